"""URL filters by a sort-merge range join, in DataFrame operations only.

A rule (host, path) holds for its host, all subdomains and all paths that begin with its own.
Hosts are written in reverse (``com.example.www``), followed by a mark and the path; so a rule is
an interval of keys, and the rules of one host nest. A url asks once for each domain that it
belongs to (its host, the host without its first label, ...) with its whole path.

Rules and questions are sorted together by key. A sweep keeps the stack of rules that have
begun: each rule carries the rules around it, so the last rule before a question has the whole
stack, and those of it that have ended are the ones that do not begin the question's key. The
sort is dealt out by ranges of keys; what is open at the start of a range is carried in. A
question's page is part of the sort order, so a url that repeats has no range for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.llm.shared import partitions, settle

MARK = "\x01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"

#: The rules of the registered query: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in ASCII lower case and path; both empty where the url is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def _stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): each rule with the rules that hold it, the longest first."""
    rules = rules.where("host is not null and path is not null and verdict is not null")
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    head = F.concat(_reversed(F.split("host", r"\.")), F.lit(MARK))
    rules = rules.select("host", "path", "verdict", F.concat(head, F.col("path")).alias("key"), F.length(head).alias("least"))
    outer = rules.select(F.col("key").alias("begin"), F.struct(F.length("key").alias("n"), "key", "host", "path", "verdict").alias("rule"))
    begins = rules.select("key", F.explode(F.expr("transform(sequence(least, length(key)), n -> substring(key, 1, n))")).alias("begin"))
    held = begins.join(outer, "begin").groupBy("key").agg(F.sort_array(F.collect_list("rule"), asc=False).alias("stack"))  # as long as a path at most
    return held


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path of the longest that fits, or null), verdict.

    ``pages`` needs page_id and url, ``rules`` host, path and verdict; other columns are not
    read. Pages that no rule fits get ``default``. The longest rule is that with the most
    characters of host and path; between rules of equal length the longer host goes first. Of
    equal rules the larger verdict holds (block before allow). Rules with nulls are left out.
    Repeated pages and null ids come out each; very long urls are read whole. Empty tables: no
    pages, or only defaults.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url").cast("string"))
    base = settle(pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id()))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(F.reverse(labels), 1, n), "."))
    asked = base.where("host <> ''").select("row", "path", F.explode(suffixes).alias("domain"))
    asked = asked.select(F.concat("domain", F.lit(MARK), "path").alias("key"), "row")
    stacks = _stacks(rules)
    none = F.lit(None).cast(stacks.schema["stack"].dataType)
    events = stacks.select("key", F.lit(-1).cast("long").alias("row"), "stack").unionByName(asked.select("key", "row", none.alias("stack")))
    swept = settle(events.repartitionByRange(partitions(spark), "key", "row").withColumn("range", F.spark_partition_id()))
    # what the ranges before leave open: one row for each range
    ends = swept.groupBy("range").agg(F.max_by("stack", F.when(F.col("row") < 0, F.col("key"))).alias("end"))
    carried = ends.select("range", F.last("end", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    begun = F.last("stack", ignorenulls=True).over(Window.partitionBy("range").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0))
    open_ = swept.withColumn("begun", begun).where("row >= 0").join(F.broadcast(carried), "range").select("row", "key", F.coalesce("begun", "carried").alias("stack"))
    inner = F.expr("get(filter(stack, r -> startswith(key, r.key)), 0)")
    hits = open_.where("stack is not null").select("row", inner.alias("hit")).where("hit is not null")
    size = F.length("hit.host") + F.length("hit.path")
    hits = hits.select("row", F.struct(size.alias("size"), F.length("hit.host").alias("host_size"), F.col("hit.host").alias("h"), F.col("hit.path").alias("p"), F.col("hit.verdict").alias("v")).alias("hit"))
    longest = hits.groupBy("row").agg(F.max("hit").alias("hit"))
    fits = ((F.col("host") == F.col("hit.h")) | F.endswith("host", F.concat(F.lit("."), F.col("hit.h")))) & F.startswith("path", F.col("hit.p"))
    judged = base.join(longest, "row", "left").withColumn("fits", F.coalesce(fits, F.lit(False)))
    return judged.select("page_id", "host", "path", F.when(F.col("fits"), F.concat("hit.h", "hit.p")).alias("rule"), F.when(F.col("fits"), F.col("hit.v")).otherwise(F.lit(default)).alias("verdict"))


def fixed_rules(spark) -> DataFrame:
    rows = ", ".join("('" + "', '".join(rule) + "')" for rule in RULES)
    return spark.sql(f"select * from values {rows} as rules(host, path, verdict)")

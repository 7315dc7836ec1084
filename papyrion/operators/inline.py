"""Inside a block: tokens, placeholders, styles, page drawings and content-stream folds."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.text import normalize, strip_model_marks
from papyrion.operators.grouped import each

# Tokens of plain text, in order of preference, and fragments without weight.
TOKENS = (
    r"\[[0-9]+(?:\s*,\s*[0-9]+)*\]\s*|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\s*|https?://\S+\s*"
    r"|[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]|[A-Za-z0-9_]+(?:['-][A-Za-z0-9_]+)*\s*|\s+|[^\s]"
)
NOISE_FRAGMENT = r"^[,.;:()\[\]{}\-–—/\\|]*(?:[→←↔]+[,.;:()\[\]{}\-–—/\\|]*)?$"
PLACEHOLDER = r"@@INLINE_FORMULA_(\d+)@@"
LATEX = r"\\\(.+?\\\)|\\\[.+?\\\]|\$\$[^$]+\$\$|\$[^$\n]+\$"


def tokens(text: Column | str) -> Column:
    """EXP-10: citations, addresses, links, single CJK characters, words with the space behind them, spaces, other signs."""
    return F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))


def monospace(lines: Column | None = None) -> Column:
    """FLT-31: share of monospace characters over items that are more than punctuation; at least 95 % is code."""
    lines = F.col("layoutLines") if lines is None else lines
    items = F.flatten(F.transform(F.coalesce(lines, F.array()), lambda line: F.coalesce(line["items"], F.array())))
    kept = F.filter(items, lambda i: ~normalize(i["text"]).rlike(NOISE_FRAGMENT))
    weight = lambda rows: F.aggregate(F.transform(rows, lambda i: F.greatest(F.length(normalize(i["text"])), F.lit(1))), F.lit(0), lambda a, x: a + x)
    return weight(F.filter(kept, lambda i: F.coalesce(i["isMonospaceLike"], F.lit(False)))) / F.greatest(weight(kept), F.lit(1))


def protect_formulas(text: Column | str) -> Column:
    """STR-11: struct(html, formulas): delimited formulas as numbered placeholders and a map back."""
    found = F.regexp_extract_all(text, F.lit(LATEX), F.lit(0))
    parts = F.split(text, LATEX, -1)
    name = lambda i: F.concat(F.lit("@@INLINE_FORMULA_"), (i + 1).cast("string"), F.lit("@@"))
    body = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i < F.size(found), name(i)).otherwise(""))), "")
    pairs = F.transform(found, lambda f, i: F.struct(name(i).alias("key"), f.alias("value")))
    return F.struct(body.alias("html"), F.map_from_entries(pairs).alias("formulas"))


def restore_formulas(text: Column, formulas: Column) -> Column:
    """STR-11, STR-14: placeholders back to formulas; unknown ones go."""
    keys = F.regexp_extract_all(text, F.lit(f"({PLACEHOLDER})"), F.lit(1))
    parts = F.split(text, PLACEHOLDER, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.element_at(formulas, F.get(keys, i)), F.lit("")))), "")


def placeholder_order(keys: Column) -> Column:
    """TOP-08: placeholders by their number."""
    numbered = F.transform(keys, lambda k: F.struct(F.regexp_extract(k, PLACEHOLDER, 1).cast("int").alias("n"), k.alias("k")))
    return F.transform(F.array_sort(numbered), lambda x: x["k"])


def stitched(blocks: DataFrame) -> DataFrame:
    """JOIN-20: adds ``sourceText``: a host's text with its drop cap in front, unless it begins with it; ``dropCapOf`` names the host's cap."""
    caps = blocks.select("doc", F.col("id").alias("dropCapOf"), normalize("text").alias("_lead"))
    joined = blocks.join(caps, ["doc", "dropCapOf"], "left")
    lead = F.coalesce("_lead", F.lit(""))
    return joined.withColumn("sourceText", F.when((lead != "") & ~F.startswith(normalize("text"), lead), F.concat(lead, F.col("text"))).otherwise(F.col("text"))).drop("_lead")


def split_first(text: Column) -> Column:
    """JOIN-20: struct(first, rest) of the first visible character."""
    t = F.regexp_replace(text, r"^\s+", "")
    return F.struct(F.substring(t, 1, 1).alias("first"), F.substr(t, F.lit(2)).alias("rest"))


def style_hints(items: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """AGG-14: (key, token, style): for each lower-case token the style with the highest priority (token, style, priority rows)."""
    return items.groupBy(*key, F.lower("token").alias("token")).agg(F.max(F.struct("priority", "style"))["style"].alias("style"))


def script_context(tokens_: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """WIN-13: adds ``script``: of a neutral token (null) that of the one before, else of the next that has one."""
    w = Window.partitionBy(*key).orderBy(order)
    before = F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("own", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return tokens_.withColumn("script", F.coalesce("own", before, after))


def style_runs(items: DataFrame, key: tuple[str, ...], order: str, units: str = "units") -> DataFrame:
    """WIN-19: adds the span (from, to) of each item as a share of its block's units."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.greatest(F.sum(units).over(Window.partitionBy(*key)), F.lit(1e-9))
    run = F.sum(units).over(w)
    return items.withColumns({"from": (run - F.col(units)) / whole, "to": run / whole})


def suppress_tails(blocks: DataFrame) -> DataFrame:
    """WIN-04: (doc, id, translatedText): of neighbouring prose headings one that repeats the other's translation becomes empty.

    ``blocks`` has doc, page, id, bbox, translatedText and ``sequence`` (a demoted prose heading).
    A suppressed text reads as empty for the block after it, so a document is one ordered pass.
    """
    slim = blocks.select("doc", "page", "id", F.col("bbox")[1].alias("y"), F.col("bbox")[0].alias("x"), strip_model_marks(F.coalesce("translatedText", F.lit(""))).alias("translatedText"), F.coalesce("sequence", F.lit(False)).alias("sequence"))
    sign = lambda t: "".join(c for c in t if c.isalnum())

    def run(rows: list[dict]) -> list[dict]:
        out, last = [], None
        for r in rows:
            text = r["translatedText"]
            if r["sequence"] and last is not None and last["page"] == r["page"]:
                a, b = sign(last["text"]), sign(text)
                if min(len(a), len(b)) >= 10 and (b in a or (r["y"] - last["y"] >= -2 and difflib.SequenceMatcher(None, a, b).ratio() >= 0.82)):
                    text = ""
            out.append({"doc": r["doc"], "id": r["id"], "translatedText": text})
            last = {**r, "text": text} if r["sequence"] else None
        return out

    kind = slim.schema["doc"].dataType.simpleString()
    return each(slim, ["doc"], ["page", "y", "x", "id"], run, f"doc {kind}, id string, translatedText string")


# ---------------------------------------------------------------- drawings and content streams


def horizontal_segments(lines: DataFrame, key: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """SRC-12: (key, x0, y, x1) of path lines (px, py, qx, qy) that are long and level."""
    rows = lines.where((F.abs(F.col("qx") - F.col("px")) >= 40) & (F.abs(F.col("qy") - F.col("py")) <= 1.5))
    return rows.select(*key, F.least("px", "qx").alias("x0"), ((F.col("py") + F.col("qy")) / 2).alias("y"), F.greatest("px", "qx").alias("x1"))


def cluster_segments(segments: DataFrame, key: tuple[str, ...] = ("doc", "page"), tolerance: float = 10.0) -> DataFrame:
    """WIN-15: adds ``cluster``: segments join the first cluster whose mean ends are near; a page is one group."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in segments.schema.fields)

    def run(rows: list[dict]) -> list[dict]:
        sums: list[list[float]] = []  # of each cluster: members, sum of left ends, sum of right ends
        out = []
        for r in rows:
            a, b = r["x0"], r["x1"]
            at = next((k for k, (n, p, q) in enumerate(sums) if abs(a - p / n) <= tolerance and abs(b - q / n) <= tolerance), None)
            if at is None:
                at = len(sums)
                sums.append([0, 0.0, 0.0])
            sums[at] = [sums[at][0] + 1, sums[at][1] + a, sums[at][2] + b]
            out.append({**r, "cluster": at})
        return out

    return each(segments, list(key), ["x0", "x1", "y"], run, f"{kinds}, cluster long")


def text_objects(instructions: DataFrame, key: tuple[str, ...] = ("doc", "page", "stream")) -> DataFrame:
    """SRC-14, STR-21, WIN-20: (key, object, n, text) of instruction rows (ord, op, text): what stands between BT and ET.

    The number of an object is the running count of BT; instructions outside are left out.
    """
    w = Window.partitionBy(*key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    begun, ended = F.sum(F.when(F.col("op") == "BT", 1).otherwise(0)).over(w), F.sum(F.when(F.col("op") == "ET", 1).otherwise(0)).over(w)
    rows = instructions.withColumns({"object": begun - 1, "_open": begun > ended}).where("_open and op <> 'BT'")
    shown = F.when(F.col("op").isin("Tj", "TJ", "'", '"'), F.coalesce("text", F.lit(""))).otherwise("")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", shown.alias("t")))), lambda x: x["t"]), "")
    return rows.groupBy(*key, "object").agg(F.count("*").alias("n"), joined.alias("text"))


def strip_text_objects(instructions: DataFrame, kept: DataFrame, key: tuple[str, ...] = ("doc", "page", "stream")) -> DataFrame:
    """WIN-20, FLT-38: instructions without the text objects that are not in ``kept`` (key, object); what is outside of objects stays."""
    w = Window.partitionBy(*key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.sum(F.when(F.col("op") == "BT", 1).otherwise(0)).over(w)
    ended = F.sum(F.when(F.col("op") == "ET", 1).otherwise(0)).over(w)
    rows = instructions.withColumns({"object": begun - 1, "_in": (begun > ended) | (F.col("op") == "ET")})
    inside = rows.where("_in").join(kept.select(*key, "object"), [*key, "object"], "left_semi")
    return inside.select(*instructions.columns).unionByName(rows.where("not _in").select(*instructions.columns))

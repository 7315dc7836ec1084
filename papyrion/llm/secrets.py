"""Secret scan: candidates by pattern, false positives removed by a random forest.

Everything runs in DataFrame operations and the JVM's random forest; no Python on executors.

*Candidates* are runs of token characters with a digit, with both cases or with the beginning of an
issued key, cut out of words; and values after a word that asks for a secret, which may be shorter
and hold other characters. A document without either is dropped by regular expressions before its
words are looked at.

*Features* of a candidate are its length, how often the class of characters changes, its
variety, shares of digits, capitals, hexadecimal digits and other characters, how much of it words
of a dictionary cover, words of its path, and the words around it. The *dictionary* holds the words
that most documents of the corpus have (all documents are counted) and parts of readable tokens.

The forest learns from *labelled findings* (candidate, before, after, path, label). By default
these are drawn from generators of the usual kinds of secrets and of what looks like them
(checksums, versions, identifiers, placeholders, numbers); a table of reviewed findings can be
given instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Labelled findings that are drawn where none are given; trees and depth of the forest.
DRAWN, TREES, DEPTH, SEED = 4000, 24, 7, 42
#: Words of the dictionary at most, and documents that have to have one.
DICTIONARY, LEAST_DOCUMENTS = 4096, 3
#: Runs of letters in a candidate as words are written together: aB is a word end, as is a change to other characters.
RUNS = "[A-Z]?[a-z]+|[A-Z]+(?![a-z])"
#: Marks around candidates; neither is ever part of one.
OPEN, CLOSE = "\x01", "\x02"

#: Words that come before secrets, words that come before other things, and parts of readable tokens.
ASKS = "pass(word|wd|phrase)?|pwd|secret|token|api_?-?key|apikey|access_?key|private_?key|auth|credential|bearer|client_?secret"
TELLS = "commit|sha-?(1|256|512)?|md5|checksum|digest|hash|revision|version|uuid|guid|isbn|id|ref|order|invoice|phone|file|path|page|build|example|sample|dummy|placeholder"
PARTS = "example|sample|test|demo|dummy|foo|bar|placeholder|changeme|your|key|user|name|version|release|build|file|image|page|index|module|package|license|mail|http|www|org|com|net|json|html|data|model|layer|node|item|list|value|config|default|public|static|assets|docs|src|lib|main|the|and|ing|tion|er|en|re|st"
PLACES = "test|example|fixture|sample|lock|vendor|doc"
#: Beginnings of issued keys.
ISSUED = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|rk_live_|xox[abprs]-|AIza|ya29|eyJ|SG|npm_|pypi-"

#: Token characters: at least 12 of them, with a digit, both cases or an issued beginning. Longer runs are one candidate each.
TOKEN = rf"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*+[0-9]|[A-Z_+/\-]*+[a-z][a-z_+/\-]*+[A-Z]|[A-Z][A-Z_+/\-]*+[a-z]|(?:{ISSUED}))[A-Za-z0-9_+/\-]{{12,}}+={{0,2}}"
#: A word that asks for a secret with a sign of assignment; the same at the end of what stands before a value.
ASSIGNS = rf"(?i:{ASKS})[\"'`]?[=:]{{1,2}}>?[\"'`]?"
ASKED = rf"(?i)(?:^|[^A-Za-z])(?:{ASKS})[^A-Za-z0-9]*$"
#: A value after such a word: at least 8 characters up to white space, a quote or the next parameter of a url, without closing punctuation.
VALUE = rf"(?<={ASSIGNS})(?![=:>])(?:(?!&[A-Za-z_]+=)[^\x00-\x20\"'`]){{7,}}(?<!&)(?!&[A-Za-z_]+=)[^\x00-\x20\"'`.,;:)\]}}>]"
CANDIDATE = rf"{VALUE}|{TOKEN}"

FEATURES = ("size", "changes", "variety", "digits", "capitals", "hexadecimal", "covered", "issued", "asked", "told", "assigned", "quoted", "place", "dashes", "vowels", "marks")


def _share(text: Column, pattern: str, of: Column) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(of), F.lit(1))


def dictionary(docs: DataFrame) -> list[str]:
    """The words of 3 letters on that most documents have, DICTIONARY at most; counted over all documents."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit("[a-z]{3,}"), 0))).alias("word"))
    most = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    return [r["word"] for r in most.orderBy(F.col("n").desc(), "word").limit(DICTIONARY).collect()]


def featured(findings: DataFrame, words: Sequence[str] = ()) -> DataFrame:
    """Adds FEATURES to rows with candidate, before, after, path; ``words`` is the dictionary."""
    c, low = F.col("candidate"), F.lower("candidate")
    runs = F.transform(F.regexp_extract_all(c, F.lit(RUNS), 0), F.lower)
    known = F.expr(f"filter(_runs, x -> x in ({', '.join(repr(w) for w in sorted({*words, 'example'}))}))")
    in_words = F.aggregate("_known", F.lit(0), lambda n, w: n + F.length(w))
    in_parts = F.length(c) - F.length(F.regexp_replace(low, f"(?:{PARTS})", ""))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    columns = {
        "size": F.log2(F.length(c) + 1),
        "changes": _share(c, r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])", c),
        "variety": F.size(F.filter(F.array(*(F.lit(chr(k)) for k in range(0x21, 0x7F))), lambda x: F.contains(c, x))) / F.greatest(F.least(F.length(c), F.lit(94)), F.lit(1)),
        "digits": _share(c, "[0-9]", c),
        "capitals": _share(c, "[A-Z]", c),
        "hexadecimal": _share(c, "[0-9a-f]", c),
        "covered": F.greatest(in_words, in_parts) / F.greatest(F.length(c), F.lit(1)),
        "issued": flag(c.rlike(f"^(?:{ISSUED})")),
        "asked": flag(F.col("before").rlike(ASKED)),
        "told": flag(F.col("before").rlike(rf"(?i)(?:^|[^A-Za-z])(?:{TELLS})[^A-Za-z0-9]*$")),
        "assigned": flag(F.col("before").rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")),
        "place": flag(F.lower(F.coalesce("path", F.lit(""))).rlike(f"(?:{PLACES})")),
        "dashes": _share(c, r"[_/\-]", c),
        "vowels": _share(low, "[aeiou]", c),
        "marks": _share(c, r"[^A-Za-z0-9_+/\-=]", c),
    }
    found = findings.withColumn("_runs", runs).withColumn("_known", known)
    return found.withColumns({k: v.cast("double") for k, v in columns.items()}).drop("_runs", "_known")


def drawn_findings(spark: SparkSession, n: int = DRAWN) -> DataFrame:
    """Labelled findings by generators: (candidate, before, after, path, label). The same for every call."""
    h = lambda k: F.sha2(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")), 256)
    mixed = lambda k: F.translate(F.base64(F.unhex(h(k))), "+/=", "xYz")
    upper = F.translate(F.upper(F.substring(h(3), 1, 40)), "01289", "GHKMZ")
    pick = lambda k, *values: F.element_at(F.array(*map(F.lit, values)), (F.conv(F.substring(h(k), 1, 6), 16, 10).cast("int") % len(values) + 1).cast("int"))
    cut = lambda text, k, *sizes: F.substr(text, F.lit(1), pick(k, *sizes))
    word = pick(4, "the", "with", "and", "of", "in", "for", "notes", "about", "see", "from")
    asked = pick(5, "password=", "PASSWORD: ", "secret = \"", "token = \"", "api_key=", "apiKey: '", "Authorization: Bearer ", "access_key = ", "client_secret=", "auth_token: ")
    told = pick(6, "commit ", "sha256:", "checksum ", "md5 = ", "version ", "uuid ", "order id ", "invoice ", "file ", "build ", "revision: ", "ref ")
    number = F.regexp_replace(F.concat(h(7), h(8)), "[a-f]", "")
    uuid = F.concat_ws("-", *(F.substring(h(9), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    name = F.concat(pick(10, "user", "item", "image", "module", "page", "layer", "example", "test", "release"), F.lit("_"), pick(11, "name", "index", "default", "value", "list", "public", "data"), F.lit("_"), F.substring(number, 1, 4))
    letters = lambda k: F.translate(mixed(k), "0123456789", "qWzRtYpSdF")
    syllable = lambda k: pick(k, "ge", "ver", "schwin", "dig", "keit", "wal", "tung", "in", "for", "ma", "tion", "com", "mu", "ni", "ca", "re", "spon", "sa", "bil", "lich", "con", "des", "ar", "men", "to")
    long_word = F.concat(*(syllable(k) for k in range(30, 36)))
    short_word = pick(36, "required", "protected", "information", "manager", "settings", "authentication", "validation", "rotation", "encryption", "expiration", "generator", "forgotten", "disabled", "undefined")
    mark = lambda k: pick(k, "!", "@", "#", "$", ".", "%", "&", "*", "?", "^")
    camel = F.concat(pick(37, "get", "set", "User", "Abstract", "create", "Default", "is"), pick(38, "Account", "Session", "Document", "Request", "Message"), pick(39, "Manager", "Factory", "Handler", "Service", "Controller", "Name"))
    compound = F.concat(F.initcap(syllable(40)), syllable(41), syllable(42), pick(43, "-", "/"), pick(44, "", "A", "B"), syllable(45), syllable(46), syllable(47))
    code = pick(48, "os.environ.get", "request.headers", "getPassword()", "<password>", "${DB_PASSWORD}", "********", "config.auth.token", "https://example.com/login", "user@example.com", "self._password", "process.env.SECRET", "{{secret_key}}", "[REDACTED]")
    path = F.concat(pick(12, "src/", "docs/", "assets/images/", "lib/static/"), name)
    kinds = [
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), F.concat(word, F.lit(" ")), " ", 1),
        (F.concat(pick(13, "ghp_", "sk_live_", "glpat-", "npm_"), cut(mixed(1), 14, 20, 24, 36)), F.concat(word, F.lit(" ")), " ", 1),
        (cut(h(2), 15, 16, 18, 20, 24, 32, 40), asked, "", 1),
        (cut(mixed(1), 16, 16, 20, 24, 32, 40), asked, "", 1),
        (cut(h(2), 17, 32, 40, 64), F.concat(told, F.lit("")), " ", 0),
        (uuid, F.concat(pick(18, "uuid ", "id=", "ref: ", "see "), F.lit("")), " ", 0),
        (cut(number, 19, 12, 13, 15, 16, 18), F.concat(word, F.lit(" ")), " ", 0),
        (name, F.concat(pick(20, "the ", "key = ", "name: ", "call ", "token: "), F.lit("")), "", 0),
        (path, F.concat(word, F.lit(" ")), " ", 0),
        (F.concat(pick(21, "example", "your", "changeme", "dummy", "sample"), pick(22, "_token_", "_password_", "_key_"), F.lit("1234")), asked, "", 0),
        (F.concat(F.lit("xxxxxxxxxxxx"), F.substring(number, 1, 2)), asked, "", 0),
        (F.concat(F.lit("2024-"), F.substring(number, 1, 2), F.lit("-"), F.substring(number, 3, 2), F.lit("-"), F.substring(number, 5, 4)), F.concat(word, F.lit(" ")), " ", 0),
        (F.concat(F.lit("AKIA"), F.substring(F.upper(letters(49)), 1, 16)), F.concat(word, F.lit(" ")), " ", 1),
        (cut(letters(50), 51, 12, 16, 20, 24, 32, 40), asked, "", 1),
        (cut(mixed(52), 53, 8, 9, 10, 11), asked, "", 1),
        (F.concat(cut(mixed(54), 55, 3, 4, 6), mark(56), cut(mixed(57), 58, 4, 5, 8), mark(59), F.substring(number, 1, 2)), asked, "", 1),
        (F.concat(F.initcap(syllable(60)), syllable(61), pick(62, "", "x", "T"), F.substring(number, 7, 4), mark(63), pick(64, "", "z", "Q")), asked, "", 1),
        (F.concat(pick(65, "ghp_", "sk_live_", "glpat-", "npm_"), cut(letters(66), 67, 20, 24, 36)), F.concat(word, F.lit(" ")), " ", 1),
        (F.initcap(long_word), F.concat(word, F.lit(" ")), " ", 0),
        (camel, F.concat(pick(68, "the ", "call ", "token: ", "see ", "auth = ", "class "), F.lit("")), "", 0),
        (compound, F.concat(word, F.lit(" ")), " ", 0),
        (short_word, F.concat(pick(69, "password ", "token ", "secret ", "Password: ", "auth: ", "credential ", "token="), F.lit("")), " ", 0),
        (F.substr(long_word, F.lit(1), pick(70, 8, 9, 11, 14)), F.concat(pick(71, "password ", "token ", "secret ", "Password: ", "auth: "), F.lit("")), " ", 0),
        (code, asked, "", 0),
    ]
    kind = F.col("id") % len(kinds)
    choose = lambda part: F.coalesce(*(F.when(kind == k, v[part] if isinstance(v[part], Column) else F.lit(v[part])) for k, v in enumerate(kinds)))
    rows = spark.range(0, n, 1, 4)
    before = F.concat(word, F.lit(" "), choose(1))
    after = F.when(before.rlike("[\"']$"), F.substring(before, -1, 1)).otherwise(choose(2))
    return rows.select(choose(0).alias("candidate"), before.alias("before"), after.alias("after"), pick(23, "src/main", "config", "web", "tests/fixtures", "docs").alias("path"), choose(3).cast("double").alias("label"))


def train(findings: DataFrame, words: Sequence[str] = ()) -> PipelineModel:
    """A forest over labelled findings, with ``words`` as dictionary; rows with nulls in candidate or label are left out."""
    rows = featured(findings.where("candidate is not null and label is not null"), words).fillna("", ["before", "after", "path"])
    parts = [VectorAssembler(inputCols=list(FEATURES), outputCol="features"), RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=5)]
    assembled = parts[0].transform(rows).select("features", "label")
    return PipelineModel([parts[0], parts[1].fit(assembled)])


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """Every candidate of every text: doc_id, word (index from 0), part (index within the word), candidate, before, after, path."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (F.col(path) if path in docs.columns else F.lit(None)).cast("string").alias("path"))
    words = rows.where(F.col("text").rlike(TOKEN) | F.col("text").rlike(rf"(?i:{ASKS})[^A-Za-z0-9]")).withColumn("words", F.split("text", SPACE)).drop("text")
    ends = lambda one, two: F.coalesce(one.rlike(ASKED) | (~one.rlike("[A-Za-z0-9]") & two.rlike(ASKED)), F.lit(False))
    at_word = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    wanted = lambda i: at_word(i).rlike(TOKEN) | at_word(i).rlike(ASSIGNS) | ((F.length(at_word(i)) >= 8) & ends(at_word(i - 1), at_word(i - 2)))
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), wanted)
    found = words.withColumn("word", F.explode(at))
    near = lambda k: at_word(F.col("word") + k)
    found = found.select("doc_id", "path", "word", F.get("words", F.col("word")).alias("text"), ends(near(-1), near(-2)).alias("asked"), F.concat_ws(" ", near(-3), near(-2), near(-1)).alias("left"))
    # a value whose word follows the word that asks for it is read as if it were assigned
    given = F.col("asked") & ~F.col("text").rlike(ASSIGNS)
    read = F.concat(F.when(given, "token=").otherwise(""), F.translate("text", OPEN + CLOSE, "\x03\x03"))
    # between marks every second part is a candidate, and the others are what stands around it
    parts = F.split(F.regexp_replace(read, f"({CANDIDATE})", f"{OPEN}$1{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)
    found = found.select("doc_id", "path", "word", "left", given.alias("given"), parts.alias("parts")).where(F.size("parts") > 1)
    found = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.size("parts") - 3) / 2).cast("int"))))
    at = F.col("part") * 2 + 1
    ahead = F.array_join(F.slice("parts", F.lit(1), at), "")
    return found.select(
        "doc_id", "word", "part", F.get("parts", at).alias("candidate"), "path",
        F.concat("left", F.lit(" "), F.when(F.col("given"), F.substr(ahead, F.lit(7))).otherwise(ahead)).alias("before"),
        F.array_join(F.slice("parts", at + 2, F.size("parts")), "").alias("after"),
    )


def scan(docs: DataFrame, model: PipelineModel | None = None, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, word, part, n_chars, candidate_sha256, score, is_secret.

    ``docs`` needs doc_id and text, and ``path`` where it has one; other columns are not read.
    Null texts hold nothing; a repeated row gives its candidates again; a null doc_id is kept. ``word`` counts
    words between ASCII white space (a text that begins with white space has an empty word 0). Very long
    texts and words are read whole. An empty table gives an empty result. A ``model`` of one's own has
    to be trained with ``dictionary(docs)`` to see the words that it sees here.
    ``score`` is the forest's share for a secret, rounded to 6 digits; is_secret from ``threshold`` on.
    """
    words = dictionary(docs)
    model = model or train(drawn_findings(docs.sparkSession), words)
    found = featured(candidates(docs, path), words)
    judged = model.transform(found).withColumn("score", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6))
    return judged.select("doc_id", "word", "part", F.length("candidate").alias("n_chars"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", (F.col("score") >= threshold).alias("is_secret"))

"""Page layout: block rules as column expressions, page statistics as aggregates, order-dependent marks as windows.

A block row has the columns of ``schemas.BLOCK`` (snake-case reading aids are not used, so rows
of JSON payloads fit as they are) and, where needed, ``doc``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions import geom
from papyrion.functions.text import FORMULA_SYMBOLS, FORMULA_TOKENS, compact, count, formula_heavy, meta_note, private_use, signature, strip_model_marks
from papyrion.functions.text import normalize as _normalize

# Patterns of the rules.
SECTION = r"^(?:\d+(?:\.\d+)*|[A-Z])(?:[.)])?\s+[^\s].{0,120}$"
CAPTION = r"(?i)^(?:figure|fig\.|table)\s+\d+[.:]?\s+|^(?:图|表)\s*\d+[：:.\s]"
TABLE_CAPTION, FIGURE_CAPTION = r"(?i)^table\s+\d+[.:]?\s+", r"(?i)^(?:figure|fig\.)\s+\d+[.:]?\s+"
ARXIV = r"(?i)^arxiv:\d{4}\.\d{4,5}(?:v\d+)?\s+\[[A-Za-z.\-]+\]\s+\d{1,2}\s+[A-Z][a-z]{2}\s+\d{4}$"
BYLINE = r"(?i)^[A-Z][A-Za-zÀ-ÖØ-öø-ÿ.'\-]+(?:\s+[A-Z][A-Za-zÀ-ÖØ-öø-ÿ.'\-]+){1,3}\s+writes\s+for\s+.+?\s+from\s+.+$"
CONNECTOR = r"(?:^|[^A-Za-z0-9_])(?:and|but|if|because|when|while|that|which|who|they|we|however|therefore)(?:$|[^A-Za-z0-9_])|如果|但是|然而|因为|所以|而且|并且|他们|我们|这种|这样|于是"
CONTINUES = r"^(?:and|but|if|because|when|while|that|which|who|they|we|however|therefore)(?:$|[^A-Za-z0-9_])|^(?:如果|但是|然而|因为|所以|而且|并且|他们|我们|这种|这样|于是)"
SENTENCE_END = r"[。！？?!.][\"”’»）)]?$"
MARKS, MARKS_AND_COMMAS = r"[，。；：.!?]", r"[，。；：,.!?]"
RUNNING = r"^[A-Z][A-Z\s/&-]{0,23}$"
FIELD_LABELS = ("document_index", "key_value_region", "field_region", "field_heading", "field_item", "field_key", "field_value", "field_hint")
REFERENCE_TITLES = ("references", "bibliography", "参考文献")


_known: dict[str, str] = {}


@contextmanager
def normalized(**columns: str) -> Iterator[None]:
    """Rules that are formed inside read the normalised text of a column from another, so it is worked out once for all of them."""
    _known.update(columns)
    try:
        yield
    finally:
        for name in columns:
            del _known[name]


def normalize(text: Column | str) -> Column:
    return F.col(_known[text]) if isinstance(text, str) and text in _known else _normalize(text)


def _s(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _d(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _box() -> Column:
    return F.col("bbox")


def _tokens(text: Column) -> Column:
    return count(text, r"\S+")


def line_texts(lines: Column | None = None) -> Column:
    """EXP-12: texts of the lines that have any."""
    lines = F.col("layoutLines") if lines is None else lines
    texts = F.transform(F.coalesce(lines, F.array()), lambda line: normalize(F.array_join(F.transform(F.coalesce(line["items"], F.array()), lambda i: F.coalesce(i["text"], F.lit(""))), "")))
    return F.filter(texts, lambda t: t != "")


def text_items(lines: Column | None = None) -> Column:
    """Items of type text with a text, of all lines."""
    lines = F.col("layoutLines") if lines is None else lines
    items = F.flatten(F.transform(F.coalesce(lines, F.array()), lambda line: F.coalesce(line["items"], F.array())))
    return F.filter(items, lambda i: (i["type"] == "text") & (normalize(i["text"]) != ""))


def n_lines() -> Column:
    return F.coalesce(F.size("layoutLines"), F.lit(0))


# ---------------------------------------------------------------- block rules


def section_signal() -> Column:
    """FLT-21."""
    return (_s("role") == "heading") | _s("doclingLabel").isin("section_header", "title") | (_s("blockType") == "heading")


def reference_heading() -> Column:
    """FLT-21."""
    return F.lower(normalize("text")).isin(*REFERENCE_TITLES)


def prose() -> Column:
    """FLT-22: at least three of five signals, or clear cases by lines."""
    t, lines = normalize("text"), line_texts()
    n, marks, tokens, size = F.size(lines), count(t, MARKS_AND_COMMAS), _tokens(t), F.length(t)
    joined, ends = t.rlike(CONNECTOR), t.rlike(SENTENCE_END)
    quoted = t.rlike("^[\"“‘']|[\"”’']$")
    goes_on = F.coalesce(F.get(lines, F.lit(1)).rlike(CONTINUES), F.lit(False))
    signals = sum((s.cast("int") for s in (marks >= 2, (tokens >= 10) | (size >= 40), joined, ends, goes_on)), F.lit(0))
    clear = ((n >= 3) & ((marks >= 1) | joined)) | (quoted & ((marks >= 1) | joined) & (size >= 28)) | ((n >= 2) & (marks >= 2) & ((tokens >= 8) | (size >= 32)))
    return (t != "") & ~t.rlike(SECTION) & (n > 0) & (clear | (signals >= 3))


def paragraph_like_heading(body_size: Column, body_width: Column) -> Column:
    """FLT-22: a heading that reads like a paragraph."""
    t, n = normalize("text"), F.size(line_texts())
    marks, size = count(t, MARKS), F.length(t)
    near = _d("fontSize") <= F.greatest(body_size * 1.45, body_size + 4.0)
    wide = F.coalesce(geom.width(_box()) >= body_width * 0.72, F.lit(False))
    long_ = ((n >= 3) & (size >= 60)) | (near & (size >= 90)) | (near & (_tokens(t) >= 14)) | (wide & (size >= 70))
    return (n >= 2) & (marks >= 1) & long_ & ~t.rlike(SECTION)


def heading(body_size: Column) -> Column:
    """FLT-22."""
    t = normalize("text")
    return (t != "") & (F.length(t) <= 140) & (t.rlike(SECTION) | (_d("fontSize") >= F.greatest(body_size * 1.18, body_size + 1.2)))


def display_formula() -> Column:
    """FLT-17: a centred formula of its own."""
    t, b, page = normalize("text"), _box(), F.greatest(_d("pageWidth", 1.0), F.lit(1.0))
    share = F.greatest(b[2] - b[0], F.lit(1.0)) / page
    centred = F.abs((b[0] + b[2]) / 2 - page / 2) <= page * 0.12
    symbols, tokens, latin = count(t, FORMULA_SYMBOLS), count(t, FORMULA_TOKENS), count(t, "[A-Za-z]")
    chunks = count(t, r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]{4,}|[A-Z][a-z]{3,}|[a-z]{4,}")
    reads = (chunks >= 2) & (count(t, MARKS) >= 1)
    return (t != "") & (F.length(t) <= 180) & centred & share.between(0.18, 0.72) & ~reads & (((symbols >= 1) & (tokens >= 2) & (latin >= 4)) | ((tokens >= 3) & (latin >= 6)))


def _body_text(least: int) -> Column:
    t, n = normalize("text"), n_lines()
    marks, size = count(t, MARKS), F.length(t)
    return ((size >= 80) & (marks >= 1)) | ((size >= 90) & (n >= 2)) | (size >= least) | ((n >= 3) & (size >= (60 if least == 120 else 70)) & (marks >= 1))


def _no_body() -> Column:
    t = normalize("text")
    return (t == "") | (_s("role") == "heading") | t.rlike(CAPTION) | private_use("text") | display_formula()


def _near_size(body_size: Column) -> Column:
    return (_d("fontSize") > 0) & (F.abs(_d("fontSize") - body_size) <= F.greatest(body_size * 0.22, F.lit(1.5)))


def body_width_candidate(body_size: Column) -> Column:
    """FLT-23: a block whose width tells the page's column width."""
    share = geom.width(_box()) / F.greatest(_d("pageWidth", 1.0), F.lit(1.0))
    return ~_no_body() & share.between(0.18, 0.86) & _near_size(body_size) & _body_text(120)


def body_like(body_width: Column, body_size: Column) -> Column:
    """FLT-23."""
    w = geom.width(_box())
    share = w / F.greatest(_d("pageWidth", 1.0), F.lit(1.0))
    fits = F.when(body_width.isNotNull(), F.abs(w - body_width) <= F.greatest(body_width * 0.16, F.lit(24.0))).otherwise(share.between(0.3, 0.86))
    return ~_no_body() & (w > 0) & fits & _near_size(body_size) & _body_text(140)


def block_type(body_width: Column, body_size: Column) -> Column:
    """PRJ-02: by label, then by content."""
    label, t, like = _s("doclingLabel"), normalize("text"), body_like(body_width, body_size)
    named = {"caption": "caption", "table": "table_body", "formula": "formula_display", "reference": "reference_block", "footnote": "footnote", "page_header": "page_header", "page_footer": "page_footer"}
    out = F.when(F.coalesce(F.col("demotedFromHeading"), F.lit(False)), "body").when(label.isin("title", "section_header"), "heading")
    for name, kind in named.items():
        out = out.when(label == name, kind)
    out = out.when(label.isin(*FIELD_LABELS), "metadata").when(label.isin("picture", "chart"), "other")
    out = out.when(label.isin("text", "paragraph", "list_item"), F.when(like, "body").otherwise("metadata"))
    return out.when(t.rlike(ARXIV), "metadata").when(t.rlike(CAPTION), "caption").when(_s("role") == "heading", "heading").when(like, "body").otherwise("metadata")


def layout_intent(body_width: Column, body_size: Column) -> Column:
    """PRJ-01."""
    t, b, page = normalize("text"), _box(), F.greatest(_d("pageWidth", 1.0), F.lit(1.0))
    tall, marks, size = F.greatest(_d("pageHeight", 1.0), F.lit(1.0)), count(t, MARKS), F.length(t)
    w = geom.width(b)
    share, edge = w / page, (b[3] <= tall * 0.18) | (b[1] >= tall * 0.82)
    shown = F.filter(
        F.transform(F.coalesce(F.col("layoutLines"), F.array()), lambda line: F.struct(
            normalize(F.array_join(F.transform(F.filter(F.coalesce(line["items"], F.array()), lambda i: (i["type"] == "text") & (normalize(i["text"]) != "")), lambda i: i["text"]), "")).alias("t"),
            (geom.width(line["bbox"]) / page).alias("w"),
            F.exists(F.coalesce(line["items"], F.array()), lambda i: (i["type"] == "text") & (normalize(i["text"]) != "") & F.coalesce(i["isMonospaceLike"], F.lit(False))).alias("m"),
        )), lambda x: x["t"] != "")
    total = F.aggregate(F.transform(shown, lambda x: _tokens(x["t"])), F.lit(0), lambda a, x: a + x)
    mean = total / F.greatest(F.size(shown), F.lit(1))
    widths = F.transform(shown, lambda x: x["w"])
    spread = F.when(F.size(shown) >= 2, F.array_max(widths) - F.array_min(widths)).otherwise(0.0)
    mono, some = F.exists(shown, lambda x: x["m"]), (n_lines() >= 3) & (F.size(shown) > 0)
    paragraph = (size >= 140) & (marks >= 2) & (_tokens(t) >= 18) & (F.abs(_d("fontSize") - body_size) <= F.greatest(body_size * 0.25, F.lit(2.0)))
    paragraph &= body_width.isNull() | (F.abs(w - body_width) <= F.greatest(body_width * 0.28, F.lit(36.0)))
    return (
        F.when((t == "") | ~_s("blockType").isin("metadata", "footnote"), "generic")
        .when(some & (size >= 140) & (marks >= 2) & (mean >= 4) & (share >= 0.55), "note_paragraph")
        .when(some & edge & (size >= 90) & (marks >= 1) & (mean >= 4) & (share >= 0.45), "note_paragraph")
        .when(some & (mean <= 3.2) & (spread >= 0.12) & mono, "structured_fields")
        .when(some & (mean <= 3.5) & (marks == 0) & (spread >= 0.08), "structured_fields")
        .when(F.coalesce(paragraph, F.lit(False)), "note_paragraph")
        .when(n_lines() >= 2, "structured_fields")
        .otherwise("generic")
    )


def tableish(text: Column | str = "text") -> Column:
    """FLT-20."""
    t = normalize(text)
    digits, words = count(t, r"\d"), count(t, "[A-Za-z]{2,}")
    return (t != "") & (t.rlike("BLEU|FLOPs|EN-DE|EN-FR") | ((digits >= 4) & ((words <= 10) | (count(t, r"[×·.=<>≤≥%/+\-]") >= 2))) | ((count(t, "[A-Z]") >= 6) & (words <= 8)))


def short_or_tableish() -> Column:
    """FLT-20."""
    t = normalize("text")
    return (t != "") & (tableish() | ((F.length(t) <= 32) & t.rlike(r"\d")) | ((F.length(t) <= 24) & (count(t, "[A-Za-z]{2,}") <= 4)))


def prose_like() -> Column:
    t = normalize("text")
    return (F.length(t) >= 70) & t.rlike(MARKS)


def table_supporting() -> Column:
    return normalize("text").rlike(TABLE_CAPTION) | tableish() | (short_or_tableish() & ~prose_like())


def table_body() -> Column:
    """FLT-20."""
    t = normalize("text")
    return (t != "") & ~t.rlike(TABLE_CAPTION) & ~t.rlike(SECTION) & (_s("role") != "heading") & ~prose_like() & (tableish() | (short_or_tableish() & (F.length(t) <= 48)))


def figure_label(page_body_size: Column) -> Column:
    """FLT-20."""
    t, tokens = normalize("text"), _tokens(normalize("text"))
    calm = count(t, MARKS) == 0
    words = count(t, "[A-Za-z][A-Za-z'-]*") + count(t, r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]{2,}")
    few = (tokens <= 8) & calm
    size, base = _d("fontSize"), F.coalesce(page_body_size, F.lit(0.0))
    small = (base > 0) & (size > 0) & (size <= base - 1.2)
    no = (t == "") | t.rlike(FIGURE_CAPTION) | t.rlike(TABLE_CAPTION) | section_signal() | (_s("doclingLabel") == "caption") | prose_like()
    no = no | (geom.width(_box()) >= F.greatest(_d("pageWidth") * 0.42, F.lit(220.0)))
    short = (F.length(t) <= 28) & calm
    yes = t.rlike("<[^>]+>") | ((_s("doclingLabel") == "picture") & few) | ((F.coalesce("rotation", F.lit(0)) != 0) & few) | (small & few) | (short & ((words <= 8) | t.rlike(r"\d")))
    return ~no & yes


def footnote() -> Column:
    return (_s("blockType") == "footnote") | (_s("doclingLabel") == "footnote")


def byline() -> Column:
    """FLT-19."""
    t = normalize("text")
    return (F.length(t) <= 180) & t.rlike(BYLINE)


def author_metadata() -> Column:
    """FLT-19: two to four lines: a bold name, what is between, an address in monospace."""
    t = normalize("text")
    item_of = lambda line: F.filter(F.coalesce(line["items"], F.array()), lambda i: (i["type"] == "text") & (normalize(i["text"]) != ""))
    rows = F.filter(F.transform(F.coalesce(F.col("layoutLines"), F.array()), lambda line: F.struct(normalize(F.array_join(F.transform(F.coalesce(line["items"], F.array()), lambda i: F.coalesce(i["text"], F.lit(""))), "")).alias("t"), item_of(line).alias("i"))), lambda r: r["t"] != "")
    n = F.size(rows)
    yes = lambda flag: lambda i: F.coalesce(i[flag], F.lit(False))
    first, last = F.get(rows, F.lit(0)), F.get(rows, n - 1)
    middle = F.slice(rows, 2, F.greatest(n - 2, F.lit(0)))
    calm = F.forall(middle, lambda r: (F.size(r["i"]) > 0) & ~F.contains(r["t"], F.lit("@")) & (_tokens(r["t"]) <= 8) & (count(r["t"], MARKS) <= 1) & ~F.exists(r["i"], yes("isMonospaceLike")))
    kinds = _s("blockType").isin("metadata", "page_header", "page_footer") | _s("doclingLabel").isin("text", "list_item", "key_value_region", "field_region")
    shape = F.contains(t, F.lit("@")) & kinds & n_lines().between(2, 4) & (F.length(t) < 160) & n.between(2, 4)
    name = (count(first["t"], "[A-Za-zÀ-ÖØ-öø-ÿ]+") >= 2) & F.exists(first["i"], yes("isBoldLike")) & (_tokens(first["t"]) <= 6)
    address = last["t"].rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}") & F.exists(last["i"], yes("isMonospaceLike"))
    return F.coalesce(shape & name & address & calm, F.lit(False))


def tiny_label() -> Column:
    """FLT-30."""
    b = _box()
    return (_s("blockType") == "metadata") & (_s("role") == "paragraph") & (n_lines() == 1) & (F.size("bbox") == 4) & (geom.width(b) <= 90) & (geom.height(b) <= 12) & (_d("fontSize") <= 6) & (F.length(strip_model_marks(_s("text"))) >= 8)


def metadata_reflow() -> Column:
    return (_s("blockType") == "metadata") & ~footnote() & (_s("role") == "paragraph")


def full_reflow() -> Column:
    """FLT-30."""
    return (_s("blockType").isin("body", "caption") | metadata_reflow()) & ~footnote()


def caption_policy() -> Column:
    """PRJ-06: null for what is no caption."""
    existing = F.trim(_s("renderPolicy"))
    w = geom.width(_box())
    shown = F.filter(F.coalesce(F.col("layoutLines"), F.array()), lambda line: normalize(F.array_join(F.transform(F.coalesce(line["items"], F.array()), lambda i: F.coalesce(i["text"], F.lit(""))), "")) != "")
    boxed = F.filter(shown, lambda line: F.size(line["bbox"]) == 4)
    widths = F.transform(boxed, lambda line: geom.width(line["bbox"]))
    offsets = F.transform(boxed, lambda line: F.greatest(line["bbox"][0] - F.col("bbox")[0], F.lit(0.0)))
    narrow = F.size(F.filter(widths, lambda x: x / F.greatest(w, F.lit(1.0)) < 0.55))
    staggered = (w > 0) & (F.size(widths) >= 3) & (narrow >= 2) & (F.array_max(widths) / F.greatest(w, F.lit(1.0)) < 0.72)
    shifted = (w > 0) & F.coalesce(F.array_max(offsets) >= F.greatest(w * 0.22, F.lit(24.0)), F.lit(False))
    styled = F.exists(text_items(), lambda i: F.coalesce(i["isBoldLike"], F.lit(False)) | F.coalesce(i["isItalicLike"], F.lit(False)) | F.coalesce(i["isMonospaceLike"], F.lit(False)))
    return (
        F.when(existing.isin("plain_reflow", "mixed_reflow", "preserve_visual"), existing)
        .when(F.coalesce(F.col("preserveOriginal"), F.lit(False)), "preserve_visual")
        .when(_s("blockType") != "caption", F.lit(None))
        .when(staggered | shifted, "preserve_visual").when(styled, "mixed_reflow").otherwise("plain_reflow")
    )


def render_policy(caption: Column | None = None) -> Column:
    """PRJ-06; ``caption``: the caption policy, where it is a column already."""
    existing, caption = F.trim(_s("renderPolicy")), caption_policy() if caption is None else caption
    return F.coalesce(F.nullif(existing, F.lit("")), F.when(tiny_label(), "preserve_visual"), caption, F.when(full_reflow(), "plain_reflow"), F.lit("structured_layout"))


def reference_block() -> Column:
    """FLT-29."""
    return F.lower(_s("blockType")).isin("reference_block", "reference", "bibliography") | (F.lower(_s("doclingLabel")) == "reference") | F.lower(_s("preserveReason")).isin("reference_block", "reference_section") | F.trim(_s("text")).rlike(r"^\[\d+\]\s+")


def compact_metadata() -> Column:
    """FLT-29."""
    t, done = normalize("text"), normalize("translatedText")
    known = t.rlike(r"(?:^|[^A-Za-z0-9_])(?:UMD|UVA|WUSTL|UNC|Google|Meta)(?:$|[^A-Za-z0-9_])") | done.rlike("大学|谷歌|Meta")
    small = (F.size("bbox") == 4) & (t != "") & (done != "") & (n_lines() <= 1) & (geom.height(_box()) <= 12.5) & (F.length(done) > F.length(t)) & known
    return _s("blockType").isin("metadata", "page_header", "page_footer") & (byline() | F.coalesce(small, F.lit(False)))


def uncertain() -> Column:
    """FLT-29."""
    noted = (_s("preserveReason") == "translation_meta_note") | meta_note("translationMetaNote")
    odd = _s("doclingLabel").isin("picture", "table") | (_s("blockType") == "table_body") | (strip_model_marks(_s("translatedText")) == "") | (F.coalesce(F.size("bbox"), F.lit(0)) != 4)
    return noted | (~F.coalesce(F.col("preserveOriginal"), F.lit(False)) & odd)


def action(policy: Column | None = None) -> Column:
    """ACT-01: preserve, review or replace; ``policy``: the render policy, where it is a column already."""
    kept = ((render_policy() if policy is None else policy) == "preserve_visual") | F.coalesce(F.col("preserveOriginal"), F.lit(False)) | F.lower(_s("blockType")).isin("formula_display", "table_header", "table_body", "code")
    kept = kept | reference_block() | (F.lower(_s("doclingLabel")) == "code") | compact_metadata()
    return F.when(kept, "preserve").when(uncertain(), "review").otherwise("replace")


def decide(blocks: DataFrame) -> DataFrame:
    """PRJ-06 and ACT-01 step by step, so that no expression is worked out twice: sets renderPolicy, adds action."""
    steps = blocks.withColumn("_caption", caption_policy())
    steps = steps.withColumn("renderPolicy", render_policy(F.col("_caption"))).drop("_caption")
    return steps.withColumn("action", action(F.col("renderPolicy")))


def preserve_reason(in_picture: Column, in_figure: Column, in_table: Column) -> Column:
    """PRJ-03: why a block stays as it is; null if it does not."""
    return (
        F.when(in_picture, "picture_region").when(in_figure, "figure_label").when(in_table, "table_region").when(private_use("text"), "garbled_text")
        .when(display_formula(), "display_formula").when(formula_heavy("text") & ~F.coalesce(F.col("isBodyLike"), F.lit(False)), "formula_heavy")
    )


def drop_cap(body_size: Column) -> Column:
    """FLT-24: one large character at the start of a paragraph."""
    t, b, size = compact("text"), _box(), _d("fontSize")
    wide = F.greatest(size * 1.6, F.when(_d("pageWidth") > 0, _d("pageWidth") * 0.12).otherwise(size * 2.2))
    return (F.length(t) == 1) & t.rlike(r"[\p{L}\p{N}]") & ~F.coalesce(F.col("preserveOriginal"), F.lit(False)) & (size >= F.greatest(body_size * 1.8, body_size + 6)) & (geom.height(b) >= F.greatest(body_size * 2.2, F.lit(18.0))) & (geom.width(b) <= wide) & (F.size(line_texts()) <= 2)


def wrap_shape() -> Column:
    """WIN-07: regular, inset_left, inset_right or complex, by the longest run of narrow lines."""
    b = _box()
    lines = F.filter(F.coalesce(F.col("layoutLines"), F.array()), lambda line: F.exists(F.coalesce(line["items"], F.array()), lambda i: (i["type"] == "text") & (normalize(i["text"]) != "")) & (geom.width(line["bbox"]) > 0))
    spans = F.transform(lines, lambda line: F.struct(F.greatest(line["bbox"][0] - b[0], F.lit(0.0)).alias("o"), geom.width(line["bbox"]).alias("w")))
    widths = F.transform(spans, lambda s: s["w"])
    top, low = F.array_max(widths), F.array_min(widths)
    limit = top - F.greatest(F.lit(28.0), top * 0.18)
    zero = lambda: F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("o"), F.lit(0.0).alias("w"), F.lit(0).alias("bn"), F.lit(0.0).alias("bo"), F.lit(0.0).alias("bw"))

    def step(a: Column, s: Column) -> Column:
        n, o, w = (F.when(s["w"] <= limit, a[k] + v).otherwise(z) for k, v, z in (("n", F.lit(1), F.lit(0)), ("o", s["o"], F.lit(0.0)), ("w", s["w"], F.lit(0.0))))
        more = n > a["bn"]
        return F.struct(n.alias("n"), o.alias("o"), w.alias("w"), F.when(more, n).otherwise(a["bn"]).alias("bn"), F.when(more, o).otherwise(a["bo"]).alias("bo"), F.when(more, w).otherwise(a["bw"]).alias("bw"))

    run = F.aggregate(spans, zero(), step)
    offset, mean, whole = run["bo"] / run["bn"], run["bw"] / run["bn"], geom.width(b)
    right = top - (offset + mean)
    regular = (whole <= 0) | (F.size(spans) < 4) | (top - low <= F.greatest(F.lit(36.0), whole * 0.14)) | (run["bn"] < 2)
    at_left, at_right = offset <= F.greatest(F.lit(14.0), whole * 0.05), right <= F.greatest(F.lit(14.0), whole * 0.05)
    return F.when(F.coalesce(regular, F.lit(True)), "regular").when(at_left & (right >= F.greatest(F.lit(28.0), whole * 0.12)), "inset_right").when(at_right & (offset >= F.greatest(F.lit(18.0), whole * 0.08)), "inset_left").otherwise("complex")


# ---------------------------------------------------------------- margins


def page_number() -> Column:
    """FLT-25."""
    return normalize("text").rlike(r"^\d{1,3}$")


def journal_footer() -> Column:
    t = normalize("text")
    squeezed = F.regexp_replace(F.upper(t), "[^A-Z0-9]+", "")
    dated = squeezed.rlike("CORRECTED|SEPTEMBER") | t.rlike(r"(?:^|[^A-Za-z0-9_])\d{1,3}(?:$|[^A-Za-z0-9_])")
    return (F.col("bbox")[1] >= F.greatest(_d("pageHeight", 1.0), F.lit(1.0)) * 0.94) & squeezed.rlike("NATURE|VOL") & dated


def margin_metadata() -> Column:
    t = normalize("text")
    return (t != "") & (F.contains(F.lower(t), F.lit("arxiv")) | (t.rlike(r"\[[A-Za-z.:-]+\]") & t.rlike(r"\d{4}")) | t.rlike(r"(?i)(?:^|[^A-Za-z0-9_])(?:cs|math|stat|econ|q-bio|hep|astro-ph)\.[A-Z-]+(?:$|[^A-Za-z0-9_-])"))


def side_marginalia() -> Column:
    b, w, h = _box(), F.greatest(_d("pageWidth", 1.0), F.lit(1.0)), F.greatest(_d("pageHeight", 1.0), F.lit(1.0))
    tall = ((b[3] - b[1]) / h >= 0.14) | F.coalesce("rotation", F.lit(0)).isin(90, 270) | (F.length(normalize("text")) >= 18)
    return ((b[2] <= w * 0.14) | (b[0] >= w * 0.86)) & ((b[2] - b[0]) / w <= 0.12) & tall


def strong_side_metadata() -> Column:
    b, w, h = _box(), F.greatest(_d("pageWidth", 1.0), F.lit(1.0)), F.greatest(_d("pageHeight", 1.0), F.lit(1.0))
    return _s("blockType").isin("metadata", "page_header", "page_footer") & side_marginalia() & ((b[2] - b[0]) / w <= 0.04) & ((b[3] - b[1]) / h >= 0.45) & (F.length(normalize("text")) >= 40)


def repeatable(text: Column) -> Column:
    """FLT-26."""
    return F.length(text).between(3, 160) & ~text.rlike(r"^[\d\s./-]+$")


def running_label(text: Column | str) -> Column:
    """FLT-26."""
    t = normalize(text)
    return t.rlike(RUNNING) & (F.length(t) <= 24) & F.size(F.filter(F.split(t, " "), lambda w: w != "")).between(1, 3)


def _zones() -> dict[str, Column]:
    h = F.greatest(_d("pageHeight", 1.0), F.lit(1.0))
    return {"top": F.col("bbox")[3] <= h * 0.11, "bottom": F.col("bbox")[1] >= h * 0.89, "side": side_marginalia()}


def ruled_margin() -> Column:
    """AGG-15: margin blocks that stay by rules of their own."""
    h, zones = F.greatest(_d("pageHeight", 1.0), F.lit(1.0)), _zones()
    return journal_footer() | strong_side_metadata() | (zones["bottom"] & page_number()) | (((F.col("bbox")[3] <= h * 0.12) | zones["side"]) & margin_metadata())


def periphery(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """AGG-15: (doc, id) of margin blocks that stay: repeated signatures on several pages, or margin rules."""
    b = blocks.withColumn("_sig", signature("text"))
    zones = F.array_compact(F.array(*(F.when(inside, zone) for zone, inside in _zones().items())))
    rows = b.where(repeatable(F.col("_sig"))).select(doc, "_sig", "page", F.explode(zones).alias("_zone"))
    often = rows.groupBy(doc, "_zone", "_sig").agg(F.countDistinct("page").alias("n")).where("n >= 2").drop("n")
    seen = b.withColumn("_zone", F.explode(zones)).join(often, [doc, "_zone", "_sig"], "left_semi").select(doc, "id")
    return seen.unionByName(b.where(ruled_margin()).select(doc, "id")).distinct()


def repeated_margin(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """AGG-15 beside the blocks: adds ``repeated``: in a margin, with a signature that stands there on several pages; a document's blocks fit a task."""
    zones = {f"_{zone}": F.coalesce(inside, F.lit(False)) for zone, inside in _zones().items()}
    some = blocks.withColumns(zones)
    sig = F.when(F.col("_top") | F.col("_bottom") | F.col("_side"), signature("text"))
    some = some.withColumn("_sig", sig).withColumn("_sig", F.when(repeatable(F.col("_sig")), F.col("_sig")))
    alike = Window.partitionBy(doc, "_sig")
    pages = lambda zone: F.when(F.col(zone), F.col("page"))
    several = [F.col(zone) & (F.min(pages(zone)).over(alike) < F.max(pages(zone)).over(alike)) for zone in zones]
    return some.withColumn("repeated", F.coalesce(F.col("_sig").isNotNull() & (several[0] | several[1] | several[2]), F.lit(False))).drop("_sig", *zones)


# ---------------------------------------------------------------- page statistics


def _text_size() -> Column:
    return F.when((F.length(normalize("text")) >= 20) & F.col("fontSize").between(6, 14), F.col("fontSize"))


def page_body_size(blocks: DataFrame, key: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """AGG-10: median font size of text blocks between 6 and 14, else 10."""
    return blocks.groupBy(*key).agg(F.coalesce(F.median(_text_size()), F.lit(10.0)).alias("bodySize"))


def with_body_size(blocks: DataFrame, key: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """AGG-10 beside the blocks: adds ``bodySize``."""
    return blocks.withColumn("bodySize", F.coalesce(F.median(_text_size()).over(Window.partitionBy(*key)), F.lit(10.0)))


def page_body_width(widths: DataFrame, key: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """AGG-11: of ``width`` rows of candidates: the median of the best bucket, or of all where it has one row."""
    buckets = widths.withColumn("_b", geom.bucket(F.col("width"), 18.0)).groupBy(*key, "_b").agg(F.count("*").alias("n"), F.avg("width").alias("mean"), F.median("width").alias("middle"))
    best = buckets.groupBy(*key).agg(F.max(F.struct("n", "mean", "middle")).alias("best"))
    whole = widths.groupBy(*key).agg(F.median("width").alias("all"))
    return best.join(whole, list(key)).select(*key, F.when(F.col("best.n") >= 2, F.col("best.middle")).otherwise(F.col("all")).alias("bodyWidth"))


def font_sizes(sizes: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """AGG-09: dominant (the most frequent, larger of equals) and representative (median) of ``size`` rows, to one digit."""
    rows = sizes.where("size > 0").withColumn("size", F.bround("size", 1))
    dominant = rows.groupBy(*key, "size").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max(F.struct("n", "size"))["size"].alias("dominant"))
    return dominant.join(rows.groupBy(*key).agg(F.median("size").alias("representative")), list(key))


def dominant_family(words: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """AGG-13: the font family with the most words of (family, words) rows; times where none has any."""
    sums = words.groupBy(*key, "family").agg(F.sum("words").alias("n"))
    return sums.groupBy(*key).agg(F.coalesce(F.max(F.when(F.col("n") > 0, F.struct("n", "family")))["family"], F.lit("times")).alias("family"))


# ---------------------------------------------------------------- order-dependent marks


def mark_references(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """WIN-02: blocks between a references heading and the next heading; a document's blocks fit a task."""
    order = Window.partitionBy(doc).orderBy("page", F.col("bbox")[1], F.col("bbox")[0]).rowsBetween(Window.unboundedPreceding, 0)
    signal = section_signal()
    inside = F.last(F.when(signal, reference_heading()), ignorenulls=True).over(order)
    marked = blocks.withColumn("_ref", F.coalesce(inside, F.lit(False)) & ~signal)
    return marked.withColumns({
        "blockType": F.when(F.col("_ref"), "reference_block").otherwise(F.col("blockType")), "role": F.when(F.col("_ref"), "preserved").otherwise(F.col("role")),
        "preserveOriginal": F.col("_ref") | F.coalesce(F.col("preserveOriginal"), F.lit(False)), "preserveReason": F.when(F.col("_ref"), "reference_section").otherwise(F.col("preserveReason")),
    }).drop("_ref")


def vertical_groups(blocks: DataFrame, key: tuple[str, ...] = ("doc", "page"), most: float = 24.0) -> DataFrame:
    """WIN-06: adds ``group``: a new one where the distance to the block before is larger than ``most``; of blocks with one place and id the lower end comes last."""
    order = Window.partitionBy(*key).orderBy(F.col("bbox")[1], F.col("bbox")[0], "id", F.col("bbox")[3], F.col("bbox")[2])
    gap = F.col("bbox")[1] - F.lag(F.col("bbox")[3]).over(order)
    return blocks.withColumn("group", F.sum(F.when(gap > most, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def table_candidates(blocks: DataFrame, key: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """WIN-06: boxes of groups of short blocks that fill several rows and columns."""
    short = blocks.where(short_or_tableish())
    many = short.groupBy(*key).count().where("count >= 5").select(*key)
    groups = vertical_groups(short.join(many, list(key), "left_semi"), key).groupBy(*key, "group")
    b = F.col("bbox")
    found = groups.agg(
        F.count("*").alias("n"), geom.union(b).alias("box"), F.max("pageWidth").alias("w"),
        F.countDistinct(geom.bucket((b[1] + b[3]) / 2, 10.0)).alias("rows"), F.countDistinct(geom.bucket(b[0], 18.0)).alias("columns"),
    )
    share = (F.col("box")[2] - F.col("box")[0]) / F.greatest(F.col("w"), F.lit(1.0))
    return found.where((F.col("n") >= 5) & share.between(0.28, 0.9) & (F.col("rows") >= 3) & (F.col("columns") >= 3)).select(*key, "group", geom.expand(F.col("box"), 4.0).alias("bbox"))


def merge_spans(spans: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """WIN-12: neighbouring items of one type and style as one: text joined, boxes united."""
    w = Window.partitionBy(*key).orderBy(order)
    style = F.struct("type", "flags", "font", F.bround("size", 2).alias("size"), F.transform("color", lambda c: F.bround(c, 6)).alias("color"))
    rows = spans.where(F.length("text") > 0).withColumn("_style", style)
    fresh = F.when(F.col("_style").eqNullSafe(F.lag("_style").over(w)), 0).otherwise(1)
    rows = rows.withColumn("run", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "")
    return rows.groupBy(*key, "run").agg(text.alias("text"), geom.union(F.col("bbox")).alias("bbox"), F.min(F.struct(order, "_style"))["_style"].alias("style"), F.count("*").alias("items"))


def spans(blocks: DataFrame) -> DataFrame:
    """EXP-09: one row per item with its line and place; flags decoded."""
    rows = blocks.select("doc", "page", "id", F.posexplode("layoutLines").alias("line", "_l")).select("doc", "page", "id", "line", F.posexplode("_l.items").alias("item", "_i"))
    return rows.select("doc", "page", "id", "line", "item", "_i.*", *(geom.flag(F.col("_i.flags"), n).alias(f"flag_{n}") for n in geom.FLAGS))


def erase_rects(blocks: DataFrame) -> DataFrame:
    """ERZ-01: (doc, page, id, rect, fallback) of blocks that are replaced: items, else lines (0.9 more), else the block (1.2 more)."""
    w, h = F.greatest(_d("pageWidth"), F.lit(1.0)), F.greatest(_d("pageHeight"), F.lit(1.0))
    real = lambda b: F.coalesce((F.size(b) == 4) & (b[2] > b[0]) & (b[3] > b[1]), F.lit(False))
    boxes = F.flatten(F.transform(F.coalesce(F.col("layoutLines"), F.array()), lambda line: F.when(
        F.size(F.filter(F.coalesce(line["items"], F.array()), lambda i: (i["type"] == "text") & real(i["bbox"]))) > 0,
        F.transform(F.filter(F.coalesce(line["items"], F.array()), lambda i: (i["type"] == "text") & real(i["bbox"])), lambda i: i["bbox"]),
    ).otherwise(F.filter(F.array(line["bbox"]), real))))
    rows = decide(blocks).where("action = 'replace'").withColumn("_boxes", boxes)
    wide = F.when(F.size("_boxes") > 0, F.transform("_boxes", lambda b: geom.expand(b, 0.9, w, h))).when(real(F.col("bbox")), F.array(geom.expand(F.col("bbox"), 1.2, w, h))).otherwise(F.array())
    return rows.withColumn("_fallback", F.size("_boxes") == 0).withColumn("rect", F.explode(wide)).select("doc", "page", "id", "rect", F.col("_fallback").alias("fallback"))


# ---------------------------------------------------------------- spatial joins


def label_blocks(blocks: DataFrame, items: DataFrame, key: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """JOIN-06: the best layout item (label, bbox, text, ord) of each block: most overlap and shared words; at most a page's items meet a page's blocks."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(normalize(t)), " "), lambda w: w != ""))
    left = blocks.select(*key, "id", F.col("bbox").alias("b"), words("text").alias("bw"))
    right = items.select(*key, "label", "ord", F.col("bbox").alias("i"), words("text").alias("iw"))
    share = geom.overlap_ratio(F.col("b"), F.col("i"))
    shared = F.size(F.array_intersect("bw", "iw")) / F.greatest(F.least(F.size("bw"), F.size("iw")), F.lit(1))
    scored = left.join(right, list(key)).withColumn("_o", share).where("_o > 0.15").withColumn("_score", F.col("_o") * 0.8 + shared * 0.2)
    return scored.groupBy(*key, "id").agg(F.max_by(F.struct("label", F.col("_score").alias("score")), F.struct("_score", -F.col("ord"))).alias("x")).select(*key, "id", "x.label", "x.score")


def adjacent_headers(bodies: DataFrame, tables: DataFrame, key: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """JOIN-07: blocks right above a table body that share at least 55 % of the smaller width."""
    t = tables.select(*key, F.col("bbox").alias("_t"))
    gap = geom.gap_y(F.col("bbox"), F.col("_t"))
    near = (geom.overlap_x_ratio(F.col("bbox"), F.col("_t")) >= 0.55) & gap.between(-2.0, F.greatest(_d("fontSize") * 2.5, F.lit(18.0)))
    return bodies.join(t, list(key)).where(near).drop("_t").dropDuplicates([*key, "id"])


def inside_regions(blocks: DataFrame, regions: DataFrame, share: float = 0.6, key: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """JOIN-10: blocks of which at least ``share`` lies in one region."""
    r = regions.select(*key, F.col("bbox").alias("_r"))
    ids = blocks.join(r, list(key)).where(geom.overlap_ratio(F.col("bbox"), F.col("_r")) >= share).select(*key, "id").distinct()
    return blocks.join(ids, [*key, "id"], "left_semi")


def anchors(blocks: DataFrame, objects: DataFrame, share: float = 0.35, key: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """JOIN-09: (key, id, anchors): names of embedded objects that cover enough of a block."""
    o = objects.select(*key, "name", F.col("bbox").alias("_o"))
    hits = blocks.join(o, list(key)).where(geom.overlap_ratio(F.col("bbox"), F.col("_o")) >= share)
    return hits.groupBy(*key, "id").agg(F.sort_array(F.collect_set("name")).alias("anchors"))

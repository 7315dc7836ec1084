"""Text functions and row rules as column expressions.

All are plain Catalyst expressions: they stay in generated code and push through projections.
Lengths count code points. White space is Unicode's, spelled out, since ``\\s`` is ASCII here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns of the rules.
WS = r"[\s\x{0B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
NUMERIC = r"^\d+(?:[.,:/-]\d+)*$"
NOISE = r"""^[0-9oO#.:,_\-/\\|()\[\]{}*+=~`"' ]+$"""
WORD = r"[A-Za-z]{3,}"
SYMBOL = r"[^A-Za-z0-9\s]"
CAPTION = r"(?i)^(fig(?:ure)?\.?|table)\s*[A-Za-z0-9.\-:]*$"
BROKEN_OCR = r"^([A-Za-z]\s+[A-Za-z][\-.,:]?|[.\-_:]{3,}[A-Za-z]?|[A-Za-z]?[.\-_:]{3,})$"
FORMULA_HINT = r"[=≈≤≥∑∫√^×÷]|(?:^|[^A-Za-z0-9_])(?:sin|cos|tan|log|ln)(?:$|[^A-Za-z0-9_])|[A-Za-z0-9]\s*[*]\s*[A-Za-z0-9]"
BRA_KET = r"\|[^|]+⟩|⟨[^⟩]+\|"
META_NOTES = (r"(?iu)^[（(]?\s*(注|NOTE)\s*[:：]", r"(?i)(?:^|[^A-Za-z0-9_])node[_\s-]?\d+(?:$|[^A-Za-z0-9_])", r"(?i)(?:^|[^A-Za-z0-9_])sid(?:$|[^A-Za-z0-9_])", r"按规则|严格保留|不合并|不调整|原文此处编号有误")
SHORTHAND = r"^(?:同上|同前|如上|上同|见上|见前)[。．.!！?？]*$|(?i)^(?:ibid\.?|same as above|see above|same as prior)[.?!]*$"
SENTENCE_MARKS = r"[，。；：.!?]"
FORMULA_SYMBOLS = r"[=≈≤≥∑∫√^×÷∈∉∞∂∆∇∝⊂⊆⊕⊗→←↔±≠]"
FORMULA_TOKENS = r"(?:^|[^A-Za-z0-9_])[A-Za-z][A-Za-z0-9_]*\s*\(|(?:^|[^A-Za-z0-9_])(?:sin|cos|tan|log|ln|max|min|softmax)(?:$|[^A-Za-z0-9_])|[_^{}]|[₀-₉₋⁰-⁹⁻]"
SCRIPT_MARKS = r"[_^₀-₉⁰-⁹]"
GREEK = "[α-ωΑ-Ω]"
MATH_FONT = r"(?i)^(?:CM|MSAM|MSBM|StandardSymL|Symbol|MTExtra)"
PRIVATE_USE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count(text: Column, pattern: str) -> Column:
    """STR-25: number of matches."""
    return F.regexp_count(text, F.lit(pattern))


def normalize(text: Column | str) -> Column:
    """STR-01: runs of white space to one space, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), WS, " "))


def compact(text: Column | str) -> Column:
    """STR-02: all white space removed."""
    return F.regexp_replace(F.coalesce(_c(text), F.lit("")), WS, "")


def preview(text: Column | str, size: int = 80) -> Column:
    """TOP-07: normalised, cut to ``size`` with dots."""
    n = normalize(text)
    return F.when(F.length(n) > size, F.concat(F.substring(n, 1, size), F.lit("..."))).otherwise(n)


def escape_html(text: Column | str) -> Column:
    """STR-05: & < > and double quotes as entities."""
    out = _c(text)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def decode_html(text: Column | str) -> Column:
    """STR-05: the reverse, ampersands last."""
    out = _c(text)
    for entity, raw in (("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(raw))
    return out


def strip_tags(html: Column | str) -> Column:
    """STR-24: text of a fragment."""
    return F.regexp_replace(_c(html), "<[^>]*>", "")


#: Words of markup that cleaners of books in other scripts drop, and what they keep.
MARKUP_WORDS = "class|href|src|alt|div|span|img|css|html|body|head|link|stylesheet|type|text|rel|image|title|subtitle|empty|line|cite|poem|stanza|author|jpg|png"
SCRIPTS = {"russian": r"\p{IsCyrillic}", "chinese": r"\p{IsHan}A-Za-z0-9", "japanese": r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}A-Za-z0-9", "korean": r"\p{IsHangul}A-Za-z0-9"}


def clean_markup(html: Column | str, language: str = "") -> Column:
    """STR-03: text of a page without scripts and styles; of a language with a script of its own only that script, without words of markup."""
    dropped = "script|style|head" if language in SCRIPTS else "script|style"
    bare = F.regexp_replace(F.coalesce(_c(html), F.lit("")), rf"(?is)<({dropped})\b[^>]*>.*?</\1\s*>|<!--.*?-->", "")
    text = decode_html(strip_tags(bare))
    if language in SCRIPTS:
        text = F.lower(text) if language == "russian" else text
        text = F.regexp_replace(text, rf"(?i)\b(?:{MARKUP_WORDS})\b", " ")
        text = F.regexp_replace(text, rf"[^{SCRIPTS[language]}\s\-]", " ")
    return normalize(text)


def sanitize_cue(text: Column | str, fallback: Column | str = "") -> Column:
    """STR-06: line breaks unified, no empty or padded lines, trimmed; ``fallback`` where nothing is left."""
    out = F.regexp_replace(F.coalesce(_c(text), F.lit("")), "\r\n?", "\n")
    out = F.regexp_replace(F.replace(out, F.lit("\x00"), F.lit("")), r"\n{2,}", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"^\s+|\s+$", "")
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.coalesce(F.nullif(out, F.lit("")), other)


def strip_fences(text: Column | str) -> Column:
    """STR-07: code fences of a model's answer removed."""
    return F.regexp_replace(F.regexp_replace(_c(text), "```[A-Za-z]*\n?", ""), r"^\s+|\s+$", "")


def merge_split_letters(html: Column | str) -> Column:
    """STR-08: a letter followed by an inline element that holds only text takes that text in."""
    return F.regexp_replace(_c(html), r"([A-Za-z])<(?:small|span|strong|em|b|i)(?:\s[^>]*)?>([^<]*)</(?:small|span|strong|em|b|i)>", "$1$2")


def strip_model_marks(text: Column | str) -> Column:
    """STR-09: padding and end marks removed, plain or escaped."""
    return F.trim(F.regexp_replace(_c(text), "(?i)<(?:pad|eos)>|&lt;(?:pad|eos)&gt;", ""))


def signature(text: Column | str) -> Column:
    """STR-10: lower case, runs of digits as #, white space normalised."""
    return F.regexp_replace(F.lower(normalize(text)), r"\d+", "#")


def upper_signature(text: Column | str) -> Column:
    """STR-10: upper-case ASCII letters and digits only."""
    return F.regexp_replace(F.upper(F.coalesce(_c(text), F.lit(""))), "[^A-Z0-9]", "")


def strip_latex(text: Column | str) -> Column:
    """STR-11: math delimiters around a whole text removed."""
    out = F.trim(_c(text))
    for opening, closing in ((r"\$\$", r"\$\$"), (r"\$", r"\$"), (r"\\\(", r"\\\)"), (r"\\\[", r"\\\]")):
        out = F.regexp_replace(out, f"^{opening}([^$]*){closing}$", "$1")
    return F.trim(out)


def occurrences(text: Column, needle: Column) -> Column:
    """STR-18: non-overlapping occurrences of a literal; none of an empty one."""
    return F.when(F.length(needle) > 0, ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("long")).otherwise(F.lit(0))


def text_units(text: Column | str) -> Column:
    """STR-15: estimated width: spaces .35, CJK 1, capitals and digits .68, small letters .56, others .6."""
    t = F.coalesce(_c(text), F.lit(""))
    cjk = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
    spaces, wide, large, small = (count(t, p) for p in (r"[ \t\n\r\f\x{0B}]", cjk, "[A-Z0-9]", "[a-z]"))
    rest = F.length(t) - spaces - wide - large - small
    return F.round(spaces * 0.35 + wide * 1.0 + large * 0.68 + small * 0.56 + rest * 0.6, 2)


def context(text: Column, term: Column, window: int = 40) -> Column:
    """STR-04: the first hit of a term, whatever its case, with ``window`` characters on both sides; empty if none."""
    at = F.instr(F.lower(text), F.lower(term))
    start = F.greatest(at - 1 - window, F.lit(0))
    cut = F.substr(text, start + 1, F.least(at - 1 + F.length(term) + window, F.length(text)) - start)
    return F.when(at > 0, F.concat(F.lit("..."), normalize(cut), F.lit("..."))).otherwise("")


def slug(text: Column | str, size: int = 60) -> Column:
    """SNK-13: part of a file name; ``selected`` where nothing is left."""
    out = F.regexp_replace(_c(text), "[\"']", "")
    out = F.regexp_replace(out, r"[<>:/\\|?*\s]+", "_")
    out = F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^_|_$", "")
    return F.coalesce(F.nullif(F.substring(out, 1, size), F.lit("")), F.lit("selected"))


def file_token(text: Column | str) -> Column:
    """SNK-09: characters that file names cannot hold as underscores."""
    return F.regexp_replace(_c(text), r'[/\\:*?"<>|]', "_")


# ---------------------------------------------------------------- rules


def mostly_symbols(text: Column | str) -> Column:
    """FLT-04: nothing to read: empty, a number, no letter or digit, or at least 60 % other signs."""
    c = compact(text)
    other = count(c, r"[^\p{L}\p{N}]")
    return (c == "") | c.rlike(NUMERIC) | (other == F.length(c)) | (other / F.greatest(F.length(c), F.lit(1)) >= 0.6)


def classify_text(text: Column | str, unicode: bool = False) -> Column:
    """FLT-01: struct(type, action, reason) by ordered rules.

    Letters are ASCII as the rules have it, so texts in other scripts count as symbols; with
    ``unicode`` letters of all scripts count.
    """
    letter, word, symbol = ("\\p{L}", r"\p{L}{3,}", r"[^\p{L}\p{N}\s]") if unicode else ("[A-Za-z]", WORD, SYMBOL)
    n, c = normalize(text), compact(text)
    alpha, digits, symbols, words = count(n, letter), count(n, r"\d"), count(n, symbol), count(n, word)
    size = F.length(c)
    result = lambda kind, action, reason: F.struct(F.lit(kind).alias("type"), F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    rules = [
        (n == "", result("TEXT_NOISE", "DROP", "empty")),
        (F.contains(n, F.lit("�")), result("TEXT_NOISE", "DROP", "replacement_char")),
        (n.rlike(CAPTION), result("CAPTION", "KEEP", "caption_label")),
        ((size <= 3) & (alpha <= 2) & (digits <= 2) & (words == 0), result("TEXT_NOISE", "DROP", "short_noise")),
        (n.rlike(NUMERIC), result("TEXT_NUMERIC", "KEEP", "numeric_only")),
        (n.rlike(BROKEN_OCR), result("TEXT_NOISE", "DROP", "broken_ocr_fragment")),
        (n.rlike(FORMULA_HINT) & (alpha + digits > 0) & (symbols >= 2) & (words <= 2), result("FORMULA", "SKIP", "formula_like_text")),
        (n.rlike(BRA_KET) & F.contains(n, F.lit("=")), result("FORMULA", "SKIP", "quantum_notation")),
        ((words == 0) & (size >= 4) & (n.rlike(NOISE) | (symbols / F.greatest(size, F.lit(1)) >= 0.45)), result("TEXT_NOISE", "DROP", "mostly_symbols")),
        ((words == 0) & (size <= 6) & (alpha <= 2) & (symbols + digits >= F.greatest(size - 1, F.lit(1))), result("TEXT_NOISE", "DROP", "isolated_fragment")),
    ]
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out.otherwise(result("TEXT_NORMAL", "KEEP", "default_keep"))


NON_TEXT = r"(?i)<(?:img|svg|picture|source|canvas|video|audio|iframe|embed|object|math)(?:[^A-Za-z0-9_]|$)"
TABLE_MATH = r"(?i)<(?:math|svg|img|mjx-container)(?:[^A-Za-z0-9_]|$)"


def classify_node(tag: Column, text: Column, html: Column, css_class: Column, pseudo_table: Column) -> Column:
    """FLT-02: by tag, class and content, else by text."""
    by_text = classify_text(text)
    result = lambda kind, action, reason: F.struct(F.lit(kind).alias("type"), F.lit(action).alias("action"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    caption = F.lower(tag).isin("caption", "figcaption")
    return (
        F.when((F.lower(tag) == "table") & pseudo_table, result("TABLE_PSEUDO", "PLACEHOLDER", "image_like_table"))
        .when(F.lower(tag) == "table", result("TABLE_REAL", "KEEP", "table_keep"))
        .when(caption & (by_text["type"] == "TEXT_NOISE"), result("CAPTION", "DROP", by_text["reason"]))
        .when(caption, result("CAPTION", "KEEP", "caption_keep"))
        .when(F.coalesce(css_class, F.lit("")).rlike("(?i)equation"), result("FORMULA", "SKIP", "equation_class"))
        .when(F.coalesce(html, F.lit("")).rlike(NON_TEXT), result("NON_TEXT_CONTENT", "KEEP", "embedded_non_text_content"))
        .otherwise(by_text)
    )


def bypass(classification: Column, mode: str = "epub") -> Column:
    """FLT-02: rows that are not worked on; subtitles pass over only empty, skipped and placeholder rows."""
    if mode == "subtitle":
        return (classification["reason"] == "empty") | classification["action"].isin("SKIP", "PLACEHOLDER")
    return classification["action"].isin("DROP", "SKIP", "PLACEHOLDER")


def pseudo_table(cells: Column, html: Column) -> Column:
    """FLT-03: a grid of tiny fragments that stands for a picture; ``cells`` is the array of cell texts."""
    full = F.filter(F.transform(cells, normalize), lambda c: c != "")
    kinds = F.transform(full, lambda c: classify_text(c)["type"])
    n = F.greatest(F.size(full), F.lit(1))
    share = lambda test: F.size(F.filter(full, test)) / n
    kind = lambda name: F.size(F.filter(kinds, lambda k: k == name)) / n
    tiny, short = share(lambda c: F.length(c) <= 2), share(lambda c: F.length(c) <= 8)
    marks, words = share(lambda c: c.rlike(r"^[0oO#.:_\- ]{1,2}$")), share(lambda c: c.rlike(WORD))
    letters = F.size(F.array_distinct(F.split(F.array_join(full, ""), "")))
    shape = (short >= 0.9) & (words <= 0.05) & (((tiny >= 0.85) & (marks >= 0.7)) | (kind("TEXT_NOISE") >= 0.75)) & (letters <= 32)
    return F.coalesce((F.size(cells) >= 12) & ~F.coalesce(html, F.lit("")).rlike(TABLE_MATH) & (F.size(full) > 0) & (kind("FORMULA") < 0.25) & shape, F.lit(False))


def placeholder(kind: Column, tag: Column) -> Column:
    """STR-23: markup that stands for what is left out; null for other kinds."""
    label = F.when(kind == "TABLE_PSEUDO", "[Table omitted: non-text OCR grid]").when(kind == "FORMULA", "[Formula omitted]")
    return F.concat(F.lit("<"), tag, F.lit(' data-placeholder="'), F.lower(kind), F.lit('">'), label, F.lit("</"), tag, F.lit(">"))


def meta_note(text: Column | str) -> Column:
    """FLT-13: a remark of the translator instead of a translation."""
    n = normalize(text)
    hits = sum((n.rlike(p).cast("int") for p in META_NOTES), F.lit(0))
    return (hits >= 2) | ((hits >= 1) & (F.length(n) <= 120) & n.rlike(r"^[（(\[]"))


def shorthand(text: Column | str) -> Column:
    """FLT-14: an answer that only points elsewhere."""
    return normalize(text).rlike(SHORTHAND)


def private_use(text: Column | str) -> Column:
    """FLT-17: characters of a private font."""
    return F.coalesce(_c(text), F.lit("")).rlike(PRIVATE_USE)


def formula_heavy(text: Column | str) -> Column:
    """FLT-17: text that is mainly formulas."""
    n = normalize(text)
    symbols, scripts, tokens = count(n, FORMULA_SYMBOLS), count(n, SCRIPT_MARKS), count(n, FORMULA_TOKENS)
    letters, latin = count(n, "[A-Za-z0-9]"), count(n, "[A-Za-z]")
    return n.rlike(PRIVATE_USE) | ((symbols >= 2) & (tokens >= 2)) | ((tokens >= 4) & (letters >= 8)) | ((scripts >= 3) & (latin >= 4))


def formula_like(text: Column | str) -> Column:
    """FLT-17: text with signs of a formula."""
    n = normalize(text)
    symbols, tokens, words = count(n, FORMULA_SYMBOLS), count(n, FORMULA_TOKENS), count(n, WORD)
    return ((symbols > 0) & (tokens >= 1)) | ((tokens >= 2) & (count(n, "[A-Za-z0-9]") >= 4) & (words <= 6)) | ((count(n, "[()]") >= 2) & (symbols >= 1))


def formula_span(text: Column | str, font: Column) -> Column:
    """FLT-16: a run that is set as a formula."""
    n = normalize(text)
    short = n.rlike(FORMULA_TOKENS) & (count(n, "[A-Za-z0-9]") <= 12)
    return (n != "") & (F.coalesce(font, F.lit("")).rlike(MATH_FONT) | n.rlike(FORMULA_SYMBOLS) | short | n.rlike(GREEK))


def orphan_punctuation(source: Column, translated: Column) -> Column:
    """FLT-15: only punctuation for a source of at least 8 characters with letters."""
    n, s = normalize(translated), normalize(source)
    return (n != "") & ~n.rlike(r"[\p{L}\p{N}]") & (F.length(s) >= 8) & s.rlike(r"\p{L}")


# ---------------------------------------------------------------- languages

HAN, KANA, HANGUL, CYRILLIC = r"[\x{4e00}-\x{9fff}]", r"[\x{3040}-\x{30ff}]", r"[\x{ac00}-\x{d7af}]", r"[\x{0400}-\x{04ff}]"
SPANISH, FRENCH = "(?iu)[ñáéíóúü¿¡]", "(?iu)[àâæçéèêëîïôœùûüÿ]"


def infer_language(text: Column | str) -> Column:
    """CFG-02: by script, then by diacritics (more than the other and at least two), else English; null without letters."""
    t = F.coalesce(_c(text), F.lit(""))
    spanish, french = count(t, SPANISH), count(t, FRENCH)
    return (
        F.when(t.rlike(KANA), "Japanese").when(t.rlike(HANGUL), "Korean").when(t.rlike(CYRILLIC), "Russian").when(t.rlike(HAN), "Chinese (Simplified)")
        .when((spanish > french) & (spanish >= 2), "Spanish").when((french > spanish) & (french >= 2), "French").when(t.rlike("[A-Za-z]"), "English")
    )


def infer_subtitle_language(srt: Column | str) -> Column:
    """CFG-02 for subtitle files: time lines and bare numbers do not count."""
    t = F.regexp_replace(_c(srt), r"(?m)^\d{2}:\d{2}:\d{2},\d{3}\s+-->.*$", "")
    return infer_language(F.regexp_replace(t, r"(?m)^\d+\s*$", ""))

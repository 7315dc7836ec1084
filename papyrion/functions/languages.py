"""Language names, aliases and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Aliases of each language and its subtitle code.
ALIASES = {
    "English": ("en", "eng", "english"),
    "Spanish": ("es", "spa", "spanish", "espanol", "español"),
    "French": ("fr", "fra", "fre", "french", "francais", "français"),
    "Russian": ("ru", "rus", "russian"),
    "Chinese (Simplified)": ("zh", "zho", "chi", "zh-cn", "zh-hans", "chinese", "chinese-simplified", "simplified-chinese"),
    "Korean": ("ko", "kor", "korean"),
    "Japanese": ("ja", "jpn", "jp", "japanese"),
}
SUBTITLE_CODES = {"English": "eng", "Spanish": "spa", "French": "fra", "Russian": "rus", "Chinese (Simplified)": "zho", "Korean": "kor", "Japanese": "jpn"}


def alias_table(spark: SparkSession) -> DataFrame:
    """(alias, language, code): a few dozen rows of fixed size."""
    rows = [(alias, name, SUBTITLE_CODES[name]) for name, aliases in ALIASES.items() for alias in aliases]
    return spark.createDataFrame(rows, "alias string, language string, code string")


def alias_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), r"[_\s]+", "-")


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), key)


def language_name(value: Column) -> Column:
    """CFG-01: canonical name of an alias; null where it is none. Full names match in any case."""
    pairs = {alias: name for name, aliases in ALIASES.items() for alias in aliases}
    pairs |= {name.lower().replace(" ", "-"): name for name in ALIASES}
    return _lookup(pairs, alias_key(value))


def subtitle_code(name: Column) -> Column:
    return F.coalesce(_lookup(SUBTITLE_CODES, name), F.lit("und"))


def matches(value: Column, expected: Column) -> Column:
    """Both name the same known language."""
    return F.coalesce(language_name(value) == language_name(expected), F.lit(False))


def file_language(name: Column) -> Column:
    """CFG-03: the last part of a file name that names a language."""
    parts = F.transform(F.split(F.lower(name), r"[._\-\s]+"), language_name)
    return F.get(F.reverse(F.filter(parts, lambda p: p.isNotNull())), F.lit(0))


def stream_language(tags: Column) -> Column:
    """CFG-03: the first of the tags language, LANGUAGE and title that names one."""
    return F.coalesce(*(language_name(F.element_at(tags, F.lit(k))) for k in ("language", "LANGUAGE", "title")))

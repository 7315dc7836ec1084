"""How translated text is set into its box: widths, lines, sizes and the way a block is written, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrion.functions import geom
from papyrion.functions.text import meta_note, normalize, orphan_punctuation, strip_model_marks, text_units

#: Width of a unit as a share of the size, what a box loses at its sides, and least sizes of bold, uneven and other text.
UNIT, SIDES, LEAST = 0.62, 4.0, (5.5, 4.8, 4.5)
#: Height of a line as a share of the size; steps in which a size falls.
LEADING, STEP = 1.2, 0.5


def width(text: Column, size: Column) -> Column:
    """GEO-09: width of a text without font metrics."""
    return text_units(text) * UNIT * size


def wrapped(text: Column, box_width: Column, size: Column) -> Column:
    """STR-16: lines of a text in a box, broken before the word that would be too wide; a single wider word has its own line."""
    most = F.greatest((box_width - SIDES) / F.greatest(size * UNIT, F.lit(0.1)), F.lit(2.0))
    tokens = F.regexp_extract_all(normalize(text), F.lit(r"\S+\s*|\s+"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("now"), F.lit(0.0).alias("units"))

    def step(state: Column, token: Column) -> Column:
        units = text_units(token).cast("double")
        full = (state["now"] != "") & (state["units"] + units > most)
        fresh = F.ltrim(token)
        return F.struct(
            F.when(full, F.concat(state["lines"], F.array(F.rtrim(state["now"])))).otherwise(state["lines"]).alias("lines"),
            F.when(full, fresh).otherwise(F.concat(state["now"], token)).alias("now"),
            F.when(full, text_units(fresh).cast("double")).otherwise(state["units"] + units).alias("units"),
        )

    end = lambda state: F.when(F.trim(state["now"]) != "", F.concat(state["lines"], F.array(F.rtrim(state["now"])))).otherwise(state["lines"])
    return F.aggregate(tokens, start, step, end)


def least_size(bold: Column, uneven: Column) -> Column:
    """RND-01: the size below which no text of a block is set."""
    return F.when(bold, LEAST[0]).when(uneven, LEAST[1]).otherwise(LEAST[2])


def fitted(text: Column, box: Column, size: Column, least: Column) -> Column:
    """RND-02: the largest size, falling from ``size`` in steps, at which the wrapped text fits the box's height; null if none does."""
    steps = F.greatest(F.floor((size - least) / STEP), F.lit(0)).cast("int")
    sizes = F.transform(F.sequence(F.lit(0), steps), lambda k: size - k * STEP)
    fits = F.filter(sizes, lambda s: F.size(wrapped(text, geom.width(box), s)) * s * LEADING <= geom.height(box))
    return F.get(fits, F.lit(0))


def way(block_type: Column, policy: Column, uniform: Column, source: Column, translated: Column) -> Column:
    """RND-01: how a block is written: rejected, skipped, kept as it is, by its styles, in one style, or as plain text."""
    text = strip_model_marks(F.coalesce(translated, F.lit("")))
    rejected = meta_note(text) | orphan_punctuation(source, text)
    styled = ~uniform & block_type.isin("heading", "metadata", "drop_cap")
    one = uniform & block_type.isin("heading", "metadata", "body", "drop_cap")
    caption = F.when(policy == "mixed_reflow", "styles").otherwise("plain")
    return (
        F.when(rejected, "rejected").when(normalize(text) == "", "skipped").when(policy == "preserve_visual", "kept").when(block_type == "caption", caption)
        .when(block_type == "drop_cap", "drop_cap").when(styled, "styles").when(one, "uniform").otherwise("plain")
    )

"""Names of fonts, and colours."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What is taken out of a font's name for its family, in this order.
STYLES = ("-bold", "-italic", "-bolditalic", "-regular", "-medium", "-light", "-heavy", "-black", "-roman", "-narrow", "-condensed", "-extended", "-oblique", "bold", "italic", "oblique", "regular", "roman", "mt", "ps", "bolditalicmt", "boldmt", "italicmt")


def base_family(name: Column) -> Column:
    """The name in lower case without style words, subset tag and marks around it."""
    out = F.lower(name)
    for style in STYLES:
        out = F.replace(out, F.lit(style), F.lit(""))
    out = F.when(F.contains(out, F.lit("+")), F.regexp_replace(out, r"^[^+]*\+", "")).otherwise(out)
    return F.regexp_replace(out, r"^[-_ ]+|[-_ ]+$", "")


def embedding_family(name: Column) -> Column:
    """The name without leading slashes, subset tag, what comes after a hyphen, and a final mt, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(name, "^/+", ""), r"^[A-Z]{6}\+", "")
    return F.regexp_replace(F.split(F.lower(bare), "-").getItem(0), "mt$", "")


def rgb(colour: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of a packed colour."""
    return tuple(F.shiftright(colour.cast("long"), shift).bitwiseAND(F.lit(255)) for shift in (16, 8, 0))


def colour_distance(a: Column, b: Column) -> Column:
    """Sum of the differences of the channels of two packed colours."""
    return sum((F.abs(x - y) for x, y in zip(rgb(a), rgb(b))), F.lit(0))

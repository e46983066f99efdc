"""Prompt text, identifiers, colours and tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = " \t\n\r\f\v"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def norm_prompt(x: Column) -> Column:
    """A prompt without outer white space; '' for null."""
    return F.coalesce(strip(x), F.lit(""))


def norm_prompt_list(parts: Column, joiner: str = "\n") -> Column:
    """Stripped parts without the blank ones, joined; '' for null."""
    kept = F.filter(F.transform(parts, strip), lambda s: s.isNotNull() & (s != ""))
    return F.coalesce(strip(F.array_join(kept, joiner)), F.lit(""))


def norm_prompt_pair(content: Column, style: Column, joiner: str = "\n") -> Column:
    return F.struct(norm_prompt_list(content, joiner).alias("content"), norm_prompt_list(style, joiner).alias("style"))


def first_text(*options: Column) -> Column:
    """The first that is neither null nor empty; '' if none is."""
    return F.coalesce(*(F.nullif(o, F.lit("")) for o in options), F.lit(""))


def input_index(input_id: Column, prefix: str) -> Column:
    """N of ``prefix:N``; null for other ids."""
    return F.regexp_extract(input_id, f"^{prefix}:([0-9]+)$", 1).try_cast("int")


def identifier_valid(x: Column) -> Column:
    """Non-empty dotted parts without white space or slashes."""
    return F.coalesce(x.rlike(r"^[^\s/\\.]+(\.[^\s/\\.]+)*$"), F.lit(False))


def render_tokens(text: Column, images: Column) -> Column:
    """``{{img:key[i]}}`` becomes the mark of its place (from 1) in ``images``, an array of ``key[i]``.

    Folds over the images, so that every token of the text is replaced in one projection; tokens
    without an image stay.
    """
    places = F.transform(images, lambda k, i: F.struct(k.alias("k"), (i + 1).cast("string").alias("i")))
    return F.aggregate(
        places, text,
        lambda s, p: F.replace(s, F.concat(F.lit("{{img:"), p["k"], F.lit("}}")), F.concat(F.lit("<img><|image_"), p["i"], F.lit("|></img>"))),
    )


#: Named colours.
COLOURS = {
    "black": "#000000", "white": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "yellow": "#ffff00",
    "cyan": "#00ffff", "magenta": "#ff00ff", "gray": "#808080", "grey": "#808080", "orange": "#ffa500", "purple": "#800080",
    "brown": "#a52a2a", "pink": "#ffc0cb",
}


def parse_colour(x: Column) -> Column:
    """(r, g, b) of a name, ``#rgb``, ``#rrggbb`` or ``r,g,b``; null if not valid."""
    text = F.lower(F.trim(x))
    names = F.create_map(*(F.lit(v) for pair in COLOURS.items() for v in pair))
    text = F.coalesce(F.try_element_at(names, text), text)
    text = F.when(text.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(text, "([0-9a-f])", "$1$1")).otherwise(text)
    digits = [F.conv(F.substring(text, 2 + 2 * i, 2), 16, 10).cast("int") for i in range(3)]
    triple = F.transform(F.split(text, ","), lambda s: F.trim(s).try_cast("int"))
    hex_form, list_form = text.rlike("^#[0-9a-f]{6}$"), text.rlike(r"^\s*\d{1,3}\s*,\s*\d{1,3}\s*,\s*\d{1,3}\s*$")
    made = [F.when(hex_form, d).when(list_form, F.get(triple, F.lit(i))) for i, d in enumerate(digits)]
    good = (hex_form | list_form) & (F.greatest(*made) <= 255)
    return F.when(good, F.struct(*(v.alias(n) for v, n in zip(made, "rgb"))))


def merge_name(names: Column, kind: str = "merge") -> Column:
    """A stable name for a merge: its kind and ten characters of a digest of the sources' names."""
    return F.concat(F.lit(kind + "_"), F.substring(F.sha1(F.array_join(names, "\0")), 1, 10))

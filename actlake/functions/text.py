"""Token text: cleaning, HTML, titles, colours and hook names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte-level artefacts of vocabularies and the characters that they stand for.
ARTEFACTS = {
    "âĢĶ": "—",
    "âĢĵ": "–",
    "âĢľ": "“",
    "âĢĿ": "”",
    "âĢĺ": "‘",
    "âĢĻ": "’",
    "âĢĭ": " ",
    "Ġ": " ",
    "Ċ": "\n",
    "ĉ": "\t",
}
# The same artefacts in HTML, then quotes, then characters with a meaning in HTML or in the page's scripts.
HTML_ARTEFACTS = {
    "âĢĶ": "&mdash;",
    "âĢĵ": "&ndash;",
    "âĢĭ": "&#8203;",
    "âĢľ": "&ldquo;",
    "âĢĿ": "&rdquo;",
    "âĢĺ": "&lsquo;",
    "âĢĻ": "&rsquo;",
    "Ġ": "&nbsp;",
    "Ċ": "&bsol;n",
    "ĉ": "&bsol;t",
}
HTML_QUOTES = {"'": "&apos;", '"': "&quot;"}
HTML_MARKS = {
    "\\": "&bsol;",
    "<": "&lt;",
    ">": "&gt;",
    ")": "&#41;",
    "(": "&#40;",
    "[": "&#91;",
    "]": "&#93;",
    "{": "&#123;",
    "}": "&#125;",
}
# Back from HTML.
HTML_BACK = {"&mdash;": "—", "&ndash;": "–", "&#8203;": " ", "&ldquo;": "“", "&rdquo;": "”", "&lsquo;": "‘", "&rsquo;": "’", "&nbsp;": " "} | {v: k for k, v in HTML_QUOTES.items()} | {v: k for k, v in HTML_MARKS.items() if k != "\\"}


def replaced(text: Column, table: dict[str, str]) -> Column:
    """Literal replacements, one after another in the table's order."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), table.items(), text)


def clean_token(token: Column) -> Column:
    return replaced(token, ARTEFACTS)


def to_html(token: Column, escape: bool = True) -> Column:
    """Artefacts always; with escape also quotes, line breaks, tabs and marks."""
    out = replaced(token, HTML_ARTEFACTS)
    return replaced(out, HTML_QUOTES | {"\\": "\\\\", "\n": "\\n", "\t": "\\t", "\r": "\\r"} | HTML_MARKS) if escape else out


def from_html(token: Column) -> Column:
    """The token that to_html() has escaped, with artefacts as the characters that they stand for."""
    out = replaced(token, HTML_BACK)
    # Backslashes last, so that none that they give is read as the start of another escape.
    pair = "&bsol;&bsol;"
    out = F.replace(out, F.lit(pair), F.lit("\x00"))
    out = replaced(out, {"&bsol;n": "\n", "&bsol;t": "\t", "&bsol;r": "\r"})
    return F.replace(out, F.lit("\x00"), F.lit("\\"))


def _hex(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.round(x).cast("int")), 2, "0"))


def warm_colour(share: Column) -> Column:
    """White at 0 to dark orange (255, 140, 0) at 1; clipped."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return F.concat(F.lit("#ff"), _hex(255 - 115 * s), _hex(255 - 255 * s))


def cold_warm_colour(share: Column) -> Column:
    """Blue at -1, white at 0, red at 1; clipped."""
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), share))
    fade = 255 * (1 - F.abs(s))
    return F.concat(F.lit("#"), F.when(s < 0, _hex(fade)).otherwise("ff"), _hex(fade), F.when(s > 0, _hex(fade)).otherwise("ff"))


def group_title(kind: Column, lower: Column, upper: Column, share: Column) -> Column:
    """The title of a sequence group, with its bounds to 3 decimals and its share to 3 decimals of a percent."""
    return F.when(kind == "TOP", F.concat(F.lit("TOP ACTIVATIONS<br>MAX = "), F.format_string("%.3f", upper))).otherwise(
        F.concat(F.lit("INTERVAL "), F.format_string("%.3f", lower), F.lit(" - "), F.format_string("%.3f", upper), F.lit("<br>CONTAINS "), F.format_string("%.3f", share * 100), F.lit("%"))
    )


def title_bounds(title: Column) -> Column:
    """struct(bin_min, bin_max, bin_contains) from a title; the top group is -1, its maximum, -1."""
    number = lambda pattern: F.regexp_extract(title, pattern, 1).try_cast("double")
    top = title.startswith("TOP")
    return F.struct(
        F.when(top, -1.0).otherwise(number(r"INTERVAL (-?[0-9.]+)")).alias("bin_min"),
        F.when(top, number(r"MAX = (-?[0-9.]+)")).otherwise(number(r" - (-?[0-9.]+)")).alias("bin_max"),
        F.when(top, -1.0).otherwise(number(r"CONTAINS ([0-9.]+)%") / 100).alias("bin_contains"),
    )


def hook_layer(name: Column) -> Column:
    """Layer of blocks.N.rest, or of a path with layers.N or h.N; null otherwise."""
    return F.nullif(F.regexp_extract(name, r"^(?:blocks|.*\blayers|.*\bh)\.(\d+)(?:\.|$)", 1), F.lit("")).cast("int")


def hook_point(name: Column) -> Column:
    """What follows blocks.N."""
    return F.nullif(F.regexp_extract(name, r"^blocks\.\d+\.(.+)$", 1), F.lit(""))


def source_id(layer: Column, source_set: Column, suffix: Column) -> Column:
    return F.concat(layer.cast("string"), F.lit("-"), source_set, F.coalesce(F.concat(F.lit("__"), suffix), F.lit("")))


def key_id(*parts: Column) -> Column:
    """A reproducible row id: c and 24 hex digits of the md5 of the parts."""
    return F.concat(F.lit("c"), F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 24))


def percent(share: Column, places: Column) -> Column:
    """A percentage with a number of decimals that differs by row (1, 2 or 3)."""
    p = share * 100
    return F.concat(F.when(places == 1, F.format_string("%.1f", p)).when(places == 2, F.format_string("%.2f", p)).otherwise(F.format_string("%.3f", p)), F.lit("%"))

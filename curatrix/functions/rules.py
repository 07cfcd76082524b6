"""Ordered rule lists, look-ups and record clean-up as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions.text import col, or_else, split_labels, squeeze, years


def first_rule(x: Column | str, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The name of the first (pattern, name) whose pattern is found, in either case."""
    y = F.coalesce(col(x), F.lit(""))
    steps = [(y.rlike(f"(?i){p}"), name) for p, name in rules]
    out = reduce(lambda c, s: c.when(*s), steps[1:], F.when(*steps[0]))
    return out.otherwise(F.lit(otherwise))


def looked_up(x: Column | str, names: dict[str, str], otherwise: Column | str | None = None) -> Column:
    """A value's entry in a short fixed map."""
    table = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return F.coalesce(table[col(x)], F.lit(otherwise) if isinstance(otherwise, str) or otherwise is None else otherwise)


def replaced_in_order(x: Column | str, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other; the order matters."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col(x))


def year_text(x: Column | str) -> Column:
    """``[c. ]start[-end]`` of a year text; the text itself where it has no year."""
    y = squeeze(x)
    found = years(x, 1000, 2099)
    about = F.when(y.rlike(r"(?i)^(c\.|ca\.?|circa|about)\s*"), "c. ").otherwise("")
    span = F.when(F.size(found) > 1, F.concat(F.element_at(found, 1).cast("string"), F.lit("-"), F.element_at(found, 2).cast("string"))).otherwise(F.element_at(F.when(F.size(found) > 0, found), 1).cast("string"))
    return F.when(F.size(found) > 0, F.concat(about, span)).otherwise(y)


def known_place(x: Column | str, sources: list[str], unknown: str = "unknown") -> Column:
    """A place without leading commas; names that only say where a record came from are unknown."""
    y = F.trim(F.regexp_replace(squeeze(x), r"^[,;\s]+|[,;\s]+$", ""))
    return F.when((F.coalesce(y, F.lit("")) == "") | F.lower(y).isin(sources), unknown).otherwise(y)


def is_file_format(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike(r"(?i)^\s*(jpe?g|png|tiff?|gif|webp)( image| file)?\s*$"), F.lit(False))


def is_pixel_size(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike(r"(?i)\d+\s*[x×]\s*\d+\s*(px|pixels?)\b"), F.lit(False))


def clipped(x: Column | str, most: int = 399) -> Column:
    """At most ``most`` characters and a closing mark."""
    y = squeeze(x)
    cut = F.when(F.length(y) > most, F.rtrim(F.substring(y, 1, most))).otherwise(y)
    return F.when(cut.rlike(r"[.!?。！？]$") | (cut == ""), cut).otherwise(F.concat(cut, F.lit(".")))


def padded_tags(tags: Column | str, fillers: list[str], least: int = 4, most: int = 6) -> Column:
    """The first ``most`` tags, filled up to ``least`` from a list that is long enough."""
    own = F.slice(F.array_distinct(col(tags)), 1, most)
    more = F.array_except(F.array(*[F.lit(f) for f in fillers]), own)
    need = F.greatest(F.lit(least) - F.size(own), F.lit(0))
    return F.concat(own, F.slice(more, F.lit(1), need))


def decade_labels(x: Column | str) -> Column:
    """``1880s`` of the first year."""
    y = years(x, 1000, 2099)
    return F.concat((F.floor(F.element_at(F.when(F.size(y) > 0, y), 1) / 10) * 10).cast("string"), F.lit("s"))


def name_parts(x: Column | str) -> Column:
    """A creator's text whole, before its brackets, and inside."""
    y = squeeze(x)
    inside = F.regexp_extract(y, r"[(（]([^)）]*)[)）]", 1)
    before = F.trim(F.regexp_extract(y, r"^([^(（]*)[(（]", 1))
    return F.array_distinct(F.filter(F.array(y, before, inside), lambda p: p != ""))


def lifespan(x: Column | str) -> tuple[Column, Column]:
    """Birth and death year of ``(1853-90)`` and the like; a death year of two digits is in the birth's century, or in
    the next where it would come first."""
    pattern = r"([12][0-9]{3})\s*[-–—]\s*([12][0-9]{3}|[0-9]{2})?"
    born, died = F.regexp_extract(col(x), pattern, 1).try_cast("int"), F.regexp_extract(col(x), pattern, 2)
    short = F.floor(born / 100) * 100 + died.try_cast("int")
    full = F.when(F.length(died) == 2, F.when(short < born, short + 100).otherwise(short)).otherwise(died.try_cast("int"))
    return born, full.cast("int")


def ratio(x: Column | str) -> Column:
    """First number over second of a size text; null without two or with a zero."""
    n = F.transform(F.regexp_extract_all(col(x), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda v: v.cast("double"))
    return F.when((F.size(n) >= 2) & (F.element_at(F.when(F.size(n) >= 2, n), 2) > 0), F.element_at(F.when(F.size(n) >= 2, n), 1) / F.element_at(F.when(F.size(n) >= 2, n), 2))


def image_verdict(width: Column, height: Column, mime: Column, least: int = 600) -> Column:
    """ok, small, or format."""
    return F.when(~F.coalesce(mime.isin("image/jpeg", "image/png", "image/webp"), F.lit(False)), "format").when(F.coalesce(F.least(width, height), F.lit(0)) < least, "small").otherwise("ok")


def priority_sorted(values: Column | str, order: list[str], most: int) -> Column:
    """Values each once, those of a list first and in its order, the rest by name; at most ``most``."""
    place = F.array(*[F.lit(v) for v in order])
    keyed = F.transform(F.array_distinct(col(values)), lambda v: F.struct(F.when(F.array_contains(place, v), F.array_position(place, v)).otherwise(len(order) + 1).alias("p"), v.alias("v")))
    return F.slice(F.transform(F.array_sort(keyed), lambda s: s["v"]), 1, most)


def artwork(record_id: list[str], title: list[str], creator: list[str], tags: list[str]) -> list[Column]:
    """Canonical projection: the first field with a value for id, title and creator; tags from all fields, each once."""
    parts = F.flatten(F.array(*[split_labels(t) for t in tags]))
    return [or_else(*record_id, F.lit("")).alias("id"), or_else(*[squeeze(t) for t in title], F.lit("untitled")).alias("title"), or_else(*[squeeze(c) for c in creator], F.lit("unknown")).alias("creator"), F.array_distinct(parts).alias("tags")]

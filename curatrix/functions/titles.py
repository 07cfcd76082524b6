"""Titles, series and labels of works and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions.text import col, or_else, squeeze

#: Fixed value: words of titles that are copies, parts or versions of another work.
DERIVATIVE = r"album|pl\.|plate|study|studies|sketch|after|follower|circle|school|studio|workshop|cercle|poster|posters|lith|illustration|copy|reproduction"


def is_derivative(title: Column | str, artist: Column | str, tags: Column | str) -> Column:
    """Whether title, creator or tags say that a work is derived from another."""
    text = F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(artist), F.lit("")), F.array_join(F.coalesce(col(tags), F.array().cast("array<string>")), " "))
    return text.rlike(rf"(?i)\b(?:{DERIVATIVE})\b")


def series_artist(x: Column | str) -> Column:
    """A creator's plain name without brackets and words of attribution; unknown where nothing is left."""
    y = F.regexp_replace(squeeze(x), r"\([^)]*\)", "")
    y = F.regexp_replace(y, r"(?i)\b(?:follower|circle|school|studio|after|workshop|cercle)\s+of\b", "")
    return or_else(F.lower(F.trim(F.regexp_replace(y, "(?i)[^a-z0-9]+", " "))), F.lit("unknown"))


def series_title(x: Column | str, albums: dict[str, str] | None = None) -> Column:
    """A title without numbers of plates, so that a series' works are alike; ``albums`` names whole series by a part of
    their titles."""
    title = F.lower(squeeze(x))
    y = F.regexp_replace(title, r"\bpl\.?\s*[0-9]+\b", "")
    y = F.regexp_replace(F.regexp_replace(y, r"\b(?:plate|no|number)\s*[0-9]+\b", ""), r"\b[0-9]+\b", "")
    out = F.trim(F.regexp_replace(y, "[^a-z0-9]+", " "))
    for part, name in reversed((albums or {}).items()):
        out = F.when(F.contains(title, F.lit(part)), name).otherwise(out)
    return out


def is_relevant(title: Column | str, query: Column | str, required: dict[str, str]) -> Column:
    """Whether a listing answers a query: ``required`` gives, for queries that hold a pattern, one that the title must
    match; the first that applies counts, and other queries take everything."""
    steps = None
    for asked, needed in required.items():
        when, then = F.lower(col(query)).rlike(asked), squeeze(title).rlike(f"(?i){needed}")
        steps = F.when(when, then) if steps is None else steps.when(when, then)
    return F.lit(True) if steps is None else steps.otherwise(True)


def display_label(x: Column | str) -> Column:
    """A label as shown: compatibility form, one blank between words, no separators at the ends."""
    from curatrix.functions.unicode import nfkc

    y = col(x)
    y = F.when(y.rlike(r"[^\x00-\x7F]"), nfkc(y)).otherwise(y)
    return F.regexp_replace(F.trim(F.regexp_replace(y, r"(?U)\s+", " ")), r"^[,，;；、|/]+|[,，;；、|/]+$", "")


def candidate_id(dimension: Column | str, label: Column | str) -> Column:
    """Id of a term that isn't in the vocabulary yet, by its plain label."""
    return F.concat(col(dimension), F.lit("-candidate-"), F.substring(F.sha1(col(label)), 1, 10))


def transliterated(x: Column | str, letters: dict[str, str]) -> Column:
    """A slug of Latin letters and digits: ``letters`` gives the Latin form of other characters, each a word of its own
    (behind digits it joins them); all else separates."""
    y = F.lower(F.coalesce(col(x), F.lit("")))
    table = F.create_map(*[F.lit(v) for pair in letters.items() for v in pair]) if letters else F.create_map().cast("map<string,string>")
    chars = F.transform(F.filter(F.split(y, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[a-z0-9]"), c).when(table[c].isNotNull(), F.concat(F.lit("\u0001"), table[c], F.lit("\u0002"))).otherwise(" "))
    joined = F.array_join(chars, "")
    # behind digits alone the word goes on, and what follows joins it
    joined = F.regexp_replace(joined, "(?<![a-z0-9])([0-9]+)\u0001([^\u0002]*)\u0002", "$1$2")
    return F.regexp_replace(F.regexp_replace(joined, "[ \u0001\u0002]+", "-"), "^-+|-+$", "")


def id_prefix_fields(kind: Column | str, fields: dict[str, str]) -> Column:
    """The array column that holds ids of a kind of term; empty for other kinds."""
    table = F.create_map(*[F.lit(v) for pair in fields.items() for v in pair])
    return F.coalesce(table[col(kind)], F.lit(""))


#: Columns of a work by kind of term.
TERM_FIELDS = {k: f"{k}_ids" for k in ("style", "subject", "medium", "technique", "support", "format", "period", "series", "region", "country", "rights")}

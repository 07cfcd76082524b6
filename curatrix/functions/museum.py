"""Open museum records as candidates of one form. Each of the three sources has its own rule of what is free, who made it
and what kind of thing it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import col, or_else, plain_artist

#: Roles that make someone a work's own creator, by source.
ROLES = "artist|designer|painter"
MORE_ROLES = ROLES + "|draftsman|engraver|etcher|printmaker|sculptor"
COLUMNS = ["source", "source_id", "source_url", "image_url", "title", "artist", "date", "place", "medium", "dimensions", "classification", "rights"]


def same_artist(expected: Column | str, actual: Column | str, qualifier: Column | None = None) -> Column:
    """Whether two names are one creator's; a qualifier other than a creator's role rules it out."""
    same = F.coalesce(plain_artist(expected) == plain_artist(actual), F.lit(False))
    return same if qualifier is None else same & F.coalesce((qualifier == "") | qualifier.rlike(f"(?i)^(?:{ROLES})$"), F.lit(True))


def is_artwork(*kinds: Column | str) -> Column:
    """Not a book or periodical."""
    text = F.lower(F.concat_ws(" ", *[F.nullif(col(k), F.lit("")) for k in kinds]))
    return ~text.rlike(r"(^|[^0-9a-z_])(book|books|publication|periodical|catalog|catalogue)($|[^0-9a-z_])")


def _listed(*values: Column) -> Column:
    """Values trimmed, none empty, each once."""
    return _cleaned(F.array(*values))


def _cleaned(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != ""))


def _with_collection(items: DataFrame, *values: str) -> Column:
    """The values and, where the records have one, their list of collections."""
    more = F.coalesce(F.col("collection"), F.array().cast("array<string>")) if "collection" in items.columns else F.array().cast("array<string>")
    return _cleaned(F.concat(F.array(*values), more))


def _title(x: str) -> Column:
    return or_else(x, F.lit("暂不明确"))


def _empty(x: str) -> Column:
    return F.coalesce(F.col(x), F.lit(""))


def cleveland(items: DataFrame, artist: str) -> DataFrame:
    """Free works with a print image of which a listed creator, a creator by role, is ``artist``. Names are compared once per
    listed creator, so the list is taken apart and the first that fits is kept."""
    free = items.where((F.col("share_license_status") == "CC0") & (F.coalesce(F.col("print_url"), F.lit("")) != "") & is_artwork("type", "department"))
    listed = free.select("id", F.posexplode("creators").alias("__at", "__c"))
    bare = F.regexp_replace(F.coalesce(F.col("__c.description"), F.lit("")), r"\s*\([^)]*\).*$", "")
    role = F.coalesce(F.nullif(F.col("__c.qualifier"), F.lit("")), F.lit("artist"))
    own = listed.where(same_artist(F.lit(artist), bare, role)).groupBy("id").agg(F.min_by("__c.description", "__at").alias("__own"))
    return free.join(own, "id").select(
        F.lit("cma").alias("source"),
        F.col("id").cast("string").alias("source_id"),
        or_else("url", F.concat(F.lit("https://www.clevelandart.org/art/"), F.col("accession_number"))).alias("source_url"),
        F.col("print_url").alias("image_url"),
        _title("title").alias("title"),
        or_else("__own", F.lit(artist)).alias("artist"),
        _empty("creation_date").alias("date"),
        F.array_join(_listed(F.array_join("culture", ", "), F.col("current_location")), "; ").alias("place"),
        _empty("technique").alias("medium"),
        _empty("measurements").alias("dimensions"),
        _with_collection(free, "type", "department").alias("classification"),
        F.lit("CC0").alias("rights"),
    )


def metropolitan(items: DataFrame, artist: str) -> DataFrame:
    """Works in the public domain with an image, by ``artist`` without a prefix such as "after"."""
    role = F.coalesce(F.nullif(F.col("artistRole"), F.lit("")), F.lit("artist")).rlike(f"(?i)^(?:{MORE_ROLES})$")
    bare = F.trim(F.coalesce(F.col("artistPrefix"), F.lit(""))) == ""
    kept = items.where(F.col("isPublicDomain") & (_empty("primaryImage") != "") & same_artist(F.lit(artist), "artistDisplayName") & bare & role & is_artwork("objectName", "classification", "department"))
    return kept.select(
        F.lit("met").alias("source"),
        F.col("objectID").cast("string").alias("source_id"),
        or_else("objectURL", F.concat(F.lit("https://www.metmuseum.org/art/collection/search/"), F.col("objectID").cast("string"))).alias("source_url"),
        F.col("primaryImage").alias("image_url"),
        _title("title").alias("title"),
        or_else("artistDisplayName", F.lit(artist)).alias("artist"),
        _empty("objectDate").alias("date"),
        F.array_join(_listed(F.col("culture"), F.col("country"), F.col("city")), "; ").alias("place"),
        _empty("medium").alias("medium"),
        _empty("dimensions").alias("dimensions"),
        _listed(F.col("classification"), F.col("department")).alias("classification"),
        F.lit("Public Domain").alias("rights"),
    )


def chicago(items: DataFrame, artist: str, images: str) -> DataFrame:
    """Works in the public domain with an image, whose title of the creator and first line of the display both name him."""
    shown = F.trim(F.regexp_extract(_empty("artist_display"), r"^[^\r\n]*", 0))
    kept = items.where(F.col("is_public_domain") & (_empty("image_id") != "") & same_artist(F.lit(artist), "artist_title") & same_artist(F.lit(artist), shown) & is_artwork("artwork_type_title", "classification_title", "department_title"))
    return kept.select(
        F.lit("aic").alias("source"),
        F.col("id").cast("string").alias("source_id"),
        or_else("api_link", F.concat(F.lit("https://www.artic.edu/artworks/"), F.col("id").cast("string"))).alias("source_url"),
        F.concat(F.lit(f"{images}/"), F.col("image_id"), F.lit("/full/!1686,1686/0/default.jpg")).alias("image_url"),
        _title("title").alias("title"),
        or_else("artist_display", "artist_title", F.lit(artist)).alias("artist"),
        _empty("date_display").alias("date"),
        _empty("place_of_origin").alias("place"),
        _empty("medium_display").alias("medium"),
        _empty("dimensions").alias("dimensions"),
        _listed(F.col("classification_title"), F.col("department_title")).alias("classification"),
        F.lit("Public Domain").alias("rights"),
    )


def candidates(*parts: DataFrame) -> DataFrame:
    """Candidates of all sources with their key and a fingerprint of creator, title and year."""
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    title = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))
    mark = F.sha2(F.concat_ws("|", plain_artist("artist"), title, F.regexp_extract("date", "[0-9]{4}", 0)), 256)
    return rows.withColumn("key", F.concat_ws(":", "source", "source_id")).withColumn("fingerprint", mark)

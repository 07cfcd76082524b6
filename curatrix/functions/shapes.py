"""Record shapes: which fields a record of each kind has, and where their values come from.

A shape names, for each field, the source fields in order of preference and how a value is cleaned. ``shaped`` turns it
into one projection; source fields that a table lacks count as missing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Field(NamedTuple):
    """``kind``: plain (as it is), text (trimmed, at most ``limit`` characters), optional (trimmed, null where empty), list
    (texts, trimmed, none empty, at most 30 of 100 characters), array (as it is), count (whole and not negative), number (a
    fixed one, in ``limit``)."""

    sources: str
    kind: str = "plain"
    default: str | None = ""
    limit: int = 0


def _text(limit: int, *sources: str) -> Field:
    return Field(" ".join(sources), "text", "", limit)


def _value(df: DataFrame, f: Field) -> Column:
    known = [F.col(s) for s in f.sources.split() if s in df.columns]
    if f.kind == "number":
        return F.lit(f.limit)
    if f.kind in ("list", "array"):
        found = F.coalesce(*known, F.array().cast("array<string>"))
        if f.kind == "array":
            return found
        clean = F.transform(found, lambda t: F.substring(F.trim(t), 1, 100))
        return F.slice(F.filter(clean, lambda t: t != ""), 1, 30)
    if f.kind == "count":
        return F.greatest(F.floor(F.coalesce(*[c.cast("double") for c in known], F.lit(0.0))), F.lit(0)).cast("long")
    found = F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in known], F.lit(None).cast("string"))
    if f.kind in ("text", "optional"):
        found = F.nullif(F.trim(found), F.lit(""))
    if f.limit:
        found = F.substring(found, 1, f.limit)
    return found if f.default is None else F.coalesce(found, F.lit(f.default))


def shaped(df: DataFrame, shape: dict[str, Field], *more: Column | str) -> DataFrame:
    """The table's rows in a shape, after the columns ``more``."""
    return df.select(*more, *[_value(df, f).alias(name) for name, f in shape.items()])


#: A work as a user's library keeps it.
WORK_SNAPSHOT = {
    "_id": _text(180, "_id", "id"),
    "id": _text(180, "id", "_id"),
    "source_id": _text(180, "source_id"),
    "supabase_id": _text(180, "supabase_id"),
    "title": _text(240, "title"),
    "titleCn": _text(240, "titleCn", "title_cn"),
    "titleEn": _text(240, "titleEn", "title_en"),
    "artist": _text(240, "artist"),
    "thumbnail_url": _text(1000, "thumbnail_url"),
    "display_url": _text(1000, "display_url"),
    "cloud_file_id": _text(1000, "cloud_file_id"),
    "medium": _text(240, "medium"),
    "dimensions": _text(240, "dimensions"),
    "tags": Field("tags", "list"),
    "tag_keys": Field("tag_keys", "list"),
    "year": _text(100, "year"),
    "location": _text(240, "location"),
    "sourceName": _text(240, "sourceName", "source_name"),
    "description": _text(1200, "description"),
    "savedAt": _text(80, "savedAt"),
    "viewedAt": _text(80, "viewedAt"),
}
#: A creator as a user's library keeps it.
ARTIST_SNAPSHOT = {
    "id": _text(180, "id", "_id"),
    "nameZh": _text(240, "nameZh", "name_zh"),
    "nameEn": _text(240, "nameEn", "name_en"),
    "lifespan": _text(120, "lifespan"),
    "country": _text(120, "country"),
    "region": _text(120, "region"),
    "styles": Field("styles", "list"),
    "periods": Field("periods", "list"),
    "aliases": Field("aliases", "list"),
    "avatarText": _text(10, "avatarText"),
    "portraitUrl": _text(1000, "portraitUrl"),
    "portraitSource": _text(1000, "portraitSource"),
    "portraitLicense": _text(240, "portraitLicense"),
    "portraitCredit": _text(500, "portraitCredit"),
    "portraitKind": _text(120, "portraitKind"),
    "portraitArtworkId": _text(180, "portraitArtworkId"),
    "portraitStatus": _text(80, "portraitStatus"),
    "portraitSnapshotVersion": Field("", "number", limit=1),
    "artworkCount": Field("artworkCount", "count"),
    "tags": Field("tags", "list"),
    "followedAt": _text(80, "followedAt"),
}
#: A work in a device's own lists.
COMPACT_WORK = {
    "_id": Field("_id id source_id supabase_id"),
    "id": Field("_id id source_id supabase_id"),
    "source_id": Field("source_id"),
    "supabase_id": Field("supabase_id"),
    "title": Field("title"),
    "titleCn": Field("titleCn title_cn title"),
    "titleEn": Field("titleEn title_en"),
    "artist": Field("artist"),
    "thumbnail_url": Field("thumbnail_url"),
    "display_url": Field("display_url"),
    "medium": Field("medium"),
    "dimensions": Field("dimensions"),
    "tags": Field("tags", "array"),
    "tag_keys": Field("tag_keys", "array"),
    "year": Field("year"),
    "location": Field("location"),
    "sourceName": Field("sourceName source_name"),
    "description": Field("description"),
}
#: A row of the relational view as a document.
EXPORTED_WORK = {
    "supabase_id": Field("id", "optional", None),
    "slug": Field("slug", "optional", None),
    "title_cn": Field("title_cn", "optional", "未命名作品"),
    "title_en": Field("title_en", "optional", None),
    "artist": Field("artist", "optional", "Unknown artist"),
    "year_and_place": Field("year_and_place", "optional", None),
    "location": Field("location", "optional", None),
    "medium": Field("medium", "optional", None),
    "dimensions": Field("dimensions", "optional", None),
    "description": Field("description", "optional", None),
    "source_name": Field("source_name", "optional", None),
    "source_url": Field("source_url", "optional", None),
    "image_id": Field("image_id", "optional", None),
    "thumbnail_url": Field("thumbnail_url display_url", "optional", None),
    "display_url": Field("display_url thumbnail_url", "optional", None),
    "download_url": Field("download_url", "optional", None),
}
#: A document as a row of a page.
PAGE_WORK = {
    "id": Field("id"),
    "title_cn": Field("title_cn"),
    "title_en": Field("title_en"),
    "artist": Field("artist"),
    "location": Field("location"),
    "year_and_place": Field("year_and_place"),
    "medium": Field("medium"),
    "dimensions": Field("dimensions"),
    "description": Field("description"),
    "display_url": Field("display_url thumbnail_url"),
    "thumbnail_url": Field("thumbnail_url"),
    "download_url": Field("download_url"),
    "iiif_url": Field("iiif_url"),
}
#: A row of a page as a client shows it.
SHOWN_WORK = {
    "title": Field("title_cn title_en", default="未命名作品"),
    "titleEn": Field("title_en"),
    "artist": Field("artist", default="未知艺术家"),
    "location": Field("location", default="未知收藏地"),
    "yearAndPlace": Field("year_and_place", default="年代与地点暂未收录"),
    "medium": Field("medium", default="材质暂未收录"),
    "dimensions": Field("dimensions", default="尺寸暂未收录"),
    "thumbnailUrl": Field("thumbnail_url display_url"),
    "displayUrl": Field("display_url thumbnail_url"),
    "downloadUrl": Field("download_url"),
}
#: A creator as a client shows it.
SHOWN_ARTIST = {
    "id": Field("_id id"),
    "nameZh": Field("name_zh nameZh"),
    "nameEn": Field("name_en nameEn"),
    "lifespan": Field("lifespan_text lifespan"),
    "region": Field("region"),
    "country": Field("country"),
    "styles": Field("styles", "array"),
    "periods": Field("periods", "array"),
    "aliases": Field("aliases", "array"),
    "bio": Field("bio_zh bio"),
    "artworkCount": Field("artwork_count artworkCount", "count"),
    "reviewStatus": Field("review_status reviewStatus", "text"),
    "regionId": Field("region_id regionId"),
}
#: Fields of a portrait that only an approved one shows.
PORTRAIT = {"portraitUrl": "portrait_url", "portraitSource": "portrait_source", "portraitLicense": "portrait_license", "portraitCredit": "portrait_credit", "portraitKind": "portrait_kind", "portraitArtworkId": "portrait_artwork_id"}


def portrait_fields(df: DataFrame) -> dict[str, Column]:
    """The portrait's fields by name, empty unless it is approved, and its status."""
    status = _value(df, Field("portrait_status portraitStatus", "text"))
    return {camel: F.when(status == "approved", _value(df, Field(f"{snake} {camel}", "text"))).otherwise("").alias(camel) for camel, snake in PORTRAIT.items()} | {"portraitStatus": status.alias("portraitStatus")}


def exported_tags(tags: Column | str, text: Column | str) -> Column:
    """Tags of a list and of a text cut at commas, semicolons and white space, each once in order."""
    listed, written = (F.col(x) if isinstance(x, str) else x for x in (tags, text))
    parts = F.concat(F.coalesce(listed, F.array().cast("array<string>")), F.split(F.coalesce(written, F.lit("")), r"[,，；、\s]+"))
    return F.array_distinct(F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != ""))


def evidence_record(df: DataFrame, site: str, *more: Column | str) -> DataFrame:
    """A work crawled from ``site`` as evidence for review: where it comes from, what was read, and its image, each a struct."""
    v = lambda name: _value(df, Field(name))
    source = F.struct(F.lit(site).alias("name"), v("source_url").alias("url"), v("source_record_id").alias("record_id"))
    raw = F.struct(*[v(n).alias(n) for n in ("title_cn", "title_en", "artist")], v("location").alias("collection"), v("year_and_place").alias("year_text"), v("medium").alias("file_format"), v("dimensions").alias("image_pixel_dimensions"), v("license").alias("license"))
    image = F.struct(F.coalesce(F.nullif(v("image_id"), F.lit("")), F.regexp_replace(v("asset_name"), r"\.[^.]+$", "")).alias("id"), v("asset_name").alias("asset_name"), v("image_url").alias("preview_url"), v("download_url").alias("download_url"))
    return df.select(*more, F.lit(1).alias("schema_version"), F.lit("pending").alias("review_status"), F.lit("unreviewed").alias("confidence"), source.alias("source"), raw.alias("raw"), image.alias("image"))


def without_keys(df: DataFrame, *keys: str) -> DataFrame:
    """All columns but some; those that aren't there don't matter."""
    return df.drop(*keys)


def only_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """The public ones of a table's columns, in the list's order."""
    return df.select(*[f for f in fields if f in df.columns])


def plain_numbers(json: Column | str) -> Column:
    """JSON whose wrapped numbers (int, long, double) are plain ones."""
    x = F.col(json) if isinstance(json, str) else json
    return F.regexp_replace(x, r'\{\s*"\$number(?:Int|Long|Double)"\s*:\s*"([^"]*)"\s*\}', "$1")


def clean_filters(df: DataFrame, groups: list[str]) -> list[Column]:
    """One trimmed text per filter group, empty where there is none."""
    return [_value(df, Field(g, "text")).alias(g) for g in groups]

"""Addresses of images and listings, names of stored files."""

from __future__ import annotations

from urllib.parse import urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions.text import col, host

_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def url_path(url: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(col(url), _PATH, 1), F.lit(""))


def is_direct_media(url: Column | str) -> Column:
    """Whether an address is a media file's own: by its ending, or by a folder that holds nothing else."""
    path = url_path(F.trim(col(url)))
    return path.rlike(r"(?i)\.(?:avif|gif|jpe?g|png|tiff?|webp)$") | F.contains(path, F.lit("/storage/v1/object/")) | F.contains(path, F.lit("/derivatives/"))


def asset_name(number: Column | str, ending: str = ".jpg") -> Column:
    """``007_standard.jpg``; longer numbers stay whole."""
    n = col(number).cast("string")
    return F.concat(F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n), F.lit(f"_standard{ending}"))


def csv_timestamp(at: Column | str) -> Column:
    """``20240131T070809Z`` of a UTC time."""
    return F.date_format(col(at), "yyyyMMdd'T'HHmmss'Z'")


def derivative_paths(image_id: Column | str) -> tuple[Column, Column]:
    """Stored paths of an image's small and large form; null where the id is empty."""
    safe = F.nullif(F.regexp_replace(F.trim(col(image_id)), "[^a-zA-Z0-9._-]", "-"), F.lit(""))
    return tuple(F.concat(F.lit(f"derivatives/{kind}/"), safe, F.lit(".webp")) for kind in ("thumb", "display"))


def original_image(store: str, folder: str, *urls: Column | str) -> Column:
    """The first address that is a JPEG of the store's folder, without query and fragment; empty if none is."""
    steps = [F.when((host(u) == store) & F.startswith(url_path(u), F.lit(folder)) & url_path(u).rlike(r"(?i)\.jpe?g$"), F.regexp_replace(col(u), r"[?#].*$", "")) for u in urls]
    return F.coalesce(*steps, F.lit(""))


def image_patch(original: Column, thumbs: str, displays: str, thumbnail: Column | str, display: Column | str, download: Column | str) -> Column:
    """Struct of the three addresses that a row should have: small and large forms for numbered originals, else the
    original; null where there is no original or nothing would change."""
    name = F.regexp_extract(original, r"/([^/]*)\.[^./]*$", 1)
    at = F.regexp_extract(original, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    numbered = name.rlike(r"(?i)^[0-9]+_standard$")
    derived = lambda folder: F.when(numbered, F.concat(at, F.lit(folder), name, F.lit(".webp"))).otherwise(original)
    same = (col(thumbnail).eqNullSafe(derived(thumbs))) & (col(display).eqNullSafe(derived(displays))) & (col(download).eqNullSafe(original))
    return F.when((original != "") & ~same, F.struct(derived(thumbs).alias("thumbnail_url"), derived(displays).alias("display_url"), original.alias("download_url")))


def search_listing(site: str, query: str, page: int = 1, size: int = 20) -> str:
    """Address of a page of search results."""
    return f"{site}/main/{'' if page == 1 else f'page/{page}/'}?" + urlencode({"s": query, "per_page": size})


def artist_listing(artist_url: str, page: int = 1, size: int = 20) -> str:
    """Address of a page of a creator's works."""
    base = artist_url.split("?")[0].rstrip("/")
    return f"{base}/{'' if page == 1 else f'page/{page}/'}?" + urlencode({"per_page": size})


def is_maintenance_page(html: Column | str) -> Column:
    """Whether a page only says that the site is under maintenance."""
    y = col(html)
    return F.coalesce(y.rlike(r"(?i)<title>\s*(?:Site\s+)?Under Maintenance\b") | y.rlike(r"(?i)\bOur website is currently undergoing scheduled maintenance\b"), F.lit(False))

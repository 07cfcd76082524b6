"""Fixed values of the catalogue: dimensions of the vocabulary, aliases and weights of the search, achievements."""

from __future__ import annotations

#: Dimension: prefix of its ids, whether it has a classification page, whether it is recommended by.
DIMENSIONS = {
    "style": ("style-", True, True),
    "subject": ("subject-", True, True),
    "medium": ("medium-", False, True),
    "technique": ("technique-", False, True),
    "support": ("support-", False, True),
    "format": ("format-", False, True),
    "series": ("series-", False, True),
    "period": ("period-", True, True),
    "region": ("region-", False, True),
    "country": ("country-", False, True),
    "rights": ("rights-", False, False),
    "collection": ("collection-", False, False),
    "source": ("source-", False, False),
}
PREFIXES = {k: v[0] for k, v in DIMENSIONS.items()}
PAGED = tuple(k for k, v in DIMENSIONS.items() if v[1])
RECOMMENDED = tuple(k for k, v in DIMENSIONS.items() if v[2])

#: Search: what a group answers to, and what it is searched as.
SEARCH_ALIASES = [
    (
        ["达", "达芬奇", "达·芬奇", "列奥纳多", "列奥纳多达芬奇", "leonardo", "da vinci", "davinci", "leonardo da vinci"],
        ["列奥纳多·达·芬奇", "列奥纳多", "达·芬奇", "达芬奇", "Leonardo da Vinci", "Da Vinci", "Leonardo"],
    )
]
#: Search: fields of a work and their weight.
SEARCH_FIELDS = [
    (["title", "titleCn", "title_cn"], 180),
    (["titleEn", "title_en"], 160),
    (["artist", "artistDisplay", "artist_display", "artist_ids", "artist_labels"], 110),
    (["description"], 80),
    (["tags", "tag_keys", "tag_ids", "tag_labels", "tags_text"], 55),
    (["medium"], 45),
    (["year", "year_and_place", "period"], 35),
    (["location"], 30),
    (["sourceName", "source_name", "source_url", "image_id"], 8),
]

#: Achievement: title, how it is granted, metric, threshold, place.
ACHIEVEMENTS = {
    "ordinary_user": ("普通用户", "default", "", 0, 10),
    "first_masterpiece": ("初识名作", "automatic", "favorite_unique_count", 1, 20),
    "treasure_with_care": ("藏珍有道", "automatic", "favorite_unique_count", 20, 30),
    "artist_confidant": ("画家知己", "automatic", "followed_artist_unique_count", 10, 40),
    "art_wanderer": ("艺术漫游者", "automatic", "history_unique_count", 50, 50),
    "learned_all_ages": ("博古通今", "manual", "", 0, 60),
}
DEFAULT_ACHIEVEMENT = "ordinary_user"


def achievement(identifier: str | None) -> tuple | None:
    """An achievement by its id, trimmed; None if there is none."""
    return ACHIEVEMENTS.get((identifier or "").strip())

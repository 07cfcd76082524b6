"""Explicit schemas; records are never inferred."""

ARTWORKS = """
_id STRING, supabase_id STRING, slug STRING, title_cn STRING, title_en STRING, title STRING, artist STRING, artist_display STRING,
raw_artist_text STRING, year_and_place STRING, location STRING, medium STRING, dimensions STRING, description STRING, tags ARRAY<STRING>,
tags_text STRING, tag_keys ARRAY<STRING>, search_terms ARRAY<STRING>, source_name STRING, source_url STRING, image_id STRING,
thumbnail_url STRING, display_url STRING, download_url STRING, status STRING, created_at STRING, updated_at STRING,
primary_artist_id STRING, artist_ids ARRAY<STRING>, classification_ids ARRAY<STRING>, tag_ids ARRAY<STRING>,
recommendation_signal_ids ARRAY<STRING>, recommendation_status STRING, recommendation_quality_score DOUBLE, random_bucket INT
"""
ARTISTS = """
_id STRING, entity_type STRING, identity_status STRING, name_zh STRING, name_en STRING, aliases ARRAY<STRING>, birth_year INT,
death_year INT, country STRING, region_id STRING, style_ids ARRAY<STRING>, representative_artwork_ids ARRAY<STRING>, bio_zh STRING,
sources ARRAY<STRUCT<title:STRING,url:STRING,fields:ARRAY<STRING>>>, review_status STRING, public_visibility STRING, artwork_count INT
"""
VOCABULARY = """
_id STRING, type STRING, period_kind STRING, label_zh STRING, label_en STRING, aliases ARRAY<STRING>, parent_id STRING,
artist_id STRING, review_status STRING, publish_status STRING, display_enabled BOOLEAN, usage_scopes ARRAY<STRING>, sort_order INT
"""
TAG_LINKS = "_id STRING, artwork_id STRING, tag_id STRING, tag_label STRING, tag_type STRING, confidence DOUBLE, match_source STRING, review_status STRING"
ARTIST_LINKS = "_id STRING, artwork_id STRING, artist_id STRING, artist_label STRING, role STRING, confidence DOUBLE, matched BOOLEAN, match_source STRING"
MUTATIONS = "user_id LONG, resource STRING, item_id STRING, device_id STRING, updated_at TIMESTAMP, deleted BOOLEAN, device_count LONG"
REVIEW_CSV = "id STRING, title_cn STRING, title_en STRING, artist STRING, location STRING, year_and_place STRING, medium STRING, dimensions STRING, description STRING, tags STRING"
PAGES = "page_id LONG, url STRING, html STRING"

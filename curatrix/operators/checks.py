"""Rule sets for records, one row per broken rule, and the audit of creators' records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.catalogue import PAGED, RECOMMENDED
from curatrix.functions.text import CJK, col

#: States, kinds and roles that records may have, versions of the vocabulary, and bounds of a biography.
REVIEW = ("candidate", "reviewed", "rejected")
TERM_TYPES = ("style", "subject", "medium", "period", "region", "country", "collection", "source")
ROLES = ("creator", "after", "attributed_to", "workshop", "publisher", "subject", "unknown")
ENTITIES = ("person", "organization", "workshop", "attribution", "anonymous", "unresolved")
IDENTITIES = ("verified", "provisional", "conflicted", "duplicate", "unresolved")
VOCABULARY_VERSION, CLASSIFICATION_VERSION = "controlled-vocabulary-v2", "classification-v7"
SHORTEST, LONGEST, FACTS = 200, 300, ("lifespan", "title", "career", "standing")
PLACEHOLDER = "待审核|待补充|未知|不详|暂无|暂不明确|资料有限|不可考|未考证"


def filled(x: Column | str) -> Column:
    return F.coalesce(F.trim(col(x)) != "", F.lit(False))


def _any(values: Column | str) -> Column:
    return F.coalesce(F.exists(col(values), filled), F.lit(False))


def _aliases_differ(aliases: Column | str) -> tuple[Column, Column]:
    """No alias is empty; none is repeated, in whatever case."""
    plain = F.transform(col(aliases), lambda a: F.lower(F.trim(F.coalesce(a, F.lit("")))))
    some = F.filter(plain, lambda a: a != "")
    return F.size(plain) == F.size(some), F.size(some) == F.size(F.array_distinct(some))


def broken(rows: DataFrame, key: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """key, field, rule: one row per rule (name to field and what must hold) that a row breaks, null as broken."""
    found = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(name).alias("rule"))) for name, (field, ok) in rules.items()]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(found).alias("e")).select(key, "e.field", "e.rule")


def artist_rules() -> dict[str, tuple[str, Column]]:
    """Ids and names, a review status, aliases that differ, and a source or authority id for what is reviewed."""
    whole, differ = _aliases_differ("aliases")
    source = F.coalesce(F.exists("sources", lambda s: filled(s["url"]) | filled(s["title"])), F.lit(False))
    return {
        "id": ("_id", filled("_id")),
        "name_zh": ("name_zh", filled("name_zh")),
        "name_en": ("name_en", filled("name_en")),
        "status": ("review_status", col("review_status").isin(*REVIEW)),
        "aliases": ("aliases", col("aliases").isNotNull()),
        "empty alias": ("aliases", col("aliases").isNull() | whole),
        "duplicate alias": ("aliases", col("aliases").isNull() | differ),
        "evidence": ("sources", (F.coalesce(col("review_status"), F.lit("")) != "reviewed") | _any(F.map_values("authority_ids")) | source),
    }


def term_rules() -> dict[str, tuple[str, Column]]:
    whole, differ = _aliases_differ("aliases")
    return {
        "id": ("_id", filled("_id")),
        "label": ("label_zh", filled("label_zh")),
        "status": ("review_status", col("review_status").isin(*REVIEW)),
        "type": ("type", col("type").isin(*TERM_TYPES)),
        "empty alias": ("aliases", col("aliases").isNull() | whole),
        "duplicate alias": ("aliases", col("aliases").isNull() | differ),
    }


def link_rules() -> dict[str, tuple[str, Column]]:
    return {
        "id": ("_id", filled("_id")),
        "work": ("artwork_id", filled("artwork_id")),
        "creator": ("artist_id", filled("artist_id")),
        "status": ("review_status", col("review_status").isin(*REVIEW)),
        "role": ("role", col("role").isin(*ROLES)),
    }


def biography_length(x: Column | str) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)[\s\x{FEFF}]+", ""))


def biography_rules() -> dict[str, tuple[str, Column]]:
    """Length, a fact of each kind, and for persons the known years in the text and an occupation."""
    person = F.coalesce(col("entity_type") == "person", F.lit(False))
    said = lambda year: ~person | (F.coalesce(col(year), F.lit(0)) <= 0) | F.contains("bio_zh", col(year).cast("string"))
    return {
        "length": ("bio_zh", biography_length("bio_zh").between(SHORTEST, LONGEST)),
        **{f"fact {k}": (f"bio_facts.{k}", filled(F.col("bio_facts")[k])) for k in FACTS},
        "birth year": ("bio_zh", said("birth_year")),
        "death year": ("bio_zh", said("death_year")),
        "occupation": ("occupations_zh", ~person | _any("occupations_zh")),
    }


def enrichment_rules() -> dict[str, tuple[str, Column]]:
    """What a finished creator's record needs, its biography included."""
    url = F.coalesce(F.exists("sources", lambda s: filled(s["url"])), F.lit(False))
    return {
        "id": ("_id", filled("_id")),
        "entity": ("entity_type", col("entity_type").isin(*ENTITIES)),
        "identity": ("identity_status", col("identity_status").isin(*IDENTITIES)),
        "name_zh": ("name_zh", filled("name_zh")),
        "name_en": ("name_en", filled("name_en")),
        "aliases": ("aliases", col("aliases").isNotNull()),
        "sources": ("sources", F.size("sources") > 0),
        "authority": ("authority_ids", (F.coalesce(col("identity_status"), F.lit("")) != "verified") | _any(F.map_values("authority_ids")) | url),
        "reason": ("unresolved_reason", ~F.coalesce(col("identity_status").isin("unresolved", "conflicted"), F.lit(False)) | filled("unresolved_reason")),
        **biography_rules(),
    }


#: What a creator's names say of its kind, in this order.
ENTITY_WORDS = {"anonymous": "unknown artist|未知艺术家|anonymous", "attribution": "circle of|follower of|圈子|追随者", "workshop": "studio of|workshop of|工作室", "organization": r"imprimerie|imp\.|lith\.|publisher|publishing|press|& co\.?|出版社|印刷所|印刷公司|艺术社"}


def entity_type(*names: Column | str, candidate: Column, known: Column) -> Column:
    """A creator's kind by words of its names; candidates without an authority id stay unresolved."""
    text = F.concat_ws(" ", *[F.nullif(col(n), F.lit("")) for n in names])
    out = None
    for kind, words in ENTITY_WORDS.items():
        hit = text.rlike(f"(?i){words}")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.when(candidate & ~known, "unresolved").otherwise("person")


def identity_status(review: Column | str, entity: Column | str, known: Column) -> Column:
    """unresolved, verified (reviewed and with an authority id) or provisional."""
    open_ = (col(review) == "rejected") | col(entity).isin("anonymous", "unresolved")
    return F.when(F.coalesce(open_, F.lit(False)), "unresolved").when((col(review) == "reviewed") & known, "verified").otherwise("provisional")


def is_placeholder(x: Column | str) -> Column:
    return filled(x) & F.coalesce(col(x).rlike(PLACEHOLDER), F.lit(False))


def gaps(entity: Column, length: Column, known: Column) -> Column:
    """Names of what a creator's record lacks, in a fixed order."""
    person = entity == "person"
    positive = lambda c: F.coalesce(col(c) > 0, F.lit(False))
    missing = {
        "entity_type": ~filled("entity_type"),
        "identity_status": ~filled("identity_status"),
        "country_code": ~filled("country_code"),
        "occupations_zh": ~F.coalesce(F.size("occupations_zh") > 0, F.lit(False)),
        "bio_facts": col("bio_facts").isNull(),
        "representative_artwork_ids": col("representative_artwork_ids").isNull(),
        "bio_length": ~length.between(SHORTEST, LONGEST),
        "authority_ids": person & ~known,
        "country_placeholder": is_placeholder("country"),
        "region_placeholder": is_placeholder("region"),
        "lifespan_placeholder": is_placeholder("lifespan_text"),
        "birth_year": person & ~positive("birth_year"),
        "death_year": person & ~positive("death_year"),
    }
    return F.filter(F.array(*[F.when(lacks, name) for name, lacks in missing.items()]), lambda x: x.isNotNull())


def research_priority(review: Column, entity: Column, missing: Column) -> Column:
    """P0 for candidates and what isn't a person, P1 for gaps in the biography or placeholders, else P2."""
    urgent = (review == "candidate") | entity.isin("unresolved", "anonymous", "attribution", "workshop", "organization")
    return F.when(F.coalesce(urgent, F.lit(False)), "P0").when(F.array_contains(missing, "bio_length") | F.exists(missing, lambda g: F.endswith(g, F.lit("_placeholder"))), "P1").otherwise("P2")


def artist_audit(artists: DataFrame) -> DataFrame:
    """_id, inferred kind and identity, biography length, gaps and priority of creators' records."""
    known = _any(F.map_values("authority_ids"))
    kind = entity_type("_id", "name_zh", "name_en", F.array_join("aliases", " "), candidate=F.coalesce(col("review_status") == "candidate", F.lit(False)), known=known)
    rows = artists.withColumn("inferred_entity_type", kind).withColumn("bio_char_count", biography_length("bio_zh"))
    rows = rows.withColumn("gaps", gaps(F.col("inferred_entity_type"), F.col("bio_char_count"), known))
    return rows.select("_id", "inferred_entity_type", identity_status("review_status", "inferred_entity_type", known).alias("proposed_identity_status"), "bio_char_count", "gaps", research_priority(F.col("review_status"), F.col("inferred_entity_type"), F.col("gaps")).alias("research_priority"))


def is_visible_artist(review: Column | str = "review_status", visibility: Column | str = "public_visibility") -> Column:
    """Reviewed and not hidden."""
    return F.coalesce(F.trim(col(review)) == "reviewed", F.lit(False)) & ~F.coalesce(F.trim(col(visibility)) == "hidden", F.lit(False))


def document_summary(docs: DataFrame, key: str, images: list[str], tags: str) -> DataFrame:
    """One row: documents, repeated keys, documents without any image, and without tags."""
    bare = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in images]).isNull()
    totals = docs.agg(F.count("*").alias("total"), F.count_if(bare).alias("missing_images"), F.count_if(F.coalesce(F.size(tags), F.lit(0)) <= 0).alias("missing_tags"))
    repeated = docs.groupBy(key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_ids"))
    # one row each
    return totals.join(repeated, F.lit(True))


def has_cjk(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike(CJK), F.lit(False))


def usage_scopes(kind: Column, period_kind: Column, recommended: tuple[str, ...] = RECOMMENDED, paged: tuple[str, ...] = PAGED) -> Column:
    """What a term may be used for: search and metadata always; recommendation, filters (periods only by decade) and
    eligibility by its kind."""
    steps = [F.lit("search"), F.lit("metadata"), F.when(kind.isin(*recommended), "recommendation"), F.when(kind.isin(*paged) & ((kind != "period") | (period_kind == "decade")), "classification_filter"), F.when(kind == "rights", "eligibility")]
    return F.filter(F.array(*steps), lambda x: x.isNotNull())


def enriched_terms(terms: DataFrame, existing: Column, paged: tuple[str, ...] = PAGED) -> DataFrame:
    """Vocabulary terms in full: kind of period by the id, clean aliases, status, whether shown, uses, the creator of a
    series (``artist_id``), place (``sort_order``) and versions. Columns that a table lacks count as missing."""
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in terms.columns else F.lit("")
    place = F.coalesce(F.col("sort_order").cast("long"), F.lit(0)) if "sort_order" in terms.columns else F.lit(0).cast("long")
    period = F.when(clean("type") == "period", F.coalesce(F.nullif(clean("period_kind"), F.lit("")), F.when(clean("_id").rlike("^period-[0-9]{4}s$"), "decade"), F.lit(""))).otherwise("")
    aliases = F.array_distinct(F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != ""))
    rows = terms.select(clean("_id").alias("_id"), clean("type").alias("type"), period.alias("period_kind"), clean("label_zh").alias("label_zh"), clean("label_en").alias("label_en"), aliases.alias("aliases"), clean("parent_id").alias("parent_id"), clean("artist_id").alias("artist_id"), F.lit("reviewed").alias("review_status"), existing.alias("existing"), place.alias("sort_order"))
    shown = F.col("existing") & F.col("type").isin(*paged) & ((F.col("type") != "period") | (F.col("period_kind") == "decade"))
    return rows.withColumn("publish_status", F.when(F.col("existing"), "published").otherwise("draft")).withColumn("display_enabled", shown).withColumn("usage_scopes", usage_scopes(F.col("type"), F.col("period_kind"))).drop("existing").withColumn("taxonomy_version", F.lit(VOCABULARY_VERSION)).withColumn("target_classification_version", F.lit(CLASSIFICATION_VERSION))


def vocabulary_errors(terms: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """code, term: unknown kinds, ids without their kind's prefix, missing labels, published but not reviewed, filters for
    kinds without any, repeated ids, missing parents, and aliases of several terms (then the alias stands for the term)."""
    prefix = F.create_map(*[F.lit(v) for pair in prefixes.items() for v in pair])[F.col("type")]
    filters = F.array_contains("usage_scopes", "classification_filter")
    paged = F.col("type").isin("style", "subject") | ((F.col("type") == "period") & (F.col("period_kind") == "decade"))
    rules = {
        "unknown_type": prefix.isNotNull(),
        "invalid_id_prefix": prefix.isNull() | F.startswith("_id", prefix),
        "missing_label_zh": F.col("label_zh") != "",
        "published_not_reviewed": (F.col("publish_status") != "published") | (F.col("review_status") == "reviewed"),
        "invalid_classification_filter_scope": ~filters | paged,
    }
    own = broken(terms, "_id", {k: ("", ok) for k, ok in rules.items()}).select(F.col("rule").alias("code"), F.col("_id").alias("term"))
    twice = terms.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_term_id").alias("code"), F.col("_id").alias("term"))
    lost = terms.where("parent_id <> ''").join(terms.select(F.col("_id").alias("parent_id")).distinct(), "parent_id", "left_anti").select(F.lit("missing_parent").alias("code"), F.col("_id").alias("term"))
    names = terms.select("_id", F.explode(F.concat(F.array("label_zh", "label_en"), "aliases")).alias("name")).select("_id", F.lower(F.trim("name")).alias("name")).where("name <> ''")
    shared = names.groupBy("name").agg(F.count_distinct("_id").alias("n")).where("n > 1").select(F.lit("alias_conflict").alias("code"), F.col("name").alias("term"))
    return own.unionByName(twice).unionByName(lost).unionByName(shared)

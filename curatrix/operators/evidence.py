"""Evidence on creators from a table of entities: targets, what they refer to, and what that is called, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.sources.files import staged


def expanded(start: DataFrame, entities: DataFrame, key: str, references: list[str], depth: int = 1) -> DataFrame:
    """id, level, found: the ids that start, and those that they refer to in up to ``depth`` steps, each at its first level
    and looked up once. ``start`` has a column id; ``references`` are arrays of ids. A level joins only ids that no level
    before had; an id without an entity is not found and leads nowhere."""
    refs = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.col(r), F.array().cast("array<string>")) for r in references])))
    known = entities.groupBy(F.col(key).alias("id")).agg(F.array_distinct(F.flatten(F.collect_set(refs))).alias("__refs"))
    front = staged(start.select("id").where("id IS NOT NULL").distinct())
    out = None
    for level in range(depth + 1):
        got = staged(front.join(known, "id", "left").select("id", F.lit(level).alias("level"), F.col("__refs").isNotNull().alias("found"), "__refs"))
        out = got if out is None else out.unionByName(got)
        if level < depth:
            front = staged(got.select(F.explode("__refs").alias("id")).where("id IS NOT NULL").distinct().join(out.select("id"), "id", "left_anti"))
            if front.isEmpty():
                break
    return out.drop("__refs")


def year_check(ours: Column, theirs: Column) -> Column:
    """Whether a year agrees: always where we have none, never where only we have one."""
    return ours.isNull() | F.coalesce(ours == theirs, F.lit(False))


def evidence(targets: DataFrame, done: DataFrame, entities: DataFrame, references: list[str]) -> DataFrame:
    """For targets (_id, entity_id, birth_year, death_year) that aren't done and name an entity: its label, years and their
    agreement, and each reference list as labels in order (empty text where an id has none).

    ``entities`` has id, label, birth_year, death_year and the arrays. Two look-ups: the targets' entities, and then only
    the labels of ids that these refer to, each once."""
    open_ = targets.join(done.select("_id").distinct(), "_id", "left_anti").where("entity_id IS NOT NULL AND entity_id <> ''")
    once = entities.dropDuplicates(["id"])
    asked = open_.select(F.col("entity_id").alias("id")).distinct()
    first = staged(once.join(asked, "id", "left_semi"))
    pairs = first.select("id", F.explode(F.array(*[F.struct(F.lit(r).alias("of"), F.coalesce(F.col(r), F.array().cast("array<string>")).alias("ids")) for r in references])).alias("p")).select("id", "p.of", F.posexplode("p.ids").alias("pos", "ref"))
    names = once.join(pairs.select(F.col("ref").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("ref"), F.col("label").alias("name"))
    lists = pairs.join(names, "ref", "left").groupBy("id", "of").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", F.lit("")).alias("name")))), lambda x: x["name"]).alias("names"))
    wide = lists.groupBy("id").agg(*[F.first(F.when(F.col("of") == r, F.col("names")), ignorenulls=True).alias(r) for r in references])
    facts = first.select("id", "label", F.col("birth_year").alias("their_birth"), F.col("death_year").alias("their_death")).join(wide, "id", "left")
    rows = open_.join(facts, open_["entity_id"] == facts["id"], "left")
    return rows.select(
        "_id", "entity_id", F.coalesce("label", F.lit("")).alias("label"), "birth_year", "their_birth", year_check(F.col("birth_year"), F.col("their_birth")).alias("birth_matches"),
        "death_year", "their_death", year_check(F.col("death_year"), F.col("their_death")).alias("death_matches"), *[F.coalesce(r, F.array().cast("array<string>")).alias(r) for r in references],
    )

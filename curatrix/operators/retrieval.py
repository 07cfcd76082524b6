"""Serving: the published view, facets, sections, counts with fallback, ranked search, ordered look-ups."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.functions.text import SEPARATORS, search_text
from curatrix.sources.files import staged


def has_all(array: Column | str, wanted: list[str]) -> Column:
    """Facets: the array holds every wanted value; none wanted: always."""
    return reduce(lambda a, b: a & b, [F.array_contains(array, w) for w in wanted], F.lit(True))


def has_any(text: str, aliases: list[str]) -> Column:
    """The text holds one of the aliases, in either case."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(x.lower())) for x in aliases], F.lit(False))


def facet_or_label(df: DataFrame, value: str, ids: str, labels: str) -> DataFrame:
    """Rows matching a controlled id, or an older label; ``all`` passes everything."""
    return df if value == "all" else df.where(F.array_contains(ids, value) | F.array_contains(labels, value))


def count_with_fallback(df: DataFrame, by_id: Column, by_label: Column) -> DataFrame:
    """``n``: rows matching by id, or by label where no row matches by id; one pass for both."""
    counts = df.agg(F.count_if(by_id).alias("by_id"), F.count_if(by_label).alias("by_label"))
    return counts.select(F.when(F.col("by_id") > 0, F.col("by_id")).otherwise(F.col("by_label")).alias("n"), F.when(F.col("by_id") > 0, "id").otherwise("label").alias("matched_by"))


def rows_with_fallback(df: DataFrame, by_id: Column, by_label: Column) -> DataFrame:
    """Rows matching by id, or by label if none does. One small count decides; the rows come from one pushed scan."""
    return df.where(by_id) if not df.where(by_id).isEmpty() else df.where(by_label)


def tag_counts(df: DataFrame, tags: str) -> DataFrame:
    """tag, n: rows per tag."""
    return df.select(F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def field_score(text: Column, query: str) -> Column:
    """1 equal, .94 beginning, .88 anywhere as written, .78 anywhere without separators, 0 none; case never matters, and
    the first two are as written or without separators."""
    return _form_score(F.lower(text), search_text(text), F.lit(query.lower()), search_text(F.lit(query)))


def _form_score(raw: Column, t: Column, asked: Column, q: Column) -> Column:
    begins = F.startswith(raw, asked) | F.startswith(t, q)
    return F.when((t == "") | (q == ""), 0.0).when(t == q, 1.0).when(begins, 0.94).when(F.contains(raw, asked), 0.88).when(F.contains(t, q), 0.78).otherwise(0.0)


def ranked(df: DataFrame, variants: list[str], weights: dict[str, float]) -> DataFrame:
    """Adds ``score``: over fields, weight times the best score of the query's variants; rows without any are left out."""
    return _scored(df, variants, {c: (F.coalesce(F.col(c).cast("string"), F.lit("")), w) for c, w in weights.items()}, {})


def _scored(df: DataFrame, variants: list[str], fields: dict[str, tuple[Column, float]], plain: dict[str, Column]) -> DataFrame:
    """``ranked`` over texts with their weights; ``plain`` has ``search_text`` of those that it is known of. The variants are
    one list that a field's text goes along: written out, they outgrow what Spark compiles, and each row is then interpreted."""
    asked = F.array(*[F.struct(F.lit(v.lower()).alias("raw"), search_text(F.lit(v)).alias("plain")) for v in variants])
    parts = []
    for name, (text, weight) in fields.items():
        both = F.struct(F.lower(text).alias("raw"), plain.get(name, search_text(text)).alias("plain"))
        # one text in a list, so that its two forms are made once and not once per variant
        best = F.transform(F.array(both), lambda t: F.array_max(F.transform(asked, lambda q: _form_score(t["raw"], t["plain"], q["raw"], q["plain"]))))
        parts.append(F.lit(weight) * F.greatest(best[0], F.lit(0.0)))
    return df.withColumn("score", F.round(reduce(lambda a, b: a + b, parts), 4)).where("score > 0")


def field_text(df: DataFrame, keys: list[str]) -> Column:
    """The values of a field's columns that the table has, lists taken apart, in one text."""
    kinds = dict(df.dtypes)
    known = [F.array_join(k, " ") if kinds[k].startswith("array") else F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys if k in kinds]
    return F.concat_ws(" ", *known)


def search_corpus(df: DataFrame, key: str, fields: list[tuple[list[str], int]]) -> DataFrame:
    """What a search reads of a table, written once for many searches: the key, and per field its text, f0, f1 and so on, and
    its ``search_text``, p0, p1 and so on. It lies in as many files as tasks can run, as a small table is one file to Spark."""
    told = df.select(key, *[field_text(df, keys).alias(f"f{i}") for i, (keys, _) in enumerate(fields)])
    dealt = told.repartition(df.sparkSession.sparkContext.defaultParallelism, key)
    return staged(dealt.select("*", *[search_text(f"f{i}").alias(f"p{i}") for i in range(len(fields))]))


def searched(corpus: DataFrame, key: str, query: str, groups: list, fields: list[tuple[list[str], int]], skip: int = 0, size: int = 20) -> DataFrame:
    """key, score: a page of the best matches in a corpus, ties by key; of rows with one key the best counts."""
    variants = expanded(query, groups)
    if not variants:
        return corpus.select(key, F.lit(0.0).alias("score")).limit(0)
    found = _scored(corpus, variants, {f"f{i}": (F.col(f"f{i}"), float(w)) for i, (_, w) in enumerate(fields)}, {f"f{i}": F.col(f"p{i}") for i in range(len(fields))})
    return found.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).offset(skip).limit(size)


def plain_query(query: str) -> str:
    """``search_text`` of one query."""
    return re.sub(SEPARATORS, "", query.strip().lower())


def expanded(query: str, groups: list) -> list[str]:
    """The query and the aliases of every group of which a key contains it or is contained in it, separators aside; the
    same alias in another case isn't repeated. A group is (keys, aliases), or one list that is both."""
    low = plain_query(query)
    pairs = [g if isinstance(g, tuple) else (g, g) for g in groups]
    more = [a for keys, aliases in pairs if any(k and (k in low or low in k) for k in map(plain_query, keys)) for a in aliases]
    return list({a.strip().lower(): a for a in reversed([query.strip(), *more]) if a.strip()}.values())[::-1] if query.strip() else []


def has_all_words(text: str, words: list[str]) -> Column:
    """The text has every word; no index and no shuffle. Most texts fail at a plain search for the words' letters, and only
    the others are cut into words."""
    low = F.lower(text)
    return reduce(lambda a, b: a & b, [F.contains(low, F.lit(w.lower())) for w in words], F.lit(True)) & has_all(F.regexp_extract_all(low, F.lit("[0-9a-z]+"), F.lit(0)), [w.lower() for w in words])


def matching_all(index: DataFrame, terms: list[str], key: str = "doc_id", term: str = "term") -> DataFrame:
    """Keys of an inverted index (term, key) that have every term; only the terms' rows are read and shuffled."""
    wanted = list(dict.fromkeys(terms))
    hit = index.where(F.col(term).isin(wanted)).groupBy(key).agg(F.count_distinct(term).alias("n"))
    return hit.where(F.col("n") == len(wanted)).select(key)


def ordered_lookup(lists: DataFrame, list_key: str, ids: str, records: DataFrame, record_key: str, limit: int | None = None) -> DataFrame:
    """Records of an array of ids, in its order; ids without a record are left out; adds ``position`` from 1."""
    places = lists.select(list_key, F.posexplode(ids).alias("__pos", record_key))
    found = places.join(records, record_key)
    out = found.withColumn("position", F.row_number().over(W.partitionBy(list_key).orderBy("__pos"))).drop("__pos")
    return out.where(F.col("position") <= limit) if limit else out


def section(df: DataFrame, kind: str, value: str, columns: dict[str, str]) -> DataFrame:
    """Dispatch by section kind to the array column that holds its ids; unknown kinds read the tags."""
    return df.where(F.array_contains(columns.get(kind, columns["tag"]), value))


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; the comparison reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def pointed(asked: DataFrame, rows: DataFrame, key: str, second: str, prefix: str, hidden: Column) -> DataFrame:
    """asked, answer and the row's columns for each asked id: the row of that key, else the one whose second id is the asked
    one without the prefix (of several the smallest key). ``answer`` tells found from hidden (then without the row) and
    absent. Two joins by key, whatever the number of ids."""
    wanted = asked.select("asked").where("asked IS NOT NULL AND asked <> ''").distinct()
    told = rows.withColumn("__hidden", F.coalesce(hidden, F.lit(False)))
    whole = F.struct(*[F.col(f"`{c}`") for c in told.columns]).alias("__row")
    first = wanted.join(told.select(F.col(key).alias("asked"), whole), "asked").groupBy("asked").agg(F.min("__row").alias("__row"))
    rest = wanted.join(first, "asked", "left_anti").withColumn("__second", F.regexp_replace("asked", f"^{re.escape(prefix)}", ""))
    other = rest.join(told.select(F.col(second).alias("__second"), F.col(key).alias("__key"), whole), "__second").groupBy("asked").agg(F.min_by("__row", "__key").alias("__row"))
    found = wanted.join(first.unionByName(other), "asked", "left")
    answer = F.when(F.col("__row").isNull(), "absent").when(F.col("__row.__hidden"), "hidden").otherwise("found")
    shown = found.withColumn("answer", answer)
    return shown.select("asked", "answer", *[F.when(F.col("answer") == "found", F.col(f"__row.`{c}`")).alias(c) for c in rows.columns])


def unseen(existing: DataFrame, incoming: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """The first incoming rows whose key isn't there yet."""
    return incoming.join(existing.select(key).distinct(), key, "left_anti").orderBy(order).limit(limit)

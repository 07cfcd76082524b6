"""Plans that must hold when tables grow: what is sent out to all tasks, and what is moved."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF
from curatrix.operators import diff, enrich, fuzzy
from curatrix.operators import recommend as R
from curatrix.operators import resolve, retrieval
from curatrix.plans import governance, recommend
from curatrix.sources import files


def sent_out(df):
    """The lines of the plan that lie below broadcasts."""
    out, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at <= depth:
            depth = None
        if depth is not None:
            out.append(line)
        elif "BroadcastExchange" in line:
            depth = at
    return "\n".join(out)


@pytest.mark.parametrize("most", [resolve.SENT_OUT, -1])
def test_texts_are_not_sent_out_for_the_longest_alias(spark, monkeypatch, most):
    want = {tuple(r) for r in governance.QUERIES["longest_alias"](spark, SF).collect()}
    monkeypatch.setattr(resolve, "SENT_OUT", most)
    got = governance.QUERIES["longest_alias"](spark, SF)
    assert "part.parquet" not in sent_out(got)
    assert {tuple(r) for r in got.collect()} == want and want


def test_texts_are_not_sent_out_for_single_aliases(spark):
    got = governance.QUERIES["unique_containment"](spark, SF)
    assert "part.parquet" not in sent_out(got) and got.count()


def test_names_that_repeat_meet_once(spark, monkeypatch):
    met = []
    monkeypatch.setattr(resolve, "staged", lambda df: met.append(df) or files.staged(df))
    left = spark.range(300).select(F.col("id").alias("i"), F.concat(F.lit("name "), (F.col("id") % 3).cast("string")).alias("n"))
    right = spark.range(400).select(F.col("id").alias("j"), F.concat(F.lit("namo "), (F.col("id") % 4).cast("string")).alias("m"))
    got = resolve.similar_names(left, "i", "n", right, "j", "m").collect()
    assert {(r.i, r.n, r.j, r.m) for r in got} == {(i, f"name {i % 3}", i % 3, f"namo {i % 3}") for i in range(300)}
    assert max(df.count() for df in met) <= 28  # four letters' pairs of seven distinct names
    assert all("name" not in sent_out(df) for df in met)


def test_near_names_meet_without_pairs_of_letters(spark, monkeypatch):
    met = []
    monkeypatch.setattr(resolve, "staged", lambda df: met.append(df) or files.staged(df))
    name = lambda kind: F.format_string(f"{kind}#%09d", "id")
    left, right = spark.range(200).select("id", name("Supplier").alias("n")), spark.range(400).select(F.col("id").alias("j"), name("Supplyer").alias("m"))
    got = resolve.similar_names(left, "id", "n", right, "j", "m").collect()
    assert {(r.id, r.j, round(r.similarity, 4)) for r in got} == {(i, i, 0.9444) for i in range(200)}
    # no frame has more rows than there are names
    assert max(df.count() for df in met) <= 400


@pytest.mark.parametrize("weight", [0, 1e12])
def test_names_some_edits_apart_meet_both_ways(spark, monkeypatch, weight):
    from curatrix.functions.text import similarity

    monkeypatch.setattr(resolve, "TEXT_WEIGHT", weight)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(9)))
    left = spark.createDataFrame([(i, word()) for i in range(60)] + [(60, None)], "i int, n string")
    right = spark.createDataFrame([(j, word()) for j in range(40)] + [(40, None)], "j int, m string")
    pairs = left.where("length(n) > 0").crossJoin(right).withColumn("s", similarity("n", "m")).where("s >= 0.5").collect()
    best = {}
    for r in pairs:
        best[r.i] = min(best.get(r.i, (0, 0)), (-r.s, r.j))
    got = {r.i: (-r.similarity, r.j) for r in resolve.similar_names(left, "i", "n", right, "j", "m", 0.5).collect()}
    assert got == best and len({s for s, _ in best.values()}) > 3


def test_channels_write_no_pairs_of_creators(spark, monkeypatch):
    met = []
    monkeypatch.setattr(R, "staged", lambda df: met.append(df) or files.staged(df))
    rng = random.Random(3)
    works = [(str(i), sorted({f"a{rng.randrange(30)}" for _ in range(12)}) if i % 9 else None, [f"c{rng.randrange(4)}"], [f"t{rng.randrange(3)}", None]) for i in range(80)]
    df = spark.createDataFrame(works, "id string, artist_ids array<string>, classification_ids array<string>, recommendation_term_ids array<string>")
    patched = df.select("id", F.lit("eligible").alias("status"), F.array(F.lit("s")).alias("recommendation_signal_ids"))
    catalogue = spark.createDataFrame([("s", "S", "published")], "_id string, label_zh string, publish_status string")
    creators = spark.createDataFrame([(f"a{i}", "n", "person", "reviewed") for i in range(30)], "id string, name string, entity_type string, review_status string")
    terms = spark.createDataFrame([(f"{k}{i}", "t", "published", ["recommendation"]) for k in "ct" for i in range(4)], "_id string, label_zh string, publish_status string, usage_scopes array<string>")
    got = {r.channel_key: (r.item_count, r.creator_count, r.top_creator, r.top_count) for r in R.channels(df, patched, catalogue, creators, terms).collect()}
    want = {}
    for _, people, classes, tags in works:
        for channel in ["signal:s", *[f"artist:{a}" for a in people or []], *[f"term:{t}" for t in classes + tags if t]]:
            n, tops = want.setdefault(channel, [0, Counter()])
            want[channel][0] += 1
            tops.update(people or [])
    best = {c: min((-k, a) for a, k in tops.items()) for c, (_, tops) in want.items()}
    assert got == {c: (n, len(tops), best[c][1], -best[c][0]) for c, (n, tops) in want.items()}
    assert max(rows.count() for rows in met) <= len(works)
    parted = {tuple(r) for r in R._spread(met[0], 2).collect()}
    assert parted == {tuple(r) for r in R._spread(met[0]).collect()}


def test_rows_with_the_same_texts_are_scored_once(spark):
    docs = spark.range(60).select("id", F.concat(F.lit("red fox "), (F.col("id") % 3).cast("string")).alias("t"))
    asked = spark.createDataFrame([(1, "fox 1"), (2, "fox 1"), (3, "rod"), (4, None), (5, "")], "q long, t string")
    plain, classes = (fuzzy.Index(docs, "id", {"t": F.col("t")}, 4, classes=c) for c in (False, True))
    assert classes.postings.select("key").distinct().count() == 3
    for best in (None, 7):
        got, want = ({tuple(r) for r in fuzzy.searched(index, asked, "q", "t", {}, best).collect()} for index in (classes, plain))
        assert got == want and {r[0] for r in got} == {1, 2, 3}


@pytest.mark.parametrize("few", [100, 0])
def test_pairs_of_names_are_not_compared_again(spark, monkeypatch, few):
    monkeypatch.setattr(enrich, "FEW_ROWS", few)
    wanted = spark.createDataFrame([(1,), (2,)], "artist_id long")
    artists = spark.createDataFrame([(1, ["a", "b", ""]), (2, ["b", "b"]), (3, ["a"])], "_id long, names array<string>")
    works = spark.createDataFrame([(7, ["a", "b"]), (8, ["b", "c"]), (9, ["c", ""])], "_id long, labels array<string>")
    links = spark.createDataFrame([(1, 7, "x"), (1, 7, "y"), (2, 9, "x"), (3, 8, "x")], "artist_id long, artwork_id long, role string")
    got = enrich.evidence_context(wanted, artists, F.col("names"), works, F.col("labels"), links)
    want = [(1, 7, "relationship", "x"), (1, 7, "relationship", "y"), (2, 9, "relationship", "x"), (2, 7, "artist_label", None), (1, 8, "artist_label", None), (2, 8, "artist_label", None)]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert "LeftAnti" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ids", [1_000_000, 3])
def test_links_move_once_by_work_and_without_names(spark, monkeypatch, ids):
    monkeypatch.setattr(enrich, "FEW_IDS", ids, raising=False)
    rng = random.Random(4)
    texts = lambda: [rng.choice(["a", "b", "c", "only", "", None]) for _ in range(rng.randrange(4))]
    people = [(i % 9, [t and t.replace("only", "name") for t in texts()]) for i in range(12)]
    things = [(100 + i, [t and t.replace("only", "label") for t in texts()] if i else None) for i in range(15)]
    linked = [(rng.randrange(11), 100 + rng.randrange(20), rng.choice("xy")) for _ in range(60)]
    some = [i for i in range(10) if i % 4]
    frame = spark.createDataFrame
    got = enrich.evidence_context(frame([(i,) for i in some], "artist_id long"), frame(people, "_id long, names array<string>"), F.col("names"), frame(things, "_id long, labels array<string>"), F.col("labels"), frame(linked, "artist_id long, artwork_id long, role string"))
    want = [(a, w, "relationship", r) for a, w, r in linked if a in some]
    pairs = {(a, w) for a, names in people for w, labels in things if a in some and {*names} & {*(labels or [])} - {"", None}}
    want += [(a, w, "artist_label", None) for a, w in pairs - {(a, w) for a, w, _ in linked}]
    assert Counter(map(tuple, got.collect())) == Counter(want) and len(pairs) > 20
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("hashpartitioning(artist_id" in plan) == (ids == 3)


def test_the_report_sends_out_no_works(spark):
    got = recommend.QUERIES["recommendation_report"](spark, SF)
    assert "part.parquet" not in sent_out(got)


def test_a_build_reads_links_once_and_moves_no_names_to_tell_them_apart(spark, monkeypatch):
    read = []
    monkeypatch.setattr(R, "staged", lambda df: read.append(df._jdf.queryExecution().optimizedPlan().toString()) or files.staged(df))
    works, sources, creators, terms, catalogue, queue, written = recommend._inputs(spark, SF)
    R.built(works, sources, creators, terms, catalogue, queue, written)
    assert sum("l_suppkey" in plan for plan in read) == 1
    plan = R.work_names(files.staged(works), R.creator_names(creators), written)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_two_creators_meet_once_and_count_for_both(spark):
    works = [("1", ["f"], ["b", "a"]), ("2", [], ["b", "a", "c"]), ("3", ["f"], ["c"]), ("4", ["f"], []), ("5", [], ["c", "b"])]
    rows = R._spread(spark.createDataFrame(works, "id string, filed array<string>, creators array<string>"))
    want = {("f", 3, 3, "a", 1), ("artist:a", 2, 3, "a", 2), ("artist:b", 3, 3, "b", 3), ("artist:c", 3, 3, "c", 3)}
    assert {tuple(r)[:5] for r in rows.collect()} == want
    # a work's row begins at the creator it goes to
    assert "slice(xs" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_creators_are_added_up_where_they_are_made(spark):
    rng = random.Random(9)
    works = [(str(i), [f"c{rng.randrange(5)}"], sorted({f"a{rng.randrange(9)}" for _ in range(rng.randrange(6))})) for i in range(70)]
    works.append(("x", ["c9", None], []))
    df = spark.createDataFrame(works, "id string, filed array<string>, creators array<string>")
    want, size = {}, Counter()
    for _, filed, people in works:
        for channel in [*filter(None, filed), *[f"artist:{a}" for a in people]]:
            size[channel] += 1
            want.setdefault(channel, Counter()).update(people)
    best = {c: min(((-k, a) for a, k in tops.items()), default=(0, None)) for c, tops in want.items()}
    # a creator's works lie in several batches; some creators are parted, others whole
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        for part in (R.PART, 18):
            rows = R._spread(df, part)
            got = {r.channel: (r.item_count, r.creator_count, r.top_creator, r.top_count) for r in rows.collect()}
            assert got == {c: (size[c], len(tops), best[c][1], -best[c][0]) for c, tops in want.items()}
            moved = re.search(r"hashpartitioning\(about#\w+, x#", rows._jdf.queryExecution().executedPlan().toString())
            assert bool(moved) == (part == 18)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_names_that_no_label_touches_stay_out_of_works(spark, monkeypatch):
    creators = spark.createDataFrame([("m", ["Moreau", "Mo"]), ("k", ["Klee", "hot"]), ("l", ["Lund", None])], "id string, names array<string>")
    queue = spark.createDataFrame([("1", " Moreau the elder"), ("1", "lee"), ("2", "Klee"), ("2", "n"), ("2", "hot"), ("3", None), ("3", "Lu"), ("3", "Mo")], "work_id string, source_text string")
    names = R.creator_names(creators)
    assert {tuple(r) for r in R.near_names(names, queue).collect()} == {("m", "Moreau"), ("m", "Mo"), ("k", "Klee"), ("l", "Lund")}
    assert R.near_names(names, queue.where("work_id = '2'")).count() == 0
    works = spark.createDataFrame([("1", ["m"]), ("2", ["k", "m"]), ("3", ["l"])], "id string, artist_ids array<string>").withColumn("artist_labels", F.array().cast("array<string>"))
    catalogue = R.signal_catalogue(spark.createDataFrame([(1, "s", "x", "motif")], "place int, id string, label string, type string"))
    outcomes = []
    for few in (R.FEW_LABELS, 0):
        monkeypatch.setattr(R, "FEW_LABELS", few)
        outcomes.append(sorted((r.work_id, r.source_text or "", r.outcome) for r in R.routes(works, creators, catalogue, queue, []).collect()))
    assert outcomes[0] == outcomes[1]
    assert [o for o in outcomes[0] if o[2] != "creator"] == [("1", "lee", "unmapped_signal_label"), ("2", "n", "unmapped_signal_label"), ("3", "", "unmapped_signal_label")]


def test_ids_of_states_are_moved_once_and_not_sent_out(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    got = diff.transition(ids(1, 9, 9, None), ids(1, 2, 3, None), ids(2, 3, 4, None), "id")
    assert sorted(got.collect(), key=str) == [(2, "missing"), (3, "missing"), (9, "unexpected"), (None, "unexpected")]
    plan = governance.QUERIES["transition"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_a_search_stays_within_what_spark_compiles(spark):
    works = spark.createDataFrame([(1, "Leonardo da Vinci", "x"), (2, "a leo-nardo", "Da.Vinci"), (3, "none", None), (4, "达芬奇", "")], "id long, a string, b string")
    fields = [(["a"], 180), (["b"], 110)]
    corpus = retrieval.search_corpus(works, "id", fields)
    assert {"p0", "p1"} <= set(corpus.columns) and len(corpus.inputFiles()) > 1
    many = [f"word {i}" for i in range(200)]
    got = retrieval.searched(corpus, "id", "Leonardo", [["leonardo", "da vinci", "达·芬奇", *many]], fields)
    assert [tuple(r) for r in got.collect()] == [(2, 250.4), (4, 180.0), (1, 169.2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StartsWith") <= 8


def test_terms_are_counted_where_their_row_is(spark):
    docs = spark.createDataFrame([(1, "b a b c, B"), (2, ""), (3, None), (4, "a")], "id int, t string")
    got = fuzzy.postings(docs, "id", {"t": F.col("t")}, repeats=False)
    want = {("a", "t", 1, 1, 3), ("b", "t", 1, 3, 3), ("c", "t", 1, 1, 3), ("a", "t", 4, 1, 1)}
    assert {tuple(r) for r in got.collect()} == want and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    twice = docs.unionByName(spark.createDataFrame([(4, "a a")], "id int, t string"))
    index = fuzzy.Index(twice, "id", {"t": F.col("t")}, 2)
    assert {tuple(r) for r in index.postings.select("term", "field", "key", "tf", "length").collect()} == want - {("a", "t", 4, 1, 1)} | {("a", "t", 4, 3, 1)}
    assert [tuple(r) for r in fuzzy.Index(docs, "id", {"t": F.col("t")}, 2).fields.select("n", "field", "mean").collect()] == [(4, "t", 1.0)]


def test_lines_are_sorted_once_and_without_names_for_images(spark, tmp_path, monkeypatch):
    from curatrix.plans import transfers

    monkeypatch.setattr(transfers, "LINES", 1)
    spark.createDataFrame([(1, 1, "F"), (2, 2, "O"), (3, 3, "F"), (4, 4, "F")], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "b"), (1, "a"), (1, "a!"), (2, None), (4, "d")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    lines = [(1, 1, 9), (1, 1, 10), (1, 2, 3), (1, None, 20), (2, 2, 5), (3, 1, 5), (4, 3, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    try:
        got = transfers.QUERIES["image_upsert"](spark, str(tmp_path))
        whole = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = [(1, "detail", "a!/20"), (1, "primary", "a!/10"), (2, "detail", None), (3, "primary", "old"), (4, "detail", None), (4, "primary", "old")]
    assert sorted(map(tuple, got.collect()), key=str) == want
    # names are put to the lines' minimum, not to each line
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "min(concat" not in plan and "min(part" in plan
    # the number of tasks follows the lines
    assert ", 7), REPARTITION_BY_NUM" in whole

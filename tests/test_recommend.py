from pyspark.sql import functions as F

from curatrix.operators import recommend as R
from curatrix.operators import rollup
from curatrix.sources.control import control_table

WORKS = "id string, artist_ids array<string>, artist_labels array<string>, artist string, classification_ids array<string>, tag_ids array<string>, recommendation_term_ids array<string>"
CREATORS = "id string, name string, names array<string>, entity_type string, review_status string"
SOURCES = "id string, status string, image string, title string, description string"
TERMS = "_id string, label_zh string, usage_scopes array<string>, publish_status string"


def routes(spark, queue, works, creators=(), aliases=()):
    works = spark.createDataFrame(works, WORKS)
    names = R.creator_names(spark.createDataFrame(list(creators), CREATORS))
    catalogue = R.signal_catalogue(control_table(spark, "recommendation_signals"))
    if aliases:
        catalogue = R.with_aliases(catalogue, spark.createDataFrame(aliases, "id string, alias string"))
    rows = spark.createDataFrame(queue, "work_id string, source_text string")
    return R.routed_labels(rows, R.signal_index(catalogue), names, R.work_names(works, names, ["artist"]))


def test_catalogue_has_each_signal_once_in_order(spark):
    rows = R.signal_catalogue(control_table(spark, "recommendation_signals")).orderBy("sort_order").collect()
    assert len(rows) == 88 == len({r._id for r in rows}) == len({r.label_zh for r in rows})
    assert (rows[0].sort_order, rows[-1].sort_order) == (10, 880)
    assert {r.type for r in rows} == set(R.SIGNAL_TYPES)
    assert rows[5].description == R.SIGNAL_TYPES[rows[5].type] + "推荐信号" and not any(r.classification_filter for r in rows)


def test_labels_are_cleaned_and_names_of_creators_set_aside(spark):
    works = [
        ("a", ["m"], None, "Studio of Klee", None, None, None),
        ("b", None, ["红色调画会"], "unknown 蓝色调 master", None, None, None),
    ]
    creators = [("m", "Moreau", ["Moreau", None, " "], "person", "reviewed"), ("k", "克利", ["克利"], "person", "reviewed")]
    queue = [("a", "  红色调 "), ("a", "红色调"), ("a", "Klee"), ("a", "Moreau the elder"), ("a", "克利"), ("b", "红色调"), ("b", "蓝色调"), ("b", "twice"), ("b", "e"), ("b", None), ("b", ""), ("z", "红色调"), (None, "红色调")]
    got = routes(spark, queue, works, creators, [("signal-palette-red", "twice"), ("signal-palette-blue", "ｔｗｉｃｅ")]).collect()
    assert len(got) == len(queue)
    kinds = {(r.work_id, r.source_text): (r.outcome, r.signal_id) for r in got}
    red = ("linked", "signal-palette-red")
    assert kinds["a", "  红色调 "] == kinds["a", "红色调"] == kinds["z", "红色调"] == kinds[None, "红色调"] == red
    # held in a certain text of the work, holding a name of its creator, and any creator's whole name
    assert {kinds["a", t][0] for t in ("Klee", "Moreau the elder", "克利")} == {"creator"}
    assert kinds["b", "红色调"][0] == "creator"
    # an uncertain text names nobody; one character is too short to lie in a name
    assert kinds["b", "蓝色调"] == ("linked", "signal-palette-blue")
    assert kinds["b", "twice"] == ("ambiguous_signal_alias", None)
    assert {kinds["b", t] for t in ("e", None, "")} == {("unmapped_signal_label", None)}


def test_patches_score_every_work(spark):
    works = spark.createDataFrame([("a", ["m"], None, None, ["c"], None, None), ("b", None, None, None, None, None, ["t"]), ("c", None, None, None, None, ["t"], None), ("d", None, None, None, None, None, None)], WORKS)
    sources = spark.createDataFrame([("a", "published", "x.jpg", "T", "D"), ("b", "published", "x.jpg", " ", None), ("c", None, "", "T", None)], SOURCES)
    links = spark.createDataFrame([("a", "s2"), ("a", "s1"), ("a", "s2")], "work_id string, signal_id string")
    got = {r.id: r for r in R.patches(works, sources, links).collect()}
    assert (got["a"].recommendation_signal_ids, got["a"].reasons, got["a"].status, got["a"].quality) == (["s1", "s2"], [], "eligible", 1.0)
    assert (got["b"].reasons, got["b"].quality) == (["missing_recommendation_dimensions"], 0.45)
    assert (got["c"].reasons, got["c"].quality) == (["not_published", "missing_image"], 0.3)
    assert (got["d"].reasons, got["d"].quality, got["d"].status) == (["not_published", "missing_image", "missing_recommendation_dimensions"], 0.0, "ineligible")
    assert all(0 <= r.bucket < R.BUCKETS for r in got.values())


def build(spark, n=9):
    works = [(f"w{i}", [f"m{i % 3}"] if i else None, None, None, ["c"] if i < 4 else None, ["t"], ["t", "c", "u", "x"]) for i in range(n)]
    sources = [(f"w{i}", "published", "x.jpg", "T", "D") for i in range(n - 1)] + [("lost", "draft", None, None, None)]
    creators = [("m0", "", ["M"], "person", "reviewed"), ("m1", "Mu", ["Mu"], "workshop", "reviewed"), ("m2", "Nu", ["Nu"], "person", "candidate")]
    terms = [("c", "C", ["recommendation"], "published"), ("t", "T", ["recommendation"], "draft"), ("u", "U", ["search"], "published"), ("y", "Y", ["recommendation"], "published")]
    catalogue = R.signal_catalogue(control_table(spark, "recommendation_signals"))
    queue = spark.createDataFrame([(f"w{i}", "红色调") for i in range(n)] + [("w1", "红色调"), ("w1", "?")], "work_id string, source_text string")
    frame = spark.createDataFrame
    return R.built(frame(works, WORKS), frame(sources, SOURCES), frame(creators, CREATORS), frame(terms, TERMS), catalogue, queue, ["artist"])


def test_channels_of_every_kind(spark):
    got = {r.channel_key: r for r in build(spark).channels.collect()}
    assert len(got) == 88 + 1 + 2 and {k for k in got if k[:7] != "signal:"} == {"artist:m0", "term:c", "term:t"}
    red = got["signal:signal-palette-red"]
    # eight works may be recommended; the one without a creator counts as a work only
    assert (red.item_count, red.creator_count, red.top_creator, red.top_count, red.top_share) == (8, 3, "m1", 3, 0.375)
    assert (red.status, red.eligible, red.mode, red.priority) == ("published", True, "cross_artist", round(3.169925 * 0.8125, 4))
    empty = got["signal:signal-palette-blue"]
    assert (empty.item_count, empty.top_creator, empty.top_share, empty.status, empty.eligible, empty.priority) == (0, None, 0.0, "long_tail", False, 0.0)
    person = got["artist:m0"]
    assert (person.title, person.scope, person.mode, person.status, person.item_count) == ("m0", "m0", "artist_focus", "long_tail", 2)
    # a term that is a class of some work counts the classes alone; a draft is held back
    assert (got["term:c"].query_field, got["term:c"].item_count) == ("classification_ids", 4)
    assert (got["term:t"].query_field, got["term:t"].item_count, got["term:t"].status, got["term:t"].eligible) == ("tag_ids", 8, "candidate", False)


def test_report_counts_and_checks(spark):
    got = {(r.section, r.name): r.n for r in build(spark).report.collect()}
    assert got["labels by outcome", "linked"] == 10 and got["works by status", "ineligible"] == 1
    assert got["works by reason", "not_published"] == got["works by reason", "missing_image"] == 1
    assert got["channels by kind", "signal"] == 88 and got["channels", "eligible"] == 1
    assert sum(n for (s, _), n in got.items() if s == "works by bucket") == 9
    checks = {name: n for (s, name), n in got.items() if s == "validation"}
    assert checks == {"unmapped labels": 1, "unknown signals": 0, "repeated links": 1, "bad buckets": 0, "works without a source": 1, "sources without a work": 1}


def test_empty_tables(spark):
    frame = spark.createDataFrame
    catalogue = R.signal_catalogue(control_table(spark, "recommendation_signals"))
    made = R.built(frame([], WORKS), frame([], SOURCES), frame([], CREATORS), frame([], TERMS), catalogue, frame([], "work_id string, source_text string"), [])
    assert made.routed.count() == made.patched.count() == 0
    assert made.channels.where(F.col("item_count") == 0).count() == 88
    assert {r.n for r in made.report.where("section = 'validation'").collect()} == {0}


def test_counts_for_a_reader(spark):
    log = spark.createDataFrame([("u", "favorite", 1), ("u", "favorite", 1), ("u", "history", 2), ("u", "history", 2), ("v", None, 3)], "user string, kind string, item int")
    assert {r.user: (r.favorites, r.history, r.views) for r in rollup.library_stats(log, "user", "kind", F.col("item")).collect()} == {"u": (1, 1, 2), "v": (0, 0, 0)}
    users = spark.createDataFrame([("a", 30), ("b", 5), ("c", None), ("d", -2)], "user string, n int")
    got = {r.user: r for r in rollup.achievement_items(users, "user", F.col("n"), 20).collect()}
    assert [(got[u].current, got[u].unlocked, got[u].percent) for u in "abcd"] == [(20, True, 100.0), (5, False, 25.0), (0, False, 0.0), (0, False, 0.0)]
    assert {r.unlock_rate for r in got.values()} == {"25.00%"}
    assert rollup.achievement_items(users.limit(0), "user", F.col("n"), 20).count() == 0


def test_sections_and_review(spark):
    channels = spark.createDataFrame([("x", "red"), ("x", "red"), ("y", "blue"), ("z", "none")], "ch string, value string")
    items = spark.createDataFrame([(1, ["red", "red"]), (2, ["red", "blue"]), (3, None), (4, ["red"])], "id int, tags array<string>")
    got = rollup.channel_sections(channels, "ch", "value", items, "id", F.col("tags"), 2, "id").collect()
    assert sorted(map(tuple, got)) == [("x", 1), ("x", 2), ("y", 2)]
    reviews = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "id int, ok int")
    r = rollup.review_audit(reviews, "id", F.col("ok") == 0, F.col("ok") == 1, F.col("ok").isNull(), items).first()
    assert (r["rows"], r.ids, r.repeated, r.undecided, r.selected, r.rejected, r.missing) == (4, 2, 2, 1, 2, 1, 2)

"""Behaviour of single operators and expressions on small inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.functions import unicode as U
from curatrix.operators import diff, resolve, retrieval, rollup, select
from curatrix.sources import files, schemas
from curatrix.streaming import library


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expr(*names).alias("x")).first().x


@pytest.mark.parametrize(
    "expr,values,want",
    [
        (T.squeeze, (" a　﻿ b\n",), "a b"),
        (T.missing_as_null, ("undefined",), None),
        (T.slug, ("  A b--C! ",), "a-b-c"),
        (T.split_labels, ("a, b；a、c|",), ["a", "b", "c"]),
        (T.strip_html, ("<p>a<script>x<y</script> &amp; <b>b</b><!-- c --></p>",), "a & b"),
        (T.host, ("HTTPS://user:pw@Example.com:80/a",), "example.com"),
        (T.last_segment, ("http://x.y/a/b/?q=1",), "b"),
        (T.last_segment, ("http://x.y",), ""),
        (T.safe_url, ("http://u:p@x.y/a?b#c",), "http://x.y/a"),
        (T.earliest_decade, ("1889 or 1871, no. 123456",), "period-1870s"),
        (T.earliest_decade, ("none",), None),
        (T.cjk_grams, ("达芬奇",), ["达", "芬", "奇", "达芬", "芬奇", "达芬奇"]),
        (T.latin_prefixes, ("Cat",), ["c", "ca", "cat", "cat"]),
        (T.query_terms, ("达·芬奇",), ["达", "芬奇"]),
        (T.query_terms, ("一二三四五六七八",), ["一二三", "二三四", "三四五", "四五六", "五六七", "六七八"]),
        (T.dedupe_title, ("The Night (study)",), "night"),
        (T.dedupe_artist, ("梵高 (Vincent van Gogh, 1853-1890)",), "vincent van gogh"),
        (T.relation_role, ("After Rembrandt",), "after"),
        (T.relation_role, ("Rembrandt",), "creator"),
        (T.redacted, ("a token=abc&x",), "a token=[redacted]&x"),
        (T.licence_status, ("CC BY-NC 4.0",), "blocked"),
        (T.licence_status, (None,), "unknown"),
        (T.sentences, ("One. Two! 三。四",), ["One.", "Two!", "三。", "四"]),
        (T.stable_bucket, ("artwork_1",), 5977),
        (T.dimension, ("style-x",), "style"),
        (T.dimension, ("x",), "unknown"),
        (U.nfkc, ("ﬁ１",), "fi1"),
        (U.without_marks, ("Cézanne",), "Cezanne"),
        (U.decode_entities, ("&#x41;&eacute;&#66;",), "AéB"),
    ],
)
def test_text(spark, expr, values, want):
    assert one(spark, expr, *values) == want


def test_more_text(spark):
    assert one(spark, T.dedupe_key, "The Night", "") == ""
    assert one(spark, T.dedupe_key, "The Night", "A. B") == "a b|night"
    turner = one(spark, T.dedupe_key, "The Fighting Temeraire", "Joseph Mallord William Turner")
    assert turner == "joseph mallord william turner|fighting temeraire"
    assert one(spark, T.dedupe_key, "The Fighting Temeraire", "约瑟夫·马洛德·威廉·透纳（Joseph Mallord William Turner，1775—1851）") == turner
    assert one(spark, T.dedupe_key, "The Fighting Temeraire", "Joseph Mallord William Turner (British, 1775–1851)") == turner
    assert one(spark, T.dedupe_title, "Café") == "cafe" == one(spark, T.dedupe_title, "Cafe") and one(spark, T.dedupe_title, "La Nuit") == "la nuit"
    assert one(spark, T.dedupe_artist, "Paul Cézanne\nFrench, 1839-1906") == "paul cezanne"
    for text, status in (("Copyrighted free use", "blocked"), ("CC BY-ND 4.0", "blocked"), ("Creative Commons Zero", "open"), ("PD-old", "open"), ("https://creativecommons.org/licenses/by/4.0", "open"), ("cc by", "unknown")):
        assert one(spark, T.licence_status, text) == status
    assert one(spark, T.similarity, "kitten", "sitting") == pytest.approx(0.5714)
    assert one(spark, U.absolute_url, "../b", "http://x.y/a/c") == "http://x.y/b"
    assert one(spark, lambda x: T.attributes(x), '<a href="u" title="t" HREF="v">') == {"href": "u", "title": "t"}
    assert one(spark, lambda x: T.or_else(x, F.lit("d")), "") == "d"


def test_unlock_rate(spark):
    rows = spark.createDataFrame([(1, 3), (5, 3), (0, 0)], "n long, d long").select(T.unlock_rate(F.col("n"), F.col("d")).alias("x")).collect()
    assert [r.x for r in rows] == ["33.33%", "100.00%", "0.00%"]


def test_round_robin_and_caps(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], i) for i in range(9)], "id long, k string, p long")
    assert [r.id for r in select.round_robin(df, "k", "id", 5).orderBy("position").collect()] == [0, 1, 3, 2, 6]
    got = select.greedy_under_caps(df.withColumn("g", F.lit(1)), "g", {"k": 2}, "id").collect()
    assert sorted(r.id for r in got) == [0, 1, 2, 3]


def test_greedy_caps_against_a_loop(spark):
    import random

    random.seed(5)
    rows = [(i, random.choice(["g", "h", None]), random.choice([1, 2, None]), random.choice("abc")) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g string, x long, y string")
    want, used = [], {}
    for i, g, x, y in rows:
        keys = [(g, "x", x), (g, "y", y)]
        if used.get(keys[0], 0) < 3 and used.get(keys[1], 0) < 2:
            want.append(i)
            for k in keys:
                used[k] = used.get(k, 0) + 1
    assert sorted(r.id for r in select.greedy_under_caps(df, "g", {"x": 3, "y": 2}, "id").collect()) == want
    nulls = spark.createDataFrame([(i, None, 1) for i in range(6)] + [(9, 1.0, 1)], "id long, g double, x long")
    assert sorted(r.id for r in select.greedy_under_caps(nulls, "g", {"x": 2}, "id").collect()) == [0, 1, 9]
    assert select.greedy_under_caps(nulls.limit(0), "g", {"x": 2}, "id").count() == 0


def test_numbers_and_islands(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    assert all(r.number == r.v + 5 for r in select.numbered(df, "v", start=5).collect())
    ids = [0, 1, 2, 5, 9, 10, 11, 12, 20, 29, 30, 31, 39, 40]
    got = select.islands(spark.createDataFrame([(i,) for i in ids + [5, None]], "id long"), "id", width=10).orderBy("first").collect()
    assert [(r.first, r.last) for r in [tuple_row(x) for x in got]] == [(0, 2), (5, 5), (9, 12), (20, 20), (29, 31), (39, 40)]
    assert select.islands(spark.createDataFrame([], "id long"), "id").count() == 0


def tuple_row(r):
    class X:
        first, last = r["first"], r["last"]

    return X


def test_search_ladder(spark):
    df = spark.createDataFrame([(1, "Sun"), (2, "Sunrise"), (3, "The Sun"), (4, "Midsunday"), (5, "Moon"), (6, None)], "id long, title string")
    got = retrieval.ranked(df, ["sun"], {"title": 10.0}).orderBy(F.desc("score"), "id").collect()
    assert [(r.id, r.score) for r in got] == [(1, 10.0), (2, 9.4), (3, 8.8), (4, 8.8)]
    df = spark.createDataFrame([(1, "Old S-un"), (2, "s u n set"), (3, "Mr. Sun-rise")], "id long, title string")
    assert [(r.id, r.score) for r in retrieval.ranked(df, ["sun"], {"title": 10.0}).orderBy("id").collect()] == [(1, 7.8), (2, 9.4), (3, 8.8)]
    assert retrieval.expanded("sun", [["sunlight", "sol"], ["moon"]]) == ["sun", "sunlight", "sol"]
    assert retrieval.expanded(" s-un ", [["Sun", "SOL", "sol"]]) == ["s-un", "Sun", "SOL"]
    assert retrieval.expanded(" ", [["a"]]) == []


def test_containment_counts_only_single_ids(spark):
    index = resolve.alias_index(spark.createDataFrame([("a", ["van gogh", "Vincent"]), ("b", ["monet"])], "id string, n array<string>"), "id", F.col("n"))
    texts = spark.createDataFrame([(1, "Vincent van Gogh"), (2, "Monet after van Gogh"), (3, "nobody"), (4, None)], "k long, t string")
    assert [(r.k, r.id) for r in resolve.uniquely_contained(texts, "k", "t", index).collect()] == [(1, "a")]
    assert {(r.k, r.alias) for r in resolve.longest_contained(texts, "k", "t", index).collect()} == {(1, "van gogh"), (2, "van gogh")}


def test_containment_knows_short_aliases_and_uncertain_texts(spark):
    index = resolve.alias_index(spark.createDataFrame([("a", ["梵高", "x"]), ("b", ["莫奈作品"])], "id string, n array<string>"), "id", F.col("n"))
    texts = spark.createDataFrame([(1, "梵高的星夜"), (2, "疑似梵高"), (3, "梵高与莫奈作品"), (4, "莫奈"), (5, "Unknown, x")], "k long, t string")
    assert [(r.k, r.id) for r in resolve.uniquely_contained(texts, "k", "t", index).collect()] == [(1, "a")]
    assert {(r.k, r.alias) for r in resolve.longest_contained(texts, "k", "t", index).collect()} == {(1, "梵高"), (2, "梵高"), (3, "莫奈作品"), (5, "x")}
    assert resolve.longest_contained(texts, "k", "t", index.limit(0)).count() == 0
    assert one(spark, lambda x: U.lookup_text(x), "Cézanne, P. (1839)") == "cezannep1839"


def test_found_creator_takes_exact_then_longest(spark):
    index = resolve.alias_index(spark.createDataFrame([("vg", ["vincent van gogh", "梵高"]), ("m", ["claude monet"]), ("g", ["gogh"])], "id string, n array<string>"), "id", F.col("n"))
    texts = spark.createDataFrame([(1, "梵高 (Vincent van Gogh)"), (2, "After Claude Monet"), (3, "Monet"), (4, "Van Gogh"), (5, "nobody"), (6, None)], "k long, t string")
    got = {r.k: (r.id, r.found_by) for r in resolve.found_creator(texts, "k", "t", index).collect()}
    assert got == {1: ("vg", "exact"), 2: ("m", "contained"), 3: ("m", "contained"), 4: ("vg", "contained")}


def test_similar_names_lose_no_pair(spark):
    import itertools
    import random

    random.seed(3)
    names = ["".join(random.choice("abc") for _ in range(random.randint(5, 9))) for _ in range(60)]
    left = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, n string")
    right = spark.createDataFrame([(i, n) for i, n in enumerate(reversed(names[:40] + [n[1:] + "x" for n in names[40:]]))], "j long, m string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {}
    for (i, n), (j, m) in itertools.product(((r.i, r.n) for r in left.collect()), [(r.j, r.m) for r in right.collect()]):
        s = round(1 - distance(n, m) / max(len(n), len(m)), 4)
        if s >= 0.72 and (s, -j) > want.get(i, (0, 0)):
            want[i] = (s, -j)
    got = {r.i: (r.similarity, -r.j) for r in resolve.similar_names(left, "i", "n", right, "j", "m").collect()}
    assert got == want


def test_channel_modes(spark):
    links = spark.createDataFrame([("f", i, 1) for i in range(8)] + [("c", i, i % 4) for i in range(9)] + [("m", 1, 1), ("m", 2, 2)] + [("two", i, i % 2) for i in range(8)], "ch string, item long, who long")
    stats = rollup.channel_stats(links, "ch", "item", "who")
    got = {r.ch: r for r in rollup.channel_policy(stats).collect()}
    assert {c: (r["mode"], r.scope, r.diversity_ready, r.eligible, r.status) for c, r in got.items()} == {
        "f": ("artist_focus", 1, True, True, "published"),
        "c": ("cross_artist", None, True, True, "published"),
        "m": ("cross_artist", None, False, False, "long_tail"),
        "two": ("cross_artist", None, False, False, "published"),
    }
    assert got["c"].top_creator == 0 and got["m"].top_share == 0.5 and got["c"].top_share == 0.3333
    forced = rollup.channel_policy(stats, F.when(F.col("ch") == "two", 9)).where("ch = 'two'").first()
    assert (forced["mode"], forced.scope, forced.eligible) == ("artist_focus", 9, True)


def test_transition_and_violations(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    got = {(r.id, r.problem) for r in diff.transition(ids(1, 9), ids(1, 2, 3), ids(2, 3, 4), "id").collect()}
    assert got == {(9, "unexpected"), (2, "missing"), (3, "missing")}
    rows = spark.createDataFrame([(1, 5), (2, None)], "id long, v long")
    assert [(r.id, r.rule) for r in diff.violations(rows, "id", {"positive": F.col("v") > 0}).collect()] == [(2, "positive")]


MUTATIONS = "event_id long, user_id long, item_id string, device_id string, updated_at timestamp, deleted boolean, device_count long"


def mutations(spark, rows):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    return spark.createDataFrame([(i, u, x, dev, at(t), dele, n) for i, u, x, dev, t, dele, n in rows], MUTATIONS)


def test_library_merge_is_idempotent_and_keeps_tombstones(spark):
    rows = mutations(spark, [(1, 1, "a", "x", 5, False, 2), (2, 1, "a", "y", 5, True, 1), (3, 1, "a", "x", 4, False, 3), (4, 1, "b", "x", 1, False, None)])
    state = library.latest_state(rows)
    assert {(r.item_id, r.deleted) for r in state.collect()} == {("a", True), ("b", False)}
    again = library.merged_state(library.merged_state(state, rows), rows.where("event_id = 3"))
    assert sorted(again.collect()) == sorted(state.collect())
    assert {(r.item_id, r.total) for r in library.total_counts(library.device_counts(rows)).collect()} == {("a", 4), ("b", None)}


def test_stream_state_goes_on_after_a_restart(spark, tmp_path):
    folder, checkpoint, seen = f"{tmp_path}/in", f"{tmp_path}/checkpoint", []

    def run():
        stream = spark.readStream.schema(MUTATIONS).parquet(folder)
        library.stream_state(stream, checkpoint, lambda state: seen.append(sorted((r.user_id, r.item_id, r.deleted) for r in state.collect())))
        return seen[-1]

    mutations(spark, [(1, 1, "a", "x", 5, False, 2), (2, 1, "a", "x", 6, True, 2)]).write.mode("append").parquet(folder)
    assert run() == [(1, "a", True)]
    mutations(spark, [(3, 2, "b", "x", 1, False, 1), (4, 1, "a", "y", 3, False, 1)]).write.mode("append").parquet(folder)
    assert run() == [(1, "a", True), (2, "b", False)]
    assert run() == [(1, "a", True), (2, "b", False)]


def test_shared_folder_is_needed_off_local_mode(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        files.shared_folder(Cluster())


def test_published_tables_are_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/t"
    files.published(spark.range(3), path)
    files.published(spark.range(5), path)
    assert spark.read.parquet(files.published_path(spark, path)).count() == 5 and len(list(tmp_path.iterdir())) == 1
    assert files.optional_table(spark, path, "id long").count() == 5 and files.optional_table(spark, f"{path}-none", "id long").count() == 0


def test_monotone_clock(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = spark.createDataFrame([(1, 1, at(10)), (2, 1, at(10)), (3, 1, at(5)), (4, 1, at(30))], "id long, u long, t timestamp")
    base = library.monotone_clock(rows, ["u"], "id", "t").orderBy("id").collect()
    assert [r.logged_at - base[0].logged_at for r in base] == [0, 1, 2, 20]


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "q",\nb', ["x", "y"]), (2, None, [])], "id long, t string, tags array<string>")
    files.write_json_lines(rows, f"{tmp_path}/j")
    assert sorted(files.json_records(spark, f"{tmp_path}/j", "id long, t string, tags array<string>").collect()) == sorted(rows.collect())
    files.write_csv(rows, f"{tmp_path}/c")
    back = files.csv_records(spark, f"{tmp_path}/c", "id string, t string, tags string").orderBy("id").collect()
    assert [(r.id, r.t, r.tags) for r in back] == [("1", 'a "q",\nb', "x|y"), ("2", None, None)]
    (tmp_path / "a.json").write_text('[{"id": 1},\n {"id": 2}]')
    assert files.json_records(spark, f"{tmp_path}/a.json", "id long", array=True).count() == 2
    (tmp_path / "b.json").write_text('{"id": 1}\n{"id": oops\n')
    bad = files.json_records_with_errors(spark, f"{tmp_path}/b.json", "id long").cache()
    assert bad.where("bad_record IS NOT NULL").count() == 1
    (tmp_path / "r.csv").write_text("﻿id,title_cn,title_en,artist,location,year_and_place,medium,dimensions,description,tags\n1,a,b,c,,,,,\"x\ny\",t\n,,,,,,,,,\n", encoding="utf-8")
    got = files.csv_records(spark, f"{tmp_path}/r.csv", schemas.REVIEW_CSV).collect()
    assert len(got) == 1 and got[0].id == "1" and got[0].description == "x\ny"
    assert files.object_listing(spark, str(tmp_path), r"\.csv$").count() >= 1


def test_keyed_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, None), (3, "z")], "k long, v string")
    rows = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert files.upserted(a, b, ["k"]).where("k = 2").first().v is None
    assert rows(files.merged(a, b, ["k"])) == [(1, "x"), (2, "y"), (3, "z")]
    assert rows(files.without(a, b, ["k"])) == [(1, "x")]
    assert rows(files.inserted_if_absent(a, b, ["k"])) == [(1, "x"), (2, "y"), (3, "z")]
    assert files.repeated_keys(a.union(a.limit(1)).withColumn("id", F.when(F.col("k") < 2, F.col("k"))), "id").count() == 2
    assert rows(select.first_per_key(a.union(b.where("v IS NOT NULL")), ["k"], F.desc("v"))) == [(1, "x"), (2, "y"), (3, "z")]
    twice = b.union(spark.createDataFrame([(3, "a")], b.schema))
    assert rows(files.inserted_if_absent(a, twice, ["k"])) == [(1, "x"), (2, "y"), (3, "a")]


def test_schemas_parse(spark):
    for text in (schemas.ARTWORKS, schemas.ARTISTS, schemas.VOCABULARY, schemas.TAG_LINKS, schemas.ARTIST_LINKS, schemas.MUTATIONS, schemas.REVIEW_CSV, schemas.PAGES):
        assert spark.createDataFrame([], text).columns


def test_rules(spark):
    from curatrix.functions import rules as R

    assert one(spark, lambda x: R.first_rule(x, [("sun", "a"), ("s", "b")], "c"), "Sunny") == "a"
    assert one(spark, lambda x: R.first_rule(x, [("sun", "a")], "c"), None) == "c"
    assert one(spark, R.year_text, "circa 1871 to 1880") == "c. 1871-1880"
    assert one(spark, R.year_text, " no  date ") == "no date"
    assert one(spark, lambda x: R.known_place(x, ["somewhere.com"]), ", Somewhere.com") == "unknown"
    assert one(spark, R.clipped, "a b") == "a b." and one(spark, R.clipped, "") == ""
    assert one(spark, R.name_parts, "梵高 (Van Gogh)") == ["梵高 (Van Gogh)", "梵高", "Van Gogh"]
    assert one(spark, lambda x: R.lifespan(x)[1], "X (1853-90)") == 1890
    assert one(spark, lambda x: R.lifespan(x)[1], "X (1888-12)") == 1912
    assert one(spark, lambda x: R.lifespan(x)[1], "X (1888-)") is None
    assert one(spark, R.ratio, "30 x 0") is None and one(spark, R.ratio, "30 x 12 cm") == 2.5
    assert one(spark, R.is_pixel_size, "100 x 200 px") and not one(spark, R.is_pixel_size, "100 x 200 cm")
    assert one(spark, lambda x: R.replaced_in_order(x, [("ab", "c"), ("c", "d")]), "abc") == "dd"
    assert one(spark, lambda x: R.looked_up(x, {"a": "b"}), "z") is None


def test_short_lists_take_one_external(spark):
    from curatrix.operators import ranking

    rows = spark.createDataFrame([("o", f"f{i}", 10 - i, i, i == 4) for i in range(6)] + [("p", "f0", 1, 9, True), ("p", "g", 0, 8, False)], "o string, f string, s long, t long, ext boolean")
    got = {(r.o, r.f, r["rank"]) for r in ranking.short_lists(rows, "o", "f", "s", "t", F.col("ext")).collect()}
    assert got == {("o", "f0", 1), ("o", "f1", 2), ("o", "f4", 3), ("p", "g", 1)}
    ranked = ranking.short_lists(rows, "o", "f", "s", "t", F.col("ext"))
    chosen = {r.o: (r.selected, r.alternate) for r in ranking.decisions(ranked, "o", "f", "rank", spark.createDataFrame([("o", "f1")], "o string, override string")).collect()}
    assert chosen == {"o": ("f1", "f0"), "p": ("g", None)}

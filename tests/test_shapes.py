"""Record shapes, museum candidates, rule sets and releases on small inputs."""

from pyspark.sql import functions as F

from curatrix.functions import catalogue, media, museum, shapes, titles
from curatrix.operators import checks, release


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_shapes_clean_and_fall_back(spark):
    df = rows(spark, [(" w1 ", None, "t" * 300, [" a ", "", "b" * 120] + ["x"] * 40, -3.5, "y")], "id string, title_cn string, title string, tags array<string>, artworkCount double, kind string")
    r = shapes.shaped(df, shapes.WORK_SNAPSHOT, "kind").first()
    assert (r._id, r.id, len(r.title), r.titleCn, r.kind) == ("w1", "w1", 240, "", "y")
    assert r.tags[:2] == ["a", "b" * 100] and len(r.tags) == 30 and r.tag_keys == []
    assert shapes.shaped(df, shapes.ARTIST_SNAPSHOT).first().artworkCount == 0
    assert shapes.shaped(df, shapes.ARTIST_SNAPSHOT).first().portraitSnapshotVersion == 1
    assert shapes.shaped(df, shapes.SHOWN_ARTIST).first().styles == []
    assert shapes.shaped(df, shapes.SHOWN_WORK).first().artist == "未知艺术家"
    assert shapes.shaped(df.limit(0), shapes.PAGE_WORK).count() == 0
    assert shapes.without_keys(df, "kind", "nothing").columns == ["id", "title_cn", "title", "tags", "artworkCount"]
    assert shapes.only_fields(df, ["title", "gone", "id"]).columns == ["title", "id"]
    assert df.select(*shapes.clean_filters(df, ["id", "gone"])).first() == ("w1", "")


def test_portraits_show_only_when_approved(spark):
    df = rows(spark, [("approved", " u ", "cc"), ("pending", "u", "cc"), (None, "u", None)], "portrait_status string, portrait_url string, portraitLicense string")
    got = df.select(*shapes.portrait_fields(df).values()).collect()
    assert [(r.portraitUrl, r.portraitLicense, r.portraitStatus) for r in got] == [("u", "cc", "approved"), ("", "", "pending"), ("", "", "")]


def test_plain_numbers_and_tags(spark):
    r = rows(spark, [('{"a":{"$numberInt":"5"},"b":[{"$numberDouble": "1.5"},{"x":{"$numberLong":"7"}}]}', ["b", " a "], "a，c d")], "j string, t array<string>, x string")
    got = r.select(shapes.plain_numbers("j").alias("j"), shapes.exported_tags("t", "x").alias("t")).first()
    assert got.j == '{"a":5,"b":[1.5,{"x":7}]}' and got.t == ["b", "a", "c", "d"]


def test_same_artist_and_artworks(spark):
    pairs = [("Paul Cézanne", "Paul Cezanne (French, 1839-1906)", None, True), ("Rembrandt", "Rembrandt", "workshop of", False), ("Rembrandt", "Rembrandt", "Painter", True), ("Monet", "Manet", None, False), ("Monet", None, None, False)]
    df = rows(spark, [(a, b, q or "", w) for a, b, q, w in pairs], "a string, b string, q string, want boolean")
    assert all(r.got == r.want for r in df.select(museum.same_artist("a", "b", F.col("q")).alias("got"), "want").collect())
    kinds = rows(spark, [("Painting", "Prints"), ("Book", None), ("print", "Rare Books"), (None, "notebook"), (None, None)], "a string, b string")
    assert [r.ok for r in kinds.select(museum.is_artwork("a", "b").alias("ok")).collect()] == [True, False, False, True, True]


def test_cleveland_takes_the_first_listed_creator_who_fits(spark):
    schema = "id long, creators array<struct<description:string,qualifier:string>>, share_license_status string, print_url string, type string, department string, url string, accession_number string, title string, creation_date string, culture array<string>, current_location string, technique string, measurements string"
    base = lambda i, creators, status="CC0", image="u", kind="Painting": (i, creators, status, image, kind, None, None, f"a{i}", None, None, ["France", "19th"], " ", None, None)
    df = rows(spark, [base(1, [("X", None), ("Claude Monet (French, 1840-1926)", "artist"), ("Claude Monet", None)]), base(2, [("Claude Monet", "after")]), base(3, [("Claude Monet", "")], "other"), base(4, [("Claude Monet", None)], image=None), base(5, None), base(6, [("Claude Monet", None)], kind="Book")], schema)
    got = museum.cleveland(df, "Claude Monet").collect()
    assert [(r.source_id, r.artist, r.title, r.place, r.source_url) for r in got] == [("1", "Claude Monet (French, 1840-1926)", "暂不明确", "France, 19th", "https://www.clevelandart.org/art/a1")]
    assert got[0].classification == ["Painting"]
    filed = df.withColumn("collection", F.when(F.col("id") == 1, F.array(F.lit("MED - Modern "), F.lit(None), F.lit("Painting"), F.lit(""))))
    assert museum.cleveland(filed, "Claude Monet").first().classification == ["Painting", "MED - Modern"]


def test_addresses(spark):
    df = rows(spark, [("https://x.y/a.JPG?v=1",), ("https://x.y/a.html",), ("https://x.y/storage/v1/object/b",), (" ",), (None,)], "u string")
    assert [bool(r.m) for r in df.select(media.is_direct_media("u").alias("m")).collect()] == [True, False, True, False, False]
    assert media.search_listing("https://s", "water lilies", 2, 50) == "https://s/main/page/2/?s=water+lilies&per_page=50"
    assert media.artist_listing("https://s/artist/monet/?x=1") == "https://s/artist/monet/?per_page=20"
    names = rows(spark, [(7,), (1234,)], "n long").select(media.asset_name("n").alias("a")).collect()
    assert [r.a for r in names] == ["007_standard.jpg", "1234_standard.jpg"]


def test_titles(spark):
    df = rows(spark, [("The Wave, Pl. 12 No 3", "Circle of Hokusai (1760)", ["x"]), ("1", "(a)", None), (None, None, ["Study"])], "t string, a string, g array<string>")
    got = df.select(titles.series_title("t").alias("t"), titles.series_artist("a").alias("a"), titles.is_derivative("t", "a", "g").alias("d")).collect()
    assert [(r.t, r.a, r.d) for r in got] == [("the wave", "hokusai", True), ("", "unknown", False), (None, "unknown", True)]
    letters = {"世": "shi", "纪": "ji", "莫": "mo", "奈": "nai"}
    slug = rows(spark, [("19世纪 莫奈 Monet",), ("A莫b",), ("—",), (None,)], "x string").select(titles.transliterated("x", letters).alias("s")).collect()
    assert [r.s for r in slug] == ["19shi-ji-mo-nai-monet", "a-mo-b", "", ""]
    assert rows(spark, [("style",), ("mood",)], "k string").select(titles.id_prefix_fields("k", titles.TERM_FIELDS).alias("f")).collect() == [("style_ids",), ("",)]


def test_audit_of_an_unknown_and_a_finished_creator(spark):
    schema = "_id string, name_zh string, name_en string, aliases array<string>, review_status string, authority_ids map<string,string>, bio_zh string, entity_type string, identity_status string, country_code string, occupations_zh array<string>, bio_facts struct<lifespan:string>, representative_artwork_ids array<string>, country string, region string, lifespan_text string, birth_year int, death_year int"
    done = ("a", "甲", "A", ["x"], "reviewed", {"wikidata": "Q1"}, "字 " * 250, "person", "verified", "fr", ["画家"], ("y",), ["w"], "法国", "欧洲", "1", 1800, 1850)
    poor = ("b", None, "Unknown artist", None, "candidate", None, None, None, None, None, None, None, None, "待补充", None, None, None, None)
    got = {r._id: r for r in checks.artist_audit(rows(spark, [done, poor], schema)).collect()}
    assert (got["a"].inferred_entity_type, got["a"].proposed_identity_status, got["a"].bio_char_count, got["a"].gaps, got["a"].research_priority) == ("person", "verified", 250, [], "P2")
    assert got["b"].inferred_entity_type == "anonymous" and got["b"].proposed_identity_status == "unresolved" and got["b"].research_priority == "P0"
    assert got["b"].gaps == ["entity_type", "identity_status", "country_code", "occupations_zh", "bio_facts", "representative_artwork_ids", "bio_length", "country_placeholder"]


def test_vocabulary_errors_name_every_rule(spark):
    schema = "_id string, type string, period_kind string, label_zh string, label_en string, aliases array<string>, parent_id string"
    terms = rows(spark, [("style-a", "style", "", "甲", "A", ["x"], ""), ("style-a", "style", "", "乙", "B", [], "style-z"), ("mood-b", "mood", "", "", "", [], ""), ("wrong", "subject", "", "丙", "", [" X "], ""), ("period-1850s", "period", None, "1850s", "", [], None)], schema)
    full = checks.enriched_terms(terms, F.lit(True)).withColumn("review_status", F.when(F.col("_id") == "wrong", "candidate").otherwise("reviewed"))
    shown = {r._id: (r.display_enabled, r.usage_scopes) for r in full.where("type <> 'style'").collect()}
    assert shown["period-1850s"] == (True, ["search", "metadata", "recommendation", "classification_filter"]) and shown["mood-b"] == (False, ["search", "metadata"])
    got = {(r.code, r.term) for r in checks.vocabulary_errors(full, catalogue.PREFIXES).collect()}
    assert got == {("unknown_type", "mood-b"), ("missing_label_zh", "mood-b"), ("invalid_id_prefix", "wrong"), ("published_not_reviewed", "wrong"), ("duplicate_term_id", "style-a"), ("missing_parent", "style-a"), ("alias_conflict", "x")}


def test_accounts_and_visibility(spark):
    metrics = rows(spark, [(1, 1, 0, 0), (2, 0, None, 60)], "user_id long, favorite_unique_count long, followed_artist_unique_count long, history_unique_count long")
    owned = release.owned_achievements(metrics, rows(spark, [(1, "first_masterpiece"), (1, "gone"), (9, "ordinary_user")], "user_id long, achievement_id string"))
    assert {(r.user_id, r.achievement_id, r.is_new) for r in owned.collect()} == {(1, "first_masterpiece", False), (1, "ordinary_user", True), (2, "ordinary_user", True), (2, "art_wanderer", True)}
    users = rows(spark, [(1, True, "first_masterpiece", 1), (2, True, "first_masterpiece", 1), (3, None, None, 1)], "user_id long, registered boolean, equipped_title_id string, schema_version int")
    assert {(r.user_id, r.equipped_title_id) for r in release.account_updates(users, owned, 1).collect()} == {(2, "ordinary_user"), (3, "ordinary_user")}
    assert catalogue.achievement(" art_wanderer ")[2] == "history_unique_count" and catalogue.achievement(None) is None
    seen = rows(spark, [("reviewed", None), ("reviewed ", "hidden"), ("candidate", None), (None, None)], "review_status string, public_visibility string")
    assert [r.v for r in seen.select(checks.is_visible_artist().alias("v")).collect()] == [True, False, False, False]
    works, patches = rows(spark, [(1, "a"), (2, "b")], "id long, v string"), rows(spark, [(1, "c", 0)], "id long, v string, previous int")
    assert [tuple(r) for r in release.released_works(works.where("id = 1"), patches, "id", "v1").collect()] == [(1, "c", "v1")]
    assert [r.id for r in release.unpatched(works, patches, "id").collect()] == [2]


def test_mutations_are_checked(spark):
    import datetime

    from curatrix.streaming import library

    at = datetime.datetime(2024, 1, 1)
    rows_ = [("dev_abcdefgh", " i ", at, None, 5), ("dev_short", "i", at, True, -1), ("dev_abcdefgh", "a\tb", at, False, 10**9), ("dev_abcdefgh", "i", None, False, None), (None, "i", at, False, 1), ("dev_abcdefgh", "x" * 300, at, False, 1)]
    got = library.checked_mutations(rows(spark, rows_, "device_id string, item_id string, updated_at timestamp, deleted boolean, device_count long"), F.lit(at)).collect()
    assert [r.problem for r in got] == [None, "device", "item", "time", "device", None]
    assert (got[0].item_id, got[0].deleted, got[1].device_count, got[2].device_count, len(got[5].item_id)) == ("i", False, 0, 1_000_000, 180)


def test_compacted_state_is_the_same(spark, tmp_path):
    from curatrix.streaming import library

    state = "user_id long, item_id string, updated_at timestamp, deleted boolean, event_id long"
    for k in range(3):
        rows(spark, [(1, "a", None, False, k), (k, "b", None, True, k)], state).write.parquet(f"{tmp_path}/c/state/batch-{k}")
    before = sorted(map(str, library.stored_state(spark, f"{tmp_path}/c").collect()))
    library.compacted(spark, f"{tmp_path}/c")
    assert sorted(map(str, library.stored_state(spark, f"{tmp_path}/c").collect())) == before
    assert len(list((tmp_path / "c" / "state").iterdir())) == 1


def test_one_key_reaches_the_scan(spark):
    from curatrix.operators import retrieval

    found = retrieval.by_key(spark.read.parquet("/root/testdata/sf0.001/part.parquet"), "p_partkey", 42)
    assert "PushedFilters: [IsNotNull(p_partkey), EqualTo(p_partkey,42)]" in found._jdf.queryExecution().executedPlan().toString()


def test_words_and_terms_need_no_shuffle(spark):
    from curatrix.plans import serving

    for name in ("search_and", "search_terms", "licence_status"):
        plans = serving.QUERIES
        if name in plans:
            assert "Exchange" not in plans[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()

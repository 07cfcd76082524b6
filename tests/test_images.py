from curatrix.operators import images

FILES = "id string, bytes long, hash string"


def test_files_are_hashed_where_they_lie(spark, tmp_path):
    import hashlib

    (tmp_path / "deep").mkdir()
    (tmp_path / "1_standard.jpg").write_bytes(b"one")
    (tmp_path / "deep" / "2.a.jpg").write_bytes(b"\xff\x00")
    (tmp_path / "empty.jpg").write_bytes(b"")
    (tmp_path / "3.txt").write_bytes(b"no image")
    got = {r.id: (r.bytes, r.hash) for r in images.hashed_files(spark, str(tmp_path), "*.jpg").collect()}
    assert got == {"1_standard": (3, hashlib.sha256(b"one").hexdigest()), "2.a": (2, hashlib.sha256(b"\xff\x00").hexdigest())}


def test_three_sources_are_compared(spark):
    f = spark.createDataFrame
    rows = f([("a", "w"), ("b", "w"), ("c", "x"), ("d", None), ("e", "lost")], "id string, work_id string")
    works = f([("w", "u1"), ("w", "u2"), ("x", "u3"), (None, "u1")], "id string, source_url string")
    stored = f([("a", 1, "h1"), ("b", 2, "h2"), ("c", 3, "h3"), ("c", 4, "h4"), ("d", 5, None)], FILES)
    local = f([("a", 1, "h1"), ("b", 9, "h9"), ("d", 5, None), (None, 1, "h1")], FILES)
    expected = f([("u1", 1, "h1"), ("u3", 3, "h3")], "source_url string, bytes long, hash string")
    matched = images.matched_images(rows, works, stored, local, expected)
    got = {r.id: tuple(r)[1:] for r in matched.collect()}
    assert got["a"] == ("w", "u1", 1, 1, 1, True, True, True)
    assert got["b"] == ("w", "u1", 2, 9, 1, False, False, False)
    assert got["c"] == ("x", "u3", 3, None, 3, False, True, False)
    # unknown hashes match nothing, and a work or source that isn't there is no fault of the image
    assert got["d"] == (None, None, 5, 5, None, False, False, False)
    assert got["e"] == ("lost", None, None, None, None, False, False, False) and len(got) == 5
    assert tuple(images.match_summary(matched).first()) == (5, 1, 2, 1, 1, 2, 2)
    assert tuple(images.match_summary(matched.limit(0)).first()) == (0,) * 7

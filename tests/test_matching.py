"""Choice under caps in rounds, against the loop."""

import random

import pytest

from curatrix.operators import matching


def loop(rows, caps):
    used, out, done = {}, set(), set()
    for q, place, *keys in sorted(rows, key=lambda r: (r[0], r[1])):
        if q not in done and all(used.get((i, k), 0) < caps[i] for i, k in enumerate(keys)):
            done.add(q)
            out.add((q, place))
            for i, k in enumerate(keys):
                used[i, k] = used.get((i, k), 0) + 1
    return out


def run(spark, rows, caps, few):
    df = spark.createDataFrame(rows, "q long, place long, item string, artist string, series string")
    got, rounds = matching.taken_in_turn(df, "q", ["place"], {n: ([n], c) for n, c in zip(("item", "artist", "series"), caps, strict=True)}, few)
    return {(r.q, r.place) for r in got.collect()}, rounds, got


@pytest.mark.parametrize("seed", [1, 2])
def test_random_queries_take_logarithmic_rounds(spark, seed):
    rng = random.Random(seed)
    rows = [(q, k, str(rng.randrange(900)), str(rng.randrange(150)), rng.choice([None, *map(str, range(60))])) for q in range(600) for k in range(4)]
    got, rounds, _ = run(spark, rows, (1, 4, 9), 0)
    assert got == loop(rows, (1, 4, 9)) and len(got) < 600
    assert rounds <= 16


def test_chains_end_in_one_task(spark):
    # each query's second choice is the next one's first
    rows = [(q, 0, str(max(q - 1, 0)), None, None) for q in range(14)] + [(q, 1, str(q), None, None) for q in range(14)]
    want = loop(rows, (1, 99, 99))
    got, long, out = run(spark, rows, (1, 99, 99), 0)
    assert got == want and long > 6  # a round per link
    got, short, _ = run(spark, rows, (1, 99, 99), 20)
    assert got == want and short < long
    assert out.columns == ["q", "place", "item", "artist", "series"]


def test_nothing_to_take(spark):
    assert run(spark, [(1, 1, "a", "b", None), (2, 1, "a", "b", None)], (1, 0, 5), 100)[0] == set()
    got, rounds, _ = run(spark, [], (1, 1, 1), 10)
    assert got == set() and rounds == 0


def test_keys_that_all_want_take_few_rounds(spark):
    # three may take "t" or, after that, "s"; looked at all at once, a round decides no more than these
    rows = [(q, k, f"{q % 7}-{k}", str(k), "s" if k else "t") for q in range(60) for k in range(5)]
    got, rounds, _ = run(spark, rows, (5, 1, 3), 100)
    assert got == loop(rows, (5, 1, 3)) and rounds <= 2

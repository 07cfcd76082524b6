"""Rule tables against loops, by automaton and by keys."""

import random

import pytest

from curatrix.operators import rule_tables


def meets(text, kind, anchor):
    return {"equals": text == anchor, "prefix": text.startswith(anchor), "suffix": text.endswith(anchor), "contains": anchor in text}[kind]


@pytest.mark.parametrize("sent", [rule_tables.SENT, 0], ids=["automaton", "keys"])
def test_the_first_rule_by_rank_wins(spark, sent):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abé漢", k=n))
    rules = [(r, rng.choice(rule_tables.KINDS), word(rng.randint(1, 4)), f"r{r % 5}", f"t{r}") for r in rng.sample(range(1000), 300)] + [(2000, "contains", "", "never", "x"), (2001, "equals", " ‘Zed’  Q", "quoted", "z")]
    texts = [word(rng.randint(0, 9)) for _ in range(150)] + [None, "", "zed\nq", "ＺＥＤ Q", "xyz", "xyz"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, `te.xt` string, text string")
    got = rule_tables.first_rules(df, "te.xt", spark.createDataFrame(rules, rule_tables.RULES), sent)
    assert got.columns == ["id", "te.xt", "text", "rank", "route", "target"]
    plain = {"zed\nq": "zed q", "ＺＥＤ Q": "zed q", None: ""}
    for r in got.collect():
        text = plain.get(r["te.xt"], r["te.xt"])
        met = [x for x in sorted(rules) if x[2] and meets(text, x[1], "zed q" if x[0] == 2001 else x[2])]
        assert (r.rank, r.route, r.target) == ((met[0][0], met[0][3], met[0][4]) if met else (None, None, None))
    assert got.count() == len(texts)
    assert rule_tables.first_rules(df, "te.xt", spark.createDataFrame([], rule_tables.RULES), sent).where("rank IS NULL").count() == len(texts)
    assert rule_tables.first_rules(df.limit(0), "te.xt", spark.createDataFrame(rules, rule_tables.RULES), sent).count() == 0


def test_the_plan_does_not_grow_with_the_rules(spark):
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    size = lambda n: len(rule_tables.first_rules(df, "t", spark.createDataFrame([(i, "contains", f"w{i}", "r", "t") for i in range(n)], rule_tables.RULES))._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(1) == size(300)


def test_routes_are_counted_with_spellings_and_samples(spark):
    rules = spark.createDataFrame([(1, "equals", "monet", "artist", ""), (2, "contains", "花", "current", "subject-flowers"), (3, "suffix", "主义", "style", "")], rule_tables.RULES)
    labels = [(1, "Monet"), (2, "monet"), (3, "monet"), (3, "monet"), (1, "花园"), (1, "花卉"), (2, "花卉"), (4, "印象主义"), (5, "misc"), (5, None), (5, " ")] + [(i, "many") for i in range(30)]
    got = {(r.route, r.key): (r.label, r.n_items, r.n_labels, r.sample) for r in rule_tables.analysis(spark.createDataFrame(labels, "w long, l string"), "w", "l", rules).collect()}
    assert got == {
        ("artist", "monet"): ("monet", 3, 2, [1, 2, 3]),
        ("current", "subject-flowers"): ("花卉", 2, 2, [1, 2]),
        ("style", "印象主义"): ("印象主义", 1, 1, [4]),
        ("unclassified", "misc"): ("misc", 1, 1, [5]),
        ("unclassified", "many"): ("many", 30, 1, list(range(10))),
    }

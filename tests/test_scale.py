"""Rows that a plan makes on the way, where many rows share a value."""

import pytest

from lodestone.functions import geo
from lodestone.operators import matchers
from lodestone.schema import TABLES


@pytest.fixture
def run(spark):
    """Rows of a table, and the most rows that a node of its plan gave, of a kind if one is named."""

    def most(node, kind):
        metric = node.metrics().get("numOutputRows")
        children = node.children()
        own = metric.get().value() if metric.isDefined() and kind in node.nodeName() else 0
        return max([own, *[most(children.apply(i), kind) for i in range(children.size())]])

    def do(df, kind=""):
        return [tuple(r) for r in df.collect()], most(df._jdf.queryExecution().executedPlan(), kind)

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a plan whose nodes are all in one tree
    yield do
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.fixture
def table(spark):
    return lambda name, rows: spark.createDataFrame(rows, TABLES[name].ddl)


def people(table, n, name=lambda k: "Jane Doe"):
    return table("entry", [(k, 1, f"x{k}", "", name(k), "", None, None, None, "Q5") for k in range(n)])


def test_claims_and_namesakes_do_not_multiply_in_full_dates(run, table):
    n = 300
    lives = table("person_dates", [(k, "1900-01-01", "1980", "1900", "1980") for k in range(n)])
    claims = [(q, p, f"{y}-01-{k % 28 + 1:02d} {k}") for q in (7, 8) for k in range(n) for p, y in ((569, 1900), (570, 1980 + q % 2))]
    terms = table("kb_terms", [("Jane Doe", 7, "en"), ("Jane Doe", 8, "de"), ("Jane Doe", 8, "en")])
    got, most = run(matchers.by_full_dates(people(table, n), lives, terms, table("kb_claims", claims)))
    assert sorted(got) == [(k, [8]) for k in range(n)]
    assert most <= 4 * n  # 600 claims of each year; n * n before


def test_namesakes_and_equal_labels_do_not_multiply_in_containment(run, table, spark):
    n = 300
    rows = people(table, n, lambda k: "Old Gear" if k == 5 else "Hot Bolt")
    labels = [(k, "the hot bolt") for k in range(n)] + [(n, "gear"), (n + 1, "an old gear"), (n + 1, "OLD"), (n + 2, "old gears"), (n + 2, "bolt"), (n + 3, "")]
    got, most = run(matchers.by_containment(rows, spark.createDataFrame(labels, "q long, label string")))
    assert sorted(got) == [(5, n), (5, n + 1)]
    assert most <= 4 * n  # n * n before


def test_containment_finds_what_brute_force_finds_and_broadcasts_no_side(run, table, spark, tmp_path):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abä\U0001f600 ") for _ in range(rng.choice([1, 2, 3, 4, 7, 8, 9, 15, 16, 17])))
    names = [word() + rng.choice(["", f" {k}"]) for k in range(120)]
    labels = [(k, rng.choice([word(), names[k] + "a", "the " + names[k].upper(), names[k][1:]])) for k in range(120)]
    want = []
    for q, label in labels:
        hits = {k for k, name in enumerate(names) if label and (label.lower() in name or name in label.lower())}
        want += [(k, q) for k in hits if len(hits) == 1]
    people(table, len(names), lambda k: names[k]).write.parquet(f"{tmp_path}/entry")
    spark.createDataFrame(labels, "q long, label string").write.parquet(f"{tmp_path}/labels")
    found = matchers.by_containment(spark.read.parquet(f"{tmp_path}/entry"), spark.read.parquet(f"{tmp_path}/labels"))
    assert sorted(run(found)[0]) == sorted(want) and len(want) > 10
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()  # all joins were, by the size of files


@pytest.mark.parametrize("block", [1024, 7])
def test_points_of_a_spot_are_paired_last(run, spark, monkeypatch, block):
    monkeypatch.setattr(geo, "BLOCK", block, raising=False)
    n = 60
    at = [(k, 10.0, 20.0) for k in range(n)] + [(n, 10.0, 20.01), (n + 1, 50.0, 20.0), (n + 2, None, 20.0)]
    df = spark.createDataFrame(at, "id long, lat double, lon double")
    got, most = run(geo.within(df, df.withColumnRenamed("id", "other_id"), 2_000.0), "Join")
    near = range(n + 1)
    assert sorted((a, b) for a, b, _ in got) == sorted([(a, b) for a in near for b in near] + [(n + 1, n + 1)])
    assert {(a, b): round(m) for a, b, m in got}[(0, n)] == 1095
    assert most < n * n  # pairs of blocks

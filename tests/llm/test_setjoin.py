import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from echofold.llm.setjoin import light_boundary, need, prefix_length, similar_records

SCHEMA = "unit_id long, lang string, fps array<long>, similarity double, sig string"


def brute(rows, theta):
    out = set()
    for (a, la, fa, *_), (b, lb, fb, *_) in combinations(sorted(rows), 2):
        if la is not None and la == lb and fa and fb and len(set(fa) & set(fb)) / len(set(fa) | set(fb)) >= theta:
            out.add((a, b))
    return out


def collection(seed, n=140, hot=4):
    rng = random.Random(seed)
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.6:
            s = set(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                if rng.random() < 0.5 and len(s) > 1:
                    s.remove(rng.choice(sorted(s)))
                else:
                    s.add(rng.randint(-5000, 5000))
        else:
            s = {rng.randint(-5000, 5000) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 16, 30, 60]))} | set(rng.sample(range(hot), rng.randint(0, hot)))
        base.append(s)
        rows.append((i, rng.choice(["a", "b", "b", "b", None]), sorted(s), 0.5, "x"))
    return rows


@pytest.mark.parametrize("theta,k", [(0.8, 2), (0.6, 2), (0.8, 1), (0.5, 3)])
def test_equals_brute_force(spark, theta, k):
    rows = collection(seed=int(theta * 10) + k)
    got = similar_records(spark.createDataFrame(rows, SCHEMA), id="unit_id", group="lang", values="fps", theta=theta, k=k)
    pairs = [(r.a, r.b) for r in got.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute(rows, theta)


@pytest.mark.parametrize("boundary", [0, 6, 20, 1000])
def test_every_boundary_gives_the_same(spark, monkeypatch, boundary):
    import echofold.llm.setjoin as m

    monkeypatch.setattr(m, "light_boundary", lambda *a: boundary)
    rows = collection(seed=9)
    got = similar_records(spark.createDataFrame(rows, SCHEMA), id="unit_id", group="lang", values="fps", theta=0.8)
    assert {(r.a, r.b) for r in got.collect()} == brute(rows, 0.8)


def test_hot_group_of_copies_and_nulls(spark):
    rows = [(i, "a", [1, 2, 3, 4, 5], None, None) for i in range(30)] + [(100, None, [1, 2, 3, 4, 5], 0.1, "x"), (101, "a", [], 0.1, "x"), (102, "a", None, 0.1, "x"), (103, "a", [1, 2, 3, 4], 0.1, "x"), (None, "a", [1, 2, 3, 4], 0.1, "x")]
    got = {(r.a, r.b) for r in similar_records(spark.createDataFrame(rows, SCHEMA), id="unit_id", group="lang", values="fps").collect()}
    assert got == set(combinations(range(30), 2)) | {(i, 103) for i in range(30)}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert similar_records(df, id="unit_id", group="lang", values="fps").count() == 0
    assert similar_records(df.withColumn("lang", F.lit("a")), id="unit_id", group="lang", values="fps").columns == ["a", "b", "similarity"]


def test_bounds():
    assert need(5, 0.8) == 4 and need(10, 0.8) == 8 and need(1, 0.8) == 1
    assert prefix_length(10, 0.8, 2) == 4 and prefix_length(1, 0.8, 2) == 1
    # many subsets are worse than short lists, long lists are worse than few subsets
    assert light_boundary([(200, 10)], 1.0, 0.8, 2) == 0
    assert light_boundary([(8, 1000)], 500.0, 0.8, 2) == 8


def test_classes_are_expanded_in_blocks(spark, monkeypatch):
    """Large classes, by themselves and next to each other, come out pair by pair whatever the blocks are."""
    import echofold.llm.setjoin as m

    monkeypatch.setattr(m, "BLOCK", 4)
    rows = [(i, "a", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], None, None) for i in range(0, 60, 2)] + [(i, "a", [1, 2, 3, 4, 5, 6, 7, 8, 9], None, None) for i in range(1, 40, 2)] + [(99, "a", [1, 2, 3, 4, 5, 6, 7, 8, 9, 11], None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.a, r.b) for r in similar_records(df, id="unit_id", group="lang", values="fps", theta=0.8).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.8)
    links, members = m.similar_record_classes(df, id="unit_id", group="lang", values="fps", theta=0.8)
    assert {(r.a, r.b) for r in links.collect()} == {(0, 1), (0, 99), (1, 99)} and {(r.id, r.rep) for r in members.collect()} == {(i, 0 if i in range(0, 60, 2) else 1 if i in range(1, 40, 2) else 99) for i, *_ in rows}

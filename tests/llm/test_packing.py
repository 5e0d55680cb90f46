import random
from collections import defaultdict

from echofold.llm.packing import best_fit, packed


def test_best_fit_takes_the_tightest_compatible():
    assert best_fit([(6, 1, -1), (7, 1, -1), (3, 1, -1)], 10) == [(0, 0), (1, 0), (1, 7)]
    # the tightest holds the same cluster: the next one is taken, or a new one opened
    assert best_fit([(6, 1, -1), (7, 1, 0), (3, 1, 0), (3, 1, 0)], 10) == [(0, 0), (1, 0), (0, 6), (2, 0)]
    assert best_fit([(5, 1, -1), (5, 2, -1), (5, 1, -1)], 10, {1: 2, 2: 1}) == [(0, 0), (1, 0), (0, 5)]


def check(rows, items, capacity):
    size = {i: s for i, s, *_ in items}
    seen, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        if r.container is None:
            assert r.size == 0 and r.place is None and r.start is None and not size[r.id]
            continue
        seen[r.id] += r.size
        bins[r.container].append(r)
        if size[r.id] <= capacity:
            assert r.size == size[r.id] and r.piece == 0
    assert all(seen[i] == (s or 0) for i, s in size.items())
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.place):
            assert r.start == at
            at += r.size
        assert at <= capacity
    return bins


def test_packs_whole_and_tight(spark):
    rng = random.Random(1)
    items = [(i, rng.choice([0, None, 1, 5, 40, 77, 100, 101, 250, rng.randint(1, 99)]), rng.choice("abc"), rng.choice([None, "c1", f"u{i}", f"p{i // 2}"])) for i in range(600)]
    df = spark.createDataFrame(items, "doc_id long, n int, source string, cluster string").withColumnRenamed("cluster", "piece")
    rows = packed(df, id="doc_id", size="n", source="source", cluster="piece", capacity=100, apart=[{"a", "b"}], group_items=200).collect()
    bins = check(rows, items, 100)
    cluster, source = {i: c for i, _, _, c in items}, {i: s for i, _, s, _ in items}
    for b in bins.values():
        named = [cluster[r.id] for r in b if cluster[r.id]]
        assert len(named) == len(set(named))
        assert not {"a", "b"} <= {source[r.id] for r in b}
    again = packed(df.repartition(7), id="doc_id", size="n", source="source", cluster="piece", capacity=100, apart=[{"a", "b"}], group_items=200).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_little_room_unused(spark):
    rng = random.Random(2)
    items = [(i, rng.randint(1, 2000), "a", None) for i in range(2000)]
    rows = packed(spark.createDataFrame(items, "d long, n int, s string, c string"), id="d", size="n", source="s", cluster="c").collect()
    bins = check(rows, items, 4096)
    assert sum(s for _, s, *_ in items) / (4096 * len(bins)) > 0.97


def test_empty(spark):
    assert packed(spark.createDataFrame([], "d long, n int, s string, c string"), id="d", size="n", source="s", cluster="c").collect() == []


def test_null_and_huge_ids(spark):
    big = 2**62 + 1
    rows = packed(spark.createDataFrame([(None, 5, None, None), (big, 7, "a", "c"), (None, 0, None, None)], "piece long, n int, s string, container string"), id="piece", size="n", source="s", cluster="container", capacity=10).collect()
    assert sorted((r.id or 0, r.size, r.container is None) for r in rows) == [(0, 0, True), (0, 5, False), (big, 7, False)]


def test_a_text_of_many_pieces_is_spread(spark):
    """Groups are counted in pieces: one long item doesn't fill a group beyond its bound."""
    rows = packed(spark.createDataFrame([(1, 10_005, "a", None), (2, 3, "a", None)], "d long, n int, s string, c string"), id="d", size="n", source="s", cluster="c", capacity=10, group_items=100).collect()
    check(rows, [(1, 10_005), (2, 3)], 10)
    assert len({r.container >> 32 for r in rows}) > 5

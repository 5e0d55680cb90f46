import random

import numpy as np
import pytest

from echofold.llm.batches import History, cut, judge_batches, lost_chunks


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute(units, theta, first=0):
    accepted = {i: s for i, n, s in units if n == first and s}
    out = {}
    for n in sorted({n for _, n, _ in units if n is not None and n > first}):
        fresh = {}
        for i, m, s in units:
            if m == n and s:
                best = max(((jaccard(s, t), -j) for j, t in accepted.items()), default=(0, 0))
                if best[0] >= theta:
                    out[i] = -best[1]
                else:
                    fresh[i] = s
        accepted |= fresh
    return out


@pytest.mark.parametrize("seed,theta", [(1, 0.85), (2, 0.85), (3, 0.6)])
def test_equals_brute_force(spark, seed, theta):
    rng = random.Random(seed)
    units = []
    for i in range(260):
        if units and rng.random() < 0.7:
            s = set(rng.choice(units)[2])
            for _ in range(rng.randint(0, 3)):
                s.symmetric_difference_update({rng.choice([rng.randint(0, 10**6), rng.choice(sorted(s)) if s else 1])})
        else:
            s = {rng.randint(0, 10**6) for _ in range(rng.choice([1, 3, 7, 20, 45]))} | {1, 2, 3}
        units.append((i, rng.randint(0, 4), s))
    df = spark.createDataFrame([(i, n, sorted(s), 0.0) for i, n, s in units] + [(900, None, [1], 0.0), (901, 2, [], 0.0), (902, 2, None, 0.0), (None, 2, [1, 2, 3], 0.0)], "unit_id long, batch_no int, fps array<long>, similarity double")
    got = {r.unit_id: r.original_id for r in judge_batches(df, theta=theta).collect()}
    assert got == brute(units, theta)


def test_lost_chunks_is_a_bound():
    rng = random.Random(5)
    for _ in range(300):
        a = {rng.randint(0, 10**9) for _ in range(rng.randint(1, 60))}
        b = set(a)
        while b and jaccard(a, b) >= 0.85:
            last = set(b)
            b.symmetric_difference_update({rng.choice([rng.randint(0, 10**9), rng.choice(sorted(b))])})
        for other in [last]:
            x = np.array(sorted(a), dtype=np.int64)
            y = np.array(sorted(other), dtype=np.int64)
            ca, cb = set(cut(x, np.array([0, len(x)]))[0].tolist()), set(cut(y, np.array([0, len(y)]))[0].tolist())
            assert len(ca - cb) <= lost_chunks(np.array([len(a)]), 0.85)[0]


def test_batch_added_again_replaces_itself(spark):
    h = History(spark)
    rec = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6, 7, 8])], "id long, values array<long>")
    h.accept(rec, 0)
    h.accept(rec, 0)
    assert h.judge(spark.createDataFrame([(2, [1, 2, 3, 4, 5, 6, 7, 8]), (3, [9])], "id long, values array<long>")).collect() == [(2, 1, 1.0)]
    h.close()


def test_empty(spark):
    df = spark.createDataFrame([], "unit_id long, batch_no int, fps array<long>")
    assert judge_batches(df).collect() == []


def random_records(seed, n, first):
    rng, same = random.Random(seed), random.Random(99)
    base = [sorted(same.sample(range(2000), same.choice([2, 5, 12, 30, 60]))) for _ in range(12)]
    out = []
    for i in range(n):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            s ^= {rng.randint(0, 2000)}
        out.append((first + i, sorted(s or {1})))
    return out


def test_reopened_history_in_buckets(spark, tmp_path, monkeypatch):
    """A second session goes on where the first ended; several buckets and parts give what one gives."""
    from echofold.llm import batches

    monkeypatch.setattr(batches, "BUCKET_ROWS", 150)
    schema = "id long, values array<long>"
    old, more, new = random_records(1, 60, 0), random_records(2, 60, 100), random_records(3, 60, 200)
    path = f"file://{tmp_path}/h"
    h = History(spark, path, theta=0.8)
    h.accept(spark.createDataFrame(old, schema), 0)
    h.accept(spark.createDataFrame(more, schema), 1)
    assert h.buckets > 1
    again = History(spark, path, theta=0.8)
    assert again.buckets == h.buckets
    got = {r.id: (r.original_id, round(r.similarity, 9)) for r in again.judge(spark.createDataFrame(new, schema)).collect()}
    known = {i: set(s) for i, s in old + more}
    want = {}
    for i, s in new:
        best = max((jaccard(set(s), t), -j) for j, t in known.items())
        if best[0] >= 0.8:
            want[i] = (-best[1], round(best[0], 9))
    assert got == want and got
    # one record touches few buckets, and only those are read
    plan = again.judge(spark.createDataFrame(new[:1], schema))
    assert plan.count() <= 1
    with pytest.raises(ValueError):
        History(spark, path, theta=0.9)


def test_copies_over_batches(spark):
    """A rejected set that comes again gets the best original there is by then; copies of an accepted one get that."""
    a, near, nearer = list(range(20)), [*range(19), 90], [*range(20), 91]
    rows = [(1, 0, near), (5, 1, a), (6, 2, nearer), (7, 2, nearer), (8, 3, a), (9, 3, nearer), (10, 4, [500, 501]), (11, 4, [500, 501]), (12, 5, [500, 501])]
    got = {r.unit_id: r.original_id for r in judge_batches(spark.createDataFrame(rows, "unit_id long, batch_no int, fps array<long>"), theta=0.88).collect()}
    assert got == brute([(i, n, set(s)) for i, n, s in rows], 0.88) and got[12] == 10 and 6 not in got and got[8] == 6

import random
from collections import Counter

import pyarrow as pa
import pytest

from echofold.llm.termfreq import Spill, duck, radix_counts, term_verdicts, value_counts


@pytest.mark.parametrize("limit", [10, 500, 100_000])
def test_radix_counts_spill_and_recurse(tmp_path, limit):
    rng = random.Random(limit)
    values = [rng.randint(-400, 400) for _ in range(3000)] + [7] * 2000
    pieces = [pa.table({"value": pa.array(values[i : i + 97], pa.int64()), "n": pa.array([1] * len(values[i : i + 97]), pa.int64()), "records": pa.array([2] * len(values[i : i + 97]), pa.int64())}) for i in range(0, len(values), 97)]
    got = Counter()
    db, aggregate = duck("64MB")
    spill = Spill(f"file://{tmp_path}")
    for t in radix_counts(iter(pieces), spill, aggregate, limit=limit):
        assert t["records"].to_pylist() == [2 * x for x in t["n"].to_pylist()]
        for v, n in zip(t["value"].to_pylist(), t["n"].to_pylist(), strict=True):
            assert v not in got or limit < 100  # a value lies in one piece
            got[v] += n
    assert got == Counter(values)
    assert spill.made == (limit < 100_000)
    spill.close()
    db.close()
    assert list(tmp_path.iterdir()) == []


def test_counts_and_verdicts(spark):
    rng = random.Random(1)
    sets = [sorted({rng.randint(0, 60) for _ in range(rng.randint(0, 12))} | {5}) for _ in range(300)] + [[], None, [99]]
    df = spark.createDataFrame([(s, 1, "v") for s in sets], "fps array<long>, n int, value string")
    want = Counter(v for s in sets if s for v in s)
    twice = spark.createDataFrame([(s and s + s[:3] + [None, 5],) for s in sets], "fps array<long>")
    often = Counter(v for s in sets if s for v in s + s[:3] + [5])
    assert {r.value: (r.n, r.records) for r in value_counts(twice, values="fps", limit=50).collect()} == {v: (often[v], n) for v, n in (want | Counter({5: want[5] + (99 in want)})).items()}
    assert {r.value: r.records for r in value_counts(df, values="fps", limit=50).collect()} == dict(want)
    got = {r.value: r.verdict for r in term_verdicts(df, values="fps").collect()}
    assert got == {v: "rare" if n == 1 else "common" for v, n in want.items() if n == 1 or n > 10}


def test_empty(spark):
    df = spark.createDataFrame([], "fps array<long>")
    assert term_verdicts(df, values="fps").collect() == []

import random
from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from echofold.functions import content, paths, scalars, tokens
from echofold.operators import check, clusters, graph, history, metrics, pairs
from echofold.operators.changes import snapshot_changes, transitions
from echofold.operators.fingerprints import text_fingerprint, text_fingerprints, with_fingerprints
from echofold.sources.tables import compared_path, file_rows, unit_rows

UNIT = "unit_id long, lang string, file_id long, file string, name string, start_line int, end_line int, start_byte int, end_byte int, sig_lines int, is_test boolean, is_trait_impl_method boolean, fps array<long>"


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def random_units(seed, n=80):
    rng, rows, sets = random.Random(seed), [], []
    for i in range(n):
        s = set(rng.choice(sets)) if sets and rng.random() < 0.6 else {rng.randint(0, 400) for _ in range(rng.choice([0, 2, 4, 9, 20]))}
        for _ in range(rng.randint(0, 2)):
            s ^= {rng.randint(0, 400)}
        if rng.random() < 0.1 and sets:
            s |= set(rng.choice(sets))
        sets.append(s)
        rows.append((i, rng.choice(["a", "b", None]), i % 7, f"f{i % 7}.py", f"n{i}", i, i + 5, i * 10, i * 10 + 5, rng.choice([None, 3, 9]), False, False, sorted(s) if rng.random() < 0.95 else None))
    return rows


def make(spark, rows):
    return spark.createDataFrame(rows, UNIT)


def brute_pairs(rows):
    for x, y in combinations(rows, 2):
        if x[1] is not None and x[1] == y[1] and x[12] and y[12]:
            a, b = set(x[12]), set(y[12])
            yield x[0], y[0], a, b


@pytest.mark.parametrize("seed,theta", [(1, 0.8), (2, 0.5), (3, 0.3)])
def test_pairs_equal_brute_force(spark, seed, theta):
    rows = random_units(seed)
    got = {(r.a, r.b, r.shared, round(r.similarity, 9)) for r in pairs.jaccard_pairs(make(spark, rows), theta).collect()}
    assert got == {(i, j, len(a & b), round(jaccard(a, b), 9)) for i, j, a, b in brute_pairs(rows) if len(a & b) >= 3 and jaccard(a, b) >= theta}
    got = {(r.a, r.b, r.shared) for r in pairs.candidate_pairs(make(spark, rows)).collect()}
    assert got == {(i, j, len(a & b)) for i, j, a, b in brute_pairs(rows) if len(a & b) >= 3}


def test_links_connect_what_pairs_connect(spark):
    rows = random_units(8, 120)
    rows += [(200 + i, "a", 1, "f", "n", 1, 2, 0, 1, 5, False, False, [1, 2, 3, 4]) for i in range(40)] + [(300 + i, "a", 1, "f", "n", 1, 2, 0, 1, 5, False, False, [1, 2]) for i in range(3)]
    df = make(spark, rows)
    members, reps = pairs.set_classes(df)
    assert {r.rep for r in members.where("unit_id >= 200 and unit_id < 300").collect()} == {200} and reps.count() == members.select("rep").distinct().count()
    links, full = pairs.similar_links(df), pairs.jaccard_pairs(df)
    assert links.count() < full.count()
    label = lambda e: {(r.v, r.label) for r in graph.components(e).collect()}
    assert label(links) == label(full)


def test_containment_and_nesting(spark):
    rows = random_units(5, 100)
    got = {(r.small, r.large, round(r.containment, 9)) for r in pairs.containment_pairs(make(spark, rows)).collect()}
    want = set()
    for i, j, a, b in brute_pairs(rows):
        small, large = (i, j) if len(a) <= len(b) else (j, i)
        if len(a & b) >= 3 and jaccard(a, b) < 0.8 and len(a & b) / min(len(a), len(b)) >= 0.9:
            want.add((small, large, round(len(a & b) / min(len(a), len(b)), 9)))
    assert got == want and got
    inner = [list(rows[0]), list(rows[0])]
    inner[0][0], inner[0][1], inner[0][7], inner[0][8], inner[0][12] = 1, "a", 10, 20, list(range(5))
    inner[1][0], inner[1][1], inner[1][7], inner[1][8], inner[1][12] = 2, "a", 0, 90, list(range(50))
    assert pairs.containment_pairs(make(spark, inner)).count() == 0
    inner[1][2] = 55
    assert pairs.best_container(pairs.containment_pairs(make(spark, inner))).collect() == [(1, 2, 1.0)]


def test_nesting_is_tested_on_members(spark):
    unit = lambda i, file, start, end, fps: (i, "a", file, "f", "n", 1, 2, start, end, 5, False, False, fps)
    inner, outer = list(range(5)), list(range(50))
    rows = [unit(1, 7, 10, 20, inner), unit(2, 7, 0, 90, outer)]
    for copies, want in [([], []), ([unit(3, 8, 10, 20, inner)], [(1, 2)]), ([unit(3, 7, 30, 40, inner)], []), ([unit(3, 7, 95, 99, inner)], [(1, 2)])]:
        df = make(spark, rows + copies)
        members, reps = pairs.set_classes(df)
        got = pairs.containment_pairs(reps, members=members.join(df.select("unit_id", "file_id", "start_byte", "end_byte"), "unit_id"))
        assert [(r.small, r.large) for r in got.collect()] == want
        assert pairs.containment_pairs(reps).count() == 0


def test_cull(spark):
    rows = [(i, "a", 0, "f", "n", 1, 2, 0, 1, 5, False, False, [7, i + 100]) for i in range(30)] + [(50 + i, "b", 0, "f", "n", 1, 2, 0, 1, 5, False, False, [7]) for i in range(3)] + [(99, None, 0, "f", "n", 1, 2, 0, 1, 5, False, False, None)]
    culled = {r.unit_id: r.fps for r in pairs.cull(make(spark, rows), floor=10).collect()}
    assert culled[0] == [100] and culled[50] == [7] and culled[99] is None and len(culled) == 34
    assert pairs.hot_fingerprints(make(spark, rows), floor=10).collect() == [("a", 7, 30)]


def test_probe_takes_the_best(spark):
    base = [(i, "a", 0, "f", "n", 1, 2, 0, 1, 5, False, False, s) for i, s in ((1, [1, 2, 3, 4, 5, 6, 7]), (2, [1, 2, 3, 4, 5, 6, 8]), (3, [9]), (4, []))]
    changed = [(i, "a", 0, "g", "m", 1, 2, 0, 1, 5, False, False, s) for i, s in ((11, [1, 2, 3, 4, 5, 6, 7]), (12, [1, 2, 3, 4, 5, 6]), (13, [9]), (14, []), (15, None), (16, [77]))]
    got = {r.unit_id: (r.original_id, round(r.similarity, 3)) for r in pairs.probe_pairs(make(spark, changed), make(spark, base)).collect()}
    assert got == {11: (1, 1.0), 12: (1, 0.857), 13: (3, 1.0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 330)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.v: r.label for r in graph.components(spark.createDataFrame([*edges, (None, 1), (2, None)], "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent if any((v == a) != (v == b) for a, b in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def unit(i, file, start, end, lines, fps, test=False, trait=False):
    return (i, "a", file, f"f{file}.py", f"n{i}", start, end, start, end, lines, test, trait, fps)


def test_clusters(spark):
    s = [1, 2, 3, 4]
    rows = [unit(1, 1, 0, 50, 10, s), unit(2, 2, 0, 50, 18, s), unit(3, 3, 0, 50, None, s),  # kept
            unit(4, 1, 10, 20, 3, [9, 8, 7]), unit(5, 2, 10, 20, 3, [9, 8, 7]),  # nested in the first
            unit(6, 4, 0, 90, 9, [5, 6, 7]), unit(7, 4, 5, 80, 8, [5, 6, 7]),  # one inside the other: a cluster of one
            unit(10, 5, 0, 9, 4, [21, 22, 23], True), unit(11, 6, 0, 9, 4, [21, 22, 23], True), unit(12, 7, 0, 9, 4, [31, 32, 33], False, True), unit(13, 8, 0, 9, 4, [31, 32, 33], False, True)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (6, 7), (10, 11), (12, 13)], "a long, b long")
    members = clusters.ranked_members(make(spark, rows), edges)
    assert {(r.cluster, r.unit_id, r["rank"]) for r in clusters.with_rank(members).collect()} == {(1, 2, 1), (1, 1, 2), (1, 3, 3), (10, 10, 1), (10, 11, 2), (12, 12, 1), (12, 13, 2)}
    table = {r.cluster: r for r in clusters.cluster_rows(members).collect()}
    assert table[1].deletable_lines == 10 and table[1].copies == 3 and table[1].similarity == 1.0 and table[10].test_only and table[12].trait_impl_only
    score = lambda **k: clusters.score(clusters.cluster_rows(members), F.lit(100), **k).first()
    assert (score().percent, score().grade, score(include_tests=True).deletable_lines) == (10.0, "D", 14)
    assert clusters.score(clusters.cluster_rows(members), F.lit(0)).first()[1:] == (0.0, "A")
    assert [r.cluster for r in clusters.top_clusters(clusters.cluster_rows(members), 2).collect()] == [1, 10]


def test_equal_spans_are_not_nested(spark):
    rows = [unit(1, 1, 0, 50, 10, [1]), unit(2, 1, 0, 50, 10, [1]), unit(3, 1, 60, 70, 10, [1])]
    m = make(spark, rows).withColumn("cluster", F.lit(1))
    assert clusters.drop_nested_members(m).count() == 3
    assert clusters.drop_nested_members(make(spark, [*rows, unit(4, 1, 0, 60, 1, [1])]).withColumn("cluster", F.lit(1))).count() == 2


def test_grades(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 2.99, 3.0, 5.9, 6.0, 9.99, 10.0, 14.9, 15.0, None)], "p double")
    assert [r[0] for r in df.select(scalars.grade(F.col("p"))).collect()] == ["A", "A", "B", "B", "C", "C", "D", "D", "F", None]


def test_paths(spark):
    cases = {"a/x_test.go": True, "tests/x.rs": True, "src/test_a.py": True, "a/b.test.ts": True, "a/FooTest.java": True, "a/spec/x.rb": True, "conftest.py": True, "a/x_spec.rb": True, "src/app.ts": False, "src/contest.py": False,
             "src/testing/x.py": False, "src/latest.go": False, "a/fooTests.swift": True, "tests.rs": True}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", paths.is_test_path(F.col("p"))).collect()} == cases
    assert all(paths.py_is_test(k) == v for k, v in cases.items())
    cases = {"node_modules/x.js": True, "a/Vendor/x.go": True, "a/x.min.js": True, "a/x.generated.cs": True, "x.d.ts": True, "src/app.ts": False, "builder/x.go": False, "a.generated.d/x.ts": False}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", paths.default_excluded(F.col("p"))).collect()} == cases
    cases = {"a.ts": "typescript", "a.tsx": "tsx", "A.TS": None, "go": "go", "x.h": "c", "x.hpp": "cpp", "README": None}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", paths.lang_of(F.col("p"))).collect()} == cases
    df = spark.createDataFrame([("./a\\b.py",), (".\\./x",), ("a/./b",), (None,)], "p string")
    assert [r[0] for r in df.select(compared_path(F.col("p"))).collect()] == ["a/b.py", "x", "a/./b", None]


def test_content(spark):
    cases = [("// @generated\nx", "generated"), ("\n" * 9 + "# DO NOT EDIT", "generated"), ("\n" * 10 + "# do not edit", None), ("x" * 2001, "minified"), ("é" * 1001, "minified"), ("x" * 1000, "minified"), ("x" * 300, None), ("", None), ("a\r\nb\n", None), (None, "non-utf8")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(content.skip_reason(F.col("t"))).collect()] == [w for _, w in cases]
    assert [r[0] for r in df.where("t is not null").orderBy("i").select(F.size(content.lines(F.col("t")))).collect()][-3:] == [1, 0, 2]


def test_suggestions(spark):
    cases = [("rust", "src/report/card.rs", "render", "x.rs", "use crate::report::card::render;"), ("rust", "src/lib.rs", "render", "x.rs", "use crate::render;"), ("rust", "my/src/a/mod.rs", "f", "x.rs", "use crate::a::f;"), ("rust", "a.txt", "f", "x", None),
             ("python", "pkg/util/parse.py", "p", "x.py", "from pkg.util.parse import p"), ("python", "src/pkg/__init__.py", "p", "x.py", "from pkg import p"), ("python", "__init__.py", "p", "x.py", None), ("python", "a/b.pyi", "p", "x.py", "from a.b import p"),
             ("typescript", "src/a/b.ts", "f", "src/c/d.ts", "import { f } from '../a/b';"), ("javascript", "src/b.js", "f", "src/d.js", "import { f } from './b';"), ("tsx", "b.tsx", "f", "a/b/c.ts", "import { f } from '../../b';"), ("typescript", "a/b/x.test.ts", "f", "a/d.ts", "import { f } from './b/x.test';"),
             ("go", "a.go", "f", "b.go", None), (None, "a", "f", "b", None)]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, lang string, o string, n string, f string")
    got = [r[0] for r in df.orderBy("i").select(scalars.import_suggestion(F.col("lang"), F.col("o"), F.col("n"), F.col("f"))).collect()]
    assert got == [c[4] for c in cases]


def test_small_functions(spark):
    df = spark.createDataFrame([(0.0, 12, "abcdef"), (0.5, 1234567, "abc"), (1.0, 1999, "abcd"), (2.0, 999, ""), (None, None, None)], "s double, n long, t string")
    rows = df.select(scalars.sim_bar(F.col("s")), scalars.group_digits(F.col("n")), scalars.human_ms(F.col("n")), scalars.truncate(F.col("t"), 4), scalars.truncate_left(F.col("t"), 4), scalars.month_of(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("", "12", "12ms", "abc…", "…def", "1970-01"), ("████▌", "1,234,567", "1234.6s", "abc", "abc", "1970-01"), ("█████████", "1,999", "2.0s", "abcd", "abcd", "1970-01"), ("█████████", "999", "999ms", "", "", "1970-01"), (None,) * 6]
    assert spark.createDataFrame([([1, 2], [2, 3], [])], "a array<int>, b array<int>, c array<int>").select(scalars.jaccard(F.col("a"), F.col("b")), scalars.jaccard(F.col("c"), F.col("c"))).first() == (1 / 3, 0.0)
    assert spark.range(1).select(scalars.month_of(F.lit(-1))).first()[0] == "1969-12"


def test_tokens_and_winnow(spark):
    df = spark.createDataFrame([(1, "One 22 33 two, three"), (2, None), (3, ""), (4, " ".join(f"w{i}" for i in range(40)))], "doc_id long, text string")
    t = {r.id: r.codes for r in tokens.tokenised(df, "doc_id", "text").collect()}
    assert t[1] == ["one", "NUM", "two", "three"] and t[2] == t[3] == []
    import hashlib

    words = [f"w{i}" for i in range(40)]
    h = [hashlib.md5(" ".join(words[i : i + 10]).encode()).hexdigest() for i in range(31)]
    got = {r.id: r for r in text_fingerprints(df, "doc_id", "text").collect()}
    assert got[4].kgrams == 31 and set(got[4].fps) == {min(h[i : i + 8]) for i in range(24)} and len(got[4].fps) == len(set(got[4].fps))
    assert got[1].fps == got[2].fps == [] and got[3].kgrams == 0
    for w in range(1, 12):
        assert set(text_fingerprint(" ".join(words), 10, w)[1]) == {min(h[i : i + w]) for i in range(32 - w)}
    assert text_fingerprint(" ".join(words[:12]))[1] == [min(h[:3])]


def test_exact_fingerprints(spark):
    df = spark.createDataFrame([(1, list(range(30))), (2, None), (3, [1, 2])], "id long, codes array<int>")
    got = {r.id: r.fps for r in with_fingerprints(df).collect()}
    # the polynomial written out with Python's integers
    m = 2**64

    def mix(h):
        h = (h + 0x9E3779B97F4A7C15) % m
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % m
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB % m
        return h ^ (h >> 31)

    hashes = []
    for i in range(21):
        h = 0
        for c in range(i, i + 10):
            h = (h * 1_000_003 + c + 1) % m
        hashes.append(mix(h))
    want = {min(hashes[i : i + 8]) for i in range(14)}
    assert sorted(x % m for x in got[1]) == sorted(want) and got[2] == [] and got[3] == []


def test_history_functions(spark):
    rows = [("r", i, m, v) for i, (m, v) in enumerate([("01", 0.0), ("01", 1.0), ("02", 2.0), ("03", 9.0), ("02", 3.0), ("02", 4.0)])]
    df = spark.createDataFrame(rows, "repo string, n int, m string, v double")
    assert [(r.n, r.month) for r in history.month_last(df, group="repo", order="n", month=F.col("m")).orderBy("n").collect()] == [(1, "01"), (2, "02"), (3, "03"), (5, "02")]
    many = spark.range(50).select(F.lit("r").alias("repo"), F.col("id").alias("n"))
    for most in (2, 3, 7, 36, 49, 50, 80):
        got = [r.n for r in history.evenly_spaced(many, group="repo", order="n", most=most).orderBy("n").collect()]
        assert got == (list(range(50)) if most >= 50 else sorted({i * 49 // (most - 1) for i in range(most)}))
    assert [r.n for r in history.evenly_spaced(many, group="repo", order="n", most=1).collect()] == [49]
    assert history.evenly_spaced(many.limit(1), group="repo", order="n", most=1).count() == 1
    series = lambda *v: spark.createDataFrame([("r", i, x, f"d{i}") for i, x in enumerate(v)], "repo string, n int, v double, d string")
    inflect = lambda *v: tuple(history.inflection(series(*v), group="repo", order="n", value="v", date="d").first())[1:]
    assert inflect(0.0, 0.0, 0.0, 5.0, 9.0) == (None, "d2")
    assert inflect(2.0, 2.0, 2.0, 4.0, 4.0) == (2.0, "d0") and inflect(4.0, 2.0, 2.0, 2.2) == (None, None) and inflect(1.0, 9.0) == (None, None)
    assert inflect(5.0, 4.0, 3.0, 1.0) == (None, None) and inflect(0.0, 0.0, 0.1, 0.2) == (None, None)
    assert [round(r.smoothed, 3) for r in history.smooth(series(1.0, 2.0, 6.0), group="repo", order="n", value="v").orderBy("n").collect()] == [1.5, 3.0, 4.0]
    sized = spark.createDataFrame([(f"f{i:02}", x) for i, x in enumerate([3, None, 4, 5, 6])], "f string, n int")
    pick = lambda t: [r.f for r in history.prefix_until(sized, order="f", size="n", target=t).orderBy("f").collect()]
    assert pick(7) == ["f00", "f01", "f02"] and pick(8) == ["f00", "f01", "f02", "f03"] and len(pick(99)) == 5 and pick(0) == []


def test_hunks(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +3,4 @@ f\n+a\n@@ -9 +12 @@\n@@ -20,3 +22,0 @@\n--- a/y\n+++ /dev/null\n@@ -1,3 +0,0 @@\n--- a/z\n+++ b/dir/z y.ts\t\n@@ -0,0 +1,7 @@\n+@@ -1 +1 @@\n"
    rows = [(1, i, x) for i, x in enumerate(diff.splitlines())]
    got = check.parse_hunks(spark.createDataFrame(rows, "diff int, n int, line string"))
    assert sorted(map(tuple, got.collect())) == [(1, "dir/z y.ts", 1, 7), (1, "x", 3, 6), (1, "x", 12, 12)]
    units = make(spark, [(1, "a", 1, "x", "n", 1, 2, 0, 1, 1, False, False, []), (2, "a", 1, "x", "n", 5, 9, 0, 1, 1, False, False, []), (3, "a", 1, "q", "n", 5, 9, 0, 1, 1, False, False, [])])
    assert [r.unit_id for r in check.touched(units, got).collect()] == [2]


def test_anti_filters(spark):
    m = spark.createDataFrame([(1, "a", "f", "a", "f", [1, 2]), (2, "a", "g", "b", "f", [1, 2]), (3, "a", "g", "c", "f", [1, 2]), (4, "a", "g", "d", "f", [1, 2]), (5, None, None, None, None, None)], "unit_id long, file string, name string, original_file string, original_name string, original_fps array<long>")
    other = check.without_same_function(m)
    assert sorted(r.unit_id for r in other.collect()) == [2, 3, 4, 5]
    now = spark.createDataFrame([("c", [1, 2]), ("d", [1, 9])], "file string, fps array<long>")
    changed = spark.createDataFrame([("c",), ("d",), ("a",)], "file string")
    assert sorted(r.unit_id for r in check.without_moves(other, now, changed).collect()) == [2, 3, 5]


def test_metrics(spark):
    truth = spark.createDataFrame([(1, 2, 1), (3, 4, 2), (5, 6, 2)], "a long, b long, kind int")
    pred = spark.createDataFrame([(2, 1), (1, 2), (3, 4), (1, 9), (7, 7), (None, 1)], "a long, b long")
    s = metrics.scores(metrics.confusion(truth, pred, 10)).first()
    assert (s.tp, s.fp, s.fn, s.tn) == (2, 1, 1, 41) and round(s.f1, 6) == 0.666667 and round(s.mcc, 6) == round((2 * 41 - 1) / (3 * 3 * 42 * 42) ** 0.5, 6)
    none = metrics.scores(metrics.confusion(truth.limit(0), pred.limit(0), 3)).first()
    assert (none.precision, none.recall, none.f1, none.mcc, none.tn) == (0.0, 0.0, 0.0, 0.0, 3)
    assert {r.kind: (r.hit, r.total) for r in metrics.recall_by(truth, pred, "kind").collect()} == {1: (1, 1), 2: (1, 2)}
    runs = spark.createDataFrame([("x", 1, 2), ("x", 3, 4), ("y", 2, 1), ("z", 8, 9)], "run string, a long, b long")
    assert metrics.determinism(runs).first() == (3, (0.5 + 0 + 0) / 3)
    assert metrics.determinism(runs.where("run = 'x'")).first() == (1, 1.0)
    r = metrics.run_summary(spark.createDataFrame([("g", 1.0, 2), ("g", 3.0, 0), ("g", None, 1), ("h", None, 0)], "g string, v double, f int"), group="g", values=["v"], cost="v", found="f").orderBy("g").collect()
    assert r[0].runs == 3 and r[0].v_mean == 2.0 and round(r[0].v_stddev, 6) == 1.414214 and round(r[0].cost_per_hit, 6) == 1.333333 and r[1].v_mean is None and r[1].v_stddev is None and r[1].cost_per_hit is None
    m = metrics.match_truth(spark.createDataFrame([("x/a.py", "f"), ("a.py", "g"), (None, None)], "file string, name string"), spark.createDataFrame([(5, "q/a.py", "f"), (4, "a.py", "f")], "id long, file string, name string"))
    assert sorted((r.name or "", r.truth_id) for r in m.collect()) == [("", None), ("f", 4), ("g", None)]


def test_all_pairs_of_classes_are_true(spark):
    # classes {1, 2, 3} and {10, 11} are similar, {20, 21} is alone; 30 is in no class
    members = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 1, "a"), (10, 10, "a"), (11, 10, "a"), (20, 20, "b"), (21, 20, "b")], "unit_id long, rep long, lang string")
    similar = spark.createDataFrame([(1, 10)], "a long, b long")
    pred = spark.createDataFrame([(3, 2), (2, 3), (11, 3), (2, 20), (30, 1), (7, 7), (None, 1)], "a long, b long")
    assert metrics.class_confusion(members, similar, pred, 8).first() == (2, 2, 9, 15)
    assert {r.lang: (r.hit, r.total) for r in metrics.class_recall(members, similar, pred, "lang").collect()} == {"a": (2, 10), "b": (0, 1)}
    assert metrics.class_confusion(members.limit(0), similar.limit(0), pred, 8).first() == (0, 4, 0, 24)


def test_changes(spark):
    t = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    points = [("r", "c1", t(1)), ("r", "c2", t(2)), ("r", "c3", t(3)), ("r", "c3", t(3)), ("r", "c4", t(4)), ("s", "d1", t(1)), (None, "e", t(1)), ("r", None, t(9))]
    tree = [("c1", "a", "1", t(1)), ("c1", "b", "AA", t(1)), ("c1", "gone", "5", t(1)), ("c1", "b", "bb", t(2)), ("c1", "b", "bb", t(2)),
            ("c3", "./a", "1", t(3)), ("c3", "b", "BB", t(3)), ("c3", "new", "7", t(3)), ("c3", "nil", None, t(3)), ("c3", None, "7", t(3)), ("zz", "q", "1", t(3)),
            ("c4", "a", "2", t(4)), ("c4", "a", "1", t(5)), ("c4", "b", "cc", t(4)), ("c4", "new", "7", None), ("d1", "x", "1", t(1))]
    tree = spark.createDataFrame([(*r, "k", "s", "v") for r in tree], "commit string, path string, oid string, delivered_at timestamp, key string, step string, value string")
    steps = transitions(spark.createDataFrame(points, "repo string, commit string, committed_at timestamp"), tree)
    assert sorted(map(tuple, steps.collect())) == [("c1", "c3"), ("c3", "c4")]
    got = snapshot_changes(tree, steps, snapshot="commit", key=compared_path(F.col("path")), value=F.lower("oid"), version=F.col("delivered_at"))
    want = [("c3", "gone", "removed"), ("c3", "new", "added"), ("c4", "b", "changed")]
    assert sorted(map(tuple, got.collect())) == want
    shuffled = snapshot_changes(tree, steps, snapshot="commit", key=compared_path(F.col("path")), value=F.lower("oid"), version=F.col("delivered_at"), sides=1)
    assert sorted(map(tuple, shuffled.collect())) == want
    assert snapshot_changes(tree.limit(0), steps.limit(0), snapshot="commit", key=F.col("path"), value=F.col("oid"), version=F.col("delivered_at")).collect() == []


def test_canonical_rows(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, " Go ", 5, 0, [3, 1, None, 3], t), (1, "go", 5, 0, [1, 3], t), (2, None, None, None, None, t), (None, "go", 1, 1, [1], t), (3, "RUST", 2, 1, [], None)]
    units = spark.createDataFrame(rows, "unit_id long, lang string, sig_lines int, batch_no int, fingerprints array<long>, loaded_at timestamp")
    assert sorted((r.unit_id, r.lang, r.fps) for r in unit_rows(units).collect()) == [(1, "go", [1, 3]), (2, None, []), (3, "rust", [])]
    files = spark.createDataFrame([(1, "./a", t), (1, "a", t + timedelta(1)), (None, "b", t), (2, None, None)], "file_id long, path string, loaded_at timestamp")
    assert sorted((r.file_id, r.file) for r in file_rows(files).collect()) == [(1, "a"), (2, None)]


def test_stream_of_changes(spark, tmp_path):
    from echofold.streaming.incremental import watch_changes

    base = make(spark, [(1, "a", 0, "f", "n", 1, 2, 0, 1, 5, False, False, [1, 2, 3, 4, 5, 6, 7]), (2, "a", 0, "f", "m", 1, 2, 0, 1, 5, False, False, [50, 51])])
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    make(spark, [(11, "a", 0, "g", "x", 1, 2, 0, 1, 5, False, False, [1, 2, 3, 4, 5, 6, 7]), (12, "a", 0, "f", "m", 1, 2, 0, 1, 5, False, False, [50, 51])]).write.parquet(src)
    stream = spark.readStream.schema(base.schema).parquet(src)
    q = watch_changes(stream, base, out, str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination(120)
    make(spark, [(13, "a", 0, "g", "x", 1, 2, 0, 1, 5, False, False, [50, 51])]).write.mode("append").parquet(src)
    q = watch_changes(stream, base, out, str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination(120)
    assert sorted((r.unit_id, r.original_id, r.original_file) for r in spark.read.parquet(out).collect()) == [(11, 1, "f"), (13, 2, "f")]


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "p5_found" in e.queries()
    assert Counter(k.split("_")[0] for k in e.queries())["p5"] == 1

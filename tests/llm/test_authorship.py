import random

import numpy as np
import pytest

from echofold.llm import authorship
from echofold.llm.authorship import FEATURES, batch_features, incompressible, not_hand_written, note_kind, package_of, path_kind
from echofold.llm.repair import repair

SCHEMA = "file_id long, repo string, path string, content string, kind string"


def hand(seed, n=30):
    rng = random.Random(seed)
    names = ["order", "total", "client", "index", "value", "result", "path", "state"]
    w = lambda: rng.choice(names)
    forms = [lambda: f"    {w()} = {w()}.{w()}({w()}, {rng.randint(1, 99)})", lambda: f"    if {w()} < {w()}[{w()}]:\n        return {w()} + {rng.randint(1, 9)}",
             lambda: f"    for {w()} in {w()}({w()}): {w()} += {rng.randint(1, 9)}", lambda: f"    raise {w()}(\"{w()} {w()}\")", lambda: f"    {w()}, {w()} = {w()}[{rng.randint(0, 9)}:{rng.randint(0, 9)}]",
             lambda: f"    assert {w()} is not {w()} or {w()}", lambda: f"    {w()} = [{w()} * {w()} for {w()} in {w()}]"]
    return "\n".join(f"def {w()}_{i}({w()}, {w()}):\n" + "\n".join(rng.choice(forms)() for _ in range(rng.randint(3, 7))) + "\n" for i in range(n // 4))


def test_grammar_of_runs_and_noise():
    rng = np.random.default_rng(1)
    seqs = [np.tile([1, 2, 3, 4], 50), rng.integers(0, 200, 200), np.zeros(0, np.int64), np.array([5])]
    g = repair(np.concatenate(seqs).astype(np.int64), np.array([len(s) for s in seqs]))
    covered = g.covered(24)
    assert covered[0] > 0.9 and covered[1] == 0 and covered[2] == 0 and covered[3] == 0
    assert g.coded()[0] < 0.2 and g.coded()[1] > 0.9
    assert np.bincount(g.owner, weights=g.span, minlength=4).tolist() == [200, 200, 0, 1]
    # a sequence's grammar doesn't depend on its neighbours
    alone = repair(seqs[0].astype(np.int64), np.array([200]))
    assert alone.span.tolist() == g.span[g.owner == 0].tolist() and alone.rules[0] == g.rules[0]


@pytest.mark.parametrize("path,want", [
    ("web/node_modules/x/a.js", "vendored"), ("Vendor/a/b.go", "vendored"), ("deps/some-lib-1.2.3/a.c", "vendored"), ("static/js/lib-4.1.0.js", "vendored"), ("a/b.min.js", "minified"),
    ("x/generated/a.ts", "generated"), ("x/a_pb2.py", "generated"), ("x/a.pb.go", "generated"), ("dist/a.js", "generated"),
    ("src/vendor_portal/a.py", None), ("src/minify_1.py", None), ("lib/generator/a.go", None), ("src/builder/a.rs", None), ("src/distribution/a.rs", None), ("a/bundle_rules.ts", None), (None, None), ("", None),
])
def test_paths(path, want):
    assert path_kind(path) == want


@pytest.mark.parametrize("text,want", [
    ("// Code generated by tool v1. DO NOT EDIT.\npackage x", "generated"), ("/*\n * @generated by z\n */\nx", "generated"), ("# This file was created automatically from a.idl; manual changes will be lost.\n", "generated"),
    ("// Vendored from lib 1.2; see PATCHES.\n", "vendored"), ("/*! lib v5.9 | (c) the lib authors | ISC license */\n", "vendored"), ("// Copyright Y Ltd\n// more\npackage a\n// Third-party code, see NOTICE.\n", "vendored"),
    ("# Generated automatically by z\n", "generated"), ("// Autogenerated using z 1\n", "generated"), ("# Erzeugt mit z\n", "generated"), ("// Code généré par z\n", "generated"), ("-- This is a generated file.\n", "generated"), ("# Please do not modify this file!\n", "generated"),
    ("// Any modifications will be discarded.\n", "generated"), ("# Never change the order of these\n", None), ("// edits of the user are lost-proof\n", None), ("# Handwritten; the generated code is elsewhere\n", None),
    ("// Helpers for the auto-generated client; written by hand.\n", None), ("// DO NOT EDIT while a job is running\n", None), ("# The rows are generated by the nightly job.\n", None),
    ("var B = \"Code generated by x\";\n", None), ("// Inspired by lib 5.4; this version is ours.\n", None), ("// The file system was written with care\n", None), ("a\nb\nc\nd\ne\n// Code generated by x\n", None), ("", None),
])
def test_notes(text, want):
    assert note_kind(text) == want


def test_noise():
    rng = random.Random(4)
    blob = "".join(rng.choice("ABCDEFabcdefghijkl0123456789+/") for _ in range(4000))
    assert incompressible(blob) > 0.95 and incompressible("some words|other words|" * 100) < 0.5 and incompressible("") == 0.0


def test_files(spark):
    rng = random.Random(6)
    accessors = "\n".join(f"  get{n}{i}() {{ return this.f_[{i}]; }}\n  set{n}{i}(v) {{ this.f_[{i}] = v; return this; }}" for i, n in enumerate(rng.choices(["Shard", "Batch", "Token"], k=30)))
    blob = "X = (\n" + "\n".join('  "' + "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(76)) + '"' for _ in range(40)) + "\n)"
    numbers = "T = [\n" + "\n".join(", ".join(str(rng.randint(-9999, 9999)) for _ in range(12)) + "," for _ in range(40)) + "\n]"
    mini = "".join(f"function {a}(b,c){{return b.x?c:{a}(c)}}var {a}={a}[{i}],y={a}||z;" for i, a in enumerate("abcdefghijklmnop" * 3))
    pattern = 'P = "^(' + "|".join(rng.choice(["load_shard", "split_token", "merge_batch", "rank_route"]) for _ in range(90)) + ')$"\n' + hand(99)
    copied = hand(50, 60)
    rows = [(1, "r1", "a/x.js", accessors, "k"), (2, "r1", "a/x.py", blob, "k"), (3, "r1", "a/n.py", numbers, "k"), (4, "r1", "a/m.js", mini, "k"), (5, "r1", ".\\vendor\\q.go", None, "k"), (6, "r1", "a/q.go", None, "k"),
            (7, "r1", "a/p.py", pattern, "k"), (8, "r1", "a/e.py", "", "k"), (None, "r1", "a/x.js", accessors, "k"), (9, None, None, hand(1), None), (9, None, None, hand(1), None), (10, "r1", "a/long.py", hand(3, 4000), "k")]
    rows += [(20 + i, f"r{i}", f"s/c{i}.py", hand(60 + i, 8) + "\n" + copied, "k") for i in range(4)] + [(40 + i, f"r{i}", f"s/h{i}.py", hand(70 + i), "k") for i in range(4)]
    got = {r.file_id: r.kind for r in not_hand_written(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "generated", 2: "data", 3: "data", 4: "minified", 5: "vendored", 20: "vendored", 21: "vendored", 22: "vendored", 23: "vendored"}
    assert not_hand_written(spark.createDataFrame([], SCHEMA)).collect() == []


def test_copies_already_flagged_count_for_unmarked_ones(spark):
    library = hand(50, 60)
    rows = [(i, f"r{i}", f"node_modules/lib/c{i}.py", library, "k") for i in range(3)] + [(9, "r9", "src/c.py", library, "k"), (10, "r10", "src/own.py", hand(51, 60), "k")]
    got = {r.file_id: r.kind for r in not_hand_written(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: "vendored", 1: "vendored", 2: "vendored", 9: "vendored"}


def feature(name, path, content):
    return batch_features([path], [content])[0][0][list(FEATURES).index(name)]


def test_names_of_the_whole_text():
    head = "".join(f"moduleNumber{i}=loadModule({i});" for i in range(1500))
    mini = "".join(f"function {a}(b,c){{return b.x?c:{a}(c)}}" for a in "abcdefgh" * 1200)
    assert len(head) > 20_000 and feature("short_names", "a.js", head + mini) > 0.5 and feature("short_names", "a.js", mini[:21_000] + head * 20) < 0.5


def test_blobs_over_many_lines():
    rng = random.Random(8)
    lines = "\n".join("    " + "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(76)) for _ in range(40))
    for path, text in [("a.js", f"const x = `\n{lines}\n`;"), ("a.py", f'X = """\n{lines}\n"""'), ("a.py", f"X = '''\n{lines}\n'''"), ("a.sh", f"base64 -d <<'EOF'\n{lines}\nEOF\n"), ("a.php", f"<?php $x = <<<EOT\n{lines}\n  EOT;\n"),
                       ("a.rb", f"X = <<~B\n{lines}\n  B\n"), ("a.cc", f'auto x = R"z({lines})z";'), ("a.rs", f'let x = r#"{lines}"#;'), (None, f"x = `{lines}`")]:
        assert feature("noise", path, text) > 0.85 and feature("quoted", path, text) > 0.5, path
    # neither shifts, nor names in backticks, nor doubled quotes open a literal
    for path, text in [("a.c", "int a = 1 << N;\nb = 1 << N;\n  N;\n" + "f(x);\n" * 9), ("a.sql", "select `a from t;\n" + "select b;\n" * 9 + "select c`;"), ("b.sql", "select '''a'' b';\n" + "select b;\n" * 9 + "select '''';")]:
        assert feature("quoted", path, text) < 0.3, path


@pytest.mark.parametrize("text,want", [
    ("/*\n   Copyright Y\n   a\n   b\n   c\n   d\n   This file was generated by z\n*/\nx", "generated"), ("<!--\n  a\n  This file was generated by z\n-->\n<x/>", "generated"),
    ('"""\na\nb\nc\nd\ne\nVendored copy of b.\n"""\nx', "vendored"), ("/* a */\na\nb\nc\nd\ne\nThis file was generated by z\n", None), ("/* open\na\nb\nc\nd\ne\nf\nThis file was generated by z\n", None),
])
def test_notes_inside_blocks(text, want):
    assert note_kind(text) == want


def test_grammar_is_finished():
    # digram i (of its own two symbols and the next one's) comes i + 2 times: counts rise along the sequence
    rising = [x for k in range(60) for x in range(60 - k - 1, 60)] + list(range(60))
    seqs = [np.array(rising), np.tile([1, 2, 3, 4, 5], 30), np.array([7, 7, 7]), np.array([3])]
    g = repair(np.concatenate(seqs).astype(np.int64), np.array([len(s) for s in seqs]))
    for i, s in enumerate(seqs):
        left, seen = g.symbol[g.owner == i].tolist(), {}
        for j, pair in enumerate(zip(left, left[1:], strict=False)):
            assert j - seen.setdefault(pair, j) < 2, (i, pair)
        assert g.span[g.owner == i].sum() == len(s)
        alone = repair(s.astype(np.int64), np.array([len(s)]))
        assert alone.span.tolist() == g.span[g.owner == i].tolist() and alone.rules[0] == g.rules[i]


def test_packages_come_from_paths(spark):
    """A package is known by two repositories' paths; files that cite it with a version are copies, those that speak of it aren't."""
    rows = [(1, "r1", "node_modules/quux-lib/a.js", hand(1), "k"), (2, "r2", "deps/quux-lib-1.2.3/b.js", hand(2), "k"), (3, "r3", "vendor/lonely/c.js", hand(3), "k")]
    heads = ["# Copied over from quux-lib/2.0.", "# quux-lib rev 77, unchanged", "# Kopie von quux-lib, version 4", "# Inspired by quux-lib 2.0", "# quux-lib is slow here", "# Needs quux-lib 2.1 or later", "# lonely 1.2.0", "# other-lib 3.1"]
    rows += [(10 + i, "r4", f"src/f{i}.py", h + "\n" + hand(20 + i), "k") for i, h in enumerate(heads)]
    got = {r.file_id for r in not_hand_written(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1, 2, 3, 10, 11, 12}
    assert package_of("a/vendor/@scope/pkg/x.js") == "@scope/pkg" and package_of("src/vendor_portal/a.py") is None and package_of(None) is None


def test_batches_by_size(spark, monkeypatch):
    """However files are put together, a file's features are its own."""
    import pyarrow as pa

    sizes = [3, 5, 0, None, 12, 1, 1, 20, 2]
    contents = pa.array([None if n is None else "x" * n for n in sizes])
    monkeypatch.setattr(authorship, "BATCH_CHARS", 10)
    parts = list(authorship._slices(contents))
    assert [i for first, n in parts for i in range(first, first + n)] == list(range(len(sizes)))
    assert all(n == 1 or sum(s or 0 for s in sizes[first : first + n]) <= 10 for first, n in parts)
    texts = [hand(i, 8) for i in range(5)] + [None, "", "a b a b a b a b"]
    assert [r for t in texts for r in batch_features(["p"], [t])[0]] == batch_features(["p"] * len(texts), texts)[0]


def test_symbols_are_renumbered(monkeypatch):
    tokens = np.array([5, 6, 5, 6, 7, 5, 6, 7] * 20, dtype=np.int64)
    shifted = repair(tokens + (1 << 32), np.array([len(tokens)]))
    assert shifted.span.tolist() == repair(tokens, np.array([len(tokens)])).span.tolist()

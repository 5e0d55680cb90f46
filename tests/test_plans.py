import io
import json
import os
import subprocess

import pytest

from echofold import cli, server
from echofold.plans import report as R
from echofold.plans.config import Config
from echofold.plans.corpus import plant, true_pairs
from echofold.plans.scan import Scan
from echofold.sources.files import source_files, walk

from .test_extract import A, B, BODY


def write(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


def git(root, *args, date=None):
    env = {**os.environ, "GIT_AUTHOR_NAME": "t", "GIT_AUTHOR_EMAIL": "t@t", "GIT_COMMITTER_NAME": "t", "GIT_COMMITTER_EMAIL": "t@t"}
    if date:
        env |= {"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date}
    subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, env=env)


TS = BODY["typescript"]


def test_walk(tmp_path):
    write(tmp_path, {"src/app.ts": "x", "src/app.min.js": "x", "node_modules/a/b.js": "x", "vendor/c.go": "x", "README.md": "x", ".hidden/a.py": "x", "out.log.py": "x", "skip/a.py": "x", "skip/keep.py": "x", "b.py": "x", ".gitignore": "*.log.py\nskip/*\n!skip/keep.py\n/b.py\n", "deep/b.py": "x"})
    assert [f for f, _ in walk(str(tmp_path))] == ["deep/b.py", "skip/keep.py", "src/app.ts"]
    assert [f for f, _ in walk(str(tmp_path), excludes=("deep/*",))] == ["skip/keep.py", "src/app.ts"]
    assert "vendor/c.go" in [f for f, _ in walk(str(tmp_path), default_excludes=False)]


def test_scan_report(spark, tmp_path):
    write(tmp_path, {"a/one.ts": TS.format(**A), "b/two.ts": "// x\n" + TS.format(**B), "c/gen.ts": "// @generated\nx\n", "d/bad.py": b"\xff\xfe", "t/one.test.ts": TS.format(**{**A, "n": "q"}), "e/Other.py": BODY["python"].format(**A)})
    scan = Scan(source_files(spark, str(tmp_path)), Config(min_tokens=30))
    doc = R.report(scan, "root")
    assert [len(c["members"]) for c in doc["clusters"]] == [3] and {m["name"] for m in doc["clusters"][0]["members"]} == {"sum_all", "addUp", "q"}
    c = doc["clusters"][0]
    assert c["similarity"] >= 0.95 and c["deletable_lines"] == 22 and not c["test_only"] and c["members"][0]["representative"] and "trait_impl_only" not in c
    assert doc["stats"]["skipped_generated"] == 1 and doc["stats"]["skipped_non_utf8"] == 1 and doc["stats"]["functions"] == 4
    assert doc["stats"]["elapsed_ms"] > 0 and R.report(scan, "root")["stats"]["elapsed_ms"] > doc["stats"]["elapsed_ms"]
    text = "\n".join(R.text_report(scan, "root"))
    assert "[1] 3 alike at 100%, 22 lines to delete" in text and "left out   1 generated, 1 non-utf8" in text and text.count("keep") == 1 and "grade" in text
    pieces = []
    R.stream_json(scan, "root", pieces.append)
    streamed = json.loads("".join(pieces))
    assert list(streamed) == ["schema_version", "root", "stats", "score", "clusters"] and streamed["clusters"] == doc["clusters"] and streamed["score"] == doc["score"]
    assert R.score_card(doc).startswith("<svg")
    read = lambda f: (tmp_path / f).read_text()
    members = [d for _, m, d in R.ranked_documents(scan.members, scan.clusters, only=1) if m]
    assert members == c["members"] and list(R.ranked_documents(scan.members, scan.clusters, only=2)) == []
    one, two, full = ("\n".join(R.explain(members, read, **o)) for o in ({}, {"columns": 120}, {"full": True}))
    assert "export function ⟦addUp⟧" in one and "≠" in two and "return acc;" in full and "⟦" not in full


def test_aligned_lines():
    a = [f"line {i}" for i in range(20)]
    b = [*a[:9], "line nine", *a[10:15], *a[16:]]
    rows = list(R.aligned(a, b, 2))
    assert [r for r in rows if isinstance(r, int)] == [7, 1, 2]
    assert (10, "line ⟦9⟧", 10, "line ⟦nine⟧", False) in rows and (16, "line 15", None, "", False) in rows
    assert [r[0] for r in rows if not isinstance(r, int) and r[4]] == [8, 9, 11, 12, 14, 15, 17, 18]
    assert list(R.aligned(a, a)) == [20] and list(R.aligned([], [])) == []
    assert R.wrap("日本語", 4) == ["日本", "語"] and R.gauge(1.0) == "█" * 9 and R.gauge(0.0) == "" and R.shortened("abcdef", 4) == "abc…" and R.shortened("abcdef", 4, end=False) == "…def"


def test_explain_of_no_cluster(spark, tmp_path, capsys):
    write(tmp_path, {"a/one.ts": TS.format(**A), "b/two.ts": TS.format(**B)})
    assert cli.main(["scan", str(tmp_path), "--explain", "0"]) == 2 and cli.main(["scan", str(tmp_path), "--explain", "2"]) == 2
    assert "from 1 to 1" in capsys.readouterr().err
    assert cli.main(["scan", str(tmp_path), "--explain", "1"]) == 0
    assert "kept: " in capsys.readouterr().out
    assert cli.main(["scan", str(tmp_path), "--json"]) == 0 and len(json.loads(capsys.readouterr().out)["clusters"]) == 1


def test_containment_and_shapes(spark, tmp_path):
    small = BODY["python"].format(**A)
    body = "".join(small.splitlines(keepends=True)[1:])
    big = "def big(items, label):\n" + "".join(f"    step_{i} = [items[{i}].run(x, key={i}) for x in label if not x.done({i})]\n    while step_{i}.pop() is not None: label.append(step_{i})\n" for i in range(3)) + "    try:\n        items.close()\n    except ValueError as e:\n        raise KeyError(label) from e\n" + body
    cs = "public class {n} {{\n  public int Id {{ get; set; }}\n  public string Name {{ get; set; }}\n  public {t} Extra(int x) {{ return x; }}\n  public void Go(string s) => Run(s);\n  public long Size;\n}}\n"
    write(tmp_path, {"a.py": small, "b.py": big, "x.cs": cs.format(n="Customer", t="int"), "y.cs": cs.format(n="Client", t="int")})
    scan = Scan(source_files(spark, str(tmp_path)), Config(min_tokens=20), shapes=True)
    doc = R.report(scan, "r", containment=True)
    assert doc["clusters"] == []
    assert [(c["contained"]["name"], c["container"]["name"]) for c in doc["containment"]] == [("sum_all", "big")]
    assert [[m["name"] for m in c["members"]] for c in doc["class_shapes"]] == [["Customer", "Client"]]
    text = "\n".join(R.text_report(scan, "r", containment=True))
    assert "[1] 2 alike at 100%\n" in text and "stands in big (b.py:1" in text and "Nothing is repeated." in text


def test_planted_corpus(spark, tmp_path):
    from echofold.operators.metrics import confusion, recall_by, scores

    planted = plant(7)
    rows = [(p.file, len(p.source), p.source) for p in planted]
    scan = Scan(spark.createDataFrame(rows, "file string, size long, content string"), Config(min_tokens=20))
    ids = {p.file: p.id for p in planted}
    members = [(r.cluster, ids[r.file]) for r in scan.members.select("cluster", "file").collect()]
    found = spark.createDataFrame([(a, b) for c, a in members for d, b in members if c == d and a < b], "a long, b long")
    truth = spark.createDataFrame(true_pairs(planted), "a long, b long, kind int")
    s = scores(confusion(truth, found, len(planted))).first()
    recall = {r.kind: r.recall for r in recall_by(truth, found, "kind").collect()}
    assert s.precision == 1.0 and recall[1] == 1.0 and recall[2] == 1.0 and s.f1 >= 0.7


@pytest.fixture
def repo(tmp_path):
    git(tmp_path, "init", "-q", "-b", "main")
    write(tmp_path, {"src/original.ts": TS.format(**A), "src/noise.ts": "export const x = 1;\n"})
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "base")
    return tmp_path


def check(capsys, repo, *args):
    code = cli.main(["check", str(repo), "--min-tokens", "30", *args])
    return code, capsys.readouterr().out


def test_check_scenarios(spark, repo, capsys):
    assert check(capsys, repo) == (0, "Nothing has changed.\n")
    write(repo, {"src/copy.ts": "// new\n\n" + TS.format(**B)})
    code, out = check(capsys, repo)
    assert code == 1 and out.startswith("src/copy.ts:3: addUp repeats sum_all (src/original.ts:1) at 100%") and "import { sum_all } from './original';" in out
    write(repo, {"src/copy.ts": "export function other(q) {\n  return q.items.map(x => x * 2).filter(Boolean);\n}\n"})
    assert check(capsys, repo)[0] == 0
    # edited in place
    write(repo, {"src/copy.ts": "", "src/original.ts": TS.format(**{**A, "k": 999})})
    assert check(capsys, repo)[0] == 0
    # moved: the original is gone from its file
    write(repo, {"src/original.ts": "export const y = 2;\n", "src/moved.ts": TS.format(**B)})
    assert check(capsys, repo)[0] == 0
    # staged copies are looked at alone
    git(repo, "checkout", "-q", "--", "src/original.ts")
    git(repo, "add", "src/moved.ts")
    write(repo, {"src/unstaged.ts": TS.format(**{**B, "n": "third"})})
    code, out = check(capsys, repo, "--json")
    found = json.loads(out)["findings"]
    assert code == 1 and [f["file"] for f in found] == ["src/moved.ts"] and found[0]["original_line"] == 1
    # a branch against its merge base
    git(repo, "checkout", "-q", "-b", "work")
    git(repo, "commit", "-qm", "copy")
    assert check(capsys, repo, "--diff", "main")[0] == 1


def test_history(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    root = tmp_path / "r"
    root.mkdir()
    git(root, "init", "-q", "-b", "main")
    kinds = ["totals", "merge", "window", "parse", "retry", "brackets"]
    from echofold.plans.corpus import DONORS, render
    import random

    rng = random.Random(1)
    for month in range(1, 13):
        name = kinds[month - 1] if month <= 6 else "totals"
        write(root, {f"src/m{month}.py": render(DONORS[name], rng, 2)[1]})
        git(root, "add", "-A")
        git(root, "commit", "-qm", "m", date=f"2024-{month:02d}-15T12:00:00+0000")
    code = cli.main(["history", str(root), "--min-tokens", "20", "--json"])
    doc = json.loads(capsys.readouterr().out)
    values = [p["slop_percent"] for p in doc["series"]]
    assert code == 0 and len(values) == 12 and values[0] == 0.0 and values[-1] > 20 and doc["growth_since"].startswith("2024-0") and doc["series"][0]["date"] == "2024-01"
    assert (tmp_path / "echofold-card.svg").read_text().startswith("<svg")
    chart = "\n".join(R.history_lines(doc))
    assert "in 12 snapshots" in chart and chart.count("%") == 14 and "from nothing to" in chart
    assert cli.main(["history", str(tmp_path / "r" / "src"), "--max-snapshots", "1", "--no-card"]) == 2


def test_not_a_repository(tmp_path, capsys):
    assert cli.main(["check", str(tmp_path)]) == 2
    assert "git" in capsys.readouterr().err
    assert cli.main(["scan", str(tmp_path)]) == 2


def test_server(spark, repo):
    ask = lambda **m: server.handle({"jsonrpc": "2.0", "id": 1, **m})
    assert ask(method="initialize", params={"protocolVersion": "x"})["result"]["protocolVersion"] == "x"
    assert ask(method="ping")["result"] == {} and len(ask(method="tools/list")["result"]["tools"]) == 2
    assert ask(method="nope")["error"]["code"] == -32601
    assert ask(method="tools/call", params={"name": "zzz"})["result"]["isError"]
    assert server.handle({"method": "ping"}) is None
    out = io.StringIO()
    assert server.serve(io.StringIO('{bad\n\n{"id":2,"method":"ping"}\n'), out) == 0
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert lines[0]["error"]["code"] == -32700 and lines[1] == {"jsonrpc": "2.0", "id": 2, "result": {}}
    scanned = ask(method="tools/call", params={"name": "scan_duplication", "arguments": {"path": str(repo)}})["result"]
    assert not scanned["isError"] and scanned["structuredContent"]["stats"]["files"] == 2
    write(repo, {"src/copy.ts": TS.format(**B)})
    checked = ask(method="tools/call", params={"name": "check_duplication", "arguments": {"path": str(repo)}})["result"]
    assert [f["name"] for f in checked["structuredContent"]["findings"]] == ["addUp"]

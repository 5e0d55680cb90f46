"""Git repositories as DataFrames: log, trees, blobs and diffs. Executors must see the repository under the same path."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class GitError(RuntimeError):
    pass


def git(repo: str, *args: str, text: bool = True):
    """Output of a git command; raises ``GitError`` with git's own words."""
    try:
        done = subprocess.run(["git", "-C", repo, *args], capture_output=True, check=False)
    except FileNotFoundError as e:
        raise GitError("git isn't installed") from e
    if done.returncode:
        raise GitError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode("utf-8", "replace") if text else done.stdout


def repo_root(path: str) -> str:
    try:
        return git(path, "rev-parse", "--show-toplevel").strip()
    except GitError as e:
        raise GitError(f"{path} is not inside a git repository") from e


def log(spark: SparkSession, repo: str) -> DataFrame:
    """``commit, ts`` of the mainline, ``n`` counting from the oldest."""
    rows = [line.split() for line in git(repo, "log", "--first-parent", "--reverse", "--format=%H %ct", "HEAD").splitlines()]
    return spark.createDataFrame([(i, c, int(t)) for i, (c, t) in enumerate(rows)], "n int, commit string, ts long")


def trees(repo: str, commits: DataFrame) -> DataFrame:
    """``commit, oid, file`` of the blobs of each commit of ``commits(commit)``, one git process a commit on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for commit in batch.column(0).to_pylist():
                oids, files = [], []
                for entry in git(repo, "ls-tree", "-r", "-z", commit, text=False).split(b"\0"):
                    meta, _, name = entry.partition(b"\t")
                    parts = meta.split()
                    if len(parts) == 3 and parts[1] == b"blob":
                        oids.append(parts[2].decode())
                        files.append(name.decode("utf-8", "replace"))
                yield pa.record_batch({"commit": pa.array([commit] * len(oids), pa.string()), "oid": pa.array(oids, pa.string()), "file": pa.array(files, pa.string())})

    return commits.select("commit").mapInArrow(run, "commit string, oid string, file string")


def blobs(repo: str, oids: DataFrame, most: int) -> DataFrame:
    """Adds ``content`` to the rows of ``oids(oid, ...)``: the text of the blob, null if it is missing, larger than ``most`` bytes
    or not UTF-8. One long-lived git process a task."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in oids.schema) + ", content string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        child = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for batch in batches:
                out = []
                for oid in batch.column(batch.schema.get_field_index("oid")).to_pylist():
                    child.stdin.write(f"{oid}\n".encode())
                    child.stdin.flush()
                    head = child.stdout.readline().split()
                    if len(head) != 3:
                        out.append(None)
                        continue
                    data = child.stdout.read(int(head[2]) + 1)[:-1]
                    try:
                        out.append(data.decode("utf-8") if head[1] == b"blob" and len(data) <= most else None)
                    except UnicodeDecodeError:
                        out.append(None)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "content"])
        finally:
            child.stdin.close()
            child.wait()

    return oids.mapInArrow(run, schema)


def changes(repo: str, revision: str | None = None) -> tuple[str, str, str, list[str]]:
    """(mode, base commit, unified diff without context, untracked files).

    With a revision: from the merge base to HEAD (``range``). Else what is staged, if anything is (``staged``), else the working
    tree with its untracked files (``worktree``); both against HEAD.
    """
    fmt = ("-U0", "--no-color", "--no-ext-diff", "--src-prefix=a/", "--dst-prefix=b/")
    if revision:
        base = git(repo, "merge-base", revision, "HEAD").strip()
        return "range", base, git(repo, "diff", *fmt, base, "HEAD"), []
    base = git(repo, "rev-parse", "HEAD").strip()
    staged = git(repo, "diff", "--cached", *fmt)
    if staged.strip():
        return "staged", base, staged, []
    return "worktree", base, git(repo, "diff", *fmt), [x for x in git(repo, "ls-files", "--others", "--exclude-standard", "-z").split("\0") if x]


def new_side(repo: str, mode: str, files: DataFrame) -> DataFrame:
    """``file, content`` of changed files as they are now: in HEAD, in the index or in the working tree; null if gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                try:
                    if mode == "worktree":
                        with open(os.path.join(repo, name), "rb") as f:
                            data = f.read()
                    else:
                        data = git(repo, "show", f"{'HEAD' if mode == 'range' else ''}:{name}", text=False)
                    out.append(data.decode("utf-8"))
                except (OSError, GitError, UnicodeDecodeError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["file", "content"])

    return files.select(F.col("file")).mapInArrow(run, "file string, content string")

"""Reports of scans and histories: JSON, plain text, SVG.

Spark ranks, numbers and cuts; what comes here is written out row by row as it arrives (``toLocalIterator`` holds a partition), so that a
report is as long as it is and the driver's memory isn't. ``cluster_json`` is the same as a table, for ``write.text``.
"""

from __future__ import annotations

import difflib
import html
import itertools
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import __version__
from .. import constants as K
from ..operators.clusters import cluster_order, cluster_rows, global_numbers, with_rank
from .scan import Scan


# ---- clusters as documents -----------------------------------------------------------------------------------------------

def numbered_clusters(clusters: DataFrame) -> DataFrame:
    """Adds ``id``: 1, 2, ... in the total order of clusters."""
    key = F.struct((-F.col("deletable_lines")).alias("a"), "rep_file", "rep_line", "cluster")
    return global_numbers(clusters.withColumn("_key", key), "_key", "id").drop("_key")


def cluster_json(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """``id, member, json``, ready for ``write.text``: a document for each cluster (member 0; ids in order of rank), and one for each
    member, numbered from 1. Members are documents of their own, since a cluster may hold any number of them."""
    return _documents(members, numbered_clusters(clusters))


def _documents(members: DataFrame, numbered: DataFrame) -> DataFrame:
    head = F.struct("id", "copies", "similarity", "deletable_lines", "test_only", F.when(F.col("trait_impl_only"), F.lit(True)).alias("trait_impl_only"))
    one = F.struct("file", "name", "start_line", "end_line", F.col("sig_lines").alias("lines"), "similarity", "representative", F.coalesce("is_test", F.lit(False)).alias("test"))
    rows = with_rank(members).join(numbered.select("cluster", "id"), "cluster")
    return numbered.select("id", F.lit(0).cast("long").alias("member"), F.to_json(head).alias("json")).unionByName(rows.select("id", F.col("rank").alias("member"), F.to_json(one).alias("json")))


def ranked_documents(members: DataFrame, clusters: DataFrame, *, most: int | None = None, only: int | None = None) -> Iterator[tuple[int, int, dict]]:
    """``(id, member, document)`` in order of rank: of all clusters, of the first ``most``, or of the one of rank ``only``."""
    if most is not None:
        clusters = clusters.orderBy(*cluster_order()).limit(most)
    numbered = numbered_clusters(clusters)
    if only is not None:
        numbered = numbered.where(F.col("id") == only)
    kept = members if most is None and only is None else members.join(numbered.select("cluster"), "cluster", "left_semi")
    for r in _documents(kept, numbered).orderBy("id", "member").toLocalIterator():
        yield r.id, r.member, json.loads(r.json)


def whole_clusters(rows: Iterable[tuple[int, int, dict]]) -> Iterator[dict]:
    """The documents of ``ranked_documents`` put together, one cluster in memory at a time."""
    for _, group in itertools.groupby(rows, key=lambda r: r[0]):
        (_, _, head), *rest = group
        yield head | {"members": [m for _, _, m in rest]}


# ---- JSON ----------------------------------------------------------------------------------------------------------------

def summary(scan: Scan, root: str) -> dict:
    """What precedes the clusters. Counted last of all, so that the time in it is that of the whole scan."""
    score = scan.score
    return {"schema_version": K.JSON_SCHEMA, "root": root, "stats": scan.stats | {"elapsed_ms": scan.elapsed_ms()}, "score": score}


def _sections(scan: Scan, containment: bool, most: int | None = None) -> Iterator[tuple[str, Iterator[dict]]]:
    yield "clusters", whole_clusters(ranked_documents(scan.members, scan.clusters, most=most))
    if scan.shapes:
        yield "class_shapes", whole_clusters(ranked_documents(scan.shape_members, cluster_rows(scan.shape_members)))
    if containment:
        yield "containment", map(json.loads, scan.containment.toJSON().toLocalIterator())


def report(scan: Scan, root: str, *, most: int | None = None, containment: bool = False) -> dict:
    """The report as one document, for callers that ask for one; ``most`` cuts the clusters (in Spark) to the first in rank."""
    found = {k: list(v) for k, v in _sections(scan, containment, most)}
    return summary(scan, root) | {k: v for k, v in found.items() if v or k == "clusters"}


def stream_json(scan: Scan, root: str, write: Callable[[str], object], *, containment: bool = False) -> None:
    """The whole report as one JSON document, written piece by piece."""
    pad = lambda text, by: text.replace("\n", "\n" + " " * by)
    scan.score  # noqa: B018 - clusters are made before time is read
    head = json.dumps(summary(scan, root), indent=2, ensure_ascii=False)
    write(head[: head.rindex("\n")])
    for name, documents in _sections(scan, containment):
        first = next(documents, None)
        if first is None and name != "clusters":
            continue
        write(f',\n  "{name}": [')
        for i, d in enumerate(itertools.chain([first] if first else [], documents)):
            write(("," if i else "") + "\n    " + pad(json.dumps(d, indent=2, ensure_ascii=False), 4))
        write("\n  ]" if first else "]")
    write("\n}\n")


# ---- text ----------------------------------------------------------------------------------------------------------------

def shortened(text: str, most: int, *, end: bool = True) -> str:
    """At most so many characters, the last ones (or the first) given up for a sign of it."""
    if len(text) <= most:
        return text
    kept = most - 1
    return text[:kept] + "…" if end else "…" + text[len(text) - kept :]


def gauge(share: float, cells: int = 9) -> str:
    """A bar of eighths of cells."""
    full, rest = divmod(int(min(1.0, max(0.0, share)) * cells * 8 + 0.5), 8)
    return "█" * full + K.BAR_EIGHTHS[rest]


def _took(ms: int) -> str:
    return f"{ms} ms" if ms < 1000 else f"{ms / 1000:.1f} s"


def head_lines(head: dict) -> Iterator[str]:
    s, sc = head["stats"], head["score"]
    yield f"echofold {__version__} on {head['root']}"
    yield f"  score      {sc['slop_percent']:.1f} % of the code repeats other code: grade {sc['grade']}"
    yield f"  to delete  {sc['deletable_lines']:,} of {s['significant_lines']:,} significant lines, if one copy of each cluster stays"
    yield f"  read       {s['files']:,} files, {s['total_lines']:,} lines, {s['functions']:,} functions, {_took(s['elapsed_ms'])}"
    left = [f"{s[k]:,} {k.removeprefix('skipped_').replace('_', '-')}" for k in ("skipped_generated", "skipped_minified", "skipped_non_utf8") if s[k]]
    if left:
        yield "  left out   " + ", ".join(left)


def _notes(c: dict) -> str:
    return "; all in tests, not counted" if c["test_only"] else "; all of traits, not counted" if c.get("trait_impl_only") else ""


def cluster_lines(rows: Iterable[tuple[int, int, dict]], unit: str = "lines") -> Iterator[str]:
    """A heading for a cluster, a row for a member: what it is (kept, or how similar to what is kept), place, name, size."""
    for id, member, d in rows:
        if not member:
            yield ""
            yield f"[{id}] {d['copies']} alike at {d['similarity']:.0%}" + (f", {d['deletable_lines']:,} lines to delete{_notes(d)}" if unit == "lines" else "")
        else:
            sign = "keep".ljust(14) if d["representative"] else f"{d['similarity']:>4.0%} {gauge(d['similarity']):<9}"
            yield f"    {sign}  {shortened(d['file'], 60, end=False)}:{d['start_line']}  {shortened(d['name'], 40)}  ({d['lines']} {unit})"


def text_report(scan: Scan, root: str, *, show_all: bool = False, containment: bool = False) -> Iterator[str]:
    """The report's lines: the first clusters, or all of them, and what is left unsaid."""
    most = None if show_all else K.TOP_CLUSTERS
    head = summary(scan, root)
    total = scan.clusters.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("deletable_lines"), F.lit(0)).alias("lines")).first()
    yield from head_lines(head)
    shown = lines = 0
    def counted():
        nonlocal shown, lines
        for id, member, d in ranked_documents(scan.members, scan.clusters, most=most):
            if not member:
                shown, lines = shown + 1, lines + d["deletable_lines"]
            yield id, member, d
    yield from cluster_lines(counted())
    yield ""
    if not total.n:
        yield "Nothing is repeated."
    elif total.n > shown:
        yield f"{total.n - shown:,} more of {total.n:,} clusters, with {total.lines - lines:,} lines to delete: --all lists them, --explain N compares the copies of one."
    if scan.shapes:
        yield from ("", "Types with like members (an experiment, not part of the score)")
        found = False
        for line in cluster_lines(ranked_documents(scan.shape_members, cluster_rows(scan.shape_members)), "members"):
            found = True
            yield line
        if not found:
            yield "    none"
    if containment:
        yield from ("", "Functions copied into larger ones (an experiment, not part of the score)")
        none = True
        for r in scan.containment.toLocalIterator():
            none = False
            yield f"    {r.containment:>4.0%} of {_place(r.contained)} stands in {_place(r.container)}"
        if none:
            yield "    none"


def _place(side) -> str:
    return f"{side['name']} ({shortened(side['file'], 60, end=False)}:{side['start_line']}, {side['lines']} lines)"


# ---- copies side by side ---------------------------------------------------------------------------------------------------

_PIECE = re.compile(r"\w+|\s+|.")


def marked(old: str, new: str) -> tuple[str, str]:
    """Two lines with what differs between them in ``⟦⟧``."""
    a, b = _PIECE.findall(old), _PIECE.findall(new)
    left, right = [], []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        for pieces, out in ((a[i:j], left), (b[k:m], right)):
            text = "".join(pieces)
            out.append(text if op == "equal" or not text else f"⟦{text}⟧")
    return "".join(left), "".join(right)


def aligned(a: list[str], b: list[str], context: int = 3) -> Iterator[tuple[int | None, str, int | None, str, bool] | int]:
    """Pairs of lines as ``(number, left, number, right, equal)``, sides without a partner being empty; a bare number stands for so many
    equal lines that are further than ``context`` from any difference."""
    codes = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    for n, (op, i, j, k, m) in enumerate(codes):
        if op == "equal":
            before, after = context * (n > 0), context * (n + 1 < len(codes))
            hidden = j - i - before - after
            for d in range(j - i):
                if hidden > 0 and d == before:
                    yield hidden
                if hidden <= 0 or d < before or d >= before + hidden:
                    yield i + d + 1, a[i + d], k + d + 1, b[k + d], True
            continue
        for x, y in itertools.zip_longest(range(i, j), range(k, m)):
            left, right = a[x] if x is not None else "", b[y] if y is not None else ""
            if x is not None and y is not None:
                left, right = marked(left, right)
            yield (x + 1 if x is not None else None), left, (y + 1 if y is not None else None), right, False


def explain(members: Iterable[dict], read: Callable[[str], str], *, full: bool = False, columns: int = 80) -> Iterator[str]:
    """The copies of a cluster (the kept one first) compared with the kept one: in one column with signs, from 120 columns on in two; with
    ``full`` the bodies themselves. ``read(file)`` gives a file's text."""
    body = lambda m: read(m["file"]).expandtabs(4).splitlines()[m["start_line"] - 1 : m["end_line"]]
    title = lambda m: f"{m['name']}  {m['file']}:{m['start_line']}-{m['end_line']}"
    kept: list[str] = []
    for n, m in enumerate(members):
        text = body(m)
        if not n:
            kept, first = text, m
            yield "kept: " + title(m)
        else:
            yield f"{m['similarity']:.0%} alike: " + title(m)
        if full or not n:
            yield from (f"{m['start_line'] + i:>6}  {x}" for i, x in enumerate(text))
        else:
            yield from (two_columns if columns >= 120 else one_column)(aligned(kept, text), first["start_line"] - 1, m["start_line"] - 1, columns)
        yield ""


def one_column(rows, a: int, b: int, columns: int) -> Iterator[str]:
    number = lambda n, by: f"{n + by:>5}" if n else " " * 5
    for r in rows:
        if isinstance(r, int):
            yield f"{'':13}({r} equal lines)"
            continue
        i, left, j, right, equal = r
        if equal:
            yield f"{number(i, a)} {number(j, b)}  {left}"
        else:
            if i:
                yield f"{number(i, a)} {number(None, 0)} -{left}"
            if j:
                yield f"{number(None, 0)} {number(j, b)} +{right}"


def two_columns(rows, a: int, b: int, columns: int) -> Iterator[str]:
    half = (columns - 15) // 2
    for r in rows:
        if isinstance(r, int):
            yield f"({r} equal lines)".center(columns).rstrip()
            continue
        i, left, j, right, equal = r
        for n, (x, y) in enumerate(itertools.zip_longest(wrap(left, half), wrap(right, half), fillvalue="")):
            numbers = [f"{v + by:>5}" if v and not n else " " * 5 for v, by in ((i, a), (j, b))]
            yield f"{numbers[0]} {x}{' ' * (half - display_width(x))} {' ' if equal else '≠'} {numbers[1]} {y}".rstrip()


def display_width(text: str) -> int:
    """Columns a terminal needs: two for wide characters, none for those that combine with another."""
    return sum(0 if unicodedata.combining(c) else 1 + (unicodedata.east_asian_width(c) in "WF") for c in text)


def wrap(line: str, columns: int) -> list[str]:
    """A line in pieces of at most so many columns, tabs as four spaces; an empty line is one empty piece."""
    pieces, width = [""], 0
    for c in line.expandtabs(4):
        w = display_width(c)
        if width + w > columns and pieces[-1]:
            pieces.append("")
            width = 0
        pieces[-1] += c
        width += w
    return pieces


# ---- history -------------------------------------------------------------------------------------------------------------

def growth(h: dict) -> str:
    """What the series says in a sentence."""
    now, since = h["series"][-1]["slop_percent"], h["growth_since"]
    if not since:
        return "No growth to speak of."
    return f"Since {since} it has grown {h['growth_factor']:.1f} times." if h["growth_factor"] is not None else f"Since {since} it has gone from nothing to {now:.1f} %."


def history_lines(h: dict, cells: int = 40) -> Iterator[str]:
    """A row a snapshot, the bars in eighths of cells, measured by the highest."""
    points = h["series"]
    top = max(p["slop_percent"] for p in points) or 1.0
    yield f"echofold {__version__}: repeated code of {h['repo']} in {len(points)} snapshots"
    for p in points:
        mark = "<" if p["date"] == h["growth_since"] else ""
        yield f"  {p['date']}  {p['commit'][:10]}  {p['slop_percent']:>5.1f} %  {gauge(p['slop_percent'] / top, cells)}{mark}"
    yield f"Now {points[-1]['slop_percent']:.1f} %, grade {h['current_grade']}. {growth(h)}"


# ---- cards ---------------------------------------------------------------------------------------------------------------

# Size of a card for link previews; inks by grade.
_WIDTH, _HEIGHT = 1200, 630
_INK = {"A": "#1a7f37", "B": "#4c8c2b", "C": "#9a6700", "D": "#bc4c00", "F": "#cf222e"}


def _svg(*parts: str) -> str:
    style = "text{font-family:sans-serif;fill:#24292f}.small{font-size:26px}.big{font-size:46px;font-weight:600}"
    return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {_WIDTH} {_HEIGHT}" width="{_WIDTH}" height="{_HEIGHT}">', f"<style>{style}</style>", f'<rect width="{_WIDTH}" height="{_HEIGHT}" fill="#fff"/>', *parts, "</svg>", ""])


def _text(x: float, y: float, text: str, kind: str = "small", **more: str) -> str:
    extra = "".join(f' {k}="{v}"' for k, v in more.items())
    return f'<text class="{kind}" x="{x:g}" y="{y:g}"{extra}>{html.escape(text)}</text>'


def score_card(head: dict) -> str:
    """A bar for all significant lines, the part that could go filled in, and the bounds of the grades above it."""
    sc, s = head["score"], head["stats"]
    left, wide, top, tall = 80, _WIDTH - 160, 330, 70
    most = max(2 * K.GRADES[-1][0], sc["slop_percent"] * 1.1)
    at = lambda v: left + wide * min(v, most) / most
    bounds = [f'<path d="M{at(b):.0f} {top - 20}V{top + tall}" stroke="#8c959f" stroke-dasharray="4 6"/>' + _text(at(b) - 8, top - 30, g, **{"text-anchor": "end"}) for b, g in K.GRADES]
    return _svg(
        _text(left, 110, head["root"], "big"), _text(left, 170, f"{s['functions']:,} functions in {s['files']:,} files"),
        f'<rect x="{left}" y="{top}" width="{wide}" height="{tall}" rx="8" fill="#eaeef2"/>', f'<rect x="{left}" y="{top}" width="{at(sc["slop_percent"]) - left:.0f}" height="{tall}" rx="8" fill="{_INK[sc["grade"]]}"/>', *bounds,
        _text(left, 480, f"Grade {sc['grade']}: {sc['slop_percent']:.1f} % repeated", "big"), _text(left, 540, f"{sc['deletable_lines']:,} of {s['significant_lines']:,} lines could be deleted"))


def history_card(h: dict) -> str:
    """Columns, one a snapshot; those from where growth is counted in the grade's ink."""
    points, ink = h["series"], _INK[h["current_grade"]]
    left, wide, floor, tall = 80, _WIDTH - 160, 470, 250
    top, step = max(p["slop_percent"] for p in points) or 1.0, wide / len(points)
    grown = h["growth_since"] or "~"
    columns = [f'<rect x="{left + i * step + step * 0.1:.1f}" y="{floor - (t := max(2.0, tall * p["slop_percent"] / top)):.1f}" width="{step * 0.8:.1f}" height="{t:.1f}" fill="{ink if p["date"] >= grown else "#8c959f"}"/>' for i, p in enumerate(points)]
    return _svg(_text(left, 110, h["repo"], "big"), _text(left, 165, f"Grade {h['current_grade']}: {points[-1]['slop_percent']:.1f} % repeated"), *columns,
                _text(left, floor + 40, points[0]["date"]), _text(left + wide, floor + 40, points[-1]["date"], **{"text-anchor": "end"}), _text(left, 575, growth(h)))

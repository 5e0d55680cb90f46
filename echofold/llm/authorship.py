"""Generated, minified and vendored source files, and data saved as code.

Each file gets a Re-Pair grammar of its token classes (identifiers, numbers and strings are one class each, comments are
left out). Hand-written code repeats statements, but not stretches of many statements: where most of a file lies in rules
of two dozen tokens and more, a tool wrote it, or it is a table. Literals whose own grammar saves nothing over their alphabet are
blobs. What repositories share shows copies that were taken over: rules over whole lines that turn up in several of them, and names of
packages, learnt from paths, which a file's first comments cite with a version. Next to the grammars stand the plain signs: places and names of
files, the usual wording of notices in the first comments, and code without white space.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, small, spread
from ..sources.tables import compared_path
from .hashing import U64, mix
from .repair import repair

# Places and names that tell where a file comes from, in the compared form of paths.
VENDORED_PATH = re.compile(
    r"(?i)(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|vendor|third[_-]?party|3rd[_-]?party|pods|carthage)/"
    r"|/[\w.@-]*[a-z][\w.@-]*-v?\d+\.\d+(?:\.\d+)*/|(?:^|/)[a-z][\w.]*(?:-[a-z][\w.]*)*-v?\d+(?:\.\d+)+(?:[.-]min)?\.\w+$"
)
GENERATED_PATH = re.compile(
    r"(?i)(?:^|/)(?:__generated__|generated|auto-?gen(?:erated)?|codegen(?:-out)?|\.next|\.nuxt)/|^(?:dist|build|out|target)/"
    r"|\.(?:generated|gen|g|pb|designer|bundle|freezed)\.\w+$|_(?:pb2|pb2_grpc|pb|generated|autogen)\.\w+$"
)
MINIFIED_PATH = re.compile(r"(?i)[.-]min\.\w+$")
# How notices are put, as classes of words: what is spoken of, what was done to it, how, by what, and what a change is worth.
_SELF = r"(?:code|file|source|class|module|client|stub|datei|fichier|archivo|файл)s?"
_MADE = r"(?:generated|created|produced|emitted|written|built|derived|generiert|erzeugt|erstellt|généré|produit|genere|generado|сгенерирован\w*)"
_HOW = r"(?:auto|automatically|machine|automatisch|automatiquement|automáticamente|автоматически)"
_BY = r"(?:by|from|with|using|out of|of|mit|aus|von|par|depuis|por|desde|de|из)"
_IS = r"(?:is|was|were|has been|have been|wurde|est|a été|fue|был)"
BY_HAND = re.compile(r"(?i)hand-?written|\b(?:written|maintained|made|kept) by hand\b")
GENERATED_NOTE = re.compile("|".join([
    rf"(?i)@generated\b|<auto-?generated|\b{_HOW}[- ]?{_MADE} (?:{_BY}|{_SELF})\b|\b{_MADE} {_HOW}\b",
    rf"\b{_SELF} (?:{_IS} )?(?:{_HOW}[- ]?)?{_MADE}\b",
    rf"^\W*(?:{_HOW}[- ]?)?(?:{_MADE}|output|ausgabe|sortie)(?: {_HOW})? {_BY}\b",
    rf"^\W*(?:this is )?(?:an? )?(?:{_HOW}[- ]?)?{_MADE} {_SELF}\b|\bmachine[- ](?:written|made)\b|自動生成",
    r"\b(?:do not|don't|never) (?:edit|modify|change)(?: (?:it|this|this file|the file|by hand|manually|directly))*\s*(?:[.!;*]|-->|$)",
    r"\b(?:changes?|edits?|modifications?)\b[^.;]*\b(?:lost|overwritten|discarded|survive)\b(?!-)",
    r"\bnicht (?:von hand|manuell) \w+|\bne pas (?:modifier|éditer)\b|\bno (?:modificar|editar)\b|\bне (?:редактировать|изменять)\b",
]))
VENDORED_NOTE = re.compile(r"(?i)\bvendored\b|\bthird[- ]party (?:code|file|source|library)|^\W*[\w.@/-]+ v?\d+(?:\.\d+)+ \| (?:\(c\)|©|copyright)")
#: A package's name in a path: what follows a vendored place, or stands before a version.
_PACKAGE = re.compile(
    r"(?i)(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|vendor|third[_-]?party|3rd[_-]?party|pods|carthage)/((?:@[\w.-]+/)?[a-z][\w.]*(?:-[a-z][\w.]*)*)"
    r"|/([\w.@]*?[a-z][\w.@]*?(?:-[a-z][\w.@]*?)*)-v?\d+\.\d+(?:\.\d+)*(?:[.-]min)?(?:/|\.\w+$)"
)
_VERSION = re.compile(r"(?i)(?<![\d.])v?\d+\.\d+|\brev(?:ision)?\.? ?\d|\bversion \d")
_CITED = re.compile(r"(?:@[\w.-]+/)?[a-z][\w.]*(?:-[a-z][\w.]*)*")
#: A line of such words names a package without being taken from it.
_APART = re.compile(r"(?i)\b(?:inspired|modelled|ours|own|rewrit\w+|rewrote|replac\w+|instead|compatible|similar|unlike|requires?|needs?|uses?|wraps?|tested)\b")

_LINE = re.compile(r"\r\n|\r|\n")
_COMMENT_LINE = re.compile(r"[ \t]*(?://|#(?!include|define|if|endif)|/\*|\*(?!\w)|--|;;|<!--|'''|\"\"\")")
_BLOCK = re.compile(r"[ \t]*(/\*|<!--|'''|\"\"\")")
_COMMENTS = re.compile(r"(?m)^[ \t]*(?://|#(?!include|define|if|endif)|--|;;|\*(?!\w)|/\*).*$|/\*[^*]*\*/")
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')
# Literals over many lines, tried before those of one line: triple quotes, raw strings of C++ and Rust, template literals.
_LONG = r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""|\bR"(?P<c>[^()\\\s"]{0,16})\((?s:.*?)\)(?P=c)"|\bb?r(?P<r>#+)"(?s:.*?)"(?P=r)'
_SINGLES = r"|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''"
_BACKTICKS = r"|`(?:[^`\\]++|\\[\s\S])*+`"
_LITERAL = {(s, b): re.compile(_LONG + _SINGLES * s + _BACKTICKS * b + "|" + _STRING.pattern) for s in (False, True) for b in (False, True)}
# where a backtick opens a string (elsewhere it quotes names or runs commands), and where three single quotes don't
_TEMPLATES = re.compile(r"(?i)\.(?:[cm]?[jt]s|[jt]sx|vue|svelte|go)$|(?:^|/)[^./]*$")
_DOUBLED = re.compile(r"(?i)\.(?:sql|ddl|psql|vb|bas)$")
_HEREDOC = re.compile(r"<<(<?[-~]?)[ \t]*([\"']?)([A-Za-z_]\w*)\2")
_HEREDOC_END = re.compile(r"(?m)^([ \t]*)([A-Za-z_]\w*)([;)]*)[ \t]*$")
_OPENS = re.compile(r'"""|\'\'\'|`|<<|\bR"|\br#|\bbr#')
_LAYOUT = re.compile(r"\s*\n\s*")
_IDENT = re.compile(r"[^\W\d]\w*(?:[ \t]+[^\W\d]\w*)*")
_NUMBER = re.compile(r"[-+]?\d[\w.]*")
_SWITCH = re.compile(r"[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])")
_WHITE = re.compile(r"\s+")
_NAME = re.compile(r"[^\W\d]\w*")


def path_kind(path: str | None) -> str | None:
    """What a file's place and name (in the compared form) say; None if nothing."""
    if not path:
        return None
    if VENDORED_PATH.search(path):
        return "vendored"
    if MINIFIED_PATH.search(path):
        return "minified"
    return "generated" if GENERATED_PATH.search(path) else None


def head_comments(text: str, code_lines: int = 5) -> list[str]:
    """The lines of the comments with which a file begins, which is where a notice stands: those before its first ``code_lines`` lines
    of code. Block comments and docstrings are comments on all their lines."""
    found, code = [], 0
    at = 0
    inside = 0  # where the block comment or docstring that is open ends
    while at < len(text) and code < code_lines:
        end = text.find("\n", at)
        line = text[at : end if end >= 0 else len(text)]
        if at >= inside and (m := _BLOCK.match(line)):
            close = "*/" if m[1] == "/*" else "-->" if m[1] == "<!--" else m[1]
            inside = max(inside, text.find(close, at + m.end()))
        if at < inside or _COMMENT_LINE.match(line):
            found.append(line)
        elif line.strip():
            code += 1
        at += len(line) + 1
    return found


def note_kind(text: str) -> str | None:
    """What the comments say with which a file begins, in the usual words of notices."""
    for line in head_comments(text):
        if not BY_HAND.search(line):
            if GENERATED_NOTE.search(line):
                return "generated"
            if VENDORED_NOTE.search(line):
                return "vendored"
    return None


def package_of(path: str | None) -> str | None:
    """The package that a path names, in lower case."""
    m = _PACKAGE.search(path or "")
    return (m[1] or m[2]).lower() if m else None


def cited_names(text: str) -> list[str]:
    """What the comments at the beginning name beside a version, in lower case: packages, should one of the words be one."""
    lines = [x.lower() for x in head_comments(text) if _VERSION.search(x) and not _APART.search(x)]
    return sorted({w.rstrip(".") for x in lines for w in _CITED.findall(x) if len(w) > 2})


def incompressible(literals: str) -> float:
    """Bits of the Re-Pair grammar of a text against those its alphabet alone would take: near 1 or above for noise."""
    raw = np.frombuffer(literals.encode("utf-8", "replace"), dtype=np.uint8)
    if len(raw) < 64:
        return 0.0
    names, codes = np.unique(raw, return_inverse=True)
    if len(names) < 2:
        return 0.0
    g = repair(codes.astype(np.int64), np.array([len(codes)]))
    rules = int(g.rules[0])
    coded = (len(g.symbol) + 2 * rules) * math.log2(len(names) + rules)
    return coded / (len(codes) * math.log2(len(names)))


def _heredocs(code: str) -> tuple[str, list[str]]:
    """A text with a quote sign for the body of every heredoc, and the bodies. The end of one stands alone in its line, and
    unindented unless the opening (``<<-``, ``<<~``, ``<<<``) allows else; without an end it is a shift."""
    words = {m[3] for m in _HEREDOC.finditer(code)}
    ends: dict[tuple[str, bool], list[int]] = {}
    for m in _HEREDOC_END.finditer(code) if words else ():
        if m[2] in words:
            ends.setdefault((m[2], True), []).append(m.start())
            if not m[1] and not m[3]:
                ends.setdefault((m[2], False), []).append(m.start())
    kept, bodies, at = [], [], 0
    for m in _HEREDOC.finditer(code) if ends else ():
        body = code.find("\n", m.end()) + 1
        close = ends.get((m[3], bool(m[1])), [])
        i = bisect_left(close, body)
        if m.start() >= at and body and i < len(close):
            kept += [code[at:body], '"\n']
            bodies.append(code[body : close[i]])
            at = close[i]
    return ("".join(kept) + code[at:], bodies) if bodies else (code, [])


def long_literals(path: str | None, code: str) -> tuple[int, str]:
    """How many characters of a text lie in literals, those over many lines too, and their contents without line ends and indents."""
    outside, bodies = _heredocs(code) if "<<" in code else (code, [])
    pattern = _LITERAL[not _DOUBLED.search(path or ""), "`" in code and bool(_TEMPLATES.search(path or ""))]
    found = [m[0] for m in pattern.finditer(outside)]
    inner = [x[3:-3] if x.startswith(('"""', "'''")) else x[1:-1] for x in found] + bodies
    return sum(map(len, found + bodies)), "".join(_LAYOUT.sub("", x) if "\n" in x else x for x in inner)


def _noise(literals: str) -> float:
    # words, however many, keep to one kind of letter; encoded bytes switch all the time
    return incompressible(literals) if literals and len(_SWITCH.findall(literals)) > 0.1 * len(literals) else 0.0


def _blocks(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rules over whole lines: blocks between lines whose hash is a local minimum, so that equal stretches of two files are
    cut alike whatever stands around them. Hash and number of lines of every inner block."""
    if len(lines) < 8:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = mix(np.array([hash_text(x) for x in lines], dtype=np.uint64))
    cut = np.flatnonzero((h[1:-1] < h[:-2]) & (h[1:-1] <= h[2:])) + 1
    if len(cut) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        weights = h * (np.arange(len(h), dtype=np.uint64) * U64(2) + U64(1))
        sums = np.add.reduceat(h, cut)[:-1]
        # positions count from the block's own beginning
        firsts = np.add.reduceat(weights, cut)[:-1] - sums * (cut[:-1].astype(np.uint64) * U64(2))
        rule = mix(sums * U64(7) + firsts)
    return rule.view(np.int64), np.diff(cut)


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


FEATURES = {
    "path_kind": "string", "package": "string", "note_kind": "string", "tokens": "int", "deep24": "double", "coded": "double",
    "white": "double", "short_names": "double", "literals": "double", "noise": "double", "lines": "int", "quoted": "double",
}


def batch_features(paths: list, contents: list) -> tuple[list[list], list[np.ndarray], list[np.ndarray], list[list[str]]]:
    """Columns of ``FEATURES``, the line rules (hashes, lengths) and the cited names of a batch of files; null content has null features."""
    rows, sequences, rules, lengths, cited = [], [], [], [], []
    for path, content in zip(paths, contents, strict=True):
        kind = path_kind(path)
        if content is None:
            rows.append([kind, package_of(path), *[None] * (len(FEATURES) - 2)])
            cited.append([])
            rules.append(np.zeros(0, np.int64))
            lengths.append(np.zeros(0, np.int64))
            continue
        text = _LINE.sub("\n", content) if "\r" in content else content
        code = _COMMENTS.sub("", text)
        bare = _STRING.sub('"', code)
        literal = len(code) - len(bare)
        squeezed = _WHITE.sub("", bare)
        share = literal / max(1, len(code))
        digits = len(bare) - len(bare.encode("ascii", "replace").translate(None, b"0123456789"))
        literals = "".join(x[1:-1] for x in _STRING.findall(code)) if share > 0.4 else ""
        noise = _noise(literals)
        # literals over many lines stay in the grammar, which sees what is regular in them
        quoted = share
        if _OPENS.search(code):
            size, literals = long_literals(path, code)
            quoted = max(share, size / len(code))
            noise = max(noise, _noise(literals)) if quoted > 0.4 else noise
        names = short = 0
        if len(squeezed) > 0.88 * len(bare):
            for m in _NAME.finditer(bare):
                names += 1
                short += m.end() - m.start() <= 2
        sequences.append((len(rows), np.frombuffer(_NUMBER.sub("0", _IDENT.sub("i", bare)).translate(_DROP).encode("ascii", "replace"), dtype=np.uint8)))
        body = [x for x in (y.strip() for y in code.split("\n")) if x]
        rule, length = _blocks(body)
        rules.append(rule)
        lengths.append(length)
        cited.append(cited_names(text))
        rows.append([kind, package_of(path), note_kind(text), 0, 0.0, 0.0, 1 - len(squeezed) / max(1, len(bare)), short / max(1, names),
                     (literal + digits) / max(1, len(code)), noise, len(body), max(quoted, (literal + digits) / max(1, len(code)))])
    sizes = np.array([len(s) for _, s in sequences], dtype=np.int64)
    if sizes.sum():
        g = repair(np.concatenate([s for _, s in sequences]).astype(np.int64), sizes)
        deep24, coded = g.covered(24), g.coded()
        for j, (i, _) in enumerate(sequences):
            rows[i][3:6] = [int(sizes[j]), float(deep24[j]), float(coded[j])]
    return rows, rules, lengths, cited


_DROP = {c: None for c in map(ord, " \t\n\r\f\v")}


#: Characters of content that are looked at together (a longer file is alone): bounds the memory of the grammars' arrays.
BATCH_CHARS = 4_000_000


def _slices(contents: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, rows) of runs of rows that hold at most ``BATCH_CHARS`` bytes together."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(contents), 0)).astype(np.int64)
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and (held + n > BATCH_CHARS or i - first >= 4096):
            yield first, i - first
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes) - first


def _lists(parts: list, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in parts]))).astype(np.int32))
    flat = [x for r in parts for x in r] if pa.types.is_string(kind) else np.concatenate(parts)
    return pa.ListArray.from_arrays(offsets, pa.array(flat, kind))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = list(FEATURES), {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    for batch in batches:
        for first, count in _slices(batch.column("content")):
            part = batch.slice(first, count)
            rows, rules, lengths, cited = batch_features(part.column("path").to_pylist(), part.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("file_id"), part.column("repo"), *(pa.array([r[j] for r in rows], types[FEATURES[n]]) for j, n in enumerate(names)),
                 _lists(rules, pa.int64()), _lists(lengths, pa.int64()), _lists(cited, pa.string())],
                names=["file_id", "repo", *names, "rules", "rule_lines", "cited"])


def file_features(files: DataFrame) -> DataFrame:
    """``file_id, repo``, the columns of ``FEATURES``, ``rules``, ``rule_lines`` and ``cited`` of every row of ``files(file_id, repo, path, content)``."""
    fields = ", ".join(f"{n} {t}" for n, t in FEATURES.items())
    return spread(files.select("file_id", "repo", compared_path(F.col("path")).alias("path"), "content"), "file_id").mapInArrow(
        _featurize, f"file_id long, repo string, {fields}, rules array<long>, rule_lines array<long>, cited array<string>")


def grammar_kind() -> F.Column:
    """The verdict of a file's own features; null for hand-written ones."""
    # a small table in front of a short function comes close to the second; it consists of literals
    deep = (F.col("deep24") > 0.8) | ((F.col("deep24") > 0.6) & (F.col("tokens") * (1 - F.col("deep24")) < 50) & (F.col("literals") < 0.2))
    return (
        F.when(F.col("path_kind").isNotNull(), F.col("path_kind"))
        .when(F.col("note_kind").isNotNull(), F.col("note_kind"))
        .when((F.col("white") < 0.12) & (F.col("short_names") > 0.5) & (F.col("tokens") >= 40), "minified")
        .when(((F.col("quoted") > 0.5) & (F.col("noise") > 0.85)) | ((F.col("literals") > 0.5) & deep), "data")
        .when(deep & (F.col("tokens") >= 48), "generated")
    )


def not_hand_written(files: DataFrame, *, min_repos: int = 3, shared_share: float = 0.5, min_lines: int = 20, package_repos: int = 2) -> DataFrame:
    """``file_id, kind`` (generated, minified, vendored, data) of the files that nobody of the project wrote.

    Of several rows of a file one verdict is enough (ties: the least kind); rows without ``file_id`` are ignored. A file without
    content is judged by its path alone, an empty one too. A file of at least ``min_lines`` lines is vendored, too, if more than
    ``shared_share`` of them lie in rules that ``min_repos`` repositories have, in files of whatever verdict and length; and so is one whose
    first comments name, with a version, a package that the paths of ``package_repos`` repositories name. What travels between tasks
    are rule hashes and names, never contents.
    """
    features = file_features(files.where("file_id is not null")).withColumn("kind", grammar_kind())
    kept = materialize(features.select("file_id", "repo", "kind", "package", "cited", "lines", "rules", "rule_lines"), "file-features")
    held = kept.select("file_id", "repo", "kind", "lines", F.explode(F.arrays_zip("rules", "rule_lines")).alias("r")).select("file_id", "repo", "kind", "lines", F.col("r.rules").alias("rule"), F.col("r.rule_lines").alias("n"))
    # distinct (rule, repository) first, so that a rule that very many files have is counted from few rows
    common = held.select("rule", "repo").distinct().groupBy("rule").agg(F.count(F.lit(1)).alias("repos")).where(F.col("repos") >= min_repos).select("rule")
    owned = held.where((F.col("lines") >= min_lines) & F.col("kind").isNull()).select("file_id", "repo", "lines", "rule", "n")
    copies = owned.join(common, "rule").groupBy("file_id", "repo", "lines").agg(F.sum("n").alias("shared")).where(F.col("shared") > F.col("lines") * shared_share)
    packages = kept.where("package is not null").select("package", "repo").distinct().groupBy("package").agg(F.count(F.lit(1)).alias("repos")).where(F.col("repos") >= package_repos).select("package")
    # packages are few beside files: their names are broadcast while they are (counted), and the citing files aren't shuffled
    taken = kept.where("kind is null").select("file_id", F.explode("cited").alias("package")).join(small(packages, 100_000), "package", "left_semi")
    return (
        kept.where("kind is not null").select("file_id", "kind").unionByName(copies.unionByName(taken, allowMissingColumns=True).select("file_id", F.lit("vendored").alias("kind")))
        .groupBy("file_id").agg(F.min("kind").alias("kind"))
    )

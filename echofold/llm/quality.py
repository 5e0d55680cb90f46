"""Per-document text quality of mail: statistics, repetition, and whether the sender wrote natural prose.

Everything is decided on the sender's own words (``mail.own_words``), in two passes over them. The first counts over the whole
corpus, with map-side combine, in how many documents every paragraph stands and in how many paragraphs of running text and
of other shape every word. Paragraphs of very many documents are boilerplate (notices, standing phrases) and say nothing about the one that
ends with them. Words that come far more often in running text than elsewhere are what prose is made of (mostly function words) in
whatever languages the corpus has; no word is listed here. The second pass computes the statistics and judges by them: duplicate lines and
paragraphs, characters in the dominant n-gram, symbols, digits, broken words, lines' shape, and the share of running-text words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, spread
from .mail import body_text, own_words

#: A paragraph is boilerplate in one of so many documents, and in ``BOILERPLATE_LEAST`` at least.
BOILERPLATE_SHARE, BOILERPLATE_LEAST = 500, 5
#: A word is known to the corpus in one of so many paragraphs (so that the known words are a bounded number), and in ``WORD_LEAST`` at least.
WORD_SHARE, WORD_LEAST = 10_000, 4
#: A word belongs to running text if its share of those paragraphs is so many times that of the others.
RUNNING_ODDS = 3.0

_CJK = "぀-ヿ一-鿿"
_WORD = re.compile(rf"[{_CJK}]|[^\W\d_{_CJK}]+")
_IDEOGRAPH = re.compile(f"[{_CJK}]")
_BULLET = re.compile(r"[ \t]*(?:[-*•+·–]|\(?\w{1,3}[.)])[ \t]")
_END = re.compile(r"[.!?。！？…:;]['\"»”)\]]*$")
_SENTENCE = re.compile(r"[.!?…]['\"»”)\]]*(?=\s|$)|[。！？]")
#: Signs inside a word that don't belong there; punctuation, dashes and East Asian signs may stand without space.
_BROKEN = re.compile(r"[^\w\s'’ʼ.,;:!¿¡/&()\-\u2010-\u2026\u3000-\u303f\uff00-\uffef](?<=[^\W\d_].)[^\w\s'’ʼ.,;:!¿¡/&()\-\u2010-\u2026\u3000-\u303f\uff00-\uffef]*(?=[^\W_])")
_DIGITS = re.compile(r"\d+")
_ASCII_WORD = re.compile("[a-z]+")


def normal(paragraph: str) -> str:
    return " ".join(paragraph.split())


def paragraph_key(paragraph: str) -> int:
    key = xxhash.xxh3_64_intdigest(normal(paragraph))
    return key - (key >> 63 << 64)


class Shape:
    """What can be said of a paragraph without knowing a word."""

    def __init__(self, text: str):
        self.text = text
        self.lines = [x for x in (y.strip() for y in text.split("\n")) if x]
        self.words = (_ASCII_WORD if text.isascii() else _WORD).findall(text.lower())
        self.solid = sum(map(len, text.split())) or 1
        self.letters = sum(map(len, self.words))
        self.digits = sum(map(len, _DIGITS.findall(text)))
        self.tokens = len(text.split())
        self.cjk = len(_IDEOGRAPH.findall(text)) if not text.isascii() else 0
        self.broken = len(_BROKEN.findall(text)) / max(1, self.tokens, len(self.words) // 2)
        self.bullets = sum(1 for x in self.lines if _BULLET.match(x)) / max(1, len(self.lines))
        self.sentences = len(_SENTENCE.findall(text))

    @property
    def lettered(self) -> bool:
        return self.letters >= 0.6 * self.solid and self.broken <= 0.25

    @property
    def unforced(self) -> float:
        """Share of the line breaks that no width asked for: the next line's first word would have found room."""
        width = max(map(len, self.lines))
        return sum(1 for x, y in zip(self.lines, self.lines[1:], strict=False) if len(x) + len(y.split(None, 1)[0]) < width) / max(1, len(self.lines) - 1)

    def running(self) -> bool:
        """Surely sentences: some end inside the lines, or the lines are those of a width."""
        n = len(self.words)
        return (n >= 8 and self.letters >= 0.75 * self.solid and self.digits <= 0.08 * self.solid and self.broken <= 0.05 and self.bullets == 0 and bool(_END.search(self.lines[-1]))
                and n >= 5 * len(self.lines) and 4 * self.sentences <= n <= 60 * self.sentences and (len(self.lines) < 3 or self.unforced <= 0.2))

    def other(self) -> bool:
        """Surely no running text: many digits, symbols or bullets, or four lines and more that no width broke and that aren't a sentence each."""
        if self.letters < 0.6 * self.solid or self.digits > 0.2 * self.solid or len(self.lines) > 2 and self.bullets > 0.6:
            return True
        return len(self.lines) > 3 and self.unforced > 0.5 and (sum(1 for x in self.lines if _END.search(x)) < 0.9 * len(self.lines) or len(self.words) < 4 * len(self.lines))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """own array<string> -> (word, para, n, m): paragraphs of running text (n) and of other shape (m) a word stands in; documents (n) a
    paragraph stands in; and their totals, under an empty word. Combined per task as long as keys are few."""
    words: Counter = Counter()
    others: Counter = Counter()
    paras: Counter = Counter()
    total = [0, 0, 0]

    def flush():
        keys = list(words.keys() | others.keys())
        hashes = list(paras)
        yield pa.record_batch({
            "word": pa.array(keys + [None] * len(hashes) + ["", ""], pa.string()), "para": pa.array([None] * len(keys) + hashes + [0, 1], pa.int64()),
            "n": pa.array([words[k] for k in keys] + [paras[h] for h in hashes] + [total[0], total[2]], pa.int64()), "m": pa.array([others[k] for k in keys] + [0] * len(hashes) + [total[1], 0], pa.int64())})
        for x in (words, others, paras):
            x.clear()
        total[:] = 0, 0, 0

    for batch in batches:
        for own in batch.column(0).to_pylist():
            if not own:
                continue
            total[2] += 1
            paras.update({paragraph_key(p) for p in own})
            for p in own:
                s = Shape(p)
                if s.running():
                    total[0] += 1
                    words.update(set(s.words))
                elif s.other():
                    total[1] += 1
                    others.update(set(s.words))
        if len(words) + len(others) + len(paras) > 200_000:
            yield from flush()
    yield from flush()


class Corpus:
    """What the second pass knows of the corpus: boilerplate (hashes of paragraphs), known words, and those of running text."""

    def __init__(self, boilerplate: Iterable[int] = (), running: Iterable[str] = (), known: Iterable[str] = ()):
        self.boilerplate, self.running = frozenset(boilerplate), frozenset(running)
        self.known = frozenset(known) | self.running

    def prose(self, s: Shape) -> bool:
        """Natural sentences, in whatever case and with or without punctuation."""
        words = s.words
        if not s.lettered or len(words) < 2:
            return False
        typical = [w for w in words if w in self.running]
        share = len(typical) / len(words)
        if share >= 0.4:
            return len(set(typical)) >= (3 if len(words) >= 12 else 2 if len(words) > 4 else 1)
        if len(words) < 8 or sum(w in self.known for w in words) > 0.3 * len(words):
            return False
        # a language that the corpus hardly has: sentences by their shape, among them many short words, some of which come again
        short = [w for w in words if len(w) <= 3]
        lower = sum(x[:1].islower() for x in s.text.split())
        return s.running() and s.cjk > 0.5 * len(words) or s.running() and len(short) >= 0.2 * len(words) and lower >= 0.6 * s.tokens and (len(words) < 25 or len(set(short)) < len(short))


def corpus_of(own: DataFrame) -> Corpus:
    """The counts of a table with a column ``own array<string>``, over all rows; what is kept is bounded by shares of the totals."""
    counted = own.select("own").mapInArrow(_counter, "word string, para long, n long, m long").groupBy("word", "para").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    counted = materialize(counted, "text-counts")
    totals = {r.para: r for r in counted.where("word = ''").collect()}
    if not totals:
        return Corpus()
    running, other, documents = totals[0].n, totals[0].m, totals[1].n
    often = counted.where(F.col("word").isNull() & (F.col("n") >= max(BOILERPLATE_LEAST, documents / BOILERPLATE_SHARE))).select("para").collect()
    seen = counted.where((F.col("word") != "") & (F.col("n") + F.col("m") >= max(WORD_LEAST, (running + other) / WORD_SHARE)))
    odds = F.col("n") * (other + 1) >= RUNNING_ODDS * (F.col("m") + 0.5) * (running + 1)
    known = seen.select("word", (odds & (F.col("n") >= WORD_LEAST)).alias("typical")).collect()
    return Corpus((r.para for r in often), (r.word for r in known if r.typical), (r.word for r in known))


def ngram_cover(words: list[str], n: int) -> float:
    """Share of the words' letters in the n-gram that covers most: occurrences that don't overlap, at least two of them, else 0."""
    best = 0
    grams = list(zip(*(words[k:] for k in range(n)), strict=False))
    for gram, times in Counter(grams).items():
        if times > 1 and times * (size := sum(map(len, gram))) > best:
            if any(gram[k:] == gram[:-k] for k in range(1, n)):  # it can overlap itself
                at, times = -n, 0
                for i, x in enumerate(grams):
                    if x == gram and i >= at + n:
                        at, times = i, times + 1
            best = max(best, times * size * (times > 1))
    return best / max(1, sum(map(len, words)))


def repeated_cover(words: list[str], n: int) -> float:
    """Share of the words' letters that lie in some n-gram which stands earlier in the text, every word counted once."""
    grams = list(zip(*(words[k:] for k in range(n)), strict=False))
    seen: set[tuple] = set()
    if len(set(grams)) == len(grams):
        return 0.0
    until = covered = 0
    for i, gram in enumerate(grams):
        if gram in seen:
            covered += sum(map(len, words[max(until, i) : i + n]))
            until = i + n
        seen.add(gram)
    return covered / max(1, sum(map(len, words)))


def entropy(items: Iterable) -> float:
    """Bits an item."""
    counts = Counter(items)
    total = sum(counts.values())
    return -sum(c / total * math.log2(c / total) for c in counts.values()) if total else 0.0


STATS = {
    "own_chars": "int", "words": "int", "mean_word_length": "double", "symbol_ratio": "double", "digit_ratio": "double", "broken_words": "double", "lines_end_punctuated": "double", "words_a_line": "double",
    "common_words": "double", "bullet_lines": "double", "duplicate_lines": "double", "duplicate_paragraphs": "double", "top_2gram": "double", "top_3gram": "double", "top_4gram": "double", "repeated_5gram": "double",
    "word_entropy": "double", "letter_entropy": "double", "boilerplate": "double", "prose_share": "double", "kind": "string",
}


def text_stats(own: list[str] | None, corpus: Corpus) -> tuple | None:
    """The statistics of ``STATS`` for a sender's own paragraphs; None for those of a null text.

    ``kind``: ``empty`` (nothing of the sender's own, or boilerplate alone), ``prose``, else ``list``, ``repeated`` or ``junk``.
    """
    if own is None:
        return None
    size = lambda x: sum(map(len, x.split()))
    paras = [p for p in own if paragraph_key(p) not in corpus.boilerplate]
    whole = sum(map(size, own))
    text = "\n".join(paras)
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    solid = size(text)
    boilerplate = (whole - solid) / max(1, whole)
    if not solid:
        return (0, 0, *[0.0] * 16, boilerplate, 0.0, "empty")
    shapes = [Shape(p) for p in paras]
    words = [w for s in shapes for w in s.words]
    letters, digits = sum(s.letters for s in shapes), sum(s.digits for s in shapes)
    top2, top3, top4 = (ngram_cover(words, n) for n in (2, 3, 4))
    again = repeated_cover(words, 5)
    distinct: dict[str, bool] = {}
    prose = 0
    for s in shapes:
        p = normal(s.text)
        if p in distinct:
            prose += s.solid * (s.solid <= 40 and distinct[p])
        elif distinct.setdefault(p, corpus.prose(s)):
            prose += s.solid
    share = prose / solid
    dup_lines = 1 - len(set(lines)) / len(lines)
    bullets = sum(1 for x in lines if _BULLET.match(x)) / len(lines)
    kind = "prose" if share > 0.5 else "list" if bullets > 0.5 else "junk"
    if kind != "list" and (top2 > 0.5 and len(words) > 20 or top4 > 0.5 and len(words) > 40 or dup_lines > 0.6 and len(lines) > 4):
        kind = "repeated"
    n = len(words)
    return (
        solid, n, letters / max(1, n), max(0, solid - letters - digits) / solid, digits / solid, sum(s.broken * s.tokens for s in shapes) / max(1, sum(s.tokens for s in shapes)),
        sum(1 for x in lines if _END.search(x)) / len(lines), n / len(lines), sum(1 for w in words if w in corpus.running) / max(1, n), bullets,
        dup_lines, 1 - len(distinct) / len(paras), top2, top3, top4, again, entropy(words), entropy("".join(words)), boilerplate, share, kind,
    )


def quality(documents: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and the columns of ``STATS`` for every row; a null text has null statistics. The sender's own words are written once and
    read twice; input of fewer partitions than cores is spread. What travels between tasks are counts of words and of paragraphs' hashes."""
    names = list(STATS)
    types = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    kind = documents.schema[id].dataType.simpleString()
    rows = spread(documents.select(F.col(id).alias("id"), F.col(text).alias("text")), "id")
    own = materialize(rows.mapInArrow(_owner, f"id {kind}, own array<string>"), "own-words")
    known = documents.sparkSession.sparkContext.broadcast(corpus_of(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = known.value
        for batch in batches:
            rows = [text_stats(x, corpus) for x in batch.column(1).to_pylist()]
            columns = [pa.array([r and r[i] for r in rows], types[STATS[n]]) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *names])

    return own.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} {t}" for n, t in STATS.items()))


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            own = [None if t is None else own_words(body_text(t)) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.list_(pa.string()))], names=["id", "own"])

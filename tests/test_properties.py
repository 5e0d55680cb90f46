"""Properties that must hold for any input."""

import difflib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from echofold.extract.lexer import LEXERS, tokenize
from echofold.extract.units import analyse
from echofold.operators.fingerprints import fingerprint, kgram_hashes, winnow_hashes
from echofold.plans import report as R
from echofold.plans.corpus import plant, scatter, true_pairs

codes = st.lists(st.integers(0, 65535), max_size=200).map(lambda x: np.array(x, dtype=np.int64))


@given(codes, codes, st.lists(st.integers(0, 65535), min_size=17, max_size=40))
@settings(max_examples=60, deadline=None)
def test_a_run_of_seventeen_is_shared(a, b, run):
    one, two = np.concatenate((a, run, b)), np.concatenate((b, run, a))
    assert set(fingerprint(one.astype(np.int64)).tolist()) & set(fingerprint(two.astype(np.int64)).tolist())


@given(codes)
@settings(max_examples=60, deadline=None)
def test_fingerprints_are_a_sorted_subset(a):
    h = kgram_hashes(a)
    f = winnow_hashes(h)
    assert len(h) == max(0, len(a) - 9) and set(f.tolist()) <= set(h.tolist()) and np.array_equal(f, np.unique(f)) and (len(f) > 0) == (len(h) > 0)


@given(st.sampled_from(sorted(LEXERS)), st.text(max_size=300))
@settings(max_examples=200, deadline=None)
def test_any_text_is_read(lang, text):
    tokens = tokenize(lang, text)
    assert all(text[t.start : t.end] == t.text for t in tokens) and all(x.end <= y.start for x, y in zip(tokens, tokens[1:], strict=False))
    analyse(lang, text, 1)


@given(st.floats(-1, 2), st.text(max_size=20), st.integers(2, 12))
@settings(max_examples=60, deadline=None)
def test_report_cells(x, s, most):
    assert len(R.gauge(x)) <= 9 and len(R.shortened(s, most)) <= max(most, 1) and len(R.shortened(s, most, end=False)) <= max(most, 1)


@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=12), st.lists(st.sampled_from(["a", "b", "c"]), max_size=12))
@settings(max_examples=60, deadline=None)
def test_aligned_lines_lose_nothing(a, b):
    rows = list(R.aligned(a, b, 1))
    plain = lambda x: x.replace("⟦", "").replace("⟧", "")
    shown = [r for r in rows if not isinstance(r, int)]
    hidden = sum(r for r in rows if isinstance(r, int))
    assert len([r for r in shown if r[0]]) + hidden == len(a) and len([r for r in shown if r[2]]) + hidden == len(b)
    assert all((not r[0] or plain(r[1]) == a[r[0] - 1]) and (not r[2] or plain(r[3]) == b[r[2] - 1]) for r in shown)
    changed = sum(max(i2 - i1, j2 - j1) for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op != "equal")
    assert sum(not r[4] for r in shown) == changed and "\n".join(R.two_columns(rows, 0, 0, 120)).count("≠") == changed


@given(st.text(max_size=60), st.integers(2, 20))
@settings(max_examples=60, deadline=None)
def test_wrapping_loses_nothing(text, columns):
    pieces = R.wrap(text, columns)
    assert "".join(pieces) == text.expandtabs(4) and all(R.display_width(p) <= columns for p in pieces)


def test_corpus_is_what_its_seed_says():
    assert plant(3) == plant(3) != plant(4)
    planted = plant(7)
    assert {k for *_, k in true_pairs(planted)} == {1, 2, 3, 4} and len({p.file for p in planted}) == len(planted)
    host = [("a/b/x.py", "x = 1\n"), ("c/y.py", "")]
    mixed = scatter(planted, host)
    assert len(mixed) == len(planted) + 2 and set(host) <= set(mixed) and all(f.startswith(("a/b/", "c/")) for f, _ in mixed)

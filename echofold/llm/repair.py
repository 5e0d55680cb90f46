"""Re-Pair grammars of many token sequences at once.

A round counts the digrams of every sequence and turns each digram that is more frequent than its neighbours, and comes
at least twice in its sequence, into a rule; all of them in one step, so that a round is a few sorts whatever the number of
sequences. After the first ``rounds``, or once such a round finds nothing, digrams win by the power of two below their count and
then by a fixed order, which takes a number of rounds that grows with the logarithm of the length; they go on until no digram
is left that could be replaced twice. Sequences never share rules, so the grammar of one doesn't depend on which others it is processed with.
"""

from __future__ import annotations

import numpy as np

from .hashing import mix


class Grammar:
    """What is left of the sequences: ``symbol``, ``owner`` (sequence), ``span`` (tokens a symbol stands for), and ``rules`` a sequence."""

    def __init__(self, owner: np.ndarray, symbol: np.ndarray, span: np.ndarray, rules: np.ndarray, sizes: np.ndarray):
        self.owner, self.symbol, self.span, self.rules, self.sizes = owner, symbol, span, rules, sizes

    def covered(self, least: int) -> np.ndarray:
        """Per sequence the share of its tokens that lie in rules of at least ``least`` tokens."""
        long = self.span >= least
        return np.bincount(self.owner[long], weights=self.span[long], minlength=len(self.sizes)) / np.maximum(self.sizes, 1)

    def coded(self) -> np.ndarray:
        """Per sequence the symbols of its grammar (what is left and two for each rule) to a token."""
        left = np.bincount(self.owner, minlength=len(self.sizes))
        return (left + 2 * self.rules) / np.maximum(self.sizes, 1)


def repair(tokens: np.ndarray, sizes: np.ndarray, rounds: int = 14) -> Grammar:
    """Grammars of sequences laid end to end: ``tokens`` (small non-negative integers) and the ``sizes`` of the sequences."""
    count = len(sizes)
    owner = np.repeat(np.arange(count, dtype=np.int64), sizes)
    symbol = owner * (int(tokens.max(initial=0)) + 1) + tokens
    names = count * (int(tokens.max(initial=0)) + 1)  # symbols are numbered below
    span = np.ones(len(tokens), dtype=np.int64)
    rules = np.zeros(count, dtype=np.int64)
    for _ in range(rounds):
        n = len(symbol)
        if n < 2:
            break
        if names > 1 << 31:  # a pair of names must fit into 63 bits
            kept, symbol = np.unique(symbol, return_inverse=True)
            names = len(kept)
        inside = owner[1:] == owner[:-1]
        pair = symbol[:-1] * names + symbol[1:]
        _, at, times = np.unique(pair, return_inverse=True, return_counts=True)
        weight = np.where(inside, times[at], 0)
        # a digram wins against its right neighbour if at least as frequent, against its left one only if more frequent;
        # in a run of equal digrams every other one wins
        left = np.concatenate(([0], weight[:-1]))
        right = np.concatenate((weight[1:], [0]))
        wins = (weight >= 2) & (weight >= left) & (weight >= right)
        start = wins & ~np.concatenate(([False], wins[:-1]))
        at_start = np.maximum.accumulate(np.where(start, np.arange(n - 1), 0))
        chosen = np.flatnonzero(wins & ((np.arange(n - 1) - at_start) % 2 == 0))
        if not len(chosen):
            break
        # a rule must still be used twice once neighbours have taken their tokens
        uses = np.bincount(at[chosen], minlength=len(times))
        chosen = chosen[uses[at[chosen]] >= 2]
        if not len(chosen):
            break
        owner_of = np.full(len(times), -1, dtype=np.int64)
        owner_of[at[chosen]] = owner[chosen]
        rules += np.bincount(owner_of[owner_of >= 0], minlength=count)
        symbol[chosen] = names + at[chosen]
        names += len(times)
        span[chosen] += span[chosen + 1]
        keep = np.ones(n, dtype=bool)
        keep[chosen + 1] = False
        symbol, owner, span = symbol[keep], owner[keep], span[keep]
    return _finished(owner, symbol, span, rules, np.asarray(sizes))


def _finished(owner: np.ndarray, symbol: np.ndarray, span: np.ndarray, rules: np.ndarray, sizes: np.ndarray) -> Grammar:
    """The grammars with all repeated digrams replaced; sequences in which a round replaces nothing are done and set aside."""
    done = []
    while len(symbol) > 1:
        n = len(symbol)
        kept, symbol = np.unique(symbol, return_inverse=True)
        names = len(kept)
        where = np.arange(n - 1)
        same = symbol[1:] == symbol[:-1]
        # in a run of one symbol every other digram counts
        since = np.maximum.accumulate(np.where(np.concatenate(([True], ~same[:-1])), where, 0))
        counts = (owner[1:] == owner[:-1]) & (~same | ((where - since) % 2 == 0))
        _, first, at = np.unique(symbol[:-1] * names + symbol[1:], return_index=True, return_inverse=True)
        times = np.bincount(at[counts], minlength=len(first))
        # all occurrences of a digram have one rank, equal ranks are equal digrams; places count from the sequence's beginning
        begin = np.maximum.accumulate(np.where(np.concatenate(([True], owner[1:] != owner[:-1])), np.arange(n), 0))
        level = np.frexp(times.astype(np.float64))[1]
        rank = np.empty(len(first), dtype=np.int64)
        rank[np.lexsort((mix((first - begin[first]).astype(np.uint64)), level))] = np.arange(1, len(first) + 1)
        weight = np.where(counts & (times[at] >= 2), rank[at], 0)
        wins = (weight > 0) & (weight >= np.concatenate(([0], weight[:-1]))) & (weight >= np.concatenate((weight[1:], [0])))
        uses = np.bincount(at[wins], minlength=len(first))
        chosen = np.flatnonzero(wins & (uses[at] >= 2))
        moved = np.zeros(len(sizes), dtype=bool)
        moved[owner[chosen]] = True
        rules = rules + np.bincount(owner[first[np.unique(at[chosen])]], minlength=len(sizes))
        symbol[chosen] = names + at[chosen]
        span[chosen] += span[chosen + 1]
        keep = np.ones(n, dtype=bool)
        keep[chosen + 1] = False
        still = moved[owner]
        done.append((owner[~still], symbol[~still], span[~still]))
        symbol, owner, span = symbol[keep & still], owner[keep & still], span[keep & still]
    done.append((owner, symbol, span))
    owner, symbol, span = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(owner, kind="stable")
    return Grammar(owner[order], symbol[order], span[order], rules, sizes)

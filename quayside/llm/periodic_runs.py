"""Operator 13: maximal periodic runs of words, by suffix trees and Lyndon roots.

A text's words are symbols.  Ukkonen's construction builds the suffix tree of a stretch of them and of its
reversal; the Euler tour of a tree with a sparse table of its least depths answers any lowest common ancestor, and so the
longest common extension of two places, in constant time.  The longest Lyndon word at each place, under the order of
symbols and under the reversed one, is the only possible root of a run there: it ends where the next smaller suffix begins,
and the ranks of suffixes are the leaves' order.  Each root is extended to the right by the tree and to the left by
that of the reversal; what is long enough is a run.

Trees are built only where a run can be.  In a run of at least 24 words and three periods every window of eight words comes again
within a period, which is at most a third of the stretch.  Windows are compared by hashes, and a stretch of windows that
do come again loses those that come again only farther away, until nothing changes.  Equal windows have
equal hashes, so no run is lost, and a maximal run lies in one stretch with all that could extend it.  Most
texts have no such stretch.

A text is one row and one task's work: memory grows with the longest text, about a kilobyte for each word of a stretch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Every window of so many words in a run comes again a period away: LEAST_WORDS / LEAST_PERIODS.
WINDOW = LEAST_WORDS // LEAST_PERIODS
MULTIPLIERS = np.random.default_rng(13).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)

SCHEMA = (
    ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()))


class SuffixTree:
    """Suffix tree of a sequence of symbols >= 0, closed by -1; answers longest common extensions."""

    def __init__(self, symbols: list[int]) -> None:
        self.text = [*symbols, -1]
        self._build()
        self._tour()

    def _build(self) -> None:
        """Ukkonen: one symbol after another, from the active point along suffix links."""
        text = self.text
        n = len(text)
        begin, end, link, kids = [0], [0], [0], [{}]
        suffix = [-1]  # of a leaf; leaves come in the order of their suffixes
        node = edge = along = waiting = leaves = 0
        for i, symbol in enumerate(text):
            last = 0  # inner node that still needs its link
            waiting += 1
            while waiting:
                if not along:
                    edge = i
                branch = kids[node]
                child = branch.get(text[edge])
                if child is None:
                    branch[text[edge]] = len(begin)
                    begin.append(i), end.append(n), link.append(0), kids.append(None), suffix.append(leaves)
                    leaves += 1
                    if last:
                        link[last] = node
                    last = 0
                else:
                    at = begin[child]
                    size = end[child] - at
                    if along >= size:
                        edge += size
                        along -= size
                        node = child
                        continue
                    if text[at + along] == symbol:
                        along += 1
                        if last:
                            link[last] = node
                        break
                    fork = len(begin)
                    begin.append(at), end.append(at + along), link.append(0), suffix.append(-1)
                    kids.append({symbol: fork + 1, text[at + along]: child})
                    begin.append(i), end.append(n), link.append(0), kids.append(None), suffix.append(leaves)
                    leaves += 1
                    branch[text[edge]] = fork
                    begin[child] = at + along
                    if last:
                        link[last] = fork
                    last = fork
                waiting -= 1
                if node:
                    node = link[node]
                elif along:
                    along -= 1
                    edge = i - waiting + 1
        self.begin, self.end, self.kids, self.suffix = begin, end, kids, suffix

    def _tour(self) -> None:
        """Euler tour of string depths; the ancestor of two leaves is the least between their places."""
        begin, end, kids, suffix = self.begin, self.end, self.kids, self.suffix
        depth, tour, place, ranks, seen = [0] * len(begin), [], [0] * len(self.text), [0] * len(self.text), 0
        stack = [0]
        while stack:
            v = stack.pop()
            if v < 0:
                tour.append(depth[~v])
            elif (branch := kids[v]) is None:
                place[suffix[v]] = len(tour)
                ranks[suffix[v]] = seen
                seen += 1
                tour.append(depth[v])
            else:
                d = depth[v]
                tour.append(d)
                for _, k in sorted(branch.items(), reverse=True):
                    depth[k] = d + end[k] - begin[k]
                    stack += (~v, k)
        self.ranks, self.place = ranks, np.array(place)
        self.least = [np.array(tour, np.int32)]
        step = 1
        while 2 * step <= len(tour):
            self.least.append(np.minimum(self.least[-1][:-step], self.least[-1][step:]))
            step *= 2

    def reversed_ranks(self) -> list[int]:
        """Ranks of the suffixes when greater symbols come first; the end of the text still comes before all."""
        ranks, seen, stack = [0] * len(self.text), 0, [0]
        while stack:
            v = stack.pop()
            branch = self.kids[v]
            if branch is None:
                ranks[self.suffix[v]] = seen
                seen += 1
            else:
                ends = branch.get(-1)
                stack += [k for s, k in sorted(branch.items()) if s >= 0]
                if ends is not None:
                    stack.append(ends)
        return ranks

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefix of the suffixes at ``a`` and ``b``, which differ."""
        x, y = self.place[a], self.place[b]
        low, high = np.minimum(x, y), np.maximum(x, y) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            least = self.least[k]
            out[at] = np.minimum(least[low[at]], least[high[at] - (1 << k)])
        return out


def next_smaller(ranks: list[int]) -> np.ndarray:
    """For each place the next one with a smaller rank; the last place has the smallest."""
    out, stack = [0] * (len(ranks) - 1), []
    for i, r in enumerate(ranks):
        while stack and ranks[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(symbols: list[int]) -> np.ndarray:
    """Rows (start, length, period) of all maximal runs that are long enough, by start and period."""
    n = len(symbols)
    if n < LEAST_WORDS:
        return np.empty((0, 3), np.int64)
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    found = []
    for ranks in (ahead.ranks, ahead.reversed_ranks()):
        root_end = next_smaller(ranks)
        at = np.arange(n)
        right, left = ahead.extension(at, root_end), np.zeros(n, np.int64)
        left[1:] = back.extension(n - at[1:], n - root_end[1:])
        period = root_end - at
        length = left + period + right
        good = (length >= LEAST_WORDS) & (length >= LEAST_PERIODS * period)
        found.append(np.stack([at - left, length, period], 1)[good])
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """Parts [from, to) of a text in which a run can be."""
    n = len(words) - WINDOW + 1
    if len(words) < LEAST_WORDS:
        return []
    symbols = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    hashes = symbols[:n] * MULTIPLIERS[0]
    for k in range(1, WINDOW):
        hashes += symbols[k : k + n] * MULTIPLIERS[k]
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    if not len(same):
        return []
    away = np.full(n, len(words) + 1, np.int64)  # to the nearest equal window
    a, b = order[same], order[same + 1]
    np.minimum.at(away, a, b - a)
    np.minimum.at(away, b, b - a)
    at = np.flatnonzero(LEAST_PERIODS * away <= len(words))
    while len(at):
        cut = np.flatnonzero(np.diff(at) > 1)
        first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
        size = last - first + WINDOW
        mine = np.repeat(size, last - first + 1)
        keep = (mine >= LEAST_WORDS) & (LEAST_PERIODS * away[at] <= mine)
        if keep.all():
            return list(zip(first.tolist(), (last + WINDOW).tolist(), strict=True))
        at = at[keep]
    return []


def text_runs(words: list[bytes]) -> np.ndarray:
    """Rows (start, length, period) of a text's runs, by start and period."""
    found = []
    for lo, hi in stretches(words):
        names: dict[bytes, int] = {}
        found.append(runs_of([names.setdefault(w, len(names)) for w in words[lo:hi]]) + np.array([lo, 0, 0]))
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(runs):
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's rewriting: one text in ten repeats a part of itself from some word on."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def periodic_runs(docs: DataFrame, rewrite=lambda words, doc_id: words) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and digests of all runs and of the collapsed text, for every row of ``docs``.

    A word is what ASCII white space parts.  ``rewrite`` (words, doc_id) may change a text's words first.
    Null and empty texts have no word and no run; repeated rows give repeated rows; a null doc_id stays null; other
    columns are ignored; an empty table gives none; a text of any length is one task's work.
    """

    def row(text: str, doc_id: int | None) -> tuple:
        words = rewrite(text.encode("utf-8").split(), doc_id)
        runs = text_runs(words)
        best = (None,) * 4
        if len(runs):
            start, length, period = max(runs.tolist(), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
            best = (start, length, period, 1000 * length // period)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
        return len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.slice(lo, 500)
                rows = map(row, part.column("text").to_pylist(), part.column("doc_id").to_pylist())
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), SCHEMA, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *(n for n, _ in SCHEMA)])

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), planted)

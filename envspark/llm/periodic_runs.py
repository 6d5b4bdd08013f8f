"""Runs of periodically repeated words.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), at least ``max(least, 2 q)`` words long, that no neighbouring
word extends.  The words of many texts are put one after another, words of
different texts being different, and searched together:

1. *Enhanced suffix array.*  Ranks of words are refined by doubling into ranks
   of 2, 4, 8, ... words; only suffixes that still share their rank with
   another are sorted again.  The ranks of every level are kept and give the
   longest common extension of two places, to the right (LCP) or the left.
2. *LCP intervals.*  A stack over the LCP values yields the intervals, each
   with its depth and the borders of its children; no tree is built.
3. *Branching-tandem test.*  A square ``w w`` whose two halves are followed by
   different words has its places i and i + \\|w\\| in different children of the
   interval of depth \\|w\\|.  For the suffixes of all but the largest child it is
   looked up whether the inverse suffix array at i + depth or i - depth falls
   into the interval: O(n log n) look-ups in all.
4. *Rotation and merging.*  Such a square is the last one of its run; the
   common extension to the left is how far it can be rotated.  Squares of one
   stretch (multiples of the period) are merged into the run of the smallest.

With d = least // 4 + 1, every period q < d has a multiple of d to 2 d - 2
words, and twice that is at most ``least``: each run holds a square of halves of
d words or more, so suffixes that share fewer words with every other one are
left aside.

Null, empty and white-space texts have no words and no runs.  Rows are
independent of each other: repeated rows and ids, and null ids, are kept.
A text is one row and is processed in one piece, in memory in proportion to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.llm.common import small_batches
from envspark.llm.hashing import FACTORS, NOT_SPACE, blocks, mix, word_hashes


class SuffixRanks:
    """Ranks of the suffixes of some word sequences laid end to end, level by
    level; level t tells apart what differs in the next 2^t words."""

    def __init__(self, words: np.ndarray, first: np.ndarray, depth: int):
        n, counts = len(words), np.diff(first)
        self.words, self.depth = words, depth
        self.begin, self.end = np.repeat(first[:-1], counts), np.repeat(first[1:], counts)
        owner = mix(np.arange(len(counts), dtype=np.uint64) * FACTORS[0] + FACTORS[1])
        key = mix(words ^ np.repeat(owner, counts))
        order = np.argsort(key, kind="stable")
        rank = np.zeros(n, np.int64)
        order = self._regroup(rank, order, key[order])
        self.levels, self.slot, step = [rank.copy()], None, 1
        while len(order):
            if self.slot is None and 2 * step > depth:
                # from here on only suffixes that share ``step`` words with another are looked at
                self.active, self.whole = order, len(self.levels)
                self.slot = np.full(n, -1, np.int64)
                self.slot[order] = np.arange(len(order))
            key = rank[order] * (n + 1) + self._next(rank, order, step)
            by = np.argsort(key, kind="stable")
            order, step = self._regroup(rank, order[by], key[by]), 2 * step
            self.levels.append(rank.copy() if self.slot is None else rank[self.active])
        if self.slot is None:
            self.active, self.whole, self.slot = order, len(self.levels), np.full(n, -1, np.int64)
        self.order = self.active[np.argsort(rank[self.active])]
        self.inverse = np.full(n, -1, np.int64)
        self.inverse[self.order] = np.arange(len(self.order))

    def _next(self, rank, order, step):
        """Rank ``step`` words on, from 1; 0 where the sequence has ended."""
        at = order + step
        inside = at < self.end[order]
        return np.where(inside, rank[np.where(inside, at, 0)] + 1, 0)

    @staticmethod
    def _regroup(rank, order, key):
        """Set the ranks of suffixes sorted by key (a group's rank is its
        first place) and return those that share theirs."""
        if not len(order):
            return order
        place = np.arange(len(order))
        old = rank[order]
        fresh = np.r_[True, key[1:] != key[:-1]]
        group = np.r_[True, old[1:] != old[:-1]]
        rank[order] = old + (np.maximum.accumulate(np.where(fresh, place, 0))
                             - np.maximum.accumulate(np.where(group, place, 0)))
        return order[~(fresh & np.r_[fresh[1:], True])]

    def _same(self, t: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the 2^t words at x and at y are equal (x <> y)."""
        level = self.levels[t]
        if t < self.whole:                          # kept for every place, not only the active ones
            return level[x] == level[y]
        a, b = self.slot[x], self.slot[y]
        both = (a >= 0) & (b >= 0)
        return both & (level[np.where(both, a, 0)] == level[np.where(both, b, 0)])

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and from j on (i < j, one sequence)."""
        n, end = np.zeros(len(i), np.int64), self.end[i] if len(i) else i
        for t in range(len(self.levels) - 1, -1, -1):
            ok = np.flatnonzero(j + n + (1 << t) <= end)
            n[ok[self._same(t, i[ok] + n[ok], j[ok] + n[ok])]] += 1 << t
        return n

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words that end before i and before j (i < j)."""
        n, begin = np.zeros(len(i), np.int64), self.begin[i] if len(i) else i
        for t in range(len(self.levels) - 1, -1, -1):
            ok = np.flatnonzero(i - n - (1 << t) >= begin)
            n[ok[self._same(t, i[ok] - n[ok] - (1 << t), j[ok] - n[ok] - (1 << t))]] += 1 << t
        return n

    def lcp(self) -> np.ndarray:
        """Common words of neighbours in the suffix array; 0 below ``depth``."""
        out = np.zeros(len(self.order), np.int64)
        a, b = self.order[:-1], self.order[1:]
        near = np.flatnonzero(self.begin[a] == self.begin[b])
        out[near + 1] = self.right(np.minimum(a[near], b[near]), np.maximum(a[near], b[near]))
        out[out < self.depth] = 0
        return out


def interval_borders(lcp: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every split k of an LCP interval: where the interval begins, its
    first split, and where the child that begins at k ends."""
    left, head, until = [0] * len(lcp), list(range(len(lcp))), [len(lcp)] * len(lcp)
    stack: list[int] = []
    for k, v in enumerate(lcp):
        while stack and lcp[stack[-1]] > v:
            until[stack.pop()] = k
        if stack and lcp[stack[-1]] == v:
            before = stack.pop()
            until[before], left[k], head[k] = k, left[before], head[before]
        elif stack:
            left[k] = stack[-1]
        stack.append(k)
    return np.array(left, np.int64), np.array(head, np.int64), np.array(until, np.int64)


def branching_squares(ranks: SuffixRanks) -> tuple[np.ndarray, np.ndarray]:
    """Places and half lengths of the squares that are followed by a word
    other than the first of their second half."""
    lcp = ranks.lcp()
    left, head, until = interval_borders(lcp.tolist())
    split = np.flatnonzero(lcp > 0)
    heads = split[head[split] == split]
    last = np.zeros(len(lcp), np.int64)
    last[head[split]] = split                       # the last split of each interval wins
    low, high = np.r_[split, left[heads]], np.r_[until[split], heads]
    of = np.r_[head[split], heads]
    size = high - low
    by = np.lexsort((size, of))
    small = by[:-1][of[by][1:] == of[by][:-1]] if len(by) else by       # all but the largest child
    low, size, of = low[small], size[small], of[small]
    leaf = np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(size) else low
    of = np.repeat(of, size)
    place, depth, begin, end = ranks.order[leaf], lcp[of], left[of], until[last[of]]
    found = []
    for start, other in ((place, place + depth), (place - depth, place - depth)):
        at = np.flatnonzero((other >= ranks.begin[place]) & (other < ranks.end[place]))
        where = ranks.inverse[other[at]]
        at = at[(where >= begin[at]) & (where < end[at])]
        s, d = start[at], depth[at]
        open_end = s + 2 * d < ranks.end[s]
        branches = ~open_end | (ranks.words[s + d] != ranks.words[np.where(open_end, s + 2 * d, 0)])
        found.append(np.stack((s[branches], d[branches])))
    s, d = np.unique(np.concatenate(found, axis=1), axis=1)
    return s, d


def word_runs(words: np.ndarray, first: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (in the joined sequence), lengths and smallest periods of the
    runs of some word sequences, by start and period."""
    depth = least // 4 + 1          # of the shortest square looked for
    ranks = SuffixRanks(words, first, depth)
    place, period = branching_squares(ranks)
    start = place - ranks.left(place, place + period)
    length = place + 2 * period - start
    ok = length >= np.maximum(least, 2 * period)
    start, length, period = start[ok], length[ok], period[ok]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    if len(start):
        fresh = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])]
        start, length, period = start[fresh], length[fresh], period[fresh].copy()
    # periods below ``depth`` show as a multiple of theirs
    for q in range(depth - 1, 0, -1):
        at = np.flatnonzero((period % q == 0) & (period < 3 * depth))
        at = at[ranks.right(start[at], start[at] + q) >= length[at] - q]
        period[at] = q
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12,
              edit: Callable[[int | None, list[bytes]], list[bytes] | None] | None = None) -> DataFrame:
    """Every row's id, ``n_words``, ``runs`` (start, length and period of each,
    by start and period) and ``collapsed``: its words without those that a run
    contains after its first period, joined by one space.  ``edit`` may give
    other words for a row (as many; None: as they are) before the search."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = 0
            for texts in blocks((t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]):
                ids = pdf["id"].iloc[at:at + len(texts)]
                at += len(texts)
                lists = [t.split() for t in texts]
                if edit is not None:
                    for k, i in enumerate(ids):
                        other = edit(None if pd.isna(i) else int(i), lists[k])
                        if other is not None:
                            lists[k], texts[k] = other, b" ".join(other)
                hashes, first = word_hashes(texts, NOT_SPACE)
                start, length, period = word_runs(hashes, first, least)
                drop = np.zeros(len(hashes) + 1, np.int32)
                np.add.at(drop, start + period, 1)
                np.add.at(drop, start + length, -1)
                gone = np.cumsum(drop) > 0
                bounds = np.searchsorted(start, first)
                runs, collapsed = [], []
                for k, words in enumerate(lists):
                    a, b = bounds[k], bounds[k + 1]
                    runs.append([(int(s), int(n), int(q)) for s, n, q in
                                 zip(start[a:b] - first[k], length[a:b], period[a:b])])
                    if a < b:
                        keep = np.flatnonzero(~gone[first[k]:first[k + 1]])
                        words = [words[w] for w in keep.tolist()]
                    collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pd.DataFrame({"id": ids.to_numpy(), "n_words": [len(x) for x in lists],
                                    "runs": runs, "collapsed": collapsed})
    kind = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return (small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .mapInPandas(run, kind).withColumnRenamed("id", id_col))


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes] | None:
    """The edit of the registered query: in every tenth document (by the CRC
    of its id) the words repeat with some period from some word on."""
    if doc_id is None or not words:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def run_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest of ``find_runs``: how many runs, the longest (ties: smallest
    start, then period), and SHA-256 of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    out = found.withColumn("__top", F.when(F.size("runs") > 0, longest))
    start, length, period = -F.col("__top")["col2"], F.col("__top")["length"], -F.col("__top")["col3"]
    return out.select(id_col, F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"),
                      period.alias("period"), F.expr("1000 * __top.length div -__top.col3").alias("exponent_milli"),
                      F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"),
                      F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))

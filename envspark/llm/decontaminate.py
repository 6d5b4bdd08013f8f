"""Benchmark decontamination by latent semantic retrieval.

1. *Statistics.*  Document frequencies of hashed terms over the whole corpus.
2. *Latent space.*  A randomised SVD of the TF-IDF matrix of passages: the
   benchmark items and all corpus passages, which together weigh as those of
   ``CORPUS`` documents.  The products with the matrix are computed where its
   rows are and summed by block of terms; orthonormalisation of the thin
   factor is the driver's share.
3. *Search.*  Every passage of every document (``WINDOW`` words, moved by
   ``CHUNK``) is folded into the space and compared with every item of the
   block: the cosine between the passage and the item's latent image.
4. *Checks.*  Candidates above the cosine threshold are accepted if a longest
   common subsequence of words around the passage holds enough of the item,
   and enough of its ending, where the answer stands.

Every step reads all rows and whole texts.  Items are taken
in blocks of at most ``BLOCK`` items and ``LATENT`` distinct terms (three passes
over the corpus each; an item of more terms is a block of its own), so what is
broadcast - an idf table, the term loadings and one block - is bounded.

Terms in more than ``max_df`` of the documents weigh nothing unless an item
holds them: a passage that is copied into many rows makes its own words
frequent.  Such a term weighs at least ``FLOOR``, and the more the fewer items
of the block hold it, up to the weight at ``max_df``.

Null and empty texts have no passages; items without words match nothing; a
repeated item is reported under each of its ids, repeated rows each get their
own hits.  Null item ids are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.llm.common import small_batches
from envspark.llm.hashing import ALPHANUMERIC, blocks, word_hashes

CHUNK, WINDOW = 16, 3           # words per chunk, chunks per passage
TERMS = 1 << 18                 # hashed terms
LATENT = 1 << 13                # terms with loadings, at most (the items' first)
CORPUS = 2_000                  # documents the whole corpus weighs as against the items, at most
RANK, EXTRA = 256, 16           # axes kept, and more for accuracy
BLOCK = 256                     # items searched per pass
FLOOR = 0.5                     # least weight of an item's term
COSINE, SHARE, ENDING = 0.1, 0.6, 0.4


def words_in(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of some texts at a time, and where each text's begin.
    Words are runs of ASCII letters and digits and of characters beyond
    ASCII, in lower case."""
    for some in blocks((t or "").lower().encode("utf-8", "surrogatepass") for t in texts):
        yield word_hashes(some, ALPHANUMERIC)


def words_of(text: str | None) -> np.ndarray:
    return next(words_in([text]))[0]


def term_ids(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(TERMS - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Documents per hashed term, and documents with words.  Each task counts
    its own rows; TERMS numbers reach the driver."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(TERMS, np.int64), 0
        for pdf in batches:
            for words, first in words_in(pdf["t"]):
                sizes = np.diff(first)
                n += int((sizes > 0).sum())
                one = np.unique(np.repeat(np.arange(len(sizes)), sizes) * TERMS + term_ids(words))
                df += np.bincount(one % TERMS, minlength=TERMS)
        some = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.r_[-1, some], "n": np.r_[n, df[some]]})
    rows = (docs.select(F.col(text_col).alias("t")).mapInPandas(run, "term int, n long")
            .groupBy("term").agg(F.sum("n").alias("n")).toPandas())
    df = np.zeros(TERMS, np.int64)
    real = rows[rows["term"] >= 0]
    df[real["term"].to_numpy()] = real["n"].to_numpy()
    return df, int(rows.loc[rows["term"] < 0, "n"].sum())


def _dense(place: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int, step: int = 64):
    """Entries of a sparse matrix of ``n`` rows, by ascending place, as small
    dense blocks: first row, columns that occur, block."""
    cuts = np.searchsorted(place, np.arange(0, n + step, step))
    for b, lo, hi in zip(range(0, n, step), cuts, cuts[1:]):
        if lo < hi:
            own, col = np.unique(row[lo:hi], return_inverse=True)
            size = min(step, n - b)
            a = np.bincount((place[lo:hi] - b) * len(own) + col, weight[lo:hi], size * len(own))
            yield b, own, a.reshape(size, -1).astype(np.float32)


@dataclass
class Index:
    """What a task needs to search one block of items."""
    ids: list
    words: list[np.ndarray]     # hashes of the items' words
    idf: np.ndarray             # TERMS, 0 for terms in too many documents and no item
    row: np.ndarray             # TERMS -> row of loadings, or -1
    loadings: np.ndarray        # terms x items: folded term (times idf) on the item's image of unit length
    cosine: float
    share: float
    ending: float

    def masks(self):
        """Per item: word -> bits of its places."""
        out = []
        for ws in self.words:
            m: dict[int, int] = {}
            for i, w in enumerate(ws.tolist()):
                m[w] = m.get(w, 0) | 1 << i
            out.append(m)
        return out

    def vocabulary(self):
        """The items' words, ascending, and how often each item holds each."""
        vocabulary = np.unique(np.concatenate(self.words))
        holds = np.zeros((len(self.words), len(vocabulary)), np.int32)
        for i, ws in enumerate(self.words):
            np.add.at(holds[i], np.searchsorted(vocabulary, ws), 1)
        return vocabulary, holds

    def search(self, texts) -> list[list[tuple]]:
        """Hits of each text: (item id, cosine, share, first word)."""
        if not hasattr(self, "_masks"):
            self._masks = self.masks()
            self._vocabulary, self._holds = self.vocabulary()
            self._sizes = np.array([len(ws) for ws in self.words])
        return [h for words, first in words_in(texts) for h in self._search(words, first)]

    def _search(self, words: np.ndarray, begin: np.ndarray) -> list[list[tuple]]:
        sizes = np.diff(begin)
        hits: list[list[tuple]] = [[] for _ in sizes]
        terms = term_ids(words)
        rows = self.row[terms]
        there = np.flatnonzero(rows >= 0)
        if not len(there):
            return hits
        chunks = -(-sizes // CHUNK) + WINDOW - 1       # empty chunks end each document
        first = np.r_[0, np.cumsum(chunks)]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        at = first[doc] + (np.arange(len(words)) - begin[doc]) // CHUNK
        weight = self.idf[terms]
        size = np.convolve(np.bincount(at, weight * weight, first[-1]), np.ones(WINDOW))[WINDOW - 1:][:first[-1]]
        where = at[there]
        starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        sums = np.zeros((len(starts) + 1, self.loadings.shape[1]), np.float32)      # the last: no loaded words
        nth = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(where)]))
        for b, own, block in _dense(nth, rows[there], np.ones(len(there)), len(starts)):
            sums[b:b + len(block)] = block @ self.loadings[own]
        # windows that begin at or just before a chunk with loaded words
        place = np.full(first[-1] + WINDOW, len(starts))
        place[where[starts]] = np.arange(len(starts))
        some = np.unique((where[starts][:, None] - np.arange(WINDOW)).ravel())
        some = some[some >= 0]
        window = sums[place[some]]
        for k in range(1, WINDOW):
            window += sums[place[some + k]]
        least = self.cosine * np.sqrt(np.maximum(size[some], 1e-9))
        found_at, found_item = np.nonzero(window >= least[:, None])
        doc_of = np.searchsorted(first, some, "right") - 1
        able = self.enough(words, begin, doc_of[found_at], (some - first[doc_of])[found_at] * CHUNK, found_item)
        best: dict[tuple[int, int], tuple] = {}
        for r, i in zip(found_at[able].tolist(), found_item[able].tolist()):
            d, c = int(doc_of[r]), int(some[r])
            found = self.check(i, words[begin[d]:begin[d + 1]], int(c - first[d]) * CHUNK)
            if found is not None and ((d, i) not in best or best[d, i][1] < found[0]):
                best[d, i] = (float(window[r, i] / np.sqrt(size[c])), *found)
        for (d, i), (cos, share, start) in sorted(best.items()):
            hits[d].append((self.ids[i], cos, share, start))
        return hits

    def enough(self, words: np.ndarray, begin: np.ndarray, doc: np.ndarray, at: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which candidates have so many of the item's words around the passage
        that ``check`` can find the share (a common subsequence has no more)."""
        out = np.zeros(len(item), bool)
        slot = np.minimum(np.searchsorted(self._vocabulary, words), len(self._vocabulary) - 1)
        known = np.flatnonzero(self._vocabulary[slot] == words)
        slot = slot[known]
        by_slot = np.argsort(slot, kind="stable")
        first = np.searchsorted(slot[by_slot], np.arange(len(self._vocabulary) + 1))
        n = self._sizes[item]
        low = np.searchsorted(known, begin[doc] + np.maximum(0, at - n))
        high = np.searchsorted(known, np.minimum(begin[doc + 1], begin[doc] + at + WINDOW * CHUNK + n))
        order = np.argsort(item, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(item[order])) + 1) if len(order) else ():
            own = np.flatnonzero(self._holds[item[some[0]]])
            sizes = first[own + 1] - first[own]
            start = np.cumsum(sizes) - sizes
            # places of the item's words, word by word, and how many there are before each place
            nth = np.arange(sizes.sum()) - np.repeat(start, sizes)
            places = by_slot[np.repeat(first[own], sizes) + nth]
            mine = np.zeros(len(known) + 1, np.int32)
            mine[places + 1] = 1
            np.cumsum(mine, out=mine)
            a, b = mine[low[some]], mine[high[some]]
            some, a, b = (v[(b - a) / n[some] >= self.share] for v in (some, a, b))
            if not len(some):
                continue
            # a word counts as often as the item holds it: where its place that many times before is outside
            often = np.repeat(self._holds[item[some[0]], own], sizes)
            at_place = mine[places]
            before = np.full(len(places), -1)
            more = np.flatnonzero(nth >= often)
            before[at_place[more]] = at_place[more - often[more]]
            nth = np.repeat(np.arange(len(some)), b - a)
            at_word = np.arange(len(nth)) + np.repeat(a - np.r_[0, np.cumsum(b - a)][:-1], b - a)
            count = np.bincount(nth, before[at_word] < a[nth], len(some))
            out[some] = count / n[some] >= self.share
        return out

    def check(self, item: int, words: np.ndarray, at: int) -> tuple[float, int] | None:
        """Share of the item in a longest common subsequence with the words
        around the passage, if it and the share of the ending suffice."""
        n = len(self.words[item])
        start = max(0, at - n)
        around = words[start:at + WINDOW * CHUNK + n].tolist()
        masks, full = self._masks[item], (1 << n) - 1
        v = full
        for w in around:
            m = masks.get(w)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        common = full & ~v
        share = common.bit_count() / n
        tail = max(1, n // 4)
        if share < self.share or (common >> (n - tail)).bit_count() < self.ending * tail:
            return None
        return share, start


def _product(terms: np.ndarray, passage: np.ndarray, idf, row, q: np.ndarray) -> np.ndarray:
    """A'(A q) for the TF-IDF rows (unit length) of passages, given by their
    terms and the ascending number of the passage of each."""
    out = np.zeros(q.shape, np.float64)
    if not len(terms):
        return out
    x, n = idf[terms].astype(np.float64), int(passage[-1]) + 1
    size = np.sqrt(np.bincount(passage, x * x, n))[passage]
    r = row[terms]
    keep = np.flatnonzero((r >= 0) & (size > 0))
    for _, own, block in _dense(passage[keep], r[keep], x[keep] / size[keep], n):
        out[own] += block.T @ (block @ q[own])
    return out


def _corpus_product(texts: DataFrame, idf, row, q: np.ndarray) -> np.ndarray:
    """A'(A q) over all passages of the corpus: every task multiplies its
    passages, sums meet per block of terms, and the thin result goes to the
    driver."""
    step, width = 1024, q.shape[1]
    shared = texts.sparkSession.sparkContext.broadcast((idf, row, q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf_, row_, q_ = shared.value
        total = np.zeros(q_.shape, np.float64)
        for pdf in batches:
            for words, first in words_in(pdf["t"]):
                sizes = np.diff(first)
                pieces = -(-sizes // (CHUNK * WINDOW))
                doc = np.repeat(np.arange(len(sizes)), sizes)
                start = np.r_[0, np.cumsum(pieces)][:-1]
                passage = start[doc] + (np.arange(len(words)) - first[doc]) // (CHUNK * WINDOW)
                total += _product(term_ids(words), passage, idf_, row_, q_)
        for b in range(0, len(q_), step):
            yield pd.DataFrame({"b": [b], "m": [total[b:b + step].astype(np.float32).tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(m, np.float32).astype(np.float64) for m in pdf["m"])
        return pd.DataFrame({"b": [pdf["b"].iat[0]], "m": [total.astype(np.float32).tobytes()]})
    parts = texts.mapInPandas(run, "b int, m binary").groupBy("b").applyInPandas(add, "b int, m binary").collect()
    shared.destroy()
    out = np.zeros_like(q)
    for r in parts:
        m = np.frombuffer(r["m"], np.float32).reshape(-1, width)
        out[r["b"]:r["b"] + len(m)] = m
    return out


def _orthonormal(y: np.ndarray) -> np.ndarray:
    """The thin factor of y = QR, written over y.  Blocks of rows are factored
    one at a time and their triangles once more, in double precision, so that
    the driver holds no further matrix of that size."""
    n, width = y.shape
    cuts = np.arange(0, max(1, n - 4 * width + 1), 4 * width).tolist() + [n]      # the last block is the longest
    pairs = list(zip(cuts, cuts[1:]))
    if len(pairs) == 1:
        y[:], _ = np.linalg.qr(y.astype(np.float64))
        return y
    top, _ = np.linalg.qr(np.concatenate([np.linalg.qr(y[lo:hi].astype(np.float64), "r") for lo, hi in pairs]))
    for i, (lo, hi) in enumerate(pairs):
        q, _ = np.linalg.qr(y[lo:hi].astype(np.float64))
        y[lo:hi] = q @ top[i * width:(i + 1) * width]
    return y


def latent_axes(texts: DataFrame, share: float, items: list[np.ndarray], idf, row, n_terms: int, rank: int,
                rounds: int = 1, seed: int = 11) -> np.ndarray:
    """The leading right singular vectors (terms x rank) by randomised
    subspace iteration over all passages of the texts, each of the weight
    ``share``.  Items weigh so much that they shape the first axes."""
    rng = np.random.default_rng(seed)
    width = min(rank + EXTRA, n_terms)
    q = np.empty((n_terms, width), np.float32)
    for b in range(0, n_terms, 1024):
        q[b:b + 1024] = rng.standard_normal(q[b:b + 1024].shape)
    q = _orthonormal(q)
    terms, item = np.concatenate(items), np.repeat(np.arange(len(items)), [len(t) for t in items])

    def product(q):
        y = _corpus_product(texts, idf, row, q)
        y *= np.float32(share)
        own = _product(terms, item, idf, row, q)
        own *= 100.0
        y += own
        return y
    for _ in range(rounds):
        q = _orthonormal(product(q))
    y = product(q)
    values, vectors = np.linalg.eigh(sum(q[b:b + 1024].T.astype(np.float64) @ y[b:b + 1024] for b in range(0, n_terms, 1024)))
    del y
    return (q @ vectors[:, ::-1][:, :rank].astype(np.float32)).astype(np.float32)


def build_indexes(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str,
                  cosine: float, share: float, ending: float, max_df: float = 0.05) -> Iterator[Index]:
    """One index per block of items."""
    df, n = document_frequencies(small_batches(docs), text_col)
    plain = np.log((n + 1) / (df + 1)).astype(np.float32)
    frequent = df > max(max_df * n, 20)
    # a partial product is as large whatever its task reads, so there are as many as cores, not as files
    texts = docs.select(F.col(text_col).alias("t")).coalesce(max(6, docs.sparkSession.sparkContext.defaultParallelism))
    taken = benchmark.select(F.col(item_col), F.col(item_text)).orderBy(item_col, item_text)

    def item_blocks():
        block, held = [], set()
        for r in taken.toLocalIterator():
            words = words_of(r[1])
            if not len(words):
                continue
            new = set(term_ids(words).tolist())
            if block and (len(block) == BLOCK or len(held | new) > LATENT):
                yield block
                block, held = [], set()
            block.append((r[0], words))
            held |= new
        if block:
            yield block

    def index(kept):
        terms = [term_ids(w) for _, w in kept]
        distinct = {t.tobytes(): t for t in terms}.values()
        own, holders = np.unique(np.concatenate([np.unique(t) for t in distinct]), return_counts=True)
        idf = np.where(frequent, 0, plain)
        least = np.clip(np.log((len(distinct) + 1) / holders), FLOOR, max(FLOOR, np.log(1 / max_df)))
        idf[own] = np.maximum(plain[own], np.where(frequent[own], least, FLOOR))
        others = np.argsort(-np.where(idf > 0, df, 0), kind="stable")
        others = others[df[others] > 0]
        others = others[~np.isin(others, own)][:max(0, LATENT - len(own))]
        chosen = np.r_[own, others]
        row = np.full(TERMS, -1, np.int32)
        row[chosen] = np.arange(len(chosen))
        rank = min(RANK, len(chosen))
        axes = latent_axes(texts, min(1.0, CORPUS / max(1, n)), terms, idf, row, len(chosen), rank)
        # terms of no item that hardly bear on the axes are not looked up
        length = np.linalg.norm(axes, axis=1)
        faint = length < 0.02 * np.median(length[:len(own)])
        faint[:len(own)] = False
        row[chosen[faint]] = -1
        loadings = axes * idf[chosen][:, None]
        images = np.stack([loadings[row[t]].sum(0) for t in terms])
        length = np.linalg.norm(images, axis=1, keepdims=True)
        images = np.where(length > 0, images / np.maximum(length, 1e-9), 0).astype(np.float32)
        return Index([i for i, _ in kept], [w for _, w in kept], idf, row, (loadings @ images.T).astype(np.float32),
                     cosine, share, ending)
    return map(index, item_blocks())


HITS = "array<struct<item_id:long,cosine:double,lcs_share:double,first_word:int>>"


def _searcher(spark, index: Index):
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf(HITS)
    def search(texts: pd.Series) -> pd.Series:
        names = ("item_id", "cosine", "lcs_share", "first_word")
        return pd.Series([[dict(zip(names, h)) for h in hs] for hs in shared.value.search(texts)])
    return search


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text", cosine: float = COSINE, share: float = SHARE,
          ending: float = ENDING) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share and first_word of every benchmark
    item found in a document (its best passage)."""
    found = None
    src = docs.select(F.col(id_col), F.col(text_col).alias("__t"))
    for index in build_indexes(docs, benchmark, id_col, text_col, item_col, item_text, cosine, share, ending):
        one = src.select(id_col, F.explode(_searcher(docs.sparkSession, index)("__t")).alias("h")).select(id_col, "h.*")
        found = one if found is None else found.union(one)
    if found is None:
        none = F.array().cast(HITS)
        found = src.select(id_col, F.explode(none).alias("h")).select(id_col, "h.*")
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", cosine: float = COSINE, share: float = SHARE,
                  ending: float = ENDING) -> DataFrame:
    """The documents in which no benchmark item is found, with all columns."""
    kept = docs
    for index in build_indexes(docs, benchmark, id_col, text_col, item_col, item_text, cosine, share, ending):
        kept = kept.where(F.size(_searcher(docs.sparkSession, index)(F.col(text_col))) == 0)
    return kept

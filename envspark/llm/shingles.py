"""Sets of word shingles, and the comparison of pairs of them on the full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.llm.common import member_of
from envspark.llm.hashing import FACTORS, NOT_SPACE, blocks, mix, word_hashes

STAR = 256              # sets compared with one copy of the text they are compared with


def _some_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sets of a few texts at once."""
    words, first = word_hashes(texts, NOT_SPACE)
    grams = np.full(max(0, len(words) - n + 1), n, np.uint64)
    for i in range(n):
        grams += words[i:len(words) - n + 1 + i] * (FACTORS[i % 64] + np.uint64(2 * (i // 64)))
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            s = np.sort(grams[a:b - n + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            k = int(b - a)
            g = np.full(1, k, np.uint64)
            for i in range(k):
                g += words[a + i:a + i + 1] * (FACTORS[i % 64] + np.uint64(2 * (i // 64)))
            out.append(mix(g))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams; words are
    runs without ASCII white space, A-Z lower-cased."""
    for some in blocks((t or "").encode("utf-8", "surrogatepass").lower() for t in texts):
        yield from _some_sets(some, n)


def _signed(x) -> int:
    return int(x) - (1 << 64) if int(x) >= 1 << 63 else int(x)


def set_digest(s: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(s.tobytes()))


def node_texts(docs: DataFrame, nodes: DataFrame, n: int, text_col: str) -> DataFrame:
    """One text for each of ``nodes`` (column node)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            found = [(set_digest(s), t) for s, t in zip(shingle_sets(pdf["text"], n), pdf["text"]) if len(s)]
            found = [(x, t) for x, t in found if x not in seen and not seen.add(x)]
            yield pd.DataFrame(found, columns=["node", "text"])
    return (docs.select(F.col(text_col).alias("text")).mapInPandas(run, "node long, text string")
            .where(member_of(nodes, F.col("node"))).join(nodes, "node", "left_semi").dropDuplicates(["node"]))


def compared(pairs: DataFrame, texts: DataFrame, n: int, share: int, differences: bool = False,
             sizes: bool = False) -> DataFrame:
    """Every pair (a, b) with ``linked``, on the full sets (``sizes``: also
    the size ``n`` of b's set and ``x`` of its difference to a's) - or with
    ``n`` and the difference itself (``diff``); a pair whose column ``plain``
    is true gets b's whole set instead.  The partners of one ``a`` are dealt
    into shares of about STAR, each with one copy of its text.  Further
    columns of the pairs are carried along."""
    more = [c for c in pairs.columns if c not in ("a", "b")]
    kinds = dict(pairs.dtypes)
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("shares"))
    partners = (pairs.join(shares, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int"))
                .join(texts.withColumnRenamed("node", "b"), "b")
                .select("a", "share", F.lit(1).alias("role"), "b", *more, "text"))
    heads = (shares.join(texts.withColumnRenamed("node", "a"), "a")
             .select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role"),
                     *[F.lit(None if kinds[c].startswith("array") else 0).cast(kinds[c]).alias(c) for c in ["b", *more]], "text"))
    dealt = heads.union(partners).repartition("a", "share").sortWithinPartitions("a", "share", "role")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = None
        for pdf in batches:
            found = []
            whole = pdf["plain"] if "plain" in more else np.zeros(len(pdf), bool)
            for role, plain, s in zip(pdf["role"], whole, shingle_sets(pdf["text"], n)):
                if not role:
                    head = s
                elif differences:
                    diff = s if plain else np.setxor1d(head, s, assume_unique=True)
                    found.append((len(s), diff.view(np.int64)))
                else:
                    both = len(np.intersect1d(head, s, assume_unique=True))
                    linked = bool(100 * both >= share * (len(head) + len(s) - both))
                    found.append((linked, len(s), len(head) + len(s) - 2 * both)[:len(made)])
            out = pdf.loc[pdf["role"] == 1, ["a", "b", *more]].reset_index(drop=True)
            yield out.join(pd.DataFrame(found, columns=made))
    made = ["n", "diff"] if differences else ["linked", "n", "x"] if sizes else ["linked"]
    carried = "".join(f", {c} {kinds[c]}" for c in more)
    return (dealt.select("a", "role", "b", *more, "text")
            .mapInPandas(run, f"a long, b long{carried}, " + ("n long, diff array<long>" if differences else "linked boolean" + (", n long, x long" if sizes else ""))))

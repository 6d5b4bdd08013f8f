"""Near-duplicate groups by SuperMinHash signatures.

1. *Signatures.*  Every shingle draws, from its own random stream, one slot
   and one value per level; the slots of a shingle are a permutation, built a
   swap at a time, and the value of level j lies in [j, j + 1).  A component is
   the least value that fell into it, so a text is done as soon as every
   component is below the next level: one draw per shingle for all but short
   texts.  The correlated ranks give less variance than independent ones.
2. *Banding.*  ``rows`` components make a band; equal bands make candidates.
   At the similarity asked for (0.8), a pair shares none of 40 bands of 5 with
   a chance of 1.3e-7.
3. *Verification.*  In a band's bucket all members are compared with one
   member only, that met in most buckets, on the full sets.  Members outside
   the component of this pivot are compared with the other members of its star
   by their differences to the pivot, which give the exact similarity: many
   pairs at once, in tiles of bounded size.  A tile returns only links that
   join components, less than it has rows.
4. *Grouping.*  Connected components of the links (union by smallest label).

Nodes are distinct shingle sets, named by 64 bits of their digest, so copies
meet before any pair is made.  The work in tiles grows with the square of the
members of one star that its pivot leaves apart; their rows do not.

Null and empty texts (or white space only) have no shingles and link with
nothing.  Texts with fewer words than a shingle are one shingle.  Repeated
rows belong to one class; rows that share an id but not the text are linked
each by its own text.  A null id never names a class unless all its ids are
null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.llm.common import connected_components, cut_lineage, small_batches
from envspark.llm.hashing import FACTORS, mix
from envspark.llm.shingles import compared, node_texts, set_digest, shingle_sets

SIZE = 200              # components of a signature (256 at most: slots are bytes)
ROWS = 5                # components of a band
TILE = 1024             # members on each side of a tile
LEAF = 1 << 19          # differing shingles on each side of a tile
COLUMNS = 4096          # shingles of one incidence matrix
LEVEL = np.uint64(32)   # bits of a value below its level


def signatures(sets: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """SuperMinHash signatures (sets x size) of non-empty sets of 64-bit
    elements; a component is level * 2^32 + a 32-bit value."""
    items = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    sig = np.full((len(sets), size), np.iinfo(np.uint64).max, np.uint64)
    slots = None
    for j in range(size):
        draw = mix(items + np.uint64(int(FACTORS[1]) * (j + 1) & (1 << 64) - 1))
        pick = j + (((draw >> LEVEL) * np.uint64(size - j)) >> LEVEL).astype(np.intp)
        if slots is None:
            slot = pick                             # nothing has been swapped yet
        else:
            rows = np.arange(len(items))
            slot = slots[rows, pick].astype(np.intp)
            slots[rows, pick] = slots[:, j]
        value = (np.uint64(j) << LEVEL) | (draw & np.uint64(0xFFFFFFFF))
        np.minimum.at(sig.reshape(-1), owner * size + slot, value)
        open_ = sig.max(1) >= np.uint64(j + 1) << LEVEL
        if not open_.any():
            break
        alive = open_[owner]
        if slots is None:
            slots = np.tile(np.arange(size, dtype=np.uint8), (int(alive.sum()), 1))
            slots[np.arange(len(slots)), slot[alive]] = 0
        elif not alive.all():
            slots = slots[alive]
        if not alive.all():
            items, owner = items[alive], owner[alive]
    return sig


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band (signatures x bands)."""
    bands = sig.shape[1] // rows
    key = mix(np.arange(bands, dtype=np.uint64) * FACTORS[2] + FACTORS[3])[None, :].repeat(len(sig), 0)
    for r in range(rows):
        key = mix(key ^ mix(sig[:, r:bands * rows:rows] + FACTORS[4]))
    return key


def document_signatures(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Every row's id, set size and node; the first row of a node in a task
    also has its ``bands``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            sets = list(shingle_sets(pdf["text"], n))
            nodes = [set_digest(s) if len(s) else None for s in sets]
            fresh = [i for i, x in enumerate(nodes) if x is not None and x not in seen and not seen.add(x)]
            bands = [None] * len(sets)
            for at in range(0, len(fresh), 256):
                some = fresh[at:at + 256]
                for i, keys in zip(some, band_keys(signatures([sets[i] for i in some])).view(np.int64)):
                    bands[i] = keys
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets],
                                "node": pd.array(nodes, "Int64"), "bands": bands})
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInPandas(run, "doc_id long, n_shingles long, node long, bands array<long>"))


def tile_links(x: pd.DataFrame, y: pd.DataFrame, share: int) -> list[tuple[int, int]]:
    """Links between components that the rows of two leaves (columns
    component, n, diff) bring together; none that follows from others.

    Two sets differ in ``len(diff x) + len(diff y) - 2 both`` shingles; ``both``
    is counted for all pairs by products of incidence matrices over the
    shingles that occur on both sides."""
    left, right = ([np.asarray(d, np.int64) for d in side["diff"]] for side in (x, y))
    sizes = [np.array([len(d) for d in side], np.int64) for side in (left, right)]
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    both = np.zeros((len(left), len(right)), np.int64)
    places = []
    for side in (left, right):
        flat, row = np.concatenate(side), np.repeat(np.arange(len(side)), [len(d) for d in side])
        at = np.searchsorted(common, flat)
        hit = np.flatnonzero(common[np.minimum(at, len(common) - 1)] == flat) if len(common) else at[:0]
        places.append((row[hit], at[hit]))
    for begin in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - begin)
        parts = []
        for side, (row, at) in zip((left, right), places):
            m = np.zeros((len(side), width), np.float32)
            here = (at >= begin) & (at < begin + width)
            m[row[here], at[here] - begin] = 1
            parts.append(m)
        both += (parts[0] @ parts[1].T).astype(np.int64)
    total = x["n"].to_numpy(np.int64)[:, None] + y["n"].to_numpy(np.int64)
    shared = (total - (sizes[0][:, None] + sizes[1] - 2 * both)) // 2
    cx, cy = x["component"].to_numpy(np.int64), y["component"].to_numpy(np.int64)
    i, j = np.nonzero((100 * shared >= share * (total - shared)) & (cx[:, None] != cy))
    if not len(i):
        return []
    met = np.unique(np.stack((np.minimum(cx[i], cy[j]), np.maximum(cx[i], cy[j])), 1), axis=0)
    top: dict[int, int] = {}

    def root(c: int) -> int:
        while c in top:
            c = top[c]
        return c
    links = []
    for a, b in met.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            top[max(ra, rb)] = min(ra, rb)
            links.append((a, b))
    return links


def unsettled_links(star: DataFrame, comps: DataFrame, texts: DataFrame, n: int, share: int) -> DataFrame:
    """Links (a, b) between components among the members of one star that its
    pivot leaves apart.

    Only stars with members outside their pivot's component and another member
    are looked at.  Their members are dealt into leaves of bounded size, and
    every pair of leaves that holds an outside member is one tile."""
    named = (star.select("a", "b").join(comps.withColumnRenamed("node", "b"), "b", "left")
             .select("a", "b", F.coalesce("component", "b").alias("component"))
             .join(comps.select(F.col("node").alias("a"), F.col("component").alias("home")), "a", "left")
             .withColumn("main", F.col("component") == F.coalesce("home", "a")).drop("home"))
    stars = (named.groupBy("a").agg(F.count("*").alias("members"), F.count_if(~F.col("main")).alias("outside"))
             .where("members > 1 and outside > 0").select("a"))
    rows = cut_lineage(compared(named.join(stars, "a", "left_semi").select("a", "b", "component", "main"),
                                texts, n, share, differences=True))
    leaves = lambda of: F.greatest(
        F.ceil(F.count_if(of) / TILE), F.ceil(F.sum(F.when(of, F.size("diff")).otherwise(0)) / LEAF)).cast("int")
    counts = rows.groupBy("a").agg(leaves(~F.col("main")).alias("outer"), leaves(F.col("main")).alias("inner"))
    rows = (rows.join(counts, "a")
            .withColumn("leaf", F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.when(F.col("main"), F.col("inner"))
                                                                   .otherwise(F.col("outer")))).cast("int")))
    name = lambda left, main, right: F.xxhash64("a", left, main, right)
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    mine = F.concat(F.transform(F.sequence(F.col("leaf"), F.col("outer") - 1), lambda r: name("leaf", F.lit(False), r)),
                    F.transform(upto(F.col("inner")), lambda r: name("leaf", F.lit(True), r)))
    theirs = (F.when(F.col("main"), F.transform(upto(F.col("outer")), lambda m: name(m, F.lit(True), F.col("leaf"))))
              .otherwise(F.transform(F.sequence(F.lit(0), F.col("leaf")), lambda m: name(m, F.lit(False), F.col("leaf")))))
    columns = ("key", "component", "n", "diff")
    left = rows.where("not main").select(F.explode(mine), "component", "n", "diff").toDF(*columns)
    right = rows.select(F.explode(theirs), "component", "n", "diff").toDF(*columns)

    def work(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = tile_links(x, y, share) if len(x) and len(y) else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")
    return left.groupBy("key").cogroup(right.groupBy("key")).applyInPandas(work, "a long, b long")


def connected_nodes(docs: DataFrame, sets: DataFrame, n: int, share: int, text_col: str) -> DataFrame:
    """(node, component) of the nodes that have links."""
    cells = sets.where("bands is not null").select(F.explode("bands").alias("key"), "node")
    shared = cut_lineage(cells.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
                         .where("lo <> hi").select("key"))
    met = cut_lineage(cells.join(shared, "key", "left_semi").distinct())
    often = met.groupBy("node").agg(F.count("*").alias("cells"))
    pivot = (met.join(often, "node").groupBy("key").agg(F.max(F.struct("cells", "node")).alias("top"))
             .select("key", F.col("top.node").alias("a")))
    pairs = cut_lineage(met.join(pivot, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct())
    texts = cut_lineage(node_texts(docs, met.select("node").distinct(), n, text_col))
    star = cut_lineage(compared(pairs, texts, n, share))
    comps = connected_components(star.where("linked"))
    if star.where("not linked").limit(1).count() == 0:
        return comps
    comps = cut_lineage(comps)
    return connected_components(comps.select(F.col("component").alias("a"), F.col("node").alias("b"))
                                .union(unsettled_links(star, comps, texts, n, share)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                    share: int = 80) -> DataFrame:
    """Every row's id, ``n_shingles``, ``component_id`` (the smallest id
    reachable over links, Jaccard similarity of at least ``share`` percent)
    and ``kept``: whether its id is that one."""
    sets = cut_lineage(document_signatures(small_batches(docs), n, id_col, text_col))
    comps = connected_nodes(docs, sets, n, share, text_col)
    own = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = own.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = named.join(least, "component").select("node", "component_id")
    out = (sets.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
           .select("doc_id", "n_shingles",
                   F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumnRenamed("doc_id", id_col)

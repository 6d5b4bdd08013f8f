"""N-gram Jaccard join over count vectors.

Every document is the set of its distinct word shingles.  Two sets of sizes a
and b with Jaccard similarity of at least s differ in at most
D = (a + b)(1 - s)/(1 + s) shingles.  The join runs in four exact steps:

1. *Cells.*  Shingles are hashed into more than D groups; by the pigeonhole
   one group must then be identical in both sets.  D depends on the sizes, so
   sizes are cut into bands a factor 1/s apart and a document takes part in
   its own band and in the one below.  A cell is (band, group, content).
2. *Stars.*  In a cell every member is compared with one pivot only, the
   member met in most cells (the original of a family of copies).
3. *Count vectors.*  Every set has a count vector modulo two, a bit for each
   coordinate and about as many coordinates as elements; two of them differ
   in no more bits than the sets in elements.  Pairs whose sizes or bits
   exclude a link end here, before a text is moved: chance meetings in a cell,
   whose number grows faster than the documents.
   Pairs of a star that are not settled by the pivot (both linked to it, hence
   connected) and met in a cell of three or more are searched by the bits and,
   as far as these leave them, by count vectors of their differences to the
   pivot, or of their whole sets where these are smaller:
   members are put into zones of their distance and dealt by hash into leaves;
   a pair of leaves is opened only if their boxes, and a pair of points only
   if the summed coordinate minima, allow the required overlap.
4. *Verification* of the surviving pairs on the exact shingle sets.

A pure R-tree over the raw count vectors has nothing to prune: at these
similarities the search radius is wider than the spread of unrelated
documents in every coordinate, and it would compare nearly all pairs of
equal size.  Hence the cells in front of it and the vectors relative to the
pivot.  Equal sets are collapsed to one representative first.

Nodes of the graph are distinct sets, named by 64 bits of their digest; equal
sets meet in one node before any pair is made, whatever their number.

Null and empty texts (or white space only) have no shingles and link with
nothing.  Texts with fewer words than a shingle are one shingle.  Repeated
rows belong to one class.  A null id never names a class unless all its ids
are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envspark.llm.common import connected_components, cut_lineage, member_of, small_batches
from envspark.llm.hashing import FACTORS, mix
from envspark.llm.shingles import compared, set_digest, shingle_sets

GROUPS = 64             # coordinates of a count vector
LEAF = 1 << 17          # difference elements in a leaf of the tree
BITS_LEAF = 1 << 20     # elements in a leaf of sets given by their bits


class Bounds:
    """Sizes, bands and allowed differences for Jaccard >= share / 100."""

    def __init__(self, share: int):
        self.share = share
        self.edges = [1]                # first size of each band
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, -(-self.edges[-1] * 100 // share)))

    def most_difference(self, total):
        """Largest symmetric difference of linked sets of ``total`` elements."""
        return total * (100 - self.share) // (100 + self.share)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def difference(self, band: int) -> int:
        """Largest difference of linked sets the smaller of which is in ``band``."""
        small = self.edges[band + 1] - 1
        return int(self.most_difference(small + small * 100 // self.share))

    def linked(self, a, b, both):
        return 100 * both >= self.share * (a + b - both)


def _cells_of(s: np.ndarray, bounds: Bounds) -> np.ndarray:
    """Cell keys of a non-empty set.  A pair's smaller set is in the larger
    one's band or the one below, so both bands' groupings are used.

    Empty groups would bring unrelated sets together.  With D + 1 + spare
    groups at least 1 + spare are identical, so unless both sets have more
    than ``spare`` empty groups an identical one has elements; only sets with
    more than that need cells for their empty groups.
    """
    keys = [np.empty(0, np.uint64)]
    own = bounds.band(len(s))
    mixed = mix(s + np.uint64(0x51ED2701))
    for band in {max(own - 1, 0), own}:
        d = bounds.difference(band)
        if not d:
            continue                    # only equal sets link, and they are one node
        # half as many again as a random set of the band's least size leaves empty
        spare = 4 + int(1.6 * d * np.exp(-bounds.edges[band] / (1.08 * d + 4)))
        m = d + 1 + spare
        group = (mixed % np.uint64(m)).astype(np.intp)
        content = np.zeros(m, np.uint64)
        np.add.at(content, group, mixed)
        tag = np.arange(m, dtype=np.uint64) * FACTORS[0] + np.uint64((band + 1 << 32) + 1)
        cells = mix(content + mix(tag))
        filled = np.bincount(group, minlength=m) > 0
        keys.append(cells if m - filled.sum() > spare else cells[filled])
    return np.concatenate(keys)


def parities(s: np.ndarray) -> bytes:
    """The count vector of a set modulo two, one bit a coordinate.  There are
    at least 64 coordinates and as many as elements, a power of two, so the
    halves of a vector give the vector of half the coordinates.  Those of two
    sets differ in no more bits than the sets in elements."""
    size = max(64, 1 << (len(s) - 1).bit_length())
    counts = np.bincount((mix(s + FACTORS[5]) & np.uint64(size - 1)).astype(np.intp), minlength=size)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def _folded(bits: list[bytes], words: int) -> np.ndarray:
    """Vectors of ``words`` * 64 bits, one a row."""
    out = np.empty((len(bits), words), np.uint64)
    for i, b in enumerate(bits):
        v = np.frombuffer(b, np.uint64)
        while len(v) > words:
            v = v[:len(v) // 2] ^ v[len(v) // 2:]
        out[i] = v
    return out


def document_sets(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, set size and the node of every row (null without shingles), and
    a ``row`` key that tells apart rows of one id with different texts.  The
    first row of a node in a task also has its ``bits`` (see ``parities``)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            sets = list(shingle_sets(pdf["text"], n))
            nodes = [set_digest(s) if len(s) else None for s in sets]
            bits = [parities(s) if x is not None and x not in seen and not seen.add(x) else None for x, s in zip(nodes, sets)]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets],
                "node": pd.array(nodes, "Int64"), "row": pdf["row"], "bits": pd.Series(bits, dtype=object)})
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .withColumn("row", F.xxhash64("doc_id", "text"))
            .mapInPandas(run, "doc_id long, n_shingles long, node long, row long, bits binary"))


def texts_of(docs: DataFrame, sets: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One text for each of ``nodes`` (column node), found by its row key."""
    rows = cut_lineage(sets.where("node is not null").join(nodes, "node", "left_semi")
                       .groupBy("node").agg(F.min("row").alias("row")))
    own_key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    return (docs.where(member_of(rows.select("row"), own_key))
            .select(own_key.alias("row"), F.col(text_col).alias("text")).dropDuplicates(["row"])
            .join(rows, "row").select("node", "text"))


def document_cells(docs: DataFrame, n: int, bounds: Bounds, text_col: str) -> DataFrame:
    """(key, node) of every row's cells."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, nodes, held, seen = [], [], 0, set()
            for s in shingle_sets(pdf["text"], n):
                node = set_digest(s) if len(s) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                k = _cells_of(s, bounds).view(np.int64)
                keys.append(k)
                nodes.append(np.full(len(k), node, np.int64))
                held += len(k)
                if held > 200_000:
                    yield pd.DataFrame({"key": np.concatenate(keys), "node": np.concatenate(nodes)})
                    keys, nodes, held = [], [], 0
            if held:
                yield pd.DataFrame({"key": np.concatenate(keys), "node": np.concatenate(nodes)})
    return docs.select(F.col(text_col).alias("text")).mapInPandas(run, "key long, node long")


def _counts(items: list[np.ndarray]) -> np.ndarray:
    """Count vectors: elements hashed into GROUPS coordinates."""
    out = np.zeros((len(items), GROUPS), np.int32)
    for i, x in enumerate(items):
        if len(x):
            out[i] = np.bincount((mix(x.view(np.uint64)) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    return out


def leaf_links(left: pd.DataFrame, right: pd.DataFrame, bounds: Bounds) -> list[tuple[int, int]]:
    """Links between the points of two leaves (columns node, n, diff).

    The two sets differ in len(diff A) + len(diff B) - 2 both elements, and
    ``both`` is at most the summed coordinate minima of the count vectors -
    tested on the boxes, then on the points; survivors on the elements.
    """
    a, b = ([np.asarray(x, np.int64) for x in side["diff"]] for side in (left, right))
    na, nb = left["n"].to_numpy(np.int64), right["n"].to_numpy(np.int64)
    xa, xb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    ca, cb = _counts(a), _counts(b)
    if xa.min() + xb.min() - 2 * np.minimum(ca.max(0), cb.max(0)).sum() > bounds.most_difference(int(na.max() + nb.max())):
        return []
    ids, others = left["node"].to_numpy(), right["node"].to_numpy()
    links, sets = [], {}
    for i in range(len(a)):
        most = bounds.most_difference(na[i] + nb)
        near = np.flatnonzero(np.abs(xa[i] - xb) <= most)
        near = near[xa[i] + xb[near] - 2 * np.minimum(ca[i], cb[near]).sum(1) <= most[near]]
        if len(near):
            mine = set(a[i].tolist())
            for j in near:
                theirs = sets.get(j)
                if theirs is None:
                    theirs = sets[j] = set(b[j].tolist())
                if others[j] != ids[i] and xa[i] + xb[j] - 2 * len(mine & theirs) <= most[j]:
                    links.append((int(ids[i]), int(others[j])))
    return links


def near_pairs(pairs: DataFrame, sketches: DataFrame, bounds: Bounds) -> DataFrame:
    """Every pair (a, b) with the size ``n`` of b's set and whether sizes and
    bits allow a link (``near``).  ``sketches`` has node, n_shingles and bits."""
    side = lambda x: sketches.toDF(x, f"n_{x}", f"bits_{x}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            na, nb = pdf["n_a"].to_numpy(np.int64), pdf["n_b"].to_numpy(np.int64)
            most = bounds.most_difference(na + nb)
            near = np.abs(na - nb) <= most
            words = np.minimum(pdf["bits_a"].str.len(), pdf["bits_b"].str.len()).to_numpy(np.int64) // 8
            for w in np.unique(words[near]):
                at = np.flatnonzero(near & (words == w))
                va, vb = (_folded(pdf[c].iloc[at].tolist(), int(w)) for c in ("bits_a", "bits_b"))
                near[at] = np.bitwise_count(va ^ vb).sum(1) <= most[at]
            yield pdf[["a", "b", "wide"]].assign(n=nb, near=near)
    return (pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "wide", "n_a", "bits_a", "n_b", "bits_b")
            .mapInPandas(run, "a long, b long, wide boolean, n long, near boolean"))


def _tiles(star: DataFrame, bounds: Bounds, leaf: int) -> DataFrame:
    """The tiles of every member of a star in which it may meet a partner: a,
    b, ``plain`` (given by its whole set) and the tiles on either side.

    ``star`` has rows a (pivot), b (member), linked, n (set size) and x (its
    distance to one set).  The distances of linked members differ by at most D,
    so members are put into zones of that width (each into two, so that
    neighbours meet) and only zones with an open member and a partner go on.
    Leaves hold about ``leaf`` elements; a pair of leaves is one tile's work,
    so a large family spreads over many.
    """
    open_ = (star.groupBy("a").agg(
        F.count("*").alias("members"), F.count_if(~F.col("linked")).alias("rest"),
        (F.sum("n") < F.sum("x")).alias("plain"),
        (F.max("n") * 2 * (100 - bounds.share) / (100 + bounds.share) + 1).alias("width"))
        .where("members > 1 and rest > 0").select("a", "plain", "width"))
    zoned = (star.join(open_, "a").withColumn("x", F.when(F.col("plain"), F.col("n")).otherwise(F.col("x")))
             .withColumn("c", F.floor(F.col("x") / F.col("width")))
             .select("a", "b", "plain", "linked", "x", F.explode(F.array(F.col("c"), F.col("c") + 1)).alias("zone")))
    leaves = lambda of: F.ceil(F.sum(F.when(of, F.col("x") + 1).otherwise(0)) / leaf).cast("int")
    zones = (zoned.groupBy("a", "zone")
             .agg(F.count("*").alias("members"), leaves(~F.col("linked")).alias("open_leaves"),
                  leaves(F.col("linked")).alias("linked_leaves"))
             .where("members > 1 and open_leaves > 0").drop("members"))
    rows = (zoned.join(zones, ["a", "zone"])
            .withColumn("leaf", F.pmod(F.xxhash64("b"), F.when(F.col("linked"), F.col("linked_leaves"))
                                       .otherwise(F.col("open_leaves"))).cast("int")))
    none = F.array().cast("array<long>")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda left, linked, right: F.xxhash64("a", "zone", left, linked, right)
    mine = F.concat(F.transform(F.sequence(F.col("leaf"), F.col("open_leaves") - 1), lambda r: tile("leaf", F.lit(False), r)),
                    F.transform(upto(F.col("linked_leaves")), lambda r: tile("leaf", F.lit(True), r)))
    theirs = (F.when(F.col("linked"), F.transform(upto(F.col("open_leaves")), lambda m: tile(m, F.lit(True), F.col("leaf"))))
              .otherwise(F.transform(F.sequence(F.lit(0), F.col("leaf")), lambda m: tile(m, F.lit(False), F.col("leaf")))))
    return (rows.select("a", "b", "plain", F.when(F.col("linked"), none).otherwise(mine).alias("mine"), theirs.alias("theirs"))
            .groupBy("a", "b", "plain")
            .agg(F.flatten(F.collect_list("mine")).alias("mine"), F.flatten(F.collect_list("theirs")).alias("theirs")))


def _dealt(tiled: DataFrame, *columns: str) -> DataFrame:
    """A row for each tile and side of every member, with some of its columns."""
    sided = lambda of, left: F.transform(of, lambda t: F.struct(t.alias("tile"), F.lit(left).alias("mine")))
    return (tiled.select(*columns, F.explode(F.concat(sided("mine", True), sided("theirs", False))).alias("t"))
            .select("t.tile", "t.mine", *columns))


def near_members(tiles: pd.DataFrame, bounds: Bounds) -> pd.DataFrame:
    """The members (a, b) whose sizes and bits allow a link with a member on
    the other side of their tile (null: on both).  Rows have tile (ascending),
    mine, a, b, n_shingles and bits."""
    tile, mine, nodes = tiles["tile"].to_numpy(), tiles["mine"].to_numpy(object), tiles["b"].to_numpy()
    either = pd.isna(mine)
    mine, theirs_too = np.where(either, True, mine).astype(bool), either | (mine == False)  # noqa: E712
    size, bits = tiles["n_shingles"].to_numpy(np.int64), tiles["bits"].to_numpy()
    cuts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True])
    out = np.zeros(len(tiles), bool)
    for lo, hi in zip(cuts, cuts[1:]):
        left, right = lo + np.flatnonzero(mine[lo:hi]), lo + np.flatnonzero(theirs_too[lo:hi])
        if not len(left) or not len(right):
            continue
        words = min(len(b) for b in bits[lo:hi]) // 8
        ours, theirs = _folded(bits[left], words), _folded(bits[right], words)
        for i, v in zip(left, ours):
            most = bounds.most_difference(size[i] + size[right])
            some = np.flatnonzero((np.abs(size[i] - size[right]) <= most) & (nodes[right] != nodes[i]))
            some = some[np.bitwise_count(theirs[some] ^ v).sum(1) <= most[some]]
            out[i] |= len(some) > 0
            out[right[some]] = True
    return tiles.loc[out, ["a", "b"]].drop_duplicates()


def open_members(star: DataFrame, sketches: DataFrame, bounds: Bounds) -> DataFrame:
    """The members (a, b) of a star that their bits allow a link with another
    member of it, unless both are linked with the pivot.  ``star`` has a, b,
    linked and n.  A star of up to BITS_LEAF elements is one tile, in which its
    members are once each; only larger ones are dealt into zones and leaves, by
    the sizes of their sets."""
    star = star.withColumn("n", F.greatest("n", F.lit(64))).withColumn("x", F.col("n"))    # 64 bits at least
    size = (star.groupBy("a").agg(F.count("*").alias("members"), F.count_if(~F.col("linked")).alias("rest"),
                                  (F.sum("n") <= BITS_LEAF).alias("small"))
            .where("members > 1 and rest > 0").select("a", "small"))
    star = star.join(size, "a")
    sides = F.when(~F.col("linked"), F.lit(None).cast("boolean")).otherwise(False)
    bits = sketches.withColumnRenamed("node", "b")
    small = star.where("small").select(F.col("a").alias("tile"), sides.alias("mine"), "a", "b")
    large = _dealt(_tiles(star.where("not small").drop("small"), bounds, BITS_LEAF), "a", "b")
    dealt = small.union(large).join(bits, "b").select("tile", "mine", "a", "b", "n_shingles", "bits")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []       # rows of one tile
        for pdf in batches:
            if not len(pdf):
                continue
            tile = pdf["tile"].to_numpy()
            cut = int((tile != tile[-1]).sum())     # rows are sorted by tile
            if held and (cut or held[0]["tile"].iat[0] != tile[-1]) or cut:
                yield near_members(pd.concat([*held, pdf.iloc[:cut]]), bounds)
                held = []
            held.append(pdf.iloc[cut:])
        if held:
            yield near_members(pd.concat(held), bounds)
    return (dealt.repartition("tile").sortWithinPartitions("tile")
            .mapInPandas(run, "a long, b long").distinct())


def rest_links(star: DataFrame, texts: DataFrame, n: int, bounds: Bounds) -> DataFrame:
    """Links (a, b) among members of one star of which at least one is not
    linked with the pivot.  ``star`` has rows a (pivot), b (member), linked, n
    (set size) and x (size of its difference to the pivot).

    Members are told apart by their differences to one set: the pivot, or the
    empty set where the members' whole sets are smaller than their differences
    to the pivot (texts that have little in common with it).  Zones and leaves
    use sizes; elements are fetched for the members left and moved once, to
    the tiles.
    """
    dealt = _dealt(compared(cut_lineage(_tiles(star, bounds, LEAF)), texts, n, bounds.share, differences=True)
                   .withColumn("node", F.col("b")), "node", "n", "diff")

    def work(members: pd.DataFrame) -> pd.DataFrame:
        a, b = members[members["mine"]], members[~members["mine"]]
        found = leaf_links(a, b, bounds) if len(a) and len(b) else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")
    return dealt.groupBy("tile").applyInPandas(work, "a long, b long")


def set_links(docs: DataFrame, sets: DataFrame, n: int, share: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between nodes that connect what similarity connects.
    ``sets`` are the documents' sets (``document_sets``).

    Two members that are not linked with the pivot of their cell share a cell
    of three or more, so only such cells make a pair ``wide``."""
    bounds = Bounds(share)
    key = Window.partitionBy("key")
    met = cut_lineage(document_cells(docs, n, bounds, text_col)
                      .withColumn("lo", F.min("node").over(key)).withColumn("hi", F.max("node").over(key))
                      .where("lo <> hi").select("key", "node").distinct())
    met_often = met.groupBy("node").agg(F.count("*").alias("cells"))
    pivot = (met.join(met_often, "node").groupBy("key")
             .agg(F.max(F.struct("cells", "node")).alias("top"), (F.count("*") > 2).alias("wide"))
             .select("key", F.col("top.node").alias("a"), "wide"))
    pairs = (met.join(pivot, "key").where("node <> a").groupBy("a", F.col("node").alias("b"))
             .agg(F.max("wide").alias("wide")))
    sketches = cut_lineage(sets.where("bits is not null").join(met_often, "node", "left_semi")
                           .select("node", "n_shingles", "bits").dropDuplicates(["node"]))
    judged = cut_lineage(near_pairs(pairs, sketches, bounds))
    ends = lambda of: of.select(F.col("a").alias("node")).union(of.select("b")).distinct()

    def star_of(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        texts = cut_lineage(texts_of(docs, sets, ends(some), id_col, text_col))
        return texts, cut_lineage(compared(some, texts, n, share, sizes=True))
    _, star = star_of(judged.where("near").select("a", "b", "wide"))
    members = (star.where("wide").select("a", "b", "linked", "n")
               .union(judged.where("wide and not near").select("a", "b", F.lit(False), "n")))
    texts, rest = star_of(cut_lineage(open_members(members, sketches, bounds)))
    return star.where("linked").select("a", "b").union(rest_links(rest, texts, n, bounds))


def _components(docs: DataFrame, id_col: str, text_col: str, n: int, share: int) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows, and (node, component) of the distinct ones."""
    sets = cut_lineage(document_sets(small_batches(docs), n, id_col, text_col))
    comps = connected_components(set_links(docs, sets, n, share, id_col, text_col))
    nodes = sets.where("node is not null").select("node").distinct()
    return sets, (nodes.join(comps, "node", "left")
                  .select("node", F.coalesce("component", "node").alias("component")))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4,
                    share: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest id
    reachable over links (Jaccard similarity of at least ``share`` percent)."""
    sets, comps = _components(docs, id_col, text_col, n, share)
    own = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = own.join(comps, "node")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = named.join(least, "component").select("node", "component_id")
    return (sets.join(of_node, "node", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumnRenamed("doc_id", id_col))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, share: int = 80) -> DataFrame:
    """The documents without near duplicates: of each class one row stays,
    with all its columns - that of the smallest id (null ids last), of equal
    ids that of the smallest ``row`` key, of rows that agree in id and text any
    one.  Rows without shingles stay."""
    sets, comps = _components(docs, id_col, text_col, n, share)
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")
    own = sets.where("node is not null").groupBy("node").agg(F.min(place).alias("first")).join(comps, "node")
    first = own.groupBy("component").agg(F.min("first").alias("first"))
    kept = own.join(first.withColumnRenamed("first", "stays"), "component").select("node", F.col("stays.row").alias("stays"))
    rows = cut_lineage(sets.join(kept, "node").groupBy("row").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
                       .where("row <> stays or n > 1"))
    gone = rows.where("row <> stays").select(F.col("row").alias("__row"))
    repeated = rows.where("row = stays").select(F.col("row").alias("__row"))
    own_key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    maybe = member_of(rows.select("row"), own_key)
    left = docs.where(maybe).withColumn("__row", own_key).join(gone, "__row", "left_anti")
    once = left.join(repeated, "__row", "left_semi").dropDuplicates(["__row"])
    return (left.join(repeated, "__row", "left_anti").union(once).select(*docs.columns)
            .union(docs.where(~maybe)))

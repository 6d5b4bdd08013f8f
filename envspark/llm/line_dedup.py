"""Line dedup by a segment-partition edit join.

Two lines within ``tau`` edits share a segment: the shorter one is cut into
tau + 1 segments, the edits touch at most tau of them, and the untouched one
stands in the longer line at a place shifted by at most tau.  Every line
indexes its own segments and probes, for each length it may be near to, the
few shifts that can still lead to tau edits in total.  Equal keys meet in a
cell; candidates of a cell are checked by letter counts and then by a banded
bit-parallel edit distance.  Lines that link, directly or over others, are
one class; the earliest occurrence (document, line) of a class stays.

Only DataFrame functions are used.  Repeated lines meet before any join: a
line that occurs more than ``hot`` times is taken once, so a line in a third
of all documents adds one row to its cells.  In a cell, members are first
compared with one pivot (the member of most cells); only pairs that are not
both linked to it are compared with each other.

Lines are compared as they are.  Lines below ``min_chars`` code points take no
part in the edit join (two edits would turn one into another); equal ones are
one class from ``exact_chars`` code points on (``min_chars`` unless given).
Shorter lines of white space only separate others and stay.  Null and empty texts
have no lines; a null id ranks last; rows with the same id and different texts
are told apart by a key of id and text.  Rows that agree in both share their
places in ``line_classes``; ``remove_lines`` keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envspark.llm.common import connected_components, cut_lineage, member_of

TAU, MIN_CHARS, HOT = 2, 30, 1000
LETTERS = "eatinorsdhlcumg, "


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_chars: int, exact_chars: int | None = None) -> DataFrame:
    """doc_id, row key, line_no, line and its 64-bit hash, for lines long
    enough and, from ``exact_chars`` on, shorter ones that are not blank."""
    taken = F.length("line") >= min_chars
    if exact_chars is not None:
        taken = taken | (F.length("line") >= exact_chars) & F.col("line").rlike(r"\S")
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__t"))
            .select("doc_id", F.xxhash64("doc_id", "__t").alias("row"),
                    F.posexplode(F.split("__t", "\n", -1)).alias("line_no", "line"))
            .where(taken)
            .withColumn("node", F.xxhash64("line")))


def lookups(tau: int) -> list[tuple[int, int, int, bool]]:
    """(segment, length difference, shift, probe): a line's own segments, and
    for each difference to a shorter line the shifts after which the edits
    left and right of the segment can still add up to tau."""
    probes = [(i, dl, d, True) for dl in range(tau + 1) for i in range(tau + 1) for d in range(-tau, tau + 1)
              if abs(d) <= i and abs(d - dl) <= tau - i and (dl or d)]
    return [(i, 0, 0, False) for i in range(tau + 1)] + probes


def cells_of(lines: DataFrame, tau: int) -> DataFrame:
    """(key, node, probe) of every line: its own segments, and the substrings
    it looks up among the segments of lines up to tau shorter.

    A line of length n is cut into k = tau + 1 segments of n div k code
    points, the last n mod k of them longer by one.
    """
    k = tau + 1
    plan = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dl).alias("dl"), F.lit(d).alias("d"), F.lit(p).alias("probe"))
                     for i, dl, d, p in lookups(tau)])
    rows = (lines.select("node", "line", F.length("line").alias("n"), F.explode(plan).alias("c"))
            .select("node", "line", "n", "c.i", "c.dl", "c.d", "c.probe")
            .withColumn("m", F.col("n") - F.col("dl"))
            .withColumn("more", F.col("m") % k)
            .withColumn("short", F.col("i") - (k - F.col("more")))
            .withColumn("size", ((F.col("m") - F.col("more")) / k).cast("int") + (F.col("short") >= 0).cast("int"))
            .withColumn("start", F.col("i") * ((F.col("m") - F.col("more")) / k).cast("int")
                        + F.greatest(F.lit(0), F.col("short")) + F.col("d")))
    return (rows.where(f"m > {tau} and start >= 0 and start + size <= n")
            .select(F.xxhash64("i", "m", F.substring(F.col("line"), F.col("start") + 1, F.col("size"))).alias("key"),
                    "node", "probe"))


def _equal_bits(x: Column, y: Column, bit: int) -> Column:
    return F.zip_with(x, y, lambda p, q: F.when(p == q, bit).otherwise(0))


def edits(a: Column, b: Column, tau: int) -> Column:
    """Edit distance of two strings up to tau, else null.

    Row e of the state is a word of 2 tau + 1 bits; bit k says that after j
    characters of b, j + k - tau characters of a can be matched with e edits.
    One step compares b's next character with a's band and moves all rows by
    bit operations: match, substitute, insert (shift down), delete (shift up).
    """
    width = 2 * tau + 1
    full = (1 << width) - 1
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    pad = F.array_repeat(F.lit(""), tau)
    band, cb = F.concat(pad, chars(a), pad, pad), chars(b)
    # bit k of the j-th mask: b's j-th character is the one k places into its band
    masks = None
    for k in range(width):
        bit = _equal_bits(cb, F.slice(band, k + 1, F.greatest(F.size(cb), F.lit(0))), 1 << k)
        masks = bit if masks is None else F.zip_with(masks, bit, lambda x, y: x + y)
    rows = [f"r{e}" for e in range(tau + 1)]
    kind = "struct<" + ",".join(f"{r}:int" for r in rows) + ">"
    # before any character of b: e characters of a deleted with e edits
    zero = F.struct(*[F.lit(sum(1 << (tau + x) for x in range(e + 1)) & full).alias(r) for e, r in enumerate(rows)]).cast(kind)

    def step(s, x):
        new = []
        for e, r in enumerate(rows):
            v = s[r].bitwiseAND(x)
            if e:
                low = s[rows[e - 1]]
                v = v.bitwiseOR(low).bitwiseOR(F.shiftright(low, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(full))
            new.append(v)
        return F.when(s[rows[-1]] == 0, s).otherwise(F.struct(*[v.alias(r) for v, r in zip(new, rows)]).cast(kind))

    def finish(s):
        bit = F.pow(F.lit(2), F.length(a) - F.length(b) + tau).cast("int")
        hit = F.lit(None).cast("int")
        for e in reversed(range(tau + 1)):
            hit = F.when(s[rows[e]].bitwiseAND(bit) != 0, e).otherwise(hit)
        return hit
    return F.when(F.abs(F.length(a) - F.length(b)) <= tau, F.aggregate(masks, zero, step, finish))


def _counts(line: Column) -> Column:
    return F.array(*[(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).cast("int") for c in LETTERS])


def _count_gap(a: str, b: str) -> Column:
    gap = F.lit(0)
    for i in range(len(LETTERS)):
        gap = gap + F.abs(F.get(F.col(a), i) - F.get(F.col(b), i))
    return gap


def line_links(lines: DataFrame, once: DataFrame, tau: int) -> DataFrame:
    """Links (a, b) between nodes of distinct lines within tau edits that
    connect all that are within tau edits.  ``lines`` has every line,
    ``once`` the lines to take (frequent ones a single time)."""
    key = Window.partitionBy("key")
    met = cut_lineage(cells_of(once, tau)
                      .withColumn("lo", F.min("node").over(key)).withColumn("hi", F.max("node").over(key))
                      .withColumn("all_probe", F.min("probe").over(key))
                      .where("lo <> hi and not all_probe").select("key", "node", "probe").distinct())
    often = met.groupBy("node").agg(F.countDistinct("key").alias("cells"))
    pivot = (met.join(often, "node").groupBy("key").agg(F.max(F.struct("cells", "node")).alias("top"))
             .select("key", F.col("top.node").alias("pivot")))
    held = cut_lineage(met.join(pivot, "key"))
    texts = cut_lineage(once.where(member_of(often.select("node"), F.col("node")))
                        .join(often.select("node"), "node", "left_semi")
                        .groupBy("node").agg(F.min("line").alias("line"))
                        .withColumn("len", F.length("line")).withColumn("counts", _counts(F.col("line"))))
    side = lambda n: texts.select(F.col("node").alias(n), F.col("line").alias(f"{n}_line"),
                                  F.col("len").alias(f"{n}_len"), F.col("counts").alias(f"{n}_counts"))
    near = (F.abs(F.col("a_len") - F.col("b_len")) <= tau) & (_count_gap("a_counts", "b_counts") <= 2 * tau)

    def verify(pairs):
        return (pairs.join(side("a"), "a").join(side("b"), "b").where(near)
                .where(edits(F.col("a_line"), F.col("b_line"), tau).isNotNull()).select("a", "b"))
    stars = held.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    linked = cut_lineage(verify(stars))
    # members with what the cell needs for the pair test
    settled = linked.select(F.col("a").alias("pivot"), F.col("b").alias("node"), F.lit(True).alias("linked"))
    rows = (held.join(settled, ["pivot", "node"], "left")
            .withColumn("settled", F.coalesce("linked", F.col("node") == F.col("pivot")))
            .select("key", "node", "probe", "settled"))
    open_ = rows.where("not settled").select("key").distinct()
    rows = rows.join(open_, "key", "left_semi")
    left = rows.where("not probe").select("key", F.col("node").alias("a"), F.col("settled").alias("a_settled"))
    right = rows.select("key", F.col("node").alias("b"), F.col("settled").alias("b_settled"), F.col("probe").alias("b_probe"))
    left = left.join(side("a").drop("a_line"), "a")
    right = right.join(side("b").drop("b_line"), "b")
    rest = (left.join(right, (left["key"] == right["key"]) & (F.col("a") != F.col("b"))
                      & (F.col("b_probe") | (F.col("a") < F.col("b")))
                      & ~(F.col("a_settled") & F.col("b_settled")) & near)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return linked.select("a", "b").union(verify(rest))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU,
                 min_chars: int = MIN_CHARS, hot: int = HOT, exact_chars: int | None = None) -> DataFrame:
    """Every line that is not the first of its class: doc_id, line_no, node,
    class_id (smallest node), and the kept place (kept_doc_id, kept_line_no)."""
    return _later_lines(docs, id_col, text_col, tau, min_chars, hot, exact_chars).drop("row")


def _later_lines(docs, id_col, text_col, tau, min_chars, hot, exact_chars) -> DataFrame:
    lines = lines_of(docs, id_col, text_col, min_chars, exact_chars)
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row", "line_no")
    counts = cut_lineage(lines.groupBy("node").agg(F.count("*").alias("n"), F.min(place).alias("first")))
    frequent = counts.where(F.col("n") > hot).select("node")
    # lines that the sketch takes for frequent without need are only taken once too
    often = F.coalesce(member_of(frequent, F.col("node")), F.lit(False))
    long = lines.where(F.length("line") >= min_chars)
    once = (long.select("node", "line").where(~often)
            .union(long.where(often).groupBy("node").agg(F.min("line").alias("line"))))
    comps = connected_components(line_links(long, once, tau))
    classed = counts.join(comps, "node", "left").withColumn("class_id", F.coalesce("component", "node"))
    first = classed.groupBy("class_id").agg(F.min("first").alias("kept"), F.sum("n").alias("lines")).where("lines > 1")
    of_node = (classed.join(first, "class_id")
               .select("node", "class_id", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.row").alias("kept_row"),
                       F.col("kept.line_no").alias("kept_line_no")))
    return (lines.select("doc_id", "row", "line_no", "node").join(of_node, "node")
            .where("not (row = kept_row and line_no = kept_line_no)")
            .select("doc_id", "row", "line_no", "node", "class_id", "kept_doc_id", "kept_line_no"))


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU,
                 min_chars: int = MIN_CHARS, hot: int = HOT, length_col: str | None = None,
                 exact_chars: int | None = None) -> DataFrame:
    """The documents with their repeated lines taken out (all columns kept;
    a document without repeated lines is untouched; one of which nothing is
    left is gone).  Of rows that agree in id and text, and have lines, one
    stays.  ``length_col`` is brought up to date."""
    cut = (_later_lines(docs, id_col, text_col, tau, min_chars, hot, exact_chars)
           .groupBy("row").agg(F.sort_array(F.collect_set("line_no")).alias("gone")))
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    blank = F.trim(F.coalesce(F.col(text_col), F.lit(""))) == ""
    copies = (docs.where(~blank).select(key.alias("row")).groupBy("row").agg(F.count("*").alias("n")).where("n > 1")
              .select("row", F.lit(True).alias("copies")))
    changed = cut_lineage(cut.join(copies, "row", "full").select(F.col("row").alias("__row"), F.col("gone").alias("__gone"),
                                                                  F.coalesce("copies", F.lit(False)).alias("__copies")))
    maybe = member_of(changed.select("__row"), key)
    kept = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda _, i: ~F.array_contains("__gone", i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept)
    touched = docs.where(maybe).withColumn("__row", key).join(changed, "__row", "left")
    several = F.coalesce("__copies", F.lit(False))
    touched = touched.where(~several).union(touched.where(several).dropDuplicates(["__row"]))
    touched = touched.where(F.col("__gone").isNull() | (F.trim(kept) != ""))
    new = {text_col: text}
    if length_col:
        new[length_col] = F.when(F.col("__gone").isNull(), F.col(length_col)).otherwise(
            F.length(kept).cast(docs.schema[length_col].dataType))
    return (touched.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
            .union(docs.where(~maybe)))

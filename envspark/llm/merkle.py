"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves.

A text is cut into paragraphs (lines).  A paragraph's digest is the SHA-256
of its text; sections are runs of paragraphs ended by a blank paragraph or by
a digest that starts with 0 (so section borders follow content, and an edit
moves no other border); section digests hash their paragraphs' digests and
the root hashes the sections'.  Equal roots mean equal texts, and comparing
levels from the top locates the edited paragraphs.  Below the paragraphs,
leaves are pieces of 16 to 64 code points that end at a content-defined place
(a word ending in a frequent letter or a punctuation mark), and the words of
paragraphs below 64 code points; the share of common leaves is the likeness of two trees.

Only DataFrame functions are used.  Null reads as the empty text, whose tree
has one empty paragraph and no leaves; two empty trees have likeness 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envspark.llm.common import blank

LEAF = r"(?s).{16,64}?[snde.,;:!?。、](?:\s+|$)|.{1,64}"
WORD = r"\S+"
FIRST_ID = -(1 << 63)      # a null id sorts as the smallest


def with_tree(df: DataFrame, text: Column, prefix: str) -> DataFrame:
    """Add <prefix>root, <prefix>sections, <prefix>paragraphs (hex digests)
    and <prefix>leaves (64-bit hashes, distinct) for a text column."""
    c = lambda name: f"{prefix}{name}"
    kind = "struct<cur:string,out:array<string>>"
    zero = F.struct(F.lit("").alias("cur"), F.array().alias("out")).cast(kind)
    empty = F.sha2(F.lit(""), 256)

    def step(a, digest):
        cur = F.concat(a["cur"], digest)
        ends = (digest == empty) | digest.startswith("0")
        return F.when(ends, F.struct(F.lit("").alias("cur"),
                                     F.concat(a["out"], F.array(F.sha2(cur, 256))).alias("out")).cast(kind)) \
            .otherwise(F.struct(cur.alias("cur"), a["out"].alias("out")).cast(kind))

    def finish(a):
        return F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(F.sha2(a["cur"], 256))))
    return (df
            .withColumn(c("lines"), F.split(text, "\n", -1))
            .withColumn(c("paragraphs"), F.transform(c("lines"), lambda p: F.sha2(p, 256)))
            .withColumn(c("leaves"), F.array_distinct(F.flatten(F.transform(
                c("lines"), lambda p: F.transform(
                    F.when(F.length(p) < 64, F.regexp_extract_all(p, F.lit(WORD), F.lit(0)))
                    .otherwise(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0))), lambda x: F.xxhash64(x))))))
            .drop(c("lines"))
            .withColumn(c("sections"), F.aggregate(c("paragraphs"), zero, step, finish))
            .withColumn(c("root"), F.sha2(F.array_join(c("sections"), ""), 256)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two leaf arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union).cast("double")


def fingerprint(prefix: str = "") -> Column:
    """The root and the leading digits of the section digests."""
    return F.concat_ws(":", F.col(f"{prefix}root"),
                       F.array_join(F.transform(f"{prefix}sections", lambda s: F.substring(s, 1, 16)), "."))


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of ``a`` whose digest is not in
    ``b``: where the two trees differ."""
    return F.filter(F.transform(a, lambda p, i: F.when(F.array_contains(b, p), -1).otherwise(i)), lambda i: i >= 0)


def document_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, root, sections, paragraphs and leaves of every row."""
    t = docs.select(F.col(id_col), blank(text_col).alias("__t"))
    return with_tree(t, F.col("__t"), "").drop("__t")


def with_next(docs: DataFrame, id_col: str, text_col: str, rows_per_bucket: int = 20_000) -> tuple[DataFrame, Window]:
    """Rows dealt out in ranges of descending id, so that the next row of
    each is the next in its range: columns __id, __text, __bucket, __halo and
    the window.  The first row of a range is also given (as halo) to the
    range before it, and the very first row to the last range.

    Only range bounds and the largest id of each range come to the driver
    (one number per ``rows_per_bucket`` rows, at most 65536).
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID))
    src = docs.select(F.col(id_col).cast("long").alias("__id"), blank(text_col).alias("__text"), key.alias("__key"))
    ids = docs.select(key.alias("__key"))
    n = ids.count()
    buckets = max(1, min(65_536, -(-n // rows_per_bucket)))
    bounds = []
    if buckets > 1:
        share = [i / buckets for i in range(1, buckets)]
        bounds = sorted(set(ids.agg(F.percentile_approx("__key", share, max(10_000, 4 * buckets))).first()[0]))

    if bounds:
        arr = F.array(*[F.lit(int(b)) for b in bounds])
        steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
        pair = "struct<lo:int,hi:int>"

        def halve(a, _):
            mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
            right = F.element_at(arr, mid + 1) <= F.col("__key")
            return F.when(a["lo"] >= a["hi"], a).otherwise(
                F.when(right, F.struct((mid + 1).alias("lo"), a["hi"].alias("hi")).cast(pair))
                .otherwise(F.struct(a["lo"].alias("lo"), mid.alias("hi")).cast(pair)))
        bucket = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")).cast(pair),
                             halve, lambda a: a["lo"])
    else:
        bucket = F.lit(0)
    heads = {r[0]: r[1] for r in ids.select(bucket.alias("b"), "__key").groupBy("b").agg(F.max("__key")).collect()}
    order = sorted(heads)
    target = {b: order[i + 1] if i + 1 < len(order) else order[0] for i, b in enumerate(order)}
    at = range(len(bounds) + 1)
    head = F.array(*[F.lit(heads.get(b)).cast("long") for b in at])
    to = F.array(*[F.lit(target.get(b)).cast("int") for b in at])
    dealt = (src.withColumn("__b", bucket)
             .withColumn("__places", F.when(
                 F.element_at(head, F.col("__b") + 1) == F.col("__key"),
                 F.array(F.struct(F.col("__b").alias("b"), F.lit(False).alias("halo")),
                         F.struct(F.element_at(to, F.col("__b") + 1).alias("b"), F.lit(True).alias("halo"))))
                 .otherwise(F.array(F.struct(F.col("__b").alias("b"), F.lit(False).alias("halo"))))))
    dealt = (dealt.withColumn("__place", F.explode("__places"))
             .select("__id", "__text", "__key", F.col("__place.b").alias("__bucket"), F.col("__place.halo").alias("__halo")))
    w = Window.partitionBy("__bucket").orderBy(F.asc("__halo"), F.desc("__key"), F.desc("__text"))
    return dealt, w


def neighbour_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     rows_per_bucket: int = 20_000) -> DataFrame:
    """Fingerprints of each text, of the text whose last third is replaced by
    the beginning of the next document's (descending id, then the first), and
    the likenesses.  Equal ids follow each other by descending text."""
    dealt, w = with_next(docs, id_col, text_col, rows_per_bucket)
    third = F.floor(F.length("__text") / 3).cast("int")
    d = (dealt.withColumn("__next", F.lead("__text").over(w))
         .withColumn("__edited", F.when(~F.col("__halo"), F.concat(
             F.substring(F.col("__text"), F.lit(1), F.length("__text") - third),
             F.substring(F.coalesce("__next", F.lit("")), F.lit(1), third))).otherwise(F.lit("")))
         .drop("__next"))
    d = with_tree(d, F.col("__text"), "__own_")
    d = with_tree(d, F.col("__edited"), "__new_")
    d = d.withColumn("__ahead", F.lead("__own_leaves").over(w)).where("not __halo")
    return d.select(
        F.col("__id").alias(id_col), F.length("__text").cast("long").alias("n_chars"),
        F.sha2("__edited", 256).alias("edited_sha256"),
        fingerprint("__own_").alias("fingerprint"), fingerprint("__new_").alias("edited_fingerprint"),
        likeness(F.col("__own_leaves"), F.col("__new_leaves")).alias("near_edited"),
        likeness(F.col("__own_leaves"), F.col("__ahead")).alias("near_next"),
        F.size(changed_paragraphs(F.col("__own_paragraphs"), F.col("__new_paragraphs"))).alias("n_changed_paragraphs"))

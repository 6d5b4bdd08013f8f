"""Substring dedup by unit hashing.

Units are the sentences of each line (cut after terminators and at line
ends), normalised to lower-case words.  Digests are grouped over the whole
corpus; the occurrence with the smallest (document, offset) is kept and every
other one is marked with its original code-point offsets.  Marked units of a
row that follow each other form a run, whose words are given; runs of fewer
than ``min_words`` words stay (the registered query marks all).

Null and empty texts have no units.  A null document id ranks last.  Repeated
rows are repeated occurrences: all but the first are marked.  A row is told
from others of its id by the hash of its text (``row``) and a number among
equal rows (``copy``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envspark.llm.common import small_batches

UNIT = re.compile(r"[^\n.!?]*[.!?]+|[^\n.!?]+")
WORDS = re.compile(r"\w+")
COLUMNS = ["doc_id", "row", "unit", "start", "end", "n_words", "h1", "h2"]
SCHEMA = "doc_id long, row long, unit int, start int, end int, n_words int, h1 long, h2 long"


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, row, text in zip(pdf["doc_id"].astype("Int64"), pdf["row"], pdf["text"]):
            k = 0
            for m in UNIT.finditer(text or ""):
                words = WORDS.findall(m[0].lower())
                if words:
                    h = xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))
                    out.append((doc, row, k, m.start(), m.end(), len(words), (h >> 64) - (1 << 63),
                                (h & ((1 << 64) - 1)) - (1 << 63)))
                    k += 1
                if len(out) >= 100_000:
                    yield _frame(out)
                    out = []
        yield _frame(out)


def _frame(out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=COLUMNS)
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All units of all texts: document, hash of the text, number among its
    units with words, [start, end) in code points, words and the 128-bit
    digest of the normalised unit."""
    return (small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                                       F.xxhash64(text_col).alias("row"))
            .mapInPandas(_cut, SCHEMA))


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = 20) -> DataFrame:
    """The units to remove: doc_id, start, end, n_words, run_words, the kept
    occurrence (kept_doc_id, kept_start), and row and copy.

    One aggregate over digests (combined map-side, so a unit in every
    document is a few rows per task) and one equi-join back, whose hot
    digests adaptive execution splits.  Only repeated units reach the windows
    per row that number equal rows and measure the runs.
    """
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "start", "row")
    u = units(docs, id_col, text_col)
    kept = (u.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("kept")).where("n > 1")
            .select("h1", "h2", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"),
                    F.col("kept.row").alias("kept_row")))
    # the units of equal rows are numbered alike, whichever row each is from
    marked = (units(docs, id_col, text_col).join(kept, ["h1", "h2"]).repartition("doc_id", "row")
              .withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "row", "unit").orderBy("start")))
              .where("not (doc_id <=> kept_doc_id and row = kept_row and start = kept_start and copy = 1)"))
    w = Window.partitionBy("doc_id", "row", "copy").orderBy("unit")
    run = Window.partitionBy("doc_id", "row", "copy", "run")
    return (marked.withColumn("run", F.col("unit") - F.row_number().over(w))
            .withColumn("run_words", F.sum("n_words").over(run))
            .where(F.col("run_words") >= min_words)
            .select("doc_id", "start", "end", "n_words", "run_words", "kept_doc_id", "kept_start", "row", "copy"))


def remove_units(docs: DataFrame, marked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their marked units (all other columns kept)."""
    cuts = (marked.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("copy").alias("__copy"))
            .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cuts")))

    @F.pandas_udf("string")
    def cut(text: pd.Series, cuts: pd.Series) -> pd.Series:
        def one(t, cs):
            if t is None or cs is None:
                return t
            out, at = [], 0
            for c in cs:
                out.append(t[at:c["start"]])
                at = max(at, c["end"])
            return "".join(out) + t[at:]
        return pd.Series([one(t, c) for t, c in zip(text, cuts)])
    cols = [c for c in docs.columns]
    own, row = F.col(id_col).cast("long"), F.xxhash64(text_col)
    rows = docs.withColumn("__own", own).withColumn("__hash", row)
    rows = rows.withColumn("__no", F.row_number().over(Window.partitionBy("__own", "__hash").orderBy(F.lit(1))))
    j = rows.join(cuts, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__row"))
                  & (F.col("__no") == F.col("__copy")), "left")
    return j.select(*[cut(F.col(c), F.col("__cuts")).alias(c) if c == text_col else F.col(c) for c in cols])

"""Secret scans: fixed patterns plus a randomness test battery.

Three base kinds (assignments, access keys, long hex runs) are matched as
given.  Beside them every long token is tested for randomness: its encoding
is inferred from its characters, then three statistics ask whether it could
be uniform noise over that alphabet - chi-squared uniformity, runs above and
below the middle of the alphabet, lag-1 serial correlation - and Fisher's
method combines them.  Within a text the p-values are weighted by token
length (long tokens carry more evidence) and Benjamini-Hochberg decides which
tokens are *not* random; the others are reported as kind ``random``.

One projection per row: no shuffle, no Python.  Null reads as empty; empty
texts have no spans; texts are scanned whole; offsets are code points.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark.llm.common import blank, spans

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"          # a maximal run of 24 or more
TOKEN = r"[A-Za-z0-9+/_-]{20,}=*"       # = pads the end; the value of NAME=VALUE is a token of its own
KINDS = ("assign", "access", "hex", "random")

# encoding, what its tokens look like, alphabet in code order
ENCODINGS = (
    {"name": "hex", "shape": "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", "letters": "0123456789abcdef"},
    {"name": "hex-upper", "shape": "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "letters": "0123456789ABCDEF"},
    {"name": "base32", "shape": "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"},
    {"name": "base36", "shape": "^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", "letters": "0123456789abcdefghijklmnopqrstuvwxyz"},
    {"name": "base62", "shape": "^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9]+=*$",
     "letters": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"},
    {"name": "base64", "shape": "^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_-]+=*$",
     "letters": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-"},
)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal (logistic approximation, error < 2e-4)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070565656 * z * z * z))


def _p_values(token: Column, letters: Column) -> Column:
    """Fisher's combination of the three tests; small means not random.  The
    padding at the end of a base-32/64 token is not tested."""
    body = F.regexp_replace(token, "=+$", "")
    chars = F.filter(F.split(body, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    k = F.length(letters).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: (F.length(body) - F.length(F.replace(body, c, F.lit("")))).cast("double"))
    chi = k / n * F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x) - n
    df = k - 1
    # Wilson-Hilferty: the cube root of chi-squared over its mean is near normal
    p_chi = _upper_tail((F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    value = F.transform(chars, lambda c: F.position(c, letters).cast("double"))
    # runs above / below the middle of the alphabet
    up = F.transform(value, lambda v: F.when(v > k / 2, 1.0).otherwise(0.0))
    ahead = F.slice(up, 2, F.greatest(F.size(up) - 1, F.lit(0)))
    here = F.slice(up, 1, F.greatest(F.size(up) - 1, F.lit(0)))
    runs = 1 + F.aggregate(F.zip_with(here, ahead, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x)
    n1 = F.aggregate(up, F.lit(0.0), lambda a, x: a + x)
    n0 = n - n1
    mean = 1 + 2 * n1 * n0 / n
    var = 2 * n1 * n0 * (2 * n1 * n0 - n) / (n * n * (n - 1))
    p_runs = F.when(var > 0, F.least(F.lit(1.0), 2 * _upper_tail(F.abs(runs - mean) / F.sqrt(var)))).otherwise(1e-12)
    # lag-1 serial correlation of the symbol values under uniformity
    mid, spread = (k + 1) / 2, (k * k - 1) / 12
    cov = F.aggregate(F.zip_with(F.slice(value, 1, F.greatest(F.size(value) - 1, F.lit(0))),
                                 F.slice(value, 2, F.greatest(F.size(value) - 1, F.lit(0))),
                                 lambda x, y: (x - mid) * (y - mid)), F.lit(0.0), lambda a, x: a + x)
    p_serial = F.least(F.lit(1.0), 2 * _upper_tail(F.abs(cov / (spread * F.sqrt(n - 1)))))
    half = -(F.ln(F.greatest(p_chi, F.lit(1e-12))) + F.ln(F.greatest(p_runs, F.lit(1e-12)))
             + F.ln(F.greatest(p_serial, F.lit(1e-12))))
    return F.exp(-half) * (1 + half + half * half / 2)      # chi-squared with 6 degrees of freedom


def _random_spans(text: Column, q: float) -> Column:
    """Tokens whose uniformity is not rejected at false-discovery rate q."""
    encodings = F.from_json(F.lit(json.dumps(list(ENCODINGS))), "array<struct<name:string,shape:string,letters:string>>")
    kind = "array<struct<start:int,end:int,hit:string,letters:string>>"
    named = F.transform(spans(text, F.lit(TOKEN)), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"),
        F.element_at(F.concat(F.filter(encodings, lambda e: F.rlike(s["hit"], e["shape"]))["letters"],
                              F.array(F.lit(""))), 1).alias("letters")))
    tested = F.filter(named.cast(kind), lambda s: s["letters"] != "")
    total = F.aggregate(tested, F.lit(0.0), lambda a, s: a + F.length(s["hit"]))
    m = F.size(tested)
    # weighted p-value: weights are token lengths with mean one
    scored = F.array_sort(F.transform(tested, lambda s: F.struct(
        (_p_values(s["hit"], s["letters"]) * total / (m * F.length(s["hit"]))).alias("p"),
        s["start"].alias("start"), s["end"].alias("end"))))
    ranked = F.zip_with(scored, F.sequence(F.lit(1), F.greatest(m, F.lit(1))),
                        lambda s, i: F.struct(i.alias("i"), (s["p"] <= q * i / m).alias("hit")))
    last = F.aggregate(F.filter(ranked, lambda r: F.coalesce(r["hit"], F.lit(False))), F.lit(0),
                       lambda a, r: F.greatest(a, r["i"]))
    # those beyond the last rejection were not shown to be patterned
    return F.slice(scored, last + 1, F.greatest(m - last, F.lit(0)))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.01) -> DataFrame:
    """One row per input row: id and spans, an array of (start, kind number,
    kind, end) sorted by start, then kind as listed in KINDS.  A random token
    inside a base span is not reported again."""
    t = F.col("__t")

    def kinded(xs: Column, kind: str) -> Column:
        return F.transform(xs, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"),
                                                  s["end"].alias("end"), F.lit(kind).alias("kind")))
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string>>")
    raw = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def gated(pattern: str, gate: str | None = None) -> Column:
        return F.when(t.rlike(gate or pattern), spans(t, F.lit(pattern))).otherwise(raw)
    assign = F.filter(gated(ASSIGN), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN_VALUE, 1)) >= 6)
    access = F.filter(gated(ACCESS), lambda s: F.length(s["hit"]) >= 20)
    base = (docs.select(F.col(id_col), blank(text_col).alias("__t"))
            .withColumn("__b", F.concat(kinded(assign, "assign"), kinded(access, "access"), kinded(gated(HEX), "hex"))))
    noise = F.when(t.rlike(TOKEN), kinded(_random_spans(t, q), "random")).otherwise(none)
    return (base.withColumn("__r", noise)
            .withColumn("spans", F.array_sort(F.concat("__b", F.filter(
                "__r", lambda r: ~F.exists("__b", lambda b: (b["start"] <= r["start"]) & (b["end"] >= r["end"]))))))
            .drop("__t", "__b", "__r"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.01) -> DataFrame:
    """Digest of :func:`scan_secrets` per row: counts, the base spans' hash
    and all spans as text."""
    s = F.col("spans")
    show = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan_secrets(docs, id_col, text_col, q).select(
        id_col, count("assign"), count("access"), count("hex"),
        F.sha2(show(F.filter(s, lambda x: x["kind"] != "random")), 256).alias("base_sha256"),
        show(s).alias("spans"), count("random"))

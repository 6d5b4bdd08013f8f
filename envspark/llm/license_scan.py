"""License scans: ordered signature rules behind a keyword prefilter.

A rule is a regular expression over the normalised text (words joined by one
space) with a label, a priority and a confidence.  A normalised text is
looked at closely only if it holds the gate phrase of some rule; of the rules
only those whose keyword is among the text's words run.  Every match of a rule
holds both its gate phrase and its keyword.  Overlapping
detections are resolved by interval containment: a detection inside an
earlier-starting, longer or higher-priority one is suppressed.

Everything is a projection over one row: no shuffle, no Python.
Null and empty texts give zero words, no labels and score 0; long texts are
read whole; repeated rows are scanned independently.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark.llm.common import blank, spaces, spans

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"      # either case; the normalised text is lower case
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LICENSE = "licen[cs]ed?"         # gate of the base phrases, too
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# label, keyword, name as it reads in normalised text, SPDX identifier
FAMILIES = (
    ("mit", "mit", "(?:the )?mit", "mit"),
    ("apache", "apache", "(?:the )?apache", "apache 2 0"),
    ("agpl", "affero", "(?:the )?(?:gnu )?affero general public", "agpl 3 0"),
    ("lgpl", "lesser", "(?:the )?(?:gnu )?lesser general public", "lgpl 3 0"),
    ("lgpl", "library", "(?:the )?(?:gnu )?library general public", "lgpl 2 0"),
    ("gpl", "general", "(?:the )?(?:gnu )?general public", "gpl 3 0"),
    ("gpl", "gpl", "(?:the )?(?:gnu )?gpl", "gpl 2 0"),
    ("gfdl", "documentation", "(?:the )?(?:gnu )?free documentation", "gfdl 1 3"),
    ("bsd", "bsd", "(?:the |a )?(?:[234] clause |new |simplified |modified )?bsd", "bsd 3 clause"),
    ("mpl", "mozilla", "(?:the )?mozilla public", "mpl 2 0"),
    ("epl", "eclipse", "(?:the )?eclipse public", "epl 2 0"),
    ("eupl", "european", "(?:the )?european union public", "eupl 1 2"),
    ("cddl", "distribution", "(?:the )?common development and distribution", "cddl 1 0"),
    ("cpl", "common", "(?:the )?common public", "cpl 1 0"),
    ("isc", "isc", "(?:the )?isc", "isc"),
    ("zlib", "zlib", "(?:the )?zlib(?: libpng)?", "zlib"),
    ("boost", "boost", "(?:the )?boost software", "bsl 1 0"),
    ("artistic", "artistic", "(?:the )?artistic", "artistic 2 0"),
    ("python", "python", "(?:the )?python software foundation", "psf 2 0"),
    ("php", "php", "(?:the )?php", "php 3 01"),
    ("ruby", "ruby", "(?:the )?ruby", "ruby"),
    ("openssl", "openssl", "(?:the )?openssl", "openssl"),
    ("postgresql", "postgresql", "(?:the )?postgresql", "postgresql"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "(?:the )?wtfpl", "wtfpl"),
    ("ofl", "font", "(?:the )?(?:sil )?open font", "ofl 1 1"),
    ("odbl", "database", "(?:the )?open (?:data commons open )?database", "odbl 1 0"),
    ("cc-by-nc-sa", "sa", "(?:the )?cc by nc sa", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", "nd", "(?:the )?cc by nc nd", "cc by nc nd 4 0"),
    ("cc-by-nc", "nc", "(?:the )?cc by nc", "cc by nc 4 0"),
    ("cc-by-sa", "sa", "(?:the )?cc by sa", "cc by sa 4 0"),
    ("cc-by-nd", "nd", "(?:the )?cc by nd", "cc by nd 4 0"),
    ("cc-by", "by", "(?:the )?cc by", "cc by 4 0"),
    ("cc0", "cc0", "(?:the )?cc0", "cc0 1 0"),
    ("creative-commons", "creative", "(?:the |a )?creative commons", "cc by 3 0"),
    ("microsoft-public", "microsoft", "(?:the )?microsoft (?:public|reciprocal)", "ms pl"),
    ("academic-free", "academic", "(?:the )?academic free", "afl 3 0"),
    ("open-software", "software", "(?:the )?open software", "osl 3 0"),
    ("universal-permissive", "permissive", "(?:the )?universal permissive", "upl 1 0"),
    ("mulan", "mulan", "(?:the )?mulan (?:permissive|public)", "mulanpsl 2 0"),
)

# how a license is announced: pattern around the name, confidence, gate (words
# that every match holds)
TEMPLATES = (
    ("spdx license identifier {spdx}", 1.0, "spdx"),
    ("(?:is |are )?licen[cs]ed under (?:the terms of )?{name}(?: licen[cs]e)?(?: version)?(?: \\d+)*", 0.95, LICENSE),
    ("(?:is |are )?released under (?:the terms of )?{name}(?: licen[cs]e)?(?: version)?(?: \\d+)*", 0.95, "released under"),
    ("(?:is |are )?distributed under (?:the terms of )?{name}(?: licen[cs]e)?(?: version)?(?: \\d+)*", 0.95, "distributed under"),
    ("available under (?:the terms of )?{name}(?: licen[cs]e)?(?: version)?(?: \\d+)*", 0.9, "available under"),
    ("subject to (?:the terms of )?{name} licen[cs]e(?: version)?(?: \\d+)*", 0.9, LICENSE),
    ("see {name} licen[cs]e for (?:more )?details", 0.85, LICENSE),
    ("{name} licen[cs]e(?: version)?(?: \\d+)*", 0.7, LICENSE),
)

# signatures without a named family: label, keyword, pattern, confidence, gate
NOTICES = (
    ("all-rights-reserved", "reserved", "(?:copyright )?all rights reserved", 0.6, "all rights reserved"),
    ("copyright", "copyright", "copyright(?: c)? \\d{4}", 0.5, "copyright"),
    ("public-domain", "domain", "(?:released into|dedicated to|in) the public domain", 0.7, "public domain"),
    ("proprietary", "proprietary", "proprietary and confidential", 0.8, "proprietary and confidential"),
)


def signature_rules() -> list[dict]:
    """The ordered rules: every family in every template (specific templates
    first), then the notices.  The position is the priority."""
    rules = [{"label": label, "keyword": "spdx" if "{spdx}" in template else keyword, "confidence": conf, "gate": gate,
              "pattern": "(?<= )" + template.format(name=name, spdx=spdx) + "(?= )"}
             for template, conf, gate in TEMPLATES for label, keyword, name, spdx in FAMILIES]
    rules += [{"label": label, "keyword": keyword, "confidence": conf, "gate": gate, "pattern": f"(?<= ){pattern}(?= )"}
              for label, keyword, pattern, conf, gate in NOTICES]
    return [dict(r, priority=i) for i, r in enumerate(rules)]


def _normal(text: Column) -> Column:
    words = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), NOT_WORD, " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def _suppress(found: Column) -> Column:
    """Drop detections contained in another one.  Sorted by start, longest
    first, then priority, a detection is contained exactly if an earlier one
    reaches at least as far."""
    kind = "struct<far:int,kept:array<struct<start:int,back:int,priority:int,label:string,confidence:double>>>"
    zero = F.struct(F.lit(-1).alias("far"), F.array().alias("kept")).cast(kind)
    return F.aggregate(
        F.array_sort(found), zero,
        lambda a, s: F.when(-s["back"] <= a["far"], a).otherwise(
            F.struct((-s["back"]).alias("far"), F.concat(a["kept"], F.array(s)).alias("kept")).cast(kind)),
        lambda a: a["kept"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: list[dict] | None = None) -> DataFrame:
    """One row per input row: id, n_words, base (places of the base phrases as
    start word, end word, label), found (surviving detections: start word,
    end word, priority, label, confidence)."""
    rules = signature_rules() if rules is None else rules
    by_key: dict[str, list[dict]] = {}
    for r in rules:
        by_key.setdefault(r["keyword"], []).append(r)
    table = F.from_json(F.lit(json.dumps(by_key)),
                        "map<string,array<struct<label:string,keyword:string,confidence:double,"
                        "pattern:string,priority:int>>>")
    keys = F.array(*[F.lit(k) for k in by_key])
    # a rule without a gate lets every text pass
    gate = f" (?:{'|'.join(sorted({LICENSE, *(r.get('gate', '') for r in rules)}))}) " if all(r.get("gate") for r in rules) else ""
    gated = (docs.select(F.col(id_col), blank(text_col).alias("__t"))
             .withColumn("n_words", F.regexp_count("__t", F.lit(WORD)).cast("long"))
             .withColumn("__all", _normal(F.col("__t")))
             .withColumn("__n", F.when(F.col("__all").rlike(gate), F.col("__all")))
             .drop("__t", "__all"))
    norm = F.col("__n")
    def base_places(phrase, label):
        return F.transform(spans(norm, F.lit(f"(?<= ){phrase}(?= )"), spaces),
                           lambda s: F.struct((s["start"] - 1).alias("start"), s["end"].alias("end"),
                                              F.lit(label).alias("label")))
    places = [base_places(phrase, label) for phrase, label in BASE]
    none_base = F.array().cast("array<struct<start:int,end:int,label:string>>")
    none_found = F.array().cast("array<struct<start:int,back:int,priority:int,label:string,confidence:double>>")

    def detect(rule):
        return F.transform(spans(norm, rule["pattern"], spaces),
                           lambda s: F.struct((s["start"] - 1).alias("start"), (-s["end"]).alias("back"),
                                              rule["priority"].alias("priority"), rule["label"].alias("label"),
                                              rule["confidence"].alias("confidence")))
    mine = F.array_intersect(F.split(F.trim(norm), " "), keys)
    found = F.flatten(F.transform(F.flatten(F.transform(mine, lambda k: F.element_at(table, k))), detect))
    return (gated
            .withColumn("base", F.when(norm.isNull(), none_base).otherwise(F.concat(*places)))
            .withColumn("found", F.when(norm.isNull(), none_found).otherwise(_suppress(found)))
            .withColumn("found", F.transform("found", lambda s: F.struct(
                s["start"].alias("start"), (-s["back"]).alias("end"), s["priority"].alias("priority"),
                s["label"].alias("label"), s["confidence"].alias("confidence"))))
            .drop("__n"))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of :func:`scan_licenses`: counts, first and last base place,
    labels and a score (the best confidence; 0 without a detection)."""
    base, found = F.col("base"), F.col("found")
    labels = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    starts = F.transform(base, lambda s: s["start"].cast("long"))
    base_score = F.when(F.size(base) > 0, F.lit(0.9)).otherwise(F.lit(0.0))
    return scan_licenses(docs, id_col, text_col).select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base["label"]).alias("base_labels"),
        labels(F.concat(base["label"], found["label"])).alias("labels"),
        F.greatest(base_score, F.coalesce(F.array_max(found["confidence"]), F.lit(0.0))).alias("score"),
        F.size(found).cast("long").alias("n_found"))

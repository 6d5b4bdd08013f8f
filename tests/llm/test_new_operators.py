"""SuperMinHash groups, vector codes and periodic runs against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from envspark.llm import decontaminate, hashing, periodic_runs, quality, registry, superminhash, vector_codes
from envspark.llm.common import table
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm import brute
from tests.llm.test_llm import ODD, SCHEMA, corpus, none_of  # noqa: F401

VECTORS = "vec_id long, embedding array<float>, label int, entry int, vector string, id string"


# -- word hashes ------------------------------------------------------------

def test_word_hashes_tell_words_apart():
    thue = ["".join("ab"[(bin(i).count("1") + flip) & 1] for i in range(n)) for n in (8, 256, 1024, 2048) for flip in (0, 1)]
    words = [f"w{i}" for i in range(5000)] + ["a" * k for k in range(1, 600)] + thue
    words += ["a" * k + "\0" for k in range(1, 20)] + ["\0" * k for k in range(1, 20)]
    words = sorted(set(words))
    text = " \t\n".join(words).encode()
    got, first = hashing.word_hashes([b"", text, b"  ", text], hashing.NOT_SPACE)
    assert first.tolist() == [0, 0, len(words), len(words), 2 * len(words)]
    assert len(set(got.tolist())) == len(words) and (got[:len(words)] == got[len(words):]).all()


# -- SuperMinHash -----------------------------------------------------------

def plain_signature(elements, size):
    sig = [1 << 64] * size
    for x in elements:
        p = list(range(size))
        for j in range(size):
            d = int(hashing.mix(np.array([(int(x) + int(hashing.FACTORS[1]) * (j + 1)) % (1 << 64)], np.uint64))[0])
            k = j + ((d >> 32) * (size - j) >> 32)
            p[j], p[k] = p[k], p[j]
            sig[p[j]] = min(sig[p[j]], (j << 32) | (d & 0xFFFFFFFF))
    return sig


def test_signatures_equal_the_plain_algorithm():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, k, np.uint64) for k in (1, 2, 3, 17, 200, 600)]
    for s, got in zip(sets, superminhash.signatures(sets, 40)):
        assert got.tolist() == plain_signature(s, 40)
    assert superminhash.signatures([], 40).shape == (0, 40)


@pytest.mark.parametrize("s", [0.5, 0.8])
def test_signatures_estimate_with_less_variance(s):
    rng = np.random.default_rng(2)
    seen = []
    for _ in range(300):
        both = round(600 * s / (1 + s))
        a = rng.integers(0, 1 << 63, 600, np.uint64)
        x, y = superminhash.signatures([a[:300], np.r_[a[:both], a[300:600 - both]]])
        seen.append((x == y).mean())
    assert abs(np.mean(seen) - s) < 0.01 and np.std(seen) < math.sqrt(s * (1 - s) / superminhash.SIZE)


def test_near_duplicates(spark, corpus):  # noqa: F811
    texts, df = corpus
    got = superminhash.near_duplicates(df, n=4, share=80).collect()
    assert len(got) == len(texts)
    expected = brute.jaccard_components(texts, 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert superminhash.near_duplicates(none_of(spark)).count() == 0


def test_near_duplicates_family_around_the_threshold(spark):
    """Copies on both sides of the threshold to the original and each other."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(150)]
    texts = {}
    for d in range(120):
        w = list(words)
        for p in rng.sample(range(5, 145, 9), rng.randint(0, 9)):
            w[p] = rng.choice(["x", "y", f"z{d}"])
        texts[d] = " ".join(w)
    texts |= {200 + i: " ".join(f"u{i}_{j}" for j in range(40)) for i in range(5)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in superminhash.near_duplicates(df, n=4, share=80).collect()}
    assert got == brute.jaccard_components(texts, 4, 80)
    assert len({c for _, c in got.values()}) > 6


def test_near_duplicates_of_repeated_and_null_ids(spark):
    same = "one two three four five six seven"
    rows = [(2, same), (2, "a text that nobody else has at all"), (9, same), (9, same), (None, same), (None, None),
            (None, "another text that is alone in here"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in superminhash.near_duplicates(df, n=4).collect()),
                 key=str)
    assert got == sorted([(2, 4, 2, True), (2, 5, 2, True), (9, 4, 2, False), (9, 4, 2, False), (None, 4, 2, False),
                          (None, 0, None, True), (None, 4, None, True), (4, 0, 4, True)], key=str)


# -- vector codes -----------------------------------------------------------

def plain_codes(rows, parts=16, entries=64, rounds=2):
    """vec_id -> (code, error, label error) and the codebooks' digest."""
    kept = sorted((i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows
                  if v and all(x is not None and math.isfinite(x) for x in v))
    if not kept:
        return {}, None
    d = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * d:(p + 1) * d]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        at = [[min((far(cut(v, p), c), e) for e, c in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]
        if r < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [cut(v, p) for (_, v, _), a in zip(kept, at) if a[p][1] == e]
                    if mine:
                        books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    error = [sum(x for x, _ in a) for a in at]
    total = {}
    for (_, _, lab), x in zip(kept, error):
        total[lab] = total.get(lab, 0) + x
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for _, e in a), x, total[lab])
            for (i, _, lab), a, x in zip(kept, at, error)}, digest


def test_vector_codes(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.0, -0.3, 0.0, 0.26, 0.5, rng.gauss(0, 1)]) for _ in range(32)], rng.choice([None, 1, 2]))
            for i in rng.sample(range(1000), 180)]
    rows += [(2000 + i, list(rows[i][1]), 7) for i in range(20)]                 # equal vectors
    bad = [(-1, None, 1), (-2, [], 1), (-3, [float("nan")] * 32, 1), (-4, [float("inf")] + [0.0] * 31, None),
           (-5, [None] + [0.0] * 31, 2)]
    df = spark.createDataFrame([(i, v, lab, 1, "v", "i") for i, v, lab in rows + bad], VECTORS)
    as_float = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    want, digest = plain_codes(as_float)
    got = vector_codes.code_report(df.repartition(5)).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_vector_codes_of_few_repeated_and_no_rows(spark):
    v = [float(k) for k in range(16)]
    df = spark.createDataFrame([(1, v, None, 1, "", ""), (1, v, 3, 1, "", ""), (None, [x + 9 for x in v], None, 1, "", ""),
                                (5, v + v, 3, 1, "", "")], VECTORS)
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in vector_codes.code_report(df).collect())
    assert got == [("1", "00" * 16, 0, 0), ("1", "00" * 16, 0, 0), ("None", "02" * 16, 0, 0)]     # another length: left out
    assert vector_codes.code_report(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        vector_codes.code_report(spark.createDataFrame([(1, [1e9] * 16, 1, 1, "", "")], VECTORS)).count()
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.code_report(spark.createDataFrame([(1, [1.0] * 17, 1, 1, "", "")], VECTORS))


def test_active_entries_give_the_full_scan():
    rng = np.random.default_rng(5)
    books = rng.integers(-9, 9, (4, 8, 3))
    parts = rng.integers(-9, 9, (500, 4, 3))
    entry, dist = vector_codes.assign(parts, books)
    for share in (0.0, 0.2, 1.0):
        new = np.where(rng.random((4, 8, 1)) < share, rng.integers(-9, 9, books.shape), books)
        full = vector_codes.assign(parts, new)
        some = vector_codes.assign(parts, new, entry, dist, (new != books).any(2))
        assert (full[0] == some[0]).all() and (full[1] == some[1]).all()
    big = rng.integers(-(1 << 25), 1 << 25, (20, 3))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in big] for x in big]
    assert vector_codes.squared_distances(big, big).tolist() == want


def test_vector_codes_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{SF_CHECK}/embeddings.parquet'")
    want = {r[0]: r[1:] for r in duckdb.sql(registry.ORACLE["op12_vector_codes"]).fetchall()}
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256)
           for r in registry.QUERIES["op12_vector_codes"](spark, SF_CHECK).collect()}
    assert got == want and len(got) > 400


# -- periodic runs ----------------------------------------------------------

def plain_runs(w, least=12):
    """(start, length, period) by scanning every period."""
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            part = w[i:j + q]
            if len(part) >= max(least, 2 * q) and not any(
                    all(part[k] == part[k + p] for k in range(len(part) - p)) for p in range(1, q)):
                found.append((i, len(part), q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_report(doc_id, text):
    w = brute.SPACED.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    drop = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{n_},{q}\n" for s, n_, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def report_of(df):
    found = periodic_runs.find_runs(df, edit=periodic_runs.planted_period)
    return [(r.doc_id, (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256))
            for r in periodic_runs.run_report(found).collect()]


@pytest.mark.parametrize("least", [3, 4, 12, 20])
def test_word_runs(least):
    rng = random.Random(least)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(0, 5)):
            w, k, n = [], rng.choice([1, 2, 2, 3, 6]), rng.randint(0, 70)
            while len(w) < n:
                piece = [rng.randrange(k) for _ in range(rng.randint(1, 9))]
                w += piece * rng.choice([1, 1, 2, 3, 6])
            docs.append(w)
        first = np.cumsum([0] + [len(d) for d in docs])
        ids = hashing.mix(np.array([x + 1 for d in docs for x in d], np.uint64))
        got = [[] for _ in docs]
        for s, n, q in zip(*periodic_runs.word_runs(ids, first, least)):
            k = int(np.searchsorted(first, s, "right")) - 1
            got[k].append((int(s - first[k]), int(n), int(q)))
        assert got == [plain_runs(d, least) for d in docs]


def test_periodic_runs_of_documents(spark, corpus):  # noqa: F811
    texts, df = corpus
    want = {d: plain_report(d, t) for d, t in texts.items()}
    got = report_of(df)
    assert len(got) == len(texts) and dict(got) == want
    assert sum(v[0] > 0 for v in want.values()) > 10


def test_periodic_runs_of_odd_rows(spark):
    texts = ["", None, " \t\n", "a " * 5000, "a b " * 20 + "c " + "b a " * 20, "x y z " * 4, "x y z " * 4,
             "é 🙂 " * 9 + "ü", "w" * 50_000 + " v", " ".join("ab"[bin(i).count("1") & 1] for i in range(3000))]
    rows = [(i if i != 5 else None, t, i, "k", 1) for i, t in enumerate(texts)] + [(3, "a " * 5000, 0, "k", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted([(r[0], plain_report(r[0], r[1] if r[2] != 9 else texts[9])) for r in rows if r[2] not in (3, 9, 0)], key=str)
    got = sorted([x for x in report_of(df) if x[0] not in (0, 3, 9)], key=str)
    assert got == want
    long = [x[1] for x in report_of(df) if x[0] == 3]
    assert long == [(1, 0, 5000, 1, 5000000, *long[0][5:])] * 2
    assert report_of(none_of(spark)) == []


def test_registered_queries_on_the_smallest_tables(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF_SMALL, "documents").collect()}
    got = registry.QUERIES["op11_superminhash"](spark, SF_SMALL).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard_components(texts, 4, 80)
    got = registry.QUERIES["op13_periodic_runs"](spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2 and got.count() == len(texts)


# -- row keys of the filters ------------------------------------------------

TEXT = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
CLEAN = "a clean text of its own that nobody else has anywhere in this corpus, kept as it is"


def test_keep_first_tells_rows_of_one_id_apart(spark):
    rows = [(1, TEXT, "a"), (2, TEXT, "b"), (2, CLEAN, "c"), (9, "pi " + CLEAN[::-1], "d"), (9, "pi " + CLEAN[::-1], "e"),
            (None, TEXT, "f"), (None, "rho sigma tau upsilon phi chi psi omega", "g"), (None, None, "h"), (None, None, "i"),
            (4, "", "j"), (4, "", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    from envspark.llm import jaccard_join
    got = sorted(r.row for r in jaccard_join.keep_first(df).collect())
    assert got in ([*"acdghijk"], [*"aceghijk"])
    assert jaccard_join.keep_first(df.limit(0)).count() == 0


def test_remove_lines_tells_rows_of_one_id_apart(spark):
    from envspark.llm import line_dedup
    line = "this line is found in more than one of the documents"
    rows = [(1, f"{line}\nfirst of all lines in here, and long enough", 0), (2, f"{line}\nsecond text with a line of its own", 0),
            (2, "another text of the same id as the one before\nclean line that nobody else has in the corpus", 0),
            (None, f"third text, without an id, starts here\n{line}", 0), (7, "one and the same row\ntwice", 0),
            (7, "one and the same row\ntwice", 0), (8, "", 0), (8, "", 0), (8, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in line_dedup.remove_lines(df, length_col="n_chars", exact_chars=1).collect()), key=str)
    assert got == sorted([rows[0][:2], (2, "second text with a line of its own"), rows[2][:2],
                          (None, "third text, without an id, starts here"), rows[4][:2], (8, ""), (8, ""), (8, None)], key=str)


def test_latent_space_is_fitted_on_every_passage(spark):
    """The product with the TF-IDF matrix takes in every passage of every
    text, however many texts there are; candidates are judged alike with and
    without the count of words that stands before the subsequence."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.4, rng.integers(0, 130)) % 900) for _ in range(2600)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(i, " ".join(texts[i].split()[:40])) for i in range(60) if len(texts[i]) > 50],
                                  "item_id long, text string")
    index = next(decontaminate.build_indexes(df, bench, "doc_id", "text", "item_id", "text", 0.1, 0.5, 0.2))
    q = rng.standard_normal((int(index.row.max()) + 1, 7)).astype(np.float32)
    got = decontaminate._corpus_product(df.select(df.text.alias("t")), index.idf, index.row, q)
    rows = []
    for t in texts:
        terms = decontaminate.term_ids(decontaminate.words_of(t))
        for i in range(0, len(terms), decontaminate.CHUNK * decontaminate.WINDOW):
            part = terms[i:i + decontaminate.CHUNK * decontaminate.WINDOW]
            x, line = index.idf[part].astype(float), np.zeros(len(q))
            keep = index.row[part] >= 0
            np.add.at(line, index.row[part][keep], x[keep])
            rows.append(line / max(np.sqrt((x * x).sum()), 1e-12))
    a = np.array(rows)
    assert np.allclose(got, a.T @ (a @ q), rtol=1e-3, atol=1e-3 * np.abs(got).max())
    found = index.search(texts)
    index.enough = lambda words, begin, doc, at, item: np.ones(len(item), bool)
    assert index.search(texts) == found and sum(map(len, found)) >= bench.count()


def test_quality_weights_are_those_of_all_pairs(spark):
    """Every labelled row and every good-bad pair counts: the weights equal
    those of Newton steps over all pairs, one by one."""
    rng = np.random.default_rng(3)
    n, k = 700, len(quality.NAMES)
    x = rng.normal(0, 1, (n, k)) * rng.uniform(0.1, 9, k)
    x[:, 4] = 2.5                                      # a feature that tells nothing
    y = (x[:, 0] / x[:, 0].std() + x[:, 1] / x[:, 1].std() + rng.normal(0, 1, n) > 0.3).astype(int)
    df = spark.createDataFrame([(int(a), *map(float, r)) for a, r in zip(y, x)],
                               "__y int, " + ", ".join(f"{c} double" for c in quality.NAMES)).repartition(4)
    got = quality.fit_pairs(df)
    scale = np.where(x.std(0) > 1e-12, x.std(0), 1.0)
    z = (x - x.mean(0)) / scale
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, k)
    w = np.zeros(k)
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ w))
        w -= np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(k), d.T @ (p - 1) / len(d) + 1e-3 * w)
    assert np.allclose(got.weights, w, atol=1e-3) and np.allclose(got.centre, x.mean(0)) and np.allclose(got.scale, scale)
    s, at = np.sort(z @ got.weights), int((y == 0).sum())
    assert math.isclose(got.threshold, (s[at - 1] + s[at]) / 2, abs_tol=1e-9) and math.isclose(got.width, s.std() / 4)


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """No label is left out, however many there are; null ids, other values
    and the held-out third are."""
    docs = spark.range(30000).selectExpr("id as doc_id", "concat('a line of words ', id) as text")
    labels = spark.range(30000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    labels = labels.unionByName(spark.sql("select cast(null as long) as doc_id, 1 as quality union all select 5L, 7"))
    seen = []
    monkeypatch.setattr(quality, "fit_pairs", lambda rows, *a: seen.append(rows.count()))
    quality.fit(docs, labels)
    assert seen == [sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(30000))]


def test_latent_axes_hold_few_matrices_on_the_driver(monkeypatch):
    """The driver's share of the axes: orthonormal factors written in place."""
    import tracemalloc
    n, width = 6000, 100 + decontaminate.EXTRA
    rng = np.random.default_rng(4)
    y = (rng.standard_normal((n, width)) * np.logspace(2, -2, width)).astype(np.float32)
    idf, row = np.ones(decontaminate.TERMS, np.float32), np.full(decontaminate.TERMS, -1, np.int32)
    row[:n] = np.arange(n)
    monkeypatch.setattr(decontaminate, "_corpus_product", lambda t, i, r, q: y @ (y.T @ q))
    tracemalloc.start()
    held = tracemalloc.get_traced_memory()[0]
    axes = decontaminate.latent_axes(None, 1.0, [np.arange(40)], idf, row, n, 100)
    peak = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert peak < 5.5 * y.nbytes
    assert np.allclose(axes.T @ axes, np.eye(100), atol=1e-5)
    for rows in (3, width, 5 * width, n):
        q = decontaminate._orthonormal(y[:rows, :min(rows, width)].copy())
        assert np.allclose(q.T @ q, np.eye(q.shape[1]), atol=1e-5)
        assert np.allclose(q @ (q.T @ y[:rows, :q.shape[1]]), y[:rows, :q.shape[1]], atol=1e-2)


def test_candidates_keep_what_counts_of_words_allow():
    """``enough`` against counters of the words around each passage."""
    rng = np.random.default_rng(8)
    vocabulary = rng.integers(0, 2 ** 63, 30).astype(np.uint64)
    items = [vocabulary[rng.integers(0, 30, n)] for n in (1, 7, 20, 40)] + [rng.integers(0, 2 ** 63, 5).astype(np.uint64)]
    index = decontaminate.Index(list(range(5)), items, None, None, None, 0.1, 0.6, 0.4)
    index._vocabulary, index._holds = index.vocabulary()
    index._sizes = np.array([len(ws) for ws in items])
    docs = [vocabulary[rng.integers(0, 30, n)] if n % 2 else rng.integers(0, 2 ** 63, n).astype(np.uint64) for n in (3, 200, 0, 91, 40)]
    words, begin = np.concatenate(docs), np.r_[0, np.cumsum([len(d) for d in docs])]
    doc, at, item = (v.ravel() for v in np.meshgrid(np.arange(5), np.arange(0, 200, decontaminate.CHUNK), np.arange(5)))
    real = at < np.array([len(d) for d in docs])[doc]
    doc, at, item = doc[real], at[real], item[real]
    want = []
    for d, a, i in zip(doc, at, item):
        n = len(items[i])
        around = Counter(docs[d][max(0, a - n):a + decontaminate.WINDOW * decontaminate.CHUNK + n].tolist())
        want.append((around & Counter(items[i].tolist())).total() / n >= 0.6)
    assert index.enough(words, begin, doc, at, item).tolist() == want and 0 < sum(want) < len(want)


# -- chance meetings --------------------------------------------------------

def test_chance_meetings_move_no_texts(spark, monkeypatch):
    """Unrelated texts of few words meet in cells; their texts, and the
    elements of their sets, stay where they are, and every link is found."""
    from envspark.llm import jaccard_join
    rng = random.Random(6)
    some = lambda k: rng.choices([f"w{i}" for i in range(12)], [40, 20, 10, 8, 6, 4, 3, 3, 2, 2, 1, 1], k=k)
    texts = {d: some(rng.randint(200, 330)) for d in range(240)}
    for d in range(300, 360):               # near copies on both sides of the threshold
        texts[d] = list(texts[d % 7])
        for p in rng.sample(range(10, 190, 20), rng.randint(0, 9)):
            texts[d][p] = f"z{rng.randrange(9)}"
    texts = {d: " ".join(w) for d, w in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    moved, plain = [], jaccard_join.compared

    def compared(pairs, *a, **b):
        moved.extend((r.a, r.b) for r in pairs.select("a", "b").collect())
        return plain(pairs, *a, **b)
    monkeypatch.setattr(jaccard_join, "compared", compared)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(df, n=5, share=80).collect()}
    want = brute.jaccard_components(texts, 5, 80)
    assert got == want
    node = {jaccard_join.set_digest(next(jaccard_join.shingle_sets([t], 5))): d for d, t in texts.items()}
    family = {d for d in texts if d < 7 or d >= 300}
    met = [(node[a], node[b]) for a, b in moved]
    assert any(a in family for a, _ in met) and len({c for _, c in want.values()}) > 233
    assert sum(a not in family or b not in family for a, b in met) < 10


def test_bits_of_sets_never_exclude_a_link():
    """``parities`` differ in no more bits than sets in elements, at any sizes."""
    from envspark.llm import jaccard_join
    rng = np.random.default_rng(3)
    for n in (1, 2, 40, 63, 64, 65, 127, 130, 700, 1030):
        for k in (0, 1, n // 5, n // 2, n):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.r_[a[:n - k], rng.integers(0, 1 << 63, k // 2 + 1).astype(np.uint64)]
            bits = [jaccard_join.parities(s) for s in (a, b)]
            va, vb = jaccard_join._folded(bits, min(map(len, bits)) // 8)
            assert min(len(a), len(b)) <= 64 * len(va) and np.bitwise_count(va ^ vb).sum() <= k + k // 2 + 1


def test_open_members_against_all_pairs(spark, monkeypatch):
    """Stars in one tile and in many give the members that a plain search over
    all pairs of a star gives, but for pairs that are both linked; each member
    of a star in one tile is moved once."""
    from envspark.llm import jaccard_join
    rng = np.random.default_rng(5)
    bounds, sets, star = jaccard_join.Bounds(80), {}, []
    for a in range(4):
        base = rng.integers(0, 1 << 63, 90).astype(np.uint64)
        for i in range(30):
            k = int(rng.integers(0, 60))
            sets[a * 100 + i] = np.r_[base[:90 - k], rng.integers(0, 1 << 63, int(rng.integers(1, 30))).astype(np.uint64)]
            star.append((a, a * 100 + i, bool(rng.random() < 0.4), len(sets[a * 100 + i])))
    star.append((9, 0, False, len(sets[0])))            # alone in its star
    rows = [(b, len(s), jaccard_join.parities(s)) for b, s in sets.items()]
    sketches = spark.createDataFrame(rows, "node long, n_shingles long, bits binary")
    df = spark.createDataFrame(star, "a long, b long, linked boolean, n long")

    def allowed(x, y):
        v = [jaccard_join._folded([jaccard_join.parities(s)], 1 if min(len(sets[x]), len(sets[y])) <= 64 else 2) for s in (sets[x], sets[y])]
        most = bounds.most_difference(len(sets[x]) + len(sets[y]))
        return abs(len(sets[x]) - len(sets[y])) <= most and np.bitwise_count(v[0] ^ v[1]).sum() <= most
    want, sure = set(), set()
    for a, x, lx, _ in star:
        for c, y, ly, _ in star:
            if a == c and x < y and not (lx and ly):
                if len(np.setxor1d(sets[x], sets[y])) <= bounds.most_difference(len(sets[x]) + len(sets[y])):
                    sure |= {(a, x), (a, y)}
                if allowed(x, y):
                    want |= {(a, x), (a, y)}
    for leaf in (jaccard_join.BITS_LEAF, 400):
        monkeypatch.setattr(jaccard_join, "BITS_LEAF", leaf)
        got = {tuple(r) for r in jaccard_join.open_members(df, sketches, bounds).collect()}
        # members of a tile are compared by the bits of its smallest set, which exclude less
        assert sure <= want <= got and len(got) < len(star)

"""The training-data operators against brute force, on documents with every
odd case and on the smallest tables."""

import hashlib
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from envspark.llm import (bpe, decontaminate, html_extract, jaccard_join, license_scan, line_dedup, merkle, quality,
                          secret_scan, substring_dedup)
from envspark.llm.common import connected_components, table
from tests.conftest import SF_SMALL
from tests.llm import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

ODD = [None, "", "   \n\n", "One.", "One.", "MIT License, the Mit  license", "É token = 'abc123+/x' É🙂 AKIA" + "A1" * 9,
       "x" * 30_000, "deadbeef" * 4 + " password:ab token=token: abcdefgh", "GENERAL public License general public license"]
SCHEMA = "doc_id long, text string, node long, key string, n int"      # extra columns with clashing names


def docs_of(spark, texts, start=1):
    return spark.createDataFrame([(start + i, t, i, "k", 1) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    """doc_id -> text of the smallest table and the odd texts, and as rows."""
    rows = [(r[0], r[1]) for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)]
    return dict(rows), spark.createDataFrame([(d, t, d, "k", 1) for d, t in rows], SCHEMA)


def none_of(spark):
    return spark.createDataFrame([], SCHEMA)


def test_licenses(spark, corpus):
    texts, df = corpus
    got = license_scan.license_report(df).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert license_scan.license_report(none_of(spark)).count() == 0


def test_license_rules_and_containment(spark):
    assert len(license_scan.signature_rules()) > 200
    r = license_scan.scan_licenses(docs_of(spark, ["It is licensed under the Apache License, Version 2.0. See MIT license."])).first()
    assert [(f.label, f.start) for f in r.found] == [("apache", 1), ("mit", 11)]


def test_every_license_rule_on_a_sentence_of_its_own(spark):
    def sentence(pattern):
        s = pattern.replace("(?<= )", "").replace("(?= )", "").replace("[cs]", "s").replace("(?: \\d+)*", "").replace("\\d{4}", "2020")
        s = re.sub(r"\(\?:[^()]*\)\?", "", re.sub(r"\(\?:(the |sil |gnu )\)\?", "", s))
        return re.sub(r"\(\?:([^()|]*)\|[^()]*\)", r"\1", s).replace(" ", "\n")
    rules = license_scan.signature_rules()
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs_of(spark, [sentence(r["pattern"]) for r in rules], 0)).collect()}
    assert [(r["pattern"], got[r["priority"]].found) for r in rules if r["label"] not in {f.label for f in got[r["priority"]].found}] == []
    texts = ["// SPDX-License-Identifier: MPL-2.0", "Released under the GPL v3", "proprietary and\nconfidential", "in the  public\ndomain"]
    labels = {r.doc_id: r.labels for r in license_scan.license_report(docs_of(spark, texts)).collect()}
    assert labels == {1: "mpl", 2: "gpl", 3: "proprietary", 4: "public-domain"}


def test_secrets(spark, corpus):
    texts, df = corpus
    for r in secret_scan.secret_report(df).collect():
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute.secrets(texts[r.doc_id])
    assert secret_scan.secret_report(none_of(spark)).count() == 0


def test_random_tokens_are_told_from_patterned_ones(spark):
    rng = random.Random(5)
    noise = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60))
    got = {r.doc_id: r.n_random for r in secret_scan.secret_report(docs_of(spark, [f"key {noise} end", "id " + "Aa1" * 20 + " end"])).collect()}
    assert got == {1: 1, 2: 0}


def test_random_values_after_an_equals_sign(spark):
    rng = random.Random(5)
    noise = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60))
    texts = [f"AWS_KEY={noise}", f"https://h.example/p?sig={noise}&v=1", f"key {noise}== end"]
    got = {r.doc_id: r.spans for r in secret_scan.secret_report(docs_of(spark, texts)).collect()}
    assert got == {1: "random:8:68", 2: "random:24:84", 3: "random:4:66"}


def test_merkle(spark, corpus):
    texts, df = corpus
    edited = brute.edited(texts)
    got = merkle.neighbour_report(df, rows_per_bucket=40).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.n_chars == len(texts[r.doc_id] or "")
        assert r.edited_sha256 == hashlib.sha256(edited[r.doc_id].encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_text = {}
    for r in got:
        by_text.setdefault(texts[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({f for v in by_text.values() for f in v}) == len(by_text)
    assert merkle.neighbour_report(none_of(spark)).count() == 0
    twice = merkle.neighbour_report(docs_of(spark, ["a b c"]).union(docs_of(spark, ["a b c"])))
    assert twice.count() == 2


def test_bpe_matches_tiktoken(spark, corpus):
    tiktoken = pytest.importorskip("tiktoken")
    texts, df = corpus
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    out = bpe.encode_texts(df, RANKS, public_tokenizers.PATTERN, block=500)
    for r in bpe.decode_ids(out, RANKS).collect():
        t = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert r.ids == ids and r.decoded == t and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode_texts(none_of(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_transducer_with_few_states_and_short_lookahead():
    ranks = bpe.load_ranks(RANKS)
    t = bpe.Transducer(ranks, max_states=50)
    rng = random.Random(1)
    for _ in range(300):
        piece = "".join(rng.choice("aeithnors.é-") for _ in range(rng.randint(1, 60))).encode()
        assert t.encode(piece, lookahead=8) == ([ranks[piece]] if piece in ranks else t.merge(piece))


def test_neighbours_agree_where_plain_merging_keeps_them():
    ranks = bpe.load_ranks(RANKS)
    t = bpe.Transducer(ranks)
    assert t.whole == {i for b, i in ranks.items() if t.merge(b) == [i]}
    rng = random.Random(2)
    ids = sorted(ranks.values())
    for upto in (600, 3000, len(ids)):
        for _ in range(4000):
            a, b = ids[rng.randrange(upto)], ids[rng.randrange(upto)]
            assert t.agree(a, b) == (t.merge(t.bytes[a] + t.bytes[b]) == [a, b])
    # runs of one letter, where merges of equal rank compete
    small = bpe.Transducer({b"a": 0, b"b": 1, b"aa": 2, b"aaa": 3, b"aaaa": 4, b"ba": 5})
    for n in range(1, 40):
        for piece in (b"a" * n, b"b" + b"a" * n, b"ab" * n):
            assert small.encode(piece) == ([small.ranks[piece]] if piece in small.ranks else small.merge(piece))


def test_memo_keeps_what_is_met_again():
    made = []

    class Counting:
        def encode(self, piece):
            made.append(piece)
            return [len(piece)]
    memo = bpe._Memo(Counting(), 8)
    for i in range(50):
        assert memo["the"] == struct.pack("<I", 3) and memo[f"word{i}"]
        assert len(memo) + len(memo.older) <= 8
    assert made.count(b"the") == 1 and len(made) == 51


def test_stream_decoder_holds_back_cut_characters():
    d = bpe.StreamDecoder({0: b"\xf0\x9f", 1: b"\x99\x82", 2: b"a"})
    assert [d.feed([0]), d.feed([1, 2]), d.close()] == ["", "🙂a", ""]


def test_jaccard_classes(spark, corpus):
    texts, df = corpus
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(df).collect()}
    assert got == brute.jaccard_components(texts)
    assert jaccard_join.jaccard_classes(none_of(spark)).count() == 0


def test_jaccard_family_around_the_threshold(spark):
    """Copies whose links to the original and to each other lie on both sides
    of the threshold, so that the search beyond the pivot matters."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    texts = {}
    for d in range(90):
        w = list(words)
        for p in rng.sample(range(10, 110, 12), rng.randint(0, 6)):
            w[p] = rng.choice(["x", "y", f"z{d}"])
        texts[d] = " ".join(w)
    texts |= {100 + i: " ".join(f"u{i}_{j}" for j in range(50)) for i in range(5)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(df).collect()}
    assert got == brute.jaccard_components(texts)
    kept = {r.doc_id for r in jaccard_join.keep_first(df, n=4, share=85).collect()}
    assert kept == {c for _, c in got.values()}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(400, 460)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in parent}


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_edit_distance(spark, tau):
    rng = random.Random(3)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abé🙂") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i:i + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        pairs.append((a, "".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.edits(F.col("a"), F.col("b"), tau).alias("d"))
    for r in got.collect():
        d = brute.edit_distance(r.a, r.b)
        assert r.d == (d if d <= tau else None)


def test_line_classes(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(30, 60))) for _ in range(12)]
    texts = {}
    for d in range(40):
        lines = []
        for _ in range(3):
            s = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                i = rng.randint(0, len(s))
                s[i:i + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
            lines.append("".join(s))
        texts[d] = "\n".join([*lines, "short"])
    places = {(d, i): x for d, t in texts.items() for i, x in enumerate(t.split("\n")) if len(x) >= 30}
    distinct = sorted(set(places.values()))
    parent = {x: x for x in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if abs(len(a) - len(b)) <= 2 and brute.edit_distance(a, b) <= 2:
                parent[root(a)] = root(b)
    first = {}
    for p in sorted(places):
        first.setdefault(root(places[p]), p)
    want = {p for p, x in places.items() if first[root(x)] != p}
    df = docs_of(spark, [texts[d] for d in sorted(texts)], 0)
    for hot in (1000, 1):
        got = line_dedup.line_classes(df, hot=hot).collect()
        assert {(r.doc_id, r.line_no) for r in got} == want and len(got) == len(want)
    left = {r.doc_id: r.text for r in line_dedup.remove_lines(df).collect()}
    for d, t in texts.items():
        rest = "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in want)
        assert left.get(d) == rest
    odd = docs_of(spark, ODD)
    assert line_dedup.remove_lines(odd).count() == len(ODD) and line_dedup.line_classes(none_of(spark)).count() == 0


def test_short_lines_that_repeat_exactly(spark, tmp_path):
    """Short lines are classed by equality alone, in the query and the stage."""
    import corpus_pipeline
    from envspark.llm import registry
    texts = [f"Licensed under CC BY-NC 4.0.\n \n\nown line of document number {'abcdefgh'[i] * 9}\nab{'cd'[i % 2]}" for i in range(8)]
    docs_of(spark, texts, 0).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.line_no, r.kept_doc_id) for r in registry.QUERIES["op6_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {(i, 0, 0) for i in range(1, 8)} | {(i, 4, i % 2) for i in range(2, 8)}
    left = {r.doc_id: r.text for r in corpus_pipeline.line_filter(spark, docs_of(spark, texts, 0), "").collect()}
    for i, t in enumerate(texts):
        lines = t.split("\n")
        assert left[i] == "\n".join([*lines[:1] * (i == 0), *lines[1:4], *lines[4:] * (i < 2)])


def test_substring_dedup(spark):
    passage = "Alpha beta gamma delta epsilon zeta eta theta. " * 1 + "Iota kappa lambda mu nu xi omicron pi rho and some more words. Sigma tau upsilon phi chi psi omega again and again."
    texts = [f"First one starts here {passage} It ends so.", f"Another beginning {passage} With another end.", "Nothing of the kind. In this one."]
    df = docs_of(spark, texts)
    got = substring_dedup.repeated_units(df).collect()
    assert {r.doc_id for r in got} == {2} and {r.kept_doc_id for r in got} == {1}
    for r in got:
        assert texts[1][r.start:r.end] in passage
    left = {r.doc_id: r.text for r in substring_dedup.remove_units(df, substring_dedup.repeated_units(df)).collect()}
    assert left[1] == texts[0] and left[3] == texts[2] and "kappa" not in left[2]
    assert substring_dedup.repeated_units(docs_of(spark, ODD)).count() == 0 == substring_dedup.repeated_units(none_of(spark)).count()


def test_substring_dedup_gives_every_repeat(spark, tmp_path):
    """Short units in the query; runs over units without words, per row."""
    from envspark.llm import registry
    ten = "a b c d e f g h i j"
    passage = f"{ten}. \n---\n{ten.upper()} k l. \n---\nshort one."
    rows = [(1, passage), (2, f"own words. {passage}"), (2, f"other beginning here. {passage}"), (None, passage), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["op3_substring_dedup"](spark, str(tmp_path)).collect()
    assert {r.kept_doc_id for r in got} == {1} and len(got) == 4 * 3
    assert {r.run_words for r in got} == {24}
    assert len({(r.doc_id, r.row, r.copy) for r in got}) == 4
    left = sorted(r.text for r in substring_dedup.remove_units(df, substring_dedup.repeated_units(df)).collect())
    assert passage in left and sum(ten in t for t in left) == 1
    twice = docs_of(spark, ["One two. Three."]).union(docs_of(spark, ["One two. Three."]))
    assert substring_dedup.repeated_units(twice, min_words=0).count() == 2


def test_decontamination(spark):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in "bcdfghjklm" for b in ("an", "et", "or", "iv", "us", "ol", "ap", "em", "ik", "ud")]
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(n))
    items = [say(30) for _ in range(12)]
    clean = [say(200) for _ in range(60)]
    dirty = []
    for i, t in enumerate(items):
        w = t.split()
        w[5] = "replaced"
        dirty.append(f"{say(40)} {' '.join(w)} {say(70)}")
    df = docs_of(spark, [*clean, *dirty, None, ""], 0)
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(99, None, "x"), (98, "", "x")], "item_id long, text string, doc_id string")
    hits = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}
    assert hits == {(60 + i, i) for i in range(12)}
    assert {r.doc_id for r in decontaminate.without_leaks(df, bench).collect()} == set(range(60)) | {72, 73}
    assert decontaminate.leaks(none_of(spark), bench).count() == 0
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_decontamination_of_an_item_in_many_rows(spark):
    """Copies of a passage make its own words frequent; they are found all the
    same, up to a passage in every row, and blocks are cut by terms."""
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    items = [say(30) for _ in range(3)]
    texts = [f"{say(60)} {items[0]} {items[1] if i % 3 == 0 else ''} {items[2] if i == 7 else ''} {say(60)}" for i in range(90)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(i, 0) for i in range(90)} | {(i, 1) for i in range(0, 90, 3)} | {(7, 2)}
    df = docs_of(spark, texts, 0)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == want
    assert decontaminate.without_leaks(df, bench).count() == 0


def test_decontamination_of_an_item_with_many_words(spark):
    """No word of an item is left out, however many terms the items hold."""
    words = [f"w{i}x" for i in range(decontaminate.LATENT + 2000)]
    bench = spark.createDataFrame([(0, " ".join(words)), (1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    index = list(decontaminate.build_indexes(docs_of(spark, [f"lead {' '.join(words[:500])}"]), bench, "doc_id", "text",
                                             "item_id", "text", 0.1, 0.6, 0.4))
    assert [i.ids for i in index] == [[0], [1]]
    assert all((i.row[decontaminate.term_ids(w)] >= 0).all() for i in index for w in i.words)


def test_decontamination_of_an_item_that_repeats_a_word(spark):
    """An item may hold a word more often than all texts of a batch."""
    bench = spark.createDataFrame([(0, "echo " * 9 + "alpha beta")], "item_id long, text string")
    df = docs_of(spark, ["echo alpha beta", "echo " * 9 + "alpha beta", "alpha"], 0)
    index, = decontaminate.build_indexes(df, bench, "doc_id", "text", "item_id", "text", 0.1, 0.6, 0.4)
    assert [[h[0] for h in hits] for text in ("echo alpha beta", "echo " * 9 + "alpha beta", "alpha")
            for hits in index.search([text])] == [[], [0], []]
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()] == [(1, 0)]


def test_html(spark):
    menu = "<nav><a>Home</a><a>News</a></nav>"
    pages = [
        (1, "http://h.example/1", f"<html><body>{menu}<div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>One<br>two <b>three</b></p>"
                                  "<div class='comments'>first!</div><form><p>x</p></form></article><footer>f</footer></body></html>"),
        (2, "http://h.example/2", "<div>All rights of this site belong to us forever</div><p>Unique words here on two</p>"),
        (3, "http://h.example/3", "<div>All rights of this site belong to us forever</div><p>Other words on page three</p>"),
        (4, None, None), (5, "", ""), (None, "u", "<main>m</main>")]
    got = {r.page_id: r.text for r in html_extract.extract_main(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "A & B\nOne two three", 2: "Unique words here on two", 3: "Other words on page three", 4: "", 5: "", None: "m"}


PAGE_SCHEMA = "page_id long, url string, html string, text string, key long, page long, block int"    # clashing names


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, 3) for r in rows], PAGE_SCHEMA)


def test_html_implied_ends_and_names():
    def kinds(html):
        return list(html_extract.blocks(html))
    assert kinds("<article><p class=notice>We<p>Body</article>") == [("out", "We"), ("main", "Body")]
    assert kinds("<article><li class='nav-item'>Home<p>Body</article>") == [("out", "Home"), ("main", "Body")]
    assert kinds("<article><ul><li class='nav-item'>Home<li>Real</ul>B</article>") == [("out", "Home"), ("main", "Real"), ("main", "B")]
    assert kinds("<table><tr><td class=ad>a<td>b<tr><td>c</table>d") == [("out", "a"), ("open", "b"), ("open", "c"), ("open", "d")]
    assert kinds("<article><div class=notice>a<p>b</article>c") == [("out", "a"), ("out", "b"), ("open", "c")]
    assert kinds("<div><main><p>a</div></p>b</main></div>c") == [("main", "a"), ("main", "b"), ("open", "c")]
    assert kinds("<form><nav>n</nav><main>m<form>f</form></main></form>") == [("out", "n"), ("main", "m"), ("out", "f")]
    assert kinds("<main><div class='section-header'>a</div><div class='comment-list'>b</div><i class='relatedWork'>c</i>"
                 "<span class='AD'>d <span>e</span> f</span> g</main>") == [
        ("main", "a"), ("out", "b"), ("doubt", "c"), ("out", "d e f"), ("main", "g")]
    deep = "<div><ul><li><p>" * 20_000
    assert kinds(deep + "x" + "</div>" * 20_000) == [("open", "x")]


def test_html_copies_hints_and_odd_rows(spark):
    one = "<div>Our terms are the terms of all</div><p>Only this page has these few words</p>"
    body = "<article><p>Text number {}</p><div id='related-work'>{}</div></article>"
    rows = [(1, "http://h.example/1", one), (2, "http://h.example/1?p=2", one), (2, "http://h.example/1?p=2", one), (None, None, one),
            (4, "http://g.example/4", body.format(4, "Earlier work of others on this")),
            (5, "http://g.example/5", body.format(5, "Read more on our fine site now")),
            (6, "http://g.example/6", body.format(6, "Read more on our fine site now")),
            (7, "http://l.example/7", "<main>" + "<p>long page</p>" * 30_000), (8, "http://l.example/8", "<main></main>"), (9, "", " ")]
    got = sorted((r.page_id or 0, r.text, r.n_chars, r.n_repeated) for r in html_extract.extract_main(pages_of(spark, rows)).collect())
    both = "Our terms are the terms of all\nOnly this page has these few words"
    long = "\n".join(["long page"] * 30_000)
    assert got == [(0, both, 65, 0), (1, both, 65, 0), (2, both, 65, 0), (2, both, 65, 0),
                   (4, "Text number 4\nEarlier work of others on this", 44, 0), (5, "Text number 5", 13, 1), (6, "Text number 6", 13, 1),
                   (7, long, len(long), 0), (8, "", 0, 0), (9, "", 0, 0)]
    assert html_extract.extract_main(pages_of(spark, rows).limit(0)).count() == 0


def test_html_moves_texts_compressed(spark):
    """The join with the repeated blocks moves far less than the texts."""
    said = " ".join(f"word{i % 50}" for i in range(20_000))
    rows = [(i, f"http://h.example/{i}", f"<main><p>{i} {said}</p><p>\u00e9 \U0001f642</p></main><p>All the same words on each page</p>") for i in range(6)]
    found = html_extract.extract_main(pages_of(spark, rows))
    assert {r.page_id: (r.text, r.n_repeated) for r in found.collect()} == {
        i: (f"{i} {said}\n\u00e9 \U0001f642", 1) for i in range(6)}
    assert "packed" in found._jdf.queryExecution().optimizedPlan().toString()


def test_html_against_brute_force(spark):
    rng = random.Random(5)
    shared = [" ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randint(2, 9))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 9)))
                 for _ in range(5)]
        inside = "".join(f"<p>{x}</p>" for x in parts[:3])
        hinted = f"<section class='related-{rng.randrange(3)}x'>{parts[3]}</section>"
        html = f"<article>{inside}{hinted}</article><p>{parts[4]}</p>" if i % 3 else f"{inside}<footer>{parts[3]}</footer>"
        rows.append((i, f"http://h{i % 4}.example/{i}", html))
    rows += [(100 + i, f"http://h{i % 4}.example/copy", rows[i][2]) for i in range(8)]
    want = brute.main_texts(rows)
    got = {r.page_id: r.text for r in html_extract.extract_main(pages_of(spark, rows)).collect()}
    assert got == want and len(set(want.values())) > 30


def test_quality_held_out_accuracy(spark):
    d, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = quality.score_documents(d, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    none = quality.score_documents(docs_of(spark, ODD), labels.limit(0)).collect()
    assert [(r.score, r.predicted) for r in none] == [(0.5, 1)] * len(ODD)


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    bench = [r.text for r in table(spark, sf, "benchmark").collect()]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) <= set(docs) and len(got) > 0.7 * len(docs)
    for r in got.values():          # no benchmark item is left whole in a kept document
        text = bpe.decode_ids(spark.createDataFrame([(r.ids,)], "ids array<int>"), RANKS).first().decoded if r.doc_id % 40 == 0 else None
        if text:
            assert not any(" ".join(b.split()) in " ".join(text.split()) for b in bench)
            assert set(text.split("\n")) <= set(docs[r.doc_id].split("\n"))

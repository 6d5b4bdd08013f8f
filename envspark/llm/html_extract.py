"""HTML extraction with a host suffix array.

A page is read as a stream of blocks.  Blocks inside ``article`` / ``main``
are main text, except navigation, forms, scripts, adverts, notices and
comments nested in them.  Everything outside is suspect, and so are blocks in
an element of the container whose name only hints at boilerplate
(``related-work``).  The token streams of suspect blocks are concatenated per
host into a suffix array cut at a depth of ``depth`` tokens: suffixes with the
same first ``depth`` tokens stand together, and an interval with two distinct
pages is a substring repeated across pages.  Blocks covered by repeated
substrings are boilerplate.  Hinted blocks of a container stay if they are not
covered; a page without a container keeps the open blocks - not excluded by
their element - that are not covered: its unique runs.

Pages are told apart by their blocks, so copies of a page under several
addresses or ids are one page for repetition, and each gets its text.

Elements follow the rules of implied end tags: a paragraph ends where a block
begins, list items, table cells and options end at the next one, and an end
tag ends all that is open inside its element but never a main container.

The interval test is a map-side combined minimum and maximum of the page key
per (host, suffix prefix), so a host with a third of all pages, or a menu on
every page, is a few rows per task; the join back to places is an equi-join
that adaptive execution can split.

Null and empty pages give the empty text.  Every row is read by itself, so
repeated rows and null ids keep their rows; further columns are left out.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.llm.common import small_batches

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section
select summary table tbody td tfoot th thead title tr ul caption""".split())
EXCLUDED = frozenset("nav footer aside form button select menu dialog head title search fieldset label input".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARK = re.compile(
    r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
HINTS = frozenset("""ad ads advert adverts advertisement sponsored promo banner cookie cookies consent gdpr notice notices
popup modal sidebar nav navbar navigation menu breadcrumb breadcrumbs masthead header footer contentinfo complementary
comment comments disqus replies share sharing social related newsletter subscribe login search toolbar
pagination""".split())
# words that do not change what the hint beside them says
PLAIN = frozenset("""site page top bottom left right main global primary secondary bar box list item items link links block
widget container wrapper wrap inner outer area panel btn button buttons icon icons group user reader form field input post
posts article articles story stories web mobile desktop fixed sticky js thread""".split())
LISTS = frozenset("ul ol menu dir dl".split())
# a start tag ends these open elements, up to the ones named last
ENDED = {tag: (frozenset(ends.split()), frozenset(upto.split())) for tag, ends, upto in (
    ("li", "li", "ul ol menu dir"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("option", "option", "select"),
    ("td", "td th", "tr table"), ("th", "td th", "tr table"), ("tr", "tr td th", "table"),
    ("tbody", "tbody thead tfoot tr td th", "table"), ("tfoot", "tbody thead tfoot tr td th", "table"))}
NO_PARAGRAPH = BLOCKS - frozenset("html body head title legend option select caption table tbody td tfoot th thead tr".split())
HOLDS_PARAGRAPH = frozenset("table td th caption button".split()) | MAIN
HOST = re.compile(r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def _effect(tag: str, attrs: str, in_main: bool) -> str | None:
    """What an element does to the blocks inside: out, doubt or nothing.  A
    name all of whose words belong to boilerplate excludes; one with other
    words beside a hint leaves it to the repetition on the host."""
    if tag in MAIN or tag in ("html", "body"):
        return None
    if tag in EXCLUDED or (tag == "header" and not in_main):
        return "form" if tag == "form" and not in_main else "out"
    effect = None
    for m in MARK.finditer(attrs or ""):
        value = next((v for v in m.groups() if v), "")
        for name in value.split() if m[0][:5].lower() == "class" else [value]:
            words = {w.lower() for w in WORD.findall(name)}
            hints = words & HINTS - ({"header"} if in_main else set())
            if hints and words <= HINTS | PLAIN:
                return "out"
            if hints:
                effect = "doubt"
    return effect


class _Open:
    """The open elements that matter: blocks, and elements with an effect."""

    def __init__(self):
        self.stack: list[tuple[str, str | None]] = []
        self.tags: Counter = Counter()
        self.effects: Counter = Counter()

    def kind(self) -> str:
        e = self.effects
        if e["out"]:
            return "out"
        if e["main"]:
            return "doubt" if e["doubt"] else "main"
        return "out" if e["form"] else "open"

    def pop_to(self, n: int) -> None:
        while len(self.stack) > n:
            tag, effect = self.stack.pop()
            self.tags[tag] -= 1
            self.effects[effect] -= 1

    def end_nearest(self, ends, upto) -> None:
        """End the outermost of ``ends`` that is open above the next ``upto``."""
        left, at, n = sum(self.tags[t] for t in ends), None, len(self.stack)
        while left:
            n -= 1
            tag = self.stack[n][0]
            if tag in ends:
                at, left = n, left - 1
            elif tag in upto:
                break
        if at is not None:
            self.pop_to(at)

    def start(self, tag: str, attrs: str) -> None:
        if tag in NO_PARAGRAPH:
            self.end_nearest(("p",), HOLDS_PARAGRAPH)
            if tag not in ENDED and not any(self.tags[t] for t in LISTS):
                self.end_nearest(("li", "dt", "dd"), MAIN)      # an item without a list
        if tag in ENDED:
            ends, upto = ENDED[tag]
            self.end_nearest(ends, upto | MAIN)
        if tag in VOID or attrs.endswith("/"):
            return
        if tag in MAIN and not self.effects["out"]:
            effect = "main"
        else:
            effect = _effect(tag, attrs, self.effects["main"] > 0)
        if effect or tag in BLOCKS or self.tags[tag]:
            self.stack.append((tag, effect))
            self.tags[tag] += 1
            self.effects[effect] += 1

    def end(self, tag: str) -> None:
        if not self.tags[tag] or tag in ("html", "body"):
            return
        for n in range(len(self.stack) - 1, -1, -1):
            at = self.stack[n][0]
            if at == tag:
                self.pop_to(n)
                return
            if at in MAIN or (tag not in BLOCKS and at in BLOCKS):
                return


def blocks(page: str | None) -> Iterator[tuple[str, str]]:
    """(kind, text) of the page's non-empty blocks in order; kind is main,
    doubt (inside a main container, in an element that hints at boilerplate),
    open (outside a main container) or out (inside an excluded element)."""
    opened = _Open()
    held: list[str] = []

    def flush(kind):
        text = " ".join(htmllib.unescape("".join(held)).split())
        held.clear()
        if text:
            yield kind, text
    for m in PIECE.finditer(page or ""):
        if m["text"] is not None:
            held.append(m["text"])
            continue
        if m["tag"] is None:
            if m["raw"]:
                held.append(" ")
            continue
        tag, before = m["tag"].lower(), opened.kind()
        if tag == "br":
            held.append(" ")
            continue
        if m["close"]:
            opened.end(tag)
        else:
            opened.start(tag, m["attrs"])
        if tag in BLOCKS or opened.kind() != before:
            yield from flush(before)
    yield from flush(opened.kind())


def _page_key(host: str, found: list[tuple[str, str]]) -> int:
    """Tells pages apart by their blocks."""
    h = xxhash.xxh3_64(host.encode("utf-8", "surrogatepass"))
    for kind, text in found:
        h.update(f"\n{kind}\t{text}".encode("utf-8", "surrogatepass"))
    return h.intdigest() - (1 << 63)


def _host(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 depth: int = 6, covered_share: float = 0.8) -> DataFrame:
    """page id, url, text, n_chars and n_repeated (suspect blocks covered by
    runs repeated across the host's pages)."""
    src = small_batches(pages).select(F.col(id_col).cast("long").alias("__id"), F.col(url_col).alias("__url"),
                       F.col(html_col).alias("__html"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, url, html in zip(pdf["__id"], pdf["__url"], pdf["__html"]):
                found = list(blocks(html))
                contained = any(kind in ("main", "doubt") for kind, _ in found)
                parts, numbers, n = [], [], 0
                for kind, text in found:
                    if kind == "main":
                        if numbers and numbers[-1] < 0:
                            parts[-1].append(text)
                        else:
                            parts.append([text])
                            numbers.append(-1)
                        continue
                    if kind == ("doubt" if contained else "open"):
                        parts.append([text])
                        numbers.append(n)
                    n += 1
                parts = ["\n".join(p) for p in parts]
                text = "\n".join(parts).encode()
                rows.append((page, url, _page_key(_host(url), found), len(text), pa.compress(text, "zstd", asbytes=True),
                             [len(p) for p in parts], numbers))
            frame = pd.DataFrame(rows, columns=["__id", "__url", "key", "bytes", "packed", "sizes", "numbers"])
            frame["__id"] = frame["__id"].astype("Int64")
            yield frame

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, repeated = [], []
            for size, packed, sizes, numbers, boiler in zip(*(pdf[c] for c in ("bytes", "packed", "sizes", "numbers", "boiler"))):
                text = pa.decompress(packed, size, "zstd", asbytes=True).decode()
                gone, at, parts = set() if boiler is None else set(boiler), 0, []
                for n, number in zip(sizes, numbers):
                    if number not in gone:
                        parts.append(text[at:at + n])
                    at += n + 1
                texts.append("\n".join(parts))
                repeated.append(len(gone))
            frame = pdf[["__id", "__url"]].assign(text=texts, n_repeated=repeated)
            frame["__id"] = frame["__id"].astype("Int64")
            yield frame

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, seen = [], set()
            for url, html in zip(pdf["__url"], pdf["__html"]):
                host, found = _host(url), list(blocks(html))
                page = _page_key(host, found)
                if page in seen:
                    continue
                seen.add(page)
                for n, text in enumerate(text for kind, text in found if kind != "main"):
                    tokens = text.lower().split()
                    # a block shorter than the depth is one suffix by itself
                    last = max(1, len(tokens) - depth + 1)
                    for i in range(last):
                        h = xxhash.xxh3_64_intdigest(
                            f"{host}\n{' '.join(tokens[i:i + depth])}".encode("utf-8", "surrogatepass")) - (1 << 63)
                        rows.append((h, page, n, i, len(tokens)))
            yield pd.DataFrame(rows, columns=["h", "page", "block", "pos", "n_tokens"])

    places = src.select("__url", "__html").mapInPandas(
        suffixes, "h long, page long, block int, pos int, n_tokens int")
    shared = (places.groupBy("h").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
              .where("lo <> hi").select("h"))
    hits = places.join(shared, "h", "left_semi").distinct()
    # tokens of a block covered by [pos, pos + depth) of its repeated places
    repeated = (hits.groupBy("page", "block", "n_tokens").agg(F.array_sort(F.collect_set("pos")).alias("at"))
                .withColumn("covered", F.aggregate(
                    "at", F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
                    lambda a, p: F.struct(
                        F.least(p + depth, F.col("n_tokens")).alias("upto"),
                        (a["n"] + F.least(p + depth, F.col("n_tokens")) - F.greatest(p, a["upto"])).alias("n")),
                    lambda a: a["n"]))
                .where(F.col("covered") >= covered_share * F.col("n_tokens"))
                .groupBy("page").agg(F.collect_set("block").alias("boiler")))
    # texts travel compressed: they are most of what the join moves
    return (src.mapInPandas(read, "__id long, __url string, key long, bytes long, packed binary, sizes array<int>, numbers array<int>")
            .join(repeated, F.col("key") == F.col("page"), "left")
            .select("__id", "__url", "bytes", "packed", "sizes", "numbers", "boiler")
            .mapInPandas(kept, "__id long, __url string, text string, n_repeated long")
            .select(F.col("__id").alias(id_col), F.col("__url").alias(url_col), "text",
                    F.length("text").cast("long").alias("n_chars"), "n_repeated"))

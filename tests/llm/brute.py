"""Plain Python versions of the query contracts, one document at a time."""

import hashlib
import re

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def licenses(text):
    words = WORD.findall(ascii_lower(text or ""))
    starts, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))


def secrets(text):
    text = text or ""
    found = []
    key = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for m in key.finditer(text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, "hex", m.end()))
    found.sort()
    n = [sum(f[1] == k for f in found) for k in range(3)]
    base = ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)
    return (*n, hashlib.sha256(base.encode()).hexdigest())


def edited(texts):
    """doc_id -> edited text, for unique ids."""
    ids = sorted(texts, reverse=True)
    out = {}
    for i, d in enumerate(ids):
        t, nxt = texts[d] or "", texts[ids[(i + 1) % len(ids)]] or ""
        k = len(t) // 3
        out[d] = t[:len(t) - k] + nxt[:k]
    return out


def shingles(text, n=4):
    w = SPACED.findall(ascii_lower(text or ""))
    if not w:
        return frozenset()
    if len(w) < n:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def jaccard_components(texts, n=4, share=85):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {d: shingles(t, n) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            sa, sb = sets[a], sets[b]
            if sa and sb and min(len(sa), len(sb)) * 100 >= share * max(len(sa), len(sb)):
                both = len(sa & sb)
                if 100 * both >= share * (len(sa) + len(sb) - both):
                    ra, rb = root(a), root(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in ids}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def main_texts(pages, depth=6, share=0.8):
    """page id -> main text by comparing every page with every other one of
    its host, token by token, on the parsed blocks."""
    from envspark.llm.html_extract import blocks
    read = {i: (url.split("/")[2], tuple(blocks(html))) for i, url, html in pages}

    def runs(tokens):
        return [tuple(tokens[i:i + depth]) for i in range(max(1, len(tokens) - depth + 1))]
    out = {}
    for i, (host, found) in read.items():
        others = {f for h, f in read.values() if h == host and f != found}
        elsewhere = {r for f in others for kind, text in f if kind != "main" for r in runs(text.lower().split())}
        contained = any(kind in ("main", "doubt") for kind, _ in found)
        kept = []
        for kind, text in found:
            tokens = text.lower().split()
            covered = {k for at, r in enumerate(runs(tokens)) if r in elsewhere for k in range(at, min(at + depth, len(tokens)))}
            if kind == "main" or (kind == ("doubt" if contained else "open") and len(covered) < share * len(tokens)):
                kept.append(text)
        out[i] = "\n".join(kept)
    return out

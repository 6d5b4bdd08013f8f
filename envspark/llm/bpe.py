"""Byte-level BPE as a lazily determinised transducer, and its decoder.

Encoding.  A sequence of tokens is the BPE encoding of its bytes exactly if
every two neighbours are: encoding their joined bytes gives the two back.  So
the last token of the encoding of a prefix is the one vocabulary entry that
ends there and agrees with the last token before it.  Reading left to right,
only prefix ends from which some vocabulary entry could still reach beyond
the current byte matter; a state is these open ends, each with the tree node
of the bytes since and the token leading to it, and a move puts out the token
that ends at the new byte.  A
token is certain once the chains behind all open ends share it, which takes
a few entries' lengths at most.  States and moves are built when first met
and kept (up to ``max_states``, then started afresh).

Whether two entries may stand side by side is read off their edges: an entry
came from two halves by its last merge, so the entries that touch the border
are known with the ranks at which each of them appeared and disappeared.  The
two agree unless a merge across the border fell into such a time.

Decoding joins the tokens' bytes and feeds them to an incremental UTF-8 state
machine, so it can stream tokens that cut characters in half.

Texts are split by the vocabulary's pattern first.  Null reads as empty;
empty texts have no tokens.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.llm.common import small_batches


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a rank file (base64 bytes, rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Bytes in, token ids out; see the module text."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        # the tree of all entries: node and byte -> node; per node its bytes' number, entry and whether it goes on
        self.tree: dict[int, int] = {}
        self.depth, self.entry, self.inner = [0], [-1], [True]
        for b, i in ranks.items():
            node = 0
            for byte in b:
                self.inner[node] = True
                to = self.tree.get(node << 8 | byte)
                if to is None:
                    to = self.tree[node << 8 | byte] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    self.entry.append(-1)
                    self.inner.append(False)
                node = to
            self.entry[node] = i
        self.pair: dict[int, bool] = {}
        # the halves of an entry's last merge, and the entries that encode as themselves
        self.left_half: dict[int, int] = {}
        self.right_half: dict[int, int] = {}
        self.whole: set[int] = set()
        for i in sorted(self.bytes):
            self._place(i)
        self.reset()

    def _place(self, i: int) -> None:
        entry, ranks = self.bytes[i], self.ranks
        if len(entry) == 1:
            self.whole.add(i)
            return
        for k in range(1, len(entry)):
            a, b = ranks.get(entry[:k]), ranks.get(entry[k:])
            if a is not None and b is not None and a in self.whole and b in self.whole and not self.crossed(a, b, i):
                self.left_half[i], self.right_half[i] = a, b
                self.whole.add(i)
                return

    def reset(self) -> None:
        # a state: for each open end, the furthest first, the node of the
        # bytes since and one more than the last token there (0: piece start)
        start = struct.pack("<Q", 0)
        self.states: dict[bytes, int] = {start: 0}
        self.keys: list[bytes] = [start]
        self.moves: dict[int, int] = {}     # state and byte -> next state and token, packed

    def merge(self, piece: bytes) -> list[int]:
        """The encoding by plain merging: the lowest-ranked neighbours first,
        until none is left.  The yardstick of the transducer."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def crossed(self, left: int, right: int, before: int = 1 << 60) -> bool:
        """Whether a merge across the border of two entries comes before rank
        ``before``.  Of merges of equal rank the leftmost comes first."""
        ranks, token = self.ranks, self.bytes
        a, a_gone = left, 1 << 60
        while a is not None:
            inner = self.right_half.get(a)
            a_since = -1 if inner is None else a
            b, b_gone, mine = right, 1 << 60, token[a]
            while b is not None:
                half = self.left_half.get(b)
                m = ranks.get(mine + token[b])
                if m is not None:
                    at = max(m, a_since, -1 if half is None else b)
                    if at < before and at < a_gone and at <= b_gone:
                        return True
                b, b_gone = half, b
            a, a_gone = inner, a
        return False

    def agree(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two entries are encoded as the two."""
        if left < 0:
            return True
        key = left << 32 | right
        known = self.pair.get(key)
        if known is None:
            if len(self.pair) > 300_000:
                self.pair.clear()
            known = self.pair[key] = not self.crossed(left, right)
        return known

    def step(self, key: bytes, byte: int) -> tuple[bytes, int]:
        """Follow one byte: the new state and the token that ends there."""
        token, live = None, []
        for end in struct.unpack(f"<{len(key) >> 3}Q", key):
            node = self.tree.get(end >> 32 << 8 | byte)
            if node is None:
                continue
            left = end & 0xFFFFFFFF
            if token is None:
                t = self.entry[node]
                if t in self.whole and self.agree(left - 1, t):
                    token = t
            if self.inner[node]:
                live.append(node << 32 | left)
        if token is None:
            raise ValueError("the vocabulary lacks single bytes")
        return struct.pack(f"<{len(live) + 1}Q", *live, token + 1), token

    def move(self, state: int, byte: int) -> int:
        key, token = self.step(self.keys[state], byte)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.keys)
            self.keys.append(key)
        made = self.moves[state << 8 | byte] = to << 32 | token
        return made

    def settled(self, ending: list[int], state: int) -> int:
        """The last position that the token chains behind all open ends of
        the state share: tokens up to there are certain."""
        chains = []
        key = self.keys[state]
        for end in struct.unpack(f"<{len(key) >> 3}Q", key):
            p, chain = len(ending) - self.depth[end >> 32], set()
            while p > 0:
                chain.add(p)
                p -= self.size[ending[p - 1]]
            chains.append(chain)
        return max(set.intersection(*chains), default=0)

    def path(self, ending: list[int], upto: int) -> list[int]:
        out, p = [], upto
        while p > 0:
            t = ending[p - 1]
            out.append(t)
            p -= self.size[t]
        out.reverse()
        return out

    def encode(self, piece: bytes, lookahead: int = 4096) -> list[int]:
        """Token ids of one piece; a piece that is an entry is that entry.
        Certain tokens are put out every ``lookahead`` bytes."""
        direct = self.ranks.get(piece)
        if direct is not None:
            return [direct]
        if len(self.keys) > self.max_states:
            self.reset()
        state, ending, out, moves = 0, [], [], self.moves
        for byte in piece:
            made = moves.get(state << 8 | byte)
            if made is None:
                made = self.move(state, byte)
            state = made >> 32
            ending.append(made & 0xFFFFFFFF)
            if len(ending) >= lookahead:
                sure = self.settled(ending, state)
                out += self.path(ending, sure)
                del ending[:sure]
        return out + self.path(ending, len(ending))


class StreamDecoder:
    """Token ids in, text out as soon as whole characters are there."""

    def __init__(self, token_bytes: dict[int, bytes], errors: str = "replace"):
        self.token_bytes = token_bytes
        self.utf8 = codecs.getincrementaldecoder("utf-8")(errors)

    def feed(self, ids: Iterable[int]) -> str:
        return self.utf8.decode(b"".join(map(self.token_bytes.__getitem__, ids)))

    def close(self) -> str:
        return self.utf8.decode(b"", True)


class _Memo(dict):
    """Piece -> its ids as little-endian 32-bit integers.  Holds two
    generations of ``limit`` / 2 pieces: a full one becomes the older, whose
    pieces come back when met again, so that frequent pieces stay."""

    def __init__(self, transducer: Transducer, limit: int):
        self.transducer, self.half, self.older = transducer, max(1, limit // 2), {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = self.transducer.encode(piece.encode("utf-8", "surrogatepass"))
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[piece] = packed
        return packed


_WORKER: dict[tuple, tuple] = {}


def _worker(lines: bytes, pattern: str, memo: int):
    """Transducer, pattern and memo of this Python worker, kept across tasks."""
    key = (hash(lines), pattern, memo)
    if key not in _WORKER:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
        t = Transducer(ranks)
        _WORKER.clear()
        _WORKER[key] = (t, regex.compile(pattern), _Memo(t, memo))
    return _WORKER[key]


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = True, memo: int = 300_000, block: int = 1 << 20) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and (``with_ids``) the ids.

    A narrow map: nothing is shuffled.  The rank file is read once on the
    driver and broadcast; it does not grow with the data.  A text is split
    piece by piece and hashed in blocks of ``block`` pieces, so that memory
    beside the text itself is bounded when ids are not asked for.
    """
    with open(rank_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "__id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transducer, split, memoised = _worker(shared.value, pattern, memo)
        token_bytes = transducer.bytes.__getitem__
        for pdf in batches:
            out, held = [], 0
            for doc, text in zip(pdf["__id"], pdf["__text"]):
                ids_hash, text_hash, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                for packed in _packed(text or "", split, memoised, block):
                    ids = memoryview(packed).cast("I").tolist()
                    n += len(ids)
                    ids_hash.update(packed)
                    text_hash.update(b"".join(map(token_bytes, ids)))
                    if with_ids:
                        kept.append(packed)
                ids = (np.frombuffer(b"".join(kept), "<i4"),) if with_ids else ()
                out.append((doc, n, ids_hash.hexdigest(), text_hash.hexdigest(), *ids))
                held += n
                if held > 500_000:
                    yield frame(out)
                    out, held = [], 0
            yield frame(out)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["__id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)
        made["__id"] = made["__id"].astype("Int64")
        return made
    src = small_batches(docs).select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    return src.mapInPandas(run, schema).withColumnRenamed("__id", id_col)


def _packed(text: str, split, memoised: _Memo, block: int) -> Iterator[bytes]:
    if len(text) <= 4 * block:
        yield b"".join(map(memoised.__getitem__, split.findall(text)))
        return
    held = []
    for m in split.finditer(text):
        held.append(memoised[m[0]])
        if len(held) >= block:
            yield b"".join(held)
            held = []
    yield b"".join(held)


def decode_ids(df: DataFrame, rank_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the text of an array of token ids, decoded in steps by the
    incremental UTF-8 machine (invalid bytes become U+FFFD; null stays null)."""
    token_bytes = {i: b for b, i in load_ranks(rank_path).items()}
    shared = df.sparkSession.sparkContext.broadcast(token_bytes)

    @F.pandas_udf("string")
    def decode(col: pd.Series) -> pd.Series:
        def one(ids):
            if ids is None:
                return None
            d = StreamDecoder(shared.value)
            parts = [d.feed(ids[i:i + 65_536]) for i in range(0, len(ids), 65_536)]
            return "".join(parts) + d.close()
        return col.map(one)
    return df.withColumn(out_col, decode(ids_col))

"""Byte-level BPE by a queue of merge ranks with a hierarchical bitmap.

All pre-tokens of a batch are one linked list of symbols. Bucket r holds the list
positions whose pair merges into rank r; a bitmap of three levels marks the buckets in
use, and find-first-set gives the next rank. A bucket is taken at once, for all
pre-tokens: positions whose pair has changed since are stale and skipped, neighbours
in a run merge from the left, every second one. New pairs go to their buckets. A merge
that makes a pair of a smaller rank ends its pre-token's turn, and the rest of the
bucket waits. A very long pre-token has a queue of its own with the same bitmap, whose
buckets are heaps of positions: its work follows the merges (times the logarithm of
its length) whatever the ranks, not the square of the length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ChunkTable, by_pretoken, slices
from .common import documents, text_or_empty

_NONE = -1
#: Bytes from which a pre-token has a queue of its own.
LONG = 1024


class RankBitmap:
    """A set of small integers with find-first-set, 64 to a word, in levels."""

    def __init__(self, size: int):
        self.levels = []
        while True:
            size = (size + 63) // 64
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, i: int) -> None:
        for level in self.levels:
            word, bit = i >> 6, 1 << (i & 63)
            if level[word] & bit:
                return
            level[word] |= bit
            i = word

    def remove(self, i: int) -> None:
        for level in self.levels:
            level[i >> 6] &= ~(1 << (i & 63))
            if level[i >> 6]:
                return
            i >>= 6

    def first(self) -> int:
        """The smallest member, -1 if there is none."""
        i = 0
        for level in reversed(self.levels):
            word = level[i]
            if not word:
                return -1
            i = (i << 6) + (word & -word).bit_length() - 1
        return i


class Ranks:
    """Merge ranks of a tiktoken file; a token's id is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ids.values()) + 1
        self.tokens = [b""] * self.size
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        keys, ranks, self.careful = [], [], np.zeros(self.size, bool)
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                # A part that ranks above the whole: after its merge a smaller rank may come next.
                for part in (left, right):
                    if part is not None and part > rank:
                        self.careful[part] = True
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    ranks.append(rank)
        self._hash(np.array(keys, np.int64), np.array(ranks, np.int64))

    def _hash(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open hash table of all pairs that merge."""
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        self.keys, self.ranks = np.full(1 << self.bits, _NONE, np.int64), np.full(1 << self.bits, _NONE, np.int64)
        slot = self._slot(keys)  # pairs are distinct
        while len(keys):
            free = self.keys[slot] == _NONE
            self.keys[slot[free]], self.ranks[slot[free]] = keys[free], ranks[free]
            left = self.keys[slot] != keys
            keys, ranks, slot = keys[left], ranks[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank into which each pair merges, -1 if it does not."""
        keys = left << 20 | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != _NONE))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[hit]]
            more = ~hit & (found != _NONE)
            open_, slot = open_[more], slot[more]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in a row, and how many each has."""
        whole = [self.ids.get(p, _NONE) for p in pieces]
        counts = np.array([1 if p else 0 for p in pieces], np.int64)
        many = [k for k, (p, w) in enumerate(zip(pieces, whole, strict=True)) if p and w < 0 and len(p) < LONG]
        long = {k: self.merge_long(p) for k, (p, w) in enumerate(zip(pieces, whole, strict=True)) if w < 0 and len(p) >= LONG}
        ids, sizes = self._merge([pieces[k] for k in many])
        counts[many] = sizes
        for k, own in long.items():
            counts[k] = len(own)
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        single = np.array([k for k, w in enumerate(whole) if w >= 0], np.int64)
        out[ends[single] - 1] = np.array(whole, np.int64)[single]
        for k, own in long.items():
            out[ends[k] - len(own) : ends[k]] = own
        if many:
            stops = np.cumsum(sizes)
            out[np.repeat(ends[many] - stops, sizes) + np.arange(len(ids))] = ids  # the places that gather() would read
        return out, counts

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one pre-token: the bitmap's first rank, the leftmost position in its bucket, until none is left."""
        n, tokens, known = len(piece), self.tokens, self.ids.get
        symbol = array("i", self.byte_ids[np.frombuffer(piece, np.uint8)].astype(np.int32).tobytes())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        after[n - 1] = _NONE
        start = self.pair(self.byte_ids[np.frombuffer(piece[:-1], np.uint8)], self.byte_ids[np.frombuffer(piece[1:], np.uint8)])
        rank = array("i", np.append(start, _NONE).astype(np.int32).tobytes())
        used, buckets = RankBitmap(self.size), {}
        order = np.argsort(start, kind="stable")
        bounds = np.flatnonzero(np.diff(start[order], prepend=-2))
        for at, end in zip(bounds.tolist(), [*bounds[1:].tolist(), n - 1], strict=True):
            if (r := int(start[order[at]])) >= 0:
                buckets[r] = order[at:end].tolist()  # ascending, so a heap
                used.add(r)
        while (r := used.first()) >= 0:
            held = buckets[r]
            waits = False
            while held and not waits:
                i = heapq.heappop(held)
                if rank[i] != r:
                    continue  # stale
                gone = after[i]
                symbol[i], after[i], rank[gone] = r, after[gone], _NONE
                symbol[gone] = _NONE
                if after[i] >= 0:
                    before[after[i]] = i
                else:
                    rank[i] = _NONE
                for j in (before[i], i):
                    if j >= 0 and after[j] >= 0:
                        rank[j] = new = known(tokens[symbol[j]] + tokens[symbol[after[j]]], _NONE)
                        if new >= 0:
                            if bucket := buckets.get(new):
                                heapq.heappush(bucket, j)
                            else:
                                buckets[new] = [j]
                                used.add(new)
                                if new == r:
                                    held = buckets[r]
                            waits |= new < r
            if not held:
                buckets.pop(r, None)
                used.remove(r)
        every = np.frombuffer(symbol, np.int32)
        return every[every >= 0].astype(np.uint32)

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not pieces:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        lengths = np.array([len(p) for p in pieces], np.int64)
        symbol = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(symbol)
        owner = np.repeat(np.arange(len(pieces)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.cumsum(lengths) - 1
        after[last], before[last - lengths + 1] = _NONE, _NONE
        rank = np.full(n, _NONE, np.int64)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.pair(symbol[inner], symbol[inner + 1])
        alive = np.ones(n, bool)

        buckets: dict[int, list[np.ndarray]] = {}
        used = RankBitmap(self.size)

        def push(places: np.ndarray) -> None:
            ranks = rank[places]
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            starts = np.flatnonzero(np.diff(ranks, prepend=-1))
            bounds = [*starts[1:].tolist(), len(places)]
            for r, a, b in zip(ranks[starts].tolist(), starts.tolist(), bounds, strict=True):
                if r in buckets:
                    buckets[r].append(places[a:b])
                else:
                    buckets[r] = [places[a:b]]
                    used.add(r)

        push(inner)
        while (r := used.first()) >= 0:
            used.remove(r)
            held = buckets.pop(r)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = at[rank[at] == r]  # the rest is stale
            if len(at) > 1:
                at = np.unique(at)
                every = at
                runs = np.flatnonzero(at[1:] != after[at[:-1]]) + 1
                if len(runs) + 1 < len(at):
                    place = np.arange(len(at))
                    start = np.zeros(len(at), np.int64)
                    start[runs] = runs
                    at = at[(place - np.maximum.accumulate(start)) % 2 == 0]
                if self.careful[r]:
                    last = self._turns(r, at, owner, symbol, after, before)
                    # Places after the one that ends a pre-token's turn wait; those that it spoils are stale by then.
                    stop = np.full(len(pieces), n, np.int64)
                    stop[owner[at[last]]] = at[last]
                    push(every[every > stop[owner[every]]])
                    at = at[at <= stop[owner[at]]]
            if not len(at):
                continue
            gone = after[at]
            follows = after[gone]
            symbol[at], after[at], alive[gone], rank[gone] = r, follows, False, _NONE
            has = follows >= 0
            before[follows[has]] = at[has]
            rank[at[~has]] = _NONE
            left = before[at]
            left = left[left >= 0]
            changed = np.concatenate([at[has], left])
            rank[changed] = self.pair(symbol[changed], symbol[after[changed]])
            push(changed)
        return symbol[alive].astype(np.uint32), np.bincount(owner[alive], minlength=len(pieces))


    def _turns(self, r: int, at: np.ndarray, owner: np.ndarray, symbol: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Indexes in ``at`` of the first place in each pre-token whose merge, from the left, makes a pair of a smaller rank."""
        gone = after[at]
        left, right = before[at], after[gone]
        beside = np.zeros(len(at), bool)
        beside[1:] = left[1:] == gone[:-1]  # merged just before
        smaller = np.zeros(len(at), bool)
        for has, a, b in ((left >= 0, np.where(beside, r, symbol[left]), r), (right >= 0, r, symbol[right])):
            found = self.pair(*np.broadcast_arrays(np.asarray(a, np.int64), np.asarray(b, np.int64)))
            smaller |= has & (found >= 0) & (found < r)
        ends = np.flatnonzero(smaller)
        return ends[np.flatnonzero(np.diff(owner[at[ends]], prepend=-1))]


_RANKS: dict[str, tuple[Ranks, ChunkTable]] = {}


def encoder(path: str) -> tuple[Ranks, ChunkTable]:
    """The worker's ranks of a file, and its table of chunks."""
    if path not in _RANKS:
        ranks = Ranks(path)

        def encode(pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
            return ranks.encode([p.encode() for p in pretokens])

        _RANKS[path] = ranks, ChunkTable(by_pretoken(encode))
    return _RANKS[path]


def encode_texts(docs: DataFrame, ranks: str, text_col: str = "text") -> DataFrame:
    """``docs`` with column ids: the ids of each text, as array<int>.

    Special strings are ordinary text. A null or empty text has no ids. All other columns
    are kept (one named ids is replaced); repeated rows stay; an empty table stays empty.
    """
    return _encoded(docs, ranks, text_col, "ids array<int>", lambda ids, _: pa.array(ids, pa.list_(pa.int32())), "ids")


def _encoded(docs: DataFrame, ranks: str, text_col: str, field: str, make, name: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in (text_col, name)]
    rows = docs.select(F.struct(*rest).alias("own"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = encoder(ranks)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in slices(texts, [len(t) for t in texts], 24 << 20):
                made = make(table.ids(texts[part]), known)
                yield pa.RecordBatch.from_arrays([batch.column("own").slice(part.start, part.stop - part.start), made], ["own", name])

    out = rows.mapInArrow(run, f"own {rows.schema['own'].dataType.simpleString()}, {field}")
    return out.select(*[F.col("own")[c].alias(c) for c in rest], name)


def decode(ids: np.ndarray, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def digests(docs: DataFrame, ranks: str, text_col: str = "text") -> DataFrame:
    """Encode and decode each text: struct coded (n_tokens, ids_sha256, decoded_sha256).

    Nulls, empty texts, repeated rows and other columns as in ``encode_texts``.
    """

    def make(every: Iterator[np.ndarray], known: Ranks) -> pa.Array:
        out = [(len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode(ids, known.tokens)).hexdigest()) for ids in every]
        n, a, b = zip(*out, strict=True)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, ranks, text_col, "coded struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>", make, "coded")


def op4_rank_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document as digests; nulls, repeated rows and empty tables as in ``encode_texts``."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).select("doc_id", "coded.*")

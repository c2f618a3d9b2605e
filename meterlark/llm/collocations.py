"""Phrase collocations by weighted acyclic automata over the n-grams of whole tables.

A ``Counts`` automaton maps label sequences (language, word, word, ...) to counts: every arc carries the
count of the sequence that ends with it, and states with equal arcs are one. Each task builds automata
of its shard from sorted n-grams, one for each range of hashed prefixes; the ranges are exchanged, the
automata of a range are united and their weights summed, and n-grams that are too rare go. Parts of a
phrase are looked up where their range lies: the phrases of a range send an automaton of the parts they
ask for, and it is composed with the automaton of the counts there.

Three scans: words, then pairs of words that are frequent, then triples of pairs that are. A triple
cannot be frequent unless its pairs are, so nothing is lost; what a scan knows of the one before is a
bitmap of 2^24 bits (false positives only cost work). A hot language, word or pair costs one row a task.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents

#: Labels of a sequence at most: a language and three words.
DEPTH = 4
#: Bits of the bitmaps that name frequent words and pairs.
BITMAP = 24
#: Tokens that a task counts before it hands on the automata of what it has.
HELD = 2_000_000
#: Tokens of one range, about; words with more than 1/HEAVY of all tokens are dealt by their second word too.
RANGE, HEAVY = 1 << 19, 10_000
#: Tokens whose pairs are looked up at once, and ranges whose automata a task hands on at once.
SLICE, SENT = 250_000, 32
#: Ranges whose phrases ask for their parts together.
GROUP = 16
# Bytes that end a piece, and the case of A to Z.
ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(ENDS))
_BLANK, _BREAK = -2, -1
_GAP = np.array([_BREAK], np.int32)


def summed(grams: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of ``grams`` (n x DEPTH label numbers, -1 after the last) with the sums of their weights."""
    if not len(grams):
        return grams, weights
    packed = [(grams[:, i] + 1 << 32) | (grams[:, i + 1] + 1) for i in range(0, DEPTH, 2)]
    order = np.lexsort(packed[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(p[order]) != 0 for p in packed], axis=0)
    return grams[order[new]], np.add.reduceat(weights[order], np.flatnonzero(new))


class Counts:
    """A minimal weighted automaton. ``words``: sorted labels; state s has the arcs first[s] to
    first[s + 1] of ``label``, ``weight`` and ``target``; state 0 has no arcs, the last state is the start."""

    def __init__(self, words: list[bytes], first: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray):
        self.words, self.first, self.label, self.weight, self.target = words, first, label, weight, target

    @classmethod
    def build(cls, words: list[bytes], grams: np.ndarray, weights: np.ndarray) -> Counts:
        """From sorted distinct sequences of numbers of sorted ``words``; states are registered from the last labels up."""
        n = len(grams)
        register: dict[bytes, int] = {b"": 0}
        first, arcs = [0, 0], []
        total = 0
        # Which rows begin a new prefix of d + 1 labels.
        new = np.zeros((DEPTH, n), bool)
        differs = np.zeros(n, bool)
        if n:
            differs[0] = True
        for d in range(DEPTH):
            if n:
                differs[1:] |= grams[1:, d] != grams[:-1, d]
            new[d] = differs & (grams[:, d] >= 0)
        below: np.ndarray | None = None  # for each prefix of the deeper level: its place among the rows; and its state
        states: np.ndarray | None = None
        kind = np.dtype([("label", "<i4"), ("target", "<i4"), ("weight", "<i8")])
        for d in reversed(range(DEPTH)):
            at = np.flatnonzero(new[d])
            arc = np.zeros(len(at), kind)
            arc["label"] = grams[at, d]
            ends = grams[at, d + 1] < 0 if d + 1 < DEPTH else np.ones(len(at), bool)
            arc["weight"] = np.where(ends, weights[at], 0)
            if below is not None and len(below):
                owner = np.searchsorted(at, below, "right") - 1
                arc["target"][owner] = states  # every state of the deeper level has one owner
            # A state for each prefix of d labels: the run of its arcs.
            starts = np.flatnonzero(new[d - 1]) if d else np.zeros(1, np.int64)
            group = np.searchsorted(starts, at, "right") - 1
            heads = np.flatnonzero(np.diff(group, prepend=-1)) if len(at) else np.zeros(0, np.int64)
            found = np.empty(len(heads), np.int32)
            bounds = [*heads.tolist(), len(at)]
            for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                key = arc[a:b].tobytes()
                state = register.get(key)
                if state is None or d == 0:
                    state = register[key] = len(first) - 1
                    arcs.append(key)
                    total += b - a
                    first.append(total)
                found[i] = state
            below, states = starts[group[heads]] if len(heads) else np.zeros(0, np.int64), found
        table = np.frombuffer(b"".join(arcs), kind)
        return cls(words, np.array(first, np.int64), table["label"].copy(), table["weight"].copy(), table["target"].copy())

    @classmethod
    def of(cls, labels: np.ndarray, weights: np.ndarray, words: list[bytes]) -> Counts:
        """From any sequences of numbers of any ``words``: numbers are made to sort as the words do, weights summed."""
        used = np.unique(labels[labels >= 0])
        ranked, rank = _ranked([words[i] for i in used.tolist()])
        own = np.full(len(words) + 1, -1, np.int64)
        own[used] = rank[:-1]
        grams, weights = summed(own[labels], weights)
        return cls.build(ranked, grams, weights)

    def sequences(self, in_order: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Every sequence with a weight and the weights, sorted unless any order will do."""
        rows, states = np.full((1, DEPTH), -1, np.int64), np.array([len(self.first) - 2])
        out, counts = [], []
        for d in range(DEPTH):
            n = self.first[states + 1] - self.first[states]
            owner = np.repeat(np.arange(len(states)), n)
            at = np.repeat(self.first[states] - np.cumsum(n) + n, n) + np.arange(len(owner))
            rows = rows[owner]
            rows[:, d] = self.label[at]
            states, weight = self.target[at], self.weight[at]
            out.append(rows[weight > 0])
            counts.append(weight[weight > 0])
        found, weights = np.concatenate(out), np.concatenate(counts)
        return summed(found, weights) if in_order else (found, weights)

    @staticmethod
    def union(parts: list[Counts], least: int = 1) -> Counts:
        """One automaton of all sequences, their weights summed, without those below ``least``."""
        whole = Union()
        for part in parts:
            whole.add(part)
        return whole.result(least)

    def compose(self, counts: Counts) -> np.ndarray:
        """The weights that ``counts`` has for this automaton's sequences, in their order (0 where it has none)."""
        grams, _ = self.sequences()
        index = {w: i for i, w in enumerate(counts.words)}
        own = np.array([index.get(w, -2) for w in self.words] + [-1], np.int64)
        grams = own[grams]
        states, weight = np.full(len(grams), len(counts.first) - 2), np.zeros(len(grams), np.int64)
        alive = np.ones(len(grams), bool)
        width = len(counts.words) + 1
        owner = np.repeat(np.arange(len(counts.first) - 1), np.diff(counts.first))
        keys = owner * width + counts.label
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        for d in range(DEPTH):
            step = alive & (grams[:, d] != -1)
            at = np.searchsorted(keys, states * width + grams[:, d])
            hit = step & (grams[:, d] >= 0) & (at < len(keys))
            hit[hit] = keys[at[hit]] == (states * width + grams[:, d])[hit]
            arc = order[at[hit]]
            weight[hit], states[hit] = counts.weight[arc], counts.target[arc]
            weight[step & ~hit] = 0
            alive &= hit | ~step
        return weight

    def dump(self) -> bytes:
        lengths = np.array([len(w) for w in self.words], "<i4")
        head = np.array([len(self.words), len(self.first), len(self.label)], "<i8")
        arrays = (self.first.astype("<i8"), self.label.astype("<i4"), self.weight.astype("<i8"), self.target.astype("<i4"))
        return b"".join([head.tobytes(), lengths.tobytes(), *[a.tobytes() for a in arrays], *self.words])

    @classmethod
    def load(cls, data: bytes) -> Counts:
        n, states, arcs = np.frombuffer(data, "<i8", 3).tolist()
        at, out = 24, []
        for kind, size in (("<i4", n), ("<i8", states), ("<i4", arcs), ("<i8", arcs), ("<i4", arcs)):
            out.append(np.frombuffer(data, kind, size, at))
            at += out[-1].nbytes
        lengths, first, label, weight, target = out
        ends = (at + np.cumsum(lengths)).tolist()
        words = [data[a:b] for a, b in zip([at, *ends[:-1]], ends, strict=True)] if n else []
        return cls(words, first, label, weight, target)

    def items(self) -> Iterator[tuple[tuple[bytes, ...], int]]:
        grams, weights = self.sequences()
        for row, w in zip(grams.tolist(), weights.tolist(), strict=True):
            yield tuple(self.words[i] for i in row if i >= 0), w


class Union:
    """Sequences of automata under union, as sorted rows; its size follows the distinct sequences, not the parts."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.rows, self.weights = [np.zeros((0, DEPTH), np.int64)], [np.zeros(0, np.int64)]
        self.fresh = 0

    def add(self, part: Counts) -> None:
        grams, weights = part.sequences(False)
        number = self.number
        own = np.array([number.setdefault(w, len(number)) for w in part.words] + [-1], np.int64)
        self.rows.append(own[grams])
        self.weights.append(weights)
        self.fresh += len(grams)
        if self.fresh > max(1 << 18, len(self.rows[0])):
            self._sum()

    def _sum(self) -> None:
        rows, weights = summed(np.concatenate(self.rows), np.concatenate(self.weights))
        self.rows, self.weights, self.fresh = [rows], [weights], 0

    def result(self, least: int) -> Counts:
        self._sum()
        keep = self.weights[0] >= least
        return Counts.of(self.rows[0][keep], self.weights[0][keep], list(self.number))


# Hashes of words and sequences; numpy's numbers wrap.


def _hash(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def _mixed(hashes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """A hash of each row's labels."""
    out = np.zeros(len(labels), np.uint64)
    for column in labels.T:
        out = (out ^ np.where(column >= 0, hashes[column] if len(hashes) else 0, 0).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class _Deal:
    """Range of a sequence: by the hash of (language, first word), for heavy ones with the second word."""

    def __init__(self, ranges: int, heavy: list[tuple[bytes, bytes]]):
        self.ranges, self.heavy = ranges, set(heavy)

    def __call__(self, words: list[bytes], grams: np.ndarray) -> np.ndarray:
        hashes = _hash(words)
        prefix = grams[:, :3].copy()
        index = {w: i for i, w in enumerate(words)}
        heavy = [index[a] << 32 | index[b] for a, b in self.heavy if a in index and b in index]
        prefix[~np.isin(prefix[:, 0] << 32 | prefix[:, 1], heavy), 2] = -1
        return (_mixed(hashes, prefix) >> np.uint64(40)).astype(np.int64) * self.ranges >> 24

    def split(self, words: list[bytes], grams: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, Counts]]:
        """The automata of each range, from sorted distinct sequences of sorted words."""
        ranges = self(words, grams)
        order = np.argsort(ranges, kind="stable")
        heads = np.flatnonzero(np.diff(ranges[order], prepend=-1))
        own = np.full(len(words) + 1, -1, np.int64)
        for part in np.split(order, heads[1:]) if len(order) else []:
            rows = grams[part]
            seen = np.zeros(len(words) + 1, bool)
            seen[rows] = True
            used = np.flatnonzero(seen[:-1])
            own[used] = np.arange(len(used))
            yield int(ranges[part[0]]), Counts.build([words[i] for i in used.tolist()], own[rows], weights[part])


def _bit(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


class _Words(dict):
    """Numbers of words; only those of the bitmap get one of their own, others break phrases."""

    def __init__(self, lang: bytes, bitmap: np.ndarray | None, bits: int):
        super().__init__({b"": _BLANK, b"\n": _BREAK})
        self.bitmap, self.shift, self.known = bitmap, 64 - bits, []
        self.seed = xxhash.xxh64_intdigest(lang)

    def __missing__(self, word: bytes) -> int:
        if self.bitmap is not None:
            bit = xxhash.xxh64_intdigest(word, seed=self.seed) >> self.shift
            if not self.bitmap[bit >> 3] >> (bit & 7) & 1:
                self[word] = _BREAK
                return _BREAK
        self[word] = number = len(self.known)
        self.known.append(word)
        return number


def numbers_of(text: str, words: dict[bytes, int]) -> np.ndarray:
    """A text's words as numbers, -1 between pieces and at both ends."""
    tokens = text.encode("utf-8", "surrogatepass").translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
    # itemgetter looks all of them up at once; with one it gives no tuple.
    found = np.frombuffer(array("i", itemgetter(*tokens, b"\n")(words)), np.int32)
    return np.concatenate([_GAP, found[found != _BLANK]])


def _shards(batches: Iterator[pd.DataFrame], bitmap: np.ndarray | None, most: int = HELD, bits: int = BITMAP) -> Iterator[list[tuple[bytes, _Words, np.ndarray]]]:
    """(language, words, numbers of all texts) of as many texts as hold ``most`` tokens."""
    held: dict[str, tuple[_Words, list]] = {}
    n = 0

    def taken():
        return [(lang.encode("utf-8", "surrogatepass"), words, np.concatenate(parts)) for lang, (words, parts) in held.items()]

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            if lang not in held:
                held[lang] = (_Words(lang.encode("utf-8", "surrogatepass"), bitmap, bits), [])
            words, parts = held[lang]
            parts.append(numbers_of(text, words))
            n += len(parts[-1])
            if n >= most:
                shard, held, n = taken(), {}, 0
                yield shard
    if held:
        yield taken()


def _bitmap(blobs: DataFrame, of, bits: int) -> np.ndarray:
    """Bytes of the bitmap of the hashes that ``of`` gives for batches of ``blobs``. 2 MB, whatever the input."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.unique(_bit(of(batch), bits))
            value = np.left_shift(np.int64(1), found & 63)
            word, first = np.unique(found >> 6, return_index=True)
            yield pd.DataFrame({"word": word, "bits": np.bitwise_or.reduceat(value, first) if len(found) else value})

    # At most 2^18 rows reach the driver, which the workers get as one array.
    rows = blobs.mapInPandas(words, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return table.view(np.uint8)


def _united(shards: DataFrame, least: int) -> DataFrame:
    """(range, blob): the automata of each range united, without what is rarer than ``least``.

    Rows come sorted by range; a task holds the distinct sequences of one range, whatever the number of shards.
    """

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, whole = None, Union()
        for batch in batches:
            for key, blob in zip(batch["range"].tolist(), batch["blob"], strict=True):
                if key != now and now is not None:
                    yield pd.DataFrame({"range": [now], "blob": [whole.result(least).dump()]})
                    whole = Union()
                now = key
                whole.add(Counts.load(blob))
        if now is not None:
            yield pd.DataFrame({"range": [now], "blob": [whole.result(least).dump()]})

    return cut(shards.repartition("range").sortWithinPartitions("range").mapInPandas(unite, "range int, blob binary"))


def _rows(found: Iterable[tuple[int, Counts]]) -> pd.DataFrame:
    rows = [(k, c.dump()) for k, c in found]
    return pd.DataFrame(rows, columns=["range", "blob"])


def _parts(words: tuple[bytes, ...]) -> list[tuple[tuple[bytes, ...], tuple[bytes, ...]]]:
    """Cuts of a phrase (language first) after each number of its words."""
    lang, rest = words[:1], words[1:]
    return [(lang + rest[:k], lang + rest[k:]) for k in range(1, len(rest))]


def _ranked(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """``words`` sorted, and the rank of each by its old number (-1 after the last, for -1)."""
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.full(len(words) + 1, -1, np.int64)
    rank[order] = np.arange(len(words))
    return [words[i] for i in order], rank


def _numbered(counts: dict[tuple[bytes, ...], int]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Sorted words, sorted sequences of their numbers, and the weights."""
    number: dict[bytes, int] = {}
    rows = np.full((len(counts), DEPTH), -1, np.int64)
    for i, s in enumerate(counts):
        for j, w in enumerate(s):
            rows[i, j] = number.setdefault(w, len(number))
    words, rank = _ranked(list(number))
    return words, *summed(rank[rows], np.array(list(counts.values()), np.int64))


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, cover: int = 50, held: int = HELD, size: int = RANGE, parts: int = HEAVY, bits: int = BITMAP) -> DataFrame:
    """Every phrase of two or three words that occurs ``least`` times in its language: (lang, phrase, a, l,
    r, n, score), without those whose words lie in a longer one that has ``cover`` percent of their count.

    l and r are the counts of the parts of the cut with the lowest floor(10^6 a^2 / (l r)), which is the
    score (the earliest of equal cuts); n counts all words of the language. A null language is ``und``, a
    null text has no words, repeated rows count each, an empty table gives no rows. All arithmetic is on
    whole numbers of any size. ``held``, ``size``, ``parts`` and ``bits`` (tokens of a shard and of a
    range, the share of a heavy word, bits of the bitmaps) change the work, not the result.
    """
    texts = _texts(docs, text_col, lang_col)
    context = docs.sparkSession.sparkContext

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard in _shards(batches, None, held, bits):
            for lang, words, numbers in shard:
                yield pd.DataFrame({"lang": lang.decode("utf-8", "surrogatepass"), "word": words.known, "n": np.bincount(numbers[numbers >= 0], minlength=len(words.known))})

    words = cut(texts.mapInPandas(counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # Fewer than ``parts`` words, whatever the input.
    heavy = [(r["lang"].encode("utf-8", "surrogatepass"), bytes(r["word"])) for r in words.where(F.col("n") > max(1, total // parts)).select("lang", "word").collect()]
    deal = context.broadcast(_Deal(min(1 << 16, max(256, total // size)), heavy))

    def word_hashes(batch: pd.DataFrame) -> np.ndarray:
        seeds = {x: xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in batch["lang"].unique()}
        return np.array([xxhash.xxh64_intdigest(w, seed=seeds[x]) for x, w in zip(batch["lang"], batch["word"], strict=True)], np.uint64)

    word_bits = context.broadcast(_bitmap(words.where(F.col("n") >= least), word_hashes, bits))

    def shard_grams(shard: list, length: int, pair_bits: np.ndarray | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Labels, sequences and counts of a shard: words and pairs (length 2), or triples (length 3)."""
        number: dict[bytes, int] = {}
        for lang, known, _ in shard:
            for w in (lang, *known.known):
                number.setdefault(w, len(number))
        labels, rank = _ranked(list(number))
        rows, weights = [], []
        for lang, known, numbers in shard:
            own = rank[[number[w] for w in known.known]] if known.known else np.zeros(0, np.int64)
            gap = numbers < 0
            pair = ~(gap[:-1] | gap[1:])
            if length == 2:
                at = np.flatnonzero(pair)
                # One number for both words: sorting it is what a shard does most.
                key, count = np.unique(own[numbers[at]] << 32 | own[numbers[at + 1]], return_counts=True)
                found = np.full((len(key) + len(own), DEPTH), -1, np.int64)
                found[: len(key), 1], found[: len(key), 2] = key >> 32, key & 0xFFFFFFFF
                found[len(key) :, 1] = own
                weights.append(np.concatenate([count, np.bincount(numbers[~gap], minlength=len(own))]))
            else:
                hashes = _hash([lang, *known.known])
                frequent = np.zeros(len(pair) + 1, bool)
                for low in range(0, len(pair), SLICE):  # a slice at a time, for memory
                    where = low + np.flatnonzero(pair[low : low + SLICE])
                    labelled = np.stack([np.zeros(len(where), np.int64), numbers[where] + 1, numbers[where + 1] + 1], 1)
                    bit = _bit(_mixed(hashes, labelled), bits)
                    frequent[where] = pair_bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1
                at = np.flatnonzero(frequent[:-1] & frequent[1:])
                found = np.full((len(at), DEPTH), -1, np.int64)
                for k in range(length):
                    found[:, k + 1] = own[numbers[at + k]]
                weights.append(np.ones(len(at), np.int64))
            found[:, 0] = rank[number[lang]]
            rows.append(found)
        return labels, *summed(np.concatenate(rows), np.concatenate(weights))

    def grams(length: int, pairs) -> DataFrame:
        def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # Triples are few: a shard of them may have more tokens, and so its automata more in common.
            for shard in _shards(batches, word_bits.value, held * (length - 1), bits):
                labels, rows, weights = shard_grams(shard, length, pairs.value if pairs else None)
                found = deal.value.split(labels, rows, weights)
                while part := list(islice(found, SENT)):
                    yield _rows(part)

        return _united(texts.mapInPandas(shards, "range int, blob binary"), least)

    pairs = grams(2, None)

    def pair_hashes(batch: pd.DataFrame) -> np.ndarray:
        out = [np.zeros(0, np.uint64)]
        for blob in batch["blob"]:
            counts = Counts.load(blob)
            rows, _ = counts.sequences()
            out.append(_mixed(_hash(counts.words), rows[rows[:, 2] >= 0][:, :3]))
        return np.concatenate(out)

    pair_bits = context.broadcast(_bitmap(pairs, pair_hashes, bits))
    triples = grams(3, pair_bits)

    # The phrases of a group of ranges ask for their parts where those lie: the weight of a part is one
    # more than the largest count of a longer phrase that holds it.
    groups = max(1, deal.value.ranges // GROUP)
    both = cut(pairs.unionByName(triples).withColumn("group", F.col("range") % groups))

    def ask(found: pd.DataFrame) -> pd.DataFrame:
        asked: dict[tuple[bytes, ...], int] = {}
        for blob in found["blob"]:
            for words, a in Counts.load(blob).items():
                for cut_ in _parts(words):
                    for part in cut_:
                        asked[part] = max(asked.get(part, 1), a + 1 if len(part) == 3 else 1)
        sent = deal.value.split(*_numbered(asked))
        return pd.DataFrame([(target, found["group"].iloc[0], c.dump()) for target, c in sent], columns=["range", "group", "blob"])

    requests = both.groupBy("group").applyInPandas(ask, "range int, group int, blob binary")

    def answer(asked: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        """To each group the counts of its parts; to the range's own the counts of the longest phrases over its pairs."""
        columns = ["group", "cover", "blob"]
        if asked.empty or counts.empty:
            return pd.DataFrame(columns=columns)
        whole, out, longest = Counts.load(counts["blob"].iloc[0]), [], {}
        for group, blob in zip(asked["group"].tolist(), asked["blob"], strict=True):
            part = Counts.load(blob)
            rows, _ = part.sequences()
            out.append((group, False, Counts.of(rows, part.compose(whole), part.words).dump()))
            for words, a in part.items():
                if a > 1:
                    longest[words] = max(longest.get(words, 0), a - 1)
        covers = Counts.build(*_numbered(longest))
        out.append((int(counts["range"].iloc[0]) % groups, True, covers.dump()))
        return pd.DataFrame(out, columns=columns)

    answers = requests.groupBy("range").cogroup(pairs.groupBy("range")).applyInPandas(answer, "group int, cover boolean, blob binary")

    def score(found: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        count: dict[tuple[bytes, ...], int] = {}
        longest: dict[tuple[bytes, ...], int] = {}
        for is_cover, blob in zip(told["cover"], told["blob"], strict=True):
            (longest if is_cover else count).update(Counts.load(blob).items())
        rows = []
        for blob in found["blob"]:
            for words, a in Counts.load(blob).items():
                if len(words) < 3 or 100 * longest.get(words, 0) >= cover * a:
                    continue
                cuts = [(count[x], count[y]) for x, y in _parts(words)]
                best, left, right = min(((10**6 * a * a // (x * y), x, y) for x, y in cuts), key=lambda c: c[0])
                lang, phrase = words[0], b" ".join(words[1:])
                rows.append((lang.decode("utf-8", "surrogatepass"), phrase.decode("utf-8", "surrogatepass"), a, left, right, best))
        return pd.DataFrame(rows, columns=["lang", "phrase", "a", "l", "r", "score"])

    scored = both.groupBy("group").cogroup(answers.groupBy("group")).applyInPandas(score, "lang string, phrase string, a long, l long, r long, score long")
    return cut(scored).join(sizes, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def op12_count_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language by score, count and text; nulls, repeated rows and empty tables as in ``phrases``."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = phrases(documents(spark, sf_dir)).withColumn("rank", F.row_number().over(order)).where("rank <= 2000")
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda w: w <> '') AS ws
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), g AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
  FROM pieces, range(1, 4) s(k), unnest(range(1, len(ws) - k + 2)) p(i)
), f AS (
  SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(c) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND c >= 10
), cuts AS (
  SELECT lang, phrase, a, j, array_to_string(ws[1 : j], ' ') AS x, array_to_string(ws[j + 1 : k], ' ') AS y FROM c, range(1, 3) s(j) WHERE j < k
), scored AS (
  SELECT cuts.*, x.c AS l, y.c AS r, CAST(1000000 AS HUGEINT) * a * a // (CAST(x.c AS HUGEINT) * y.c) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.y
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), over AS (
  SELECT lang, unnest([array_to_string(ws[1 : 2], ' '), array_to_string(ws[2 : 3], ' ')]) AS phrase, a AS longer FROM c WHERE k = 3
), kept AS (
  SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM over WHERE over.lang = best.lang AND over.phrase = best.phrase AND 100 * longer >= 50 * a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

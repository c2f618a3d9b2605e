"""Token ids by chunks between single spaces, remembered within a worker.

A single space between two characters that are not white space always starts a
pre-token of the public pattern, whatever stands around it: no alternative of the
pattern has a space other than as its first character, save runs of white space, and
the special token of the vocabulary holds no space. So the ids of a text are the ids
of its chunks in a row, and each distinct chunk needs to be encoded once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import regex

#: White space other than the space and the line feed, as str.isspace has it.
_OTHER = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: A stable boundary: the space of this match.
STABLE = re.compile(r"(?<=\S) (?=\S)")

Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def split_chunks(text: str) -> list[str]:
    """Chunks of a text, each but the first without the space that it starts with."""
    pieces = text.split(" ")
    # Without white space beside a space every space is a boundary; plain searches are fastest.
    odd = text[:1] == " " or text[-1:] == " " or "  " in text or "\n " in text or " \n" in text
    if not odd and not any(c in text for c in _OTHER):
        return pieces
    out, held = [], [pieces[0]]
    for before, piece in zip(pieces, pieces[1:], strict=False):
        if piece and before and not piece[0].isspace() and not before[-1].isspace():
            out.append(" ".join(held))
            held = [piece]
        else:
            held.append(piece)
    out.append(" ".join(held))
    return out


def parts(text: str, most: int = 1 << 20) -> Iterator[str]:
    """A text cut at stable boundaries into parts of about ``most`` characters."""
    at = 0
    while len(text) - at > most and (m := STABLE.search(text, at + most)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class ChunkTable:
    """Ids of distinct chunks. ``encode`` turns strings into (all their ids, ids of each)."""

    def __init__(self, encode: Encode, most: int = 900_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        # Chunks after a space, and first chunks of texts; the ids of both in one array each.
        self.kinds = [[_Numbers(), np.empty(0, np.uint32), np.zeros(1, np.int64)] for _ in range(2)]

    def _learn(self) -> None:
        for kind, prefix in zip(self.kinds, (" ", ""), strict=True):
            numbers = kind[0]
            if numbers.new:
                ids, counts = self.encode([prefix + c for c in numbers.new])
                numbers.new = []
                kind[1] = np.concatenate([kind[1], ids.astype(np.uint32)])
                kind[2] = np.concatenate([kind[2], kind[2][-1] + np.cumsum(counts)])

    def _numbered(self, text: str) -> list[tuple[int, np.ndarray]]:
        found: list[tuple[int, np.ndarray]] = []
        for part in parts(text):
            # A later part begins with the space of its first chunk.
            pieces = split_chunks(part[1:] if found else part)
            rest = pieces if found else pieces[1:]
            head = -1 if found else self.kinds[1][0][pieces[0]]
            found.append((head, np.fromiter(map(self.kinds[0][0].__getitem__, rest), np.int32, len(rest))))
        return found

    def texts(self, texts: list[str]) -> list[list[tuple[int, np.ndarray]]]:
        """The numbers of the texts' chunks, once all their chunks are known."""
        if sum(len(k[0]) for k in self.kinds) > self.most:
            self._clear()
        numbered = [self._numbered(t) for t in texts]
        self._learn()
        return numbered

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        numbered = self.texts(texts)
        sizes = [np.diff(k[2]) for k in self.kinds]
        return np.array([sum((sizes[1][h] if h >= 0 else 0) + sizes[0][rest].sum() for h, rest in t) for t in numbered], np.int64)

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        numbered = self.texts(texts)
        (_, ids, ends), (_, first_ids, first_ends) = self.kinds
        for t in numbered:
            out = []
            for head, rest in t:
                if head >= 0:
                    out.append(first_ids[first_ends[head] : first_ends[head + 1]])
                out.append(gather(ids, ends[rest + 1], ends[rest + 1] - ends[rest]))
            yield np.concatenate(out)


def gather(ids: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``ids`` in runs: the ``counts[i]`` ids before ``ends[i]``, one run after the other."""
    stops = np.cumsum(counts)
    total = int(stops[-1]) if len(stops) else 0
    return ids[np.repeat(ends - stops, counts) + np.arange(total)]


def by_pretoken(encode: Encode, most: int = 600_000) -> Encode:
    """Encodes strings by their pre-tokens, each of which is encoded once."""
    pattern = regex.compile(public_tokenizers.PATTERN)
    numbers, ids, ends = _Numbers(), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def run(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        nonlocal numbers, ids, ends
        if len(numbers) > most:
            numbers, ids, ends = _Numbers(), np.empty(0, np.uint32), np.zeros(1, np.int64)
        rows = [pattern.findall(s) for s in strings]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((numbers[p] for row in rows for p in row), np.int64, int(sizes.sum()))
        if numbers.new:
            more, counts = encode(numbers.new)
            numbers.new = []
            ids, ends = np.concatenate([ids, more]), np.concatenate([ends, ends[-1] + np.cumsum(counts)])
        counts = ends[flat + 1] - ends[flat]
        before = np.concatenate([[0], np.cumsum(counts)])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return gather(ids, ends[flat + 1], counts), before[bounds[1:]] - before[bounds[:-1]]

    return run


def library_encode(path: str, most: int = 600_000) -> Encode:
    """The tokenizers library over pre-tokens, many at once, divided by the vocabulary's special token; some ``most`` are remembered."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    special = {i: t.content for i, t in library.get_added_tokens_decoder().items()}
    mark, between = max(special.items())

    def joined(pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = [between.join(pretokens[i : i + 1000]) + between for i in range(0, len(pretokens), 1000)]
        # A few texts at a time: the library's results are many times larger than the ids.
        found = [np.array(e.ids, np.uint32) for i in range(0, len(texts), 16) for e in library.encode_batch_fast(texts[i : i + 16], add_special_tokens=False)]
        row = np.concatenate(found)
        at = np.flatnonzero(row == mark)
        return np.delete(row, at), np.diff(at, prepend=-1) - 1

    plain = by_pretoken(joined, most)

    def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [i for i, x in enumerate(strings) if any(s in x for s in special.values())]
        if not odd:
            return plain(strings)
        # Only the library itself finds its special strings.
        marked = set(odd)
        ids, counts = plain([x for i, x in enumerate(strings) if i not in marked])
        rest = iter(np.split(ids, np.cumsum(counts)[:-1]))
        found = [np.array(library.encode(x, add_special_tokens=False).ids, np.uint32) if i in marked else next(rest) for i, x in enumerate(strings)]
        return np.concatenate(found), np.array([len(f) for f in found], np.int64)

    return encode


#: Chunks that a worker's table remembers: some 310 MB. A table of 100,000 takes a third of that and 1.7 times the CPU time.
KNOWN = 900_000

_TABLES: dict[tuple[str, int], ChunkTable] = {}


def library_table(path: str, known: int = KNOWN) -> ChunkTable:
    """The worker's table for a vocabulary file; tasks of one worker share it. It remembers some ``known`` chunks."""
    if (path, known) not in _TABLES:
        _TABLES[path, known] = ChunkTable(library_encode(path, known * 2 // 3), known)
    return _TABLES[path, known]


def slices(values: list, sizes: list[int], most: int = 8 << 20) -> Iterator[slice]:
    """Slices of a batch with about ``most`` in all of ``sizes``, so that memory doesn't follow the batch."""
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(values):
        yield slice(at, len(values))

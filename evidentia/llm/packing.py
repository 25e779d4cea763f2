"""Hierarchical packing of documents into windows of several context sizes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import _text as T

#: Context sizes, longest first. Each is a power of two.
TIERS = (2048, 1024, 512, 256)
#: Tokens of one step group.
STEP_TOKENS = 32_768
#: Bytes of text that are packed together in a task.
UNIT = 1 << 22
#: Distinct words whose tokens a worker remembers.
REMEMBERED = 2_000_000
#: Id after each document.
END = 1


class WordTokens:
    """Token ids of words, each distinct word tokenised once. Words end at white space, and so do the
    tokens of this kind of vocabulary, so a text's ids are the ids of its words.

    Words are remembered by a 64-bit hash, in sorted arrays; among REMEMBERED words two have the same
    hash with a probability of 1e-7.
    """

    #: A character that is a token of its own between spaces; words that hold it are tokenised alone.
    SEPARATOR = "\0"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        (self.separator,) = self.tokenizer.encode(self.SEPARATOR, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.begin = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _tokenise(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        found = self._whole(words)
        return np.array([x for y in found for x in y], dtype=np.uint32), np.array([len(x) for x in found], dtype=np.int64)

    def _whole(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, many words in one text."""
        out: list[list[int]] = []
        for k in range(0, len(words), 200):
            part = words[k : k + 200]
            joined = f" {self.SEPARATOR} ".join("" if self.SEPARATOR in w else w for w in part)
            ids = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids
            pieces: list[list[int]] = [[]]
            for x in ids:
                if x == self.separator:
                    pieces.append([])
                else:
                    pieces[-1].append(x)
            out += [self.tokenizer.encode(w, add_special_tokens=False).ids if self.SEPARATOR in w else x for w, x in zip(part, pieces, strict=True)]
        return out

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word where its ids begin in self.ids, and how many it has."""
        keys, first, which = np.unique(T.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > REMEMBERED:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            raw = data.tobytes()
            ids, count = [], []
            for k in range(0, len(fresh), 20_000):
                part = first[fresh[k : k + 20_000]]
                x, y = self._tokenise([raw[i:j].decode() for i, j in zip(starts[part].tolist(), ends[part].tolist(), strict=True)])
                ids.append(x)
                count.append(y)
            new = np.concatenate(count)
            begin = len(self.ids) + np.cumsum(new) - new
            self.ids = np.concatenate([self.ids, *ids])
            self.keys, self.begin, self.count = (np.insert(old, at[fresh], x) for old, x in ((self.keys, keys[fresh]), (self.begin, begin), (self.count, new)))
            at = np.searchsorted(self.keys, keys)
        return self.begin[at][which], self.count[at][which]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, END after each, and the bounds of each text's ids."""
        starts, ends, first = T.words(data, offsets)
        begin, count = self.places(data, starts, ends) if len(starts) else (np.zeros(0, dtype=np.int64),) * 2
        total = np.concatenate([[0], np.cumsum(count)])
        size = total[first[1:]] - total[first[:-1]] + 1
        at = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(at[-1], dtype=np.uint32)
        tokens = np.ones(at[-1], dtype=bool)
        tokens[at[1:] - 1] = False
        out[~tokens] = END
        out[tokens] = self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], count)]
        return out, at


class _Pool:
    """Pieces (text, start) by length; a bit mask finds the best length."""

    def __init__(self):
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.mask = 0

    def put(self, length: int, piece: tuple[int, int]) -> None:
        self.by.setdefault(length, []).append(piece)
        self.mask |= 1 << length

    def take(self, length: int) -> tuple[int, int]:
        rows = self.by[length]
        piece = rows.pop()
        if not rows:
            self.mask &= ~(1 << length)
        return piece

    def longest(self, most: int) -> int:
        """The longest length up to most, 0 if there is none."""
        return max(0, (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def shortest_over(self, length: int) -> int:
        rest = self.mask >> (length + 1)
        return (rest & -rest).bit_length() + length if rest else 0


def pack(sizes: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (context size, [(text, start, length)]) that hold each token of the texts once.

    Whole windows of the longest size are cut off first. What is left of each text goes to the tier of
    the smallest size that holds it. Windows are packed from the longest tier down: the gap of a
    window takes the longest pieces that fit, which come from shorter tiers, and then the head of a
    piece that doesn't fit; its rest goes back to its own tier. Only the last window may stay short;
    it is cut at powers of two, so that it needs no padding either.
    """
    pool, most = _Pool(), TIERS[0]
    for text, size in enumerate(sizes.tolist()):
        whole = size // most
        for k in range(whole):
            yield most, [(text, k * most, most)]
        if size % most:
            pool.put(size % most, (text, whole * most))
    for tier in TIERS:
        low = tier // 2 if tier != TIERS[-1] else 0
        while (length := pool.mask.bit_length() - 1) > low:
            window, gap = [(*pool.take(length), length)], tier - length
            while gap and pool.mask:
                if fits := pool.longest(gap):
                    window.append((*pool.take(fits), fits))
                    gap -= fits
                else:
                    over = pool.shortest_over(gap)
                    text, start = pool.take(over)
                    window.append((text, start, gap))
                    pool.put(over - gap, (text, start + gap))
                    gap = 0
            if gap:
                yield from _binary(window)
            else:
                yield tier, window


def _binary(window: list[tuple[int, int, int]]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """The pieces of a short window as sequences whose lengths are powers of two."""
    rest = list(reversed(window))
    left = sum(length for *_, length in window)
    while left:
        size = gap = 1 << (left.bit_length() - 1)
        out = []
        while gap:
            text, start, length = rest.pop()
            part = min(gap, length)
            out.append((text, start, part))
            if part < length:
                rest.append((text, start + part, length - part))
            gap -= part
        left -= size
        yield size, out


def step_groups(sequences: list[tuple[int, list[tuple[int, int, int]]]]) -> np.ndarray:
    """For each sequence the number of its step group. A group has sequences of one context size and
    about STEP_TOKENS tokens; sequences are dealt back and forth by the attention cost of their pieces,
    so that the groups of a size cost about the same."""
    context = np.array([size for size, _ in sequences])
    cost = np.array([sum(length * length for *_, length in pieces) for _, pieces in sequences])
    out, base = np.zeros(len(sequences), dtype=np.int64), 0
    for size in np.unique(context)[::-1]:
        mine = np.flatnonzero(context == size)
        groups = max(1, round(len(mine) * int(size) / STEP_TOKENS))
        order = mine[np.argsort(-cost[mine], kind="stable")]
        turn = np.arange(len(mine))
        lane = turn % groups
        out[order] = base + np.where(turn // groups % 2 == 0, lane, groups - 1 - lane)
        base += groups
    return out


_tokenizers: dict[str, WordTokens] = {}


def _packed(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokens(path)
        # numbers of different tasks don't meet: a task has fewer than 2**40 sequences
        sequence = step = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = T.flat(batch.column("text"))
            for i, j in T.slices(offsets, UNIT):
                ids, bounds = _tokenizers[path].encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size = np.diff(bounds)
                sequences = list(pack(size))
                groups = step_groups(sequences)
                rows = [(k, place, *piece, size_) for k, (size_, pieces) in enumerate(sequences) for place, piece in zip(_places(pieces), pieces, strict=True)]
                k, place, text, start, length, context = np.array(rows, dtype=np.int64).T
                low = bounds[text] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(low.tolist(), (low + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(text + i)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[text]),
                        pa.array(k + sequence), pa.array(place), pa.array(context), pa.array(groups[k] + step),
                    ],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step_id"],
                )
                sequence += len(sequences)
                step += int(groups.max()) + 1

    return run


def _places(pieces: list[tuple[int, int, int]]) -> list[int]:
    out, at = [], 0
    for *_, length in pieces:
        out.append(at)
        at += length
    return out


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Documents as pieces of sequences of at most TIERS[0] tokens, almost all full.

    docs: doc_id (long) and text; other columns are ignored. A document's ids are those of the
    tokenizer file (without its special tokens) and END. Null and empty texts are END alone. Rows that
    repeat an id, or have none, are documents of their own. Each partition of docs is packed where it
    is read, UNIT bytes of text at a time, so nothing is shuffled and no task holds more than a batch;
    each unit ends in at most one short window, cut at powers of two. No sequence needs padding.

    tokenizer is the path of a tokenizers file whose words end at white space; it must be at that
    path on every worker, as an installed package is.

    Returns one row per piece: doc_id, start, length, ids_crc32 (of unsigned little-endian 32-bit ids), doc_tokens, sequence_id,
    offset, context (size of the sequence's window), step_id (its step group).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context long, step_id long"
    return rows.mapInArrow(_packed(tokenizer), schema)

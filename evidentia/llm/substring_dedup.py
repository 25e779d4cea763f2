"""Repeated substrings: long byte strings anywhere (prefix-free parsing), and word passages after their first place (seed and extend)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._repeats import Slice, Windows, cut, identified, repeated_spans


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of set flags in each text."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[first[1:]] - total[first[:-1]]


def _binary(data: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(kind)


def _cut_bytes(s: Slice, removed: np.ndarray) -> list[pa.Array]:
    fresh = removed.copy()
    fresh[1:] &= ~removed[:-1]
    fresh[s.offsets[:-1][np.diff(s.offsets) > 0]] = removed[s.offsets[:-1][np.diff(s.offsets) > 0]]
    size, gone = np.diff(s.offsets), _per_text(removed, s.first)
    return [pa.array(size), pa.array(gone), pa.array(_per_text(fresh, s.first)), _binary(s.data[~removed], size - gone, pa.binary())]


def _cut_words(s: Slice, removed: np.ndarray) -> list[pa.Array]:
    kept = np.flatnonzero(~removed)
    text = np.searchsorted(s.first, kept, "right") - 1
    last = np.ones(len(kept), dtype=bool)
    last[:-1] = text[1:] != text[:-1]
    begin, end = s.starts[kept], s.ends[kept]
    # a kept word takes the byte after it along as its space, but for the last of its text
    change = np.bincount(begin, minlength=len(s.data) + 2) - np.bincount(end + ~last, minlength=len(s.data) + 2)
    data = s.data.copy()
    data[end[~last]] = 0x20
    size = np.bincount(text, weights=end - begin + ~last, minlength=len(s.offsets) - 1).astype(np.int64)
    body = data[np.cumsum(change[: len(data)]) > 0]
    return [pa.array(np.diff(s.first)), pa.array(_per_text(removed, s.first)), _binary(body, size, pa.binary())]


def remove_repeated_bytes(docs: DataFrame, length: int = 200, gram: int = 64) -> DataFrame:
    """Remove every byte that a string of `length` bytes covers which also starts anywhere else.

    Prefix-free parsing: rolling-hash triggers (the least gram of each window) cut texts into
    overlapping phrases; distinct phrases are a dictionary, and texts are sequences of its entries.
    Only what shares a trigger can be equal, so corpus order is never formed as a whole: phrases with
    one trigger are brought together, and their suffixes of the given length are compared there.

    docs needs doc_id (long) and text, read as UTF-8; other columns are ignored. Null texts count as
    empty. Texts shorter than the length lose nothing. Strings never cross documents; overlaps and
    repeats within a document count. Rows that repeat an id are separate documents.
    Returns one row per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary).
    """
    w = Windows(length, min(gram, length), of_words=False)
    rows, dealt = identified(docs)
    spans = repeated_spans(rows, dealt, w, earlier=False)
    return cut(dealt, spans, w, _cut_bytes, "n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeated_passages(docs: DataFrame, words: int = 20, anchor: int = 6) -> DataFrame:
    """Remove every word of a run of `words` words that also starts earlier in the corpus.

    Seed and extend: documents meet on winnowed anchors (the least gram of `anchor` words in each
    window). From an anchor the match extends both ways: phrases that are equal as a whole match to
    the ends of what the anchor serves, others are compared window by window; neighbouring matches
    join to maximal repeats.

    docs needs doc_id (long) and text; other columns are ignored. Earlier means a smaller doc_id, or
    the same and an earlier word. Words are runs of bytes other than space and \\x09-\\x0D, unchanged.
    Null and short texts lose nothing. Rows that repeat an id (or have none) are taken in the order of
    their texts, after smaller ids; null ids come first.
    Returns one row per row of docs: doc_id, n_words, n_removed, kept (binary: the kept words, joined by one space).
    """
    w = Windows(words, min(anchor, words), of_words=True)
    rows, dealt = identified(docs)
    spans = repeated_spans(rows, dealt, w, earlier=True)
    return cut(dealt, spans, w, _cut_words, "n_words long, n_removed long, kept binary")

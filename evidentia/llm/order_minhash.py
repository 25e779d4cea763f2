"""Order MinHash: fingerprints whose likeness follows the edit distance of texts.

A text's k-mers of code points are numbered by occurrence, so each is unique. For each of SAMPLES hash
functions the TUPLE numbered k-mers with the smallest values are selected; in the order in which they
stand in the text, their k-mers are hashed to one number of the fingerprint. Two texts agree on such a
number about as often as the selected k-mers are common to both and stand in the same order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._tables import materialise

KMER = 8
SAMPLES = 64
TUPLE = 2
#: Bytes of text handled at once in a task.
UNIT = 1 << 22

_rng = np.random.default_rng(11)
_FLIP = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]
_TIMES = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None] | np.uint32(1)
_SALT = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_POINTS = np.uint64(0xD6E8FEB86659FD93)


def numbered(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k-mers, and a 32-bit value for each k-mer with its number of occurrence."""
    n = len(grams)
    bits = np.uint64(max(1, int(n).bit_length()))
    if n < 1 << 24:  # the position rides in the low bits: one sort without an index
        keyed = np.sort(grams >> bits << bits | np.arange(n, dtype=np.uint64))
        at = (keyed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    else:
        at = np.argsort(grams, kind="stable")
    ordered = grams[at]
    edge = np.ones(n, dtype=bool)
    edge[1:] = ordered[1:] != ordered[:-1]
    begin = np.flatnonzero(edge)
    occurrence = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    return at, (T.mix(ordered + occurrence.astype(np.uint64) * T.MULTIPLIER) >> np.uint64(32)).astype(np.uint32)


def selected(values: np.ndarray) -> np.ndarray:
    """For each hash function the indices of its TUPLE least values (fewer if there are fewer)."""
    n = len(values)
    take = min(TUPLE, n)
    out = np.empty((SAMPLES, take), dtype=np.int64)
    step = max(1, (1 << 16) // n)
    for low in range(0, SAMPLES, step):
        hashed = (values ^ _FLIP[low : low + step]) * _TIMES[low : low + step]
        rows = np.arange(len(hashed))
        for k in range(take):
            out[low : low + step, k] = best = hashed.argmin(axis=1)
            hashed[rows, best] = np.uint32(0xFFFFFFFF)
    return out


def fingerprint(points: np.ndarray) -> np.ndarray:
    """SAMPLES 16-bit numbers of a text given as code points; a text shorter than a k-mer is one k-mer, an empty text none."""
    n = len(points)
    grams = T.rolling_grams((points.astype(np.uint64) + np.uint64(1)) * _POINTS, min(n, KMER)) if n else np.zeros(1, dtype=np.uint64)
    at, values = numbered(grams)
    chosen = np.sort(at[selected(values)], axis=1)
    found = _SALT.copy()
    for k in range(chosen.shape[1]):
        found = T.mix(found * T.MULTIPLIER + grams[chosen[:, k]])
    return (found >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / SAMPLES


def edited(own: np.ndarray, following: np.ndarray) -> np.ndarray:
    """own with its last half replaced by the start of the following text."""
    half = len(own) // 2
    return np.concatenate([own[: len(own) - half], following[:half]])


def _points(texts: pa.Array) -> Iterator[np.ndarray]:
    """Code points of each text, decoded a unit at a time; null counts as empty."""
    data, offsets = T.flat(texts)
    for i, j in T.slices(offsets, UNIT):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        points = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        count = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[own]
        for a, b in zip(count[:-1], count[1:], strict=True):
            yield points[a:b]


_OUT = "n_chars long, edited_sha256 string, print binary, edited_print binary, near_edited double, near_next double"


def _compared(own: np.ndarray, mark: np.ndarray, following: np.ndarray, next_mark: np.ndarray) -> tuple:
    new = edited(own, following)
    new_mark = fingerprint(new)
    digest = hashlib.sha256(new.tobytes().decode("utf-32-le").encode()).hexdigest()
    return len(own), digest, mark.tobytes(), new_mark.tobytes(), likeness(mark, new_mark), likeness(mark, next_mark)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[x for x, _ in fields])


_INSIDE = f"doc_id long, {_OUT}, part long, first_text string, last_text string"


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each text with the one after it in the partition. The first and last text go out too,
    for the comparison across partitions; the last has no other result yet."""
    part = TaskContext.get().partitionId()
    before = None
    nothing = (None,) * 6
    text_of = lambda p: p.tobytes().decode("utf-32-le")
    for batch in batches:
        out = []
        for doc_id, points in zip(batch.column("doc_id").to_pylist(), _points(batch.column("text")), strict=True):
            now = (doc_id, points, fingerprint(points))
            if before is None:
                out.append((None, *nothing, part, text_of(points), None))
            else:
                out.append((before[0], *_compared(before[1], before[2], now[1], now[2]), part, None, None))
            before = now
            if len(out) >= 2000:
                yield _rows(out, _INSIDE)
                out = []
        before = before and (before[0], before[1].copy(), before[2])
        if out:
            yield _rows(out, _INSIDE)
    if before is not None:
        yield _rows([(before[0], *nothing, part, None, text_of(before[1]))], _INSIDE)


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, own, following in zip(batch.column("doc_id").to_pylist(), _points(batch.column("last_text")), _points(batch.column("next_text")), strict=True):
            out.append((doc_id, *_compared(own, fingerprint(own), following, fingerprint(following))))
        if out:
            yield _rows(out, f"doc_id long, {_OUT}")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The next document follows in descending doc_id (null last; repeated ids in the order of their
    texts), after the last comes the first; a single document is its own next. The edited text has its
    last floor(n/2) code points replaced by as many from the start of the next text (or all of it).

    docs: doc_id (long) and text; other columns are ignored; null texts count as empty. Texts move
    once, dealt by ranges of doc_id; only the first and last text of each range move again.

    Returns one row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint
    (hex of SAMPLES 16-bit numbers), near_edited, near_next (share of equal numbers).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    # rows that share an id are dealt by the start of their texts
    dealt = rows.repartitionByRange(order[0], F.substring("text", 1, 16)).sortWithinPartitions(*order)
    found, _ = materialise(dealt.mapInArrow(_inside, _INSIDE))

    # one row for each range of ids: its first text, and its last document
    ends = found.where("first_text is not null or last_text is not null").select("part", "first_text", "last_text", "doc_id")
    ends = ends.groupBy("part").agg(F.max("first_text").alias("first_text"), F.max("last_text").alias("last_text"), F.max("doc_id").alias("doc_id"))
    ends, _ = materialise(ends)
    # only the numbers of the ranges are put in order; their texts meet by a join
    along = Window.orderBy("part")
    numbers = ends.select("part", F.coalesce(F.lead("part").over(along), F.first("part").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_part"))
    firsts = ends.select(F.col("part").alias("next_part"), F.col("first_text").alias("next_text"))
    across = ends.select("part", "doc_id", "last_text").join(numbers, "part").join(firsts, "next_part").select("doc_id", "last_text", "next_text")
    across = across.mapInArrow(_between, f"doc_id long, {_OUT}")

    done = found.where("first_text is null and last_text is null").drop("part", "first_text", "last_text").unionByName(across)
    return done.select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("print")).alias("fingerprint"), F.lower(F.hex("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next"
    )

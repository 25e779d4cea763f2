"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from . import _text as T

#: Lengths of the n-grams, in characters (code points) of the lower-cased text, and the buckets they are hashed to.
ORDERS = (1, 2, 3, 4)
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
#: Bytes of text that are handled at once.
PIECE = 1 << 17
#: Rows of a batch that are handled at once, and of them those whose counts are held as one dense matrix.
PART, BLOCK = 500, 64
#: Labels whose counts a task holds before it hands them on.
HELD = 64
#: So many rows of a typical language are added to what a language's own rows say of its likelihoods.
PRIOR = 10
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """Languages in order, log P(n-gram | language) as a matrix (languages x BUCKETS), and log P(language)."""

    langs: list[str]
    matrix: np.ndarray
    priors: np.ndarray


def points_of(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes."""
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)


def buckets(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order: the buckets of all n-grams of the points."""
    values = points.astype(np.uint64) + np.uint64(1)
    hashed = np.zeros(len(values) + 1, dtype=np.uint64)
    for order in range(1, max(ORDERS) + 1):
        n = max(0, len(values) - order + 1)
        hashed = T.mix(hashed[:n] * T.MULTIPLIER + values[order - 1 :])
        if order in ORDERS:
            yield order, (hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Piece:
    """Characters of the texts low to high of a batch, or a part of one long text."""

    low: int
    high: int
    points: np.ndarray
    #: Of each text in points; n-grams that begin at or after the last one are counted in the next part.
    offsets: np.ndarray
    more: int = 0

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each bucket occurs in each text (texts x BUCKETS), and how many n-grams a text has."""
        n = len(self.offsets) - 1
        size = np.diff(self.offsets)
        owner = np.repeat(np.arange(n), size)
        left = np.repeat(self.offsets[1:], size) + self.more - np.arange(self.offsets[-1])
        places = []
        for order, found in buckets(self.points):
            found += owner[: len(found)] * BUCKETS if self.more == 0 else 0
            places.append(found[np.flatnonzero(left[: len(found)] >= order)])
        out = np.bincount(np.concatenate(places), minlength=n * BUCKETS).reshape(n, BUCKETS)
        return out, out.sum(axis=1)


def pieces(texts: pa.Array) -> Iterator[Piece]:
    """Texts in pieces of bounded size. A very long text comes in several parts; each shows the characters
    that follow it, so that every n-gram is counted once, in the part in which it begins."""
    data, offsets = T.flat(pc.utf8_lower(texts.cast(pa.large_string())))
    lead = np.concatenate([(data & 0xC0) != 0x80, [True]])
    for i, j in T.slices(offsets, PIECE):
        low, high = int(offsets[i]), int(offsets[j])
        if high - low <= PIECE:
            for a in range(i, j, BLOCK):
                b = min(j, a + BLOCK)
                part = data[offsets[a] : offsets[b]]
                at = np.concatenate([[0], np.cumsum(lead[offsets[a] : offsets[b]])])[offsets[a : b + 1] - offsets[a]]
                yield Piece(a, b, points_of(part), at)
            continue
        while low < high:
            end = min(high, low + PIECE)
            while not lead[end]:
                end -= 1
            beyond = end
            for _ in range(max(ORDERS) - 1):
                if beyond < high:
                    beyond += 1
                    while not lead[beyond]:
                        beyond += 1
            points = points_of(data[low:beyond])
            more = int(lead[end:beyond].sum())
            yield Piece(i, j, points, np.array([0, len(points) - more]), more)
            low = end


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most PART rows, so that copies of texts in a task stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            yield batch.slice(at, PART)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n), and in bucket -1 the number of rows."""
    totals: dict[str, np.ndarray] = {}

    def done() -> Iterator[pa.RecordBatch]:
        for x, sums in totals.items():
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(used), pa.string()), pa.array(used - 1), pa.array(sums[used])], names=["lang", "bucket", "n"])
        totals.clear()

    for batch in _parts(batches):
        langs = batch.column("lang").to_pylist()
        for x in langs:
            if x not in totals and len(totals) >= HELD:
                yield from done()
            totals.setdefault(x, np.zeros(1 + BUCKETS, dtype=np.int64))[0] += 1
        for piece in pieces(batch.column("text")):
            counts, _ = piece.counts()
            for x, row in zip(langs[piece.low : piece.high], counts, strict=True):
                totals.setdefault(x, np.zeros(1 + BUCKETS, dtype=np.int64))[1:] += row
    yield from done()


def fit(labelled: DataFrame, smoothing: float = 0.5) -> Model:
    """The model of the labelled rows (text and lang; rows without one of them are left out).

    Every row is counted whole, in tasks. What comes to the driver is one row of at most BUCKETS sums for
    each label, whatever the number of rows; labels are not limited.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).toArrow().sort_by("lang")
    langs = found.column("lang").to_pylist()
    counts, rows_of = np.full((len(langs), BUCKETS), smoothing), np.zeros(len(langs))
    for k, (bucket, n) in enumerate(zip(found.column("bucket"), found.column("n"), strict=True)):
        bucket, n = np.array(bucket.values), np.array(n.values)
        counts[k, bucket[bucket >= 0]] += n[bucket >= 0]
        rows_of[k] = n[bucket < 0].sum()
    return Model(langs, np.log(counts / counts.sum(axis=1, keepdims=True)), np.log(rows_of / max(1.0, rows_of.sum())) if langs else rows_of)


def _score(langs: list[str], priors: np.ndarray, matrix):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = matrix.value.T.astype(np.float64)
        names = np.array([*langs, "und"], dtype=object)
        for batch in _parts(batches):
            n = batch.num_rows
            total, grams_of = np.zeros((n, max(1, len(langs)))), np.zeros(n, dtype=np.int64)
            if langs:
                for piece in pieces(batch.column("text")):
                    counts, grams = piece.counts()
                    total[piece.low : piece.high] += _product(counts, table)
                    grams_of[piece.low : piece.high] += grams
            judged = total + priors if langs else total
            best = judged.argmax(axis=1)
            score = 1 / np.exp(judged - judged.max(axis=1, keepdims=True)).sum(axis=1)
            known = np.array([bool(langs) and x is not None and _LETTER.search(x) is not None for x in batch.column("text").to_pylist()], dtype=bool)
            mean = total[np.arange(n), best] / np.maximum(grams_of, 1)
            best[~known] = len(langs)
            score[~known] = 0.0
            kept = batch.schema.names
            found = [pa.array(names[best], pa.string()), pa.array(score), pa.array(mean), pa.array(grams_of)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *found], names=[*kept, "lang_pred", "score", "likelihood", "grams"])

    return run


def _product(counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """counts times table over the buckets that occur at all; each text is summed in the order of the buckets, so its sum doesn't depend on its neighbours."""
    out = np.empty((len(counts), table.shape[1]))
    for k, row in enumerate(counts):
        used = np.flatnonzero(row)
        out[k] = row[used] @ table[used]
    return out


def identify(docs: DataFrame, model: Model, with_text: bool = False, **carry: Column) -> DataFrame:
    """The most probable language of each text: doc_id, text (with_text), what carry names, lang_pred, score, likelihood, grams.

    score is the posterior probability (0 to 1) of lang_pred. likelihood is the mean log P(n-gram | lang_pred)
    over the text's n-grams, grams their number: unlike score it says whether the text is in that language at
    all (see plausible). A text that is null or has no letter (Unicode category L) gets `und` and score 0, as
    does every text if nothing was learned. Of equally probable languages the first by name is taken.
    Only text is read for the prediction. Rows come back one for one: null or repeated ids stay.
    The matrix is broadcast: 4 bytes for each label and bucket. Texts of any length are scored whole, in pieces.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.matrix.astype(np.float32))
    # mapInArrow doesn't take names with dots
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c.alias(f"carried_{k}") for k, c in enumerate(carry.values())])
    score = _score(model.langs, model.priors, shared)
    found = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("likelihood", DoubleType()), StructField("grams", LongType())]
    out = rows.mapInArrow(score, StructType([*rows.schema.fields, *found])).toDF("doc_id", "text", *carry, *[f.name for f in found])
    return out if with_text else out.drop("text")


def expectations(labelled: DataFrame, model: Model) -> dict[str, tuple[float, float, float]]:
    """For each language: mean and variance of the likelihood of texts in it, and the variance of one n-gram's.

    labelled: doc_id, text and lang, of rows that took no part in the fit. Every one of them that is found in
    its own language counts; three sums for each language come to the driver. Languages of few rows lean on the others.
    """
    found = identify(labelled, model, label=F.col("lang").cast("string")).where("lang_pred = label")
    x = F.col("likelihood")
    sums = {r["lang_pred"]: (r["n"], r["s"], r["ss"]) for r in found.groupBy("lang_pred").agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss")).collect()}
    if not sums:
        return {}
    n, s, ss = np.array(list(sums.values())).sum(axis=0)
    mean, var = s / n, max(0.0, ss / n - (s / n) ** 2)
    out = {}
    for k, lang in enumerate(model.langs):
        n, s, ss = sums.get(lang, (0, 0.0, 0.0))
        own = (s + PRIOR * mean) / (n + PRIOR)
        spread = (ss - 2 * own * s + n * own**2 + PRIOR * (var + (mean - own) ** 2)) / (n + PRIOR)
        p = np.exp(model.matrix[k])
        out[lang] = (float(own), float(max(0.0, spread)), float((p * model.matrix[k] ** 2).sum() - (p * model.matrix[k]).sum() ** 2))
    return out


def plausible(expected: dict[str, tuple[float, float, float]], deviations: float) -> Column:
    """Whether a row of identify() is no further below its language's mean likelihood than so many standard
    deviations. Short texts vary more: an n-gram's variance over their number is added. True if nothing was learned."""
    if not expected:
        return F.lit(True)
    of = lambda k: F.create_map(*[F.lit(v) for lang, e in expected.items() for v in (lang, e[k])])[F.col("lang_pred")]
    floor = of(0) - F.lit(float(deviations)) * F.sqrt(of(1) + of(2) / F.greatest("grams", F.lit(1)))
    return F.coalesce(F.col("likelihood") >= floor, F.lit(False))


def held_out(doc_id: Column) -> Column:
    """Rows that take no part in the fit: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))

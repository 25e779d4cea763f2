"""Near-duplicate documents: MinHash bands for candidates, odd sketches to thin them, exact sets to decide.

A document's set holds its distinct word shingles. K MinHash samples of the set are cut into bands;
documents that agree on a band share a bucket. For the candidates a second set of MinHash samples, the
least shingle of each bin of the hash space, is folded into an odd sketch: each sample flips one bit,
so the XOR of two sketches has few bits where the sets are alike, and its population count estimates
how many samples differ. Sets of at most FINE_MOST shingles have bins so fine that each shingle is a
sample, so nothing is left to chance but the folding; larger sets have coarse bins, which keep the
sketch from filling up. Sets near the limit carry both, as their partners may lie beyond it.
Only pairs whose sizes and sketches leave the threshold possible are compared on their full sets.

Pairs within a bucket are not all formed. First each member meets the smallest id of its bucket; the
links found so far make components. Only buckets that still hold several components are looked at
again, in blocks of bounded size, and only pairs across components with close sketches come out, each
from the first bucket that its two documents share.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._components import components
from ._groups import whole_groups
from ._tables import materialise, small

#: 32 bands of 5 samples: a pair of similarity 0.8 shares no band with probability 3e-6.
BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
#: Bins of small and of large sets, as powers of two, and the most shingles of a small set.
FINE_BITS, COARSE_BITS = 40, 12
FINE_MOST = 1280
SKETCH_BITS = 2048
#: Words of a sketch: the number of samples, then the bits.
SKETCH_WORDS = 1 + SKETCH_BITS // 64
#: Standard deviations of sampling and of folding that a sketch may be off.
DEVIATIONS = 5
#: Documents in one block when a bucket is compared again.
BLOCK = 512
#: Bytes of text hashed at once in a task.
SLICE = 1 << 19

_rng = np.random.default_rng(7)
_LOW = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None] | np.uint32(1)
_HIGH = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None] | np.uint32(1)
_BAND_WEIGHTS = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def far_bits(threshold: float, n_a, n_b, s_a, s_b, bins, sqrt, exp, low, high):
    """The most bits in which the sketches of a pair at the threshold differ, given set sizes n, sample
    sizes s and the bins. Works on numpy arrays and on columns alike, with the functions that are passed."""
    t = threshold
    union = (n_a + n_b) / (1 + t)
    more = high(union - high(n_a, n_b), 0 * union)  # shingles of the union that the larger set lacks
    fresh = exp(-union / bins)  # share of them that fall into empty bins
    samples = high(s_a, s_b) + more * fresh  # bins that the union fills
    left = high(1 - samples / union, 0 * union)  # what sampling leaves out; 0 if the samples are the set
    spread = sqrt(samples * (t * (1 - t)) * left + t * t * more * (1 - fresh))
    differ = s_a + s_b - 2 * t * samples + 2 * DEVIATIONS * spread
    n = SKETCH_BITS
    # each differing sample flips one bit, so there are never more bits than samples that differ
    folded = low(sqrt(n / 4 * (1 - exp(-4 / n * differ))), differ * (2 / n) ** 0.5)
    return low(differ, n / 2 * (1 - exp(-2 / n * differ)) + DEVIATIONS * folded) + 1e-6


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = T.flat(texts, lower=True)
    for i, j in T.slices(offsets, SLICE):
        part = data[offsets[i] : offsets[j]]
        starts, ends, first = T.words(part, offsets[i : j + 1] - offsets[i])
        values = T.word_hashes(part, starts, ends)
        grams = T.run_hash(values, width)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:  # fewer words: the whole sequence
                yield T.run_hash(values[a:b], int(b - a))
            else:
                yield np.zeros(0, dtype=np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima of a non-empty set, taken in pieces that stay in the cache."""
    low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 1024):
        hashed = low[at : at + 1024] * _LOW
        hashed ^= high[at : at + 1024] * _HIGH
        np.minimum(out, hashed.min(axis=1), out=out)
    return out


def odd_sketch(shingles: np.ndarray, bin_bits: int) -> np.ndarray:
    """The number of samples of a sorted set, its least shingle in each bin, then their parity bitmap."""
    bins = shingles >> np.uint64(64 - bin_bits)
    first = np.ones(len(bins), dtype=bool)
    first[1:] = bins[1:] != bins[:-1]
    samples = T.mix(shingles[first] * T.MULTIPLIER)
    flips = np.bincount((samples % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.concatenate([[np.uint64(len(samples))], np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)])


def sketches_of(shingles: np.ndarray, threshold: float) -> list[np.ndarray]:
    """The fine sketch of a small set, then the coarse one of a set that may be alike to a large one."""
    n = len(shingles)
    fine = [odd_sketch(shingles, FINE_BITS)] if n <= FINE_MOST else []
    return fine + ([odd_sketch(shingles, COARSE_BITS)] if n >= FINE_MOST * threshold - 1 else [])


def band_keys(samples: np.ndarray) -> np.ndarray:
    grouped = samples.astype(np.uint64).reshape(len(samples), BANDS, ROWS)
    return T.mix((T.mix(grouped * _BAND_WEIGHTS) * _BAND_WEIGHTS[::-1]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.view(np.int64).ravel()), rows.shape[1]).cast(pa.list_(pa.int64()))


def _signatures(width: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n = part.num_rows
                size, one, two = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
                samples, sketch, ends = np.zeros((n, SAMPLES), dtype=np.uint32), [np.zeros(0, dtype=np.uint64)], np.zeros(n + 1, dtype=np.int32)
                for i, s in enumerate(shingle_sets(part.column("text"), width)):
                    size[i] = len(s)
                    if len(s):
                        samples[i] = minhash(s)
                        sketch += sketches_of(s, threshold)
                        one[i], two[i] = s.sum(dtype=np.uint64), T.mix(s).sum(dtype=np.uint64)
                    ends[i + 1] = (len(sketch) - 1) * SKETCH_WORDS
                words = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sketch).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), words, _lists(band_keys(samples))],
                    names=["doc_id", "n_shingles", "s1", "s2", "sketch", "bands"],
                )

    return run


def _possible(threshold: float) -> Column:
    """Whether sizes and sketches of the columns x and y (structs size, sketch) leave the threshold possible."""
    x, y = F.col("x"), F.col("y")
    fine = F.greatest(x["size"], y["size"]) <= FINE_MOST

    def bits(side: Column) -> Column:  # the fine sketch comes first, the coarse one last
        return F.slice(side["sketch"], F.when(fine, F.lit(2)).otherwise(F.lit(1 - SKETCH_WORDS)), F.lit(SKETCH_WORDS - 1))

    def samples(side: Column) -> Column:
        return F.element_at(side["sketch"], F.when(fine, F.lit(1)).otherwise(F.lit(-SKETCH_WORDS)))

    far = F.aggregate(F.zip_with(bits(x), bits(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, more: n + more)
    bins = F.when(fine, F.lit(2.0**FINE_BITS)).otherwise(F.lit(2.0**COARSE_BITS))
    most = far_bits(threshold, x["size"], y["size"], samples(x), samples(y), bins, F.sqrt, F.exp, F.least, F.greatest)
    return (F.least(x["size"], y["size"]) >= F.greatest(x["size"], y["size"]) * (threshold - 1e-9)) & (far <= most)


def _verify(width: int, threshold: Fraction):
    over, under = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = shingle_sets(batch.column("text_a"), width), shingle_sets(batch.column("text_b"), width)
            good = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                small_, large = (x, y) if len(x) <= len(y) else (y, x)
                if not len(small_):
                    continue
                at = np.minimum(np.searchsorted(large, small_), len(large) - 1)
                common = int((large[at] == small_).sum())
                good[i] = under * common >= over * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _verified(docs: DataFrame, pairs: DataFrame, n_pairs: int, width: int, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. Only texts of documents in pairs move."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = docs.select("doc_id", "text").join(small(ids, 2 * n_pairs, 8), "doc_id", "left_semi")
    joined = (
        pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return joined.mapInArrow(_verify(width, threshold), "a long, b long")


def _across(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, starts in whole_groups(batches, ["key", "i", "j"]):
            doc, root, home, key, i_, j_, size = (group.column(c).to_numpy() for c in ("doc_id", "root", "home", "key", "i", "j", "size"))
            bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(doc), BANDS)
            lists = group.column("sketch").combine_chunks()
            ends, words = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().view(np.uint64)
            for a, b in zip(starts, [*starts[1:], len(doc)], strict=True):
                mine = np.flatnonzero(home[a:b] == i_[a]) + a
                theirs = np.flatnonzero(home[a:b] == j_[a]) + a
                small_, large = np.minimum.outer(size[mine], size[theirs]), np.maximum.outer(size[mine], size[theirs])
                x, y = np.nonzero((small_ >= large * (threshold - 1e-9)) & (root[mine][:, None] != root[theirs][None, :]))
                x, y = mine[x], theirs[y]
                if i_[a] == j_[a]:
                    once = doc[x] < doc[y]
                    x, y = x[once], y[once]
                fine = np.maximum(size[x], size[y]) <= FINE_MOST
                p, q = (np.where(fine, ends[z], ends[z + 1] - SKETCH_WORDS) for z in (x, y))
                far = np.zeros(len(x), dtype=np.int64)
                for w in range(1, SKETCH_WORDS):
                    far += np.bitwise_count(words[p + w] ^ words[q + w])
                bins = np.where(fine, 2.0**FINE_BITS, 2.0**COARSE_BITS)
                good = far <= far_bits(threshold, size[x], size[y], words[p].astype(np.int64), words[q].astype(np.int64), bins, np.sqrt, np.exp, np.minimum, np.maximum)
                x, y = x[good], y[good]
                shared = bands[x] == bands[y]
                good = shared.any(axis=1) & (bands[x, shared.argmax(axis=1)] == key[a])  # one bucket for each pair
                x, y = doc[x[good]], doc[y[good]]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of the threshold or more.

    docs needs doc_id (long) and text; other columns are ignored, whatever their names. Words are
    runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased; a text of fewer words than
    the shingle is one shingle of all its words. Null texts and texts without words have an empty
    set, are linked with nothing and keep their own id.

    Returns one row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable),
    kept (doc_id = component_id). Repeated rows are all returned; where an id stands on several rows,
    a link of one of them counts for all. A null id takes part only through equal sets. An empty
    table gives an empty result.
    """
    limit = Fraction(threshold).limit_denominator(10_000)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed, _ = materialise(source.mapInArrow(_signatures(shingle, float(threshold)), "doc_id long, n_shingles long, s1 long, s2 long, sketch array<long>, bands array<long>"))

    # documents with equal sets are one class, represented by its smallest id
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("sketch", "bands"), "doc_id").alias("sig"))
    reps, _ = materialise(classes.where("rep is not null").select("rep", F.struct(F.col("n_shingles").alias("size"), "sig.sketch").alias("sig"), "sig.bands"))

    members = reps.select("rep", F.explode("bands").alias("key"))
    hubs = members.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets, _ = materialise(members.join(hubs, "key").select("key", "rep", "hub"))
    sketches = reps.select("rep", "sig")
    pairs = buckets.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = (
        pairs.join(sketches.select(F.col("rep").alias("a"), F.col("sig").alias("x")), "a")
        .join(sketches.select(F.col("rep").alias("b"), F.col("sig").alias("y")), "b")
        .where(_possible(float(threshold)))
        .select("a", "b")
        .distinct()
    )
    pairs, seen = materialise(pairs)
    links, _ = materialise(_verified(source, pairs, seen["rows"], shingle, limit))
    roots = components(links)

    # buckets that still hold several components, without the hub, which has met all members
    placed = buckets.where("rep <> hub").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    mixed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    blocks = mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rest = placed.join(blocks, "key").withColumn("home", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = rest.select("key", "rep", "root", "home", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    spread = spread.select("key", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"), "home", F.col("rep").alias("doc_id"), "root")
    spread = spread.join(reps.select(F.col("rep").alias("doc_id"), "sig.*", "bands"), "doc_id").select("key", "i", "j", "home", "doc_id", "root", "size", "sketch", "bands")
    spread = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more, seen = materialise(spread.mapInArrow(_across(float(threshold)), "a long, b long").distinct())
    if seen["rows"]:
        late, found = materialise(_verified(source, more, seen["rows"], shingle, limit))
        if found["rows"]:
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(late))

    home = full.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep")).join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    home, seen = materialise(home.select("n_shingles", "s1", "s2", F.coalesce("root", "rep").alias("component_id")))
    found = signed.select("doc_id", "n_shingles", "s1", "s2").join(small(home, seen["rows"], 32), ["n_shingles", "s1", "s2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))

"""Repeated windows of a corpus, exactly: the engine of both substring deduplications.

Texts are sequences of 64-bit tokens (bytes or words). A window is a run of `window` tokens of one
text. Every window is owned by one trigger: its gram of `gram` tokens with the smallest rolling hash
(the rightmost on ties). Equal windows have equal triggers at equal offsets, so two windows can only
be equal when they are served by the same trigger value. A trigger with the stretch of text around it
that its windows cover is a phrase; consecutive phrases of a text overlap.

1. Count trigger values. Nearly all occur once, and nothing they own can repeat.
2. Phrases of repeated triggers are joined to those values. Equal phrases (trigger, extent and hash of
   the whole stretch) form the dictionary, with their number and first occurrence.
3. Dictionary phrases that share a trigger but differ are brought together with their tokens, shard by
   shard of triggers. Bytes are put in suffix order there, and neighbouring suffixes that agree for a
   window repeat; words are extended from their common anchor to both sides, all phrases at once.
4. Spans that repeat go back to their texts.

Trigger values are fast rolling hashes that only bring phrases together; whether windows are equal is
said by the suffix order or the extension (on the tokens themselves), or by hashes modulo a prime.

Texts move once, dealt by their id; the last two passes over them share that exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._groups import whole_groups
from ._tables import materialise

#: Bytes of text in one pass of the rolling hash; longer texts go in pieces that overlap by a window.
PIECE = 1 << 19
#: Bits of the packed key of a gram that hold its place, so that the rightmost wins a tie.
_PLACE = np.uint64(21)
#: Differing phrases of one trigger up to this number are compared in one task; beyond it their windows are counted one by one in a shuffle.
GROUP = 8_000
#: Bytes of suffixes that are sorted at once.
SORTED = 1 << 24
#: Longest window: places of texts of up to 2 GB fit into one integer beside two offsets of a window.
LONGEST = 1 << 16


@dataclass(frozen=True)
class Windows:
    window: int
    gram: int
    #: Bytes or words.
    of_words: bool

    def __post_init__(self):
        if not 0 < self.gram <= self.window <= LONGEST:
            raise ValueError(f"a window has 1 to {LONGEST} tokens, its gram no more than the window")

    @property
    def reach(self) -> int:
        """Grams in a window."""
        return self.window - self.gram + 1

    @property
    def bits(self) -> int:
        """Bits of an offset in a window."""
        return self.reach.bit_length()

    def pack(self, place: np.ndarray, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        """One integer that sorts as place."""
        return place << 2 * self.bits | far << self.bits | near

    def unpack(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        most = (1 << self.bits) - 1
        return at >> 2 * self.bits, at >> self.bits & most, at & most


@dataclass(frozen=True)
class Slice:
    """Some rows of a batch as tokens."""

    low: int
    high: int
    data: np.ndarray
    offsets: np.ndarray
    #: Index of the first token of each row, and the number of tokens.
    first: np.ndarray
    #: Of the words in data; None where the tokens are bytes.
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def tokens(self) -> np.ndarray:
        return self.data if self.starts is None else T.word_hashes(self.data, self.starts, self.ends)


def slices(texts: pa.Array, of_words: bool) -> Iterator[Slice]:
    data, offsets = T.flat(texts)
    for i, j in T.slices(offsets, PIECE):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if of_words:
            starts, ends, first = T.words(part, own)
            yield Slice(i, j, part, own, first, starts, ends)
        else:
            yield Slice(i, j, part, own, own)


def triggers(token: np.ndarray, first: np.ndarray, w: Windows, full: bool) -> Iterator[dict[str, np.ndarray]]:
    """Triggers that own windows of the texts: text (index into first), place of the trigger in its
    text, near and far (offsets of the last and first window they own before it), gram hash, and with
    full the hash of the whole stretch."""
    total, step = len(token), PIECE
    for low in range(0, max(1, total - w.window + 1), step):
        high = min(total, low + step + w.window - 1)
        part = token[low:high]
        n = len(part) - w.window + 1
        if n <= 0:
            return
        grams = T.rolling_grams(part if w.of_words else T.BYTE_VALUES[part], w.gram)
        place = np.arange(len(grams), dtype=np.uint64)
        key = (grams >> _PLACE << _PLACE) | ((np.uint64(1) << _PLACE) - np.uint64(1) - place)
        least = T.sliding_min(key, w.reach)
        owner = ((np.uint64(1) << _PLACE) - np.uint64(1) - (least & ((np.uint64(1) << _PLACE) - np.uint64(1)))).astype(np.int64)
        # windows that cross the end of a text don't count
        start = np.arange(low, low + n)
        text = np.searchsorted(first, start, "right") - 1
        inside = start + w.window <= first[text + 1]
        start, text, owner = start[inside] - low, text[inside], owner[inside]
        if not len(start):
            continue
        edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])]))
        last = np.append(edge[1:], len(start)) - 1
        at = owner[edge]
        out = {"text": text[edge], "place": at + low - first[text[edge]], "far": at - start[edge], "near": at - start[last], "gram": grams[at]}
        if full:
            out["stretch"] = T.range_hash(T.prefix_hash(part), start[edge], start[last] + w.window)
        yield out


def _counting(w: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text"), w.of_words):
                for t in triggers(s.tokens(), s.first, w, full=False):
                    yield pa.RecordBatch.from_arrays([pa.array(t["gram"].view(np.int64))], names=["gram"])

    return run


def _phrases(w: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("rid").to_numpy(zero_copy_only=False)
            for s in slices(batch.column("text"), w.of_words):
                for t in triggers(s.tokens(), s.first, w, full=True):
                    arrays = [t["gram"].view(np.int64), t["stretch"].view(np.int64), ids[s.low + t["text"]], w.pack(t["place"], t["far"], t["near"])]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["gram", "stretch", "rid", "at"])

    return run


def _contexts(w: Windows):
    """Stretches of the wanted phrases, as the bytes of their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            bounds = wanted.offsets.to_numpy()
            inner = wanted.values
            gram, at, times, variants = (inner.field(k).to_numpy(zero_copy_only=False) for k in ("gram", "at", "times", "variants"))
            ids = batch.column("rid").to_numpy(zero_copy_only=False)
            for s in slices(batch.column("text"), w.of_words):
                mine = np.arange(bounds[s.low], bounds[s.high])
                if not len(mine):
                    continue
                token = s.tokens()
                unit = token.dtype.itemsize
                raw = memoryview(np.ascontiguousarray(token)).cast("B")
                number = np.diff(bounds[s.low : s.high + 1])
                base, owner = np.repeat(s.first[:-1], number), np.repeat(ids[s.low : s.high], number)
                place, far, near = w.unpack(at[mine])
                begin, end = base + place - far, base + place - near + w.window
                for k in range(0, len(mine), 5000):
                    cut = slice(k, k + 5000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(gram[mine[cut]]), pa.array(owner[cut]), pa.array(at[mine[cut]]), pa.array(times[mine[cut]]), pa.array(variants[mine[cut]]),
                            pa.array([bytes(raw[a * unit : b * unit]) for a, b in zip(begin[cut], end[cut], strict=True)], pa.binary()),
                        ],
                        names=["gram", "rid", "at", "times", "variants", "context"],
                    )

    return run


@dataclass(frozen=True)
class Phrases:
    """Dictionary phrases with their tokens, and their windows: the phrase of each, the offset of its trigger, and where it begins in the tokens."""

    token: np.ndarray
    #: Of each phrase in token.
    begin: np.ndarray
    place: np.ndarray
    far: np.ndarray
    near: np.ndarray
    gram: np.ndarray
    doc: np.ndarray
    times: np.ndarray
    phrase: np.ndarray
    offset: np.ndarray
    start: np.ndarray


def _phrases_of(table: pa.Table, w: Windows) -> Phrases:
    context = table.column("context").combine_chunks()
    place, far, near = w.unpack(table.column("at").to_numpy())
    offsets = np.frombuffer(context.buffers()[1], dtype=np.int32)[context.offset : context.offset + len(context) + 1].astype(np.int64)
    raw = np.frombuffer(context.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    token = raw.copy().view(np.uint64) if w.of_words else raw
    begin = (offsets[:-1] - offsets[0]) // (8 if w.of_words else 1)
    count = far - near + 1
    phrase = np.repeat(np.arange(len(far)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    doc, times, gram = (table.column(k).to_numpy() for k in ("rid", "times", "gram"))
    return Phrases(token, begin, place, far, near, gram, doc, times, phrase, far[phrase] - step, begin[phrase] + step)


def _suffix_classes(p: Phrases, w: Windows) -> np.ndarray:
    """A number for each window, the same for equal windows. The suffixes of the phrases that windows
    begin are put in order; a window is equal to its neighbour where they agree for its whole length.

    Phrases overlap by a window, so a suffix that begins one never reaches the end of its phrase: the
    order of suffixes is that of the dictionary, and the parse is never needed to go on with a tie.
    """
    suffixes = np.lib.stride_tricks.sliding_window_view(p.token, w.window)
    out, base = np.empty(len(p.start), dtype=np.int64), 0
    # windows at different offsets have their triggers elsewhere, so they differ and can be sorted apart
    by_offset = np.argsort(p.offset, kind="stable")
    edges = np.append(_edges(p.offset[by_offset]), len(by_offset))
    for i, j in T.slices(edges, max(1, SORTED // w.window)):
        mine = by_offset[edges[i] : edges[j]]
        text = np.ascontiguousarray(suffixes[p.start[mine]]).view(f"S{w.window}").ravel()
        order = np.argsort(text, kind="stable")
        fresh = np.ones(len(mine), dtype=bool)
        fresh[1:] = text[order[1:]] != text[order[:-1]]
        out[mine[order]] = base + np.cumsum(fresh) - 1
        base += len(mine)
    return out


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where one of the sorted columns differs from the row before."""
    fresh = np.zeros(len(columns[0]), dtype=bool)
    fresh[:1] = True
    for x in columns:
        fresh[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(fresh)


def _refined(match: np.ndarray, rows: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Classes of rows that were in one class and have the same next token; -1 for rows that go on alone."""
    order = np.lexsort((token, match[rows]))
    edges = _edges(match[rows][order], token[order])
    size = np.diff(np.append(edges, len(order)))
    number = np.repeat(np.where(size > 1, np.arange(len(edges)), -1), size)
    out = np.full(len(match), -1, dtype=np.int64)
    out[rows[order]] = number
    return out


def _extension_classes(p: Phrases, w: Windows) -> np.ndarray:
    """A number for each window, the same for equal windows, and -1 for windows without an equal one.

    Phrases with one anchor are matched on its tokens, and then extended a token at a time to the right
    and to the left: classes of phrases that still agree are split by the next token, and a phrase that
    is left alone goes no further. A window is a reach to the left and one to the right, so windows are
    equal where both classes are. All pairs are told apart without forming one.
    """
    anchor = p.begin + p.far
    order = np.argsort(p.gram, kind="stable")
    match = np.empty(len(p.gram), dtype=np.int64)
    match[order] = np.cumsum(np.isin(np.arange(len(order)), _edges(p.gram[order])))
    for k in range(w.gram):
        rows = np.flatnonzero(match >= 0)
        match = _refined(match, rows, p.token[anchor[rows] + k])

    def extended(most: np.ndarray, at: Callable[[np.ndarray, int], np.ndarray]) -> list[np.ndarray]:
        out = [match]
        for k in range(1, w.reach):
            rows = np.flatnonzero((out[-1] >= 0) & (most >= k))
            out.append(_refined(out[-1], rows, p.token[at(anchor[rows], k)]))
        return out

    right = extended(w.window - w.gram - p.near, lambda a, k: a + w.gram + k - 1)
    left = extended(p.far, lambda a, k: a - k)
    out, base = np.full(len(p.phrase), -1, dtype=np.int64), 0
    for k in range(w.reach):
        mine = np.flatnonzero(p.offset == k)
        x, y = left[k][p.phrase[mine]], right[w.reach - 1 - k][p.phrase[mine]]
        good = (x >= 0) & (y >= 0)
        mine = mine[good]
        if len(mine):
            _, out[mine] = np.unique(x[good] * len(match) + y[good], return_inverse=True)
            out[mine] += base
            base += len(mine)
    return out


def _compare(w: Windows, earlier: bool):
    """Spans of the phrases' windows that repeat, by whole groups of phrases with one trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, starts in whole_groups(batches, ["gram"]):
            bounds = np.append(starts, group.num_rows)
            for low, high in T.slices(bounds, 4000):
                yield from _spans(_phrases_of(group.slice(bounds[low], bounds[high] - bounds[low]), w), w, earlier)

    return run


def _spans(p: Phrases, w: Windows, earlier: bool) -> Iterator[pa.RecordBatch]:
    mark = _extension_classes(p, w) if w.of_words else _suffix_classes(p, w)
    doc, start = p.doc[p.phrase], p.place[p.phrase] - p.offset
    rows = np.flatnonzero(mark >= 0)
    order = rows[np.lexsort((start[rows], doc[rows], mark[rows])) if earlier else np.argsort(mark[rows], kind="stable")]
    repeated = np.zeros(len(mark), dtype=bool)
    if len(order):
        edges = _edges(mark[order])
        if earlier:
            repeated[order] = True
            repeated[order[edges]] = False
        else:
            size = np.diff(np.append(edges, len(order)))
            repeated[order] = np.repeat(np.add.reduceat(p.times[p.phrase[order]], edges) > 1, size)
    hit = np.flatnonzero(repeated)
    if len(hit):  # runs of neighbouring windows are one span
        fresh = np.concatenate([[True], (np.diff(hit) != 1) | (p.phrase[hit][1:] != p.phrase[hit][:-1])])
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(hit)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(doc[hit[head]]), pa.array(start[hit[head]]), pa.array(start[hit[tail]] + w.window)], names=["rid", "begin", "end"])


def _window_rows(w: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                p = _phrases_of(pa.Table.from_batches([batch.slice(k, 1000)]), w)
                hashed = T.range_hash(T.prefix_hash(p.token), p.start, p.start + w.window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.gram[p.phrase]), pa.array(p.offset), pa.array(hashed.view(np.int64)), pa.array(p.doc[p.phrase]), pa.array(p.place[p.phrase] - p.offset), pa.array(p.times[p.phrase])],
                    names=["gram", "offset", "hash", "rid", "begin", "times"],
                )

    return run


def identified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rid, text) as documents are read, and the same dealt by rid. rid tells rows apart and
    sorts as doc_id. It is doc_id itself unless ids are null or repeat; then rows are numbered in the
    order of doc_id (null first) and text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1)
    if odd.isEmpty():
        rows = docs.select("doc_id", F.col("doc_id").alias("rid"), "text")
    else:
        rows, _ = materialise(docs.orderBy(F.col("doc_id").asc_nulls_first(), "text").select("doc_id", F.monotonically_increasing_id().alias("rid"), "text"))
    return rows, rows.repartition("rid")


def repeated_spans(rows: DataFrame, dealt: DataFrame, w: Windows, earlier: bool) -> DataFrame:
    """(rid, begin, end) in tokens: spans of windows that also start elsewhere, or with earlier only
    those that also start before (smaller rid, or the same and a smaller begin). Spans of a text may
    overlap. The arguments are what identified() returns."""
    counted = rows.select("text").mapInArrow(_counting(w), "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    counted, _ = materialise(counted)  # so that the join below reads both sides from a shuffle, and a gram with very many phrases is split
    phrases = rows.select("rid", "text").mapInArrow(_phrases(w), "gram long, stretch long, rid long, at long").join(counted, "gram")
    phrases, _ = materialise(phrases.withColumn("extent", F.col("at").bitwiseAND(F.lit((1 << 2 * w.bits) - 1))))
    dictionary, _ = materialise(phrases.groupBy("gram", "stretch", "extent").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("rid", "at")).alias("first")))

    # phrases that repeat whole
    again = dictionary.where("times > 1").select("gram", "stretch", "extent", "first")
    whole = phrases.join(again, ["gram", "stretch", "extent"])
    if earlier:
        whole = whole.where("rid <> first.rid or at <> first.at")
    place, far, near = f"shiftright(at, {2 * w.bits})", f"(shiftright(at, {w.bits}) & {(1 << w.bits) - 1}L)", f"(at & {(1 << w.bits) - 1}L)"
    whole = whole.selectExpr("rid", f"{place} - {far} as begin", f"{place} - {near} + {w.window} as end")

    # dictionary phrases that share a trigger and differ
    variants = dictionary.groupBy("gram").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")
    differ = dictionary.join(variants, "gram").select("gram", "times", "first.rid", "first.at", "variants")
    differ, seen = materialise(differ, crowded=F.count_if(F.col("variants") > GROUP))
    wanted = differ.groupBy("rid").agg(F.collect_list(F.struct("gram", "at", "times", "variants")).alias("wanted"))
    contexts = dealt.join(wanted.hint("shuffle_hash"), "rid").select("rid", "text", "wanted")
    contexts = contexts.mapInArrow(_contexts(w), "gram long, rid long, at long, times long, variants long, context binary")
    if seen["crowded"]:
        contexts, _ = materialise(contexts)
    few = contexts.where(F.col("variants") <= GROUP).repartition("gram").sortWithinPartitions("gram")
    spans = whole.union(few.mapInArrow(_compare(w, earlier), "rid long, begin long, end long"))
    if seen["crowded"]:
        crowd = contexts.where(F.col("variants") > GROUP)
        windows = crowd.mapInArrow(_window_rows(w), "gram long, offset long, hash long, rid long, begin long, times long")
        same = windows.groupBy("gram", "offset", "hash").agg(F.sum("times").alias("total"), F.min(F.struct("rid", "begin")).alias("first")).where("total > 1").drop("total")
        many = windows.join(same, ["gram", "offset", "hash"])
        if earlier:
            many = many.where("rid <> first.rid or begin <> first.begin")
        spans = spans.union(many.select("rid", "begin", (F.col("begin") + w.window).alias("end")))
    return spans


def cut(dealt: DataFrame, spans: DataFrame, w: Windows, make: Callable[[Slice, np.ndarray], list[pa.Array]], schema: str) -> DataFrame:
    """doc_id and what make() returns, for each text. make gets some texts and the mask of the tokens
    that spans cover, and returns the columns that the schema names."""
    gathered = spans.groupBy("rid").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = dealt.join(gathered.hint("shuffle_hash"), "rid", "left").select("doc_id", "text", "spans")
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            bounds = spans.offsets.to_numpy()
            begin, end = (spans.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("begin", "end"))
            for s in slices(batch.column("text"), w.of_words):
                mine = slice(bounds[s.low], bounds[s.high])
                base = np.repeat(s.first[:-1], np.diff(bounds[s.low : s.high + 1]))
                total = int(s.first[-1])
                change = np.bincount(base + begin[mine], minlength=total + 1) - np.bincount(base + end[mine], minlength=total + 1)
                columns = make(s, np.cumsum(change[:total]) > 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.low, s.high - s.low), *columns], names=names)

    return joined.mapInArrow(run, f"doc_id long, {schema}")

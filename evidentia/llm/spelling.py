"""Spelling variants: words one edit apart, found as points in rectangles of two word orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._groups import whole_groups
from ._tables import materialise

#: Runs of these characters are words; in UTF-8 the accented ones are the byte C3 and another.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One code point of every run whose checksum this divides is lost.
LOST = 97
#: Letters of words in one block; blocks with more are divided by narrower ranges of the edit's position.
BLOCK = 1 << 22
#: Words that are ordered at once, and queries that walk down a tree at once.
WORDS, QUERIES = 100_000, 1 << 16

_KEY = ["size", "low", "high", "pre", "suf"]


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): distinct words of all texts and how often they occur. Counts are partial before the shuffle."""
    body = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(body, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length)
    check = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    runs = runs.select("run", check.alias("check"))
    at = (F.col("check") % F.length("run")).cast("int")
    word = F.when(F.col("check") % LOST == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


class WaveletTree:
    """Reports the values of a permutation that lie in a range of places and in a range of values. A level for each
    bit: at a node, values without the bit go left and those with it right, and ranks say where a range of places goes."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.ones: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            right = values >> bit & 1
            self.ones.append(np.concatenate([[0], np.cumsum(right)]))
            values = np.concatenate([values[right == 0], values[right == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for every place in [left, right) of a query whose value is in [low, high)."""
        query, head = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
        for bit, ones in zip(range(self.bits - 1, -1, -1), self.ones, strict=True):
            zeros = len(ones) - 1 - ones[-1]
            a, b = ones[left], ones[right]
            query = np.concatenate([query, query])
            head = np.concatenate([2 * head, 2 * head + 1])
            left, right = np.concatenate([left - a, zeros + a]), np.concatenate([right - b, zeros + b])
            keep = np.flatnonzero((left < right) & (head << bit < high[query]) & (head + 1 << bit > low[query]))
            query, head, left, right = query[keep], head[keep], left[keep], right[keep]
        return query, head


class _Order:
    """Words of two sizes in the order of their letters: for every length of a common beginning, which words share it."""

    def __init__(self, letters: np.ndarray, longer: np.ndarray):
        self.order = np.argsort(np.ascontiguousarray(letters).view(f"S{letters.shape[1]}").ravel(), kind="stable")
        self.rank = np.empty(len(letters), dtype=np.int64)
        self.rank[self.order] = np.arange(len(letters))
        ordered = letters[self.order]
        differ = ordered[1:] != ordered[:-1]
        #: Letters shared with the word before.
        self.shared = np.concatenate([[-1], np.argmax(differ, axis=1) if len(differ) else []]).astype(np.int64)
        self.most = int(self.shared.max())
        #: How many words of either size stand before each place.
        self.before = [np.concatenate([[0], np.cumsum(longer[self.order] == kind)]) for kind in (False, True)]

    def interval(self, length: int, longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each word, the interval of the words of one size, numbered in order, that begin with its first letters."""
        fresh = self.shared < length
        start = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        end = np.append(start[1:], len(fresh))
        before = self.before[longer]
        return before[start][group][self.rank], before[end][group][self.rank]

    def numbered(self, longer: np.ndarray, kind: bool) -> np.ndarray:
        """The words of one size in order."""
        return self.order[longer[self.order] == kind]


def near_pairs(letters: np.ndarray, longer: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that one edit at a place in [low, high) makes equal, each pair once in either direction.

    letters holds one word a row: size letters, or size + 1 where longer says so; shorter rows end in 0. Replacing a
    letter at i leaves the first i and the last size - 1 - i letters, inserting one there the first i and the last
    size - i: the words sought lie in the prefix interval of forward order and in the suffix interval of reverse
    order. A tree for each size reports the points in both. Of the places where one insertion can be made (before
    or after equal letters) the last counts.
    """
    backward = np.zeros_like(letters)
    width = size + longer
    column = np.arange(size + 1)
    at = width[:, None] - 1 - column
    backward[at >= 0] = letters[np.nonzero(at >= 0)[0], at[at >= 0]]
    forth, back = _Order(letters, longer), _Order(backward, longer)
    trees, members = [], []
    for kind in (False, True):
        there, here = forth.numbered(longer, kind), back.numbered(longer, kind)
        place = np.empty(len(letters), dtype=np.int64)
        place[here] = np.arange(len(here))
        trees.append(WaveletTree(place[there]) if len(there) else None)
        members.append(here)
    short = np.flatnonzero(~longer)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    asked: dict[bool, list[tuple]] = {False: [], True: []}

    def answer(kind: bool) -> None:
        if asked[kind]:
            word, left, right, down, up, place = (np.concatenate(x) for x in zip(*asked[kind], strict=True))
            asked[kind].clear()
            for k in range(0, len(word), QUERIES):
                query, value = trees[kind].report(left[k : k + QUERIES], right[k : k + QUERIES], down[k : k + QUERIES], up[k : k + QUERIES])
                a, b, i = word[k + query], members[kind][value], place[k + query]
                good = letters[b, i] != letters[a, i]  # for a replacement: not the word itself
                pairs.append((a[good], b[good]))
                if kind:
                    pairs.append((b[good], a[good]))

    for i in range(max(low, size - 1 - back.most), min(high, forth.most + 1)):
        for kind in (False, True):
            left, right = (x[short] for x in forth.interval(i, kind))
            down, up = (x[short] for x in back.interval(size - i if kind else size - 1 - i, kind)) if i < size or kind else (left, left)
            least = 1 if kind else 2  # the word itself is a point of its own size
            good = np.flatnonzero((right - left >= least) & (up - down >= least))
            if len(good):
                asked[kind].append((short[good], left[good], right[good], down[good], up[good], np.full(len(good), i)))
            if sum(len(x[0]) for x in asked[kind]) >= QUERIES:
                answer(kind)
    answer(False)
    answer(True)
    empty = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([empty, *x]) for x in zip(*pairs, strict=True)) if pairs else (empty, empty)


def _letters(words: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of Latin-1 letters, and which of them have size + 1."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    lead = raw == 0xC3
    single = raw + np.uint8(0x40) * (raw >= 0x80)
    count = np.concatenate([[0], np.cumsum(~lead)])
    bounds = count[offsets - offsets[0]]
    width = np.diff(bounds)
    out = np.zeros((len(words), size + 1), dtype=np.uint8)
    row = np.repeat(np.arange(len(words)), width)
    out[row, np.arange(len(row)) - bounds[:-1][row]] = single[~lead]
    return out, width > size


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For words of whole blocks: how many near words they have there, and the most frequent of these."""
    for table, starts in whole_groups(batches, ["size", "low", "high", "block"]):
        size, low, high = (table.column(k).to_numpy() for k in ("size", "low", "high"))
        bounds, i = np.append(starts, table.num_rows), 0
        while i < len(starts):  # blocks of one kind together
            at, j = bounds[i], i + 1
            while j < len(starts) and bounds[j + 1] - at <= WORDS and all(x[bounds[j]] == x[at] for x in (size, low, high)):
                j += 1
            part = table.slice(at, bounds[j] - at)
            if part.num_rows > 1:
                yield _found(part, int(size[at]), int(low[at]), int(high[at]))
            i = j


def _found(part: pa.Table, size: int, low: int, high: int) -> pa.RecordBatch:
    words, n = part.column("word").combine_chunks(), part.column("n").to_numpy()
    letters, longer = _letters(words, size)
    a, b = near_pairs(letters, longer, size, low, high)
    rank = np.empty(len(letters), dtype=np.int64)
    rank[np.argsort(letters.view(f"S{size + 1}").ravel(), kind="stable")] = np.arange(len(letters))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, dtype=np.int64)
    near = np.diff(np.append(head, len(a)))
    return pa.RecordBatch.from_arrays([words.take(pa.array(a[head])), pa.array(near), pa.array(n[b[head]]), words.take(pa.array(b[head]))], names=["word", "near", "best_n", "best"])


def _keyed(ranges: DataFrame) -> DataFrame:
    """Ranges (word, n, size, low, high) with what all words of a block share: what stands before and after the range."""
    after = F.greatest(F.col("size") - F.col("high"), F.lit(0)).cast("int")
    return ranges.withColumns({"pre": F.substring("word", F.lit(1), F.col("low").cast("int")), "suf": F.right("word", after)})


def _blocks(words: DataFrame) -> list[DataFrame]:
    """Words dealt to blocks: words of size or size + 1 letters that may differ by an edit at a place in [low, high).

    An edit in the first half leaves the last letters as they are, one in the second half the first letters. Where
    that puts too many letters into one block (words that begin alike), it is divided into two ranges of places,
    which have more letters in common, down to single places. No pair is lost or met twice."""
    word, own = F.col("word"), F.length("word").cast("long")
    sizes = words.select("word", "n", F.explode(F.when(own > 5, F.array(own, own - 1)).otherwise(F.array(own))).alias("size"))
    half = F.expr("size div 2")
    ends = F.array(F.struct(F.lit(0).cast("long").alias("low"), half.alias("high")), F.struct(half.alias("low"), (F.col("size") + 1).alias("high")))
    ranges, done = sizes.select(word, "n", "size", F.explode(ends).alias("r")).select("word", "n", "size", "r.low", "r.high"), []
    while True:
        keyed = _keyed(ranges)
        sums = keyed.groupBy(*_KEY).agg(F.sum(F.length("word")).alias("letters"), F.count(F.lit(1)).alias("rows"))
        large, seen = materialise(sums.where((F.col("letters") > BLOCK) & (F.col("rows") > 1) & (F.col("high") - F.col("low") > 1)).drop("letters", "rows"))
        if not seen["rows"]:
            return [*done, keyed]
        done.append(keyed.join(large, _KEY, "left_anti"))
        middle = F.expr("(low + high) div 2")
        halves = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
        ranges, _ = materialise(keyed.join(large, _KEY).select("word", "n", "size", F.explode(halves).alias("r")).select("word", "n", "size", "r.low", "r.high"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where forms lead in the end. Each step doubles how far a word has followed; a form occurs at
    least twice as often as its word, so there is no circle."""
    state, seen = materialise(forms.select("word", F.col("form").alias("root")), left=F.count(F.lit(1)))
    while seen["left"]:
        jump = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        state, seen = materialise(state.join(jump, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), left=F.count_if(F.col("moved")))
        state = state.select("word", "root")
    return state


def spelling_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """The form of each word: its near word that occurs most often, if at least `times` as often as the word.

    Two-dimensional range reporting: words are points, by their place in forward and in reverse order. For each
    place of an edit, near words are the points in a prefix interval of the one and a suffix interval of the other,
    reported by wavelet trees. Words are first dealt to blocks that share their beginning or their end, and blocks
    with too many letters are divided further, so that no task holds the vocabulary; a word has at most as many
    near words as places times letters, and only their number and the best of them leave a block.

    words needs word (distinct, letters of RUN, 5 or more) and n, its occurrences. Near words differ by exactly one
    inserted, deleted or replaced code point. Ties go to the smallest word in code-point order. Null words or
    counts are no words and are left out; an empty table gives no rows.
    Returns one row per word: word, form (or null), root (where forms lead in the end), n, n_near, form_n.
    """
    words = words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")).where("word is not null and n is not null")
    words, _ = materialise(words)
    found = None
    for block in _blocks(words):
        part = block.select("size", "low", "high", F.xxhash64(*_KEY).alias("block"), "word", "n")
        part = part.repartition("size", "low", "high", "block").sortWithinPartitions("size", "low", "high", "block")
        part = part.mapInArrow(_nearest, "word string, near long, best_n long, best string")
        found = part if found is None else found.union(part)
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("b")
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.minus")).alias("best_n"))
    is_form = F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False))
    rows = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    rows, _ = materialise(rows)
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

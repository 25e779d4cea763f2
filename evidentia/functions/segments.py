"""Sentences and prose units of texts, by one compiled pattern and a single pass over each text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Full-width marks that end a sentence, marks that may follow an end, marks that may open
# a word, and words whose period ends no sentence.
TERMINATORS = "。！？；"
CLOSERS = "」』）〕】》〉”’\"')]"
OPENERS = "\"'(“‘"
ABBREVIATIONS = frozenset(
    ("st", "no", "nos", "mr", "mrs", "ms", "dr", "prof", "co", "corp", "inc", "ltd", "jr", "sr", "vs", "etc",
     "fig", "approx", "dept", "gov", "rep", "sen", "gen", "lt", "col", "capt", "mt", "ft", "e.g", "i.e", "u.s", "u.k")
)

_CLOSE = f"[{re.escape(CLOSERS)}]"
#: An end: a newline; full-width marks with what closes them; or . ! ? (with closers) before white space
#: and neither a digit nor a-z, or at the end of the text, with further such marks and closers.
_END = re.compile(
    rf"\n|[{TERMINATORS}][{TERMINATORS}{re.escape(CLOSERS)}]*"
    rf"|([.!?])(?={_CLOSE}*+(?:\Z|\s++(?![\da-z])))[.!?{re.escape(CLOSERS)}]*"
)
_SPACE = re.compile(r"\s")


def _abbreviated(text: str, dot: int) -> bool:
    """Whether the period at dot belongs to an abbreviation or a single letter."""
    size = 64
    while size < dot and not _SPACE.search(text, dot - size, dot):
        size *= 2
    before = text[max(0, dot - size) : dot]
    word = before[len(before) - len(before.split()[-1]) :] if before and not before[-1].isspace() else ""
    word = word.strip(OPENERS).casefold()
    return word in ABBREVIATIONS or (len(word) == 1 and word.isalpha())


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences, in code points, without white space at the ends."""
    cuts, at = [0], 0
    while found := _END.search(text, at):
        if found[1] == "." and _abbreviated(text, found.start()):
            at = found.start() + 1
            continue
        at = found.end()
        cuts.append(at)
    cuts.append(len(text))
    out = []
    for low, high in zip(cuts, cuts[1:]):
        piece = text[low:high]
        bare = piece.strip()
        if bare:
            start = low + len(piece) - len(piece.lstrip())
            out.append((start, start + len(bare)))
    return out


_UNIT_END = re.compile(rf"(?:\n|[{TERMINATORS}][{TERMINATORS}{re.escape(CLOSERS.replace(']', ''))}]*)\s*")


def unit_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of prose units: full-width marks and newlines end one (with the white space after them), and a unit without letters or
    digits goes to the one after it (the last to the one before). The units make up the whole text."""
    cuts = [0, *(m.end() for m in _UNIT_END.finditer(text)), len(text)]
    out: list[tuple[int, int]] = []
    start = 0
    for end in cuts[1:]:
        if end > start and any(c.isalnum() for c in text[start:end]):
            out.append((start, end))
            start = end
    if start < len(text):
        out = [*out[:-1], (out[-1][0], len(text))] if out else [(0, len(text))]
    return out


def spans_of(rows: DataFrame, key: str, text: Column, spans: Callable[[str], list[tuple[int, int]]], prefix: str = "S") -> DataFrame:
    """One row for each span of each text: key, id (prefix and number from 1), start, end, text. Null texts have none."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, names, starts, ends, texts = [], [], [], [], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                for n, (a, b) in enumerate(spans(value or ""), 1):
                    take.append(k)
                    names.append(f"{prefix}{n}")
                    starts.append(a)
                    ends.append(b)
                    texts.append(value[a:b])
                if len(take) > 20_000:
                    yield _rows(batch, take, names, starts, ends, texts)
                    take, names, starts, ends, texts = [], [], [], [], []
            yield _rows(batch, take, names, starts, ends, texts)

    def _rows(batch, take, names, starts, ends, texts) -> pa.RecordBatch:
        columns = [batch.column(0).take(pa.array(take, pa.int64())), pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[key, "id", "start", "end", "text"])

    return rows.select(key, text.cast("string").alias("__text")).mapInArrow(run, f"{key} {kind}, id string, start int, end int, text string")


def sentences(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """Sentences of texts with their offsets: a newline or a full-width mark ends one, and . ! ? do before
    white space, unless a digit or a-z follows or the period closes an abbreviation or a single letter."""
    return spans_of(rows, key, text, sentence_spans)


def cited(citations: DataFrame, segments: DataFrame, key: str, ids: str = "ids") -> DataFrame:
    """Resolves lists of sentence ids: key, valid, cited (the sentences' texts in document order, joined by spaces).

    citations: key and an array of ids. A list is valid if it is not empty, repeats nothing and names
    only sentences that its document has (segments: key, id, start, text).
    """
    listed = citations.select(key, F.posexplode_outer(ids).alias("__n", "id"))
    found = listed.join(segments.select(key, "id", "start", "text"), [key, "id"], "left")
    gathered = found.groupBy(key).agg(
        F.count("__n").alias("__listed"), F.count_distinct("id").alias("__distinct"), F.count("start").alias("__known"),
        F.sort_array(F.collect_list(F.struct("start", "text"))).alias("__parts"),
    )
    valid = (F.col("__listed") > 0) & (F.col("__listed") == F.col("__distinct")) & (F.col("__known") == F.col("__listed"))
    return gathered.select(key, valid.alias("valid"), F.when(valid, F.array_join(F.transform("__parts", lambda p: p["text"]), " ")).alias("cited"))


def focused(segments: DataFrame, focus: DataFrame, key: str) -> DataFrame:
    """The sentences whose (start, end) is one of the recorded focus spans of their document."""
    return segments.join(focus.select(key, "start", "end").distinct(), [key, "start", "end"], "left_semi")

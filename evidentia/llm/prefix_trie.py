"""Trie of conversations by their first turns, merged family by family."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import materialise

#: Ids of a family: conversations c with the same c - c % FAMILY.
FAMILY = 20
#: A conversation takes fewer turns than this from its base.
HEADS = 4
#: Nodes of a family that a task holds; a larger family is handed on in parts, which merge like those of two families.
HELD = 200_000
#: Bits of an id inside one joined piece of ids.
PIECE_BITS = 12

_PART = "a long, b long, parent_a long, parent_b long, depth long, n long, first long, words long, ends array<long>"


def taken(conv_id: int) -> int:
    """Turns that a conversation takes from the base of its family."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


class _Family:
    """The trie of one family. A node's key is a digest of its parent's key and its last turn."""

    ROOT = (0, 0)

    def __init__(self) -> None:
        self.nodes: dict[tuple[int, int], list] = {}
        self.base: list[tuple[bytes, int]] = []

    def begin(self, conv_id: int, is_base: bool) -> None:
        self.conv_id, self.is_base, self.depth, self.own = conv_id, is_base, 0, 0
        self.at = self.ROOT
        self._visit(self.ROOT, None, 0)
        self.skip = 0 if is_base else taken(conv_id)
        for turn in self.base[: self.skip]:
            self._go(*turn)

    def turn(self, digest: bytes, words: int) -> None:
        if self.is_base and len(self.base) < HEADS:
            self.base.append((digest, words))
        if self.own >= self.skip:
            self._go(digest, words)
        self.own += 1

    def end(self) -> None:
        self.nodes[self.at][5].append(self.conv_id)

    def _go(self, digest: bytes, words: int) -> None:
        before = self.at
        raw = hashlib.blake2b(before[0].to_bytes(8, "little", signed=True) + before[1].to_bytes(8, "little", signed=True) + digest, digest_size=16).digest()
        self.at = int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)
        self.depth += 1
        self._visit(self.at, before, words)

    def _visit(self, key: tuple[int, int], parent: tuple[int, int] | None, words: int) -> None:
        if key in self.nodes:
            self.nodes[key][2] += 1
        else:
            self.nodes[key] = [parent, self.depth, 1, self.conv_id, words, []]

    def parts(self) -> pa.RecordBatch:
        """The nodes so far. A conversation that goes on visits only nodes below its last one, so parts add up."""
        keys, rows = list(self.nodes), list(self.nodes.values())
        up = [r[0] or (None, None) for r in rows]
        longs = [[k[0] for k in keys], [k[1] for k in keys], [p[0] for p in up], [p[1] for p in up], *[[r[i] for r in rows] for i in (1, 2, 3, 4)]]
        self.nodes = {}
        names = [c.split()[0] for c in _PART.split(", ")]
        return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in longs], pa.array([r[5] for r in rows], pa.list_(pa.int64()))], names=names)


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Family tries of rows (family, conv_id, digest, words) in order."""
    trie, family, conversation = _Family(), None, None
    for batch in batches:
        for base, conv_id, digest, words in zip(*[batch.column(k).to_pylist() for k in ("family", "conv_id", "digest", "words")], strict=True):
            if conv_id != conversation:
                if conversation is not None:
                    trie.end()
                if base != family:
                    if trie.nodes:
                        yield trie.parts()
                    trie, family = _Family(), base
                trie.begin(conv_id, conv_id == base)
                conversation = conv_id
            trie.turn(digest, words)
            if len(trie.nodes) > HELD:
                last = trie.nodes.pop(trie.at)  # stays, as the conversation may end here
                yield trie.parts()
                trie.nodes[trie.at] = last
    if conversation is not None:
        trie.end()
        yield trie.parts()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each node, over the pieces of its ids in order."""
    now, found = None, None
    for batch in batches:
        out = []
        for a, b, piece in zip(*[batch.column(k).to_pylist() for k in ("a", "b", "ids")], strict=True):
            if (a, b) != now:
                if now is not None:
                    out.append((*now, found.hexdigest()))
                now, found = (a, b), hashlib.sha256(piece.encode())
            else:
                found.update(f",{piece}".encode())
        yield _digest_rows(out)
    if now is not None:
        yield _digest_rows([(*now, found.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(np.array(columns[0], dtype=np.int64)), pa.array(np.array(columns[1], dtype=np.int64)), pa.array(list(columns[2]), pa.string())], names=["a", "b", "sha"])


def _ends(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, sha) of nodes at which several conversations end. Ids are joined in pieces of neighbouring ids, so that
    no row holds more than a piece; a node's pieces then run through one digest, which has to read them in order."""
    several = nodes.where("n_ends > 1").select("a", "b")
    ids = parts.where("size(ends) > 0").select("a", "b", F.explode("ends").alias("id")).join(several, ["a", "b"])
    pieces = ids.groupBy("a", "b", F.shiftright("id", PIECE_BITS).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "piece").mapInArrow(_digests, "a long, b long, sha string")


def _subtrees(nodes: DataFrame) -> DataFrame:
    """(a, b, n_leaves, saved) of nodes with several members, over their subtrees.

    A node with one member has one leaf below it and saves nothing, so only shared nodes are summed. Each step
    doubles how far below a node its sums reach: a node adds the sums of those that lie just beyond, whose
    pointers lead to it. Steps are the logarithm of the greatest depth that is shared.
    """
    state = nodes.where("n > 1").select(
        "a", "b", F.col("parent_a").alias("up_a"), F.col("parent_b").alias("up_b"),
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_single")).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"),
    )
    state, seen = materialise(state, open=F.count("up_a"))
    while seen["open"]:
        more = state.where("up_a is not null").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jump = state.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("up_a").alias("far_a"), F.col("up_b").alias("far_b"))
        state = state.join(more, ["a", "b"], "left").join(jump, ["up_a", "up_b"], "left").select(
            "a", "b", F.col("far_a").alias("up_a"), F.col("far_b").alias("up_b"),
            (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        )
        state, seen = materialise(state, open=F.count("up_a"))
    return state.select("a", "b", "n_leaves", "saved")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: what sharing their first turns saves.

    Every conversation c is rebuilt: the first taken(c) turns of its base c - c % 20 (all if that has fewer, none
    if there is no such conversation), then its own turns after its first taken(c). Family-first merging: the
    conversations of a base are brought together, in order; a task rebuilds them and emits the small trie of each
    family, in which a prefix that many members share is one node. Only such nodes are shuffled to be merged with
    those of other families; turns go as digests and word counts, texts never move. Sums over subtrees take as many
    steps as the logarithm of the shared depth.

    conversations needs conv_id (long), turn, role and text; other columns are ignored. Turns are ordered by turn,
    null first; equal turns by role and digest of the text. Null roles and texts are empty. c % 20 is never negative.
    Rows without conv_id belong to no conversation and give nothing. Repeated rows are turns of their own. A family's
    turns pass through one task as a stream, of which it holds HELD nodes. An empty table has no root and gives no rows.
    Returns one row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        (F.col("conv_id").cast("long") - F.pmod(F.col("conv_id").cast("long"), F.lit(FAMILY))).alias("family"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"),
        F.unhex(F.sha2(turn.cast("binary"), 256)).alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    ordered = rows.repartition("family").sortWithinPartitions("family", "conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    parts, _ = materialise(ordered.select("family", "conv_id", "digest", "words").mapInArrow(_families, _PART))
    merged = parts.groupBy("a", "b").agg(
        F.sum("n").alias("n"), F.min("first").alias("conv_id"), F.max("parent_a").alias("parent_a"), F.max("parent_b").alias("parent_b"),
        F.max("depth").alias("depth"), F.max("words").alias("words"), F.sum(F.size("ends")).alias("n_ends"), F.min(F.get("ends", F.lit(0))).alias("one_end"),
    )
    merged, _ = materialise(merged)
    children = merged.where("depth > 0").groupBy(F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n") == 1).alias("n_single"))
    nodes, _ = materialise(merged.join(children, ["a", "b"], "left").fillna(0, ["n_children", "n_single"]))
    parents = nodes.where("n_children > 0").select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(parents, ["parent_a", "parent_b"], "left").join(_subtrees(nodes), ["a", "b"], "left").join(_ends(parts, nodes), ["a", "b"], "left")
    one = F.sha2(F.when(F.col("n_ends") == 0, "").otherwise(F.col("one_end").cast("string")).cast("binary"), 256)
    return found.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("sha", one).alias("ends_sha256"),
    )

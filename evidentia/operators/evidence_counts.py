"""Distributions of many fields of evidence in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..sources.tables import written
from .audit import field_state
from .proposals import gate_order

#: Distinct values that a task sums up before it passes its counts on.
HELD = 50_000
#: Bytes of rows that wait to be grouped at once.
WAITING = 32 << 20
#: Hosts that have rows of their own; the others are counted together.
HOSTS = 31
_PART = "dimension string, value string, n long, first long"


def _grouped(rows: pa.Table, n: tuple[str, str], first: str) -> pa.Table:
    """value, n and first of each value but null; n: the column to count or sum up, and which of both."""
    found = rows.group_by("value", use_threads=False).aggregate([n, (first, "min")])
    return pa.table({"value": found["value"], "n": found["_".join(n)], "first": found[f"{first}_min"]}).filter(pc.field("value").is_valid())


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each column's values and where they were seen first, over all batches of a task. Batches wait until they
    are worth grouping: a group for each value of each small batch takes longer than the rows."""
    held: dict[str, pa.Table] = {}
    waiting: list[pa.RecordBatch] = []

    def take() -> None:
        table = pa.Table.from_batches(waiting)
        waiting.clear()
        for name in table.schema.names:
            if name != "__at":
                found = _grouped(pa.table({"value": table[name], "p": table["__at"]}), ("p", "count"), "p")
                held[name] = _grouped(pa.concat_tables([held[name], found]), ("n", "sum"), "first") if name in held else found

    def rows() -> Iterator[pa.RecordBatch]:
        for name, found in held.items():
            yield from found.add_column(0, "dimension", pa.repeat(name, found.num_rows)).combine_chunks().to_batches()
        held.clear()

    for batch in batches:
        waiting.append(batch)
        if sum(b.nbytes for b in waiting) > WAITING:
            take()
            if sum(t.num_rows for t in held.values()) > HELD:
                yield from rows()
    if waiting:
        take()
    yield from rows()


def counted(rows: DataFrame, position: Column, values: dict[str, Column], capped: tuple[str, ...] = (), cap: int = HOSTS) -> DataFrame:
    """Distributions of several expressions in one pass: dimension, value, n. Nulls aren't counted.

    A task sums up its own rows and shuffles a row for each value it has met, so what is shuffled grows with
    distinct values and tasks, never with rows. Of the capped dimensions only the cap values that stand first by
    position have rows; the others are OTHER, for which the counts are written once and read twice. position is a
    long without nulls; an empty table gives no rows.
    """
    narrow = rows.select(position.cast("long").alias("__at"), *[v.cast("string").alias(k) for k, v in values.items()])
    found = narrow.mapInArrow(_summed, _PART).groupBy("dimension", "value").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    if not capped:
        return found.drop("first")
    found, _ = written(found)
    limited = F.col("dimension").isin(*capped)
    place = F.row_number().over(Window.partitionBy("dimension").orderBy("first", "value"))
    early = found.where(limited).withColumn("__k", place).where(F.col("__k") <= cap).select("dimension", "value", F.lit(True).alias("__early"))
    named = found.join(F.broadcast(early), ["dimension", "value"], "left")  # no more than cap rows a dimension
    value = F.when(~limited | F.col("__early"), F.col("value")).otherwise("OTHER")
    return named.groupBy("dimension", value.alias("value")).agg(F.sum("n").alias("n"))


#: Columns that are shown only where they are plain tokens; the content type without its parameters, in lower case.
TOKENS = ("transport_error", "document_status", "page_kind", "source_provenance", "canonical_related", "body_available", "factual_substance", "relation", "validation", "metadata_status", "path", "final_endpoint", "consistency", "initial_host", "failing_host", "mismatch", "content_type")
#: Fields that make up the signature of a rejection.
SIGNATURE = ("rejection_gate", "http_status", "transport_error", "content_type", "principal_document_status", "page_kind", "source_provenance", "canonical_related", "body_available", "factual_substance", "semantic_relation", "semantic_response_validation", "host_transition", "acquisition_path")


def evidence_fields(evidence: DataFrame, position: str) -> DataFrame:
    """The position, the 27 fields of evidence that are counted, and its two states, by name. Fields behind a gate
    that was not reached say so. What several fields need is a column of its own first, so that it is computed once.
    Plain tokens are checked as one array: an expression for each of them makes code too long to be compiled."""
    c, rejected = F.col, F.col("state") != "READY"
    tokens = F.array(*[c(t).cast("string") for t in TOKENS[:-1]], F.lower(F.substring_index(F.nullif(c("content_type"), F.lit("")), ";", 1)))
    reached = evidence.withColumns({
        "__tokens": F.transform(tokens, lambda t: text.safe_token(t)), "__gate": gate_order(c("gate")),
        "__candidate": F.nullif(urls.host(c("candidate_url")), F.lit("")), "__resolved": F.nullif(urls.host(c("resolved_url")), F.lit("")),
    })
    token = lambda name: c("__tokens")[TOKENS.index(name)]
    behind = lambda name, after: field_state(token(name), c("__gate"), after)
    moved = F.when(c("__candidate").isNull() | c("__resolved").isNull(), "RESOLVED_HOST_MISSING").when(c("__candidate") == c("__resolved"), "SAME_HOST").otherwise("CHANGED_HOST")
    reason, gate = F.coalesce("reject_reason", F.lit("UNKNOWN")), F.coalesce("gate", F.lit("UNKNOWN"))
    fields = {
        "ready_count": F.when(~rejected, "READY"), "rejected_count": F.when(rejected, "REJECTED"),
        "reject_reason": F.when(rejected, reason), "rejection_gate": F.when(rejected, gate), "reason_gate": F.when(rejected, F.concat_ws("|", reason, gate)),
        "http_status": c("status_code").cast("string"), "transport_error": behind("transport_error", 2),
        "content_type": token("content_type"),
        "principal_document_status": behind("document_status", 6), "page_kind": token("page_kind"), "source_provenance": behind("source_provenance", 5),
        "canonical_related": behind("canonical_related", 5), "body_available": behind("body_available", 6), "factual_substance": behind("factual_substance", 8),
        "semantic_relation": behind("relation", 9), "semantic_response_validation": behind("validation", 9),
        "metadata_extraction_status": F.coalesce(token("metadata_status"), F.when(rejected, "NOT_REACHED")),
        "candidate_hostname": c("__candidate"), "resolved_hostname": c("__resolved"), "redirect_hop_count": dates.hop_bucket(c("hops")), "host_transition": moved,
        "acquisition_latency_bucket": dates.latency_bucket(c("elapsed_ms")), "acquisition_path": token("path"), "acquisition_final_endpoint": token("final_endpoint"),
        "acquisition_redirect_consistency": token("consistency"), "acquisition_initial_hostname": token("initial_host"),
        "acquisition_failing_endpoint_hostname": token("failing_host"), "source_provenance_mismatch": token("mismatch"),
    }
    named = reached.select(c(position).alias("__at"), *[v.alias(k) for k, v in fields.items()])
    signature = F.concat_ws(";", *[F.coalesce(p, F.lit("-")) for p in SIGNATURE])
    return named.withColumn("rejection_signature", F.when(c("rejected_count").isNotNull(), signature))


def evidence_distributions(evidence: DataFrame, position: str) -> DataFrame:
    """dimension, value, n of 27 fields of evidence and the counts of its two states, in one pass over the rows.

    evidence: position (long), state, reject_reason, gate (one of proposals.GATES), status_code, transport_error, content_type,
    document_status, page_kind, source_provenance, canonical_related, body_available, factual_substance, relation,
    validation, metadata_status, candidate_url, resolved_url, hops, elapsed_ms, path, final_endpoint, consistency,
    initial_host, failing_host, mismatch; all may be null. Four dimensions of hosts keep the hosts seen first.
    """
    hosts = ("candidate_hostname", "resolved_hostname", "acquisition_initial_hostname", "acquisition_failing_endpoint_hostname")
    fields = evidence_fields(evidence, position)
    return counted(fields, F.col("__at"), {c: F.col(c) for c in fields.columns if c != "__at"}, capped=hosts)

"""Replay of what a run has recorded: saved proposals behind their digests, and records rebuilt without their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import plain_json

#: The version of saved proposals that can be read.
VERSION = "scope-v1"


def digest(value: Column, kind: S.DataType) -> Column:
    """SHA-256 of a value's plain JSON text; of a text as it is."""
    return F.sha2((value if isinstance(kind, S.StringType) else plain_json.plain(value, kind)).cast("binary"), 256)


def saved(artifacts: DataFrame, version: str = VERSION) -> DataFrame:
    """artifacts with version and the digests of content, metadata, request and proposal: what a run saves.

    artifacts: candidate_id, title, content (text), metadata and proposal (structs, or null), parse_status."""
    rows = artifacts.withColumns({"version": F.lit(version), "content_sha256": digest(F.col("content"), S.StringType()), "metadata_sha256": digest(F.col("metadata"), artifacts.schema["metadata"].dataType)})
    return rows.withColumns({"request_sha256": _request(rows), "proposal_sha256": F.when(F.col("proposal").isNotNull(), digest(F.col("proposal"), artifacts.schema["proposal"].dataType))})


def _request(rows: DataFrame) -> Column:
    asked = F.struct("candidate_id", "title", "content_sha256", "metadata_sha256")
    return digest(asked, rows.select(asked.alias("x")).schema["x"].dataType)


def replayable(artifacts: DataFrame, version: str = VERSION) -> DataFrame:
    """artifacts with status and reason: FAIL at the first digest that doesn't belong to what was saved, BLOCKED without a
    parsed proposal, else READY, which may be judged again with no call to anyone. Missing digests are wrong ones."""
    wrong = lambda recorded, own: ~F.coalesce(F.col(recorded) == own, F.lit(False))
    kind = lambda c: artifacts.schema[c].dataType
    parsed = F.coalesce(F.col("parse_status") == "PARSED", F.lit(False)) & F.col("proposal").isNotNull()
    reason = (
        F.when(wrong("version", F.lit(version)), "UNSUPPORTED_VERSION")
        .when(F.col("content").isNull() | wrong("content_sha256", digest(F.col("content"), S.StringType())), "SOURCE_CONTENT_DIGEST_MISMATCH")
        .when(F.col("metadata").isNull() | wrong("metadata_sha256", digest(F.col("metadata"), kind("metadata"))), "SOURCE_METADATA_DIGEST_MISMATCH")
        .when(wrong("request_sha256", _request(artifacts)), "REQUEST_IDENTITY_DIGEST_MISMATCH").when(~parsed, "NO_REPLAYABLE_PARSED_PROPOSAL")
        .when(wrong("proposal_sha256", digest(F.col("proposal"), kind("proposal"))), "PROPOSAL_DIGEST_MISMATCH")
    )
    rows = artifacts.withColumn("reason", reason)
    return rows.withColumn("status", F.when(F.col("reason").isNull(), "READY").when(F.col("reason") == "NO_REPLAYABLE_PARSED_PROPOSAL", "BLOCKED").otherwise("FAIL"))


def rebuilt(entries: DataFrame) -> DataFrame:
    """candidate_id, content_key, body and focus (spans) of the records of an audited run, rebuilt without their texts.

    entries: candidate_id, content_sha256 (or null), excerpt (array of sentence ids S1, S2 ..., null or empty: S1),
    region_id (or null). Records of one content get one body, with as many sentences as the greatest index that any of
    them cites, so that equal sources are equal again; an established region stands in a line of its own.
    """
    cited = F.when(F.coalesce(F.size("excerpt"), F.lit(0)) > 0, F.col("excerpt")).otherwise(F.array(F.lit("S1")))
    index = F.transform(cited, lambda s: F.substring(s, F.lit(2), F.length(s)).try_cast("int"))
    rows = entries.select("candidate_id", F.coalesce("content_sha256", F.col("candidate_id").cast("string")).alias("content_key"), index.alias("index"), "region_id")
    sizes = rows.groupBy("content_key").agg(F.max(F.array_max("index")).alias("sentences"))
    line = lambda i: F.concat(F.col("content_key"), F.lit(" sentence "), i.cast("string"), F.lit("."))
    whole = rows.join(sizes, "content_key").withColumn("lines", F.transform(F.sequence(F.lit(1), "sentences"), line))
    # numbers of one length make lines of one length, so a line begins after all digits before it
    digits = lambda i: F.aggregate(F.array(*[F.lit(10**k) for k in range(9)]), F.lit(0), lambda a, p: a + F.greatest(i - p, F.lit(0)))
    fixed = F.length("content_key") + F.length(F.lit(" sentence .")) + 1
    start = lambda i: ((i - 1) * fixed + digits(i)).cast("int")
    span = lambda i: F.struct(start(i).alias("start"), (start(i) + F.length(line(i))).cast("int").alias("end"))
    body = F.concat(F.array_join("lines", "\n"), F.coalesce(F.concat(F.lit("\nRegion "), "region_id"), F.lit("")))
    return whole.select("candidate_id", "content_key", body.alias("body"), F.transform("index", span).alias("focus"))

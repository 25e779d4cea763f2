"""Evidence of candidates: redirects, provenance, and the ordered gates that decide whether a source counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls


def clean_chain(chain: Column) -> Column:
    """Resource keys of the hops; null if one of them is no usable url."""
    return F.when(F.forall(chain, urls.exact), F.transform(chain, urls.resource_key))


def path_kind(chain: Column) -> Column:
    """DIRECT, REDIRECTED or UNKNOWN (no chain, or a hop that can't be read)."""
    known = clean_chain(chain)
    return F.when(known.isNull() | (F.size(known) == 0), "UNKNOWN").when(F.size(F.array_distinct(known)) == 1, "DIRECT").otherwise("REDIRECTED")


def provenance_violation(candidate: Column, resolved: Column, chain: Column) -> Column:
    """Why the ends of a chain aren't the candidate's and the resolved url, else null."""
    known = clean_chain(chain)
    return (
        F.when(known.isNull() | (F.size(known) == 0), "CHAIN_UNKNOWN")
        .when(F.element_at(known, 1) != urls.resource_key(candidate), "START_MISMATCH")
        .when(F.element_at(known, -1) != urls.resource_key(resolved), "END_MISMATCH")
    )


def canonical_related(canonical: Column, resolved: Column, chain: Column) -> Column:
    """Whether a page's canonical url is the resolved one or a hop on the way."""
    key = urls.resource_key(canonical)
    return F.coalesce((key == urls.resource_key(resolved)) | F.exists(clean_chain(chain), lambda k: k == key), F.lit(False))


def textual(content_type: Column) -> Column:
    return F.coalesce(F.regexp_like(F.lower(content_type), F.lit("html|text|xml")), F.lit(False))


def substantial(body: Column, headlines: Column) -> Column:
    """Whether a body says more than its title or a headline."""
    key = text.lookup_key(body)
    return F.coalesce((key != "") & ~F.exists(headlines, lambda h: text.lookup_key(h) == key), F.lit(False))


# The reason that each gate rejects with.
REASONS = {
    "URL_VALIDATION": "URL_UNRESOLVED", "LINK_RESOLUTION": "URL_UNRESOLVED", "FETCH_TRANSPORT": "CONTENT_UNAVAILABLE", "HTTP_STATUS": "CONTENT_UNAVAILABLE",
    "CONTENT_TYPE": "CONTENT_UNAVAILABLE", "SOURCE_PROVENANCE": "SOURCE_PAGE_MISMATCH", "PRINCIPAL_DOCUMENT": "INSUFFICIENT_SUBSTANCE",
    "BODY_AVAILABILITY": "INSUFFICIENT_SUBSTANCE", "FACTUAL_SUBSTANCE": "TITLE_ONLY",
}


def judged(rows: DataFrame) -> DataFrame:
    """rows with state (READY or REJECTED), gate and reason of the first gate that fails.

    rows: url, resolved_url, fetched (boolean), status_code, content_type, chain (array), document_status,
    body, headlines (array).
    """
    good = {
        "URL_VALIDATION": urls.exact(F.col("url")),
        "LINK_RESOLUTION": urls.exact(F.col("resolved_url")),
        "FETCH_TRANSPORT": F.col("fetched"),
        "HTTP_STATUS": F.col("status_code").between(200, 299),
        "CONTENT_TYPE": textual(F.col("content_type")),
        "SOURCE_PROVENANCE": provenance_violation(F.col("url"), F.col("resolved_url"), F.col("chain")).isNull(),
        "PRINCIPAL_DOCUMENT": F.col("document_status") != "COLLECTION",
        "BODY_AVAILABILITY": F.trim("body") != "",
        "FACTUAL_SUBSTANCE": substantial(F.col("body"), F.col("headlines")),
    }
    gate = F.lit(None).cast("string")
    for name, passed in reversed(good.items()):
        gate = F.when(F.coalesce(passed, F.lit(False)), gate).otherwise(name)
    reason = F.lit(None).cast("string")
    for name, why in REASONS.items():
        reason = F.when(F.col("gate") == name, F.lit(why)).otherwise(reason)
    return rows.withColumn("gate", gate).withColumn("state", F.when(F.col("gate").isNull(), "READY").otherwise("REJECTED")).withColumn("reason", reason)


def source_display(publisher: Column, declared_host: Column, page_host: Column) -> Column:
    """The publisher's name if it is short and its host is that of the page, else the page's host."""
    own = F.coalesce(urls.same_publisher(declared_host, page_host), F.lit(False))
    return F.when(own & (F.length(F.trim(publisher)).between(1, 80)), F.trim(publisher)).otherwise(page_host)


def catalogue_text(*fields: Column) -> Column:
    """The stated fields of a record, one a line."""
    return F.concat_ws("\n", *[F.nullif(F.trim(f), F.lit("")) for f in fields])

"""Opaque links of an aggregator, and addresses that may be fetched."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Bytes that an id with an embedded url starts with, and the start of a payload that holds none.
EMBEDDED, SEALED = "081322", "AU_yqL"


def link_id(url: Column, aggregator: str) -> Column:
    """The opaque id in an article url of the aggregator's host; null for any other url."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?" + rf"(?i:{aggregator.replace('.', '[.]')})" + r"(?::\d*)?/(?:rss/)?(?:articles|read)/([A-Za-z0-9_-]+)", 1)
    return F.when(found != "", found)


def embedded_url(link: Column, own_domain: str) -> Column:
    """The publisher's url inside an opaque id, without a request; null where there is none.

    The id is URL-safe Base64 of a marker, a length (one byte, or two of seven bits each) and that many
    bytes of UTF-8. Only http and https urls with a host outside own_domain count.
    """
    padded = F.concat(F.translate(link, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(link), F.lit(4))))
    raw = F.try_to_binary(padded, F.lit("base64"))
    byte = lambda at: F.conv(F.substring(F.hex(raw), 2 * at - 1, 2), 16, 10).cast("int")
    long_form = byte(4) >= 128
    size = F.when(long_form, byte(4) - 128 + byte(5) * 128).otherwise(byte(4))
    body = F.substr(raw, F.when(long_form, 6).otherwise(5), size)
    said = F.trim(F.try_validate_utf8(body.cast("string")))
    host = F.lower(F.regexp_extract(said, r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    outside = (host != "") & (host != own_domain) & ~host.endswith("." + own_domain)
    return F.when(F.hex(raw).startswith(EMBEDDED) & ~said.startswith(SEALED) & outside, said)


def resolved_links(links: DataFrame, recorded: DataFrame, aggregator: str, own_domain: str, key: Sequence[str] = ("url",)) -> DataFrame:
    """links with publisher_url and method: DIRECT (no opaque link), EMBEDDED, RECORDED (the answer of an earlier
    request) or UNRESOLVABLE. links: url; recorded: url, publisher_url; key: the columns by which a link has its answer, where
    several links have the same url. Of several answers for a key the least one counts, so that no link is repeated."""
    kept = list(links.columns)
    known = recorded.groupBy(*key).agg(F.min("publisher_url").alias("__known"))
    found = links.join(known, list(key), "left")
    opaque = link_id(F.col("url"), aggregator)
    inside = embedded_url(opaque, own_domain)
    method = F.when(opaque.isNull(), "DIRECT").when(inside.isNotNull(), "EMBEDDED").when(F.col("__known").isNotNull(), "RECORDED").otherwise("UNRESOLVABLE")
    return found.select(*kept, F.when(opaque.isNull(), F.col("url")).otherwise(F.coalesce(inside, "__known")).alias("publisher_url"), method.alias("method"))


@F.pandas_udf(BooleanType())
def public_ip(address: pd.Series) -> pd.Series:
    """Whether an IPv4 or IPv6 address is reachable for all; false for anything else. An IPv4 address inside an IPv6 one decides."""

    def judged(value) -> bool:
        try:
            ip = ipaddress.ip_address(value)
        except ValueError:
            return False
        ip = getattr(ip, "ipv4_mapped", None) or ip
        closed = ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_unspecified or ip.is_multicast or ip.is_reserved
        return ip.is_global and not closed

    return address.map(judged, na_action=None).astype(bool)

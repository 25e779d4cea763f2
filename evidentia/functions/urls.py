"""Url expressions. The normal forms differ on purpose: one strips tracking, one identifies pages, one names the resource."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING_PREFIX, TRACKING = "utm_", ("fbclid", "gclid")


def _part(url: Column, group: int) -> Column:
    """scheme, authority, path, query (with its ?) of a url without its fragment."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", group)


def _port_is_legal(url: Column) -> Column:
    port = F.regexp_extract(_part(url, 2), r":([^:\]]*)$", 1)
    return (port == "") | (F.regexp_like(port, F.lit(r"^\d{1,5}$")) & (F.coalesce(port.try_cast("int"), F.lit(99999)) <= 65535))


def strip_tracking(url: Column) -> Column:
    """Without fragment and tracking parameters, whose names may be percent-encoded; everything else as it is. Empty
    for anything but http and https with a host and a legal port."""
    bare = F.trim(url)
    query = F.substr(_part(bare, 4), F.lit(2))

    def name(p: Column) -> Column:
        raw = F.substring_index(p, "=", 1)
        return F.lower(F.coalesce(F.try_url_decode(raw), raw))

    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~name(p).startswith(TRACKING_PREFIX) & ~name(p).isin(*TRACKING)), "&")
    clean = F.concat(_part(bare, 1), F.lit("://"), _part(bare, 2), _part(bare, 3), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    usable = F.lower(_part(bare, 1)).isin("http", "https") & (_part(bare, 2) != "") & _port_is_legal(bare)
    return F.when(usable, clean).otherwise("")


def identity_form(url: Column) -> Column:
    """Lower-case scheme and authority, no slash at the end of the path (but / for the root), query kept, no
    fragment; empty for anything but http and https with a host."""
    bare = F.trim(url)
    path = F.regexp_replace(_part(bare, 3), "/+$", "")
    whole = F.concat(F.lower(_part(bare, 1)), F.lit("://"), F.lower(_part(bare, 2)), F.when(path == "", "/").otherwise(path), F.when(_part(bare, 4) == "?", "").otherwise(_part(bare, 4)))
    return F.when(F.lower(_part(bare, 1)).isin("http", "https") & (_part(bare, 2) != ""), whole).otherwise("")


def host(url: Column) -> Column:
    """Lower-case host without user, port and a leading www. Most have neither user nor port, so one is asked for first."""
    authority = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    bare = F.when(F.contains(authority, F.lit("@")) | F.contains(authority, F.lit(":")), F.regexp_replace(authority, r"^.*@|:\d*$", "")).otherwise(authority)
    return F.when(F.startswith(bare, F.lit("www.")), F.substr(bare, F.lit(5))).otherwise(bare)


def resource_key(url: Column) -> Column:
    """scheme, host, port other than the scheme's own, path (/ if empty) and query, in one string."""
    scheme = F.lower(_part(url, 1))
    port = F.regexp_extract(_part(url, 2), r":(\d+)$", 1)
    own = F.when(scheme == "https", "443").when(scheme == "http", "80").otherwise("")
    path = F.when(_part(url, 3) == "", "/").otherwise(_part(url, 3))
    return F.concat_ws("|", scheme, host(url), F.when(port == own, "").otherwise(port), path, F.substr(_part(url, 4), F.lit(2)))


def exact(url: Column) -> Column:
    """Whether a url can be used as it is: http or https, a host, a legal port, no spaces or control characters, no broken %xx."""
    return F.coalesce(
        F.lower(_part(url, 1)).isin("http", "https") & (host(url) != "") & _port_is_legal(url)
        & ~F.regexp_like(url, F.lit(r"[\s\x00-\x1f\x7f]")) & ~F.regexp_like(url, F.lit("%(?![0-9A-Fa-f]{2})")),
        F.lit(False),
    )


def same_publisher(a: Column, b: Column) -> Column:
    """Whether two hosts are equal or one is a subdomain of the other; null where one isn't declared."""
    return F.when((a != "") & (b != ""), (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a)))


def joined(base: Column, ref: Column) -> Column:
    """ref as it is meant on a page at base: absolute, with the scheme, from the root, a query, or beside the page. Leading ./ and ../ are resolved."""
    place = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    folder = F.regexp_replace(_part(base, 3), "[^/]*$", "")
    up = F.length(F.regexp_extract(ref, r"^(?:\.\./|\./)*", 0)) - F.length(F.replace(F.regexp_extract(ref, r"^(?:\.\./|\./)*", 0), F.lit("../"), F.lit("")))
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - (up / 3).cast("int"), F.lit(0)))
    beside = F.concat(place, F.lit("/"), F.array_join(F.transform(kept, lambda p: F.concat(p, F.lit("/"))), ""), F.regexp_replace(ref, r"^(?:\.\./|\./)*", ""))
    return (
        F.when(F.regexp_like(ref, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), ref).when(F.startswith(ref, F.lit("//")), F.concat(_part(base, 1), F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(place, ref)).when(F.startswith(ref, F.lit("?")), F.concat(place, _part(base, 3), ref)).when(ref == "", base).otherwise(beside)
    )


#: Characters of a page in which its head stands.
HEAD = 20_000


def amp_canonical(content: Column, resolved: Column) -> Column:
    """The article that an AMP page declares as its canonical one, if it declares exactly one, on the same host, and
    another than the page itself; else empty."""
    head = F.left(F.coalesce(content, F.lit("")), F.lit(HEAD))
    links = F.regexp_extract_all(head, F.lit(r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical[\"']?[^>]*>"), F.lit(0))
    href = F.regexp_extract(F.get(links, F.lit(0)), r"(?i)\bhref\s*=\s*[\"']([^\"']+)[\"']", 1)
    found = strip_tracking(joined(resolved, F.trim(F.coalesce(href, F.lit("")))))
    good = F.regexp_like(head, F.lit(r"(?i)<html\b[^>]*?\s(?:\u26a1|amp)[\s=>/]")) & (F.size(links) == 1) & (F.coalesce(href, F.lit("")) != "") & (found != "") & (found != strip_tracking(resolved)) & (host(found) == host(resolved))
    return F.when(good, found).otherwise("")

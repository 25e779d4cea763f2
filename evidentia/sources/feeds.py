"""Feed documents, embedded catalogues, byte bodies, and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_FIELD = "array<struct<_VALUE:string,_url:string>>"
#: Fields of an item as they may stand in a feed: any number of times, whatever the contract says.
FEED = f"channel array<struct<item:array<struct<title:{_FIELD},link:{_FIELD},source:{_FIELD},pubDate:{_FIELD},description:{_FIELD}>>>>, malformed string"
_ROOT = r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)*<(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)"
#: A field's name, and whether an item must have it.
FIELDS = (("title", True), ("link", True), ("source", False), ("pubDate", False), ("description", False))


def _field_fault(item: Column, name: str, required: bool) -> Column:
    """Why a field of an item ends the whole document, or null: it stands twice, or it is required and missing or blank."""
    values = item[name]
    number = F.coalesce(F.size(values), F.lit(0))
    missing = F.when(number <= 0, f"MISSING_{name.upper()}").when(F.coalesce(F.trim(values[0]["_VALUE"]), F.lit("")) == "", f"EMPTY_{name.upper()}")
    return F.when(number > 1, f"REPEATED_{name.upper()}").otherwise(missing if required else F.lit(None))


def feed_documents(feeds: DataFrame) -> DataFrame:
    """feed_id, status, reason, items (array) of feed documents. feeds: feed_id, body (RSS).

    Spark's XML reader takes a document apart by a schema in which every field may repeat. A document is taken whole
    or not at all: INVALID_RESPONSE where it is no XML, has another root or not exactly one channel, or where an
    item has a field twice, or no title or link; else SUCCESS_WITH_RESULTS or SUCCESS_ZERO_RESULTS. The first
    reason in the order of the document is given. Null bodies are no XML.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    parsed = F.from_xml(body, FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed", "ignoreSurroundingSpaces": "false", "nullValue": "\u0001"})
    rows = feeds.select("feed_id", F.regexp_extract(body, _ROOT, 1).alias("root"), parsed.alias("x"))
    items = F.coalesce(F.col("x.channel")[0]["item"], F.array())
    faults = F.filter(F.transform(items, lambda i: F.coalesce(*[_field_fault(i, n, r) for n, r in FIELDS])), lambda f: f.isNotNull())
    channels = F.coalesce(F.size("x.channel"), F.lit(0))
    rows = rows.select("feed_id", "root", F.col("x.malformed").alias("malformed"), channels.alias("channels"), items.alias("items"), F.get(faults, F.lit(0)).alias("fault"))
    reason = (
        F.when(F.col("malformed").isNotNull() | (F.col("root") == ""), "MALFORMED").when(F.lower("root") != "rss", "UNEXPECTED_ROOT")
        .when(F.col("channels") != 1, "CHANNELS").otherwise(F.col("fault"))
    )
    status = F.when(F.col("reason").isNotNull(), "INVALID_RESPONSE").when(F.size("items") > 0, "SUCCESS_WITH_RESULTS").otherwise("SUCCESS_ZERO_RESULTS")
    return rows.withColumn("reason", reason).select("feed_id", status.alias("status"), "reason", "items")


def feed_items(feeds: DataFrame) -> DataFrame:
    """Entries of sound feed documents: feed_id, ordinal (from 0), title, link, publisher, published, snippet (as they
    stand, empty where there is none) and publisher_url (trimmed)."""
    # a filter on the status would take every document apart once more; one on the rows of the outer form doesn't
    entry = F.posexplode_outer(F.when(F.col("status") == "SUCCESS_WITH_RESULTS", F.col("items"))).alias("ordinal", "item")
    rows = feed_documents(feeds).select("feed_id", entry).where("ordinal is not null")
    text = lambda n: F.coalesce(F.get(F.col(f"item.{n}._VALUE"), F.lit(0)), F.lit(""))
    optional = lambda n: F.when(F.trim(text(n)) == "", "").otherwise(text(n))
    return rows.select(
        "feed_id", "ordinal", text("title").alias("title"), text("link").alias("link"), optional("source").alias("publisher"), optional("pubDate").alias("published"),
        optional("description").alias("snippet"), F.trim(F.coalesce(F.get(F.col("item.source._url"), F.lit(0)), F.lit(""))).alias("publisher_url"),
    )


def request_status(status: Column) -> Column:
    """Typed outcome of a request's HTTP status."""
    return F.when(status == 200, "SUCCESS").when(status.isin(401, 403), "AUTHENTICATION").when(status == 429, "RATE_LIMIT").otherwise("INVALID")


def embedded_entries(pages: DataFrame, schema: str) -> DataFrame:
    """Entries of a JSON list in a page's <script type="application/json">: page_id, ordinal, entry."""
    raw = F.regexp_extract("html", r'(?s)<script type="application/json">(.*?)</script>', 1)
    return pages.select("page_id", F.posexplode(F.from_json(raw, f"array<{schema}>")).alias("ordinal", "entry"))


#: Charsets by their names; others are read as UTF-8, which ASCII is a part of.
CHARSETS = {"utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "UTF-8", "ascii": "UTF-8", "iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE"}
#: Bytes of a page in which its meta tag stands.
META_BYTES = 4096


def charset(body: Column, content_type: Column) -> Column:
    """The charset that the header names, else that of a meta tag, else UTF-8 (also for names that Spark doesn't know)."""
    head = F.decode(F.substring(body, 1, META_BYTES), "ISO-8859-1")
    named = [F.lower(F.regexp_extract(c, p, 1)) for c, p in ((content_type, r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)"), (head, r"(?i)<meta[^>]*?charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)"))]
    names = F.create_map(*[F.lit(x) for kv in CHARSETS.items() for x in kv])
    return F.coalesce(*[F.try_element_at(names, F.coalesce(n, F.lit(""))) for n in named], F.lit("UTF-8"))


def _sound_utf16(body: Column, little: Column) -> Column:
    """Whether all units of two bytes are characters or pairs of surrogates; others would end the whole job."""
    digits = F.hex(body)
    lone = lambda *patterns: F.regexp_like(digits, F.lit("|".join(f"^(?:[0-9A-F]{{4}})*?{p}" for p in patterns)))
    backward = lone("..D[89AB](?!..D[C-F])", "(?<!..D[89AB])..D[C-F]")
    return (F.octet_length(body) % 2 == 0) & ~F.when(little, backward).otherwise(lone("D[89AB]..(?!D[C-F])", "(?<!D[89AB]..)D[C-F]"))


def decoded(body: Column, content_type: Column) -> Column:
    """Bytes as text, in their charset. Bytes that UTF-8 has no character for are replaced; what is not sound UTF-16 is
    read as UTF-8, so that no page ends a job. Null stays null."""
    name = charset(body, content_type)
    little = (name == "UTF-16LE") | ((name == "UTF-16") & F.startswith(F.hex(body), F.lit("FFFE")))
    wide = F.when(little & (name == "UTF-16LE"), F.decode(body, "UTF-16LE")).when(name == "UTF-16BE", F.decode(body, "UTF-16BE")).otherwise(F.decode(body, "UTF-16"))
    plain = F.when(name == "ISO-8859-1", F.decode(body, "ISO-8859-1")).otherwise(F.make_valid_utf8(body.cast("string")))
    return F.when(F.startswith(name, F.lit("UTF-16")) & _sound_utf16(body, little), wide).otherwise(plain)


def write_report(report: DataFrame, path: str) -> None:
    """report: one row with text. Written as one Markdown file."""
    report.select(F.col("text").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)

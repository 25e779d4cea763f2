"""URL filter: listed rules first, else a weighted vocabulary found by Aho-Corasick with boundary checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import materialise
from .url_vocabulary import Vocabulary, as_listed

#: One of these rejects.
STRICT = ("casino", "porn", "porno", "xxx", "viagra", "cialis", "sexcam", "escort", "jackpot", "malware", "phishing", "warez", "spam")
#: SOFT_HITS different ones of these reject.
SOFT = ("cheap", "pills", "pharmacy", "loan", "loans", "payday", "bonus", "win", "winner", "free", "bet", "betting", "poker", "slots", "dating", "adult", "replica", "discount", "crack", "torrent", "clickbait", "seo", "backlinks", "farm", "lottery", "sexy")
SOFT_HITS = 2
#: Rules up to this number are one expression; more of them are joined to the suffixes of the hosts, with the same result.
INLINE_RULES = 200


@dataclass(frozen=True)
class Rule:
    """A host and a path, like `example.net/en/`, and whether urls below it are allowed."""

    place: str
    allow: bool

    @property
    def host(self) -> str:
        return self.place.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.place.partition("/")[2]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct(place, allow), else null."""
    found = F.lit(None).cast("struct<place:string,allow:boolean>")
    for rule in sorted(rules, key=lambda r: (len(r.place), r.place)):  # a longer one overrides
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.place).alias("place"), F.lit(rule.allow).alias("allow"))).otherwise(found)
    return found


def _joined_rules(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rows with __rule, as rule_of() gives it, for any number of rules: each host meets the rules of its own
    suffixes, and the longest of those whose path fits is kept. A host has few suffixes, so nothing grows."""
    listed = rows.sparkSession.createDataFrame([(r.host, r.path, r.place, r.allow) for r in rules], "__host string, __path string, place string, allow boolean").dropDuplicates(["place"])
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    numbered = rows.withColumn("__row", F.struct(F.monotonically_increasing_id(), F.spark_partition_id()))
    met = numbered.select("__row", "host", "path", F.explode(suffixes).alias("__host")).join(listed, "__host").where(F.col("path").startswith(F.col("__path")))
    best = met.groupBy("__row").agg(F.max_by(F.struct("place", "allow"), F.struct(F.length("place"), "place")).alias("__rule"))
    return numbered.join(best, "__row", "left").drop("__row")


def hits(url: str, terms: ahocorasick.Automaton, compounds: bool = False) -> tuple[list[str], list[str]]:
    """Distinct strict and soft terms whose forms stand between boundaries: characters other than letters and digits
    or, with compounds, other pieces that lead to such a boundary without a gap."""
    text = url.lower()
    met = [(end + 1 - length, end + 1, term) for end, (length, term) in terms.iter(text)]
    found: tuple[set, set] = (set(), set())
    if any(term for *_, term in met):
        before, after = set(), set()  # places that pieces reach from a boundary, and from which they reach one
        opens = lambda at: at == 0 or not text[at - 1].isalnum() or at in before
        closes = lambda at: at == len(text) or not text[at].isalnum() or at in after
        if compounds:
            for s, e, _ in sorted(met, key=lambda m: m[0]):
                if opens(s):
                    before.add(e)
            for s, e, _ in sorted(met, key=lambda m: -m[1]):
                if closes(e):
                    after.add(s)
        for s, e, term in met:
            if term and opens(s) and closes(e):
                found[not term[1]].add(term[0])
    return sorted(found[0]), sorted(found[1])


def _counts(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = vocabulary.automaton()
        kind = pa.list_(pa.string())
        for batch in batches:
            found = [hits(x, terms, vocabulary.compounds) if x else ([], []) for x in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([s for s, _ in found], kind), pa.array([s for _, s in found], kind)], names=["page_id", "url", "strict_terms", "soft_terms"])

    return run


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = (), strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_hits: int = SOFT_HITS, vocabulary: Vocabulary | None = None) -> DataFrame:
    """A verdict for each url: that of the longest rule that fits, else block on one strict term or on
    soft_hits different soft terms, else allow. A vocabulary takes the place of strict and soft; its forms of
    one term are one hit.

    pages needs page_id (long) and url; other columns are ignored. A null url, an empty one and one
    without :// have an empty host and path; their text is searched all the same. Rows come back one
    for one; nothing is shuffled.
    Returns page_id, host, path, rule (null without), verdict, strict_terms, soft_terms.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.mapInArrow(_counts(vocabulary or as_listed(strict, soft)), "page_id long, url string, strict_terms array<string>, soft_terms array<string>")
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "strict_terms", "soft_terms")
    rows = rows.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules)) if len(rules) <= INLINE_RULES else _joined_rules(materialise(rows)[0], rules)
    bad = (F.size("strict_terms") > 0) | (F.size("soft_terms") >= soft_hits)
    allowed = F.coalesce(F.col("__rule.allow"), ~bad)
    return rows.select("page_id", "host", "path", F.col("__rule.place").alias("rule"), F.when(allowed, "allow").otherwise("block").alias("verdict"), "strict_terms", "soft_terms")

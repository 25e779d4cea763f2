"""Plan items, their execution, and candidates from what they found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text, urls
from .ordering import running


def plan_items(markets: DataFrame, families: DataFrame, bindings: DataFrame) -> DataFrame:
    """Markets times families, where a family without listed markets takes all, and the binding of both isn't UNSUPPORTED.

    markets: market, profile; families: family, intent, markets (array); bindings: profile, provider,
    support. All are small dimensions. Returns market, profile, family, intent, provider.
    """
    fields = families.select("family", "intent", F.coalesce("markets", F.array().cast("array<string>")).alias("markets"))
    listed = fields.select("family", "intent", F.explode(F.array_distinct("markets")).alias("market"))
    # families for all markets meet them on the empty list that both carry
    open_ = fields.where(F.size("markets") == 0).select("family", "intent", F.lit(0).alias("__all"))
    met = markets.join(listed, "market").select("market", "profile", "family", "intent")
    met = met.unionByName(markets.withColumn("__all", F.lit(0)).join(open_, "__all").select("market", "profile", "family", "intent"))
    return met.join(bindings, "profile").where("support <> 'UNSUPPORTED'").select("market", "profile", "family", "intent", "provider")


#: The intent that runs in a monthly check only.
MONITORED = "MONITORED_STANDARDS"


def intents_due(items: DataFrame, check_due: Column) -> DataFrame:
    """Plan items whose intent is due: the monitored one only where a monthly check is (null: is not)."""
    return items.where((F.col("intent") != MONITORED) | F.coalesce(check_due, F.lit(False)))


#: What plan items are ordered by.
ORDER = ("intent_place", "market", "profile", "family", "provider", "language", "anchor", "term", "query")


def canonical_order(items: DataFrame) -> DataFrame:
    """items with position (from 1) in the order of ORDER, nulls first. Ranges of the order are numbered side by side."""
    keys = [F.col(c).asc_nulls_first() for c in ORDER]
    found = running(items.withColumn("__plan", F.lit(0)), ["__plan"], keys, name="position")
    return found.withColumn("position", F.col("position") + 1).drop("__plan")


def unbound(markets: DataFrame, bindings: DataFrame) -> DataFrame:
    """Markets whose profile has no binding at all."""
    return markets.join(bindings.select("profile").distinct(), "profile", "left_anti").select("market")


def without_items(dimension: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Values of a dimension for which the plan has no item."""
    return dimension.select(key).distinct().join(items.select(key), key, "left_anti")


def concrete_requests(items: DataFrame, templates: Sequence[str], anchors: Sequence[str], terms: Column, most: int) -> DataFrame:
    """One request for each template, anchor and term of an item: query, and fits (whether the item has no more than most)."""
    named = items.withColumn("__terms", terms)
    combined = len(templates) * max(1, len(anchors)) * F.size("__terms")
    rows = named.withColumn("fits", combined <= most).withColumn("template", F.explode(F.array(*[F.lit(t) for t in templates])))
    rows = rows.withColumn("anchor", F.explode(F.array(*[F.lit(a) for a in anchors or ("",)]))).withColumn("term", F.explode("__terms"))
    return rows.withColumn("query", text.filled(F.col("template"), market=F.col("market"), anchor=F.col("anchor"), term=F.col("term"))).drop("__terms", "template")


def executed(items: DataFrame, order: str, failed: Column) -> DataFrame:
    """items with executed: a run stops after the first failure of the infrastructure, what follows isn't attempted."""
    first = items.where(failed).agg(F.min(order).alias("__stop"))
    return items.crossJoin(F.broadcast(first)).withColumn("executed", F.col("__stop").isNull() | (F.col(order) <= F.col("__stop"))).drop("__stop")


def request_url(base: str, query: Column, start: Column, end: Column) -> Column:
    """A source's url with the window as part of its query; the end is exclusive there."""
    window = F.concat(query, F.lit(" after:"), start.cast("string"), F.lit(" before:"), F.date_add(end, 1).cast("string"))
    return F.concat(F.lit(base + "?q="), F.url_encode(window))


def acquisitions(attempts: DataFrame, plan: DataFrame) -> DataFrame:
    """Results of successful attempts, one row each: plan_item_id, intent, ordinal (from 0), and the result's fields.
    attempts: plan_item_id, status, results (array of struct); plan: plan_item_id, intent."""
    good = attempts.where("status = 'SUCCESS_WITH_RESULTS'").join(plan.select("plan_item_id", "intent"), "plan_item_id")
    return good.select("plan_item_id", "intent", F.posexplode("results").alias("ordinal", "r")).select("plan_item_id", "intent", "ordinal", "r.*")


def catalogue_entries_in(entries: DataFrame, start: Column, end: Column) -> DataFrame:
    """Entries dated in the window; undated ones only while their status is Superseding."""
    return entries.where(F.when(F.col("day").isNull(), F.col("status") == "Superseding").otherwise(F.col("day").between(start, end)))


def conflicting_occurrences(rows: DataFrame, keys: Sequence[str], payload: Column) -> DataFrame:
    """Keys that came with different payloads."""
    return rows.groupBy(*keys).agg(F.count_distinct(payload).alias("payloads")).where("payloads > 1").select(*keys)


def normalised(found: DataFrame) -> DataFrame:
    """Candidates of acquisitions: one for each exact url, with a representative, and all origins.

    found: acquisition_id, url, title, publisher, published_at, snippet, intent. Urls that can't be used as
    they are are left out, and equal rows of one acquisition count once. The representative is the least by
    (title, publisher, published_at, snippet); the intent is the least on its own.
    Returns candidate_id, url, title, publisher, published_at, snippet, intent, origins (sorted array).
    """
    order = ("title", "publisher", "published_at", "snippet")
    kept = found.where(urls.exact(F.col("url"))).dropDuplicates(["acquisition_id", "url", *order, "intent"])
    rows = kept.groupBy("url").agg(F.min(F.struct(*order)).alias("r"), F.min("intent").alias("intent"), F.array_sort(F.collect_set("acquisition_id")).alias("origins"))
    return rows.select(ids.content_id("cand_", url=F.col("url")).alias("candidate_id"), "url", "r.*", "intent", "origins")


def observations(plan: DataFrame, attempts: DataFrame, origins: DataFrame) -> DataFrame:
    """One row for each plan item: status (NOT_ATTEMPTED without an attempt), results, and distinct candidates.
    origins: plan_item_id, candidate_id."""
    counts = origins.groupBy("plan_item_id").agg(F.count_distinct("candidate_id").alias("candidates"))
    rows = plan.select("plan_item_id").join(attempts.select("plan_item_id", "status", F.size("results").alias("results")), "plan_item_id", "left").join(counts, "plan_item_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("plan_item_id", F.coalesce("status", F.lit("NOT_ATTEMPTED")).alias("status"), zero(F.greatest("results", F.lit(0))).alias("results"), zero("candidates").alias("candidates"))


def acceptance(observed: DataFrame) -> DataFrame:
    """One row: BLOCK if nothing was attempted or all attempts failed, PASS_WITH_GAPS if some did, else LEGAL."""
    counts = observed.agg(F.count_if(F.col("status") != "NOT_ATTEMPTED").alias("attempted"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status") == "NOT_ATTEMPTED").alias("missed"))
    state = F.when(F.col("attempted") == F.col("failed"), "BLOCK").when(F.col("failed") + F.col("missed") > 0, "PASS_WITH_GAPS").otherwise("LEGAL")
    return counts.withColumn("acceptance", state)


def attempt_failures(plan: DataFrame, attempts: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Failed attempts in the order of the plan, with what is known of them: position, plan_item_id, failure, status_code."""
    rows = attempts.where("status = 'FAILED'").select("plan_item_id").join(plan.select("plan_item_id", "position"), "plan_item_id", "left")
    return rows.join(diagnostics.select("plan_item_id", "failure", "status_code"), "plan_item_id", "left").select("position", "plan_item_id", F.coalesce("failure", F.lit("UNKNOWN")).alias("failure"), "status_code")

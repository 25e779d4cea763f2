"""Events out of records: sources and facts that make a pair one event, recorded proposals, and what a group comes to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, ids, urls

#: Roles that are first hand; how many sentences and characters of each record a request shows, the
#: fullest first; the characters of a request; and how many procedures must agree on a pair.
FIRST_HAND = ("first_party", "first_hand", "operator_notice", "government_notice")
TIERS = ((6, 900), (4, 600), (3, 450), (2, 300))
REQUEST_SIZE = 66_000
AGREEING = 2


def source_key(url: Column, body: Column, focus_ids: Column) -> Column:
    """Equal for records of one source: the same page, text and focus."""
    return F.sha2(F.to_json(F.struct(urls.identity_form(url).alias("url"), F.sha2(body, 256).alias("body"), focus_ids.alias("focus"))), 256)


def exact_source_pairs(records: DataFrame, key: Column, id_column: str) -> DataFrame:
    """(left_id, right_id) of each record and the least record of its source, in as many rows as there are records.
    For components that says all; a complete link needs every pair, so give it the least records alone where more than
    two records share a source, and let the others follow theirs."""
    keyed = records.select(F.col(id_column).alias("right_id"), key.alias("__key"))
    least = keyed.groupBy("__key").agg(F.min("right_id").alias("left_id"))
    return keyed.join(least, "__key").where("left_id <> right_id").select("left_id", "right_id")


def region_conflicts(pairs: DataFrame, regions: DataFrame) -> DataFrame:
    """Pairs of which both have an established region, and not the same. regions: candidate_id, region_id."""
    known = regions.where("region_id is not null")
    left = known.select(F.col("candidate_id").alias("left_id"), F.col("region_id").alias("__left"))
    right = known.select(F.col("candidate_id").alias("right_id"), F.col("region_id").alias("__right"))
    return pairs.join(left, "left_id").join(right, "right_id").where("__left <> __right").select("left_id", "right_id")


def placements(nominated: DataFrame, confirmed: DataFrame) -> DataFrame:
    """What became of each nominated member: PLACED, SEPARATED (in another group of the answer), OMITTED or MEMBER_INVALID.

    nominated: procedure, group_no, candidate_id, lead (the group's first member); confirmed: procedure,
    group_no, candidate_id, part (group of the answer), valid.
    """
    answer = confirmed.groupBy("procedure", "group_no", "candidate_id").agg(F.min("part").alias("part"), F.min("valid").alias("valid"))
    rows = nominated.join(answer, ["procedure", "group_no", "candidate_id"], "left")
    leads = answer.select("procedure", "group_no", F.col("candidate_id").alias("lead"), F.col("part").alias("__lead_part"))
    rows = rows.join(leads, ["procedure", "group_no", "lead"], "left")
    state = F.when(F.col("part").isNull(), "OMITTED").when(~F.col("valid"), "MEMBER_INVALID").when(F.col("part") == F.col("__lead_part"), "PLACED").otherwise("SEPARATED")
    return rows.select("procedure", "group_no", "candidate_id", state.alias("placement"))


def first_verdicts(verdicts: DataFrame) -> DataFrame:
    """One verdict for each procedure and pair: that of the earliest nomination that decided it. verdicts: procedure, nomination, left_id, right_id, same."""
    return verdicts.groupBy("procedure", "left_id", "right_id").agg(F.min_by("same", "nomination").alias("same"))


def agreed_pairs(verdicts: DataFrame, least: int = AGREEING) -> DataFrame:
    """Pairs that enough procedures call the same."""
    same = first_verdicts(verdicts).where("same")
    return same.groupBy("left_id", "right_id").agg(F.count_distinct("procedure").alias("procedures")).where(F.col("procedures") >= least)


def records_in_order(records: DataFrame) -> DataFrame:
    """records with place and place_reversed by (normal form of the url, id): the order of the first and of the second nomination."""
    rows = records.withColumn("__url", urls.identity_form(F.col("url")))
    up, down = Window.partitionBy("batch").orderBy("__url", "candidate_id"), Window.partitionBy("batch").orderBy(F.desc("__url"), F.desc("candidate_id"))
    return rows.withColumn("place", F.row_number().over(up)).withColumn("place_reversed", F.row_number().over(down)).drop("__url")


def publication_order(rows: DataFrame, batch: str) -> DataFrame:
    """rows with position (from 1) by instant of publication, raw text and id; what can't be read comes first."""
    order = Window.partitionBy(batch).orderBy(F.asc_nulls_first("__at"), "published_at", "candidate_id")
    return rows.withColumn("__at", dates.mail_instant(F.col("published_at"))).withColumn("position", F.row_number().over(order)).drop("__at")


def short_references(rows: DataFrame, owner: str, order: str, prefix: str) -> DataFrame:
    """rows with reference: prefix and their number in the order of their owner."""
    return rows.withColumn("reference", F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(owner).orderBy(order))))


def tier(payloads: DataFrame, batch: str, limit: int = REQUEST_SIZE) -> DataFrame:
    """The fullest tier in which a batch fits into one request: batch, tier, size; without one the last tier, to be
    cut. payloads: batch, tier, size of each record."""
    sums = payloads.groupBy(batch, "tier").agg(F.sum("size").alias("size"))
    fits = F.min(F.when(F.col("size") <= limit, F.struct("tier", "size")))
    last = F.max(F.struct("tier", "size"))
    return sums.groupBy(batch).agg(F.coalesce(fits, last).alias("t")).select(batch, "t.*")


def leading_sentences(sentences: DataFrame, record: str, order: str, size: Column, number: int, budget: int) -> DataFrame:
    """The first sentences of a record that a tier shows: at most number, and no more than budget in all but for the first."""
    along = Window.partitionBy(record).orderBy(order)
    rows = sentences.withColumn("__sum", F.sum(size).over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(along))
    return rows.where((F.col("__n") == 1) | ((F.col("__n") <= number) & (F.col("__sum") <= budget))).drop("__sum", "__n")


def events(groups: DataFrame, records: DataFrame) -> DataFrame:
    """One row for each group: event_id, member_ids (sorted), canonical (first-hand before others, then by the normal
    form of the url and the id), and basis (which facts all its members state alike).

    groups: group_id, candidate_id; records: candidate_id, url, source_role, facts (map). The id is a hash of the members' ids.
    """
    rows = groups.join(records, "candidate_id")
    first = F.struct((~F.col("source_role").isin(*FIRST_HAND)).alias("later"), urls.identity_form(F.col("url")).alias("url"), "candidate_id")
    found = rows.groupBy("group_id").agg(F.array_sort(F.collect_set("candidate_id")).alias("member_ids"), F.min(first).alias("first"))
    stated = rows.select("group_id", "candidate_id", F.explode("facts").alias("fact", "value")).where(F.trim("value") != "")
    alike = stated.groupBy("group_id", "fact").agg(F.count_distinct(F.lower(F.trim("value"))).alias("values"), F.count_distinct("candidate_id").alias("stating"))
    basis = alike.where("values = 1").groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("fact", "stating"))).alias("facts"))
    joined = found.join(basis, "group_id", "left")
    size = F.size("member_ids")
    named = F.transform(F.filter(F.coalesce("facts", F.array()), lambda f: f["stating"] == size), lambda f: f["fact"])
    return joined.select("group_id", ids.content_id("evt_", 24, members=F.col("member_ids")).alias("event_id"), "member_ids", F.col("first.candidate_id").alias("canonical"), named.alias("basis"))


def uncertain_pairs(groups: DataFrame, candidates: DataFrame, same: DataFrame) -> DataFrame:
    """Candidate pairs that ended in different groups though something spoke for them: left_id, right_id, together.
    candidates and same are pairs (left_id, right_id) of the same blocks; groups: group_id, candidate_id."""
    left = groups.select(F.col("candidate_id").alias("left_id"), F.col("group_id").alias("__left"))
    right = groups.select(F.col("candidate_id").alias("right_id"), F.col("group_id").alias("__right"))
    rest = candidates.join(same, ["left_id", "right_id"], "left_anti")
    return rest.join(left, "left_id").join(right, "right_id").select("left_id", "right_id", (F.col("__left") == F.col("__right")).alias("together"))


def procedure_counts(details: DataFrame, value: str) -> DataFrame:
    """Numbers out of lines like "nomination 2 of procedure 3: 14 pairs": procedure, nomination, pairs (summed)."""
    part = lambda p: F.regexp_extract(value, p, 1).cast("int")
    rows = details.where(F.regexp_like(value, F.lit(r"nomination \d+ of procedure \d+: \d+ pairs")))
    rows = rows.select(part(r"procedure (\d+)").alias("procedure"), part(r"nomination (\d+)").alias("nomination"), part(r": (\d+) pairs").alias("pairs"))
    return rows.groupBy("procedure", "nomination").agg(F.sum("pairs").alias("pairs"))


def replay_differences(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """Groups (as sorted arrays of members) that only one of two runs has: members, side."""
    listed = lambda g: g.groupBy("group_id").agg(F.array_sort(F.collect_set("candidate_id")).alias("members")).select("members")
    a, b = listed(found), listed(recorded)
    return a.exceptAll(b).withColumn("side", F.lit("found")).unionByName(b.exceptAll(a).withColumn("side", F.lit("recorded")))


def group_order(groups: DataFrame) -> DataFrame:
    """Groups in the order of their member arrays."""
    return groups.orderBy("member_ids")


def pair_list(groups: DataFrame, members: Sequence[str] = ("left_id", "right_id")) -> DataFrame:
    """Unordered pairs inside groups of a proposal, which are small by contract."""
    a, b = members
    left = groups.select("group_id", F.col("candidate_id").alias(a))
    return left.join(groups.select("group_id", F.col("candidate_id").alias(b)), "group_id").where(F.col(a) < F.col(b)).select(a, b)

"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import materialise, quoted, small

#: Sweeps over all marginals in one job, and the largest relative change of a weight in a sweep at which fitting stops.
SWEEPS = 4
TOLERANCE = 1e-9
#: Jobs at most, and by how much a marginal may be missed without a warning.
MOST_JOBS, LOOSE = 25, 1e-6
#: Cells up to this number are fitted in one task, more of them in a shuffle for each marginal.
LOCAL_CELLS = 100_000
#: A weight grows to this multiple of its bound at most where bounded marginals contradict each other.
STEEPEST = 1e12


def text_form(text: Column) -> Column:
    """A topic for tables without one: what form the text has."""
    return (
        F.when(text.contains(" | "), "table")
        .when(F.regexp_like(text, F.lit("[0-9]")), "record")
        .when(F.octet_length(text) < 500, "note")
        .otherwise("prose")
    )


def _targets(cells: DataFrame, column: str, power: float, given: Mapping[str, float] | None) -> DataFrame:
    """column and its target share: that of given, or else tempered from the natural one."""
    name = f"__to_{column}"
    if given is not None:
        total = sum(given.values())
        share = F.lit(0.0)
        for value, weight in given.items():
            share = F.when(F.col(column) == value, F.lit(weight / total)).otherwise(share)
        return cells.select(column).distinct().select(F.col(column).alias(name + "_of"), share.alias(name))
    sums = cells.groupBy(column).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("raw"))
    total = sums.agg(F.sum("raw").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select(F.col(column).alias(name + "_of"), (F.col("raw") / F.col("total")).alias(name))


def _scaled(state: DataFrame, by: list[str], amount: str, cap: str, to: Column, ties: list[str]) -> DataFrame:
    """amount times one factor for each group of by, so that the sum of least(amount, cap) is to.

    That sum is the least of the lines "the first k amounts times the factor, and the caps of the others"
    over amounts in order of amount / cap, so the factor is the largest at which such a line meets to.
    """
    whole = Window.partitionBy(*by)
    upto = whole.orderBy(F.col(amount) / F.col(cap), *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    free = F.sum(amount).over(upto)
    line = F.when(free > 0, (to - (F.sum(cap).over(whole) - F.sum(cap).over(upto))) / free)
    state = state.withColumn("__line", line)
    factor = F.coalesce(F.max("__line").over(whole), F.lit(0.0))
    return state.withColumn(amount, F.least(F.col(amount) * factor, F.col(cap) * F.lit(STEEPEST))).drop("__line")


def _reachable(cells: DataFrame, column: str, to: DataFrame, wanted: float) -> DataFrame:
    """Targets of which none asks for more than all tokens of its value; what such values can't give is
    spread over the other values in proportion to their targets."""
    name = f"__to_{column}"
    held = cells.groupBy(F.col(column).alias(name + "_of")).agg((F.sum("tokens") / F.lit(wanted)).alias("held"))
    rows = to.join(held, name + "_of").coalesce(1).withColumn("all", F.lit(1))
    total = F.least(F.lit(1.0), F.sum(F.when(F.col(name) > 0, F.col("held"))).over(Window.partitionBy("all")))
    rows = _scaled(rows.withColumn("total", total), ["all"], name, "held", F.col("total"), [name + "_of"])
    return rows.select(name + "_of", F.least(name, "held").alias(name))


def rake(
    cells: DataFrame, columns: list[str], power: float, targets: Mapping[str, Mapping[str, float]] | None = None, wanted: float | None = None,
) -> DataFrame:
    """Weights (sum 1) of the cells that meet the target share of every value of every column.

    cells: the columns (strings) and tokens (positive). Each sweep scales the weights to one marginal
    after another. Values of target 0 get weight 0. The ratios between cells that a marginal doesn't
    force stay as they are in the corpus.

    wanted is the number of tokens that weight 1 stands for. A cell then never gets more than its tokens:
    a sweep fixes the cells that would at all their tokens and scales the others to what is left of the
    marginal. First, targets beyond all tokens of a value are lowered to these, and the other values of
    the column take the rest (_reachable). Marginals that still contradict each other under these bounds
    end with the last column met, the others missed, and the sum at 1; a warning then says by how much
    (marginals() says which).
    """
    current, seen = materialise(cells.select(*columns, F.col("tokens").cast("double").alias("tokens")), bytes=F.coalesce(F.sum(F.octet_length(F.concat_ws("", *columns))), F.lit(0)))
    count, width = seen["rows"], seen["bytes"] // max(1, seen["rows"]) + 16
    weighted = current.withColumn("weight", F.col("tokens"))
    if wanted is not None:
        weighted = weighted.withColumn("__cap", F.col("tokens") / F.lit(wanted))
    for column in columns:
        to = _targets(current, column, power, (targets or {}).get(column))
        to = small(to if wanted is None else _reachable(current, column, to, wanted), count, width)
        weighted = weighted.join(to, weighted[column] == to[f"__to_{column}_of"], "left").drop(f"__to_{column}_of")
    held = F.col("weight") if wanted is None else F.least("weight", "__cap")
    for _ in range(MOST_JOBS):
        state = weighted.coalesce(1) if count <= LOCAL_CELLS else weighted
        for sweep in range(SWEEPS):
            for k, column in enumerate(columns):
                to, now = F.col(f"__to_{column}"), F.sum(held).over(Window.partitionBy(column))
                if sweep == SWEEPS - 1 and k == 0:  # what the last sweep starts from, and by how much the first marginal is missed there
                    state = state.withColumn("__before", held)
                    state = state.withColumn("__off", F.when(to > 0, F.abs(now / to - 1)).otherwise(F.lit(0.0)))
                if wanted is None:
                    state = state.withColumn("weight", F.when(now > 0, F.col("weight") * to / now).otherwise(F.lit(0.0)))
                else:
                    state = _scaled(state, [column], "weight", "__cap", to, columns)
        moved = F.abs(held - F.col("__before")) / F.greatest(held, F.lit(1e-300))
        weighted, seen = materialise(state, off=F.max("__off"), moved=F.max(moved))
        weighted = weighted.drop("__off", "__before")
        if not seen["moved"] or seen["moved"] <= TOLERANCE:
            break
    if seen["off"] and seen["off"] > LOOSE:
        warnings.warn(f"marginals contradict each other under their bounds: one is missed by {seen['off']:.2%}", stacklevel=2)
    return weighted.select(*columns, "tokens", held.alias("weight"))


def marginals(raked: DataFrame, columns: list[str]) -> DataFrame:
    """What a result of rake() comes to: column, value, natural and reached share, one row for each value of each column."""
    sums = raked.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(
        F.grouping_id(*[F.col(c) for c in columns]).alias("set"), F.sum("tokens").alias("tokens"), F.sum("weight").alias("reached")
    )
    sets = {(1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i)): c for i, c in enumerate(columns)}
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, c in sets.items():
        name, value = F.when(F.col("set") == k, F.lit(c)).otherwise(name), F.when(F.col("set") == k, F.col(c)).otherwise(value)
    whole = Window.partitionBy("column")
    return sums.select(name.alias("column"), value.alias("value"), "tokens", "reached").select("column", "value", (F.col("tokens") / F.sum("tokens").over(whole)).alias("natural"), "reached")


def uniform(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone: 52 bits of its SHA-256."""
    bits = F.conv(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 13), 16, 10).cast("long")
    return F.coalesce(bits / F.lit(float(1 << 52)), F.lit(0.0))


def mix(
    docs: DataFrame, fraction: float = 0.5, power: float = 0.5, topic: Column | None = None, tokens: Column | None = None,
    targets: Mapping[str, Mapping[str, float]] | None = None, **carry: Column,
) -> DataFrame:
    """Documents with calibrated sampling probabilities, and which of them are drawn.

    Token counts by (source, lang, topic) are raked to the target shares of sources, languages and
    topics, where no cell gets more than all its tokens: what a full cell can't give, others give. A
    document's probability is its cell's weight over the cell's natural share, times the wanted fraction
    of all tokens. So the wanted tokens are reached, and every target that the corpus can meet. It is drawn if a number that only depends on its doc_id
    is below that, so repeated rows are drawn or left together, and a rerun draws the same.

    docs: doc_id, text, source, lang; other columns are ignored. Null source, lang or topic are a value of their own (""). topic
    is an expression over docs (default: the form of the text), tokens the size of a document (default:
    a token for each 4 bytes, rounded up, at least 1). targets gives shares by column (source, lang,
    topic) and value; values it doesn't name get none. Columns without are tempered: natural share to a power.
    Cells are summed before they are shuffled, so a source with a third of all rows is one row a task.
    carry names expressions that are returned too. Rows come back one for one, repeated ones too; null texts
    count as empty, a null doc_id as one id like others. An empty table gives none.

    Returns doc_id, source, lang, topic, tokens, probability, kept, and what carry names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    topic = text_form(text) if topic is None else topic
    tokens = F.greatest(F.ceil(F.octet_length(text) / 4), F.lit(1)) if tokens is None else tokens
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), named(F.col("source")).alias("source"), named(F.col("lang")).alias("lang"), named(topic).alias("topic"),
        tokens.cast("long").alias("tokens"), *[c.alias(k) for k, c in carry.items()],
    )
    columns = ["source", "lang", "topic"]
    cells, seen = materialise(rows.groupBy(*columns).agg(F.sum("tokens").alias("tokens")), total=F.sum("tokens"), bytes=F.sum(F.octet_length(F.concat_ws("", *columns))))
    wanted = max(fraction * float(seen["total"] or 1), 1e-9)
    raked = rake(cells, columns, power, targets, wanted)
    chance = raked.select(*columns, F.least(F.col("weight") * F.lit(wanted) / F.col("tokens"), F.lit(1.0)).alias("probability"))
    found = rows.join(small(chance, seen["rows"], (seen["bytes"] or 0) // max(1, seen["rows"]) + 16), columns)
    return found.select("doc_id", *columns, "tokens", "probability", (uniform(F.col("doc_id")) < F.col("probability")).alias("kept"), *[quoted(c) for c in carry])

"""Mixing sources to target weights over a domain - language - source tree, in DataFrame operations only.

Capacities (tokens times ``max_epochs``) are summed from leaves to the root, then a token budget goes down. At each
node the budget is shared among the children by weight; a child whose capacity is below its share gets its capacity, and
what it lacks goes to its siblings by their weights. Only what all siblings together lack is seen one level up, where the
node's capacity is the sum of its children's. So shortages move to siblings before they move to ancestors.
Shares are whole tokens; tokens left by rounding go to the first children that are not full.

A leaf with budget b and t tokens takes all rows b div t times (epochs 0, 1, ...) and, in one more epoch, the token
prefix of b mod t in the order of md5(seed, epoch, doc_id). The end of the prefix is found without sorting a leaf: tokens are
summed per cell of leading digits of the order key, the cell that crosses the budget is summed by further digits, and only
rows of one cell of that are ordered. Rows are then compared with their leaf's end; texts are not shuffled. What has a row per
leaf at most (leaves, budgets, cells) is stored, so no plan repeats the steps before it in the driver's memory.

Weights are whole numbers per path (``"domain"``, ``"domain/lang"``, ``"domain/lang/source"``); a path without one has weight
1, a weight of 0 leaves the node out.

Defined results: a null name of a level is the empty name; a null text has no tokens. Rows without tokens come with
full epochs, and with the prefix if they stand before its end. Rows that repeat id and tokens stand together, so the
last of a prefix may be taken more than once. Texts are counted whole, however long. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import ROW, stored, whole_text

LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of the order key per step of the search for a prefix's end: 4,096 cells.
CELL_DIGITS = 3
STEPS = 2
WHOLE = "decimal(20,0)"


@dataclass(frozen=True)
class Mix:
    """``share`` (numerator, denominator) of all available tokens is the budget."""

    weights: dict[str, int] = field(default_factory=dict)
    share: tuple[int, int] = (3, 5)
    max_epochs: int = 2
    seed: int = 42


def domain_of(source: Column) -> Column:
    """Domain of a source: its trailing number modulo 4, ``other`` without one."""
    number = F.expr("try_cast(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') AS int)")
    return F.when(source.isNull() | number.isNull(), F.lit("other")).otherwise(F.concat(F.lit("domain"), (number % 4).cast("string")))


def count_tokens(text: Column) -> Column:
    """Words between white space, the token unit of the mix."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0b\f\r]+")).cast("long")


def _weight(weights: dict[str, int], path: Column) -> Column:
    if not weights:
        return F.lit(1)
    known = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
    return F.coalesce(F.try_element_at(known, path), F.lit(1))


def _share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``budget`` of each child (parent columns, name, weight, cap, total) of nodes with budget ``total``."""
    ratio = F.col("cap").cast("double") / F.col("weight").cast("double")
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(ratio, name)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        children.withColumn("before", F.coalesce(F.sum("cap").over(upto), F.lit(0)).cast(WHOLE))
        .withColumn("onward", F.sum("weight").over(onward).cast("decimal(16,0)"))
        .withColumn("full", F.expr("cap * onward <= weight * (total - before)"))
        .withColumn("rest", (F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0))).cast(WHOLE))
        .withColumn("open_weight", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(by), F.lit(1)).cast("decimal(16,0)"))
        .withColumn("part", F.when(~F.col("full"), F.expr("(weight * rest) div open_weight").cast(WHOLE)))
        .withColumn("odd", (F.col("rest") - F.sum("part").over(by)).cast(WHOLE))
        .withColumn("place", F.sum(F.when(F.col("full"), 0).otherwise(1)).over(order))
    )
    extra = F.when(F.col("place") <= F.col("odd"), 1).otherwise(0)
    return ranked.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.col("part") + extra).cast(WHOLE))


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, tokens and budget of each leaf from (domain, lang, source, tokens)."""
    caps = leaves.withColumn("cap", (F.col("tokens") * mix.max_epochs).cast(WHOLE))
    paths = {k: F.concat_ws("/", *LEVELS[: k + 1]) for k in range(3)}
    for k in range(3):
        caps = caps.withColumn(f"w{k}", _weight(mix.weights, paths[k]).cast("decimal(12,0)"))
    caps = caps.filter("w0 > 0 AND w1 > 0 AND w2 > 0")
    num, den = mix.share
    level = caps.groupBy("domain").agg(F.sum("cap").cast(WHOLE).alias("cap"), F.first("w0").alias("weight"), F.sum("tokens").cast(WHOLE).alias("all"))
    root = Window.partitionBy(F.lit(0))
    budget = F.least(F.expr(f"(all_tokens * {num}) div {den}").cast(WHOLE), F.sum("cap").over(root).cast(WHOLE))
    level = level.withColumn("all_tokens", F.sum("all").over(root)).withColumn("total", budget)
    found = _share_out(level, [], "domain").select("domain", F.col("budget").alias("total"))
    level = caps.groupBy("domain", "lang").agg(F.sum("cap").cast(WHOLE).alias("cap"), F.first("w1").alias("weight"))
    found = _share_out(level.join(found, "domain"), ["domain"], "lang").select("domain", "lang", F.col("budget").alias("total"))
    level = caps.select("domain", "lang", "source", "tokens", "cap", F.col("w2").alias("weight"))
    return _share_out(level.join(found, ["domain", "lang"]), ["domain", "lang"], "source").select(*LEVELS, "tokens", F.col("budget").cast("long").alias("budget"))


def _order_key(mix: Mix) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("full_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def prefix_ends(rows: DataFrame, leaves: DataFrame, mix: Mix) -> DataFrame:
    """For each leaf the number of full epochs and the last row of its prefix.

    Returns (domain, lang, source, full_epochs, end_key, end_id, end_tokens, end_taken); end_key is null without a prefix.
    """
    plan = leaves.filter("tokens > 0").selectExpr(*LEVELS, "budget div tokens AS full_epochs", "budget % tokens AS left")
    part = rows.join(plan.filter("left > 0"), list(LEVELS)).withColumn("okey", _order_key(mix))
    part = part.select(*LEVELS, "doc_id", "n_tokens", "okey", "left")
    for step in range(STEPS):
        cell = F.substring("okey", 1 + step * CELL_DIGITS, CELL_DIGITS)
        before = Window.partitionBy(*LEVELS).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        crossing = (
            part.groupBy(*LEVELS, "left", cell.alias("cell"))
            .agg(F.sum("n_tokens").alias("n"))
            .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .filter("before < left AND before + n >= left")
            .select(*LEVELS, "cell", (F.col("left") - F.col("before")).alias("still"))
        )
        crossing = stored(crossing, "mix-cells")
        part = (
            part.withColumn("cell", cell)
            .join(crossing, [*LEVELS, "cell"])
            .select(*LEVELS, "doc_id", "n_tokens", "okey", F.col("still").alias("left"))
        )
    upto = Window.partitionBy(*LEVELS).orderBy("okey", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        part.withColumn("before", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0)))
        .filter("before < left AND before + n_tokens >= left")
        .groupBy(*LEVELS)
        .agg(F.min(F.struct("okey", "doc_id", "n_tokens", (F.col("left") - F.col("before")).alias("taken"))).alias("end"))
        .select(
            *LEVELS,
            F.col("end.okey").alias("end_key"),
            F.col("end.doc_id").alias("end_id"),
            F.col("end.n_tokens").alias("end_tokens"),
            F.col("end.taken").alias("end_taken"),
        )
    )
    return plan.drop("left").join(last, list(LEVELS), "left")


def _named(docs: DataFrame, domain: Column | None) -> DataFrame:
    """Input rows as ``_row`` with doc_id, the names of the levels and n_tokens."""
    rows = docs.select(F.struct("*").alias(ROW), "doc_id", "lang", "source", count_tokens(whole_text()).alias("n_tokens"))
    rows = rows.withColumn("domain", domain if domain is not None else domain_of(F.col("source")))
    return rows.select(ROW, "doc_id", "n_tokens", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEVELS])


def mix_rows(docs: DataFrame, mix: Mix, domain: Column | None = None) -> DataFrame:
    """Input rows as ``_row`` with doc_id, domain, lang, source, epoch, n_tokens and taken_tokens, once per epoch."""
    rows = _named(docs, domain)
    narrow = stored(rows.select(*LEVELS, "doc_id", "n_tokens"), "mix-rows")
    leaves = stored(narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    ends = stored(prefix_ends(narrow, stored(leaf_budgets(leaves, mix), "mix-budgets"), mix), "mix-ends")
    placed = rows.join(ends, list(LEVELS)).withColumn("okey", _order_key(mix))
    here = F.struct("okey", F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), "n_tokens")
    end = F.struct(F.col("end_key").alias("okey"), F.coalesce("end_id", F.lit(-(2**63))).alias("i"), F.col("end_tokens").alias("n_tokens"))
    in_prefix = F.col("end_key").isNotNull() & (here <= end)
    none = F.array().cast("array<bigint>")
    full = F.when(F.col("full_epochs") > 0, F.sequence(F.lit(0).cast("long"), F.col("full_epochs") - 1)).otherwise(none)
    partial = F.when(in_prefix, F.array(F.col("full_epochs"))).otherwise(none)
    taken = F.when((F.col("epoch") == F.col("full_epochs")) & (here == end), F.col("end_taken")).otherwise(F.col("n_tokens"))
    return placed.withColumn("epoch", F.explode(F.concat(full, partial))).select(
        ROW, "doc_id", *LEVELS, "epoch", "n_tokens", taken.cast("long").alias("taken_tokens")
    )


def mixed_documents(docs: DataFrame, mix: Mix, domain: Column | None = None) -> DataFrame:
    """Whole rows of the mix with their columns, at most once each (``max_epochs`` should be 1)."""
    return mix_rows(docs, mix, domain).filter("epoch = 0").select(f"{ROW}.*")

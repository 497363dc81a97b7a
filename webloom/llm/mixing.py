"""Mixing sources to target weights: hierarchical budgeting (native).

Documents hang on the leaves of a tree of domain, language and source. A budget of
tokens is passed down from the root. At each node the children get shares in
proportion to their weights, but none more than its subtree holds (its tokens times
``max_epochs``); what a child cannot take goes to its siblings by weight. Only what
all siblings together cannot take is missing from their parent's capacity and so
goes to the parent's own siblings. Shares are whole tokens, rounded down.

A leaf takes whole epochs while its budget holds them and, from the next one, the
prefix of the documents in the seeded order of that epoch whose tokens fit. The
prefix is found without sorting a leaf: tokens are summed by the first bits of the
order's hash, and only the rows of the one cell in which the budget ends are sorted.

Cases: a null text has no tokens; such rows come along where their hash falls. Null
domains, languages and sources are nodes of their own, of weight 1. Rows with one
doc_id share a place in the order and are taken together or not at all. An empty
table gives an empty result. Other columns are ignored by ``select`` and kept by
``mix``; a row taken in several epochs is repeated.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.quality import words_of
from webloom.llm.scratch import materialize

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class MixConfig:
    #: Budget in thousandths of all tokens there are.
    budget_permille: int = 600
    max_epochs: int = 2
    seed: int = 17
    #: Domains are groups of sources: the source's number modulo this.
    domains: int = 4
    #: Whole-number weights by level and name; what is not named weighs ``default_weight``.
    weights: dict[str, dict[str, int]] = field(
        default_factory=lambda: {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}
    )
    default_weight: int = 1


def domain_of(source: Column, config: MixConfig) -> Column:
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("long") % config.domains).cast("string")))


def _order_hash(doc_id: Column, epoch: Column, config: MixConfig) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(config.seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def tokens(documents: DataFrame, config: MixConfig, keep_rows: bool = False) -> DataFrame:
    row = [F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")] if keep_rows else []
    return documents.select(
        *row,
        F.col("doc_id").alias("doc_id"),
        domain_of(F.col("source"), config).alias("domain"),
        F.col("lang").alias("lang"),
        F.col("source").alias("source"),
        F.size(words_of(F.coalesce(F.col("text"), F.lit("")))).cast("long").alias("n_tokens"),
    )


def _weight(level: str, config: MixConfig) -> Column:
    weight = F.lit(config.default_weight)
    for name, value in sorted(config.weights.get(level, {}).items()):
        weight = F.when(F.col(level) == name, F.lit(value)).otherwise(weight)
    return weight.cast("long")


def _share(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Budget of each node from its parent's (column ``given``): fill in the order of capacity by weight."""
    level = LEVELS[len(parents)]
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(1))
    ordered = siblings.orderBy(F.col("capacity") / F.col("weight"), F.col(level).asc_nulls_first())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    led = nodes.withColumn("left", F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("rest", F.sum("weight").over(after))
    full = led.withColumn("full", F.col("capacity") * F.col("rest") <= F.col("left") * F.col("weight"))
    # once one is not full none after it is; they share what is left at the first of them
    first = full.withColumn("open", F.min(F.when(~F.col("full"), F.struct(F.col("rest") * -1, "left", F.col("rest").alias("r")))).over(siblings))
    return first.withColumn("given", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("least(capacity, (open.left * weight) DIV open.r)"))).drop(
        "left", "rest", "full", "open", "weight"
    )


def budgets(leaves: DataFrame, total: int, config: MixConfig) -> DataFrame:
    """(domain, lang, source, n_tokens) with ``budget``, for leaves of a tree whose root has ``total`` tokens to give."""
    given = None
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("n_tokens").alias("n_tokens"), (F.sum("n_tokens") * config.max_epochs).alias("capacity")).withColumn("weight", _weight(level, config))
        if given is None:
            nodes = nodes.withColumn("given", F.lit(total).cast("long"))
        else:
            named = given.select(*[F.col(k).alias(f"p_{k}") for k in keys[:-1]], "given")
            same = F.lit(True)
            for k in keys[:-1]:
                same = same & F.col(k).eqNullSafe(F.col(f"p_{k}"))
            nodes = nodes.join(named, same).drop(*[f"p_{k}" for k in keys[:-1]])
        given = _share(nodes, keys[:-1])
    return given.select(*LEVELS, "n_tokens", F.col("given").alias("budget"))


def _same_leaf(suffix: str = "p_") -> Column:
    same = F.lit(True)
    for k in LEVELS:
        same = same & F.col(k).eqNullSafe(F.col(f"{suffix}{k}"))
    return same


def plan(counted: DataFrame, config: MixConfig) -> DataFrame:
    """Per leaf: p_domain, p_lang, p_source, budget, whole epochs, and the last hash taken from the epoch after them. ``counted`` must be a written table."""
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    leaves = counted.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n_tokens"))
    leaf = (
        budgets(leaves, total * config.budget_permille // 1000, config)
        .withColumn("whole", F.when(F.col("n_tokens") > 0, F.expr("budget DIV n_tokens")).otherwise(F.lit(0)))
        .withColumn("over", F.col("budget") - F.col("whole") * F.col("n_tokens"))
        .select(*[F.col(k).alias(f"p_{k}") for k in LEVELS], "budget", "whole", "over")
    )
    leaf = materialize(leaf, "mix-leaves")
    hashed = counted.join(leaf, _same_leaf()).withColumn("h", _order_hash(F.col("doc_id"), F.col("whole"), config)).withColumn("cell", F.substring("h", 1, 3))
    own = [f"p_{k}" for k in LEVELS]
    cells = hashed.groupBy(*own, "over", "cell").agg(F.sum("n_tokens").alias("t"))
    upto = Window.partitionBy(*own).orderBy("cell")
    cells = cells.withColumn("seen", F.sum("t").over(upto))
    ends = cells.where(F.col("seen") > F.col("over")).groupBy(*own).agg(F.min(F.struct("cell", (F.col("seen") - F.col("t")).alias("before"))).alias("e"))
    ends = ends.select(*[F.col(k).alias(f"e_{k}") for k in own], F.col("e.cell").alias("end_cell"), F.col("e.before").alias("before"))
    same_end = F.lit(True)
    for k in own:
        same_end = same_end & F.col(k).eqNullSafe(F.col(f"e_{k}"))
    in_cell = hashed.join(ends, same_end & (F.col("cell") == F.col("end_cell"))).groupBy(*own, "over", "before", "h").agg(F.sum("n_tokens").alias("t"))
    taken = in_cell.withColumn("seen", F.col("before") + F.sum("t").over(Window.partitionBy(*own).orderBy("h"))).where(F.col("seen") <= F.col("over"))
    last = taken.groupBy(*own).agg(F.max("h").alias("last_h")).select(*[F.col(k).alias(f"l_{k}") for k in own], "last_h")
    same_last = F.lit(True)
    for k in own:
        same_last = same_last & F.col(k).eqNullSafe(F.col(f"l_{k}"))
    with_end = leaf.join(ends, same_end, "left").join(last, same_last, "left")
    # nothing of the cell fits: all cells before it; the leaf has no end cell: its budget takes every row once more (only without tokens)
    cut = F.coalesce("last_h", F.when(F.col("end_cell").isNotNull(), F.col("end_cell")).otherwise(F.lit("g")))
    return materialize(with_end.select(*own, "budget", "whole", cut.alias("cut")), "mix-plan")


def _taken(counted: DataFrame, config: MixConfig) -> DataFrame:
    planned = counted.join(plan(counted, config), _same_leaf())
    partial = (_order_hash(F.col("doc_id"), F.col("whole"), config) <= F.col("cut")) & (F.col("whole") < config.max_epochs)
    copies = F.col("whole") + F.when(partial, 1).otherwise(0)
    return planned.withColumn("copies", copies.cast("int")).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))


def select(documents: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """A row for each document row and epoch in which it is taken: doc_id, domain, lang, source, n_tokens, epoch, and the leaf's budget."""
    counted = materialize(tokens(documents, config), "mix-tokens")
    return _taken(counted, config).select("doc_id", *LEVELS, "n_tokens", "epoch", "budget")


def mix(documents: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The rows taken, with all their columns, once for each epoch."""
    counted = materialize(tokens(documents, config, keep_rows=True), "mix-rows")
    return _taken(counted, config).select("row.*")

"""Quality rules: adaptive thresholds from mergeable quantile sketches (native).

Every document gets a few integer measures. Per language and source, each measure
is summarised by a log-linear histogram sketch: a value's bucket is its own value
with all but the six highest bits cleared, so a quantile read from the sketch is
at most 1/32 below the true one. Sketches merge by adding counts; those of a
language are merged from those of its sources, and those of the corpus from those
of the languages, which is where small groups take their thresholds from.

Cases: a null text has no words. A null language or source is a group of its own.
Equal rows are judged alike, each row once. An empty table gives an empty result.
Other columns are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.scratch import materialize

BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[ \t-\r]+"


@dataclass(frozen=True)
class Rule:
    """Reject above ``median + spread * max(q75 - median, slack)``; ``slack`` keeps a spread of zero from rejecting trifles."""

    name: str
    measure: str
    spread: int
    slack: int


RULES = (
    Rule("symbols", "1000000 * n_symbols DIV word_chars", 4, 15000),
    Rule("duplicate_lines", "1000000 * n_dup_lines DIV n_lines", 4, 125000),
    Rule("repeated_words", "1000000 * n_repeat_words DIV n_words", 4, 75000),
    Rule("capitals", "1000000 * n_capitals DIV word_chars", 4, 50000),
    Rule("shouting", "1000000 * n_shouts DIV n_words", 4, 50000),
    Rule("word_length", "1000 * word_chars DIV n_words", 6, 700),
)


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 50
    repeat_percent: int = 50
    #: Groups with fewer documents than this take the thresholds of their language, then of the corpus.
    min_group: int = 200
    rules: tuple[Rule, ...] = field(default=RULES)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _count(characters: str) -> Column:
    return F.regexp_count("text", F.lit(characters)).cast("long")


def words_of(text: Column) -> Column:
    """Words of a text as an array; empty for a blank text."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_CLASS))


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice.

    Sorting 32 hash bits of each window beside its place leaves the few places
    whose bits recur; only there are the windows themselves sorted and compared.
    """

    def places(w: Column) -> Column:
        return F.sequence(F.lit(0), F.size(w) - 3)

    def hashed(w: Column) -> Column:
        return F.sort_array(F.transform(places(w), lambda i: F.shiftleft(F.xxhash64(w[i], w[i + 1], w[i + 2]), 32) + i))

    def members(s: Column, same, value) -> Column:
        """Of a sorted array, the values of the elements equal to a neighbour."""
        rest = F.slice(s, F.lit(2), F.size(s))
        pairs = F.zip_with(s, rest, lambda x, y: F.when(same(x, y), F.array(value(x), value(y))))
        return F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")

    def covered(w: Column) -> Column:
        recurring = _let(hashed(w), lambda s: members(s, lambda x, y: F.shiftrightunsigned(x.bitwiseXOR(y), 32) == 0, place))
        windows = F.sort_array(
            F.transform(recurring, lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("t"), i.alias("i")))
        )
        again = _let(windows, lambda s: members(s, lambda x, y: x["t"] == y["t"], lambda x: x["i"]))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(covered(words))


def measure(documents: DataFrame, keep_rows: bool = False) -> DataFrame:
    """doc_id, lang, source and the integer measures; with ``keep_rows`` the whole input row as ``row`` besides."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source = documents.select(
        *([F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")] if keep_rows else []),
        "doc_id",
        F.col("lang").alias("lang"),
        F.col("source").alias("source"),
        text.alias("text"),
    )
    measures = _let(
        words_of(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        ),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    line_counts = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d")))
    return (
        source.withColumn("_m", measures)
        .withColumn("_l", line_counts)
        .select(
            *(["row"] if keep_rows else []),
            "doc_id",
            "lang",
            "source",
            F.col("_m.n_words").alias("n_words"),
            F.col("_m.word_chars").alias("word_chars"),
            _count("[#*$%&|<>]").alias("n_symbols"),
            (F.col("_l.n") - F.col("_l.d")).alias("n_dup_lines"),
            F.col("_m.n_repeat_words").alias("n_repeat_words"),
            F.col("_l.n").alias("n_lines"),
            _count("[A-Z]").alias("n_capitals"),
            _count("!").alias("n_shouts"),
        )
    )


def base_failed(config: QualityConfig) -> Column:
    return (F.col("n_words") < config.min_words) | (100 * F.col("n_repeat_words") > config.repeat_percent * F.col("n_words"))


def _bucket(value: str) -> str:
    drop = f"(length(bin({value})) - 6)"
    return f"CASE WHEN {value} < 64 THEN {value} ELSE shiftleft(shiftright({value}, {drop}), {drop}) END"


def sketches(measured: DataFrame, config: QualityConfig) -> DataFrame:
    """(lang, source, rule, bucket, n) over the documents that pass the base rules."""
    pairs = ", ".join(f"'{r.name}', CAST({r.measure} AS BIGINT)" for r in config.rules)
    values = measured.where(~base_failed(config)).selectExpr("lang", "source", f"stack({len(config.rules)}, {pairs}) AS (rule, value)")
    return values.groupBy("lang", "source", "rule", F.expr(_bucket("value")).alias("bucket")).agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, config: QualityConfig) -> DataFrame:
    """One row per language and source: the highest value that each rule lets pass."""
    levels = {
        "s": ["lang", "source"],
        "l": ["lang"],
        "c": [],
    }
    limits = F.create_map(*[F.lit(x) for r in config.rules for x in (r.name, r.spread)])
    slacks = F.create_map(*[F.lit(x) for r in config.rules for x in (r.name, r.slack)])
    found = {}
    for level, keys in levels.items():
        merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
        steps = merged.groupBy(*keys, "rule").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("h"), F.sum("n").alias("total"))

        def at(percent: int) -> Column:
            """Bucket of the document of rank ceil(percent/100 * total)."""
            rank = F.floor((F.col("total") * percent + 99) / 100)
            start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("q"))
            return F.aggregate(
                "h",
                start,
                lambda a, x: F.struct(
                    (a["seen"] + x["n"]).alias("seen"),
                    F.when(a["q"].isNull() & (a["seen"] + x["n"] >= rank), x["bucket"]).otherwise(a["q"]).alias("q"),
                ),
                lambda a: a["q"],
            )

        read = steps.select(*keys, "rule", "total", at(50).alias("q50"), at(75).alias("q75"))
        limit = F.col("q50") + limits[F.col("rule")] * F.greatest(F.col("q75") - F.col("q50"), slacks[F.col("rule")])
        found[level] = (
            read.withColumn("limit", limit)
            .groupBy(*keys)
            .agg(F.max("total").alias(f"{level}_n"), F.map_from_entries(F.collect_list(F.struct("rule", "limit"))).alias(f"{level}_limit"))
        )
    joined = (
        found["s"]
        .alias("s")
        .join(found["l"].withColumnRenamed("lang", "of_lang"), F.col("lang").eqNullSafe(F.col("of_lang")))
        .join(found["c"], F.lit(True))
    )
    chosen = F.when(F.col("s_n") >= config.min_group, F.col("s_limit")).when(F.col("l_n") >= config.min_group, F.col("l_limit")).otherwise(F.col("c_limit"))
    return joined.withColumn("chosen", chosen).select(
        F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[F.col("chosen")[r.name].alias(f"max_{r.name}") for r in config.rules]
    )


def judged(measured: DataFrame, config: QualityConfig) -> DataFrame:
    """``measured`` (a written table) with base_failed, kept and the thresholds that applied."""
    limits = thresholds(sketches(measured, config), config)
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_lang", "t_source")
    over = F.lit(False)
    for rule in config.rules:
        over = over | (F.expr(f"CASE WHEN word_chars > 0 THEN {rule.measure} END") > F.col(f"max_{rule.name}"))
    failed = base_failed(config)
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(over, F.lit(False)))


def score(documents: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """A row per document row: its measures, verdicts and the thresholds of its group."""
    result = judged(materialize(measure(documents), "quality"), config)
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return result.select(*first, *[f"max_{r.name}" for r in config.rules])


def keep(documents: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows of ``documents`` that the rules keep, with all their columns."""
    measured = materialize(measure(documents, keep_rows=True), "quality-rows")
    return judged(measured, config).where("kept").select("row.*")

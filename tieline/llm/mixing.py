"""Mixing sources to target weights by iterative proportional fitting.

Token counts per (source, language, topic) cell are raked: scaled to each margin's target in turn until all three
fit. A document's probability follows from its cell's raked share, scaled so that the expected sample has the wanted
size, and a hash of its id decides. DataFrame expressions only; the library's products carry no prose, so the operator
is general.

Cells are aggregated before anything is dealt by a margin, so a hot source or language is a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieline.llm.common import blank_words, stored

MARGINS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
RATE, ROUNDS, SCALINGS = 0.5, 10, 12


def n_words(text: Column) -> Column:
    return F.size(blank_words(text)).cast("bigint")


def text_kind(text: Column, words: Column) -> Column:
    """A topic where the table has none: table (a bar for every ten words), note, article or long text."""
    bars = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^|]+", ""))
    return F.when((bars > 0) & (bars * 10 >= words), "table").when(words < 100, "note").when(words < 1000, "article").otherwise("long")


def cell_tokens(docs: DataFrame) -> DataFrame:
    """Documents with cell columns source, lang, topic and n_tokens summed up per cell."""
    return docs.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))


def temperature_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(margin, share): each value's share of tokens raised to `power` and scaled to sum up to 1."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).where("t > 0").withColumn("p", F.pow(F.col("t").cast("double"), F.lit(power)))
    total = sums.agg(F.sum("p")).first()[0] or 1.0
    return sums.select(margin, (F.col("p") / F.lit(total)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """cells (margins, tokens > 0) with `weight`: token weights whose sums fit the targets' shares of all tokens.

    targets: per margin a table (value, share). A value without a target gets none of the weight. Each round fits every
    margin once. Each fit reads the cells twice (sums and weights), so it is stored before the next one: the plan of a
    step stays small however many there are."""
    total = float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    goals = {m: stored(t.withColumnRenamed("share", "_share"), "targets") for m, t in targets.items()}
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for m, goal in goals.items():
            sums = out.groupBy(m).agg(F.sum("weight").alias("_sum")).join(goal, m, "left")
            factor = sums.select(m, F.when(F.col("_sum") > 0, F.coalesce("_share", F.lit(0.0)) * F.lit(total) / F.col("_sum")).otherwise(0.0).alias("_f"))
            out = stored(out.join(factor, m).withColumn("weight", F.col("weight") * F.col("_f")).select(*cells.columns, "weight"), "raked")
    return out


def sampling_rates(raked: DataFrame, rate: float = RATE, scalings: int = SCALINGS) -> DataFrame:
    """Cells with probability = min(1, c * weight / tokens), c chosen so that the expected tokens are `rate` of all."""
    ratio = F.col("weight") / F.col("tokens")
    c = rate
    total = raked.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    for _ in range(scalings if total else 0):
        got = raked.agg(F.sum(F.least(F.lit(1.0), ratio * F.lit(c)) * F.col("tokens"))).first()[0]
        c = c * rate * total / got if got else c
    return raked.withColumn("probability", F.round(F.least(F.lit(1.0), ratio * F.lit(c)), 9))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id, the same for rows that repeat it."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rate: float = RATE, rounds: int = ROUNDS, topic: Column | None = None) -> DataFrame:
    """All rows and columns of docs plus n_tokens, topic, probability and sampled.

    docs: doc_id, text, source, lang. targets: per margin (source, lang, topic) a table of shares; margins not given
    follow their own token shares raised to MARGINS' power. `topic` is an expression over docs (text_kind if none).
    Null sources and languages count as one value of their own (the empty string). Texts without words carry no tokens:
    they get the probability of their cell, or `rate` if the whole cell has none. The same id is always drawn alike.
    Columns of docs with one of the four added names are replaced."""
    added = ["n_tokens", "topic", "probability", "sampled"]
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added or (c == "topic" and topic is not None)])
    words = own.withColumn("n_tokens", n_words(F.col("text")))
    words = words.withColumn("topic", topic if topic is not None else text_kind(F.col("text"), F.col("n_tokens")))
    keys = [F.coalesce(F.col(m).cast("string"), F.lit("")).alias(m) for m in MARGINS]
    cells = stored(cell_tokens(words.select(*keys, "n_tokens")), "cells")
    full = cells.where("tokens > 0")
    goals = {m: (targets or {}).get(m) for m in MARGINS}
    goals = {m: temperature_targets(full, m, MARGINS[m]) if g is None else g for m, g in goals.items()}
    rates = sampling_rates(rake(full, goals, rounds), rate).select(*[F.col(m).alias(f"_{m}") for m in MARGINS], F.col("probability"))
    joined = words.join(stored(rates, "rates"), [F.coalesce(words[m].cast("string"), F.lit("")) == F.col(f"_{m}") for m in MARGINS], "left")
    p = F.coalesce("probability", F.lit(float(rate)))
    return joined.select(*[F.col(f"`{c}`") for c in own.columns if c != "topic"], "n_tokens", "topic", p.alias("probability"), (draw(F.col("doc_id")) < p).alias("sampled"))

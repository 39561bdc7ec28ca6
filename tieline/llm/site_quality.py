"""Quality scores of documents by hierarchical empirical Bayes.

A document's own evidence (naive Bayes over a few text measures in fixed bins) is combined with what is known of its
place: the share of good documents of a host is shrunk toward the global share, that of a path within the host toward
the host's, each by as much as the spread between hosts (paths) in the labels suggests. A sparse site thus gets the
global prior and a well-known one its own. Grouped aggregates only. The library's products carry no prose, so the
operator is general; host is the archive a text comes from, path its section there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieline.llm.common import blank_words, let, pick, stored

MEASURES = {"words": [10, 20, 60, 200, 1000], "symbols": [1, 5, 50], "upper": [10, 40, 100, 300], "variety": [10, 25, 40, 60, 80], "word_length": [3, 4, 5, 6, 8], "marks": [1, 10, 50]}
FOLDS, FOLD = 5, 0


def bins(value: Column, cuts: list[int]) -> Column:
    """Number of cuts that the value reaches."""
    return sum((F.when(value >= c, 1).otherwise(0) for c in cuts), F.lit(0))


def text_measures(text: Column) -> Column:
    """Struct of bins: words; symbols, capital letters and exclamation marks per 1000 characters; distinct words per
    100 words; characters per word. Integer arithmetic, so equal texts fall into equal bins everywhere."""
    t = F.coalesce(text, F.lit(""))
    per = F.greatest(F.length(t), F.lit(1))
    def only(cls):
        return F.length(F.regexp_replace(t, f"[^{cls}]+", ""))
    def measures(w):
        n = F.greatest(F.size(w), F.lit(1))
        values = {"words": F.size(w), "symbols": F.floor(only(r"#*$%&|<>") * 1000 / per), "upper": F.floor(only(r"\p{Lu}") * 1000 / per),
                  "variety": F.floor(F.size(F.array_distinct(w)) * 100 / n), "word_length": F.floor(F.length(F.array_join(w, "")) / n), "marks": F.floor(only("!") * 1000 / per)}
        return F.struct(*[bins(values[m], c).alias(m) for m, c in MEASURES.items()])
    return let(blank_words(text), measures)


def site_posteriors(labelled: DataFrame) -> tuple[float, DataFrame]:
    """Global share of good rows and (host, path, host_rate, path_rate) from rows (host, path, good 0/1).

    Method-of-moments spread between hosts and between paths of a host; no label at all gives 0.5 and an empty table."""
    paths = stored(labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("k")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("paths"))
    t = hosts.agg(F.sum("hn").alias("n"), F.sum("hk").alias("k"), F.sum(F.col("hn") * F.col("hn")).alias("sq"), F.count("*").alias("hosts"), F.sum("paths").alias("paths"),
                  F.sum(F.col("nn") / F.col("hn")).alias("within")).first()
    n = float(t["n"] or 0)
    prior = float(t["k"]) / n if n else 0.5
    var = prior * (1 - prior)
    rates = paths.join(hosts.select("host", "hn", "hk"), "host")
    s = hosts.agg(F.sum(F.col("hn") * F.pow(F.col("hk") / F.col("hn") - prior, 2)).alias("s")).first()["s"] or 0.0
    w = rates.agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("hk") / F.col("hn"), 2)).alias("s")).first()["s"] or 0.0

    def worth(total, groups, room):
        spread = (total - groups * var) / room if room > 0 else 0.0
        return min(max(var / spread - 1, 1.0), 1e6) if spread > 0 else 1e6

    m_host = worth(s, t["hosts"] - 1, n - float(t["sq"] or 0) / n if n else 0.0)
    m_path = worth(w, (t["paths"] or 0) - t["hosts"], n - float(t["within"] or 0))
    host_rate = (F.col("hk") + m_host * prior) / (F.col("hn") + m_host)
    out = rates.withColumn("host_rate", host_rate).withColumn("path_rate", (F.col("k") + m_path * F.col("host_rate")) / (F.col("n") + m_path))
    return prior, stored(out.select("host", "path", "host_rate", "path_rate"), "sites")


def evidence(labelled: DataFrame) -> dict[tuple[str, int], float]:
    """log P(bin | good) - log P(bin | poor) of every measure's bin, with one added row per bin; a fixed small table."""
    rows = labelled.select("good", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("b")) for m in MEASURES])).alias("x"))
    seen = {(r["m"], r["b"]): (r["g"], r["n"] - r["g"]) for r in rows.groupBy("x.m", "x.b").agg(F.sum("good").alias("g"), F.count("*").alias("n")).collect()}
    import math

    out = {}
    for m, cuts in MEASURES.items():
        cells = [seen.get((m, b), (0, 0)) for b in range(len(cuts) + 1)]
        good, poor = sum(g for g, _ in cells) + len(cells), sum(p for _, p in cells) + len(cells)
        out |= {(m, b): math.log((g + 1) / good) - math.log((p + 1) / poor) for b, (g, p) in enumerate(cells)}
    return out


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, evidence, host_rate, path_rate, score and kept (score >= threshold).

    labels: doc_id, quality (0 or 1; others and nulls are ignored; a doc_id labelled twice counts by its mean). Rows
    whose crc32(doc_id) mod 5 is 0 are held out: their labels are not learned from. score is the posterior of a good
    document: evidence plus the log odds of its path's rate (of the host's for a path without labels, of the global
    share for a host without). Null hosts and paths are groups of their own; null text is an empty text."""
    base = pick(docs, "doc_id", "text", host, path)
    feats = stored(base.select("doc_id", F.coalesce(F.col(f"`{host}`"), F.lit("")).alias("host"), F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")).alias("path"),
                               F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == FOLD, F.lit(False)).alias("held_out"),
                               text_measures(F.col("text")).alias("m")).select("doc_id", "host", "path", "held_out", "m.*"), "measures")
    marks = pick(labels, "doc_id", "quality").where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("good"))
    learn = feats.where("NOT held_out").join(marks, "doc_id")
    prior, sites = site_posteriors(learn.select("host", "path", "good"))
    table = evidence(learn)
    llr = sum((F.element_at(F.array(*[F.lit(table[m, b]) for b in range(len(c) + 1)]), F.col(m) + 1) for m, c in MEASURES.items()), F.lit(0.0))
    hosts = sites.select(F.col("host").alias("_host"), "host_rate").distinct()
    own = sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "path_rate")
    out = feats.join(hosts, F.col("host") == F.col("_host"), "left").join(own, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    host_rate = F.coalesce("host_rate", F.lit(prior))
    rate = F.least(F.greatest(F.coalesce("path_rate", host_rate), F.lit(1e-6)), F.lit(1 - 1e-6))
    out = out.select("doc_id", "held_out", llr.alias("evidence"), host_rate.alias("host_rate"), rate.alias("path_rate"))
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate"))))))
    return out.withColumn("score", score).withColumn("kept", F.col("score") >= threshold)

"""URL filter: explicit host and path rules, and boosted trees on lexical features for the URLs no rule covers.

Judges the download links of archived catalog pages (page_id, url). The trees learn from the URLs that rules already
label, so they extend the rules' judgement to similar names. DataFrame expressions and JVM-side trees only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieline.llm.common import let, lower_ascii, pick, stored

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
TRAIN_ROWS, TREES, DEPTH, MAX_RULES = 8192, 12, 3, 10_000
FEATURES = ["length", "host_length", "depth", "host_depth", "digit_ratio", "entropy", "params", "dashes", "suffix_blocked"]


def split_url(urls: DataFrame) -> DataFrame:
    """url parts: `host` after the first `://` (A-Z lowered), `path` after it up to ? or #, `query` the rest. Null urls
    and urls without `://` have empty parts."""
    url = F.coalesce(F.col("url"), F.lit(""))
    shape = r"^(?s:.*?)://([^/?#]*)([^?#]*)((?s:.*))"
    return urls.withColumns({"host": lower_ascii(F.regexp_extract(url, shape, 1)), "path": F.regexp_extract(url, shape, 2), "query": F.regexp_extract(url, shape, 3)})


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null.

    A rule `host/path` fits its host and all subdomains if the path starts with its own. Of rules of equal length the
    one with the longer host wins, then block. The list is a parameter of at most MAX_RULES entries."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    order = sorted(dict.fromkeys((r.partition("/")[0].lower(), "/" + r.partition("/")[2], r, v) for r, v in rules),
                   key=lambda x: (-len(x[2]), -len(x[0]), x[3] != "block", x[2]))
    def fit(h, p):
        return ((host == h) | host.endswith("." + h)) & path.startswith(p)
    return F.coalesce(*[F.when(fit(h, p), F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"))) for h, p, r, v in order],
                      F.lit(None).cast("struct<rule:string,verdict:string>"))


def lexical_features(urls: DataFrame) -> DataFrame:
    """Adds length, depth, digit ratio, character entropy (bits), parameter count, dashes and the host's suffix."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(url)
    def entropy(chars):
        sorted_ = F.sort_array(chars)
        ends = let(sorted_, lambda s: F.filter(F.transform(s, lambda c, i: F.when((i == F.size(s) - 1) | (F.get(s, i + 1) != c), i)), lambda v: v.isNotNull()))
        counts = let(ends, lambda e: F.transform(e, lambda v, k: v - F.when(k > 0, F.get(e, F.greatest(k - 1, F.lit(0)))).otherwise(F.lit(-1))))
        return F.aggregate(counts, F.lit(0.0), lambda t, c: t - c / F.size(chars) * F.log2(c / F.size(chars)))
    chars = F.filter(F.split(url, ""), lambda c: c != "")
    return urls.withColumns({
        "length": n.cast("double"), "host_length": F.length("host").cast("double"), "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
        "host_depth": F.size(F.split("host", "\\.")).cast("double"), "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(n, F.lit(1)),
        "entropy": F.when(n > 0, let(chars, entropy)).otherwise(F.lit(0.0)),
        "params": F.when(F.startswith("query", F.lit("?")), F.size(F.split("query", "&"))).otherwise(0).cast("double"),
        "dashes": (n - F.length(F.translate(url, "-", ""))).cast("double"), "suffix": F.element_at(F.split("host", "\\."), -1)})


def _sample(labelled: DataFrame, most: int) -> DataFrame:
    """At most `most` distinct labelled urls, those with the smallest hash: the choice does not depend on row order, and
    copies of one url do not fill it."""
    return split_url(labelled.select("url", "blocked").distinct().orderBy(F.xxhash64("url"), "url").limit(most))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, train_rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict and block_score (null where a rule decides).

    The verdict is the rule's, else the trees': block if the boosted trees, learned from at most `train_rows` urls with
    a rule (a documented bound; judging covers all urls), find it more likely than not. suffix_blocked is the smoothed
    share of blocked rows of the host's last label among all rows with a rule; a ruled host ends like its rule's, so the
    table has no more rows than there are rules. Without labelled urls everything else is allowed; with one verdict only
    among the training urls, that verdict holds. Repeated rows are judged alike."""
    base = split_url(pick(pages, "page_id", "url")).withColumn("m", match_rule(F.col("host"), F.col("path"), rules))
    known = base.where("m IS NOT NULL").select("url", F.element_at(F.split("host", "\\."), -1).alias("suffix"), F.when(F.col("m.verdict") == "block", 1.0).otherwise(0.0).alias("blocked"))
    train = stored(_sample(known, train_rows), "url-sample")
    seen = train.agg(F.count("*").alias("n"), F.coalesce(F.sum("blocked"), F.lit(0.0)).alias("k")).first()
    parts = base.select("page_id", "url", "host", "path", "query", "m.rule", "m.verdict")
    if seen["k"] in (0.0, float(seen["n"])):
        only = "block" if seen["n"] and seen["k"] else "allow"
        score = F.when(F.col("rule").isNull(), F.lit(1.0 if only == "block" else 0.0))
        return parts.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(only)).alias("verdict"), score.alias("block_score"))
    counts = stored(known.groupBy("suffix").agg(F.sum("blocked").alias("k"), F.count("*").alias("n")), "suffixes")
    total = counts.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    prior = total["k"] / total["n"]
    suffixes = counts.select("suffix", ((F.col("k") + 10 * prior) / (F.col("n") + 10)).alias("rate"))

    def features(df):
        with_rate = lexical_features(df).join(F.broadcast(suffixes.withColumnRenamed("suffix", "_suffix")), F.col("suffix") == F.col("_suffix"), "left")
        return with_rate.withColumn("suffix_blocked", F.coalesce("rate", F.lit(prior)))

    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model = GBTClassifier(labelCol="blocked", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=7).fit(assemble.transform(features(train)).select("features", "blocked").coalesce(2))
    scored = model.transform(assemble.transform(features(parts)))
    score = F.when(F.col("rule").isNull(), vector_to_array("probability")[1])
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("prediction") == 1.0, "block").otherwise("allow")).alias("verdict"), score.alias("block_score"))

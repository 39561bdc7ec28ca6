"""Lines that many pages of one site share, as DataFrame expressions only.

`drop_boilerplate` removes lines found on more than a share of a host's pages; `quality_rules` removes normalised lines
found in more than the same share of a host's distinct texts and rejects documents that the removal depletes or that repeat themselves.
The share is a twentieth: on the sf0.1 table the one boilerplate line stands on 8.7 to 13.2 % of a host's distinct pages and no
other line on more than 4.6 %, so the limit lies between and each line has the same verdict in all hosts.
The host is the `source` column: the archive or site a text comes from. The library's products carry no prose, so the
operators are general.

Line counts are combined map-side and then dealt by (host, line), so neither a hot host nor a hot line is one group.
Lines over the limit are stored; the join back with the texts is a broadcast only while their stored size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieline.llm.common import BLANK_CHARS, BLANKS, blank_words, let, pick, stored, text_key

RATIO, MIN_PAGES, SALTS = 0.05, 5, 32
MAX_DOCS, MIN_LEFT = 4, 0.3


def bare(line: Column) -> Column:
    """A line without blanks at its ends."""
    return F.trim(line, F.lit(BLANK_CHARS))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_pages(docs: DataFrame) -> DataFrame:
    """(host, line hash, pages): on how many pages of a host each non-blank line stands.

    Copies of a page count as one page, and a line that repeats on a page counts once."""
    hashes = F.array_distinct(F.transform(F.filter(F.transform(text_lines(F.col("text")), bare), lambda x: x != ""), lambda x: F.xxhash64(x)))
    lines = docs.select("host", text_key(F.col("text")).alias("page"), F.explode(hashes).alias("line")).groupBy("host", "line", "page").agg(F.lit(1).alias("one"))
    return lines.groupBy("host", "line").agg(F.count("*").alias("pages"))


def _hosts(docs: DataFrame, host: str) -> DataFrame:
    """Null hosts are one host of their own, named by the empty string."""
    return docs.withColumn("host", F.coalesce(F.col(f"`{host}`"), F.lit("")))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host the hashes of its boilerplate lines: on at least `min_pages` pages and on more than `ratio` of them.

    A host's list is bounded: it holds at most (mean distinct lines of its pages) / ratio hashes. Stored."""
    base = _hosts(pick(docs, "text", host), host)
    pages = base.select("host", text_key(F.col("text")).alias("page")).groupBy("host", "page").agg(F.lit(1).alias("one"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    often = line_pages(base).where(F.col("pages") >= min_pages).join(totals, "host").where(F.col("pages") > F.col("total") * F.lit(ratio))
    return stored(often.groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("lines")), "boilerplate")


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All rows and columns of docs, with boilerplate lines removed from `text`, plus n_lines and n_dropped (bigint).

    Lines are split at \\n and compared without blanks at their ends; blank lines are never boilerplate. The other
    lines keep their order and bytes. Null text stays null with no lines; a text of only boilerplate becomes empty.
    Copies of a page count once, so a copied page does not make its own lines frequent. Columns of docs named n_lines or n_dropped are replaced."""
    marks = boilerplate(docs, host, ratio, min_pages)
    salted = marks.select(F.col("host").alias("_host"), F.col("lines").alias("_bad"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    dealt = docs.withColumns({"_h": F.coalesce(F.col(f"`{host}`"), F.lit("")), "_s": F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")})
    joined = dealt.join(salted, (F.col("_h") == F.col("_host")) & (F.col("_s") == F.col("_salt")), "left")

    def split(bad):
        def parts(lines):
            left = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(bad, F.xxhash64(bare(x))) & (bare(x) != ""), F.lit(False)))
            return let(left, lambda kept: F.struct(F.array_join(kept, "\n").alias("text"), F.size(lines).alias("n"), (F.size(lines) - F.size(kept)).alias("gone")))
        return parts

    cut = joined.withColumn("_cut", F.when(F.col("text").isNotNull(), let(F.split("text", "\n", -1), split(F.col("_bad")))))
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    columns = [F.col("_cut.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c == "text" or c in own]
    return cut.select(*columns, F.coalesce("_cut.n", F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce("_cut.gone", F.lit(0)).cast("bigint").alias("n_dropped"))


def without_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Rows of docs with boilerplate lines removed (and n_chars, where there is one, counted anew); a row of which no
    word is left goes, also one that had none."""
    cut = drop_boilerplate(docs, host, ratio, min_pages).where(bare(F.regexp_replace("text", "\n", " ")) != "")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])


def base_counts(words: Column, text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text (array of its words given)."""
    lines = F.filter(text_lines(text), lambda x: bare(x) != "")
    dup = let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))

    def covered(grams):
        """Words inside windows that occur twice or more: sort windows by (hash, place), keep those equal to a
        neighbour, sort by place and add up what each window adds."""
        marked = F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        def neighbours(s):
            last = F.size(s) - 1
            same = F.filter(F.transform(s, lambda x, i: F.when(((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"]))
                                                              | ((i < last) & (F.get(s, F.least(i + 1, last))["h"] == x["h"])), x["i"])), lambda v: v.isNotNull())
            return let(F.sort_array(same), lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.when(k < F.size(p) - 1, F.least(F.get(p, k + 1) - x, F.lit(5))).otherwise(F.lit(5))), F.lit(0), lambda t, v: t + v))
        return let(F.sort_array(marked), neighbours)

    def windows(w):
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.xxhash64(F.slice(w, i, 5)))
        return F.when(F.size(w) > 5, let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0)))).otherwise(F.lit(0))

    return let(words, lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        dup.cast("bigint").alias("n_dup_lines"), windows(w).cast("bigint").alias("n_repeat_words")))


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, single blanks: what counts as the same line across documents."""
    return bare(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), BLANKS, " "))


def quality_rules(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT,
                  min_words: int = 10, max_repeat_pct: int = 20, ratio: float = RATIO) -> DataFrame:
    """One row per document: doc_id, the five base counts, n_removed_words, base_failed and kept.

    A normalised line found in more than a share `ratio` of the distinct texts of its host, and in more than `max_docs`
    (which guards small hosts), is removed; equal texts count once, so a copied document does not make its own lines frequent. kept is false if the base rule fails (n_words < min_words
    or 100 * n_repeat_words > max_repeat_pct * n_words) or if less than `min_left` of the words stands in lines that
    are not removed. Null and blank texts have no words and fail; repeated rows each get their row."""
    base = _hosts(pick(docs, "doc_id", "text", host), host).withColumn("key", text_key(F.col("text")))
    norm = F.transform(text_lines(F.col("text")), lambda x: F.struct(F.xxhash64(normal_line(x)).alias("line"), F.size(F.filter(F.split(x, BLANKS), lambda w: w != "")).alias("words")))
    lines = base.select("doc_id", "host", "key", F.explode(F.filter(norm, lambda s: s["words"] > 0)).alias("s")).select("doc_id", "host", "key", "s.*")
    once = lines.groupBy("host", "line", "key").agg(F.count("*").alias("n"))
    totals = base.groupBy("host", "key").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("total"))
    often = once.groupBy("host", "line").agg(F.count("*").alias("texts")).where(F.col("texts") > max_docs)
    often = often.join(totals, "host").where(F.col("texts") > F.col("total") * F.lit(ratio))
    often = stored(often.select(F.col("host").alias("_host"), F.col("line").alias("_line")), "lines")
    hit = lines.join(often, (F.col("host") == F.col("_host")) & (F.col("line") == F.col("_line")))
    removed = hit.groupBy("doc_id", "host", "key").agg(F.sum("words").alias("gone"))
    removed = removed.select(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("key").alias("_key"), "gone")
    copies = base.groupBy("doc_id", "host", "key").agg(F.count("*").alias("rows")).where("rows > 1").select(
        F.col("doc_id").alias("_id2"), F.col("host").alias("_host2"), F.col("key").alias("_key2"), "rows")
    counts = base.select("doc_id", "host", "key", base_counts(blank_words(F.col("text")), F.col("text")).alias("c")).select("doc_id", "host", "key", "c.*")
    out = counts.join(removed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("host") == F.col("_host")) & (F.col("key") == F.col("_key")), "left")
    out = out.join(copies, F.col("doc_id").eqNullSafe(F.col("_id2")) & (F.col("host") == F.col("_host2")) & (F.col("key") == F.col("_key2")), "left")
    gone = F.floor(F.coalesce(F.col("gone") / F.coalesce("rows", F.lit(1)), F.lit(0))).cast("bigint")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", gone.alias("n_removed_words"), failed.alias("base_failed"),
                      (~failed & ((F.col("n_words") - gone) >= F.col("n_words") * F.lit(min_left))).alias("kept"))

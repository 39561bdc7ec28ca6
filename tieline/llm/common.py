"""Helpers shared by the text operators: stored intermediates, expression binding, words and their hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from tieline.session import shared_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: lineage is cut, lost executors replay
    nothing before it, and the optimizer knows its size when it chooses between broadcast and shuffle joins."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression so that `body` may use it many times (also inside lambdas) and it is computed once."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def blank_words(text: Column) -> Column:
    """Words between ASCII blanks; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def text_key(text: Column) -> Column:
    """Short identity of a row's text, used beside doc_id to find the row again (null text differs from empty text)."""
    return F.coalesce(F.xxhash64(text), F.lit(0)) + F.when(text.isNull(), 1).otherwise(0)


def pick(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name cannot clash with those an operator adds."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def as_bytes(df: DataFrame, text: str = "text") -> DataFrame:
    """Text as UTF-8 bytes: Arrow then hands Python slices without decoding them."""
    return df.withColumn(text, F.col(text).cast("binary"))


BITMAP_WORDS = 1 << 18


def slot(*columns: str) -> Column:
    """Place of a row's key in a bitmap of 2^24 bits."""
    return F.pmod(F.xxhash64(*columns), F.lit(BITMAP_WORDS * 64))


def bitmap(keys: DataFrame, *columns: str) -> Broadcast:
    """A bitmap of 2 MB, whatever the number of keys, in which each key's place is set. It says of a row that its key is
    surely not among them, or may be; with very many keys it lets more rows pass to the exact join behind it."""
    import numpy as np

    words = keys.select(slot(*columns).alias("s")).selectExpr("CAST(shiftright(s, 6) AS INT) AS w", "shiftleft(1L, CAST(s & 63 AS INT)) AS b")
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(BITMAP_WORDS, np.int64)
    bits[np.array(rows["w"], np.int64)] = np.array(rows["b"], np.int64)
    return keys.sparkSession.sparkContext.broadcast(bits.tobytes())


def held(bits: bytes, slots):
    """Which of the slots (array of places) are set."""
    import numpy as np

    words = np.frombuffer(bits, np.int64)
    return (words[slots >> 6] >> (slots & 63)) & 1 == 1


class WordHashes:
    """64-bit hashes of words, remembered for the frequent ones of a task."""

    def __init__(self, limit: int = 20_000):
        self.limit, self.known = limit, {}

    def __call__(self, words: list[bytes]):
        import numpy as np
        from xxhash import xxh3_64_intdigest

        known = self.known
        if len(known) > self.limit:
            known.clear()
        new = {w for w in words if w not in known}
        known.update((w, xxh3_64_intdigest(w)) for w in new)
        out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(new) > self.limit:
            known.clear()
        return out


def mix(h):
    """Finalise 64-bit values so that all bits depend on all input bits (works in place on a copy)."""
    import numpy as np

    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def gram_hashes(h, size: int):
    """Order-sensitive hashes of `size` consecutive word hashes."""
    import numpy as np

    n = len(h) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size):
        if n > 0:
            out = mix(out + h[i:i + n] + np.uint64(0x9E3779B97F4A7C15))
    return out


BATCH_BYTES, BATCH_KEY, BATCH_DEFAULT = "1m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """`mapInArrow` with batches of about 1 MB, or one row if it is longer: texts are long, and a batch is held by the
    executor and its Python worker at once. The limit is set for the session unless it has one of its own."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT:
        conf.set(BATCH_KEY, BATCH_BYTES)

    def lean(batches):
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())  # gives freed batches back; the default pool keeps them
        yield from run(batches)

    return df.mapInArrow(lean, schema)


def pieces(column, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow binary column of at most `limit` bytes, or one row if it is longer."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, s in enumerate(sizes):
        if i > start and total + s > limit:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of links: (node, component), component being the smallest node reachable.

    Alternates large-star and small-star steps; every round is a few shuffles of the links and is stored. Nodes
    without a link have no row. Works for groups of any size and chains of any length (rounds grow with the log)."""
    edges = stored(links.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
                   .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct(), "links")

    def mark(e):
        return e.select(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()

    before = mark(edges)
    while before["n"]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

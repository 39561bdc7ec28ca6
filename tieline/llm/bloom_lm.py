"""Language-model scores from a log-frequency Bloom filter.

All words and all word pairs of the training texts are counted, whatever their count. Counts are rounded to powers of
two and stored as (n-gram, level) memberships of a Bloom filter of 10 bits each; a count is read back by asking for level 1, 2,
... until the answer is no, and stands for the mean count of all n-grams of that level.

The filter grows with the corpus. Up to BROADCAST_CHUNKS chunks of 2^20 bits (134 MB) it is broadcast. A larger one is a table of
chunks; up to MAPPED_CHUNKS (8.6 GB), if the shared folder is mounted, tasks also put the chunks into one file there, which
scoring maps into memory. Else the distinct n-grams of up to 64 texts at a time go to slabs of SLAB chunks: a task reads a slab
once, before all its n-grams. Words of a share of 2^-20 and
more (at most 2^20) are also broadcast with exact counts, which saves them a probe; the exact base score uses every word's
count, by a join for the other words. The library's products carry no prose, so the operator is general.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from tieline.llm.common import WordHashes, as_bytes, map_batches, mix, pick, pieces, stored
from tieline.session import mounted, shared_path, spread

WORD_SHARE = 2.0 ** -20
BITS_PER_ENTRY, PROBES, CHUNK_BITS, END = 10, 5, 1 << 20, b"\n"
BROADCAST_CHUNKS, MAPPED_CHUNKS, SLAB = 1024, 1 << 16, 64
HELD_TOKENS = 1 << 19  # tokens whose pairs a task counts before it hands them on
BACKOFF = 0.1  # share of a word's count that is kept for pairs not seen


@dataclass
class Model:
    """A trained model: totals, the count of every word (hash, count), what is broadcast, and the chunks of a filter
    that is not (chunk, bits); its file, if there is one, is named in what is broadcast."""

    tokens: int
    types: int
    counts: DataFrame
    shared: Broadcast
    slices: DataFrame | None


def token_hashes(raw: bytes | None, hashes: WordHashes):
    """Hashes of a text's lower-cased words and of one end."""
    return hashes([*(raw.lower().split() if raw else ()), END])


def pair_keys(prev, word):
    import numpy as np

    return mix(mix(prev + np.uint64(0x2545F4914F6CDD1D)) + word)


def planes(a) -> bytes:
    """An array's bytes, all first bytes before all second ones: the planes of sorted keys compress."""
    import numpy as np

    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def from_planes(raw: bytes, dtype):
    import numpy as np

    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def place_of(keys, parts: int):
    """Which of `parts` equal ranges of hashes a key falls into."""
    import numpy as np

    return (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def place_column(key: str, parts: int) -> Column:
    return F.shiftright(F.shiftrightunsigned(key, 32) * F.lit(parts), 32).cast("int")


def probe_positions(keys, level: int, chunks: int):
    """Bit positions (one row per probe) of a membership; all probes of an n-gram lie in one chunk of the filter."""
    import numpy as np

    base = place_of(keys, chunks) * np.uint64(CHUNK_BITS)
    h = mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    first, second = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return [base + ((first + np.uint64(i) * second) & np.uint64(CHUNK_BITS - 1)) for i in range(PROBES)]


def probe_levels(keys, bits, chunks: int, first: int = 0):
    """Level of each n-gram: the number of memberships found one after another; bits start at chunk `first`."""
    import numpy as np

    level, alive = np.zeros(len(keys), np.int64), np.arange(len(keys))
    while chunks and len(alive):
        ok = np.ones(len(alive), bool)
        at = int(level[alive[0]]) + 1
        for pos in probe_positions(keys[alive], at, chunks):
            pos = pos - np.uint64(first * CHUNK_BITS)
            ok &= (bits[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1 == 1
        alive = alive[ok]
        level[alive] = at
    return level


def level_of(count: Column, cut: float) -> Column:
    """1 + floor(log2(count / cut)) for counts of at least `cut`."""
    return (F.floor(F.log2(count / F.lit(cut)) + 1e-12) + 1).cast("int")


def _lookup(table, keys):
    """Place of each key in a sorted array, and whether it is there."""
    import numpy as np

    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def count_words(texts: DataFrame) -> DataFrame:
    """(h, c): count of every distinct word hash of the texts, ends included. texts: one column of UTF-8 bytes."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes = WordHashes()
        for b in batches:
            for lo, hi in pieces(b.column(0)):
                all_ = np.concatenate([token_hashes(r, hashes) for r in b.column(0).slice(lo, hi - lo).to_pylist()])
                h, c = np.unique(all_, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    return map_batches(texts, run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def count_pairs(texts: DataFrame, buckets: int) -> DataFrame:
    """All pairs of consecutive words with their levels, one row per range of keys: k and level (planes of uint64 and uint8),
    n and total (number of pairs and sum of their counts at each level). Each range holds about 2^19 tokens' pairs."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes = WordHashes()
        end, held, size = hashes([END]), [], 0

        def flush():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            at = np.searchsorted(place_of(k, buckets), np.arange(buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(at))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([planes(k[at[i]:at[i + 1]]) for i in full], pa.binary()),
                                               pa.array([planes(c[at[i]:at[i + 1]].astype(np.uint32)) for i in full], pa.binary())], ["bucket", "k", "c"])

        for b in batches:
            for r in b.column(0).to_pylist():
                h = token_hashes(r, hashes)
                held.append(pair_keys(np.concatenate([end, h[:-1]]), h))
                size += len(h)
                if size >= HELD_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def merge(table):
        import numpy as np
        import pyarrow as pa

        k = np.concatenate([from_planes(x, np.uint64) for x in table["k"].to_pylist()])
        c = np.concatenate([from_planes(x, np.uint32) for x in table["c"].to_pylist()]).astype(np.int64)
        order = np.argsort(k)
        k, c = k[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        k, c = k[first], np.add.reduceat(c, first)
        level = np.frexp(c.astype(np.float64))[1]
        n, total = np.bincount(level, minlength=64), np.bincount(level, c, 64).astype(np.int64)
        return pa.table({"k": pa.array([planes(k)], pa.binary()), "level": pa.array([level.astype(np.uint8).tobytes()], pa.binary()),
                         "n": pa.array([n], pa.list_(pa.int64())), "total": pa.array([total], pa.list_(pa.int64()))})

    parts = map_batches(texts, run, "bucket int, k binary, c binary")
    return parts.groupBy("bucket").applyInArrow(merge, "k binary, level binary, n array<bigint>, total array<bigint>")


def packed(entries: DataFrame, parts: int) -> DataFrame:
    """Rows (k, level) gathered to one row per range of keys, in the form of count_pairs."""
    def pack(table):
        import numpy as np
        import pyarrow as pa

        k, level = table["k"].to_numpy().view(np.uint64), table["level"].to_numpy()
        return pa.table({"k": pa.array([planes(k)], pa.binary()), "level": pa.array([level.astype(np.uint8).tobytes()], pa.binary())})

    return entries.select("k", "level", place_column("k", parts).alias("part")).groupBy("part").applyInArrow(pack, "k binary, level binary")


def filter_chunks(entries: DataFrame, chunks: int) -> DataFrame:
    """(chunk, bits): the filter's chunks of 2^20 bits, about 10^5 memberships each; entries: k, level (planes)."""
    def fill(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for raw, levels in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys, level = from_planes(raw, np.uint64), np.frombuffer(levels, np.uint8)
                order = np.argsort(keys)
                keys, level = keys[order], level[order]
                chunk = place_of(keys, chunks)
                starts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
                for lo, hi in zip(starts, [*starts[1:], len(keys)]):
                    flags = np.zeros(CHUNK_BITS, bool)
                    for j in range(1, int(level[lo:hi].max()) + 1):
                        for pos in probe_positions(keys[lo:hi][level[lo:hi] >= j], j, chunks):
                            flags[(pos & np.uint64(CHUNK_BITS - 1)).astype(np.int64)] = True
                    yield pa.RecordBatch.from_arrays([pa.array([int(chunk[lo])], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    def unite(table):
        import numpy as np
        import pyarrow as pa

        bits = np.zeros(CHUNK_BITS // 8, np.uint8)
        for x in table["bits"]:
            bits |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"chunk": table["chunk"][:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    return map_batches(entries.select("k", "level"), fill, "chunk int, bits binary").groupBy("chunk").applyInArrow(unite, "chunk int, bits binary")


def whole_filter(parts: DataFrame, chunks: int) -> bytearray:
    out = bytearray(chunks * CHUNK_BITS // 8)
    for r in parts.toLocalIterator():
        out[r["chunk"] * CHUNK_BITS // 8:(r["chunk"] + 1) * CHUNK_BITS // 8] = r["bits"]
    return out


def filter_file(parts: DataFrame, chunks: int) -> str | None:
    """The filter's chunks, put by tasks at their places in one file of the shared folder, if that is mounted."""
    spark = parts.sparkSession
    file = mounted(spark, shared_path(spark, "filter-bits"))
    if file is None or chunks > MAPPED_CHUNKS:
        return None
    with open(file, "wb") as f:
        f.truncate(chunks * CHUNK_BITS // 8)

    def put(batches):
        import pyarrow as pa

        with open(file, "r+b") as f:
            for b in batches:
                for chunk, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    f.seek(chunk * CHUNK_BITS // 8)
                    f.write(bits)
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    map_batches(parts.select("chunk", "bits"), put, "n bigint").agg(F.sum("n")).collect()
    return file


def build_filter(entries: DataFrame, chunks: int) -> bytearray:
    """The filter's bits for rows (k, level)."""
    return whole_filter(filter_chunks(packed(entries, chunks), chunks), chunks)


def train_model(docs: DataFrame, text: str = "text") -> Model:
    """Learn from all texts of docs (null: only an end). Returns the model; its filter size follows from the counts."""
    import numpy as np

    spark = docs.sparkSession
    texts = as_bytes(docs.select(F.col(f"`{text}`").alias("text")))
    counts = stored(count_words(texts), "words")
    levels = counts.groupBy(level_of(F.col("c"), 1.0).alias("level")).agg(F.sum("c").alias("total"), F.count("*").alias("n")).collect()
    n, v = sum(r["total"] for r in levels), sum(r["n"] for r in levels)
    often = counts.where(F.col("c") >= n * WORD_SHARE).toArrow()  # at most 2^20 rows
    h, c = np.array(often["h"], np.int64).view(np.uint64), np.array(often["c"], np.int64)
    order = np.argsort(h)
    # a task hands on a row for each range, so there are not many more ranges for more tokens, but larger ones
    buckets = max(min(n >> 19, max(n >> 22, 1024)), 1)
    pairs = stored(count_pairs(texts, buckets), "pairs")
    both = pairs.select(F.posexplode(F.arrays_zip("n", "total")).alias("level", "x")).groupBy("level").agg(F.sum("x.total").alias("total"), F.sum("x.n").alias("n")).where("n > 0").collect()
    mean = {}
    for name, rows in (("words", levels), ("pairs", both)):
        mean[name] = np.zeros(1 + max([r["level"] for r in rows], default=0))
        for r in rows:
            mean[name][r["level"]] = r["total"] / r["n"]
    size = sum(r["level"] * r["n"] for r in [*levels, *both])
    chunks = -(-size * BITS_PER_ENTRY // CHUNK_BITS)
    words = packed(counts.select(F.col("h").alias("k"), level_of(F.col("c"), 1.0).alias("level")), buckets)
    parts = filter_chunks(pairs.select("k", "level").unionByName(words), chunks)
    small = chunks <= BROADCAST_CHUNKS
    shared = {"h": h[order], "c": c[order], "mean": mean, "chunks": chunks, "bits": whole_filter(parts, chunks) if small and chunks else b""}
    slices = None if small else stored(parts, "filter")
    shared["file"] = None if small else filter_file(slices, chunks)
    return Model(n, v, counts, spark.sparkContext.broadcast(shared), slices)


def tokens(column, hashes: WordHashes, end, common):
    """Of a column of texts: all word hashes, where texts start, their lengths, the distinct hashes, each token's place
    and that of the token before among them, and the places of the distinct hashes in `common`, if they are there."""
    import numpy as np

    texts = [token_hashes(r, hashes) for r in column.to_pylist()]
    lengths = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    word = np.concatenate(texts)
    uniq, inv = np.unique(word, return_inverse=True)
    prev = np.empty(len(inv), np.int64)
    prev[1:] = inv[:-1]
    prev[starts] = int(np.searchsorted(uniq, end[0]))
    return word, starts, lengths, uniq, inv, prev, *_lookup(common, uniq)


def score_texts(docs: DataFrame, model: Model, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """One row per text: the `keep` columns, n_tokens, n_known, base_score and score.

    base_score is the sum over the text's words and its end of log10((c + 0.1) / (N + 0.1 (V + 1))) with exact training
    counts c; n_known counts tokens with c > 0. score is the model's log10 probability: the sum of log10 p(word | word
    before) = (pair + BACKOFF c p) / ((1 + BACKOFF) c), where pair and c (of the word before) are counts read from the filter and p is
    the word's own probability as in base_score; after a word that was never seen it is p. Counts from the filter are
    means of their level, so the probabilities after one word add up to 1 only on average. Words are
    told apart by 64-bit hashes. Null and blank texts have one token, the end. An untrained model scores 0 for base."""
    shared, n, v, size = model.shared, model.tokens, model.types, SLAB
    import math

    low = math.log10(n + 0.1 * (v + 1))

    def score(columns, column, hashes, levels):
        """Record batches for rows of `columns` with texts `column`; levels(keys) reads the filter."""
        import numpy as np
        import pyarrow as pa

        m, end = shared.value, hashes([END])
        for lo, hi in pieces(column):
            word, starts, lengths, uniq, inv, prev, at, often = tokens(column.slice(lo, hi - lo), hashes, end, m["h"])
            count = np.where(often, m["c"][at] if len(m["h"]) else 0, 0)
            mean = m["mean"]["words"]
            held = count.astype(np.float64)
            held[~often] = mean[np.minimum(levels(uniq[~often]), len(mean) - 1)]
            p = (held + 0.1) / (n + 0.1 * (v + 1))
            known = np.flatnonzero((held[prev] > 0) & (held[inv] > 0))
            mean = m["mean"]["pairs"]
            keys, back = np.unique(pair_keys(uniq[prev[known]], word[known]), return_inverse=True)
            pair = np.zeros(len(inv))
            pair[known] = mean[np.minimum(levels(keys), len(mean) - 1)][back]
            c, p = held[prev], p[inv]
            p = np.where(c > 0, (np.minimum(pair, c) + BACKOFF * c * p) / ((1 + BACKOFF) * np.maximum(c, 1)), p)
            exact = np.where(often, np.log10(count + 0.1) - low, 0.0)
            rare = [t[~o] for t, o in zip(np.split(word, starts[1:]), np.split(often[inv], starts[1:]))]
            rare = [np.unique(r, return_counts=True) for r in rare]
            yield pa.RecordBatch.from_arrays([
                *[c.slice(lo, hi - lo) for c in columns], pa.array(lengths, pa.int64()), pa.array(np.add.reduceat(often[inv].astype(np.int64), starts)),
                pa.array(np.add.reduceat(exact[inv], starts)), pa.array(np.add.reduceat(np.log10(p), starts)), pa.array([r[0].view(np.int64) for r in rare], pa.list_(pa.int64())),
                pa.array([r[1].astype(np.int32) for r in rare], pa.list_(pa.int32()))], [*kept, "n_tokens", "often", "base", "score", "rare", "times"])

    def run(batches):
        import numpy as np

        m, hashes = shared.value, WordHashes()
        bits = np.asarray(np.memmap(m["file"], np.uint8, "r")) if m["file"] else np.frombuffer(m["bits"], np.uint8)
        for b in batches:
            yield from score(b.columns[:-1], b.column(b.num_columns - 1), hashes, lambda keys: probe_levels(keys, bits, m["chunks"]))

    def ask(table):
        """The distinct n-grams of a group of texts, by slab of the filter."""
        import numpy as np
        import pyarrow as pa

        m, hashes = shared.value, WordHashes()
        col, keys = table["_text_"].combine_chunks(), []
        for lo, hi in pieces(col):
            word, _, _, uniq, _, prev, _, often = tokens(col.slice(lo, hi - lo), hashes, hashes([END]), m["h"])
            keys += [uniq[~often], pair_keys(uniq[prev], word)]
        keys = np.unique(np.concatenate(keys))
        slab = place_of(keys, m["chunks"]).astype(np.int32) // size
        starts = np.flatnonzero(np.concatenate([[True], slab[1:] != slab[:-1]]))
        return pa.table({"_group": pa.array([table["_group"][0].as_py()] * len(starts), pa.int64()), "slab": slab[starts], "k": pa.array([x.tobytes() for x in np.split(keys, starts[1:])], pa.binary())})

    def answer(batches):
        """Levels of n-grams; rows of a slab follow each other, its chunks (group -1) first."""
        import numpy as np
        import pyarrow as pa

        m, now, bits, width = shared.value, None, b"", CHUNK_BITS // 8
        for b in batches:
            group, asked, found = b["_group"].to_pylist(), [], []
            for g, slab, chunk, raw in zip(group, b["slab"].to_pylist(), b["chunk"].to_pylist(), b["k"].to_pylist()):
                if slab != now:
                    now, bits = slab, np.zeros(size * width, np.uint8)
                if g < 0:
                    bits[chunk % size * width:(chunk % size + 1) * width] = np.frombuffer(raw, np.uint8)
                else:
                    asked.append(raw)
                    found.append(probe_levels(np.frombuffer(raw, np.uint64), bits, m["chunks"], slab * size).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([g for g in group if g >= 0], pa.int64()), pa.array(asked, pa.binary()), pa.array(found, pa.binary())], ["_group", "k", "level"])

    def finish(texts, answers):
        import numpy as np
        import pyarrow as pa

        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in answers["k"].to_pylist()])
        level = np.concatenate([np.frombuffer(x, np.uint8) for x in answers["level"].to_pylist()])
        order = np.argsort(keys)
        keys, level = keys[order], level[order].astype(np.int64)
        columns = [texts[c].combine_chunks() for c in kept]
        return pa.Table.from_batches(list(score(columns, texts["_text_"].combine_chunks(), WordHashes(), lambda k: level[np.searchsorted(keys, k)])))

    rows = as_bytes(docs.select(*[e.alias(k) for k, e in keep.items()], F.col(f"`{text}`").alias("_text_")), "_text_")
    kept = list(keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema += ", n_tokens bigint, often bigint, base double, score double, rare array<bigint>, times array<int>"
    if model.slices is None or shared.value["file"]:
        first = map_batches(rows, run, schema)
    else:
        rows = stored(rows.withColumn("_group", F.shiftright(F.monotonically_increasing_id(), 6)), "texts")
        asked = rows.select("_group", "_text_").groupBy("_group").applyInArrow(ask, "_group bigint, slab int, k binary").withColumn("chunk", F.lit(-1))
        slabs = model.slices.select(F.lit(-1).cast("bigint").alias("_group"), (F.col("chunk") / size).cast("int").alias("slab"), F.col("bits").alias("k"), "chunk")
        met = spread(asked.unionByName(slabs), "slab").sortWithinPartitions("slab", "_group")
        found = map_batches(met, answer, "_group bigint, k binary, level binary")
        first = rows.groupBy("_group").cogroup(found.groupBy("_group")).applyInArrow(finish, schema)
    first = stored(first.withColumn("_uid", F.monotonically_increasing_id()), "scored")
    seldom = first.select("_uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("_uid", F.col("x.rare").alias("h"), F.col("x.times").alias("t"))
    seldom = seldom.join(model.counts, "h", "left").select("_uid", "t", F.coalesce("c", F.lit(0)).alias("c"))
    sums = seldom.groupBy("_uid").agg(F.sum(F.when(F.col("c") > 0, F.col("t")).otherwise(0)).alias("known"), F.sum(F.col("t") * (F.log10(F.col("c") + 0.1) - F.lit(low))).alias("more"))
    out = first.join(sums, "_uid", "left")
    return out.select(*[f"`{k}`" for k in kept], "n_tokens", (F.col("often") + F.coalesce("known", F.lit(0))).alias("n_known"),
                      (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")

"""Near-duplicate documents with HyperMinHash.

A text is the set of its distinct word shingles. Each shingle's hash goes to one bucket; a bucket keeps its smallest
hash in compressed form, the number of leading zeros and ten bits of mantissa. For banding, an empty register holds the
smallest value of all shingles under a hash of its own, so that short texts band like long ones. Texts that agree on a whole band of registers are candidates; the
collision-corrected estimate drops the clearly different, and the rest are compared on their full sets.

All members of a band are first compared with its smallest document only. Then only pairs of a band that these links
left in different components are looked at: inside the join by a 4096-bit digest of both sets, of which few that are
not links pass, and each pair in the first band it shares. Nothing is capped; members of a crowded band that resemble
each other without being links are the one case in which the join still looks at each pair. With 40 bands of 5
registers a pair of similarity 0.8 is missed with a chance of about 1e-7, by the digest with 3e-7; for more than some
hundred million texts, more registers a band (and more bands) keep the bands of unrelated texts small. The library's
products carry no prose, so the operator is general.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tieline.llm.common import WordHashes, as_bytes, components, gram_hashes, map_batches, mix, pick, pieces, stored, text_key

BANDS, ROWS, MANTISSA, EMPTY = 40, 5, 10, 0xFFFF
SHINGLE_WORDS, SIMILARITY = 5, 80
FIRST_LOOK, FEW = 0.6, 24
WORDS, MOST_APART = 64, 514


def compress(least):
    """Leading zeros (6 bits) and mantissa (10 bits) of 64-bit minima as uint16."""
    import numpy as np

    _, e = np.frexp(np.maximum(least >> np.uint64(11), np.uint64(1)).astype(np.float64))
    zeros = np.minimum(53 - e, 42).astype(np.uint64)
    digits = ((least >> np.uint64(11)) >> np.maximum(e - 1 - MANTISSA, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    return (zeros << np.uint64(MANTISSA) | digits).astype(np.uint16)


def register_set(hashes, seeds):
    """HyperMinHash registers of distinct 64-bit hashes: the true ones (empty ones marked) and those for banding, in
    which an empty register holds the smallest re-hashed value of all shingles."""
    import numpy as np

    size = len(seeds)
    bucket = ((hashes >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
    least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bucket, mix(hashes))
    empty = np.ones(size, bool)
    empty[bucket] = False
    regs = compress(least)
    full, regs[empty] = regs.copy(), EMPTY
    if empty.any():
        again = (hashes[None, :] ^ seeds[empty][:, None]) * np.uint64(0xD6E8FEB86659FD93)
        full[empty] = compress((again ^ (again >> np.uint64(32))).min(1))
    return regs, full


def word_key(words: list[bytes]) -> bytes:
    """Identity of a word sequence."""
    from hashlib import blake2b

    return blake2b(b" ".join(words), digest_size=16).digest()


def sketch(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, word_key (hash of the lower-cased word sequence), regs (true registers,
    empty ones marked) and bands (keys of its bands). Texts without words have no word_key, registers or bands."""
    size = bands * rows

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes = WordHashes()
        seeds = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        band_no = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for b in batches:
            for lo, hi in pieces(b.column(1)):
                out = []
                for raw in b.column(1).slice(lo, hi - lo).to_pylist():
                    words = raw.lower().split() if raw else []
                    if not words:
                        out.append((0, None, None, None))
                        continue
                    k = min(shingle_words, len(words))
                    grams = np.unique(gram_hashes(hashes(words), k))
                    regs, full = register_set(grams, seeds)
                    key = word_key(words)
                    if len(grams) < 4:
                        keys = [int(np.bitwise_xor.reduce(mix(grams)).view(np.int64))]
                    else:
                        full = full.reshape(bands, rows).astype(np.uint64)
                        h = band_no.copy()
                        for c in range(rows):
                            h = mix(h + full[:, c] + np.uint64(0x9E3779B97F4A7C15))
                        keys = h.view(np.int64).tolist()
                    out.append((len(grams), key, regs.tobytes(), keys))
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *[pa.array(list(c), t) for c, t in zip(zip(*out), kinds)]], ["doc_id", "n_shingles", "word_key", "regs", "bands"])

    rows_ = as_bytes(pick(docs, "doc_id", "text"))
    return map_batches(rows_, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, word_key binary, regs binary, bands array<bigint>")


def promising(pairs: DataFrame, nodes: DataFrame, share: int = SIMILARITY) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose collision-corrected estimate reaches FIRST_LOOK (about
    six standard deviations below 0.8), or that have few registers to judge by."""
    side = nodes.select("node", "regs", "n_shingles")
    left = side.select(F.col("node").alias("a"), F.col("regs").alias("ra"), F.col("n_shingles").alias("na"))
    right = side.select(F.col("node").alias("b"), F.col("regs").alias("rb"), F.col("n_shingles").alias("nb"))
    joined = pairs.join(right, "b").join(left, "a").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * share)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.stack([np.frombuffer(v, np.uint16) for v in b.column(i).to_pylist()]) for i in (2, 3))
            na, nb = (np.array(b.column(i), np.float64) for i in (4, 5))
            used = ((x != EMPTY) | (y != EMPTY)).sum(1)
            equal = ((x == y) & (x != EMPTY)).sum(1)
            chance = 0.16991948715 * x.shape[1] / 2.0 ** MANTISSA * 4 * na * nb / (na + nb) ** 2
            estimate = np.maximum(equal - chance, 0) / np.maximum(used, 1)
            keep = pa.array((estimate >= FIRST_LOOK) | (used < FEW))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    kind = nodes.schema["node"].dataType.simpleString()
    return map_batches(joined.select("a", "b", "ra", "rb", "na", "nb"), run, f"a {kind}, b {kind}")


def digests(texts: DataFrame, shingle_words: int) -> DataFrame:
    """(node, word_key, d0..d63): one bit of each of 4096 minima of a shingle set. Two sets differ in half of
    (1 - similarity) of the bits on average; at 0.8 more than MOST_APART differ with a chance of 3e-7. texts: node, text
    as bytes."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes = WordHashes()
        seeds = (mix(np.arange(1, WORDS * 64 + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(32)).astype(np.uint32)
        for b in batches:
            for lo, hi in pieces(b.column(1)):
                out, names = np.zeros((hi - lo, WORDS), np.int64), []
                for i, raw in enumerate(b.column(1).slice(lo, hi - lo).to_pylist()):
                    words = raw.lower().split()
                    names.append(word_key(words))
                    grams = (np.unique(gram_hashes(hashes(words), min(shingle_words, len(words)))) >> np.uint64(32)).astype(np.uint32)
                    bits = np.empty(len(seeds), bool)
                    step = max(1, 500_000 // max(len(grams), 1))
                    for s in range(0, len(seeds), step):
                        v = grams[None, :] ^ seeds[s:s + step, None]
                        v *= np.uint32(0x9E3779B1)
                        v ^= v >> np.uint32(15)
                        v *= np.uint32(0x85EBCA77)
                        bits[s:s + step] = mix(v.min(1).astype(np.uint64)) & np.uint64(1) == 1
                    out[i] = np.packbits(bits).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(names, pa.binary()), *[pa.array(np.ascontiguousarray(out[:, k])) for k in range(WORDS)]],
                                                     ["node", "word_key", *[f"d{k}" for k in range(WORDS)]])

    kind = texts.schema["node"].dataType.simpleString()
    return map_batches(texts, run, f"node {kind}, word_key binary, " + ", ".join(f"d{k} bigint" for k in range(WORDS)))


def verified(pairs: DataFrame, texts: DataFrame, shingle_words: int, share: int) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity: 100 * shared >= share * all."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")

    def shingles(raw):
        words = raw.lower().split()
        k = min(shingle_words, len(words))
        return set(zip(*[words[i:] for i in range(k)])) if k else set()

    def run(batches):
        import pyarrow as pa

        last, known = None, set()
        for b in batches:
            keep = []
            for lo, hi in pieces(b.column(3)):
                for a, ta, tb in zip(*[b.column(i).slice(lo, hi - lo).to_pylist() for i in (0, 2, 3)]):
                    if (a, ta) != last:
                        last, known = (a, ta), shingles(ta)
                    other = shingles(tb)
                    both = len(known & other)
                    keep.append(100 * both >= share * (len(known) + len(other) - both) and both > 0)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    kind = texts.schema["node"].dataType.simpleString()
    return map_batches(joined, run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, share: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links, kept.

    docs: doc_id, text (other columns are ignored). Links join documents with 100 * shared >= share * all distinct
    shingles of `shingle_words` words (blank-separated, A-Z lowered; fewer words: the whole sequence is one shingle).
    component_id is the smallest doc_id reachable over links, kept whether that is the document itself, n_links the
    number of verified links of its class of equal word sequences (copies are linked with their class, not counted).
    Null, empty and blank texts have an empty set and are linked with nothing. A row with null doc_id takes no part
    (component_id null, kept true). Rows that repeat a doc_id act as one document with the links of each."""
    docs = pick(docs, "doc_id", "text")
    marks = stored(sketch(docs, shingle_words, bands, rows), "sketch")
    worded = marks.where("word_key IS NOT NULL AND doc_id IS NOT NULL")
    members = stored(worded.groupBy("word_key").agg(F.min("doc_id").alias("node")), "members")
    nodes = stored(worded.join(members.select("node").distinct(), worded["doc_id"] == F.col("node")).select("node", "word_key", "n_shingles", "regs", "bands").dropDuplicates(["node", "word_key"]), "nodes")
    kin = worded.select("word_key", "doc_id").join(members, "word_key").where("doc_id != node")
    classes = stored(kin.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct(), "classes")

    buckets = nodes.select("node", "word_key", "n_shingles", F.explode("bands").alias("band"))
    heads = buckets.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "head")
    shared = stored(buckets.join(heads, "band").select("band", "node", "word_key", "head", "n_shingles"), "bands")
    star = stored(shared.where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "star")
    look = stored(promising(star, nodes, share), "look")
    first = _check(look, docs, shingle_words, share)
    parts = components(first)

    placed = shared.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    open_bands = placed.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("band")
    rest = stored(placed.join(open_bands, "band").select("band", "node", "word_key", "part", "n_shingles"), "rest")
    loose = stored(rest.select("node").distinct(), "loose")
    fine = digests(_texts(docs, loose), shingle_words).dropDuplicates(["node", "word_key"])
    rest = rest.join(stored(fine.join(nodes.select("node", "word_key", "bands"), ["node", "word_key"]), "fine"), ["node", "word_key"])
    x, y = rest.alias("x"), rest.alias("y")
    apart = sum((F.bit_count(F.col(f"x.d{k}").bitwiseXOR(F.col(f"y.d{k}"))) for k in range(WORDS)), F.lit(0))
    first_shared = F.filter(F.zip_with("x.bands", "y.bands", lambda p, q: F.when(p == q, p)), lambda v: v.isNotNull())[0]
    cross = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.part") != F.col("y.part"))
                   & (F.least("x.n_shingles", "y.n_shingles") * 100 >= F.greatest("x.n_shingles", "y.n_shingles") * share)
                   & (apart <= MOST_APART) & (first_shared == F.col("x.band")))
    cross = cross.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    second = _check(stored(cross, "look"), docs, shingle_words, share)

    links = first.unionByName(second).distinct()
    ends = links.select(F.col("a").alias("n")).union(links.select("b")).groupBy("n").agg(F.count("*").alias("n_links"))
    places = stored(components(links.unionByName(classes)), "places")
    named = places.join(ends, F.col("node") == F.col("n"), "left").select(F.col("node").alias("_id"), "component", "n_links")
    out = marks.select("doc_id", "n_shingles").join(named, F.col("doc_id") == F.col("_id"), "left")
    root = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts (as bytes) of the documents named by a stored table of nodes."""
    return as_bytes(docs.join(wanted, docs["doc_id"] == wanted["node"]).select("node", "text").where("text IS NOT NULL"))


def _check(pairs: DataFrame, docs: DataFrame, shingle_words: int, share: int) -> DataFrame:
    """Verify stored pairs on the texts of the documents they name."""
    needed = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "needed")
    return stored(verified(pairs, _texts(docs, needed), shingle_words, share), "verified")


def keep_one_of_each(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, share: int = SIMILARITY) -> DataFrame:
    """Rows of docs (all columns): of each group of near duplicates the document with the smallest id, and all others.

    Rows that repeat a kept doc_id are the same document: the one with the smallest text key stays. Rows with null
    doc_id, which cannot be named, all stay."""
    groups = near_duplicates(docs, shingle_words, share)
    gone = stored(groups.where("NOT kept").select(F.col("doc_id").alias("_id")).distinct(), "gone")
    left = docs.join(gone, docs["doc_id"] == F.col("_id"), "left_anti")
    again = groups.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id"))
    again = stored(again.join(docs, F.col("_id") == docs["doc_id"]).groupBy("_id").agg(F.min(text_key(F.col("text"))).alias("_key")), "again")
    single = left.join(again, left["doc_id"] == F.col("_id"), "left_anti")
    repeated = left.join(again, (left["doc_id"] == F.col("_id")) & (text_key(left["text"]) == F.col("_key")), "left_semi")
    return single.unionByName(repeated.dropDuplicates(["doc_id"]))

"""Benchmark decontamination by winnowing.

Of every window of 10 words (6 overlapping 5-word grams) the smallest gram hash is the window's fingerprint. Equal
windows have equal fingerprints, so joining the fingerprints of texts with those of benchmark windows finds every
shared span of 10 words or more; each hit is then extended to its whole window and compared word by word. The
library's products carry no prose, so the operator is general.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tieline.llm.common import BITMAP_WORDS, WordHashes, as_bytes, bitmap, gram_hashes, held, map_batches, pick, pieces, slot, stored, text_key

WINDOW, GRAM = 10, 5


def _word_table() -> bytes:
    """Byte map that lower-cases A-Z, keeps 0-9, a-z and bytes of non-ASCII characters, and blanks the rest."""
    keep = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
    return bytes(i + 32 if 65 <= i <= 90 else i if i in keep else 32 for i in range(256))


def benchmark_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of the items: words (joined by a blank), length, fingerprint, its offset in the window, items.

    An item of fewer words than a window, but not none, is one window, fingerprinted by its whole length. `items` is
    the sorted list of the (string) ids of items that hold the window. Items without id or words have no window."""
    table = _word_table()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes = WordHashes()
        for b in batches:
            out = []
            for item, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = raw.translate(table).split() if raw else []
                n = min(len(words), window)
                if not n:
                    continue
                size = gram if n == window else n
                g = gram_hashes(hashes(words), size)
                for i in range(len(words) - n + 1):
                    at = int(np.argmin(g[i:i + n - size + 1]))
                    out.append((item, b" ".join(words[i:i + n]), n, int(g[i + at].view(np.int64)), at))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.int32()))],
                                             ["item", "words", "length", "print", "offset"])

    rows = as_bytes(items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text")).where("item IS NOT NULL"))
    return (map_batches(rows, run, "item string, words binary, length int, print bigint, offset int").groupBy("words", "length", "print", "offset")
            .agg(F.array_sort(F.collect_set("item")).alias("items")))


def winnow(docs: DataFrame, lengths: list[int], window: int = WINDOW, gram: int = GRAM, text: str = "text") -> DataFrame:
    """Fingerprints of texts: doc_id, key (see text_key), length of the windows meant, print, position of its gram.

    Full windows keep the smallest gram hash of each window (about two of seven positions); for each shorter length in
    `lengths` every gram of that length is kept."""
    table, short = _word_table(), sorted(n for n in set(lengths) if n < window)
    full = window in lengths

    def marks(h):
        import numpy as np

        if full and len(h) >= window:
            g = gram_hashes(h, gram)
            span = window - gram + 1
            n = len(g) - span + 1
            low = g[:n].copy()
            for i in range(1, span):
                np.minimum(low, g[i:i + n], out=low)
            near = np.zeros(len(g), bool)
            for i in range(span):
                near[i:i + n] |= g[i:i + n] == low
            at = np.flatnonzero(near)
            yield window, g[at], at
        for size in short:
            g = gram_hashes(h, size)
            if len(g):
                yield size, g, np.arange(len(g))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes = WordHashes()
        for b in batches:
            for lo, hi in pieces(b.column(2)):
                ids, keys, sizes, prints, at, counts = [], [], [], [], [], []
                for i, raw in zip(range(lo, hi), b.column(2).slice(lo, hi - lo).to_pylist()):
                    words = raw.translate(table).split() if raw else []
                    for size, g, pos in marks(hashes(words)) if words else ():
                        ids.append(i)
                        sizes.append(np.full(len(g), size, np.int32))
                        prints.append(g.view(np.int64))
                        at.append(pos.astype(np.int32))
                        counts.append(len(g))
                if ids:
                    rows = pa.array(np.repeat(np.array(ids), counts))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(prints)),
                                                      pa.array(np.concatenate(at))], ["doc_id", "key", "length", "print", "at"])

    rows = as_bytes(docs.select("doc_id", text_key(F.col(text)).alias("key"), F.col(text).alias("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {kind}, key bigint, length int, print bigint, at int")


def find_candidates(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Windows that may stand in a text: doc_id, key, hits array<struct<start, words, items>>, stored.

    The window table is stored first, so the join with it is a broadcast only while its size allows. A text's hits are
    bounded by its own fingerprints times the distinct windows that share one."""
    windows = stored(benchmark_windows(items, window, gram), "windows")
    lengths = [r[0] for r in windows.select("length").distinct().collect()]  # at most `window` numbers
    found = winnow(docs, lengths, window, gram).join(windows, ["length", "print"])
    hits = found.select("doc_id", "key", F.struct((F.col("at") - F.col("offset")).alias("start"), "words", "items").alias("hit")).where("hit.start >= 0")
    return stored(hits.groupBy("doc_id", "key").agg(F.collect_set("hit").alias("hits")), "candidates")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per text: doc_id, text_key, n_words, n_hit (words inside any occurring window), spans array<struct<start, stop>>
    (word positions, merged), items (sorted ids of items with an occurring window) and contaminated (n_hit > 0).

    docs: doc_id, text. items: item_id, text. Words are runs of 0-9, a-z (A-Z lowered) and non-ASCII characters. Null
    and empty texts have no words; repeated rows are judged alike, each on its own row; an empty table on either side
    gives no hits."""
    docs = pick(docs, "doc_id", "text")
    return _judge(docs, find_candidates(docs, items, window, gram))


def _judge(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Extend the candidates. All texts are counted where they are read; only texts that may have a candidate (by a
    bitmap of fixed size) travel to the join with the candidates."""
    table, bits = _word_table(), bitmap(hits, "doc_id", "key")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for lo, hi in pieces(b.column(3)):
                maybe = held(bits.value, np.array(b.column(2).slice(lo, hi - lo)))
                texts = b.column(3).slice(lo, hi - lo).to_pylist()
                counts = [len(t.translate(table).split()) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(counts, pa.int64()),
                                                  pa.array([t if m else None for t, m in zip(texts, maybe)], pa.binary())], ["doc_id", "key", "n_words", "text"])

    rows = docs.withColumn("key", text_key(F.col("text"))).select("doc_id", "key", slot("doc_id", "key").alias("slot"), F.col("text").cast("binary").alias("text"))
    counted = map_batches(rows, count, f"doc_id {kind}, key bigint, n_words bigint, text binary")
    joined = counted.alias("d").join(hits.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.key") == F.col("h.key")), "left")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo, hi in pieces(b.column(3)):
                rows = []
                for raw, cand in zip(b.column(3).slice(lo, hi - lo).to_pylist(), b.column(4).slice(lo, hi - lo).to_pylist()):
                    words = raw.translate(table).split() if cand else []
                    spans, names = [], set()
                    for c in sorted(cand or (), key=lambda c: c["start"]):
                        want = c["words"].split(b" ")
                        i, j = c["start"], c["start"] + len(want)
                        if words[i:j] == want:
                            names.update(c["items"])
                            if spans and i <= spans[-1]["stop"]:
                                spans[-1]["stop"] = max(spans[-1]["stop"], j)
                            else:
                                spans.append({"start": i, "stop": j})
                    total = sum(s["stop"] - s["start"] for s in spans)
                    rows.append((total, spans, sorted(names), total > 0))
                kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.string()), pa.bool_())
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in b.columns[:3]], *[pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]],
                                                 ["doc_id", "text_key", "n_words", "n_hit", "spans", "items", "contaminated"])

    return map_batches(joined.select("d.doc_id", "d.key", "d.n_words", "d.text", "h.hits"), run, f"doc_id {kind}, text_key bigint, n_words bigint, n_hit bigint, "
                       "spans array<struct<start:int,stop:int>>, items array<string>, contaminated boolean")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Rows of docs (all columns) that share no window with the benchmark; other rows pass unchanged."""
    hits = find_candidates(pick(docs, "doc_id", "text"), items, window, gram)
    bad = _judge(pick(docs, "doc_id", "text"), hits).where("contaminated").select("doc_id", F.col("text_key").alias("key")).distinct()
    bad = stored(bad, "contaminated")
    some, others = split_by(docs, bad)
    gone = bad.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    return others.unionByName(some.join(gone, some["doc_id"].eqNullSafe(F.col("_id")) & (text_key(some["text"]) == F.col("_key")), "left_anti"))


def split_by(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of docs whose (doc_id, text key) may be among the keys, and those for which it surely is not."""
    bits = bitmap(keys, "doc_id", "key")

    rows = docs.select("*", F.pmod(F.xxhash64(docs["doc_id"], text_key(docs["text"])), F.lit(BITMAP_WORDS * 64)).alias("_slot_"))

    def part(wanted):
        def run(batches):
            import numpy as np
            import pyarrow as pa

            for b in batches:
                keep = held(bits.value, np.array(b.column(b.num_columns - 1))) == wanted
                yield pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).filter(pa.array(keep))

        return map_batches(rows, run, docs.schema)

    return part(True), part(False)

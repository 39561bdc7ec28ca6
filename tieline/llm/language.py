"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector. A letter n-gram is the product of its letters' vectors, each rolled by its
distance from the n-gram's end; a text is the sum of its n-grams; a language is the sum of its texts, each scaled to
unit length. A text gets the language whose prototype has the largest cosine with it. The library's products carry no
prose, so the operator is general: it takes any table with a text column.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from tieline.llm.common import map_batches, pick

DIM, GRAM, SEED, PIECE = 1024, 3, 20240607, 1 << 17
SCALE = float(1 << 24)
MAX_LANGUAGES = 1000


class Encoder:
    """Sums n-gram vectors of texts. Works on pieces of at most PIECE letters, so memory does not grow with a text."""

    def __init__(self, dim: int = DIM, gram: int = GRAM):
        import numpy as np

        self.dim, self.gram, self.vectors = dim, gram, {}
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def vector(self, code: int):
        import numpy as np

        if code not in self.vectors:
            if len(self.vectors) > 20_000:
                self.vectors.clear()
            bits = np.random.Philox(key=[SEED, code]).random_raw(self.dim // 64)
            self.vectors[code] = (np.unpackbits(bits.view(np.uint8)).astype(np.int8) * 2 - 1)
        return self.vectors[code]

    def runs(self, text: str) -> Iterator:
        """Lower-cased letters as code points, every run of other characters as one 0, padded by 0 at both ends;
        consecutive pieces overlap by gram - 1 codes."""
        import numpy as np

        tail = np.zeros(1, np.uint32)
        for i in range(0, len(text) + 1, PIECE):
            codes = np.frombuffer(text[i:i + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.where(self.letter[codes], codes, 0)
            if i + PIECE > len(text):
                codes = np.append(codes, 0).astype(np.uint32)
            codes = codes[(codes != 0) | (np.append(tail[-1:], codes[:-1]) != 0)]
            codes = np.concatenate([tail, codes])
            yield codes
            tail = codes[-(self.gram - 1):]

    def encode(self, texts: list[str | None]):
        """Bundled vectors (float64, whole numbers) of texts; rows without letters are zero."""
        import numpy as np

        out = np.zeros((len(texts), self.dim))
        held, size = [], 0
        for d, text in enumerate(texts):
            for codes in self.runs(text) if text else ():
                if len(codes) >= self.gram and codes.any():
                    held.append((d, codes))
                    size += len(codes)
                if size >= PIECE:
                    self._add(out, held)
                    held, size = [], 0
        if held:
            self._add(out, held)
        return out

    def _add(self, out, held) -> None:
        import numpy as np

        alphabet, _ = np.unique(np.concatenate([c for _, c in held]), return_inverse=True)
        base, g = np.uint64(len(alphabet)), self.gram
        grams, owner, docs = [], [], sorted({d for d, _ in held})
        for d, codes in held:
            c = np.searchsorted(alphabet, codes).astype(np.uint64)
            n = len(c) - g + 1
            key = np.zeros(n, np.uint64)
            for i in range(g):
                key = key * base + c[i:i + n]
            grams.append(key)
            owner.append(np.full(n, docs.index(d), np.int64))
        keys, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        counts = np.bincount(np.concatenate(owner) * len(keys) + inverse, minlength=len(docs) * len(keys)).reshape(len(docs), len(keys)).astype(np.float32)
        letters = np.stack([self.vector(int(a)) for a in alphabet])
        for lo in range(0, len(keys), 1024):
            part, bound = keys[lo:lo + 1024].copy(), None
            for back in range(g):
                rolled = np.roll(letters, back, axis=1)[(part % base).astype(np.int64)]
                bound = rolled if bound is None else bound * rolled
                part //= base
            out[docs] += counts[:, lo:lo + 1024] @ bound.astype(np.float32)


def _texts(column, start: int, stop: int) -> list[str | None]:
    return column.slice(start, stop - start).to_pylist()


def _groups(column, most: int = 512, chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold at most `most` rows and about `chars` bytes."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, s in enumerate(sizes):
        if i > start and (total + s > chars or i - start >= most):
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)


def train_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM, gram: int = GRAM) -> DataFrame:
    """Language prototypes (lang, profile array<bigint>) from rows with a non-null lang; all rows are used.

    Unit vectors are summed as whole numbers (scaled by 2^24), so the result does not depend on the order of rows.
    Null texts and texts without letters add nothing. Each task sends one row per language and 512 texts."""
    def partial(batches):
        import numpy as np
        import pyarrow as pa

        enc = Encoder(dim, gram)
        for b in batches:
            texts, langs = b.column(0), b.column(1).to_pylist()
            for lo, hi in _groups(texts):
                x = enc.encode(_texts(texts, lo, hi))
                norm = np.sqrt((x * x).sum(1))
                unit = np.rint(x * (SCALE / np.where(norm > 0, norm, 1))[:, None]).astype(np.int64)
                names = sorted(set(langs[lo:hi]))
                sums = [unit[[i for i, v in enumerate(langs[lo:hi]) if v == n]].sum(0) for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([s.tolist() for s in sums], pa.list_(pa.int64()))], ["lang", "part"])

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull())
    parts = map_batches(rows, partial, "lang string, part array<bigint>")
    sums = parts.select("lang", F.posexplode("part").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    return sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("profile"))


def collect_profiles(profiles: DataFrame, most: int = MAX_LANGUAGES) -> tuple[list[str], list[list[int]]]:
    """Prototypes on the driver: at most `most` languages of fixed-length vectors (8 MB); more are an error."""
    rows = profiles.orderBy("lang").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} languages in the labels")
    rows = [r for r in rows if any(r["profile"])]
    return [r["lang"] for r in rows], [r["profile"] for r in rows]


def _predictor(names: list[str], profiles: list[list[int]], dim: int, gram: int):
    """Function from an Arrow text column to (languages, scores) lists."""
    def make():
        import numpy as np

        enc = Encoder(dim, gram)
        proto = np.array(profiles, np.float64).reshape(len(names), dim)
        proto /= np.maximum(np.sqrt((proto * proto).sum(1)), 1e-300)[:, None]

        def predict(column):
            langs, scores = [], []
            for lo, hi in _groups(column):
                x = enc.encode(_texts(column, lo, hi))
                norm = np.sqrt((x * x).sum(1))
                for row, length in zip(x, norm):
                    cos = np.round(proto @ row / length, 9) if length > 0 and names else None
                    best = int(cos.argmax()) if cos is not None else -1
                    langs.append(names[best] if cos is not None else "und")
                    scores.append(float(min(max(cos[best], 0.0), 1.0)) if cos is not None else 0.0)
            return langs, scores

        return predict

    return make


def identify_language(docs: DataFrame, profiles: DataFrame, keep: list[str], text: str = "text", dim: int = DIM, gram: int = GRAM) -> DataFrame:
    """One row per text: the `keep` columns, lang_pred and score.

    lang_pred is the learned language with the largest cosine (of equal cosines the first by name), score that cosine
    cut to 0..1. A text that is null or has no letter, and every text when nothing was learned, gets `und` and 0. Only
    the text is looked at. Whole texts are read; long ones in pieces of 2^17 letters, which gives the same vector."""
    make = _predictor(*collect_profiles(profiles), dim, gram)

    def run(batches):
        import pyarrow as pa

        predict = make()
        for b in batches:
            langs, scores = predict(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=pa.schema(
                [*[b.schema.field(i) for i in range(b.num_columns - 1)], pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]))

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_batches(rows, run, f"{schema}, lang_pred string, score double")


def keep_languages(docs: DataFrame, profiles: DataFrame, accepted: list[str] | None = None, least: float = 0.0,
                   text: str = "text", dim: int = DIM, gram: int = GRAM) -> DataFrame:
    """Rows whose predicted language is accepted (any learned one if not named) with at least the given score.

    Rows pass unchanged with all their columns, repeated rows included; null texts and texts without letters go."""
    make = _predictor(*collect_profiles(profiles), dim, gram)
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        predict = make()
        for b in batches:
            langs, scores = predict(b.column(at))
            yield b.filter(pa.array([v != "und" and s >= least and (accepted is None or v in accepted) for v, s in zip(langs, scores)], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def is_held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the decimal id falls in the given part; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """Text and lang of the labelled rows outside the held-out part."""
    return pick(docs, "doc_id", "text", "lang").where(~is_held_out(F.col("doc_id"), 4, 2) & F.col("lang").isNotNull())

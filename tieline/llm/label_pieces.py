"""SentencePiece (BPE) encoding and decoding of product labels.

A token sequence is the BPE encoding of a text exactly if every two neighbours, merged anew from their characters, come
out as the same two tokens. So a text is cut from left to right: the longest piece that starts at a position
(Aho-Corasick) is tried first, then its ever shorter prefixes that are pieces, each checked against the token before it
by re-merging the two. Where none fits, the position cannot be a token border: it is marked in a bitfield and the token
before is taken back. The encoding of a prefix is unique, so a marked position is never tried again and the work stays
proportional to the text.

Merging is what the library does: of all neighbours whose concatenation is a piece those with the highest score are
merged first, of equal scores the leftmost. Texts are normalised by the library's own normaliser and decoded by its
decode(). Characters that are in no piece become byte tokens.

The project's texts are its product labels (path, xml); any table with a key and a text column can be given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tieline.llm.common import map_batches, pieces as batch_pieces

MODEL_LIMIT = 64 << 20
SEEN_CHARS, SEEN_PAIRS = 4_000_000, 300_000


def load_model(path: str) -> bytes:
    """A model file as bytes, which go to the workers with the job: at most 64 MB, BPE, and without user-defined or
    unused pieces (they are matched by other rules); anything else is an error."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as f:
        model = f.read(MODEL_LIMIT + 1)
    if len(model) > MODEL_LIMIT:
        raise ValueError(f"model file of more than {MODEL_LIMIT} bytes")
    proto = pb.ModelProto()
    proto.ParseFromString(model)
    kinds = pb.ModelProto.SentencePiece
    if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
        raise ValueError("only BPE models without user-defined and unused pieces are handled")
    return model


class Vocabulary:
    """Pieces, their scores and an Aho-Corasick automaton; a worker builds it once a model.

    Tokens are numbered by place in `text`: first the model's pieces, then characters that occur in pieces without being
    one. `units` holds what a token stands for in the output: its id, or the ids of its bytes."""

    def __init__(self, model: bytes):
        import ahocorasick
        import numpy as np
        from sentencepiece import SentencePieceProcessor

        self.sp = sp = SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        bytes_at = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        own = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.text = [sp.id_to_piece(i) for i in own]
        # merged lowest first, so the scores change sign
        self.rank = {t: -sp.get_score(i) for t, i in zip(self.text, own)}
        alphabet = set("".join(self.text))
        self.text += sorted(alphabet - set(self.text))
        self.place = {t: k for k, t in enumerate(self.text)}
        self.size = [len(t) for t in self.text]
        pack = lambda ids: np.array(ids, np.int32).tobytes()
        self.unknown = lambda c: pack([bytes_at[b] for b in c.encode("utf-8")] if bytes_at else [sp.unk_id()])
        self.units = [pack([i]) for i in own] + [self.unknown(c) for c in self.text[len(own):]]
        self.shorter = [next((self.place[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.place), -1) for t in self.text]
        # tokens that start at a position are those whose reverse ends there in the reversed text
        self.ends = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, t in enumerate(self.text):
            self.ends.add_word(t[::-1], k)
        self.ends.make_automaton()
        self.alphabet, self.cut = alphabet, self._cutter(alphabet)
        self.fits: list[dict[int, int]] = [{} for _ in range(len(self.text) + 1)]  # the last row is that of no left token
        self.n_fits = 0
        self.seen = Parts(self)

    def _cutter(self, alphabet: set[str]):
        """A pattern that cuts a text into parts over whose borders no piece reaches, so that each part is encoded by
        itself: before any `opening` character that follows another one, and around characters of no piece."""
        import re

        before: dict[str, set[str]] = {}
        for t in self.text:
            for a, b in zip(t, t[1:]):
                before.setdefault(b, set()).add(a)
        opening = {c for c in alphabet if not c.isalpha()}
        while stuck := {c for c in opening if before.get(c, set()) - opening}:
            opening -= stuck
        group = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]"
        first, rest = sorted(opening), sorted(alphabet - opening)
        parts = [group(first) + "+" + (group(rest) + "*" if rest else "")] if first else []
        parts += [group(rest) + "+"] if rest else []
        return re.compile("|".join([*parts, "(?s:.)"])).findall

    def merge(self, text: str) -> list[str]:
        """Characters merged pair by pair, best score first and leftmost among equals."""
        rank, none = self.rank, float("inf")
        parts = list(text)
        gain = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while gain:
            best = min(gain)
            if best == none:
                break
            i = gain.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del gain[i]
            if i:
                gain[i - 1] = rank.get(parts[i - 1] + parts[i], none)
            if i < len(gain):
                gain[i] = rank.get(parts[i] + parts[i + 1], none)
        return parts

    def fit(self, left: int, right: int) -> int:
        """The longest token among `right` and the pieces that are prefixes of it that survives being merged anew with
        `left` before it (or, with left -1, by itself); -1 if there is none. Remembered in the left token's row."""
        row, tried = self.fits[left], []
        before = self.text[left] if left >= 0 else ""
        found = -1
        while right >= 0:
            known = row.get(right)
            if known is not None:
                found = known
                break
            tried.append(right)
            token = self.text[right]
            if self.merge(before + token) == ([before, token] if before else [token]):
                found = right
                break
            right = self.shorter[right]
        if self.n_fits >= SEEN_PAIRS:
            for other in self.fits:
                other.clear()
            self.n_fits = 0
        self.n_fits += len(tried)
        row.update(dict.fromkeys(tried, found))
        return found

    def tokens(self, part: str) -> list[int]:
        """Tokens of a part that consists of the alphabet's characters, by backtracking. Positions count down from the
        part's length, as in the reversed text; the automaton names the longest match of an end first. A set bit of
        `failed` marks the position before that many characters from the end."""
        longest: dict[int, int] = {}
        self.ends.find_all(part[::-1], longest.setdefault)
        size, shorter, fits, fit = self.size, self.shorter, self.fits, self.fit
        failed = None
        out: list[int] = []
        at = len(part) - 1
        left, k, row = -1, longest[at], fits[-1]
        while True:
            good = row.get(k)
            if good is None:
                good = fit(left, k)
            if good >= 0:
                end = at - size[good]
                if failed is None or not failed[end + 1 >> 3] >> (end + 1 & 7) & 1:
                    out.append(good)
                    if end < 0:
                        return out
                    at, left, row, k = end, good, fits[good], longest[end]
                    continue
                k = shorter[good]
            else:
                k = -1
            while k < 0:
                if failed is None:
                    failed = bytearray((len(part) >> 3) + 1)
                failed[at + 1 >> 3] |= 1 << (at + 1 & 7)
                last = out.pop()
                at += size[last]
                left, k = out[-1] if out else -1, shorter[last]
                row = fits[left]

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed 32-bit numbers."""
        out = b"".join(map(self.seen.__getitem__, self.cut(self.sp.normalize(text))))
        if self.seen.chars > SEEN_CHARS:
            self.seen.before = {}
            self.seen = Parts(self, self.seen)
        return out


class Parts(dict):
    """Packed ids of the parts met so far; a part that neither this nor the generation before knows is encoded when it
    is asked for. So frequent parts stay known when the older generation is given up."""

    def __init__(self, vocab: Vocabulary, before: dict[str, bytes] | None = None):
        super().__init__()
        self.vocab, self.chars, self.before = vocab, 0, before or {}

    def __missing__(self, part: str) -> bytes:
        v = self.vocab
        ids = self.before.get(part)
        if ids is None:
            ids = b"".join([v.units[k] for k in v.tokens(part)]) if part[0] in v.alphabet else v.unknown(part)
        self[part] = ids
        self.chars += len(part)
        return ids


_LOADED: dict[bytes, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """The worker's vocabulary of a model, kept from task to task."""
    if model not in _LOADED:
        _LOADED.clear()
        _LOADED[model] = Vocabulary(model)
    return _LOADED[model]


def _with_last(batch, column, name: str, kind):
    import pyarrow as pa

    fields = [batch.schema.field(i) for i in range(batch.num_columns - 1)]
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], column], schema=pa.schema([*fields, pa.field(name, kind)]))


def _schema(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields[:-1])


def encode_labels(labels: DataFrame, model: bytes, keep: list[str] | None = None, xml: str = "xml") -> DataFrame:
    """One row per label: the `keep` columns (path if not named) and ids array<int>, as the library's encode() gives
    them without begin and end ids. A null or empty text has no ids; rows that repeat a key or a text each get theirs.
    Texts are encoded whole. Bytes that are not UTF-8 count as U+FFFD. A kept column named `ids` is replaced."""
    sent = labels.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        vocab = vocabulary(sent.value)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for lo, hi in batch_pieces(texts):
                packed = [vocab.encode(t.decode("utf-8", "replace")) if t else b"" for t in texts.slice(lo, hi - lo).to_pylist()]
                ends = np.zeros(hi - lo + 1, np.int32)
                np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield _with_last(b.slice(lo, hi - lo), ids, "ids", pa.list_(pa.int32()))

    rows = labels.select(*[F.col(f"`{c}`") for c in keep or ["path"] if c != "ids"], F.col(f"`{xml}`").cast("binary").alias("_text_"))
    return map_batches(rows, run, f"{_schema(rows)}ids array<int>")


def decode_labels(encoded: DataFrame, model: bytes, keep: list[str] | None = None, ids: str = "ids", xml: str = "xml") -> DataFrame:
    """One row per id list: the `keep` columns (path if not named) and the text, as the library's decode(ids) gives it.
    A null list gives null, an empty one the empty text. A kept column with the text's name is replaced."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        sp = vocabulary(sent.value).sp
        for b in batches:
            lists = b.column(b.num_columns - 1)
            units, edges = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
            known = lists.is_valid().to_pylist()
            texts = [sp.decode(units[lo:hi].tolist()) if lo < hi else "" if ok else None for lo, hi, ok in zip(edges, edges[1:], known)]
            yield _with_last(b, pa.array(texts, pa.string()), xml, pa.string())

    rows = encoded.select(*[F.col(f"`{c}`") for c in keep or ["path"] if c != xml], F.col(f"`{ids}`").alias("_ids_"))
    return map_batches(rows, run, f"{_schema(rows)}`{xml}` string")


def ids_digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def encode_and_decode(labels: DataFrame, model: bytes, key: str = "path", xml: str = "xml") -> DataFrame:
    """Per label: the key, n_tokens, ids_sha256 and decoded_sha256 (of the decoded text's UTF-8)."""
    ids = encode_labels(labels, model, [key], xml).withColumn("n_tokens", F.size("ids").cast("bigint")).withColumn("ids_sha256", ids_digest(F.col("ids")))
    text = decode_labels(ids, model, [key, "n_tokens", "ids_sha256"], xml="_decoded_")
    return text.select(f"`{key}`", "n_tokens", "ids_sha256", F.sha2("_decoded_", 256).alias("decoded_sha256"))


def model_from(spark: SparkSession, path: str) -> bytes:
    """Model bytes of a file that only Spark's readers reach."""
    rows = spark.read.format("binaryFile").load(path).where(F.col("length") <= MODEL_LIMIT).select("content").limit(1).collect()
    if not rows:
        raise ValueError(f"no model of at most {MODEL_LIMIT} bytes at {path}")
    return bytes(rows[0][0])

"""Fill-in-middle examples from product labels, on seekable compressed frames.

A text is stored as a list of frames: zstandard frames of at most `units` code points, each compressed by itself and
carrying the number of code points before it. A cut at a code point decompresses the one frame that holds it; digests
and searches stream over the frames in order. So, beside the row that brings a text in, no step holds more of it than
its compressed frames and one frame in plain form. What is made of a text (prefix, suffix and middle in the wanted
order, each after its mark) is a list of frames again, and so is the text rebuilt from that.

The project's texts are its product labels (path, xml); any table with a key and a text column can be given.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

from pyspark.sql import DataFrame, functions as F

from tieline.llm.common import map_batches, stored

UNITS, LEVEL, BLOCK = 4096, 3, 1 << 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
RATE, SUFFIX_FIRST = 90, 20
FRAMES = "array<struct<first_unit: bigint, n_units: int, frame: binary>>"


def count_units(data: bytes) -> int:
    """Code points of UTF-8 bytes: all bytes but continuation bytes."""
    import numpy as np

    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


def unit_offset(data: bytes, units: int) -> int:
    """Byte offset after the first `units` code points."""
    import numpy as np

    if units <= 0:
        return 0
    starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return int(starts[units]) if units < len(starts) else len(data)


class Frames:
    """Makes and reads frames; one for a task, since its compressor is used again and again."""

    def __init__(self, units: int = UNITS, level: int = LEVEL):
        import zstandard

        self.units = units
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.unpack = zstandard.ZstdDecompressor().decompress

    def write(self, parts: Iterable[bytes]) -> list[dict]:
        """Frames of the text that the parts make up. All but the last hold `units` code points."""
        import numpy as np

        out, first, held = [], 0, b""

        def add(data: bytes, n: int) -> None:
            nonlocal first
            out.append({"first_unit": first, "n_units": n, "frame": self.pack(data)})
            first += n

        for part in parts:
            for lo in range(0, len(part), BLOCK):
                held += part[lo:lo + BLOCK]
                if len(held) <= self.units:
                    continue
                starts = np.flatnonzero((np.frombuffer(held, np.uint8) & 0xC0) != 0x80)
                full = max(len(starts) - 1, 0) // self.units  # one unit at least stays behind: its bytes may go on
                edges = [0, *starts[self.units:full * self.units + 1:self.units].tolist()]
                for x, y in zip(edges, edges[1:]):
                    add(held[x:y], self.units)
                held = held[edges[-1]:]
        if held:
            add(held, count_units(held))
        return out

    def read(self, frames: list[dict], start: int = 0, stop: int | None = None) -> Iterator[bytes]:
        """The text between two code points, frame by frame; frames outside are not decompressed."""
        if not frames:
            return
        stop = frames[-1]["first_unit"] + frames[-1]["n_units"] if stop is None else stop
        at = max(bisect_right(frames, start, key=lambda f: f["first_unit"]) - 1, 0)
        for f in frames[at:]:
            first = f["first_unit"]
            if first >= stop:
                return
            if start >= first + f["n_units"]:
                continue
            data = self.unpack(f["frame"])
            hi = unit_offset(data, stop - first) if stop < first + f["n_units"] else len(data)
            yield data[unit_offset(data, start - first) if start > first else 0:hi]

    def find(self, frames: list[dict], marks: tuple[bytes, ...]) -> dict[bytes, int]:
        """Code point of each mark's first place (marks that do not occur are left out); a mark may cross frames."""
        most = max(map(len, marks)) - 1
        found, tail, before = {}, b"", 0
        for data in self.read(frames):
            window = tail + data
            for m in marks:
                at = window.find(m) if m not in found else -1
                if at >= 0:
                    found[m] = before + count_units(window[:at])
            if len(found) == len(marks):
                break
            cut = len(window) - most if len(window) > most else 0
            while cut > 0 and window[cut] & 0xC0 == 0x80:
                cut -= 1
            before, tail = before + count_units(window[:cut]), window[cut:]
        return found


def digest(parts: Iterable[bytes]) -> str:
    h = sha256()
    for p in parts:
        h.update(p)
    return h.hexdigest()


def draws(key: str | None, seed: int = 1) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers from the key: the first 8-digit groups of the SHA-256 of `seed:key`."""
    h = sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(h[i:i + 4], "big") for i in (0, 4, 8, 12))


def choose(n: int, marked: bool, key: str | None, seed: int, rate: int, suffix_first: int) -> tuple[str, int, int]:
    """Form of the example and the two cuts, in code points."""
    a, b, c, d = draws(key, seed)
    cuts = sorted((a % (n + 1), b % (n + 1)))
    form = "plain" if n == 0 or marked or c % 100 >= rate else "spm" if d % 100 < suffix_first else "psm"
    return form, *cuts


def frame_labels(labels: DataFrame, key: str = "path", xml: str = "xml", units: int = UNITS, level: int = LEVEL) -> DataFrame:
    """One row per label: the key, n_units (code points) and its frames. A null or empty text has no frames. Extra
    columns are left behind; repeated rows stay. Bytes that are not UTF-8 are kept as they are."""
    def rows_of(batches):
        io = Frames(units, level)
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1)):
                frames = io.write([text.as_py()] if text.is_valid else [])
                yield {key: k, "n_units": frames[-1]["first_unit"] + frames[-1]["n_units"] if frames else 0, "frames": frames}

    run = in_batches(rows_of, {key: "text", "n_units": "long", "frames": "frames"}, "frames")
    rows = labels.select(F.col(f"`{key}`").cast("string").alias(key), F.col(f"`{xml}`").cast("binary").alias("_text_"))
    return map_batches(rows, run, f"`{key}` string, n_units bigint, frames {FRAMES}")


def arrow_frames():
    import pyarrow as pa

    return pa.list_(pa.struct([pa.field("first_unit", pa.int64()), pa.field("n_units", pa.int32()), pa.field("frame", pa.binary())]))


def in_batches(make: Callable[..., Iterator[dict]], fields: dict[str, str], frames: str, most: int = 1 << 20):
    """Turn a generator of row dictionaries into one of record batches of about `most` bytes of frames."""
    def run(batches):
        import pyarrow as pa

        kinds = {"text": pa.string(), "long": pa.int64(), "frames": arrow_frames()}
        schema = pa.schema([pa.field(n, kinds[k]) for n, k in fields.items()])
        held, size = [], 0
        for row in make(batches):
            held.append(row)
            size += 200 + sum(len(f["frame"]) for f in row[frames])
            if size >= most:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def store_frames(labels: DataFrame, key: str = "path", xml: str = "xml", units: int = UNITS, level: int = LEVEL) -> DataFrame:
    """frame_labels written to the shared folder and read back: later steps, and tasks that replace lost ones, start
    from the frames."""
    return stored(frame_labels(labels, key, xml, units, level), "frames")


def fill_in_middle(framed: DataFrame, key: str = "path", seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, units: int = UNITS) -> DataFrame:
    """One example per framed text: the key, n, form, prefix_units, middle_units, output_sha256 and output (frames).

    The key's hash draws two cuts between code points; prefix, middle and suffix are what lies before, between and after
    them (any may be empty). Form: plain (the text as it is) if the text is empty, holds one of the three marks or is
    not among `rate` of 100; else spm (`<S>`suffix`<P>`prefix`<M>`middle) for `suffix_first` of 100; else psm
    (`<P>`prefix`<S>`suffix`<M>`middle). prefix_units and middle_units are null for plain. Rows that repeat a key are
    cut by the same draws; a null key draws like an empty one."""
    def rows_of(batches):
        io = Frames(units)
        for b in batches:
            for k, n, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                frames = cell.as_py() or []
                form, p, q = choose(n, bool(io.find(frames, (PREFIX, SUFFIX, MIDDLE))), k, seed, rate, suffix_first)
                order = {"plain": [(b"", 0, n)], "psm": [(PREFIX, 0, p), (SUFFIX, q, n), (MIDDLE, p, q)], "spm": [(SUFFIX, q, n), (PREFIX, 0, p), (MIDDLE, p, q)]}[form]
                output = io.write(part for mark, lo, hi in order for part in (mark, *(io.read(frames, lo, hi) if lo < hi else ())))
                cut = form != "plain"
                yield {key: k, "n": n, "form": form, "prefix_units": p if cut else None, "middle_units": q - p if cut else None,
                       "output_sha256": digest(io.read(output)), "output": output}

    run = in_batches(rows_of, {key: "text", "n": "long", "form": "text", "prefix_units": "long", "middle_units": "long", "output_sha256": "text", "output": "frames"}, "output")
    rows = framed.select(F.col(f"`{key}`"), F.col("n_units"), F.col("frames"))
    return map_batches(rows, run, f"`{key}` string, n bigint, form string, prefix_units bigint, middle_units bigint, output_sha256 string, output {FRAMES}")


def restore_labels(examples: DataFrame, keep: list[str] | None = None, units: int = UNITS, frames: bool = False) -> DataFrame:
    """The exact text from each example's output and form alone: the `keep` columns (path if not named), restored_sha256
    and, if asked for, the text as frames. Marks are searched in the output; in a text that is not plain each stands
    once. An unknown form or a missing mark is an error."""
    keep = keep or ["path"]
    k = len(keep)
    schema_text = "restored_sha256 string" + (f", restored {FRAMES}" if frames else "")

    def run(batches):
        import pyarrow as pa

        io = Frames(units)
        for b in batches:
            digests, texts = [], []
            for form, cell in zip(b.column(k).to_pylist(), b.column(k + 1)):
                output = cell.as_py() or []
                n = output[-1]["first_unit"] + output[-1]["n_units"] if output else 0
                if form == "plain":
                    ranges = [(0, n)]
                else:
                    at = io.find(output, (PREFIX, SUFFIX, MIDDLE))
                    p, s, m = at[PREFIX], at[SUFFIX], at[MIDDLE]
                    ranges = {"psm": [(p + 3, s), (m + 3, n), (s + 3, m)], "spm": [(p + 3, m), (m + 3, n), (s + 3, p)]}[form]
                def parts():
                    return (x for lo, hi in ranges if lo < hi for x in io.read(output, lo, hi))  # noqa: B023
                digests.append(digest(parts()))
                texts.append(io.write(parts()) if frames else None)
            made = [pa.array(digests, pa.string())] + ([pa.array(texts, arrow_frames())] if frames else [])
            names = ["restored_sha256"] + (["restored"] if frames else [])
            fields = [b.schema.field(i) for i in range(k)] + [pa.field(n, a.type) for n, a in zip(names, made)]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *made], schema=pa.schema(fields))

    rows = examples.select(*[F.col(f"`{c}`") for c in keep], F.col("form").alias("_form_"), F.col("output"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:k])
    return map_batches(rows, run, kept + schema_text)

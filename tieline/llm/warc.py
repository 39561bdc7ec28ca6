"""WARC archives as a chunked record table.

Archived pages (page_id, url, html) become WARC/1.1 records. A record is written as rows of at most `chunk_chars`
characters: the first row holds the record's headers, each further one a continuation record with its segment number,
so that no row of the archives holds a whole oversized record. Chunks leave the writer one by one, each with the digest
of the payload so far; beside them only the page's own row is held. The reader holds one whole compressed archive (a
file above 2 GB fails). Equal payloads are stored once; later ones are revisit records. Reading turns archives back into chunk rows and sums up each record chunk by chunk with
a running SHA-1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieline.llm.common import map_batches

CHUNK_CHARS = 1 << 18
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
HEADER_DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One narrow row per distinct page row: record_id, page_id, digest (hex SHA-1 of the UTF-8 html), payload_bytes,
    record_type and refers_to (a record_id).

    Of records with equal payloads of at least `min_bytes` bytes the one with the smallest page_id (of several, with the
    smallest record_id) is a response, the others are revisits that refer to it; smaller ones are all responses. Null
    html is an empty payload. A null page_id comes after all others."""
    named = _named(pages).select("record_id", "page_id", "digest", F.octet_length("html").cast("bigint").alias("payload_bytes")).distinct()
    rank = F.struct(F.col("page_id").isNull().alias("unnamed"), F.col("page_id"), F.col("record_id"))
    first = named.groupBy("digest").agg(F.min(rank)["record_id"].alias("first"))
    again = (F.col("payload_bytes") >= min_bytes) & (F.col("record_id") != F.col("first"))
    return named.join(first, "digest").select("record_id", "page_id", "digest", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"),
                                              F.when(again, F.col("first")).alias("refers_to"))


def _named(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), digest and record_id, which tells page_id, payload and url."""
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    address = F.coalesce(F.sha1(F.col("url").cast("binary")), F.lit("none"))
    return base.withColumn("record_id", F.concat_ws(":", F.lit("urn:page"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "digest", address))


def chunk_rows(pages: DataFrame, min_bytes: int = 0, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The chunked record table: record_id, chunk_no (from 1), block, the bytes of one WARC record each, and digest_so_far,
    the payload's SHA-1 (base32) up to and including the chunk: that of the last chunk is the stated one. Beside the row
    that brings a page in, a task holds about 1 MB of chunks.

    Every row of pages has its record. Equal rows travel as one with their number; from the second on they have that
    number in the record_id and revisit the first (below `min_bytes` they are responses). Headers of revisits carry the
    digest and length of the payload they refer to and have no block of their own."""
    plan = plan_records(pages, min_bytes).drop("page_id", "digest").hint("merge")
    body = _named(pages).groupBy("record_id").agg(F.first("url").alias("url"), F.first("html").alias("html"), F.first("digest").alias("digest"), F.count("*").alias("copies"))
    rows = body.join(plan, "record_id").select("record_id", "url", "html", "digest", "payload_bytes", "record_type", "refers_to", "copies")

    def segments(name, url, html_, hexa, size, kind, refers):
        """Chunk rows of one page, one after another: only the chunk at hand is encoded, and the payload's digest is
        carried along from chunk to chunk."""
        from base64 import b32encode
        from hashlib import sha1

        def record(fields, block):
            head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
            return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n"

        digest = b32encode(bytes.fromhex(hexa)).decode()
        target = "".join(c for c in url if c not in "\r\n") if url is not None else None
        common = [("WARC-Record-ID", f"<{name}>"), ("WARC-Date", HEADER_DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
        if kind == "revisit":
            fields = [("WARC-Type", kind), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers}>"), ("X-Payload-Length", size)]
            yield name, 1, record(fields, b""), digest
            return
        running, last = sha1(), max(1, -(-len(html_) // chunk_chars))
        for no in range(1, last + 1):
            piece = html_[(no - 1) * chunk_chars:no * chunk_chars].encode()
            running.update(piece)
            if no == 1:
                fields = [("WARC-Type", kind), *common, ("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", 1 if last > 1 else None)]
                piece = HTTP + piece
            else:
                fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:{no}>"), ("WARC-Date", HEADER_DATE), ("WARC-Segment-Origin-ID", f"<{name}>"),
                          ("WARC-Segment-Number", no), ("WARC-Segment-Total-Length", len(HTTP) + size if no == last else None)]
            yield name, no, record(fields, piece), b32encode(running.digest()).decode()

    def records(name, *page, copies):
        yield from segments(name, *page)
        *page, kind, refers = page
        if kind == "response" and page[3] >= min_bytes:
            kind, refers = "revisit", name
        for k in range(2, copies + 1):
            yield from segments(f"{name}:{k}", *page, kind, refers)

    def run(batches):
        out, held = [], 0
        for b in batches:
            for i in range(b.num_rows):
                *page, copies = [c[i].as_py() for c in b.columns]
                for row in records(*page, copies=copies):
                    out.append(row)
                    held += len(row[2])
                    if held > 1 << 20:
                        yield _chunk_batch(out)
                        out, held = [], 0
        yield _chunk_batch(out)

    return map_batches(rows, run, "record_id string, chunk_no int, block binary, digest_so_far string")


def _chunk_batch(rows):
    import pyarrow as pa

    columns = list(zip(*rows)) if rows else [()] * 4
    kinds = {"record_id": pa.string(), "chunk_no": pa.int32(), "block": pa.binary(), "digest_so_far": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, chunk_chars: int = CHUNK_CHARS) -> None:
    """Write pages as gzipped WARC files, one per task, to a folder that must not exist yet.

    Rows hold whole WARC records (segments), so any dealing of rows to files is a valid set of archives."""
    rows = chunk_rows(pages, min_bytes, chunk_chars)
    rows.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def read_chunks(spark: SparkSession, path: str, step: int = 1 << 20) -> DataFrame:
    """Chunk rows of all archives under a folder: record_id, chunk_no, record_type, page_id, refers_to, stated_digest,
    stated_bytes, payload_bytes and digest of records that are whole, else the chunk.

    Archives are unpacked `step` bytes at a time; the parser holds one segment. Only a segment of a divided record
    keeps its bytes in the row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def blocks(data):
        """(headers, block) of each record of one archive."""
        import zlib

        unpack, held = zlib.decompressobj(47), bytearray()
        fed = iter(range(0, len(data), step))

        def more():
            at = next(fed, None)
            if at is None:
                return False
            held.extend(unpack.decompress(data[at:at + step]))
            return True

        while True:
            while (end := held.find(b"\r\n\r\n")) < 0:
                if not more():
                    if held.strip():
                        raise ValueError("an archive ends inside a record's headers")
                    return
            head = dict(line.split(": ", 1) for line in held[:end].decode().split("\r\n")[1:])
            size = int(head["Content-Length"])
            while len(held) < end + 4 + size + 4:
                if not more():
                    raise ValueError("an archive ends inside a record")
            yield head, bytes(held[end + 4:end + 4 + size])
            del held[:end + 4 + size + 4]

    def run(batches):
        from base64 import b32encode
        from hashlib import sha1

        for b in batches:
            for i in range(b.num_rows):
                out = []
                for head, block in blocks(memoryview(b.column(0)[i].as_buffer())):
                    kind, part = head["WARC-Type"], int(head.get("WARC-Segment-Number", 1))
                    name = head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"]).strip("<>")
                    if kind == "response":
                        block = block[block.index(b"\r\n\r\n") + 4:]
                    whole = kind == "response" and "WARC-Segment-Number" not in head
                    page = name.split(":")[2]
                    refers = head["WARC-Refers-To"].strip("<>").split(":")[2] if "WARC-Refers-To" in head else None
                    out.append((name, part, kind, None if page == "none" else int(page), None if refers is None else int(refers), head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
                                int(head["X-Payload-Length"]) if "X-Payload-Length" in head else None, len(block) if whole else None,
                                b32encode(sha1(block).digest()).decode() if whole else None, None if whole or kind == "revisit" else block))
                    if len(out) >= 2048 or out[-1][-1] is not None:
                        yield _read_batch(out)
                        out = []
                yield _read_batch(out)

    return map_batches(files, run, "record_id string, chunk_no int, record_type string, page_id bigint, refers_to bigint, stated_digest string, stated_bytes bigint, "
                                 "payload_bytes bigint, digest string, chunk binary")


def _read_batch(rows):
    import pyarrow as pa

    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["record_id", "chunk_no", "record_type", "page_id", "refers_to", "stated_digest", "stated_bytes", "payload_bytes", "digest", "chunk"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 10, kinds)], names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives: page_id, payload_bytes, payload_digest (upper-case base32 SHA-1),
    record_type, refers_to and intact (the digest computed while reading equals the stated one).

    The chunks of a divided record are brought together in order and hashed one after another; no task holds more than
    a batch of chunks. A revisit reports the length and digest it states."""
    chunks = read_chunks(spark, path)
    whole = chunks.repartition("record_id").sortWithinPartitions("record_id", "chunk_no")

    def run(batches):
        from base64 import b32encode
        from hashlib import sha1

        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
        open_, running, size = None, None, 0

        def finish():
            digest = b32encode(running.digest()).decode()
            return open_[3], size, digest, open_[2], None, digest == open_[5]

        for b in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if open_ is not None and row[0] != open_[0]:
                    out.append(finish())
                    open_ = None
                if row[8] is not None:
                    out.append((row[3], row[7], row[8], row[2], None, row[8] == row[5]))
                elif row[2] == "revisit":
                    out.append((row[3], row[6], row[5], row[2], row[4], True))
                else:
                    if open_ is None:
                        open_, running, size = row[:9], sha1(), 0
                    running.update(row[9])
                    size += len(row[9])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], names)
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(finish(), kinds)], names)

    return map_batches(whole, run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, intact boolean")

"""WARC archives and a two-level capture index.

Writing. Records are composed natively and written by Spark's text writer, whose line separator is
the record's closing CR LF CR LF: valid, uncompressed WARC/1.1 files on any store Spark writes to,
with the committer's recovery from lost executors; a file ends where FILE_BYTES are reached. Equal payloads
are stored once: the smallest page_id holds the response, others are revisits that refer to it.

Index. One line a record, keyed by its URL with the host reversed; lines are range-sorted and cut
into compressed blocks; a sparse directory has one row a block. A lookup binary-searches the
directory, range-reads one block, bisects in it and range-reads the record: ``captures`` and ``fetch``
for one URL from the driver, ``lookup`` for a table of URLs on the executors.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Shorter payloads are never deduplicated.
MIN_DEDUP_BYTES = 100
#: An archive file passes this size by less than one record.
FILE_BYTES = 32 << 20
#: Lines of an index block (more if the directory would pass MAX_BLOCKS).
BLOCK_LINES = 2000
MAX_BLOCKS = 200_000
#: Bytes of keys the executors get of the directory at most; longer keys are cut, which costs blocks read in vain only.
DIRECTORY_BYTES = 128 << 20
#: Neighbouring records are read together up to this length.
SPAN_BYTES = 8 << 20
_RECORD = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "payload": "binary"}
#: Pages carry no capture time; records need one.
DATE = "2024-01-01T00:00:00Z"
SEPARATOR = "\r\n\r\n"
#: What would break a header line.
_ESCAPES = {"\r": "%0D", "\n": "%0A", "\t": "%09", " ": "%20"}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def reversed_host_key(url: str | None) -> str:
    """http://www.Example.org:80/a?b -> org,example,www)/a?b; a URL without a host sorts under its own text."""
    m = re.match(r"(?i)^([a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", url or "")
    if not m or not m[2]:
        return "-)" + (url or "")
    port = "" if m[3] in (None, "", "80", "443") else ":" + m[3]
    return ",".join(reversed(m[2].lower().split("."))) + port + ")" + (m[4] or "/")


def _uri(url: str | None) -> str | None:
    """The URL as a record's header has it."""
    for bad, code in _ESCAPES.items():
        url = url and url.replace(bad, code)
    return url


def decide(pages: DataFrame) -> DataFrame:
    """(digest, first, n) of the payloads that occur more than once: who holds each."""
    p = pages.select("page_id", F.octet_length("_payload").alias("_len"), F.sha2(F.col("_payload").cast("binary"), 256).alias("digest"))
    same = p.where(F.col("_len") >= MIN_DEDUP_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    return same.where((F.col("n") > 1) & F.col("first").isNotNull())


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit("\r\n"))


def compose(pages: DataFrame, same: DataFrame, total: int) -> DataFrame:
    """One column: the record of each page, without its closing separator."""
    p = pages.withColumns({"digest": F.sha2(F.col("_payload").cast("binary"), 256), "_len": F.octet_length("_payload")})
    p = common.hot_left_join(p, same, ["digest"], "n", total)
    revisit = (F.col("_len") >= MIN_DEDUP_BYTES) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    uri = F.col("url")
    for bad, code in _ESCAPES.items():
        uri = F.replace(uri, F.lit(bad), F.lit(code))
    http = F.concat(F.lit(_HTTP), F.col("_len").cast("string"), F.lit("\r\n\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\n"),
        _header("WARC-Record-ID", ident("page_id")),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        F.when(F.col("url").isNotNull(), _header("WARC-Target-URI", uri)).otherwise(""),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("X-Payload-Length", F.col("_len").cast("string")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {_PROFILE}\r\n"), _header("WARC-Refers-To", ident("first")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("_len"))).cast("string")),
        F.lit("\r\n"),
        http,
    )
    return p.select(F.concat(head, F.when(revisit, "").otherwise(F.col("_payload"))).alias("value"))


def _volumes(records: DataFrame, file_bytes: int) -> DataFrame:
    """(value, volume): a task begins a new file where ``file_bytes`` are reached. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            size = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64) + len(SEPARATOR)
            before = done + np.cumsum(size) - size
            done += int(size.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((before // file_bytes).astype(np.int32))], names=["value", "volume"])

    return records.mapInArrow(run, "value string, volume int")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = FILE_BYTES) -> None:
    """Writes an archive folder. A null payload is empty; a null URL has no target header; rows that
    repeat the smallest id of a payload are responses too, and so is a payload known by null ids only."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("_payload"))
    same = common.keep(decide(p), "payloads")
    _volumes(compose(p, same, pages.count()), file_bytes).write.option("lineSep", SEPARATOR).partitionBy("volume").mode("overwrite").text(path)


def parse(data, at: int) -> tuple[dict, int, int, int]:
    """(headers, start of the block, end of the block, start of the next record) of the record at ``at``."""
    end = data.find(b"\r\n\r\n", at)
    lines = bytes(data[at:end]).decode().split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    start = end + 4
    stop = start + int(head["content-length"])
    return head, start, stop, stop + len(SEPARATOR)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(key, id, file, offset, length, type) of every record of an archive folder, by walking its files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, at, rows = content.as_buffer().to_pybytes(), 0, []
                while at < len(data):
                    head, _, _, nxt = parse(data, at)
                    rows.append((reversed_host_key(head.get("warc-target-uri")), head["warc-record-id"], name, at, nxt - at, head["warc-type"]))
                    at = nxt
                cols = list(zip(*rows)) if rows else [[]] * 6
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "id", "file", "offset", "length", "type"])

    return _files(spark, path).mapInArrow(run, "key string, id string, file string, offset long, length long, type string")


@dataclass
class CaptureIndex:
    """The directory (first key, last key, file, offset, length of each block) stays sorted on the driver:
    at most MAX_BLOCKS rows, since blocks grow with the archive."""

    spark: SparkSession
    archive: str
    path: str
    directory: list[tuple[str, str, str, int, int]]

    @classmethod
    def build(cls, spark: SparkSession, archive: str, path: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
        lines = common.keep(scan(spark, archive), "captures")
        n = lines.count()
        per = max(block_lines, -(-n // MAX_BLOCKS))
        parts = max(1, min(common.shuffle_parts(spark), n // (8 * per)))  # eight full blocks a file at least

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def block(rows):
                body = zlib.compress("\n".join("\t".join(map(str, r)) for r in rows).encode())
                return f"{rows[0][0]}\t{rows[-1][0]}\t{len(body)}\n".encode() + body

            held: list[tuple] = []
            for batch in batches:
                held += list(zip(*(c.to_pylist() for c in batch.columns)))
                out = []
                while len(held) >= per:
                    out.append(block(held[:per]))
                    held = held[per:]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([block(held)], pa.binary())], names=["value"])

        # a record's line is spread by its id too, so that one host or URL with a third of all captures fills many blocks
        ordered = lines.repartitionByRange(parts, "key", "id", "file", "offset").sortWithinPartitions("key", "id", "file", "offset")
        ordered.mapInArrow(blocks, "value binary").select(F.col("value").cast("string")).write.mode("overwrite").text(path)
        return cls.open(spark, archive, path)

    @classmethod
    def open(cls, spark: SparkSession, archive: str, path: str) -> CaptureIndex:
        """Reads the directory from the blocks' headers."""

        def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    rows = [(a, z, name, s, n) for a, z, s, n in _walk(content.as_buffer().to_pybytes())]
                    cols = list(zip(*rows)) if rows else [[]] * 5
                    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["first", "last", "file", "offset", "length"])

        d = _files(spark, path).mapInArrow(heads, "first string, last string, file string, offset long, length long")
        return cls(spark, archive, path, sorted(tuple(r) for r in d.collect()))

    def _range(self, file: str, offset: int, length: int) -> bytes:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(file)
        stream = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(p)
        try:
            stream.seek(offset)
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
        finally:
            stream.close()

    def captures(self, url: str) -> list[tuple]:
        """(key, id, file, offset, length, type) of every record of a URL."""
        key, out = reversed_host_key(_uri(url)), []
        at = max(0, bisect.bisect_left([d[0] for d in self.directory], key) - 1)
        for first, last, file, offset, length in self.directory[at:]:
            if first > key:
                break
            if last >= key:
                rows = _rows(self._range(file, offset, length))
                out += rows[bisect.bisect_left(rows, (key,)) : bisect.bisect_left(rows, (key + "\0",))]
        return out

    def fetch(self, capture: tuple) -> tuple[dict, bytes]:
        """(headers, payload) of a capture, by a range read of its archive."""
        data = self._range(capture[2], capture[3], capture[4])
        head, start, stop, _ = parse(data, 0)
        return head, data[data.index(b"\r\n\r\n", start) + 4 : stop]

    def lookup(self, urls: DataFrame, url_col: str = "url") -> DataFrame:
        """Every record of the given URLs, once, in the columns of :meth:`read`; nothing for unknown ones.

        Keys are made different first, so that a URL asked for by a third of all rows is one key. Each
        is sought in the directory by binary search; a block is range-read once by the task that has its
        keys, bisected, and the records it points to are range-read file by file, neighbours together.
        Null URLs ask for the records without one. On a store that ``pyarrow.fs`` does not open, Spark
        brings the files that blocks and records lie in, and both are cut out of them at the same places.
        """
        blocks = self.directory
        cut = max(64, DIRECTORY_BYTES // (8 * max(1, len(blocks))))  # characters: two keys of up to four bytes each
        firsts, lasts = [d[0][:cut] for d in blocks], [d[1][:cut] for d in blocks]
        files = sorted({d[2] for d in blocks})
        places = [(bisect.bisect_left(files, d[2]), d[3], d[4]) for d in blocks]
        shared = self.spark.sparkContext.broadcast((firsts, lasts, files, places))

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = {reversed_host_key(_uri(u)) for u in batch.column(0).to_pylist()}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["key"])

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            firsts, lasts, files, places = shared.value
            for batch in batches:
                rows = []
                for key in batch.column(0).to_pylist():
                    short = key[:cut]
                    at = bisect.bisect_left(lasts, short)
                    while at < len(firsts) and firsts[at] <= short:
                        f, o, n = places[at]
                        rows.append((files[f], o, n, key))
                        at += 1
                cols = list(zip(*rows)) if rows else [[]] * 4
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file", "offset", "length", "key"])

        def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read, held, lines = _reader(), None, []
            for batch in batches:
                out = []
                for file, offset, length, key in zip(*(c.to_pylist() for c in batch.columns)):
                    if held != (file, offset):
                        held, lines = (file, offset), _rows(read(file, offset, length))
                    out += _bisected(lines, key)
                yield _places(out)

        def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content, at in zip(batch.column(0), batch.column(1).to_pylist()):
                    data, held, lines, out = content.as_buffer(), None, [], []
                    for x in at:
                        if held != x["offset"]:
                            held, lines = x["offset"], _rows(data.slice(x["offset"], x["length"]).to_pybytes())
                        out += _bisected(lines, x["key"])
                    yield _places(out)

        def open_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = _reader()
            for batch in batches:
                for file, at in _spans(list(zip(*(c.to_pylist() for c in batch.columns)))):
                    start = at[0][0]
                    data = read(file, start, at[-1][0] + at[-1][1] - start)
                    yield _records([_row(data[o - start : o - start + n]) for o, n in at])

        wanted = urls.select(F.col(url_col).cast("string").alias("url")).mapInArrow(keys, "key string").distinct()
        blocks = wanted.mapInArrow(find, "file string, offset long, length long, key string")
        if not self.range_reads():
            captures = self._with_content(self.path, blocks, "offset", "length", "key").mapInArrow(cut_blocks, "file string, offset long, length long")
            return self._with_content(self.archive, captures, "offset", "length").mapInArrow(_cut_records, ", ".join(f"{c} {t}" for c, t in _RECORD.items()))
        blocks = blocks.repartition("file", "offset").sortWithinPartitions("file", "offset")
        captures = blocks.mapInArrow(open_blocks, "file string, offset long, length long").repartition("file").sortWithinPartitions("file", "offset")
        return captures.mapInArrow(open_records, ", ".join(f"{c} {t}" for c, t in _RECORD.items()))

    def range_reads(self) -> bool:
        """Whether ``pyarrow.fs`` opens the store of the archive and the index, so that executors can read ranges."""
        try:
            _store(self.archive), _store(self.path)
        except (OSError, ValueError, NotImplementedError, ImportError):
            return False
        return True

    def entries(self) -> DataFrame:
        """All index lines: the blocks, decompressed by the executors."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(1):
                    data = content.as_buffer().to_pybytes()
                    for _, _, s, n in _walk(data):
                        cols = list(zip(*_rows(data[s : s + n])))
                        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "id", "file", "offset", "length", "type"])

        return _files(self.spark, self.path).mapInArrow(run, "key string, id string, file string, offset long, length long, type string")

    def read(self) -> DataFrame:
        """Every record through the index: (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload).

        Index lines meet the archive file they point into (a file is of bounded size) and the records
        are cut out at their offsets. The payload of a response must have the digest its header
        states; a revisit has no payload of its own (null).
        """
        return self._with_content(self.archive, self.entries(), "offset", "length").mapInArrow(_cut_records, ", ".join(f"{c} {t}" for c, t in _RECORD.items()))

    def _with_content(self, path: str, places: DataFrame, *cols: str) -> DataFrame:
        """(content, at) of the files of ``path`` that have places (file, cols); a file is of bounded size."""
        per = places.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("at"))
        per = F.broadcast(per) if len(self.directory) <= 64 else per  # 64 blocks have a few MB of places at most
        return _files(self.spark, path).withColumnRenamed("path", "file").join(per, "file").select("content", "at")


def _store(uri: str):
    """(file system, path) of a URI as Spark writes it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _reader():
    """read(file, offset, length): a range read; the last file stays open."""
    held = [None, None]

    def read(file: str, offset: int, length: int) -> bytes:
        if held[0] != file:
            store, path = _store(file)
            held[:] = file, store.open_input_file(path)
        return held[1].read_at(length, offset)

    return read


def _spans(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(file, [(offset, length)]): neighbours in sorted rows, of up to SPAN_BYTES together or one record."""
    held: list[tuple[int, int]] = []
    of = None
    for file, offset, length in rows:
        if held and (file != of or offset != held[-1][0] + held[-1][1] or offset + length - held[0][0] > SPAN_BYTES):
            yield of, held
            held = []
        of = file
        held.append((offset, length))
    if held:
        yield of, held


def _bisected(lines: list[tuple], key: str) -> list[tuple[str, int, int]]:
    """(file, offset, length) of the captures of a key among a block's lines."""
    return [r[2:5] for r in lines[bisect.bisect_left(lines, (key,)) : bisect.bisect_left(lines, (key + "\0",))]]


def _places(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 3
    kinds = [pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file", "offset", "length"])


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records at their places in the files' contents."""
    for batch in batches:
        for content, at in zip(batch.column(0), batch.column(1).to_pylist()):
            data = content.as_buffer()
            for x in range(0, len(at), 500):
                yield _records([_row(data.slice(s["offset"], s["length"]).to_pybytes()) for s in at[x : x + 500]])


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(_RECORD))


def _walk(data: bytes) -> Iterator[tuple[str, str, int, int]]:
    """(first key, last key, start, length) of each block of an index file."""
    at = 0
    while at < len(data):
        end = data.index(b"\n", at)
        first, last, n = data[at:end].decode().split("\t")
        yield first, last, end + 1, int(n)
        at = end + 1 + int(n) + 1


def _rows(block: bytes) -> list[tuple]:
    rows = (x.split("\t") for x in zlib.decompress(block).decode().split("\n"))
    return [(k, i, f, int(o), int(n), t) for k, i, f, o, n, t in rows]


def _row(data: bytes) -> tuple:
    head, start, stop, _ = parse(data, 0)
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    payload = None
    if head["warc-type"] == "response":
        payload = data[data.index(b"\r\n\r\n", start) + 4 : stop]
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{head['warc-record-id']}: the payload does not have its digest")
        if len(payload) != int(head["x-payload-length"]):
            raise ValueError(f"{head['warc-record-id']}: the payload does not have its length")
    ident = lambda v: None if v is None or v == "<urn:page:null>" else int(v[10:-1])
    return ident(head["warc-record-id"]), head.get("warc-target-uri"), int(head["x-payload-length"]), digest, head["warc-type"], ident(head.get("warc-refers-to")), payload


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    archive, index = common.scratch_path(spark, "warc"), common.scratch_path(spark, "index")
    write(pages, archive)
    ix = CaptureIndex.build(spark, archive, index)
    return ix.lookup(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first, count(*) AS n FROM p WHERE payload_bytes >= {MIN_DEDUP_BYTES} GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes::BIGINT AS payload_bytes, p.payload_digest, CASE WHEN first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> p.page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= {MIN_DEDUP_BYTES}"""

"""WARC archives with a two-level capture index.

Writing: each task compresses its records one by one (gzip members, so each can
be read alone) into archive files in the shared folder. Records with a payload
that another record holds become revisits of the one with the largest page_id.
File names carry the task attempt; the manifest, a table that Spark commits,
says which files count, so attempts that were lost or repeated do no harm.

Index: the manifest's captures are range-partitioned and sorted by their
reversed-host URL key (SURT) and packed into compressed blocks of ``LINES``
lines. The directory, a sorted table, keeps one row per block: first and last
key, file, offset, length. A look-up sorts its URLs by key; each task reads the
slice of the directory that its keys span and finds each key's blocks by binary
search. The blocks are dealt to tasks, so that a URL with very many captures is
no single task's work; a task reads a block once, finds the lines of its keys
by binary search, and the records' ranges are read after that, in file order.

Edge cases: null html is an empty payload; an empty payload is a payload like
any other; a null url has the key '-' and no Target-URI; control characters in
urls are percent-encoded in headers; different urls may share a key, a look-up
gives only those of the url asked for; a null page_id is never preferred; rows
that repeat a page_id with an equal payload are responses alike; very long
payloads are records like any other, one at a time in memory; an empty table
writes no archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.llm._session import filesystem as _filesystem
from trustlake.llm._session import keyed_join, own_folder, partitions, stored
from trustlake.llm._words import parts

LINES = 3000
#: Rows of the directory in one of its files.
DIRECTORY = 1 << 16
ROLL = 1 << 30
DATE = "1970-01-01T00:00:00Z"
STAMP = "19700101000000"
LEVEL = 3
#: Ranges of one file that lie this near to each other are read at once, up to SPAN bytes.
SPAN = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "url string, surt string, page_id long, refers_to long, record_type string, payload_digest string, file string, offset long, length long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def surt(url: str | None) -> str:
    """Reversed-host key: ``https://m.example.org/a?b`` -> ``org,example,m)/a?b``."""
    if not url:
        return "-"
    try:
        p = urlsplit(url.strip())
        host, port = (p.hostname or "").rstrip("."), p.port
    except ValueError:
        return url
    if host.startswith("www."):
        host = host[4:]
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{key}){p.path or '/'}{'?' + p.query if p.query else ''}"


def digest32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record with its closing blank lines, not compressed."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(0x21, 0x7F)))))
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _writer(folder: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        task = TaskContext.get()
        out, name, at, number = None, "", 0, 0
        for whole in batches:
            for batch in parts(whole, "html", 2 << 20):
                rows = []
                for page_id, url, page, sha, best in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    if out is None:
                        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number}.warc.gz"
                        out, at = fs.open_output_stream(f"{root}/{name}", compression=None), 0
                    refers_to = best
                    digest = digest32(sha)
                    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = z.compress(record(page_id, url, (page or "").encode(), digest, refers_to)) + z.flush()
                    out.write(data)
                    rows.append((url, surt(url), page_id, refers_to, "response" if refers_to is None else "revisit", digest, name, at, len(data)))
                    at += len(data)
                    if at >= ROLL:
                        out.close()
                        out, number = None, number + 1
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
                types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])
        if out is not None:
            out.close()

    return run


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives below ``folder``/warc and the manifest to ``folder``/manifest; return the manifest."""
    spark = pages.sparkSession
    fs, root = _filesystem(folder)
    fs.create_dir(f"{root}/warc", recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # Digests meet without the payloads; what comes back is keyed by page.
    narrow = stored(rows.select("page_id", "sha"), "payloads")
    several = stored(narrow.groupBy("sha").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).filter("n > 1"), "repeated")
    revisits = keyed_join(narrow, several, ["sha"]).filter("page_id IS NULL OR page_id <> best").distinct()
    same = rows["page_id"].eqNullSafe(revisits["page_id"]) & (rows["sha"] == revisits["sha"])
    rows = rows.join(revisits, same, "left").select(rows["page_id"], "url", "html", rows["sha"], "best")
    rows.mapInArrow(_writer(f"{folder}/warc"), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _indexer(folder: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        task = TaskContext.get()
        name = f"cdx-{task.partitionId():05d}-{task.taskAttemptId()}.gz"
        out, at, lines, rows = None, 0, [], []

        def block() -> None:
            nonlocal out, at
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = z.compress("".join(f"{key} {STAMP} {rest}\n" for key, rest in lines).encode()) + z.flush()
            out.write(data)
            rows.append((lines[0][0], lines[-1][0], name, at, len(data), len(lines)))
            at += len(data)
            lines.clear()

        for batch in batches:
            for url, key, page_id, refers_to, kind, digest, file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                lines.append((key.replace(" ", "%20").replace("\n", "%0A"), json.dumps({"url": url, "page_id": page_id, "refers_to": refers_to, "type": kind, "digest": digest, "filename": file, "offset": offset, "length": length})))
                if len(lines) == LINES:
                    block()
        if lines:
            block()
        if out is not None:
            out.close()
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 3 + [pa.int64()] * 3, strict=True)], names=["first_key", "last_key", "file", "offset", "length", "lines"])

    return run


def index(manifest: DataFrame, folder: str) -> DataFrame:
    """Write the blocks below ``folder``/cdx and the directory to ``folder``/directory; return the directory."""
    spark = manifest.sparkSession
    fs, root = _filesystem(folder)
    fs.create_dir(f"{root}/cdx", recursive=True)
    key = F.regexp_replace(F.regexp_replace("surt", " ", "%20"), "\n", "%0A")
    # A host with a third of all pages is split by the rest of its key and the page.
    ordered = manifest.withColumn("key", key).repartitionByRange(partitions(spark), "key", "page_id", "offset").sortWithinPartitions("key", "page_id", "offset").drop("key")
    ddl = "first_key string, last_key string, file string, offset long, length long, lines long"
    blocks = stored(ordered.mapInArrow(_indexer(f"{folder}/cdx"), ddl), "blocks")
    # Few files with sorted rows, so that a task opens only what its keys need.
    blocks.repartitionByRange(1 + blocks.count() // DIRECTORY, "first_key", "last_key").sortWithinPartitions("first_key", "last_key").write.parquet(f"{folder}/directory")
    return spark.read.schema(ddl).parquet(f"{folder}/directory")


def _lines(raw: bytes) -> list[tuple[str, str]]:
    return [tuple(x.split(" ", 2)[::2]) for x in zlib.decompress(raw, 31).decode().split("\n") if x]


def _read_blocks(folder: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for batch in batches:
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with fs.open_input_file(f"{root}/{file}") as f:
                    rest = [json.loads(x[1]) for x in _lines(f.read_at(length, offset))]
                yield pa.RecordBatch.from_arrays([pa.array([x["filename"] for x in rest], pa.string()), pa.array([x["offset"] for x in rest], pa.int64()), pa.array([x["length"] for x in rest], pa.int64())], names=["file", "offset", "length"])

    return run


def _read_records(folder: str, keep: int = 0, html: bool = False) -> object:
    """Range reads, near ones of a file together. ``keep``: leading columns that pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        now, f = None, None
        for batch in batches:
            file, offset, length = (batch.column(keep + i).to_pylist() for i in range(3))
            rows, texts = [], []
            a = 0
            while a < len(file):
                z, end = a + 1, offset[a] + length[a]
                while z < len(file) and file[z] == file[a] and offset[z] >= offset[a] and offset[z] + length[z] - offset[a] <= SPAN:
                    end = max(end, offset[z] + length[z])
                    z += 1
                if file[a] != now:
                    if f is not None:
                        f.close()
                    now, f = file[a], fs.open_input_file(f"{root}/{file[a]}")
                data = f.read_at(end - offset[a], offset[a])
                for i in range(a, z):
                    at = offset[i] - offset[a]
                    fields, payload = parse(zlib.decompress(data[at : at + length[i]], 31))
                    kind = fields["WARC-Type"]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != int(fields["Payload-Length"]) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{file[i]} at {offset[i]}: the payload doesn't match its digest")
                    page, to = fields.get("Page-ID"), fields.get("Refers-To-Page-ID")
                    rows.append((int(page) if page is not None else None, int(fields["Payload-Length"]), digest, kind, int(to) if to is not None else None))
                    if html:
                        texts.append(payload.decode() if kind == "response" else None)
                a = z
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()], strict=True)]
            names = [x.split()[0] for x in RESULT.split(", ")]
            arrays, names = [*(batch.column(i) for i in range(keep)), *arrays], [*batch.schema.names[:keep], *names]
            if html:
                arrays, names = [*arrays, pa.array(texts, pa.string())], [*names, "html"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        if f is not None:
            f.close()

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All captures, through directory, blocks and record ranges."""
    n = partitions(spark)
    directory = spark.read.parquet(f"{folder}/directory").select("file", "offset", "length")
    captures = directory.repartition(n).mapInArrow(_read_blocks(f"{folder}/cdx"), "file string, offset long, length long")
    ordered = captures.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_read_records(f"{folder}/warc"), RESULT)


def _key(url: str | None) -> str:
    return surt(url).replace(" ", "%20").replace("\n", "%0A")


def _find_blocks(folder: str) -> object:
    """The index blocks that may hold each url's key, by binary search in the directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        fs, root = _filesystem(folder)
        for batch in batches:
            asked = sorted(((_key(u), u) for u in batch.column(0).to_pylist()), key=lambda x: x[0])
            if not asked:
                continue
            spans = (ds.field("first_key") <= asked[-1][0]) & (ds.field("last_key") >= asked[0][0])
            near = ds.dataset(f"{root}/directory", filesystem=fs, format="parquet", exclude_invalid_files=True).to_table(filter=spans).sort_by([("first_key", "ascending"), ("last_key", "ascending")])
            first, last = near["first_key"].to_pylist(), near["last_key"].to_pylist()
            at, of = [], []
            for n, (key, _) in enumerate(asked):
                k = bisect.bisect_left(last, key)
                while k < len(first) and first[k] <= key:
                    at.append(k)
                    of.append(n)
                    k += 1
            hit = near.take(pa.array(at, pa.int64())).combine_chunks()
            cols = [pa.array([asked[n][1] for n in of], pa.string()), pa.array([asked[n][0] for n in of], pa.string()), *(hit[c].combine_chunks() for c in ("file", "offset", "length"))]
            yield pa.RecordBatch.from_arrays(cols, names=["url", "key", "block_file", "block_offset", "block_length"])

    return run


def _find_lines(folder: str) -> object:
    """The captures of each url in a block, by binary search among its sorted lines. Rows come in order of blocks, so each is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        now, lines, keys = None, [], []
        for batch in batches:
            rows = []
            for url, key, file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (file, offset) != now:
                    with fs.open_input_file(f"{root}/{file}") as f:
                        lines = _lines(f.read_at(length, offset))
                    now, keys = (file, offset), [x[0] for x in lines]
                i = bisect.bisect_left(keys, key)
                while i < len(keys) and keys[i] == key:
                    x = json.loads(lines[i][1])
                    if x["url"] == url:
                        rows.append((url, x["filename"], x["offset"], x["length"]))
                    i += 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 2 + [pa.int64()] * 2, strict=True)], names=["url", "file", "offset", "length"])

    return run


def lookup(urls: DataFrame, folder: str, *, html: bool = True) -> DataFrame:
    """``urls`` (url, ...) -> url, page_id, payload_bytes, payload_digest, record_type, refers_to and, with ``html``, that of responses, for each capture of each distinct url (null: captures without one)."""
    spark = urls.sparkSession
    n = partitions(spark)
    own = urls.select(F.col("url").cast("string").alias("url")).distinct()
    # Near the order of keys: hosts reversed.
    host = F.array_join(F.reverse(F.split(F.regexp_extract("url", "//(?:www[.])?([^/:?#]*)", 1), r"\.")), ",")
    blocks = own.repartitionByRange(n, host, "url").mapInArrow(_find_blocks(folder), "url string, key string, block_file string, block_offset long, block_length long")
    blocks = blocks.repartition(n, "block_file", "block_offset").sortWithinPartitions("block_file", "block_offset")
    found = blocks.mapInArrow(_find_lines(f"{folder}/cdx"), "url string, file string, offset long, length long")
    found = found.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return found.mapInArrow(_read_records(f"{folder}/warc", 1, html), f"url string, {RESULT}" + (", html string" if html else ""))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    folder = own_folder(spark, "archive")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index(write(pages, folder), folder)
    return lookup(pages, folder, html=False).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM p),
d AS (SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(h, CAST(5 * g + 1 AS INTEGER), 5) AS BIGINT)) AS five FROM b)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(five, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (v >> 15) % 32 AS INTEGER), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (v >> 10) % 32 AS INTEGER), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (v >> 5) % 32 AS INTEGER), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + v % 32 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM d
"""

"""Web archives with a two-level capture index.

``write_archives`` writes WARC/1.1 files, one gzip member per record, with Spark's own text writer (a cast from binary
to string keeps the bytes, and the line separator is a zero byte, which gzip readers skip as padding between members).
``write_index`` sorts one line per record by reversed-host URL key into compressed blocks and keeps a sparse directory
of their first keys. ``locate`` finds lines by binary search: over the ranges of the index parts, then over the block
directory of a part, then inside the one block; ``read_ranges`` slices the records out of the archives.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mullion.llm.common import picked, plain
from mullion.runtime import cut

SMALLEST = 1000  # bytes from which an equal payload becomes a revisit
LINE_SCHEMA = "key string, file string, at bigint, length bigint, line string"
BLOCK_SCHEMA = "part int, block int, first_key string, last_key string, lines int, data binary"
RECORD_SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query in lower case; scheme, port and fragment do not count."""
    try:
        parts = urlsplit((url or "").strip())
        host = parts.hostname or ""
    except ValueError:
        return "!)" + (url or "")
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def capture_key(url: str | None, page_id: int | None, digest: str) -> str:
    """URL key and record, so that the captures of one URL are in a fixed order and may lie in several blocks."""
    return f"{url_key(url)} {'' if page_id is None else page_id:0>20} {digest}".replace("\n", "%0A").replace("\t", "%09")


def with_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, refers_to (null: a response).

    Of pages whose payloads have one SHA-1, SHA-256 and size of at least 1000 bytes, that with the largest page_id is the response;
    the others refer to it. Rows that repeat its id as well are responses too. Null html is an empty payload.
    """
    rows = picked(pages, page_id=id_col, url=url_col, html=html_col).select(
        F.col("page_id").cast("bigint"), "url", plain(F.col("html")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha1("payload")).withColumn("check", F.sha2("payload", 256))
    # Counts combine before the shuffle; only repeated payloads are met again, and one of them may be split over tasks.
    again = (rows.filter(F.col("payload_bytes") >= SMALLEST).groupBy("digest", "check", "payload_bytes")
             .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response")).filter("n > 1").drop("n"))
    met = rows.join(again, ["digest", "check", "payload_bytes"], "left")
    return met.withColumn("refers_to", F.when(F.col("page_id") < F.col("response"), F.col("response")).when(F.col("page_id").isNull(), F.col("response"))).drop("check", "response")


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    name = "null" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if refers_to is None else b""
    return ("\r\n".join([*head, f"Content-Length: {len(body)}", "", ""])).encode() + body + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """page_id, url, type, digest, size, refers_to and payload of one WARC record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda v: None if v == "<urn:page:null>" else int(v[10:-1])
    url = fields.get("WARC-Target-URI")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
            "type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"][5:], "size": int(fields["X-Payload-Length"]),
            "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": rest[:int(fields["Content-Length"])]}


def write_archives(typed: DataFrame, path: str, level: int = 5) -> None:
    """One archive per Spark partition of ``typed`` (see ``with_types``) and 20,000 records, a gzip member per record."""
    def members(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(lo, 256).to_pylist():
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.append(packer.compress(_record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])) + packer.flush())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    rows = typed.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(members, "member binary")
    rows.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 20000).text(path)


def _members(data: bytes):
    """(offset, length, record) of each gzip member, zero bytes between them skipped."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        reader, end, out = zlib.decompressobj(31), at, []
        while not reader.eof:
            if end >= len(data):
                raise ValueError("archive ends inside a record")
            out.append(reader.decompress(view[end:end + 65536]))
            end += min(65536, len(data) - end)
        end -= len(reader.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """file, content of every archive."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")


def write_index(spark: SparkSession, archives: str, path: str, block_lines: int = 3000) -> None:
    """Read every archive through and write its capture lines, sorted, as compressed blocks with their first and last keys."""
    def lines(batches):
        for r in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows)):
            rows = {k: [] for k in ("key", "file", "at", "length", "line")}
            for at, length, record in _members(r["content"]):
                x = parse(record)
                rows["key"].append(capture_key(x["url"], x["page_id"], x["digest"]))
                rows["file"].append(r["file"])
                rows["at"].append(at)
                rows["length"].append(length)
                rows["line"].append(json.dumps({"url": x["url"], "digest": x["digest"], "type": x["type"], "file": r["file"], "offset": at, "length": length}))
            yield pa.RecordBatch.from_arrays([pa.array(rows["key"], pa.string()), pa.array(rows["file"], pa.string()), pa.array(rows["at"], pa.int64()),
                                              pa.array(rows["length"], pa.int64()), pa.array(rows["line"], pa.string())], names=list(rows))

    def blocks(batches):
        from pyspark import TaskContext

        part, block, held, keys = TaskContext.get().partitionId(), 0, [], []

        def close():
            nonlocal block, held, keys
            data = zlib.compress("\n".join(f"{k}\t{x}" for k, x in zip(keys, held)).encode(), 6)
            row = [part, block, keys[0], keys[-1], len(keys), data]
            block, held, keys = block + 1, [], []
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["part", "block", "first_key", "last_key", "lines", "data"])

        for batch in batches:
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(key)
                held.append(line)
                if len(keys) == block_lines:
                    yield close()
        if keys:
            yield close()

    found = cut(archive_files(spark, archives).mapInArrow(lines, LINE_SCHEMA))
    (found.repartitionByRange("key", "file", "at").sortWithinPartitions("key", "file", "at").select("key", "line")
     .mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path))


def locate(wanted: DataFrame, index: str) -> DataFrame:
    """Capture lines of the keys in ``wanted(key)``: key, url, digest, type, file, offset, length.

    The driver holds one key range per index part (as many as the index job had output partitions, whatever the
    number of captures). Keys go to the parts whose range may hold them; there a search over the part's directory
    opens only the blocks that may hold the key. Distinct keys only; a key that was not captured gives no row.
    """
    spark = wanted.sparkSession
    blocks = spark.read.parquet(index)
    bounds = sorted((r.lo, r.hi, r.part) for r in blocks.groupBy("part").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).collect())
    lows, highs, parts = [b[0] for b in bounds], [b[1] for b in bounds], [b[2] for b in bounds]

    def route(batches):
        for batch in batches:
            keys, to = [], []
            for key in batch.column(0).to_pylist():
                i = bisect.bisect_left(highs, key)
                while i < len(lows) and lows[i] <= key:
                    keys.append(key)
                    to.append(parts[i])
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(to, pa.int32())], names=["key", "part"])

    fields = ("key", "url", "digest", "type", "file", "offset", "length")
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())

    def search(asked: pa.Table, directory: pa.Table) -> pa.Table:
        order = sorted(directory.select(["block", "first_key", "last_key"]).to_pylist(), key=lambda r: r["block"])
        ends, place = [r["last_key"] for r in order], {b: i for i, b in enumerate(directory.column("block").to_pylist())}
        out: dict[str, list] = {f: [] for f in fields}
        opened, names, rows = -1, [], []
        for key in sorted(asked.column("key").to_pylist()):
            b = bisect.bisect_left(ends, key)
            while b < len(order) and order[b]["first_key"] <= key:
                if b != opened:
                    text = zlib.decompress(directory.column("data")[place[order[b]["block"]]].as_py()).decode()
                    rows = [x.split("\t", 1) for x in text.split("\n")]
                    names, opened = [x[0] for x in rows], b
                for i in range(bisect.bisect_left(names, key), bisect.bisect_right(names, key)):
                    line = json.loads(rows[i][1])
                    out["key"].append(key)
                    for f in fields[1:]:
                        out[f].append(line[f])
                b += 1
        return pa.Table.from_arrays([pa.array(out[f], k) for f, k in zip(fields, kinds)], names=list(fields))

    asked = wanted.select("key").distinct().mapInArrow(route, "key string, part int")
    return asked.groupBy("part").cogroup(blocks.groupBy("part")).applyInArrow(
        search, "key string, url string, digest string, type string, file string, offset bigint, length bigint")


def read_ranges(lines: DataFrame, archives: str) -> DataFrame:
    """The records of capture lines (``locate``), each sliced out of its archive by offset and length and checked against its digest."""
    spark = lines.sparkSession
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")

    def slices(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in names}
        data = held.column("content")[0].as_py() if held.num_rows else b""
        for at, length in sorted(zip(asked.column("offset").to_pylist(), asked.column("length").to_pylist())):
            x = parse(zlib.decompress(data[at:at + length], 31))
            if x["type"] == "response" and (hashlib.sha1(x["payload"]).hexdigest() != x["digest"] or len(x["payload"]) != x["size"]):
                raise ValueError(f"record at {at} does not meet its digest")
            for n, v in zip(names, (x["page_id"], x["url"], x["size"], x["digest"], x["type"], x["refers_to"], x["payload"])):
                out[n].append(v)
        return pa.Table.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds)], names=list(names))

    return (lines.select("file", "offset", "length").groupBy("file").cogroup(archive_files(spark, archives).groupBy("file"))
            .applyInArrow(slices, RECORD_SCHEMA))


def keys_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The capture keys of pages, as the index has them."""
    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, p, d) for p, u, d in zip(*(c.to_pylist() for c in batch.columns))], pa.string())], names=["key"])

    rows = picked(pages, page_id=id_col, url=url_col, html=html_col)
    return rows.select(F.col("page_id").cast("bigint"), "url", F.sha1(plain(F.col("html")).cast("binary")).alias("digest")).mapInArrow(keyed, "key string")

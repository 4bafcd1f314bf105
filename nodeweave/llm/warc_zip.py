"""WARC records in ZIP packages, read by ranges without extraction.

Each writing task streams one package to the shared folder: a stored member of records compressed one by one, and a stored
index of their offsets. Its name holds the attempt, and only packages that a finished task named in the manifest are read,
so a lost executor leaves an orphan file and nothing else. Reading parses the end record, the ZIP64 end record and the
central directory from the file's tail, finds the members' data behind their local headers, and deals the index out in
ranges, each read by one seek.

Defined cases: null html is an empty payload; null ids and urls stay null; rows that repeat both id and payload are all
written as responses; line ends in a url are escaped in the record and restored; other columns are not read, whatever
their names; very long payloads are one record each; an empty table gives no package and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeweave.llm.common import maybe_in, scratch, with_groups, written

LEAST_BYTES, RANGE_BYTES, PARTITION_BYTES = 1000, 4 << 20, 64 << 20
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    text = (urn or "")[len("<urn:page:") : -1]
    return int(text) if text else None


def _escaped(url: str) -> str:
    """Without line ends, which would end the header; `_restored` undoes it. A per cent sign before these digits is escaped too."""
    return re.sub(r"%(?=0A|0D|25)|[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)


def _restored(text: str | None) -> str | None:
    return text if text is None else re.sub(r"%(0A|0D|25(?=0A|0D|25))", lambda m: chr(int(m[1][:2], 16)), text)


def record(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record."""
    body = _HTTP if revisit else _HTTP + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _urn(page_id)}
    if url is not None:
        head["WARC-Target-URI"] = _escaped(url)
    head |= {"WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(len(payload))}
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; revisits have no payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def package(out, rows, zip64: bool = False) -> int:
    """Writes rows (page_id, url, payload, digest, refers_to, revisit) as a ZIP package to a stream; their number."""
    index = io.BytesIO()
    at = n = 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(RECORDS, "w", force_zip64=True) as member, gzip.GzipFile(fileobj=index, mode="wb", compresslevel=1, mtime=0) as lines:
            for row in rows:
                data = gzip.compress(record(*row), 1, mtime=0)
                member.write(data)
                lines.write(json.dumps({"offset": at, "length": len(data)}).encode() + b"\n")
                at, n = at + len(data), n + 1
        with z.open(INDEX + ".gz", "w", force_zip64=zip64) as member:
            member.write(index.getvalue())
    return n


def directory(f, size: int) -> dict[str, tuple[int, int, int]]:
    """{member: (offset of its local header, length, method)} from the central directory, ZIP64 or not."""
    tail = min(size, 22 + 65535 + 20)
    f.seek(size - tail)
    end = f.read(tail)
    at = end.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", end, at + 10)
    if at >= 20 and end[at - 20 : at - 16] == b"PK\x06\x07":
        f.seek(struct.unpack_from("<Q", end, at - 20 + 8)[0])
        count, length, start = struct.unpack_from("<QQQ", f.read(56), 32)
    f.seek(start)
    central, at, found = f.read(length), 0, {}
    for _ in range(count):
        if central[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed_size, full_size, names, extras, notes, offset = (
            *struct.unpack_from("<H", central, at + 10), *struct.unpack_from("<II", central, at + 20),
            *struct.unpack_from("<HHH", central, at + 28), *struct.unpack_from("<I", central, at + 42),
        )
        name = central[at + 46 : at + 46 + names].decode()
        extra, k = central[at + 46 + names : at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # ZIP64: only the fields that are full in the entry, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full_size = next(wide) if full_size == 0xFFFFFFFF else full_size
                packed_size = next(wide) if packed_size == 0xFFFFFFFF else packed_size
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            k += 4 + n
        found[name] = (offset, packed_size, method)
        at += 46 + names + extras + notes
    return found


def member_at(f, entry: tuple[int, int, int]) -> tuple[int, int]:
    """(start, length) of a stored member's data; the local header's own name and extra fields come before it."""
    offset, length, method = entry
    if method != zipfile.ZIP_STORED:
        raise ValueError("member is not stored")
    f.seek(offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    names, extras = struct.unpack_from("<HH", head, 26)
    return offset + 30 + names + extras, length


def ranges(f, size: int, most: int = RANGE_BYTES) -> Iterator[tuple[int, list[int]]]:
    """(start, lengths of the records there) in order, about `most` bytes each."""
    members = directory(f, size)
    first, _ = member_at(f, members[RECORDS])
    at, length = member_at(f, members[INDEX + ".gz"])
    f.seek(at)
    start, lengths, total = None, [], 0
    for line in gzip.GzipFile(fileobj=io.BytesIO(f.read(length))):
        x = json.loads(line)
        if start is None:
            start = first + x["offset"]
        lengths.append(x["length"])
        total += x["length"]
        if total >= most:
            yield start, lengths
            start, lengths, total = None, [], 0
    if lengths:
        yield start, lengths


def _open(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store, path


def judged(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id, url, html) with digest, refers_to and revisit. Payloads that surely come once pass beside the join."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    key = F.when(F.length(html) >= least, F.sha2(html, 256))
    light = pages.select("page_id", key.alias("k")).where(F.col("k").isNotNull())
    groups = written(light.groupBy("k").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "payloads")
    rows = maybe_in(pages.select("page_id", "url", html.alias("payload"), F.sha1(html).alias("digest"), key.alias("k")), groups, "k")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = with_groups(rows.where("_maybe").drop("_maybe"), groups, "k", "n", total)
    alone = rows.where("NOT _maybe").drop("_maybe").withColumns({"first": F.lit(None).cast("long"), "n": F.lit(None).cast("long")})
    out = alone.unionByName(met).withColumn("revisit", F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    return out.select("page_id", "url", "payload", "digest", F.when(F.col("revisit"), F.col("first")).alias("refers_to"), "revisit")


def packages(rows: DataFrame) -> DataFrame:
    """Writes judged rows as packages; the manifest (uri, size) of those that finished tasks wrote."""
    folder = scratch(rows.sparkSession, "warc")

    def run(batches):
        import pyarrow as pa

        def each():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit")))

        rest = each()
        head = next(rest, None)
        if head is None:
            return
        uri = f"{folder}/part-{uuid.uuid4().hex}.zip"
        store, path = _open(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)

        def all_rows():
            yield head
            yield from rest

        with store.open_output_stream(path) as out:
            package(out, all_rows())
        yield pa.RecordBatch.from_pydict({"uri": pa.array([uri]), "size": pa.array([store.get_file_info(path).size], pa.int64())})

    return written(rows.mapInArrow(run, "uri string, size long"), "manifest")


def records(manifest: DataFrame) -> DataFrame:
    """A row a record of the packages: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""

    def list_(batches):
        import pyarrow as pa

        for b in batches:
            for uri, size in zip(b.column("uri").to_pylist(), b.column("size").to_pylist()):
                store, path = _open(uri)
                with store.open_input_file(path) as f:
                    got = list(ranges(f, size))
                yield pa.RecordBatch.from_pydict({"uri": pa.array([uri] * len(got), pa.string()), "start": pa.array([s for s, _ in got], pa.int64()), "lengths": pa.array([n for _, n in got], pa.list_(pa.int64()))})

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for uri, start, lengths in zip(*(b.column(c).to_pylist() for c in ("uri", "start", "lengths"))):
                store, path = _open(uri)
                with store.open_input_file(path) as f:
                    f.seek(start)
                    data = f.read(sum(lengths))
                rows, at = [], 0
                for n in lengths:
                    head, payload = parse(gzip.decompress(data[at : at + n]))
                    at += n
                    said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = head["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).hexdigest() != said:
                        raise ValueError(f"digest of {head['WARC-Record-ID']} differs")
                    bytes_ = int(head["X-Payload-Length"]) if revisit else len(payload)
                    rows.append((_page(head["WARC-Record-ID"]), bytes_, said, head["WARC-Type"], _page(head.get("WARC-Refers-To")), _restored(head.get("WARC-Target-URI")), None if revisit else payload))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    # a task about PARTITION_BYTES, at least one a core; a given number, as AQE would fold these small rows into one task
    total = manifest.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, -(-total // PARTITION_BYTES))
    spread = manifest.mapInArrow(list_, "uri string, start long, lengths array<long>").repartition(int(tasks), "uri", "start")
    return spread.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def op5(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return records(packages(judged(pages))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to FROM q"""

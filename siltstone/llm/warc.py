"""WARC archives: written with an index, read back by coalesced byte ranges.

Writing makes one .warc.gz of concatenated members per task and returns, for every record, its file,
offset, length, URL and digest. That index is stored first and is the only way to the records: a file
left behind by a task that was lost is in no index. Reading takes the selected index rows, sorts them
by file and offset, joins neighbouring byte ranges into one read, and parses the records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import is_small, matching, new_folder, stage, staged_texts, tasks_for

#: Bytes between two wanted ranges that are cheaper to read than to skip, and the most one read takes.
GAP, READ = 64 << 10, 8 << 20

#: Fixed values of the WARC format.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
END = b"\r\n\r\n"

INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode().rstrip("=")


def _headers(first: str, fields: list[tuple[str, str]]) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in fields)]).encode() + END


def _one_line(value: str) -> str:
    return " ".join(value.split())


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, str]:
    """The bytes of a response, or of a revisit if it refers to another record, and its digest. The
    HTTP headers of a revisit state the length of the payload that it leaves out."""
    digest = digest_of(payload)
    block = _headers("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        block += payload
    else:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return _headers("WARC/1.0", [*fields, ("Content-Length", str(len(block)))]) + block + END, digest


def parse(raw: bytes) -> tuple:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes and payload of a record."""
    head, _, rest = raw.partition(END)
    field = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(END)
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda urn: int(urn[10:-1]) if len(urn) > 11 else None
    kind = field["WARC-Type"]
    return number(field["WARC-Record-ID"]), field["WARC-Target-URI"], kind, number(field.get("WARC-Refers-To", "")), field["WARC-Payload-Digest"][5:], length, payload if kind == "response" else None


def revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", body_col: str = "html") -> DataFrame:
    """id, sha1 and refers_to of the pages that revisit another one: of equal payloads of at least
    `least_bytes` that with the largest id is the response."""
    body = F.coalesce(pages[body_col], F.lit(""))
    seen = stage(pages.select(pages[id_col].alias("id"), F.sha1(body.cast("binary")).alias("sha1"), F.octet_length(body).alias("bytes")), "warc-seen").where(F.col("bytes") >= least_bytes)
    first = stage(seen.groupBy("sha1").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").select("sha1", "refers_to"), "warc-first")
    each = seen.select("id", "sha1").distinct()  # before the join: a grouping after it would keep a hot payload in one task
    return stage(each.join(first, "sha1").where(~F.col("id").eqNullSafe(F.col("refers_to"))).select("id", "sha1", "refers_to"), "warc-revisits")


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", level: int = 1) -> DataFrame:
    """Write a record per page below path (any folder that all executors reach); return the stored index.

    A null body is empty, a null URL an empty one; line breaks in a URL become spaces. Repeated rows
    are written each; all that share the largest id of their payload are responses. A null id counts
    as the smallest; a group with null ids only holds responses. Pages of any length are one record each; no pages
    give no archive and an empty index. Other columns may have any name.
    """
    root = path.rstrip("/")
    body = F.coalesce(pages[body_col], F.lit(""))
    again = revisits(pages, least_bytes, id_col, body_col)
    rows = pages.select(pages[id_col].cast("long").alias("id"), F.coalesce(pages[url_col], F.lit("")).alias("url"), body.cast("binary").alias("body"), F.sha1(body.cast("binary")).alias("sha1"))
    other = again.select(F.col("id").alias("other"), F.col("sha1").alias("same"), "refers_to")
    same = (F.col("sha1") == F.col("same")) & F.col("id").eqNullSafe(F.col("other"))
    columns = ["id", "url", "body", "refers_to"]
    if is_small(again):
        rows = rows.join(F.broadcast(other), same, "left").select(*columns)
    else:  # pages that revisit nothing stay where they are
        on = {"id": rows["id"], "sha1": rows["sha1"]}
        first = matching(rows, on, again, "left_anti").select("id", "url", "body", F.lit(None).cast("long").alias("refers_to"))
        rows = first.unionByName(matching(rows, on, again, "left_semi").join(other, same).select(*columns))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        file = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        store.create_dir(folder, recursive=True)
        at, out = 0, None
        for batch in batches:
            index = []
            for page_id, url, payload, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw, digest = record(page_id, url, payload, refers_to, date)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                packed = packer.compress(raw) + packer.flush()
                if out is None:
                    out = store.open_output_stream(file, compression=None, buffer_size=1 << 20)
                out.write(packed)
                index.append((page_id, url, digest, "response" if refers_to is None else "revisit", file.rsplit("/", 1)[1], at, len(packed)))
                at += len(packed)
            names = [f.split(" ")[0] for f in INDEX.split(", ")]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in index], schema=_arrow(INDEX))
        if out is not None:
            out.close()

    return staged_texts(rows.mapInArrow(write, INDEX), "warc-index")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split(" ") for f in ddl.split(", "))])


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, int, int]]:
    """Sorted (offset, length) ranges as reads (from, to, first range, last range)."""
    reads: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(ranges):
        if reads and offset - reads[-1][1] <= gap and max(reads[-1][1], offset + length) - reads[-1][0] <= most:
            reads[-1] = (reads[-1][0], max(reads[-1][1], offset + length), reads[-1][2], i)
        else:
            reads.append((offset, offset + length, i, i))
    return reads


def read_warc(index: DataFrame, path: str, payloads: bool = True, block: int = 64 << 20) -> DataFrame:
    """The records of the index rows given, a row each; `payload` is null for revisits, and for all
    records unless `payloads`. Rows are grouped by file and blocks of it, so that one large archive
    is read by several tasks. An index row that is given twice is read twice; an empty index gives no rows."""
    root = path.rstrip("/")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        schema = _arrow(RECORD)
        for batch in batches:
            wanted = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            starts = [i for i, w in enumerate(wanted) if not i or w[0] != wanted[i - 1][0]]
            for a, b in zip(starts, [*starts[1:], len(wanted)], strict=True):
                with store.open_input_file(f"{folder}/{wanted[a][0]}") as f:
                    for begin, end, first, last in coalesced([w[1:] for w in wanted[a:b]]):
                        raw = f.read_at(end - begin, begin)
                        found = [parse(zlib.decompress(raw[o - begin : o - begin + n], 31)) for _, o, n in wanted[a + first : a + last + 1]]
                        if not payloads:
                            found = [(*r[:-1], None) for r in found]
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

    n = tasks_for(index.sparkSession, index.agg(F.sum("length")).first()[0] or 0)
    placed = index.select("file", "offset", "length").repartition(n, "file", F.floor(F.col("offset") / block)).sortWithinPartitions("file", "offset")
    return placed.mapInArrow(read, RECORD)


def archived(pages: DataFrame, **how) -> DataFrame:
    """Write the pages as WARC into the shared folder and read every record back; odd rows as in write_warc()."""
    path = new_folder(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, path, **how), path)

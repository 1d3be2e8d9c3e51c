"""WARC archives as seekable Zstandard bundles (operator 13).

A bundle is a row of independent Zstandard frames, each with whole records of about `frame_bytes` together, and at its end a
seek table in the public seekable format: a skippable frame with the compressed and full size of each frame, their
number, a descriptor and a magic number. Any reader of Zstandard unpacks a bundle from front to back; one that knows the
table goes to any frame. The index maps a record's identifier to its bundle, its frame and the place within the unpacked frame.

Pages are first stored with a row number, a digest and a size. Which of them revisit another is decided on those small
columns alone; the decisions then go to the files that hold the pages, so no payload is ever shuffled. A task writes the
bundles of one file of pages, a record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlore.llm.document_store import Store, file_of, numbers
from orderlore.llm.tables import filesystem, stored
from orderlore.session import fresh_path

FRAME_BYTES, BUNDLE_BYTES, LEVEL, LEAST_BYTES, WHEN = 1 << 20, 1 << 30, 3, 0, "1970-01-01T00:00:00Z"
# fixed values of the seekable format and of WARC 1.1
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "record_id string, bundle string, frame int, at bigint, size bigint"
_RECORD = "record_id string, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to_id string, payload binary"
_SCHEMA = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary())])


class BundleWriter:
    """Writes records into frames and bundles of a folder; `entries` collects their places."""

    def __init__(self, files: pafs.FileSystem, place: str, frame_bytes: int, bundle_bytes: int, level: int):
        self.files, self.place, self.frame_bytes, self.bundle_bytes = files, place, frame_bytes, bundle_bytes
        self.packer, self.out, self.entries = zstandard.ZstdCompressor(level=level), None, []

    def add(self, record_id: str, record: list[bytes]) -> None:
        if self.out is None:
            self.name, self.sizes, self.written, self.frame, self.filled = f"{uuid.uuid4().hex}.warc.zst", [], 0, [], 0
            self.out = self.files.open_output_stream(f"{self.place}/{self.name}", compression=None)  # not by its ending
        size = sum(map(len, record))
        if self.filled and self.filled + size > self.frame_bytes:
            self._end_frame()
        self.entries.append((record_id, self.name, len(self.sizes), self.filled, size))
        self.frame += record
        self.filled += size
        if self.filled >= self.frame_bytes:
            self._end_frame()
        if self.written >= self.bundle_bytes:
            self.close()

    def _end_frame(self) -> None:
        packed = self.packer.compress(b"".join(self.frame))
        self.out.write(packed)
        self.sizes.append((len(packed), self.filled))
        self.written, self.frame, self.filled = self.written + len(packed), [], 0

    def close(self) -> None:
        """Ends the bundle with its seek table."""
        if self.out is not None:
            if self.filled:
                self._end_frame()
            table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
            self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
            self.out.close()
            self.out = None

    def taken(self) -> list[tuple]:
        entries, self.entries = self.entries, []
        return entries


def seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """Start, compressed size and full size of each frame of a bundle."""
    size = file.size()
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != _SEEKABLE:
        raise ValueError("not a seekable bundle")
    file.seek(size - 9 - 8 * count)
    found, start = [], 0
    for packed, full in struct.iter_unpack("<II", file.read(8 * count)):
        found.append((start, packed, full))
        start += packed
    return found


def _safe(url: str) -> str:
    """A header is one line: characters that would end it are written as escapes."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(record_id: str, page_id: int | None, url: str | None, digest: str, payload: bytes, revisited: dict | None, when: str) -> list[bytes]:
    head = {"WARC-Type": "revisit" if revisited else "response", "WARC-Record-ID": record_id, "WARC-Date": when}
    if url is not None:
        head["WARC-Target-URI"] = _safe(url)
    if page_id is not None:
        head["WARC-Page-ID"] = str(page_id)
    head["WARC-Payload-Digest"] = f"sha1:{digest}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisited:
        head |= {"WARC-Profile": _REVISIT, "WARC-Refers-To": revisited["id"]}
        if revisited["url"] is not None:
            head["WARC-Refers-To-Target-URI"] = _safe(revisited["url"])
    body = [http] if revisited else [http, payload]
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(sum(map(len, body)))}
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return [lines.encode(), *body, b"\r\n\r\n"]


def _headers(data: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in data.decode().split("\r\n")[1:] if ": " in line)


def parse(data: bytes, at: int, payloads: bool) -> tuple[tuple, int]:
    """The record at a place of an unpacked frame (columns of _RECORD), and where the next one starts.

    Size and digest are those of the payload read; a response whose payload doesn't agree with its header raises ValueError.
    """
    body = data.index(b"\r\n\r\n", at) + 4
    head = _headers(data[at:body])
    end = body + int(head["Content-Length"])
    digest, page = head["WARC-Payload-Digest"].removeprefix("sha1:"), head.get("WARC-Page-ID")
    size = payload = None
    if head["WARC-Type"] == "response":
        payload = data[data.index(b"\r\n\r\n", body) + 4 : end]
        size = len(payload)
        if _digest(payload) != digest:
            raise ValueError(f"{head['WARC-Record-ID']}: the payload doesn't match its digest")
    row = (head["WARC-Record-ID"], None if page is None else int(page), head.get("WARC-Target-URI"), head["WARC-Type"], size, digest, head.get("WARC-Refers-To"), payload if payloads else None)
    return row, end + 4


def _store(pages: DataFrame) -> Store:
    """Pages with row numbers, and the digest and size of their payload."""
    path = fresh_path(pages.sparkSession, "pages")
    payload = F.coalesce("html", F.lit(""))
    columns = [F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("html")]
    columns += [F.unhex(F.sha2(payload, 256)).alias("digest"), F.octet_length(payload).cast("bigint").alias("bytes")]
    pages.select(columns).write.option("maxRecordsPerFile", 0).option("compression", "zstd").parquet(path)
    files, place = filesystem(path)
    sample = next(f.base_name for f in files.get_file_info(pafs.FileSelector(place)) if f.base_name.startswith("part-"))
    return Store(path, "part-{:05d}" + sample[10:])


def _revisits(rows: DataFrame, least_bytes: int) -> DataFrame:
    """rid and first (page_id, url and rid of the response) of every page that revisits another."""
    small = rows.where(F.col("bytes") >= least_bytes).select("rid", "page_id", "url", "digest")
    order = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", F.col("url").isNull().alias("unlinked"), "url", "rid")
    groups = small.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # written, so that both sides of the join are plain exchanges and a digest with very many pages can be split
    groups = stored(groups, "warc-groups")
    return small.select("rid", "digest").join(groups, "digest").where(F.col("rid") != F.col("first.rid")).select("rid", "first")


def _write(source: Store, folder: str, frame_bytes: int, bundle_bytes: int, level: int, when: str):
    run = uuid.uuid5(uuid.NAMESPACE_URL, folder)

    def name(rid: int) -> str:
        return f"<urn:uuid:{uuid.uuid5(run, str(rid))}>"

    def one_file(number: int, revisits: Iterator[dict], writer: BundleWriter) -> Iterator[list[tuple]]:
        due = next(revisits, None)
        for batch in source.batches(number, ["rid", "page_id", "url", "html"], 64):
            for rid, page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("rid", "page_id", "url", "html"))):
                payload, revisited = html.encode(), None
                if due is not None and due["rid"] == rid:
                    revisited = {"id": name(due["first"]["rid"]), "url": due["first"]["url"]}
                    due = next(revisits, None)
                writer.add(name(rid), _record(name(rid), page_id, url, _digest(payload), payload, revisited, when))
            yield writer.taken()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = filesystem(folder)
        waiting = (row for batch in batches for row in batch.to_pylist())
        row = next(waiting, None)
        while row is not None:  # the file's own row comes first, then its revisits by row number
            number, following = row["file"], []

            def own(number=number, following=following):
                for r in waiting:
                    if r["file"] != number:
                        following.append(r)
                        return
                    yield r

            revisits, writer = own(), BundleWriter(files, place, frame_bytes, bundle_bytes, level)
            for entries in one_file(number, revisits, writer):
                yield _entries(entries)
            writer.close()
            for _ in revisits:
                raise ValueError("a revisit names a row that its file doesn't hold")
            row = following[0] if following else None

    return rows


def _entries(entries: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    columns = list(zip(*entries)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["record_id", "bundle", "frame", "at", "size"])


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, when: str = WHEN) -> tuple[DataFrame, str]:
    """Write a record for each page (page_id, url, html) into bundles; the index and the folder.

    The index has record_id, bundle, frame, at and size. It is the only list of valid bundles: one left behind by a lost or
    repeated task is in no row of it. Of pages with equal payloads of at least `least_bytes` bytes the one with the smallest
    page_id (null last; equal ids by url, then by row) is a response and the others revisit it; smaller ones are all
    responses. Null html is the empty payload; a null url or page_id leaves out its header; `when` is the date
    of all records. Repeated rows each get their record. An empty table writes nothing. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    files, place = filesystem(folder)
    files.create_dir(place, recursive=True)
    source = _store(pages)
    rows = source.rows(spark)
    first = "struct<unnamed:boolean,page_id:bigint,unlinked:boolean,url:string,rid:bigint>"
    each = spark.createDataFrame([(n,) for n in sorted(numbers(source))], "file bigint").selectExpr("file", "cast(null as bigint) rid", f"cast(null as {first}) first")
    due = _revisits(rows, least_bytes).select(file_of(F.col("rid")).alias("file"), "rid", "first")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = each.union(due).repartition(parts, "file").sortWithinPartitions("file", F.col("rid").asc_nulls_first())
    return stored(dealt.mapInArrow(_write(source, folder, frame_bytes, bundle_bytes, level, when), _INDEX), "warc-index"), folder


def _list_frames(folder: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = filesystem(folder)
        for batch in batches:
            for bundle in batch.column("bundle").to_pylist():
                with files.open_input_file(f"{place}/{bundle}") as file:
                    found = seek_table(file)
                out = {"bundle": [bundle] * len(found), "frame": range(len(found)), "start": [f[0] for f in found], "packed": [f[1] for f in found]}
                yield pa.RecordBatch.from_pydict(out, pa.schema([("bundle", pa.string()), ("frame", pa.int32()), ("start", pa.int64()), ("packed", pa.int64())]))

    return rows


def frames(index: DataFrame, folder: str) -> DataFrame:
    """bundle, frame, start and packed size of all frames, from the seek tables of the bundles that the index names."""
    bundles = index.select("bundle").distinct()
    return stored(bundles.mapInArrow(_list_frames(folder), "bundle string, frame int, start bigint, packed bigint"), "warc-frames")


def _read(folder: str, payloads: bool):
    """Records of frames; where `places` is there, only the records at those places."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = filesystem(folder)
        name, file, unpack = None, None, zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    if file is not None:
                        file.close()
                    name, file = row["bundle"], files.open_input_file(f"{place}/{row['bundle']}")
                file.seek(row["start"])
                data = unpack.decompress(file.read(row["packed"]))
                out, at, places = [], 0, row.get("places")
                for at in places or ():
                    out.append(parse(data, at, payloads)[0])
                while places is None and at < len(data):
                    record, at = parse(data, at, payloads)
                    out.append(record)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)
        if file is not None:
            file.close()

    return rows


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records of an archive: record_id, page_id, url, record_type, payload_bytes, payload_digest, refers_to_id, payload.

    Frames are dealt out one by one, so a large bundle is read by many tasks. Payload and size of a revisit are null;
    `resolve` takes them from the record it refers to. Without `payloads` that column is null.
    """
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = frames(index, folder).repartition(parts, "bundle", "frame").sortWithinPartitions("bundle", "frame")
    return dealt.mapInArrow(_read(folder, payloads), _RECORD)


def read_records(index: DataFrame, folder: str, wanted: DataFrame, payloads: bool = True) -> DataFrame:
    """The records named by `wanted` (record_id), from the frames that hold them and no others.

    Repeated names give one record; names that the index lacks give none.
    """
    places = index.join(wanted.select("record_id").distinct(), "record_id").groupBy("bundle", "frame").agg(F.array_sort(F.collect_list("at")).alias("places"))
    dealt = frames(index, folder).join(places, ["bundle", "frame"]).select("bundle", "frame", "start", "packed", "places")
    return dealt.mapInArrow(_read(folder, payloads), _RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, a revisit's size and page coming from its response."""
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"))
    size = F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes")
    revisits = records.where("record_type = 'revisit'").join(responses, "refers_to_id")
    own = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to"))
    return own.union(revisits.select("page_id", size, "payload_digest", "record_type", "refers_to"))


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """`resolve` over a stored copy of the records' small columns."""
    return resolve(stored(read_archives(index, folder, payloads=False).drop("payload"), "warc-records"))

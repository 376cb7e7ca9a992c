"""WARC archives as a PySpark Python data source, for reading and writing.

Reading: archives (.warc.gz and .warc) of a folder and those below it, or a single one; one partition for each group of files
of up to `partition_bytes`. A compressed file is one stream of gzip members, one for each record. Each member tells its
compressed size in its extra field (the `sl` field of the WARC standard's annex), so that a reader which has inflated only
the headers can pass over the rest; in a plain file the record's length does. Predicates on record_type and on the other
header columns are pushed down and decide before a payload is inflated; without the payload column (option
payload=false) none is. Members without that field, or with several records, are inflated in full. Header names are
taken in any case, values with or without white space around them, in UTF-8 or Latin-1.

Writing: each task writes files of up to `file_bytes` under names that no other write has, hidden until the write is
committed; appending leaves the archives that are there, overwriting replaces them. A task that is run again writes other
hidden files, and only those of one attempt are published, so that lost executors do no harm. Files are reached by
pyarrow.fs, so that any store that it knows will do.

Duplicates: of records with equal payloads the one with the least id is the response, the others revisit it.

Edge cases: null payloads are empty ones; null URLs have no Target-URI; line ends in a URL are percent-encoded; with
`min_bytes` over 0 shorter payloads are all responses; rows with a null id are responses and get no record id;
repeated rows of one id are the response again; a very long payload is written and read whole, alone; other columns,
whatever their names, are ignored; an empty table gives an archive without records.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from framewright.llm._common import materialise, sieve
from framewright.shared import fresh_path

SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_bytes bigint, payload binary"
#: Fixed header names of the format; the length of a payload that a revisit leaves out is a header of our own.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_bytes": "X-Payload-Length"}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIRST = 4096


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _archives(fs: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    """Archives in a folder and the folders below it, or the one at the path; hidden names, and what is in hidden folders, are left out."""
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [info]
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    shown = lambda i: not any(p[0] in "._" for p in i.path[len(path.rstrip("/")) + 1 :].split("/"))
    return sorted((i for i in found if i.is_file and i.base_name.endswith((".warc.gz", ".warc")) and shown(i)), key=lambda i: i.path)


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field holds its own size and the record's."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    total = 12 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """A WARC record of the columns in SCHEMA."""
    payload = row["payload"] or b""
    if row["record_type"] == "revisit":
        payload = b""
    fields = {name: row[c] for c, name in HEADERS.items() if row.get(c) is not None}
    if "WARC-Target-URI" in fields:
        fields["WARC-Target-URI"] = fields["WARC-Target-URI"].replace("\r", "%0D").replace("\n", "%0A")
    if row["record_type"] == "revisit":
        fields["WARC-Profile"] = _REVISIT
    fields |= {"Content-Type": "text/html", "Content-Length": len(payload)}
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in fields.items()), b"\r\n", payload, b"\r\n\r\n"])


def parse_headers(head: bytes) -> dict[str, str]:
    """Fields of a record's head by lower-case name: in UTF-8 or, where it isn't that, Latin-1; white space around values goes, lines that
    begin with it carry the one before on."""
    try:
        text = head.decode()
    except UnicodeDecodeError:
        text = head.decode("latin-1")
    fields, name = {}, ""
    for line in text.split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def _length(fields: dict[str, str]) -> int:
    try:
        return int(fields["content-length"])
    except (KeyError, ValueError):
        raise ValueError(f"a record without a length: {fields}") from None


def plain_records(stream, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """records() of an archive that isn't compressed: what isn't wanted is passed over without being read."""
    data, size = b"", stream.size()
    while True:
        data = data.lstrip(b"\r\n")
        while (end := data.find(b"\r\n\r\n")) < 0:
            more = stream.read(1 << 16)
            if not more:
                if data.strip():
                    raise ValueError("a record ends within its headers")
                return
            data = (data + more).lstrip(b"\r\n")
        fields, body = parse_headers(data[:end]), data[end + 4 :]
        n, ok = _length(fields), wanted(fields)
        data, missing = body[n:], n - len(body)
        if missing > 0:
            if stream.tell() + missing > size:
                raise ValueError("a record is cut off")
            if ok and payloads:
                body += stream.read(missing)
            else:
                stream.seek(missing, 1)
        if ok:
            yield fields, body[:n] if payloads else None


def records(stream, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers, and the payload if it is asked for, of the records whose headers `wanted` takes."""
    data = b""
    while True:
        if len(data) < _FIRST:
            data += stream.read(1 << 16)
        if not data:
            return
        size = struct.unpack("<I", data[16:20])[0] if len(data) >= 24 and data[3] & 4 and data[12:14] == b"sl" else 0
        extra = data[16:24]
        inflate = zlib.decompressobj(31)
        text, rest = inflate.decompress(data, _FIRST), inflate.unconsumed_tail
        past = len(data)  # bytes of this member taken from the stream so far, the next one's among them
        while b"\r\n\r\n" not in text and not inflate.eof:
            if not rest:
                rest = stream.read(1 << 16)
                past += len(rest)
                data = b""
                if not rest:
                    raise ValueError("a record ends within its headers")
            text += inflate.decompress(rest, _FIRST)
            rest = inflate.unconsumed_tail
        head, _, body = text.partition(b"\r\n\r\n")
        fields = parse_headers(head)
        ok = wanted(fields)
        alone = size and struct.unpack("<I", extra[4:])[0] == len(head) + 8 + _length(fields)
        if alone and not (ok and payloads):  # on to the next member without inflating this one
            if data and size <= len(data):
                data = data[size:]
            else:
                stream.seek(stream.tell() + size - past)
                data = b""
            if ok:
                yield fields, None
            continue
        parts = [body]
        while not inflate.eof:
            if not rest:
                rest = stream.read(1 << 18)
                if not rest:
                    raise ValueError("a record is cut off")
            parts.append(inflate.decompress(rest))
            rest = b""
        data, body = inflate.unused_data, b"".join(parts)
        while True:  # a member may hold several records
            end = _length(fields)
            if len(body) < end:
                raise ValueError("a record is cut off")
            if ok:
                yield fields, body[:end] if payloads else None
            head, there, body = body[end:].lstrip(b"\r\n").partition(b"\r\n\r\n")
            if not there:
                break
            fields = parse_headers(head)
            ok = wanted(fields)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.columns = options["path"], [f.name for f in schema.fields]
        self.payloads = options.get("payload", "true").lower() == "true" and "payload" in self.columns
        self.per = int(options.get("partition_bytes", 16 << 20))
        self.wanted: list[tuple[str, frozenset]] = []
        if "record_type" in options:
            self.wanted.append((HEADERS["record_type"].lower(), frozenset([options["record_type"]])))

    def pushFilters(self, filters):
        """Equality and membership on header columns of text; what remains goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in HEADERS and column != "payload_bytes":
                self.wanted.append((HEADERS[column].lower(), frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f

    def partitions(self):
        fs, path = _store(self.path)
        infos = _archives(fs, path)
        if not infos and fs.get_file_info(path).type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        groups, size = [], 0
        for i in infos:
            if not groups or size + i.size > self.per:
                groups.append([])
                size = 0
            groups[-1].append(i.path)
            size += i.size
        return [_Files(g) for g in groups] or [_Files([])]

    def read(self, partition):
        fs, _ = _store(self.path)
        wanted = self.wanted
        takes = lambda fields: all(fields.get(k) in v for k, v in wanted)
        rows, held = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as stream:
                packed = stream.read(2) == b"\x1f\x8b"
                stream.seek(0)
                for fields, payload in (records if packed else plain_records)(stream, takes, self.payloads):
                    row = {c: fields.get(name.lower()) for c, name in HEADERS.items()}
                    row["payload_bytes"] = int(row["payload_bytes"] or _length(fields))
                    rows.append(row | {"payload": payload})
                    held += len(payload or b"")
                    if held > 4 << 20 or len(rows) >= 5000:
                        yield self._batch(rows)
                        rows, held = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in self.columns], names=self.columns)


@dataclass
class _Written(WriterCommitMessage):
    """Files of a task: hidden names that become visible when the write is committed."""

    hidden: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Files are named by the write, the task and a number. They are hidden until all tasks are done: commit() publishes those
    of the attempts that count, for an overwrite in place of all archives that were there, and deletes what other
    attempts of this write left; abort() deletes all of them that are there by then. What a task writes that is killed later
    stays hidden and is never read."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.level, self.overwrite = options["path"], int(options.get("level", 1)), overwrite
        self.most, self.run = int(options.get("file_bytes", 256 << 20)), uuid.uuid4().hex

    def write(self, batches):
        from pyspark import TaskContext

        fs, path = _store(self.path)
        fs.create_dir(path, recursive=True)
        attempt, hidden = uuid.uuid4().hex, []
        rows = (row for batch in batches for i in range(0, batch.num_rows, 64) for row in batch.slice(i, 64).to_pylist())
        row = next(rows, None)
        while row is not None or not hidden:
            hidden.append(f".{self.run}-{attempt}-part-{TaskContext.get().partitionId():05d}-{len(hidden):03d}-{self.run}.warc.gz")
            with fs.open_output_stream(f"{path}/{hidden[-1]}", compression=None) as out:
                while row is not None and out.tell() < self.most:
                    out.write(member(record(row), self.level))
                    row = next(rows, None)
        return _Written(hidden)

    def _own(self, fs, path: str) -> list[str]:
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return [i.path for i in found if i.base_name.startswith(f".{self.run}-")]

    def commit(self, messages):
        fs, path = _store(self.path)
        fs.create_dir(path, recursive=True)
        for i in _archives(fs, path) if self.overwrite else []:
            fs.delete_file(i.path)
        for m in messages:
            for name in m.hidden if m is not None else []:
                fs.move(f"{path}/{name}", f"{path}/{name.split('-', 2)[2]}")
        for left in self._own(fs, path):
            fs.delete_file(left)

    def abort(self, messages):
        fs, path = _store(self.path)
        for left in self._own(fs, path):
            fs.delete_file(left)


class WarcSource(DataSource):
    """spark.read.format("warc").load(path) and df.write.format("warc").mode("append" or "overwrite").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def base32_sha1(payload: Column) -> Column:
    """The payload's SHA-1 in upper-case base32, from four times 40 bits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def as_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Rows of SCHEMA for pages: responses and revisits."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("target_uri"), F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    # Which ids revisit which is found without payloads. Those ids, and not digests, then meet the payloads: ids are nearly all
    # different, while a page that is everywhere has one digest. Rows that can't be revisits aren't shuffled.
    key = ["payload_digest", "payload_bytes"]
    told = materialise(rows.filter(F.col("id").isNotNull() & (F.col("payload_bytes") >= min_bytes)).select("id", *key), "digests")
    first = told.groupBy(*key).agg(F.min("id").alias("first"), F.count("*").alias("c")).filter("c > 1").select(*key, "first")
    later = materialise(told.join(first, key).filter("id <> first").distinct(), "revisits")
    maybe = sieve(later, "id")
    rows = rows.withColumn("_maybe", maybe(F.col("id")))
    some = rows.filter("_maybe").join(later, ["id", *key], "left")
    met = some.unionByName(rows.filter("not _maybe").withColumn("first", F.lit(None).cast("bigint")))
    again = F.col("first").isNotNull()
    return met.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">")).alias("record_id"),
        "target_uri", F.concat(F.lit("sha1:"), "payload_digest").alias("payload_digest"), F.when(again, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))).alias("refers_to"),
        "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )


def write(records_df: DataFrame, path: str, mode: str = "append") -> None:
    records_df.sparkSession.dataSource.register(WarcSource)
    records_df.write.format("warc").mode(mode).save(path)


def read(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_number(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives pages in the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type,
    refers_to. Digest and length of a response come from the payload that was read, a revisit's from its headers; both
    scans push their record type down."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(as_records(pages), path)
    responses = read(spark, path).filter("record_type = 'response'")
    revisits = read(spark, path, payload=False).filter("record_type = 'revisit'")  # from headers alone
    back = responses.unionByName(revisits)
    is_response = F.col("record_type") == "response"
    return back.select(
        page_number(F.col("record_id")).alias("page_id"), F.when(is_response, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("bigint").alias("payload_bytes"),
        F.when(is_response, base32_sha1(F.col("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"), "record_type", page_number(F.col("refers_to")).alias("refers_to"),
    )

"""WARC archives: a writer in DataFrame operations and a PySpark Python data source that reads them.

Writing. Uncompressed WARC records are UTF-8 text if their payloads are, and each ends with two line breaks; so an
archive is a text table whose line separator is those breaks, written by Spark into whatever store the path names. Of
records with equal payloads of `least` bytes or more, that of the largest id holds the payload, and the others are
revisit records that refer to it.

Reading (format "warc"). The driver lists the files and plans one partition per file. A task parses a record's headers
first and tests the pushed predicates on them; the payload of a record that fails, or of any record if the option
`payload` is false, is skipped by its length, neither read into Python nor decoded. Predicates on the record type and
the other header columns (HEADERS) are pushed down: those given to `read_warc`, which belong to that load alone, and on
demand those that Spark finds in a query. Files ending in .gz are read through their members.

Defined results: null html is an empty payload; a null url leaves out the target; null ids are written as "null" and
come back as null; repeated rows each get a record; an empty table gives an archive without records; malformed records
raise with file and offset; other columns may have any names.
"""

from __future__ import annotations

import gzip
import io
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from .common import attach, durable

LEAST = 1000  # bytes from which equal payloads are stored once
END = "\r\n\r\n"
BATCH_BYTES = 8 << 20
BROADCAST_ROWS = 100_000  # revisits, about 100 bytes each, up to which their list is broadcast
SCHEMA = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, refers_to string, content_length long, http_length long, payload binary"
#: Header of each column that a predicate can be pushed to.
HEADERS = {
    "record_id": "warc-record-id",
    "warc_type": "warc-type",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}


def record_text(type_: str, refers: bool) -> F.Column:
    """A record as text without its closing line breaks, from columns id, url, date, sha1, bytes, html and refers_to."""
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = http if refers else F.concat(http, F.col("html"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    lines = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {type_}"),
        F.concat(F.lit("WARC-Record-ID: "), name("id")),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        *([F.concat(F.lit("WARC-Refers-To: "), name("refers_to")), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if refers else []),
        F.concat(F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", least: int = LEAST) -> None:
    """Write one record per row of pages."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"))
    base = base.withColumns({"sha1": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long"), "date": F.lit(date)})
    digests = durable(base.where(F.col("bytes") >= least).select("id", "sha1"))
    groups = durable(digests.groupBy("sha1").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"))
    again = attach(digests, groups, "sha1", "n", digests.count()).where("id <> refers_to or (id is null and refers_to is not null)")
    again = durable(again.select(F.col("id").alias("again_id"), F.col("sha1").alias("again_sha1"), "refers_to").distinct())
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)  # else payloads and revisits shuffle by id and digest
    marked = base.join(again, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("sha1") == F.col("again_sha1")), "left")
    text = F.when(F.col("refers_to").isNull(), record_text("response", False)).otherwise(record_text("revisit", True))
    marked.select(text.alias("value")).write.option("lineSep", END).text(path)


def matches(test: Filter, row: dict[str, str | None]) -> bool:
    """Whether a record's headers pass a pushed predicate."""
    if isinstance(test, Not):
        return row.get(test.child.attribute[0]) is not None and not matches(test.child, row)
    value = row.get(test.attribute[0])
    if isinstance(test, IsNull):
        return value is None
    if isinstance(test, EqualNullSafe):
        return value == test.value
    if value is None:
        return False
    if isinstance(test, IsNotNull):
        return True
    if isinstance(test, EqualTo):
        return value == test.value
    if isinstance(test, In):
        return value in test.value
    if isinstance(test, StringStartsWith):
        return value.startswith(test.value)
    if isinstance(test, StringEndsWith):
        return value.endswith(test.value)
    return test.value in value  # StringContains


def pushable(test: Filter) -> bool:
    if isinstance(test, Not):
        return isinstance(test.child, EqualTo | In) and pushable(test.child)
    return isinstance(test, EqualTo | EqualNullSafe | In | IsNull | IsNotNull | StringStartsWith | StringEndsWith | StringContains) and len(test.attribute) == 1 and test.attribute[0] in HEADERS


def filesystem(path: str) -> tuple:
    """(file system, path in it). Paths without a scheme are local."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]*:/", path, re.I):
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return fs.LocalFileSystem(), path


def predicate(column: str, kind: str, value: str | list[str] | None = None) -> Filter:
    """A predicate on a header column: kind is =, !=, in, not in, null, not null, starts, ends or contains."""
    if column not in HEADERS:
        raise ValueError(f"no header column {column}; there are {', '.join(HEADERS)}")
    at = (column,)
    made = {
        "=": lambda: EqualTo(at, value),
        "!=": lambda: Not(EqualTo(at, value)),
        "in": lambda: In(at, tuple(value)),
        "not in": lambda: Not(In(at, tuple(value))),
        "null": lambda: IsNull(at),
        "not null": lambda: IsNotNull(at),
        "starts": lambda: StringStartsWith(at, value),
        "ends": lambda: StringEndsWith(at, value),
        "contains": lambda: StringContains(at, value),
    }
    if kind not in made:
        raise ValueError(f"no predicate {kind}; there are {', '.join(made)}")
    return made[kind]()


class WarcPartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.tests: list[Filter] = [predicate(*p) for p in json.loads(options.get("predicates", "[]"))]

    def partitions(self) -> list[WarcPartition]:
        from pyarrow import fs

        store, path = filesystem(self.root)
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            return [WarcPartition(path)]
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        return [WarcPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", "."))]

    def read(self, partition: WarcPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark passes where there are no partitions
            return
        store, _ = filesystem(self.root)
        with store.open_input_file(partition.path) as raw:
            stream = gzip.open(raw) if partition.path.endswith(".gz") else io.BufferedReader(_Seekable(raw), 1 << 20)
            rows, size = [], 0
            for row in self.records(stream, partition.path):
                rows.append(row)
                size += 500 + len(row[-1] or b"")
                if size > BATCH_BYTES:
                    yield self.batch(rows)
                    rows, size = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*HEADERS, "content_length", "http_length", "payload"])

    def records(self, stream, name: str) -> Iterator[tuple]:
        while True:
            line = stream.readline()
            while line in (b"\r\n", b"\n"):
                line = stream.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{name}: no record at {stream.tell() - len(line)}")
            start = stream.tell() - len(line)
            head = read_headers(stream)
            if not head.get("content-length", "").isdigit():
                raise ValueError(f"{name}: no length of the record at {start}")
            length = int(head["content-length"])
            row = {column: head.get(header) for column, header in HEADERS.items()}
            if not all(matches(t, row) for t in self.tests):
                stream.seek(length, io.SEEK_CUR)
                continue
            http_length = payload = None
            if not self.payload and row["warc_type"] == "response":
                stream.seek(length, io.SEEK_CUR)
            else:
                block = stream.read(length)
                if head.get("content-type", "").startswith("application/http"):
                    http, _, body = block.partition(b"\r\n\r\n")
                    said = re.search(rb"\r\ncontent-length:\s*(\d+)", http, re.I)
                    http_length = int(said[1]) if said else None
                    payload = body if row["warc_type"] == "response" and self.payload else None
                else:
                    payload = block if self.payload else None
            yield (*row.values(), length, http_length, payload)


class PushingWarcReader(WarcReader):
    """Takes predicates from Spark as well."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            if pushable(test):
                self.tests.append(test)
            else:
                yield test


class _Seekable(io.RawIOBase):
    """A pyarrow file as a raw stream that can seek."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.file.read(len(buffer))
        buffer[: len(got)] = got
        return len(got)

    def seek(self, to: int, whence: int = io.SEEK_SET) -> int:
        return self.file.seek(to, whence)

    def tell(self) -> int:
        return self.file.tell()


def read_headers(stream) -> dict[str, str]:
    """Names in lower case; a line that begins with white space continues the one before."""
    head: dict[str, str] = {}
    last = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and last:
            head[last] += " " + text.strip()
        else:
            last, _, value = text.partition(":")
            last = last.strip().lower()
            head[last] = value.strip()
    return head


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return (PushingWarcReader if self.options.get("pushdown", "false").lower() == "true" else WarcReader)(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True, where: tuple[tuple, ...] = (), pushdown: bool = False) -> DataFrame:
    """The records of the archives at path whose headers pass all predicates of `where` (column, kind[, value]).

    With pushdown, Spark's own predicates on header columns reach the reader too, if the session has
    spark.sql.python.filterPushdown.enabled (else this fails). Spark keeps what it last pushed to a loaded Python source,
    so such a frame is for one set of predicates; `where` has no such limit.
    """
    if pushdown and spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        raise ValueError("set spark.sql.python.filterPushdown.enabled for the session first")
    spark.dataSource.register(WarcDataSource)
    made = [list(p) for p in where]
    for p in made:
        predicate(*p)
    options = {"payload": str(payload).lower(), "predicates": json.dumps(made), "pushdown": str(pushdown).lower()}
    records = spark.read.format("warc").options(**options).load(path)
    return records.where("warc_type is not null") if pushdown else records  # so that each scan pushes something


def page_records(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row per record of `write_warc`: the id, payload_bytes, payload_digest, record_type, refers_to.

    A response's size and digest are taken from the payload itself, a revisit's from its headers.
    """
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    is_response = F.col("warc_type") == "response"
    return records.select(
        page("record_id").try_cast("bigint").alias(id_col),
        F.when(is_response, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(is_response, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page("refers_to").try_cast("bigint").alias("refers_to"),
    )

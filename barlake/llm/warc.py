"""WARC archives: written with Spark's text writer, read by a Python data source.

`write_archive` makes a record per page. The payload is the html in UTF-8 and the only block of a record. Of
the records with equal payloads of at least `LEAST_SHARED` bytes the one with the largest page_id is a response and
the others are revisits, which carry no payload but name it. Duplicates are found on digests alone; pages are joined
with the digests that occur more than once, which is a broadcast as long as these are few by their written size.
Records are text with CRLF line ends, so the text writer with a record separator of two CRLFs makes valid
uncompressed archives in any file system that Spark can write to, with at most `RECORDS_PER_FILE` records a file.

The data source (`WarcSource`, format "warc") plans partitions of whole files, small ones together. It takes
filters on record_type and on the header columns and evaluates them on a record's header, which is parsed first; the
payload of a record that fails, or of any record with option payload=false, is skipped by its length and neither read
nor decoded.

Null html is an empty payload, a null url leaves out its header. Without any page_id in a group of equal payloads all
are responses, and so are rows that share the largest page_id; a null page_id beside it revisits it. Empty tables
give an archive without records. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from barlake import session
from barlake.llm.common import table

LEAST_SHARED = 1000
RECORDS_PER_FILE = 50_000
BYTES_A_PARTITION = 64 << 20
BYTES_A_READ = 1 << 20
RECORDS_A_BATCH = 2000
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HEADER_COLUMNS = "page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long"


def revisit_plan(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """page_id, target_uri, html, digest, n_bytes, record_type and refers_to of every page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), html.alias("html"))
    own = own.withColumn("n_bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha1("html"))
    shared = own.filter(F.col("n_bytes") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first_id")).filter("n > 1 AND first_id IS NOT NULL")
    joined = own.join(session.cut(shared.select("digest", "first_id")), "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first_id"))).drop("first_id")


def write_archive(pages: DataFrame, path: str, least: int = LEAST_SHARED) -> None:
    """Write the archive's files below the path."""
    plan = revisit_plan(pages, least)
    revisit = F.col("record_type") == "revisit"

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("target_uri", r"[\r\n]+", " ")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("X-Payload-Length", F.col("n_bytes").cast("string")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    record = F.concat(header, F.when(revisit, F.lit("")).otherwise(F.col("html"))).alias("value")
    plan.select(record).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def open_files(path: str):
    """A pyarrow file system and the path inside it, for any URI that it knows."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def parse_header(raw: bytes) -> tuple[dict, int]:
    """The header columns of a record and the length of its block."""
    version, *lines = raw.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:60]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = int(fields["content-length"])
    return {
        "page_id": _page(fields.get("warc-record-id")),
        "record_type": fields.get("warc-type"),
        "target_uri": fields.get("warc-target-uri"),
        "payload_digest": (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
        "payload_bytes": int(fields.get("x-payload-length", block)),
        "refers_to": _page(fields.get("warc-refers-to")),
    }, block


def read_records(source, size: int, wanted: Callable[[dict], bool], payload: bool, chunk: int = BYTES_A_READ) -> Iterator[tuple[dict, bytes | None]]:
    """The wanted records of an open file; payloads that are not wanted are skipped unread."""
    held, base, at = b"", 0, 0  # bytes held, their place in the file, the place of the next record

    def need(upto: int, least: int) -> None:
        nonlocal held, base
        if base + len(held) < upto:
            held = held[at - base :] if at - base < len(held) else b""
            base = at
            source.seek(base + len(held))
            held += source.read(max(least, upto - base - len(held)))

    while at < size:
        look = chunk
        need(min(size, at + 1), look)
        while (end := held.find(b"\r\n\r\n", at - base)) < 0:
            if base + len(held) >= size:
                raise ValueError(f"the header at {at} has no end")
            need(min(size, base + len(held) + 1), look)
        header, block = parse_header(held[at - base : end])
        body = base + end + 4
        if wanted(header):
            content = None
            if payload:
                need(body + block, look)
                content = held[body - base : body - base + block]
            yield header, content
        at = body + block + 4


class WarcFiles(InputPartition):
    """Files, with their sizes, that one task reads."""

    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class WarcReader(DataSourceReader):
    """Reads records whose headers pass all filters that were taken."""

    def __init__(self, path: str, payload: bool, columns: list[str]) -> None:
        self.path, self.payload, self.columns = path, payload, columns
        self.taken: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of header columns with constants, leaves the rest to Spark."""
        kinds = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", IsNotNull: "is"}
        for f in filters:
            kind, name = kinds.get(type(f)), getattr(f, "attribute", ("",))
            if kind and len(name) == 1 and name[0] in self.columns and name[0] != "payload":
                self.taken.append((name[0], kind, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[WarcFiles]:
        from pyarrow import fs

        system, path = open_files(self.path)
        found = system.get_file_info(fs.FileSelector(path))
        out: list[WarcFiles] = []
        room = 0
        for f in sorted(found, key=lambda f: f.path):
            if f.type != fs.FileType.File or f.base_name[0] in "._" or not f.size:
                continue
            if not out or f.size > room:
                out.append(WarcFiles([]))
                room = BYTES_A_PARTITION
            out[-1].files.append((f.path, f.size))
            room -= f.size
        return out or [WarcFiles([])]

    def wanted(self, header: dict) -> bool:
        for name, kind, value in self.taken:
            own = header[name]
            if own is None:
                return False
            if not {"=": lambda: own == value, "in": lambda: own in value, ">": lambda: own > value, ">=": lambda: own >= value, "<": lambda: own < value, "<=": lambda: own <= value, "is": lambda: True}[kind]():
                return False
        return True

    def read(self, partition: WarcFiles) -> Iterator[pa.RecordBatch]:
        system, _ = open_files(self.path)
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in self.columns])
        batch: list[dict] = []
        size = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(batch, schema=schema)

        for path, length in partition.files:
            with system.open_input_file(path) as source:
                for header, payload in read_records(source, length, self.wanted, self.payload):
                    batch.append(header | {"payload": payload} if self.payload else header)
                    size += len(payload or b"")
                    if len(batch) >= RECORDS_A_BATCH or size >= BYTES_A_PARTITION // 4:
                        yield full()
                        batch, size = [], 0
        if batch:
            yield full()


class WarcSource(DataSource):
    """Format "warc": options path, and payload (default true) for whether there is a payload column."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return HEADER_COLUMNS + (", payload binary" if self._payload() else "")

    def _payload(self) -> bool:
        return self.options.get("payload", "true").lower() != "false"

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self._payload(), [f.name for f in schema.fields])


def read_archive(spark: SparkSession, path: str, payload: bool = True, where: str | None = None) -> DataFrame:
    """The records of an archive that meet a condition; the data source evaluates what concerns headers.

    Spark keeps the filters that it pushed with a loaded frame, so load anew for each condition.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    found = spark.read.format("warc").option("payload", str(payload).lower()).load(path)
    return found.filter(where) if where else found


def op7_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    """The contract's result, of records written and read back; sizes and digests of payloads are those read."""
    path = session.scratch(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    found = read_archive(spark, path)
    response = F.col("record_type") == "response"
    return found.select(
        "page_id",
        F.when(response, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )

"""WARC archives and a Merkle fixity audit of their replicas.

Pages are written as WARC records by Spark's text writer (gzip) and read back as bytes.
Each record is hashed; hashes are combined level by level, in order of offset, into trees
of byte ranges. To compare two replicas only the roots are compared first, and below them
only the children of nodes that differ, down to the records that are damaged or missing.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import map_arrow, partitions, staged

END = "\r\n\r\n"  # ends the header, and again the record
#: Text files whose lines are records; gzip at its fastest costs a third of its default's time.
GZIP = {"lineSep": END, "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
FANOUT = 16
ARCHIVE_ROWS = 2000  # pages per archive on average
DATE = "2024-01-01T00:00:00Z"  # a fixed date: equal pages give equal bytes


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page's WARC record without the ending CR LF CR LF."""
    safe = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "_")
    body = F.coalesce(html, F.lit(""))
    name = F.coalesce(page_id.cast("string"), F.lit("none"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        name,
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        safe,
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.sha2(body, 256),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(END),
        body,
    )


def archived(pages: DataFrame, per_archive: int = ARCHIVE_ROWS) -> DataFrame:
    """(archive, page_id, record): pages dealt to archives by page_id, each of bounded size.

    Page ids are numbers without large holes. Pages without one are dealt by their contents to
    archives of their own, as many as their number asks for.
    """
    base = pages.select(F.col("page_id"), F.col("url"), F.col("html"))
    lone = 1 + base.where("page_id IS NULL").count() // per_archive
    known = F.concat(F.lit("part-"), F.lpad(F.expr(f"page_id div {per_archive}").cast("string"), 12, "0"))
    unknown = F.concat(F.lit("none-"), F.pmod(F.xxhash64("url", "html"), F.lit(lone)).cast("string"))
    return base.select(
        F.coalesce(known, unknown).alias("archive"),
        "page_id",
        record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"),
    )


def write_warc(records: DataFrame, path: str, archives: int | None = None) -> None:
    """One gzip WARC per archive, its records by page_id (equal ones in any order)."""
    parts = max(partitions(records), archives or 0)
    dealt = records.repartition(parts, "archive").sortWithinPartitions("archive", "page_id", "record")
    _written(dealt.select("archive", "record"), path)


def copy_warc(spark: SparkSession, first: str, second: str, change: Column | None = None) -> None:
    """A replica of the archives under ``first``; ``change`` may alter its ``record``.

    Archives are read whole by one task each, so their order holds without a shuffle.
    """
    read = read_warc(spark, first).select("archive", "seq", F.col("record").cast("string").alias("record"))
    changed = read if change is None else read.withColumn("record", change)
    _written(changed.sortWithinPartitions("archive", "seq").select("archive", "record"), second)


def _written(sorted_records: DataFrame, path: str) -> None:
    sorted_records.write.partitionBy("archive").options(**GZIP).text(path)


READ = (
    "archive string, seq bigint, offset bigint, length bigint, record_id string, uri string, payload_ok boolean, "
    "sha256 string, record binary"
)


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields, payload) of each record; a damaged tail is one record.

    A header that cannot be read makes the rest up to the next record start one record.
    """
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        fields: dict[str, str] = {}
        size = None
        if head >= 0 and data.startswith(b"WARC/", at):
            for line in data[at:head].split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
            if fields.get("content-length", "").isdigit():
                size = int(fields["content-length"])
        end = None if size is None else head + 4 + size + 4
        if end is None or data[end - 4 : end] != b"\r\n\r\n":
            found = data.find(b"\r\n\r\nWARC/", at + 1)
            end = len(data) if found < 0 else found + 4
        payload = data[head + 4 : end - 4] if head >= 0 and fields else b""
        yield at, end - at, fields, payload
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under ``path``, with offsets in the unpacked archive.

    ``record`` is its bytes without the CR LF CR LF that ends it; see :func:`payload`.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.binary())
        names = [f.split()[0] for f in READ.split(", ")]
        for batch in batches:
            for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = []
                for seq, (offset, length, fields, payload) in enumerate(parse(data)):
                    told = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    sha = hashlib.sha256(data[offset : offset + length]).hexdigest()
                    rows.append((
                        archive, seq, offset, length, fields.get("warc-record-id"), fields.get("warc-target-uri"),
                        told == hashlib.sha256(payload).hexdigest(), sha, data[offset : offset + length].removesuffix(b"\r\n\r\n"),
                    ))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    archive = F.regexp_extract("path", r"archive=([^/]+)/", 1)
    return map_arrow(files.select(archive.alias("archive"), "content"), run, READ)


def payload(record: Column) -> Column:
    """The payload of a record's text: what follows its header."""
    return F.regexp_replace(record, r"(?s)\A.*?\r\n\r\n", "")


def leaves(records: DataFrame) -> DataFrame:
    """The lowest level of the trees: (archive, level, node, first, end, hash)."""
    return records.select(
        "archive",
        F.lit(0).alias("level"),
        F.col("seq").alias("node"),
        F.col("offset").alias("first"),
        (F.col("offset") + F.col("length")).alias("end"),
        F.col("sha256").alias("hash"),
    )


def tree(lowest: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """All nodes. A node's hash is over its byte range and its children's hashes in order."""
    level, found = lowest, lowest
    depth = 0
    while (level.agg(F.max("node")).first()[0] or 0) > 0:
        depth += 1
        children = F.sort_array(F.collect_list(F.struct("node", "hash")))  # at most fanout of them
        level = staged(
            level.groupBy("archive", F.expr(f"node div {fanout}").alias("parent"))
            .agg(F.min("first").alias("first"), F.max("end").alias("end"), children.alias("children"))
            .select(
                "archive",
                F.lit(depth).alias("level"),
                F.col("parent").alias("node"),
                "first",
                "end",
                F.sha2(F.concat_ws(":", "first", "end", F.concat_ws(",", "children.hash")), 256).alias("hash"),
            ),
            f"tree{depth}",
        )
        found = found.unionByName(level)
    return found


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(archive, seq) of the records that differ or are missing on one side.

    Levels are compared from the top; only children of differing nodes are looked at.
    """
    top = max(x.agg(F.max("level")).first()[0] or 0 for x in (left, right))
    suspects: DataFrame | None = None
    for level in range(top, -1, -1):
        a, b = (
            x.where(F.col("level") == level).select("archive", "node", F.struct("first", "end", "hash").alias(name))
            for x, name in ((left, "a"), (right, "b"))
        )
        if suspects is not None:
            child = F.expr(f"node div {fanout}") == F.col("p")
            under = suspects.withColumnRenamed("node", "p").withColumnRenamed("archive", "q")
            a, b = (x.join(under, (F.col("archive") == F.col("q")) & child, "left_semi") for x in (a, b))
        differing = a.join(b, ["archive", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
        suspects = staged(differing.select("archive", "node"), f"suspects{level}")
    return suspects.withColumnRenamed("node", "seq")


def fixity(
    spark: SparkSession, first: str, second: str
) -> tuple[DataFrame, DataFrame]:
    """Records of the first replica, and the places where the second differs from it.

    A place is (archive, seq, here): that record of the first replica has no equal in the
    second's archive, or (``here`` is false) that of the second none in the first's. A record
    lost or added in the middle moves all behind it, so the trees differ from there on; records
    whose bytes the other replica has too, as often, are no damage.
    """
    records = staged(read_warc(spark, first).drop("record"), "records")
    other = staged(leaves(read_warc(spark, second)), "other-leaves")
    suspects = audit(tree(leaves(records)), tree(other))
    sides = [
        x.join(suspects.withColumnRenamed("seq", "node"), ["archive", "node"]).select("archive", F.col("node").alias("seq"), "hash")
        for x in (leaves(records), other)
    ]
    nth = F.row_number().over(Window.partitionBy("archive", "hash").orderBy("seq")).alias("nth")
    a, b = (x.select("*", nth) for x in sides)
    key = ["archive", "hash", "nth"]
    lost = a.join(b.select(*key), key, "left_anti").select("archive", "seq", F.lit(True).alias("here"))
    found = b.join(a.select(*key), key, "left_anti").select("archive", "seq", F.lit(False).alias("here"))
    return records, staged(lost.unionByName(found), "damage")

"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

**Writing.**  A record is a header block, an empty line and the payload; the text
writer puts each one after the other with ``\\r\\n\\r\\n`` between, which is the WARC 1.0
layout.  Files are committed by Spark, so lost tasks leave nothing behind, and any
file system that Spark can write to will do.  Of records with equal payloads of at
least ``least_bytes``, the one with the smallest id is a ``response``; the others are
``revisit`` records that name it and hold no payload.

**Reading.**  Files are split at every ``WARC/1.0\\r\\n``, wherever it occurs, also inside
payloads.  Each task takes the pieces of its splits and emits, per piece, the offset of
the record that may begin there and of its successor as its header claims, both
within the split; the splits' lengths, summed over a file, turn them into offsets of
the file.  Inside a split the candidates' successors form a forest; its order is
numbered so that "is on the chain from this entry" is a comparison, and each candidate
knows where its chain leaves the split.  Pointer jumping over those exits, from offset 0 of
every file, finds the entry of every split by Spark joins; a candidate is a record
only if it is on the chain from its split's entry.  A record is whole if its payload
ends within its file; pieces that belong to a record with magic in its payload are
put together again by offset.

Payload bytes never cross the network for records without magic inside.

Defined cases: null html is an empty payload; a null url gives ``urn:spindrift:none``; header
values have control characters percent-encoded, and urls, headers and payloads may be of any length; pages
without an id come back with a null one and are never a copy of others; repeated rows are written each,
and of copies only those with a larger id than the smallest revisit it, so rows that share it are
responses both; an empty table gives no records; other columns, whatever their names, are not written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm import bloom, common

MAGIC = "WARC/1.0\r\n"
BREAK = "\r\n\r\n"
LEAST_BYTES = 100


def _safe(c: Column) -> Column:
    """No line ends inside a header value."""
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def plan_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Pages with ``digest``, ``size`` and ``keeper`` (null: a response; else the response's id)."""
    spark = pages.sparkSession
    rows = common.pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html").cast("long"))
    keys = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("keeper"), F.count("*").alias("n"))
    same = common.store(keys.where("n > 1 and keeper is not null").select("digest", "keeper"), "copies", number=F.count(F.lit(1)))
    if not same.watched["number"]:
        return rows.withColumn("keeper", F.lit(None).cast("long"))
    head = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    might = bloom.test(same.select(head.alias("key")), same.watched["number"])
    # unlike payloads stay in place; copies, perhaps a third of all, meet their group's row in a join that Spark can split
    rows = rows.withColumn("copied", (F.col("size") >= least_bytes) & might(head))
    met = rows.where("copied").join(same, "digest", "left")
    met = met.withColumn("keeper", F.when(F.col("page_id") > F.col("keeper"), F.col("keeper")))
    columns = ["page_id", "url", "html", "digest", "size", "keeper"]
    return met.select(*columns).unionByName(rows.where("not copied").withColumn("keeper", F.lit(None).cast("long")).select(*columns))


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    rows = plan_records(pages, least_bytes)
    name = lambda c: F.concat(F.lit("<urn:spindrift:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("keeper").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), _safe(F.coalesce("url", F.lit("urn:spindrift:none")))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("keeper")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    rows.select(F.concat(header, F.lit(BREAK), block).alias("value")).write.option("lineSep", BREAK).text(path)


_HEADERS = {
    "type": b"warc-type",
    "record_id": b"warc-record-id",
    "target_uri": b"warc-target-uri",
    "refers_to": b"warc-refers-to",
    "claimed": b"warc-payload-digest",
    "full_length": b"x-payload-length",
}
_SCANNED = (
    "file string, split long, seen long, piece_bytes long, start long, next long, leaves long, pre long, last long, "
    "body long, length long, payload_sha256 string, " + ", ".join(f"{k} string" for k in _HEADERS)
)
_COLUMNS = [f.split() for f in _SCANNED.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64()}


def _header(piece: bytes) -> tuple[int, int, list[str | None]]:
    """Where the payload begins, its claimed length and the header values; (-1, -1, nulls) without a header block."""
    end = piece.find(BREAK.encode())
    values: dict[bytes, bytes] = {}
    for line in piece[: max(end, 0)].split(b"\r\n"):
        key, _, value = line.partition(b":")
        values.setdefault(key.strip().lower(), value.strip())
    length = values.get(b"content-length", b"")
    if end < 0 or not length.isdigit() or len(length) > 15:
        return -1, -1, [None] * len(_HEADERS)
    return end + 4, int(length), [values[h].decode("utf-8", "replace") if h in values else None for h in _HEADERS.values()]


def _forest(start: list[int], after: list[int]) -> tuple[list[int], list[int], list[int]]:
    """For candidates of one split in order: where their chain leaves it (-1: it breaks), and their places in
    an order in which those whose chains run through one directly follow it (first place, last place)."""
    n, index = len(start), {s: i for i, s in enumerate(start)}
    leaves, parent = [-1] * n, [n] * n
    for i in range(n - 1, -1, -1):
        if after[i] > start[-1]:
            leaves[i] = after[i]
        elif after[i] in index:
            parent[i] = index[after[i]]
            leaves[i] = leaves[parent[i]]
    weight = [1] * (n + 1)
    for i in range(n):  # predecessors lie before
        weight[parent[i]] += weight[i]
    pre, free = [0] * n, [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        pre[i] = free[parent[i]]
        free[parent[i]] += weight[i]
        free[i] = pre[i] + 1
    return leaves, pre, [pre[i] + weight[i] - 1 for i in range(n)]


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, split, offset in the split, piece): pieces come in the order of the file.

    A piece begins behind the magic that ended the piece before it, except at the head of a file.
    """
    at, total = None, 0
    for batch in batches:
        for file, split, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (file, split) != at:
                at, total = (file, split), 0
            piece = piece.as_py()
            yield file, split, total, piece
            total += len(piece) + len(MAGIC)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[list]) -> pa.RecordBatch:
        seen = rows[-1][4] + 2 * len(MAGIC) + rows[-1][3]
        leaves, pre, last = _forest([r[4] for r in rows], [r[5] for r in rows])
        for r, a, b, c in zip(rows, leaves, pre, last, strict=True):
            r[2], r[6:9] = seen, (a, b, c)
        return pa.record_batch([pa.array(c, _TYPES[f[1]]) for c, f in zip(zip(*rows, strict=True), _COLUMNS, strict=True)], [f[0] for f in _COLUMNS])

    rows: list[list] = []
    for file, split, offset, piece in _splits(batches):
        if rows and rows[0][:2] != [file, split]:
            yield out(rows)
            rows = []
        body, length, values = _header(piece)
        after, digest = -1, None
        if body >= 0:
            after = offset + body + length + len(BREAK)
            if body + length <= len(piece):
                digest = hashlib.sha256(memoryview(piece)[body : body + length]).hexdigest()
        rows.append([file, split, 0, len(piece), offset - len(MAGIC), after, 0, 0, 0, body, length, digest, *values])
    if rows:
        yield out(rows)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``file, offset, type, record_id, target_uri, refers_to, payload_bytes, payload_digest, intact``.

    ``payload_bytes`` and ``payload_digest`` are of the full payload: what a response holds, or what
    a revisit says.  ``intact``: a response's bytes have the digest that its header claims.
    """
    common.prepare(spark)
    found = common.store(_pieces(spark, path).mapInArrow(common.frugal(_scan), _SCANNED), "pieces")
    # a split's first piece begins where the split before ended: running sums over a file's splits
    w = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = found.groupBy("file", "split").agg(F.max("seen").alias("seen")).withColumn("base", F.coalesce(F.sum("seen").over(w), F.lit(0)))
    placed = found.join(base.select("file", "split", "base"), ["file", "split"])
    moved = [F.when(F.col(c) >= low, F.col(c) + F.col("base")).otherwise(-1).alias(c) for c, low in (("start", -len(MAGIC)), ("next", 0), ("leaves", 0))]
    placed = common.store(placed.select(*[c for c in found.columns if c not in ("start", "next", "leaves")], *moved), "placed")
    candidates = placed.where("next >= 0 and start >= 0")
    # pointer jumping from the start of each file over the places where chains leave splits
    reached = placed.select("file").distinct().select("file", F.lit(0).cast("long").alias("start"))
    targets = candidates.select("file", F.col("leaves").alias("start")).where("start >= 0").unionByName(reached).distinct()
    jumps = candidates.where("leaves >= 0").join(targets, ["file", "start"]).select("file", "start", F.col("leaves").alias("to"))
    reached, jumps, seen = common.store(reached, "reached"), common.store(jumps, "jumps"), -1
    while (count := reached.count()) > seen:  # each round doubles the steps that a jump makes
        seen = count
        step = reached.join(jumps, ["file", "start"]).select("file", F.col("to").alias("start"))
        reached = common.store(reached.unionByName(step).distinct(), "reached")
        further = jumps.select("file", F.col("start").alias("to"), F.col("to").alias("end"))
        jumps = common.store(jumps.join(further, ["file", "to"]).select("file", "start", F.col("end").alias("to")), "jumps")
    entries = candidates.join(reached, ["file", "start"]).select("file", "split", F.col("pre").alias("entry")).groupBy("file", "split").agg(F.min("entry").alias("entry"))
    ends = placed.groupBy("file").agg(F.max(F.col("start") + len(MAGIC) + F.col("piece_bytes")).alias("file_bytes"))
    records = candidates.join(entries, ["file", "split"]).where("pre <= entry and entry <= last").join(ends, "file")
    records = records.where(F.col("start") + len(MAGIC) + F.col("body") + F.col("length") <= F.col("file_bytes"))
    records = common.store(records, "records")
    torn = records.where("payload_sha256 is null")
    if torn.isEmpty():
        return _result(records.withColumn("whole_sha256", F.lit(None).cast("string")))
    whole = _reassemble(spark, path, placed, records, base)
    return _result(records.join(whole, ["file", "start"], "left"))


def _result(records: DataFrame) -> DataFrame:
    revisit = F.lower("type") == "revisit"
    digest, claimed = F.coalesce("payload_sha256", "whole_sha256"), F.regexp_replace("claimed", "^sha256:", "")
    return records.select(
        "file",
        F.col("start").alias("offset"),
        "type",
        "record_id",
        F.replace(F.replace(F.replace("target_uri", F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%")).alias("target_uri"),
        "refers_to",
        F.when(revisit, F.coalesce(F.col("full_length").try_cast("long"), "length")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.coalesce(claimed, digest)).otherwise(digest).alias("payload_digest"),
        (revisit | claimed.isNull() | (claimed == digest)).alias("intact"),
    )


def _reassemble(spark: SparkSession, path: str, placed: DataFrame, records: DataFrame, base: DataFrame) -> DataFrame:
    """``file, start, whole_sha256`` of records whose payload holds magic: their pieces meet by record."""
    w = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.col("owner"), ignorenulls=True).over(w)
    marks = records.select("file", "start", F.col("start").alias("owner"), F.when(F.col("payload_sha256").isNull(), F.col("start")).alias("torn"))
    all_pieces = placed.where("start >= 0").select("file", "split", "start").join(marks, ["file", "start"], "left")
    owned = all_pieces.withColumn("owner", owner)
    broken = records.where("payload_sha256 is null").select("file", F.col("start").alias("owner"), "body", "length")
    wanted = owned.join(broken, ["file", "owner"]).join(base.select("file", "split", "base"), ["file", "split"])
    # where the piece lies in its split, as the second reading sees it
    wanted = common.store(wanted.withColumn("place", F.col("start") + len(MAGIC) - F.col("base")).drop("torn"), "torn")
    key = F.xxhash64("file", "split", "place")
    might = bloom.test(wanted.select(key.alias("key")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _splits(batches):
            yield pa.record_batch([pa.array([v]) for v in row], ["file", "split", "place", "piece"])

    again = _pieces(spark, path).mapInArrow(common.frugal(place), "file string, split long, place long, piece binary").where(might(key))

    def join(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("start")
        body, length = pieces["body"][0].as_py(), pieces["length"][0].as_py()
        payload = MAGIC.encode().join(pieces["piece"].to_pylist())[body : body + length]
        return pa.table({"file": [pieces["file"][0].as_py()], "start": [pieces["owner"][0].as_py()], "whole_sha256": [hashlib.sha256(payload).hexdigest()]})

    met = again.join(wanted, ["file", "split", "place"]).select("file", "owner", "start", "body", "length", "piece")
    return met.groupBy("file", "owner").applyInArrow(join, "file string, start long, whole_sha256 string")

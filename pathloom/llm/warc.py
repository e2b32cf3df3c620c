"""Write WARC archives with Spark's text writer and read them back in splits, finding records by verified chains.

The magic of a record may also stand inside a payload, so a reader that starts anywhere in a file cannot trust it. Each
task splits its part of the file at every magic and emits, per candidate record, where its successor must begin. Within a
split the successors are followed at once; what remains is one jump per split and entry point. Pointer jumping (doubling the
length of all jumps) from the start of each file then marks the entry points that are really reached, in as many rounds as the
logarithm of the splits of a file. Records on a marked chain are real, all other candidates lie inside payloads.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.joins import left_join
from pathloom.scale import cut_lineage

MAGIC = "WARC/1.0\r\n"
_END = "\r\n\r\n"
_HEADER = re.compile(rb"((?:[^\r\n]+\r\n)+)\r\n")
_REFERS = b"WARC-Refers-To-Page"
_PIECE = pa.schema([
    ("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("next", pa.int64()), ("leaves", pa.int64()),
    ("fits", pa.bool_()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
])
_PIECES = ("file string, split long, at long, size long, next long, leaves long, fits boolean, page_id long, record_type string, "
           "refers_to long, payload_bytes long, payload_digest string")
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of bytes in upper-case base32: five hexadecimal digits are four of base 32."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _one_line(text: Column) -> Column:
    """A header value on one line: control characters are written as %XX."""
    text = F.coalesce(text, F.lit(""))
    for code in (37, 13, 10, 0):  # % first
        text = F.replace(text, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return text


def records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """One row per row of ``pages (page_id, url, html)`` with the record that it becomes.

    Among records with equal payloads of at least ``min_revisit_bytes`` the smallest ``page_id`` is the response and the
    others refer to it; smaller payloads are all responses. Copies of a row with that smallest id are responses. A null html is
    an empty payload.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("html"))
    known = whole.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": base32_sha1(F.col("html"))})
    # Digests with several ids are few where copies are few; the html itself is not moved if they can be broadcast.
    shared = (
        known.filter(F.col("payload_bytes") >= min_revisit_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"))
        .filter("first_id != last_id or first_id is null")
        .select(F.concat_ws(":", "payload_digest", "payload_bytes").alias("payload_key"), "first_id")
    )
    shared = cut_lineage(shared)
    keyed = known.withColumn("payload_key", F.concat_ws(":", "payload_digest", "payload_bytes"))
    return left_join(keyed, shared, "payload_key").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(F.col("first_id") < F.col("page_id"), F.col("first_id")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Write the records of ``pages`` as WARC files under ``path``, one file per task."""
    row = records(pages, min_revisit_bytes)
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, "").otherwise(F.col("html"))
    header = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.xxhash64("page_id", "url", "payload_digest").cast("string"),
        F.lit(">\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Target-URI: "), _one_line(F.col("url")),
        F.lit("\r\nWARC-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit("\r\nWARC-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(revisit, F.concat(
            F.lit(f"\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n{_REFERS.decode()}: "),
            F.col("refers_to").cast("string"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(_END),
    )
    row.select(F.concat(header, body).alias("record")).write.option("lineSep", _END).text(path)


def _fields(piece: bytes) -> tuple[dict[bytes, bytes], int] | None:
    found = _HEADER.match(piece)
    if not found:
        return None
    lines = [line.partition(b":") for line in found[1].split(b"\r\n")[:-1]]
    fields = {name.strip(): value.strip() for name, _, value in lines}
    return (fields, found.end()) if fields.get(b"Content-Length", b"").isdigit() else None


def _record(fields: dict[bytes, bytes], payload: bytes | None) -> list:
    """``page_id, record_type, refers_to, payload_bytes, payload_digest`` of a record."""
    def number(name: bytes) -> int | None:
        return int(fields[name]) if fields.get(name, b"").lstrip(b"-").isdigit() else None

    kind = fields.get(b"WARC-Type", b"").decode("utf-8", "replace")
    if kind == "revisit":
        size, digest = number(b"WARC-Payload-Length"), fields.get(b"WARC-Payload-Digest", b"").decode("utf-8", "replace").removeprefix("sha1:")
    elif payload is not None:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    else:
        size = digest = None
    return [number(b"WARC-Page-ID"), kind, number(_REFERS), size, digest]


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between magics, in file order within each split of a file."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("value"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """Every piece with its file, its split and its place relative to the first piece of the split."""
    split, at = None, 0
    for batch in batches:
        files, begins = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, value in enumerate(batch.column(2)):
            if (files[i], begins[i]) != split:
                split, at = (files[i], begins[i]), 0
            value = value.as_py()
            yield *split, at, value
            at += len(MAGIC) + len(value)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece the place at which it claims its successor to be, and where its chain leaves the split; what it would be as
    a record if it is one whole. A last row per split, of size -1, stands where the split ends."""
    rows: list[list] = []

    def finished() -> pa.RecordBatch:
        file, split, at, size = rows[-1][:4]
        end = at + size + len(MAGIC)
        exits: dict[int, int | None] = {}
        for row in reversed(rows):  # a successor stands behind, so its exit is known
            if row[4] is not None:
                row[5] = exits[row[2]] = row[4] if row[4] >= end else exits.get(row[4])
        rows.append([file, split, end, -1] + [None] * 8)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE)], schema=_PIECE)

    for file, split, at, value in _placed(batches):
        if rows and rows[-1][:2] != [file, split]:
            yield finished()
            rows = []
        row = [file, split, at, len(value)] + [None] * 8
        read = _fields(value)
        if read:
            fields, header = read
            stop = header + int(fields[b"Content-Length"])
            row[4] = at + stop + len(_END) + len(MAGIC)
            row[6] = value[stop:] == _END.encode()
            row[7:] = _record(fields, value[header:stop] if row[6] else None)
        rows.append(row)
    if rows:
        yield finished()


def _follow(table: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one split; ``until`` is the start of the record behind each, which the pieces of a record share."""
    table = table.sort_values("at")
    base, entry, after = (table[c].iloc[0] for c in ("base", "entry", "after"))
    claims = dict(zip(table["at"], table["next"]))
    starts: list[int] = []
    while not pd.isna(entry) and entry in claims:
        starts.append(int(entry))
        entry = claims[entry]
    behind = pd.Series(starts, dtype="int64").searchsorted(table["at"], "right")
    table["real"] = table["at"].isin(starts)
    table["until"] = [base + starts[i] if i < len(starts) else after for i in behind]
    table["place"] = base + table["at"]
    return table.drop(columns=["base", "entry", "after", "next", "leaves", "size"])


def _joined_record(table: pd.DataFrame) -> pd.DataFrame:
    """A record whose payload holds the magic, from its pieces."""
    table = table.sort_values("place")
    whole = MAGIC.encode().join(table["value"])
    fields, header = _fields(whole)
    stop = header + int(fields[b"Content-Length"])
    page_id, kind, refers, size, digest = _record(fields, whole[header:stop])
    return pd.DataFrame({"page_id": pd.array([page_id], "Int64"), "payload_bytes": [size], "payload_digest": [digest], "record_type": [kind],
                         "refers_to": pd.array([refers], "Int64")})


def _reached(jumps: DataFrame, rounds: int) -> DataFrame:
    """``(file, start)`` of all starts reached from the first record of each file over ``jumps (file, start, to)``."""
    first = len(MAGIC)
    targets = jumps.select("file", F.col("to").alias("start")).distinct()
    steps = cut_lineage(jumps.join(targets, ["file", "start"], "left_semi").unionByName(jumps.filter(F.col("start") == first)).distinct())
    reached = cut_lineage(steps.filter(F.col("start") == first).select("file", "start"))
    for _ in range(rounds):
        onward = reached.join(steps, ["file", "start"]).select("file", F.col("to").alias("start"))
        reached = cut_lineage(reached.unionByName(onward).distinct())
        second = steps.select("file", F.col("start").alias("to"), F.col("to").alias("far"))
        steps = cut_lineage(steps.join(second, ["file", "to"]).select("file", "start", F.col("far").alias("to")))
    return reached


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the uncompressed archives under ``path``: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Size and digest of a response are those of its payload as read; a revisit has those of the payload it refers to in
    its header. A file whose chain does not end at its end is damaged and is an error. No archive gives an empty table.
    """
    pieces = cut_lineage(_scan(spark, path).mapInArrow(_candidates, _PIECES))
    in_file = Window.partitionBy("file").orderBy("split")
    ends = pieces.filter("size = -1").select("file", "split", F.col("at").alias("total"))
    splits = cut_lineage(
        ends.withColumn("base", F.sum("total").over(in_file) - F.col("total"))
        .withColumn("file_end", F.sum("total").over(Window.partitionBy("file")))
        .withColumn("splits", F.count(F.lit(1)).over(Window.partitionBy("file")))
    )
    most = splits.agg(F.max("splits")).first()[0] or 0
    claims = pieces.filter("leaves is not null").join(splits, ["file", "split"])
    place = F.col("base") + F.col("at")
    jumps = cut_lineage(claims.select("file", "split", "at", place.alias("start"), (F.col("base") + F.col("leaves")).alias("to")))
    reached = _reached(jumps.select("file", "start", "to"), most.bit_length() + 1)
    whole = reached.join(splits.select("file", F.col("file_end").alias("start")).distinct(), ["file", "start"])
    files = splits.filter(F.col("file_end") > len(MAGIC)).select("file").distinct()
    damaged = files.join(whole, "file", "left_anti").limit(3).collect()
    if damaged:
        raise ValueError(f"damaged archives, such as {[row.file for row in damaged]}")
    entries = reached.join(jumps, ["file", "start"]).select("file", "split", "at", "start")
    entry = entries.select("file", "split", F.col("at").alias("entry"), "start")
    later = in_file.rowsBetween(1, Window.unboundedFollowing)
    splits = splits.join(entry, ["file", "split"], "left").select(
        "file", "split", "base", "entry", F.coalesce(F.min("start").over(later), F.col("file_end")).alias("after"))
    kept = ("file string, split long, at long, fits boolean, page_id long, record_type string, refers_to long, payload_bytes long, "
            "payload_digest string, real boolean, until long, place long")
    followed = cut_lineage(
        pieces.filter("size >= 0").join(splits, ["file", "split"]).groupBy("file", "split").applyInPandas(_follow, kept))
    columns = [field.split()[0] for field in _RECORD.split(", ")]
    simple = followed.filter("real and fits").select(*columns)
    broken = followed.filter("real and not fits").select("file", "until")
    if not broken.limit(1).count():
        return simple
    needed = followed.join(broken, ["file", "until"], "left_semi").select("file", "split", "at", "until", "place")

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, split, at, value in _placed(batches):
            yield pa.RecordBatch.from_pydict({"file": [file], "split": [split], "at": [at], "value": [value]})

    values = _scan(spark, path).mapInArrow(raw, "file string, split long, at long, value binary")
    parts = values.join(needed, ["file", "split", "at"]).select("file", "until", "place", "value")
    return simple.unionByName(parts.groupBy("file", "until").applyInPandas(_joined_record, _RECORD))

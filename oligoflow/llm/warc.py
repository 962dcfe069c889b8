"""WARC archives: one record for each page, repeats as revisits, and a reader that follows the chain of records.

Writing: a record ends with two line ends, so Spark's text writer with that separator writes whole archives; a task that
is tried again leaves one file. Payloads of at least REVISIT bytes that are equal (SHA-1 and length) are written once,
by the row with the largest page_id; the others become revisit records, which keep the digest and the HTTP headers.

Reading: files are cut wherever a line begins like a record, by Spark's text reader and so in parts of bounded size.
Each place may be a record or lie within a payload that holds the same bytes. A task reads the header at each
place and gives the place of its successor. Within a part the successors are followed to where the chain leaves the
part; from part to part, pointers from the file's start are doubled until nothing new is reached. Only places on the
chain from a file's start are records; a chain that doesn't end with its file raises an error. Records without such
bytes in their payload are complete where they are read, and their payload's digest is worked out there. The others are
read once more, put together from their pieces, and only their bytes are moved.

Cases: null payloads count as empty; a null page_id has an empty id, comes before all numbers and reads back as null;
rows that share page_id and payload are all responses, or all revisits; line ends in addresses are escaped; an empty
table gives no records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes from which equal payloads are written once, and revisits that are told to all tasks; more are joined by a shuffle.
REVISIT, BROADCAST_REVISITS = 1000, 100_000
VERSION, END = "WARC/1.1", "\r\n\r\n"
#: Where files are cut: a line that begins like a record. No two places can overlap, and no line of a header is like it.
_BETWEEN = "\nWARC/1."
_LEAD = len("WARC/1.")
_ID = "urn:x-page:"
#: When the records were made: the same in every run, as a task may be tried again.
DATE = "1970-01-01T00:00:00Z"
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")
_FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def revisits(pages: DataFrame, least: int = REVISIT) -> DataFrame:
    """(page_id, digest, keeper) of the rows whose payload another row with a larger page_id has."""
    rows = pages.where(F.col("size") >= least).groupBy("digest", "size", "page_id").agg(F.lit(1).alias("one"))
    best = rows.groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    return rows.join(best.select("digest", "size", "keeper"), ["digest", "size"]).where("page_id is null or page_id < keeper").select("page_id", "digest", "keeper")


def records(pages: DataFrame, least: int = REVISIT) -> DataFrame:
    """(record) of pages(page_id, url, html), each without the separator that follows it."""
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    again = common.written(revisits(rows.select("page_id", "digest", "size"), least), "warc-revisits")
    again = again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "keeper", F.lit(True).alias("revisit"))
    again = F.broadcast(again) if again.count() <= BROADCAST_REVISITS else again
    rows = rows.join(again, rows["page_id"].eqNullSafe(F.col("_id")) & (rows["digest"] == F.col("_digest")), "left")
    rows = rows.withColumn("revisit", F.coalesce("revisit", F.lit(False)))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), text("size"), F.lit(END))
    address = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat_ws(
        "\r\n", F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit(f"WARC-Record-ID: <{_ID}"), text("page_id"), F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), address), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Refers-To: <{_ID}"), text("keeper"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http; msgtype=response"),
    )
    block = F.when(F.col("revisit"), F.octet_length(http)).otherwise(F.octet_length(http) + F.col("size"))
    return rows.select(F.concat(head, F.lit("\r\nContent-Length: "), block.cast("string"), F.lit(END), http, F.when(F.col("revisit"), "").otherwise(F.col("html"))).alias("record"))


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT) -> None:
    records(pages, least).write.option("lineSep", END).text(folder)


def header(text: bytes) -> tuple[int, int] | None:
    """(bytes of a record's header with the empty line behind it, bytes of its block) of what follows `WARC/1.`."""
    stop = text.find(b"\r\n\r\n")
    if stop < 0 or text[:3] not in (b"0\r\n", b"1\r\n"):
        return None
    found = _LENGTH.search(text, 0, stop + 2)
    return (stop + 4, int(found[1])) if found else None


def parsed(text: bytes) -> tuple[int | None, int, str, str, int | None]:
    """The values of _FIELDS of one record, from what follows `WARC/1.` to the end of its block."""
    start, size = header(text)
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in text[:start].split(b"\r\n")[1:]) if k}
    number = lambda v: int(v) if (v := (v or b"").removeprefix(f"<{_ID}".encode()).removesuffix(b">")) else None
    kind = fields.get(b"warc-type", b"").decode()
    body = text[start : start + size]
    page, refers = number(fields.get(b"warc-record-id")), number(fields.get(b"warc-refers-to"))
    digest = fields.get(b"warc-payload-digest", b"").partition(b":")[2].decode().lower()
    http = body.find(b"\r\n\r\n") + 4
    if kind == "revisit":
        found = _LENGTH.search(body, 0, http)
        return page, int(found[1]) if found else 0, digest, kind, refers
    payload = body[http:] if http >= 4 else body
    own = hashlib.sha1(payload).hexdigest()
    if digest and own != digest:
        raise ValueError(f"record {page}: its payload has the digest {own}, not {digest}")
    return page, len(payload), own, kind, refers


def _chains(at: np.ndarray, follower: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exit, first, last) of the places of one part, in order, with their successors (-1: none).

    exit is where the chain from a place leaves the part, -1 if it breaks off; end is where the next part's first place
    would be, and a file's last record leads to one byte less. A place r is on the chain from e if
    first[r] <= first[e] <= last[r]: numbers by depth first search of the tree that successors make.
    """
    n = len(at)
    up = np.searchsorted(at, follower)
    inside = (up < n) & (follower >= 0) & (at[np.minimum(up, n - 1)] == follower) if n else np.zeros(0, bool)
    exit_, size = np.where(~inside & (follower >= end - 1), follower, -1), np.ones(n, np.int64)
    for i in range(n):  # successors lie behind, so all that points to a place has been seen before it
        if inside[i]:
            size[up[i]] += size[i]
    first, free = np.zeros(n, np.int64), np.zeros(n, np.int64)
    top = 0
    for i in range(n - 1, -1, -1):
        if inside[i]:
            first[i] = free[up[i]]
            free[up[i]] += size[i]
            exit_[i] = exit_[up[i]]
        else:
            first[i], top = top, top + size[i]
        free[i] = first[i] + 1
    return exit_, first, first + size - 1


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.option("lineSep", _BETWEEN).text(folder)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.col("value").cast("binary").alias("value"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(file, part, piece, place, text) of the pieces of each part, in order; places count from where its first text begins."""
    here, k, place = None, 0, 0
    for batch in batches:
        for file, part, text in zip(batch.column("file").to_pylist(), batch.column("part").to_pylist(), batch.column("value").to_pylist()):
            if here != (file, part):
                here, k, place = (file, part), 0, 0
            yield file, part, k, place, text
            k, place = k + 1, place + len(text) + len(_BETWEEN)


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each place where a record may begin, as a written table; places and successors count from its part's start."""
    names = ["file", "part", "piece", "place", "length", "follower", "exit", "first", "last", "whole", *(f.split()[0] for f in _FIELDS.split(", "))]
    schema = "file string, part long, piece long, place long, length long, follower long, exit long, first long, last long, whole boolean, " + _FIELDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def done() -> pa.RecordBatch:
            at, follower = (np.array([r[i] for r in rows], np.int64) for i in (3, 5))
            links = _chains(at, follower, rows[-1][3] + rows[-1][4] + len(_BETWEEN))
            columns = [*zip(*rows)]
            return pa.record_batch([*(pa.array(c) for c in columns[:6]), *(pa.array(c) for c in links), *(pa.array(c, t) for c, t in zip(columns[6:], (pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())))], names=names)

        for file, part, piece, place, text in _numbered(batches):
            if rows and rows[-1][:2] != (file, part):
                yield done()
                rows = []
            if part == 0 and piece == 0 and text.startswith(b"WARC/1."):  # nothing separates the first record
                text, length, place = text[_LEAD:], len(text), place + _LEAD
            else:
                length = len(text)
            found = header(text)
            need = sum(found) if found else 0
            # Two line ends follow a block; the last of their bytes is a part of the separator but at a file's end.
            whole = bool(found) and text[need:] in (b"\r\n\r", b"\r\n\r\n")
            follower = place + need + len(END) + _LEAD if found else -1
            rows.append((file, part, piece, place, len(text), follower, whole, *(parsed(text) if whole else (None,) * 5)))
        if rows:
            yield done()
        common.release()

    common.small_batches(spark)
    return common.written(_pieces(spark, folder).mapInArrow(run, schema), "warc-candidates")


def chained(found: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(file, part, base, entry): where in a part the chain from its file's start comes in, and the part's own start."""
    parts = found.groupBy("file", "part").agg(F.max(F.col("place") + F.col("length")).alias("end"))
    span = F.col("end") + len(_BETWEEN)
    before = Window.partitionBy("file").orderBy("part")  # one row for each part of a file
    parts = parts.withColumn("base", F.sum(span).over(before) - span).withColumn("bytes", F.sum(span).over(before) - len(_BETWEEN))
    parts = common.written(parts, "warc-parts")
    placed = found.join(parts.select("file", "part", "base"), ["file", "part"])
    out = placed.select("file", "part", (F.col("base") + F.col("place")).alias("at"), F.when(F.col("exit") >= 0, F.col("base") + F.col("exit")).alias("to"))
    goals = out.where("to is not null").select("file", F.col("to").alias("at")).distinct()
    starts = out.groupBy("file").agg(F.min("at").alias("at"))
    doors = common.written(out.join(goals.unionByName(starts).distinct(), ["file", "at"]), "warc-doors")
    jump = doors.select("file", "at", "to")
    reached = common.written(starts, "warc-reached")
    for _ in range(max_rounds):
        more = reached.join(jump, ["file", "at"]).join(doors.select("file", F.col("at").alias("to")), ["file", "to"], "left_semi").select("file", F.col("to").alias("at"))
        fresh = common.written(more.join(reached, ["file", "at"], "left_anti").distinct(), "warc-fresh")
        if fresh.isEmpty():
            break
        reached = common.written(reached.unionByName(fresh), "warc-reached")
        over = jump.select("file", F.col("at").alias("to"), F.col("to").alias("top"))
        jump = common.written(jump.join(over, ["file", "to"]).select("file", "at", F.col("top").alias("to")), "warc-jump")
    else:
        raise RuntimeError(f"chains did not end in {max_rounds} rounds")
    entries = reached.join(doors, ["file", "at"])
    ends = entries.groupBy("file").agg(F.max_by("to", "at").alias("end"), F.max("at").alias("at"))
    sizes = parts.groupBy("file").agg(F.max("bytes").alias("bytes"))
    # A chain ends where the next record's version would be.
    bad = sizes.join(ends, "file", "left").where(F.coalesce(F.col("end"), F.lit(-1)) != F.col("bytes") + _LEAD).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['file']}: its records don't lead to its end")
    own = entries.select("file", "part", F.col("at").alias("_at")).join(parts, ["file", "part"])
    return common.written(parts.select("file", "part", "base").join(own.select("file", "part", (F.col("_at") - F.col("base")).alias("entry")), ["file", "part"], "left"), "warc-entries")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """_FIELDS of every record of the archives in a folder."""
    found = candidates(spark, folder)
    parts = chained(found)
    entry = found.select("file", "part", F.col("place").alias("entry"), F.col("first").alias("number")).join(parts.where("entry is not null"), ["file", "part", "entry"]).select("file", "part", "number")
    marked = found.join(entry, ["file", "part"], "left").join(parts.select("file", "part", "base"), ["file", "part"])
    marked = marked.withColumn("real", F.coalesce(F.col("number").between(F.col("first"), F.col("last")), F.lit(False)))
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    whole = marked.where("real and whole").select(*names)
    broken = common.written(marked.where("real and not whole").select("file", (F.col("base") + F.col("place")).alias("record")), "warc-broken")
    if broken.isEmpty():
        return whole
    # Every piece belongs to the last record that begins at it or before, maybe in an earlier part of the file.
    pieces = marked.join(broken.select("file").distinct(), "file", "left_semi").select("file", "part", "piece", (F.col("base") + F.col("place")).alias("at"), "real")
    last = pieces.groupBy("file", "part").agg(F.max(F.when(F.col("real"), F.col("at"))).alias("at"))
    carried = F.last("at", ignorenulls=True).over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each part
    inside = Window.partitionBy("file", "part").orderBy("at")  # a part's own places
    owned = pieces.withColumn("record", F.last(F.when(F.col("real"), F.col("at")), ignorenulls=True).over(inside))
    owned = owned.join(last.select("file", "part", carried.alias("carried")), ["file", "part"]).withColumn("record", F.coalesce("record", "carried"))
    wanted = common.written(owned.join(broken, ["file", "record"], "left_semi").select("file", "part", "piece", "record"), "warc-wanted")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for file, part, piece, _, text in _numbered(batches):
            rows.append((file, part, piece, text))
            size += len(text)
            if size > 1 << 20:
                yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["file", "part", "piece", "value"])
                rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["file", "part", "piece", "value"])

    texts = _pieces(spark, folder).mapInArrow(number, "file string, part long, piece long, value binary")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_REVISITS else wanted
    joined = texts.join(few, ["file", "part", "piece"]).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("part", "piece", "value"))).alias("pieces"))  # one page's own bytes

    @F.pandas_udf(_FIELDS)
    def put_together(pieces: pd.Series) -> pd.DataFrame:
        rows = [parsed(_BETWEEN.encode().join(map(bytes, some)).removeprefix(b"WARC/1.")) for some in pieces]
        out = pd.DataFrame(rows, columns=names)
        return out.assign(**{c: out[c].astype("Int64") for c in ("page_id", "payload_bytes", "refers_to")})

    return whole.unionByName(joined.select(put_together("pieces.value").alias("r")).select("r.*"))


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = REVISIT) -> DataFrame:
    """_FIELDS of every page, read back from the archives that it writes to a folder."""
    spark = pages.sparkSession
    folder = folder or common.new_path(spark, "warc")
    write_archives(pages, folder, least)
    return read_archives(spark, folder)

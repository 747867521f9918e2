"""WARC archives: writing pages as response and revisit records, reading records back by boundary-chain verification.

A reader can't trust the magic "WARC/1." alone, since a payload may hold it. So tasks, each with a byte range of a file,
emit candidates: every place that has the magic at the start of a line, with a successor offset from its own header's
length. The candidates of a range are linked among themselves first, by pointer jumping, which tells for each the offset
where its chain leaves the range; offsets are made absolute by the sums of the ranges before. Then only the places
where chains enter ranges are linked across a file, by pointer jumping from offset 0: in every round each arc is
replaced by two of it, so a chain of n arcs takes log2(n) rounds. Each range keeps what is reached from its entry.
Magic inside a payload is never reached.

Ranges are Spark's own splits of text by the separator "\\r\\nWARC/1.", whose rows keep their bytes as they are. Headers
hold no empty line, so a row begins with a whole header, if with any; a payload that holds the separator goes on in
the rows behind, from which a second pass fetches the bytes that records reached are made of.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.llm.common import looked_up, new_path, written

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_MAGIC = b"WARC/1."
_SEPARATOR = "\r\nWARC/1."
_ID = "urn:page:"
_FIELD = re.compile(rb"\r\n([A-Za-z-]+): *([^\r\n]*)")


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of SHA-1: five hex digits give four letters, and 40 digits leave no rest."""
    digits = F.sha1(data)
    letters = []
    for i in range(8):
        n = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(_BASE32), F.shiftright(n, 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for j in (3, 2, 1, 0)]
    return F.concat(*letters)


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, least: int = 0) -> DataFrame:
    """pages with digest, bytes and refers_to: the smallest id among equal payloads of at least `least` bytes, else null.

    Only (id, digest, bytes) are shuffled to find equal payloads, as minima and counts on the map side. The pages stay
    where they are if the payloads found more than once are few enough to broadcast, counted first; else they are
    joined by digest, those of a frequent payload spread over many tasks.
    """
    keyed = pages.withColumn("bytes", F.octet_length(payload_col).cast("long")).withColumn("digest", base32_sha1(F.col(payload_col).cast("binary")))
    groups = keyed.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min(id_col).alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = written(groups.select(F.col("digest"), F.col("first")), "copies")
    found = looked_up(keyed, groups, "digest", groups.count())
    first = F.when((F.col("bytes") >= least) & ~F.col(id_col).eqNullSafe(F.col("first")), F.col("first"))
    return found.withColumn("refers_to", first).drop("first")


def record(id_: Column, url: Column, payload: Column, digest: Column, size: Column, refers_to: Column) -> Column:
    """A record without the two line ends that close it."""
    eol = F.lit("\r\n")
    address = F.translate(F.coalesce(url, F.lit("")), "\r\n", "")
    name = lambda x: F.concat(F.lit(f"<{_ID}"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), eol, eol)
    first = refers_to.isNull()
    block = F.when(first, F.concat(http, payload)).otherwise(http)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(first, F.lit("response")).otherwise(F.lit("revisit")), F.lit("\r\nWARC-Record-ID: "), name(id_),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), address, F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"), digest,
        F.when(first, F.lit("")).otherwise(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(refers_to))),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), eol, eol, block,
    )


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, file_bytes: int = 1 << 30) -> None:
    """Write a record per row into archives below path, of about file_bytes each or a task's rows, if those are less.

    Null payloads are empty, line ends in addresses are dropped, rows alike are a record each (with the smallest id of
    their payload all of them are responses); no rows give no records. Spark's text writer lays the records down, with
    the two line ends that close a record as its separator, so archives go wherever Spark can write.
    """
    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    keyed = with_revisits(slim, "id", "payload", least)
    total = slim.agg(F.sum(F.octet_length("payload") + F.coalesce(F.octet_length("url"), F.lit(0)) + 600).alias("b"), F.count("*").alias("n")).first()
    rows = max(1, int(file_bytes * total["n"] / total["b"])) if total["n"] else 1
    lines = keyed.select(record(F.col("id"), F.col("url"), F.col("payload"), F.col("digest"), F.col("bytes"), F.col("refers_to")).alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", rows).text(path)


def _page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").removeprefix(_ID)
    return int(tail) if re.fullmatch(r"-?\d+", tail) else None


def parsed(row: bytes, known: int) -> tuple[int, int, dict[str, str]] | None:
    """(where the block begins, where the next record would begin, fields) of a record whose magic's last `known` bytes
    come before row, both from the magic's first byte; None without a whole header and a length."""
    end = row.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {m[1].decode("ascii").lower(): m[2].decode("utf-8", "replace") for m in _FIELD.finditer(row, 0, end)}
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 16):
        return None
    block = known + end + 4
    return block, block + int(length) + 4, fields


def leaving(offsets: np.ndarray, successors: np.ndarray, end: int) -> np.ndarray:
    """Where each candidate's chain (offsets ascending) leaves a range that ends with the two bytes before `end`, by pointer
    jumping; -1 where it breaks off inside."""
    n = len(offsets)
    if not n:
        return np.zeros(0, dtype=np.int64)
    jump = np.searchsorted(offsets, successors)
    inside = successors < end - 2
    hit = inside & (jump < n) & (offsets[np.minimum(jump, n - 1)] == successors)
    out = np.where(inside, -1, successors)
    jump = np.where(hit, jump, np.arange(n))
    for _ in range(int(n).bit_length() + 1):
        jump = jump[jump]
    return out[jump]


def reachable(offsets: np.ndarray, successors: np.ndarray, start: int = 0) -> np.ndarray:
    """Which offsets (ascending) lie on the chain from offset `start`, by pointer jumping."""
    n = len(offsets)
    jump = np.searchsorted(offsets, successors)
    hit = (jump < n) & (offsets[np.minimum(jump, n - 1)] == successors) if n else np.zeros(0, dtype=bool)
    jump = np.append(np.where(hit, jump, n), n)  # the last place stands for the end
    reached = np.zeros(n + 1, dtype=bool)
    reached[:n] = offsets == start
    for _ in range(max(1, int(n).bit_length() + 1)):
        reached[jump[reached]] = True
        jump = jump[jump]
    return reached[:n]


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, value): the bytes between separators, in order within each range (path, block) of a file."""
    lines = spark.read.option("lineSep", _SEPARATOR).option("recursiveFileLookup", "true").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _range() -> Column:
    return F.concat_ws("#", F.col("block").cast("string"), "path").alias("range")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(path, block, at, known, row) of each row, with the two bytes behind it that the separator begins with (none are there
    at the end of a file): `at` is the offset in its range of the magic before it, of which `known` bytes are its
    separator's (none for the first row of a file, which holds its magic itself)."""
    key, at = None, 0
    for b in batches:
        for path, block, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if (path, block) != key:
                key, at = (path, block), 0
            known, row = 0 if at == block == 0 else len(_MAGIC), row + b"\r\n"
            yield path, block, at, known, row
            at += known + len(row)


_CANDIDATE = "path string, block long, at long, next long, leaves long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, body long"
_FOUND = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]


def _told(fields: dict[str, str], payload: bytes | None, http: bytes, keep: bool) -> tuple:
    """_FOUND of a record. Digest and size of a response are taken from its bytes, not its header."""
    if payload is not None:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    else:
        given = re.search(rb"Content-Length: *(\d+)", http)
        size, digest = int(given[1]) if given else 0, fields.get("warc-payload-digest", "").removeprefix("sha1:")
    return _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), fields.get("warc-type"), size, digest, _page(fields.get("warc-refers-to")), payload if keep else None


def _candidate(row: bytes, known: int, keep: bool) -> tuple | None:
    """(next, _FOUND..., body) from the magic's first byte. body is null where the row holds the whole record, else where its
    payload begins."""
    if not known and not row.startswith(_MAGIC):
        return None
    if (p := parsed(row, known)) is None:
        return None
    block, successor, fields = p
    whole = successor <= known + len(row)
    end = successor - 4 - known
    body = row.find(b"\r\n\r\n", block - known, end if whole else len(row)) + 4
    response = fields.get("warc-type") == "response"
    if whole or not response:
        return (successor, *_told(fields, row[body:end] if response else None, row[block - known : body], keep), None)
    return (successor, *_told(fields, b"", b"", False), known + body)


def _candidates(spark: SparkSession, path: str, keep: bool) -> DataFrame:
    """Candidates of every range, and one row a range, whose `next` is null and whose `at` is where the range ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, end = None, [], 0
        for name, block, at, known, row in _ranges(batches):
            if (name, block) != key:
                if key:
                    yield from _linked(key, rows, end)
                key, rows = (name, block), []
            if found := _candidate(row, known, keep):
                rows.append((at, at + found[0], *found[1:]))
            end = at + known + len(row)
        if key:
            yield from _linked(key, rows, end)

    return _rows(spark, path).mapInArrow(run, _CANDIDATE)


def _linked(key: tuple[str, int], rows: list[tuple], end: int) -> Iterator[pa.RecordBatch]:
    offsets, successors = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1))
    leaves = leaving(offsets, successors, end).tolist()
    out = [(*key, *r[:2], x, *r[2:]) for r, x in zip(rows, leaves, strict=True)]
    out.append((*key, end, None, None, *[None] * (len(_FOUND) + 1)))
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names = [f.split() for f in _CANDIDATE.split(", ")]
    for i in range(0, len(out), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out[i : i + 2000], strict=True), names, strict=True)], names=[n for n, _ in names])


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record reached: path, offset, page_id, url, record_type, payload_bytes, payload_digest, refers_to, and
    payload if asked for (null for revisits).

    Files of any size, plain or compressed with a suffix that Spark knows (one member a record or one for all), of
    which only plain ones are read in ranges. Empty files give no rows; it is an error if the chain of any other
    doesn't end at its last byte. A task holds the candidates of a range (with payloads, their bytes) and a record.
    """
    found = written(_candidates(spark, path, payloads), "candidates")
    ends = found.filter("next is null").select("path", "block", F.col("at").alias("size"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # sizes count the two bytes of the separator behind each range, and nothing is behind the last
    bases = ends.select(_range(), "path", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), (F.sum("size").over(Window.partitionBy("path")) - 2).alias("last"))
    bases = written(bases, "ranges")
    n_ranges = bases.count()
    placed = found.filter("next is not null").withColumn("range", _range()).drop("path", "block")
    placed = looked_up(placed, bases, "range", n_ranges, "inner").withColumns({"at": F.col("at") + F.col("base"), "next": F.col("next") + F.col("base")})
    nodes = placed.select("path", "range", "at", "next", F.when(F.col("leaves") >= 0, F.col("leaves") + F.col("base")).otherwise(-1).alias("leaves"))
    # chains enter ranges at few places: where others leave, and at the start
    doors = nodes.select("path", F.col("leaves").alias("at")).union(bases.select("path", F.lit(0).cast("long"))).distinct()
    arcs = nodes.select("path", "range", "at", "leaves").join(doors, ["path", "at"]).select("path", "range", "at", "leaves")
    arcs = arcs.union(bases.groupBy("path").agg(F.max("last").alias("at")).select("path", F.lit(""), "at", F.lit(-1).cast("long")))

    def entries(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        keep = reachable(t["at"].to_numpy(), t["leaves"].to_numpy())
        if not keep[-1]:
            raise ValueError(f"the records of {t['path'][0]} don't end at its last byte")
        return t.filter(pa.array(keep)).slice(0, int(keep.sum()) - 1).select(["range", "at"])

    entered = written(arcs.groupBy("path").applyInArrow(entries, "range string, at long"), "entries")  # errors show here

    def verify(t: pa.Table, entry: pa.Table) -> pa.Table:
        if not entry.num_rows or not t.num_rows:
            return t.slice(0, 0).select(["range", "at"])
        t = t.sort_by("at")
        return t.filter(pa.array(reachable(t["at"].to_numpy(), t["next"].to_numpy(), entry["at"][0].as_py()))).select(["range", "at"])

    kept = nodes.select("range", "at", "next").groupBy("range").cogroup(entered.groupBy("range")).applyInArrow(verify, "range string, at long")
    records = written(placed.join(kept, ["range", "at"]).select("path", F.col("at").alias("offset"), "next", *_FOUND, "body"), "records")
    whole = records.filter("body is null").select("path", "offset", *_FOUND)
    parted = records.filter("body is not null")
    if parted.limit(1).count():
        whole = whole.unionByName(_fetched(spark, path, parted, bases, n_ranges, payloads))
    return whole if payloads else whole.drop("payload")


def _fetched(spark: SparkSession, path: str, parted: DataFrame, bases: DataFrame, n_ranges: int, keep: bool) -> DataFrame:
    """The records of parted, whose payloads hold separators, from the rows that they span."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block, at, known, row in _ranges(batches):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([at], pa.int64()), pa.array([_MAGIC[:known] + row], pa.binary())], names=["path", "block", "at", "row"])

    rows = _rows(spark, path).mapInArrow(numbered, "path string, block long, at long, row binary")
    rows = looked_up(rows.withColumn("range", _range()).drop("path", "block"), bases, "range", n_ranges, "inner").select("path", (F.col("at") + F.col("base")).alias("at"), "row")
    # rows and records meet by stretches of 64 KiB, so a file's many rows aren't each held against its many records
    rows = rows.withColumn("stretch", F.shiftright("at", 16))
    spans = parted.select("path", "offset", "next", "body", *_FOUND[:-1], F.explode(F.sequence(F.shiftright("offset", 16), F.shiftright(F.col("next") - 1, 16))).alias("stretch"))
    parts = rows.join(spans, ["path", "stretch"]).filter("at >= offset and at < next")

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        first = {c: t[c][0].as_py() for c in ("path", "offset", "next", "body", *_FOUND[:-1])}
        payload = b"".join(t["row"].to_pylist())[first["body"] : first["next"] - 4 - first["offset"]]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        told = {**{c: first[c] for c in ("path", "offset", *_FOUND[:-1])}, "payload_bytes": len(payload), "payload_digest": digest, "payload": payload if keep else None}
        return pa.table({c: pa.array([v], k) for (c, v), k in zip(told.items(), _KINDS, strict=True)})

    kind = "path string, offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return parts.groupBy("path", "offset").applyInArrow(join, kind)


_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to new archives in the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least=least)
    return read_archives(pages.sparkSession, path)

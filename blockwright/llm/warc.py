"""WARC archives: writing with revisit records, reading by boundary chains.

Writing turns each page into a record (header, HTTP head, payload; a revisit has
no payload) and stores the records with Spark's own text writer, whose line
separator is the blank line that ends a record.  The archives are plain files in
a folder that the cluster shares, so that Spark can split them.  Payloads are
compressed while they travel.

Reading scans the splits of the archives for the magic that starts a record.  Every place
with the magic is only a *candidate*: a task emits its offset and, from its
header, the offset of its successor.  A payload may hold the magic too, so
starting at offset 0 of the file, pointer jumping over successors keeps the
candidates that are reachable and drops the others.  A task first follows
pointers inside its split, which leaves one exit per candidate; jumping then
doubles over the splits of a file.
Digests and lengths are computed from the bytes while they stream by.  A
reachable record that runs past its split (its payload holds the magic, and a
border lies behind it) is put together from the lines of the splits that it
covers, in a second pass over these splits, which hashes them in their order.  A task
holds no archive; the longest it holds at once is the text between two magics.

Edge cases: a null html is an empty payload; repeated pages give a record each,
and of equal rows with the largest id each is a response; line breaks in a url
are escaped in its header; an empty table gives no archive and no rows; extra
columns are ignored.  An archive that ends inside a reachable record raises, naming the file.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockwright.llm import _text
from blockwright.llm._session import checkpoint, new_folder, ship, shuffles_go

MAGIC = "WARC/1.1\r\n"
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _digests(batches: Iterator[pa.RecordBatch], packed: bool) -> Iterator[pa.RecordBatch]:
    """Size and digest of each payload; on request url and packed payload too."""
    for batch in batches:
        bodies = [t or b"" for t in batch.column("html").cast(pa.binary()).to_pylist()]
        sizes = pa.array(list(map(len, bodies)), pa.int64())
        columns = [batch.column("page_id"), sizes, pa.array(list(map(base32_sha1, bodies)), pa.string())]
        if packed:
            columns += [batch.column("url"), pa.array([zlib.compress(b, 1) for b in bodies], pa.binary())]
        yield pa.record_batch(columns, names=["page_id", "payload_bytes", "payload_digest", "url", "packed"][: len(columns)])


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Type of each page's record: of equal payloads of at least ``least_bytes``
    the one with the largest id is the response and the others revisit it."""
    ship(pages.sparkSession)
    own = "page_id long, payload_bytes long, payload_digest string"
    rows = pages.select("page_id", "url", "html").mapInArrow(_text.frees(functools.partial(_digests, packed=True)), f"{own}, url string, packed binary")
    narrow = pages.select("page_id", "html").mapInArrow(_text.frees(functools.partial(_digests, packed=False)), own)
    groups = narrow.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
    joined = rows.join(groups.where("_n > 1").drop("_n"), ["payload_digest", "payload_bytes"], "left")
    return joined.withColumn("refers_to", F.when(F.col("_last") != F.col("page_id"), F.col("_last"))).drop("_last")


def _record(page: int | None, url: str | None, size: int, digest: str, packed: bytes, refers: int | None) -> bytes:
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    block = HEAD.encode() + (b"" if refers is not None else zlib.decompress(packed))
    lines = [
        MAGIC, f"WARC-Type: {'response' if refers is None else 'revisit'}\r\n", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>\r\n", f"WARC-Date: {DATE}\r\n", f"WARC-Target-URI: {url}\r\n",
        "" if refers is None else f"WARC-Profile: {REVISIT}\r\nWARC-Refers-To: <urn:page:{refers}>\r\n", f"WARC-Payload-Digest: sha1:{digest}\r\n", f"Payload-Length: {size}\r\n",
        "Content-Type: application/http;msgtype=response\r\n", f"Content-Length: {len(block)}\r\n\r\n",
    ]
    return "".join(lines).encode() + block


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "payload_bytes", "payload_digest", "packed", "refers_to"))
        yield pa.record_batch([pa.array([_record(*row) for row in zip(*columns, strict=True)], pa.binary()).cast(pa.string())], names=["value"])


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, compression: str = "none") -> None:
    """One archive per task that has rows."""
    records = plan_records(pages, least_bytes).mapInArrow(_text.frees(_records), "value string")
    with shuffles_go(pages.sparkSession):
        records.select("*").write.option("lineSep", "\r\n\r\n").option("compression", compression).text(folder)


class _Open:
    """A candidate whose block is still streaming by."""

    def __init__(self, offset: int, body: bytes):
        self.offset, self.fields, self.next, self.block, self.size = offset, {}, None, None, 0
        self.head, self.sha, self.payload_bytes, self.in_payload = b"", hashlib.sha1(usedforsecurity=False), 0, False
        end = body.find(b"\r\n\r\n")
        self.left = 0
        if end < 0:
            return
        for line in body[:end].split(b"\r\n"):
            name, colon, value = line.partition(b":")
            if colon:
                self.fields[name.strip().lower()] = value.strip()
        size = self.fields.get(b"content-length", b"")
        if not size.isdigit() or b"warc-type" not in self.fields:
            return
        self.size = self.left = int(size)
        self.block = offset + len(MAGIC) + end + 4
        self.next = self.block + self.left + 4
        self.feed(body[end + 4 :])

    def feed(self, data: bytes) -> None:
        data = data[: self.left]
        self.left -= len(data)
        if not self.in_payload:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            data, self.head, self.in_payload = self.head[end + 4 :], self.head[: end + 4], True
        self.sha.update(data)
        self.payload_bytes += len(data)

    def row(self) -> dict:
        text = lambda name: self.fields.get(name, b"").decode("utf-8", "replace") or None
        return {
            "off": self.offset, "next": self.next, "block": self.block, "size": self.size, "complete": not self.left, "type": text(b"warc-type"), "id": text(b"warc-record-id"), "refers": text(b"warc-refers-to"),
            "digest": text(b"warc-payload-digest"), "claimed": text(b"payload-length"), "payload_bytes": self.payload_bytes, "sha1": base64.b32encode(self.sha.digest()).decode(),
        }


_CANDIDATE = pa.schema([
    ("file", pa.string()), ("split", pa.int64()), ("covered", pa.int64()), ("off", pa.int64()), ("next", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("complete", pa.bool_()), ("type", pa.string()), ("id", pa.string()),
    ("refers", pa.string()), ("digest", pa.string()), ("claimed", pa.string()), ("payload_bytes", pa.int64()), ("sha1", pa.string()),
])
_DDL = "file string, split long, covered long, off long, next long, block long, size long, complete boolean, type string, id string, refers string, digest string, claimed string, payload_bytes long, sha1 string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each split, offsets relative to its first line, and a last
    row per split with the bytes that its lines cover."""
    key, at, still, rows = None, 0, [], []
    magic = MAGIC.encode()

    def flush(final: bool) -> list[dict]:
        nonlocal rows, still
        if final:
            rows += [c.row() for c in still]
            still = []
            if key is not None:
                rows.append({"covered": at})
        out, rows = [r | {"file": key[0], "split": key[1]} for r in rows], []
        return out

    for batch in batches:
        out: list[dict] = []
        for file, split, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            line = value.as_py()
            if (file, split) != key:
                if key is not None:
                    out += flush(True)
                key, at = (file, split), 0
            if at or split:  # the magic stands before each line but the first of a file
                for c in still:
                    c.feed(magic)
                    c.feed(line)
                done = [c for c in still if not c.left]
                rows += [c.row() for c in done]
                still = [c for c in still if c.left]
                one = _Open(at - len(magic), line)
                if one.next is not None:
                    if one.left:
                        still.append(one)
                    else:
                        rows.append(one.row())
            at += len(line) + len(magic)
        if key is not None:
            out += flush(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_CANDIDATE)
    if key is not None:
        yield pa.RecordBatch.from_pylist(flush(True), schema=_CANDIDATE)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line, with the magic before it, and its offset from the split's first line."""
    key, at, magic = None, 0, MAGIC.encode()
    for batch in batches:
        offsets, values = [], []
        for file, split, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if (file, split) != key:
                key, at = (file, split), 0
            lead = magic if at or split else b""  # none before the first line of a file
            offsets.append(at - len(lead))
            values.append(lead + value)
            at += len(value) + len(magic)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(offsets, pa.int64()), pa.array(values, pa.binary())], names=["file", "split", "at", "value"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and digest of the payloads whose lines arrive in order."""
    key, open_ = None, None

    def close() -> tuple:
        if open_.left:
            raise ValueError(f"{key[0]} ends inside the record at {key[1]}")
        return *key, open_.payload_bytes, base64.b32encode(open_.sha.digest()).decode()

    for batch in batches:
        out = []
        for file, off, block, size, at, value in zip(*(batch.column(c).to_pylist() for c in ("file", "off", "block", "size", "at", "value")), strict=True):
            if (file, off) != key:
                if key is not None:
                    out.append(close())
                key, open_ = (file, off), _Open(off, b"")
                open_.left = size
            open_.feed(value[max(0, block - at) :])
        yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["file", "off", "payload_bytes", "sha1"])
    if key is not None:
        yield pa.record_batch([pa.array([x], t) for x, t in zip(close(), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "off", "payload_bytes", "sha1"])


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def candidates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Every place with the magic and a header, with absolute offsets; and the
    offset of the first line of each split."""
    found = checkpoint(_lines(ship(spark), folder).mapInArrow(_text.frees(_scan), _DDL))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    covered = found.where("covered IS NOT NULL").select("file", "split", "covered", F.coalesce(F.sum("covered").over(before), F.lit(0)).alias("base"))
    rows = found.where("covered IS NULL").drop("covered").join(covered, ["file", "split"])
    return rows.withColumns({c: F.col(c) + F.col("base") for c in ("off", "next", "block")}).drop("base", "covered"), covered


def _exits(key, group):
    """Inside a split: the offset at which the chain of each candidate leaves it."""
    import pandas as pd

    nxt = dict(zip(group["off"], group["next"], strict=True))
    leave: dict[int, int] = {}
    for off in sorted(nxt, reverse=True):
        leave[off] = leave.get(nxt[off], nxt[off])
    return pd.DataFrame({"file": key[0], "off": list(leave), "jump": list(leave.values())})


def _chain(key, group):
    """Inside a split: the candidates on the chain from its entry."""
    nxt = dict(zip(group["off"], group["next"], strict=True))
    at, on = int(group["entry"].iloc[0]), set()
    while at in nxt:
        on.add(at)
        at = nxt[at]
    return group[group["off"].isin(on)].drop(columns=["entry"])


def reachable(found: DataFrame) -> DataFrame:
    """The candidates on the chain from the start of their file."""
    narrow = found.select("file", "split", "off", "next")
    jumps = checkpoint(narrow.groupBy("file", "split").applyInPandas(_exits, "file string, off long, jump long"))
    entries = jumps.where("off = 0").select("file", "off")
    splits = found.groupBy("file").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).head()[0] or 1
    reach, hop = entries, jumps
    for _ in range(max(0, splits - 1).bit_length()):
        ahead = reach.join(hop, ["file", "off"]).select("file", F.col("jump").alias("off"))
        reach = checkpoint(reach.union(ahead.join(jumps.select("file", "off"), ["file", "off"], "left_semi")).distinct())
        twice = hop.select("file", F.col("off").alias("_from"), F.col("jump").alias("off")).join(hop, ["file", "off"])
        hop = checkpoint(twice.select("file", F.col("_from").alias("off"), "jump"))
    entry = narrow.join(reach, ["file", "off"], "left_semi").groupBy("file", "split").agg(F.min("off").alias("entry"))
    on = narrow.join(entry, ["file", "split"]).groupBy("file", "split").applyInPandas(_chain, "file string, split long, off long, next long")
    return found.join(on.select("file", "off"), ["file", "off"], "left_semi")


def _over_borders(spark: SparkSession, folder: str, records: DataFrame, splits: DataFrame) -> DataFrame:
    """Length and digest of the reachable records that run past their split.  They
    do not overlap, so a split has the lines of a few of them at most."""
    open_ = records.where(~F.col("complete")).select("file", "off", "block", "size")
    met = open_.join(splits, "file").where(f"base - {len(MAGIC)} < block + size AND base + covered > block")
    lines = _lines(spark, folder).mapInArrow(_text.frees(_chunks), "file string, split long, at long, value binary")
    parts = lines.join(met, ["file", "split"]).withColumn("at", F.col("at") + F.col("base")).where("at < block + size AND at + length(value) > block")
    ordered = parts.select("file", "off", "block", "size", "at", "value").repartition("file", "off").sortWithinPartitions("file", "off", "at")
    whole = ordered.mapInArrow(_text.frees(_joined), "file string, off long, payload_bytes long, sha1 string")
    return records.where(~F.col("complete")).drop("payload_bytes", "sha1").join(whole, ["file", "off"]).select(records.columns)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a folder of archives: id, type, reference and digest."""
    found, splits = candidates(spark, folder)
    records = checkpoint(reachable(found))
    if not records.where(~F.col("complete")).isEmpty():
        records = records.where("complete").unionByName(_over_borders(spark, folder, records, splits))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    revisit = F.col("type") == "revisit"
    return records.select(
        F.expr("try_cast(regexp_extract(id, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)").alias("page_id"),
        F.when(revisit, F.col("claimed").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_extract("digest", "^sha1:(.*)$", 1)).otherwise(F.col("sha1")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, number("refers").cast("long")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages as archives and read them back."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archives(pages, folder, least_bytes)
    return read_archives(spark, folder)

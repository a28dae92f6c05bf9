"""WARC archives of pages, read back and indexed by an external merge.

Writing: one record a page. Records are composed by SQL functions and written by
Spark's text writer with CRLF CRLF between them, which is how WARC records end, so
that the commit protocol of any Hadoop file system holds. Each file is gzipped and
so read by one task, in order. Reading: the stream of a file is put together
again and cut by Content-Length alone, whatever a payload holds; digests of
responses are checked.

Of records with equal payloads of at least REVISIT bytes the one with the largest
page_id is the response; others are revisits without a payload.

Index: the captures of each read task are sorted by (URL key, time, page_id) into a
run. Runs are dealt by ranges of that key, a hot URL being split by time; each
range's pieces meet in a loser tree, k ways; ranges in order make the whole order,
and `position` is a capture's place in it.

Cases: a null html is an empty payload, and so a response. A null page_id has no
X-Page-Id, comes back as null, never is the largest and refers like any other. A
null url has no target URI and the empty URL key. Rows that repeat the largest
page_id of a group are all responses, so ties need no order. White space in a URL is percent-coded.
Very long pages are one record each, whole. An empty table gives archives without records
and an empty index. Other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

REVISIT = 1000
RECORDS_PER_FILE = 50_000
END = "\r\n\r\n"
EPOCH = 1_704_067_200  # captures are dated page_id seconds from 2024-01-01 where pages has no column captured_at
SCHEMA = "page_id long, url string, ts long, record_type string, payload_bytes long, payload_digest string, refers_to long, urlkey string, file string, offset long"


def records(pages: DataFrame) -> DataFrame:
    """A WARC record in each row's `value`."""
    when = F.coalesce(F.unix_seconds(F.col("captured_at").cast("timestamp")), F.lit(EPOCH)) if "captured_at" in pages.columns else F.lit(EPOCH) + F.coalesce(F.pmod(F.col("page_id").cast("long"), F.lit(10**9)), F.lit(0))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), r"\r", "%0D"), r"[\s\x00-\x1f]", "%20").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"), when.alias("ts"))
    base = base.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    same = base.where(F.col("size") >= REVISIT).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    full = base.join(same.select("digest", "size", "first"), ["digest", "size"], "left")
    revisit = F.expr("first is not null and not (page_id <=> first)")
    hex32 = lambda c: F.md5(F.concat_ws("/", F.lit("record"), F.coalesce(c.cast("string"), F.lit("null")), "digest"))
    uuid = lambda c: F.regexp_replace(hex32(c), "(.{8})(.{4})(.{4})(.{4})(.{12})", "<urn:uuid:$1-$2-$3-$4-$5>")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    value = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", uuid(F.col("page_id"))), line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), line("X-Payload-Length", F.col("size")), line("X-Page-Id", F.col("page_id")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", uuid(F.col("first"))), line("X-Refers-To-Page", F.col("first")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )
    return full.select(value.alias("value"))


def write_archives(spark: SparkSession, pages: DataFrame, path: str) -> None:
    """Gzipped archives *.warc.gz under path."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        records(pages).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    fs, root = C._fs(spark, path)
    for status in fs.listStatus(root):  # names only
        name = status.getPath().getName()
        if name.endswith(".txt.gz"):
            fs.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(root, name.removesuffix(".txt.gz") + ".warc.gz"))


def url_key(url: str | None) -> str:
    """The host's parts from the last, then path and query; scheme, www and fragment don't count."""
    if not url:
        return ""
    try:
        s = urlsplit(url if "://" in url else f"http://{url}")
        host = (s.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (s.path or "/").lower() + (f"?{'&'.join(sorted(s.query.lower().split('&')))}" if s.query else "")


def parse(chunks: Iterator[bytes], open_end: bool = False) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records of a stream of bytes; with open_end, the last one may lack the CRLF CRLF behind it."""
    buffer, at, offset = bytearray(), 0, 0
    head = None

    for piece in chunks:
        buffer += piece
        while True:
            if head is None:
                end = buffer.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                lines = buffer[at:end].decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no record at {offset + at}: {lines[0][:60]!r}")
                head = dict(line.split(": ", 1) for line in lines[1:]) | {"": str(end + 4)}
            start = int(head[""])
            stop = start + int(head["Content-Length"])
            if len(buffer) < stop + 4:
                break
            yield offset + at, head, bytes(buffer[start:stop])
            head, at = None, stop + 4
            if at > 1 << 20:
                del buffer[:at]
                offset, at = offset + at, 0
    if open_end and head is not None and len(buffer) == stop:
        yield offset + at, head, bytes(buffer[start:stop])
    elif head is not None or at != len(buffer):
        raise ValueError("the archive ends inside a record")


def _capture(file: str, offset: int, head: dict[str, str], block: bytes) -> tuple:
    kind = head["WARC-Type"]
    size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{file}: the payload at {offset} isn't what was written")
    number = lambda name: int(head[name]) if name in head else None
    ts = int(datetime.strptime(head["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp())
    url = head.get("WARC-Target-URI")
    return number("X-Page-Id"), url, ts, kind, size, digest, number("X-Refers-To-Page"), url_key(url), file, offset


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(x.split(" ") for x in SCHEMA.split(", ")), strict=True)
    types = [pa.int64() if k == "long" else pa.string() for k in kinds]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments between CRLF CRLF, file by file and in order, to captures.

    Spark doesn't tell whether a file's last segment had a CRLF CRLF behind it, so each stands before the next segment.
    """
    rows: list[tuple] = []

    def segments() -> Iterator[tuple[str, bytes]]:
        last = None
        for b in batches:
            files = b.column("file")
            for i, v in enumerate(b.column("value")):
                file = files[i].as_py()
                yield file, (END.encode() if file == last else b"") + v.as_py().encode()
                last = file

    stream = segments()
    ahead = next(stream, None)
    while ahead is not None:
        file = ahead[0]

        def one(file: str = file) -> Iterator[bytes]:
            nonlocal ahead
            while ahead is not None and ahead[0] == file:
                yield ahead[1]
                ahead = next(stream, None)

        for offset, head, block in parse(one(), open_end=True):
            rows.append(_capture(file, offset, head, block))
            if len(rows) == 4096:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures in the archives under path."""
    C.bound_batches(spark)
    lines = spark.read.option("lineSep", END).text(path).select("value", F.col("_metadata.file_name").alias("file"))
    return lines.mapInArrow(_read, SCHEMA)


def loser_tree(runs: list[list]) -> Iterator:
    """Merges sorted lists k ways: each inner node keeps the loser of its match, and a match is played on the way up only."""
    k = len(runs)
    if not k:
        return
    at, tree = [0] * k, [-1] * k

    def before(a: int, b: int) -> bool:
        if at[a] == len(runs[a]) or at[b] == len(runs[b]):
            return at[a] < len(runs[a])
        x, y = runs[a][at[a]], runs[b][at[b]]
        return x < y or (x == y and a < b)

    def play(i: int) -> int:
        node = (i + k) // 2
        while node > 0:
            if tree[node] < 0:
                tree[node] = i
                return -1
            if before(tree[node], i):
                tree[node], i = i, tree[node]
            node //= 2
        return i

    winner = -1
    for i in range(k):
        w = play(i)
        winner = w if w >= 0 else winner
    while at[winner] < len(runs[winner]):
        yield runs[winner][at[winner]]
        at[winner] += 1
        winner = play(winner)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of all runs: the runs' pieces are put in order of their own numbers and merged."""
    held = list(batches)
    full = pa.Table.from_batches(held) if held else None
    if full is None or not full.num_rows:
        return
    part = TaskContext.get().partitionId()
    run, seq = full.column("run").to_numpy(), full.column("seq").to_numpy()
    order = np.lexsort((seq, run))
    keys = list(zip(*(full.column(c).to_pylist() for c in ("urlkey", "ts")), [-(2**63) if p is None else p for p in full.column("page_id").to_pylist()], full.column("file").to_pylist(), full.column("offset").to_pylist(), range(full.num_rows), strict=True))
    cuts = np.flatnonzero(np.diff(run[order])) + 1
    merged = [key[-1] for key in loser_tree([[keys[i] for i in piece] for piece in np.split(order, cuts)])]
    out = full.drop_columns(["run", "seq"]).take(pa.array(merged))
    out = out.append_column("part", pa.array(np.full(len(merged), part, np.int32))).append_column("idx", pa.array(np.arange(len(merged))))
    yield from out.to_batches(max_chunksize=4096)


def index(scratch: C.Scratch, captures: DataFrame) -> DataFrame:
    """captures and position: their place by (urlkey, ts, page_id, file, offset)."""
    key = ["urlkey", "ts", "page_id", "file", "offset"]
    runs = captures.sortWithinPartitions(*key).withColumn("id", F.monotonically_increasing_id())
    runs = scratch.save(runs.withColumns({"run": F.shiftright("id", 33), "seq": F.col("id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("id"), "runs")
    merged = scratch.save(runs.repartitionByRange(*key).mapInArrow(_merge, f"{SCHEMA}, part int, idx long"), "merged")
    scratch.drop("runs")
    counts = sorted(merged.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each range
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = scratch.spark.createDataFrame(starts, "part int, start long")
    return merged.join(F.broadcast(offsets), "part").withColumn("position", F.col("start") + F.col("idx")).drop("part", "idx", "start")


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, and urlkey, ts, file, offset, position: a row for each record read back."""
    scratch = C.Scratch(spark, "warc")
    path = f"{scratch.root}/archives"
    write_archives(spark, C.table(spark, sf_dir, "pages"), path)
    found = index(scratch, read_archives(spark, path))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts", "file", "offset", "position")

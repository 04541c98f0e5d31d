"""WARC archives of pages, and one ordered index over them by external merge.

Writing: each page is a record; of equal payloads of at least `least_bytes` the page with the smallest id is a
response, the others are revisits that name it. Records end with two line ends, so Spark's text writer with that
separator writes them as valid WARC files, compressed as a whole, into the given folder of any file system that Spark can write. Pages
of like length share archives, so that their rows bound their bytes; a page's html crosses the network once, and copies of one
page are dealt over several tasks.

Reading: the files come back as binary rows and are parsed by Content-Length; digests are taken from the payload
again and compared. Each file's captures, sorted by URL key, time and id, are a run.

Merging: splitters from a bounded sample cut the key space into ranges; each run is cut at the splitters, and the
pieces of all runs that fall into one range are merged by a loser tree. Ranges follow one another, so the whole is
ordered. A URL with very many captures is cut by time.

Offsets and lengths of the index are places in the uncompressed archive.

Null html is an empty payload, a null URL has the empty key and no Target-URI, null ids come first and are written without their field. Repeated
rows are records of their own, with one Record-ID. Other columns are ignored, unless one is named as the capture time; where that is null the time of pages without one is used. An empty table gives no files' records and no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END = "\r\n"
#: Shelves of archives: pages of more than so many bytes, rows of an archive at most. A longer page than the last has an archive's bytes in view.
SHELVES = ((-1, 2000), (32 << 10, 64), (1 << 20, 0))
ARCHIVE_BYTES = 64 << 20
#: Keys that the driver sees to choose the splitters.
SPLIT_SAMPLE = 10_000
#: Captures of a range on average.
RANGE_ROWS = 50_000
#: First capture time where pages have none: an id's seconds are added to it.
EPOCH = "2024-01-01T00:00:00Z"


def repeats(digested: DataFrame, least_bytes: int) -> DataFrame:
    """(payload_digest, first_id, n) of payloads that several pages have."""
    long_enough = digested.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
    return common.written(long_enough.agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeats")


def with_records(digested: DataFrame, first: DataFrame) -> DataFrame:
    """digested pages with record_type and refers_to."""
    joined = common.salted_join(digested, first, "payload_digest", "n", F.xxhash64("page_id", "url"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id"))).drop("first_id")


def fields(*pairs: tuple[str, Column]) -> Column:
    """Header lines; a field with a null value is left out."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit("")) for name, value in pairs))


def write(pages: DataFrame, path: str, least_bytes: int = 100, captured: str | None = None) -> None:
    """Write pages (page_id, url, html) as WARC files. captured: the column that has the time of capture."""
    usual = F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 31)))
    time = F.coalesce(F.col(captured).cast("timestamp"), usual) if captured else usual
    given = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    digested = given.withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    first = repeats(digested, least_bytes)
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    ends = [least for least, _ in SHELVES[1:]] + [None]
    for (more_than, rows), most in zip(SHELVES, ends, strict=True):
        if more_than < longest:
            shelf = digested.where((F.col("payload_bytes") > more_than) & (F.lit(True) if most is None else F.col("payload_bytes") <= most))
            write_records(with_records(shelf, first), path, rows or max(1, ARCHIVE_BYTES // longest))


def write_records(records: DataFrame, path: str, file_rows: int) -> None:
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    block = F.when(F.col("record_type") == "response", F.concat(http, F.col("html"))).otherwise(http)
    identity = lambda id_: F.concat(F.lit("<urn:page:"), id_.cast("string"), F.lit(">"))
    head = fields(
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.coalesce(identity(F.col("page_id")), F.lit("<urn:page:unknown>"))), ("WARC-Date", F.col("date")), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))), ("WARC-Refers-To", identity(F.col("refers_to"))),
        ("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("X-Payload-Length", F.col("payload_bytes")), ("X-Page-ID", F.col("page_id")), ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(block)),
    )
    text = records.select(F.concat(F.lit("WARC/1.1" + END), head, F.lit(END), block).alias("value"))
    text.write.mode("append").option("lineSep", END + END).option("maxRecordsPerFile", file_rows).option("compression", "gzip").text(path)


def url_key(url: str | None) -> str:
    """Host from its end, then path and query, in lower case: captures of a site stand together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    return (",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def parse(data: bytes) -> Iterator[dict]:
    """The records of an archive: fields, offset, length and payload."""
    at = 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        lines = data[at : body - 4].decode("utf-8").split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        found = dict(line.split(": ", 1) for line in lines[1:])
        end = body + int(found["Content-Length"])
        payload = data[data.index(b"\r\n\r\n", body, end) + 4 : end]
        yield {"fields": found, "offset": at, "length": end - at, "payload": payload}
        at = end + 4


ENTRY = pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
ENTRY_DDL = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def order(e: tuple) -> tuple:
    """Sort key of an entry: URL key, time, id (null first), place."""
    return e[0], e[1], e[2] is not None, e[2] or 0, e[7], e[8]


def entry(archive: str, r: dict) -> tuple:
    f = r["fields"]
    digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
    if f["WARC-Type"] == "response":
        size, own = len(r["payload"]), hashlib.sha256(r["payload"]).hexdigest()
        if own != digest:
            raise ValueError(f"{archive}, byte {r['offset']}: payload digest {own} where {digest} is named")
    else:
        size = int(f["X-Payload-Length"])
    number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">")) if x is not None else None
    return url_key(f.get("WARC-Target-URI")), f["WARC-Date"], number(f.get("X-Page-ID")), size, digest, f["WARC-Type"], number(f.get("WARC-Refers-To")), archive.rsplit("/", 1)[-1], r["offset"], r["length"]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of the archives under path, each archive's in order: one run for each."""
    common.prepare(spark)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in common.rows(b):
                data = zlib.decompress(content, wbits=47) if archive.endswith(".gz") else content
                found = sorted((entry(archive, r) for r in parse(data)), key=order)
                for k in range(0, len(found), 4096):
                    yield common.batch_of(ENTRY, found[k : k + 4096])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(each, ENTRY_DDL)


def merge(runs: list[list[tuple]]) -> Iterator[tuple]:
    """k-way merge of sorted runs by a loser tree: inner nodes hold the loser of their match, one path is replayed for each entry."""
    k = len(runs)
    if k <= 1:
        yield from (runs[0] if runs else ())
        return
    at = [0] * k
    heads = [(False, order(r[0])) if r else (True,) for r in runs]  # an exhausted run loses to all others
    losers, winners = [0] * k, [0] * (2 * k)
    for i in range(k):
        winners[k + i] = i
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if heads[a] <= heads[b] else (b, a)
    best = winners[1]
    while not heads[best][0]:
        yield runs[best][at[best]]
        at[best] += 1
        heads[best] = (False, order(runs[best][at[best]])) if at[best] < len(runs[best]) else (True,)
        node = (k + best) // 2
        while node:
            if heads[losers[node]] < heads[best]:
                best, losers[node] = losers[node], best
            node //= 2


def merged_index(runs: DataFrame) -> DataFrame:
    """The entries with range and position: by (range, position) they are in order of URL key, time and id."""
    spark = runs.sparkSession
    runs = common.written(runs, "runs")
    n = runs.count()
    ranges = max(1, -(-n // RANGE_ROWS), min(common.partitions(spark), n // 100))
    sample = runs.where(F.pmod(F.xxhash64("archive", "offset"), F.lit(max(1, n // SPLIT_SAMPLE))) == 0).limit(2 * SPLIT_SAMPLE)
    keys = sorted((r[0], r[1], r[2] is not None, r[2] or 0) for r in sample.select("url_key", "captured", "page_id").collect())
    splitters = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of the runs by range. A batch holds a part of one run or of several; each part is in order."""
        for b in batches:
            pieces: dict[tuple[int, str], list[tuple]] = {}
            for e in common.rows(b):
                pieces.setdefault((bisect_right(splitters, order(e)[:4]), e[7]), []).append(e)
            out = [(r, *map(list, zip(*p, strict=True))) for (r, _), p in pieces.items()]
            yield common.batch_of(pa.schema([("merge_range", pa.int32()), *((f.name, pa.list_(f.type)) for f in ENTRY)]), out)

    lists = ", ".join(f"{c} array<{t}>" for c, t in (x.split() for x in ENTRY_DDL.split(", ")))
    pieces = runs.mapInArrow(cut, f"merge_range int, {lists}")

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        columns = table.drop_columns(["merge_range"]).to_pydict()
        # A run's pieces came in several batches; each piece is sorted on its own.
        out = list(merge([list(zip(*piece, strict=True)) for piece in zip(*columns.values(), strict=True)]))
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array(range(len(out)), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), ENTRY.types, strict=True))], names=["merge_range", "merge_position", *ENTRY.names])

    return pieces.groupBy("merge_range").applyInArrow(join, f"merge_range int, merge_position long, {ENTRY_DDL}")


def round_trip(pages: DataFrame, path: str, least_bytes: int = 100) -> DataFrame:
    """Write pages as archives under path, read them back, and give the merged index."""
    common.prepare(pages.sparkSession)
    write(pages, path, least_bytes)
    return merged_index(read_runs(pages.sparkSession, path))

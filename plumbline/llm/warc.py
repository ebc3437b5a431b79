"""WARC archives of pages, and the histories of their captures by an external merge of sorted index runs.

Writing: a page whose payload equals a later one's is stored as a revisit without it. Each task sorts its records by
URL key and time and writes them as an archive, so every archive is a sorted run. Archives are gzip files; records end
with two line breaks, as the format wants, which Spark's text writer adds.
Reading: each archive is decompressed in windows and parsed by the records' own lengths; a capture keeps its archive and
its place there. An archive's index is cut at key boundaries that all archives share (taken from a bounded sample of
keys), so many that a range holds a bounded number of captures on average; where a range meets, the k runs are merged by
a loser tree, which turns a few rows of each run at a time into Python values.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batched_groups, partitions, shared_dir, written

LEAST_BYTES = 1000
CRLF = "\r\n"
_KINDS = {"string": pa.string(), "long": pa.int64()}
INDEX = "urlkey string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long"
COLUMNS = {x.split()[0]: _KINDS[x.split()[1]] for x in INDEX.split(", ")}
RUNS = ", ".join(f"{n} array<{k}>" for n, k in (x.split() for x in INDEX.split(", ")))
#: Bytes of pages of usual length in one archive, before compression.
ARCHIVE_BYTES = 64 << 20
#: Salts of the join by digest, and the page_ids of the first second of the year 1 and the last one of 9999.
SALTS, EARLIEST, LATEST = 16, -63_713_433_600, 251_824_463_999
#: Bytes that decompressing an archive reads and makes at once, captures of a key range, and rows of a run or of the result that are Python values at once.
WINDOW, RANGE, ROWS = 1 << 20, 500_000, 1000


def urlkey(url: Column) -> Column:
    """A sort key: the host's names from the last to the first, then the rest, in lower case; empty for null."""
    host = F.regexp_extract(F.lower(url), r"^[^:]*://([^/?#:]*)", 1)
    rest = F.regexp_extract(F.lower(url), r"^[^:]*://[^/?#]*(?s:(.*))$", 1)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(""))


def write_archives(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", records_per_file: int = 2000) -> str:
    """Write a WARC record for each page and return the folder of the archives.

    Of pages with equal payloads of at least 1000 bytes, that with the largest page_id is a response, others revisit it;
    all smaller ones are responses. A null payload is empty, a null URL too. Of repeated rows with the same largest id
    all are responses; a null id is a response whose record id has no number. The capture time is the page_id in seconds
    after 2020 (pages have none of their own), at the earliest the first second of the year 1 and at the latest the last
    one of 9999, in UTC; captures beyond are told apart by their ids, so that the order by time is that of all ids.
    A response's block is an HTTP response with the page as its body. Other columns are not read. An archive has at most records_per_file records, and
    fewer where pages are so long on average that it would have more than ARCHIVE_BYTES.
    """
    source = pages.select(pages[id_column].cast("long").alias("page_id"), F.coalesce(pages[url].cast("string"), F.lit("")).alias("url"), F.coalesce(pages[html].cast("string"), F.lit("")).alias("html"))
    usual = source.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    records_per_file = max(1, min(records_per_file, ARCHIVE_BYTES // (int(usual) + 1)))
    marked = source.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html"))
    # only digests that several pages have; counted before they are joined, one row for each task and digest
    shared = marked.where(F.col("size") >= LEAST_BYTES).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    # pages move by digest and salt, so that one common page is dealt to SALTS tasks
    salts = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    placed = salted.join(salts, ["digest", "salt"], "left").withColumn("refers_to", F.when((F.col("size") >= LEAST_BYTES) & (F.col("page_id") < F.col("last")), F.col("last")))
    seconds = F.least(F.greatest(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(EARLIEST)), F.lit(LATEST)).alias("seconds")
    at = F.date_format(F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    is_revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    record = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:unnumbered:"), F.hex(F.xxhash64("url", "digest")), F.lit("-"), F.monotonically_increasing_id().cast("string"), F.lit(">")))),
        line("WARC-Date", F.col("at")),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        line("X-URL-Key", F.regexp_replace("urlkey", r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        F.coalesce(line("WARC-Refers-To", urn(F.col("refers_to"))), F.lit("")),
        F.when(is_revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.when(is_revisit, "0").otherwise((F.octet_length(http) + F.col("size")).cast("string"))),
        F.lit(CRLF),
        F.when(is_revisit, "").otherwise(F.concat(http, F.col("html"))),
    )
    folder = f"{shared_dir(pages.sparkSession)}/plumbline-warc-{uuid.uuid4().hex}"
    runs = placed.withColumn("urlkey", urlkey(F.col("url"))).withColumn("at", at).sortWithinPartitions("urlkey", "at", "page_id")
    runs.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(folder)
    return folder


_NUMBER = re.compile(rb"<urn:page:(-?\d+)>")


def _inflated(archive: bytes) -> Iterator[bytes]:
    """What the archive's gzip members hold, one after the other, in windows."""
    stream, at, pending, within = zlib.decompressobj(31), 0, b"", False
    while pending or at < len(archive):
        if not pending:
            pending, at = archive[at : at + WINDOW], at + WINDOW
        yield stream.decompress(pending, WINDOW)
        within = not stream.eof
        pending = stream.unconsumed_tail if within else stream.unused_data
        if not within:
            stream = zlib.decompressobj(31)
    if within:
        yield stream.flush()
        if not stream.eof:
            raise ValueError("an archive ends within a member")


def parse(archive: bytes) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """The place in the decompressed archive, the header fields and the block of each record, by the records' own lengths."""
    source, held, begin = _inflated(archive), bytearray(), 0

    def reaches(size: int) -> bool:
        while len(held) < size:
            more = next(source, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while reaches(1):
        end, searched = -1, 0
        while (end := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if not reaches(len(held) + 1):
                raise ValueError("an archive ends within a header")
        fields = dict(x.split(b": ", 1) for x in bytes(held[:end]).split(b"\r\n")[1:])
        start = end + 4
        stop = start + int(fields[b"Content-Length"])
        if not reaches(stop + 4) or held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield begin, fields, bytes(held[start:stop])
        del held[: stop + 4]
        begin += stop + 4


class LoserTree:
    """Merges k sorted runs: each inner node keeps the loser of its match, so the next row costs one path of matches."""

    def __init__(self, runs: list[Iterator]):
        self.runs, k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.size = k
        self.losers = [-1] * k
        winners = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.before(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self) -> Iterator:
        while (row := self.heads[self.winner]) is not None:
            yield row
            own = self.winner
            self.heads[own] = next(self.runs[own], None)
            node = (own + self.size) // 2
            while node:
                if self.before(self.losers[node], own):
                    self.losers[node], own = own, self.losers[node]
                node //= 2
            self.winner = own


def _sort_key(row: tuple) -> tuple:
    """Nulls come first."""
    return (row[0], row[1], row[2] is not None, row[2] or 0)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of each archive, in its order; a payload's digest and length are taken from what is stored."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows = []
            for offset, fields, payload in parse(batch.column(1)[i].as_py()):
                number = lambda name: int(m[1]) if (m := _NUMBER.search(fields.get(name, b""))) else None  # noqa: B023, E731
                revisit = fields[b"WARC-Type"] == b"revisit"
                if not revisit:  # the body of the HTTP response
                    payload = payload[payload.index(b"\r\n\r\n") + 4 :]
                digest = fields[b"WARC-Payload-Digest"].split(b":")[1].decode() if revisit else hashlib.sha1(payload).hexdigest()
                size = int(fields[b"X-Payload-Length"]) if revisit else len(payload)
                rows.append((fields[b"X-URL-Key"].decode(), fields[b"WARC-Date"].decode(), number(b"WARC-Record-ID"), size, digest, "revisit" if revisit else "response", number(b"WARC-Refers-To"), offset))
            columns = list(zip(*rows)) or [()] * len(COLUMNS)
            lists = [pa.array([list(c)], pa.list_(k)) for c, k in zip(columns, COLUMNS.values())]
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()]), *lists], names=["archive", *COLUMNS])


def _captures(run: pa.RecordBatch | pa.Table, i: int) -> Iterator[tuple]:
    """(sort key, (archive, *columns)) of the captures of row i, a few of them at once."""
    archive, lists = run.column("archive")[i].as_py(), [run.column(n)[i].values for n in COLUMNS]
    for at in range(0, len(lists[0]), ROWS):
        for row in zip(*(x.slice(at, ROWS).to_pylist() for x in lists)):
            yield _sort_key(row), (archive, *row)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each capture of a part, in order; the runs stay Arrow arrays until their rows are next."""
    for group in batched_groups(batches, "part"):
        part, place = group.column("part")[0].as_py(), 0
        merged = (row for _, row in LoserTree([_captures(group, i) for i in range(group.num_rows)]))
        while some := list(islice(merged, ROWS)):
            made = [pa.array(c, k) for c, k in zip(zip(*some), [pa.string(), *COLUMNS.values()])]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int32()), pa.array(range(place, place + len(some)), pa.int64()), *made], names=["part", "place", "archive", *COLUMNS])
            place += len(some)


def read_histories(spark, folder: str, sample_keys: int = 10_000) -> DataFrame:
    """All captures of the archives in a folder in the order of (urlkey, captured, page_id), with their place.

    Returns (part, place, archive, urlkey, captured, page_id, payload_bytes, payload_digest, record_type, refers_to,
    offset): parts follow each other, place is the order within one, and the record begins at the offset of its archive's
    decompressed bytes. An archive may have one gzip member or one for each record. Captures with the same key, time
    and id are ordered by archive. An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")
    runs = written(files.mapInArrow(_index, f"archive string, {RUNS}"), "capture-runs")
    # boundaries from every n-th key of each run: at most sample_keys and a few for each run reach the driver
    total = runs.agg(F.sum(F.size("page_id"))).first()[0] or 0
    parts = max(partitions(spark), -(-total // RANGE))
    step = max(1, -(-total // sample_keys))
    some = runs.select(F.explode(F.filter(F.arrays_zip("urlkey", "captured"), lambda x, i: i % step == 0)).alias("k")).select("k.*").orderBy(F.rand(1)).limit(sample_keys).collect()
    keys = sorted((r["urlkey"], r["captured"]) for r in some)
    bounds = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                urls, times = batch.column("urlkey")[i].as_py(), batch.column("captured")[i].as_py()
                part = [bisect_right(bounds, k) for k in zip(urls, times)]
                starts = [j for j in range(len(part)) if j == 0 or part[j] != part[j - 1]]
                pieces = [(a, b - a) for a, b in zip(starts, [*starts[1:], len(part)])]
                columns = [pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(c)[i].values.slice(a, n)) for a, n in pieces]) for c in COLUMNS] if pieces else []
                if pieces:
                    yield pa.RecordBatch.from_arrays([pa.array([part[a] for a, _ in pieces], pa.int32()), pa.array([batch.column("archive")[i].as_py()] * len(pieces)), *columns], names=["part", "archive", *COLUMNS])

    dealt = runs.mapInArrow(cut, f"part int, archive string, {RUNS}")
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "archive").mapInArrow(_merge, f"part int, place long, archive string, {INDEX}")


def captures_sql(pages: str = "pages") -> str:
    """DuckDB SQL of the captures' digests, types and references."""
    return f"""
    with p as (select page_id, coalesce(html, '') as html from {pages}), d as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as payload_digest from p),
    w as (select *, max(page_id) over (partition by payload_digest) as last from d)
    select page_id, payload_bytes, payload_digest, case when payload_bytes >= {LEAST_BYTES} and page_id < last then 'revisit' else 'response' end as record_type,
        case when payload_bytes >= {LEAST_BYTES} and page_id < last then last end as refers_to from w"""

"""WARC archives with payload deduplication, and an external merge of their capture indexes.

Writing: one record per page; records are texts (ASCII headers, UTF-8 payload) that Spark's text sink ends with the
record separator, so files are written atomically by task.  Of equal payloads that of the largest page_id is a response,
the others are revisits that refer to it and carry no payload.

Reading: each archive gives a run, its captures sorted by URL key, time and page.  Runs are stored, cut at splitters that
come from evenly spaced captures of all runs, and each range of keys merges its slices of all runs with a loser tree.
The ranges in order are the globally ordered capture histories.

Defined results: a null html is an empty payload; a null url has an empty key and no target header; a null page_id is
smaller than any other, so its record is a revisit if another page has the payload, and refers_to is null where the
response has no page_id; of rows that repeat both page_id and payload all are alike; other columns pass unused.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import materialise, shared_path, small_or_shuffled, table

#: Payloads of at least so many bytes are deduplicated.
LEAST_BYTES = 0
#: Records and payload bytes a file (one record may be larger); an archive is read whole, so this bounds a reader's memory.
FILE_RECORDS = 2000
FILE_BYTES = 128 << 20
#: Every so many captures of a run one is a sample; a range has about so many captures.
SAMPLE_STEP = 32
RANGE_CAPTURES = 20_000
#: At most so many ranges: the keys that cut them are broadcast, so beyond it ranges grow instead.
MAX_RANGES = 100_000

_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = "\r\n\r\n"
_EPOCH = 1_704_067_200


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a string's UTF-8 bytes: each five hexadecimal digits give four letters."""
    digits = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.lower(F.concat(*parts)), "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to).  Only payloads that occur twice are joined back."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    same = lambda df: df.withColumns({"_a": F.sha1(F.col("payload").cast("binary")), "_b": F.xxhash64("payload")})
    keyed = same(rows).where(F.octet_length("payload") >= least_bytes).select("page_id", "_a", "_b")
    twice = materialise(keyed.groupBy("_a", "_b").agg(F.max("page_id").alias("keep"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "repeated")
    n = twice.count()
    out = same(rows).join(small_or_shuffled(twice, n), ["_a", "_b"], "left") if n else rows.withColumn("keep", F.lit(None).cast("long"))
    revisit = F.col("keep").isNotNull() & (F.octet_length("payload") >= least_bytes) & ((F.col("page_id") < F.col("keep")) | F.col("page_id").isNull())
    return out.select("page_id", "url", "payload", base32_sha1(F.col("payload")).alias("digest"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keep")).alias("refers_to"))


def record(row: DataFrame) -> Column:
    """A WARC record, without the separator after it, from the columns of ``with_types``."""
    is_revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    size = F.octet_length("payload")
    target = F.regexp_replace(F.regexp_replace("url", r"\r", "%0D"), r"\n", "%0A")
    second = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31_536_000)) + _EPOCH
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Date", F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss'Z'")), line("WARC-Target-URI", target), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(is_revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("X-Payload-Length", F.when(is_revisit, size.cast("string"))), line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.when(is_revisit, 0).otherwise(size) + len(_HTTP)).cast("string")), F.lit("\r\n" + _HTTP), F.when(is_revisit, "").otherwise(F.col("payload")),
    )


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES) -> None:
    """Archives under ``path``.  Records go to them by classes of size, each 32 times as wide as the one below and with as
    many fewer records a file, so that an archive stays within ``file_bytes`` or has one record."""
    rows = with_types(pages, least_bytes)
    size = F.octet_length("payload")
    largest = pages.agg(F.coalesce(F.max(F.octet_length("html")), F.lit(0))).head()[0]
    low, high = -1, max(1, file_bytes // file_records)
    while low < largest or low < 0:
        some = rows.where((size > low) & (size <= high))
        writer = some.select(record(some).alias("value")).write.option("lineSep", _END).option("compression", "gzip")
        writer.option("maxRecordsPerFile", max(1, min(file_records, file_bytes // high))).text(f"{path}/upto-{high}")
        low, high = high, high * 32


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers with lower-cased names, block, offset) of each record of an archive."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        body = data.index(b"\r\n\r\n", at) + 4
        names = (line.partition(":") for line in data[at : body - 4].decode("utf-8", "replace").split("\r\n")[1:])
        headers = {k.strip().lower(): v.strip() for k, _, v in names}
        size = int(headers["content-length"])
        yield headers, data[body : body + size], at
        at = body + size + len(_END)


def url_key(url: str) -> str:
    """A sortable form of a URL: host labels from the last, without www and port 80 or 443, then path and sorted query."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^@/?#]*@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?", url)
    host, port, path, query = (x or "" for x in m.groups())
    labels = re.sub(r"^www\d*\.", "", host.lower()).split(".")
    port = "" if port in ("", "80", "443") else f":{port}"
    query = "?" + "&".join(sorted(query.lower().split("&"))) if query else ""
    return f"{','.join(reversed(labels))}{port}){path.lower() or '/'}{query}"


CAPTURE = "key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured_at string"
_NAMES = [f.split()[0] for f in CAPTURE.split(", ")]
_ARROW = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.string()) for n in _NAMES])


def captures(data: bytes) -> list[tuple]:
    """An archive's captures as a sorted run.  The key orders by URL key, time and page."""
    out = []
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:none>" else None
    for headers, block, _ in records(data):
        page, refers = number(headers["warc-record-id"]), number(headers.get("warc-refers-to"))
        if headers["warc-type"] == "revisit":
            size, digest = int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
        else:
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        surt = url_key(headers["warc-target-uri"]) if "warc-target-uri" in headers else ""
        when = re.sub(r"\D", "", headers["warc-date"])
        order = "" if page is None else f"{page + (1 << 63):020d}"
        out.append((f"{surt}\x00{when}\x00{order}", page, size, digest, headers["warc-type"], refers, surt, when))
    return sorted(out, key=lambda x: x[0])


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, captures): for each archive file its sorted captures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = captures(gzip.decompress(batch.column(1)[i].as_buffer().to_pybytes()))
                listed = pa.array([[dict(zip(_NAMES, c, strict=True)) for c in found]], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), listed], names=["run", "captures"])

    kind = pa.list_(pa.struct(list(_ARROW)))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, f"run string, captures array<struct<{', '.join(f.replace(' ', ':') for f in CAPTURE.split(', '))}>>")


class LoserTree:
    """Merges sorted sequences of rows whose first field is their key.  ``tree[0]`` is the winner, the other nodes hold
    the losers of their matches; the next row takes one match a level."""

    _LAST = None

    def __init__(self, sequences: Sequence[Iterator[tuple]]) -> None:
        self.sources = [iter(s) for s in sequences]
        self.rows = [next(s, self._LAST) for s in self.sources]
        self.size = len(self.sources)
        self.tree = [-1] * max(self.size, 1)
        for i in range(self.size):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.rows[a], self.rows[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _play(self, winner: int) -> None:
        node = (winner + self.size) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:  # the first to come waits for its match
                self.tree[node] = winner
                return
            if self._beats(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.size and (row := self.rows[winner := self.tree[0]]) is not None:
            yield row
            self.rows[winner] = next(self.sources[winner], self._LAST)
            self._play(winner)


def splitters(found: DataFrame, total: int, range_captures: int = RANGE_CAPTURES, step: int = SAMPLE_STEP) -> list[str]:
    """Keys at which the histories are cut into ranges of about ``range_captures``; one key comes back for each range."""
    samples = found.select(F.explode(F.filter("captures", lambda x, i: i % step == 0)).alias("c")).select("c.key")
    each = max(1, range_captures // step)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = each // 2
        for batch in batches:
            at = [i for i in range(batch.num_rows) if (seen + i) % each == 0]
            seen += batch.num_rows
            yield batch.take(pa.array(at, pa.int64()))

    parts = max(1, min(total // range_captures, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = samples.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(pick, "key string").collect()
    return sorted({r["key"] for r in rows})


def histories(found: DataFrame, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """All captures of the stored runs, with the range they are in, their place in it and their position among all,
    counted from 0; (range, place) and position give the same order."""
    total = found.agg(F.coalesce(F.sum(F.size("captures")), F.lit(0))).head()[0]
    range_captures = max(range_captures, -(-total // MAX_RANGES))
    cuts = found.sparkSession.sparkContext.broadcast(splitters(found, total, range_captures))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                run = batch.column(1).slice(i, 1).flatten()
                keys = run.field("key").to_pylist()
                at = [0, *(bisect_left(keys, c) for c in cuts.value), len(keys)]
                full = [(r, a, b) for r, (a, b) in enumerate(zip(at, at[1:], strict=False)) if a < b]
                if full:
                    parts = pa.chunked_array([pa.array([run.slice(a, b - a).to_pylist()], batch.schema.field(1).type) for _, a, b in full]).combine_chunks()
                    yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in full], pa.int32()), parts], names=["range", "captures"])

    def merge(group: pa.Table) -> pa.Table:
        rows = list(LoserTree([(tuple(c[n] for n in _NAMES) for c in run.as_py()) for run in group.column(1)]))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)]
        return pa.table([pa.array([group.column(0)[0].as_py()] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int64()), *columns], names=["range", "place", *_NAMES])

    listed = found.schema["captures"].dataType.simpleString()
    cut = found.select("run", "captures").mapInArrow(slices, f"range int, captures {listed}")
    merged = cut.groupBy("range").applyInArrow(merge, f"range int, place long, {CAPTURE}")
    sizes = cut.groupBy("range").agg(F.sum(F.size("captures")).alias("_n"))  # a row a range, MAX_RANGES at most
    before = sizes.select("range", (F.sum("_n").over(Window.orderBy("range")) - F.col("_n")).alias("_before"))
    return merged.join(F.broadcast(before), "range").withColumn("position", F.col("_before") + F.col("place")).drop("_before")


def op1_warc_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archives")
    write(table(spark, sf_dir, "pages"), path)
    return histories(materialise(runs(spark, path), "runs")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "position")



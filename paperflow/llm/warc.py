"""WARC archives with a two-level capture index.

write_archives() writes one record per page with Spark's text writer (records end in CRLF, the line end of the writer, so a
file is a valid WARC file and is committed as any Spark output is). Of records with equal payloads of at least MIN_REVISIT
bytes the one with the largest id holds the payload, the others are revisit records that refer to it.

build_index() reads the headers of the archives, window by window past their payloads, sorts captures by reversed-host key (SURT) into ranges, packs each range
into compressed blocks of BLOCK_CAPTURES, and keeps a sparse directory: the first key of each block, one array for each range.
lookup() finds ranges by binary search among their bounds (one row for each range, which is all that is broadcast), blocks by
binary search in a range's directory, and captures by binary search in a block; read_records() then reads the byte ranges.

Nulls and odd input: a null payload is empty; a null url has an empty key; a null id is written without an id and never
referred to while an equal payload has one; line breaks in urls are percent-encoded; repeated rows are records of their own
(those with the largest id are all responses); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import count_of, delete, dropped, scratch, written

MIN_REVISIT = 1000
RECORDS_PER_FILE = 4000
BLOCK_CAPTURES = 256
RANGE_CAPTURES = 500_000
BROADCAST_ROWS = 1_000_000
WINDOW = 1 << 18
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "key string, file string, start long, size long"


def surt(url: Column) -> Column:
    """Reversed host, `)`, path and query without the fragment; lower-case host without user, port and www."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::\d*)?([^#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, pattern, 1)), r"^www\d*\.", "")
    path = F.regexp_extract(url, pattern, 2)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    return F.when(url.rlike(pattern), F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)).otherwise(url)


def planned(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    large = rows.where(F.octet_length("payload") >= MIN_REVISIT)
    shared = large.groupBy("payload_digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1 and holder is not null")
    shared = written(shared.select("payload_digest", "holder"), "shared")
    if count_of(shared) <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    out = rows.join(shared, "payload_digest", "left")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return out.select("page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("holder")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", records_per_file: int = RECORDS_PER_FILE) -> None:
    """WARC/1.1 files of at most records_per_file records under path."""
    r = planned(pages, id_col, url_col, html_col)
    is_revisit = F.col("record_type") == "revisit"
    body = F.when(is_revisit, F.lit("")).otherwise(F.col("payload"))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Refers-To", F.when(is_revisit, urn(F.col("refers_to")))),
        line("WARC-Profile", F.when(is_revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
        F.lit("\r\n"),
    )
    r.select(record.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", records_per_file).text(path)


def _opened(uri: str):
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def header_of(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Fields of the record at this place and where its payload begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    return dict(x.split(": ", 1) for x in lines[1:]), end + 4


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")


def headers(f, window: int = WINDOW) -> Iterator[tuple[dict[str, str], int, int]]:
    """Fields, start and size of every record of an open archive. Reads windows that begin at a header and skips payloads that
    reach beyond them, so neither the archive nor a payload is held."""
    length, at, start, data = f.size(), 0, 0, b""
    while at < length:
        end = data.find(b"\r\n\r\n", at - start)
        size = window
        while end < 0:
            start, data = at, f.read_at(min(size, length - at), at)
            end = data.find(b"\r\n\r\n")
            if end < 0 and at + size >= length:
                raise ValueError(f"a header without an end at {at}")
            size *= 2
        fields, body = header_of(data, at - start)
        after = start + body + int(fields["Content-Length"]) + 4
        yield fields, at, after - at
        at = after
        if at > start + len(data):
            start, data = at, b""


def captures(spark: SparkSession, path: str) -> DataFrame:
    """key, file, start, size of every record, from the headers alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri in frame["file"]:
                with _opened(uri) as f:
                    found = headers(f)
                    while rows := [(fields.get("WARC-Target-URI"), uri, start, size) for fields, start, size in itertools.islice(found, 5000)]:
                        yield pd.DataFrame(rows, columns=["url", "file", "start", "size"])

    files = archive_files(spark, path)
    dealt = files.repartition(max(1, min(count_of(files), 4 * spark.sparkContext.defaultParallelism)))
    return dealt.select("file").mapInPandas(run, "url string, file string, start long, size long").select(surt(F.col("url")).alias("key"), "file", "start", "size")


def build_index(spark: SparkSession, path: str, block_captures: int = BLOCK_CAPTURES, range_captures: int = RANGE_CAPTURES) -> tuple[DataFrame, DataFrame]:
    """blocks(range, block, first_key, last_key, data) and directory(range, first_key, last_key, first_keys, last_keys)."""
    from pyspark import TaskContext

    rows = written(captures(spark, path), "captures")  # deleted once the blocks are written
    ranges = max(1, -(-count_of(rows) // range_captures))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, block, held = TaskContext.get().partitionId(), 0, []

        def packed(part: list) -> pd.DataFrame:
            return pd.DataFrame([(place, block, part[0][0], part[-1][0], zlib.compress(json.dumps(part).encode()))], columns=["range", "block", "first_key", "last_key", "data"])

        for frame in frames:
            held += frame.to_numpy().tolist()
            while len(held) >= block_captures:
                yield packed(held[:block_captures])
                held, block = held[block_captures:], block + 1
        if held:
            yield packed(held)

    ordered = rows.repartitionByRange(ranges, "key", "file", "start").sortWithinPartitions("key", "file", "start")
    blocks = written(ordered.mapInPandas(run, "range int, block int, first_key string, last_key string, data binary"), "blocks")
    dropped(rows)
    entry = F.array_sort(F.collect_list(F.struct("block", "first_key", "last_key")))
    directory = blocks.groupBy("range").agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"), entry.alias("e"))
    return blocks, written(directory.select("range", "first_key", "last_key", F.col("e.first_key").alias("first_keys"), F.col("e.last_key").alias("last_keys")), "directory")


def between(firsts: list[str], lasts: list[str], key: str) -> range:
    """The places whose closed span of keys holds this key; both lists ascend."""
    return range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))


def lookup(keys: DataFrame, blocks: DataFrame, directory: DataFrame) -> DataFrame:
    """key, file, start, size of all captures of the keys (column key)."""
    spark = keys.sparkSession
    bounds = directory.select("range", "first_key", "last_key").orderBy("first_key", "last_key", "range").collect()  # a row for each range
    shared = spark.sparkContext.broadcast(([b["range"] for b in bounds], [b["first_key"] for b in bounds], [b["last_key"] for b in bounds]))

    def to_ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, firsts, lasts = shared.value
        for frame in frames:
            yield pd.DataFrame([(k, ids[i]) for k in frame["key"] for i in between(firsts, lasts, k)], columns=["key", "range"])

    def to_blocks(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(entries):
            return pd.DataFrame(columns=["key", "range", "block"])
        e = entries.iloc[0]
        firsts, lasts = list(e["first_keys"]), list(e["last_keys"])
        return pd.DataFrame([(k, e["range"], b) for k in queries["key"] for b in between(firsts, lasts, k)], columns=["key", "range", "block"])

    def to_captures(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for wanted, data in zip(frame["keys"], frame["data"], strict=True):
                rows = json.loads(zlib.decompress(data))
                own = [r[0] for r in rows]
                for k in wanted:
                    out += rows[bisect.bisect_left(own, k) : bisect.bisect_right(own, k)]
            yield pd.DataFrame(out, columns=["key", "file", "start", "size"])

    in_range = keys.select("key").distinct().mapInPandas(to_ranges, "key string, range int")
    slices = F.expr("int(pmod(xxhash64(key), 32))")
    sliced = directory.select("range", "first_keys", "last_keys", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("slice"))
    in_block = in_range.withColumn("slice", slices).groupBy("range", "slice").cogroup(sliced.groupBy("range", "slice")).applyInPandas(to_blocks, "key string, range int, block int")
    wanted = in_block.groupBy("range", "block").agg(F.collect_list("key").alias("keys"))
    return wanted.join(blocks.select("range", "block", "data"), ["range", "block"]).select("keys", "data").mapInPandas(to_captures, CAPTURE)


def read_records(found: DataFrame) -> DataFrame:
    """Range-reads captures (file, start, size): page_id, url, payload_bytes, payload_digest, record_type, refers_to. What a
    revisit says of its payload is taken from the response that it refers to."""

    def number(urn: str | None) -> int | None:
        return int(urn[len("<urn:page:") : -1]) if urn else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, f = None, None
        for frame in frames:
            out = []
            for uri, start, size in zip(frame["file"], frame["start"], frame["size"], strict=True):
                if uri != name:
                    if f is not None:
                        f.close()
                    name, f = uri, _opened(uri)
                data = f.read_at(size, start)
                fields, body = header_of(data, 0)
                payload = data[body : body + int(fields["Content-Length"])]
                digest = hashlib.sha1(payload).hexdigest()
                stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response" and stated != digest:
                    raise ValueError(f"{uri} at {start}: the payload doesn't have its digest")
                out.append((number(fields.get("WARC-Record-ID")), fields.get("WARC-Target-URI"), len(payload), stated, fields["WARC-Type"], number(fields.get("WARC-Refers-To"))))
            yield pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})
        if f is not None:
            f.close()

    parts = max(found.sparkSession.sparkContext.defaultParallelism, 1)
    ordered = found.repartition(parts * 4, "file").sortWithinPartitions("file", "start")
    rows = written(ordered.mapInPandas(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"), "records")
    responses, revisits = rows.where("record_type = 'response'"), rows.where("record_type = 'revisit'")
    referred = revisits.select("refers_to", "payload_digest").distinct()
    known = responses.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").join(referred, ["refers_to", "payload_digest"], "left_semi").distinct()
    resolved = revisits.drop("payload_bytes").join(known, ["refers_to", "payload_digest"])
    return responses.unionByName(resolved.select(rows.columns))


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives and their index, then reads every capture back through the index."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    blocks, directory = build_index(spark, path)
    url = F.regexp_replace(F.regexp_replace(F.col(url_col).cast("string"), "\r", "%0D"), "\n", "%0A")
    keys = pages.select(surt(url).alias("key"))
    out = read_records(lookup(keys, blocks, directory))  # what it returns stands on a table of its own
    dropped(blocks, directory)
    delete(spark, path)
    return out

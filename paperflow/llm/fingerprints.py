"""MinHash document fingerprints.

A fingerprint is NUM_PERM MinHash values of 16 bits (the low half of multiply-shift universal hashes, minimised over the
word shingles of the whole text), written as hexadecimal. The share of equal values estimates the Jaccard similarity of two
shingle sets; two different minima agree by chance in 1 of 65536 cases. near_duplicates() cuts the same values into bands, joins
the bands in Spark and confirms the Jaccard similarity on full shingle sets.

Nulls and odd input: null and empty texts have the fingerprint of the empty set (all f), equal to each other with likeness 1
and to any other text with likeness 0. Null ids come last in descending order; rows of one id, or without one, are in the
order of a hash of their text, then of the text; repeated rows are documents of their own; other columns are ignored; an empty
table gives an empty result; a single document is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neardup
from .common import MinHash, checkpointed, dropped, mix, shingle_sets, small_batches, tidy, utf8, word_hashes, written

NUM_PERM = 128
BAND_ROWS = 4
PARTITION_CHARS = 16_000_000


def signatures(texts: pa.Array, hasher: MinHash, shingle: int = 5) -> np.ndarray:
    words, at = word_hashes(*utf8(texts))
    return hasher.signatures(*shingle_sets(words, at, shingle)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal values, row by row; empty sets are alike only to empty sets."""
    same = (a == b).mean(axis=1)
    none_a, none_b = (a == 0xFFFF).all(axis=1), (b == 0xFFFF).all(axis=1)
    return np.where(none_a != none_b, 0.0, same)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num_perm: int = NUM_PERM, shingle: int = 5) -> DataFrame:
    """id_col and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(num_perm)
        for batch in batches:
            sig = signatures(batch.column(1), hasher, shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes().hex() for x in sig], pa.string())], [id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), f"`{id_col}` {kind}, fingerprint string")


def _in_order(docs: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id long, text) in as many partitions as ranges of descending doc_id: doc_id, text, h, part, guard, in order.
    The first document of each part is also a guard (guard = 1) at the end of the part before it, that of the first part at the
    end of the last. Rows without an id are dealt to parts of their own by h, a hash of the text."""
    from pyspark.ml.feature import Bucketizer

    at = ", ".join(str(i / parts) for i in range(1, parts)) or "0.5"
    row = docs.selectExpr(f"percentile_approx(doc_id, array({at}), 100000) AS q", "count(*) AS n", "count_if(doc_id IS NULL) AS nulls").first()
    splits = sorted({float(x) for x in row["q"] or []}) if parts > 1 else []
    n_ranges, n_nulls = len(splits) + 1, max(1, -(-row["nulls"] * parts // max(1, row["n"])))
    h = F.shiftrightunsigned(F.xxhash64("text"), 1)
    share = F.least(F.floor(h / float(1 << 63) * n_nulls), F.lit(n_nulls - 1)).cast("int")
    if splits:
        bucketed = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="at", outputCol="bucket", handleInvalid="keep").transform(docs.withColumn("at", F.col("doc_id").cast("double")))
        bucketed = bucketed.withColumn("range", (n_ranges - 1 - F.col("bucket")).cast("int")).drop("at", "bucket")
    else:
        bucketed = docs.withColumn("range", F.lit(0))
    ranged = bucketed.withColumn("part", F.when(F.col("doc_id").isNull(), n_ranges + share).otherwise(F.col("range"))).drop("range")
    heads = ranged.where("doc_id IS NOT NULL").groupBy("part").agg(F.max("doc_id").alias("head"))
    firsts = ranged.join(F.broadcast(heads), "part", "left").where("doc_id IS NULL OR doc_id = head")  # heads: a row for each part
    firsts = firsts.groupBy("part").agg(F.min(F.struct(h.alias("h"), "text")).alias("first"), F.first("doc_id").alias("doc_id"))
    firsts = written(firsts.select("part", "doc_id", "first.h", "first.text"), "guards")
    found = sorted(r["part"] for r in firsts.select("part").collect())
    before = docs.sparkSession.createDataFrame(list(zip(found, [*found[-1:], *found[:-1]], strict=True)), "part int, before int")
    guards = firsts.join(F.broadcast(before), "part").select("doc_id", "text", "h", F.col("before").alias("part"), F.lit(1).alias("guard"))
    rows = ranged.select("doc_id", "text", h.alias("h"), "part", F.lit(0).alias("guard")).unionByName(guards)
    return rows.repartitionById(n_ranges + n_nulls, "part").sortWithinPartitions("guard", F.desc_nulls_last("doc_id"), "h", "text")


def edit_half(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num_perm: int = NUM_PERM, shingle: int = 5, partition_chars: int = PARTITION_CHARS) -> DataFrame:
    """Fingerprints of every text, of its edited text (second half from the next document in descending id), and their
    likeness: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = base.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // partition_chars))
    ordered = small_batches(_in_order(base, ranges))
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(num_perm)
        last = None  # (id, text, signature, part) of a row that waits for its next

        def out(rows: list, nexts: list, edited: list) -> pa.RecordBatch:
            mine = np.stack([r[2] for r in rows])
            es = signatures(pa.array(edited, pa.string()), hasher, shingle)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([len(r[1]) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array([m.tobytes().hex() for m in mine]),
                    pa.array([e.tobytes().hex() for e in es]),
                    pa.array(likeness(mine, es)),
                    pa.array(likeness(mine, np.stack(nexts))),
                ],
                columns,
            )

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                sig = signatures(b.column(1), hasher, shingle)
                rows, nexts, edited = [], [], []
                for i, t, s, p, guard in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), sig, b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                    if last is not None and last[3] == p:
                        rows.append(last)
                        nexts.append(s)
                        edited.append(edit_half(last[1], t))
                    last = None if guard else (i, t, s, p)
                if rows:
                    yield out(rows, nexts, edited)

    return ordered.mapInArrow(tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def band_sketch(docs: DataFrame, id_col: str, text_col: str, num_perm: int, band_rows: int, shingle: int) -> DataFrame:
    """doc_id, set_key (null for an empty set), n_shingles, bands (a hash of each band's number and values), row_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(num_perm)
        number = np.arange(num_perm // band_rows, dtype=np.uint64)
        for batch in batches:
            s, at = shingle_sets(*word_hashes(*utf8(batch.column(1))), shingle)
            values = hasher.signatures(s, at).astype(np.uint16).astype(np.uint64).reshape(batch.num_rows, -1, band_rows)
            bands = mix(number)[None].repeat(batch.num_rows, 0)
            for j in range(band_rows):
                bands = mix(bands ^ values[:, :, j])
            keys = [neardup.set_key(s[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(np.diff(at)), lists, batch.column(2)], ["doc_id", "set_key", "n_shingles", "bands", "row_hash"])

    kind, text = docs.schema[id_col].dataType.simpleString(), F.col(text_col).cast("string")
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("row_hash"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, set_key binary, n_shingles long, bands array<long>, row_hash long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, num_perm: int = NUM_PERM, band_rows: int = BAND_ROWS, shingle: int = 5) -> DataFrame:
    """id_col, component_id: bands of band_rows signature values are joined, links confirmed on full shingle sets at percent.

    With 32 bands of 4 a pair at 0.8 meets in no band with a probability of 5e-8."""
    rows = written(band_sketch(docs, id_col, text_col, num_perm, band_rows, shingle), "sketch")
    sets = rows.where("set_key is not null").groupBy("set_key").agg(F.min("n_shingles").alias("n_shingles"), F.min("row_hash").alias("row_hash"), F.first("bands").alias("bands"))
    sets = written(sets, "sets")
    tokens = sets.select("set_key", "n_shingles", F.explode("bands").alias("token"))
    crowd = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    posted = written(tokens.join(crowd, "token"), "posted")
    wanted = written(posted.select("set_key").distinct().join(sets.select("set_key", "row_hash"), "set_key"), "wanted")
    dropped(sets)
    full = written(neardup.full_sets(docs, id_col, text_col, wanted, shingle), "full")
    comp = checkpointed(neardup.components(neardup.links(posted, full, 1, percent)))
    dropped(posted, full, wanted)
    return neardup.named(rows, comp, id_col).select(id_col, "component_id")

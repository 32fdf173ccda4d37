"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

A text is a sparse vector x: root counts of hashed words (length 1), and one indicator for the quantile bin of each structure
statistic (shares of upper case, digits, punctuation, symbols, lines, distinct words ...) and of its length. The score is
sigmoid(w0 + w.x + sum over pairs <v_i, v_j> x_i x_j); with rank-k factors the pair sum is
half of the sum over factors of (sum v x)^2 - sum v^2 x^2, which scoring takes over the non-zero features alone.

It is fitted on a bounded sample: at most max_train_docs labelled rows, chosen by a hash of the id; scoring covers all rows.

Nulls and odd input: a null text counts as empty, which has a score like any other; labels with a null id or value are not
learned; a null id is never held out and never learned from; without labels of both values every score is the same, close to
the only label (0.5 without any). Repeated rows are scored each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fetched, released, small_batches, tidy, utf8, word_hashes
from .langid import held_out, uniform

WORD_BUCKETS = 4096
BINS = 8
RANK = 8
MAX_TRAIN_DOCS = 4000
HELD_OUT = 3
STATS = ("chars", "words", "word_length", "upper", "digits", "punctuation", "symbols", "bars", "bangs", "lines", "non_ascii", "distinct", "top_word", "odd_ends")
_CLASS = np.zeros((7, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, 48:58] = True
_CLASS[2, [ord(c) for c in ".,;:?'\"()-"]] = True
_CLASS[3, [ord(c) for c in "#$%&*+=<>@^_~`/\\{}[]"]] = True
_CLASS[4, ord("|")] = True
_CLASS[5, ord("!")] = True
_CLASS[6, 10] = True
_CODE = np.full(256, 7, np.uint8)
for _k in range(7):
    _CODE[_CLASS[_k]] = _k
_CODE[128:192] = 8  # continuation bytes
_CODE[192:] = 9


def _grouped(raw: np.ndarray, offsets: np.ndarray, limit: int = 128, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, min(lo + limit, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1))
        yield lo, hi
        lo = hi


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Word part, by its non-zero entries (text, bucket, value; rows of length 1), and structure statistics (texts x len(STATS))."""
    n = len(offsets) - 1
    counts = np.zeros((n, 10))
    size = np.diff(offsets)
    for d in range(n):
        counts[d] = np.bincount(_CODE[raw[offsets[d] : offsets[d + 1]]], minlength=10)
    chars = size - counts[:, 8]
    words, at = word_hashes(raw, offsets)
    n_words = np.diff(at)
    cells, times = np.unique(np.repeat(np.arange(n), n_words) * WORD_BUCKETS + (words >> np.uint64(52)).astype(np.int64), return_counts=True)
    doc, bucket = np.divmod(cells, WORD_BUCKETS)
    value = np.sqrt(times / np.maximum(n_words, 1)[doc]).astype(np.float32)
    top = np.zeros(n)
    np.maximum.at(top, doc, times)
    c, w = np.maximum(chars, 1), np.maximum(n_words, 1)
    ends = np.zeros(n)
    if len(raw):
        odd = (_CODE[raw] == 3) | (_CODE[raw] == 5)
        closing = odd & np.append((raw[1:] == 32) | (raw[1:] == 10), True)
        total = np.concatenate([[0], np.cumsum(closing)])
        ends = (total[offsets[1:]] - total[offsets[:-1]]) / w
    stats = np.column_stack([np.log1p(chars), np.log1p(n_words), chars / w, *(counts[:, k] / c for k in range(6)), counts[:, 6] / w, counts[:, 9] / c, np.bincount(doc, minlength=n) / w, top / w, ends])
    return (doc, bucket, value), stats


@dataclass
class Model:
    cuts: np.ndarray  # statistics x (BINS - 1)
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def bins(self, stats: np.ndarray) -> np.ndarray:
        """The feature numbers of the statistics' bins (texts x statistics)."""
        s = stats.shape[1]
        return WORD_BUCKETS + np.arange(s) * BINS + np.column_stack([np.searchsorted(self.cuts[k], stats[:, k], "right") for k in range(s)])

    def vectors(self, entries: tuple[np.ndarray, np.ndarray, np.ndarray], stats: np.ndarray) -> np.ndarray:
        """The whole feature rows: words, then indicators of the statistics' bins."""
        n, s = stats.shape
        z = np.zeros((n, WORD_BUCKETS + s * BINS), np.float32)
        z[entries[0], entries[1]] = entries[2]
        z[np.arange(n)[:, None], self.bins(stats)] = 1 / np.sqrt(s)
        return z

    def score(self, entries: tuple[np.ndarray, np.ndarray, np.ndarray], stats: np.ndarray) -> np.ndarray:
        """Sum-of-squares identity over the non-zero features."""
        n, s = stats.shape
        if not n:
            return np.zeros(0)
        doc = np.concatenate([entries[0], np.repeat(np.arange(n), s)])
        order = np.argsort(doc, kind="stable")  # every text has at least its statistics
        place = np.concatenate([entries[1], self.bins(stats).ravel()])[order]
        value = np.concatenate([entries[2], np.full(n * s, 1 / np.sqrt(s), np.float32)])[order]
        starts = np.searchsorted(doc[order], np.arange(n))
        each = self.factors[place] * value[:, None]
        pairs = 0.5 * (np.add.reduceat(each, starts) ** 2 - np.add.reduceat(each**2, starts)).sum(1)
        return 1 / (1 + np.exp(-np.clip(self.bias + np.add.reduceat(self.weights[place] * value, starts) + pairs, -30, 30)))


def fit(entries: tuple[np.ndarray, np.ndarray, np.ndarray], stats: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.02, ridge: float = 1e-5, seed: int = 5) -> Model:
    """Adam on the logistic loss, the classes weighted equally in half."""
    rng = np.random.default_rng(seed)
    cuts = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(stats) else np.zeros((len(STATS), BINS - 1))
    mean = float(y.mean()) if len(y) else 0.5
    d = WORD_BUCKETS + len(STATS) * BINS
    model = Model(cuts, float(np.log(mean / (1 - mean))) if 0 < mean < 1 else (mean - 0.5) * 20, np.zeros(d, np.float32), np.zeros((d, RANK), np.float32))
    if not len(y) or not 0 < mean < 1:
        return model
    z = model.vectors(entries, stats)
    model.factors = rng.normal(0, 0.05, (d, RANK)).astype(np.float32)
    p = [np.array([model.bias], np.float32), model.weights, model.factors]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            a, target = z[rows], y[rows]
            sums = a @ p[2]
            raw = p[0] + a @ p[1] + 0.5 * (sums**2 - (a**2) @ (p[2] ** 2)).sum(1)
            g = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - target) / len(rows)).astype(np.float32)
            ag = a * g[:, None]
            grads = [np.array([g.sum()]), ag.sum(0) + ridge * p[1], a.T @ (g[:, None] * sums) - (a * ag).sum(0)[:, None] * p[2] + ridge * p[2]]
            t += 1
            for i, grad in enumerate(grads):
                m[i] += 0.1 * (grad - m[i])
                v[i] += 0.001 * (grad**2 - v[i])
                p[i] -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    model.bias, model.weights, model.factors = float(p[0][0]), p[1], p[2]
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Fits on labelled rows that aren't held out. The chosen ids (max_train_docs at most) are broadcast. Of rows that share
    an id the one of the least hash of its text counts, and rows are fitted in the order of (hash of the id, id), so the model depends
    on the table alone, however its rows lie in files."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col, HELD_OUT, 1))
    share = min(1.0, max_train_docs / max(1, marks.count()))
    some = marks.select(F.col(id_col), F.col(label_col), uniform(id_col, 29).alias("place")).where(F.col("place") < share)
    some = some.groupBy(id_col, "place").agg(F.max(F.col(label_col).cast("int")).alias("label")).orderBy("place", id_col).limit(max_train_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                (doc, bucket, value), stats = features(*utf8(b.column(1)))
                at = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(c)) for c in (bucket.astype(np.int16), value)]
                yield pa.RecordBatch.from_arrays([b.column(0), *lists, pa.array([r.tobytes() for r in stats], pa.binary()), *b.columns[2:]], ["label", "bucket", "value", "stats", "place", "id"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = small_batches(docs).select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    chosen = rows.join(F.broadcast(some), id_col).groupBy("place", F.col(id_col).alias("id")).agg(F.min(F.struct(F.xxhash64("_text").alias("hash"), "_text")).alias("t"), F.min("label").alias("label"))
    chosen = chosen.select("label", F.col("t._text").alias("text"), "place", "id")
    got = chosen.mapInArrow(tidy(run), f"label int, bucket array<short>, value array<float>, stats binary, place double, id {kind}").toArrow()  # a row for each chosen id
    got = got.sort_by([("place", "ascending"), ("id", "ascending")])
    fetched(docs.sparkSession)
    sizes = got["bucket"].combine_chunks().value_lengths().to_numpy()
    bucket, value = (got[c].combine_chunks().flatten().to_numpy() for c in ("bucket", "value"))
    entries = np.repeat(np.arange(len(sizes)), sizes), bucket, value
    stats = np.frombuffer(b"".join(got["stats"].to_pylist()), float).reshape(-1, len(STATS))
    labels = np.array(got["label"].to_pylist(), float)
    del got
    out = fit(entries, stats, labels)
    del entries, bucket, value, stats
    released()
    return out


def _scores(m: Model, texts: pa.Array) -> np.ndarray:
    raw, offsets = utf8(texts)
    out = np.zeros(len(texts))
    for lo, hi in _grouped(raw, offsets):
        part = offsets[lo : hi + 1]
        out[lo:hi] = m.score(*features(raw[part[0] : part[-1]], part - part[0]))
    return out


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """The rows of docs, in all their columns, with a score of at least one half. Python sees the texts and returns a boolean alone."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, max_train_docs))

    @F.arrow_udf("boolean")
    def good(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            yield pa.array(_scores(model.value, texts) >= 0.5)
        released()

    return small_batches(docs).where(good(F.col(text_col).cast("string")))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """id_col, held_out boolean, score double, predicted int of every row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, max_train_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _scores(model.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), held_out(id_col, HELD_OUT, 1).alias("held_out"))
    return small_batches(rows).mapInArrow(tidy(run), f"`{id_col}` {kind}, held_out boolean, score double, predicted int")

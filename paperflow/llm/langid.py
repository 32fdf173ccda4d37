"""Language identification by error-correcting output codes.

Each language has a codeword of bits; one logistic classifier for each bit reads hashed byte 2- and 3-grams of the whole
lower-cased text (digits, ASCII punctuation and white space count as one blank). Decoding is loss-weighted: the codeword with
the least summed logistic loss against the classifiers' margins wins, its share among exp(-loss) is the score. A text is
ambiguous if the two best shares differ by less than AMBIGUOUS, and rejected if it is `und`, or ambiguous with more wrong bits
than the code corrects.

The classifiers are fitted on a bounded sample: at most max_train_docs labelled rows, in about equal parts for each language,
chosen by a hash of the id; the rest of the work covers all rows.

Nulls and odd input: a null text or one without a letter is `und` with score 0; a null language is not learned; a null id is
never held out and never learned from; without any labelled row every text is `und`; with one language every other text has
it. Repeated rows are scored each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, fetched, fresh, released, small_batches, tidy, utf8

BUCKETS = 4096
AMBIGUOUS = 0.2
MAX_TRAIN_DOCS = 4000
HELD_OUT = 5
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[: ord("a")] = 32
_BLANK[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_BLANK[ord("z") + 1 : 128] = 32


def histograms(raw: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """(texts x buckets) float32: root counts of hashed 2- and 3-grams, of length 1."""
    n = len(offsets) - 1
    out = np.zeros((n, buckets), np.float32)
    lo = 0
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    while lo < n:
        hi = max(lo + 1, min(int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1, lo + 64))
        counts = np.zeros((hi - lo) * buckets)
        for at in range(int(offsets[lo]), int(offsets[hi]), SLICE_BYTES):
            end = min(at + SLICE_BYTES + 2, int(offsets[hi]))  # two bytes over, for the grams that begin here
            b = _BLANK[raw[at:end]].astype(np.uint32)
            doc = np.repeat(np.arange(hi - lo), np.diff(np.clip(offsets[lo : hi + 1], at, end)))
            with np.errstate(over="ignore"):
                two = (b[:-1] << np.uint32(8)) | b[1:]
                for gram, width in ((two, 2), ((two[:-1] << np.uint32(8)) | b[2:], 3)):
                    last = min(len(gram), SLICE_BYTES)
                    inside = doc[:last] == doc[width - 1 : width - 1 + last]
                    h = ((gram[:last] * np.uint32(2654435761) + np.uint32(width * 40503)) * np.uint32(2246822519)) >> shift
                    counts += np.bincount((doc[:last] * buckets + h)[inside], minlength=len(counts))
        rows = np.sqrt(counts.reshape(hi - lo, buckets))
        out[lo:hi] = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
        lo = hi
    return out


def code_matrix(n: int, seed: int = 3) -> np.ndarray:
    """Codewords (n x bits) of -1 and 1: all distinct splits of up to 5 languages (two or three languages have too few to
    correct a bit), beyond that the random 31 bits with the largest least distance of 300 draws."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[(s >> i) & 1 for i in range(n)] for s in range(1, 2 ** (n - 1))]).T * 2.0 - 1
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(300):
        code = rng.choice([-1.0, 1.0], (n, 31))
        distance = (31 - code @ code.T) / 2 + np.eye(n) * 99
        if (d := distance.min()) > most and (np.abs(code.sum(0)) < n).all():
            best, most = code, d
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @property
    def radius(self) -> int:
        """Wrong bits that the code corrects."""
        n, bits = self.code.shape
        if n < 2:
            return bits
        distance = (bits - self.code @ self.code.T) / 2 + np.eye(n) * 99
        return int((distance.min() - 1) // 2)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language (index), its share, the lead on the second, wrong bits."""
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(2)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        top = np.sort(share, axis=1)
        lead = top[:, -1] - top[:, -2] if share.shape[1] > 1 else np.ones(len(x))
        wrong = (np.sign(margins) != self.code[best]).sum(1)
        return best, top[:, -1], lead, wrong


def fit_bits(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 120, rate: float = 0.5, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic classifiers of all bits at once (y: texts x bits of -1, 1), by Adam over all rows."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    weight = (weight / weight.sum())[:, None].astype(np.float32)
    for t in range(1, steps + 1):
        g = -y / (1 + np.exp(y * (x @ w + b))) * weight
        for p, grad, m1, v1 in ((w, x.T @ g + ridge * w, m, v), (b, g.sum(0), mb, vb)):
            m1 += 0.1 * (grad - m1)
            v1 += 0.001 * (grad**2 - v1)
            p -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(v1 / (1 - 0.999**t)) + 1e-8)
    return w, b


def held_out(id_col: str, mod: int, rest: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(False))


def uniform(id_col: str, salt: int):
    """A number from 0 to 1 that depends on the id alone."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.lit(salt)), 11) / float(1 << 53)


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_train_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Fits on rows that aren't held out; at most max_train_docs of them, in equal parts for each language."""
    rows = small_batches(docs).where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col, HELD_OUT, 0))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32))
    each = max(1, max_train_docs // len(languages))
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, each / counts[k]))])
    place = fresh(rows, "_place")
    drawn = rows.withColumn(place, uniform(id_col, 17) / share[F.col(lang_col)]).where(F.col(place) < 1)
    last = drawn.select(place).orderBy(place).limit(max_train_docs).agg(F.max(place)).first()[0]  # the draw has max_train_docs rows by expectation
    some = drawn.where(F.col(place) <= F.lit(last)) if last is not None else drawn.limit(0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x = histograms(*utf8(part.column(1))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    got = some.select(F.col(lang_col), F.lower(F.col(text_col).cast("string")), place).mapInArrow(tidy(features), "lang string, x binary").limit(max_train_docs).toArrow()
    fetched(docs.sparkSession)
    if not got.num_rows:
        return Model([], np.ones((0, 1)), np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32))
    labels = got["lang"].to_pylist()
    x = np.empty((len(labels), BUCKETS), np.float32)
    for i, row in enumerate(got["x"]):
        x[i] = np.frombuffer(row.as_buffer(), np.float16)
    del got
    languages = sorted(set(labels))
    index = {c: i for i, c in enumerate(languages)}
    y = np.array([index[c] for c in labels])
    code = code_matrix(len(languages))
    weights, bias = fit_bits(x, code[y].astype(np.float32), (1 / np.bincount(y))[y])
    del x
    released()
    return Model(languages, code, weights, bias)


def _inputs(text_col: str) -> list:
    text = F.col(text_col).cast("string")
    return [F.lower(text), F.coalesce(text.rlike(r"\p{L}"), F.lit(False))]


def _judge(model):
    """Of lower-cased texts and whether they have letters: prediction, score, lead, wrong bits, ambiguous, rejected."""

    def part(m: Model, texts: pa.Array, letters: np.ndarray) -> list[np.ndarray]:
        if m.languages:
            best, score, lead, wrong = m.decode(histograms(*utf8(texts)))
        else:
            letters, best, score, lead, wrong = np.zeros(len(letters), bool), *[np.zeros(len(letters), int)] * 4
        ambiguous = (lead < AMBIGUOUS) & letters
        names = np.array([*m.languages, "und"], object)[np.where(letters, best, len(m.languages))]
        return [names, np.where(letters, score, 0.0), np.where(letters, lead, 0.0), np.where(letters, wrong, 0), ambiguous, ~letters | (ambiguous & (wrong > m.radius))]

    def run(texts: pa.Array, letters: pa.Array) -> list[pa.Array]:
        mask = letters.to_numpy(zero_copy_only=False).astype(bool)
        parts = [part(model.value, texts.slice(lo, 512), mask[lo : lo + 512]) for lo in range(0, len(texts), 512)] or [part(model.value, texts, mask)]
        kinds = [pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_()]
        return [pa.array(np.concatenate(c), k) for c, k in zip(zip(*parts, strict=True), kinds, strict=True)]

    return run


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """The rows of docs, in all their columns, that are not rejected. Python sees the texts and returns a boolean alone."""
    judged = _judge(docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col, max_train_docs)))

    @F.arrow_udf("boolean")
    def rejected(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, letters in columns:
            yield judged(texts, letters)[-1]
        released()

    return small_batches(docs).where(~rejected(*_inputs(text_col)))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """id_col, held_out, lang_pred, score, second_share_lead double, wrong_bits int, ambiguous boolean, rejected boolean."""
    judged = _judge(docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col, max_train_docs)))
    names = [id_col, "held_out", "lang_pred", "score", "lead", "wrong_bits", "ambiguous", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *judged(batch.column(2), batch.column(3))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), held_out(id_col, HELD_OUT, 0).alias("held_out"), *_inputs(text_col))
    return small_batches(rows).mapInArrow(tidy(run), f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, lead double, wrong_bits int, ambiguous boolean, rejected boolean")

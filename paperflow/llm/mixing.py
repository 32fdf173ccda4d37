"""Mixing sources to target weights by iterative proportional fitting.

Topics are clusters learned from all texts: spherical k-means over tf-idf rows of hashed words, a pass of Spark over every
document for each round; every document then gets its nearest cluster. Token counts (words) are
summed in Spark for each (source, language, topic) cell. Raking scales the cells until the token shares of every source,
language and topic are their targets. A cell's factor, times the budget (the share of all tokens that is wanted), is the
expected number of copies of each of its documents. Without repeats no factor may pass 1 / budget: a cell at that bound keeps
all its documents and the others make up for it. With repeats there is no bound, and a document is kept as many times as the
whole part of that number says, and once more with the probability of the rest. A document's uniform number comes from a hash
of its id: the same rows are kept on every run.

The cells are aggregates over three dimensions, at most MAX_CELLS of them (more is an error, not a cut); they go to the driver
and back as a broadcast table. Without targets, those are the marginals of the cells' natural shares to the power TEMPER; with
targets for some dimensions, the others are not held to any. Targets that no weights meet within max_gap (a share of the
tokens) are an error.

Nulls and odd input: a null source or language is a value of its own; a null or empty text or one of white space has no tokens
and the topic `none`; a cell without tokens has the factor 1; a null id takes its uniform number from the text; copies of a
row share their fate; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, fresh, released, small_batches, tidy, utf8, word_hashes, written

MAX_CELLS = 200_000
TEMPER = 0.9
BUDGET = 0.75
MAX_GAP = 0.01
TOPICS = 12
WORD_BUCKETS = 1024
UNIT = float(1 << 24)
DRAWS = 4
DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
SLICE = 256
BLOCK = 128
GAIN = 1e-4
WIDE = 32


def word_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Non-zero entries (text, bucket, count) of hashed words, and the number of words of each text."""
    words, at = word_hashes(*utf8(texts))
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    cells, times = np.unique(doc * WORD_BUCKETS + (words >> np.uint64(54)).astype(np.int64), return_counts=True)
    return *np.divmod(cells, WORD_BUCKETS), times, np.diff(at)


@dataclass
class Topics:
    idf: np.ndarray
    centres: np.ndarray  # topics x WORD_BUCKETS, of length 1

    def nearest(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The topic of each text (-1 without words) and its number of words."""
        doc, bucket, times, n_words = word_counts(texts)
        topic = np.full(len(texts), -1)
        if len(doc):
            near = self.centres.T[bucket] * (np.log1p(times) * self.idf[bucket])[:, None]
            at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            topic[doc[at]] = np.add.reduceat(near, at).argmax(1)  # the text's own length changes nothing
        return topic, n_words


@dataclass
class Part:
    """Entries of up to BLOCK texts that have words, text by text: ends (their number up to each text), bucket, value, and a uniform
    number for each text. A table of parts has them as binary columns, so that a pass hands Python few rows."""

    ends: np.ndarray
    bucket: np.ndarray
    value: np.ndarray  # times of a word's bucket, or in table rows whole numbers: the row's length is UNIT
    place: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))

    def dense(self) -> np.ndarray:
        x = np.zeros((len(self.ends), WORD_BUCKETS))
        x[self.doc, self.bucket] = self.value
        return x

    def nearest(self, centres: np.ndarray) -> np.ndarray:
        return (self.dense() @ centres.T).argmax(1)


PART = {"ends": "<u4", "bucket": "<u2", "value": "<f4", "place": "<f8"}
TIMES = PART | {"value": "<u4"}
PARTS = ", ".join(f"{name} binary" for name in PART)
ROW_GROUP = {"parquet.block.size": str(8 << 20)}  # a reader decodes a row group of such long rows at once


def _parts(batches: Iterator[pa.RecordBatch], kinds: Mapping[str, str] = PART) -> Iterator[Part]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Part(*(np.frombuffer(batch.column(c)[row].as_buffer(), kind) for c, kind in enumerate(kinds.values())))


def _row(part: Part, kinds: Mapping[str, str] = PART) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.asarray(getattr(part, name), kind).tobytes()], pa.binary()) for name, kind in kinds.items()], list(kinds))


def _totals(table: DataFrame, shape: tuple[int, int], of: Callable[[Part], np.ndarray], kinds: Mapping[str, str] = PART) -> np.ndarray:
    """Sums over all parts of what of(part) gives: a matrix of whole numbers. Tasks send their sums, WIDE in a row, which Spark adds up."""
    sums = [f"s{k}" for k in range(WIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-shape[0] * shape[1] // WIDE) * WIDE)
        for part in _parts(batches, kinds):
            total[: shape[0] * shape[1]] += of(part).ravel()
        total = total.reshape(-1, WIDE).astype(np.int64)
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(c) for c in total[at].T)], ["k", *sums])

    got = table.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in ("k", *sums))).groupBy("k").agg(*(F.sum(c).alias(c) for c in sums)).toArrow()
    out = np.zeros((-(-shape[0] * shape[1] // WIDE), WIDE))
    out[got["k"].to_numpy()] = np.stack([got[c].to_numpy() for c in sums], axis=1)
    return out.ravel()[: shape[0] * shape[1]].reshape(shape)


def _drawn(table: DataFrame, centres: np.ndarray, n: int, turn: int) -> np.ndarray:
    """At most n rows, drawn from all with a chance that grows with their distance from the centres, as k-means|| does: those whose
    exponential waiting times at that rate are the shortest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[tuple[float, bytes, bytes]] = []
        for part in _parts(batches):
            far = 1 - (part.dense() @ centres.T).max(1) / UNIT if len(centres) else np.ones(len(part.ends))
            u = np.modf(part.place * (1 << 20) + turn * 0.6180339887498949)[0]
            some = np.flatnonzero(far > 1e-6)
            wait = -np.log(np.maximum(u[some], 1e-300)) / far[some]
            starts = np.concatenate([[0], part.ends])
            for i in np.argsort(wait, kind="stable")[:n]:
                cut = slice(starts[some[i]], starts[some[i] + 1])
                first.append((float(wait[i]), part.bucket[cut].tobytes(), part.value[cut].tobytes()))
            first = sorted(first)[:n]
        if first:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*first, strict=True)], ["wait", "bucket", "value"])

    got = table.mapInArrow(tidy(run), "wait double, bucket binary, value binary").orderBy("wait", "bucket", "value").limit(n).collect()
    out = np.zeros((len(got), WORD_BUCKETS))
    for x, row in zip(out, got, strict=True):
        x[np.frombuffer(row["bucket"], PART["bucket"])] = np.frombuffer(row["value"], PART["value"])
    return out / UNIT


def _seeds(table: DataFrame, topics: int, seed: int) -> np.ndarray:
    """First centres: rows drawn in a few turns, then k-means++ among these, each weighed by the rows that are nearest to it."""
    centres = _drawn(table, np.zeros((0, WORD_BUCKETS)), 1, 0)
    for turn in range(1, DRAWS + 1):
        more = _drawn(table, centres, 2 * topics, turn)
        if not len(more):
            break
        centres = np.concatenate([centres, more])
    weight = _totals(table, (1, len(centres)), lambda part: np.bincount(part.nearest(centres), minlength=len(centres)))[0]
    rng, picked = np.random.default_rng(seed), [int(weight.argmax())]
    while len(picked) < min(topics, len(centres)):
        far = weight * np.maximum(1 - (centres @ centres[picked].T).max(1), 0)
        if far.sum() < 1e-6:
            break
        picked.append(int(rng.choice(len(centres), p=far / far.sum())))
    return centres[picked]


def learn_topics(docs: DataFrame, id_col: str, text_col: str, topics: int = TOPICS, rounds: int = 30, seed: int = 7, gain: float = GAIN) -> Topics:
    """Spherical k-means over tf-idf rows of every text with a word. The first centres are drawn; each round then makes every centre
    anew as the sum over all texts that are nearest to it, until the texts' likeness to their centres, added up, grows by less than
    gain of itself. The texts' rows are written once; a round is a pass over them, and only sums by centre and bucket come to the driver."""
    text = F.col(text_col).cast("string")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                doc, bucket, times, _ = word_counts(part.column(0))
                sizes = np.bincount(doc, minlength=part.num_rows)
                worded = np.flatnonzero(sizes)
                if len(worded):
                    yield _row(Part(np.cumsum(sizes[worded]), bucket, times, part.column(1).to_numpy()[worded]), TIMES)

    table = written(small_batches(docs).select(text, _uniform(F.col(id_col), text, 41).alias("place")).mapInArrow(tidy(counted), PARTS), "topics", **ROW_GROUP)
    counts = _totals(table, (1, WORD_BUCKETS + 1), lambda part: np.append(np.bincount(part.bucket, minlength=WORD_BUCKETS), len(part.ends)), TIMES)[0]
    idf = np.log((1 + counts[WORD_BUCKETS]) / (1 + counts[:WORD_BUCKETS])) + 0.01
    if not counts[WORD_BUCKETS]:
        dropped(table)
        return Topics(idf, np.zeros((1, WORD_BUCKETS)))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, TIMES):  # whole numbers up to 2^24, which 32 bits hold: their sums are the same in any order
            x = np.log1p(part.value) * idf[part.bucket]
            norm = np.sqrt(np.bincount(part.doc, x * x))
            yield _row(Part(part.ends, part.bucket, np.rint(x * (UNIT / norm)[part.doc]), part.place))

    rows = written(table.mapInArrow(tidy(weighed), PARTS), "topics", **ROW_GROUP)
    dropped(table)
    centres, like = _seeds(rows, topics, seed), 0.0

    def summed(part: Part) -> np.ndarray:
        return np.bincount(part.nearest(centres)[part.doc] * WORD_BUCKETS + part.bucket, part.value, len(centres) * WORD_BUCKETS)

    for _ in range(rounds):
        sums = _totals(rows, (len(centres), WORD_BUCKETS), summed)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
        if norm.sum() - like < gain * norm.sum():
            break
        like = norm.sum()
    dropped(rows)
    released()
    return Topics(idf, centres)


def _topic_column(topics: Topics, docs: DataFrame):
    """A column function of a text: topic, n_tokens."""
    model = docs.sparkSession.sparkContext.broadcast(topics)

    @F.arrow_udf("topic string, n_tokens long")
    def of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = np.array([*(f"t{k:02d}" for k in range(len(model.value.centres))), "none"], object)
        for texts in columns:
            parts = [model.value.nearest(texts.slice(lo, SLICE)) for lo in range(0, len(texts), SLICE)]
            topic, n = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, int) for i in (0, 1))
            yield pa.StructArray.from_arrays([pa.array(names[topic], pa.string()), pa.array(n, pa.int64())], ["topic", "n_tokens"])
        released()

    return of.asNondeterministic()  # evaluated once in a plan: the optimizer copies what it takes for cheap into filters


def _uniform(id_: Column, text: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(id_.cast("string"), text, F.lit(""))), 11) / float(1 << 53)


def rake(tokens: np.ndarray, members: list[np.ndarray], targets: list[np.ndarray], most: float = np.inf, tolerance: float = 1e-10, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """Factors of the cells, at most most, and the largest gap between a token share and its target. members[d]: the value of
    each cell in dimension d; targets[d]: the share of each value. Values without tokens get none, the targets of the others
    are scaled to 1."""
    live = tokens > 0
    if not live.any():
        return np.ones(len(tokens)), 0.0
    share = tokens / tokens.sum()
    weight, bound = share.copy(), share * max(most, 1.0)
    goals = []
    for m, t in zip(members, targets, strict=True):
        t = np.where(np.bincount(m, weight, len(t)) > 0, t, 0.0)
        if not t.sum():
            raise ValueError("no value with tokens has a target above 0")
        goals.append(t / t.sum())
    for _ in range(rounds):
        worst = 0.0
        for m, goal in zip(members, goals, strict=True):
            now = np.bincount(m, weight, len(goal))
            worst = max(worst, float(np.abs(now - goal).max()))
            weight = np.minimum(weight * np.divide(goal, now, out=np.ones_like(now), where=now > 0)[m], bound)
        if worst < tolerance:
            break
    gap = max((float(np.abs(np.bincount(m, weight, len(g)) - g).max()) for m, g in zip(members, goals, strict=True)), default=0.0)
    return np.divide(weight, share, out=np.ones(len(tokens)), where=live), gap


@dataclass(frozen=True)
class Mix:
    """What is wanted: target shares by dimension (source, lang, topic) and value, the budget, and whether documents may repeat."""

    targets: Mapping[str, Mapping[str, float]] | None = None
    temper: float = TEMPER
    budget: float = BUDGET
    repeats: bool = False
    max_gap: float = MAX_GAP
    seed: int = 1
    topics: int = TOPICS


def cells(counts: DataFrame, wanted: Mix) -> DataFrame:
    """source, lang, topic, factor, expected of every cell of counts (source, lang, topic, n_tokens)."""
    found = counts.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")).limit(MAX_CELLS + 1).collect()
    if len(found) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic")
    found.sort(key=lambda r: tuple(r)[:3])
    tokens = np.array([r["tokens"] for r in found], float)
    tempered = np.where(tokens > 0, tokens, 0) ** wanted.temper if found else tokens
    members, goals = [], []
    for d in DIMENSIONS:
        names = sorted({r[d] for r in found})
        index = {n: i for i, n in enumerate(names)}
        member = np.array([index[r[d]] for r in found], int)
        if wanted.targets is None:
            goals.append(np.bincount(member, tempered * (tokens > 0), len(names)))
        elif d in wanted.targets:
            goals.append(np.array([wanted.targets[d].get(n, 0.0) for n in names]))
        else:
            continue
        members.append(member)
    factor, gap = rake(tokens, members, goals, np.inf if wanted.repeats else 1 / wanted.budget)
    if gap > wanted.max_gap:
        raise ValueError(f"the targets can't be met: a share stays {gap:.3g} off")
    expected = np.where(tokens > 0, factor * wanted.budget, wanted.budget)
    rows = [(r["source"], r["lang"], r["topic"], float(f), float(e)) for r, f, e in zip(found, factor, expected, strict=True)]
    return counts.sparkSession.createDataFrame(rows, "source string, lang string, topic string, factor double, expected double")


def _value(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(NONE))


def _copies(expected: Column, uniform: Column) -> Column:
    return (F.floor(expected + 1e-12) + (uniform < expected - F.floor(expected + 1e-12)).cast("int")).cast("int")


def weigh(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", wanted: Mix = Mix()) -> DataFrame:  # noqa: B008
    """Every row's id_col, source, lang, topic, n_tokens, factor, probability (of being kept at all), copies, kept. The texts are
    read once after the topics are learned; the small columns are written and read for the rest."""
    text = F.col(text_col).cast("string")
    of = _topic_column(learn_topics(docs, id_col, text_col, wanted.topics), docs)
    small = docs.select(F.col(id_col).alias("id"), _value(source_col).alias("source"), _value(lang_col).alias("lang"), _uniform(F.col(id_col), text, wanted.seed).alias("u"), of(text).alias("t"))
    small = written(small.select("id", "source", "lang", "u", "t.topic", "t.n_tokens"), "mix")
    out = small.join(F.broadcast(cells(small, wanted)), list(DIMENSIONS)).withColumn("copies", _copies(F.col("expected"), F.col("u")))
    return out.select(F.col("id").alias(id_col), *DIMENSIONS, "n_tokens", "factor", F.least("expected", F.lit(1.0)).alias("probability"), "copies", (F.col("copies") > 0).alias("kept"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", wanted: Mix = Mix()) -> DataFrame:  # noqa: B008
    """The kept rows, in the columns of docs, each as often as it has copies. Topics are found twice, for the counts and for the
    rows: that costs less than carrying whole rows through a shuffle."""
    text, m, c = F.col(text_col).cast("string"), fresh(docs, "_mix"), fresh(docs, "_cell")
    of = _topic_column(learn_topics(docs, id_col, text_col, wanted.topics), docs)
    counts = docs.select(_value(source_col).alias("source"), _value(lang_col).alias("lang"), of(text).alias("t"))
    table = cells(counts.select("source", "lang", "t.topic", "t.n_tokens"), wanted).select(F.struct("*").alias(c))
    rows = docs.withColumn(m, of(text))
    same = (_value(source_col) == F.col(f"{c}.source")) & (_value(lang_col) == F.col(f"{c}.lang")) & (F.col(f"{m}.topic") == F.col(f"{c}.topic"))
    rows = rows.join(F.broadcast(table), same).withColumn(m, _copies(F.col(f"{c}.expected"), _uniform(F.col(id_col), text, wanted.seed))).drop(c).where(F.col(m) > 0)
    if wanted.repeats:
        rows = rows.withColumn(m, F.explode(F.sequence(F.lit(1), F.col(m))))
    return rows.drop(m)

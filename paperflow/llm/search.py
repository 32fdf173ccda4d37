"""Exact BM25 top-k with a sharded inverted index and tiles of scores.

Index: each task cuts the documents it reads into shards of about SHARD_TOKENS words and SHARD_DOCS documents at most and stores
one row for each shard: compressed arrays of sorted terms (64-bit word hashes) and postings by ascending document. Documents of a
shard are ordered so that those of like words are neighbours, and cut into groups (alike).
Document frequencies, the number of documents and their mean length are summed over all shards.

Search: queries are cut into blocks of about BLOCK_TERMS terms and QUERY_BLOCK queries, and a block into groups of alike queries; a
task is a query block (a broadcast) against TASK_SHARDS shards of the index or so, so a task's work doesn't grow with the index or the
queries. WAVE blocks at a time are searched in one job, whose results are written before the next. A group of queries meets a
group of documents as a tile of scores in 32 bits: terms that many of both have are multiplied as dense matrices, postings of the
others are added one by one, whichever costs less for the term. Documents whose score in the tile, by a bound of its rounding
error, can be among the k best get their score in 64 bits, summed in the order of terms, so equal documents have equal scores in
whatever shard or tile they lie. The k-th best score so far is the threshold of the next tile and shard. The tasks' best are merged
by score, ties by id. (Block maxima don't help here: with whole documents as queries 98 % of the blocks of 128 documents could hold one of the best.)

Words are runs of letters, digits and non-ASCII characters, A-Z as a-z. The query of a document is made of all words of its
whole text; given queries can be of any terms.

Nulls and odd input: null or empty texts have no terms, match nothing and count as documents of length 0; null ids can be
found but are never queries; repeated rows are documents of their own; other columns are ignored; without documents or
queries the result is empty.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, scratch, small_batches, tidy, utf8, word_hashes, written

K1, B = 1.2, 0.75
SHARD_TOKENS = 1_000_000
SHARD_DOCS = 16_384
GROUP, GROUPS = 1024, 16
CENTRES, COMMON = 8, 256
QUERY_BLOCK = 16_384
BLOCK_TERMS = 1_000_000
TASK_SHARDS = 32
WAVE = 2
DENSE = 0.0025  # share of a tile's pairs that have a term above which multiplying costs less than adding its postings
HEAD, PIECE, RESCORED = 2048, 1 << 17, 256  # terms multiplied, postings added, pairs scored again at a time
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[:48] = _SEPARATOR[58:65] = _SEPARATOR[91:97] = _SEPARATOR[123:128] = True
SHARD = "shard long, n_docs long, n_tokens long, doc_ids binary, lengths binary, groups binary, terms binary, starts binary, docs binary, tfs binary"
TYPES = {"doc_ids": "<i8", "lengths": "<i4", "groups": "<i4", "terms": "<i8", "starts": "<i4", "docs": "<i4", "tfs": "<i4"}
NO_ID = -(2**63)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = utf8(column)
    return word_hashes(np.where(_SEPARATOR[raw], np.uint8(32), raw), offsets)


def _packed(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, kind).tobytes())


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _spans(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n places from each start, one after the other."""
    out = (lo - n.cumsum() + n).repeat(n)
    out += np.arange(len(out))
    return out


def _paired(number: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whole numbers and values, of 32 bits each, side by side, so that both are fetched at once."""
    out = np.empty((len(number), 2), np.int32)
    out[:, 0], out[:, 1] = number, value.astype(np.float32).view(np.int32)
    return out.view(np.int64).ravel()


def _parted(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pairs.view(np.int32)[::2], pairs.view(np.float32)[1::2]


def alike(owner: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of n texts, given by the words that each owns, in which those of like words are neighbours, short before long; and where
    groups begin: GROUP texts or so, GROUPS groups or so. Texts are dealt to the nearest of some centres by their common words;
    no result depends on it."""
    label = np.zeros(n, int)
    if len(words) and n > GROUP:
        seen, times = np.unique(words[:: max(1, len(words) >> 16)], return_counts=True)
        common = np.sort(seen[np.argsort(-times, kind="stable")[:COMMON]])
        at = np.minimum(np.searchsorted(common, words), len(common) - 1)
        own = common[at] == words
        x = np.zeros((n, len(common)), np.float32)
        x[owner[own], at[own]] = 1
        had = x.sum(1)
        x /= np.maximum(np.sqrt(had), 1)[:, None]
        full = np.flatnonzero(had >= np.median(had) / 2)
        seeds = [int(np.argmax(x @ x.sum(0)))]
        near = x[full] @ x[seeds[0]]
        while len(seeds) < CENTRES:  # the text that is least like the seeds so far
            seeds.append(int(full[np.argmin(near)]))
            near = np.maximum(near, x[full] @ x[seeds[-1]])
        centres = x[seeds]
        for _ in range(5):
            label = np.argmax(x @ centres.T, 1)
            sizes = np.bincount(label, minlength=len(centres))
            kept = np.flatnonzero(sizes >= n / 32)
            centres = np.stack([x[label == c].sum(0) for c in kept])
            centres /= np.maximum(np.linalg.norm(centres, axis=1), 1e-9)[:, None]
        label = np.argmax(x @ centres.T, 1)
    order = np.lexsort((np.bincount(owner, minlength=n), label))
    cuts, size = [], max(GROUP, -(-n // GROUPS))
    edges = np.append(np.flatnonzero(np.diff(label[order], prepend=-1)), n)
    for lo, hi in itertools.pairwise(edges):
        cuts.append(np.linspace(lo, hi, -(-(hi - lo) // size) + 1).astype(int)[:-1])
    return order, np.concatenate(cuts) if cuts else np.zeros(0, int)


def shard_row(shard: int, ids: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> dict:
    """The index of documents given by their words, one after the other."""
    place, groups = alike(np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), words, len(lengths))
    words = words[_spans((np.cumsum(lengths, dtype=np.int64) - lengths)[place], lengths[place].astype(np.int64))]
    ids, lengths = ids[place], lengths[place]
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    w = words.view(np.int64)
    order = np.argsort(w, kind="stable")  # documents ascend already
    w, doc = w[order], doc[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(w))).astype(np.int32)
    w, doc = w[at], doc[at]
    first = np.ones(len(w), bool)
    first[1:] = w[1:] != w[:-1]
    arrays = {"doc_ids": ids, "lengths": lengths, "groups": groups, "terms": w[first], "starts": np.append(np.flatnonzero(first), len(w)), "docs": doc, "tfs": tf}
    return {"shard": shard, "n_docs": len(lengths), "n_tokens": int(lengths.sum())} | {k: _packed(v, TYPES[k]) for k, v in arrays.items()}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each shard (SHARD), written in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        schema = pa.schema([(x.split()[0], pa.int64() if x.split()[1] == "long" else pa.binary()) for x in SHARD.split(", ")])
        ids, words, lengths, held, rows = [], [], [], 0, 0

        def cut() -> pa.RecordBatch:
            row = shard_row(number, np.concatenate(ids), np.concatenate(words), np.concatenate(lengths).astype(np.int32))
            ids.clear(), words.clear(), lengths.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        for whole in batches:
            for lo in range(0, whole.num_rows, 100):
                batch = whole.slice(lo, 100)
                w, at = _words(batch.column(1))
                ids.append(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False))
                words.append(w)
                lengths.append(np.diff(at))
                held, rows = held + len(w) + batch.num_rows, rows + batch.num_rows
                if held >= shard_tokens or rows >= SHARD_DOCS:
                    yield cut()
                    number, held, rows = number + 1, 0, 0
        if held:
            yield cut()

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return written(small_batches(rows).mapInArrow(tidy(run), SHARD), "index")


def document_frequencies(index: DataFrame) -> DataFrame:
    """term, df over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t, n = _unpacked(terms, "<i8"), np.diff(_unpacked(starts, "<i4")).astype(np.int64)
                for lo in range(0, len(t), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(t[lo : lo + 50_000]), pa.array(n[lo : lo + 50_000])], ["term", "df"])

    return index.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(queries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, term, qtf of all words of the query texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                batch = whole.slice(lo, 200)
                w, at = _words(batch.column(1))
                doc = np.repeat(np.arange(batch.num_rows), np.diff(at))
                order = np.lexsort((w, doc))
                w, doc = w[order], doc[order]
                first = np.ones(len(w), bool)
                first[1:] = (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
                start = np.flatnonzero(first)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc[start]]), pa.array(w[start].view(np.int64)), pa.array(np.diff(np.append(start, len(w))))], ["query_id", "term", "qtf"])

    rows = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    rows = small_batches(rows).mapInArrow(tidy(run), "query_id long, term long, qtf long")
    return rows.groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf"))


def weighted(terms: DataFrame, index: DataFrame, top: int | None = None) -> tuple[DataFrame, float]:
    """query_id, term, weight (qtf x idf) of all terms of each query (or its top ones), and the mean document length."""
    n, tokens = index.agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    n, tokens = n or 0, tokens or 0
    scored = terms.join(document_frequencies(index), "term").withColumn("weight", F.col("qtf") * F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    if top is not None:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "term"))
        scored = scored.withColumn("place", place).where(F.col("place") <= top)
    return scored.select("query_id", "term", "weight"), max(tokens / max(n, 1), 1e-9)


class Queries:
    """A block of queries in groups of alike ones: their terms by query, and by group and term."""

    def __init__(self, query_id: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.terms, term = np.unique(term, return_inverse=True)
        ids, owner = np.unique(query_id, return_inverse=True)
        place, groups = alike(owner, self.terms[term], len(ids))
        self.edges = np.append(groups, len(ids))
        rank = np.empty(len(ids), int)
        rank[place] = np.arange(len(ids))
        self.ids, owner = ids[place], rank[owner]
        order = np.lexsort((term, owner))
        self.term, self.weight = term[order].astype(np.int32), weight[order].astype(float)
        self.first = np.searchsorted(owner[order], np.arange(len(ids) + 1))

    def by_term(self) -> list[tuple[np.ndarray, ...]]:
        """Of each group: its terms, where the queries that have each begin, and those queries (places in the group) with their weights."""
        out = []
        for lo, hi in itertools.pairwise(self.edges):
            own = slice(self.first[lo], self.first[hi])
            order = np.argsort(self.term[own], kind="stable")
            terms, owner = self.term[own][order], np.arange(hi - lo).repeat(np.diff(self.first[lo : hi + 1]))
            starts = np.flatnonzero(np.diff(terms, prepend=-1))
            out.append((terms[starts], np.append(starts, len(order)), _paired(owner[order], self.weight[own][order])))
        return out


class Shard:
    """A shard's postings of a block's terms, by term and by document."""

    def __init__(self, row: dict, terms: np.ndarray, mean_length: float):
        self.doc_ids, lengths, groups, own, starts, docs, tfs = (_unpacked(row[name], kind) for name, kind in TYPES.items())
        self.n = len(lengths)
        at = np.minimum(np.searchsorted(own, terms), max(len(own) - 1, 0))
        found = np.flatnonzero(own[at] == terms) if len(own) else np.zeros(0, int)
        self.place = np.full(len(terms), -1)  # of the block's terms among those found
        self.place[found] = np.arange(len(found))
        n = (starts[at[found] + 1] - starts[at[found]]).astype(np.int64)
        p = _spans(starts[at[found]].astype(np.int64), n)
        doc, tf, term = docs[p], tfs[p], np.arange(len(found), dtype=np.int32).repeat(n)
        norm = K1 * (1 - B + B * lengths / mean_length)
        impact = tf * (K1 + 1) / (tf + norm[doc])
        self.edges = np.append(groups, self.n)
        group = np.arange(len(groups)).repeat(np.diff(self.edges))[doc]
        self.count = np.bincount(term * np.int64(len(groups)) + group, minlength=len(found) * len(groups))
        start = self.count.cumsum() - self.count
        self.count, self.start = (np.array(x.reshape(len(found), len(groups)).T, np.int32, order="C") for x in (self.count, start))
        self.pairs = _paired(doc - self.edges[group], impact)
        order = np.argsort(doc.astype(np.uint16) if self.n <= 1 << 16 else doc, kind="stable")  # terms ascend within a document
        self.of_doc = np.append(0, np.bincount(doc, minlength=self.n).cumsum())
        self.term, self.impact = term[order], impact[order]

    def tile(self, g: int, terms: tuple[np.ndarray, ...], size: int) -> np.ndarray | None:
        """Scores in 32 bits of the documents of group g for size queries, of which terms has the terms found here: their places, where
        and how many their queries are, and these queries with their weights. None if they share no term."""
        place, begin, many, queries = terms
        have = np.flatnonzero(self.count[g][place])
        place, begin, many = place[have], begin[have], many[have]
        if not len(have):
            return None
        n, n_docs = self.count[g][place], int(self.edges[g + 1] - self.edges[g])
        dense = n * many > DENSE * n_docs * size
        scores = np.zeros((size, n_docs), np.float32)
        head = np.flatnonzero(dense)
        for lo in range(0, len(head), HEAD):
            h = head[lo : lo + HEAD]
            d, w = np.zeros((len(h), n_docs), np.float32), np.zeros((len(h), size), np.float32)
            for to, pairs, lengths in ((d, self.pairs[_spans(self.start[g][place[h]], n[h])], n[h]), (w, queries[_spans(begin[h], many[h])], many[h])):
                at, value = _parted(pairs)
                to.ravel()[(np.arange(len(h)) * to.shape[1]).repeat(lengths) + at] = value
            scores += w.T @ d
        rest = np.flatnonzero(~dense)
        rows, each = queries[_spans(begin[rest], many[rest])], n[rest].repeat(many[rest])
        _parted(rows)[0][:] *= n_docs
        start, ends, cells, lo = self.start[g][place[rest]].repeat(many[rest]), each.cumsum(), scores.ravel(), 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, "right")))
            (row, weight), (at, impact) = _parted(rows[lo:hi].repeat(each[lo:hi])), _parted(self.pairs[_spans(start[lo:hi], each[lo:hi])])
            np.add.at(cells, (row + at).astype(np.intp), weight * impact)
            lo = hi
        return scores


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row."""
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]


class Best:
    """The k best documents of each query of a block so far."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k, self.groups = queries, k, queries.by_term()
        self.docs, self.scores = np.zeros((len(queries.ids), k), np.int64), np.full((len(queries.ids), k), -np.inf)

    def meet(self, shard: Shard) -> None:
        found = []
        for (lo, hi), (terms, starts, own) in zip(itertools.pairwise(self.queries.edges), self.groups, strict=True):
            place = shard.place[terms]
            have = np.flatnonzero(place >= 0)
            if len(have):
                q, doc = self._candidates(shard, (place[have], starts[have], np.diff(starts)[have], own), lo, hi)
                found.append((q + lo, doc))
        if any(len(q) for q, _ in found):
            self._add(shard, *(np.concatenate(x) for x in zip(*found, strict=True)))

    def _candidates(self, shard: Shard, parts: tuple[np.ndarray, ...], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Queries (from lo on) and documents of all pairs that can be among the k best, by query."""
        k, floors = self.k, np.maximum(self.scores[lo:hi, -1], 0)
        slack = (int(np.diff(self.queries.first[lo : hi + 1]).max()) + 16) * 2.0**-23  # more than twice the rounding error of a score
        least = np.maximum(floors * (1 - slack), np.finfo(np.float32).tiny)
        found = []
        shared = shard.count[:, parts[0]].astype(np.float32) @ parts[2].astype(np.float32)
        for g in np.argsort(-shared, kind="stable"):
            scores = shard.tile(int(g), parts, hi - lo)
            if scores is None:
                continue
            able = scores >= least[:, None].astype(np.float32)
            over = np.flatnonzero(np.count_nonzero(able, axis=1) > 2 * k)
            if len(over):
                least[over] = np.maximum(least[over], _kth(scores[over], k) * (1 - 2 * slack))
                able[over] &= scores[over] >= least[over, None]
            at = np.flatnonzero(able)
            q, d = np.divmod(at, able.shape[1])
            found.append((q, d + shard.edges[g], scores.ravel()[at]))
        if not found:
            return np.zeros(0, int), np.zeros(0, int)
        q, doc, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-score, q))
        q, doc, score = q[order], doc[order], score[order]
        first = np.searchsorted(q, np.arange(hi - lo))
        full = np.flatnonzero(np.bincount(q, minlength=hi - lo) >= k)
        least[full] = np.maximum(least[full], score[first[full] + k - 1] * (1 - 2 * slack))
        kept = score >= least[q]
        return q[kept], doc[kept]

    def _scores(self, shard: Shard, q: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Scores of pairs, by document, summed in the order of terms."""
        at, out = shard.place[self.queries.term], np.zeros(len(q))
        own = np.flatnonzero(at >= 0)
        at, weight, first = at[own], self.queries.weight[own], np.searchsorted(own, self.queries.first)
        impacts, held, last = np.zeros(len(shard.count[0])), slice(0), -1
        a, n = first[q], first[q + 1] - first[q]
        for lo in range(0, len(q), RESCORED):
            ends = n[lo : lo + RESCORED].cumsum()
            parts, x = np.empty(ends[-1]), 0
            for d, i, y in zip(doc[lo : lo + RESCORED].tolist(), a[lo : lo + RESCORED].tolist(), ends.tolist(), strict=True):
                if d != last:
                    impacts[shard.term[held]] = 0
                    held, last = slice(shard.of_doc[d], shard.of_doc[d + 1]), d
                    impacts[shard.term[held]] = shard.impact[held]
                part, mine = parts[x:y], slice(i, i + y - x)
                impacts.take(at[mine], out=part, mode="clip")
                part *= weight[mine]
                x = y
            out[lo : lo + RESCORED] = np.bincount(np.arange(len(ends)).repeat(n[lo : lo + RESCORED]), parts, len(ends))
        return out

    def _add(self, shard: Shard, q: np.ndarray, doc: np.ndarray) -> None:
        order = np.argsort(doc, kind="stable")
        q, doc = q[order], doc[order]
        doc, score = shard.doc_ids[doc], self._scores(shard, q, doc)
        queries = np.unique(q)
        had = self.scores[queries] > -np.inf
        q = np.concatenate([queries.repeat(self.k)[had.ravel()], q])
        doc, score = np.concatenate([self.docs[queries][had], doc]), np.concatenate([self.scores[queries][had], score])
        order = np.lexsort((doc, -score, q))
        q, doc, score = q[order], doc[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        self.docs[q[kept], place[kept]], self.scores[q[kept], place[kept]] = doc[kept], score[kept]


def _searcher(block: Broadcast, mean_length: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the shards that come, the k best documents of each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(block.value, k)
        for batch in batches:
            for i in range(batch.num_rows):
                best.meet(Shard(batch.slice(i, 1).to_pylist()[0], best.queries.terms, mean_length))
        for lo in range(0, len(best.scores), 2000):
            scores = best.scores[lo : lo + 2000]
            some = scores > -np.inf
            if some.any():
                docs = best.docs[lo : lo + 2000][some]
                yield pa.RecordBatch.from_arrays([pa.array(best.queries.ids[lo : lo + 2000].repeat(some.sum(1))), pa.array(docs, mask=docs == NO_ID), pa.array(scores[some])], ["query_id", "doc_id", "score"])

    return tidy(run)


def search(index: DataFrame, weights: DataFrame, mean_length: float, k: int = 10, block_terms: int = BLOCK_TERMS, wave: int = WAVE) -> DataFrame:
    """query_id, rank, doc_id, score: the k best of each query (fewer if fewer share a term with it)."""
    spark = index.sparkSession
    weights = written(weights, "queries")
    queries, terms = weights.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.count("*"), F.sum("n")).first()
    blocks = max(1, -(-queries // QUERY_BLOCK), -(-(terms or 0) // block_terms))
    if blocks > 1:  # in files by block, of which a block reads its own
        whole, number = weights, F.expr(f"pmod(xxhash64(query_id), {blocks})")
        weights = written(whole.repartition(blocks, number).withColumn("block", number), "queries")
        dropped(whole)
    place, schema = scratch(spark, "found"), "query_id long, doc_id long, score double"
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-index.count() // TASK_SHARDS))  # a task's thresholds grow with its shards
    for lo in range(0, blocks, wave):
        parts, held = [], []
        for i in range(lo, min(lo + wave, blocks)):
            rows = (weights.where(F.col("block") == i).drop("block") if blocks > 1 else weights).toArrow()
            held.append(spark.sparkContext.broadcast(Queries(*(rows.column(c).to_numpy() for c in ("query_id", "term", "weight")))))
            parts.append(small_batches(index).coalesce(tasks).mapInArrow(_searcher(held[-1], mean_length, k), schema))
        functools.reduce(DataFrame.union, parts).write.mode("append").parquet(place)
        for block in held:
            block.destroy()
    dropped(weights)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return spark.read.schema(schema).parquet(place).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 50, k: int = 10) -> DataFrame:
    """The k best documents for each document whose id is divisible by every, itself among them."""
    index = build_index(docs, id_col, text_col)
    weights, mean_length = weighted(query_terms(docs.where(F.col(id_col) % every == 0), id_col, text_col), index)
    found = search(index, weights, mean_length, k)
    dropped(index)
    return found

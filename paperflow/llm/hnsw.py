"""Approximate nearest neighbours by the largest inner product: a hierarchical navigable small-world graph for each shard.

Vectors are dealt to shards of about SHARD_ROWS by a hash, so that copies of one vector don't meet. A shard's distinct vectors are the
nodes of one graph; equal vectors are one node with the smallest ids of its copies, as many as any query can be given. Each node has
a random level; the graph of a level is a flat array of neighbours, nodes x width, with -1 for none. Inner products become distances by
one more coordinate that makes all vectors of a shard equally long. Nodes enter in waves that double: a wave searches the graph
for its candidates, adds its own members, and keeps neighbours that are closer to the node than to each other (diversity). A query walks
down the levels and then searches level 0 with a beam of ef nodes; all queries of a block walk at once in numpy. Every query is given
to every shard, in blocks, and the shards' results are merged; scores are inner products of the original vectors in double precision.

A node that no walk can reach is found by a scan: if a beam ends with fewer nodes than were asked for, its shard is scanned in
blocks for that query.

Nulls and odd input: vectors that are null, empty, all zero, or hold a null or non-finite component take no part, as rows without an
id; vectors of different lengths are not compared, they are in shards of their own; rows that share an id are candidates each, and a
query's own rows are those of its id; rows of one id with different vectors are queries each, equal ones are one query; ties go to the smaller id; a table of one row gives an empty result, as an empty one; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, tidy, written

SHARD_ROWS = 8192
WIDTH = 24
EF_BUILD = 96
EF_SEARCH = 160
WAVE = 512
QUERY_BLOCK = 4096
AT_ONCE = 256
EXPAND = 4
MOST_TASKS = 20_000


def _beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, banned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, scores) of the ef best nodes that a best-first walk over links finds for each query from its entry node (queries x
    entries), best first; -1 and -inf where there are fewer."""
    n, q = len(vectors), np.arange(len(queries))
    seen = np.zeros((len(queries), n + 1), bool)  # the last column is for -1
    seen[:, n] = True
    seen[q[:, None], entry] = True
    nodes = np.full((len(queries), ef), -1, np.int32)
    scores = np.full((len(queries), ef), -np.inf, np.float32)
    done = np.ones((len(queries), ef), bool)
    k = min(entry.shape[1], ef)
    nodes[:, :k], done[:, :k] = entry[:, :k], False
    scores[:, :k] = np.einsum("qkd,qd->qk", vectors[entry[:, :k]], queries)
    live = q
    while len(live):
        open_ = np.where(done[live], -np.inf, scores[live])
        pick = np.argpartition(-open_, min(EXPAND, ef) - 1, axis=1)[:, :EXPAND] if ef > EXPAND else np.argsort(-open_, axis=1)
        good = np.take_along_axis(open_, pick, 1) > -np.inf
        more = good.any(axis=1)
        live, pick, good = live[more], pick[more], good[more]
        if not len(live):
            break
        at = np.where(good, nodes[live[:, None], pick], -1)
        done[live[:, None], pick] = True
        near = links[at]  # links[-1] is a row of -1
        near = near.reshape(len(live), -1)
        fresh = ~seen[live[:, None], near]
        near = np.where(fresh, near, -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        width = int((near >= 0).sum(axis=1).max(initial=0))
        if not width:
            continue
        near.sort(axis=1)
        near = near[:, -width:]
        seen[live[:, None], near] = True
        found = np.einsum("qkd,qd->qk", vectors[near], queries[live])
        found[near < 0] = -np.inf
        all_scores = np.concatenate([scores[live], found], axis=1)
        all_nodes = np.concatenate([nodes[live], near], axis=1)
        all_done = np.concatenate([done[live], near < 0], axis=1)
        top = np.argpartition(-all_scores, ef - 1, axis=1)[:, :ef]
        scores[live] = np.take_along_axis(all_scores, top, 1)
        nodes[live] = np.take_along_axis(all_nodes, top, 1)
        done[live] = np.take_along_axis(all_done, top, 1)
    order = np.argsort(-scores, axis=1, kind="stable")
    nodes, scores = np.take_along_axis(nodes, order, 1), np.take_along_axis(scores, order, 1)
    nodes[scores == -np.inf] = -1
    return nodes, scores


def _diverse(vectors: np.ndarray, base: np.ndarray, candidates: np.ndarray, keep: int) -> np.ndarray:
    """For each base node keep of its candidates (-1: none; nearest first) that are nearer to it than to any kept before, filled up with
    the nearest of the others."""
    out = np.full((len(base), keep), -1, np.int32)
    for lo in range(0, len(base), AT_ONCE):
        c = candidates[lo : lo + AT_ONCE]
        v = vectors[c]
        here = np.einsum("bcd,bd->bc", v, vectors[base[lo : lo + AT_ONCE]])
        among = v @ v.transpose(0, 2, 1)
        blocked = np.full(c.shape, -np.inf, np.float32)  # the largest product with a kept one
        kept = np.zeros(c.shape, bool)
        n = np.zeros(len(c), np.int64)
        for j in range(c.shape[1]):
            take = (c[:, j] >= 0) & (here[:, j] > blocked[:, j]) & (n < keep)
            kept[:, j] = take
            n += take
            blocked = np.where(take[:, None], np.maximum(blocked, among[:, j]), blocked)
        rank = np.where(c < 0, 2, np.where(kept, 0, 1)) * c.shape[1] + np.arange(c.shape[1])
        order = np.argsort(rank, axis=1)[:, :keep]
        out[lo : lo + len(c), : order.shape[1]] = np.take_along_axis(c, order, 1)
    return out


def _nearest_first(vectors: np.ndarray, base: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """candidates of each base node, nearest first, without repeats and without the node itself."""
    c = np.sort(np.where(candidates == base[:, None], -1, candidates), axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    s = np.empty(c.shape, np.float32)
    for lo in range(0, len(base), AT_ONCE):
        s[lo : lo + AT_ONCE] = np.einsum("bcd,bd->bc", vectors[c[lo : lo + AT_ONCE]], vectors[base[lo : lo + AT_ONCE]])
    s[c < 0] = -np.inf
    return np.take_along_axis(c, np.argsort(-s, axis=1, kind="stable"), 1)


class Graph:
    """The flat neighbour arrays of a shard: links[level] is (nodes + 1) x width, int32; the last row is -1."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], entry: int):
        self.vectors, self.links, self.entry = vectors, links, entry

    @staticmethod
    def augmented(vectors: np.ndarray) -> np.ndarray:
        """float32 vectors with the coordinate that makes all equally long, scaled to the unit sphere."""
        v = vectors / np.sqrt((vectors**2).sum(axis=1).max(initial=1e-300))
        return np.hstack([v, np.sqrt(np.maximum(0, 1 - (v**2).sum(axis=1)))[:, None]]).astype(np.float32)

    @classmethod
    def build(cls, vectors: np.ndarray, width: int = WIDTH, ef: int = EF_BUILD, seed: int = 1) -> Graph:
        """vectors: augmented. Nodes enter in the order of a seeded shuffle; levels are seeded as well."""
        n, rng = len(vectors), np.random.default_rng(seed)
        order = rng.permutation(n)
        level = np.floor(-np.log(1 - rng.random(n)) / np.log(width)).astype(int)
        level[order[0]] = max(level.max(initial=0), 0)
        links = [np.full((n + 1, 2 * width if h == 0 else width), -1, np.int32) for h in range(level.max(initial=0) + 1)]
        graph, at = cls(vectors, links, int(order[0])), 1
        while at < n:
            wave = order[at : at + min(WAVE, at)]
            entry = np.full((len(wave), 1), graph.entry)
            for h in range(len(links) - 1, -1, -1):
                found = np.concatenate([_beam(vectors, links[h], vectors[wave[lo : lo + AT_ONCE]], entry[lo : lo + AT_ONCE], ef if (level[wave] >= h).any() else 1)[0] for lo in range(0, len(wave), AT_ONCE)])
                entry = np.where(found[:, :1] >= 0, found[:, :1], entry)
                mine = level[wave] >= h
                if mine.any():
                    graph._enter(h, wave[mine], found[mine], width)
            at += len(wave)
        return graph

    def _enter(self, h: int, new: np.ndarray, found: np.ndarray, width: int) -> None:
        vectors, links = self.vectors, self.links[h]
        peers = vectors[new] @ vectors[new].T
        np.fill_diagonal(peers, -np.inf)
        k = min(width, len(new) - 1)
        own = new[np.argpartition(-peers, k - 1, axis=1)[:, :k]] if k > 0 else np.zeros((len(new), 0), int)
        candidates = _nearest_first(vectors, new, np.hstack([found, own]).astype(np.int32))
        chosen = _diverse(vectors, new, candidates[:, : 4 * width], width)
        links[new, :width] = chosen
        to, of = chosen.ravel(), np.repeat(new, chosen.shape[1])
        of, to = of[to >= 0], to[to >= 0]
        by = np.argsort(to, kind="stable")
        of, to = of[by], to[by]
        touched, first = np.unique(to, return_index=True)
        place = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        extra = np.full((len(touched), int(place.max(initial=-1)) + 1), -1, np.int32)
        extra[np.searchsorted(touched, to), place] = of
        both = _nearest_first(vectors, touched, np.hstack([links[touched], extra]))
        room = links.shape[1]
        many = (both >= 0).sum(axis=1) > room
        links[touched[~many]] = both[~many, :room]
        if many.any():
            links[touched[many]] = _diverse(vectors, touched[many], both[many, : 3 * room], room)

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """(queries x ef) nodes for queries of the vectors' length before they were augmented; -1 for none."""
        q = np.hstack([queries, np.zeros((len(queries), 1))]).astype(np.float32)
        out = []
        for lo in range(0, len(q), AT_ONCE):
            own = q[lo : lo + AT_ONCE]
            entry = np.full((len(own), 1), self.entry)
            for h in range(len(self.links) - 1, 0, -1):
                found = _beam(self.vectors, self.links[h], own, entry, 8)[0]
                entry = np.where(found[:, :1] >= 0, found[:, :1], entry)
            out.append(_beam(self.vectors, self.links[0], own, entry, ef)[0])
        return np.concatenate(out) if out else np.zeros((0, ef), np.int32)


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each row summed in the same way, so that equal vectors have equal scores."""
    return (vectors * query).sum(axis=-1)


INDEX = "dim int, shard long, n_nodes int, vectors binary, ids binary, starts binary, entry int, widths array<int>, links binary"


def index_shards(batches: Iterator[pa.RecordBatch], keep: int, width: int, ef: int) -> Iterator[pa.RecordBatch]:
    """One row of flat arrays for each shard (dim, shard): doubles of the distinct vectors, ids of each (the keep smallest), links of all
    levels as int32."""
    table = pa.Table.from_batches(list(batches)).combine_chunks()
    dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
    flat = table.column("v").combine_chunks()
    v = np.asarray(flat.flatten(), np.float64).reshape(-1, dim)
    copies = np.minimum(table.column("copies").to_numpy(), keep)
    v, ids = np.repeat(v, copies, axis=0), np.repeat(table.column("id").to_numpy(), copies)
    order = np.lexsort((ids, *v.T[::-1]))
    v, ids = v[order], ids[order]
    first = np.append(True, (v[1:] != v[:-1]).any(axis=1))
    node = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    few = np.arange(len(ids)) - at[node] < keep
    v, ids, node = v[first], ids[few], node[few]
    graph = Graph.build(Graph.augmented(v), width, ef)
    starts = np.searchsorted(node, np.arange(len(v) + 1))
    yield pa.RecordBatch.from_pylist(
        [
            {
                "dim": dim, "shard": shard, "n_nodes": len(v), "vectors": v.tobytes(), "ids": ids.astype(np.int64).tobytes(), "starts": starts.astype(np.int32).tobytes(), "entry": graph.entry,
                "widths": [x.shape[1] for x in graph.links], "links": b"".join(x.tobytes() for x in graph.links),
            }
        ],
        schema=pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("n_nodes", pa.int32()), ("vectors", pa.binary()), ("ids", pa.binary()), ("starts", pa.binary()), ("entry", pa.int32()), ("widths", pa.list_(pa.int32())), ("links", pa.binary())]),
    )


class Shard:
    def __init__(self, row: dict):
        n, at = row["n_nodes"], 0
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, -1)
        self.ids, self.starts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["starts"], np.int32)
        flat, links = np.frombuffer(row["links"], np.int32), []
        for w in row["widths"]:
            links.append(flat[at : at + (n + 1) * w].reshape(n + 1, w))
            at += (n + 1) * w
        self.graph = Graph(Graph.augmented(self.vectors), links, row["entry"])

    def best(self, ids: np.ndarray, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, id, score) of each query's k best here, other ids than its own."""
        n = len(self.vectors)
        ef = min(max(ef, 2 * k + 2), n)
        rows = []
        for lo in range(0, len(queries), AT_ONCE):
            own = queries[lo : lo + AT_ONCE]
            found = self.graph.search(own, ef)
            for i, nodes in enumerate(found):
                nodes = nodes[nodes >= 0]
                if len(nodes) < min(n, k + 1):  # out of reach of the walk
                    scores = np.concatenate([exact(self.vectors[x : x + 4096], own[i]) for x in range(0, n, 4096)])
                    nodes = np.argsort(-scores, kind="stable")[: 2 * k + 2]
                    rest = np.flatnonzero(scores == scores[nodes[-1]])  # ties at the end go by id
                    nodes = np.union1d(nodes, rest)
                scores = exact(self.vectors[nodes], own[i])
                size = self.starts[nodes + 1] - self.starts[nodes]
                which = np.repeat(np.arange(len(nodes)), size)
                place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + self.starts[nodes][which]
                got, s = self.ids[place], scores[which]
                got, s = got[got != ids[lo + i]], s[got != ids[lo + i]]
                top = np.lexsort((got, -s))[:k]
                rows.append((np.full(len(top), lo + i), got[top], s[top]))
        return tuple(np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def vectors_of(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dim, v (doubles), copies (rows that are equal in both) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    wild = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.exists("v", wild) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id", "v").agg(F.count("*").alias("copies")).select("id", F.size("v").alias("dim"), "v", "copies")


def build_index(rows: DataFrame, keep: int, shard_rows: int = SHARD_ROWS, width: int = WIDTH, ef: int = EF_BUILD) -> DataFrame:
    """INDEX rows, one for each shard, written to the shared folder. keep: the most results that a query can be given, with its own."""
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    tasks = min(sizes.agg(F.sum("shards")).first()[0] or 1, MOST_TASKS)  # by number: the work isn't in the bytes
    dealt = rows.join(sizes, "dim").select("dim", F.pmod(F.xxhash64("id", "v"), "shards").alias("shard"), "id", "v", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from index_shards(batches, keep, width, ef)

    return written(small_batches(dealt).repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInArrow(run, INDEX), "hnsw")


def nearest(table: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, width: int = WIDTH, ef_build: int = EF_BUILD, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by every."""
    rows = written(vectors_of(table, id_col, vector_col), "vectors")
    index = build_index(rows, k + 1, shard_rows, width, ef_build)
    queries = rows.where(F.col("id") % every == 0).select("id", "dim", "v", F.xxhash64("v").alias("of"))
    # a block of queries goes to every shard of its vector length: one row for each shard and block, joined on the shard
    number = F.pmod(F.xxhash64("id", "v"), F.greatest(F.lit(1), F.ceil(F.col("n") / QUERY_BLOCK)))
    counts = queries.groupBy("dim").agg(F.count("*").alias("n"))
    blocks = queries.join(counts, "dim").groupBy("dim", number.alias("block")).agg(F.collect_list(F.struct("id", "of", "v")).alias("queries"))
    asked = blocks.join(index.select("dim", "shard"), "dim")
    tasks = min(asked.count() or 1, MOST_TASKS)
    pairs = index.join(asked, ["dim", "shard"]).repartition(tasks, "dim", "shard", "block").drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                asked = row.column("queries").flatten()
                ids, of = np.asarray(asked.field("id"), np.int64), np.asarray(asked.field("of"), np.int64)
                vectors = np.asarray(asked.field("v").flatten(), np.float64).reshape(len(ids), -1)
                shard = Shard({c: row.column(c)[0].as_py() for c in ("n_nodes", "vectors", "ids", "starts", "entry", "widths", "links")})
                which, found, score = shard.best(ids, vectors, k, ef)
                yield pa.RecordBatch.from_arrays([pa.array(ids[which]), pa.array(of[which]), pa.array(found), pa.array(score)], ["query_id", "of", "vec_id", "score"])

    found = small_batches(pairs).mapInArrow(tidy(run), "query_id long, of long, vec_id long, score double")
    order = Window.partitionBy("query_id", "of").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

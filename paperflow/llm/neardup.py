"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Every text gives its set of distinct shingles, a 128-bit key of that set and a MinHash signature. Rows of one key are
   copies; from here on there is one row per distinct set.
2. Every (coordinate, value) pair of a signature is a token. Sets are posted under tokens that at least two sets have, rarest
   first, and only under as many as any partner with enough collisions must share (prefix); sets with fewer shared tokens
   than the match threshold are skipped.
3. Collisions of two posted sets are counted over the whole signature; pairs under the match threshold are skipped, the others
   are confirmed on their full shingle sets.
4. Lists are joined without emitting all pairs. Each list first compares its members with one member (another one in every
   list), links are merged into components, and only members of different components are still compared: pair by pair in
   short lists; in long lists in blocks, of which each returns a spanning forest of its links. Nothing is capped: every
   posted pair is either compared or already in one component.

The match threshold is the largest count that a pair at the wanted similarity reaches with a probability of 1 - MISS.

Nulls and odd input: a null, empty or blank text has an empty set: component_id is its own id, kept is true, n_shingles 0. A
null id takes part like any other row but never names a component while one of its members has an id. Repeated rows are
copies; rows of the same id are all kept if that id names the component. Other columns of the input are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MinHash, checkpointed, count_of, dropped, fresh, shingle_sets, small_batches, texts_of, tidy, word_hashes, written

NUM_PERM = 48
MISS = 1e-8
SHORT_LIST = 32
BLOCK_SHINGLES = 200_000
BROADCAST_ROWS = 2_000_000  # of eight bytes
BROADCAST_LISTS = 200_000


def match_threshold(similarity: float, num_perm: int, miss: float = MISS) -> int:
    """The largest t with P(matches < t) <= miss, at the wanted similarity."""
    total, t = 0.0, 0
    while t < num_perm:
        total += math.comb(num_perm, t) * similarity**t * (1 - similarity) ** (num_perm - t)
        if total > miss:
            break
        t += 1
    return max(1, t)


def sketch(docs: DataFrame, id_col: str, text_col: str, num_perm: int, shingle: int, seed: int = 1) -> DataFrame:
    """doc_id, set_key (null for an empty set), n_shingles, sig, row_hash of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(num_perm, seed)
        for batch in batches:
            words, at = word_hashes(*texts_of(batch, "text"))
            s, at = shingle_sets(words, at, shingle)
            sig = hasher.signatures(s, at).view(np.int32)
            keys = [set_key(s[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            sigs = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * num_perm), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(np.diff(at)), sigs, batch.column(2)], ["doc_id", "set_key", "n_shingles", "sig", "row_hash"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("row_hash"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, set_key binary, n_shingles long, sig array<int>, row_hash long")


def set_key(members: np.ndarray) -> bytes | None:
    return hashlib.blake2b(members.astype("<u8", copy=False).tobytes(), digest_size=16).digest() if len(members) else None


def full_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, shingle: int) -> DataFrame:
    """set_key, members (shingle hashes) and, if wanted has it, sig of the wanted sets (columns set_key, row_hash), from one row of each."""
    extra = [c for c in ("sig",) if c in wanted.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = word_hashes(*texts_of(batch, "text"))
            s, at = shingle_sets(words, at, shingle)
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                cut = at[lo : lo + part.num_rows + 1]
                lists = pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), pa.array(s[cut[0] : cut[-1]].view(np.int64)))
                same = pa.array([set_key(s[x:y]) == k for x, y, k in zip(cut[:-1].tolist(), cut[1:].tolist(), part.column(0).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, *(part.column(2) for _ in extra)], ["set_key", "members", *extra]).filter(same)

    text = F.col(text_col).cast("string")
    texts = docs.select(text.alias("text"), F.xxhash64(F.col(id_col), text).alias("row_hash"))
    if count_of(wanted) <= BROADCAST_ROWS:  # eight bytes each
        texts = texts.join(F.broadcast(wanted.select("row_hash")), "row_hash", "left_semi")
    found = small_batches(texts).join(wanted, "row_hash").select("set_key", "text", *extra)
    return found.mapInArrow(tidy(run), "set_key binary, members array<bigint>" + ", sig array<int>" * len(extra)).dropDuplicates(["set_key"])


def _collisions(a: str, b: str):
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def _alike(na, nb, percent: int):
    """Sets of these sizes can reach the similarity."""
    return (F.lit(100) * F.least(na, nb)) >= (F.lit(percent) * F.greatest(na, nb))


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of set keys those with enough similarity on full sets and, if sets has signatures, enough collisions."""
    sides = [[F.col("set_key").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in sets.columns if c != "set_key")] for x in ("a", "b")]
    both = pairs.join(sets.select(sides[0]), "a").join(sets.select(sides[1]), "b")
    shared = F.size(F.array_intersect("members_a", "members_b"))
    if "sig" in sets.columns:
        shared = F.when(_collisions("sig_a", "sig_b") >= threshold, shared).otherwise(F.lit(0))
    both = both.select("a", "b", shared.cast("long").alias("shared"), (F.size("members_a") + F.size("members_b")).cast("long").alias("total"))
    return both.where((F.col("shared") > 0) & (100 * F.col("shared") >= percent * (F.col("total") - F.col("shared")))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of the nodes of edges (a, b); alternating large and small stars, cut by a
    checkpoint at each turn."""
    e = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct()
        e = checkpointed(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    stars = e.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").union(stars.select(F.col("component").alias("node"), "component").distinct())


def _pairs(a, b):
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _blocks(percent: int):
    """Compares two blocks of a long list on full sets; a spanning forest of the links between different components."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        left, right = g[g["side"] == 0], g[g["side"] == 1]
        label = {}

        def root(x: bytes) -> bytes:
            while label.get(x, x) != x:
                x = label[x]
            return x

        out = []
        rc, rn = right["component"].tolist(), right["members"].map(len).to_numpy()
        values = np.concatenate([*right["members"], np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(len(right)), rn)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        keys = right["set_key"].tolist()
        for key, members, comp in zip(left["set_key"], left["members"], left["component"], strict=True):
            m = np.sort(np.asarray(members))
            lo, hi = np.searchsorted(values, m, "left"), np.searchsorted(values, m, "right")
            n = hi - lo
            hits = owner[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            shared = np.bincount(hits, minlength=len(right))
            for j in np.flatnonzero((shared > 0) & (100 * shared >= percent * (len(m) + rn - shared))):
                x, y = root(comp), root(rc[j])
                if x != y:
                    label[max(x, y)] = min(x, y)
                    out.append((min(key, keys[j]), max(key, keys[j])))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _few(lists: DataFrame) -> DataFrame:
    """A table of lists (written), broadcast if its rows are few, so that the members of a very long list don't meet in one
    task; else Spark splits the skewed partitions of the join."""
    return F.broadcast(lists) if count_of(lists) <= BROADCAST_LISTS else lists


def links(posted: DataFrame, sets: DataFrame, threshold: int, percent: int) -> DataFrame:
    """Links (a, b) whose components are those of all confirmed pairs that meet in a list. posted: token, set_key, n_shingles."""
    spark = posted.sparkSession
    size_of = posted.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("token", "set_key").alias("h"), "set_key", "n_shingles")).alias("pivot")).where("size > 1")
    starred = posted.join(size_of, "token").where((F.col("set_key") != F.col("pivot.set_key")) & _alike(F.col("n_shingles"), F.col("pivot.n_shingles"), percent))
    tried = written(starred.select(*_pairs(F.col("set_key"), F.col("pivot.set_key"))).distinct(), "tried")
    found = written(confirmed(tried, sets, threshold, percent), "links")
    comp = written(components(found), "components")

    labelled = posted.join(comp, posted["set_key"] == comp["node"], "left").select("token", "set_key", "n_shingles", F.coalesce("component", "set_key").alias("component"))
    labelled = written(labelled, "labelled")
    in_list = labelled.groupBy("token", "component").agg(F.count("*").alias("n"))
    open_lists = in_list.groupBy("token").agg(F.sum("n").alias("size"), F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("top")).where("parts > 1 and size > 2")
    open_lists = written(open_lists.select("token", "size", F.col("top.component").alias("top")), "open")

    short = labelled.join(_few(open_lists), "token").where(F.col("size") <= SHORT_LIST)
    members = F.sort_array(F.collect_list(F.struct("set_key", "n_shingles", "component")))
    short = short.groupBy("token").agg(members.alias("m")).select("m", F.explode("m").alias("x"))
    later = F.filter("m", lambda y: (y["set_key"] > F.col("x.set_key")) & (y["component"] != F.col("x.component")) & _alike(y["n_shingles"], F.col("x.n_shingles"), percent))
    short = short.select(F.col("x.set_key").alias("a"), F.explode(F.transform(later, lambda y: y["set_key"])).alias("b")).distinct()
    short = short.join(tried, ["a", "b"], "left_anti")
    more = written(confirmed(short, sets, threshold, percent), "more")

    rest = labelled.join(_few(open_lists), "token").where(F.col("size") > SHORT_LIST).withColumn("odd", F.col("component") != F.col("top"))
    counts = rest.groupBy("token").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("all_blocks"), F.ceil(F.sum(F.when(F.col("odd"), F.col("n_shingles")).otherwise(0)) / BLOCK_SHINGLES).cast("int").alias("odd_blocks"))
    counts = written(counts, "blocked")
    rest = rest.join(_few(counts), "token").withColumn("h", F.xxhash64("set_key"))
    lefts = rest.where("odd").select("token", F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"), F.expr("int(pmod(h, odd_blocks))").alias("i"), F.lit(0).alias("side"), "set_key", "component")
    rights = rest.select("token", F.expr("int(pmod(h, all_blocks))").alias("j"), F.explode(F.sequence(F.lit(0), F.col("odd_blocks") - 1)).alias("i"), F.lit(1).alias("side"), "set_key", "component")
    grid = lefts.unionByName(rights).join(sets.select("set_key", "members"), "set_key")
    blocks = written(grid.groupBy("token", "i", "j").applyInPandas(_blocks(percent), "a binary, b binary"), "blocks")

    out = checkpointed(found.union(more).union(blocks).distinct())
    dropped(tried, found, comp, labelled, open_lists, more, counts, blocks)
    return out


def _labelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """The sketched rows, with component: its key (null for an empty set) and least_row: the row that names it."""
    labelled = rows.join(comp, rows["set_key"] == comp["node"], "left").select("doc_id", "row_hash", "set_key", "n_shingles", F.coalesce("component", "set_key").alias("component"))
    name = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_hash")
    least = labelled.where("component is not null").groupBy("component").agg(F.min(name).alias("least_row"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = labelled.join(_few(written(least, "least")), "component", "left")
    return out.withColumn("least_row", F.coalesce("least_row", F.when(F.col("component").isNotNull(), name)))


def named(rows: DataFrame, comp: DataFrame, id_col: str) -> DataFrame:
    """id_col, n_shingles, component_id, kept of the sketched rows."""
    component_id = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.coalesce("least_row.doc_id", "doc_id"))
    return _labelled(rows, comp).select(F.col("doc_id").alias(id_col), "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, num_perm: int = NUM_PERM, shingle: int = 5) -> DataFrame:
    """The rows of docs, in all their columns, without those near another: one row of each component, that of the least id
    (of several, the one of the least hash; of rows without an id, too). Rows with empty sets all stay."""
    rows, comp = _components(docs, id_col, text_col, percent, num_perm, shingle)
    found = written(_labelled(rows, comp).where("component is not null").select("row_hash", (F.col("row_hash") != F.col("least_row.row_hash")).alias("gone")), "decisions")
    row, mark = fresh(docs, "_row"), fresh(docs, "_twice")
    gone = found.where("gone").select(F.col("row_hash").alias(row)).distinct()
    twice = found.where("not gone").groupBy(F.col("row_hash").alias(row)).agg(F.count("*").alias("n")).where("n > 1").select(row, F.lit(True).alias(mark))
    if count_of(found) <= BROADCAST_ROWS:
        gone, twice = F.broadcast(gone), F.broadcast(twice)
    own = [F.col(f"`{c}`") for c in docs.columns]
    left = docs.withColumn(row, F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))).join(gone, row, "left_anti").join(twice, row, "left")
    single = left.where(F.col(mark).isNull()).select(own)
    return single.unionByName(left.where(F.col(mark)).dropDuplicates([row]).select(own))


def _components(docs: DataFrame, id_col: str, text_col: str, percent: int, num_perm: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row, and the components of set keys (node, component)."""
    rows = written(sketch(docs, id_col, text_col, num_perm, shingle), "sketch")
    sets = written(rows.where("set_key is not null").groupBy("set_key").agg(F.min("n_shingles").alias("n_shingles"), F.min("row_hash").alias("row_hash"), F.first("sig").alias("sig")), "sets")

    threshold = match_threshold(percent / 100, num_perm)
    value = F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    tokens = sets.select("set_key", "n_shingles", F.posexplode("sig").alias("place", "value")).select("set_key", "n_shingles", F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(value).alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    ranked = tokens.join(shared, "token").groupBy("set_key", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("tokens")).where(F.size("tokens") >= threshold)
    prefix = F.slice("tokens", 1, F.size("tokens") - (threshold - 1))
    posted = written(ranked.select("set_key", "n_shingles", F.explode(prefix).alias("t")).select("t.token", "set_key", "n_shingles"), "posted")

    wanted = written(posted.select("set_key").distinct().join(sets.select("set_key", "row_hash", "sig"), "set_key"), "wanted")
    full = written(full_sets(docs, id_col, text_col, wanted, shingle), "full")
    edges = links(posted, full, threshold, percent)
    comp = checkpointed(components(edges))
    dropped(posted, full, sets, wanted)

    return rows, comp


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, num_perm: int = NUM_PERM, shingle: int = 5) -> DataFrame:
    """One row per input row: id_col, n_shingles long, component_id (least id of its component), kept boolean."""
    return named(*_components(docs, id_col, text_col, percent, num_perm, shingle), id_col)

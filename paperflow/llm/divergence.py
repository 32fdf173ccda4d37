"""Source divergence audit: how far each source's use of terms is from the other sources of its language.

Terms are maximal runs of ASCII letters and characters beyond ASCII, with only A-Z lower-cased. A language keeps the V terms that
at least min_docs of its documents hold. A kept term has p = 1 + floor(SCALE * (count + 1) / (N + V)) in a group (language, source)
or in a whole language; N is the sum of counts over kept terms. The distance of two values is f(p, q) = floor((p - q)^2 / q).

p depends on a term's count alone, so the sum of f over all terms needs only, for each pair of counts, the number of terms that have
the one count here and the other there. Kept terms are dealt to blocks of about BLOCK_TERMS, each with a bit in its block. For each
(group, count) a block has a bitset of its terms; the AND of two bitsets and its popcount is a joint cell, multiplied by f, and the
cells of count zero are what the others leave of each bitset (the complement). A count that only a few terms of a block have is kept
as the places of its bits, and those bits are tested one by one, as an AND with so sparse a bitset would be. Blocks are independent
tasks whose sums Spark adds up; what a block holds is bounded by its terms times the groups that use them, and what it returns by the
pairs of sources, which are the result's rows.

Nulls and odd input: a null text is empty, a null language or source is ''; a group without terms is a group (N = 0); without kept
terms (V = 0) pairs have the value 0; a language with one source has no pairs; ties go by the item's UTF-8 bytes; repeated rows count
as documents; very long texts are counted whole in slices; other columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, small_batches, tidy, utf8, written

SCALE = 1_000_000_000
BLOCK_TERMS = 8192
DENSE_TERMS = 64
TOP_TERMS = 200
CHUNK_BYTES = 8 << 20
PAIR_CELLS = 1 << 22
SMALL_ROWS = 50_000  # languages and groups up to which they are broadcast
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and the number of the text that each is from."""
    raw, at = utf8(texts)
    inside = _LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    kept = np.concatenate([[0], np.cumsum(inside)])
    offsets = np.append(kept[starts], kept[-1]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]]))
    return terms, np.searchsorted(at, starts, "right") - 1


def counted(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """lang, source, term, n (occurrences), docs (texts that hold it) of these texts."""
    groups: dict[tuple[str, str], int] = {}
    group = np.array([groups.setdefault(x, len(groups)) for x in zip(langs.to_pylist(), sources.to_pylist(), strict=True)], np.int64)
    terms, of = terms_of(texts)
    coded = terms.dictionary_encode()
    size = len(coded.dictionary)
    code = coded.indices.to_numpy().astype(np.int64)
    held = np.unique(of * size + code) if size else np.zeros(0, np.int64)
    key, n = np.unique(group[of] * size + code, return_counts=True)
    docs = np.zeros(len(key), np.int64)
    if size:
        np.add.at(docs, np.searchsorted(key, group[held // size] * size + held % size), 1)
    named = list(groups) or [("", "")]
    which = pa.array(key // max(size, 1))
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in named]).take(which), pa.array([x[1] for x in named]).take(which), coded.dictionary.take(pa.array(key % max(size, 1))), pa.array(n), pa.array(docs)],
        ["lang", "source", "term", "n", "docs"],
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            yield from (counted(*b.columns) for b in whole.to_batches())
            waiting, size = [], 0
    if waiting:
        yield from (counted(*b.columns) for b in pa.Table.from_batches(waiting).combine_chunks().to_batches())


def kept_terms(docs: DataFrame, text_col: str, lang_col: str, source_col: str, min_docs: int) -> DataFrame:
    """lang, source, term, n, lang_count: counts of kept terms in groups, above 0, and in their language. Counted in tasks first, then
    one shuffle by (lang, term)."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = small_batches(docs).select(named(lang_col).alias("lang"), named(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    parts = rows.mapInArrow(tidy(_count), "lang string, source string, term string, n long, docs long")
    counts = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    summed = counts.withColumn("docs", F.sum("docs").over(whole)).withColumn("lang_count", F.sum("n").over(whole))
    return summed.where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "lang_count")


def sized(df: DataFrame) -> DataFrame:
    """A broadcast hint for rows that are few, by a count; others are joined as Spark finds best."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def scaled(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact in 64 bits for totals up to 9e15: a long division in steps of 1000."""
    out, left = np.divmod(count.astype(np.int64) + 1, total)
    for _ in range(3):
        more, left = np.divmod(left * 1000, total)
        out = out * 1000 + more
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def bitset(places: np.ndarray, words: int) -> np.ndarray:
    bits = np.zeros(words * 64, np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _levels(places: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(count, number of terms, bitset as far as its last word that isn't zero, or sorted places as int32) for each count."""
    order = np.lexsort((places, counts))
    places, counts = places[order], counts[order]
    cut = np.flatnonzero(np.diff(counts)) + 1
    out = []
    for own, c in zip(np.split(places, cut), counts[np.concatenate([[0], cut])].tolist(), strict=True):
        out.append((c, len(own), bitset(own, int(own[-1]) // 64 + 1).tobytes() if len(own) >= DENSE_TERMS else own.astype(np.int32).tobytes()))
    return out


def level_rows(block: pa.Table) -> pa.Table:
    """One block's rows (lang, block, source, term, n) as levels: lang, block, source, n, terms, bits; the row of source null has
    the number of the block's terms."""
    lang, number = block.column("lang")[0], block.column("block")[0]
    place = pc.rank(block.column("term").combine_chunks(), tiebreaker="dense").to_numpy() - 1
    coded = block.column("source").combine_chunks().dictionary_encode()
    code, n = coded.indices.to_numpy(), block.column("n").to_numpy()
    rows: list[tuple] = [(None, 0, int(place.max()) + 1, None)]
    for i, source in enumerate(coded.dictionary.to_pylist()):
        mine = code == i
        rows += [(source, *x) for x in _levels(place[mine], n[mine])]
    cols = list(zip(*rows, strict=True))
    return pa.table({"lang": pa.array([lang.as_py()] * len(rows), pa.string()), "block": pa.array([number.as_py()] * len(rows), pa.int64()), "source": pa.array(cols[0], pa.string()), "n": pa.array(cols[1], pa.int64()), "terms": pa.array(cols[2], pa.int64()), "bits": pa.array(cols[3], pa.binary())})


class Levels:
    """A group's levels in a block: bitsets of the frequent counts, every term's count by place."""

    def __init__(self, rows: list[tuple[int, int, bytes]], n_terms: int, total: int):
        words = -(-n_terms // 64)
        dense = [(c, b) for c, size, b in rows if size >= DENSE_TERMS]
        self.bits = np.zeros((len(dense), words), np.uint64)
        for i, (_, b) in enumerate(dense):
            own = np.frombuffer(b, np.uint64)
            self.bits[i, : len(own)] = own
        self.dense_p = scaled(np.array([c for c, _ in dense], np.int64), total)
        self.zero_p = scaled(np.zeros(1, np.int64), total)[0]
        self.level_p = scaled(np.array([c for c, _, _ in rows], np.int64), total)
        self.sizes = np.array([size for _, size, _ in rows], np.int64)
        self.p = np.full(n_terms, self.zero_p, np.int64)  # by place
        self.used = np.zeros(n_terms, bool)
        sparse = [(np.frombuffer(b, np.int32), c) for c, size, b in rows if size < DENSE_TERMS]
        self.places = np.concatenate([x for x, _ in sparse]) if sparse else np.zeros(0, np.int32)
        self.sparse = np.zeros(n_terms, bool)
        self.sparse[self.places] = True
        if sparse:
            self.p[self.places] = scaled(np.repeat([c for _, c in sparse], [len(x) for x, _ in sparse]), total)
        for bits, p in zip(self.bits, self.dense_p, strict=True):
            self.p[np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little")[:n_terms])] = p
        self.used[self.places] = True
        for bits in self.bits:
            self.used |= np.unpackbits(bits.view(np.uint8), bitorder="little")[:n_terms].astype(bool)


def joint(a: Levels, b: Levels) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """The cells of two groups in a block: (p in a, p in b, number of terms) where both counts are above zero, where one is zero, by
    complement, and the number of terms that neither has."""
    n_terms, cells = len(a.p), []
    if len(a.bits) and len(b.bits):
        step = max(1, PAIR_CELLS // max(1, b.bits.size))
        for lo in range(0, len(a.bits), step):
            n = np.bitwise_count(a.bits[lo : lo + step, None] & b.bits[None]).sum(axis=2, dtype=np.int64)
            cells.append((np.repeat(a.dense_p[lo : lo + step], len(b.bits)), np.tile(b.dense_p, n.shape[0]), n.ravel()))
    places = np.concatenate([a.places[b.used[a.places]], b.places[a.used[b.places] & ~a.sparse[b.places]]])
    cells.append((a.p[places], b.p[places], np.ones(len(places), np.int64)))
    pa_, pb, n = (np.concatenate(x) for x in zip(*cells, strict=True))
    left = []
    for own, p in ((a, pa_), (b, pb)):
        order = np.argsort(own.level_p, kind="stable")
        met = np.zeros(len(order), np.int64)
        if len(order):
            levels, first = np.unique(own.level_p[order], return_index=True)  # counts that share a p are one level
            np.add.at(met, np.searchsorted(levels, p[n > 0]), n[n > 0])
            sizes = np.add.reduceat(own.sizes[order], first)
            left.append((levels, sizes - met[: len(levels)]))
        else:
            left.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    (la, na), (lb, nb) = left
    cells.append((la, np.full(len(la), b.zero_p), na))
    cells.append((np.full(len(lb), a.zero_p), lb, nb))
    return cells, int(n_terms - n.sum() - na.sum() - nb.sum())


def pair_rows(block: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block's levels and groups (lang, source, n, terms, bits, total) as lang, source, item, value for every ordered pair of
    sources. Rows with bits are levels, the row without a source has the number of the block's terms, other rows are the groups."""
    rows: dict[str, list] = {}
    totals: dict[str, int] = {}
    n_terms, lang = 0, None
    for lang, source, n, terms, bits, total in (x for b in block for x in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "n", "terms", "bits", "total")), strict=True)):
        if total is not None:
            totals[source] = total
        elif source is None:
            n_terms = terms
        else:
            rows.setdefault(source, []).append((n, terms, bits))
    names = sorted(totals)
    levels = [Levels(rows.get(s, []), n_terms, totals[s]) for s in names]
    for i, a in enumerate(levels):
        here, there, value = [], [], []
        for j in range(i + 1, len(levels)):
            b, ahead, back = levels[j], 0, 0
            cells, neither = joint(a, b)
            for p, q, n in cells:
                ahead += int((distance(p, q) * n).sum())
                back += int((distance(q, p) * n).sum())
            here += [names[i], names[j]]
            there += [names[j], names[i]]
            value += [ahead + neither * int(distance(a.zero_p, b.zero_p)), back + neither * int(distance(b.zero_p, a.zero_p))]
        if value:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value)), pa.array(here), pa.array(there), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: for each group the other sources of its language by divergence (part pair), and the top
    terms that it uses more than its language does (part term)."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    terms = written(kept_terms(docs, text_col, lang_col, source_col, min_docs), "terms")
    per_lang = written(terms.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_distinct("term").alias("v")), "languages")
    sums = terms.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select(named(lang_col).alias("lang"), named(source_col).alias("source")).distinct()
    groups = written(groups.join(sums, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0), "groups")

    number = F.pmod(F.xxhash64("lang", "term"), F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS)))
    in_blocks = terms.join(sized(per_lang), "lang").select("lang", number.alias("block"), "source", "term", "n").repartition("lang", "block")
    levels = written(in_blocks.groupBy("lang", "block").applyInArrow(level_rows, "lang string, block long, source string, n long, terms long, bits binary"), "levels")
    shown = groups.join(levels.select("lang", "block").distinct(), "lang")
    shown = shown.select("lang", "block", "source", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("terms"), F.lit(None).cast("binary").alias("bits"), (F.col("n") + F.col("v")).alias("total"))
    both = levels.withColumn("total", F.lit(None).cast("long")).unionByName(shown)
    sent = both.groupBy("lang", "block").applyInArrow(pair_rows, "lang string, source string, item string, value long")
    pairs = written(sent.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pairs")
    dropped(levels, per_lang)
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").where("source <> item").join(pairs, ["lang", "source", "item"], "left").na.fill(0, ["value"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    share = lambda n, total: f"1 + CAST({SCALE} AS DECIMAL(10, 0)) * ({n} + 1) div ({total})"
    used = terms.join(sized(groups.withColumnRenamed("n", "group_n")), ["lang", "source"])
    used = used.select("lang", "source", F.col("term").alias("item"), F.expr(share("n", "group_n + v")).alias("p"), F.expr(share("lang_count", "lang_n + v")).alias("q"))
    used = used.where("p > q").withColumn("value", F.expr("(p - q) * (p - q) div q"))
    best = used.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))

"""Divergence of sources, nearest neighbours and interactions of filters: brute force, SQL, odd inputs."""

import collections
import itertools
import random
import re

import numpy as np
import oracle
import pyarrow as pa
import pytest

pytest.importorskip("paperflow.llm")

from paperflow.llm import divergence, filter_audit, hnsw  # noqa: E402
from paperflow.llm import queries as q  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n long, docs long, block long, mask int, term string, part string"
SPARE = (9, 9, 9, 9, "x", "y")


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_filter_interactions"])
def test_audit_sql(spark, sf, name):
    assert oracle.difference(spark, oracle.database(sf), q.QUERIES[name], q.ORACLE_SQL[name], sf) is None


# --- divergence of sources


def divergences_of(rows, min_docs=3, top=200):
    low = {i: i + 32 for i in range(65, 91)}
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for text, lang, source in rows:
        group = (lang or "", source or "")
        groups.add(group)
        terms = [t.translate(low) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        counts[group].update(terms)
        docs[group[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        sources = [s for x, s in groups if x == lang]
        n = {s: {t: c for t, c in counts[lang, s].items() if t in kept} for s in sources}
        total = {s: sum(n[s].values()) for s in sources}
        whole = sum((collections.Counter(n[s]) for s in sources), collections.Counter())
        p = lambda c, size: 1 + 10**9 * (c + 1) // (size + len(kept))  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(o, sum(f(p(n[s].get(t, 0), total[s]), p(n[o].get(t, 0), total[o])) for t in kept)) for o in sources if o != s]
            terms = [(t, p(c, total[s]), p(whole[t], sum(total.values()))) for t, c in n[s].items()]
            terms = [(t, f(a, b)) for t, a, b in terms if a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, r) for r, (item, v) in enumerate(ranked, 1) if part == "pair" or r <= top]
    return sorted(out)


def table_of(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def texts(seed, n, vocabulary):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÇéβД") for _ in range(rng.randint(1, 5))) for _ in range(vocabulary)]
    out = []
    for i in range(n):
        text = rng.choice([" ", "\n", "1-2 "]).join(words[int(len(words) * rng.random() ** 3)].upper() if rng.random() < 0.2 else words[int(len(words) * rng.random() ** 3)] for _ in range(rng.randint(0, 90)))
        out.append((i, text, rng.choice(["en", "en", "en", None, ""]), rng.choice(["a", "a", "a", "b", "c", None]), *SPARE))
    return out


@pytest.mark.parametrize(("dense", "block"), [(64, 8192), (2, 100), (1, 64)])
def test_divergences_match_brute_force(spark, monkeypatch, dense, block):
    monkeypatch.setattr(divergence, "DENSE_TERMS", dense)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    rows = texts(1, 240, 700) + [(1000, "word " * 60_000, "en", "long", *SPARE), (1001, None, "tr", "a", *SPARE), (1002, "only one", "de", "a", *SPARE), (1002, "only one", "de", "a", *SPARE), (None, "", "de", "b", *SPARE)]
    got = table_of(divergence.divergences(spark.createDataFrame(rows, DOC), top=20))
    assert got == divergences_of([r[1:4] for r in rows], top=20)


def test_divergences_odd(spark):
    empty = divergence.divergences(spark.createDataFrame([], DOC))
    assert empty.count() == 0 and empty.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [(1, None, None, None, *SPARE), (2, "...", "", "b", *SPARE), (3, "1 2 3", None, "c", *SPARE)]  # no kept term at all
    got = table_of(divergence.divergences(spark.createDataFrame(rows, DOC)))
    assert got == divergences_of([r[1:4] for r in rows]) and {r[4] for r in got} == {0} and len(got) == 6


@pytest.mark.parametrize("dense", [1, 3, 1000])
def test_joint_cells_cover_every_term(monkeypatch, dense):
    monkeypatch.setattr(divergence, "DENSE_TERMS", dense)
    rng = np.random.default_rng(dense)
    n_terms, total = 300, 5000
    counts = [np.minimum(rng.geometric(0.3, n_terms), 9) * (rng.random(n_terms) < 0.7) for _ in range(2)]
    levels = [divergence.Levels(divergence._levels(np.flatnonzero(c), c[c > 0]), n_terms, total) for c in counts]
    cells, neither = divergence.joint(*levels)
    got = collections.Counter()
    for p, r, n in cells:
        for x in zip(p.tolist(), r.tolist(), n.tolist(), strict=True):
            got[x[:2]] += x[2]
    got[int(levels[0].zero_p), int(levels[1].zero_p)] += neither
    want = collections.Counter(zip(*(divergence.scaled(c, total).tolist() for c in counts), strict=True))
    assert {k: v for k, v in got.items() if v} == dict(want)


def test_scaled_is_exact():
    for count, total in [(0, 1), (10**12, 10**13), (8 * 10**15, 9 * 10**15), (6, 7), (123_456_789_012, 999_999_999_989)]:
        assert divergence.scaled(np.array([count]), total)[0] == 1 + 10**9 * (count + 1) // total


def test_terms_of_texts():
    terms, of = divergence.terms_of(pa.array(["Ab1cÉ", None, "", "x", "y z!", "...", "ß"]))
    assert terms.to_pylist() == ["ab", "cÉ", "x", "y", "z", "ß"] and of.tolist() == [0, 0, 3, 4, 4, 6]


# --- nearest neighbours


def brute_nearest(rows, k, every):
    """{query id: [(score, vec_id)]} best first."""
    ok = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % every == 0:
            found = sorted((-float((w * v).sum()), j) for j, w in ok if j != i and len(w) == len(v))
            out[i] = [(-s, j) for s, j in found[:k]]
    return out


def recall(got, want):
    hit = [len({j for _, j in want[i]} & {r.vec_id for r in got if r.query_id == i}) / max(1, len(want[i])) for i in want]
    return float(np.mean(hit))


def test_nearest_recall_on_the_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute_nearest(rows, 20, 20), q.op12_nearest_neighbours(spark, sf).collect()
    assert {r.query_id for r in got} == set(want) and recall(got, want) >= 0.9
    for i in want:
        own = sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and i not in {r.vec_id for r in own}
        assert [(r.score, -r.vec_id) for r in own] == sorted(((r.score, -r.vec_id) for r in own), reverse=True)


def test_nearest_of_several_shards_and_lengths(spark):
    """Unequal lengths of vectors (largest inner product isn't the least angle), two dimensions, shards, copies in all of them."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)) * rng.uniform(0.5, 2)) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(600)] + [(3000 + i, rng.normal(size=3)) for i in range(90)]
    rows = [(i, v.tolist()) for i, v in rows]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, dim int, shard int")
    want, got = brute_nearest(rows, 20, 20), hnsw.nearest(table, shard_rows=400).collect()
    assert {r.query_id for r in got} == set(want) and recall(got, want) >= 0.97
    scores = {(i, j): s for i, found in want.items() for s, j in found}
    assert all(r.score == pytest.approx(scores[r.query_id, r.vec_id], rel=1e-12) for r in got if (r.query_id, r.vec_id) in scores)
    copies = [r.vec_id for r in sorted((r for r in got if r.query_id == 2000), key=lambda r: r["rank"])]
    assert copies == sorted(copies) and len(copies) == 20 or recall(got, want) == 1.0


def test_nearest_odd(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, []), (80, [float("nan"), 1.0]), (100, [None, 1.0]), (120, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [1.0, 2.0]), (2, [1.0, 5.0]), (2, [1.0, 5.0]), (3, [9.0, 9.0, 9.0]), (140, [0.0, 1.0]), (140, [0.0, -1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hnsw.nearest(table).collect()
    own = lambda i: [(r["rank"], r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])]
    assert {r.query_id for r in got} == {0, 140}
    assert own(0) == [(1, 1, 1.0), (2, 2, 1.0), (3, 2, 1.0), (4, 140, 0.0), (5, 140, -0.0)]
    assert sorted(own(140)) == sorted([(1, 2, 5.0), (2, 2, 5.0), (3, 1, 2.0), (4, 0, 0.0), (1, 0, 0.0), (2, 1, -2.0), (3, 2, -5.0), (4, 2, -5.0)])
    for few in ([], [(0, [1.0])]):
        out = hnsw.nearest(spark.createDataFrame(few, "vec_id long, embedding array<float>"))
        assert out.count() == 0 and out.columns == ["query_id", "rank", "vec_id", "score"]


def test_graph_is_flat_and_reaches_every_node():
    rng = np.random.default_rng(5)
    vectors = hnsw.Graph.augmented(rng.normal(size=(900, 12)))
    graph = hnsw.Graph.build(vectors, width=8, ef=40)
    again = hnsw.Graph.build(vectors, width=8, ef=40)
    assert all((a == b).all() for a, b in zip(graph.links, again.links, strict=True))  # a lost task makes the same shard again
    assert len(graph.links) > 1 and graph.links[0].shape == (901, 16) and graph.links[1].shape == (901, 8)
    seen, at = {graph.entry}, [graph.entry]
    while at:
        near = set(graph.links[0][at].ravel().tolist()) - seen - {-1}
        seen |= near
        at = list(near)
    assert len(seen) >= 890
    for links in graph.links:
        assert (links[-1] == -1).all()
        for i, row in enumerate(links[:-1]):
            row = row[row >= 0].tolist()
            assert len(row) == len(set(row)) and i not in row


# --- interactions of filters


def interactions_of(docs, labels):
    """Every order applied to every document, one after the other."""
    good, toxic = {i for i, a, _ in labels if a == 1 and i is not None}, {i for i, _, b in labels if b == 1 and i is not None}
    fails = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        smaller = any((x or "") == t and (j is not None and (i is None or j < i)) for j, x, _ in docs)
        f = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), smaller]
        fails.append((lang or "", i, {x for x, y in zip("ABCDE", f, strict=True) if y}))
    out, shapley = {}, collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        left = fails
        for step, x in enumerate(order, 1):
            for part in {p for p, _, _ in fails}:
                mine = [r for r in left if r[0] == part]
                gone = [r for r in mine if x in r[2]]
                everyone = [r for r in fails if r[0] == part and x in r[2]]
                out[part, order, step] = [len(mine) - len(gone), len(gone), len(everyone) - len(gone), sum(r[2] == {x} for r in everyone), sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone)]
                shapley[part, x] += len(gone)
            left = [r for r in left if x not in r[2]]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_interactions_match_brute_force(spark):
    rng = random.Random(2)
    docs = []
    for i in range(120):
        words = [f"w{rng.randrange(rng.choice([20, 2000]))}" for _ in range(rng.choice([3, 199, 200, 260]))]
        text = rng.choice([" ", "\n", "\x0b\t"]).join(words) + rng.choice(["", "", " #", " 5%", " ABCDEF " * 40])
        docs.append((i, rng.choice([text, docs[-1][1] if docs else text]), rng.choice(["en", "de", None, ""])))
    docs += [(500, None, "en"), (501, "", "en"), (502, " \n ", None), (None, "", "en"), (None, "x y", "de"), (None, "x y", "de"), (503, "x y", "fr"), (503, "x y", "fr"), (504, "many words " * 60_000, "en")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 130, 2)] + [(4, 1, None), (6, None, 1), (None, 1, 1), (500, 1, 1)]
    table = spark.createDataFrame([(*r, "s", *SPARE) for r in docs], DOC)
    got = filter_audit.interactions(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == interactions_of(docs, labels)


def test_interactions_of_nothing(spark):
    got = filter_audit.interactions(spark.createDataFrame([], DOC), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got.count() == 0 and got.columns == COLUMNS
    one = filter_audit.interactions(spark.createDataFrame([(1, None, None, None, *SPARE)], DOC), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and {r.shapley for r in one if r.filter_order[r.step - 1] == "A"} == {120}


def test_topics_are_learned_from_every_text(spark):
    """Rounds over all 5,000 rows as a plain loop makes them: words that stand in few texts count in idf and centres."""
    from paperflow.llm import mixing

    texts = [f"{'alpha beta' if i % 2 else 'gamma delta'} w{i % 7} {'rare' if i % 1250 == 3 else ''}" for i in range(5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = mixing.learn_topics(docs, "doc_id", "text", topics=4)
    doc, bucket, times, _ = mixing.word_counts(pa.array(texts))
    x = np.zeros((len(texts), mixing.WORD_BUCKETS))
    x[doc, bucket] = times
    idf = np.log((1 + len(texts)) / (1 + (x > 0).sum(0))) + 0.01
    assert np.allclose(model.idf, idf)
    x = np.log1p(x) * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mine = (x @ model.centres.T).argmax(1)  # the rounds have come to rest
    sums = np.stack([x[mine == k].sum(0) for k in range(len(model.centres))])
    assert np.allclose(model.centres, sums / np.linalg.norm(sums, axis=1, keepdims=True), atol=1e-5)
    again = mixing.learn_topics(docs.repartition(7), "doc_id", "text", topics=4)
    assert (again.centres == model.centres).all()


def test_topics_rounds_end_when_they_gain_nothing(spark, monkeypatch):
    """Over texts without topics, whose clusters creep on: few passes, after which a further round as a plain loop gains next to nothing."""
    from paperflow.llm import mixing

    rng, passes, totals = np.random.default_rng(3), [], mixing._totals
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.4, 30) % 400) for _ in range(3000)]
    monkeypatch.setattr(mixing, "_totals", lambda *a: passes.append(1) or totals(*a))
    model = mixing.learn_topics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "doc_id", "text")
    assert len(passes) < 25
    doc, bucket, times, _ = mixing.word_counts(pa.array(texts))
    x = np.zeros((len(texts), mixing.WORD_BUCKETS))
    x[doc, bucket] = np.log1p(times) * model.idf[bucket]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ model.centres.T
    sums = np.stack([x[near.argmax(1) == k].sum(0) for k in range(len(model.centres))])
    assert np.linalg.norm(sums, axis=1).sum() < near.max(1).sum() * (1 + 1e-3)

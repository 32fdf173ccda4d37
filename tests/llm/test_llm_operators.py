"""The corpus operators against brute force, round trips and held-out accuracy, and their odd inputs."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("paperflow.llm")

from paperflow.llm import common, extraction, fingerprints, langid, mixing, neardup, packing, quality, search, shards, warc  # noqa: E402
from paperflow.llm import queries as q  # noqa: E402

import public_tokenizers  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, component string, sets long, _row int, _mix int, held_out int"
ODD = [
    (1, None, "en", "a", 0, "x", "y", 1, 1, 1, 1),
    (2, "", None, None, 0, "x", "y", 1, 1, 1, 1),
    (3, "  \n\t ", "en", "a", 3, "x", "y", 1, 1, 1, 1),
    (None, "one two three four five six seven", "en", "a", 30, "x", "y", 1, 1, 1, 1),
    (5, "one two three four five six seven", "en", None, 30, "x", "y", 1, 1, 1, 1),
    (5, "one two three four five six seven", "en", None, 30, "x", "y", 1, 1, 1, 1),
    (6, "12345 !!! ???", "de", "b", 12, "x", "y", 1, 1, 1, 1),
    (7, "word " * 60_000, "en", "b", 300_000, "x", "y", 1, 1, 1, 1),
    (8, "É\x00ß 日本語 \U0001f600 ́", "fr", "b", 10, "x", "y", 1, 1, 1, 1),
    (9, "alone", "en", "b", 5, "x", "y", 1, 1, 1, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words_of(text):
    low = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    return re.findall(rb"[^\x20\x09-\x0d]+", low)


def sets_of(pairs):
    out = []
    for _, text in pairs:
        w = words_of(text)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute_components(pairs, percent):
    """component (row numbers) of every row."""
    sets, label = sets_of(pairs), list(range(len(pairs)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    posted = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in posted[g]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
        for g in s:
            posted[g].append(i)
    return [root(i) for i in range(len(pairs))], [len(s) for s in sets]


def near_texts(seed=0, groups=6, copies=60):
    """Groups of near copies of one base, some with many edits, and texts that share half of a common passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage, out = [word() for _ in range(60)], []
    for g in range(groups):
        base = [word() for _ in range(120)]
        for c in range(copies if g < 2 else 4):
            w = base[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    out += [" ".join(passage + [word() for _ in range(45)]) for _ in range(80)]
    rng.shuffle(out)
    return list(enumerate(out))


# --- near-duplicates


@pytest.mark.parametrize("percent", [80, 85])
def test_near_components_match_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT_LIST", 6)  # the long lists' way is taken too
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 1500)
    pairs = near_texts()
    got = neardup.near_components(spark.createDataFrame(pairs, "doc_id long, text string"), percent=percent).toPandas().set_index("doc_id")
    component, sizes = brute_components(pairs, percent)
    for (i, _), c, n in zip(pairs, component, sizes, strict=True):
        assert (got.component_id[i], got.n_shingles[i], got.kept[i]) == (c, n, c == i)


def test_near_components_of_documents(spark, sf, docs):
    pairs = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    got = q.op5_minhash_near_dedup(spark, sf).toPandas().set_index("doc_id")
    component, sizes = brute_components(pairs, 85)
    assert all(got.component_id[i] == pairs[c][0] and got.n_shingles[i] == n for (i, _), c, n in zip(pairs, component, sizes, strict=True))


def test_near_components_odd(spark, odd):
    got = [tuple(r) for r in neardup.near_components(odd).collect()]
    assert sorted(got, key=repr) == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 3, 5, False), (5, 3, 5, True), (5, 3, 5, True), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 8, True), (9, 1, 9, True)], key=repr)
    assert neardup.near_components(odd.limit(0)).count() == 0


def test_deduplicated_keeps_one_row_of_each_group(spark, odd):
    out = neardup.deduplicated(odd)
    assert out.columns == odd.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 5, 6, 7, 8, 9]


def test_match_threshold():
    for s in (0.8, 0.85):
        t = neardup.match_threshold(s, 48)
        below = lambda k: sum(math.comb(48, i) * s**i * (1 - s) ** (48 - i) for i in range(k))
        assert below(t) <= 1e-8 < below(t + 1)


def test_word_hashes_split_as_the_pattern_does():
    texts = ["A b\tc\n\nD", "", "  x ", None, "é É", "word " * 300_000]
    import pyarrow as pa

    h, at = common.word_hashes(*common.utf8(pa.array(texts)))
    assert np.diff(at).tolist() == [len(words_of(t)) for t in texts]
    assert h[0] == common.word_hashes(*common.utf8(pa.array(["a"])))[0][0] and len(set(h[at[5] :].tolist())) == 1


# --- fingerprints


def test_edited_fingerprints(spark, sf, docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = q.op10_fingerprints(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(rows)
    sets = dict(zip([i for i, _ in rows], sets_of(rows), strict=True))
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        assert got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest() and got.n_chars[i] == len(text)
        e = sets_of([(0, edited)])[0]
        assert abs(got.near_edited[i] - len(sets[i] & e) / len(sets[i] | e)) < 0.25
    by_text = collections.defaultdict(set)
    for i, text in rows:
        by_text[text].add(got.fingerprint[i])
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprints_in_many_parts_and_odd(spark, odd, docs):
    few = fingerprints.edited_fingerprints(docs).toPandas().set_index("doc_id").sort_index()
    many = fingerprints.edited_fingerprints(docs, partition_chars=20_000).toPandas().set_index("doc_id").sort_index()
    pd.testing.assert_frame_equal(few, many)
    got = fingerprints.edited_fingerprints(odd)
    assert got.count() == len(ODD) and fingerprints.edited_fingerprints(odd.limit(0)).count() == 0
    one = fingerprints.edited_fingerprints(odd.where("doc_id = 9")).first()
    assert one.near_next == 1.0


def test_edited_fingerprints_of_repeated_ids(spark):
    """Rows of one id, or without one, are in the order of a hash of the text; each has its own next document."""
    import pyspark.sql.functions as F

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(1, 30)))) for i in [None] * 300 + [50] * 200 + list(range(100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = [(r.doc_id, r.text, r.h) for r in docs.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h")).collect()]
    order = sorted(hashed, key=lambda r: (r[0] is None, -(r[0] or 0), r[2], r[1]))
    want = collections.Counter((r[0], hashlib.sha256(fingerprints.edit_half(r[1], n[1]).encode()).hexdigest()) for r, n in zip(order, [*order[1:], order[0]], strict=True))
    got = collections.Counter((r.doc_id, r.edited_sha256) for r in fingerprints.edited_fingerprints(docs, partition_chars=900).collect())
    assert got == want


def test_near_duplicates_by_bands(spark):
    pairs = near_texts(3, groups=3, copies=12)
    got = fingerprints.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).toPandas().set_index("doc_id")
    component, _ = brute_components(pairs, 80)
    wrong = sum(got.component_id[i] != c for (i, _), c in zip(pairs, component, strict=True))
    assert wrong <= 0.05 * len(pairs)


def test_near_duplicates_at_the_threshold(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    pairs = []
    for _ in range(300):  # 104 of 128 shingles in common
        base = [word() for _ in range(120)]
        pairs += [" ".join(base), " ".join(base[:-12] + [word() for _ in range(12)])]
    pairs = list(enumerate(pairs))
    got = fingerprints.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).toPandas().set_index("doc_id")
    component, _ = brute_components(pairs, 80)
    assert len(set(component)) == 300 and all(got.component_id[i] == c for (i, _), c in zip(pairs, component, strict=True))


def test_near_duplicates_of_the_table(spark, sf, docs):
    got = q.op10_near_duplicates(spark, sf).toPandas().set_index("doc_id")
    pairs = sorted((r.doc_id, r.text) for r in docs.collect())
    component, _ = brute_components(pairs, 80)
    assert [got.component_id[i] for i, _ in pairs] == [pairs[c][0] for c in component]


# --- language and quality


def test_language_accuracy_on_held_out_rows(spark, sf, docs):
    got = q.op2_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) and (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(got.doc_id, got.held_out, strict=True))


def test_language_odd(spark, odd):
    got = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 6)] == ["und"] * 4 and got[1].rejected and not got[None].held_out
    assert langid.identify(odd.limit(0)).count() == 0
    kept = langid.accepted(odd)
    assert kept.columns == odd.columns and {1, 2, 3, 6}.isdisjoint({r.doc_id for r in kept.collect()})
    unlabelled = odd.withColumn("lang", odd["lang"].substr(99, 1).cast("string")).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_codes_are_apart():
    for n in (2, 3, 4, 5, 9, 30):
        code = langid.code_matrix(n)
        assert len({tuple(c) for c in code.tolist()}) == n
    m = langid.Model(list("abcd"), langid.code_matrix(4), np.eye(7, dtype=np.float32), np.zeros(7, np.float32))
    flipped = langid.code_matrix(4)[2].copy()
    flipped[0] *= -1
    assert m.radius == 1 and m.decode(flipped[None] * 4.0)[0][0] == 2


def test_two_languages_correct_no_bit():
    m = langid.Model(list("ab"), langid.code_matrix(2), np.eye(1), np.zeros(1))
    assert m.code.shape == (2, 1) and m.radius == 0


def test_languages_of_all_rows_by_plain_loops(spark, docs):
    m = langid.train(docs, "doc_id", "text", "lang")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}

    def plain(text):
        low = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in text.lower().encode())
        counts = collections.Counter()
        for width in (2, 3):
            for i in range(len(low) - width + 1):
                g = int.from_bytes(low[i : i + width], "big")
                counts[((g * 2654435761 + width * 40503) * 2246822519 % 2**32) >> 20] += 1
        norm = math.sqrt(sum(counts.values())) or 1
        margins = [sum(m.weights[h, b] * math.sqrt(c) / norm for h, c in counts.items()) + m.bias[b] for b in range(m.code.shape[1])]
        losses = [sum(math.log1p(math.exp(-x * c)) for x, c in zip(margins, code, strict=True)) for code in m.code]
        share = [math.exp(min(losses) - x) for x in losses]
        best = share.index(max(share))
        return m.languages[best], share[best] / sum(share)

    for r in docs.collect():
        name, score = plain(r.text or "") if any(c.isalpha() for c in r.text or "") else ("und", 0.0)
        assert got[r.doc_id].lang_pred == name and abs(got[r.doc_id].score - score) < 1e-3


def test_quality_accuracy_on_held_out_rows(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = q.op3_quality(spark, sf).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.quality == held.predicted).mean() > 0.9 and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    d = quality.WORD_BUCKETS + len(quality.STATS) * quality.BINS
    m = quality.Model(np.zeros((len(quality.STATS), quality.BINS - 1)), 0.3, rng.normal(size=d), rng.normal(0, 0.1, (d, quality.RANK)))
    n, s = 3, len(quality.STATS)
    doc, bucket = np.repeat([0, 2], 6), np.concatenate([rng.choice(quality.WORD_BUCKETS, 6, replace=False) for _ in range(2)])
    entries, stats = (doc, bucket, rng.normal(size=12).astype(np.float32)), rng.normal(size=(n, s))
    z = m.vectors(entries, stats)
    assert ((z[:, quality.WORD_BUCKETS :] > 0).sum(1) == s).all()
    for row, got in zip(z, m.score(entries, stats), strict=True):
        at = np.flatnonzero(row)
        pairs = sum(m.factors[i] @ m.factors[j] * row[i] * row[j] for a, i in enumerate(at) for j in at[a + 1 :])
        assert np.isclose(got, 1 / (1 + np.exp(-(0.3 + row @ m.weights + pairs))))


def test_quality_scores_of_all_rows_by_plain_loops(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    m = quality.train(docs, labels, "doc_id", "text", "quality")
    got = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    bucket = {}

    def plain(text):
        raw, w = text.encode(), words_of(text)
        for x in set(w) - bucket.keys():
            bucket[x] = int(common.word_hashes(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0][0]) >> 52
        count = collections.Counter(bucket[x] for x in w)
        share = lambda chars: sum(text.count(c) for c in chars) / max(len(text), 1)
        symbols, n = "#$%&*+=<>@^_~`/\\{}[]", max(len(w), 1)
        odd_ends = sum(c in symbols + "!" and text[i + 1 : i + 2] in ("", " ", "\n") for i, c in enumerate(text))
        stats = [
            math.log1p(len(text)), math.log1p(len(w)), len(text) / n, share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share(".,;:?'\"()-"), share(symbols), share("|"), share("!"),
            text.count("\n") / n, sum(b >= 192 for b in raw) / max(len(text), 1), len(count) / n, max(count.values(), default=0) / n, odd_ends / n,
        ]
        x = {b: math.sqrt(c / n) for b, c in count.items()}
        for k, v in enumerate(stats):
            x[quality.WORD_BUCKETS + k * quality.BINS + sum(v >= cut for cut in m.cuts[k])] = 1 / math.sqrt(len(stats))
        pairs = 0.0
        for f in range(quality.RANK):
            total = sum(m.factors[i, f] * v for i, v in x.items())
            pairs += (total**2 - sum((m.factors[i, f] * v) ** 2 for i, v in x.items())) / 2
        return 1 / (1 + math.exp(-max(-30, min(30, m.bias + sum(m.weights[i] * v for i, v in x.items()) + pairs))))

    want = {r.doc_id: plain(r.text or "") for r in docs.collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-3


def test_quality_does_not_depend_on_the_layout(spark, sf, docs):
    """Two layouts of one table, with repeated ids whose rows don't all fit in the sample."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    twice = docs.unionByName(docs.where("doc_id % 3 = 0").selectExpr("doc_id", "concat(text, ' more') AS text", "lang", "source", "n_chars"))
    scores = lambda d: sorted((r.doc_id, r.score) for r in quality.score(d, labels, max_train_docs=40).collect())
    assert scores(twice.repartition(3)) == scores(twice.orderBy("text").repartition(7, "source"))


@pytest.mark.parametrize(("before", "after"), [("64m", str(common.BATCH_BYTES)), ("1g", str(common.BATCH_BYTES)), ("512k", "512k"), ("4096", "4096")])
def test_batches_are_bounded_whatever_the_unit(spark, before, after):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = spark.conf.get(name)
    try:
        spark.conf.set(name, before)
        common.small_batches(spark.range(1))
        assert spark.conf.get(name) == after
    finally:
        spark.conf.set(name, kept)


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(5, 1, "x"), (None, 0, "x"), (6, None, "x"), (9, 1, "x")], "doc_id long, quality int, text string")
    got = quality.score(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(odd.limit(0), labels.limit(0)).count() == 0
    assert {r.score for r in quality.score(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.accepted(odd, labels).columns == odd.columns


# --- packing


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, p in pieces.items():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
        assert at == len(ids[i])
    total = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
        total += at if at & (at - 1) == 0 else 2048
    assert set(pieces) == set(ids) and total <= 1.02 * sum(map(len, ids.values()))


def test_packing_of_documents(spark, sf, docs):
    check_packing(q.op4_packing(spark, sf).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_packing_odd(spark, odd):
    once = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack(once, PATH).collect(), {r.doc_id: r.text for r in once.collect()})
    assert packing.pack(odd, PATH).groupBy().sum("length").first()[0] > 0 and packing.pack(odd.limit(0), PATH).count() == 0


def test_words_have_the_ids_of_the_library():
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    odd = ["it's DON'T we'll 'tis ''s", "ÀÉ Ünïcode Straße 12ab3 x́y", "a<|endoftext|>b", "日本語 テスト, καλός ΣΑΣ", "İstanbul\x1cx   y z", "", "  ", None, "foo'sbar 'S", "é ́a ﬁ ½ ①", "de%%% a.b.c x-y (z)"]
    for t, ids in zip(odd, words(odd), strict=True):
        assert ids.tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


def test_the_pipeline_remembers_fewer_words_for_the_same_pieces(spark, odd, monkeypatch):
    pipeline, asked, pack = pytest.importorskip("corpus_pipeline"), {}, packing.pack
    monkeypatch.setattr(packing, "pack", lambda *a, **b: asked.update(b) or pack(*a, **b))
    rows = odd.limit(9).coalesce(1)
    got = pipeline.pack(spark, rows, "").collect()
    assert asked["cache_bytes"] < packing.CACHE_BYTES // 4
    assert got == pack(rows, PATH).collect() == pack(rows, PATH, cache_bytes=0).collect()


def test_packer_fills_windows():
    rng = random.Random(1)
    lengths = [rng.choice([1, 5, 80, 300, 700, 1500, 5000]) for _ in range(400)]
    windows = packing.Packer().pack(lengths)
    assert sum(n for _, w in windows for *_, n in w) == sum(lengths) and all(size == sum(n for *_, n in w) for size, w in windows)
    steps = packing.step_groups(windows, 8)
    sizes = collections.defaultdict(set)
    for (size, _), s in zip(windows, steps, strict=True):
        sizes[s].add(size)
    assert all(len(x) == 1 for x in sizes.values())


# --- archives


def test_archives_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas().set_index("page_id")
    got = q.op1_warc(spark, sf).toPandas()
    assert sorted(got.page_id) == sorted(pages.index)
    for r in got.itertuples():
        raw = pages.html[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(raw), hashlib.sha1(raw).hexdigest(), pages.url[r.page_id])


def test_archives_odd(spark):
    big = "é" * 600
    rows = [(1, "http://WWW.a.b.com:80/x?y#z", big, 1), (2, "http://a.b.com/x?y", big, 1), (3, None, big, 1), (None, "odd\r\nurl", big, 1), (5, "http://q.org", None, 1), (6, "http://q.org/", "small", 1), (7, "http://q.org/", "small", 1), (2, "http://a.b.com/x?y", big, 1), (8, "http://z", "WARC/1.1\r\n\r\n" + big, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest int")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_and_read(pages).collect()), key=repr)
    assert got == sorted([(1, "revisit", 3, 1200), (2, "revisit", 3, 1200), (2, "revisit", 3, 1200), (3, "response", None, 1200), (None, "revisit", 3, 1200), (5, "response", None, 0), (6, "response", None, 5), (7, "response", None, 5), (8, "response", None, 1212)], key=repr)
    assert warc.archive_and_read(pages.limit(0)).count() == 0


@pytest.mark.parametrize("window", [64, 1000, 1 << 18])
def test_headers_are_read_past_payloads(window):
    class File:
        def __init__(self, data):
            self.data, self.read = data, 0

        def size(self):
            return len(self.data)

        def read_at(self, n, at):
            self.read += n
            return self.data[at : at + n]

    rng, raw, want = random.Random(1), b"", []
    for i in range(60):
        payload = b"\r\n\r\nWARC/1.1" + b"x" * rng.choice([0, 10, 3000, 200_000 if i == 7 else 5])
        record = b"WARC/1.1\r\nWARC-Target-URI: http://a/%d%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, b"y" * rng.choice([0, 300]), len(payload), payload)
        want.append((len(raw), len(record)))
        raw += record
    f = File(raw)
    assert [(start, size) for _, start, size in warc.headers(f, window)] == want
    assert window > 1000 or f.read < len(raw)


def test_lookup_finds_every_capture(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    path = common.scratch(spark, "warc")
    warc.write_archives(pages.union(pages), path, records_per_file=30)
    blocks, directory = warc.build_index(spark, path, block_captures=7, range_captures=40)
    want = collections.Counter(warc.captures(spark, path).toPandas().key)
    keys = spark.createDataFrame(pd.DataFrame({"key": [*want, "", "nope", "zzz"]}))
    assert collections.Counter(warc.lookup(keys, blocks, directory).toPandas().key) == want


# --- extraction


def test_extraction_of_pages(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas().set_index("page_id")
    for r in q.op8_extraction(spark, sf).collect():
        body = pages.html[r.page_id]
        body = body[body.index("<article>") : body.index("</article>")]
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", body)).split()) and r.n_chars == len(r.text)


def test_extraction_of_new_layouts():
    rng, wrong, total = random.Random(987), 0, 0
    for _ in range(80):
        tree = extraction.parse(extraction.labelled_page(rng))
        for v, p in enumerate(extraction.train().marginals(tree)):
            if v and tree.sizes[v]:
                total += 1
                wrong += (p > 0.5) != ("data-label" in tree.attrs[v])
    assert wrong <= 0.03 * total


def test_messages_give_exact_marginals():
    import itertools

    model = extraction.train()
    tree = extraction.parse("<nav><ul><li>a</ul></nav><article><h1>b</h1><p>c<p>d</article><footer>e</footer>")
    u, n = model.unary(tree), len(tree.tag)
    mass = [0.0] * n
    whole = 0.0
    for y in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(u[v] * y[v] for v in range(n)) + sum(model.edges[extraction.kind(tree.tag[v])][y[tree.parent[v]]][y[v]] for v in range(1, n)))
        whole += w
        for v in range(n):
            mass[v] += w * y[v]
    assert np.allclose([m / whole for m in mass], model.marginals(tree))


@pytest.mark.parametrize("page", [None, "", "<", "a < b", "<p", "<!--", "<script>x", "</p></div>", "<div><p>x</div></p>", "<a href='>'>t</a>", "&amp;&#65;&nope;", "<p class=\"x'>y</p>", "<" * 5000, "<div>" * 3000 + "x"])
def test_extraction_never_fails(page):
    assert isinstance(extraction.train().extract(page), str)


@pytest.mark.parametrize("mark", ["<object data=x>", "<video src=x>", "<audio src=x>", "<canvas>", "<select>", "<svg viewBox='0 0 1 1'>", "<template>", "<noscript>"])
def test_extraction_keeps_text_after_an_unclosed_element(mark):
    one, two = ("The first paragraph of the article has some words in it.", "The second one goes on for as long as the first did.")
    model = extraction.train()
    for page in (f"<body>{mark}<article><h1>T</h1><p>{one}</p><p>{two}</p></article></body>", f"<article><h1>T</h1><p>{one}</p>{mark}<p>{two}</p></article>"):
        assert model.extract(page) == f"T {one} {two}"
    name = mark[1:].split()[0].strip(">")
    if name != "object":  # a later element's end tag is its own; nested ones are balanced
        page = f"<article><h1>T</h1><p>{one}</p>{mark}<p>{two}</p>{mark}no{mark}no</{name}>no</{name}></article>"
        assert model.extract(page) == f"T {one} {two}"


def test_extraction_keeps_formulas_and_objects():
    page = "<article><h1>T</h1><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be given.</p><object data=x><p>What it shows is told in words here.</p></object><p>And so it ends.</p></article>"
    assert extraction.train().extract(page) == "T Let x=1 be given. What it shows is told in words here. And so it ends."


HOSTILE = {
    "quotes": "<p>x</p><a " + '"' * 101, "open tags": "<a b " * 100_000, "svg": "<svg " * 100_000 + ">", "unended svg": "<svg>" * 100_000, "heads": "<head>" * 100_000, "swallowed": '<b ">"' * 100_000,
    "scripts": "<script " * 50_000, "comments": "<!-- " * 100_000, "signs": "<" * 300_000, "mixed quotes": "<a '\"" * 100_000, "declarations": "<!x " * 100_000, "attributes": "<p " + "class='" * 100_001 + ">x</p>",
    "nested": "<div>" * 60_000 + "x", "stray ends": "<foo><div>" + "<bar>" * 50_000 + "</foo>" * 50_000 + "t", "items": "<ul>" + "<li><td>" * 50_000, "long text": "<p>" + "word " * 4_000_000 + "</p>",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_extraction_is_linear(name):
    import time

    page = HOSTILE[name]
    began = time.process_time()
    extraction.train().extract(page[: len(page) // 4])
    quarter = time.process_time() - began
    began = time.process_time()
    text = extraction.train().extract(page)
    assert time.process_time() - began < 1 + 8 * quarter + len(page) / 1e6
    assert name != "long text" or len(text) == len(page.split("<p>")[1]) - 5


def test_extraction_of_huge_numbers():
    assert extraction.train().extract("<p>a&#" + "9" * 5000 + ";b&#x" + "f" * 5000 + ";c&#000000000000065;</p>") == "a\ufffdb\ufffdcA"


LAYOUTS = [
    # class names and nesting that labelled_page() never makes
    """<body class="tpl-7"><div class="hdr__top"><a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a></div><main><div class="grid"><div class="cell-8"><h1>Bridge opens</h1><div class="byl">By A. Writer</div>
    <p>The new bridge was opened on Monday after four years of work by two firms from the region.</p><p>Traffic will be counted for a year before the old crossing is closed.</p></div></div></main>
    <footer><a href="/i">Imprint</a> <a href="/p">Privacy</a> Copyright 2020</footer></body>""",
    """<html><body><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><article><header><h1>Bridge opens</h1></header><section><h2>Why</h2><p>The new bridge was opened on Monday after four years of work by two firms from the region.</p></section>
    <section><h2>What next</h2><p>Traffic will be counted for a year before the old crossing is closed.</p><figure><img src=x><figcaption>The bridge at night</figcaption></figure></section></article><aside><h3>Most read</h3><ol><li><a href=3>Three</a></ol></aside></body></html>""",
]


@pytest.mark.parametrize("page", LAYOUTS)
def test_extraction_of_layouts_of_another_hand(page):
    text = extraction.train().extract(page)
    for wanted in ("Bridge opens", "after four years of work", "before the old crossing is closed."):
        assert wanted in text
    for other in ("Sport", "Two", "Privacy", "Most read", "Three"):
        assert other not in text


# Pages of another hand: names and nesting apart from labelled_page().
FIRST = "The new bridge was opened on Monday after four years of work by two firms from the region."
SECOND = "Traffic will be counted for a year before the old crossing is closed, the council said."
ARTICLE = f"<h1>Bridge opens</h1><p>{FIRST}</p><p>{SECOND}</p>"
WHOLE = f"Bridge opens {FIRST} {SECOND}"
PAGES = {
    "gdpr": (f'<body><div class="gdpr-bar"><p>We use cookies to give you the best experience.</p><button>OK</button></div><main>{ARTICLE}</main></body>', WHOLE),
    "respond": (f'<body><main><article>{ARTICLE}</article><div id="respond"><h3>3 thoughts on this</h3><ol class="commentlist"><li class="depth-1"><p>Nice one, thanks for that report!</p></li><li class="depth-1"><p>I do not agree with this at all.</p></li></ol></div></main></body>', WHOLE),
    "wp": (f'<body><div id="masthead"><p>The Daily Bridge</p><p>All the news</p></div><div id="primary"><article>{ARTICLE}</article></div><div id="colophon"><p>Proudly made by us in the region.</p></div></body>', WHOLE),
    "de": (f'<body><div class="kopfzeile"><p>Die Zeitung am Ort</p></div><div class="inhalt">{ARTICLE}</div><div class="fusszeile"><p>Impressum und Datenschutz</p></div></body>', WHOLE),
    "tr": (f'<body><div class="ust-menu"><ul><li><a href=1>Ana sayfa</a></li><li><a href=2>Spor</a></li></ul></div><article>{ARTICLE}</article><div class="yorumlar"><p>Çok güzel olmuş, elinize sağlık.</p><p>Katılmıyorum bu habere.</p></div></body>', WHOLE),
    "copy": (f'<body><main>{ARTICLE}</main><div class="x8f3k"><p>Copyright 2021 The Daily Bridge. All rights reserved.</p></div></body>', WHOLE),
    "testid": (f"<article><h1>Bridge opens</h1><p data-testid='share-comment-menu'>{FIRST}</p><p>{SECOND}</p></article>", WHOLE),
    "sources": (f"<nav><a href=1>Home</a></nav><article>{ARTICLE}<h2>Sources</h2><ul><li><a href='/a'>Annual report of the bridge office</a></li><li><a href='/b'>Minutes of the council meeting in May</a></li></ul></article>", WHOLE + " Sources Annual report of the bridge office Minutes of the council meeting in May"),
    "related": (f"<article>{ARTICLE}<section class='related work'><h2>Earlier bridges</h2><p>Two earlier bridges stood at the same place and were lost to floods in the last century.</p></section></article>", WHOLE + " Earlier bridges Two earlier bridges stood at the same place and were lost to floods in the last century."),
    "adfree": (f"<article><h1>Bridge opens</h1><div class='article-ad-free-note'>{FIRST}</div><p>{SECOND}</p></article>", WHOLE),
    "nameless": (f"<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>Sport</a></div><div><div><h1>Bridge opens</h1><p>{FIRST}</p><p>{SECOND}</p></div></div><div><p>© 2020 The Daily Bridge</p></div></body>", WHOLE),
    "sidebar": (f"<body><div class='wrap'><div class='col-8'>{ARTICLE}</div><div class='col-4'><h3>Most read</h3><ul><li><a href=1>One more thing</a></li><li><a href=2>Another thing</a></li></ul></div></div></body>", WHOLE),
    "camel": (f"<body><div class='siteHeader'><p>Daily</p></div><article>{ARTICLE}</article><div class='commentsSection'><p>I like it very much indeed.</p></div><div class='pageFooter'><p>Some last words here.</p></div></body>", WHOLE),
    "pubdisqus": (f"<body><main>{ARTICLE}<div id='disqus_thread'><p>Great read, thank you all!</p></div></main></body>", WHOLE),
    "fr": (f"<body><div id='entete'><p>Le journal</p></div><div id='contenu'>{ARTICLE}</div><div id='commentaires'><p>Merci pour cet article.</p></div><div class='pied-de-page'><p>Mentions</p></div></body>", WHOLE),
    "newsletter": (f"<body><article>{ARTICLE}</article><div class='newsletter-signup'><p>Get our best stories every morning.</p></div></body>", WHOLE),
    "modal": (f"<body><div class='modal-overlay'><p>Subscribe now and save half of the price.</p></div><main>{ARTICLE}</main></body>", WHOLE),
}


@pytest.mark.parametrize("name", PAGES)
def test_extraction_of_pages_of_another_hand(name):
    page, want = PAGES[name]
    assert extraction.train().extract(page) == want


def other_layouts():
    """(page, article words, other words) of 120 layouts: shells and furniture under names that the training pages don't have."""
    rng = random.Random(41)
    say = lambda n: " ".join(rng.choice("river stone market winter engine letter garden office report summer window bridge music school".split()) for _ in range(n))
    shells = ["<article>{}</article>", "<main>{}</main>", '<main><div class="row"><div class="col-8">{}</div></div></main>', '<div class="post-body">{}</div>', '<div id="story-text">{}</div>', "<div><div>{}</div></div>", '<div class="c-9f2a"><section>{}</section></div>', "<main><article><div>{}</div></article></main>"]
    for i in range(120):
        own = [say(rng.randint(3, 7)), *(say(rng.randint(15, 70)) + "." for _ in range(rng.randint(3, 7)))]
        parts = [f"<h1>{own[0]}</h1>", *(f"<p data-testid='share-menu' data-comment-id='{i}'>{x}</p>" for x in own[1:])]
        if i % 4 == 0:
            own.append(say(12))
            parts.append(f"<blockquote><p>{own[-1]}</p></blockquote>")
        head, menu, cookie, side, talk, foot = say(3), [say(1) for _ in range(5)], say(9), [say(4) for _ in range(4)], say(11) + "!", say(7)
        top = f'<div class="{rng.choice(["topbar-wrap", "site-branding", "pageHeader", "kopf-bereich"])}"><p>{head}</p></div>' if i % 2 else f"<header><p>{head}</p></header>"
        nav = f'<div class="{rng.choice(["nav-wrap", "mainMenu", "menue-leiste", "x1"])}"><ul>' + "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in menu) + "</ul></div>"
        note = f'<div class="{rng.choice(["cookie-layer", "CookieConsent", "gdpr-note", "privacy-popup"])}"><p>We use cookies. {cookie}.</p><button>OK</button></div>' if i % 3 == 0 else ""
        rail = f'<div class="{rng.choice(["side-area", "sidebar-right", "related-stories", "x2"])}"><h3>{side[0]}</h3><ul>' + "".join(f"<li><a href='/{j}'>{x}</a></li>" for j, x in enumerate(side[1:])) + "</ul></div>"
        said = f'<div class="{rng.choice(["comment-area", "userComments", "kommentar-bereich", "yorumlar-alani"])}"><div><p>{talk}</p></div></div>' if i % 3 else ""
        last = f'<div class="{rng.choice(["footer-wrap", "globalFooter", "fusszeile-unten", "x3"])}"><p>Copyright 2021 {foot}</p></div>'
        yield f"<html><body>{top}{nav}{note}{rng.choice(shells).format(''.join(parts))}{rail}{said}{last}</body></html>", " ".join(own).split(), [*head.split(), *menu, *(cookie.split() if note else []), *" ".join(side).split(), *(talk.split() if said else []), *foot.split()]


def test_extraction_recall_and_precision():
    recall, precision, exact = [], [], 0
    for page, own, _ in other_layouts():
        got = extraction.train().extract(page).split()
        both = sum((collections.Counter(got) & collections.Counter(own)).values())
        recall.append(both / len(own))
        precision.append(both / max(1, len(got)))
        exact += got == own
    assert np.mean(recall) >= 0.97 and np.mean(precision) >= 0.97 and exact >= 0.8 * len(recall), (np.mean(recall), np.mean(precision), exact)


def test_extraction_odd(spark):
    pages = spark.createDataFrame([(None, None, None, "x"), (1, "u", "<article><h1>T</h1><p>A&nbsp;&amp;\n b</p></article><script>no</script>", "x"), (1, "u", "", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extraction.extract(pages).collect()) == [(0, "", 0), (1, "", 0), (1, "T A & b", 7)]
    assert extraction.extract(pages.limit(0)).count() == 0


# --- shards


@pytest.mark.parametrize("files", [1, 6])
def test_compaction_keeps_rows_and_sizes(spark, docs, odd, files):
    """Whatever the layout of the input, arrivals are merged."""
    table, log = shards.arrivals_compacted(docs.repartition(files), common.scratch(spark, "shards"))
    assert sorted(map(tuple, table.read().collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    assert [x[0] for x in log] == list(range(1, len(log) + 1)) and sum(x[1] == "append" for x in log) == shards.ARRIVALS
    merged = [x for x in log if x[1].startswith("merge")]
    assert len(merged) >= 4 and all(b[2] + b[3] < a[2] + a[3] for a, b in zip(log, log[1:]) if b in merged)
    m = table.manifest()
    assert m.version == len(log) and len(table.shards((*m.open, *m.sealed))) < 8 and table.compact().version == m.version


def test_compaction_seals_full_shards_and_expires_the_rest(spark, docs):
    table, log = shards.arrivals_compacted(docs, common.scratch(spark, "shards"), target_bytes=50_000)
    m = table.manifest()
    assert all(s.bytes >= shards.FULL * 50_000 for s in table.shards(m.sealed)) and len(m.sealed) and log[-1][3] == len(table.shards(m.sealed))
    assert table.read().count() == docs.count() and table.expire() >= 0 and table.versions() == [m.version]
    on_disk = {r.path.split("/data/")[1] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{table.root}/data").select("path").collect()}
    assert {s.path.split("/data/")[1] for s in table.shards((*m.open, *m.sealed))} == on_disk
    assert table.read().count() == docs.count()


def test_compaction_odd(spark, odd):
    other = shards.arrivals_compacted(odd, common.scratch(spark, "shards"), arrivals=3)[0]
    assert sorted(map(tuple, other.read().collect()), key=repr) == sorted(ODD, key=repr)
    empty, log = shards.arrivals_compacted(odd.limit(0), common.scratch(spark, "shards"))
    assert empty.read().count() == 0 and empty.read().columns == odd.columns and len(log) == 1


def test_versions_of_the_registered_query(spark):
    log = q.op6_versions(spark, "/root/testdata/sf0.01").orderBy("version").collect()
    tiers = {r.action.split()[-1] for r in log if r.action.startswith("merge")}
    assert len(log) > shards.ARRIVALS and len(tiers) > 1 and log[-1].open_shards + log[-1].sealed_shards < shards.ARRIVALS / 2


def test_manifests_are_atomic(spark, odd):
    table = shards.ShardTable(spark, common.scratch(spark, "shards"))
    with pytest.raises(ValueError):
        table.read()
    first = table.append(odd)
    table.append(odd)
    with pytest.raises(Exception, match="exist|rename"):
        table._commit(first, first.schema, "append", [], first.open)
    assert table.version() == 2 and table.read(1).count() == len(ODD)


def test_arrivals_of_another_schema_are_refused(spark, odd):
    table = shards.ShardTable(spark, common.scratch(spark, "shards"))
    table.append(odd)
    for other in (odd.drop("lang"), odd.withColumn("n_chars", odd["n_chars"].cast("int")), odd.select(*reversed(odd.columns))):
        with pytest.raises(ValueError):
            table.append(other)
    assert table.version() == 1 and table.read().count() == len(ODD)


# --- mixing


def test_raking_meets_all_marginals(spark, sf, docs):
    goal = {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}
    sources = {r.source: 1.0 for r in docs.select("source").distinct().collect()}
    got = mixing.weigh(docs, wanted=mixing.Mix(targets={"lang": goal, "source": sources}, repeats=True)).toPandas()
    for column, wanted in (("lang", goal), ("source", dict.fromkeys(sources, 1 / len(sources)))):
        share = (got.n_tokens * got.factor).groupby(got[column]).sum() / (got.n_tokens * got.factor).sum()
        assert all(abs(s - wanted[v]) < 1e-6 for v, s in share.items())
    assert got.probability.between(0, 1).all() and got.copies.max() > 1 and ((got.copies > 0) == got.kept).all()


def test_mixing_of_all_rows_by_plain_loops(spark, docs):
    """Topics, token counts, cells, probabilities and the kept rows, recomputed row by row."""
    import pyspark.sql.functions as F

    model = mixing.learn_topics(docs, "doc_id", "text")
    got = mixing.weigh(docs).toPandas().set_index("doc_id")
    rows = docs.select("doc_id", "text", "source", "lang", mixing._uniform(F.col("doc_id"), F.col("text"), 1).alias("u")).collect()
    bucket, mine = {}, {}
    for r in rows:
        w = words_of(r.text)
        for x in set(w) - bucket.keys():
            bucket[x] = int(common.word_hashes(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0][0]) >> 54
        count = collections.Counter(bucket[x] for x in w)
        near = [sum(c[b] * math.log1p(n) * model.idf[b] for b, n in count.items()) for c in model.centres]
        assert got.n_tokens[r.doc_id] == len(w)
        assert not w or near[int(got.topic[r.doc_id][1:])] > max(near) - 1e-9
        mine[r.doc_id] = (r.source, r.lang, got.topic[r.doc_id])
    tokens = collections.Counter()
    for r in rows:
        tokens[mine[r.doc_id]] += len(words_of(r.text))
    tempered = {c: n**mixing.TEMPER for c, n in tokens.items()}
    total, aim, weight = sum(tokens.values()), sum(tempered.values()), {c: n / sum(tokens.values()) for c, n in tokens.items()}
    for _ in range(400):
        for d in range(3):
            now, goal = collections.Counter(), collections.Counter()
            for c in weight:
                now[c[d]] += weight[c]
                goal[c[d]] += tempered[c] / aim
            weight = {c: min(w * goal[c[d]] / now[c[d]], tokens[c] / total / mixing.BUDGET) for c, w in weight.items()}
    kept = set()
    for r in rows:
        c = mine[r.doc_id]
        p = weight[c] / (tokens[c] / total) * mixing.BUDGET
        assert abs(got.probability[r.doc_id] - min(1, p)) < 1e-4
        if abs(p - r.u) > 1e-4:
            assert got.kept[r.doc_id] == (r.u < p)
        if got.kept[r.doc_id]:
            kept.add(r.doc_id)
    assert {r.doc_id for r in mixing.sample(docs).collect()} == kept and 0.6 < len(kept) / len(rows) < 0.9


def test_rake_against_plain_loops():
    rng = np.random.default_rng(0)
    tokens = rng.integers(1, 99, 24).astype(float)
    members = [np.repeat(np.arange(4), 6), np.tile(np.arange(6), 4)]
    goals = [np.array([0.4, 0.3, 0.2, 0.1]), np.full(6, 1 / 6)]
    w = (tokens / tokens.sum()).reshape(4, 6)
    for _ in range(500):
        w = w * (goals[0] / w.sum(1))[:, None]
        w = w * (goals[1] / w.sum(0))[None]
    factor, gap = mixing.rake(tokens, members, goals)
    assert np.allclose(factor * tokens / tokens.sum(), w.ravel()) and gap < 1e-9


def test_bounded_rake():
    tokens = np.array([90.0, 5.0, 4.0, 1.0])
    members = [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    factor, gap = mixing.rake(tokens, members, [np.array([0.92, 0.08]), np.array([0.9, 0.1])], most=2)
    assert gap < 1e-6 and factor.max() <= 2 + 1e-9
    _, gap = mixing.rake(tokens, members, [np.array([0.5, 0.5]), np.array([0.9, 0.1])], most=2)
    assert gap > 0.3


def test_targets_out_of_reach_are_an_error(spark, docs):
    with pytest.raises(ValueError, match="can't be met"):
        mixing.weigh(docs, wanted=mixing.Mix(targets={"lang": {"fr": 0.9, "en": 0.1}}))


def test_repeats_reach_the_budget(spark, docs):
    wanted = mixing.Mix(targets={"lang": {"fr": 0.5, "en": 0.5}}, budget=1.5, repeats=True)
    rows = mixing.sample(docs, wanted=wanted)
    assert rows.columns == docs.columns and {r.lang for r in rows.select("lang").distinct().collect()} == {"fr", "en"}
    copies = mixing.weigh(docs, wanted=wanted).toPandas().set_index("doc_id").copies
    seen = collections.Counter(r.doc_id for r in rows.collect())
    assert max(seen.values()) > 1 and all(seen[i] == n for i, n in copies.items())


def test_topics_part_texts_of_different_words(spark):
    rng = random.Random(2)
    kinds = [[f"{a}{b}" for b in "klmnoprstuvw"] for a in ("ba", "ce", "di")]
    rows = [(i, " ".join(rng.choice(kinds[i % 3]) for _ in range(40)), "s", "x") for i in range(90)]
    got = mixing.weigh(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), wanted=mixing.Mix(topics=3)).toPandas()
    assert got.topic.nunique() == 3 and all(got[got.doc_id % 3 == k].topic.nunique() == 1 for k in range(3))


def test_mixing_odd(spark, odd):
    got = mixing.weigh(odd)
    assert got.count() == len(ODD) and got.where("source = '(none)'").count() == 3
    assert {r.doc_id for r in got.where("topic = 'none'").collect()} == {1, 2, 3} and got.where("topic = 'none' and n_tokens > 0").count() == 0
    assert mixing.sample(odd).columns == odd.columns
    assert mixing.weigh(odd.limit(0)).count() == 0 and mixing.sample(odd.limit(0)).count() == 0
    kept = {i: {r.kept for r in rows} for i, rows in ((5, got.where("doc_id = 5").collect()),)}
    assert all(len(x) == 1 for x in kept.values())


# --- search


def brute_search(texts, query_id, terms, k=10):
    bags = {i: collections.Counter(re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode().lower())) for i, t in texts.items()}
    size = {i: sum(b.values()) for i, b in bags.items()}
    mean = sum(size.values()) / len(size)
    score = {}
    for i, b in bags.items():
        s = sum(w * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for t, w in terms.items() if b[t])
        if s > 0:
            score[i] = s
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_search_matches_brute_force(spark, sf, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    bags = {i: collections.Counter(re.findall(rb"[0-9A-Za-z\x80-\xff]+", t.encode().lower())) for i, t in texts.items()}
    df = collections.Counter(w for b in bags.values() for w in b)
    index = search.build_index(docs, shard_tokens=9_000)
    assert index.count() >= 2
    weights, mean = search.weighted(search.query_terms(docs.where("doc_id % 50 = 0")), index, top=None)
    got = search.search(index, weights, mean).toPandas()
    for i in [i for i in texts if i % 50 == 0]:
        terms = {w: n * math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) for w, n in bags[i].items()}
        mine = got[got.query_id == i].sort_values("rank")
        want = brute_search(texts, i, terms)
        assert np.allclose(mine.score, [s for _, s in want]) and mine["rank"].tolist() == list(range(1, len(want) + 1))
        firm = [d for (d, s), (_, n) in zip(want[:-1], want[1:], strict=True) if abs(s - n) > 1e-9][:3]
        assert all(d in set(mine.doc_id) for d in firm)


def test_similar_documents_by_all_terms(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    bags = {i: collections.Counter(re.findall(rb"[0-9A-Za-z\x80-\xff]+", t.encode().lower())) for i, t in texts.items()}
    df = collections.Counter(w for b in bags.values() for w in b)
    got = search.similar_documents(docs).toPandas()
    asked = [i for i in texts if i % 50 == 0]
    assert max(len(bags[i]) for i in asked) > 16
    for i in asked:
        terms = {w: n * math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) for w, n in bags[i].items()}
        want = brute_search(texts, i, terms)
        assert np.allclose(got[got.query_id == i].sort_values("rank").score, [s for _, s in want])


def test_search_in_query_blocks_by_terms(spark, docs):
    index = search.build_index(docs)
    weights, mean = search.weighted(search.query_terms(docs.where("doc_id % 10 = 0")), index)
    one, many = (search.search(index, weights, mean, block_terms=n).toPandas().sort_values(["query_id", "rank"], ignore_index=True) for n in (10**9, 400))
    assert weights.count() > 2 * 400
    pd.testing.assert_frame_equal(one, many)


def test_equal_scores_across_shards_are_ranked_by_id(spark):
    rows = [(i, "same words here" if i % 3 else f"other text {i}") for i in (*range(40, 0, -1), 7)] + [(None, "same words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    index = search.build_index(docs, shard_tokens=12)
    assert index.count() > 5
    weights, mean = search.weighted(search.query_terms(docs.where("doc_id = 1")), index)
    got = [(r["rank"], r.doc_id) for r in search.search(index, weights, mean, k=6).orderBy("rank").collect()]
    assert got == list(enumerate([None, 1, 2, 4, 5, 7], 1))


def test_search_multiplies_common_terms(monkeypatch):
    """Documents of two languages and all lengths, copies among them, whatever the tiles: rows as of plain loops, equal scores for equal
    documents, and most of what a pair shares multiplied, not added posting by posting."""
    rng = np.random.default_rng(5)
    texts = [rng.zipf(1.3, int(rng.integers(0, 120))) % 300 + 1000 * (i % 3 > 1) for i in range(300)]
    texts += [texts[i] for i in range(0, 60)]
    words = [x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x in texts]
    bags = [collections.Counter(w.view(np.int64).tolist()) for w in words]
    df, mean = collections.Counter(w for b in bags for w in b), np.mean([len(x) for x in texts])
    idf = {w: math.log(1 + (len(texts) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    asked = [(q, w, n * idf[w]) for q in range(0, 300, 2) for w, n in bags[q].items()]
    for group, dense, head, piece in ((1024, 0.0025, 2048, 1 << 17), (16, 0.02, 5, 64), (64, 0.0, 7, 1), (32, 2.0, 9, 50)):
        for name, value in (("GROUP", group), ("GROUPS", 40), ("DENSE", dense), ("HEAD", head), ("PIECE", piece), ("RESCORED", 3)):
            monkeypatch.setattr(search, name, value)
        best = search.Best(search.Queries(*(np.array(x) for x in zip(*asked, strict=True))), 10)
        for lo in range(0, len(texts), 120):
            own = range(lo, min(lo + 120, len(texts)))
            row = search.shard_row(lo, np.array(own), np.concatenate([words[i] for i in own]), np.array([len(words[i]) for i in own], np.int32))
            best.meet(search.Shard(row, best.queries.terms, mean))
        assert sorted(best.queries.ids.tolist()) == sorted({q for q, *_ in asked}) and (len(best.queries.edges) > 2) == (group < 150)
        for q, docs, scores in zip(best.queries.ids.tolist(), best.docs, best.scores, strict=True):
            want = {i: sum(bags[q][w] * idf[w] * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * len(texts[i]) / mean)) for w in sorted(bags[q]) if w in b) for i, b in enumerate(bags)}
            want = sorted(((-s, i) for i, s in want.items() if s > 0))[:10]
            kept = scores > -np.inf
            assert np.allclose(scores[kept], [-s for s, _ in want], rtol=1e-12) and docs[kept].tolist() == [i for _, i in want]
    monkeypatch.undo()
    added, add = [], np.add.at
    queries = search.Queries(*(np.array(x) for x in zip(*asked, strict=True)))
    shard = search.Shard(search.shard_row(0, np.arange(len(texts)), np.concatenate(words), np.array([len(x) for x in texts], np.int32)), queries.terms, mean)
    monkeypatch.setattr(search.np, "add", type("", (), {"at": lambda a, i, b: (added.append(len(i)), add(a, i, b))}))
    search.Best(queries, 10).meet(shard)
    assert sum(added) < 0.1 * sum(df[w] for _, w, _ in asked)


def test_search_without_queries_or_words():
    queries = search.Queries(*(np.zeros(0, x) for x in (int, int, float)))
    row = search.shard_row(0, np.arange(3), np.zeros(0, np.uint64), np.zeros(3, np.int32))
    search.Best(queries, 10).meet(search.Shard(row, queries.terms, 1.0))
    some = search.Best(search.Queries(np.array([1]), np.array([7]), np.array([1.0])), 10)
    some.meet(search.Shard(row, some.queries.terms, 1.0))
    assert not (some.scores > -np.inf).any()


def test_search_odd(spark, odd):
    got = search.similar_documents(odd, every=1)
    assert {r.query_id for r in got.collect()} <= {5, 6, 7, 8, 9}
    assert search.similar_documents(odd.limit(0)).count() == 0


# --- pipeline


def test_pipeline_stages(spark, sf, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, seen = docs, {}
    for name, stage in pipeline.STAGES:
        before = rows
        rows = common.written(stage(spark, rows, sf), name)
        seen[name] = rows
        if name == "minhash_near_dedup":
            pairs = sorted((r.doc_id, r.text) for r in before.collect())
            component, _ = brute_components(pairs, 80)
            assert sorted(r.doc_id for r in rows.collect()) == sorted(pairs[c][0] for c in set(component))
        if name != "packing":
            assert rows.columns == docs.columns and rows.join(before, "doc_id", "left_anti").count() == 0
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    good = labels.join(docs, "doc_id").count()
    assert labels.join(seen["quality_classifier"], "doc_id").count() >= 0.98 * good
    final = seen["mixing"].toPandas()
    check_packing(rows.collect(), dict(zip(final.doc_id, final.text, strict=True)))
    assert pipeline.run(spark, sf).count() == rows.count()
    accepted = {r.doc_id for r in langid.identify(docs).where("not rejected").collect()}
    assert {r.doc_id for r in seen["language_id"].collect()} == accepted and len(accepted) > 0.97 * docs.count()
    weighed = mixing.weigh(seen["minhash_near_dedup"]).where("kept").collect()
    assert sorted(final.doc_id) == sorted(r.doc_id for r in weighed)


@pytest.mark.parametrize("rows", [ODD, []])
def test_pipeline_odd(spark, sf, odd, rows):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd if rows else odd.limit(0)
    for name, stage in pipeline.STAGES:
        before = docs
        docs = common.written(stage(spark, before, sf), name)
        assert name == "packing" or docs.columns == odd.columns
    assert {r.doc_id for r in docs.collect()} <= {None, 5, 7, 8, 9} and docs.count() >= 3 * bool(rows)


def test_oracles(spark, sf):
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import oracle

    con = oracle.database(sf)
    for name, sql in q.ORACLE_SQL.items():
        assert oracle.difference(spark, con, q.QUERIES[name], sql, sf) is None, name


def test_manifest_is_json(spark, odd):
    table = shards.ShardTable(spark, common.scratch(spark, "shards"))
    table.append(odd)
    text = spark.read.text(f"{table.root}/manifest/v000000001.json").first()[0]
    assert json.loads(text)["version"] == 1


def test_words_of_latin_letters_never_meet_the_whole_tokenizer(monkeypatch):
    """The model itself encodes them, in its byte alphabet, as the tokenizer does; every such letter is in some word."""
    import random

    letters, rng = [chr(c) for c in [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]], random.Random(5)
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(50)) for _ in range(20)] + letters
    words, asked = packing.WordTokenizer(PATH), []
    whole = words._whole
    monkeypatch.setattr(words, "_whole", lambda w: asked.extend(w) or whole(w))
    assert [list(x) for x in words(texts)] == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked == []


def test_the_driver_gives_memory_back_after_each_table(spark, monkeypatch):
    jvm, given = spark._jvm, []
    mbeans = str(jvm.java.lang.management.ManagementFactory.getRuntimeMXBean().getSpecVersion())
    assert common.trimmed(spark) or int(mbeans.split(".")[0]) < 17  # the command came with 17
    monkeypatch.setattr(common, "trimmed", lambda s: given.append(s) or True)
    table = common.written(spark.range(5), "five")
    assert common.checkpointed(table).count() == 5 and len(given) == 2
    common.fetched(spark)
    common.dropped(table)
    assert len(given) == 3

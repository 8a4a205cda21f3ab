"""Training-data operators on small fixtures: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns; and against brute force."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemosail.llm import ann, common, decontam, graph, language_id, linear_bag, minhash, packing, queries, substring, suffix_dedup, token_counts, toxicity, url_filter
from tests.conftest import DATA
from tests.oracle import connect, rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "rid long, pretoken string, key string, did long, th int, node long, component string, score string"


def words(seed, n, vocab=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


PASSAGE = words(99, 70, 10_000)
BASE = words(1, 120)
TEXTS = {
    1: BASE, 2: BASE, 3: BASE.replace(" ", "\n", 3), 4: BASE + " one more word", 5: words(2, 80) + " " + PASSAGE + " " + words(3, 60), 6: words(4, 90) + " " + PASSAGE,
    7: "", 8: None, 9: "one", 10: "one", 11: "  ", 12: words(5, 6000), 13: "a b c", 14: "x　y ▁z", 15: "for " * 300, 16: words(6, 40),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows_ = [(i, t, "en", "s", len(t or "")) for i, t in TEXTS.items()] + [(None, BASE, None, None, None), (None, None, None, None, None), (5, TEXTS[5], "en", "s", 1)]
    df = spark.createDataFrame(rows_, DOCS)
    for c in EXTRA.split(", "):  # columns whose names operators use inside
        name, kind = c.split()
        df = df.withColumn(name, F.lit("1").cast(kind))
    return df.repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *cols):
    return {(r.doc_id, *(r[c] for c in cols)) for r in df.collect()}


# common


def test_gram_hashes_depend_on_the_run_alone():
    h = np.random.default_rng(0).integers(0, 2**63, 200, np.uint64)
    for n in (1, 2, 3, 16, 35, 50):
        g = common.gram_hashes(h, n)
        assert len(g) == 200 - n + 1
        for k in (0, 17, len(g) - 1):
            assert common.gram_hashes(h[k : k + n], n)[0] == g[k]
    assert len(common.gram_hashes(h[:3], 4)) == 0


def test_window_argmin():
    h = np.random.default_rng(1).integers(0, 30, 300, np.uint64) << np.uint64(40)
    for w in (1, 2, 7, 35, 400):
        got = common.window_argmin(h, w)
        k = min(w, len(h))
        assert got.tolist() == [i + int(np.argmin(h[i : i + k])) for i in range(len(h) - k + 1)]


def test_merge_spans():
    assert common.merge_spans([(5, 9), (1, 3), (3, 4), (8, 12)]) == [(1, 4), (5, 12)]


def test_tables_are_discarded(spark):
    mark = common.written()
    t, kept = common.materialize(spark.range(5), "probe"), common.materialize(spark.range(3), "probe")
    assert t.count() == 5
    common.discard(spark, mark, kept)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|FAILED_READ_FILE|does not exist"):
        t.count()
    assert kept.count() == 3 and common.written() == mark + 1


def test_batches_are_bounded_in_bytes(spark):
    common.small_batches(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    long = spark.range(12).repartition(1).select(F.repeat(F.lit("x"), 3_000_000).alias("t"))
    assert max(r.n for r in long.mapInArrow(sizes, "n long").collect()) <= 2


def test_a_shared_folder_is_needed_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


# 2 token counts


@pytest.mark.parametrize("setup", [{"head": 20}, {"head_bytes": -40 * 300_000 + 500}, {"head": 20, "longest": 3}, {}])
def test_tokens(docs, none, setup):
    sp = token_counts.load_model()
    want = sorted((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in [*TEXTS.items(), (5, TEXTS[5])])
    got = token_counts.count_tokens(docs, **setup).collect()  # in most of these, most pre-tokens take the join
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got if r.doc_id) == want
    assert sorted(r.n_tokens for r in got if r.doc_id is None) == sorted([0, len(sp.encode(BASE))])
    assert token_counts.count_tokens(none).count() == 0


def test_texts_without_blanks_are_no_keys(spark):
    sp = token_counts.load_model()
    texts = ["中文没有空格" * 400, "x" * 3000 + " the", "the 日本語" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert max(len(r.pretoken) for r in token_counts.piece_counts(df).collect()) <= 512
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()} == {i: len(sp.encode(t)) for i, t in enumerate(texts)}


def test_only_shuffled_input_is_written(spark, docs):
    files = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    assert common.stable(files, "t") is files
    mark = common.written()
    common.stable(files.where("doc_id > 3"), "t")
    assert common.written() == mark
    assert common.stable(files.repartition(2), "t").count() == 200 and common.written() == mark + 1
    common.discard(spark, mark)


def test_pretokens_sum_like_the_library():
    sp = token_counts.load_model()
    r = random.Random(5)
    for _ in range(400):
        t = "".join(r.choice([" ", "  ", "a", "the", "\n", "\t", "▁", "é", "中", "😀", "1", ".", "ﬁ", "　", "<s>", "\x00"]) for _ in range(r.randrange(0, 40)))
        assert sum(len(sp.encode(p)) if p else 1 for p in token_counts.pretokens(t)) == len(sp.encode(t)), repr(t)


# 5 packing


def word_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.MODEL))


def word_ids(t, tokenizer=None):
    return (tokenizer or word_tokenizer()).encode(t or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers():
    enc, tokenizer = packing.Encoder(), word_tokenizer()
    tricky = ["", None, "İstanbul Straße'S don't ... naïve, ﬁ x́y <|endoftext|>! ΣΑΣ ab\x1cc a\x85b a\xa0b　c ª1º2 ?!a., é. É,, 3.14", "A" * 5000, "\n \t\r", "<|endoftext|>", "''s'sun we'LL\x0bx"]
    tricky += [f"a{chr(c)}b {chr(c)}'{chr(c).upper()}" for c in range(0x250)]
    r = random.Random(7)
    tricky += ["".join(r.choice(" aB'sé.,!7ñß\n中") for _ in range(60)) for _ in range(200)]
    ids, size = enc.encode(pa.array(tricky))
    at = np.concatenate([[0], np.cumsum(size)])
    for k, t in enumerate(tricky):
        assert ids[at[k] : at[k + 1]].tolist() == word_ids(t, tokenizer), repr(t)
    some = [t for t in tricky if t and t.isascii()]
    assert enc.encode(pa.array(some))[0].tolist() == [i for t in some for i in word_ids(t, tokenizer)]


def test_bulks_are_bounded_and_whole():
    texts = ["x" * n for n in (10, 0, 900, 5, 300, 300, 300, 4000, 1)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])] * 2
    got = list(packing.bulks(batches, 1000))
    assert [t for _, part in got for t in part.to_pylist()] == texts * 2
    assert all(sum(map(len, part.to_pylist())) <= 1000 or len(part) == 1 for _, part in got)


def test_packing_round_trip(docs, none):
    got = packing.pack(docs, capacity=256, slack=4, group_items=4, fan_in=2).toPandas()
    tokenizer, want = word_tokenizer(), collections.Counter()
    for i, t in [*TEXTS.items(), (5, TEXTS[5]), (None, BASE), (None, None)]:
        ids = np.array([*word_ids(t, tokenizer), 0], "<u4").tobytes()
        for p, at in enumerate(range(0, len(ids), 1024)):
            want[(i, p, at // 4, len(ids[at : at + 1024]) // 4, zlib.crc32(ids[at : at + 1024]))] += 1
    have = collections.Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert have == want
    for _, s in got.groupby("sequence_id"):
        at = 0
        for r in s.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert got.sequence_id.nunique() <= 1.15 * got.length.sum() / 256 + 2
    assert packing.pack(none).count() == 0


def test_packing_tree_reaches_one_root(spark):
    text = F.repeat(F.lit("the "), (F.col("id") * 37 % 90 + 5).cast("int"))
    df = spark.range(600).select(F.col("id").alias("doc_id"), text.alias("text")).repartition(20)
    used, least = packing.fill_rate(packing.pack(df, capacity=256, fan_in=2), 256)
    assert least <= used <= 1.05 * least
    split, _ = packing.fill_rate(packing.pack(df, capacity=256, fan_in=2, group_items=3), 256)
    assert split <= 1.1 * least


def test_best_fit_is_close_to_the_bound():
    sizes = np.random.default_rng(3).integers(1, 1500, 5000)
    bins, offsets, fill = packing.best_fit(sizes, 2048)
    assert fill.max() <= 2048 and len(fill) <= 1.01 * sizes.sum() / 2048 + 1
    assert np.bincount(bins, weights=sizes).tolist() == fill.tolist()


# 3 near duplicates


def brute_components(texts, n, percent=80):
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).encode().split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and both:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(docs, none):
    got = minhash.near_duplicates(docs, minhash.Config(words=4)).collect()
    want = brute_components(TEXTS, 4)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id} == {(i, n, c) for i, (n, c) in want.items()}
    lone = {(r.n_shingles > 0, r.component_id, r.kept) for r in got if r.doc_id is None}
    assert lone == {(True, 1, False), (False, None, True)}
    assert minhash.near_duplicates(none).count() == 0


def test_group_of_near_copies_with_stragglers(spark):
    r, base = random.Random(11), words(20, 150, 5000).split()
    texts = {}
    for i in range(160):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        texts[i + 1] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = minhash.near_duplicates(df, minhash.Config(words=4, leaders=3, tries=1)).collect()
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == {(i, n, c) for i, (n, c) in brute_components(texts, 4).items()}


def test_large_buckets_are_compared_by_tiles(spark):
    base, texts = words(61, 120, 400).split(), {}
    r = random.Random(62)
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        texts[i + 1] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for c in (minhash.Config(words=4, leaders=3, tries=1, small=2, tile=9), minhash.Config(words=4, leaders=3, tries=1, small=2)):
        got = minhash.near_duplicates(df, c).collect()
        assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == {(i, n, k) for i, (n, k) in brute_components(texts, 4).items()}
    nodes = minhash.features(df, c, "doc_id", "text").select(F.col("doc_id").alias("node"), "n", "sketch", "own")
    rows = nodes.select(F.explode(F.array(F.lit(5).cast("long"), F.col("node") % 3)).alias("key"), "node", (F.col("node") % 7).alias("c"), F.lit(2).cast("long").alias("big"), F.lit(120).cast("long").alias("m"), "n", "sketch", "own")
    pairs = lambda found: {(min(p, q), max(p, q), b) for p, q, b in ((f.x, f.y, f.bits) for f in found.collect())}
    want = pairs(minhash.joined(rows, rows, c))
    assert len(want) > 100 and pairs(minhash.tiled(rows, minhash.Config(words=4, tile=9))) == pairs(minhash.tiled(rows, c)) == want
    plan = minhash.candidates(*last_round(spark, rows), None, None, c)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan  # no join has all pairs of a large bucket


def last_round(spark, rows):
    labels = rows.select("node", F.col("c").alias("root")).distinct()
    return rows.select("key", "node", "m"), labels, rows.select("node", "n", "sketch", "own").distinct(), spark.createDataFrame([], "x long, y long, linked boolean")


def test_one_id_with_two_texts(spark):
    a, b = words(50, 60, 5000), words(51, 60, 5000)
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, words(52, 60, 5000))], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df, minhash.Config(words=4)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_one_row_of_each_group_stays(docs):
    kept = minhash.without_near_duplicates(docs, minhash.Config())
    assert set(kept.columns) == set(docs.columns)
    got = sorted((r.doc_id or 0) for r in kept.collect())
    want = brute_components(TEXTS, 5)
    assert [i for i in got if i] == sorted(i for i, (_, c) in want.items() if c == i)
    assert got.count(0) == 1  # the null text under a null id; the other one is a copy


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 150: 100, 200: 100}


def test_rounds_end_without_further_jobs(spark, monkeypatch):
    ids = spark.range(10)
    assert common.materialize(ids, "seen", 4, F.count_if(F.col("id") > 6)).table_seen == 3
    for empty in (ids.where("id < 0"), ids.where("false"), ids.join(ids.where("id < 0"), "id")):
        assert common.materialize(empty, "seen", seen=F.count("*")).table_seen == 0
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    monkeypatch.setattr(type(docs), "isEmpty", lambda self: pytest.fail("a job of its own"))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, minhash.Config(words=4)).collect()}
    want = {k: c for k, (_, c) in brute_components(TEXTS, 4).items()}
    assert got == want
    loops = spark.createDataFrame([(7, 7)], "a long, b long")
    assert graph.components(loops).count() == 0 and graph.components(loops.where("a < 0")).count() == 0


def test_own_sketch_bounds_the_difference():
    r = np.random.default_rng(2)
    c, mask = minhash.Config(), np.uint64(1023)
    odd = lambda s: np.bincount((s >> np.uint64(7) & mask).astype(int), minlength=c.parity) & 1
    for _ in range(30):
        a = np.unique(r.integers(0, 2**63, 300, np.uint64))
        b = np.unique(np.concatenate([a[40:], r.integers(0, 2**63, 50, np.uint64)]))
        assert (odd(a) ^ odd(b)).sum() <= len(np.setxor1d(a, b))


# 1 and 7 repeated passages


def brute_later(texts, length):
    seen, out = set(), {}
    for i in sorted(texts):
        w = (texts[i] or "").encode().split()
        cov = bytearray(len(w))
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            if key in seen:
                cov[k : k + length] = b"\1" * length
            seen.add(key)
        out[i] = [x for x, c in zip(w, cov, strict=True) if not c]
    return out


def test_later_copies_are_cut(spark, docs, none):
    df = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r.text for r in suffix_dedup.without_repeats(df).collect()}
    for i, left in brute_later(TEXTS, 50).items():
        assert (got[i] or "").encode().split() == left
        if len(left) == len((TEXTS[i] or "").split()):
            assert got[i] == TEXTS[i]  # untouched texts keep their white space
    assert suffix_dedup.without_repeats(none).count() == 0
    assert suffix_dedup.without_repeats(docs).count() == docs.count()


def test_frequent_passage_is_cut_from_all_but_the_first(spark):
    texts = {i: words(1000 + i, 30, 10**6) + " " + PASSAGE + " " + words(5000 + i, 30, 10**6) for i in range(1, 60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    for group in (8, 1000):
        got = {r.doc_id: r.text for r in suffix_dedup.without_repeats(df, group=group).collect()}
        assert {i: t.encode().split() for i, t in got.items()} == brute_later(texts, 50)


def test_passages_behind_a_frequent_prefix(spark):
    header = words(77, 30, 10**6)
    texts = {i: " ".join([words(2000 + i, 20, 10**6), header, words(3000 + i % 40, 25, 10**6), words(4000 + i, 30, 10**6)]) for i in range(1, 121)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text for r in suffix_dedup.without_repeats(df, group=8).collect()}
    assert {i: t.encode().split() for i, t in got.items()} == brute_later(texts, 50)


def test_copies_among_longer_one_sided_matches(spark):
    seed = next(k for k in range(100) if 12 <= suffix_dedup.anchors(common.word_hashes(words(k, 50, 10**6).encode().split(), common.word_memo()), 50, 16)[0][0] <= 22)
    w = words(seed, 50, 10**6).split()
    a = int(suffix_dedup.anchors(common.word_hashes([x.encode() for x in w], common.word_memo()), 50, 16)[0][0])
    left, gram, right, before, after = w[:a], w[a : a + 16], w[a + 16 :], words(801, 5, 10**6).split(), words(802, 5, 10**6).split()
    parts = [gram] * 12 + [w] + [gram + right + after] * 20 + [before + left + gram] * 20 + [before + w + after]
    texts = {i: " ".join([words(8000 + i, 40, 10**6), *p, words(9000 + i, 40, 10**6)]) for i, p in enumerate(parts, 1)}
    last = brute_later(texts, 50)[len(parts)]
    assert len(last) == 90
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.without_repeats(df).collect()}
    assert {i: t.encode().split() for i, t in got.items()} == brute_later(texts, 50)


def test_rows_of_later_copies(spark, tmp_path):
    shared = [words(600 + k, 60 + k, 10**6) for k in range(4)]
    r = random.Random(3)
    texts = {}
    for i in range(40):
        parts = [words(700 + i, 30, 10**6), *r.sample(shared, r.randrange(0, 3)), words(900 + i, 10 + i, 10**6)]
        texts[i] = " ".join(parts)
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_suffix_dedup(spark, str(tmp_path)).collect()
    seen, want = {}, set()
    for i in sorted(texts):
        w = texts[i].split()
        spans = []
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), i) != i:
                spans.append((k, k + 50, seen[tuple(w[k : k + 50])]))
        for a, z in common.merge_spans((a, z) for a, z, _ in spans):
            want.add((i, a, z - a, min(x for b, _, x in spans if a <= b < z)))
    assert len(want) > 20
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_copies_without_ids(spark, tmp_path):
    rows_ = [(1, "a b " + PASSAGE), (None, PASSAGE + " c"), (None, None), (2, None)]
    spark.createDataFrame(rows_, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = queries.op1_suffix_dedup(spark, str(tmp_path)).collect()
    assert (row.doc_id, row.start_word, row.n_words, row.earlier_doc_id) in {(1, 2, 70, None), (None, 0, 70, 1)}


def test_neighbours_of_sorted_contexts():
    r = np.random.default_rng(5)
    n, side = 400, 6
    group = np.sort(r.integers(0, 5, n))
    R, L = r.integers(0, 2, (n, side)).astype(">u4"), r.integers(0, 2, (n, side)).astype(">u4")
    nr, nl = r.integers(0, side + 1, n), r.integers(0, side + 1, n)
    for x, m in ((R, nr), (L, nl)):
        x[np.arange(side)[None] >= m[:, None]] = 0
    got = suffix_dedup.earliest_equal(group, R, nr, L, nl)
    for l in range(side + 1):
        seen = {}
        for i in range(n):
            ok = nl[i] >= l and nr[i] >= side - l
            key = (group[i], tuple(L[i, :l]), tuple(R[i, : side - l]))
            assert got[i, l] == (seen.setdefault(key, i) if ok else -1)


def brute_windows(rows_, length):
    split = [(t or "").encode().split() for _, t in rows_]
    count = collections.Counter(tuple(w[k : k + length]) for w in split for k in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(rows_, split, strict=True):
        cov = bytearray(len(w))
        for k in range(len(w) - length + 1):
            if count[tuple(w[k : k + length])] > 1:
                cov[k : k + length] = b"\1" * length
        kept = b" ".join(x for x, c in zip(w, cov, strict=True) if not c)
        out.append((i or 0, len(w), sum(cov), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("setup", [{"cells": None}, {}, {"cells": 8, "heavy": 2}, {"flush": 50}, {"cells": 21, "heavy": 0}])
def test_windows_removed(docs, setup):
    got = substring.digest(substring.remove_repeats(docs, **({"cells": 22} | setup))).collect()
    rows_ = [*TEXTS.items(), (5, TEXTS[5]), (None, BASE), (None, None)]
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_windows(rows_, 35)


def test_windows_of_nothing(none):
    assert substring.remove_repeats(none, cells=21).count() == 0


# 4 toxicity, 9 languages


def test_toxicity(spark, none):
    r = random.Random(3)
    bad = ["idiot", "moron", "scum"]
    texts, labels = [], []
    for k in range(400):
        w = words(k, r.randrange(5, 200)).split()
        y = k % 4 == 0
        if y:
            w[r.randrange(len(w))] = r.choice(bad)
        texts.append(" ".join(w)), labels.append(int(y))
    model = toxicity.fit(texts, labels)
    long = words(9000, 8000).split()
    long[4000] = "moron"
    rows_ = [(1, words(7000, 50)), (2, words(7001, 40) + " idiot " + words(7002, 40)), (3, " ".join(long)), (4, ""), (5, None), (None, "scum"), (6, "!!!"), (7, words(7003, 8000))]
    df = spark.createDataFrame(rows_, "doc_id long, text string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert got[2] > 0.7 and got[3] > 0.7 and got[None] > 0.7
    unseen = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(1, words(7001, 40) + " idiots " + words(7002, 40)), (2, words(7001, 80))], "doc_id long, text string"), model).collect()}
    assert unseen[1] > 0.4 > 5 * unseen[2]  # a form that no label showed shares n-grams with one that some did
    assert max(got[k] for k in (1, 4, 5, 6, 7)) < 0.7 and got[4] == got[5] == got[6]
    assert {r.doc_id for r in toxicity.drop_toxic(df, model).collect()} == {1, 4, 5, 6, 7}
    assert toxicity.score(none, toxicity.fit([], [])).count() == 0
    again = toxicity.score(df.union(df), model).groupBy("doc_id").agg(F.count_distinct("score").alias("k"), F.count("*").alias("n")).collect()
    assert all(r.k == 1 and r.n == 2 for r in again)
    flat = toxicity.fit(["a", "b"], [0, 0])
    assert all(r.score == pytest.approx(0.001) for r in toxicity.score(df, flat).collect())


def test_held_out_accuracy(spark):
    folder = f"{DATA}/sf0.1"
    got = queries.op4_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert got[got.toxic == 0].predicted.mean() < 0.02 and got[got.toxic == 1].predicted.mean() > 0.85
    lang = queries.op9_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (lang.lang == lang.lang_pred).mean() > 0.97


def test_languages(spark, none):
    names = {"aa": "bado kiru", "bb": "zeltan owix", "cc": "mmuph nnat", "dd": "ghirlo vask", "ee": "tsuqe ryhj"}
    texts, langs = [], []
    for name, stems in names.items():
        for k in range(60):
            r = random.Random(k)
            texts.append(" ".join(r.choice(stems.split()) + r.choice(["ta", "ri", ""]) for _ in range(12))), langs.append(name)
    model = language_id.fit(texts, langs)
    assert model.code.shape == (5, 15)
    rows_ = [(1, "bado kiruta"), (2, "OWIX zeltan!"), (3, "12 34 ..."), (4, ""), (5, None), (None, "vask")]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(rows_, "doc_id long, text string"), model).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[None].lang_pred) == ("aa", "bb", "dd")
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and not got[k].ambiguous for k in (3, 4, 5))
    assert language_id.fit([], []) is None and language_id.predict(none, None).count() == 0
    assert language_id.predict(spark.createDataFrame([(1, "a")], "doc_id long, text string"), None).first().lang_pred == "und"


def test_letters():
    assert all(map(linear_bag.has_letter, ["a", "1é", "中", "ª", "_x"])) and not any(map(linear_bag.has_letter, ["", None, "² ½ Ⅷ", "12_", "...", "٣"]))


def test_languages_of_long_and_repeated_rows(spark):
    stems = {"aa": "bado kiru", "bb": "zeltan owix"}
    rows_ = [(k, " ".join(random.Random(k).choices(stems[g].split(), k=12)), g, "x", "y") for k, g in enumerate(["aa", "bb"] * 40)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string, lang_pred string, score string")
    model = language_id.fit(*language_id.language_sample(df, F.col("doc_id") >= 0))
    more = [(100, "zeltan " * 200_000), (101, "² ½ Ⅷ"), (0, rows_[0][1]), (0, rows_[0][1])]
    got = language_id.predict(spark.createDataFrame(more, "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got) == [(0, "aa"), (0, "aa"), (100, "bb"), (101, "und")]
    assert language_id.predict(df, model).count() == 80


def test_every_language_of_a_sample_can_be_predicted(spark):
    rows_ = [(100 * g + k, " ".join(random.Random(k).choices([f"q{g}x{j}" for j in range(6)], k=20)), f"l{g:03}") for g in range(60) for k in range(12 if g else 400)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    c = language_id.Config(sample=100)
    texts, langs = language_id.language_sample(df, F.lit(True), c)
    assert len(set(langs)) == 60 and max(collections.Counter(langs).values()) <= 8
    model = language_id.fit(texts, langs, c)
    got = language_id.predict(df, model).join(df.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.9
    small = language_id.language_sample(df, F.lit(True), language_id.Config(sample_bytes=60 * 300))
    assert all(sum(len(t) for t, g in zip(*small, strict=True) if g == x) <= 300 for x in set(small[1]))


def test_codewords():
    for k in (2, 3, 4, 6, 9, 30):
        c = language_id.codewords(k)
        assert len({tuple(r) for r in c}) == k
    assert min((a != b).sum() for a, b in itertools.combinations(language_id.codewords(4), 2)) == 4


def test_bags_of_words_do_not_mix():
    u = np.random.default_rng(0).normal(size=(512, 2))
    ws = ["alpha", "a", "naïve", "中文字"]
    alone = np.concatenate([linear_bag.word_scores([w], u, 2, 4) for w in ws])
    assert np.allclose(linear_bag.word_scores(ws, u, 2, 4), alone)


# 6 urls


RULES = queries.URL_RULES


def test_rules(spark):
    urls = ["https://WWW.Example.com/en/7?x", "http://a.com/en/", "http://com/en/x", "http://acom/en/x", "http://x.net/de/9", "http://example.net/de/88", "http://y.org/es", "http://y.org/es/", None, "nonsense", "ftp://h#f", "http://example.com:80/en/"]
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, RULES).collect()}
    assert got[0] == ("www.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1][2:] == ("com/en/", "block") and got[2][2:] == ("com/en/", "block") and got[3] == ("acom", "/en/x", None, "allow")
    assert got[4][2:] == ("net/de/", "allow") and got[5][2:] == ("example.net/de/8", "block")
    assert got[6][2] is None and got[7][2:] == ("org/es/", "block")
    assert got[8] == got[9] == ("", "", None, "allow") and got[10][:2] == ("h", "") and got[11][2] is None


def test_propagation_equals_power_iteration(spark):
    a = lambda *hosts: " ".join(f'<a href="http://{h}/x">l</a>' for h in hosts)
    pages = [(1, "http://good.net/de/1", a("n1.io", "n2.io")), (2, "http://n1.io/", a("n2.io")), (3, "http://bad.com/en/1", a("n2.io")), (4, "http://shady.io/", a("bad.com", "bad.com")), (5, "http://n2.io/", None), (6, "http://far.io/", a("shady.io"))]
    got = {r.host: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES, tolerance=1e-9).collect()}
    hosts = sorted({"good.net", "n1.io", "n2.io", "bad.com", "shady.io", "far.io"})
    w = np.zeros((6, 6))
    for s, t, n in [("good.net", "n1.io", 1), ("good.net", "n2.io", 1), ("n1.io", "n2.io", 1), ("bad.com", "n2.io", 1), ("shady.io", "bad.com", 2), ("far.io", "shady.io", 1)]:
        w[hosts.index(s), hosts.index(t)] = n

    def rank(w, seed):
        p = w / np.maximum(w.sum(axis=1, keepdims=True), 1)
        s = np.array([h == seed for h in hosts], float)
        m = s
        for _ in range(200):
            m = 0.85 * m @ p
            m = m + (1 - m.sum()) * s
        return m

    for h, t, d in zip(hosts, rank(w, "good.net"), rank(w.T, "bad.com"), strict=True):
        assert got[h].trust == pytest.approx(t) and got[h].distrust == pytest.approx(d)
    assert got["shady.io"].verdict == got["far.io"].verdict == "block" and got["n1.io"].verdict == "allow"
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


def test_distrust_reaches_far_and_rows_repeat(spark):
    a = lambda h: f'<a href="http://{h}/x">l</a>'
    chain = [(k, f"http://h{k}.io/", a(f"h{k + 1}.io") + " " + "word " * (100_000 if k == 3 else 1)) for k in range(15)]
    rows_ = [*chain, (15, "http://h15.io/", a("bad.com")), (16, "http://bad.com/en/1", None), (16, "http://bad.com/en/1", None), (17, "http://good.net/de/1", None), (3, chain[3][1], chain[3][2])]
    got = url_filter.judge(spark.createDataFrame(rows_, "page_id long, url string, html string"), RULES).collect()
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows_)
    assert {r.page_id: r.verdict for r in got} == {k: "allow" if k == 17 else "block" for k in range(18)}


# 8 nearest neighbours


@pytest.mark.parametrize("setup", [{"shard_rows": 30, "min_cells": 5, "block": 3}, {"most_cells": 1, "shard_rows": 90, "block": 8}, {}])
def test_nearest_equals_brute_force(spark, setup):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(300, 8)), np.tile(r.normal(size=(1, 8)), (40, 1)), 5 * r.normal(size=(60, 8))])
    odd = [(900, None), (920, [0.0] * 8), (940, [float("nan")] * 8), (960, [1.0] * 3), (None, [1.0] * 8), (980, [None] + [1.0] * 7)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for row in ann.nearest(df, F.col("vec_id") % 20 == 0, 7, **setup).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    assert set(got) == {i for i in range(400) if i % 20 == 0}
    for q, found in got.items():
        s = np.einsum("ij,j->i", x, x[q])
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:7]
        assert [i for i, _ in found] == order and np.allclose([v for _, v in found], s[order])
    few = ann.nearest(df.where("vec_id < 3"), F.lit(True), 20)
    assert few.count() == 6
    assert ann.nearest(df.where("vec_id > 899"), F.lit(True)).count() == 0


def test_repeated_ids_and_rows(spark):
    r = np.random.default_rng(8)
    rows_ = [(i, r.normal(size=6).tolist()) for i in range(1, 60)]
    rows_ += [(20, r.normal(size=6).tolist()), rows_[39], rows_[4], rows_[4]]  # another vector of 20; 40 and 5 again
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>").repartition(4)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, 5, min_cells=4).collect()
    lists = collections.Counter()
    for q, v in {(q, tuple(v)) for q, v in rows_ if q % 20 == 0}:
        order = sorted({(-float(np.dot(v, w)), i) for i, w in rows_ if i != q})[:5]
        lists[(q, *(i for _, i in order))] += 1
    have = collections.defaultdict(list)
    for x in sorted(got, key=lambda x: x["rank"]):
        have[x.query_id, x["rank"]].append(x.vec_id)
    assert {q: sorted(v) for q, v in have.items()} == {(q, k + 1): sorted(t[k + 1] for t in lists if t[0] == q) for q in (20, 40) for k in range(5)}


def test_far_cells_are_not_searched(spark):
    r = np.random.default_rng(9)
    c = 40 * np.eye(6)
    x = np.concatenate([c[k] + 0.1 * r.normal(size=(200, 6)) for k in range(6)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    mark = common.written()
    assert ann.nearest(df, F.col("vec_id") % 20 == 0, 5, min_cells=24).count() == 300
    (asks,) = [p for p in common._WRITTEN[mark:] if "/asks-" in p]
    assert spark.read.parquet(asks).count() < 60 * 12


def test_pruning_below_one_keeps_recall(spark):
    r = np.random.default_rng(6)
    c = r.normal(size=(20, 16))
    x = np.concatenate([c[k] + 0.1 * r.normal(size=(150, 16)) for k in range(20)])
    exact = ann.Tree(x).search(x[::50], 10)[1]
    near = ann.Tree(x).search(x[::50], 10, 0.5)[1]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, near, strict=True)]) >= 0.9


# 10 decontamination


ITEMS = [(1, "Tom Smith buys 12 apples and gives 5 apples to Anna Lee before walking 3 km home to his old house."), (2, words(321, 40, 9000)), (3, "short item here"), (4, None), (5, "")]


def test_templates(spark, none):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    same = "Intro text. Then Bob Jones buys 30 apples and gives 9 apples to Mary Fox before walking 8 miles home to his old house."
    odd = "So Tom Smith buys 12 apples and gives 5 apples to Tom Smith before walking 12 km home to his old house."
    mixed = "So Bob Bob buys 30 apples and gives 9 apples to Bob Bob before walking 8 miles home to his old house."
    rows_ = [(1, same), (2, words(1, 500) + " " + ITEMS[1][1].upper() + " " + words(2, 500)), (3, words(3, 300)), (4, None), (5, ""), (6, "a short item here now"), (None, ITEMS[1][1]), (7, odd), (8, ITEMS[0][1] + " " + ITEMS[0][1]), (9, mixed)]
    df = spark.createDataFrame(rows_, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    for c in (decontam.Config(), decontam.Config(chunk_windows=40)):
        got = decontam.contaminated(df, bench, c)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (2, 2), (6, 3), (None, 2), (7, 1), (8, 1)}
        assert got.where("doc_id = 1").first().consistency == 1.0
        # one slot of seven disagrees in 7, which the bound allows; 9 gives one name to three people
        assert 0.8 <= got.where("doc_id = 7").first().consistency < 1
        kept = decontam.drop_contaminated(df, bench, c)
        assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 9}
    assert decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(df, bench.limit(0)).count() == 0


def test_inconsistent_slots_are_no_leak():
    item = "Ann has 4 pens and Ann lends 4 pens to Ben while Ann keeps 7 and Ben keeps 4 pens in all"
    bench = decontam.Benchmark([(1, item)], decontam.Config())
    memo = common.Memo(decontam.code)
    twin = "so Eve has 6 pens and Eve lends 6 pens to Joe while Eve keeps 9 and Joe keeps 6 pens in all"
    mess = "so Eve has 6 pens and Pat lends 8 pens to Joe while Sue keeps 9 and Eve keeps 2 pens in all"
    assert bench.matches(twin, memo) and not bench.matches(mess, memo)


def test_changed_names_at_the_start_of_sentences():
    item = "Sam has 3 red pens. Tom has 5 blue pens. Kim gives 4 pens to Sam."
    twin = "Eve has 6 red pens. Joe has 7 blue pens. Pat gives 8 pens to Eve."
    mess = "Eve has 6 red pens. Eve has 7 blue pens. Eve gives 8 pens to Joe."
    bench = decontam.Benchmark([(1, item)], decontam.Config())
    memo = common.Memo(decontam.code)
    assert bench.matches(twin, memo) == [(1, 0, 16, 1.0, 1.0)] and bench.matches(item.upper(), memo)
    assert not bench.matches(mess, memo)


def test_slot_values_of_other_lengths_and_inserted_words():
    item = "On a cold morning Tom walked slowly to the market where twelve ripe melons lay in a box and Tom bought some of them before the rain began so that by noon Tom had carried home every melon he could find there"
    bench = decontam.Benchmark([(1, item)], decontam.Config())
    memo = common.Memo(decontam.code)
    twin = item.replace("Tom", "Mary Ann").replace("twelve", "twenty five")
    assert bench.matches("So " + twin, memo) == [(1, 1, 42, 1.0, 1.0)]
    more = item.replace("ripe melons", "very ripe melons").replace("before the", "just before the").replace("home every", "back home every")
    assert [m[0] for m in bench.matches(more, memo)] == [1]
    mess = item.replace("Tom walked", "Mary Ann walked").replace("Tom bought", "Eve bought").replace("Tom had", "Jo Lee had")
    assert not bench.matches(mess, memo)
    assert not bench.matches(words(31, 40) + " " + " ".join(item.split()[:12]) + " " + words(32, 60) + " " + " ".join(item.split()[-10:]), memo)


def test_items_without_ordinary_words_match_word_for_word(spark):
    items = ["What is 12 + 5?", "1 2 3 4 5 6 7 8 9 10", "Tom has 3", "Tom 3 Ann 4 Ben 5 Kim 6 Eve 7 Joe 8", "7"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"before. {t} after" for t in items] + ["What is 13 + 5?", "1 2 3 4 5 6 7 8 9 11", "Tom has 4", "no items"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (1, 4), (3, 4), (6, 4)}


def test_long_and_repeated_texts(spark):
    item = words(321, 40, 9000)
    bench = spark.createDataFrame([(1, item), (1, item), (2, words(322, 3000, 9000))], "item_id long, text string")
    long = words(11, 60_000) + " " + item + " " + words(12, 60_000)
    df = spark.createDataFrame([(1, long), (1, long), (2, words(13, 120_000)), (3, words(14, 50) + " " + words(322, 3000, 9000))], "doc_id long, text string")
    got = [(r.doc_id, r.item_id, r.start, r.n_words) for r in decontam.contaminated(df, bench).collect()]
    assert sorted(got) == [(1, 1, 60_000, 40)] * 4 + [(3, 2, 50, 3000)]
    assert [r.doc_id for r in decontam.drop_contaminated(df, bench).collect()] == [2]


def test_leaks_against_plain_search(spark):
    folder = f"{DATA}/sf0.01"
    got = {(r.doc_id, r.item_id) for r in queries.op10_decontamination(spark, folder).collect()}
    flat = lambda t: " " + " ".join(decontam.re.findall(r"\w+", t.lower())) + " "
    d = [(r.doc_id, flat(r.text)) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    b = [(r.item_id, flat(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert got == {(i, j) for i, t in d for j, x in b if x in t}


# the registered queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(name, spark):
    folder = f"{DATA}/sf0.001"
    assert rows(queries.QUERIES[name](spark, folder).toPandas()) == rows(connect(folder).sql(queries.SQL[name]).df())


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    folder = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = docs
    for _, stage in corpus_pipeline.STAGES[:1]:
        after = stage(spark, after, folder)
    clean = {r.doc_id: r.text for r in after.collect()}
    one = {i: t for i, t in clean.items() if brute_components(clean, 5)[i][1] == i}
    cut = {i: b" ".join(w).decode() for i, w in brute_later(one, 50).items()}
    flat = lambda t: " " + " ".join(decontam.re.findall(r"\w+", t.lower())) + " "
    bench = [flat(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = {i for i, t in cut.items() if not any(b in flat(t) for b in bench)}
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert set(got.doc_id) == want
    tokenizer = word_tokenizer()
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(word_ids(cut[i], tokenizer)) + 1 for i in want}
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_pipeline_of_nulls_ties_and_empties(spark, docs, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(k, 1, int(k % 2)) for k in range(1, 5)] + [(None, None, None), (6, 1, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (None, ""), (2, words(6, 3000)[:200])], "item_id long, text string")
    for part, d in (("full", docs), ("empty", docs.limit(0))):
        d.write.parquet(f"{tmp_path}/{part}/documents.parquet")
        labels.where("true" if part == "full" else "false").write.parquet(f"{tmp_path}/{part}/labels.parquet")
        bench.where("true" if part == "full" else "false").write.parquet(f"{tmp_path}/{part}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    ids = [r.doc_id for r in got]
    assert ids.count(7) == ids.count(8) == ids.count(11) == 1 and ids.count(None) == 1  # the empty text without an id; the copy of 1 without one gave way
    assert 1 in ids and 2 not in ids and 3 not in ids and ids.count(5) == 1
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0

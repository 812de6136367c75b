import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.llm import common, hnsw, mixing, ngram_join, packing, pii_crf, quality_cnn, quality_rules, sharding, suffix_dedup, toxicity_mil

from . import cases


@pytest.fixture(scope="module")
def rows():
    return cases.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, cases.SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_components_find_the_least_node(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(5, 5)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("tile", [ngram_join.TILE, 3000])
def test_ngram_join_matches_all_pairs(docs, rows, tile):
    got = ngram_join.near_duplicates(docs, tile=tile).drop("text_crc32").collect()
    assert sorted(map(tuple, got)) == cases.near_duplicates(pairs(rows))


def test_ngram_join_on_a_chain_and_on_copies(spark):
    base = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(base[i * 12 : i * 12 + 250])) for i in range(12)] + [(50 + i, " ".join(base)) for i in range(30)]
    got = ngram_join.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string").repartition(4), tile=2000).drop("text_crc32")
    assert sorted(map(tuple, got.collect())) == cases.near_duplicates(chain)


def test_keep_one_where_a_doc_id_repeats(spark):
    words = [f"w{i}" for i in range(200)]
    near, far = " ".join(words[:-3]), " ".join(f"x{i}" for i in range(50))
    rows = [(1, " ".join(words)), (1, near), (1, far), (1, far), (2, near), (1, ""), (1, " "), (None, far[:-3]), (None, "only here " * 3), (None, "Only here " * 3)]
    got = [tuple(r) for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    first = min(" ".join(words), near, key=lambda t: zlib.crc32(t.encode()))
    odd = min("only here " * 3, "Only here " * 3, key=lambda t: zlib.crc32(t.encode()))
    assert sorted(got, key=str) == sorted([(1, first), (1, far), (1, ""), (1, " "), (None, odd)], key=str)


def test_tile_bound_never_loses_a_link():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in (1, 2, 30, 100)]
    sets += [np.sort(np.append(s[1 + len(s) // 20 :], np.uint64(7))) for s in sets]
    names = np.arange(len(sets))
    got = ngram_join.tile_links(names, sets, names)
    want = {(i, j) for i in names for j in names if i < j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert {tuple(sorted(p)) for p in got} == want


def test_suffix_dedup_matches_brute_force(docs, rows):
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted(map(tuple, got)) == cases.removed(pairs(rows))


def test_suffix_dedup_keeps_texts_and_handles_ties(spark):
    t = "abcdefghij" * 9
    rows = [(3, t), (3, t), (None, t), (1, "q" + t[:60]), (2, "q" * 49), (4, None)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)
    want = cases.removed([(9 if d is None else d, x) for d, x in rows])
    assert sorted((9 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_loser_tree_merges_with_prefix_lengths():
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 99, (600, suffix_dedup.SPAN), dtype=np.uint8)
    rows[:, 12:] = 97
    parts = [np.unique(rows[i::7], axis=0) for i in range(7)]
    runs, lists = [], []
    for p in parts:
        lcp, rest = suffix_dedup.front_code(p)
        assert (suffix_dedup.front_decode(lcp, rest, suffix_dedup.SPAN) == p).all()
        runs.append(([int.from_bytes(r.tobytes()) for r in p], lcp.tolist()))
        lists += [r.tobytes() for r in p]
    run, at, lcp = suffix_dedup.merge(runs)
    got = [parts[r][i].tobytes() for r, i in zip(run, at)]
    assert got == sorted(lists)
    for a, b, n in zip(got, got[1:], lcp[1:]):
        assert a[:n] == b[:n] and (n == len(a) or a[n] != b[n])


def test_quality_statistics_match(spark, docs, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.judge(docs, labels).select("doc_id", *quality_rules.BASE, "base_failed", "kept").collect()
    want = [(d, *s, not s[-1]) for d, t in pairs(rows) for s in [cases.statistics(t)]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_binomial_tail_is_exact(spark):
    rows = [(k, n) for n in (1, 40, 900, 20000) for k in (0, 1, 3, 8) if k < n * 0.01 or k == 0]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in got:
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.01) + (r.n - i) * math.log(0.99)) for i in range(r.k + 1))
        assert r.p == pytest.approx(want, rel=1e-9)


def test_quality_rules_need_evidence_and_keep_the_good(spark):
    good = [(i, " ".join(f"word{j}" for j in range(i % 40 + 12)), "en") for i in range(6000)]
    junk = [(10000 + i, " ".join(f"w{j}*** {i}%%%" for j in range(20)), "en") for i in range(200)]
    few = [(20000 + i, " ".join(f"w{j}***" for j in range(20)), "de") for i in range(50)]
    docs = spark.createDataFrame(good + junk + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, int(d < 10000)) for d, _, _ in good + junk + few] + [(5, None)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality_rules.keep_good(docs, labels).collect()}
    assert {d for d, _, _ in good} <= kept and not {d for d, _, _ in junk} & kept
    assert {d for d, _, _ in few} <= kept  # a stratum without good labels certifies nothing


def test_one_level_for_all_rules_is_certified_in_each_stratum(spark):
    # 320 good documents of a stratum are enough; one good document more that a stricter level would lose stops there
    text = lambda i, share: " ".join(f"word{j}{'#' * (1 if j < share else 0)}" for j in range(60 + i % 9))
    rows = [(i, text(i, 0), lang) for lang in ("de", "fr") for i in range(1000 if lang == "fr" else 0, (1000 if lang == "fr" else 0) + 320)]
    rows += [(5000 + i, text(i, 22), "de") for i in range(30)] + [(6000 + i, text(i, 22), "fr") for i in range(30)] + [(7000 + i, text(i, 22), "it") for i in range(30)]
    lost = [(1900 + i, text(i, 22), "fr") for i in range(9)]
    docs = spark.createDataFrame(rows + lost, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, int(d < 5000)) for d, _, _ in rows + lost], "doc_id long, quality int")
    level = {r.stratum: r.level for r in quality_rules.levels(quality_rules.features(docs), labels).collect()}
    feats = {r.doc_id: r for r in quality_rules.features(docs).collect()}
    over = lambda d: max(sum(feats[d][r] > c for c in g) for r, g in quality_rules.GRID.items())
    for lang, n_strata in (("de", 2), ("fr", 2)):
        good = [d for d, _, x in rows + lost if x == lang and d < 5000]
        tail = lambda k, n: sum(math.comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1))
        want, n = None, len(good)
        for at in reversed(range(quality_rules.LEVELS)):
            if tail(sum(over(d) > at for d in good), n) > 0.05 / n_strata:
                break
            want = at
        assert level.get(lang) == want
    kept = {r.doc_id for r in quality_rules.keep_good(docs, labels).collect()}
    assert not {5000 + i for i in range(30)} & kept and {6000 + i for i in range(30)} <= kept and {7000 + i for i in range(30)} <= kept


def test_mix_reaches_the_targets(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(cases.WORDS.findall(r[1] or ""))
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        level = rest / sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and level * weight[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(3 * size[r.source] if r.source in capped else level * weight[r.source])
        assert r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 1 for r in got)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_repeated_rows_hold_the_words_taken(docs):
    mixed = common.cut(mixing.mix(docs))
    words = Counter()
    for r in mixing.repeat_rows(mixed, docs.columns).collect():
        words[r.doc_id] += len(cases.WORDS.findall(r.text))
    assert words == Counter({r.doc_id: r.taken for r in mixed.collect() if r.taken})


def test_shards_are_even_and_gapless(spark, docs, rows):
    got = sharding.shuffle_shards(docs, 7, bucket_rows=20).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r.text) for r in got) == Counter(pairs(rows))
    same = spark.createDataFrame([(1, "x")] * 500, "doc_id long, text string")
    assert Counter(r.shard for r in sharding.shuffle_shards(same, 5, bucket_rows=16).collect()) == Counter({s: 100 for s in range(5)})


def test_packing_round_trip(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    odd = [(5000, "<|endoftext|> It's ΣΑΣ İstanbul x\x1cy é ²½ 12a \u0085z"), (5001, "it's we'LL 3.14 ÄÖ-ß " * 30), (5000, "twice")]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = packing.pack(every, length=64).collect()
    want = Counter()
    for d, t in pairs(rows) + odd:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        want[(d, len(ids))] += 1
    space, by_doc, ids_of = defaultdict(list), defaultdict(int), {}
    for d, t in pairs(rows) + odd:
        ids_of.setdefault((d, len(i := [*tok.encode(t or "", add_special_tokens=False).ids, 2])), i)
    for r in got:
        space[r.sequence_id].append((r.offset, r.length))
        by_doc[(r.doc_id, r.doc_tokens)] += r.length
        part = ids_of[(r.doc_id, r.doc_tokens)][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert by_doc == Counter({k: k[1] * n for k, n in want.items()})
    for s, parts in space.items():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == 64 or s == max(space)


def test_hilbert_curve_visits_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_pii_base_matches_the_patterns(docs, rows):
    got = {r.doc_id: r for r in pii_crf.find_pii(docs).collect()}
    for d, t in pairs(rows):
        base = cases.base_spans(t or "")
        assert [got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone] == list(map(len, base))
        assert got[d].base_sha256 == hashlib.sha256(pii_crf.listed(base).encode()).hexdigest()
        assert set(pii_crf.listed(base).split(",")) <= set(got[d].spans.split(","))


def test_pii_patterns_on_random_texts():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        t = "".join(rng.choice(list("ab1234567890..@@--+ ()_é\n"), rng.integers(0, 60)))
        assert pii_crf.base_spans(t) == cases.base_spans(t)


def test_field_adds_repeated_mentions():
    texts = [f"call +1 (888) 555-{1000 + i} now and (888) 555-{1000 + i} later" for i in range(60)] + [f"room {i} has 4{i} chairs" for i in range(60)]
    marked = [f"call +1 (888) 555-{1000 + i} now or +1 (888) 555-{1000 + i} later" for i in range(200)]
    model = pii_crf.fit([pii_crf.Field(t, pii_crf.base_spans(t)) for t in texts[60:] + marked])
    base, every = pii_crf.find(texts[0], model)
    assert len(every[3]) == 2 and base[3][0] in every[3]
    assert "888" in texts[0][slice(*every[3][1])] or "1000" in texts[0][slice(*every[3][1])]
    assert pii_crf.find(texts[70], model)[1] == [[], [], [], []]
    assert pii_crf.masked(texts[0], base) == "call [phone] now and (888) 555-1000 later"


@pytest.mark.parametrize(
    "first,later",
    [
        ("+1 (888) 555-1000", "(888) 555-1000"), ("+1 888 555 1000", "888 555 1000"), ("+1 (888) 555-1000", "8885551000"), ("+18885551000", "8885551000"),
        ("+1 (888) 555-1000", "0018885551000"), ("+1 (888) 555-1000", "1.888.555.1000"), ("+1 (888) 555-1000", "(888) 555-1001"), ("4111 1111 1111 1111", "4111 1111 1111 1112"),
    ],
)
def test_field_adds_whole_mentions(first, later):
    plain = [f"room {i} has 4{i} chairs" for i in range(60)]
    marked = [f"call {first} now or {first} later" for _ in range(200)]
    model = pii_crf.fit([pii_crf.Field(t, pii_crf.base_spans(t)) for t in plain + marked])
    text = f"call {first} now, room 3 has {later} later and 4 chairs"
    base, every = pii_crf.find(text, model)
    assert [text[a:b] for x, y in zip(base, every) for a, b in y if (a, b) not in x] == [later]
    assert not any(c.isdigit() for c in pii_crf.cleaned(f"call {first} or {later}", model))


def test_field_sees_texts_without_a_match():
    model = pii_crf.fit([pii_crf.Field(t, pii_crf.base_spans(t)) for t in [f"room {i} has 4{i} chairs" for i in range(60)] + [f"call +1 (888) 555-{1000 + i} now" for i in range(200)]])
    text = "call +1 (826) 555-4081 190 2000 now"
    assert not any(pii_crf.base_spans("call (826) 555-4081 now")) and not any(pii_crf.base_spans(text))
    assert pii_crf.find("call (826) 555-4081 now", model) == ([[], [], [], []], [[], [], [], [(5, 19)]])
    assert pii_crf.cleaned("call (826) 555-4081 now", model) == "call [phone] now"


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("query,label,least", [("op7_quality_cnn", "quality", 0.95), ("op9_toxicity_mil", "toxic", 0.9)])
def test_classifiers_on_held_out_labels(spark, query, label, least):
    from lintel.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    got = QUERIES[query](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(got["score"].to_numpy(), got[label].to_numpy()) > least


def test_classifiers_on_odd_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(d, i % 2, i % 2) for i, (d, _) in enumerate(pairs(rows))] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for fn in (quality_cnn.quality, toxicity_mil.toxicity):
        for marks in (labels, none):
            got = fn(docs, marks, F.lit(True)).collect()
            assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert fn(empty, none, F.lit(True)).count() == 0


def test_cnn_gradients_match_differences():
    rng = np.random.default_rng(2)
    net = {k: (rng.standard_normal(s) * 0.4).astype(np.float32) for k, s in quality_cnn.SHAPES.items()}
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 5, 200, 700)]
    raw, offs, y = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), np.array([0, 1, 1, 0])

    def loss(n):
        s = quality_cnn.scores(n, raw, offs)
        return -np.mean(np.where(y == 1, np.log(s), np.log(1 - s)))

    grads = quality_cnn.gradients(net, raw, offs, y)
    for name in net:
        i = np.unravel_index(np.abs(grads[name]).argmax(), net[name].shape)
        up, down = ({k: v.astype(np.float64) for k, v in net.items()} for _ in range(2))
        up[name][i] += 1e-4
        down[name][i] -= 1e-4
        assert grads[name][i] == pytest.approx((loss(up) - loss(down)) / 2e-4, rel=0.05)


def test_cnn_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(3)
    net = {k: rng.standard_normal(s).astype(np.float32) for k, s in quality_cnn.SHAPES.items()}
    score = lambda texts: quality_cnn.scores(net, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for text in (b"", b"short", b"x" * 56, bytes(range(256)) * 2):
        alone = score([text])[0]
        for _ in range(20):
            beside = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (70, 9)]
            assert score([beside[0], text, beside[1]])[1] == pytest.approx(alone, rel=1e-5)


def test_words_are_counted_beyond_the_sample(spark):
    plain = "rain and sun. wind in tree. "
    rows = [(i, plain + ("You old zog. " if i % 50 == 0 else "You vile grunk. ") + plain if i % 2 == 0 else plain * 3, int(i % 2 == 0)) for i in range(2000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    texts = dict(r[:2] for r in rows)
    got = [r for r in toxicity_mil.toxicity(docs, labels, F.lit(True), 40).collect() if r.doc_id % 50 == 0]
    assert len(got) == 40 and all("zog" in texts[r.doc_id][r.worst_start : r.worst_end] for r in got)
    # without 'zog' and 'old' known beyond the sample, 'you' alone would point there
    weights = np.frombuffer(toxicity_mil.train(docs, labels, F.lit(True), 40), np.float32)
    cell = toxicity_mil.sentence_words(np.frombuffer(b"zog", np.uint8), np.array([0, 3]))[0][0]
    assert weights[cell] > 1


def test_samples_are_bounded_where_a_doc_id_is_hot(spark):
    rows = [(7, f"text {i % 300}") for i in range(600)] + [(100 + i, f"other {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(d, int(d == 7)) for d in sorted({d for d, _ in rows})], "doc_id long, toxic int")
    got = toxicity_mil.sample(docs, labels, "toxic", F.lit(True), 50).collect()
    assert Counter(r.y for r in got) == {1: 50, 0: 50} and len({(r.doc_id, bytes(r.text)) for r in got}) == 100
    same = spark.createDataFrame([(None, "call 5")] * 900 + [(3, f"call {i}") for i in range(900)], "doc_id long, text string")
    assert pii_crf.training(same, 1.0).count() == 901
    assert 20 < pii_crf.training(same, 0.1).count() < 200


def test_offending_sentence_is_located(spark):
    rng = np.random.default_rng(4)
    plain = lambda n: ". ".join(" ".join(rng.choice(["rain", "sun", "wind", "tree", "road"], 6)) for _ in range(n)) + "."
    rows = [(i, plain(4) + " You are a vile grunk. " + plain(3) if i % 3 == 0 else plain(8), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    texts = dict(r[:2] for r in rows)
    for r in toxicity_mil.toxicity(docs, labels, F.col("doc_id") < 200).collect():
        assert (r.score >= 0.7) == (r.doc_id % 3 == 0)
        if r.doc_id % 3 == 0:
            assert "vile" in texts[r.doc_id][r.worst_start : r.worst_end]


def exact_nearest(vectors, queries, k):
    ids, x = np.array([v[0] for v in vectors]), np.array([v[1] for v in vectors], float)
    out = {}
    for q, v in queries:
        d = np.sqrt(((x - np.array(v, float)) ** 2).sum(1))
        out[q] = [(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return out


def test_hnsw_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((20, 16))
    good = [(i, (centres[i % 20] + 0.3 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(3000)]
    good += [(4000 + i, good[7][1]) for i in range(200)]
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] + [1.0] * 15), (9003, [None] + [1.0] * 15), (9004, [1.0, 2.0]), (9005, []), (None, [1.0] * 16)]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>").repartition(4)
    graphs = common.cut(hnsw.index(df, shard_rows=800))
    got = hnsw.search(graphs, df.where("vec_id % 50 = 0 OR vec_id = 9004 OR vec_id = 4003"), 10).collect()
    want = exact_nearest(good, [g for g in good if g[0] % 50 == 0 or g[0] == 4003], 10)
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == set(want)
    hit = sum(len({v for v, _ in found[q]} & {v for v, _ in w}) for q, w in want.items())
    assert hit / sum(map(len, want.values())) >= 0.95
    assert [v for v, _ in found[4003]] == [v for v, _ in want[4003]]
    assert all(s == pytest.approx(dict(want[q])[v], rel=1e-12) for q, f in found.items() for v, s in f if v in dict(want[q]))


def test_hnsw_ties_go_to_the_smaller_ids(spark):
    rng = np.random.default_rng(4)
    base = np.full(20, 8.0)
    rows = [(0, base.tolist())]
    ids = rng.permutation(np.arange(1, 41)).tolist()
    for i in range(20):
        for sign in (1.0, -1.0):
            v = base.copy()
            v[i] += sign
            rows.append((int(ids[len(rows) - 1]), v.tolist()))
    rows += [(500 + i, (base + 3 + rng.random(20)).tolist()) for i in range(60)]
    vectors = spark.createDataFrame([(*r, 7, 8, "x") for r in rows], "vec_id long, embedding array<float>, shard int, dim int, vec string").repartition(3)
    for shard_rows in (4096, 40):
        got = hnsw.search(common.cut(hnsw.index(vectors, shard_rows)), vectors.where("vec_id = 0"), 10, 12).orderBy("rank").collect()
        assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, i, i, 1.0) for i in range(1, 11)]


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ngram_join.near_duplicates(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert sharding.shuffle_shards(empty, 4).count() == 0
    assert pii_crf.find_pii(empty).count() == 0
    assert quality_rules.judge(empty, labels).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.nearest(vectors, F.col("vec_id") % 100 == 0).count() == 0

"""Each stage of the pipeline against a plain version, on a small corpus with awkward rows."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lintel.llm import packing

from . import cases

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and returned."""
    top = str(tmp_path_factory.mktemp("sf"))
    rows = cases.corpus(seed=3)
    rows += rows[20:25] + [(None, rows[30][1], "en", "s1", 9, 0, "x", 0), (None, "alone " * 3 + "with ten or more words in it to pass base", "en", "s1", 9, 0, "x", 0)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).select(*COLUMNS).repartition(3)
    spark.createDataFrame([(r[0], 1) for r in rows[:80]], "doc_id long, quality int").write.parquet(f"{top}/labels.parquet")
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, top)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == COLUMNS
        out.write.parquet(f"{top}/{name}")
        out = spark.read.parquet(f"{top}/{name}")
        seen.append((docs.collect(), out.collect()))
        docs = out
    return seen


def test_quality_drops_what_fails(stages):
    before, after = stages[0]
    assert Counter(map(tuple, after)) == Counter(tuple(r) for r in before if not cases.statistics(r.text)[-1])


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    far = 1 << 40
    distinct = {(far if r.doc_id is None else r.doc_id, r.text) for r in before}
    by_id = defaultdict(list)
    for d, t in distinct:
        by_id[d].append(t)
    assert all(len(t) == 1 for d, t in by_id.items() if d != far)
    comps = cases.near_duplicates(sorted(distinct), 5, 80)
    want = {d for d, _, c in comps if d == c and d != far}
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in after) == 1


def test_pii_is_masked(stages):
    before, after = stages[2]
    assert len(before) == len(after)
    old = {r.doc_id: r for r in before}
    for r in after:
        assert not any(cases.base_spans(r.text or "")) and r.n_chars == len(r.text)
        if not any(cases.base_spans(old[r.doc_id].text)):
            assert r.text == old[r.doc_id].text


def test_mixing_repeats_rows(stages):
    before, after = stages[3]
    words = lambda rows: sum(len(cases.WORDS.findall(r.text)) for r in rows)
    assert abs(words(before) - words(after)) <= 10
    most = Counter(r.doc_id for r in after)
    assert max(most.values()) <= 3 and set(most) <= {r.doc_id for r in before}


def test_packing_holds_every_row(stages):
    before, after = stages[4]
    assert len({(r.sequence_id, r.offset) for r in after}) == len(after)
    assert sum(r.start == 0 for r in after) == len(before)
    total = sum(r.length for r in after)
    assert max(r.sequence_id for r in after) == (total - 1) // packing.LENGTH


def test_near_copies_at_five_words_and_four_fifths_go(spark):
    words = [f"w{i}" for i in range(200)]
    edited = [w if i % 100 != 50 else "new" for i, w in enumerate(words[:110])]
    texts = [words, words + [f"x{i}" for i in range(40)], words + [f"y{i}" for i in range(80)], edited[:100], words[:100]]
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)]
    sets = [cases.shingles(r[1], 5) for r in rows]
    near = {(i, j) for i in range(5) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert near == {(1, 0), (4, 3)} and all(100 * len(a & b) < 85 * len(a | b) for a, b in [(cases.shingles(rows[1][1]), cases.shingles(rows[0][1]))])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [0, 2, 3]

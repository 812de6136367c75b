"""Operators on rows with extra columns called like every helper column: values pass unchanged, results stay the same."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lintel.llm import mixing, ngram_join, pii_crf, quality_rules

from . import cases

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def helper_names():
    """Every name given to a column in the package's sources."""
    names = set()
    for path in Path(mixing.__file__).parent.glob("*.py"):
        text = path.read_text()
        names |= set(re.findall(r'(?:alias|withColumn|withColumnRenamed|col)\("([A-Za-z_][A-Za-z0-9_]*)"', text))
        names |= set(re.findall(r'"([A-Za-z_][A-Za-z0-9_]*)": F\.', text))
    return sorted(names - {*COLUMNS, "size", "source_size", "target", "taken"} | {"c0", "c1", "_id", "_crc", "_bad_id", "whole", "rest", "l_key", "g_source", "_turn"})


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(*r[:4], len(r[1] or "")) for r in cases.corpus(seed=6)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    extra = plain
    for i, name in enumerate(helper_names()):
        extra = extra.withColumn(name, F.lit(i))
    labels = spark.createDataFrame([(r[0], 1) for r in rows[:80]], "doc_id long, quality int")
    return plain, extra, labels


STEPS = {
    "keep_good": lambda d, labels: quality_rules.keep_good(d, labels),
    "keep_one": lambda d, labels: ngram_join.keep_one(d, 5, 80),
    "mask_pii": lambda d, labels: pii_crf.mask_pii(d),
    "mix": lambda d, labels: mixing.mix(d),
    "repeat_rows": lambda d, labels: mixing.repeat_rows(mixing.mix(d), d.columns),
    "judge": lambda d, labels: quality_rules.judge(d, labels).drop("rules"),
    "near_duplicates": lambda d, labels: ngram_join.near_duplicates(d),
}


@pytest.mark.parametrize("name", STEPS)
def test_values_pass_whatever_columns_are_called(tables, name):
    plain, extra, labels = tables
    assert len(extra.columns) > 60
    want, got = STEPS[name](plain, labels), STEPS[name](extra, labels)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    passed = [c for c in got.columns if c not in want.columns]
    assert passed == ([c for c in extra.columns if c not in want.columns] if name not in ("judge", "near_duplicates") else [])
    if passed:
        place = {n: i for i, n in enumerate(helper_names())}
        assert [tuple(r) for r in got.select(passed).distinct().collect()] == [tuple(place[c] for c in passed)]


def test_the_stages_are_all_covered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_join", "pii", "mixing", "packing"]

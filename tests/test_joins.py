import random
import re

from pyspark.sql import functions as F

from lintel.functions.text import word_key
from lintel.operators import consensus as N
from lintel.operators import dedup as D
from lintel.operators import joins as J

WORD = "project_id string, word_id int, text string"
MARK = "project_id string, mark string"


def test_confusion_reading(spark):
    words = spark.createDataFrame([("P", i, w) for i, w in enumerate(["3003", "3O03", "8A", "303", "(3c03)"])], WORD)

    def read(*marks):
        m = spark.createDataFrame([("P", x) for x in marks], MARK)
        return {r["word_id"]: r["mark"] for r in J.confusion_join(words, m).collect()}

    assert read("3C03") == {4: "3C03"}
    assert read("3003", "BA", "3C3") == {0: "3003", 1: "3003", 2: "BA", 3: "3C3", 4: "3003"}


def test_contains_join_ranks(spark):
    texts = spark.createDataFrame([("P", 1, "D10"), ("P", 2, "TAG D101 X"), ("P", 3, "10"), ("P", 4, "zz")], "project_id string, text_id int, text string")
    marks = spark.createDataFrame([("P", m) for m in ("D10", "D101", "D1")], MARK)
    got = {r["text_id"]: r["mark"] for r in J.contains_join(texts, marks).collect()}
    assert got == {1: "D10", 2: "D101", 3: "D101"}


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_best_is_exact(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("ABC") for _ in range(rng.randint(1, 11))) for _ in range(150)]
    names = [(i, " ".join(rng.choice(words)[::1] + rng.choice(["", "A", "B"]) for _ in range(2))) for i in range(60)]
    left = spark.createDataFrame([("P", i, n) for i, n in names], "project_id string, name_id int, name string")
    right = spark.createDataFrame([("P", w, i) for i, w in enumerate(words)], "project_id string, text string, word_id int")
    for r in (0.8, 0.6):
        got = {(x["name_id"], x["part_no"]): (x["text"], x["word_id"]) for x in J.fuzzy_best(left, right, r).collect()}
        want = {}
        for i, n in names:
            for k, part in enumerate(n.split()):
                if len(part) < 3:
                    continue
                scored = [(-(1 - _lev(part, w) / max(len(part), len(w))), w) for w in set(words)]
                scored = [s for s in scored if -s[0] > r]
                if scored:
                    w = min(scored)[1]
                    want[i, k] = (w, words.index(w))
        assert got == want


def test_fuzzy_best_on_long_words_meets_on_rare_pieces(spark):
    rng = random.Random(12)
    stem = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rng.randint(12, 24))) for _ in range(60)]

    def noisy(w, n):
        for _ in range(n):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("ABCXYZ") + w[i + 1 :], w[:i] + rng.choice("ABCXYZ") + w[i:]])
        return w

    # every word begins alike, so the first pieces are held by all
    words = [(i, "DOOR" + noisy(w, rng.randint(0, 6))) for i, w in enumerate(stem)]
    names = [(i, "DOOR" + w) for i, w in enumerate(stem)]
    right = spark.createDataFrame([("P", w, i) for i, w in words], "project_id string, text string, word_id int")
    left = spark.createDataFrame([("P", i, n) for i, n in names], "project_id string, name_id int, name string")
    got = {r["name_id"]: r["text"] for r in J.fuzzy_best(left, right).collect()}
    want = {}
    for i, n in names:
        scored = [(-(1 - _lev(n, w) / max(len(n), len(w))), w) for _, w in words]
        if any(-s > 0.8 for s, _ in scored):
            want[i] = min(scored)[1]
    assert got == want and 20 < len(want) < 60
    parts = spark.createDataFrame([("P", n, 4) for _, n in names], "project_id string, part string, _k int")
    cand = J._close_candidates(parts, spark.createDataFrame([("P", w, 4) for _, w in words], "project_id string, _w string, _k int"), ["project_id"])
    assert cand.count() < 300


def test_containment_looks_up_the_rarest_piece(spark):
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    inner = sorted({word(rng.randint(1, 6)) for _ in range(120)} | {"the door", "xyz", "q"})
    outer = sorted({word(rng.randint(1, 30)) for _ in range(150)} | {"the door " * 3, "the d", "z"} | {"common the " + word(9) for _ in range(200)})
    a = spark.createDataFrame([(p, x) for p in ("P", "Q") for x in inner], "project_id string, _in string")
    b = spark.createDataFrame([("P", x) for x in outer], "project_id string, _out string")
    got = {(r["_in"], r["_out"]) for r in J.containing(a, b, ["project_id"]).collect()}
    assert got == {(i, o) for i in inner for o in outer if i in o}
    one = a.where("_in = 'the door'")
    assert J.containing_candidates(one, b, ["project_id"]).count() == 1


def test_containment_in_a_very_long_text(spark):
    rng = random.Random(14)
    text = "".join(rng.choice("ABCDEFGHIJ") for _ in range(100_000))
    marks = [text[5000:5012], text[-9:], "K1", text[:1], "ZZTOP"]
    t = spark.createDataFrame([("P", 1, text), ("P", 2, text[5003:5009])], "project_id string, text_id int, text string")
    got = {r["text_id"]: r["mark"] for r in J.contains_join(t, spark.createDataFrame([("P", m) for m in marks], MARK)).collect()}
    assert got == {1: marks[0], 2: marks[0]}


def test_expand_instances_keeps_unlocated(spark):
    rows = spark.createDataFrame([("P", 1, "D1", "D1 COPY"), ("P", 2, "D2", ""), ("P", 3, "D1", None)], "project_id string, row_no int, mark string, original_mark string")
    det = spark.createDataFrame([("P", "D1", "a"), ("P", "D1 COPY", "b"), ("P", "X", "c")], "project_id string, mark string, det_id string")
    got = sorted((r["row_no"], r["det_id"] or "", r["qty"]) for r in J.expand_instances(rows, det).collect())
    assert got == [(1, "a", 1), (1, "b", 1), (2, "", 0), (3, "a", 1)]


def test_audit_only_where_the_pass_ran(spark):
    rows = spark.createDataFrame([("P", "1", "D-1"), ("P", "1", "D2"), ("P", "2", "D3")], "project_id string, page_id string, mark string")
    seen = spark.createDataFrame([("P", "1", "d1"), ("P", "2", "--")], "project_id string, page_id string, mark string")
    got = {r["mark"]: r["needs_review"] for r in J.audit(rows, seen).collect()}
    assert got == {"D-1": False, "D2": True, "D3": False}


def test_three_way_and_totals(spark):
    def f(*rows):
        return spark.createDataFrame(rows, "building string, floor string, unit_type string, n int")

    out = J.three_way({"plan": f(("B", "Level 3", "A2", 6), ("B", "Level 2", "A2", 4)), "matrix": f(("B", "Level 3", "A2", 6), ("B", "Level 2", "A2", 4)), "mix": f(("B", "Level 3", "A2", 5), ("B", "Level 2", "A2", 4))}, ["building", "floor", "unit_type"])
    assert [(r["floor"], r["plan"], r["mix"], r["status"]) for r in out.collect()] == [("Level 3", 6, 5, "VERIFY")]
    stated = spark.createDataFrame([("doors", 358)], "k string, total int")
    got = spark.createDataFrame([("doors", 358), ("windows", 0)], "k string, total int")
    res = {r["k"]: (r["stated_total"], r["delta"], r["match"]) for r in J.reconcile_totals(stated, got, "k").collect()}
    assert res == {"doors": (358, 0, True), "windows": (None, None, None)}


def passes(spark, *sets):
    rows = [("P", "1", i + 1, m) for i, s in enumerate(sets) for m in s]
    return spark.createDataFrame(rows, "project_id string, page_id string, pass_no int, mark string")


def test_consensus(spark):
    agreed = N.jaccard_consensus(passes(spark, "ABCD", "ABCDE")).collect()
    assert {r["mark"] for r in agreed} == set("ABCD") and agreed[0]["match_ratio"] == 0.8 and agreed[0]["method"] == "agreement"
    voted = N.jaccard_consensus(passes(spark, "AB", "BC", "CD")).collect()
    assert {r["mark"] for r in voted} == set("BC") and voted[0]["method"] == "2-of-3"
    assert N.jaccard_consensus(passes(spark, "", "", "AB")).count() == 0
    assert {r["mark"] for r in N.vote(passes(spark, "AB", "BC", "CD")).collect()} == set("BC")


def test_string_consensus(spark):
    df = spark.createDataFrame([("D101", "D101", "x"), ("", "", "zz"), ("D-101", "QQQQQ", "D-101"), ("xx", "D-7777", "D-7777"), ("aa", "bb", "cc")], "pass_1 string, pass_2 string, pass_3 string")
    got = [(r["resolved"], r["needs_review"]) for r in N.string_consensus(df).collect()]
    assert got == [("D101", False), ("", False), ("D-101", False), ("D-7777", False), ("", True)]


def test_dedup_first(spark):
    df = spark.createDataFrame([("P", 0, "D1"), ("P", 1, "d1 draft"), ("P", 2, "D2"), ("P", 3, ""), ("P", 4, None)], "project_id string, row_no int, mark string")
    got = sorted((r["row_no"], r["mark"], r["_original_mark"]) for r in D.dedup_first(df).collect())
    assert got == [(0, "D1", None), (2, "D2", None), (3, "", None), (4, "", None)]


def test_evidence(spark):
    df = spark.createDataFrame([("P", "a", 2, "x"), ("P", "a", 1, "y"), ("P", "b", 1, "x"), ("P", "b", 1, "z"), ("P", "b", 3, "q")], "project_id string, item string, level int, value string")
    got = {r["item"]: (r["level"], r["value"], r["status"]) for r in D.best_evidence(df).collect()}
    assert got == {"a": (1, "y", "VERIFIED"), "b": (1, None, "CONFLICT")}


def test_bifurcated_lookup(spark):
    rows = spark.createDataFrame([("P", 1, "A", "", "va"), ("P", 2, "B.1", "B", "vb1"), ("P", 3, "B.2", "B", "vb2"), ("P", 4, "C.1", None, "vc")], "project_id string, row_no int, mark string, original_tag string, value string")
    det = spark.createDataFrame([("P", m) for m in "ABCD"], MARK)
    got = {r["mark"]: r["value"] for r in J.lookup_with_fallback(det, rows).collect()}
    assert got == {"A": "va", "B": "vb1", "C": "vc", "D": None}


def test_confusion_join_sorts_no_texts_to_aggregate_readings(spark):
    odd = ["#D1.", "D1.\n", "D1.\r\n", "-\n", "..", "", None, "8A", "(D1", "D1\u2028", "D1. \n", "é_"]
    words = spark.createDataFrame([("P", i, w) for i, w in enumerate(odd)] + [("P", 0, "8A"), (None, 99, "D1")], WORD)
    got = {r["i"]: r["w"] for r in words.where("project_id = 'P' and text is not null").select(F.col("word_id").alias("i"), word_key("text").alias("w")).collect() if r["i"]}
    assert got == {i: re.sub(r"^[.,()\[\]{}\-_#*]+|[.,()\[\]{}\-_#*]+(?=(?:\r\n|[\n\r\u2028])?\Z)", "", w).upper() for i, w in enumerate(odd) if i and w is not None}
    marks = spark.createDataFrame([("P", "D1"), ("P", "BA"), (None, "D1")], MARK)
    found = J.confusion_join(words, marks)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert {r["word_id"]: (r["mark"], r["priority"]) for r in found.collect()} == {0: ("D1", 0), 7: ("BA", 4), 8: ("D1", 0)} | {i: ("D1", 0) for i in got if got[i] == "D1"}
    # once before, once after the rows of an id are together; it was four times, over all words
    assert plan.count("SortAggregate") == 2

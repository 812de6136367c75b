import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lintel.operators import spatial as S
from lintel.operators import tables as B
from lintel.operators.scan import folded, islands, of_lists, ordered_scan, splitters, stored

WORD = "project_id string, page_id string, block int, line int, word int, x0 double, y0 double, x1 double, y1 double, text string"


def page(spark, rows):
    """rows: (x0, x1, y, text)."""
    return spark.createDataFrame(
        [("P", "1", 0, 0, i, float(a), float(y), float(b), float(y) + 8, t) for i, (a, b, y, t) in enumerate(rows)], WORD
    )


def test_scan_equals_plain_windows_on_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 11}", rng.randint(0, 5000), i, rng.choice([None, 1, 5, 9])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, pos int, id int, v int").repartition(7)
    got = ordered_scan(df, ["k"], ["pos", "id"], "pos", 97, n=("row_number", None), s=("sum", "v"), m=("max", "v"), l=("last", "v"), p=("lag", "v"))
    w = "over (partition by k order by pos, id"
    want = df.selectExpr(
        "*", f"row_number() {w}) n", f"coalesce(sum(v) {w}), 0) s", f"max(v) {w}) m", f"last(v, true) {w}) l", f"lag(v) {w}) p"
    )
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    runs = islands(df, ["k"], ["pos", "id"], "pos", "_p", "pos", F.col("pos") - F.col("_p") > 6, 97)
    plain = df.selectExpr("*", f"lag(pos) {w}) q").selectExpr("k", "pos", "id", "v", "sum(case when pos - q <= 6 then 0 else 1 end) over (partition by k order by pos, id) island")
    assert runs.exceptAll(plain).count() == 0


def test_scan_of_a_key_whose_rows_are_all_close(spark):
    rng = random.Random(4)
    rows = [("a", rng.random() * 1e-3, i, rng.choice([None, 2, 7])) for i in range(1500)] + [(None, 5.0, i, i) for i in range(300)] + [("b", float(i), i, 1) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, pos double, id int, v int").repartition(5)
    cuts = {r["_on_k"]: r["_cuts"] for r in splitters(df, ["k"], "pos", 100).collect()}
    assert set(cuts) == {"a", None} and cuts[None] == [5.0]
    held = [sum(sum(c < p for c in cuts["a"]) == i for k, p, _, _ in rows if k == "a") for i in range(len(cuts["a"]) + 1)]
    assert len(held) > 200 and max(held) <= 30
    specs = {"n": ("row_number", None), "s": ("sum", "v"), "m": ("max_before", "v"), "l": ("last", "v"), "x": ("next", "v"), "p": ("lag", "v")}
    cut, whole = (ordered_scan(df, ["k"], ["pos", "id"], "pos", most, **specs) for most in (100, 10**6))
    assert splitters(df, ["k"], "pos", 10**6) is None and cut.columns == whole.columns
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
    w = "over (partition by k order by pos, id rows between"
    want = df.selectExpr("*", f"max(v) {w} unbounded preceding and 1 preceding) m", f"first(v, true) {w} current row and unbounded following) x")
    assert sorted(map(str, cut.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_join_words(spark):
    got = sorted((r["x0"], r["x1"], r["text"]) for r in B.join_words(page(spark, [(0, 10, 0, "D"), (11, 15, 0, "-1"), (30, 35, 0, "X"), (34, 40, 0, "Y")])).collect())
    assert got == [(0, 15, "D-1"), (30, 35, "X"), (34, 40, "Y")]


def test_merge_intervals(spark):
    df = spark.createDataFrame([("P", "1", a, b) for a, b in [(0.0, 10.0), (14.0, 20.0), (26.0, 30.0), (1.0, 3.0)]], "project_id string, page_id string, lo double, hi double")
    for most in (4096, 2):
        assert sorted((r["lo"], r["hi"]) for r in B.merge_intervals(df, most=most).collect()) == [(0, 20), (26, 30)]


def test_group_rows_anchors_on_first_word(spark):
    ys = [0, 3, 5, 6, 9.5, 30]
    got = {r["y0"]: r["row_start"] for r in B.group_rows(page(spark, [(0, 1, y, "w") for y in ys]), most=2).collect()}
    assert got == {0: 0, 3: 0, 5: 5, 6: 5, 9.5: 9.5, 30: 30}


def test_line_clusters(spark):
    df = spark.createDataFrame([("P", "1", x, 0.0, y) for x, y in [(1.0, 10.0), (2.0, 30.0), (10.0, 5.0), (12.0, 5.0)]], "project_id string, page_id string, x0 double, y0 double, y1 double")
    got = sorted((r["x"], r["total_len"]) for r in B.line_clusters(df, min_len=20).collect())
    assert got == [(1.5, 40)]


def test_headers(spark):
    df = spark.createDataFrame([("P", "1", i, "GLAZING") for i in range(3)] + [("P", "1", 3, "Mark")], "project_id string, page_id string, col_no int, header string")
    assert [r["header"] for r in B.suffix_duplicates(df).orderBy("col_no").collect()] == ["GLAZING", "GLAZING_1", "GLAZING_2", "Mark"]
    assert [r["header"] for r in B.suffix_duplicates(df, style="print").orderBy("col_no").collect()] == ["GLAZING", "GLAZING 2", "GLAZING 3", "Mark"]
    cells = spark.createDataFrame(
        [("P", "t", r, c, v) for r, row in enumerate([["Mark", "DOOR", ""], ["", "Type", "Finish"], ["D1", "a", "b"]]) for c, v in enumerate(row)]
        + [("P", "u", r, c, v) for r, row in enumerate([["Mark", "Size"], ["D1", "3"]]) for c, v in enumerate(row)],
        "project_id string, table_id string, row_no int, col_no int, value string",
    )
    got = {(r["table_id"], r["col_no"]): (r["header"], r["data_start"]) for r in B.flatten_headers(cells).collect()}
    assert got == {("t", 0): ("Mark", 2), ("t", 1): ("DOOR Type", 2), ("t", 2): ("DOOR Finish", 2), ("u", 0): ("Mark", 1), ("u", 1): ("Size", 1)}


def test_continuations(spark):
    df = spark.createDataFrame(
        [("P", "1", 0, "D1", "see", "w"), ("P", "1", 1, "", "detail", ""), ("P", "1", 2, "", "own", "x"), ("P", "1", 3, "D2", None, "y")],
        "project_id string, page_id string, row_no int, mark string, comments string, width string",
    )
    got = [(r["row_no"], r["mark"], r["comments"]) for r in B.join_continuations(df, others=["width"]).orderBy("row_no").collect()]
    assert got == [(0, "D1", "see detail"), (2, "", "own"), (3, "D2", "")]


TABLE = [
    (10, 40, 0, "MARK"), (80, 120, 0, "DOOR"), (122, 150, 0, "TYPE"), (200, 240, 0, "WIDTH"), (300, 340, 0, "WIDTH"),
    (10, 40, 30, "D101"), (80, 120, 30, "HM"), (200, 240, 30, "3'"), (300, 340, 30, "2'"), (400, 405, 30, "7"),
    (10, 40, 60, "D102"), (80, 120, 60, "WD"), (80, 100, 68, "flush"), (200, 240, 60, "4'"),
]


@pytest.mark.parametrize("ruled", [False, True])
def test_words_to_table(spark, ruled):
    edges = None
    if ruled:
        xs = [5.0, 70.0, 190.0, 290.0, 390.0]
        edges = spark.createDataFrame([("P", "1", x, 0.0, 80.0) for x in xs], "project_id string, page_id string, x0 double, y0 double, y1 double")
    out = B.words_to_table(page(spark, TABLE), edges)
    got = {}
    for r in out.collect():
        got.setdefault(r["row_no"], {})[r["header"]] = r["value"]
    assert {r["mark"] for r in got.values()} == {"D101", "D102"}
    assert got[1]["WIDTH"] == "3'" and got[1]["WIDTH_1"] == "2'" and got[2]["WIDTH_1"] == ""
    assert got[1]["COLUMN_4"] == "7"
    assert got[2]["DOOR TYPE"] == "WD flush"


def test_blank_placeholder_column_goes(spark):
    rows = [r for r in TABLE if r[3] != "7"] + [(400, 405, 0, " ")]
    heads = {r["header"] for r in B.words_to_table(page(spark, rows)).collect()}
    assert not any(h.startswith("COLUMN_") for h in heads)


def random_pages(spark, rng):
    """Ten pages of 20 lines; every third has no mark."""
    rows = []
    for n in range(10):
        for line in range(20):
            for word in range(rng.randint(1, 6)):
                x = word * 40.0 + rng.choice([0, 0, 3])
                t = rng.choice(["HM", "WD", "width", "flush", "D1", "101"] if n % 3 else ["width", "flush", "door"])
                rows.append(("P", f"G{n}", 0, line, word, x, line * rng.choice([3.0, 10.0]), x + rng.randint(5, 39), line * 10.0 + 8, t))
    return spark.createDataFrame(rows, WORD)


def test_words_to_table_joins_no_word_by_its_position(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(B, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, name))
    words = random_pages(spark, random.Random(5))
    B.words_to_table(words)
    # what is stored is made from lists of words: no join is on a word's place, which would send all words again
    joins = [x for p in plans for x in p.splitlines() if "Join" in x]
    assert len(plans) == 2 and joins and not any("_cx" in x or "_cy" in x or "pos" in x for x in joins)
    assert all("collect_list(struct(" in p for p in plans)


def test_nearest_of_lists(spark):
    rng = random.Random(8)
    points = spark.createDataFrame([(f"k{rng.randint(0, 5)}", i, float(rng.randint(0, 60)) if i % 9 else None) for i in range(200)], "k string, id int, pos double")
    stops = spark.createDataFrame([(f"k{rng.randint(0, 4)}", i, float(rng.randint(0, 60))) for i in range(25)], "k string, anchor_id int, pos double")
    spans = spark.createDataFrame([(f"k{k}", i, i * 10.0, i * 10.0 + k) for k in range(5) for i in range(1, 5)], "k string, span_no int, lo double, hi double")
    for near, other in ((S.nearest_1d, stops), (S.nearest_span, spans)):
        want = near(points, other, key=["k"])
        got = near(folded(points, ["k"]), other, lambda p: p["pos"], ["k"], rows="_rows")
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_join_words_lists_a_line_and_cuts_it(spark):
    rng = random.Random(6)
    rows = []
    for line in range(30):
        x = 0.0
        for word in range(rng.randint(1, 12)):
            at = x + rng.choice([0, 1, 2.4, 2.5, 9, -1])
            x = at + rng.randint(1, 5)
            rows.append(("P", "1", line // 7, line, word, at if word % 11 or not line % 4 else None, rng.random(), x if rng.random() < 0.9 else None, rng.random(), f"w{word}"))
    words = spark.createDataFrame(rows, WORD)
    lists, large = B.join_words(words), B.join_words(words, most=4)
    # no running sums over sorted rows, which were sorted again for the texts
    assert "Window" not in lists._jdf.queryExecution().optimizedPlan().toString()
    assert lists.schema.names == large.schema.names and lists.dtypes == large.dtypes
    assert sorted(map(str, lists.collect())) == sorted(map(str, large.collect()))


def test_ordered_text_lists_words_after_they_moved(spark):
    words = spark.createDataFrame([("b", 1.0, 2.0, "c"), ("b", 0.0, 5.0, "a"), ("b", 1.0, 0.0, "b"), ("x", 0.0, 0.0, None), (None, 0.0, 0.0, "n")], "block string, y0 double, x0 double, text string")
    text = B.ordered_text(words, "block")
    assert {r["block"]: r["text"] for r in text.collect()} == {"b": "a b c", "x": "", None: "n"}
    # a list made before the shuffle sorts, and spills, the whole share of a task
    before = text._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")[-1]
    assert "collect_list" not in before


def odd_places(rng, n):
    return [rng.choice([None, float("nan"), float("inf"), float(rng.randint(0, 40)), rng.uniform(0, 40)]) if rng.random() < 0.3 else float(rng.randint(0, 60)) for _ in range(n)]


def test_lists_give_the_same_as_rows(spark):
    rng = random.Random(12)
    rows = [(f"k{k}", a, b, rng.choice(["b", "a", "c"]), rng.random() < 0.8) for k in range(40) for a, b in zip(odd_places(rng, k % 17), odd_places(rng, k % 17))]
    words = spark.createDataFrame(rows, "k string, x0 double, y0 double, text string, is_mark boolean")
    pages = folded(words, ["k"])
    leads = B.line_leads(pages, ["k"])
    want = words.groupBy("k", "y0").agg(F.min(F.struct("x0", "text", "is_mark")).alias("_lead"))
    assert sorted(map(str, leads.collect())) == sorted(map(str, want.collect()))
    # the second column as ends of intervals that begin at the first; those without the flag do not count
    lists = pages.select("k", *[F.col("_rows")[c].alias(c) for c in ("x0", "y0", "is_mark")])
    got = B.merge_intervals(lists, "x0", "y0", key=["k"], on="is_mark")
    want = B.merge_intervals(words.where("is_mark"), "x0", "y0", key=["k"])
    assert got.dtypes == want.dtypes and want.count() > 40
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_stops_of_odd_places(spark):
    rng = random.Random(13)
    points = spark.createDataFrame([(f"k{k}", i, p) for k in range(30) for i, p in enumerate(odd_places(rng, 12))], "k string, id int, pos double")
    stops = spark.createDataFrame([(f"k{k}", i, p) for k in range(28) for i, p in enumerate(odd_places(rng, k % 9)) if p != float("inf")], "k string, anchor_id int, pos double")
    spans = stops.groupBy("k", F.col("pos").alias("lo")).agg(F.min("anchor_id").alias("span_no")).withColumn("hi", F.col("lo") + F.col("span_no") % 3)
    for near, other in ((S.nearest_1d, stops), (S.nearest_span, spans)):
        want = near(points, other, key=["k"]).where("pos is not null and not isnan(pos) and pos < 1e9")
        got = near(folded(points, ["k"]), other, lambda p: p["pos"], ["k"], rows="_rows")
        assert got.where("pos is null").selectExpr("count(*) > 0 and count(anchor_id) = 0" if other is stops else "count(*) > 0 and count(span_no) = 0").first()[0]
        got = got.where("pos is not null and not isnan(pos) and pos < 1e9")
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_words_are_not_sorted_to_place_them(spark, monkeypatch):
    """Words of a page stay one list until their cells are told: Spark sorted all words, and those four times, to look around."""
    plans = []
    monkeypatch.setattr(B, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, name))
    B.words_to_table(random_pages(spark, random.Random(5)))
    assert not any("Window" in x and "_at" in x for p in plans for x in p.splitlines())
    assert "ArrowEvalPython" in plans[0] and "ArrowEvalPython" in plans[1]
    assert not any("inline" in x and "text" in x for x in plans[0].splitlines() if "Generate" in x and "_lead" not in x)


def test_arrow_functions_take_few_lists_at_a_time(spark):
    seen = []

    def work(lists):
        seen.append(len(lists.flatten()))
        return lists

    lists = pa.array([[1.0] * n for n in (0, 3, 9, 1, 1, 40, 0, 2)])
    assert of_lists(work, "array<double>", 8).func(lists).equals(lists)
    assert seen == [3, 11, 40, 2]
    made = spark.range(50).select(F.transform(F.sequence(F.lit(0), F.col("id")), lambda i: i.cast("double")).alias("x"))
    assert made.select(of_lists(lambda x: x, "array<double>", 7)("x").alias("y"), "x").where("x <> y").count() == 0

import random

import pytest

from lintel.functions import text as T
from lintel.operators import cells as C
from tests.fixtures import cells


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r["o"] for r in df.select("i", fn("v").alias("o")).orderBy("i").collect()]


def test_clean_mark(spark):
    assert values(spark, T.clean_mark, ["D-1 COPY", "COPY", "ORIGINAL  A  2", "recopy1"]) == ["D-1", "COPY", "A 2", "recopy1"]


def test_width_inches(spark):
    given = ["3'-0\"", "3-0", "3'", "3", "36", "3'-0\"/3'-0\"", "", "abc", "3'-0 1/2\"", None, "1d"]
    assert values(spark, T.width_inches, given) == [36, 36, 36, 36, 36, 72, 0, 0, 24, 0, 0]


def test_imperial_to_m(spark):
    got = values(spark, T.imperial_to_m, ["3'-0\"", "3'", "1 3/4\"", "1/2\"", "", None])
    assert got == pytest.approx([0.9144, 0.9144, 0.0444, 0.0127, 0, 0], abs=1e-4)


def test_floor_and_mode(spark):
    assert values(spark, T.floor_name, ["STILT FLOOR PLAN", "Parking Level", " First Floor "]) == ["Ground Floor", "Ground Floor", "First Floor"]
    assert values(spark, T.opening_mode_code, ["Single-Leaf", "pair", "2", "Elevator", "zzz"]) == ["SGL", "PR", "CO", "ELEV", "SGL"]


def test_mark_text_and_keys(spark):
    assert values(spark, T.is_mark_text, ["A101", "WIDTH", "ABCD", "Abcde", "3'", "mark."]) == [True, False, True, False, False, False]
    assert values(spark, T.word_key, ["(d-1)", "#A2."]) == ["D-1", "A2"]
    assert values(spark, T.sf_material, ["AL/GL", "N/A", "GLASS DOOR", "METAL", "AL-1"]) == [True, False, True, False, True]


def test_similarity(spark):
    df = spark.createDataFrame([("D-101", "d-101 "), ("abc", "xyz"), (None, "a")], "a string, b string")
    got = [r["r"] for r in df.select(T.similarity("a", "b").alias("r")).collect()]
    assert got == [1.0, 0.0, None]


def test_commands(spark):
    said = ["set outer wall to 9 inches", "wall thickness is 230 mm", "floor height to 10 ft", "foundation depth is 1.5", "num floors to 4", "hello"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = [(r["parameter"], r["value"]) for r in T.command_extract(df, "s").orderBy("i").collect()]
    assert got == [
        ("outer_wall.thickness_m", 0.229), ("outer_wall.thickness_m", 0.23), ("floor_height_m", 3.05),
        ("foundation_depth_m", 1.5), ("num_floors", 4.0), (None, None),
    ]


def test_detail_shift_chains_both_finishes(spark):
    df = spark.createDataFrame([("A1/B2", "C3/D4", "h", "j")], ["FINISH", "FRAME FINISH", "DETAIL HEAD", "DETAIL JAMB"])
    r = T.repair_detail_shift(df).first()
    assert (r["DETAIL HEAD"], r["DETAIL JAMB"], r["DETAIL SILL"], r["FINISH"], r["FRAME FINISH"]) == ("C3/D4", "A1/B2", "h", "", "")


def test_overlay_and_fallback(spark):
    df = spark.sql("select map('a','1','b','2') as x, map('a','','b','9','c','3') as y")
    assert df.select(T.overlay_maps("x", "y").alias("m")).first()["m"] == {"a": "1", "b": "9", "c": "3"}


def test_row_mode_rules(spark):
    rows = [
        ("A", {"No. of Leaves": "2"}), ("B", {"Leaves": "1", "Width": "3'-0\"/3'-0\""}), ("C", {"Width": "3'-0\"/3'-0\""}),
        ("D", {"Width Panel 1": "3'", "Width Panel 2": "2'"}), ("E", {"Size": "3' x 2"}), ("F", {"Width": "3'"}), ("G", {"Size": "(2) 3'"}), ("H", {}),
    ]
    got = {r["row_no"]: r["opening_mode"] for r in C.row_opening_mode(cells(spark, rows)).collect()}
    assert [got[i] for i in range(8)] == ["PR", "SGL", "PR", "PR", "PR", "SGL", "PR", "SGL"]


def test_unit_system_title_wins(spark):
    c = cells(spark, [("A", {"w": "900 mm"})])
    title = spark.createDataFrame([("P", "imperial")], "project_id string, stated_unit string")
    assert T.unit_system(c).first()["unit_system"] == "metric"
    assert T.unit_system(c, title=title).first()["unit_system"] == "imperial"


def test_canonical_header_depends_on_table(spark):
    c = cells(spark, [("A", {"Material": "x", "Hw Set": "y", "odd": "z"})], kind="window")
    got = [r["canonical"] for r in C.canonical_header(c).orderBy("col_no").collect()]
    assert got == ["MARK", "WINDOW MATERIAL", "HARDWARE GROUP NO", "ODD"]


def test_drop_unmarked(spark):
    df = spark.createDataFrame([("D1",), ("Width",), (" ",), (None,)], "mark string")
    assert [r["mark"] for r in T.drop_unmarked(df).collect()] == ["D1"]


def test_block_ratio_is_the_published_one(spark):
    from difflib import SequenceMatcher

    from lintel.functions import blocks

    rng = random.Random(11)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    pairs = [("", ""), ("", "a"), ("a", "a"), ("D-101", "D101"), ("WIKIMEDIA", "WIKIMANIA"), ("ab" * 150, "ba" * 140), ("x" * 300, "x" * 300), ("é漢😀", "漢é😀")]
    pairs += [(word(rng.randint(0, 14), "ABC-1"), word(rng.randint(0, 14), "ABC-1")) for _ in range(600)]
    pairs += [(word(rng.randint(150, 420), s), word(rng.randint(190, 420), s)) for s in ("ab", "abcdefghijklmnopqrstuvwxyz0123456789", "aaaaaaaaaaaaaaaaaaaaaaaaaaaab") for _ in range(6)]
    want = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    got = blocks.ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == want
    assert sum(abs(w - (1 - _edits(a, b) / max(len(a), len(b), 1))) > 0.05 for (a, b), w in zip(pairs[:300], want)) > 100
    df = spark.createDataFrame([(i, f" {a.lower()}", b) for i, (a, b) in enumerate(pairs[:200])] + [(900, None, "a")], "i int, a string, b string")
    got = {r["i"]: r["s"] for r in df.repartition(3).select("i", T.similarity("a", "b").alias("s")).collect()}
    assert got[900] is None
    assert all(got[i] == SequenceMatcher(None, a.upper().strip(), b.upper().strip()).ratio() for i, (a, b) in enumerate(pairs[:200]))


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]

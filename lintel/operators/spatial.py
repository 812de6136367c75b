"""Geometry on drawing pages: grid-bucket joins, zones, nearest anchors, spatial de-duplication.

A distance predicate alone would plan as a nested loop over all pairs. Each join here first
spreads one side over the grid cells it can reach, meets the other side by equality on the
cell, and only then tests the exact predicate. Pairs come out once without a distinct.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel import vocab as V
from lintel.functions import text as T
from lintel.operators.scan import MOST, beside_stops, fields, ordered_scan

BOX = ("x0", "y0", "x1", "y1")


def _list(x):
    return [x] if isinstance(x, str) else list(x)


def _cells(x0, y0, x1, y1, cell):
    """Array of grid cells covered by a rectangle."""

    wide = cell if isinstance(cell, Column) else F.lit(cell)

    def span(a, b):
        return F.sequence(F.floor(a / wide).cast("bigint"), F.floor(b / wide).cast("bigint"))

    return F.flatten(
        F.transform(
            span(x0, x1), lambda i: F.transform(span(y0, y1), lambda j: F.struct(i.alias("cx"), j.alias("cy")))
        )
    )


def _shuffled(df: DataFrame) -> DataFrame:
    """A join side that is never sent whole to every executor through the driver.

    Spark measures a side by its files, before rows are spread over cells: a large table of few bytes a row looks small.
    """
    return df.hint("shuffle_merge")


def _distance(ax, ay, bx, by) -> Column:
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return F.sqrt(dx * dx + dy * dy)


def bbox_join(a: DataFrame, b: DataFrame, pad=V.PATH_PAD, cell=140.0, key=("project_id", "page_id"), a_id="a_id", b_id="b_id") -> DataFrame:
    """Pairs whose boxes share an interior area after padding ``a``: (key, a_id, b_id)."""
    key = _list(key)
    left = a.select(
        *key, a_id, *[(F.col(c) + (pad if c.endswith("1") else -pad)).alias(f"a_{c}") for c in BOX]
    )
    right = b.select(*key, b_id, *[F.col(c).alias(f"b_{c}") for c in BOX])

    def spread(df, p):
        return df.withColumn("_cell", F.explode(_cells(*[F.col(f"{p}_{c}") for c in BOX], cell)))

    pairs = spread(left, "a").join(_shuffled(spread(right, "b")), [*key, "_cell"])
    touch = F.expr("a_x0 < b_x1 and b_x0 < a_x1 and a_y0 < b_y1 and b_y0 < a_y1")
    # The pair belongs to the one cell that holds the low corner of its common area.
    home = (F.col("_cell.cx") == F.floor(F.greatest("a_x0", "b_x0") / F.lit(cell))) & (
        F.col("_cell.cy") == F.floor(F.greatest("a_y0", "b_y0") / F.lit(cell))
    )
    return pairs.where(touch & home).select(*key, a_id, b_id)


def radius_join(a: DataFrame, b: DataFrame, r, cell=None, key=("project_id", "page_id"), strict=False) -> DataFrame:
    """Pairs of points (cx, cy) within ``r``; keeps all columns, ``b`` ones prefixed ``b_``.

    Only ``a`` is spread over cells; ``b`` points sit in one cell each, so no pair repeats.
    """
    key, cell = _list(key), cell or r
    left = a.withColumn(
        "_cell", F.explode(_cells(F.col("cx") - r, F.col("cy") - r, F.col("cx") + r, F.col("cy") + r, cell))
    )
    right = b.select(*key, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in key]).withColumn(
        "_cell",
        F.struct(
            F.floor(F.col("b_cx") / F.lit(cell)).cast("bigint").alias("cx"),
            F.floor(F.col("b_cy") / F.lit(cell)).cast("bigint").alias("cy"),
        ),
    )
    dist = _distance("cx", "cy", "b_cx", "b_cy")
    pairs = left.join(_shuffled(right), [*key, "_cell"]).withColumn("dist", dist).drop("_cell")
    return pairs.where(F.col("dist") < r) if strict else pairs.where(F.col("dist") <= r)


def has_near(a: DataFrame, b: DataFrame, r, ids, key=("project_id", "page_id"), strict=False, also=None) -> DataFrame:
    """Distinct ``ids`` of the points of ``a`` that some point of ``b`` lies within ``r`` of.

    A semi join: a point stops at its first neighbour in each of the few cells it covers, so a crowd
    of neighbours makes no pairs. ``also`` may read ``dist`` and b's columns, prefixed ``b_``.
    """
    key = _list(key)
    spread = F.explode(_cells(F.col("cx") - r, F.col("cy") - r, F.col("cx") + r, F.col("cy") + r, r))
    left = a.select(*key, *ids, F.col("cx").alias("a_cx"), F.col("cy").alias("a_cy"), spread.alias("_cell"))
    right = b.select(*[F.col(k).alias(f"_on_{k}") for k in key], *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in key])
    for c in ("cx", "cy"):
        left = left.withColumn(f"_a{c}", F.col(f"_cell.{c}"))
        right = right.withColumn(f"_b{c}", F.floor(F.col(f"b_{c}") / F.lit(r)).cast("bigint"))
    dist = _distance("a_cx", "a_cy", "b_cx", "b_cy")
    meets = (F.col("_acx") == F.col("_bcx")) & (F.col("_acy") == F.col("_bcy")) & ((dist < r) if strict else (dist <= r))
    for k in key:
        meets = meets & (F.col(k) == F.col(f"_on_{k}"))
    if also is not None:
        meets = meets & also(dist)
    return left.join(_shuffled(right), meets, "left_semi").select(*key, *ids).distinct()


def path_centres(paths: DataFrame) -> DataFrame:
    return paths.withColumns(
        {
            "cx": (F.col("x0") + F.col("x1")) / 2,
            "cy": (F.col("y0") + F.col("y1")) / 2,
            "area": (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")),
        }
    )


def _not_bubble(dist=None):
    return ~(((F.col("dist") if dist is None else dist) < V.BUBBLE_RADIUS) & (F.col("b_area") < V.BUBBLE_AREA))


def path_count(marks: DataFrame, paths: DataFrame, r=V.ARC_RADIUS, key=("project_id", "page_id"), mark_id="mark_id") -> DataFrame:
    """Curved paths centred within ``r`` of each mark, label bubbles ignored; 0 where none.

    Equal path centres are counted first, so a pile of copies meets a mark as one row.
    """
    key = _list(key)
    curves = (
        path_centres(paths.where("has_curve")).groupBy(*key, "cx", "cy", "area").agg(F.count(F.lit(1)).alias("n"))
    )
    spots = marks.select(*key, "cx", "cy").distinct()
    counted = (
        radius_join(spots, curves, r, key=key)
        .where(_not_bubble())
        .groupBy(*key, "cx", "cy")
        .agg(F.sum("b_n").alias("arc_count"))
    )
    return marks.join(_shuffled(counted), [*key, "cx", "cy"], "left").select(
        *key, mark_id, F.coalesce("arc_count", F.lit(0)).alias("arc_count")
    )


def nearest_1d(points: DataFrame, anchors: DataFrame, pos="pos", key=("project_id", "page_id"), anchor="anchor_id", most=MOST, rows=None) -> DataFrame:
    """Nearest anchor per point on a line; ties go to the lower position.

    One scan of the union from both ends: the last anchor at or before, the first at or after. Points may
    come as one row a key with a list ``rows`` of points (see :func:`folded`); ``pos`` is then a function of a point.
    """
    key = _list(key)
    if rows:
        stops = anchors.groupBy(*key, "pos").agg(F.min(anchor).alias("_a"))
        stops = stops.select(*key, F.col("pos").alias("at"), F.coalesce("pos", F.lit(-math.inf)).alias("to"), "pos", F.col("_a").alias("id"))
        both = beside_stops(points, stops, F.transform(rows, pos), key, False, True)
        stop = lambda i: F.get("_stops", F.get("_of", i))
        row = lambda r, i: F.struct(*fields(points, r, rows), stop(i)["id"].alias(anchor), F.abs(pos(r) - stop(i)["pos"]).alias("dist"))
        return both.select(*[c for c in points.columns if c != rows], F.inline(F.transform(rows, row)))
    at, lo, hi = F.col(pos), F.col("_lo"), F.col("_hi")
    best = F.when(lo.isNull(), hi).when(hi.isNull(), lo).when((at - lo["pos"]) <= (hi["pos"] - at), lo).otherwise(hi)
    stops = anchors.groupBy(*key, F.col(pos)).agg(F.min(anchor).alias("_a"))
    stops = stops.withColumns({"_k": F.lit(0), "_s": F.struct(F.col(pos).alias("pos"), F.col("_a").alias("id"))})
    spots = points.select(*key, pos).distinct().withColumn("_k", F.lit(1))
    line = stops.select(*key, pos, "_k", "_s").unionByName(spots, allowMissingColumns=True)
    both = ordered_scan(line, key, [pos, "_k"], pos, most, _lo=("last", "_s"), _hi=("next", "_s"))
    found = both.where("_k = 1").select(*key, pos, best["id"].alias(anchor), F.abs(at - best["pos"]).alias("dist"))
    return points.join(found, [*key, pos], "left")


def nearest_span(points: DataFrame, spans: DataFrame, pos="pos", key=("project_id", "page_id"), span="span_no", most=MOST, rows=None, row=None) -> DataFrame:
    """Span holding each position, else the span with the nearest edge; spans do not overlap.

    One scan from both ends: the last span that starts before the point, the first at or after it. Points may
    come as one row a key with a list ``rows`` of points (see :func:`folded`); ``pos`` is then a function of a point. They
    stay lists, beside the list ``_stops`` of spans, if ``row`` makes a row of a point and its span.
    """
    key = _list(key)
    stop = F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.col(span).alias("n"))
    lo, hi, at = F.col("_lo"), F.col("_hi"), F.col("_at")
    before, after = F.greatest(F.lit(0.0), at - lo["hi"]), hi["lo"] - at
    pick = F.when(lo.isNull(), hi["n"]).when(hi.isNull(), lo["n"]).when(before <= after, lo["n"]).otherwise(hi["n"])
    if rows:
        stops = spans.select(*key, F.col("lo").alias("at"), F.coalesce("hi", F.lit(math.inf)).alias("to"), F.col(span).alias("n"))
        both = beside_stops(points, stops, F.transform(rows, pos), key, True, True)
        flat = row is None
        row = row or (lambda r, n: F.struct(*fields(points, r, rows), n.alias(span)))
        made = F.transform(rows, lambda r, i: row(r, F.get("_stops", F.get("_of", i))["n"]))
        kept = [c for c in points.columns if c != rows]
        return both.select(*kept, F.inline(made)) if flat else both.select(*kept, made.alias(rows), "_stops")
    stops = spans.select(*key, F.col("lo").cast("double").alias("_at"), F.lit(1).alias("_k"), stop.alias("_s"))
    spots = points.select(*key, F.col(pos).cast("double").alias("_at")).distinct().withColumn("_k", F.lit(0))
    line = stops.unionByName(spots, allowMissingColumns=True)
    both = ordered_scan(line, key, ["_at", "_k"], "_at", most, _lo=("last", "_s"), _hi=("next", "_s"))
    found = both.where("_k = 0").select(*key, F.col("_at").alias(pos), pick.alias(span))
    return points.join(found, [*key, pos], "left")


def _segment_distance(px, py, s="s", row=None):
    """How far a place is from the segment of columns named ``s`` and a corner, of ``row`` where they are its fields."""
    x0, y0, x1, y1 = (F.col(f"{s}{c}") if row is None else row[f"{s}{c}"] for c in BOX)
    dx, dy = x1 - x0, y1 - y0
    len2 = dx * dx + dy * dy
    t = ((px - x0) * dx + (py - y0) * dy) / F.nullif(len2, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))
    return F.sqrt(F.pow(px - (x0 + t * dx), 2) + F.pow(py - (y0 + t * dy), 2))


#: Pages with at most so many segments are searched whole. Each level of the pyramid reaches so many times farther; above the last a page is one cell.
FEW_SEGMENTS, WIDER, LEVELS = 32, 3, 12


def _pyramid(segs: DataFrame, reach, key) -> DataFrame:
    """Segments by (key, _level, _cell): those within the level's reach of any place in the cell, and some more.

    A level's cells are as wide as it reaches, ``reach`` times WIDER to the level. The last level has one cell.
    """
    level = segs.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    wide = F.lit(float(reach)) * F.pow(F.lit(float(WIDER)), F.col("_level"))
    cover = _cells(
        F.least("sx0", "sx1") - wide, F.least("sy0", "sy1") - wide, F.greatest("sx0", "sx1") + wide, F.greatest("sy0", "sy1") + wide, wide
    )
    pad = wide * (1 + math.sqrt(2) / 2)
    cover = F.filter(cover, lambda c: _segment_distance((c["cx"] + 0.5) * wide, (c["cy"] + 0.5) * wide) <= pad)
    whole = F.struct(F.lit(0).cast("bigint").alias("cx"), F.lit(0).cast("bigint").alias("cy"))
    return level.withColumn("_cell", F.explode(cover)).unionByName(segs.select("*", F.lit(LEVELS).alias("_level"), whole.alias("_cell")))


def _cell_at(reach, level):
    """The cell of (cx, cy) at a level of the pyramid."""
    wide = F.lit(float(reach)) * F.pow(F.lit(float(WIDER)), level)
    place = lambda c: F.when(level >= LEVELS, 0).otherwise(F.floor(F.col(c) / wide)).cast("bigint").alias(c)
    return F.struct(place("cx"), place("cy"))


def _many(segs: DataFrame, key) -> DataFrame:
    """Pages with more than FEW_SEGMENTS segments."""
    return segs.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW_SEGMENTS).select(*key)


def _far_nearest(spots: DataFrame, segs: DataFrame, reach, key) -> DataFrame:
    """(key, cx, cy, dist) of places to the nearest segment of their page, however far.

    A place looks up its cell at each level; the first level whose cell holds anything has a segment within
    (1 + sqrt 2) times its reach, so the level after it, which reaches WIDER times as far, holds the nearest.
    """
    dist = _segment_distance(F.col("cx"), F.col("cy"))
    large = _many(segs, key)
    # the few segments of a page come as one list, so a place stays one row and need not be put together again
    few = segs.join(large, key, "left_anti").groupBy(*key).agg(F.collect_list(F.struct(*[f"s{c}" for c in BOX])).alias("_few"))
    each = F.transform("_few", lambda s: _segment_distance(F.col("cx"), F.col("cy"), row=s))
    near = spots.join(few, key).select(*key, "cx", "cy", F.array_min(each).alias("dist"))
    tall = _pyramid(segs.join(large, key, "left_semi"), reach, key)
    held = tall.select(*key, "_level", "_cell").distinct()
    asks = spots.join(large, key, "left_semi").withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    asks = asks.withColumn("_cell", _cell_at(reach, F.col("_level")))
    first = asks.join(held, [*key, "_level", "_cell"], "left_semi").groupBy(*key, "cx", "cy").agg(F.min("_level").alias("_level"))
    first = first.withColumn("_level", F.least(F.col("_level") + 1, F.lit(LEVELS)))
    first = first.withColumn("_cell", _cell_at(reach, F.col("_level")))
    far = first.join(tall, [*key, "_level", "_cell"]).groupBy(*key, "cx", "cy").agg(F.min(dist).alias("dist"))
    return near.unionByName(far)


def _between(w="w", s="s"):
    """How far two segments are apart: 0 where they cross, else as far as the nearest end of one from the other."""

    def side(ax, ay, bx, by, px, py):
        return F.signum((F.col(bx) - F.col(ax)) * (F.col(py) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(px) - F.col(ax)))

    a, b = [f"{s}{c}" for c in BOX], [f"{w}{c}" for c in BOX]
    crossing = (side(*a, *b[:2]) * side(*a, *b[2:]) < 0) & (side(*b, *a[:2]) * side(*b, *a[2:]) < 0)
    ends = F.least(
        _segment_distance(F.col(b[0]), F.col(b[1]), s), _segment_distance(F.col(b[2]), F.col(b[3]), s),
        _segment_distance(F.col(a[0]), F.col(a[1]), w), _segment_distance(F.col(a[2]), F.col(a[3]), w),
    )
    return F.when(crossing, 0.0).otherwise(ends)


def wall_offsets(walls: DataFrame, segs: DataFrame, reach, key) -> DataFrame:
    """Walls (key, wx0, wy0, wx1, wy1) with ``_off``, their distance to the nearest segment of the page.

    No segment nearer than the one nearest to a wall's middle is farther from the middle than that plus half the
    wall, so one cell of the pyramid, at the level that reaches so far, holds the nearest.
    """
    large = _many(segs, key)
    near = walls.join(segs.join(large, key, "left_anti"), key).groupBy(*walls.columns).agg(F.min(_between()).alias("_off"))
    middle = walls.join(large, key, "left_semi").withColumns({"cx": (F.col("wx0") + F.col("wx1")) / 2, "cy": (F.col("wy0") + F.col("wy1")) / 2})
    many = segs.join(large, key, "left_semi")
    first = _far_nearest(middle.select(*key, "cx", "cy").distinct(), many, reach, key)
    radius = F.col("dist") + F.hypot(F.col("wx1") - F.col("wx0"), F.col("wy1") - F.col("wy0")) / 2
    steps = F.ceil(F.log(F.greatest(radius / reach, F.lit(1.0))) / math.log(WIDER) + 1e-9)
    asks = middle.join(first, [*key, "cx", "cy"]).withColumn("_level", F.least(steps, F.lit(LEVELS)).cast("int"))
    asks = asks.withColumn("_cell", _cell_at(reach, F.col("_level"))).drop("dist")
    far = asks.join(_pyramid(many, reach, key), [*key, "_level", "_cell"]).groupBy(*walls.columns).agg(F.min(_between()).alias("_off"))
    return near.unionByName(far)


def host_distance(points: DataFrame, walls: DataFrame, segments: DataFrame, dist: DataFrame, reach=V.HOST_WALL_REACH, key=("project_id", "page_id"), point_id="point_id") -> DataFrame:
    """``dist`` (point_id, dist to the boundary) with ``host_dist``: how far the host wall is from the boundary.

    The host is, of the walls within ``reach`` of the point, the one nearest to the boundary; without
    one the point's own distance counts. Two segments are 0 apart where they cross, else as far as the
    nearest end of one from the other.
    """
    key = _list(key)
    wall = walls.select(*key, *[F.col(c).alias(f"w{c}") for c in BOX]).distinct()
    segs = segments.select(*key, *[F.col(c).alias(f"s{c}") for c in BOX]).distinct()
    off = wall_offsets(wall, segs, reach, key)
    cover = _cells(F.least("wx0", "wx1") - reach, F.least("wy0", "wy1") - reach, F.greatest("wx0", "wx1") + reach, F.greatest("wy0", "wy1") + reach, reach)
    pad = reach * (1 + math.sqrt(2) / 2)
    cover = F.filter(cover, lambda c: _segment_distance((c["cx"] + 0.5) * F.lit(reach), (c["cy"] + 0.5) * F.lit(reach), "w") <= pad)
    cell = F.struct(*[F.floor(F.col(c) / F.lit(reach)).cast("bigint").alias(c) for c in ("cx", "cy")])
    spots = points.select(*key, "cx", "cy").distinct().withColumn("_cell", cell)
    near = spots.join(off.withColumn("_cell", F.explode(cover)), [*key, "_cell"]).where(_segment_distance(F.col("cx"), F.col("cy"), "w") <= reach)
    host = near.groupBy(*key, "cx", "cy").agg(F.min("_off").alias("_off"))
    at = points.select(*key, point_id, "cx", "cy").join(host, [*key, "cx", "cy"], "left").select(*key, point_id, "_off")
    return dist.join(at, [*key, point_id]).withColumn("host_dist", F.coalesce("_off", "dist")).drop("_off")


def nearest_segment(points: DataFrame, segments: DataFrame, bands=V.BOUNDARY_BANDS, cell=None, key=("project_id", "page_id"), point_id="point_id") -> DataFrame:
    """Distance to the nearest boundary segment of the page, and its zone.

    Segments near a point are found by grid cell; points that have none within the outer band look in wider
    and wider cells. Pages of a few segments are searched whole. Pages without any segment have no distance and are borderline.
    """
    key = _list(key)
    near, reach = bands
    segs = segments.select(*key, *[F.col(c).alias(f"s{c}") for c in BOX]).distinct()
    spots = points.select(*key, "cx", "cy").distinct()
    best = _far_nearest(spots, segs, cell or reach, key)
    d = F.col("dist")
    zone = (
        F.when(d.isNull(), "borderline")
        .when(d <= near, "perimeter")
        .when(d <= reach, "borderline")
        .otherwise("inside")
    )
    return (
        points.join(best, [*key, "cx", "cy"], "left")
        .select(*key, point_id, "dist", zone.alias("zone"), (zone == "borderline").alias("is_borderline"))
    )


def outside_zones(points: DataFrame, zones: DataFrame, key=("project_id", "page_id"), cell=250.0) -> DataFrame:
    """Points outside every zone rectangle of their page.

    A zone is cut to the cells it covers; a page has few zones, so the copied side stays small.
    """
    key = _list(key)
    z = zones.select(*key, *[F.col(c).alias(f"z_{c}") for c in BOX]).distinct()
    z = z.withColumn("_cell", F.explode(_cells(*[F.col(f"z_{c}") for c in BOX], cell)))
    p = points.withColumn(
        "_cell",
        F.struct(
            F.floor(F.col("cx") / F.lit(cell)).cast("bigint").alias("cx"),
            F.floor(F.col("cy") / F.lit(cell)).cast("bigint").alias("cy"),
        ),
    )
    on = [p[k] == z[k] for k in key] + [
        p["_cell"] == z["_cell"], p["cx"].between(z["z_x0"], z["z_x1"]), p["cy"].between(z["z_y0"], z["z_y1"]),
    ]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return p.join(z, cond, "left_anti").drop("_cell")


def schedule_zones(titles: DataFrame, pages: DataFrame, key=("project_id", "page_id")) -> DataFrame:
    """Rectangle from just above a schedule title to the far page corner."""
    key = _list(key)
    return (
        titles.where(T.any_of(F.upper("text"), V.SCHEDULE_TITLES))
        .join(pages.select(*key, "page_w", "page_h"), key)
        .select(
            *key, (F.col("x0") - 20).alias("x0"), (F.col("y0") - 50).alias("y0"),
            F.col("page_w").alias("x1"), F.col("page_h").alias("y1"),
        )
    )


def drop_labelled_blocks(words: DataFrame, keywords=None, key=("project_id", "page_id"), block="block") -> DataFrame:
    """Words of text blocks that hold no room word.

    The blocks of a task are looked up in a hash table, one row a block, so that no word has to be sorted.
    """
    key = _list(key)
    keywords = V.ROOM_WORDS if keywords is None else keywords
    labels = (
        words.where(F.exists(T.words_of("text", V.WORD_PUNCT + "/"), lambda w: F.lower(w).isin(list(keywords))))
        .select(*key, block)
        .distinct()
    )
    return words.join(labels.hint("shuffle_hash"), [*key, block], "left_anti")


def prefer_if_any(df: DataFrame, flag="in_circle", key=("project_id", "page_id", "mark")) -> DataFrame:
    """Flagged rows where their group has any, else the whole group. No window over the group."""
    key = _list(key)
    has = df.where(F.col(flag)).select(*key).distinct()
    return df.where(F.col(flag)).unionByName(df.where(~F.coalesce(F.col(flag), F.lit(False))).join(has, key, "left_anti").select(*df.columns))


def in_tag_circle(words: DataFrame, paths: DataFrame, key=("project_id", "page_id"), mark_id="mark_id") -> DataFrame:
    """Words whose centre lies in a small round path."""
    key = _list(key)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    round_ = paths.where(F.col("has_curve") & w.between(12, 35) & h.between(12, 35) & (F.abs(w - h) <= 4))
    spots = path_centres(round_).select(*key, "cx", "cy").distinct()
    hit = has_near(words, spots, 12.0, [mark_id], key)
    return words.join(_shuffled(hit.withColumn("in_circle", F.lit(True))), [*key, mark_id], "left").withColumn(
        "in_circle", F.coalesce("in_circle", F.lit(False))
    )


def _rows_at(df, kept, key, order):
    """Rows of ``df`` that hold the best rank of a kept position."""
    winners = kept.select(*key, F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("r"))
    return df.join(winners, [*key, "cx", "cy"]).where(order == F.col("r")).select(*df.columns)


#: Cells along a side of the squares in which de-duplication meets points; a point near a side is copied to the squares beyond it.
SQUARE = 8


def _squares(c, around: int):
    """The squares that hold a cell or one up to ``around`` cells from it, as an array."""
    span = lambda x: F.sequence(F.floor((c[x] - around) / SQUARE), F.floor((c[x] + around) / SQUARE))
    return F.flatten(F.transform(span("cx"), lambda i: F.transform(span("cy"), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def spatial_dedup(df: DataFrame, eps=V.DEDUP_EPS, rank=("neg_arcs", "row_id"), key=("project_id", "page_id", "mark"), exact=False) -> DataFrame:
    """Points that no better-ranked point lies within ``eps`` of, on both axes.

    With ``exact`` a dropped point covers nothing: points are taken in rank order, each unless a kept
    one is near. Points of one cell of side ``eps`` are all near each other, so only a cell's best can
    stay, and it alone looks around: at the points of its square of cells and those within a cell of that. The greedy form is sequential along a page: a
    sorted stream in which a task holds the kept points of its page, at most one a cell.
    Ranks are taken to be unique; rows that tie stay together.
    """
    key, rank = _list(key), _list(rank)
    order = F.struct(*rank)
    # Among equal positions only the best can stay, whatever happens around it.
    spots = df.groupBy(*key, F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.min(order).alias("r"))
    if exact:
        return _rows_at(df, _greedy(spots, eps, key), key, order)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*key, "cx", "cy"]])
    placed = df.where(known).withColumns({"_cell": F.struct(*[F.floor(F.col(c) / F.lit(eps)).cast("bigint").alias(c) for c in ("cx", "cy")]), "_rank": order})
    # Spark keeps a cell's best of each partition before it shuffles
    first = F.rank().over(Window.partitionBy(*key, "_cell").orderBy("_rank"))
    best = placed.withColumn("_place", first).where("_place = 1").withColumn("_at", F.get(_squares(F.col("_cell"), 0), 0))
    cell = F.struct(*[F.floor(F.col(c) / F.lit(eps)).cast("bigint").alias(f"c{c}") for c in "xy"])
    other = spots.select(*[F.col(k).alias(f"_on_{k}") for k in key], "x", "y", "r", F.explode(_squares(cell, 1)).alias("_in"))
    meets = (F.col("_at") == F.col("_in")) & (F.abs(F.col("cx") - F.col("x")) < eps) & (F.abs(F.col("cy") - F.col("y")) < eps) & (F.col("r") < F.col("_rank"))
    for k in key:
        meets = meets & (F.col(k) == F.col(f"_on_{k}"))
    return best.join(_shuffled(other), meets, "left_anti").select(*df.columns)


def _greedy(spots: DataFrame, eps: float, key: list[str]) -> DataFrame:
    def walk(batches):
        page, kept = None, {}
        for pdf in batches:
            take = []
            for *k, x, y in pdf[[*key, "x", "y"]].itertuples(index=False):
                if k != page:
                    page, kept = k, {}
                i, j = math.floor(x / eps), math.floor(y / eps)
                around = (kept.get((a, b)) for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1))
                take.append(not any(p and abs(p[0] - x) < eps and abs(p[1] - y) < eps for p in around))
                if take[-1]:
                    kept[(i, j)] = (x, y)
            yield pdf[[*key, "x", "y"]][take]

    rows = spots.repartition(*key).sortWithinPartitions(*key, "r")
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*key, "x", "y"])
    kept = rows.select(*key, "x", "y").mapInPandas(walk, schema)
    return kept.join(spots, [*key, "x", "y"])


def leaf_groups(paths: DataFrame, eps=V.LEAF_EPS, key=("project_id", "page_id", "mark_id")) -> DataFrame:
    """Number of separate swing-arc groups per mark: arcs within ``eps`` of any member join.

    Input is the distinct arc centres around one mark (see :func:`arcs_near`), which the search radius
    bounds. Centres are taken in turn; each joins the groups it is near into one.
    """
    key = _list(key)

    def take(groups, p):
        near = lambda g: F.exists(g, lambda q: F.hypot(q["cx"] - p["cx"], q["cy"] - p["cy"]) < F.lit(eps))
        one = F.concat(F.flatten(F.filter(groups, near)), F.array(p))
        return F.concat(F.filter(groups, lambda g: ~near(g)), F.array(one))

    centre = F.struct(F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"))
    arcs = paths.groupBy(*key).agg(F.array_sort(F.collect_set(centre)).alias("_p"))
    none = F.array().cast("array<array<struct<cx:double,cy:double>>>")
    return arcs.select(*key, F.size(F.aggregate("_p", none, take)).cast("int").alias("leaf_groups"))


def arcs_near(marks: DataFrame, paths: DataFrame, r=V.ARC_RADIUS, key=("project_id", "page_id"), mark_id="mark_id") -> DataFrame:
    """Distinct arc centres around each mark, label bubbles left out."""
    key = _list(key)
    arcs = path_centres(paths.where("has_curve")).select(*key, "cx", "cy", "area").distinct()
    near = radius_join(marks, arcs, r, key=key).where(_not_bubble())
    return near.select(*key, mark_id, F.col("b_cx").alias("cx"), F.col("b_cy").alias("cy")).distinct()


def mode_from_paths(marks: DataFrame, paths: DataFrame, facts: DataFrame | None = None, key=("project_id", "page_id"), mark_id="mark_id") -> DataFrame:
    """Opening mode of each mark: schedule facts first, then dashed swings, then arc groups.

    ``facts`` may give ``fact_mode`` per (project_id, mark); see :func:`fact_mode`.
    """
    key = _list(key)
    long_straight = ~F.col("has_curve") & ((F.col("x1") - F.col("x0") > 80) | (F.col("y1") - F.col("y0") > 80))
    dashes = path_centres(paths.where(F.col("is_dashed") & ~long_straight)).select(*key, "cx", "cy", "area").distinct()
    dashed = has_near(marks, dashes, V.DASH_RADIUS, [mark_id], key, strict=True, also=_not_bubble)
    groups = leaf_groups(arcs_near(marks, paths, key=key, mark_id=mark_id), key=[*key, mark_id])
    out = marks.join(_shuffled(dashed.withColumn("_dash", F.lit(True))), [*key, mark_id], "left").join(
        _shuffled(groups), [*key, mark_id], "left"
    )
    fact = F.lit(None).cast("string")
    if facts is not None:
        out = out.join(facts.select("project_id", "mark", "fact_mode"), ["project_id", "mark"], "left")
        fact = F.col("fact_mode")
    drawn = F.when(F.col("_dash"), "DA").when(F.col("leaf_groups") >= 2, "PR").otherwise("SGL")
    return out.select(*key, mark_id, F.coalesce(fact, drawn).alias("opening_mode"))


def fact_mode():
    """Mode settled by schedule facts alone, NULL when the drawing has to decide.

    Reads door_material, frame_material, door_type, comments, width_a and width_b.
    """
    mat, frame, dtype, note = (F.col(c) for c in ("door_material", "frame_material", "door_type", "comments"))
    a, b = (T.text_of(c) for c in ("width_a", "width_b"))
    has_a, has_b = ~a.isin("", "-"), ~b.isin("", "-")
    words = F.array(*[F.lit(w) for w in V.DOUBLE_ACTING_WORDS])
    acting = (
        T.any_of(dtype, V.DOUBLE_ACTING_PHRASES) | T.any_of(note, V.DOUBLE_ACTING_PHRASES)
        | F.arrays_overlap(T.words_of(dtype), words) | F.arrays_overlap(T.words_of(note), words)
    )
    store = V.PATH_STOREFRONT_MATERIAL
    return (
        F.when(mat.isin(store) | frame.isin(store) | T.any_of(note, V.PATH_STOREFRONT_COMMENT), "STOREFRONT")
        .when(has_a & has_b, "PR")
        .when(has_a, "SGL")
        .when(mat.isin(V.BLANK_CASED_MATERIAL) & dtype.isin(V.BLANK_CASED_TYPE), "CO")
        .when(dtype.isin(V.CASED_TYPES), "CO")
        .when(acting, "DA")
    )

"""Tables rebuilt from positioned words, and other order-dependent row work."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel import vocab as V
from lintel.functions import text as T
from lintel.operators.scan import MOST, beside_stops, folded, islands, of_lists, ordered_scan, splitters, stored
from lintel.operators.spatial import nearest_1d, nearest_span

PAGE = ("project_id", "page_id")


def _list(x):
    return [x] if isinstance(x, str) else list(x)


def ordered_join(value, order, sep=" "):
    """Aggregate: values joined in ``order``."""
    entry = F.struct(*[F.col(o) for o in order], F.col(value).alias("_v"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["_v"]), sep)


def join_words(words: DataFrame, gap=V.WORD_GAP, key=PAGE, most=MOST) -> DataFrame:
    """Glue words of one line whose horizontal gap is 0 <= gap < ``gap``."""
    line = [*_list(key), "block", "line"]

    def is_break(x0, before):
        return ~((x0 - before >= 0) & (x0 - before < gap))

    cuts = splitters(words, line, "x0", most)
    if cuts is None:  # a line is one list, cut where it breaks
        rows = words.select(*line, "x0", "word", "text", "x1", "y0", "y1").repartition(*line).withColumn("_id", F.xxhash64(*line))
        rows = folded(rows, ["_id", *line], "_ws").select(*line, F.array_sort("_ws").alias("_ws"))  # sorted by a number first
        opens = F.transform("_ws", lambda w, i: F.when((i == 0) | F.coalesce(is_break(w["x0"], F.get("_ws", i - 1)["x1"]), F.lit(True)), i))
        rows = rows.select(*line, "_ws", F.filter(opens, lambda i: i.isNotNull()).alias("_at"))
        pieces = F.transform("_at", lambda i, n: F.slice("_ws", i + 1, F.coalesce(F.get("_at", n + 1), F.size("_ws")) - i))
        runs = rows.select(*line, F.posexplode(pieces).alias("_n", "_run"))
        run, start = F.col("_run"), F.element_at("_run", 1)
        return runs.select(
            *line,
            (F.col("_n") + 1).cast("bigint").alias("island"),
            F.array_join(run["text"], "").alias("text"),
            F.array_min(run["x0"]).alias("x0"),
            start["y0"].alias("y0"),
            F.element_at("_run", -1)["x1"].alias("x1"),
            F.array_max(run["y1"]).alias("y1"),
            start["word"].alias("word"),
        )
    runs = islands(words, line, ["x0", "word"], "x0", "_px1", "x1", is_break(F.col("x0"), F.col("_px1")), cuts=cuts)
    return runs.groupBy(*line, "island").agg(
        ordered_join("text", ["x0", "word"], "").alias("text"),
        F.min("x0").alias("x0"),
        F.min_by("y0", F.struct("x0", "word")).alias("y0"),
        F.max_by("x1", F.struct("x0", "word")).alias("x1"),
        F.max("y1").alias("y1"),
        F.min_by("word", F.struct("x0", "word")).alias("word"),
    )


def merge_intervals(df: DataFrame, lo="lo", hi="hi", tol=V.INTERVAL_TOLERANCE, key=PAGE, most=MOST, on=None) -> DataFrame:
    """Union of intervals that overlap or lie within ``tol``: (key, span_no, lo, hi).

    Intervals may come as one row a key: with ``on``, the name of a list that tells which of them count, ``lo`` and ``hi`` are lists.
    """
    key = _list(key)
    if on:
        lists = df.select(*key, _merged(tol)(F.col(lo).cast("array<double>"), F.col(hi).cast("array<double>"), F.col(on)).alias("_spans"))
        spans = lists.select(*key, F.posexplode(F.arrays_zip(F.col("_spans")["lo"].alias("lo"), F.col("_spans")["hi"].alias("hi"))).alias("_n", "_s"))
        return spans.select(*key, (F.col("_n") + 1).cast("bigint").alias("span_no"), "_s.lo", "_s.hi")
    uniq = df.groupBy(*key, F.col(lo).alias("lo")).agg(F.max(hi).alias("hi"))
    cuts = splitters(uniq, key, "lo", most)
    ends = ordered_scan(uniq, key, ["lo"], "lo", cuts=cuts, _m=("max_before", "hi"))
    ends = ends.withColumn("_opens", F.coalesce((F.col("lo") > F.col("_m") + tol).cast("int"), F.lit(1)))
    runs = ordered_scan(ends, key, ["lo"], "lo", cuts=cuts, span_no=("sum", "_opens"))
    return runs.groupBy(*key, "span_no").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _merged(tol):
    """Arrow function of lists of ends of intervals, and which of them count: the lists of the ends of their unions."""

    def merge(lo, hi, on):
        size = np.diff(lo.offsets.to_numpy())
        on = on.flatten().fill_null(False).to_numpy(zero_copy_only=False)
        page = np.repeat(np.arange(len(size)), size)[on]
        lo, hi = (c.flatten().filter(pa.array(on)) for c in (lo, hi))
        (has_lo, lo), (has_hi, hi) = ((c.is_valid().to_numpy(zero_copy_only=False), c.fill_null(0).to_numpy()) for c in (lo, hi))
        order = np.lexsort((lo, page) if has_lo.all() else (lo, has_lo, page))  # nulls come first, nan last
        page, lo, hi, has_lo, has_hi = (c[order] for c in (page, lo, hi, has_lo, has_hi))

        def begins(*columns):
            differ = [(c[1:] != c[:-1]) & ((c[1:] == c[1:]) | (c[:-1] == c[:-1])) for c in columns]
            return np.flatnonzero(np.concatenate((np.ones(min(len(page), 1), bool), np.logical_or.reduce(differ))))

        def most(at):
            """Of each stretch the largest end, nan before all, and whether it has any."""
            return np.maximum.reduceat(np.where(has_hi, hi, -np.inf), at), np.logical_or.reduceat(has_hi, at)

        if len(page):
            at = begins(page, has_lo, lo)  # of those that begin alike one
            (hi, has_hi), page, lo, has_lo = most(at), page[at], lo[at], has_lo[at]
            by, rank = np.lexsort((hi, has_hi, page)), np.empty(len(page), np.int64)
            rank[by] = np.arange(len(page))
            reach = by[np.maximum.accumulate(rank)]  # pages follow each other in rank
            first = np.concatenate(([True], page[1:] != page[:-1]))
            before = np.concatenate(([0], reach[:-1]))
            end = hi[before] + tol
            opens = first | ~has_hi[before] | ~has_lo | (lo > end) | np.isnan(lo) & ~np.isnan(end)
            at = np.flatnonzero(opens)
            (hi, has_hi), page = most(at), page[at]
            least = np.fmin.reduceat(np.where(has_lo, lo, np.nan), at)
            lo, has_lo = least, np.logical_or.reduceat(has_lo, at)
        sizes = pa.array(np.concatenate(([0], np.cumsum(np.bincount(page, minlength=len(size))))), pa.int32())
        lists = [pa.ListArray.from_arrays(sizes, pa.array(c, pa.float64(), mask=~has)) for c, has in ((lo, has_lo), (hi, has_hi))]
        return pa.StructArray.from_arrays(lists, ["lo", "hi"])

    return of_lists(merge, "lo array<double>, hi array<double>")


def line_clusters(edges: DataFrame, tol=V.LINE_TOLERANCE, min_len=0.0, key=PAGE, most=MOST) -> DataFrame:
    """Vertical edges clustered by x; clusters whose total length reaches ``min_len`` (number or column)."""
    key = _list(key)
    same_x = edges.groupBy(*key, "x0").agg(
        F.sum(F.col("y1") - F.col("y0")).alias("_len"), F.count(F.lit(1)).alias("_n")
    )
    runs = islands(same_x, key, ["x0"], "x0", "_px", "x0", F.col("x0") - F.col("_px") > tol, most, out="cluster")
    out = runs.groupBy(*key, "cluster").agg(
        (F.sum(F.col("x0") * F.col("_n")) / F.sum("_n")).alias("x"), F.sum("_len").alias("total_len")
    )
    return out.where(F.col("total_len") >= min_len)


def group_rows(words: DataFrame, tol=V.ROW_TOLERANCE, key=PAGE, pos="y0", most=MOST) -> DataFrame:
    """Adds ``row_start``: the position of the first word of the text row a word belongs to.

    A row takes every word closer than ``tol`` to its first one. Rows never cross a gap of
    ``tol``, so pages are cut there; each piece's distinct positions then stream through a
    task in order, with the current row as the only state.
    """
    key = _list(key)
    spots = words.select(*key, pos).distinct()
    runs = islands(spots, key, [pos], pos, "_p", pos, F.col(pos) - F.col("_p") >= tol, most, out="_piece")
    names = [*key, "_piece"]

    def walk(batches):
        piece, start = None, None
        for pdf in batches:
            starts = []
            for here, y in zip(pdf[names].itertuples(index=False, name=None), pdf[pos]):
                if here != piece or y - start >= tol:
                    piece, start = here, y
                starts.append(start)
            yield pdf[[*key, pos]].assign(row_start=starts)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spots.schema.fields)
    kind = spots.schema[pos].dataType.simpleString()
    ordered = runs.repartition(*[F.col(n) for n in names]).sortWithinPartitions(*names, pos)
    walked = ordered.mapInPandas(walk, f"{fields}, row_start {kind}")
    return words.join(walked, [*key, pos], "left")


def ordered_text(words: DataFrame, group, order=("y0", "x0"), text="text") -> DataFrame:
    """Words of each group joined by blanks in reading order.

    Words move to their group before they are listed: lists made on the way would sort each task's whole share, and spill it.
    """
    words = words.select(*dict.fromkeys([*_list(group), *_list(order), text])).repartition(*_list(group))
    return words.groupBy(*_list(group)).agg(F.trim(ordered_join(text, _list(order))).alias("text"))


def suffix_duplicates(headers: DataFrame, key=PAGE, order="col_no", header="header", style="code", most=MOST) -> DataFrame:
    """Repeated headers get ``_1``, ``_2`` (style ``code``) or `` 2``, `` 3`` (style ``print``)."""
    nth = ordered_scan(headers, [*_list(key), header], _list(order), _list(order)[0], most, _n=("row_number", None))
    n = F.col("_n")
    tail = F.concat(F.lit("_"), (n - 1).cast("string")) if style == "code" else F.concat(F.lit(" "), n.cast("string"))
    return nth.withColumn(header, F.when(n > 1, F.concat(F.col(header), tail)).otherwise(F.col(header))).drop("_n")


def flatten_headers(cells: DataFrame, key=("project_id", "table_id"), most=MOST) -> DataFrame:
    """Two-row headers to one name per column.

    Two rows count as header when the second starts blank and is not all blank; the first
    row's names run on to the right until the next name.
    """
    key = _list(key)
    v = T.strip(T.text_of("value"))
    top = cells.where("row_no <= 1").groupBy(*key, "col_no").agg(
        F.max(F.when(F.col("row_no") == 0, v)).alias("_r0"), F.max(F.when(F.col("row_no") == 1, v)).alias("_r1")
    )
    top = top.withColumns({"_r0": F.coalesce("_r0", F.lit("")), "_r1": F.coalesce("_r1", F.lit(""))})
    two = cells.where("row_no = 1").groupBy(*key).agg(
        (F.bool_or((F.col("col_no") == 0) & (v != "")) == F.lit(False)).alias("_first_blank"),
        F.bool_or(v != "").alias("_any"),
    )
    filled = ordered_scan(
        top.withColumn("_n0", F.nullif(F.col("_r0"), F.lit(""))), key, ["col_no"], "col_no", most, _p=("last", "_n0")
    ).join(two, key, "left")
    pair = F.coalesce(F.col("_first_blank") & F.col("_any"), F.lit(False))
    joined = F.concat_ws(" ", F.nullif(F.col("_p"), F.lit("")), F.nullif(F.col("_r1"), F.lit("")))
    return filled.select(
        *key, "col_no", F.when(pair, joined).otherwise(F.col("_r0")).alias("header"),
        F.when(pair, 2).otherwise(1).alias("data_start"),
    )


def join_continuations(rows: DataFrame, mark="mark", text="comments", key=PAGE, order="row_no", others=(), most=MOST) -> DataFrame:
    """Rows with a blank mark and nothing but text continue the row above."""
    key, o = _list(key), _list(order)
    blank = T.strip(T.text_of(mark)) == ""
    for c in others:
        blank = blank & (T.strip(T.text_of(c)) == "")
    flagged = rows.withColumn("_start", (~blank).cast("int"))
    grouped = ordered_scan(flagged, key, o, o[0], most, _g=("sum", "_start"))
    keep = [c for c in rows.columns if c not in (*key, text)]
    filled = grouped.withColumn("_t", F.nullif(T.strip(T.text_of(text)), F.lit("")))
    entry = F.struct(*[F.col(c) for c in o], F.col("_t"))
    pieces = F.filter(F.array_sort(F.collect_list(entry)), lambda e: e["_t"].isNotNull())
    return (
        filled.groupBy(*key, "_g")
        .agg(
            F.min_by(F.struct(*keep), F.struct(*o)).alias("_first"),
            F.array_join(F.transform(pieces, lambda e: e["_t"]), " ").alias(text),
        )
        .select(*key, *[F.col(f"_first.{c}").alias(c) for c in keep], text)
        .select(*rows.columns)
    )


def mark_column(words: DataFrame, key=PAGE, first_n=3, col_no="col_no", text="text", flag=None) -> DataFrame:
    """Of the first columns, the one with most distinct mark-like texts; the leftmost on ties.

    ``flag`` names a column that already says whether a word looks like a mark.
    """
    key = _list(key)
    marks = words.where((F.col(col_no) < first_n) & (F.col(flag) if flag else T.is_mark_text(text)))
    per_col = marks.groupBy(*key, col_no).agg(F.countDistinct(F.upper(T.strip(text))).alias("n_marks"))
    best = per_col.groupBy(*key).agg(
        F.max_by(col_no, F.struct("n_marks", -F.col(col_no))).alias("mark_col"), F.max("n_marks").alias("n_marks")
    )
    return (
        words.select(*key)
        .distinct()
        .join(best, key, "left")
        .select(*key, F.coalesce("mark_col", F.lit(0)).alias("mark_col"), F.coalesce("n_marks", F.lit(0)).alias("n_marks"))
    )


def line_leads(pages: DataFrame, key=PAGE, rows="_rows") -> DataFrame:
    """First word of each line: (key, y0, ``_lead`` with x0, text, is_mark), of words as one row a page with the list ``rows``."""

    def first(y0, x0):
        size = np.diff(y0.offsets.to_numpy())
        page = np.repeat(np.arange(len(size)), size)
        (has_y, y), (has_x, x) = ((c.is_valid().to_numpy(zero_copy_only=False), c.fill_null(0).to_numpy()) for c in (y0.flatten(), x0.flatten()))
        differ = [x[1:] - x[:-1], y[1:] - y[:-1], page[1:] - page[:-1]]
        read = (differ[2] > 0) | (differ[1] > 0) | (differ[1] == 0) & (differ[0] >= 0)  # words mostly come as they are read
        known = has_x.all() and has_y.all()
        order = np.arange(len(page)) if known and read.all() else np.lexsort((x, has_x, y, has_y, page))  # nulls come first, nan last

        def same(a, b, *columns):
            return np.logical_and.reduce([(c[a] == c[b]) | ((c[a] != c[a]) & (c[b] != c[b])) for c in columns])

        opens = np.concatenate((np.ones(min(len(order), 1), bool), ~same(order[1:], order[:-1], page, has_y, y)))
        line = np.cumsum(opens) - 1
        least = same(order, order[opens][line], has_x, x)
        at, line = order[least], line[least]
        words = np.bincount(line, minlength=int(opens.sum()))
        lines = np.bincount(page[order[opens]], minlength=len(size))
        words, lines = (pa.array(np.concatenate(([0], np.cumsum(c))), pa.int32()) for c in (words, lines))
        number = pa.array(at - (np.cumsum(size) - size)[page[at]], pa.int32())
        return pa.ListArray.from_arrays(lines, pa.ListArray.from_arrays(words, number))

    found = of_lists(first, "array<array<int>>")
    place = [F.col(rows)[c].cast("array<double>") for c in ("y0", "x0")]
    word = lambda i, *names: [F.get(rows, i)[c].alias(c) for c in names]
    # of words that begin a line at one place the first by its text
    lead = lambda tied: F.array_min(F.transform(tied, lambda i: F.struct(*word(i, "x0", "text", "is_mark")))).alias("_lead")
    each = F.transform("_first", lambda tied: F.struct(*word(F.get(tied, 0), "y0"), lead(tied)))
    return pages.withColumn("_first", found(*place)).select(*_list(key), F.inline(each))


def column_spans(words: DataFrame, edges: DataFrame | None, key=PAGE, most=MOST, pages: DataFrame | None = None) -> DataFrame:
    """Column spans from ruled lines where a page has three or more, else from text projection.

    ``words`` carry the ``is_mark`` flag. Rows are told by the words' lines. ``pages`` are the words as one row a page with
    the list ``_rows`` (see :func:`folded`), if no page is too large for one task: its words then meet their lines where they are.
    """
    key = _list(key)
    if pages is None:
        lines = words.groupBy(*key, "y0").agg(F.min(F.struct("x0", "text", "is_mark")).alias("_lead"))
    else:  # lines move once, whole: rows are told from the same as they are joined to
        lines = folded(line_leads(pages, key).repartition(*key), key, "_lines").select(*key, F.inline("_lines"))
    lines = group_rows(lines, key=key, most=most)
    lead = lines.groupBy(*key, "row_start").agg(F.min("_lead")["is_mark"].alias("_data"))
    data_pages = lead.where("_data").select(*key).distinct().withColumn("_page", F.lit(True))
    shown = (
        lines.join(lead, [*key, "row_start"])
        .join(data_pages, key, "left")
        .select(*key, "y0", (F.col("_data") | F.col("_page").isNull()).alias("shown"))
    )
    if pages is None:
        shown = words.join(shown.where("shown").select(*key, "y0"), [*key, "y0"])
    else:
        stops = shown.select(*key, F.col("y0").alias("at"), F.col("y0").alias("to"), "shown")
        places = beside_stops(pages.select(*key, *[F.col("_rows")[c].alias(c) for c in ("x0", "x1", "y0")]), stops, F.col("y0"), key, False, False)
        shown = places.select(*key, "x0", "x1", F.transform("_of", lambda i: F.get("_stops", i)["shown"]).alias("_on"))
    projected = merge_intervals(shown, "x0", "x1", key=key, most=most, on=None if pages is None else "_on")
    projected = projected.withColumn("span_no", (F.col("span_no") - 1).cast("int"))
    if edges is None:
        return projected
    height = words.groupBy(*key).agg(
        (F.max("y1") - F.min("y0")).alias("_h"), F.min("x0").alias("_wx0"), F.max("x1").alias("_wx1")
    )
    long = edges.where(F.col("y1") - F.col("y0") >= 12)
    lines = line_clusters(long, key=key, most=most).join(height, key).where(F.col("total_len") >= 0.3 * F.col("_h"))
    page = lines.groupBy(*key).agg(
        F.array_sort(F.collect_set("x")).alias("_xs"), F.first("_wx0").alias("_wx0"), F.first("_wx1").alias("_wx1")
    ).where(F.size("_xs") >= 3)
    xs = F.col("_xs")
    left = F.when(F.col("_wx0") < F.element_at(xs, 1) - 8, F.array(F.round(F.col("_wx0") - 3, 1))).otherwise(F.array().cast("array<double>"))
    right = F.when(F.col("_wx1") > F.element_at(xs, -1) + 8, F.array(F.round(F.col("_wx1") + 3, 1))).otherwise(F.array().cast("array<double>"))
    page = page.withColumn("_xs", F.concat(left, xs, right))
    ruled = page.select(*key, F.posexplode(F.slice(F.col("_xs"), F.lit(1), F.size("_xs") - 1)).alias("span_no", "lo"), "_xs")
    ruled = ruled.select(*key, "span_no", "lo", F.element_at("_xs", F.col("span_no") + 2).alias("hi"))
    free = projected.join(ruled.select(*key).distinct(), key, "left_anti")
    return ruled.unionByName(free)


def words_to_table(words: DataFrame, edges: DataFrame | None = None, key=PAGE, most=MOST) -> DataFrame:
    """Schedule cells from positioned words: (key, row_no, col_no, header, value).

    Column spans, mark column, nearest row per word, headers from the words above the first
    mark, duplicate headers numbered, blank placeholder columns dropped. Whether any page is too large
    for one task is asked once, of the words. If none is, words travel as one list a page, and columns and rows join that list.
    Words with their column, and the texts of header and body cells, are written once to the checkpoint folder; all else reads those.
    """
    key = _list(key)
    # a page without a name has no table; told here, so that all who read the pages read one shuffle
    words = words.where(reduce(and_, [F.col(k).isNotNull() for k in key]) & F.col("text").rlike(r"\S")).withColumn("is_mark", T.is_mark_text("text"))
    words = words.select(*key, "text", "x0", "x1", "y0", "y1", "is_mark")
    most = None if splitters(words, key, "y0", most) is None else most
    small = most is None
    pages = folded(words, key) if small else None
    # spans move once, whole: placing the words and listing the columns read the same
    spans = folded(column_spans(words, edges, key, most, pages).repartition(*key), key, "_spans").select(*key, F.inline("_spans"))
    if small:  # a page is stored as one row, with its marks and columns in lists of their own, as most steps read no more
        word = lambda r, n: F.struct(n.alias("col_no"), *[r[c].alias(c) for c in ("text", "is_mark", "x0", "y0")], ((r["y0"] + r["y1"]) / 2).alias("_cy"))
        placed = nearest_span(pages, spans, lambda r: (r["x0"] + r["x1"]) / 2, key, rows="_rows", row=word)
        listed = [F.filter("_rows", lambda r: r["is_mark"]).alias("_marks"), F.col("_stops")["n"].alias("_columns")]
        table = stored(placed.select(*key, "_rows", *listed), "placed")
        placed, columns = table.select(*key, F.inline_outer("_marks")), table.select(*key, F.explode("_columns").alias("col_no"))
    else:
        placed = nearest_span(words.withColumn("_cx", (F.col("x0") + F.col("x1")) / 2), spans, "_cx", key, most=most)
        placed = placed.select(*key, F.col("span_no").alias("col_no"), "text", "is_mark", "x0", "y0", ((F.col("y0") + F.col("y1")) / 2).alias("_cy"))
        table = stored(placed.unionByName(spans.select(*key, F.col("span_no").alias("col_no")), allowMissingColumns=True), "placed")
        placed, columns = table.where("text is not null"), table.where("text is null").select(*key, "col_no")

    which = mark_column(placed, key, flag="is_mark").select(*key, "mark_col")
    marks = placed.where("is_mark").join(which, key).where(F.col("col_no") == F.col("mark_col")).select(
        *key, F.col("_cy").alias("pos"), F.col("text").alias("_m"), F.col("x0").alias("_x")
    )
    numbered = ordered_scan(marks, key, ["pos", "_x", "_m"], "pos", most, row_no=("row_number", None))
    anchors = numbered.select(*key, "pos", F.col("row_no").alias("anchor_id"))
    # a page without marks has no cells
    first = marks.groupBy(*key).agg((F.min("pos") - 8).alias("_first"))
    above = F.col("_cy") < F.coalesce(F.col("_first"), F.lit(float("inf")))
    if small:
        data = nearest_1d(table.select(*key, "_rows").join(first.hint("shuffle_hash"), key), anchors, lambda r: r["_cy"], key, rows="_rows")
    else:
        body = placed.select(*key, "col_no", "text", "x0", "y0", "_cy")
        data = nearest_1d(body.join(first, key).withColumn("pos", F.col("_cy")), anchors, "pos", key, most=most)
    data = data.withColumns({"_above": above, "anchor_id": F.when(~above, F.col("anchor_id"))})
    cell = [*key, "_above", "anchor_id", "col_no"]
    data = data.withColumn("_id", F.xxhash64(*cell))  # sorted by a number first
    texts = stored(data.groupBy("_id", *cell).agg(ordered_join("text", ["y0", "x0", "text"]).alias("value")).drop("_id"), "texts")

    names = texts.where("_above").select(*key, "col_no", F.col("value").alias("header"))
    named = columns.join(names, [*key, "col_no"], "left")
    given = suffix_duplicates(named.where("header is not null"), key, most=most)
    empty = named.where("header is null").withColumn("header", F.concat(F.lit("COLUMN_"), F.col("col_no").cast("string")))
    headers = given.unionByName(empty).join(which, key)
    headers = headers.select(*key, "col_no", F.when(F.col("col_no") == F.col("mark_col"), F.lit("mark")).otherwise(F.col("header")).alias("header"))

    values = texts.where("not _above").select(*key, "anchor_id", "col_no", "value")
    # a placeholder without a word below the heads goes
    used = values.select(*key, "col_no").distinct().join(headers, [*key, "col_no"]).select(*key, "header").distinct()
    stays = headers.where(~F.col("header").startswith("COLUMN_")).unionByName(
        headers.where(F.col("header").startswith("COLUMN_")).join(used, [*key, "header"], "left_semi").select(*headers.columns)
    )
    own = numbered.select(*key, F.col("row_no").alias("anchor_id"), F.upper("_m").alias("_m"))
    grid = own.join(stays, key).join(values, [*key, "anchor_id", "col_no"], "left")
    value = F.coalesce(F.col("value"), F.lit(""))
    mark = F.upper(F.coalesce(F.nullif(F.col("value"), F.lit("")), F.col("_m")))
    return grid.select(*key, F.col("anchor_id").alias("row_no"), "col_no", "header", F.when(F.col("header") == "mark", mark).otherwise(value).alias("value"))


def flatten_extraction(df: DataFrame, floors="per_floor") -> DataFrame:
    """Nested plan extraction -> one row per opening box.

    ``per_floor`` is ``array<struct<floor, doors: array<opening>, windows: array<opening>>>`` with
    ``opening = struct<type, count, source, bounding_boxes>``. Unknown types stay; an opening
    without boxes keeps one row with a NULL box.
    """
    rest = [c for c in df.columns if c != floors]
    per_floor = df.select(*rest, F.explode(floors).alias("f"))
    kinds = F.array(
        F.struct(F.lit("door").alias("kind"), F.col("f.doors").alias("items")),
        F.struct(F.lit("window").alias("kind"), F.col("f.windows").alias("items")),
    )
    openings = per_floor.select(*rest, F.col("f.floor").alias("floor"), F.explode(kinds).alias("k")).select(
        *rest, "floor", "k.kind", F.explode("k.items").alias("o")
    )
    return openings.select(
        *rest, "floor", "kind", F.coalesce(F.nullif(F.col("o.type"), F.lit("")), F.lit("UNKNOWN")).alias("type"),
        F.col("o.count").alias("count"), F.col("o.source").alias("source"), F.posexplode_outer("o.bounding_boxes").alias("box_no", "box"),
    )

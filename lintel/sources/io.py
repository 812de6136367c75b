"""Readers and writers: registries, specification texts, pages, keyed upserts, takeoff output."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PAGE_WORD = (
    "project_id STRING, page_id STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, text STRING, block INT, line INT, word INT"
)
PAGE_PATH = (
    "project_id STRING, page_id STRING, path_id INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, "
    "has_curve BOOLEAN, is_dashed BOOLEAN, stroke_width DOUBLE, filled BOOLEAN"
)
DETECTION = (
    "project_id STRING, det_id BIGINT, mark STRING, floor_no INT, floor_name STRING, file_no INT, page_no INT, "
    "w_cx DOUBLE, w_cy DOUBLE, bbox STRUCT<x0:DOUBLE,y0:DOUBLE,x1:DOUBLE,y1:DOUBLE>, location STRING, int_ext STRING, "
    "vlm_opening_mode STRING, vlm_wall_type STRING, wall_type STRING, dist_to_boundary DOUBLE, is_borderline BOOLEAN"
)
ROW = "MAP<STRING,STRING>"


def _list(x):
    return [x] if isinstance(x, str) else list(x)


def registry_rows(text: Column) -> Column:
    """Schedule rows of one JSON text: a list, or a list under instance_schedule or data."""
    wrapped = F.from_json(text, f"instance_schedule ARRAY<{ROW}>, data ARRAY<{ROW}>")
    bare = F.from_json(text, f"ARRAY<{ROW}>")
    bare = F.when(F.substring(F.ltrim(text), 1, 1) == "[", bare)

    def filled(a):
        return F.when(F.size(a) > 0, a)

    return F.coalesce(filled(bare), filled(wrapped["instance_schedule"]), filled(wrapped["data"]))


def registry_cells(docs: DataFrame, text="value", key=("project_id", "table_id"), type_hint=None) -> DataFrame:
    """Registry documents -> long cells in printed column order; ``type_hint`` is a text or a Column of docs."""
    key = _list(key)
    hint = type_hint if isinstance(type_hint, Column) else F.lit(type_hint or "")
    rows = docs.select(*key, hint.alias("_hint"), F.posexplode(registry_rows(F.col(text))).alias("row_no", "row"))
    rows = rows.withColumn("schedule_type", F.coalesce(F.element_at("row", F.lit("_schedule_type")), "_hint"))
    cells = rows.select(*key, "row_no", "schedule_type", F.posexplode("row").alias("col_no", "header", "value"))
    return cells.where("header <> '_schedule_type'").select(
        *key, "row_no", "col_no", "header", F.coalesce("value", F.lit("")).alias("value"), "schedule_type"
    )


def read_registry(spark: SparkSession, path: str, type_hint: str | None = None) -> DataFrame:
    """One JSON document per file; the project is the file's base name, the table the part after ``--``, if any.

    So ``tower--doors.json`` and ``tower--windows.json`` are two tables of one project.
    """
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    docs = spark.read.text(path, wholetext=True).select(
        F.split(name, "--")[0].alias("project_id"), F.coalesce(F.get(F.split(name, "--", 2), F.lit(1)), F.lit("")).alias("table_id"), "value"
    )
    return registry_cells(docs, type_hint=type_hint)


def json_body(c) -> Column:
    """The JSON part of a noisy text: a fenced block, else first opening to last closing bracket."""
    c = F.col(c) if isinstance(c, str) else c
    fenced = F.regexp_extract(c, r"(?is)```(?:json)?\s*(\{.*\}|\[.*\])\s*```", 1)
    loose = F.regexp_extract(c, r"(?s)([{\[].*[}\]])", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(loose, F.lit("")), F.trim(c))


def parse_loose_json(c, ddl: str) -> Column:
    """Parsed struct, or NULL when no JSON of that shape can be read."""
    return F.from_json(json_body(c), ddl, {"mode": "PERMISSIVE"})


def quarantine(df: DataFrame, c: str):
    """(ok, bad) by whether the text holds readable JSON."""
    flagged = df.withColumn("_ok", F.try_parse_json(json_body(c)).isNotNull())
    return flagged.where("_ok").drop("_ok"), flagged.where("not coalesce(_ok, false)").drop("_ok")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx_paragraphs(content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    for p in root.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t"))
        if text.strip():
            yield text


def _spec_paragraphs(batches):
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            if path.lower().endswith(".docx"):
                lines = _docx_paragraphs(bytes(content))
            else:
                lines = bytes(content).decode("utf-8", errors="ignore").splitlines()
            out.extend((path, i, t) for i, t in enumerate(lines))
        yield pd.DataFrame(out, columns=["path", "para_no", "text"])


def read_spec_corpus(spark: SparkSession, glob: str) -> DataFrame:
    """Paragraphs of .docx and .txt specification files, one task per group of files."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    files = files.where(F.lower("path").rlike(r"\.(docx|txt)$"))
    return files.mapInPandas(_spec_paragraphs, "path string, para_no int, text string")


def _typed(spark, path, ddl):
    reader = spark.read.schema(StructType.fromDDL(ddl))
    return reader.json(path) if re.search(r"\.jsonl?(\.gz)?$", path) else reader.parquet(path)


def read_page_words(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path, PAGE_WORD)


def read_page_paths(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path, PAGE_PATH)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path, DETECTION)


def latest(df: DataFrame, keys, order) -> DataFrame:
    """The last row per key: an aggregation with map-side combine, no window."""
    keys, order = _list(keys), _list(order)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert_latest(target: DataFrame, changes: DataFrame, keys, order) -> DataFrame:
    """Target with the latest change per key in place of the rows it had.

    Only the changes are folded; rows of the target that no change names pass through an anti join,
    which needs no shuffle of the target while the changed keys are few enough to broadcast.
    """
    new = latest(changes, keys, order)
    return target.join(new.select(*_list(keys)), _list(keys), "left_anti").unionByName(new.select(*target.columns))


TAKEOFF_TABLES = ("door_schedule", "unit_count", "unit_door", "assumption_log")


def write_takeoff(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> list[str]:
    """Write the takeoff tables below ``path`` as one result, and return where they lie.

    Each call writes a folder of its own; only when all its tables are there does one row in ``path``/commits name it.
    Until then, and if any table fails, :func:`read_takeoff` gives the result before. Rows of a project are put
    together, a large project over several files.
    """
    for name in tables:
        if name not in TAKEOFF_TABLES:
            raise ValueError(f"unknown takeoff table {name}")
    run = uuid.uuid4().hex
    for name, df in tables.items():
        writer = (df.hint("rebalance", "project_id") if "project_id" in df.columns else df).write.format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        if "project_id" in df.columns:
            writer = writer.partitionBy("project_id")
        writer.save(f"{path}/{run}/{name}")
    if tables:
        spark = next(iter(tables.values())).sparkSession
        commit = spark.range(1).select(F.lit(run).alias("run"), F.lit(fmt).alias("fmt"), F.current_timestamp().alias("at"), F.array(*map(F.lit, tables)).alias("tables"))
        commit.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return [f"{path}/{run}/{name}" for name in tables]


def read_takeoff(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the last result that was written whole; none before the first."""
    try:
        last = spark.read.parquet(f"{path}/commits").orderBy(F.desc("at"), "run").limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    (c,) = last
    return {name: _text_projects(spark.read.format(c["fmt"]).option("header", True).load(f"{path}/{c['run']}/{name}")) for name in c["tables"]}


def _text_projects(df: DataFrame) -> DataFrame:
    return df.withColumn("project_id", F.col("project_id").cast("string")) if "project_id" in df.columns else df


def cells_to_rows(cells: DataFrame, r="r", c="c", v="value", columns=(), key=("sheet",)) -> DataFrame:
    """Sparse cells -> wide rows; ``columns`` lists the column numbers to keep, in order.

    Cells are sent to their row before they are aggregated: Spark sorts half-made rows of text, and would sort all
    cells of an input file in the one task that reads it.
    """
    key = _list(key)
    picks = [F.max(F.when(F.col(c) == n, F.col(v))).alias(f"c{n}") for n in columns]
    return cells.repartition(*key, r).groupBy(*key, r).agg(*picks)


def rows_to_cells(df: DataFrame, columns, key=("sheet",), r="r") -> DataFrame:
    """Wide rows -> sparse cells; empty cells are left out."""
    entries = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{n}`").cast("string").alias("value")) for i, n in enumerate(columns)])
    return df.select(*_list(key), r, F.explode(entries).alias("e")).select(*_list(key), r, "e.c", "e.value").where(
        "value is not null and value <> ''"
    )


def grid_cells(sheets: DataFrame, sparse="celldata", dense="data", key=("sheet",)) -> DataFrame:
    """Cells of a sheet: the dense grid wins where it has rows, else the sparse list.

    ``celldata`` is array<struct<r, c, v>>, ``data`` array<array<string>>; numbering starts at 1.
    """
    key = _list(key)
    has_grid = F.coalesce(F.size(dense), F.lit(0)) > 0
    grid = (
        sheets.where(has_grid)
        .select(*key, F.posexplode(dense).alias("r", "row"))
        .select(*key, (F.col("r") + 1).alias("r"), F.posexplode("row").alias("c", "value"))
        .select(*key, "r", (F.col("c") + 1).alias("c"), "value")
        .where("value is not null and (value <> '' or r = 1)")
    )
    loose = sheets.where(~has_grid).select(*key, F.explode(sparse).alias("e")).select(
        *key, (F.col("e.r") + 1).alias("r"), (F.col("e.c") + 1).alias("c"), F.coalesce("e.v", F.lit("")).alias("value")
    )
    return grid.unionByName(loose)

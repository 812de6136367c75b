"""Cases as DataFrames. MODE_CASES are fixed values of published cases; the rest is our own."""

DET = (
    "project_id string, det_id string, mark string, floor_no int, floor_name string, page_no int, w_cx double, w_cy double, "
    "vlm_opening_mode string, vlm_wall_type string, wall_type string"
)
CELL = "project_id string, table_id string, row_no int, col_no int, header string, value string, schedule_type string"

# mark, cells, plan mode, expected mode (None: anything but DA)
MODE_CASES = [
    ("300-03", {"comments": "DBL ACT", "door type": "WOOD", "material": "WD"}, "DA", "DA"),
    ("300-35", {"comments": "ANTI-BARRICADE DOOR", "door type": "METAL", "material": "HM"}, "DA", "DA"),
    ("F108", {"comments": "DOUBLE ACTING DOOR", "door type": "METAL", "material": "HM"}, "DA", "DA"),
    ("300-04", {"comments": "AUTOMATIC, CR", "door type": "WOOD", "material": "WD"}, "SGL", None),
    ("98C", {"door type": "CO", "door material": "N/A", "frame material": "", "comments": "STOREFRONT UNIT"}, "CO", "STOREFRONT"),
    ("100A", {"door type": "CO", "door material": "N/A", "frame material": "WD", "comments": "CASED OPENING"}, "CO", "CO"),
    ("98D", {"door type": "CO", "door material": "N/A", "frame material": "", "comments": "", "hardware group no": "SET 8"}, "CO", "STOREFRONT"),
    ("3.0 - THIRD", {"door type": "CO", "door material": "N/A", "frame material": "", "hardware group no": "", "comments": ""}, "CO", "CO"),
    ("99A", {"door width": "3'-0\"", "frame type": "EX", "door material": "SCWD", "comments": "RELOCATE EXISTING DOOR - PREP DOOR/FRAME AS REQUIRED"}, "SGL", "SGL"),
]


def cells(spark, rows, project="P", kind="door", table="T"):
    """rows: list of (mark, {header: value})."""
    out = []
    for i, (mark, fields) in enumerate(rows):
        for c, (h, v) in enumerate({"mark": mark, **fields}.items()):
            out.append((project, table, i, c, h, v, kind))
    return spark.createDataFrame(out, CELL)


def detections(spark, rows, project="P"):
    """rows: list of (mark, floor_no, mode, side, wall)."""
    out = [
        (project, f"d{i:03d}", m, f, f"Level {f}", 0, 10.0 * i, 5.0, mode, side, wall)
        for i, (m, f, mode, side, wall) in enumerate(rows)
    ]
    return spark.createDataFrame(out, DET)

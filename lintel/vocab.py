"""Fixed values.

The word lists, thresholds and code tables below must equal the published rules
for results to agree, so they are stated here as plain text, in their natural order.
"""

# Stamps printed across drawings that leak into marks.
WATERMARKS = ["LANIGIRO", "ORIGINAL", "WATERMARK", "CONFIDENTIAL", "COPY", "DRAFT", "VOID", "PRELIMINARY"]

# Characters trimmed from the ends of a printed word.
WORD_PUNCT = ".,()[]{}-_#*"
SENTENCE_PUNCT = ".,()[]{}-_#*/\"'"

# Headers that hold the mark, and headers that look like it but do not.
MARK_HEADERS = [
    "mark", "type", "marks", "door mark", "door no", "door no.", "window mark", "window no",
    "window no.", "id", "mark / type", "mark/type",
]
NOT_MARK_HEADERS = ["hardware group no", "door type", "frame type", "opening mode", "type of door", "type of frame"]
LOCATION_HEADERS = [
    "location", "location name", "room", "room name", "room no", "room number", "room/location",
    "room / location", "room_name", "room_no",
]
NOT_LOCATION_HEADERS = ["comments", "remarks", "estimator notes", "description"]

# Canonical header -> printed spellings (lower case). Type and material depend on the table.
HEADER_SYNONYMS = {
    "DOOR TYPE": ["type", "door type", "door_type"],
    "FRAME TYPE": ["frame type", "frame_type"],
    "DOOR MATERIAL": ["material", "door material", "door mat'l", "door_material", "door_mat'l"],
    "FRAME MATERIAL": ["frame material", "frame mat'l", "frame_material", "frame_mat'l", "material_1", "material 1"],
    "DOOR FINISH": ["door finish", "door_finish"],
    "FRAME FINISH": ["frame finish", "frame_finish"],
    "HARDWARE GROUP NO": [
        "hardware group no", "hardware group number", "group no", "group number", "hardware group",
        "hw set", "hardware set", "hw_set",
    ],
    "DETAIL HEAD": ["head", "detail head", "detail_head"],
    "DETAIL JAMB": ["jamb", "detail jamb", "detail_jamb"],
    "LOCATION": LOCATION_HEADERS,
    "FLOOR / LEVEL": [
        "floor", "level", "floor / level", "floor/level", "floor level", "floor no", "floor number",
        "level no", "level number", "floor_no", "level_no",
    ],
}
WINDOW_HEADER_FOR = {"DOOR TYPE": "WINDOW TYPE", "DOOR MATERIAL": "WINDOW MATERIAL"}
# Blank-like values; each rule has its own list.
BLANK_CELL = ["", "-", "N/A", "NONE"]
BLANK_CASED_MATERIAL = ["-", "", "NONE", "N/A", "CASED OPENING"]
BLANK_CASED_TYPE = ["-", "", "CO", "NONE", "N/A", "CASED OPENING", "CASED"]
BLANK_FRAME = ["", "-", "N/A", "NA", "NONE"]
BLANK_STOREFRONT = ["", "-", "N/A", "NA", "NONE", "UNKNOWN", "EXIST", "EX"]
CASED_TYPES = ["CO", "CASED OPENING", "CASED"]
EXISTING = ["EXIST", "EX", "EXISTING"]

# Opening modes.
MODE_SYNONYMS = {
    "SGL": ["SINGLE", "SGL", "SINGLE-LEAF", "SINGLE LEAF", "1"],
    "DA": ["DA", "DOUBLE ACTING", "DOUBLE-ACTING", "DOUBLE_ACTING"],
    "DE": ["DE", "DOUBLE EGRESS", "DOUBLE-EGRESS", "DOUBLE_EGRESS"],
    "PR": ["PR", "PAIR", "PAIRED", "DOUBLE SGL", "PR.", "PRS", "P"],
    "CO": ["CO", "DOUBLE-LEAF", "DOUBLE LEAF", "TWO-LEAF", "TWO LEAF", "2", "CASED", "CASED OPENING"],
    "ELEV": ["ELEV", "ELEVATOR"],
    "FIXED": ["FIXED"],
    "CASEMENT": ["CASEMENT"],
}
DOUBLE_ACTING_PHRASES = [
    "DBL ACT", "DBL-ACT", "DOUBLE ACTING", "DOUBLE-ACTING", "DOUBLE ACT", "DOUBLE-ACT",
    "ANTI-BARRICADE", "ANTI - BARRICADE",
]
DOUBLE_ACTING_WORDS = ["DA", "AB"]
WIDE_DOOR_INCHES = 50.0

# Leaf counts and widths.
LEAF_HEADERS = ["no. of leaves", "leaves", "leaf qty", "panels", "leaves qty", "no. of panels", "leaves number"]
LEAF_PAIR = ["2", "PR", "DBL", "PAIR", "DOUBLE", "TWO", "2.0"]
LEAF_SINGLE = ["1", "SGL", "SINGLE", "ONE", "1.0"]
WIDTH_HEADERS = ["width", "size", "dimension", "opening size", "panel size"]
PAIR_PHRASES = [
    "PAIR", "2 AUTOMATIC", "2-LEAF", "2-LEAVES", "DOUBLE", "2 LEAF", "2 LEAVES", "TWO LEAF", "TWO LEAVES",
]
HARDWARE_HEADERS = ["hardware group", "hardware set", "hw set", "group no", "group number"]
SIDE_HEADERS = ["int/ext", "int_ext", "interior/exterior", "int / ext", "interior / exterior"]
COMMENT_HEADERS = ["comments", "remarks", "estimator notes", "description"]

# Storefront and aluminium vocabularies.
STOREFRONT_TOKENS = [
    "AL", "ALUM", "ALUMINUM", "ALUMINIUM", "ALLUMINUM", "ALLUMINIUM", "ALM", "STOREFRONT", "SF", "CW",
    "CURTAINWALL", "GL", "GLASS", "GLZ", "GLAZING",
]
STOREFRONT_PHRASES = ["ALUMINUM", "ALUM", "STOREFRONT", "AD SYSTEM"]
STOREFRONT_SENTENCE = ["STOREFRONT", "EXCLUDE", "EXCLUDED", "ALUMINUM", "ALUM"]
ALUMINIUM_EXCLUSION = ["aluminium", "aluminum", "alum"]
ALUMINIUM_MATERIAL = ["ALUMINUM", "GLASS", "ALUMINIUM", "ALUM"]
NOTE_MATERIAL = ["ALUMINUM", "GLASS", "ALUMINIUM", "ALUM", "GLAZING", "AL/GL", "GL/AL"]
NOTE_MATERIAL_WORDS = ["AL", "GL", "GLZ"]
PATH_STOREFRONT_MATERIAL = ["AL", "ALUM", "ALUMINUM", "GLASS", "GL", "STOREFRONT"]
PATH_STOREFRONT_COMMENT = ["STOREFRONT", "AD SYSTEM", "ALUMINUM"]

# Buckets.
SIDELITE_WORDS = [
    "sidelite", "side lite", "side-lite", "borrowed lite", "borrowed-lite", "borrowedlite", "transom", "glass panel",
]
MULTIFOLD_WORDS = ["multifold", "operable wall", "folding wall", "accordion door", "operable partition"]
SOFT_EXTERIOR_WORDS = [
    "garage", "parking", "loading dock", "breezeway", "compactor", "cellar", "covered walkway",
    "open-air corridor", "pkg",
]
BUCKET_COLORS = {
    "Interior": "FFFF00", "Exterior": "00B0F0", "Soft Exterior": "92D050", "Window": "FFC000", "Not in Scope": "FF69B4",
}
ANNOTATION_SOFT = ["GARAGE", "PARKING", "BREEZEWAY", "COMPACTOR", "CELLAR"]
ANNOTATION_WINDOW = ["WINDOW", "SIDELITE", "BORROWED LITE", "TRANSOM"]

# Sections.
COMMON_AREA_WORDS = [
    "lobby", "corridor", "stair", "mech", "elec", "trash", "garage", "amenity", "office", "mail", "laundry",
    "exit", "entry",
]
OVERHEAD_LOCATION_WORDS = ["overhead", "roll-up", "coiling", "sectional"]

# Takeoff notes and statuses.
NOTE_MULTIFOLD = "Door tag found on Floor plan it is a multifold wall assembly. So, Excluded."
NOTE_SIDELITE = "Sidelite / Borrowed Lite opening."
NOTE_CASED = "Cased opening found on floor plan."
NOTE_NOT_FOUND = "Not Found"
NOTE_WALL = "Door Bifurcated on basis of wall type"
NOTE_LOCATION = "Door Bifurcated on basis of Location"
NO_REASON = "VLM detection discrepancy"
NOTE_THICKNESS = "Door Bifurcated due to larger wall."
NOTE_ALUMINIUM = "Door is of Aluminium/Glass material."
NOTE_ALUMINIUM_EXCLUDED = "EXCLUDED per specifications (Aluminium door exclusion)."

# Floors.
STILT_ALIASES = [
    "stilt", "stilt floor", "stilt floor plan", "ground stilt", "stilt/ground", "ground/stilt",
    "stilt (ground)", "ground (stilt)", "parking floor", "parking level", "pillar floor", "piloti floor",
]

# Words that mark a text block as a room label.
ROOM_WORDS = [
    "room", "rm", "office", "toilet", "staff", "holding", "treatment", "bed", "lounge", "lobby", "corridor", "hall",
    "stair", "storage", "mech", "electrical", "elec", "janitor", "closet", "bath", "shower", "wc", "vestibule",
    "entry", "exit", "classroom", "kitchen", "conf", "conference", "shared", "hvac", "elevator", "utility",
    "laundry", "nourse", "care", "station", "exam", "examination", "it", "pantry", "waiting", "reception", "soiled",
    "clean", "nurse", "nook", "dictation", "physician", "touchdown", "med", "meds", "unisex", "vest", "clos", "lrd",
    "sub", "wait", "consult", "consultation", "work", "lockers", "triage", "harrison", "mamaroneck", "shwr",
    "toilet/shwr", "cr", "com", "crm",
]
INTERIOR_WORDS = [
    "TOILET", "OFFICE", "HOLDING", "ROOM", "CORRIDOR", "STAIR", "EX.", "EXISTING", "CLOSET", "HALL", "LOUNGE",
    "JANITOR", "EVS", "ELEC", "MECH", "UTILITY", "STORE", "STORAGE", "ENTRY", "VESTIBULE", "RECEPTION", "TRIAGE",
    "WAITING", "CONSULT", "NURSE", "LINEN", "TRASH", "PASSAGEWAY", "STATION", "LAB",
]
HEADER_WORDS = [
    "mark", "number", "door", "window", "frame", "schedule", "type", "finish", "comments", "level", "floor", "sheet",
    "code", "id", "tag", "fire", "rating", "width", "height", "hw", "set", "head", "jamb", "panel", "pane",
    "dimensions", "qty", "quantity", "manuf", "manufacturer", "remarks", "elevation", "detail", "sill", "glass",
    "glazing", "material", "mat'l", "thickness", "thckns", "hand", "welding", "gauge", "depth", "anchor", "face",
]
HEADER_LIKE_MARKS = [
    "panel 1", "panel 2", "width", "height", "door number", "mark", "door details", "door panels", "door frame",
    "type", "finish 1", "fire rating", "finish", "head", "jamb", "hw set", "comments",
]
SCHEDULE_TITLES = ["DOOR AND FRAME SCHEDULE", "DOOR SCHEDULE", "WINDOW SCHEDULE", "FRAME SCHEDULE"]

# Output sheet.
DOOR_SCHEDULE_COLUMNS = [
    "Qty", "NUMBER", "LOCATION", "Opening Mode", "Int/Ext", "Wall Type", "Takeoff Notes", "WIDTH", "HEIGHT",
    "THICKNESS", "DOOR TYPE", "DOOR MATERIAL", "DOOR FINISH", "FRAME TYPE", "FRAME MATERIAL", "FRAME FINISH",
    "HEAD", "JAMB", "SILL", "FIRE RATING", "HARDWARE SET", "KEY CARD READER", "COMMENTS",
]
HIDDEN_COLUMNS = [
    "count", "qty", "needs_review", "needs review", "need_review", "need review", "opening_mode", "opening mode",
    "int/ext", "int_ext",
]

# Review items, in the order of the assumption log.
QUEUE_TYPES = [
    "aluminium_exclusion_flag", "mark_not_located", "missing_from_plan", "ocr_cv_mismatch", "opening_mode_conflict", "orphan_plan_mark",
]

EVIDENCE_LEVELS = [
    "revision", "schedule", "type details", "wall schedule", "floor plan", "enlarged plan", "general notes",
    "typical details", "inference",
]

# Run progress: node -> (step, percent).
PROGRESS_STEPS = {
    "specifications_analyzer_node": ("specs_analyzed", 10),
    "schedule_parser_node": ("schedule_parsed", 25),
    "ocr_consensus_node": ("ocr_completed", 45),
    "cv_detector_node": ("cv_detector_completed", 75),
    "reconciliation_node": ("reconciliation_completed", 90),
    "excel_writer_node": ("completed", 100),
    "plan_annotation_node": ("completed", 100),
}
RATE_LIMIT = 100
RATE_WINDOW_SECONDS = 60

# Units and thresholds.
FOOT_M = 0.3048
INCH_M = 0.0254
CONSENSUS_RATIO = 0.80
WORD_GAP = 2.5
INTERVAL_TOLERANCE = 5.0
LINE_TOLERANCE = 2.5
ROW_TOLERANCE = 4.0
DEDUP_EPS = 8.0
PATH_PAD = 70.0
ARC_RADIUS = 50.0
DASH_RADIUS = 65.0
LEAF_EPS = 45.0
BUBBLE_RADIUS = 15.0
BUBBLE_AREA = 200.0
BOUNDARY_BANDS = (25.0, 85.0)
HOST_WALL_REACH = 80.0

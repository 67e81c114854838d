"""Schemas of the record tables."""

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
LINES = f"image_id string, line_no int, text string, score double, box {BOX}, image_width int, image_height int"
BOUNDARY = "struct<slope:double,intercept:double,support:double>"
GRIDS = f"image_id string, horizontal array<{BOUNDARY}>, vertical array<{BOUNDARY}>, confidence double"
#: A record as the parsers give it; ordinal is its place in the input, across all pages.
RECORD_FIELDS = [
    ("full_name", "string", ""), ("first_name", "string", ""), ("last_name", "string", ""), ("name_split_confidence", "double", 0.0),
    ("detected_name_order", "string", ""), ("center", "string", ""), ("age", "int", None), ("age_unit", "string", ""), ("sex", "string", ""),
    ("origin", "string", ""), ("specialty", "string", ""), ("area", "string", ""), ("source_image", "string", ""), ("confidence", "double", 0.0),
    ("needs_review", "boolean", False), ("notes", "array<string>", []), ("raw_line", "string", ""), ("occurrences", "int", 1),
    ("source_images", "array<string>", []), ("duplicate_status", "string", "Único"), ("duplicate_detail", "string", ""), ("document_id", "string", ""),
    ("review_status", "string", ""), ("clinical_notes", "string", ""), ("name_confidence", "double", 0.0), ("document_confidence", "double", 0.0),
    ("age_confidence", "double", 0.0), ("origin_confidence", "double", 0.0), ("specialty_confidence", "double", 0.0), ("field_evidence", "map<string,string>", {}),
]
RECORD = ", ".join(f"{n} {t}" for n, t, _ in RECORD_FIELDS)


def record(**values) -> dict:
    """A record with its defaults; lists and maps are fresh."""
    out = {n: (list(d) if isinstance(d, list) else dict(d) if isinstance(d, dict) else d) for n, _, d in RECORD_FIELDS}
    unknown = set(values) - set(out) - {"ordinal", "record_no", "image_id", "patient_id"}
    if unknown:
        raise TypeError(f"no such fields: {sorted(unknown)}")
    return out | values


def with_defaults(df):
    """df with every record column, defaults where it has none."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.withColumns({n: F.expr("map()").cast(t) if t.startswith("map") else F.array().cast(t) if isinstance(d, list) else F.lit(d).cast(t) for n, t, d in RECORD_FIELDS if n not in have})

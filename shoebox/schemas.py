"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

# Date-times are naive UTC with whole seconds, hence TIMESTAMP_NTZ.
_TS = T.TimestampNTZType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


FOLDERS = _struct(
    ("id", T.LongType(), False),
    ("parent_id", T.LongType(), True),
    ("path", T.StringType(), False),
    ("recursive", T.BooleanType(), False),
    ("scan_complete", T.BooleanType(), False),
    ("exclude", T.ArrayType(T.StringType()), False),
    ("include", T.ArrayType(T.StringType()), False),
    ("thumbnail_cache_mode", T.StringType(), True),
    ("thumbnail_cache_folder", T.StringType(), True),
    ("thumbnail_cache_fallback", T.StringType(), False),
    ("created_at", _TS, True),
)

MEDIA = _struct(
    ("id", T.LongType(), False),
    ("folder_id", T.LongType(), False),
    ("relative_path", T.StringType(), False),
    ("absolute_path", T.StringType(), False),
    ("content_hash", T.StringType(), False),
    ("width", T.IntegerType(), True),
    ("height", T.IntegerType(), True),
    ("format", T.StringType(), True),
    ("file_size", T.LongType(), True),
    ("modified_at", _TS, True),
    ("created_at", _TS, True),
    ("is_present", T.BooleanType(), False),
    ("missing_since", _TS, True),
)

CONFIGS = _struct(
    ("id", T.LongType(), False),
    ("name", T.StringType(), False),
    ("kind", T.StringType(), False),
    ("enabled", T.BooleanType(), False),
    ("options", T.StringType(), True),
    ("created_at", _TS, True),
)

VALUES = _struct(
    ("id", T.LongType(), False),
    ("media_file_id", T.LongType(), False),
    ("searchable_config_id", T.LongType(), False),
    ("value_json", T.StringType(), True),
    ("created_at", _TS, True),
    ("updated_at", _TS, True),
)

WORK_ITEMS = _struct(
    ("id", T.LongType(), False),
    ("media_file_id", T.LongType(), False),
    ("searchable_config_id", T.LongType(), True),
    ("job_kind", T.StringType(), False),
    ("params_json", T.StringType(), True),
    ("status", T.StringType(), False),
    ("attempts", T.LongType(), False),
    ("error", T.StringType(), True),
    ("created_at", _TS, True),
    ("updated_at", _TS, True),
)

LISTING = _struct(
    ("path", T.StringType(), False),
    ("is_dir", T.BooleanType(), False),
    ("size", T.LongType(), True),
    ("mtime", _TS, True),
)

CHANGE_EVENTS = _struct(
    ("event_id", T.LongType(), False),
    ("ts", _TS, True),
    ("path", T.StringType(), False),
    ("event_kind", T.StringType(), False),
    ("path_exists", T.BooleanType(), False),
    ("is_dir", T.BooleanType(), False),
)

IMPORT_RULES = _struct(
    ("rule_no", T.IntegerType(), False),
    ("path", T.StringType(), False),
    ("recursive", T.BooleanType(), False),
    ("flatten", T.BooleanType(), False),
    ("exclude", T.ArrayType(T.StringType()), False),
    ("include", T.ArrayType(T.StringType()), False),
    ("cache_mode", T.StringType(), False),
    ("cache_folder", T.StringType(), False),
    ("cache_fallback", T.StringType(), False),
)

TABLES = {
    "folders": FOLDERS,
    "media": MEDIA,
    "configs": CONFIGS,
    "values": VALUES,
    "work_items": WORK_ITEMS,
}

MEDIA_FILE_COLUMNS = [
    "id", "folder_id", "relative_path", "absolute_path", "content_hash", "width", "height",
    "format", "file_size", "is_present", "missing_since",
]
SUMMARY_COLUMNS = [
    "id", "folder_id", "relative_path", "absolute_path", "content_hash", "width", "height",
    "format", "file_size", "created_at", "modified_at", "is_present", "missing_since",
]
FOLDER_COLUMNS = [
    "id", "parent_id", "path", "recursive", "scan_complete", "exclude", "include",
    "thumbnail_cache_mode", "thumbnail_cache_folder", "thumbnail_cache_fallback",
]


def timestamp(text: str):
    """A fixed date-time as a TIMESTAMP_NTZ literal, independent of the session zone."""
    return F.lit(text).cast("timestamp_ntz")

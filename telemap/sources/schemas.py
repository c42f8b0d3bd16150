"""Fixed schemas at the borders between stages."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _I, _TS = (
    T.StringType(),
    T.LongType(),
    T.DoubleType(),
    T.IntegerType(),
    T.TimestampType(),
)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


PROCESS = _schema(
    ("pid_hash", _S),
    ("parent_pid_hash", _S),
    ("process_started", _TS),
    ("first_seen", _TS),
    ("hostname", _S),
    ("process_name", _S),
    ("process_path", _S),
    ("args", _S),
)
PROCESS_PATH = _schema(("pid_hash", _S), ("ptree", _S))
PROCESS_IMAGE_LOAD = _schema(("pid_hash", _S), ("filename", _S), ("first_seen", _TS))
PROCESS_FILTERED = _schema(
    ("pid_hash", _S),
    ("parent_pid_hash", _S),
    ("timestamp", _TS),
    ("hostname", _S),
    ("name", _S),
    ("cmdline", _S),
    ("ptree", _S),
)
IMAGE_LOADS = _schema(("pid_hash", _S), ("filename", _S), ("timestamp", _TS))
UNIQUES = _schema(("obj_id", _L), ("obj", _S), ("first_key", _S), ("n", _L))
TOKENS = _schema(("obj_id", _L), ("tokens", T.ArrayType(_S)))
MAP = _schema(("id", _S), ("x", _D), ("y", _D))
CLUSTERS = _schema(("id", _S), ("cluster", _I))
LABELS = _schema(("cluster", _I), ("label", _S))
ANNOTATIONS = _schema(("id", _S), ("label", _S), ("hover_text", _S))
DICTIONARY = _schema(("label", _S), ("rank", _L))

"""Shared folder for tables that cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.sources.shared import new_path, shared_folder, written  # noqa: F401  the operators write through this module

#: Estimated bytes of a table that is broadcast at most.
BROADCAST_BYTES = 24 << 20
#: Estimated bytes of a row of a hashed relation besides its values, and of a value.
ROW_BYTES, VALUE_BYTES = 24, 8


def broadcast_bytes(written_rows: DataFrame) -> int:
    """Estimated bytes of a written table of numbers and arrays of numbers, once it is broadcast."""
    arrays = [f.name for f in written_rows.schema.fields if f.dataType.typeName() == "array"]
    n, *items = written_rows.agg(F.count("*"), *(F.coalesce(F.sum(F.size(a)), F.lit(0)) for a in arrays)).first()
    return n * (ROW_BYTES + VALUE_BYTES * len(written_rows.columns)) + VALUE_BYTES * sum(items)


def limited_broadcast(written_rows: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if it has ``most`` bytes by estimate; else it is joined by a shuffle."""
    return F.broadcast(written_rows) if broadcast_bytes(written_rows) <= most else written_rows


def broadcast_if_small(ids: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A table that is written, counted, and broadcast if it is small; else it is joined by a shuffle."""
    return limited_broadcast(written(ids), most)

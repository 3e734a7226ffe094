"""Tables that are changed in place: only the buckets that a change touches are read and written again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parley.operators import maintenance

BUCKETS = 64
_BUCKET, _LIVE = "_bucket", "_live"


class StoredTable:
    """A Parquet table in a folder, dealt over buckets by a hash of the columns ``by``.

    A change finds the buckets that it touches (at most ``buckets`` numbers come to the driver), reads these
    alone, and overwrites these partitions alone; a bucket is written whole or not at all. Every bucket
    has a mark besides its rows, so that one that loses all its rows is overwritten too. Changes are
    functions of keys and values, so one that broke off between buckets is made good by making it again.
    One writer at a time; a reader sees each bucket before or after the change.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, by: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.by, self.buckets = spark, path, schema, by, buckets

    @classmethod
    def create(cls, rows: DataFrame, path: str, by: list[str], buckets: int = BUCKETS) -> StoredTable:
        """A new table of the rows; what is at the path goes."""
        made = cls(rows.sparkSession, path, rows.schema, by, buckets)
        made._marked(rows, list(range(buckets))).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(_BUCKET).parquet(path)
        return made

    def _bucket(self) -> Column:
        # In the table's own types, as equal numbers of other types have other hashes.
        kinds = {f.name: f.dataType for f in self.schema.fields}
        return F.pmod(F.xxhash64(*(F.col(f"`{c}`").cast(kinds[c]) for c in self.by)), F.lit(self.buckets)).cast("int")

    def _all(self) -> DataFrame:
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        return self.spark.read.schema(f"{names}, {_LIVE} boolean, {_BUCKET} int").parquet(self.path)

    def _marked(self, rows: DataFrame, buckets: list[int]) -> DataFrame:
        """Rows dealt to their buckets, with a mark for each of ``buckets``."""
        typed = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields))
        dealt = typed.withColumns({_LIVE: F.lit(True), _BUCKET: self._bucket()})
        marks = self.spark.createDataFrame([(b,) for b in buckets], f"{_BUCKET} int")
        empty = marks.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields), F.lit(False).alias(_LIVE), _BUCKET)
        # Spark splits a bucket that is too large for a task.
        return dealt.unionByName(empty).hint("rebalance", F.col(_BUCKET))

    def rows(self) -> DataFrame:
        """All rows of the table as it is now."""
        return self._all().where(_LIVE).select(*(F.col(f"`{c}`") for c in self.schema.names))

    def _touched(self, *hits: DataFrame) -> list[int]:
        """Buckets of the rows, each with the columns ``by``; at most as many as there are."""
        found: set[int] = set()
        for rows in hits:
            found |= {r[0] for r in rows.select(self._bucket()).distinct().collect()}
        return sorted(found)

    def _rewrite(self, buckets: list[int], change: Callable[[DataFrame], DataFrame]) -> list[int]:
        if buckets:
            old = self._all().where(F.col(_BUCKET).isin(buckets) & F.col(_LIVE)).select(*(F.col(f"`{c}`") for c in self.schema.names))
            self._marked(change(old), buckets).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(self.path)
            self.spark.catalog.refreshByPath(self.path)
        return buckets

    def upsert(self, new: DataFrame, keys: list[str], keep_old: bool = False) -> list[int]:
        """Rows by key, new ones in place of old ones, or the old ones kept (DO NOTHING); the buckets written. Keys include ``by``."""
        self._keyed(keys)
        return self._rewrite(self._touched(new), lambda old: maintenance.upserted(old, new, keys, keep_old))

    def replace(self, new: DataFrame, keys: list[str]) -> list[int]:
        """All old rows of the new rows' keys go, then the new rows come."""
        self._keyed(keys)
        return self._rewrite(self._touched(new), lambda old: maintenance.replace_partition(old, new, keys))

    def delete(self, gone: DataFrame, keys: list[str]) -> list[int]:
        """Rows of the keys in ``gone`` go."""
        self._keyed(keys)
        return self._rewrite(self._touched(gone), lambda old: maintenance.delete_matching(old, gone, keys))

    def update(self, condition: Column, values: dict[str, Column]) -> list[int]:
        """New values where the condition holds, in the buckets where it does. Columns ``by`` keep their values."""
        if set(values) & set(self.by):
            raise ValueError(f"{', '.join(self.by)} decide a row's bucket and cannot be updated; delete and insert")
        return self._rewrite(self._touched(self.rows().where(condition)), lambda old: maintenance.update_where(old, condition, values))

    def update_one(self, condition: Column, values: dict[str, Column]) -> list[int]:
        """As ``update``; an error if no row matches."""
        done = self.update(condition, values)
        if not done:
            raise LookupError("no row matches")
        return done

    def write_terms(self, new: DataFrame) -> list[int]:
        """Glossary terms, in place of those of the same id or of the same surface, language, scope and meeting.

        Terms are dealt by surface; the buckets of old terms of the same ids are written too.
        """
        self._keyed(["surface", "language", "scope", "meeting_id"])
        moved = self.rows().join(new.select("id").distinct(), "id", "left_semi")
        buckets = self._touched(new, moved)
        return self._rewrite(buckets, lambda part: maintenance.write_terms(part, new))

    def _keyed(self, keys: list[str]) -> None:
        if not set(self.by) <= set(keys):
            raise ValueError(f"the keys must include {', '.join(self.by)}, which decide a row's bucket")

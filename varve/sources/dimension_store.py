"""A change log and its type 2 dimension as parquet folders.

``log/batch_id=N/part=P``               changes of batch N, each part written once
``versions/batch_id=N/is_current=true`` all current versions after batch N
``versions/batch_id=N/is_current=false`` the versions batch N closed
``commits``                             one row per finished step

Closed versions are written once and never rewritten; a batch costs a pass over the
current versions only. A step counts when its commit row exists, and repeating an
unfinished step overwrites its own folder, so a job can be killed anywhere and rerun.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.operators import scd2

_COMMITS = "batch_id LONG, step STRING"


@dataclass(frozen=True)
class DimensionStore:
    spark: SparkSession
    root: str
    changes_schema: str
    spec: scd2.Spec = scd2.CUSTOMER

    def _path(self, part: str) -> str:
        return f"{self.root.rstrip('/')}/{part}"

    def _exists(self, part: str) -> bool:
        try:
            return bool(self.spark.read.schema(_COMMITS).parquet(self._path(part)).schema)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return False
            raise

    def _finished(self, step: str) -> list[int]:
        if not self._exists("commits"):
            return []
        rows = (
            self.spark.read.schema(_COMMITS).parquet(self._path("commits"))
            .where(F.col("step") == step).select("batch_id").distinct().collect()
        )
        return sorted(r.batch_id for r in rows)

    def _commit(self, batch_id: int, step: str) -> None:
        self.spark.createDataFrame([(batch_id, step)], _COMMITS).coalesce(1).write.mode(
            "append"
        ).parquet(self._path("commits"))

    def ingested(self) -> list[int]:
        return self._finished("ingested")

    def applied(self) -> list[int]:
        return self._finished("applied")

    def ingest(self, batch_id: int, changes: DataFrame) -> bool:
        """Add a batch to the log. False when the log already has it."""
        if batch_id in self.ingested():
            return False
        changes.drop(self.spec.batch).write.mode("overwrite").parquet(
            self._path(f"log/{self.spec.batch}={batch_id}/part=whole")
        )
        self._commit(batch_id, "ingested")
        return True

    def add_part(self, changes: DataFrame, part: str) -> None:
        """Add some rows of one or more batches to the log; repeating a part replaces it.

        Rows of a batch that was applied before change nothing if the log has them. Others
        would be lost, so they are an error.
        """
        key, last = F.col(self.spec.batch), max(self.applied(), default=None)
        if last is not None:
            late = changes.where(key <= last)
            if not late.isEmpty():
                known = self._rows().select(late.columns)
                if not late.exceptAll(known).isEmpty():
                    raise ValueError(f"rows arrived for a batch up to {last}, which was applied")
            changes = changes.where(key > last)
        changes.withColumn("part", F.lit(part)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(self.spec.batch, "part").parquet(self._path("log"))

    def close_parts(self) -> None:
        """Take every batch in the log for complete."""
        if self._exists("log"):
            held = self._rows().select(self.spec.batch).distinct().collect()
            for batch_id in sorted({r[0] for r in held} - set(self.ingested())):
                self._commit(batch_id, "ingested")

    def _rows(self) -> DataFrame:
        schema = f"{self.changes_schema}, part STRING"
        return self.spark.read.schema(schema).parquet(self._path("log")).drop("part")

    def batch(self, batch_id: int) -> DataFrame:
        """The changes of one batch. A row that was delivered in two parts counts once."""
        return self._rows().where(F.col(self.spec.batch) == batch_id).distinct()

    def _pending(self, batch_id: int) -> DataFrame:
        """One batch to be applied. In a run of changes a row delivered twice stands next to itself and
        changes nothing the second time, so runs take the rows as they lie."""
        if self.spec.many_per_batch:
            return self._rows().where(F.col(self.spec.batch) == batch_id)
        return self.batch(batch_id)

    def log(self) -> DataFrame:
        """The changes of every finished batch."""
        return self._rows().where(F.col(self.spec.batch).isin(self.ingested())).distinct()

    def _versions(self) -> tuple[DataFrame, int] | None:
        done = self.applied()
        if not done:
            return None
        sample = scd2.empty(self.spark, self.batch(done[-1]), self.spec)
        schema = sample.schema.add("batch_id", "long")
        frame = self.spark.read.schema(schema).parquet(self._path("versions"))
        return frame.where(F.col("batch_id").isin(done)), done[-1]

    def current(self) -> DataFrame | None:
        found = self._versions()
        if found is None:
            return None
        versions, last = found
        return versions.where(F.col("is_current") & (F.col("batch_id") == last)).select(
            *self.spec.columns
        )

    def dimension(self) -> DataFrame | None:
        """All versions after the last applied batch; None before the first."""
        found = self._versions()
        if found is None:
            return None
        versions, last = found
        return versions.where(~F.col("is_current") | (F.col("batch_id") == last)).select(
            *self.spec.columns
        )

    def apply_pending(self) -> list[int]:
        """Apply every logged batch not applied yet, in order; returns their ids.

        A batch that arrives below the last applied one is refused: applied out of order it
        would close versions in the wrong place.
        """
        done = self.applied()
        pending = [b for b in self.ingested() if b not in done]
        if done and pending and pending[0] < done[-1]:
            raise ValueError(f"batch {pending[0]} arrived after batch {done[-1]} was applied")
        for batch_id in pending:
            changes = self._pending(batch_id)
            current = self.current()
            if current is None:
                current = scd2.empty(self.spark, changes, self.spec)
            scd2.apply_changes(current, changes, self.spec).write.mode("overwrite").partitionBy(
                "is_current"
            ).parquet(self._path(f"versions/batch_id={batch_id}"))
            self._commit(batch_id, "applied")
        return pending

"""The catalog of uploads as a stored table of changes: append, delete with an owner check, select, compact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from gridmeter.sources.catalog import catalog_delete, catalog_select

KEYS = ("user_id", "id")
#: Folders that users are dealt to; a select of one user reads one of them.
BUCKETS = 64


class StoredCatalog:
    """Changes as Parquet in folders by bucket of `user_id` and by batch; the newest change of a key is its row.

    * A change is a row, or a row marked as deleted. Batches are numbered by the caller, ascending; writing a batch replaces what an
      earlier attempt of the same batch wrote, so a job that runs twice with the same rows adds nothing. One batch is one call.
      Writers that share the table must not share batch numbers.
    * Keys are (`user_id`, `id`); an `id` of another user is another key, which is the owner check. Rows with a null in their key are
      kept and replaced like others, but match no select by that key and no delete.
    * Of equal keys in one batch the greatest row is kept (columns compared in order, deletion first).
    * An empty batch, an empty table and a delete of unknown keys are fine and change nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = BUCKETS):
        """`schema`: columns of the catalog, the keys among them. A new path becomes an empty table."""
        taken = {"bucket", "batch", "deleted"} & {name.lower() for name in schema.names}
        if taken or not set(KEYS) <= set(schema.names):
            raise ValueError(f"a catalog needs the columns {KEYS} and none named {sorted(taken)}")
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets
        # Every column may be null in files; folders give bucket and batch.
        self.stored = StructType([f for f in StructType.fromJson(schema.jsonValue())]).add("deleted", BooleanType())
        self.stored = self.stored.add("bucket", IntegerType()).add("batch", LongType())
        spark.createDataFrame([], self.stored).write.mode("append").partitionBy("bucket", "batch").parquet(path)

    def _bucket(self, user: Column) -> Column:
        return F.pmod(F.xxhash64(user), F.lit(self.buckets)).cast("int")

    def changes(self) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(self.path)

    def _write(self, rows: DataFrame, batch: int, deleted: bool) -> None:
        columns = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields]
        out = rows.select(*columns).withColumns({
            "deleted": F.lit(deleted), "bucket": self._bucket(F.col("user_id")), "batch": F.lit(batch).cast("long")})
        # The hint puts a bucket into few files and splits one that holds most rows.
        out.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "bucket", "batch").parquet(self.path)

    def append(self, rows: DataFrame, batch: int) -> None:
        """Add rows, or replace those of equal keys."""
        self._write(rows, batch, deleted=False)

    def _newest(self, changes: DataFrame) -> DataFrame:
        row = F.struct(*[f"`{c}`" for c in self.schema.names])
        newest = changes.groupBy(*KEYS).agg(F.max(F.struct("batch", "deleted", row.alias("row"))).alias("_newest"))
        return newest.filter(~F.col("_newest.deleted")).select("_newest.row.*")

    def snapshot(self) -> DataFrame:
        return self._newest(self.changes())

    def select(
        self, equals: Mapping[str, object] | None = None, columns: Sequence[str] | None = None, order: Sequence[Column | str] = (),
    ) -> DataFrame:
        """Current rows; equality on keys reaches the files, and a user's bucket is the only folder read.

        Other columns are compared after the newest change is known, as an older change might match."""
        changes = self.changes()
        for name, value in (equals or {}).items():
            if name in KEYS:
                changes = changes.filter(F.col(name) == F.lit(value).cast(self.schema[name].dataType))
            if name == "user_id":
                changes = changes.filter(F.col("bucket") == self._bucket(F.lit(value).cast(self.schema[name].dataType)))
        return catalog_select(self._newest(changes), equals, columns, order)

    def delete(self, keys: DataFrame, batch: int) -> DataFrame:
        """Delete the rows of these (`id`, `user_id`) and return them; rows of other users stay, whatever their id.

        The result is read from the stored batch, so it stays the same after later changes; a second run of the batch returns the same."""
        wanted = keys.select(*KEYS).distinct()
        _, gone = catalog_delete(self._newest(self.changes().filter(F.col("batch") < batch)), wanted)
        self._write(gone, batch, deleted=True)
        done = self.changes().filter((F.col("batch") == batch) & F.col("deleted"))
        return done.select(*[f"`{c}`" for c in self.schema.names])

    def compact(self, path: str, batch: int = 0) -> StoredCatalog:
        """The current rows as one batch of a new table; the old one is left to its owner, and readers switch when this returns."""
        new = StoredCatalog(self.spark, path, self.schema, self.buckets)
        new.append(self.snapshot(), batch)
        return new

"""Keyed stores on plain Parquet, exports and metadata clean-up."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.session import cut_lineage, forget


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete_documents(rows: DataFrame, ids: DataFrame, column: str = "document_id") -> DataFrame:
    """``rows`` without those of the documents in ``ids(id)``."""
    return rows.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_anti")


def deleted_counts(rows: DataFrame, ids: DataFrame, column: str = "document_id") -> DataFrame:
    """How many rows each named document loses, 0 included."""
    hit = rows.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_semi").groupBy(column).agg(F.count("*").alias("n"))
    return ids.select(F.col("id").alias(column)).distinct().join(hit, column, "left").select(
        column, F.coalesce("n", F.lit(0)).alias("deleted")
    )


REPLACED, MARKS = "batch_documents", "batch_marks"  # tables of a batch beside its own


@dataclass(frozen=True)
class ChunkStore:
    """Rows of documents in plain Parquet, partitioned by a bucket of the document id.

    An upsert or a deletion reads the buckets it names and overwrites just these; the others are left alone. What replaces
    them is written to the shared folder first, so nothing is lost with an executor, and doing it again gives the same rows.
    A bucket with hot documents is spread over several files. The number of buckets is fixed for the life of a store.
    """

    spark: SparkSession
    path: str
    buckets: int = 32

    def write(self, rows: DataFrame) -> None:
        """Make the store hold ``rows`` in the buckets they fall in."""
        self._overwrite(rows.withColumn("bucket", self._bucket("document_id")))

    def upsert(self, new: DataFrame, keys: list[str]) -> None:
        """Rows of ``new`` replace stored rows with the same ``keys``."""
        touched = self._touched(new)
        self._replace(touched, upsert(self._rows(touched), new, keys))

    def delete(self, ids: DataFrame) -> None:
        """Drop all rows of the documents in ``ids(id)``."""
        touched = self._touched(ids.withColumnRenamed("id", "document_id"))
        self._replace(touched, delete_documents(self._rows(touched), ids))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("document_id").isNotNull()).drop("bucket")

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r["bucket"] for r in rows.select(self._bucket("document_id").alias("bucket")).distinct().collect()]

    def _rows(self, touched: list[int]) -> DataFrame:
        stored = self.spark.read.parquet(self.path)
        return stored.where(F.col("bucket").isin(touched) & F.col("document_id").isNotNull()).drop("bucket")

    def _replace(self, touched: list[int], rows: DataFrame) -> None:
        # dynamic overwrite leaves buckets without rows as they were, so each gets a row of no document
        ends = self.spark.createDataFrame([(b,) for b in touched], "bucket int")
        staged = cut_lineage(rows.withColumn("bucket", self._bucket("document_id")).unionByName(ends, allowMissingColumns=True))
        self._overwrite(staged)
        forget(staged)

    def _overwrite(self, rows: DataFrame) -> None:
        dynamic = rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        dynamic.partitionBy("bucket").parquet(self.path)


@dataclass(frozen=True)
class BatchTables:
    """Several Parquet tables of documents, written a batch at a time and seen a batch at a time.

    A batch is a partition of every table. Which documents it replaces is written after its rows, and a one-row mark last of all:
    until then readers see none of the batch in any table. Of every document the rows of its newest marked batch
    count, so a document that is named without rows loses those it had. A batch that failed half-way is written
    again under its number. ``rewrite`` brings many batches back to one.
    """

    spark: SparkSession
    folder: str

    def put(self, table: str, rows: DataFrame, batch: int) -> DataFrame:
        """Write one table of a batch; returns the rows as written."""
        path = self._place(table, batch)
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def commit(self, ids: DataFrame, batch: int) -> None:
        """Let readers see the batch, which replaces the documents in ``ids(document_id)``."""
        ids.select("document_id").distinct().write.mode("overwrite").parquet(self._place(REPLACED, batch))
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(self._place(MARKS, batch))

    def read(self, table: str) -> DataFrame:
        return self._stored(table).join(self._newest(), ["document_id", "batch"], "left_semi").drop("batch")

    def rewrite(self, folder: str, tables: tuple[str, ...]) -> BatchTables:
        """The tables as they stand, as one batch below another folder; later batches go there."""
        fresh, last = BatchTables(self.spark, folder), self._stored(MARKS).agg(F.max("batch")).first()[0]
        for table in tables:
            fresh.put(table, self.read(table), last)
        fresh.commit(self._newest(), last)
        return fresh

    def _place(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch={batch}"

    def _stored(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}").withColumn("batch", F.col("batch").cast("long"))

    def _newest(self) -> DataFrame:
        named = self._stored(REPLACED).join(self._stored(MARKS), "batch", "left_semi")
        return named.groupBy("document_id").agg(F.max("batch").alias("batch"))


def iso_text(moment: Column) -> Column:
    """ISO form of a moment; the fraction appears only where there is one."""
    moment = moment.cast("timestamp")
    fraction = F.when(F.unix_micros(moment) % 1_000_000 == 0, "").otherwise(F.date_format(moment, ".SSSSSS"))
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), fraction)


def rows_as_json(rows: DataFrame) -> DataFrame:
    """Each row as JSON with ISO timestamps, null fields kept."""
    moments = {c for c, kind in rows.dtypes if kind in ("timestamp", "timestamp_ntz")}
    fields = [iso_text(F.col(c)).alias(c) if c in moments else F.col(c) for c in rows.columns]
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def export_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One folder of JSON lines per table."""
    for name, rows in tables.items():
        rows_as_json(rows).write.mode("overwrite").text(f"{folder}/{name}")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def export_graph(nodes: DataFrame, edges: DataFrame, limit: int | None = 500) -> tuple[DataFrame, DataFrame]:
    """The first nodes by id (None: all) and their out-edges, distinct and complete."""
    picked = nodes if limit is None else nodes.orderBy("id").limit(limit)
    whole = edges.where("src <> '' and dst <> '' and rel <> ''")
    return picked, whole.join(picked.select(F.col("id").alias("src")), "src", "left_semi").distinct()


def seed_rules(existing: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds whose code is not known yet; of several with one code the first by its other columns."""
    fresh = seeds.join(existing.select("rule_code"), "rule_code", "left_anti")
    others = [c for c in seeds.columns if c != "rule_code"]
    return fresh.groupBy("rule_code").agg(F.min(F.struct(*others)).alias("s")).select("rule_code", *[F.col("s")[c].alias(c) for c in others])


def sanitized_metadata(document_id: Column, chunk_index: Column, char_start: Column, char_end: Column, own: Column) -> Column:
    """Chunk metadata as stored: base fields under the chunk's own, nulls dropped, values as text."""
    base = F.create_map(
        F.lit("document_id"), document_id, F.lit("chunk_index"), chunk_index.cast("string"),
        F.lit("char_start"), char_start.cast("string"), F.lit("char_end"), char_end.cast("string"),
    )
    return F.map_filter(F.map_concat(base, own), lambda _, v: v.isNotNull())

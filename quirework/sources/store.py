"""The stored relations as parquet tables to which batches are appended exactly once.

A batch has an id and brings rows for one table or several.  Its rows go to a folder of its
own in each table; a marker, renamed into place when all of them are written, commits the
batch.  Readers see committed batches only, so the tables of a batch appear together; a batch
that was cut off leaves folders that nobody reads and that its next attempt replaces; a batch
that is committed already adds nothing.  Under a stream the id is the stream's name and the
micro-batch number, which Spark repeats after a failure: that makes ``foreachBatch`` exactly once.

Parquet has no updates: what a row is now follows from the rows appended (``operators.state``).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quirework.schemas import RELATIONS


class WrongColumns(ValueError):
    code = "WRONG_COLUMNS"


def conformed(name: str, frame: DataFrame) -> DataFrame:
    """The relation's columns, in its order and types; optional ones may be absent, none may be unknown, a null where one must not be fails the write."""
    schema = RELATIONS[name]
    unknown, absent = set(frame.columns) - set(schema.names), [f.name for f in schema if not f.nullable and f.name not in frame.columns]
    if unknown or absent:
        raise WrongColumns(f"{name}: unknown {sorted(unknown)}, absent {absent}")

    def column(f):
        value = (F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType)
        return (value if f.nullable else F.when(value.isNull(), F.raise_error(F.lit(f"{name}.{f.name} is null")).cast(f.dataType)).otherwise(value)).alias(f.name)

    return frame.select(*map(column, schema))


class Store:
    """Tables below a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self.files = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        return self.files.exists(self.path(f"{self.root}/_commits/{batch}"))

    def append(self, batch: str, **tables: DataFrame) -> bool:
        """Write a batch; False if it is committed already."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        if self.committed(batch):
            return False
        for name, frame in tables.items():
            conformed(name, frame).write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")
        draft = f"{self.root}/_drafts/{uuid.uuid4().hex}"
        out = self.files.create(self.path(draft))
        out.write(bytearray(f"{batch} {','.join(sorted(tables))}\n".encode()))
        out.close()
        self.files.mkdirs(self.path(f"{self.root}/_commits"))
        # of two writers of one batch, whose rows are the same, one renames and the other finds it done
        if not self.files.rename(self.path(draft), self.path(f"{self.root}/_commits/{batch}")):
            self.files.delete(self.path(draft), False)
            return False
        return True

    def read(self, name: str) -> DataFrame:
        """The rows of all committed batches, each with its ``batch``."""
        schema = RELATIONS[name]
        shape = StructType([*schema.fields, StructField("batch", StringType())])
        if not (self.files.exists(self.path(f"{self.root}/{name}")) and self.files.exists(self.path(f"{self.root}/_commits"))):
            return self.spark.createDataFrame([], shape)
        marks = self.spark.read.text(f"{self.root}/_commits").select(F.split("value", " ").alias("m"))
        done = marks.where(F.array_contains(F.split(F.col("m")[1], ","), name)).select(F.col("m")[0].alias("batch"))
        rows = self.spark.read.schema(shape).parquet(f"{self.root}/{name}")
        # markers are a few bytes a batch; the join prunes folders, not rows
        return rows.join(done, "batch", "left_semi").select(*schema.names, "batch")

    def sink(self, stream: str, tables: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch``: ``tables`` makes the rows of each table from a micro-batch."""

        def write(frame: DataFrame, number: int) -> None:
            self.append(f"{stream}-{number}", **tables(frame))

        return write

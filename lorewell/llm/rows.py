"""Rows of a stored table, told apart by where they are stored.

A row's uid is made of the number of its file, in order of path, and its place
in that file. A running number of a scan changes when Spark splits the files
another way, as it may when executors come or go; a place in a file doesn't. So
a table may be scanned again, by other executors, and every scan and every
repeated task gives its rows the same uids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lorewell.scratch import materialize

#: Bits of a uid that hold the place in a file; blocks of 32,768 rows whose marks (4 KB a block) are broadcast at most.
PLACE_BITS, BLOCKS = 40, 8192


def _is_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is a scan of Parquet files, perhaps with columns selected and rows filtered."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.relation().toString().lower()


class Rows:
    """A table whose rows can be told apart in every scan; what isn't a scan of Parquet files is written first."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        self.docs = docs if _is_scan(docs) else materialize(docs, "stored")
        paths = self.docs.select(self._at("file_path").alias("path")).distinct().collect()  # the driver lists the files for every scan
        files = spark.createDataFrame(list(enumerate(sorted(r["path"] for r in paths))), "file long, path string")
        self.files = materialize(files.coalesce(1), "files")

    def _at(self, field: str) -> Column:
        return self.docs.metadataColumn("_metadata")[field]

    def whole(self, *without: str) -> Column:
        """All columns, but for some, as one struct, in which no name can clash with another."""
        return F.struct(*[F.col(f"`{c}`") for c in self.docs.columns if c not in without])

    def pick(self, *columns: Column) -> DataFrame:
        """uid and the given columns of every row."""
        picked = self.docs.select(self._at("file_path").alias("path"), self._at("row_index").alias("place"), F.struct(*columns).alias("own"))
        uid = F.shiftleft("file", PLACE_BITS).bitwiseOR(F.col("place")).alias("uid")
        return picked.join(F.broadcast(self.files), "path").select(uid, "own.*")

    def marked(self, marks: DataFrame, *columns: Column) -> DataFrame:
        """uid, the given columns and ``marked``: whether a row's uid is in ``marks``.

        The marks go to the rows as one bit for each row of the table, so no
        text is moved; more than BLOCKS blocks of them are joined instead.
        """
        rows, marks = self.pick(*columns), marks.select("uid")
        block = F.bitmap_bucket_number("uid").alias("block")
        bits = materialize(marks.groupBy(block).agg(F.bitmap_construct_agg(F.bitmap_bit_position("uid")).alias("bits")), "marks")
        if bits.count() > BLOCKS:
            return rows.join(marks.distinct().withColumn("marked", F.lit(True)), "uid", "left").fillna(False, ["marked"])
        at = F.bitmap_bit_position("uid").cast("int")
        byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = rows.withColumn("_block", F.bitmap_bucket_number("uid")).join(F.broadcast(bits), F.col("_block") == F.col("block"), "left")
        return found.select(*rows.columns, F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False)).alias("marked"))

    def only(self, marks: DataFrame, *columns: Column) -> DataFrame:
        """uid and the given columns of the rows whose uid is in ``marks``."""
        return self.marked(marks, *columns).where("marked").drop("marked")

    def keep(self, marks: DataFrame) -> DataFrame:
        """The rows whose uid is in ``marks``, with all columns of the table."""
        return self.only(marks, self.whole().alias("row")).select("row.*")

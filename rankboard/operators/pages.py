"""A ranked frame in files of consecutive ranks, and pages read from the files that hold them.

``RankedPages.write`` sorts a frame once (range partitions, sorted inside) and writes it; every file is a
run of consecutive ranks.  The index has one row a file: its first and last rank.  A page then is a
look into the index and a scan of one or two files with a pushed-down filter: no sort, no shuffle,
no write, whatever page it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_path

_POS_BITS = 33
_INDEX = "file string, part long, first long, last long, base long"


class RankedPages:
    """Rows in rank order under ``path/rows``, with the ranks of every file under ``path/index``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._rows = spark.read.parquet(f"{self.path}/rows")
        self._index = spark.read.schema(_INDEX).parquet(f"{self.path}/index")

    @classmethod
    def write(cls, df: DataFrame, order: Sequence[Column], path: str | None = None,
              num_partitions: int | None = None) -> RankedPages:
        """Sort by ``order`` (a total order: end it with a unique key) and write.

        Inside ``session.lineage_scope`` the files are released with the scope; give a ``path`` and call it
        outside one to keep them.
        """
        spark = df.sparkSession
        path = path or shared_path(spark, "lineage", "pages")
        ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
        sorted_ = ranged.sortWithinPartitions(*order).withColumn("_rk_mid", F.monotonically_increasing_id())
        rows = cut_lineage(sorted_, "pages", f"{path}/rows")
        # ids are consecutive inside a partition, so the first id of a file tells the ranks of all its rows
        runs = (rows.groupBy(F.col("_metadata.file_path").alias("file"))
                    .agg(F.min("_rk_mid").alias("base"), F.count(F.lit(1)).alias("n")))
        upto = F.sum("n").over(Window.orderBy("base"))   # one row a file
        index = runs.select("file", F.shiftright("base", _POS_BITS).alias("part"), (upto - F.col("n") + 1).alias("first"),
                            upto.alias("last"), "base")
        cut_lineage(index.coalesce(1), "pages_index", f"{path}/index")
        return cls(spark, path)

    def total(self) -> int:
        return self._index.agg(F.max("last")).first()[0] or 0

    def ranks(self, first: int, last: int, out_col: str = "rank") -> DataFrame:
        """The rows ranked ``first`` to ``last``."""
        files = self._index.where((F.col("first") <= last) & (F.col("last") >= first)).collect()   # no more than ranks asked for
        out = None
        for f in sorted(files, key=lambda r: r["first"]):
            shift = f["first"] - f["base"]
            lo, hi = max(first, f["first"]) - shift, min(last, f["last"]) - shift
            rows = (self.spark.read.schema(self._rows.schema).parquet(f["file"]).where(F.col("_rk_mid").between(lo, hi))
                        .withColumn(out_col, (F.col("_rk_mid") + shift).cast("long")).drop("_rk_mid"))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            out = self._rows.where("false").withColumn(out_col, F.col("_rk_mid")).drop("_rk_mid")
        return out

    def page(self, page_no: int, page_size: int, out_col: str = "rank") -> DataFrame:
        """Page ``page_no``, from 1."""
        return self.ranks((page_no - 1) * page_size + 1, page_no * page_size, out_col)

    def last_page(self, page_size: int) -> int:
        return max(1, -(-self.total() // page_size))

    def all(self, out_col: str = "rank") -> DataFrame:
        """Every row with its rank."""
        parts = self._index.groupBy("part").agg((F.min("first") - F.min("base")).alias("_shift"))   # one row a partition
        return (self._rows.withColumn("part", F.shiftright("_rk_mid", _POS_BITS)).join(F.broadcast(parts), "part")
                    .withColumn(out_col, (F.col("_rk_mid") + F.col("_shift")).cast("long")).drop("part", "_rk_mid", "_shift"))

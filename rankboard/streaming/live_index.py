"""The stored rank index of a live board: seats and cells, kept current from changed users only.

``<board>_seats`` holds every roster row with its totals and seat, in buckets of ``user_id`` ranges
(``sources.buckets``); ``<board>_cells`` the score histogram (``operators.rank_index``).  A batch of changed
totals rewrites the buckets of the users it holds, re-seats those, and recounts their cells.  The
index is rebuilt from roster and totals when the roster has changed, or when a batch went by
that the index has not seen.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rank_index as X
from ..operators.leaderboard import board_from_totals
from ..sources.buckets import BUCKETS_PROPERTY, bucket_count, create_bucket_table, in_buckets, replace_buckets, set_properties
from ..sources.tables import publish_version, table_location, table_property, table_version

SEATS_DDL = ("user_id STRING, display_name STRING, email STRING, total_points BIGINT, questions_answered BIGINT, "
             "seat BIGINT")
CELLS_DDL = "bucket INT, total_points BIGINT, questions_answered BIGINT, n BIGINT"
BATCH, ROSTER, BOUNDS = "rankboard.index.batch", "rankboard.index.roster", "rankboard.index.bounds"
# Members of a bucket, about, when an index is built.
SEATS = 100_000


class RankIndex:
    """The index of the board ``board_table``, under ``root`` (shared storage)."""

    def __init__(self, spark: SparkSession, board_table: str, root: str, buckets: int | None = None):
        self.spark, self.root = spark, f"{root.rstrip('/')}/index"
        self.seats_table, self.cells_table = f"{board_table}_seats", f"{board_table}_cells"
        self.buckets = buckets

    @classmethod
    def of(cls, spark: SparkSession, board_table: str) -> RankIndex:
        """The index of a live board, found by the board's name."""
        return cls(spark, board_table, table_location(spark, f"{board_table}_seats").rsplit("/", 2)[0])

    # -- state ---------------------------------------------------------------------
    def _property(self, key: str) -> str | None:
        exists = self.spark.catalog.tableExists(self.seats_table)
        return table_property(self.spark, self.seats_table, key) if exists else None

    @property
    def batch(self) -> int | None:
        """The last batch that the index holds (None: there is no index)."""
        held = self._property(BATCH)
        return None if held is None else int(held)

    def seats(self) -> DataFrame:
        return self.spark.table(self.seats_table)

    def cells(self) -> DataFrame:
        return self.spark.table(self.cells_table)

    def _bounds(self) -> list[str]:
        rows = self.spark.read.schema("low string").parquet(self._property(BOUNDS)).collect()   # < MAX_BUCKETS
        return sorted(r["low"] for r in rows)

    # -- updates -------------------------------------------------------------------
    def update(self, changed: DataFrame, batch_id: int, roster: DataFrame | str, totals: DataFrame) -> str:
        """Bring the index to ``batch_id``; ``totals`` hold that batch already, ``changed`` its users' totals.

        Returns how: ``held`` (nothing to do), ``changed`` (the users' buckets) or ``rebuilt``."""
        version = table_version(self.spark, roster) if isinstance(roster, str) else "frame"
        if self.batch is None or self._property(ROSTER) != version or self.batch not in (batch_id, batch_id - 1):
            rows = self.spark.table(roster) if isinstance(roster, str) else roster
            self.rebuild(board_from_totals(rows, totals, keep_key=True), batch_id, version)
            return "rebuilt"
        if self.batch == batch_id:
            return "held"
        self.change(changed, batch_id)
        return "changed"

    def rebuild(self, board: DataFrame, batch_id: int, version: str) -> None:
        """Build the index from a whole board (``user_id``, names, totals)."""
        spark = self.spark
        wanted = self.buckets or min(X.MAX_BUCKETS, max(4, -(-board.count() // SEATS)))
        bounds = X.range_bounds(board, wanted)
        create_bucket_table(spark, self.seats_table, SEATS_DDL, f"{self.root}/seats", wanted)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.cells_table} ({CELLS_DDL}) USING parquet LOCATION '{self.root}/cells/v0'")
        path = f"{self.root}/bounds-{uuid.uuid4().hex[:8]}"
        spark.createDataFrame([(b,) for b in bounds], "low string").coalesce(1).write.parquet(path)
        every = range(max(wanted, bucket_count(spark, self.seats_table)))
        seats = X.seated(board.withColumn("bucket", X.bucket_of(bounds)))
        replace_buckets(seats, self.seats_table, list(every), f"{batch_id:012d}", {BUCKETS_PROPERTY: len(every)})
        self._publish_cells(X.count_cells(self.seats()))
        set_properties(spark, self.seats_table, {BOUNDS: path, ROSTER: version, BATCH: batch_id})

    def change(self, changed: DataFrame, batch_id: int) -> list[int]:
        """Take in the new totals of some users; users who are not on the roster change nothing."""
        bounds = self._bounds()
        new = changed.select("user_id", *(F.col(c).alias(f"_{c}") for c in X.SCORE)).persist()
        try:
            touched = sorted(r["b"] for r in new.select(X.bucket_of(bounds).alias("b")).distinct().collect())   # <= buckets
            held = in_buckets(self.seats(), touched).drop("seat")
            now = held.join(new, "user_id", "left")
            for c in X.SCORE:
                now = now.withColumn(c, F.coalesce(f"_{c}", c))
            replace_buckets(X.seated(now.select(*held.columns)), self.seats_table, touched, f"{batch_id:012d}")   # may be empty: strangers
            recounted = X.count_cells(in_buckets(self.seats(), touched))
            rest = self.cells().where(~F.col("bucket").isin(touched))
            self._publish_cells(rest.unionByName(recounted))
            set_properties(self.spark, self.seats_table, {BATCH: batch_id})
            return touched
        finally:
            new.unpersist()

    def _publish_cells(self, cells: DataFrame) -> None:
        publish_version(cells.repartition(1), self.cells_table, f"{self.root}/cells/v{uuid.uuid4().hex[:12]}")

    # -- reads -----------------------------------------------------------------------
    def board(self) -> DataFrame:
        """Every member with its rank."""
        return X.with_rank(self.seats(), X.offsets(self.cells())).drop("seat", "bucket")

    def ranks(self, first: int, last: int) -> DataFrame:
        """The members ranked ``first`` to ``last``: the cells name the buckets and scores to read."""
        placed = X.offsets(self.cells()).where((F.col("before") < last) & (F.col("before") + F.col("n") >= first))
        cells = placed.collect()   # at most one a rank asked for
        if not cells:
            return self.board().where("false")
        wanted = None
        for c in cells:
            part = ((F.col("bucket") == c["bucket"]) & (F.col("total_points") == c["total_points"])
                    & (F.col("questions_answered") == c["questions_answered"])
                    & F.col("seat").between(first - c["before"], last - c["before"]))
            wanted = part if wanted is None else wanted | part
        rows = in_buckets(self.seats(), sorted({c["bucket"] for c in cells})).where(wanted)
        known = self.spark.createDataFrame(cells, placed.schema)
        return X.with_rank(rows, F.broadcast(known)).drop("seat", "bucket")   # one row a rank asked for, at most

    def rank_of(self, user_id: str) -> DataFrame:
        """One user's row with the rank; empty for a user who is not on the board."""
        bucket = bisect_right(self._bounds(), user_id)
        mine = self.seats().where((F.col("bucket") == bucket) & (F.col("user_id") == user_id))
        return X.with_rank(mine, X.offsets(self.cells())).drop("seat", "bucket")

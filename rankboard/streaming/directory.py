"""The roster kept in step with a directory that is exported page by page.

Pages arrive as files, in any order and perhaps more than once.  The state store holds, per user, the
entry listed last (``startIndex`` and position), so what a micro-batch sends on is the right
row whatever came first; it is MERGEd into the roster.  After any arrival order, and after replays, the
roster equals ``ingest_directory`` of all pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..operators import roster as R
from ..session import STREAMING_CONF
from ..sources import tables as TB

UPDATED = ["email", "display_name", "user_name"]


def stream_directory_pages(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of JSON Lines pages; a page that does not parse raises, as in the batch reader."""
    reader = spark.readStream.schema(S.DIRECTORY_PAGE).option("mode", "FAILFAST").option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.json(path)


class RosterMerge:
    """``foreachBatch`` body: the batch's users (one row each) into the roster; running it again changes nothing."""

    def __init__(self, users_table: str):
        self.users_table = users_table

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        source = batch.persist()
        try:
            if source.isEmpty():
                return
            if TB.has_row_level_operations(spark, self.users_table):
                TB.native_merge(source, self.users_table, "user_id", UPDATED)
            else:
                TB.rewrite(spark, self.users_table, lambda users: R.upsert(users, source, source_is_unique=True))
        finally:
            source.unpersist()


def start_directory_sync(pages: DataFrame, users_table: str, checkpoint: str, missing_active: bool = False,
                         missing_email: str | None = None, trigger: str | None = None) -> StreamingQuery:
    """S1 / S9 as a stream: ``pages`` (``stream_directory_pages``) into ``users_table``."""
    spark = pages.sparkSession
    for k, v in STREAMING_CONF.items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
    last = R.ingest_directory(pages, missing_active, missing_email)
    writer = (last.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
                  .foreachBatch(RosterMerge(users_table)))
    writer = writer.trigger(availableNow=True) if trigger in (None, "availableNow") else writer.trigger(processingTime=trigger)
    return writer.start()

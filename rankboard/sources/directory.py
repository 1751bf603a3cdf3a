"""Directory export source.

The reference pulls users page by page over HTTP.  Here the pages are files of
JSON Lines, one page document ``{"Resources": [...]}`` per line, so the input is
splittable and each row holds one bounded page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S


def read_directory_pages(spark: SparkSession, path: str, whole_documents: bool = False) -> DataFrame:
    """Read page documents with a fixed schema (no inference pass over the data).

    One document per line, or with ``whole_documents`` one per file (over several lines;
    such a file is read by one task).  A page that is cut short or holds a field of the wrong
    type raises: no user is lost without a word.
    """
    return spark.read.schema(S.DIRECTORY_PAGE).json(path, mode="FAILFAST", multiLine=whole_documents)


def parse_directory_pages(text: DataFrame, column: str = "value") -> DataFrame:
    """Page documents held as JSON text in a column (e.g. from a stream or a table); malformed text raises."""
    return text.select(F.from_json(F.col(column), S.DIRECTORY_PAGE, {"mode": "FAILFAST"}).alias("p")).select("p.*")


def write_directory_pages(pages: DataFrame, path: str) -> str:
    """Write pages (``startIndex`` if present, ``Resources``) as JSON Lines; absent fields are omitted."""
    cols = [c for c in ("startIndex", "Resources") if c in pages.columns]
    pages.select(F.to_json(F.struct(*cols)).alias("value")).write.mode("overwrite").text(path)
    return path

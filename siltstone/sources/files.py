"""Source files as tables of numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered_lines(files: DataFrame) -> DataFrame:
    """``repo, path, line, text`` of ``files(repo, path, content)``; lines count from 1.

    Lines end at LF or CRLF.  A file without content has one empty line; a null
    content has none.
    """
    lines = F.posexplode(F.split("content", "\r?\n", -1)).alias("at", "text")
    return files.filter("content is not null").select("repo", "path", lines).select("repo", "path", (F.col("at") + 1).alias("line"), "text")

"""Words and word windows of texts as Spark expressions; no Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of ASCII white space.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Words of a text; none of a null one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def window_hashes(word_hashes: Column, size: int) -> Column:
    """64-bit hashes of all windows of ``size`` words, in order, from the words' hashes."""
    n = F.size(word_hashes) - size
    windows = F.transform(
        F.array(word_hashes),
        lambda h: F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])),
    )
    return F.when(n >= 0, F.get(windows, F.lit(0))).otherwise(F.array().cast("array<bigint>"))

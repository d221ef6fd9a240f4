"""Keys of joins whose hot partitions AQE can split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def copied(key: Column) -> Column:
    """A computed copy of a join key, as text, for the side that was aggregated by this key.

    AQE splits hot partitions only where each side is shuffled right below the join. A side that was aggregated by
    the key isn't shuffled again; joined on a copy it is, which costs one row per key. Tables need no copy.
    """
    return F.concat(key.cast("string"), F.lit(""))

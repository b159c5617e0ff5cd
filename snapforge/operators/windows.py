"""Window frames over rows of a key by date: row offsets, not calendar days."""

from pyspark.sql import Window, WindowSpec
from pyspark.sql import functions as F


def history(key: str = "uuid", date: str = "snapshot_date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(F.col(date).asc_nulls_first())


def last(n: int, key: str = "uuid", date: str = "snapshot_date") -> WindowSpec:
    return history(key, date).rowsBetween(1 - n, 0)


def so_far(key: str = "uuid", date: str = "snapshot_date") -> WindowSpec:
    return history(key, date).rowsBetween(Window.unboundedPreceding, 0)

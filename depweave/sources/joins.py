"""Tables that are broadcast or shuffled by their number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of some texts are broadcast up to this many, rows of two numbers up to ten times as many; longer tables are shuffled.
BROADCAST_ROWS = 100_000


def to_join(table: DataFrame, most: int | None = None) -> DataFrame:
    """The table as the right side of a join: broadcast where it has few rows, by a sort of both sides where not.

    Left to itself, Spark goes by the size of the files, which hold columns of equal or rising values in far less room
    than the driver needs for the rows.
    """
    return F.broadcast(table) if table.count() <= (BROADCAST_ROWS if most is None else most) else table.hint("merge")

"""3 x 3 neighbourhoods of a dense cell table in two window passes, without a self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OFFSETS = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]


def neighbourhood(cells: DataFrame, value: str, border: str, out: str = "nb") -> DataFrame:
    """Add struct `out` of the fields n0..n8 (row-major) around each cell of `cells` (r, c, value, ...).

    Cells must be dense: nodata cells are rows with a null value. border: `mirror` repeats the cell inside the edge
    (-1 is 1), `edge` the edge itself (-1 is 0). One pass along rows, one along columns; a raster that is one cell
    wide or high falls back to the cell itself.
    """
    across, down = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")

    def sides(v: Column, w) -> tuple[Column, Column]:
        before, after = F.lag(v).over(w), F.lead(v).over(w)
        if border == "mirror":
            return F.coalesce(before, after, v), F.coalesce(after, before, v)
        if border == "edge":
            return F.coalesce(before, v), F.coalesce(after, v)
        raise ValueError(border)

    one = F.struct(F.col(value).alias("v"))  # a null struct is off the grid, a null field is nodata
    left, right = sides(one, across)
    d = cells.withColumn("_left", left).withColumn("_right", right)
    d = d.withColumn("_row", F.struct(F.col("_left.v").alias("a"), F.col(value).alias("b"), F.col("_right.v").alias("c")))
    up, low = sides(F.col("_row"), down)
    d = d.withColumn("_up", up).withColumn("_low", low)
    fields = [F.col(f"{row}.{f}") for row in ("_up", "_row", "_low") for f in "abc"]
    return d.withColumn(out, F.struct(*[x.alias(f"n{i}") for i, x in enumerate(fields)])).drop("_left", "_right", "_row", "_up", "_low")

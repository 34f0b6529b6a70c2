"""Numbers that a drawing of a one-hop graph needs, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Canvas, radii and scales; fixed values.
CENTRE, LEAST_RADIUS, RADIUS_STEP, MOST_RADIUS = (450, 300), 110, 10, 212
SEARCH_HEAD = 8


def radial(nodes: DataFrame) -> DataFrame:
    """x, y of the centre's neighbours on a circle from its top on, in order of name; the centre in the middle."""
    n = F.count_if(~F.col("is_center")).over(Window.partitionBy("novel_id"))
    i = F.row_number().over(Window.partitionBy("novel_id").orderBy("is_center", "name")) - 1
    out = nodes.withColumns({"n": n, "i": i})
    angle = -F.pi() / 2 + 2 * F.pi() * F.col("i") / F.greatest(F.col("n"), F.lit(1))
    radius = F.when(F.col("is_center"), 0).otherwise(F.least(F.lit(MOST_RADIUS), LEAST_RADIUS + RADIUS_STEP * F.col("n")))
    return out.withColumns({"x": F.round(CENTRE[0] + radius * F.cos(angle), 6), "y": F.round(CENTRE[1] + radius * F.sin(angle), 6)}).drop("n", "i")


def node_radius(mention_count: Column) -> Column:
    return F.round(8 + 9 * F.sqrt(mention_count / 982)).cast("int")


def edge_width(weight: Column) -> Column:
    return F.greatest(F.lit(2.2), F.least(F.lit(3.4), 1 + 0.42 * F.log2(weight + 1)))


def confidence_meter(confidence: Column) -> tuple[Column, Column]:
    """Percent, and how many of five lights are on."""
    return F.round(confidence * 100).cast("int"), F.size(F.filter(F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8, 1.0)]), lambda t: confidence >= t - 1e-9))


def job_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100 * done / total)).otherwise(0).cast("int")

"""Field geometry of a batted ball."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published spray-angle transform and the field thirds.
HOME_X = 125.42
HOME_Y = 198.27
SPRAY_SCALE = 0.75
THIRD_DEGREES = 15.0


def spray_angle(x: Column, y: Column) -> Column:
    """Degrees from straightaway center: negative toward left field, positive toward right."""
    across = x.try_cast("double") - HOME_X
    out = F.lit(HOME_Y) - y.try_cast("double")
    return F.atan2(across, out) * (180.0 / math.pi) * SPRAY_SCALE


def batted_direction(x: Column, y: Column, side: Column) -> Column:
    """``center`` within 15 degrees inclusive, else pull or opposite by batting side; else null."""
    angle = spray_angle(x, y)
    toward_pull = F.when(side == "R", -angle).when(side == "L", angle)
    return (
        F.when(toward_pull.isNull(), F.lit(None).cast("string"))
        .when(F.abs(angle) <= THIRD_DEGREES, F.lit("center"))
        .when(toward_pull > 0, F.lit("pull"))
        .otherwise(F.lit("opposite"))
    )


def location_direction(location: Column, side: Column) -> Column:
    """Coarse direction from the code of the fielder who handled the ball and the batting side."""
    location = location.try_cast("double").try_cast("bigint")
    field_side = (
        F.when(location.isin(5, 6, 7), F.lit("left"))
        .when(location.isin(3, 4, 9), F.lit("right"))
        .when(location.isin(1, 2, 8), F.lit("center"))
    )
    return (
        F.when(field_side.isNull() | ~F.coalesce(side.isin("L", "R"), F.lit(False)), F.lit(None).cast("string"))
        .when(field_side == "center", F.lit("center"))
        .when((field_side == "left") == (side == "R"), F.lit("pull"))
        .otherwise(F.lit("opposite"))
    )

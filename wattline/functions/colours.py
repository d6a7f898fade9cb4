"""Group colours and axis tags (PRJ-11, PRJ-12, JN-03)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chart colour per production group, and the fallback colour.
GROUP_COLOURS = {
    "hydro": "#1f77b4",
    "wind": "#17becf",
    "thermal": "#7f7f7f",
    "solar": "#e377c2",
    "other": "#2ca02c",
}
DEFAULT_COLOUR = "#AAAAAA"
DOMINANT_GROUP = "hydro"
PRODUCTION_GROUPS = ["hydro", "wind", "thermal", "solar", "other"]
PRICE_AREAS = ["NO1", "NO2", "NO3", "NO4", "NO5"]


def colour_of(group: Column) -> Column:
    """Colour for a group; unknown or NULL groups get the default.

    A map literal is a constant folded into the projection: no join and no
    broadcast that could grow with the data.
    """
    lookup = F.create_map(*[x for k, v in GROUP_COLOURS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(lookup, group), F.lit(DEFAULT_COLOUR))


def axis_of(group: Column, dominant: str = DOMINANT_GROUP) -> Column:
    """``primary`` for the dominant group, ``secondary`` for the rest."""
    return F.when(group == F.lit(dominant), F.lit("primary")).otherwise(F.lit("secondary"))

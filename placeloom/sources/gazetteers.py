"""Static gazetteers as tables: states, area codes and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.functions import text


def states(spark: SparkSession) -> DataFrame:
    """(code, state): two-letter codes and names in small letters; some fifty rows."""
    return spark.createDataFrame([(c, n) for n, c in text.STATES.items()], "code string, state string")


def area_states(rows: DataFrame, phone: str = "phone", state: str = "state") -> DataFrame:
    """(area, home): the state in which most numbers of an area code stand, learnt from ``rows``; ties by the later code.

    Where a numbering plan's table (area, home) is at hand, pass it to the operators in place of this one.
    """
    r = rows.select(F.left(text.last_ten_digits(F.col(phone)), F.lit(3)).alias("area"), text.state_code(F.col(state)).alias("st")).where("area IS NOT NULL AND st IS NOT NULL")
    return r.groupBy("area", "st").count().groupBy("area").agg(F.max_by("st", F.struct("count", "st")).alias("home"))


def nearest_known(lat: Column, lng: Column, places: Column) -> Column:
    """The entry of a short array of struct(name, lat, lng) that is nearest by degrees."""
    d = F.transform(places, lambda p: F.struct((F.pow(p["lat"] - lat, 2) + F.pow(p["lng"] - lng, 2)).alias("d"), p["name"].alias("name")))
    return F.array_min(d)["name"]

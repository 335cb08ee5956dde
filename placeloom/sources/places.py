"""The outside directory: its nested release, the flat extract made of it, and a scan of a box of the extract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def nested(flat: DataFrame) -> DataFrame:
    """Flat rows in the release's nested layout."""
    c = F.col
    return flat.select(
        "id", F.struct(c("name").alias("primary")).alias("names"), c("category").alias("basic_category"), "confidence", "operating_status", "websites", "phones", "socials",
        F.array(F.struct(c("street").alias("freeform"), c("city").alias("locality"), "region", "postcode")).alias("addresses"),
        F.struct(c("lng").alias("xmin"), c("lng").alias("xmax"), c("lat").alias("ymin"), c("lat").alias("ymax")).alias("bbox"),
        F.transform(F.coalesce("datasets", F.array().cast("array<string>")), lambda x: F.struct(x.alias("dataset"))).alias("sources"))


def flattened(release: DataFrame) -> DataFrame:
    """The extract: first address, middle of the box, distinct datasets. Only the nested fields used are read."""
    c, a = F.col, F.try_element_at("addresses", F.lit(1))
    return release.select(
        "id", c("names.primary").alias("name"), c("basic_category").alias("category"), "confidence", "operating_status", "websites", "phones", "socials", a["freeform"].alias("street"), a["locality"].alias("city"), a["region"].alias("region"), a["postcode"].alias("postcode"),
        ((c("bbox.ymin") + c("bbox.ymax")) / 2).alias("lat"), ((c("bbox.xmin") + c("bbox.xmax")) / 2).alias("lng"), F.array_distinct(F.transform("sources", lambda s: s["dataset"])).alias("datasets"))


def write_extract(places: DataFrame, path: str) -> None:
    """Range-partitioned and sorted by position, so that row groups of a box can be skipped; the committer makes it atomic."""
    places.repartitionByRange("lat", "lng").sortWithinPartitions("lat", "lng").write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_box(spark: SparkSession, path: str, south: float, north: float, west: float, east: float) -> DataFrame:
    return spark.read.parquet(path).where(F.col("lat").between(south, north) & F.col("lng").between(west, east))

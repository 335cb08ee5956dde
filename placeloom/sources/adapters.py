"""JSON sources of live records: each adapter maps its own layout to one typed venue record.

Payloads are columns of JSON documents (files or cached responses); fetching is not part of the engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VENUE = ["source", "ord", "name", "address", "city", "state", "postal_code", "phone", "website_url", "lat", "lng", "place_types"]


def venue(source: str, **cols: Column) -> list[Column]:
    kinds = {"lat": "double", "lng": "double", "ord": "long", "place_types": "array<string>"}
    cols = {"source": F.lit(source), **cols}
    return [cols.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in VENUE]


def exploded(docs: DataFrame, payload: str, path: str, item: str) -> DataFrame:
    """One row per record of a JSON list below ``path``, with its place in the list as ``ord``; bad documents give none."""
    src = F.get_json_object(payload, path) if path else F.col(payload)
    return docs.select(F.posexplode(F.from_json(src, f"array<{item}>")).alias("ord", "v"))


def directory(docs: DataFrame, payload: str) -> DataFrame:
    """Business directory: {"results": [{name, address, city, state, zip, phone, website, latitude, longitude, categories}]}"""
    v = exploded(docs, payload, "$.results", "struct<name:string,address:string,city:string,state:string,zip:string,phone:string,website:string,latitude:string,longitude:string,categories:array<string>>")
    c = lambda x: F.col(f"v.{x}")
    return v.select(*venue("bizdata", ord=F.col("ord"), name=c("name"), address=c("address"), city=c("city"), state=c("state"), postal_code=c("zip"), phone=c("phone"), website_url=c("website"), lat=F.expr("try_cast(v.latitude AS double)"), lng=F.expr("try_cast(v.longitude AS double)"), place_types=c("categories")))


def map_elements(docs: DataFrame, payload: str) -> DataFrame:
    """Map data: {"elements": [{lat, lon, center: {lat, lon}, tags: {...}}]}; ways and relations carry a center."""
    v = exploded(docs, payload, "$.elements", "struct<lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>")
    t = lambda k: F.try_element_at("v.tags", F.lit(k))
    return v.select(*venue("overpass", ord=F.col("ord"), name=t("name"), address=F.nullif(F.concat_ws(" ", t("addr:housenumber"), t("addr:street")), F.lit("")), city=t("addr:city"), state=t("addr:state"), postal_code=t("addr:postcode"), phone=F.coalesce(t("phone"), t("contact:phone")), website_url=F.coalesce(t("website"), t("contact:website")), lat=F.coalesce("v.lat", "v.center.lat"), lng=F.coalesce("v.lon", "v.center.lon"), place_types=F.transform(F.split(t("cuisine"), ";"), lambda x: F.trim(x))))


def map_search(docs: DataFrame, payload: str) -> DataFrame:
    """Map search: {"local_results": [{title, address, phone, website, gps_coordinates, type | types | type_ids}]}"""
    v = exploded(docs, payload, "$.local_results", "struct<title:string,address:string,phone:string,website:string,gps_coordinates:struct<latitude:double,longitude:double>,type:string,types:array<string>,type_ids:array<string>>")
    none = F.array().cast("array<string>")
    kinds = F.array_union(F.array_union(F.array_compact(F.array("v.type")), F.coalesce("v.types", none)), F.coalesce("v.type_ids", none))
    return v.select(*venue("serpapi", ord=F.col("ord"), name=F.col("v.title"), address=F.col("v.address"), phone=F.col("v.phone"), website_url=F.col("v.website"), lat=F.col("v.gps_coordinates.latitude"), lng=F.col("v.gps_coordinates.longitude"), place_types=kinds))


def open_data(docs: DataFrame, payload: str) -> DataFrame:
    """Open data rows: aliases of one field are coalesced, coordinates may be nested."""
    v = exploded(docs, payload, "", "struct<name:string,business_name:string,dba:string,address:string,street_address:string,city:string,state:string,zip:string,zip_code:string,phone:string,latitude:string,longitude:string,location:struct<latitude:string,longitude:string>>")
    c = lambda *x: F.coalesce(*[F.nullif(F.col(f"v.{k}"), F.lit("")) for k in x])
    number = lambda x: x.try_cast("double")
    return v.select(*venue("socrata", ord=F.col("ord"), name=c("dba", "business_name", "name"), address=c("address", "street_address"), city=c("city"), state=c("state"), postal_code=c("zip", "zip_code"), phone=c("phone"), lat=number(c("latitude", "location.latitude")), lng=number(c("longitude", "location.longitude"))))


def geojson(docs: DataFrame, payload: str) -> DataFrame:
    """GeoJSON features; coordinates are longitude first."""
    v = exploded(docs, payload, "$.features", "struct<geometry:struct<coordinates:array<double>>,properties:map<string,string>>")
    p = lambda k: F.try_element_at("v.properties", F.lit(k))
    xy = lambda i: F.try_element_at("v.geometry.coordinates", F.lit(i))
    return v.select(*venue("photon", ord=F.col("ord"), name=p("name"), address=F.nullif(F.concat_ws(" ", p("housenumber"), p("street")), F.lit("")), city=p("city"), state=p("state"), postal_code=p("postcode"), lat=xy(2), lng=xy(1)))


def knowledge_base(docs: DataFrame, payload: str) -> DataFrame:
    """Query-service bindings with points as text: Point(longitude latitude)."""
    v = exploded(docs, payload, "$.results.bindings", "struct<label:struct<value:string>,coord:struct<value:string>>")
    n = lambda i: F.nullif(F.regexp_extract("v.coord.value", r"Point\((-?[\d.]+) (-?[\d.]+)\)", i), F.lit("")).try_cast("double")
    return v.select(*venue("wikidata", ord=F.col("ord"), name=F.col("v.label.value"), lat=n(2), lng=n(1)))


def whole(c: Column) -> Column:
    return F.round(c).cast("long").cast("string")


def overpass_request(lat: Column, lng: Column, radius_km: Column) -> Column:
    """The query for restaurants around a point: nodes, ways and relations with their centers."""
    return F.concat(F.lit('[out:json];nwr["amenity"="restaurant"](around:'), whole(radius_km * 1000), F.lit(","), F.format_string("%.6f", lat), F.lit(","), F.format_string("%.6f", lng), F.lit(");out center;"))


def soda_circle(lat: Column, lng: Column, radius_km: Column) -> Column:
    """The where-clause of an open-data request around a point."""
    return F.concat(F.lit("within_circle(location, "), F.format_string("%.6f", lat), F.lit(", "), F.format_string("%.6f", lng), F.lit(", "), whole(radius_km * 1000), F.lit(")"))


def box_of(lat: Column, lng: Column, radius_km: Column) -> Column:
    """west,south,east,north of the box around a circle, for text search and box queries."""
    up, side = radius_km / 111.32, radius_km / 111.32 / F.cos(F.radians(lat))
    return F.concat_ws(",", *[F.format_string("%.4f", x) for x in (lng - side, lat - up, lng + side, lat + up)])


ADAPTERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {"bizdata": directory, "overpass": map_elements, "serpapi": map_search, "socrata": open_data, "photon": geojson, "wikidata": knowledge_base}


def union_in_order(parts: list[DataFrame]) -> DataFrame:
    """Sources one after another: ``ord`` counts on from source to source without counting rows."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("ord", F.col("ord") + F.lit(i) * (1 << 40))
        out = p if out is None else out.unionByName(p)
    return out

"""Sources: feature collections, XML documents, configuration files, tables; explicit schemas only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FEATURES = "type string, features array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"


def features(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """region, layer, pos, kind, coordinates (JSON text), properties of every feature of the named files.

    The file's name gives region and layer (``{region}_{layer}.geojson``); a file holds one document,
    so files are the unit of parallelism.  Coordinates stay text: their depth differs by kind.
    """
    raw = spark.read.schema(FEATURES).option("multiLine", True).json(paths).withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), "^(.*)\\.(geo)?json$", 1))
    each = raw.select("file", F.posexplode("features").alias("pos", "f"))
    return each.select(F.regexp_extract("file", "^(.*)_([a-z]+)$", 1).alias("region"), F.regexp_extract("file", "^(.*)_([a-z]+)$", 2).alias("layer"), "pos", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def points(df: DataFrame) -> DataFrame:
    """Adds ``coords``, the vertices as (lat, lon): of a point, a line, or a polygon's outer ring."""
    pair = lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon"))  # noqa: E731  files hold (lon, lat)
    point = F.array(pair(F.from_json("coordinates", "array<double>")))
    line = F.transform(F.from_json("coordinates", "array<array<double>>"), pair)
    ring = F.transform(F.from_json("coordinates", "array<array<array<double>>>")[0], pair)
    return df.withColumn("coords", F.when(F.col("kind") == "Point", point).when(F.col("kind") == "LineString", line).when(F.col("kind") == "Polygon", ring))


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Elements of an XML document as rows; attributes are columns with a leading underscore."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def interconnections(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A configured list of links; missing fields, equal ends and non-positive capacities raise."""
    need = ("id", "from_region", "to_region", "capacity_mw")
    for r in rows:
        if lack := [k for k in need if r.get(k) in (None, "")]:
            raise ValueError(f"interconnection without {lack}")
        if r["from_region"] == r["to_region"] or not float(r["capacity_mw"]) > 0:
            raise ValueError(f"interconnection {r['id']} is not valid")
    kept = [(str(r["id"]), str(r["from_region"]), str(r["to_region"]), float(r["capacity_mw"]), str(r.get("type", "AC"))) for r in rows]
    return spark.createDataFrame(kept, "id string, from_region string, to_region string, capacity_mw double, type string")


def cached_lookup(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Joins (lat, lon) to a cache keyed by both with six decimals, as text."""
    return df.withColumn("key", F.format_string("%.6f,%.6f", "lat", "lon")).join(cache, "key", "left")


def feature_lines(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Files of one GeoJSON feature a line: the properties of the given schema, and ``coords``."""
    schema = f"geometry string, properties struct<{properties}>"
    raw = spark.read.schema(schema).json(path)
    parts = raw.select(F.get_json_object("geometry", "$.type").alias("kind"), F.get_json_object("geometry", "$.coordinates").alias("coordinates"), "properties.*")
    return points(parts).drop("kind", "coordinates")


def elements(df: DataFrame) -> DataFrame:
    """Map elements (type, id, lat, lon, center, tags) as plants: nodes by their place, others by their centre.

    Elements without both coordinates go.  Of several tags the first that is set counts, empty or not;
    without any the text is empty.
    """
    tag = lambda *names: F.coalesce(*(F.col("tags")[n] for n in names), F.lit(""))
    place = lambda c: F.round(F.when(F.col("type") == "node", F.col(c)).otherwise(F.col(f"center.{c}")), 6)
    name = tag("name", "name:ja", "name:en")
    rows = df.select(
        F.col("id").alias("osm_id"), F.col("type").alias("osm_type"), place("lon").alias("lon"), place("lat").alias("lat"), name.alias("name"),
        tag("plant:source", "generator:source", "source").alias("source"), tag("plant:output:electricity", "generator:output:electricity").alias("output"),
        tag("operator").alias("operator"), tag("voltage").alias("voltage"),
        F.when(name == "", F.concat(F.lit("plant_"), F.col("id").cast("string"))).otherwise(name).alias("display_name"),
    )
    return rows.where("lon IS NOT NULL AND lat IS NOT NULL")


def gml_plants(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """Plants of a GML document: elements of each kind joined to the points they refer to.

    ``kinds`` maps element names to fuels.  A point needs an id and exactly two numbers; plants whose
    reference meets no point go; a capacity that is no number is null.
    """
    pair = F.split(F.trim("`gml:pos`"), r"\s+")
    xy = xml_rows(spark, path, "gml:Point", "`_gml:id` string, `gml:pos` string").where(F.size(pair) == 2)
    xy = xy.select(F.col("_gml:id").alias("ref"), pair[0].try_cast("double").alias("lat"), pair[1].try_cast("double").alias("lon")).where("ref IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    fields = "`_gml:id` string, `ksj:position` struct<_VALUE:string,`_xlink:href`:string>, `ksj:nameOfPlant` string, `ksj:nameOfOwner` string, `ksj:generatingPower` string, `ksj:burningType` string"
    text = lambda c: F.trim(F.coalesce(F.col(f"ksj:{c}"), F.lit("")))
    found = None
    for kind, fuel in kinds.items():
        one = xml_rows(spark, path, f"ksj:{kind}", fields).select(
            F.col("_gml:id").alias("plant_id"), F.regexp_replace(F.col("ksj:position")["_xlink:href"], "^#+", "").alias("ref"), text("nameOfPlant").alias("name"), text("nameOfOwner").alias("owner"),
            text("generatingPower").try_cast("double").alias("mw"), text("burningType").alias("burning"), F.lit(fuel).alias("fuel"),
        )
        found = one if found is None else found.unionByName(one)
    return found.join(xy, "ref").drop("ref")

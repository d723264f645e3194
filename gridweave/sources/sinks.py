"""Sinks: feature lines, CSV, tiers, reports, versioned stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_features(df: DataFrame, path: str, coords: str = "coords") -> None:
    """One GeoJSON feature a line: points or lines from ``coords``, all other columns as properties."""
    xy = F.transform(coords, lambda p: F.array(p["lon"], p["lat"]))
    one = F.size(coords) == 1
    shape = F.when(one, F.to_json(F.struct(F.lit("Point").alias("type"), xy[0].alias("coordinates")))).otherwise(F.to_json(F.struct(F.lit("LineString").alias("type"), xy.alias("coordinates"))))
    rest = F.to_json(F.struct(*[c for c in df.columns if c != coords]))
    df.select(F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), rest, F.lit("}")).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV with a header, columns sorted, those with a leading underscore left out; quotes inside are doubled."""
    df.select(*(f"`{c}`" for c in sorted(df.columns) if not c.startswith("_"))).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_tiers(df: DataFrame, path: str, kv: str = "kv") -> None:
    """Materialises every row under each tier it belongs to: all, from 154 kV, from 275 kV."""
    tiers = F.array_compact(F.array(F.lit("all"), F.when(F.col(kv) >= 154, "154"), F.when(F.col(kv) >= 275, "275")))
    df.withColumn("tier", F.explode(tiers)).write.mode("overwrite").partitionBy("tier").parquet(path)


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows, filled: how many rows each table has and whether it has any."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), (F.count("*") > 0).alias("filled"))
        out = one if out is None else out.union(one)
    return out


class Store:
    """Attribute tables as numbered Parquet versions; readers of a version are never disturbed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self, table: str) -> list[int]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        fs = at.getFileSystem(conf)
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        done = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        have = self.versions(table)
        if not have:
            raise KeyError(f"no table {table}")
        return self.spark.read.parquet(f"{self.path}/{table}/v={have[-1] if version is None else version}")

    def write(self, table: str, df: DataFrame) -> int:
        new = (self.versions(table) or [0])[-1] + 1
        df.write.parquet(f"{self.path}/{table}/v={new}")
        return new

    def add_column(self, table: str, name: str, kind: str) -> int:
        """A migration: the next version has one more column, null everywhere."""
        now = self.read(table)
        if name in now.columns:
            return self.versions(table)[-1]
        return self.write(table, now.withColumn(name, F.lit(None).cast(kind)))

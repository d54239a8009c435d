"""Readers and writers: CSV, JSON lines, word lists, the catalog, keyed Parquet tables, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import strings as X
from ..plans.dialect import SPARK

CITY_COLUMNS = ("city", "city_ascii", "state_id", "state_name", "county_fips", "county_name", "lat", "lng", "population", "density", "timezone", "zips", "ranking", "source", "military", "incorporated")
LOG_SCHEMA = "timestamp string, worker_id string, event_type string, target_id long, page_number int, accepted_count int, raw_count int"


def exists(spark: SparkSession, path: str) -> bool:
    """By Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header row, every field a string."""
    return spark.read.csv(path, header=True, schema=T.StructType([T.StructField(c, T.StringType()) for c in CITY_COLUMNS]), enforceSchema=False)


def city_registry(cities: DataFrame, p90: int = 100_000, p50: int = 10_000) -> DataFrame:
    """Typed rows: bad numbers become null, rows without coordinates go; slugs that clash get the county, then a count, in the order of city, state and county."""
    number = lambda c, t: F.expr(f"try_cast(nullif(trim({c}), '') AS {t})")
    rows = cities.withColumns({"population": number("population", "int"), "density": number("density", "double"), "lat": number("lat", "double"), "lng": number("lng", "double"), "ranking": number("ranking", "int")})
    rows = rows.where("lat IS NOT NULL AND lng IS NOT NULL")
    rows = rows.withColumns({"slug": F.expr(X.city_slug(SPARK, "city", "state_id")), "geo": F.expr(X.geo("city", "state_id")), "military": F.upper(F.trim("military")) == "TRUE", "tier": F.when(F.col("population") >= p90, 1).when(F.col("population") >= p50, 2).otherwise(3)})
    order = W.partitionBy("slug").orderBy("city", "state_id", "county_name", "lat", "lng")
    rows = rows.withColumn("nth", F.row_number().over(order))
    county = F.regexp_replace(F.lower(F.trim("county_name")), " ", "-")
    rows = rows.withColumn("slug", F.when((F.col("nth") > 1) & (F.coalesce(county, F.lit("")) != ""), F.concat("slug", F.lit("-"), county)).otherwise(F.col("slug")))
    again = F.row_number().over(W.partitionBy("slug").orderBy("nth", "city", "state_id", "county_name", "lat", "lng"))
    rows = rows.withColumn("again", again)
    return rows.withColumn("slug", F.when(F.col("again") > 1, F.concat("slug", F.lit("-"), F.col("again").cast("string"))).otherwise(F.col("slug"))).drop("nth", "again")


def first_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-or-ignore: the first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="label string, slug string").select(F.trim("label").alias("label"), F.trim("slug").alias("slug"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A list of words, one a line, as distinct lower-case rows; a missing file gives none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "word string")
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events, one JSON object a line; broken lines are left out."""
    return spark.read.schema(LOG_SCHEMA).json(path, mode="DROPMALFORMED")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records, one JSON object a line; a broken line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_chat(rows: DataFrame, path: str, system: str) -> None:
    """instruction and output columns as chat messages."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    write_jsonl(rows.select(F.array(message("system", F.lit(system)), message("user", F.col("instruction")), message("assistant", F.col("output"))).alias("messages")), path)


def write_instructions(rows: DataFrame, path: str) -> None:
    write_jsonl(rows.select("instruction", F.coalesce("input", F.lit("")).alias("input"), "output"), path)


def tables(spark: SparkSession) -> DataFrame:
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, kind string, temporary boolean")


def columns(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "name string, type string, nullable boolean")


def search_rows(df: DataFrame, term: str, key: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows in which any column's text has the term, in the order of a key, a page of them."""
    hit = F.lit(False)
    for f in df.schema.fields:
        hit |= F.coalesce(F.col(f.name).cast("string").ilike(f"%{term}%"), F.lit(False))
    return df.where(hit).orderBy(key).offset(offset).limit(limit)


def put_pages(spark: SparkSession, new: DataFrame, path: str) -> None:
    """A cache of pages by the hash of their URL: appended with the time, so the latest of a hash counts."""
    new.select(F.sha2("url", 256).alias("hash"), "url", "html", "at").write.mode("append").parquet(path)


def get_pages(spark: SparkSession, path: str, now: str, hours: int) -> DataFrame:
    rows = spark.read.parquet(path).where(F.col("at") >= F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {int(hours)} HOURS"))
    return first_by_key(rows, ["hash"], [F.desc("at")])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new over rows of old, by key, where new's values aren't null; other rows stay."""
    o, n = old.alias("o"), new.alias("n")
    columns_ = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in old.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*columns_)


def parametrised(spark: SparkSession, sql: str, **values) -> DataFrame:
    """SQL with named parameters, bound and never spliced."""
    return spark.sql(sql, args=values)

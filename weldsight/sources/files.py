"""Batch readers with explicit schemas."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Readings of a request at most.
LONGEST = 1200
SENSORS = [f"c{i}" for i in range(1, 20)]
RAW_SCHEMA = T.StructType([T.StructField("time", T.StringType()), *[T.StructField(c, T.StringType() if c == "c10" else T.DoubleType()) for c in SENSORS], T.StructField("error", T.StringType())])
READING = T.StructType([*RAW_SCHEMA.fields])
REQUEST_SCHEMA = T.StructType([T.StructField("gun_id", T.StringType()), T.StructField("readings", T.ArrayType(READING))])


def with_file_parts(df: DataFrame, path) -> DataFrame:
    """file, class and gun from names like E01_0; a name without a class code has none."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)
    cls = F.regexp_extract("file", r"^(E\d{2})_", 1)
    return df.withColumn("file", name).withColumn("class", F.when(cls != "", cls)).withColumn("gun", F.regexp_extract("file", r"_(\d+)$", 1).try_cast("int"))


def read_machine_csv(spark: SparkSession, path: str) -> DataFrame:
    """One file for each machine; the schema is fixed and nothing is inferred."""
    rows = spark.read.schema(RAW_SCHEMA).option("header", True).csv(path)
    return with_file_parts(rows.withColumn("_path", F.col("_metadata.file_path")), F.col("_path")).drop("_path")


def read_preprocessed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parse_switch(column: str):
    """c10 as a boolean: true/false, 1/0, on/off in any case and spacing; anything else is null."""
    text = F.lower(F.trim(F.col(column).cast("string")))
    return F.when(text.isin("on", "true", "1", "1.0"), True).when(text.isin("off", "false", "0", "0.0"), False)


def parse_time(column: str):
    """Naive UTC; a time without an offset is UTC."""
    return F.to_timestamp(F.col(column)).cast("timestamp_ntz")


def validated(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) readings: time and switch parse, counters are not negative, the code is 0 or E and digits."""
    typed = readings.withColumn("_c10", parse_switch("c10")).withColumn("_time", F.expr("try_to_timestamp(time)").cast("timestamp_ntz"))
    code = F.coalesce(F.col("error"), F.lit("0"))
    good = F.coalesce(F.col("_time").isNotNull() & F.col("_c10").isNotNull() & (F.col("c11") >= 0) & (F.col("c12") >= 0) & code.rlike(r"^(0|E\d{3})$"), F.lit(False))
    valid = typed.filter(good).withColumn("time", F.col("_time")).withColumn("c10", F.col("_c10")).withColumn("error", code).drop("_c10", "_time")
    return valid, typed.filter(~good).drop("_c10", "_time")


def _request_problem():
    """Why a request is refused, or null."""
    n = F.coalesce(F.size("readings"), F.lit(0))
    return F.when(~F.coalesce(F.length("gun_id").between(1, 64), F.lit(False)), "gun_id needs 1 to 64 characters").when(n < 1, "no readings").when(n > LONGEST, F.concat(n.cast("string"), F.lit(f" readings, {LONGEST} at most")))


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Readings of JSON requests {gun_id, readings}: one row each, in arrival order within a request."""
    rows = (spark.readStream if stream else spark.read).schema(REQUEST_SCHEMA).json(path)
    return rows.filter(_request_problem().isNull()).select("gun_id", F.posexplode("readings").alias("arrival", "r")).select("gun_id", "arrival", "r.*")


def refused_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The requests that ``read_requests`` leaves out, with the reason: gun_id, n_readings, problem. Lines that are no JSON
    have neither gun nor readings."""
    rows = (spark.readStream if stream else spark.read).schema(REQUEST_SCHEMA).json(path).withColumn("problem", _request_problem())
    return rows.filter("problem IS NOT NULL").select("gun_id", F.greatest(F.size("readings"), F.lit(0)).alias("n_readings"), "problem")


def read_matrix(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """Lines of numbers with commas: file, row, column, value; rows are numbered from 0 in each file, and only those from
    ``first`` up to before ``last`` are given. Empty lines are no rows."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")).filter(F.trim("value") != "")
    numbered = lines.withColumn("row", F.row_number().over(Window.partitionBy("file").orderBy("_block", "_id")) - 1)
    rows = numbered.filter((F.col("row") >= first) & (F.lit(True) if last is None else F.col("row") < last))
    return rows.select("file", "row", F.posexplode(F.split(F.trim("value"), r",\s*")).alias("column", "cell")).select("file", "row", "column", F.col("cell").cast("double").alias("value"))


def read_folder(spark: SparkSession, path: str, columns: dict[str, str], pattern: str = "*.csv") -> DataFrame:
    """All CSV files below a folder at any depth, one after the other, with the file's name. ``columns`` (name to type) are
    found by the names in each file's own header: files may order them otherwise, lack some (null) or have more. Headers are
    read in a pass of their own."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    heads = raw.withColumn("file", F.col("_metadata.file_path")).filter(F.col("_metadata.file_block_start") == 0).withColumn("_id", F.monotonically_increasing_id())
    orders = [(r.head, r.files) for r in heads.groupBy("file").agg(F.min_by("value", "_id").alias("head")).groupBy("head").agg(F.collect_list("file").alias("files")).collect()]  # a name for each file
    parts = []
    for head, files in orders:
        names = [n.strip() for n in head.split(",")]
        rows = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("header", True).csv([unquote(f) for f in files])
        parts.append(rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), *[(F.col(f"`{c}`") if c in names else F.lit(None)).try_cast(kind).alias(c) for c, kind in columns.items()]))
    empty = spark.createDataFrame([], T.StructType([T.StructField("file", T.StringType())])).select("file", *[F.lit(None).cast(k).alias(c) for c, k in columns.items()])
    for p in parts:
        empty = empty.unionByName(p)
    return empty


def read_log_values(spark: SparkSession, path: str, marker: str = "-") -> DataFrame:
    """The value of each ``key = value`` line; lines that begin with the marker are skipped."""
    lines = spark.read.text(path).filter(~F.col("value").startswith(marker) & F.col("value").contains("="))
    return lines.select(F.trim(F.substring_index("value", "=", 1)).alias("key"), F.trim(F.substring_index("value", "=", -1)).cast("double").alias("value"))

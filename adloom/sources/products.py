"""Product catalogs: reading, cleaning and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom import schemas
from adloom.functions import urls
from adloom.functions.text import blank_to_null, strip


def read_products(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Products with trimmed text fields; the schema is given, so files are never sampled."""
    reader = spark.read.schema("product_id long, " + schemas.PRODUCT)
    return trim_fields(reader.options(**options).format(fmt).load(path))


def trim_fields(df: DataFrame) -> DataFrame:
    """Trim the text fields a form would trim; absent ones become empty."""
    typed = ["name", "description", "source_url", "price", "audience_hint"]
    return df.withColumns({c: F.coalesce(strip(F.col(c)), F.lit("")) for c in typed if c in df.columns})


def with_final_name(df: DataFrame) -> DataFrame:
    """Name as typed, else guessed from the URL; a reason where neither gives one."""
    guess = F.nullif(urls.guess_name(F.col("source_url")), F.lit(""))
    named = df.withColumn("name", F.coalesce(blank_to_null(F.col("name")), guess))
    return named.withColumn("reject_reason", F.when(F.col("name").isNull(), "missing_name"))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = with_final_name(df)
    return (checked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            checked.filter(F.col("reject_reason").isNotNull()))


def with_source_type(df: DataFrame) -> DataFrame:
    has_image = F.coalesce(F.col("image_data_url"), F.lit("")) != ""
    return df.withColumn("source_type", urls.source_type_with_image(F.col("source_url"), has_image))

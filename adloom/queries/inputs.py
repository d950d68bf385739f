"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def product_urls(part: DataFrame) -> DataFrame:
    """Parts with a source URL on one of several hosts; one in seven is empty and one malformed."""
    k = F.col("p_partkey")
    host = F.element_at(F.array(*[F.lit(x) for x in [
        "https://www.aliexpress.com", "https://www.amazon.com", "https://shop.tiktok.com", "https://demo.myshopify.com",
        "https://www.tienda-uno.es"]]), (k % 7 + 1).cast("int"))
    path = F.concat(F.lit("/products/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.lower("p_type"), F.lit("-"),
                    F.lpad(k.cast("string"), 7, "0"), F.lit(".html"))
    url = F.when(k % 7 == 5, "").when(k % 7 == 6, F.concat(F.lit("http//roto "), F.col("p_name"))).otherwise(F.concat(host, path))
    return part.withColumn("source_url", url)


def products(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog in product shape."""
    k = F.col("p_partkey")
    return product_urls(table(spark, sf, "part")).select(
        k.alias("product_id"), F.col("p_name").alias("name"),
        F.concat(F.lower("p_type"), F.lit(" "), F.col("p_brand")).alias("description"), "source_url",
        F.concat(F.lit("USD "), F.col("p_retailprice").cast("decimal(12,2)").cast("string")).alias("price"),
        F.when(k % 5 == 0, "data:image/png").alias("image_data_url"),
        F.when(k % 3 == 0, F.col("p_brand")).otherwise("").alias("audience_hint"),
        F.when(k % 10 == 0, "hogar").when(k % 10 == 1, "desconocida").otherwise("").alias("category_id"),
    )

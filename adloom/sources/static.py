"""Static tables: small, bounded by the code that defines them, and safe to broadcast."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from adloom import schemas
from adloom.knowledge import subscriptions
from adloom.knowledge.categories import BUILTIN, Category, as_rows, check_size

MAX_STATIC_ROWS = 100_000


def static_table(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """Local relation from dicts or tuples; refuses anything that is not small."""
    if len(rows) > MAX_STATIC_ROWS:
        raise ValueError(f"{len(rows)} rows are too many for a static table; read them as a DataFrame")
    schema = T.StructType.fromDDL(ddl)
    dicts = [r if isinstance(r, dict) else dict(zip(schema.fieldNames(), r)) for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(dicts, schema=to_arrow_schema(schema)), schema)


def load_kb(spark: SparkSession, categories: list[Category] = BUILTIN) -> DataFrame:
    check_size(categories)
    return static_table(spark, as_rows(categories), schemas.CATEGORY)


def kb_values(kb: DataFrame, field: str) -> DataFrame:
    """One row per element of a list field: keywords, benefits, desires, fears, secondary_problems."""
    return kb.select(F.col("id").alias("category_id"), F.posexplode(field).alias("pos", "value"))


def kb_audiences(kb: DataFrame) -> DataFrame:
    return kb.select(F.col("id").alias("category_id"), F.posexplode("audiences").alias("pos", "a")).select(
        "category_id", "pos", "a.name", "a.description", "a.pains")


def category_pains(kb: DataFrame) -> DataFrame:
    """All pains of all audiences of a category, in order."""
    pains = F.flatten(F.transform("audiences", lambda a: a["pains"]))
    return kb.select(F.col("id").alias("category_id"), F.posexplode(pains).alias("pos", "pain"))


def load_plans(spark: SparkSession) -> DataFrame:
    rows = [(*p, [{"text": t, "included": i} for t, i in subscriptions.FEATURES[p[0]]]) for p in subscriptions.PLANS]
    return static_table(spark, rows, "plan_id string, plan_name string, price int, credits int, campaign_limit int, "
                                     "rank int, features array<struct<text: string, included: boolean>>")


def load_modules(spark: SparkSession) -> DataFrame:
    rows = [(i, *m) for i, m in enumerate(subscriptions.MODULES)]
    return static_table(spark, rows, "ord int, module_id string, module_name string, module_group string, min_plan string")


def load_costs(spark: SparkSession) -> DataFrame:
    return static_table(spark, list(subscriptions.ACTION_COSTS.items()), "action string, cost int")


def plan_modules(spark: SparkSession) -> DataFrame:
    return static_table(spark, subscriptions.PLAN_MODULES,
                        "plan_id string, ord int, module_id string, module_name string, module_group string, min_plan string")


def plan_locked(spark: SparkSession) -> DataFrame:
    return static_table(spark, subscriptions.PLAN_LOCKED,
                        "plan_id string, module_id string, module_name string, required_plan string, required_price int")

"""Scored product rows: the shared input of every creative module."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.functions import scoring
from adloom.functions.numbers import money
from adloom.functions.seeded import sampled, seed_of, seeded_pick
from adloom.functions.text import encode_component, name_or_default, short_name
from adloom.knowledge import templates
from adloom.knowledge.categories import BUILTIN, Category
from adloom.operators.classify import category_lookup, resolve_category
from adloom.operators.spreading import spread
from adloom.sources.static import load_kb

RATINGS = ["saturation", "visual_appeal", "explainability", "ugc_fit", "price_lo", "price_hi"]


def with_campaign_id(df: DataFrame) -> DataFrame:
    """Repeatable id; the product id keeps copies of one listing apart."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("product_id", "name", "source_url")]
    return df.withColumn("campaign_id", F.concat(F.lit("cmp_"), F.sha2(F.concat_ws("|", *parts), 256)))


def with_category(products: DataFrame, categories: list[Category] = BUILTIN) -> DataFrame:
    """Products with campaign id, seed and all fields of their category."""
    named = (products if "campaign_id" in products.columns else with_campaign_id(products)).withColumn("seed", seed_of(F.col("name"), F.col("source_url")))
    resolved = resolve_category(named, categories)
    kb = load_kb(products.sparkSession, categories).drop("keywords", "visual_hooks", "ord").withColumnRenamed("name", "kb_name")
    return category_lookup(resolved, kb)


def with_scores(df: DataFrame) -> DataFrame:
    """Add ratings-based scores, prices and the viral prediction."""
    c = F.col
    return (
        df.withColumns({
            "content_ideas": scoring.content_ideas(c("visual_appeal")),
            "viral_potential": scoring.viral_potential(c("visual_appeal"), c("explainability"), c("ugc_fit"), c("saturation"), c("seed")),
            "recommended_price": scoring.recommended_price(c("price_lo"), c("price_hi")),
            "factors": scoring.viral_factors(c("visual_appeal"), c("explainability"), c("saturation"), c("ugc_fit")),
        })
        .withColumn("score", scoring.creative_score(c("content_ideas"), c("viral_potential"), c("visual_appeal"),
                                                    c("explainability"), c("ugc_fit"), c("saturation"), c("seed")))
        .withColumn("probability", scoring.viral_probability(c("score"), c("factors"), c("seed")))
    )


def score_products(products: DataFrame, categories: list[Category] = BUILTIN) -> DataFrame:
    return with_scores(with_category(products, categories))


def with_slots(df: DataFrame) -> DataFrame:
    """Add the per-product values that templates may refer to."""
    c = F.col
    lower = lambda name: F.transform(name, F.lower)
    return df.withColumns({
        "p": short_name(name_or_default(c("name"))),
        "cat": F.lower("kb_name"),
        "b": sampled(c("seed"), "benefits", c("benefits"), 7),
        "pains": lower(F.flatten(F.transform("audiences", lambda a: a["pains"]))),
        "auds": lower(F.transform("audiences", lambda a: a["name"])),
        "price_text": F.concat(money(c("recommended_price")), F.lit(" USD")),
        "person": seeded_pick(c("seed"), "person", F.array(*[F.lit(x) for x in templates.PERSONS])),
        "reviewers": sampled(c("seed"), "reviewers", F.array(*[F.lit(x) for x in templates.REVIEW_NAMES]), 4),
        "desire0": seeded_pick(c("seed"), "landing", c("desires")),
    }).withColumns({"q": encode_component(c("p")), "qcat": encode_component(F.substring_index("kb_name", " ", 1))})


def enrich(products: DataFrame, categories: list[Category] = BUILTIN) -> DataFrame:
    return with_slots(score_products(spread(products), categories))


def by_campaign(products: DataFrame) -> DataFrame:
    """Products with their campaign id, dealt out by it: what is built of a product can then be joined by that id without an exchange."""
    spark = products.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return with_campaign_id(products).repartition(n, "campaign_id")


def with_twins(products: DataFrame, key: str = "product_id") -> DataFrame:
    """Add ``twin``: whether the key comes in other rows too."""
    several = products.groupBy(F.col(key).alias("_key")).count().filter("count > 1").select("_key", F.lit(True).alias("_twin"))
    joined = products.join(several.hint("merge"), products[key].eqNullSafe(several["_key"]), "left")
    return joined.select(*products.columns, F.coalesce("_twin", F.lit(False)).alias("twin"))

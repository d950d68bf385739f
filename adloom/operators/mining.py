"""Competitor copy mining: rules over the lines and the whole text of each document.

Every rule is a regular expression on a column, so a corpus is read once and no row is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.seeded import seeded_int
from adloom.functions.text import lines_in_range, strip
from adloom.functions.urls import url_domain
from adloom.knowledge import rules as R
from adloom.operators.selection import first_k, first_match

SCOPES = ["transformation", "social_proof", "offer", "guarantee"]


def matches(lowered: Column, pattern: str) -> Column:
    """Rule test on lower-case text (rules are written in lower case)."""
    return lowered.rlike(pattern)


def competitor_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lines of the copy with their position among the kept lines."""
    lines = lines_in_range(F.col(text), R.LINE_MIN, R.LINE_MAX)
    return docs.select("doc_id", F.posexplode(lines).alias("pos", "line"))


def is_cta(lowered: Column, rules: dict) -> Column:
    short = (F.length(lowered) < R.CTA_SHORT_LENGTH) & matches(lowered, rules["cta_short"])
    return matches(lowered, rules["cta_start"]) | short


def mine(docs: DataFrame, rules: dict = R.COMPETITOR, text: str = "text") -> DataFrame:
    """Add lines, hooks, ctas and the document flags and evidence lines."""
    body = F.coalesce(strip(F.col(text)), F.lit(""))
    both = F.transform(lines_in_range(F.col("body"), R.LINE_MIN, R.LINE_MAX), lambda line: F.struct(line.alias("line"), F.lower(line).alias("low")))
    lined = docs.withColumn("body", body).withColumns({"lined": both, "_low": F.lower("body")})
    lines = F.col("lined")
    having = lambda test: F.transform(F.filter(lines, lambda x: test(x["low"])), lambda x: x["line"])
    first = lambda rule: first_match(lines, lambda x: matches(x["low"], rules[rule]))["line"]
    return lined.withColumns({
        "lines": F.transform(lines, lambda x: x["line"]),
        "hooks": first_k(having(lambda low: matches(low, rules["hook"])), R.MAX_HOOKS),
        "ctas": first_k(having(lambda low: is_cta(low, rules)), R.MAX_CTAS),
        **{f"has_{s}": matches(F.col("_low"), rules[s]) for s in SCOPES},
        "offer_line": first("offer_line"), "guarantee_line": first("guarantee_line"),
    }).drop("lined", "_low")


def storytelling() -> Column:
    return (F.when(F.length("body") <= R.STORY_MIN_LENGTH, "no_text").when(F.col("has_transformation"), "transformation")
            .when(F.col("has_social_proof"), "social_proof").otherwise("direct"))


def offer_evidence() -> Column:
    return F.when(F.col("has_offer"), F.coalesce("offer_line", F.lit(R.DEFAULT_OFFER))).otherwise(R.NO_OFFER)


def guarantee_evidence() -> Column:
    return F.when(F.col("has_guarantee"), F.coalesce("guarantee_line", F.lit(R.DEFAULT_GUARANTEE))).otherwise(R.NO_GUARANTEE)


def or_placeholder(values: Column, placeholder: list[str]) -> Column:
    return F.when(F.size(values) > 0, values).otherwise(F.array(*map(F.lit, placeholder)))


def ad_framework(url: Column) -> Column:
    """Domain, start of the first hook and first call to action."""
    hook = F.coalesce(F.left(F.get("hooks", F.lit(0)), F.lit(R.HOOK_PREVIEW)), F.lit(R.DEFAULT_HOOK))
    cta = F.coalesce(F.get("ctas", F.lit(0)), F.lit(R.DEFAULT_CTA))
    return F.concat_ws(" → ", url_domain(url), hook, cta)


def competitor_report(docs: DataFrame, rules: dict = R.COMPETITOR) -> DataFrame:
    """One row per source (doc_id, url, name, text) with all findings and advice."""
    k = seeded_int(F.concat("url", "name"), "competitor", 2, 3).cast("string")
    fill = lambda texts: F.array(*[F.replace(F.lit(t), F.lit("{k}"), k) if "{k}" in t else F.lit(t) for t in texts])
    return mine(docs, rules).select(
        "doc_id", "url", or_placeholder(F.col("hooks"), R.NO_HOOKS).alias("hooks"), or_placeholder(F.col("ctas"), R.NO_CTAS).alias("ctas"),
        storytelling().alias("storytelling"), offer_evidence().alias("offer"), guarantee_evidence().alias("guarantee"),
        ad_framework(F.col("url")).alias("framework"), fill(R.WEAKNESSES).alias("weaknesses"), fill(R.COUNTER_MOVES).alias("counter_moves"),
        fill(R.COLOR_TODOS).alias("colors"))


def corpus_stats(mined: DataFrame, keys: list[str]) -> DataFrame:
    """Rule hit rates per key; sums are formed before the exchange, so a hot source is no single task."""
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return mined.groupBy(*keys).agg(
        F.count("*").alias("docs"), rate(F.size("hooks") > 0).alias("hook_rate"), rate(F.size("ctas") > 0).alias("cta_rate"),
        *[rate(F.col(f"has_{s}")).alias(f"{s}_rate") for s in SCOPES])

"""Diagnosis of ad descriptions: rule flags to issues and advice lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.seeded import seeded_int
from adloom.knowledge import rules as R
from adloom.operators.mining import matches


def issue_codes(description: Column, rules: dict = R.DIAGNOSIS) -> Column:
    """Codes of all issues in report order; the default code when there is none."""
    d = F.lower(description)
    hit = lambda rule: matches(d, rules[rule])
    found = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in {
        "short": F.length(d) < R.SHORT_DESCRIPTION, "no_hook": ~hit("mentions_hook"), "brand_intro": hit("brand_intro"),
        "too_long": hit("long_video") & ~hit("warm_traffic"), "no_close": ~hit("mentions_close"), "generic_audio": hit("generic_audio"),
    }.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit(R.DEFAULT_ISSUE[0]))).otherwise(found)


def diagnose(df: DataFrame, text: str = "text", rules: dict = R.DIAGNOSIS) -> DataFrame:
    messages = F.create_map(*[F.lit(x) for kv in [*R.ISSUES.items(), R.DEFAULT_ISSUE] for x in kv])
    return df.withColumn("issues", issue_codes(F.coalesce(text, F.lit("")), rules)).withColumn(
        "messages", F.transform("issues", lambda i: messages[i]))


def append_fixed(first: Column, fixed: list[str]) -> Column:
    """Conditional entries, then the fixed ones."""
    return F.concat(first, F.array(*map(F.lit, fixed)))


def advice_lists(diagnosed: DataFrame, text: str = "text") -> DataFrame:
    """Removals, additions, tests and changes; needs wow_moment and environment of the category."""
    seed = F.coalesce(text, F.lit(""))
    removal = F.filter(F.array(F.when(F.array_contains("issues", "brand_intro"), F.lit(R.BRAND_REMOVAL))), lambda x: x.isNotNull())
    slots = {"wow": F.col("wow_moment"), "env": F.col("environment"), "a": seeded_int(seed, "change_a", 10, 20).cast("string"),
             "b": seeded_int(seed, "change_b", 10, 40).cast("string")}

    def line(text_):
        out = F.lit(text_)
        for slot, value in slots.items():
            if f"{{{slot}}}" in text_:
                out = F.replace(out, F.lit(f"{{{slot}}}"), value)
        return out

    lines = lambda texts: F.array(*map(line, texts))
    return diagnosed.withColumns({
        "remove": append_fixed(removal, R.REMOVALS), "add": lines(R.ADDITIONS), "test": lines(R.TESTS),
        "hook_changes": lines(R.HOOK_CHANGES), "cta_changes": lines(R.CTA_CHANGES), "pacing_changes": lines(R.PACING_CHANGES)})


def issue_frequency(diagnosed: DataFrame) -> DataFrame:
    return diagnosed.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))

"""Category detection and lookup."""

from __future__ import annotations

import json

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.binding import let
from adloom.functions.text import fold_accents
from adloom.knowledge.categories import BUILTIN, Category, check_size
from adloom.operators.spreading import spread


def keyword_score(folded: Column, keywords: Column) -> Column:
    """Sum of the lengths of the keywords found anywhere in the text (parts of words count)."""
    hits = F.filter(keywords, lambda k: folded.contains(k))
    return F.aggregate(hits, F.lit(0), lambda total, k: total + F.length(k))


def category_scores(folded: Column, categories: list[Category]) -> Column:
    """Array of (score, -order, id), one entry per category."""
    rows = [{"rank": -i, "id": c.id, "keywords": c.keywords} for i, c in enumerate(categories)]
    literal = F.from_json(F.lit(json.dumps(rows)), "array<struct<rank: int, id: string, keywords: array<string>>>")
    return F.transform(literal, lambda c: F.struct(keyword_score(folded, c["keywords"]).alias("score"), c["rank"], c["id"]))


def detect_category(df: DataFrame, text: Column, categories: list[Category] = BUILTIN) -> DataFrame:
    """Add ``detected_id`` and ``detected_score``; the first category wins ties, the last is the default.

    Keywords are inlined after a size check, so no row is exchanged or multiplied.
    """
    check_size(categories)
    # Bound, the folded text is computed once and not once per keyword.
    best = df.withColumn("_best", F.array_max(let(fold_accents(text), lambda folded: category_scores(folded, categories))))
    found = F.col("_best.score") > 0
    return best.withColumns({
        "detected_id": F.when(found, F.col("_best.id")).otherwise(F.lit(categories[-1].id)),
        "detected_score": F.when(found, F.col("_best.score")).otherwise(F.lit(0)),
    }).drop("_best")


#: Characters of all keywords that an automaton is built of: it takes some hundred bytes for each in every Python worker.
MAX_CHARACTERS = 5_000_000


def _automaton(rows: list[tuple]) -> ahocorasick.Automaton:
    """Automaton whose words hold (length, categories)."""
    found: dict = {}
    for category, keyword in rows:
        found.setdefault(keyword, set()).add(category)
    out = ahocorasick.Automaton()
    for keyword, categories in found.items():
        out.add_word(keyword, (keyword, tuple(categories)))
    out.make_automaton()
    return out


def detect_category_by_automaton(df: DataFrame, text: Column, keywords: DataFrame | list[tuple], default_id: str) -> DataFrame:
    """Add ``detected_id`` and ``detected_score`` for keywords (category_id, ord, keyword) of any number: each text is read once.

    A multi-pattern automaton with goto and fail links steps once per character, however many keywords there are. It is built once
    per Python worker from the broadcast keywords, whose total size is checked. Only the folded text goes to Python and only
    (order, score) comes back; rows are neither exchanged nor multiplied.
    """
    if isinstance(keywords, DataFrame):
        sizes = keywords.agg(F.sum(F.length("keyword")).alias("n")).first()
        if (sizes["n"] or 0) > MAX_CHARACTERS:
            raise ValueError(f"{sizes['n']} characters of keywords, more than {MAX_CHARACTERS}; use detect_category_by_grams")
        keywords = [tuple(r) for r in keywords.select("category_id", "ord", "keyword").collect()]
    elif (n := sum(len(k) for *_, k in keywords)) > MAX_CHARACTERS:
        raise ValueError(f"{n} characters of keywords, more than {MAX_CHARACTERS}; use detect_category_by_grams")
    ids = {o: i for i, o, _ in keywords}
    shared = df.sparkSession.sparkContext.broadcast([(o, k) for _, o, k in keywords if k])
    held: list = []

    @F.pandas_udf("ord int, score int")
    def best(texts: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(_automaton(shared.value) if shared.value else None)
        rows = []
        for t in texts:
            totals: dict = {}
            seen = {word for _, word in held[0].iter(t)} if t and held[0] else ()
            for keyword, categories in seen:
                for o in categories:
                    totals[o] = totals.get(o, 0) + len(keyword)
            rows.append(min(totals.items(), key=lambda x: (-x[1], x[0])) if totals else (None, 0))
        return pd.DataFrame(rows, columns=["ord", "score"]).astype({"ord": "Int32", "score": "int32"})

    names = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair]) if ids else F.create_map().cast("map<int,string>")
    return df.withColumn("_best", best(fold_accents(text))).withColumns({
        "detected_id": F.coalesce(F.try_element_at(names, F.col("_best.ord")), F.lit(default_id)), "detected_score": F.col("_best.score")}).drop("_best")


def detect_category_by_grams(df: DataFrame, key: str, text: Column, keywords: DataFrame, lengths: list[int],
                             default_id: str, window: int = 256) -> DataFrame:
    """Same result for a keyword table (category_id, ord, keyword) of any size.

    A keyword is looked up by its first characters: as many as the largest power of two within its length. So a text is cut at
    every place once per power of two and not once per keyword length; a piece reaches as far as the keywords of its
    power may, meets them by equality of its first characters and is compared with them whole, and neither side is crossed. Texts are
    cut into overlapping windows first, which bounds a row and the cost of cutting; a keyword found in several
    windows counts once. ``key`` is unique per row. A catalog of few splits is spread over all cores first.
    """
    steps = sorted({1 << (n.bit_length() - 1) if n else 0 for n in lengths})
    folded = spread(df.select(key, fold_accents(text).alias("_t")), key).filter(F.length("_t") > 0)
    starts = F.sequence(F.lit(1), F.length("_t"), F.lit(window))
    size = F.lit(window + max(lengths) - 1)
    windows = folded.select(key, F.explode(F.transform(starts, lambda i: F.substring(F.col("_t"), i, size))).alias("_w"))

    def pieces(q: int) -> Column:
        most = min(max(2 * q - 1, 0), max(lengths))
        at = F.sequence(F.lit(1), F.length("_w") - q + 1)
        every = F.array_distinct(F.transform(at, lambda i: F.substring(F.col("_w"), i, F.lit(most))))
        cut = F.transform(every, lambda s: F.struct(F.left(s, F.lit(q)).alias("gram"), s.alias("piece")))
        return F.when(F.length("_w") >= q, cut).otherwise(F.array().cast("array<struct<gram: string, piece: string>>"))

    n = F.length("keyword")
    step = F.coalesce(*[F.when(n >= q, F.lit(q)) for q in reversed(steps)])
    words = keywords.filter(n.isin(lengths)).select("category_id", "ord", "keyword", F.left("keyword", step).alias("gram"))
    cut = windows.select(key, F.explode(F.flatten(F.array(*map(pieces, steps)))).alias("_p")).select(key, "_p.gram", "_p.piece")
    hits = cut.join(words, "gram").filter(F.startswith("piece", "keyword"))
    scores = hits.dropDuplicates([key, "category_id", "keyword"]).groupBy(key, "category_id", "ord").agg(
        F.sum(F.length("keyword")).alias("score"))
    best = scores.groupBy(key).agg(argmax_first(F.col("category_id"), F.col("score"), F.col("ord")).alias("detected_id"))
    return df.join(best, key, "left").withColumn("detected_id", F.coalesce("detected_id", F.lit(default_id)))


def argmax_first(value: Column, score: Column, order: Column) -> Column:
    """Aggregate: the value with the greatest score, the earliest in order on ties."""
    return F.max_by(value, F.struct(score, -order))


def known_or_last(category_id: Column, categories: list[Category] = BUILTIN) -> Column:
    return F.when(category_id.isin([c.id for c in categories]), category_id).otherwise(F.lit(categories[-1].id))


def resolve_category(df: DataFrame, categories: list[Category] = BUILTIN) -> DataFrame:
    """Add ``resolved_id``: the given category when set, else the detected one."""
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")), F.coalesce("source_url", F.lit("")))
    given = F.nullif(F.coalesce("category_id", F.lit("")), F.lit(""))
    out = detect_category(df, text, categories)
    chosen = F.when(given.isNotNull(), known_or_last(given, categories)).otherwise(F.col("detected_id"))
    return out.withColumn("resolved_id", chosen)


def category_lookup(df: DataFrame, kb: DataFrame, category_id: str = "resolved_id") -> DataFrame:
    """Join the base by id; ids outside it must already be mapped to the default."""
    # A left join: an inner one would repeat the detection in an inferred not-null filter below it.
    # The base is a static table of checked size.
    return df.join(F.broadcast(kb.withColumnRenamed("id", category_id)), category_id, "left")

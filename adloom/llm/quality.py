"""Quality by hierarchical empirical Bayes: document evidence, shrunk by the sites that a document comes from.

1. Evidence: binned surface measures of a text (capitals, symbols, exclamation marks, repeated neighbours, vocabulary growth,
   word length) as a log-likelihood ratio good : bad, from counts over the labelled rows that are not held out.
2. Sites: the expected good documents of every host and path come from grouped sums over all documents. Hosts are shrunk
   toward the global share and paths toward their host; the weights of these priors come from the spread between sites
   (method of moments), so sparse sites lean on their prior.
3. Posterior: log odds of the path, without the document itself, plus the evidence of the document. Kept from 0.5 on.

Defined results: null and blank texts have no evidence, so their site decides. Null hosts and paths are sites of their own.
Without labels of both classes there is no evidence and the prior is even. Repeated rows and null ids are ordinary rows;
labels of unknown ids are ignored, and of repeated labels the lowest counts. Texts of any length stay in their row.
``keep_good`` returns the documents with all their columns; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.binding import let
from adloom.llm.common import need, words
from adloom.llm.toxicity import held_out
from adloom.session import shared_dir, staged

BINS = 16
MEASURES = 6
SMOOTHING = 1.0
#: Log odds of one measure and of a whole text are held within these bounds.
MOST, MOST_ALL = 4.0, 12.0
#: Site tables of up to so many rows (about 50 bytes each) are broadcast; larger ones are joined.
BROADCAST_ROWS = 200_000


def measures(text: Column) -> Column:
    """Array of bins (0 to 15), one per measure; null for a text without words."""
    text = F.coalesce(text, F.lit(""))
    bin_of = lambda share: F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")

    def of(w):
        n, letters = F.size(w), F.greatest(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(1))
        chars = F.greatest(F.char_length(text), F.lit(1))
        repeats = F.size(F.filter(F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda x: x))
        growth = F.log(F.size(F.array_distinct(w)).cast("double") + 1) / F.log(n.cast("double") + 1)
        return F.when(n > 0, F.array(
            bin_of(F.regexp_count(text, F.lit(r"\p{Lu}")) / letters),
            bin_of(4 * F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:!?'\"()\-]")) / chars),
            bin_of(4 * (F.char_length(text) - F.char_length(F.replace(text, F.lit("!"), F.lit("")))) / chars),
            bin_of(repeats / n), bin_of(F.greatest(2 * growth - 1, F.lit(0.0))), bin_of(chars / n / 32)))
    return let(words(text), of)


def measured(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, bins. The generator keeps the bins from being computed at every use."""
    return docs.select(F.col("doc_id"), host.alias("host"), path.alias("path"), F.explode(F.array(measures(F.col("text")))).alias("bins"))


def evidence_table(found: DataFrame, labels: DataFrame) -> tuple[list[list[float]], float]:
    """Log-likelihood ratios by measure and bin, and the good share, from labelled rows that are not held out."""
    known = need(labels, "doc_id", "quality").filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = found.filter("bins IS NOT NULL").join(known, "doc_id").select("quality", F.posexplode("bins").alias("m", "b"))
    counts = {(r["quality"], r["m"], r["b"]): r["count"] for r in rows.groupBy("quality", "m", "b").count().collect()}  # at most 2 x 6 x 16 rows
    total = {q: sum(v for (a, m, _), v in counts.items() if a == q and m == 0) for q in (0, 1)}
    if not total[0] or not total[1]:
        return [[0.0] * BINS for _ in range(MEASURES)], 0.5
    share = lambda q, m, b: (counts.get((q, m, b), 0) + SMOOTHING) / (total[q] + SMOOTHING * BINS)
    table = [[max(-MOST, min(MOST, math.log(share(1, m, b) / share(0, m, b)))) for b in range(BINS)] for m in range(MEASURES)]
    return table, total[1] / (total[0] + total[1])


def evidence(bins: Column, table: list[list[float]]) -> Column:
    parts = [F.get(F.array(*[F.lit(v) for v in row]), F.get(bins, F.lit(m))) for m, row in enumerate(table)]
    return F.when(bins.isNull(), 0.0).otherwise(F.greatest(F.least(sum(parts[1:], parts[0]), F.lit(MOST_ALL)), F.lit(-MOST_ALL)))


def _odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _precision(sites: DataFrame, mean: str) -> float:
    """Weight of the prior by the method of moments: sites that differ little are shrunk a lot."""
    row = sites.filter("n >= 5").agg(
        F.sum("n").alias("n"), F.count("*").alias("sites"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(mean), 2)).alias("between"),
        F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("within")).first()
    if not row["n"] or row["sites"] < 2 or not row["within"]:
        return 10.0
    size, spread = row["n"] / row["sites"], row["between"] / row["n"]
    inside = row["within"] / row["n"]
    beyond = max(spread - inside / size, 1e-6)
    return max(1.0, min(1e4, inside / beyond - 1))


def site_table(found: DataFrame, table, prior: float) -> DataFrame:
    """host, path, n, s, host_mean, weight: sums of every path and the mean of its host that it is shrunk toward."""
    p = _sigmoid(_odds(F.lit(prior)) + evidence(F.col("bins"), table))
    paths = staged(found.select("host", "path", p.alias("p")).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")),
                   shared_dir(found.sparkSession, "quality"), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("all", F.lit(0.0))
    everything = paths.agg((F.sum("s") / F.sum("n")).alias("m")).first()["m"]
    mean = prior if everything is None else everything
    weight = _precision(hosts.withColumn("mean", F.lit(mean)), "mean")
    shrunk = hosts.select(F.col("host").alias("_host"), ((F.lit(weight * mean) + F.col("s")) / (weight + F.col("n"))).alias("host_mean"))
    joined = paths.join(shrunk, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    return joined.withColumn("weight", F.lit(_precision(joined, "host_mean")))


def posterior(found: DataFrame, sites: DataFrame, table, prior: float) -> DataFrame:
    """Adds evidence, site (mean of the path without the row), score and kept to rows of (host, path, bins)."""
    small = sites.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    held = sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "n", "s", "host_mean", "weight")
    rows = found.withColumn("evidence", evidence(F.col("bins"), table)).join(
        F.broadcast(held) if small else held, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    own = _sigmoid(_odds(F.lit(prior)) + F.col("evidence"))
    site = (F.col("weight") * F.col("host_mean") + F.greatest(F.col("s") - own, F.lit(0.0))) / (F.col("weight") + F.col("n") - 1)
    rows = rows.withColumn("site", site).withColumn("score", _sigmoid(_odds(F.col("site")) + F.col("evidence")))
    return rows.withColumn("kept", F.col("score") >= 0.5).drop("_host", "_path", "n", "s", "host_mean", "weight")


def _fitted(docs: DataFrame, labels: DataFrame, host: Column, path: Column):
    found = staged(measured(need(docs, "doc_id", "text", "source", "lang"), host, path), shared_dir(docs.sparkSession, "quality"), "measures")
    table, prior = evidence_table(found, labels)
    return found, site_table(found, table, prior), table, prior




def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, score, evidence, site, kept for every document."""
    found, sites, table, prior = _fitted(docs, labels, F.col(host), F.col(path))
    return posterior(found, sites, table, prior).select("doc_id", "score", "evidence", "site", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The documents that are kept, with all their columns. Texts are measured a second time rather than shuffled."""
    _, sites, table, prior = _fitted(docs, labels, F.col(host), F.col(path))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.col(host).alias("host"), F.col(path).alias("path"),
                       F.explode(F.array(measures(F.col("text")))).alias("bins"))
    return posterior(rows, sites, table, prior).filter("kept").select(*[F.col(f"_row.`{n}`").alias(n) for n in names])

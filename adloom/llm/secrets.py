"""Secret scan: candidate words of a text, sorted into secrets and false positives by a random forest.

Candidates are values of at least 12 characters that hold a digit or a change of case, and values of any length that follow a key
and an equals sign or colon. Words are split at quotes, commas, equals signs and colons; URLs and words with signs inside
are candidates as a whole too, so a word may give several. Features: length, character transitions and shares, dictionary coverage (the most frequent words of the whole
corpus), the path of the document, and the words before and after. The forest is trained on labelled findings: by default
a bounded draw of the corpus's own candidates, labelled by strict formats (``label_by_format``); the forest itself never sees
a format, prefix or value, so it judges findings of any format. Everything runs as DataFrame operations and the library's
forest.

Defined results: null and empty texts give no candidate. Null paths count as empty. Repeated rows give repeated findings.
Words of any length are candidates in full. Without findings of both classes nothing can be learned: score null, is_secret
false. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.binding import let
from adloom.llm.common import words
from adloom.session import shared_dir, staged

MIN_LENGTH = 12
#: So many findings of each class at most are used for training; candidates and scores have no limit.
MAX_FINDINGS = 20_000
DICTIONARY = 400
TREES, DEPTH, SEED = 40, 8, 7
THRESHOLD = 0.5
KEYS = r"(?i)pass(word|wd|phrase)?|pwd|secret|token|api.?key|access.?key|auth|credential|bearer"
#: Words are split at these; a URL stays whole besides its pieces, and so does the padding of base64.
SPLIT = "[,=:\"'`]"
URL = r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s\"'`,]+"
PIECE = "[\"'`]?[A-Za-z0-9+/_\\-]{16,}={1,2}(?=$|[\"'`,;])|[=:]>?|[\"'`]?[^\"'`,=:]+"
SIGN = "^[=:]>?$"
KEY_END = r"(^|[{(\[<?&;/.])[A-Za-z_][A-Za-z0-9_.\-]*$"
JOINED = "^[\"'`{(\\[]*([A-Za-z_][A-Za-z0-9_.\\-]*)[=:]+>?(.+)$"
#: Marks around a value. A run at the end is tried from its begin only, so long words take linear time.
EDGES = r"^[\"'`(\[{<]++|(?:\G|(?<![\"'`,;.)\]}>]))[\"'`,;.)\]}>]++$"
OUTSIDE = r"^[^A-Za-z0-9+/_\-]++|(?<=[A-Za-z0-9+/=_\-])[^A-Za-z0-9+/=_\-]++$"
FAKES = r"(?i)example|sample|dummy|placeholder|changeme|xxxx|test"
TRANSITIONS = r"(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])|(?<=[a-z])(?=[^a-z0-9])|(?<=[A-Z])(?=[^A-Z0-9])"
FEATURES = ["length", "transitions", "digits", "upper", "lower", "other", "distinct", "vowels", "coverage", "depth", "path_test", "path_config",
            "key", "fake", "assigned", "quoted", "next_key", "next_fake"]


def _tokens(w: Column) -> Column:
    """(word_no, s, quoted) of all words: URLs as a whole, then the pieces between quotes, commas and signs, and each sign."""
    def of(x, i):
        parts = F.when(x.rlike(SPLIT), F.concat(F.regexp_extract_all(x, F.lit(URL), 0), F.regexp_extract_all(x, F.lit(PIECE), 0))).otherwise(F.array(x))
        return F.transform(parts, lambda s: F.struct(i.alias("word_no"), F.regexp_replace(s, "^[\"'`]+", "").alias("s"), s.rlike("^[\"'`]").alias("quoted")))
    return F.filter(F.flatten(F.transform(w, of)), lambda t: t["s"] != "")


def _likely(x: Column) -> Column:
    return (F.char_length(x) >= MIN_LENGTH) & x.rlike("[0-9]|[a-z][A-Z]")


def _pieces(t: Column) -> Column:
    """Candidates among the tokens: likely ones, and what follows a key and a sign."""
    at = lambda i, k: F.when(i >= k, F.get(t, F.greatest(i - k, F.lit(0)))["s"])
    sign = lambda c: F.coalesce(c.rlike(SIGN), F.lit(False))
    # Up to two signs, as in := and ==.
    key = lambda i: F.when(sign(at(i, 1)), F.when(sign(at(i, 2)), at(i, 3)).otherwise(at(i, 2)))
    follows = lambda i: F.coalesce(key(i).rlike(KEY_END), F.lit(False))
    marked = F.filter(F.transform(t, lambda x, i: F.when(~sign(x["s"]) & ~x["s"].startswith("//") & (_likely(x["s"]) | follows(i)), i)), lambda i: i.isNotNull())
    return F.transform(marked, lambda i: F.struct(
        F.get(t, i)["word_no"].alias("word_no"), F.get(t, i)["s"].alias("inside"), F.get(t, i)["quoted"].alias("quoted"), follows(i).alias("assigned"),
        F.concat_ws(" ", key(i), at(i, 1)).alias("before"), F.get(t, i + 1)["s"].alias("after")))


def _whole(w: Column) -> Column:
    """Candidates among the words as they stand, without the key in front of a sign: values may hold signs and commas themselves."""
    p = lambda i, k: F.when(i >= k, F.get(w, F.greatest(i - k, F.lit(0))))
    joined = lambda x: F.regexp_extract(x, JOINED, 1)
    sign = lambda c: F.coalesce(c.rlike(SIGN), F.lit(False))
    after_sign = lambda i: F.coalesce(p(i, 1).rlike("[=:]>?$") & (~sign(p(i, 1)) | p(i, 2).rlike("[A-Za-z0-9_][\"'`]*$")), F.lit(False))
    inside = lambda x: F.when(joined(x) != "", F.regexp_extract(x, JOINED, 2)).otherwise(x)
    # Others are pieces or URLs already; what holds a quote inside is several values.
    several = lambda v: v.rlike("[^,=:][,=:]+[^,=:]") & ~v.rlike("[\"'`]") & ~v.startswith("//") & ~v.rlike(f"^{URL}$")
    wanted = lambda x, i: x.rlike("[,=:]") & (_likely(x) | (joined(x) != "") | after_sign(i)) & several(F.regexp_replace(inside(x), EDGES, ""))
    marked = F.filter(F.transform(w, lambda x, i: F.when(wanted(x, i), i)), lambda i: i.isNotNull())
    one = lambda i, x: F.struct(i.alias("word_no"), inside(x).alias("inside"), inside(x).rlike("^[\"'`]").alias("quoted"),
                                ((joined(x) != "") | after_sign(i)).alias("assigned"), F.concat_ws(" ", joined(x), F.when(sign(p(i, 1)), p(i, 2)), p(i, 1)).alias("before"), F.get(w, i + 1).alias("after"))
    return F.transform(marked, lambda i: one(i, F.get(w, i)))


def candidates(docs: DataFrame, path: Column) -> DataFrame:
    """doc_id, path, word_no, value, before, after, assigned, quoted: one row per candidate value of a word."""
    rows = docs.select("doc_id", F.coalesce(path, F.lit("")).alias("path"), F.explode(let(words(F.col("text")), lambda w: F.concat(_whole(w), let(_tokens(w), _pieces)))).alias("c"))
    # A value after a sign keeps all marks that passwords have.
    value = F.when(F.col("c.assigned"), F.regexp_replace("c.inside", EDGES, "")).otherwise(F.regexp_replace("c.inside", OUTSIDE, ""))
    found = rows.select("doc_id", "path", F.col("c.word_no").alias("word_no"), value.alias("value"), F.col("c.quoted").alias("quoted"), F.col("c.assigned").alias("assigned"),
                        F.col("c.before").alias("before"), F.coalesce("c.after", F.lit("")).alias("after"))
    return found.filter((F.char_length("value") >= MIN_LENGTH) | (F.col("assigned") & (F.col("value") != "")))


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent plain words of all texts; the number is a parameter."""
    plain = F.filter(words(F.lower("text")), lambda x: x.rlike("^[a-z]{3,10}$"))
    counted = docs.select(F.explode(plain).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(size)
    return [r["w"] for r in counted.collect()]


def featured(found: DataFrame, known_words: list[str]) -> DataFrame:
    """Adds the feature columns."""
    v, n = F.col("value"), F.char_length("value")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    cover = (F.lit("|".join(sorted(known_words, key=lambda w: (-len(w), w)))) if known_words else F.lit("(?!)"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return found.withColumns({
        "length": n.cast("double"), "transitions": F.regexp_count(v, F.lit(TRANSITIONS)) / n, "digits": share("[0-9]"), "upper": share("[A-Z]"),
        "lower": share("[a-z]"), "other": share("[^A-Za-z0-9]"), "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "vowels": F.regexp_count(F.lower(v), F.lit("[aeiou]")) / n,
        "coverage": 1 - F.char_length(F.regexp_replace(F.lower(v), cover, F.lit(""))) / n,
        "depth": F.regexp_count("path", F.lit("/")).cast("double"), "path_test": flag(F.col("path").rlike(FAKES)),
        "path_config": flag(F.col("path").rlike(r"(?i)\.(env|ini|cfg|conf|ya?ml|json|properties|toml)$")),
        "key": flag(F.col("before").rlike(KEYS)), "fake": flag(F.concat_ws(" ", "before", "value").rlike(FAKES)),
        "assigned": F.col("assigned").cast("double"), "quoted": F.col("quoted").cast("double"),
        "next_key": flag(F.col("after").rlike(KEYS)), "next_fake": flag(F.col("after").rlike(FAKES))})


def label_by_format(found: DataFrame) -> DataFrame:
    """Findings whose format tells what they are: is_secret 1 or 0; all others are left out."""
    v, key = F.col("value"), F.col("before").rlike(KEYS)
    fake = F.concat_ws(" ", "before", "value").rlike(FAKES) & ~v.contains("@")
    secret = (v.rlike("^AKIA[0-9A-Z]{16}$") | v.rlike("^gh[pousr]_[A-Za-z0-9]{36}$") | v.rlike("^sk_live_[A-Za-z0-9]{16,}$")
              | (key & F.col("assigned").cast("boolean") & v.rlike("^[0-9a-fA-F]{16,}$")))
    harmless = (v.rlike("^[^@]+@[^@]+$") | v.rlike("^[0-9.,:/-]+$") | v.rlike("^https?:") | v.rlike("[^\\x00-\\x7F]")
                | (~key & v.rlike("^[a-zA-Z]+$")) | v.rlike("^(.)\\1+$"))
    return found.withColumn("is_secret", F.when(fake | harmless, 0).when(secret, 1)).filter("is_secret IS NOT NULL")


def drawn(labelled: DataFrame, most: int = MAX_FINDINGS) -> DataFrame:
    """At most ``most`` labelled findings of different values of each class, drawn by a hash of the value: a rare class is never crowded out."""
    one = labelled.groupBy("value", "is_secret").agg(F.max_by(F.struct("path", "before", "after", "assigned", "quoted"), F.xxhash64("before", "after")).alias("f"))
    part = lambda k: one.filter(F.col("is_secret") == k).select("value", "f.*", "is_secret").orderBy(F.xxhash64("value"), "value").limit(most)
    return part(1).unionByName(part(0))


def train(labelled: DataFrame, known_words: list[str]):
    """Forest over the features, or None without both classes."""
    rows = featured(labelled, known_words).select(array_to_vector(F.array(*FEATURES)).alias("features"), F.col("is_secret").cast("double").alias("label"))
    if rows.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(rows)


def scan(docs: DataFrame, path: str | None = "source", findings: DataFrame | None = None) -> DataFrame:
    """doc_id, word_no, length, value_sha256, score, is_secret: one row per candidate.

    ``findings`` are labelled candidates (value, path, before, after, assigned, quoted, is_secret).
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "secrets")
    found = staged(candidates(docs, F.col(path) if path else F.lit("")), folder, "candidates")
    known = dictionary(docs)
    labelled = staged(drawn(findings if findings is not None else label_by_format(found)), folder, "labelled")
    model = train(labelled, known)
    rows = featured(found, known)
    if model is None:
        scored = rows.withColumn("score", F.lit(None).cast("double"))
    else:
        scored = model.transform(rows.withColumn("features", array_to_vector(F.array(*FEATURES)))).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("doc_id", "word_no", F.char_length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 9).alias("score"),
                         F.coalesce(F.col("score") >= THRESHOLD, F.lit(False)).alias("is_secret"))

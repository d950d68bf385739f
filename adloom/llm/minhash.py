"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A document's set holds its word shingles. SuperMinHash gives each element a random permutation of the signature's places and
one value per rank, value = rank + uniform number; a place keeps its smallest value. Ranks of one element are correlated,
which lowers the variance, and the walk over ranks stops as soon as no place can still fall. Bands of the signature are
bucket keys. Documents of equal sets are one class, which its smallest id stands for.

No bucket is expanded into all its pairs. Every member is compared with the smallest id of its bucket first; members of
different components of one bucket are then compared with pivots, of which each round has more until they are all members outside the
bucket's largest component, while the bucket holds several components and if a lower bound of what they do not share leaves a link possible: the parity bits of two sets differ in at most as many places as the sets have elements that only one of them
holds. The bound and the triangle inequality of the Jaccard distance exclude no link; of sets far above 1,024 shingles the
bits say less, and more pairs are verified. Links are confirmed on the full texts, never on signatures.

With 32 bands of 5 places, a pair of similarity 0.8 shares no bucket with a probability of 3e-6; nothing else is lost.

Defined results: null and blank texts have an empty set, n_shingles 0, and are linked with nothing; texts of fewer words than a
shingle have their whole word sequence as one. Null ids come out as their own component (null) and are kept. Repeated rows
of an id are one document of one set and share its row values; rows of one id with different texts link as one id. An
empty table gives an empty result. Other columns are not read, and ``deduplicate`` passes them through.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import need
from adloom.llm.graph import components
from adloom.session import shared_dir, staged

PLACES = 160
BANDS = 32
SEED = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x100000001B3)
#: Longs of parity bits for each set.
PARITY = 16
#: Rows of a large bucket that its others are compared with in the first round, as expected.
PIVOTS, GROWTH = 2, 64
#: Elements hashed at a time.
CHUNK = 1 << 17


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def text_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z only and splits at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash per word: a polynomial over its bytes, mixed with its length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), BASE, np.uint64))
    sums = np.add.reduceat(mixed(data * SEED) * powers[place], starts)
    return mixed(sums + lengths.astype(np.uint64) * SEED)


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Distinct hashes of the word shingles, sorted."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    n = max(len(h) - k + 1, 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        out = mixed(out + SEED + h[i: i + n])
    return np.unique(out)


def signatures(elements: np.ndarray, owner: np.ndarray, n: int, m: int = PLACES) -> np.ndarray:
    """SuperMinHash signatures (n x m) of n sets: elements[i] belongs to set owner[i]. Sets without elements stay infinite."""
    sig = np.full(n * m, np.inf)
    left = np.arange(len(elements))
    order = None
    for j in range(m):
        h, own = elements[left], owner[left]
        r = (mixed(h + SEED * np.uint64(2 * j + 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = j + (mixed(h + SEED * np.uint64(2 * j + 2)) % np.uint64(m - j)).astype(np.int64)
        if j == 0:
            place, first = k, k
        else:
            if order is None:  # few elements go on beyond the first rank
                order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(left), 1))
                rows = np.arange(len(left))
                order[rows, 0], order[rows, first] = first, 0
            rows = np.arange(len(left))
            place = order[rows, k].astype(np.int64)
            order[rows, k], order[rows, j] = order[rows, j], place
        np.minimum.at(sig, own * m + place, r + j)
        # A later rank gives at least j + 1, so sets whose places are all below are done.
        go = (sig.reshape(n, m).max(axis=1) > j + 1)[own]
        if not go.all():
            left = left[go]
            if order is not None:
                order = order[go]
            else:
                first = first[go]
        if not len(left):
            break
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, -1)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64) * SEED), bits.shape[:2]).copy()
    for i in range(bits.shape[2]):
        key = mixed(key ^ bits[:, :, i]) + SEED
    return key.view(np.int64)


def parity_bits(elements: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """n x PARITY longs: bit b of a set tells whether an odd number of its elements falls on b."""
    bits = np.zeros(n * PARITY, np.uint64)
    at = owner * PARITY + ((elements >> np.uint64(6)) % np.uint64(PARITY)).astype(np.int64)
    np.bitwise_xor.at(bits, at, np.uint64(1) << (elements & np.uint64(63)))
    return bits.view(np.int64).reshape(n, PARITY)


def _sketcher(k: int, bands: int):
    def chunks(batch):
        """Lists of (id, set) of at most about CHUNK elements; a larger set comes alone."""
        held, size = [], 0
        for i, text in zip(batch["doc_id"], batch["text"]):
            s = shingle_set(text_words(text), k)
            if held and size + len(s) > CHUNK:
                yield held
                held, size = [], 0
            held.append((i, s))
            size += len(s)
        if held:
            yield held

    def sketch(batches):
        np.seterr(over="ignore")  # hashing is arithmetic modulo 2 ** 64
        for batch in batches:
            for held in chunks(batch):
                sizes = np.array([len(s) for _, s in held])
                elements = np.concatenate([s for _, s in held])
                owner = np.repeat(np.arange(len(held)), sizes)
                keys = band_keys(signatures(elements, owner, len(held)), bands)
                one = [int(mixed(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for _, s in held]
                two = [int(np.bitwise_xor.reduce(mixed(s * M1 + SEED)).view(np.int64)) if len(s) else 0 for _, s in held]
                yield pd.DataFrame({"doc_id": pd.array([i for i, _ in held], "Int64"), "n_shingles": sizes, "d1": one, "d2": two, "keys": list(keys),
                                    "bits": list(parity_bits(elements, owner, len(held)))})
    return sketch


SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, bits array<long>"


def _verifier(k: int):
    def sets(text):
        words = text_words(text)
        return {tuple(words[i: i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()

    def verify(batches):
        for batch in batches:
            rows, last, held = [], None, set()
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"]):
                if a != last:
                    last, held = a, sets(ta)
                other = sets(tb)
                rows.append((a, b, len(held & other), len(held | other)))
            yield pd.DataFrame(rows, columns=["a", "b", "inter", "whole"], dtype=np.int64)
    return verify


def verified(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """a, b, inter, whole: exact set sizes of each pair, from the full texts."""
    texts = need(docs, "doc_id", "text").filter("doc_id IS NOT NULL")
    first = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = first.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(_verifier(k), "a long, b long, inter long, whole long")


def near_duplicates(docs: DataFrame, k: int = 2, percent: int = 80, bands: int = BANDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id that links reach), kept."""
    folder = shared_dir(docs.sparkSession, "minhash")
    linked = (F.col("inter") * 100) >= (F.col("whole") * percent)
    sketch = staged(need(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInPandas(_sketcher(k, bands), SKETCH), folder, "sketch")
    full = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    of_class = full.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["n_shingles", "d1", "d2"]).select("doc_id", "rep", "n_shingles").distinct()
    members = staged(of_class, folder, "members")
    reps = members.filter("doc_id = rep").select(F.col("rep").alias("doc_id"))
    buckets = (full.join(reps, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("keys").alias("key")))
    heads = buckets.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("size")).filter("size > 1")
    shared = staged(buckets.join(heads, "key").select("key", "id", "n", "a", "size"), folder, "shared")
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    sizes = members.filter("doc_id = rep").select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na")).distinct()
    star = shared.filter("id <> a").select("a", F.col("id").alias("b"), "n").distinct().join(sizes, "a").filter(fits(F.col("n"), F.col("na")))
    first = staged(verified(star.select("a", "b"), docs, k), folder, "first")
    links = first.filter(linked).select("a", "b")
    found = components(links, folder, "near")
    # Buckets of several components: what the comparison with the smallest id has left open.
    labelled = (shared.filter("size > 2 AND id <> a").join(first.select("a", F.col("b").alias("id"), "inter", "whole"), ["a", "id"], "left")
                .withColumn("d", 1 - F.col("inter") / F.col("whole")).select("key", "id", "n", "size", "d"))
    # An id whose rows have different texts has no bits, and all its pairs are verified.
    single = F.when(F.min(F.struct("d1", "d2")) == F.max(F.struct("d1", "d2")), F.first("bits"))
    apart = F.aggregate(F.zip_with("x.bits", "y.bits", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, v: total + v)
    possible = F.coalesce(apart, F.lit(0)) * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)
    far = F.coalesce(F.abs(F.col("x.d") - F.col("y.d")) > 1 - percent / 100 + 1e-9, F.lit(False))
    # Round by round more rows of an open bucket are pivots, which all its rows are compared with: a few in a large bucket, since
    # links of rows to a pivot put most of a group into one component and leave no pair to compare. Pivots of former rounds have met all
    # rows of their buckets and leave. Once no more rows than that lie outside the bucket's largest component, they are the pivots:
    # each pair of different components holds one of them, so the bucket is done.
    pivots, place = PIVOTS, F.pmod(F.xxhash64("key", "id"), F.col("size"))
    for turn in itertools.count():
        now = labelled.join(found, "id", "left").withColumn("c", F.coalesce("component_id", "id")).drop("component_id")
        parts = now.groupBy("key", "c").agg(F.count("*").alias("rows"), F.max(place < pivots).alias("drawn"))
        drawn, main, last = F.when(F.col("drawn"), F.col("c")), F.col("top.c"), F.col("others") <= pivots
        mixed_keys = (parts.groupBy("key").agg(F.max(F.struct("rows", "c")).alias("top"), F.sum("rows").alias("all"), F.count("*").alias("parts"), F.min("c").alias("low"),
                                               F.max("c").alias("high"), F.min(drawn).alias("first"), F.max(drawn).alias("end"))
                      .filter("parts > 1").withColumn("others", F.col("all") - F.col("top.rows"))
                      # only: the component of all pivots, if there is but one; its rows meet no pivot of another.
                      .select("key", last.alias("last"), main.alias("main"), (last | F.col("first").isNotNull()).alias("any"),
                              F.when(last, F.when(F.col("parts") == 2, F.when(F.col("low") == main, F.col("high")).otherwise(F.col("low"))))
                              .otherwise(F.when(F.col("first") == F.col("end"), F.col("first"))).alias("only")))
        pivot, meets = F.when(F.col("last"), F.col("c") != F.col("main")).otherwise(place < pivots), F.col("any") & ~F.col("c").eqNullSafe(F.col("only"))
        open_rows = staged(now.join(mixed_keys, "key").withColumns({"pivot": pivot, "meets": meets}).drop("main", "any", "only"), folder, f"open-{turn}")
        if open_rows.isEmpty():
            break
        # One row per document, with its buckets (a few for each of its texts), so its bits are looked up once.
        ids = (open_rows.filter("pivot OR meets").groupBy("id")
               .agg(F.collect_set(F.when(F.col("pivot"), F.struct("key", "n", "d", "c"))).alias("as_pivot"), F.collect_set(F.when(F.col("meets"), F.struct("key", "n", "d", "c", "pivot"))).alias("in")))
        bits = (full.withColumnRenamed("doc_id", "id").join(ids.select("id"), "id", "left_semi")
                .groupBy("id").agg(single.alias("bits")))
        ranked = ids.join(bits, "id")
        x, y = ranked.select("id", "bits", F.inline("as_pivot")).alias("x"), ranked.select("id", "bits", F.inline("in")).alias("y")
        rest = (x.join(y, (F.col("x.key") == F.col("y.key")) & (~F.col("y.pivot") | (F.col("x.id") < F.col("y.id"))) & (F.col("x.c") != F.col("y.c"))
                       & fits(F.col("x.n"), F.col("y.n")) & ~far & possible)
                .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
        more = staged(verified(rest, docs, k).filter(linked).select("a", "b"), folder, f"second-{turn}")
        if not more.isEmpty():
            links = found.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(more)
            found = components(links, folder, f"near-{turn}")
        labelled = open_rows.filter(~F.col("last") & (place >= pivots)).drop("c", "last", "pivot", "meets")
        pivots *= GROWTH
    links = found.select(F.col("id").alias("a"), F.col("component_id").alias("b"))
    # Rows of one id with different texts are one document.
    same_id = members.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(links.unionByName(same_id), folder, "all")
    result = sketch.select("doc_id", "n_shingles").join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns; documents without words stay."""
    gone = near_duplicates(docs, k, percent).filter("NOT kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")

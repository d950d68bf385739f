"""Toxicity by compression distance: windows compress better with a dictionary of the class they belong to.

Two zstandard dictionaries are trained, one on ordinary and one on toxic training texts. The toxic one is trained on the
contrast text: of each toxic training text, the words that occur in far more toxic than ordinary training texts (signed
log-likelihood ratio), since all other words are ordinary ones that the first dictionary covers already. A text is cut
into windows of whole words, and each window is compressed as ordinary text (ordinary dictionary) and as toxic text
(both). Dictionaries are loaded as plain content, so a literal costs a byte and a match shows in full.

How many windows gain at least 1, 3, 5, 7 bytes is turned into a probability by a logistic model that was fitted on
labelled texts against dictionaries that have not seen them (two halves, crosswise); 0.3 is the threshold of ``predicted``.

Labels only come from training rows; language, source and id are never inputs. At most ``max_toxic`` and ``max_ordinary``
different labelled texts, drawn by a hash of the text, are used in full for fitting; all texts are scored in full.

Defined results: null and empty texts have no window and get the score of a text without any gain. Repeated rows get equal
scores. Without labelled rows of both classes nothing can be learned and every score is 0. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import need

WINDOW = 32
ORDINARY_BYTES = 1 << 16
TOXIC_BYTES = 1 << 11
MIN_MATCH = 6
MIN_RATIO = 20.0
GAINS = (1, 3, 4, 5, 6, 7)
THRESHOLD = 0.3
MAX_TOXIC = 3000
MAX_ORDINARY = 4000
OUT = "doc_id long, held_out boolean, score double, predicted int, windows long, gain long"


def text_windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Runs of whole lower-case words of at least ``size`` bytes; a longer word is a window of its own."""
    out, run, n = [], [], 0
    for word in (text or "").lower().encode("utf-8", "replace").split():
        run.append(word)
        n += len(word) + 1
        if n >= size:
            out.append(b" " + b" ".join(run) + b" ")
            run, n = [], 0
    if run:
        out.append(b" " + b" ".join(run) + b" ")
    return out


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=17, chain_log=16, search_log=3, min_match=MIN_MATCH, target_length=8, strategy=zstandard.STRATEGY_LAZY,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


class Gains:
    """Bytes that a window saves when it is compressed as toxic instead of as ordinary text."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.as_ordinary, self.as_toxic = _compressor(ordinary).compress, _compressor(ordinary + toxic).compress

    def of(self, text: str | None) -> np.ndarray:
        one, two = self.as_ordinary, self.as_toxic
        found = text_windows(text)
        return np.fromiter((len(one(w)) - len(two(w)) for w in found), np.int32, len(found))

    def features(self, text: str | None) -> np.ndarray:
        gains = self.of(text)
        return np.array([math.log1p((gains >= g).sum()) for g in GAINS] + [math.log1p(len(gains)), float(gains.max(initial=0))])


def contrast_words(toxic: list[list[bytes]], ordinary: list[list[bytes]], min_ratio: float = MIN_RATIO) -> dict[bytes, float]:
    """Words, highest ratio first, whose share of toxic texts is above that of ordinary texts by a log-likelihood ratio of ``min_ratio``."""
    have, lack = Counter(), Counter()
    for words in toxic:
        have.update(set(words))
    for words in ordinary:
        lack.update(set(words))
    n, m = len(toxic), len(ordinary)

    def ratio(word):
        a, b = have[word], lack[word]
        e, f = (a + b) * n / (n + m), (a + b) * m / (n + m)
        return 0.0 if a <= e or a < 4 * b else 2 * (a * math.log(a / e) + (b * math.log(b / f) if b else 0.0))
    found = {w: ratio(w) for w in have}
    return dict(sorted(((w, r) for w, r in found.items() if r >= min_ratio), key=lambda x: (-x[1], x[0])))


def _train(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; the joined samples where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the first is the constant."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + 0.1 * np.eye(len(w)), a.T @ (p - y) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _distinct(rows: list[list[bytes]]) -> list[list[bytes]]:
    """One of each group of near copies: texts with the same three smallest word hashes are one."""
    seen, out = set(), []
    for words in rows:
        key = tuple(sorted({zlib.crc32(w) for w in words})[:3])
        if key not in seen:
            seen.add(key)
            out.append(words)
    return out


def fit(rows: pd.DataFrame) -> dict:
    """Dictionaries of all (text, toxic) rows; the weights come from each half's dictionaries on the other half."""
    texts = {1: [], 0: []}
    for text, toxic in zip(rows["text"], rows["toxic"]):
        texts[int(toxic)].append(text or "")
    if not texts[1] or not texts[0]:
        return {}
    half = lambda side: {k: v[side::2] or v for k, v in texts.items()}
    x, y = [], []
    for side in (0, 1):
        gains, other = Gains(*dictionaries(half(side))), half(1 - side)
        x += [gains.features(t) for k in (1, 0) for t in other[k]]
        y += [k for k in (1, 0) for _ in other[k]]
    ordinary, toxic = dictionaries(texts)
    return {"ordinary": ordinary, "toxic": toxic, "weights": _logistic(np.array(x), np.array(y, float))}


def dictionaries(texts: dict[int, list[str]]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary of labelled texts."""
    words = {k: _distinct([t.lower().encode("utf-8", "replace").split() for t in texts[k]]) for k in texts}
    chosen = contrast_words(words[1], words[0])
    toxic = [b" " + b" ".join(dict.fromkeys(w for w in ws if w in chosen)) + b" " for ws in words[1]]
    ordinary = [w for t in texts[0] for w in text_windows(t)]
    trained = _train([s for s in toxic if len(s) > 8], TOXIC_BYTES)
    # Training leaves words out when samples are few; they follow, most telling first.
    left = b" " + b" ".join(w for w in chosen if b" " + w + b" " not in trained) + b" "
    return _train(ordinary, ORDINARY_BYTES), trained + left[:TOXIC_BYTES]


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> pd.DataFrame:
    """The labelled texts of the fit, in hash order: whole texts, each once. Rows whose crc32(id) mod 4 is 2 are held out."""
    known = need(labels, "doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = need(docs, "doc_id", "text").filter("text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("at"), F.md5("text").alias("key"))
    rows = texts.select("doc_id", "at", "key").join(known, "doc_id").select("toxic", "at", "key").distinct()
    drawn = None
    for toxic, bound in ((1, max_toxic), (0, max_ordinary)):
        part = rows.filter(F.col("toxic") == toxic).orderBy("at", "key").limit(bound)
        drawn = part if drawn is None else drawn.unionByName(part)
    found = texts.select("at", "key", "text").join(F.broadcast(drawn.select("toxic", "key")), "key")  # at most both bounds
    return found.groupBy("toxic", "at", "key").agg(F.first("text").alias("text")).select("text", "toxic", "at").toPandas().sort_values(["toxic", "at", "text"], ignore_index=True)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(4)) == 2, F.lit(False))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted, windows, gain (largest of a window) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: two dictionaries and nine weights

    def apply(batches):
        m = shared.value
        gains = Gains(m["ordinary"], m["toxic"]) if m else None
        for batch in batches:
            scores, counts, best = [], [], []
            for text in batch["text"]:
                if gains is None:
                    scores.append(0.0), counts.append(0), best.append(0)
                    continue
                x = gains.features(text)
                scores.append(float(1 / (1 + np.exp(-np.clip(m["weights"][0] + x @ m["weights"][1:], -30, 30)))))
                counts.append(round(math.expm1(x[-2])))
                best.append(int(x[-1]))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": scores,
                                "predicted": [int(s >= THRESHOLD) for s in scores], "windows": counts, "gain": best})
    return need(docs, "doc_id", "text").withColumn("held_out", held_out()).mapInPandas(apply, OUT)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(training_rows(docs, labels)))

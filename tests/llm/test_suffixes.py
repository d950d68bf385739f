"""Repeated passages against brute force: overlaps, periodic and long texts, nulls, repeated rows, hot passages, many small batches."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adloom.llm import suffixes

SCHEMA = "doc_id long, text string"


def expected(docs, match):
    low = {}
    for d, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - match + 1) if d is not None else ():
            w = data[i:i + match]
            low[w] = min(low.get(w, d), d)
    out = []
    for d, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - match + 1) if d is not None else ():
            if low[data[i:i + match]] < d:
                gone[i:i + match] = b"\1" * match
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def some_docs():
    random.seed(8)
    words = ["alpha", "bétä", "gamma", "delta", "ž", "\0nul", "omega", "no", "a"]
    phrase = lambda n: " ".join(random.choice(words) for _ in range(n))
    shared = [phrase(n) for n in (12, 20, 60, 300)]
    docs = [(i, phrase(random.randint(0, 30)) + random.choice(shared)[random.randint(0, 20):] + phrase(random.randint(0, 30)) + random.choice(shared + [""])) for i in range(120)]
    docs += [(i, "start " + shared[0] + phrase(9) + f"{i}") for i in range(130, 170)]  # a passage that goes on differently
    docs += [(200, "a" * 500), (199, "b" + "a" * 300 + "ab" * 100), (201, "ab" * 90), (202, None), (203, ""), (204, "x" * 49), (205, "y" * 50), (206, "y" * 51), (None, shared[3]), (5, shared[3]), (5, shared[3])]
    return docs + [(207, docs[3][1]), (208, docs[3][1] + "!"), (0, "again " + docs[0][1])]


def found(df, **more):
    rows = suffixes.remove_repeats(df, **more).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    return sorted(map(tuple, rows), key=str)


def test_brute_force(spark):
    docs = some_docs()
    df = spark.createDataFrame(random.sample(docs, len(docs)), SCHEMA).withColumns({c: F.lit("x") for c in ("d", "t", "h", "x", "start", "found", "kept", "g")}).repartition(5)
    want = expected(docs, 50)
    assert sum(r[2] > 0 for r in want) > 60 and found(df) == want
    assert found(df, heavy=2) == want  # large keys go by single windows
    assert found(df, match=20) == expected(docs, 20) and found(df, match=33) == expected(docs, 33)
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_spans_give_the_kept_bytes(spark):
    docs = dict((d, t) for d, t in some_docs() if d is not None and d > 5)
    for r in suffixes.remove_repeats(spark.createDataFrame(list(docs.items()), SCHEMA)).collect():
        data, at, kept = (docs[r.doc_id] or "").encode(), 0, b""
        for s in r.spans:
            kept += data[at:s.first]
            at = s.last
        assert kept + data[at:] == bytes(r.kept) and sum(s.last - s.first for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def spans_in_process(docs, match=50, stretch=1 << 20, rows=1 << 17, merged=1 << 19, size=7, heavy=20_000):
    """The operator's steps over many small batches, without Spark."""
    keep = suffixes.STRETCH, suffixes.ROWS, suffixes.MERGED
    suffixes.STRETCH, suffixes.ROWS, suffixes.MERGED = stretch, rows, merged
    try:
        batches = [pa.RecordBatch.from_pydict({"d": [d for d, _ in docs[i:i + size]], "t": list(range(i, min(i + size, len(docs)))), "text": [t for _, t in docs[i:i + size]]},
                                              pa.schema([("d", pa.int64()), ("t", pa.int32()), ("text", pa.string())])) for i in range(0, len(docs), size)]
        chunk = lambda table: table.combine_chunks().to_batches(max_chunksize=size)
        pieces = pa.Table.from_batches(list(suffixes._cut_up(match)(batches)), suffixes.PIECE).sort_by([("h", "ascending"), ("x", "ascending"), ("d", "ascending")])
        got = pa.Table.from_batches(list(suffixes._groups()(chunk(pieces))), suffixes.FOUND).to_pylist()
        opened: dict = {}
        for r in got:
            if r["alone"]:
                opened.setdefault((r["d"], r["t"]), []).append({k: r[k] for k in ("start", "n", "lead")})
        texts = [{"d": d, "t": t, "text": docs[t][1], "found": f} for (d, t), f in opened.items()]
        parts = list(suffixes._parts(match)(chunk(pa.Table.from_pylist(texts)))) if texts else []
        parts = pa.Table.from_batches(parts, suffixes.PART).sort_by("g")
        more = [r for b in suffixes._merge(match, heavy)(chunk(parts)) for r in b.to_pylist()]
        low = {}
        for r in more:
            if r["window"] is not None:
                low[r["window"]] = min(low.get(r["window"], r["d"]), r["d"])
        assert bool(low) == (heavy < 100)
        more = [r for r in more if r["window"] is None or low[r["window"]] < r["d"]]
    finally:
        suffixes.STRETCH, suffixes.ROWS, suffixes.MERGED = keep
    gone = [bytearray(len(t.encode())) for _, t in docs]
    for r in [r for r in got if not r["alone"]] + more:
        n = r["n"] + match - 1
        gone[r["t"]][r["start"]: r["start"] + n] = b"\1" * n
    return gone


@pytest.mark.parametrize("match", [50, 31])
@pytest.mark.parametrize("limits", [{}, {"stretch": 60, "rows": 8, "merged": 200}, {"stretch": 97, "rows": 40, "merged": 1}, {"heavy": 9}, {"heavy": 4, "size": 3, "merged": 300}])
def test_small_batches(limits, match):
    docs = [(d, t) for d, t in some_docs() if d is not None and t]
    want = expected(docs, match)
    gone = spans_in_process(docs, match, **limits)
    got = sorted(((d, len(g), sum(g), sum(v and (not i or not g[i - 1]) for i, v in enumerate(g)),
                   hashlib.sha256(bytes(b for b, v in zip(t.encode(), g) if not v)).hexdigest()) for (d, t), g in zip(docs, gone)), key=str)
    assert got == want


def test_interleave_is_a_sort():
    """Merged order and common prefixes of several shards against sorted strings."""
    random.seed(1)
    for _ in range(30):
        shards = [["".join(random.choice("ab") for _ in range(random.randint(1, 12))).encode() for _ in range(random.randint(1, 6))] for _ in range(random.randint(1, 5))]
        built = [suffixes.Shard(s) for s in shards]
        depth = 4
        shard, common = suffixes.interleave([b.before for b in built], depth)
        next_of, rows = [iter([(s[o], p) for o, p in zip(b.owner[b.order], b.place[b.order])]) for s, b in zip(shards, built)], []
        for s in shard:
            text, place = next(next_of[s])
            rows.append(text[place:place + depth])
        assert len(rows) == sum(len(t) + 1 for s in shards for t in s)
        whole = [(i, r) for i, r in enumerate(rows) if len(r) == depth]
        assert [r for _, r in whole] == sorted(r for _, r in whole)
        for (i, a), (j, b) in zip(whole, whole[1:]):
            shared = next((k for k in range(depth) if a[k] != b[k]), depth)
            assert min(common[i + 1:j + 1]) == shared


def test_anchors():
    random.seed(3)
    h = np.array([random.randrange(1 << 40) << 24 for _ in range(300)], np.uint64) * np.uint64(pow(int(suffixes.M1), -1, 1 << 64))
    with np.errstate(over="ignore"):
        assert suffixes.anchors(h, 35).tolist() == [min(range(i, i + 35), key=lambda k: (int(h[k] * suffixes.M1) >> 24, k)) for i in range(300 - 34)]

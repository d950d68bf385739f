"""Operators against brute force or held-out labels on the small tables."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from adloom.llm import line_dedup, minhash
from adloom.llm.queries import QUERIES
from pyspark.sql import functions as F

import corpus_pipeline


def read(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


class Groups(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


@pytest.mark.parametrize("k", [2, 5])
def test_near_copies(spark, sf, k):
    rows = read(sf, "documents")
    sets = {}
    for r in rows:
        w = minhash.text_words(r["text"])
        sets[r["doc_id"]] = {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()
    groups, ids = Groups(), sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                groups.link(i, j)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), k).collect()}
    assert got == {i: (len(sets[i]), groups.root(i), groups.root(i) == i) for i in ids}


def test_distance(spark):
    random.seed(3)
    rows = []
    for _ in range(400):
        a = "".join(random.choice("abé") for _ in range(random.randint(1, 12)))
        b = "".join(c for c in a if random.random() > 0.2) + random.choice(["", "a", "é"])
        rows.append((a, b) if len(a) >= len(b) else (b, a))
    df = spark.createDataFrame([r for r in rows if r[1]], "a string, b string")
    for most in (1, 2, 3):
        assert df.filter(line_dedup.edit_distance(F.col("a"), F.col("b"), most) != F.least(F.levenshtein("a", "b"), F.lit(most + 1))).isEmpty()


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[i + 1:] == b[i + (len(a) == len(b)):]


def test_lines(spark):
    random.seed(5)
    base = ["".join(random.choice("abcd ") for _ in range(random.randint(8, 16))) for _ in range(20)]

    def changed(line):
        i = random.randrange(len(line))
        return random.choice([line, line[:i] + "é" + line[i:], line[:i] + line[i + 1:], line[:i] + "x" + line[i + 1:], line[:i] + "xyz" + line[i:]])
    docs = [(i, "\n".join(changed(changed(random.choice(base))) for _ in range(5))) for i in range(60)]
    spots = [(d, i, line) for d, text in docs for i, line in enumerate(text.split("\n")) if line.strip(" ")]
    groups, lines = Groups(), sorted({line for *_, line in spots})
    for n, a in enumerate(lines):
        for b in lines[:n]:
            if min(len(a), len(b)) >= 6 and one_edit(a, b):
                groups.link(a, b)
    seen, want = set(), {d: [] for d, _ in docs}
    for d, i, line in spots:
        if groups.root(line) in seen:
            want[d].append(i)
        seen.add(groups.root(line))
    got = {r.doc_id: list(r.repeated) for r in line_dedup.line_report(spark.createDataFrame(docs, "doc_id long, text string"), 1, 6).collect()}
    assert got == want


def test_decontamination(spark, sf):
    """Every document that holds a whole item word by word is found, and no document without half of an item's words in order."""
    strip = lambda t: [w for w in ("".join(c for c in x.lower() if c.isalnum()) for x in t.split()) if w]
    items = {r["item_id"]: strip(r["text"]) for r in read(sf, "benchmark")}
    found = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontamination"](spark, sf).collect()}
    for r in read(sf, "documents"):
        words = strip(r["text"])
        grams = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
        text = " " + " ".join(words) + " "
        for i, item in items.items():
            whole = " " + " ".join(item[1:]) + " " in text
            share = sum(tuple(item[p:p + 5]) in grams for p in range(len(item) - 4)) / (len(item) - 4)
            assert not whole or (r["doc_id"], i) in found
            assert share >= 0.5 or (r["doc_id"], i) not in found


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in read(sf, "labels")}
    rows = [r for r in QUERIES["op3_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in toxic]
    hit = [r.predicted for r in rows if toxic[r.doc_id] == 1]
    false = [r.predicted for r in rows if toxic[r.doc_id] == 0]
    assert sum(hit) / len(hit) > 0.6 and sum(false) / len(false) < 0.1


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    good = {r["doc_id"]: r["quality"] for r in read(sf, "labels")}
    kept = {r.doc_id: r.kept for r in QUERIES["op8_quality"](spark, sf).collect()}
    clean = [kept[i] for i, q in good.items() if q == 1]
    bad = [kept[i] for i, q in good.items() if q == 0]
    assert sum(clean) / len(clean) > 0.97 and sum(bad) / len(bad) < 0.4


def test_secrets_found(spark):
    sf = "/root/testdata/sf0.01"
    import re
    tokens = sum(len(re.findall(r'token = "[0-9a-f]{40}"', r["text"])) for r in read(sf, "documents"))
    rows = QUERIES["op2_secrets"](spark, sf).collect()
    secret = [r for r in rows if r.is_secret]
    assert tokens <= len(secret) <= 2 * tokens + 40 and len(secret) < len(rows)


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == columns, name
        assert {r.doc_id for r in got.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in read(sf, "documents")}
    assert len({texts[r.doc_id].lower() for r in rows}) == len(rows) > 100
    assert abs(sum(r.taken for r in rows) - 1.5 * sum(r["size"] for r in rows)) < 0.02 * sum(r["size"] for r in rows)


def test_parity_bits_exclude_no_link():
    draw = np.random.default_rng(5)
    for size in (1, 3, 40, 900, 5000):
        base = draw.integers(0, 2**63, size, dtype=np.uint64)
        sets = [np.unique(np.r_[base[draw.random(size) < 0.9], draw.integers(0, 2**63, size // 10, dtype=np.uint64)]) for _ in range(6)]
        bits = minhash.parity_bits(np.concatenate(sets), np.repeat(np.arange(6), [len(s) for s in sets]), 6)
        for i in range(6):
            for j in range(6):
                apart = sum(int(v & (2**64 - 1)).bit_count() for v in (bits[i] ^ bits[j]).tolist())
                assert apart <= len(np.setxor1d(sets[i], sets[j]))

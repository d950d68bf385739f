import random
import re
from types import SimpleNamespace

from pyspark.sql import functions as F

from adloom.functions.binding import let
from adloom.knowledge import templates
from adloom.llm import decontaminate, minhash
from adloom.operators import catalog, classify, creative, overlay, selection
from adloom.plans.campaigns import build_campaigns
from adloom.queries import creative as queries
from adloom.queries.inputs import products
from adloom.streaming.ledger import LISTS, AccountLedger

c = F.col


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_overlays_are_not_broadcast(spark, sf):
    """parsed overlays are many times their files, however small those are."""
    usable, _ = overlay.split_overlays(overlay.parse_overlay(queries.overlays(spark, sf)))
    base = catalog.with_campaign_id(products(spark, sf)).withColumn("score", F.lit(1))
    merged = plan(overlay.overlay_merge(base, usable))
    assert "BroadcastHashJoin" not in merged and "ShuffledHashJoin" in merged


def test_overlays_are_parsed_on_all_cores(spark, sf):
    """a catalog in one split was one task."""
    assert queries.overlays(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_documents_stay_where_their_campaign_is(spark, sf):
    rows = catalog.score_products(catalog.by_campaign(products(spark, sf)))
    assert rows.select("campaign_id").exceptAll(catalog.with_campaign_id(products(spark, sf)).select("campaign_id")).isEmpty()
    usable, _ = overlay.split_overlays(overlay.parse_overlay(queries.overlays(spark, sf)))
    merged = plan(overlay.overlay_merge(rows.select("campaign_id", "score"), usable))
    assert len(re.findall(r"Exchange hashpartitioning\(campaign_id", merged)) == 2  # products and overlays once each


def test_hot_key_is_joined_by_its_bits(spark):
    """F8: joined by the key alone, nearly all rows went to one task."""
    df = spark.range(5000).select(F.when(c("id") % 100 == 0, "cold").otherwise("hot").alias("k"), c("id").alias("i"))
    got = selection.sample_k(df, ["k"], "i", c("k"), 300)
    assert re.search(r"Join Inner, .*_b#\d+ = _kb#\d+", plan(got, "optimizedPlan"))
    assert {(r.k, r.n) for r in got.groupBy("k").agg(F.count("*").alias("n")).collect()} == {("cold", 50), ("hot", 300)}


def test_blocks_of_single_products_are_not_exchanged(spark, sf):
    """all texts of all products were exchanged and sorted."""
    one = catalog.enrich(products(spark, sf)).withColumn("twin", F.lit(False))
    label = lambda r: r["attrs"]["script"]
    made = creative.render_module(one, "beats", label, ["product_id"], "script")
    assert "ObjectHashAggregate" not in plan(made)
    beats = creative.expand_templates(one, "beats").withColumn("script", c("attrs")["script"])
    assert made.exceptAll(creative.render_group(beats, ["product_id", "script"])).isEmpty()
    assert made.count() == one.count() * len({label(r) for r in templates.BUILTIN["beats"]})


def test_blocks_of_repeated_products_hold_the_items_of_all_their_rows(spark, sf):
    some = products(spark, sf).filter("product_id < 6")
    twice = catalog.enrich(catalog.with_twins(some.unionByName(some.filter("product_id < 3").withColumn("name", F.lit("Otro nombre")))))
    for module, label in (("abtesting", lambda r: r.get("as_group", r["item_group"])), ("ads", lambda r: "")):
        items = creative.all_items(twice, [module]) if module == "abtesting" else creative.expand_templates(twice, module).withColumn("item_group", F.lit(""))
        want = creative.render_group(items, ["product_id", "item_group"])
        got = creative.render_module(twice, module, label, ["product_id"], "item_group")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_keywords_are_looked_up_by_their_first_characters(spark):
    """texts were cut once per keyword length."""
    words = [("a", 0, "x"), ("a", 0, "abc"), ("b", 1, "abcde"), ("b", 1, "zz"), ("c", 2, "abcdefghi"), ("c", 2, "ninguna")]
    texts = [(1, "abcdefghi " * 90 + "zz"), (2, "x" * 300), (3, "abcd"), (4, ""), (5, None), (6, "y" * 254 + "abcde")]
    got = classify.detect_category_by_grams(spark.createDataFrame(texts, "k int, t string"), "k", c("t"), spark.createDataFrame(words, "category_id string, ord int, keyword string"),
                                            sorted({len(w) for *_, w in words}), "none")
    scores = {k: {i: sum(len(w) for j, _, w in words if j == i and w in (t or "")) for i in "abc"} for k, t in texts}
    want = {k: max(s, key=lambda i: (s[i], -ord(i))) if any(s.values()) else "none" for k, s in scores.items()}
    assert {r.k: r.detected_id for r in got.collect()} == want
    assert "StartsWith(" in plan(got, "optimizedPlan")


def test_timer_gives_rows_and_writes_changed_accounts_only():
    """a pandas frame was made for every timer, and the account written whether it had changed or not."""
    written, held = [], [(7_200_000_000, 2, "view", None, False, "1970-01"), (3_600_000_001, 1, "nothing", None, False, "1970-01")]
    waiting = SimpleNamespace(get=lambda: iter(held), clear=lambda: written.append("clear"), put=written.append)
    account = SimpleNamespace(get=lambda: ("free", 3, "1970-01", 0), update=written.append)
    ledger = AccountLedger(3_600_000)
    ledger.waiting, ledger.account = [waiting] * LISTS, account
    out = list(ledger.handleExpiredTimer((5,), None, SimpleNamespace(getExpiryTimeInMs=lambda: 7_200_000)))
    assert [(r.event_id, r.user_id, r.ok, r.reason) for r in out] == [(1, 5, False, "bad_action")]
    assert written == [[held[0]]]


def test_bound_values_are_not_copied(spark):
    """a transformed array of one copied every bound value and result."""
    row = spark.range(3).select(let(F.array("id", c("id") * 2), lambda v: F.struct(F.get(v, 1).alias("x"), F.size(v).alias("n"))).alias("s"),
                                let(F.when(c("id") > 0, c("id")), lambda v: F.coalesce(v, F.lit(-1))).alias("z"))
    assert "transform" not in plan(row, "optimizedPlan")
    assert [(r.s.x, r.s.n, r.z) for r in row.orderBy("s.x").collect()] == [(0, 2, -1), (2, 2, 1), (4, 2, 2)]


def test_variants_quote_the_filled_hooks(spark, sf):
    """fifty hooks of each document were filled a second time."""
    some = catalog.enrich(products(spark, sf).filter("product_id < 5"))
    docs = build_campaigns(some, F.lit("2024-01-01").cast("timestamp"), enriched=True)
    quoted = docs.select("hooks").limit(0).withColumn("seed", F.lit("x")).select(creative.nested_ab_hooks(c("hooks")))
    assert quoted.schema[0].dataType == docs.schema["abhooks"].dataType
    shown = lambda rows: sorted((r.product_id, r.ord, r.title, r.text, r.detail) for r in rows)
    got = docs.select("product_id", F.inline("abhooks")).collect()
    want = creative.ab_variants(some).filter("item_group = 'Hooks'").select("product_id", "ord", "title", "text", "detail").collect()
    assert len(got) == 50 * some.count() and shown(got) == shown(want)


def copies(seed):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(4)]
    texts = []
    for i in range(90):
        words = list(bases[i % 4])
        for at in rng.sample(range(60), rng.choice([0, 1, 2, 4])):
            words[at] = f"x{rng.randrange(9)}"
        texts.append((i, " ".join(words)))
    return texts


def test_open_buckets_are_compared_by_pivots(spark, monkeypatch):
    """pipeline: all pairs of an open bucket were made. With one place per band nearly all texts meet in a bucket."""
    texts = copies(5)
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in texts}
    low = {i: i for i in sets}
    for _ in sets:
        for i, x in sets.items():
            for j, y in sets.items():
                if 100 * len(x & y) >= 80 * len(x | y):
                    low[i] = low[j] = min(low[i], low[j])
    for pivots, growth in ((1, 3), (minhash.PIVOTS, minhash.GROWTH)):
        monkeypatch.setattr(minhash, "PIVOTS", pivots)
        monkeypatch.setattr(minhash, "GROWTH", growth)
        got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 2, bands=160)
        assert {r.doc_id: r.component_id for r in got.collect()} == low


def test_compared_buckets_leave_the_rounds(spark, monkeypatch):
    """pipeline: buckets whose rows had all been pivots stayed open to the end, so the join with the bits made their rows in every round."""
    rounds, write = {}, minhash.staged

    def seen(df, folder, name):
        done = write(df, folder, name)
        if name.startswith("open-"):
            rounds[int(name[5:])] = [r.size for r in done.select("size").collect()]
        if name.startswith("second-"):
            rounds["plan"] = plan(df, "optimizedPlan")
        return done
    monkeypatch.setattr(minhash, "staged", seen)
    monkeypatch.setattr(minhash, "PIVOTS", 1)
    monkeypatch.setattr(minhash, "GROWTH", 4)
    minhash.near_duplicates(spark.createDataFrame(copies(5), "doc_id long, text string"), 2, bands=80)
    assert "collect_set" in rounds.pop("plan")  # a document's buckets are one row of that join
    assert len(rounds) > 2 and rounds[1] and all(size > 4 ** (turn - 1) for turn, sizes in rounds.items() if turn for size in sizes)


def test_rows_outside_the_largest_component_close_a_bucket(spark, monkeypatch):
    """op5, pipeline: each round made a row for every row of an open bucket, twice, though nearly all were of one component."""
    base = [f"w{i}" for i in range(60)]

    def changed(*at):
        return " ".join(f"x{i}" if i in at else w for i, w in enumerate(base))
    texts = [(0, changed()), *((i, changed(i)) for i in range(1, 41)), (41, changed(3, 8, 13, 18, 23)), (42, changed(5, 45, 49, 53))]
    rounds, write = [], minhash.staged

    def seen(df, folder, name):
        done = write(df, folder, name)
        if name.startswith("open-"):
            rounds.append(done.collect())
        return done
    monkeypatch.setattr(minhash, "staged", seen)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 2, bands=160).collect()}
    assert got == dict.fromkeys(range(43), 0) | {41: 41}  # 42 is linked with 5, not with the smallest id
    assert len(rounds) == 2 and len(rounds[0]) > 1000 and not rounds[1]  # at most two rows of a bucket are outside: one round
    large = [r for r in rounds[0] if r.size > 10]
    assert large and {r.id for r in large if r.pivot} == {41} and all(r.meets for r in large if r.id < 41)


def test_windows_of_documents_are_made_in_compiled_code(spark):
    """op6: every place of a text took several interpreted calls, and the openers were tried at every character."""
    items = spark.createDataFrame([(1, "the old red barn of seven doors stood near the wide river"), (2, "only three here"), (3, "Once")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "We saw that the old red barn of seven doors stood near the wide river"), (2, "so only three here"), (3, "once\x0bOnce"), (4, ""), (5, None)], "doc_id long, text string")
    found = decontaminate.contamination(docs, items)
    assert {(r.doc_id, r.item_id, r.first_word, r.last_word) for r in found.collect()} == {(1, 1, 3, 14), (2, 2, 1, 3), (3, 3, 0, 0)}
    assert "Generate posexplode(strict" in plan(found)


def test_bit_table_stands_in_the_plan_once_for_each_look_up(spark):
    """pipeline: the driver took too much memory; the plan of the decontamination had the table eight times."""
    items = spark.createDataFrame([(1, "the old red barn of seven doors stood near the wide river")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "We saw that the old red barn of seven doors stood near the wide river"), (2, "the old red barn"), (3, None)], "doc_id long, text string")
    found = decontaminate.contamination(docs, items)
    assert {(r.doc_id, r.item_id, r.first_word, r.last_word) for r in found.collect()} == {(1, 1, 3, 14)}
    assert plan(found, "optimizedPlan").count("getbit(") == 4


def test_patterns_that_look_at_one_character_first(spark):
    rng, parts = random.Random(4), ["Tom", "The", "Élan", "éa", "12", "3.5", "km", "KM", "%", ",", ".", "'", "-", "\x01", "\x01q", "\t", "\n", "\x85", "漢", "١", "", "B'", "/", "ß", *" " * 8]
    df = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))),) for _ in range(4000)], "s string")
    for p in ("NUMBER", "UNIT", "NAME", "MAYBE", "BARE", "MARKS", "ASIDE"):
        short = getattr(decontaminate, p)
        look = {"NUMBER": "(?![a-zA-Z ])", "BARE": "(?![a-zA-Z ])", "MARKS": "(?![a-z ])", "NAME": r"(?=\p{Lu})", "MAYBE": r"(?=\p{Lu})", "ASIDE": r"(?=\x01)", "UNIT": r"(?<=[ \t])"}[p]
        assert look in short
        assert df.filter(F.regexp_replace("s", short, "_") != F.regexp_replace("s", short.replace(look, "", 1), "_")).isEmpty()

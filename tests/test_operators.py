import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from adloom.functions import numbers, scoring, text, urls
from adloom.knowledge import rules as R
from adloom.knowledge import templates
from adloom.knowledge.categories import BUILTIN, RATINGS, load_categories
from adloom.operators import overlay, catalog, classify, creative, diagnosis, ledger, mining, selection
from adloom.plans.campaigns import SECTIONS, build_campaigns, campaign_markdown
from adloom.queries.inputs import products
from adloom.sources.documents import read_documents, write_documents
from adloom.sources.campaigns import read_campaigns_json, write_campaigns_json, write_markdown
from adloom.sources.products import read_products, split_valid

c = F.col

# Category -> price, anchor, level, meta, tiktok per coin, pinterest, raw score per coin.
GOLDEN = {
    "cocina": (34.95, 78, "Medio", 10, (9, 10), 7, (80.8, 84.0)), "hogar": (39.95, 94, "Alto", 10, (9, 10), 7, (84.8, 88.0)),
    "belleza": (59.95, 142, "Medio", 9, (9, 10), 7, (73.6, 76.8)), "fitness": (69.95, 158, "Medio", 8, (9, 10), 7, (71.2, 74.4)),
    "mascotas": (44.95, 110, "Alto", 10, (9, 10), 7, (84.8, 88.0)), "tecnologia": (64.95, 158, "Medio", 8, (7, 8), 7, (64.8, 68.0)),
    "bebe": (54.95, 126, "Muy alto", 10, (9, 10), 7, (82.4, 85.6)), "moda": (54.95, 126, "Medio", 10, (9, 10), 7, (80.8, 84.0)),
    "salud": (59.95, 142, "Alto", 8, (9, 10), 5, (68.8, 72.0)), "auto": (44.95, 110, "Muy alto", 9, (8, 9), 7, (76.0, 79.2)),
    "oficina": (54.95, 126, "Muy alto", 9, (8, 9), 7, (76.0, 79.2)), "general": (39.95, 94, "Alto", 9, (8, 9), 7, (72.0, 75.2)),
}


def test_golden_categories(spark):
    rows = [(cid, lo, hi, *r, coin) for cid, _, (lo, hi), r in RATINGS for coin in (0, 1)]
    df = spark.createDataFrame(rows, "id string, lo int, hi int, sat int, va int, ex int, ug int, coin int")
    base = numbers.half_up((c("va") + c("ug") + (5 - c("sat")) + c("ex")) / 4)
    viral = F.least(F.lit(5), base + c("coin"))
    ideas = scoring.content_ideas(c("va"))
    platform = scoring.platform_scores(viral, c("ex"), c("va"), c("ug"), c("sat"))
    raw = (ideas + viral + c("ex") + c("va") + c("ug")) / 25 * 80 + (5 - c("sat")) / 5 * 20
    out = df.select("id", "coin", F.round(scoring.recommended_price(c("lo"), c("hi")), 2), scoring.anchor_price(c("hi")),
                    scoring.scaling_level(c("sat")), platform[1]["score"], platform[0]["score"], platform[3]["score"], F.round(raw, 4)).collect()
    for cid, coin, price, anchor, level, meta, tiktok, pinterest, score in out:
        want = GOLDEN[cid]
        assert (price, anchor, level, meta, tiktok, pinterest, score) == (*want[:4], want[4][coin], want[5], want[6][coin])


def test_scores_stay_in_range(spark, sf):
    row = catalog.score_products(products(spark, sf)).agg(
        F.min("score"), F.max("score"), F.min("probability"), F.max("probability")).first()
    assert row[0] >= 35 and row[1] <= 98 and row[2] >= 25 and row[3] <= 95


def test_results_do_not_depend_on_partitions(spark, sf):
    def run(n):
        e = catalog.with_slots(catalog.score_products(products(spark, sf).repartition(n)))
        return sorted(creative.expand_templates(e, "ads").select("product_id", "ord", "text").collect())
    assert run(1) == run(7)


def test_counts_and_no_open_slots(spark, sf):
    items = creative.all_items(catalog.enrich(products(spark, sf)))
    assert items.filter(F.concat("title", "text", "detail").rlike(r"\{\w+\}|\x01")).count() == 0
    assert [len(templates.BUILTIN[m]) for m in ("hooks", "scripts", "beats", "visual", "imageprompts", "videoprompts")] == [116, 36, 216, 16, 18, 12]


def test_nested_equals_long(spark, sf):
    e = catalog.enrich(products(spark, sf))
    for module in ("ads", "landing", "offers"):
        nested = e.select("product_id", F.inline(creative.nested_module(module))).select("product_id", "ord", "title", "text", "detail")
        long = creative.expand_templates(e, module).select("product_id", "ord", "title", "text", "detail")
        assert nested.exceptAll(long).count() == 0 and nested.count() == long.count()


def test_text_edges(spark):
    rows = [(None,), ("",), ("  x  ",), ("Ünïcode ÑANDÚ de  la  casa ",), ("a b 😀",), ("Uno dos de 14",), ("uno: dos: tres",)]
    df = spark.createDataFrame(rows, "s string")
    out = [tuple(r) for r in df.select(text.short_name(c("s")), text.fold_accents(c("s")), text.name_or_default(c("s"))).collect()]
    assert out[0][2] == "este producto" and out[1] == ("", "", "este producto")
    assert out[3][:2] == ("Ünïcode ÑANDÚ", "unicode nandu de  la  casa ")
    assert out[4][0] == "a b 😀" and out[5][0] == "Uno dos"
    title, body = text.split_title(c("s"), F.lit("-"))
    assert tuple(df.select(title, body).collect()[6]) == ("uno", "dos: tres")


def test_urls(spark):
    rows = [("https://x.com/dp/Cool-Widget_Deluxe-123456789.html?a=1",), ("http://x.com/",), ("no url",), (None,), ("http://bad host/a",),
            ("https://AMZN.to/abc",), ("https://www.Shop.es/a/bb",)]
    df = spark.createDataFrame(rows, "u string")
    got = [tuple(r) for r in df.select(urls.guess_name(c("u")), urls.source_type(c("u")), urls.url_domain(c("u"))).collect()]
    assert got[0] == ("Cool Widget Deluxe", "tienda", "x.com")
    assert got[1][0] == "" and got[2] == ("", "manual", "no url") and got[3][1] == "manual"
    assert got[4][0] == "" and got[5][1] == "amazon" and got[6][2] == "shop.es"


def test_money_rounds_the_binary_value(spark):
    values = [34.95 * 1.7, 17.475, 1.005, 0.125, 2.675, 1234567.895, 59.95 / 2, 0.375, 43.6875]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(numbers.fixed2(c("x"))).collect()]
    assert got == ["59.42", "17.48", "1.00", "0.13", "2.67", "1234567.89" if f"{1234567.895:.2f}" == "1234567.89" else "1234567.90",
                   f"{59.95 / 2:.2f}", "0.38", "43.69"]


def test_detection_ties_and_default(spark):
    kb = [b for b in BUILTIN if b.id in ("hogar", "tecnologia", "general")]
    df = spark.createDataFrame([(1, "rod usb"), (2, "nothing"), (3, "LÁMPARA"), (4, None)], "id int, t string")
    got = {r[0]: r[1] for r in classify.detect_category(df, c("t"), kb).select("id", "detected_id").collect()}
    assert got == {1: "hogar", 2: "general", 3: "hogar", 4: "general"}


def test_knowledge_base_from_file(spark, tmp_path):
    from dataclasses import asdict
    path = tmp_path / "kb.json"
    path.write_text(json.dumps([asdict(b) for b in BUILTIN[-2:]]))
    assert [b.id for b in load_categories(str(path))] == ["oficina", "general"]
    path.write_text("[]")
    with pytest.raises(ValueError):
        load_categories(str(path))


SPENDS = "event_id long, ts timestamp, user_id long, action string"
PROFILES = "user_id long, plan_id string, credits int, period string, campaigns_this_month int"
CHANGES = "event_id long, ts timestamp, user_id long, plan_id string, keeps_counter boolean"


def trace(spark, actions, changes=(), months=None):
    rows = [(i, datetime(2024, (months or {}).get(i, 1), 1, 0, i), 1, a) for i, a in enumerate(actions) if a]
    profile = spark.createDataFrame([(1, "free", 10, "2024-01", 0)], PROFILES)
    changed = spark.createDataFrame([(i, datetime(2024, 1, 1, 0, i), 1, p, k) for i, p, k in changes], CHANGES) if changes else None
    out = ledger.credit_ledger(spark.createDataFrame(rows, SPENDS), profile, changed).orderBy("event_id").collect()
    return [(r.reason, r.credits, r.campaigns_this_month) for r in out]


def test_ledger_traces(spark):
    assert trace(spark, ["campaign", "campaign", "iteration"]) == [("", 0, 1), ("limit", 0, 1), ("credits", 0, 1)]
    assert trace(spark, ["iteration", "campaign", "competitor"]) == [("", 5, 0), ("credits", 5, 0), ("", 0, 0)]
    assert trace(spark, ["campaign", "campaign"], months={1: 2}) == [("", 0, 1), ("", 0, 1)]
    assert trace(spark, ["foo", "campaign"]) == [("bad_action", None, None), ("", 0, 1)]
    assert trace(spark, ["campaign", None, "campaign"], [(1, "premium", False)]) == [("", 0, 1), ("", 90, 1)]
    # A local change refills the credits but keeps the campaign count.
    assert trace(spark, ["campaign", None, "campaign", "iteration"], [(1, "free", True)]) == [("", 0, 1), ("limit", 10, 1), ("", 5, 1)]
    assert trace(spark, ["campaign", None, "campaign", None, "campaign"], [(1, "premium", True), (3, "max", True)]) == [
        ("", 0, 1), ("", 90, 2), ("", 490, 3)]


def simulate(events, profile):
    """Step-by-step run of one account: (id, ts, action, new_plan, keeps)."""
    limits, quota, cost = {"free": 1, "premium": 10, "max": 50}, {"free": 10, "premium": 100, "max": 500}, {"campaign": 10, "competitor": 5, "iteration": 5}
    plan, credits, period, n = profile
    out = {}
    for eid, ts, action, new_plan, keeps in sorted(events, key=lambda e: (e[1], e[0])):
        month = ts.strftime("%Y-%m")
        if month != period:
            period, credits, n = month, quota[plan], 0
        if new_plan:
            plan, credits, n = new_plan, quota[new_plan], n if keeps else 0
            continue
        reason = "limit" if action == "campaign" and n >= limits[plan] else "credits" if credits < cost[action] else ""
        if not reason:
            credits, n = credits - cost[action], n + (action == "campaign")
        out[eid] = (reason, credits, n)
    return out


def test_ledger_of_one_hot_account(spark):
    """One account holds nearly all events, with hundreds of changes and refusals in a month."""
    import random
    rng = random.Random(7)
    events, other = [], []
    for i in range(6000):
        ts = datetime(2024, 1 + rng.randrange(3), 1 + rng.randrange(28), rng.randrange(24), rng.randrange(60), rng.randrange(60))
        if rng.random() < 0.02:
            events.append((i, ts, None, rng.choice(["free", "premium", "max"]), rng.random() < 0.8))
        else:
            events.append((i, ts, rng.choice(["campaign", "campaign", "competitor", "iteration"]), None, False))
    spends = spark.createDataFrame([(e[0], e[1], 1, e[2]) for e in events if e[2]], SPENDS)
    changes = spark.createDataFrame([(e[0], e[1], 1, e[3], e[4]) for e in events if e[3]], CHANGES)
    profile = spark.createDataFrame([(1, "premium", 35, "2024-01", 4)], PROFILES)
    for chunk in ("1 hour", "10 days"):
        got = {r.event_id: (r.reason, r.credits, r.campaigns_this_month) for r in ledger.credit_ledger(spends, profile, changes, chunk).collect()}
        assert got == simulate(events, ("premium", 35, "2024-01", 4))
    plain = [e for e in events if e[2]]
    got = {r.event_id: (r.reason, r.credits, r.campaigns_this_month) for r in ledger.credit_ledger(spends, profile).collect()}
    assert got == simulate(plain, ("premium", 35, "2024-01", 4))


def test_ledger_plan_prunes_before_the_exchange(spark):
    spends = spark.createDataFrame([(1, datetime(2024, 1, 1), 1, "campaign")], SPENDS)
    profile = spark.createDataFrame([(1, "free", 10, "2024-01", 0)], PROFILES)
    plan = ledger.credit_ledger(spends, profile)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_top_k_with_one_hot_key(spark):
    df = spark.range(20_000).select(F.when(c("id") % 3 == 0, c("id")).otherwise(-1).alias("k"), "id")
    for k in (3, 1500):
        out = selection.top_k_per_key(df, ["k"], [c("id").desc()], k).filter("k = -1").agg(F.count("*"), F.min("id")).first()
        ids = sorted((i for i in range(20_000) if i % 3), reverse=True)[:k]
        assert tuple(out) == (k, ids[-1])


def test_mining_rules(spark):
    copy = "Compra ya\r\n\n¿Buscas ÚLTIMAS ofertas?\nGarantía de 30 días en todo\ncorta\nEnvío gratis hoy " + "z" * 90
    df = spark.createDataFrame([(1, "https://www.rival.com/a", "p", copy), (2, "rival", "p", None)], "doc_id int, url string, name string, text string")
    one, two = mining.competitor_report(df).orderBy("doc_id").collect()
    assert one.hooks[:2] == ["Compra ya", "¿Buscas ÚLTIMAS ofertas?"] and one.ctas == ["Compra ya", "¿Buscas ÚLTIMAS ofertas?"]
    assert one.guarantee == "Garantía de 30 días en todo" and one.offer.startswith("Envío gratis") and one.framework.startswith("rival.com → Compra ya")
    assert two.hooks == R.NO_HOOKS and two.storytelling == "no_text" and two.framework.startswith("rival → ")


def test_diagnosis_rules(spark):
    good = "Hook en el primer segundo, demo corta de quince segundos, precio y link claros al final del anuncio"
    rows = [("Abre con LOGO",), (good,), ("Dura 45 segundos con música de stock " + good,), ("VSL de 60 segundos " + good,), (None,)]
    got = [r[0] for r in diagnosis.diagnose(spark.createDataFrame(rows, "text string")).select("issues").collect()]
    assert got == [["short", "no_hook", "brand_intro", "no_close"], ["fine_tuning"], ["too_long", "generic_audio"], ["fine_tuning"],
                   ["short", "no_hook", "no_close"]]


def test_products_and_documents_round_trip(spark, sf, tmp_path):
    raw = products(spark, sf)
    raw.withColumn("name", F.concat(F.lit(" "), "name", F.lit("  "))).withColumn("source_type", F.lit("")).write.json(str(tmp_path / "p"))
    got = read_products(spark, str(tmp_path / "p"), "json")
    assert got.filter("name like ' %'").count() == 0
    ok, rejected = split_valid(got)
    assert ok.count() == raw.count() and rejected.count() == 0
    docs = build_campaigns(raw, F.lit("2024-03-05").cast("timestamp")).limit(20)
    write_campaigns_json(docs, str(tmp_path / "c"))
    (tmp_path / "c" / "part-bad.json").write_text('{"campaign_id": \n')
    good, bad = read_campaigns_json(spark, str(tmp_path / "c"), docs.schema)
    assert good.count() == 20 and bad.count() == 1
    marked = campaign_markdown(good)
    write_markdown(marked, str(tmp_path / "md"))
    write_markdown(marked, str(tmp_path / "each"), file_each=True)
    files = read_documents(spark, str(tmp_path / "each"), ".md")
    assert {r.text for r in files.collect()} == {r.markdown for r in marked.select("markdown").collect()} and files.count() == 20
    assert spark.read.json(str(tmp_path / "md")).count() == 20
    text_ = marked.first().markdown
    heads = [line for line in text_.split("\n") if line.startswith("## ")]
    assert heads[0] == "## Creative Score" and [h.split(".")[0] for h in heads[1:]] == [f"## {i}" for i in range(1, 16)]
    assert len(SECTIONS) == 11 and "5/3/2024" in text_ and "### 🔍 Curiosidad" in text_ and "16. " not in text_


def test_competitor_section(spark, sf):
    docs = build_campaigns(products(spark, sf), F.lit("2024-03-05").cast("timestamp")).limit(1)
    found = F.struct(F.lit("u").alias("url"), F.lit("f").alias("framework"), F.array(F.lit("x")).alias("counter_moves"))
    assert "## 16. Análisis de competidor" in campaign_markdown(docs.withColumn("competitor", found)).first().markdown


def test_document_sink_retries(spark, tmp_path):
    """A task that fails midway and runs again leaves nothing but whole files; a failed job leaves no attempts."""
    from adloom.sources.documents import DocumentWriter
    root, text_ = str(tmp_path / "docs"), "línea\n" * 1000
    rows = [("aa", f"d{i}", f"{i} {text_}") for i in range(20)]

    def failing():
        yield from rows[:7]
        raise RuntimeError("lost")
    writer = DocumentWriter(root, ".md")
    with pytest.raises(RuntimeError):
        writer.write(failing())
    messages = [writer.write(iter(rows)), writer.write(iter(rows[3:5])), None]
    assert (tmp_path / "docs" / "_temporary").exists()
    writer.commit(messages)
    names = sorted(str(p.relative_to(root)) for p in (tmp_path / "docs").rglob("*") if p.is_file())
    assert names == sorted(["_SUCCESS", *[f"aa/d{i}.md" for i in range(20)]]) and (tmp_path / "docs" / "aa" / "d3.md").read_text() == rows[3][2]
    with pytest.raises(RuntimeError):
        writer.write(failing())
    writer.abort([])
    assert not (tmp_path / "docs" / "_temporary").exists()
    df = spark.createDataFrame([("b/b", "ñ x", "uno"), ("c", "d", None)], "folder string, name string, text string")
    write_documents(df, "file:" + str(tmp_path / "more"), ".md")
    assert {tuple(r) for r in read_documents(spark, str(tmp_path / "more"), ".md").collect()} == {("b", "ñ x", "uno")}
    assert (tmp_path / "more" / "c" / "d.md").read_text() == ""
    with pytest.raises(Exception, match="document files have the columns"):
        df.select("name", "text").write.format("document_files").mode("append").save(str(tmp_path / "x"))


def test_overlay_faults_on_every_level(spark):
    import json
    good = {"problem": "p", "secondaryProblems": ["s"], "benefits": ["b"], "audiences": [{"name": "n", "description": "d", "pains": ["x"]}], "angles": [],
            "objections": [{"objection": "o", "response": "r"}], "differentiators": [], "pricing": {"recommended": "1", "range": "2", "strategy": "3", "marginNote": "4"},
            "scoreVerdict": "v", "scoreTotal": 7, "hooks": [{"category": "c", "items": ["i"]}], "landing": {"headline": "h", "subheadline": "s", "guarantee": "g"}, "ugcScripts": []}

    def bad(**more):
        return json.dumps(good | more)
    cases = {
        "a": (json.dumps(good), set()), "b": ("{", {("$", "malformed")}), "c": ("[1]", {("$", "wrong_type")}), "d": (bad(scoreTotal="7"), {("$.scoreTotal", "wrong_type")}),
        "e": (bad(audiences=[good["audiences"][0], {"name": "n", "description": 3, "pains": "x", "age": 1}]),
              {("$.audiences[1].description", "wrong_type"), ("$.audiences[1].pains", "wrong_type"), ("$.audiences[1].age", "unknown_field")}),
        "f": (bad(pricing=None, more=1), {("$.pricing", "missing_field"), ("$.more", "unknown_field")}), "g": (None, set()), "h": (bad(hooks=[{"items": [1]}]), {
            ("$.hooks[0].category", "missing_field"), ("$.hooks[0].items[0]", "wrong_type")})}
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "campaign_id string, json string")
    parsed = overlay.parse_overlay(df)
    found = {k: set() for k in cases}
    for r in overlay.quarantine(parsed).collect():
        found[r.campaign_id].add((r.path, r.error))
    assert found == {k: v[1] for k, v in cases.items()}
    rows = {r.campaign_id: r for r in parsed.collect()}
    assert [k for k in cases if rows[k].overlay is not None] == ["a"] and rows["f"].overlay_error == "unknown_field" and rows["a"].overlay.asDict(True) == good
    twice = parsed.filter("overlay IS NOT NULL").union(parsed.filter("overlay IS NOT NULL"))
    assert overlay.one_each(twice).count() == 1


def test_automaton_equals_the_literal_path(spark):
    """Ties, keywords inside keywords, shared keywords, accents, empty and null texts, no keywords at all."""
    rows = [("a", 0, "ring"), ("a", 0, "spring"), ("b", 1, "ring"), ("b", 1, "rin"), ("c", 2, "ñandu"), ("c", 2, "xx")]
    texts = ["A Spring RING", "rin", "xx rin", "ñandú ring", "", None, "nothing", "xxx spring spring"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    score = lambda t, ks: sum(len(k) for k in set(ks) if k in t)
    fold = {r.id: r.f or "" for r in df.select("id", text.fold_accents(c("t")).alias("f")).collect()}
    want = {}
    for i in fold:
        best = min(((-score(fold[i], [k for x, _, k in rows if x == cat]), o, cat) for cat, o in {(r[0], r[1]) for r in rows}))
        want[i] = (best[2], -best[0]) if best[0] else ("none", 0)
    got = classify.detect_category_by_automaton(df, c("t"), rows, "none")
    assert {r.id: (r.detected_id, r.detected_score) for r in got.collect()} == want
    table = spark.createDataFrame(rows, "category_id string, ord int, keyword string")
    assert classify.detect_category_by_automaton(df, c("t"), table, "none").exceptAll(got).isEmpty()
    assert {r.detected_id for r in classify.detect_category_by_automaton(df, c("t"), table.limit(0), "none").collect()} == {"none"}
    with pytest.raises(ValueError, match="characters of keywords"):
        classify.detect_category_by_automaton(df, c("t"), [("a", 0, "k" * 6_000_000)], "none")


def test_samples_of_any_size(spark):
    """A hot key, small keys, a null key, k above the key's rows; every row once."""
    import hashlib
    rows = [(None if i % 50 == 0 else "hot" if i % 10 else f"k{i % 7}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, i long").withColumn("seed", F.coalesce("k", F.lit("-")))
    for k in (1, 5, 3000, 100_000):
        want = set()
        for key in {r[0] for r in rows}:
            own = sorted((hashlib.md5(f"{key or '-'}|{i}".encode()).hexdigest(), i) for x, i in rows if x == key)
            want |= {(key, i, n) for n, (_, i) in enumerate(own[:k], start=1)}
        got = selection.sample_k(df, ["k"], "i", c("seed"), k).select("k", "i", "rank").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_counts_inside_a_row(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["x"])], "id int, v array<string>")
    got = {r.id: None if r.c is None else [tuple(x) for x in r.c] for r in df.select("id", text.counted(c("v")).alias("c")).collect()}
    assert got == {1: [("a", 1), ("b", 2)], 2: [], 3: None, 4: [("x", 1)]}

"""Classification, scores, prices and offers over the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom.functions import numbers, scoring
from adloom.functions.seeded import seeded_int, seeded_pick
from adloom.knowledge.categories import BUILTIN
from adloom.operators import catalog, classify, reports, selection
from adloom.queries import sqlkit as S
from adloom.queries.inputs import products, table
from adloom.queries.registry import query
from adloom.sources.static import static_table

c = F.col


def scored(spark, sf):
    return catalog.score_products(products(spark, sf))


@query("detect_category", S.resolved_sql("SELECT product_id, detected_id, detected_score FROM detected"))
def _(spark, sf):
    text = F.concat_ws(" ", "name", "description", "source_url")
    return classify.detect_category(products(spark, sf), text).select("product_id", "detected_id", "detected_score")


@query("detect_category_documents", S.with_ctes(S.kw_cte()) + """,
h AS (SELECT doc_id, category_id, ord, sum(length(keyword)) AS score
  FROM documents JOIN kw ON contains(strip_accents(lower(text)), keyword) GROUP BY ALL)
SELECT d.doc_id, coalesce(arg_max(category_id, (score, -ord)), 'general') AS detected_id, coalesce(max(score), 0)::INTEGER AS detected_score
FROM documents d LEFT JOIN h USING (doc_id) GROUP BY 1""")
def _(spark, sf):
    """Long texts against the built-in keywords."""
    docs = table(spark, sf, "documents")
    return classify.detect_category_by_automaton(docs, c("text"), builtin_keywords(), "general").select("doc_id", "detected_id", "detected_score")


def builtin_keywords() -> list[tuple]:
    return [(b.id, i, k) for i, b in enumerate(BUILTIN) for k in b.keywords]


#: Word parts by whose combinations 20,000 keywords are made, in ten categories.
STEMS = "an er th on in re at st en ti or ng al ed ha is ou le nd ve".split()
MANY = len(STEMS) ** 3 * 5 // 2


@query("detect_category_automaton", S.resolved_sql("SELECT product_id, detected_id, detected_score FROM detected"))
def _(spark, sf):
    """The path for keywords of any number, with the built-in ones."""
    text = F.concat_ws(" ", "name", "description", "source_url")
    return classify.detect_category_by_automaton(products(spark, sf), text, builtin_keywords(), "general").select("product_id", "detected_id", "detected_score")


@query("detect_category_many_keywords", f"""
WITH s AS (SELECT {S.lit(STEMS)} AS s), kw AS (SELECT i % 10 AS ord, s[i % 20 + 1] || s[i // 20 % 20 + 1] || s[i // 400 % 20 + 1] || s[i // 8000 + 1] AS keyword FROM s, range({MANY}) r(i)),
f AS MATERIALIZED (SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents),
h AS (SELECT doc_id, ord, sum(length(keyword)) AS score FROM f JOIN kw ON contains(folded, keyword) GROUP BY ALL)
SELECT d.doc_id, coalesce('c' || arg_max(ord, (score, -ord)), 'none') AS detected_id, coalesce(max(score), 0)::INTEGER AS detected_score FROM documents d LEFT JOIN h USING (doc_id) GROUP BY 1""")
def _(spark, sf):
    """20,000 keywords from a table."""
    i = c("id")
    stems = F.array(*[F.lit(x) for x in STEMS])
    at = lambda n: F.get(stems, n.cast("int"))
    keyword = F.concat(at(i % 20), at(F.floor(i / 20) % 20), at(F.floor(i / 400) % 20), at(F.floor(i / 8000)))
    keywords = spark.range(MANY).select(F.concat(F.lit("c"), (i % 10).cast("string")).alias("category_id"), (i % 10).cast("int").alias("ord"), keyword.alias("keyword"))
    return classify.detect_category_by_automaton(table(spark, sf, "documents"), c("text"), keywords, "none").select("doc_id", "detected_id", "detected_score")


@query("detect_category_by_grams", S.resolved_sql("SELECT product_id, detected_id FROM detected"))
def _(spark, sf):
    rows = [(b.id, i, k) for i, b in enumerate(BUILTIN) for k in b.keywords]
    keywords = static_table(spark, rows, "category_id string, ord int, keyword string")
    lengths = sorted({len(r[2]) for r in rows})
    text = F.concat_ws(" ", "name", "description", "source_url")
    return classify.detect_category_by_grams(products(spark, sf), "product_id", text, keywords, lengths, "general").select(
        "product_id", "detected_id")


@query("keyword_score", S.with_ctes(S.kw_cte()) + """
SELECT p_partkey, coalesce(sum(length(keyword)), 0)::INTEGER AS score FROM part LEFT JOIN kw ON contains(p_name || ' gadget usb', keyword) AND category_id = 'tecnologia'
GROUP BY 1""")
def _(spark, sf):
    words = next(b.keywords for b in BUILTIN if b.id == "tecnologia")
    text = F.concat("p_name", F.lit(" gadget usb"))
    return table(spark, sf, "part").select("p_partkey", classify.keyword_score(text, F.array(*map(F.lit, words))).alias("score"))


@query("argmax_first", "SELECT p_brand, arg_max(p_partkey, (p_size, -p_partkey)) AS p_partkey FROM part GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(
        classify.argmax_first(c("p_partkey"), c("p_size"), c("p_partkey")).alias("p_partkey"))


@query("category_lookup", S.with_ctes(S.kb_cte(), S.PRODUCTS) + """
SELECT product_id, k.id AS category_id, k.price_lo, k.price_hi FROM products JOIN kb k
  ON k.id = CASE WHEN category_id IN (SELECT id FROM kb) THEN category_id ELSE 'general' END""")
def _(spark, sf):
    known = products(spark, sf).withColumn("category_id", classify.known_or_last(c("category_id")))
    from adloom.sources.static import load_kb
    kb = load_kb(spark).select("id", "price_lo", "price_hi")
    return classify.category_lookup(known, kb, "category_id").select("product_id", "category_id", "price_lo", "price_hi")


@query("resolve_category", S.resolved_sql("SELECT product_id, resolved_id FROM resolved"))
def _(spark, sf):
    return classify.resolve_category(products(spark, sf)).select("product_id", "resolved_id")


@query("content_ideas", S.scored_sql("SELECT product_id, content_ideas FROM scored"))
def _(spark, sf):
    return scored(spark, sf).select("product_id", c("content_ideas"))


@query("viral_potential", S.scored_sql("SELECT product_id, viral_potential FROM scored"))
def _(spark, sf):
    return scored(spark, sf).select("product_id", "viral_potential")


@query("creative_score", S.scored_sql("SELECT product_id, score FROM scored"))
def _(spark, sf):
    return scored(spark, sf).select("product_id", "score")


METRICS = ", ".join(f"{{'ord': {i}, 'label': {S.lit(n)}, 'stars': {e}, 'note': CASE WHEN {e} >= {t} THEN {S.lit(y)} ELSE {S.lit(o)} END}}"
                    for i, (n, e, t, y, o) in enumerate([
    ("Contenido posible", "content_ideas", 5, "Muchos formatos posibles", "Unos cuantos formatos"),
    ("Potencial viral", "viral_potential", 4, "El efecto se ve enseguida", "Necesita un buen gancho"),
    ("Saturación", "saturation", 4, "Mercado lleno: destaca por creativo", "Queda hueco en el mercado"),
    ("Facilidad de explicar", "explainability", 4, "Se entiende solo", "Pide una frase de contexto"),
    ("Visualmente atractivo", "visual_appeal", 4, "Luce en cámara", "Apóyate en personas"),
    ("UGC potencial", "ugc_fit", 4, "Fácil para creadores", "Hará falta guion")], start=1))


@query("score_metrics", S.scored_sql(f"SELECT product_id, m.ord AS ord, m.label AS label, m.stars AS stars, m.note AS note FROM (SELECT product_id, unnest([{METRICS}]) AS m FROM scored)"))
def _(spark, sf):
    rows = scoring.score_metrics(c("content_ideas"), c("viral_potential"), c("saturation"), c("explainability"), c("visual_appeal"), c("ugc_fit"))
    return scored(spark, sf).select("product_id", F.inline(rows))


@query("platform_scores", S.with_ctes(S.kb_cte(), S.kw_cte(), S.PRODUCTS, S.DETECTED, S.SCORED) + """,
t AS (SELECT *, least(10, floor((viral_potential + ugc_fit) * 0.95::DOUBLE + 0.5 + 0.5))::INTEGER AS tiktok,
  least(10, floor((explainability + visual_appeal) * 0.9::DOUBLE + (5 - saturation) * 0.2::DOUBLE + 1 + 0.5))::INTEGER AS meta FROM scored)
SELECT product_id, 'TikTok' AS name, tiktok AS score, CASE WHEN tiktok >= 8 THEN 'Primera opción' ELSE 'Solo con ganchos fuertes' END AS note FROM t
UNION ALL SELECT product_id, 'Meta Ads', meta, CASE WHEN meta >= 8 THEN 'Apta para público frío' ELSE 'Mejor en retargeting' END FROM t
UNION ALL SELECT product_id, 'YouTube Shorts', greatest(5, least(10, tiktok - 1)), 'Reutiliza lo que funcione' FROM t
UNION ALL SELECT product_id, 'Pinterest', CASE WHEN visual_appeal >= 4 THEN 7 ELSE 5 END,
  CASE WHEN visual_appeal >= 4 THEN 'Canal de apoyo' ELSE 'Canal menor' END FROM t""")
def _(spark, sf):
    rows = scoring.platform_scores(c("viral_potential"), c("explainability"), c("visual_appeal"), c("ugc_fit"), c("saturation"))
    return scored(spark, sf).select("product_id", F.inline(rows)).drop("ord")


@query("score_verdict", S.scored_sql("""SELECT product_id, CASE WHEN score >= 85 THEN 'Excelente: entra con fuerza'
  WHEN score >= 70 THEN 'Sólido: diferénciate por creativo' ELSE 'Exigente: prueba con poco presupuesto' END AS verdict FROM scored"""))
def _(spark, sf):
    return scored(spark, sf).select("product_id", scoring.score_verdict(c("score")).alias("verdict"))


FACTORS = [("Efecto rápido", "visual_appeal >= 4"), ("Claro sin sonido", "explainability >= 4"), ("Invita a comentar", "TRUE"),
           ("Saturación del feed", None), ("Fácil de replicar", "ugc_fit >= 4"), ("Emoción para compartir", "TRUE")]
FACTOR_SQL = " UNION ALL ".join(
    f"SELECT product_id, {S.lit(n)} AS factor, " + (f"CASE WHEN {t} THEN 'Positivo' ELSE 'Neutro' END" if t
    else "CASE WHEN saturation >= 4 THEN 'Negativo' ELSE 'Positivo' END") + " AS impact FROM scored" for n, t in FACTORS)
NOTE_SQL = "CASE factor " + " ".join(f"WHEN {S.lit(n)} THEN CASE WHEN impact = 'Positivo' THEN {S.lit(a)} ELSE {S.lit(b)} END" for n, (a, b) in scoring.FACTOR_NOTES.items()) + " END"


@query("viral_factors", S.scored_sql(f"SELECT *, {NOTE_SQL} AS note FROM ({FACTOR_SQL})"))
def _(spark, sf):
    return scored(spark, sf).select("product_id", F.inline("factors")).drop("ord")


@query("impact_tone", S.scored_sql(f"""SELECT product_id, factor, CASE impact WHEN 'Positivo' THEN 'ok' WHEN 'Negativo' THEN 'bad'
  ELSE 'default' END AS tone FROM ({FACTOR_SQL})"""))
def _(spark, sf):
    rows = scored(spark, sf).select("product_id", F.inline("factors"))
    return rows.select("product_id", "factor", numbers.impact_tone(c("impact")).alias("tone"))


@query("factor_counts", S.scored_sql("SELECT product_id, positives, negatives FROM scored"))
def _(spark, sf):
    return scored(spark, sf).select("product_id", scoring.count_impact(c("factors"), "Positivo").alias("positives"),
                                    scoring.count_impact(c("factors"), "Negativo").alias("negatives"))


@query("viral_probability", S.scored_sql("SELECT product_id, probability FROM scored"))
def _(spark, sf):
    return scored(spark, sf).select("product_id", "probability")


@query("viral_verdict", S.scored_sql("""SELECT product_id, CASE WHEN probability >= 75 THEN 'Alto: cuida el gancho'
  WHEN probability >= 55 THEN 'Medio-alto: publica volumen' ELSE 'Moderado: busca conversión' END AS verdict FROM scored"""))
def _(spark, sf):
    return scored(spark, sf).select("product_id", scoring.viral_verdict(c("probability")).alias("verdict"))


@query("recommended_price", S.scored_sql("SELECT product_id, round(recommended_price, 2) AS price FROM scored"))
def _(spark, sf):
    return scored(spark, sf).select("product_id", F.round("recommended_price", 2).alias("price"))


@query("price_strategy", S.scored_sql(f"""SELECT product_id, {S.money('recommended_price')} || ' USD' AS recommended,
  '$' || price_lo || '–$' || price_hi || ' USD' AS price_range, floor(price_hi * 1.6::DOUBLE + 0.5)::INTEGER AS anchor,
  30 AS second_unit_discount, 65 AS target_margin FROM scored"""))
def _(spark, sf):
    prices = scoring.price_strategy(c("price_lo"), c("price_hi"), c("recommended_price"))
    return scored(spark, sf).select("product_id", prices.alias("s")).select(
        "product_id", "s.recommended", c("s.range").alias("price_range"), "s.anchor", "s.second_unit_discount", "s.target_margin")


@query("scaling_level", S.scored_sql(f"""SELECT product_id, CASE WHEN saturation <= 2 THEN 'Muy alto' WHEN saturation = 3 THEN 'Alto' ELSE 'Medio' END AS level,
  CASE WHEN saturation >= 4 THEN 'Demanda probada con mucha competencia' ELSE 'Hay demanda y queda espacio' END || ' (' || saturation || '/5)' AS reason,
  {S.lit(', '.join(scoring.SCALING_CHANNELS))} AS channels FROM scored"""))
def _(spark, sf):
    return scored(spark, sf).select("product_id", scoring.scaling_level(c("saturation")).alias("level"),
                                    scoring.scaling_reason(c("saturation")).alias("reason"), F.lit(", ".join(scoring.SCALING_CHANNELS)).alias("channels"))


@query("offer_math", S.scored_sql("""
SELECT product_id, '2x1' AS offer, round(recommended_price * 1.7::DOUBLE, 4) AS price, NULL::DOUBLE AS value, NULL::INTEGER AS saving_pct FROM scored
UNION ALL SELECT product_id, 'Bundle', round(recommended_price * 1.25::DOUBLE, 4), round(recommended_price * 1.4::DOUBLE + 9.95::DOUBLE, 4),
  floor((recommended_price * 1.4::DOUBLE + 9.95::DOUBLE - recommended_price * 1.25::DOUBLE) / (recommended_price * 1.4::DOUBLE + 9.95::DOUBLE) * 100 + 0.5)::INTEGER FROM scored
UNION ALL SELECT product_id, 'Compra 2 y recibe...', round(recommended_price / 2, 4), round(recommended_price, 4), NULL FROM scored
UNION ALL SELECT product_id, 'Regalo gratis', 3.0, 14.95, NULL FROM scored
UNION ALL SELECT product_id, 'Descuento progresivo', round(recommended_price * 1.6::DOUBLE, 4), round(recommended_price * 2.1::DOUBLE, 4), NULL FROM scored
UNION ALL SELECT product_id, 'Urgencia', round(recommended_price, 4), round(recommended_price * 1.4::DOUBLE, 4), NULL FROM scored
UNION ALL SELECT product_id, 'Escasez', NULL, NULL, NULL FROM scored"""))
def _(spark, sf):
    rows = scored(spark, sf).select("product_id", F.inline(scoring.offer_math(c("recommended_price"))))
    return rows.select("product_id", "offer", F.round("price", 4).alias("price"), F.round("value", 4).alias("value"), "saving_pct")


@query("category_distribution", S.scored_sql("""SELECT resolved_id AS category_id, count(*) AS products, round(avg(score), 4) AS mean_score,
  round(avg(recommended_price), 4) AS mean_price FROM scored GROUP BY 1"""))
def _(spark, sf):
    return reports.category_distribution(scored(spark, sf))


@query("top_products", S.scored_sql("SELECT product_id, name, score, CASE WHEN score >= 80 THEN 'green' WHEN score >= 60 THEN 'amber' ELSE 'red' END AS band FROM scored ORDER BY score DESC, product_id LIMIT 20"))
def _(spark, sf):
    best = selection.top_rows(scored(spark, sf).select("product_id", "name", "score"), [c("score").desc(), c("product_id")], 20)
    return best.withColumn("band", numbers.score_band(c("score")))


@query("seeded_int", S.products_sql(f"SELECT product_id, {S.seeded_int('name || source_url', 'demo', 7, 30)} AS n FROM products"))
def _(spark, sf):
    return products(spark, sf).select("product_id", seeded_int(F.concat("name", "source_url"), "demo", 7, 30).alias("n"))


@query("seeded_pick", S.with_ctes(S.kb_cte(), "kbp AS (SELECT p_partkey, p_name, k.fears FROM part JOIN kb k ON k.ord = p_partkey % 12)")
       + f"\nSELECT p_partkey, {S.pick(S.draw(S.digest('p_name', S.lit('fear'))), 'fears')} AS fear FROM kbp")
def _(spark, sf):
    from adloom.queries.text import kb_parts
    return kb_parts(spark, sf).select("p_partkey", seeded_pick(c("p_name"), "fear", c("fears")).alias("fear"))


@query("sampled_benefits", S.enriched_sql("SELECT product_id, generate_subscripts(b, 1) - 1 AS pos, unnest(b) AS benefit FROM enriched"))
def _(spark, sf):
    return catalog.enrich(products(spark, sf)).select("product_id", F.posexplode("b").alias("pos", "benefit"))


@query("sample_k", """
SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(source || '|' || doc_id::VARCHAR), doc_id) AS rank FROM documents)
WHERE rank <= 5""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id")
    return selection.sample_k(docs, ["source"], "doc_id", c("source"), 5)


@query("sample_k_large", """
SELECT heat, line, rank FROM (SELECT *, row_number() OVER (PARTITION BY heat ORDER BY md5(heat || '|' || line), line) AS rank
  FROM (SELECT CASE WHEN l_orderkey % 100 = 0 THEN 'cold' ELSE 'hot' END AS heat, l_orderkey || '-' || l_linenumber AS line FROM lineitem)) WHERE rank <= 50000""")
def _(spark, sf):
    """50,000 rows of a key that holds nearly all."""
    line = F.concat_ws("-", c("l_orderkey").cast("string"), c("l_linenumber").cast("string"))
    lines = table(spark, sf, "lineitem").select(F.when(c("l_orderkey") % 100 == 0, "cold").otherwise("hot").alias("heat"), line.alias("line"))
    return selection.sample_k(lines, ["heat"], "line", c("heat"), 50_000)

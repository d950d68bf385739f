"""Scalar projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom.functions import numbers, text, urls
from adloom.operators import filters
from adloom.queries import sqlkit as S
from adloom.queries.inputs import products, table
from adloom.queries.registry import query
from adloom.session import shared_dir
from adloom.sources import products as source
from adloom.sources.static import category_pains, kb_values, load_kb

SOURCE_CASE = """CASE WHEN coalesce(source_url, '') = '' THEN 'manual' WHEN contains(lower(source_url), 'aliexpress') THEN 'aliexpress'
  WHEN contains(lower(source_url), 'amazon') OR contains(lower(source_url), 'amzn.') THEN 'amazon'
  WHEN contains(lower(source_url), 'tiktok') THEN 'tiktok' WHEN contains(lower(source_url), 'shopify') THEN 'shopify'
  WHEN starts_with(lower(source_url), 'http') THEN 'tienda' ELSE 'manual' END"""
LABEL_CASE = "CASE {} " + " ".join(f"WHEN {S.lit(k)} THEN {S.lit(v)}" for k, v in urls.SOURCE_LABELS.items()) + " END"

# Name guessed from the URL, as CTEs that end in guesses(product_id, guess).
GUESS = r"""
segs AS (
  SELECT product_id, list_filter(string_split(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '') AS s
  FROM products),
slugs AS (
  SELECT product_id, coalesce(list_filter(s, lambda x: length(x) > 12 AND contains(x, '-'))[1],
    list_filter(s, lambda x: length(x) = list_max(list_transform(s, lambda y: length(y))))[1], '') AS g FROM segs),
cleaned AS (
  SELECT product_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    g, '\.html?$', '', 'i'), '\d{6,}', '', 'g'), '[-_+]', ' ', 'g'), '\b(dp|item|products?|product|detail|itm|ref|gp)\b', '', 'gi'), '\s+', ' ', 'g')) AS g
  FROM slugs),
guesses AS (
  SELECT product_id, CASE WHEN length(g) < 4 THEN '' ELSE array_to_string(list_transform(string_split(g, ' '),
    lambda w: CASE WHEN length(w) > 2 THEN upper(w[1]) || w[2:] ELSE w END), ' ') END AS guess FROM cleaned)"""


@query("read_products", S.products_sql("SELECT *, '' AS source_type FROM products"))
def _(spark, sf):
    """The catalog as JSON lines with blanks around its texts, through the reader."""
    folder = shared_dir(spark, "products")
    raw = products(spark, sf).withColumns({"name": F.concat(F.lit("\t "), "name", F.lit("  ")), "source_type": F.lit("")})
    raw.write.json(f"{folder}/json")
    return source.read_products(spark, f"{folder}/json", "json")


@query("valid_products", S.with_ctes(S.PRODUCTS, GUESS) + """
SELECT product_id, coalesce(nullif(trim(CASE WHEN product_id % 4 = 0 THEN ' ' ELSE name END), ''), nullif(guess, '')) AS name,
  CASE WHEN coalesce(nullif(trim(CASE WHEN product_id % 4 = 0 THEN ' ' ELSE name END), ''), nullif(guess, '')) IS NULL
    THEN 'missing_name' END AS reject_reason
FROM products JOIN guesses USING (product_id)""")
def _(spark, sf):
    blanked = products(spark, sf).withColumn("name", F.when(F.col("product_id") % 4 == 0, " ").otherwise(F.col("name")))
    return source.with_final_name(blanked).select("product_id", "name", "reject_reason")


@query("source_type", S.products_sql(f"SELECT product_id, source_url, {SOURCE_CASE} AS source_type FROM products"))
def _(spark, sf):
    return products(spark, sf).select("product_id", "source_url", urls.source_type(F.col("source_url")).alias("source_type"))


@query("source_type_with_image", S.products_sql(f"""SELECT product_id, CASE WHEN image_data_url IS NOT NULL AND source_url = ''
  THEN 'imagen' ELSE {SOURCE_CASE} END AS source_type FROM products"""))
def _(spark, sf):
    return source.with_source_type(products(spark, sf)).select("product_id", "source_type")


@query("source_label", S.products_sql(f"SELECT product_id, {LABEL_CASE.format('(' + SOURCE_CASE + ')')} AS label FROM products"))
def _(spark, sf):
    return products(spark, sf).select("product_id", urls.source_label(urls.source_type(F.col("source_url"))).alias("label"))


@query("guess_name", S.with_ctes(S.PRODUCTS, GUESS) + "\nSELECT product_id, guess FROM guesses")
def _(spark, sf):
    return products(spark, sf).select("product_id", urls.guess_name(F.col("source_url")).alias("guess"))


@query("longest_segment", S.products_sql(r"""
SELECT product_id, list_filter(s, lambda x: length(x) = list_max(list_transform(s, lambda y: length(y))))[1] AS segment
FROM (SELECT product_id, list_filter(string_split(source_url, '/'), lambda s: s <> '') AS s FROM products)"""))
def _(spark, sf):
    parts = F.filter(F.split("source_url", "/"), lambda s: s != "")
    return products(spark, sf).select("product_id", urls.longest_segment(parts).alias("segment"))


LONG_NAME_SQL = """parts AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' de la ' || lower(p_type)
  WHEN 2 THEN p_name || ' 14 x ' || p_brand ELSE '  ' || p_name || ' Para  todos los dias' END AS long_name FROM part)"""


def long_names(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", (
        F.when(k % 4 == 0, n).when(k % 4 == 1, F.concat(n, F.lit(" de la "), F.lower("p_type")))
        .when(k % 4 == 2, F.concat(n, F.lit(" 14 x "), F.col("p_brand")))
        .otherwise(F.concat(F.lit("  "), n, F.lit(" Para  todos los dias")))).alias("long_name"))


@query("short_name", S.with_ctes(LONG_NAME_SQL, S.short_name_ctes("parts", "p_partkey", "long_name", "shorts")) + "\nSELECT p_partkey, p AS short_name FROM shorts")
def _(spark, sf):
    return long_names(spark, sf).select("p_partkey", text.short_name(F.col("long_name")).alias("short_name"))


@query("name_or_default", """SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size > 25 THEN '  ' ELSE p_name END), ''), 'este producto') AS name FROM part""")
def _(spark, sf):
    name = F.when(F.col("p_size") > 25, "  ").otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", text.name_or_default(name).alias("name"))


@query("fold_accents", "SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.fold_accents(F.col("text")).alias("folded"))


@query("url_domain", r"""
SELECT page_id, CASE WHEN u LIKE '%://%' THEN regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?#:]+)', 1)), 'www\.', '') ELSE u END AS domain
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'sin url' WHEN 1 THEN replace(url, '://', '://www.') ELSE url END AS u FROM pages)""")
def _(spark, sf):
    k = F.col("page_id") % 4
    u = F.when(k == 0, "sin url").when(k == 1, F.replace("url", F.lit("://"), F.lit("://www."))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", urls.url_domain(u).alias("domain"))


@query("slugify", "SELECT p_partkey, substr(regexp_replace(lower(p_name || ' ' || p_brand || ' & ' || p_type || ' edición especial'), '[^a-z0-9]+', '-', 'g'), 1, 40) AS slug FROM part")
def _(spark, sf):
    name = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" & "), "p_type", F.lit(" edición especial"))
    return table(spark, sf, "part").select("p_partkey", text.slugify(name).alias("slug"))


@query("encode_component", "SELECT p_partkey, " + S.encode("p_name || ' (' || p_brand || ') *ñ~!''+&'") + " AS encoded FROM part")
def _(spark, sf):
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") *ñ~!'+&"))
    return table(spark, sf, "part").select("p_partkey", text.encode_component(name).alias("encoded"))


@query("money", "SELECT p_partkey, " + S.money("p_retailprice * 1.7::DOUBLE / 4") + " AS price FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", numbers.money(F.col("p_retailprice") * 1.7 / 4).alias("price"))


@query("parse_money", r"""
SELECT p_partkey, coalesce(nullif(try_cast(regexp_extract(regexp_replace(t, '[^0-9.]', '', 'g'), '^(\d+\.?\d*|\.\d+)', 1) AS DOUBLE), 0), 39.95::DOUBLE) AS price
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'gratis' WHEN 1 THEN '$0.00' WHEN 2 THEN 'USD ' || p_size || '.50 / ud' WHEN 3 THEN '1.2.' || p_size
  ELSE '€' || p_size END AS t FROM part)""")
def _(spark, sf):
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    t = (F.when(k == 0, "gratis").when(k == 1, "$0.00").when(k == 2, F.concat(F.lit("USD "), size, F.lit(".50 / ud")))
         .when(k == 3, F.concat(F.lit("1.2."), size)).otherwise(F.concat(F.lit("€"), size)))
    return table(spark, sf, "part").select("p_partkey", numbers.parse_money(t).alias("price"))


KB_PART = "kbp AS (SELECT p_partkey, k.id, k.benefits, k.saturation, k.desires FROM part JOIN kb k ON k.ord = p_partkey % 12)"


def kb_parts(spark, sf):
    """Each part with one category of the base, in turn."""
    kb = F.broadcast(load_kb(spark))
    return table(spark, sf, "part").join(kb, F.col("p_partkey") % 12 == F.col("ord"))


@query("split_title", S.with_ctes(S.kb_cte(), KB_PART) + """
SELECT p_partkey, trim(split_part(t, ':', 1)) AS title, coalesce(nullif(trim(CASE WHEN contains(t, ':') THEN substr(t, strpos(t, ':') + 1) END), ''), 'sin texto') AS body
FROM (SELECT p_partkey, benefits[p_partkey % 8 + 1] AS t FROM kbp)""")
def _(spark, sf):
    t = text.cycle(F.col("benefits"), F.col("p_partkey"))
    title, body = text.split_title(t, F.lit("sin texto"))
    return kb_parts(spark, sf).select("p_partkey", title.alias("title"), body.alias("body"))


@query("initcap_first", S.with_ctes(S.kb_cte(), KB_PART) + "\nSELECT p_partkey, upper(t[1]) || t[2:] AS title FROM (SELECT p_partkey, desires[p_partkey % 5 + 1] AS t FROM kbp)")
def _(spark, sf):
    return kb_parts(spark, sf).select("p_partkey", text.initcap_first(text.cycle(F.col("desires"), F.col("p_partkey"))).alias("title"))


@query("cycle", S.with_ctes(S.kb_cte(), KB_PART) + "\nSELECT p_partkey, benefits[p_size % len(benefits) + 1] AS benefit FROM kbp JOIN part USING (p_partkey)")
def _(spark, sf):
    return kb_parts(spark, sf).select("p_partkey", text.cycle(F.col("benefits"), F.col("p_size")).alias("benefit"))


@query("star_bar", S.with_ctes(S.kb_cte(), KB_PART) + "\nSELECT p_partkey, repeat('★', saturation) || repeat('☆', 5 - saturation) AS stars FROM kbp")
def _(spark, sf):
    return kb_parts(spark, sf).select("p_partkey", text.star_bar(F.col("saturation")).alias("stars"))


@query("first_sentence", "SELECT doc_id, split_part(text, '.', 1) AS sentence FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@query("truncate_preview", """
SELECT doc_id, CASE WHEN length(text) > 32 THEN left(text, 32) || '…' ELSE text END AS title,
  CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END AS line,
  CASE WHEN length(text) > 6000 THEN left(text, 6000) || '…' ELSE text END AS body FROM documents""")
def _(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", text.truncate_preview(t, 32, "…").alias("title"), text.truncate_preview(t, 60, "...").alias("line"),
        text.truncate_preview(t, 6000, "…").alias("body"))


@query("ordinal_label", "SELECT p_partkey, CASE WHEN length(p_partkey::VARCHAR) >= 2 THEN p_partkey::VARCHAR ELSE lpad(p_partkey::VARCHAR, 2, '0') END AS label FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.ordinal_label(F.col("p_partkey")).alias("label"))


@query("billing_period", "SELECT strftime(ts, '%Y-%m') AS period, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(numbers.billing_period(F.col("ts")).alias("period")).agg(F.count("*").alias("n"))


@query("display_date", "SELECT o_orderkey, strftime(o_orderdate, '%-d/%-m/%Y') AS shown FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", numbers.display_date(F.col("o_orderdate")).alias("shown"))


@query("score_band", "SELECT p_partkey, CASE WHEN p_size * 2 >= 80 THEN 'green' WHEN p_size * 2 >= 60 THEN 'amber' ELSE 'red' END AS band FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", numbers.score_band(F.col("p_size") * 2).alias("band"))


@query("clamp_pct", "SELECT event_id, greatest(0.0::DOUBLE, least(100.0::DOUBLE, (value - 10) / 50.0::DOUBLE * 100)) AS pct FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", numbers.clamp_pct(F.col("value") - 10, F.lit(50.0)).alias("pct"))


@query("campaign_id", S.products_sql("SELECT product_id, 'cmp_' || sha256(concat_ws('|', product_id::VARCHAR, name, source_url)) AS campaign_id FROM products"))
def _(spark, sf):
    from adloom.operators.catalog import with_campaign_id
    return with_campaign_id(products(spark, sf)).select("product_id", "campaign_id")


@query("product_context", S.products_sql("""SELECT product_id, concat_ws(chr(10), 'Producto: ' || name,
  CASE WHEN description <> '' THEN 'Descripción: ' || description END, CASE WHEN source_url <> '' THEN 'URL de origen: ' || source_url END,
  CASE WHEN price <> '' THEN 'Precio observado/coste: ' || price END,
  CASE WHEN audience_hint <> '' THEN 'Pista de audiencia del usuario: ' || audience_hint END) AS context FROM products"""))
def _(spark, sf):
    c = F.col
    return products(spark, sf).select("product_id", text.product_context(
        c("name"), c("description"), c("source_url"), c("price"), c("audience_hint")).alias("context"))


@query("knowledge_values", S.with_ctes(S.kb_cte(), S.kw_cte()) + """
SELECT f.field, category_id, pos, value, n.n AS parts_in_turn FROM (
  SELECT 'benefits' AS field, id AS category_id, generate_subscripts(benefits, 1) - 1 AS pos, unnest(benefits) AS value FROM kb
  UNION ALL SELECT 'fears', id, generate_subscripts(fears, 1) - 1, unnest(fears) FROM kb
  UNION ALL SELECT 'desires', id, generate_subscripts(desires, 1) - 1, unnest(desires) FROM kb
  UNION ALL SELECT 'secondary_problems', id, generate_subscripts(secondary_problems, 1) - 1, unnest(secondary_problems) FROM kb) f
JOIN (SELECT k.id, count(*) AS n FROM part JOIN kb k ON k.ord = p_partkey % 12 GROUP BY 1) n ON n.id = f.category_id""")
def _(spark, sf):
    kb = load_kb(spark)
    parts = [kb_values(kb, f).withColumn("field", F.lit(f)) for f in ["benefits", "fears", "desires", "secondary_problems"]]
    values = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    used = kb_parts(spark, sf).groupBy(F.col("id").alias("category_id")).agg(F.count("*").alias("parts_in_turn"))
    return values.join(used, "category_id")


@query("category_pains", S.with_ctes(S.kb_cte(), KB_PART) + """
SELECT id AS category_id, pos, pain, count(*) AS parts_in_turn FROM kbp
JOIN (SELECT id, generate_subscripts(pain_list, 1) - 1 AS pos, unnest(pain_list) AS pain FROM kb) USING (id) GROUP BY ALL""")
def _(spark, sf):
    used = kb_parts(spark, sf).groupBy(F.col("id").alias("category_id")).agg(F.count("*").alias("parts_in_turn"))
    return used.join(F.broadcast(category_pains(load_kb(spark))), "category_id")


@query("search_items", """SELECT doc_id, source, text FROM documents WHERE lang = 'es' AND contains(lower(text), 'ción')""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return filters.search_items(docs, "CIÓN", group="es", group_col="lang").select("doc_id", "source", "text")


LINES = r"""doc_lines AS (
  SELECT doc_id, pos, line FROM (
    SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, trim(unnest(l), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS line
    FROM (SELECT doc_id, string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '\n+') AS l FROM documents))
  WHERE length(line) > 8 AND length(line) < 160)"""


@query("lines_in_range", "WITH " + LINES + " SELECT doc_id, line, count(*) AS n FROM doc_lines GROUP BY ALL")
def _(spark, sf):
    """Counted inside the row, so no line is exchanged."""
    lines = text.counted(text.lines_in_range(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", F.inline(lines)).withColumnRenamed("value", "line")


@query("missing_config", """
SELECT c_custkey, list_filter(['name', 'email', 'segment'], lambda k: (k = 'name' AND c_name = '') OR (k = 'email' AND c_custkey % 3 = 0)
  OR (k = 'segment' AND c_mktsegment = 'BUILDING')) AS missing
FROM customer WHERE c_custkey % 3 = 0 OR c_mktsegment = 'BUILDING'""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    conf = c.select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.lit("x@example.com")).alias("email"),
                    F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"))
    return filters.missing_config(conf, ["name", "email", "segment"]).select("c_custkey", "missing")

"""Creative modules over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.functions import urls
from adloom.functions.numbers import parse_money, priority_tone
from adloom.functions.seeded import digest, draw
from adloom.functions.text import ordinal_label, split_title
from adloom.knowledge import templates
from adloom.operators import catalog, creative, filters, overlay, reports, selection
from adloom.operators.catalog import with_campaign_id
from adloom.plans.campaigns import MODULES, build_campaigns, campaign_markdown
from adloom.queries.inputs import products
from adloom.queries.registry import query
from adloom.queries.text import LABEL_CASE, SOURCE_CASE
from adloom.queries import sqlkit as S
from adloom.session import shared_dir
from adloom.sources.campaigns import read_campaigns_json
from adloom.sources.documents import read_documents, write_documents
from adloom.sources.static import static_table


def enriched(spark, sf) -> DataFrame:
    return catalog.enrich(products(spark, sf))


def enriched_twins(spark, sf) -> DataFrame:
    return catalog.enrich(catalog.with_twins(products(spark, sf)))


def flat_attrs(items: DataFrame) -> DataFrame:
    pairs = F.transform(F.sort_array(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return items.withColumn("attrs", F.array_join(pairs, ";"))


def _module_query(module: str, name: str):
    @query(name, S.items_sql(module))
    def run(spark, sf):
        return flat_attrs(creative.expand_templates(enriched(spark, sf), module))


for _module, _name in [
    ("hooks", "generate_hooks"), ("ads", "generate_ads"), ("scripts", "generate_scripts"), ("beats", "generate_script_beats"),
    ("visual", "generate_storyboards"), ("imageprompts", "generate_image_prompts"), ("videoprompts", "generate_video_prompts"),
    ("ugc", "generate_creator_scripts"), ("landing", "generate_landing"), ("offers", "generate_offer_texts"),
    ("planner", "generate_production_plan"), ("thumbnails", "generate_thumbnails"), ("library", "generate_research_links"),
    ("viral", "growth_recommendations"),
]:
    _module_query(_module, _name)


TEXT_COLUMNS = ["product_id", "campaign_id", "module", "item_group", "ord", "title", "text", "detail"]


def hook_ctes() -> str:
    return S.with_ctes(*S.base_ctes(), S.template_cte("hooks", "hook_tpl"), S.filled_ctes("hook_tpl", "hook_filled"),
                       "hooks AS (SELECT product_id, campaign_id, seed, ord, item_group, f[1] AS title, f[2] AS text, f[3] AS detail, f[4] AS attrs FROM hook_filled)")


AB_SQL = hook_ctes() + ",\n" + S.template_cte("abtesting", "ab_tpl") + ",\n" + S.filled_ctes("ab_tpl", "ab_filled").strip() + """,
ab AS (
  SELECT product_id, campaign_id, 'abtesting' AS module, 'Hooks' AS item_group, ord, title, text, 'Retención a 3 segundos' AS detail FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY md5(seed || '|abtesting|' || ord::VARCHAR)) AS n FROM hooks) WHERE n <= 50
  UNION ALL SELECT product_id, campaign_id, module, item_group, ord, f[1], f[2], f[3] FROM ab_filled)
"""


@query("generate_ab_variants", AB_SQL + "SELECT * FROM ab")
def _(spark, sf):
    return creative.ab_variants(enriched(spark, sf)).select(TEXT_COLUMNS)


LISTS = S.with_ctes(*S.base_ctes(), S.template_cte("intelligence"), S.filled_ctes("tpl", "filled")) + f""",
listed AS (SELECT product_id, campaign_id, 'secondary_problems' AS g, {S.sampled('seed', 'secondary', 'secondary_problems', 4)} AS v FROM enriched
  UNION ALL SELECT product_id, campaign_id, 'benefits', b FROM enriched UNION ALL SELECT product_id, campaign_id, 'audiences', audience_names FROM enriched),
ranked AS (SELECT *, row_number() OVER (PARTITION BY product_id, item_group ORDER BY CASE WHEN item_group IN {tuple(templates.DRAWN_GROUPS)} THEN md5(seed || '|' || item_group || '|' || ord::VARCHAR) END, ord) AS n FROM filled)
SELECT product_id, campaign_id, module, item_group, n::INTEGER AS ord, f[1] AS title, f[2] AS text, f[3] AS detail, regexp_extract(f[4], 'idea=(.*)$', 1) AS idea FROM ranked
WHERE n <= {templates.SHOWN} OR item_group NOT IN {tuple(templates.DRAWN_GROUPS)}
UNION ALL SELECT product_id, campaign_id, 'intelligence', g, generate_subscripts(v, 1), '', unnest(v), '', '' FROM listed"""


@query("generate_intelligence", LISTS)
def _(spark, sf):
    return creative.intelligence_lists(enriched(spark, sf))


@query("landing_benefit_blocks", S.items_sql("landing", """SELECT product_id, ord, trim(split_part(text, ':', 1)) AS title,
  coalesce(nullif(trim(CASE WHEN contains(text, ':') THEN substr(text, strpos(text, ':') + 1) END), ''), detail) AS body FROM items WHERE item_group = 'benefits'"""))
def _(spark, sf):
    items = creative.expand_templates(enriched(spark, sf), "landing").filter(F.col("item_group") == "benefits")
    title, body = split_title(F.col("text"), F.col("detail"))
    return items.select("product_id", "ord", title.alias("title"), body.alias("body"))


@query("hook_by_angle", S.with_ctes(S.PRODUCTS, S.ANGLE_CTE) + f"""
SELECT product_id, angle, coalesce(a.lines, {S.lit(next(iter(templates.ANGLE_HOOKS.values())))})[({S.draw(S.digest('name', 'angle'))}) % 3 + 1] AS line
FROM products CROSS JOIN (SELECT unnest({S.lit(templates.ANGLES + ['Otro'])}) AS angle) LEFT JOIN angle_hooks a USING (angle)""")
def _(spark, sf):
    angles = F.explode(F.array(*[F.lit(a) for a in templates.ANGLES + ["Otro"]])).alias("angle")
    rows = products(spark, sf).select("product_id", "name", angles)
    return rows.select("product_id", "angle", creative.angle_hook(F.col("angle"), draw(digest(F.col("name"), F.col("angle")))).alias("line"))


@query("angle_duration_grid", S.products_sql(f"""SELECT product_id, angle, duration FROM products, (SELECT unnest({S.lit(templates.ANGLES)}) AS angle),
  (SELECT unnest({S.lit([d for d, _ in templates.DURATIONS])}) AS duration)"""))
def _(spark, sf):
    return creative.angle_duration_grid(products(spark, sf)).select("product_id", "angle", "duration")


@query("scripts_by_duration", S.items_sql("scripts", "SELECT product_id, ord, title FROM items WHERE contains(attrs, 'duration=45s')"))
def _(spark, sf):
    items = creative.expand_templates(enriched(spark, sf), "scripts")
    return filters.by_attribute(items, "duration", "45s").select("product_id", "ord", "title")


@query("prompts_by_tool", S.items_sql("imageprompts", "SELECT product_id, ord, text FROM items WHERE attrs LIKE '%tool=Flux%'"))
def _(spark, sf):
    items = creative.expand_templates(enriched(spark, sf), "imageprompts")
    return filters.by_attribute(items, "tool", "Flux").select("product_id", "ord", "text")


@query("links_by_platform", S.items_sql("library", "SELECT product_id, item_group AS platform, string_agg(text, ' ' ORDER BY ord) AS links FROM items GROUP BY 1, 2"))
def _(spark, sf):
    return filters.links_by_platform(creative.expand_templates(enriched(spark, sf), "library"))


def all_items_sql(modules: list[str], select: str) -> str:
    return S.with_ctes(*S.all_items_ctes(modules)) + "\n" + select


def text_hash(*columns):
    """Number of an item's texts, as in the check SQL."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x01", *columns)), 1, 12), 16, 10).cast("bigint")


def attrs_text(attrs):
    return F.array_join(F.transform(F.sort_array(F.map_entries(attrs)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


COUNTED = ["hooks", "visual", "planner"]


@query("group_counts", all_items_sql(COUNTED, "SELECT module, item_group, count(*) AS n FROM items GROUP BY 1, 2"))
def _(spark, sf):
    return reports.group_counts(creative.all_items(enriched(spark, sf), COUNTED, texts=False))


@query("all_items", all_items_sql(list(templates.BUILTIN), f"SELECT product_id, module, count(*) AS n, sum({S.ITEM_HASH})::BIGINT AS text_hash FROM items GROUP BY 1, 2"))
def _(spark, sf):
    """All texts of all modules; a number per product and module stands for them."""
    items = creative.all_items(enriched(spark, sf))
    texts = text_hash(F.col("ord").cast("string"), "item_group", "title", "text", "detail", attrs_text(F.col("attrs")))
    return items.groupBy("product_id", "module").agg(F.count("*").alias("n"), F.sum(texts).alias("text_hash"))


CAMPAIGN_SQL = "'cmp_' || sha256(concat_ws('|', product_id::VARCHAR, name, source_url)) AS campaign_id"
KPI_MODULES = ["hooks", "scripts", "ads", "ugc", "imageprompts", "videoprompts", "offers", "abtesting"]


def counts_sql(modules: list[str]) -> str:
    return ", ".join(f"count(*) FILTER (WHERE module = '{m}') AS n_{m}" for m in modules)


@query("campaign_kpis", all_items_sql(KPI_MODULES, f"SELECT campaign_id, {counts_sql(KPI_MODULES)} FROM items GROUP BY 1"))
def _(spark, sf):
    return reports.campaign_kpis(creative.all_items(enriched(spark, sf), KPI_MODULES, texts=False))


CARD_MODULES = ["hooks", "scripts", "ads", "ugc"]


@query("campaign_cards", all_items_sql(CARD_MODULES, f"""SELECT i.*, name, timestamp '2024-01-01' + to_days(product_id::INTEGER % 28) AS created,
  {LABEL_CASE.format('(' + SOURCE_CASE + ')')} AS source_label, score FROM scored JOIN (SELECT campaign_id, {counts_sql(CARD_MODULES)} FROM items GROUP BY 1) i USING (campaign_id)"""))
def _(spark, sf):
    created = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("product_id") % 28).cast("int"))
    label = urls.source_label(urls.source_type(F.col("source_url")))
    e = enriched(spark, sf).withColumns({"created": created, "source_label": label})
    return reports.campaign_cards(creative.all_items(e, CARD_MODULES, ("name", "created", "source_label", "score"), texts=False)).orderBy(F.col("created").desc(), "campaign_id")


@query("distinct_in_order", S.items_sql("scripts", "SELECT item_group AS duration, min(ord)::INTEGER AS first_seen FROM items GROUP BY 1"))
def _(spark, sf):
    items = creative.expand_templates(enriched(spark, sf), "scripts").select(F.col("item_group").alias("duration"), "ord")
    return selection.distinct_in_order(items, "duration", "ord").orderBy("first_seen")


@query("distinct_values", S.items_sql("library", "SELECT DISTINCT item_group AS platform FROM items"))
def _(spark, sf):
    return creative.expand_templates(enriched(spark, sf), "library").select(F.col("item_group").alias("platform")).distinct()


@query("plan_workload", S.items_sql("planner", r"""SELECT item_group AS phase, regexp_extract(attrs, 'priority=(\w+)', 1) AS priority, regexp_extract(attrs, 'platform=([^;]*)', 1) AS platform,
  sum(regexp_extract(attrs, 'count=(\d+)', 1)::INTEGER)::BIGINT AS pieces, count(*) AS lines FROM items GROUP BY ROLLUP (1, 2, 3)"""))
def _(spark, sf):
    return reports.plan_workload(creative.expand_templates(enriched(spark, sf), "planner"))


@query("priority_tone", S.items_sql("planner", r"""SELECT product_id, ord, CASE regexp_extract(attrs, 'priority=(\w+)', 1) WHEN 'Alta' THEN 'bad' WHEN 'Media' THEN 'warn' ELSE 'default' END AS tone FROM items"""))
def _(spark, sf):
    items = creative.expand_templates(enriched(spark, sf), "planner")
    return items.select("product_id", "ord", priority_tone(F.col("attrs")["priority"]).alias("tone"))


@query("head_k", S.items_sql("landing", "SELECT product_id, item_group, ord, text FROM (SELECT *, row_number() OVER (PARTITION BY product_id, item_group ORDER BY ord) AS rank FROM items) WHERE rank <= 2"))
def _(spark, sf):
    items = creative.expand_templates(enriched(spark, sf), "landing").select("product_id", "item_group", "ord", "text")
    return selection.top_k_per_key(items, ["product_id", "item_group"], [F.col("ord")], 2).drop("rank")


@query("flatten_hooks", hook_ctes() + "\nSELECT product_id, ord AS pos, text FROM hooks")
def _(spark, sf):
    nested = enriched(spark, sf).select("product_id", creative.nested_module("hooks").alias("hooks"))
    return nested.select("product_id", F.posexplode(F.transform("hooks", lambda h: h["text"])).alias("pos", "text")).withColumn("pos", F.col("pos") + 1)


@query("render_block", S.items_sql("ads", "SELECT product_id, ord, lpad(ord::VARCHAR, 2, '0') || '. ' || title || chr(10) || text || chr(10) || detail AS block FROM items"))
def _(spark, sf):
    items = creative.expand_templates(enriched(spark, sf), "ads")
    return items.select("product_id", "ord", creative.render_block(ordinal_label(F.col("ord"))).alias("block"))


@query("render_script_blocks", S.items_sql("beats", r"""SELECT product_id, regexp_extract(attrs, 'script=(\d+)', 1)::INTEGER AS script,
  string_agg(rank || '. ' || text, chr(10) ORDER BY ord) AS block FROM (SELECT *, row_number() OVER (PARTITION BY product_id, regexp_extract(attrs, 'script=(\d+)', 1) ORDER BY ord) AS rank FROM items) GROUP BY 1, 2"""))
def _(spark, sf):
    blocks = creative.render_module(enriched_twins(spark, sf), "beats", lambda r: r["attrs"]["script"], ["product_id"], "script")
    return blocks.withColumn("script", F.col("script").cast("int"))


@query("render_numbered_variants", AB_SQL + """SELECT product_id, item_group, string_agg(rank || '. ' || text, chr(10) ORDER BY ord) AS block
FROM (SELECT *, row_number() OVER (PARTITION BY product_id, item_group ORDER BY ord) AS rank FROM ab) GROUP BY 1, 2""")
def _(spark, sf):
    return creative.render_module(enriched_twins(spark, sf), "abtesting", lambda r: r.get("as_group", r["item_group"]), ["product_id"], "item_group")


CAMPAIGN_CTES = S.all_items_ctes(MODULES) + [f"""
drawn AS (SELECT product_id, item_group, f[1] AS title, regexp_extract(f[4], 'idea=(.*)$', 1) AS idea, f[2] AS text,
  row_number() OVER (PARTITION BY product_id, item_group ORDER BY md5(seed || '|' || item_group || '|' || ord::VARCHAR), ord) AS n FROM intel_filled WHERE item_group IN {tuple(templates.DRAWN_GROUPS)})""",
    f"""lists AS (SELECT product_id, string_agg(title || ': ' || idea, '|' ORDER BY n) FILTER (WHERE item_group = 'angles') AS angles,
  string_agg(title || ': ' || text, '|' ORDER BY n) FILTER (WHERE item_group = 'objections') AS objections FROM drawn WHERE n <= {templates.SHOWN} GROUP BY 1)"""]
CAMPAIGN_CTES[-2:-2] = [S.template_cte("intelligence", "intel_tpl"), S.filled_ctes("intel_tpl", "intel_filled")]


@query("build_campaigns", S.with_ctes(*CAMPAIGN_CTES) + f"""
SELECT s.product_id, s.campaign_id, score AS total, probability, n, text_hash, angles, objections FROM scored s JOIN lists USING (product_id)
JOIN (SELECT product_id, count(*) AS n, sum({S.ITEM_HASH})::BIGINT AS text_hash FROM items GROUP BY 1) i USING (product_id)""")
def _(spark, sf):
    """Whole documents; counts and a number of all texts stand for the modules."""
    c = F.col
    docs = build_campaigns(products(spark, sf), F.lit("2024-01-01").cast("timestamp"))
    items = F.concat(*MODULES, "abhooks")
    texts = F.transform(items, lambda t: text_hash(t["ord"].cast("string"), t["item_group"], t["title"], t["text"], t["detail"], attrs_text(t["attrs"])))
    pairs = lambda name, a, b: F.array_join(F.transform(c(f"intelligence.{name}"), lambda t: F.concat(t[a], F.lit(": "), t[b])), "|").alias(name)
    return docs.select("product_id", "campaign_id", c("score.total").alias("total"), c("viral.probability").alias("probability"), F.size(items).cast("long").alias("n"),
                       F.aggregate(texts, F.lit(0).cast("bigint"), lambda total, x: total + x).alias("text_hash"), pairs("angles", "name", "bigIdea"), pairs("objections", "objection", "response"))


@query("campaign_json", S.with_ctes(*S.all_items_ctes(["hooks"])) + f"""
SELECT product_id, campaign_id, score AS total, round(recommended_price, 2) AS price, hooks, {templates.SHOWN} AS angles
FROM scored JOIN (SELECT product_id, string_agg(text, '|' ORDER BY ord) AS hooks FROM items GROUP BY 1) USING (product_id)""")
def _(spark, sf):
    """Documents as JSON text, read back with their schema."""
    c = F.col
    docs = build_campaigns(products(spark, sf), F.lit("2024-01-01").cast("timestamp"))
    stored = docs.select("product_id", F.to_json(F.struct("campaign_id", "score", "hooks", "intelligence")).alias("json"))
    kept = "campaign_id string, score struct<total: int>, hooks array<struct<text: string>>, intelligence struct<pricing: struct<recommended: string>, angles: array<struct<name: string>>>"
    back = stored.select("product_id", F.from_json("json", kept).alias("d"))
    return back.select("product_id", "d.campaign_id", c("d.score.total").alias("total"), parse_money(c("d.intelligence.pricing.recommended")).alias("price"),
                       F.array_join(F.transform("d.hooks", lambda h: h["text"]), "|").alias("hooks"), F.size("d.intelligence.angles").alias("angles"))


@query("read_campaigns_json", S.scored_sql("""SELECT CASE WHEN product_id % 10 = 0 THEN 'corrupt' ELSE 'ok' END AS kind, CASE WHEN product_id % 10 <> 0 THEN product_id END AS product_id,
  CASE WHEN product_id % 10 <> 0 THEN score END AS total FROM scored"""))
def _(spark, sf):
    """Documents written as JSON lines, one in ten of them cut off, through the reader with its quarantine."""
    folder = shared_dir(spark, "campaigns")
    docs = catalog.score_products(products(spark, sf)).select("product_id", F.to_json(F.struct("product_id", "campaign_id", F.struct(F.col("score").alias("total")).alias("score"))).alias("value"))
    docs.select(F.when(F.col("product_id") % 10 == 0, F.left("value", F.length("value") - 3)).otherwise(F.col("value")).alias("value")).write.text(f"{folder}/json")
    good, bad = read_campaigns_json(spark, f"{folder}/json", "product_id long, campaign_id string, score struct<total: int>")
    return good.select(F.lit("ok").alias("kind"), "product_id", "score.total").unionByName(
        bad.select(F.lit("corrupt").alias("kind"), F.lit(None).cast("long").alias("product_id"), F.lit(None).cast("int").alias("total")))


@query("document_files", S.items_sql("ads", "SELECT lpad((product_id % 16)::VARCHAR, 2, '0') AS folder, campaign_id AS name, string_agg(ord || '. ' || text, chr(10) ORDER BY ord) AS text FROM items GROUP BY 1, 2"))
def _(spark, sf):
    """The ads of each campaign in a file of its own, written by the sink and read back."""
    folder = shared_dir(spark, "documents")
    place = F.lpad((F.col("product_id") % 16).cast("string"), 2, "0")
    blocks = creative.render_module(enriched_twins(spark, sf).withColumn("folder", place), "ads", lambda r: "", ["folder", "campaign_id"])
    write_documents(blocks.select("folder", F.col("campaign_id").alias("name"), F.col("block").alias("text")), f"{folder}/ads", ".md")
    return read_documents(spark, f"{folder}/ads", ".md")


@query("campaign_markdown")
def _(spark, sf):
    docs = build_campaigns(products(spark, sf), F.lit("2024-01-01").cast("timestamp"))
    return campaign_markdown(docs).select("product_id", "campaign_id", "markdown")


def attr(name: str) -> str:
    return f"regexp_extract(attrs, '(^|;){name}=([^;]*)', 2)"


def notes_sql(line: str, *names: str) -> str:
    return f"{line} || ' [' || concat_ws(' | ', {', '.join(map(attr, names))}) || ']'"


TITLED_SQL = "'**' || title || '** — ' || replace(text, chr(10), ' / ')"
#: Section, module, line, heading, as in the export.
SECTION_SQL = [
    ("2. Hooks", "hooks", "text", f"{attr('emoji')} || ' ' || item_group"),
    ("3. Anuncios (Ad Generator)", "ads", notes_sql(f"concat_ws(' · ', {TITLED_SQL}, detail, {attr('cta')})", "description", "specs", "notes"), "''"),
    ("5. Storyboards (Visual Generator)", "visual", notes_sql(f"concat_ws(' · ', {attr('n')}, text, {attr('duration')})", "shot", "subject", "expression", "light", "movement", "audio"),
     f"item_group || ': ' || {attr('concept')}"),
    ("6. Prompts de imagen IA", "imageprompts", notes_sql(TITLED_SQL, "meta"), "item_group"), ("7. Prompts de video IA", "videoprompts", notes_sql(TITLED_SQL, "meta"), "item_group"),
    ("8. UGC Generator", "ugc", notes_sql(TITLED_SQL, "profile", "tone", "setting", "wardrobe"), f"{attr('emoji')} || ' ' || item_group"),
    ("9. Thumbnails", "thumbnails", notes_sql(TITLED_SQL, "style", "layout", "colors", "prompt"), "''"), ("10. Landing Copy", "landing", TITLED_SQL, "item_group"),
    ("11. Ofertas (Offer Builder)", "offers", notes_sql(TITLED_SQL, "name", "structure", "example", "best_for"), "''"),
    ("12. Creative Planner", "planner", notes_sql(f"{attr('count')} || '× ' || title || ' [' || {attr('platform')} || '] ' || {attr('priority')}", "notes"), "item_group"),
    ("15. Creative Library (búsquedas)", "library", notes_sql(f"'[' || {attr('platform')} || '] ' || title || ': ' || text", "note"), "''"),
]
MARKDOWN_MODULES = [m for _, m, *_ in SECTION_SQL] + ["scripts", "beats"]
MARKDOWN_SQL = S.with_ctes(*S.all_items_ctes(MARKDOWN_MODULES), "shown AS (SELECT * FROM items WHERE item_group NOT IN ('comparison', 'reviews'))",
    "lined AS (" + " UNION ALL ".join(f"SELECT product_id, {S.lit(t)} AS section, ord, item_group, {line} AS line, {head} AS heading FROM shown WHERE module = '{m}'" for t, m, line, head in SECTION_SQL) + ")",
    "headed AS (SELECT *, heading <> '' AND item_group IS DISTINCT FROM lag(item_group) OVER (PARTITION BY product_id, section ORDER BY ord) AS fresh FROM lined)",
    f"""voiced AS (SELECT product_id, {attr('script')}::INTEGER AS script,
  string_agg('- **' || {attr('time')} || ' · ' || title || '** — VOZ: ' || text || ' | VISUAL: ' || detail, chr(10) ORDER BY ord) AS beats FROM items WHERE module = 'beats' GROUP BY ALL)""") + """
SELECT product_id, section, trim(string_agg(CASE WHEN fresh THEN chr(10) || '### ' || heading || chr(10) ELSE '' END || '- ' || line, chr(10) ORDER BY ord), chr(10)) AS body FROM headed GROUP BY 1, 2
UNION ALL SELECT i.product_id, '4. Guiones (Script Generator)', trim(string_agg(chr(10) || '### [' || item_group || '] ' || title || chr(10) || 'Hook: ' || text || chr(10) || beats || chr(10) || 'CTA: ' || detail, chr(10) ORDER BY ord), chr(10))
FROM items i JOIN voiced v ON v.product_id = i.product_id AND v.script = i.ord WHERE module = 'scripts' GROUP BY 1"""


@query("markdown_sections", MARKDOWN_SQL)
def _(spark, sf):
    """The export's sections that items fill, as they stand in the document."""
    docs = campaign_markdown(build_campaigns(products(spark, sf), F.lit("2024-01-01").cast("timestamp")))
    parts = docs.select("product_id", F.explode(F.split("markdown", "\n## ")).alias("part"))
    title = F.substring_index("part", "\n", 1)
    filled = [*[t for t, *_ in SECTION_SQL], "4. Guiones (Script Generator)"]
    return parts.select("product_id", title.alias("section"), F.trim(F.substring("part", F.length(title) + 1, F.length("part")), F.lit("\n")).alias("body")).filter(F.col("section").isin(filled))


# ---- overlays --------------------------------------------------------------------------------

def overlays(spark, sf) -> DataFrame:
    """An overlay document in JSON per product; some are absent, cut, incomplete or hold an extra field."""
    c, k = F.col, F.col("product_id")
    row = catalog.spread(products(spark, sf))
    texts = lambda *v: F.array(*[F.concat(F.lit(x), c("name")) for x in v])
    persona = lambda who, i: F.struct(F.lit(who).alias("persona"), F.concat(F.lit(f"gancho {i} "), c("name")).alias("hook"), F.lit(f"guion {i}").alias("script"))
    doc = F.struct(
        F.when(k % 20 != 0, F.concat(F.lit("Problema de "), c("name"))).alias("problem"),
        F.when(k % 8 == 0, F.array().cast("array<string>")).otherwise(texts("uno ", "dos ")).alias("secondaryProblems"), texts("b1 ", "b2: ").alias("benefits"),
        F.array(F.struct(F.lit("a").alias("name"), F.lit("d").alias("description"), F.when(k % 35 != 1, texts("p ")).alias("pains"))).alias("audiences"),
        F.array(F.struct(F.lit("n").alias("name"), F.lit("e").alias("emotion"), F.lit("d").alias("description"), F.lit("b").alias("bigIdea"))).alias("angles"),
        F.array(F.struct(F.lit("o").alias("objection"), F.lit("r").alias("response"))).alias("objections"), texts("x ").alias("differentiators"),
        F.struct(F.lit("$1").alias("recommended"), F.lit("r").alias("range"), F.lit("s").alias("strategy"), F.lit("m").alias("marginNote"), F.when(k % 39 == 2, "EUR").alias("currency")).alias("pricing"),
        F.lit("veredicto").alias("scoreVerdict"), (k % 150 - 10).cast("int").alias("scoreTotal"),
        F.array(F.struct(F.lit("CURIOSIDAD").alias("category"), texts("h ").alias("items")), F.struct(F.lit("Nueva").alias("category"), texts("h ").alias("items"))).alias("hooks"),
        F.struct(F.concat(F.lit("Titular "), c("name")).alias("headline"), F.lit("s").alias("subheadline"), F.lit("g").alias("guarantee")).alias("landing"),
        F.array(persona("Una abuela", 0), persona("La mamá joven", 1), persona("Otra persona", 2)).alias("ugcScripts"))
    text = F.to_json(doc)
    text = F.when(k % 41 == 3, F.regexp_replace(text, '"scoreTotal":(-?[0-9]+)', '"scoreTotal":"$1"')).otherwise(text)
    text = F.when(k % 28 == 0, F.left(text, F.length(text) - 5)).when(k % 44 == 0, F.concat(F.lit('{"extra":1,'), F.substring(text, F.lit(2), F.length(text)))).otherwise(text)
    text = F.when(k % 5 != 3, text)
    return with_campaign_id(row).select("product_id", "campaign_id", text.alias("json"))


FAULTS_SQL = """CASE WHEN product_id % 5 = 3 THEN [] WHEN product_id % 28 = 0 THEN [{'path': '$', 'error': 'malformed'}] ELSE list_concat(
  CASE WHEN product_id % 44 = 0 THEN [{'path': '$.extra', 'error': 'unknown_field'}] ELSE [] END, CASE WHEN product_id % 20 = 0 THEN [{'path': '$.problem', 'error': 'missing_field'}] ELSE [] END,
  CASE WHEN product_id % 35 = 1 THEN [{'path': '$.audiences[0].pains', 'error': 'missing_field'}] ELSE [] END,
  CASE WHEN product_id % 39 = 2 THEN [{'path': '$.pricing.currency', 'error': 'unknown_field'}] ELSE [] END,
  CASE WHEN product_id % 41 = 3 THEN [{'path': '$.scoreTotal', 'error': 'wrong_type'}] ELSE [] END) END"""
ERROR_SQL = """CASE WHEN product_id % 5 = 3 THEN NULL WHEN product_id % 28 = 0 THEN 'malformed' WHEN product_id % 44 = 0 OR product_id % 39 = 2 THEN 'unknown_field'
  WHEN product_id % 20 = 0 OR product_id % 35 = 1 THEN 'missing_field' WHEN product_id % 41 = 3 THEN 'wrong_type' END"""
USABLE_SQL = f"(product_id % 5 <> 3 AND {ERROR_SQL} IS NULL)"


@query("parse_overlay", S.products_sql(f"""SELECT product_id, {ERROR_SQL} AS overlay_error, CASE WHEN {USABLE_SQL} THEN (product_id % 150 - 10)::INTEGER END AS score_total
FROM products"""))
def _(spark, sf):
    return overlay.parse_overlay(overlays(spark, sf)).select("product_id", "overlay_error", F.col("overlay.scoreTotal").alias("score_total"))


@query("overlay_quarantine", S.products_sql(f"SELECT product_id, f.path, f.error FROM (SELECT product_id, unnest({FAULTS_SQL}) AS f FROM products)"))
def _(spark, sf):
    """Every wrong path of every refused document."""
    return overlay.quarantine(overlay.parse_overlay(overlays(spark, sf)), "product_id")


def by_overlay(new: str, old: str) -> str:
    return f"CASE WHEN {USABLE_SQL} THEN {new} ELSE {old} END"


PEOPLE_SQL = by_overlay("CASE ord WHEN 1 THEN 'gancho 1 ' || name || '/guion 1' WHEN 7 THEN 'gancho 0 ' || name || '/guion 0' WHEN 2 THEN 'gancho 1 ' || name || '/guion 1' "
                        "WHEN 3 THEN 'gancho 2 ' || name || '/guion 2' ELSE title || '/' || text END", "title || '/' || text")
DOCUMENTS = [*CAMPAIGN_CTES, """
own AS (SELECT product_id, string_agg(item_group || ':' || regexp_extract(attrs, 'emoji=(.*)$', 1) || ':' || text, '|' ORDER BY ord) FILTER (WHERE module = 'hooks') AS hooks,
  string_agg(text, '|' ORDER BY ord) FILTER (WHERE module = 'landing' AND item_group IN ('headline', 'subheadline', 'guarantee')) AS landing FROM items GROUP BY 1)""",
             "people AS (SELECT i.product_id, string_agg(" + PEOPLE_SQL.replace("product_id %", "i.product_id %") + ", '|' ORDER BY ord) AS ugc FROM items i JOIN products p ON p.product_id = i.product_id WHERE module = 'ugc' GROUP BY 1)",
             "plain AS (SELECT product_id, string_agg(f[2], '|' ORDER BY ord) AS differentiators FROM intel_filled WHERE item_group = 'differentiators' GROUP BY 1)"]


@query("merge_documents", S.with_ctes(*DOCUMENTS) + f"""
SELECT product_id, {by_overlay("'overlay'", "'local'")} AS generated_by, {by_overlay("'Problema de ' || name", "problem || '. ' || p")} AS problem,
  {by_overlay("CASE WHEN product_id % 8 <> 0 THEN 'uno ' || name || '|dos ' || name ELSE array_to_string(second, '|') END", "array_to_string(second, '|')")} AS secondary,
  {by_overlay("'b1 ' || name || '|b2: ' || name", "array_to_string(b, '|')")} AS benefits, {by_overlay("'a'", "array_to_string(audience_names, '|')")} AS audiences,
  {by_overlay("'n: b'", "angles")} AS angles, {by_overlay("'o: r'", "objections")} AS objections, {by_overlay("'x ' || name", "differentiators")} AS differentiators,
  {by_overlay("'$1/r/s/m'", "price_text || '/$' || price_lo || '–$' || price_hi || ' USD/Ancla $' || floor(price_hi * 1.6::DOUBLE + 0.5)::INTEGER || ', oferta ' || " + S.money("recommended_price") + " || '/Margen bruto objetivo: 65%'")} AS pricing,
  {by_overlay("greatest(0, least(100, product_id % 150 - 10))", "score")}::INTEGER AS total, {by_overlay("'veredicto'", "''")} AS verdict,
  {by_overlay("'CURIOSIDAD:🔍:h ' || name || '|Nueva:✨:h ' || name", "hooks")} AS hooks, {by_overlay("'Titular ' || name || '|s|g'", "landing")} AS landing, ugc
FROM (SELECT *, {S.sampled('seed', 'secondary', 'secondary_problems', 4)} AS second FROM enriched) JOIN lists USING (product_id) JOIN own USING (product_id) JOIN people USING (product_id) JOIN plain USING (product_id)""")
def _(spark, sf):
    """All fields of a replacement document in the campaign document; the verdict is shown where it was replaced."""
    c = F.col
    usable, _ = overlay.split_overlays(overlay.parse_overlay(overlays(spark, sf)))
    rows = catalog.with_slots(catalog.score_products(catalog.by_campaign(products(spark, sf))))
    docs = overlay.merge_documents(build_campaigns(rows, F.lit("2024-01-01").cast("timestamp"), enriched=True), usable)
    joined = lambda values, f=lambda x: x: F.array_join(F.transform(values, f), "|")
    both = lambda a, b, sep: lambda t: F.concat(t[a], F.lit(sep), t[b])
    i = lambda name: c(f"intelligence.{name}")
    landing = F.filter("landing", lambda t: t["item_group"].isin("headline", "subheadline", "guarantee"))
    price = F.concat_ws("/", *[i(f"pricing.{x}") for x in ("recommended", "range", "strategy", "marginNote")])
    return docs.select(
        "product_id", "generated_by", i("problem").alias("problem"), joined(i("secondaryProblems")).alias("secondary"), joined(i("benefits")).alias("benefits"),
        joined(i("audiences"), lambda a: a["name"]).alias("audiences"), joined(i("angles"), both("name", "bigIdea", ": ")).alias("angles"),
        joined(i("objections"), both("objection", "response", ": ")).alias("objections"), joined(i("differentiators")).alias("differentiators"), price.alias("pricing"),
        c("score.total").alias("total"), F.when(c("generated_by") == "overlay", c("score.verdict")).otherwise("").alias("verdict"),
        joined(c("hooks"), lambda t: F.concat_ws(":", t["item_group"], t["attrs"]["emoji"], t["text"])).alias("hooks"), joined(landing, lambda t: t["text"]).alias("landing"),
        joined(c("ugc"), both("title", "text", "/")).alias("ugc"))


@query("overlay_merge", S.enriched_sql(f"""SELECT product_id, CASE WHEN {USABLE_SQL} THEN 'overlay' ELSE 'local' END AS generated_by,
  CASE WHEN {USABLE_SQL} THEN 'Problema de ' || name ELSE problem END AS problem,
  CASE WHEN {USABLE_SQL} AND product_id % 8 <> 0 THEN 'uno ' || name || '|dos ' || name ELSE array_to_string(secondary_problems, '|') END AS secondary_problems,
  CASE WHEN {USABLE_SQL} THEN greatest(0, least(100, product_id % 150 - 10)) ELSE score END::INTEGER AS score,
  CASE WHEN {USABLE_SQL} THEN 'Titular ' || name ELSE name END AS headline FROM enriched"""))
def _(spark, sf):
    base = catalog.score_products(catalog.spread(products(spark, sf))).select("product_id", "campaign_id", "problem", "secondary_problems", "score", F.col("name").alias("headline"))
    usable, _ = overlay.split_overlays(overlay.parse_overlay(overlays(spark, sf)))
    out = overlay.overlay_merge(base, usable)
    return out.select("product_id", "generated_by", "problem", F.array_join("secondary_problems", "|").alias("secondary_problems"), "score", "headline")


@query("overlay_status", S.products_sql(f"""SELECT {CAMPAIGN_SQL}, CASE WHEN product_id % 5 = 3 THEN 'no_overlay' WHEN {ERROR_SQL} IS NULL THEN 'merged' ELSE 'kept_base' END AS status,
  {ERROR_SQL} AS overlay_error FROM products"""))
def _(spark, sf):
    return overlay.overlay_status(with_campaign_id(products(spark, sf)), overlay.parse_overlay(overlays(spark, sf)))


@query("hook_emoji", S.products_sql(f"""SELECT product_id, category, CASE WHEN category = 'CURIOSIDAD' THEN '🔍' ELSE '✨' END AS emoji
FROM products, (VALUES ('CURIOSIDAD'), ('Nueva')) g(category) WHERE {USABLE_SQL}"""))
def _(spark, sf):
    usable, _ = overlay.split_overlays(overlay.parse_overlay(overlays(spark, sf)))
    hooks = usable.select("product_id", F.explode("overlay.hooks").alias("h")).select("product_id", F.col("h.category").alias("category"))
    groups = static_table(spark, templates.HOOK_GROUPS, "category string, emoji string, n int")
    return overlay.hook_emoji(hooks, groups, templates.DEFAULT_EMOJI)


@query("persona_match", S.products_sql(f"""SELECT product_id, pos, persona, CASE pos WHEN 0 THEN 'gancho 1 ' || name WHEN 6 THEN 'gancho 0 ' || name
  WHEN 1 THEN 'gancho 1 ' || name WHEN 2 THEN 'gancho 2 ' || name ELSE 'base' END AS hook
FROM products, (SELECT unnest(range(7)) AS pos, unnest({S.lit([p for p, _ in templates.PERSONAS])}) AS persona) WHERE {USABLE_SQL}"""))
def _(spark, sf):
    usable, _ = overlay.split_overlays(overlay.parse_overlay(overlays(spark, sf)))
    base = F.array(*[F.struct(F.lit(p).alias("persona"), F.lit("base").alias("hook"), F.lit("base").alias("script")) for p, _ in templates.PERSONAS])
    out = usable.select("product_id", F.posexplode(overlay.persona_match(base, F.col("overlay.ugcScripts"))).alias("pos", "u"))
    return out.select("product_id", "pos", "u.persona", "u.hook")

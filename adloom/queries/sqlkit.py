"""Check SQL for DuckDB: shared common table expressions over the given tables."""

from __future__ import annotations

from adloom.functions.text import TRAILING_WORDS
from adloom.knowledge import subscriptions, templates
from adloom.knowledge.categories import BUILTIN, as_rows

WS = r"[\s\x{0b}\x{a0}]+"


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(lit, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: list[str], rows: list) -> str:
    body = ",\n".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


def static(name: str, columns: str, rows: list) -> str:
    return values(name, columns.split(), rows)


def kb_cte() -> str:
    cols = ["ord", "id", "name", "problem", "secondary_problems", "benefits", "desires", "fears", "environment", "demo_action",
            "wow_moment", "price_lo", "price_hi", "saturation", "visual_appeal", "explainability", "ugc_fit"]
    rows = [[r[c] for c in cols] + [[a["name"] for a in r["audiences"]], [p for a in r["audiences"] for p in a["pains"]]]
            for r in as_rows(BUILTIN)]
    return values("kb", cols + ["audience_names", "pain_list"], rows)


def kw_cte() -> str:
    return values("kw", ["ord", "category_id", "keyword"], [(i, c.id, k) for i, c in enumerate(BUILTIN) for k in c.keywords])


PRODUCTS = """
products AS (
  SELECT p_partkey AS product_id, p_name AS name, lower(p_type) || ' ' || p_brand AS description,
    CASE WHEN p_partkey % 7 = 5 THEN '' WHEN p_partkey % 7 = 6 THEN 'http//roto ' || p_name
      ELSE ['https://www.aliexpress.com', 'https://www.amazon.com', 'https://shop.tiktok.com', 'https://demo.myshopify.com',
            'https://www.tienda-uno.es'][p_partkey % 7 + 1]
        || '/products/' || replace(p_name, ' ', '-') || '-' || lower(p_type) || '-' || lpad(p_partkey::VARCHAR, 7, '0') || '.html'
    END AS source_url,
    'USD ' || p_retailprice::DECIMAL(12,2)::VARCHAR AS price,
    CASE WHEN p_partkey % 5 = 0 THEN 'data:image/png' END AS image_data_url,
    CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS audience_hint,
    CASE WHEN p_partkey % 10 = 0 THEN 'hogar' WHEN p_partkey % 10 = 1 THEN 'desconocida' ELSE '' END AS category_id
  FROM part)"""

DETECTED = f"""
hits AS (
  SELECT product_id, kw.category_id, kw.ord, sum(length(keyword)) AS score
  FROM products JOIN kw ON contains(strip_accents(lower(name || ' ' || description || ' ' || source_url)), keyword)
  GROUP BY ALL),
best AS (SELECT product_id, arg_max(category_id, (score, -ord)) AS category_id, max(score) AS score FROM hits GROUP BY product_id),
detected AS (
  SELECT p.*, coalesce(b.category_id, 'general') AS detected_id, coalesce(b.score, 0)::INTEGER AS detected_score
  FROM products p LEFT JOIN best b USING (product_id)),
resolved AS (
  SELECT *, CASE WHEN category_id = '' THEN detected_id
    WHEN category_id IN (SELECT id FROM kb) THEN category_id ELSE 'general' END AS resolved_id
  FROM detected)"""


def draw(h: str, slot: int = 0) -> str:
    return f"('0x' || substr({h}, {8 * slot + 1}, 8))::BIGINT"


def digest(seed: str, tag: str) -> str:
    return f"md5({seed} || '|' || {tag})"


def pick(number: str, values: str) -> str:
    return f"({values})[({number}) % len({values}) + 1]"


def seeded_int(seed: str, tag: str, lo: int, hi: int) -> str:
    return f"({draw(digest(seed, lit(tag)))} % {hi - lo + 1} + {lo})"


def sampled(seed: str, tag: str, values: str, k: int) -> str:
    keyed = f"list_transform({values}, lambda v: {{'h': md5({seed} || '|{tag}|' || v), 'v': v}})"
    return f"list_transform(list_sort({keyed})[1:{k}], lambda s: s.v)"


def fixed2(x: str) -> str:
    return f"CASE WHEN ({x}) * 8 = floor(({x}) * 8) THEN printf('%.2f', floor(({x}) * 100 + 0.5) / 100) ELSE printf('%.2f', {x}) END"


def money(x: str) -> str:
    return f"('$' || {fixed2(x)})"


def encode(x: str) -> str:
    out = f"url_encode({x})"
    for a, b in [("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*")]:
        out = f"replace({out}, {lit(a)}, {lit(b)})"
    return out


def short_name_ctes(source: str, key: str, name: str, out: str) -> str:
    """CTEs that end in ``out(key, p)``."""
    stop = lit(TRAILING_WORDS)
    loose = rf"(list_contains({stop}, lower(w[-1])) OR regexp_full_match(w[-1], '[\d.,]+'))"
    step = f"CASE WHEN len(w) > 2 AND {loose} THEN w[1:len(w)-1] ELSE w END"
    return f"""
{out}_w AS (SELECT {key}, string_split_regex(trim(coalesce(nullif(trim({name}), ''), 'este producto')), '\\s+')[1:4] AS w FROM {source}),
{out}_d AS (SELECT {key}, {step} AS w FROM {out}_w),
{out} AS (SELECT {key}, array_to_string({step}, ' ') AS p FROM {out}_d)"""


SCORED = f"""
scored0 AS (
  SELECT r.* EXCLUDE (category_id), 'cmp_' || sha256(concat_ws('|', r.product_id::VARCHAR, r.name, r.source_url)) AS campaign_id,
    r.name || r.source_url AS seed, k.* EXCLUDE (id, name, ord), k.name AS kb_name,
    least(5, greatest(3, visual_appeal)) AS content_ideas,
    least(5, floor((visual_appeal + ugc_fit + (5 - saturation) + explainability) / 4 + 0.5)
      + CASE WHEN {draw(digest("r.name || r.source_url", "'viral_potential'"))} >= 2147483648 THEN 1 ELSE 0 END)::INTEGER AS viral_potential,
    floor((price_lo + (price_hi - price_lo) * 0.55::DOUBLE) / 5 + 0.5) * 5 - 0.05::DOUBLE AS recommended_price,
    CASE WHEN visual_appeal >= 4 THEN 1 ELSE 0 END + CASE WHEN explainability >= 4 THEN 1 ELSE 0 END
      + CASE WHEN ugc_fit >= 4 THEN 1 ELSE 0 END + 2 + CASE WHEN saturation >= 4 THEN 0 ELSE 1 END AS positives,
    CASE WHEN saturation >= 4 THEN 1 ELSE 0 END AS negatives
  FROM resolved r JOIN kb k ON k.id = r.resolved_id),
scored1 AS (
  SELECT *, greatest(35, least(98, floor(
      (content_ideas + viral_potential + explainability + visual_appeal + ugc_fit) / 25 * 80 + (5 - saturation) / 5 * 20
      + {seeded_int('seed', 'score', -2, 3)} + 0.5)))::INTEGER AS score
  FROM scored0),
scored AS (
  SELECT *, greatest(25, least(95, floor(score * 0.6::DOUBLE + positives * 7 - negatives * 9
      + {seeded_int('seed', 'viral', 0, 6)} + 0.5)))::INTEGER AS probability
  FROM scored1)"""

LOWER_LIST = "list_transform({}, lambda v: lower(v))"
ENRICHED = f"""{short_name_ctes('products', 'product_id', 'name', 'shorts')},
enriched0 AS (
  SELECT s.*, n.p, lower(kb_name) AS cat, {sampled('seed', 'benefits', 'benefits', 7)} AS b,
    {LOWER_LIST.format('pain_list')} AS pains, {LOWER_LIST.format('audience_names')} AS auds,
    {money('recommended_price')} || ' USD' AS price_text,
    {pick(draw(digest('seed', "'person'")), lit(templates.PERSONS))} AS person,
    {sampled('seed', 'reviewers', lit(templates.REVIEW_NAMES), 4)} AS reviewers,
    {pick(draw(digest('seed', "'landing'")), 'desires')} AS desire0
  FROM scored s JOIN shorts n USING (product_id)),
enriched AS (SELECT *, {encode('p')} AS q, {encode("split_part(kb_name, ' ', 1)")} AS qcat FROM enriched0)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


def products_sql(select: str) -> str:
    return with_ctes(PRODUCTS) + "\n" + select


def resolved_sql(select: str) -> str:
    return with_ctes(kb_cte(), kw_cte(), PRODUCTS, DETECTED) + "\n" + select


def scored_sql(select: str) -> str:
    return with_ctes(kb_cte(), kw_cte(), PRODUCTS, DETECTED, SCORED) + "\n" + select


# ---- templates -------------------------------------------------------------------------------

def attrs_text(attrs: dict) -> str:
    return ";".join(f"{k}={attrs[k]}" for k in sorted(attrs))


def template_cte(module: str, name: str = "tpl") -> str:
    rows = [(r["module"], r["item_group"], r["ord"], "\x01".join([r["title"], r["text"], r["detail"], attrs_text(r["attrs"])]), r["lo"], r["hi"], r["lo2"],
             r["hi2"], r["attrs"].get("angle", "")) for m in ([module] if isinstance(module, str) else module) for r in templates.BUILTIN[m]]
    return values(name, "module item_group ord raw lo hi lo2 hi2 angle".split(), rows)


ANGLE_CTE = values("angle_hooks", ["angle", "lines"], list(templates.ANGLE_HOOKS.items()))


def offer_case() -> str:
    r = "recommended_price"
    texts = {
        "2x1": money(f"{r} * 1.7::DOUBLE"),
        "Bundle": f"{money(f'{r} * 1.25::DOUBLE')} || ' / ' || {money(f'{r} * 1.4::DOUBLE + 9.95::DOUBLE')}",
        "Compra 2 y recibe...": f"{money(f'{r} / 2')} || ' / ' || {money(r)}",
        "Regalo gratis": "'$3.00 / $14.95'",
        "Descuento progresivo": f"{money(f'{r} * 2 * 0.8::DOUBLE')} || ' / ' || {money(f'{r} * 3 * 0.7::DOUBLE')}",
        "Urgencia": f"{money(r)} || ' / ' || {money(f'{r} * 1.4::DOUBLE')}", "Escasez": "''",
    }
    return "CASE item_group " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in texts.items()) + " ELSE '' END"


def fill_expr(body: str) -> str:
    """Nested replacements over one joined row of enriched and template columns (with digest h)."""
    pairs = [
        ("pain", pick(draw("h", 0), "pains")), ("fear", pick(draw("h", 0), "fears")), ("desire", pick(draw("h", 1), "desires")),
        ("aud", pick(draw("h", 2), "auds")), ("benefit", f"lower({pick(draw('h', 1), 'b')})"),
        ("secondary", f"lower({pick(draw('h', 1), 'secondary_problems')})"),
        ("n", f"(({draw('h', 2)}) % (hi - lo + 1) + lo)::VARCHAR"), ("m", f"(({draw('h', 3)}) % (hi2 - lo2 + 1) + lo2)::VARCHAR"),
        ("cta", pick(draw("h", 1), lit(templates.CTAS))), ("offer", offer_case()),
        ("p", "p"), ("cat", "cat"), ("env", "environment"), ("demo", "demo_action"), ("wow", "wow_moment"), ("problem", "problem"),
        ("price", "price_text"), ("lo", "price_lo::VARCHAR"), ("person", "person"), ("q", "q"), ("qcat", "qcat"),
        ("auds", "array_to_string(auds, ', ')"), ("opening", "upper(desire0[1]) || desire0[2:]"),
        *[(f"b{i}", f"b[{i} % len(b) + 1]") for i in range(5)], *[(f"review{i}", f"reviewers[{i + 1}]") for i in range(4)],
    ]
    for slot, value in pairs:
        body = f"replace({body}, '{{{slot}}}', {value})"
    return body


def filled_ctes(tpl: str, out: str, hook: str | None = None) -> str:
    """CTEs ending in ``out``: enriched x templates with the filled title, text and detail."""
    line = f"(coalesce(a.lines, {lit(next(iter(templates.ANGLE_HOOKS.values())))}))"
    body = f"replace(raw, '{{anglehook}}', {line}[({draw('h', 3)}) % 3 + 1])"
    join = ""
    if hook:
        body = f"replace({body}, '{{hook}}', hk.text)"
        join = f"LEFT JOIN {hook} hk ON hk.product_id = x.product_id AND hk.ord = ({draw('h', 2)}) % {len(templates.BUILTIN['hooks'])} + 1"
    return f"""
{out}_x AS (SELECT e.*, t.*, md5(seed || '|' || module || '|' || t.ord::VARCHAR) AS h FROM enriched e CROSS JOIN {tpl} t),
{out}_b AS (SELECT x.*, {body} AS body FROM {out}_x x LEFT JOIN angle_hooks a ON a.angle = x.angle {join}),
{out} AS (SELECT product_id, campaign_id, seed, module, item_group, ord, string_split({fill_expr('body')}, chr(1)) AS f FROM {out}_b)"""


ITEM_COLUMNS = "product_id, campaign_id, module, item_group, ord, f[1] AS title, f[2] AS text, f[3] AS detail, f[4] AS attrs"


def base_ctes() -> list[str]:
    return [kb_cte(), kw_cte(), PRODUCTS, DETECTED, SCORED, ENRICHED, ANGLE_CTE]


def items_sql(module: str, select: str | None = None) -> str:
    parts = base_ctes()
    hook = None
    if module == "ads" or "ads" in module:
        parts += [template_cte("hooks", "hook_tpl"), filled_ctes("hook_tpl", "hook_filled"),
                  "hook_items AS (SELECT product_id, ord, f[2] AS text FROM hook_filled)"]
        hook = "hook_items"
    parts += [template_cte(module), filled_ctes("tpl", "filled", hook), f"items AS (SELECT {ITEM_COLUMNS} FROM filled)"]
    return with_ctes(*parts) + "\n" + (select or "SELECT * FROM items")


def all_items_ctes(modules: list[str]) -> list[str]:
    """CTEs that end in ``items``: all items of the modules, the drawn hook variants included."""
    element, _, _, metric = templates.AB_ELEMENTS[0]
    parts = base_ctes() + [template_cte("hooks", "hook_tpl"), filled_ctes("hook_tpl", "hook_filled"), "hook_items AS (SELECT product_id, ord, f[2] AS text FROM hook_filled)",
                           template_cte(modules), filled_ctes("tpl", "filled", "hook_items" if "ads" in modules else None)]
    drawn = f"""
  UNION ALL SELECT product_id, campaign_id, 'abtesting', {lit(element)}, ord, f[1], f[2], {lit(metric)}, f[4] FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY md5(seed || '|abtesting|' || ord::VARCHAR)) AS n FROM hook_filled) WHERE n <= 50"""
    return parts + [f"items AS (SELECT {ITEM_COLUMNS} FROM filled{drawn if 'abtesting' in modules else ''})"]


#: Number of an item's texts; sums of it stand for all texts of a group.
ITEM_HASH = "('0x' || substr(md5(concat_ws(chr(1), ord::VARCHAR, item_group, title, text, detail, attrs)), 1, 12))::BIGINT"


def enriched_sql(select: str) -> str:
    return with_ctes(*base_ctes()) + "\n" + select


PLAN_CTE = static("plans", "plan_id plan_name price credits campaign_limit rank", subscriptions.PLANS)
MODULE_CTE = static("modules", "ord module_id module_name module_group min_plan", [(i, *m) for i, m in enumerate(subscriptions.MODULES)])
COST_CTE = static("costs", "action cost", list(subscriptions.ACTION_COSTS.items()))

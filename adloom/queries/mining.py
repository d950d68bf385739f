"""Competitor copy and ad descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom.knowledge import rules as R
from adloom.operators import diagnosis, mining
from adloom.operators.catalog import spread
from adloom.operators.selection import first_match
from adloom.queries import sqlkit as S
from adloom.queries.inputs import table
from adloom.queries.registry import query
from adloom.sources.static import load_kb

c = F.col
RULES = R.extend(R.COMPETITOR, R.CORPUS_WORDS)
DIAGNOSIS = R.extend(R.DIAGNOSIS, R.CORPUS_WORDS)


def copies(spark, sf):
    """Documents as competitor copy; one in eleven has no usable URL."""
    k = c("doc_id")
    url = F.when(k % 11 == 0, c("source")).otherwise(F.concat(F.lit("https://www."), "source", F.lit(".example.com/p/"), k.cast("string")))
    return spread(table(spark, sf, "documents"), "doc_id").withColumns({"url": url, "name": F.concat(F.lit("producto "), c("lang"))})


COPIES = """copies AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN source ELSE 'https://www.' || source || '.example.com/p/' || doc_id END AS url, 'producto ' || lang AS name,
  trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS body FROM documents)"""
LINES = r"""lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY raw_pos) - 1 AS pos, line FROM (
    SELECT doc_id, generate_subscripts(l, 1) AS raw_pos, trim(unnest(l), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS line
    FROM (SELECT doc_id, string_split_regex(body, '\n+') AS l FROM copies)) WHERE length(line) > 8 AND length(line) < 160)"""


def rx(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {S.lit(pattern)}, 'i')"


def mined_ctes(r: dict) -> str:
    cta = f"({rx('line', r['cta_start'])} OR (length(line) < 40 AND {rx('line', r['cta_short'])}))"
    return S.with_ctes(COPIES, LINES) + f""",
hook_lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM lines WHERE {rx('line', r['hook'])}),
cta_lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM lines WHERE {cta}),
hooks AS (SELECT doc_id, list(line ORDER BY pos) AS hooks FROM hook_lines WHERE n <= 6 GROUP BY 1),
ctas AS (SELECT doc_id, list(line ORDER BY pos) AS ctas FROM cta_lines WHERE n <= 5 GROUP BY 1),
offers AS (SELECT doc_id, arg_min(line, pos) AS offer_line FROM lines WHERE {rx('line', r['offer_line'])} GROUP BY 1),
guarantees AS (SELECT doc_id, arg_min(line, pos) AS guarantee_line FROM lines WHERE {rx('line', r['guarantee_line'])} GROUP BY 1),
mined AS (
  SELECT d.*, hooks, ctas, offer_line, guarantee_line, {rx('body', r['transformation'])} AS has_transformation, {rx('body', r['social_proof'])} AS has_social_proof,
    {rx('body', r['offer'])} AS has_offer, {rx('body', r['guarantee'])} AS has_guarantee
  FROM copies d LEFT JOIN hooks USING (doc_id) LEFT JOIN ctas USING (doc_id) LEFT JOIN offers USING (doc_id) LEFT JOIN guarantees USING (doc_id)),
report AS (
  SELECT doc_id, url, source, lang, name, array_to_string(coalesce(hooks, {S.lit(R.NO_HOOKS)}), ' | ') AS hooks, array_to_string(coalesce(ctas, {S.lit(R.NO_CTAS)}), ' | ') AS ctas,
    CASE WHEN length(body) <= 100 THEN 'no_text' WHEN has_transformation THEN 'transformation' WHEN has_social_proof THEN 'social_proof' ELSE 'direct' END AS storytelling,
    CASE WHEN has_offer THEN coalesce(offer_line, {S.lit(R.DEFAULT_OFFER)}) ELSE {S.lit(R.NO_OFFER)} END AS offer,
    CASE WHEN has_guarantee THEN coalesce(guarantee_line, {S.lit(R.DEFAULT_GUARANTEE)}) ELSE {S.lit(R.NO_GUARANTEE)} END AS guarantee,
    CASE WHEN doc_id % 11 = 0 THEN source ELSE lower(source) || '.example.com' END || ' → ' || coalesce(left(hooks[1], 40), {S.lit(R.DEFAULT_HOOK)})
      || ' → ' || coalesce(ctas[1], {S.lit(R.DEFAULT_CTA)}) AS framework
  FROM mined)
"""


BASE = mined_ctes(RULES)


def mined(spark, sf, rules=RULES):
    return mining.mine(copies(spark, sf), rules)


@query("competitor_lines", S.with_ctes(COPIES, LINES) + "\nSELECT doc_id, pos, line FROM lines")
def _(spark, sf):
    return mining.competitor_lines(copies(spark, sf))


@query("extract_hooks", BASE + "SELECT doc_id, hooks FROM report")
def _(spark, sf):
    return mined(spark, sf).select("doc_id", F.array_join(mining.or_placeholder(c("hooks"), R.NO_HOOKS), " | ").alias("hooks"))


@query("extract_hooks_default_rules", mined_ctes(R.COMPETITOR) + "SELECT doc_id, hooks, ctas, storytelling FROM report")
def _(spark, sf):
    out = mined(spark, sf, R.COMPETITOR)
    return out.select("doc_id", F.array_join(mining.or_placeholder(c("hooks"), R.NO_HOOKS), " | ").alias("hooks"),
                      F.array_join(mining.or_placeholder(c("ctas"), R.NO_CTAS), " | ").alias("ctas"), mining.storytelling().alias("storytelling"))


@query("extract_ctas", BASE + "SELECT doc_id, ctas FROM report")
def _(spark, sf):
    return mined(spark, sf).select("doc_id", F.array_join(mining.or_placeholder(c("ctas"), R.NO_CTAS), " | ").alias("ctas"))


@query("first_match", BASE + "SELECT doc_id, arg_min(line, pos) AS line FROM lines WHERE contains(line, ' the ') GROUP BY 1")
def _(spark, sf):
    line = first_match(c("lines"), lambda x: x.contains(" the "))
    return mined(spark, sf).select("doc_id", line.alias("line")).filter(c("line").isNotNull())


@query("storytelling_class", BASE + "SELECT doc_id, storytelling FROM report")
def _(spark, sf):
    return mined(spark, sf).select("doc_id", mining.storytelling().alias("storytelling"))


@query("offer_detection", BASE + "SELECT doc_id, offer FROM report")
def _(spark, sf):
    return mined(spark, sf).select("doc_id", mining.offer_evidence().alias("offer"))


@query("guarantee_detection", BASE + "SELECT doc_id, guarantee FROM report")
def _(spark, sf):
    return mined(spark, sf).select("doc_id", mining.guarantee_evidence().alias("guarantee"))


@query("ad_framework", BASE + "SELECT doc_id, framework FROM report")
def _(spark, sf):
    return mined(spark, sf).select("doc_id", mining.ad_framework(c("url")).alias("framework"))


@query("competitor_report", BASE + f"""SELECT doc_id, url, hooks, ctas, storytelling, offer, guarantee, framework, {S.lit(' | '.join(R.WEAKNESSES))} AS weaknesses,
  replace({S.lit(' | '.join(R.COUNTER_MOVES))}, '{{k}}', {S.seeded_int('(url || name)', 'competitor', 2, 3)}::VARCHAR) AS counter_moves, {S.lit(' | '.join(R.COLOR_TODOS))} AS colors FROM report""")
def _(spark, sf):
    out = mining.competitor_report(copies(spark, sf), RULES)
    return out.withColumns({k: F.array_join(k, " | ") for k in ["hooks", "ctas", "weaknesses", "counter_moves", "colors"]})


@query("competitor_corpus_stats", BASE + """SELECT source, lang, count(*) AS docs, round(avg((hooks IS NOT NULL)::INTEGER), 6) AS hook_rate, round(avg((ctas IS NOT NULL)::INTEGER), 6) AS cta_rate,
  round(avg(has_transformation::INTEGER), 6) AS transformation_rate, round(avg(has_social_proof::INTEGER), 6) AS social_proof_rate,
  round(avg(has_offer::INTEGER), 6) AS offer_rate, round(avg(has_guarantee::INTEGER), 6) AS guarantee_rate FROM mined GROUP BY 1, 2""")
def _(spark, sf):
    return mining.corpus_stats(mined(spark, sf), ["source", "lang"])


def descriptions(spark, sf):
    return table(spark, sf, "conversations")


def diagnosis_ctes(r: dict) -> str:
    codes = {"short": "length(d) < 60", "no_hook": f"NOT {rx('d', r['mentions_hook'])}", "brand_intro": rx("d", r["brand_intro"]),
             "too_long": f"{rx('d', r['long_video'])} AND NOT {rx('d', r['warm_traffic'])}", "no_close": f"NOT {rx('d', r['mentions_close'])}",
             "generic_audio": rx("d", r["generic_audio"])}
    listed = ", ".join(f"CASE WHEN {t} THEN {S.lit(k)} END" for k, t in codes.items())
    return f"""WITH found AS (SELECT conv_id, turn, text, list_filter([{listed}], lambda x: x IS NOT NULL) AS i
  FROM (SELECT *, lower(text) AS d FROM conversations)),
issues AS (SELECT conv_id, turn, text, CASE WHEN len(i) = 0 THEN ['fine_tuning'] ELSE i END AS issues FROM found)
"""


DIAG = diagnosis_ctes(DIAGNOSIS)
MESSAGES = "CASE x " + " ".join(f"WHEN {S.lit(k)} THEN {S.lit(v)}" for k, v in [*R.ISSUES.items(), R.DEFAULT_ISSUE]) + " END"


@query("diagnose", DIAG + f"SELECT conv_id, turn, array_to_string(issues, ',') AS issues, array_to_string(list_transform(issues, lambda x: {MESSAGES}), ' | ') AS messages FROM issues")
def _(spark, sf):
    out = diagnosis.diagnose(descriptions(spark, sf), rules=DIAGNOSIS)
    return out.select("conv_id", "turn", F.array_join("issues", ",").alias("issues"), F.array_join("messages", " | ").alias("messages"))


@query("diagnose_default_rules", diagnosis_ctes(R.DIAGNOSIS) + "SELECT conv_id, turn, array_to_string(issues, ',') AS issues FROM issues")
def _(spark, sf):
    return diagnosis.diagnose(descriptions(spark, sf)).select("conv_id", "turn", F.array_join("issues", ",").alias("issues"))


@query("default_issue", DIAG + "SELECT conv_id, turn, issues[1] = 'fine_tuning' AS is_default FROM issues")
def _(spark, sf):
    out = diagnosis.diagnose(descriptions(spark, sf), rules=DIAGNOSIS)
    return out.select("conv_id", "turn", (F.get("issues", F.lit(0)) == R.DEFAULT_ISSUE[0]).alias("is_default"))


def advised(spark, sf):
    kb = F.broadcast(load_kb(spark).select("ord", "wow_moment", "environment"))
    out = diagnosis.diagnose(descriptions(spark, sf), rules=DIAGNOSIS).join(kb, c("conv_id") % 12 == c("ord"))
    return diagnosis.advice_lists(out)


def fixed(texts):
    body = S.lit(" | ".join(texts))
    for slot, value in {"wow": "wow_moment", "env": "environment", "a": S.seeded_int("text", "change_a", 10, 20) + "::VARCHAR",
                        "b": S.seeded_int("text", "change_b", 10, 40) + "::VARCHAR"}.items():
        body = f"replace({body}, '{{{slot}}}', {value})"
    return body


@query("advice_lists", DIAG.rstrip() + ",\n" + S.kb_cte() + f"""
SELECT conv_id, turn, CASE WHEN list_contains(issues, 'brand_intro') THEN {S.lit(R.BRAND_REMOVAL + ' | ')} ELSE '' END || {S.lit(' | '.join(R.REMOVALS))} AS remove, {fixed(R.ADDITIONS)} AS add,
  {fixed(R.TESTS)} AS test, {fixed(R.HOOK_CHANGES)} AS hook_changes, {fixed(R.CTA_CHANGES)} AS cta_changes, {fixed(R.PACING_CHANGES)} AS pacing_changes
FROM issues JOIN kb ON kb.ord = conv_id % 12""")
def _(spark, sf):
    names = ["remove", "add", "test", "hook_changes", "cta_changes", "pacing_changes"]
    return advised(spark, sf).select("conv_id", "turn", *[F.array_join(n, " | ").alias(n) for n in names])


@query("append_fixed", DIAG + f"SELECT conv_id, turn, len(issues) + 2 AS n, issues[1] || '/' || 'b' AS ends FROM issues")
def _(spark, sf):
    both = diagnosis.append_fixed(c("issues"), ["a", "b"])
    out = diagnosis.diagnose(descriptions(spark, sf), rules=DIAGNOSIS)
    return out.select("conv_id", "turn", F.size(both).alias("n"), F.concat_ws("/", F.get(both, F.lit(0)), F.element_at(both, -1)).alias("ends"))


@query("issue_frequency", DIAG + "SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM issues) GROUP BY 1")
def _(spark, sf):
    return diagnosis.issue_frequency(diagnosis.diagnose(descriptions(spark, sf), rules=DIAGNOSIS))

"""Registered queries of the operators, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from adloom.llm import (conversations, decontaminate, exact_dedup, license, line_dedup, minhash, mixing, quality, secrets, spelling, suffixes,
                        toxicity, warc)

QUERIES: dict = {}
SQL: dict[str, str] = {}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return add


def table(spark, sf: str, name: str):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_warc", """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f""")
def op1_warc(spark, sf):
    return warc.archive_digests(table(spark, sf, "pages"))


@query("op4_exact_dedup", f"""
WITH t AS (SELECT doc_id, sha256({LOWER.format("coalesce(text, '')")}) AS text_sha256, {LOWER.format("coalesce(text, '')")} AS content FROM documents),
g AS (SELECT content, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY content)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM t JOIN g USING (content)""")
def op4_exact_dedup(spark, sf):
    return exact_dedup.duplicate_groups(table(spark, sf, "documents"))


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix-1/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cut FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(cut) OVER (ORDER BY cut / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cut / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
water AS (SELECT min_by(level, cut / weight) FILTER (WHERE cut > level * weight) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN water.level IS NULL THEN cut ELSE least(cut, water.level * weight) END AS target FROM l, water),
b1 AS (SELECT *, CAST(floor(sum(target) OVER () / 16 + 0.5) AS BIGINT) AS blocks, count(*) OVER () AS n, sum(target) OVER () AS votes FROM t),
q1 AS (SELECT *, unnest(generate_series(1, CAST(floor(CASE WHEN votes > 0 THEN target / votes ELSE 0 END * (blocks + 0.5 * n)) AS BIGINT) + 2)) AS k FROM b1),
r1 AS (SELECT *, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source NULLS LAST, k) AS place FROM q1),
a AS (SELECT source, any_value(source_size) AS source_size, any_value(target) AS target, count(*) FILTER (WHERE place <= blocks AND target > 0) AS source_blocks,
    greatest(CAST(ceil(any_value(source_size) / 1048576) AS BIGINT), 1) AS shards FROM r1 GROUP BY source),
m AS (SELECT d.*, a.source_size, a.target, a.source_blocks, CAST(('0x' || substr(ord, 1, 8)) AS BIGINT) % a.shards AS shard FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
h AS (SELECT source, shard, any_value(source_blocks) AS blocks, CAST(sum(size) AS BIGINT) AS length FROM m GROUP BY source, shard),
b2 AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, sum(length) OVER (PARTITION BY source) AS votes FROM h),
q2 AS (SELECT *, unnest(generate_series(1, CAST(floor(CASE WHEN votes > 0 THEN length / votes ELSE 0 END * (blocks + 0.5 * n)) AS BIGINT) + 2)) AS k FROM b2),
r2 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length / (2 * k - 1) DESC, shard, k) AS place FROM q2),
c AS (SELECT source, shard, any_value(length) AS length, least(16 * count(*) FILTER (WHERE place <= blocks AND length > 0), 2 * any_value(length)) AS quota FROM r2 GROUP BY source, shard),
p AS (SELECT m.*, c.length, c.quota, coalesce(sum(size) OVER (PARTITION BY m.source, m.shard ORDER BY ord, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM m JOIN c ON m.source IS NOT DISTINCT FROM c.source AND m.shard = c.shard)
SELECT doc_id, source, size, source_size, target,
  CAST(CASE WHEN length > 0 THEN quota // length ELSE 0 END * size
    + greatest(0, least(quota - CASE WHEN length > 0 THEN quota // length ELSE 0 END * length - start, size)) AS BIGINT) AS taken
FROM p"""


@query("op7_mixing", MIX_SQL)
def op7_mixing(spark, sf):
    return mixing.mix(table(spark, sf, "documents"))


@query("op3_toxicity")
def op3_toxicity(spark, sf):
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


LICENSE_SQL = f"""
WITH w AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT template, label, template < {len(license.BASE)} AS is_base, string_split(phrase, ' ') AS tw FROM (VALUES
  {", ".join(f"({i}, '{p}', '{l}')" for i, (p, l) in enumerate([*license.BASE, *license.TEMPLATES]))}) v(template, phrase, label)),
tp AS (SELECT template, label, is_base, len(tw) - 1 AS t_grams, unnest(generate_series(0, len(tw) - 2)) AS t_pos, tw FROM t),
g AS (SELECT row, unnest(generate_series(0, len(w) - 2)) AS pos, w FROM w),
v AS (SELECT g.row, template, label, is_base, t_grams, pos, t_pos, pos - t_pos AS diagonal FROM (SELECT row, pos, w[pos + 1] AS a, w[pos + 2] AS b FROM g) g
  JOIN (SELECT *, tw[t_pos + 1] AS a, tw[t_pos + 2] AS b FROM tp) tp ON g.a = tp.a AND g.b = tp.b),
d AS (SELECT row, template, label, is_base, t_grams, diagonal, count(*) AS votes, min(pos) AS low, max(pos) AS high, min(t_pos) AS t_low FROM v GROUP BY ALL),
b AS (SELECT row, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list(label) AS labels FROM d WHERE is_base AND votes = t_grams GROUP BY row),
m AS (SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER o) <= 2 AND low <= lag(high) OVER o + 4 AND t_low > lag(t_low) OVER o THEN 0 ELSE 1 END AS fresh
  FROM d WHERE NOT is_base WINDOW o AS (PARTITION BY row, template ORDER BY low, diagonal)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY row, template ORDER BY low, diagonal) AS span FROM m),
s AS (SELECT row, template, label, span, min(low) AS first_pos, max(high) AS last_pos, least(sum(votes) / any_value(t_grams), 1.0) AS cover FROM n GROUP BY row, template, label, span),
o AS (SELECT row, list(label) AS labels, max(cover) AS cover FROM s WHERE cover >= 0.75 GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(b.labels)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(o.labels, [])))), ','), '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(cover, 0.0) END AS DOUBLE) AS score
FROM w LEFT JOIN b USING (row) LEFT JOIN o USING (row)"""


@query("op10_license", LICENSE_SQL)
def op10_license(spark, sf):
    return license.scan(table(spark, sf, "documents")).drop("spans")


@query("op6_decontamination")
def op6_decontamination(spark, sf):
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "cover", "slots", "first_word", "last_word")


@query("op5_minhash")
def op5_minhash(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"))


@query("op8_quality")
def op8_quality(spark, sf):
    # Documents carry no URL: their source stands for the host, their language for a path of it.
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op9_line_dedup")
def op9_line_dedup(spark, sf):
    return line_dedup.line_report(table(spark, sf, "documents"))


@query("op2_secrets")
def op2_secrets(spark, sf):
    return secrets.scan(table(spark, sf, "documents"))


#: DuckDB has no crc32: its table by rule, and the checksum of a text column over that table (``tab``).
CRC_TABLE = """(SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab)"""


def crc32_sql(text: str) -> str:
    data = f"list_transform(range(1, strlen({text}) + 1), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {data}), lambda a, b: xor(a >> 8, tab[xor(a, b) % 256 + 1])), 4294967295)"


SPELLING_SQL = f"""
WITH RECURSIVE r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({LOWER.format("text")}, '[a-zA-Z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
h AS (SELECT run, {crc32_sql("(id || ':' || run)")} AS h FROM r, {CRC_TABLE} WHERE length(run) >= 7),
o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM h),
v AS (SELECT word, count(*) AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
d AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, unnest(range(CAST(length(word) AS INT)))::INT AS i FROM v)),
p AS (SELECT a.word AS one, b.word AS two FROM d a JOIN d b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.cut = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.cut = v.word),
b AS (SELECT one AS word, count(*) AS n_near, arg_min(struct_pack(w := two, n := v.n), struct_pack(a := -v.n, b := two)) AS best FROM p JOIN v ON p.two = v.word GROUP BY one),
f AS (SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN best.n >= 10 * v.n THEN best.w END AS form, CASE WHEN best.n >= 10 * v.n THEN best.n END AS form_n
  FROM v LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root, 0 AS hops FROM f UNION ALL SELECT c.word, f.form, hops + 1 FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.*, root FROM f JOIN (SELECT word, arg_max(root, hops) AS root FROM c GROUP BY word) USING (word)"""


@query("op12_spelling", SPELLING_SQL)
def op12_spelling(spark, sf):
    return spelling.variants(table(spark, sf, "documents"))


REPAIR_SQL = f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT conv_id, turn, role, text, {crc32_sql("key")} % 20 AS h FROM k, {CRC_TABLE}),
e AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS repeated,
    trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM e),
w AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before,
    CASE WHEN bare = '' THEN 'blank' WHEN repeated THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
s AS (SELECT conv_id, max(place) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM w GROUP BY conv_id),
-- Nodes: 0 nothing, 1 system, 2 user, 3 assistant was written last. The value is the cost nr a fixed width, then the audit.
edges AS (SELECT * FROM (VALUES (0, 2), (1, 2), (2, 3), (3, 2)) v(node, next)),
paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS place, 0 AS node, '00000000' AS value FROM s
  UNION ALL
  SELECT conv_id, any_value(place) AS place, node, min(value) AS value FROM (
    SELECT i.conv_id, w.place, t.node, lpad(CAST(CAST(left(i.value, 8) AS INT) + t.cost AS VARCHAR), 8, '0') || substr(i.value, 9) || t.letter AS value
    FROM (
      SELECT conv_id, place, node, value FROM paths
      UNION ALL
      SELECT conv_id, place, next, lpad(CAST(CAST(left(value, 8) AS INT) + 3 AS VARCHAR), 8, '0') || substr(value, 9) || 'I' FROM paths JOIN edges USING (node)) i
    JOIN w ON w.conv_id IS NOT DISTINCT FROM i.conv_id AND w.place = i.place + 1
    JOIN edges g ON g.node = i.node,
    LATERAL (SELECT unnest([
      {{'node': i.node, 'cost': 4, 'letter': 'D', 'able': true}},
      {{'node': 1, 'cost': CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'letter': 'K', 'able': fault IN ('', 'truncated') AND i.node = 0 AND initial = 's'}},
      {{'node': g.next, 'cost': CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END + CASE WHEN initial = substr('ua', g.next - 1, 1) THEN 0 ELSE 3 END,
        'letter': CASE WHEN initial = substr('ua', g.next - 1, 1) THEN 'K' ELSE 'R' END, 'able': fault IN ('', 'truncated')}}], recursive := true)) t
    WHERE t.able) GROUP BY conv_id, node),
last AS (SELECT s.conv_id, min(CASE WHEN node IN (0, 3) THEN value WHEN node = 2 THEN lpad(CAST(CAST(left(value, 8) AS INT) + 3 AS VARCHAR), 8, '0') || substr(value, 9) || 'I' END) AS value
  FROM paths JOIN s ON s.conv_id IS NOT DISTINCT FROM paths.conv_id AND s.n = paths.place GROUP BY s.conv_id),
a AS (SELECT conv_id, substr(value, 9) AS audit, CAST(left(value, 8) AS BIGINT) AS cost FROM last),
l AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS nr, audit FROM a),
m AS (SELECT conv_id, nr, audit[nr] AS letter, sum(CASE WHEN audit[nr] <> 'I' THEN 1 ELSE 0 END) OVER o AS place, sum(CASE WHEN audit[nr] <> 'D' THEN 1 ELSE 0 END) OVER o AS written
  FROM l WINDOW o AS (PARTITION BY conv_id ORDER BY nr)),
q AS (SELECT m.conv_id, m.nr, m.letter, m.written, CASE WHEN m.letter = 'I' THEN '' ELSE w.role END AS role, CASE WHEN m.letter = 'I' THEN '' ELSE w.text END AS text
  FROM m LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND w.place = m.place WHERE m.letter <> 'D'),
z AS (SELECT conv_id, max(CASE WHEN written = 1 AND letter = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) AS system FROM q GROUP BY conv_id),
t AS (SELECT q.conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (written - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY nr)) AS sha
  FROM q JOIN z ON q.conv_id IS NOT DISTINCT FROM z.conv_id GROUP BY q.conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query("op13_conversations", REPAIR_SQL)
def op13_conversations(spark, sf):
    return conversations.damage_report(table(spark, sf, "conversations"))


REPEATS_SQL = """
WITH t AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT row, doc_id, s, substr(x, 2 * s + 1, 100) AS g FROM (SELECT *, unnest(range(greatest(length(x) // 2 - 49, 0))) AS s FROM t WHERE doc_id IS NOT NULL)),
m AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT row, s, max(s + 50) OVER (PARTITION BY row ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g JOIN m USING (g) WHERE doc_id > low),
i AS (SELECT row, s, sum(CASE WHEN reach >= s THEN 0 ELSE 1 END) OVER (PARTITION BY row ORDER BY s) AS span FROM c),
b AS (SELECT row, min(s) AS low, max(s) + 50 AS high FROM i GROUP BY row, span),
k AS (SELECT row, coalesce(lag(high) OVER (PARTITION BY row ORDER BY low), 0) AS low, low AS high FROM b
  UNION ALL SELECT t.row, coalesce(max(high), 0), any_value(length(x) // 2) FROM t LEFT JOIN b USING (row) GROUP BY t.row),
r AS (SELECT row, string_agg(substr(x, 2 * low + 1, 2 * (high - low)), '' ORDER BY low) AS kept FROM k JOIN t USING (row) GROUP BY row),
n AS (SELECT row, sum(high - low) AS n_removed, count(*) AS n_spans FROM b GROUP BY row)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(kept)) AS kept_sha256 FROM t JOIN r USING (row) LEFT JOIN n USING (row)"""


@query("op11_suffix_array", REPEATS_SQL)
def op11_suffix_array(spark, sf):
    return suffixes.digests(table(spark, sf, "documents"))

"""Queries of learned names, candidates, layouts and fresh stock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.functions import names as N
from stockloom.operators import layout as Y
from stockloom.operators import learning as H
from stockloom.operators import resolution as R
from stockloom.operators import stock as S
from stockloom.sources.adapters import MARKS, PIECES, STORED, USES, asked_names, goods, invoice_lines, learned_rules, movements, page_tokens, picked, read, split_list

from .name_queries import CUT, SKIN, STORE, sql_canonical, sql_mended, sql_print
from .registry import query

#: A fixed dictionary for the names of parts: target, category, alias.
DICTIONARY = (("WIDGET", "A", "widget"), ("GADGET", "A", "gadget"), ("BOLT", "B", "bolt"), ("GEAR", "B", "gear"), ("RING", "B", "ring"), ("GIZMO", "A", "gizmo"), ("BIG BOLT", "B", "large bolt"), ("RED RING", "B", "red ring"))
ROWS = ", ".join(f"('{t}', '{c}', '{a}')" for t, c, a in DICTIONARY)


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {ROWS} AS d(target, category, alias)")


@query(f"""WITH d(target, category, alias) AS (VALUES {ROWS}), n AS (SELECT DISTINCT replace(p_name, 'o', '0') AS name, CASE WHEN p_partkey % 2 = 0 THEN 'B' END AS hint FROM part),
 b AS (SELECT name, hint, lower(replace(name, ' ', '')) AS k, target, category, replace(alias, ' ', '') AS dk FROM n JOIN d ON hint IS NULL OR hint = category), c AS (SELECT *, round(1 - levenshtein(k, dk) / greatest(length(k), length(dk)), 9) AS s, levenshtein(k, dk) AS l FROM b),
 o AS (SELECT *, row_number() OVER w AS rn, lead(s) OVER w AS nx FROM c WINDOW w AS (PARTITION BY name, hint ORDER BY s DESC, l, target, category))
 SELECT name, hint, CASE WHEN s >= 0.5 THEN target END AS target, s AS similarity, round(s - coalesce(nx, s - 1), 9) AS margin, CASE WHEN s < 0.5 THEN 'NONE' WHEN NOT (k <> dk AND contains(k, dk)) AND l <= CASE WHEN greatest(length(k), length(dk)) <= 2 THEN 0 WHEN greatest(length(k), length(dk)) <= 5 THEN 1 ELSE 2 END AND s >= 0.65
  AND round(s - coalesce(nx, s - 1), 9) >= CASE WHEN greatest(length(k), length(dk)) <= 3 THEN 0.2 ELSE 0.12 END THEN 'AUTO' ELSE 'REVIEW' END AS decision FROM o WHERE rn = 1""")  # fmt: skip
def er_fuzzy_cut(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "part").select(F.replace("p_name", F.lit("o"), F.lit("0")).alias("name"), F.when(F.col("p_partkey") % 2 == 0, "B").alias("hint"))
    return R.fuzzy(names, dictionary(spark))


#: The score of each distinct misread name's best part for each entry: the whole or a part of the alias's length, one less or one more; edits or 0.88 of the letters in common.
RANKED = f"""d(target, category, alias) AS (VALUES {ROWS}), n AS (SELECT DISTINCT replace(p_name, 'o', '0') AS name, lower(replace(replace(p_name, 'o', '0'), ' ', '')) AS k FROM part),
 y AS (SELECT name, k, target, category, replace(alias, ' ', '') AS a, length(replace(alias, ' ', '')) AS m FROM n, d),
 z AS (SELECT DISTINCT name, target, category, a, m, unnest(list_prepend(k, flatten(list_transform([m - 1, m, m + 1], lambda j: CASE WHEN j = m - 1 OR j <= length(k) THEN list_transform(range(1, greatest(1, length(k) - j + 1) + 1), lambda i: substr(k, i, j)) ELSE [] END)))) AS p FROM y),
 v AS (SELECT name, target, category, greatest(1 - levenshtein(p, a) / greatest(length(p), m), 0.88::DOUBLE * (2 * list_sum(list_transform(list_distinct(string_split(p, '')), lambda c: least(length(p) - length(replace(p, c, '')), m - length(replace(a, c, ''))))) / (length(p) + m))) AS s FROM z WHERE p <> ''),
 e AS (SELECT name, category, target, round(max(s), 9) AS score FROM v GROUP BY 1, 2, 3), ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, length(target) DESC, target, category) AS place FROM e)"""


def misread(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.replace("p_name", F.lit("o"), F.lit("0")).alias("name"))


@query(f"WITH {RANKED} SELECT name, category, target, score, CAST(place AS INT) AS place FROM ranked WHERE place <= 5")
def er_rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(misread(spark, d), dictionary(spark))


@query(f"WITH {RANKED} SELECT name, CASE WHEN score >= 0.65 THEN target END AS cut, CASE WHEN score >= 0.8 THEN 'AUTO' WHEN score >= 0.65 THEN 'REVIEW' ELSE 'NONE' END AS decision FROM ranked WHERE place = 1")
def er_resolve(spark: SparkSession, d: str) -> DataFrame:
    """No rule of the cuts knows these names, so the dictionary decides on all of them."""
    return R.resolved(misread(spark, d), dictionary(spark))


@query(f"WITH {RANKED} SELECT name, CASE WHEN max(score) >= 0.65 THEN arg_min(target, place) END AS suggestion, CAST(floor(max(score) * 100 + 0.5) AS BIGINT) AS confidence, max(score) < 0.805 AS review, string_agg(target, '|' ORDER BY place) FILTER (place IN (2, 3)) AS others FROM ranked GROUP BY 1")
def er_suggest(spark: SparkSession, d: str) -> DataFrame:
    return R.suggestions(misread(spark, d), dictionary(spark))


#: DuckDB counts edits in bytes, so the letters of the names are first replaced by single bytes.
LETTERS = "".join(sorted({c for w in (*STORED, *MARKS, *PIECES, *USES, "호쌀농협") for c in w if c > "\x7f"}))
BYTES = "".join(c for c in map(chr, range(33, 127)) if c not in "'\\lpc0123456789")[: len(LETTERS)]
ascii_of = lambda x: f"translate({x}, '{LETTERS}', '{BYTES}')"
STORED_WORD = lambda x: f"CASE WHEN contains({sql_mended(x)}, '냉동') THEN '냉동' WHEN contains({sql_mended(x)}, '냉장') THEN '냉장' END"
CASES = lambda x, rules: "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{v}'" for p, v in rules) + " END"
LEAST = "CASE WHEN least(length(n.key), length(r.key)) <= 4 THEN 0.95 WHEN least(length(n.key), length(r.key)) <= 7 THEN 0.86 ELSE 0.82 END"
AGREE = "(n.said IS NULL OR r.said IS NULL OR n.said = r.said)"
LEARNED = f"""r0 AS (SELECT supplier, {sql_print('source')} AS key, source, target, category, storage, priority, {sql_print('target')} AS print, {STORED_WORD('source')} AS said, priority * 1000000000 + confidence * 1000000 + least(success, 999) * 1000 + day AS rank, confidence FROM learned_rules),
 r AS (SELECT * FROM r0 WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY supplier, key ORDER BY rank DESC, source DESC, target DESC, category DESC, storage DESC, priority DESC, print DESC) = 1),
 n AS (SELECT id, supplier, name, {sql_print('name')} AS key, {STORED_WORD('name')} AS said, {CASES("coalesce(hint, '')", N.HINTS)} AS hinted, {CASES("replace(name, ' ', '')", N.STATED)} AS stated FROM asked_names),
 p0 AS (SELECT n.id, r.category, r.storage, r.print, r.target, length(r.key) AS size, r.rank, r.confidence FROM n JOIN r ON r.supplier = n.supplier AND starts_with(n.key, r.key) AND length(n.key) > length(r.key) AND length(r.key) >= 4
  WHERE regexp_matches(name, '주식회사|농협|엘피씨|도드람|유통회사|축산유통|미트유통') AND {AGREE} AND (length(r.key) >= 6 OR r.storage <> '' AND n.said = r.storage AND coalesce(hinted = r.category, true) AND coalesce(stated = r.category, true))),
 p1 AS (SELECT * FROM p0 QUALIFY row_number() OVER (PARTITION BY id, category, storage, print ORDER BY size DESC, rank DESC, category DESC, storage DESC, print DESC, target DESC) = 1),
 p AS (SELECT id, target, category, storage, confidence FROM (SELECT *, row_number() OVER w AS k, lead(size) OVER w AS second FROM p1 WINDOW w AS (PARTITION BY id ORDER BY size DESC, rank DESC, category DESC, storage DESC, print DESC, target DESC)) WHERE k = 1 AND (second IS NULL OR size - second >= 3)),
 x AS (SELECT n.*, a.target AS own, p.target AS pre, g.target AS every, coalesce(a.category, p.category, g.category) AS lc, coalesce(a.storage, p.storage, g.storage) AS ls, coalesce(a.confidence, p.confidence, g.confidence) AS lq FROM n LEFT JOIN r a ON a.supplier = n.supplier AND a.key = n.key LEFT JOIN p ON p.id = n.id LEFT JOIN r g ON g.supplier IS NULL AND g.key = n.key),
 f0 AS (SELECT n.id, r.supplier, r.print, r.target, r.category, r.storage, r.confidence, r.rank, r.priority, round(1 - levenshtein({ascii_of('n.key')}, {ascii_of('r.key')}) / greatest(length(n.key), length(r.key)), 9) AS similarity FROM x n JOIN r ON (r.supplier IS NULL OR r.supplier = n.supplier) AND {AGREE} WHERE own IS NULL AND pre IS NULL AND every IS NULL AND round(1 - levenshtein({ascii_of('n.key')}, {ascii_of('r.key')}) / greatest(length(n.key), length(r.key)), 9) >= {LEAST}),
 f1 AS (SELECT *, round(similarity + CASE WHEN supplier IS NULL THEN 0 ELSE 0.03::DOUBLE END + least(priority, 500) / 100000, 9) AS score, CASE WHEN supplier IS NULL THEN 'global_fuzzy' ELSE 'supplier_fuzzy' END AS way FROM f0),
 f2 AS (SELECT * FROM f1 QUALIFY row_number() OVER (PARTITION BY id, print ORDER BY score DESC, rank DESC, similarity DESC, print DESC, target DESC, way DESC) = 1),
 f AS (SELECT * FROM (SELECT *, row_number() OVER w AS k, lead(similarity) OVER w AS second FROM f2 WINDOW w AS (PARTITION BY id ORDER BY score DESC, rank DESC, similarity DESC, print DESC, target DESC, way DESC)) WHERE k = 1 AND (second IS NULL OR round(similarity - second, 9) >= 0.06))"""


@query(f"""WITH {LEARNED} SELECT x.id, coalesce(own, pre, every, f.target) AS target, CASE WHEN own IS NOT NULL THEN 'supplier_exact' WHEN pre IS NOT NULL THEN 'supplier_prefix' WHEN every IS NOT NULL THEN 'global_exact' ELSE f.way END AS "by",
 CASE WHEN own IS NULL AND pre IS NOT NULL THEN 0.97 WHEN coalesce(own, every) IS NOT NULL THEN 1 ELSE f.similarity END::DOUBLE AS similarity FROM x LEFT JOIN f ON f.id = x.id""")
def er_find_learned(spark: SparkSession, d: str) -> DataFrame:
    return R.found_rules(asked_names(spark, d), learned_rules(spark, d)).select("id", "target", "by", "similarity")


STANDARD = "CASE " + " ".join(f"WHEN {'skin = ' + repr('skinless') + ' AND ' if s[0] == '삼겹살' else ''}(contains(c, '{s[0]}') OR regexp_matches(c, '(^|[\\s(])({a})($|[\\s()])')) THEN '{'|'.join(s[1:])}'" for s, (_, a) in zip(N.STANDARDS, N.ALIASES, strict=True)) + " END"


@query(f"""WITH {LEARNED}, l AS (SELECT x.id, x.name, hinted, stated, x.key AS f, coalesce(own, pre, every, f.target) AS target, coalesce(lc, f.category) AS lc, coalesce(ls, f.storage) AS ls, coalesce(lq, f.confidence) AS lq, CASE WHEN own IS NOT NULL THEN 'supplier_exact' WHEN pre IS NOT NULL THEN 'supplier_prefix' WHEN every IS NOT NULL THEN 'global_exact' ELSE f.way END AS how FROM x LEFT JOIN f ON f.id = x.id),
 c0 AS (SELECT *, {sql_canonical('name')} AS n, {SKIN} AS skin FROM l), c1 AS (SELECT *, n AS c, {CUT} AS rule, {STORE} AS stored FROM c0), c2 AS (SELECT *, {STANDARD} AS std, coalesce(stated, hinted, CASE WHEN skin <> 'unknown' THEN '돼지고기' END) AS declared FROM c1),
 c3 AS (SELECT *, CASE WHEN coalesce(split_part(std, '|', 2) = declared, true) THEN std END AS s FROM c2),
 c4 AS (SELECT id, f, skin, coalesce(split_part(s, '|', 2), CASE WHEN target IS NOT NULL THEN lc END, CASE WHEN split_part(rule, '|', 1) IN ('안심', '등심', '사태', '갈비') THEN coalesce(declared, split_part(rule, '|', 2)) ELSE split_part(rule, '|', 2) END) AS category, coalesce(split_part(s, '|', 3), target, split_part(rule, '|', 1)) AS cut,
  CASE WHEN stored <> '미표기' THEN stored WHEN target IS NOT NULL AND ls <> '' THEN ls ELSE '보관미상' END AS storage, CAST(CASE WHEN s IS NOT NULL THEN 100 WHEN target IS NOT NULL THEN least(100, lq) WHEN rule IS NULL THEN 60 WHEN stored = '미표기' THEN 92 ELSE 96 END AS BIGINT) AS confidence, split_part(s, '|', 1) AS code,
  CASE WHEN s IS NOT NULL THEN 'standard' WHEN target IS NOT NULL THEN how WHEN rule IS NOT NULL THEN 'rule' ELSE 'none' END AS "by", coalesce(split_part(s, '|', 4), CASE WHEN target IS NULL THEN CASE WHEN split_part(rule, '|', 2) = '돼지고기' AND skin = 'skin_on' THEN '미박' ELSE split_part(rule, '|', 3) END END, '') AS q FROM c3),
 c5 AS (SELECT *, CASE WHEN category = '돼지고기' AND skin = 'skin_on' THEN '미박' WHEN category = '돼지고기' AND skin = 'skinless' AND cut <> '삼겹' THEN '박피' ELSE q END AS qualifier FROM c4)
 SELECT id, category, cut, qualifier, storage, confidence, code, "by", lower(coalesce(category, '미분류') || '|' || storage || '|' || coalesce(cut, f) || '|' || qualifier) AS key FROM c5""")
def er_classify_learned(spark: SparkSession, d: str) -> DataFrame:
    """Names by standard products, learned rules and the rules of cuts, in this order."""
    return R.classified_names(asked_names(spark, d), learned_rules(spark, d))


@query("SELECT id, CASE WHEN contains(name, '냉동') THEN '냉동' WHEN contains(name, '냉장') THEN '냉장' WHEN id % 7 = 0 THEN '냉동' WHEN id % 5 = 0 OR id % 3 = 0 AND size <= 30 THEN '냉장' WHEN id % 2 = 0 THEN '냉동' ELSE '보관미상' END AS storage, CASE WHEN contains(name, '냉동') OR contains(name, '냉장') THEN 'explicit_name' WHEN id % 7 = 0 THEN 'document_context' WHEN id % 5 = 0 THEN 'expiry_date' WHEN id % 3 = 0 AND size <= 30 THEN 'slaughter_age' WHEN id % 2 = 0 THEN 'learned_pattern' ELSE 'unknown' END AS source FROM goods")
def er_infer_storage(spark: SparkSession, d: str) -> DataFrame:
    return inferred(spark, d).select("id", "x.storage", "x.source")


def inferred(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("id"), F.lit("2024-03-01").cast("date")
    x = R.storage_inferred(F.col("name"), F.when(k % 7 == 0, "냉동고"), day, F.when(k % 5 == 0, F.date_add(day, 2)), F.when(k % 3 == 0, F.date_sub(day, F.col("size"))), F.lit(30), F.when(k % 2 == 0, "냉동"))
    return goods(spark, d).select("id", "size", x.alias("x"))


@query("SELECT source, count(*) AS n, count(*) FILTER (size > 40) AS suspicious FROM (SELECT size, CASE WHEN contains(name, '냉동') OR contains(name, '냉장') THEN 'explicit_name' WHEN id % 7 = 0 THEN 'document_context' WHEN id % 5 = 0 THEN 'expiry_date' WHEN id % 3 = 0 AND size <= 30 THEN 'slaughter_age' WHEN id % 2 = 0 THEN 'learned_pattern' ELSE 'unknown' END AS source FROM goods) GROUP BY 1")
def er_storage_audit(spark: SparkSession, d: str) -> DataFrame:
    """Inferences by source, and how many of them are of goods too old for it."""
    return inferred(spark, d).groupBy("x.source").agg(F.count("*").alias("n"), F.count_if(F.col("size") > 40).alias("suspicious"))


@query(f"""WITH a0 AS (SELECT {sql_print('source')} AS key, confidence, target AS product FROM learned_rules WHERE id % 3 = 1), m0 AS (SELECT {sql_print('source')} AS key, confidence AS score, target AS product FROM learned_rules WHERE id % 3 = 2),
 n AS (SELECT DISTINCT name, {sql_print('name')} AS key FROM asked_names), a AS (SELECT key, max((confidence, product)) AS a FROM a0 GROUP BY 1), m AS (SELECT key, max((score, product)) AS m FROM m0 GROUP BY 1),
 x AS (SELECT name, key, a, m FROM n LEFT JOIN a USING (key) LEFT JOIN m USING (key)), t AS (SELECT DISTINCT key, product, 100 AS most, 1 AS kind FROM a0 UNION SELECT DISTINCT key, product, score, 0 FROM m0),
 q AS (SELECT DISTINCT x.key AS k, t.key AS b, round(1 - levenshtein({ascii_of('x.key')}, {ascii_of('t.key')}) / greatest(length(x.key), length(t.key)), 9) AS s FROM x JOIN (SELECT DISTINCT key FROM t) t ON x.a IS NULL AND x.m IS NULL AND x.key <> ''),
 best AS (SELECT k, max((CAST(floor(least(CASE kind WHEN 1 THEN 100 ELSE 99 END, s * most) + 0.5) AS BIGINT), kind, product)) AS top FROM q JOIN t ON t.key = q.b WHERE s >= 0.7 GROUP BY 1)
 SELECT name, coalesce(a[2], m[2], top[3]) AS product, CAST(coalesce(a[1], CASE WHEN m IS NOT NULL THEN least(99, m[1]) END, top[1], 0) AS BIGINT) AS score, CASE WHEN a IS NOT NULL THEN CASE WHEN a[1] >= 90 THEN 'matched' ELSE 'needs_review' END WHEN m IS NOT NULL THEN 'learned_match' WHEN top[1] >= 86 THEN 'needs_review' ELSE 'new_alias_candidate' END AS status FROM x LEFT JOIN best ON best.k = x.key""")
def er_match_alias(spark: SparkSession, d: str) -> DataFrame:
    r = learned_rules(spark, d).groupBy("source", "target", (F.col("id") % 3).alias("part")).agg(F.max("confidence").alias("confidence"))  # few texts are left to be normalised
    r = r.withColumn("key", N.fingerprint(F.col("source")))
    aliases = r.where("part = 1").select("key", "confidence", F.col("target").alias("product"))
    memory = r.where("part = 2").select("key", F.col("confidence").alias("score"), F.col("target").alias("product"))
    return R.matched(asked_names(spark, d), aliases, memory)


@query("SELECT p_partkey AS id, round([1.0, 1.2][p_partkey % 2 + 1] * p_size / 50.0 * (1 + least(0.2, p_partkey % 20 * 0.02)) * CASE WHEN p_partkey % 3 = 0 THEN 1.1 ELSE 1.0 END, 6)::DOUBLE AS score FROM part")
def er_memory_score(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    x = R.memory_score(F.when(k % 2 == 0, 1.0).otherwise(1.2), F.col("p_size") / 50, k % 20, k % 3 == 0)
    return read(spark, d, "part").select(k.alias("id"), F.round(x, 6).alias("score"))


@query("SELECT p_brand AS product, arg_max(p_name, (p_size, p_name)) AS label FROM part GROUP BY 1")
def er_natural_label(spark: SparkSession, d: str) -> DataFrame:
    return R.natural_labels(read(spark, d, "part").select(F.col("p_brand").alias("product"), F.col("p_size").alias("score"), F.col("p_name").alias("label")))


#: Confirmations, and the tables that they meet, from the learned rules: staged are those of suppliers, with a number of occurrences.
SHAPES = {
    "staged": ("id % 2 = 0 AND supplier IS NOT NULL", "supplier, source, lower(replace(source, ' ', '')) AS name, target, CAST(confidence AS BIGINT) AS confidence, CAST(success % 50 + 1 AS BIGINT) AS occurrences"),
    "aliases": ("id % 5 = 0 AND supplier IS NOT NULL", "supplier, lower(replace(source, ' ', '')) AS name, source AS raw, 'OLD-' || target AS code, CAST(confidence AS BIGINT) AS confidence, CAST(id % 60 AS BIGINT) AS count"),
    "patterns": ("id % 4 = 0 AND supplier IS NOT NULL", "supplier, source, CASE WHEN id % 12 = 0 THEN category ELSE target END AS target, CAST(id % 30 AS BIGINT) AS samples, CAST(id % 30 AS BIGINT) AS successes, CAST(80 AS BIGINT) AS confidence, id % 8 = 0 AS active"),
    "history": ("id % 6 = 0 AND supplier IS NOT NULL", "supplier, source AS raw, CASE WHEN id % 12 = 0 THEN 'OLD-other' ELSE 'OLD-' || target END AS code, CAST(85 AS BIGINT) AS confidence, CAST(1 AS BIGINT) AS count, id % 18 > 0 AS active"),
}
ONE_OF = {"aliases": "supplier, name", "patterns": "supplier, source", "history": "supplier, raw"}
SYNC = ", ".join(f"{k} AS (SELECT {items}{', id' if k in ONE_OF else ''} FROM learned_rules WHERE {where}{f' QUALIFY row_number() OVER (PARTITION BY {ONE_OF[k]} ORDER BY id) = 1' if k in ONE_OF else ''})" for k, (where, items) in SHAPES.items()) + """,
 dictionary AS (SELECT DISTINCT 'OLD-' || target AS code, target AS standard, target < '목' AS approved, CAST(70 AS BIGINT) AS confidence, CAST(3 AS BIGINT) AS sources, CAST(0 AS BIGINT) AS aliases FROM learned_rules WHERE id % 3 = 0 AND target <> '목살' AND target <> '사태'),
 s0 AS (SELECT * FROM staged QUALIFY row_number() OVER (PARTITION BY supplier, name ORDER BY occurrences DESC, confidence DESC, target DESC, source DESC) = 1),
 d1 AS (SELECT * FROM dictionary UNION ALL SELECT 'LEARNED-' || upper(left(md5(target), 16)), target, true, max(confidence), CAST(sum(occurrences) AS BIGINT), 0 FROM s0 WHERE lower(target) NOT IN (SELECT lower(standard) FROM dictionary) GROUP BY target),
 s AS (SELECT s0.*, code FROM s0 JOIN (SELECT lower(standard) AS low, code FROM d1 QUALIFY row_number() OVER (PARTITION BY lower(standard) ORDER BY approved DESC, confidence DESC, code) = 1) ON low = lower(target)),
 al AS (SELECT coalesce(a.supplier, s.supplier) AS supplier, coalesce(a.name, s.name) AS name, coalesce(s.source, a.raw) AS raw, coalesce(s.code, a.code) AS code, greatest(a.confidence, s.confidence) AS confidence, greatest(a.count, s.occurrences) AS count FROM aliases a FULL JOIN s ON s.supplier = a.supplier AND s.name = a.name),
 di AS (SELECT d1.code, standard, approved OR n IS NOT NULL AS approved, greatest(d1.confidence, sure) AS confidence, greatest(sources, u) AS sources, coalesce(n, aliases) AS aliases FROM d1 LEFT JOIN (SELECT code, count(*) AS n, CAST(sum(count) AS BIGINT) AS u, max(confidence) AS sure FROM al GROUP BY 1) c ON c.code = d1.code),
 sp AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY supplier, lower(source) ORDER BY occurrences DESC, confidence DESC, target DESC, source DESC) = 1),
 pa AS (SELECT p.supplier, p.source, p.target, CASE WHEN lower(p.target) = lower(sp.target) THEN greatest(samples, occurrences) ELSE samples END AS samples, CASE WHEN lower(p.target) = lower(sp.target) THEN greatest(p.confidence, sp.confidence) ELSE p.confidence END AS confidence, coalesce(lower(p.target) = lower(sp.target), p.active) AS active FROM patterns p LEFT JOIN sp ON sp.supplier = p.supplier AND lower(sp.source) = lower(p.source)
  UNION ALL SELECT supplier, source, target, occurrences, confidence, true FROM sp WHERE NOT EXISTS (SELECT 1 FROM patterns p WHERE p.supplier = sp.supplier AND lower(p.source) = lower(sp.source) AND lower(p.target) = lower(sp.target))),
 sh AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY supplier, source ORDER BY occurrences DESC, confidence DESC, code DESC) = 1),
 hi AS (SELECT h.supplier, h.raw, h.code, h.confidence, h.count, h.active AND coalesce(sh.code = h.code, true) AS active FROM history h LEFT JOIN sh ON sh.supplier = h.supplier AND sh.source = h.raw
  UNION ALL SELECT supplier, source, code, confidence, occurrences, true FROM sh WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.active AND h.supplier = sh.supplier AND h.raw = sh.source AND h.code = sh.code))"""


def learning_tables(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    r = learned_rules(spark, d)
    of = lambda k: r.where(SHAPES[k][0]).selectExpr("id", *split_list(SHAPES[k][1]))
    first = lambda k: of(k).withColumn("k", F.row_number().over(Window.partitionBy(*ONE_OF[k].split(", ")).orderBy("id"))).where("k = 1").drop("k", "id")
    whole = r.where("id % 3 = 0 AND target <> '목살' AND target <> '사태'").selectExpr("'OLD-' || target AS code", "target AS standard", "target < '목' AS approved", "70L AS confidence", "3L AS sources", "0L AS aliases").distinct()
    return of("staged").drop("id"), {"dictionary": whole} | {k: first(k) for k in ONE_OF}


@query(f"""WITH {SYNC} SELECT 'dictionary' AS kind, code AS owner, standard AS subject, CAST(aliases AS VARCHAR) AS target, sources AS n, confidence, approved AS active FROM di UNION ALL SELECT 'aliases', supplier, name, code, count, confidence, true FROM al
 UNION ALL SELECT 'patterns', supplier, source, target, samples, confidence, active FROM pa UNION ALL SELECT 'history', supplier, raw, code, count, confidence, active FROM hi""")
def pst_learn_sync(spark: SparkSession, d: str) -> DataFrame:
    """All four tables after the sync, one below the other."""
    t = H.synced(*learning_tables(spark, d))
    col = lambda k, *names: t[k].select(F.lit(k).alias("kind"), *(F.expr(e).alias(a) for e, a in zip(names, ("owner", "subject", "target", "n", "confidence", "active"), strict=True)))
    x = col("dictionary", "code", "standard", "string(aliases)", "sources", "confidence", "approved").unionByName(col("aliases", "supplier", "name", "code", "count", "confidence", "true"))
    return x.unionByName(col("patterns", "supplier", "source", "target", "samples", "confidence", "active")).unionByName(col("history", "supplier", "raw", "code", "count", "confidence", "active"))


@query(f"""WITH {SYNC} SELECT 'dictionary' AS kind, (SELECT count(*) FROM dictionary) AS before, (SELECT count(*) FROM di) AS after UNION ALL SELECT 'aliases', (SELECT count(*) FROM aliases), (SELECT count(*) FROM al)
 UNION ALL SELECT 'patterns', (SELECT count(*) FROM patterns WHERE active), (SELECT count(*) FROM pa WHERE active) UNION ALL SELECT 'history', (SELECT count(*) FROM history WHERE active), (SELECT count(*) FROM hi WHERE active)""")
def pst_learn_dry_run(spark: SparkSession, d: str) -> DataFrame:
    return H.dry_run(*learning_tables(spark, d))


LOGGED = "e AS (SELECT supplier, target AS name, category AS product, confidence, success AS count, CASE WHEN id % 4 < 2 THEN id % 4 = 0 END AS auto, id AS used, id % 3 = 1 AS logged FROM learned_rules WHERE supplier IS NOT NULL)"


@query(f"""WITH {LOGGED}, b AS (SELECT supplier, name, product, max(confidence) AS confidence, sum(count) AS count, coalesce(arg_max(auto, used) FILTER (auto IS NOT NULL), false) AS auto, max(used) AS used FROM e WHERE NOT logged GROUP BY 1, 2, 3),
 a AS (SELECT *, 0 AS given FROM b UNION ALL SELECT supplier, name, product, CASE WHEN used % 5 > 0 THEN confidence END, CASE WHEN used % 2 = 0 THEN count ELSE 1 END, auto, used, 1 FROM e WHERE logged)
 SELECT supplier, name, product, CAST(coalesce(max(confidence), 0) AS BIGINT) AS confidence, CAST(sum(count) AS BIGINT) AS count, coalesce(arg_max(auto, (given, used)) FILTER (auto IS NOT NULL), false) AS auto, max(used) AS used FROM a GROUP BY 1, 2, 3""")
def er_learning_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Confirmations over the entries that there are; some say nothing of confidence, count or automatic use."""
    k = F.col("id")
    e = learned_rules(spark, d).where("supplier IS NOT NULL").select("supplier", F.col("target").alias("name"), F.col("category").alias("product"), F.col("confidence").cast("long").alias("confidence"), F.col("success").cast("long").alias("count"), F.when(k % 4 < 2, k % 4 == 0).alias("auto"), k.alias("used"), (k % 3 == 1).alias("logged"))
    keys = ["supplier", "name", "product"]
    last = F.max_by("auto", F.when(F.col("auto").isNotNull(), F.col("used")))
    entries = e.where("NOT logged").groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.sum("count").alias("count"), F.coalesce(last, F.lit(False)).alias("auto"), F.max("used").alias("used"))
    log = e.where("logged").select(*keys, F.when(F.col("used") % 5 > 0, F.col("confidence")).alias("confidence"), F.when(F.col("used") % 2 == 0, F.col("count")).alias("count"), "auto", "used")
    return H.confirmed(entries, log)


@query("""WITH RECURSIVE e AS (SELECT p_brand AS pattern, p_partkey AS at, p_size AS c, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part), r AS (SELECT pattern, k, CAST(c AS BIGINT) AS confidence FROM e WHERE k = 1 UNION ALL SELECT e.pattern, e.k, CAST(least(100, floor((r.confidence + e.c) / 2 + 0.5)) AS BIGINT) FROM r JOIN e ON e.pattern = r.pattern AND e.k = r.k + 1)
 SELECT pattern, count(*) AS samples, sum(s) AS successes, max(f) AS confidence FROM (SELECT p_brand AS pattern, p_partkey % 2 AS s FROM part) JOIN (SELECT pattern, arg_max(confidence, k) AS f FROM r GROUP BY 1) USING (pattern) GROUP BY 1""")
def er_pattern_upsert(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_brand").alias("pattern"), F.col("p_partkey").alias("at"), F.lit(1).alias("samples"), (F.col("p_partkey") % 2).alias("successes"), F.col("p_size").alias("confidence"))
    return R.halving_confidence(p, ["pattern"], ["at"])


@query("SELECT id, c AS confidence, CASE WHEN c >= 95 THEN 'AUTO_APPROVED' WHEN c >= 80 THEN 'REVIEW_REQUIRED' WHEN c >= 60 THEN 'USER_SELECT' ELSE 'UNKNOWN' END AS route FROM (SELECT p_partkey AS id, CAST(greatest(0, least(100, floor(p_size * 2 * 0.38::DOUBLE + least(20, p_partkey % 100 * 0.2::DOUBLE) + least(15, p_partkey % 90 * 0.15::DOUBLE) + least(15, p_size / 10 + log2(p_partkey % 7 + 1) * 2) + least(20, p_partkey % 6 * 4) + least(12, p_partkey % 5 * 3) + 0.5))) AS BIGINT) AS c FROM part)")
def er_dictionary_candidates(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    x = R.dictionary_score(size * 2, k % 100, k % 90, size, k % 7, k % 6, k % 5)
    return read(spark, d, "part").select(k.alias("id"), x.alias("x")).select("id", "x.*")


@query("SELECT id, CASE WHEN contains(name, '오겹살') THEN '오겹살 냉장' WHEN contains(name, '가브릿살') THEN '가브리살' WHEN contains(name, '돼지갈비') THEN '돼지 갈비 냉동' WHEN contains(name, '미박 삼겹살') THEN '오겹살(국내)' ELSE name END AS name FROM goods")
def er_alias_patterns(spark: SparkSession, d: str) -> DataFrame:
    return goods(spark, d).select("id", N.standard_aliases(F.col("name")).alias("name"))


#: Typing errors, and what they mean: whole names, qualifiers and bellies one edit off, and what must stay.
TYPED = (
    ("미박 삼겹살(국내)", "오겹살"), ("미빅 앞다리살", "미박 앞다리살"), ("냉동 미후지", "냉동 미박 뒷다리살"), ("냉장박피삼겹살", "냉장 삼겹살"), ("미박파 삼겹살 구이", "오겹살 구이"), ("한돈 미발박 삼겸살", "한돈 오겹살"), ("미빅피 삽결살 1kg", "미빅피 삽결살 1kg"),
    ("미박 삼결살 1kg", "오겹살 1kg"), ("냉동 미밖 삼겹실 특", "냉동 오겹살 특"), ("수제 미배삼박 삼겹 (진공)", "수제 미배삼박 삼겹 (진공)"), ("특선 미돈박 삼겹살", "특선 오겹살"), ("(미박비 삼겹)", "(오겹살)"), ("미국 삼겹살", "미국 삼겹살"), ("박피 목살", "박피 목살"),
    ("미 삼겹 구이", "오겹살 구이"),
)


@query(f"SELECT p_partkey AS id, {picked(tuple(b for _, b in TYPED), f'p_partkey % {len(TYPED)}', True)} || CASE WHEN p_partkey % {len(TYPED)} IN (0, 3) THEN '' ELSE ' ' || CAST(p_size AS VARCHAR) END AS name FROM part")
def er_contextual_typos(spark: SparkSession, d: str) -> DataFrame:
    """Names with errors of their own, most with a number behind them."""
    place = (F.col("p_partkey") % len(TYPED)).cast("int")
    name = F.concat(F.get(F.array(*(F.lit(a) for a, _ in TYPED)), place), F.when(place.isin(0, 3), "").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"))))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), N.contextual_typos(name).alias("name"))


HEADS = "h AS (SELECT p_brand AS doc, CAST(p_partkey % 5 AS VARCHAR) AS name, min(p_partkey % 1000) AS x FROM part GROUP BY 1, 2)"


def headers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").groupBy(F.col("p_brand").alias("doc"), (F.col("p_partkey") % 5).cast("string").alias("name")).agg(F.min(F.col("p_partkey") % 1000).alias("x"))


#: Header texts that a column's token may have, in order.
LABELLED = ", ".join(f"({i}, {j}, '{name}', '{label}')" for i, (name, texts) in enumerate(Y.HEADERS) for j, label in enumerate(texts))


@query(f"""WITH v(place, nth, name, label) AS (VALUES {LABELLED}), t AS (SELECT *, lower(regexp_replace(text, '[\\s·ㆍ:：()\\[\\]{{{{}}}}]', '', 'g')) AS bare FROM page_tokens),
 c AS (SELECT doc, id, x, w, h, x + w / 2 AS centre, t.y + h / 2 AS y, CAST(floor(least(100, confidence + CASE WHEN bare = label THEN 8 ELSE 0 END) + 0.5) AS BIGINT) AS confidence, name, place, nth FROM t JOIN v ON bare = label OR (contains(bare, label) OR contains(label, bare)) AND least(length(bare), length(label)) >= 2),
 m AS (SELECT *, greatest(18, median(h) OVER (PARTITION BY doc) * 1.25) AS reach, row_number() OVER (PARTITION BY doc ORDER BY place) AS k FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc, name ORDER BY confidence DESC, id, nth) = 1)),
 r AS (SELECT doc, k, place, CAST(1 AS BIGINT) AS band, [CAST(y AS DOUBLE)] AS s, [1] AS n FROM m WHERE k = 1 UNION ALL SELECT doc, k, place, coalesce(hit, len(s) + 1), CASE WHEN hit IS NULL THEN s || [CAST(y AS DOUBLE)] ELSE list_transform(range(1, len(s) + 1), lambda i: s[i] + CASE WHEN i = hit THEN y ELSE 0 END) END, CASE WHEN hit IS NULL THEN n || [1] ELSE list_transform(range(1, len(n) + 1), lambda i: n[i] + CASE WHEN i = hit THEN 1 ELSE 0 END) END
  FROM (SELECT m.*, s, n, list_filter(range(1, len(s) + 1), lambda i: abs(s[i] / n[i] - m.y) <= reach)[1] AS hit FROM r JOIN m ON m.doc = r.doc AND m.k = r.k + 1)),
 g AS (SELECT m.*, band, count(*) OVER b AS items, sum(y) OVER b / count(*) OVER b AS height FROM m JOIN r ON r.doc = m.doc AND r.k = m.k WINDOW b AS (PARTITION BY m.doc, band)),
 o AS (SELECT *, lag(centre) OVER (PARTITION BY doc ORDER BY centre, place) AS before FROM (SELECT * FROM g QUALIFY rank() OVER (PARTITION BY doc ORDER BY items DESC, height, band) = 1)),
 z AS (SELECT * FROM o JOIN (SELECT doc, max(x + w) AS width FROM page_tokens GROUP BY 1) USING (doc) WHERE before IS NULL OR centre - before > greatest(8, width * 0.008)),
 e AS (SELECT *, count(*) OVER (PARTITION BY doc) AS cols, lag(centre) OVER a AS p, lead(centre) OVER a AS f FROM z WINDOW a AS (PARTITION BY doc ORDER BY centre, place))
 SELECT doc, name, CAST(centre AS DOUBLE) AS centre, CAST(CASE WHEN p IS NULL THEN greatest(0, x - greatest(12, w * 0.45)) ELSE (p + centre) / 2 END AS DOUBLE) AS "left", CAST(CASE WHEN f IS NULL THEN least(width, x + w + greatest(12, w * 0.45)) ELSE (f + centre) / 2 END AS DOUBLE) AS "right", confidence FROM e WHERE cols >= 3""")
def doc_table_columns(spark: SparkSession, d: str) -> DataFrame:
    return Y.table_columns(page_tokens(spark, d))


@query(f"WITH {HEADS}, c AS (SELECT doc, name, CASE WHEN p IS NULL THEN 0 ELSE (p + x) / 2 END AS l, CASE WHEN n IS NULL THEN 1000 ELSE (x + n) / 2 END AS r FROM (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS n FROM h WINDOW w AS (PARTITION BY doc ORDER BY x, name))), t AS (SELECT DISTINCT p_brand AS doc, p_size AS row FROM part) SELECT doc, row, name, l AS x, row * 20 AS y, r - l AS w, 20 AS h FROM c JOIN t USING (doc)")
def doc_cell_regions(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select(F.col("p_brand").alias("doc"), F.col("p_size").alias("row")).distinct()
    return Y.cell_boxes(Y.column_bounds(headers(spark, d), 1000.0), rows.select("doc", "row", (F.col("row") * 20).alias("y"), F.lit(20).alias("h")))


@query("SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN b.x WHEN b.name IS NULL THEN a.x ELSE round((a.x * 3 + b.x) / 4, 6) END AS x, coalesce(a.n, 0) + coalesce(b.n, 0) AS samples FROM (SELECT p_brand AS name, avg(p_size) AS x, 3 AS n FROM part WHERE p_partkey % 25 > 2 GROUP BY 1) a FULL JOIN (SELECT p_brand AS name, avg(p_size) AS x, 1 AS n FROM part WHERE p_size > 20 GROUP BY 1) b ON a.name = b.name")
def doc_template_merge(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    of = lambda w, n: p.where(w).groupBy(F.col("p_brand").alias("name")).agg(F.avg("p_size").alias("x")).withColumn("samples", F.lit(n))
    return Y.merged_templates(of("p_partkey % 25 > 2", 3), of("p_size > 20", 1))


@query("SELECT l.doc, l.row, list_sort(list(t.trace) FILTER (t.trace <> '')) AS traces FROM (SELECT doc, row, lead(row, 1, 1000000) OVER (PARTITION BY doc ORDER BY row) AS nx FROM invoice_lines WHERE row % 2 = 1) l LEFT JOIN invoice_lines t ON t.doc = l.doc AND t.row >= l.row AND t.row < l.nx GROUP BY 1, 2 HAVING count(*) FILTER (t.trace <> '') > 0")
def doc_trace_attach(spark: SparkSession, d: str) -> DataFrame:
    """Every second row is a product's line; trace numbers on it and up to the next one are its own."""
    l = invoice_lines(spark, d)
    return Y.traces_of_lines(l.where("row % 2 = 1").select("doc", "row"), l.where("trace <> ''").select("doc", "row", "trace")).where(F.size("traces") > 0)


@query("""WITH t AS (SELECT *, greatest(12, h * CAST(0.7 AS DOUBLE)) AS reach, row_number() OVER (PARTITION BY doc ORDER BY y, x, id, text, w, h, confidence) AS k FROM page_tokens),
 r AS (SELECT doc, k, CAST(1 AS BIGINT) AS band, [CAST(y AS DOUBLE)] AS s, [1] AS n FROM t WHERE k = 1 UNION ALL SELECT doc, k, coalesce(hit, len(s) + 1), CASE WHEN hit IS NULL THEN s || [CAST(y AS DOUBLE)] ELSE list_transform(range(1, len(s) + 1), lambda i: s[i] + CASE WHEN i = hit THEN y ELSE 0 END) END, CASE WHEN hit IS NULL THEN n || [1] ELSE list_transform(range(1, len(n) + 1), lambda i: n[i] + CASE WHEN i = hit THEN 1 ELSE 0 END) END
  FROM (SELECT t.doc, t.k, t.y, s, n, list_filter(range(1, len(s) + 1), lambda i: abs(s[i] / n[i] - t.y) <= reach)[1] AS hit FROM r JOIN t ON t.doc = r.doc AND t.k = r.k + 1)),
 g AS (SELECT t.doc, band, avg(t.y) AS y, string_agg(text, ' ' ORDER BY x, id, text) AS text, round(avg(confidence), 2) AS confidence FROM t JOIN r ON r.doc = t.doc AND r.k = t.k GROUP BY 1, 2)
 SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY y, band) AS line, text, confidence FROM g""")
def doc_line_grouping(spark: SparkSession, d: str) -> DataFrame:
    return Y.grouped_lines(page_tokens(spark, d))


@query("SELECT p_brand AS doc, CASE WHEN y < 300 THEN 'head' WHEN y < 800 THEN 'body' ELSE 'foot' END AS region, string_agg(id, ' ' ORDER BY y, id) AS text FROM (SELECT p_brand, p_partkey AS id, p_partkey * 7919 % 1000 AS y FROM part) GROUP BY 1, 2")
def doc_region_map(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    t = read(spark, d, "part").select(F.col("p_brand").alias("doc"), k.alias("id"), (k * 7919 % 1000).alias("y"), k.cast("string").alias("text"))
    return Y.regions(t, (("head", 0, 300), ("body", 300, 800), ("foot", 800, 1000)))


@query("SELECT doc, row, list_filter([CASE WHEN quantity * 3000 > 100000 OR price * 200 > 1000000 THEN 'OUT_OF_RANGE' END, CASE WHEN quantity IS NULL THEN 'NUMBER_MISSING' WHEN abs(quantity * price - amount) > 1 THEN 'ARITHMETIC' END, CASE WHEN trace = '' THEN 'TRACE_MISSING' END], lambda x: x IS NOT NULL) AS messages FROM (SELECT * FROM invoice_lines)")
def doc_mobile_limits(spark: SparkSession, d: str) -> DataFrame:
    l = invoice_lines(spark, d)
    return l.select("doc", "row", Y.line_messages(F.col("quantity"), F.col("price"), F.col("amount"), F.col("trace"), F.col("quantity") * 3000, F.col("price") * 200).alias("messages"))


def printed(x: str, places: int) -> str:
    """SQL that rounds a double as it is printed, half away from zero; DuckDB's own round multiplies first, which can cross a half."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18)), {places}) AS DOUBLE)"


FRESH = f"""m AS (SELECT product, CAST(sum(CASE WHEN kind = 'OUT' THEN -qty ELSE qty END) AS DOUBLE) AS on_hand, CAST(coalesce(sum(qty) FILTER (kind = 'IN' AND expiry <= DATE '1998-09-05'), 0) AS DOUBLE) AS waste FROM movements WHERE is_active GROUP BY 1),
 dd AS (SELECT CAST(unnest(range(DATE '1998-09-02' - 55, DATE '1998-09-02' + 1, INTERVAL 1 DAY)) AS DATE) AS day), so AS (SELECT product, day, CAST(sum(qty) AS DOUBLE) AS s FROM movements WHERE is_active AND kind = 'OUT' AND day BETWEEN DATE '1998-09-02' - 55 AND DATE '1998-09-02' GROUP BY 1, 2),
 st AS (SELECT product, round(avg(sold) FILTER (day > DATE '1998-09-02' - 7) * 0.65 + avg(sold) * 0.35, 3) AS demand, round(stddev_samp(sold), 3) AS deviation, count(*) AS days, round(least(0.95, 0.25 + count(*) / 56), 2)::DOUBLE AS confidence FROM (SELECT c.product, dd.day, coalesce(s, 0) AS sold FROM (SELECT DISTINCT product FROM so) c CROSS JOIN dd LEFT JOIN so ON so.product = c.product AND so.day = dd.day) GROUP BY 1),
 yp AS (SELECT p_name AS product, greatest(0.78, least(0.96, (0.88 * 50 + sum(o) FILTER (ok)) / (50 + sum(i) FILTER (ok)))) AS r, count(*) FILTER (ok) AS n, sum(i) FILTER (ok) AS i FROM (SELECT p_name, p_size::DOUBLE AS i, p_size * 0.9::DOUBLE AS o, abs(p_size::DOUBLE - p_size * 0.9::DOUBLE - 0.5::DOUBLE) / p_size <= 0.1 AS ok FROM part WHERE p_size > 25) GROUP BY 1),
 x AS (SELECT coalesce(m.product, st.product) AS product, coalesce(on_hand, 0) AS on_hand, coalesce(waste, 0) AS waste, coalesce(demand, 0) AS demand, coalesce(deviation, 0) AS deviation, coalesce(days, 0) AS days, coalesce(confidence, 0.25) AS confidence, CASE WHEN n IS NULL THEN 1 ELSE round(r, 4)::DOUBLE END AS rate, CASE WHEN n IS NULL THEN 0.4 ELSE round(greatest(0.25, least(0.98, 0.25 + n / 40 + i / 500)), 2)::DOUBLE END AS known
  FROM m FULL JOIN st ON st.product = m.product LEFT JOIN yp ON yp.product = coalesce(m.product, st.product) WHERE on_hand > 0 OR days IS NOT NULL),
 c AS (SELECT *, 1.28 * deviation AS safety, CASE WHEN demand > 0 THEN demand * 5 * 0.9 ELSE 'inf'::DOUBLE END AS cap, greatest(0, on_hand - waste) AS available FROM x), t AS (SELECT *, greatest(0, least(demand * 2 + safety, cap)) AS target FROM c),
 o AS (SELECT *, CASE WHEN target - available <= 0 THEN 0 ELSE ceil((target - available) / rate) END AS order_, least(0.98, confidence * 0.35 + 0.7 * 0.30 + known * 0.15) AS sure FROM t),
 f AS (SELECT product, on_hand, waste, available, {printed("safety + demand", 3)} AS reorder_point, {printed("target", 3)} AS target, {printed("order_", 3)} AS recommended, {printed("sure", 2)} AS sure, CASE WHEN sure < 0.55 OR days < 7 THEN 'REVIEW' WHEN waste > 0 OR available >= cap THEN 'REDUCE' WHEN order_ > 0 THEN 'ORDER' ELSE 'HOLD' END AS action,
  concat_ws(',', CASE WHEN days < 56 THEN 'DEMAND_HISTORY_SHORT' ELSE 'DEMAND_HISTORY_OK' END, 'INVENTORY_CHECK_REQUIRED', CASE WHEN waste > 0 THEN 'EXPIRY_RISK' ELSE 'EXPIRY_CLEAR' END, CASE WHEN rate < 1 AND known < 0.75 THEN 'YIELD_LEARNING' ELSE 'YIELD_READY' END) AS reasons FROM o)"""


def fresh(spark: SparkSession, d: str) -> DataFrame:
    """Products with stock, what of it expires, 56 days of demand and learned yields, as replenishment proposals. Stock: the movements', demand: their active issues; yields: of parts, the larger ones observed."""
    m = movements(spark, d).where("is_active")
    on_hand = m.groupBy("product").agg(F.sum(F.when(F.col("kind") == "OUT", -F.col("qty")).otherwise(F.col("qty"))).cast("double").alias("on_hand"), F.coalesce(F.sum(F.when((F.col("kind") == "IN") & (F.col("expiry") <= F.lit("1998-09-05").cast("date")), F.col("qty"))), F.lit(0)).cast("double").alias("waste"))
    sold = m.where("kind = 'OUT'").select("product", F.col("day").alias("sale_date"), F.col("qty").alias("amount"))
    seen = read(spark, d, "part").where("p_size > 25").select(F.col("p_name").alias("product"), F.col("p_size").cast("double").alias("input"), (F.col("p_size") * 0.9).alias("output"), F.lit(0.0).alias("byproduct"), F.lit(0.5).alias("loss"))
    return S.fresh_proposals(on_hand, sold, S.yield_profile(seen, ["product"], "TRIM_STANDARD"), "1998-09-02", "F1_CORE_FRESH")


@query(f"WITH {FRESH} SELECT *, CASE action WHEN 'ORDER' THEN 0 WHEN 'REDUCE' THEN 1 WHEN 'REVIEW' THEN 2 ELSE 3 END AS place FROM f")
def an_fresh_stock(spark: SparkSession, d: str) -> DataFrame:
    return fresh(spark, d).select("product", "on_hand", "waste", "available", "reorder_point", "target", "recommended", "sure", "action", "reasons", "place")


@query(f"WITH {FRESH} SELECT action, count(*) AS n, round(sum(recommended), 3)::DOUBLE AS kilograms, count(*) FILTER (waste > 0) AS expiring FROM f GROUP BY 1")
def an_fresh_kpi(spark: SparkSession, d: str) -> DataFrame:
    return Y.action_counts(fresh(spark, d))

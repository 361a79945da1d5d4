"""Query understanding queries N01-N10 on questions phrased from the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import understanding as ud
from tessella.plans import derived as dv
from tessella.plans.q_retrieval import STOP_SQL, nation_names
from tessella.plans.registry import fragment, query

# Each event asks a question; its type sets the wording.
fragment("asks", """
  SELECT event_id AS query_id, k, CASE event_type
    WHEN 'error' THEN 'UPF 告警怎么排查 E' || k WHEN 'click' THEN CASE WHEN k < 50 THEN 'add User_' || user_id || ' 命令 参数' ELSE '如何查询 session' || k END
    WHEN 'view' THEN '什么是 smf 会话 ' || k WHEN 'purchase' THEN 'AMF 与 XSMF 的区别 CloudCore ' || k
    ELSE CASE WHEN k < 30 THEN 'where is the UDG 路径' WHEN k < 60 THEN '配置' ELSE 'alarm list of UNC' END END AS query
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
""")


def asks(spark, d):
    e = dv.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    t, k = F.col("event_type"), F.col("k")
    text = (
        F.when(t == "error", F.concat(F.lit("UPF 告警怎么排查 E"), k))
        .when(t == "click", F.when(k < 50, F.concat(F.lit("add User_"), "user_id", F.lit(" 命令 参数"))).otherwise(F.concat(F.lit("如何查询 session"), k)))
        .when(t == "view", F.concat(F.lit("什么是 smf 会话 "), k)).when(t == "purchase", F.concat(F.lit("AMF 与 XSMF 的区别 CloudCore "), k))
        .otherwise(F.when(k < 30, "where is the UDG 路径").when(k < 60, "配置").otherwise("alarm list of UNC")))
    return e.select(F.col("event_id").alias("query_id"), "k", text.alias("query"))


VERBS = "|".join(ud.COMMAND_VERBS)
_VERB_CASE = " ".join(
    f"WHEN contains(query, '{w}') THEN '{v}' || CASE WHEN regexp_matches(query, '{w}.*?[A-Za-z]') THEN ' ' || upper(regexp_extract(query, '{w}.*?([A-Za-z][A-Za-z0-9_]*)', 1)) ELSE '' END"
    for w, v in ud.COMMAND_VERBS.items())
fragment("commands", rf"""
  SELECT *, CASE WHEN regexp_matches(query, '(?i)(ADD|MOD|DEL|SET|SHOW|LST|DSP|REG|DEREG)\s+([A-Z][A-Z0-9_]*)')
    THEN upper(regexp_extract(query, '(?i)(ADD|MOD|DEL|SET|SHOW|LST|DSP|REG|DEREG)\s+([A-Z][A-Z0-9_]*)', 1) || ' ' || regexp_extract(query, '(?i)(ADD|MOD|DEL|SET|SHOW|LST|DSP|REG|DEREG)\s+([A-Z][A-Z0-9_]*)', 2))
    {_VERB_CASE} END AS command
  FROM asks
""", ("asks",))
_INTENT = " ".join(f"WHEN regexp_matches(query, '{'|'.join(w)}') THEN '{n}'" for n, w in ud.INTENT_KEYWORDS.items())
fragment("understood", f"""
  SELECT *, CASE WHEN command IS NOT NULL THEN 'command_usage' {_INTENT} ELSE 'general' END AS intent FROM commands
""", ("commands",))


def understood(spark, d):
    a = asks(spark, d).withColumn("command", ud.command(F.col("query")))
    return a.withColumn("intent", ud.intent(F.col("query"), F.col("command").isNotNull()))


@query("n01_intent", "SELECT query_id, intent FROM understood", ("understood",))
def n01(spark, d):
    return understood(spark, d).select("query_id", "intent")


@query("n02_command", "SELECT query_id, coalesce(command, '') AS command FROM commands", ("commands",))
def n02(spark, d):
    return understood(spark, d).select("query_id", F.coalesce("command", F.lit("")).alias("command"))


def _scope_sql(terms: list[str]) -> str:
    parts = ", ".join(f"CASE WHEN regexp_matches(query, '(?i)(^|[^A-Za-z0-9_]){t}([^A-Za-z0-9_]|$)') THEN '{t.upper()}' END" for t in terms)
    return f"array_to_string(list_sort(list_filter([{parts}], lambda x: x IS NOT NULL)), ',')"


@query("n03_scope_terms", f"SELECT query_id, {_scope_sql(ud.NETWORK_ELEMENTS)} AS network_elements, {_scope_sql(ud.PRODUCTS)} AS products FROM asks", ("asks",))
def n03(spark, d):
    q = F.col("query")
    return asks(spark, d).select("query_id", F.array_join(ud.scope_terms(q, ud.NETWORK_ELEMENTS), ",").alias("network_elements"),
                                 F.array_join(ud.scope_terms(q, ud.PRODUCTS), ",").alias("products"))


@query("n04_keywords", rf"""
  SELECT query_id, array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(regexp_replace(query, '(?i)(ADD|MOD|DEL|SET|SHOW|LST|DSP|REG|DEREG)\s+([A-Z][A-Z0-9_]*)', '', 'g')), '([\x{{4e00}}-\x{{9fff}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+'),
    lambda x: (length(x) >= 2 OR regexp_matches(x, '[\x{{4e00}}-\x{{9fff}}]')) AND x NOT IN ({STOP_SQL})), ' ') AS keywords FROM asks
""", ("asks",))
def n04(spark, d):
    return asks(spark, d).select("query_id", F.array_join(ud.keywords(F.col("query")), " ").alias("keywords"))


COMPLEXITY_SQL = """CASE WHEN intent IN ('comparison', 'troubleshooting') OR k >= 95 OR k = 7 THEN 'complex' WHEN intent IN ('command_usage', 'navigational') THEN 'simple' ELSE 'medium' END"""


def with_complexity(spark, d):
    u = understood(spark, d)
    return u.withColumn("needs_comparison", F.col("k") == 7).withColumn("complexity", ud.complexity(
        F.col("intent"), F.col("command").isNotNull(), F.when(F.col("k") >= 95, 2).otherwise(0), F.col("k") == 7))


@query("n05_complexity", f"SELECT query_id, {COMPLEXITY_SQL} AS complexity FROM understood", ("understood",))
def n05(spark, d):
    return with_complexity(spark, d).select("query_id", "complexity")


# Model labels: the event types renamed to the labels a model would give.
fragment("labels_given", """
  SELECT event_id, CASE event_type WHEN 'error' THEN 'troubleshooting' WHEN 'click' THEN 'procedural' WHEN 'view' THEN 'conceptual' WHEN 'purchase' THEN 'comparative' ELSE 'unknown' END AS label FROM events
""")


@query("n06_normalize_intent", """
  SELECT event_id, CASE label WHEN 'troubleshooting' THEN 'troubleshooting' WHEN 'procedural' THEN 'procedure' WHEN 'conceptual' THEN 'concept_lookup' WHEN 'comparative' THEN 'comparison' ELSE 'general' END AS intent FROM labels_given
""", ("labels_given",))
def n06(spark, d):
    t = F.col("event_type")
    label = F.when(t == "error", "troubleshooting").when(t == "click", "procedural").when(t == "view", "conceptual").when(t == "purchase", "comparative").otherwise("unknown")
    return dv.table(spark, d, "events").select("event_id", ud.normalize_intent(label).alias("intent"))


def _policy_rows(policy: dict, key: str) -> str:
    rows = [(k, r, float(w), n) for k, routes in policy.items() for r, (w, n) in routes.items()]
    return dv.values_sql(rows, f"{key}, route, weight, top_k")


@query("n07_route_plan", f"""
  WITH u AS (SELECT *, {COMPLEXITY_SQL} AS complexity FROM understood), c AS ({_policy_rows(ud.COMPLEXITY_ROUTES, 'complexity')}), p AS ({_policy_rows(ud.INTENT_POLICY, 'intent')}),
  r AS (SELECT query_id, intent, complexity, k, 'none' AS profile, route, weight, top_k FROM u JOIN c USING (complexity)
        UNION ALL SELECT query_id, intent, complexity, k, 'core', route, weight, top_k FROM u JOIN p USING (intent))
  SELECT query_id, intent, profile, route, weight::DOUBLE AS weight, top_k, 'weighted_rrf' AS fusion,
    CASE WHEN intent IN ('troubleshooting', 'comparison', 'procedure') OR complexity = 'complex' THEN 'cascade' ELSE 'score' END AS rerank FROM r
""", ("understood",))
def n07(spark, d):
    u = with_complexity(spark, d)
    return ud.route_plan(u).withColumn("profile", F.lit("none")).unionByName(ud.route_plan(u, ud.INTENT_POLICY).withColumn("profile", F.lit("core")))


@query("n07_expansion_config", """
  SELECT query_id, CASE intent WHEN 'troubleshooting' THEN 'causes,results_in,enables,conditions,elaborates,backgrounds' WHEN 'comparison' THEN 'contrasts_with,parallels,elaborates'
    WHEN 'procedure' THEN 'purposes,enables,sequences,conditions,elaborates' ELSE '' END AS relation_types, CASE WHEN intent IN ('troubleshooting', 'comparison', 'procedure') THEN 2 ELSE 1 END AS max_depth FROM understood
""", ("understood",))
def n07b(spark, d):
    return understood(spark, d).select("query_id", ud.expansion_config(F.col("intent")).alias("e")).select(
        "query_id", F.array_join("e.relation_types", ",").alias("relation_types"), "e.max_depth")


@query("n08_section_navigation", """
  WITH h AS (SELECT DISTINCT query_id, segment_id FROM mentions JOIN nation_names ON mention_text = name),
  n AS (SELECT query_id, lower(o_orderpriority) AS section, count(*) AS hits FROM h JOIN orders ON segment_id = o_orderkey GROUP BY 1, 2),
  t AS (SELECT *, sum(hits) OVER (PARTITION BY query_id) AS total FROM n)
  SELECT query_id, section, hits, total::BIGINT AS total, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, section) AS rank, hits / total >= 0.6 AND total >= 5 AS hard
  FROM t WHERE hits / total >= 0.15 QUALIFY rank <= 3
""", ("mentions", "nation_names"))
def n08(spark, d):
    sec = dv.table(spark, d, "orders").select(F.col("o_orderkey").alias("segment_id"), F.col("o_orderpriority").alias("section"))
    refs = dv.mentions(spark, d).select("segment_id", F.col("mention_text").alias("name")).join(sec, "segment_id")
    return ud.navigate_sections(nation_names(spark, d), refs).select("query_id", "section", "hits", "total", "rank", "hard")


# Conversations: the first user turn is the question, the next user turns its variants, the answers its sub-queries.
@query("n09_query_fan_out", r"""
  WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user'),
  q AS (SELECT conv_id, text FROM u WHERE n = 1),
  v AS (SELECT u.conv_id, u.text, row_number() OVER (PARTITION BY u.conv_id ORDER BY n) AS i FROM u JOIN q USING (conv_id) WHERE n > 1 AND u.text <> q.text AND regexp_matches(u.text, '\S')),
  s AS (SELECT conv_id, text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'assistant' AND conv_id IN (SELECT conv_id FROM q)),
  a AS (SELECT conv_id, 'original' AS kind, 0 AS g, 0 AS i, text, 'procedure' AS intent, 'conv' || conv_id AS entities FROM q
    UNION ALL SELECT conv_id, 'variant', 1, i, text, 'procedure', 'conv' || conv_id FROM v WHERE i <= 2
    UNION ALL SELECT conv_id, 'sub_query', 2, i, text, CASE WHEN turn > 2 THEN 'comparison' ELSE 'procedure' END, CASE WHEN turn > 4 THEN 'turn' || turn ELSE 'conv' || conv_id END FROM s WHERE i <= 4)
  SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY g, i) - 1 AS variant_no, kind, text, intent, entities FROM a
""")
def n09(spark, d):
    c = dv.table(spark, d, "conversations")
    turns = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text"))))
    g = c.groupBy("conv_id").agg(turns("user").alias("u"), turns("assistant").alias("a")).filter(F.size("u") > 0)
    none = F.array().cast("array<string>")
    subs = F.transform("a", lambda t: F.struct(
        t["text"].alias("text"), F.when(t["turn"] > 2, "comparison").otherwise("general").alias("intent"),
        F.when(t["turn"] > 4, F.array(F.concat(F.lit("turn"), t["turn"]))).otherwise(none).alias("entities")))
    q = g.select(F.col("conv_id").alias("query_id"), F.col("u")[0]["text"].alias("query"), F.lit("procedure").alias("intent"),
                 F.array(F.concat(F.lit("conv"), "conv_id")).alias("entities"),
                 F.transform(F.slice("u", F.lit(2), F.size("u")), lambda t: t["text"]).alias("variants"), subs.alias("sub_queries"))
    return ud.fan_out(q).withColumn("entities", F.array_join("entities", ","))


@query("n10_evidence_roles", """
  SELECT query_id, CASE intent WHEN 'command_usage' THEN 'parameter,example,procedure_step' WHEN 'troubleshooting' THEN 'troubleshooting_step,alarm,constraint' WHEN 'concept_lookup' THEN 'concept,note'
    WHEN 'procedure' THEN 'procedure_step,parameter,example' WHEN 'comparison' THEN 'concept,parameter' ELSE '' END AS roles FROM understood
""", ("understood",))
def n10(spark, d):
    return understood(spark, d).select("query_id", F.array_join(ud.evidence_roles(F.col("intent")), ",").alias("roles"))

"""Query understanding and routing over a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators.enrich import lookup
from tessella.operators.retrieval import STOPWORDS_EN, STOPWORDS_ZH

# Intent keywords, in the order the classes are tried.
INTENT_KEYWORDS = {
    "comparison": "区别 差异 对比 比较 不同".split(),
    "troubleshooting": "故障 排查 告警 错误 异常 处理".split(),
    "procedure": "步骤 流程 操作 怎么做 如何操作".split(),
    "concept_lookup": "是什么 什么是 概念 介绍 概述 原理".split(),
    "navigational": "在哪里 如何找到 路径".split(),
}
# The command pattern and the verbs that stand for a command, first hit in this order.
COMMAND = r"(?i)(ADD|MOD|DEL|SET|SHOW|LST|DSP|REG|DEREG)\s+([A-Z][A-Z0-9_]*)"
COMMAND_VERBS = {
    "新增": "ADD", "添加": "ADD", "创建": "ADD", "修改": "MOD", "更改": "MOD", "编辑": "MOD", "删除": "DEL", "移除": "DEL",
    "查询": "SHOW", "查看": "DSP", "显示": "LST", "设置": "SET", "配置": "SET",
}
# Default scope terms.
NETWORK_ELEMENTS = "AMF SMF UPF UDM PCF NRF AUSF BSF NSSF SCP UDSF UDR".split()
PRODUCTS = "UDG UNC CloudCore".split()
# Labels a model may give, and the roles of evidence an intent prefers.
INTENT_LABELS = {
    "conceptual": "concept_lookup", "factoid": "general", "procedural": "procedure", "comparative": "comparison",
    "troubleshooting": "troubleshooting", "navigational": "navigational", "general": "general", "concept_lookup": "concept_lookup",
    "procedure": "procedure", "comparison": "comparison", "command_usage": "command_usage",
}
EVIDENCE_ROLES = {
    "command_usage": ["parameter", "example", "procedure_step"], "troubleshooting": ["troubleshooting_step", "alarm", "constraint"],
    "concept_lookup": ["concept", "note"], "procedure": ["procedure_step", "parameter", "example"], "comparison": ["concept", "parameter"],
}
# Routes (weight, top k) by complexity, and by intent where a profile has a policy.
COMPLEXITY_ROUTES = {
    "simple": {"entity_exact": (1.5, 20), "lexical_bm25": (1.0, 50)},
    "medium": {"lexical_bm25": (1.0, 50), "dense_vector": (0.9, 50)},
    "complex": {"lexical_bm25": (1.0, 50), "dense_vector": (0.9, 50), "entity_exact": (0.7, 20), "entity_graph": (0.6, 20)},
}
INTENT_POLICY = {
    "default": {"lexical_bm25": (1.0, 50), "entity_exact": (1.0, 20), "dense_vector": (0.8, 50)},
    "command_usage": {"entity_exact": (1.6, 20), "lexical_bm25": (1.0, 50), "dense_vector": (0.4, 20)},
    "concept_lookup": {"dense_vector": (1.3, 60), "lexical_bm25": (1.0, 50), "entity_exact": (0.5, 15)},
    "troubleshooting": {"lexical_bm25": (1.2, 60), "entity_exact": (1.1, 30), "dense_vector": (0.7, 30)},
    "procedure": {"lexical_bm25": (1.1, 50), "entity_exact": (1.0, 25), "dense_vector": (0.8, 40)},
    "comparison": {"dense_vector": (1.2, 60), "lexical_bm25": (1.0, 50), "entity_exact": (0.7, 20)},
    "navigational": {"entity_exact": (1.5, 10), "lexical_bm25": (0.8, 20), "dense_vector": (0.3, 10)},
    "general": {"lexical_bm25": (1.0, 50), "dense_vector": (1.0, 50), "entity_exact": (0.8, 20)},
}
CASCADE_INTENTS = ("troubleshooting", "comparison", "procedure")
EXPANSION_TYPES = {
    "troubleshooting": ["causes", "results_in", "enables", "conditions", "elaborates", "backgrounds"],
    "comparison": ["contrasts_with", "parallels", "elaborates"],
    "procedure": ["purposes", "enables", "sequences", "conditions", "elaborates"],
}
SOFT_SHARE, SOFT_MAX, HARD_SHARE, HARD_HITS = 0.15, 3, 0.6, 5
MAX_VARIANTS, MAX_SUB_QUERIES = 2, 4


def command(query: Column) -> Column:
    """Command of a query: verb and object by pattern, else a verb word and the identifier after it."""
    verb, obj = F.regexp_extract(query, COMMAND, 1), F.regexp_extract(query, COMMAND, 2)
    word = F.get(F.filter(F.array(*[F.lit(w) for w in COMMAND_VERBS]), lambda w: F.contains(query, w)), F.lit(0))
    after = F.substring(query, F.instr(query, word) + F.length(word), F.length(query))
    target = F.nullif(F.upper(F.regexp_extract(after, r"([A-Za-z][A-Za-z0-9_]*)", 1)), F.lit(""))
    by_word = F.concat_ws(" ", lookup(COMMAND_VERBS, word), target)
    return F.when(verb != "", F.upper(F.concat_ws(" ", verb, obj))).when(word.isNotNull(), by_word)


def intent(query: Column, has_command: Column) -> Column:
    """Intent by keyword classes in order; a command entity comes first."""
    out = F.when(has_command, "command_usage")
    for name, words in INTENT_KEYWORDS.items():
        out = out.when(query.rlike("|".join(words)), name)
    return out.otherwise("general")


def scope_terms(query: Column, terms: list[str]) -> Column:
    """Upper-case terms that stand as whole words in the query, sorted."""
    hits = [F.when(query.rlike(rf"(?i)(?<![A-Za-z0-9_])\Q{t}\E(?![A-Za-z0-9_])"), F.lit(t.upper())) for t in terms]
    return F.array_sort(F.filter(F.array(*hits), lambda x: x.isNotNull()))


def keywords(query: Column) -> Column:
    """Tokens of the query without commands, stopwords and single non-CJK characters."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS_ZH + STOPWORDS_EN])
    toks = tx.tokens(F.regexp_replace(query, COMMAND, ""))
    return F.filter(toks, lambda t: ((F.length(t) >= 2) | t.rlike(tx.CJK)) & ~F.array_contains(stop, t))


def complexity(intent_: Column, has_command: Column, n_sub_queries: Column, needs_comparison: Column) -> Column:
    return (
        F.when(intent_.isin("comparison", "troubleshooting") | (n_sub_queries > 0) | F.coalesce(needs_comparison, F.lit(False)), "complex")
        .when((intent_ == "command_usage") & has_command, "simple").when(intent_ == "navigational", "simple").otherwise("medium"))


def normalize_intent(label: Column) -> Column:
    return F.coalesce(lookup(INTENT_LABELS, label), F.lit("general"))


def evidence_roles(intent_: Column) -> Column:
    pairs = [x for k, v in EVIDENCE_ROLES.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))]
    return F.coalesce(F.create_map(*pairs)[intent_], F.array().cast("array<string>"))


def _route_table(queries: DataFrame, policy: dict) -> DataFrame:
    """The constant policy as rows (key, route, weight, top_k, fusion), joined through Spark's size check."""
    rows = ", ".join(
        f"('{key}', '{route}', {float(w)}D, {k}, '{'weighted_rrf' if len(routes) > 1 else 'identity'}')"
        for key, routes in policy.items() for route, (w, k) in routes.items())
    return queries.sparkSession.sql(f"SELECT * FROM (VALUES {rows}) AS t(key, route, weight, top_k, fusion)")


def route_plan(queries: DataFrame, policy: dict | None = None) -> DataFrame:
    """One row per (query, route): routes of the profile's policy for the intent, else of the complexity.

    ``queries``: (query_id, intent, complexity, needs_comparison). Also carries the fusion and rerank method.
    """
    used, column, other = (policy, "intent", "default") if policy else (COMPLEXITY_ROUTES, "complexity", "medium")
    cascade = F.col("intent").isin(*CASCADE_INTENTS) | (F.col("complexity") == "complex") | F.coalesce("needs_comparison", F.lit(False))
    q = queries.select("query_id", "intent", F.when(cascade, "cascade").otherwise("score").alias("rerank"),
                       F.when(F.col(column).isin(*used), F.col(column)).otherwise(other).alias("key"))
    return q.join(_route_table(queries, used), "key").drop("key")


def expansion_config(intent_: Column, base_depth: int = 1, base_expanded: int = 20) -> Column:
    """Relation types, depth and size of graph expansion; empty types mean the global order."""
    pairs = [x for k, v in EXPANSION_TYPES.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))]
    types = F.create_map(*pairs)[intent_]
    return F.struct(F.coalesce(types, F.array().cast("array<string>")).alias("relation_types"),
                    F.when(types.isNotNull(), max(base_depth, 2)).otherwise(base_depth).alias("max_depth"), F.lit(base_expanded).alias("max_expanded"))


def navigate_sections(names: DataFrame, segment_refs: DataFrame) -> DataFrame:
    """Chapters where a query's entities gather: soft ones bias the order, hard ones may filter.

    ``names``: (query_id, name); ``segment_refs``: (segment_id, section, name). A chapter is soft with 15
    percent of the segments hit (best three), hard with 60 percent when five or more were hit.
    """
    hit = segment_refs.join(names, "name").filter(F.length("section") > 0).select("query_id", "segment_id", "section").distinct()
    n = hit.groupBy("query_id", F.lower(tx.strip(F.col("section"))).alias("section")).agg(F.count("*").alias("hits"))
    total = n.groupBy("query_id").agg(F.sum("hits").alias("total"))
    share = F.col("hits") / F.col("total")
    s = n.join(total, "query_id").filter(share >= SOFT_SHARE)
    w = W.partitionBy("query_id").orderBy(F.col("hits").desc(), "section")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= SOFT_MAX).withColumn(
        "hard", (share >= HARD_SHARE) & (F.col("total") >= HARD_HITS))


def fan_out(queries: DataFrame) -> DataFrame:
    """The query itself, up to two variants and up to four sub-queries.

    ``queries``: (query_id, query, intent, entities ARRAY, variants ARRAY<STRING>, sub_queries
    ARRAY<STRUCT<text, intent, entities>>). A sub-query inherits what it does not state itself.
    """
    variants = F.slice(F.filter("variants", lambda v: v.rlike(r"\S") & (v != F.col("query"))), 1, MAX_VARIANTS)
    row = lambda kind, text, intent_, ents: F.struct(
        F.lit(kind).alias("kind"), text.alias("text"), intent_.alias("intent"), ents.alias("entities"))
    subs = F.transform(F.slice("sub_queries", 1, MAX_SUB_QUERIES), lambda s: row(
        "sub_query", s["text"], F.when(s["intent"] != "general", s["intent"]).otherwise(F.col("intent")),
        F.when(F.size(s["entities"]) > 0, s["entities"]).otherwise(F.col("entities"))))
    every = F.concat(
        F.array(row("original", F.col("query"), F.col("intent"), F.col("entities"))),
        F.transform(variants, lambda v: row("variant", v, F.col("intent"), F.col("entities"))), subs)
    return queries.select("query_id", F.posexplode(every).alias("variant_no", "v")).select("query_id", "variant_no", "v.*")

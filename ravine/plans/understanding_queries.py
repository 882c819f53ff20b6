"""Query understanding and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ravine.operators import analytics, understanding as U
from ravine.plans import sql as S
from ravine.plans.registry import query
from ravine.sources.tables import table

_KEY = "conv_id, turn"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))


_Q = "q AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user')"


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_index"), "role", F.col("text").alias("content"))


def _rewrite_sql() -> str:
    expr = "question"
    for a, b in U.TYPOS.items():
        expr = f"replace({expr}, '{a}', '{b}')"
    terms = "flatten([" + ", ".join(f"CASE WHEN list_contains(string_split(categories, ','), '{c}') THEN [{', '.join(repr(t) for t in ts)}] ELSE [] END" for c, ts in U.DOMAIN_TERMS.items()) + "])"
    return f"CASE WHEN len({terms}) > 0 THEN {expr} || ' Niagara BAS/HVAC ' || array_to_string(({terms})[1:3], ' ') ELSE {expr} END"


@query(f"WITH {_Q}, c AS (SELECT *, {S.labels('question', U.CATEGORY_KEYWORDS, 'configuration')} AS categories FROM q) SELECT {_KEY}, categories, {_rewrite_sql()} AS rewritten FROM c")
def query_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir).withColumn("c", U.categories(F.col("question")))
    return q.select("conv_id", "turn", F.array_join("c", ",").alias("categories"), U.rewrite(F.col("question"), F.col("c")).alias("rewritten"))


def _case(expr: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {S.any_of(expr, w)} THEN '{n}'" for n, w in rules) + f" ELSE '{default}' END"


_TYPE = _case("question", U.TYPES, "general")
_MODE = f"CASE WHEN {S.any_of('question', U.CONCEPTUAL)} AND NOT contains(lower(question), 'how to') AND NOT contains(lower(question), 'how do i') THEN 'conceptual' ELSE {_case('question', U.MODES, 'conceptual')} END"
_KIND_HITS = " + ".join(f"(contains(lower(string_split(question, chr(10))[1]), '{w}'))::INT + (contains(lower(question), '{w}'))::INT" for w in U.TECHNICAL)


@query(f"""WITH {_Q}, t AS (SELECT *, {_MODE} AS mode, {_TYPE} AS query_type, CASE WHEN {_KIND_HITS} >= 3 THEN 'technical' WHEN {_KIND_HITS} >= 1 THEN 'mixed' ELSE 'prose' END AS kind FROM q),
 w AS (SELECT *, round(CASE kind WHEN 'technical' THEN 0.35 WHEN 'prose' THEN 0.6 ELSE 0.5 END::DOUBLE + CASE query_type WHEN 'reference' THEN -0.1 WHEN 'troubleshooting' THEN -0.05 WHEN 'definition' THEN 0.05 ELSE 0 END::DOUBLE, 6) AS semantic FROM t)
 SELECT {_KEY}, mode, query_type, kind, semantic, round(1.0::DOUBLE - semantic, 6) AS keyword FROM w""")
def query_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    t = _questions(spark, sf_dir).withColumns({"mode": U.mode(q), "query_type": U.query_type(q), "kind": U.document_kind(F.split(q, "\n")[0], q)})
    semantic, keyword = U.weights(F.col("kind"), F.col("query_type"))
    return t.select("conv_id", "turn", "mode", "query_type", "kind", semantic.alias("semantic"), keyword.alias("keyword"))


#: Letters beyond ASCII are word characters to the engine's patterns; here digits stand for them.
_ASCII = r"regexp_replace(question, '[^\P{L}a-zA-Z]', '9', 'g')"
_ENTITY = rf"list_distinct(list_concat(regexp_extract_all({_ASCII}, '\b[A-Z]{{2,}}\b'), regexp_extract_all(regexp_replace({_ASCII}, '(^|\. )[A-Z][a-z]+\b', '\1x', 'g'), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b')))"
_HAS = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


_ADAPTIVE = rf"""WITH {_Q}, t AS (SELECT *, lower(question) AS low, {_TYPE} AS query_type, CAST(len({_ENTITY}) AS INT) AS entities, len(list_filter(string_split_regex(question, '\s+'), lambda w: w <> '')) AS words, length(question) - length(replace(question, '?', '')) AS asks FROM q),
 c AS (SELECT *, CASE WHEN (query_type = 'definition' AND words < 10 AND entities <= 1) OR (words < 8 AND entities <= 1 AND NOT {_HAS(['and', 'or', 'but', 'also'])}) THEN 'simple'
  WHEN asks > 1 OR entities >= 3 OR (query_type IN ('comparison', 'design', 'troubleshooting') AND words > 15) OR ({_HAS(['compare', 'difference', 'vs', 'versus', 'better', 'which'])} AND entities >= 2) OR ({_HAS(['step', 'procedure', 'process', 'sequence'])} AND words > 12) THEN 'complex' ELSE 'moderate' END AS complexity FROM t),
 k AS (SELECT *, CASE complexity WHEN 'simple' THEN 3 WHEN 'moderate' THEN 5 ELSE 7 END AS b, CASE complexity WHEN 'simple' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END AS v FROM c),
 w AS (SELECT *, CAST(CASE WHEN query_type IN ('comparison', 'design') THEN least(b + 2, 10) WHEN query_type = 'troubleshooting' THEN least(b + 1, 8) WHEN query_type = 'definition' AND complexity = 'simple' THEN 2 ELSE b END AS INT) AS top_k, CAST(CASE WHEN query_type IN ('procedural', 'troubleshooting') THEN least(v + 1, 4) ELSE v END AS INT) AS win FROM k)"""


@query(rf"""{_ADAPTIVE} SELECT {_KEY}, query_type, entities, complexity, top_k, win AS "window", round(greatest(0.0, (25.0 - (top_k + top_k * win * 2)) / 25.0::DOUBLE), 6)::DOUBLE AS savings FROM w""")
def adaptive_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    t = _questions(spark, sf_dir).withColumns({"query_type": U.query_type(q), "entities": U.entity_count(q)})
    t = t.withColumn("complexity", U.complexity(q, F.col("query_type"), F.col("entities")))
    t = t.withColumns({"top_k": U.top_k(F.col("complexity"), F.col("query_type")), "window": U.window(F.col("complexity"), F.col("query_type"))})
    return t.select("conv_id", "turn", "query_type", "entities", "complexity", "top_k", "window", F.round(U.token_savings(F.col("top_k"), F.col("window")), 6).alias("savings"))


@query(rf"""{_ADAPTIVE} SELECT {_KEY}, CAST(CASE WHEN turn > 2 THEN least(top_k + 2, 10) ELSE top_k END AS INT) AS top_k, CAST(CASE WHEN turn > 2 THEN least(win + 1, 4) ELSE win END AS INT) AS "window" FROM w""")
def adaptive_follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions after the second turn follow up: more chunks and a wider window."""
    q = F.col("question")
    t = _questions(spark, sf_dir).withColumns({"query_type": U.query_type(q), "entities": U.entity_count(q)})
    t = t.withColumn("complexity", U.complexity(q, F.col("query_type"), F.col("entities")))
    k, w = U.follow_up_bump(U.top_k(F.col("complexity"), F.col("query_type")), U.window(F.col("complexity"), F.col("query_type")), F.col("turn") > 2)
    return t.select("conv_id", "turn", k.alias("top_k"), w.alias("window"))


def _parts(patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches(lower(question), '{p}', 's')".replace(", 's'", "") for p in patterns) + ")"


@query(f"WITH {_Q} SELECT {_KEY}, {_TYPE} = 'comparison' OR length(question) - length(replace(question, '?', '')) > 1 OR {_parts(U.MULTI_PART)} AS basic, {_TYPE} = 'comparison' OR length(question) - length(replace(question, '?', '')) > 1 OR {_parts(U.MULTI_PART_MORE)} AS more FROM q")
def multi_hop_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("question"), U.query_type(F.col("question"))
    need = lambda p: U.needs_multi_hop(q, t, F.lit("moderate"), F.lit(0), p)
    return _questions(spark, sf_dir).select("conv_id", "turn", need(U.MULTI_PART).alias("basic"), need(U.MULTI_PART_MORE).alias("more"))


_TECH = r"\b(span|block|gpm|pump|valve|sensor|controller|wire|wiring|component|module|analog|digital|bacnet|niagara|kitcontrol|honeywell)\b"


@query(rf"""WITH {_Q}, l AS (SELECT *, lower(question) AS low, trim(question, ' ') AS s, len(string_split(trim(question, ' '), ' ')) AS n FROM q)
 SELECT {_KEY}, CASE WHEN s = '' THEN 'error' WHEN regexp_matches(lower(s), '^(hi|hello|hey|greetings|good morning|good afternoon|good evening)\b') THEN 'clarification' WHEN regexp_matches(lower(s), '^(list|show|get|display|what)\s+(documents?|files?|manuals?|pdfs?)$') THEN 'metadata'
 WHEN regexp_matches(lower(s), '\b(show|display|find|get)\s+(image|diagram|picture|schematic|wiring|visual|drawing)s?\b') THEN 'visual' WHEN regexp_matches(lower(s), '^(it|this|that|they|the)\s') AND n < 6 THEN 'clarification' WHEN n < 3 AND NOT contains(s, '?') THEN 'clarification' ELSE 'search' END AS intent,
 regexp_matches(low, '\b(show|image|diagram|picture|visual|schematic|wiring|drawing)\b') OR regexp_matches(low, 'wir(e|ing)') AS wants_visuals, regexp_matches(low, '\b(detailed|spec|specification|table|parameter|configuration|breakdown)\b') AS wants_details,
 CASE WHEN regexp_matches(low, '\b(detailed|spec|specification|table|parameter|configuration|breakdown)\b') THEN 30 ELSE 20 END AS top_k, CAST(CASE WHEN regexp_matches(low, '{_TECH}') THEN 0.6 ELSE 0.4 END AS DOUBLE) AS fts_weight FROM l""")
def intent_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    return _questions(spark, sf_dir).select("conv_id", "turn", U.intent(q).alias("intent"), *(c.alias(n) for n, c in U.analyze(q).items()))


@query(rf"""WITH {_Q}, l AS (SELECT *, lower(question) AS low, len(string_split(question, ' ')) AS n FROM q) SELECT {_KEY}, array_to_string(list_filter([CASE WHEN regexp_matches(low, '\b(it|this|that|they|these|those)\b') AND n < 8 THEN 'vague_pronoun' END, CASE WHEN n < 3 AND NOT regexp_matches(low, '{_TECH}') THEN 'too_vague' END,
 CASE WHEN regexp_matches(low, '\b(pump|valve|sensor|loop|point|controller|output)\b') AND NOT regexp_matches(low, '\b(which|what type|what kind|pid|analog|digital|control|modulating|temperature|pressure|humidity|flow)\b') THEN 'ambiguous_term' END,
 CASE WHEN NOT regexp_matches(low, '\b(how|configure|wire|install|setup|troubleshoot|connect|set|adjust|calibrate|test|check|diagnose|repair|replace)\b') AND NOT (regexp_matches(low, '\b(what|where|when|why|which|who)\b') OR contains(question, '?')) AND n < 6 THEN 'unclear_intent' END], lambda x: x IS NOT NULL), ',') AS issues FROM l""")
def query_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", U.issues(F.col("question")).alias("issues"))


@query(f"WITH {_Q} SELECT {_KEY}, CASE {_TYPE} " + " ".join("WHEN '{}' THEN '{}'".format(k, "|".join(v).replace("'", "''")) for k, v in U.SUGGESTIONS.items() if k != "general") + " ELSE '{}' END AS suggestions FROM q".format("|".join(U.SUGGESTIONS["general"])))
def follow_up_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", U.suggestions(U.query_type(F.col("question"))).alias("suggestions"))


@query(r"""WITH c AS (SELECT conv_id AS session_id, count(*) AS messages, max_by(text, turn) FILTER (role = 'user') AS question FROM conversations GROUP BY 1)
 SELECT *, CASE WHEN question IS NULL THEN FALSE ELSE regexp_matches(lower(question), '^(what about|how about|and|also|additionally)') OR regexp_matches(lower(question), '^(can you|could you|please)') OR regexp_matches(lower(question), '\b(that|this|it|they|them)\b') OR regexp_matches(lower(question), '^(more|further|additional)')
 OR (len(list_filter(string_split_regex(question, '\s+'), lambda w: w <> '')) < 8 AND messages > 2) END AS is_followup, messages > 6 AS is_long, messages >= 6 AS needs_summary FROM c""")
def convo_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.contexts(_messages(spark, sf_dir))


@query("SELECT conv_id AS session_id, turn AS message_index, role, CASE WHEN length(text) > 500 THEN substring(text, 1, 497) || '...' ELSE text END AS content FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def convo_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.last_messages(_messages(spark, sf_dir))


@query("SELECT conv_id AS session_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages, CAST(floor(avg(length(text))) AS BIGINT) AS avg_length, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY 1")
def convo_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.conversation_stats(_messages(spark, sf_dir))


@query(r"WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(text || ' [Page ' || (doc_id % 7) || '] x [Page ' || (doc_id % 3) || ']', '\[Page (\d+)\]', 1)) AS p FROM documents) SELECT doc_id, len(p)::INT AS n, array_to_string(list_sort(p), ',') AS pages FROM d")
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.col("text"), F.lit(" [Page "), F.col("doc_id") % 7, F.lit("] x [Page "), F.col("doc_id") % 3, F.lit("]"))
    pages = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[Page (\d+)\]"), F.lit(1)))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(pages).alias("n"), F.array_join(F.array_sort(pages), ",").alias("pages"))

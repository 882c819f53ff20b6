"""Query understanding and conversations: columns over a table of questions, so a batch is one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ravine.functions import keywords
from ravine.functions.text import contains_any, ellipsis, word_count

#: Keywords of the query categories.
CATEGORY_KEYWORDS = {
    "architecture": ["multi-tier", "system database", "virtual px", "enterprise", "supervisor network", "topology", "vm", "host", "station", "jace network", "multi tier", "enterprise supervisor", "multiple supervisors", "virtual machine", "spans multiple", "rolls up to", "system design", "system architecture"],
    "graphics": ["graphics", "px", "navigation", "display", "ui", "view", "tag dictionary", "roll-up", "navigation tree", "wiresheet", "design view", "grahics", "desgin"],
    "provisioning": ["provision", "backup", "restore", "job builder", "bulk deploy", "distribution", "archive", "bulk provision"],
    "troubleshooting": ["alarm", "error", "fault", "diagnostic", "troubleshoot", "symptom", "fix", "failed", "issue", "problem"],
    "configuration": ["configure", "setup", "point", "schedule", "parameter", "tuning", "sequence", "setpoint", "config"],
    "hardware": ["wiring", "io", "power", "installation", "sensor", "actuator", "physical", "cable", "termination", "jace", "controller", "device install"],
    "hvac": ["hvac", "ahu", "air handler", "vav", "variable air volume", "fcu", "fan coil", "chiller", "boiler", "cooling tower", "vfd", "fan", "pump", "damper", "sequence of operation", "heating", "cooling", "ventilation", "air flow", "cfm"],
    "energy": ["energy", "demand", "load shedding", "utility", "kwh", "kw", "power consumption", "energy optimization", "demand response", "energy savings", "meter", "carbon", "sustainability"],
    "integration": ["bacnet", "modbus", "lonworks", "lon", "opc", "protocol", "integration", "third-party", "gateway", "driver", "point mapping", "device driver", "trend", "historian"],
}
#: Topics of each category, typos, and terms that a category adds to a query.
CATEGORY_TOPICS = {"architecture": ["system_database", "multi_tier_architecture"], "graphics": ["graphics"], "provisioning": ["provisioning"], "troubleshooting": ["troubleshooting"], "configuration": ["configuration"], "hardware": ["hardware"], "hvac": ["hvac_systems"], "energy": ["energy_management"], "integration": ["integration"]}
TYPOS = {"supervisrs": "supervisors", "grahics": "graphics", "desgin": "design", "confgure": "configure"}
DOMAIN_TERMS = {"architecture": ["multi-tier", "System Database", "enterprise supervisor"], "graphics": ["PX pages", "navigation tree", "tag-based displays"], "provisioning": ["bulk deployment", "job builder", "backup procedures"], "troubleshooting": ["diagnostics", "fault codes", "alarm conditions"], "configuration": ["point configuration", "schedules", "parameters"], "hardware": ["wiring", "installation", "IO configuration"]}
#: Ordered words of modes, types and document kinds.
MODES = [("troubleshooting", ["issue", "problem", "error", "failing", "not working", "diagnose", "troubleshoot"]), ("design", ["design", "architect", "best practice", "recommend", "approach", "should i"]), ("comparison", ["compare", "vs", "versus", "difference", "better", "which"]), ("procedural", ["how to", "how do", "steps", "procedure", "process", "configure", "setup", "install"])]
CONCEPTUAL = ["why", "what is", "explain", "how does", "understand"]
TYPES = [("definition", ["what is", "what are", "define", "explain", "meaning of", "definition"]), ("example", ["example", "how to", "how do", "how can", "show me", "demo", "tutorial"]), ("comparison", ["compare", "comparison", "difference", "vs", "versus", "better", "which"]), ("troubleshooting", ["error", "fix", "debug", "issue", "problem", "not working", "failed", "troubleshoot"]), ("reference", ["default", "spec", "parameter", "argument", "return", "value", "setting"])]
TECHNICAL = ["api", "spec", "specification", "reference", "sdk", "protocol", "configuration", "config", "installation", "setup", "troubleshooting", "debug", "error", "guide", "manual", "documentation", "technical", "system", "architecture", "design", "implementation", "code", "programming", "software", "hardware", "network", "database"]
MULTI_PART = ["and then", "after that", "first.*then", "step 1.*step 2", "difference between.*and", "compare.*to", "versus"]
MULTI_PART_MORE = ["and then", "after that", "first.*then", "step.*step", "difference between.*and", "compare.*to", "versus", "what about.*and", "how.*and.*why"]
FOLLOW_UP = [r"^(what about|how about|and|also|additionally)", r"^(can you|could you|please)", r"\b(that|this|it|they|them)\b", r"^(more|further|additional)"]
#: Patterns of the router, the analyzer and the validator.
GREETING = r"^(hi|hello|hey|greetings|good morning|good afternoon|good evening)\b"
LISTING = r"^(list|show|get|display|what)\s+(documents?|files?|manuals?|pdfs?)$"
PICTURES = r"\b(show|display|find|get)\s+(image|diagram|picture|schematic|wiring|visual|drawing)s?\b"
DANGLING = r"^(it|this|that|they|the)\s"
TECHNICAL_TERM = r"\b(span|block|gpm|pump|valve|sensor|controller|wire|wiring|component|module|analog|digital|bacnet|niagara|kitcontrol|honeywell)\b"
DETAILS = r"\b(detailed|spec|specification|table|parameter|configuration|breakdown)\b"
VISUALS = [r"\b(show|image|diagram|picture|visual|schematic|wiring|drawing)\b", "wir(e|ing)"]
PRONOUN = r"\b(it|this|that|they|these|those)\b"
AMBIGUOUS = r"\b(pump|valve|sensor|loop|point|controller|output)\b"
SPECIFIED = r"\b(which|what type|what kind|pid|analog|digital|control|modulating|temperature|pressure|humidity|flow)\b"
ACTION = r"\b(how|configure|wire|install|setup|troubleshoot|connect|set|adjust|calibrate|test|check|diagnose|repair|replace)\b"
QUESTION_WORD = r"\b(what|where|when|why|which|who)\b"
SUGGESTIONS = {
    "definition": ["How do I configure this?", "Show me a step-by-step setup procedure", "What are common issues with this?"],
    "example": ["What if this doesn't work?", "Are there alternative approaches?", "Show me the verification steps"],
    "troubleshooting": ["What are other possible causes?", "How do I prevent this in the future?", "Show me the diagnostic steps"],
    "comparison": ["Which one should I use for my setup?", "How do I migrate from one to the other?", "What are the performance implications?"],
    "general": ["Can you show me the implementation steps?", "What related topics should I know about?", "Are there any common pitfalls?"],
}


def _first(text: Column, rules, default: str) -> Column:
    out = None
    for name, words in rules:
        hit = contains_any(text, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def categories(question: Column) -> Column:
    return keywords.labels(F.lower(question), CATEGORY_KEYWORDS, "configuration")


def topics_of(cats: Column) -> Column:
    """The topics of an array of categories, each once."""
    table = F.create_map(*(x for k, v in CATEGORY_TOPICS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.array_distinct(F.flatten(F.transform(cats, lambda c: F.coalesce(F.element_at(table, c), F.array().cast("array<string>")))))


def rewrite(question: Column, cats: Column) -> Column:
    """Typos mended, and the first three terms of the categories added."""
    for wrong, right in TYPOS.items():
        question = F.replace(question, F.lit(wrong), F.lit(right))
    terms = F.flatten(F.array(*(F.when(F.array_contains(cats, c), F.array(*map(F.lit, t))).otherwise(F.array().cast("array<string>")) for c, t in DOMAIN_TERMS.items())))
    return F.when(F.size(terms) > 0, F.concat(question, F.lit(" Niagara BAS/HVAC "), F.array_join(F.slice(terms, 1, 3), " "))).otherwise(question)


def mode(question: Column) -> Column:
    low = F.lower(question)
    teach = contains_any(question, CONCEPTUAL) & ~F.contains(low, F.lit("how to")) & ~F.contains(low, F.lit("how do i"))
    return F.when(teach, "conceptual").otherwise(_first(question, MODES, "conceptual"))


def query_type(question: Column) -> Column:
    return _first(question, TYPES, "general")


def document_kind(title: Column, sample: Column) -> Column:
    """technical from three indicator hits on, mixed from one, else prose."""
    hits = sum((F.contains(F.lower(x), F.lit(w)).cast("int") for x in (title, sample) for w in TECHNICAL), F.lit(0))
    return F.when(hits >= 3, "technical").when(hits >= 1, "mixed").otherwise("prose")


def weights(kind: Column, type_: Column) -> tuple[Column, Column]:
    """Semantic and keyword weight, adding up to 1."""
    base = F.when(kind == "technical", 0.35).when(kind == "prose", 0.6).otherwise(0.5)
    shift = F.when(type_ == "reference", -0.1).when(type_ == "troubleshooting", -0.05).when(type_ == "definition", 0.05).otherwise(0.0)
    semantic = F.round(base + shift, 6)
    return semantic, F.round(1.0 - semantic, 6)


def entity_count(question: Column) -> Column:
    """Different acronyms and capitalised phrases that don't begin the text or follow '. '."""
    acronyms = F.regexp_extract_all(question, F.lit(r"\b[A-Z]{2,}\b"), F.lit(0))
    names = F.regexp_extract_all(question, F.lit(r"(?<!^)(?<!\. )\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), F.lit(0))
    return F.size(F.array_distinct(F.concat(acronyms, names)))


def complexity(question: Column, type_: Column, entities: Column) -> Column:
    words, questions = word_count(question), F.length(question) - F.length(F.replace(question, F.lit("?"), F.lit("")))
    compound = contains_any(question, ["and", "or", "but", "also"])
    comparison = contains_any(question, ["compare", "difference", "vs", "versus", "better", "which"])
    steps = contains_any(question, ["step", "procedure", "process", "sequence"])
    simple = ((type_ == "definition") & (words < 10) & (entities <= 1)) | ((words < 8) & (entities <= 1) & ~compound)
    hard = (questions > 1) | (entities >= 3) | (type_.isin("comparison", "design", "troubleshooting") & (words > 15)) | (comparison & (entities >= 2)) | (steps & (words > 12))
    return F.when(simple, "simple").when(hard, "complex").otherwise("moderate")


def top_k(level: Column, type_: Column) -> Column:
    base = F.when(level == "simple", 3).when(level == "moderate", 5).otherwise(7)
    return F.when(type_.isin("comparison", "design"), F.least(base + 2, F.lit(10))).when(type_ == "troubleshooting", F.least(base + 1, F.lit(8))).when((type_ == "definition") & (level == "simple"), 2).otherwise(base)


def window(level: Column, type_: Column) -> Column:
    base = F.when(level == "simple", 1).when(level == "moderate", 2).otherwise(3)
    return F.when(type_.isin("procedural", "troubleshooting"), F.least(base + 1, F.lit(4))).otherwise(base)


def follow_up_bump(k: Column, w: Column, follow_up: Column) -> tuple[Column, Column]:
    return F.when(follow_up, F.least(k + 2, F.lit(10))).otherwise(k), F.when(follow_up, F.least(w + 1, F.lit(4))).otherwise(w)


def token_savings(k: Column, w: Column) -> Column:
    """Against 25 chunks, never below 0."""
    return F.greatest(F.lit(0.0), (25.0 - (k + k * w * 2)) / 25.0)


def needs_multi_hop(question: Column, type_: Column, level: Column, entities: Column, patterns: list[str] = MULTI_PART) -> Column:
    questions = F.length(question) - F.length(F.replace(question, F.lit("?"), F.lit("")))
    low = F.lower(question)
    parts = F.lit(False)
    for p in patterns:
        parts = parts | low.rlike(p)
    return (type_ == "comparison") | ((level == "complex") & (entities >= 3)) | (questions > 1) | parts


def suggestions(type_: Column) -> Column:
    """Three follow-up questions for a query type, joined by a bar."""
    return F.coalesce(F.element_at(F.create_map(*(x for k, v in SUGGESTIONS.items() for x in (F.lit(k), F.lit("|".join(v))))), type_), F.lit("|".join(SUGGESTIONS["general"])))


def intent(question: Column) -> Column:
    """greeting and short or dangling questions need clarification; else metadata, visual or search."""
    q = F.trim(question)
    low, words = F.lower(q), F.size(F.split(q, " "))
    return (
        F.when(q == "", "error")
        .when(low.rlike(GREETING), "clarification")
        .when(low.rlike(LISTING), "metadata")
        .when(low.rlike(PICTURES), "visual")
        .when(low.rlike(DANGLING) & (words < 6), "clarification")
        .when((words < 3) & ~F.contains(q, F.lit("?")), "clarification")
        .otherwise("search")
    )


def analyze(question: Column) -> dict[str, Column]:
    """Routing flags and parameters of a question."""
    low = F.lower(question)
    technical = low.rlike(TECHNICAL_TERM)
    details = low.rlike(DETAILS)
    return {
        "wants_visuals": low.rlike(VISUALS[0]) | low.rlike(VISUALS[1]),
        "wants_details": details,
        "top_k": F.when(details, 30).otherwise(20),
        "fts_weight": F.when(technical, 0.6).otherwise(0.4),
    }


def issues(question: Column) -> Column:
    """What a question lacks: vague_pronoun, too_vague, ambiguous_term, unclear_intent."""
    low, words = F.lower(question), F.size(F.split(question, " "))
    vague = low.rlike(PRONOUN) & (words < 8)
    ambiguous = low.rlike(AMBIGUOUS) & ~low.rlike(SPECIFIED)
    action = low.rlike(ACTION)
    asks = low.rlike(QUESTION_WORD) | F.contains(question, F.lit("?"))
    short = (words < 3) & ~low.rlike(TECHNICAL_TERM)
    found = F.array(F.when(vague, F.lit("vague_pronoun")), F.when(short, F.lit("too_vague")), F.when(ambiguous, F.lit("ambiguous_term")), F.when(~action & ~asks & (words < 6), F.lit("unclear_intent")))
    return F.array_join(F.array_compact(found), ",")


def is_follow_up(question: Column, messages: Column) -> Column:
    hit = F.lit(False)
    for p in FOLLOW_UP:
        hit = hit | F.lower(question).rlike(p)
    return hit | ((word_count(question) < 8) & (messages > 2))


def contexts(messages: DataFrame) -> DataFrame:
    """Per conversation: the last question, whether it follows up, whether it is long or needs a summary."""
    out = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.max_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("message_index"))).alias("question"))
    question = F.coalesce("question", F.lit(""))
    follow = F.when(F.col("question").isNull(), False).otherwise(is_follow_up(question, F.col("messages")))
    return out.withColumns({"is_followup": follow, "is_long": F.col("messages") > 6, "needs_summary": F.col("messages") >= 6})


def last_messages(messages: DataFrame, n: int = 4, longest: int = 500) -> DataFrame:
    """The last n messages of each conversation, cut to ``longest`` characters."""
    w = Window.partitionBy("session_id").orderBy(F.col("message_index").desc())
    return messages.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n).select("session_id", "message_index", "role", ellipsis("content", longest).alias("content"))

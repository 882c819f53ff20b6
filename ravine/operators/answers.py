"""From ranked chunks to an answer's context: conversation, several hops, previews, prompt, grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ravine.functions import formats, keywords, text as T
from ravine.operators import expand
from ravine.operators.search import top

#: Terms that count as entities wherever they occur.
TERMS = ["system database", "system db", "multi-tier", "supervisor", "jace", "station", "px", "graphics", "navigation", "tag dictionary", "bacnet", "modbus", "lon", "n2", "provisioning", "backup", "alarm", "fault", "schedule", "sequence", "ahu", "vav", "fcu", "chiller", "boiler", "point", "control", "network", "protocol"]
MORE_TERMS = ["fox", "niagara", "tridium", "workbench", "web profile"]
#: A run of capitalised words, or capitals.
NAMES = r"\b(?:[A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*)*|[A-Z]{2,})\b"
ENTITIES, HINTS, MANY = 20, 5, 10


def entities(messages: DataFrame, most: int = ENTITIES) -> DataFrame:
    """Per conversation its first entities in order: names and known terms of all messages."""
    low = F.lower("content")
    names = F.filter(F.transform(F.regexp_extract_all("content", F.lit(NAMES), F.lit(0)), lambda t: F.lower(t)), lambda t: F.length(t) > 2)
    terms = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in TERMS)))
    each = messages.select("session_id", F.array_distinct(F.concat(names, terms)).alias("e"))
    some = each.select("session_id", F.explode_outer("e").alias("e")).distinct()
    w = Window.partitionBy("session_id").orderBy(F.col("e").asc_nulls_last())
    some = some.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    return some.groupBy("session_id").agg(F.array_sort(F.collect_list("e")).alias("entities"))


def enhanced(question: Column, entities: Column, follow_up: Column) -> Column:
    """A follow-up's query with the first entities of its conversation."""
    hints = F.slice(entities, 1, HINTS)
    return F.when(follow_up & (F.size(hints) > 0), F.concat_ws(" ", question, F.array_join(hints, " "))).otherwise(question)


def wider_window(entities: Column, follow_up: Column) -> Column:
    return follow_up | (F.size(entities) > MANY)


def frequent_entities(messages: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent entities of each conversation; a known term counts as often as it occurs
    anywhere, whatever its count as a name."""
    names = F.filter(F.transform(F.regexp_extract_all("content", F.lit(NAMES), F.lit(0)), lambda t: F.lower(t)), lambda t: F.length(t) > 2)
    low = F.lower("content")
    known = TERMS + MORE_TERMS
    terms = F.zip_with(F.array(*map(F.lit, known)), keywords.counts(low, known), lambda t, n: F.struct(t.alias("entity"), n.alias("n"), F.lit(True).alias("term")))
    found = F.transform(names, lambda t: F.struct(t.alias("entity"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("term")))
    each = messages.select("session_id", F.explode(F.concat(found, F.filter(terms, lambda x: x["n"] > 0))).alias("x")).select("session_id", "x.*")
    counts = each.groupBy("session_id", "entity").agg(F.coalesce(F.sum(F.when(F.col("term"), F.col("n"))), F.sum("n")).alias("n"))
    w = Window.partitionBy("session_id").orderBy(F.col("n").desc(), "entity")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def summarised(messages: DataFrame, recent: int = 4, least: int = 6, longest: int = 300) -> DataFrame:
    """Per conversation of ``least`` messages or more: all but the recent ones, as the text that a
    summary is made from; shorter ones have none."""
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("message_index"))
    old = messages.withColumns({"n": n, "place": place}).filter((F.col("n") >= least) & (F.col("place") <= F.col("n") - recent))
    line = F.concat(F.upper("role"), F.lit(": "), F.substring("content", 1, longest))
    return old.groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("messages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def multi_hop(lists: DataFrame, hops: int = 3, per_hop: int = 3, single: int = 5) -> DataFrame:
    """Chunks of a question's sub-questions (question_id, hop from 0, id, score), each once.

    The first three hops give their best three; a question with one sub-question its best five. A
    chunk found again has its last score in its first place.
    """
    many = F.max("hop").over(Window.partitionBy("question_id")) > 0
    rank = F.row_number().over(Window.partitionBy("question_id", "hop").orderBy(F.col("score").desc(), "id"))
    kept = lists.withColumns({"many": many, "rank": rank}).filter((F.col("hop") < hops) & (F.col("rank") <= F.when(F.col("many"), per_hop).otherwise(single)))
    place = F.col("hop") * max(per_hop, single) + F.col("rank")
    once = kept.withColumn("place", place).groupBy("question_id", "id").agg(F.min("place").alias("place"), F.max_by("score", "place").alias("score"))
    return once.withColumn("position", F.row_number().over(Window.partitionBy("question_id").orderBy("place"))).drop("place")


def previews(chunks: DataFrame, seeds: DataFrame, n: int = 2, longest: int = 200) -> DataFrame:
    """For each seed (doc_id, id) the n chunks before and after in its document, line feeds as blanks,
    cut to ``longest`` characters."""
    short = F.substring(F.translate("content", "\n", " "), 1, longest)
    some = chunks.join(seeds.select("doc_id").distinct(), "doc_id", "left_semi")
    return expand.neighbours(some, short, n).join(seeds.select("id"), "id", "left_semi")


def source_blocks(results: DataFrame) -> DataFrame:
    """The context of each query: a block for each result in rank order.

    results: query_id, rank, source_type (pdf or youtube), title, page_number, at (seconds), section_path, content.
    """
    where = F.when(F.col("source_type") == "pdf", F.concat(F.lit("**Page "), F.col("page_number").cast("string"), F.lit("**\n"))).when(F.col("source_type") == "youtube", F.concat(F.lit("**Timestamp "), T.minutes_seconds(F.col("at")), F.lit("**\n"))).otherwise("")
    section = F.when(F.size(F.coalesce("section_path", F.array().cast("array<string>"))) > 0, F.concat(F.lit("**Section**: "), F.array_join("section_path", " > "), F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("\n## Source ["), F.col("rank").cast("string"), F.lit("] - "), F.upper("source_type"), F.lit(": "), F.col("title"), F.lit("\n"))
    block = F.concat(head, where, section, F.lit("\n"), F.col("content"), F.lit("\n\n" + "=" * 80 + "\n"))
    return results.groupBy("query_id").agg(F.count(F.lit(1)).alias("sources"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), "").alias("context"))


def once_by_url(images: DataFrame, k: int = 10) -> DataFrame:
    """A query's images, one for each URL: the last one's values in the first one's place, ten at most.
    images: query_id, place, url, caption."""
    one = images.groupBy("query_id", "url").agg(F.min("place").alias("first"), F.max_by("caption", "place").alias("caption"))
    return one.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).filter(F.col("n") <= k)


def first_by_id(assets: DataFrame, key: str = "asset_id", order: str = "place") -> DataFrame:
    """Assets, the first of each id."""
    w = Window.partitionBy(key).orderBy(order)
    return assets.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def citations(results: DataFrame, k: int = 5) -> DataFrame:
    """The best citations again by score."""
    return top(results, "score", k)


def claims(answers: DataFrame) -> DataFrame:
    """Answers (answer_id, answer) to their claims: sentences of more than 20 characters, 20 at most."""
    return answers.select("answer_id", F.posexplode(formats.sentences("answer")).alias("claim_no", "claim"))


def supported(claims: DataFrame, citations: DataFrame, share: float = 0.6) -> DataFrame:
    """Claims with whether one of their answer's citations (answer_id, content) supports them.

    The offline rule: a citation has at least ``share`` of the claim's different words. Answers
    without citations support nothing.
    """
    words = claims.withColumn("w", F.array_distinct(T.tokens("claim")))
    cited = citations.select("answer_id", F.array_distinct(T.tokens("content")).alias("c"))
    part = F.size(F.array_intersect("w", F.coalesce("c", F.array().cast("array<string>")))) / F.greatest(F.size("w"), F.lit(1))
    return words.join(cited, "answer_id", "left").groupBy("answer_id", "claim_no").agg((F.max(part) >= share).alias("supported"))


def verified(answers: DataFrame, citations: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Per answer: claims, supported ones, their share and whether it reaches the threshold. No claim
    is grounded; an answer without citations isn't, and counts no claims."""
    judged = supported(claims(answers), citations).groupBy("answer_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if("supported").alias("supported"))
    cited = citations.select("answer_id").distinct().withColumn("cited", F.lit(True))
    out = answers.select("answer_id").join(judged, "answer_id", "left").join(cited, "answer_id", "left").fillna(False, ["cited"])
    n = F.when(F.col("cited"), F.coalesce("claims", F.lit(0))).otherwise(F.lit(0))
    yes = F.when(F.col("cited"), F.coalesce("supported", F.lit(0))).otherwise(F.lit(0))
    confidence = F.when(~F.col("cited"), 0.0).when(n == 0, 1.0).otherwise(yes / F.greatest(n, F.lit(1)))
    return out.select("answer_id", n.cast("long").alias("claims"), yes.cast("long").alias("supported"), F.round(confidence, 6).alias("confidence"), (F.round(confidence, 6) >= threshold).alias("grounded"))

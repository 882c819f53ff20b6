"""Ingestion: elements, headings, section tree, greedy chunks, topics, page index, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ravine.functions import keywords, text as T
from ravine.operators import folds
from ravine.sources.tables import TOPICS

#: Keywords of the topics, in the topics' order.
TOPIC_KEYWORDS = dict(
    zip(
        TOPICS,
        [
            ["system database", "system db", "station database", "shared database", "db sync", "database synchronization", "station coordination", "sysdb", "history sync", "shared history", "station sync", "data replication"],
            ["multi-tier", "multi tier", "enterprise supervisor", "virtual px", "vm", "supervisor network", "jace network", "topology", "network architecture", "tiered architecture", "hierarchical network", "supervisor station", "jace-to-supervisor", "supervisor-to-jace", "niagara network", "enterprise network", "multiple supervisors", "multiple stations", "network design", "site architecture"],
            ["px", "graphics", "navigation", "display", "view", "tag dictionary", "wiresheet", "roll-up", "navigation tree", "ui", "user interface", "visual", "dashboard", "hmi", "graphic design", "tag-based", "px page", "visualization", "display design", "navigation design", "graphic template", "web profile", "web graphics", "tag reference", "dynamic graphics"],
            ["provision", "backup", "restore", "job builder", "bulk", "distribution", "archive", "deploy", "deployment", "module distribution", "station backup", "archive manager", "bulk operations", "station restore", "snapshot", "rollback", "configuration backup", "system restore"],
            ["alarm", "fault", "error", "diagnostic", "troubleshoot", "issue", "symptom", "debug", "problem", "failure", "alarm routing", "fault detection", "error code", "diagnosis", "alarm analysis", "fault condition", "system error", "alarm notification", "fault message"],
            ["configure", "schedule", "parameter", "point", "setpoint", "tuning", "sequence", "setup", "setting", "config", "control logic", "pid tuning", "point configuration", "parameter setup", "control strategy", "scheduling", "setpoint adjustment", "point setup", "logic configuration", "bql", "control program", "program logic", "logic editor"],
            ["wiring", "io", "sensor", "actuator", "power", "installation", "termination", "physical", "cable", "connector", "jace", "controller", "hardware install", "device installation", "i/o module", "analog input", "digital output", "universal input", "communication module", "network adapter", "power supply", "battery backup", "din rail", "enclosure", "field device", "controller installation", "device commissioning"],
            ["ahu", "air handler", "air handling unit", "vav", "variable air volume", "fcu", "fan coil", "chiller", "boiler", "heat exchanger", "cooling tower", "hvac", "heating", "ventilation", "cooling", "damper", "vfd", "variable frequency drive", "fan", "pump", "sequence of operation", "hvac sequence", "equipment schedule", "psychrometric", "enthalpy", "static pressure", "cfm", "air flow", "discharge air", "return air", "supply air", "exhaust", "economizer", "heat recovery", "energy recovery"],
            ["energy", "demand", "load shedding", "peak demand", "utility", "kw demand", "kwh", "power consumption", "energy optimization", "demand response", "load control", "energy savings", "power monitoring", "energy meter", "submeter", "utility meter", "carbon", "emissions", "sustainability", "green building", "leed", "energy star", "benchmarking"],
            ["bacnet", "modbus", "lonworks", "lon", "opc", "snmp", "protocol", "integration", "third-party", "gateway", "driver", "device driver", "network discovery", "point mapping", "device integration", "protocol conversion", "bacnet ms/tp", "bacnet ip", "modbus rtu", "modbus tcp", "lonmark", "lon network", "opc ua", "opc da", "trend", "data logging", "historian", "data export"],
        ],
        strict=True,
    )
)
#: The backfill's own steps, in order, with their keywords.
BACKFILL = [
    ("system_database", ["system database", "system db", "station database", "shared database"]),
    ("multi_tier_architecture", ["multi-tier", "multi tier", "enterprise supervisor", "virtual px", "supervisor network", "jace network"]),
    ("graphics", ["graphics", " px ", "navigation", "display", "view", "tag dictionary", "wiresheet"]),
    ("provisioning", ["provision", "backup", "restore", "job builder", "archive", "deploy"]),
    ("troubleshooting", ["alarm", "fault", "error", "diagnostic", "troubleshoot"]),
    ("configuration", ["configure", "setup", "parameter", "setting", "config"]),
    ("hvac_systems", ["ahu", "air handler", "vav", "variable air volume", "fcu", "fan coil", "chiller", "boiler", "cooling tower", "vfd", "sequence of operation", "discharge air", "supply air"]),
    ("energy_management", ["energy", "demand", "load shedding", "utility", "kwh", " kw ", "power consumption", "energy savings", "meter"]),
    ("integration", ["bacnet", "modbus", "lonworks", " lon ", "opc", "protocol", "device driver", "point mapping", "historian"]),
]


def topics(content: Column, title: Column | None = None) -> Column:
    """The topics whose keywords occur as substrings; ['other'] where none does. Lower-case texts."""
    return keywords.labels(content if title is None else F.concat_ws(" ", title, content), TOPIC_KEYWORDS, "other")


def backfill(content: Column) -> Column:
    """Topics by the ordered steps: the first hit is the main topic, later ones are appended.

    The second step appends only to system_database; the one step before it can have added nothing
    else, so that condition always holds.
    """
    return keywords.labels(content, dict(BACKFILL), "other")


def elements(documents: DataFrame, lines_per_page: int = 5) -> DataFrame:
    """Lines as elements: doc_id, page_no, idx, text. Blank lines are dropped, numbering stays."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text")).filter(F.length(F.trim("text")) > 0).withColumn("page_no", F.floor(F.col("idx") / lines_per_page).cast("int"))


def fill_pages(pages: DataFrame) -> DataFrame:
    """Every page from a document's first to its last, with the number of its elements (maybe 0)."""
    counts = pages.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n"))
    every = counts.groupBy("doc_id").agg(F.min("page_no").alias("a"), F.max("page_no").alias("b")).select("doc_id", F.explode(F.sequence("a", "b")).alias("page_no"))
    return every.join(counts, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.coalesce("n", F.lit(0)).alias("n"))


def element_type(label: Column) -> Column:
    low = F.lower(label)
    return F.when(F.contains(low, F.lit("title")) | F.contains(low, F.lit("section")) | F.contains(low, F.lit("heading")), "section_header").otherwise("text")


def heading_level(label: Column) -> Column:
    """0 for a title; the first number between dashes of a heading, else 1; 99 for other labels."""
    low = F.lower(label)
    number = F.regexp_extract(low, r"(?:^|-)(\d+)(?:-|$)", 1)
    heading = F.contains(low, F.lit("section")) | F.contains(low, F.lit("heading"))
    return F.when(F.contains(low, F.lit("title")), 0).when(heading & (number != ""), F.when(number != "", number).cast("int")).when(heading, 1).otherwise(99)


def repeated_lines(elements: DataFrame, more_than: int = 3, shorter: int = 60, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Short texts that a document repeats: headers and footers."""
    return elements.filter(F.length("text") < shorter).groupBy(*by, "text").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than)


def toc_pages(elements: DataFrame) -> DataFrame:
    """Pages of contents: the word, or many headers with many dotted lines."""
    t = F.trim("text")
    stats = elements.groupBy("doc_id", "page_no").agg(F.count_if(F.length(t) < 60).alias("headers"), F.count_if(t.rlike(r"\.{3,}")).alias("dotted"), F.count_if(t.rlike(r"\d+$")).alias("numbered"), F.max(F.contains(F.lower(t), F.lit("contents"))).alias("named"))
    return stats.withColumn("is_toc", F.col("named") | ((F.col("headers") > 8) & (F.col("dotted") > 3)))


def headings(lines: DataFrame) -> DataFrame:
    """Titles that pass every noise filter; of equal ones (without case) a document's first."""
    t = F.col("text")
    ok = lines.filter((F.length(t) >= 10) & ~T.is_header_noise(t) & ~T.is_legal(t) & ~T.is_identifier(t) & ~T.is_navigation(t) & ~T.is_metadata(t) & T.is_valid_title(t))
    w = Window.partitionBy("doc_id", F.lower(t)).orderBy("idx")
    first = ok.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    numbered = Window.partitionBy("doc_id").orderBy("idx")
    return first.withColumn("section_id", F.format_string("sec_%04d", F.row_number().over(numbered) - 1)).withColumn("level", F.coalesce(T.section_level(t), F.lit(1)))


def section_parents(sections: DataFrame) -> DataFrame:
    """The nearest section before with a smaller level: one window for each of the four levels."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("idx"))).over(w) for k in range(1, 5)]
    parent = F.greatest(*(F.when(F.col("level") > k, x) for k, x in zip(range(1, 5), last)), F.lit(None).cast("int"))
    return sections.withColumn("parent_idx", parent)


def section_paths(sections: DataFrame, depth: int = 4) -> DataFrame:
    """Root-to-leaf titles; levels are bounded, so the path is a few joins to the parent."""
    s = section_parents(sections).select("doc_id", "idx", "title", "parent_idx")
    up = s.select(F.col("doc_id"), F.col("idx").alias("p"), F.col("title").alias("pt"), F.col("parent_idx").alias("pp"))
    out = s.withColumn("path", F.array("title")).withColumn("p", F.col("parent_idx"))
    for _ in range(depth - 1):
        out = out.join(up, ["doc_id", "p"], "left").withColumn("path", F.when(F.col("pt").isNotNull(), F.concat(F.array("pt"), "path")).otherwise(F.col("path"))).withColumn("p", F.col("pp")).drop("pt", "pp")
    return out.select("doc_id", "idx", F.array_join("path", " > ").alias("path"))


def transcript_chunks(segments: DataFrame, seconds: int = 60) -> DataFrame:
    """Group a key's segments while their durations stay within ``seconds``: a fold in order.

    ``segments``: key, at (seconds), seq, duration, text. Returns key, chunk_no, start_s, end_s, n, text.
    """
    return folds.fold(segments.select("key", "at", "seq", "duration", "text"), "key", ["at", "seq"], folds.transcript_chunks(seconds), "key bigint, chunk_no int, start_s bigint, end_s bigint, n int, text string")


def chunk_ranges(chunks: DataFrame, by: str = "section_id") -> DataFrame:
    """Per section: first and last chunk and how many there are."""
    return chunks.groupBy(by).agg(F.min("id").alias("first_chunk"), F.max("id").alias("last_chunk"), F.count(F.lit(1)).alias("chunks"))

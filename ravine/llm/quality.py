"""Quality rules with adaptive thresholds from mergeable quantile sketches.

A first pass measures every document with built-in functions. The measures of the documents that
pass the base rules go into quantile sketches: a histogram with buckets of a relative width of
1/64 (integers, so that sketches merge by addition and every run agrees), one for each language
and source. A language's and the corpus' sketches are merged from these. Their quantiles give the
thresholds that are joined to the measured documents; a group with too few documents takes its
language's, then the corpus'. A threshold is a far fence above the group's usual values:
``q80 + FENCE * (q80 - q50) + slack``. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ravine.llm.common import WORD, materialize

N = 5  # words in a window that counts as repetition
FENCE = 6
#: Documents that a sketch must hold before its own thresholds are used.
ENOUGH = 100
#: Measures in whole thousandths (word_length: hundredths), with the slack of their fences.
SLACK = {"symbols": 100, "capitals": 200, "word_length": 300, "dup_lines": 500}
#: More groups than this aren't broadcast.
FEW_GROUPS = 50_000

_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(df: DataFrame) -> DataFrame:
    """__repeat: words in windows of N that occur twice or more in the text.

    Columns hold each step: an array that a lambda needs is never computed inside it.
    """
    size = F.size("__hashes")
    five = F.transform("__hashes", lambda h, i: F.xxhash64(h, *(F.get("__hashes", i + k) for k in range(1, N))))
    df = df.withColumn("__five", F.slice(five, F.lit(1), F.greatest(size - N + 1, F.lit(0))))
    df = df.withColumn("__any", F.size(F.array_distinct("__five")) < F.size("__five"))
    in_order = F.sort_array(F.transform("__five", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__sorted", F.when(F.col("__any"), in_order))
    same = F.zip_with("__sorted", F.slice("__sorted", 2, size), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    df = df.withColumn("__same", same)
    either = F.zip_with("__same", F.concat(F.array(F.lit(False)), "__same"), lambda a, b: F.coalesce(a, F.lit(False)) | b)
    starts = F.sort_array(F.array_compact(F.zip_with("__sorted", either, lambda s, f: F.when(f, s["i"]))))
    df = df.withColumn("__starts", starts)
    covered = F.zip_with("__starts", F.slice("__starts", 2, size), lambda a, b: F.least(F.lit(N), F.coalesce(b - a, F.lit(N))))
    df = df.withColumn("__repeat", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda x, y: x + y), F.lit(0)).cast("long"))
    return df.drop("__five", "__any", "__sorted", "__same", "__starts")


def _removed(text: Column, characters: str) -> Column:
    """How many of these characters the text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measure(df: DataFrame) -> DataFrame:
    """Add the base measures of ``text`` (null: as the empty text) and base_failed."""
    df = df.drop(*_MEASURES, "base_failed", "kept", "n_lines", "n_capitals")
    df = df.withColumn("__text", F.coalesce("text", F.lit("")))
    df = df.withColumn("__words", F.array_remove(F.split(F.translate("__text", "\t\n\x0b\x0c\r", "     "), " "), ""))
    df = df.withColumn("n_words", F.size("__words").cast("long")).withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    df = df.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long")).drop("__words")
    df = _repeat_words(df)
    lines = F.filter(F.split("__text", "\n"), lambda line: line.rlike(WORD))
    df = df.withColumn("__lines", lines)
    df = df.withColumns(
        {
            "n_symbols": _removed(F.col("__text"), "#*$%&|<>"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_capitals": _removed(F.col("__text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "n_repeat_words": F.col("__repeat"),
        }
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__text", "__hashes", "__lines", "__repeat")


def _ratios() -> dict[str, str]:
    """The adaptive measures as whole numbers."""
    return {
        "symbols": "(1000 * n_symbols) div greatest(n_words, 1)",
        "capitals": "(1000 * n_capitals) div greatest(word_chars, 1)",
        "word_length": "(100 * word_chars) div greatest(n_words, 1)",
        "dup_lines": "(1000 * n_dup_lines) div greatest(n_lines, 1)",
    }


def bucket(value: Column) -> Column:
    """The least whole number of the value's sketch bucket: 7 leading bits are kept."""
    drop = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    unit = F.pow(F.lit(2.0), drop).cast("long")
    return value - F.pmod(value, unit)


def sketch(measured: DataFrame) -> DataFrame:
    """The sketches: lang, source, measure, bucket, n — add up n to merge."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), bucket(F.expr(e)).alias("bucket")) for k, e in _ratios().items())))
    rows = measured.filter("not base_failed").select("lang", "source", each.alias("__m")).select("lang", "source", "__m.*")
    return rows.groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The merged sketches' fences by ``keys`` and measure, where they hold ENOUGH documents."""
    merged = sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    merged = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    at = {q: F.min(F.when(100 * F.col("upto") >= q * F.col("all"), F.col("bucket"))).alias(f"q{q}") for q in (50, 80)}
    out = merged.groupBy(*keys, "measure").agg(*at.values(), F.max("all").alias("all"))
    slack = F.create_map(*(x for k, v in SLACK.items() for x in (F.lit(k), F.lit(v))))
    return out.select(*keys, "measure", "all", (F.col("q80") + FENCE * (F.col("q80") - F.col("q50")) + slack[F.col("measure")]).alias("fence"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """A row for each language and source: the highest value of each measure that is kept."""
    own = _fences(sketches, ["lang", "source"]).filter(F.col("all") >= ENOUGH).select("lang", "source", "measure", F.col("fence").alias("own"))
    lang = _fences(sketches, ["lang"]).filter(F.col("all") >= ENOUGH).select("lang", "measure", F.col("fence").alias("by_lang"))
    corpus = _fences(sketches, []).select("measure", F.col("fence").alias("by_corpus"))
    every = sketches.select("lang", "source", "measure").distinct()
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]
    out = every.join(own, same(every, own, "lang", "source", "measure"), "left").select(every["*"], "own")
    out = out.join(lang, same(out, lang, "lang", "measure"), "left").select(out["*"], "by_lang")
    out = out.join(corpus, same(out, corpus, "measure"), "left").select(out["*"], "by_corpus")
    fence = F.coalesce("own", "by_lang", "by_corpus")
    return out.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == k, fence)).alias(f"max_{k}") for k in SLACK))


def judge(df: DataFrame) -> DataFrame:
    """``df`` with its measures, base_failed and ``kept``.

    Null texts count as empty (no word: base_failed). Null languages and sources are groups like
    any other. Repeated rows count each. Columns that have a measure's name are replaced. Very long
    texts are measured whole; an empty table gives an empty one. The measured table is written to the shared folder once, so texts are measured once.
    """
    return _verdict(materialize(measure(df), "measured"))


def judge_documents(documents: DataFrame) -> DataFrame:
    out = judge_small(documents)
    return out.select("doc_id", *_MEASURES, "base_failed", "kept")


def judge_small(documents: DataFrame) -> DataFrame:
    """As ``judge``, without carrying the texts: measured first, then dropped."""
    keep = ["doc_id", "lang", "source", *_MEASURES, "n_lines", "n_capitals", "base_failed"]
    measured = materialize(measure(documents.select("doc_id", "lang", "source", "text")).select(*keep), "measures")
    return _verdict(measured)


def _verdict(measured: DataFrame) -> DataFrame:
    limits = materialize(thresholds(sketch(measured)).withColumnsRenamed({"lang": "__lang", "source": "__source"}), "limits")
    if limits.count() <= FEW_GROUPS:
        limits = F.broadcast(limits)  # at most FEW_GROUPS rows of six values
    joined = measured.join(limits, measured["lang"].eqNullSafe(F.col("__lang")) & measured["source"].eqNullSafe(F.col("__source")), "left")
    within = F.lit(True)
    for k, e in _ratios().items():
        within = within & (F.expr(e) <= F.coalesce(F.col(f"max_{k}"), F.expr(e)))
    return joined.withColumn("kept", ~F.col("base_failed") & within).drop("__lang", "__source", *(f"max_{k}" for k in SLACK))

"""Quality rules with host verdicts.

Each document is measured, the share of failing documents is counted by host,
shrunk towards the corpus by an empirical beta prior, and the verdict of the
host is joined back to its documents. Everything is DataFrame functions.

Defined results:

* null or blank text: no words, so ``n_words`` is 0 and the document fails;
* null host: one host of its own;
* repeated rows: each is a document, measured and counted on its own;
* empty table: empty result;
* columns of the input that have the name of a measure: kept inside ``row``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.joins import broadcast_if_small
from driftline.llm.tables import packed, words, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
MAX_SYMBOL_PCT = 10
MAX_DUP_LINE_PCT = 30
MAX_HOST_RATE = 0.5
MAX_PRIOR = 1e6

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(df: DataFrame, text: str = "text", host: str = "source",
            keep: list[str] | None = None) -> DataFrame:
    """``row``, ``host``, the measures of the text and the rules it breaks.

    Repeated windows are found inside the row: a window is one 64-bit hash of
    its words, and only a text in which two windows agree has its windows
    sorted with their positions. No word leaves its row, so nothing shuffles.
    """
    out = packed(df, keep, text=text, host=host).withColumn("text", F.coalesce("text", F.lit("")))
    out = out.withColumns({
        "words": words(F.col("text")),
        "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long")})
    out = out.select(
        "row", "host", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).alias("windows"))
    out = out.withColumn("sorted", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = out.drop("windows").withColumn("starts", F.sort_array(F.transform(F.filter(
        "sorted", lambda w, k: F.coalesce(w["h"] == F.get("sorted", k - 1)["h"], F.lit(False))
        | F.coalesce(w["h"] == F.get("sorted", k + 1)["h"], F.lit(False))), lambda w: w["i"])))
    out = out.drop("sorted").withColumn("n_repeat_words", F.coalesce(F.aggregate(
        F.transform("starts", lambda p, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda total, n: total + n), F.lit(0).cast("long")))
    base = ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
    return out.select("row", "host", *MEASURES, base.alias("base_failed"), (
        base | (100 * F.col("n_symbols") > MAX_SYMBOL_PCT * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PCT * F.col("n_lines"))).alias("rule_failed"))


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate, verdict.

    The prior is Beta(m k, (1 - m) k): m is the corpus rate, k follows from the
    variance between hosts, less what drawing n documents makes by itself.
    Hosts that do not differ get the largest k, so all rates become m.
    """
    hosts = written(measured.groupBy("host").agg(
        F.count("*").alias("host_docs"),
        F.sum(F.col("rule_failed").cast("long")).alias("host_failures")), "hosts")
    m, k = beta_prior(hosts)
    rate = F.round((F.col("host_failures") + m * k) / (F.col("host_docs") + k), 9)
    return hosts.select("*", rate.alias("host_rate"), (rate > max_rate).alias("host_rejected"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and strength of the prior, from four sums over the hosts."""
    n, f = F.col("host_docs"), F.col("host_failures")
    docs, failures, squares, count = hosts.agg(
        F.sum(n), F.sum(f), F.sum(f * f / n), F.count("*")).first()
    if not docs:
        return 0.0, MAX_PRIOR
    m = failures / docs
    between = squares / docs - m * m - m * (1 - m) * count / docs
    return m, max(1.0, min(MAX_PRIOR, m * (1 - m) / between - 1)) if between > 0 else MAX_PRIOR


def host_rules(df: DataFrame, text: str = "text", host: str = "source",
               max_rate: float = MAX_HOST_RATE, keep: list[str] | None = None) -> DataFrame:
    """Measures, host verdict and ``kept`` for each row of ``df``, which stays in ``row``.

    The measured rows are written once, since both the count by host and the
    join read them; ``keep`` names the input columns to write with them (all). The verdicts (one row per host) are broadcast only if they
    are few; otherwise the join shuffles, and adaptive execution splits a host
    that holds much of the table.
    """
    measured = written(measure(df, text, host, keep), "measured")
    verdicts = broadcast_if_small(host_verdicts(measured, max_rate))
    joined = measured.join(verdicts.withColumnRenamed("host", "verdict_host"),
                           F.col("host").eqNullSafe(F.col("verdict_host")), "left")
    return joined.drop("verdict_host").withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))

"""Quality rules: base text statistics and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word uni- and bigrams are counted, one over the
raw corpus (every document) and one over all trusted documents (labelled as
good).  A document's score is the
mean over its n-grams of log p_trusted - log p_raw; it is kept if the score is
at least ``threshold`` and the base rules hold.  Only DataFrame functions are
used; the ratio table has ``2 ** bits`` entries whatever the corpus.

Nulls and oddities: null and empty texts have no words and fail the base
rules.  A null id is carried along.  Repeated rows are judged one by one.
Without trusted documents the ratio is 0 everywhere and only the base rules
decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import prepare, table, words

BITS = 16
THRESHOLD = -0.5
WINDOW = 8


def word_columns(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``w_`` (words) and ``h_`` (their 64-bit hashes)."""
    return docs.withColumn("w_", words(F.col(text))).withColumn("h_", F.transform("w_", lambda w: F.xxhash64(w)))


def ngrams(docs: DataFrame, bits: int) -> DataFrame:
    """Adds ``g_``: the buckets of all uni- and bigrams of ``h_``."""
    size = F.lit(1 << bits)
    pairs = F.when(F.size("h_") > 1, F.transform(
        F.sequence(F.lit(0), F.size("h_") - 2), lambda i: F.pmod(F.xxhash64(F.get("h_", i), F.get("h_", i + 1)), size)))
    return docs.withColumn("g_", F.concat(F.transform("h_", lambda h: F.pmod(h, size)),
                                          F.coalesce(pairs, F.array().cast("array<bigint>"))))


def ratio_table(docs: DataFrame, trusted: DataFrame, ident: str, text: str, bits: int) -> DataFrame:
    """One row with ``llr_``, the log ratio of each bucket (add-one half smoothing).

    ``trusted`` holds the ids of trusted documents; the raw counts are taken
    over all of ``docs``."""
    ids = trusted.select(F.col(ident).alias("t_")).where("t_ IS NOT NULL").distinct().withColumn("is_", F.lit(1))
    # The trusted ids grow with the corpus, so they are merged, not broadcast, at every size.
    marked = docs.select(F.col(ident).alias("t_"), F.col(text).alias("x_")).join(ids.hint("merge"), "t_", "left")
    counted = (
        # explode_outer, as explode would have the optimizer infer a filter on the array and compute it twice
        ngrams(word_columns(marked, "x_"), bits).select(F.coalesce("is_", F.lit(0)).alias("is_"), F.explode_outer("g_").alias("b"))
        .where("b IS NOT NULL").groupBy("b").agg(F.count("*").alias("raw"), F.sum("is_").cast("long").alias("good"))
    ).checkpoint()
    total = counted.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    n, mass = 1 << bits, 0.5 * (1 << bits)
    spark = docs.sparkSession
    both = spark.range(n).withColumnRenamed("id", "b").join(counted, "b", "left").na.fill(0)
    llr = (F.log((F.col("good") + 0.5) / (total["good"] + mass)) - F.log((F.col("raw") + 0.5) / (total["raw"] + mass))
           if total["good"] else F.lit(0.0))
    # A table of 2 ** bits rows: gathered into one array by design.
    return both.select(F.struct("b", llr.alias("v")).alias("x")).agg(F.sort_array(F.collect_list("x")).alias("x")).select(
        F.col("x.v").alias("llr_")).checkpoint()


def base_counts(df: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; needs ``w_`` and ``h_``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(F.size("h_") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("h_") - WINDOW), lambda i: F.xxhash64(*[F.get("h_", i + k) for k in range(WINDOW)])))
    df = df.withColumns({
        "n_words": F.size("w_").cast("long"),
        "word_chars": F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "l_": lines, "v_": windows,
    })
    df = df.withColumns({
        "n_dup_lines": (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long"),
        # Sorted only where some window occurs twice.
        "s_": F.when(F.size("v_") > F.size(F.array_distinct("v_")), F.sort_array(F.transform("v_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    })
    same = F.transform("s_", lambda x, k: F.when(
        (k > 0) & (x["h"] == F.get("s_", k - 1)["h"]) | F.coalesce(x["h"] == F.get("s_", k + 1)["h"], F.lit(False)), x["i"]))
    df = df.withColumn("p_", F.sort_array(F.filter(same, lambda i: i.isNotNull())))
    covered = F.aggregate(
        F.transform("p_", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p_", k + 1) - i, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("l_", "v_", "s_", "p_")


def judge(docs: DataFrame, trusted: DataFrame, ident: str = "doc_id", text: str = "text", keep: list[str] | None = None,
          bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """Judge every row: the columns ``keep`` (default: the id), the base counts,
    base_failed, score and kept."""
    keep = keep or [ident]
    held = [f"k{i}_" for i in range(len(keep))]
    model = ratio_table(docs, trusted, ident, text, bits)
    df = docs.select(*[F.col(c).alias(h) for c, h in zip(keep, held)], F.col(text).alias("x_"))
    df = base_counts(word_columns(df, "x_"), "x_")
    df = ngrams(df, bits).withColumn("llr_", model.scalar())
    total = F.aggregate(F.transform("g_", lambda b: F.get("llr_", b.cast("int"))), F.lit(0.0), lambda a, x: a + x)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return (
        df.select(*held, *counts, failed.alias("base_failed"),
                  F.coalesce(total / F.when(F.size("g_") > 0, F.size("g_")), F.lit(0.0)).alias("score"))
        .select(*[F.col(h).alias(c) for c, h in zip(keep, held)], *counts, "base_failed", "score",
                (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def kept_rows(docs: DataFrame, trusted: DataFrame, ident: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are."""
    names = [f"c{i}_" for i in range(len(docs.columns))]  # the caller's names may be those of the verdict's columns
    at = dict(zip(docs.columns, names))
    trusted = trusted.select(F.col(ident).alias(at[ident]))
    # The random column keeps the optimizer from copying the verdict's expressions into the filter below them.
    judged = judge(docs.toDF(*names), trusted, at[ident], at[text], keep=names, **options).withColumn("r_", F.rand(0))
    return judged.where("kept AND r_ >= 0").select(*names).toDF(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return judge(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))

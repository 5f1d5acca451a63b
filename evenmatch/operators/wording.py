"""Gender-coded wording of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import find_all
from ..sources import rules as R
from ..sources.rules import ENDINGS, FEMININE_CODED, MASCULINE_CODED, VERDICT_CUTOFF

WORD_PATTERN = r"[a-z]+(?:-[a-z]+)*"


def form_table(spark: SparkSession, masculine=MASCULINE_CODED, feminine=FEMININE_CODED, endings=ENDINGS) -> DataFrame:
    """(word, type, matched): every form of every entry; the first entry in list order owns a form.

    Entries times endings is about a thousand rows, so matching is an equi-join on whole words.
    """
    rows = [(e, kind, i) for kind, words in (("masculine-coded", masculine), ("feminine-coded", feminine)) for i, e in enumerate(words)]
    entries = spark.createDataFrame(rows, "matched string, type string, ord int")
    stem = F.when(F.col("matched").endswith("e"), F.expr("substr(matched, 1, length(matched) - 1)")).otherwise(F.col("matched"))
    forms = entries.select("matched", "type", "ord", F.explode(F.transform(F.array(*[F.lit(e) for e in endings]), lambda e: F.concat(stem, e))).alias("word"))
    return forms.groupBy("word", "type").agg(F.min_by("matched", "ord").alias("matched"))


def flag_coded_words(texts: DataFrame, forms: DataFrame, key: str = "bio_id", text: str = "text") -> DataFrame:
    """One row per flagged word occurrence: key, pos, word, type, matched."""
    words = texts.select(key, F.posexplode(find_all(F.lower(text), WORD_PATTERN)).alias("pos", "word"))
    return words.join(forms, "word").select(key, F.col("pos").cast("bigint").alias("pos"), "word", "type", "matched")


def wording_score(texts: DataFrame, forms: DataFrame, key: str = "bio_id", text: str = "text") -> DataFrame:
    """Per text: counts, score per 100 words (+ masculine, - feminine) and verdict.

    The words of a text are looked up and counted in the task that read it; one row per text and
    task is shuffled.
    """
    words = find_all(F.lower(text), WORD_PATTERN)
    both = forms.groupBy("word").agg(
        F.max((F.col("type") == "masculine-coded").cast("int")).alias("m"), F.max((F.col("type") == "feminine-coded").cast("int")).alias("f"))
    d = texts.select(key, words.alias("_w")).select(key, F.size("_w").cast("bigint").alias("n_words"), F.explode_outer("_w").alias("word")).join(both, "word", "left")
    c = d.groupBy(key, "n_words").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("masculine_count"), F.coalesce(F.sum("f"), F.lit(0)).alias("feminine_count"))
    score = F.bround((F.col("masculine_count") - F.col("feminine_count")) / F.greatest("n_words", F.lit(1)) * 100, 2)
    verdict = (
        F.when((F.col("masculine_count") == 0) & (F.col("feminine_count") == 0), R.NO_CODED_WORDS)
        .when(F.abs("score") < VERDICT_CUTOFF, R.BALANCED_WORDS)
        .when(F.col("score") > 0, R.MASCULINE_WORDS)
        .otherwise(R.FEMININE_WORDS)
    )
    return c.withColumn("score", score).withColumn("verdict", verdict)

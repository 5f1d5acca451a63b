"""Text units: tokens, windows, sentences, candidate phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import PIECE, WORD_OR_MARK, find_all, search_tokens, strip
from ..sources.rules import GENERIC_NOUNS, STOP_WORDS
from .spans import runs


def lexical_tokens(df: DataFrame, key: str = "bio_id", text: str = "text", stop_words=()) -> DataFrame:
    """One row per token occurrence: key, pos (after stop-word removal), token."""
    return df.select(key, F.posexplode(search_tokens(F.col(text), stop_words)).alias("pos", "token"))


def token_windows(df: DataFrame, width: int, key: str = "bio_id", text: str = "text") -> DataFrame:
    """Consecutive windows of at most ``width`` tokens, cut from the original text."""
    if width <= 0:
        raise ValueError("width must be positive")
    pieces = df.select(key, find_all(F.col(text), PIECE).alias("_p"))
    indexed = pieces.withColumn(
        "_t", F.filter(F.transform("_p", lambda p, i: F.when(F.length(strip(p)) > 0, i + 1)), lambda i: i.isNotNull())
    ).where(F.size("_t") > 0)
    starts = indexed.select(key, "_p", "_t", F.explode(F.expr(f"sequence(0, (size(_t) - 1) DIV {width})")).alias("win"))
    first = F.get("_t", (F.col("win") * width).cast("int"))
    last = F.get("_t", F.least((F.col("win") + 1) * width, F.size("_t")).cast("int") - 1)
    return starts.select(key, F.col("win").cast("bigint").alias("win"), F.array_join(F.slice("_p", first, last - first + 1), "").alias("window_text"))


def split_sentences(df: DataFrame, key: str = "bio_id", text: str = "text") -> DataFrame:
    """Sentences with character and token offsets in the whole text.

    A sentence ends at . ! or ? followed by whitespace. Offsets are running sums over the
    sentences of one text, which already was a single row.
    """
    sep = r"(?<=[.!?])\s+"
    parts = df.select(
        key, F.split(F.col(text), sep).alias("_s"), F.transform(find_all(F.col(text), sep), lambda x: F.length(x)).alias("_g")
    ).select(key, F.posexplode(F.arrays_zip("_s", "_g")).alias("sent", "_z"))
    before = W.partitionBy(key).orderBy("sent").rowsBetween(W.unboundedPreceding, -1)
    return (
        parts.select(
            key, F.col("sent").cast("bigint").alias("sent"), F.col("_z._s").alias("sentence"), F.coalesce("_z._g", F.lit(0)).alias("_gap"),
            F.size(find_all(F.col("_z._s"), WORD_OR_MARK)).cast("bigint").alias("n_tokens"),
        )
        .withColumn("start_char", F.coalesce(F.sum(F.length("sentence") + F.col("_gap")).over(before), F.lit(0)))
        .withColumn("start_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
        .where(F.col("n_tokens") > 0)
        .select(key, "sent", "sentence", "start_char", (F.col("start_char") + F.length("sentence")).alias("end_char"), "start_token", "n_tokens")
    )


def candidate_phrases(
    df: DataFrame, key: str = "bio_id", text: str = "text", stop_words=STOP_WORDS, generic=GENERIC_NOUNS, min_chars: int = 2,
    max_chars: int | None = None,
) -> DataFrame:
    """Maximal runs of content words between stop words, punctuation, numbers and placeholders.

    Runs headed (last word) by a generic noun and too short or too long ones are dropped; pass
    ``generic=()`` for the unfiltered variant.
    """
    pattern = r"<[A-Z_]+>|" + WORD_OR_MARK
    toks = df.select(key, find_all(F.col(text), pattern).alias("_t"))
    stops = sorted(stop_words)
    flagged = toks.withColumn(
        "_f", F.transform("_t", lambda t: t.rlike(r"^[\p{L}_]") & ~F.lower(t).isin(stops))
    )
    spans = flagged.select(key, "_t", F.explode(runs(F.col("_f"))).alias("s")).select(
        key, F.col("s.start").alias("start"), F.col("s.end").alias("end"),
        F.expr("array_join(slice(_t, s.start + 1, s.end - s.start), ' ')").alias("text"),
        F.expr("lower(get(_t, s.end - 1))").alias("_head"),
    ).where(F.length("text") >= min_chars)
    if generic:
        spans = spans.where(~F.col("_head").isin(sorted(generic)))
    if max_chars is not None:
        spans = spans.where(F.length("text") <= max_chars)
    return spans.select(key, "start", "end", "text", F.lit("knowledge").alias("label"), F.lit("noun_chunk").alias("source"))

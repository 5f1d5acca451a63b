"""Benchmark decontamination by spaced-seed hashing; DataFrame functions only.

A seed hashes the words at the kept positions of a fixed mask; what stands at the ignored ones does
not matter, so a seed still hits when a word there was replaced. The seeds of all positions of the
documents are joined to those of the benchmark. A hit puts document and item on a diagonal; around
the hits of a diagonal the words themselves are compared in place, and a document is contaminated
where, in some window of ``WINDOW`` words (or the item, if shorter), at least ``SHARE`` of the words
agree.

Every window that counts as contaminated gets a hit: the masks are chosen by the window's size, and
for each size they meet all ways to place the substitutions that ``SHARE`` allows (``least_agreeing``;
the tests try all of them). Masks begin and end with a kept word, so this also holds where a document
begins or ends inside the window. Items of up to three words flag only where all their words agree.

Null and empty texts are clean. Repeated rows get equal verdicts; rows are told apart by id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from ..sources.storage import Scratch
from .columns import restored, shielded

WINDOW = 13
SHARE = 0.75
#: Kept (1) and ignored (0) word positions of the seeds, by the size of the window: that of the item, ``WINDOW`` at most.
MASKS = {
    13: ("111011", "110111", "1100001011"), 12: ("111011", "110111", "11001011", "110100011"), 11: ("1101011", "1110011"), 10: ("111011", "11111", "11010011"),
    9: ("11101", "100111"), 8: ("11011", "1111", "1100011"), 7: ("11011",), 6: ("11101", "10111"), 5: ("1101", "111"), 4: ("111", "1011", "1101"), 3: ("111",), 2: ("11",), 1: ("1",),
}
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20  # a table is broadcast if it has at most so many rows, and so many bytes in its arrays


def words(text: Column) -> Column:
    """Lower-cased words of a text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def least_agreeing(width: int) -> int:
    """Words that agree at least in a contaminated window of ``width`` words."""
    return next(n for n in range(width + 1) if n / width >= SHARE)


def width_of(words: Column) -> Column:
    """Words of the window in which an item is judged."""
    return F.least(F.lit(WINDOW), F.size(words))


def _seed_array(h: Column, mask: str) -> Column:
    """The seed at every position of ``h``; null where the mask does not fit."""
    kept = [i for i, c in enumerate(mask) if c == "1"]
    n, short = F.size(h), F.least(F.size(h), F.lit(kept[-1]))
    made = F.transform(F.slice(h, F.lit(1), n - short), lambda _, i: F.xxhash64(*[F.get(h, i + k) for k in kept], F.lit(mask)))
    return F.concat(made, F.array_repeat(F.lit(None).cast("long"), short))


def seeds(table: DataFrame, keys: list[str], widths: list[int], own: bool = False) -> DataFrame:
    """``keys, seed, at``: seeds of the masks of ``widths`` at every position of the column ``words``;
    ``own``: only those for the window of the row itself."""
    masks = list(dict.fromkeys(m for w in widths for m in MASKS[w]))
    hashed = table.select(*keys, width_of(F.col("words")).alias("width"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    blank = F.array_repeat(F.lit(None).cast("long"), F.size("h"))
    arrays = [_seed_array(F.col("h"), m) for m in masks]
    if own:
        arrays = [F.when(F.col("width").isin([w for w in widths if m in MASKS[w]]), x).otherwise(blank) for m, x in zip(masks, arrays)]
    both = hashed.select(*keys, F.size("h").alias("n"), F.concat(*arrays).alias("s"))
    # the outer form: for the inner one the optimizer would filter on the size of the whole chain, unfolded, before it
    rows = both.select(*keys, F.greatest("n", F.lit(1)).alias("n"), F.posexplode_outer("s").alias("at", "seed"))
    return rows.where("seed is not null").select(*keys, (F.col("at") % F.col("n")).cast("int").alias("at"), "seed")


def bounded(table: DataFrame) -> DataFrame:
    """``table`` marked for broadcasting if it is measured to be small; else as it is, for a shuffled join.

    Arrays are measured by their bytes, all other columns have a fixed width.
    """
    wide = [F.coalesce(F.length(F.to_json(f.name)), F.lit(0)) for f in table.schema if isinstance(f.dataType, ArrayType)]
    size = table.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(sum(wide, F.lit(0)).cast("long")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(table) if size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES else table


def _agreement() -> Column:
    """1 or 0 for each pair of words on the diagonal ``d``: whether they agree."""
    low, high = F.greatest(F.lit(0), -F.col("d")), F.least(F.size("item_words"), F.size("words") - F.col("d"))
    n = F.greatest(high - low, F.lit(0))
    return F.zip_with(
        F.slice("item_words", (low + 1).cast("int"), n.cast("int")), F.slice("words", (low + F.col("d") + 1).cast("int"), n.cast("int")), lambda a, b: F.when(a == b, 1).otherwise(0)
    )


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k1, k2, item_id, d, best``: verified diagonals of rows of ``docs``; k1, k2 tell rows apart."""
    work = Scratch(docs.sparkSession, "seeds")
    keyed = docs.select(*row_keys(id_col, text_col), words(F.col(text_col)).alias("words"))
    listed = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("words")).distinct()
    widths = sorted(r.width for r in listed.select(width_of(F.col("words")).alias("width")).where("width > 0").distinct().collect()) or [WINDOW]
    index = work.write(seeds(listed, ["item_id"], widths, own=True).withColumnRenamed("at", "item_at"), "index")
    hits = seeds(keyed, ["k1", "k2"], widths).join(bounded(index), "seed")
    lines = work.write(hits.select("k1", "k2", "item_id", (F.col("at") - F.col("item_at")).alias("d")).distinct(), "lines")
    rows = bounded(lines.select("k1", "k2").distinct())
    hit_texts = docs.select(*row_keys(id_col, text_col), F.col(text_col).alias("text")).join(rows, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    hit_words = work.write(hit_texts.select("k1", "k2", words(F.col("text")).alias("words")), "words")
    side = hit_words.join(lines, ["k1", "k2"]).join(bounded(listed.withColumnRenamed("words", "item_words")), "item_id")
    compared = side.select("k1", "k2", "item_id", "d", width_of(F.col("item_words")).alias("width"), _agreement().alias("same"))
    in_window = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("same") - F.col("width") + 1, F.lit(1))),
        lambda i: F.aggregate(F.slice(F.col("same"), i, F.col("width")), F.lit(0), lambda a, x: a + x),
    )
    scored = compared.where(F.size("same") > 0).select("k1", "k2", "item_id", "d", (F.array_max(in_window) / F.col("width")).alias("best"))
    return work.write(scored.where(F.col("best") >= SHARE), "found")


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits that tell rows apart by id and text."""
    return [F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(text_col, F.lit("seeds"), id_col).alias("k2")]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus ``contaminated``, ``bench_items`` (ids, sorted) and ``bench_share``.

    Other columns may have any name; one that is named like a result is replaced by it.
    """
    needed = (id_col, text_col)
    return restored(_contamination(shielded(docs, needed), items, *needed), docs, needed, ("contaminated", "bench_items", "bench_share"))


def uncontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a passage of the benchmark, all columns as they are."""
    needed = (id_col, text_col)
    return restored(_contamination(shielded(docs, needed), items, *needed).where("not contaminated"), docs, needed)


def _contamination(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    found = overlaps(docs, items, id_col, text_col).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("bench_items"), F.max("best").alias("bench_share"))
    k1, k2 = row_keys(id_col, text_col)
    out = docs.select("*", k1.alias("_k1"), k2.alias("_k2")).join(bounded(found), F.expr("_k1 = k1 and _k2 = k2"), "left")
    return out.select(
        *docs.columns, F.col("bench_items").isNotNull().alias("contaminated"),
        F.coalesce("bench_items", F.array().cast("array<long>")).alias("bench_items"), F.coalesce("bench_share", F.lit(0.0)).alias("bench_share"),
    )


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, contaminated, n_items, bench_items, bench_share``."""
    out = contamination(docs.select("doc_id", "text"), items)
    return out.select("doc_id", "contaminated", F.size("bench_items").cast("long").alias("n_items"), "bench_items", "bench_share")

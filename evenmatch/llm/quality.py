"""Quality of documents by regularised quadratic discriminant analysis.

Each text becomes a few transformed statistics. The labelled rows give a mean and a covariance per
class, summed on the executors; the covariances are shrunk towards their diagonal, factored once
(Cholesky), and every document is scored by the difference of the two log densities, that is by
Mahalanobis distances in the factored form, with built-in column arithmetic.

A null or empty text has well-defined statistics (all zero) and is scored like any other. Labels
with a null id or quality are left out; a repeated label counts once, and if it says both things,
not at all. Where one class has fewer than two rows, every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.storage import Scratch
from .columns import restored, shielded
from .words import SPACES, hashed_words, shingles, text_bytes

STATS = ("size", "word_length", "upper", "symbols", "digits", "stutter", "repeats", "single", "line", "stops")
PAD = 12  # words of ordinary text by which shares are padded, so that a few words say little
SHRINK = 0.1  # weight of the diagonal in a class covariance
FLOOR = 1e-3  # least variance of a statistic
HELD_OUT = 2  # remainder by 4 of the crc32 of ids whose labels are never learned
ACCEPT = 0.7

_CLASS = np.zeros(256, np.int64)  # 1 upper case, 2 digit, 3 sentence mark, 4 other ASCII sign, 5 line end, 6 blank, 7 end of sentence; else 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[x for x in range(33, 127) if not chr(x).isalnum()]] = 4
_CLASS[[ord(c) for c in ",'-\"()"]] = 3
_CLASS[10] = 5
_CLASS[[32, 9, 11, 12, 13]] = 6
_CLASS[ord(".")] = 7


def _statistics(batches):
    for batch in batches:
        data, at = text_bytes(batch.column("text"))
        for row, to, words, first in hashed_words(batch.column("text"), SPACES):
            n, cut = to - row, at[row : to + 1] - at[row]
            owner = np.repeat(np.arange(n), np.diff(cut))
            kinds = np.bincount(owner * 8 + _CLASS[data[at[row] : at[to]]], minlength=8 * n).reshape(n, 8).astype(float)
            count, size = np.diff(first).astype(float), np.diff(cut).astype(float)
            solid = np.maximum(size - kinds[:, 6] - kinds[:, 5], 1)
            same = np.zeros(len(words), bool)
            same[1:] = words[1:] == words[:-1]
            same[first[:-1][np.diff(first) > 0]] = False
            stutter = np.add.reduceat(np.append(same, False), first[:-1]) * (count > 0)
            distinct = np.diff(shingles(words, first, 5)[1])
            runs = np.maximum(count - 4, np.minimum(count, 1))
            single = np.diff(shingles(words, first, 1)[1])
            share = lambda x, of, pad: np.sqrt(np.clip(x / (of + pad), 0, 1))
            columns = (
                np.log1p(count), np.log((solid * (count > 0) + 5 * PAD) / (count + PAD)), share(kinds[:, 1], solid, 5 * PAD), share(kinds[:, 4], solid, 5 * PAD),
                share(kinds[:, 2], solid, 5 * PAD), share(stutter, count, PAD), share(runs - distinct, runs, PAD), np.log((single + PAD) / (count + PAD)),
                np.log1p(count / (1 + kinds[:, 5])), share(kinds[:, 7] + PAD / 10, count, PAD),
            )
            ids = batch.column("doc_id").slice(row, n)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.nan_to_num(c)) for c in columns]], names=["doc_id", *STATS])


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of every row."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{s} double" for s in STATS)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_statistics, schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of ``ACCEPT`` at least, all columns as they are.

    Where there are too few labels to learn from, every row stays. The statistics are taken twice,
    for the fit and beside the rows, which is cheaper than moving the texts to join the scores.
    """
    model, needed = fit(statistics(docs), labels), ("doc_id", "text")
    if model is None:
        return docs
    inner = shielded(docs, needed)

    def beside(batches):
        for batch in batches:
            parts = pa.Table.from_batches(_statistics([batch]))
            table = pa.Table.from_batches([batch])
            for name in STATS:
                table = table.append_column(f"_{name}", parts.column(name) if len(batch) else pa.array([], pa.float64()))
            yield from table.to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema)
    both = inner.mapInArrow(beside, fields + ", " + ", ".join(f"_{s} double" for s in STATS))
    return restored(both.where(log_odds(model, "_") >= float(np.log(ACCEPT / (1 - ACCEPT)))), docs, needed)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the labels of an id are never learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame) -> list | None:
    """``[(log prior and normaliser, mean, inverse Cholesky factor)]`` of the classes 0 and 1."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    known = known.where((F.col("quality") == F.col("most")) & ~held_out()).drop("most")
    pairs = [(a, b) for i, a in enumerate(STATS) for b in STATS[i:]]
    sums = stats.join(known, "doc_id").groupBy("quality").agg(
        F.count("*").alias("n"), *[F.sum(a).alias(a) for a in STATS], *[F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs]
    )
    rows = {int(r["quality"]): r for r in sums.collect()}  # one row per class
    if any(rows.get(c) is None or rows[c]["n"] < 2 for c in (0, 1)):
        return None
    model, total = [], sum(rows[c]["n"] for c in (0, 1))
    for c in (0, 1):
        row, n = rows[c], rows[c]["n"]
        mean = np.array([row[a] for a in STATS]) / n
        cov = np.zeros((len(STATS), len(STATS)))
        for a, b in pairs:
            i, j = STATS.index(a), STATS.index(b)
            cov[i, j] = cov[j, i] = row[f"{a}*{b}"] / n - mean[i] * mean[j]
        cov = (1 - SHRINK) * cov + SHRINK * np.diag(np.diag(cov)) + FLOOR * np.eye(len(STATS))
        factor = np.linalg.cholesky(cov)
        model.append((float(np.log(n / total) - np.log(np.diag(factor)).sum()), mean, np.linalg.inv(factor)))
    return model


def log_odds(model: list, prefix: str = "") -> Column:
    """Log density of class 1 minus that of class 0, from the statistics columns."""
    parts = []
    for constant, mean, inverse in model:
        centred = [F.col(prefix + s) - F.lit(float(m)) for s, m in zip(STATS, mean, strict=True)]
        distance = F.lit(0.0)
        for i in range(len(STATS)):
            line = F.lit(0.0)
            for j in range(i + 1):
                line = line + F.lit(float(inverse[i, j])) * centred[j]
            distance = distance + line * line
        parts.append(F.lit(constant) - distance / 2)
    return parts[1] - parts[0]


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    stats = Scratch(docs.sparkSession, "quality").write(statistics(docs), "stats")
    model = fit(stats, labels)
    score = F.lit(0.5) if model is None else F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.greatest(-log_odds(model), F.lit(-700.0)), F.lit(700.0))))
    scored = stats.select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))

"""Span-level evaluation: exact and partial counts, precision/recall/F1, error lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .annotation import GROUP_LIMIT
from .spans import BIN

VIEWS = {"all": (None, None), "skill": (("skill", "verb_phrase"), ("skill",)), "knowledge": (("knowledge",), ("knowledge",))}


def exact_hits(pred: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct boundaries found on both sides."""
    b = [*keys, "start", "end"]
    return pred.select(*b).distinct().join(gold.select(*b).distinct(), b, "left_semi")


def span_exact_counts(pred: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: distinct predicted, gold and identical boundaries."""
    b = [key, "start", "end"]
    side = pred.select(*b).distinct().withColumn("p", F.lit(1)).join(gold.select(*b).distinct().withColumn("g", F.lit(1)), b, "full_outer")
    return side.groupBy(key).agg(F.count("p").alias("n_pred"), F.count("g").alias("n_gold"), F.count(F.col("p") + F.col("g")).alias("n_hit"))


def swept(pred: DataFrame, gold: DataFrame, ids: list[str]) -> DataFrame:
    """Distinct boundaries of both sides with ``p``, ``g`` (which side has them) and ``touches_g``, ``touches_p``.

    One sweep over the union, ordered by start: a span overlaps one of the other side if the greatest
    end of those that start no later lies behind its start, or if the next of them starts before its
    end. The latter is swept from the last start backwards, since a frame that ends with the text is
    summed up anew for every row. Everything is keyed by ``ids``, so the rows are shuffled once.
    """
    b = [*ids, "start", "end"]
    side = lambda d, p: d.select(*b, F.lit(p).alias("p"), F.lit(1 - p).alias("g"))
    rows = side(pred, 1).unionByName(side(gold, 0)).repartition(*ids).groupBy(*b).agg(F.max("p").alias("p"), F.max("g").alias("g"))
    upto = W.partitionBy(*ids).orderBy("start").rangeBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*ids).orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, -1)

    def touches(c: str) -> Column:
        reach = F.max(F.when(F.col(c) == 1, F.col("end"))).over(upto)
        nearest = F.min(F.when(F.col(c) == 1, F.col("start"))).over(after)
        return F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(nearest < F.col("end"), F.lit(False))

    return rows.withColumns({"touches_g": touches("g"), "touches_p": touches("p")})


def _counts() -> list[Column]:
    n = lambda c, name: F.count_if(c).alias(name)
    p, g = F.col("p") == 1, F.col("g") == 1
    return [n(p, "n_pred"), n(g, "n_gold"), n(p & g, "exact"), n(p & F.col("touches_g"), "pred_hit"), n(g & F.col("touches_p"), "gold_hit")]


def span_partial_counts(pred: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document with any overlap: predicted spans that overlap gold, and gold spans that are overlapped."""
    counts = swept(pred, gold, [key]).groupBy(key).agg(*_counts())
    return counts.where("pred_hit > 0").select(key, F.col("pred_hit").alias("n_pred_correct"), F.col("gold_hit").alias("n_gold_found"))


def _view(spans: DataFrame, side: int) -> DataFrame:
    """One copy of a span per view it belongs to."""
    names = [F.when(F.lit(True) if v[side] is None else F.col("label").isin(list(v[side])), n) for n, v in VIEWS.items()]
    return spans.select("*", F.explode(F.array_compact(F.array(*names))).alias("view"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def span_prf(pred: DataFrame, gold: DataFrame, key: str = "doc_id", group: str = "source") -> DataFrame:
    """Micro precision, recall and F1 per (group or 'all', view, mode)."""
    ids = [key, group, "view"]
    each = swept(_view(pred, 0), _view(gold, 1), ids).groupBy(group, "view").agg(*_counts())
    kinds = ("n_pred", "n_gold", "exact", "pred_hit", "gold_hit")
    counts = each.withColumn("group", F.explode(F.array(F.lit("all"), F.col(group)))).groupBy("group", "view").agg(*[F.sum(k).alias(k) for k in kinds])
    modes = counts.select("group", "view", "n_pred", "n_gold", F.explode(F.array(
        F.struct(F.lit("exact").alias("mode"), F.col("exact").alias("pc"), F.col("exact").alias("gf")),
        F.struct(F.lit("partial").alias("mode"), F.col("pred_hit").alias("pc"), F.col("gold_hit").alias("gf")))).alias("m"))
    prec, rec = _ratio(F.col("m.pc"), F.col("n_pred")), _ratio(F.col("m.gf"), F.col("n_gold"))
    return modes.select("group", "view", F.col("m.mode").alias("mode"), prec.alias("precision"), rec.alias("recall"),
                        _ratio(2 * prec * rec, prec + rec).alias("f1"), "n_pred", "n_gold")


def span_errors(pred: DataFrame, gold: DataFrame, top: int = 40, key: str = "doc_id") -> DataFrame:
    """Most frequent false positives, boundary errors and missed gold spans: (kind, text, n).

    Spans and their texts are shuffled once, by document. They meet inside the row of a (document,
    position bin); a span of several bins is put together again without leaving its task.
    """
    side = lambda d, p: d.select(key, "start", "end", "text", F.lit(p).alias("p"))
    rows = side(pred, True).unionByName(side(gold, False)).repartition(key)
    bins = F.when(F.col(key).isNotNull(), F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN)))
    span, bin_ = F.struct("start", "end", "text"), F.col("_bin")
    met = rows.withColumn("_bin", F.explode_outer(bins)).groupBy(key, "_bin").agg(
        F.sort_array(F.collect_list(F.when(F.col("p"), span))).alias("_p"), F.sort_array(F.collect_list(F.when(~F.col("p"), span))).alias("_g"))
    same = lambda x, y: (x["start"] == y["start"]) & (x["end"] == y["end"])
    # a pair that shares several bins meets in the first of them; spans without a bin meet none
    meet = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"]) & (bin_ == F.floor(F.greatest(x["start"], y["start"]) / BIN))
    once = F.filter("_p", lambda x, i: ~F.coalesce((i > 0) & same(x, F.get("_p", i - 1)), F.lit(False)))
    met = met.withColumn("_d", once)
    yes = lambda c: F.coalesce(c, F.lit(False))

    def found(x, p, touched, exact, by):
        home = bin_.isNull() | (bin_ == F.floor(x["start"] / BIN))
        return F.struct(F.lit(p).alias("p"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), home.cast("bigint").alias("n"),
                        yes(touched).alias("touched"), yes(exact).alias("exact"), by.alias("by"))

    none = F.array().cast(met.schema["_p"].dataType)
    preds = F.transform("_p", lambda x: found(x, True, F.exists("_g", lambda y: meet(x, y)), F.lit(False), none))
    golds = F.transform("_g", lambda y: found(
        y, False, F.exists("_d", lambda x: meet(x, y)), bin_.isNotNull() & F.exists("_d", lambda x: same(x, y)), F.filter("_d", lambda x: meet(x, y))))
    each = met.select(key, F.explode_outer(F.concat(preds, golds)).alias("x")).select(key, "x.*").groupBy(key, "p", "start", "end", "text").agg(
        F.sum("n").alias("n"), F.max("touched").alias("touched"), F.max("exact").alias("exact"), F.array_distinct(F.flatten(F.collect_list("by"))).alias("by"))
    kind = F.when(F.col("p"), F.when(~F.col("touched"), "false_positive")).when(~F.col("exact"), F.when(F.col("touched"), "boundary").otherwise("missed"))
    texts = F.concat("text", F.lit("  ->  "), F.array_join(F.transform(F.sort_array("by"), lambda x: x["text"]), " | "))
    errors = each.select(kind.alias("kind"), F.when(~F.col("p") & F.col("touched"), texts).otherwise(F.lower("text")).alias("text"), "n")
    counts = errors.where("kind IS NOT NULL").groupBy("kind", "text").agg(F.sum("n").alias("n"))
    if top <= GROUP_LIMIT:  # each task keeps the first rows of a kind
        r = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), "text"))
        return counts.withColumn("_r", r).where(F.col("_r") <= top).drop("_r")
    tops = [counts.where(F.col("kind") == k).orderBy(F.desc("n"), "text").limit(top) for k in ("false_positive", "boundary", "missed")]
    return tops[0].unionByName(tops[1]).unionByName(tops[2])


def unannotated_share(pred: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """Predictions, and those in documents without any gold span."""
    has = gold.select(key).distinct().withColumn("g", F.lit(1))
    return pred.join(has, key, "left").agg(F.count(F.lit(1)).alias("n_pred"), F.count_if(F.col("g").isNull()).alias("n_unannotated"))


def span_examples(pred: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """Gold and predicted texts of each document side by side."""
    text = lambda d, n: d.groupBy(key).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("start", "end", "label", "text"))), lambda x: F.concat(F.lit("["), x["text"], F.lit("]/"), F.upper(F.substring(x["label"], 1, 1)))), ", ").alias(n))
    return text(gold, "gold").join(text(pred, "pred"), key, "full_outer").na.fill("-", ["gold", "pred"])

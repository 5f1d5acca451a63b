"""Near-miss suggestions: best concept matches, taxonomy relations and similarity bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import rows
from ..sources.storage import written
from .entities import best_matches, entity_bags, joined_bags
from .resampling import bootstrap_ratio_ci


def concept_bags(entities: DataFrame, key: str, concept: str = "concept", pos: str = "pos", vec: str = "embedding") -> DataFrame:
    """One entity per concept of a document: its first mention."""
    first = entities.where(F.col(concept).isNotNull()).groupBy(key, concept).agg(F.min(F.struct(pos, vec)).alias("m"))
    return entity_bags(first.select(key, concept, F.col("m")[pos].alias("pos"), F.col("m")[vec].alias("vec")), key, ent=concept, vec="vec")


def best_concept_match(pairs: DataFrame, jd_bags: DataFrame, bio_bags: DataFrame) -> DataFrame:
    """One row per (pair, target concept) with the best bio concept; pairs with an empty side drop out."""
    best = best_matches(joined_bags(pairs, jd_bags, bio_bags))
    return best.select("jd_id", "bio_id", rows("best").alias("b")).select(
        "jd_id", "bio_id", F.col("b.jd_ent").alias("jd_concept"), F.col("b.bio_ent").alias("bio_concept"), F.col("b.sim").alias("sim"))


def concept_related(matches: DataFrame, edges: DataFrame, a: str = "jd_concept", b: str = "bio_concept") -> DataFrame:
    """Add ``strict`` (same, or direct parent or child) and ``lenient`` (or a shared direct parent).

    Relations are looked up for the distinct concept pairs only. A parent list is bounded by the
    taxonomy, so siblings are an array intersection of the two lists.
    """
    matches = written(matches, "matches")
    parents = edges.groupBy(F.col("conceptUri").alias("_c")).agg(F.collect_set("broaderUri").alias("_p"))
    none = F.array().cast("array<string>")
    d = (
        matches.select(a, b).distinct()
        .join(parents.withColumnsRenamed({"_c": a, "_p": "_pa"}), a, "left").join(parents.withColumnsRenamed({"_c": b, "_p": "_pb"}), b, "left")
        .withColumns({"_pa": F.coalesce("_pa", none), "_pb": F.coalesce("_pb", none)})
    )
    strict = (F.col(a) == F.col(b)) | F.array_contains("_pa", F.col(b)) | F.array_contains("_pb", F.col(a))
    flags = d.select(a, b, strict.alias("strict"), (strict | F.arrays_overlap("_pa", "_pb")).alias("lenient"))
    return matches.join(flags, [a, b])


def grid(start: float, stop: float, step: float) -> list[float]:
    n = int((stop + step / 2 - start) / step + 1e-9)
    return [round(start + i * step, 4) for i in range(n + 1) if start + i * step < stop + step / 2]


def band_grid(matches: DataFrame, los: list[float], his: list[float], by: list[str] = ()) -> DataFrame:
    """Per band lo <= sim < hi (hi > lo): suggestions, precisions and suggestions per pair.

    Rows are first counted per interval between neighbouring bounds; bands add up those counts.
    """
    by = list(by)
    bounds = sorted({*los, *his})
    at = {v: i + 1 for i, v in enumerate(bounds)}  # number of bounds <= v
    bands = [(lo, hi, at[lo], at[hi]) for lo in los for hi in his if hi > lo]
    cell = F.size(F.filter(F.array(*[F.lit(float(v)) for v in bounds]), lambda v: v <= F.col("sim")))
    counts = matches.groupBy(*by, cell.alias("_cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("strict").cast("int")).alias("s"), F.sum(F.col("lenient").cast("int")).alias("l"))
    n_pairs = matches.select(*by, "jd_id", "bio_id").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"))
    table = F.array(*[F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.lit(a).alias("a"), F.lit(b).alias("b")) for lo, hi, a, b in bands])
    # every band appears for every group, with zero counts where it is empty
    frame = n_pairs.select(*by, "n_pairs", F.explode(table).alias("x")).select(*by, "n_pairs", "x.lo", "x.hi")
    hits = counts.select(*by, "n", "s", "l", F.explode(F.filter(table, lambda x: (F.col("_cell") >= x["a"]) & (F.col("_cell") < x["b"]))).alias("x"))
    sums = hits.groupBy(*by, "x.lo", "x.hi").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("l").alias("l"))
    return frame.join(sums, [*by, "lo", "hi"], "left").select(
        *by, "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), (F.col("s") / F.col("n")).alias("strict"), (F.col("l") / F.col("n")).alias("lenient"),
        (F.coalesce("n", F.lit(0)) / F.col("n_pairs")).alias("per_pair"))


def band_ci(matches: DataFrame, bands: list[tuple[float, float]], by: list[str] = (), n_boot: int = 1000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Interval of the strict and lenient precision of each band, targets resampled as clusters."""
    by = list(by)
    table = F.array(*[F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for lo, hi in bands])
    d = matches.select(*by, "jd_id", "strict", "lenient", F.explode(F.filter(table, lambda x: (F.col("sim") >= x["lo"]) & (F.col("sim") < x["hi"]))).alias("x"))
    both = F.array(F.struct(F.lit("strict").alias("k"), F.col("strict").cast("double").alias("v")), F.struct(F.lit("lenient").alias("k"), F.col("lenient").cast("double").alias("v")))
    long = d.select(*by, "jd_id", "x.lo", "x.hi", F.explode(both).alias("y"))
    series = [*by, "lo", "hi", "kind"]
    clusters = long.groupBy(*by, "lo", "hi", F.col("y.k").alias("kind"), "jd_id").agg(F.sum("y.v").alias("num"), F.count(F.lit(1)).cast("double").alias("den"))
    return bootstrap_ratio_ci(clusters, series, "jd_id", ["num", "den"], "num / den", n_boot, alpha, seed)


def choose_band(bands: DataFrame, min_n: int, select_on: str = "lenient") -> DataFrame:
    """The most precise band with enough suggestions; more suggestions, then lower bounds, break ties."""
    return bands.where(F.col("n") >= min_n).orderBy(F.desc(select_on), F.desc("n"), "lo", "hi").limit(1)


def suggestions(matches: DataFrame, lo: float, hi: float) -> DataFrame:
    """Suggestions of each pair inside the band, most similar first (``rank``)."""
    item = F.struct((-F.col("sim")).alias("neg"), F.col("jd_concept"), F.col("bio_concept"))
    d = matches.where((F.col("sim") >= lo) & (F.col("sim") < hi)).groupBy("jd_id", "bio_id").agg(F.sort_array(F.collect_list(item)).alias("_l"))
    return d.select("jd_id", "bio_id", F.posexplode("_l").alias("p", "x")).select(
        "jd_id", "bio_id", (F.col("p") + 1).cast("bigint").alias("rank"), "x.jd_concept", "x.bio_concept", (-F.col("x.neg")).alias("sim"))


def base_rates(matches: DataFrame, by: list[str] = ()) -> DataFrame:
    return matches.groupBy(*by).agg(
        F.avg(F.col("strict").cast("int")).alias("strict"), F.avg(F.col("lenient").cast("int")).alias("lenient"), F.count(F.lit(1)).alias("n"))

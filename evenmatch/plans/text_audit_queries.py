"""One audit from texts to metrics: pools, seven rewrites, changed-only scores, metrics per pool."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators import fairness as H, resampling as J, rewrite as G
from ..sources.storage import written
from .audit_queries import r6
from .catalog import query
from .entity_queries import entity_scorer
from .rewrite_queries import ORIENTATION, cf_texts, rewrites
from .score_queries import lexical_scorers


def scorers(t) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The lexical scorers and the entity scorer, each fitted once."""
    return lexical_scorers(t) | {"entity": entity_scorer(t, "idf_weighted").score}

def audited(t, by: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Every pooled pair once per scorer and condition, with the score of its original and of its rewrite."""
    pool = t.pools()
    table = written(H.build_pair_table(pool, rewrites(t, pool), list(G.CONDITIONS), ORIENTATION), "pairs")
    scores = written(H.score_changed_by(table, cf_texts(t), t.jds(), by).drop("pert_text"), "text-scores")
    key = ["scorer", "jd_id", "bio_id"]
    first = scores.where("condition = 'original'").select(*key, "score", "nonempty")
    after = scores.where("condition <> 'original'").select(*key, "condition", "sign", "changed", F.col("score").alias("pert_score"), F.col("nonempty").alias("pert_nonempty"))
    facts = pool.join(t.jds().select("jd_id", F.col("pool_set").alias("split")), "jd_id").select("jd_id", "bio_id", "bio_gender", "rel_binary", "rel_graded", "split")
    return after.join(first, key).join(facts, ["jd_id", "bio_id"])


def metrics(rows: DataFrame) -> DataFrame:
    """All metrics of each pool and condition."""
    flags = rows.withColumn("changed", F.col("changed").cast("int"))
    return H.per_pool_metrics(flags, one_condition="pronoun_swap")


@query("text_audit_scores")
def _(t):
    d = audited(t, scorers(t))
    return d.select("scorer", "jd_id", "bio_id", "condition", "sign", "changed", "rel_binary", "rel_graded", r6("score"), r6("pert_score"))


@query("text_audit_metrics")
def _(t):
    rows = written(audited(t, scorers(t)), "audited")
    d = J.summarise_metrics(written(metrics(rows), "text-metrics"), n_boot=200, seed=3)
    return d.select("scorer", "split", "condition", "metric", r6("value"), "n_units", r6("ci_low"), r6("ci_high"))

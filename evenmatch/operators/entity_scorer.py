"""The entity scorer from text to score: extract, keep distinct entities, embed strings, compare bags.

Three stores make up its state, all keyed by content: bags of entity keys by the hash of the text,
vectors by the entity string, and the weights fitted on the target texts. A batch extracts only texts
and embeds only strings that no earlier batch had; the texts of earlier batches are never read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import entities as E
from .dense import embed_texts
from .stores import ResultStore

AGGREGATIONS = ("maxsim_mean", "idf_weighted", "one_to_one", "threshold_fraction")


def kept_entities(spans: DataFrame, key: str, labels: tuple[str, ...] | None = ("skill", "knowledge"), sources: tuple[str, ...] | None = None, casefold: bool = True) -> DataFrame:
    """(key, ent_key, entity, pos): distinct entities of each text, the first surface form kept."""
    text = F.trim("text")
    ok = F.length(text) > 0
    if labels is not None:
        ok = ok & F.col("label").isin(list(labels))
    if sources is not None:
        ok = ok & F.col("source").isin(list(sources))
    named = spans.where(ok).select(key, F.when(F.lit(casefold), F.lower(text)).otherwise(text).alias("ent_key"), text.alias("entity"), F.col("start").alias("pos"), "end", "label")
    return named.groupBy(key, "ent_key").agg(F.min(F.struct("pos", "end", "label", "entity")).alias("m")).select(key, "ent_key", "m.entity", "m.pos")


class EntityScorer:
    """Scores (jd_id, text_id, resume_text) rows against the target texts it was fitted on."""

    def __init__(
        self, spark: SparkSession, extract: Callable[[DataFrame], DataFrame], aggregation: str = "maxsim_mean", threshold: float | None = None,
        labels: tuple[str, ...] | None = ("skill", "knowledge"), sources: tuple[str, ...] | None = None, casefold: bool = True,
        encoder: Callable[[DataFrame], DataFrame] | None = None,
    ):
        """``extract`` maps (text_hash, text) rows to spans: text_hash, start, end, text, label, source."""
        if aggregation not in AGGREGATIONS:
            raise ValueError(f"aggregation must be one of {AGGREGATIONS}")
        if (aggregation == "threshold_fraction") != (threshold is not None):
            raise ValueError("a threshold goes with threshold_fraction, and only with it")
        self.extract, self.aggregation, self.threshold, self.encoder = extract, aggregation, threshold, encoder
        self.keep = lambda spans: kept_entities(spans, "text_hash", labels, sources, casefold)
        self.bags = ResultStore(spark, "entity_bags", "text_hash")
        self.vectors = ResultStore(spark, "entity_vectors", "entity")
        self.targets: DataFrame | None = None
        self.weights: tuple[DataFrame, DataFrame] | None = None

    def learn(self, texts: DataFrame) -> None:
        """Put the bags of new texts (text_hash, text) and the vectors of new entity strings into the stores."""
        new = self.bags.missing(texts.dropDuplicates(["text_hash"]))
        found = self.keep(self.extract(new)).groupBy("text_hash").agg(F.sort_array(F.collect_list(F.struct("pos", "ent_key", "entity"))).alias("ents"))
        # a text without entities is known as well, as an empty bag
        empty = F.array().cast(found.schema["ents"].dataType)
        self.bags.append(new.select("text_hash").join(found, "text_hash", "left").select("text_hash", F.coalesce("ents", empty).alias("ents")))
        last = self.bags.spark.table(self.bags.table).where(F.col("version") == self.bags.versions)
        strings = self.vectors.missing(last.select(F.explode("ents.entity").alias("entity")).distinct())
        self.vectors.append(embed_texts(strings, "entity", encoder=self.encoder).select(F.col("text").alias("entity"), "vec"))

    def fit(self, jds: DataFrame) -> "EntityScorer":
        """Learn the target texts (jd_id, text) and the weights of their entities."""
        self.targets = jds.select("jd_id", F.sha2("text", 256).alias("text_hash"), "text")
        self.learn(self.targets.select("text_hash", "text"))
        long = self.bags.attach(self.targets.select("jd_id", "text_hash")).select("jd_id", F.explode("ents").alias("e")).select("jd_id", "e.ent_key")
        self.weights = E.entity_idf(long, self.targets)
        return self

    def _bag_vectors(self, owners: DataFrame, owner: str, weighted: bool = False) -> DataFrame:
        """(owner, ents) with vectors, for the owners' text hashes; a bag is put together once per text."""
        bags = self.bags.attach(owners.select("text_hash").distinct()).select("text_hash", F.explode("ents").alias("e")).select("text_hash", "e.*")
        if weighted:
            bags = E.with_entity_weights(bags, *self.weights)
        whole = E.entity_bags(bags.join(self.vectors.read(), "entity"), "text_hash", ("weight",) if weighted else (), vec="vec")
        return owners.join(whole, "text_hash").select(owner, "ents")

    def _score(self) -> Column:
        if self.aggregation == "maxsim_mean":
            return E.maxsim_mean()
        if self.aggregation == "threshold_fraction":
            return E.threshold_fraction(self.threshold)
        return E.idf_weighted_maxsim() if self.aggregation == "idf_weighted" else E.one_to_one_match()

    def _bags(self, rows: DataFrame, weighted: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(pairs, target bags, bags of the rows' texts), after learning what is new in the rows."""
        if self.targets is None:
            raise ValueError("fit the scorer on the target texts first")
        texts = rows.select("text_id", F.sha2("resume_text", 256).alias("text_hash"), F.col("resume_text").alias("text")).dropDuplicates(["text_id"])
        self.learn(texts.select("text_hash", "text"))
        jd_bags = self._bag_vectors(self.targets.select("jd_id", "text_hash"), "jd_id", weighted)
        bio_bags = self._bag_vectors(texts.select("text_id", "text_hash"), "text_id").withColumnRenamed("text_id", "bio_id")
        return rows.select("jd_id", F.col("text_id").alias("bio_id")), jd_bags, bio_bags

    def score(self, rows: DataFrame) -> DataFrame:
        """(jd_id, text_id, score, nonempty); a pair with an empty side scores 0 and is flagged."""
        weighted = self.aggregation == "idf_weighted"
        out = E.empty_policy(*self._bags(rows, weighted), self._score(), ("weight",) if weighted else ())
        return out.select("jd_id", F.col("bio_id").alias("text_id"), "score", "nonempty")

    def report(self, rows: DataFrame, top: int | None = None, order: str = "lost") -> DataFrame:
        """Requirements of each pair whose both sides have entities: weight, best match, contribution and loss."""
        best = E.best_matches(E.joined_bags(*self._bags(rows, True)), ("weight",))
        return E.requirement_report(best, top=top, order=order).withColumnRenamed("bio_id", "text_id")

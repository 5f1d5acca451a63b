"""Posting titles to classes: regex rules, review list, final mapping.

Titles repeat a lot, so rules run once per distinct title. The rules are configuration (a few
patterns per class), so they become literal ``rlike`` expressions of one narrow projection rather
than a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class TitleRule:
    name: str
    include: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    flag: tuple[str, ...] = ()
    require_description: str | None = None
    code: str | None = None


@dataclass(frozen=True)
class TitleRules:
    rules: tuple[TitleRule, ...]
    exclude_all: tuple[str, ...] = field(default=())

    def names(self) -> list[str]:
        return [r.name for r in self.rules]


def _any(col: Column, patterns) -> Column:
    # U: word boundaries and classes follow Unicode, so accented letters are part of a word
    pats = list(patterns)
    if not pats:
        return F.lit(False)
    return col.rlike("(?iU)" + "|".join(f"(?:{p})" for p in pats))


def title_counts(postings: DataFrame, title_norm: str = "title_norm", title: str = "title", key: str = "jd_id") -> DataFrame:
    return postings.groupBy(title_norm).agg(F.count(F.lit(1)).alias("n_postings"), F.min_by(title, key).alias("example_title"))


def match_titles(titles: DataFrame, rules: TitleRules, title_norm: str = "title_norm") -> DataFrame:
    """Add ``strong`` and ``weak`` class lists (in rule order) to a table of distinct titles."""
    t = F.col(title_norm)
    vetoed = _any(t, rules.exclude_all)
    strong, weak = [], []
    for r in rules.rules:
        open_ = ~_any(t, r.exclude)
        inc = _any(t, r.include)
        strong.append(F.when(open_ & inc, r.name))
        weak.append(F.when(open_ & F.when(inc, _any(t, r.flag)).otherwise(_any(t, r.weak)), r.name))
    keep = lambda cols: F.when(vetoed, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*cols)))
    return titles.withColumns({"strong": keep(strong), "weak": keep(weak)})


def title_status(matched: DataFrame) -> DataFrame:
    """auto: exactly one strong and no weak class; everything else that matched is ambiguous."""
    ns, nw = F.size("strong"), F.size("weak")
    auto = (ns == 1) & (nw == 0)
    return matched.where((ns > 0) | (nw > 0)).select(
        *[c for c in matched.columns if c not in ("strong", "weak")],
        F.when(ns == 1, F.get("strong", F.lit(0))).otherwise("").alias("auto_occupation"),
        F.array_join(F.array_distinct(F.concat("strong", "weak")), "|").alias("candidates"),
        F.when(auto, "auto").otherwise("ambiguous").alias("status"),
        F.when(auto, "")
        .when(ns == 1, F.concat(F.lit("flagged / weak match: "), F.array_join("weak", "|")))
        .when(ns > 1, "matches several occupations")
        .otherwise("weak pattern only")
        .alias("note"),
    )


def review_priority(statuses: DataFrame, class_names: list[str], needed: int) -> DataFrame:
    """Mark ambiguous titles high when a candidate class has too few auto-mapped postings."""
    filled = (
        statuses.where("status = 'auto'").groupBy("auto_occupation").agg(F.sum("n_postings").alias("n")).where(F.col("n") >= needed)
    )
    # at most one entry per class name
    enough = filled.agg(F.collect_set("auto_occupation").alias("names"))
    scarce = F.exists(
        F.split("candidates", r"\|"),
        lambda c: ~F.coalesce(F.array_contains(F.col("_enough"), c), F.lit(False)) & c.isin(class_names),
    )
    return (
        statuses.withColumn("_enough", enough.scalar())
        .withColumn(
            "review_priority",
            F.when(F.col("status") != "ambiguous", "").when(scarce, "high").otherwise("low"),
        )
        .drop("_enough")
    )


def review_order(statuses: DataFrame) -> DataFrame:
    rank = F.when(F.col("review_priority") == "high", 0).when(F.col("review_priority") == "low", 1).otherwise(2)
    return statuses.orderBy(rank, "candidates", F.desc("n_postings"), "title_norm")


def carry_reviews(new: DataFrame, old: DataFrame, title_norm: str = "title_norm") -> DataFrame:
    """Keep earlier decisions by title; blank ones do not count."""
    kept = (
        old.select(title_norm, F.expr("nullif(trim(reviewed_occupation), '')").alias("_old"))
        .where("_old IS NOT NULL")
        .groupBy(title_norm)
        .agg(F.max("_old").alias("_old"))
    )
    base = new if "reviewed_occupation" in new.columns else new.withColumn("reviewed_occupation", F.lit(""))
    return (
        base.join(kept, title_norm, "left")
        .withColumn("reviewed_occupation", F.coalesce("_old", "reviewed_occupation"))
        .drop("_old")
    )


def validate_reviews(df: DataFrame, class_names: list[str]) -> DataFrame:
    """Rows whose decision is neither a class, nor 'none', nor blank."""
    return df.where(~F.trim("reviewed_occupation").isin([*class_names, "none", ""]))


def final_mapping(df: DataFrame, title_norm: str = "title_norm") -> DataFrame:
    rev = F.trim("reviewed_occupation")
    return (
        df.select(
            title_norm,
            F.when((rev != "") & (rev != "none"), rev)
            .when((rev == "") & (F.col("status") == "auto"), F.col("auto_occupation"))
            .alias("occupation"),
        )
        .where("occupation IS NOT NULL")
    )


def description_requirement(postings: DataFrame, rules: TitleRules, text: str = "text") -> DataFrame:
    """Set ``occupation`` to NULL where its required description pattern is missing; flag the row."""
    fails = F.lit(False)
    for r in rules.rules:
        if r.require_description:
            fails = fails | ((F.col("occupation") == r.name) & ~F.col(text).rlike("(?iU)" + r.require_description))
    fails = F.coalesce(fails, F.lit(False))
    return postings.withColumn("dropped", fails).withColumn(
        "occupation", F.when(F.col("dropped"), F.lit(None)).otherwise(F.col("occupation"))
    )


def description_dropped(checked: DataFrame, original: str) -> DataFrame:
    return checked.groupBy(original).agg(F.count_if("dropped").alias("n_dropped"))

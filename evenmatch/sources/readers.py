"""Readers with explicit schemas. CSV and JSON reads fail on malformed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.checks import asserted, require_columns
from ..functions.text import n_words, normalize_title, squash
from .digests import sha256_in_rounds
from .quoted_csv import header_of, parsed, quoted_records
from .rules import CLASSES, GENDERS

#: Names of files that text readers decompress.
COMPRESSED = r"\.(gz|deflate|bz2|lz4|snappy|zstd?)$"


def read_labelled_texts(
    spark: SparkSession, path: str, classes=CLASSES, genders=GENDERS, text: str = "hard_text", row_id: str = "row_id"
) -> DataFrame:
    """Parquet partitioned by split with integer labels -> bios with decoded labels.

    Ids are ``split-row_id``: a stable key rather than a row position, which a parallel scan lacks.
    """
    raw = require_columns(spark.read.parquet(path), [text, "profession", "gender", "split", row_id], path)
    raw = asserted(raw, F.col("profession").between(0, len(classes) - 1), "profession label out of range")
    raw = asserted(raw, F.col("gender").between(0, len(genders) - 1), "gender label out of range")
    name = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), F.col(c).cast("int") + 1)
    return raw.select(
        F.concat_ws("-", "split", F.col(row_id).cast("string")).alias("bio_id"),
        F.trim(text).alias("text"),
        F.col("profession").cast("int").alias("occupation_id"),
        F.col("gender").cast("int").alias("gender_id"),
        F.col("split").cast("string").alias("split"),
        name(classes, "profession").alias("occupation"),
        name(genders, "gender").alias("gender"),
        n_words(F.col(text)).alias("n_words"),
    )


def read_csv_columns(spark: SparkSession, path: str, columns: list[str], place: str | None = None) -> DataFrame:
    """Named string columns of CSV files with quoted line breaks, read in parallel within each file.

    ``place`` adds a column that orders the rows as they stand in the files.
    """
    header = header_of(spark, path)
    clean = {c.lstrip("\ufeff"): c for c in header}
    missing = sorted(set(columns) - set(clean))
    if missing:
        raise ValueError(f"{path} lacks columns {missing}; it has {sorted(clean)}")
    rows = quoted_records(spark, path).withColumn("_r", parsed(F.col("record"), header))
    at = [F.struct("file", "block", "line").alias(place)] if place else []
    return rows.select(*[F.col(f"_r.`{clean[c]}`").alias(c) for c in columns], *at)


def postings_audit(raw: DataFrame, min_words: int) -> DataFrame:
    """Counts of raw, missing, short, duplicate and kept postings."""
    d = raw.select(
        (F.col("title").isNull() | F.col("description").isNull()).alias("na"),
        squash(F.coalesce("description", F.lit(""))).alias("text"),
    ).withColumn("short", ~F.col("na") & (n_words(F.col("text")) < min_words))
    copies = d.groupBy("na", "short", F.sha2("text", 256)).agg(F.count(F.lit(1)).alias("n"))
    good = ~F.col("na") & ~F.col("short")
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw"),
        F.coalesce(F.sum(F.when(F.col("na"), F.col("n"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(F.col("short"), F.col("n"))), F.lit(0)).alias("too_short"),
        F.coalesce(F.sum(F.when(good, F.col("n") - 1)), F.lit(0)).alias("duplicate"),
        F.coalesce(F.sum(F.when(good, 1)), F.lit(0)).alias("kept"),
    )


def clean_postings(raw: DataFrame, min_words: int = 50) -> DataFrame:
    """title/description postings -> jd_id, title, title_norm, text, n_words; first id of equal texts kept."""
    d = (
        raw.na.drop(subset=["title", "description"])
        .withColumn("text", squash(F.col("description")))
        .withColumn("n_words", n_words(F.col("text")))
        .where(F.col("n_words") >= min_words)
    )
    num = F.expr("try_cast(job_id AS bigint)")
    first = d.groupBy(F.sha2("text", 256)).agg(F.min(F.struct(num.alias("n"), F.col("job_id").alias("job_id"))).alias("m")).select("m.job_id")
    return d.join(first, "job_id", "left_semi").select(
        F.concat(F.lit("li-"), F.col("job_id")).alias("jd_id"),
        F.trim("title").alias("title"),
        normalize_title(F.col("title")).alias("title_norm"),
        "text",
        "n_words",
    )


def read_postings(spark: SparkSession, path: str, min_words: int = 50) -> DataFrame:
    return clean_postings(read_csv_columns(spark, path, ["job_id", "title", "description"]), min_words)


def read_taxonomy(
    spark: SparkSession, path: str, alternative: bool = True, hidden: bool = False, released_only: bool = True
) -> DataFrame:
    """Taxonomy CSV -> one row per distinct surface form of a concept, in file order of the forms.

    ``concept_pos`` orders concepts as they stand in the file.
    """
    cols = ["conceptUri", "skillType", "preferredLabel", "altLabels", "hiddenLabels", "status"]
    raw = read_csv_columns(spark, path, cols, "concept_pos")
    if released_only:
        raw = raw.where(F.lower(F.trim(F.coalesce("status", F.lit("")))).isin("released", ""))
    lists = [F.array("preferredLabel")]
    if alternative:
        lists.append(F.split(F.coalesce("altLabels", F.lit("")), "\n"))
    if hidden:
        lists.append(F.split(F.coalesce("hiddenLabels", F.lit("")), "\n"))
    forms = F.transform(F.array_compact(F.concat(*lists)), lambda x: F.trim(x))
    forms = F.array_distinct(F.filter(forms, lambda x: F.length(x) > 0))
    return (
        raw.withColumn("forms", forms)
        .where(F.size("forms") > 0)
        .select(
            F.col("conceptUri").alias("concept_id"),
            F.when(F.lower(F.coalesce("skillType", F.lit(""))).contains("knowledge"), "knowledge").otherwise("skill").alias("label"),
            F.get("forms", F.lit(0)).alias("preferred"),
            F.posexplode("forms").alias("form_pos", "form"),
            "concept_pos",
        )
    )


def read_token_sentences(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with tokens and two BIO layers; a length mismatch fails the job."""
    raw = spark.read.schema(
        "idx bigint, tokens array<string>, tags_skill array<string>, tags_knowledge array<string>, source string"
    ).option("mode", "FAILFAST").json(path)
    same = (F.size("tags_skill") == F.size("tokens")) & (F.size("tags_knowledge") == F.size("tokens"))
    return asserted(raw, same, "tag/token length mismatch").withColumn("source", F.coalesce("source", F.lit("")))


def read_name_counts(spark: SparkSession, path: str, first_year: int, last_year: int) -> DataFrame:
    """Name counts of a year range; the range filter reaches the parquet scan."""
    raw = require_columns(spark.read.parquet(path), ["name", "sex", "year", "count"], path)
    return raw.where(F.col("year").between(first_year, last_year)).groupBy("name", "sex").agg(F.sum("count").alias("count"))


def read_labelled_names(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_columns(spark, path, ["label", "gender", "n"]).withColumn("n", F.col("n").cast("bigint"))


def read_concept_edges(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_columns(spark, path, ["conceptUri", "broaderUri"]).distinct()


def read_rating_logs(spark: SparkSession, path: str, annotator_pattern: str = r"([^/=]+?)(?:\.csv|/part-[^/]*)$") -> DataFrame:
    """Append-only rating logs; the annotator is the file stem (or the folder of a split log)."""
    files = {"recursiveFileLookup": True, "pathGlobFilter": "*.csv"}
    rows = quoted_records(spark, path, **files).withColumn("_r", parsed(F.col("record"), ["pair_id", "rating", "comment", "timestamp_utc"]))
    return rows.select(
        F.regexp_extract("file", annotator_pattern, 1).alias("annotator"),
        "_r.pair_id", F.col("_r.rating").cast("int").alias("rating"), "_r.comment", F.to_timestamp("_r.timestamp_utc").alias("ts"),
    )


def read_scores(spark: SparkSession, path: str, splits=None, conditions=None) -> DataFrame:
    """Saved scores; the split predicate prunes folders and the condition predicate reaches the scan."""
    d = spark.read.parquet(path)
    if splits:
        d = d.where(F.col("split").isin(list(splits)))
    if conditions:
        d = d.where(F.col("condition").isin(list(conditions)))
    return d


def file_manifest(spark: SparkSession, path: str, pattern: str = "*", step: int = 1 << 28) -> DataFrame:
    """Size and sha-256 of every file below ``path``; a task reads about ``step`` bytes of a file.

    Files up to ``step`` bytes are digested whole, larger ones in rounds. Files whose names Hadoop's
    readers take for compressed ones are always digested whole and must stay under 2 GB. Spark lists no
    empty files.
    """
    options = {"pathGlobFilter": pattern, "recursiveFileLookup": True}
    files = spark.read.format("binaryFile").options(**options).load(path)
    large = (F.col("_metadata.file_size") > step) & ~F.col("_metadata.file_name").rlike(COMPRESSED)  # prunes the listed files
    named = lambda *cols: [F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("n_bytes"), *cols]
    whole = files.where(~large).select(*named(F.sha2("content", 256).alias("sha256")))
    rest = files.where(large).select(*named(F.col("_metadata.file_path").alias("path")))
    sizes = {r.path: r.n_bytes for r in rest.collect()}  # names of large files only
    if not sizes:
        return whole
    digests = sha256_in_rounds(spark, path, sizes, large, step, **options)
    return whole.unionByName(rest.join(digests, "path").select("file", "n_bytes", "sha256"))


def name_counts_from_triples(
    triples: DataFrame, citizen_of: str, classes: dict[str, str], min_persons: int = 3,
    p_citizen: str = "citizen", p_given: str = "given_name", p_class: str = "name_class",
) -> DataFrame:
    """Given names of citizens by the class of the name, with the number of distinct persons.

    The name table is small next to the persons; the count per (name, gender) combines map-side.
    """
    people = triples.where((F.col("p") == p_citizen) & (F.col("o") == citizen_of)).select("s").distinct()
    given = triples.where(F.col("p") == p_given).select("s", F.col("o").alias("name")).distinct()
    kinds = triples.where((F.col("p") == p_class) & F.col("o").isin(list(classes))).select(F.col("s").alias("name"), F.col("o").alias("cls")).distinct()
    gender = F.create_map(*[x for k, v in classes.items() for x in (F.lit(k), F.lit(v))])
    return (
        given.join(people, "s", "left_semi")
        .groupBy("name").agg(F.count(F.lit(1)).alias("n"))  # (person, name) is distinct already
        .join(kinds, "name")
        .select("name", gender[F.col("cls")].alias("gender"), "n")
        .where(F.col("n") >= min_persons)
    )

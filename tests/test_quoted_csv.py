"""Parallel reading of quoted CSV against Spark's one-task reader, with byte ranges that cut records and quotes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evenmatch.sources import readers
from evenmatch.sources.quoted_csv import header_of, parsed, quoted_records

PIECES = ["plain", 'say ""hi""', "two\nlines", "\n", "a,b", "cr\r\nlf", '""', "é\n\n\n", "x" * 300, " pad ", '""\n""']


def write(path, seed: int, n: int, ending: str) -> None:
    rng = random.Random(seed)
    with open(path, "w", newline="") as f:
        f.write(f'id,"text",n{ending}')
        for i in range(n):
            text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 5)))
            f.write(rng.choice([f'{i},"{text}",{i % 7}', f'"{i}","{text}",', f"{i},plain,{i}"]) + ending)
            if rng.random() < 0.05:
                f.write(ending)


def rows(d, n: int):
    return sorted(d.selectExpr(*[f"_c{i}" for i in range(n)]).collect(), key=repr)


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_records_equal_the_one_task_reader(spark, tmp_path, small_ranges, seed):
    for k in range(2):
        write(tmp_path / f"part-{k}.csv", 10 * seed + k, 150, "\n")
    path = str(tmp_path)
    columns = header_of(spark, path)
    assert columns == ["id", "text", "n"]
    records = quoted_records(spark, path)
    assert records.select("file", "block").distinct().count() > 20
    got = records.select(parsed(F.col("record"), columns).alias("r")).selectExpr("r.id AS _c0", "r.text AS _c1", "r.n AS _c2")
    want = spark.read.options(header=True, multiLine=True, quote='"', escape='"', lineSep="\n").csv(path).toDF("_c0", "_c1", "_c2")
    assert rows(got, 3) == rows(want, 3)
    order = [r[0] for r in records.orderBy("file", "block", "line").where(F.col("file").endswith("part-0.csv")).select(parsed(F.col("record"), columns)["id"].cast("int")).collect()]
    assert order == list(range(150))


def test_carriage_returns_end_records_and_stay_inside_fields(spark, tmp_path, small_ranges):
    write(tmp_path / "a.csv", 5, 120, "\r\n")
    records = quoted_records(spark, str(tmp_path / "a.csv")).select(parsed(F.col("record"), ["id", "text", "n"]).alias("r")).select("r.*").collect()
    assert sorted(int(r.id) for r in records) == list(range(120))
    assert any("\r\n" in (r.text or "") for r in records) and not any((r.n or "").endswith("\r") for r in records)


def test_labelled_names_and_missing_columns(spark, tmp_path):
    (tmp_path / "names.csv").write_text('﻿label,gender,n,note\n"Ann\nMary",F,3,x\nBo,M,12,y\n', encoding="utf-8")
    got = sorted(map(tuple, readers.read_labelled_names(spark, str(tmp_path / "names.csv")).collect()))
    assert got == [("Ann\nMary", "F", 3), ("Bo", "M", 12)]
    with pytest.raises(ValueError, match="lacks columns"):
        readers.read_csv_columns(spark, str(tmp_path / "names.csv"), ["age"])


def test_concepts_keep_the_order_of_the_file(spark, tmp_path, small_ranges):
    head = "conceptUri,skillType,preferredLabel,altLabels,hiddenLabels,status\n"
    body = "".join(f'u{99 - i:02d},skill,"form {i}","alt {i}\nSame Form",,released\n' for i in range(60))
    (tmp_path / "tax.csv").write_text(head + body)
    d = readers.read_taxonomy(spark, str(tmp_path / "tax.csv"))
    order = [r.concept_id for r in d.select("concept_id", "concept_pos").distinct().orderBy("concept_pos").collect()]
    assert order == [f"u{99 - i:02d}" for i in range(60)]
    from evenmatch.operators.spans import build_patterns

    assert build_patterns(d).where("key = 'same form'").first().concept_id == "u99"

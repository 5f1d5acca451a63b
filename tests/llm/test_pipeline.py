"""The pipeline's stages against brute force on the smallest tables, and the queries' columns."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evenmatch.llm import mixing, quality
from evenmatch.llm.registry import load, table
from test_operators import sets, smallest_reachable, spark_words

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of the given documents and of each stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = table(spark, PATH, "documents")
    out = [(docs.columns, docs.collect())]
    for no, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, PATH).write.parquet(f"{folder}/{no}")
        docs = spark.read.parquet(f"{folder}/{no}")
        out.append((docs.columns, docs.collect()))
    return out


def test_stages_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] and len(stages) == 6
    assert all(set(columns) == set(stages[0][0]) for columns, _ in stages[:-1])


def test_quality_stage_keeps_what_the_operator_accepts(spark, stages):
    good = {r.doc_id for r in quality.quality(table(spark, PATH, "documents"), table(spark, PATH, "labels")).where("predicted = 1").collect()}
    assert {r.doc_id for r in stages[1][1]} == good and len(good) < len(stages[0][1])


def test_dedup_stage_keeps_the_first_of_each_group(stages):
    rows = [(r.doc_id, sets(r.text)) for r in stages[1][1]]
    links = {(a, b) for a, x in rows for b, y in rows if a < b and x and 100 * len(x & y) >= 75 * len(x | y)}
    root = smallest_reachable([i for i, _ in rows], links)
    assert sorted(r.doc_id for r in stages[2][1]) == sorted(set(root.values()))


def test_decontamination_stage_drops_the_overlaps_only(spark, stages):
    code: dict = defaultdict(lambda: len(code))
    items = [np.array([code[w] for w in spark_words(r.text.lower())]) for r in table(spark, PATH, "benchmark").collect()]

    def dirty(text: str) -> bool:
        words = np.array([code[w] for w in spark_words(text.lower())], int)
        for item in items:
            width = min(13, len(item))
            edge = np.full(len(item) - width, -1)
            places = np.concatenate([edge, words, edge])
            if len(places) < len(item):
                continue
            same = np.lib.stride_tricks.sliding_window_view(places, len(item)) == item
            total = np.cumsum(np.concatenate([np.zeros((len(same), 1), int), same], 1), 1)
            if ((total[:, width:] - total[:, :-width]).max() >= 0.75 * width) if len(same) else False:
                return True
        return False

    kept = {r.doc_id for r in stages[3][1]}
    assert kept == {r.doc_id for r in stages[2][1] if not dirty(r.text)}


def test_pii_stage_rewrites_all_and_only_personal_data(stages):
    mail = re.compile(r"[\w.]+@mail\d+\.example\.com")
    before, after = ({r.doc_id: r for r in stages[k][1]} for k in (3, 4))
    assert before.keys() == after.keys()
    assert not any(mail.search(r.text) for r in after.values()) and any(mail.search(r.text) for r in before.values())
    assert all(r.n_chars == len(r.text) for r in after.values() if r.text != before[r.doc_id].text)
    plain = [i for i, r in before.items() if not re.search(r"[0-9@=:]", r.text)]
    assert plain and all(before[i] == after[i] for i in plain)


def test_mix_stage_repeats_what_the_mix_takes(spark, stages):
    taken = mixing.mixed(spark.createDataFrame(stages[4][1], table(spark, PATH, "documents").schema)).collect()
    assert Counter(r.doc_id for r in stages[5][1]) == Counter({r.doc_id: r.mix_repeats for r in taken if r.mix_repeats})
    assert max(Counter(r.doc_id for r in stages[5][1]).values()) <= 3


COLUMNS = {
    "op1_": ["doc_id", "n_shingles", "component_id", "kept"], "op2_": ["doc_id", "size", "source_size", "target", "taken"],
    "op3_": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"], "op4_": ["page_id", "url", "text", "n_chars"],
    "op5_": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op6_": ["doc_id", "n_tokens"], "op7_": ["doc_id", "text"],
    "op8_": ["vec_id", "n_links", "component_id", "kept"], "op9_": ["doc_id", "contaminated"], "op10_": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("prefix", COLUMNS)
def test_query_columns_and_rows(spark, prefix):
    names = [n for n in load()[0] if n.startswith(prefix)]
    assert len(names) == 1
    made = load()[0][names[0]](spark, PATH)
    assert made.columns[: len(COLUMNS[prefix])] == COLUMNS[prefix]
    source = {"op4_": "pages", "op8_": "embeddings"}.get(prefix, "documents")
    assert made.count() == table(spark, PATH, source).count()


def test_mix_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{PATH}/documents.parquet'")
    queries, sql = load()
    want = sorted(con.execute(sql["op2_mix_sources"]).fetchall())
    got = sorted(tuple(r) for r in queries["op2_mix_sources"](spark, PATH).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want, strict=True))


def test_held_out_is_the_remainder_of_crc32(spark):
    import zlib

    got = spark.range(200).select(F.col("id").alias("doc_id"), quality.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)

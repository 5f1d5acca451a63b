"""Streams over the given tables, each as one file and as a folder of files."""

from __future__ import annotations

import pytest

from evenmatch.plans import load_catalog
from evenmatch.plans.views import Tables
from oracle_check import compare, connect

PATH = "/root/testdata/sf0.001"
STREAMED = ("documents", "events", "benchmark")
CATALOG = load_catalog()


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("folders"))
    for name in STREAMED:
        spark.read.parquet(f"{PATH}/{name}.parquet").repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("key", ["stream_dedup", "stream_match", "stream_wording", "stream_rating_counts", "stream_latest_ratings"])
def test_folders_of_files_are_streamed(spark, folders, key):
    fn, sql = CATALOG[key]
    assert compare(fn(Tables(spark, folders)), sql, connect(PATH)) == "ok"

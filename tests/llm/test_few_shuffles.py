"""Near-duplicate classes: chains that come together from pieces, and the number of shuffles they take."""

from __future__ import annotations

import random

import pytest

from evenmatch.llm import minhash
from test_operators import sentence, sets, smallest_reachable


def chain(n: int) -> list[tuple[int, str]]:
    """Texts of which each shares enough with the next two or three only, in a random order of ids, some of them twice."""
    words = sentence(random.Random(8), 300 + 12 * n)
    ids = random.Random(9).sample(range(1000), n)
    rows = [(i, " ".join(words[12 * k : 12 * k + 300])) for k, i in enumerate(ids)]
    return rows + rows[::4]


@pytest.fixture(scope="module")
def found(spark):
    rows = chain(40)
    group = "near duplicates of a chain"
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(held, ("false", "-1"), strict=True):
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    return rows, got, len({s for j in jobs for s in j.stageIds if (i := tracker.getStageInfo(s)) and i.numCompletedTasks})


def test_a_chain_is_one_component(found):
    rows, got, _ = found
    known = {i: sets(t) for i, t in rows}
    links = {(a, b) for a, x in known.items() for b, y in known.items() if a < b and 100 * len(x & y) >= 75 * len(x | y)}
    want = smallest_reachable(list(known), links)
    assert len(set(want.values())) == 1 and len(links) < 5 * len(known)
    assert len(got) == len(rows)
    assert all((r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id) for r in got)


def test_a_chain_takes_few_stages(found):
    assert found[2] < 130

"""Vector codes, centroids and quality rules against plain Python on small tables with nulls, ties, copies and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest

from evenmatch.llm import centroids, codebooks, contamination, embeddings, html, licenses, minhash, mixing, pii, quality, repeats, rules, vectors

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label string, id long, tag string, n int, v string, cluster string"


def vector_rows(width: int, count: int = 150, seed: int = 1) -> list[tuple]:
    """Clustered vectors with ties and copies, and rows that must be left out."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(5)]
    rows = []
    for i in range(count):
        v = [x + rng.choice([0, 0, 0.01, 0.25]) * rng.uniform(-1, 1) for x in rng.choice(centres)]
        rows.append((i * 7 % 601, v, rng.choice(["a", "b", None])))
    rows += [(1000 + i, rows[3][1], "a") for i in range(30)]
    rows += [(2000, None, "a"), (2001, [], "b"), (2002, [None] + [0.1] * (width - 1), "a"), (2003, [NAN] + [0.1] * (width - 1), "a"), (2004, [0.2] * (width - 1) + [INF], "b")]
    rows += [(2005, [0.0] * width, None), (2006, [0.5] * (width - 4), "b"), (None, [0.3] * width, "b")]
    return [(*r, 5, "x", 2, "y", "z") for r in rows]


def kept_rows(rows: list[tuple], width: int, scale: int) -> list[tuple]:
    fine = lambda v: v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)
    return [(r[0], [int(np.floor(scale * x)) for x in r[1]], r[2]) for r in rows if fine(r[1])]


def distance(a, b) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def brute_codes(rows: list[tuple], entries: int, rounds: int, scale: int, width: int) -> list[tuple]:
    kept = kept_rows(rows, width, scale)
    size = width // 4
    cut = lambda v, p: v[p * size : (p + 1) * size]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: r[0])[:entries]
    books = [[cut(r[1], p) for r in first] for p in range(4)]
    nearest = lambda v, book: min((distance(v, c), e) for e, c in enumerate(book))
    for r in range(rounds + 1):
        found = [[nearest(cut(v, p), books[p]) for p in range(4)] for _, v, _ in kept]
        if r == rounds:
            break
        for p in range(4):
            for e in range(len(first)):
                mine = [cut(v, p) for (_, v, _), f in zip(kept, found, strict=True) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    by_label: dict = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return [(i, "".join(f"{e:02x}" for _, e in f), err, by_label[label], digest) for (i, _, label), f, err in zip(kept, found, errors, strict=True)]


def order(rows) -> list:
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("entries,seed", [(24, 1), (70, 2), (500, 3)])
def test_codes_equal_full_scans(spark, entries, seed):
    rows = vector_rows(12, 260, seed)
    got = codebooks.code_report(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=min(entries, 256))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert order(got.collect()) == order(brute_codes(rows, min(entries, 256), 4, 1024, 12))


def test_bounds_spare_scans_and_stay_below():
    """After a move, rows far from every changed group are not scanned, and every bound is below the true distance."""
    rng = np.random.default_rng(5)
    books = rng.integers(-900, 900, (64, 4))
    x = books[rng.integers(0, 64, 3000)] + rng.integers(-20, 20, (3000, 4))
    groups = codebooks.entry_groups(books)
    assert sorted(np.concatenate(groups).tolist()) == list(range(64)) and max(map(len, groups)) <= codebooks.GROUP
    code, bounds, stamps = np.zeros(3000, np.int64), np.zeros((3000, len(groups)), np.float32), np.zeros((3000, len(groups)), np.uint8)
    history = [books]
    for stamp in range(4):
        got = codebooks._scan_part(x, history, groups, stamp, code, bounds, stamps, not stamp)
        full = vectors.squared(x, history[-1])
        assert (full.argmin(1) == code).all() and (full.min(1) == got).all()
        full[np.arange(3000), code] = codebooks.LARGEST
        for g, members in enumerate(groups):
            moved = np.array([np.sqrt(((history[-1][members] - old[members]) ** 2).sum(1)).max() for old in history])
            assert (bounds[:, g] - moved[stamps[:, g]] <= np.sqrt(full[:, members].min(1)) + 1e-3).all()
        assert stamp == 0 or (stamps < stamp).mean() > 0.3
        history.append(history[-1] + rng.integers(-9, 9, books.shape) * (rng.random((64, 1)) < 0.2))


def brute_clusters(rows: list[tuple], k: int, rounds: int, scale: int, width: int) -> list[tuple]:
    kept = [(i, v) for i, v, _ in kept_rows(rows, width, scale)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest())[:k]
    at = [list(v) for _, v in first]
    for r in range(rounds + 1):
        found = [min((distance(v, c), j) for j, c in enumerate(at)) for _, v in kept]
        if r == rounds:
            break
        for j in range(len(at)):
            mine = [v for (_, v), f in zip(kept, found, strict=True) if f[1] == j]
            if mine:
                at[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    inertia = [sum(d for d, j in found if j == c) for c in range(len(at))]
    return [(i, j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found, strict=True)]


@pytest.mark.parametrize("k,width,block", [(9, 64, 7), (40, 64, 512), (400, 8, 16)])
def test_clusters_equal_full_scans(spark, monkeypatch, k, width, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    rows = vector_rows(width, 220, k)
    got = centroids.cluster_report(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, width=width)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert order(got.collect()) == order(brute_clusters(rows, k, 5, 256, width))


def test_box_candidates_hold_every_nearest_centroid_and_prune():
    rng = np.random.default_rng(2)
    at, some = rng.integers(-500, 500, (40, 6)), 0
    for _ in range(60):
        x = rng.integers(-500, 500, 6) + rng.integers(-25, 25, (80, 6))
        found = centroids.candidates(x.min(0), x.max(0), at)
        assert set(vectors.squared(x, at).argmin(1)) <= set(found.tolist())
        some += len(found)
    assert some < 60 * 40 / 3


def test_hilbert_neighbours_are_one_step_apart():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = centroids.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_huge_components_saturate_and_distances_stay_exact(spark):
    top = vectors.LIMIT
    x = np.array([[top, -top, 3], [0, 1, 2]])
    assert vectors.squared(x, x)[0, 1] == distance(x[0].tolist(), x[1].tolist())
    rows = [(1, [1e300] * 8, "a"), (2, [-1e300] * 8, "a"), (3, [0.0] * 8, "b")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert {r["vec_id"]: r["cluster"] for r in centroids.cluster_report(d, k=3, width=8).collect()}.keys() == {1, 2, 3}
    assert all(r["error"] == 0 for r in codebooks.code_report(d, entries=3).collect())


def test_empty_vector_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    bad = spark.createDataFrame([(1, None, 1), (2, [], 1)], "vec_id long, embedding array<float>, label int")
    assert codebooks.code_report(none).count() == 0 and centroids.cluster_report(none).count() == 0
    assert centroids.cluster_report(bad).count() == 0
    assert [(r["vec_id"], r["error"]) for r in codebooks.code_report(bad).collect()] == [(2, 0)]


# ---------------------------------------------------------------- quality rules
def plain_counts(text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen: dict = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(["of", "the", "and", "in"]) if rng.random() < 0.4 else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") + ("\n" if i % 30 == 29 else "") for i, w in enumerate(words)).capitalize()


def texts() -> list[tuple]:
    rng = random.Random(4)
    rows: list = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "a b c a b c a"), (5, "x\nx\n x\nx\n\n"), (6, "é ü é ü é ü \U0001f600 | # %"), (None, prose(rng, 80))]
    rows += [(10 + i, prose(rng, rng.randint(60, 300))) for i in range(60)]
    rows += [(100 + i, " ".join(w + "$$$" for w in prose(rng, 90).replace("of", "xyzw").split())) for i in range(8)]
    rows += [(200 + i, " | ".join(prose(rng, 90).split())) for i in range(8)]
    rows += [(300 + i, "Spam " * 200 + prose(rng, 20)) for i in range(4)] + [(400, prose(rng, 60) * 2), (401, prose(rng, 20000)), (10, "again " * 60)]
    rows += [(500 + i, prose(rng, 90).upper().replace(" ", "!! ")) for i in range(6)]
    return rows


@pytest.fixture(scope="module")
def judged_rows(spark):
    d = spark.createDataFrame([(*r, "q", 7, "w") for r in texts()], "doc_id long, text string, quality string, n_words int, votes string").repartition(3)
    return d


def test_counts_equal_plain_python(judged_rows):
    got = rules.counted(judged_rows).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert order(got) == order([(i, *plain_counts(t)) for i, t in texts()])


def test_rules_keep_prose_and_drop_junk(judged_rows):
    out = rules.rule_report(judged_rows)
    assert out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = out.collect()
    for r in rows:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
        if r["doc_id"] is None or 10 <= r["doc_id"] < 100 or r["doc_id"] == 401:
            assert r["kept"] or r["base_failed"]
        elif r["doc_id"] >= 100:
            assert not r["kept"], r
    assert sum(r["kept"] for r in rows) == 62


def test_passing_returns_all_columns_as_they_are(judged_rows):
    kept = rules.passing(judged_rows)
    assert kept.schema == judged_rows.schema and kept.count() == 62


def test_estimation_equals_plain_python(judged_rows):
    votes = [r["votes"] for r in rules.counted(judged_rows).select(rules.votes()).collect()]
    model = rules.estimate(rules.counted(judged_rows).select(rules.votes()))
    good, right, found = 0.8, [0.98] * len(rules.RULES), [0.3] * len(rules.RULES)
    for _ in range(rules.ROUNDS):
        post = []
        for v in votes:
            a, b = good, 1 - good
            for j, x in enumerate(v):
                if x:
                    a, b = a * (right[j] if x > 0 else 1 - right[j]), b * (found[j] if x < 0 else 1 - found[j])
            post.append(a / (a + b))
        good = (sum(post) + 8) / (len(votes) + 10)
        for j in range(len(right)):
            g, b = ({x: sum(p if side else 1 - p for p, v in zip(post, votes, strict=True) if v[j] == x) for x in (1, -1)} for side in (1, 0))
            right[j], found[j] = (g[1] + 9.8) / (g[1] + g[-1] + 10), (b[-1] + 3) / (b[1] + b[-1] + 10)
    assert model["good"] == pytest.approx(good) and list(model["right"].values()) == pytest.approx(right) and list(model["found"].values()) == pytest.approx(found)


def test_rules_on_an_empty_table(spark):
    assert rules.rule_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------- long texts and clashing columns
LONG = {
    "mail hosts": "x@" + "a." * 300_000 + "com", "mail names": "a.b-" * 200_000, "mail signs": "%+" * 300_000 + "@", "groups": "12 " * 6_000, "glued groups": "1- " * 30_000,
    "cards": "4111 1111 1111 1111 " * 300, "iban": "DE89 3704 " * 80_000, "phones": "+1 " * 200_000, "dots": "1.1" * 300_000, "digits": "7" * 900_000, "blanks": ("1-" + " " * 5000) * 30,
    "secrets": "token='" * 100_000, "glued mail": "1 2 3 4 5 6 7 8.a@b.com " * 2_000,
}


@pytest.mark.parametrize("name", LONG)
def test_no_text_stops_the_pseudonyms(spark, name):
    d = spark.createDataFrame([(1, LONG[name]), (2, "call 517-555-0497")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(d).collect()}
    assert got[2].n_pii == 1 and len(got[1].text) >= len(LONG[name]) // 2
    if name == "cards":
        assert got[1].n_pii == 300 and "4111 1111 1111 1111" not in got[1].text
    if name == "glued mail":
        assert got[1].n_pii >= 2_000 and "8.a@b.com" not in got[1].text


def test_digit_runs_in_context(spark):
    cases = {"5 2024-01-05  x": 1, "517-555-0497   !": 1, "4111 1111 1111 1111 9x": 1, "4111111111111111x": 0, "4111111111111111.5": 0, "4111 1111 1111 1111-": 0, "1 2 3 4 5 6 7 8.a@b.com": 1, "12 34": 0, "a@b.co1 and c@d.org.": 2}
    got = {r.text_id: r.n_pii for r in pii.pseudonymised(spark.createDataFrame([(t, t) for t in cases], "text_id string, text string")).collect()}
    assert got == cases


def test_key_comes_from_the_session(spark):
    d = spark.createDataFrame([(1, "call 517-555-0497")], "doc_id long, text string")
    before = pii.pseudonymised(d).first().text
    spark.conf.set(pii.KEY_SETTING, "another key")
    try:
        assert pii.pseudonymised(d).first().text != before == pii.pseudonymised(d, pii.KEY).first().text
    finally:
        spark.conf.unset(pii.KEY_SETTING)


CLASHES = (
    "size target whole rest last source_size weight place start words mix_s mix_order mix_size mix_bucket mix_taken mix_repeats epoch k1 k2 d best seed at h n width item_id item_words same contaminated "
    "bench_items bench_share _size _upper _new _found n_pii _k1 id key v ids tag component_id kept votes quality label score"
).split()


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 70) + " mail a@b.org", "ab"[i % 2], 3, *[f"{c}-{i}" for c in CLASHES]) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(2)


def clash_stages(spark):
    items = spark.createDataFrame([(1, "nothing of this kind stands there at all")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    return {
        "mixing": mixing.repeated, "decontamination": lambda d: contamination.uncontaminated(d, items), "pii": pii.rewritten, "quality": lambda d: quality.accepted(d, labels),
        "dedup": minhash.one_of_each, "rules": rules.passing,
    }


@pytest.mark.parametrize("stage", ["mixing", "decontamination", "pii", "quality", "dedup", "rules"])
def test_stages_return_clashing_columns_as_they_are(spark, clashing, stage):
    out = clash_stages(spark)[stage](clashing)
    skip = {"epoch"} if stage == "mixing" else set()
    assert [c for c in out.columns if c not in skip] == [c for c in clashing.columns if c not in skip]
    rows = out.collect()
    assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in CLASHES if c not in skip)


def test_reports_work_beside_clashing_columns(spark, clashing):
    items = spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string")
    for out, own in ((mixing.mixed(clashing), ["mix_size", "mix_source_size", "mix_target", "mix_repeats", "mix_taken"]), (contamination.contamination(clashing, items), ["contaminated", "bench_items", "bench_share"]), (pii.pseudonymised(clashing), ["n_pii"])):
        assert len(set(out.columns)) == len(out.columns) and out.columns[-len(own) :] == own and out.count() == 30
        assert all(r["size"] == f"size-{r.doc_id}" for r in out.collect())
    assert minhash.near_duplicates(clashing).count() == licenses.license_scan(clashing).count() == repeats.repeats_removed(clashing).count() == rules.rule_report(clashing).count() == 30


# ---------------------------------------------------------------- embeddings: repeated ids, missing ids, several lengths
def brute_links(rows: list[tuple]) -> list[tuple]:
    fine = lambda v: bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = [np.array(v, float) / np.linalg.norm(v) if fine(v) else None for _, v in rows]
    near = lambda a, b: a is not None and b is not None and len(a) == len(b) and (a @ b) >= embeddings.COSINE - 1e-12
    linked = [[j for j in range(len(rows)) if j != i and near(unit[i], unit[j])] for i in range(len(rows))]
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            fresh = [j for j in linked[todo.pop()] if j not in seen]
            seen.update(fresh)
            todo += fresh
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vec_id, len(linked[i]), least, vec_id == least))
    return out


def test_links_of_repeated_ids_missing_ids_and_lengths(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0, 0.0, 0.0]), (5, [1.0, 0.01, 0.0])]
    rows += [(None, [0.0, 0.0, 1.0]), (8, [0.0, 0.01, 1.0]), (None, [1.0, 1.0, -1.0]), (None, None), (9, []), (10, [0.0, 0.0, 0.0]), (11, [NAN, 1.0, 1.0]), (12, [1.0, None, 1.0])]
    rows += [(13, [1.0, 0.0]), (14, [1.0, 0.001]), (15, [0.0, 1.0]), (16, [2.0]), (17, [-3.0]), (4, [4.0]), (6, [-1.0, 0.0, 0.0]), (6, [0.0, -1.0, 0.0]), (7, [0.0, -1.0, 0.02])]
    got = embeddings.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert order(got.collect()) == order(brute_links(rows))


def test_recall_at_many_reference_points():
    """Pairs at exactly the threshold share two of their closest reference points nearly always, however many there are."""
    rng = np.random.default_rng(3)
    for count in (64, 256, 1024, 4096):
        points = embeddings._unit(rng.normal(size=(count, 64)))
        x = embeddings._unit(rng.normal(size=(1500, 64)))
        side = rng.normal(size=x.shape)
        side = embeddings._unit(side - (side * x).sum(1, keepdims=True) * x)
        y = 0.9 * x + np.sqrt(1 - 0.81) * side
        n = embeddings.nearest(count)
        close = [np.argpartition(-(v @ points.T), n, axis=1)[:, :n] for v in (x, y)]
        both = (close[0][:, :, None] == close[1][:, None, :]).any(2).sum(1)
        assert (both >= embeddings.SHARED).mean() > 0.97, (count, (both >= embeddings.SHARED).mean())


# ---------------------------------------------------------------- odd pages
ART = " ".join(f"word{i}" for i in range(50))
PAGES = [
    (f'<div class="container has-sidebar"><article><p>{ART}</p></article><div class="sidebar">x y</div></div>', ART),
    (f'<div id="content-sidebar-wrap"><article><p>{ART}</p></article></div>', ART),
    (f'<form action="x"><input name=q><article><p>{ART}</p></article></form>', ART),
    (f"<form><h1>Title</h1><p>{ART}</p></form>", f"Title {ART}"),
    (f'<article><p>{ART}</p></article><form class="contact"><p>Your name</p></form>', ART),
    (f"<article><p title=it's>{ART}</p><p>more text</p><p>it's last</p></article>", f"{ART} more text it's last"),
    (f'<article><p>{ART} <span style="display:none">hid den</span> end</p></article>', f"{ART} end"),
    (f'<article><p>{ART} <span class="ad">buy now</span> end</p></article>', f"{ART} end"),
    (f"<article><p>{ART} <math><mi>x</mi></math> end</p></article>", f"{ART} x end"),
    (f'<div class="post"><div class="entry-header"><h1>Title</h1></div><p>{ART}</p></div>', f"Title {ART}"),
    (f'<article><p>{ART}</p></article><div class="comments"><article class="comment-body"><p>nice one</p></article></div>', ART),
    (f'<article><p>{ART}</p></article><div class="related"><article class="teaser"><p>read this too</p></article></div>', ART),
    (f"<div><a href=x>Home</a></div><div>Sign in</div><div><a>About</a></div><div><p>{ART}</p></div>", ART),
    (f"<article =x><p a='b\"c' d=\"e'f\">{ART}</p></article>", ART),
    (f'<article><p data-x="never closed>{ART}</p></article>', ART),
    (f"<article><p>{ART}</p></i></b></div></article>", ART),
    (f"<article><ul><li>one<li>two<p>three<p>four</ul><p>{ART}</article>", f"one two three four {ART}"),
    (f"<article><p>a < b and c<d>e</d> {ART}</p></article>", f"a < b and ce {ART}"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_odd_pages(page, want):
    assert html.main_text(f"<html><body>{page}</body></html>", html.train()) == want


def test_tree_asks_words_and_neighbours():
    def asked(tree) -> set:
        return set() if isinstance(tree, int) else {html.FEATURES[tree[0]]} | asked(tree[2]) | asked(tree[3])

    assert {"words", "links", "around", "main"} <= asked(html.train()) and {"words_before", "links_before", "links_after", "words_after"} & asked(html.train())


@pytest.mark.parametrize("page", ["<a " * 300_000 + "'", "<div>" * 100_000 + "</i></b>" * 60_000, '<a x="' * 150_000, "<" * 800_000, "<i><div>" + "<b>" * 90_000 + "</i>" * 90_000, "<!--" * 200_000, "<p>" * 250_000, "<a =" * 250_000, "<x/" * 250_000])
def test_broken_markup_takes_linear_time(page):
    start = time.time()
    html.main_text(page, html.train())
    assert time.time() - start < 20  # quadratic readers take minutes


# ---------------------------------------------------------------- licenses
def test_every_passage_is_found_whole_changed_and_in_context(spark):
    rng, rows = random.Random(6), []
    for i, (label, text) in enumerate((*licenses.PASSAGES.items(), *licenses.LATER.items())):
        words = text.split()
        changed = [w if rng.random() > 0.06 else "other" for w in words]
        rows += [(3 * i, f"{prose(rng, 30)} {text} {prose(rng, 30)}", label), (3 * i + 1, " ".join(changed).upper(), label), (3 * i + 2, " ".join(rng.sample(words, len(words))), "")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, want string")).collect()}
    for doc_id, text, label in rows:
        found = got[doc_id].labels.split(",")
        if label:
            assert label in found and got[doc_id].score >= licenses.ENOUGH, (doc_id, label, found)
        else:  # shuffled words are no passage; a short notice may stand there by chance
            assert not {p[2] for p in got[doc_id].places or [] if p[1] - p[0] > 10}


def test_notices_carry_their_own_labels(spark):
    rows = [(i, f"under the {phrase} here") for i, phrase in enumerate({**licenses.PHRASES, **licenses.NOTICES})]
    got = {r.doc_id: r.labels.split(",") for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i] for i, label in enumerate({**licenses.PHRASES, **licenses.NOTICES}.values()))

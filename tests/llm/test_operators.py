"""Operators against brute force on small tables with nulls, empty texts, ties, copies and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenmatch.llm import contamination, embeddings, html, licenses, minhash, mixing, pii, quality, repeats, token_count
from evenmatch.llm.words import SPACES, hashed_words, shingles

SCHEMA = "doc_id long, text string, source string, id string, key string"


def sentence(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def corpus() -> list[tuple]:
    """Copies, near copies with more and more edits, shared passages, short, empty and null texts."""
    rng = random.Random(3)
    texts: list = [None, "", " \n ", "one", "one two three", "one two three"]
    base = sentence(rng, 140)
    for edits in range(14):
        words = list(base)
        for _ in range(edits // 2):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        texts += [" ".join(words)] * (2 if edits % 3 == 0 else 1)
    passage = " ".join(sentence(rng, 60))
    for _ in range(12):
        texts.append(" ".join([*sentence(rng, rng.randint(0, 90)), passage, *sentence(rng, rng.randint(0, 90))]))
    texts += [" ".join(sentence(rng, rng.randint(1, 120))) for _ in range(12)]
    texts += ["spam " * 300, "é" * 400 + " x", " ".join(sentence(rng, 9000))]
    rows = [(i * 7 % 101, t, [None, "b", "a", "c"][i % 4], "x", "y") for i, t in enumerate(texts)]
    return rows + [(None, "lost and found " * 3, "a", None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def spark_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sets(text: str | None) -> set:
    words = spark_words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def smallest_reachable(ids: list, links: set) -> dict:
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_minhash_equals_all_pairs(docs):
    rows = [(i, sets(t)) for i, t, *_ in corpus() if i is not None]
    links = {(a, b) for a, x in rows for b, y in rows if a < b and x and 100 * len(x & y) >= 75 * len(x | y)}
    want = smallest_reachable([i for i, _ in rows], links)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert len(got) == len(rows) + 1
    assert {i: got[i].component_id for i in want} == want
    assert all(got[i].n_shingles == len(s) and got[i].kept == (want[i] == i) for i, s in rows)
    assert got[None].component_id is None and got[None].kept
    assert len(set(want.values())) < len(want)


def test_one_of_each_keeps_columns_and_one_of_repeated_rows(spark, docs):
    twice = docs.unionByName(docs)
    kept = minhash.one_of_each(twice)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(i for i in ids if i is not None) == sorted({i for i in ids if i is not None})


def test_superminhash_is_an_estimate_and_fills_every_slot():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 1 << 54, n, dtype=np.uint64) for n in (300, 60, 40))
    values = np.concatenate([np.sort(np.concatenate([shared, a])), np.sort(np.concatenate([shared, b])), shared[:1]])
    found = minhash.signatures(values, np.array([0, 360, 700, 701]))
    assert (found != 0xFFFFFFFF).all()
    assert abs((found[0] == found[1]).mean() - 300 / 400) < 0.15
    assert len(set((found[2] >> 24).tolist())) == minhash.SLOTS  # one element: the ranks are a permutation


def test_shingle_blocks_do_not_depend_on_batching(monkeypatch):
    texts = [t for _, t, *_ in corpus()]
    whole = [set(v[at[i] : at[i + 1]].tolist()) for _, _, w, a in hashed_words(pa.array(texts), SPACES) for v, at in [shingles(w, a, 5)] for i in range(len(at) - 1)]
    import evenmatch.llm.words as words

    monkeypatch.setattr(words, "BLOCK", 512)
    monkeypatch.setattr(words.blocks, "__defaults__", (512,))
    small = [set(v[at[i] : at[i + 1]].tolist()) for _, _, w, a in hashed_words(pa.array(texts), SPACES) for v, at in [shingles(w, a, 5)] for i in range(len(at) - 1)]
    assert whole == small
    assert [len(s) for s in whole] == [len(sets(t)) for t in texts]


def test_mixing_meets_its_targets(docs):
    rows = mixing.mix_sizes(docs).collect()
    assert len(rows) == len(corpus())
    by: dict = {}
    for (i, t, s, *_), size in ((r, len(spark_words(r[1]))) for r in corpus()):
        by.setdefault(s, []).append(size)
    order = sorted((s for s in by if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total = sum(map(sum, by.values()))
    target, clamped = {}, set()
    while True:
        free = [s for s in by if s not in clamped]
        left = total - sum(3 * sum(by[s]) for s in clamped)
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if 3 * sum(by[s]) < level * weight[s]}
        if not over:
            break
        clamped |= over
    target = {s: 3.0 * sum(by[s]) if s in clamped else level * weight[s] for s in by}
    source = {(i, len(spark_words(t))): s for i, t, s, *_ in corpus()}
    for s in by:
        mine = [r for r in rows if source[r.doc_id, r.size] == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == sum(by[s]) and r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(r.size for r in mine) / 2 + 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sizes(docs.repartition(7)).collect()))


def test_license_places_and_labels(spark):
    passage = licenses.PASSAGES["mit"].split()
    texts = [
        "Released under the MIT License, the mit-license! MIT  LICENSE mit licenses", None, "", "general public general public license", "apache license mit license mit",
        " ".join([*passage[:20], "really", *passage[21:30], *passage[32:]]).title(), " ".join(passage[:12]), "cc by-nc 4.0",
    ]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(0, texts[0], "z")]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, score string")).collect()
    assert len(got) == len(rows)
    for r in got:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (texts[r.doc_id] or "").lower())
        places = sorted((at, label) for phrase, label in licenses.PHRASES.items() for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split())
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    assert {r.labels for r in got if r.doc_id == 5} == {"mit"} and {r.labels for r in got if r.doc_id == 6} == {""}
    assert {r.labels for r in got if r.doc_id == 7} == {"cc-by-nc"}


PAGES = {
    "<html><head><title>T</title><script>if (a<b) x('<p>no</p>')</script></head><body><nav><a href=/>Home</a></nav><article><h1>Big &amp; small</h1><p>First <b>one</b>.<p>Second&nbsp;two &#233;</article><footer>c 2020</footer>": "Big & small First one. Second two é",
    "<div class='cookie-notice'>We use cookies</div><main><p>A text of some length that says things.</p><form>Mail <input></form><aside>See also</aside></main><div id=comments><p>Nice</p></div>": "A text of some length that says things.",
    "<p>plain page without any marks at all but with enough words to be its text</p>": "plain page without any marks at all but with enough words to be its text",
    "": "", "<!-- open": "", "<p": "",
}


def test_html_text(spark):
    rows = [(i, f"u{i}", page, "old") for i, page in enumerate([*PAGES, None])]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for i, text in enumerate([*PAGES.values(), ""]):
        assert (got[i].text, got[i].n_chars) == (text, len(text))


def test_html_words_of_main_inside_other_parts():
    tree, article = html.train(), " ".join(f"word{i}" for i in range(50))
    plain = f"<div><p>{article}</p><p>{article}</p></div>"
    want = f"{article} {article}"
    for rest in (
        '<footer><div class="content">Imprint and contact of the publisher</div></footer>', '<aside><div class="text">Read more of our papers today</div></aside>',
        '<div class="comments"><div class="comment-text">I do not agree with any of this</div></div>', '<div class="comment-body">I do not agree with any of this</div>',
        '<div class="sidebar-content">Read more of our papers today</div>', '<div class="ad-text">Buy two and pay for one only</div>',
    ):
        for page in (plain + rest, rest + plain, f"<article>{plain}</article>{rest}", f'<div class="post-content">{plain}</div>{rest}'):
            assert html.main_text(f"<html><body>{page}</body></html>", tree) == want, page


def test_html_tree_learns_its_table():
    tree = html.train()
    assert all(html.accept(tree, row[:-1]) == bool(row[-1]) for row in html.LABELLED)


def test_repeats_equal_brute_force(docs):
    rows = [(i, (t or "").encode()) for i, t, *_ in corpus()]
    seen = Counter(b[i : i + 200] for _, b in rows for i in range(len(b) - 199))
    got = {r.doc_id: r for r in repeats.repeats_removed(docs).collect()}
    for i, b in rows:
        gone = bytearray(len(b))
        for at in range(len(b) - 199):
            if seen[b[at : at + 200]] > 1:
                gone[at : at + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())


def test_suffix_levels_merge_geometrically(spark):
    from evenmatch.sources.storage import Scratch

    family = repeats.SuffixLevels(Scratch(spark, "test-levels"), "t")
    for batch in range(5):
        family.add(spark.createDataFrame([(batch,), (batch + 1,), (100 + batch,)], "name long"))
    assert [rank for rank, *_ in family.levels] == [2, 0]
    assert sorted(r.name for r in family.repeated().collect()) == [1, 2, 3, 4]


def test_token_counts_equal_the_tokenizer(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary, unknown = token_count.pieces("/opt/tokenizers/piece_bpe_32k.model")
    for pieces, full in ((vocabulary, True), ([v for v in vocabulary if not v[0].startswith("<0x")], False)):
        model = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, unknown, full))
        model.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
        counter = token_count.Counter(pieces, unknown)
        for text in [t for _, t, *_ in corpus() if t][:40] + ["日本語 テ", "🙂🙂a 🙂", "▁▁ a▁b", "a\n\n b"]:
            assert counter.text(text) == len(model.encode(text).ids), text[:40]
    got = {r.doc_id: r.n_tokens for r in token_count.token_counts(docs, "/opt/tokenizers/piece_bpe_32k.model").collect()}
    counter = token_count.Counter(vocabulary, unknown)
    assert got == {i: counter.text(t) for i, t, *_ in corpus()}


def test_embeddings_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows: list = [base[i % 60] + rng.normal(size=16) * (0.02 if i % 3 else 0.35) for i in range(400)] + [base[0]] * 5
    rows = [x.astype(np.float32).astype(float).tolist() for x in rows]
    bad = [None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0] * 3, [float("inf")] * 16]
    table = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows + bad)] + [(None, rows[0], "x")], "vec_id long, embedding array<float>, v string")
    got = {r.vec_id: r for r in embeddings.embedding_links(table).collect()}
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in range(len(rows)))
    assert 0.95 * near.sum() <= found <= near.sum() + len(rows)  # the row without an id counts as one more copy
    assert all(got[len(rows) + i].n_links == 0 and got[len(rows) + i].kept for i in range(len(bad)))
    want = smallest_reachable(list(range(len(rows))), {(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)})
    assert np.mean([got[i].component_id == want[i] for i in range(len(rows))]) > 0.95


def test_contamination_tolerates_substitutions(spark):
    rng = random.Random(11)
    items = [(i, " ".join(sentence(rng, 30))) for i in range(20)] + [(20, "too short"), (21, None), (None, "x " * 20)]
    clean = [" ".join(sentence(rng, 200)) for _ in range(30)]
    dirty = []
    for i in range(20):
        words = items[i][1].split()
        for at in range(3, 30, 9):
            words[at] = "changed"
        dirty.append(" ".join([*sentence(rng, rng.randint(0, 50)), *words, *sentence(rng, 5)]).upper())
    part = [" ".join([*sentence(rng, 40), *items[3][1].split()[:9]])]
    texts = clean + dirty + part + [None, "", items[1][1], items[1][1]]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    got = {r.doc_id: r for r in contamination.contamination_report(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got) == len(texts)
    assert not any(got[i].contaminated for i in range(30))
    assert all(got[30 + i].bench_items == [i] for i in range(20))
    assert not any(got[50 + i].contaminated for i in range(3)) and got[53].contaminated and got[54].bench_share == 1.0


def test_contamination_masks_meet_every_substitution():
    assert sorted(contamination.MASKS) == list(range(1, contamination.WINDOW + 1))
    for width, masks in contamination.MASKS.items():
        kept = [[i for i, c in enumerate(m) if c == "1"] for m in masks]
        assert all(m[0] == m[-1] == "1" and len(m) <= width for m in masks)
        for changed in itertools.combinations(range(width), width - contamination.least_agreeing(width)):
            assert any(not {at + k for k in ks} & set(changed) for ks in kept for at in range(width - ks[-1])), (width, changed)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(23)
    # short items, every 4th word of a long one, and random substitutions
    lengths = [1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 10, 11, 12, 12, 12, 13, 13, 13, 14, 15, 15, 15, 22, 40]
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))) for i, n in enumerate(lengths)]
    texts = []
    for _, text in items:
        for share in (0, 0.1, 0.2, 0.2, 0.25, 0.25, 0.3, 0.3):
            words = [w if rng.random() >= share else "new" for w in text.split()]
            texts.append(" ".join([*sentence(rng, rng.randint(0, 9)), *words, *sentence(rng, rng.randint(0, 9))]))
        for first in range(4):
            texts.append(" ".join("new" if i % 4 == first else w for i, w in enumerate(text.split())))
        texts.append(" ".join(text.split()[: rng.randint(1, 12)]))

    def share(words: list[str], item: list[str]) -> float:
        width = min(13, len(item))
        return max(sum(0 <= i + d < len(words) and words[i + d] == item[i] for i in range(at, at + width)) / width for d in range(-len(item), len(words)) for at in range(len(item) - width + 1))

    want = {i: [k for k, item in items if share(t.split(), item.split()) >= 0.75] for i, t in enumerate(texts)}
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.bench_items for r in contamination.contamination_report(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and sum(map(len, want.values())) > 150


def test_pii_pseudonyms(spark):
    texts = [
        "mail a.b@mail7.example.com or +1 (517) 555-0497.", "card 4111 1111 1111 1111, not 4111111111111112, again 4111111111111111", "10.0.0.1 999.1.1.1 1.2.3.4.5 and 1985-02-28, 1985-02-30",
        'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"!', "GB82 WEST 1234 5698 7654 32", "plain 3.14 text 12345", "", None,
    ]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n long")).collect()}
    assert [got[i].n_pii for i in range(8)] == [2, 2, 2, 1, 1, 0, 0, 0]
    assert [got[i].text for i in (5, 6, 7)] == texts[5:]
    cards = re.findall(r"(?:\d ?){16}", got[1].text)
    digits = [re.sub(r"\D", "", c) for c in cards]
    assert digits[0] == digits[2] != "4111111111111111" and digits[1] == "4111111111111112"
    worth = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits[0]))]
    assert sum(worth) % 10 == 0 and re.fullmatch(r"card (?:\d{4} ){3}\d{4}, not 4111111111111112, again \d{16}", got[1].text)
    assert "999.1.1.1 1.2.3.4.5" in got[2].text and "1985-02-30" in got[2].text and "1985-02-28" not in got[2].text and "10.0.0.1 " not in got[2].text
    iban = re.sub(" ", "", got[4].text)
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban[:2] == "GB"


def test_pii_values_beside_other_digits(spark):
    card, phone = "4111 1111 1111 1111", "517-555-0497"
    hidden = [  # text, values that must go, what must stay
        (f"{card} 123", [card], " 123"), ("4111111111111111 12/25", ["4111111111111111"], " 12/25"), (f"{phone} 100 times", [phone], " 100 times"), ("415-555-0123 2024", ["415-555-0123"], " 2024"),
        ("call +15175550497.", ["5175550497"], "call +1"), ("call 517 555 0497 now", ["517 555 0497"], " now"), ("2024-01-05T10:00:00Z", ["2024-01-05"], "T10:00:00Z"),
        (f"no 2024 {card} 12", [card], "no 2024 "), (f"77 {card} {phone} 5", [card, phone], " 5"), ("4111-1111-1111-1111-123", ["4111-1111-1111-1111"], "-123"),
        (f"{card} 01/02/2024", [card, "01/02/2024"], " "), (f"{'12 ' * 4000}{card}", [card], "12 12 12 "),
    ]
    clear = ["1 2 3 4 5 6 7 8 9 10 11 12", "2024 - 2025  1234 5678", "1234567890123456789012345", "100 200 3000"]
    rows = list(enumerate([h[0] for h in hidden] + clear))
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (text, values, stays) in enumerate(hidden):
        assert got[i].n_pii == len(values) and not any(v in got[i].text for v in values) and stays in got[i].text, (text[:60], got[i].text[:60])
        assert re.sub(r"\d", "0", got[i].text) == re.sub(r"\d", "0", text)
    assert [got[len(hidden) + i].text for i in range(len(clear))] == clear


def test_feistel_is_a_permutation(spark):
    out = spark.range(1000).select(pii.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "t", "k").alias("d"))
    assert {r.d for r in out.collect()} == {f"{i:03d}" for i in range(1000)}


def test_quality_separates_and_holds_labels_out(spark):
    rng = random.Random(2)
    good = [(" ".join(sentence(rng, rng.randint(20, 200))) + ". ").capitalize() for _ in range(150)]
    junk = [" ".join(w.upper() + "!!" for w in sentence(rng, 80)) for _ in range(75)] + ["word " * rng.randint(40, 300) for _ in range(75)]
    texts = [(i, t, "label") for i, t in enumerate(good + junk)] + [(300, None, ""), (301, "", ""), (None, "x", "")]
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(texts, "doc_id long, text string, quality string")
    got = quality.quality(table, labels).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert held and np.mean([r.predicted == (r.doc_id < 150) for r in held]) > 0.95
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(str, quality.quality(table, flipped).collect())) == sorted(map(str, got))
    kept = quality.accepted(table, labels)
    assert kept.columns == table.columns and {str(r.doc_id) for r in kept.collect()} == {str(r.doc_id) for r in got if r.predicted}
    assert {r.score for r in quality.quality(table, labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("name", ["minhash", "mixing", "licenses", "repeats", "contamination", "pii", "quality", "embeddings", "html", "tokens"])
def test_empty_tables(spark, name):
    docs = spark.createDataFrame([], SCHEMA)
    items, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    made = {
        "minhash": lambda: minhash.near_duplicates(docs), "mixing": lambda: mixing.mix_sizes(docs), "licenses": lambda: licenses.license_scan(docs), "repeats": lambda: repeats.repeats_removed(docs),
        "contamination": lambda: contamination.contamination_report(docs, items), "pii": lambda: pii.pseudonymised(docs), "quality": lambda: quality.quality(docs, labels),
        "embeddings": lambda: embeddings.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>")), "html": lambda: html.extract(spark.createDataFrame([], "page_id long, html string")),
        "tokens": lambda: token_count.token_counts(docs, "/opt/tokenizers/piece_bpe_32k.model"),
    }
    assert made[name]().collect() == []

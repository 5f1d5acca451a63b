"""Near-duplicate documents by SuperMinHash signatures, banding, verification and components.

Signature: every shingle carries a random permutation of the slots and one random fraction per
permutation rank; slot ``p`` keeps the smallest ``rank + fraction`` of any shingle. Because the
ranks of one shingle are a permutation, slots are negatively correlated, which lowers the variance,
and a document stops as soon as every slot is filled: later ranks cannot be smaller.

Candidates: 128 slots in 32 bands of 4. At a similarity of 0.75 a pair misses all bands with
probability (1 - 0.75^4)^32 = 5e-6. Equal shingle sets are one class from the start, so copies are
never paired. In a bucket every member meets one pivot, another one for each band; the members that
are still in another component than most of their bucket are then compared with all the rest of it,
tile by tile inside the tasks on their full sets, which only put out links. So no bucket is expanded into its pairs,
yet no pair that shares a bucket and could still join two components goes unseen. Links are confirmed on full shingle sets.

Rows without words have no shingles and no links. A null ``text`` counts as empty. A row with a
null id is a document of its own class unless its text equals another's. Repeated rows share a
class; rows with one id and different texts share a node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.storage import Scratch
from .contamination import bounded
from .graph import components, roots
from .words import SPACES, hashed_words, mix, shingles

SLOTS, BAND = 128, 4
SHARE = 75  # percent of the union that two linked sets share at least
PLANES = 8  # four bits of each slot, as bit planes of two longs
#: Slots of 128 whose four bits agree at least; 98 are expected at a similarity of 0.75, 5 sigma lower is 73.
AGREE = 73
TILE = 256  # rows of a bucket that are compared with as many others at a time
_EMPTY = np.uint32(0xFFFFFFFF)
_SEEDS = [np.uint64((j * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)) for j in range(SLOTS)]


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SuperMinHash signatures (rank in the upper 8 bits, fraction below) of all rows of a block."""
    n = len(at) - 1
    found = np.full(n * SLOTS, _EMPTY, np.uint32)
    row = np.repeat(np.arange(n), np.diff(at))
    order, value = None, values
    for rank in range(SLOTS):
        draw = mix(value ^ _SEEDS[rank])
        pick = (rank + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(SLOTS - rank)) >> np.uint64(32))).astype(np.intp)
        if order is None:
            slot = pick
        else:
            index = np.arange(len(pick))
            slot = order[index, pick]
            order[index, pick] = order[index, rank]
        np.minimum.at(found, row * SLOTS + slot, (np.uint32(rank) << np.uint32(24)) | (draw >> np.uint64(40)).astype(np.uint32))
        open_rows = (found.reshape(n, SLOTS) == _EMPTY).any(1)
        keep = open_rows[row]
        if not keep.any():
            break
        if order is None:
            order = np.tile(np.arange(SLOTS, dtype=np.uint8), (int(keep.sum()), 1))
            pick = pick[keep]
            order[np.arange(len(pick)), pick] = 0
        else:
            order = order[keep]
        row, value = row[keep], value[keep]
    return found.reshape(n, SLOTS)


def _sketches(batches):
    for batch in batches:
        ids = batch.column("id")
        for row, to, words, at in hashed_words(batch.column("text"), SPACES):
            values, at = shingles(words, at, 5)
            n, filled = to - row, np.diff(at) > 0
            mixed = np.concatenate([mix(values), np.zeros(1, np.uint64)])
            other = mix(mixed ^ _SEEDS[1])
            starts = np.minimum(at[:-1], len(values))
            total = np.where(filled, np.add.reduceat(mixed, starts), 0).view(np.int64)
            more = np.where(filled, np.add.reduceat(other, starts), 0).view(np.int64)
            found = np.zeros((n, SLOTS), np.uint32)
            if filled.any():
                found[filled] = signatures(values, np.concatenate([at[:-1][filled], at[-1:]]))
            key = np.broadcast_to(np.arange(SLOTS // BAND, dtype=np.uint64), (n, SLOTS // BAND))
            for j in range(BAND):
                key = mix(key * np.uint64(0xD1342543DE82EF95) + found[:, j::BAND])
            planes = np.stack([np.packbits((found >> np.uint32(b)) & np.uint32(1), axis=1).view(">i8").astype(np.int64) for b in range(4)], 1)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(row, n), pa.array(np.diff(at).astype(np.int64)), pa.array(total), pa.array(more),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, PLANES * n + 1, PLANES, dtype=np.int32)), pa.array(planes.reshape(-1))),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, n * SLOTS // BAND + 1, SLOTS // BAND, dtype=np.int32)), pa.array(key.reshape(-1).view(np.int64))),
                ],
                names=["id", "n_shingles", "f1", "f2", "planes", "bands"],
            )


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, f1, f2`` (fingerprint of the set), bit planes and band keys of every row."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _sketches, "id long, n_shingles long, f1 long, f2 long, planes array<long>, bands array<long>"
    )


def _confirm(batches):
    for batch in batches:
        sets = []
        for name in ("text_a", "text_b"):
            found = []
            for _, _, words, at in hashed_words(batch.column(name), SPACES):
                values, at = shingles(words, at, 5)
                found += [values[at[i] : at[i + 1]] for i in range(len(at) - 1)]
            sets.append(found)
        keep = []
        for x, y in zip(*sets, strict=True):
            both = len(x) + len(y) - len(np.union1d(x, y)) if len(x) and len(y) else 0
            keep.append(both > 0 and 100 * both >= SHARE * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], names=["u", "v"])


def confirmed(pairs: DataFrame, texts: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """Columns ``u`` and ``v`` (the ids, or their components) of the pairs ``a, b`` whose full shingle sets share enough."""
    left, right = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(right, "b").join(left, "a").select(F.col(u).alias("u"), F.col(v).alias("v"), "text_a", "text_b").mapInArrow(_confirm, "u long, v long")


def _codes(batches):
    """The shingle sets themselves: what a tile links is linked by the same hashes as in ``confirmed``."""
    for batch in batches:
        for row, to, words, at in hashed_words(batch.column("text"), SPACES):
            values, at = shingles(words, at, 5)
            codes = [values[at[i] : at[i + 1]].tobytes() for i in range(to - row)]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, to - row), pa.array(codes, pa.binary())], names=["id", "codes"])


def _compare(batches):
    """For each tile of rows sorted by ``key, mb, ab, role``: links of rows of role 0 with rows of role 1 in other components."""
    group, held = None, []
    for batch in (b.slice(i, TILE) for b in batches for i in range(0, len(b), TILE)):
        table = batch.to_pydict()
        out = []
        for key, mb, ab, *row in zip(*(table[c] for c in ("key", "mb", "ab", "role", "id", "c", "codes")), strict=True):
            if (key, mb, ab) != group:
                out += _links(held)
                group, held = (key, mb, ab), []
            held.append(row)
        yield _link_batch(out)
    yield _link_batch(_links(held))


def _link_batch(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["a", "b", "c_a", "c_b"])


def _links(rows: list) -> list[tuple[int, int, int, int]]:
    """Links of rows of role 0 with rows of role 1 that join all components which such links can join in the tile.

    The larger and the smaller id, and the components of both.
    """
    few = [r for r in rows if r[0] == 0]
    many = [r for r in rows if r[0] == 1 and len(r[3])]
    if not few or not many:
        return []
    sets = [np.frombuffer(r[3], np.uint64) for r in many]
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(x) for x in sets])
    start = np.cumsum(size) - size
    ids, parts = np.array([r[1] for r in many]), np.array([r[2] for r in many])
    out, mark, root = [], np.zeros(len(names), np.int32), {}

    def find(part: int) -> int:
        while root.get(part, part) != part:
            part = root[part]
        return part

    for _, own, part, packed in few:
        mine = np.frombuffer(packed, np.uint64)
        at = np.minimum(np.searchsorted(names, mine), len(names) - 1)
        at = at[names[at] == mine]
        mark[at] = 1
        both = np.add.reduceat(mark[codes], start)
        mark[at] = 0
        union = size + len(mine) - both
        for i in np.flatnonzero((100 * both >= SHARE * union) & (parts != part) & (ids != own)):
            here, there = find(part), find(int(parts[i]))
            if here != there:  # a link inside what the tile has joined already adds nothing
                root[max(here, there)] = min(here, there)
                ends = sorted([(own, part), (int(ids[i]), int(parts[i]))], reverse=True)
                out.append((ends[0][0], ends[1][0], ends[0][1], ends[1][1]))
    return out


def _agree() -> Column:
    """Slots whose four bits agree in the bit planes ``planes_a`` and ``planes_b``."""
    differ = []
    for half in range(2):
        planes = [F.get(F.col("planes_a"), 2 * b + half).bitwiseXOR(F.get(F.col("planes_b"), 2 * b + half)) for b in range(4)]
        differ.append(F.bit_count(planes[0].bitwiseOR(planes[1]).bitwiseOR(planes[2]).bitwiseOR(planes[3])))
    return F.lit(SLOTS) - differ[0] - differ[1]


def _likely(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Distinct pairs whose sizes and bit planes allow the wanted similarity, with ``agree``."""
    a, b = (marks.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("planes").alias(f"planes_{c}")) for c in "ab")
    return (
        pairs.distinct().join(a, "a").join(b, "b").where(f"100 * least(n_a, n_b) >= {SHARE} * greatest(n_a, n_b)")
        .select("a", "b", _agree().alias("agree")).where(F.col("agree") >= AGREE)
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` of every row of ``docs``."""
    work = Scratch(docs.sparkSession, "minhash")
    made = work.write(sketches(docs, id_col, text_col), "sketches")
    # equal sets have equal planes and bands, so any row of a class can give them
    whole = made.where("n_shingles > 0").groupBy("n_shingles", "f1", "f2").agg(F.min("id").alias("rep"), F.first("planes").alias("planes"), F.first("bands").alias("bands"))
    classes = work.write(whole, "classes")
    reps = classes.where("rep is not null").select(F.col("rep").alias("id"), "n_shingles", "planes", "bands")
    # one row per id: of rows with one id and different texts the larger set stands for the sizes and planes
    marks = work.write(reps.groupBy("id").agg(F.max(F.struct("n_shingles", "planes")).alias("m")).select("id", "m.*"), "marks")
    # the pivot of a bucket is the id that is smallest when its bits are flipped by the key's, so no join has to bring it back
    rows = reps.select("id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("id").bitwiseXOR(F.col("key"))).alias("low")).where("n > 1")
    members = rows.join(shared.select("key", F.col("low").bitwiseXOR(F.col("key")).alias("p")), "key").distinct()
    members = work.write(members, "members")

    pairs = members.where("id <> p").select(F.greatest("id", "p").alias("a"), F.least("id", "p").alias("b"))
    likely = work.write(_likely(pairs, marks), "likely")
    # texts of the rows that any later step may need, read from the input once
    wanted = bounded(members.select("id").distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = work.write(texts.join(wanted, "id", "left_semi"), "texts")
    best = likely.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("m")).select("a", "m.b")
    links = work.write(confirmed(best, texts), "links-1")
    found = roots(links, work, "parts-1")

    more = work.write(confirmed(_apart(likely.select("a", "b"), found), texts, "c_a", "c_b"), "links-2")

    # whoever is not in the largest component of its bucket is compared with the rest of the bucket
    placed = members.where("id <> p").join(found, "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("c"))
    most = placed.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("size"), F.max(F.struct("n", "c")).alias("m"))
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    split = most.where("parts > 1").select("key", F.col("m.c").alias("large"), tiles(F.col("size")).alias("na"), tiles(F.col("size") - F.col("m.n")).alias("nm"))
    placed = work.write(placed.join(split, "key"), "open")
    tile = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = placed.where("c <> large").select("key", tile("nm", 1).alias("mb"), every("na").alias("ab"), F.lit(0).alias("role"), "id", "c")
    all_rows = placed.select("key", every("nm").alias("mb"), tile("na", 2).alias("ab"), F.lit(1).alias("role"), "id", "c")
    codes = work.write(texts.join(placed.select("id").distinct(), "id", "left_semi").mapInArrow(_codes, "id long, codes binary"), "codes")
    rest = few.unionByName(all_rows).join(codes, "id").repartition("key", "mb", "ab").sortWithinPartitions("key", "mb", "ab", "role")
    rest = rest.select("key", "mb", "ab", "role", "id", "c", "codes").mapInArrow(_compare, "a long, b long, c_a long, c_b long").distinct()
    rest = work.write(confirmed(work.write(rest, "rest"), texts, "c_a", "c_b"), "links-3")
    # what is left joins components, so only these are nodes of the second graph
    joined = components(more.unionByName(rest), work, "parts-2").select(F.col("id").alias("c"), F.col("component_id").alias("joined"))

    whole = classes.select("n_shingles", "f1", "f2", "rep").join(found, F.col("rep") == F.col("id"), "left").withColumn("c", F.coalesce("component_id", "rep"))
    whole = whole.join(joined, "c", "left").select("n_shingles", "f1", "f2", F.coalesce("joined", "c").alias("component_id"))
    out = made.drop("planes", "bands").join(whole, ["n_shingles", "f1", "f2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the first document of each near-duplicate group only.

    Of rows with one id one stays. Rows with a null id cannot be named and all stay.
    """
    kept = near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n")).where("kept")
    kept = Scratch(docs.sparkSession, "kept").write(kept, "ids")
    single, several = (docs.join(bounded(kept.where(f"n {op} 1").select("doc_id")), "doc_id", "left_semi").select(*docs.columns) for op in ("=", ">"))
    return single.unionByName(several.dropDuplicates(["doc_id"])).unionByName(docs.where("doc_id is null"))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs that are not yet in one component, with the components ``c_a`` and ``c_b``."""
    a, b = (found.select(F.col("id").alias(c), F.col("component_id").alias(f"c_{c}")) for c in "ab")
    placed = pairs.join(a, "a", "left").join(b, "b", "left")
    return placed.select("a", "b", F.coalesce("c_a", "a").alias("c_a"), F.coalesce("c_b", "b").alias("c_b")).where("c_a <> c_b")

"""Compression of vectors by product codebooks, with norm-of-sum bounds against full rescans.

Vectors are cut into ``PARTS`` consecutive parts and every part position has a codebook. A round
assigns each part to its nearest entry and moves the entries. Each row remembers, for every part, its
entry and for every group of about ``GROUP`` entries a lower bound of the distance to those of them
that are not its entry, together with the round in which the bound was measured (its stamp). All
codebooks of earlier rounds are retained, so a bound of round s is worth, in round r, its value less
the largest true displacement |entry(r) - entry(s)| in the group: the norm of the sum of the moves,
not the sum of their norms. A group is scanned again, exactly, only when its bound does not exceed
the exact distance to the present entry.

Distances are whole numbers; bounds are rounded down and compared with a margin, so they only spare
work. The groups follow from the starting codebook by halving along its widest component. The rows
carry their state from round to round in written tables; a round sends at most one row per entry
out of a task, and the driver holds the codebooks alone.

Components are integers floor(scale * x) (see ``vectors``). Left out: null vectors, vectors with null
or non-finite components, and vectors of another length than most have (ties: the longer). A length
that ``PARTS`` does not divide makes the first parts one longer. Rows with a null id are coded but give
no entry; of repeated ids the smaller packed vector comes first. Repeated rows count as often as they
occur. With fewer than ``entries`` vectors with an id the codebooks are shorter; an empty table gives an
empty result. Other columns of the table are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.storage import Scratch
from .vectors import floors, integer_rows, matrix, squared

PARTS = 4
GROUP = 16
LARGEST = (1 << 63) - 1
STATE = "code binary, error long, bounds binary, stamps binary"


def part_ranges(width: int) -> list[slice]:
    """Where each part lies in a vector."""
    cuts = np.cumsum([0] + [width // PARTS + (p < width % PARTS) for p in range(PARTS)])
    return [slice(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def entry_groups(entries: np.ndarray) -> list[np.ndarray]:
    """Numbers of the entries in groups of at most ``GROUP`` that lie near each other."""
    groups, todo = [], [np.arange(len(entries))]
    while todo:
        some = todo.pop()
        if len(some) <= GROUP or not entries.shape[1]:
            groups.append(np.sort(some))
            continue
        spread = entries[some].max(0) - entries[some].min(0)
        order = some[np.argsort(entries[some][:, int(spread.argmax())], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return groups


def _down(distance: np.ndarray) -> np.ndarray:
    """Square roots as 32-bit numbers that are not above the true ones."""
    return np.nextafter(np.sqrt(distance.astype(float)).astype(np.float32), np.float32(-np.inf))


def _two_least(distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the smallest value of each row (the first of equals), that value, and the second smallest."""
    at = distance.argmin(1)
    every = np.arange(len(distance))
    least = distance[every, at]
    rest = distance.copy()
    rest[every, at] = LARGEST
    return at, least, rest.min(1)


def _scan_part(x, history, groups, stamp, code, bounds, stamps, full):
    """One part of a batch in round ``stamp``; changes code, bounds and stamps in place, returns the distances."""
    entries, every = history[-1], np.arange(len(x))
    if full:
        own = np.full(len(x), LARGEST)
        code[:] = -1
    else:
        own = ((x - entries[code]) ** 2).sum(1)
        moved = np.stack([[np.sqrt(((entries[g] - old[g]) ** 2).sum(1).astype(float)).max() * (1 + 1e-9) for g in groups] for old in history])  # stamps x groups
        reach = np.sqrt(own.astype(float)) * (1 + 1e-6) + 1e-3
    best, at = own.copy(), code.copy()
    old_group = np.full(len(x), -1)
    new_group, runner = np.full(len(x), -1), np.full(len(x), LARGEST)
    for g, members in enumerate(groups):
        rows = every if full else np.flatnonzero(bounds[:, g] - moved[stamps[:, g], g] <= reach)
        place = np.full(len(entries), -1)
        place[members] = np.arange(len(members))
        inside = place[code] if not full else np.full(len(x), -1)
        old_group[inside >= 0] = g
        if not len(rows):
            continue
        distance = squared(x[rows], entries[members])
        mine = np.flatnonzero(inside[rows] >= 0)
        distance[mine, inside[rows][mine]] = LARGEST
        first, least, second = _two_least(distance)
        number = members[first]
        bounds[rows, g], stamps[rows, g] = _down(least), stamp
        wins = (least < best[rows]) | ((least == best[rows]) & (least < LARGEST) & (number < at[rows]))
        won = rows[wins]
        best[won], at[won], new_group[won], runner[won] = least[wins], number[wins], g, second[wins]
    changed = np.flatnonzero(new_group >= 0)
    bounds[changed, new_group[changed]] = _down(runner[changed])
    left = changed[old_group[changed] >= 0]  # the entry they leave counts for its group from now on
    group = old_group[left]
    if len(left):
        known = np.nextafter((bounds[left, group] - moved[stamps[left, group], group]).astype(np.float32), np.float32(-np.inf))
        bounds[left, group], stamps[left, group] = np.minimum(known, _down(own[left])), stamp
    code[:] = at
    return best


def _round(history: list[list[np.ndarray]], groups: list[list[np.ndarray]], ranges: list[slice]):
    """Assignment of every row in round len(history) - 1; the first one has no state to begin with."""
    stamp, width = len(history) - 1, ranges[-1].stop
    most = max(map(len, groups))

    def assign(batches):
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x = matrix(batch.column("v"), width)
            if stamp:
                read = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).copy()
                code, bounds, stamps = read("code", np.uint8).reshape(n, PARTS).astype(np.int64), read("bounds", np.float32).reshape(n, PARTS, most), read("stamps", np.uint8).reshape(n, PARTS, most)
            else:
                code, bounds, stamps = np.zeros((n, PARTS), np.int64), np.zeros((n, PARTS, most), np.float32), np.zeros((n, PARTS, most), np.uint8)
            error = np.zeros(n, np.int64)
            for p, cut in enumerate(ranges):
                part = code[:, p].copy()
                error += _scan_part(x[:, cut], [h[p] for h in history], groups[p], stamp, part, bounds[:, p], stamps[:, p], not stamp)
                code[:, p] = part
            packed = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("id", "tag", "v")], packed(code.astype(np.uint8)), pa.array(error), packed(bounds), packed(stamps)],
                names=["id", "tag", "v", "code", "error", "bounds", "stamps"],
            )

    return assign


def _sums(entries: int, ranges: list[slice]):
    width, widest = ranges[-1].stop, max(r.stop - r.start for r in ranges)

    def add(batches):
        count, total = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, widest), np.int64)
        for batch in batches:
            x = matrix(batch.column("v"), width)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(batch), PARTS)
            for p, cut in enumerate(ranges):
                count[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(total[p][:, : cut.stop - cut.start], code[:, p], x[:, cut])
        part, entry = np.nonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * widest), pa.array(total[part, entry].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), lists], names=["part", "entry", "n", "total"])

    return add


def codes(
    table: DataFrame, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", tag_col: str | None = None
) -> tuple[DataFrame, list[np.ndarray]]:
    """(``id, tag, code, error`` of every vector kept, the final codebooks); ``code`` holds a byte per part."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: entries must lie between 1 and 256")
    spark, work = table.sparkSession, Scratch(table.sparkSession, "codebooks")
    rows = work.write(integer_rows(table, id_col, vector_col, scale, F.col(tag_col) if tag_col else None), "all")
    most = rows.groupBy("n").agg(F.count("*").alias("c")).agg(F.max(F.struct("c", "n")).alias("m")).first()["m"]
    width = most["n"] if most else 0
    rows = rows.where(F.col("n") == width).select("id", "tag", "v")
    first = rows.where("id is not null").select("id", "v").orderBy("id", "v").limit(entries).collect()
    tag = rows.schema["tag"].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"id long, tag {tag}, code binary, error long"), []
    ranges, start = part_ranges(width), matrix([r["v"] for r in first], width)
    history = [[start[:, cut].copy() for cut in ranges]]
    groups = [entry_groups(book) for book in history[0]]
    widest = max(r.stop - r.start for r in ranges)
    for no in range(rounds + 1):
        rows = work.write(rows.mapInArrow(_round(history, groups, ranges), f"id long, tag {tag}, v binary, {STATE}"), f"round-{no}")
        work.drop(*(["all"] if no == 0 else [f"round-{no - 1}"]))
        if no == rounds:
            break
        sums = rows.select("v", "code").mapInArrow(_sums(len(start), ranges), "part int, entry int, n long, total array<long>")
        sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(widest)]).alias("total"))
        books = [book.copy() for book in history[-1]]
        for row in sums.collect():  # a row per entry
            book = books[row["part"]]
            book[row["entry"]] = [floors(t, row["n"]) for t in row["total"][: book.shape[1]]]
        history.append(books)
    return rows.select("id", "tag", "code", "error"), history[-1]


def code_report(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """``id_col, code, error, label_error, codebooks_sha256`` of every vector kept.

    Sums above the largest long are given as the largest long.
    """
    found, books = codes(table, id_col=id_col, vector_col=vector_col, tag_col=label_col, **options)
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    labels = found.groupBy(F.col("tag").alias("label")).agg(total.alias("label_error"))
    joined = found.join(labels, F.col("tag").eqNullSafe(F.col("label")))
    return joined.select(F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def code_sql(entries: int = 256, rounds: int = 4, scale: int = 1024, width: int = 64) -> str:
    """The rows of ``code_report`` over the embeddings, every part compared with every entry."""
    size = width // PARTS
    parts = [
        f"""k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"x AS MATERIALIZED (SELECT vec_id, p, v[p * {size} + 1 : (p + 1) * {size}] AS v FROM k, range({PARTS}) t(p))",
        f"""c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM x
  WHERE vec_id IN (SELECT vec_id FROM k WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT {entries}))""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT x.vec_id, x.p, min(struct_pack(d := list_inner_product(x.v, x.v) + list_inner_product(c.v, c.v) - 2 * list_inner_product(x.v, c.v), e := c.e)) AS m,
  any_value(x.v) AS v FROM x JOIN c{r} c USING (p) GROUP BY 1, 2)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(u.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS v FROM (
  SELECT p, m.e AS e, i, floor(sum(v[i]) / count(*)) AS x FROM a{r}, range(1, {size + 1}) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2) u USING (p, e))"""
            )
    parts.append(f"f AS MATERIALIZED (SELECT vec_id, string_agg(lower(printf('%02x', m.e)), '' ORDER BY p) AS code, sum(m.d)::bigint AS error FROM a{rounds} GROUP BY 1)")
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::bigint AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::bigint::varchar), ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256 FROM f JOIN k USING (vec_id)"""
    )

"""Embedding near-dedup by collision counting over sorted one-dimensional projections.

Unit vectors with a cosine of ``c`` are ``d = sqrt(2 - 2c)`` apart, and a Gaussian projection of them differs by a normal
variable of deviation ``d``. For each of many projections the vectors are sorted, and a window centred on each finds those
that collide with it. A pair that collides often enough is verified. How often is enough follows from the wanted recall: it is
the count that a pair exactly at the threshold reaches but for the part that may be missed.

Sorting all vectors in one place would leave each window a fixed share of them, so they are first dealt into cells, by a few
further projections cut at random shifts, in several independent tables; number and depth of the tables follow from the
recall and from a bounded sample that tells how crowded cells are. Collisions are counted inside cells. A crowded cell is dealt
into chunks and its chunks are met two by two, each couple a group of its own, so that no task holds a whole cell. A pair counts only
in the first table whose cell it shares.

Tasks emit what each vector gains in links and a spanning forest of the links they verified, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgewise.llm.common import mix
from lodgewise.llm.components import components
from lodgewise.session import stored

SAMPLE = 1_024
CELL = 1_024  # vectors that a vector should meet in its cell, of those unlike it
_PROJECTIONS = 16
_WINDOW = 2.2  # half a window, in distances at the threshold
_CELL_WIDTH = 4.0
_MOST_TABLES = 32  # keeps cells from being cut so finely that the recall would take more tables than that
_BUFFER = 1 << 14  # rows whose groups are counted in one numpy pass
_PAIRS = 1 << 20  # collisions of one projection held at once


def _normal_tail(x: float) -> float:
    """Chance that a standard normal variable is above ``x``."""
    return math.erfc(x / math.sqrt(2)) / 2


@dataclass(frozen=True)
class Plan:
    """How vectors are dealt and when a pair is verified."""

    threshold: float
    depth: int  # projections that name a cell
    tables: int
    hits: int  # collisions out of ``_PROJECTIONS`` that make a candidate
    block: int  # rows of one chunk of a cell
    seed: int

    @property
    def distance(self) -> float:
        return max(math.sqrt(max(0.0, 2 - 2 * self.threshold)), 1e-6)

    def directions(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Projections that deal, their shifts, and projections that count, for vectors of one length."""
        rng = np.random.default_rng([self.seed, dim])
        counting = rng.standard_normal((dim, _PROJECTIONS))
        dealing = rng.standard_normal((dim, self.tables * self.depth))
        return dealing, rng.random(self.tables * self.depth), counting


def same_cell(depth: int) -> float:
    """Chance that a pair at the threshold shares a cell that ``depth`` projections name."""
    r = _CELL_WIDTH
    one = 1 - 2 * _normal_tail(r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))
    return one**depth


def tables_for(depth: int, miss: float) -> int:
    return 1 if depth == 0 else math.ceil(math.log(miss) / math.log(1 - same_cell(depth)))


def hits_for(miss: float) -> int:
    """The greatest count that a pair at the threshold fails with a chance of at most ``miss``."""
    p = 1 - 2 * _normal_tail(_WINDOW)
    below, k = 0.0, 0
    while True:
        below += math.comb(_PROJECTIONS, k) * p**k * (1 - p) ** (_PROJECTIONS - k)
        if below > miss:
            return max(k, 1)
        k += 1


def plan(sample: np.ndarray, n: int, threshold: float = 0.95, recall: float = 0.99, seed: int = 7, cell: int = CELL, block: int | None = None) -> Plan:
    """The shallowest cells in which ``n`` vectors like the sampled ones meet at most ``cell`` others that are unlike them."""
    miss = (1 - recall) / 2
    dim = sample.shape[1] if sample.size else 1
    block = block or int(np.clip((1 << 20) // max(dim, 1), 256, 2048))
    unit = _unit(sample) if sample.size else sample
    depth = 0
    if n > cell and len(unit) > 1:
        a, b = np.triu_indices(len(unit), 1)
        unlike = (unit @ unit.T)[a, b] < threshold
        a, b = a[unlike], b[unlike]
        width = _CELL_WIDTH * max(math.sqrt(max(0.0, 2 - 2 * threshold)), 1e-6)
        rng = np.random.default_rng([seed, dim, 1])
        trials = [np.ones(len(a), bool) for _ in range(4)]
        while len(a) and n * np.mean([t.mean() for t in trials]) > cell and tables_for(depth + 1, miss) <= _MOST_TABLES:
            depth += 1
            for t in trials:
                place = np.floor(unit @ rng.standard_normal(dim) / width + rng.random())
                t &= place[a] == place[b]
    return Plan(threshold, depth, tables_for(depth, miss), hits_for(miss), block, seed)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest part is taken out first, so that no square overflows or vanishes."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets, np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, values[offsets[rows][:, None] + np.arange(dim)]


def _cells(vectors: np.ndarray, how: Plan) -> np.ndarray:
    """The cell of each vector in each table."""
    n, dim = vectors.shape
    out = np.full((n, how.tables), dim, np.uint64)
    if how.depth:
        dealing, shift, _ = how.directions(dim)
        place = np.floor(_unit(vectors) @ dealing / (_CELL_WIDTH * how.distance) + shift).astype(np.int64)
        place = place.astype(np.uint64).reshape(n, how.tables, how.depth)
        for k in range(how.depth):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + place[:, :, k])
    return out


def _with_cells(how: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.empty((batch.num_rows, how.tables), np.uint64)
            for rows, vectors in _by_length(batch.column("embedding")):
                cells[rows] = _cells(vectors, how)
            offsets = pa.array(np.arange(batch.num_rows + 1) * how.tables, pa.int32())
            listed = pa.ListArray.from_arrays(offsets, pa.array(cells.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "n", "embedding")), listed], ["node", "n", "embedding", "cells"])

    return run


def _windows(group: np.ndarray, places: np.ndarray, half: float, hits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group that collide in at least ``hits`` projections, a bounded number at a time.

    ``places`` has a row for each projection. A pair that may miss ``m`` projections collides in one of the first ``m + 1``; it
    is taken up in the first of them, so it comes once.
    """
    projections, n = places.shape
    spare = projections - hits
    span = 2 * (np.abs(places).max() + half) + 1
    for r in range(spare + 1):
        key = group * span + places[r]
        order = np.argsort(key, kind="stable")
        key = key[order]
        count = np.searchsorted(key, key + half, side="right") - np.arange(n) - 1
        upto = np.concatenate([[0], np.cumsum(count)])
        low = 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(upto, upto[low] + _PAIRS, side="right")) - 1)
            many = count[low:high]
            first = np.repeat(np.arange(low, high), many)
            second = first + 1 + np.arange(len(first)) - np.repeat(upto[low:high] - upto[low], many)
            a, b = order[first], order[second]
            low = high
            for s in range(r):
                fresh = np.abs(places[s][a] - places[s][b]) > half
                a, b = a[fresh], b[fresh]
            missed = np.full(len(a), r, np.int8)
            for s in range(r + 1, projections):
                missed += np.abs(places[s][a] - places[s][b]) > half
                near = missed <= spare
                if near.sum() < 0.8 * len(a) or s == projections - 1:
                    a, b, missed = a[near], b[near], missed[near]
            if len(a):
                yield a, b


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the trees of each pair; ``label`` names the least row of a tree for each of its rows, before and after."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            upper = label[label]
            if np.array_equal(upper, label):
                break
            label[:] = upper


_LINKED = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _count_group(table: pa.Table, group: np.ndarray, how: Plan) -> Iterator[pa.RecordBatch]:
    column = {c: table.column(c).to_numpy() for c in ("node", "n", "tab", "side", "a", "b")}
    cells = table.column("cells").combine_chunks()
    cells = cells.flatten().to_numpy().reshape(len(cells), -1)
    for rows, vectors in _by_length(table.column("embedding")):
        unit = _unit(vectors)
        _, _, counting = how.directions(vectors.shape[1])
        places = np.ascontiguousarray((unit @ counting).T)
        node, n, tab, side = (column[c][rows] for c in ("node", "n", "tab", "side"))
        alone = (column["a"] == column["b"])[rows]
        label, links = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        step = max(1024, (1 << 21) // vectors.shape[1])
        for a, b in _windows(group[rows], places, _WINDOW * how.distance, how.hits):
            fit = alone[a] | (side[a] != side[b])
            a, b = a[fit], b[fit]
            fit = (cells[rows[a]] == cells[rows[b]]).argmax(1) == tab[a]
            a, b = a[fit], b[fit]
            for at in range(0, len(a), step):
                x, y = a[at : at + step], b[at : at + step]
                near = np.einsum("ij,ij->i", unit[x], unit[y]) >= how.threshold
                x, y = x[near], y[near]
                np.add.at(links, x, n[y])
                np.add.at(links, y, n[x])
                _unite(label, x, y)
        got = np.flatnonzero(links)
        if len(got):
            yield pa.RecordBatch.from_arrays([pa.array(node[got]), pa.array(links[got]), pa.array(node[label[got]])], schema=_LINKED)


_GROUP = ["block", "tab", "cell", "a", "b"]


def _linked(how: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            kept = more if kept is None else pa.concat_tables([kept, more])
            if kept.num_rows < _BUFFER:
                continue
            group = _numbered(kept)
            whole = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if whole:
                yield from _count_group(kept.slice(0, whole), group[:whole], how)
                kept = kept.slice(whole)
        if kept is not None and kept.num_rows:
            yield from _count_group(kept, _numbered(kept), how)

    return run


def _numbered(table: pa.Table) -> np.ndarray:
    changes = np.zeros(table.num_rows, bool)
    for c in _GROUP:
        x = table.column(c).to_numpy()
        changes[1:] |= x[1:] != x[:-1]
    return np.cumsum(changes)


def _dealt(cells: DataFrame, how: Plan) -> DataFrame:
    """One row per vector and group it is in; cells of one vector are left out, cells of many rows are cut into couples of chunks."""
    crowd = cells.select(F.posexplode("cells").alias("tab", "cell")).groupBy("tab", "cell").agg(F.count("*").alias("size"))
    crowd = crowd.where("size > 1").select("tab", "cell", F.ceil(F.col("size") / how.block).alias("chunks"))
    rows = cells.select("node", "n", "embedding", "cells", F.posexplode("cells").alias("tab", "cell"))
    chunk = F.pmod(F.xxhash64("node"), "chunks")
    rows = rows.join(stored(crowd, "cells"), ["tab", "cell"]).withColumn("chunk", chunk)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    rows = rows.withColumns({"a": F.least("chunk", "other"), "b": F.greatest("chunk", "other"), "side": F.col("chunk") > F.col("other")})
    rows = rows.withColumn("block", F.xxhash64("tab", "cell", "a", "b"))
    return rows.select(*_GROUP, F.col("side").cast("int").alias("side"), "node", "n", "embedding", "cells")


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, recall: float = 0.99, seed: int = 7, cell: int = CELL, block: int | None = None
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors (vec_id, embedding)``.

    Rows whose cosine, in double precision, is at least ``threshold`` are linked. ``n_links`` counts the other rows that a row is
    linked with directly, ``component_id`` is the least id reachable by links, the row's own included, and ``kept`` marks the rows
    that carry it. No pair below the threshold is linked; one at the threshold is found with a chance of ``recall`` or more, closer ones more
    surely. Equal vectors are one class throughout and are never paired with each other.

    A vector that is NULL, empty, all zero, or holds a NULL or a non-finite part is linked with nothing; vectors of different
    lengths are not compared. A repeated ``vec_id`` is a vector of its own, a NULL one loses to any other as component id.
    The cells' depth is fitted on at most 1,024 vectors, and ``cell`` and ``block`` say how many meet in a cell and in a task; every vector is dealt, counted and returned. Other columns are not read.
    """
    element = vectors.schema["embedding"].dataType.elementType
    kind = "array<float>" if isinstance(element, T.FloatType) else "array<double>"
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"))
    unfit = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col("embedding").isNotNull() & ~F.coalesce(unfit, F.lit(True)) & F.exists("embedding", lambda x: x != 0)
    classes = rows.where(fit).groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    how = _fitted(classes, threshold, recall, seed, cell, block)
    cells = classes.select("node", "n", "embedding").mapInArrow(
        _with_cells(how), f"node bigint, n bigint, embedding {kind}, cells array<bigint>"
    )
    grouped = _dealt(cells, how).repartition("block").sortWithinPartitions(*_GROUP)
    linked = stored(grouped.mapInArrow(_linked(how), "node bigint, links bigint, root bigint"), "links")
    roots = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    near = linked.groupBy("node").agg(F.sum("links").alias("links"))
    found = classes.join(near, "node", "left").join(roots, "node", "left")
    found = stored(
        found.select(
            "embedding",
            "low",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("bigint").alias("n_links"),
            F.coalesce("root", "node").alias("root"),
        ),
        "classes",
    )
    least = stored(found.groupBy("root").agg(F.min("low").alias("component_id")), "roots")
    named = found.join(least, "root").select("embedding", "n_links", "component_id", F.lit(True).alias("fit"))
    return rows.join(named, "embedding", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.when(F.col("fit"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
        F.when(F.col("fit"), F.col("component_id").eqNullSafe(F.col("vec_id"))).otherwise(True).alias("kept"),
    )


def _fitted(classes: DataFrame, threshold: float, recall: float, seed: int, cell: int, block: int | None) -> Plan:
    """The plan for these vectors, from their number and the sampled ones of the commonest length."""
    n = classes.count()
    taken = classes.select("embedding").orderBy(F.xxhash64("node", F.lit(seed))).limit(SAMPLE).collect() if n else []
    sizes = [len(r[0]) for r in taken]
    dim = max(set(sizes), key=sizes.count) if sizes else 0
    alike = [r[0] for r in taken if len(r[0]) == dim]
    sample = np.array(alike, np.float64).reshape(len(alike), dim)
    return plan(sample, n, threshold, recall, seed, cell, block)

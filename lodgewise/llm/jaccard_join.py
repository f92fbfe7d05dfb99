"""N-gram Jaccard join by parity sketches.

A sketch has blocks; each token of a set is XORed, as a hash, into the one block that it falls to. Two sets differ in
at most as many blocks as they differ in tokens. Sets that reach the threshold differ in few tokens for their size, so
with more blocks than that some block is equal: sets are joined on equal blocks, band by band of set sizes. A second
sketch of single bits bounds the difference of each candidate pair from below, and the rest is verified token by token.
Sets of more tokens than that sketch has bits are held to it by a longer one as well: a short one is as full for any two
long sets, however they differ, and what it lets through grows with the square of their number.

Equal sets are one node from the start. Within the sets that share a block, all are compared with one of them, the
best connected; only sets that this leaves in different components are compared with one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgewise.llm.common import SMALL_SLICE_BYTES, WORD, Words, as_long, mix, slices, text_or_empty, unused
from lodgewise.llm.components import components
from lodgewise.session import fresh_folder, remove, stored

#: 64-bit words of the bit sketch, and its columns.
SKETCH = 8
_SKETCH = [f"s{i}" for i in range(SKETCH)]
#: A band's greatest size is about this many times its least.
BAND = 1.4
#: Ways to deal tokens to blocks, of which most sets need the first alone.
SEEDS = 8
#: Sets whose blocks a task has written are remembered up to this number, so that copies write none.
_REMEMBERED = 200_000


class Bands:
    """Bands of set sizes and, for each, how many tokens a linked pair may differ in and how many blocks there are."""

    def __init__(self, threshold: Fraction, largest: int):
        self.threshold = threshold
        lows = [1]
        while lows[-1] <= largest:
            lows.append(max(lows[-1] + 1, int(lows[-1] * BAND)))
        self.low = np.array(lows[:-1], np.int64)
        high = np.array(lows[1:], np.int64) - 1
        share = (1 - threshold) / (1 + threshold)
        # a set of the band is compared with equal or larger ones, up to this size
        self.reach = np.array([int(h / threshold) for h in high.tolist()], np.int64)
        self.differ = np.array([int(share * (h + r)) for h, r in zip(high.tolist(), self.reach.tolist())], np.int64)
        self.spare = np.array([self._spare(*x) for x in zip(self.low.tolist(), self.differ.tolist())], np.int64)
        self.blocks = self.differ + 1 + self.spare

    @staticmethod
    def _spare(low: int, differ: int) -> int:
        """As many blocks to spare as the least sets of a band leave empty, and one deviation more, so that few deal twice.

        Where no number will do, as sets that small may differ in nearly all of their tokens, the least one is taken.
        """
        least = 1 + differ // 20
        # with any number of blocks, at least ``blocks - low`` are empty
        for spare in range(least, low + 1 if low > differ + 1 else least, 1 + differ // 200):
            blocks = differ + 1 + spare
            empty = blocks * (1 - 1 / blocks) ** low
            if spare >= int(empty + empty**0.5):
                return spare
        return least

    def of(self, size: np.ndarray) -> Iterator[np.ndarray]:
        """The bands that sets of these sizes belong to, one after the other; -1 where there is no further one."""
        band = np.searchsorted(self.low, size, side="right") - 1
        while (band >= 0).any():
            # linked sets of these sizes are equal where no token may differ
            yield np.where((band >= 0) & (self.differ[band] > 0), band, -1)
            below = np.maximum(band - 1, 0)
            band = np.where((band > 0) & (self.reach[below] >= size), below, -1)


def token_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-word shingles of all texts, text by text in order, and each text's number of them.

    A text of fewer than n words has the whole sequence as one shingle; one without words has none.
    """
    hashes = words.hashes()
    counts = words.counts()
    salt = np.uint64(0xD6E8FEB86659FD93)
    grams = np.zeros(len(hashes), np.uint64)
    last = words.first[words.text + 1] if len(hashes) else np.empty(0, np.int64)
    length = np.zeros(len(hashes), np.int64)
    place = np.arange(len(hashes))
    for k in range(n):
        inside = place + k < last
        grams[inside] = grams[inside] * salt + hashes[(place + k)[inside]]
        length += inside
    grams = mix(grams + length.astype(np.uint64) * np.uint64(_SALT))
    whole = (length == n) | (place == (words.first[words.text] if len(hashes) else 0))
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for i in np.flatnonzero(counts):
        low, high = words.first[i], words.first[i + 1]
        found = np.unique(grams[low:high][whole[low:high]])
        sets.append(found)
        sizes[i] = len(found)
    return np.concatenate([*sets, np.empty(0, np.uint64)]), sizes


_SALT = 0x9E3779B97F4A7C15


def nodes(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each set, the same for equal sets."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens), dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64) * np.uint64(_SALT))


def bit_sketches(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of 64-bit words per set; each token turns one bit over."""
    bits = 64 * SKETCH
    owner = np.repeat(np.arange(len(sizes)), sizes)
    flips = np.bincount(owner * bits + (tokens % np.uint64(bits)).astype(np.int64), minlength=len(sizes) * bits) & 1
    return np.packbits(flips.astype(np.uint8).reshape(len(sizes), bits), axis=1).view(np.uint64)


def long_sketches(tokens: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """A sketch of at least one bit for each token, a power of two, for sets of more tokens than `bit_sketches` has bits."""
    ends = np.cumsum(sizes)
    out: list[bytes | None] = [None] * len(sizes)
    for i in np.flatnonzero(sizes > 64 * SKETCH).tolist():
        bits = 1 << (int(sizes[i]) - 1).bit_length()
        flips = np.bincount((tokens[ends[i] - sizes[i] : ends[i]] % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
        out[i] = np.packbits(flips.astype(np.uint8)).tobytes()
    return out


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two long sketches differ, the longer one folded; the sets differ in as many tokens at least."""
    n = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, n), axis=0) for x in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def block_keys(tokens: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) for the blocks of all sets; linked sets that differ have a key in common.

    Linked sets of a band have more than ``spare`` equal blocks. If one has at most ``spare`` empty blocks, one of the
    equal blocks is not empty, so empty ones are left out. A set with more deals its tokens anew, with the next seed,
    and so does any set linked to it that is in the same position; what the last seed leaves writes its empty blocks.
    """
    first = np.concatenate([[0], np.cumsum(sizes)])
    out_set, out_key = [], []
    for band in bands.of(sizes):
        todo = np.flatnonzero(band >= 0)
        for seed in range(SEEDS):
            if not len(todo):
                break
            n = sizes[todo]
            row = np.repeat(first[todo] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            mine = tokens[row]
            blocks = bands.blocks[band[todo]]
            start = np.concatenate([[0], np.cumsum(blocks)])
            dealt = mix(mine + np.uint64((seed + 1) * _SALT % (1 << 64)))
            cell = np.repeat(start[:-1], n) + (dealt % np.repeat(blocks, n).astype(np.uint64)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            sorted_cell = cell[order]
            begin = np.flatnonzero(np.concatenate([[True], sorted_cell[1:] != sorted_cell[:-1]]))
            content = np.bitwise_xor.reduceat(mix(dealt)[order], begin)
            full = sorted_cell[begin]
            owner = np.searchsorted(start, full, side="right") - 1
            empty = blocks - np.bincount(owner, minlength=len(todo))
            sparse = empty > bands.spare[band[todo]]
            if seed == SEEDS - 1 and sparse.any():
                missing = np.setdiff1d(np.concatenate([np.arange(start[i], start[i + 1]) for i in np.flatnonzero(sparse)]), full)
                full = np.concatenate([full, missing])
                content = np.concatenate([content, np.zeros(len(missing), np.uint64)])
                owner = np.searchsorted(start, full, side="right") - 1
            place = (full - start[owner]).astype(np.uint64)
            label = (band[todo][owner].astype(np.uint64) * np.uint64(SEEDS) + np.uint64(seed)) * np.uint64(1 << 40) + place
            out_set.append(todo[owner])
            out_key.append(mix(content ^ mix(label)))
            todo = todo[sparse]
    if not out_set:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(out_set), np.concatenate(out_key)


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("text").cast("string").alias("text"))


def sketched(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``node`` and the bit sketches for each row; ``node`` is null for empty sets, ``long`` for small ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SMALL_SLICE_BYTES):
            tokens, sizes = token_sets(Words(batch.column(1), lower=True), n)
            sketch = bit_sketches(tokens, sizes)
            node = pa.array(nodes(tokens, sizes).view(np.int64), pa.int64(), mask=sizes == 0)
            columns = [batch.column(0), as_long(sizes), node, *(as_long(np.ascontiguousarray(sketch[:, i])) for i in range(SKETCH))]
            columns.append(pa.array(long_sketches(tokens, sizes), pa.binary()))
            yield pa.record_batch(columns, names=["doc_id", "n_shingles", "node", *_SKETCH, "long"])

    schema = "doc_id bigint, n_shingles bigint, node bigint, " + ", ".join(f"{s} bigint" for s in _SKETCH) + ", long binary"
    return _texts(docs).mapInArrow(run, schema)


def keyed(docs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """``key``, ``node`` for each block of each set; a task writes copies of a set that it remembers once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bands = Bands(threshold, 1 << 10)
        for batch in slices(batches, "text", SMALL_SLICE_BYTES):
            tokens, sizes = token_sets(Words(batch.column(1), lower=True), n)
            node = nodes(tokens, sizes)
            fresh = np.zeros(len(sizes), bool)
            for i, x in enumerate(node.tolist()):
                if sizes[i] and x not in seen:
                    fresh[i] = True
                    seen.add(x)
            if len(seen) > _REMEMBERED:
                seen.clear()
            if sizes.max(initial=0) >= bands.low[-1]:
                bands = Bands(threshold, 2 * int(sizes.max()))
            tokens = tokens[np.repeat(fresh, sizes)]
            which, key = block_keys(tokens, sizes[fresh], bands)
            yield pa.record_batch([as_long(key), as_long(node[fresh][which])], names=["key", "node"])

    return _texts(docs).mapInArrow(run, "key bigint, node bigint")


def _could_link(threshold: Fraction) -> Column:
    """What the sizes and bit sketches of nodes u and v allow: their sets may still reach the threshold."""
    n, m = F.col("u_n"), F.col("v_n")
    p, q = threshold.numerator, threshold.denominator
    apart = sum((F.bit_count(F.col(f"u_{s}").bitwiseXOR(F.col(f"v_{s}"))) for s in _SKETCH), F.lit(0))
    return (F.least(n, m) * q >= F.greatest(n, m) * p) & (apart * (q + p) <= (n + m) * (q - p))


def _as(node: DataFrame, side: str) -> DataFrame:
    return node.select(F.col("node").alias(side), F.col("n_shingles").alias(f"{side}_n"), *[F.col(s).alias(f"{side}_{s}") for s in _SKETCH])


def screened(pairs: DataFrame, long: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs ``u``, ``v`` that may reach the threshold by their long sketches, or have none; ``n`` is both sets' size.

    ``long`` has ``node`` and ``long`` for the nodes of large sets.
    """
    both = pairs.join(long.toDF("u", "a"), "u", "left").join(long.toDF("v", "b"), "v", "left").select("u", "v", "n", "a", "b")
    p, q = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            size, a, b = (batch.column(c) for c in (2, 3, 4))
            for i in np.flatnonzero(np.asarray(a.is_valid()) & np.asarray(b.is_valid())).tolist():
                bits = apart(*(np.frombuffer(x[i].as_buffer(), np.uint64) for x in (a, b)))
                keep[i] = bits * (q + p) <= size[i].as_py() * (q - p)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))

    return both.mapInArrow(run, "u bigint, v bigint")


def linked(docs: DataFrame, pairs: DataFrame, firsts: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """The pairs ``u``, ``v`` of nodes whose sets reach the threshold, by all their tokens, stored.

    ``firsts`` has a row of ``docs`` by ``doc_id`` for each node. Only sets of nodes in pairs are moved, and their
    tokens don't stay on disk.
    """
    asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    rows = firsts.join(asked, "node").select(F.col("node").alias("want"), F.col("doc_id").alias("first"))
    texts = _texts(docs)
    texts = texts.join(rows, texts["doc_id"].eqNullSafe(rows["first"])).select("want", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SMALL_SLICE_BYTES):
            tokens, sizes = token_sets(Words(batch.column(1), lower=True), n)
            node, want = nodes(tokens, sizes).view(np.int64), np.asarray(batch.column(0))
            ends = np.cumsum(sizes)
            same = np.flatnonzero(node == want)  # rows of one id may differ in text
            found = [tokens[ends[i] - sizes[i] : ends[i]].tobytes() for i in same.tolist()]
            yield pa.record_batch([pa.array(want[same], pa.int64()), pa.array(found, pa.binary())], names=["node", "tokens"])

    sets = texts.mapInArrow(run, "node bigint, tokens binary").dropDuplicates(["node"])
    held = fresh_folder(docs.sparkSession, "token-sets")
    sets.write.parquet(held)
    sets = docs.sparkSession.read.schema(sets.schema).parquet(held)
    left = pairs.join(sets.withColumnsRenamed({"node": "u", "tokens": "a"}), "u")
    both = left.join(sets.withColumnsRenamed({"node": "v", "tokens": "b"}), "v").select("u", "v", "a", "b")
    p, q = threshold.numerator, threshold.denominator

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = q * common >= p * (len(a) + len(b) - common)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))

    links = stored(both.mapInArrow(verify, "u bigint, v bigint"), "links")
    remove(docs.sparkSession, held)
    return links


def rooted(docs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``node`` and ``root`` for each row; rows of one component have one root, empty sets none."""
    sets = stored(sketched(docs, n), "sets")
    told = sets.filter(F.col("node").isNotNull())
    node = stored(told.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n_shingles", *_SKETCH)]), "nodes")
    long = stored(told.filter(F.col("long").isNotNull()).select("node", "long").dropDuplicates(["node"]), "long-sketches")
    firsts = told.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    within = Window.partitionBy("key")
    shared = F.min("node").over(within) != F.max("node").over(within)
    keys = keyed(docs, n, threshold).withColumn("shared", shared).filter("shared").select("key", "node")
    members = stored(keys.distinct(), "members")
    # each shared block is led by the node that shares most blocks with most nodes: the original rather than a copy
    degree = members.join(members.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("node").agg(F.sum("n").alias("degree"))
    leads = members.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("lead"))
    leads = leads.select("key", F.col("lead.node").alias("u"))
    star = members.join(leads, "key").filter("node != u").select("u", F.col("node").alias("v")).distinct()
    allowed = star.join(_as(node, "u"), "u").join(_as(node, "v"), "v").filter(_could_link(threshold)).select("u", "v", (F.col("u_n") + F.col("v_n")).alias("n"))
    pairs = stored(screened(allowed, long, threshold), "pairs")
    links = linked(docs, pairs, firsts, n, threshold)
    roots = stored(components(links), "roots")
    # what shares a block and is in different components yet
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("key")
    rest = placed.join(open_keys, "key").join(node, "node")
    sides = [rest.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("root", *_SKETCH)], F.col("node").alias(s), F.col("n_shingles").alias(f"{s}_n")) for s in "uv"]
    meet = (sides[0]["key"] == sides[1]["key"]) & (F.col("u_root") < F.col("v_root")) & _could_link(threshold)
    across = sides[0].join(sides[1], meet).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), (F.col("u_n") + F.col("v_n")).alias("n")).distinct()
    done = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    more = stored(screened(across.join(done, ["u", "v"], "left_anti"), long, threshold), "pairs")
    links = links.unionByName(linked(docs, more, firsts, n, threshold))
    roots = components(links)
    placed = sets.select("doc_id", "n_shingles", "node").join(roots, "node", "left")
    return stored(placed.withColumn("root", F.coalesce("root", "node")), "placed")


def join(docs: DataFrame, n: int = 4, threshold: Fraction = Fraction(85, 100)) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``node`` for each row of ``docs``.

    Sets are the distinct n-word shingles of the whole text, A-Z in lower case; with fewer words, the whole sequence
    is one. Rows are linked where intersection over union reaches the threshold; ``component_id`` is the least
    ``doc_id`` of all that are reachable by links, a row's own included (null ids don't count, but pass links on).
    ``node`` numbers equal sets. Rows without words have no node, are linked with nothing, and are their own
    component. Repeated rows are linked like other equal texts; of other columns none is read; an empty table gives
    no rows.
    """
    placed = rooted(docs, n, threshold)
    least = placed.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    own = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return placed.join(least, "root", "left").select("doc_id", "n_shingles", own.alias("component_id"), "node")


def representatives(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(80, 100)) -> DataFrame:
    """One row of ``docs`` for each component, unchanged and with all columns; all rows without words stay.

    It is the row of the least ``doc_id`` (null only if there is no other), of rows of one id the one with the least
    set number, then with the least hash of all columns.
    """
    placed = rooted(docs, n, threshold).filter(F.col("root").isNotNull())
    known, number, nameless, place = (unused(name, docs.columns) for name in ("_node", "_id", "_nameless", "_row"))
    # plain keys, not a null-safe comparison: the window is dealt as the join is, and texts move once
    keys = [known, number, nameless]
    ids = {number: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), nameless: F.col("doc_id").cast("long").isNull()}
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "node")
    kept = placed.groupBy("root").agg(F.min(order).alias("kept")).select("kept.*")
    kept = kept.withColumns(ids).withColumnRenamed("node", known).select(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SMALL_SLICE_BYTES):
            tokens, sizes = token_sets(Words(batch.column(batch.schema.get_field_index("text")), lower=True), n)
            node = pa.array(nodes(tokens, sizes).view(np.int64), pa.int64(), mask=sizes == 0)
            yield pa.record_batch([*batch.columns, node], names=[*batch.schema.names, known])

    numbered = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(known, T.LongType())])).withColumns(ids)
    empty = docs.filter(~text_or_empty().rlike(WORD))
    chosen = numbered.join(kept, keys)
    first = Window.partitionBy(*keys).orderBy(F.xxhash64(*docs.columns))
    chosen = chosen.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1)
    return chosen.select(*docs.columns).unionByName(empty)

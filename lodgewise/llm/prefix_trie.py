"""Conversation prefix trie: a z-fast trie of turn sequences, built by batched insertion.

A conversation is a sequence of turns, a prefix the exclusive or of two 64-bit hashes of its (place, role, text), which
is summed in any order. The trie is compacted: a node stands where a conversation ends or two part, and its edge ``(s, e]``
covers the depths from its parent's to its own on the path of one conversation, the witness. Each edge is filed under its handle, the
prefix whose length is the two-fattest number of ``(s, e]``, the one that most powers of two divide.

All conversations that are not in yet look for their exit node at once, by fat binary search: each step halves the depths
that are left by one look at the handles, so that there are about log2 of the longest conversation's steps. Where they leave
the trie, the edge is split, and of those that leave at one place by the same turn one is inserted, chosen at random; the others go on
from there in the next batch. The chosen one is likely to follow most of the others, so batches are about as many as the
logarithm of the conversations, whatever the depth. Equal conversations are one from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgewise.llm.common import text_or_empty
from lodgewise.session import stored

_BLOCK_BITS = 12  # turns of a conversation that one window task holds: 4,096
_STEPS = 4  # of the search, between two stored states
_ENDS_BITS = 16  # ids of one node that are joined to a string at once: 65,536
ROOT = -1


@dataclass
class Trie:
    """The tables of a built trie.

    ``paths (conv, p, x1, x2, chars)``: each distinct conversation's prefixes, from the empty one on, with the code points of
    the texts so far. ``sequences (conv, length, x1, x2, copies)``: distinct conversations under their smallest id.
    ``ends (conv, length, x1, x2)``: every conversation and its whole prefix. ``edges (s, e, w, ...)``: the compacted nodes.
    """

    paths: DataFrame
    sequences: DataFrame
    ends: DataFrame
    edges: DataFrame


def _summed(rows: DataFrame, block: Column, order: list, sums: dict[str, Column], offsets: dict[str, Column]) -> DataFrame:
    """Running values per ``conv`` in bounded windows: inside a block of rows, plus the totals of the blocks before.

    ``sums`` are aggregates of a block; ``offsets`` says how what came before is added to the value inside.
    """
    rows = rows.withColumn("block", block)
    inside = Window.partitionBy("conv", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv", "block").agg(*[total.alias(name) for name, total in sums.items()])
    again = {"n": F.sum, "x1": F.bit_xor, "x2": F.bit_xor, "chars": F.sum}
    earlier = totals.select(
        "conv", "block", *[F.coalesce(again[name](name).over(before), F.lit(0)).alias(f"_{name}") for name in sums]
    )
    running = rows.withColumns({f"+{name}": total.over(inside) for name, total in sums.items()})
    joined = running.join(earlier, ["conv", "block"])
    return joined.withColumns({f"+{name}": offsets[name] for name in sums}).drop("block", *[f"_{name}" for name in sums])


def placed(conversations: DataFrame) -> DataFrame:
    """``(conv, i, t1, t2, chars)``: hashes and code points of each turn, numbered from 1 in its conversation.

    Turns are in order of ``turn``, NULL first, equal ones by role and text (by the MD5 of both). NULL role or text counts as
    empty. Rows without ``conv_id`` belong to no conversation and are left out; a repeated row is a further turn.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"),
        F.col("turn").cast("bigint").alias("turn"),
        F.md5(F.concat(role, F.lit("\n"), text)).alias("tie"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(text, F.lit(1), role).alias("t2"),
        F.char_length(text).cast("bigint").alias("chars"),
    )
    block = F.coalesce(F.shiftright("turn", _BLOCK_BITS), F.lit(-(1 << 62)))
    order = [F.asc_nulls_first("turn"), "tie", "t1", "t2"]
    numbered = _summed(turns, block, order, {"n": F.count("*")}, {"n": F.col("+n") + F.col("_n")})
    return numbered.select("conv", F.col("+n").alias("i"), "t1", "t2", "chars")


def spliced(turns: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that open like the first of their group: their lengths ``(conv, length)`` and their turns.

    Conversation ``c`` takes the first ``h = crc32(c) % heads`` turns of ``c - c % group``, as far as there are any, in place of its
    own first ``h`` turns.
    """
    turns = stored(turns, "turns")
    own = stored(turns.groupBy("conv").agg(F.count("*").alias("own")), "conversations")
    first = F.col("conv") - F.col("conv") % group
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    others = own.select(F.col("conv").alias("first"), F.col("own").alias("given"))
    convs = own.select("conv", "own", first.alias("first"), h.alias("h")).join(others, "first", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("given", F.lit(0))))
    length = F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    convs = stored(convs.select("conv", "first", "h", "k", length.alias("length")), "spliced")
    opening = turns.where((F.col("conv") % group == 0) & (F.col("i") < heads)).withColumnRenamed("conv", "first")
    head = opening.join(convs, "first").where("i <= k").select("conv", F.col("i").alias("p"), "t1", "t2", "chars")
    tail = turns.join(convs, "conv").where("i > h").select("conv", (F.col("i") - F.col("h") + F.col("k")).alias("p"), "t1", "t2", "chars")
    return convs.select("conv", "length"), head.unionByName(tail)


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: lengths and turns, as `build` takes them."""
    turns = stored(turns, "turns")
    return turns.groupBy("conv").agg(F.count("*").alias("length")), turns.withColumnRenamed("i", "p")


def _prefixes(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    hashed = turns.select(
        "conv", "p", F.xxhash64("p", "t1", "t2").alias("x1"), F.xxhash64("t2", F.lit(7), "p", "t1").alias("x2"), "chars"
    )
    sums = {"x1": F.bit_xor("x1"), "x2": F.bit_xor("x2"), "chars": F.sum("chars")}
    add = {"x1": F.col("+x1").bitwiseXOR(F.col("_x1")), "x2": F.col("+x2").bitwiseXOR(F.col("_x2")), "chars": F.col("+chars") + F.col("_chars")}
    running = _summed(hashed, F.shiftright("p", _BLOCK_BITS), ["p"], sums, add)
    running = running.select("conv", "p", *[F.col(f"+{x}").alias(x) for x in sums])
    zero = F.lit(0).cast("bigint")
    return running.unionByName(lengths.select("conv", *[zero.alias(x) for x in ("p", "x1", "x2", "chars")]))


def _fattest(a: str, b: str) -> Column:
    """The two-fattest number of ``(a, b]``: the one with most zero bits at its end."""
    return F.expr(f"{b} & -shiftleft(1L, length(bin({a} ^ {b})) - 1)")


def _at(paths: DataFrame, conv: str, p: str, x1: str, x2: str) -> DataFrame:
    return paths.select(F.col("conv").alias(conv), F.col("p").alias(p), F.col("x1").alias(x1), F.col("x2").alias(x2))


def _keyed(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges ``(s, e, w)`` with the prefixes they are found by: handle, first turn and end."""
    depths = F.array(_fattest("s", "e"), F.col("s") + 1, F.col("e"))
    each = edges.select("s", "e", "w", F.posexplode(depths).alias("what", "p")).join(_at(paths, "w", "p", "x1", "x2"), ["w", "p"])
    names = ("h", "f", "n")
    keys = [F.max(F.when(F.col("what") == i, F.col(x))).alias(f"{n}{x[1]}") for i, n in enumerate(names) for x in ("x1", "x2")]
    return each.groupBy("s", "e", "w").agg(*keys).withColumn("f", _fattest("s", "e"))


_EDGE = "s bigint, e bigint, w bigint, h1 bigint, h2 bigint, f1 bigint, f2 bigint, n1 bigint, n2 bigint, f bigint"


def _search(pending: DataFrame, edges: DataFrame, paths: DataFrame, longest: int) -> DataFrame:
    """Fat binary search of each pending conversation between its known depth ``a`` and its length.

    Adds ``xs, xe, xw, xn1, xn2``: the deepest edge whose handle lies on the conversation's path, NULL where that is none
    below ``a``.
    """
    state = pending.withColumn("b", F.col("length"))
    state = state.withColumns({x: F.lit(None).cast("bigint") for x in ("xs", "xe", "xw", "xn1", "xn2")})
    handles = edges.select("f", "h1", "h2", *[F.col(c).alias(f"y{c}") for c in ("s", "e", "w", "n1", "n2")])
    for step in range(1, longest.bit_length() + 1):
        probe = state.withColumn("f", F.when(F.col("a") < F.col("b"), _fattest("a", "b")))
        probe = probe.join(_at(paths, "conv", "f", "h1", "h2"), ["conv", "f"], "left").join(handles, ["f", "h1", "h2"], "left")
        found = F.col("ye").isNotNull()
        state = probe.select(
            "conv",
            "length",
            F.when(found, F.col("ye")).otherwise(F.col("a")).alias("a"),
            F.when(found | F.col("f").isNull(), F.col("b")).otherwise(F.col("f") - 1).alias("b"),
            *[F.when(found, F.col(f"y{x}")).otherwise(F.col(f"x{x}")).alias(f"x{x}") for x in ("s", "e", "w", "n1", "n2")],
        )
        if step % _STEPS == 0 and step < longest.bit_length():
            state = stored(state, "search")
    return state


def _exits(pending: DataFrame, edges: DataFrame, paths: DataFrame, longest: int) -> DataFrame:
    """Where pending conversations leave the trie: ``(conv, length, x, e, w, k1, k2)``.

    ``x`` is the depth down to which the trie knows the conversation, ``w`` and ``e`` the edge on which that is, NULL at a node
    without an edge for the next turn, and ``k1, k2`` the prefix one turn further.
    """
    found = _search(pending, edges, paths, longest)
    found = found.join(_at(paths, "conv", "xe", "m1", "m2"), ["conv", "xe"], "left")
    # a handle on the path only says that the edge is entered; whether its end is on the path too, the prefix there tells
    through = F.col("xw").isNull() | (F.col("m1").eqNullSafe(F.col("xn1")) & F.col("m2").eqNullSafe(F.col("xn2")))
    found = found.withColumn("at", F.when(through, F.col("a"))).withColumn("next", F.col("at") + 1)
    children = edges.select((F.col("s") + 1).alias("next"), "f1", "f2", F.col("s").alias("cs"), F.col("e").alias("ce"), F.col("w").alias("cw"))
    found = found.join(_at(paths, "conv", "next", "f1", "f2"), ["conv", "next"], "left").join(children, ["next", "f1", "f2"], "left")
    inside = F.col("at").isNull()
    exits = found.select(
        "conv",
        "length",
        "at",
        *[F.when(inside, F.col(f"x{c}")).otherwise(F.col(f"c{c}")).alias(c) for c in ("s", "e", "w")],
    )
    exits = stored(exits, "exits")
    ranges = exits.where("w is not null").select("conv", "w", F.explode(F.sequence(F.col("s") + 1, F.least("e", "length"))).alias("p"))
    alike = ranges.join(_at(paths, "conv", "p", "x1", "x2"), ["conv", "p"]).join(_at(paths, "w", "p", "x1", "x2"), ["w", "p", "x1", "x2"])
    shared = alike.groupBy("conv").agg(F.max("p").alias("shared"))
    exits = exits.join(shared, "conv", "left").withColumn("x", F.coalesce("shared", "at", "s")).withColumn("next", F.col("x") + 1)
    exits = exits.join(_at(paths, "conv", "next", "k1", "k2"), ["conv", "next"], "left")
    return exits.select("conv", "length", "x", "e", "w", "k1", "k2")


def _split(edges: DataFrame, exits: DataFrame, leaves: DataFrame, paths: DataFrame) -> DataFrame:
    """The edges after a batch: cut where conversations left them, and the new ones."""
    cuts = exits.where("x < e").select("w", "e", F.col("x").alias("cut")).distinct()
    hit = edges.join(cuts.select("w", "e").distinct(), ["w", "e"], "left_semi").select("s", "e", "w")
    ends = hit.join(cuts, ["w", "e"]).unionByName(hit.withColumn("cut", F.col("e")))
    above = F.lag("cut").over(Window.partitionBy("w", "e").orderBy("cut"))
    pieces = ends.select(F.coalesce(above, F.col("s")).alias("s"), F.col("cut").alias("e"), "w")
    fresh = _keyed(pieces.unionByName(leaves), paths)
    return edges.join(cuts, ["w", "e"], "left_anti").select(*fresh.columns).unionByName(fresh)


def build(lengths: DataFrame, turns: DataFrame) -> Trie:
    """The trie of conversations given by ``lengths (conv, length)`` and ``turns (conv, p, t1, t2, chars)``.

    ``lengths`` has each conversation once, those without turns too.
    """
    spark = lengths.sparkSession
    lengths = stored(lengths, "lengths")
    prefixes = stored(_prefixes(lengths, turns), "prefixes")
    ends = lengths.join(prefixes.withColumnRenamed("p", "length"), ["conv", "length"]).drop("chars")
    ends = stored(ends, "ends")
    sequences = ends.groupBy("length", "x1", "x2").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    sequences = stored(sequences, "sequences")
    paths = stored(prefixes.join(sequences.select("conv"), "conv"), "paths")
    edges = stored(spark.createDataFrame([], _EDGE), "edges")
    pending = sequences.where("length > 0").select("conv", "length", F.lit(0).cast("bigint").alias("a"))
    longest = sequences.agg(F.max("length")).first()[0] or 0
    left = pending.count()
    while left:
        exits = stored(_exits(pending, edges, paths, longest), "places")
        # who leaves at the end of an edge has not looked beyond it
        out = exits.where("x < length and (e is null or x < e)")
        chosen = out.groupBy("x", "k1", "k2").agg(F.min(F.struct(F.xxhash64("conv").alias("luck"), "conv", "length")).alias("one"))
        leaves = stored(chosen.select(F.col("x").alias("s"), F.col("one.length").alias("e"), F.col("one.conv").alias("w")), "leaves")
        edges = stored(_split(edges, exits, leaves, paths), "edges")
        pending = exits.where("x < length").join(leaves.select(F.col("w").alias("conv")), "conv", "left_anti")
        pending = stored(pending.select("conv", "length", F.col("x").alias("a")), "pending")
        left = pending.count()
    return Trie(paths, sequences, ends, edges)


def _nodes(trie: Trie) -> tuple[DataFrame, DataFrame]:
    """Compacted nodes with what their subtrees hold, the root among them, and each distinct conversation's own node."""
    paths, sequences = trie.paths, trie.sequences
    edges = stored(trie.edges.select("s", "e", "w", "n1", "n2").withColumn("node", F.monotonically_increasing_id()), "numbered")
    on_path = paths.join(edges, (paths.p == edges.e) & (paths.x1 == edges.n1) & (paths.x2 == edges.n2)).select("conv", "node", "e")
    root = sequences.select("conv", F.lit(ROOT).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("e"))
    downwards = Window.partitionBy("conv").orderBy("e")
    stops = on_path.unionByName(root).withColumn("parent", F.lag("node").over(downwards))
    stops = stored(stops.join(sequences.select("conv", "length", "copies"), "conv"), "stops")
    nodes = stops.groupBy("node", "e").agg(F.sum("copies").alias("n"), F.min("conv").alias("owner"), F.min("parent").alias("parent"))
    depth = edges.select("node", "s", "w")
    nodes = nodes.join(depth, "node", "left").withColumns({"s": F.coalesce("s", F.lit(-1)), "w": F.coalesce("w", "owner")})
    nodes = stored(nodes, "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    at = F.array(F.greatest("s", F.lit(0)), F.greatest(F.col("e") - 1, F.lit(0)), F.col("e"))
    chars = nodes.select("node", "w", F.posexplode(at).alias("what", "p")).join(
        paths.select(F.col("conv").alias("w"), "p", "chars"), ["w", "p"]
    )
    chars = chars.groupBy("node").agg(
        *[F.max(F.when(F.col("what") == i, F.col("chars"))).alias(x) for i, x in enumerate(("chars_s", "chars_up", "chars_e"))]
    )
    nodes = nodes.join(children, "node", "left").join(chars, "node").na.fill(0, ["children"])
    edge = (F.col("n") - 1) * (F.col("chars_e") - F.col("chars_s"))
    nodes = stored(nodes.withColumn("edge", edge), "measured")
    upwards = Window.partitionBy("conv").orderBy(F.desc("e"))
    held = stops.join(nodes.select("node", "owner", "edge", "children"), "node").select(
        "conv",
        "node",
        # a subtree's edges, each told by its owner, and leaves, each told by the conversation that ends there
        F.sum(F.when(F.col("owner") == F.col("conv"), F.col("edge")).otherwise(0))
        .over(upwards.rowsBetween(Window.unboundedPreceding, -1))
        .alias("below"),
        (F.first("children").over(upwards) == 0).cast("bigint").alias("leaf"),
    )
    sums = held.groupBy("node").agg(F.coalesce(F.sum("below"), F.lit(0)).alias("below"), F.sum("leaf").alias("leaves"))
    saved = (F.col("n") - 1) * (F.col("chars_e") - F.col("chars_up")) + F.col("below")
    nodes = stored(nodes.join(sums, "node").withColumn("saved", saved), "summed")
    return nodes, stops.where("e = length").select("conv", "node")


def _digests(ends: DataFrame) -> DataFrame:
    """``(node, ends_sha256)``: the hash of the ascending, comma-joined ids of each node.

    Ids are joined by ranges of 65,536, and the ranges run through the hash one by one, so that no list of a node is ever whole.
    """
    schema = "node bigint, ends_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for at, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if at == node:
                    digest.update(b"," + ids.encode())
                else:
                    if digest is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["node", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["node", "ends_sha256"])

    ranges = ends.groupBy("node", F.shiftright("conv", _ENDS_BITS).alias("part"))
    ids = ranges.agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))).alias("ids"))
    return ids.repartition("node").sortWithinPartitions("node", "part").select("node", "ids").mapInArrow(run, schema)


def expand(trie: Trie) -> DataFrame:
    """One row per distinct prefix, unary ones too, with what holds of all conversations that start with it.

    ``conv_id`` the smallest of them, ``depth``, ``parent_conv_id`` that of the prefix one turn shorter (NULL at the root),
    ``n_convs``, ``n_children``, ``n_leaves`` of its subtree, ``saved_tokens``: summed over its subtree, the code points of the last
    text for each conversation but one; ``ends_sha256``: the hash of the ids that end there. No conversation gives no row, not even a root.
    """
    nodes, own = _nodes(trie)
    keys = trie.sequences.join(own, "conv").select("length", "x1", "x2", "node")
    ends = _digests(trie.ends.join(keys, ["length", "x1", "x2"]).select("node", "conv"))
    above = nodes.select(F.col("node").alias("parent"), F.col("owner").alias("parent_owner"))
    full = nodes.join(above, "parent", "left").join(ends, "node", "left")
    each = full.withColumn("depth", F.explode(F.sequence(F.col("s") + 1, F.col("e")))).withColumn("p", F.greatest(F.col("depth") - 1, F.lit(0)))
    each = each.join(trie.paths.select(F.col("conv").alias("w"), "p", "chars"), ["w", "p"])
    end = F.col("depth") == F.col("e")
    none = hashlib.sha256(b"").hexdigest()
    return each.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("s") + 1, F.col("owner")).otherwise(F.col("parent_owner")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(end, F.col("children")).otherwise(1).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.when(end, F.col("saved")).otherwise(F.col("saved") + (F.col("n") - 1) * (F.col("chars_up") - F.col("chars"))).alias("saved_tokens"),
        F.when(end, F.coalesce("ends_sha256", F.lit(none))).otherwise(F.lit(none)).alias("ends_sha256"),
    )


def prefixes(conversations: DataFrame) -> DataFrame:
    """The expanded trie of ``conversations (conv_id, turn, role, text)`` as they are; see `placed` and `expand`."""
    return expand(build(*whole(placed(conversations))))

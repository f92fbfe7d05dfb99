"""Mixing sources to target weights as a time-varying curriculum.

Each source has a schedule: a weight that runs linearly over training. Its integral gives the source's share of the
demand, in words; shares that exceed what a source may give are reshared. Documents of a source are laid end to end
in hash order, which makes each place on that line a point of the source's cumulative demand. Inverting the
integral turns that point into a training position between 0 and 1, and documents are range-sorted by it.

No window runs over a whole source: running totals are taken over hash buckets of a source, then within a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodgewise.llm.common import WORD, Words, as_long, slices, text_or_empty
from lodgewise.session import stored


@dataclass(frozen=True)
class Ramp:
    """A weight that runs from ``weight * start`` to ``weight * end``; the mean of start and end is 1."""

    weight: float
    start: float = 1.0
    end: float = 1.0

    def __post_init__(self):
        if self.weight <= 0 or min(self.start, self.end) <= 0 or abs(self.start + self.end - 2) > 1e-9:
            raise ValueError("weights and ramps are positive, and start and end of a ramp have the mean 1")


#: Weights repeat over the sources in code point order.
CYCLE = (Ramp(3.0, 0.5, 1.5), Ramp(1.0), Ramp(2.0, 1.4, 0.6))


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def targets(sized: DataFrame, cycle: tuple[Ramp, ...] = CYCLE, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``, ``start``, ``end``.

    The demand is ``share`` times all sizes, dealt by weight; a target stops at ``most`` times the source's size,
    and the excess is reshared by weight until none is above. That is the level l for which the sums of
    min(most * size, l * weight) reach the demand; taking sources by size over weight, the level that remains
    after the first ones are full rises up to l and falls beyond, so l is the largest of these levels.
    """
    if not 0 < share <= most:
        raise ValueError("the demand can't be met")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # from here on one row per source
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(cycle)
    ramps = F.array(*[F.struct(F.lit(r.weight).alias("weight"), F.lit(r.start).alias("start"), F.lit(r.end).alias("end")) for r in cycle])
    dealt = sources.withColumn("ramp", F.get(ramps, turn)).select("source", "source_size", "ramp.*")
    full = F.col("source_size") * F.lit(float(most))
    by_need = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    demand = F.sum("source_size").over(all_rows) * F.lit(float(share))
    left = demand - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    weights = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = dealt.withColumn("level", left / weights).withColumn("level", F.max("level").over(all_rows))
    return leveled.select(
        "source", "source_size", F.least(full, F.col("level") * F.col("weight")).alias("target"), "start", "end"
    )


def allot(
    docs: DataFrame, cycle: tuple[Ramp, ...] = CYCLE, share: float = 1.5, most: float = 2.0, measured: DataFrame | None = None
) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``taken``, ``laid``, ``start`` and ``end``; drops none.

    ``size`` counts the words of the text (null or empty: 0), ``laid`` the words of the source laid out before the
    document. The mix reads the line of a source from the beginning, and again when it ends, up to the target:
    ``taken`` is what it takes of the document, repeats counted, so a source's taken words are its target rounded
    down, and the last document may be taken in part. Null sources are one source. Documents lie in the order of
    the hash of their id, then size, then the text's hash: reruns agree, and repeated rows share what they get.
    Columns of these names, and any named like ``_place``, are replaced. ``measured`` is what `_measured` has stored.
    """
    own = ["size", "source_size", "target", "taken", "laid", "start", "end", "_place", "_hash", "_s", "_b", "_before", "_inside"]
    rows = docs.drop(*own).withColumns(_measures())
    return _placed(rows, _measured(docs) if measured is None else measured, cycle, share, most).drop("_hash")


def _measures() -> dict[str, Column]:
    """What lays a document out: its words, the hash of its id, and that of its text."""
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return {"size": word_count(), "_place": place, "_hash": F.xxhash64(text_or_empty())}


def _measured(docs: DataFrame) -> DataFrame:
    """The documents without their texts; the texts are read once for all that counts words alone."""
    measures = [value.alias(name) for name, value in _measures().items()]
    return stored(docs.select("doc_id", "source", *measures), "measured")


def _placed(rows: DataFrame, measured: DataFrame, cycle: tuple[Ramp, ...], share: float, most: float) -> DataFrame:
    """The columns of `allot` for rows that have their measures; what is joined to them is stored, so that its size is known."""
    keys = {"_s": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")), "_b": F.substring("_place", 1, 3)}
    dealt = targets(measured.select("source", "size"), cycle, share, most)  # one row per source
    dealt = dealt.withColumn("_s", keys["_s"]).drop("source")
    sums = measured.withColumns(keys).groupBy("_s", "_b").agg(F.sum("size").alias("_sum"))
    until = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_s", "_b", F.coalesce(F.sum("_sum").over(until), F.lit(0)).alias("_before"))
    offsets = stored(before.join(dealt, "_s"), "offsets")
    inside = Window.partitionBy("_s", "_b").orderBy("_place", "size", "_hash").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumns(keys).withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # keys that are never null and the window's own: the rows stay where the window has them
    joined = laid.join(offsets, ["_s", "_b"]).withColumn("laid", F.col("_before") + F.col("_inside"))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target") - rounds * F.col("source_size"))
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("laid")))
    return joined.withColumn("taken", taken.cast("long")).drop("_place", "_s", "_b", "_before", "_inside")


def position(demanded: Column) -> Column:
    """The training position at which a source with ``target``, ``start`` and ``end`` has demanded so many words."""
    x = F.when(F.col("target") > 0, F.least(F.lit(1.0), demanded / F.col("target"))).otherwise(F.lit(0.0))
    start, rise = F.col("start"), F.col("end") - F.col("start")
    return 2 * x / (start + F.sqrt(start * start + 2 * rise * x))


def first_position() -> Column:
    return F.when(F.col("taken") > 0, position(F.col("laid").cast("double")))


def copies(
    docs: DataFrame, cycle: tuple[Ramp, ...] = CYCLE, share: float = 1.5, most: float = 2.0, measured: DataFrame | None = None
) -> DataFrame:
    """The rows of `mix` with the columns of `allot`, ``_copy``, ``_words`` (that the copy has) and ``_at`` (its position)."""
    told, words = allot(docs, cycle, share, most, measured), F.col("_words")
    copies = F.greatest(F.lit(1), F.ceil(F.col("taken") / F.greatest(F.lit(1), F.col("size")))).cast("int")
    told = told.filter((F.col("taken") > 0) | (F.col("size") == 0))
    told = told.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    told = told.withColumn("_words", F.least(F.col("size"), F.col("taken") - F.col("_copy") * F.col("size")))
    told = told.withColumn("_at", position((F.col("_copy") * F.col("source_size") + F.col("laid")).cast("double")))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")
    told = told.withColumn("text", F.when(words < F.col("size"), part).otherwise(F.col("text")))
    order = ["_at", "doc_id", "_copy"]
    return told.repartitionByRange(*order).sortWithinPartitions(*order)


def tally(docs: DataFrame, cycle: tuple[Ramp, ...] = CYCLE, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``doc_id``, ``source`` and the columns of `allot`, but ``taken`` counts the words of the sorted copies: of each row of ``docs``, 0 without copies."""
    key = ["doc_id", "source", "size", "laid"]
    measured = _measured(docs)
    texts = docs.select("doc_id", "source", "text")
    mixed = copies(texts, cycle, share, most, measured).select(*[F.col(c).alias(f"_{c}") for c in key], "text")
    columns = [f"_{c}" for c in key]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = as_long(Words(batch.column(len(columns))).counts().astype("int64"))
            yield pa.record_batch([*batch.columns[: len(columns)], words], names=[*columns, "_n"])

    # a plain aggregate would let Spark leave out the sort
    emitted = mixed.mapInArrow(counted, StructType([*mixed.schema.fields[:-1], StructField("_n", LongType())]))
    emitted = emitted.groupBy(*columns).agg(F.sum("_n").alias("_taken"))
    told = _placed(measured, measured, cycle, share, most).drop("taken", "_hash")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    joined = told.join(emitted, same, "left").withColumn("taken", F.coalesce("_taken", F.lit(0)).cast("long"))
    return joined.drop("_taken", *columns)


def mix(docs: DataFrame, cycle: tuple[Ramp, ...] = CYCLE, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixed documents, one row per copy, sorted by training position; the columns of ``docs`` and no others.

    A document comes once for each time that its source's line is read over it. A copy that is taken in part has
    its first words, joined by one blank, and ``n_chars`` (if there) counts them. Documents without words take no
    part in the demand and come once, at their source's beginning; with an empty table the result is empty.
    """
    used = ["doc_id", "source", "text"]
    others = [c for c in docs.columns if c not in used]  # out of the way of the columns that are added here
    rest = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("_rest")] if others else []
    ordered = copies(docs.select(*used, *rest), cycle, share, most)
    columns = {c: F.col(c) if c in used else F.col(f"_rest.`{c}`") for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("_words") < F.col("size"), F.char_length("text").cast("long")).otherwise(columns["n_chars"])
    return ordered.select(*[value.alias(name) for name, value in columns.items()])

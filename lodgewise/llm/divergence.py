"""Source divergence audit: how far the word use of each source is from that of the others of its language.

`CountVectorizer` gives every document a sparse vector of exact term counts. Its vocabulary has the terms in at least
``min_df`` documents of a language, without a limit in number, and a term is filed with its language, so one pass does what one per
language would. The vocabulary of a model is held by the driver and every executor, so the kept terms are counted first and dealt into slices by hash, by
their exact number, and each slice is a model of its own; the vectors of all slices together are those of one model without a bound.

The vectors are summed by (language, source), entry by entry. A pair of sources is evaluated on its entries alone: where
a source lacks a term its share is a constant of the source, so all its empty places are one product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgewise.llm.common import SLICE_BYTES, Words, slices, text_or_empty
from lodgewise.session import stored

#: All that `CountVectorizer` can take.
MOST_TERMS = (1 << 31) - 1
#: Terms of one vocabulary, about 100 MB in the driver and in each executor.
SLICE_TERMS = 1 << 20
_UNIT = 1_000_000_000
# ASCII letters and everything beyond ASCII make terms
_INSIDE = np.zeros(256, bool)
_INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
# stands between language and term; no term holds it
_MARK = "\x00"


def _cut(batch: pa.RecordBatch) -> tuple[Words, np.ndarray, list[bytes], np.ndarray]:
    """The terms of a batch and their letters, the languages with their mark, and the language of each text."""
    words = Words(batch.column("text"), lower=True, inside=_INSIDE)
    langs, lang = np.unique(np.asarray(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
    return words, words.data[_INSIDE[words.data]], [(name + _MARK).encode() for name in langs], lang


def _filed(batch: pa.RecordBatch) -> tuple[pa.StringArray, np.ndarray]:
    """Language, mark and term of every term in the batch; the terms of text ``i`` are those from ``first[i]`` to ``first[i + 1]``."""
    words, letters, marks, lang = _cut(batch)
    extra = np.array([len(m) for m in marks], np.int64)
    of_word = lang[words.text]
    size = words.end - words.start
    offsets = np.concatenate([[0], np.cumsum(size + extra[of_word])])
    body = np.empty(offsets[-1], np.uint8)
    for code, mark in enumerate(marks):
        at = offsets[:-1][of_word == code]
        for k, byte in enumerate(mark):
            body[at + k] = byte
    body[np.arange(len(letters)) + np.repeat(np.cumsum(extra[of_word]), size)] = letters
    filed = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(body))
    return filed.cast(pa.string()), words.first


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        filed, first = _filed(batch)
        terms = pa.ListArray.from_arrays(pa.array(first, pa.int32()), filed)
        yield pa.RecordBatch.from_arrays([batch.column("grp"), terms], ["grp", "terms"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a slice each of its filed terms is."""
    for batch in slices(batches, "text", 2 * SLICE_BYTES):
        words, letters, marks, lang = _cut(batch)
        offsets = np.concatenate([[0], np.cumsum(words.end - words.start)])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        names = max(len(coded.dictionary), 1)
        once = np.sort(words.text * names + coded.indices.to_numpy())
        once = once[np.diff(once, prepend=-1) > 0]
        df = np.bincount(lang[once // names] * names + once % names, minlength=len(marks) * names)
        for code, mark in enumerate(marks):
            here = df[code * names : (code + 1) * names]
            some = np.flatnonzero(here)
            terms = pc.binary_join_element_wise(pa.scalar(mark, pa.large_binary()), coded.dictionary.take(pa.array(some)), pa.scalar(b"", pa.large_binary()))
            yield pa.RecordBatch.from_arrays([terms.cast(pa.large_string()).cast(pa.string()), pa.array(here[some], pa.int64())], ["filed", "df"])


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(grp, lang, source)`` of all that occur, and the rows with ``grp``: a hash that no two of them share."""
    named = stored(rows.select("lang", "source").distinct(), "groups")
    salt = 0
    while True:
        grp = F.xxhash64("lang", "source", F.lit(salt))
        groups, numbers = named.select(grp.alias("g")).agg(F.count("*"), F.count_distinct("g")).first()
        if groups == numbers:
            return named.withColumn("grp", grp), rows.withColumn("grp", grp)
        salt += 1


def count_terms(docs: DataFrame, min_df: int = 10, slice_terms: int = SLICE_TERMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups, kept terms, and the sums of the documents' vectors.

    ``(grp, lang, source)`` has every group that occurs; ``(term_id, lang, term)`` each term that at least ``min_df``
    documents of its language hold; ``(grp, term_id, n)`` how often the group has it, where it has it at all.
    """
    spark = docs.sparkSession
    rows = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), text_or_empty().alias("text"))
    groups, rows = _grouped(rows)
    found = rows.select("lang", "text").mapInArrow(_frequencies, "filed string, df bigint")
    kept = found.groupBy("filed").agg(F.sum("df").alias("df")).where(F.col("df") >= min_df)
    kept = stored(kept.select("filed"), "kept")
    parts = math.ceil(kept.count() / slice_terms)
    vocabulary = spark.createDataFrame([], "term_id bigint, filed string")
    counts = spark.createDataFrame([], "grp bigint, term_id bigint, n bigint")
    for part in range(parts):
        own = kept.where(F.pmod(F.xxhash64("filed"), F.lit(parts)) == part)
        if own.isEmpty():
            continue
        model = CountVectorizer(inputCol="terms", outputCol="vector", vocabSize=MOST_TERMS).fit(own.select(F.array("filed").alias("terms")))
        first = part << 32
        terms = model.vocabulary
        table = spark.createDataFrame(pa.table({"term_id": pa.array(np.arange(len(terms)) + first, pa.int64()), "filed": terms}))
        vocabulary = vocabulary.unionByName(stored(table, "vocabulary"))
        vectors = model.transform(rows.select("grp", "lang", "text").mapInArrow(_lists, "grp bigint, terms array<string>"))
        # the stored form of a sparse vector: places and what stands there
        entry = F.unwrap_udt("vector")
        entries = vectors.select("grp", F.explode(F.arrays_zip(entry["indices"].alias("place"), entry["values"].alias("n"))).alias("entry"))
        sums = entries.groupBy("grp", "entry.place").agg(F.sum(F.col("entry.n").cast("bigint")).alias("n"))
        counts = counts.unionByName(stored(sums.select("grp", (F.col("place") + first).alias("term_id"), "n"), "term-counts"))
    # a language may hold the mark itself, a term never does
    term = F.substring_index("filed", _MARK, -1)
    lang = F.substring("filed", F.lit(1), F.length("filed") - F.length(term) - 1)
    return groups, vocabulary.select("term_id", lang.alias("lang"), term.alias("term")), counts


def _share(n: Column | str, total: str, terms: str) -> Column:
    """Smoothed share of a term in billionths, plus one; exact, as the product outgrows a bigint."""
    n = F.col(n) if isinstance(n, str) else n
    scaled = F.lit(_UNIT).cast("decimal(12,0)") * (n + 2).cast("decimal(20,0)")
    below = (F.col(total) + 2 * F.col(terms)).cast("decimal(20,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", scaled, below)


def _apart(p: Column | str, q: Column | str) -> Column:
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, min_df: int = 10, top: int = 10, slice_terms: int = SLICE_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: the divergence of each (lang, source) group.

    Part ``pair`` has a row for every other source of the language, part ``term`` the ``top`` terms that the group uses
    more than its language does; ranks count from 1 by falling value, ties by item. NULL language, source and text count
    as empty. A language without kept terms has pairs of value 0; a group without terms is compared like any other.
    Repeated rows are documents of their own, other columns are not read, and an empty table gives no row.
    """
    groups, vocabulary, counts = count_terms(docs, min_df, slice_terms)
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("grp").agg(F.sum("n").alias("total"))
    known = groups.join(totals, "grp", "left").join(sizes, "lang", "left").na.fill(0, ["total", "v"])
    none = F.when(F.col("v") > 0, _share(F.lit(0).cast("bigint"), "total", "v")).otherwise(1)
    sides = stored(known.withColumn("none", none), "sides")
    shares = stored(
        counts.join(sides.drop("source"), "grp").select("grp", "lang", "term_id", "n", _share("n", "total", "v").alias("p"), "none"),
        "shares",
    )
    pairs = _pairs(sides, shares)
    by_item = Window.partitionBy("grp").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(by_item)).withColumn("part", F.lit("pair"))
    best = _terms(sides, shares, vocabulary).withColumn("rank", F.row_number().over(by_item))
    ranked = ranked.unionByName(best.where(F.col("rank") <= top).withColumn("part", F.lit("term")))
    return ranked.join(groups, "grp").select("lang", "source", "part", "item", "value", "rank")


def _pairs(sides: DataFrame, shares: DataFrame) -> DataFrame:
    """``(grp, item, value)``: every other source of the language and its distance summed over all kept terms."""
    one = sides.select("lang", F.col("grp").alias("a"), F.col("none").alias("a0"), "v")
    two = sides.select("lang", F.col("grp").alias("b"), F.col("none").alias("b0"))
    # as if both lacked every term
    empty = one.join(two, "lang").where("a < b").select("a", "b", (F.col("v") * _apart("a0", "b0")).alias("value"))
    # what a term that one has changes, as if the other lacked it; equal shares are one row
    alike = shares.groupBy("lang", F.col("grp").alias("a"), F.col("none").alias("a0"), "p").agg(F.count("*").alias("m"))
    single = (
        alike.join(two, "lang")
        .where("a != b")
        .select(
            F.least("a", "b").alias("a"),
            F.greatest("a", "b").alias("b"),
            (F.col("m") * (_apart("p", "b0") - _apart("a0", "b0"))).alias("value"),
        )
    )
    # what both have: set right what the two steps before took for granted
    left = shares.select("term_id", F.col("grp").alias("a"), F.col("p").alias("ap"), F.col("none").alias("a0"))
    right = shares.select("term_id", F.col("grp").alias("b"), F.col("p").alias("bp"), F.col("none").alias("b0"))
    change = _apart("ap", "bp") - _apart("ap", "b0") - _apart("a0", "bp") + _apart("a0", "b0")
    double = left.join(right, "term_id").where("a < b").groupBy("a", "b").agg(F.sum(change).alias("value"))
    sums = empty.unionByName(single).unionByName(double).groupBy("a", "b").agg(F.sum("value").alias("value"))
    sums = stored(sums, "pair-sums")
    both = sums.unionByName(sums.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    return both.join(sides.select(F.col("grp").alias("b"), F.col("source").alias("item")), "b").select(F.col("a").alias("grp"), "item", "value")


def _terms(sides: DataFrame, shares: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(grp, item, value)`` of the terms that a group has and uses more than its language."""
    langs = sides.groupBy("lang").agg(F.sum("total").alias("total"), F.first("v").alias("v"))
    whole = shares.groupBy("term_id", "lang").agg(F.sum("n").alias("n")).join(langs, "lang")
    expected = whole.select("term_id", _share("n", "total", "v").alias("q"))
    more = shares.select("grp", "term_id", "p").join(expected, "term_id").where("p > q")
    return more.join(vocabulary.select("term_id", F.col("term").alias("item")), "term_id").select("grp", "item", _apart("p", "q").alias("value"))

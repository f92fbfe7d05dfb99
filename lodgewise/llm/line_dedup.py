"""Line dedup: repeated runs of lines found in a suffix array that is built by distributed prefix doubling.

Every line is a suffix: the sequence of lines from it to the end of its document. Suffixes that agree in their first
k lines stand together in the suffix array and form an interval of longest common prefix k or more; the interval is
named by its first suffix in the order of documents. Names for 2k lines come from pairs of names for k lines, by one
aggregation that combines before it shuffles. Suffixes that share their first k lines with no other are dropped at
once, as they can share no more. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgewise.llm.common import WORD, text_or_empty
from lodgewise.session import stored

#: Runs of fewer lines than this stay, unless they have so many words: a passage may stand on one line.
MIN_LINES = 2
MIN_WORDS = 50
_PLACE = ("_doc", "_hash", "_line")


def _lines(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def _named(suffixes: DataFrame, *more: str) -> DataFrame:
    """The suffixes that share their key (``a``, ``b``) with another, and as ``name`` the first that has it; ``more`` columns stay."""
    place, keys = F.struct(*_PLACE), ["a", "b"]
    intervals = suffixes.groupBy(*keys).agg(F.min(place).alias("name"), F.max(place).alias("_last"))
    intervals = intervals.filter(F.col("name") != F.col("_last")).drop("_last")
    return suffixes.join(intervals, keys).select(*_PLACE, "name", *more)


def _paired(named: DataFrame, apart: int) -> DataFrame:
    """Suffixes of which the one ``apart`` lines later also has a name; both names are the new key."""
    later = Window.partitionBy("_doc", "_hash").orderBy("_line").rangeBetween(apart, apart)
    paired = named.select(*_PLACE, F.col("name").alias("a"), F.first("name").over(later).alias("b"))
    return paired.filter(F.col("b").isNotNull())


def _later_copies(named: DataFrame, n: int) -> DataFrame:
    """The lines (``at``) of each run of ``n`` lines that also stands earlier; ``_line`` is the run's first."""
    copies = named.filter(F.struct(*_PLACE) != F.col("name")).select(*_PLACE).distinct()
    return copies.withColumn("at", F.explode(F.sequence("_line", F.col("_line") + (n - 1))))


def _long(lines: DataFrame, words: DataFrame, min_words: int) -> DataFrame:
    """Of the lines of runs, those whose run has ``min_words`` words or more."""
    words = words.withColumnsRenamed({"_doc": "_d", "_hash": "_h", "at": "_a"})
    same = lines["_doc"].eqNullSafe(words["_d"]) & (lines["_hash"] == words["_h"]) & (lines["at"] == words["_a"])
    counted = lines.join(words, same)
    runs = counted.groupBy(*_PLACE).agg(F.sum("_words").alias("_words"), F.collect_list("at").alias("_at"))
    return runs.filter(F.col("_words") >= min_words).select("_doc", "_hash", F.explode("_at").alias("at"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """The maximal runs of lines that are later copies: ``_doc``, ``_hash``, ``first`` (from 0), ``n``.

    A line belongs to one if some ``min_lines`` consecutive lines of its document, it among them, also stand
    earlier: in a document of lesser id (null least; rows of one id by the hash of their text), or further up in the
    same document. Runs of fewer lines count alike if they have ``min_words`` words; with None they don't. ``_hash``
    is the text's hash.
    """
    if min_lines < 1:
        raise ValueError("a run has one line at least")
    if min_words is not None and min_words < 1:
        raise ValueError("a long run has one word at least")
    text = text_or_empty()
    split = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64(text).alias("_hash"), F.posexplode(_lines(text)).alias("_line", "_text"))
    size = F.size(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))) if min_words else F.lit(0)
    hashed = split.select(*_PLACE, F.xxhash64("_text").alias("a"), F.xxhash64("_text", F.lit(1)).alias("b"), size.alias("_words"))
    named = stored(_named(stored(hashed, "lines"), "_words"), "names-1")
    # a run that stands twice has only lines that do
    words = named.select("_doc", "_hash", F.col("_line").alias("at"), "_words").distinct()
    known, shorter = 1, []
    while known < min_lines:
        if min_words and known == 1:
            shorter.append(_later_copies(named.filter(F.col("_words") >= min_words), 1).select("_doc", "_hash", "at"))
        elif min_words:
            shorter.append(_long(_later_copies(named, known), words, min_words))
        apart = 1 if min_words else min(known, min_lines - known)  # every length below min_lines is looked at
        known += apart
        named = stored(_named(_paired(named, apart)), f"names-{known}")
    covered = _later_copies(named, min_lines).select("_doc", "_hash", "at")
    for lines in shorter:
        covered = covered.unionByName(lines)
    covered = covered.distinct()
    in_doc = Window.partitionBy("_doc", "_hash")
    runs = covered.withColumn("_run", F.col("at") - F.row_number().over(in_doc.orderBy("at")))
    return runs.groupBy("_doc", "_hash", "_run").agg(F.min("at").alias("first"), F.count("*").cast("int").alias("n")).drop("_run")


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """Deletes later copies of repeated runs of lines from ``text``; adds ``n_lines`` and ``n_removed``.

    Runs have ``min_lines`` lines or, be they shorter, ``min_words`` words.

    Lines end at line feeds and are compared whole and unchanged. Documents are kept with all other columns, be they
    left without lines (then ``text`` is empty); null and empty texts have none and are returned as they are. Rows
    that repeat an id with the same text are one document, and each gets that document's result. Columns named
    ``n_lines`` or ``n_removed`` are replaced; an empty table gives no rows.
    """
    runs = repeated_runs(docs, min_lines, min_words).groupBy("_doc", "_hash").agg(F.collect_list(F.struct("first", "n")).alias("_runs"))
    own = ["doc_id", "text"]
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    others = [F.col(f"`{c}`") for c in columns if c not in own]  # out of the way of the columns that are added here
    keyed = docs.select(*own, *([F.struct(*others).alias("_rest")] if others else [])).withColumn("_key", F.xxhash64(text_or_empty()))
    joined = keyed.join(runs, keyed["doc_id"].eqNullSafe(runs["_doc"]) & (keyed["_key"] == runs["_hash"]), "left")
    lines = _lines(text_or_empty())
    gone = F.flatten(F.transform("_runs", lambda r: F.sequence(r["first"], r["first"] + r["n"] - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    told = joined.withColumn("n_lines", F.size(lines)).withColumn("n_removed", F.coalesce(F.size(gone), F.lit(0)))
    told = told.withColumn("n_removed", F.greatest("n_removed", F.lit(0)))
    told = told.withColumn("text", F.when(F.col("_runs").isNull(), F.col("text")).otherwise(text))
    return told.select(*[F.col(c) if c in own else F.col(f"_rest.`{c}`").alias(c) for c in columns], "n_lines", "n_removed")

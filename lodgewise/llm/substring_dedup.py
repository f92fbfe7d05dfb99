"""Substring dedup: windows of words that also start earlier, found in a compressed FM-index per shard.

A window's anchor is its least hashed word gram. Equal windows have equal anchors, so a window whose anchor occurs
once in the corpus can't repeat; the others are cut out as segments, runs of windows with one anchor, and sent to the
shard of the anchor. A shard indexes its segments and searches them backward in the index, which gives the matching
statistics up to the threshold; a window is a copy if its interval holds an earlier place.

Equal segments are indexed once, under their first place, and later ones are copies as a whole, so groups of copies
cost a shard one segment. An anchor that very many windows share sends each window by its own hash instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgewise.llm.common import Words, as_long, gram_hashes, mix, slices, text_or_empty
from lodgewise.llm.fm_index import FMIndex
from lodgewise.session import stored

#: Words of a gram.
GRAM = 5
#: Anchors that stand at more places than this are shared by too many windows for one shard.
HOT = 2_000
#: Words that are indexed together, and the memory of a task for segments it has sent.
INDEXED, _REMEMBERED = 1_000_000, 300_000

_NO_ID = -(1 << 63)


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows, places of their anchors (the leftmost least gram), and hashes of all grams."""
    hashes = words.hashes()
    grams = gram_hashes(hashes, GRAM)
    wide = window - GRAM + 1
    if len(grams) < wide:
        return np.empty(0, np.int64), np.empty(0, np.int64), grams
    least, known = np.arange(len(grams)), 1
    while known < wide:
        step = min(known, wide - known)
        left, right = least[: len(least) - step], least[step:]
        least = np.where(grams[right] < grams[left], right, left)
        known += step
    begins = np.arange(len(least))
    inside = begins + window <= words.first[words.text[begins] + 1]
    return begins[inside], least[inside], grams


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """``anchor``, ``row`` and ``n``, how many places of the document are the anchor of some window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column(1))
            _, least, grams = anchors(words, window)
            places = np.unique(least)
            text, gram = words.text[places], grams[places]
            order = np.lexsort((gram, text))
            text, gram = text[order], gram[order]
            fresh = np.flatnonzero(np.concatenate([[len(gram) > 0], (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])]))
            n = np.diff(np.append(fresh, len(gram)))
            row = np.asarray(batch.column(0))[text[fresh]]
            yield pa.record_batch([as_long(gram[fresh]), as_long(row), as_long(n)], names=["anchor", "row", "n"])

    return docs.select("row", "text").mapInArrow(run, "anchor bigint, row bigint, n bigint")


def segments(docs: DataFrame, window: int, whole: bool) -> DataFrame:
    """The windows of ``docs`` whose anchor repeats, as segments of consecutive windows with one anchor.

    ``docs`` has ``anchors``, the repeated ones of each document, and ``hot``, those shared too often. A segment has
    its ``shard`` key, the hash of its ``content``, place (``doc_id``, ``row``, ``begin``) and ``size`` in words. With
    ``whole`` it has its words, 4 bytes each, and a task leaves out those of which it has sent an earlier copy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[int, int], tuple[int, int, int]] = {}
        for batch in slices(batches, "text"):
            words = Words(batch.column(2))
            begins, least, grams = anchors(words, window)
            known = [np.asarray(batch.column(3)[i].values).view(np.uint64) for i in range(batch.num_rows)]
            hot = [np.asarray(batch.column(4)[i].values).view(np.uint64) for i in range(batch.num_rows)]
            text, gram = words.text[begins], grams[least]
            keep, shared = np.zeros(len(begins), bool), np.zeros(len(begins), bool)
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
            for i in range(batch.num_rows):
                part = slice(cuts[i], cuts[i + 1])
                keep[part] = np.isin(gram[part], known[i])
                if len(hot[i]):
                    shared[part] = np.isin(gram[part], hot[i])
            begins, least, text, gram, shared = begins[keep], least[keep], text[keep], gram[keep], shared[keep]
            if not len(begins):
                continue
            goes_on = (begins[1:] == begins[:-1] + 1) & (least[1:] == least[:-1]) & (text[1:] == text[:-1]) & ~shared[1:]
            first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
            last = np.append(first[1:], len(begins)) - 1
            low, high = begins[first], begins[last] + window
            hashes = words.hashes()
            content = _content(hashes, low, high)
            shard = np.where(shared[first], content, gram[first])
            owner, begin = text[first], low - words.first[text[first]]
            doc_id = np.asarray(batch.column(0).fill_null(_NO_ID))[owner]
            row, size = np.asarray(batch.column(1))[owner], high - low
            columns = [as_long(shard), as_long(content), as_long(doc_id), as_long(row), as_long(begin), as_long(size)]
            if whole:
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                send, held = [], []
                for i, (s, c, *place) in enumerate(zip(shard.tolist(), content.tolist(), doc_id.tolist(), row.tolist(), begin.tolist())):
                    had = sent.get((s, c))
                    if had is None or tuple(place) < had:
                        sent[s, c] = tuple(place)
                        send.append(i)
                        held.append(short[low[i] : high[i]].tobytes())
                if len(sent) > _REMEMBERED:
                    sent.clear()
                columns = [c.take(pa.array(send, pa.int64())) for c in columns] + [pa.array(held, pa.binary())]
            yield pa.record_batch(columns, names=_PLACED + ["words"] * whole)

    schema = ", ".join(f"{c} bigint" for c in _PLACED) + ", words binary" * whole
    return docs.select("doc_id", "row", "text", "anchors", "hot").mapInArrow(run, schema)


_PLACED = ["shard", "content", "doc_id", "row", "begin", "size"]


def _content(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of the words between the places, the same wherever they stand."""
    base = 0xD6E8FEB86659FD93
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(hashes), base, np.uint64))])
    inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(hashes), pow(base, -1, 1 << 64), np.uint64))])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1], dtype=np.uint64)])
    return mix((sums[high] - sums[low]) * inverse[low] + (high - low).astype(np.uint64))


def copies(shards: DataFrame, window: int) -> DataFrame:
    """For each segment of a shard its first place, and the ranges of its windows that start earlier elsewhere.

    ``ranges`` are first and last windows in turn, counted from the segment's beginning. Shards are read in the order
    of their keys, and as many of them are indexed together as have ``INDEXED`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            low = 0
            shard = np.asarray(batch.column(0))
            for cut in [*(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), batch.num_rows]:
                part = batch.slice(low, cut - low)
                if total >= INDEXED and held[-1].column(0)[-1] != part.column(0)[0]:
                    yield _searched(pa.Table.from_batches(held).combine_chunks().to_batches()[0], window)
                    held, total = [], 0
                held.append(part)
                total += int(np.asarray(part.column(5)).sum())
                low = cut
        if held:
            yield _searched(pa.Table.from_batches(held).combine_chunks().to_batches()[0], window)

    schema = "shard bigint, content bigint, doc_id bigint, row bigint, begin bigint, ranges array<int>"
    return shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def _searched(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    shard, content, doc_id, row, begin, size = (np.asarray(batch.column(i)) for i in range(6))
    order = np.lexsort((begin, row, doc_id, content, shard))
    fresh = np.concatenate([[True], (shard[order][1:] != shard[order][:-1]) | (content[order][1:] != content[order][:-1])])
    firsts = order[fresh]
    firsts = firsts[np.lexsort((begin[firsts], row[firsts], doc_id[firsts]))]  # places in the index follow the corpus
    size = size[firsts]
    kept = batch.take(pa.array(firsts))
    body = np.frombuffer(b"".join(kept.column(6).to_pylist()), np.uint32)
    numbers, named = np.unique(body, return_inverse=True)
    ends = np.cumsum(size + 1)  # with the stop after each segment
    text = np.zeros(int(ends[-1]), np.int64)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = named + 1
    windows = size - window + 1
    which = np.repeat(np.arange(len(size)), windows)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = (ends - 1 - size)[which] + offset
    index = FMIndex(text, len(numbers), window)
    earlier = index.least_places(text, starts + window, window) < starts
    # ranges of consecutive windows
    edge = np.concatenate([[True], which[1:] != which[:-1]])
    opens = earlier & (edge | ~np.concatenate([[False], earlier[:-1]]))
    closes = earlier & (np.append(edge[1:], True) | ~np.append(earlier[1:], False))
    flat = np.stack([offset[opens], offset[closes]], 1).ravel()
    counts = 2 * np.bincount(which[opens], minlength=len(size))
    ranges = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))
    return pa.record_batch([*(kept.column(i) for i in range(5)), ranges], names=["shard", "content", "doc_id", "row", "begin", "ranges"])


def copied_ranges(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` (``doc_id``, ``text``, ``row``) dealt by row, and per row the ranges of windows that are copies."""
    found = anchor_rows(docs, window)
    totals = found.groupBy("anchor").agg(F.sum("n").alias("total")).filter("total > 1")
    repeated = found.select("anchor", "row").join(totals, "anchor")
    hot = F.collect_list(F.when(F.col("total") > HOT, F.col("anchor"))).alias("hot")
    by_row = stored(repeated.groupBy("row").agg(F.collect_list("anchor").alias("anchors"), hot), "anchors")
    dealt = docs.repartition("row")  # used several times, shuffled once
    told = dealt.join(by_row, "row")
    indexed = copies(segments(told, window, True), window).select(
        "shard", "content", F.struct("doc_id", "row", "begin").alias("first"), "ranges"
    )
    placed = segments(told, window, False).join(indexed, ["shard", "content"])
    place = F.struct("doc_id", "row", "begin")
    every = F.array(F.lit(0), (F.col("size") - window).cast("int"))
    gone = placed.select("row", F.col("begin").cast("int").alias("begin"), F.when(place != F.col("first"), every).otherwise(F.col("ranges")).alias("r"))
    gone = gone.filter(F.size("r") > 0).select("row", F.transform("r", lambda w: w + F.col("begin")).alias("r"))
    return dealt, gone.groupBy("row").agg(F.flatten(F.collect_list("r")).alias("ranges"))


def dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``text`` for each row: the words that no repeated window covers.

    Words are runs of anything but ASCII white space, unchanged. A window is ``window`` consecutive words of one
    document; it is a copy if its words also start earlier: in a document of lesser ``doc_id`` (null least, rows of
    one id by the hash of their text), or further up in the same document. Copies are judged on the input, not on
    what is left. The words that are kept are joined by one blank. Rows that repeat id and text are one document, and
    each gets its result. Null and empty texts have no words; shorter texts keep all; other columns are dropped.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("row", _row())
    dealt, ranges = copied_ranges(docs, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n_words, n_removed, texts = [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2)):
                words = text.as_buffer().to_pybytes().split()
                n_words.append(len(words))
                if ranges.is_valid:
                    ends = np.asarray(ranges.values).reshape(-1, 2)
                    marks = np.zeros(len(words) + 1, np.int64)
                    np.add.at(marks, ends[:, 0], 1)
                    np.add.at(marks, ends[:, 1] + window, -1)
                    words = [w for w, gone in zip(words, np.cumsum(marks).tolist()) if not gone]
                n_removed.append(n_words[-1] - len(words))
                texts.append(b" ".join(words).decode())
            yield pa.record_batch(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "n_removed", "text"],
            )

    told = dealt.join(ranges, "row", "left").select("doc_id", "text", "ranges")
    return told.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, text string")

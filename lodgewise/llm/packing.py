"""Token ids in packed rows: best-fit-decreasing packing of whole documents into rows of a fixed length.

Texts are tokenised and packed in one pass over each partition, without a shuffle. A task packs what it has read in
blocks of a bounded number of tokens, so memory is bounded however large a partition or a document is.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgewise.llm.common import slices

#: Tokens that are packed together; a task holds a few times as many bytes.
BLOCK = 4_000_000
_MOST_CACHED = 300_000
_CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
# White space beyond ASCII: with it, pieces of a text are not independent, and the text is encoded in one go.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Callable[[str], bytes]:
    """Encodes a text into two bytes per id, little end first, exactly as the byte-pair tokenizer does.

    The tokenizer splits before white space, so a word with the blanks before it has the same ids wherever it
    stands; ids of frequent words are kept.
    """
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids need more than two bytes")
    raw = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    known: dict[str, bytes] = {}

    def fresh(chunk: str) -> bytes:
        ids = np.array(raw(chunk), "<u2").tobytes()
        if len(chunk) <= 40:
            if len(known) >= _MOST_CACHED:
                known.clear()
            known[chunk] = ids
        return ids

    def encode(text: str) -> bytes:
        if _OTHER_SPACE.search(text):
            return np.array(raw(text), "<u2").tobytes()
        get = known.get
        return b"".join([get(c) or fresh(c) for c in _CHUNK.findall(text)])

    return encode


class Capacities:
    """A segment tree over how much room rows have left: adds rows, and takes the fullest one that still fits."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the least room of ``least`` or more, and its room."""
        node = least + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        self._change(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Rows of indices: by decreasing length, each into the fullest row that has room, or else into a new one."""
    tree, rows = Capacities(most), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        row, room = found if found else (len(rows), most)
        if not found:
            rows.append([])
        rows[row].append(i)
        if room > n:
            tree.add(room - n, row)
    return rows


SCHEMA = (
    "doc_ids array<bigint>, pieces array<int>, n_pieces array<int>, cu_seqlens array<int>, resets array<int>, "
    "n_tokens int, ids binary"
)


def pack(docs: DataFrame, path: str, pattern: str, row_length: int = 2048, end_id: int = 50256, block: int = BLOCK) -> DataFrame:
    """Packs ``doc_id``, ``text`` into rows of ``row_length`` ids, of which each is one row of the result.

    A document's ids end with ``end_id``. One of more than ``row_length`` ids is split into pieces, of which all but
    the last fill a row; ``pieces`` and ``n_pieces`` say which piece of how many a segment is, so joining them gives
    back every document. ``cu_seqlens`` are the cumulative lengths of the segments, beginning with 0; ``resets``
    the places at which positions start anew. ``ids`` has two bytes per id, little end first, filled up with
    ``end_id`` after ``n_tokens`` ids. Rows of a block come in the order of their first documents, so the order of
    the input holds from block to block. Null and empty texts are ``end_id`` alone; null ids stay null; repeated rows
    are packed each; other columns are ignored; an empty table gives no rows.
    """
    if not 1 <= row_length <= 1 << 20 or not 0 <= end_id < 1 << 16:
        raise ValueError("rows have 1 to 1048576 ids of two bytes")

    def rows_of(held: list[tuple[int | None, int, int, np.ndarray]]) -> pa.RecordBatch:
        rows = best_fit(np.array([len(h[3]) for h in held]), row_length)
        rows = sorted((sorted(r) for r in rows), key=lambda r: r[0])
        out: dict[str, list] = {name: [] for name in ("doc_ids", "pieces", "n_pieces", "cu_seqlens", "resets", "n_tokens", "ids")}
        for row in rows:
            cuts = [0, *np.cumsum([len(held[i][3]) for i in row]).tolist()]
            ids = np.full(row_length, end_id, "<u2")
            ids[: cuts[-1]] = np.concatenate([held[i][3] for i in row])
            for name, value in (
                ("doc_ids", [held[i][0] for i in row]),
                ("pieces", [held[i][1] for i in row]),
                ("n_pieces", [held[i][2] for i in row]),
                ("cu_seqlens", cuts),
                ("resets", cuts[:-1]),
                ("n_tokens", cuts[-1]),
                ("ids", ids.tobytes()),
            ):
                out[name].append(value)
        kinds = [pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4, pa.int32(), pa.binary()]
        return pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        held, total = [], 0
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(np.frombuffer(encode(text or ""), "<u2"), np.array([end_id], "<u2"))
                n = -(-len(ids) // row_length)
                for k in range(n):
                    held.append((doc_id, k, n, ids[k * row_length : (k + 1) * row_length]))
                    total += len(held[-1][3])
                    if total >= block:
                        yield rows_of(held)
                        held, total = [], 0
        if held:
            yield rows_of(held)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packed, SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet; each file is an id matrix of whole rows with its segment lengths."""
    packed.write.parquet(path)

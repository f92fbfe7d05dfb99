"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

CGK embedding: a walk reads a text's words and at each step stays or moves on, by a random bit of the word it stands
on and of the step. Two texts walk alike until they differ, and fall into step again after an edit, so few edits are
few differing coordinates. Bit sampling: a table's key are the words at a few sampled steps. Several tables, each with
its own walk and its own steps, make it unlikely that all of them miss; how many it takes is found out on the items
themselves, edited as far as the threshold allows and as evenly as possible. Walks begin at each word of the documents and at each
word of an item, so that an edit spoils only the walks that run into it. What shares a key is aligned exactly.

Items too short for walks, and those for which the tables don't reach the recall, are cut into one part more than they
may have edits: one part has none, so documents that hold a part are all that need aligning, and none is missed.

Items are a stated query set: they are taken in blocks of bounded size, and every document is read once per block.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgewise.llm.common import Words, gram_hashes, mix, slices

#: Items that are searched in one pass over the documents.
BLOCK = 20_000
#: Steps of a walk, sampled steps, and tables at most.
STEPS, SAMPLED, MOST_TABLES = 8, 3, 24
#: From so many words on items may have edits, and are searched by walks; shorter ones are searched exactly, and by parts.
LEAST_EDITED, LEAST_WALKED = 5, 8
_BITMAP = 20


@dataclass(frozen=True)
class Table:
    """One walk: the bits that move it, and the steps whose words make its key."""

    salt: int
    sampled: tuple[int, ...]


def _tables(seed: int) -> list[Table]:
    draw = np.random.default_rng(seed)
    return [
        Table(int(draw.integers(1, 1 << 62)) | 1, tuple(sorted(draw.choice(STEPS, SAMPLED, replace=False).tolist())))
        for _ in range(MOST_TABLES)
    ]


def keys(words: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Key of the walk from each word on, and whether it stands on different words at the sampled steps.

    Walks that reach the end of ``words`` stay on the last one.
    """
    moves = mix(words ^ np.uint64(table.salt))
    at = np.arange(len(words))
    key, distinct = np.zeros(len(words), np.uint64), np.ones(len(words), bool)
    before = None
    for step in range(table.sampled[-1] + 1):
        if step in table.sampled:
            if before is not None:
                distinct &= at > before
            before = at
            key = (key + words[at]) * np.uint64(0xD6E8FEB86659FD93)
        at = np.minimum(at + ((moves[at] >> np.uint64(step)) & np.uint64(1)).astype(np.int64), len(words) - 1)
    return mix(key), distinct


class Items:
    """A block of items: their words, allowed edits, and keys by table."""

    def __init__(self, ids: list, texts: list[str], similarity: float, recall: float, seed: int = 5):
        words = Words(pa.array(texts, pa.string()), lower=True)
        hashes = words.hashes()
        self.ids = ids
        self.words = [hashes[words.first[i] : words.first[i + 1]] for i in range(len(texts))]
        size = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.where(size < LEAST_EDITED, 0, np.floor((1 - similarity) * size + 1e-9)).astype(np.int64)
        long = np.flatnonzero(size >= LEAST_WALKED)
        every = _tables(seed)
        own = [[keys(self.words[i], t) for t in every] for i in long]
        some = np.array([any(k[1].any() for k in o) for o in own], bool)  # the others stand on one word all along
        self.walked, own = long[some], [o for o, s in zip(own, some) if s]
        needed = self._needed(own, every, recall, seed)
        if needed > MOST_TABLES:
            self.walked, own, needed = long[:0], [], 0
        self.tables = every[:needed]
        self.index = []
        for t in range(len(self.tables)):
            key = np.concatenate([k[t][0][k[t][1]] for k in own] + [np.empty(0, np.uint64)])
            item = np.concatenate([np.full(k[t][1].sum(), i) for i, k in zip(self.walked, own)] + [np.empty(0, np.int64)])
            offset = np.concatenate([np.flatnonzero(k[t][1]) for k in own] + [np.empty(0, np.int64)])
            self.index.append(_Index(key, item.astype(np.int64), offset.astype(np.int64)))
        whole: dict[int, list[int]] = {}
        walked = set(self.walked.tolist())
        for i in np.flatnonzero(size).tolist():
            if i not in walked or not self._sure(i):
                whole.setdefault(int(size[i]), []).append(i)
        self.whole = {
            n: _Index(np.concatenate([gram_hashes(self.words[i], n) for i in found]), np.array(found), np.zeros(len(found), np.int64))
            for n, found in whole.items()
        }
        parts: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(self.edits).tolist():
            if i not in walked:
                cuts = np.linspace(0, size[i], min(int(self.edits[i]) + 1, int(size[i])) + 1).astype(np.int64)
                for low, high in itertools.pairwise(cuts.tolist()):
                    parts.setdefault(high - low, []).append((i, low))
        self.parts = {
            n: _Index(np.concatenate([gram_hashes(self.words[i][o : o + n], n) for i, o in found]), *np.array(found, np.int64).T)
            for n, found in parts.items()
        }

    def _needed(self, own: list, every: list[Table], recall: float, seed: int) -> int:
        """How many tables find this share of items that are edited as far as allowed, tried on 400 draws of them.

        One more than there are if they don't all together.
        """
        if not len(self.walked):
            return 0
        draw = np.random.default_rng(seed + 1)
        first_hit = []
        for which in draw.integers(0, len(self.walked), 400):
            item = self.walked[which]
            edited = self.words[item].copy()
            n, edits = len(edited), int(self.edits[item])
            # evenly spread replacements leave the shortest runs of words between them
            edited[((np.arange(edits) + draw.random()) * n / max(1, edits)).astype(np.int64)] = draw.integers(1, 1 << 62, edits)
            hit = MOST_TABLES
            for t, table in enumerate(every):
                key, distinct = keys(edited, table)
                known, good = own[which][t]
                if np.isin(key[distinct], known[good]).any():
                    hit = t
                    break
            first_hit.append(hit)
        place = min(len(first_hit), int(np.ceil(recall * len(first_hit)))) - 1
        return int(np.sort(first_hit)[place]) + 1

    def _sure(self, item: int) -> bool:
        """Whether some walk of some table stays inside the item, so that no copy of it can be missed."""
        text = self.words[item]
        longer = np.append(text, np.full(STEPS, mix(text[-1:])[0]))
        for table in self.tables:
            (a, fine), (b, _) = keys(text, table), keys(longer, table)
            if (fine & (a == b[: len(a)])).any():
                return True
        return False


class _Index:
    """Sorted keys behind a bitmap, which most other keys don't pass."""

    def __init__(self, key: np.ndarray, item: np.ndarray, offset: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.offset = key[order], item[order], offset[order]
        self.some = np.zeros(1 << _BITMAP, bool)
        self.some[(self.key >> np.uint64(64 - _BITMAP)).astype(np.int64)] = True

    def hits(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``key``, items and offsets of all equal keys."""
        place = np.flatnonzero(self.some[(key >> np.uint64(64 - _BITMAP)).astype(np.int64)])
        low = np.searchsorted(self.key, key[place], "left")
        n = np.searchsorted(self.key, key[place], "right") - low
        row = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else low
        return np.repeat(place, n), self.item[row], self.offset[row]


def aligned(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each window the least word edit distance between the item and any part of the window."""
    n = windows.shape[1]
    ramp = np.arange(n + 1)
    row = np.zeros((len(windows), n + 1), np.int64)
    for k, word in enumerate(item, 1):
        best = row + 1
        best[:, 1:] = np.minimum(best[:, 1:], row[:, :-1] + (windows != word))
        best[:, 0] = k
        row = np.minimum.accumulate(best - ramp, 1) + ramp
    return row.min(1)


def leaks(words: Words, items: Items) -> list[tuple[int, int, int, int]]:
    """(text, item, edit distance, word about where it begins) for each text and item, the least distance of each."""
    hashes = words.hashes()
    if not len(hashes):
        return []
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for n, index in items.whole.items():
        place, item, _ = index.hits(gram_hashes(hashes, n))
        inside = place + n <= words.first[words.text[place] + 1] if len(place) else np.zeros(0, bool)
        for p, i in zip(place[inside].tolist(), item[inside].tolist()):
            found.setdefault((int(words.text[p]), i), (0, p))
    cells = []

    def look(place: np.ndarray, item: np.ndarray, offset: np.ndarray) -> None:
        if len(place):
            wide = items.edits[item] + 1
            # diagonals within the allowed edits of one another are looked at together
            cells.append(np.unique(np.stack([words.text[place], item, (place - offset) // wide], 1), axis=0))

    for table, index in zip(items.tables, items.index):
        key, distinct = keys(hashes, table)
        look(*index.hits(np.where(distinct, key, ~key)))
    for n, index in items.parts.items():
        look(*index.hits(gram_hashes(hashes, n)))
    cells = np.unique(np.concatenate(cells), axis=0) if cells else np.empty((0, 3), np.int64)
    for item in np.unique(cells[:, 1]).tolist():
        mine, want, most = cells[cells[:, 1] == item], items.words[item], int(items.edits[item])
        for low in range(0, len(mine), 4096):
            part = mine[low : low + 4096]
            begin = part[:, 2] * (most + 1) - most
            at = begin[:, None] + np.arange(len(want) + 3 * most + 1)
            inside = (at >= words.first[part[:, 0]][:, None]) & (at < words.first[part[:, 0] + 1][:, None])
            windows = np.where(inside, hashes[np.clip(at, 0, len(hashes) - 1)], np.uint64(0))
            far = aligned(want, windows)
            for text, distance, start in zip(part[:, 0].tolist(), far.tolist(), begin.tolist()):
                if distance <= most and distance < found.get((text, item), (most + 1, 0))[0]:
                    found[text, item] = (distance, max(start + most, int(words.first[text])))
    return [(t, i, d, p - int(words.first[t])) for (t, i), (d, p) in found.items()]


def blocks(items: DataFrame, similarity: float, recall: float, block: int = BLOCK) -> Iterator[Items]:
    """The items in blocks of about ``block``; null and empty texts are left out."""
    told = items.select("item_id", "text").filter(F.length("text") > 0)
    n = max(1, -(-told.count() // block))
    for b in range(n):
        rows = told.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == b).orderBy("item_id", "text").collect()  # one block of the query set
        yield Items([r["item_id"] for r in rows], [r["text"] for r in rows], similarity, recall)


def find(docs: DataFrame, items: DataFrame, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """Pairs ``doc_id``, ``item_id`` with ``distance``, ``n_words`` (of the item) and ``word``, one for each row and item.

    A document leaks an item if some part of it is within floor((1 - similarity) * n) word edits of the item's n
    words, A-Z in lower case; items of fewer than 5 words may have no edits. Exact copies are always found, edited ones
    with the given recall, and those of items of 5 to 7 words all. ``word`` is about where the passage begins, counted from 0. Null and
    empty texts leak nothing; repeated rows and items give repeated pairs; of other columns none is read.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for block in blocks(items, similarity, recall):

        def run(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                found = leaks(Words(batch.column(1), lower=True), block)
                columns = [
                    pa.array(batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.int64()),
                    pa.array([block.ids[f[1]] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.int32()),
                    pa.array([len(block.words[f[1]]) for f in found], pa.int32()),
                    pa.array([f[3] for f in found], pa.int32()),
                ]
                yield pa.record_batch(columns, names=["doc_id", "item_id", "distance", "n_words", "word"])

        pairs = texts.mapInArrow(run, "doc_id bigint, item_id bigint, distance int, n_words int, word int")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def clean(docs: DataFrame, items: DataFrame, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """The rows of ``docs`` that leak no item, unchanged and with all columns; null and empty texts stay."""
    for block in blocks(items, similarity, recall):

        def run(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                where = batch.schema.get_field_index("text")
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in leaks(Words(batch.column(where), lower=True), block)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

"""Personal data: fixed rules, and a linear-chain conditional random field over word shapes that adds to them.

The field labels words as outside, or as beginning or continuing an email address, IP address, card or phone number.
Words without a digit and without an at sign can only be outside, which is a constraint of the model: it splits each
text into short independent chains, and the best labelling of these is exact. A small labelled table trains it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgewise.llm.common import Words, mix, slices, text_or_empty
from lodgewise.session import stored

Span = tuple[int, int, int]  # kind, start, end

# Kinds and their patterns, in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_DIGIT_OR_AT = np.zeros(256, np.int64)
_DIGIT_OR_AT[[*range(48, 58), 64]] = 1

#: Label 0 is outside; kind k begins with 1 + 2k and goes on with 2 + 2k.
LABELS = 1 + 2 * len(KINDS)
_FEATURES = 4096


@dataclass(frozen=True)
class Settings:
    """How many texts the labelled table has at most, and how the field is trained."""

    texts: int = 3_000
    around: int = 3
    steps: int = 120
    rate: float = 0.3
    decay: float = 1e-3
    seed: int = 11


@dataclass(frozen=True)
class Field:
    emit: np.ndarray  # features x labels
    step: np.ndarray  # labels x labels


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: int, text: str) -> bool:
    """What every span of the kind must fulfil."""
    if kind == 0:
        return _DOMAIN.search(text.rpartition("@")[2]) is not None
    if kind == 1:
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and (len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255) for p in parts)
    digits = _digits(text)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 8 <= len(digits) <= 15


def rule_spans(text: str) -> tuple[list[Span], bool]:
    """The spans that the rules find, by kind and start, and whether they dropped a number near the right length.

    An email's name reaches back from its at sign as far as its characters go, or to the last match: the same as
    searching from the left, in one pass.
    """
    spans: list[Span] = []
    dropped = False
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            last = domain.end()
            spans.append((0, begin, last))
        at = text.find("@", max(at + 1, last))
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        for found in pattern.finditer(text):
            if valid(kind, found[0]):
                spans.append((kind, found.start(), found.end()))
            elif kind > 1 and len(found[0]) >= 16:
                dropped = True
    return spans, dropped


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


# words and their features

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shape(word: str) -> str:
    """Letters as a or A, digits as 9, runs of more than four alike cut to four."""
    kinds = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub("[0-9]", "9", word[:80]))
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1", kinds)


def features(before: str, word: str, after: str) -> list[int]:
    """Hashed features of a word between its neighbours (empty at the ends of a text)."""
    digits = _digits(word[:80])
    bare = word.strip("()[]{}<>,;:!?\"'").rstrip(".")
    told = [
        "bias",
        "s" + shape(bare),
        "c" + re.sub(r"(.)\1+", r"\1", shape(bare)),
        f"n{min(len(digits), 20)}",
        "first" + word[:1] if not word[:1].isalnum() else "first",
        f"ip{valid(1, bare)}",
        f"card{16 <= len(digits) <= 19 and luhn(digits)}",
        f"at{bare.count('@')}{'.' in bare.rpartition('@')[2]}",
        "b" + re.sub(r"(.)\1+", r"\1", shape(before)[:12]) if re.search("[0-9@+]", before) else "b",
        "a" + re.sub(r"(.)\1+", r"\1", shape(after)[:12]) if re.search("[0-9@+]", after) else "a",
    ]
    return [zlib.crc32(t.encode()) % _FEATURES for t in told]


_N_FEATURES = 10
_WORDS_AT_ONCE = 20_000


def scores(field: Field, rows: np.ndarray) -> np.ndarray:
    """Word scores per label: rows of feature numbers to rows of labels."""
    out = np.zeros((len(rows), LABELS))
    for k in range(_N_FEATURES if len(rows) else 0):  # one feature after the other, in one array
        out += field.emit[rows[:, k]]
    return out


def viterbi(score: np.ndarray, first: np.ndarray, size: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best labels of many chains at once: chain i has the rows first[i] to first[i] + size[i] of ``score``."""
    labels = np.zeros(len(score), np.int64)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    back = np.zeros(score.shape, np.int8)
    best = score[first] + _START
    longest = int(size[0]) if len(size) else 0
    done = np.zeros(len(size), np.int64)
    for t in range(1, longest + 1):
        going = int(np.searchsorted(-size, -t, side="left"))  # chains of more than t words
        done[going : len(best)] = best[going:].argmax(1)
        best = best[:going]
        if not going:
            break
        ways = best[:, :, None] + step[None]
        at = first[:going] + t
        back[at] = ways.argmax(1)
        best = ways.max(1) + score[at]
    now = done.copy()
    for t in range(longest - 1, -1, -1):
        going = int(np.searchsorted(-size, -t, side="left"))
        at = first[:going] + t
        labels[at] = now[:going]
        now[:going] = back[at, now[:going]]
    return labels


_START = np.zeros(LABELS)
_START[2::2] = -1e9  # no chain begins in the middle of a span
_BARRED = np.zeros((LABELS, LABELS))
for _k in range(len(KINDS)):
    _BARRED[:, 2 + 2 * _k] = -1e9
    _BARRED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = 0


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(chains: list[tuple[np.ndarray, np.ndarray]], settings: Settings = Settings()) -> Field:
    """Maximum likelihood with a quadratic penalty; chains of words by feature rows and labels, most likely short."""
    chains = sorted(chains, key=lambda c: -len(c[1]))
    size = np.array([len(c[1]) for c in chains])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    rows, labels = np.concatenate([c[0] for c in chains]), np.concatenate([c[1] for c in chains])
    longest, n = int(size[0]), len(chains)
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]
    emit, step = np.zeros((_FEATURES, LABELS)), np.zeros((LABELS, LABELS))
    moment = [np.zeros_like(emit), np.zeros_like(step)]
    seen = np.zeros_like(step)
    for t in range(1, longest):
        at = first[: live[t]] + t
        np.add.at(seen, (labels[at - 1], labels[at]), 1)
    truth = np.zeros((len(labels), LABELS))
    truth[np.arange(len(labels)), labels] = 1
    for _ in range(settings.steps):
        score, moves = emit[rows].sum(1), step + _BARRED
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[first] = score[first] + _START
        for t in range(1, longest):
            at = first[: live[t]] + t
            alpha[at] = score[at] + _lse(alpha[at - 1][:, :, None] + moves[None], 1)
        for t in range(longest - 1, 0, -1):
            at = first[: live[t]] + t
            beta[at - 1] = _lse(moves[None] + (score[at] + beta[at])[:, None, :], 2)
        total = _lse(alpha[first + size - 1], 1)
        whole = np.repeat(total, size)
        chance = np.exp(alpha + beta - whole[:, None])
        expected = np.zeros_like(step)
        for t in range(1, longest):
            at = first[: live[t]] + t
            pair = alpha[at - 1][:, :, None] + moves[None] + (score[at] + beta[at])[:, None, :] - total[: live[t], None, None]
            expected += np.exp(pair).sum(0)
        slope = np.zeros_like(emit)
        np.add.at(slope, rows.ravel(), np.repeat(truth - chance, rows.shape[1], 0))
        for k, (value, up) in enumerate(((emit, slope), (step, seen - expected))):
            up = up / n - settings.decay * value
            moment[k] += up * up
            value += settings.rate * up / (np.sqrt(moment[k]) + 1e-8)
    return Field(emit, step + _BARRED)


def labelled_chains(text: str, spans: list[Span], around: int) -> list[tuple[list[str], list[int]]]:
    """Words with neighbours and labels near each span, for training."""
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    labels = [0] * len(words)
    starts = [w[0] for w in words]
    ranges = []
    for kind, a, b in spans:
        low = int(np.searchsorted(starts, a, side="right")) - 1
        high = int(np.searchsorted(starts, b, side="left"))
        for i in range(low, high):
            labels[i] = 1 + 2 * kind + (i > low)
        ranges.append((max(0, low - around), min(len(words), high + around)))
    out = []
    for low, high in ranges or [(0, min(len(words), 6 * around))]:
        out.append(([w[2] for w in words[low:high]], labels[low:high]))
    return out


def labelled_table(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A small table of ``text`` and ``spans`` for training, at most ``settings.texts`` rows.

    Lines of the documents that hold a digit or an at sign, in hash order; the rules label them, and lines where the
    rules drop a long number, whose labels would be doubtful, are left out.
    """
    line = F.explode(F.split(F.col("text"), "\n"))
    lines = docs.select(line.alias("text")).filter(F.col("text").rlike("[0-9@]") & (F.char_length("text") < 5_000)).distinct()
    picked = lines.orderBy(F.xxhash64("text", F.lit(settings.seed)), "text").limit(settings.texts)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(t, *rule_spans(t)) for t in batch.column(0).to_pylist()]
            kept = [(t, [x for s in spans for x in s]) for t, spans, dropped in found if not dropped]
            yield pa.record_batch([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.list_(pa.int32()))], names=["text", "spans"])

    return picked.mapInArrow(label, "text string, spans array<int>")


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Field | None:
    """Trains the field on a small table of ``text`` and ``spans`` (kind, start, end after one another).

    Besides the chains as they stand, spans are set side by side in pairs, so that the field also learns where one
    ends and the next begins. Without any span there is no field.
    """
    rows = labelled.orderBy(F.xxhash64("text")).limit(settings.texts).collect()
    chains = []
    for row in rows:
        flat = list(row["spans"])
        chains += labelled_chains(row["text"], list(zip(flat[::3], flat[1::3], flat[2::3])), settings.around)
    cores = [([w for w, k in zip(words, labels) if k], [k for k in labels if k]) for words, labels in chains]
    cores = [c for c in cores if c[0]]
    if not cores:
        return None
    draw = np.random.default_rng(settings.seed)
    for i, j in zip(draw.integers(0, len(cores), len(cores)), draw.integers(0, len(cores), len(cores))):
        chains.append((cores[i][0] + cores[j][0], cores[i][1] + cores[j][1]))
    coded = []
    for words, labels in chains:
        around = ["", *words, ""]
        if words:
            coded.append((np.array([features(*around[i : i + 3]) for i in range(len(words))]), np.array(labels)))
    return train(coded, settings)


def field_spans(field: Field, words: Words) -> dict[int, list[Span]]:
    """Spans in code points that the field finds, by text number."""
    marks = np.concatenate([[0], np.cumsum(_DIGIT_OR_AT[words.data])])
    told = np.flatnonzero(marks[words.end] > marks[words.start])
    if not len(told):
        return {}
    text_of = words.text[told]
    chained = (np.diff(told) == 1) & (np.diff(text_of) == 0)
    first = np.flatnonzero(np.concatenate([[True], ~chained]))
    size = np.diff(np.append(first, len(told)))

    def word(i: int, text: int) -> str:
        if not words.first[text] <= i < words.first[text + 1]:
            return ""
        return words.bytes_of(i)[:400].decode("utf-8", "replace")

    # neighbours count up to the ends of the text; words that stand alike have the same scores
    hashes = words.hashes()
    before = np.where(told > words.first[text_of], hashes[np.maximum(told - 1, 0)], np.uint64(0))
    after = np.where(told + 1 < words.first[text_of + 1], hashes[np.minimum(told + 1, len(words) - 1)], np.uint64(0))
    alike = mix(mix(mix(before) + hashes[told]) + after)
    del hashes, before, after
    labels = np.empty(len(told), np.int64)
    low = 0
    while low < len(first):  # whole chains, of so many words together or one that is longer
        high = max(low + 1, int(np.searchsorted(first, first[low] + _WORDS_AT_ONCE, side="right")) - 1)
        high = len(first) if first[-1] + size[-1] - first[low] <= _WORDS_AT_ONCE else high
        begin, end = int(first[low]), int(first[high - 1] + size[high - 1])
        _, sample, which = np.unique(alike[begin:end], return_index=True, return_inverse=True)
        score = np.empty((len(sample), LABELS))
        for at in range(0, len(sample), _WORDS_AT_ONCE):
            some = zip(told[begin + sample[at : at + _WORDS_AT_ONCE]].tolist(), text_of[begin + sample[at : at + _WORDS_AT_ONCE]].tolist())
            rows = np.array([features(word(i - 1, t), word(i, t), word(i + 1, t)) for i, t in some], np.int32)
            score[at : at + len(rows)] = scores(field, rows)
        labels[begin:end] = viterbi(score[which], first[low:high] - begin, size[low:high], field.step)
        low = high
    points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    out: dict[int, list[Span]] = {}
    at = 0
    while at < len(told):
        label, end = labels[at], at + 1
        if label:
            while end < len(told) and labels[end] == (label + 1) // 2 * 2 and chained[end - 1]:
                end += 1
            kind = int(label - 1) // 2
            text = int(text_of[at])
            low, high = int(words.start[told[at]]), int(words.end[told[end - 1]])
            whole = words.data[low:high].tobytes()
            front = len(whole) - len(whole.lstrip(b"()[]{}<>,;:!?\"'=" if kind != 3 else b"[]{}<>,;:!?\"'="))
            low, high = low + front, high - (len(whole) - len(whole.rstrip(b"()[]{}<>,;:!?\"'.-")))
            if low < high and valid(kind, words.data[low:high].tobytes().decode("utf-8", "replace")):
                begin = points[words.offsets[text]]
                out.setdefault(text, []).append((kind, int(points[low] - begin), int(points[high] - begin)))
        at = end
    return out


SCHEMA = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
)


def find(docs: DataFrame, field: Field | None) -> DataFrame:
    """Finds personal data in every whole text: ``doc_id``, counts, hash and list of spans, one row per row.

    ``n_email`` to ``n_phone`` count what the rules find, ``base_sha256`` is the hash of their spans. ``spans`` has
    these and the spans that the field adds (``n_added``): ones that overlap none of the rules' and hold what the kind
    asks for. Places are code points, ends exclusive. Null and empty texts have no spans; repeated rows are judged
    each; other columns are ignored; without a field only the rules are applied.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column(1))
            marks = np.concatenate([[0], np.cumsum(_DIGIT_OR_AT[words.data])])
            marked = marks[words.offsets[1:]] > marks[words.offsets[:-1]]
            more = field_spans(field, words) if field else {}
            texts, rows = batch.column(1), []
            for i in range(batch.num_rows):
                base = rule_spans(texts[i].as_py())[0] if marked[i] else []
                added = [s for s in more.get(i, ()) if all(s[2] <= b[1] or b[2] <= s[1] for b in base)]
                counts = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            frame = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            columns = pa.RecordBatch.from_pandas(frame, preserve_index=False)
            yield pa.record_batch([batch.column(0), *columns.columns], names=["doc_id", *frame.columns])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)


def detect(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Labels a small table, trains the field on it, and finds personal data in all texts."""
    labelled = stored(labelled_table(docs.select("text"), settings), "pii-labelled")
    return find(docs, fit(labelled, settings))

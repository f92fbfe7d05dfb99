"""The text operators against plain Python on small tables."""

import hashlib
import itertools
import random
import re
import signal
import tracemalloc
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken.load
from pyspark.sql import functions as F

from lodgewise.llm import decontaminate, fm_index, imatch, jaccard_join, line_dedup, mixing, packing, pii, substring_dedup, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, first=1):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, first)], "doc_id bigint, text string").repartition(3)


def prose(rng, n, vocabulary=400):
    return [f"w{int(rng.paretovariate(0.8)) % vocabulary}" for _ in range(n)]


# 1 line dedup


def brute_lines(texts, least):
    seen, out = set(), []
    for text in texts:
        lines = text.split("\n") if text else []
        gone = set()
        for i in range(len(lines) - least + 1):
            run = tuple(lines[i : i + least])
            if run in seen:
                gone.update(range(i, i + least))
            seen.add(run)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if text else text)
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_line_dedup(spark, least):
    rng = random.Random(least)
    texts = ["\n".join(rng.choice("abcdefgh") * rng.randint(0, 2) for _ in range(rng.randint(0, 25))) for _ in range(40)]
    texts += ["x\nx\nx\nx\nx\nx\nx", "x\nx\nx\nx", None, ""]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs_of(spark, texts), least).collect()}
    assert [got[i] for i in range(1, len(texts) + 1)] == brute_lines(texts, least)


def brute_long_lines(texts, least, words):
    """As `brute_lines`; runs of fewer lines go too if they have so many words."""
    seen, out = set(), []
    for text in texts:
        lines = text.split("\n") if text else []
        gone = set()
        for i in range(len(lines)):
            for n in range(1, least + 1):
                run = tuple(lines[i : i + n])
                if len(run) == n:
                    if run in seen and (n == least or len(WORD.findall(" ".join(run))) >= words):
                        gone.update(range(i, i + n))
                    seen.add(run)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if text else text)
    return out


@pytest.mark.parametrize("least", [1, 2, 4])
def test_line_dedup_of_long_lines(spark, least):
    rng = random.Random(least)
    lines = [" ".join(prose(rng, n)) for n in (1, 2, 3, 5, 9, 10, 11, 30)] + ["", "\t "]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8))) for _ in range(60)] + [lines[-3]] * 3 + [None, ""]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs_of(spark, texts), least, 10).collect()}
    assert [got[i] for i in range(1, len(texts) + 1)] == brute_long_lines(texts, least, 10)


def test_one_line_documents_are_deduped(spark):
    passage = " ".join(prose(random.Random(5), line_dedup.MIN_WORDS))
    short = passage.rsplit(" ", 1)[0]
    texts = [passage, f"unlike\n{passage}\nothers", passage, short, short]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(1, 6)] == [(passage, 0), ("unlike\nothers", 1), ("", 1), (short, 0), (short, 0)]


def test_runs_of_documents_without_id_are_weighed(spark):
    passage = [" ".join(prose(random.Random(k), 20)) for k in range(3)]
    rows = [(None, "\n".join(passage)), (4, "\n".join(["unlike", *passage[:3]])), (5, "\n".join(passage[:2]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup(docs, 4, 50).collect()}
    assert got == {None: 0, 4: 3, 5: 0}
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup(docs.selectExpr("-doc_id AS doc_id", "text"), 4, 40).collect()}
    assert got == {None: 0, -5: 2, -4: 3}
    twice = spark.createDataFrame([(1, passage[0]), (None, passage[0] * 3), (None, passage[0] * 3 + "\nx")], docs.schema)
    assert sum(r["n_removed"] for r in line_dedup.dedup(twice).collect()) == 1


# 2 decontamination


def brute_distance(item, words):
    row = [0] * (len(words) + 1)
    for k, w in enumerate(item, 1):
        new = [k]
        for j, x in enumerate(words, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(3)
    items = [[f"q{rng.randint(0, 3000)}" for _ in range(rng.choice([5, 6, 7, 8, 12, 25, 60]))] for _ in range(60)]
    items.append(["same"] * 12)
    texts, exact = [], set()
    for d in range(150):
        words = prose(rng, rng.randint(0, 120))
        which = rng.randrange(len(items))
        passage = list(items[which])
        edits = rng.choice([0, 0, 1, 2, len(passage) // 5, len(passage) // 3])
        for _ in range(edits):
            at = rng.randrange(len(passage))
            passage[at : at + 1] = rng.choice([[], ["new"], [passage[at], "new"]])
        at = rng.randint(0, len(words))
        texts.append(" ".join(words[:at] + passage + words[at:]).upper() if d % 3 else " ".join(words))
        if d % 3 and not edits:
            exact.add((d + 1, which))
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find(docs_of(spark, texts), table).collect()}
    want = {}
    for (d, text), (i, item) in itertools.product(enumerate(texts, 1), enumerate(items)):
        far = brute_distance(item, text.lower().split())
        if far <= (0 if len(item) < decontaminate.LEAST_EDITED else len(item) // 5):
            want[d, i] = far
    assert exact <= set(got)
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(got[p] >= want[p] for p in got)
    kept = {r["doc_id"] for r in decontaminate.clean(docs_of(spark, texts), table).collect()}
    assert kept == set(range(1, len(texts) + 1)) - {d for d, _ in got}


@pytest.mark.parametrize("most_tables", [24, 1])
def test_decontamination_of_short_and_hard_items(spark, monkeypatch, most_tables):
    monkeypatch.setattr(decontaminate, "MOST_TABLES", most_tables)  # one doesn't reach the recall
    rng = random.Random(23)
    items = [[f"q{rng.randint(0, 40)}" for _ in range(n)] for n in [1, 2, 3, 4, 5, 5, 6, 6, 7, 7] * 3] + [["same"] * 10]
    if most_tables == 1:
        items += [[f"r{rng.randint(0, 900)}" for _ in range(n)] for n in (10, 20, 30)]
    texts = []
    for _ in range(120):
        passage = list(rng.choice(items))
        for _ in range(rng.choice([0, 1, 1, 2, len(passage) // 5])):
            at = rng.randrange(len(passage) + 1)
            passage[at : at + 1] = rng.choice([[], ["new"], ["new", "q1"]])
        texts.append(" ".join(prose(rng, rng.randint(0, 20)) + passage + prose(rng, rng.randint(0, 20))))
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find(docs_of(spark, texts), table).collect()}
    want = {}
    for (d, text), (i, item) in itertools.product(enumerate(texts, 1), enumerate(items)):
        far = brute_distance(item, text.split())
        if far <= (0 if len(item) < 5 else len(item) // 5):
            want[d, i] = far
    assert got == want


# 3 URL rules


def test_url_rules(spark):
    rules = [
        url_filter.site_rule("com", "/", "allow"),
        url_filter.site_rule("example.com", "/en/", "block"),
        url_filter.site_rule("www.example.com", "/en/", "allow"),
        url_filter.site_rule("net", "/es/", "block"),
        url_filter.pattern_rule("paged", r"[?&]page=[0-9]+", "block", "page"),
    ]
    cases = {
        "http://EXAMPLE.com/en/x": ("example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://a.www.example.com/en/?q#z": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://badexample.com/en/x": ("badexample.com", "/en/x", "com/", "allow"),
        "http://example.com/EN/x?page=3": ("example.com", "/EN/x", "com/", "allow"),
        "http://b.net/es/1": ("b.net", "/es/1", "net/es/", "block"),
        "http://b.net/es": ("b.net", "/es", None, "allow"),
        "http://b.org/l?page=2": ("b.org", "/l", None, "block"),
        "http://b.com": ("b.com", "", None, "allow"),
        "b.com/en/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id bigint, url string")
    got = url_filter.judge(pages, rules).orderBy("page_id").collect()
    assert [tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in got] == list(cases.values())


# 4 personal data

BASE = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    r"[0-9](?:[\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            checksum = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            good = (
                kind == 0
                or (kind == 1 and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == 2 and 16 <= len(digits) <= 19 and checksum % 10 == 0)
                or (kind == 3 and 8 <= len(digits) <= 15)
            )
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_rules_equal_the_patterns():
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choice("a.@-+ 0123456789()é_%,") for _ in range(rng.randint(0, 45)))
        assert pii.rule_spans(text)[0] == brute_spans(text), text
    card = "4111 1111 1111 1111"
    assert [s[0] for s in pii.rule_spans(f"{card} and 10.0.0.256 and 010.0.0.255 +65 (9123) 4567")[0]] == [1, 2, 3]


def test_pii_whole_texts(spark):
    card = "4111-1111-1111-1111"
    texts = [f"mail é{i}@x.org or +44 20 7946 0{i:03d}, host 10.0.0.{i} card {card}" for i in range(60)] + ["plain words", "", None]
    rows = {r["doc_id"]: r for r in pii.detect(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts, 1):
        base = brute_spans(text or "")
        assert rows[i]["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in range(4)]
        told = set(rows[i]["spans"].split(",")) - {""}
        assert set(pii.joined(base).split(",")) - {""} <= told and len(told) == len(base) + rows[i]["n_added"]


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    step = rng.normal(size=(pii.LABELS, pii.LABELS)) + pii._BARRED
    size = np.array([1, 4, 2, 3])
    score = rng.normal(size=(size.sum(), pii.LABELS)) * 2
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    got = pii.viterbi(score, first, size, step)
    for a, n in zip(first, size):
        def total(path):
            return pii._START[path[0]] + sum(score[a + t, y] for t, y in enumerate(path)) + sum(step[x, y] for x, y in zip(path, path[1:]))

        best = max(itertools.product(range(pii.LABELS), repeat=int(n)), key=total)
        assert tuple(got[a : a + n]) == best


# 5 Jaccard join


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def brute_components(sets, threshold):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("n,threshold", [(4, Fraction(85, 100)), (5, Fraction(80, 100)), (1, Fraction(1, 2))])
def test_jaccard_join(spark, n, threshold):
    rng = random.Random(n)
    texts = [None, "", " \t\n", "one", "ONE", "one two", "one two three four", "One Two Three Four"]
    for _ in range(12):
        words = prose(rng, rng.choice([3, 8, 20, 60, 200]))
        for _ in range(rng.randint(1, 10)):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, len(words) // 40, len(words) // 20])):
                copy[rng.randrange(len(copy))] = "new"
            cut = rng.choice([0, 0, 1, len(words) // 12])
            texts.append(" ".join(copy[cut:]))
    sets = {i: shingles(t, n) for i, t in enumerate(texts, 1)}
    want = brute_components(sets, threshold)
    docs = docs_of(spark, texts)
    rows = jaccard_join.join(docs, n, threshold).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {d: len(s) for d, s in sets.items()}
    kept = {r["doc_id"] for r in jaccard_join.representatives(docs, n, threshold).collect()}
    assert kept == set(want.values())


@pytest.mark.parametrize("threshold", [Fraction(t, 100) for t in (30, 50, 60, 80, 85, 95, 100)])
def test_linked_sets_of_few_tokens_share_a_key(threshold):
    def stopped(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, stopped)
    signal.alarm(30)  # the numbers of blocks were once sought without an end
    try:
        bands = jaccard_join.Bands(threshold, 5_000)
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
    assert (bands.spare >= 1).all() and (bands.blocks == bands.differ + 1 + bands.spare).all()
    rng = random.Random(threshold.numerator)
    sets = []
    for size in [*range(1, 41)] * 3:
        base = [rng.getrandbits(63) for _ in range(size)]
        sets += [base, base[1:] or base, [*base, rng.getrandbits(63)], [*base[:-1], rng.getrandbits(63)], base[: -1 - size // 6] or base]
    tokens = [np.unique(np.array(x, np.uint64)) for x in sets]
    which, key = jaccard_join.block_keys(np.concatenate(tokens), np.array([len(x) for x in tokens]), bands)
    keys = [set(key[which == i].tolist()) for i in range(len(sets))]
    for start in range(0, len(sets), 5):
        for i, j in itertools.combinations(range(start, start + 5), 2):
            a, b = set(sets[i]), set(sets[j])
            if a != b and len(a & b) >= threshold * len(a | b):
                assert keys[i] & keys[j]


def test_long_sketches_bound_the_difference():
    rng = random.Random(11)
    for size, more in ((600, 0), (1_000, 40), (1_020, 10), (3_000, 0), (5_000, 400)):
        base = [rng.getrandbits(63) for _ in range(size + more)]
        a, b = set(base), set(base[more:-7]) | {rng.getrandbits(63) for _ in range(5)}
        far = {rng.getrandbits(63) for _ in range(size)}
        tokens = [np.sort(np.array(list(x), np.uint64)) for x in (a, b, far)]
        sizes = np.array([len(x) for x in tokens])
        u, v, w = (np.frombuffer(x, np.uint64) for x in jaccard_join.long_sketches(np.concatenate(tokens), sizes))
        assert len(u) * 64 >= len(a) and jaccard_join.apart(u, v) == jaccard_join.apart(v, u) <= len(a ^ b)
        assert jaccard_join.apart(u, w) * 9 > len(a) + len(far)  # not at 0.8
    assert jaccard_join.long_sketches(np.arange(512, dtype=np.uint64), np.array([512])) == [None]


def test_long_texts_that_share_little_are_not_fetched(spark, monkeypatch):
    rng = random.Random(12)
    common = [f"c{i}" for i in range(400)]
    texts = [" ".join([*common, *(f"t{t}x{rng.getrandbits(40)}" for _ in range(1_300 + 10 * t))]) for t in range(12)]
    near = texts[0].split(" ")
    near[700] = "edited"
    texts.append(" ".join(near))
    real, asked = jaccard_join.linked, []

    def linked(docs, pairs, *more):
        asked.extend(tuple(r) for r in pairs.select("u", "v").collect())
        return real(docs, pairs, *more)

    monkeypatch.setattr(jaccard_join, "linked", linked)
    kept = {r["doc_id"] for r in jaccard_join.representatives(docs_of(spark, texts)).collect()}
    assert kept == set(range(1, 13)) and len(asked) == 1  # pairs that only share a passage grow with the square of the texts


def test_near_copies_leave_no_tokens_and_move_texts_once(spark):
    from lodgewise.session import shared_folder

    texts = [" ".join(prose(random.Random(i // 2), 300 + i % 2)) for i in range(20)]
    docs = docs_of(spark, texts).unionByName(docs_of(spark, texts)).unionByName(docs_of(spark, texts[:1]).withColumn("doc_id", F.lit(None).cast("bigint")))
    before, key = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), "spark.sql.autoBroadcastJoinThreshold"
    folder = Path(shared_folder(spark).removeprefix("file://"))
    there = set(folder.glob("token-sets-*"))
    spark.conf.set(key, "-1")
    try:
        kept = jaccard_join.representatives(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        # both sides of the join; the window takes the rows as they are
        assert len(re.findall(r"Exchange hashpartitioning\(_node", plan)) == 2 and plan.count("Exchange hashpartitioning(_") == 2
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(1, 21, 2))
    finally:
        spark.conf.set(key, before)
    assert set(folder.glob("token-sets-*")) == there


# 6 packing


def test_packing_round_trip(spark):
    rng = random.Random(6)
    texts = [" ".join(prose(rng, rng.choice([1, 10, 100, 900]))) for _ in range(60)] + ["", None, "a b  c", "é" * 700]
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = tiktoken.load.load_tiktoken_bpe(path)
    raw = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = packing.pack(docs_of(spark, texts), path, pattern, row_length=128, block=2_000).collect()
    parts = {}
    for r in rows:
        ids, cuts = np.frombuffer(r["ids"], "<u2").tolist(), r["cu_seqlens"]
        assert len(ids) == 128 and cuts[-1] == r["n_tokens"] <= 128 and r["resets"] == cuts[:-1]
        for doc, piece, of, a, b in zip(r["doc_ids"], r["pieces"], r["n_pieces"], cuts, cuts[1:]):
            parts[doc, piece] = (of, ids[a:b])
    for i, text in enumerate(texts, 1):
        of = parts[i, 0][0]
        assert sum((parts[i, k][1] for k in range(of)), []) == raw.encode_ordinary(text or "") + [50256]


def test_best_fit_decreasing():
    rng = random.Random(60)
    for _ in range(100):
        most = rng.randint(1, 40)
        lengths = np.array([rng.randint(1, most) for _ in range(rng.randint(1, 60))])
        rooms, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [r for r in range(len(rooms)) if rooms[r] >= lengths[i]]
            if not fits:
                rooms.append(most)
                fits = [len(rooms) - 1]
            rooms[min(fits, key=lambda r: rooms[r])] -= lengths[i]
        got = packing.best_fit(lengths, most)
        assert sorted(i for row in got for i in row) == list(range(len(lengths)))
        assert sorted(most - lengths[row].sum() for row in got) == sorted(rooms)


# 8 fingerprints


def test_imatch_edited_texts(spark):
    rng = random.Random(8)
    texts = [" ".join(prose(rng, rng.randint(1, 80))) + " é😀" for _ in range(40)] + [None, "", "x"]
    texts.append(texts[0])
    rows = {r["doc_id"]: r for r in imatch.compare(docs_of(spark, texts)).collect()}
    assert len(rows) == len(texts)
    whole = [t or "" for t in texts]
    for i, text in enumerate(whole, 1):
        following = whole[i - 2] if i > 1 else whole[-1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert rows[1]["fingerprint"] == rows[len(texts)]["fingerprint"] != rows[2]["fingerprint"]
    assert rows[1]["near_next"] == 1  # its next is the last document, which is equal


# 7 toxicity


def toxic_corpus(spark):
    """2,400 texts, a sixth toxic; one toxic text in twelve has the rare word instead of the common one."""
    rng, rows, labels = random.Random(7), [], []
    for i in range(2_400):
        words = prose(rng, 20)
        if i % 6 == 0:
            words[3] = "scoundrel" if i % 72 else "blatherskite"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    rows += [(10_000 + k, rows[1][1] + " copied") for k in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxic_features_are_counted_over_all_texts(spark):
    docs, labels = toxic_corpus(spark)
    whole = toxicity.fit(docs, labels)
    some = toxicity.fit(docs.repartition(5), labels, toxicity.Settings(positives=20, unlabelled=200))
    assert some.buckets.tolist() == whole.buckets.tolist()
    rare = toxicity.features(pa.array(["blatherskite"]))[1]
    assert set(rare.tolist()) & set(some.buckets.tolist())


def test_counts_take_equal_texts_once():
    texts = pa.record_batch([pa.array([1, 0, 0]), pa.array(["vile man", "man man", ""])], names=["positive", "text"])
    (got,) = toxicity._counted(iter([texts]))
    told = {r["bucket"]: (r["u"], r["p"]) for r in got.to_pylist()}
    (man,) = {int(b) for b in toxicity.features(pa.array(["man"]))[1]}
    (vile,) = {int(b) for b in toxicity.features(pa.array(["vile"]))[1]}
    assert told == {-1: (3, 1), man: (2, 1), vile: (1, 1)}


def test_counts_hold_little_and_are_told_in_parts():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(1_000)) for _ in range(600)]
    batch = pa.record_batch([pa.array([i % 2 for i in range(600)]), pa.array(texts)], names=["positive", "text"])
    tracemalloc.start()
    got = list(toxicity._counted(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 << 20  # two counts of eight bytes for each bucket, and one slice's passes
    assert max(b.num_rows for b in got) <= 1 << 16
    rows = [r for b in got for r in b.to_pylist()]
    held = [set(toxicity.features(pa.array([t]))[1].tolist()) for t in texts]
    both = Counter(b for h in held for b in h), Counter(b for h in held[1::2] for b in h)
    assert {r["bucket"]: (r["u"], r["p"]) for r in rows} == {-1: (600, 300)} | {b: (n, both[1][b]) for b, n in both[0].items()}
    assert len(rows) == len(both[0]) + 1


# 9 mixing


def test_mixing_takes_what_it_told(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None, "c"]) if i % 3 else "a", " ".join(prose(rng, rng.randint(0, 50)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(3)
    told = {r["doc_id"]: r for r in mixing.allot(docs).collect()}
    mixed = mixing.mix(docs).toPandas()
    words = mixed.groupby("doc_id")["text"].agg(lambda s: sum(len(WORD.findall(t)) for t in s)).to_dict()
    assert all(words.get(i, 0) == r["taken"] <= 2 * r["size"] for i, r in told.items())
    for source in {r[1] for r in rows}:
        mine = [r for r in told.values() if r["source"] == source]
        assert 0 <= mine[0]["target"] - sum(r["taken"] for r in mine) < 1
        assert mine[0]["source_size"] == sum(r["size"] for r in mine)
    again = mixing.mix(docs.repartition(7)).toPandas()
    pd.testing.assert_frame_equal(mixed, again)


def test_mixing_tallies_its_sorted_copies(spark, monkeypatch):
    rng = random.Random(19)
    rows = [(i, rng.choice(["a", "b", None]), " ".join(prose(rng, rng.randint(0, 20)))) for i in range(80)] + [(None, "b", "x y"), (3, "a", "x"), (3, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(3)
    columns = ["doc_id", "source", "size", "target", "laid", "taken"]
    told = sorted(map(str, mixing.allot(docs).select(*columns).collect()))
    assert sorted(map(str, mixing.tally(docs).select(*columns).collect())) == told
    emitted = mixing.copies(docs)
    monkeypatch.setattr(mixing, "copies", lambda *a: emitted.filter("_copy = 0"))
    once = mixing.tally(docs).collect()
    assert len(once) == len(rows) and sum(r["taken"] for r in once) == emitted.filter("_copy = 0").agg({"_words": "sum"}).first()[0]


# 10 substring dedup


def test_suffix_order_and_search():
    rng = np.random.default_rng(10)
    for most in (1, 2, 9):
        text = np.append(rng.integers(1, most + 1, 120), 0)
        index = fm_index.FMIndex(text, most, 6)
        ends = np.arange(6, 121)
        got = index.least_places(text, ends, 6)
        body = text.tolist()
        want = [next(s for s in range(120) if body[s : s + 6] == body[e - 6 : e]) for e in ends]
        assert got.tolist() == want


@pytest.mark.parametrize("hot", [2_000, 2])
def test_substring_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(hot)
    passages = [prose(rng, rng.choice([19, 20, 21, 55])) for _ in range(6)]
    texts = [None, "", "a " * 70, "b " * 20, " ".join(["a", "b"] * 40)]
    for _ in range(50):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += prose(rng, rng.randint(0, 30)) + rng.choice(passages)
        texts.append("  ".join(words))
    texts += texts[-4:]
    seen, want = set(), {}
    for i, text in enumerate(texts, 1):
        words, gone = WORD.findall(text or ""), set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        want[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    rows = substring_dedup.dedup(docs_of(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in rows} == want

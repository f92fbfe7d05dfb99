"""Near vectors, the conversation trie and the source audit against plain Python on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodgewise.llm import divergence, near_vectors, prefix_trie

# near vectors

VECTORS = "vec_id bigint, embedding array<double>"


def brute_links(vectors, threshold):
    fit = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(vectors)
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if fit[i] and fit[j] and len(vectors[i]) == len(vectors[j]):
                a, b = (np.array(vectors[k]) / np.abs(vectors[k]).max() for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i].append(j)
                    links[j].append(i)
    return links


def components_of(links, ids):
    seen, least = {}, {}
    for i in range(len(links)):
        if i in seen:
            continue
        todo, members = [i], {i}
        while todo:
            for j in links[todo.pop()]:
                if j not in members:
                    members.add(j)
                    todo.append(j)
        known = [ids[m] for m in members if ids[m] is not None]
        for m in members:
            seen[m] = i
            least[m] = min(known) if known else None
    return [least[i] for i in range(len(links))]


def clustered(rng, centres, each, dim, spread):
    out = []
    for c in rng.standard_normal((centres, dim)):
        out += [c + spread * rng.standard_normal(dim) for _ in range(each)]
    return [list(map(float, v)) for v in out]


@pytest.mark.parametrize("cell, block", [(1_024, None), (20, None), (20, 16)])
def test_near_vectors_against_all_pairs(spark, cell, block):
    rng = np.random.default_rng(cell + (block or 0))
    vectors = clustered(rng, 30, 6, 12, 0.18) + clustered(rng, 1, 60, 12, 0.1) + clustered(rng, 100, 1, 12, 0)
    vectors += [vectors[0]] * 5 + [[2 * x for x in vectors[7]]]
    df = spark.createDataFrame(list(enumerate(vectors)), VECTORS).repartition(3)
    got = near_vectors.near_vectors(df, 0.95, 0.999, cell=cell, block=block).orderBy("vec_id").collect()
    links = brute_links(vectors, 0.95)
    wanted, found = sum(map(len, links)), sum(r["n_links"] for r in got)
    assert len(got) == len(vectors) and found <= wanted and found >= 0.99 * wanted
    assert all(r["n_links"] <= len(x) for r, x in zip(got, links))
    if cell == 1_024 or found == wanted:
        assert [r["component_id"] for r in got] == components_of(links, range(len(vectors)))
        assert [r["n_links"] for r in got] == list(map(len, links))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_deeper_cells_take_more_tables():
    rng = np.random.default_rng(1)
    sample = rng.standard_normal((300, 16))
    small, large = near_vectors.plan(sample, 1_000), near_vectors.plan(sample, 10_000_000)
    assert small.depth == 0 and small.tables == 1
    assert large.depth > 2 and large.tables > small.tables
    assert 1 - (1 - near_vectors.same_cell(large.depth)) ** large.tables >= 0.995


def test_windows_find_every_pair_that_collides_often_enough():
    rng = np.random.default_rng(3)
    places = rng.standard_normal((5, 60))
    group = np.sort(rng.integers(0, 4, 60))
    got = Counter()
    for a, b in near_vectors._windows(group, places, 0.8, 3):
        got.update((min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist()))
    want = {
        (i, j)
        for i in range(60)
        for j in range(i + 1, 60)
        if group[i] == group[j] and (np.abs(places[:, i] - places[:, j]) <= 0.8).sum() >= 3
    }
    assert set(got) == want and set(got.values()) == {1}


def test_near_vectors_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [[1.0, 0.0], [2.0, 0.0], None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 0.0, 0.0], [1e300, 1e290], [1e-300, 0.0]]
    vectors += [[1.0, 0.0], [-1.0, 0.0], [0.0, 0.0]]
    ids = [5, 6, 7, None, 9, 9, 10, 11, 12, 3, None, 5, 13, 14]
    schema = VECTORS + ", node string, n string, cells string, root string"
    df = spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in zip(ids, vectors)], schema)
    got = near_vectors.near_vectors(df).collect()
    links = brute_links(vectors, 0.95)
    least = components_of(links, ids)
    want = Counter((i, len(x), c, i == c) for i, x, c in zip(ids, links, least))
    assert Counter(map(tuple, got)) == want
    assert near_vectors.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    floats = spark.createDataFrame([(1, [0.5, 0.25]), (2, [1.0, 0.5])], "vec_id int, embedding array<float>")
    assert [r["n_links"] for r in near_vectors.near_vectors(floats).collect()] == [1, 1]


# conversations

TURNS = "conv_id bigint, turn bigint, role string, text string"


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0, hashlib.md5(f"{role}\n{text}".encode()).hexdigest()), (role, text)))
    return {c: [t for _, t in sorted(turns)] for c, turns in convs.items()}


def brute_nodes(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, inside in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(inside) - 1) * len(p[-1][1]) if p else 0
    return Counter(
        (
            min(inside),
            len(p),
            min(members[p[:-1]]) if p else None,
            len(inside),
            children[p],
            leaves[p],
            saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
        for p, inside in members.items()
    )


def random_turns(seed, n, most=12):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        shape = rng.random()
        length = 0 if shape < 0.05 else rng.randint(1, most)
        turns = [(i, rng.choice("ua"), rng.choice("xy") * rng.randint(0, 2)) for i in range(length)]
        if shape > 0.7:
            turns = [(i, "u", "same") for i in range(length)]
        rows += [(c * 37 - 400, *t) for t in turns]
    return rows


@pytest.mark.parametrize("seed, n, most", [(1, 150, 6), (2, 60, 70)])
def test_trie_against_all_prefixes(spark, seed, n, most):
    rows = random_turns(seed, n, most)
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert Counter(map(tuple, prefix_trie.prefixes(df).collect())) == brute_nodes(ordered(rows))


def test_edges_are_the_compacted_trie(spark):
    rows = random_turns(5, 80, 9)
    trie = prefix_trie.build(*prefix_trie.whole(prefix_trie.placed(spark.createDataFrame(rows, TURNS))))
    convs = ordered(rows)
    prefixes = {tuple(t[:d]) for t in convs.values() for d in range(len(t) + 1)}
    nexts = Counter(p[:-1] for p in prefixes if p)
    nodes = {p for p in prefixes if p and (nexts[p] != 1 or list(p) in convs.values())}
    got = [(r["s"], r["e"], r["w"]) for r in trie.edges.collect()]
    assert {tuple(convs[w][:e]) for s, e, w in got} == nodes and len(got) == len(nodes)
    for s, e, w in got:
        assert s == max(d for d in range(e) if d == 0 or tuple(convs[w][:d]) in nodes)


def test_spliced_conversations(spark):
    rows = [(c, i, "u", f"{c if i > c % 7 else 0}.{i}") for c in [*range(95, 130), 200, 450, -250, -200, -201] for i in range(c % 9)]
    rows += [(100, 5, "a", "more"), (100, 6, "a", "more"), (100, 7, "a", "more"), (131, None, None, None), (131, 0, "u", None)]
    base = ordered(rows)
    want = {}
    for c, turns in base.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - int(np.fmod(c, 100))
        want[c] = base.get(first, [])[:h] + turns[h:]
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    built = prefix_trie.build(*prefix_trie.spliced(prefix_trie.placed(df)))
    assert Counter(map(tuple, prefix_trie.expand(built).collect())) == brute_nodes(want)


def test_trie_edge_cases(spark):
    rows = [
        (None, 0, "u", "lost"),
        (1, None, "u", "b"),
        (1, None, None, None),
        (1, -5_000_000_000, "u", "c"),
        (1, 9_000_000_000, "u", "d" * 100_000),
        (2, 3, "u", "b"),
        (2, 3, "u", "b"),
        (2, 3, "a", "é😀"),
        (70_000, 0, "u", "b"),
        (140_000, 0, "u", "b"),
        (5, 0, "u", "b"),
    ]
    extra = ["conv", "p", "i", "n", "block", "length", "x1", "e"]
    df = spark.createDataFrame([(*r, *extra) for r in rows], TURNS + "".join(f", {c} string" for c in extra))
    assert Counter(map(tuple, prefix_trie.prefixes(df).collect())) == brute_nodes(ordered(rows))
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefixes(empty).count() == 0
    assert prefix_trie.prefixes(spark.createDataFrame(rows[:1], TURNS)).count() == 0


# sources


def brute_audit(docs, min_df, top):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [[x or "" for x in d] for d in docs]
    cut = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(lower)) for text, _, _ in docs]
    df = Counter((lang, t) for (_, lang, _), terms in zip(docs, cut) for t in set(terms))
    counts = {(lang, source): Counter() for _, lang, source in docs}
    for (_, lang, source), terms in zip(docs, cut):
        counts[lang, source].update(t for t in terms if df[lang, t] >= min_df)
    rows = set()
    for lang, source in counts:
        kept = [t for l, t in df if l == lang and df[l, t] >= min_df]
        of_lang = sum((c for (l, _), c in counts.items() if l == lang), Counter())

        def share(c, t):
            return 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def apart(p, q):
            return (p - q) * (p - q) // (p + q)

        own = counts[lang, source]
        pairs = [(s, sum(apart(share(own, t), share(c, t)) for t in kept)) for (l, s), c in counts.items() if l == lang and s != source]
        terms = [(t, apart(share(own, t), share(of_lang, t))) for t in kept if own[t] and share(own, t) > share(of_lang, t)]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            rows |= {(lang, source, part, item, value, r) for r, (item, value) in enumerate(items[:most], 1)}
    return rows


DOCS = "text string, lang string, source string"


def some_docs(seed, n):
    rng = random.Random(seed)
    words = ["The", "the", "é", "Éa", "a_b", "x1y", "día", "zebra", "über-Wort", "語", "q\x00r", "Ω", "lamp", "Tree", "😀"]
    docs = [
        (" ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "B"]))
        for _ in range(n)
    ]
    return docs + [(None, "en", "silent"), (None, None, None), ("", "fr", "a"), ("once", "fr", "b"), ("the " * 30_000, "en", "long"), ("é" * 70_000, "en", "a")]


@pytest.mark.parametrize("slice_terms", [1 << 20, 3])
def test_audit_against_brute_force(spark, slice_terms):
    docs = some_docs(slice_terms, 120)
    df = spark.createDataFrame([(*d, "x", "x") for d in docs], DOCS + ", grp string, n string").repartition(3)
    got = divergence.audit(df, 3, 4, slice_terms).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute_audit(docs, 3, 4)


def test_audit_shares_are_exact_for_large_counts(spark):
    df = spark.createDataFrame([(10**13, 10**14, 10**6)], "n bigint, total bigint, v bigint")
    got = df.select(divergence._share("n", "total", "v")).first()[0]
    assert got == 1 + 1_000_000_000 * (10**13 + 2) // (10**14 + 2 * 10**6)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    alone = spark.createDataFrame([(None, None, None)] * 3 + [(None, None, "s")], DOCS)
    assert [tuple(r) for r in divergence.audit(alone).orderBy("source").collect()] == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]
    one = spark.createDataFrame([("word", "en", "s")] * 10, DOCS)
    assert divergence.audit(one).where(F.col("part") == "pair").count() == 0

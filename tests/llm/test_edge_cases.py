"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodgewise.llm import decontaminate, imatch, jaccard_join, line_dedup, mixing, packing, pii, substring_dedup, toxicity, url_filter

LONG = " ".join(f"word{i % 5000}" for i in range(60_000)) + "\n" + "x" * 100_000
ROWS = [
    (1, "plain words in a row\nand a second line", "en", "a", 40),
    (1, "plain words in a row\nand a second line", "en", "a", 40),
    (1, "the same id with another text", None, "a", None),
    (None, "no id at all but words and words", "en", None, 3),
    (None, None, None, None, None),
    (5, None, "en", "b", 0),
    (6, "", "en", "b", 0),
    (7, " \t\n \x0b", "en", "b", 5),
    (8, LONG, "en", "a", len(LONG)),
    (9, LONG, "de", "c", len(LONG)),
    (10, "a@b.co 10.0.0.1 😀 é", "fr", "c", 20),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = (
    "n_lines n_removed name a b key node root u v component_id n_shingles first begin size target taken laid start end score "
    "positive held predicted bucket row anchor shard content total hash slot place n text_id hashes _hash _key _row _place _copy _words _node _id _kept _runs _doc _at"
).split()


def packed(docs):
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def items(docs):
    return docs.sparkSession.createDataFrame([(1, "plain words in a row and a second line"), (2, None), (3, ""), (None, "short")], "item_id bigint, text string")


def labels(docs):
    rows = [(1, 1, 1), (8, 0, 0), (9, 0, 1), (10, None, None), (None, 0, 0), (11, 1, 0)]
    return docs.sparkSession.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


PER_ROW = {
    "line_dedup": line_dedup.dedup,
    "pii": lambda d: pii.find(d, None),
    "pii_detect": pii.detect,
    "jaccard_join": jaccard_join.join,
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels(d))),
    "imatch": imatch.compare,
    "mixing_allot": mixing.allot,
    "substring_dedup": substring_dedup.dedup,
    "url_filter": lambda d: url_filter.judge(d, [url_filter.site_rule("com", "/", "allow")], "text"),
}
FILTERS = {
    "representatives": jaccard_join.representatives,
    "clean": lambda d: decontaminate.clean(d, items(d)),
    "keep": lambda d: toxicity.keep(d, toxicity.fit(d, labels(d))),
    "mix": mixing.mix,
}
OTHERS = {"leaks": lambda d: decontaminate.find(d, items(d)), "packed": packed}
EVERY = PER_ROW | FILTERS | OTHERS


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("name", sorted(EVERY))
def test_empty_table(spark, name):
    empty = spark.createDataFrame([], SCHEMA)
    assert EVERY[name](empty).count() == 0


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_row_per_row(docs, name):
    got = PER_ROW[name](docs)
    assert got.count() == len(ROWS)
    if "doc_id" in got.columns:
        assert sorted(str(r[0]) for r in got.select("doc_id").collect()) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", sorted(EVERY))
def test_clashing_columns_change_nothing(docs, name):
    if name == "url_filter":
        return  # its own columns are replaced, see its docstring
    more = docs.withColumns({c: F.lit("extra") for c in CLASHING})
    plain, clashing = EVERY[name](docs), EVERY[name](more)
    shared = [c for c in plain.columns if c in ("doc_id", "text", "component_id", "n_removed", "spans", "score", "fingerprint", "taken", "ids")]
    rows = lambda df: sorted(map(str, df.select(*shared).collect()))
    assert rows(plain) == rows(clashing)
    if name in FILTERS:
        assert clashing.columns == more.columns
    if name in FILTERS or name == "line_dedup":
        kept = [c for c in CLASHING if name in FILTERS or c not in ("n_lines", "n_removed")]
        assert clashing.select(*kept).distinct().collect() == [("extra",) * len(kept)]


def test_texts_that_are_alike_in_nothing_stay(docs):
    kept = jaccard_join.representatives(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["1", "1", "None", "None", "5", "6", "7", "8", "10"])
    cleaned = decontaminate.clean(docs, items(docs)).collect()
    assert len(cleaned) == len(ROWS) - 2  # both rows that hold the item


def test_all_rows_null(spark):
    docs = spark.createDataFrame([(None,) * 5] * 3, SCHEMA)
    for name, operator in PER_ROW.items():
        assert operator(docs).count() == 3, name
    for name in ("representatives", "clean", "keep"):
        assert FILTERS[name](docs).count() == 3, name

"""The queries of the numbered operators over their whole tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgewise.llm import decontaminate, divergence, imatch, jaccard_join, line_dedup, mixing, near_vectors, packing, pii, prefix_trie, substring_dedup, toxicity, url_filter
from lodgewise.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# The site rules of the contract, and pattern rules for pages that repeat other pages.
URL_RULES = [
    url_filter.site_rule("com", "/", "allow"),
    url_filter.site_rule("example.com", "/en/", "block"),
    url_filter.site_rule("www.example.com", "/en/", "allow"),
    url_filter.site_rule("net", "/es/", "block"),
    url_filter.site_rule("net", "/fr/", "block"),
    url_filter.pattern_rule("paged-list", r"[?&]page=[0-9]+(?:&|#|$)", "block", "page"),
    url_filter.pattern_rule("sign-in", r"/(?:users?/)?login(?:[/?#]|$)", "block", "login"),
    url_filter.pattern_rule("sign-up", r"/signup(?:[/?#]|$)", "block", "signup"),
    url_filter.pattern_rule("basket", r"/cart(?:[/?#]|$)", "block", "cart"),
]


@query(
    "op3_url_filter",
    r"""
    WITH parts AS (
      SELECT page_id, url,
        CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
    sites AS (
      SELECT page_id, lower(url) AS whole, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM parts),
    ruled AS (
      SELECT *, CASE
        WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
        CASE WHEN regexp_matches(whole, '[?&]page=[0-9]+(&|#|$)') THEN 'paged-list'
        WHEN regexp_matches(whole, '/(users?/)?login([/?#]|$)') THEN 'sign-in'
        WHEN regexp_matches(whole, '/signup([/?#]|$)') THEN 'sign-up'
        WHEN regexp_matches(whole, '/cart([/?#]|$)') THEN 'basket' END AS pattern
      FROM sites)
    SELECT page_id, host, path, rule, CASE
      WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
      WHEN rule IS NOT NULL OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
    FROM ruled
    """,
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "pattern")


@query("op6_token_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query(
    "op9_source_mixing",
    r"""
    WITH sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    sources AS (
      SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn
      FROM sized GROUP BY source),
    dealt AS (
      SELECT source, source_size, CASE turn WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM sources),
    levels AS (
      SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER need, 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER need, 0)) AS level
      FROM dealt
      WINDOW need AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    aims AS (
      SELECT source, source_size, least(2.0 * source_size, (max(level) OVER ()) * weight)::DOUBLE AS target FROM levels),
    laid AS (
      SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS laid FROM sized),
    parts AS (
      SELECT doc_id, size, source_size, target, laid, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS rounds
      FROM laid JOIN aims ON laid.source IS NOT DISTINCT FROM aims.source)
    SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
      (rounds * size + greatest(0, least(size, floor(target - rounds * source_size) - laid)))::BIGINT AS taken
    FROM parts
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    sized = mixing.tally(docs)
    return sized.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op7_toxicity")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted)


@query("op8_imatch")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.compare(table(spark, folder, "documents").select("doc_id", "text"))


@query("op4_pii")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return pii.detect(table(spark, folder, "documents").select("doc_id", "text"))


@query(
    "op1_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr
      FROM documents WHERE text <> ''),
    pairs AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY nr) AS below FROM lines),
    copies AS (
      SELECT doc_id, nr FROM (
        SELECT doc_id, nr, row_number() OVER (PARTITION BY line, below ORDER BY doc_id, nr) AS place FROM pairs WHERE below IS NOT NULL)
      WHERE place > 1),
    long_copies AS (
      SELECT doc_id, nr FROM (
        SELECT doc_id, nr, row_number() OVER (PARTITION BY line ORDER BY doc_id, nr) AS place FROM lines
        WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50)
      WHERE place > 1),
    gone AS (SELECT doc_id, nr + k AS nr FROM copies, range(2) AS ks(k) UNION SELECT doc_id, nr FROM long_copies),
    kept AS (
      SELECT l.doc_id, count(*) AS n_lines, count(g.nr) AS n_removed,
        coalesce(string_agg(l.line, chr(10) ORDER BY l.nr) FILTER (WHERE g.nr IS NULL), '') AS text
      FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.nr = g.nr GROUP BY l.doc_id)
    SELECT d.doc_id, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_removed, 0)::INTEGER AS n_removed,
      sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
    """,
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op2_decontamination")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.find(docs, table(spark, folder, "benchmark"))


@query(
    "op5_jaccard_join",
    r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM words),
    tokens AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
    links AS MATERIALIZED (
      SELECT a.doc_id AS u, b.doc_id AS v FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (max(a.n) + max(b.n) - count(*))),
    reached AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u)
    SELECT s.doc_id, len(s)::BIGINT AS n_shingles, min(v) AS component_id
    FROM sets s JOIN reached ON s.doc_id = u GROUP BY s.doc_id, s
    """,
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return jaccard_join.join(docs).select("doc_id", "n_shingles", "component_id")


@query(
    "op10_substring_dedup",
    r"""
    WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20),
    windows AS (
      SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) > 1 AS copy FROM starts),
    gone AS (SELECT DISTINCT doc_id, i + k AS i FROM windows, range(20) AS ks(k) WHERE copy),
    each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
    kept AS (
      SELECT e.doc_id, count(g.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL), '') AS text
      FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
    SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM words w LEFT JOIN kept ON w.doc_id = kept.doc_id
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query(
    "op13_source_divergence",
    r"""
    WITH d AS (
      SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
    kept AS MATERIALIZED (
      SELECT lang, term FROM (SELECT lang, unnest(list_distinct(t)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 10),
    sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
    tokens AS (SELECT lang, source, unnest(t) AS term FROM d),
    counts AS MATERIALIZED (
      SELECT lang, source, term, count(*)::HUGEINT AS c FROM tokens JOIN kept USING (lang, term) GROUP BY lang, source, term),
    groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
    shares AS MATERIALIZED (
      SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
        1 + (1000000000 * (coalesce(c, 0) + 2)) // (coalesce(sum(c) OVER (PARTITION BY g.lang, g.source), 0)::HUGEINT + 2 * v) AS p
      FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON g.lang = s.lang
      LEFT JOIN counts n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
    whole AS (
      SELECT lang, term, 1 + (1000000000 * (c + 2)) // (n + 2 * v) AS q
      FROM (SELECT lang, term, sum(c)::HUGEINT AS c, sum(sum(c)) OVER (PARTITION BY lang)::HUGEINT AS n FROM counts GROUP BY lang, term)
      JOIN sizes USING (lang)),
    sums AS (
      SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    terms AS (
      SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value
      FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    WHERE part = 'pair' OR rank <= 10
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents").select("text", "lang", "source"))


@query(
    "op11_near_vectors",
    """
    WITH RECURSIVE fit AS (
      SELECT row_number() OVER () AS nr, vec_id, embedding::DOUBLE[] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS MATERIALIZED (
      SELECT a.nr AS u, b.nr AS v, b.vec_id FROM fit a JOIN fit b ON a.nr <> b.nr AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
    reached AS (SELECT nr AS u, nr AS v FROM fit UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u),
    lows AS (SELECT u, min(vec_id) AS component_id FROM reached JOIN fit ON reached.v = nr GROUP BY u),
    degrees AS (SELECT u, count(*) AS n_links FROM links GROUP BY u),
    linked AS (
      SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id FROM fit JOIN lows ON lows.u = nr LEFT JOIN degrees d ON d.u = nr),
    single AS (
      SELECT vec_id, 0 AS n_links, vec_id AS component_id FROM embeddings
      WHERE embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0
        OR len(list_filter(embedding, lambda x: x <> 0)) = 0)
    SELECT vec_id, n_links::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
    FROM (SELECT * FROM linked UNION ALL SELECT * FROM single)
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"))


@query(
    "op12_prefix_trie",
    r"""
    WITH crc AS (
      SELECT list_transform(range(256), lambda i: list_reduce(
        list_prepend(i, range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS t),
    ordered AS MATERIALIZED (
      SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(10) || coalesce(text, ''))) AS i
      FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (
      SELECT c, c - c % 100 AS base, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
        lambda v, b: xor(v // 256, t[xor(v, b) % 256 + 1]))) % 6 AS h
      FROM (SELECT DISTINCT c FROM ordered), crc),
    heads AS (SELECT v.c, o.i, o.role, o.text FROM convs v JOIN ordered o ON o.c = v.base AND o.i <= v.h),
    rebuilt AS (
      SELECT c, list({'role': role, 'text': text} ORDER BY i) AS turns FROM (
        SELECT c, i, role, text FROM heads
        UNION ALL SELECT o.c, o.i, o.role, o.text FROM ordered o JOIN convs v ON v.c = o.c AND o.i > v.h)
      GROUP BY c),
    whole AS MATERIALIZED (SELECT v.c, coalesce(turns, []) AS turns FROM convs v LEFT JOIN rebuilt r ON r.c = v.c),
    members AS (SELECT c, d, turns[1:d] AS prefix, len(turns) = d AS ends FROM whole, unnest(range(len(turns) + 1)) AS u(d)),
    nodes AS MATERIALIZED (
      SELECT min(c) AS conv_id, d, prefix, count(*) AS n, coalesce(length(prefix[d].text), 0) AS chars,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
      FROM members GROUP BY d, prefix),
    children AS (SELECT p.d, p.prefix, count(*) AS k FROM nodes p JOIN nodes n ON n.d = p.d + 1 AND n.prefix[1:p.d] = p.prefix GROUP BY p.d, p.prefix),
    counted AS MATERIALIZED (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.prefix = n.prefix),
    above AS (SELECT prefix[1:u.d] AS prefix, u.d, n, chars, k FROM counted c, unnest(range(c.d + 1)) AS u(d)),
    sums AS (SELECT d, prefix, sum((n - 1) * chars) AS saved, count(*) FILTER (WHERE k = 0) AS leaves FROM above GROUP BY d, prefix)
    SELECT c.conv_id, c.d::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n::BIGINT AS n_convs, c.k::BIGINT AS n_children,
      s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, c.ends_sha256
    FROM counted c JOIN sums s ON s.d = c.d AND s.prefix = c.prefix LEFT JOIN nodes p ON p.d = c.d - 1 AND p.prefix = c.prefix[1:c.d - 1]
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    turns = prefix_trie.placed(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))
    return prefix_trie.expand(prefix_trie.build(*prefix_trie.spliced(turns)))

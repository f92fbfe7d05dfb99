"""Document fingerprints by I-Match: terms within a band of document frequency, sorted and hashed per lexicon subset.

Terms are hashed to slots, and a slot's document frequency is counted over all documents. The lexicon is the set of
slots whose share of the documents lies in a band, so it is a bit set of fixed size whatever the corpus holds. The
rest needs one shuffle, which brings each document to its neighbour: of the distinct terms of a text that are in the
lexicon, each of several random subsets of the lexicon gives one hash of what it keeps. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgewise.llm.common import text_or_empty

#: Slots of the term hash. Rare terms that share a slot add some 1e-4 to its document share, below the band.
SLOTS = 1 << 20
#: The band: shares of all documents, i.e. inverse document frequencies of 3.0 to 7.6.
LEAST, MOST = 0.0005, 0.05
#: Random draws, and for each the shares 2**-s of the lexicon that its nested subsets keep.
DRAWS, SCALES = 16, (1, 3, 5, 7, 9)
_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def slots(text: Column) -> Column:
    """The distinct slots of the terms: runs of letters, digits and non-ASCII characters, in lower case."""
    terms = F.filter(F.split(F.lower(text), _BREAKS), lambda t: t != "")
    return F.array_distinct(F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(SLOTS))))


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> Column:
    """The slots within the band, as a constant array of 64-bit words; at most SLOTS / 64 rows reach the driver."""
    n = docs.count()
    counts = docs.select(F.explode(slots(text_or_empty())).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    band = counts.filter((F.col("n") >= least * n) & (F.col("n") <= most * n) & (F.col("n") >= 2))
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    words = band.groupBy(F.expr("cast(slot div 64 as int)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    held = {r["word"]: r["bits"] for r in words.collect()}
    listed = ",".join(str(held.get(i, 0)) for i in range(SLOTS // 64))
    return F.split(F.lit(listed), ",").cast("array<bigint>")


def terms(df: DataFrame, text: str, band: Column) -> DataFrame:
    """Adds ``_terms``: the distinct slots of the text that are in the lexicon, or all of them if none is."""

    def known(slot: Column) -> Column:
        word = F.get(band, F.shiftright(slot, 6).cast("int"))
        return F.getbit(word, F.pmod(slot, F.lit(64)).cast("int")) == 1

    df = df.withColumn("_every", slots(F.col(text))).withColumn("_terms", F.filter("_every", known))
    return df.withColumn("_terms", F.when(F.size("_terms") > 0, F.col("_terms")).otherwise(F.col("_every"))).drop("_every")


def subset_hashes(df: DataFrame, keys: list[str]) -> DataFrame:
    """One array of hashes per distinct ``keys``: one for each draw and scale, null where the subset keeps no term.

    The exclusive or of the terms' hashes is a hash of the sorted distinct terms that needs no list of them: each row
    of ``_terms`` is summed up as it is read. Where ``df`` is dealt by one of the keys nothing is shuffled.
    """
    each = df.select(*keys, F.explode_outer("_terms").alias("_slot"))
    sums = []
    for number in range(DRAWS):
        drawn = F.xxhash64("_slot", F.lit(number))
        for scale in SCALES:
            kept = F.col("_slot").isNotNull() & (drawn.bitwiseAND(F.lit((1 << scale) - 1)) == 0)
            sums.append(F.bit_xor(F.when(kept, drawn)).alias(f"_h{len(sums)}"))
    hashed = each.groupBy(*keys).agg(*sums)
    return hashed.select(*keys, F.array(*[f"_h{i}" for i in range(len(sums))]).alias("hashes"))


def likeness(a: str, b: str) -> Column:
    """The share of draws in which both texts agree, each judged by its sparsest subset that keeps a term of either.

    Draws that keep no term of either are left out; without any left, texts are alike.
    """

    def agree(number: int) -> Column:
        verdicts = []
        for scale in reversed(range(len(SCALES))):
            x, y = (F.get(F.col(c), F.lit(number * len(SCALES) + scale)) for c in (a, b))
            verdicts.append(F.when(x.isNotNull() | y.isNotNull(), x.eqNullSafe(y).cast("int")))
        return F.coalesce(*verdicts)

    drawn = F.filter(F.array(*[agree(number) for number in range(DRAWS)]), lambda v: v.isNotNull())
    same = F.size(F.filter(drawn, lambda v: v == 1))
    return F.when(F.size(drawn) > 0, same / F.size(drawn)).otherwise(F.lit(1.0))


def shown(hashes: str) -> Column:
    """A fingerprint as a string: 8 hexadecimal digits per subset, or a dash."""
    digits = lambda h: F.coalesce(F.lower(F.substring(F.lpad(F.hex(h), 16, "0"), 1, 8)), F.lit("-"))
    return F.array_join(F.transform(hashes, digits), "")


def ranged(docs: DataFrame, rows: int = 2_500, most: int = 4_096) -> DataFrame:
    """Deals ``doc_id``, ``text`` into ranges of descending ids, each followed by the first row of the next range.

    ``_range`` numbers the ranges, about ``rows`` rows each but ``most`` ranges at most, which only sets how many
    tasks there are; null ids are a range of their own at the end. The rows that follow (one per range) have
    ``_follows`` 1; the last range is followed by the first row of all.
    """
    n = max(1, min(most, docs.count() // rows))
    cuts: list[int] = []
    if n > 1:
        shares = [i / n for i in range(1, n)]
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 10 * n).alias("cuts")).first()["cuts"] or []))
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c >= F.col("doc_id"))) if cuts else F.lit(0)
    number = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(above).cast("int")
    dealt = docs.select(number.alias("_range"), "doc_id", F.xxhash64("text").alias("_hash"), "text", F.lit(0).alias("_follows"))
    order = Window.partitionBy("_range").orderBy(F.col("doc_id").desc_nulls_last(), "_hash")
    firsts = dealt.withColumn("_row", F.row_number().over(order)).filter("_row = 1")
    by_range = Window.orderBy("_range")  # one row per range from here on
    whole = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("_range").over(by_range), F.last("_range").over(whole))
    return dealt.unionByName(firsts.select(before.alias("_range"), "doc_id", "_hash", "text", F.lit(1).alias("_follows")))


def compare(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """Fingerprints of each text and of its edited form, and how alike they and the next document's are.

    The edited text is the text with its last half (rounded down, in code points) replaced by as many code points
    from the beginning of the next one, by descending ``doc_id``, null ids last, rows of one id by the hash of their
    text; after the last comes the first, so a single document follows itself. Null texts are empty; empty texts
    have an all-dash fingerprint and are alike only to texts without terms; an empty table gives no rows; of other
    columns none is read. Equal texts have equal fingerprints.
    """
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    band = lexicon(docs, least, most)
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    order = Window.partitionBy("_range").orderBy("_follows", F.col("doc_id").desc_nulls_last(), "_hash")
    following = {"_next": F.coalesce(F.lead("text").over(order), F.lit("")), "_row": F.row_number().over(order)}
    rows = ranged(docs).withColumns(following).withColumn("n_chars", size.cast("long"))
    rows = rows.withColumn("_edited", F.concat(F.substring("text", F.lit(1), size - half), F.substring("_next", F.lit(1), half)))
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256))
    row = ["_range", "_row", "_follows", "doc_id", "n_chars", "edited_sha256"]
    forms = rows.select(*row, F.posexplode(F.array("text", "_edited")).alias("_form", "_text"))
    hashed = subset_hashes(terms(forms, "_text", band), [*row, "_form"])
    # the forms of a row, then the next row, within the range: nothing is shuffled again
    along = Window.partitionBy("_range").orderBy("_row", "_form")
    hashed = hashed.withColumn("edited_hashes", F.lead("hashes", 1).over(along)).withColumn("next_hashes", F.lead("hashes", 2).over(along))
    return hashed.filter("_form = 0 and _follows = 0").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown("hashes").alias("fingerprint"),
        shown("edited_hashes").alias("edited_fingerprint"),
        likeness("hashes", "edited_hashes").alias("near_edited"),
        likeness("hashes", "next_hashes").alias("near_next"),
    )

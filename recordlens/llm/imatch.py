"""I-Match fingerprints over randomised lexicons, in DataFrame functions only."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlens.llm.common import cut, table

#: Terms are kept whose share of documents lies in this band; there can be at most
#: (mean number of distinct terms of a document) / BAND[0] of them.
BAND = (1 / 200, 1 / 40)
#: Random lexicons: in each of FAMILIES a term is in the r-th with probability 4 ** -r, r up to QUARTERS; and all terms.
FAMILIES, QUARTERS = 16, 4
LEXICONS = FAMILIES * QUARTERS + 1
#: Two fingerprints are compared in so many of their smallest lexicons that hold a term of either text.
COMPARED = 16
#: A lexicon of more terms than this isn't held by every task but joined by shuffling.
BROADCAST_TERMS = 1_000_000
#: Ranges of doc_id that the next document is looked for in, at most.
RANGES = 16384
_GAP = r"[^\p{L}\p{N}]+"
_DIGITS = 4


def distinct_terms(text: Column) -> Column:
    """The distinct terms of a text: runs of letters and digits in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAP)), lambda t: t != "")


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """``(term)`` of the terms in the band, counted over all rows of docs(text, ...)."""
    total = docs.count()
    counts = docs.select(F.explode(distinct_terms(F.col("text"))).alias("term")).groupBy("term").count()
    return counts.where((F.col("count") >= max(2.0, band[0] * total)) & (F.col("count") <= max(2.0, band[1] * total))).select("term")


def codes(terms: Column) -> Column:
    """The sorted distinct codes of some terms: 64 hash bits, of which each draws the term into a lexicon or not."""
    return F.array_sort(F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t))))


def fingerprint(terms: Column) -> Column:
    """The fingerprint of sorted distinct term codes: _DIGITS hex digits for each random lexicon.

    Half of the families have eight bits of a term's code each, the others eight bits of the code's
    hash, and these hashes stand for the terms there. The r-th lexicon of a family holds the terms
    whose first 2 * r bits of the family are zero. The document's terms in a lexicon, sorted and
    distinct, are hashed; of a lexicon that holds none of them there are dashes. The smallest
    lexicons come first, all terms last. Without any term the fingerprint is empty.
    """

    def part(own: Column) -> Column:
        return F.when(F.size(own) == 0, "-" * _DIGITS).otherwise(F.right(F.lpad(F.lower(F.hex(F.xxhash64(own))), 16, "0"), F.lit(_DIGITS)))

    def masks(family: int) -> Column:  # of each lexicon of the family the bits that must be zero, and whose bits they are
        bits = [4**r - 1 << family % 8 * 8 for r in range(1, QUARTERS + 1)]
        return F.struct(*[F.lit(x - 2**64 if x >= 2**63 else x).cast("long").alias(f"r{r}") for r, x in enumerate(bits, 1)], F.lit(family // 8).alias("half"))

    def drawn(own: Column, family: Column, r: int) -> Column:  # the parts of lexicons r to QUARTERS, each drawn out of the one before
        if r > QUARTERS:
            return F.array().cast("array<string>")
        chosen = F.filter(own, lambda code: code.bitwiseAND(family[f"r{r}"]) == 0)
        return F.element_at(F.transform(F.array(chosen), lambda x: F.concat(F.array(part(x)), drawn(x, family, r + 1))), 1)

    def of(both: Column) -> Column:
        families = F.transform(F.array(*[masks(f) for f in range(FAMILIES)]), lambda f: drawn(F.get(both, f["half"]), f, 1))
        level = lambda m: F.transform(F.sequence(F.lit(QUARTERS - 1), F.lit(0)), lambda r: F.transform(m, lambda x: F.get(x, r)))
        small = F.element_at(F.transform(F.array(families), lambda m: F.flatten(level(m))), 1)
        return F.when(F.size(both[0]) == 0, F.lit("")).otherwise(F.array_join(F.concat(small, F.array(part(both[0]))), ""))

    pair = F.transform(F.array(terms), lambda own: F.array(own, F.array_sort(F.transform(own, lambda code: F.xxhash64(code)))))
    return F.element_at(F.transform(pair, of), 1)


def likeness(a: Column, b: Column) -> Column:
    """Of the COMPARED smallest lexicons with terms of either text, the share in which the hashes agree.

    Equal fingerprints have 1, also empty ones; an empty one and another have 0, and so has a null.
    In small lexicons the hashes agree about as often as the texts share terms; in large ones only
    if hardly any term differs.
    """
    none = "-" * _DIGITS
    split = lambda c: F.regexp_extract_all(c, F.lit(f".{{{_DIGITS}}}"), F.lit(0))
    both = F.arrays_zip(split(a).alias("a"), split(b).alias("b"))
    seen = F.slice(F.filter(both, lambda p: (p["a"] != none) | (p["b"] != none)), 1, COMPARED)
    share = F.element_at(F.transform(F.array(seen), lambda s: F.size(F.filter(s, lambda p: p["a"] == p["b"])).cast("double") / F.size(s)), 1)
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(share)


def _marks_passed(marks: list[int]) -> Column:
    """How many of the sorted marks are at most doc_id, found in two steps: a run of marks, then a mark."""
    if not marks:
        return F.lit(0)
    step = ceil(len(marks) ** 0.5)
    longs = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")
    passed = lambda values: F.size(F.filter(values, lambda m: m <= F.col("doc_id")))
    runs = passed(longs(marks[::step]))
    return F.when(runs == 0, F.lit(0)).otherwise((runs - 1) * step + passed(F.slice(longs(marks), (runs - 1) * step + 1, F.lit(step))))


def with_next(rows: DataFrame, value: str, tie: str, name: str) -> DataFrame:
    """``rows`` with ``name``: ``value`` of the next row by descending doc_id, after the last the first.

    Rows are dealt into ranges of doc_id, those without one into ranges of ``tie``, a hash; so no
    task sees all of them. The first row of each range is copied to the end of the range before,
    and a window within ranges finds the next row. Only ids and ties of first rows, one a range, are
    brought together. Nulls come last; rows of one doc_id are ordered by ``tie``.
    """
    buckets = max(1, min(RANGES, rows.count() // 1024))
    asked = [k / buckets for k in range(1, buckets)] or [0.5]
    marks = sorted(set(rows.agg(F.percentile_approx("doc_id", asked, max(20000, 4 * buckets)).alias("m")).first()["m"] or []))
    unknown = F.shiftright(tie, 58).cast("int") - 64  # 64 ranges below all others
    dealt = rows.withColumn("_range", F.when(F.col("doc_id").isNull(), unknown).otherwise(_marks_passed(marks)))
    tops = dealt.groupBy("_range").agg(F.max(F.struct("doc_id", tie)).alias("_top"))  # at most RANGES + 64 rows
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("_range").desc())
    last = F.min("_range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = tops.select("_range", "_top", F.coalesce(F.lag("_range").over(order), last).alias("_before"))
    own = F.struct("doc_id", tie).eqNullSafe(F.col("_top"))
    copies = dealt.join(F.broadcast(before), "_range").where(own).drop("_top", "_range").withColumnRenamed("_before", "_range")
    together = dealt.withColumn("_copy", F.lit(False)).unionByName(copies.withColumn("_copy", F.lit(True)))
    inside = Window.partitionBy("_range").orderBy("_copy", F.col("doc_id").desc_nulls_last(), F.col(tie).desc())
    return together.withColumn(name, F.lead(value).over(inside)).where(~F.col("_copy")).drop("_range", "_copy")


def _band_table(terms: DataFrame, buckets: int) -> DataFrame:
    """One row of one array: in place b the codes of the lexicon's terms that leave b when divided by ``buckets``."""
    code = terms.select(F.xxhash64("term").alias("code")).distinct()
    held = code.groupBy(F.pmod("code", F.lit(buckets)).alias("id")).agg(F.collect_list("code").alias("codes"))
    places = terms.sparkSession.range(buckets).join(held, "id", "left").select(F.struct("id", F.coalesce("codes", F.array().cast("array<bigint>")).alias("codes")).alias("x"))
    return places.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["codes"]).alias("band"))


def _in_band(rows: DataFrame, terms: DataFrame, sides: list[str], buckets: int) -> DataFrame:
    """``rows`` with ``_in``: for each side, an array of codes, those in the lexicon.

    The lexicon is a scalar subquery, so every task holds it once; a code is looked up in its place there.
    """
    band = rows.withColumn("_band", _band_table(terms, buckets).scalar())
    known = lambda code: F.array_contains(F.get("_band", F.pmod(code, F.lit(buckets)).cast("int")), code)
    return band.withColumn("_in", F.transform(F.array(*sides), lambda own: F.filter(own, known))).drop("_band")


def _in_band_by_join(rows: DataFrame, terms: DataFrame, sides: list[str]) -> DataFrame:
    """As ``_in_band`` for a lexicon of any size: codes are exploded, joined with it and gathered again."""
    numbered = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    sided = lambda n: lambda code: F.struct(F.lit(n).alias("n"), code.alias("code"))
    spread = F.explode(F.concat(*[F.transform(s, sided(n)) for n, s in enumerate(sides)]))
    met = numbered.select("_row", spread.alias("x")).select("_row", "x.*").join(terms.select(F.xxhash64("term").alias("code")).distinct(), "code", "left_semi")
    own = [F.sort_array(F.collect_set(F.when(F.col("n") == n, F.col("code")))).alias(f"_{n}") for n in range(len(sides))]
    found = met.groupBy("_row").agg(*own)
    empty = F.array().cast("array<bigint>")
    return numbered.join(found, "_row", "left").withColumn("_in", F.array(*[F.coalesce(f"_{n}", empty) for n in range(len(sides))])).drop("_row", *[f"_{n}" for n in range(len(sides))])


def fingerprints(texts: DataFrame, terms: DataFrame, sides: list[str]) -> DataFrame:
    """For each row of ``texts`` a fingerprint of each of the text columns ``sides``.

    The codes of a text's terms are looked up in the lexicon; those found there make its fingerprint.
    A text without terms in the band has the fingerprint of all its terms, however many. All other
    columns stay.
    """
    kept = [c for c in texts.columns if c not in sides]
    every = [f"_all_{s}" for s in sides]
    coded = texts.select(*kept, *[codes(distinct_terms(F.col(s))).alias(c) for s, c in zip(sides, every)])
    size = terms.count()
    met = _in_band(coded, terms, every, max(1, size)) if size <= BROADCAST_TERMS else _in_band_by_join(coded, terms, every)
    own = [F.when(F.size(F.get("_in", n)) > 0, F.get("_in", n)).otherwise(F.col(c)) for n, c in enumerate(every)]
    hashed = met.select(*kept, F.array(*own).alias("_sets")).select(*kept, F.transform("_sets", fingerprint).alias("_f"))
    return hashed.select(*kept, *[F.get("_f", n).alias(f"fingerprint_{side}") for n, side in enumerate(sides)])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like they are.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many
    (or all) of the next document by descending doc_id. Likeness is that of two fingerprints as they
    are returned, so a text with terms in the band and one without have none. Null texts count as empty; texts without terms have an empty fingerprint. Rows
    that repeat a doc_id follow one another by text hash; null doc_ids come last. Very long texts are
    read whole. Other columns of docs, whatever their names, are
    ignored. An empty table gives no rows.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    terms = cut(lexicon(plain))
    rows = with_next(plain.withColumn("tie", F.xxhash64("text")), "text", "tie", "next")
    size, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - third), F.substring("next", F.lit(1), third))
    texts = rows.select("doc_id", "tie", size.cast("long").alias("n_chars"), "text", edited.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    found = cut(fingerprints(texts, terms, ["text", "edited"]))
    ahead = with_next(found, "fingerprint_text", "tie", "next_fingerprint")
    own, other = F.col("fingerprint_text"), F.col("fingerprint_edited")
    return ahead.select(
        "doc_id", "n_chars", "edited_sha256", own.alias("fingerprint"), other.alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"), likeness(own, F.col("next_fingerprint")).alias("near_next"),
    )


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))

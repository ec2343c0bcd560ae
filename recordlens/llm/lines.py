"""Line deduplication by a fixed-depth tree of line templates, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.llm.common import table, written

#: A template recurs if at least this many lines of documents have it; lines of fewer tokens have none.
MIN_DOCS, MIN_TOKENS = 3, 3
#: Places of a line at most: a longer line has as many runs of equal numbers of tokens.
PLACES = 8
#: Levels of leading places below the token count, and how many lines a child must have to be one.
DEPTH, CHILD = 2, 3
#: A template with fields has at least these shares of its places, and tokens, as constants.
CONSTANT_SHARE, CONSTANT_TOKENS = (2, 3), 4
FIELD = "<*>"
#: A token with a digit, matched from its start without backtracking.
_VARIABLE = r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def masked_lines(text: Column) -> Column:
    """The lines of a text with one space between tokens and a field for each token with a digit."""
    plain = F.coalesce(text, F.lit(""))
    for gap in "\t\x0b\f\r":
        plain = F.replace(plain, F.lit(gap), F.lit(" "))
    single = lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t)
    masked = lambda t: F.when(t.rlike("[0-9]"), F.regexp_replace(t, _VARIABLE, FIELD)).otherwise(t)
    whole = F.element_at(F.transform(F.transform(F.array(plain), single), masked), 1)
    return F.transform(F.split(whole, "\n"), lambda line: F.trim(line))  # noqa: PLW0108  trim has a second parameter


def _places(line: Column) -> Column:
    """Of a masked line the token count, the hash of each place, and the places with a constant token as bits."""

    def cut_up(tokens: Column) -> Column:
        width = F.ceil(F.size(tokens) / PLACES).cast("int")
        count = F.ceil(F.size(tokens) / width).cast("int")
        return F.struct(
            F.size(tokens).alias("n"),
            F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(tokens, k * width + 1, width)).alias("steps"),
        )

    def hashed(x: Column) -> Column:
        n = x["n"]
        solid = F.transform(x["steps"], lambda s, k: F.when(F.size(F.array_remove(s, FIELD)) > 0, F.call_function("shiftleft", F.lit(1), k)).otherwise(0))
        return F.struct(
            n.alias("n"),
            F.transform(x["steps"], lambda s, k: F.xxhash64(n, k, s)).alias("steps"),
            F.aggregate(solid, F.lit(0), lambda a, b: a + b).alias("solid"),
        )

    return F.element_at(F.transform(F.transform(F.transform(F.array(line), lambda x: F.split(x, " ")), cut_up), hashed), 1)


def _line_hash(steps: Column) -> Column:
    """The exclusive or of the places' hashes, so that a field is taken out by its own hash."""
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def document_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, line, n, solid, s0 .. s7)``: each masked line of a row once, lines of MIN_TOKENS or more."""
    each = docs.select("doc_id", F.explode(F.array_distinct(masked_lines(F.col("text")))).alias("text"))
    enough = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) >= MIN_TOKENS - 1
    return (
        each.where(enough).select("doc_id", _places(F.col("text")).alias("x"))
        .select("doc_id", _line_hash(F.col("x.steps")).alias("line"), "x.n", "x.solid", *[F.get("x.steps", F.lit(k)).alias(f"s{k}") for k in range(PLACES)])
    )


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` that at least CHILD rows have, each once."""
    return rows.groupBy(key).count().where(F.col("count") >= CHILD).select(key)


def templates(lines: DataFrame) -> DataFrame:
    """``(line, template, docs, first)`` for the distinct lines of ``document_lines`` that have a template.

    The tree: below the token count a line goes down by its leading places, DEPTH at most, as long
    as CHILD lines of documents go the same way; one that can't go down at all has no template. In
    the node where a line stays, a place is constant if CHILD lines have the same there, else a
    field. Tokens with digits are fields from the start. A template is the constants with their
    places; it needs one constant token, and with fields without digits the shares of
    CONSTANT_SHARE and CONSTANT_TOKENS.
    """
    rooted = written(lines.join(_shared(lines, "s0"), "s0"))  # what follows is of the lines of inner nodes only
    ways = rooted.withColumn("way", F.xxhash64("s0", "s1"))
    deep = _shared(ways, "way").withColumn("deep", F.lit(True))
    placed = ways.join(deep, "way", "left").select("line", *[f"s{k}" for k in range(PLACES)], "solid", "way", F.when(F.col("deep"), DEPTH).otherwise(1).alias("depth"))
    node = F.when(F.col("depth") == DEPTH, F.col("way")).otherwise(F.col("s0"))
    bit = lambda k: F.call_function("shiftright", F.col("solid"), k).bitwiseAND(F.lit(1))
    place = lambda x, k: F.struct(F.xxhash64("depth", node, x).alias("key"), x.alias("x"), bit(k).alias("bit"), k.alias("k"))
    below = F.filter(F.transform(F.array(*[f"s{k}" for k in range(PLACES)]), place), lambda p: p["x"].isNotNull() & (p["k"] >= F.col("depth")))
    held = placed.select("line", F.explode(below).alias("p")).select("line", "p.key", "p.x", "p.bit")
    counted = held.groupBy("key").agg(F.count("*").alias("docs"), F.min("line").alias("lo"), F.max("line").alias("hi"), F.max("x").alias("x"), F.max("bit").alias("bit"))
    # fewer than CHILD = 3 rows are of two lines at most, the least and the greatest
    rare = counted.where(F.col("docs") < CHILD).select("x", "bit", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("line"))
    fields = rare.groupBy("line").agg(F.bit_xor("x").alias("gone"), F.count("*").alias("fields"), F.sum("bit").alias("bits"))
    known = rooted.groupBy("line").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"), F.max("n").alias("n"), F.max("solid").alias("solid"))
    width = F.ceil(F.col("n") / PLACES)
    constant = F.bit_count("solid") - F.coalesce("bits", F.lit(0))
    share = constant * CONSTANT_SHARE[1] >= F.ceil(F.col("n") / width) * CONSTANT_SHARE[0]
    enough = F.when(F.col("fields").isNull(), constant > 0).otherwise(share & (constant * width >= CONSTANT_TOKENS))
    return known.join(fields, "line", "left").where(enough).select(
        "line", F.col("line").bitwiseXOR(F.coalesce("gone", F.lit(0))).alias("template"), "docs", "first"
    )


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without lines whose template an earlier document holds and ``min_docs`` lines have in all.

    Adds ``n_lines`` and ``n_dropped``. The document of the smallest doc_id keeps its lines of
    the template, so that nothing is lost altogether; within one document a masked line counts once
    and may repeat. Rows that share a doc_id count as a document each but keep or lose the same
    templates; a null doc_id is never the first. A null text stays null and counts as one empty
    line; empty lines and lines of fewer than MIN_TOKENS tokens stay, however often they recur: so
    short a line has no template. Lines that begin with a field without digits have none either. Very long lines have PLACES long places. All columns and rows
    stay, emptied documents too; columns named as an added one are replaced. An empty table gives
    no rows.
    """
    lines = written(document_lines(docs))
    own = written(templates(lines))
    recurring = own.groupBy("template").agg(F.sum("docs").alias("n"), F.min("first").alias("from")).where(F.col("n") >= min_docs).select("template", "from")
    bad = own.join(recurring, "template").select("line", "from")
    bad = bad.repartition(F.xxhash64("line"))  # a side of its own, so that AQE may split a hot line's rows
    later = lines.select("doc_id", "line").join(bad, "line").where(~F.col("doc_id").eqNullSafe(F.col("from")))
    dropped = later.groupBy("doc_id").agg(F.collect_set("line").alias("_dropped")).withColumnRenamed("doc_id", "_doc")
    kept_names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "text")]
    hashes = F.transform(masked_lines(F.col("text")), lambda line: _line_hash(_places(line)["steps"]))
    joined = docs.join(dropped, docs["doc_id"].eqNullSafe(dropped["_doc"]), "left").withColumn(
        "_parts", F.when(F.col("_dropped").isNotNull(), F.arrays_zip(_lines(F.col("text")).alias("line"), hashes.alias("hash")))
    ).withColumn("_left", F.filter("_parts", lambda p: ~F.array_contains("_dropped", p["hash"])))
    return joined.select(
        *kept_names,
        F.when(F.col("_left").isNull(), F.col("text")).otherwise(F.array_join(F.col("_left.line"), "\n")).alias("text"),
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.when(F.col("_left").isNull(), F.lit(0)).otherwise(F.size("_parts") - F.size("_left")).cast("long").alias("n_dropped"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_recurring_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, [t FOR t IN string_split_regex(line, '[\x20\x09-\x0D]+') IF t <> ''] AS words
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
          unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)),
masked AS (
  SELECT doc_id, pos, line, len(words) AS n, CAST(ceil(len(words) / 8.0) AS INT) AS width,
    [CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END FOR w IN words] AS tokens
  FROM lines),
stepped AS (
  SELECT doc_id, pos, line, n, width, CASE WHEN n >= 3 THEN
    [array_to_string(list_slice(tokens, CAST(k * width + 1 AS INT), CAST((k + 1) * width AS INT)), ' ') FOR k IN range(CAST(ceil(n / width) AS INT))] END AS steps
  FROM masked),
held AS (
  SELECT n, width, steps, count(*) AS docs, min(doc_id) AS first
  FROM (SELECT DISTINCT doc_id, n, width, steps FROM stepped WHERE steps IS NOT NULL) GROUP BY n, width, steps),
ways AS (
  SELECT n, j, steps[1:j] AS lead, sum(docs) AS docs FROM held, (SELECT unnest([1, 2]) AS j) GROUP BY n, j, steps[1:j]),
placed AS (
  SELECT h.*, CASE WHEN b.docs >= 3 THEN 2 ELSE 1 END AS depth
  FROM held h JOIN ways a ON a.n = h.n AND a.j = 1 AND a.lead = h.steps[1:1] JOIN ways b ON b.n = h.n AND b.j = 2 AND b.lead = h.steps[1:2]
  WHERE a.docs >= 3),
spread AS (
  SELECT n, width, steps, docs, depth, steps[1:depth] AS lead, unnest(steps) AS step, unnest(range(len(steps))) AS place FROM placed),
counted AS (
  SELECT n, depth, lead, place, step, sum(docs) AS docs FROM spread GROUP BY n, depth, lead, place, step),
generalised AS (
  SELECT s.n, s.width, s.steps,
    array_agg(CASE WHEN s.place < s.depth OR c.docs >= 3 THEN s.step END ORDER BY s.place) AS template,
    count(*) AS places, count(*) FILTER (WHERE s.place >= s.depth AND c.docs < 3) AS fields,
    count(*) FILTER (WHERE (s.place < s.depth OR c.docs >= 3) AND len([w FOR w IN string_split(s.step, ' ') IF w <> '<*>']) > 0) AS constants
  FROM spread s JOIN counted c ON s.n = c.n AND s.depth = c.depth AND s.lead = c.lead AND s.place = c.place AND s.step = c.step
  GROUP BY s.n, s.width, s.steps),
templates AS (
  SELECT n, steps, template FROM generalised
  WHERE CASE WHEN fields = 0 THEN constants > 0 ELSE constants * 3 >= places * 2 AND constants * width >= 4 END),
recurring AS (
  SELECT t.n, t.template, min(h.first) AS first FROM templates t JOIN held h ON t.n = h.n AND t.steps = h.steps
  GROUP BY t.n, t.template HAVING sum(h.docs) >= 3),
marked AS (
  SELECT s.doc_id, s.pos, s.line, r.n IS NOT NULL AND s.doc_id <> r.first AS dropped
  FROM stepped s LEFT JOIN templates t ON s.n = t.n AND s.steps = t.steps LEFT JOIN recurring r ON t.n = r.n AND t.template = r.template)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

"""Line deduplication against its SQL and by hand."""

import duckdb
from recordlens.llm import lines


def test_against_sql(spark):
    path = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in lines.op3_line_dedup(spark, path).collect())
    documents = duckdb.read_parquet(f"{path}/documents.parquet")  # noqa: F841  read by the SQL
    assert got == sorted(duckdb.sql(lines.OP3_SQL).fetchall())


def texts(spark, rows, columns="doc_id long, text string"):
    out = lines.drop_recurring_lines(spark.createDataFrame(rows, columns))
    return {r["doc_id"]: r["text"] for r in out.collect()}


def test_templates(spark):
    body = ["alpha one two three", "beta four five six", "gamma seven eight nine"]
    rows = [(k, f"{b}\nPage {k} of 30 printed 2024-01-0{k}\n\nok\nok") for k, b in enumerate(body, 1)]
    assert texts(spark, rows) == {
        1: "alpha one two three\nPage 1 of 30 printed 2024-01-01\n\nok\nok", 2: "beta four five six\n\nok\nok", 3: "gamma seven eight nine\n\nok\nok",
    }


def test_counts_documents_not_lines(spark):
    rows = [(1, "same line here\nsame line here\nsame line here"), (2, "same line here")]
    assert texts(spark, rows) == dict(rows)


def test_fields_without_digits(spark):
    names = ["Alice", "Bob", "Carol", "Dora", "Egon"]
    rows = [(k, f"{name}s {name}t {name}u\nPosted by {name} in News today") for k, name in enumerate(names)]
    assert texts(spark, rows) == {k: (text if not k else text.split("\n")[0]) for k, text in rows}
    first = [(k, f"{name} posted a comment today") for k, name in enumerate(names)]
    assert texts(spark, first) == dict(first)
    second = [(k, f"Comment: {name} wrote five lines today") for k, name in enumerate(names)]
    assert texts(spark, second) == {k: (text if not k else "") for k, text in second}


def test_fields_in_long_lines(spark):
    lead, tail = (" ".join(f"{c}{chr(97 + k)}" for k in range(16)) for c in "wv")
    rows = [(k, f"{lead} {c}a {c}b {tail} zz") for k, c in enumerate("xyz")]
    assert texts(spark, rows) == {0: rows[0][1], 1: "", 2: ""}
    half = [(k, f"{lead} " + " ".join(f"{c}{chr(97 + j)}" for j in range(16))) for k, c in enumerate("xyz")]
    assert texts(spark, half) == dict(half)  # half of the line differs: no template


def test_too_few_constants(spark):
    rows = [(k, f"The {c}{c} of the\n{k} {k + 1} {k + 2}") for k, c in enumerate("xyz")]
    assert texts(spark, rows) == dict(rows)


def test_edges(spark):
    line = "all rights are reserved"
    rows = [(None, line, 7), (2, line, 8), (2, line, 9), (3, None, 1), (4, "", 2), (5, line + "\r", 3)]
    out = lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int"))
    found = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=str)
    assert found == sorted([(None, "", 1, 1), (2, line, 1, 0), (2, line, 1, 0), (3, None, 1, 0), (4, "", 1, 0), (5, "", 1, 1)], key=str)
    assert lines.drop_recurring_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long(spark):
    rows = [(k, "word " * 200_000 + "\n" + "x" * 500_000) for k in range(3)]
    same = spark.createDataFrame([(k, "\n".join(f"a b c {k} {j:x}" for j in range(20_000))) for k in range(3)], "doc_id long, text string")
    assert sorted(r["n_dropped"] for r in lines.drop_recurring_lines(same).collect())[0] == 0
    assert {k: len(t) for k, t in texts(spark, rows).items()} == {0: len(rows[0][1]), 1: 500_000, 2: 500_000}

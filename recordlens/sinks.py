"""Sinks: results as JSON and CSV, and reports as text."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.functions.scalars import real_time_factor
from recordlens.operators.score import confusion, field_scores
from recordlens.schema import FIELDS, LATENTS
from recordlens.single import write_single
from recordlens.sources.pcm import reachable


def result_json() -> Column:
    """The nine fields of a row as one JSON object, in order."""
    return F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})


def envelopes(results: DataFrame) -> DataFrame:
    """``json`` of results(name, status, error, elapsed_s, audio_s, stage_times, warnings, the fields and estimates), rounded as reported."""
    ok = F.col("status") == "ok"
    rtf = F.round(real_time_factor(F.col("elapsed_s"), F.col("audio_s")), 4)
    known = [f.name for f in LATENTS if f.name in results.columns]
    latents = [F.when(ok, F.struct(*known)).alias("latents")] if known else []
    body = F.struct(
        "name", "status", F.when(ok, F.struct(*FIELDS)).alias("result"), "error",
        F.round("elapsed_s", 3).alias("elapsed_s"), F.round("audio_s", 2).alias("audio_s"), rtf.alias("rtf"), *latents,
        F.transform_values("stage_times", lambda _, s: F.round(s, 4)).alias("stage_times"), "warnings",
    )
    return results.select("name", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def score_report(judged: DataFrame) -> str:
    """Fields with their scores and errors, and the mean accuracy, as one JSON object; a row for each field and confusion comes here."""
    wrong = confusion(judged).groupBy("field").agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("_n"), "truth", "pred", "count"))).alias("errors"))
    share = lambda c: F.round(c, 4).alias(c)
    scores = field_scores(judged).join(wrong, "field", "left").orderBy("field")
    fields: dict[str, object] = {}
    for r in scores.select("field", "n", share("accuracy"), share("adjacent_accuracy"), share("macro_f1"), "errors").collect():
        errors = [{"truth": e["truth"], "pred": e["pred"], "count": e["count"]} for e in r["errors"] or []]
        fields[r["field"]] = {"n": r["n"], "accuracy": r["accuracy"], "adjacent_accuracy": r["adjacent_accuracy"], "macro_f1": r["macro_f1"], "errors": errors}
    graded = [f["accuracy"] for f in fields.values() if f["n"]]
    return json.dumps({"fields": fields, "mean_field_accuracy": round(sum(graded) / len(graded), 4) if graded else 0.0}, ensure_ascii=False)


def _write(ordered: DataFrame, path: str, single: bool | None, **around: str) -> None:
    """One file where Python reaches the store, else a folder of lines."""
    if reachable(path.rpartition("/")[0] or ".") if single is None else single:
        write_single(ordered, path, uuid.uuid4().hex, **around)
    else:
        ordered.select("value").write.mode("overwrite").text(path)


def write_json(results: DataFrame, path: str, job: str | None = None, report: str | None = None, single: bool | None = None) -> None:
    """An array of envelopes by name, in one file; with ``job`` an object of the job, its results and the score report.

    A store that Python doesn't reach, or ``single=False``, gets a folder of lines, one envelope each.
    """
    ordered = envelopes(results).orderBy("name").select(F.col("json").alias("value"))
    head, tail = "[\n", "\n]\n"
    if job is not None:
        head = '{"job": ' + json.dumps(job, ensure_ascii=False) + ', "results": [\n'
        tail = "\n]" + (f', "score_report": {report}' if report else "") + "}\n"
    _write(ordered, path, single, head=head, tail=tail, between=",\n")


def _csv_cell(value: Column) -> Column:
    """A cell as CSV has it: quoted if it holds a quote, a comma or a line end."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_csv(results: DataFrame, path: str, wide: bool = False, single: bool | None = None) -> None:
    """name, status, result_json, error in the order of names, in one file with a byte-order mark; ``wide`` has the nine fields as columns too."""
    ok = F.when(F.col("status") == "ok", result_json())
    columns = {"name": F.col("name"), "status": F.col("status"), **({f: F.when(F.col("status") == "ok", F.col(f)) for f in FIELDS} if wide else {})}
    columns |= {"error": F.col("error"), "result_json": ok} if wide else {"result_json": ok, "error": F.col("error")}
    ordered = results.orderBy("name").select(F.concat_ws(",", *map(_csv_cell, columns.values())).alias("value"))
    _write(ordered, path, single, head="\ufeff" + ",".join(columns) + "\r\n", tail="\r\n", between="\r\n")


def write_supplied(results: DataFrame, path: str) -> None:
    """name, result_json: the form in which labels come."""
    results.where("status = 'ok'").select("name", result_json().alias("result_json")).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def report_lines(scores: DataFrame) -> DataFrame:
    """(field, line): one line of text for each field's scores."""
    share = lambda c: F.format_string("%6.1f %%", F.col(c) * 100)
    line = F.concat_ws("  ", F.rpad("field", 28, " "), F.format_string("n=%-6d", F.col("n").cast("int")), share("accuracy"), share("adjacent_accuracy"), F.format_string("%.3f", F.col("macro_f1")))
    return scores.select("field", line.alias("line"))


def stage_lines(totals: DataFrame) -> DataFrame:
    """(total_s, line): one line of text for each stage of stage totals(stage, total_s, rtf), to be shown the longest first."""
    return totals.select("total_s", F.format_string("%-14s%9.2f%9.4f", "stage", "total_s", "rtf").alias("line"))

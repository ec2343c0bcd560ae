"""One ordered file against a plain writer; an error leaves what was there."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F
from recordlens import sinks
from recordlens.schema import DEFAULTS
from recordlens.single import write_single


def test_one_file_in_order(spark, tmp_path):
    rows = [(k, f"row {k} é中\n" if k % 7 else "") for k in range(2000)]
    frame = spark.createDataFrame(rows, "k int, value string").repartition(9).orderBy("k")
    place = str(tmp_path / "out.txt")
    for run, head in (("a", "[\n"), ("b", "")):
        write_single(frame, place, run, head=head, tail="]", between=",")
        assert open(place, encoding="utf-8", newline="").read() == head + ",".join(v for _, v in rows) + "]"
    write_single(frame.limit(0), place, "c", "[", "]")
    assert open(place).read() == "[]"
    failing = frame.withColumn("value", F.when(F.col("k") < 1500, F.col("value")).otherwise(F.raise_error(F.lit("stop")).cast("string")))
    with pytest.raises(Exception, match="stop"):
        write_single(failing, place, "d")
    assert open(place).read() == "[]" and [p.name for p in tmp_path.iterdir()] == ["out.txt"]


def test_results_as_json_and_csv(spark, tmp_path):
    values = {k: (v if v != "" else 'a, "b"\nc') for k, v in DEFAULTS.items()}
    names = ["z.wav", 'q"uote.wav', "a,b.wav", "ünï.wav"]
    rows = [(n, "ok" if k else "failed", None if k else "broken, really", 1.23456, 9.876, {"vad": 0.123456}, ["w"], *values.values()) for k, n in enumerate(names)]
    kinds = {bool: "boolean", float: "double", str: "string"}
    schema = "name string, status string, error string, elapsed_s double, audio_s double, stage_times map<string,double>, warnings array<string>, " + ", ".join(f"{k} {kinds[type(v)]}" for k, v in DEFAULTS.items())
    results = spark.createDataFrame(rows, schema).withColumn("arousal", F.lit(0.5)).repartition(3)
    sinks.write_json(results, f"{tmp_path}/r.json")
    read = json.load(open(tmp_path / "r.json", encoding="utf-8"))
    assert [r["name"] for r in read] == sorted(names) and read[1]["result"] == values and read[1]["elapsed_s"] == 1.235 and read[1]["rtf"] == 0.125 and read[1]["latents"] == {"arousal": 0.5}
    failed = next(r for r in read if r["status"] == "failed")
    assert failed["result"] is None and failed["error"] == "broken, really"
    sinks.write_json(results, f"{tmp_path}/j.json", "job 1", json.dumps({"fields": {}}))
    whole = json.load(open(tmp_path / "j.json", encoding="utf-8"))
    assert whole["job"] == "job 1" and whole["results"] == read and whole["score_report"] == {"fields": {}}
    for wide in (False, True):
        sinks.write_csv(results, f"{tmp_path}/r.csv", wide)
        raw = (tmp_path / "r.csv").read_bytes()
        table = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline="")))
        assert raw.startswith(b"\xef\xbb\xbfname,status,") and [r[0] for r in table[1:]] == sorted(names) and len({len(r) for r in table}) == 1
        at = table[0].index("result_json")
        assert json.loads(table[2][at]) == values and (len(table[0]) == 13) == wide
        out = io.StringIO(newline="")
        csv.writer(out).writerows(table)
        assert raw == out.getvalue().encode("utf-8-sig")  # byte for byte what a plain writer makes of it
    sinks.write_json(results, f"{tmp_path}/lines", single=False)
    assert [json.loads(r["value"])["name"] for r in spark.read.text(f"{tmp_path}/lines").collect()] == sorted(names)

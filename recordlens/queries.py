"""Queries of the recording analysis over the test tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlens.functions import scalars, vocab
from recordlens.operators import classdist, clusters, emotion, intervals, quality, roles, samples, score, tune, windows
from recordlens.operators.derive import derive, fill_stubs, repaired, unevidenced_count
from recordlens.plans.carriers import (
    CLASS_SCORES_SQL,
    FRAMES_SQL,
    HOP,
    LATENTS_SQL,
    class_scores,
    files,
    frames,
    latents,
    packed,
    table,
    utterances,
)
from recordlens.plans.roles import assigned
from recordlens.plans.tone import tone
from recordlens.sources import manifest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def clamp_sql(x: str) -> str:
    return f"greatest(0.0e0, least(1.0e0, {x}))"


# -- derivation ---------------------------------------------------------------------------------

_TONE = """CASE WHEN arousal IS NULL OR valence IS NULL THEN 'neutral'
    WHEN arousal>=0.8e0 AND valence<=-0.6e0 THEN 'distressed'
    WHEN abs(valence)<0.2e0 AND arousal<0.55e0 THEN 'neutral' WHEN valence>0 THEN 'satisfied'
    WHEN valence<=-0.45e0 OR arousal>=0.55e0 THEN 'upset' ELSE 'frustrated' END"""
_INTENSITY = """CASE WHEN arousal IS NULL OR valence IS NULL THEN 'low' WHEN arousal<0.2e0 THEN 'low'
    WHEN arousal<0.55e0 THEN 'medium' ELSE 'high' END"""


@query(f"""
WITH latents AS ({LATENTS_SQL}),
d AS (SELECT *, {_TONE} AS tone, {_INTENSITY} AS intensity, coalesce(noise_level_db>=-53.0e0, false) AS present FROM latents)
SELECT k, ln, tone AS emotional_tone,
  CASE WHEN (tone='neutral' AND intensity='high') OR (tone='distressed' AND intensity='low') THEN 'medium' ELSE intensity END AS emotional_intensity,
  present AS background_noise_present,
  CASE WHEN NOT present THEN '' WHEN untagged THEN 'static' WHEN alarm>=music THEN 'alarm' ELSE 'music' END AS background_noise_type,
  CASE WHEN NOT present THEN 'none' WHEN noise_level_db<-50.0e0 THEN 'low' WHEN noise_level_db<-24.0e0 THEN 'medium' ELSE 'high' END AS background_noise_severity,
  CASE WHEN degradation_score IS NULL OR degradation_score<0.25e0 THEN 'clear' WHEN degradation_score<0.55e0 THEN 'slightly_impaired' ELSE 'severely_impaired' END AS audio_quality,
  coalesce(overlap_ratio>=0.02e0, false) AS speaker_overlap_present,
  coalesce(max_silence_s>=12.0e0, false) AS long_silence_present
FROM d""")
def derive_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["emotional_tone", "emotional_intensity", "background_noise_present", "background_noise_type", "background_noise_severity", "audio_quality", "speaker_overlap_present", "long_silence_present"]
    return derive(latents(spark, sf_dir)).select("k", "ln", *names)


def _margin_sql(x: str, scale: str, *edges: str) -> str:
    gaps = [f"abs({x}-({e}))" for e in edges]
    gap = f"least({', '.join(gaps)})" if len(gaps) > 1 else gaps[0]
    return clamp_sql(f"({gap})/{scale}")


@query(f"""
WITH latents AS ({LATENTS_SQL}),
m AS (SELECT *, noise_level_db>=-53.0e0 AND NOT untagged AND greatest(music, alarm)<0.15e0 AS weak, arousal IS NOT NULL AND valence IS NOT NULL AS moved FROM latents),
s AS (SELECT *, [CASE WHEN weak THEN 0.0e0 END,
    CASE WHEN noise_level_db IS NOT NULL THEN {_margin_sql('noise_level_db', '6.0e0', '-53.0e0')} END,
    CASE WHEN degradation_score IS NOT NULL THEN {_margin_sql('degradation_score', '0.15e0', '0.25e0', '0.55e0')} END,
    CASE WHEN max_silence_s IS NOT NULL THEN {_margin_sql('max_silence_s', '4.0e0', '12.0e0')} END,
    CASE WHEN overlap_ratio IS NOT NULL THEN {_margin_sql('overlap_ratio', '0.03e0', '0.02e0')} END,
    CASE WHEN moved THEN {_margin_sql('valence', '0.3e0', '0.0e0', '-0.45e0')} END,
    CASE WHEN moved THEN {_margin_sql('arousal', '0.2e0', '0.2e0', '0.55e0')} END] AS margins,
  (CASE WHEN max_silence_s IS NULL THEN 1 ELSE 0 END + CASE WHEN overlap_ratio IS NULL THEN 1 ELSE 0 END + CASE WHEN noise_level_db IS NULL THEN 1 ELSE 0 END
   + CASE WHEN degradation_score IS NULL THEN 1 ELSE 0 END + CASE WHEN arousal IS NULL THEN 1 ELSE 0 END + CASE WHEN valence IS NULL THEN 1 ELSE 0 END) AS absent FROM m)
SELECT k, ln, CAST(absent AS INT) AS n_unevidenced, greatest(0.1e0, least(1.0e0, (0.85e0-0.09e0*absent)
  * CASE WHEN list_count(margins)>0 THEN 0.65e0+0.35e0*(list_sum(margins)/list_count(margins)) ELSE 1.0e0 END
  * CASE WHEN role_confidence IS NOT NULL THEN 1.0e0-0.2e0*(1.0e0-role_confidence) ELSE 1.0e0 END)) AS confidence
FROM s""")
def derive_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = latents(spark, sf_dir)
    return derive(df.withColumn("n_unevidenced", unevidenced_count(df))).select("k", "ln", "n_unevidenced", F.col("confidence_exact").alias("confidence"))


@query(f"""
WITH latents AS ({LATENTS_SQL})
SELECT k, ln, coalesce(max_silence_s, 0.0e0) AS max_silence_s, coalesce(overlap_ratio, 0.0e0) AS overlap_ratio,
  coalesce(noise_level_db, -60.0e0) AS noise_level_db, coalesce(degradation_score, 0.0e0) AS degradation_score,
  coalesce(arousal, 0.0e0) AS arousal, coalesce(valence, 0.0e0) AS valence,
  concat_ws(',', CASE WHEN max_silence_s IS NULL THEN 'max_silence_s' END, CASE WHEN overlap_ratio IS NULL THEN 'overlap_ratio' END,
    CASE WHEN noise_level_db IS NULL THEN 'noise_level_db' END, CASE WHEN degradation_score IS NULL THEN 'degradation_score' END,
    CASE WHEN arousal IS NULL THEN 'arousal' END, CASE WHEN valence IS NULL THEN 'valence' END) AS stubbed
FROM latents""")
def stub_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["max_silence_s", "overlap_ratio", "noise_level_db", "degradation_score", "arousal", "valence"]
    return fill_stubs(latents(spark, sf_dir)).select("k", "ln", *names, F.array_join("stubbed", ",").alias("stubbed"))


_RAW_FIELDS = """SELECT l_orderkey AS k, l_linenumber AS ln,
  CASE l_linenumber%5 WHEN 0 THEN 'neutral' WHEN 1 THEN 'distressed' WHEN 2 THEN 'upset' WHEN 3 THEN 'satisfied' END AS tone,
  CASE l_partkey%3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS intensity,
  CASE WHEN l_suppkey%5=0 THEN NULL ELSE l_tax>0.04e0 END AS present,
  CASE l_returnflag WHEN 'A' THEN '  Television ' WHEN 'N' THEN '' ELSE 'Music' END AS kind,
  CASE l_orderkey%4 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'high' END AS severity FROM lineitem"""


@query(f"""
WITH r AS ({_RAW_FIELDS}),
d AS (SELECT k, ln, coalesce(tone, 'neutral') AS tone, intensity, coalesce(present, false) AS present, lower(trim(kind)) AS kind, coalesce(severity, 'none') AS severity FROM r)
SELECT k, ln, tone AS emotional_tone,
  CASE WHEN (tone='neutral' AND intensity='high') OR (tone='distressed' AND intensity='low') THEN 'medium' ELSE intensity END AS emotional_intensity,
  present AS background_noise_present,
  CASE WHEN NOT present THEN '' WHEN kind='' THEN 'unspecified' ELSE kind END AS background_noise_type,
  CASE WHEN NOT present THEN 'none' WHEN severity='none' THEN 'low' ELSE severity END AS background_noise_severity
FROM d""")
def consistency_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    pick = lambda c, *values: F.try_element_at(F.array(*map(F.lit, values)), (c + 1).cast("int"))
    fields = repaired(
        pick(F.col("l_linenumber") % 5, "neutral", "distressed", "upset", "satisfied"),
        pick(F.col("l_partkey") % 3, "low", "medium", "high"),
        F.when(F.col("l_suppkey") % 5 != 0, F.col("l_tax") > 0.04),
        F.when(F.col("l_returnflag") == "A", "  Television ").when(F.col("l_returnflag") == "N", "").otherwise("Music"),
        pick(F.col("l_orderkey") % 4, "none", "low", "high"),
    )
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), *[c.alias(n) for n, c in fields.items()])


# -- scoring ------------------------------------------------------------------------------------

_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_PAIRS_SQL = """
  SELECT o_orderkey AS name, 'priority' AS field, o_orderpriority AS truth,
    CAST(substr(o_orderpriority, 1, 1) AS INT) AS tr, greatest(1, least(5, CAST(substr(o_orderpriority, 1, 1) AS INT) + CAST(o_custkey%4 AS INT) - 1)) AS pr, NULL AS pred
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus='O')
  UNION ALL SELECT o_orderkey, 'status', o_orderstatus, NULL, NULL, CASE WHEN o_custkey%5=0 THEN 'F' WHEN o_custkey%11=0 THEN NULL ELSE o_orderstatus END
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus='O')"""
_JUDGED_SQL = f"""
  SELECT name, field, truth, CASE WHEN field='priority' THEN ['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'][pr] ELSE pred END AS pred,
    CASE WHEN field='priority' THEN tr=pr ELSE coalesce(truth=pred, false) END AS hit,
    CASE WHEN field='priority' THEN abs(tr-pr)<=1 ELSE coalesce(truth=pred, false) END AS adjacent
  FROM ({_PAIRS_SQL}) p"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    level = F.least(F.lit(5), F.greatest(F.lit(1), F.substring("o_orderpriority", 1, 1).cast("int") + (F.col("o_custkey") % 4).cast("int") - 1))
    guess = F.when(F.col("o_custkey") % 5 == 0, "F").when(F.col("o_custkey") % 11 == 0, None).otherwise(F.col("o_orderstatus"))
    truth = score.unpivot(orders, "o_orderkey", {"priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus")})
    open_lines = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    scored = orders.join(open_lines, "o_orderkey", "left_semi")  # orders without an open line have a truth and no prediction
    pred = score.unpivot(scored, "o_orderkey", {"priority": F.element_at(F.array(*map(F.lit, _PRIORITIES)), level), "status": guess})
    return score.judged(score.pairs(pred, truth), {"priority": _PRIORITIES}, ())


def _f1_sql(source: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""
  SELECT {k}avg(f) AS macro_f1 FROM (
    SELECT {k}class, CASE WHEN 2*tp+fp+fn>0 AND tp>0 THEN 2.0e0*(tp/(tp+fp))*(tp/(tp+fn))/((tp/(tp+fp))+(tp/(tp+fn))) ELSE 0.0e0 END AS f FROM (
      SELECT {k}class, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(fp) AS DOUBLE) AS fp, CAST(sum(fn) AS DOUBLE) AS fn FROM (
        SELECT {k}truth AS class, CASE WHEN truth IS NOT DISTINCT FROM pred THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN truth IS DISTINCT FROM pred THEN 1 ELSE 0 END AS fn FROM {source}
        UNION ALL SELECT {k}pred, 0, CASE WHEN truth IS DISTINCT FROM pred THEN 1 ELSE 0 END, 0 FROM {source}) c
      GROUP BY {k}class) g) h {f'GROUP BY {keys}' if keys else ''}"""


@query(f"""
WITH j AS ({_JUDGED_SQL}), f AS ({_f1_sql('j', 'field')})
SELECT j.field, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0e0 ELSE 0.0e0 END), 6) AS accuracy,
  round(avg(CASE WHEN adjacent THEN 1.0e0 ELSE 0.0e0 END), 6) AS adjacent_accuracy, round(max(macro_f1), 6) AS macro_f1
FROM j JOIN f ON j.field=f.field GROUP BY j.field""")
def score_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score.field_scores(_judged(spark, sf_dir))
    return scores.select("field", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "adjacent_accuracy", "macro_f1")])


@query(f"""
WITH j AS ({_JUDGED_SQL})
SELECT field, coalesce(truth, '') AS truth, coalesce(pred, '') AS pred, count(*) AS n_wrong, min(name) AS first_name FROM j WHERE NOT hit GROUP BY field, truth, pred""")
def score_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = score.confusion(_judged(spark, sf_dir))
    return wrong.select("field", F.coalesce("truth", F.lit("")).alias("truth"), F.coalesce("pred", F.lit("")).alias("pred"), F.col("count").alias("n_wrong"), "first_name")


_QUALITY_PAIRS = """SELECT CASE WHEN quality=1 THEN 'clear' ELSE 'severely_impaired' END AS truth,
    CASE WHEN n_chars>=2000 THEN 'clear' WHEN n_chars>=500 THEN 'slightly_impaired' ELSE 'severely_impaired' END AS pred, lang
  FROM documents JOIN labels USING (doc_id)"""


@query(f"WITH j AS ({_QUALITY_PAIRS}), f AS ({_f1_sql('j', 'lang')}) SELECT lang, round(macro_f1, 6) AS macro_f1 FROM f")
def score_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    size = F.when(F.col("n_chars") >= 2000, "clear").when(F.col("n_chars") >= 500, "slightly_impaired").otherwise("severely_impaired")
    truth = F.when(F.col("quality") == 1, "clear").otherwise("severely_impaired")
    found = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("lang", truth.alias("truth"), size.alias("pred"))
    return score.macro_f1(found, "lang").select("lang", F.round("macro_f1", 6).alias("macro_f1"))


@query(f"""WITH j AS ({_JUDGED_SQL})
SELECT round(avg(round(a, 4)), 6) AS mean_field_accuracy FROM (SELECT field, avg(CASE WHEN hit THEN 1.0e0 ELSE 0.0e0 END) AS a FROM j GROUP BY field) s""")
def score_mean_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score.mean_field_accuracy(score.field_scores(_judged(spark, sf_dir)))
    return found.select(F.round("mean_field_accuracy", 6).alias("mean_field_accuracy"))


@query("""
WITH p AS (SELECT DISTINCT doc_id AS name FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)), t AS (SELECT DISTINCT doc_id AS name FROM labels)
SELECT coalesce(p.name, t.name) AS name, CASE WHEN p.name IS NULL THEN 'missing_prediction' WHEN t.name IS NULL THEN 'unlabelled' ELSE 'matched' END AS status
FROM p FULL JOIN t ON p.name=t.name""")
def manifest_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda t: table(spark, sf_dir, t).select(F.col("doc_id").alias("name"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("name"))
    return score.name_status(named("documents").join(items, "name", "left_anti"), named("labels"))  # so there are names on either side only


# -- intervals ----------------------------------------------------------------------------------

_REGIONS_SQL = f"""
frames AS ({FRAMES_SQL}),
st AS (SELECT *, coalesce(last_value(CASE WHEN prob>=0.5e0 THEN 1 WHEN prob<0.35e0 THEN 0 END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS on_,
    max(i) OVER (PARTITION BY file_id) + 1 AS n FROM frames),
tu AS (SELECT *, coalesce(lag(on_) OVER (PARTITION BY file_id ORDER BY i), 0) AS was FROM st),
ed AS (SELECT file_id, i, on_, n FROM tu WHERE on_<>was),
raw AS (SELECT * FROM (SELECT file_id, on_, i*0.5e0 AS s, coalesce((lead(i) OVER (PARTITION BY file_id ORDER BY i) + 1)*0.5e0, n*0.5e0) AS e, n*0.5e0 AS dur FROM ed) x WHERE on_=1),
pad AS (SELECT file_id, greatest(0.0e0, s-0.06e0) AS s, least(dur, e+0.06e0) AS e, dur FROM raw),
isl AS (SELECT *, CASE WHEN coalesce(s-lag(e) OVER (PARTITION BY file_id ORDER BY s)>=0.2e0, true) THEN 1 ELSE 0 END AS fresh FROM pad),
num AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM isl),
regions AS (SELECT * FROM (SELECT file_id, min(s) AS start_s, max(e) AS end_s, max(dur) AS duration_s FROM num GROUP BY file_id, island) y WHERE end_s-start_s>=0.12e0),
fl AS (SELECT file_id, (max(i)+1)*0.5e0 AS duration_s FROM frames GROUP BY file_id),
gaps AS (SELECT * FROM (
    SELECT file_id, coalesce(lag(end_s) OVER (PARTITION BY file_id ORDER BY start_s), 0.0e0) AS start_s, start_s AS end_s FROM regions
    UNION ALL SELECT fl.file_id, coalesce(m.last_s, 0.0e0), fl.duration_s FROM fl LEFT JOIN (SELECT file_id, max(end_s) AS last_s FROM regions GROUP BY file_id) m ON fl.file_id=m.file_id) z
  WHERE end_s-start_s>1e-6)"""


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.speech_regions(frames(spark, sf_dir), HOP)


@query(f"WITH {_REGIONS_SQL} SELECT file_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM regions")
def vad_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir).select("file_id", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query(f"WITH {_REGIONS_SQL} SELECT file_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM gaps")
def vad_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.gaps(_regions(spark, sf_dir), files(frames(spark, sf_dir)))
    return found.select("file_id", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query(f"""WITH {_REGIONS_SQL}
SELECT fl.file_id, fl.duration_s, coalesce(r.n, 0) AS n_regions, round(coalesce(r.sp, 0.0e0), 6) AS speech_s, round(coalesce(r.sp/fl.duration_s, 0.0e0), 6) AS speech_ratio,
  round(coalesce(g.ms, 0.0e0), 6) AS max_silence_s
FROM fl LEFT JOIN (SELECT file_id, count(*) AS n, sum(end_s-start_s) AS sp FROM regions GROUP BY 1) r ON fl.file_id=r.file_id
LEFT JOIN (SELECT file_id, max(end_s-start_s) AS ms FROM gaps GROUP BY 1) g ON fl.file_id=g.file_id""")
def vad_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.speech_summary(_regions(spark, sf_dir), files(frames(spark, sf_dir)))
    return found.select("file_id", "duration_s", "n_regions", *[F.round(c, 6).alias(c) for c in ("speech_s", "speech_ratio", "max_silence_s")])


_RUNS_SQL = f"""
runs AS (SELECT file_id, min(i) AS first_i, max(i) AS last_i, count(*) AS n FROM (
  SELECT file_id, i, i-row_number() OVER (PARTITION BY file_id ORDER BY i) AS island FROM ({FRAMES_SQL}) f WHERE prob>=0.5e0) x GROUP BY file_id, island)"""


@query(f"WITH {_RUNS_SQL} SELECT * FROM runs")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.true_runs(frames(spark, sf_dir), F.col("prob") >= 0.5)


@query(f"""WITH {_REGIONS_SQL}, {_RUNS_SQL}
SELECT r.file_id, r.first_i, r.n FROM runs r WHERE EXISTS (SELECT 1 FROM regions g WHERE g.file_id=r.file_id AND (r.first_i+r.last_i)*0.25e0 BETWEEN g.start_s AND g.end_s)""")
def interval_stab(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = intervals.true_runs(frames(spark, sf_dir), F.col("prob") >= 0.5).withColumn("mid_s", (F.col("first_i") + F.col("last_i")) * 0.25)
    return intervals.stab(runs, "mid_s", _regions(spark, sf_dir)).select("file_id", "first_i", "n")


@query("""
WITH u AS (SELECT conv_id AS file_id, turn, turn+0.5e0 AS mid, text FROM conversations),
g AS (SELECT conv_id AS file_id, CAST(turn AS DOUBLE) AS s, turn+1.0e0 AS e FROM conversations WHERE role='user' AND conv_id%4<>0)
SELECT u.file_id, string_agg(text, ' ' ORDER BY turn) AS text FROM u
WHERE EXISTS (SELECT 1 FROM g WHERE g.file_id=u.file_id AND u.mid BETWEEN g.s AND g.e) OR NOT EXISTS (SELECT 1 FROM g WHERE g.file_id=u.file_id)
GROUP BY u.file_id""")
def range_semi_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = utterances(spark, sf_dir)
    own = said.where((F.col("role") == "user") & (F.col("file_id") % 4 != 0)).select("file_id", "start_s", "end_s")
    return intervals.text_in_regions(said.select("file_id", "start_s", "end_s", "text"), own)


@query("""
SELECT s.conv_id AS file_id, s.turn AS seg, u.text FROM conversations s
JOIN (SELECT conv_id, turn, text FROM conversations) u ON s.conv_id=u.conv_id AND s.turn=u.turn WHERE s.role='assistant'""")
def rounded_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = utterances(spark, sf_dir)
    moved = said.where("role = 'assistant'").select("file_id", (F.col("start_s") + 0.0002).alias("start_s"), (F.col("end_s") - 0.0002).alias("end_s"), F.col("seq").alias("seg"))
    return intervals.matched_spans(moved, said).select("file_id", "seg", "text")


@query("""
SELECT conv_id AS file_id, turn AS seg FROM conversations WHERE (turn + least(1.0e0, length(text)/200.0e0)) - turn >= 0.6e0""")
def long_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = utterances(spark, sf_dir).withColumn("end_s", F.col("start_s") + F.least(F.lit(1.0), F.length("text") / 200.0))
    return intervals.long_enough(spoken).select("file_id", F.col("seq").alias("seg"))


@query(f"""
WITH f AS ({FRAMES_SQL}), sp AS (SELECT file_id, i*0.5e0 AS s, i*0.5e0+least(value, 4.0e0) AS e FROM f WHERE value>0),
ev AS (SELECT file_id, p, sum(d) AS d FROM (SELECT file_id, s AS p, 1 AS d FROM sp UNION ALL SELECT file_id, e, -1 FROM sp) x GROUP BY 1, 2),
dp AS (SELECT file_id, sum(d) OVER (PARTITION BY file_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS depth, lead(p) OVER (PARTITION BY file_id ORDER BY p)-p AS len FROM ev)
SELECT file_id, round(coalesce(sum(CASE WHEN depth>=1 THEN len END), 0.0e0), 6) AS support_s, round(coalesce(sum(CASE WHEN depth>=2 THEN len END), 0.0e0), 6) AS overlap_s,
  round(coalesce(coalesce(sum(CASE WHEN depth>=2 THEN len END), 0.0e0)/sum(CASE WHEN depth>=1 THEN len END), 0.0e0), 6) AS overlap_ratio FROM dp GROUP BY file_id""")
def overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = frames(spark, sf_dir).where("value > 0").select("file_id", (F.col("i") * 0.5).alias("start_s"), (F.col("i") * 0.5 + F.least("value", F.lit(4.0))).alias("end_s"))
    found = intervals.overlap_ratio(spans)
    return found.select("file_id", *[F.round(c, 6).alias(c) for c in ("support_s", "overlap_s", "overlap_ratio")])


# -- windows and statistics ---------------------------------------------------------------------

WIDTH = 5


@query(f"""
SELECT file_id, i, low FROM (SELECT file_id, i, min(value) OVER w AS low, count(*) OVER w AS n FROM ({FRAMES_SQL}) f
  WINDOW w AS (PARTITION BY file_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING)) x WHERE n={WIDTH}""")
def sliding_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding_minimum(frames(spark, sf_dir), "value", WIDTH)


@query(f"""
WITH f AS ({FRAMES_SQL}), m AS (SELECT file_id, i, low FROM (SELECT file_id, i, min(value) OVER w AS low, count(*) OVER w AS n FROM f
  WINDOW w AS (PARTITION BY file_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING)) x WHERE n={WIDTH}),
a AS (SELECT file_id, quantile_cont(low*1.5e0, 0.9) AS floor FROM m GROUP BY 1), b AS (SELECT file_id, quantile_cont(value, 0.5) AS mid FROM f GROUP BY 1)
SELECT a.file_id, round(greatest(-90.0e0, least(0.0e0, 10.0e0*log10(floor+1e-30)-10.0e0*log10(mid+1e-30))), 6) AS noise_level_db FROM a JOIN b ON a.file_id=b.file_id""")
def noise_floor_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    floor = windows.percentiles(windows.sliding_minimum(rows, "value", WIDTH).withColumn("low", F.col("low") * 1.5), "low", floor=0.9)
    db = lambda c: 10.0 * F.log10(F.col(c) + 1e-30)
    joined = floor.join(windows.percentiles(rows, "value", mid=0.5), "file_id")
    return joined.select("file_id", F.round(scalars.clamp(db("floor") - db("mid"), -90.0, 0.0), 6).alias("noise_level_db"))


@query(f"""WITH f AS ({FRAMES_SQL}), t AS (SELECT *, 'high' AS kind FROM f WHERE abs(value)>=60 UNION ALL SELECT *, 'low' FROM f WHERE abs(value)<30),
r AS (SELECT file_id, kind, i, value, i-row_number() OVER (PARTITION BY file_id, kind ORDER BY i) AS g FROM t)
SELECT file_id, kind, min(i) AS first_i, max(i) AS last_i, count(*) AS n, min(value) AS low, max(value) AS high FROM r GROUP BY file_id, kind, g HAVING count(*)>=2""")
def sample_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = samples.sample_runs(packed(spark, sf_dir), {"high": (F.lit(60.0), True, 2), "low": (F.lit(30.0), False, 2)})
    return found.withColumn("file_id", F.col("file_id").cast("long"))


@query(f"""WITH f AS ({FRAMES_SQL}), m AS (SELECT file_id, low FROM (SELECT file_id, min(value) OVER w AS low, count(*) OVER w AS n FROM f
  WINDOW w AS (PARTITION BY file_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING)) x WHERE n={WIDTH})
SELECT file_id, count(*) AS windows, round(quantile_cont(low, 0.5), 6) AS mid, round(quantile_cont(low, 0.9), 6) AS high FROM m GROUP BY 1""")
def minimum_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = samples.minimum_runs(packed(spark, sf_dir), WIDTH)
    share = lambda at: F.round(F.percentile("low", at, F.col("n")), 6)
    return runs.groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.sum("n").alias("windows"), share(0.5).alias("mid"), share(0.9).alias("high"))


@query(f"""SELECT file_id, round(sqrt(avg(value*value)), 6) AS rms, round(20.0e0*log10(greatest(sqrt(avg(value*value)), 1e-9)), 6) AS level_db,
  round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(stddev_pop(value), 6) AS sd
FROM ({FRAMES_SQL}) f GROUP BY file_id""")
def level_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    level = quality.file_level(rows.withColumnRenamed("value", "x"))
    shape = windows.percentiles(rows, "value", p10=0.1, p50=0.5, p90=0.9)
    spread = rows.groupBy("file_id").agg(F.stddev_pop("value").alias("sd"))
    return level.join(shape, "file_id").join(spread, "file_id").select("file_id", *[F.round(c, 6).alias(c) for c in ("rms", "level_db", "p10", "p50", "p90", "sd")])


@query(f"""WITH {_REGIONS_SQL}, lv AS (SELECT file_id, coalesce(avg(value*value) FILTER (WHERE EXISTS (SELECT 1 FROM regions q WHERE q.file_id=f.file_id AND (f.i+0.5e0)*0.5e0 BETWEEN q.start_s AND q.end_s)), avg(value*value)) AS ms FROM frames f GROUP BY file_id),
t AS (SELECT f.*, greatest(1e-6, sqrt(lv.ms)*power(10.0e0, -30.0e0/20)) AS fl_ FROM frames f JOIN lv ON f.file_id=lv.file_id),
r AS (SELECT file_id, min(i) AS a, max(i) AS b, count(*) AS n FROM (SELECT file_id, i, i-row_number() OVER (PARTITION BY file_id ORDER BY i) AS g FROM t WHERE value<fl_) x GROUP BY file_id, g),
h AS (SELECT * FROM r WHERE n*0.5e0 BETWEEN 0.5e0 AND 1.0e0 AND EXISTS (SELECT 1 FROM regions q WHERE q.file_id=r.file_id AND (r.a+r.b+1)*0.25e0 BETWEEN q.start_s AND q.end_s)),
c AS (SELECT file_id, count(*) AS holes FROM h GROUP BY 1), s AS (SELECT file_id, sum(end_s-start_s) AS sp FROM regions GROUP BY 1)
SELECT s.file_id, coalesce(c.holes, 0) AS holes, round({clamp_sql('(coalesce(c.holes, 0)/s.sp-0.3e0)/4.7e0')}, 6) AS dropouts FROM s LEFT JOIN c ON s.file_id=c.file_id""")
def dropout_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, regions = frames(spark, sf_dir).withColumnRenamed("value", "rms"), _regions(spark, sf_dir)
    holes = quality.dropouts(rows, regions, HOP, (0.5, 1.0), -30.0).groupBy("file_id").agg(F.count("*").alias("holes"))
    spoken = regions.groupBy("file_id").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("speech_s")).join(holes, "file_id", "left")
    n = F.coalesce("holes", F.lit(0))
    return spoken.select("file_id", n.alias("holes"), F.round(quality.dropout_score(n / F.col("speech_s")), 6).alias("dropouts"))


@query(f"""SELECT l_orderkey AS k, l_linenumber AS ln, 1.0e0-(1.0e0-least(1.0e0, l_discount*8.0e0)*1.0e0)*(1.0e0-0.9e0*least(1.0e0, l_tax*9.0e0))
  *(1.0e0-0.6e0*{clamp_sql('(l_quantity-20.0e0)/40.0e0')})*(1.0e0-0.55e0*coalesce(CASE WHEN l_partkey%3=0 THEN NULL ELSE (l_partkey%7)/7.0e0 END, 0.0e0)) AS degradation_score FROM lineitem""")
def noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), (F.col("l_discount") * 8.0).alias("clipping"), (F.col("l_tax") * 9.0).alias("dropouts"),
        scalars.ramp(F.col("l_quantity"), 20.0, 60.0).alias("level"), F.when(F.col("l_partkey") % 3 != 0, (F.col("l_partkey") % 7) / 7.0).alias("bandwidth"),
    )
    return quality.degradation(parts).select("k", "ln", "degradation_score")


@query(f"""SELECT l_orderkey AS k, l_linenumber AS ln,
  round(greatest({clamp_sql('(l_discount-0.0005e0)/0.0395e0')}, {clamp_sql('(l_quantity-8.0e0)/92.0e0')}), 6) AS clipping,
  round(greatest({clamp_sql('(l_quantity-42.0e0)/18.0e0')}, {clamp_sql('(-l_quantity+6.0e0)/4.5e0')}), 6) AS level,
  round(greatest({clamp_sql('(-(l_partkey%5)*4000.0e0+16000.0e0)/8100.0e0')}*0.55e0, CASE WHEN l_suppkey*50>4200 THEN {clamp_sql('(l_quantity-32.0e0)/16.0e0')} ELSE 0.0e0 END), 6) AS bandwidth
FROM lineitem""")
def impairment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"),
        F.round(quality.clipping_score(F.col("l_discount"), q), 6).alias("clipping"),
        F.round(quality.level_score(-q), 6).alias("level"),
        F.round(quality.bandwidth_score((F.col("l_partkey") % 5) * 4000.0, -q, F.col("l_suppkey") * 50), 6).alias("bandwidth"),
    )


@query(f"""
WITH f AS ({FRAMES_SQL}), c AS (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM f)
SELECT file_id, i FROM c WHERE n<=24 OR i IN (SELECT CAST(floor(k*(n-1)/23.0e0) AS BIGINT) FROM range(24) t(k))""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.even_sample(frames(spark, sf_dir), 24).select("file_id", "i")


@query(f"""WITH {_REGIONS_SQL}, w AS (SELECT file_id, start_s, end_s, unnest(range(CAST(floor((end_s-start_s)/0.6e0+1e-9) AS BIGINT))) AS k FROM regions)
SELECT file_id, CAST(k AS INT) AS k, round(start_s+k*0.6e0, 6) AS win_start_s, round(least(start_s+k*0.6e0+1.25e0, end_s), 6) AS win_end_s FROM w""")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.fixed_windows(_regions(spark, sf_dir))
    return found.select("file_id", "k", *[F.round(c, 6).alias(c) for c in ("win_start_s", "win_end_s")])


@query(f"""WITH f AS ({FRAMES_SQL}), p AS (SELECT file_id, value+70.0e0 AS f0 FROM f), m AS (SELECT file_id, median(f0) AS mid, count(*) AS n FROM p GROUP BY 1)
SELECT p.file_id, max(n) AS n, CASE WHEN max(n)>=4 THEN round(stddev_pop(12.0e0*log2(f0/mid)), 6) END AS semitone_sd FROM p JOIN m ON p.file_id=m.file_id GROUP BY p.file_id""")
def semitone_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    pitches = frames(spark, sf_dir).select("file_id", (F.col("value") + 70.0).alias("f0"))
    return windows.semitone_spread(pitches).withColumn("semitone_sd", F.round("semitone_sd", 6))


@query(f"""SELECT file_id, round(exp(avg(ln(value+1e-14)))/avg(value+1e-14), 6) AS flatness, round(coalesce(sum(CASE WHEN (i%64)*125<1000 THEN value ELSE 0.0e0 END)/sum(value), 0.0e0), 6) AS low_share,
  round(coalesce(sum(CASE WHEN (i%64)*125>=4000 THEN value ELSE 0.0e0 END)/sum(value), 0.0e0), 6) AS high_share FROM ({FRAMES_SQL}) f GROUP BY file_id""")
def spectral_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = frames(spark, sf_dir).select("file_id", ((F.col("i") % 64) * 125).alias("hz"), F.col("value").alias("power"))
    return windows.spectral_shape(bins, 1000.0, 4000.0).select("file_id", *[F.round(c, 6).alias(c) for c in ("flatness", "low_share", "high_share")])


@query("""SELECT file_id, round(c, 6) AS channel_corr, c<0.98e0 AS true_stereo FROM (SELECT l_suppkey AS file_id,
  CASE WHEN stddev_pop(l_quantity)>1e-9 AND stddev_pop(r)>1e-9 THEN covar_pop(l_quantity, r)/(stddev_pop(l_quantity)*stddev_pop(r)) ELSE 1.0e0 END AS c
  FROM (SELECT l_suppkey, l_quantity, CASE l_suppkey%3 WHEN 0 THEN l_quantity*0.5e0 WHEN 1 THEN 1.0e0 ELSE l_tax*10.0e0 END AS r FROM lineitem) s GROUP BY 1) x""")
def channel_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    right = F.when(F.col("l_suppkey") % 3 == 0, q * 0.5).when(F.col("l_suppkey") % 3 == 1, 1.0).otherwise(F.col("l_tax") * 10.0)
    samples = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file_id"), q.alias("left"), right.alias("right"))
    return windows.channel_correlation(samples).select("file_id", F.round("channel_corr", 6).alias("channel_corr"), "true_stereo")


@query(f"""WITH {_REGIONS_SQL}, c AS (SELECT DISTINCT file_id, i FROM (SELECT file_id, unnest(range(CAST(floor(start_s/0.5e0) AS BIGINT), CAST(ceil(end_s/0.5e0) AS BIGINT))) AS i FROM regions) x)
SELECT f.file_id, f.i FROM frames f WHERE EXISTS (SELECT 1 FROM c WHERE c.file_id=f.file_id AND c.i=f.i) OR NOT EXISTS (SELECT 1 FROM regions r WHERE r.file_id=f.file_id)""")
def frame_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, regions = frames(spark, sf_dir), _regions(spark, sf_dir)
    first, after = F.floor(F.col("start_s") / HOP).cast("long"), F.ceil(F.col("end_s") / HOP).cast("long")
    return windows.masked_frames(rows.select("file_id", "i"), regions, first, after)


@query(f"""WITH f AS (SELECT file_id, i, 20.0e0*log10(value+1e-9) AS db FROM ({FRAMES_SQL}) x), h AS (SELECT file_id, quantile_cont(db, 0.9) AS hi FROM f GROUP BY 1)
SELECT f.file_id, f.i FROM f JOIN h ON f.file_id=h.file_id WHERE db>hi-25.0e0""")
def voiced_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = frames(spark, sf_dir).select("file_id", "i", (20.0 * F.log10(F.col("value") + 1e-9)).alias("db"))
    return windows.voiced(levels, "db").select("file_id", "i")


@query(f"""WITH p AS (SELECT user_id AS file_id, event_type AS band, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)-1 AS BIGINT) AS i, value AS power FROM events),
l AS (SELECT * FROM (SELECT file_id, i, min(power) OVER w AS low, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY file_id, band ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) x WHERE n=3),
fl AS (SELECT file_id, quantile_cont(s, 0.9) AS noise FROM (SELECT file_id, i, sum(low)*1.5e0 AS s FROM l GROUP BY 1, 2) y GROUP BY 1),
sp AS (SELECT file_id, quantile_cont(s, 0.5) AS speech FROM (SELECT file_id, i, sum(power) AS s FROM p WHERE i%2=0 GROUP BY 1, 2) z GROUP BY 1)
SELECT fl.file_id, round(CASE WHEN speech IS NULL THEN -90.0e0 ELSE greatest(-90.0e0, least(0.0e0, 10.0e0*log10(noise+1e-30)-10.0e0*log10(speech+1e-30))) END, 6) AS noise_level_db FROM fl LEFT JOIN sp ON fl.file_id=sp.file_id""")
def noise_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    power = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("event_type").alias("band"), (F.row_number().over(order) - 1).cast("long").alias("i"), F.col("value").alias("power"))
    speech = power.where("i % 2 = 0").select("file_id", "i").distinct()
    return windows.noise_level(power, speech, 3).withColumn("noise_level_db", F.round("noise_level_db", 6))


# -- classes and vocabulary ---------------------------------------------------------------------

_VOTES_SQL = f"""
sc AS ({CLASS_SCORES_SQL}),
votes AS (SELECT file_id, CASE WHEN name IN ('Car', 'Engine') THEN 'road noise' WHEN name='Music' THEN 'music' ELSE 'keyboard typing' END AS term, sum(score) AS score
  FROM sc WHERE name IN ('Car', 'Engine', 'Music', 'Computer keyboard') GROUP BY 1, 2),
shares AS (SELECT *, score/sum(score) OVER (PARTITION BY file_id) AS share FROM votes)"""


@query(f"WITH {_VOTES_SQL} SELECT file_id, term, round(score, 6) AS score, round(share, 6) AS share FROM shares")
def class_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classdist.shares(classdist.class_votes(class_scores(spark, sf_dir)))
    return found.select("file_id", "term", F.round("score", 6).alias("score"), F.round("share", 6).alias("share"))


@query(f"WITH {_VOTES_SQL} SELECT file_id, term, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY share DESC, term) AS n FROM shares) x WHERE n<=2")
def class_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classdist.shares(classdist.class_votes(class_scores(spark, sf_dir)))
    return classdist.ranked(found, "share", 2).select("file_id", "term", "rank")


@query(f"WITH {_VOTES_SQL} SELECT file_id, term FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, term) AS n FROM votes) x WHERE n=1")
def class_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classdist.ranked(classdist.class_votes(class_scores(spark, sf_dir)), "score", 1).select("file_id", "term")


@query(f"""WITH sc AS ({CLASS_SCORES_SQL}) SELECT file_id, name, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, name) AS n FROM sc) x
WHERE n<=3 AND score>0.02e0""")
def class_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classdist.top_scores(class_scores(spark, sf_dir), 3).select("file_id", "name", "rank")


def _rows_sql(table_: dict[str, str] | tuple[str, ...]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    items = table_.items() if isinstance(table_, dict) else [(x, x) for x in table_]
    return "VALUES " + ", ".join(f"({n}, {quote(k)}, {quote(v)})" for n, (k, v) in enumerate(items))


_SURFACE_SQL = """
  SELECT DISTINCT t FROM (
    SELECT trim(q || ' ' || a) AS t FROM (SELECT unnest(['', 'Sharp', 'background', 'very loud']) AS q) x,
      (SELECT DISTINCT event_type AS a FROM events UNION SELECT DISTINCT p_name FROM part UNION SELECT unnest(['TV', 'static!', 'hiss', 'Wind noise (microphone)',
       'keyboard', 'Babble', 'traffic noise', 'phone line', 'dog kennel', 'music', 'Alarm', 'car', 'baby monitor', ''])) y)"""
_NORMAL_SQL = f"""
cn AS (SELECT * FROM ({_rows_sql(vocab.CANONICAL)}) v(n, a, b)), al AS (SELECT * FROM ({_rows_sql(vocab.ALIASES)}) v(n, a, b)),
kl AS (SELECT * FROM ({_rows_sql(vocab.FOLDED_CLASSES)}) v(n, a, b)),
surface AS ({_SURFACE_SQL}),
fo AS (SELECT t, trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) AS f FROM surface),
ba AS (SELECT t, f, array_to_string(w, ' ') AS bare, w FROM (SELECT t, f, list_filter(string_split(f, ' '), lambda x: x NOT IN ({', '.join(chr(39) + q + chr(39) for q in vocab.QUALIFIERS)})) AS w FROM fo) z),
normal AS (SELECT t, CASE WHEN f='' THEN '' ELSE coalesce(
  (SELECT b FROM cn WHERE a=f), (SELECT b FROM kl WHERE a=f), (SELECT b FROM al WHERE a=f), (SELECT b FROM al WHERE a=bare), (SELECT b FROM cn WHERE a=bare),
  (SELECT arg_min(b, n) FROM cn WHERE list_has_any(string_split(a, ' '), w)), (SELECT arg_min(b, n) FROM al WHERE list_has_any(string_split(a, ' '), w)),
  nullif(bare, ''), f) END AS term FROM ba)"""


def _surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    literals = ["TV", "static!", "hiss", "Wind noise (microphone)", "keyboard", "Babble", "traffic noise", "phone line", "dog kennel", "music", "Alarm", "car", "baby monitor", ""]
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("a")).union(table(spark, sf_dir, "part").select("p_name")).distinct()
    names = own.union(spark.range(1).select(F.explode(F.array(*map(F.lit, literals))))).distinct()
    qualified = names.select(F.explode(F.array(*[F.trim(F.concat(F.lit(q + " "), "a")) for q in ("", "Sharp", "background", "very loud")])).alias("t"))
    return qualified.distinct()


@query(f"WITH {_NORMAL_SQL} SELECT t, term, CASE WHEN term IN (SELECT a FROM cn) THEN term ELSE '' END AS canonical FROM normal")
def vocab_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surface(spark, sf_dir).select("t", vocab.normalize(F.col("t")).alias("term"), vocab.canonical_only(F.col("t")).alias("canonical"))


@query(f"""WITH {_NORMAL_SQL}, fam AS (SELECT * FROM (VALUES {', '.join(f"({n}, '{t}')" for n, f in enumerate(vocab.FAMILIES) for t in f)}) v(g, term)),
tm AS (SELECT DISTINCT term FROM normal)
SELECT a.term AS truth, b.a AS pred, CASE WHEN a.term=b.a THEN 1.0e0 WHEN a.term='' THEN 0.0e0
  WHEN list_has_any(string_split(a.term, ' '), string_split(b.a, ' ')) OR EXISTS (SELECT 1 FROM fam f JOIN fam g ON f.g=g.g WHERE f.term=a.term AND g.term=b.a) THEN 0.5e0 ELSE 0.0e0 END AS likeness
FROM tm a, cn b""")
def vocab_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _surface(spark, sf_dir).select(vocab.normalize(F.col("t")).alias("truth")).distinct()
    pairs = terms.select("truth", F.explode(F.array(*map(F.lit, vocab.CANONICAL))).alias("pred"))  # against the closed vocabulary
    return pairs.select("truth", "pred", vocab.match_terms(F.col("truth"), F.col("pred")).alias("likeness"))


# -- roles and clusters -------------------------------------------------------------------------

_AGENT, _CUSTOMER = (r"\bthe\b", r"\bof (the|and)\b", r"\bdie\b", r"\bla\b"), (r"\band\b", r"\bis\b")
_EDGE = r"[^\p{L}\p{N}_]"  # DuckDB's word boundary knows ASCII letters only
_BOUND = lambda p: f"(^|{_EDGE}){p.replace(chr(92) + 'b', '')}({_EDGE}|$)"
_HITS = lambda patterns: "+".join(f"CASE WHEN regexp_matches(lower(text), '{_BOUND(p)}') THEN 1 ELSE 0 END" for p in patterns)


@query(rf"SELECT conv_id, turn, CAST(({_HITS(_AGENT)})-({_HITS(_CUSTOMER)}) AS DOUBLE) AS votes FROM conversations")
def role_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", roles.agent_votes(F.col("text"), _AGENT, _CUSTOMER).alias("votes"))


_CLUSTERS_SQL = """
cl AS (SELECT conv_id AS file_id, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS cluster, -CAST(min(length(text)) AS DOUBLE)/10.0e0 AS floor_db,
  stddev_pop(length(text))/20.0e0 AS level_sd, CAST(min(turn) AS DOUBLE) AS first_start_s, CAST(sum(CASE WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])the([^\\p{L}\\p{N}_]|$)') THEN 1 ELSE 0 END) AS DOUBLE) AS votes
  FROM conversations GROUP BY 1, 2)"""


def _deviation(ordered: Column) -> Column:
    """Population deviation of an array of structs' ``x``, updated value by value in their order: the same to the last bit in each run."""
    nothing = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(s: Column, e: Column) -> Column:
        n = s["n"] + 1.0
        mean = s["mean"] + (e["x"] - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["squares"] + (e["x"] - s["mean"]) * (e["x"] - mean)).alias("squares"))

    return F.aggregate(ordered, nothing, step, lambda s: F.sqrt(F.try_divide(s["squares"], s["n"])))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    cluster = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    lengths = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("turn", F.length("text").cast("double").alias("x")))))
    return turns.groupBy(F.col("conv_id").alias("file_id"), cluster.alias("cluster")).agg(
        (-F.min(F.length("text")).cast("double") / 10.0).alias("floor_db"), (_deviation(lengths) / 20.0).alias("level_sd"),
        F.min("turn").cast("double").alias("first_start_s"), F.sum(roles.pattern_hits(F.col("text"), (r"\bthe\b",))).cast("double").alias("votes"),
    )


@query(f"""WITH {_CLUSTERS_SQL},
w AS (SELECT *, count(*) OVER p AS n, sum(floor_db) OVER p AS sf, sum(level_sd) OVER p AS sl, max(votes) OVER p - min(votes) OVER p AS spread,
  row_number() OVER (PARTITION BY file_id ORDER BY first_start_s, cluster)=1 AS fst FROM cl WINDOW p AS (PARTITION BY file_id)),
s AS (SELECT *, CASE WHEN n>1 THEN greatest(-1.0e0, least(1.0e0, (floor_db-(sf-floor_db)/(n-1))/12.0e0)) ELSE 0.0e0 END
  + 0.45e0*CASE WHEN n>1 THEN greatest(-1.0e0, least(1.0e0, (level_sd-(sl-level_sd)/(n-1))/6.0e0)) ELSE 0.0e0 END - CASE WHEN fst THEN 0.3e0 ELSE 0.0e0 END AS sc FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY sc DESC, cluster) AS rk FROM s),
m AS (SELECT *, max(CASE WHEN rk=1 THEN sc END) OVER p - max(CASE WHEN rk=2 THEN sc END) OVER p AS mg FROM r WINDOW p AS (PARTITION BY file_id)),
x AS (SELECT *, coalesce(mg/1.75e0<0.55e0 AND spread>0, false) AS words FROM m), y AS (SELECT *, sc-CASE WHEN words THEN 1.2e0*votes/spread ELSE 0.0e0 END AS fin FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY fin DESC, cluster) AS rank FROM y),
q AS (SELECT *, max(CASE WHEN rank=1 THEN fin END) OVER p - max(CASE WHEN rank=2 THEN fin END) OVER p AS mg2 FROM z WINDOW p AS (PARTITION BY file_id))
SELECT file_id, cluster, round(fin, 6) AS score, CAST(rank AS INT) AS rank, round(coalesce({clamp_sql('mg2/CASE WHEN words THEN 2.95e0 ELSE 1.75e0 END')}, 0.35e0), 6) AS role_confidence
FROM (SELECT * FROM q) t""".replace("coalesce(greatest(0.0e0, least(1.0e0, mg2/", "coalesce(CASE WHEN mg2 IS NOT NULL THEN greatest(0.0e0, least(1.0e0, mg2/").replace("1.75e0 END)), 0.35e0)", "1.75e0 END)) END, 0.35e0)"))
def role_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = roles.acoustic_roles(_clusters(spark, sf_dir))
    return found.select("file_id", "cluster", scalars.rounded(F.col("score"), 6).alias("score"), "rank", scalars.rounded(F.col("role_confidence"), 6).alias("role_confidence"))


@query(f"""WITH {_CLUSTERS_SQL}, w AS (SELECT *, count(*) OVER p AS n, max(votes) OVER p - min(votes) OVER p AS spread, row_number() OVER (PARTITION BY file_id ORDER BY votes, cluster) AS rk FROM cl WINDOW p AS (PARTITION BY file_id)),
g AS (SELECT file_id, max(CASE WHEN rk=1 THEN cluster END) AS customer, max(spread) AS spread, max(CASE WHEN rk=1 THEN floor_db END) AS own, max(CASE WHEN rk>1 THEN floor_db END) AS other FROM w WHERE n>=2 AND spread>0 GROUP BY 1)
SELECT file_id, customer, round(CASE WHEN own>other THEN least(0.95e0, greatest(0.15e0, least(0.9e0, spread/4.0e0))+0.15e0) ELSE greatest(0.15e0, least(0.9e0, spread/4.0e0)) END, 6) AS role_confidence FROM g""")
def role_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.lexical_roles(_clusters(spark, sf_dir)).withColumn("role_confidence", F.round("role_confidence", 6))


_SPEECH_SQL = "SELECT conv_id AS file_id, greatest(0.0e0, (sum(length(text))-400)/20.0e0) AS speech_s FROM conversations GROUP BY 1"


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of hardly any text are recordings without speech."""
    length = F.greatest(F.lit(0.0), (F.sum(F.length("text")) - 400) / 20.0)
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("file_id")).agg(length.alias("speech_s"))


_CASCADE_SQL = f"""
sp AS ({_SPEECH_SQL}), size AS (SELECT file_id, count(*) AS n FROM (SELECT conv_id AS file_id, role FROM conversations GROUP BY 1, 2) q GROUP BY 1),
lx AS ({ORACLE_SQL["role_lexical"]}), ac AS ({ORACLE_SQL["role_score"]}),
rc AS (SELECT sp.file_id, CASE WHEN coalesce(speech_s, 0)<=0 THEN 0 WHEN lx.file_id IS NOT NULL OR size.n>=2 THEN size.n ELSE 1 END AS n_speakers,
  CASE WHEN coalesce(speech_s, 0)<=0 THEN NULL WHEN lx.file_id IS NOT NULL THEN lx.customer WHEN size.n>=2 THEN ac.cluster END AS customer,
  CASE WHEN coalesce(speech_s, 0)<=0 THEN 0.0e0 WHEN lx.file_id IS NOT NULL THEN lx.role_confidence WHEN size.n>=2 THEN ac.role_confidence ELSE 0.35e0 END AS role_confidence,
  CASE WHEN coalesce(speech_s, 0)<=0 THEN 'silent' WHEN lx.file_id IS NOT NULL THEN 'lexical' WHEN size.n>=2 THEN 'acoustic' ELSE 'one voice' END AS how
  FROM sp LEFT JOIN lx ON sp.file_id=lx.file_id LEFT JOIN ac ON sp.file_id=ac.file_id AND ac.rank=1 LEFT JOIN size ON sp.file_id=size.file_id)"""


@query(f"WITH {_CASCADE_SQL} SELECT file_id, CAST(n_speakers AS INT) AS n_speakers, CAST(customer AS INT) AS customer, round(role_confidence, 4) AS role_confidence, how FROM rc")
def role_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words decide, else the sound of the voices, else all speech is the customer's."""
    own = _clusters(spark, sf_dir)
    return assigned(_spoken(spark, sf_dir), own, own)


@query("""
WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings WHERE label IS NOT NULL),
m AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x*x)) AS size FROM m GROUP BY 1),
u AS (SELECT m.label, dim, x/size AS x FROM m JOIN n ON m.label=n.label)
SELECT a.label AS label, b.label AS other, round(1.0e0-sum(a.x*b.x), 6) AS separation FROM u a JOIN u b ON a.dim=b.dim AND b.label=a.label+1 GROUP BY 1, 2""")
def centroid_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = clusters.centroids(table(spark, sf_dir, "embeddings").where("label IS NOT NULL"), "label")
    other = means.select(F.col("label").alias("other"), F.col("centroid").alias("c2"))
    pairs = means.join(other, F.col("other") == F.col("label") + 1)
    return pairs.select("label", "other", F.round(clusters.separation(pairs, "centroid", "c2"), 6).alias("separation"))


@query("""WITH w AS (SELECT vec_id//20 AS file_id, CASE WHEN label<=1 THEN 1 ELSE 0 END AS cluster, count(*) AS n FROM embeddings GROUP BY 1, 2),
r AS (SELECT file_id, min(n) AS least_n, sum(n) AS all_n, count(*) AS k FROM w GROUP BY 1)
SELECT w.file_id, CASE WHEN k>=2 AND least_n>=greatest(2.0e0, 0.12e0*all_n) THEN cluster ELSE 0 END AS cluster, CAST(sum(n) AS BIGINT) AS n FROM w JOIN r ON w.file_id=r.file_id GROUP BY 1, 2""")
def small_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("file_id"), F.when(F.col("label") <= 1, 1).otherwise(0).alias("cluster"))
    return clusters.collapse_small(own).groupBy("file_id", "cluster").agg(F.count("*").alias("n"))


_UNIT = "list_transform({0}, lambda y: y/CASE WHEN list_inner_product({0}, {0})>0 THEN sqrt(list_inner_product({0}, {0})) ELSE 1.0e0 END)"


def _two_means_sql(rounds: int) -> str:
    """Two starts for each file of 100 vectors, its first and its last, and so many rounds for all."""
    parts = [f"""
x AS (SELECT vec_id//100 AS file_id, vec_id AS id, {_UNIT.format("e")} AS x, row_number() OVER (PARTITION BY vec_id//100 ORDER BY vec_id) AS r, count(*) OVER (PARTITION BY vec_id//100) AS n
  FROM (SELECT vec_id, list_transform(embedding, lambda y: CAST(y AS DOUBLE)) AS e FROM embeddings) q),
sd AS (SELECT file_id, r-1 AS start, x AS a FROM x WHERE r=1 OR r=n),
s0 AS (SELECT file_id, start, a, x AS b FROM (SELECT x.file_id, start, a, x.x AS x, row_number() OVER (PARTITION BY x.file_id, start ORDER BY list_inner_product(x.x, a), x.id) AS k
  FROM x JOIN sd ON x.file_id=sd.file_id) q WHERE k=1)"""]
    for k in range(rounds):
        parts.append(f"""
d{k} AS (SELECT x.file_id, start, CASE WHEN list_inner_product(x, b)>list_inner_product(x, a) THEN 1 ELSE 0 END AS side, x FROM x JOIN s{k} ON x.file_id=s{k}.file_id),
e{k} AS (SELECT file_id, start, side, unnest(x) AS v, unnest(range(len(x))) AS dim FROM d{k}),
m{k} AS (SELECT file_id, start, side, list(v ORDER BY dim) AS m FROM (SELECT file_id, start, side, dim, avg(v) AS v FROM e{k} GROUP BY ALL) q GROUP BY ALL),
s{k + 1} AS (SELECT s{k}.file_id, s{k}.start, coalesce({_UNIT.format("p.m")}, a) AS a, coalesce({_UNIT.format("q.m")}, b) AS b FROM s{k}
  LEFT JOIN m{k} p ON s{k}.file_id=p.file_id AND s{k}.start=p.start AND p.side=0 LEFT JOIN m{k} q ON s{k}.file_id=q.file_id AND s{k}.start=q.start AND q.side=1)""")
    parts.append(f"""
fin AS (SELECT x.file_id, id, start, x.x AS x, list_inner_product(x, a) AS da, list_inner_product(x, b) AS db FROM x JOIN s{rounds} s ON x.file_id=s.file_id),
bst AS (SELECT file_id, start FROM (SELECT file_id, start, row_number() OVER (PARTITION BY file_id ORDER BY round(sum(greatest(da, db)), 9) DESC, start) AS k FROM fin GROUP BY file_id, start) q WHERE k=1),
ch AS (SELECT f.file_id, id, x, CASE WHEN db>da THEN 1 ELSE 0 END AS side FROM fin f JOIN bst ON f.file_id=bst.file_id AND f.start=bst.start),
cl AS (SELECT file_id, id, x, abs(side-first_value(side) OVER (PARTITION BY file_id ORDER BY id)) AS cluster, count(*) OVER (PARTITION BY file_id) AS n FROM ch),
nn AS (SELECT file_id, cluster, count(*) AS k FROM cl GROUP BY 1, 2), ok AS (SELECT file_id, count(*)>=2 AND min(k)>=greatest(2.0e0, 0.12e0*sum(k)) AS keep FROM nn GROUP BY 1),
cc AS (SELECT cl.file_id, id, n, CASE WHEN keep THEN cluster ELSE 0 END AS cluster, vec_id FROM cl JOIN ok ON cl.file_id=ok.file_id JOIN embeddings ON vec_id=id),
ce AS (SELECT file_id, cluster, dim, avg(CAST(v AS DOUBLE)) AS v FROM (SELECT cc.file_id, cc.cluster, unnest(e.embedding) AS v, unnest(range(len(e.embedding))) AS dim FROM cc JOIN embeddings e ON e.vec_id=cc.vec_id) q GROUP BY ALL),
cm AS (SELECT file_id, cluster, {_UNIT.format("m")} AS m FROM (SELECT file_id, cluster, list(v ORDER BY dim) AS m FROM ce GROUP BY ALL) q),
se AS (SELECT a.file_id, 1.0e0-list_inner_product(a.m, b.m) AS separation FROM cm a JOIN cm b ON a.file_id=b.file_id AND a.cluster=0 AND b.cluster=1)
SELECT cc.file_id, id, CAST(CASE WHEN n<4 OR separation IS NULL OR separation<0.22e0 THEN 0 ELSE cluster END AS INT) AS cluster, CASE WHEN n>=4 THEN round(separation, 6) END AS separation
FROM cc LEFT JOIN se ON cc.file_id=se.file_id""")
    return "WITH " + ",".join(parts[:-1]) + "," + parts[-1]


@query(_two_means_sql(3))
def speaker_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clusters of each 100 vectors, by two starts and three rounds for all files at once."""
    own = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("file_id"), F.col("vec_id").alias("id"), "embedding")
    return clusters.speakers(own, starts=2, rounds=3).select("file_id", "id", "cluster", F.round("separation", 6).alias("separation"))


# -- emotion ------------------------------------------------------------------------------------

_POSTERIOR_SQL = f"""SELECT file_id, CASE WHEN i%4=0 THEN 'neu' WHEN i%4=1 THEN 'hap' WHEN i%4=2 THEN 'ang' WHEN i%8=3 THEN 'sad' ELSE 'other' END AS label,
  value/sum(value) OVER (PARTITION BY file_id) AS p FROM ({FRAMES_SQL}) f"""


def _posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    label = F.when(i % 4 == 0, "neu").when(i % 4 == 1, "hap").when(i % 4 == 2, "ang").when(i % 8 == 3, "sad").otherwise("other")
    return frames(spark, sf_dir).select("file_id", label.alias("label"), (F.col("value") / F.sum("value").over(Window.partitionBy("file_id"))).alias("p"))


_PROJECT_SQL = """SELECT file_id, greatest(-1.0e0, least(1.0e0, sum(p*CASE label WHEN 'hap' THEN 0.7e0 WHEN 'ang' THEN -0.7e0 WHEN 'sad' THEN -0.55e0 ELSE 0.0e0 END))) AS valence,
  greatest(-1.0e0, least(1.0e0, 2.0e0*sum(p*CASE label WHEN 'neu' THEN 0.1e0 WHEN 'hap' THEN 0.55e0 WHEN 'ang' THEN 0.85e0 WHEN 'sad' THEN 0.15e0 ELSE 0.2e0 END)-1.0e0)) AS arousal FROM po GROUP BY 1"""


@query(f"WITH po AS ({_POSTERIOR_SQL}), pr AS ({_PROJECT_SQL}) SELECT file_id, round(valence, 6) AS valence, round(arousal, 6) AS arousal FROM pr")
def ser_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emotion.project(_posteriors(spark, sf_dir)).select("file_id", F.round("valence", 6).alias("valence"), F.round("arousal", 6).alias("arousal"))


@query(f"""WITH po AS ({_POSTERIOR_SQL}) SELECT file_id, round(greatest(-1.0e0, least(1.0e0, sum(CASE WHEN label='hap' THEN p WHEN label IN ('ang', 'sad') THEN -p ELSE 0.0e0 END))), 6) AS lexical FROM po GROUP BY 1""")
def sentiment_valence(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _posteriors(spark, sf_dir).withColumn("label", F.when(F.col("label") == "hap", "Positive").when(F.col("label").isin("ang", "sad"), "NEG").otherwise("neutral"))
    return emotion.sentiment_valence(named).withColumn("lexical", F.round("lexical", 6))


@query(f"""
WITH latents AS ({LATENTS_SQL}), a AS (SELECT k, ln, arousal, valence, role_confidence, k%97 AS file_id, coalesce(arousal>=0.3e0, false) OR abs(coalesce(valence, 0.0e0))<0.35e0 AS wanted FROM latents),
l AS (SELECT * FROM (SELECT range AS file_id, (range%21)/10.0e0-1.0e0 AS lexical FROM range(97)) x WHERE file_id%5<>0),
j AS (SELECT a.*, CASE WHEN wanted THEN lexical END AS lex FROM a LEFT JOIN l ON a.file_id=l.file_id),
f AS (SELECT *, CASE WHEN valence IS NOT NULL AND lex IS NOT NULL THEN 0.35e0*valence+0.65e0*lex ELSE coalesce(lex, valence, 0.0e0) END AS v,
  CASE WHEN valence IS NOT NULL AND lex IS NOT NULL THEN 'fused' WHEN lex IS NOT NULL THEN 'lexical' WHEN valence IS NOT NULL THEN 'acoustic' ELSE 'none' END AS valence_source,
  CASE WHEN role_confidence<0.5e0 THEN 0.5e0+role_confidence ELSE 1.0e0 END AS sh FROM j)
SELECT k, ln, round(greatest(-1.0e0, least(1.0e0, v*sh)), 6) AS valence, valence_source, round(CASE WHEN arousal IS NOT NULL THEN greatest(-1.0e0, least(1.0e0, arousal*sh)) END, 6) AS arousal FROM f""")
def fusion_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latents(spark, sf_dir).select("k", "ln", "arousal", F.col("valence").alias("acoustic"), "role_confidence", (F.col("k") % 97).alias("file_id"))
    words = spark.range(97).where("id % 5 <> 0").select(F.col("id").alias("file_id"), ((F.col("id") % 21) / 10.0 - 1.0).alias("lexical"))
    found = emotion.cascade(rows, words).withColumn("arousal", F.when(F.col("arousal").isNotNull(), F.col("arousal")))
    return found.select("k", "ln", F.round("valence", 6).alias("valence"), "valence_source", F.round("arousal", 6).alias("arousal"))


@query(f"""WITH {_REGIONS_SQL}, po AS ({_POSTERIOR_SQL}), pr AS ({_PROJECT_SQL}), {_CASCADE_SQL},
spk AS (SELECT fl.file_id, coalesce(sum(end_s-start_s), 0.0e0) AS speech_s FROM fl LEFT JOIN regions r ON fl.file_id=r.file_id GROUP BY 1),
wd AS (SELECT conv_id AS file_id, greatest(-1.0e0, least(1.0e0, avg(length(text))/60.0e0-1.0e0)) AS lexical FROM conversations GROUP BY 1),
ps AS (SELECT file_id, greatest(-1.0e0, least(1.0e0, avg(value)/50.0e0-1.0e0)) AS arousal FROM frames GROUP BY 1),
j AS (SELECT s.file_id, coalesce((ps.arousal+pr.arousal)/2.0e0, ps.arousal, pr.arousal) AS arousal, pr.valence AS acoustic, rc.role_confidence AS conf, wd.lexical
  FROM spk s LEFT JOIN ps ON s.file_id=ps.file_id LEFT JOIN pr ON s.file_id=pr.file_id LEFT JOIN rc ON s.file_id=rc.file_id LEFT JOIN wd ON s.file_id=wd.file_id WHERE s.speech_s>0),
k AS (SELECT *, CASE WHEN coalesce(arousal>=0.3e0, false) OR abs(coalesce(acoustic, 0.0e0))<0.35e0 THEN lexical END AS lex, CASE WHEN conf<0.5e0 THEN 0.5e0+round(conf, 4) ELSE 1.0e0 END AS sh FROM j)
SELECT file_id, round(greatest(-1.0e0, least(1.0e0, arousal*sh)), 4) AS arousal,
  round(greatest(-1.0e0, least(1.0e0, sh*CASE WHEN acoustic IS NOT NULL AND lex IS NOT NULL THEN 0.35e0*acoustic+0.65e0*lex ELSE coalesce(lex, acoustic, 0.0e0) END)), 4) AS valence,
  CASE WHEN acoustic IS NOT NULL AND lex IS NOT NULL THEN 'fused' WHEN lex IS NOT NULL THEN 'lexical' WHEN acoustic IS NOT NULL THEN 'acoustic' ELSE 'none' END AS valence_source FROM k
UNION ALL SELECT file_id, 0.0e0, 0.0e0, 'none' FROM spk WHERE speech_s<=0""")
def tone_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prosody with classes, words where needed, shrunk by roles: each from another table, so that each lacks some files."""
    rows = frames(spark, sf_dir)
    speech = intervals.speech_summary(_regions(spark, sf_dir), files(rows)).select("file_id", "speech_s")
    prosodic = rows.groupBy("file_id").agg(scalars.clamp(F.avg("value") / 50.0 - 1.0, -1.0, 1.0).alias("arousal"))
    words = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("file_id")).agg(scalars.clamp(F.avg(F.length("text")) / 60.0 - 1.0, -1.0, 1.0).alias("lexical"))
    return tone(speech, prosodic, _posteriors(spark, sf_dir), words, role_cascade(spark, sf_dir))


@query("""SELECT l_orderkey AS k, l_linenumber AS ln, CASE WHEN l_quantity>=40 THEN 'none' WHEN l_quantity>=25 THEN 'low' WHEN l_quantity>=12 THEN 'medium' ELSE 'high' END AS severity,
  CAST(floor(least(100.0e0, 100.0e0*(l_linenumber+CASE WHEN l_linenumber<7 THEN least((l_partkey%6)/5.0e0, 0.99e0) ELSE 0.0e0 END)/7.0e0)) AS INT) AS percent,
  CASE WHEN l_extendedprice<60 THEN 'just now' WHEN l_extendedprice<3600 THEN CAST(floor(l_extendedprice/60) AS BIGINT)||' min ago' WHEN l_extendedprice<86400 THEN CAST(floor(l_extendedprice/3600) AS BIGINT)||' h ago'
    ELSE CAST(floor(l_extendedprice/86400) AS BIGINT)||' d ago' END AS age FROM lineitem""")
def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), line.alias("ln"), scalars.snr_severity(F.col("l_quantity")).alias("severity"),
        scalars.progress_percent(line, F.col("l_partkey") % 6, F.lit(5), F.lit(7)).alias("percent"), scalars.age_bucket(F.col("l_extendedprice")).alias("age"),
    )


@query(f"""SELECT l_orderkey AS k, l_linenumber AS ln, round(greatest(-1.0e0, least(1.0e0, 2.0e0*(0.3e0*{clamp_sql('(l_quantity/4.0e0-3.0e0)/8.0e0')}+0.3e0*{clamp_sql('(l_linenumber-0.8e0)/3.2e0')}
  +0.2e0*{clamp_sql('(l_discount*6.0e0-0.15e0)/0.4e0')}+0.2e0*{clamp_sql('(l_tax*12.0e0-0.5e0+0.6e0)/1.0e0')})-1.0e0)), 6) AS arousal FROM lineitem""")
def prosodic_arousal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = emotion.prosodic_arousal(F.col("l_quantity") / 4.0, F.col("l_linenumber") * 1.0, F.col("l_discount") * 6.0, F.col("l_tax") * 12.0 - 0.5)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.round(found, 6).alias("arousal"))


@query("""SELECT d.doc_id AS name, coalesce(CAST(l.quality AS VARCHAR) || '|' || CAST(l.toxic AS VARCHAR), CAST(d.doc_id AS VARCHAR)) AS grp FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id""")
def group_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"))
    groups = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), F.concat_ws("|", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("grp"))
    return score.with_groups(clips, groups)


@query("""SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END AS BIGINT) AS rank,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END, o_orderkey) AS INT) AS pos FROM orders""")
def rank_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = score.rank_order("o_orderpriority", {"o_orderpriority": ("5-LOW", "3-MEDIUM", "2-HIGH")})
    ranked = table(spark, sf_dir, "orders").withColumn("rank", key)
    return ranked.select("o_orderkey", "rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy("rank", "o_orderkey")).alias("pos"))


# -- files, manifests and jobs ------------------------------------------------------------------

_PATHS_SQL = """SELECT page_id, CASE page_id%9 WHEN 0 THEN '__MACOSX/' WHEN 1 THEN 'up.zip.d/' ELSE 'up' || (page_id%3) || '.d/' END
  || replace(replace(split_part(split_part(url, '?', 1), '#', 1), 'https://', ''), 'http://', '')
  || CASE page_id%5 WHEN 0 THEN '.WAV' WHEN 1 THEN '.ogg' WHEN 2 THEN '.csv' WHEN 3 THEN '.txt' ELSE '' END
  || CASE WHEN page_id%31=0 THEN '/.DS_Store' WHEN page_id%29=0 THEN '/._a.ogg' ELSE '' END AS path FROM pages"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    folder = F.when(n % 9 == 0, "__MACOSX/").when(n % 9 == 1, "up.zip.d/").otherwise(F.concat(F.lit("up"), (n % 3).cast("string"), F.lit(".d/")))
    plain = F.replace(F.replace(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    ending = F.when(n % 5 == 0, ".WAV").when(n % 5 == 1, ".ogg").when(n % 5 == 2, ".csv").when(n % 5 == 3, ".txt").otherwise("")
    extra = F.when(n % 31 == 0, "/.DS_Store").when(n % 29 == 0, "/._a.ogg").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(folder, plain, ending, extra).alias("path"))


_BASE = "split_part(path, '/', -1)"


@query(f"""WITH p AS ({_PATHS_SQL}), b AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x<>'') AS parts FROM p),
c AS (SELECT *, parts[len(parts)] AS base FROM b), d AS (SELECT *, lower(regexp_extract(base, '.[.]([^.]+)$', 1)) AS suffix FROM c)
SELECT page_id, base, suffix, CASE WHEN list_contains(parts, '__MACOSX') OR starts_with(base, '._') OR base='.DS_Store' THEN 'junk'
  WHEN suffix IN ('wav', 'ogg', 'mp3') THEN 'audio' WHEN suffix='csv' THEN 'manifest' ELSE 'skipped' END AS kind FROM d""")
def junk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _paths(spark, sf_dir).select("page_id", manifest.basename(path).alias("base"), manifest.suffix(path).alias("suffix"), manifest.classify(path).alias("kind"))


_NAMES_SQL = """SELECT page_id, 'up' || (page_id%2) || '.d/' || (page_id%7) || '/' || regexp_extract(url, '//([a-z]+)', 1) || '.wav' AS path FROM pages"""


@query(f"""WITH p AS ({_NAMES_SQL}), b AS (SELECT page_id, path, split_part(path, '/', 3) AS base, split_part(path, '/', 2) || '/' || split_part(path, '/', 3) AS rest FROM p),
c AS (SELECT *, count(*) OVER (PARTITION BY base) AS same FROM b), l AS (SELECT *, CASE WHEN same=1 THEN base ELSE rest END AS label FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY base, label ORDER BY path, page_id)-1 AS nth FROM l)
SELECT path, CASE WHEN nth>0 THEN replace(base, '.wav', '') || ' (' || nth || ').wav' ELSE label END AS label FROM n""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "//([a-z]+)", 1)
    n = F.col("page_id")
    path = F.concat(F.lit("up"), (n % 2).cast("string"), F.lit(".d/"), (n % 7).cast("string"), F.lit("/"), host, F.lit(".wav"))
    return manifest.display_names(table(spark, sf_dir, "pages").select(path.alias("path"))).select("path", "label")


@query("""WITH c AS (SELECT page_id AS rows_, 'a/' || repeat('d/', CAST(page_id%4 AS INT)) || url AS path FROM pages),
d AS (SELECT path, CASE WHEN rows_%3=0 THEN 0 ELSE rows_ END AS rows, len(list_filter(string_split(path, '/'), lambda x: x<>'')) AS depth FROM c)
SELECT path, rows FROM d WHERE rows>0 ORDER BY depth, path LIMIT 1""")
def manifest_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    found = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("a/"), F.repeat(F.lit("d/"), (n % 4).cast("int")), "url").alias("path"), F.when(n % 3 == 0, 0).otherwise(n).alias("rows")
    )
    return manifest.choose_manifest(found).select("path", "rows")


@query("""WITH s AS (SELECT DISTINCT (page_id%3) || '/f' || (page_id%90) || '.wav' AS name FROM pages), l AS (SELECT (page_id%4) || '/f' || (page_id%120) || '.wav' AS name, page_id AS row_ FROM pages),
ll AS (SELECT name, max(row_) AS row_ FROM l GROUP BY 1), sh AS (SELECT split_part(name, '/', 2) AS base, count(*) AS n, min(name) AS target FROM s GROUP BY 1),
k AS (SELECT ll.name AS was, row_, CASE WHEN s.name IS NOT NULL THEN s.name WHEN sh.n=1 THEN sh.target END AS target, s.name IS NOT NULL AS exact
  FROM ll LEFT JOIN s ON ll.name=s.name LEFT JOIN sh ON split_part(ll.name, '/', 2)=sh.base),
m AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY exact DESC, row_ DESC) AS n FROM k WHERE target IS NOT NULL)
SELECT target AS name, was, true AS matched FROM m WHERE n=1 UNION ALL SELECT was, was, false FROM k WHERE target IS NULL""")
def manifest_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    pages = table(spark, sf_dir, "pages")
    named = lambda a, b: F.concat((n % a).cast("string"), F.lit("/f"), (n % b).cast("string"), F.lit(".wav"))
    labels = pages.groupBy(named(4, 120).alias("name")).agg(F.max("page_id").alias("row"))
    return manifest.rekey(labels, pages.select(named(3, 90).alias("name")).distinct()).select("name", "was", "matched")


@query("""WITH t AS (SELECT event_type AS stage, sum(CAST(round(value*100) AS BIGINT)) AS cents FROM events GROUP BY 1), a AS (SELECT sum(n) AS audio FROM (SELECT count(*)*10.0e0 AS n FROM events GROUP BY user_id) x)
SELECT stage, round(cents/100.0e0, 6) AS total_s, round(cents/100.0e0/audio, 6) AS rtf FROM t, a""")
def stage_rtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordlens.operators import jobs

    events = table(spark, sf_dir, "events")
    sums = events.groupBy("user_id", "event_type").agg((F.sum(F.round(F.col("value") * 100).cast("long")) / 100.0).alias("s"), F.count("*").alias("n"))
    results = sums.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "s"))).alias("stage_times"), (F.sum("n") * 10.0).alias("audio_s"))
    return jobs.stage_totals(results).select("stage", F.round("total_s", 6).alias("total_s"), F.round("rtf", 6).alias("rtf"))


@query("""SELECT o_custkey AS job, count(*) FILTER (WHERE o_orderstatus<>'F') AS n_ok, count(*) FILTER (WHERE o_orderstatus='F') AS n_failed, count(*) AS n,
  round(sum(CAST(round(o_totalprice) AS BIGINT))/60.0e0, 6) AS audio_min, round(sum(o_orderkey%50)/sum(CAST(round(o_totalprice) AS BIGINT))::DOUBLE, 6) AS rtf FROM orders GROUP BY 1""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordlens.operators import jobs

    results = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("job"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("status"),
        F.round("o_totalprice").cast("long").alias("audio_s"), (F.col("o_orderkey") % 50).alias("elapsed_s"),
    )
    return jobs.batch_summary(results, "job").select("job", "n_ok", "n_failed", "n", F.round("audio_min", 6).alias("audio_min"), F.round("rtf", 6).alias("rtf"))


@query("""SELECT o_orderkey AS job_id, n, CASE WHEN n=1 THEN a WHEN n=2 THEN a || ' and ' || b ELSE a || ' and ' || (n-1) || ' others' END AS title FROM (
  SELECT o_orderkey, o_orderdate, o_orderkey%3+1 AS n, 'f' || o_custkey || '.wav' AS a, o_orderstatus || '.ogg' AS b FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 12) x""")
def job_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordlens.operators import jobs

    orders = table(spark, sf_dir, "orders").withColumns({"started": F.col("o_orderdate"), "job_id": F.col("o_orderkey"), "n": F.col("o_orderkey") % 3 + 1})
    names = F.array(F.concat(F.lit("f"), F.col("o_custkey").cast("string"), F.lit(".wav")), F.concat("o_orderstatus", F.lit(".ogg")), F.lit("c.wav"))
    listed = jobs.newest(orders, 12)  # the report's own limit
    return listed.select("job_id", "n", scalars.job_title(F.slice(names, 1, F.col("n").cast("int")), F.col("n")).alias("title"))


@query("""SELECT job_id, o_custkey FROM (SELECT o_orderkey AS job_id, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) x WHERE n>4""")
def job_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordlens.operators import jobs

    held = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), "o_custkey", F.col("o_orderdate").alias("started"))
    return jobs.evicted(held, "o_custkey", keep=4).select("job_id", "o_custkey")


@query("""SELECT l_suppkey AS archive, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)*1000) AS BIGINT) AS bytes,
  round(coalesce(max(CASE WHEN l_linenumber>1 THEN CAST(l_quantity AS BIGINT)*1000/(l_linenumber-1.0e0) END), 0.0e0), 6) AS max_ratio FROM lineitem GROUP BY 1""")
def upload_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordlens.operators import jobs

    members = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("archive"), (F.col("l_quantity").cast("long") * 1000).alias("size"), (F.col("l_linenumber") - 1).alias("packed"))
    return jobs.upload_totals(members).select("archive", "n", "bytes", F.round("max_ratio", 6).alias("max_ratio"))


# -- tuning -------------------------------------------------------------------------------------

_GRID = (6.0, 9.0, 12.0, 15.0, 18.0)
_TUNE_SQL = f"""
g AS (SELECT unnest([{', '.join(f'{v}e0' for v in _GRID)}]) AS candidate),
r AS (SELECT l_suppkey%13 AS grp, l_linenumber*3.0e0 AS silence, CASE WHEN l_quantity>25 THEN 'true' ELSE 'false' END AS truth FROM lineitem),
fo AS (SELECT grp, (row_number() OVER (ORDER BY grp)-1)%4 AS fold FROM (SELECT DISTINCT grp FROM r) d),
j AS (SELECT fo.fold, g.candidate, r.truth, CASE WHEN silence>=candidate THEN 'true' ELSE 'false' END AS pred FROM r JOIN fo ON r.grp=fo.grp CROSS JOIN g)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 13).alias("grp"), (F.col("l_linenumber") * 3.0).alias("silence"), F.when(F.col("l_quantity") > 25, "true").otherwise("false").alias("truth")
    )


def _decide(value):
    return F.when(F.col("silence") >= value, "true").otherwise("false")


@query(f"WITH {_TUNE_SQL}, f AS ({_f1_sql('j', 'candidate')}) SELECT candidate, round(macro_f1, 6) AS macro_f1 FROM f")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tune.grid_scores(_labelled(spark, sf_dir), list(_GRID), _decide).select("candidate", F.round("macro_f1", 6).alias("macro_f1"))


@query(f"WITH {_TUNE_SQL}, f AS ({_f1_sql('j', 'fold, candidate')}) SELECT candidate, round(avg(macro_f1), 6) AS mean_score, count(*) AS folds FROM f GROUP BY 1")
def grouped_mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    dealt = rows.join(tune.folds(rows, 4), "grp")
    found = tune.grouped_mean(tune.grid_scores(dealt, list(_GRID), _decide, "fold"))
    return found.select("candidate", F.round("mean_score", 6).alias("mean_score"), "folds")


@query(f"""WITH {_TUNE_SQL}, p AS (SELECT r.grp%3 AS part, 'silence' AS field, truth, CAST(len(list_filter([{', '.join(f'{v}e0' for v in _GRID)}], lambda g: g<=silence)) AS INT) AS bin FROM r
  UNION ALL SELECT l_orderkey%3, 'tax', l_returnflag, CASE WHEN l_linenumber=7 THEN -1 ELSE CAST(len(list_filter([0.02e0, 0.05e0], lambda g: g<=l_tax)) AS INT) END FROM lineitem)
SELECT part, field, truth, bin, count(*) AS n FROM p GROUP BY ALL""")
def threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one table that a descent over two fields' thresholds needs of all rows."""
    silence = _labelled(spark, sf_dir).select((F.col("grp") % 3).alias("part"), F.lit("silence").alias("field"), "truth", F.col("silence").alias("value"))
    tax = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 3).alias("part"), F.lit("tax").alias("field"), F.col("l_returnflag").alias("truth"), F.when(F.col("l_linenumber") != 7, F.col("l_tax")).alias("value"))
    return tune.binned_counts(silence.union(tax), {"silence": _GRID, "tax": (0.02, 0.05)}, "part")


# -- extension: sessions of events --------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events),
s AS (SELECT *, sum(CASE WHEN was IS NULL OR ts>=was+INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, min(ts) AS start_ts, count(*) AS n_events FROM s GROUP BY user_id, n""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordlens.streaming.sessions import sessions

    return sessions(table(spark, sf_dir, "events"), "12 hours").select("user_id", "start_ts", "n_events")

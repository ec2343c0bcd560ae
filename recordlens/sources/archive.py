"""ZIP archives: their members as rows, and the checks before any is unpacked."""

from __future__ import annotations

import csv
import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from recordlens.sources.manifest import LABEL_SCHEMA, choose_manifest, classify, display_names, is_junk, rekey, slashed, suffix

# Members, bytes and compression ratio that an archive may have.
MOST_MEMBERS, MOST_BYTES, MOST_RATIO = 2000, 2 << 30, 200.0

MEMBERS = "archive string, member string, size long, packed long, error string"


def members(files: DataFrame) -> DataFrame:
    """The members of archives files(path, content); one that is no archive gives a row with an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as held:
                        rows += [(path, i.filename, i.file_size, i.compress_size, None) for i in held.infolist() if not i.is_dir()]
                except (zipfile.BadZipFile, OSError, ValueError) as problem:
                    rows.append((path, None, 0, 0, str(problem)))
            yield pd.DataFrame(rows, columns=["archive", "member", "size", "packed", "error"])

    return files.select("path", "content").mapInPandas(run, MEMBERS)


def unsafe(member: Column) -> Column:
    """Whether a path leaves the folder that it is unpacked to."""
    return slashed(member).startswith("/") | F.array_contains(F.split(slashed(member), "/"), "..")


def verdicts(found: DataFrame) -> DataFrame:
    """(archive, problem): why an archive is refused, null if it is not. Junk members don't count."""
    own = found.where(F.col("error").isNull() & ~is_junk(F.coalesce("member", F.lit(""))))
    ratio = F.when(F.col("packed") > 0, F.col("size") / F.col("packed"))
    sums = own.groupBy("archive").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max(ratio).alias("ratio"), F.max(unsafe(F.col("member"))).alias("unsafe")
    )
    problem = (
        F.when(F.col("n") > MOST_MEMBERS, "too many members").when(F.col("bytes") > MOST_BYTES, "too large")
        .when(F.col("ratio") > MOST_RATIO, "implausible compression").when(F.col("unsafe"), "unsafe path")
    )
    broken = found.where(F.col("error").isNotNull()).select("archive", F.lit("not an archive").alias("problem"))
    return sums.select("archive", problem.alias("problem")).union(broken)


@udtf(returnType="member string, unpacked binary, problem string")
class Members:
    """The members of one archive with their content; one that can't be read has what went wrong instead."""

    def eval(self, content: bytes | None):  # noqa: ANN201
        try:
            held = zipfile.ZipFile(io.BytesIO(content or b""))
        except (zipfile.BadZipFile, OSError, ValueError) as problem:
            yield None, None, str(problem) or type(problem).__name__
            return
        with held:
            for info in held.infolist():
                if not info.is_dir():
                    try:
                        yield info.filename, held.read(info), None
                    except (zipfile.BadZipFile, OSError, ValueError, RuntimeError, NotImplementedError, EOFError, zlib.error) as problem:
                        yield info.filename, None, str(problem) or type(problem).__name__


def extract(files: DataFrame) -> DataFrame:
    """(archive, member, content, problem) of the members of archives that ``verdicts`` passes; junk is left out.

    The archives are judged first, by their directories alone; one that is refused isn't opened again. A
    member that is damaged has a problem and no content; the others of its archive are not affected.
    """
    passed = verdicts(members(files)).where(F.col("problem").isNull()).select(F.col("archive").alias("path"))
    opened = files.select("path", "content").join(passed, "path")
    found = opened.lateralJoin(Members(F.col("content").outer())).select(F.col("path").alias("archive"), "member", "unpacked", "problem").withColumnRenamed("unpacked", "content")
    return found.where(~is_junk(F.coalesce("member", F.lit(""))))


@udtf(returnType="row int, name string, result_json string")
class ManifestRows:
    """The rows of one CSV with the columns name and result_json, as they stand in the file; nothing of what is no such CSV."""

    def eval(self, content: bytes | None):  # noqa: ANN201
        try:
            rows = csv.DictReader(io.StringIO((content or b"").decode("utf-8-sig"), newline=""))
            if not {"name", "result_json"} <= set(rows.fieldnames or ()):
                return
            for n, row in enumerate(rows):
                yield n, (row["name"] or "").strip(), (row["result_json"] or "").strip()
        except (UnicodeDecodeError, csv.Error):
            return


def stage(files: DataFrame) -> DataFrame:
    """(path, kind, content, problem): one row for each file and archive member of uploaded files(path, content).

    Kinds are audio, manifest, junk and skipped; refused for an archive that may not be unpacked, broken for what
    can't be read. Members lie below their archive's path without its suffix. Nested archives are skipped.
    """
    zipped = suffix(F.col("path")) == "zip"
    plain = files.where(~zipped).select("path", classify(F.col("path")).alias("kind"), "content", F.lit(None).cast("string").alias("problem"))
    archives = files.where(zipped)
    judged = verdicts(members(archives)).where(F.col("problem").isNotNull())
    refused = judged.select(F.col("archive").alias("path"), F.when(F.col("problem") == "not an archive", "broken").otherwise("refused").alias("kind"), F.lit(None).cast("binary").alias("content"), "problem")
    inner = extract(archives).withColumn("path", F.concat(F.regexp_replace("archive", r"(?i)\.zip$", ""), F.lit("/"), slashed(F.col("member"))))
    unpacked = inner.select("path", F.when(F.col("problem").isNotNull(), "broken").otherwise(classify(F.col("path"))).alias("kind"), "content", "problem")
    return plain.unionByName(unpacked).unionByName(refused)


def staged_names(staged: DataFrame) -> DataFrame:
    """(path, label) of the staged recordings, as they are shown."""
    return display_names(staged.where("kind = 'audio'").select("path")).select("path", "label")


def staged_labels(staged: DataFrame) -> DataFrame:
    """(name, truth) of the first staged manifest, by depth and path, that has a valid row, under the names that are shown.

    Rows without a name or with broken JSON are skipped; of equal names the last counts.
    """
    rows = staged.where("kind = 'manifest'").select("path", "content").lateralJoin(ManifestRows(F.col("content").outer())).select("path", "row", "name", "result_json")
    parsed = rows.withColumn("truth", F.from_json("result_json", LABEL_SCHEMA + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    whole = parsed.where((F.col("name") != "") & (F.col("result_json") != "") & F.col("truth._corrupt").isNull())
    chosen = choose_manifest(whole.groupBy("path").agg(F.count("*").alias("rows"))).select("path")
    own = whole.join(chosen, "path", "left_semi").groupBy("name").agg(F.max("row").alias("row"), F.max_by(F.col("truth").dropFields("_corrupt"), "row").alias("truth"))
    named = rekey(own.select("name", "row"), staged_names(staged).select(F.col("label").alias("name")))
    return named.join(own.select(F.col("name").alias("was"), "truth"), "was").select("name", "truth")

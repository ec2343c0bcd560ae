"""One ordered text file from a sorted relation: tasks write parts, the commit joins them and moves the whole into place."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import RecordBatch, fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from recordlens.sources.pcm import opened

#: Bytes that the commit copies at a time.
COPY = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    """A task's part: its place in the order, its path, and how many rows it holds."""

    order: int
    path: str
    rows: int


class SingleWriter(DataSourceArrowWriter):
    """Parts are written beside the file; nothing is at its place until all tasks have ended well."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.place, self.overwrite = options["path"], overwrite
        self.head, self.tail, self.between = (options.get(k, "") for k in ("head", "tail", "between"))
        self.run = options["run"]

    def _parts(self, root: str) -> str:
        return f"{root.rstrip('/')}.parts-{self.run}"

    def write(self, iterator: Iterator[RecordBatch]) -> Part:
        system, root = opened(self.place)
        task = TaskContext.get()
        system.create_dir(self._parts(root), recursive=True)
        path, rows = f"{self._parts(root)}/{task.partitionId():06d}-{task.taskAttemptId()}", 0
        with system.open_output_stream(path) as out:
            for batch in iterator:
                for value in batch["value"].to_pylist():
                    out.write(((self.between if rows else "") + (value or "")).encode())
                    rows += 1
        return Part(task.partitionId(), path, rows)

    def commit(self, messages: list[Part | None]) -> None:
        system, root = opened(self.place)
        if not self.overwrite and system.get_file_info(root).type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.place)
        whole, any_ = f"{self._parts(root)}/whole", False
        system.create_dir(self._parts(root), recursive=True)
        with system.open_output_stream(whole) as out:
            out.write(self.head.encode())
            for part in sorted((m for m in messages if m and m.rows), key=lambda m: m.order):
                if any_:
                    out.write(self.between.encode())
                any_ = True
                with system.open_input_stream(part.path) as held:
                    while chunk := held.read(COPY):
                        out.write(chunk)
            out.write(self.tail.encode())
        if system.get_file_info(root).type == fs.FileType.Directory:
            system.delete_dir(root)
        system.move(whole, root)
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        system, root = opened(self.place)
        if system.get_file_info(self._parts(root)).type == fs.FileType.Directory:
            system.delete_dir(self._parts(root))


class SingleText(DataSource):
    """``df.write.format("single_text")``: the column ``value`` in the order of the relation, in one file.

    Options: ``head``, ``tail``, and ``between`` rows; ``run``, a name of its own for each write.
    """

    @classmethod
    def name(cls) -> str:
        return "single_text"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> SingleWriter:  # noqa: ANN001
        return SingleWriter(dict(self.options), overwrite)


def write_single(ordered: DataFrame, path: str, run: str, head: str = "", tail: str = "", between: str = "\n") -> None:
    """Writes ordered(value) to one file in place of what is there; an error leaves what was there."""
    spark = ordered.sparkSession
    spark.dataSource.register(SingleText)
    options = {"head": head, "tail": tail, "between": between, "run": run}
    ordered.select("value").write.format("single_text").options(**options).mode("overwrite").save(path)

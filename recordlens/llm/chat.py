"""Chat formatting: typed content parts flattened by a visitor into a reversible template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import ceil, isfinite

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlens.llm.common import table

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER = "<|part|>"
#: Tokens that a part expands to: image patches of this many pixels a side, audio frames a second, tokens a page.
PATCH, FRAMES, PAGE = 28, 25, 512

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<part:int,kind:string,ref:string,at:int,tokens:bigint>"
_MOST = 2**63 - 1
TURN = f"role string, body string, loss array<struct<at:int,length:int>>, attachments array<{ATTACHMENT}>"


def escape(text: str) -> str:
    """Text in which no control string can begin: ``<|`` gets a backslash, ``<\\|`` one more."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


class PartVisitor:
    """Flattens the parts of one turn, in order, into text, placeholders and attachment records.

    Neighbouring text parts are one run of text, escaped as a whole, so no control string can form
    across their border. Counts that are missing, negative or not finite are zero.
    """

    def __init__(self) -> None:
        self.body: list[str] = []
        self.length = 0
        self.run: list[str] = []
        self.spans: list[dict] = []
        self.attachments: list[dict] = []

    def visit(self, order: int, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part['kind']}", self.visit_other)(order, part)

    def _write(self, piece: str) -> None:
        self.body.append(piece)
        self.length += len(piece)

    def end_text(self) -> None:
        """Writes the run of text parts so far, with its span."""
        if self.run:
            piece = escape("".join(self.run))
            self.spans.append({"at": self.length, "length": len(piece)})
            self._write(piece)
            self.run = []

    def visit_text(self, order: int, part: dict) -> None:
        self.run.append(part["text"] or "")

    def _attach(self, order: int, part: dict, tokens: int) -> None:
        self.end_text()
        self.attachments.append({"part": order, "kind": part["kind"], "ref": part["ref"], "at": self.length, "tokens": min(tokens, _MOST)})
        self._write(PLACEHOLDER.get(part["kind"], OTHER))

    def visit_image(self, order: int, part: dict) -> None:
        across, down = (ceil(max(0, part[side] or 0) / PATCH) for side in ("width", "height"))
        self._attach(order, part, across * down)

    def visit_audio(self, order: int, part: dict) -> None:
        frames = (part["seconds"] or 0.0) * FRAMES
        self._attach(order, part, ceil(max(0.0, frames)) if isfinite(frames) else 0)

    def visit_document(self, order: int, part: dict) -> None:
        self._attach(order, part, max(0, part["pages"] or 0) * PAGE)

    def visit_other(self, order: int, part: dict) -> None:
        self._attach(order, part, 1)


def flatten(parts: list[dict] | None) -> PartVisitor:
    visitor = PartVisitor()
    for order, part in enumerate(parts or []):
        visitor.visit(order, part)
    visitor.end_text()
    return visitor


def _flatten_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    attachment = pa.struct([("part", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())])
    span = pa.struct([("at", pa.int32()), ("length", pa.int32())])
    for batch in batches:
        seen = [flatten(parts) for parts in batch["parts"].to_pylist()]
        roles = batch["role"].to_pylist()
        yield pa.record_batch(
            [
                batch["conv_id"], batch["turn"],
                pa.array([escape(r or "").replace("\n", BREAK) for r in roles], pa.string()),
                pa.array(["".join(v.body) for v in seen], pa.string()),
                pa.array([v.spans if r == "assistant" else [] for v, r in zip(seen, roles)], pa.list_(span)),
                pa.array([v.attachments for v in seen], pa.list_(attachment)),
            ],
            ["conv_id", "turn", "role", "body", "loss", "attachments"],
        )


def _content(turns: DataFrame) -> Column:
    """The parts of each turn with all fields of PART, those that ``turns`` doesn't have as null.

    Without a column ``parts`` the column ``text`` is the one part.
    """
    fields = [field.split(":") for field in PART.removeprefix("struct<").removesuffix(">").split(",")]
    if "parts" not in turns.columns:
        own = {"kind": F.lit("text"), "text": F.col("text")}
        return F.array(F.struct(*[own.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields]))
    given = {name.lower() for name in turns.schema["parts"].dataType.elementType.names}

    def widened(part: Column) -> Column:
        whole = F.struct(*[(part[name] if name in given else F.lit(None)).cast(kind).alias(name) for name, kind in fields])
        return F.when(part.isNotNull(), whole)

    return F.transform("parts", widened)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation of turns(conv_id, turn, role, and text or parts).

    Returns ``conv_id, formatted, loss, attachments, n_turns``. ``formatted`` is
    ``<|im_start|>role\\nbody<|im_end|>\\n`` for each turn in order; ``loss`` holds the code-point
    spans of assistant text; ``attachments`` has, in order, turn, part, kind, reference, place
    and expanded tokens of every image, audio or document part (other kinds get one token).
    A part's struct may lack any field but ``kind`` or hold others. Control strings in texts and
    roles are escaped, also those that form across neighbouring text parts, so that ``read_back``
    restores each turn; neighbouring text parts share a span. Turns of one number are ordered by role, then body; null turns come first; a null
    conv_id is a conversation of its own; null roles and texts are empty; other columns are
    ignored; no rows give no rows. A conversation is one string, so its size is that of the
    output; everything before is done turn by turn.
    """
    ids = {name: turns.schema[name].dataType.simpleString() for name in ("conv_id", "turn")}
    flat = turns.select("conv_id", "turn", "role", _content(turns).alias("parts")).mapInArrow(
        _flatten_turns, f"conv_id {ids['conv_id']}, turn {ids['turn']}, {TURN}"
    )
    # the place where a turn starts is a running sum, so a long conversation costs no more a turn than a short one
    earlier = Window.partitionBy("conv_id").orderBy("turn", "role", "body", "loss", "attachments").rowsBetween(Window.unboundedPreceding, -1)
    head, tail = F.concat(F.lit(START), F.col("role"), F.lit("\n")), F.concat(F.col("body"), F.lit(END + "\n"))
    size = F.length("role") + F.length("body") + len(START) + len(END) + 2
    placed = flat.withColumn("start", F.coalesce(F.sum(size).over(earlier), F.lit(0)).cast("int"))
    base = F.col("start") + F.length(head)
    written = placed.select(
        "conv_id", "start", F.concat(head, tail).alias("written"),
        F.transform("loss", lambda s: F.struct((s["at"] + base).alias("at"), s["length"].alias("length"))).alias("loss"),
        F.transform("attachments", lambda a: F.struct(a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), (a["at"] + base).alias("at"), a["tokens"].alias("tokens"))).alias("attachments"),
    )
    gathered = written.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "written", "loss", "attachments"))).alias("turns"))
    return gathered.select(
        "conv_id",
        F.array_join("turns.written", "").alias("formatted"),
        F.flatten("turns.loss").alias("loss"),
        F.flatten(F.transform("turns", lambda t, k: F.transform(t["attachments"], lambda a: F.struct(k.alias("turn"), *[a[n].alias(n) for n in ("part", "kind", "ref", "at", "tokens")])))).alias("attachments"),
        F.size("turns").alias("n_turns"),
    )


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation; placeholders stay as they are."""
    turns = []
    for piece in formatted.split(START)[1:]:
        role, _, body = piece.partition("\n")
        turns.append((unescape(role.replace(BREAK, "\n")), unescape(body[: body.rindex(END)])))
    return turns


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for formatted, loss in zip(batch["formatted"].to_pylist(), batch["loss"].to_pylist()):
            turns = read_back(formatted)
            masked = "".join(unescape(formatted[s["at"] : s["at"] + s["length"]]) for s in loss)
            rows.append((
                len(turns),
                hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest(),
                len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(formatted),
            ))
        names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.record_batch([batch["conv_id"], *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["conv_id", *names])


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    done = format_conversations(turns).select("conv_id", "formatted", "loss")
    return done.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

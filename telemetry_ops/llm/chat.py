"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor walks them in order;
text is escaped, and every other part becomes a placeholder ``<|kind:number|>``, its reference
and the tokens it expands to being recorded. Turns look like ``<|im_start|>role\\ncontent<|im_end|>\\n``.

Conversations are streamed: rows arrive in order of conversation and turn, and each turn leaves as a
row of its own, so that memory does not grow with the length of a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetry_ops.llm.text import slices, small_batches

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_CONTROL = re.compile(r"\\|<(?=\||/?s>|</?SYS>>|/?SYS>>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")

#: Tokens per unit of an attachment: image tile, second of sound, document page.
TOKENS = {"image": 256, "audio": 25, "document": 640}

PART = "struct<kind: string, text: string, ref: string, units: long>"
PIECES = (
    "conv_id long, position long, role string, piece string, begin long, loss_begin long, loss_end long, "
    "attachments array<struct<number: long, kind: string, ref: string, tokens: long>>"
)
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, n_attachments long, attachment_tokens long"
)


def escape(text: str) -> str:
    """Break control strings by a backslash behind their first character; double other backslashes."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(n|\\?)", lambda m: "\n" if m[1] == "n" else m[1], role)


class Flatten:
    """Visitor over the parts of one conversation; attachments are numbered through all its turns."""

    def __init__(self):
        self.count = 0
        self.found: list[dict] = []

    def content(self, parts: list[dict]) -> str:
        self.found = []
        return "".join(getattr(self, f"visit_{p['kind'] or 'text'}", self.visit_unknown)(p) for p in parts)

    def visit_text(self, part: dict) -> str:
        return escape(part["text"] or "")

    def visit_image(self, part: dict) -> str:
        return self._attach(part)

    def visit_audio(self, part: dict) -> str:
        return self._attach(part)

    def visit_document(self, part: dict) -> str:
        return self._attach(part)

    def visit_unknown(self, part: dict) -> str:
        raise ValueError(f"Unknown kind of content part: {part['kind']}")

    def _attach(self, part: dict) -> str:
        self.count += 1
        tokens = TOKENS[part["kind"]] * (1 if part["units"] is None else part["units"])
        self.found.append({"number": self.count, "kind": part["kind"], "ref": part["ref"], "tokens": tokens})
        return f"<|{part['kind']}:{self.count}|>"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, fresh = None, True
    schema = None
    for batch in batches:
        for piece in slices(batch, "sized"):
            rows = []
            for r in piece.to_pylist():
                if fresh or r["conv_id"] != current:
                    current, fresh, position, at, visitor = r["conv_id"], False, 0, 0, Flatten()
                head = OPEN + escape_role(r["role"] or "") + "\n"
                body = visitor.content(r["parts"] or [])
                whole = head + body + CLOSE
                loss = (at + len(head), at + len(head) + len(body)) if r["role"] == "assistant" else (None, None)
                rows.append(
                    {
                        "conv_id": current, "position": position, "role": r["role"], "piece": whole, "begin": at,
                        "loss_begin": loss[0], "loss_end": loss[1], "attachments": visitor.found,
                    }
                )
                position, at = position + 1, at + len(whole)
            schema = schema or _schema()
            yield pa.RecordBatch.from_pylist(rows, schema)


def _schema() -> pa.Schema:
    one = pa.struct([("number", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
    names = ("conv_id", "position", "role", "piece", "begin", "loss_begin", "loss_end", "attachments")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(one))
    return pa.schema(list(zip(names, kinds)))


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role`` with ``parts`` (array of ``PART``) or ``text`` to rows ``PIECES``.

    Concatenated by ``position``, a conversation's pieces are its formatted text; ``begin``,
    ``loss_begin`` and ``loss_end`` are code points in it, the loss being on what an assistant says. Turns
    are ordered by turn (null last), then role and content. A null text, role or list of parts is empty;
    rows with a null ``conv_id`` are one conversation. Rows of a conversation stay together, in order.
    """
    one = F.struct(F.lit("text").alias("kind"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))
    parts = F.col("parts").cast(f"array<{PART}>") if "parts" in turns.columns else F.array(one)
    rows = small_batches(turns).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", parts.alias("parts"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", "parts")
    sized = F.concat_ws("", F.transform("parts", lambda p: p.getField("text"))).cast("binary")
    return rows.select("conv_id", "role", "parts", sized.alias("sized")).mapInArrow(_format, PIECES)


def read_piece(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn; attachments leave no text."""
    m = _TURN.fullmatch(piece)
    if not m:
        raise ValueError("Not a formatted turn")
    return unescape_role(m[1]), unescape(_PLACEHOLDER.sub("", m[2]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, names = None, [f.split()[0] for f in DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def closed(s):
        return (s["id"], s["n"], s["all"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["size"], s["files"], s["tokens"])

    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if r["position"] == 0:
                if state:
                    done.append(closed(state))
                state = {"id": r["conv_id"], "n": 0, "chars": 0, "size": 0, "files": 0, "tokens": 0, "all": hashlib.sha256(), "loss": hashlib.sha256()}
            role, text = read_piece(r["piece"])
            state["n"] += 1
            state["all"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            state["size"] += len(r["piece"])
            state["files"] += len(r["attachments"])
            state["tokens"] += sum(a["tokens"] for a in r["attachments"])
            if r["loss_begin"] is not None:
                masked = r["piece"][r["loss_begin"] - r["begin"] : r["loss_end"] - r["begin"]]
                masked = unescape(_PLACEHOLDER.sub("", masked))
                state["chars"] += len(masked)
                state["loss"].update(masked.encode("utf-8", "surrogatepass"))
        if done:
            yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*done), kinds)], names)
    if state:
        yield pa.record_batch([pa.array([v], k) for v, k in zip(closed(state), kinds)], names)


def chat_digests(pieces: DataFrame) -> DataFrame:
    """What is read back from ``format_chats``, per conversation, in ``DIGEST``. Takes its output as it is."""
    return pieces.mapInArrow(_digest, DIGEST)

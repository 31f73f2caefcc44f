"""Chat formatting by assembling token ids: segments are encoded apart, reserved ids spliced between.

Control strings inside texts are escaped: after a ``<`` that backslashes and a
``|`` follow, one more backslash is put in, and taken out again on reading.  So
no text can hold a control string, and each text comes back as it was.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import slices

#: Rows whose tokens a task holds as Python objects.
SLICE = 256

START, END = "<|im_start|>", "<|im_end|>"
#: Ids that follow the tokenizer's own 50,257.
START_ID, END_ID = 50257, 50258
TRAINED_ROLE = "assistant"

_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"<\\{m[1]}|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: f"<{m[1]}|", text)


def escape_role(role: str) -> str:
    """A role stands on one line: its backslashes and line ends are escaped before its control strings."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Segments:
    """Encodes and decodes segments; reserved ids never come from a text."""

    _open: dict[str, Segments] = {}

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    @classmethod
    def open(cls, path: str) -> Segments:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


def format_turns(turns: DataFrame, *, path: str | None = None) -> DataFrame:
    """One row per turn: ``conv_id, turn, place, ids, loss_mask``; joined by place they are the conversation.

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Each row is encoded where
    it lies; only then are conversations brought together, and their places
    counted in a stream, so that a conversation of any length takes no memory.
    Rows with equal turns are ordered by role and text; a null role or text is
    empty, a null conv_id is a conversation of its own.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    spark = turns.sparkSession
    source = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv, turn = (source.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def run(batches):
        segments = Segments.open(path)
        newline = segments.encode(["\n"])[0]
        for batch in slices(batches, SLICE):
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            heads = segments.encode([escape_role(role) + "\n" for role in roles])
            bodies = segments.encode([escape(text) for text in texts])
            ids, masks = [], []
            for role, head, body in zip(roles, heads, bodies, strict=True):
                parts = ([START_ID], head, body, [END_ID], newline)
                ends = np.cumsum([0, *map(len, parts)])
                ids.append(np.concatenate([np.array(part, np.int32) for part in parts]))
                # The mask is the prefix sum of +1 where the trained text begins and -1 where it ends.
                steps = np.zeros(ends[-1] + 1, np.int8)
                if role == TRAINED_ROLE:
                    steps[ends[2]] += 1
                    steps[ends[3]] -= 1
                masks.append(np.cumsum(steps[:-1], dtype=np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.binary())], names=["conv_id", "turn", "role", "text", "ids", "loss_mask"])

    encoded = source.mapInArrow(run, f"conv_id {conv}, turn {turn}, role string, text string, ids array<int>, loss_mask binary")
    together = encoded.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("role", "text")

    def place(batches):
        last, count = object(), 0
        for batch in batches:
            places = []
            for conv_id in batch.column(0).to_pylist():
                count = count + 1 if conv_id == last else 0
                last = conv_id
                places.append(count)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(places, pa.int64()), *batch.columns[2:]], names=["conv_id", "turn", "place", "ids", "loss_mask"])

    return together.mapInArrow(place, f"conv_id {conv}, turn {turn}, place bigint, ids array<int>, loss_mask binary")


def read_back(formatted: DataFrame, *, path: str | None = None) -> DataFrame:
    """Parses formatted conversations from their ids alone: counts and digests for each.

    Takes format_turns' rows in any order and partitioning, brings each
    conversation's together by place, and keeps only running digests.
    """
    parts = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    formatted = formatted.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "place")
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    conv = formatted.schema["conv_id"].dataType
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    class Reading:
        def __init__(self):
            self.turns, self.loss_chars, self.chars = 0, 0, 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()

        def row(self, conv_id):
            return conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        decode = Segments.open(path).decode
        kinds = [to_arrow_type(conv), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, last = None, None
        for batch in slices(batches, SLICE):
            rows = []
            for conv_id, place, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("place").to_pylist(), batch.column("ids").to_pylist(), batch.column("loss_mask").to_pylist(), strict=True):
                if place == 0:
                    if now is not None:
                        rows.append(now.row(last))
                    now, last = Reading(), conv_id
                inner = ids[1 : ids.index(END_ID)]
                content, tail = decode(inner), decode(ids[len(inner) + 2 :])
                role, _, text = content.partition("\n")
                masked = unescape(decode([x for x, m in zip(ids, mask, strict=True) if m]))
                now.turns += 1
                now.chars += len(START) + len(content) + len(END) + len(tail)
                now.all.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                now.loss.update(masked.encode())
                now.loss_chars += len(masked)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(now.row(last), kinds, strict=True)], names=names)

    return formatted.mapInArrow(run, f"conv_id {conv.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")

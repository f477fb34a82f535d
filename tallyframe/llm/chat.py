"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once with offsets; the spans of its assistant texts and the spans of its
tokens are both sorted, so each text's tokens are found by binary search and the mask is the intersection. Turns are
marked by the control strings below. Inside a text, a control string gets a backslash in front of it, and the
backslashes that were there, or that end the text, are doubled; reading the rendered string undoes that exactly.

Rows are ordered by turn, then role and text; a null turn comes first, a null text or role is an empty one. Roles other
than the three named keep their name in the marker. Rows with a null conversation id form one conversation. Repeated
rows are turns of their own. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import map_batches, written
from tallyframe.llm.tokens import tokenizer

VOCABULARY = "byte_bpe_50k.json"
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER_OPEN, OTHER_MIDDLE, OTHER_CLOSE = "<role:", ">", "</role>"
CONTROLS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", OTHER_OPEN, OTHER_CLOSE]
_CONTROL = "|".join(re.escape(c) for c in CONTROLS)
_TO_ESCAPE = re.compile(rf"(\\*)({_CONTROL}|\Z)", re.S)
_ESCAPED = re.compile(rf"(\\+)({_CONTROL}|\Z)", re.S)


def escape(text: str) -> str:
    """Every run of backslashes before a control string or the end is doubled; control strings get one more."""
    return _TO_ESCAPE.sub(lambda m: m[1] * 2 + ("\\" + m[2] if m[2] else ""), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace(">", "\\>").replace("<", "\\<").replace("[", "\\[")


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans of the assistant texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        opening, closing = MARKS.get(role) or (f"{OTHER_OPEN}{escape_role(role)}{OTHER_MIDDLE}", OTHER_CLOSE)
        inner = escape(text)
        at += len(opening)
        if role == "assistant":
            spans.append((at, at + len(inner)))
        parts += [opening, inner, closing]
        at += len(inner) + len(closing)
    return "".join(parts), spans


_ROLE = re.compile(r"((?:\\.|[^\\>])*)>", re.S)


@cache
def _closing(mark: str) -> re.Pattern:
    return re.compile(rf"(?<!\\)(?:\\\\)*{re.escape(mark)}", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted string, exactly as they were rendered."""
    turns, at = [], 0
    while at < len(formatted):
        for role, (opening, closing) in MARKS.items():
            if formatted.startswith(opening, at):
                at += len(opening)
                break
        else:
            named = _ROLE.match(formatted, at + len(OTHER_OPEN))
            if not formatted.startswith(OTHER_OPEN, at) or named is None:
                raise ValueError(f"no turn at {at}")
            role, closing, at = re.sub(r"\\(.)", r"\1", named[1], flags=re.S), OTHER_CLOSE, named.end()
        found = _closing(closing).search(formatted, at)
        if found is None:
            raise ValueError(f"turn at {at} does not end")
        end = found.end() - len(closing)
        turns.append((role, unescape(formatted[at:end])))
        at = end + len(closing)
    return turns


def masked_spans(spans: list[tuple[int, int]], offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens touch an assistant text, and the characters that those tokens and the texts share.

    ``offsets`` are the tokens' sorted character spans; several tokens may share a character.
    """
    mask = np.zeros(len(offsets), bool)
    out = []
    for start, end in spans:
        if end <= start or not len(offsets):
            continue
        first = int(np.searchsorted(offsets[:, 1], start, side="right"))
        last = int(np.searchsorted(offsets[:, 0], end, side="left"))
        mask[first:last] = True
        if last > first:
            out.append((max(start, int(offsets[first, 0])), min(end, int(offsets[last - 1, 1]))))
    return mask, out


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): one row per conversation with its ordered turns. The unit of work is one conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_chats(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(conv_id, formatted, ids, loss_mask, loss_starts, loss_ends): one row per conversation.

    ``loss_mask`` has a flag for each token; the spans are in characters of ``formatted``.
    """

    def make():
        encoder = tokenizer(vocabulary)
        encoder.encode_special_tokens = True  # their strings in a text are ordinary text

        def work(batch):
            keys = batch.column(0)
            for begin in range(0, batch.num_rows, 128):
                rendered = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column(1).slice(begin, 128).to_pylist()]
                ids, masks, starts, ends = [], [], [], []
                for (_, spans), found in zip(rendered, encoder.encode_batch([r for r, _ in rendered], add_special_tokens=False), strict=True):
                    mask, shared = masked_spans(spans, np.array(found.offsets, dtype=np.int64).reshape(-1, 2))
                    ids.append(found.ids)
                    masks.append(mask.tolist())
                    starts.append([a for a, _ in shared])
                    ends.append([b for _, b in shared])
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(begin, 128), pa.array([r for r, _ in rendered]), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_())), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))],
                    ["conv_id", "formatted", "ids", "loss_mask", "loss_starts", "loss_ends"],
                )

        return work

    kind = rows.schema["conv_id"].dataType.simpleString()
    return map_batches(conversations(rows), make, f"conv_id {kind}, formatted string, ids array<int>, loss_mask array<boolean>, loss_starts array<int>, loss_ends array<int>")


def read_chats(chats: DataFrame) -> DataFrame:
    """What formatted chats hold: turns and the text under the loss mask, as digests."""

    def make():
        def work(batch):
            keys, formatted, starts, ends = (batch.column(i) for i in range(4))
            n_turns, turn_sums, loss_chars, loss_sums, sizes = [], [], [], [], []
            for text, a, b in zip(formatted.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
                turns = parse(text)
                digest = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode("utf-8", "surrogatepass"))
                loss = "".join(unescape(text[i:j]) for i, j in zip(a, b, strict=True))
                n_turns.append(len(turns))
                turn_sums.append(digest.hexdigest())
                loss_chars.append(len(loss))
                loss_sums.append(hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest())
                sizes.append(len(text))
            return pa.RecordBatch.from_arrays(
                [keys, pa.array(n_turns, pa.int64()), pa.array(turn_sums, pa.string()), pa.array(loss_chars, pa.int64()), pa.array(loss_sums, pa.string()), pa.array(sizes, pa.int64())],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        return work

    kind = chats.schema["conv_id"].dataType.simpleString()
    return map_batches(chats.select("conv_id", "formatted", "loss_starts", "loss_ends"), make, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def with_probe(rows: DataFrame) -> DataFrame:
    """The conversations and one more, whose texts are control strings."""
    spark = rows.sparkSession
    said = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"select * from values (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


def stored_digests(rows: DataFrame) -> DataFrame:
    return read_chats(written(format_chats(with_probe(rows)), "chats"))

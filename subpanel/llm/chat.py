"""Chat formatting at token level: segments are encoded apart, reserved ids spliced in, masks come from prefix sums."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subpanel.llm.common import map_arrow, prepare, small_batches

#: Control strings of the template, in the order of their reserved ids after the vocabulary's.
START, SEP, END = CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
_RAW, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURNS = "conv_id long, turn long, role string, formatted string, ids binary, n_tokens long, text_from long, text_to long"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def escape(text: str) -> str:
    """No `<|` is left: `<`, any backslashes and `|` get one backslash more."""
    return _RAW.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # names of special tokens inside texts are ordinary text
    return tokenizer


def format_turns(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """One row per turn: conv_id, turn, role, formatted text, token ids and places, in order of the conversation.

    A turn is START role SEP text END; role and text are escaped and encoded apart, so no control id can come from
    content. `ids` are little-endian unsigned 32-bit; `text_from` and `text_to` bound the text's tokens in the turn;
    `start` is the turn's first token in its conversation, and `loss_from` to `loss_to` the tokens under the loss mask
    there (assistant texts; equal for other roles). Turns go by turn number (nulls first), ties by formatted text;
    repeated rows are repeated turns. Null roles and texts are empty; rows without conv_id form one conversation.
    A conversation is never held at once: places are running sums over its sorted rows. No rows give no rows.
    """
    prepare(conversations.sparkSession)
    path = path or default_tokenizer()
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.string()),
                        ("ids", pa.binary()), ("n_tokens", pa.int64()), ("text_from", pa.int64()), ("text_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        first = tokenizer.get_vocab_size(with_added_tokens=True)
        start, sep, end = (np.asarray([first + i], "<u4") for i in range(3))
        for batch in small_batches(batches):
            if not batch.num_rows:
                continue
            conv, turn, roles, texts = (batch.column(i).to_pylist() for i in range(4))
            segments = [escape(s or "") for s in (*roles, *texts)]
            coded = [np.asarray(e.ids, "<u4") for e in tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
            n = len(conv)
            role_ids, text_ids = coded[:n], coded[n:]
            sizes = np.array([[1, len(r), 1, len(t), 1] for r, t in zip(role_ids, text_ids)])
            ends = np.cumsum(sizes, axis=1)
            ids = [np.concatenate([start, r, sep, t, end]).tobytes() for r, t in zip(role_ids, text_ids)]
            formatted = [f"{START}{r}{SEP}{t}{END}" for r, t in zip(segments[:n], segments[n:])]
            values = (conv, turn, roles, formatted, ids, ends[:, 4].tolist(), ends[:, 2].tolist(), ends[:, 3].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(values, schema)], schema=schema)

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    turns = map_arrow(rows, run, TURNS)
    order = [F.asc_nulls_first("turn"), F.asc("formatted")]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    loss = F.col("role").eqNullSafe("assistant")
    return placed.withColumns({"loss_from": F.col("start") + F.col("text_from"),
                               "loss_to": F.col("start") + F.when(loss, F.col("text_to")).otherwise(F.col("text_from"))})


def read_back(turns: DataFrame, path: str | None = None) -> DataFrame:
    """Per conversation, from token ids and masks alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows stream by in the order of the conversation; only the digests' states are held.
    """
    prepare(turns.sparkSession)
    path = path or default_tokenizer()
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        first = tokenizer.get_vocab_size(with_added_tokens=True)
        read = lambda ids: tokenizer.decode(ids.tolist(), skip_special_tokens=False) if len(ids) else ""
        now, state, done = None, None, []

        def close():
            if state is not None:
                done.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done), schema)], schema=schema)
            done.clear()
            return out

        for batch in small_batches(batches):
            for conv, ids, start, a, b in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if now != (conv,):
                    close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                tokens = np.frombuffer(ids, "<u4")
                marks = np.flatnonzero(tokens >= first)
                role, text = (read(tokens[i + 1:j]) for i, j in zip(marks[:-1], marks[1:]))
                learnt = unescape(read(tokens[a - start:b - start]))
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "replace"))
                state[2] += len(learnt)
                state[3].update(learnt.encode("utf-8", "replace"))
                state[4] += len(role) + len(text) + sum(map(len, CONTROLS))
            if len(done) > 5000:
                yield emit()
        close()
        if done:
            yield emit()

    sorted_turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "formatted").select(
        "conv_id", "ids", "start", "loss_from", "loss_to")
    return map_arrow(sorted_turns, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

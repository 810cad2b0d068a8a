"""Mixture-controlled packing: deficit round-robin over source queues, in closed form over prefix sums.

The queue of a source is all its documents' tokens in stored order. Of W rounds (one window of tokens each), round w
serves queue k from token floor(w*T_k/W) to floor((w+1)*T_k/W): its quantum plus the deficit carried from the round
before, so a queue is never more than one token off its share, across windows and partitions alike. The place of a
token in the whole stream then follows from the queues' totals alone, and every partition places its documents by itself.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subpanel.llm.common import give_back, map_arrow, small_batches, written
from subpanel.session import setting

LENGTH = 2048
END_ID = 1
MAX_QUEUES = 1024
MAX_BROADCAST_ROWS = 200_000
#: Documents that an executor sends to a worker at a time, and bytes of text that are encoded together.
BATCH_ROWS = 1000
BATCH_BYTES = 2_000_000
#: Runs of these after a word are a token run of their own.
STOPS = b".,;:!?*#%$&()[]{}-_/+=~^@"


def _byte_signs() -> dict[int, int]:
    """Signs that byte-level vocabularies use for bytes: printable ones stand for themselves, the others follow U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in plain)}


BYTE_SIGNS = _byte_signs()
TOKENS = "part int, queue string, before long, doc_id long, n long, ids binary"
PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Pieces(dict[bytes, bytes]):
    """Ids of pieces between ASCII white space, as little-endian unsigned 32-bit values, worked out when first asked for.

    Of a word, case does not matter and a tail of stops is a token run of its own. `older` holds what was known before.
    """

    def __init__(self, tokenizer, older: dict[bytes, bytes]):
        super().__init__({b"": b""})
        self.tokenizer, self.tokenize, self.older = tokenizer, tokenizer.model.tokenize, older

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.older.get(piece)
        self[piece] = ids = self.ids_of(piece) if ids is None else ids
        return ids

    def ids_of(self, piece: bytes) -> bytes:
        core = piece.rstrip(STOPS)
        # A word of plain letters passes normaliser and splitter unchanged: its merges are all that is left.
        if core.isalpha():  # of bytes: ASCII letters
            low = core.lower()
        else:
            word = core.decode().lower()
            if not word.isalpha() or max(word) >= "\u0250":
                ids = self.tokenizer.encode_batch_fast([piece.decode()], add_special_tokens=False)[0].ids
                return pack_ids(f"<{len(ids)}I", *ids)
            low = word.encode()
        if low != piece:
            return self[low] + self[piece[len(core):]]
        signs = low.decode() if low.isascii() else low.decode("latin-1").translate(BYTE_SIGNS)
        ids = [t.id for t in self.tokenize(signs)]
        return pack_ids(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit values, remembering pieces between ASCII white space.

    Normaliser, splitter and merges of the tokenizer never look across white space, so a text's ids are those of its
    pieces in order. About `remember` recent pieces are kept, and as many of the time before.
    """

    def __init__(self, path: str, remember: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.remember = Tokenizer.from_file(path), remember
        self.known = Pieces(self.tokenizer, {})

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([(text or "").encode("utf-8", "replace")], pa.string()))[0].as_py()

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """Ids of each text, of a null none. A piece that the texts repeat is looked up once."""
        if len(self.known) > self.remember:
            self.known.older = {}
            self.known = Pieces(self.tokenizer, self.known)
        texts = pc.fill_null(texts, "")
        # Names of special tokens are case-sensitive.
        plain = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
        split = pc.ascii_split_whitespace(pc.if_else(plain, pc.ascii_lower(texts), texts))
        pieces = split.flatten().dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces.dictionary)], pieces.dictionary), " ")
        names = distinct[0].as_buffer().to_pybytes().split(b" ")
        _, ends, ids = pa.array(map(self.known.__getitem__, names), pa.large_binary()).take(pieces.indices).buffers()
        # The ids of a text's pieces lie together, so its ends are those of its first and last piece.
        ends = np.frombuffer(ends, np.int64)[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), ids])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One encoder a worker process, so later tasks find pieces that are known already."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def forget_encoders() -> None:
    """Drop the encoders of this worker with all that they remember, for stages after the encoding."""
    _ENCODERS.clear()
    give_back()


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches of (doc_id, queue, text) where another BATCH_BYTES of text are full."""
    for batch in batches:
        full = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(full)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Stored token table: part (task), queue (source), before (tokens of that queue earlier in the part), doc_id, n, ids."""
    schema = pa.schema([("part", pa.int32()), ("queue", pa.string()), ("before", pa.int64()), ("doc_id", pa.int64()),
                        ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = encoder_of(path), TaskContext.get().partitionId(), {}
        tail = pa.scalar(np.asarray([end_id], "<u4").tobytes(), pa.large_binary())
        for batch in text_batches(batches):
            ids = pc.binary_join_element_wise(encoder.encode_all(batch.column(2)), tail, pa.scalar(b"", pa.large_binary()))
            n, before = pc.divide(pc.binary_length(ids), 4), []
            for queue, count in zip(batch.column(1).to_pylist(), n.to_pylist()):
                before.append(seen.get(queue, 0))
                seen[queue] = before[-1] + count
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), batch.column(1), pa.array(before, pa.int64()),
                                              batch.column(0), n, ids.cast(pa.binary())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS):
        return written(map_arrow(rows, run, TOKENS), "tokens")


class Plan:
    """Places of tokens: queue totals → the round-robin's stream positions."""

    def __init__(self, totals: list[int], length: int):
        self.totals, self.length = np.asarray(totals, dtype=object), length
        self.rounds = max(1, -(-sum(totals) // length))
        if self.rounds < 1 << 31:  # products stay below 2^63
            self.totals = self.totals.astype(np.int64)
        self.whole, self.rest = self.totals // self.rounds, self.totals % self.rounds

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens all queues have given before each round."""
        return rounds[:, None] * self.whole + rounds[:, None] * self.rest // self.rounds

    def round_of(self, token: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """The round in which a queue gives a token."""
        return -(-(token + 1) * self.rounds // self.totals[queue]) - 1

    def pieces(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, token of it, length, stream position) of documents whose queue tokens are start … start + n.

        A piece is what one round takes of a document, cut where a sequence ends.
        """
        first, last = self.round_of(start, queue), self.round_of(start + n - 1, queue)
        # A queue of fewer tokens than rounds skips rounds: then each token is looked up.
        sparse = last - first >= n
        count = np.where(sparse, n, last - first + 1).astype(np.int64)
        doc = np.repeat(np.arange(len(n)), count)
        step = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        w = np.where(sparse[doc], self.round_of(start[doc] + step, queue[doc]), first[doc] + step)
        use = np.ones(len(doc), bool)
        use[1:] = (doc[1:] != doc[:-1]) | (w[1:] != w[:-1])
        doc, w = doc[use], w[use]
        out: list[tuple[np.ndarray, ...]] = []
        for i in range(0, len(doc), 4096):
            d, some = doc[i:i + 4096], w[i:i + 4096]
            rows, q = np.arange(len(d)), queue[d]
            at, after = self.served(some), self.served(some + 1)
            gives = after - at
            begin = at[rows, q]
            low, high = np.maximum(begin, start[d]), np.minimum(after[rows, q], start[d] + n[d])
            before = np.cumsum(gives, axis=1)[rows, q] - gives[rows, q]
            place = at.sum(axis=1) + before + low - begin
            size = high - low
            left = np.minimum(size, self.length - place % self.length)
            keep = size > 0
            out.append((d[keep], (low - start[d])[keep], left[keep], place[keep]))
            keep = size > left  # a round holds no more than a sequence, so it ends at most once inside
            out.append((d[keep], (low - start[d] + left)[keep], (size - left)[keep], (place + left)[keep]))
        if not out:
            return (np.zeros(0, np.int64),) * 4
        doc, token, size, place = (np.concatenate([x[k] for x in out]).astype(np.int64) for k in range(4))
        order = np.lexsort((token, doc))
        return doc[order], token[order], size[order], place[order]


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, max_queues: int = MAX_QUEUES) -> DataFrame:
    """Pieces of all documents in sequences of at most `length` tokens; only the last sequence is not full.

    One row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty texts
    are one end token; a null source is a queue of its own; sources beyond the `max_queues` largest share one queue;
    repeated rows are packed each. Columns other than doc_id, source and text are ignored. No rows give no pieces.
    """
    spark = docs.sparkSession
    tokens = tokenized(docs, path or default_tokenizer())
    per_part = tokens.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    top = per_part.groupBy("queue").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "queue").limit(max_queues).collect()
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    order = {r["queue"]: i for i, r in enumerate(top)}
    totals = [r["n"] for r in top]
    if (rest := total - sum(totals)):
        totals.append(rest)
    known = spark.createDataFrame([(q, i) for q, i in order.items()], "queue string, line int")
    lines = per_part.join(F.broadcast(known), per_part["queue"].eqNullSafe(known["queue"]), "left").select(
        "part", per_part["queue"], F.coalesce("line", F.lit(len(order))).alias("line"), "n")
    places = Window.partitionBy("line").orderBy("part", F.asc_nulls_first("queue")).rowsBetween(Window.unboundedPreceding, -1)
    bases = written(lines.select("part", "queue", "line", F.coalesce(F.sum("n").over(places), F.lit(0)).alias("base")), "bases")
    right = F.broadcast(bases) if bases.count() <= MAX_BROADCAST_ROWS else bases
    placed = tokens.alias("t").join(right.alias("b"), F.expr("t.part = b.part and t.queue <=> b.queue")).select(
        "t.doc_id", "t.queue", "b.line", F.expr("b.base + t.before").alias("start"), "t.n", "t.ids")
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), *((c, pa.int64()) for c in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        plan, crc = Plan(totals, length), zlib.crc32
        for batch in small_batches(batches):
            docs, queues = batch.column(0), batch.column(1)
            line, start, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(plan.totals.dtype) for i in (2, 3, 4))
            doc, token, size, place = plan.pieces(line.astype(np.int64), start, n)
            views = [memoryview(x) for x in batch.column(5).to_pylist()]
            sums = [crc(views[d][a:b]) for d, a, b in zip(doc.tolist(), (4 * token).tolist(), (4 * (token + size)).tolist())]
            for i in range(0, len(doc), 1 << 16):
                s = slice(i, i + (1 << 16))
                at = pa.array(doc[s])
                yield pa.RecordBatch.from_arrays([
                    docs.take(at), queues.take(at), pa.array(token[s]), pa.array(size[s]), pa.array(sums[s], pa.int64()),
                    pa.array(n.astype(np.int64)[doc[s]]), pa.array(place[s] // length), pa.array(place[s] % length)], schema=schema)

    return map_arrow(placed, run, PIECES)

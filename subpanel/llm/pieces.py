"""SentencePiece encoding and decoding with offsets, from the model file.

A text is normalised by longest prefixes of the model's compiled character map, and every normalised byte records the
source byte it comes from. The normalised text is cut where no piece of the vocabulary can cross, each part is encoded
by the model's merges, and every piece is projected through the record to a span of source bytes.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

# The model's kinds of pieces, its blank sign, and the signs of what cannot be decoded.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BLANK = "▁"
BLANK_BYTES = BLANK.encode()
REPLACEMENT = "�".encode()
UNKNOWN_SURFACE = " ⁇ "
BPE = 2
#: Prefixes of the character map that are looked at for one place.
MOST_PREFIXES = 32
REMEMBER = 300_000
#: Characters of a part that is merged without a queue; no score of a pair.
SHORT, NEVER = 24, float("-inf")


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of one serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at:at + size]
        at += size


class CharMap:
    """The compiled character map: a double-array trie of source strings, and their replacements."""

    def __init__(self, blob: bytes):
        self.units, self.texts = np.zeros(0, np.uint32).tolist(), b""
        if len(blob) > 4:
            size = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.texts = blob[4 + size:]
        starts = [b for b in range(256) if self.units and self._follow(self._offset(self.units[0]), b)]
        #: Bytes no source string begins with, in runs: they stay as they are.
        self.plain = re.compile(b"[^" + b"".join(re.escape(bytes([b])) for b in starts) + b"]+" if starts else b"(?s:.)+")

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def _follow(self, node: int, byte: int) -> bool:
        to = node ^ byte
        return to < len(self.units) and self.units[to] & 0x800000FF == byte

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest source string at a place."""
        units, found, seen = self.units, None, 0
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            if not self._follow(node, data[i]):
                break
            unit = units[node ^ data[i]]
            node ^= data[i] ^ self._offset(unit)
            if unit >> 8 & 1:
                found, seen = (i + 1 - at, units[node] & 0x7FFFFFFF), seen + 1
                if seen == MOST_PREFIXES:
                    break
        if found is None:
            return None
        return found[0], self.texts[found[1]:self.texts.index(b"\0", found[1])]


def spelt_text(data: bytes) -> bytes:
    """The characters that bytes spell; each byte outside them is a replacement sign."""
    out, at = [], 0
    while at < len(data):
        one = data[at:at + char_size(data[at])]
        try:
            one.decode()
        except UnicodeDecodeError:
            one, at = REPLACEMENT, at + 1
        else:
            at += len(one)
        out.append(one)
    return b"".join(out)


def char_size(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Normalizer:
    """Normalised bytes of a text and, for each of them and the end, the source byte it comes from."""

    def __init__(self, spec: bytes, as_suffix: bool = False, user: Sequence[str] = ()):
        self.map, self.dummy, self.squeeze, self.escape, self.as_suffix = CharMap(b""), True, True, True, as_suffix
        for field, value in message(spec):
            if field == 2:
                self.map = CharMap(value)
            elif field == 3:
                self.dummy = bool(value)
            elif field == 4:
                self.squeeze = bool(value)
            elif field == 5:
                self.escape = bool(value)
        self.blank = BLANK_BYTES if self.escape else b" "
        own = sorted((u.encode() for u in user), key=len, reverse=True)
        self.user = re.compile(b"|".join(map(re.escape, own))) if own else None

    def parts(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(source place, source length, replacement) in order; kept stretches come whole."""
        at = 0
        while at < len(data):
            if self.user and (m := self.user.match(data, at)):
                yield at, m.end() - at, m.group()
                at = m.end()
                continue
            plain = self.map.plain.match(data, at)
            end = plain.end() if plain else at
            if plain and self.user and (m := self.user.search(data, at, end)):
                end = m.start()
            if end > at:
                yield at, end - at, data[at:end]
                at = end
                continue
            size, text = self.map.longest(data, at) or (n := char_size(data[at]), data[at:at + n])
            yield at, size, text
            at += size

    def normalize(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.user and not self.squeeze and not self.as_suffix and self.escape:
            # Nothing but blanks changes.
            widths = np.where(np.frombuffer(data, np.uint8) == 32, len(BLANK_BYTES), 1)
            lead = len(BLANK_BYTES) if self.dummy else 0
            origin = np.concatenate([np.zeros(lead, np.int64), np.repeat(np.arange(len(data)), widths), [len(data)]])
            return BLANK_BYTES[:lead] + data.replace(b" ", BLANK_BYTES), origin
        out, origin, done = bytearray(), [], 0
        todo = self._blanks(data)
        if self.squeeze:
            todo = list(todo)
            skip = 0
            while skip < len(todo) and todo[skip][2] == b" ":
                skip += 1
            todo = todo[skip:]
            if not todo:
                return b"", np.zeros(1, np.int64)
            done = todo[0][0]

        def add(text: bytes, begin: int, step: int) -> None:
            """step 1: the bytes come from consecutive source bytes; 0: all from the first."""
            out.extend(text)
            origin.extend(range(begin, begin + len(text)) if step else [begin] * len(text))

        if self.dummy and not self.as_suffix:
            add(self.blank, done, 0)
        after_blank = self.squeeze
        for begin, size, text in todo:
            if after_blank:
                text = text.lstrip(b" ")
            if text:
                if text == data[begin:begin + size] and b" " not in text:
                    self._kept(add, text, begin)
                else:
                    add(text.replace(b" ", self.blank), begin, 0)
                after_blank = self.squeeze and text.endswith(b" ")
            done = begin + size
        if self.squeeze:
            while out.endswith(self.blank):
                done = origin[len(out) - len(self.blank)]
                del out[-len(self.blank):], origin[-len(self.blank):]
        if self.dummy and self.as_suffix:
            add(self.blank, done, 0)
        return bytes(out), np.array([*origin, done], np.int64)

    def _blanks(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """The parts, kept stretches cut into blanks and what stands between."""
        for begin, size, text in self.parts(data):
            if text != data[begin:begin + size] or b" " not in text or self.user and self.user.fullmatch(text):
                yield begin, size, text
                continue
            for m in re.finditer(rb" |[^ ]+", text):
                yield begin + m.start(), m.end() - m.start(), m.group()

    @staticmethod
    def _kept(add, text: bytes, begin: int) -> None:
        """Bytes of one character come from its first byte."""
        if text.isascii():
            add(text, begin, 1)
            return
        at = 0
        while at < len(text):
            n = char_size(text[at])
            add(text[at:at + n], begin + at, 0)
            at += n


class Model:
    """Vocabulary, merges and normaliser of a model file."""

    def __init__(self, path: str, remember: int = REMEMBER):
        with open(path, "rb") as f:
            fields = list(message(f.read()))
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer = dict(message(next((v for k, v in fields if k == 2), b"")))
        for _, value in (x for x in fields if x[0] == 1):
            piece = dict(message(value))
            self.pieces.append(piece.get(1, b"").decode())
            self.scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
            self.kinds.append(piece.get(3, NORMAL))
        if trainer.get(3, 1) != BPE:
            raise ValueError("the model is not of the merging kind")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown_surface = trainer.get(44, UNKNOWN_SURFACE.encode()).decode()
        user = [p for p, k in zip(self.pieces, self.kinds) if k == USER]
        as_suffix = bool(trainer.get(24, 0))
        self.normalizer = Normalizer(next((v for k, v in fields if k == 3), b""), as_suffix, user)
        denormalizer = next((v for k, v in fields if k == 5), b"")
        self.denormalizer = Normalizer(denormalizer) if any(k == 2 and v for k, v in message(denormalizer)) else None
        of = lambda *kinds: {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in kinds}
        self.known = of(NORMAL, USER, UNUSED)
        self.bytes = {int(p[3:5], 16): i for p, i in of(BYTE).items()}
        self.unknown = next(iter(of(UNKNOWN).values()), 0)
        control = of(CONTROL)
        self.begin, self.end = (control.get(trainer.get(k, d).decode()) for k, d in ((46, b"<s>"), (47, b"</s>")))
        self.user = re.compile("|".join(map(re.escape, sorted(user, key=len, reverse=True)))) if user else None
        #: Scores of pieces, for short parts; models with pieces of special kinds take the general way.
        self.score = {p: self.scores[i] for p, i in self.known.items()}
        self.short = not any(k in (USER, UNUSED) for k in self.kinds)
        self._cuts()
        self.remember = remember
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Normalised bytes of each piece; byte pieces get theirs from the character they spell.
        self.sizes = np.array([0 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, self.kinds)], np.int64)
        self.values = np.array([int(p[3:5], 16) if k == BYTE else -1 for p, k in zip(self.pieces, self.kinds)], np.int64)
        self.controls = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.surfaces = [self._surface(i) for i in range(len(self.pieces))]

    def _cuts(self) -> None:
        """Parts that no piece crosses: before blanks, and between signs that no chain of pieces joins.

        Models of other kinds, whose unknown signs have no bytes, say, take a text as one part.
        """
        self.cut = None
        if any(BLANK in p.lstrip(BLANK) for p in self.known) or self.user or self.normalizer.as_suffix or not self.byte_fallback:
            return
        group: dict[str, set[str]] = {}
        for piece in self.known:
            signs = set(piece.lstrip(BLANK))
            if len(piece.lstrip(BLANK)) > 1:
                for other in {id(g): g for g in (group[c] for c in signs if c in group)}.values():
                    signs |= other
                group.update(dict.fromkeys(signs, signs))
        kinds = [f"[{re.escape(''.join(sorted(g)))}]+" for g in {id(g): g for g in group.values()}.values()]
        kinds = "|".join([*sorted(kinds, key=len, reverse=True), f"[^{BLANK}]"])
        self.cut = re.compile(f"{BLANK}+(?:{kinds})?|{kinds}", re.DOTALL)

    # --- encoding -------------------------------------------------------------------------------

    def merge(self, text: str) -> list[tuple[int, int]]:
        """(id, normalised bytes) of the pieces of a part: the best-scored neighbours merge first, the leftmost on ties.

        Of a character spelt in bytes, the last byte holds all of it.
        """
        if self.short and len(text) <= SHORT:
            return self._spell(self._merge_short(text))
        known, scores, kinds = self.known, self.scores, self.kinds
        if self.user:
            signs, fixed, at = [], [], 0
            for m in [*self.user.finditer(text), None]:
                stop = m.start() if m else len(text)
                signs += text[at:stop]
                fixed += [False] * (stop - at)
                if m:
                    signs.append(m.group())
                    fixed.append(True)
                    at = m.end()
        else:
            signs, fixed = list(text), None
        n = len(signs)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[float, int, int, int]] = []
        halves: dict[str, tuple[str, str]] = {}

        def offer(left: int, right: int) -> None:
            if left < 0 or right < 0 or fixed and (fixed[left] or fixed[right]):
                return
            both = signs[left] + signs[right]
            i = known.get(both)
            if i is not None:
                heapq.heappush(queue, (-scores[i], left, right, len(both)))
                if kinds[i] == UNUSED:
                    halves[both] = signs[left], signs[right]

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, left, right, size = heapq.heappop(queue)
            if not signs[left] or not signs[right] or len(signs[left]) + len(signs[right]) != size:
                continue
            signs[left] += signs[right]
            signs[right] = ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return self._spell((s for s in signs if s), halves)

    def _merge_short(self, text: str) -> list[str]:
        """The same for a few characters: the score of each pair of neighbours is kept in a list."""
        signs, score = list(text), self.score.get
        pairs = [score(a + b, NEVER) for a, b in zip(signs, signs[1:])]
        while pairs:
            best = max(pairs)
            if best == NEVER:
                break
            i = pairs.index(best)
            signs[i] += signs.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = score(signs[i] + signs[i + 1], NEVER)
            if i:
                pairs[i - 1] = score(signs[i - 1] + signs[i], NEVER)
        return signs

    def _spell(self, signs: Iterable[str], halves: Mapping[str, tuple[str, str]] = {}) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for sign in signs:
            i = self.known.get(sign, self.unknown)
            if self.kinds[i] == UNUSED and sign in halves:
                out += self._spell(halves[sign], halves)
            elif i == self.unknown and self.byte_fallback:
                data = sign.encode()
                out += [(self.bytes[b], 0) for b in data[:-1]]
                out.append((self.bytes[data[-1]], len(data)))
            else:
                out.append((i, len(sign.encode())))
        return out

    def _learn(self, parts: set[str]) -> None:
        if len(self.seen) > self.remember:
            self.seen, self.older = {}, self.seen
        seen, older, known, short = self.seen, self.older, self.known, self.short and SHORT
        for part in parts:
            if part in seen:
                continue
            if part in older:
                seen[part] = older[part]
                continue
            if len(part) <= short:
                signs = self._merge_short(part)
                try:
                    ids = [known[s] for s in signs]
                except KeyError:
                    ids = [i for i, _ in self._spell(signs)]
            else:
                ids = [i for i, _ in self.merge(part)]
            seen[part] = struct.pack(f"<{len(ids)}I", *ids)

    def _sizes(self, ids: np.ndarray) -> np.ndarray:
        """Normalised bytes of each piece of a whole text; of a character spelt in bytes, the last byte holds all."""
        sizes, values = self.sizes[ids], self.values[ids]
        first = np.flatnonzero((values >= 0) & (values & 0xC0 != 0x80))
        if len(first):
            lead = values[first]
            size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            sizes[first + size - 1] = size
        return sizes

    def encode(self, text: str | None) -> tuple[bytes, bytes, bytes]:
        """Ids, and first and end source byte of each, as little-endian unsigned 32-bit values."""
        data = (text or "").encode()
        normal, origin = self.normalizer.normalize(data)
        normal = normal.decode()
        if self.cut:
            parts = self.cut.findall(normal)
            try:
                ids = b"".join(map(self.seen.__getitem__, parts))
            except KeyError:
                self._learn(set(parts))
                ids = b"".join(map(self.seen.__getitem__, parts))
            ids = np.frombuffer(ids, "<u4")
            sizes = self._sizes(ids)
        else:
            found = self.merge(normal)
            ids, sizes = (np.array([x[k] for x in found], t) for k, t in ((0, "<u4"), (1, np.int64)))
        if not self.byte_fallback and len(ids) > 1:  # unknown neighbours are one
            more = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            first = np.flatnonzero(np.concatenate([[True], ~more]))
            ids, sizes = ids[first], np.add.reduceat(sizes, first)
        # All but the last byte of a character stand empty at its first.
        ends = np.cumsum(sizes)
        return ids.tobytes(), origin[ends - sizes].astype("<u4").tobytes(), origin[ends].astype("<u4").tobytes()

    # --- decoding -------------------------------------------------------------------------------

    def _surface(self, i: int) -> bytes:
        if self.kinds[i] == CONTROL:
            return b""
        if self.kinds[i] == UNKNOWN:
            return self.unknown_surface.encode()
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return self.pieces[i].replace(BLANK, " ").encode()

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: blanks for their signs, without the leading one, byte pieces joined to characters.

        A byte that is no part of a character becomes U+FFFD, control pieces nothing.
        """
        kinds, surfaces, normalizer = self.kinds, self.surfaces, self.normalizer
        out: list[bytes] = []
        at = 0
        while at < len(ids) and kinds[ids[at]] != BYTE:  # the first pieces lose their blank
            surface = surfaces[ids[at]]
            begun = bool(surface)
            if kinds[ids[at]] not in (CONTROL, UNKNOWN) and (normalizer.dummy or normalizer.squeeze) and surface.startswith(b" "):
                surface = surface[1:]
                begun = not normalizer.squeeze or bool(surface)
            out.append(surface)
            at += 1
            if begun:
                break
        rest = ids[at:]
        try:
            if not self.controls.isdisjoint(rest[:-1]):
                raise ValueError("control pieces between bytes part them")
            text = b"".join([*out, *map(surfaces.__getitem__, rest)]).decode()
        except ValueError:
            for spelt, group in groupby(rest, lambda i: kinds[i] == BYTE):
                data = b"".join(map(surfaces.__getitem__, group))
                out.append(spelt_text(data) if spelt else data)
            text = b"".join(out).decode()
        if self.denormalizer:
            return self.denormalizer.normalize(text.encode())[0].decode().replace(BLANK, " ")
        return text


_MODELS: dict[str, Model] = {}


def model_of(path: str) -> Model:
    """One model a worker process, so later tasks find parts that are known already."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def small_arrays(batches: Iterable[pa.Array], rows: int = 200) -> Iterator[pa.Array]:
    """Incoming arrays cut, so that few texts and their pieces are held at a time."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


_INTS = pa.binary()
_ENCODED = pa.struct([("ids", _INTS), ("begins", _INTS), ("ends", _INTS)])


def encode(text: Column, path: str | None = None, begin: bool = False, end: bool = False) -> Column:
    """Struct of `ids`, `begins` and `ends`: binary of little-endian unsigned 32-bit values, one per piece.

    The whole text is encoded as the model's library does, without sampling. begins and ends are the piece's bytes in
    the UTF-8 source; a dummy blank, `begin` and `end` ids and all but the last byte of a spelt character are empty
    spans. Null counts as the empty text. Rows do not see each other.
    """
    path = path or default_model()

    @arrow_udf("struct<ids: binary, begins: binary, ends: binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(path)
        number = struct.Struct("<I").pack
        for batch in small_arrays(batches):
            cols: tuple[list[bytes], ...] = ([], [], [])
            for text in batch.to_pylist():
                ids, begins, ends = model.encode(text)
                last = number(len((text or "").encode())) if end else b""
                if begin:
                    ids, begins, ends = number(model.begin) + ids, number(0) + begins, number(0) + ends
                if end:
                    ids, begins, ends = ids + number(model.end), begins + last, ends + last
                for col, value in zip(cols, (ids, begins, ends)):
                    col.append(value)
            yield pa.StructArray.from_arrays([pa.array(c, _INTS) for c in cols], fields=list(_ENCODED))
        pa.default_memory_pool().release_unused()

    return run(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """Texts of binary ids, as the model's library decodes them. Null stays null."""
    path = path or default_model()

    @arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(path)
        for batch in small_arrays(batches):
            yield pa.array([None if x is None else model.decode(np.frombuffer(x, "<u4").tolist()) for x in batch.to_pylist()], pa.string())
        pa.default_memory_pool().release_unused()

    return run(ids)

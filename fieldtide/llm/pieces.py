"""SentencePiece encoding and decoding by suffix-array matching.

A text with a leading space is cut in front of each run of spaces into units; no piece reaches over such a cut. The
distinct units that a batch adds are concatenated and indexed by a suffix array, sorted as deep as the longest piece. Every piece
of the vocabulary is binary-searched in it for its range of occurrences. The occurrences are edges; sorted by position,
they are relaxed from left to right, which leaves each unit's segmentation of the largest total score. Ties keep the
longer last piece. A character without a piece of its own is an edge of byte pieces, priced below every piece.

Scores are those of the vocabulary file. Its order of merges serves as the score, so results may differ from those of a
merge-by-merge encoder; decoding gives the text back in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldtide.llm.work import byte_views, chunks

_MARK = "▁".encode()
_PLAIN = b"\xff\xfe\xfd"  # stands for the mark where a text holds it itself; no UTF-8 text has these bytes
_STOP = b"\xfc"
_UNIT = re.compile(rb" *[^ ]+| +$")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes with their ids and scores, and the ids of the 256 byte pieces."""

    pieces: list[bytes]
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    size: int
    lengths: np.ndarray
    low: np.ndarray  # the first eight bytes, filled up with zeros
    high: np.ndarray  # the same, filled up with 255

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        """Reads a model file on the driver. The file is not trained or changed."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        byte_ids = np.array([k for k in every if model.is_byte(k)], np.int32)
        if byte_ids.size != 256:
            raise ValueError("the vocabulary needs all 256 byte pieces")
        ids = [k for k in every if not (model.is_byte(k) or model.is_unknown(k) or model.is_control(k) or model.is_unused(k))]
        return cls.of({k: model.id_to_piece(k).encode() for k in ids}, {k: model.get_score(k) for k in ids}, byte_ids, len(every))

    @classmethod
    def of(cls, pieces: dict[int, bytes], scores: dict[int, float], byte_ids: np.ndarray, size: int) -> "Vocabulary":
        order = sorted(pieces, key=lambda k: (pieces[k], k))
        parts = [pieces[k] for k in order]
        return cls(parts, np.array(order, np.int32), np.array([scores[k] for k in order], float), byte_ids, size,
                   np.array([len(p) for p in parts], np.int64), _first_eight(parts, b"\0"), _first_eight(parts, b"\xff"))

    def bytes_of(self) -> list[bytes]:
        """What each id decodes to."""
        out = [b""] * self.size
        for k, piece in zip(self.ids.tolist(), self.pieces):
            out[k] = piece.replace(_MARK, b" ")
        for value, k in enumerate(self.byte_ids.tolist()):
            out[k] = bytes([value])
        return out


def _eights(data: bytes) -> np.ndarray:
    """The eight bytes from each position as one big-endian number, as if zeros followed."""
    padded = data + bytes(16)
    out = np.empty(len(padded) - 8, np.uint64)
    for k in range(8):
        out[k::8] = np.frombuffer(padded, ">u8", (len(padded) - k) // 8, k)[: out[k::8].size]
    return out


def suffix_array(data: bytes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their next ``depth`` bytes, and ``_eights`` of the data, followed by zeros.

    Only positions that tie in the bytes so far are compared further.
    """
    eights = _eights(data + bytes(depth))
    order = np.argsort(eights[: len(data)])
    first = eights[order]
    same = np.concatenate([[False], first[1:] == first[:-1]])
    for offset in range(8, depth, 8):
        open_places = np.flatnonzero(same | np.append(same[1:], False))
        if not open_places.size:
            break
        group = np.cumsum(~same[open_places])
        column = eights[order[open_places] + offset]
        moved = np.lexsort((column, group))
        order[open_places] = order[open_places][moved]
        column = column[moved]
        same = np.zeros(order.size, bool)
        same[open_places[1:]] = (column[1:] == column[:-1]) & (group[1:] == group[:-1])
    return order, eights


def _first_eight(parts: list[bytes], fill: bytes) -> np.ndarray:
    return np.frombuffer(b"".join(p[:8].ljust(8, fill) for p in parts), ">u8").astype(np.uint64)


def occurrences(vocabulary: Vocabulary, order: np.ndarray, eights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of each piece in the suffix array, by binary search eight bytes at a time."""
    first = eights[order]
    low = np.searchsorted(first, vocabulary.low, "left")
    high = np.searchsorted(first, vocabulary.high, "right")
    for k in np.flatnonzero((high > low) & (vocabulary.lengths > 8)):
        rest, offset = vocabulary.pieces[k][8:], 8
        a, b = low[k], high[k]
        while rest and a < b:
            part = eights[order[a:b] + offset]
            bounds = _first_eight([rest], b"\0")[0], _first_eight([rest], b"\xff")[0]
            a, b = a + np.searchsorted(part, bounds[0], "left"), a + np.searchsorted(part, bounds[1], "right")
            rest, offset = rest[8:], offset + 8
        low[k], high[k] = a, b
    return low, high


def segment(units: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and how many each unit has. Units hold the mark for spaces."""
    if not units:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    data = _STOP.join(units) + _STOP
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    unit_starts = np.cumsum(lengths + 1) - lengths - 1
    order, eights = suffix_array(data, max(map(len, vocabulary.pieces), default=1))
    low, high = occurrences(vocabulary, order, eights)
    # Edges are many: their numbers stay at 32 bits.
    order = order.astype(np.int32)
    del eights
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(count.size, dtype=np.int32), count)
    start = order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(which.size)]
    stop = start + vocabulary.lengths[which].astype(np.int32)
    # Characters that no piece covers alone: edges of bytes.
    raw = np.frombuffer(data, np.uint8)
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    ends = np.append(heads[1:], len(data))
    heads, ends = heads[raw[heads] != _STOP[0]].astype(np.int32), ends[raw[heads] != _STOP[0]].astype(np.int32)
    char_end = np.zeros(len(data), np.int32)
    char_end[heads] = ends
    alone = np.zeros(len(data), bool)
    alone[start[char_end[start] == stop]] = True
    bare = heads[~alone[heads]]
    penalty = float(vocabulary.scores.min(initial=0.0)) - 10
    kind = np.concatenate([which, np.full(bare.size, -1, np.int32)])
    del which
    score = np.append(vocabulary.scores, penalty)[kind]
    start, stop = np.concatenate([start, bare]), np.concatenate([stop, char_end[bare]])
    # Edges sorted by position in their units relax all units side by side: those from the first bytes, then the second.
    unit_of = np.repeat(np.arange(lengths.size, dtype=np.int32), lengths + 1)
    longest = int(lengths.max())
    within = (start - unit_starts[unit_of[start]]).astype(np.uint16 if longest < 1 << 16 else np.uint32)
    side = np.argsort(within, kind="stable")
    start, stop, kind, score = start[side], stop[side], kind[side], score[side]
    rounds = np.searchsorted(within[side], np.arange(longest + 1).astype(within.dtype))
    del within, side
    best = np.full(len(data) + 1, -np.inf)
    best[unit_starts] = 0.0
    for lo, hi in zip(rounds[:-1], rounds[1:]):
        if lo < hi:
            np.maximum.at(best, stop[lo:hi], best[start[lo:hi]] + score[lo:hi])
    tight = np.flatnonzero((best[start] + score == best[stop]) & np.isfinite(best[stop]))[::-1]
    back = np.full(len(data) + 1, -1)
    back[stop[tight]] = tight  # the edge that starts first stays
    chosen = np.zeros(len(data), np.int64)  # the edge of the path that starts at a byte, plus one
    at = unit_starts + lengths
    open_units = np.flatnonzero(lengths > 0)
    while open_units.size:
        e = back[at[open_units]]
        chosen[start[e]] = e + 1
        at[open_units] = start[e]
        open_units = open_units[at[open_units] > unit_starts[open_units]]
    path = chosen[chosen > 0] - 1
    kind, start, stop = kind[path], start[path], stop[path]
    pieces = np.where(kind >= 0, 1, stop - start)
    first = np.cumsum(pieces) - pieces
    ids = np.zeros(int(pieces.sum()), np.int32)
    plain = kind >= 0
    ids[first[plain]] = vocabulary.ids[kind[plain]]
    spread = np.repeat(np.flatnonzero(~plain), pieces[~plain])
    step = np.arange(spread.size) - np.repeat(np.cumsum(pieces[~plain]) - pieces[~plain], pieces[~plain])
    ids[first[spread] + step] = vocabulary.byte_ids[raw[start[spread] + step]]
    return ids, np.bincount(unit_of[start], weights=pieces, minlength=lengths.size).astype(np.int64)


def _mark_ids(vocabulary: Vocabulary) -> np.ndarray:
    """Byte ids of the stand-ins to the byte ids of the mark itself."""
    table = np.arange(vocabulary.size, dtype=np.int32)
    table[vocabulary.byte_ids[list(_PLAIN)]] = vocabulary.byte_ids[list(_MARK)]
    return table


class UnitTable(dict):
    """Units seen so far by number, with their ids. Holds at most about ``most`` units between batches; new ones are
    indexed in parts of about ``index_bytes``."""

    def __init__(self, vocabulary: Vocabulary, most: int = 300_000, index_bytes: int = 192 << 10):
        super().__init__()
        self.vocabulary, self.most, self.index_bytes, self.marks = vocabulary, most, index_bytes, _mark_ids(vocabulary)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[bytes] = []
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def __missing__(self, unit: bytes) -> int:
        self[unit] = number = len(self)
        self.fresh.append(unit)
        return number

    def settle(self) -> None:
        """Segments the units that came since the last call."""
        flat, sizes, part, held = [self.flat], [self.sizes], [], 0
        for k, unit in enumerate(self.fresh, 1):
            part.append(unit.replace(b" ", _MARK))
            held += len(unit)
            if held >= self.index_bytes or k == len(self.fresh):
                ids, counts = segment(part, self.vocabulary)
                flat.append(self.marks[ids])
                sizes.append(counts)
                part, held = [], 0
        self.flat, self.sizes, self.fresh = np.concatenate(flat), np.concatenate(sizes), []

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offsets of the texts. An empty text has none."""
        if len(self) > self.most:
            self.forget()
        used: list[int] = []
        ends = [0]
        for text in texts:
            if text:
                used.extend(map(self.__getitem__, _UNIT.findall(b" " + text.replace(_MARK, _PLAIN))))
            ends.append(len(used))
        self.settle()
        use = np.array(used, np.int64)
        length = self.sizes[use]
        total = np.concatenate([[0], np.cumsum(length)])
        starts = np.cumsum(self.sizes) - self.sizes
        ids = self.flat[np.repeat(starts[use] - total[:-1], length) + np.arange(total[-1])]
        return ids, total[ends]


def encode_batch(texts: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    return UnitTable(vocabulary).encode(texts)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", to: str = "ids", batch_bytes: int = 2 << 20) -> DataFrame:
    """``docs`` with the piece ids of every whole text in ``to``; null and empty texts have no ids.

    A task indexes about ``batch_bytes`` of text at a time, or one longer text. ``to`` replaces a column of that name.
    """
    schema = docs.drop(to).withColumn(to, F.lit(None).cast("array<int>")).schema
    arranged = docs.drop(to).withColumn("_units", F.coalesce(F.col(text), F.lit("")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = UnitTable(vocabulary)
        for batch in batches:
            data, offsets = byte_views(batch.column(batch.num_columns - 1))
            for lo, hi in chunks(offsets, batch_bytes):
                texts = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(lo, hi)]
                ids, ends = table.encode(texts)
                column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], column], names=[*part.schema.names[:-1], to])

    return arranged.mapInArrow(scan, schema)


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", to: str = "decoded", batch_ids: int = 1 << 20) -> DataFrame:
    """``docs`` with the text of ``ids`` in ``to``: pieces joined, marks as spaces, without the leading space. Null ids give
    the empty text; bytes that are no UTF-8 become replacement characters. About ``batch_ids`` ids are held as text at a time."""
    schema = docs.drop(to).withColumn(to, F.lit("")).schema
    arranged = docs.drop(to).withColumn("_ids", F.coalesce(F.col(ids), F.expr("cast(array() as array<int>)")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary.bytes_of()
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
            ends = ends - ends[0]
            for lo, hi in chunks(ends, batch_ids):
                out = []
                for a, b in zip(ends[lo:hi].tolist(), ends[lo + 1 : hi + 1].tolist()):
                    raw = b"".join(map(table.__getitem__, flat[a:b].tolist()))
                    out.append(raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace"))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.string())], names=[*part.schema.names[:-1], to])

    return arranged.mapInArrow(scan, schema)

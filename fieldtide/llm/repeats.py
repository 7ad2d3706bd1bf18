"""Removal of byte passages that occur more than once in a collection, by column-wise construction of its
Burrows-Wheeler transform.

Every text is cut into runs of windows (``windows.py``). Runs under an anchor of only one occurrence cannot repeat and go
no further; equal runs are one string with a count. The other strings of an anchor are a small collection, aligned at
the anchor; those without a stretch around it in common with another one share no window and are left out. The transform of many collections is built together, column by column from the right: each round reads the
next symbol of every string from a sequential file of columns, inserts it in front of the string's suffix, and rewrites
the file that holds the order of the suffixes with the common prefix of neighbours. Strings are aligned, so a suffix can
share a whole window only with suffixes of its own column; a round therefore keeps the block of the transform that
belongs to the newest column and costs time linear in the strings. A window repeats when its suffix shares at least the
window's length with a neighbour in that order.

An anchor with many strings is dealt out again under a longer context: the anchor and the ``_CONTEXT`` bytes to its right,
or to its left for windows that end before these. Each part is a collection of its own, built column-wise. What is still
large there is dealt out by whole windows, which repeat if there are two of them. All rows count: nothing is capped or
sampled. Strings and windows are taken for equal by 128 bits of their SHA-256, as texts are; inside a collection the
construction compares their bytes.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from fieldtide.llm.windows import GRAM, anchor_offsets, runs, stretch_hashes
from fieldtide.llm.work import byte_views, chunks, saved, text_key, unused

_RUN = "key bigint, content binary, text_id binary, start int, n int"
_CHUNK = 32 << 10  # its hashes stay in cache
_CONTEXT = 76  # of the 152 bytes of a window beside its anchor, one side has as many


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def _text_runs(length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_views(batch.column("text"))
            ids = batch.column("text_id").cast(pa.binary())
            for lo, hi in chunks(offsets, 8 * _CHUNK):
                part = data[offsets[lo] : offsets[hi]]
                own, found = offsets[lo : hi + 1] - offsets[lo], []
                for a, b in chunks(own, _CHUNK):
                    r = runs(part[own[a] : own[b]], own[a : b + 1] - own[a], length)
                    found.append((r["anchor"], r["at"] + own[a], r["n"], r["start"], r["doc"] + lo + a))
                anchor, first, n, start, doc = (np.concatenate(c) for c in zip(*found))
                if n.size:
                    view = memoryview(part)
                    content = [_digest(view[a:b]) for a, b in zip(first.tolist(), (first + n + length - 1).tolist())]
                    yield pa.record_batch({"key": anchor, "content": pa.array(content, pa.binary()), "text_id": ids.take(pa.array(doc)),
                                           "start": start.astype(np.int32), "n": n.astype(np.int32)})

    return scan


def _range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Smallest value of each range first..last. Ranges are passed from the back, so that gaps between them cost nothing."""
    bounds = np.empty(2 * first.size, np.int64)
    bounds[0::2], bounds[1::2] = first[::-1], last[::-1] + 1
    return np.minimum.reduceat(values, bounds)[0::2][::-1]


def repeated_windows(strings: list[bytes], group: np.ndarray, counts: np.ndarray, length: int, folder: str) -> np.ndarray:
    """For every string and window start, whether that window also occurs in another string of its group.

    ``folder`` holds the sequential files: the symbols by column, and the order and common prefixes after each round.
    """
    many = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, many)
    anchors = anchor_offsets(strings, length)
    right, left = int((sizes - anchors).max()), int(anchors.max())
    table = np.zeros((right + left, many), np.uint16)
    data = np.frombuffer(b"".join(strings), np.uint8)
    row = np.repeat(np.arange(many), sizes)
    at = np.arange(data.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    table[right - 1 - (at - anchors[row]), row] = data.astype(np.uint16) + 1
    columns, state = Path(folder, "columns"), Path(folder, "state")
    table.tofile(columns)
    del table, row, at, data

    rank = np.unique(group, return_inverse=True)[1]
    order = np.argsort(rank, kind="stable")
    block = rank[order] * 257
    found = np.zeros((many, int(counts.max())), bool)
    # The state keeps its size and is written over in place: a file cut to nothing and written anew goes to disk each round.
    with columns.open("rb", 0) as source, state.open("w+b", 0) as held:
        held.write(np.stack([order, np.zeros(many, np.int64)]))
        for column in range(right + left):
            symbols = np.frombuffer(source.read(2 * many), np.uint16)
            held.seek(0)
            order, common = np.frombuffer(held.read(16 * many), np.int64).reshape(2, many)
            own = symbols[order]
            key = block + own
            new = np.argsort(key, kind="stable")
            key = key[new]
            same = np.flatnonzero((key[1:] == key[:-1]) & (own[new[1:]] != 0)) + 1
            longer = np.zeros(many + 1, np.int64)
            if same.size:
                first, last = new[same - 1] + 1, new[same]
                shared = common[last]
                far = np.flatnonzero(first < last)
                if far.size:
                    shared[far] = _range_minima(np.append(common, 0), first[far], last[far])
                longer[same] = np.minimum(shared + 1, length)
            order = order[new]
            held.seek(0)
            held.write(np.stack([order, longer[:many]]))
            far = np.flatnonzero(np.maximum(longer[:-1], longer[1:]) >= length)
            if far.size:
                here = order[far]
                start = anchors[here] + (right - 1 - column)
                hit = (start >= 0) & (start < counts[here])
                found[here[hit], start[hit]] = True
    return found


def may_share(strings: list[bytes], group: np.ndarray, length: int, steps: int = 4) -> np.ndarray:
    """Whether each string has a stretch around its anchor in common with another of its group that a shared window needs.

    A window has 0 to ``length - GRAM`` bytes left of its anchor. Dealt to ``steps`` ranges of that number, all windows of
    a range cover the bytes from the range's first number left of the anchor to those that its last number leaves on the
    right. Strings that share a window share one of these stretches, so their hashes agree: no shared window is missed.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    starts = np.cumsum(sizes) - sizes
    anchors = anchor_offsets(strings, length)
    data = np.frombuffer(b"".join(strings), np.uint8)
    bounds = np.linspace(0, length - GRAM + 1, steps + 1).astype(np.int64)
    shared = np.zeros(sizes.size, bool)
    for first, last in zip(bounds[:-1], bounds[1:]):
        at, stretch = anchors - first, int(length - (last - 1 - first))
        here = np.flatnonzero((at >= 0) & (at + stretch <= sizes) & (first < last))
        key, own = stretch_hashes(data, starts[here] + at[here], stretch), group[here]
        order = np.lexsort((key, own))
        same = (key[order[1:]] == key[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
        shared[here[order[1:][same]]] = True
        shared[here[order[:-1][same]]] = True
    return shared


def _ranges(flags: np.ndarray) -> pa.ListArray:
    """Starts and ends of the runs of true flags of each row, one after the other."""
    edges = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, at = np.nonzero(edges)
    offsets = np.searchsorted(row, np.arange(flags.shape[0] + 1))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(at.astype(np.int32)))


def _build(length: int, batch_strings: int):
    """Only strings that ``may_share`` a window with another are built; those that do not have what their copies say."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(rows: list[tuple], found: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
                                    _ranges(found)], names=["key", "content", "spans"])

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            counts = np.array([r[3] for r in rows])
            with tempfile.TemporaryDirectory() as folder:
                found = repeated_windows([r[2] for r in rows], np.array([r[0] for r in rows]), counts, length, folder)
            whole = np.array([r[4] > 1 for r in rows])
            found[whole] = np.arange(found.shape[1]) < counts[whole, None]
            return result(rows, found)

        def sift(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
            shared = may_share([r[2] for r in rows], np.array([r[0] for r in rows]), length)
            return [r for r, s in zip(rows, shared) if s], [r for r, s in zip(rows, shared) if not s and r[4] > 1]

        def alone(rows: list[tuple]) -> pa.RecordBatch:
            return result(rows, np.arange(max(r[3] for r in rows)) < np.array([r[3] for r in rows])[:, None])

        rows: list[tuple] = []
        held: list[tuple] = []  # whole groups of strings that are to be built
        seen: tuple | None = None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "bytes", "n", "copies"))):
                if seen == r[:2]:
                    continue  # the same text was read twice
                if len(rows) >= batch_strings and r[0] != rows[-1][0]:
                    some, rest = sift(rows)
                    if rest:
                        yield alone(rest)
                    held, rows = held + some, []
                    if len(held) >= batch_strings:
                        yield solve(held)
                        held = []
                rows.append(r)
                seen = r[:2]
        if rows:
            some, rest = sift(rows)
            if rest:
                yield alone(rest)
            held += some
        if held:
            yield solve(held)

    return build


def _cut(length: int):
    """Bytes of each wanted run. Of copies of a text that come one after the other, the first is read."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: bytes | None = None
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("text_id").to_pylist()
            first = [k for k, key in enumerate(ids) if key != (ids[k - 1] if k else last)]
            last = ids[-1] if ids else last
            batch = batch.take(pa.array(first, pa.int64()))
            for text, wanted in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("wanted").to_pylist()):
                out += [(w["key"], w["content"], text[w["start"] : w["start"] + w["n"] + length - 1], w["n"], w["copies"]) for w in wanted]
            if out:
                types = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["key", "content", "bytes", "n", "copies"])

    return cut


def _refine(length: int, whole: bool):
    """The parts of a string: its windows with the context to the right of the anchor, and those with it to the left;
    with ``whole`` every window by itself, without its bytes. ``at`` is a part's first window."""

    def key_of(data: bytes) -> int:
        return int.from_bytes(hashlib.sha256(data).digest()[16:24], "little", signed=True)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings, counts = batch.column("bytes").to_pylist(), batch.column("n").to_pylist()
            out: list[tuple] = []
            anchors = anchor_offsets(strings, length).tolist() if strings else []
            for k, (raw, n, anchor) in enumerate(zip(strings, counts, anchors)):
                if whole:
                    parts = [(key_of(raw[a : a + length]), raw[a : a + length], a, 1) for a in range(n)]
                else:
                    turn = min(max(0, anchor - _CONTEXT), n)  # from here on the window holds the right context
                    parts = [(key_of(b"l" + raw[anchor - _CONTEXT : anchor + GRAM]), raw[: turn + length - 1], 0, turn)] if turn else []
                    if turn < n:
                        parts.append((key_of(b"r" + raw[anchor : anchor + GRAM + _CONTEXT]), raw[turn : n + length - 1], turn, n - turn))
                out += [(k, key, _digest(data), None if whole else data, at, size) for key, data, at, size in parts]
            if out:
                own, key, content, data, at, size = zip(*out)
                own = pa.array(own)
                yield pa.record_batch({
                    "whole_key": batch.column("key").take(own), "whole": batch.column("content").take(own), "at": pa.array(at, pa.int32()),
                    "key": pa.array(key, pa.int64()), "content": pa.array(content, pa.binary()), "bytes": pa.array(data, pa.binary()),
                    "n": pa.array(size, pa.int32()), "copies": batch.column("copies").take(own)})

    return refine


def _collections(strings: DataFrame, length: int, most_strings: int, batch_strings: int, level: int = 0) -> DataFrame:
    """(key, content, spans) of distinct strings (key, content, bytes, n, copies): the repeated windows of each."""
    if level == 2:  # single windows
        return strings.filter("copies > 1").select("key", "content", F.array(F.lit(0), F.lit(1)).alias("spans"))
    large = strings.groupBy("key").agg(F.count(F.lit(1)).alias("strings")).filter(F.col("strings") > most_strings).select("key")
    build = _build(length, batch_strings)
    schema = "key bigint, content binary, spans array<int>"
    columnwise = lambda rows: rows.repartition("key").sortWithinPartitions("key", "content").mapInArrow(build, schema).filter(F.size("spans") > 0)
    if large.isEmpty():
        return columnwise(strings)
    fields = "whole_key bigint, whole binary, at int, key bigint, content binary, bytes binary, n int, copies bigint"
    hot = strings.join(large, "key", "left_semi").select(*strings.columns).dropDuplicates(["key", "content"])
    parts = saved(hot.mapInArrow(_refine(length, level == 1), fields), "parts")
    below = parts.groupBy("key", "content").agg(F.sum("copies").alias("copies"), F.min("n").alias("n"), F.min("bytes").alias("bytes"))
    below = saved(below.select("key", "content", "bytes", "n", "copies"), "strings")
    found = parts.select("whole_key", "whole", "at", "key", "content").join(
        _collections(below, length, most_strings, batch_strings, level + 1), ["key", "content"])
    lifted = found.groupBy(F.col("whole_key").alias("key"), F.col("whole").alias("content")).agg(
        F.flatten(F.collect_list(F.transform("spans", lambda x: x + F.col("at")))).alias("spans"))
    return columnwise(strings.join(large, "key", "left_anti").select(*strings.columns)).unionByName(lifted)


def repeated_runs(docs: DataFrame, text: str = "text", length: int = 200, most_strings: int = 32_768,
                  batch_strings: int = 2_000) -> DataFrame:
    """(text_id, runs): for each distinct text with repeated windows, these as (start, spans) of its runs."""
    texts = docs.select(text_key(F.col(text)).alias("text_id"), F.col(text).alias("text")).filter(F.octet_length("text") >= length)
    found = texts.mapInArrow(_text_runs(length), _RUN)
    # The texts are scanned once: runs are counted by anchor where they have been dealt out by it.
    again = found.withColumn("rows", F.count(F.lit(1)).over(W.partitionBy("key"))).filter("rows > 1")
    wanted = saved(again.groupBy("key", "content", "text_id", "start", "n").agg(F.count(F.lit(1)).alias("copies")), "runs")

    strings = saved(wanted.groupBy("key", "content").agg(
        F.sum("copies").alias("copies"), F.min(F.struct("text_id", "start", "n")).alias("at")), "strings")
    groups = strings.groupBy("key").agg(F.count(F.lit(1)).alias("strings")).filter("strings > 1")
    lone = strings.filter("copies > 1").select("key", "content", F.array(F.lit(0), F.col("at.n")).alias("spans"))
    shared = strings.join(groups, "key").select("key", "content", "copies", "at.*")
    # One row for each text that holds the first occurrence of a string: a text has boundedly many strings.
    asked = shared.groupBy("text_id").agg(F.collect_list(F.struct("key", "content", "copies", "start", "n")).alias("wanted"))
    pieces = texts.join(asked, "text_id").select("text_id", "text", "wanted").mapInArrow(
        _cut(length), "key bigint, content binary, bytes binary, n int, copies bigint")
    # Copies of a text may be read more than once; the construction passes over the second.
    spans = _collections(saved(pieces, "pieces"), length, most_strings, batch_strings)
    spans = lone.join(groups, "key", "left_anti").unionByName(spans)
    return wanted.join(spans, ["key", "content"]).groupBy("text_id").agg(F.collect_list(F.struct("start", "spans")).alias("runs"))


def _gone(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, runs: pa.StructArray, length: int) -> np.ndarray:
    """Which bytes of ``data`` a repeated window covers; text t has ``counts[t]`` of the runs."""
    spans, start = pc.struct_field(runs, "spans"), pc.struct_field(runs, "start").to_numpy(zero_copy_only=False).astype(np.int64)
    start += np.repeat(offsets[:-1], counts)
    each = np.repeat(start, pc.list_value_length(spans).to_numpy(zero_copy_only=False) // 2)
    at = spans.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    edges = np.zeros(data.size + 1, np.int32)
    np.add.at(edges, each + at[:, 0], 1)
    np.add.at(edges, each + at[:, 1] - 1 + length, -1)
    return np.cumsum(edges)[:-1] > 0


def _keep(length: int, with_text: bool):
    """Bytes outside all repeated windows, for the rows that have any; neighbours of one text are cut once."""

    def keep(key: pa.Array, text: pa.Array, runs: pa.Array) -> pa.Array:
        rows = np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False))
        own = key.take(pa.array(rows))
        new = np.append(np.ones(min(1, rows.size), bool), pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False).astype(bool))
        heads = pa.array(rows[new])
        data, offsets = byte_views(text.take(heads))
        runs = runs.take(heads)
        out: list[tuple] = []
        for lo, hi in chunks(offsets, 8 * _CHUNK):
            mine, own = runs.slice(lo, hi - lo), offsets[lo : hi + 1] - offsets[lo]
            part = data[offsets[lo] : offsets[hi]]
            gone = _gone(part, own, pc.list_value_length(mine).to_numpy(zero_copy_only=False), mine.flatten(), length)
            rising = gone.copy()
            rising[1:] &= ~gone[:-1]
            rising[own[:-1]] = gone[own[:-1]]
            removed, spans = (np.add.reduceat(flags, own[:-1], dtype=np.int64).tolist() for flags in (gone, rising))
            kept = memoryview(part[~gone])
            ends = np.append(0, own[1:] - np.cumsum(removed)).tolist()
            for a, b, n_removed, n_spans in zip(ends[:-1], ends[1:], removed, spans):
                out.append((n_removed, n_spans, hashlib.sha256(kept[a:b]).hexdigest(),
                            str(kept[a:b], "utf-8", "ignore") if with_text else None))
        types = {"n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
        fields = list(types)[: 4 if with_text else 3]
        found = pa.StructArray.from_arrays([pa.array([r[k] for r in out], types[c]) for k, c in enumerate(fields)], fields)
        place = np.full(len(key), -1)
        place[rows] = np.cumsum(new) - 1
        return found.take(pa.array(place, mask=place < 0))

    return F.arrow_udf(keep, "n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept string" * with_text)


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200, with_text: bool = False,
                   most_strings: int = 32_768, batch_strings: int = 2_000) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 (lower-case hex) and, if ``with_text``, kept.

    Texts are UTF-8 bytes; a null text is empty. A byte goes when a string of ``length`` bytes that covers it also
    starts at any other place of the collection, same text included. Strings are judged on the input. ``kept`` drops
    bytes of characters that a removal has cut. Rows repeat as they do in the input; equal texts lose equal bytes; a
    text shorter than ``length`` is kept. Added names must not be among the columns of ``docs``.
    """
    spans = repeated_runs(docs, text, length, most_strings, batch_strings)
    value = F.coalesce(F.col(text), F.lit(""))
    key, whole, found = unused(docs, "_key"), unused(docs, "_whole"), unused(docs, "_found")
    # The text is hashed before the rows are dealt out by it, and travels once.
    rows = docs.withColumn(whole, F.sha2(value, 256)).withColumn(key, F.unhex(F.substring(whole, 1, 32)))
    rows = rows.join(spans.select(F.col("text_id").alias(key), F.col("runs").alias(found)), key, "left")
    runs = F.col(found)
    rows = rows.withColumn(found, _keep(length, with_text)(F.col(key), F.when(runs.isNotNull(), F.col(text)), runs))
    zero = F.lit(0).cast("bigint")
    extra = {
        "n_bytes": F.octet_length(value).cast("bigint"),
        "n_removed": F.coalesce(f"{found}.n_removed", zero), "n_spans": F.coalesce(f"{found}.n_spans", zero),
        "kept_sha256": F.coalesce(f"{found}.kept_sha256", whole),
    }
    if with_text:
        extra["kept"] = F.coalesce(f"{found}.kept", F.col(text))
    return rows.select(*(F.col(c) for c in docs.columns), *(v.alias(k) for k, v in extra.items()))

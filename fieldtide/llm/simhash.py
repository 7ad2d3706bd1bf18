"""SimHash fingerprints and their near-duplicate groups, by a Gray-order hierarchical index.

Distinct fingerprints are few next to rows, so the index holds those only. 64 bits in six blocks: two fingerprints that
differ in at most two bits agree on at least four whole blocks, so each is filed under the fifteen masks of four blocks.
Such a masked pattern is the top of a tree. Below it fingerprints lie in the order of their Gray rank, where neighbours
share most bits; each node keeps the bits that all codes under it share and its parent does not fix. A search walks down
with the number of differing bits so far and drops a whole group once that exceeds the limit. A pattern fixes at least 42
bits, which bounds a tree whatever the corpus. A task emits one link from each code to its local root, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fieldtide.llm.work import saved, text_key
from fieldtide.operators.components import roots

_BLOCKS = (11, 11, 11, 11, 10, 10)
_FAN = 8


def shingle_hashes(text: bytes, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 hashes of all word shingles; none without words. Fewer words than a shingle are one."""
    words = text.lower().split()  # bytes: A-Z only, and space with the controls 9 to 13
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.diff(ends, prepend=0))[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())), "<u8")


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Bit majority of the hashes of all word shingles; zero without words."""
    hashes = shingle_hashes(text, shingle, seed)
    return majority(hashes) if hashes.size else 0


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, hashes.size, 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > hashes.size, bitorder="little").tobytes(), "little")


def signed_code(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(doc_id, text_id, fp) of every row; a null text is empty."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("text_id", text_key("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            codes = pa.array([signed_code(fingerprint(t.as_py(), shingle)) for t in texts], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_id"), codes], names=["doc_id", "text_id", "fp"])

    return rows.mapInArrow(scan, f"doc_id {kind}, text_id binary, fp bigint")


def gray_rank(code: Column) -> Column:
    """Position of a code in the sequence of Gray codes, as an unsigned number moved into signed order."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _masks(distance: int) -> list[int]:
    at, blocks = 0, []
    for size in _BLOCKS:
        blocks.append(((1 << size) - 1) << at)
        at += size
    return [sum(c) for c in combinations(blocks, len(_BLOCKS) - distance)]


class GrayIndex:
    """Tree over codes in Gray order. ``levels`` go from the leaves up: pattern and own mask (bits not fixed above)."""

    def __init__(self, codes: np.ndarray):
        shared = [(codes, np.full(codes.size, ~np.uint64(0)))]
        while shared[-1][0].size > _FAN:
            pattern, mask = shared[-1]
            starts = np.arange(0, pattern.size, _FAN)
            all_and, all_or = np.bitwise_and.reduceat(pattern, starts), np.bitwise_or.reduceat(pattern, starts)
            shared.append((all_and, np.bitwise_and.reduceat(mask, starts) & ~(all_and ^ all_or)))
        self.levels = []
        for k, (pattern, mask) in enumerate(shared):
            above = shared[k + 1][1][np.arange(mask.size) // _FAN] if k + 1 < len(shared) else np.uint64(0)
            self.levels.append((pattern, mask & ~above))

    def search(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, code) of at most ``distance`` differing bits, by position."""
        pattern, own = self.levels[-1]
        who = np.repeat(np.arange(queries.size), pattern.size)
        node = np.tile(np.arange(pattern.size), queries.size)
        so_far = np.zeros(who.size, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, own = self.levels[depth]
            so_far = so_far + np.bitwise_count((queries[who] ^ pattern[node]) & own[node])
            keep = so_far <= distance
            who, node, so_far = who[keep], node[keep], so_far[keep]
            if depth:
                below = self.levels[depth - 1][0].size
                child = node[:, None] * _FAN + np.arange(_FAN)
                real = (child < below).ravel()
                who, so_far, node = np.repeat(who, _FAN)[real], np.repeat(so_far, _FAN)[real], child.ravel()[real]
        return who, node


def local_roots(codes: np.ndarray, distance: int, slice_size: int = 512) -> np.ndarray:
    """Position of the root of each code: the smallest position that links reach inside this tree."""
    index, label = GrayIndex(codes), np.arange(codes.size)
    for k in range(0, codes.size, slice_size):
        a, b = index.search(codes[k : k + slice_size], distance)
        a = a + k
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                break
            np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
    return label


def _link(distance: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(codes: np.ndarray) -> pa.RecordBatch | None:
            label = local_roots(codes.view(np.uint64), distance)
            far = label != np.arange(codes.size)
            a, b = codes[far], codes[label[far]]
            return pa.record_batch({"u": np.minimum(a, b), "v": np.maximum(a, b)}) if far.any() else None

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, top, code = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "top", "fp"))
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (top[1:] != top[:-1])) + 1
            for piece, at in zip(np.split(code, cuts), np.concatenate([[0], cuts])):
                if last != (part[at], top[at]):
                    codes = np.concatenate(held) if held else np.zeros(0, np.int64)
                    if codes.size > 1 and (out := solve(codes)) is not None:
                        yield out
                    held, last = [], (part[at], top[at])
                held.append(piece)
        codes = np.concatenate(held) if held else np.zeros(0, np.int64)
        if codes.size > 1 and (out := solve(codes)) is not None:
            yield out

    return link


def linked(codes: DataFrame, distance: int = 2) -> DataFrame:
    """(node, root) of every code in ``fp`` (distinct) that has a link of at most ``distance`` differing bits."""
    tops = F.array(*(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(signed_code(m))).alias("top"))
                     for k, m in enumerate(_masks(distance))))
    filed = codes.select("fp", F.inline(tops)).select("part", "top", "fp")
    filed = filed.repartition("part", "top").sortWithinPartitions("part", "top", gray_rank(F.col("fp")))
    return roots(filed.mapInArrow(_link(distance), "u bigint, v bigint").distinct(), ())


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, text_id, fp, component_id) of every row.

    component_id is the smallest doc_id that links reach, null where all doc_ids of the component are null. Rows without
    words have fingerprint zero and link like any other; repeated rows stay.
    """
    rows = saved(fingerprints(docs, text, doc_id, shingle), "fingerprints")
    codes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = linked(codes.select("fp"), distance).select(F.col("node").alias("fp"), "root")
    codes = codes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = codes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = codes.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_id", "fp", "root", "component_id")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row of each component, with all columns: that of the smallest doc_id, null ids last, ties by text hash."""
    return first_rows(docs, near_groups(docs, text, doc_id, shingle, distance), text, doc_id)


def first_rows(docs: DataFrame, rows: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each ``root`` of ``rows`` (doc_id, text_id, root)."""
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("_keep_id"), F.col("text_id").alias("_keep_text"))
    kept = rows.groupBy("root").agg(F.min(order).alias("k")).select("k._keep_id", "k._keep_text")
    key = text_key(F.coalesce(F.col(text), F.lit("")))
    out = docs.withColumn("_text_key", key).join(
        kept, F.col(doc_id).eqNullSafe(F.col("_keep_id")) & (F.col("_text_key") == F.col("_keep_text")), "left_semi")
    return out.dropDuplicates([doc_id, "_text_key"]).drop("_text_key")


def as_hex(code: Column) -> Column:
    return F.lpad(F.lower(F.hex(code)), 16, "0")

"""Groups of near copies: texts whose sets of word shingles have a Jaccard similarity of ``least`` or more.

Candidates are linked texts of the SimHash index (``simhash``, two bits apart, over the same shingles): copies and the
nearest of the near ones. At 0.8 two 64-bit codes differ in about ten bits, where an index over them no longer selects.
What lies further apart comes from several min-wise fingerprints: ``bands`` keys of ``rows`` minima each, of which two texts of similarity s
share none with probability (1 - s ** rows) ** bands: 7e-5 at 0.8 and 8e-7 at 0.85 with 24 keys of 5. Every link is
then checked on the sets themselves. Texts that share a key are first compared with a few texts of that key only; pairs
that are still in different components afterwards are all compared, so no pair of a shared key goes unseen and a large
group of copies costs its size, not its square. Comparing all is a product of token matrices over blocks of a key's
texts; every pair of blocks is a group of its own, and a group emits no more links than it has texts. Only texts that
share a key without being copies of each other cost the square of their number there, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fieldtide.llm.simhash import first_rows, linked, majority, shingle_hashes, signed_code
from fieldtide.llm.work import saved, text_key
from fieldtide.operators.components import roots

_PIVOTS = 3
_SLICE = 1 << 18


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Distinct hashes of the shingles; texts without words share one element."""
    hashes = np.unique(shingle_hashes(text, shingle))
    return hashes if hashes.size else np.zeros(1, "<u8")


def band_keys(sets: list[np.ndarray], bands: int, rows: int, seed: int = 5) -> np.ndarray:
    """Keys of every set, one row each: a hash of ``rows`` minima and the number of the band."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    turn = rng.integers(0, 1 << 63, bands * rows, np.uint64)
    starts = np.cumsum([0, *(s.size for s in sets[:-1])])
    hashes = np.concatenate(sets)
    least = np.stack([np.minimum.reduceat((hashes ^ t) * f, starts) for f, t in zip(factor, turn)], axis=1)
    wide = 8 * rows
    return np.array([[xxhash.xxh64_intdigest(row[k * wide : (k + 1) * wide], k) for k in range(bands)]
                     for row in (r.tobytes() for r in least)], np.uint64).view(np.int64)


def signed(docs: DataFrame, text: str, doc_id: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, node, keys, fp) of every row; a null text is empty, ``node`` identifies the text, ``fp`` is its SimHash."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.withColumn("node", text_key("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, codes, size, first = [], [], 0, 0
            for k, text in enumerate(batch.column("text").cast(pa.large_binary())):
                hashes = shingle_hashes(text.as_py(), shingle)
                codes.append(signed_code(majority(hashes) if hashes.size else 0))
                sets.append(np.unique(hashes) if hashes.size else np.zeros(1, "<u8"))
                size += sets[-1].size
                if size >= _SLICE or k + 1 == batch.num_rows:
                    keys = band_keys(sets, bands, rows)
                    keys = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
                    part = batch.slice(first, len(sets))
                    yield pa.record_batch([part.column("doc_id"), part.column("node"), keys, pa.array(codes, pa.int64())],
                                          names=["doc_id", "node", "keys", "fp"])
                    sets, codes, size, first = [], [], 0, k + 1

    return source.mapInArrow(scan, f"doc_id {dict(source.dtypes)['doc_id']}, node binary, keys array<bigint>, fp bigint")


def index_pairs(texts: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (node, p) that the SimHash index links: each text with the least of its code, that one with its root's.

    ``texts`` is (node, fp). There are no more pairs than texts, however large a group of one code or root.
    """
    firsts = texts.groupBy("fp").agg(F.min("node").alias("p"))
    near = linked(firsts.select("fp"), distance).filter("node <> root")
    above = firsts.select(F.col("fp").alias("root"), F.col("p").alias("q"))
    far = near.join(firsts, near["node"] == firsts["fp"]).select("p", "root").join(above, "root").select(F.col("p").alias("node"), F.col("q").alias("p"))
    return texts.join(firsts, "fp").select("node", "p").filter("node <> p").unionByName(far)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column("node"), batch.column("text").cast(pa.large_binary())):
                own = pa.array([shingle_set(text.as_py(), shingle).view(np.int64)], pa.list_(pa.int64()))
                yield pa.record_batch([pa.array([node.as_py()], pa.binary()), own], names=["node", "own"])

    return texts.select("node", "text").mapInArrow(scan, "node binary, own array<bigint>")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of similarity ``least`` or more."""
    side = lambda node, own: sets.select(F.col("node").alias(node), F.col("own").alias(own))
    rows = pairs.join(side("v", "b"), "v").join(side("u", "a"), "u")
    both = F.size(F.array_intersect("a", "b"))
    return rows.filter(both >= least * (F.size("a") + F.size("b") - both)).select("u", "v")


def overlaps(sets: list[np.ndarray], cells: int = 1 << 22) -> np.ndarray:
    """Number of common elements of every two sets, by products of 0-1 matrices over slices of the elements."""
    owner = np.repeat(np.arange(len(sets)), [s.size for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = np.cumsum(count > 1) - 1
    kept = count[token] > 1
    owner, token = owner[kept], twice[token[kept]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    both, step = np.zeros((len(sets), len(sets)), np.float32), max(1, cells // len(sets))
    many = int(token[-1]) + 1 if token.size else 0
    for first in range(0, many, step):
        a, b = np.searchsorted(token, (first, first + step))
        held = np.zeros((len(sets), min(step, many - first)), np.float32)  # most groups have few common elements
        held[owner[a:b], token[a:b] - first] = 1
        both += held @ held.T
    return both.astype(np.float64)


def block_links(nodes: list[bytes], root: list[bytes], sets: list[np.ndarray], least: float) -> list[tuple[bytes, bytes]]:
    """Pairs of similarity ``least`` or more that join what ``root`` leaves apart, none that earlier pairs already join."""
    both, size = overlaps(sets), np.array([s.size for s in sets])
    a, b = np.nonzero(np.triu(both >= least * (size[:, None] + size[None, :] - both), 1))
    label, out = np.unique(np.array([r.hex() for r in root]), return_inverse=True)[1], []
    apart = label[a] != label[b]
    for i, j in zip(a[apart], b[apart]):
        if label[i] != label[j]:
            label[label == label[j]] = label[i]
            out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    return out


def _block_links(least: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(nodes: list, root: list, sets: list) -> Iterator[pa.RecordBatch]:
            if len(set(root)) > 1 and (found := block_links(nodes, root, sets, least)):
                u, v = zip(*found)
                yield pa.record_batch({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})

        nodes, root, sets, last = [], [], [], None
        for batch in batches:
            own = batch.column("own")
            for k, at in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")))):
                if at != last:
                    yield from solve(nodes, root, sets)
                    nodes, root, sets, last = [], [], [], at
                nodes.append(batch.column("node")[k].as_py())
                root.append(batch.column("root")[k].as_py())
                sets.append(own[k].values.to_numpy().copy())
        yield from solve(nodes, root, sets)

    return link


def copy_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, least: float = 0.8,
                bands: int = 24, rows: int = 5, block: int = 512) -> DataFrame:
    """(doc_id, text_id, root) of every row; rows of one root are linked by near copies. Rows without words are one group."""
    found = saved(signed(docs, text, doc_id, shingle, bands, rows), "band-keys")
    near = saved(index_pairs(found.select("node", "fp").distinct()), "index-pairs")
    filed = found.dropDuplicates(["node"]).select(F.explode("keys").alias("key"), "node")
    h = F.xxhash64("node")
    shared = filed.groupBy("key").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).filter("lo <> hi").select("key")
    held = saved(filed.join(shared, "key"), "shared-keys")
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("node", text_key("text"))
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    compared = held.select("node").unionByName(near.select("node")).unionByName(near.select(F.col("p").alias("node"))).distinct()
    sets = saved(_sets(texts.join(compared, "node", "left_semi"), shingle), "shingle-sets")
    # Pivots of a key: the least nodes in a few orders of hashes.
    pivot = lambda k: F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node"))["node"]
    pivots = held.groupBy("key").agg(F.array(*(pivot(k) for k in range(_PIVOTS))).alias("p"))
    pairs = held.join(pivots, "key").select("node", F.explode(F.array_distinct("p")).alias("p")).filter("node <> p").unionByName(near)
    ordered = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    links = saved(_alike(pairs.select(*ordered("node", "p")).distinct(), sets, least), "pivot-links")
    label = roots(links, ())
    # What the pivots left apart: all pairs of one key between its components.
    named = held.join(label, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    g = F.xxhash64("root")
    apart = named.groupBy("key").agg(F.min(g).alias("lo"), F.max(g).alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi")
    named = named.join(apart.select("key", F.ceil(F.col("n") / block).cast("int").alias("n")), "key")
    # A text of block x meets every other block; two texts of one block meet in any of these.
    mine = F.pmod(F.xxhash64("node", F.lit(block)), F.col("n")).cast("int")
    others = F.when(F.col("n") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("n") - 1), F.col("mine")))
    named = named.withColumn("mine", mine).withColumn("other", F.explode(others))
    named = named.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "root")
    blocks = named.join(sets, "node").select("key", "i", "j", "node", "root", "own")
    blocks = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = saved(blocks.mapInArrow(_block_links(least), "u binary, v binary").distinct(), "block-links")
    if not more.isEmpty():
        # The stars of the first links stand for these: only what the new ones join is left to settle.
        label = roots(label.select(F.col("root").alias("u"), F.col("node").alias("v")).unionByName(more), ())
    out = found.select("doc_id", "node").join(label, "node", "left")
    return out.select("doc_id", F.col("node").alias("text_id"), F.coalesce("root", "node").alias("root"))


def copy_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **bounds) -> DataFrame:
    """One row of each group, with all columns: that of the smallest doc_id, null ids last, ties by text hash."""
    return first_rows(docs, copy_groups(docs, text, doc_id, **bounds), text, doc_id)

"""Merkle manifest of a dataset: leaves of documents, a tree per source, a tree over the sources, and a proof per document.

Leaves of a source are numbered by id: a range partitioning deals them out, and the counts of its parts are added up, so
that no task holds a source. A level hashes every ``FANOUT`` consecutive nodes into one. All of its siblings are lag and
lead columns of fixed offsets, masked by the node's slot in its run and the run's length; the first child of a run hashes
it into the parent. The windows run over blocks of whole runs, never over a source. A level has a sixteenth of the rows
of the one below; proofs are handed down from the root, each level joining only its own nodes with their parents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldtide.llm.work import lower_ascii, saved

FANOUT = 16
_BLOCK = FANOUT * 16
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with p, the place in their group ``g`` from 0 by ``order`` (nulls first), and n, the rows of the group."""
    dealt = saved(rows.repartitionByRange("g", *order).withColumn("part", F.spark_partition_id()), "merkle-dealt")
    counts = dealt.groupBy("g", "part").agg(F.count(F.lit(1)).alias("rows"))
    group = W.partitionBy("g")
    ahead = F.sum("rows").over(group.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("g", "part", F.coalesce(ahead, F.lit(0)).alias("ahead"), F.sum("rows").over(group).alias("n"))
    place = F.row_number().over(W.partitionBy("g", "part").orderBy(*order)) - 1
    placed = dealt.withColumn("place", place).join(counts, ["g", "part"])
    return placed.withColumn("p", F.col("place") + F.col("ahead")).drop("part", "place", "ahead")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes with ``left`` and ``right``: the digests of the others of their run, concatenated."""
    here = W.partitionBy("g", F.floor(F.col("p") / _BLOCK)).orderBy("p")
    slot = F.col("p") % FANOUT
    length = F.least(F.lit(FANOUT), F.col("n") - F.col("p") + slot)
    left = [F.when(slot >= k, F.lag("h", k).over(here)).otherwise("") for k in range(FANOUT - 1, 0, -1)]
    right = [F.when(slot + k < length, F.lead("h", k).over(here)).otherwise("") for k in range(1, FANOUT)]
    return nodes.withColumns({"left": F.concat(*left), "right": F.concat(*right)})


def parents(nodes: DataFrame) -> DataFrame:
    """(g, p, n, h) of the next level. A group of one node has none."""
    first = with_siblings(nodes.filter("n > 1").select("g", "p", "n", "h")).filter(F.col("p") % FANOUT == 0)
    return first.select("g", F.floor(F.col("p") / FANOUT).alias("p"), F.ceil(F.col("n") / FANOUT).alias("n"),
                        F.sha2(F.concat("h", "right"), 256).alias("h"))


def levels(nodes: DataFrame) -> list[DataFrame]:
    """All levels from ``nodes`` upward, until every group has one node. Each is written and read again."""
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(saved(parents(out[-1]), "merkle-level"))
        most = -(-most // FANOUT)
    return out


def subroots(tree: list[DataFrame]) -> DataFrame:
    """(g, h): the last node of every group."""
    ends = [nodes.filter("n = 1").select("g", "h") for nodes in tree]
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return out


def with_paths(tree: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Nodes of the lowest level with ``path``, (left, right) of each level upward, and the columns of ``tops``.

    ``tops`` has one row for every group: g, the path from its last node on, and columns to hand down.
    """
    handed = [c for c in tops.columns if c not in ("g", "path")]
    above: DataFrame | None = None
    for nodes in reversed(tree):
        found = nodes.filter("n = 1").join(tops, "g").select(*nodes.columns, "path", *handed)
        if above is not None:
            own = with_siblings(nodes.filter("n > 1")).withColumn("up", F.floor(F.col("p") / FANOUT))
            step = F.array(F.struct("left", "right"))
            inner = own.join(above.withColumnRenamed("p", "up"), ["g", "up"])
            found = found.unionByName(inner.select(*nodes.columns, F.concat(step, "path").alias("path"), *handed))
        above = found.select("g", "p", "path", *handed)
    return found


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, concatenated from the leaf's level upward, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def manifest(docs: DataFrame, received: dict[str, Column] | None = None, fields: Sequence[str] = _FIELDS, source: str = "source",
             doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, source, leaf, received_leaf, path, subroot, root.

    ``fields`` make up a leaf. ``received`` maps fields to the values that a receiver holds: received_leaf is the leaf of
    these, path and roots are those of ``docs``. A leaf's place in its source is by id, null first, then by leaf; null is
    a source of its own, ahead of the others. Equal rows have neighbouring leaves of one digest, and their proofs are
    those of different places. No documents give no rows. Other columns are not read.
    """
    received = received or {}
    values = [F.col(c) for c in fields]
    group = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))
    rows = docs.select(group.alias("g"), F.col(doc_id).alias("id"), leaf(values).alias("h"),
                       (leaf([received.get(c, F.col(c)) for c in fields]) if received else F.lit(None).cast("string")).alias("changed"))
    # Hashed once: the sampling of the range partitioning reads the leaves, not the texts.
    rows = saved(rows.withColumn("changed", F.when(F.col("changed") != F.col("h"), F.col("changed"))), "merkle-leaves")
    tree = levels(saved(numbered(rows, ["id", "h"]), "merkle-nodes"))
    tops = subroots(tree).select(F.lit("").alias("g"), F.col("g").alias("of"), "h")
    crown = levels(saved(numbered(tops, ["of"]), "merkle-nodes"))
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    root = subroots(crown).select("g", no_path.alias("path"), F.col("h").alias("root"))
    tops = with_paths(crown, root).select(F.col("of").alias("g"), "path", F.col("h").alias("subroot"), "root")
    found = with_paths(tree, tops)
    return found.select(
        F.col("id").alias("doc_id"), F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias("source"), F.col("h").alias("leaf"),
        F.coalesce("changed", "h").alias("received_leaf"), "path", "subroot", "root")


def tampered(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text in lower case (A-Z) where 5 divides the CRC-32 of the id, else as it is."""
    hit = F.crc32(F.col(doc_id).cast("string")) % 5 == 0
    return F.when(F.coalesce(hit, F.lit(False)), lower_ascii(F.col(text))).otherwise(F.col(text))


def _sql(depth: int = 5) -> str:
    """The same in SQL, for sources and numbers of sources up to 16 ** depth."""
    fields = lambda text: " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    step = "list_reduce(list_concat([xor(c, b)], [0::BIGINT FOR i IN range(8)]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    crc = f"xor(list_reduce(list_concat([4294967295], [ascii(d)::BIGINT FOR d IN string_split(doc_id::VARCHAR, '')]), lambda c, b: {step}), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"base AS (SELECT doc_id, coalesce('s' || source, '') AS g, sha256({fields('text')}) AS h, "
        f"CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN sha256({fields(lower)}) ELSE sha256({fields('text')}) END AS held FROM documents)",
        "t0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM base)",
    ]
    for name in "tu":
        for k in range(depth):
            parts.append(f"{name}{k + 1} AS (SELECT g, p // 16 AS p, (n + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY p)) AS h "
                         f"FROM (SELECT g, p, n, h FROM {name}{k}) WHERE n > 1 GROUP BY g, p // 16, n)")
        for k in range(depth):
            parts.append(
                f"{name}s{k} AS (SELECT a.g, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS lft, "
                f"coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS rgt FROM {name}{k} a JOIN {name}{k} b "
                f"ON a.g = b.g AND a.p // 16 = b.p // 16 WHERE a.n > 1 GROUP BY a.g, a.p)")
        ends = " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(depth + 1))
        parts.append(f"{name}ends AS ({ends})")
        if name == "t":
            parts.append("u0 AS (SELECT '' AS g, g AS of_, h, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM tends)")
    parts.append("f0 AS (SELECT t.doc_id, t.g, t.p, t.h AS leaf, t.held AS now, '' AS proof, u.h AS subroot, u.p AS up, r.h AS root "
                 "FROM t0 t JOIN u0 u ON t.g = u.of_ CROSS JOIN uends r)")
    for k in range(2 * depth):
        name, at, on = ("t", "f.p", "s.g = f.g") if k < depth else ("u", "f.up", "true")
        level = k % depth
        parts.append(
            f"f{k + 1} AS (SELECT f.doc_id, f.g, f.p, leaf, subroot, up, root, proof || coalesce(s.lft || s.rgt, '') AS proof, "
            f"CASE WHEN s.lft IS NULL THEN now ELSE sha256(s.lft || now || s.rgt) END AS now "
            f"FROM f{k} f LEFT JOIN {name}s{level} s ON {on} AND s.p = {at} // {16 ** level})")
    return ("WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, "
            f"now = root AS verified FROM f{2 * depth}")


SQL = _sql()

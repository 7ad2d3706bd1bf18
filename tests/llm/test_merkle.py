"""Merkle manifest against a plain recursive build."""

import hashlib
import zlib

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import fieldtide
from fieldtide.llm import merkle

cloudpickle.register_pickle_by_value(fieldtide)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, g string, p int, h string, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests):
    """The root, and for each leaf the (left, right) of its runs upward."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for k, place in enumerate(at):
            run = place // 16 * 16
            paths[k].append(("".join(level[run:place]), "".join(level[place + 1 : run + 16])))
            at[k] = place // 16
        level = [sha(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0], paths


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in sources:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1]), r) for r in rows if r[3] == s), key=lambda x: x[:3])
        built[s] = ([x[2:] for x in own], *tree([x[2] for x in own]))
    root, crown = tree([built[s][1] for s in sources])
    for s, up in zip(sources, crown):
        for (digest, r), path in zip(built[s][0], built[s][2]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf(r[0], r[3], r[2], r[4], r[1].translate(lower)) if hit and r[1] is not None else digest
            proof = ""
            for left, right in path + up:
                now, proof = sha(left, now, right), proof + left + right
            yield r[0], digest, built[s][1], root, sha(proof), now, now == root


def query(docs):
    rows = merkle.manifest(docs, {"text": merkle.tampered()})
    folded = merkle.fold(F.col("received_leaf"), F.col("path"))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256), folded, folded == F.col("root"))


def check(spark, rows):
    got = [tuple(r) for r in query(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def row(k, source, text="Some Text", **more):
    return (k, text, more.get("lang", "en"), source, more.get("n", 9), "x", 1, "y", "z")


def test_sources_of_many_sizes(spark):
    rows = [row(k, "hot", f"Text {k}") for k in range(300, 0, -1)]
    rows += [row(1000 + k, f"s{k % 23}é", None if k % 7 == 0 else "" if k % 5 == 0 else f"A{k}") for k in range(60)]
    rows += [row(2000, None, "Ünï"), row(2001, "", "x" * 50_000), row(2002, "Z", "漢字 ABC", lang=None, n=None)]
    check(spark, rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [row(5, "a"), row(5, "a"), row(5, "a", "other"), row(None, "a"), row(None, "a", None), row(None, None, None, lang=None, n=None)]
    rows += [row(7, "b")] * 20
    check(spark, rows)


@pytest.mark.parametrize("count", [1, 2, 16, 17, 256, 257])
def test_run_borders(spark, count):
    check(spark, [row(k, "one") for k in range(count)])


def test_no_rows(spark):
    assert query(spark.createDataFrame([], SCHEMA)).collect() == []

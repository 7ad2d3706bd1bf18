"""Fingerprints and scores of whole queries and models against plain reimplementations."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark import cloudpickle
from pyspark.sql import functions as F

import fieldtide
from fieldtide.llm import queries, toxicity
from fieldtide.llm.quality import Quality
from fieldtide.llm.toxicity import Toxicity

cloudpickle.register_pickle_by_value(fieldtide)
SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def spark_hash(*values):
    """XXH64 over several columns, each seeded with the hash so far; nulls change nothing."""
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<q", v) if isinstance(v, int) else struct.pack("<i", v[0])
            h = xxhash.xxh64_intdigest(data, h)
    return signed(h)


def order_signature(text, k=2, least=2):
    words = re.findall(r"[^\x20\x09-\x0D]{1,8}", text)
    grams = [spark_hash(*(words[i + j] if i + j < len(words) else None for j in range(k))) for i in range(max(len(words) - k + 1, min(1, len(words))))]
    seen, buckets = {}, {}
    for place, gram in enumerate(grams):
        name = signed((gram << 26) % (1 << 64)) >> 26
        number = seen[name] = seen.get(name, -1) + 1
        h = spark_hash(name, (number,)) % (1 << 64)
        buckets.setdefault(h & 31, []).append((h >> 32, place))
    out = {}
    for bucket, items in buckets.items():
        code = [c for c, _ in sorted(sorted(items)[:least], key=lambda x: x[1])]
        out[bucket if bucket < 16 else bucket - 32] = spark_hash(*([-1] * (least - len(code)) + code)) & 0xFFFF
    return out




def test_order_minhash_query(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(50)] + ["naïve", "漢字", "verylongwordofmanycharacters", "a"]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 90)))) for _ in range(40)] + ["", None, " \t\n", "x", "a a a a a a a a a", "z" * 5000]
    rows = [(int(k * 7 % 46), t) for k, t in enumerate(texts)] + [(5, "again and again"), (5, "again and again"), (None, "no id"), (None, texts[0])]
    spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id bigint, text string, sig string, n_chars int").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op6_order_minhash(spark, str(tmp_path)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), spark_hash(r[1])))
    expected = []
    share = lambda a, b: 1.0 if not a and not b else sum(a.get(x) == b.get(x) for x in a.keys() | b.keys()) / len(a.keys() | b.keys())
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        cut = len(t) // 3
        changed = t[: len(t) - cut] + after[:cut]
        s, e, n = order_signature(t), order_signature(changed), order_signature(after)
        expected.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), round(share(s, e), 9), round(share(s, n), 9), len(s) * 6))
    mine = [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9), len(r["fingerprint"])) for r in got]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert [r[:5] for r in sorted(mine, key=key)] == [r[:5] for r in sorted(expected, key=key)]


def plain_score(model, text):
    words = re.findall(rb"[0-9a-z'\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text))
    row = {int(b): k + 1 for k, b in enumerate(model.known)}
    widest = max(b.shape[0] for b in model.banks)
    ids = [row.get(1 + zlib.crc32(w) % (toxicity.BUCKETS - 1), 0) for w in words]
    ids += [0] * (widest - len(ids))
    z, at = model.out_bias, 0
    for bank, bias in zip(model.banks, model.biases):
        width, _, filters = bank.shape
        for f in range(filters):
            best = max(sum(float(model.embed[ids[i + w]] @ bank[w, :, f]) for w in range(width)) for i in range(len(ids) - width + 1))
            z += max(best + float(bias[f]), 0) * float(model.out[at])
            at += 1
    return 1 / (1 + np.exp(-z))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_scores(spark, tables):
    docs, labels = tables
    fitted = Toxicity.fit(docs, labels)
    rows = [(1, "Some WORDS don't fit"), (2, ""), (3, None), (4, "x"), (5, "é 漢字 ' \x00 12"), (6, "word " * 9000 + "last")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(docs.select("doc_id", "text"))
    for r in df.select("text", fitted.scores(F.col("text")).alias("s")).collect():
        text = (r["text"] or "").encode()
        if len(text) < 3000 or len(set(text)) < 10:
            assert r["s"] == pytest.approx(plain_score(fitted.model, text), abs=1e-5)


def test_repeated_rows_and_ties_teach_once(spark, tables):
    docs, labels = tables
    doubled = Toxicity.fit(docs.unionByName(docs), labels.unionByName(labels))
    once = Toxicity.fit(docs, labels)
    assert doubled.threshold == once.threshold and np.array_equal(doubled.model.embed, once.model.embed)


def test_the_network_beats_a_word_table():
    """Labels that hang on pairs of words: each word by itself is as common in either class."""
    rng = np.random.default_rng(4)
    other = [f"w{k}".encode() for k in range(60)]
    texts, labels = [], []
    for k in range(2400):
        words = list(rng.choice(other, 25))
        a, b = [(b"harm", b"you"), (b"love", b"time"), (b"harm", b"time"), (b"love", b"you")][k % 4]
        at = int(rng.integers(0, 20))
        words[at : at + 2] = [a, b]
        texts.append(b" ".join(words))
        labels.append(float(k % 4 < 2))
    labels, own = np.array(labels), np.arange(2400) < 1800
    buckets = toxicity.WordBuckets()
    ids = [toxicity.word_ids(t, buckets, 3) for t in texts]
    model = toxicity.train([i for i, k in zip(ids, own) if k], labels[own], epochs=40)
    tables, known = model.tables(), toxicity.WordBuckets(model.known)
    kept = np.flatnonzero(~own)
    scores = np.array([model.score(toxicity.word_ids(texts[k], known, 3), tables) for k in kept])
    rows = [np.unique([known[w] for w in texts[k].split()]) for k in kept]
    odds = toxicity.log_odds([np.array([known[w] for w in texts[k].split()]) for k in np.flatnonzero(own)], labels[own], np.ones(own.sum()), model.known.size + 1)
    table = np.array([odds[r].max() for r in rows])
    right = lambda s: np.mean([(a > b) + 0.5 * (a == b) for a in s[labels[kept] == 1] for b in s[labels[kept] == 0]])
    assert right(table) < 0.65 < 0.9 < right(scores)


def test_quality_scores(spark, tables):
    docs, labels = tables
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    model = Quality.fit(docs, labels.select("doc_id", grade.alias("grade")), 3)
    m = model.model
    row = {int(b): k + 1 for k, b in enumerate(m.known)}
    df = docs.select("text").unionByName(spark.createDataFrame([("",), (None,), ("a a a",), ("same same",), ("same same",)], "text string"))
    for r in df.select("text", model.tails(F.col("text")).alias("t")).collect():
        text = (r["text"] or "").encode()
        words = set(re.findall(rb"[0-9a-z'\x80-\xff]+", re.sub(rb"[A-Z]", lambda x: x[0].lower(), text)))
        rows = {row.get(1 + zlib.crc32(w) % (toxicity.BUCKETS - 1), 0) for w in words} - {0}
        counts = np.zeros(128)
        for b in text:
            if b < 128:
                counts[65 if 65 <= b < 91 else 97 if 97 <= b < 123 else 48 if 48 <= b < 58 else b] += 1
        shares = np.log1p(counts * 1000 / max(1, len(text))) / 7
        place = sum(m.words[k] for k in rows) / np.sqrt(1 + len(text) / 50) + shares @ m.shares
        expected = 1 / (1 + np.exp(-(place - m.thresholds)))
        assert r["t"] == pytest.approx(expected.tolist(), abs=1e-5)

"""Operators of the llm subpackage against brute force, with nulls, empty and long texts, ties, repeated rows and no rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark import cloudpickle
from pyspark.sql import functions as F

import fieldtide
from fieldtide.llm import licences, mixing, orderhash, topk, warc
from fieldtide.llm.pieces import Vocabulary, decode, encode
from fieldtide.llm.quality import Quality
from fieldtide.llm.repeats import remove_repeats
from fieldtide.llm.simhash import as_hex, local_roots, near_dedup, near_groups
from fieldtide.llm.toxicity import Toxicity

cloudpickle.register_pickle_by_value(fieldtide)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, fp int"
WORDS = "alpha beta gamma delta rho sigma tau phi chi psi omega the of and élan naïve 漢字".split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage = prose(60)
    texts = [prose(rng.randrange(5, 120)) for _ in range(40)]
    texts += [prose(20) + passage + prose(15) for _ in range(5)] + [passage, passage]
    texts += [texts[0], texts[0], texts[1] + "x", None, "", "  \t", "a", "A b", "ab" * 600, "z" * 1000, prose(9000), "▁▁ ▁ x", "\x00 nul"]
    out = [(k, t, rng.choice(["en", "fr", None]), f"s{k % 4}" if k % 9 else None, None, "extra", k) for k, t in enumerate(texts)]
    return [*out, out[3], (None, texts[2], "en", "s1", 1, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, expected):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def brute_repeats(texts, length):
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(x and (i == 0 or not gone[i - 1]) for i, x in enumerate(gone))
        yield len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, x in zip(t, gone) if not x)).hexdigest()


@pytest.mark.parametrize("bounds", [{}, {"most_strings": 2, "batch_strings": 3}])
def test_repeats(docs, rows, bounds):
    got = remove_repeats(docs.select("doc_id", "text"), **bounds).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    found = brute_repeats([(r[1] or "").encode() for r in rows], 200)
    same(got, [(r[0], *x) for r, x in zip(rows, found)])


def test_repeats_of_nothing(empty):
    assert remove_repeats(empty).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words)] if 0 < len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, empty):
    codes = [brute_fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(codes):
            for j, b in enumerate(codes):
                if (a ^ b).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    ids = {g: min((r[0] for r, x in zip(rows, label) if x == g and r[0] is not None), default=None) for g in set(label)}
    groups = near_groups(docs)
    same(groups.select("doc_id", as_hex(F.col("fp")), "component_id").collect(),
         [(r[0], f"{c:016x}", ids[g]) for r, c, g in zip(rows, codes, label)])
    kept = near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    assert near_groups(empty).count() == 0 and near_dedup(empty).count() == 0


def test_gray_index_in_a_dense_group():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    codes = np.unique(np.concatenate([b ^ np.bitwise_or(np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64),
                                                      np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) for b in base]))
    links = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
    label = np.arange(codes.size)
    while True:
        new = np.where(links, label[None, :], codes.size).min(axis=1)
        if np.array_equal(new, label):
            break
        label = new
    assert np.array_equal(local_roots(codes, 2, slice_size=100), label)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(int(i), [float(x) for x in rng.normal(0, 0.3, 12)]) for i in range(300)]
    vectors += [(300 + i, vectors[i % 3][1]) for i in range(60)]  # ties
    odd = [(1000, None), (1020, [float("nan")] * 12), (1040, [None] * 12), (1060, [float("inf")] * 12), (None, [0.1] * 12), (1080, [0.5] * 3), (1100, [])]
    df = spark.createDataFrame(vectors + odd, "vec_id bigint, embedding array<float>")
    whole = {i: np.floor(64 * np.array(v + [0.0] * (12 - len(v)), np.float32).astype(float)).astype(int) for i, v in vectors + [odd[5], odd[6]]}
    expected = []
    for q in (i for i in whole if i % 20 == 0):
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:20]
        expected += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    for sizes in ({}, {"block_rows": 70, "block_queries": 4}):
        same(topk.top_rows(df, F.col("vec_id") % 20 == 0, **sizes).collect(), expected)
    assert topk.top_rows(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_rows(df.filter("vec_id < 8"), F.col("vec_id") % 20 == 0).count() == 7


def test_warc(spark, tmp_path):
    long = "é" * 60 + "\r\n\r\nWARC/1.1\r\n"
    pages = [(5, "http://a/ b", long), (2, None, long), (9, "u", long), (9, "u", long), (7, "u\r\nX: y", "short"), (8, "u", "short"),
             (11, "u", None), (None, "u", long), (12, "u", "x" * 99), (13, "u", "x" * 99), (14, "u", "x" * 100), (15, "u", "x" * 100)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, digest string")
    warc.write_archives(df, str(tmp_path / "w"), per_file=3)
    got = warc.read_archives(spark, str(tmp_path / "w"))
    original = {long: 2, "x" * 100: 14}
    expected = []
    for i, _, html in pages:
        raw = (html or "").encode()
        first = original.get(html)
        visit = first is not None and first != i
        expected.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if visit else "response", first if visit else None, None if visit else raw))
    same([(*r[:5], None if r[6] is None else bytes(r[6])) for r in got.drop("x").collect()], expected)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs, per_bucket=6).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2), per_bucket=6).collect()))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for r in rows:
        total[r[3]] += size(r[1])
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(total.values())
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * total[s]}
        if not full:
            break
        target |= {s: 2.0 * total[s] for s in full}
        free, left = free - full, left - sum(2 * total[s] for s in full)
        if not free:
            break
    target |= {s: level * weight[s] for s in free}
    assert len(got) == len(rows)
    for r in got:
        assert r["_size"] == size(r["text"]) and r["_source_size"] == total[r["source"]]
        assert r["_target"] == pytest.approx(target[r["source"]]) and 0 <= r["_copies"] <= 2
    assert mixing.emit(mixing.mix(docs)).columns == docs.columns
    assert mixing.mix(empty).count() == 0


def brute_pieces(text, vocabulary):
    if not text:
        return []
    scores = {p: (i, s) for p, i, s in zip(vocabulary.pieces, vocabulary.ids.tolist(), vocabulary.scores.tolist())}
    units = ["▁" if c == " " else "" if c == "▁" else c for c in " " + text]
    best, back = [0.0] + [-np.inf] * len(units), [None] * (len(units) + 1)
    for i, c in enumerate(units):
        for j in range(i + 1, min(len(units), i + 48) + 1):
            piece = "".join(units[i:j]).encode()
            if "" not in units[i:j] and piece in scores and best[i] + scores[piece][1] > best[j]:
                best[j], back[j] = best[i] + scores[piece][1], (i, [scores[piece][0]])
        if not c or c.encode() not in scores:
            value = best[i] + vocabulary.scores.min() - 10
            if value > best[i + 1]:
                best[i + 1], back[i + 1] = value, (i, vocabulary.byte_ids[list((c or "▁").encode())].tolist())
    out, j = [], len(units)
    while j:
        j, ids = back[j]
        out = ids + out
    return out


def test_pieces(spark, docs, rows, empty):
    vocabulary = Vocabulary.load("/opt/tokenizers/piece_bpe_32k.model")
    coded = decode(encode(docs, vocabulary, batch_bytes=2000), vocabulary).select("doc_id", "text", "ids", "decoded").collect()
    assert len(coded) == len(rows)
    for r in coded:
        assert r["decoded"] == (r["text"] or "")
        if len(r["text"] or "") < 1500:
            assert r["ids"] == brute_pieces(r["text"], vocabulary)
    assert decode(encode(empty, vocabulary), vocabulary).count() == 0


def test_order_minhash(spark, docs, rows, empty):
    raw = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    sign = lambda df: orderhash.add_signature(df, "text", "sig")
    found = orderhash.with_next(raw, ["text", "sig"], sign, parts=4).collect()
    assert len(found) == len(rows)
    ids = sorted({r[0] for r in rows if r[0] is not None}, reverse=True)
    by_id = {r[0]: (r[1] or "") for r in rows}
    for r in found:
        if r["doc_id"] in ids[:-1] and r["doc_id"] != rows[3][0]:
            assert r["next_text"] == by_id[ids[ids.index(r["doc_id"]) + 1]]
    signatures = {}
    for r in found:
        assert signatures.setdefault(r["text"], r["sig"]) == r["sig"] and len(r["sig"]) <= 32
    assert signatures[""] == [] and len(signatures["a"]) == 1
    # Moving a block changes the order signature of a text whose set of k-mers stays nearly the same.
    words = [f"w{k}" for k in range(400)]
    pair = spark.createDataFrame([(" ".join(words), " ".join(words[200:] + words[:200]), " ".join(words[:395] + ["q"] * 5))], "a string, b string, c string")
    for c in "abc":
        pair = orderhash.add_signature(pair, c, f"s{c}")
    near = pair.select(orderhash.likeness(F.col("sa"), F.col("sb")), orderhash.likeness(F.col("sa"), F.col("sc")), orderhash.likeness(F.col("sa"), F.col("sa"))).first()
    assert near[0] < 0.8 < near[1] <= near[2] == 1.0
    assert orderhash.with_next(sign(empty.withColumn("_tie", F.lit(0))), ["text", "sig"], lambda df: df).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(600):
        words = [rng.choice(base) for _ in range(rng.randrange(5, 60))]
        toxic = k % 6 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "scum"]))
        rows.append((k, " ".join(words), "en" if k % 2 else None, int(toxic)))
    df = spark.createDataFrame(rows + [(None, None, None, None), (9999, "", "xx", None), (9998, "vile " * 20000, "en", None)], "doc_id bigint, text string, lang string, y int")
    labels = df.select("doc_id", F.col("y").alias("toxic"))
    fitted = Toxicity.fit(df, labels)
    got = df.select("doc_id", "y", fitted.scores(F.col("text")).alias("s"), F.crc32(F.col("doc_id").cast("string")).alias("c")).collect()
    held = [r for r in got if r["c"] is not None and r["c"] % 4 == 2 and r["y"] is not None]
    assert len(got) == 603 and all(0 <= r["s"] <= 1 for r in got)
    assert np.mean([(r["s"] >= 0.3) == (r["y"] == 1) for r in held]) > 0.95
    nothing = Toxicity.fit(empty, labels.limit(0))
    assert nothing.model is None and empty.select(nothing.scores(F.col("text"))).count() == 0


def test_quality(spark, empty):
    rng = random.Random(5)
    good, bad = [f"w{k}" for k in range(200)], ["##", "!!!", "|"]
    rows = []
    for k in range(600):
        grade = k % 3
        words = [rng.choice(good if rng.random() < 0.4 + 0.3 * grade else bad) for _ in range(40)]
        rows.append((k, " ".join(words), grade))
    df = spark.createDataFrame(rows + [(None, None, None), (7777, "", None)], "doc_id bigint, text string, grade int")
    fitted = Quality.fit(df, df.select("doc_id", "grade"), 3)
    assert fitted.model.thresholds[0] < fitted.model.thresholds[1]
    got = df.select("grade", fitted.tails(F.col("text")).alias("t")).collect()
    assert all(1 >= r["t"][0] >= r["t"][1] >= 0 for r in got)
    mean = [np.mean([sum(r["t"]) for r in got if r["grade"] == g]) for g in range(3)]
    assert mean[0] < 0.5 < mean[1] < 1.5 < mean[2]
    assert Quality.fit(empty, df.select("doc_id", "grade").limit(0), 3).model is None


def test_licences(spark, docs, empty):
    model = licences.train(["some ordinary words of the text here"] * 50 + ["we saw it by the river and in the town"] * 50)
    texts = [(1, "Prose first.\nReleased under the MIT License.\nmore"), (2, "Licensed under CC BY-NC 4.0."), (3, "a license to kill"),
             (4, None), (5, ""), (None, "x\r\n\r\nThis work is licensed under the GNU General Public License, version 3.")]
    df = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id bigint, text string, family string")
    got = licences.scan(df, model).select("doc_id", "paragraph", "line", "family", "confirmed").collect()
    same(got, [(1, 0, 1, "mit", True), (2, 0, 0, "cc-by-nc", True), (None, 1, 0, "gpl", True)])
    assert licences.scan(empty, model).count() == 0 and licences.scan(docs, model).count() == 0

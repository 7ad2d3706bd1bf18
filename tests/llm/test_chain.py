"""run() of the corpus pipeline on a planted table against a plain chain of the same decisions."""

import hashlib
import random
import re
import shutil
from collections import Counter
from pathlib import Path

import pytest
from pyspark import cloudpickle

import corpus_pipeline
import fieldtide
from fieldtide.llm import toxicity
from fieldtide.llm.copies import copy_groups
from fieldtide.llm.pieces import Vocabulary, decode
from fieldtide.llm.queries import PIECES
from fieldtide.llm.work import written

cloudpickle.register_pickle_by_value(fieldtide)
SF = Path("/root/testdata/sf0.001")


def word_set(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def groups(texts):
    """Root position of every text: smallest position that links of similarity 0.8 reach."""
    sets, root = [word_set(t) for t in texts], list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(k) for k in range(len(texts))]


def without_repeats(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    starts = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    for t, r in zip(texts, raw):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if starts[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield None if t is None else bytes(b for b, g in zip(r, gone) if not g).decode("utf-8", "ignore")


def copies_of(rows, weights=(3.0, 1.0, 2.0), per_bucket=2_000):
    """How often the mix takes each (doc_id, source, text)."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    held = {s: sum(n for n, r in zip(size, rows) if r[1] == s) for s in sources}
    weigh = {s: weights[k % 3] for k, s in enumerate(sources)}
    target, left, open_ = {}, 1.5 * sum(size), set(sources)
    while open_:
        total = sum(weigh[s] for s in open_)
        full = {s for s in open_ if left * weigh[s] / total >= 2 * held[s]}
        if not full:
            target |= {s: left * weigh[s] / total for s in open_}
            break
        for s in full:
            target[s] = 2.0 * held[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    out = [0] * len(rows)
    for s in sources:
        own = [k for k, r in enumerate(rows) if r[1] == s]
        buckets = len(own) // per_bucket + 1
        key = lambda k: ((b := (rows[k][0] + size[k]) % buckets), size[k] if b % 2 == 0 else -size[k], rows[k][0])
        u = int(hashlib.md5(f"11:{'s' + s if s is not None else ''}".encode()).hexdigest()[:8], 16) / 2**32
        rate = target[s] / held[s] if held[s] else 0.0
        for place, k in enumerate(sorted(own, key=key), 1):
            out[k] = int(u + rate * place) - int(u + rate * (place - 1))
    return out


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(8)
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    texts = [r["text"] for r in docs.orderBy("doc_id").select("text").collect()]
    long = [t for t in texts if t and len(t.split()) > 60]
    rows = []

    def plant(text):
        rows.append((5000 + len(rows), text, rng.choice(["en", "de", None]), rng.choice(["src0", "planted", None]), len(text or "")))

    for t in long[:6]:
        for k in range(4):  # copies, and near copies of growing distance
            words = t.split(" ")
            for _ in range(k * len(words) // 60):
                words[rng.randrange(len(words))] = rng.choice(["changed", "other"])
            plant(" ".join(words))
    passage = " ".join(rng.choice("alpha beta gamma delta rho sigma tau naïve 漢字".split()) for _ in range(70))
    for k in range(5):
        plant(" ".join(rng.choice("one two three four five six".split()) for _ in range(40)) + f" {k}\n{passage}\n{k} " + " ".join(rng.choice("ten eleven twelve".split()) for _ in range(30)))
    for t in (None, "", "  ", "x"):
        plant(t)
    folder = tmp_path_factory.mktemp("planted")
    extra = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.unionByName(extra.select(docs.columns)).write.parquet(str(folder / "documents.parquet"))
    shutil.copytree(SF / "labels.parquet", folder / "labels.parquet") if (SF / "labels.parquet").is_dir() else shutil.copy(SF / "labels.parquet", folder)
    return str(folder)


def test_run_equals_a_plain_chain(spark, planted):
    docs, labels = (spark.read.parquet(f"{planted}/{t}.parquet") for t in ("documents", "labels"))
    rows = [tuple(r) for r in docs.orderBy("doc_id").select("doc_id", "source", "text", "lang").collect()]
    fitted = toxicity.Toxicity.fit(docs, labels)
    model, tables, buckets = fitted.model, fitted.model.tables(), toxicity.WordBuckets(fitted.model.known)
    score = lambda t: model.score(toxicity.word_ids((t or "").encode(), buckets, model.widest), tables)
    clean = [r for r in rows if score(r[2]) < fitted.by_lang.get(r[3] or "", fitted.threshold)]
    root = groups([r[2] for r in clean])
    kept = [r for k, r in enumerate(clean) if root[k] == k]
    assert len(rows) > len(clean) > len(kept) > 150
    cut = list(without_repeats([r[2] for r in kept]))
    assert sum(a != r[2] for a, r in zip(cut, kept)) >= 5
    cleaned = [(r[0], r[1], t) for r, t in zip(kept, cut)]
    expected = Counter()
    for (i, _, t), n in zip(cleaned, copies_of(cleaned)):
        expected[i, t or ""] += n
    before = written()
    out = corpus_pipeline.run(spark, planted)
    assert len(written()) == len(before) + 1  # only the last stage's table is left
    got = Counter((r["doc_id"], r["decoded"]) for r in decode(out, Vocabulary.load(PIECES)).select("doc_id", "decoded").collect())
    assert got == +expected


def test_recall_by_similarity(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    rows, pairs = [], []
    for k in range(240):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 160))]
        other = list(base)
        for _ in range(max(1, int(len(base) * (k % 8) * 0.006))):
            other[rng.randrange(len(other))] = rng.choice(words)
        a, b = word_set(" ".join(base)), word_set(" ".join(other))
        pairs.append((2 * k, 2 * k + 1, len(a & b) / len(a | b)))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    root = {r["doc_id"]: r["root"] for r in copy_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    bands = {low: [root[a] == root[b] for a, b, s in pairs if low <= s < high] for low, high in ((0.0, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.01))}
    assert all(len(found) >= 10 for found in bands.values())
    assert {low: sum(found) / len(found) for low, found in bands.items()} == {0.0: 0.0, 0.7: 0.0, 0.8: 1.0, 0.9: 1.0}

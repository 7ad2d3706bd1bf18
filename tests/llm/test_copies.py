"""Near copies at a similarity of 0.8, against brute force over all pairs."""

import random

import numpy as np

import corpus_pipeline
from fieldtide.llm.copies import block_links, copy_groups

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def planted():
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    change = lambda words, n: [w if k not in at else f"x{rng.randrange(10**6)}" for at in [set(rng.sample(range(len(words)), n))] for k, w in enumerate(words)]
    texts = [" ".join(prose(rng.randrange(3, 200))) for _ in range(60)]
    for size, edits in ((120, 1), (200, 3), (300, 6), (300, 8), (60, 1), (400, 20)) * 6:
        base = prose(size)
        texts += [" ".join(base), " ".join(change(base, edits))]
    chain = prose(200)
    for _ in range(6):  # neighbours are alike, the ends are not
        texts.append(" ".join(chain))
        chain = change(chain, 3)
    template = prose(150)
    texts += [" ".join(change(template, 1)) for _ in range(80)]  # one group of copies
    texts += [" ".join(template[:90] + prose(60)) for _ in range(40)]  # a shared passage is no copy
    texts += [texts[0], texts[0].upper(), "", None, " \t", "one two", "one  two"]
    out = [(k, t, "en", f"s{k % 3}", None) for k, t in enumerate(texts)]
    return [*out, (None, texts[1], "en", "s1", None), out[2]]


def components(rows):
    sets = [shingles(r[1]) for r in rows]
    label, near = list(range(len(rows))), []
    for i, a in enumerate(sets):
        near += [(i, j) for j in range(i) if len(a & sets[j]) >= 0.8 * len(a | sets[j])]
    for _ in rows:
        before = list(label)
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return label, near


def test_copies(spark):
    rows = planted()
    label, near = components(rows)
    assert sum(rows[i][1] != rows[j][1] for i, j in near) > 1000
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    group = lambda pairs: sorted(sorted(map(str, g)) for g in pairs.values())
    expected, got = {}, {}
    for r, x in zip(rows, label):
        expected.setdefault(x, []).append((r[0]))
    for r in copy_groups(df, block=16).collect():
        got.setdefault(bytes(r["root"]), []).append(r["doc_id"])
    assert group(got) == group(expected)
    kept = corpus_pipeline.simhash_near_dedup(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(min((x for x in g if x is not None), default=None)) for g in expected.values())
    assert copy_groups(df.limit(0)).count() == 0


def test_unlike_texts_of_one_key():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 100)
    sets = [np.unique(np.concatenate([base[rng.random(100) > share], rng.integers(0, 1 << 62, 3)])) for share in rng.choice([0.02, 0.1, 0.3], 120)]
    names = [bytes([k]) for k in range(120)]
    near = {(i, j) for i in range(120) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}

    def joined(pairs):
        label = list(range(120))
        for _ in range(120):
            for i, j in pairs:
                label[i] = label[j] = min(label[i], label[j])
        return label

    found = block_links(names, names, sets, 0.8)
    assert 0 < len(found) < 120 and {(v[0], u[0]) for u, v in found} <= near
    assert joined([(u[0], v[0]) for u, v in found]) == joined(near)

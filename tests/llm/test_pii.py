"""Personal data: patterns against plain regular expressions, the tagger against held-out and rewritten spans."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark import cloudpickle

import fieldtide
from fieldtide.llm import pii
from fieldtide.llm.lstm_crf import Tagger
from fieldtide.llm.queries import op11_pii

cloudpickle.register_pickle_by_value(fieldtide)
SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, base string, spans int"


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        total = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d)))
        out += [("card", *m.span())] if 13 <= len(d) <= 19 and total % 10 == 0 else []
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


def random_texts():
    rng = random.Random(5)
    parts = ["a@b.cc", "x.y+z@host-1.example.com", "@", "a@b", "a@b.", "a@@b.c", "é@b.cc", "1.2.3.4", "256.1.1.1", "001.02.3.4", "1.2.3.4.5.6.7.8",
             "1..2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "4785380592391139", "+1 (743) 555-3824", "+49", "+1 2", "+123456789012345678", " ",
             "\n", ".", "-", "word", "漢字", "00000000000000000000001.2.3.4", "%", "a.b@c.d@e.f", "9", "12"]
    yield from ("".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(3000))
    yield from ("a" * 50_000, "1" * 50_000 + "x", "1." * 20_000, "@" * 5000, "a@" * 5000, "+1" + " " * 30_000 + "x", "a.b@" + "c." * 10_000)


def test_patterns():
    for text in random_texts():
        assert pii.base_spans(text) == plain(text), text[:200]


def test_windows_cover_all_hints():
    rng = random.Random(2)
    for _ in range(500):
        size = rng.randrange(0, 700)
        text = "".join(rng.choice("abcdefgh") if rng.random() > 0.01 else rng.choice("0@([") for _ in range(size))
        last = max(0, -(-(size - pii.WIDTH) // pii.STEP))
        expected = [k * pii.STEP for k in range(last + 1) if re.search(r"[0-9@(\[]", text[k * pii.STEP : k * pii.STEP + pii.WIDTH])]
        assert pii.window_starts(text) == expected


def test_gradients():
    rng = np.random.default_rng(0)
    model = Tagger(*[p + rng.normal(0, 0.3, p.shape) for p in Tagger.start(10, 4, 5).params])
    ids, tags = rng.integers(0, 10, (3, 7)), rng.integers(0, 5, (3, 7))
    grads = model.gradient(ids, tags)[1]
    for param, grad in zip(model.params, grads):
        for _ in range(4):
            at = tuple(int(rng.integers(s)) for s in param.shape)
            was = param[at]
            param[at] = was + 1e-3
            up = model.gradient(ids, tags)[0]
            param[at] = was - 1e-3
            down = model.gradient(ids, tags)[0]
            param[at] = was
            assert abs((up - down) / 2e-3 - grad[at]) < 1e-4


def test_best_path_is_the_best_of_all():
    rng = np.random.default_rng(1)
    model = Tagger.start(5, 2, 3)
    model.moves[:], model.first[:] = rng.normal(size=(3, 3)), rng.normal(size=3)
    scores = rng.normal(size=(6, 5, 3))
    value = lambda s, p: model.first[p[0]] + sum(s[t, x] for t, x in enumerate(p)) + sum(model.moves[a, b] for a, b in zip(p, p[1:]))
    for s, path in zip(scores, model.best_path(scores)):
        every = [tuple(np.unravel_index(k, (3,) * 5)) for k in range(3**5)]
        assert value(s, tuple(path)) == pytest.approx(max(value(s, p) for p in every))


def test_reconcile():
    text = "call (743) 555-3824 or (743) 555-3825 at 1.2.3.4"
    whole, other = ["phone", 5, 19, 5.0, False], ["phone", 23, 37, 5.0, False]
    assert sorted(pii.reconcile(text, [whole, whole, other], [])) == [("phone", 5, 19), ("phone", 23, 37)]
    assert pii.reconcile(text, [["phone", 5, 14, 2.0, True], ["phone", 10, 19, 3.0, True]], []) == [("phone", 5, 19)]
    assert pii.reconcile(text, [whole], [("phone", 18, 22)]) == []
    assert pii.reconcile(text, [["ip", 5, 19, 9.0, False], ["phone", 5, 19, -1.0, False]], []) == []
    # The pair outweighs the span that meets both.
    digits = "(743) 555-3824 555-3825"
    found = pii.reconcile(digits, [["phone", 0, 14, 3.0, False], ["phone", 0, 23, 2.0, False]], [])
    assert found == [("phone", 0, 14)]


@pytest.fixture(scope="module")
def windows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return pii.labelled_windows(docs), pii.labelled_windows(docs.filter("doc_id % 3 > 0")), docs


def test_sample_does_not_depend_on_the_partitions(spark, windows):
    again = pii.labelled_windows(windows[2].repartition(7), per_class=10)
    assert [tuple(r) for r in again] == [tuple(r) for r in pii.labelled_windows(windows[2].coalesce(1), per_class=10)]
    assert len(again) <= 50 and {s.split(":")[0] for r in again for s in r["spans"].split(",") if s} == set(pii.KINDS)


def test_held_out_spans(windows):
    """Trained on two thirds of the documents: labelled spans of the others, and the same rewritten."""
    model = pii.fit(windows[1])
    rng, hits, rewritten_hits, total, extra = np.random.default_rng(9), 0, 0, 0, 0
    for r in windows[2].filter("doc_id % 3 = 0").select("text").collect():
        text = r["text"] or ""
        base = pii.base_spans(text)
        found = {tuple(s[:3]) for _, spans in pii.decode(model, [text]) for s in spans}
        for kind, a, b in base:
            total += 1
            hits += (kind, a, b) in found
            new = pii.rewritten(kind, text[a:b], rng)
            changed = text[:a] + new + text[b:]
            spans = pii.reconcile(changed, [s for _, part in pii.decode(model, [changed]) for s in part], pii.base_spans(changed))
            every = pii.base_spans(changed) + spans
            rewritten_hits += any(s[0] == kind and s[1] < a + len(new) and s[2] > a for s in every)
        clean = re.sub(r"[0-9@+]", "x", text)
        extra += len(pii.reconcile(clean, [s for _, part in pii.decode(model, [clean]) for s in part], []))
    assert total > 15 and hits >= 0.8 * total and rewritten_hits >= 0.6 * total and extra == 0


def test_rows(spark):
    texts = [None, "", "x", "mail a.b@c.de now", "mail a.b@c.de now", "漢字 +1 (743) 555-3824 é", "z" * 3000 + " 1.2.3.4 " + "y " * 60_000 + "4111 1111 1111 1111"]
    docs = spark.createDataFrame([(k, t, "own", 7) for k, t in enumerate(texts)] + [(3, texts[3], "own", 7), (None, texts[5], None, None)], SCHEMA)
    rows = pii.personal_data(docs.repartition(3)).collect()
    assert len(rows) == 9
    for r in rows:
        text = r["text"] or ""
        base = [(s["kind"], s["start"], s["end"]) for s in r["pii"]["base"]]
        assert base == plain(text) and set(base) <= {(s["kind"], s["start"], s["end"]) for s in r["pii"]["spans"]}
        assert r["pii"]["base_text"] == ",".join(f"{k}:{a}:{b}" for k, a, b in base)
    assert pii.personal_data(docs.limit(0)).collect() == []


def test_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = op11_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))  | ({""} if not base else set())
    clean = [r for r in rows if not plain(texts[r["doc_id"]])]
    assert sum(bool(r["spans"]) for r in clean) == 0

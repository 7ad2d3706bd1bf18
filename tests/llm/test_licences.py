"""Licence notices as they stand in files: wrapped, side by side, alike, repeated; scores against plain arithmetic."""

import math
import random
import re
import textwrap

import pytest

from fieldtide.llm import licences

WORDS = "the of and in on with for our new river town data work file model system note week plan copy public general".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return licences.train([prose(rng, rng.randrange(3, 40)) for _ in range(600)])


def found(spark, model, texts):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts], "doc_id bigint, text string, family string, line int").repartition(3)
    return {(r["doc_id"], r["paragraph"], r["family"]): r for r in licences.scan(df, model).collect()}


def test_every_notice_is_found_in_its_family(spark, model):
    notices = [(f, n) for f, ns in licences.NOTICES.items() for n in ns]
    rng = random.Random(2)
    texts = [(k, f"{prose(rng, 30)}\n\n{n}\n\n{prose(rng, 20)}") for k, (_, n) in enumerate(notices)]
    got = found(spark, model, texts)
    right = [got.get((k, 1, f)) for k, (f, _) in enumerate(notices)]
    assert sum(r is not None and r["confirmed"] for r in right) >= 0.9 * len(notices)
    wrong = [key for key, r in got.items() if r["confirmed"] and key[2] != notices[key[0]][0]]
    assert wrong == []


def test_wrapped_notices(spark, model):
    header = lambda family, k: "\n".join(" * " + x for x in textwrap.wrap(licences.NOTICES[family][k], 60))
    rng = random.Random(3)
    texts = [(1, f"/*\n{header('gpl', 2)}\n */\n\n{prose(rng, 40)}"), (2, f"{prose(rng, 9)}\n{header('agpl', 1)}\n{prose(rng, 9)}"),
             (3, header("isc", 1)), (4, header("bsd", 1).replace("\n", "\r\n"))]
    got = found(spark, model, texts)
    assert {k: r["confirmed"] for k, r in got.items() if r["confirmed"]} == {
        (1, 0, "gpl"): True, (2, 0, "agpl"): True, (3, 0, "isc"): True, (4, 0, "bsd"): True}
    assert got[2, 0, "agpl"]["lines"] > 1 and got[2, 0, "agpl"]["similarity"] > 0.8


def test_notices_side_by_side(spark, model):
    got = found(spark, model, [(1, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.")])
    assert {k for k, r in got.items() if r["confirmed"]} == {(1, 0, "mit"), (1, 0, "apache-2.0")}
    assert (got[1, 0, "mit"]["line"], got[1, 0, "apache-2.0"]["line"], got[1, 0, "mit"]["lines"]) == (0, 1, 1)


def test_ordinary_paragraphs_repeats_and_long_texts(spark, model):
    rng = random.Random(4)
    notice = "Licensed under CC BY 4.0."
    texts = [(k, prose(rng, 60)) for k in range(30)] + [(50, "a license to kill"), (51, "the general public"), (52, None), (53, ""), (54, "\n\n\r\n")]
    texts += [(60, notice)] * 5 + [(61, notice), (None, notice), (None, f"{prose(rng, 3)}\n\n{notice}")]
    texts += [(62, "\n\n".join(prose(rng, 50) for _ in range(3000)) + f"\n\n{notice}")]
    got = found(spark, model, texts)
    assert {k for k, r in got.items() if r["confirmed"]} == {(60, 0, "cc-by"), (61, 0, "cc-by"), (None, 0, "cc-by"), (None, 1, "cc-by"), (62, 3000, "cc-by")}


def test_scores_equal_plain_arithmetic(spark, model):
    notices = [n for ns in licences.NOTICES.values() for n in ns]
    got = found(spark, model, list(enumerate(notices)))
    assert len(got) >= 0.9 * len(notices)
    for (k, _, family), r in got.items():
        grams = licences._grams(licences._words(notices[k]))
        z = [b + sum(model.weights[g][j] for g in grams if g in model.weights) for j, b in enumerate(model.intercepts)]
        assert r["probability"] == pytest.approx(math.exp(z[model.families.index(family)]) / sum(map(math.exp, z)))
        share = lambda n: len(set(grams) & set(licences._grams(licences._words(n)))) / len(licences._grams(licences._words(n)))
        fits = {f: max(map(share, ns)) for f, ns in licences.NOTICES.items()}
        assert r["similarity"] == pytest.approx(fits[family])
        assert r["confirmed"] == (fits[family] >= 0.5 and fits[family] >= max(fits.values()))
    assert re.fullmatch(r"[a-z0-9. -]+", " ".join(model.hints))

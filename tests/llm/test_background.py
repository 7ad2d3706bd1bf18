"""The licence scan's background sample on tables of copies."""

from fieldtide.llm import licences


def test_copies_are_one_text(spark):
    texts = [f"text {k} of ordinary words\n" + "\n".join(f"line {j} of {k}" for j in range(60)) for k in range(12)]
    df = spark.createDataFrame([(400 * k + c, t) for k, t in enumerate(texts) for c in range(400)] + [(-1, None)], "doc_id bigint, text string")
    got = licences.background_sample(df, most_rows=10, per_text=50)
    of = lambda k: [p for p in got if p.startswith(f"text {k} ") or p.endswith(f" of {k}")]
    assert len(got) == 500 and sorted(len(of(k)) for k in range(12)) == [0] * 2 + [50] * 10
    # Later lines of a text are picked as well as its first.
    assert any(p.startswith("line 59 ") for p in got)
    assert len(licences.background_sample(df, most_paragraphs=30)) == 30
    assert licences.background_sample(df.limit(0)) == []

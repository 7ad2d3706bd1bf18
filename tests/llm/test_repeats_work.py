import random

import numpy as np
import pyarrow as pa

from fieldtide.llm import repeats


def batch(strings):
    many = len(strings)
    return pa.record_batch([
        pa.array([7] * many, pa.int64()), pa.array([b"%03d" % k for k in range(many)], pa.binary()), pa.array(strings, pa.binary()),
        pa.array([len(s) - 199 for s in strings], pa.int32()), pa.array([1] * many, pa.int64())], names=["key", "content", "bytes", "n", "copies"])


def test_only_strings_that_may_share_a_window_are_built(monkeypatch):
    rng = random.Random(3)
    common = rng.randbytes(150)
    strings = [rng.randbytes(30) + common + rng.randbytes(50) for _ in range(40)]
    # Two of them have 200 bytes in common, from their third byte on.
    strings[9] = strings[9][:2] + strings[4][2:202] + strings[9][202:]
    strings[4] = strings[4][:202] + b"\0" * 28
    built = []
    plain = repeats.repeated_windows
    monkeypatch.setattr(repeats, "repeated_windows", lambda texts, *rest: built.extend(texts) or plain(texts, *rest))
    monkeypatch.setattr(repeats, "anchor_offsets", lambda texts, length: np.full(len(texts), 80))
    spans = {c: s for out in repeats._build(200, 2_000)(iter([batch(strings)])) for c, s in zip(out.column("content").to_pylist(), out.column("spans").to_pylist()) if s}
    assert spans == {b"004": [2, 3], b"009": [2, 3]}
    assert set(built) <= {strings[4], strings[9]}


def test_texts_are_scanned_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)
    plain = repeats._text_runs

    def counted(length):
        scan = plain(length)

        def run(batches):
            def tally():
                for b in batches:
                    read.add(b.num_rows)
                    yield b

            return scan(tally())

        return run

    monkeypatch.setattr(repeats, "_text_runs", counted)
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefgh", k=260))
    rows = [(k, "".join(rng.choices("ijklmnop", k=300)) + str(k // 3) + passage * (k % 3 == 0)) for k in range(30)]
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {k: 260 * (k % 3 == 0) for k in range(30)}
    assert read.value == 30

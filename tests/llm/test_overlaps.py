import tracemalloc

import numpy as np

from fieldtide.llm.copies import overlaps


def test_overlaps_take_what_the_sets_hold():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 400, np.uint64)
    sets = [np.unique(rng.choice(pool, 90)) for _ in range(6)]
    tracemalloc.start()
    try:
        both = overlaps(sets)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1_000_000
    assert both.tolist() == [[len(set(a.tolist()) & set(b.tolist())) if i != j else both[i, i] for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert np.array_equal(overlaps(sets, cells=60)[~np.eye(6, dtype=bool)], both[~np.eye(6, dtype=bool)])

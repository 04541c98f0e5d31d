"""The exact vector search of blocks against one pair at a time."""

import math

import numpy as np
import pyarrow as pa

from inkwell.operators import vectors


def test_blocks_give_what_single_pairs_give():
    rng = np.random.default_rng(3)
    held = {i: rng.normal(size=8).tolist() for i in range(60)}
    held |= {i: held[5] for i in range(40, 55)} | {57: None, 58: held[1][:7] + [None]}
    table = lambda ids: pa.table({"vec_id": pa.array(ids, pa.int64()), "u": pa.array([held[i] for i in ids], pa.list_(pa.float64()))})
    good = {i: v for i, v in held.items() if v is not None and None not in v}
    asked, others = [5, 7, 45, 57], [i for i in reversed(held) if i != 7]
    got = vectors.nearest(table(asked), table(others), 10, 6).to_pylist()
    for q in asked:
        cosine = lambda i, q=q: math.sumprod(good[i], good[q]) / math.dist(good[i], [0] * 8) / math.dist(good[q], [0] * 8) if i in good and q in good else None
        want = sorted(((-math.inf if (s := cosine(i)) is None else round(s, 6)), -i) for i in others if i != q)[::-1][:10]
        assert [(-math.inf if r["similarity"] is None else r["similarity"], -r["vec_id"]) for r in got if r["query_id"] == q] == want
    assert vectors.rounded(np.array([0.1234565, -0.1234565, 0.5]), 6).tolist() == [0.123457, -0.123457, 0.5]

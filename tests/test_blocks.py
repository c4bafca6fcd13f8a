"""Refined blocks of crowded point sets, by brute force over keys."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from orbweave import queries


def refined(codes, level, code, n_crit):
    inside = codes[codes >> 3 * (16 - level) == code]
    if len(inside) <= n_crit or level == 16:
        return [(code << 3 * (16 - level) << 15) + level]
    return [key for i in range(8) for key in refined(inside, level + 1, 8 * code + i, n_crit)]


def check(spark, d):
    codes = np.array([r.base_key >> 15 for r in queries.point_keys(spark, d).collect()])
    expected = refined(codes, 0, 0, 40)
    found = [r.key for r in queries.blocks_split(spark, d).collect()]
    assert sorted(found) == sorted(expected)
    assert max(k & 32767 for k in found) > queries.DEPTH and sum(8.0 ** -(k & 32767) for k in found) == 1


def test_crowded_boxes_are_split(spark, tmp_path):
    rng = np.random.default_rng(1)
    at = rng.random((300, 6))
    at[:200] = 0.3 + 0.01 * at[:200]
    table = {"vec_id": np.arange(300), "embedding": at.astype(np.float32).tolist(), "label": np.zeros(300, np.int32)}
    pq.write_table(pa.table(table), tmp_path / "embeddings.parquet")
    check(spark, str(tmp_path))


def test_crowded_boxes_of_a_table(spark):
    check(spark, "/root/testdata/sf0.1")

"""The swap queries run until a whole round is in vain."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from protospan.operators import pairs, swap
from protospan.plans.queries import QUERIES
from protospan.sources.points import points


@pytest.mark.parametrize(("name", "energy"), [("swap_search", "cluster"), ("swap_search_lowrank", "lowrank")])
def test_the_last_round_is_in_vain(spark, tmp_path, name, energy):
    n, x = 60, np.random.default_rng(1).normal(size=(60, 12))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(x.astype("f4").tolist(), pa.list_(pa.float32())), "label": pa.array([0] * n, pa.int32())}), tmp_path / "embeddings.parquet")
    got = QUERIES[name](spark, str(tmp_path)).orderBy("swap_no").collect()
    assert len(got) > 5 and got[-1].stagnation == n
    pts = points(spark.read.parquet(str(tmp_path / "embeddings.parquet")), "vec_id", "embedding", "label")
    four = swap.swap_search(pts, pairs.prototypes(pts, [0, 1, 2]), energy, 2, max_swaps=4)
    assert got[-1].energy < four.energy

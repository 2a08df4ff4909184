"""The views that both engines derive from the tables agree where rounding decides."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from folioframe.fixtures import duck_sql, view
from folioframe.plans import catalogue

IMAGES = ("img_crop", "img_letterbox", "img_pad_to_stride", "img_png_roundtrip", "img_resize_to_fit", "img_drop_alpha", "img_normalize", "img_resize", "img_swap_red_blue", "img_pixel")


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    """Embeddings of 32-bit numbers whose thousandfold is nearest to a whole number, of either sign."""
    near = (np.arange(1, 1025, dtype=np.float64) / 1000).astype(np.float32)
    flat = np.concatenate([near, np.nextafter(near, np.float32(0)), -np.nextafter(near, np.float32(2))])
    # every place of an image gets some of the edges
    flat = np.concatenate([np.roll(flat, k * 13) for k in range(16)]).astype(np.float32)
    rows = flat.reshape(-1, 64)
    where = tmp_path_factory.mktemp("edges")
    table = pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(list(rows), pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())})
    pq.write_table(table, where / "embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{where}/embeddings.parquet'")
    return str(where), duck


def test_gray_levels_round_as_in_duckdb(spark, edges):
    where, duck = edges
    got = {(r.image_id, r.r, r.c): r.gray for r in view(spark, where, "v_gray").collect()}
    want = {(i, r, c): g for i, r, c, g in duck.sql(duck_sql("SELECT image_id, r, c, gray FROM {v_gray} g")).fetchall()}
    assert got == want


@pytest.mark.parametrize("name", IMAGES)
def test_images_of_such_levels(spark, edges, name):
    where, duck = edges
    result = catalogue.queries()[name](spark, where)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(map(str, map(tuple, result.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))

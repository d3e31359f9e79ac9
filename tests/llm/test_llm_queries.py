import glob
import os

import pytest
from pyspark.sql import functions as F

from limpid.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
COLUMNS = {
    "p1_found": ["field_name", "row_id"], "p2_found": ["password"], "p3_found": ["first_record_id", "record_id"], "p4_found": ["record_id"],
    "p7_found": ["exposure_id_a", "exposure_id_b"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "pii_type", "pii_text"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    import duckdb

    from tools.compare import canonical

    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    if name in COLUMNS:
        assert list(got.columns) == COLUMNS[name]
    if name not in queries.SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    want = con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_usage_is_that_of_the_packing(spark, tmp_path):
    from limpid.llm import packing

    rows = [(i, "some words and numbers 12345 " * (i % 90), 1) for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens bigint").write.parquet(f"{tmp_path}/documents.parquet")
    used = queries.QUERIES["p8_usage"](spark, str(tmp_path)).first()
    packed = queries.QUERIES["p8_pack"](spark, str(tmp_path))
    assert used == packing.usage(packed).first()
    assert used.n_tokens == packed.agg(F.sum("size")).first()[0] > 400

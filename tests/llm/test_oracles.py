import pytest

from helpers import awkward, oracle, sorted_rows
from paperloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_its_sql(spark, sf_dir, name):
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages", "embeddings")}
    assert sorted_rows(QUERIES[name](spark, sf_dir).collect()) == oracle(ORACLES[name], **tables)


@pytest.mark.parametrize("name", ["op3_substring_dedup", "op4_line_rules", "op6_jaccard_join"])
def test_equals_its_sql_on_awkward_rows(spark, tmp_path, name):
    frame = awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted_rows(QUERIES[name](spark, str(tmp_path)).collect()) == oracle(ORACLES[name], documents=frame)

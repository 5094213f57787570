import pytest

from logscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_repeated_passages", "op4_url_filter", "op5_pii", "op7_mix_sources", "op9_byte_bpe", "op10_simhash"])
def test_building_a_plan_changes_no_session_setting(spark, name):
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(k) for k in keys]
    QUERIES[name](spark, SF)
    assert [spark.conf.get(k) for k in keys] == before

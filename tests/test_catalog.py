import pytest

import __spark_entry__ as contract
from tests.check_queries import compare

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["Topic", "Count", "Name", "Representation", "Top_words"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["topic_info", "bm25_scores", "topics_over_time", "parsed_replies", "snippets", "roundtrip_json", "frequent_word_names"])
def test_query_matches_its_twin(spark, name):
    assert compare(spark, SF, name, contract.queries()[name], contract.oracle_sql()[name]).startswith("ok")

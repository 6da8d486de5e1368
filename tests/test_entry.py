import __spark_entry__


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[:4] == ["feature_id", "entitled", "basis", "raw_recommended"] and df.count() == 10


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

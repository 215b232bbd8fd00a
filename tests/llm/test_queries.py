from mercanta.llm import queries


def test_all_run(spark, data):
    for name, query in queries.QUERIES.items():
        assert query(spark, data).count() >= 0, name

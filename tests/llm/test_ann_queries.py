"""The vector that is asked for an id with several."""

from vulnwave.llm import ann


def test_least_vector_is_asked(spark):
    vectors = [[float(k), 30.0 - k] for k in range(1, 30)]
    for rows in (vectors, vectors[::-1]):
        table = spark.createDataFrame([(i, v) for i in (20, 40) for v in rows] + [(20, [0.0, 0.0]), (20, None)], "vec_id long, embedding array<float>").coalesce(1)
        asked = ann.usable_queries(table, "vec_id", "embedding", 2)
        assert sorted((r["key"], r["v"]) for r in asked.collect()) == [(20, [1.0, 29.0]), (40, [1.0, 29.0])]

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from covaria.operators import topics as TP


def counted(spark, n):
    """Vectors of ``n`` notes, and how many times one of them was made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def cells(i):
        made.add(1)
        return [1.0 + i % 3, float(i % 2), 2.0]

    rows = spark.createDataFrame([(i,) for i in range(n)], "i long").repartition(2)
    return rows.select("i", array_to_vector(cells("i")).alias("features")), made


def test_perplexity_makes_the_vectors_once(spark):
    """Failed before: the count of the words and the bound made the vectors once each."""
    vectors, _ = counted(spark, 40)
    model = TP.fit_topics(vectors, 2, 2)
    vectors, made = counted(spark, 40)
    alone = TP.log_perplexity(model, vectors)
    assert made.value == 40
    assert abs(alone + model.logPerplexity(vectors)) < 1e-9


def test_held_vectors_serve_fit_and_perplexity(spark):
    vectors, made = counted(spark, 40)
    with TP.held(vectors) as kept:
        assert kept.is_cached and kept.columns == ["features"]
        with TP.held(kept) as again:
            assert again is kept
        bound = TP.log_perplexity(TP.fit_topics(kept, 2, 2), kept)
        assert kept.is_cached
    assert made.value == 40 and not kept.is_cached
    plain, _ = counted(spark, 40)
    assert bound == TP.log_perplexity(TP.fit_topics(plain, 2, 2), plain)

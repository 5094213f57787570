"""Components, k-means and silhouette as aggregates, against Spark ML and numpy."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from logscope.operators import clusters as CL
from logscope.operators import features as FT
from logscope.operators import segments as SG
from logscope.plans.catalog import R
from tests.conftest import SF_SMALL

COLS = ["a", "b", "c"]


def points(spark, n=400, seed=1, partitions=5):
    rng = np.random.default_rng(seed)
    at = rng.normal(0, 1, (n, 3)) + rng.choice([-6, 0, 6], (n, 3))
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(at)], "id long, a double, b double, c double").repartition(partitions), at


def test_components_equal_spark_ml(spark):
    r = R(spark, SF_SMALL)
    ml = {x["host"]: x["v"] for x in SG.host_ml_features(r).select("host", vector_to_array("features").alias("v")).collect()}
    got = {x["host"]: [x["pc1"], x["pc2"], x["pc3"]] for x in FT.host_pca(r).collect()}
    assert set(ml) == set(got)
    a, b = np.array([ml[h] for h in ml]), np.array([got[h] for h in ml])
    b *= np.sign((a * b).sum(axis=0))
    np.testing.assert_allclose(a, b, atol=1e-5)


def test_components_of_flat_and_few_rows(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    fitted = CL.components(df, ["a", "b"], 2)
    rows = df.select(*[c.alias(f"p{i}") for i, c in enumerate(fitted.projected())]).collect()
    assert fitted.variance.tolist() == pytest.approx([1.0, 0.0]) and all(r["p1"] == 0 for r in rows)
    empty = CL.components(df.limit(0), ["a", "b"], 1)
    assert empty.variance.tolist() == [0.0]


def plain_kmeans(x, k):
    centers = [x[np.lexsort((np.arange(len(x)), -(x ** 2).sum(axis=1)))[0]]]
    while len(centers) < k:
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centers], axis=0)
        if far.max() <= 0:
            break
        centers.append(x[int(np.argmax(far))])
    c = np.array(centers)
    for _ in range(20):
        lab = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[lab == i].mean(axis=0) if (lab == i).any() else c[i] for i in range(len(c))])
    return ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1), c


@pytest.mark.parametrize("k", [1, 3, 4, 9])
def test_kmeans_equals_numpy_for_any_layout(spark, k):
    want = None
    for partitions in (1, 13):
        df, x = points(spark, partitions=partitions)
        got = [r["segment"] for r in CL.labelled(df, COLS, "id", k).orderBy("id").collect()]
        if want is None:
            want = plain_kmeans(x, k)[0].tolist()
        assert got == want


def test_kmeans_is_as_good_as_spark_ml(spark):
    df, _ = points(spark, seed=3)
    cost = CL.evaluation(CL.labelled(df, COLS, "id", 8), COLS).first()["wssse"]
    vec = VectorAssembler(inputCols=COLS, outputCol="features").transform(df)
    assert cost <= 1.25 * KMeans(k=8, seed=42, featuresCol="features").fit(vec).summary.trainingCost


def test_fewer_points_than_centres_and_none(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 5.0)], "id long, a double")
    assert [r["segment"] for r in CL.labelled(df, ["a"], "id", 4).orderBy("id").collect()] == [1, 1, 0]
    assert CL.labelled(df.limit(0), ["a"], "id", 4).count() == 0


def test_silhouette_equals_spark_ml(spark):
    df, _ = points(spark, seed=5)
    lab = CL.labelled(df, COLS, "id", 5)
    vec = VectorAssembler(inputCols=COLS, outputCol="features").transform(lab)
    want = ClusteringEvaluator(predictionCol="segment", featuresCol="features").evaluate(vec)
    got = CL.evaluation(lab, COLS).collect()
    assert got[0]["silhouette"] == pytest.approx(want, abs=1e-9)
    assert sum(r["size"] for r in got) == 400


def test_silhouette_of_one_segment_single_points_and_ties(spark):
    df = spark.createDataFrame([(0, 0.0, 0), (1, 0.0, 0), (2, 9.0, 1), (3, 0.0, 2), (4, 0.0, 2), (5, 4.0, None)], "id long, a double, segment int")
    got = {r["id"]: r["silhouette"] for r in CL.silhouettes(df, ["a"]).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}
    one = CL.silhouettes(df.where("segment = 0"), ["a"]).collect()
    assert [r["silhouette"] for r in one] == [0.0, 0.0]
    with pytest.raises(ValueError):
        CL.silhouettes(df, ["a"], max_labels=2)


def test_plan_of_labelling_and_silhouette_is_narrow(spark):
    df, _ = points(spark)
    df = df.coalesce(1)
    lab = CL.labelled(df, COLS, "id", 3)
    text = CL.silhouettes(lab.select("*", F.lit(1).alias("extra")), COLS)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "HashAggregate" not in text

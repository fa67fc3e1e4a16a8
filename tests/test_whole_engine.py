"""The longest test, after all others."""

from oracle import SF
from pyspark.sql import functions as F

from namefold.plans.adapters import Graph
from namefold.plans.queries import QUERIES


def test_engine_finds_the_known_renaming(spark):
    found = QUERIES["engine_nine_matchers"](spark, SF).join(Graph(spark, SF).truth().select("a", F.col("b").alias("true_b")), "a", "left")
    n, right, named = found.where("a like 'LX/%'").agg(F.count("*"), F.sum((F.col("b") == F.col("true_b")).cast("int")), F.countDistinct("b")).first()
    assert n > 1500 and right / n > 0.95 and named == n

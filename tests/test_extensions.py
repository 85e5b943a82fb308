"""What a host can add: aggregates, generators, connectors, solvers; and
tables of a database, in Spark's own Derby."""

import numpy as np
import pytest
from algebra_cases import rows
from pyspark.sql import functions as F

from tessera.functions import aggregates
from tessera.plans.lexer import AlgebraError


@pytest.fixture
def s(session):
    session.script("""
        R := [
        | k | v |
        |---|---|
        | a | 1 |
        | a | 4 |
        | b | 3 |
        | b |   |
        ];
    """)
    return session


def test_an_aggregate_of_columns(s):
    s.aggregate("spread", lambda x: F.max(x) - F.min(x))
    assert rows(s.relation("γ k, spread(v) → d, COUNT(*) → n (R)")) == [("a", 3, 2), ("b", 0, 2)]
    assert rows(s.relation("γ spread(v) → d (R)")) == [(3,)]


def test_an_aggregate_of_python_functions(s):
    s.aggregate("product_of", aggregates.folded(lambda: 1, lambda p, v: p if v is None else p * v, float, "double"))
    assert rows(s.relation("γ k, product_of(v) → p, SUM(v) → t (R)")) == [("a", 4.0, 5), ("b", 3.0, 3)]


def test_a_library(s):
    s.library({"twice": lambda x: x * 2}, {"span": lambda x: F.max(x) - F.min(x)})
    assert rows(s.relation("γ k, span(twice(v)) → d (R)")) == [("a", 6), ("b", 0)]


def test_a_generator(s):
    s.generator("Squares", lambda spark, o: spark.range(int(o["count"])).select((F.col("id") * F.col("id")).alias("n")))
    s.script('source Q from generator { name: "Squares", count: "4" };')
    assert rows(s.relation("Q")) == [(0,), (1,), (4,), (9,)]


def test_a_connector(s):
    asked = []

    def read(spark, options, table, schema):
        asked.append((options["place"], table))
        return spark.range(3).toDF("n")

    s.connector("abacus", read)
    s.script('connection a from abacus { place: "desk" }; source N from a { table: "beads" };')
    assert rows(s.relation("σ n > 0 (N)")) == [(1,), (2,)] and asked[0] == ("desk", "beads")


class Greedy:
    """Takes rows in order as long as they fit."""

    def choose(self, gain, a, b, kinds):
        x = np.zeros(len(gain), int)
        for i in range(len(gain)):
            x[i] = 1
            if (a @ x > b).any():
                x[i] = 0
        return x

    def weights(self, cost, a, b, kinds, lo, hi):
        return lo


def test_a_solver(s):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    text = "OPTIMIZE MAXIMIZE SUM(v) SUBJECT TO SUM(v) <= 4 (σ v IS NOT NULL (R))"
    assert rows(s.relation(text)) == [("a", 4)]
    s.solver = Greedy()
    assert rows(s.relation(text)) == [("a", 1), ("b", 3)]


@pytest.fixture
def url(spark, tmp_path):
    at = f"jdbc:derby:{tmp_path}/db"
    df = spark.range(1, 101).select(F.col("id").cast("int").alias("ID"), F.concat(F.lit("n"), "id").alias("NAME"))
    df = df.union(spark.createDataFrame([(None, "none")], "ID int, NAME string"))
    df.write.jdbc(f"{at};create=true", "T")
    return at


def test_a_table_of_a_database(session, url):
    session.script(f'source T from database {{ url: "{url}", table: "T", schema: {{ ID: NUMBER, NAME: STRING }} }};')
    assert rows(session.relation("π NAME (σ ID = 7 (T))")) == [("n7",)]
    assert "PushedFilters: [*IsNotNull(ID), *EqualTo(ID,7)]" in session.relation("σ ID = 7 (T)").df._jdf.queryExecution().explainString(session.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.mark.parametrize("ends", ["", ', lower: 20, upper: 40'])
def test_a_table_in_parts(session, url, ends):
    session.script(f'connection d from database {{ url: "{url}", partition: "ID", partitions: 4{ends} }}; source T from d {{ table: "T" }};')
    df = session.relation("T").df
    assert df.rdd.getNumPartitions() == 4 and df.count() == 101
    assert sorted(r.ID for r in df.collect() if r.ID is not None) == list(range(1, 101))


def test_a_connection_takes_no_other_keys(session):
    with pytest.raises(AlgebraError, match="has no colour"):
        session.script('connection d from database { url: "jdbc:derby:x", colour: "red" };')


def test_mongodb_without_its_connector(session):
    session.script('connection m from mongodb { uri: "mongodb://nowhere", database: "d" }; source C from m { table: "c" };')
    with pytest.raises(AlgebraError, match="connector is not installed"):
        session.relation("C").df
    session.script('connection n from mongodb { database: "d" }; source D from n { table: "c" };')
    with pytest.raises(AlgebraError, match="has a uri"):
        session.relation("D").df

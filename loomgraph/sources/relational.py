"""Relational tables as triples.

Instance ids are ``tag * 10^12 + key``; every edge set is distinct.  Literals
get an id from their text's place among the distinct ones of their column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph import terms as T
from loomgraph.sources.tables import table

TAG = 1_000_000_000_000
REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER, USER, EVENT = range(1, 9)

LOCATED_IN, PLACED_BY, PLACES, CONTAINS, CONTAINED_IN, SUPPLIED_BY, INVOLVES, SUPPLIES = range(100, 108)
BRAND, PART_NAME, PART_TYPE, SEGMENT, PRIORITY, PERFORMED_BY, EVENT_TYPE, LEAD_SUPPLIER, ORIGIN, NEIGHBOUR_OF = range(108, 118)

C_AGENT, C_PARTY, C_CUSTOMER, C_SUPPLIER, C_PART, C_ORDER, C_PLACE, C_NATION, C_REGION, C_USER, C_EVENT = range(200, 211)

#: Literal columns: (tag, table, column).
LITERALS = {
    BRAND: (20, "part", "p_brand"),
    PART_NAME: (21, "part", "p_name"),
    PART_TYPE: (22, "part", "p_type"),
    SEGMENT: (23, "customer", "c_mktsegment"),
    PRIORITY: (24, "orders", "o_orderpriority"),
    EVENT_TYPE: (25, "events", "event_type"),
}


def entity(tag: int, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return key.cast("bigint") + F.lit(tag * TAG)


def key_of(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.pmod(c, F.lit(TAG))


def literals(spark: SparkSession, d: str, prop: int) -> DataFrame:
    """``(id, text)`` of a literal column; these have few distinct values."""
    tag, t, c = LITERALS[prop]
    texts = table(spark, d, t).select(F.col(c).alias("text")).where("text IS NOT NULL").distinct()
    return texts.select(entity(tag, F.dense_rank().over(Window.orderBy("text"))).alias("id"), "text")


def edges(spark: SparkSession, d: str, prop: int) -> DataFrame:
    """The distinct statements ``(s, p, o)`` of one property."""

    def t(name: str) -> DataFrame:
        return table(spark, d, name)

    def make(df: DataFrame, s: Column, o: Column) -> DataFrame:
        return df.select(s.alias("s"), F.lit(prop).cast("bigint").alias("p"), o.alias("o")).na.drop().distinct()

    if prop == LOCATED_IN:
        return reduce(
            DataFrame.unionByName,
            [
                make(t("nation"), entity(NATION, "n_nationkey"), entity(REGION, "n_regionkey")),
                make(t("customer"), entity(CUSTOMER, "c_custkey"), entity(NATION, "c_nationkey")),
                make(t("supplier"), entity(SUPPLIER, "s_suppkey"), entity(NATION, "s_nationkey")),
            ],
        )
    if prop == PLACED_BY:
        return make(t("orders"), entity(ORDER, "o_orderkey"), entity(CUSTOMER, "o_custkey"))
    if prop == CONTAINS:
        return make(t("lineitem"), entity(ORDER, "l_orderkey"), entity(PART, "l_partkey"))
    if prop == SUPPLIED_BY:
        return make(t("lineitem"), entity(ORDER, "l_orderkey"), entity(SUPPLIER, "l_suppkey"))
    if prop == SUPPLIES:
        return make(t("lineitem"), entity(SUPPLIER, "l_suppkey"), entity(PART, "l_partkey"))
    if prop == PERFORMED_BY:
        return make(t("events"), entity(EVENT, "event_id"), entity(USER, "user_id"))
    if prop == LEAD_SUPPLIER:
        return make(t("supplier"), entity(NATION, "s_nationkey"), entity(SUPPLIER, "s_suppkey"))
    if prop == NEIGHBOUR_OF:
        # the next nation of the same region, in the order of keys; there are 25
        following = F.lead("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
        pairs = t("nation").select("n_nationkey", following.alias("next"))
        return make(pairs, entity(NATION, "n_nationkey"), entity(NATION, "next"))
    if prop in LITERALS:
        tag, name, c = LITERALS[prop]
        owner = {"part": (PART, "p_partkey"), "customer": (CUSTOMER, "c_custkey"), "orders": (ORDER, "o_orderkey"), "events": (EVENT, "event_id")}[name]
        rows = t(name).join(literals(spark, d, prop), F.col(c) == F.col("text"))
        return make(rows, entity(*owner), F.col("id"))
    raise ValueError(f"no source for property {prop}")


def members(spark: SparkSession, d: str, cls: int) -> DataFrame:
    """The explicit ``type`` statements of a class."""
    tag, name, key = {
        C_CUSTOMER: (CUSTOMER, "customer", "c_custkey"),
        C_SUPPLIER: (SUPPLIER, "supplier", "s_suppkey"),
        C_PART: (PART, "part", "p_partkey"),
        C_ORDER: (ORDER, "orders", "o_orderkey"),
        C_NATION: (NATION, "nation", "n_nationkey"),
        C_REGION: (REGION, "region", "r_regionkey"),
        C_EVENT: (EVENT, "events", "event_id"),
    }[cls]
    return typed(table(spark, d, name).select(entity(tag, key).alias("s")), cls)


def typed(subjects: DataFrame, cls: int) -> DataFrame:
    """``type`` statements for the distinct ids of a one-column table."""
    return (
        subjects.toDF("s").where("s IS NOT NULL").distinct()
        .select("s", F.lit(T.TYPE).cast("bigint").alias("p"), F.lit(cls).cast("bigint").alias("o"))
    )


def graph(spark: SparkSession, d: str, properties=(), classes=()) -> DataFrame:
    """The statements of some properties and classes, each once."""
    return reduce(
        DataFrame.unionByName, [edges(spark, d, p) for p in properties] + [members(spark, d, c) for c in classes]
    )


def statements(spark: SparkSession, rows: list[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "s bigint, p bigint, o bigint")

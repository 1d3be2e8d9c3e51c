"""The `sales` view: order lines with their order, customer, place and product."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# cost of one unit relative to the list price, chosen so that about half the products lose money
COST_FACTOR = 2.08

_SALES = "l_extendedprice * (1 - l_discount)"

# column -> (tables beside lineitem it needs, SQL expression)
_COLUMNS = {
    "order_id": ((), "l_orderkey"),
    "product_id": ((), "l_partkey"),
    "quantity": ((), "l_quantity"),
    "discount": ((), "l_discount"),
    "sales": ((), _SALES),
    "shipping_cost": ((), "l_extendedprice * l_tax"),
    "ship_mode": ((), "l_returnflag"),
    "ship_date": ((), "l_shipdate"),
    "order_date": (("orders",), "o_orderdate"),
    "order_priority": (("orders",), "o_orderpriority"),
    "customer_id": (("orders",), "o_custkey"),
    "customer_name": (("orders", "customer"), "c_name"),
    "segment": (("orders", "customer"), "c_mktsegment"),
    "state": (("orders", "customer", "nation"), "n_name"),
    "region": (("orders", "customer", "nation", "region"), "r_name"),
    "category": (("part",), "p_type"),
    "sub_category": (("part",), "p_brand"),
    "product_name": (("part",), "p_name"),
    "profit": (("part",), f"{_SALES} - {COST_FACTOR}D * l_quantity * p_retailprice"),
}
SALES_COLUMNS = tuple(_COLUMNS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_view(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The view, restricted to `columns` (all of them when none are named).

    The foreign keys of the star resolve, so a dimension that no wanted column reads cannot change
    the rows and is left out of the plan: a total over sales scans lineitem alone. Dimensions are
    joined to orders before orders meets lineitem, so the largest table is shuffled once on the order
    key. No join is hinted: Catalyst broadcasts a side only under autoBroadcastJoinThreshold.
    """
    columns = columns or SALES_COLUMNS
    needed = {table for c in columns for table in _COLUMNS[c][0]}
    lines = read_table(spark, sf_dir, "lineitem")
    if "orders" in needed:
        orders = read_table(spark, sf_dir, "orders")
        if "customer" in needed:
            buyers = read_table(spark, sf_dir, "customer")
            if "nation" in needed:
                places = read_table(spark, sf_dir, "nation")
                if "region" in needed:
                    regions = read_table(spark, sf_dir, "region")
                    places = places.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
                buyers = buyers.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
            orders = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "part" in needed:
        lines = lines.join(read_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(*[F.expr(_COLUMNS[c][1]).alias(c) for c in columns])

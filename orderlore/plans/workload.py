"""The fixed question workload over the `sales` view.

Every entry is (question, plan). A plan receives `s`, which returns the view restricted to the named
columns, so that only the needed columns and joins reach the scan. Named values of the retail
questions (West, Technology, 2022, ...) are mapped to values that exist in the order tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlore.functions.numeric import exact_mean, exact_sum, ratio
from orderlore.plans.star import sales_view

# fixed values: the retail question's words and the value each stands for in the order tables
EAST, WEST = "ASIA", "AMERICA"
CALIFORNIA, NEW_YORK = "NATION_3", "NATION_7"
TECHNOLOGY, FURNITURE = "PROMO", "STANDARD"
CONSUMER, CORPORATE = "BUILDING", "MACHINERY"
STANDARD_CLASS, FIRST_CLASS = "N", "A"
HIGH_PRIORITY = "2-HIGH"
CHAIRS = "Brand#13"
FOUR_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]
Y2020, Y2021, Y2022, Y2023 = 1997, 1998, 1999, 2000

Sales = Callable[..., DataFrame]


def _total(column: str, name: str | None = None) -> Column:
    return exact_sum(column).alias(name or f"total_{column}")


def _mean(column: str, name: str | None = None) -> Column:
    return exact_mean(column).alias(name or f"avg_{column}")


def _distinct(column: str, name: str) -> Column:
    return F.count_distinct(column).alias(name)


def _margin(name: str = "profit_margin") -> Column:
    return ratio(exact_sum("profit"), exact_sum("sales")).alias(name)


def _margin_pct() -> Column:
    return (ratio(exact_sum("profit"), exact_sum("sales")) * 100).alias("profit_margin_pct")


def _between(start: str, end: str) -> Column:
    """Half-open date range; kept as a range so that it is pushed down to the orders scan."""
    day = F.col("order_date")
    return (day >= F.to_timestamp_ntz(F.lit(start))) & (day < F.to_timestamp_ntz(F.lit(end)))


def _in_year(first: int, last: int | None = None) -> Column:
    return _between(f"{first}-01-01 00:00:00", f"{(last or first) + 1}-01-01 00:00:00")


def _period(unit: str) -> Column:
    """First day of the period as text, e.g. 1999-04-01 for the second quarter of 1999."""
    return F.date_format(F.date_trunc(unit, "order_date"), "yyyy-MM-dd").alias(unit)


def _year() -> Column:
    return F.year("order_date").cast("bigint").alias("year")


def _quarter() -> Column:
    return F.quarter("order_date").cast("bigint").alias("quarter")


def _per_order(s: Sales, column: str, *keys: str) -> DataFrame:
    """One row per order with the sum of `column`; `keys` are attributes of the order."""
    return s("order_id", column, *keys).groupBy("order_id", *keys).agg(exact_sum(column).alias("order_value"))


def _top(df: DataFrame, n: int, measure: str, *ties: str, ascending: bool = False) -> DataFrame:
    order = F.col(measure).asc() if ascending else F.col(measure).desc()
    return df.orderBy(order, *ties).limit(n)


def _growth(df: DataFrame, period: str, measure: str) -> DataFrame:
    """Change against the previous period. One row per period, so one window task is enough."""
    before = F.lag(measure).over(Window.orderBy(period))
    return df.withColumn("previous", before).withColumn(
        "growth_pct", ratio(F.col(measure) - F.col("previous"), F.col("previous")) * 100
    )


def _ranked(df: DataFrame, measure: str, rank: Callable[[], Column] = F.rank) -> DataFrame:
    """Rank of already aggregated groups."""
    return df.withColumn("rank", rank().over(Window.orderBy(F.col(measure).desc())).cast("bigint"))


def _share(df: DataFrame, measure: str, name: str = "share_pct") -> DataFrame:
    """Share of the grand total, over already aggregated groups; the total is a scalar subquery."""
    whole = df.select(F.sum(F.col(measure).cast("decimal(38,4)")).cast("double")).scalar()
    return df.select("*", (ratio(F.col(measure), whole) * 100).alias(name))


AGGREGATION = {
    "W-AGG01": ("What is the total sales?", lambda s: s("sales").agg(_total("sales"))),
    "W-AGG02": ("Calculate the sum of all profits", lambda s: s("profit").agg(_total("profit"))),
    "W-AGG03": ("Count the total number of orders", lambda s: s("order_id").agg(_distinct("order_id", "order_count"))),
    "W-AGG04": ("Find the average discount rate", lambda s: s("discount").agg(_mean("discount"))),
    "W-AGG05": (
        "What is the maximum single order value?",
        lambda s: _per_order(s, "sales").agg(F.max("order_value").alias("max_order_value")),
    ),
    "W-AGG06": (
        "What is the minimum profit recorded?",
        lambda s: s("profit").agg(F.round(F.min("profit"), 4).alias("min_profit")),
    ),
    "W-AGG07": ("Calculate total quantity sold across all orders", lambda s: s("quantity").agg(_total("quantity"))),
    "W-AGG08": ("What is the average shipping cost?", lambda s: s("shipping_cost").agg(_mean("shipping_cost"))),
    "W-AGG09": (
        "Count the number of unique customers",
        lambda s: s("customer_id").agg(_distinct("customer_id", "customer_count")),
    ),
    "W-AGG10": ("Sum of sales by region", lambda s: s("region", "sales").groupBy("region").agg(_total("sales"))),
    "W-AGG11": (
        "Calculate average sales per order",
        lambda s: _per_order(s, "sales").agg(_mean("order_value", "avg_sales_per_order")),
    ),
    "W-AGG12": (
        "What is total profit by category?",
        lambda s: s("category", "profit").groupBy("category").agg(_total("profit")),
    ),
    "W-AGG13": (
        "Count orders by customer segment",
        lambda s: s("segment", "order_id").groupBy("segment").agg(_distinct("order_id", "order_count")),
    ),
    "W-AGG14": (
        "Find maximum discount percentage given",
        lambda s: s("discount").agg((F.max("discount") * 100).alias("max_discount_pct")),
    ),
    "W-AGG15": (
        "What is minimum shipping cost per order?",
        lambda s: _per_order(s, "shipping_cost").agg(F.min("order_value").alias("min_shipping_cost")),
    ),
    "W-AGG16": (
        "Calculate total sales in Technology category",
        lambda s: s("category", "sales").where(F.col("category") == TECHNOLOGY).agg(_total("sales")),
    ),
    "W-AGG17": (
        "Find average quantity per order",
        lambda s: _per_order(s, "quantity").agg(_mean("order_value", "avg_quantity_per_order")),
    ),
    "W-AGG18": (
        "Sum of profits in Furniture category",
        lambda s: s("category", "profit").where(F.col("category") == FURNITURE).agg(_total("profit")),
    ),
    "W-AGG19": (
        "Count number of orders in East region",
        lambda s: s("region", "order_id").where(F.col("region") == EAST).agg(_distinct("order_id", "order_count")),
    ),
    "W-AGG20": (
        "What is the maximum sales value in a single transaction?",
        lambda s: s("sales").agg(F.round(F.max("sales"), 4).alias("max_sales")),
    ),
}


def _lines(s: Sales, *extra: str) -> DataFrame:
    """Detail rows: the order line with its money and the columns the question is about."""
    return s("order_id", "product_id", "sales", "profit", *extra).withColumns(
        {"sales": F.round("sales", 4), "profit": F.round("profit", 4)}
    )


FILTERING = {
    "W-FIL01": (
        "Show me all orders from California",
        lambda s: _lines(s, "state", "customer_id").where(F.col("state") == CALIFORNIA),
    ),
    "W-FIL02": (
        "List products with profit greater than $500",
        lambda s: s("product_name", "profit")
        .groupBy("product_name")
        .agg(_total("profit"))
        .where(F.col("total_profit") > 500),
    ),
    "W-FIL03": (
        "Find orders with discount greater than or equal to 0.2",
        lambda s: _lines(s, "discount").where(F.col("discount") >= 0.05),
    ),
    "W-FIL04": (
        "Display only Technology category products",
        lambda s: _lines(s, "category", "product_name").where(F.col("category") == TECHNOLOGY),
    ),
    "W-FIL05": (
        "Show Consumer segment customer orders",
        lambda s: _lines(s, "segment", "customer_id").where(F.col("segment") == CONSUMER),
    ),
    "W-FIL06": (
        "List orders with Standard Class shipping",
        lambda s: _lines(s, "ship_mode").where(F.col("ship_mode") == STANDARD_CLASS),
    ),
    "W-FIL07": (
        "Show all Furniture category items",
        lambda s: _lines(s, "category", "product_name").where(F.col("category") == FURNITURE),
    ),
    "W-FIL08": (
        "Display only High priority orders",
        lambda s: _lines(s, "order_priority").where(F.col("order_priority") == HIGH_PRIORITY),
    ),
    "W-FIL09": ("Find sales transactions above $1000", lambda s: _lines(s).where(F.col("sales") > 80000)),
    "W-FIL10": (
        "Show customers from West region",
        lambda s: s("customer_id", "customer_name", "region")
        .where(F.col("region") == WEST)
        .select("customer_id", "customer_name")
        .distinct(),
    ),
    "W-FIL11": (
        "List all orders from 2022",
        lambda s: _lines(s, "order_date")
        .where(_in_year(Y2022))
        .withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd")),
    ),
    "W-FIL12": (
        "Find products with negative profit",
        lambda s: s("product_name", "profit")
        .groupBy("product_name")
        .agg(_total("profit"))
        .where(F.col("total_profit") < 0),
    ),
    "W-FIL13": (
        "Show orders with discount above 15 percent",
        lambda s: _lines(s, "discount").where(F.col("discount") > 0.08),
    ),
    "W-FIL14": (
        "Display orders shipped to New York state",
        lambda s: _lines(s, "state", "customer_id").where(F.col("state") == NEW_YORK),
    ),
    "W-FIL15": (
        "List sub-category of Chairs only",
        lambda s: _lines(s, "sub_category", "product_name").where(F.col("sub_category") == CHAIRS),
    ),
    "W-FIL16": (
        "Show Corporate segment orders",
        lambda s: _lines(s, "segment", "customer_id").where(F.col("segment") == CORPORATE),
    ),
    "W-FIL17": ("Find sales below $100", lambda s: _lines(s).where(F.col("sales") < 5000)),
    "W-FIL18": (
        "List orders with quantity greater than 5",
        lambda s: _lines(s, "quantity").where(F.col("quantity") > 40),
    ),
    "W-FIL19": (
        "Show orders with shipping cost under $10",
        lambda s: _lines(s, "shipping_cost")
        .where(F.col("shipping_cost") < 100)
        .withColumn("shipping_cost", F.round("shipping_cost", 4)),
    ),
    "W-FIL20": (
        "Find profits between $100 and $500",
        lambda s: _lines(s).where(F.col("profit").between(1000, 5000)),
    ),
}


def _by(s: Sales, key: str, measure: str, aggregate: Column) -> DataFrame:
    return s(key, measure).groupBy(key).agg(aggregate)


RANKING = {
    "W-TOP01": (
        "What are the top 10 products by total sales?",
        lambda s: _top(_by(s, "product_name", "sales", _total("sales")), 10, "total_sales", "product_name"),
    ),
    "W-TOP02": (
        "Show me the bottom 5 states by profit",
        lambda s: _top(_by(s, "state", "profit", _total("profit")), 5, "total_profit", "state", ascending=True),
    ),
    "W-TOP03": (
        "List the top 20 customers by total spending",
        lambda s: _top(_by(s, "customer_id", "sales", _total("sales")), 20, "total_sales", "customer_id"),
    ),
    "W-TOP04": (
        "Find the worst performing 10 products by profit",
        lambda s: _top(
            _by(s, "product_name", "profit", _total("profit")), 10, "total_profit", "product_name", ascending=True
        ),
    ),
    "W-TOP05": (
        "Which products have the highest discount percentages?",
        lambda s: _top(
            _by(s, "product_name", "discount", F.max("discount").alias("max_discount")),
            10,
            "max_discount",
            "product_name",
        ),
    ),
    "W-TOP06": (
        "Show me the 5 regions with lowest sales",
        lambda s: _top(_by(s, "region", "sales", _total("sales")), 5, "total_sales", "region", ascending=True),
    ),
    "W-TOP07": (
        "What are the most popular 10 categories by order count?",
        lambda s: _top(
            _by(s, "category", "order_id", _distinct("order_id", "order_count")), 10, "order_count", "category"
        ),
    ),
    "W-TOP08": (
        "List the 5 least sold sub-categories",
        lambda s: _top(
            _by(s, "sub_category", "quantity", _total("quantity")), 5, "total_quantity", "sub_category", ascending=True
        ),
    ),
    "W-TOP09": (
        "Show top 5 customer segments by profitability",
        lambda s: _top(_by(s, "segment", "profit", _total("profit")), 5, "total_profit", "segment"),
    ),
    "W-TOP10": (
        "Which are the 3 least used shipping modes?",
        lambda s: _top(
            s("ship_mode").groupBy("ship_mode").agg(F.count("*").alias("line_count")),
            3,
            "line_count",
            "ship_mode",
            ascending=True,
        ),
    ),
    "W-TOP11": (
        "Find top 10 products by profit margin",
        lambda s: _top(
            s("product_name", "profit", "sales").groupBy("product_name").agg(_margin()),
            10,
            "profit_margin",
            "product_name",
        ),
    ),
    "W-TOP12": (
        "List bottom 5 states by total revenue",
        lambda s: _top(_by(s, "state", "sales", _total("sales")), 5, "total_sales", "state", ascending=True),
    ),
    "W-TOP13": (
        "Who are the top 15 most frequent customers?",
        lambda s: _top(
            _by(s, "customer_id", "order_id", _distinct("order_id", "order_count")), 15, "order_count", "customer_id"
        ),
    ),
    "W-TOP14": (
        "What are the 10 least ordered products?",
        lambda s: _top(
            s("product_name").groupBy("product_name").agg(F.count("*").alias("line_count")),
            10,
            "line_count",
            "product_name",
            ascending=True,
        ),
    ),
    "W-TOP15": (
        "Show top 7 regions by order count",
        lambda s: _top(_by(s, "region", "order_id", _distinct("order_id", "order_count")), 7, "order_count", "region"),
    ),
    "W-TOP16": (
        "Find bottom 5 categories by quantity sold",
        lambda s: _top(
            _by(s, "category", "quantity", _total("quantity")), 5, "total_quantity", "category", ascending=True
        ),
    ),
    "W-TOP17": (
        "Which were the best 6 performing months?",
        lambda s: _top(
            s("order_date", "sales").groupBy(_period("month")).agg(_total("sales")), 6, "total_sales", "month"
        ),
    ),
    "W-TOP18": (
        "List 10 products with highest sales volume",
        lambda s: _top(_by(s, "product_name", "quantity", _total("quantity")), 10, "total_quantity", "product_name"),
    ),
    "W-TOP19": (
        "Show 5 orders with highest total value",
        lambda s: _top(_per_order(s, "sales"), 5, "order_value", "order_id"),
    ),
    "W-TOP20": (
        "Find 10 customers with lowest average order value",
        lambda s: _top(
            _per_order(s, "sales", "customer_id").groupBy("customer_id").agg(_mean("order_value")),
            10,
            "avg_order_value",
            "customer_id",
            ascending=True,
        ),
    ),
}


def _over_time(s: Sales, unit: str, measure: str, aggregate: Column, window: Column | None = None) -> DataFrame:
    rows = s("order_date", measure)
    rows = rows if window is None else rows.where(window)
    return rows.groupBy(_period(unit)).agg(aggregate)


def _by_year(s: Sales, measure: str, aggregate: Column, window: Column | None = None) -> DataFrame:
    rows = s("order_date", measure)
    rows = rows if window is None else rows.where(window)
    return rows.groupBy(_year()).agg(aggregate)


def _order_count() -> Column:
    return _distinct("order_id", "order_count")


TIME = {
    "W-TIM01": (
        "Show me the sales trend from 2020 to 2023",
        lambda s: _over_time(s, "month", "sales", _total("sales"), _in_year(Y2020, Y2023)),
    ),
    "W-TIM02": (
        "What was the monthly revenue in 2022?",
        lambda s: _over_time(s, "month", "sales", _total("sales"), _in_year(Y2022)),
    ),
    "W-TIM03": (
        "Calculate quarterly profit for 2021",
        lambda s: _over_time(s, "quarter", "profit", _total("profit"), _in_year(Y2021)),
    ),
    "W-TIM04": ("Display weekly order patterns", lambda s: _over_time(s, "week", "order_id", _order_count())),
    "W-TIM05": (
        "What were daily sales in January 2022?",
        lambda s: _over_time(
            s, "day", "sales", _total("sales"), _between(f"{Y2022}-01-01 00:00:00", f"{Y2022}-02-01 00:00:00")
        ),
    ),
    "W-TIM06": (
        "Show year-over-year sales growth from 2020 to 2023",
        lambda s: _growth(
            _by_year(s, "sales", _total("sales"), _in_year(Y2020, Y2023)), "year", "total_sales"
        ),
    ),
    "W-TIM07": (
        "Analyze seasonal trends in Furniture category",
        lambda s: s("order_date", "category", "sales")
        .where(F.col("category") == FURNITURE)
        .groupBy(_quarter())
        .agg(_total("sales")),
    ),
    "W-TIM08": (
        "Calculate monthly profit margins for 2021",
        lambda s: s("order_date", "profit", "sales")
        .where(_in_year(Y2021))
        .groupBy(_period("month"))
        .agg(_margin()),
    ),
    "W-TIM09": (
        "Show sales by month in 2022",
        lambda s: s("order_date", "sales")
        .where(_in_year(Y2022))
        .groupBy(F.month("order_date").cast("bigint").alias("month_number"))
        .agg(_total("sales")),
    ),
    "W-TIM10": (
        "How many orders per quarter in 2021?",
        lambda s: _over_time(s, "quarter", "order_id", _order_count(), _in_year(Y2021)),
    ),
    "W-TIM11": ("Display revenue trend over all 4 years", lambda s: _by_year(s, "sales", _total("sales"))),
    "W-TIM12": (
        "What was profit by year from 2020 to 2023?",
        lambda s: _by_year(s, "profit", _total("profit"), _in_year(Y2020, Y2023)),
    ),
    "W-TIM13": (
        "Show monthly order volume for 2020",
        lambda s: _over_time(s, "month", "order_id", _order_count(), _in_year(Y2020)),
    ),
    "W-TIM14": (
        "Calculate quarterly growth rate for 2022",
        lambda s: _growth(
            _over_time(s, "quarter", "sales", _total("sales"), _in_year(Y2022)), "quarter", "total_sales"
        ),
    ),
    "W-TIM15": (
        "Compare yearly sales from 2020 to 2023",
        lambda s: _by_year(s, "sales", _total("sales"), _in_year(Y2020, Y2023)),
    ),
    "W-TIM16": (
        "What were sales in December 2021?",
        lambda s: s("order_date", "sales")
        .where(_between(f"{Y2021}-12-01 00:00:00", f"{Y2021 + 1}-01-01 00:00:00"))
        .agg(_total("sales")),
    ),
    "W-TIM17": (
        "Show orders in Q1 2022",
        lambda s: _lines(s, "order_date")
        .where(_between(f"{Y2022}-01-01 00:00:00", f"{Y2022}-04-01 00:00:00"))
        .withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd")),
    ),
    "W-TIM18": (
        "Display revenue in summer months of 2021",
        lambda s: _over_time(
            s, "month", "sales", _total("sales"), _between(f"{Y2021}-06-01 00:00:00", f"{Y2021}-09-01 00:00:00")
        ),
    ),
    "W-TIM19": (
        "What was profit in winter season 2020?",
        lambda s: s("order_date", "profit")
        .where(_in_year(Y2020) & F.month("order_date").isin(12, 1, 2))
        .agg(_total("profit")),
    ),
    "W-TIM20": (
        "Calculate monthly average order value for 2022",
        lambda s: _per_order(lambda *c: s(*c).where(_in_year(Y2022)), "sales", "order_date")
        .groupBy(_period("month"))
        .agg(_mean("order_value")),
    ),
    "W-TIM21": (
        "Show quarterly customer counts for 2021",
        lambda s: _over_time(
            s, "quarter", "customer_id", _distinct("customer_id", "customer_count"), _in_year(Y2021)
        ),
    ),
    "W-TIM22": (
        "What were yearly profit margin trends?",
        lambda s: s("order_date", "profit", "sales").groupBy(_year()).agg(_margin()),
    ),
    "W-TIM23": (
        "Which months had peak sales in 2022?",
        lambda s: _ranked(_over_time(s, "month", "sales", _total("sales"), _in_year(Y2022)), "total_sales").where(
            F.col("rank") == 1
        ),
    ),
    "W-TIM24": (
        "Display order frequency by month in 2021",
        lambda s: s("order_date", "order_id")
        .where(_in_year(Y2021))
        .groupBy(F.month("order_date").cast("bigint").alias("month_number"))
        .agg(_order_count()),
    ),
    "W-TIM25": (
        "Show revenue by quarter for all years",
        lambda s: s("order_date", "sales").groupBy(_year(), _quarter()).agg(_total("sales")),
    ),
}


def _two(s: Sales, key: str, values: tuple[str, str], measure: str, *aggregates: Column) -> DataFrame:
    return s(key, measure).where(F.col(key).isin(*values)).groupBy(key).agg(*aggregates)


COMPARISON = {
    "W-CMP01": (
        "Compare sales between East and West regions",
        lambda s: _two(s, "region", (EAST, WEST), "sales", _total("sales")),
    ),
    "W-CMP02": (
        "Consumer vs Corporate segment profitability",
        lambda s: _two(s, "segment", (CONSUMER, CORPORATE), "profit", _total("profit")),
    ),
    "W-CMP03": (
        "Technology vs Furniture category revenue",
        lambda s: _two(s, "category", (TECHNOLOGY, FURNITURE), "sales", _total("sales")),
    ),
    "W-CMP04": (
        "Compare 2022 sales to 2023 sales",
        lambda s: _by_year(s, "sales", _total("sales"), _in_year(Y2022, Y2023)),
    ),
    "W-CMP05": (
        "Standard Class vs First Class shipping costs",
        lambda s: _two(
            s,
            "ship_mode",
            (STANDARD_CLASS, FIRST_CLASS),
            "shipping_cost",
            _total("shipping_cost"),
            _mean("shipping_cost"),
        ),
    ),
    "W-CMP06": (
        "Q1 2022 vs Q4 2022 performance",
        lambda s: s("order_date", "sales")
        .where(_between(f"{Y2022}-01-01 00:00:00", f"{Y2022}-04-01 00:00:00") | _between(f"{Y2022}-10-01 00:00:00", f"{Y2022 + 1}-01-01 00:00:00"))
        .agg(
            exact_sum(F.when(F.quarter("order_date") == 1, F.col("sales"))).alias("q1_sales"),
            exact_sum(F.when(F.quarter("order_date") == 4, F.col("sales"))).alias("q4_sales"),
        ),
    ),
    "W-CMP07": (
        "Compare all three customer segments by profit",
        lambda s: _by(s, "segment", "profit", _total("profit")),
    ),
    "W-CMP08": (
        "Regional sales comparison across all regions",
        lambda s: s("region", "sales").groupBy("region").agg(_total("sales"), F.count("*").alias("line_count")),
    ),
    "W-CMP09": (
        "Category revenue comparison for all categories",
        lambda s: _by(s, "category", "sales", _total("sales")),
    ),
    "W-CMP10": (
        "Product performance comparison by region",
        lambda s: s("product_name", "region", "sales")
        .groupBy("product_name")
        .pivot("region", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])
        .agg(exact_sum("sales"))
        .withColumnRenamed("MIDDLE EAST", "MIDDLE_EAST"),
    ),
    "W-CMP11": (
        "Customer segments ranked by average profit",
        lambda s: _ranked(_by(s, "segment", "profit", _mean("profit")), "avg_profit"),
    ),
    "W-CMP12": (
        "Shipping modes compared by total cost",
        lambda s: _by(s, "ship_mode", "shipping_cost", _total("shipping_cost")),
    ),
    "W-CMP13": (
        "Sub-categories compared by total sales",
        lambda s: _by(s, "sub_category", "sales", _total("sales")),
    ),
    "W-CMP14": (
        "States ranked by order count",
        lambda s: _ranked(_by(s, "state", "order_id", _order_count()), "order_count", F.dense_rank),
    ),
    "W-CMP15": (
        "Years compared by growth rate",
        lambda s: _ranked(
            _growth(_by_year(s, "sales", _total("sales")), "year", "total_sales").where(
                F.col("growth_pct").isNotNull()
            ),
            "growth_pct",
        ),
    ),
    "W-CMP16": (
        "Months compared by revenue in 2022",
        lambda s: _ranked(_over_time(s, "month", "sales", _total("sales"), _in_year(Y2022)), "total_sales"),
    ),
    "W-CMP17": (
        "Regions compared by unique customer count",
        lambda s: _by(s, "region", "customer_id", _distinct("customer_id", "customer_count")),
    ),
    "W-CMP18": (
        "Categories compared by profit margin percentage",
        lambda s: s("category", "profit", "sales").groupBy("category").agg(_margin_pct()),
    ),
    "W-CMP19": (
        "Segments compared by average order value",
        lambda s: _per_order(s, "sales", "segment").groupBy("segment").agg(_mean("order_value")),
    ),
    "W-CMP20": (
        "Quarters compared by sales volume in 2021",
        lambda s: _over_time(s, "quarter", "quantity", _total("quantity"), _in_year(Y2021)),
    ),
}


def _grouped(s: Sales, keys: tuple, measure: str, aggregate: Column) -> DataFrame:
    """Group by named columns, or by periods of the order date given as columns."""
    names = [k for k in keys if isinstance(k, str)]
    dated = ["order_date"] if len(names) < len(keys) else []
    return s(*names, *dated, measure).groupBy(*keys).agg(aggregate)


GROUPING = {
    "W-GRP01": ("Sales by region and category", lambda s: _grouped(s, ("region", "category"), "sales", _total("sales"))),
    "W-GRP02": (
        "Profit by segment and sub-category",
        lambda s: _grouped(s, ("segment", "sub_category"), "profit", _total("profit")),
    ),
    "W-GRP03": ("Order count by state and year", lambda s: _grouped(s, ("state", _year()), "order_id", _order_count())),
    "W-GRP04": (
        "Average discount by category and segment",
        lambda s: _grouped(s, ("category", "segment"), "discount", _mean("discount")),
    ),
    "W-GRP05": (
        "Total sales by region and customer segment",
        lambda s: _grouped(s, ("region", "segment"), "sales", _total("sales")),
    ),
    "W-GRP06": (
        "Quantity sold by category and month",
        lambda s: _grouped(s, ("category", _period("month")), "quantity", _total("quantity")),
    ),
    "W-GRP07": (
        "Shipping cost by mode and region",
        lambda s: _grouped(s, ("ship_mode", "region"), "shipping_cost", _total("shipping_cost")),
    ),
    "W-GRP08": ("Revenue by year and quarter", lambda s: _grouped(s, (_year(), _quarter()), "sales", _total("sales"))),
    "W-GRP09": (
        "Profit margin by category and region",
        lambda s: s("category", "region", "profit", "sales").groupBy("category", "region").agg(_margin()),
    ),
    "W-GRP10": (
        "Customer count by segment and state",
        lambda s: _grouped(s, ("segment", "state"), "customer_id", _distinct("customer_id", "customer_count")),
    ),
    "W-GRP11": (
        "Order value by priority and segment",
        lambda s: _grouped(s, ("order_priority", "segment"), "sales", _total("sales")),
    ),
    "W-GRP12": (
        "Discount percentage by category and year",
        lambda s: _grouped(
            s, ("category", _year()), "discount", (exact_mean("discount") * 100).alias("avg_discount_pct")
        ),
    ),
    "W-GRP13": ("Sales by ship mode and region", lambda s: _grouped(s, ("ship_mode", "region"), "sales", _total("sales"))),
    "W-GRP14": (
        "Profit by sub-category and segment",
        lambda s: _grouped(s, ("sub_category", "segment"), "profit", _total("profit")),
    ),
    "W-GRP15": ("Revenue by state and category", lambda s: _grouped(s, ("state", "category"), "sales", _total("sales"))),
    "W-GRP16": (
        "Order frequency by segment and month",
        lambda s: _grouped(s, ("segment", _period("month")), "order_id", _order_count()),
    ),
    "W-GRP17": ("Average sales by region and year", lambda s: _grouped(s, ("region", _year()), "sales", _mean("sales"))),
    "W-GRP18": (
        "Total profit by category and quarter",
        lambda s: _grouped(s, ("category", _period("quarter")), "profit", _total("profit")),
    ),
    "W-GRP19": (
        "Shipping costs by mode and year",
        lambda s: _grouped(s, ("ship_mode", _year()), "shipping_cost", _total("shipping_cost")),
    ),
    "W-GRP20": (
        "Customer spending by segment and region",
        lambda s: _grouped(s, ("segment", "region"), "sales", _total("sales")),
    ),
}


def _repeat_customers(s: Sales) -> DataFrame:
    orders = s("customer_id", "order_id").groupBy("customer_id").agg(_order_count())
    return orders.agg(
        F.count_if(F.col("order_count") > 1).alias("repeat_customers"),
        F.count("*").alias("all_customers"),
        (ratio(F.count_if(F.col("order_count") > 1), F.count("*")) * 100).alias("retention_pct"),
    )


def _sold_in_every_region(s: Sales) -> DataFrame:
    """Relational division: products whose region count equals the number of regions with sales."""
    sold = s("product_name", "region").distinct()
    regions = sold.select(F.count_distinct("region")).scalar()
    return sold.groupBy("product_name").agg(F.count("*").alias("region_count")).where(F.col("region_count") == regions)


def _running(df: DataFrame, period: str, measure: str, name: str) -> DataFrame:
    """Running total over already aggregated periods: one row per period of the calendar."""
    window = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(F.col(measure).cast("decimal(38,4)")).over(window).cast("double"))


def _top_product_per_region(s: Sales) -> DataFrame:
    totals = s("region", "product_name", "sales").groupBy("region", "product_name").agg(_total("sales"))
    best = Window.partitionBy("region").orderBy(F.col("total_sales").desc(), "product_name")
    return totals.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def _above_average_customers(s: Sales) -> DataFrame:
    orders = _per_order(s, "sales", "customer_id")
    overall = orders.select(exact_mean("order_value")).scalar()
    return orders.groupBy("customer_id").agg(_mean("order_value")).where(F.col("avg_order_value") > overall)


def _seasonal_products(s: Sales) -> DataFrame:
    """Products that sell more than 28 % of their quantity in one quarter of the year."""
    seasons = s("product_name", "order_date", "quantity").groupBy("product_name", _quarter()).agg(_total("quantity"))
    whole = F.sum("total_quantity").over(Window.partitionBy("product_name"))
    return seasons.withColumn("season_pct", ratio(F.col("total_quantity"), whole) * 100).where("season_pct > 28")


def _price_bands(s: Sales) -> DataFrame:
    sales = F.col("sales")
    band = (
        F.when(sales < 10000, "under 10k")
        .when(sales < 30000, "10k to 30k")
        .when(sales < 60000, "30k to 60k")
        .when(sales < 90000, "60k to 90k")
        .otherwise("90k and more")
    )
    return s("sales").groupBy(band.alias("price_range")).agg(F.count("*").alias("line_count"), _total("sales"))


ANALYTICAL = {
    "W-ANL01": (
        "What is the profit margin percentage by category?",
        lambda s: s("category", "profit", "sales").groupBy("category").agg(_margin_pct()),
    ),
    "W-ANL02": ("Calculate customer retention by showing repeat customers", _repeat_customers),
    "W-ANL03": ("Show products that appear in orders across all regions", _sold_in_every_region),
    "W-ANL04": (
        "Find customers who purchased from multiple categories",
        lambda s: s("customer_id", "category")
        .groupBy("customer_id")
        .agg(_distinct("category", "category_count"))
        .where("category_count > 1"),
    ),
    "W-ANL05": (
        "Calculate the running total of sales by month in 2022",
        lambda s: _running(
            _over_time(s, "month", "sales", _total("sales"), _in_year(Y2022)), "month", "total_sales", "running_sales"
        ),
    ),
    "W-ANL06": (
        "Show month-over-month growth rate for 2022",
        lambda s: _growth(_over_time(s, "month", "sales", _total("sales"), _in_year(Y2022)), "month", "total_sales"),
    ),
    "W-ANL07": (
        "Identify products sold in all four regions",
        lambda s: s("product_name", "region")
        .where(F.col("region").isin(FOUR_REGIONS))
        .groupBy("product_name")
        .agg(_distinct("region", "region_count"))
        .where(F.col("region_count") == len(FOUR_REGIONS)),
    ),
    "W-ANL08": (
        "Calculate the percentage contribution of each category to total sales",
        lambda s: _share(_by(s, "category", "sales", _total("sales")), "total_sales", "contribution_pct"),
    ),
    "W-ANL09": ("Find the top product in each region by sales", _top_product_per_region),
    "W-ANL10": ("Show customers with above-average order values", _above_average_customers),
    "W-ANL11": (
        "Calculate the cumulative profit by date",
        lambda s: _running(
            _over_time(s, "day", "profit", _total("profit")), "day", "total_profit", "cumulative_profit"
        ),
    ),
    "W-ANL12": ("Identify seasonal products sold primarily in specific months", _seasonal_products),
    "W-ANL13": ("Show the sales distribution by price ranges", _price_bands),
    "W-ANL14": (
        "Calculate market share by category",
        lambda s: _share(_by(s, "category", "quantity", _total("quantity")), "total_quantity", "market_share_pct"),
    ),
    "W-ANL15": (
        "Find correlation between order quantity and discount rate",
        lambda s: s("quantity", "discount").agg(F.round(F.corr("quantity", "discount"), 8).alias("correlation")),
    ),
}

# The worked examples that accompany the questions.
EXAMPLES = {
    "E01": (
        "What is the total sales by region?",
        lambda s: _by(s, "region", "sales", _total("sales")).orderBy(F.desc("total_sales"), "region"),
    ),
    "E02": (
        "Show me the trend of profit over time",
        lambda s: _over_time(s, "month", "profit", _mean("profit")).orderBy("month"),
    ),
    "E03": (
        "Sales and order lines by segment",
        lambda s: s("segment", "sales").groupBy("segment").agg(_total("sales"), F.count("*").alias("order_count")),
    ),
    "E04": (
        "What are the top 10 products by profit?",
        lambda s: _top(_by(s, "product_name", "profit", _total("profit")), 10, "total_profit", "product_name"),
    ),
    "E05": (
        "Show relationship between discount and profit",
        lambda s: s("discount", "profit")
        .groupBy(F.round("discount", 2).alias("discount_rate"))
        .agg(_mean("profit"), F.count("*").alias("transaction_count"))
        .orderBy("discount_rate"),
    ),
    "E06": (
        "List all orders with details",
        lambda s: _lines(s, "customer_name")
        .orderBy("order_id", "product_id", "sales", "profit")
        .limit(100),
    ),
}

QUESTIONS = {**AGGREGATION, **FILTERING, **RANKING, **TIME, **COMPARISON, **GROUPING, **ANALYTICAL, **EXAMPLES}


def answer(question_id: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUESTIONS[question_id][1](partial(sales_view, spark, sf_dir))

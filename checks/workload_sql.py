"""Reference SQL of the question workload."""

from __future__ import annotations

VIEW = """WITH sales AS (
SELECT l_orderkey AS order_id, l_partkey AS product_id, l_quantity AS quantity, l_discount AS discount,
 l_extendedprice * (1 - l_discount) AS sales, l_extendedprice * l_tax AS shipping_cost, l_returnflag AS ship_mode,
 o_orderdate AS order_date, o_orderpriority AS order_priority, o_custkey AS customer_id, c_name AS customer_name,
 c_mktsegment AS segment, n_name AS state, r_name AS region, p_type AS category, p_brand AS sub_category,
 p_name AS product_name, l_extendedprice * (1 - l_discount) - 2.08 * l_quantity * p_retailprice AS profit
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)
"""


def xsum(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(18,4))) AS DOUBLE)"


def xavg(c: str) -> str:
    return f"({xsum(c)} / COUNT({c}))"


def tot(c: str) -> str:
    return f"{xsum(c)} AS total_{c}"


def avg(c: str, name: str | None = None) -> str:
    return f"{xavg(c)} AS {name or 'avg_' + c}"


MARGIN = f"{xsum('profit')} / NULLIF({xsum('sales')}, 0) AS profit_margin"
MARGIN_PCT = f"{xsum('profit')} / NULLIF({xsum('sales')}, 0) * 100 AS profit_margin_pct"
ORDERS = "COUNT(DISTINCT order_id) AS order_count"
YEAR = "CAST(year(order_date) AS BIGINT) AS year"
QUARTER = "CAST(quarter(order_date) AS BIGINT) AS quarter"


def period(unit: str) -> str:
    return f"strftime(date_trunc('{unit}', order_date), '%Y-%m-%d') AS {unit}"


def years(first: int, last: int | None = None) -> str:
    return f"year(order_date) BETWEEN {first} AND {last or first}"


def grouped(keys: str, agg: str, where: str = "true", tail: str = "") -> str:
    return f"SELECT {keys}, {agg} FROM sales WHERE {where} GROUP BY ALL {tail}"


def whole(agg: str, where: str = "true") -> str:
    return f"SELECT {agg} FROM sales WHERE {where}"


def per_order(c: str, keys: str = "") -> str:
    return f"(SELECT order_id {keys}, {xsum(c)} AS order_value FROM sales GROUP BY ALL)"


def lines(where: str, extra: str = "") -> str:
    return f"SELECT order_id, product_id, round(sales, 4) AS sales, round(profit, 4) AS profit {extra} FROM sales WHERE {where}"


def growth(inner: str, key: str, measure: str) -> str:
    return (
        f"SELECT *, ({measure} - previous) / NULLIF(previous, 0) * 100 AS growth_pct FROM "
        f"(SELECT *, lag({measure}) OVER (ORDER BY {key}) AS previous FROM ({inner}))"
    )


def ranked(inner: str, measure: str, fn: str = "rank") -> str:
    return f"SELECT *, {fn}() OVER (ORDER BY {measure} DESC) AS rank FROM ({inner})"


def share(inner: str, measure: str, name: str) -> str:
    return f"SELECT *, {measure} / CAST(SUM(CAST({measure} AS DECIMAL(18,4))) OVER () AS DOUBLE) * 100 AS {name} FROM ({inner})"


def running(inner: str, key: str, measure: str, name: str) -> str:
    return (
        f"SELECT *, CAST(SUM(CAST({measure} AS DECIMAL(18,4))) OVER (ORDER BY {key} ROWS UNBOUNDED PRECEDING) AS DOUBLE)"
        f" AS {name} FROM ({inner})"
    )


DAY = ", strftime(order_date, '%Y-%m-%d') AS order_date"

_BODIES = {
    "W-AGG01": whole(tot("sales")),
    "W-AGG02": whole(tot("profit")),
    "W-AGG03": whole(ORDERS),
    "W-AGG04": whole(avg("discount")),
    "W-AGG05": f"SELECT MAX(order_value) AS max_order_value FROM {per_order('sales')}",
    "W-AGG06": whole("round(MIN(profit), 4) AS min_profit"),
    "W-AGG07": whole(tot("quantity")),
    "W-AGG08": whole(avg("shipping_cost")),
    "W-AGG09": whole("COUNT(DISTINCT customer_id) AS customer_count"),
    "W-AGG10": grouped("region", tot("sales")),
    "W-AGG11": f"SELECT {avg('order_value', 'avg_sales_per_order')} FROM {per_order('sales')}",
    "W-AGG12": grouped("category", tot("profit")),
    "W-AGG13": grouped("segment", ORDERS),
    "W-AGG14": whole("MAX(discount) * 100 AS max_discount_pct"),
    "W-AGG15": f"SELECT MIN(order_value) AS min_shipping_cost FROM {per_order('shipping_cost')}",
    "W-AGG16": whole(tot("sales"), "category = 'PROMO'"),
    "W-AGG17": f"SELECT {avg('order_value', 'avg_quantity_per_order')} FROM {per_order('quantity')}",
    "W-AGG18": whole(tot("profit"), "category = 'STANDARD'"),
    "W-AGG19": whole(ORDERS, "region = 'ASIA'"),
    "W-AGG20": whole("round(MAX(sales), 4) AS max_sales"),
    "W-FIL01": lines("state = 'NATION_3'", ", state, customer_id"),
    "W-FIL02": f"SELECT * FROM ({grouped('product_name', tot('profit'))}) WHERE total_profit > 500",
    "W-FIL03": lines("discount >= 0.05", ", discount"),
    "W-FIL04": lines("category = 'PROMO'", ", category, product_name"),
    "W-FIL05": lines("segment = 'BUILDING'", ", segment, customer_id"),
    "W-FIL06": lines("ship_mode = 'N'", ", ship_mode"),
    "W-FIL07": lines("category = 'STANDARD'", ", category, product_name"),
    "W-FIL08": lines("order_priority = '2-HIGH'", ", order_priority"),
    "W-FIL09": f"SELECT * FROM ({lines('true')}) WHERE sales > 80000",
    "W-FIL10": "SELECT DISTINCT customer_id, customer_name FROM sales WHERE region = 'AMERICA'",
    "W-FIL11": lines(years(1999), DAY),
    "W-FIL12": f"SELECT * FROM ({grouped('product_name', tot('profit'))}) WHERE total_profit < 0",
    "W-FIL13": lines("discount > 0.08", ", discount"),
    "W-FIL14": lines("state = 'NATION_7'", ", state, customer_id"),
    "W-FIL15": lines("sub_category = 'Brand#13'", ", sub_category, product_name"),
    "W-FIL16": lines("segment = 'MACHINERY'", ", segment, customer_id"),
    "W-FIL17": f"SELECT * FROM ({lines('true')}) WHERE sales < 5000",
    "W-FIL18": lines("quantity > 40", ", quantity"),
    "W-FIL19": lines("shipping_cost < 100", ", round(shipping_cost, 4) AS shipping_cost"),
    "W-FIL20": f"SELECT * FROM ({lines('true')}) WHERE profit BETWEEN 1000 AND 5000",
    "W-TOP01": grouped("product_name", tot("sales"), tail="ORDER BY total_sales DESC, product_name LIMIT 10"),
    "W-TOP02": grouped("state", tot("profit"), tail="ORDER BY total_profit, state LIMIT 5"),
    "W-TOP03": grouped("customer_id", tot("sales"), tail="ORDER BY total_sales DESC, customer_id LIMIT 20"),
    "W-TOP04": grouped("product_name", tot("profit"), tail="ORDER BY total_profit, product_name LIMIT 10"),
    "W-TOP05": grouped(
        "product_name", "MAX(discount) AS max_discount", tail="ORDER BY max_discount DESC, product_name LIMIT 10"
    ),
    "W-TOP06": grouped("region", tot("sales"), tail="ORDER BY total_sales, region LIMIT 5"),
    "W-TOP07": grouped("category", ORDERS, tail="ORDER BY order_count DESC, category LIMIT 10"),
    "W-TOP08": grouped("sub_category", tot("quantity"), tail="ORDER BY total_quantity, sub_category LIMIT 5"),
    "W-TOP09": grouped("segment", tot("profit"), tail="ORDER BY total_profit DESC, segment LIMIT 5"),
    "W-TOP10": grouped("ship_mode", "COUNT(*) AS line_count", tail="ORDER BY line_count, ship_mode LIMIT 3"),
    "W-TOP11": grouped("product_name", MARGIN, tail="ORDER BY profit_margin DESC, product_name LIMIT 10"),
    "W-TOP12": grouped("state", tot("sales"), tail="ORDER BY total_sales, state LIMIT 5"),
    "W-TOP13": grouped("customer_id", ORDERS, tail="ORDER BY order_count DESC, customer_id LIMIT 15"),
    "W-TOP14": grouped("product_name", "COUNT(*) AS line_count", tail="ORDER BY line_count, product_name LIMIT 10"),
    "W-TOP15": grouped("region", ORDERS, tail="ORDER BY order_count DESC, region LIMIT 7"),
    "W-TOP16": grouped("category", tot("quantity"), tail="ORDER BY total_quantity, category LIMIT 5"),
    "W-TOP17": grouped(period("month"), tot("sales"), tail="ORDER BY total_sales DESC, month LIMIT 6"),
    "W-TOP18": grouped("product_name", tot("quantity"), tail="ORDER BY total_quantity DESC, product_name LIMIT 10"),
    "W-TOP19": f"SELECT * FROM {per_order('sales')} ORDER BY order_value DESC, order_id LIMIT 5",
    "W-TOP20": (
        f"SELECT customer_id, {avg('order_value')} FROM {per_order('sales', ', customer_id')} GROUP BY ALL "
        "ORDER BY avg_order_value, customer_id LIMIT 10"
    ),
    "W-TIM01": grouped(period("month"), tot("sales"), years(1997, 2000)),
    "W-TIM02": grouped(period("month"), tot("sales"), years(1999)),
    "W-TIM03": grouped(period("quarter"), tot("profit"), years(1998)),
    "W-TIM04": grouped(period("week"), ORDERS),
    "W-TIM05": grouped(period("day"), tot("sales"), years(1999) + " AND month(order_date) = 1"),
    "W-TIM06": growth(grouped(YEAR, tot("sales"), years(1997, 2000)), "year", "total_sales"),
    "W-TIM07": grouped(QUARTER, tot("sales"), "category = 'STANDARD'"),
    "W-TIM08": grouped(period("month"), MARGIN, years(1998)),
    "W-TIM09": grouped("CAST(month(order_date) AS BIGINT) AS month_number", tot("sales"), years(1999)),
    "W-TIM10": grouped(period("quarter"), ORDERS, years(1998)),
    "W-TIM11": grouped(YEAR, tot("sales")),
    "W-TIM12": grouped(YEAR, tot("profit"), years(1997, 2000)),
    "W-TIM13": grouped(period("month"), ORDERS, years(1997)),
    "W-TIM14": growth(grouped(period("quarter"), tot("sales"), years(1999)), "quarter", "total_sales"),
    "W-TIM15": grouped(YEAR, tot("sales"), years(1997, 2000)),
    "W-TIM16": whole(tot("sales"), years(1998) + " AND month(order_date) = 12"),
    "W-TIM17": lines(years(1999) + " AND quarter(order_date) = 1", DAY),
    "W-TIM18": grouped(period("month"), tot("sales"), years(1998) + " AND month(order_date) IN (6, 7, 8)"),
    "W-TIM19": whole(tot("profit"), years(1997) + " AND month(order_date) IN (12, 1, 2)"),
    "W-TIM20": (
        f"SELECT {period('month')}, {avg('order_value')} FROM {per_order('sales', ', order_date')} "
        f"WHERE {years(1999)} GROUP BY ALL"
    ),
    "W-TIM21": grouped(period("quarter"), "COUNT(DISTINCT customer_id) AS customer_count", years(1998)),
    "W-TIM22": grouped(YEAR, MARGIN),
    "W-TIM23": f"SELECT * FROM ({ranked(grouped(period('month'), tot('sales'), years(1999)), 'total_sales')}) WHERE rank = 1",
    "W-TIM24": grouped("CAST(month(order_date) AS BIGINT) AS month_number", ORDERS, years(1998)),
    "W-TIM25": grouped(f"{YEAR}, {QUARTER}", tot("sales")),
    "W-CMP01": grouped("region", tot("sales"), "region IN ('ASIA', 'AMERICA')"),
    "W-CMP02": grouped("segment", tot("profit"), "segment IN ('BUILDING', 'MACHINERY')"),
    "W-CMP03": grouped("category", tot("sales"), "category IN ('PROMO', 'STANDARD')"),
    "W-CMP04": grouped(YEAR, tot("sales"), years(1999, 2000)),
    "W-CMP05": grouped("ship_mode", tot("shipping_cost") + ", " + avg("shipping_cost"), "ship_mode IN ('N', 'A')"),
    "W-CMP06": whole(
        f"{xsum('CASE WHEN quarter(order_date) = 1 THEN sales END')} AS q1_sales, "
        f"{xsum('CASE WHEN quarter(order_date) = 4 THEN sales END')} AS q4_sales",
        years(1999),
    ),
    "W-CMP07": grouped("segment", tot("profit")),
    "W-CMP08": grouped("region", tot("sales") + ", COUNT(*) AS line_count"),
    "W-CMP09": grouped("category", tot("sales")),
    "W-CMP10": grouped(
        "product_name",
        ", ".join(
            f"CAST(SUM(CAST(sales AS DECIMAL(18,4))) FILTER (region = '{r}') AS DOUBLE) AS {r.replace(' ', '_')}"
            for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
        ),
    ),
    "W-CMP11": ranked(grouped("segment", avg("profit")), "avg_profit"),
    "W-CMP12": grouped("ship_mode", tot("shipping_cost")),
    "W-CMP13": grouped("sub_category", tot("sales")),
    "W-CMP14": ranked(grouped("state", ORDERS), "order_count", "dense_rank"),
    "W-CMP15": ranked(
        f"SELECT * FROM ({growth(grouped(YEAR, tot('sales')), 'year', 'total_sales')}) WHERE growth_pct IS NOT NULL",
        "growth_pct",
    ),
    "W-CMP16": ranked(grouped(period("month"), tot("sales"), years(1999)), "total_sales"),
    "W-CMP17": grouped("region", "COUNT(DISTINCT customer_id) AS customer_count"),
    "W-CMP18": grouped("category", MARGIN_PCT),
    "W-CMP19": f"SELECT segment, {avg('order_value')} FROM {per_order('sales', ', segment')} GROUP BY ALL",
    "W-CMP20": grouped(period("quarter"), tot("quantity"), years(1998)),
    "W-GRP01": grouped("region, category", tot("sales")),
    "W-GRP02": grouped("segment, sub_category", tot("profit")),
    "W-GRP03": grouped(f"state, {YEAR}", ORDERS),
    "W-GRP04": grouped("category, segment", avg("discount")),
    "W-GRP05": grouped("region, segment", tot("sales")),
    "W-GRP06": grouped(f"category, {period('month')}", tot("quantity")),
    "W-GRP07": grouped("ship_mode, region", tot("shipping_cost")),
    "W-GRP08": grouped(f"{YEAR}, {QUARTER}", tot("sales")),
    "W-GRP09": grouped("category, region", MARGIN),
    "W-GRP10": grouped("segment, state", "COUNT(DISTINCT customer_id) AS customer_count"),
    "W-GRP11": grouped("order_priority, segment", tot("sales")),
    "W-GRP12": grouped(f"category, {YEAR}", f"{xavg('discount')} * 100 AS avg_discount_pct"),
    "W-GRP13": grouped("ship_mode, region", tot("sales")),
    "W-GRP14": grouped("sub_category, segment", tot("profit")),
    "W-GRP15": grouped("state, category", tot("sales")),
    "W-GRP16": grouped(f"segment, {period('month')}", ORDERS),
    "W-GRP17": grouped(f"region, {YEAR}", avg("sales")),
    "W-GRP18": grouped(f"category, {period('quarter')}", tot("profit")),
    "W-GRP19": grouped(f"ship_mode, {YEAR}", tot("shipping_cost")),
    "W-GRP20": grouped("segment, region", tot("sales")),
    "W-ANL01": grouped("category", MARGIN_PCT),
    "W-ANL02": (
        "SELECT COUNT(*) FILTER (order_count > 1) AS repeat_customers, COUNT(*) AS all_customers, "
        "COUNT(*) FILTER (order_count > 1) / COUNT(*) * 100 AS retention_pct "
        f"FROM ({grouped('customer_id', ORDERS)})"
    ),
    "W-ANL03": (
        "SELECT product_name, COUNT(DISTINCT region) AS region_count FROM sales GROUP BY 1 "
        "HAVING COUNT(DISTINCT region) = (SELECT COUNT(DISTINCT region) FROM sales)"
    ),
    "W-ANL04": (
        "SELECT customer_id, COUNT(DISTINCT category) AS category_count FROM sales GROUP BY 1 "
        "HAVING COUNT(DISTINCT category) > 1"
    ),
    "W-ANL05": running(grouped(period("month"), tot("sales"), years(1999)), "month", "total_sales", "running_sales"),
    "W-ANL06": growth(grouped(period("month"), tot("sales"), years(1999)), "month", "total_sales"),
    "W-ANL07": (
        "SELECT product_name, COUNT(DISTINCT region) AS region_count FROM sales "
        "WHERE region IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') GROUP BY 1 HAVING COUNT(DISTINCT region) = 4"
    ),
    "W-ANL08": share(grouped("category", tot("sales")), "total_sales", "contribution_pct"),
    "W-ANL09": (
        "SELECT region, product_name, total_sales FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY region ORDER BY total_sales DESC, product_name) AS place FROM ({grouped('region, product_name', tot('sales'))})) "
        "WHERE place = 1"
    ),
    "W-ANL10": (
        f"SELECT customer_id, {avg('order_value')} FROM {per_order('sales', ', customer_id')} GROUP BY 1 "
        f"HAVING {xavg('order_value')} > (SELECT {xavg('order_value')} FROM {per_order('sales')})"
    ),
    "W-ANL11": running(grouped(period("day"), tot("profit")), "day", "total_profit", "cumulative_profit"),
    "W-ANL12": (
        "SELECT * FROM (SELECT *, total_quantity / SUM(total_quantity) OVER (PARTITION BY product_name) * 100 AS season_pct "
        f"FROM ({grouped(f'product_name, {QUARTER}', tot('quantity'))})) WHERE season_pct > 28"
    ),
    "W-ANL13": grouped(
        "CASE WHEN sales < 10000 THEN 'under 10k' WHEN sales < 30000 THEN '10k to 30k' WHEN sales < 60000 THEN '30k to 60k' "
        "WHEN sales < 90000 THEN '60k to 90k' ELSE '90k and more' END AS price_range",
        "COUNT(*) AS line_count, " + tot("sales"),
    ),
    "W-ANL14": share(grouped("category", tot("quantity")), "total_quantity", "market_share_pct"),
    "W-ANL15": whole("round(corr(quantity, discount), 8) AS correlation"),
    "E01": grouped("region", tot("sales"), tail="ORDER BY total_sales DESC, region"),
    "E02": grouped(period("month"), avg("profit"), tail="ORDER BY month"),
    "E03": grouped("segment", tot("sales") + ", COUNT(*) AS order_count"),
    "E04": grouped("product_name", tot("profit"), tail="ORDER BY total_profit DESC, product_name LIMIT 10"),
    "E05": grouped(
        "round(discount, 2) AS discount_rate",
        avg("profit") + ", COUNT(*) AS transaction_count",
        tail="ORDER BY discount_rate",
    ),
    "E06": lines("true", ", customer_name") + " ORDER BY order_id, product_id, 3, 4 LIMIT 100",
}

SQL = {key: VIEW + body for key, body in _BODIES.items()}

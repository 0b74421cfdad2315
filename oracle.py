"""The registered queries as plain SQL over the test tables.

Written from the definitions, not from the Spark code: range joins instead of the exploded
calendar, row-wise long series instead of wide ones, the engine's own quantile function.
"""

from __future__ import annotations

import math
import re
from statistics import NormalDist

_Z = repr(NormalDist().inv_cdf(0.95))


def _r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def _uniform(seed: str, keys: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', '{seed}', {keys})), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"


_AMOUNT = "round(l_extendedprice)::BIGINT::VARCHAR"
_LINE_KEYS = "Product_Code, Warehouse, Product_Category, \"Date\", Order_Demand"

_FEATURES = """month("Date")::INT AS Month, year("Date")::INT AS Year, date_trunc('month', "Date")::DATE AS Month_Year,
    (dayofweek("Date") + 1)::INT AS DOW, strftime("Date", '%V') AS The_Week"""

_CUBE = f"2.0 + 0.5 * (sqrt(-2.0 * ln({_uniform('1234:r', 'Product_Category')})) * cos({2.0 * math.pi!r} * {_uniform('1234:a', 'Product_Category')}))"
_DEST = f"'Dest_' || (floor({_uniform('1234:dest', _LINE_KEYS)} * 8)::INT + 1)"


def _ape(forecast: str, actual: str) -> str:
    return f"""CASE WHEN {forecast} IS NULL OR {actual} IS NULL THEN 0.0
        WHEN {actual} = 0 AND {forecast} - {actual} = 0 THEN 0.0
        WHEN {actual} = 0 THEN 1.0 ELSE abs(({forecast} - {actual}) / {actual}) END"""


def _compared(role: str) -> str:
    return f"""SELECT coalesce(a.cycle_id, f.cycle_id) AS cycle_id, coalesce(a.Warehouse, f.Warehouse) AS Warehouse,
        coalesce(a."Date", f.Fcast_Date) AS "Date", coalesce(a.demand, 0.0) AS act, f.DOW, f.Fcast_Volume,
        coalesce(f."Lower", 0.0) AS lo, coalesce(f."Upper", 0.0) AS up
        FROM (SELECT * FROM role_daily WHERE role = '{role}') a
        FULL JOIN f ON a.cycle_id = f.cycle_id AND a.Warehouse = f.Warehouse AND a."Date" = f.Fcast_Date"""


# Building blocks, in dependency order.
_CTES = {
    "raw": f"""SELECT p_brand AS Product_Code,
        (['Whse_A','Whse_C','Whse_J','Whse_S'])[l_suppkey % 4 + 1] AS Warehouse, p_type AS Product_Category,
        CASE WHEN l_suppkey % 4 = 0 AND l_orderkey % 50 = 0 THEN 'NA' ELSE strftime(l_shipdate, '%Y/%m/%d') END AS "Date",
        CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN '(' || {_AMOUNT} || ')' ELSE {_AMOUNT} END AS Order_Demand
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "typed": """SELECT Product_Code, Warehouse, Product_Category, try_strptime("Date", '%Y/%m/%d')::DATE AS "Date",
        try_cast(translate(Order_Demand, '()', '-') AS DOUBLE) AS Order_Demand FROM raw""",
    "clipped": """SELECT * FROM typed WHERE "Date" > DATE '1995-01-08' AND "Date" < DATE '2001-10-28'""",
    "bounds": """SELECT Warehouse, Product_Code, quantile_cont(Order_Demand, 0.99) AS u, quantile_cont(Order_Demand, 0.01) AS l
        FROM clipped GROUP BY ALL""",
    "flagged": """SELECT c.*, u, l, CASE WHEN Order_Demand > u OR Order_Demand < l THEN 1 ELSE 0 END AS take_out
        FROM clipped c JOIN bounds USING (Warehouse, Product_Code)""",
    "clean": "SELECT * FROM flagged WHERE take_out = 0",
    "daily": 'SELECT Warehouse, "Date", sum(Order_Demand) AS demand FROM clean GROUP BY ALL',
    "months": """SELECT date_trunc('month', "Date")::DATE AS Month_Year, sum(Order_Demand) AS orders FROM clean GROUP BY ALL""",
    "wh_months": """SELECT Warehouse, date_trunc('month', "Date")::DATE AS Month_Year, sum(Order_Demand) AS orders
        FROM clean GROUP BY ALL""",
    "dow_share": """SELECT Month_Year, DOW, orders, orders / nullif(sum(orders) OVER (PARTITION BY Month_Year), 0) AS pct
        FROM (SELECT date_trunc('month', "Date")::DATE AS Month_Year, (dayofweek("Date") + 1)::INT AS DOW,
              sum(Order_Demand) AS orders FROM clean GROUP BY ALL)""",
    "boxes": """SELECT DOW, quantile_cont(pct, 0.25) AS q1, quantile_cont(pct, 0.5) AS med, quantile_cont(pct, 0.75) AS q3
        FROM dow_share GROUP BY DOW""",
    "fw": """SELECT (i + 1)::INT AS cycle_id, d AS delivery, d AS target_start, d + 69 AS target_end,
        d - 364 AS comp_target_start, d + 69 - 364 AS comp_target_end,
        d - 84 AS comp_pre_delivery_start, d - 7 AS comp_pre_delivery_end,
        d - 84 - 364 AS comp_pre_delivery_start_prev, d - 7 - 364 AS comp_pre_delivery_end_prev
        FROM (SELECT i, DATE '1996-04-01' + (14 * i)::INT AS d FROM range(157) t(i))""",
    "roles": """SELECT cycle_id, 'target' AS role, target_start AS a, target_end AS b FROM fw
        UNION ALL SELECT cycle_id, 'comp_target', comp_target_start, comp_target_end FROM fw
        UNION ALL SELECT cycle_id, 'pre', comp_pre_delivery_start, comp_pre_delivery_end FROM fw
        UNION ALL SELECT cycle_id, 'pre_prev', comp_pre_delivery_start_prev, comp_pre_delivery_end_prev FROM fw
        UNION ALL SELECT cycle_id, 'span', comp_pre_delivery_start, target_end FROM fw""",
    "role_daily": """SELECT cycle_id, role, Warehouse, "Date", demand FROM daily JOIN roles ON "Date" BETWEEN a AND b""",
    "totals": """SELECT r.cycle_id, r.role, coalesce(sum(demand), 0.0) AS total FROM roles r
        LEFT JOIN role_daily d ON r.cycle_id = d.cycle_id AND r.role = d.role WHERE r.role <> 'span' GROUP BY ALL""",
    "wide": """SELECT cycle_id, max(total) FILTER (role = 'target') AS target, max(total) FILTER (role = 'comp_target') AS comp_target,
        max(total) FILTER (role = 'pre') AS pre, max(total) FILTER (role = 'pre_prev') AS pre_prev FROM totals GROUP BY cycle_id""",
    "expected": """SELECT cycle_id, comp_target AS v, (pre - pre_prev) / nullif(pre_prev, 0) AS g,
        comp_target * ((pre - pre_prev) / nullif(pre_prev, 0) + 1) AS e FROM wide""",
    "curve": """SELECT cycle_id, Warehouse, DOW, o / nullif(sum(o) OVER (PARTITION BY cycle_id, Warehouse), 0) AS pct_orders
        FROM (SELECT cycle_id, Warehouse, (dayofweek("Date") + 1)::INT AS DOW, sum(demand) AS o
              FROM role_daily WHERE role = 'pre' GROUP BY ALL)""",
    "shares": """SELECT cycle_id, Warehouse, o AS orders, o / nullif(sum(o) OVER (PARTITION BY cycle_id), 0) AS pct_orders
        FROM (SELECT cycle_id, Warehouse, sum(demand) AS o FROM role_daily WHERE role = 'pre' GROUP BY ALL)""",
    "volumes": """SELECT s.cycle_id, s.Warehouse, c.DOW, s.pct_orders * e / 10 * c.pct_orders AS Fcast_Volume
        FROM shares s JOIN expected USING (cycle_id) LEFT JOIN curve c ON s.cycle_id = c.cycle_id AND s.Warehouse = c.Warehouse""",
    "target_days": """SELECT cycle_id, (unnest(generate_series(target_start, target_end, INTERVAL 1 DAY)))::DATE AS Fcast_Date FROM fw""",
    "grid": """SELECT cycle_id, Warehouse, Fcast_Date, (dayofweek(Fcast_Date) + 1)::INT AS DOW
        FROM target_days CROSS JOIN (SELECT DISTINCT Warehouse FROM daily)""",
    "point": """SELECT coalesce(v.cycle_id, g.cycle_id) AS cycle_id, coalesce(v.Warehouse, g.Warehouse) AS Warehouse, Fcast_Date,
        coalesce(v.DOW, g.DOW) AS DOW, coalesce(Fcast_Volume, 0.0) AS Fcast_Volume
        FROM volumes v FULL JOIN grid g ON v.cycle_id = g.cycle_id AND v.Warehouse = g.Warehouse AND v.DOW = g.DOW""",
    "conf": """SELECT coalesce(v.cycle_id, t.cycle_id) AS cycle_id, Warehouse, Fcast_Date, coalesce(v.DOW, t.DOW) AS DOW, Fcast_Volume
        FROM volumes v FULL JOIN (SELECT *, (dayofweek(Fcast_Date) + 1)::INT AS DOW FROM target_days) t
        ON v.cycle_id = t.cycle_id AND v.DOW = t.DOW""",
    "errors": """SELECT a.cycle_id, a.Warehouse, a."Date", a.demand AS Act_Orders, c.DOW, c.Fcast_Volume,
        c.Fcast_Volume - a.demand AS Variance
        FROM (SELECT * FROM role_daily WHERE role = 'target') a
        LEFT JOIN conf c ON a.cycle_id = c.cycle_id AND a.Warehouse IS NOT DISTINCT FROM c.Warehouse AND a."Date" = c.Fcast_Date""",
    "sds": """SELECT cycle_id, Warehouse, DOW, CASE WHEN count(Variance) = count(*) THEN stddev_samp(Variance) END AS vsd
        FROM errors GROUP BY ALL""",
    "calibration": """SELECT a.cycle_id, a.delivery, b.cycle_id AS calibration_id
        FROM fw a LEFT JOIN fw b ON b.delivery = a.delivery - 84""",
    "f": f"""SELECT coalesce(p.cycle_id, s.cycle_id) AS cycle_id, coalesce(p.Warehouse, s.Warehouse) AS Warehouse, Fcast_Date,
        coalesce(p.DOW, s.DOW) AS DOW, Fcast_Volume,
        CASE WHEN Fcast_Volume - vsd * {_Z} < 0 THEN 0.0 ELSE Fcast_Volume - vsd * {_Z} END AS "Lower",
        Fcast_Volume + vsd * {_Z} AS "Upper"
        FROM point p FULL JOIN (SELECT c.cycle_id, Warehouse, DOW, vsd FROM sds JOIN calibration c ON sds.cycle_id = c.calibration_id) s
        ON p.cycle_id = s.cycle_id AND p.Warehouse = s.Warehouse AND p.DOW IS NOT DISTINCT FROM s.DOW""",
    "cmp": _compared("span"),
    "base": f"""SELECT *, {_ape('Fcast_Volume', 'act')} AS ape, strftime("Date", '%V') AS The_Week FROM ({_compared('target')})""",
    "long": """SELECT cycle_id, Warehouse, "Date", 'Act_Orders' AS variable, act AS value FROM cmp
        UNION ALL SELECT cycle_id, Warehouse, "Date", 'Fcast_Volume', Fcast_Volume FROM cmp
        UNION ALL SELECT cycle_id, Warehouse, "Date", 'Lower', lo FROM cmp
        UNION ALL SELECT cycle_id, Warehouse, "Date", 'Upper', up FROM cmp""",
    "k3": """SELECT cycle_id, CASE WHEN count(value) = count(*) THEN sum(value) END AS total FROM long JOIN fw USING (cycle_id)
        WHERE "Date" = delivery AND variable = 'Fcast_Volume' GROUP BY ALL""",
    "k3_wh": """SELECT cycle_id, Warehouse, CASE WHEN count(value) = count(*) THEN sum(value) END AS total
        FROM long JOIN fw USING (cycle_id) WHERE "Date" = delivery AND variable = 'Fcast_Volume' GROUP BY ALL""",
    "k4": """SELECT cycle_id, "Date", variable, CASE WHEN variable = 'Act_Orders'
          THEN CASE WHEN "Date" = delivery THEN total WHEN "Date" < delivery THEN orders END
          ELSE CASE WHEN "Date" >= delivery THEN orders END END AS orders
        FROM (SELECT cycle_id, "Date", variable, coalesce(sum(value), 0.0) AS orders FROM long GROUP BY ALL)
        JOIN fw USING (cycle_id) LEFT JOIN k3 USING (cycle_id)""",
    "k5": """SELECT s.cycle_id, s.Warehouse, "Date", variable, CASE WHEN variable = 'Act_Orders'
          THEN CASE WHEN "Date" = delivery THEN total WHEN "Date" < delivery THEN orders END
          ELSE CASE WHEN "Date" >= delivery THEN orders END END AS orders
        FROM (SELECT cycle_id, Warehouse, "Date", variable, coalesce(sum(value), 0.0) AS orders FROM long GROUP BY ALL) s
        JOIN fw USING (cycle_id) LEFT JOIN k3_wh k ON s.cycle_id = k.cycle_id AND s.Warehouse = k.Warehouse""",
    "k6": """SELECT cycle_id, "Date", variable, CASE WHEN variable = 'Act_Orders'
          THEN CASE WHEN "Date" <= delivery + 47 THEN orders END ELSE CASE WHEN "Date" >= delivery THEN orders END END AS orders
        FROM (SELECT cycle_id, "Date", variable, coalesce(sum(value), 0.0) AS orders FROM long GROUP BY ALL)
        JOIN fw USING (cycle_id)""",
    "lagged": """SELECT a.Warehouse, a."Date", a.demand AS Total_Orders, b.demand AS Forecast_Orders
        FROM daily a LEFT JOIN daily b ON a.Warehouse = b.Warehouse AND b."Date" = a."Date" - 28""",
    "bench": """SELECT cycle_id, Warehouse, Total_Orders, Forecast_Orders FROM lagged JOIN fw ON "Date" BETWEEN target_start AND target_end
        WHERE Forecast_Orders IS NOT NULL""",
    "weeks": f"""SELECT *, {_ape('Fcast_Volume', 'act')} AS ape FROM (
        SELECT cycle_id, The_Week, CASE WHEN count(act) = count(*) THEN sum(act) END AS act,
        CASE WHEN count(Fcast_Volume) = count(*) THEN sum(Fcast_Volume) END AS Fcast_Volume FROM base GROUP BY ALL)""",
    "mix": """SELECT cycle_id, coalesce(a.Product_Category, e.Product_Category) AS Product_Category, actual_pct, expected_pct
        FROM (SELECT cycle_id, Product_Category, o / nullif(sum(o) OVER (PARTITION BY cycle_id), 0) AS actual_pct
              FROM (SELECT cycle_id, Product_Category, sum(Order_Demand) AS o FROM clean JOIN fw
                    ON "Date" BETWEEN target_start AND target_end GROUP BY ALL)) a
        FULL JOIN (SELECT cycle_id, Product_Category, o / nullif(sum(o) OVER (PARTITION BY cycle_id), 0) AS expected_pct
              FROM (SELECT cycle_id, Product_Category, sum(Order_Demand) AS o FROM clean JOIN fw
                    ON "Date" BETWEEN comp_pre_delivery_start AND comp_pre_delivery_end GROUP BY ALL)) e
        USING (cycle_id, Product_Category)""",
}


def _with(body: str) -> str:
    """Prefix the building blocks that ``body`` uses, directly or through others."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name, sql in _CTES.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                todo.append(sql)
    parts = [f"{name} AS ({sql})" for name, sql in _CTES.items() if name in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def _trend(source: str, by: str) -> str:
    """Local quadratic fit by weighted normal equations over a self-join."""
    part = f"PARTITION BY {by}, " if by else "PARTITION BY "
    keys = f"{by}, " if by else ""
    same = f"a.{by} = b.{by} AND " if by else ""
    sel = f"a.{by} AS {by}, " if by else ""
    return f"""WITH_SOURCE, pairs AS (
        SELECT {sel}a.Month_Year, a.orders, (b.Month_Year - a.Month_Year)::DOUBLE AS d, b.orders AS y
        FROM {source} a JOIN {source} b ON {same}TRUE),
      ranked AS (SELECT *, row_number() OVER ({part}Month_Year ORDER BY abs(d)) AS rn,
        count(*) OVER ({part}Month_Year) AS n FROM pairs),
      reach AS (SELECT *, max(CASE WHEN rn = greatest(floor(n * 0.75 + 1e-5), 1) THEN abs(d) END) OVER ({part}Month_Year) AS h
        FROM ranked),
      weighted AS (SELECT *, CASE WHEN abs(d) < h THEN d / h END AS u,
        CASE WHEN abs(d) < h THEN pow(1 - pow(abs(d) / h, 3), 3) END AS w FROM reach),
      m AS (SELECT {keys}Month_Year, any_value(orders) AS orders, count(w) AS k, sum(w) AS s0, sum(w*u) AS s1, sum(w*u*u) AS s2,
        sum(w*u*u*u) AS s3, sum(w*u*u*u*u) AS s4, sum(w*y) AS t0, sum(w*u*y) AS t1, sum(w*u*u*y) AS t2 FROM weighted GROUP BY ALL)
      SELECT {keys}Month_Year, {_r('orders', 2)} AS orders, {_r('''CASE WHEN k >= 3 THEN
        (t0*(s2*s4-s3*s3) - t1*(s1*s4-s2*s3) + t2*(s1*s3-s2*s2)) /
        nullif(s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2), 0) END''', 2)} AS trend FROM m"""


def _trend_sql(source: str, by: str = "") -> str:
    head = _with(f"SELECT 1 FROM {source}").removesuffix(f" SELECT 1 FROM {source}")
    return _trend(source, by).replace("WITH_SOURCE", head)


_CLEAN_COLUMNS = 'Product_Code, Warehouse, Product_Category, "Date", Order_Demand'
_F_COLUMNS = f"""cycle_id, Warehouse, Fcast_Date, DOW, {_r('Fcast_Volume', 2)} AS Fcast_Volume,
    {_r('"Lower"', 2)} AS "Lower", {_r('"Upper"', 2)} AS "Upper\""""
_WEEKEND = """coalesce(dayofweek("Date") IN (0, 6), FALSE)"""
_SERIES = f'cycle_id, "Date", variable, {_r("orders", 2)} AS orders'
_GAP = "coalesce(sum(Fcast_Volume), 0.0) - coalesce(sum(act), 0.0)"
_MAPE = f'{_r("avg(ape)")} AS "MAPE", count(*) AS n_rows, count(*) - count(Fcast_Volume) AS n_no_forecast'


def _error(by: str) -> str:
    keys = f"{by}, " if by else ""
    return f"""SELECT cycle_id, {keys}{_r('v', 2)} AS sum_variance, {_r('v / nullif(comp_target, 0)')} AS pct_variance
        FROM (SELECT cycle_id, {keys}{_GAP} AS v FROM base GROUP BY ALL) JOIN wide USING (cycle_id)"""


def _level(name: str, by: str = "") -> str:
    keys = f", {by}" if by else ""
    shown = ", ".join(f"{c if c == by else 'NULL'}::VARCHAR AS {c}" for c in ("Warehouse", "The_Week"))
    return f"""SELECT cycle_id, '{name}' AS level, {shown}, {_r('v', 2)} AS sum_variance,
        {_r('v / nullif(comp_target, 0)')} AS pct_variance, "MAPE", n_rows, n_no_forecast
        FROM (SELECT cycle_id{keys}, {_GAP} AS v, {_MAPE} FROM base GROUP BY ALL) JOIN wide USING (cycle_id)"""


_EXACT = (
    ("Product_Code", "Product_Code"),
    ("Warehouse", "Warehouse"),
    ("Product_Category", "Product_Category"),
    ("Date", '"Date"'),
    ("Order_Demand", "Order_Demand"),
)

_QUERIES = {
    "read_orders": """SELECT Product_Code, Warehouse, Product_Category, nullif("Date", 'NA') AS "Date", Order_Demand FROM raw""",
    "write_forecast": f"SELECT {_F_COLUMNS}, DATE '2001-10-28' AS run_date FROM f",
    "write_forecast_csv": f"SELECT {_F_COLUMNS}, DATE '2001-10-28' AS run_date FROM f",
    "write_forecast_dow_curve": f"SELECT cycle_id, Warehouse, DOW, {_r('pct_orders')} AS pct_orders, DATE '2001-10-28' AS run_date FROM curve",
    "write_forecast_warehouse_share": f"""SELECT cycle_id, Warehouse, orders, {_r('pct_orders')} AS pct_orders,
        DATE '2001-10-28' AS run_date FROM shares""",
    "parse_dates": """SELECT Product_Code, Warehouse, Product_Category, try_strptime("Date", '%Y/%m/%d')::DATE AS "Date",
        Order_Demand FROM raw""",
    "parse_accounting_numbers": """SELECT Product_Code, Warehouse, Product_Category, "Date",
        try_cast(translate(Order_Demand, '()', '-') AS DOUBLE) AS Order_Demand FROM raw""",
    "calendar_features": f"SELECT {_CLEAN_COLUMNS}, {_FEATURES} FROM typed",
    "attach_category_volume": f"SELECT {_LINE_KEYS}, {_r(_CUBE)} AS Cubic_Volume FROM raw",
    "category_volumes": f"SELECT DISTINCT Product_Category, {_r(_CUBE)} AS Cubic_Volume FROM raw",
    "assign_destination": f"SELECT {_LINE_KEYS}, {_DEST} AS Dest FROM raw",
    "lookup_lines": f"""SELECT {_CLEAN_COLUMNS} FROM typed WHERE Product_Code = 'Brand#20' AND Warehouse = 'Whse_A'
        AND Product_Category = 'LARGE' AND "Date" = DATE '1998-08-29'""",
    "lookup_lines_indexed": f"""SELECT {_CLEAN_COLUMNS} FROM typed WHERE Product_Code = 'Brand#20' AND Warehouse = 'Whse_A'
        AND Product_Category = 'LARGE' AND "Date" = DATE '1998-08-29'""",
    "drop_missing_dates": f'SELECT {_CLEAN_COLUMNS} FROM typed WHERE "Date" IS NOT NULL',
    "missing_dates": f'SELECT {_CLEAN_COLUMNS} FROM typed WHERE "Date" IS NULL',
    "clip_date_range": f"SELECT {_CLEAN_COLUMNS} FROM clipped",
    "distinct_counts": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT nullif({q}, 'NA')) AS n_distinct FROM raw"
        for c, q in _EXACT
    ),
    "distinct_counts_sketch": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT nullif({q}, 'NA')) AS n_distinct, TRUE AS near FROM raw" for c, q in _EXACT
    ),
    "null_counts": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({q}) AS n_null FROM typed"
        for c, q in [(c, f'"{c}"') for c in ("Product_Code", "Warehouse", "Product_Category", "Date", "Order_Demand")]
        + [(c, '"Date"') for c in ("Month", "Year", "Month_Year", "DOW", "The_Week")]
        + [("Cubic_Volume", "1"), ("Dest", "1")]
    ),
    "frequency_table": f"""SELECT Month_Year, count(*) AS n FROM (SELECT {_FEATURES} FROM typed WHERE "Date" IS NOT NULL) GROUP BY ALL""",
    "frequency_table_missing_by_warehouse": 'SELECT Warehouse, count(*) AS n FROM typed WHERE "Date" IS NULL GROUP BY ALL',
    "frequency_table_missing_by_category": 'SELECT Product_Category, count(*) AS n FROM typed WHERE "Date" IS NULL GROUP BY ALL',
    "missing_volume_share": f"""SELECT {_r('coalesce(sum(Order_Demand) FILTER ("Date" IS NULL), 0) / nullif(sum(Order_Demand), 0)')}
        AS missing_share FROM typed""",
    "demand_summary": f"""SELECT min(Order_Demand) AS min, {_r('quantile_cont(Order_Demand, 0.25)')} AS q1,
        {_r('quantile_cont(Order_Demand, 0.5)')} AS median, {_r('avg(Order_Demand)')} AS mean,
        {_r('quantile_cont(Order_Demand, 0.75)')} AS q3, max(Order_Demand) AS max,
        count(*) - count(Order_Demand) AS n_null FROM clipped""",
    "shape": """SELECT p::INT AS position, c AS column_name, 'string' AS type, n_rows
        FROM (SELECT count(*) AS n_rows FROM raw), (VALUES (1, 'Product_Code'), (2, 'Warehouse'), (3, 'Product_Category'),
        (4, 'Date'), (5, 'Order_Demand')) t(p, c)""",
    "preview": f"SELECT {_LINE_KEYS} FROM raw ORDER BY {_LINE_KEYS} LIMIT 6",
    "sample_rows": f"""SELECT {_LINE_KEYS} FROM raw
        ORDER BY md5(concat_ws('|', '1234', {_LINE_KEYS})), {_LINE_KEYS} LIMIT 5""",
    "warehouse_totals": """SELECT Warehouse, count(*) AS total_orders, sum(Order_Demand) AS sum_orders FROM clipped GROUP BY ALL""",
    "flag_outliers": f"SELECT {_CLEAN_COLUMNS}, {_r('u')} AS upper, {_r('l')} AS lower, take_out FROM flagged",
    "outlier_impact": f"""SELECT Warehouse, count_removed, sum_removed, {_r('avg_remove')} AS avg_remove, total_orders, sum_orders,
        {_r('count_removed / total_orders')} AS pct_count_removed, {_r('sum_removed / nullif(sum_orders, 0)')} AS pct_sum_removed
        FROM (SELECT Warehouse, count(*) AS count_removed, sum(Order_Demand) AS sum_removed, avg(Order_Demand) AS avg_remove
              FROM flagged WHERE take_out = 1 GROUP BY ALL)
        JOIN (SELECT Warehouse, count(*) AS total_orders, sum(Order_Demand) AS sum_orders FROM clipped GROUP BY ALL) USING (Warehouse)""",
    "trim_outliers": f"SELECT {_CLEAN_COLUMNS} FROM clean",
    "daily_totals": 'SELECT "Date", sum(Order_Demand) AS orders FROM clean GROUP BY ALL',
    "monthly_totals": "SELECT Month_Year, orders FROM months",
    "warehouse_monthly_totals": "SELECT Warehouse, Month_Year, orders FROM wh_months",
    "warehouse_cv": f"""SELECT Warehouse, {_r('m', 2)} AS m, {_r('s', 2)} AS s, {_r('s / nullif(m, 0)')} AS cv
        FROM (SELECT Warehouse, avg(orders) AS m, stddev_samp(orders) AS s FROM wh_months GROUP BY ALL)""",
    "monthly_dow_share": f"SELECT Month_Year, DOW, orders, {_r('pct')} AS pct FROM dow_share",
    "monthly_dow_share_weekdays": f"SELECT Month_Year, DOW, orders, {_r('pct')} AS pct FROM dow_share WHERE DOW NOT IN (1, 7)",
    "dow_box_stats": f"""SELECT DOW, {_r('min(pct) FILTER (NOT outside)')} AS whisker_low, {_r('any_value(q1)')} AS q1,
        {_r('any_value(med)')} AS median, {_r('any_value(q3)')} AS q3, {_r('max(pct) FILTER (NOT outside)')} AS whisker_high,
        count(*) FILTER (outside) AS n_outliers
        FROM (SELECT *, pct < q1 - 1.5 * (q3 - q1) OR pct > q3 + 1.5 * (q3 - q1) AS outside FROM dow_share JOIN boxes USING (DOW))
        GROUP BY DOW""",
    "dow_box_outliers": f"""SELECT DOW, Month_Year, {_r('pct')} AS pct FROM dow_share JOIN boxes USING (DOW)
        WHERE pct < q1 - 1.5 * (q3 - q1) OR pct > q3 + 1.5 * (q3 - q1)""",
    "date_framework": f"""SELECT fw.*, {', '.join(f"""
        (count(DISTINCT "Date") FILTER (role = '{r}')) AS {r}_days, min("Date") FILTER (role = '{r}') AS {r}_first,
        max("Date") FILTER (role = '{r}') AS {r}_last""" for r in ('target', 'comp_target', 'pre', 'pre_prev'))}
        FROM fw LEFT JOIN role_daily USING (cycle_id) GROUP BY ALL""",
    "cycle_window_totals": "SELECT cycle_id, role, total FROM totals",
    "calibration_cycle": """SELECT cycle_id, delivery, calibration_id, n AS calibration_days, n = 70 AS calibration_complete
        FROM calibration LEFT JOIN (SELECT cycle_id AS calibration_id, count(DISTINCT "Date") AS n
              FROM fw LEFT JOIN (SELECT * FROM role_daily WHERE role = 'target') USING (cycle_id) GROUP BY ALL) USING (calibration_id)""",
    "horizon_grid": "SELECT cycle_id, Warehouse, Fcast_Date, DOW FROM grid",
    "benchmark_4wk": 'SELECT Warehouse, "Date", Total_Orders, Forecast_Orders FROM lagged',
    "benchmark_variance": f"""SELECT cycle_id, {_r('(sum(Forecast_Orders) - sum(Total_Orders)) / nullif(sum(Total_Orders), 0)')} AS variance
        FROM fw LEFT JOIN bench USING (cycle_id) GROUP BY ALL""",
    "benchmark_variance_by_wh": f"""SELECT cycle_id, Warehouse,
        {_r('(sum(Forecast_Orders) - sum(Total_Orders)) / nullif(sum(Total_Orders), 0)')} AS variance FROM bench GROUP BY ALL""",
    "benchmark_mape": f"""SELECT cycle_id, {_r('''avg(CASE WHEN Total_Orders IS NULL THEN 0.0
        WHEN Forecast_Orders = 0 AND Total_Orders = 0 THEN 0.0 WHEN Forecast_Orders = 0 THEN 1.0
        ELSE abs(Forecast_Orders - Total_Orders) / Forecast_Orders END) FILTER (Forecast_Orders IS NOT NULL)''')} AS mape
        FROM fw LEFT JOIN bench USING (cycle_id) GROUP BY ALL""",
    "yoy_growth": f"SELECT cycle_id, pre, pre_prev, {_r('(pre - pre_prev) / nullif(pre_prev, 0)')} AS growth FROM wide",
    "expected_volume": f"""SELECT cycle_id, v AS comp_volume, {_r('g')} AS growth, {_r('e', 2)} AS expected_volume,
        {_r('(e - v) / nullif(v, 0)')} AS expected_growth FROM expected""",
    "dow_curve": f"SELECT cycle_id, Warehouse, DOW, {_r('pct_orders')} AS pct_orders FROM curve",
    "warehouse_share": f"SELECT cycle_id, Warehouse, orders, {_r('pct_orders')} AS pct_orders FROM shares",
    "warehouse_dow_volume": f"SELECT cycle_id, Warehouse, DOW, {_r('Fcast_Volume', 2)} AS Fcast_Volume FROM volumes",
    "daily_forecast": f"SELECT cycle_id, Warehouse, Fcast_Date, DOW, {_r('Fcast_Volume', 2)} AS Fcast_Volume FROM point",
    "calibration_forecast": f"SELECT cycle_id, Warehouse, Fcast_Date, DOW, {_r('Fcast_Volume', 2)} AS Fcast_Volume FROM conf",
    "calibration_error": f"""SELECT cycle_id, Warehouse, "Date", Act_Orders, DOW, {_r('Fcast_Volume', 2)} AS Fcast_Volume,
        {_r('Variance', 2)} AS Variance FROM errors""",
    "error_sd": f"SELECT cycle_id, Warehouse, DOW, {_r('vsd', 2)} AS vsd FROM sds",
    "forecast_with_interval": f"SELECT {_F_COLUMNS} FROM f",
    "actual_vs_forecast": f"""SELECT cycle_id, Warehouse, "Date", act AS Act_Orders, DOW, {_r('Fcast_Volume', 2)} AS Fcast_Volume,
        {_r('lo', 2)} AS "Lower", {_r('up', 2)} AS "Upper", {_r('Fcast_Volume - act', 2)} AS Variance,
        {_r('(Fcast_Volume - act) / nullif(act, 0)')} AS Var_Pct, {_r(_ape('Fcast_Volume', 'act'))} AS Abs_Var_Pct FROM cmp""",
    "measures_long": f'SELECT cycle_id, Warehouse, "Date", variable, {_r("value", 2)} AS value FROM long',
    "delivery_day_total": f"SELECT cycle_id, {_r('total', 2)} AS total FROM k3",
    "delivery_day_total_by_wh": f"SELECT cycle_id, Warehouse, {_r('total', 2)} AS total FROM k3_wh",
    "stakeholder_series": f"SELECT {_SERIES} FROM k4",
    "stakeholder_series_by_wh": f"SELECT Warehouse, {_SERIES} FROM k5",
    "stakeholder_series_asof": f"SELECT {_SERIES} FROM k6",
    "weekdays_only": f"SELECT {_SERIES} FROM k4 WHERE NOT {_WEEKEND}",
    "weekdays_only_by_wh": f"SELECT Warehouse, {_SERIES} FROM k5 WHERE NOT {_WEEKEND}",
    "weekdays_only_asof": f"SELECT {_SERIES} FROM k6 WHERE NOT {_WEEKEND}",
    "accuracy_base": f"""SELECT cycle_id, Warehouse, "Date", act AS act_orders, DOW, {_r('Fcast_Volume', 2)} AS Fcast_Volume,
        {_r('lo', 2)} AS "Lower", {_r('up', 2)} AS "Upper", {_r('Fcast_Volume - act', 2)} AS variance,
        {_r('(Fcast_Volume - act) / nullif(act, 0)')} AS var_pct, {_r('ape')} AS abs_var_pct, The_Week FROM base""",
    "accuracy_measures_long": f"""SELECT cycle_id, Warehouse, "Date", variable, {_r('value', 2)} AS value FROM (
        SELECT cycle_id, Warehouse, "Date", 'act_orders' AS variable, act AS value FROM base
        UNION ALL SELECT cycle_id, Warehouse, "Date", 'Fcast_Volume', Fcast_Volume FROM base
        UNION ALL SELECT cycle_id, Warehouse, "Date", 'Lower', lo FROM base
        UNION ALL SELECT cycle_id, Warehouse, "Date", 'Upper', up FROM base)""",
    "actual_yoy": f"SELECT cycle_id, target, comp_target, {_r('(target - comp_target) / nullif(comp_target, 0)')} AS actual_chg FROM wide",
    "forecast_error": _error(""),
    "error_by_wh": _error("Warehouse"),
    "error_by_week": _error("The_Week"),
    "error_levels": f"{_level('total')} UNION ALL {_level('Warehouse', 'Warehouse')} UNION ALL {_level('The_Week', 'The_Week')}",
    "mape": f"SELECT cycle_id, {_MAPE} FROM base GROUP BY ALL",
    "mape_by_wh": f"SELECT cycle_id, Warehouse, {_MAPE} FROM base GROUP BY ALL",
    "mape_by_week": f"SELECT cycle_id, The_Week, {_MAPE} FROM base GROUP BY ALL",
    "weekly_grain": f"""SELECT cycle_id, The_Week, act AS act_orders, {_r('Fcast_Volume', 2)} AS Fcast_Volume,
        {_r('Fcast_Volume - act', 2)} AS variance, {_r('(Fcast_Volume - act) / nullif(act, 0)')} AS var_pct,
        {_r('ape')} AS abs_var_pct FROM weeks""",
    "weekly_grain_mape": f"SELECT cycle_id, {_r('avg(ape)')} AS weekly_mape FROM weeks GROUP BY ALL",
    "warehouse_share_drift": f"""SELECT a.cycle_id, a.Warehouse, {_r('pct')} AS Actual, {_r('pct_orders')} AS Expected,
        {_r('pct - pct_orders')} AS Actual_Less_Expected
        FROM (SELECT cycle_id, Warehouse, v / nullif(sum(v) OVER (PARTITION BY cycle_id), 0) AS pct
              FROM (SELECT cycle_id, Warehouse, sum(act) AS v FROM base GROUP BY ALL)) a
        LEFT JOIN shares s ON a.cycle_id = s.cycle_id AND a.Warehouse = s.Warehouse""",
    "dow_share_drift": f"""SELECT c.cycle_id, c.Warehouse, c.DOW, {_r('pct_orders')} AS expected_pct, {_r('pct')} AS actual_pct,
        {_r('pct - pct_orders')} AS dow_variance
        FROM curve c LEFT JOIN (SELECT cycle_id, Warehouse, D, v / nullif(sum(v) OVER (PARTITION BY cycle_id, Warehouse), 0) AS pct
              FROM (SELECT cycle_id, Warehouse, (dayofweek("Date") + 1)::INT AS D, sum(act) AS v FROM base GROUP BY ALL)) a
        ON c.cycle_id = a.cycle_id AND c.Warehouse = a.Warehouse AND c.DOW = a.D""",
    "product_mix_drift": f"SELECT cycle_id, Product_Category, {_r('actual_pct')} AS actual_pct, {_r('expected_pct')} AS expected_pct FROM mix",
    "mix_band": f"""SELECT cycle_id, Product_Category, {_r('actual_pct')} AS actual_pct, {_r('expected_pct')} AS expected_pct,
        CASE WHEN expected_pct - actual_pct > 0.02 THEN 'above' WHEN expected_pct - actual_pct < -0.02 THEN 'below'
        WHEN expected_pct - actual_pct IS NOT NULL THEN 'inside' END AS band FROM mix""",
}


def build() -> dict[str, str]:
    """Query name -> SQL."""
    sql = {name: _with(body) for name, body in _QUERIES.items()}
    sql["monthly_trend"] = _trend_sql("months")
    sql["monthly_trend_by_wh"] = _trend_sql("wh_months", "Warehouse")
    return sql

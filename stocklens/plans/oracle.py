"""DuckDB SQL twins of the registered queries (the correctness gate).

Every statement runs on the driver's tables registered as views and starts from
the same mapping as ``sources.tables.tpch_retail_tables`` (FIXTURES F3).
Doubles are summed exactly, as whole multiples of 2^-70 in HUGEINT, and the total is read back
as text, which rounds once.
"""

AS_OF = "DATE '2001-12-31'"

BASE = r"""
WITH inv AS (
  SELECT CAST(n.n_regionkey AS BIGINT) AS client_id, o.o_orderkey AS invoice_id,
         CAST(o.o_orderdate AS TIMESTAMP) AS created_at, o.o_totalprice AS total_price,
         strftime(o.o_orderdate, '%Y-%m') AS year_month, CAST(o.o_orderdate AS DATE) AS day,
         o.o_orderstatus AS order_status
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
),
det AS (
  SELECT i.client_id, l.l_orderkey * 100 + l.l_linenumber AS detail_id,
         CAST(l.l_partkey AS VARCHAR) AS product_id, l.l_orderkey AS invoice_id,
         l.l_quantity AS quantity, l.l_extendedprice AS total_price,
         p.p_retailprice * 0.6 AS buy_price,
         l.l_extendedprice - (p.p_retailprice * 0.6) * l.l_quantity AS net_profit,
         CAST(l.l_shipdate AS TIMESTAMP) AS created_at, CAST(l.l_shipdate AS DATE) AS day
  FROM lineitem l JOIN inv i ON l.l_orderkey = i.invoice_id
  JOIN part p ON l.l_partkey = p.p_partkey
),
prod AS (
  SELECT CAST(r.r_regionkey AS BIGINT) AS client_id, CAST(p.p_partkey AS VARCHAR) AS product_id,
         p.p_name AS name, p.p_retailprice * 0.6 AS buy_price, p.p_retailprice AS sale_price,
         CAST((p.p_partkey * 37 + r.r_regionkey * 101) % 400 AS DOUBLE) AS current_stock
  FROM part p CROSS JOIN region r
),
dfr AS (
  SELECT i.client_id,
         CASE WHEN l.l_returnflag = 'R' THEN 'Stocks\Models\BuyInvoice' ELSE 'Stocks\Models\SaleInvoice' END AS invoice_type,
         CAST(CASE i.order_status WHEN 'O' THEN 0.0 WHEN 'P' THEN 2.0 ELSE 1.0 END AS DOUBLE) AS status,
         l.l_extendedprice AS amount, l.l_extendedprice * (1 - l.l_discount) AS paid_amount,
         CAST(l.l_suppkey AS VARCHAR) AS user_id
  FROM lineitem l JOIN inv i ON l.l_orderkey = i.invoice_id
),
sales AS (
  SELECT client_id, product_id,
         CAST(CAST(SUM(CAST(quantity * pow(2, 70) AS HUGEINT)) AS VARCHAR) AS DOUBLE) / pow(2, 70) AS sales_quantity,
         CAST(CAST(SUM(CAST(total_price * pow(2, 70) AS HUGEINT)) AS VARCHAR) AS DOUBLE) / pow(2, 70) AS sales_amount,
         CAST(CAST(SUM(CAST(net_profit * pow(2, 70) AS HUGEINT)) AS VARCHAR) AS DOUBLE) / pow(2, 70) AS net_profit,
         MAX(created_at) AS last_sale_date
  FROM det GROUP BY client_id, product_id
),
pf0 AS (
  SELECT s.client_id, s.product_id, s.sales_quantity, s.sales_amount, s.net_profit,
         COALESCE(p.name, 'Unknown Product') AS name, COALESCE(p.buy_price, 0.0) AS buy_price,
         COALESCE(p.sale_price, 0.0) AS sale_price, COALESCE(p.current_stock, 0.0) AS current_stock,
         s.last_sale_date,
         CASE WHEN s.sales_quantity > 1e-6 THEN COALESCE(p.current_stock, 0.0) / s.sales_quantity END AS efficiency_ratio
  FROM sales s LEFT JOIN prod p ON s.client_id = p.client_id AND s.product_id = p.product_id
),
pf AS (
  SELECT *,
         CASE WHEN efficiency_ratio IS NULL OR efficiency_ratio < 0 THEN 'N/A'
              WHEN efficiency_ratio < 0.8 THEN 'Undersupplied'
              WHEN efficiency_ratio < 1.2 THEN 'Balanced'
              ELSE 'Oversupplied' END AS efficiency,
         COALESCE(CAST(FLOOR((epoch_us(CAST(DATE '2001-12-31' AS TIMESTAMP)) - epoch_us(last_sale_date)) / 86400000000.0) AS INTEGER), 99999) AS days_since_last_sale
  FROM pf0
),
labels AS (
  SELECT * FROM (VALUES (0, 'Undersupplied'), (1, 'Balanced'), (2, 'Oversupplied'), (3, 'N/A')) t(label_order, efficiency)
),
sold AS (
  SELECT client_id, product_id, name, sales_quantity, current_stock FROM pf WHERE sales_quantity > 0
),
par AS (
  SELECT s.client_id, s.product_id, s.name, s.sales_quantity, s.current_stock,
         CAST(ROW_NUMBER() OVER w AS INTEGER) AS rank,
         CAST(CAST(SUM(CAST(s.sales_quantity * pow(2, 70) AS HUGEINT)) OVER w AS VARCHAR) AS DOUBLE) / pow(2, 70) / t.total * 100.0 AS cumulative_percentage
  FROM sold s JOIN (SELECT client_id, CAST(CAST(SUM(CAST(sales_quantity * pow(2, 70) AS HUGEINT)) AS VARCHAR) AS DOUBLE) / pow(2, 70) AS total
                    FROM sold GROUP BY client_id) t ON s.client_id = t.client_id
  WINDOW w AS (PARTITION BY s.client_id ORDER BY s.sales_quantity DESC, s.product_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
pareto AS (SELECT * FROM par WHERE cumulative_percentage <= 80),
stag AS (
  SELECT client_id, product_id, name, current_stock, days_since_last_sale,
         CASE WHEN days_since_last_sale < 180 THEN '3-6 months'
              WHEN days_since_last_sale < 365 THEN '6-12 months' ELSE '>1 year' END AS days_category,
         COALESCE(strftime(last_sale_date, '%Y-%m-%d'), 'N/A') AS last_sale_date_str
  FROM pf WHERE days_since_last_sale >= 90 AND days_since_last_sale < 99999
),
owed AS (
  SELECT client_id, user_id,
         CAST(CAST(SUM(CAST((amount - paid_amount) * pow(2, 70) AS HUGEINT)) AS VARCHAR) AS DOUBLE) / pow(2, 70) AS outstanding_amount
  FROM dfr WHERE invoice_type = 'Stocks\Models\BuyInvoice' AND status IN (0.0, 2.0)
  GROUP BY client_id, user_id
  HAVING CAST(CAST(SUM(CAST((amount - paid_amount) * pow(2, 70) AS HUGEINT)) AS VARCHAR) AS DOUBLE) / pow(2, 70) > 1e-6
),
top_owed AS (
  SELECT client_id, CAST(ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY outstanding_amount DESC, user_id) AS INTEGER) AS rank,
         user_id, outstanding_amount
  FROM owed QUALIFY rank <= 20
),
mavg AS (
  SELECT client_id, CAST(year_month || '-01' AS DATE) AS month_start,
         CAST(CAST(SUM(CAST(total_price * pow(2, 70) AS HUGEINT)) AS VARCHAR) AS DOUBLE) / pow(2, 70) / COUNT(*) AS avg_invoice_value
  FROM inv GROUP BY client_id, year_month
),
mgrid AS (
  SELECT client_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month_start
  FROM (SELECT client_id, MIN(month_start) AS lo, MAX(month_start) AS hi FROM mavg GROUP BY client_id)
),
monthly AS (
  SELECT g.client_id, g.month_start, COALESCE(m.avg_invoice_value, 0.0) AS avg_invoice_value
  FROM mgrid g LEFT JOIN mavg m ON g.client_id = m.client_id AND g.month_start = m.month_start
),
dgrid AS (
  SELECT client_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT client_id, MIN(day) AS lo, MAX(day) AS hi FROM det GROUP BY client_id)
),
dsales AS (
  SELECT g.client_id, g.date, COALESCE(s.value, 0.0) AS value
  FROM dgrid g LEFT JOIN (SELECT client_id, day, CAST((round_even(CAST(CAST(SUM(CAST(total_price * pow(2, 70) AS HUGEINT)) AS VARCHAR) AS DOUBLE) / pow(2, 70) * 100, 0) / 100) AS DOUBLE) AS value
                          FROM det GROUP BY client_id, day) s ON g.client_id = s.client_id AND g.date = s.day
),
dprofit AS (
  SELECT g.client_id, g.date, COALESCE(s.value, 0.0) AS value
  FROM dgrid g LEFT JOIN (SELECT client_id, day, CAST((round_even(CAST(CAST(SUM(CAST(net_profit * pow(2, 70) AS HUGEINT)) AS VARCHAR) AS DOUBLE) / pow(2, 70) * 100, 0) / 100) AS DOUBLE) AS value
                          FROM det GROUP BY client_id, day) s ON g.client_id = s.client_id AND g.date = s.day
)
"""


def q(body: str) -> str:
    return BASE + body



CAL_COLS = """CAST(isodow(d) - 1 AS INTEGER) AS day_of_week,
         CAST(isodow(d) IN (5, 6) AS INTEGER) AS is_weekend,
         CAST(month(d) AS INTEGER) AS month, CAST(quarter(d) AS INTEGER) AS quarter,
         CAST(day(d) AS INTEGER) AS day_of_month, CAST(weekofyear(d) AS INTEGER) AS week_of_year,
         0 AS is_holiday,
         CAST(day(d) = 1 AS INTEGER) AS is_month_start, CAST(last_day(d) = d AS INTEGER) AS is_month_end,
         CAST(dayofyear(d) AS INTEGER) AS day_of_year, CAST(year(d) AS INTEGER) AS year"""


def cal(date_col: str) -> str:
    return CAL_COLS.replace("(d)", f"({date_col})").replace("= d ", f"= {date_col} ")


# Islamic months by adding up year and month lengths from the epoch (leap years listed by their
# place in the cycle of 30), and the holidays of 1998 to 2003 as dates.
HOLIDAYS = """
, hyears AS (
  SELECT y, DATE '0622-07-19' + CAST(COALESCE(SUM(354 + CAST(list_contains([2, 5, 7, 10, 13, 16, 18, 21, 24, 26, 29], y % 30) AS INTEGER))
         OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start
  FROM range(1, 1500) g(y)
),
hmonths AS (
  SELECT y, m, start + CAST(COALESCE(list_sum([30, 29, 30, 29, 30, 29, 30, 29, 30, 29, 30][1:m - 1]), 0) AS INTEGER) AS start
  FROM hyears, range(1, 13) g(m)
),
hdates AS (
  SELECT start + CAST(k AS INTEGER) AS date, 'Eid al-Fitr' AS name FROM hmonths, range(0, 4) g(k) WHERE m = 10 AND year(start + CAST(k AS INTEGER)) BETWEEN 1998 AND 2003
  UNION ALL SELECT start + 8, 'Arafat Day' FROM hmonths WHERE m = 12 AND year(start + 8) BETWEEN 1998 AND 2003
  UNION ALL SELECT start + CAST(k AS INTEGER), 'Eid al-Adha' FROM hmonths, range(9, 12) g(k) WHERE m = 12 AND year(start + CAST(k AS INTEGER)) BETWEEN 1998 AND 2003
  UNION ALL SELECT make_date(y, 9, 23), 'National Day' FROM range(1998, 2004) g(y)
)
"""

FEATURES = f"""
, dfe AS (
  SELECT i.client_id, i.day AS sale_date,
         CAST(CAST(SUM(CAST(d.total_price * pow(2, 70) AS HUGEINT)) AS VARCHAR) AS DOUBLE) / pow(2, 70) AS daily_sales,
         COUNT(DISTINCT d.invoice_id) AS transaction_count,
         CAST(CAST(SUM(CAST(d.quantity * pow(2, 70) AS HUGEINT)) AS VARCHAR) AS DOUBLE) / pow(2, 70) AS total_items
  FROM det d JOIN inv i ON d.invoice_id = i.invoice_id GROUP BY i.client_id, i.day
),
dfgrid AS (
  SELECT client_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS sale_date
  FROM (SELECT client_id, MIN(sale_date) AS lo, MAX(sale_date) AS hi FROM dfe GROUP BY client_id)
),
dff AS (
  SELECT g.client_id, g.sale_date, CAST(COALESCE(e.daily_sales, 0.0) AS FLOAT) AS daily_sales,
         CAST(COALESCE(e.transaction_count, 0) AS INTEGER) AS transaction_count,
         CAST(COALESCE(e.total_items, 0.0) AS FLOAT) AS total_items
  FROM dfgrid g LEFT JOIN dfe e ON g.client_id = e.client_id AND g.sale_date = e.sale_date
),
feat AS (
  SELECT client_id, sale_date, daily_sales, transaction_count, total_items,
         {cal("sale_date")},
         CAST(LAG(daily_sales, 1) OVER w AS FLOAT) AS sales_lag_1,
         CAST(LAG(daily_sales, 2) OVER w AS FLOAT) AS sales_lag_2,
         CAST(LAG(daily_sales, 3) OVER w AS FLOAT) AS sales_lag_3,
         CAST(LAG(daily_sales, 7) OVER w AS FLOAT) AS sales_lag_7,
         CAST(LAG(daily_sales, 14) OVER w AS FLOAT) AS sales_lag_14,
         CAST(LAG(daily_sales, 21) OVER w AS FLOAT) AS sales_lag_21,
         CAST(LAG(daily_sales, 28) OVER w AS FLOAT) AS sales_lag_28,
         CAST(LAG(daily_sales, 30) OVER w AS FLOAT) AS sales_lag_30,
         CAST(LAG(daily_sales, 60) OVER w AS FLOAT) AS sales_lag_60,
         CAST(LAG(daily_sales, 90) OVER w AS FLOAT) AS sales_lag_90
  FROM dff WINDOW w AS (PARTITION BY client_id ORDER BY sale_date)
),
mfe AS (
  SELECT client_id, month_start, CAST(avg_invoice_value AS FLOAT) AS avg_invoice_value FROM monthly
),
mfeat0 AS (
  SELECT client_id, month_start, avg_invoice_value,
         CAST(month(month_start) AS INTEGER) AS month, CAST(quarter(month_start) AS INTEGER) AS quarter,
         CAST(year(month_start) AS INTEGER) AS year,
         LAG(avg_invoice_value, 1) OVER w AS avg_invoice_lag_1,
         LAG(avg_invoice_value, 2) OVER w AS avg_invoice_lag_2,
         LAG(avg_invoice_value, 3) OVER w AS avg_invoice_lag_3,
         LAG(avg_invoice_value, 4) OVER w AS avg_invoice_lag_4,
         LAG(avg_invoice_value, 5) OVER w AS avg_invoice_lag_5,
         LAG(avg_invoice_value, 6) OVER w AS avg_invoice_lag_6,
         LAG(avg_invoice_value, 7) OVER w AS avg_invoice_lag_7,
         LAG(avg_invoice_value, 8) OVER w AS avg_invoice_lag_8,
         LAG(avg_invoice_value, 9) OVER w AS avg_invoice_lag_9,
         LAG(avg_invoice_value, 10) OVER w AS avg_invoice_lag_10,
         LAG(avg_invoice_value, 11) OVER w AS avg_invoice_lag_11,
         LAG(avg_invoice_value, 12) OVER w AS avg_invoice_lag_12
  FROM mfe WINDOW w AS (PARTITION BY client_id ORDER BY month_start)
),
mfeat AS (SELECT * FROM mfeat0 WHERE avg_invoice_lag_12 IS NOT NULL)
"""


def share_ctes(measure: str, tag: str) -> str:
    """ANL-09/10 twin as CTEs ``{tag}_shares``: top 10 + Other (slices <= 1e-6 kept here)."""
    return f"""
, {tag}_top AS (
  SELECT client_id, CAST(ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY {measure} DESC, product_id) AS INTEGER) AS rank,
         product_id, name, {measure} AS value
  FROM pf QUALIFY rank <= 10
),
{tag}_oth AS (
  SELECT a.client_id, 11 AS rank, CAST(NULL AS VARCHAR) AS product_id, 'Other' AS name,
         GREATEST(0.0, CAST(CAST(a.s - t.s AS VARCHAR) AS DOUBLE) / pow(2, 70)) AS value
  FROM (SELECT client_id, SUM(CAST({measure} * pow(2, 70) AS HUGEINT)) AS s FROM pf GROUP BY client_id) a
  JOIN (SELECT client_id, SUM(CAST(value * pow(2, 70) AS HUGEINT)) AS s FROM {tag}_top GROUP BY client_id) t
    ON a.client_id = t.client_id
),
{tag}_shares AS (SELECT * FROM {tag}_top UNION ALL SELECT * FROM {tag}_oth)
"""


def top_share(measure: str) -> str:
    return q(share_ctes(measure, "s") + "SELECT client_id, rank, product_id, name, value FROM s_shares WHERE value > 1e-6")


SHARE_TABLE = q(share_ctes("sales_amount", "r") + share_ctes("net_profit", "p") + """
SELECT client_id, rank, product_id, name, value, 'revenue' AS measure FROM r_shares WHERE value > 1e-6
UNION ALL
SELECT client_id, rank, product_id, name, value, 'profit' AS measure FROM p_shares WHERE value > 1e-6""")


def seasonal_naive_ctes(tag: str, src: str, date_col: str, value_col: str, m: int, horizon: int,
                        monthly: bool) -> str:
    """FCS-07 twin as CTE ``{tag}``: client_id, date, horizon, forecast, lower_ci, upper_ci."""
    step = (f"CAST(last_d + to_months(CAST(h AS INTEGER)) AS DATE)" if monthly
            else "last_d + CAST(h AS INTEGER)")
    return f"""
, {tag}_s AS (
  SELECT client_id, {date_col} AS d, CAST({value_col} AS DOUBLE) AS y FROM {src}
  WHERE client_id IN (SELECT client_id FROM {src} GROUP BY client_id HAVING COUNT(*) >= {max(2 * m, 10)})
),
{tag}_sig AS (
  SELECT client_id, SQRT(CAST(CAST(SUM(CAST(dd * dd * pow(2, 45) AS HUGEINT)) AS VARCHAR) AS DOUBLE) / pow(2, 45) / COUNT(*)) AS sigma
  FROM (SELECT client_id, y - LAG(y, {m}) OVER (PARTITION BY client_id ORDER BY d) AS dd FROM {tag}_s)
  WHERE dd IS NOT NULL GROUP BY client_id
),
{tag}_tail AS (
  SELECT client_id, d, y, ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY d DESC) AS rn
  FROM {tag}_s QUALIFY rn <= {m}
),
{tag}_hs AS (
  SELECT client_id, last_d, h, {m} - (h - 1) % {m} AS rn, CAST(CEIL(h / {m}.0) AS DOUBLE) AS k
  FROM (SELECT client_id, MAX(d) AS last_d, unnest(generate_series(1, {horizon})) AS h FROM {tag}_tail GROUP BY client_id)
),
{tag}_raw AS (
  SELECT hs.client_id, {step} AS date, CAST(hs.h AS INTEGER) AS horizon, t.y AS forecast,
         t.y - {Z95} * g.sigma * SQRT(hs.k) AS lower_ci, t.y + {Z95} * g.sigma * SQRT(hs.k) AS upper_ci
  FROM {tag}_hs hs JOIN {tag}_tail t ON hs.client_id = t.client_id AND hs.rn = t.rn
  JOIN {tag}_sig g ON hs.client_id = g.client_id
),
{tag} AS (
  SELECT client_id, date, horizon, GREATEST(forecast, 0.0) AS forecast,
         GREATEST(lower_ci, 0.0) AS lower_ci,
         CASE WHEN lower_ci < 0 THEN GREATEST(0.0, upper_ci) ELSE upper_ci END AS upper_ci
  FROM {tag}_raw
)
"""


Z95 = "1.959963984540054"

SN_DAILY = seasonal_naive_ctes("snd", "feat", "sale_date", "daily_sales", 7, 14, False)
SN_MONTHLY = seasonal_naive_ctes("snm", "mfeat", "month_start", "avg_invoice_value", 12, 6, True)



def trend_seasonal_ctes(name: str, src: str, date: str, value: str, m: int, horizon: int, min_obs: int, monthly: bool) -> str:
    """Trend line by regr_slope/regr_intercept plus mean residuals per season."""
    step = "CAST(last + to_months(CAST(h AS INTEGER)) AS DATE)" if monthly else "last + CAST(h AS INTEGER)"
    return f"""
, {name}_s AS (
  SELECT client_id, {date} AS d, CAST({value} AS DOUBLE) AS y,
         ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY {date}) - 1 AS t, COUNT(*) OVER (PARTITION BY client_id) AS n FROM {src}),
{name}_l AS (
  SELECT client_id, MAX(n) AS n, MAX(d) AS last, regr_slope(CAST(y AS DOUBLE), CAST(t AS DOUBLE)) AS b,
         regr_intercept(CAST(y AS DOUBLE), CAST(t AS DOUBLE)) AS a
  FROM {name}_s WHERE n >= {max(min_obs, 2 * m, 10)} GROUP BY client_id),
{name}_r AS (
  SELECT client_id, t % {m} AS k, CAST(y AS DOUBLE) - (a + b * t) AS r, l.n FROM {name}_s s JOIN {name}_l l USING (client_id)),
{name}_k AS (SELECT client_id, k, AVG(r) AS s FROM {name}_r GROUP BY client_id, k),
{name}_v AS (
  SELECT client_id, SUM((r - s) * (r - s)) / (MAX(n) - {m} - 1) AS var FROM {name}_r JOIN {name}_k USING (client_id, k) GROUP BY client_id),
{name}_f AS (
  SELECT l.client_id, {step} AS date, a + b * (l.n - 1 + h) + s AS f, {Z95} * sqrt(var) * sqrt(1.0 + 1.0 / l.n) AS half
  FROM {name}_l l, range(1, {horizon + 1}) g(h), {name}_k k, {name}_v v
  WHERE k.client_id = l.client_id AND v.client_id = l.client_id AND k.k = (l.n - 1 + h) % {m}),
{name} AS (
  SELECT client_id, date, GREATEST(f, 0.0) AS forecast, GREATEST(f - half, 0.0) AS lower_ci,
         CASE WHEN f - half < 0 THEN GREATEST(0.0, f + half) ELSE f + half END AS upper_ci FROM {name}_f)
"""


FC_DAILY = trend_seasonal_ctes("fcd", "feat", "sale_date", "daily_sales", 7, 14, 360, False)
FC_MONTHLY = trend_seasonal_ctes("fcm", "mfeat", "month_start", "avg_invoice_value", 12, 6, 24, True)

FUTURE_DAILY = """
, ftail AS (
  SELECT client_id, sale_date, daily_sales,
         ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY sale_date DESC) AS rn FROM feat
),
flast AS (
  SELECT client_id, MAX(sale_date) AS last_day,
       CAST(COALESCE(MAX(CASE WHEN rn = 1 THEN daily_sales END), 0.0) AS FLOAT) AS sales_lag_1,
       CAST(COALESCE(MAX(CASE WHEN rn = 2 THEN daily_sales END), 0.0) AS FLOAT) AS sales_lag_2,
       CAST(COALESCE(MAX(CASE WHEN rn = 3 THEN daily_sales END), 0.0) AS FLOAT) AS sales_lag_3,
       CAST(COALESCE(MAX(CASE WHEN rn = 7 THEN daily_sales END), 0.0) AS FLOAT) AS sales_lag_7,
       CAST(COALESCE(MAX(CASE WHEN rn = 14 THEN daily_sales END), 0.0) AS FLOAT) AS sales_lag_14,
       CAST(COALESCE(MAX(CASE WHEN rn = 21 THEN daily_sales END), 0.0) AS FLOAT) AS sales_lag_21,
       CAST(COALESCE(MAX(CASE WHEN rn = 28 THEN daily_sales END), 0.0) AS FLOAT) AS sales_lag_28,
       CAST(COALESCE(MAX(CASE WHEN rn = 30 THEN daily_sales END), 0.0) AS FLOAT) AS sales_lag_30,
       CAST(COALESCE(MAX(CASE WHEN rn = 60 THEN daily_sales END), 0.0) AS FLOAT) AS sales_lag_60,
       CAST(COALESCE(MAX(CASE WHEN rn = 90 THEN daily_sales END), 0.0) AS FLOAT) AS sales_lag_90
  FROM ftail GROUP BY client_id
),
fdays AS (
  SELECT *, CAST(unnest(generate_series(last_day + 1, last_day + 14, INTERVAL 1 DAY)) AS DATE) AS sale_date
  FROM flast
)
"""

FUTURE_MONTHLY = """
, mtail AS (
  SELECT client_id, month_start, avg_invoice_value,
         ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY month_start DESC) AS rn FROM mfeat
),
mlast AS (
  SELECT client_id, MAX(month_start) AS last_month,
       CAST(COALESCE(MAX(CASE WHEN rn = 1 THEN avg_invoice_value END), 0.0) AS FLOAT) AS avg_invoice_lag_1,
       CAST(COALESCE(MAX(CASE WHEN rn = 2 THEN avg_invoice_value END), 0.0) AS FLOAT) AS avg_invoice_lag_2,
       CAST(COALESCE(MAX(CASE WHEN rn = 3 THEN avg_invoice_value END), 0.0) AS FLOAT) AS avg_invoice_lag_3,
       CAST(COALESCE(MAX(CASE WHEN rn = 4 THEN avg_invoice_value END), 0.0) AS FLOAT) AS avg_invoice_lag_4,
       CAST(COALESCE(MAX(CASE WHEN rn = 5 THEN avg_invoice_value END), 0.0) AS FLOAT) AS avg_invoice_lag_5,
       CAST(COALESCE(MAX(CASE WHEN rn = 6 THEN avg_invoice_value END), 0.0) AS FLOAT) AS avg_invoice_lag_6,
       CAST(COALESCE(MAX(CASE WHEN rn = 7 THEN avg_invoice_value END), 0.0) AS FLOAT) AS avg_invoice_lag_7,
       CAST(COALESCE(MAX(CASE WHEN rn = 8 THEN avg_invoice_value END), 0.0) AS FLOAT) AS avg_invoice_lag_8,
       CAST(COALESCE(MAX(CASE WHEN rn = 9 THEN avg_invoice_value END), 0.0) AS FLOAT) AS avg_invoice_lag_9,
       CAST(COALESCE(MAX(CASE WHEN rn = 10 THEN avg_invoice_value END), 0.0) AS FLOAT) AS avg_invoice_lag_10,
       CAST(COALESCE(MAX(CASE WHEN rn = 11 THEN avg_invoice_value END), 0.0) AS FLOAT) AS avg_invoice_lag_11,
       CAST(COALESCE(MAX(CASE WHEN rn = 12 THEN avg_invoice_value END), 0.0) AS FLOAT) AS avg_invoice_lag_12
  FROM mtail GROUP BY client_id
),
mdays AS (
  SELECT *, CAST(unnest(generate_series(last_month + INTERVAL 1 MONTH, last_month + INTERVAL 6 MONTH,
                                        INTERVAL 1 MONTH)) AS DATE) AS month_start
  FROM mlast
)
"""


def regression_ctes(name: str, src: str, future: str, date: str, value: str, blocks: dict[str, list[str]], m: int, min_obs: int, monthly: bool) -> str:
    """Least squares of competing sets of regressors, as relations: cross products by a self-join
    on the day, elimination by a recursion that sweeps one pivot a step (``WITH RECURSIVE``)."""
    cols = [c for b in blocks.values() for c in b]
    size = m + len(cols) + 1
    places, at = {"trend": [0], "season": list(range(1, m))}, m
    for b, cs in blocks.items():
        places[b] = list(range(at, at + len(cs)))
        at += len(cs)
    sets = ["trend", "trend+season", *(f"trend+season+{b}" for b in blocks), "trend+season+" + "+".join(blocks)]
    pivots = ", ".join(f"({c}, '{s}', {step}, {k})" for c, s in enumerate(sets)
                       for step, k in enumerate([i for b in s.split("+") for i in places[b]], 1))
    season = ", ".join(f"CAST(t % {m} = {k} AS DOUBLE)" for k in range(1, m))
    held = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0.0)" for c in cols)
    steps = f"date_diff('month', l.last, f.{date})" if monthly else f"CAST(f.{date} - l.last AS BIGINT)"
    return f"""
, {name}_s AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY {date}) - 1 AS t, COUNT(*) OVER (PARTITION BY client_id) AS n FROM {src}),
{name}_z AS (
  SELECT client_id, t, n, {date} AS d, [CAST(t AS DOUBLE), {season}, {held}, CAST({value} AS DOUBLE)] AS z FROM {name}_s WHERE n >= {max(min_obs, 2 * m, 10)}),
{name}_v AS (SELECT client_id, t, n, unnest(z) AS v, generate_subscripts(z, 1) - 1 AS i FROM {name}_z),
{name}_l AS (SELECT client_id, MAX(d) AS last, MAX(n) AS n FROM {name}_z GROUP BY client_id),
{name}_mean AS (SELECT client_id, i, AVG(v) AS mean FROM {name}_v GROUP BY client_id, i),
{name}_c AS (SELECT v.client_id, t, v.i, v - mean AS v FROM {name}_v v JOIN {name}_mean a ON v.client_id = a.client_id AND v.i = a.i),
{name}_gram AS (SELECT a.client_id, a.i, b.i AS j, SUM(a.v * b.v) AS v FROM {name}_c a JOIN {name}_c b ON a.client_id = b.client_id AND a.t = b.t GROUP BY ALL),
{name}_piv(c, model, s, k) AS (VALUES {pivots}),
{name}_sw AS (
  SELECT client_id, c, 0 AS s, i, j, v, diag FROM {name}_gram, (SELECT DISTINCT c FROM {name}_piv),
         (SELECT client_id AS dc, i AS di, v AS diag FROM {name}_gram WHERE i = j) WHERE dc = client_id AND di = i
  UNION ALL
  SELECT client_id, c, s + 1, i, j,
         CASE WHEN d > 1e-9 * dk THEN CASE WHEN i = k AND j = k THEN -1 / d WHEN i = k OR j = k THEN v / d ELSE v - vik * vkj / d END ELSE v END, diag
  FROM (SELECT w.*, p.k, MAX(CASE WHEN i = p.k AND j = p.k THEN v END) OVER (PARTITION BY client_id, w.c) AS d,
               MAX(CASE WHEN i = p.k THEN diag END) OVER (PARTITION BY client_id, w.c) AS dk,
               MAX(CASE WHEN j = p.k THEN v END) OVER (PARTITION BY client_id, w.c, i) AS vik,
               MAX(CASE WHEN i = p.k THEN v END) OVER (PARTITION BY client_id, w.c, j) AS vkj
        FROM {name}_sw w JOIN {name}_piv p ON p.c = w.c AND p.s = w.s + 1)),
{name}_m AS (SELECT w.* FROM {name}_sw w JOIN (SELECT c, MAX(s) AS s FROM {name}_piv GROUP BY c) e ON e.c = w.c AND e.s = w.s),
{name}_fit AS (
  SELECT client_id, c, COUNT(CASE WHEN i = j AND v < 0 THEN 1 END) AS p, GREATEST(MAX(CASE WHEN i = {size - 1} AND j = {size - 1} THEN v END), 0.0) AS rss
  FROM {name}_m GROUP BY client_id, c),
{name}_best AS (
  SELECT f.client_id, f.c, f.p, f.rss, l.n, l.last, n * ln(GREATEST(rss / n, 1e-9)) + 2 * (p + 2) + 2.0 * (p + 2) * (p + 3) / (n - p - 3) AS aic
  FROM {name}_fit f JOIN {name}_l l USING (client_id) WHERE n - p - 3 >= 10
  QUALIFY ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY n * ln(GREATEST(rss / n, 1e-9)) + 2 * (p + 2) + 2.0 * (p + 2) * (p + 3) / (n - p - 3), c) = 1),
{name}_fz AS (
  SELECT client_id, date, unnest(z) AS v, generate_subscripts(z, 1) - 1 AS i FROM (
    SELECT client_id, date, [CAST(t AS DOUBLE), {season}, {held}] AS z FROM (
      SELECT f.*, f.{date} AS date, l.n - 1 + {steps} AS t FROM {future} f JOIN {name}_l l USING (client_id)))),
{name}_x AS (
  SELECT z.client_id, z.date, z.i, z.v - a.mean AS x, b.c FROM {name}_fz z JOIN {name}_mean a ON a.client_id = z.client_id AND a.i = z.i
  JOIN {name}_best b ON b.client_id = z.client_id JOIN {name}_m u ON u.client_id = z.client_id AND u.c = b.c AND u.i = z.i AND u.j = z.i AND u.v < 0),
{name}_at AS (
  SELECT x.client_id, x.date, SUM(CASE WHEN q.j = {size - 1} THEN x.x * q.v END) AS slope, -COALESCE(SUM(CASE WHEN q.j < {size - 1} THEN x.x * q.v * y.x END), 0) AS quad
  FROM {name}_x x JOIN {name}_m q ON q.client_id = x.client_id AND q.c = x.c AND q.i = x.i
  LEFT JOIN {name}_x y ON y.client_id = x.client_id AND y.date = x.date AND y.i = q.j GROUP BY x.client_id, x.date),
{name}_f AS (
  SELECT b.client_id, t.date, a.mean + t.slope AS f, {Z95} * sqrt(b.rss / (b.n - b.p - 1) * GREATEST(1.0, 1.0 + 1.0 / b.n + t.quad)) AS half,
         (SELECT MAX(model) FROM {name}_piv v WHERE v.c = b.c) AS model, b.p
  FROM {name}_best b JOIN {name}_at t ON t.client_id = b.client_id JOIN {name}_mean a ON a.client_id = b.client_id AND a.i = {size - 1}),
{name} AS (
  SELECT client_id, date, GREATEST(f, 0.0) AS forecast, GREATEST(f - half, 0.0) AS lower_ci,
         CASE WHEN f - half < 0 THEN GREATEST(0.0, f + half) ELSE f + half END AS upper_ci, model, p FROM {name}_f)
"""


_CAL_NAMES = ["day_of_week", "is_weekend", "month", "quarter", "day_of_month", "week_of_year", "is_holiday", "is_month_start", "is_month_end",
              "day_of_year", "year"]
FR_DAILY = f"""
, frd_days AS (SELECT client_id, sale_date, {cal("sale_date")}, COLUMNS('sales_lag_.*') FROM fdays)
""" + regression_ctes("frd", "feat", "frd_days", "sale_date", "daily_sales",
                      {"calendar": _CAL_NAMES, "lags": [f"sales_lag_{k}" for k in (1, 2, 3, 7, 14, 21, 28, 30, 60, 90)]}, 7, 360, False)
FR_MONTHLY = """
, frm_months AS (SELECT client_id, month_start, month(month_start) AS month, quarter(month_start) AS quarter, year(month_start) AS year,
                        COLUMNS('avg_invoice_lag_.*') FROM mdays)
""" + regression_ctes("frm", "mfeat", "frm_months", "month_start", "avg_invoice_value",
                      {"calendar": ["month", "quarter", "year"], "lags": [f"avg_invoice_lag_{k}" for k in range(1, 13)]}, 12, 24, True)

FIG11 = """
, f11 AS (
  SELECT client_id, date, (round_even(CAST(value AS DOUBLE) * 100, 0) / 100) AS value, 'actual' AS type,
         CAST(NULL AS DOUBLE) AS lower_ci, CAST(NULL AS DOUBLE) AS upper_ci FROM dsales
  UNION ALL
  SELECT client_id, date, (round_even(CAST(forecast AS DOUBLE) * 100, 0) / 100), 'forecast', (round_even(CAST(lower_ci AS DOUBLE) * 100, 0) / 100), (round_even(CAST(upper_ci AS DOUBLE) * 100, 0) / 100) FROM snd
)
"""

PARETO_BANDS = """
, pb AS (
  SELECT client_id, rank, product_id, name, sales_quantity, (round_even(CAST(cumulative_percentage AS DOUBLE) * 100, 0) / 100) AS cumulative_pct,
         CASE WHEN cumulative_percentage >= 0 AND cumulative_percentage <= 80 THEN
              CAST((k - 1) * 10 AS VARCHAR) || '-' || CAST(k * 10 AS VARCHAR) || '%' ELSE 'Other' END AS percentage_category
  FROM (SELECT *, CAST(GREATEST(CEIL(cumulative_percentage / 10.0), 1) AS INTEGER) AS k FROM pareto)
)
"""


def _word(words: dict[str, str], key: str, default: str) -> str:
    return "'" + words.get(key, default).replace("'", "''") + "'"


def record_values(words: dict[str, dict[str, str]]) -> str:
    """Every value of every record of the list-shaped figures, by language and localised key:
    ``words`` are the languages' dictionaries. Written out by hand, figure by figure."""
    top = "SELECT *, ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY {} ) AS seq FROM {} QUALIFY seq <= {}"
    rounded = lambda c: f"(round_even(CAST({c} AS DOUBLE) * 100, 0) / 100)"
    series = lambda actual, fc, month: (
        f"SELECT *, ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY date, type) AS seq FROM ({actual} UNION ALL SELECT client_id, "
        + ("strftime(date, '%Y-%m')" if month else "CAST(date AS VARCHAR)")
        + f", {rounded('forecast')}, 'forecast', {rounded('lower_ci')}, {rounded('upper_ci')} FROM {fc})")
    none = "CAST(NULL AS DOUBLE) AS lower_ci, CAST(NULL AS DOUBLE) AS upper_ci"
    daily = f"SELECT client_id, CAST(date AS VARCHAR) AS date, {rounded('value')} AS value, 'actual' AS type, {none} FROM dsales"
    monthly = f"SELECT client_id, strftime(month_start, '%Y-%m') AS date, {rounded('avg_invoice_value')} AS value, 'actual' AS type, {none} FROM monthly"
    sold = "(SELECT * FROM pf WHERE sales_quantity > 0)"
    line = [("date", "date", "date"), ("value", "value", "value"), ("type", "type", "type"), ("lower_ci", "lower_ci", "lower_ci"), ("upper_ci", "upper_ci", "upper_ci")]
    stock = [("name", "x_axis.title", "Product"), ("current_stock", "series.stock", "Current Stock"), ("sales_quantity", "series.sales", "Sales")]
    figures = {
        "fig1": (top.format("sales_quantity DESC, product_id", "pf", 20), stock),
        "fig3": (top.format("sales_amount DESC, product_id", "(SELECT *, sales_quantity * buy_price AS cogs, sales_amount - sales_quantity * buy_price AS margin FROM pf)", 20),
                 [("name", "x_axis.title", "Product"), ("sales_amount", "series.revenue", "Revenue"), ("cogs", "series.cogs", "COGS"), ("margin", "series.margin", "Margin")]),
        "fig4": (top.format("sales_quantity DESC, product_id", "pf", 20), stock),
        "fig5": ("SELECT * FROM eff5", [("efficiency@efficiency_labels", "x_axis.title", "Efficiency Category"), ("total_stock", "series.stock", "Total Stock"),
                                        ("total_sales", "series.sales", "Total Sales")]),
        "fig6": ("SELECT *, rank AS seq FROM pb", [("name", "x_axis.title", "Product"), ("sales_quantity", "series.sales", "Sales Quantity"),
                                                   ("cumulative_pct", "series.cumulative", "Cumulative %"), ("percentage_category", "", "percentage_category")]),
        "fig7": (top.format("product_id", "pf WHERE sale_price > 0 AND sales_quantity > 0", 1e9),
                 [("name", "common.product_name", "Product Name"), ("sale_price", "x_axis.title", "Sale Price"), ("sales_quantity", "y_axis.title", "Quantity Sold")]),
        "fig9": (top.format("current_stock, product_id", "pf WHERE current_stock <= 10", 1e9), [("name", "x_axis.title", "Product"), ("current_stock", "y_axis.title", "Current Stock")]),
        "fig10": (top.format("days_since_last_sale DESC, product_id", "stag", 1e9),
                  [("name", "x_axis.title", "Product"), ("days_since_last_sale", "y_axis.title", "Days Since Last Sale"), ("days_category@stagnant_labels", "data_keys.category", "Stagnancy Period"),
                   ("last_sale_date_str", "common.last_sale_date", "Last Sale"), ("current_stock", "common.current_stock", "Stock"), ("product_id", "common.product_id", "ID")]),
        "fig11": (series(daily, "fcd", False), line),
        "fig12": (series(monthly, "fcm", True), line),
        "fig13": (top.format("sales_quantity, product_id", sold, 10), [("name", "y_axis.title", "Product"), ("sales_quantity", "x_axis.title", "Quantity Sold")]),
        "fig14": (top.format("sales_quantity", "(SELECT client_id, sales_quantity, COUNT(*) AS product_count FROM pf WHERE sales_quantity > 0 GROUP BY ALL)", 15),
                  [("sales_quantity", "columns.quantity", "Quantity Sold"), ("product_count", "columns.num_products", "Number of Products")]),
        "fig15": (top.format("sales_quantity DESC, product_id", sold, 10), [("name", "y_axis.title", "Product"), ("sales_quantity", "x_axis.title", "Quantity Sold")]),
        "fig17": ("SELECT *, rank AS seq FROM top_owed", [("user_id", "x_axis.title", "Supplier (ID)"), ("outstanding_amount", "y_axis.title", "Outstanding Amount")]),
    }
    parts = []
    for fig, (rows, cols) in figures.items():
        for lang, said in words.items():
            for col, key, default in cols:
                col, _, labels = col.partition("@")
                value = f"CAST({col} AS VARCHAR)"
                if labels:
                    pairs = " ".join(f"WHEN '{k.split('.', 1)[1]}' THEN {_word(said, k, k)}" for k in said if k.startswith(labels + "."))
                    value = f"CASE {col} {pairs} ELSE {col} END"
                name = _word(said, key if key.startswith("common.") else f"{fig}.{key}", default) if key and fig not in ("fig11", "fig12") else f"'{default}'"
                parts.append(f"SELECT client_id, '{fig}' AS figure, '{lang}' AS lang, CAST(seq AS BIGINT) AS seq, {name} AS key, {value} AS value FROM ({rows})")
    return q(PARETO_BANDS + FEATURES + FC_DAILY + FC_MONTHLY + """
, eff5 AS (
  SELECT c.client_id, l.efficiency, l.label_order + 1 AS seq, COALESCE(x.total_stock, 0.0) AS total_stock, COALESCE(x.total_sales, 0.0) AS total_sales
  FROM (SELECT DISTINCT client_id FROM pf) c CROSS JOIN labels l
  LEFT JOIN (SELECT client_id, efficiency, SUM(current_stock) AS total_stock, SUM(sales_quantity) AS total_sales FROM pf WHERE efficiency <> 'N/A' GROUP BY ALL) x
    ON x.client_id = c.client_id AND x.efficiency = l.efficiency),
vals AS (""" + " UNION ALL ".join(parts) + """)
SELECT client_id, figure, lang, seq, key, TRY_CAST(value AS DOUBLE) AS number, CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN value END AS text FROM vals""")

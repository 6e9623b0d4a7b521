"""The registered queries once more as DuckDB SQL, built from named common table expressions."""

from __future__ import annotations

import re

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: str, body: str) -> None:
    CTES[name] = (tuple(needs.split()), body.strip())


def query(needs: str, select: str) -> str:
    """``select`` preceded by the CTEs it needs and theirs, each once."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for dep in CTES[name][0]:
                add(dep)
            order.append(name)

    for name in needs.split():
        add(name)
    recursive = "RECURSIVE " if any(n.startswith("ets_state") for n in order) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order) + "\n" + select.strip()


def r4(expr: str, name: str | None = None) -> str:
    """Four decimals; the cut sits off exact halves so that last-bit differences cannot flip it."""
    return f"CASE WHEN abs({expr}) < 1e11 THEN floor(({expr}) * 1e4 + 0.5003) / 1e4 ELSE CAST({expr} AS DOUBLE) END AS {name or expr}"


def rr(*cols: str) -> str:
    return ", ".join(r4(c) for c in cols)


# ------------------------------------------------------------------ raw relations
cte("types", "", "SELECT p_type, dense_rank() OVER (ORDER BY p_type) AS upc FROM (SELECT DISTINCT p_type FROM part)")
cte("lines", "types", """
SELECT CAST(l.l_shipdate AS DATE) AS date, CAST(t.upc AS BIGINT) AS upc, l.l_returnflag AS cedis,
       CAST(ascii(l.l_returnflag) - 64 AS BIGINT) * 1000000000 + l.l_suppkey AS store_nbr,
       l.l_quantity, CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amount
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN types t USING (p_type)""")
cte("sell_out", "lines", """
SELECT date, sum(l_quantity) AS sell_out_pzs, upc, cedis,
       CAST(sum(amount) AS DOUBLE) / sum(l_quantity) AS final_price,
       CAST(weekofyear(date) % 8 = upc % 8 AS INTEGER) AS promo_flag
FROM lines GROUP BY date, upc, cedis""")
cte("stores", "lines", "SELECT DISTINCT store_nbr, cedis FROM lines")
cte("shelf", "lines", "SELECT DISTINCT upc, cedis, store_nbr FROM lines")
cte("inventory", "sell_out shelf", """
SELECT date, unnest(CASE WHEN upc = 1 THEN [upc * 10, upc * 10 + 1] ELSE [upc * 10] END) AS prime_item_nbr, upc, store_nbr, on_hand_qty
FROM (
  SELECT *, CASE WHEN (upc = 2 AND cedis = 'A' AND sup % 2 = 0)
                   OR (upc = 3 AND cedis = 'R' AND sup % 10 < 4 AND date >= DATE '2001-10-23')
                   OR (dip AND sup % 3 = 0) THEN 0.0::DOUBLE
                 ELSE ((sup * 31 + upc * 17 + day * 7) % 41 - 4) * k * CASE WHEN dip THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END END AS on_hand_qty
  FROM (
    SELECT s.upc, s.cedis, s.store_nbr, s.store_nbr % 1000000000 AS sup, l.k, d.date, d.day,
           s.upc % 2 = 0 AND (s.upc * 5 + ascii(s.cedis) - 64 + d.day) % 23 < 4 AS dip
    FROM shelf s
    JOIN (SELECT upc, cedis, ceil(m.mean_daily * 50 / w.n) / 100.0::DOUBLE * (1 + upc % 3) AS k
          FROM (SELECT upc, cedis, avg(sell_out_pzs) AS mean_daily FROM sell_out GROUP BY ALL) m
          JOIN (SELECT upc, cedis, count(*) AS n FROM shelf GROUP BY ALL) w USING (upc, cedis)) l USING (upc, cedis)
    CROSS JOIN (SELECT CAST(t AS DATE) AS date, CAST(date_diff('day', DATE '1970-01-01', CAST(t AS DATE)) AS BIGINT) AS day
                FROM generate_series(DATE '2001-10-15', DATE '2001-11-04', INTERVAL 1 DAY) g(t)) d
    WHERE d.date <= DATE '2001-11-01' OR s.upc <= 2))""")
cte("catalog_raw", "sell_out", """
SELECT unnest(CASE WHEN upc = 1 THEN [upc * 10, upc * 10 + 1] ELSE [upc * 10] END) AS prime_item_nbr, upc,
       avg_daily_sales, median_daily_sales, std_daily_sales, std_daily_sales / avg_daily_sales AS cv_demand, sales_share, abc_class, xyz_class,
       CAST(7 AS BIGINT) AS lead_time_days, CAST(CASE WHEN upc = 2 THEN 50 ELSE 100 END AS BIGINT) AS moq,
       CAST(CASE WHEN abc_class = 'C' THEN 14 ELSE 7 END AS BIGINT) AS safety_stock_days
FROM (
  SELECT *, CASE WHEN sales_share * np >= 1.0 THEN 'A' WHEN sales_share * np >= 0.95 THEN 'B' ELSE 'C' END AS abc_class,
         CASE upc % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE 'Z' END AS xyz_class
  FROM (
    SELECT upc, avg(sell_out_pzs) AS avg_daily_sales, median(sell_out_pzs) AS median_daily_sales, stddev_samp(sell_out_pzs) AS std_daily_sales,
           sum(sell_out_pzs) / (SELECT sum(sell_out_pzs) FROM sell_out) AS sales_share, (SELECT count(DISTINCT upc) FROM sell_out) AS np
    FROM sell_out GROUP BY upc))""")
cte("catalog", "catalog_raw", """
SELECT * EXCLUDE (rn), abc_class || '-' || xyz_class AS cluster
FROM (SELECT *, row_number() OVER (PARTITION BY upc ORDER BY prime_item_nbr) AS rn FROM catalog_raw) WHERE rn = 1""")

# ------------------------------------------------------------------ calendar
cte("easter", "", """
SELECT y, make_date(y, n // 31, n % 31 + 1) AS easter
FROM (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n
  FROM (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l
    FROM (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h
      FROM (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM (SELECT CAST(unnest(range(1990, 2011)) AS BIGINT) AS y)))))""")
cte("calendar", "sell_out easter", """
SELECT date, dow, CAST(dow >= 5 AS INTEGER) AS is_weekend, is_payday,
       CAST(max(is_payday) OVER (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS INTEGER) AS is_payday_window,
       CAST((mo = 1 AND dd = 1) OR (mo = 2 AND dd = 5) OR (mo = 3 AND dd = 21) OR (mo = 5 AND dd = 1) OR (mo = 9 AND dd = 16)
            OR (mo = 11 AND dd = 20) OR (mo = 12 AND dd = 25) OR (mo = 12 AND dd = 1 AND yy IN (1994, 2000)) AS INTEGER) AS is_holiday,
       CAST(date >= easter - 7 AND date <= easter AS INTEGER) AS is_semana_santa,
       CAST(date >= third_monday - 3 AND date <= third_monday AS INTEGER) AS is_buen_fin,
       CAST(mo = 12 AND dd >= 15 AS INTEGER) AS is_december_peak,
       CAST(date - dow AS DATE) AS week_start
FROM (
  SELECT d.date, CAST(isodow(d.date) - 1 AS INTEGER) AS dow, year(d.date) AS yy, month(d.date) AS mo, day(d.date) AS dd, e.easter,
         CAST(day(d.date) = 15 OR d.date = last_day(d.date) AS INTEGER) AS is_payday,
         make_date(year(d.date), 11, 1) + CAST((7 - (isodow(make_date(year(d.date), 11, 1)) - 1)) % 7 + 14 AS INTEGER) AS third_monday
  FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-02', (SELECT max(date) + 70 FROM sell_out)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date) d
  JOIN easter e ON e.y = year(d.date))""")
cte("weekly_cal", "calendar", """
SELECT week_start, CAST(sum(is_payday) AS BIGINT) AS payday_days, CAST(sum(is_payday_window) AS BIGINT) AS payday_window_days,
       CAST(sum(is_holiday) AS BIGINT) AS holiday_days, CAST(sum(is_semana_santa) AS BIGINT) AS semana_santa_days,
       CAST(sum(is_buen_fin) AS BIGINT) AS buen_fin_days, CAST(sum(is_december_peak) AS BIGINT) AS december_peak_days,
       CAST(weekofyear(week_start) AS INTEGER) AS week_of_year, CAST(month(week_start) AS INTEGER) AS month
FROM calendar GROUP BY week_start""")

# ------------------------------------------------------------------ daily and inventory
cte("grid", "sell_out", """
SELECT upc, cedis, CAST(unnest(generate_series(first_date, last_date, INTERVAL 1 DAY)) AS DATE) AS date
FROM (SELECT upc, cedis, min(date)::TIMESTAMP AS first_date, (SELECT max(date) FROM sell_out)::TIMESTAMP AS last_date FROM sell_out GROUP BY upc, cedis)""")
cte("daily0", "grid sell_out", """
SELECT g.upc, g.cedis, g.date, s.sell_out_pzs,
       last_value(s.final_price IGNORE NULLS) OVER (PARTITION BY g.upc, g.cedis ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS final_price,
       coalesce(s.promo_flag, 0) AS promo_flag, CAST(s.sell_out_pzs IS NULL AS INTEGER) AS is_missing
FROM grid g LEFT JOIN sell_out s ON g.upc = s.upc AND g.cedis = s.cedis AND g.date = s.date""")
cte("daily1", "daily0", """
SELECT * EXCLUDE (med, scale),
       CASE WHEN outlier_flag = 1 THEN least(sell_out_pzs, med + 5.0::DOUBLE * scale) ELSE sell_out_pzs END AS sell_out_capped
FROM (
  SELECT * EXCLUDE (dev, n_dev, mad), 1.4826::DOUBLE * mad AS scale,
         CAST(coalesce(abs((sell_out_pzs - med) / nullif(1.4826::DOUBLE * mad, 0.0)) > 5.0, false) AS INTEGER) AS outlier_flag
  FROM (
    SELECT *, CASE WHEN count(dev) OVER w >= 14 THEN median(dev) OVER w END AS mad, count(dev) OVER w AS n_dev
    FROM (
      SELECT *, abs(lag(sell_out_pzs) OVER (PARTITION BY upc, cedis ORDER BY date) - med) AS dev
      FROM (
        SELECT *, CASE WHEN count(sell_out_pzs) OVER p >= 14 THEN median(sell_out_pzs) OVER p END AS med
        FROM daily0 WINDOW p AS (PARTITION BY upc, cedis ORDER BY date ROWS BETWEEN 56 PRECEDING AND 1 PRECEDING)))
    WINDOW w AS (PARTITION BY upc, cedis ORDER BY date ROWS BETWEEN 55 PRECEDING AND CURRENT ROW)))""")
cte("daily", "daily1 calendar", """
SELECT d.*, c.is_payday, c.is_payday_window, c.is_holiday, c.is_semana_santa, c.is_buen_fin, c.is_december_peak, c.week_start
FROM daily1 d LEFT JOIN calendar c USING (date)""")
cte("stock", "inventory stores", """
SELECT date, upc, store_nbr, on_hand_qty, cedis
FROM (SELECT date, upc, store_nbr, sum(on_hand_qty) AS on_hand_qty FROM inventory GROUP BY date, upc, store_nbr) LEFT JOIN stores USING (store_nbr)""")
cte("inv", "stock", """
SELECT *, stores_at_or_below_zero / stores_reporting AS stockout_store_share
FROM (SELECT date, upc, cedis, sum(greatest(on_hand_qty, 0)) AS on_hand, sum(on_hand_qty) AS on_hand_raw, count(DISTINCT store_nbr) AS stores_reporting,
             count(*) FILTER (on_hand_qty <= 0) AS stores_at_or_below_zero, count(*) FILTER (on_hand_qty < 0) AS stores_negative
      FROM stock GROUP BY date, upc, cedis)""")

# ------------------------------------------------------------------ weekly and series
cte("week_sums", "daily", """
SELECT upc, cedis, week_start, days_observed, price_mean, promo_share, n_outliers, zero_days,
       CASE WHEN days_observed >= 5 THEN y_sum * (7.0::DOUBLE / days_observed) END AS y,
       CASE WHEN days_observed >= 5 THEN capped_sum * (7.0::DOUBLE / days_observed) END AS y_capped
FROM (SELECT upc, cedis, week_start, sum(sell_out_pzs) AS y_sum, sum(sell_out_capped) AS capped_sum, count(sell_out_pzs) AS days_observed,
             avg(final_price) FILTER (sell_out_pzs IS NOT NULL) AS price_mean, avg(promo_flag) FILTER (sell_out_pzs IS NOT NULL) AS promo_share,
             CAST(sum(outlier_flag) AS BIGINT) AS n_outliers, count(*) FILTER (sell_out_pzs = 0) AS zero_days
      FROM daily WHERE week_start BETWEEN DATE '1995-01-02' AND DATE '2001-10-29' GROUP BY upc, cedis, week_start)""")
cte("week_grid", "week_sums", """
SELECT upc, cedis, CAST(unnest(generate_series(first_week, TIMESTAMP '2001-10-29', INTERVAL 7 DAY)) AS DATE) AS week_start
FROM (SELECT upc, cedis, min(week_start)::TIMESTAMP AS first_week FROM week_sums WHERE y IS NOT NULL GROUP BY upc, cedis)""")
cte("weekly", "week_grid week_sums weekly_cal catalog", """
SELECT g.upc, g.cedis, g.week_start, coalesce(w.days_observed, 0) AS days_observed,
       last_value(w.price_mean IGNORE NULLS) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price_mean,
       coalesce(w.promo_share, 0.0::DOUBLE) AS promo_share, coalesce(w.n_outliers, 0) AS n_outliers, coalesce(w.zero_days, 0) AS zero_days,
       w.y, w.y_capped, c.* EXCLUDE (week_start), k.cluster, k.abc_class, k.xyz_class, k.lead_time_days, k.moq, k.safety_stock_days,
       CAST(row_number() OVER s - 1 AS INTEGER) AS series_age_weeks
FROM week_grid g LEFT JOIN week_sums w ON g.upc = w.upc AND g.cedis = w.cedis AND g.week_start = w.week_start
LEFT JOIN weekly_cal c ON g.week_start = c.week_start LEFT JOIN catalog k ON g.upc = k.upc
WINDOW s AS (PARTITION BY g.upc, g.cedis ORDER BY g.week_start)""")
cte("series", "daily weekly inv catalog", """
SELECT d.*, w.first_week, w.n_weeks, w.mean_weekly, w.tail8_mean, w.tail8_promo_share, w.tail4_mean, i.on_hand AS on_hand_as_of,
       k.cluster, k.abc_class, k.xyz_class, k.lead_time_days, k.moq, k.safety_stock_days,
       i.on_hand IS NOT NULL AS has_inventory, coalesce(w.n_weeks, 0) < 26 AS is_cold_start,
       coalesce(w.tail4_mean, 0) <= 0.05 * coalesce(w.mean_weekly, 0) AND coalesce(w.mean_weekly, 0) > 0 AS is_discontinued,
       coalesce(w.tail8_promo_share, 0) >= 0.4 AS is_high_promo
FROM (SELECT upc, cedis, min(date) AS first_date, max(date) AS last_date, count(*) AS n_days, avg(sell_out_pzs) AS mean_daily,
             CAST(max(date) - min(date) + 1 - count(*) AS INTEGER) AS interior_gap_days
      FROM daily WHERE sell_out_pzs IS NOT NULL GROUP BY upc, cedis) d
LEFT JOIN (SELECT upc, cedis, min(week_start) AS first_week, count(*) AS n_weeks, avg(y) AS mean_weekly,
             avg(y) FILTER (week_start > newest - 56) AS tail8_mean, avg(promo_share) FILTER (week_start > newest - 56) AS tail8_promo_share,
             avg(y) FILTER (week_start > newest - 28) AS tail4_mean
      FROM (SELECT *, max(week_start) OVER () AS newest FROM weekly WHERE y IS NOT NULL) GROUP BY upc, cedis) w USING (upc, cedis)
LEFT JOIN (SELECT upc, cedis, on_hand FROM inv WHERE date = DATE '2001-11-01') i USING (upc, cedis)
LEFT JOIN catalog k USING (upc)""")

QUERIES: dict[str, str] = {}


REGISTERED: dict[str, tuple[str, str]] = {}


def register(name: str, needs: str, select: str) -> None:
    REGISTERED[name] = (needs, select)
    QUERIES[name] = query(needs, select)

# ------------------------------------------------------------------ forecasters
H = range(1, 9)
QS = ("q05", "q10", "q50", "q90", "q95")
LV = (0.05, 0.10, 0.50, 0.90, 0.95)
NOMINAL = {"q10": 0.90 - 0.10, "q05": 0.95 - 0.05}

cte("folds", "", "SELECT CAST(i AS INTEGER) AS fold, CAST(DATE '2001-09-03' - CAST(28 * (7 - i) AS INTEGER) AS DATE) AS origin FROM range(8) r(i)")
cte("final_folds", "", "SELECT * FROM (VALUES (0, DATE '2001-10-29'), (1, DATE '2001-10-01')) v(fold, origin)")


def d(x: float) -> str:
    """A double literal: DuckDB reads plain decimals as DECIMAL."""
    return f"{x!r}::DOUBLE"


def finalized(inner: str, rest: str) -> str:
    qs = ", ".join(f"greatest({q}, 0.0::DOUBLE)" for q in QS)
    return f"SELECT {rest}, " + ", ".join(f"s[{i + 1}] AS {q}" for i, q in enumerate(QS)) + f" FROM (SELECT *, list_sort([{qs}]) AS s FROM ({inner}))"


def from_residuals() -> str:
    """Quantile columns from point, residual quantile list p and residual count n."""
    cols = [
        "point AS q50" if q == "q50" else f"CASE WHEN n >= 8 THEN point + p[{i + 1}] ELSE point * {d(1 + (lv - 0.5))} END AS {q}"
        for i, (q, lv) in enumerate(zip(QS, LV))
    ]
    return ", ".join(cols)


LEVEL_LIST = "[" + ", ".join(d(x) for x in LV) + "]"
PRED_COLS = "fold, upc, cedis, origin, h, target_week, model"

cte("resid", "weekly", "SELECT upc, cedis, week_start, y, " + ", ".join(
    f"y - avg(y) OVER (PARTITION BY upc, cedis ORDER BY week_start ROWS BETWEEN {h + 3} PRECEDING AND {h} PRECEDING) AS r{h}" for h in H) + " FROM weekly")
for suffix, folds in (("", "folds"), ("_final", "final_folds")):
    cte(f"eligible{suffix}", f"weekly {folds}", f"""
SELECT f.fold, f.origin, w.upc, w.cedis, count(w.y) AS n_weeks_at_origin
FROM weekly w JOIN {folds} f ON w.week_start <= f.origin GROUP BY ALL HAVING count(w.y) >= {26 if not suffix else 1}""")
    cte(f"ma4{suffix}", f"resid {folds}", finalized(f"""
SELECT a.fold, a.upc, a.cedis, a.origin, CAST(h AS INTEGER) AS h, CAST(a.origin + CAST(7 * h AS INTEGER) AS DATE) AS target_week, 'ma4' AS model, {from_residuals()}
FROM (SELECT f.fold, f.origin, upc, cedis, h,
             quantile_cont(CASE h {' '.join(f'WHEN {h} THEN r{h}' for h in H)} END, {LEVEL_LIST}) AS p,
             count(CASE h {' '.join(f'WHEN {h} THEN r{h}' for h in H)} END) AS n
      FROM resid JOIN {folds} f ON week_start <= f.origin CROSS JOIN (SELECT unnest(range(1, 9)) AS h) GROUP BY ALL) a
JOIN (SELECT fold, upc, cedis, coalesce(avg(y) FILTER (rk <= 4), 0.0::DOUBLE) AS point
      FROM (SELECT f.fold, upc, cedis, y, row_number() OVER (PARTITION BY f.fold, upc, cedis ORDER BY y IS NULL, week_start DESC) AS rk
            FROM resid JOIN {folds} f ON week_start <= f.origin) GROUP BY ALL) b USING (fold, upc, cedis)""", PRED_COLS))
    cte(f"snaive{suffix}", f"weekly {folds}", finalized(f"""
SELECT a.fold, a.upc, a.cedis, a.origin, CAST(h AS INTEGER) AS h, CAST(a.origin + CAST(7 * h AS INTEGER) AS DATE) AS target_week, 'seasonal_naive' AS model, {from_residuals()}
FROM (SELECT g.*, h.h, coalesce(w.y, g.last_y, 0.0::DOUBLE) AS point
      FROM (SELECT f.fold, f.origin, upc, cedis, quantile_cont(r, {LEVEL_LIST}) AS p, count(r) AS n, max_by(y, week_start) FILTER (y IS NOT NULL) AS last_y
            FROM (SELECT *, y - lag(y, 52) OVER (PARTITION BY upc, cedis ORDER BY week_start) AS r FROM weekly) JOIN {folds} f ON week_start <= f.origin GROUP BY ALL) g
      CROSS JOIN (SELECT unnest(range(1, 9)) AS h) h
      LEFT JOIN weekly w ON w.upc = g.upc AND w.cedis = g.cedis AND w.week_start = g.origin + CAST(7 * h.h - 364 AS INTEGER)) a""", PRED_COLS))

cte("pred", "ma4 snaive eligible weekly", """
SELECT p.*, w.y, w.cluster FROM (SELECT * FROM ma4 UNION ALL SELECT * FROM snaive) p
SEMI JOIN eligible e ON p.fold = e.fold AND p.upc = e.upc AND p.cedis = e.cedis
LEFT JOIN weekly w ON p.upc = w.upc AND p.cedis = w.cedis AND p.target_week = w.week_start""")

# smoothing model: the recursion walks the weeks, one row per (fold, series, grid point)
GRID = [(a, a * b, p) for a in (0.05, 0.1, 0.2, 0.4, 0.7) for b in (0.02, 0.1, 0.3) for p in (0.8, 0.9, 0.98)]
cte("interp", "weekly", """
SELECT upc, cedis, week_start, last_value(s IGNORE NULLS) OVER (PARTITION BY upc, cedis ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
       first_value(s IGNORE NULLS) OVER (PARTITION BY upc, cedis ORDER BY week_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx
FROM (SELECT *, CASE WHEN y_capped IS NOT NULL THEN {'w': week_start, 'v': y_capped} END AS s FROM weekly)""")
cte("filled", "interp folds", """
SELECT f.fold, f.origin, upc, cedis, week_start, row_number() OVER (PARTITION BY f.fold, upc, cedis ORDER BY week_start) AS t,
       coalesce(pv.v + (CASE WHEN nx.w <= f.origin THEN nx.v END - pv.v) / nullif(nx.w - pv.w, 0) * (week_start - pv.w), pv.v, CASE WHEN nx.w <= f.origin THEN nx.v END) AS yi
FROM interp JOIN folds f ON week_start <= f.origin""")
cte("ets_start", "filled", """
SELECT fold, origin, upc, cedis, list(yi ORDER BY t) AS ys, coalesce(avg(yi), 0.0::DOUBLE) AS mean, min(yi) AS lo, max(yi) AS hi, count(*) AS n FROM filled GROUP BY ALL""")
_m = lambda a, b: "(" + " + ".join(f"ys[{i}]" for i in range(a, b + 1)) + f") / {b - a + 1}.0::DOUBLE"
cte("ets_state", "ets_start", f"""
SELECT fold, upc, cedis, a, b, phi, 0 AS t, 0.0::DOUBLE AS sse, {_m(1, 10)} - 5.5::DOUBLE * (({_m(6, 10)} - {_m(1, 5)}) / 5.0::DOUBLE) AS l, ({_m(6, 10)} - {_m(1, 5)}) / 5.0::DOUBLE AS tr, ys
FROM ets_start, (VALUES {', '.join(f'({d(a)}, {d(b)}, {d(p)})' for a, b, p in GRID)}) g(a, b, phi) WHERE n >= 10 AND lo < hi
UNION ALL
SELECT fold, upc, cedis, a, b, phi, t + 1, sse + (ys[t + 1] - (l + phi * tr)) * (ys[t + 1] - (l + phi * tr)), l + phi * tr + a * (ys[t + 1] - (l + phi * tr)), phi * tr + b * (ys[t + 1] - (l + phi * tr)), ys
FROM ets_state WHERE t < len(ys)""")
_GN = ("l", "tr", "l1", "l2", "l3", "b1", "b2", "b3", "g1", "g2", "g3", "h11", "h12", "h13", "h22", "h23", "h33")


def ets_fold(suffix: str, source: str) -> None:
    """One walk over the weeks at the parameters of each row of ``source`` (fold, upc, cedis, trial, a, b, phi), sensitivities carried along."""
    key = "fold, upc, cedis, trial, a, b, phi"
    base, err = "(l + phi * tr)", "(ys[t + 1] - (l + phi * tr))"
    s1, s2, s3, rest = "(l1 + phi * b1)", "(l2 + phi * b2)", "(l3 + phi * b3 + tr)", "(1.0::DOUBLE - a)"
    nxt = [f"{base} + a * {err}", f"phi * tr + b * {err}", f"{rest} * {s1} + {err}", f"{rest} * {s2}", f"{rest} * {s3}",
           f"phi * b1 - b * {s1}", f"phi * b2 - b * {s2} + {err}", f"phi * b3 + tr - b * {s3}",
           *[f"g{i} + {err} * {s}" for i, s in enumerate((s1, s2, s3), 1)],
           f"h11 + {s1} * {s1}", f"h12 + {s1} * {s2}", f"h13 + {s1} * {s3}", f"h22 + {s2} * {s2}", f"h23 + {s2} * {s3}", f"h33 + {s3} * {s3}"]
    cte(f"ets_state{suffix}", f"ets_start {source}", f"""
SELECT fold, upc, cedis, trial, a, b, phi, 0 AS t, 0.0::DOUBLE AS sse, {_m(1, 10)} - 5.5::DOUBLE * (({_m(6, 10)} - {_m(1, 5)}) / 5.0::DOUBLE) AS l, ({_m(6, 10)} - {_m(1, 5)}) / 5.0::DOUBLE AS tr,
       {', '.join(f'0.0::DOUBLE AS {c}' for c in _GN[2:])}, ys
FROM ets_start JOIN {source} USING (fold, upc, cedis)
UNION ALL
SELECT {key}, t + 1, sse + {err} * {err}, {', '.join(nxt)}, ys FROM ets_state{suffix} WHERE t < len(ys)""")
    cte(f"ets_end{suffix}", f"ets_state{suffix}", f"SELECT {key}, sse, {', '.join(_GN)} FROM ets_state{suffix} WHERE t = len(ys)")


cte("ets_at", "ets_state", """
SELECT fold, upc, cedis, 0 AS trial, a, b, phi
FROM (SELECT *, row_number() OVER (PARTITION BY fold, upc, cedis ORDER BY sse, a, b, phi) AS rk FROM ets_state WHERE t = len(ys)) WHERE rk = 1""")
ets_fold("_0", "ets_at")
cte("ets_best_0", "ets_end_0", "SELECT * FROM ets_end_0")
for _i in range(1, 4):
    _a = {i: f"(h{i}{i} * 1.01::DOUBLE + 1e-6::DOUBLE * (h11 + h22 + h33))" for i in (1, 2, 3)}
    _m11, _m12, _m13 = f"({_a[2]} * {_a[3]} - h23 * h23)", f"(h12 * {_a[3]} - h23 * h13)", f"(h12 * h23 - {_a[2]} * h13)"
    _n1, _n2, _n3 = f"(g2 * {_a[3]} - h23 * g3)", f"(g2 * h23 - {_a[2]} * g3)", "(h12 * g3 - g2 * h13)"
    _det = f"nullif({_a[1]} * {_m11} - h12 * {_m12} + h13 * {_m13}, 0.0::DOUBLE)"
    _by = [f"(g1 * {_m11} - h12 * {_n1} + h13 * {_n2}) / {_det}", f"({_a[1]} * {_n1} - g1 * {_m12} + h13 * {_n3}) / {_det}", f"(0.0::DOUBLE - {_a[1]} * {_n2} - h12 * {_n3} + g1 * {_m13}) / {_det}"]
    cte(f"ets_to_{_i}", f"ets_best_{_i - 1}", f"""
SELECT fold, upc, cedis, trial, a, least(greatest(b1_, 0.0001::DOUBLE), a) AS b, least(greatest(p1_, 0.8::DOUBLE), 0.98::DOUBLE) AS phi
FROM (SELECT fold, upc, cedis, s.trial, least(greatest(coalesce(a + s.share * d1_, a), 0.001::DOUBLE), 0.99::DOUBLE) AS a, coalesce(b + s.share * d2_, b) AS b1_, coalesce(phi + s.share * d3_, phi) AS p1_
      FROM (SELECT * EXCLUDE (trial), {_by[0]} AS d1_, {_by[1]} AS d2_, {_by[2]} AS d3_ FROM ets_best_{_i - 1}) CROSS JOIN (VALUES (1, 1.0::DOUBLE), (2, 0.25::DOUBLE)) s(trial, share))""")
    ets_fold(f"_{_i}", f"ets_to_{_i}")
    cte(f"ets_best_{_i}", f"ets_best_{_i - 1} ets_end_{_i}", f"""
SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY fold, upc, cedis ORDER BY sse, a, b, phi, trial) AS rk
FROM (SELECT * FROM ets_best_{_i - 1} UNION ALL SELECT * FROM ets_end_{_i})) WHERE rk = 1""")
cte("ets_fit", "ets_start ets_best_3", """
SELECT s.fold, s.origin, s.upc, s.cedis, s.mean, s.n, sse, a AS alpha, b AS beta, phi, l AS level, tr AS trend
FROM ets_start s LEFT JOIN ets_best_3 g USING (fold, upc, cedis)""")


def _ets_steps() -> str:
    from statistics import NormalDist

    parts = []
    spread = "1.0::DOUBLE"
    for h in H:
        damp = "(" + " + ".join(f"phi ** {k}" for k in range(1, h + 1)) + ")"
        cols = ", ".join(
            f"coalesce(level + {damp} * trend" + ("" if q == "q50" else f" + {d(NormalDist().inv_cdf(lv))} * sqrt(sse / n * ({spread}))") + f", mean) AS {q}"
            for q, lv in zip(QS, LV))
        parts.append(f"SELECT fold, upc, cedis, origin, CAST({h} AS INTEGER) AS h, CAST(origin + {7 * h} AS DATE) AS target_week, 'ets' AS model, {cols} FROM ets_fit")
        spread += f" + (alpha + beta * {damp}) ** 2"
    return " UNION ALL ".join(parts)


cte("ets", "ets_fit", finalized(_ets_steps(), PRED_COLS))

# ------------------------------------------------------------------ metrics, calibration, selection
PINBALL = "(" + " + ".join(f"avg(greatest({d(lv)} * (y - {q}), {d(lv - 1)} * (y - {q}))) / nullif(avg(abs(y)), 0)" for q, lv in zip(QS, LV)) + ") / 5"
METRIC_COLS = ("wape", "mape", "bias", "pinball", "coverage_90", "coverage_80", "width_rel")


def metrics_sql(source: str, keys: str) -> str:
    return f"""
SELECT {keys}{',' if keys else ''} count(*) AS n, sum(abs(y - q50)) / nullif(sum(abs(y)), 0) AS wape, avg(abs(y - q50) / nullif(y, 0)) FILTER (y > 0) AS mape,
       sum(q50 - y) / nullif(sum(abs(y)), 0) AS bias, {PINBALL} AS pinball, avg(CAST(y BETWEEN q05 AND q95 AS INTEGER)) AS coverage_90,
       avg(CAST(y BETWEEN q10 AND q90 AS INTEGER)) AS coverage_80, median((q95 - q05) / greatest(q50, {d(1e-9)})) AS width_rel
FROM {source} WHERE y IS NOT NULL {'GROUP BY ' + keys if keys else ''}"""


def calibration_sql(source: str) -> str:
    parts = []
    for lo, hi in (("q10", "q90"), ("q05", "q95")):
        parts.append(f"""SELECT model, cluster, '{lo}' AS lo, '{hi}' AS hi, {d(NOMINAL[lo])} AS nominal,
       greatest(quantile_cont(greatest({lo} - y, y - {hi}) / greatest({hi} - {lo}, {d(1e-6)}), {d(NOMINAL[lo])}), {d(-0.4)}) AS k, count(*) AS n
FROM {source} WHERE y IS NOT NULL GROUP BY model, cluster""")
    return " UNION ALL ".join(parts)


def calibrated_sql(source: str, calib: str) -> str:
    rest = f"SELECT column_name FROM (DESCRIBE {source})"  # noqa: F841
    inner = f"""
SELECT p.* REPLACE (p.q10 - coalesce(k.k10, 0) * greatest(p.q90 - p.q10, {d(1e-6)}) AS q10, p.q90 + coalesce(k.k10, 0) * greatest(p.q90 - p.q10, {d(1e-6)}) AS q90,
                    p.q05 - coalesce(k.k05, 0) * greatest(p.q95 - p.q05, {d(1e-6)}) AS q05, p.q95 + coalesce(k.k05, 0) * greatest(p.q95 - p.q05, {d(1e-6)}) AS q95)
FROM {source} p LEFT JOIN (SELECT model, cluster, max(k) FILTER (lo = 'q10') AS k10, max(k) FILTER (lo = 'q05') AS k05 FROM {calib} GROUP BY model, cluster) k USING (model, cluster)"""
    qs = ", ".join(f"greatest({q}, 0.0::DOUBLE)" for q in QS)
    return "SELECT * EXCLUDE (s, " + ", ".join(QS) + "), " + ", ".join(f"s[{i + 1}] AS {q}" for i, q in enumerate(QS)) + f" FROM (SELECT *, list_sort([{qs}]) AS s FROM ({inner}))"


RANK = "CASE model WHEN 'ma4' THEN 1 WHEN 'seasonal_naive' THEN 2 WHEN 'ets' THEN 3 ELSE 4 END"


def selection_sql(source: str) -> str:
    return f"""
SELECT cluster, model AS selected_model, wape_mean, wape_std, bias_mean, coverage_90, best_wape,
       CASE WHEN wape_mean = best_wape THEN 'lowest mean WAPE' ELSE printf('within 0.02 WAPE of best (%.3f) with lower fold spread', best_wape) END AS rationale
FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY wape_std ASC NULLS LAST, {RANK}) AS pick
      FROM (SELECT *, min(wape_mean) OVER (PARTITION BY cluster) AS best_wape
            FROM (SELECT cluster, model, avg(wape) AS wape_mean, stddev_samp(wape) AS wape_std, avg(bias) AS bias_mean, avg(coverage_90) AS coverage_90 FROM {source} GROUP BY cluster, model))
      WHERE wape_mean <= best_wape + 0.02::DOUBLE) WHERE pick = 1"""


for level, keys in {"fold": "model, cluster, fold", "cluster": "model, cluster", "cluster_h": "model, cluster, h", "overall": "model", "cedis": "model, cedis"}.items():
    cte(f"m_{level}", "pred", metrics_sql("pred", keys))
cte("selection", "m_fold", selection_sql("m_fold"))
cte("early", "pred", "SELECT * FROM pred WHERE fold < 5")
cte("late", "pred", "SELECT * FROM pred WHERE fold >= 5")
cte("calib", "early", calibration_sql("early"))
cte("late_cal", "late calib", calibrated_sql("late", "calib"))
cte("hold_cal", "late_cal", metrics_sql("late_cal", "model, cluster"))
cte("hold_raw", "late", metrics_sql("late", "model, cluster"))
# blind test: fold 7 is sealed, folds whose targets end by its origin are usable
cte("blind_folds", "folds", """
SELECT fold, origin, CASE WHEN fold = 7 THEN 'sealed' WHEN origin + 56 <= (SELECT max(origin) FROM folds) THEN 'usable' ELSE 'overlap' END AS role FROM folds""")
cte("usable", "pred blind_folds", "SELECT p.* FROM pred p SEMI JOIN (SELECT * FROM blind_folds WHERE role = 'usable') b ON p.fold = b.fold")
cte("sealed", "pred", "SELECT * FROM pred WHERE fold = 7")
cte("blind_calib", "usable", calibration_sql("usable"))
cte("sealed_cal", "sealed blind_calib", calibrated_sql("sealed", "blind_calib"))
cte("blind_cluster", "sealed_cal", metrics_sql("sealed_cal", "model, cluster"))
cte("usable_fold", "usable", metrics_sql("usable", "model, cluster, fold"))
cte("preselection", "usable_fold", selection_sql("usable_fold"))
cte("blind_over", "sealed_cal sealed", f"""
SELECT a.*, b.coverage_90 AS coverage_90_raw, b.coverage_80 AS coverage_80_raw
FROM ({metrics_sql('sealed_cal', 'model')}) a JOIN ({metrics_sql('sealed', 'model')}) b USING (model)""")
cte("regret", "blind_cluster preselection", """
SELECT c.cluster, c.model AS pre_registered_model, c.wape AS blind_wape_pre_registered, b.model AS best_model_in_hindsight, b.wape AS blind_wape_best,
       c.wape - b.wape AS regret, c.coverage_90 AS coverage_90_pre_registered, c.n, c.model = b.model AS choice_held
FROM blind_cluster c JOIN preselection s ON c.cluster = s.cluster AND c.model = s.selected_model
JOIN (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY wape, model) AS rk FROM blind_cluster) b ON b.cluster = c.cluster AND b.rk = 1""")

# ------------------------------------------------------------------ forecast
cte("fc_raw", "ma4_final snaive_final eligible_final series", """
SELECT p.* EXCLUDE (fold), e.n_weeks_at_origin, CASE p.fold WHEN 0 THEN 'final' ELSE 'risk_eval' END AS origin_label, s.cluster
FROM (SELECT * FROM ma4_final UNION ALL SELECT * FROM snaive_final) p
LEFT JOIN eligible_final e ON p.fold = e.fold AND p.upc = e.upc AND p.cedis = e.cedis LEFT JOIN series s ON p.upc = s.upc AND p.cedis = s.cedis""")
cte("fc_all", "fc_raw calib", calibrated_sql("fc_raw", "calib"))
cte("fc", "fc_all selection series", """
SELECT f.*, s.is_discontinued, s.is_high_promo, coalesce(n_weeks_at_origin, 0) < 26 AS is_cold_start
FROM fc_all f LEFT JOIN selection x USING (cluster) LEFT JOIN series s ON f.upc = s.upc AND f.cedis = s.cedis
WHERE f.model = CASE WHEN coalesce(n_weeks_at_origin, 0) < 26 THEN 'ma4' ELSE coalesce(x.selected_model, 'ma4') END""")

# ------------------------------------------------------------------ lognormal maths
NUM = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
DEN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _poly(cs: tuple[float, ...], x: str) -> str:
    out = d(cs[0])
    for c in cs[1:]:
        out = f"({out} * {x} + {d(c)})"
    return out


def phi(x: str) -> str:
    a = f"abs({x})"
    tail = (f"exp(-{a} * {a} / 2.0) * CASE WHEN {a} < {d(7.07106781186547)} THEN {_poly(NUM, a)} / {_poly(DEN, a)} "
            f"ELSE 1.0 / (({a} + 1.0 / ({a} + 2.0 / ({a} + 3.0 / ({a} + 4.0 / ({a} + 0.65))))) * {d(2.506628274631)}) END")
    return f"(CASE WHEN ({x}) > 0 THEN 1.0 - {tail} ELSE {tail} END)"


def mu(q50: str) -> str:
    return f"ln(greatest({q50}, {d(1e-6)}))"


def sigma(q50: str, q90: str) -> str:
    base = f"greatest({q50}, 1.0::DOUBLE)"
    return f"least(greatest(ln(greatest({q90}, {q50}, {base}) / {base}) / {d(1.2815515655446004)}, {d(0.05)}), {d(1.5)})"


# functions of columns named mu and sigma
def p_exceeds(stock: str) -> str:
    return f"CASE WHEN {stock} <= 0 THEN 1.0::DOUBLE ELSE 1.0 - {phi(f'((ln(greatest({stock}, {d(1e-6)})) - mu) / sigma)')} END"


MEAN = "exp(mu + sigma * sigma / 2.0)"


def shortfall(stock: str) -> str:
    s = f"greatest({stock}, {d(1e-6)})"
    return (f"CASE WHEN {stock} <= 0 THEN {MEAN} ELSE greatest({MEAN} * (1.0 - {phi(f'((ln({s}) - mu - sigma * sigma) / sigma)')}) "
            f"- {s} * (1.0 - {phi(f'((ln({s}) - mu) / sigma)')}), 0.0::DOUBLE) END")


# ------------------------------------------------------------------ risk
def shares_sql(end: str) -> str:
    return f"""
SELECT g.upc, g.cedis, CAST(g.dow AS INTEGER) AS dow, coalesce(s.v / nullif(g.total, 0), {d(1.0 / 7)}) AS share
FROM (SELECT upc, cedis, dow, total FROM (SELECT upc, cedis, sum(sell_out_pzs) AS total FROM daily
        WHERE date <= {end} AND date > {end} - 182 AND sell_out_pzs IS NOT NULL GROUP BY upc, cedis) CROSS JOIN (SELECT unnest(range(7)) AS dow)) g
LEFT JOIN (SELECT upc, cedis, isodow(date) - 1 AS dow, sum(sell_out_pzs) AS v FROM daily
        WHERE date <= {end} AND date > {end} - 182 AND sell_out_pzs IS NOT NULL GROUP BY ALL) s ON g.upc = s.upc AND g.cedis = s.cedis AND g.dow = s.dow"""


def daily_fc_sql(label: str, shares: str, start: str, end: str) -> str:
    return f"""
SELECT g.upc, g.cedis, g.date, f.q50 * coalesce(s.share, {d(1.0 / 7)}) AS d50, f.q90 * coalesce(s.share, {d(1.0 / 7)}) AS d90
FROM (SELECT upc, cedis, date, greatest(date - (isodow(date) - 1)::INTEGER, (SELECT min(target_week) FROM fc WHERE origin_label = '{label}')) AS week, isodow(date) - 1 AS dow
      FROM (SELECT DISTINCT upc, cedis FROM fc WHERE origin_label = '{label}')
      CROSS JOIN (SELECT CAST(unnest(generate_series(({start})::TIMESTAMP, ({end})::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date)) g
LEFT JOIN (SELECT * FROM fc WHERE origin_label = '{label}') f ON g.upc = f.upc AND g.cedis = f.cedis AND g.week = f.target_week
LEFT JOIN {shares} s ON g.upc = s.upc AND g.cedis = s.cedis AND g.dow = s.dow"""


def scored_sql(inventory: str, demand: str) -> str:
    return f"""
SELECT * EXCLUDE (mu, sigma, before), coalesce((on_hand - before) / greatest(before, CASE WHEN before IS NOT NULL THEN 1.0::DOUBLE END), 0.0::DOUBLE) AS on_hand_change_3d,
       least(coalesce(sell_out_pzs / greatest(d50, {d(1e-6)}), 1.0::DOUBLE), 10.0::DOUBLE) AS sales_ratio_1d,
       least(coalesce(sales_7d / greatest(exp_7d, {d(1e-6)}), 1.0::DOUBLE), 10.0::DOUBLE) AS sales_ratio_7d,
       ln(1 + least(cover_days, 365.0::DOUBLE)) AS log_cover,
       coalesce(cover_days < cover_threshold, false) AS alert_cover, coalesce(p_stockout_7d > 0.5, false) AS alert_prob
FROM (SELECT *, on_hand / greatest(daily_mean_7d, {d(1e-6)}) AS cover_days, {p_exceeds('on_hand')} AS p_stockout_7d,
             sum(sell_out_pzs) OVER w AS sales_7d, sum(d50) OVER w AS exp_7d, lag(on_hand, 3) OVER (PARTITION BY upc, cedis ORDER BY date) AS before
      FROM (SELECT i.*, f.d50, f.d90, f.fwd50, f.fwd90, s.cluster, s.lead_time_days, s.safety_stock_days, d.sell_out_pzs, coalesce(d.promo_flag, 0) AS promo_flag,
                   f.fwd50 / 7 AS daily_mean_7d, s.lead_time_days + s.safety_stock_days AS cover_threshold, {mu('f.fwd50')} AS mu, {sigma('f.fwd50', 'f.fwd90')} AS sigma
            FROM {inventory} i JOIN (SELECT *, sum(d50) OVER n AS fwd50, sum(d90) OVER n AS fwd90 FROM {demand}
                              WINDOW n AS (PARTITION BY upc, cedis ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)) f ON i.upc = f.upc AND i.cedis = f.cedis AND i.date = f.date
            LEFT JOIN series s ON i.upc = s.upc AND i.cedis = s.cedis LEFT JOIN daily d ON i.upc = d.upc AND i.cedis = d.cedis AND i.date = d.date)
      WINDOW w AS (PARTITION BY upc, cedis ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""


cte("shares_eval", "daily", shares_sql("DATE '2001-10-07'"))
cte("shares_asof", "daily", shares_sql("DATE '2001-11-01'"))
cte("dfc_eval", "fc shares_eval inv", daily_fc_sql("risk_eval", "shares_eval", "SELECT min(date) FROM inv", "SELECT max(date) + 7 FROM inv"))
cte("dfc_asof", "fc shares_asof", daily_fc_sql("final", "shares_asof", "DATE '2001-10-25'", "DATE '2001-11-08'"))
cte("inv_tail", "inv", "SELECT * FROM inv WHERE date > DATE '2001-10-25' AND date <= DATE '2001-11-01'")
cte("scored_eval", "inv dfc_eval series daily", scored_sql("inv", "dfc_eval"))
cte("scored_asof", "inv_tail dfc_asof series daily", scored_sql("inv_tail", "dfc_asof"))
cte("labeled", "scored_eval", """
SELECT *, CASE WHEN n_ahead = 7 THEN any_ahead END AS label_7d, event AND coalesce(NOT prev_event, false) AS episode_onset
FROM (SELECT *, count(*) OVER a AS n_ahead, max(CAST(event AS INTEGER)) OVER a AS any_ahead, lag(event) OVER (PARTITION BY upc, cedis ORDER BY date) AS prev_event
      FROM (SELECT *, stockout_store_share >= 0.25 AS event FROM scored_eval)
      WINDOW a AS (PARTITION BY upc, cedis ORDER BY date RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 7 DAY FOLLOWING))""")
cte("alerts", "scored_asof", """
SELECT *, CASE WHEN p_stockout_7d > 0.75 OR cover_days < lead_time_days THEN 'high' WHEN alert_cover OR alert_prob THEN 'medium' ELSE 'none' END AS severity
FROM scored_asof WHERE date = DATE '2001-11-01'""")


def confusion(alert: str, event: str) -> str:
    tp, al, ev = f"count(*) FILTER ({alert} AND {event})", f"count(*) FILTER ({alert})", f"count(*) FILTER ({event})"
    pr, rc = f"{tp} / nullif({al}, 0)", f"{tp} / nullif({ev}, 0)"
    return (f"count(*) AS n, {al} AS n_alerts, {ev} AS n_events, {r4(pr, 'precision')}, {r4(rc, 'recall')}, "
            + r4(f"2.0::DOUBLE * ({pr}) * ({rc}) / nullif(({pr}) + ({rc}), 0)", "f1")
            + ", " + r4(f"count(*) FILTER ({alert} AND NOT ({event})) / nullif(count(*) FILTER (NOT ({event})), 0)", "false_alarm_rate"))


cte("by_method", "labeled", """
SELECT 'cover' AS method, alert_cover AS alert, * FROM labeled UNION ALL SELECT 'prob', alert_prob, * FROM labeled""")

# ------------------------------------------------------------------ orders
cte("protect", "fc series", """
SELECT f.upc, f.cedis, """ + ", ".join(f"sum(f.{q}) AS {q}" for q in QS) + """, count(*) AS weeks_available
FROM fc f JOIN series s ON f.upc = s.upc AND f.cedis = s.cedis WHERE f.origin_label = 'final' AND f.h <= ceil((s.lead_time_days + 7) / 7) GROUP BY f.upc, f.cedis""")
cte("naive_dem", "weekly series", """
SELECT upc, cedis, ma4_weekly, ma4_weekly * 2 AS ma4_demand, coalesce(ly, ma4_weekly * 2) AS ly_demand
FROM (SELECT upc, cedis, avg(y) FILTER (rk <= 4) AS ma4_weekly, sum(y) FILTER (week_start IN (DATE '2001-10-29' + 7 - 364, DATE '2001-10-29' + 14 - 364)) AS ly
      FROM (SELECT *, row_number() OVER (PARTITION BY upc, cedis ORDER BY y IS NULL, week_start DESC) AS rk FROM weekly WHERE week_start <= DATE '2001-10-29') GROUP BY upc, cedis)
WHERE ma4_weekly IS NOT NULL""")
cte("prices", "weekly", "SELECT upc, cedis, avg(price_mean) AS unit_price FROM weekly WHERE week_start > DATE '2001-10-29' - 28 GROUP BY upc, cedis")
cte("projected", "series daily", """
SELECT s.upc, s.cedis, coalesce(s.on_hand_as_of, 0.0::DOUBLE) AS on_hand_as_of, coalesce(g.v, 0.0::DOUBLE) AS sales_after_snapshot, s.on_hand_as_of IS NULL AS no_inventory_snapshot,
       greatest(coalesce(s.on_hand_as_of, 0.0::DOUBLE) - coalesce(g.v, 0.0::DOUBLE), 0.0::DOUBLE) AS on_hand_projected
FROM series s LEFT JOIN (SELECT upc, cedis, sum(sell_out_pzs) AS v FROM daily WHERE date > DATE '2001-11-01' AND date < DATE '2001-11-05' GROUP BY upc, cedis) g USING (upc, cedis)""")


def moq_up(need: str) -> str:
    return f"CASE WHEN is_discontinued OR {need} <= 0 THEN 0.0::DOUBLE ELSE ceil(({need}) / moq) * moq END"


def _z(level: float) -> str:
    from statistics import NormalDist

    return d(NormalDist().inv_cdf(level))


cte("orders0", "protect series fc naive_dem prices projected", f"""
SELECT p.*, s.cluster, s.abc_class, s.xyz_class, s.lead_time_days, s.moq, s.safety_stock_days, s.is_discontinued, s.is_high_promo, f.model, f.is_cold_start,
       n.ma4_weekly, n.ma4_demand, n.ly_demand, x.unit_price, x.unit_price AS unit_value, j.on_hand_as_of, j.sales_after_snapshot, j.no_inventory_snapshot, j.on_hand_projected,
       {mu('p.q50')} AS mu, {sigma('p.q50', 'p.q90')} AS sigma, CASE s.abc_class WHEN 'A' THEN {d(0.95)} WHEN 'B' THEN {d(0.9)} ELSE {d(0.85)} END AS service_level_target,
       CASE s.abc_class WHEN 'A' THEN {_z(0.95)} WHEN 'B' THEN {_z(0.9)} ELSE {_z(0.85)} END AS z
FROM protect p LEFT JOIN series s USING (upc, cedis) LEFT JOIN (SELECT * FROM fc WHERE origin_label = 'final' AND h = 1) f USING (upc, cedis)
LEFT JOIN naive_dem n USING (upc, cedis) LEFT JOIN prices x USING (upc, cedis) LEFT JOIN projected j USING (upc, cedis)""")
cte("orders1", "orders0", f"""
SELECT *, q50 AS demand_p50, q90 AS demand_p90, {MEAN} AS demand_mean, q50 / (lead_time_days + 7) AS daily_mean, CAST(lead_time_days + 7 AS INTEGER) AS protection_period_days,
       safety_stock_days * (q50 / (lead_time_days + 7)) AS safety_stock_policy, exp(mu + sigma * z) - q50 AS safety_stock_quantile FROM orders0""")
cte("orders2", "orders1", f"""
SELECT *, {moq_up('greatest(order_up_to - on_hand_projected, 0.0::DOUBLE)')} AS order_qty, {moq_up('greatest(fq_order_up_to - on_hand_projected, 0.0::DOUBLE)')} AS fq_order_qty,
       {moq_up('greatest(ma4_demand + safety_stock_days * ma4_demand / protection_period_days - on_hand_projected, 0.0::DOUBLE)')} AS ma4_order_qty,
       {moq_up('greatest(ly_demand + safety_stock_days * ly_demand / protection_period_days - on_hand_projected, 0.0::DOUBLE)')} AS ly_order_qty
FROM (SELECT *, greatest(safety_stock_policy, safety_stock_quantile) AS safety_stock,
             CASE WHEN safety_stock_policy >= safety_stock_quantile THEN 'policy_days' ELSE 'forecast_quantile' END AS safety_stock_binding,
             demand_p50 + greatest(safety_stock_policy, safety_stock_quantile) AS order_up_to, demand_p50 + greatest(safety_stock_quantile, 0.0::DOUBLE) AS fq_order_up_to FROM orders1)""")


def _outcome(prefix: str, service: str) -> str:
    st = f"(on_hand_projected + {prefix}order_qty)"
    return f"1.0 - ({p_exceeds(st)}) AS {service}, {shortfall(st)} AS {prefix}expected_lost_sales, {prefix}order_qty * unit_value AS {prefix}working_capital"


cte("orders3", "orders2", "SELECT *, " + ", ".join(
    _outcome(px, sv) for px, sv in (("", "implied_service_level"), ("fq_", "fq_service_level"), ("ma4_", "ma4_service_level"), ("ly_", "ly_service_level"))) + " FROM orders2")
cte("orders_", "orders3", f"""
SELECT *, 1.0 - expected_lost_sales / greatest(demand_mean, {d(1e-6)}) AS expected_fill_rate, (on_hand_projected + order_qty) * unit_value AS stock_value_after_order,
       (on_hand_projected + order_qty) / greatest(daily_mean, {d(1e-6)}) AS days_of_cover_after_order, order_up_to * unit_value AS target_stock_value, fq_order_up_to * unit_value AS fq_target_stock_value,
       working_capital - ma4_working_capital AS delta_working_capital_vs_ma4, implied_service_level - ma4_service_level AS delta_service_level_vs_ma4,
       expected_lost_sales - ma4_expected_lost_sales AS delta_lost_sales_vs_ma4, DATE '2001-10-29' AS origin,
       concat_ws(';', CASE WHEN is_cold_start THEN 'cold_start' END, CASE WHEN is_discontinued THEN 'discontinued_review' END, CASE WHEN is_high_promo THEN 'high_promo' END,
                 CASE WHEN no_inventory_snapshot THEN 'no_inventory_snapshot' END, CASE WHEN weeks_available < ceil((lead_time_days + 7) / 7) THEN 'short_horizon' END) AS flags
FROM orders3""")
TOTALS = {
    "order_units": "order_qty", "working_capital": "working_capital", "expected_lost_units": "expected_lost_sales", "demand_mean_units": "demand_mean",
    "ma4_order_units": "ma4_order_qty", "ma4_working_capital": "ma4_working_capital", "ma4_expected_lost_units": "ma4_expected_lost_sales",
    "ly_order_units": "ly_order_qty", "ly_working_capital": "ly_working_capital", "fq_order_units": "fq_order_qty", "fq_working_capital": "fq_working_capital",
    "fq_expected_lost_units": "fq_expected_lost_sales", "target_stock_value": "target_stock_value", "fq_target_stock_value": "fq_target_stock_value",
}
_SL = {"": "implied_service_level", "ma4_": "ma4_service_level", "fq_": "fq_service_level"}
cte("summary", "orders_", "SELECT *, " + ", ".join(f"1 - {p}expected_lost_units / demand_mean_units AS {p}fill_rate" for p in _SL) + """,
       working_capital - ma4_working_capital AS delta_working_capital_vs_ma4, ma4_expected_lost_units - expected_lost_units AS lost_units_reduction_vs_ma4,
       target_stock_value - fq_target_stock_value AS target_stock_value_freed_by_fq
FROM (SELECT CASE grouping_id(cluster, cedis) WHEN 3 THEN 'portfolio' WHEN 1 THEN 'cluster' ELSE 'cedis' END AS level, coalesce(cluster, cedis, 'portfolio') AS name, count(*) AS n_series, """
    + ", ".join(f"sum({c}) AS {n}" for n, c in TOTALS.items()) + ", " + ", ".join(f"count(*) FILTER ({c} < 0.9) AS {p}lines_below_90" for p, c in _SL.items()) + ", "
    + ", ".join(f"sum({c} * demand_mean) / nullif(sum(demand_mean), 0) AS {p}service_level_weighted" for p, c in _SL.items())
    + " FROM orders_ GROUP BY GROUPING SETS ((), (cluster), (cedis)))")

# ------------------------------------------------------------------ the queries
register("a1_scan_sell_out", "sell_out", f"SELECT date, {rr('sell_out_pzs')}, upc, cedis, {rr('final_price')}, promo_flag FROM sell_out")
register("a2_store_catalog", "stores", "SELECT store_nbr, cedis FROM stores")
register("a3_product_catalog", "catalog", "SELECT prime_item_nbr, upc, " + rr("avg_daily_sales", "median_daily_sales", "std_daily_sales", "cv_demand", "sales_share")
         + ", abc_class, xyz_class, lead_time_days, moq, safety_stock_days, cluster FROM catalog")
register("a4_scan_inventory", "stock", f"SELECT date, upc, store_nbr, {rr('on_hand_qty')}, cedis FROM stock")
register("a5_schema_violations", "inventory", """
SELECT 'cast:' || c AS rule, CAST(0 AS BIGINT) AS violations FROM (SELECT unnest(['date', 'prime_item_nbr', 'upc', 'store_nbr', 'on_hand_qty']) AS c)
UNION ALL SELECT 'null:date', count(*) FILTER (date IS NULL) FROM inventory UNION ALL SELECT 'null:upc', count(*) FILTER (upc IS NULL) FROM inventory
UNION ALL SELECT 'null:on_hand_qty', count(*) FILTER (on_hand_qty IS NULL) FROM inventory
UNION ALL SELECT 'duplicate:date,upc,store_nbr', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM inventory GROUP BY date, upc, store_nbr)""")
register("a6_negative_values", "sell_out inventory", """
SELECT count(*) FILTER (sell_out_pzs < 0) AS negative_rows, 'sell_out' AS relation FROM sell_out UNION ALL SELECT count(*) FILTER (on_hand_qty < 0), 'inventory' FROM inventory""")
register("a7_unmatched_keys", "sell_out catalog inventory stores", """
SELECT DISTINCT 'upc' AS key, upc AS value FROM sell_out ANTI JOIN (SELECT upc FROM catalog WHERE abc_class = 'A') USING (upc)
UNION ALL SELECT DISTINCT 'store_nbr', store_nbr FROM inventory ANTI JOIN stores USING (store_nbr)""")
register("a8_join_cardinality", "stores catalog_raw catalog sell_out", " UNION ALL ".join(
    f"SELECT CAST(sum(n - 1) AS BIGINT) AS surplus_rows, '{t}' AS relation FROM (SELECT count(*) AS n FROM {t} GROUP BY {k})"
    for t, k in (("stores", "store_nbr"), ("catalog_raw", "upc"), ("catalog", "upc"), ("sell_out", "upc, cedis, date"))))
register("a9_parquet_round_trip", "pred", f"SELECT model, upc, cedis, fold, h, target_week, {rr('q05', 'q10', 'q50', 'q90', 'q95', 'y')} FROM pred")
register("a10_csv_round_trip", "sell_out", f"SELECT date, {rr('sell_out_pzs')}, upc, cedis, {rr('final_price')}, promo_flag FROM sell_out")
register("a11_inventory_coverage", "stock", "SELECT date, count(*) AS rows, count(DISTINCT upc) AS upcs, count(DISTINCT store_nbr) AS stores FROM stock GROUP BY date")
register("a12_series_coverage", "series", "SELECT upc, cedis, cluster, first_date, n_days, n_weeks, is_cold_start, is_discontinued, has_inventory FROM series")

register("b1_collapse_item_numbers", "stock", f"SELECT date, upc, store_nbr, {rr('on_hand_qty')} FROM stock")
_inv_cols = "stores_reporting, stores_at_or_below_zero, stores_negative"
register("b2_inventory_by_centre", "inv", f"SELECT date, upc, cedis, {rr('on_hand', 'on_hand_raw', 'stockout_store_share')}, {_inv_cols} FROM inv")
register("b2_inventory_by_centre_unclipped", "inv", f"SELECT date, upc, cedis, {r4('on_hand_raw', 'on_hand')}, {rr('on_hand_raw', 'stockout_store_share')}, {_inv_cols} FROM inv")
register("b3_daily_grid", "daily0", f"SELECT upc, cedis, date, {rr('sell_out_pzs', 'final_price')}, promo_flag, is_missing FROM daily0")
register("b4_outliers", "daily1", f"SELECT upc, cedis, date, {rr('sell_out_pzs', 'sell_out_capped')}, outlier_flag FROM daily1")
_flags = "is_payday, is_payday_window, is_holiday, is_semana_santa, is_buen_fin, is_december_peak"
register("b5_daily_with_calendar", "daily", f"SELECT upc, cedis, date, {rr('sell_out_pzs', 'final_price', 'sell_out_capped')}, promo_flag, is_missing, outlier_flag, {_flags}, week_start FROM daily")
register("b6_data_summary", "daily", f"""
SELECT count(*) AS n_rows, count(DISTINCT (upc, cedis)) AS n_series, {r4('avg(is_missing)', 'missing_share')}, CAST(sum(outlier_flag) AS BIGINT) AS n_outliers, min(date) AS first_date, max(date) AS last_date FROM daily""")
register("c123_moving_feasts", "sell_out easter", """
SELECT CAST(y.year AS INTEGER) AS year, third_monday, third_monday - 3 AS buen_fin_first, easter - 7 AS palm_sunday, easter AS easter_sunday
FROM (SELECT DISTINCT year(date) AS year, make_date(year(date), 11, 1) + CAST((8 - isodow(make_date(year(date), 11, 1))) % 7 + 14 AS INTEGER) AS third_monday FROM sell_out) y
JOIN easter e ON e.y = y.year""")
register("c4_daily_calendar", "calendar", f"SELECT date, dow, is_weekend, {_flags}, week_start FROM calendar")
register("c5_weekly_calendar", "weekly_cal", "SELECT * FROM weekly_cal")
register("d1_complete_weeks", "daily", f"""
SELECT week_start, count(*) AS days, {r4('sum(sell_out_pzs)', 'units')} FROM daily WHERE week_start BETWEEN DATE '1995-01-02' AND DATE '2001-10-29' GROUP BY week_start""")
_week = "days_observed, n_outliers, zero_days, " + rr("price_mean", "promo_share", "y", "y_capped")
_cal_days = "payday_days, payday_window_days, holiday_days, semana_santa_days, buen_fin_days, december_peak_days, week_of_year, month"
register("d2_week_sums", "week_sums", f"SELECT upc, cedis, week_start, {_week} FROM week_sums")
register("d4_week_grid", "weekly", f"SELECT upc, cedis, week_start, {_week}, series_age_weeks FROM weekly")
register("d_weekly_table", "weekly", f"SELECT upc, cedis, week_start, {_week}, {_cal_days}, cluster, abc_class, xyz_class, lead_time_days, moq, safety_stock_days, series_age_weeks FROM weekly")
register("e1_observed_day_facts", "series", f"SELECT upc, cedis, first_date, last_date, n_days, interior_gap_days, {rr('mean_daily')} FROM series")
register("e3_observed_week_facts", "series", f"SELECT upc, cedis, first_week, n_weeks, {rr('mean_weekly', 'tail8_mean', 'tail8_promo_share', 'tail4_mean')} FROM series WHERE n_weeks IS NOT NULL")
register("e5_stock_as_of", "inv", f"SELECT upc, cedis, {r4('on_hand', 'on_hand_as_of')} FROM inv WHERE date = DATE '2001-11-01'")
register("e_series_table", "series", f"""
SELECT upc, cedis, first_date, last_date, n_days, interior_gap_days, first_week, n_weeks, {rr('mean_daily', 'mean_weekly', 'tail8_mean', 'tail8_promo_share', 'tail4_mean', 'on_hand_as_of')},
       cluster, abc_class, xyz_class, lead_time_days, moq, safety_stock_days, has_inventory, is_cold_start, is_discontinued, is_high_promo FROM series""")

register("f1_future_grid", "weekly folds weekly_cal", f"""
SELECT s.fold, s.upc, s.cedis, s.origin, CAST(h.h AS INTEGER) AS h, s.origin + CAST(7 * h.h AS INTEGER) AS target_week, {_cal_days}
FROM (SELECT DISTINCT f.fold, f.origin, w.upc, w.cedis FROM weekly w JOIN folds f ON w.week_start <= f.origin) s
CROSS JOIN (SELECT unnest(range(1, 9)) AS h) h LEFT JOIN weekly_cal c ON c.week_start = s.origin + CAST(7 * h.h AS INTEGER)""")
register("f2_finalize_quantiles", "weekly", "SELECT upc, cedis, week_start, " + rr(*QS) + " FROM (" + finalized("""
SELECT upc, cedis, week_start, y - 40 * (series_age_weeks % 5) AS q05, y + 10 AS q10, y * 0.5 AS q50, y - 3 * (series_age_weeks % 5) AS q90, y * 0.9 AS q95 FROM weekly WHERE y IS NOT NULL""", "upc, cedis, week_start") + ")")
register("f3_moving_average", "ma4", f"SELECT {PRED_COLS}, {rr(*QS)} FROM ma4")
register("f3r_moving_average_residuals", "resid", f"SELECT upc, cedis, week_start, {rr('y', *[f'r{h}' for h in H])} FROM resid")
register("f4_seasonal_naive", "snaive", f"SELECT {PRED_COLS}, {rr(*QS)} FROM snaive")
register("f6_damped_trend_fit", "ets_fit", f"SELECT fold, upc, cedis, origin, n, {rr('mean', 'sse', 'alpha', 'beta', 'phi', 'level', 'trend')} FROM ets_fit")
register("f6_damped_trend", "ets", f"SELECT {PRED_COLS}, {rr(*QS)} FROM ets")
register("f6i_interpolated_history", "filled", f"SELECT fold, upc, cedis, week_start, {rr('yi')} FROM filled")


def rolled(column: str, weeks: int, least_obs: int, fn: str = "avg") -> str:
    frame = f"OVER (PARTITION BY upc, cedis ORDER BY week_start ROWS BETWEEN {weeks - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) {frame} >= {least_obs} THEN {fn}({column}) {frame} END"


cte("scaled", "weekly", f"SELECT *, greatest({rolled('y_capped', 13, 4)}, CASE WHEN {rolled('y_capped', 13, 4)} IS NOT NULL THEN 1.0::DOUBLE END) AS scale FROM weekly")
cte("feats", "scaled", "SELECT *, roll4 - roll13 AS trend4_13 FROM (SELECT *, ln(1 + scale) AS log_scale, " + ", ".join(
    f"lag(y_capped, {k - 1}) OVER (PARTITION BY upc, cedis ORDER BY week_start) / scale AS lag{k}" for k in range(1, 9)) + ", "
    + ", ".join(f"{rolled('y_capped', w, 2)} / scale AS roll{w}" for w in (4, 8, 13, 26))
    + f", {rolled('y_capped', 8, 3, 'stddev_samp')} / scale AS roll8_std, price_mean AS price_last, price_mean / ({rolled('price_mean', 4, 1)}) AS price_ratio4, "
    + f"promo_share AS promo_last, {rolled('promo_share', 4, 1)} AS promo_roll4, zero_days AS zero_days_last, series_age_weeks AS series_age FROM scaled)")
_f_doubles = ["scale", "log_scale", *[f"lag{k}" for k in range(1, 9)], *[f"roll{w}" for w in (4, 8, 13, 26)], "roll8_std", "trend4_13", "price_last", "price_ratio4", "promo_last", "promo_roll4"]
register("f7_series_features", "feats", f"SELECT upc, cedis, week_start, {rr(*_f_doubles)}, zero_days_last, series_age FROM feats")
register("f8_last_year_lookup", "weekly", f"SELECT upc, cedis, week_start + 364 AS target_week, {r4('y_capped', 'lag52_target_raw')} FROM weekly")
_cal7 = "payday_days, holiday_days, semana_santa_days, buen_fin_days, december_peak_days, week_of_year, month"
_cal7c = ", ".join("c." + c.strip() for c in _cal7.split(","))
register("f9_supervised_rows", "feats weekly_cal", f"""
SELECT f.upc, f.cedis, f.week_start, CAST(h.h AS INTEGER) AS h, t.week_start AS target_week, {r4('f.lag1', 'lag1')}, {r4('f.roll13', 'roll13')},
       {r4('l.y_capped / f.scale', 'lag52_target')}, {r4('t.y_capped / f.scale', 'y_scaled')}, {_cal7c}
FROM feats f CROSS JOIN (SELECT unnest(range(1, 9)) AS h) h
JOIN feats t ON t.upc = f.upc AND t.cedis = f.cedis AND t.week_start = f.week_start + CAST(7 * h.h AS INTEGER)
LEFT JOIN feats l ON l.upc = f.upc AND l.cedis = f.cedis AND l.week_start = f.week_start + CAST(7 * h.h - 364 AS INTEGER)
LEFT JOIN weekly_cal c ON c.week_start = t.week_start WHERE t.y_capped / f.scale IS NOT NULL AND f.lag1 IS NOT NULL""")
register("f10_inference_rows", "feats weekly_cal", f"""
SELECT f.upc, f.cedis, CAST(h.h AS INTEGER) AS h, f.week_start + CAST(7 * h.h AS INTEGER) AS target_week, {r4('f.scale', 'scale')}, {r4('f.lag1', 'lag1')}, {r4('f.roll4', 'roll4')},
       {r4('l.y_capped / f.scale', 'lag52_target')}, {_cal7c}
FROM (SELECT * FROM feats QUALIFY row_number() OVER (PARTITION BY upc, cedis ORDER BY week_start DESC) = 1) f CROSS JOIN (SELECT unnest(range(1, 9)) AS h) h
LEFT JOIN feats l ON l.upc = f.upc AND l.cedis = f.cedis AND l.week_start = f.week_start + CAST(7 * h.h - 364 AS INTEGER)
LEFT JOIN weekly_cal c ON c.week_start = f.week_start + CAST(7 * h.h AS INTEGER)""")
cte("one_step", "feats", """
SELECT upc, cedis, week_start, coalesce(cluster, '') AS cluster, y_capped / lag(scale) OVER (PARTITION BY upc, cedis ORDER BY week_start) AS r FROM feats""")
for _key, _name in (("cluster", "k"), ("upc", "u"), ("cedis", "c")):
    cte(f"stat_{_key}", "one_step", f"""
SELECT {_key}, week_start, coalesce(sum(s) OVER w, 0.0::DOUBLE) AS {_name}_s, coalesce(sum(n) OVER w, 0) AS {_name}_n
FROM (SELECT {_key}, week_start, sum(r) AS s, count(r) AS n FROM one_step GROUP BY ALL)
WINDOW w AS (PARTITION BY {_key} ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
_codes = {"cluster": [f"{a}-{x}" for a in "ABC" for x in "XYZ"], "abc_class": list("ABC"), "xyz_class": list("XYZ")}
_own = ["log_scale", *_f_doubles[2:]]
register("f11_encoded_features", "feats weekly_cal stat_cluster stat_upc stat_cedis", f"""
SELECT f.upc, f.cedis, {r4('h.h', 'h')}, {', '.join(r4(f'f.{c}', c) for c in _own)}, {r4('f.zero_days_last', 'zero_days_last')}, {r4('f.series_age', 'series_age')},
       {r4('l.y_capped / f.scale', 'lag52_target')}, {', '.join(r4(f'c.{c.strip()}', c.strip()) for c in _cal7.split(','))},
       {r4('(u_s + 20.0 * (k_s + 20.0) / (k_n + 20.0)) / (u_n + 20.0)', 'upc_stat')}, {r4('(c_s + 20.0 * (k_s + 20.0) / (k_n + 20.0)) / (c_n + 20.0)', 'cedis_stat')},
       {', '.join(r4(f"nullif(list_position({v!r}, f.{k}), 0)", f'{k}_code') for k, v in _codes.items())}
FROM (SELECT * FROM feats WHERE week_start = DATE '2001-10-29') f CROSS JOIN (SELECT unnest(range(1, 9)) AS h) h
JOIN stat_cluster k ON k.cluster = coalesce(f.cluster, '') AND k.week_start = f.week_start
JOIN stat_upc u ON u.upc = f.upc AND u.week_start = f.week_start JOIN stat_cedis s ON s.cedis = f.cedis AND s.week_start = f.week_start
LEFT JOIN feats l ON l.upc = f.upc AND l.cedis = f.cedis AND l.week_start = f.week_start + CAST(7 * h.h - 364 AS INTEGER)
LEFT JOIN weekly_cal c ON c.week_start = f.week_start + CAST(7 * h.h AS INTEGER)""")
register("f13_calendar_union", "weekly weekly_cal", f"""
SELECT week_start, {_cal7} FROM weekly_cal WHERE week_start IN (SELECT week_start FROM weekly WHERE week_start <= DATE '2001-10-01')
   OR week_start IN (SELECT CAST(DATE '2001-10-01' + CAST(7 * h AS INTEGER) AS DATE) FROM range(1, 9) r(h))""")

register("g1_fold_origins", "weekly folds", "SELECT f.fold, f.origin, count(DISTINCT (w.upc, w.cedis)) AS n_series FROM folds f JOIN weekly w ON w.week_start <= f.origin GROUP BY ALL")
register("g2_eligible_series", "eligible", "SELECT fold, upc, cedis, n_weeks_at_origin FROM eligible")
register("g3_backtest_predictions", "pred", f"SELECT {PRED_COLS}, {rr(*QS, 'y')}, cluster FROM pred")
register("g4_rows_by_model_and_fold", "pred", "SELECT model, fold, count(*) AS n_rows, count(y) AS n_with_actual FROM pred GROUP BY model, fold")
register("g5_interval_calibration", "calib", f"SELECT model, cluster, lo, hi, {rr('nominal', 'k')}, n FROM calib")
register("g6_apply_calibration", "late_cal", f"SELECT {PRED_COLS}, {rr(*QS, 'y')}, cluster FROM late_cal")
for level, keys in {"fold": "model, cluster, fold", "cluster": "model, cluster", "cluster_h": "model, cluster, h", "overall": "model", "cedis": "model, cedis"}.items():
    register(f"g7_metrics_{level}", f"m_{level}", f"SELECT {keys}, n, {rr(*METRIC_COLS)} FROM m_{level}")
_sel = "SELECT cluster, selected_model, " + rr("wape_mean", "wape_std", "bias_mean", "coverage_90", "best_wape") + ", rationale FROM "
register("g8_model_selection", "selection", _sel + "selection")
register("g9_holdout_report", "hold_cal hold_raw", f"""
SELECT 'calibrated' AS quantiles, model, cluster, n, {rr(*METRIC_COLS)} FROM hold_cal UNION ALL SELECT 'raw', model, cluster, n, {rr(*METRIC_COLS)} FROM hold_raw""")
cte("over_cal", "late_cal", metrics_sql("late_cal", "model"))
cte("over_raw", "late", metrics_sql("late", "model"))
register("g9_holdout_overall", "over_cal over_raw", f"""
SELECT 'calibrated' AS quantiles, model, n, {rr(*METRIC_COLS)} FROM over_cal UNION ALL SELECT 'raw', model, n, {rr(*METRIC_COLS)} FROM over_raw""")
register("h7_alert_metrics", "feats", f"SELECT cedis, {confusion('(lag1 < 0.7::DOUBLE * lag2)', '(y < scale)')} FROM feats WHERE lag2 IS NOT NULL AND y IS NOT NULL GROUP BY cedis")
register("h8_lead_time", "daily", """
SELECT e.upc, e.cedis, e.date, CAST(e.date - min(a.date) AS INTEGER) AS lead_time_days
FROM daily e LEFT JOIN (SELECT * FROM daily WHERE promo_flag = 1) a ON a.upc = e.upc AND a.cedis = e.cedis AND a.date >= e.date - 7 AND a.date < e.date
WHERE e.outlier_flag = 1 GROUP BY e.upc, e.cedis, e.date""")
register("i1_split_folds", "blind_folds pred", "SELECT fold, origin, role FROM blind_folds WHERE fold IN (SELECT fold FROM pred)")
register("i2_blind_overall", "blind_over", f"SELECT model, n, {rr(*METRIC_COLS, 'coverage_90_raw', 'coverage_80_raw')} FROM blind_over")
register("i2_blind_by_cluster", "blind_cluster", f"SELECT model, cluster, n, {rr(*METRIC_COLS)} FROM blind_cluster")
register("i2_blind_preselection", "preselection", _sel + "preselection")
register("i3_blind_regret", "regret", f"SELECT cluster, pre_registered_model, best_model_in_hindsight, n, choice_held, {rr('blind_wape_pre_registered', 'blind_wape_best', 'regret', 'coverage_90_pre_registered')} FROM regret")
register("i4_weighted_means", "regret", f"SELECT {r4('sum(blind_wape_pre_registered * n) / sum(n)', 'blind_wape')}, {r4('sum(blind_wape_best * n) / sum(n)', 'blind_wape_best')} FROM regret")
_fc = "upc, cedis, h, target_week, origin, model, n_weeks_at_origin, origin_label, cluster, " + rr(*QS)
register("j1_forecast_naive_models", "fc_all", f"SELECT {_fc} FROM fc_all")
for name, label in (("j2_selected_forecast", "final"), ("j3_risk_origin_forecast", "risk_eval")):
    register(name, "fc", f"SELECT {_fc}, is_discontinued, is_high_promo, is_cold_start FROM fc WHERE origin_label = '{label}'")
register("k_lognormal_maths", "fc series", f"""
SELECT upc, cedis, h, {rr('mu', 'sigma', 'stock')}, {r4(p_exceeds('stock'), 'p_exceeds')}, {r4(MEAN, 'mean')}, {r4(f'exp(mu + sigma * {_z(0.95)})', 'q_service')}, {r4(shortfall('stock'), 'shortfall')}
FROM (SELECT f.upc, f.cedis, f.h, {mu('f.q50')} AS mu, {sigma('f.q50', 'f.q90')} AS sigma, coalesce(s.on_hand_as_of, 0.0::DOUBLE) / 10 AS stock
      FROM fc f JOIN series s ON f.upc = s.upc AND f.cedis = s.cedis WHERE f.origin_label = 'final')""")
register("l1_weekday_shares", "shares_eval", f"SELECT upc, cedis, dow, {rr('share')} FROM shares_eval")
register("l2_daily_forecast", "dfc_eval", f"SELECT upc, cedis, date, {rr('d50', 'd90')} FROM dfc_eval")
register("l3_forward_demand", "dfc_eval", f"""
SELECT upc, cedis, date, {rr('d50', 'd90')}, {r4('sum(d50) OVER n', 'fwd50')}, {r4('sum(d90) OVER n', 'fwd90')}
FROM dfc_eval WINDOW n AS (PARTITION BY upc, cedis ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)""")
_score_doubles = ("on_hand", "on_hand_raw", "stockout_store_share", "d50", "d90", "fwd50", "fwd90", "sell_out_pzs", "daily_mean_7d", "cover_days", "p_stockout_7d",
                  "sales_7d", "exp_7d", "on_hand_change_3d", "sales_ratio_1d", "sales_ratio_7d", "log_cover")
register("l4_score_days", "scored_eval", f"SELECT upc, cedis, date, {_inv_cols}, {rr(*_score_doubles)}, cluster, lead_time_days, safety_stock_days, promo_flag, cover_threshold, alert_cover, alert_prob FROM scored_eval")
register("l10_lookahead_labels", "labeled", f"SELECT upc, cedis, date, {rr('stockout_store_share')}, event, label_7d, episode_onset FROM labeled")
register("l12_method_metrics", "by_method", f"SELECT method, {confusion('alert', 'label_7d = 1')}, {r4('median(cover_days) FILTER (alert)', 'median_cover_at_alert')} FROM by_method WHERE label_7d IS NOT NULL GROUP BY method")
register("l13_threshold_sweep", "labeled", " UNION ALL ".join(
    [f"SELECT 'cover' AS method, {r4(d(float(k)), 'threshold')}, {confusion(f'(cover_days < {k})', 'label_7d = 1')} FROM labeled WHERE label_7d IS NOT NULL" for k in (3, 5, 7, 10, 14, 21, 28)]
    + [f"SELECT 'prob' AS method, {r4(d(p), 'threshold')}, {confusion(f'(p_stockout_7d > {d(p)})', 'label_7d = 1')} FROM labeled WHERE label_7d IS NOT NULL" for p in (0.1, 0.2, 0.3, 0.5, 0.7, 0.9)]))


def lead_times_sql(source: str) -> str:
    return f"""
SELECT method, count(*) AS n_onsets, count(lead) AS n_onsets_alerted, {r4('median(lead)', 'median_lead_time_days')}
FROM (SELECT e.method, e.upc, e.cedis, e.date, e.date - min(a.date) AS lead
      FROM (SELECT * FROM {source} WHERE episode_onset) e LEFT JOIN (SELECT * FROM {source} WHERE alert) a
        ON a.method = e.method AND a.upc = e.upc AND a.cedis = e.cedis AND a.date >= e.date - 7 AND a.date < e.date
      GROUP BY e.method, e.upc, e.cedis, e.date) GROUP BY method"""


register("l14_lead_times", "by_method", lead_times_sql("by_method"))
register("l16_alert_list", "alerts", f"""
SELECT upc, cedis, cluster, date, stores_reporting, cover_threshold, alert_cover, alert_prob, severity, {rr('on_hand', 'stockout_store_share', 'daily_mean_7d', 'cover_days', 'p_stockout_7d')},
       {r4('fwd50', 'demand_7d_p50')}, {r4('fwd90', 'demand_7d_p90')} FROM alerts""")
# ------------------------------------------------------------------ isolation forest: whole numbers, level by level
_IF_FEATURES = ("log_cover", "p_stockout_7d", "sales_ratio_1d", "sales_ratio_7d", "on_hand_change_3d", "promo_flag")
_IF_PRIME, _IF_ROWS, _IF_TREES, _IF_SEED = 2147483647, 256, 100, 42


def _hex(text: str, digits: int) -> str:
    """The first hex digits of an MD5 as a number."""
    return f"CAST('0x' || substr(md5({text}), 1, {digits}) AS BIGINT)"


def _path(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1000000 ELSE CAST(round(1000000 * (2.0::DOUBLE * (ln({n} - 1.0::DOUBLE) + {d(0.5772156649015329)}) - 2.0::DOUBLE * ({n} - 1.0::DOUBLE) / {n})) AS BIGINT) END"


def forest(prefix: str, source: str) -> None:
    """CTEs up to ``<prefix>_scores``: (upc, cedis, date, iforest_score) of every row of the source."""
    fs = [f"f{i}" for i in range(len(_IF_FEATURES))]
    values = ", ".join(f"CAST(floor(least(greatest(coalesce(CAST({c} AS DOUBLE), 0.0::DOUBLE), -1e8::DOUBLE), 1e8::DOUBLE) * 10000.0::DOUBLE + 0.5003::DOUBLE) AS BIGINT) AS {f}" for c, f in zip(_IF_FEATURES, fs))
    key = "upc || '|' || cedis || '|' || date"
    cte(f"{prefix}_rows", source, f"SELECT upc, cedis, date, {_hex(key, 12)} % {_IF_PRIME} AS h1, CAST('0x' || substr(md5({key}), 13, 12) AS BIGINT) % {_IF_PRIME} AS h2, {values} FROM {source}")
    part = lambda name: _hex(f"'{_IF_SEED}:' || tree || ':{name}'", 8) + f" % {_IF_PRIME - 1}"
    cte(f"{prefix}_trees", "", f"SELECT tree, {part('a')} + 1 AS a, {part('b')} AS b, {part('c')} + 1 AS c, {part('d')} AS d FROM range({_IF_TREES}) r(tree)")
    cte(f"{prefix}_1", f"{prefix}_rows {prefix}_trees", f"""
SELECT tree, CAST(1 AS BIGINT) AS node, {', '.join(fs)} FROM (
  SELECT tree, {', '.join(fs)}, row_number() OVER (PARTITION BY tree ORDER BY (h1 * a + b) % {_IF_PRIME}, (h2 * c + d) % {_IF_PRIME}, {', '.join(fs)}) AS place
  FROM {prefix}_rows, {prefix}_trees) WHERE place <= {_IF_ROWS}""")
    cte(f"{prefix}_size", f"{prefix}_rows", f"SELECT least(count(*), {_IF_ROWS}) AS n FROM {prefix}_rows")
    pick = "list_extract({}, feature + 1)".format("[" + ", ".join(fs) + "]")
    for level in range(1, 10):
        spans = "[" + ", ".join(f"max({f}) - min({f})" for f in fs) + "]"
        lows = "[" + ", ".join(f"min({f})" for f in fs) + "]"
        cte(f"{prefix}_n{level}", f"{prefix}_{level} {prefix}_size", f"""
SELECT tree, node, feature, CASE WHEN feature >= 0 THEN list_extract(lows, feature + 1) + (list_extract(spans, feature + 1) * {_hex(f"'{_IF_SEED}:' || tree || ':' || node || ':cut'", 5)}) // 1048576 END AS threshold,
       {level - 1} * 1000000 + {_path('n')} AS path
FROM (SELECT *, CASE WHEN len(usable) = 0 OR {level - 1} >= (SELECT length(bin(greatest(n - 1, 1))) FROM {prefix}_size) THEN -1
                     ELSE list_extract(usable, 1 + {_hex(f"'{_IF_SEED}:' || tree || ':' || node || ':feature'", 8)} % len(usable)) END AS feature
      FROM (SELECT tree, node, count(*) AS n, {lows} AS lows, {spans} AS spans, list_filter([{', '.join(str(i) for i in range(len(fs)))}], lambda i: list_extract({spans}, i + 1) > 0) AS usable
            FROM {prefix}_{level} GROUP BY tree, node))""")
        if level < 9:
            cte(f"{prefix}_{level + 1}", f"{prefix}_{level} {prefix}_n{level}", f"""
SELECT tree, 2 * node + CAST({pick} > threshold AS BIGINT) AS node, {', '.join(fs)} FROM {prefix}_{level} JOIN {prefix}_n{level} USING (tree, node) WHERE feature >= 0""")
    cte(f"{prefix}_nodes", " ".join(f"{prefix}_n{i}" for i in range(1, 10)), " UNION ALL ".join(f"SELECT * FROM {prefix}_n{i}" for i in range(1, 10)))
    walk = f"SELECT upc, cedis, date, {', '.join(fs)}, tree, CAST(1 AS BIGINT) AS node FROM {prefix}_rows, {prefix}_trees"
    for _ in range(8):
        walk = f"SELECT upc, cedis, date, {', '.join(fs)}, w.tree, CASE WHEN feature >= 0 THEN 2 * w.node + CAST({pick} > threshold AS BIGINT) ELSE w.node END AS node FROM ({walk}) w JOIN {prefix}_nodes n ON n.tree = w.tree AND n.node = w.node"
    cte(f"{prefix}_scores", f"{prefix}_rows {prefix}_trees {prefix}_nodes {prefix}_size", f"""
SELECT upc, cedis, date, pow(2.0::DOUBLE, -CAST(sum(path) AS DOUBLE) / CAST({_IF_TREES} * (SELECT greatest({_path('n')}, 1) FROM {prefix}_size) AS DOUBLE)) AS iforest_score
FROM ({walk}) w JOIN {prefix}_nodes n ON n.tree = w.tree AND n.node = w.node GROUP BY upc, cedis, date""")
    cte(f"{prefix}_scored", f"{source} {prefix}_scores", f"""
SELECT s.*, i.iforest_score, coalesce(i.iforest_score > (SELECT quantile_cont(iforest_score, {d(1 - 0.05)}) FROM {prefix}_scores), false) AS alert_iforest
FROM {source} s JOIN {prefix}_scores i USING (upc, cedis, date)""")


forest("win", "labeled")
forest("asof", "scored_asof")
register("l8_isolation_forest", "win_scored", f"SELECT upc, cedis, date, promo_flag, {rr(*_IF_FEATURES[:5])}, {rr('iforest_score')}, alert_iforest FROM win_scored")
cte("by_three", "win_scored", """
SELECT upc, cedis, date, cover_days, label_7d, episode_onset, method, CASE method WHEN 'cover' THEN alert_cover WHEN 'prob' THEN alert_prob ELSE alert_iforest END AS alert
FROM win_scored CROSS JOIN (SELECT unnest(['cover', 'prob', 'iforest']) AS method)""")
register("l12_three_methods", "by_three", f"SELECT method, {confusion('alert', 'label_7d = 1')}, {r4('median(cover_days) FILTER (alert)', 'median_cover_at_alert')} FROM by_three WHERE label_7d IS NOT NULL GROUP BY method")
register("l14_three_methods", "by_three", lead_times_sql("by_three"))
register("l16_three_methods", "asof_scored", f"""
SELECT upc, cedis, cluster, date, stores_reporting, cover_threshold, alert_cover, alert_prob, alert_iforest, {rr('iforest_score')},
       CASE WHEN p_stockout_7d > 0.75 OR cover_days < lead_time_days THEN 'high' WHEN alert_cover OR alert_prob OR alert_iforest THEN 'medium' ELSE 'none' END AS severity,
       {rr('on_hand', 'stockout_store_share', 'daily_mean_7d', 'cover_days', 'p_stockout_7d')}, {r4('fwd50', 'demand_7d_p50')}, {r4('fwd90', 'demand_7d_p90')}
FROM asof_scored WHERE date = DATE '2001-11-01'""")
register("o3_three_methods", "win_scored", f"""
SELECT upc, cedis, count(*) FILTER (event) AS events, count(*) FILTER (alert_cover OR alert_prob OR alert_iforest) AS alerts, {r4('median(cover_days)', 'cover')} FROM win_scored GROUP BY upc, cedis""")
register("m1_moq_rounding", "weekly", f"""
SELECT upc, cedis, week_start, {r4('y - 100', 'qty')}, moq, {r4('CASE WHEN y - 100 <= 0 THEN 0.0::DOUBLE ELSE ceil((y - 100) / moq) * moq END', 'order_qty')} FROM weekly WHERE y IS NOT NULL""")
register("m2_protection_demand", "protect", f"SELECT upc, cedis, {rr(*QS)}, weeks_available FROM protect")
register("m3_naive_demands", "naive_dem", f"SELECT upc, cedis, {rr('ma4_weekly', 'ma4_demand', 'ly_demand')} FROM naive_dem")
register("m4_unit_prices", "prices", f"SELECT upc, cedis, {rr('unit_price')} FROM prices")
register("m5_projected_stock", "projected", f"SELECT upc, cedis, no_inventory_snapshot, {rr('on_hand_as_of', 'sales_after_snapshot', 'on_hand_projected')} FROM projected")
_order_doubles = (
    "on_hand_as_of", "sales_after_snapshot", "on_hand_projected", "demand_p50", "demand_p90", "demand_mean", "service_level_target", "safety_stock_policy", "safety_stock_quantile", "safety_stock",
    "order_up_to", "order_qty", "implied_service_level", "expected_fill_rate", "expected_lost_sales", "days_of_cover_after_order", "unit_value", "working_capital", "stock_value_after_order",
    "ma4_order_qty", "ma4_service_level", "ma4_expected_lost_sales", "ma4_working_capital", "ly_order_qty", "ly_service_level", "ly_working_capital", "delta_working_capital_vs_ma4",
    "delta_service_level_vs_ma4", "delta_lost_sales_vs_ma4", "fq_order_up_to", "fq_order_qty", "fq_service_level", "fq_expected_lost_sales", "fq_working_capital", "target_stock_value", "fq_target_stock_value")
register("m14_order_file", "orders_", f"SELECT upc, cedis, cluster, model, origin, protection_period_days, safety_stock_binding, moq, flags, {rr(*_order_doubles)} FROM orders_")
_summary_doubles = [*TOTALS, *[f"{p}service_level_weighted" for p in _SL], *[f"{p}fill_rate" for p in _SL], "delta_working_capital_vs_ma4", "lost_units_reduction_vs_ma4", "target_stock_value_freed_by_fq"]
register("m15_order_summary", "summary", f"SELECT level, name, n_series, lines_below_90, ma4_lines_below_90, fq_lines_below_90, {rr(*_summary_doubles)} FROM summary")

# ------------------------------------------------------------------ quality gates
def gate(area: str, name: str, value: str, op: str, threshold, severity: str, note: str = "''") -> str:
    """One row; a string threshold is an SQL expression, a tuple a range."""
    if isinstance(threshold, tuple):
        lo, hi, text = d(threshold[0]), d(threshold[1]), f"'[{threshold[0]}, {threshold[1]}]'"
    elif isinstance(threshold, str):
        lo = hi = f"CAST({threshold} AS DOUBLE)"
        text = f"CAST(CAST({threshold} AS DOUBLE) AS VARCHAR)"
    else:
        lo = hi = d(float(threshold))
        text = f"'{threshold}'"
    ok = {"<=": f"v <= {hi}", ">=": f"v >= {lo}", "==": f"abs(v - {lo}) < {d(1e-9)}", "in": f"v BETWEEN {lo} AND {hi}"}[op]
    failed = "FAIL" if severity == "hard" else "warn"
    return (f"SELECT '{area}' AS area, '{name}' AS gate, {r4('v', 'value')}, '{op}' AS op, {text} AS threshold, '{severity}' AS severity, {note} AS note, "
            f"CASE WHEN coalesce({ok}, false) THEN 'pass' ELSE '{failed}' END AS status FROM (SELECT CAST(({value}) AS DOUBLE) AS v)")


def _wm(col: str, source: str) -> str:
    return f"SELECT sum({col} * n) / nullif(sum(n), 0) FROM {source}"


cte("sel_metrics", "m_cluster selection", "SELECT m.* FROM m_cluster m JOIN selection s ON m.cluster = s.cluster AND m.model = s.selected_model")
cte("sel_hold", "hold_cal selection", "SELECT m.* FROM hold_cal m JOIN selection s ON m.cluster = s.cluster AND m.model = s.selected_model")
cte("full_weeks", "weekly daily", """
SELECT w.y, d.units FROM weekly w JOIN (SELECT upc, cedis, week_start, sum(sell_out_pzs) AS units, count(sell_out_pzs) AS n FROM daily GROUP BY ALL) d
  ON w.upc = d.upc AND w.cedis = d.cedis AND w.week_start = d.week_start WHERE d.n = 7""")
cte("fcf", "fc", "SELECT * FROM fc WHERE origin_label = 'final'")
cte("fcs", "fcf", "SELECT upc, cedis, count(DISTINCT h) AS n_h, count(DISTINCT model) AS n_m FROM fcf GROUP BY upc, cedis")
cte("naive_w", "m_cluster", "SELECT min(w) AS w FROM (SELECT model, sum(wape * n) / sum(n) AS w FROM m_cluster WHERE model IN ('ma4', 'seasonal_naive') GROUP BY model)")
cte("rule_methods", "by_method", f"SELECT method, {confusion('alert', 'label_7d = 1')} FROM by_method WHERE label_7d IS NOT NULL GROUP BY method")


def dup(source: str, key: str) -> str:
    return f"SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM {source} GROUP BY {key})"


def share(cond: str, source: str) -> str:
    return f"SELECT avg(CAST(coalesce({cond}, false) AS INTEGER)) FROM {source}"


GATES = {
    "n1_data_gates": ("weekly full_weeks series", [
        gate("data", "weekly_duplicate_keys", dup("weekly", "upc, cedis, week_start"), "==", 0, "hard"),
        gate("data", "weekly_reconciles_to_daily_max_rel_diff", f"SELECT max(abs(y - units) / greatest(units, {d(1e-9)})) FROM full_weeks", "<=", 1e-06, "hard",
             "(SELECT count(*) FROM full_weeks) || ' fully observed weeks compared'"),
        gate("data", "weekly_y_missing_share", share("y IS NULL", "weekly"), "<=", 0.02, "soft"),
        gate("data", "series_with_inventory_share", share("has_inventory", "series"), ">=", 0.95, "soft"),
        gate("data", "n_series", "SELECT count(*) FROM series", ">=", 1, "hard")]),
    "n6_forecast_gates": ("fcf fcs series sel_metrics sel_hold naive_w m_cluster calib selection", [
        gate("forecast", "quantiles_monotone_share", share(" AND ".join(f"{b} - {a} >= {d(-1e-9)}" for a, b in zip(QS, QS[1:])), "fcf"), "==", 1.0, "hard"),
        gate("forecast", "quantiles_non_negative_share", "SELECT avg(CAST(q >= 0 AS INTEGER)) FROM (SELECT unnest([" + ", ".join(QS) + "]) AS q FROM fcf)", "==", 1.0, "hard"),
        gate("forecast", "quantiles_finite_share", "SELECT avg(CAST(isfinite(q) AS INTEGER)) FROM (SELECT unnest([" + ", ".join(QS) + "]) AS q FROM fcf)", "==", 1.0, "hard"),
        gate("forecast", "series_with_full_horizon_share", share("n_h = 8", "fcs"), "==", 1.0, "hard"),
        gate("forecast", "series_covered", "SELECT count(*) FROM fcs", "==", "(SELECT count(*) FROM series)", "hard", "'no series left without a forecast'"),
        gate("forecast", "one_model_per_series_share", share("n_m = 1", "fcs"), "==", 1.0, "hard"),
        gate("forecast", "selected_wape_overall", _wm("wape", "sel_metrics"), "<=", 0.25, "hard"),
        gate("forecast", "rel_improvement_vs_best_naive", f"1 - ({_wm('wape', 'sel_metrics')}) / (SELECT w FROM naive_w)", ">=", 0.05, "soft",
             "coalesce(printf('best naive WAPE %.3f', (SELECT w FROM naive_w)), 'no naive baseline')"),
        gate("forecast", "selected_abs_bias", f"abs(({_wm('bias', 'sel_metrics')}))", "<=", 0.1, "soft"),
        gate("forecast", "holdout_coverage_90_calibrated", _wm("coverage_90", "sel_hold"), "in", (0.85, 0.97), "hard"),
        gate("forecast", "holdout_coverage_80_calibrated", _wm("coverage_80", "sel_hold"), "in", (0.72, 0.93), "soft"),
        gate("forecast", "calibration_table_complete", "SELECT count(*) FROM calib", "==", "(SELECT 2 * count(DISTINCT model) * count(DISTINCT cluster) FROM m_cluster)", "hard", "'each model and cluster needs both intervals'"),
        gate("forecast", "selection_covers_all_clusters", "SELECT count(DISTINCT cluster) FROM selection", "==", "(SELECT count(DISTINCT cluster) FROM m_cluster)", "hard")]),
    "n19_blind_gates": ("regret blind_over", [
        gate("blind", "blind_wape_pre_registered", _wm("blind_wape_pre_registered", "regret"), "<=", 0.25, "hard", "'last fold kept out of the choice of models'"),
        gate("blind", "blind_selection_regret", f"({_wm('blind_wape_pre_registered', 'regret')}) - ({_wm('blind_wape_best', 'regret')})", "<=", 0.05, "soft", "'cost of choosing before the fold was seen'"),
        gate("blind", "blind_beats_best_naive", f"(SELECT min(wape) FROM blind_over WHERE model IN ('ma4', 'seasonal_naive')) - ({_wm('blind_wape_pre_registered', 'regret')})", ">=", 0.0, "soft")]),
    "n22_risk_gates": ("rule_methods alerts series", [
        gate("risk", "best_method_recall", "SELECT max(recall) FROM rule_methods", ">=", 0.5, "soft"),
        gate("risk", "prob_method_false_alarm_rate", "SELECT false_alarm_rate FROM rule_methods WHERE method = 'prob'", "<=", 0.15, "soft"),
        gate("risk", "methods_evaluated", "SELECT count(*) FROM rule_methods", "==", 3.0, "hard"),
        gate("risk", "alert_rows_vs_series_with_inventory", "SELECT count(*) FROM alerts", "==", "(SELECT count(*) FILTER (has_inventory) FROM series)", "hard"),
        gate("risk", "severity_values_valid_share", share("severity IN ('none', 'medium', 'high')", "alerts"), "==", 1.0, "hard"),
        gate("risk", "p_stockout_in_unit_interval_share", share("p_stockout_7d BETWEEN 0 AND 1", "alerts"), "==", 1.0, "hard"),
        gate("risk", "high_severity_implies_prob_or_cover", f"SELECT coalesce(({share('p_stockout_7d > 0.75 OR cover_days < lead_time_days', '(SELECT * FROM alerts WHERE severity = $$high$$)')}), 1.0)", "==", 1.0, "hard")]),
    "n29_orders_gates": ("orders_ series summary", [
        gate("orders", "one_line_per_series", "SELECT count(*) FROM orders_", "==", "(SELECT count(*) FROM series)", "hard"),
        gate("orders", "duplicate_lines", dup("orders_", "upc, cedis"), "==", 0, "hard"),
        gate("orders", "key_columns_nan_count", "SELECT " + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in
             ("order_qty", "implied_service_level", "working_capital", "demand_p50", "on_hand_projected", "unit_value")) + " FROM orders_", "==", 0, "hard"),
        gate("orders", "order_qty_non_negative_share", share("order_qty >= 0", "orders_"), "==", 1.0, "hard"),
        gate("orders", "order_qty_moq_multiple_share", share(f"abs(order_qty % moq) < {d(1e-6)} OR order_qty = 0", "orders_"), "==", 1.0, "hard"),
        gate("orders", "discontinued_orders_zero_share", "SELECT coalesce(avg(CAST(order_qty = 0 AS INTEGER)) FILTER (contains(flags, 'discontinued')), 1.0) FROM orders_", "==", 1.0, "hard"),
        gate("orders", "working_capital_consistent_share", share(f"abs(working_capital - order_qty * unit_value) <= {d(1e-3)} * greatest(abs(working_capital), 1)", "orders_"), "==", 1.0, "hard"),
        gate("orders", "service_level_in_unit_interval_share", share("implied_service_level BETWEEN 0 AND 1", "orders_"), "==", 1.0, "hard"),
        gate("orders", "unflagged_lines_at_target_service_level_share",
             f"SELECT coalesce(avg(CAST(implied_service_level >= service_level_target - {d(1e-6)} AS INTEGER)) FILTER (flags = ''), 1.0) FROM orders_", ">=", 0.9, "soft",
             "(SELECT count(*) FILTER (flags = '') FROM orders_) || ' unflagged lines'"),
        gate("orders", "portfolio_service_level_vs_ma4", "SELECT service_level_weighted - ma4_service_level_weighted FROM summary WHERE level = 'portfolio'", ">=", -1e-09, "soft"),
        gate("orders", "lines_below_90_vs_ma4", "SELECT ma4_lines_below_90 - lines_below_90 FROM summary WHERE level = 'portfolio'", ">=", 0, "soft", "'lines at risk, moving average minus model'")]),
}
for name, (needs, gates) in GATES.items():
    register(name, needs, " UNION ALL ".join(gates))
_all_needs = " ".join(dict.fromkeys(n for needs, _ in GATES.values() for n in needs.split()))
_all_gates = " UNION ALL ".join(g for _, gates in GATES.values() for g in gates)
register("n40_scorecard", _all_needs, _all_gates)
register("n40_scorecard_counts", _all_needs, f"SELECT status, count(*) AS n_gates FROM ({_all_gates}) GROUP BY status")

# ------------------------------------------------------------------ reporting
cte("activity", "labeled", """
SELECT upc, cedis, count(*) FILTER (event) AS events, count(*) FILTER (alert_cover OR alert_prob) AS alerts, median(cover_days) AS cover FROM labeled GROUP BY upc, cedis""")
cte("rel_resid", "pred selection", "SELECT p.cluster, (q50 - y) / y AS rel FROM pred p JOIN selection s ON p.cluster = s.cluster AND p.model = s.selected_model WHERE y > 0")
cte("rel_days", "daily", "SELECT *, sell_out_pzs / nullif(avg(sell_out_pzs) OVER (PARTITION BY upc, cedis), 0) AS rel FROM daily WHERE sell_out_pzs IS NOT NULL")
register("o1_accuracy_pivot", "m_cluster", f"SELECT cluster, {r4('max(wape) FILTER (model = $$ma4$$)', 'ma4')}, {r4('max(wape) FILTER (model = $$seasonal_naive$$)', 'seasonal_naive')} FROM m_cluster GROUP BY cluster")
register("o2_calibration_pivot", "calib", f"SELECT model, cluster, {r4('max(k) FILTER (lo = $$q10$$)', 'k_80')}, {r4('max(k) FILTER (lo = $$q05$$)', 'k_90')} FROM calib GROUP BY model, cluster")
register("o3_silent_stockouts", "activity", f"SELECT upc, cedis, events, alerts, {rr('cover')} FROM activity WHERE events > 0 AND alerts = 0")
register("o3_alert_activity", "activity", f"SELECT upc, cedis, events, alerts, {rr('cover')} FROM activity")
register("o4_value_counts", "series alerts orders_", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM {t} GROUP BY {c}" for t, c in (("series", "cluster"), ("alerts", "severity"), ("orders_", "flags"), ("orders_", "safety_stock_binding"))))
register("o5_days_on_hand", "orders_", f"""
SELECT {r4('sum(on_hand_projected) / nullif(sum(demand_p50), 0) * 14', 'days_on_hand')}, count(*) FILTER (safety_stock_binding = 'policy_days') AS lines_bound_by_policy,
       count(*) FILTER (flags <> '') AS flagged_lines, count(*) AS lines FROM orders_""")
register("o6_wape_by_horizon", "m_cluster_h", f"SELECT model, h, {r4('sum(wape * n) / sum(n)', 'wape')} FROM m_cluster_h GROUP BY model, h")
register("o7_coverage_by_model", "hold_cal hold_raw", " UNION ALL ".join(
    f"SELECT '{q}' AS quantiles, model, {r4('sum(coverage_90 * n) / sum(n)', 'coverage_90')}, {r4('sum(coverage_80 * n) / sum(n)', 'coverage_80')} FROM {t} GROUP BY model" for q, t in (("calibrated", "hold_cal"), ("raw", "hold_raw"))))
cte("last_sel", "pred selection", "SELECT p.* FROM pred p JOIN selection s ON p.cluster = s.cluster AND p.model = s.selected_model WHERE p.fold = 7")
register("o8_cluster_forecast_vs_actual", "last_sel weekly", f"""
SELECT cluster, target_week AS week_start, {r4('sum(y)', 'y')}, {r4('sum(q10)', 'q10')}, {r4('sum(q50)', 'q50')}, {r4('sum(q90)', 'q90')} FROM last_sel GROUP BY cluster, target_week
UNION ALL SELECT cluster, week_start, {r4('sum(y)', 'y')}, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
FROM weekly WHERE (upc, cedis) IN (SELECT (upc, cedis) FROM last_sel) AND week_start > DATE '2001-09-03' - 182 AND week_start <= DATE '2001-09-03' GROUP BY cluster, week_start""")
register("o9_residual_quantiles", "rel_resid", f"SELECT cluster, {r4('quantile_cont(rel, 0.1)', 'p10')}, {r4('median(rel)', 'median')}, {r4('quantile_cont(rel, 0.9)', 'p90')} FROM rel_resid GROUP BY cluster")
register("o9_residual_histogram", "rel_resid", "SELECT CAST(least(floor((least(greatest(rel, -1.0::DOUBLE), 1.0::DOUBLE) + 1.0::DOUBLE) * 25.0::DOUBLE), 49) AS INTEGER) AS bin, count(*) AS n FROM rel_resid GROUP BY 1")
register("o10_cover_by_label", "labeled", "SELECT label_7d, " + ", ".join(
    r4(f"quantile_cont(least(cover_days, 120.0::DOUBLE), {q})", n) for n, q in (("lowest", 0), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("highest", 1))) + " FROM labeled WHERE label_7d IS NOT NULL GROUP BY label_7d")
register("o11_timeline_ranking", "activity", """
SELECT upc, cedis, events, alerts FROM activity WHERE events > 0
UNION ALL SELECT upc, cedis, events, alerts FROM (SELECT *, row_number() OVER (ORDER BY alerts DESC, upc, cedis) AS rk FROM activity WHERE events = 0)
WHERE rk <= 30 - (SELECT count(*) FROM activity WHERE events > 0)""")
register("o12_representative_series", "series weekly", f"""
SELECT s.segment, w.upc, w.cedis, w.week_start, {r4('w.y', 'y')}, {r4('w.promo_share', 'promo_share')}
FROM weekly w JOIN (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY mean_weekly DESC, upc, cedis DESC) AS rk
  FROM (SELECT *, unnest(list_filter([CASE WHEN cluster IN ('A-X', 'A-Z', 'B-Z') THEN cluster END, CASE WHEN is_discontinued THEN 'discontinued' END], lambda x: x IS NOT NULL)) AS segment
        FROM series WHERE mean_weekly IS NOT NULL)) s ON s.rk = 1 AND s.upc = w.upc AND s.cedis = w.cedis
WHERE w.week_start > DATE '2001-10-29' - 364""")
_null_q = ", ".join(f"CAST(NULL AS DOUBLE) AS {q}" for q in QS)
register("o13_portfolio_outlook", "weekly fcf", f"""
SELECT week_start, {r4('sum(y)', 'y')}, {_null_q} FROM weekly WHERE week_start > (SELECT max(week_start) - 364 FROM weekly) GROUP BY week_start
UNION ALL SELECT target_week, CAST(NULL AS DOUBLE), {', '.join(r4(f'sum({q})', q) for q in QS)} FROM fcf GROUP BY target_week""")
register("o14_cluster_weeks", "weekly", f"SELECT cluster, week_start, {r4('sum(y)', 'y')}, count(DISTINCT (upc, cedis)) AS n_series FROM weekly GROUP BY cluster, week_start")
cte("lift", "daily", """
SELECT *, promo / nullif(base, 0) AS lift FROM (SELECT upc, cedis, avg(sell_out_pzs) FILTER (promo_flag = 0) AS base, avg(sell_out_pzs) FILTER (promo_flag = 1) AS promo
FROM daily WHERE sell_out_pzs IS NOT NULL GROUP BY upc, cedis) WHERE base IS NOT NULL AND promo IS NOT NULL""")
register("o15_promo_lift", "lift", f"SELECT upc, cedis, {rr('base', 'promo', 'lift')} FROM lift")
register("o15_promo_summary", "lift daily", f"SELECT {r4('median(lift)', 'median_lift')}, {r4('(SELECT avg(promo_flag) FROM daily WHERE sell_out_pzs IS NOT NULL)', 'promo_share')} FROM lift")
register("o16_weekday_index", "rel_days", f"SELECT CAST(isodow(date) - 1 AS INTEGER) AS dow, {r4('avg(rel)', 'index')} FROM rel_days GROUP BY 1")
register("o17_calendar_effects", "rel_days", " UNION ALL ".join(
    f"SELECT '{f}' AS flag, {f} AS value, {r4('avg(rel)', 'index')}, count(*) AS n FROM rel_days GROUP BY {f}" for f in ("is_payday_window", "is_holiday", "is_semana_santa", "is_buen_fin", "is_december_peak")))


def described(source: str, column: str, percentiles: dict[str, float]) -> str:
    qs = ", ".join(r4(f"quantile_cont(v, {q})", n) for n, q in percentiles.items())
    return (f"SELECT '{column}' AS \"column\", count(v) AS count, {r4('avg(v)', 'mean')}, {r4('stddev_samp(v)', 'std')}, {r4('min(v)', 'min')}, {r4('max(v)', 'max')}, {qs} "
            f"FROM (SELECT CAST({column} AS DOUBLE) AS v FROM {source})")


register("o18_describe_series", "series", " UNION ALL ".join(described("series", c, {"q25": 0.25, "q50": 0.5, "q75": 0.75}) for c in ("n_weeks", "mean_weekly", "on_hand_as_of")))
register("o18_describe_shortage", "inv", described("inv", "stockout_store_share", {"q50": 0.5, "q90": 0.9, "q95": 0.95, "q99": 0.99}))
register("o19_short_series", "inv", "SELECT count(DISTINCT (upc, cedis)) AS n_series FROM inv WHERE stockout_store_share >= 0.25")
register("o19_discontinued", "series", f"SELECT upc, cedis, cluster, {rr('mean_weekly', 'tail4_mean')} FROM series WHERE is_discontinued")
register("o20_top_orders", "orders_", f"""
SELECT upc, cedis, cluster, {rr('on_hand_projected', 'demand_p50', 'demand_p90', 'safety_stock', 'order_qty', 'implied_service_level', 'working_capital', 'ma4_order_qty')}, flags
FROM (SELECT * FROM orders_ ORDER BY working_capital DESC, upc, cedis LIMIT 10)""")
register("o20_high_alerts", "alerts", f"SELECT upc, cedis, cluster, {rr('cover_days', 'p_stockout_7d')} FROM (SELECT * FROM alerts WHERE severity = 'high' ORDER BY p_stockout_7d DESC, upc, cedis LIMIT 15)")
register("o21_error_reduction", "m_overall", f"SELECT model, {r4('1 - wape / (SELECT wape FROM m_overall WHERE model = $$ma4$$)', 'reduction_vs_ma4')} FROM m_overall")
register("o22_selected_metrics", "sel_metrics", f"SELECT cluster, model, n, {rr(*METRIC_COLS)} FROM sel_metrics")
register("o23_best_naive", "m_overall", f"SELECT model, {rr('wape')} FROM (SELECT * FROM m_overall WHERE model IN ('ma4', 'seasonal_naive') AND wape IS NOT NULL ORDER BY wape, model LIMIT 1)")
register("o24_series_with_events", "labeled", "SELECT count(DISTINCT (upc, cedis)) AS n_series FROM labeled WHERE event")


# ------------------------------------------------------------------ the same with the smoothing model among the choices
def _renamed(text: str, suffix: str, family: set[str]) -> str:
    """``text`` reading the derived relations: only names after FROM or JOIN change, columns don't."""
    return re.sub(r"\b(FROM|JOIN)(\s+)(\w+)\b", lambda m: f"{m[1]}{m[2]}{m[3]}{suffix}" if m[3] in family else m[0], text)


def _family(roots: set[str]) -> list[str]:
    """The CTEs that depend on the roots, in order of definition; the roots themselves aren't among them."""
    found: set[str] = set(roots)
    out = []
    for name, (needs, _) in list(CTES.items()):
        if name not in roots and found & set(needs):
            found.add(name)
            out.append(name)
    return out


def derive(suffix: str, roots: set[str], only: set[str] | None = None) -> set[str]:
    """Copies of the CTEs below the roots that read ``<name><suffix>`` instead; the roots' own copies must exist."""
    names = [n for n in _family(roots) if only is None or n in only]
    family = set(names) | roots
    for n in names:
        needs, body = CTES[n]
        cte(n + suffix, " ".join(x + suffix if x in family else x for x in needs), _renamed(body, suffix, family))
    return family


_below_folds = {"filled", "ets", *[n for n in CTES if n.startswith("ets_")]}
cte("folds_final", "final_folds", "SELECT * FROM final_folds")
derive("_final", {"folds"}, _below_folds)
cte("pred_3", "pred ets eligible weekly", """
SELECT * FROM pred UNION ALL
SELECT p.*, w.y, w.cluster FROM ets p SEMI JOIN eligible e ON p.fold = e.fold AND p.upc = e.upc AND p.cedis = e.cedis
LEFT JOIN weekly w ON p.upc = w.upc AND p.cedis = w.cedis AND p.target_week = w.week_start""")
cte("fc_raw_3", "fc_raw ets_final eligible_final series", """
SELECT * FROM fc_raw UNION ALL
SELECT p.* EXCLUDE (fold), e.n_weeks_at_origin, CASE p.fold WHEN 0 THEN 'final' ELSE 'risk_eval' END AS origin_label, s.cluster
FROM ets_final p LEFT JOIN eligible_final e ON p.fold = e.fold AND p.upc = e.upc AND p.cedis = e.cedis LEFT JOIN series s ON p.upc = s.upc AND p.cedis = s.cedis""")
_three = derive("_3", {"pred", "fc_raw"})
#: Queries that are registered once more with three models.
THREE_MODELS = (
    "g3_backtest_predictions", "g5_interval_calibration", "g6_apply_calibration", "g7_metrics_cluster", "g7_metrics_overall", "g8_model_selection", "g9_holdout_report",
    "i2_blind_overall", "i3_blind_regret", "i4_weighted_means", "j1_forecast_naive_models", "j2_selected_forecast", "k_lognormal_maths", "l12_three_methods", "l16_three_methods",
    "m14_order_file", "m15_order_summary", "n40_scorecard",
)
for _name in THREE_MODELS:
    _needs, _select = REGISTERED[_name]
    register(f"{_name.removesuffix('_naive_models')}_three_models", " ".join(x + "_3" if x in _three else x for x in _needs.split()), _renamed(_select, "_3", _three))

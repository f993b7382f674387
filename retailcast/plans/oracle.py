"""DuckDB SQL that recomputes each query from the raw driver tables.

The stand-in inputs are rebuilt with the same mappings as
``retailcast.sources.standins``; every query body below is an independent
SQL formulation of the Spark plan, used as the correctness oracle.
"""

from __future__ import annotations

# ---------------------------------------------------------------- stand-in CTEs
CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    CTE[name] = (deps, sql)


cte("fact", """
SELECT ((CAST(date - DATE '1970-01-01' AS BIGINT) * 2147483648 + store_nbr) * 128
        + ascii(family)) AS id, date, store_nbr, family, sales, onpromotion
FROM (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS store_nbr, l_returnflag AS family,
             SUM(l_extendedprice * (1 - l_discount)) AS sales,
             COUNT(CASE WHEN l_discount >= 0.05 THEN 1 END) AS onpromotion
      FROM lineitem GROUP BY 1, 2, 3) g""")
cte("train", "SELECT * FROM fact WHERE date < DATE '2001-07-01'", ("fact",))
cte("test", "SELECT id, date, store_nbr, family, onpromotion FROM fact "
            "WHERE date >= DATE '2001-07-01'", ("fact",))
cte("stores", """
SELECT s_suppkey AS store_nbr, n_name AS city, r_name AS state,
       CASE WHEN s_acctbal >= 7500 THEN 'A' WHEN s_acctbal >= 5000 THEN 'B'
            WHEN s_acctbal >= 2500 THEN 'C' WHEN s_acctbal >= 0 THEN 'D' ELSE 'E' END AS type,
       s_suppkey % 17 AS cluster
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""")
cte("oil", """
SELECT CAST(o_orderdate AS DATE) AS date, AVG(o_totalprice) AS dcoilwtico FROM orders
WHERE isodow(CAST(o_orderdate AS DATE)) <= 5 AND CAST(o_orderdate AS DATE) >= DATE '1995-01-10'
GROUP BY 1""")
cte("hol_raw", """
SELECT CAST(o_orderdate AS DATE) AS date,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'Holiday'
            WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'Transfer'
            WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN 'Event'
            WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F' THEN 'Bridge'
            ELSE 'Work Day' END AS type,
       CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'National'
            WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'Regional'
            ELSE 'Local' END AS locale,
       c_mktsegment, n_name, r_name, c_acctbal
FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
cte("holidays", """
SELECT date, type, locale, locale_name,
       CASE WHEN type = 'Event' THEN
                 CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Terremoto Manabi'
                      WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Mundial de futbol Brasil'
                      ELSE 'Dia de la Madre' END
            WHEN type = 'Bridge' THEN 'Puente ' || n_name
            ELSE 'Fiesta ' || locale_name END AS description,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal > 9000 END AS transferred
FROM (SELECT *, CASE WHEN locale = 'National' THEN 'Ecuador' WHEN locale = 'Regional'
                     THEN r_name ELSE n_name END AS locale_name FROM hol_raw) h""", ("hol_raw",))
# calendar split
cte("hol_kept", """
SELECT date, CASE WHEN type = 'Transfer' THEN 'Holiday' ELSE type END AS type, locale,
       locale_name, description
FROM holidays WHERE NOT coalesce(transferred, false)""", ("holidays",))
cte("c_bridge", "SELECT DISTINCT date, true AS bridge FROM hol_kept WHERE type = 'Bridge'",
    ("hol_kept",))
cte("c_quake", """
SELECT date, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS time_since_quake
FROM (SELECT DISTINCT date FROM hol_kept
      WHERE type = 'Event' AND instr(description, 'Terremoto Manabi') > 0) q""", ("hol_kept",))
cte("c_event", """
SELECT date, CASE WHEN instr(description, 'futbol') > 0 THEN 'Sports' ELSE description END
       AS description
FROM hol_kept WHERE type = 'Event' AND instr(description, 'Terremoto Manabi') = 0""",
    ("hol_kept",))
cte("c_national", "SELECT date, description FROM hol_kept "
                  "WHERE type = 'Holiday' AND locale = 'National'", ("hol_kept",))
cte("c_local", "SELECT date, locale_name, description FROM hol_kept "
               "WHERE type = 'Holiday' AND locale = 'Local'", ("hol_kept",))
cte("c_regional", "SELECT date, locale_name, description FROM hol_kept "
                  "WHERE type = 'Holiday' AND locale = 'Regional'", ("hol_kept",))
cte("cal_date", """
SELECT coalesce(n.date, b.date, e.date, q.date) AS date, n._nat, b.bridge, e._event,
       q.time_since_quake
FROM (SELECT date, array_to_string(list_sort(list_distinct(list(description))), '|') AS _nat
      FROM c_national GROUP BY date) n
FULL JOIN c_bridge b ON n.date = b.date
FULL JOIN (SELECT date, array_to_string(list_sort(list_distinct(list(description))), '|')
                  AS _event FROM c_event GROUP BY date) e ON coalesce(n.date, b.date) = e.date
FULL JOIN c_quake q ON coalesce(n.date, b.date, e.date) = q.date""",
    ("c_national", "c_bridge", "c_event", "c_quake"))
cte("cal_loc", """
SELECT date, locale_name AS city,
       array_to_string(list_sort(list_distinct(list(description))), '|') AS _loc
FROM c_local GROUP BY 1, 2""", ("c_local",))
cte("cal_reg", """
SELECT date, locale_name AS state,
       array_to_string(list_sort(list_distinct(list(description))), '|') AS _reg
FROM c_regional GROUP BY 1, 2""", ("c_regional",))
# panel with stores and promotion totals (train and test together)
cte("upanel", """
SELECT id, date, store_nbr, family, sales, onpromotion, false AS is_test FROM train
UNION ALL
SELECT id, date, store_nbr, family, NULL AS sales, onpromotion, true AS is_test FROM test""",
    ("train", "test"))
cte("spanel", """
SELECT p.*, s.city, s.state, s.type FROM upanel p LEFT JOIN stores s USING (store_nbr)""",
    ("upanel", "stores"))
cte("ppanel", """
SELECT p.*, t1.total_other_promo_store, t2.total_other_city_promo
FROM spanel p
LEFT JOIN (SELECT date, store_nbr, SUM(onpromotion) AS total_other_promo_store
           FROM spanel GROUP BY 1, 2) t1 ON p.date = t1.date AND p.store_nbr = t1.store_nbr
LEFT JOIN (SELECT date, city, family, SUM(onpromotion) AS total_other_city_promo
           FROM spanel GROUP BY 1, 2, 3) t2
       ON p.date = t2.date AND p.city = t2.city AND p.family = t2.family""", ("spanel",))
cte("calpanel", """
SELECT p.*,
       (c._nat IS NOT NULL OR l._loc IS NOT NULL OR r._reg IS NOT NULL) AS holiday,
       coalesce(c._nat, '') || coalesce(l._loc, '') || coalesce(r._reg, '')
           AS holiday_description,
       coalesce(c._event, 'none') AS event,
       CAST(coalesce(c.time_since_quake, 0) AS INTEGER) AS time_since_quake,
       CAST(coalesce(c.time_since_quake, 0) * coalesce(c.time_since_quake, 0) AS INTEGER)
           AS time_since_quake_sq,
       (c.bridge IS NULL AND NOT (c._nat IS NOT NULL OR l._loc IS NOT NULL OR r._reg IS NOT NULL)
        AND isodow(p.date) NOT IN (6, 7)) AS workday
FROM ppanel p
LEFT JOIN cal_date c ON p.date = c.date
LEFT JOIN cal_loc l ON p.date = l.date AND p.city = l.city
LEFT JOIN cal_reg r ON p.date = r.date AND p.state = r.state""",
    ("ppanel", "cal_date", "cal_loc", "cal_reg"))
# oil: interpolation by position then a 30-row mean, on the panel's distinct dates
cte("oil_pos", """
SELECT d.date, o.dcoilwtico AS v, row_number() OVER (ORDER BY d.date) AS pos
FROM (SELECT DISTINCT date FROM upanel) d LEFT JOIN oil o ON d.date = o.date""",
    ("upanel", "oil"))
cte("oil_interp", """
SELECT date, pos, coalesce(v,
         CASE WHEN pv IS NOT NULL AND nv IS NOT NULL
              THEN pv + (nv - pv) * (pos - pp) / (np - pp) END, pv, nv) AS dcoilwtico
FROM (SELECT date, pos, v,
         last_value(v IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING
                                          AND CURRENT ROW) AS pv,
         last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS)
             OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
         first_value(v IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW
                                           AND UNBOUNDED FOLLOWING) AS nv,
         first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS)
             OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np
      FROM oil_pos) x""", ("oil_pos",))
cte("oil_smooth", """
SELECT date, CASE WHEN count(dcoilwtico) OVER w >= 1 THEN avg(dcoilwtico) OVER w END AS dcoilwtico
FROM oil_interp WINDOW w AS (ORDER BY pos ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    ("oil_interp",))
cte("features_all", """
SELECT p.*, o.dcoilwtico,
       isodow(p.date) - 1 AS day, dayofyear(p.date) AS dayofyear, month(p.date) AS month,
       year(p.date) AS year,
       (day(p.date) = 15 OR p.date = last_day(p.date)) AS payday,
       CAST(lag(p.onpromotion, 1) OVER s AS DOUBLE) AS onpromotion_lag_1,
       CAST(lag(p.onpromotion, 2) OVER s AS DOUBLE) AS onpromotion_lag_2,
       CAST(lag(p.onpromotion, 3) OVER s AS DOUBLE) AS onpromotion_lag_3,
       CAST(lag(p.onpromotion, 4) OVER s AS DOUBLE) AS onpromotion_lag_4,
       CAST(lag(p.onpromotion, 5) OVER s AS DOUBLE) AS onpromotion_lag_5,
       CAST(lag(p.onpromotion, 6) OVER s AS DOUBLE) AS onpromotion_lag_6,
       CAST(lag(p.onpromotion, 7) OVER s AS DOUBLE) AS onpromotion_lag_7,
       lag(o.dcoilwtico, 1) OVER s AS dcoilwtico_lag_1,
       lag(o.dcoilwtico, 2) OVER s AS dcoilwtico_lag_2,
       lag(o.dcoilwtico, 3) OVER s AS dcoilwtico_lag_3,
       lag(o.dcoilwtico, 4) OVER s AS dcoilwtico_lag_4,
       lag(o.dcoilwtico, 5) OVER s AS dcoilwtico_lag_5,
       lag(o.dcoilwtico, 6) OVER s AS dcoilwtico_lag_6,
       lag(o.dcoilwtico, 7) OVER s AS dcoilwtico_lag_7,
       CAST(coalesce(lag(p.sales, 1) OVER (PARTITION BY p.store_nbr, p.family, dayofyear(p.date)
                                        ORDER BY p.date), 0) AS DOUBLE) AS sales_one_year_lag
FROM calpanel p LEFT JOIN oil_smooth o ON p.date = o.date
WINDOW s AS (PARTITION BY p.store_nbr, p.family ORDER BY p.date)""",
    ("calpanel", "oil_smooth"))
cte("features", """
SELECT * REPLACE (CAST(onpromotion AS DOUBLE) AS onpromotion,
                  CAST(total_other_promo_store AS DOUBLE) AS total_other_promo_store,
                  CAST(total_other_city_promo AS DOUBLE) AS total_other_city_promo),
       dcoilwtico - dcoilwtico_lag_1 AS Change_in_oil_prices,
       coalesce(onpromotion_lag_1, 0) + coalesce(onpromotion_lag_2, 0)
       + coalesce(onpromotion_lag_3, 0) + coalesce(onpromotion_lag_4, 0)
       + coalesce(onpromotion_lag_5, 0) + coalesce(onpromotion_lag_6, 0)
       + coalesce(onpromotion_lag_7, 0) AS promo_last_7_days
FROM features_all WHERE date >= DATE '1996-01-01'""", ("features_all",))


def with_ctes(body: str, *needs: str) -> str:
    """Prefix ``body`` with the CTEs it needs, dependencies first."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTE[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order) + "\n" + body

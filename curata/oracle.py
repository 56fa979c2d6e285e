"""DuckDB SQL equivalent to each registered query (the correctness oracle).

Tables are the pre-registered views over the same parquet files. Statistics
use DuckDB's own aggregates (``quantile_cont``, ``stddev_samp``, ...), so the
oracle shares no code with the Spark side. Rounding is half-even
(``round_even``), ``+ 0.0`` turns ``-0.0`` into ``0.0`` as on the Spark side.
"""

from __future__ import annotations

# The derived "dirty orders" table, as a CTE prefix.
DIRTY = """
d0 AS (
  SELECT o_orderkey AS "Order Key",
    CASE WHEN o_orderkey % 5 = 0 THEN '  ' || o_orderstatus || '  ' ELSE o_orderstatus END AS "Status",
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS "Total-Price ($)",
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS "Priority",
    CASE WHEN o_orderkey % 10 = 0 THEN o_custkey END AS "Sparse",
    CAST(o_custkey AS VARCHAR) AS "Code Text",
    CASE WHEN o_orderkey % 1000 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS "Bad Code"
  FROM orders),
dirty AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE "Order Key" % 20 = 0)"""

LINE_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def r(expr: str, digits: int) -> str:
    return f"(round_even({expr}, {digits}) + 0.0)"


def qi(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def num_summary_sql(source: str, cols: list[str], groups: list[str], with_prefix: str = "") -> str:
    """Numerical summary of ``cols`` per ``groups`` over relation ``source``."""
    g = "".join(f"{qi(x)}, " for x in groups)
    parts = [f"SELECT {g}'{c}' AS variable, CAST({qi(c)} AS DOUBLE) AS value FROM {source}"
             for c in cols]
    long = " UNION ALL ".join(parts)
    keys = groups + ["variable"]
    order = ", ".join(f"{qi(k)} ASC NULLS LAST" for k in keys)
    body = f"""long AS ({long})
SELECT {g}variable, COUNT(value) AS count,
  {r('MIN(value)', 3)} AS min, {r('quantile_cont(value, 0.25)', 3)} AS "Q1",
  {r('quantile_cont(value, 0.5)', 3)} AS median, {r('AVG(value)', 3)} AS mean,
  {r('quantile_cont(value, 0.75)', 3)} AS "Q3", {r('MAX(value)', 3)} AS max,
  {r('stddev_samp(value)', 3)} AS sd
FROM long GROUP BY {", ".join(qi(k) for k in keys)} ORDER BY {order}"""
    return f"WITH {with_prefix}{',' if with_prefix else ''} {body}" if with_prefix else f"WITH {body}"


def cat_summary_sql(source: str, col: str, top_n: int | None = None, with_prefix: str = "") -> str:
    lim = f" LIMIT {top_n}" if top_n else ""
    body = f"""SELECT '{col}' AS variable, COALESCE(CAST({qi(col)} AS VARCHAR), '(Missing)') AS category,
  COUNT(*) AS count,
  {r(f'COUNT(*) * 100.0 / (SELECT COUNT(*) FROM {source})', 2)} AS percentage
FROM {source} GROUP BY 2 ORDER BY count DESC, category{lim}"""
    return f"WITH {with_prefix} {body}" if with_prefix else body


def hist_sql(source: str, col: str, bins: int, group: str | None = None,
             with_prefix: str = "") -> str:
    """Equal-width histogram with empty bins; edges shared by all groups. A
    value is in the bin whose edges hold it: each bin is closed at its lower
    edge, the last one at both."""
    gsel = f"COALESCE(CAST({qi(group)} AS VARCHAR), '(Missing)')" if group else "'all'"
    gout = f"grid.g AS {qi(group)}, " if group else ""
    gorder = f"{qi(group)}, " if group else ""
    body = f"""base AS (SELECT CAST({qi(col)} AS DOUBLE) AS x, {gsel} AS g FROM {source}
                WHERE {qi(col)} IS NOT NULL AND NOT isnan(CAST({qi(col)} AS DOUBLE))),
rng0 AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM base),
rng AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
               CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM rng0),
edges AS (SELECT CAST(b.range AS INTEGER) AS bin, b.range * ((hi - lo) / {bins}) + lo AS e_lo,
                 CASE WHEN b.range = {bins - 1} THEN hi ELSE (b.range + 1) * ((hi - lo) / {bins}) + lo END AS e_hi
          FROM rng, range({bins}) b),
counts AS (SELECT g, bin, SUM(k) AS cnt FROM (SELECT g, x, COUNT(*) AS k FROM base GROUP BY g, x) v
           JOIN edges ON x >= e_lo AND (x < e_hi OR bin = {bins - 1}) GROUP BY g, bin),
grid AS (SELECT DISTINCT g, bin, e_lo, e_hi FROM base, edges)
SELECT {gout}grid.bin AS bin, {r('e_lo', 6)} AS bin_lo, {r('e_hi', 6)} AS bin_hi, CAST(COALESCE(counts.cnt, 0) AS BIGINT) AS count
FROM grid LEFT JOIN counts ON grid.g = counts.g AND grid.bin = counts.bin
ORDER BY {gorder}bin"""
    return f"WITH {with_prefix + ',' if with_prefix else ''} {body}"


# DuckDB spellings of the date/time layouts the Spark side tries.
DUCK_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S",
                "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y/%m/%d",
                "%m/%d/%Y", "%Y-%m"]


def _parses(expr: str) -> str:
    fmts = ", ".join(f"'{f}'" for f in DUCK_FORMATS)
    return f"try_strptime(trim({expr}), [{fmts}])"


def _trim_names_select() -> str:
    return """SELECT "Order Key" AS order_key, trim("Status") AS status,
  "Total-Price ($)" AS total_price_, trim("Priority") AS priority, "Sparse" AS sparse,
  trim("Code Text") AS code_text, trim("Bad Code") AS bad_code FROM dirty"""


def _orders_prepared() -> str:
    """CTEs reproducing the end-to-end preparation of dirty orders."""
    return DIRTY + f""",
named AS ({_trim_names_select()}),
dd AS (SELECT DISTINCT * FROM named),
fills AS (SELECT quantile_cont(total_price_, 0.5) AS m_price,
                 quantile_cont(CAST(sparse AS DOUBLE), 0.5) AS m_sparse,
                 (SELECT priority FROM dd WHERE priority IS NOT NULL GROUP BY priority
                  ORDER BY COUNT(*) DESC, priority LIMIT 1) AS m_priority FROM dd),
imp AS (SELECT order_key, status, COALESCE(total_price_, m_price) AS total_price_,
               COALESCE(priority, m_priority) AS priority,
               COALESCE(CAST(sparse AS DOUBLE), m_sparse) AS sparse, code_text, bad_code
        FROM dd, fills),
fen AS (SELECT quantile_cont(total_price_, 0.25) AS q1, quantile_cont(total_price_, 0.75) AS q3 FROM imp),
capped AS (SELECT order_key, status,
                  LEAST(GREATEST(total_price_, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) AS total_price_,
                  priority, sparse, code_text, bad_code FROM imp, fen),
cl AS (SELECT * FROM capped WHERE status <> 'P'),
st AS (SELECT quantile_cont(total_price_, 0.5) AS med, MIN(total_price_) AS mn,
              MAX(total_price_) AS mx FROM cl),
feats AS (SELECT cl.*,
  CASE WHEN total_price_ > med THEN 'high' END AS price_flag,
  CASE WHEN total_price_ >= mn AND total_price_ <= 100000.0 THEN CAST(mn AS VARCHAR) || '-100000.0'
       WHEN total_price_ > 100000.0 AND total_price_ <= 200000.0 THEN '100000.0-200000.0'
       WHEN total_price_ > 200000.0 AND total_price_ <= 300000.0 THEN '200000.0-300000.0'
       WHEN total_price_ > 300000.0 AND total_price_ <= mx THEN '300000.0-' || CAST(mx AS VARCHAR)
  END AS price_bin,
  CASE WHEN total_price_ > 0 THEN log2(total_price_) END AS price_log2
  FROM cl, st)"""


def _density_sql(table: str = "part", group: str = "p_type", value: str = "p_retailprice", digits: int = 10) -> str:
    return f"""WITH base AS (SELECT {group} AS g, {value} AS x FROM {table} WHERE {value} IS NOT NULL),
st AS (SELECT g, COUNT(*) AS n, stddev_samp(x) * pow(CAST(COUNT(*) AS DOUBLE), -0.2) * 1.0 AS bw,
              MIN(x) AS mn, MAX(x) AS mx FROM base GROUP BY g HAVING COUNT(*) >= 2 AND stddev_samp(x) > 0),
grid AS (SELECT g, n, bw, p.range AS point,
                (mn - 3.0 * bw) + p.range * (((mx + 3.0 * bw) - (mn - 3.0 * bw)) / 199.0) AS gx
         FROM st, range(200) p),
w AS (SELECT g, x, COUNT(*) AS w FROM base GROUP BY g, x)
SELECT grid.g AS {group}, CAST(point AS INTEGER) AS point, {r('gx', 6)} AS x,
  {r('SUM(w.w * exp(-0.5 * ((gx - w.x) / bw) * ((gx - w.x) / bw))) / (n * bw * sqrt(2 * pi()))', digits)} AS density
FROM grid JOIN w ON grid.g = w.g
GROUP BY grid.g, point, gx, n, bw ORDER BY 1, 2"""


def _box_sql(outliers: bool) -> str:
    head = """WITH base AS (SELECT COALESCE(event_type, '(Missing)') AS g, value AS y FROM events WHERE value IS NOT NULL),
q AS (SELECT g, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS med, quantile_cont(y, 0.75) AS q3
      FROM base GROUP BY g),
f AS (SELECT g, q1, med, q3, q1 - 1.5 * (q3 - q1) AS flo, q3 + 1.5 * (q3 - q1) AS fhi FROM q)"""
    if outliers:
        return head + """
SELECT base.g AS event_type, y AS value FROM base JOIN f ON base.g = f.g WHERE y < flo OR y > fhi"""
    return head + f"""
SELECT base.g AS event_type, COUNT(*) AS n, {r('ANY_VALUE(q1)', 6)} AS q1, {r('ANY_VALUE(med)', 6)} AS median,
  {r('ANY_VALUE(q3)', 6)} AS q3,
  {r('MIN(CASE WHEN y >= flo AND y <= fhi THEN y END)', 6)} AS whisker_low,
  {r('MAX(CASE WHEN y >= flo AND y <= fhi THEN y END)', 6)} AS whisker_high,
  COUNT(*) FILTER (WHERE NOT (y >= flo AND y <= fhi)) AS n_outliers
FROM base JOIN f ON base.g = f.g GROUP BY base.g ORDER BY 1"""


def _pairs():
    return [(LINE_NUMS[i], LINE_NUMS[j]) for i in range(len(LINE_NUMS)) for j in range(i)]


def _corr_sql() -> str:
    parts = []
    for a, b in _pairs():
        parts.append(f"""SELECT '{a}' AS var_y, '{b}' AS var_x,
  {r(f'covar_samp({a}, {b}) / NULLIF(stddev_samp({a}) * stddev_samp({b}), 0)', 9)} AS corr,
  COUNT(*) AS n FROM lineitem WHERE {' AND '.join(c + ' IS NOT NULL' for c in LINE_NUMS)}""")
    return " UNION ALL ".join(parts)


def _regr_sql() -> str:
    parts = []
    for a, b in _pairs():
        parts.append(f"""SELECT '{a}' AS var_y, '{b}' AS var_x,
  {r(f'regr_slope({a}, {b})', 6)} AS slope, {r(f'regr_intercept({a}, {b})', 6)} AS intercept,
  COUNT(*) AS n FROM lineitem WHERE {' AND '.join(c + ' IS NOT NULL' for c in LINE_NUMS)}""")
    return " UNION ALL ".join(parts)


def _wide_sql(values: str) -> str:
    return f"""WITH e AS (SELECT row_number() OVER () AS id, embedding FROM embeddings),
w AS (SELECT id, unnest(range(64)) AS i, unnest(embedding[1:64])::DOUBLE AS x FROM e),
v AS (SELECT * FROM w WHERE id NOT IN (SELECT id FROM w WHERE x IS NULL OR isnan(x)))
SELECT 'd' || a.i AS var_y, 'd' || b.i AS var_x, {values}, COUNT(*) AS n
FROM v a JOIN v b ON a.id = b.id AND b.i < a.i GROUP BY a.i, b.i"""


def _scatter_hist_sql() -> str:
    cols = LINE_NUMS[:3]
    complete = f"(SELECT * FROM lineitem WHERE {' AND '.join(c + ' IS NOT NULL' for c in cols)}) AS li"
    parts = []
    for c in cols:
        parts.append(f"SELECT '{c}' AS variable, * FROM ({hist_sql(complete, c, 18)})")
    return " UNION ALL ".join(parts)


def _scale_sql(method: str) -> str:
    if method == "standard":
        def e(c):
            return (f"(CAST({c} AS DOUBLE) - AVG({c}) OVER ()) / "
                    f"COALESCE(NULLIF(stddev_pop({c}) OVER (), 0), 1.0)")
    else:
        def e(c):
            return (f"(CAST({c} AS DOUBLE) - MIN({c}) OVER ()) / "
                    f"COALESCE(NULLIF(MAX({c}) OVER () - MIN({c}) OVER (), 0), 1.0)")
    return (f"SELECT p_partkey, {r(e('p_size'), 9)} AS p_size, "
            f"{r(e('p_retailprice'), 9)} AS p_retailprice FROM part")


def _impute_sql(method: str) -> str:
    if method == "mean":
        num = 'AVG("Total-Price ($)") AS m_price, AVG(CAST("Sparse" AS DOUBLE)) AS m_sparse'
    else:
        num = ('quantile_cont("Total-Price ($)", 0.5) AS m_price, '
               'quantile_cont(CAST("Sparse" AS DOUBLE), 0.5) AS m_sparse')
    return f"""WITH {DIRTY},
fills AS (SELECT {num},
  (SELECT "Priority" FROM dirty WHERE "Priority" IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) AS m_pri
  FROM dirty)
SELECT "Order Key", "Status", {r('COALESCE("Total-Price ($)", m_price)', 6)} AS "Total-Price ($)",
  COALESCE("Priority", m_pri) AS "Priority", {r('COALESCE(CAST("Sparse" AS DOUBLE), m_sparse)', 6)} AS "Sparse",
  "Code Text", "Bad Code" FROM dirty, fills"""


def _missing_sql() -> str:
    cols = [("Order Key", "bigint"), ("Status", "string"), ("Total-Price ($)", "double"),
            ("Priority", "string"), ("Sparse", "bigint"), ("Code Text", "string"),
            ("Bad Code", "string")]
    parts = [f"""SELECT '{c}' AS "column", COUNT(*) FILTER (WHERE {qi(c)} IS NULL) AS missing_count,
  {r(f'COUNT(*) FILTER (WHERE {qi(c)} IS NULL) * 100.0 / COUNT(*)', 2)} AS missing_pct,
  '{t}' AS dtype FROM dirty""" for c, t in cols]
    return f"WITH {DIRTY}\n" + " UNION ALL ".join(parts) + " ORDER BY missing_count DESC, 1"


def _overview_sql() -> str:
    cols = ["Order Key", "Status", "Total-Price ($)", "Priority", "Sparse", "Code Text", "Bad Code"]
    raw_miss = " + ".join(f"CAST({qi(c)} IS NULL AS BIGINT)" for c in cols)
    clean_cols = ["order_key", "status", "total_price_", "priority", "sparse", "code_text", "bad_code"]
    cl_miss = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in clean_cols)
    return f"""WITH {DIRTY},
named AS ({_trim_names_select()}),
dd AS (SELECT DISTINCT * FROM named),
raw_rows AS (SELECT COUNT(*) AS n FROM dirty)
SELECT 'raw' AS stage, COUNT(*) AS rows, CAST(7 AS BIGINT) AS columns, CAST(SUM({raw_miss}) AS BIGINT) AS missing_cells,
  COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicate_rows,
  (SELECT n FROM raw_rows) - COUNT(*) AS rows_removed FROM dirty
UNION ALL
SELECT 'cleaned', COUNT(*), CAST(7 AS BIGINT), CAST(SUM({cl_miss}) AS BIGINT),
  COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dd)),
  (SELECT n FROM raw_rows) - COUNT(*) FROM dd"""


def _filter_pred() -> str:
    return ('"Total-Price ($)" BETWEEN 50000.0 AND 400000.0 AND '
            '("Priority" IN (\'1-URGENT\', \'2-HIGH\') OR "Priority" IS NULL)')


def _levels_sql() -> str:
    prefix = """st AS (SELECT MIN(l_quantity) AS mn, MAX(l_quantity) AS mx FROM lineitem),
b AS (SELECT CASE WHEN l_quantity >= mn AND l_quantity <= 10.0 THEN CAST(mn AS VARCHAR) || '-10.0'
                  WHEN l_quantity > 10.0 AND l_quantity <= 10.5 THEN '10.0-10.5'
                  WHEN l_quantity > 10.5 AND l_quantity <= 20.0 THEN '10.5-20.0'
                  WHEN l_quantity > 20.0 AND l_quantity <= mx THEN '20.0-' || CAST(mx AS VARCHAR) END AS qty_bin,
             l_extendedprice FROM lineitem, st),
levels AS (SELECT CAST(mn AS VARCHAR) || '-10.0' AS qty_bin FROM st UNION ALL SELECT '10.0-10.5'
           UNION ALL SELECT '10.5-20.0' UNION ALL SELECT '20.0-' || CAST(mx AS VARCHAR) FROM st),
s AS (""" + num_summary_sql("b", ["l_extendedprice"], ["qty_bin"]) + ")"
    return f"""WITH {prefix}
SELECT levels.qty_bin, 'l_extendedprice' AS variable, COALESCE(s.count, 0) AS count, s.min, s."Q1",
  s.median, s.mean, s."Q3", s.max, s.sd
FROM levels LEFT JOIN s ON levels.qty_bin IS NOT DISTINCT FROM s.qty_bin"""


def _engineered_sql() -> str:
    """Summary of the prepared orders; every level of the binned column is
    listed with the other keys that occur."""
    s = num_summary_sql("feats", ["total_price_", "price_log2", "sparse"], ["price_bin", "price_flag"], _orders_prepared())
    head, body = s.rsplit("SELECT price_bin" if "SELECT price_bin" in s else 'SELECT "price_bin"', 1)
    return head.rstrip() + f""",
summed AS (SELECT "price_bin"{body}),
levels AS (SELECT CAST(mn AS VARCHAR) || '-100000.0' AS price_bin FROM st UNION ALL SELECT '100000.0-200000.0'
           UNION ALL SELECT '200000.0-300000.0' UNION ALL SELECT '300000.0-' || CAST(mx AS VARCHAR) FROM st),
keys AS (SELECT price_bin, price_flag, variable FROM summed UNION
         SELECT levels.price_bin, o.price_flag, o.variable FROM levels, (SELECT DISTINCT price_flag, variable FROM summed) o)
SELECT keys.*, COALESCE(s.count, 0) AS count, s.min, s."Q1", s.median, s.mean, s."Q3", s.max, s.sd
FROM keys LEFT JOIN summed s ON keys.price_bin IS NOT DISTINCT FROM s.price_bin
  AND keys.price_flag IS NOT DISTINCT FROM s.price_flag AND keys.variable = s.variable"""


def _scatter_matrix_sql() -> str:
    cols = LINE_NUMS[:3]
    whole = f"(SELECT * FROM lineitem WHERE {' AND '.join(c + ' IS NOT NULL' for c in cols)}) AS li"
    none = {"bin": "INTEGER", "bin_lo": "DOUBLE", "bin_hi": "DOUBLE", "count": "BIGINT", "slope": "DOUBLE", "intercept": "DOUBLE", "corr": "DOUBLE", "n": "BIGINT"}

    def row(part: str, y: str, x: str, given: dict, tail: str) -> str:
        cells = ", ".join(f"{given.get(k, f'CAST(NULL AS {t})')} AS {qi(k)}" for k, t in none.items())
        return f"SELECT '{part}' AS part, {y} AS var_y, {x} AS var_x, {cells} FROM {tail}"

    parts = [row("histogram", f"'{c}'", "CAST(NULL AS VARCHAR)", {k: qi(k) for k in ("bin", "bin_lo", "bin_hi", "count")}, f"({hist_sql(whole, c, 18)})") for c in cols]
    for a, b in [(cols[i], cols[j]) for i in range(3) for j in range(i)]:
        parts.append(row("regression", f"'{a}'", f"'{b}'", {"slope": r(f"regr_slope({a}, {b})", 6), "intercept": r(f"regr_intercept({a}, {b})", 6), "n": "COUNT(*)"}, whole))
        parts.append(row("correlation", f"'{a}'", f"'{b}'", {"corr": r(f"covar_samp({a}, {b}) / NULLIF(stddev_samp({a}) * stddev_samp({b}), 0)", 9), "n": "COUNT(*)"}, whole))
    return " UNION ALL ".join(parts)


def _step_log_sql() -> str:
    cells = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in ("order_key", "status", "total_price_", "priority", "sparse", "code_text", "bad_code"))
    return f"""WITH {DIRTY},
named AS ({_trim_names_select()}),
dd AS (SELECT DISTINCT * FROM named),
full_ AS (SELECT * FROM dd WHERE ({cells}) / 7.0 <= 0.2),
q AS (SELECT quantile_cont(total_price_, 0.25) AS q1, quantile_cont(total_price_, 0.75) AS q3 FROM full_),
inside AS (SELECT full_.* FROM full_, q WHERE total_price_ BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
n AS (SELECT (SELECT COUNT(*) FROM named) AS a, (SELECT COUNT(*) FROM dd) AS b, (SELECT COUNT(*) FROM full_) AS c,
             (SELECT COUNT(*) FROM inside) AS d, (SELECT COUNT(*) FROM inside WHERE status <> 'P' OR status IS NULL) AS e)
SELECT 'dedup' AS step, a - b AS rows_removed FROM n UNION ALL SELECT 'missing', b - c FROM n
UNION ALL SELECT 'outliers', c - d FROM n UNION ALL SELECT 'drop_values', d - e FROM n"""


SQL: dict[str, str] = {
    "num_summary": num_summary_sql("lineitem", LINE_NUMS, []),
    "num_summary_grouped": num_summary_sql("lineitem", LINE_NUMS, ["l_returnflag", "l_linestatus"]),
    "num_summary_filtered": num_summary_sql(
        f"(SELECT * FROM dirty WHERE {_filter_pred()}) AS f", ["Total-Price ($)", "Sparse"],
        ["Priority"], DIRTY),
    "num_summary_levels": _levels_sql(),
    "filter_status": f"""WITH {DIRTY}
SELECT COUNT(*) AS rows_before, COUNT(*) FILTER (WHERE {_filter_pred()}) AS rows_after FROM dirty""",
    "cat_summary": cat_summary_sql("orders", "o_orderpriority"),
    "cat_top_n": cat_summary_sql("part", "p_type", 3),
    "cat_summary_missing": cat_summary_sql("dirty", "Priority", None, DIRTY),
    "missing_table": _missing_sql(),
    "overview": _overview_sql(),
    "filter_bounds": f"""WITH {DIRTY}
SELECT * FROM (
  SELECT 'Order Key' AS "column", CAST(MIN("Order Key") AS DOUBLE) AS min, CAST(MAX("Order Key") AS DOUBLE) AS max, true AS is_integer FROM dirty
  UNION ALL SELECT 'Total-Price ($)', MIN("Total-Price ($)"), MAX("Total-Price ($)"), false FROM dirty
  UNION ALL SELECT 'Sparse', CAST(MIN("Sparse") AS DOUBLE), CAST(MAX("Sparse") AS DOUBLE), true FROM dirty)
WHERE min IS NOT NULL AND min <> max""",
    "filter_choices": f"""WITH {DIRTY}
SELECT DISTINCT "Priority" AS text, (SELECT bool_or("Priority" IS NULL) FROM dirty) AS has_missing
FROM dirty WHERE "Priority" IS NOT NULL ORDER BY 1""",
    "column_facts": f"""SELECT MIN(c_acctbal) AS min, MAX(c_acctbal) AS max, {r('AVG(c_acctbal)', 6)} AS mean,
  COUNT(c_acctbal) AS n, COUNT(*) FILTER (WHERE c_acctbal <= 0) AS non_positive,
  COUNT(DISTINCT c_acctbal) AS n_distinct, {r('quantile_cont(c_acctbal, 0.5)', 6)} AS median FROM customer""",
    "trim_names": f"WITH {DIRTY}\n{_trim_names_select()}",
    "dedup": f"WITH {DIRTY}\nSELECT DISTINCT * FROM ({_trim_names_select()})",
    "drop_rows_missing": f"""WITH {DIRTY}
SELECT * FROM dirty WHERE ({' + '.join(f'CAST({qi(c)} IS NULL AS INTEGER)' for c in
    ['Order Key', 'Status', 'Total-Price ($)', 'Priority', 'Sparse', 'Code Text', 'Bad Code'])}) / 7.0 <= 0.2""",
    "drop_cols_missing": f"""WITH {DIRTY}
SELECT "Order Key", "Status", "Total-Price ($)", "Priority", "Code Text", "Bad Code" FROM dirty""",
    "impute_mean": _impute_sql("mean"),
    "impute_median": _impute_sql("median"),
    "cast_int": f"""WITH {DIRTY}
SELECT "Order Key", CAST("Code Text" AS BIGINT) AS "Code Text", "Bad Code" FROM dirty""",
    "cast_float": f"""WITH {DIRTY}
SELECT "Order Key", CAST("Code Text" AS DOUBLE) AS "Code Text", "Status" FROM dirty""",
    "cast_text": f"""WITH {DIRTY}
SELECT CAST("Order Key" AS VARCHAR) AS "Order Key", CAST("Sparse" AS VARCHAR) AS "Sparse", "Priority" FROM dirty""",
    "scale_z": _scale_sql("standard"),
    "scale_minmax": _scale_sql("minmax"),
    "onehot_replace": """SELECT event_id, value,
  CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS event_type_click,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS event_type_error,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS event_type_purchase,
  CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS event_type_signup,
  CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS event_type_view FROM events""",
    "onehot_keep": """SELECT c_custkey, c_mktsegment,
  COALESCE(c_mktsegment = 'AUTOMOBILE', false) AS c_mktsegment_is_automobile,
  COALESCE(c_mktsegment = 'BUILDING', false) AS c_mktsegment_is_building,
  COALESCE(c_mktsegment = 'FURNITURE', false) AS c_mktsegment_is_furniture,
  COALESCE(c_mktsegment = 'HOUSEHOLD', false) AS c_mktsegment_is_household,
  COALESCE(c_mktsegment = 'MACHINERY', false) AS c_mktsegment_is_machinery FROM customer""",
    "ln_gate": f"""SELECT l_orderkey, l_linenumber, {r('ln(l_quantity)', 9)} AS l_quantity,
  {r('ln(l_extendedprice)', 9)} AS l_extendedprice, l_discount FROM lineitem""",
    "outlier_cap": f"""WITH f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, {r('CASE WHEN value IS NOT NULL THEN LEAST(GREATEST(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END', 6)} AS value
FROM events, f""",
    "outlier_remove": """WITH f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value FROM events, f
WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
    "drop_values": """SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P'
  AND o_totalprice IS NOT NULL AND NOT isnan(o_totalprice) AND o_totalprice <> 5.0""",
    "csv_roundtrip": f"""WITH {DIRTY}
SELECT "Order Key", "Status", "Total-Price ($)", "Priority", "Sparse",
  CAST("Code Text" AS BIGINT) AS "Code Text", "Bad Code",
  CASE "Order Key" % 4 WHEN 0 THEN 'say "hi", no. ' || "Order Key" WHEN 1 THEN 'two' || chr(10) || 'lines ' || "Order Key"
       WHEN 2 THEN '"quoted"' ELSE 'a,b' END AS "Note" FROM dirty""",
    "map_mean": """SELECT o_orderkey, o_totalprice,
  CASE WHEN o_totalprice > (SELECT AVG(o_totalprice) FROM orders) THEN 'high' END AS price_band FROM orders""",
    "map_median": """SELECT o_orderkey, o_totalprice,
  CASE WHEN o_totalprice <= (SELECT quantile_cont(o_totalprice, 0.5) FROM orders) THEN 'low' END AS price_band
FROM orders""",
    "map_chain": """SELECT o_orderkey, o_totalprice,
  CASE WHEN o_totalprice < 20000 THEN '1' WHEN o_totalprice > 300000 THEN 'top'
       WHEN o_totalprice > 100000 THEN 'mid' END AS tier FROM orders""",
    "bin_int": """WITH st AS (SELECT MIN(p_size) AS mn, MAX(p_size) AS mx FROM part)
SELECT p_partkey, p_size,
  CASE WHEN p_size >= mn AND p_size <= 10 THEN CAST(mn AS VARCHAR) || '-10'
       WHEN p_size > 10 AND p_size <= 20 THEN '11-20'
       WHEN p_size > 20 AND p_size <= 30 THEN '21-30'
       WHEN p_size > 30 AND p_size <= 40 THEN '31-40'
       WHEN p_size > 40 AND p_size <= mx THEN '41-' || CAST(mx AS VARCHAR) END AS size_bin
FROM part, st""",
    "bin_float": """WITH st AS (SELECT MIN(c_acctbal) AS mn, MAX(c_acctbal) AS mx FROM customer)
SELECT c_custkey, c_acctbal,
  CASE WHEN c_acctbal >= mn AND c_acctbal <= 0 THEN CAST(mn AS VARCHAR) || '-0.0'
       WHEN c_acctbal > 0 AND c_acctbal <= 2500 THEN '0.0-2500.0'
       WHEN c_acctbal > 2500 AND c_acctbal <= 5000 THEN '2500.0-5000.0'
       WHEN c_acctbal > 5000 AND c_acctbal <= 7500 THEN '5000.0-7500.0'
       WHEN c_acctbal > 7500 AND c_acctbal <= mx THEN '7500.0-' || CAST(mx AS VARCHAR) END AS balance_bin
FROM customer, st""",
    "log2_new": f"""SELECT c_custkey, c_acctbal, {r('CASE WHEN c_acctbal > 0 THEN log2(c_acctbal) END', 9)} AS acctbal_log2
FROM customer""",
    "hist": hist_sql("lineitem", "l_extendedprice", 30),
    "hist_by": hist_sql("events", "value", 20, "event_type"),
    "hist_log2": hist_sql("(SELECT CASE WHEN c_acctbal > 0 THEN log2(c_acctbal) END AS c_acctbal_log2 FROM customer) AS t",
                          "c_acctbal_log2", 20),
    "density": _density_sql(),
    "density_series": _density_sql("events", "event_type", "value", 8),
    "box": _box_sql(False),
    "box_outliers": _box_sql(True),
    "bar": """SELECT COALESCE(event_type, '(Missing)') AS category, COUNT(*) AS count FROM events
GROUP BY 1 ORDER BY count DESC, category""",
    "line_orders": f"""SELECT o_orderstatus, o_orderdate, {r('AVG(o_totalprice)', 6)} AS y_mean, COUNT(*) AS n
FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL
GROUP BY o_orderstatus, o_orderdate ORDER BY 1, 2""",
    "line_day": f"""SELECT event_type, date_trunc('day', ts) AS day, {r('AVG(value)', 6)} AS y_mean, COUNT(*) AS n
FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2 ORDER BY 1, 2""",
    "datetime_detect": f"""WITH t AS (SELECT CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority, o_orderstatus FROM orders),
c AS (
  SELECT 'o_orderdate' AS "column", COUNT(o_orderdate) AS non_missing, COUNT({_parses('o_orderdate')}) AS parsed FROM t
  UNION ALL SELECT 'o_orderpriority', COUNT(o_orderpriority), COUNT({_parses('o_orderpriority')}) FROM t
  UNION ALL SELECT 'o_orderstatus', COUNT(o_orderstatus), COUNT({_parses('o_orderstatus')}) FROM t)
SELECT "column", non_missing, parsed, round_even(CAST(parsed AS DOUBLE) / NULLIF(non_missing, 0), 6) AS parsed_share,
  COALESCE(CAST(parsed AS DOUBLE) / NULLIF(non_missing, 0) >= 0.8, false) AS is_datetime FROM c""",
    "corr_matrix": _corr_sql(),
    "pair_regression": _regr_sql(),
    "corr_wide": _wide_sql(r("covar_samp(a.x, b.x) / NULLIF(stddev_samp(a.x) * stddev_samp(b.x), 0)", 9) + " AS corr"),
    "regression_wide": _wide_sql(r("regr_slope(a.x, b.x)", 9) + " AS slope, " + r("regr_intercept(a.x, b.x)", 9) + " AS intercept"),
    "csv_file": """SELECT -o_orderkey AS "last first", o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'say "hi",' || chr(10) || o_orderstatus ELSE 'a,b' END AS note,
  row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS row_number FROM orders""",
    "scatter_hist": _scatter_hist_sql(),
    "doc_length_summary": num_summary_sql(
        "(SELECT lang, CAST(length(text) AS BIGINT) AS text_chars, n_chars FROM documents) AS d",
        ["text_chars", "n_chars"], ["lang"]),
    "doc_overview": """WITH d AS (SELECT text, lang, source FROM documents),
dd AS (SELECT DISTINCT * FROM d),
raw_rows AS (SELECT COUNT(*) AS n FROM d)
SELECT 'raw' AS stage, COUNT(*) AS rows, CAST(3 AS BIGINT) AS columns,
  CAST(SUM(CAST(text IS NULL AS BIGINT) + CAST(lang IS NULL AS BIGINT) + CAST(source IS NULL AS BIGINT)) AS BIGINT) AS missing_cells,
  COUNT(*) - (SELECT COUNT(*) FROM dd) AS duplicate_rows, (SELECT n FROM raw_rows) - COUNT(*) AS rows_removed FROM d
UNION ALL
SELECT 'cleaned', COUNT(*), CAST(3 AS BIGINT),
  CAST(SUM(CAST(text IS NULL AS BIGINT) + CAST(lang IS NULL AS BIGINT) + CAST(source IS NULL AS BIGINT)) AS BIGINT),
  CAST(0 AS BIGINT), (SELECT n FROM raw_rows) - COUNT(*) FROM dd""",
    "source_top_n": cat_summary_sql("documents", "source", 5),
    "top_urls": cat_summary_sql("pages", "url", 10),
    "top_texts": cat_summary_sql("documents", "text", 10),
    "conversation_roles": cat_summary_sql("conversations", "role"),
    "label_summary": num_summary_sql("labels", ["quality", "toxic"], []),
    "num_summary_missing_level": f"""WITH e AS (SELECT CASE WHEN o_totalprice < 300000 THEN
    CASE WHEN o_totalprice <= 100000 THEN 1 WHEN o_totalprice <= 200000 THEN 2 ELSE 3 END END AS b, o_totalprice AS v FROM orders,
    (SELECT MAX(o_totalprice) AS mx FROM orders WHERE o_totalprice < 300000))
SELECT 'o_totalprice' AS variable, COUNT(v) AS count, {r('MIN(v)', 3)} AS min, {r('quantile_cont(v, 0.25)', 3)} AS "Q1", {r('quantile_cont(v, 0.5)', 3)} AS median,
  {r('AVG(v)', 3)} AS mean, {r('quantile_cont(v, 0.75)', 3)} AS "Q3", {r('MAX(v)', 3)} AS max, {r('stddev_samp(v)', 3)} AS sd FROM e GROUP BY b""",
    "stat_select": f"""SELECT l_returnflag, variable, count, "Q1", max FROM ({num_summary_sql("lineitem", LINE_NUMS, ["l_returnflag"])})""",
    "cat_stat_select": f"""SELECT variable, category, percentage FROM ({cat_summary_sql("dirty", "Priority", None, DIRTY)})""",
    "distinct_missing": f"""WITH {DIRTY}
SELECT 'Priority' AS "column", COUNT(DISTINCT "Priority") AS n_distinct, COUNT(DISTINCT "Priority") + CAST(bool_or("Priority" IS NULL) AS BIGINT) AS n_with_missing FROM dirty
UNION ALL SELECT 'Status', COUNT(DISTINCT "Status"), COUNT(DISTINCT "Status") + CAST(bool_or("Status" IS NULL) AS BIGINT) FROM dirty""",
    "preview_head": """SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER () AS rn FROM orders) t WHERE rn <= 5""",
    "row_numbers": """SELECT c_custkey, row_number() OVER () - 1 AS row_number FROM customer""",
    "onehot_first_seen": """WITH o AS (SELECT o_orderpriority AS v, row_number() OVER () AS rn FROM orders),
l AS (SELECT v, MIN(rn) AS rn, COUNT(*) AS n FROM o WHERE v IS NOT NULL GROUP BY v)
SELECT CAST(row_number() OVER (ORDER BY rn) - 1 AS INTEGER) AS place,
  'o_orderpriority_is_' || lower(regexp_replace(replace(v, ' ', '_'), '[^A-Za-z0-9_]', '_', 'g')) AS column_name, n FROM l""",
    "datetime_first_cells": """WITH e AS (SELECT row_number() OVER () - 1 AS rn FROM events),
v AS (SELECT rn, 'late' AS c, CASE WHEN rn < 100 THEN 'none' ELSE '2024-05-06 07:08:09' END AS v FROM e
UNION ALL SELECT rn, 'early', CASE WHEN rn >= 300 THEN 'none' WHEN rn % 3 > 0 THEN '2024-05-06' END FROM e),
f AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY rn) AS place FROM v WHERE v IS NOT NULL),
s AS (SELECT c, COUNT(*) AS n, COUNT(TRY_CAST(v AS TIMESTAMP)) AS ok FROM f WHERE place <= 200 GROUP BY c)
SELECT c AS "column", n AS non_missing, ok AS parsed, round(ok / n::DOUBLE, 6) AS parsed_share, ok / n::DOUBLE >= 0.8 AS is_datetime FROM s""",
    "preview": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5",
    "json_roundtrip": """SELECT 'lines' AS layout, c_custkey AS key, c_name AS name FROM customer
UNION ALL SELECT 'array', CAST(o_orderkey AS BIGINT), o_orderpriority FROM orders""",
    "load_dispatch": """SELECT suffix, CAST(c_custkey AS BIGINT) AS c_custkey, c_name FROM customer, (VALUES ('.csv'), ('.JSON'), ('.parquet')) s(suffix)""",
    "normalize_types": """SELECT vec_id, '[' || CAST(trunc(embedding[1]) AS INTEGER) || ',' || CAST(trunc(embedding[2]) AS INTEGER) || ']' AS head, '2024-02-29' AS day,
  CASE WHEN vec_id % 3 <> 0 THEN vec_id / 2.0 END::DOUBLE AS half, label > 2 AS flag FROM embeddings""",
    "write_summary_csv": num_summary_sql("events", ["value"], ["event_type"]),
    "unique_names": """SELECT p_partkey AS key, p_size AS a_b, p_name AS a_b_3, p_brand AS a_b_2, p_type AS _ FROM part""",
    "cast_category": cat_summary_sql("part", "p_size"),
    "cast_int_nan": """SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS BIGINT) END AS size,
  CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS price FROM part""",
    "drop_values_int": "SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (10, 12)",
    "impute_mode_tie": """SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 2 WHEN 2 THEN
  (SELECT CASE WHEN SUM((p_partkey % 4 = 1)::INT) >= SUM((p_partkey % 4 = 0)::INT) THEN 2 ELSE 10 END FROM part)
  ELSE p_partkey + 100 END AS INTEGER) AS size FROM part""",
    "ln_bool": f"""SELECT p_partkey, CASE WHEN (SELECT bool_and(p_size > 0) FROM part) THEN 0.0 END::DOUBLE AS positive, {r('ln(p_retailprice)', 9)} AS p_retailprice FROM part""",
    "onehot_keep_double": """SELECT o_orderkey, o_custkey % 5 = 1 AS level_is_0_0005, o_custkey % 5 = 3 AS level_is_3_0, o_custkey % 5 = 4 AS level_is_4_0,
  o_custkey % 5 = 0 AS level_is_20000000_0 FROM orders""",
    "step_log": _step_log_sql(),
    "rule_toggle": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderpriority <> '2-HIGH'",
    "prepare_file": f"""WITH {DIRTY},
named AS (SELECT order_key, status, total_price_, priority, CAST(code_text AS BIGINT) AS code_text, bad_code, sparse FROM ({_trim_names_select()})),
dd AS (SELECT DISTINCT * FROM named),
m AS (SELECT AVG(total_price_) AS price, (SELECT priority FROM dd WHERE priority IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) AS mode FROM dd),
filled AS (SELECT order_key, status, COALESCE(total_price_, m.price) AS p, COALESCE(priority, m.mode) AS priority, code_text, bad_code FROM dd, m)
SELECT order_key, status, {r('p', 6)} AS total_price_, priority, code_text, bad_code, {r('log2(p)', 9)} AS price_log2 FROM filled WHERE p BETWEEN 100000 AND 300000""",
    "map_sequence": """SELECT p_partkey, CAST(s AS BIGINT) AS p_size, CASE WHEN s < 10 THEN 'low' END AS flag
FROM (SELECT p_partkey, CASE WHEN p_size > 40 THEN 5 ELSE p_size END AS s FROM part)""",
    "hist_discount": hist_sql("lineitem", "l_discount", 30),
    "line_text_day": f"""SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS day, {r('AVG(o_totalprice)', 6)} AS y_mean, COUNT(*) AS n FROM orders
WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1""",
    "line_choices": """SELECT place::INTEGER AS place, "column" FROM (VALUES (1, 'day'), (2, 'o_orderkey'), (3, 'o_totalprice')) t(place, "column")
WHERE (SELECT COUNT(*) FROM orders WHERE o_orderdate IS NOT NULL) > 0""",
    "box_points": f"""WITH {DIRTY}
SELECT COALESCE("Priority", '(Missing)') AS "Priority", "Total-Price ($)" FROM dirty WHERE "Total-Price ($)" IS NOT NULL""",
    "scatter_matrix": _scatter_matrix_sql(),
    "clean_engineer_summary": _engineered_sql(),
    "clean_engineer_categories": cat_summary_sql("feats", "price_bin", None, _orders_prepared()),
}

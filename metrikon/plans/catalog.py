"""Registered queries of the measurement operators, each with the SQL that gives the same rows.

The driver's tables stand in for measurement tables: customers for subjects, orders for images,
events for views of a subject, vectors for rows to impute. Nulls are derived by fixed rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, ids, nulls
from ..operators import calibrate, compare, crossval, fuse, harmonize, horizon, knn, mask, metrics, nearest, pseudonym, qc, ranks
from ..sources import tables
from ..sources.shared import fresh_path
from . import sites, tracks

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers long: the types both engines compare."""
    kinds = dict(df.dtypes)
    turn = {c: F.round(c, digits) if k == "double" else F.col(c).cast("long") for c, k in kinds.items() if k in ("double", "int", "bigint", "smallint")}
    return df.withColumns(turn)


# ---- derived tables -------------------------------------------------------------

SALT = "a salt for tests"
RANGES = {"balance": (-900.0, 9900.0), "AGE": (0.0, 23.0)}
MEASURES = ["balance", "spend", "AGE"]
CUST = """cust AS (SELECT c_custkey AS rid, CASE WHEN c_custkey % 23 <> 0 THEN c_mktsegment END AS site, CASE WHEN c_custkey % 19 <> 0 THEN CAST(c_custkey // 2 AS VARCHAR) END AS id,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS balance,
  CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 97 = 0 THEN c_acctbal * 20 ELSE c_acctbal / 2 + c_nationkey END AS spend,
  CAST(c_nationkey AS DOUBLE) AS "AGE" FROM customer)"""


def customers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    spend = F.when(k % 17 == 0, None).when(k % 97 == 0, F.col("c_acctbal") * 20).otherwise(F.col("c_acctbal") / 2 + F.col("c_nationkey"))
    return table(spark, d, "customer").select(F.when(k % 23 != 0, F.col("c_mktsegment")).alias("site"), F.when(k % 19 != 0, F.floor(k / 2).cast("string")).alias("id"), F.when(k % 11 != 0, F.col("c_acctbal")).alias("balance"), spend.alias("spend"), F.col("c_nationkey").cast("double").alias("AGE"))


EST = """est AS (SELECT o_orderkey, o_custkey AS subject, o_orderpriority AS view, o_totalprice AS truth, net, gross
  FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS net, sum(l_extendedprice) AS gross FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def estimates(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice")
    sums = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(price * (1 - F.col("l_discount"))).alias("net"), F.sum(price).alias("gross"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("view"), F.col("o_totalprice").alias("truth"))
    return o.join(sums, o.o_orderkey == sums.l_orderkey, "left").drop("l_orderkey")


GAPS = EST + """, gaps AS (SELECT o_orderkey, CASE WHEN o_orderkey % 31 <> 0 THEN view END AS view, CASE WHEN o_orderkey % 29 <> 0 THEN truth END AS truth, net FROM est)"""


def gaps(spark: SparkSession, d: str) -> DataFrame:
    """Estimates some of which lack the view or the truth."""
    k = F.col("o_orderkey")
    return estimates(spark, d).withColumns({"view": F.when(k % 31 != 0, F.col("view")), "truth": F.when(k % 29 != 0, F.col("truth"))})


GROUPS = {"FRONT+BACK": ["1-URGENT", "2-HIGH"], "LEFT+RIGHT": ["3-MEDIUM", "5-LOW"]}
IMG = """img AS (SELECT *, coalesce(status = 'ok' AND h > 40 AND h < 230, FALSE) AS ok FROM (SELECT event_id, user_id AS subject, CASE event_id % 5 WHEN 0 THEN 'front' WHEN 1 THEN 'back' WHEN 2 THEN 'left' WHEN 3 THEN 'right' ELSE 'top' END AS view,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS y, CASE WHEN event_id % 11 = 0 THEN 'no_marker' ELSE 'ok' END AS status, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value + 39 END AS h FROM events))"""


def images(spark: SparkSession, d: str) -> DataFrame:
    e, i = table(spark, d, "events"), F.col("event_id")
    view = F.when(i % 5 == 0, "front").when(i % 5 == 1, "back").when(i % 5 == 2, "left").when(i % 5 == 3, "right").otherwise("top")
    y = F.when(i % 7 != 0, F.col("value"))
    return e.select(i, F.col("user_id").alias("subject"), view.alias("view"), y.alias("y"), F.when(i % 11 == 0, "no_marker").otherwise("ok").alias("status"), (y + 39).alias("h"))


def donor(views: tuple[str, ...] = horizon.FRONT_BACK) -> Column:
    return horizon.valid_donor(F.col("view"), views, F.col("status"), F.col("y"), F.col("h"))


DIMS = [f"e{i}" for i in range(1, 9)]
VEC = "vec AS (SELECT vec_id, label, " + ", ".join(f"CASE WHEN (vec_id * 7 + {i}) % 5 = 0 THEN NULL ELSE CAST(embedding[{i}] AS DOUBLE) END AS e{i}" for i in range(1, 9)) + " FROM embeddings)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    cells = [F.when((F.col("vec_id") * 7 + i) % 5 != 0, F.col("embedding")[i - 1].cast("double")).alias(f"e{i}") for i in range(1, 9)]
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), *cells)


# ---- projections and identifiers ------------------------------------------------


@query("""SELECT 'CU' AS site, CAST(c_custkey AS VARCHAR) AS "ID", c_mktsegment AS "TYPE", round(c_acctbal * 100, 6) AS "HEIGHT_cm", round((c_acctbal + c_nationkey) / 2, 6) AS "PER_Neck_cm" FROM customer
UNION ALL SELECT 'SU', CAST(s_suppkey AS VARCHAR), NULL, round(s_acctbal, 6), NULL FROM supplier""")
def harmonize_union(spark: SparkSession, d: str) -> DataFrame:
    order = ["ID", "TYPE", "HEIGHT_cm", "PER_Neck_cm"]
    a = harmonize.Mapping({"ID": "c_custkey", "TYPE": "c_mktsegment", "HEIGHT_cm": "c_acctbal"}, {"HEIGHT_cm": 100.0}, {"PER_Neck_cm": ("c_acctbal", "c_nationkey")})
    b = harmonize.Mapping({"ID": "s_suppkey", "HEIGHT_cm": "s_acctbal"})
    frames = [harmonize.equalise(table(spark, d, t), m, order).select(F.lit(s).alias("site"), *order) for t, m, s in (("customer", a, "CU"), ("supplier", b, "SU"))]
    return tidy(harmonize.union(frames))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE (coalesce(a, 0) + coalesce(b, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) END, 6) AS m
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_discount END AS a, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_tax END AS b FROM lineitem)""")
def row_mean_pairs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 3 != 0, F.col("l_discount")).alias("a"), F.when(F.col("l_linenumber") % 2 != 0, F.col("l_tax")).alias("b"))
    return tidy(li.select("l_orderkey", "l_linenumber", nulls.row_mean("a", "b").alias("m")))


@query("""SELECT p_partkey, round(try_cast(substr(p_brand, 7) AS DOUBLE), 6) AS brand_no, round(CASE WHEN p_size = 0 THEN NULL ELSE p_retailprice / pow(p_size / 100.0, 3) END, 6) AS ponderal FROM part""")
def coerce_and_ponderal(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return tidy(p.select("p_partkey", nulls.number(F.expr("substr(p_brand, 7)")).alias("brand_no"), geometry.ponderal(F.col("p_retailprice"), F.col("p_size").cast("double")).alias("ponderal")))


@query("""SELECT c_custkey, substr(c_name, 1, 2) AS site, CASE WHEN contains(c_name, 'ST') THEN 'ST' WHEN contains(c_name, 'CTC') THEN 'CN' ELSE 'unknown' END AS cohort,
coalesce(list_extract(regexp_extract_all(c_name, '(\\d+)', 1), -1), '') AS number FROM customer""")
def parse_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", *(c.alias(k) for k, c in ids.parse_id(F.col("c_name")).items()))


VIEW_NAME = "concat(CAST(event_id AS VARCHAR), '_', CASE event_id % 6 WHEN 0 THEN 'Front' WHEN 1 THEN 'BACK' WHEN 2 THEN 'left_markers' WHEN 3 THEN 'rightfront' WHEN 4 THEN 'top' ELSE '' END, '.jpg')"


@query(f"""SELECT event_id, name, CASE WHEN contains(lower(name), 'front') THEN 'front' WHEN contains(lower(name), 'back') THEN 'back' WHEN contains(lower(name), 'left') THEN 'left' WHEN contains(lower(name), 'right') THEN 'right' END AS view,
contains(lower(name), 'markers') AS markers, split_part(name, '_', 1) AS subject FROM (SELECT event_id, {VIEW_NAME} AS name FROM events)""")
def view_from_name(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    part = F.when(i % 6 == 0, "Front").when(i % 6 == 1, "BACK").when(i % 6 == 2, "left_markers").when(i % 6 == 3, "rightfront").when(i % 6 == 4, "top").otherwise("")
    e = table(spark, d, "events").select(i, F.concat(i.cast("string"), F.lit("_"), part, F.lit(".jpg")).alias("name"))
    name = F.col("name")
    return e.select("event_id", "name", ids.view_of(name).alias("view"), F.lower(name).contains("markers").alias("markers"), ids.subject_of(name).alias("subject"))


PSEUDO = f"""concat(c_mktsegment, '_', left(sha256(concat('{SALT}', CAST(c_custkey AS VARCHAR))), 8))"""


@query(f"""SELECT {PSEUDO} AS "PSEUDO_ID", c_mktsegment, round(c_acctbal, 6) AS c_acctbal FROM customer""")
def pseudonymize(spark: SparkSession, d: str) -> DataFrame:
    return tidy(pseudonym.pseudonymise(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", "c_custkey", SALT))


@query(f"""SELECT DISTINCT c_mktsegment, c_custkey, {PSEUDO} AS "PSEUDO_ID" FROM customer""")
def pseudo_mapping(spark: SparkSession, d: str) -> DataFrame:
    return pseudonym.mapping(table(spark, d, "customer"), "c_mktsegment", "c_mktsegment", "c_custkey", SALT)


@query("""SELECT c_custkey, list_aggregate(list_sort(list_filter(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], lambda p: NOT list_contains(have, p))), 'string_agg', ';') AS missing
FROM (SELECT o_custkey AS c_custkey, list(DISTINCT o_orderpriority) AS have FROM orders GROUP BY 1) WHERE len(list_filter(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], lambda p: NOT list_contains(have, p))) > 0""")
def missing_views(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    out = tables.missing_views(o, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "c_custkey", "o_orderpriority")
    return out.select("c_custkey", F.array_join("missing", ";").alias("missing"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_subjects(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_subjects(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_anti")


PATH = "concat(CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN 'file:///' ELSE '/' END, repeat(concat('d', o_custkey % 7, '/'), CAST(o_orderkey % 12 AS INT)), CASE WHEN o_orderkey % 2 = 0 THEN './/' ELSE '' END, repeat('../', CAST(o_custkey % 15 AS INT)), 'x/./y/..//', o_orderkey, '.jpg')"


@query(f"""SELECT o_orderkey, CASE WHEN rooted THEN '/' ELSE '' END || array_to_string(kept[2:], '/') AS path FROM (SELECT o_orderkey, p LIKE '/%' AS rooted,
list_reduce([['/']] || list_transform(string_split(p, '/'), lambda x: [x]), lambda a, b: CASE WHEN b[1] IN ('', '.') THEN a WHEN b[1] <> '..' THEN a || b WHEN a[-1] = '/' THEN CASE WHEN p LIKE '/%' THEN a ELSE a || b END WHEN a[-1] = '..' THEN a || b ELSE a[:-2] END) AS kept
FROM (SELECT o_orderkey, regexp_replace({PATH}, '^file:/*', '/') AS p FROM orders))""")
def normal_paths(spark: SparkSession, d: str) -> DataFrame:
    k, who = F.col("o_orderkey"), F.col("o_custkey")
    start = F.when(k % 5 == 0, "").when(k % 5 == 1, "file:///").otherwise("/")
    folders = F.repeat(F.concat(F.lit("d"), (who % 7).cast("string"), F.lit("/")), (k % 12).cast("int"))
    path = F.concat(start, folders, F.when(k % 2 == 0, ".//").otherwise(""), F.repeat(F.lit("../"), (who % 15).cast("int")), F.lit("x/./y/..//"), k.cast("string"), F.lit(".jpg"))
    return table(spark, d, "orders").select(k, ids.normal_path(path).alias("path"))


@query(f"""WITH {CUST} SELECT site, id, round(CASE WHEN site = 'BUILDING' THEN balance + 1000 ELSE balance END, 6) AS balance FROM cust WHERE site IS DISTINCT FROM 'BUILDING' OR balance > 0""")
def site_archive(spark: SparkSession, d: str) -> DataFrame:
    """All sites stored one by one in one place; one of them again with other rows, and once more with none."""
    df, path = customers(spark, d).select("site", "id", "balance"), fresh_path(spark, "archive")
    tables.store(df, path, ["site"])
    again = df.where("site = 'BUILDING' AND balance > 0").withColumn("balance", F.col("balance") + 1000)
    tables.store(again, path, ["site"])
    tables.store(again.where("balance IS NULL"), path, ["site"])
    return tidy(tables.stored(spark, path, df.schema))


# ---- quality control ------------------------------------------------------------

CELLS = CUST + """, cells AS (SELECT rid, site, id, 'balance' AS "column", balance AS value FROM cust UNION ALL SELECT rid, site, id, 'spend', spend FROM cust UNION ALL SELECT rid, site, id, 'AGE', "AGE" FROM cust),
q AS (SELECT site, "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS n FROM cells WHERE value IS NOT NULL AND "column" <> 'AGE' GROUP BY 1, 2),
bounds AS (SELECT site, "column", q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q WHERE n >= 5 AND q3 <> q1),
marked AS (SELECT c.rid, c.site, c.id, c."column", c.value, c.value IS NULL AS miss,
  coalesce((c."column" = 'balance' AND NOT c.value BETWEEN -900 AND 9900) OR (c."column" = 'AGE' AND NOT c.value BETWEEN 0 AND 23), FALSE) AS inv,
  coalesce(c.value < low OR c.value > high, FALSE) AS outl FROM cells c LEFT JOIN bounds b ON b.site IS NOT DISTINCT FROM c.site AND b."column" = c."column"),
rowf AS (SELECT rid, any_value(site) AS site, any_value(id) AS id, concat_ws(';', CASE WHEN bool_or(inv) THEN 'invalid_range' END, CASE WHEN bool_or(miss) THEN 'missing_values' END, CASE WHEN bool_or(outl) THEN 'outlier' END) AS "QC_FLAGS",
  coalesce(string_agg("column", ';' ORDER BY "column") FILTER (miss OR inv OR outl), '') AS "QC_COLUMNS", count(*) FILTER (miss OR inv OR outl) AS "QC_N_FLAGS", bool_or(inv) AS rinv, bool_or(outl) AS routl FROM marked GROUP BY 1)"""


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return qc.flag(customers(spark, d), "site", MEASURES, RANGES)


@query(f"""WITH {CELLS} SELECT site, "column", round(low, 6) AS low, round(high, 6) AS high FROM bounds""")
def qc_iqr_bounds(spark: SparkSession, d: str) -> DataFrame:
    return tidy(qc.iqr_bounds(customers(spark, d), "site", MEASURES))


@query(f"""WITH {CELLS} SELECT site, id, "QC_FLAGS", "QC_COLUMNS", "QC_N_FLAGS" FROM rowf""")
def qc_flags(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).select("site", "id", "QC_FLAGS", "QC_COLUMNS", "QC_N_FLAGS")


def _report(inv: str, outl: str, cells: str = "") -> str:
    return f"""WITH {cells or CELLS}, r AS (SELECT m.site, m."column", count(*) AS n_rows, count(*) FILTER (miss) AS n_missing, count(*) FILTER ({inv}) AS n_invalid_range, count(*) FILTER ({outl}) AS n_outliers
FROM marked m JOIN rowf USING (rid) GROUP BY 1, 2)
SELECT *, round_even(100 * n_missing / n_rows, 2) AS missing_pct, round_even(100 * n_invalid_range / n_rows, 2) AS invalid_range_pct, round_even(100 * n_outliers / n_rows, 2) AS outlier_pct,
CASE WHEN n_missing = 0 THEN 'complete' WHEN 100 * n_missing / n_rows <= 10 THEN 'low_missing' WHEN 100 * n_missing / n_rows <= 25 THEN 'moderate_missing' ELSE 'high_missing' END AS column_status FROM r"""


@query(_report("(miss OR inv OR outl) AND rinv", "(miss OR inv OR outl) AND routl"))
def qc_report_row_level(spark: SparkSession, d: str) -> DataFrame:
    return qc.report(flagged(spark, d), "site")


@query(_report("inv", "outl"))
def qc_report_cell_level(spark: SparkSession, d: str) -> DataFrame:
    return qc.report(flagged(spark, d), "site", "cell_level")


@query(f"""WITH {CELLS} SELECT m.site, m.id, "column", round(value, 6) AS value, "QC_FLAGS" FROM marked m JOIN rowf USING (rid) WHERE miss OR inv OR outl""")
def qc_flagged_values(spark: SparkSession, d: str) -> DataFrame:
    return tidy(qc.flagged_values(flagged(spark, d), "site", "id"))


@query(f"""WITH {CUST} SELECT site, id, round(balance, 6) AS balance, '' AS "IMPUTED_COLUMNS", 0::BIGINT AS "N_IMPUTED_VALUES" FROM cust""")
def qc_pass_through(spark: SparkSession, d: str) -> DataFrame:
    return tidy(qc.pass_through(customers(spark, d).select("site", "id", "balance")))


@query(f"""WITH {CUST}, c AS (SELECT site, 'balance' AS "column", balance AS v FROM cust UNION ALL SELECT site, 'spend', spend FROM cust) SELECT site, "column", count(v) AS n, round(quantile_cont(v, 0.1), 6) AS q10, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.9), 6) AS q90 FROM c WHERE v IS NOT NULL GROUP BY 1, 2""")
def grouped_quantiles(spark: SparkSession, d: str) -> DataFrame:
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in ("balance", "spend"))))
    each = customers(spark, d).select("site", cells.alias("c")).select("site", "c.*")
    out = ranks.quantiles(each, ["site", "column"], "v", [0.1, 0.5, 0.9], "q")
    return tidy(out.select("site", "column", "n", *(F.col("q")[i].alias(f"q{p}") for i, p in enumerate((10, 50, 90)))))


# ---- metrics --------------------------------------------------------------------

ERR = "count(e) AS n, round(avg(e), 6) AS bias, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse"


def errors(spark: SparkSession, d: str) -> DataFrame:
    return estimates(spark, d).withColumn("e", F.col("net") - F.col("truth"))


@query(f"WITH {EST} SELECT view, {ERR} FROM (SELECT *, net - truth AS e FROM est) GROUP BY view")
def error_metrics(spark: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.error_metrics(errors(spark, d), "e", ["view"]))


@query(f"""WITH {EST} SELECT view, {ERR}, round(1 - sum(e * e) / nullif(var_pop(truth) * count(*), 0), 6) AS r2 FROM (SELECT *, net - truth AS e FROM est WHERE net IS NOT NULL) GROUP BY view""")
def error_metrics_r2(spark: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.with_r2(estimates(spark, d), "truth", "net", ["view"]))


@query(f"""WITH {EST} SELECT 'net' AS method, coalesce(view, 'LATERAL_GLOBAL') AS view, count(DISTINCT subject) FILTER (e IS NOT NULL) AS n_subjects, {ERR} FROM (SELECT *, net - truth AS e FROM est) GROUP BY GROUPING SETS ((view), ())""")
def metrics_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.grouping_sets(errors(spark, d).withColumn("method", F.lit("net")), "method", "view", "subject", "e", "LATERAL_GLOBAL"))


@query(f"""WITH {EST} SELECT view, count(*) AS n, round(avg(e), 6) AS bias, round(avg(e) - 1.96 * coalesce(stddev_samp(e), 0), 6) AS low, round(avg(e) + 1.96 * coalesce(stddev_samp(e), 0), 6) AS high, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse
FROM (SELECT *, net - truth AS e FROM est WHERE net IS NOT NULL) GROUP BY view""")
def bland_altman(spark: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.bland_altman(errors(spark, d), "e", ["view"]))


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_tax), 6) AS mean, round(median(l_tax), 6) AS median, round(stddev_samp(l_tax), 6) AS std, round(min(l_tax), 6) AS min, round(max(l_tax), 6) AS max FROM lineitem GROUP BY 1""")
def alignment_stats(spark: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.alignment(table(spark, d, "lineitem"), "l_tax", ["l_returnflag"]))


@query(f"""WITH {EST}, g AS (SELECT view, abs(gross - truth) - abs(net - truth) AS x FROM est WHERE net IS NOT NULL) SELECT view, count(*) AS n, round(avg(x), 6) AS mean_gain, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS improved FROM g GROUP BY 1""")
def improvement_fraction(spark: SparkSession, d: str) -> DataFrame:
    e = estimates(spark, d).withColumns({"b": F.col("gross") - F.col("truth"), "a": F.col("net") - F.col("truth")})
    return tidy(metrics.improvement(e, "b", "a", ["view"]))


MATRIX = EST + """, lab AS (SELECT truth, net, gross, unnest(list_filter([view, CASE WHEN view IN ('1-URGENT', '2-HIGH') THEN 'FRONT+BACK' END, CASE WHEN view IN ('3-MEDIUM', '5-LOW') THEN 'LEFT+RIGHT' END, 'GLOBAL'], lambda x: x IS NOT NULL)) AS grp FROM est),
m AS (SELECT grp, method, count(e) AS n, avg(e) AS bias, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM (SELECT grp, 'net' AS method, net - truth AS e FROM lab UNION ALL SELECT grp, 'gross', gross - truth FROM lab) WHERE e IS NOT NULL GROUP BY 1, 2)"""


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.metric_matrix(estimates(spark, d), {"net": "net", "gross": "gross"}, "truth", "view", GROUPS)


@query(f"WITH {MATRIX} SELECT grp, method, n, round(bias, 6) AS bias, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM m")
def method_matrix(spark: SparkSession, d: str) -> DataFrame:
    return tidy(matrix(spark, d))


@query(f"WITH {MATRIX} SELECT grp, arg_min(method, {{'a': mae, 'b': method}}) AS method, round(min(mae), 6) AS mae FROM m GROUP BY grp")
def best_method(spark: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.best_method(matrix(spark, d)))


@query(f"WITH {MATRIX} SELECT method, sum(n)::BIGINT AS n, round(sum(n * mae) / sum(n), 6) AS mae, round(sqrt(sum(n * rmse * rmse) / sum(n)), 6) AS rmse FROM m WHERE grp LIKE '_-%' GROUP BY 1")
def pooled_metrics(spark: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.pooled(matrix(spark, d).where(F.col("grp").like("_-%")), ["method"]))


@query(f"WITH {IMG} SELECT view, status, count(*) AS n FROM img GROUP BY 1, 2")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.value_counts(images(spark, d), "view", "status")


@query(f"WITH {EST} SELECT subject, round(median(truth), 6) AS truth, round(avg(net), 6) AS mean_estimate, round(median(net), 6) AS median_estimate, count(net) AS n FROM est GROUP BY 1 HAVING count(net) > 0")
def subject_summary(spark: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.subject_summary(estimates(spark, d), "subject", "truth", "net"))


# ---- references -----------------------------------------------------------------

LINES = "ref AS (SELECT l_orderkey, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS ref_no, CASE WHEN l_linenumber % 7 = 6 THEN NULL ELSE l_quantity END AS y, l_discount * 1000 AS x, l_extendedprice / l_quantity / CAST(3.7 AS DOUBLE) AS scale, l_tax AS q FROM lineitem)"


def references(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + i).alias("ref_no"), F.when(i % 7 != 6, F.col("l_quantity")).alias("y"), (F.col("l_discount") * 1000).alias("x"), (F.col("l_extendedprice") / F.col("l_quantity") / F.lit(3.7)).alias("scale"), F.col("l_tax").alias("q"))


@query(f"""WITH {LINES} SELECT l_orderkey, round(median(scale), 3) AS scale, CASE WHEN count(*) >= 2 THEN round(stddev_pop(scale), 3) END AS std, CASE WHEN count(*) >= 2 THEN round(stddev_pop(scale) / nullif(avg(scale), 0), 3) END AS cv, count(*) AS n,
CASE WHEN count(*) >= 2 AND stddev_pop(scale) / nullif(avg(scale), 0) > 0.04 THEN 'low_confidence' ELSE 'ok' END AS status FROM ref GROUP BY 1""")
def scale_summary(spark: SparkSession, d: str) -> DataFrame:
    return tidy(nearest.scale_summary(references(spark, d), ["l_orderkey"], "scale"), 3)


@query(f"""WITH {LINES}, h AS (SELECT l_orderkey, x < 50 AS half, arg_max(scale, {{'a': q, 'b': -ref_no}}) AS s FROM ref GROUP BY 1, 2)
SELECT l_orderkey, CASE WHEN count(*) = 2 THEN round(max(s) / nullif(min(s), 0), 6) END AS ratio, CASE WHEN count(*) = 2 THEN max(s) / nullif(min(s), 0) > 1.35 END AS flagged FROM h GROUP BY 1""")
def perspective_ratio(spark: SparkSession, d: str) -> DataFrame:
    return tidy(nearest.perspective(references(spark, d), ["l_orderkey"], F.col("x") < 50, F.col("q"), "scale", "ref_no"))


@query(f"""WITH {LINES} SELECT l_orderkey, arg_max(ref_no, {{'a': q, 'b': -ref_no}})::BIGINT AS ref_no, round(arg_max(scale, {{'a': q, 'b': -ref_no}}), 6) AS scale FROM ref GROUP BY 1""")
def best_quality_pick(spark: SparkSession, d: str) -> DataFrame:
    return tidy(nearest.best(references(spark, d), ["l_orderkey"], F.col("q"), "ref_no", ["ref_no", "scale"]))


FEET = "feet AS (SELECT o_orderkey AS l_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey % 50 + 0.5 END AS fy, CAST(o_orderkey % 100 AS DOUBLE) AS fx FROM orders)"


def feet(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("l_orderkey"), F.when(k % 13 != 0, F.col("o_custkey") % 50 + F.lit(0.5)).alias("fy"), (k % 100).cast("double").alias("fx"))


def _nearest_sql(distance: str) -> str:
    return f"""WITH {LINES}, {FEET}, p AS (SELECT l_orderkey, ref_no, scale, {distance} AS dist FROM feet JOIN ref USING (l_orderkey)),
b AS (SELECT l_orderkey, arg_min(ref_no, {{'a': dist, 'b': ref_no}})::BIGINT AS ref_no, arg_min(scale, {{'a': dist, 'b': ref_no}}) AS scale, min(dist) AS dist FROM p WHERE dist IS NOT NULL GROUP BY 1)
SELECT l_orderkey, ref_no, round(scale, 6) AS scale, round(dist, 6) AS distance FROM feet LEFT JOIN b USING (l_orderkey)"""


@query(_nearest_sql("abs(CAST(fy AS DOUBLE) - y)"))
def nearest_1d(spark: SparkSession, d: str) -> DataFrame:
    return tidy(nearest.nearest(feet(spark, d), references(spark, d), "l_orderkey", F.abs(F.col("fy") - F.col("y")), "ref_no", ["ref_no", "scale"]).drop("fy", "fx"))


@query(_nearest_sql("sqrt((fx - x) * (fx - x) + (CAST(fy AS DOUBLE) - y) * (CAST(fy AS DOUBLE) - y))"))
def nearest_2d(spark: SparkSession, d: str) -> DataFrame:
    dist = geometry.distance(F.col("fx"), F.col("fy"), F.col("x"), F.col("y"))
    return tidy(nearest.nearest(feet(spark, d), references(spark, d), "l_orderkey", dist, "ref_no", ["ref_no", "scale"]).drop("fy", "fx"))


@query("""WITH a AS (SELECT l_partkey AS p_partkey, avg(l_tax) AS v FROM lineitem WHERE l_quantity >= 50 GROUP BY 1), b AS (SELECT p_brand, avg(p_retailprice) AS v FROM part WHERE p_size > 25 GROUP BY 1), t AS (SELECT p_type, avg(p_retailprice) AS v FROM part GROUP BY 1)
SELECT p.p_partkey, round(coalesce(a.v, CASE WHEN p.p_size > 10 THEN b.v END, t.v), 6) AS v, CASE WHEN a.v IS NOT NULL THEN 'part' WHEN p.p_size > 10 AND b.v IS NOT NULL THEN 'brand' WHEN t.v IS NOT NULL THEN 'type' ELSE 'none' END AS level
FROM part p LEFT JOIN a USING (p_partkey) LEFT JOIN b USING (p_brand) LEFT JOIN t USING (p_type)""")
def cascading_lookup(spark: SparkSession, d: str) -> DataFrame:
    p, li = table(spark, d, "part"), table(spark, d, "lineitem")
    a = li.where("l_quantity >= 50").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_tax").alias("v"))
    b = p.where("p_size > 25").groupBy(F.col("p_brand").alias("brand")).agg(F.avg("p_retailprice").alias("v"))
    t = p.groupBy("p_type").agg(F.avg("p_retailprice").alias("v"))
    rows = p.select("p_partkey", "p_type", F.when(F.col("p_size") > 10, F.col("p_brand")).alias("brand"))
    return tidy(nearest.cascade(rows, [("part", a, ["p_partkey"]), ("brand", b, ["brand"]), ("type", t, ["p_type"])], "v").select("p_partkey", "v", "level"))


@query("""SELECT o_custkey AS subject, arg_min(o_totalprice, o_orderkey) AS truth FROM orders GROUP BY 1""")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), "o_orderkey", F.col("o_totalprice").alias("truth"))
    return nearest.first_match(o, ["subject"], "o_orderkey").select("subject", "truth")


# ---- calibration and sweeps -----------------------------------------------------

LOO = GAPS + """, s AS (SELECT view, count(*) AS n, avg(net) AS mx, avg(truth) AS my, var_pop(net) AS vx, covar_pop(truth, net) AS cxy FROM gaps WHERE net IS NOT NULL AND truth IS NOT NULL GROUP BY 1),
loo AS (SELECT o_orderkey, view, truth, net, CASE WHEN net IS NULL OR truth IS NULL OR n IS NULL THEN NULL WHEN n < 8 THEN net ELSE my - (truth - my) / (n - 1) + (n * cxy - n / (n - 1) * (net - mx) * (truth - my)) / (n * vx - n / (n - 1) * (net - mx) * (net - mx)) * ((net - mx) + (net - mx) / (n - 1)) END AS corrected
FROM (SELECT o_orderkey, gaps.view, truth, net, CAST(n AS DOUBLE) AS n, mx, my, vx, cxy FROM gaps LEFT JOIN s ON s.view = gaps.view))"""


@query(f"WITH {LOO} SELECT o_orderkey, view, round(corrected, 4) AS corrected FROM loo")
def loo_linear_calibration(spark: SparkSession, d: str) -> DataFrame:
    return tidy(calibrate.leave_one_out(gaps(spark, d), "net", "truth", ["view"]).select("o_orderkey", "view", "corrected"), 4)


@query(f"""WITH {LOO} SELECT coalesce(view, 'GLOBAL') AS view, count(*) AS n, round(avg(net - truth), 4) AS bias_before, round(avg(abs(net - truth)), 4) AS mae_before, round(sqrt(avg((net - truth) * (net - truth))), 4) AS rmse_before,
round(avg(corrected - truth), 4) AS bias_after, round(avg(abs(corrected - truth)), 4) AS mae_after, round(sqrt(avg((corrected - truth) * (corrected - truth))), 4) AS rmse_after FROM loo WHERE corrected IS NOT NULL GROUP BY GROUPING SETS ((view), ())""")
def calibration_before_after(spark: SparkSession, d: str) -> DataFrame:
    out = calibrate.leave_one_out(gaps(spark, d), "net", "truth", ["view"])
    return tidy(calibrate.before_after(out, "truth", "net", "corrected", "view"), 4)


FACTORS = calibrate.FACTORS
SWEEP = EST + f""", sw AS (SELECT factor, {ERR} FROM (SELECT factor, net * factor - truth AS e FROM est, (SELECT CAST(unnest([{", ".join(map(str, FACTORS))}]) AS DOUBLE) AS factor)) GROUP BY 1)"""


def swept(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.sweep(estimates(spark, d), FACTORS, "factor", F.col("net") * F.col("factor") - F.col("truth"))


@query(f"WITH {SWEEP} SELECT * FROM sw")
def param_sweep(spark: SparkSession, d: str) -> DataFrame:
    return tidy(swept(spark, d))


@query(f"WITH {SWEEP} SELECT arg_min(factor, {{'a': mae, 'b': factor}}) AS factor, min(mae) AS mae FROM sw")
def sweep_best(spark: SparkSession, d: str) -> DataFrame:
    return tidy(calibrate.best_value(swept(spark, d), "factor"))


# ---- horizons -------------------------------------------------------------------

FB = "view IN ('front', 'back') AND ok"
LOSO = IMG + f""", fb AS (SELECT subject, y FROM img WHERE {FB}), la AS (SELECT subject, y FROM img WHERE view IN ('left', 'right') AND ok), subj AS (SELECT DISTINCT subject FROM img),
gfb AS (SELECT s.subject, median(CASE WHEN fb.subject <> s.subject THEN fb.y END) AS v FROM subj s, fb GROUP BY 1), gl AS (SELECT s.subject, median(CASE WHEN la.subject <> s.subject THEN la.y END) AS v FROM subj s, la GROUP BY 1),
sfb AS (SELECT subject, median(y) AS v FROM fb GROUP BY 1), sl AS (SELECT subject, median(y) AS v FROM la GROUP BY 1)"""
HIER = LOSO + """, c AS (SELECT img.event_id, img.view, CASE WHEN ok THEN y END AS own, sfb.v AS sfb, sl.v AS sl, gfb.v AS gfb, gl.v AS gl FROM img LEFT JOIN sfb USING (subject) LEFT JOIN sl USING (subject) LEFT JOIN gfb USING (subject) LEFT JOIN gl USING (subject)),
hier AS (SELECT event_id, view, coalesce(sfb, gfb) AS shared, CASE WHEN sfb IS NOT NULL THEN 'subject_front_back' ELSE 'global_front_back_fallback_loo' END AS shared_source, gfb, gl, CASE WHEN view IN ('front', 'back') THEN CASE WHEN sfb IS NOT NULL THEN {'y': sfb, 's': 'subject_front_back', 'r': 'high'} WHEN own IS NOT NULL THEN {'y': own, 's': 'per_image_cube_front_back_fallback', 'r': 'medium'} WHEN gfb IS NOT NULL THEN {'y': gfb, 's': 'global_front_back_fallback_loo', 'r': 'low'} WHEN gl IS NOT NULL THEN {'y': gl, 's': 'global_lateral_last_resort_loo', 'r': 'very_low'} ELSE {'y': NULL, 's': 'no_valid_horizon', 'r': 'unavailable'} END
WHEN view IN ('left', 'right') THEN CASE WHEN own IS NOT NULL THEN {'y': own, 's': 'per_image_cube_lateral', 'r': 'high'} WHEN sl IS NOT NULL THEN {'y': sl, 's': 'paired_lateral_subject_fallback', 'r': 'medium'} WHEN coalesce(sfb, gfb) IS NOT NULL THEN {'y': coalesce(sfb, gfb), 's': 'subject_front_back_lateral_fallback', 'r': 'medium'} WHEN gl IS NOT NULL THEN {'y': gl, 's': 'global_lateral_fallback_loo', 'r': 'low'} ELSE {'y': NULL, 's': 'no_valid_horizon', 'r': 'unavailable'} END
ELSE CASE WHEN own IS NOT NULL THEN {'y': own, 's': 'per_image_cube_unknown_view', 'r': 'medium'} WHEN coalesce(sfb, gfb) IS NOT NULL THEN {'y': coalesce(sfb, gfb), 's': 'shared_unknown_view_fallback', 'r': 'low'} WHEN gl IS NOT NULL THEN {'y': gl, 's': 'global_lateral_unknown_view_fallback_loo', 'r': 'very_low'} ELSE {'y': NULL, 's': 'no_valid_horizon', 'r': 'unavailable'} END END AS p FROM c)"""


@query(f"""WITH {IMG}, own AS (SELECT subject, median(y) AS v FROM img WHERE {FB} GROUP BY 1), g AS (SELECT median(y) AS v FROM img WHERE {FB})
SELECT event_id, round(coalesce(own.v, g.v), 6) AS shared, CASE WHEN own.v IS NOT NULL THEN 'subject' WHEN g.v IS NOT NULL THEN 'global' END AS shared_source FROM img LEFT JOIN own USING (subject), g""")
def shared_reference(spark: SparkSession, d: str) -> DataFrame:
    return tidy(horizon.shared(images(spark, d), "subject", "y", donor()).select("event_id", "shared", "shared_source"))


@query(f"WITH {LOSO} SELECT subject, round(v, 6) AS loso FROM gfb")
def loso_median(spark: SparkSession, d: str) -> DataFrame:
    i = images(spark, d)
    return tidy(horizon.loso_median(i.where(donor()), i, "subject", "y"))


def corrected(spark: SparkSession, d: str) -> DataFrame:
    return horizon.correct(images(spark, d), "subject", "view", "y", "status", "h")


@query(f"""WITH {HIER} SELECT event_id, round(shared, 6) AS y_horizon_shared, shared_source AS horizon_shared_source, round(gfb, 6) AS y_global_front_back_loo, round(gl, 6) AS y_global_lateral_loo,
round(p.y, 6) AS y_horizon_corrected, p.s AS horizon_corrected_source, p.r AS height_reliability FROM hier""")
def horizon_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return tidy(corrected(spark, d).drop("subject", "view", "y", "status", "h"))


@query(f"WITH {HIER} SELECT view, p.s AS horizon_corrected_source, p.r AS height_reliability, count(*) AS n FROM hier GROUP BY 1, 2, 3")
def horizon_sources(spark: SparkSession, d: str) -> DataFrame:
    return metrics.value_counts(corrected(spark, d), "view", "horizon_corrected_source", "height_reliability")


HEIGHTS = "g AS (SELECT l_orderkey, l_linenumber, 100 + l_quantity AS feet, l_discount * 1000 AS head, CAST(l_linenumber AS DOUBLE) * 25 AS hor, l_tax * 1000 AS cam, CAST(l_suppkey % 50 + 110 AS DOUBLE) AS mask FROM lineitem)"


def poses(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (100 + c("l_quantity")).alias("feet"), (c("l_discount") * 1000).alias("head"), (c("l_linenumber") * F.lit(25.0)).alias("hor"), (c("l_tax") * 1000).alias("cam"), (c("l_suppkey") % 50 + 110).cast("double").alias("mask"))


def _height(variant: str) -> None:
    extra = {"a": "TRUE", "b": "feet - head > 0", "c": "feet - head > 0 AND feet - hor > 0 AND cam > 0"}[variant]
    sql = f"WITH {HEIGHTS}, v AS (SELECT *, CASE WHEN abs(feet - hor) > 1e-6 AND {extra} THEN cam * ((feet - head) / (feet - hor)) END AS h FROM g) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(h, 6) AS h, h > 40 AND h < 230 AS ok FROM v"

    def f(spark: SparkSession, d: str) -> DataFrame:
        c = F.col
        p = poses(spark, d).withColumn("h", geometry.height(c("cam"), c("feet"), c("head"), c("hor"), variant))
        return tidy(p.select("l_orderkey", "l_linenumber", "h", geometry.plausible(c("h")).alias("ok")))

    f.__name__ = f"horizon_height_{variant}"
    query(sql)(f)


for _v in "abc":
    _height(_v)


@query(f"""WITH {HEIGHTS}, f AS (SELECT l_orderkey, l_linenumber, 'single' AS foot, cam * ((feet - head) / (feet - hor)) AS h, abs(feet - hor) > 1e-6 AND feet > head AS fine FROM g UNION ALL SELECT l_orderkey, l_linenumber, 'mask', CASE WHEN mask <> hor THEN cam * ((mask - head) / (mask - hor)) END, abs(mask - hor) > 1e-6 AND mask > head FROM g WHERE TRUE)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, foot, round(CASE WHEN fine THEN h END, 6) AS h FROM f""")
def foot_variants(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    feet_ = F.explode(F.array(F.struct(F.lit("single").alias("foot"), c("feet").alias("y")), F.struct(F.lit("mask").alias("foot"), c("mask").alias("y"))))
    p = poses(spark, d).select("*", feet_.alias("f"))
    return tidy(p.select("l_orderkey", "l_linenumber", "f.foot", geometry.height(c("cam"), c("f.y"), c("head"), c("hor"), "b").alias("h")))


@query(f"""WITH {HEIGHTS} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(CASE WHEN hor - head > 0 THEN feet - cam * (feet - head) / (hor - head) END, 6) AS y, round(least(greatest(feet - 1.2 * cam, head), feet - 1), 6) AS crown, round(CASE WHEN abs(mask - head) <= 0.12 * (feet - head) THEN mask ELSE head END, 6) AS moved, CASE WHEN abs(mask - head) <= 0.12 * (feet - head) THEN 'mask_trim_hair' ELSE 'pose' END AS source,
round(CASE WHEN abs(mask - head) <= 0.3 * (feet - head) THEN CASE WHEN l_linenumber % 2 = 0 THEN greatest(mask, head - 5) ELSE mask END ELSE head END, 6) AS capped, CASE WHEN abs(mask - head) > 0.3 * (feet - head) THEN 'pose' WHEN l_linenumber % 2 = 0 THEN 'mask_trim_hair_capped' ELSE 'mask_trim_hair' END AS capped_source,
round(1 - abs(abs(degrees(atan2(mask - feet, hor - head))) % 180 - 90) / 90, 6) AS upright FROM g""")
def landmarks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    p = poses(spark, d)
    free = geometry.corrected_head(F.lit("left"), c("head"), c("mask"), c("feet"), rise_px=None)
    capped = geometry.corrected_head(F.when(c("l_linenumber") % 2 == 0, "left").otherwise("front"), c("head"), c("mask"), c("feet"), 0.3, 5.0)
    return tidy(p.select("l_orderkey", "l_linenumber", geometry.horizon(c("feet"), c("head"), c("cam"), c("hor") - c("head")).alias("y"), geometry.crown(c("feet"), c("cam"), F.lit(1.2), c("head")).alias("crown"), free["head_y"].alias("moved"), free["head_source"].alias("source"), capped["head_y"].alias("capped"), capped["head_source"].alias("capped_source"), geometry.verticality(c("head"), c("feet"), c("hor"), c("mask")).alias("upright")))


# ---- fusion ---------------------------------------------------------------------


@query(f"""WITH {IMG} SELECT subject, count(*) AS n, round(avg(y), 6) AS mean, round(median(y), 6) AS median, round(CASE WHEN count(*) >= 2 THEN max(y) - min(y) END, 6) AS range, round(CASE WHEN count(*) >= 2 THEN stddev_pop(y) ELSE 0 END, 6) AS std, bool_or(view = 'left') AS has_left, bool_or(view = 'right') AS has_right,
round(abs(median(y) FILTER (view = 'left') - median(y) FILTER (view = 'right')), 6) AS lr_diff FROM img WHERE view IN ('left', 'right') AND y IS NOT NULL GROUP BY 1""")
def subject_fusion(spark: SparkSession, d: str) -> DataFrame:
    return tidy(fuse.subjects(images(spark, d), "subject", "view", "y"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT c_nationkey::BIGINT AS c_nationkey, " + ", ".join(f"""round(median(o_totalprice) FILTER (o_orderpriority = '{p}'), 6) AS "{p}\"""" for p in PRIORITIES) + " FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def pivot_median(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return tidy(fuse.pivot_median(o, "c_nationkey", "o_orderpriority", PRIORITIES, "o_totalprice"))


CHAIN = """s AS (SELECT vec_id, list_filter(list_transform(embedding[1:4], lambda x: abs(CAST(x AS DOUBLE)) * 4), lambda c: c >= 0.25) AS l, list_filter(list_transform(embedding[5:8], lambda x: abs(CAST(x AS DOUBLE)) * 4), lambda c: c >= 0.25) AS r FROM embeddings),
k AS (SELECT vec_id, len(l) AS ln, coalesce(list_min(l), 0) AS lm, round(coalesce(list_avg(l), 0), 12) AS la, len(r) AS rn, coalesce(list_min(r), 0) AS rm, round(coalesce(list_avg(r), 0), 12) AS ra FROM s)"""


@query(f"WITH {CHAIN} SELECT vec_id, CASE WHEN ln > rn OR (ln = rn AND (lm > rm OR (lm = rm AND la > ra))) THEN 'left' ELSE 'right' END AS side FROM k")
def visible_side(spark: SparkSession, d: str) -> DataFrame:
    conf = lambda i: F.transform(F.slice("embedding", i, 4), lambda x: F.abs(x.cast("double")) * 4)
    return table(spark, d, "embeddings").select("vec_id", fuse.visible_side(conf(1), conf(5)).alias("side"))


@query("""SELECT l_orderkey, arg_max(l_linenumber, {'s': l_discount * least(l_tax / 0.15, 1), 'o': -l_linenumber})::BIGINT AS l_linenumber FROM lineitem GROUP BY 1""")
def best_person(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return tidy(fuse.best_person(li, "l_orderkey", "l_discount", "l_tax", "l_linenumber").select("l_orderkey", "l_linenumber"))


@query(f"""WITH {CHAIN}, p AS (SELECT vec_id, label, CASE WHEN ln > rn OR (ln = rn AND (lm > rm OR (lm = rm AND la > ra))) THEN 'left' ELSE 'right' END AS side FROM k JOIN embeddings USING (vec_id)),
c AS (SELECT vec_id, label, side, list_transform(embedding[(CASE WHEN side = 'left' THEN 1 ELSE 5 END):(CASE WHEN side = 'left' THEN 4 ELSE 8 END)], lambda x: CAST(x AS DOUBLE)) AS e FROM p JOIN embeddings USING (vec_id, label)),
q AS (SELECT vec_id, label, side, e, list_min(list_transform(e, lambda x: abs(x) * 4)) AS least, list_avg(list_transform(e, lambda x: abs(x) * 4)) AS mean FROM c),
r AS (SELECT *, CASE WHEN label = 0 THEN 'invalid_body_height_px' WHEN least < 0.25 THEN 'incomplete_pose_chain' ELSE 'ok' END AS status, sqrt(pow(100 * (e[1] - e[2]), 2) + pow(50 * (e[1] - e[2]), 2)) AS s1, sqrt(pow(100 * (e[2] - e[3]), 2) + pow(50 * (e[2] - e[3]), 2)) AS s2, sqrt(pow(100 * (e[3] - e[4]), 2) + pow(50 * (e[3] - e[4]), 2)) AS s3 FROM q)
SELECT vec_id, CASE WHEN ok THEN side END AS pose_side, round(CASE WHEN ok THEN least END, 6) AS min_confidence, round(CASE WHEN ok THEN mean END, 6) AS mean_confidence, round(CASE WHEN ok THEN s1 END, 6) AS shoulder_hip_px, round(CASE WHEN ok THEN s2 END, 6) AS hip_knee_px, round(CASE WHEN ok THEN s3 END, 6) AS knee_ankle_px,
round(CASE WHEN ok THEN s1 / (label * 100) END, 6) AS shoulder_hip_ratio, round(CASE WHEN ok THEN s2 / (label * 100) END, 6) AS hip_knee_ratio, round(CASE WHEN ok THEN s3 / (label * 100) END, 6) AS knee_ankle_ratio, status FROM (SELECT *, status = 'ok' AS ok FROM r)""")
def skeletal_features(spark: SparkSession, d: str) -> DataFrame:
    part = lambda i: F.transform(F.slice("embedding", i, 4), lambda x: F.struct((x.cast("double") * 100).alias("x"), (x.cast("double") * 50).alias("y"), (F.abs(x.cast("double")) * 4).alias("conf")))
    p = table(spark, d, "embeddings").select("vec_id", (F.col("label") * 100).alias("body"), part(1).alias("l"), part(5).alias("r"))
    return tidy(fuse.skeletal(p, "l", "r", "body").drop("body", "l", "r"))


@query(f"""WITH {HEIGHTS}, v AS (SELECT *, CASE WHEN abs(feet - hor) > 1e-6 AND feet > head AND feet > hor AND cam > 0 THEN cam * ((feet - head) / (feet - hor)) END AS ho, CASE WHEN abs(feet - mask) > 1e-6 AND feet > head AND feet > mask AND cam > 0 THEN cam * ((feet - head) / (feet - mask)) END AS hs FROM g)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(ho, 6) AS h_own, round(hs, 6) AS h_shared, round(ho - 170, 6) AS error_own, round(hs - 170, 6) AS error_shared, round(abs(ho - 170), 6) AS abs_error_own, round(abs(hs - 170), 6) AS abs_error_shared, round(abs(hs - 170) - abs(ho - 170), 6) AS improvement, round(hor - mask, 6) AS delta_px, round(CASE WHEN feet > 120 THEN (hor - mask) / (feet - 120) END, 6) AS delta_share FROM v""")
def lateral_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    p = poses(spark, d).withColumns({"truth": F.lit(170.0), "img_h": F.col("feet") - 120})
    return tidy(horizon.diagnose(p, "cam", "feet", "head", "hor", "mask", "truth", "img_h").drop("cam", "feet", "head", "hor", "mask", "truth", "img_h"))


# ---- masks ----------------------------------------------------------------------

RUNS = """runs AS (SELECT l_orderkey AS img, (l_linenumber * 4 + k) AS y, 40 + l_partkey % 10 AS x0, 40 + l_partkey % 10 + CAST(l_quantity AS BIGINT) AS x1 FROM lineitem, (SELECT unnest(range(4)) AS k)),
px AS (SELECT img, y, unnest(range(x0, x1 + 1)) AS x FROM runs),
ext AS (SELECT img, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, count(*) AS area FROM px GROUP BY 1)"""
FEET_OF = """ankles AS (SELECT o_orderkey AS img, unnest(['left', 'right']) AS ankle, unnest([45.0::DOUBLE + o_custkey % 20, 60.5::DOUBLE + o_custkey % 30]) AS ax, unnest([4.0::DOUBLE + o_custkey % 24, 20.0::DOUBLE]) AS ay, (o_custkey % 200)::DOUBLE AS w, CASE WHEN o_custkey % 3 = 0 THEN 'left' WHEN o_custkey % 3 = 1 THEN 'front' ELSE 'back' END AS view FROM orders),
sel AS (SELECT a.*, p.x, p.y, e.y_max - e.y_min + 1 AS body FROM ankles a JOIN px p USING (img) JOIN ext e USING (img) WHERE abs(p.x - a.ax) <= greatest(0.12::DOUBLE * w, 15)),
low AS (SELECT img, ankle, max(y) AS lowest, any_value(ax) AS ax, any_value(ay) AS ay, any_value(body) AS body FROM sel GROUP BY 1, 2 HAVING count(*) >= 5),
gr AS (SELECT *, CASE WHEN lowest > ay + 0.08::DOUBLE * body THEN trunc(ay + 0.08::DOUBLE * body) ELSE lowest END AS gy, greatest(trunc(0.02::DOUBLE * body), 4) AS band FROM low),
con AS (SELECT g.img, g.ankle, (CASE WHEN count(s.x) > 0 THEN trunc(median(s.x)) ELSE round_even(any_value(g.ax), 0) END)::BIGINT AS contact_x, any_value(gy)::BIGINT AS contact_y FROM gr g LEFT JOIN sel s ON s.img = g.img AND s.ankle = g.ankle AND s.y BETWEEN gy - band AND gy GROUP BY 1, 2)"""


def runs_of(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    lines = table(spark, d, "lineitem").select(c("l_orderkey").alias("img"), (c("l_linenumber") * 4).alias("y"), (40 + c("l_partkey") % 10).alias("x0"), (40 + c("l_partkey") % 10 + c("l_quantity").cast("long")).alias("x1"))
    return lines.select("img", F.explode(F.sequence(c("y"), c("y") + 3)).alias("y"), "x0", "x1")


def contacts_of(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    sides = F.explode(F.array(F.struct(F.lit("left").alias("ankle"), (45.0 + c("o_custkey") % 20).alias("x"), (4.0 + c("o_custkey") % 24).alias("y")), F.struct(F.lit("right").alias("ankle"), (60.5 + c("o_custkey") % 30).alias("x"), F.lit(20.0).alias("y"))))
    ankles = table(spark, d, "orders").select(c("o_orderkey").alias("img"), (c("o_custkey") % 200).cast("double").alias("bbox_w"), sides.alias("s")).select("img", "bbox_w", "s.*")
    return mask.contact(runs_of(spark, d), ankles, "img")


@query(f"WITH {RUNS} SELECT p.img, round(median(x), 6) AS feet_x, any_value(y_max)::BIGINT AS feet_y FROM px p JOIN ext e ON e.img = p.img WHERE y > y_max - 5 GROUP BY 1")
def mask_feet(spark: SparkSession, d: str) -> DataFrame:
    return tidy(mask.feet(runs_of(spark, d), "img"))


@query(f"""WITH {RUNS}, wide AS (SELECT img, y, min(x0) AS l, max(x1) AS r, max(x1) - min(x0) + 1 AS w FROM runs GROUP BY 1, 2),
head AS (SELECT w.*, row_number() OVER (PARTITION BY img ORDER BY w DESC) AS k, count(*) OVER (PARTITION BY img) AS n FROM wide w JOIN ext e USING (img) WHERE y <= floor(y_min + 0.12::DOUBLE * (y_max - y_min))),
skull AS (SELECT img, median(w) AS sw FROM head WHERE k <= greatest(1, n // 3) GROUP BY 1)
SELECT img, round(arg_min((l + r) / 2.0::DOUBLE, y), 6) AS head_x, min(y)::BIGINT AS head_y, round(any_value(sw), 6) AS skull_width FROM head JOIN skull USING (img) WHERE w >= 0.5::DOUBLE * sw GROUP BY 1""")
def mask_head(spark: SparkSession, d: str) -> DataFrame:
    return tidy(mask.head(runs_of(spark, d), "img"))


@query(f"""WITH {RUNS}, p AS (SELECT DISTINCT img, y, x FROM px), d1 AS (SELECT DISTINCT img, y, x + k AS x FROM p, (SELECT unnest([-1, 0, 1]) AS k)), d2 AS (SELECT DISTINCT img, y + k AS y, x FROM d1, (SELECT unnest([-1, 0, 1]) AS k)),
e1 AS (SELECT img, y, x FROM d2 WINDOW w AS (PARTITION BY img, y ORDER BY x) QUALIFY lag(x) OVER w = x - 1 AND lead(x) OVER w = x + 1), c AS (SELECT img, y, x FROM e1 WINDOW w AS (PARTITION BY img, x ORDER BY y) QUALIFY lag(y) OVER w = y - 1 AND lead(y) OVER w = y + 1),
e3 AS (SELECT img, y, x FROM c WINDOW w AS (PARTITION BY img, y ORDER BY x) QUALIFY lag(x) OVER w = x - 1 AND lead(x) OVER w = x + 1), e4 AS (SELECT img, y, x FROM e3 WINDOW w AS (PARTITION BY img, x ORDER BY y) QUALIFY lag(y) OVER w = y - 1 AND lead(y) OVER w = y + 1),
d3 AS (SELECT DISTINCT img, y, x + k AS x FROM e4, (SELECT unnest([-1, 0, 1]) AS k)), o AS (SELECT DISTINCT img, y + k AS y, x FROM d3, (SELECT unnest([-1, 0, 1]) AS k)), m AS (SELECT *, lag(x) OVER (PARTITION BY img, y ORDER BY x) IS DISTINCT FROM x - 1 AS begun FROM o)
SELECT img, count(*) FILTER (begun) AS runs, count(*) AS area, sum(x)::BIGINT AS xs, sum(y)::BIGINT AS ys, sum(x * y)::BIGINT AS xys FROM m GROUP BY 1""")
def mask_closed_opened(spark: SparkSession, d: str) -> DataFrame:
    """Closing and opening by squares of 3, summed up over the pixels of the runs that are left."""
    r = mask.morphed(runs_of(spark, d), [("dilate", 3), ("erode", 3), ("erode", 3), ("dilate", 3)], "img")
    n, total = F.col("x1") - F.col("x0") + 1, (F.col("x0") + F.col("x1")) * (F.col("x1") - F.col("x0") + 1) / 2
    return tidy(r.groupBy("img").agg(F.count("*").alias("runs"), F.sum(n).alias("area"), F.sum(total).cast("long").alias("xs"), F.sum(F.col("y") * n).alias("ys"), F.sum(F.col("y") * total).cast("long").alias("xys")))


@query(f"WITH {RUNS}, {FEET_OF} SELECT img, ankle, contact_x, contact_y FROM con")
def mask_contact(spark: SparkSession, d: str) -> DataFrame:
    return tidy(contacts_of(spark, d))


@query(f"""WITH {RUNS}, {FEET_OF}, s AS (SELECT img, count(*) >= 2 AND any_value(view) IN ('front', 'back') AS b, avg(contact_x) AS mx, avg(contact_y) AS my, arg_max(contact_x, {{'y': contact_y, 'l': ankle = 'left'}}) AS x, max(contact_y) AS y FROM con JOIN (SELECT DISTINCT img, view FROM ankles) USING (img) GROUP BY 1)
SELECT img, (CASE WHEN b THEN round_even(mx, 0) ELSE x END)::BIGINT AS feet_x, (CASE WHEN b THEN round_even(my, 0) ELSE y END)::BIGINT AS feet_y, CASE WHEN b THEN 'pose_midfeet' ELSE 'pose_singlefoot' END AS source FROM s""")
def mask_support(spark: SparkSession, d: str) -> DataFrame:
    third = F.col("o_custkey") % 3
    views = table(spark, d, "orders").select(F.col("o_orderkey").alias("img"), F.when(third == 0, "left").when(third == 1, "front").otherwise("back").alias("view"))
    return tidy(mask.support(contacts_of(spark, d).join(views, "img"), "img"))


@query(f"""WITH {RUNS}, t AS (SELECT *, y_max - y_min AS h, greatest(trunc(0.03::DOUBLE * (y_max - y_min)), 4) AS band FROM px JOIN ext USING (img) WHERE y_max > y_min),
ax AS (SELECT img, coalesce(median(x) FILTER (y > y_min + 0.3::DOUBLE * h AND y < y_min + 0.6::DOUBLE * h), median(x)) AS a FROM t GROUP BY 1),
m AS (SELECT img, count(*) FILTER (y <= y_min + band AND abs(x - a) <= 0.18::DOUBLE * (x_max - x_min + 1)) AS n, median(x) FILTER (y <= y_min + band AND abs(x - a) <= 0.18::DOUBLE * (x_max - x_min + 1)) AS near, median(x) FILTER (y <= y_min + band) AS anywhere, median(x) FILTER (y >= y_max - band) AS bottom FROM t JOIN ax USING (img) GROUP BY 1)
SELECT img, trunc(CASE WHEN n >= 3 THEN near ELSE anywhere END)::BIGINT AS head_x, y_min::BIGINT AS head_y, trunc(bottom)::BIGINT AS feet_x, y_max::BIGINT AS feet_y, (y_max - y_min)::DOUBLE AS height_px, area::BIGINT AS area, CASE WHEN y_max > y_min THEN 'ok' ELSE 'invalid_height_px' END AS status FROM ext LEFT JOIN m USING (img)""")
def mask_head_and_feet(spark: SparkSession, d: str) -> DataFrame:
    return tidy(mask.head_and_feet(runs_of(spark, d), "img"))


@query("SELECT c_custkey::VARCHAR || '_' || lower(c_mktsegment) || '.jpg' AS path, c_custkey::VARCHAR AS subject, '/images/' || c_custkey::VARCHAR || '/' || c_custkey::VARCHAR || '_' || lower(c_mktsegment) || '.jpg' AS target_path FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def image_manifest(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    assets = table(spark, d, "customer").select(F.concat(c("c_custkey").cast("string"), F.lit("_"), F.lower("c_mktsegment"), F.lit(".jpg")).alias("path"), c("c_custkey").cast("string").alias("subject"))
    accepted = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(c("o_custkey").alias("subject"))
    return tables.manifest(assets, accepted, "/images/", "subject", "path")


# ---- nearest neighbours ---------------------------------------------------------

Z = VEC + ", z AS (SELECT vec_id, label, " + ", ".join(f"e{i}, (e{i} - avg(e{i}) OVER w) / nullif(stddev_pop(e{i}) OVER w, 0) AS z{i}" for i in range(1, 9)) + " FROM vec WINDOW w AS (PARTITION BY label))"
TERMS = ", ".join(f"(a.z{i} - b.z{i}) * (a.z{i} - b.z{i}) AS t{i}" for i in range(1, 9))
SUM8, CNT8 = " + ".join(f"coalesce(t{i}, 0)" for i in range(1, 9)), " + ".join(f"(t{i} IS NOT NULL)::INT" for i in range(1, 9))
PAIRS = Z + f""", pr AS (SELECT a.label, a.vec_id, b.vec_id AS donor, {", ".join(f"a.e{i} AS v{i}, b.e{i} AS d{i}" for i in range(1, 9))}, {TERMS} FROM z a JOIN z b ON a.label = b.label AND a.vec_id <> b.vec_id),
ps AS (SELECT *, {SUM8} AS s, {CNT8} AS m FROM pr)"""
TARGETS = ["e4", "e5", "e6"]


@query(f"WITH {Z} SELECT vec_id, label, " + ", ".join(f"round(z{i}, 6) AS z_e{i}" for i in range(1, 9)) + " FROM z")
def zscore_strata(spark: SparkSession, d: str) -> DataFrame:
    return tidy(knn.zscores(vectors(spark, d), ["label"], DIMS).select("vec_id", "label", *("z_" + c for c in DIMS)))


@query(f"WITH {PAIRS} SELECT label::BIGINT AS label, vec_id, donor, round(CASE WHEN m > 0 THEN sqrt(8.0 / m * s) END, 6) AS distance FROM ps")
def nan_distance(spark: SparkSession, d: str) -> DataFrame:
    # rounded in doubles, as the SQL does; with decimals that takes longer than making the pairs
    return knn.nan_distance(vectors(spark, d), ["label"], "vec_id", DIMS).withColumn("distance", F.floor(F.col("distance") * 1e6 + 0.5) / 1e6)


IMP = PAIRS + ", imp AS (" + " UNION ALL ".join(f"""SELECT label, vec_id, 'e{i}' AS "column", median(d{i}) AS value FROM (SELECT label, vec_id, d{i}, row_number() OVER (PARTITION BY label, vec_id ORDER BY sqrt(8.0 / m * s), donor) AS rn FROM ps WHERE m > 0 AND v{i} IS NULL AND d{i} IS NOT NULL) WHERE rn <= 3 GROUP BY 1, 2""" for i in (4, 5, 6)) + ")"


@query(f"""WITH {IMP} SELECT label::BIGINT AS label, vec_id, "column", round(value, 6) AS value FROM imp""")
def knn_impute(spark: SparkSession, d: str) -> DataFrame:
    return tidy(knn.impute(vectors(spark, d), ["label"], "vec_id", DIMS, TARGETS))


@query(f"""WITH {IMP}, w AS (SELECT vec_id, max(value) FILTER ("column" = 'e4') AS i4, max(value) FILTER ("column" = 'e5') AS i5, max(value) FILTER ("column" = 'e6') AS i6 FROM imp GROUP BY 1)
SELECT vec_id, round(coalesce(e4, i4), 6) AS e4, round(coalesce(e5, i5), 6) AS e5, round(coalesce(e6, i6), 6) AS e6, e4 IS NULL AND i4 IS NOT NULL AS e4_was_imputed, e5 IS NULL AND i5 IS NOT NULL AS e5_was_imputed, e6 IS NULL AND i6 IS NOT NULL AS e6_was_imputed,
concat_ws(';', CASE WHEN e4 IS NULL AND i4 IS NOT NULL THEN 'e4' END, CASE WHEN e5 IS NULL AND i5 IS NOT NULL THEN 'e5' END, CASE WHEN e6 IS NULL AND i6 IS NOT NULL THEN 'e6' END) AS "IMPUTED_COLUMNS", ((e4 IS NULL AND i4 IS NOT NULL)::INT + (e5 IS NULL AND i5 IS NOT NULL)::INT + (e6 IS NULL AND i6 IS NOT NULL)::INT)::BIGINT AS "N_IMPUTED_VALUES" FROM vec LEFT JOIN w USING (vec_id)""")
def knn_complete(spark: SparkSession, d: str) -> DataFrame:
    v = knn.numbered(vectors(spark, d), "row")
    out = knn.complete(v, knn.impute(v, ["label"], "vec_id", DIMS, TARGETS, row="row"), "row", TARGETS)
    return tidy(out.select("vec_id", *TARGETS, *(f"{c}_was_imputed" for c in TARGETS), "IMPUTED_COLUMNS", "N_IMPUTED_VALUES"))


@query(f"WITH {IMP} SELECT count(*) AS n FROM imp")
def imputed_total(spark: SparkSession, d: str) -> DataFrame:
    v = knn.numbered(vectors(spark, d), "row")
    out = knn.complete(v, knn.impute(v, ["label"], "vec_id", DIMS, TARGETS, row="row"), "row", TARGETS)
    return tidy(out.agg(F.sum("N_IMPUTED_VALUES").alias("n")))


KS = [1, 3, 5, 7, 9]
DET = PAIRS + ", det AS (" + " UNION ALL ".join(f"""SELECT label, vec_id, 'e{i}' AS "column", v{i} AS own, d{i} AS given, donor, row_number() OVER w AS rn, (SELECT count(e{i}) FROM vec WHERE vec.label = x.label) AS observed FROM (SELECT *, sqrt(8.0 / (m - (t{i} IS NOT NULL)::INT) * greatest(s - coalesce(t{i}, 0), 0)) AS dist FROM ps WHERE v{i} IS NOT NULL AND d{i} IS NOT NULL AND m - (t{i} IS NOT NULL)::INT > 0) x WINDOW w AS (PARTITION BY label, vec_id ORDER BY dist, donor)""" for i in (4, 5, 6)) + f"""),
lv AS (SELECT label, vec_id, "column", k, first(own) AS truth, median(given) AS predicted, string_agg(CAST(donor AS VARCHAR), ';' ORDER BY rn) AS donors FROM det JOIN (SELECT unnest({KS}) AS k) ON rn <= k WHERE observed >= 3 GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {DET} SELECT label::BIGINT AS label, vec_id, "column", k::BIGINT AS k, round(truth, 6) AS truth, round(predicted, 6) AS predicted, donors FROM lv""")
def knn_lovo_detail(spark: SparkSession, d: str) -> DataFrame:
    return tidy(knn.lovo_detail(vectors(spark, d), ["label"], "vec_id", DIMS, TARGETS, KS).drop("used"))


@query(f"""WITH {DET} SELECT label::BIGINT AS label, k::BIGINT AS k, count(*) AS n, round(avg(abs(predicted - truth)), 6) AS mae, round(sqrt(avg((predicted - truth) * (predicted - truth))), 6) AS rmse FROM lv GROUP BY 1, 2""")
def knn_lovo(spark: SparkSession, d: str) -> DataFrame:
    return tidy(knn.lovo(knn.lovo_detail(vectors(spark, d), ["label"], "vec_id", DIMS, TARGETS, KS), ["label"]))


@query(f"""WITH {DET}, g AS (SELECT label, k, count(*) AS n, avg(abs(predicted - truth)) AS mae, sqrt(avg((predicted - truth) * (predicted - truth))) AS rmse FROM lv GROUP BY 1, 2)
SELECT k::BIGINT AS k, sum(n)::BIGINT AS n, round(sum(n * mae) / sum(n), 6) AS mae, round(sqrt(sum(n * rmse * rmse) / sum(n)), 6) AS rmse FROM g GROUP BY 1""")
def knn_pooled(spark: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.pooled(knn.lovo(knn.lovo_detail(vectors(spark, d), ["label"], "vec_id", DIMS, TARGETS, KS), ["label"]), ["k"]))


# Suppliers as subjects of three sites: B and C follow the height closely, D is not measured at one site, E is constant in a stratum.
BODY = ["HEIGHT_cm", "WEIGHT_kg", "A", "B", "C", "D", "E"]
SEGMENTS = ["A", "B", "C", "D", "E"]
COHORT = """coh AS (SELECT k, site, kind, CASE WHEN k % 13 <> 0 THEN h END AS c0, CASE WHEN k % 17 <> 0 THEN 50 + (k * 53) % 47 / 2.0::DOUBLE END AS c1, CASE WHEN k % 7 <> 0 THEN (k * 71) % 97 / 7.0::DOUBLE END AS c2, CASE WHEN k % 6 <> 0 THEN h * 0.4::DOUBLE + (k * 29) % 11 / 9.0::DOUBLE END AS c3,
  CASE WHEN k % 5 <> 0 THEN h * 0.8::DOUBLE + (k * 31) % 13 / 8.0::DOUBLE END AS c4, CASE WHEN site <> 'site0' AND k % 11 <> 0 THEN (k * 43) % 89 / 3.0::DOUBLE END AS c5, CASE WHEN kind = 'CN' THEN 7.0::DOUBLE WHEN k % 8 <> 0 THEN (k * 19) % 23 / 2.0::DOUBLE END AS c6
  FROM (SELECT s_suppkey AS k, concat('site', s_nationkey % 3) AS site, CASE WHEN s_suppkey % 2 = 0 THEN 'ST' ELSE 'CN' END AS kind, 150 + (s_suppkey * 37) % 61 / 2.0::DOUBLE AS h FROM supplier))"""


def bodies(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("s_suppkey"), table(spark, d, "supplier")
    part = lambda a, n, by: (k * a) % n / F.lit(float(by))
    tall = 150 + part(37, 61, 2)
    site, kind = F.concat(F.lit("site"), (F.col("s_nationkey") % 3).cast("string")), F.when(k % 2 == 0, "ST").otherwise("CN")
    cells = [F.when(k % 13 != 0, tall), F.when(k % 17 != 0, 50 + part(53, 47, 2)), F.when(k % 7 != 0, part(71, 97, 7)), F.when(k % 6 != 0, tall * 0.4 + part(29, 11, 9)), F.when(k % 5 != 0, tall * 0.8 + part(31, 13, 8))]
    cells += [F.when((site != "site0") & (k % 11 != 0), part(43, 89, 3)), F.when(kind == "CN", 7.0).when(k % 8 != 0, part(19, 23, 2))]
    return s.select(k.alias("ID"), site.alias("site"), kind.alias("TYPE"), *(c.alias(n) for c, n in zip(cells, BODY, strict=True)))


def _kept_sql(n: int, source: str, groups: str) -> str:
    """Column j stays unless its correlation with an earlier one that stays is over 0.9."""
    near = [f"coalesce(isfinite(corr(c{i}, c{j})) AND abs(corr(c{i}, c{j})) > 0.9, FALSE) AS r{i}_{j}" for j in range(n) for i in range(j)]
    out = f"SELECT {groups}, {', '.join(near)} FROM {source} GROUP BY {groups}"
    for j in range(n):
        out = f"SELECT *, NOT ({' OR '.join(f'(k{i} AND r{i}_{j})' for i in range(j)) or 'FALSE'}) AS k{j} FROM ({out})"
    return out


def _pairs_sql(mode: str) -> str:
    """All pairs of a stratum with the summed terms, under the columns of the mode."""
    n = range(len(BODY))
    used = {i: f"l{i}" + (f" AND k{i}" if mode == "corr" else "") for i in n}
    m = mode
    return f"""used_{m} AS (SELECT site, kind, {", ".join(f"{u} AS u{i}" for i, u in used.items())} FROM kept JOIN live USING (site)),
z_{m} AS (SELECT k, site, kind, {", ".join(f"c{i}" for i in n)}, {", ".join(f"CASE WHEN u{i} THEN (c{i} - avg(c{i}) OVER w) / nullif(stddev_pop(c{i}) OVER w, 0) END AS z{i}" for i in n)}, ({" + ".join(f"u{i}::INT" for i in n)})::DOUBLE AS d FROM coh JOIN used_{m} USING (site, kind) WINDOW w AS (PARTITION BY site, kind)),
p_{m} AS (SELECT *, {" + ".join(f"coalesce(t{i}, 0)" for i in n)} AS s, {" + ".join(f"(t{i} IS NOT NULL)::INT" for i in n)} AS m FROM (SELECT a.site, a.kind, a.k, b.k AS donor, a.d, {", ".join(f"a.c{i} AS v{i}, b.c{i} AS g{i}, (a.z{i} - b.z{i}) * (a.z{i} - b.z{i}) AS t{i}" for i in n)} FROM z_{m} a JOIN z_{m} b ON a.site = b.site AND a.kind = b.kind AND a.k <> b.k))"""


def _lovo_sql(mode: str) -> str:
    cells = " UNION ALL ".join(f"""SELECT site, kind, k AS id, '{BODY[i]}' AS "column", v{i} AS own, g{i} AS given, donor, row_number() OVER w AS rn, (SELECT count(c{i}) FROM coh WHERE coh.site = x.site AND coh.kind = x.kind) AS observed
FROM (SELECT *, sqrt(d / (m - (t{i} IS NOT NULL)::INT) * greatest(s - coalesce(t{i}, 0), 0)) AS dist FROM p_{mode} WHERE v{i} IS NOT NULL AND g{i} IS NOT NULL AND m - (t{i} IS NOT NULL)::INT > 0) x WINDOW w AS (PARTITION BY site, kind, k ORDER BY dist, donor)""" for i, c in enumerate(BODY) if c in SEGMENTS)
    return f"""det_{mode} AS ({cells}), lv_{mode} AS (SELECT '{mode}' AS feature_mode, site, kind, id, "column", k, first(own) AS truth, median(given) AS predicted, string_agg(CAST(donor AS VARCHAR), ';' ORDER BY rn) AS donors, count(*) AS used FROM det_{mode} JOIN (SELECT unnest({KS}) AS k) ON rn <= k WHERE observed >= 3 GROUP BY ALL)"""


LIVE = "live AS (SELECT site, " + ", ".join(f"count(c{i}) > 0 AS l{i}" for i in range(len(BODY))) + " FROM coh GROUP BY 1), kept AS (" + _kept_sql(len(BODY), "coh", "site, kind") + ")"
MODES = f"{COHORT}, {LIVE}, {_pairs_sql('all')}, {_pairs_sql('corr')}, {_lovo_sql('all')}, {_lovo_sql('corr')}"
BY_GROUP = """grp AS (SELECT site, kind AS "TYPE", feature_mode, k::BIGINT AS k, count(*) AS n_tested, round_even(avg(abs(predicted - truth)), 3) AS mae, round_even(sqrt(avg((predicted - truth) * (predicted - truth))), 3) AS rmse FROM (SELECT * FROM lv_all UNION ALL SELECT * FROM lv_corr) GROUP BY 1, 2, 3, 4)"""


def _imputation(spark: SparkSession, d: str, **options) -> dict[str, DataFrame]:
    return tracks.imputation(bodies(spark, d), "ID", BODY, SEGMENTS, **options)


@query(f"WITH {COHORT}, {LIVE} SELECT site, kind AS \"TYPE\", concat_ws(';', " + ", ".join(f"CASE WHEN k{i} AND l{i} THEN '{c}' END" for i, c in enumerate(BODY)) + ") AS kept FROM kept JOIN live USING (site)")
def knn_columns(spark: SparkSession, d: str) -> DataFrame:
    sets = knn.column_sets(bodies(spark, d), ["site", "TYPE"], BODY, ["site"], 0.9)
    names = F.array_compact(F.array(*(F.when(F.col("used")[i], F.lit(c)) for i, c in enumerate(BODY))))
    return sets.select("site", "TYPE", F.array_join(names, ";").alias("kept"))


@query(f"WITH {COHORT}, {LIVE}, {_pairs_sql('corr')} SELECT site, kind AS \"TYPE\", id::BIGINT AS \"ID\", \"column\", round(median(given), 6) AS value FROM (" + " UNION ALL ".join(f"""SELECT site, kind, k AS id, '{c}' AS "column", g{i} AS given, row_number() OVER (PARTITION BY site, kind, k ORDER BY sqrt(d / m * s), donor) AS rn FROM p_corr WHERE m > 0 AND v{i} IS NULL AND g{i} IS NOT NULL""" for i, c in enumerate(BODY) if c in SEGMENTS) + ") WHERE rn <= 3 GROUP BY ALL")
def knn_corr(spark: SparkSession, d: str) -> DataFrame:
    return tidy(knn.impute(bodies(spark, d), ["site", "TYPE"], "ID", BODY, SEGMENTS, within=["site"], limit=0.9))


@query(f"WITH {MODES}, {BY_GROUP} SELECT * FROM grp")
def knn_modes(spark: SparkSession, d: str) -> DataFrame:
    return tidy(_imputation(spark, d)["by_group"])


@query(f"""WITH {MODES}, {BY_GROUP}, pooled AS (SELECT feature_mode, k, sum(n_tested)::BIGINT AS n_tested, round_even(sum(n_tested * mae) / sum(n_tested), 3) AS mae, round_even(sqrt(sum(n_tested * rmse * rmse) / sum(n_tested)), 3) AS rmse FROM grp GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY mae, feature_mode, k) = 1 AS best FROM pooled""")
def knn_modes_summary(spark: SparkSession, d: str) -> DataFrame:
    return tidy(_imputation(spark, d)["summary"])


@query(f"""WITH {COHORT}, {LIVE}, {_pairs_sql('corr')}, {_lovo_sql('corr')} SELECT site, kind AS "TYPE", feature_mode, k::BIGINT AS k, id::VARCHAR AS subject_id, "column", round_even(truth, 3) AS true_value, round_even(predicted, 3) AS predicted_value, round_even(abs(predicted - truth), 3) AS abs_error, used AS n_neighbors_used, donors AS neighbor_ids FROM lv_corr WHERE k = 3""")
def knn_modes_detail(spark: SparkSession, d: str) -> DataFrame:
    return tidy(_imputation(spark, d, mode="corr")["detail"], 3)


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]))
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return tidy(knn.correlations(table(spark, d, "lineitem"), NUMERIC))


def _greedy(limit: float) -> str:
    """Column j stays unless it is redundant with an earlier one that stays."""
    near = {(a, b): f"coalesce(abs(corr({a}, {b})) > {limit}, FALSE) AS r{i}_{j}" for j, b in enumerate(NUMERIC) for i, a in enumerate(NUMERIC[:j])}
    out = f"SELECT {', '.join(near.values())} FROM lineitem"
    for j in range(len(NUMERIC)):
        test = " OR ".join(f"(k{i} AND r{i}_{j})" for i in range(j)) or "FALSE"
        out = f"SELECT *, NOT ({test}) AS k{j} FROM ({out})"
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column" FROM ({out}) WHERE k{j}""" for j, c in enumerate(NUMERIC))


@query(_greedy(0.6))
def corr_greedy(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in knn.not_redundant(table(spark, d, "lineitem"), NUMERIC, 0.6)], "column string")


# ---- comparison and cross-validation --------------------------------------------


@query("""WITH a AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), o AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P')
SELECT coalesce(a.k, r.k, o.k) AS o_orderkey, round(a.v, 6) AS e1_v, round(r.v, 6) AS e2_v, round(o.v, 6) AS e3_v, round(o.v / nullif(a.v, 0), 6) AS scale FROM a FULL JOIN r ON a.k = r.k FULL JOIN o ON o.k = coalesce(a.k, r.k)""")
def compare_outer_join(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    part = lambda flag: li.where(F.col("l_returnflag") == flag).groupBy("o_orderkey").agg(F.sum("l_extendedprice").alias("v"))
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_totalprice").alias("v"))
    out = compare.outer({"e1": part("A"), "e2": part("R"), "e3": o}, "o_orderkey")
    return tidy(out.withColumn("scale", compare.equivalent_scale(F.col("e3_v"), F.col("e1_v"))))


@query("""WITH s AS (SELECT CASE WHEN s_suppkey <> 7 THEN s_suppkey END AS k, s_acctbal AS v FROM supplier), c AS (SELECT CASE WHEN c_custkey <> 11 THEN c_custkey END AS k, c_acctbal AS v FROM customer WHERE c_nationkey <> 3 OR c_custkey = 11), p AS (SELECT CASE WHEN p_partkey <> 5 THEN p_partkey END AS k, p_retailprice AS v FROM part WHERE p_size > 10 OR p_partkey = 5)
SELECT coalesce(s.k, c.k, p.k) AS k, round(s.v, 6) AS s_v, round(c.v, 6) AS c_v, round(p.v, 6) AS p_v FROM s FULL JOIN c ON s.k IS NOT DISTINCT FROM c.k FULL JOIN p ON p.k IS NOT DISTINCT FROM coalesce(s.k, c.k)""")
def compare_outer_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Each frame has one row without key; the three are one row of the result."""
    frame = lambda name, key, value, none, keep: table(spark, d, name).where(keep | (F.col(key) == none)).select(F.when(F.col(key) != none, F.col(key)).alias("k"), F.col(value).alias("v"))
    frames = {"s": frame("supplier", "s_suppkey", "s_acctbal", 7, F.lit(True)), "c": frame("customer", "c_custkey", "c_acctbal", 11, F.col("c_nationkey") != 3), "p": frame("part", "p_partkey", "p_retailprice", 5, F.col("p_size") > 10)}
    return tidy(compare.outer(frames, "k"))


@query(f"""WITH {MATRIX} SELECT method, round_even(max(mae) FILTER (grp = 'FRONT+BACK'), 4) AS "FRONT+BACK", round_even(max(mae) FILTER (grp = 'LEFT+RIGHT'), 4) AS "LEFT+RIGHT", round_even(max(mae) FILTER (grp = 'GLOBAL'), 4) AS "GLOBAL" FROM m GROUP BY 1""")
def matrix_wide(spark: SparkSession, d: str) -> DataFrame:
    return compare.matrix_wide(matrix(spark, d), ["FRONT+BACK", "LEFT+RIGHT", "GLOBAL"])


def cohort(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "supplier")
    return p.select(F.col("s_suppkey").alias("subject"), (F.col("s_acctbal") / 100 + F.col("s_nationkey")).alias("y"), F.col("s_acctbal").alias("a"), F.when(F.col("s_suppkey") % 9 != 0, F.col("s_nationkey").cast("double")).alias("b"), (F.col("s_suppkey") % 7).cast("double").alias("c"))


@query()
def kfold_assign(spark: SparkSession, d: str) -> DataFrame:
    return crossval.kfold(cohort(spark, d).select("subject"), "subject")


@query()
def ridge_cv(spark: SparkSession, d: str) -> DataFrame:
    return tidy(crossval.nested(cohort(spark, d), "subject", "y", ["a", "b", "c"]))


RIDGE = """co AS (SELECT s_acctbal / 100 + s_nationkey AS y, s_acctbal AS a, CASE WHEN s_suppkey % 9 <> 0 THEN s_nationkey::DOUBLE END AS b, (s_suppkey % 7)::DOUBLE AS c FROM supplier),
f AS (SELECT y, a, coalesce(b, (SELECT median(b) FROM co)) AS b, c FROM co),
m AS (SELECT count(*)::DOUBLE AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(c) AS sc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(c, y) AS cy FROM f),
g AS (SELECT *, n + 1 AS dd, n * ab / (sa * sb) AS p, n * ac / (sa * sc) AS q, n * bc / (sb * sc) AS r, n * ay / sa AS u, n * by_ / sb AS v, n * cy / sc AS w FROM m),
x AS (SELECT *, dd * (dd * dd - r * r) - p * (p * dd - r * q) + q * (p * r - dd * q) AS det FROM g),
k AS (SELECT *, (u * (dd * dd - r * r) - p * (v * dd - r * w) + q * (v * r - dd * w)) / det AS ka, (dd * (v * dd - r * w) - u * (p * dd - r * q) + q * (p * w - v * q)) / det AS kb, (dd * (dd * w - r * v) - p * (p * w - q * v) + u * (p * r - q * dd)) / det AS kc FROM x)"""


@query(f"WITH {RIDGE}, l AS (SELECT *, my - ka * ma / sa - kb * mb / sb - kc * mc / sc AS i FROM k) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, 1.0::DOUBLE AS alpha, round(k{c}, 6) AS coefficient_standardised, round(k{c} / s{c}, 6) AS coefficient_original_units, round(i, 6) AS intercept_original_units FROM l" for c in "abc"))
def ridge_coefficients(spark: SparkSession, d: str) -> DataFrame:
    return tidy(crossval.coefficients(cohort(spark, d), "subject", "y", ["a", "b", "c"], 1.0))


# ---- tracks ---------------------------------------------------------------------

RAW = {"CO": ("customer", "c_custkey"), "ES": ("supplier", "s_suppkey"), "BR": ("part", "p_partkey")}


def _raw_names(site: str) -> list[str]:
    """The numeric columns of a site's raw table, in the order of the canonical ones."""
    m = sites.SITES[site]
    return [n for c in sites.COLUMNS[2:] for n in (m.means.get(c) or ((m.columns[c],) if c in m.columns else ()))]


def raw_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Three sites' tables as text, with blank cells and words among the numbers."""
    out = {}
    for site, (t, key) in RAW.items():
        k, m = F.col(key), sites.SITES[site]
        cells = [F.when((k * 7 + i) % 13 == 0, F.when(k % 2 == 0, " ").otherwise("n/a")).otherwise(((k * (2 * i + 3)) % 1000 / F.lit(5.0) + i).cast("string")).alias(n) for i, n in enumerate(_raw_names(site))]
        out[site] = table(spark, d, t).select(k.cast("string").alias(m.columns["ID"]), F.when(k % 3 == 0, "ST").otherwise("CN").alias(m.columns["TYPE"]), *cells)
    return out


def _canonical_sql() -> str:
    parts = []
    for site, (t, key) in RAW.items():
        m, names = sites.SITES[site], _raw_names(site)
        value = {n: f"(CASE WHEN ({key} * 7 + {i}) % 13 <> 0 THEN ({key} * {2 * i + 3}) % 1000 / 5.0::DOUBLE + {i} END)" for i, n in enumerate(names)}
        cells = {}
        for c in sites.COLUMNS[2:]:
            if c in m.means:
                a, b = (value[n] for n in m.means[c])
                cells[c] = f"(coalesce({a}, 0) + coalesce({b}, 0)) / nullif(({a} IS NOT NULL)::INT + ({b} IS NOT NULL)::INT, 0)"
            elif c in m.columns:
                cells[c] = value[m.columns[c]] + (f" * {m.factors[c]}::DOUBLE" if c in m.factors else "")
        cells["PONDERAL_INDEX_kg_m3"] = f"CASE WHEN abs({cells['HEIGHT_cm']}) > 0 THEN {cells['WEIGHT_kg']} / pow({cells['HEIGHT_cm']} / 100, 3) END"
        parts.append(f"""SELECT '{site}' AS site, {key}::VARCHAR AS "ID", CASE WHEN {key} % 3 = 0 THEN 'ST' ELSE 'CN' END AS "TYPE", """ + ", ".join(f'{cells[c]} AS "{c}"' for c in sites.COLUMNS[2:]) + f" FROM {t}")
    return " UNION ALL ".join(parts)


#: Cells, bounds and row flags of the canonical table, as CELLS has them for customers.
TRACK = "canon AS (SELECT row_number() OVER () AS rid, * FROM (" + _canonical_sql() + """)),
cells AS (SELECT rid, site, "ID" AS id, "TYPE" AS kind, """ + ", ".join(f'"{c}"' for c in sites.COLUMNS[2:]) + """ FROM canon),
long AS (""" + " UNION ALL ".join(f"""SELECT rid, site, id, kind, '{c}' AS "column", "{c}" AS value, {low}::DOUBLE AS lowest, {high}::DOUBLE AS highest FROM cells""" for c, (low, high) in qc.RANGES.items()) + """),
q AS (SELECT site, "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS n FROM long WHERE value IS NOT NULL AND "column" <> 'AGE' GROUP BY 1, 2),
bounds AS (SELECT site, "column", q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q WHERE n >= 5 AND q3 <> q1),
marked AS (SELECT l.*, value IS NULL AS miss, coalesce(NOT value BETWEEN lowest AND highest, FALSE) AS inv, coalesce(value < low OR value > high, FALSE) AS outl FROM long l LEFT JOIN bounds b ON b.site = l.site AND b."column" = l."column"),
rowf AS (SELECT rid, concat_ws(';', CASE WHEN bool_or(inv) THEN 'invalid_range' END, CASE WHEN bool_or(miss) THEN 'missing_values' END, CASE WHEN bool_or(outl) THEN 'outlier' END) AS "QC_FLAGS",
  coalesce(string_agg("column", ';' ORDER BY "column") FILTER (miss OR inv OR outl), '') AS "QC_COLUMNS", count(*) FILTER (miss OR inv OR outl) AS "QC_N_FLAGS", bool_or(inv) AS rinv, bool_or(outl) AS routl FROM marked GROUP BY 1)"""
PSEUDONYM = f"concat(site, '_', left(sha256(concat('{SALT}', id)), 8))"


@query(f"""WITH {TRACK} SELECT {PSEUDONYM} AS "PSEUDO_ID", site, kind AS "TYPE", """ + ", ".join(f'round("{c}", 6) AS "{c}"' for c in sites.COLUMNS[2:]) + """, "QC_FLAGS", "QC_COLUMNS", "QC_N_FLAGS", '' AS "IMPUTED_COLUMNS", 0::BIGINT AS "N_IMPUTED_VALUES" FROM cells JOIN rowf USING (rid)""")
def tabular_preprocessed(spark: SparkSession, d: str) -> DataFrame:
    return tidy(tracks.tabular(raw_tables(spark, d), SALT)["preprocessed"])


@query(_report("(miss OR inv OR outl) AND rinv", "(miss OR inv OR outl) AND routl", TRACK))
def tabular_report(spark: SparkSession, d: str) -> DataFrame:
    return tracks.tabular(raw_tables(spark, d), SALT)["report"]


@query(f"""WITH {TRACK} SELECT site, {PSEUDONYM} AS subject_id, kind AS "TYPE", "column", round(value, 6) AS value, "QC_FLAGS" FROM marked JOIN rowf USING (rid) WHERE miss OR inv OR outl""")
def tabular_flagged(spark: SparkSession, d: str) -> DataFrame:
    return tidy(tracks.tabular(raw_tables(spark, d), SALT)["flagged"])


@query(f"""WITH {TRACK} SELECT DISTINCT site, id AS "ID", {PSEUDONYM} AS "PSEUDO_ID" FROM cells""")
def tabular_mapping(spark: SparkSession, d: str) -> DataFrame:
    return tracks.tabular(raw_tables(spark, d), SALT)["mapping"]


# Orders stand for images, their lines for reference markers, customers for subjects.
EXP1 = """im AS (SELECT o_orderkey AS k, 'img/' || o_orderkey AS image_path, CASE WHEN o_custkey % 2 = 0 THEN 'CO' ELSE 'BR' END AS site, o_custkey::VARCHAR AS subject_id, ['front', 'back', 'left', 'right'][1 + o_orderkey % 4] AS view, 100.0::DOUBLE AS image_width,
  CASE o_orderkey % 10 WHEN 0 THEN 'invalid_height_px' WHEN 1 THEN 'ok_with_warning_small' ELSE 'ok' END AS landmark_status, CASE WHEN o_orderkey % 10 <> 0 THEN 200.0::DOUBLE + o_orderkey % 50 END AS height_px, (o_orderkey % 100)::DOUBLE AS fx, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey % 50 + 0.5::DOUBLE END AS fy FROM orders),
cal AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN 'no_marker_detected' ELSE 'ok' END AS cs, CASE WHEN o_orderkey % 19 <> 0 THEN 0.5::DOUBLE + o_custkey % 7 * 0.05::DOUBLE END AS s FROM orders),
rf AS (SELECT l_orderkey AS k, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS i, l_discount * 1000 AS x, CASE WHEN l_linenumber % 7 <> 6 THEN l_quantity END AS y, l_extendedprice / l_quantity / 3700::DOUBLE AS s, l_tax AS q FROM lineitem),
el AS (SELECT im.*, cal.s AS med, 150 + c_nationkey::DOUBLE AS truth FROM im JOIN cal USING (k) LEFT JOIN customer ON c_custkey::VARCHAR = subject_id WHERE cs <> 'no_marker_detected' AND cal.s IS NOT NULL),
pk AS (SELECT k, arg_min({'s': s, 'i': i, 'b': -q}, {'b': -q, 'i': i}) AS best, arg_min({'s': s, 'i': i, 'b': d2}, {'b': d2, 'i': i}) FILTER (d2 IS NOT NULL) AS feet, arg_min({'s': s, 'i': i, 'b': d1}, {'b': d1, 'i': i}) FILTER (d1 IS NOT NULL) AS line
  FROM (SELECT rf.*, sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) AS d2, abs(y - fy) AS d1 FROM rf JOIN el USING (k)) GROUP BY 1),
hf AS (SELECT k, x < 50 AS half, arg_max(s, {'a': q, 'b': -i}) AS s FROM rf GROUP BY 1, 2), pv AS (SELECT k, CASE WHEN count(*) = 2 THEN max(s) / nullif(min(s), 0) END AS ratio FROM hf GROUP BY 1),
e1 AS (SELECT k, image_path, site, subject_id, view, truth, height_px, med, best.s AS sb, best.i AS ib, feet.s AS sf, feet.i AS if_, feet.b AS bf, line.s AS sl, line.i AS il, line.b AS bl, ratio, coalesce(ratio > 1.35, FALSE) AS tilted,
  CASE WHEN landmark_status LIKE 'ok%' THEN 'ok' ELSE 'landmark_failed_' || landmark_status END AS status, height_px * med AS h1, height_px * best.s AS h2, height_px * feet.s AS h3, height_px * line.s AS h4 FROM el LEFT JOIN pk USING (k) LEFT JOIN pv USING (k))"""


def experiment(spark: SparkSession, d: str) -> DataFrame:
    c, o = F.col, table(spark, d, "orders")
    k, who = c("o_orderkey"), c("o_custkey")
    path = lambda x: F.concat(F.lit("img/"), x.cast("string")).alias("image_path")
    view = F.array(*map(F.lit, tracks.VIEWS))[(k % 4).cast("int")]
    status = F.when(k % 10 == 0, "invalid_height_px").when(k % 10 == 1, "ok_with_warning_small").otherwise("ok")
    im = o.select(path(k), F.when(who % 2 == 0, "CO").otherwise("BR").alias("site"), who.alias("subject_id"), view.alias("view"), F.lit(100.0).alias("image_width"), status.alias("landmark_status"), F.when(k % 10 != 0, 200.0 + k % 50).alias("height_px"), (k % 100).cast("double").alias("feet_x_px"), F.when(k % 13 != 0, who % 50 + F.lit(0.5)).alias("feet_y_px"))
    cal = o.select(path(k), F.lit(1).alias("row_order"), F.when(k % 17 == 0, "no_marker_detected").otherwise("ok").alias("calibration_status"), F.when(k % 19 != 0, F.lit(0.5) + who % 7 * F.lit(0.05)).alias("scale_cm_per_pixel"))
    second = cal.withColumns({"row_order": F.lit(2), "scale_cm_per_pixel": F.lit(9.0)})  # later rows do not count
    i = c("l_linenumber")
    refs = table(spark, d, "lineitem").select(path(c("l_orderkey")), (c("l_partkey") * 1000000 + c("l_suppkey") * 10 + i).alias("reference_index"), (c("l_discount") * 1000).alias("center_x_px"), F.when(i % 7 != 6, c("l_quantity")).alias("center_y_px"), (c("l_extendedprice") / c("l_quantity") / F.lit(3700.0)).alias("reference_scale_cm_per_pixel"), c("l_tax").alias("detection_quality"))
    manual = table(spark, d, "customer").select(c("c_custkey").alias("ID"), (150 + c("c_nationkey")).alias("HEIGHT_cm"), F.lit(0).alias("row_order"))
    return tracks.experiment_1(im, cal.union(second), refs, manual)


@query(f"""WITH {EXP1} SELECT image_path, site, subject_id, view, round(truth, 6) AS height_manual_cm, round(height_px, 6) AS height_px, round(med, 6) AS scale_median_all, round(sb, 6) AS scale_best_quality, ib::BIGINT AS best_quality_reference_index, round(sf, 6) AS scale_closest_feet, if_::BIGINT AS closest_feet_reference_index, round(bf, 6) AS closest_feet_distance_px,
round(sl, 6) AS scale_ground_line, il::BIGINT AS ground_line_reference_index, round(bl, 6) AS ground_line_delta_y_px, round(ratio, 6) AS cube_scale_ratio, tilted AS perspective_flag, status, round(h1, 6) AS height_cm_median_scale, round(h2, 6) AS height_cm_best_quality_scale, round(h3, 6) AS height_cm_closest_feet_scale, round(h4, 6) AS height_cm_ground_line_scale,
round(h1 - truth, 6) AS error_cm_median_scale, round(h2 - truth, 6) AS error_cm_best_quality_scale, round(h3 - truth, 6) AS error_cm_closest_feet_scale, round(h4 - truth, 6) AS error_cm_ground_line_scale FROM e1""")
def experiment_1(spark: SparkSession, d: str) -> DataFrame:
    return tidy(experiment(spark, d))


# Orders stand for images, their lines for masks (as runs) and for markers, customers for subjects.
EXP2 = RUNS + """, fm AS (SELECT img, max(y)::DOUBLE AS fm FROM runs GROUP BY 1),
wide AS (SELECT img, y, min(x0) AS l, max(x1) AS r, max(x1) - min(x0) + 1 AS w FROM runs GROUP BY 1, 2),
hd AS (SELECT w.*, row_number() OVER (PARTITION BY img ORDER BY w DESC) AS k, count(*) OVER (PARTITION BY img) AS n FROM wide w JOIN ext e USING (img) WHERE y <= floor(y_min + 0.12::DOUBLE * (y_max - y_min))),
sk AS (SELECT img, median(w) AS sw FROM hd WHERE k <= greatest(1, n // 3) GROUP BY 1), mh AS (SELECT img, min(y)::DOUBLE AS mh FROM hd JOIN sk USING (img) WHERE w >= 0.5::DOUBLE * sw GROUP BY 1),
im AS (SELECT o_orderkey AS img, CASE WHEN o_custkey % 2 = 0 THEN 'CO' ELSE 'BR' END AS site, o_custkey::VARCHAR AS subject_id, ['front', 'back', 'left', 'right'][1 + o_orderkey % 4] AS view, CASE WHEN o_orderkey % 21 <> 0 THEN 60 ELSE 0 END AS img_h, CASE WHEN o_orderkey % 10 = 0 THEN 'invalid_height_px' WHEN o_orderkey % 10 = 1 THEN 'ok_with_warning_small' ELSE 'ok' END AS ls,
  CASE WHEN o_orderkey % 37 <> 0 THEN 8.0::DOUBLE + o_custkey % 25 END AS f0, CASE WHEN o_orderkey % 41 <> 0 THEN o_custkey % 7 + 0.5::DOUBLE END AS h0 FROM orders),
mk AS (SELECT l_orderkey AS img, (l_partkey * 1000000 + l_suppkey * 10 + l_linenumber) * 100000 + l_quantity::BIGINT * 1000 + round(l_discount * 100)::BIGINT * 10 + round(l_tax * 100)::BIGINT AS i, l_discount * 500 AS x, l_tax * 300 AS y, 6.0::DOUBLE + l_quantity % 13 AS s, (l_partkey % 5)::DOUBLE AS t FROM lineitem WHERE l_returnflag <> 'R'),
ed AS (SELECT img, i, (y + (y + t) + (y + s + t) + (y + s)) / 4 AS middle, unnest([0, 1, 2, 3]) AS j, unnest([[x, y, x + s, y + t], [x + s, y + t, x + s - t, y + s + t], [x + s - t, y + s + t, x - t, y + s], [x - t, y + s, x, y]]) AS q FROM mk),
eb AS (SELECT img, i, any_value(middle) AS middle, arg_max({'b': greatest(q[2], q[4]), 't': least(q[2], q[4])}, {'v': round(1 - abs(abs(degrees(atan2(q[4] - q[2], q[3] - q[1]))) % 180 - 90) / 90, 9), 'j': -j}) FILTER (sqrt((q[1] - q[3]) * (q[1] - q[3]) + (q[2] - q[4]) * (q[2] - q[4])) >= 10) AS edge FROM ed GROUP BY 1, 2),
p1 AS (SELECT im.*, fm.fm, CASE WHEN view IN ('left', 'right') AND fm >= f0 - 5 THEN fm ELSE f0 END AS yf, coalesce(view IN ('left', 'right') AND fm >= f0 - 5, FALSE) AS soled, mh.mh FROM im LEFT JOIN fm USING (img) LEFT JOIN mh USING (img)),
p2 AS (SELECT *, coalesce(abs(mh - h0) <= 0.12::DOUBLE * (yf - h0), FALSE) AS near, CASE WHEN view IN ('left', 'right') THEN greatest(mh, h0 - 30) ELSE mh END AS target FROM p1),
p3 AS (SELECT *, CASE WHEN near THEN target ELSE h0 END AS yh, CASE WHEN NOT near THEN 'pose' WHEN view IN ('left', 'right') THEN 'mask_trim_hair_capped' ELSE 'mask_trim_hair' END AS hs, CASE WHEN near THEN h0 - target ELSE 0 END AS mv FROM p2),
pk AS (SELECT p3.img, TRUE AS has, arg_min(edge, {'d': abs(middle - yf), 'i': i}) FILTER (edge IS NOT NULL AND yf IS NOT NULL) AS edge FROM p3 JOIN eb USING (img) GROUP BY 1),
p4 AS (SELECT p3.*, has, edge, edge.b - 100.0::DOUBLE * (edge.b - edge.t) / 50.0::DOUBLE AS yc FROM p3 LEFT JOIN pk USING (img)),
p5 AS (SELECT *, CASE WHEN abs(yf - yc) > 1e-6 THEN 100.0::DOUBLE * ((yf - yh) / (yf - yc)) END AS hc FROM p4),
p6 AS (SELECT img, site, subject_id, view, img_h, 150 + c_nationkey::DOUBLE AS truth, ls LIKE 'ok%' AS person, CASE WHEN ls NOT LIKE 'ok%' THEN 'person_failed_' || ls WHEN has IS NULL THEN 'no_aruco' WHEN edge IS NULL THEN 'no_cube_edge' WHEN coalesce(hc > 40 AND hc < 230, FALSE) THEN 'ok' ELSE 'horizon_out_of_range' END AS status, yc, hc, yf, yh, f0, fm, soled, hs, mv FROM p5 LEFT JOIN customer ON c_custkey::VARCHAR = subject_id),
p7 AS (SELECT img, site, subject_id, view, img_h, truth, status, CASE WHEN person THEN yc END AS yc, CASE WHEN person THEN hc END AS hc, CASE WHEN person THEN yf END AS yf, CASE WHEN person THEN yh END AS yh, CASE WHEN person THEN f0 END AS f0, CASE WHEN person THEN fm END AS fm, CASE WHEN person AND soled THEN 'mask_bottom' ELSE 'pose' END AS fs, CASE WHEN person THEN hs ELSE 'pose' END AS hs, CASE WHEN person THEN mv ELSE 0 END AS mv FROM p6),
good AS (SELECT subject_id, yc FROM p7 WHERE view IN ('front', 'back') AND status = 'ok' AND yc IS NOT NULL), sub AS (SELECT subject_id, median(yc) AS v FROM good GROUP BY 1), glo AS (SELECT median(yc) AS g FROM good),
p8 AS (SELECT p7.*, coalesce(sub.v, g) AS yr, CASE WHEN sub.v IS NOT NULL THEN 'subject' ELSE 'global' END AS src FROM p7 LEFT JOIN sub USING (subject_id), glo),
e2 AS (SELECT *, yc - yr AS delta, CASE WHEN img_h > 0 THEN (yc - yr) / img_h END AS frac, CASE WHEN abs(yf - yr) > 1e-6 THEN 100.0::DOUBLE * ((yf - yh) / (yf - yr)) END AS h_s, CASE WHEN abs(f0 - yr) > 1e-6 THEN 100.0::DOUBLE * ((f0 - yh) / (f0 - yr)) END AS h_1, CASE WHEN abs(fm - yr) > 1e-6 THEN 100.0::DOUBLE * ((fm - yh) / (fm - yr)) END AS h_m FROM p8)"""


def second(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    c, o = F.col, table(spark, d, "orders")
    k, who = c("o_orderkey"), c("o_custkey")
    path = lambda x: F.concat(F.lit("img/"), x.cast("string")).alias("image_path")
    view = F.array(*map(F.lit, tracks.VIEWS))[(k % 4).cast("int")]
    status = F.when(k % 10 == 0, "invalid_height_px").when(k % 10 == 1, "ok_with_warning_small").otherwise("ok")
    im = o.select(path(k), F.when(who % 2 == 0, "CO").otherwise("BR").alias("site"), who.alias("subject_id"), view.alias("view"), F.when(k % 21 != 0, 60).otherwise(0).alias("img_h"), status.alias("landmark_status"), F.when(k % 37 != 0, who % 25 + F.lit(8.0)).alias("feet_y"), F.when(k % 41 != 0, who % 7 + F.lit(0.5)).alias("head_y"))
    runs = runs_of(spark, d).select(path(c("img")), "y", "x0", "x1")
    x, y, s, t = c("l_discount") * 500, c("l_tax") * 300, c("l_quantity") % 13 + F.lit(6.0), (c("l_partkey") % 5).cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    corners = F.array(point(x, y), point(x + s, y + t), point(x + s - t, y + s + t), point(x - t, y + s))
    markers = table(spark, d, "lineitem").where("l_returnflag <> 'R'").select(path(c("l_orderkey")), ((c("l_partkey") * 1000000 + c("l_suppkey") * 10 + c("l_linenumber")) * 100000 + c("l_quantity").cast("long") * 1000 + F.round(c("l_discount") * 100).cast("long") * 10 + F.round(c("l_tax") * 100).cast("long")).alias("marker_index"), corners.alias("corners"))
    manual = table(spark, d, "customer").select(c("c_custkey").alias("ID"), (150 + c("c_nationkey")).alias("HEIGHT_cm"), F.lit(0).alias("row_order"))
    return tracks.experiment_2(im, runs, markers, manual, marker_cm=50.0)


def unsigned(df: DataFrame, digits: int = 6) -> DataFrame:
    """Tidy, with zeros of one sign: differences of equal numbers come as either."""
    out = tidy(df, digits)
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c, k in out.dtypes if k == "double"})


@query(f"""WITH {EXP2} SELECT 'img/' || img AS image_path, site, subject_id, view, status, img_h::BIGINT AS img_h, round(truth, 6) + 0.0::DOUBLE AS height_manual_cm, round(yc, 6) + 0.0::DOUBLE AS y_horizon_cube, round(hc, 6) + 0.0::DOUBLE AS "H_horizon_cube", round(yf, 6) + 0.0::DOUBLE AS y_feet, round(yh, 6) + 0.0::DOUBLE AS y_head, round(yf - yh, 6) + 0.0::DOUBLE AS height_px, round(f0, 6) + 0.0::DOUBLE AS y_feet_single, round(fm, 6) + 0.0::DOUBLE AS y_feet_mask, fs AS feet_source, hs AS head_source, round(mv, 6) + 0.0::DOUBLE AS head_move_px,
round(yr, 6) + 0.0::DOUBLE AS y_horizon_ref, src AS horizon_ref_source, round(delta, 6) + 0.0::DOUBLE AS delta_horizon_px, round(frac, 6) + 0.0::DOUBLE AS delta_horizon_frac, round(h_s, 6) + 0.0::DOUBLE AS "H_horizon_shared", round(h_1, 6) + 0.0::DOUBLE AS "H_shared_feet_single", round(h_m, 6) + 0.0::DOUBLE AS "H_shared_feet_mask", round(h_s - truth, 6) + 0.0::DOUBLE AS error_horizon_shared, round(hc - truth, 6) + 0.0::DOUBLE AS error_horizon_cube, round(h_1 - truth, 6) + 0.0::DOUBLE AS error_feet_single, round(h_m - truth, 6) + 0.0::DOUBLE AS error_feet_mask FROM e2""")
def experiment_2(spark: SparkSession, d: str) -> DataFrame:
    return unsigned(second(spark, d)["estimates"])


@query(f"""WITH {EXP2} SELECT view, count(delta) AS n, round(avg(delta), 6) AS mean_px, round(median(delta), 6) AS median_px, round(stddev_samp(delta), 6) AS std_px, round(min(delta), 6) AS min_px, round(max(delta), 6) AS max_px FROM e2 WHERE delta IS NOT NULL GROUP BY 1""")
def experiment_2_alignment(spark: SparkSession, d: str) -> DataFrame:
    return unsigned(second(spark, d)["alignment"])


@query(f"WITH {EXP2} SELECT subject_id, " + ", ".join(f"""round(median(delta) FILTER (view = '{v}'), 6) + 0.0::DOUBLE AS "{v}\"""" for v in tracks.VIEWS) + " FROM e2 WHERE delta IS NOT NULL GROUP BY 1")
def experiment_2_pivot(spark: SparkSession, d: str) -> DataFrame:
    return unsigned(second(spark, d)["pivot"])


@query(f"""WITH {EXP2}, g AS (SELECT unnest(list_filter([view, CASE WHEN view IN ('front', 'back') THEN 'FRONT+BACK' END, 'GLOBAL'], lambda x: x IS NOT NULL)) AS grupo, h_s - truth AS e FROM e2)
SELECT grupo, count(e) AS n, coalesce(round_even(avg(e), 1), 0) AS bias_cm, coalesce(round_even(avg(abs(e)), 1), 0) AS mae_cm, coalesce(round_even(sqrt(avg(e * e)), 1), 0) AS rmse_cm FROM g GROUP BY 1""")
def experiment_2_summary(spark: SparkSession, d: str) -> DataFrame:
    return tidy(second(spark, d)["summary"])


@query(f"""WITH {EXP2}, g AS (SELECT unnest(list_filter([view, CASE WHEN view IN ('front', 'back') THEN 'FRONT+BACK' END, 'GLOBAL'], lambda x: x IS NOT NULL)) AS grp, hc - truth AS e1, h_s - truth AS e2, h_1 - truth AS e3, h_m - truth AS e4 FROM e2),
m AS (SELECT grp, unnest(['cube', 'shared', 'feet_single', 'feet_mask']) AS method, unnest([e1, e2, e3, e4]) AS e FROM g)
SELECT grp, method, count(e) AS n, round(avg(e), 4) AS bias, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse FROM m WHERE e IS NOT NULL GROUP BY 1, 2""")
def experiment_2_matrix(spark: SparkSession, d: str) -> DataFrame:
    return tidy(second(spark, d)["matrix"], 4)


# The lateral images of experiment 2 whose own horizon is ok.
LATERAL = EXP2 + """, la AS (SELECT img, subject_id, view, truth, yf, yh, yc, yr, CASE WHEN yf - yh > 0 AND yf - yc > 1e-6 THEN 100.0::DOUBLE * ((yf - yh) / (yf - yc)) END AS po, CASE WHEN yf - yh > 0 AND yf - yr > 1e-6 THEN 100.0::DOUBLE * ((yf - yh) / (yf - yr)) END AS ps FROM e2 WHERE view IN ('left', 'right') AND status = 'ok'),
lb AS (SELECT *, abs(ps - truth) - abs(po - truth) AS gain, yc - yr AS dl FROM la), lv AS (SELECT *, unnest([view, 'LATERAL_GLOBAL']) AS g FROM lb),
su AS (SELECT subject_id, median(truth) AS truth, count(*) AS n, bool_or(view = 'left') AS hl, bool_or(view = 'right') AS hr, avg(po) AS om, median(po) AS od, avg(ps) AS sm, median(ps) AS sd, avg(yc) AS yc, avg(yr) AS yr, avg(yc - yr) AS dl, CASE WHEN count(po) >= 2 THEN max(po) - min(po) END AS lr FROM lb GROUP BY 1 HAVING median(truth) IS NOT NULL)"""


def _scores(rows: str, cells: dict[str, str]) -> str:
    """The metrics of some estimates; rows has g, subject_id and truth."""
    each = " UNION ALL ".join(f"SELECT g, subject_id, truth, '{m}' AS method, {x} AS p FROM {rows}" for m, x in cells.items())
    return f"""SELECT g AS "group", method, any_value(ns) AS n_subjects, count(p - truth) AS n, round(avg(p - truth), 6) AS bias_cm, round(avg(abs(p - truth)), 6) AS mae_cm, round(sqrt(avg((p - truth) * (p - truth))), 6) AS rmse_cm, round(CASE WHEN count(p - truth) >= 2 THEN 1 - sum((p - truth) * (p - truth)) / nullif(var_pop(truth) FILTER (p IS NOT NULL) * count(p - truth), 0) END, 6) AS r2
FROM ({each}) JOIN (SELECT g, count(DISTINCT subject_id) AS ns FROM {rows} GROUP BY 1) USING (g) GROUP BY 1, 2"""


def lateral(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return tracks.lateral_diagnostic(second(spark, d)["estimates"])


@query(f"WITH {LATERAL} " + _scores("lv", {"per_image_cube_horizon": "po", "shared_subject_horizon": "ps"}))
def lateral_views(spark: SparkSession, d: str) -> DataFrame:
    return tidy(lateral(spark, d)["views"])


@query(f"""WITH {LATERAL} SELECT subject_id, round(truth, 6) AS height_manual_cm, n AS n_lateral_images, hl AS has_left, hr AS has_right, round(om, 6) AS pred_per_image_horizon_mean_cm, round(od, 6) AS pred_per_image_horizon_median_cm, round(sm, 6) AS pred_shared_horizon_mean_cm, round(sd, 6) AS pred_shared_horizon_median_cm, round(yc, 6) AS mean_cube_horizon_px, round(yr, 6) AS mean_shared_horizon_px,
round(dl, 6) + 0.0::DOUBLE AS mean_horizon_delta_px, round(lr, 6) AS left_right_prediction_difference_cm, round(om - truth, 6) + 0.0::DOUBLE AS error_per_image_horizon_mean_cm, round(sm - truth, 6) + 0.0::DOUBLE AS error_shared_horizon_mean_cm FROM su""")
def lateral_subjects(spark: SparkSession, d: str) -> DataFrame:
    return unsigned(lateral(spark, d)["subjects"])


@query(f"WITH {LATERAL}, sg AS (SELECT *, 'SUBJECT_LEVEL' AS g FROM su) " + _scores("sg", {"per_image_horizon_left_right_mean": "om", "per_image_horizon_left_right_median": "od", "shared_horizon_left_right_mean": "sm", "shared_horizon_left_right_median": "sd"}))
def lateral_subject_summary(spark: SparkSession, d: str) -> DataFrame:
    return tidy(lateral(spark, d)["subject_summary"])


@query(f"""WITH {LATERAL} SELECT g AS "group", count(*) AS n_images, round(avg(dl), 6) AS mean_horizon_delta_px, round(median(dl), 6) AS median_horizon_delta_px, round(stddev_samp(dl), 6) AS std_horizon_delta_px, round(min(dl), 6) AS min_horizon_delta_px, round(max(dl), 6) AS max_horizon_delta_px, round(avg(gain), 6) AS mean_error_improvement_cm, round(median(gain), 6) + 0.0::DOUBLE AS median_error_improvement_cm,
round(avg(CASE WHEN gain > 0 THEN 1.0 WHEN gain IS NOT NULL THEN 0.0 END), 6) AS fraction_images_improved FROM lv GROUP BY 1""")
def lateral_horizons(spark: SparkSession, d: str) -> DataFrame:
    return unsigned(lateral(spark, d)["horizons"])


LATERAL_SCALE = """im AS (SELECT o_orderkey, '/d/' || o_orderkey || '.jpg' AS p, o_custkey AS s, ['left', 'Right'][1 + o_orderkey % 2] AS v, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 60)::DOUBLE END AS fy FROM orders),
rf AS (SELECT l_orderkey AS i, '/d/' || l_orderkey || '.jpg' AS p, o_custkey AS s, ['left', 'right'][1 + l_orderkey % 2] AS v, CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity END AS y, CASE WHEN l_partkey % 3 <> 0 THEN (l_partkey % 40)::DOUBLE / 100 END AS sc, l_linenumber AS n, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'),
cl AS (SELECT '/d/' || o_orderkey || '.jpg' AS p, o_custkey AS s, ['left', 'right'][1 + o_orderkey % 2] AS v, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 1000000 END AS sc FROM orders WHERE o_orderstatus <> 'O'),
ji AS (SELECT o_orderkey, '/d/' || o_orderkey || '.jpg' AS p, s, lower(v) AS v, fy FROM im),
mr AS (SELECT o_orderkey, rf.p = ji.p AS ex, sc, abs(y - fy) AS g, n, i, l_suppkey FROM ji JOIN rf ON rf.s = ji.s AND rf.v = ji.v), ur AS (SELECT m.* FROM mr m JOIN (SELECT o_orderkey, bool_or(ex) AS own FROM mr GROUP BY 1) USING (o_orderkey) WHERE ex OR NOT own),
rr AS (SELECT o_orderkey, arg_min(sc, {'g': g, 'n': i * 100 + n, 's': sc}) FILTER (g IS NOT NULL AND sc IS NOT NULL) AS near, median(sc) AS mid FROM ur GROUP BY 1),
mc AS (SELECT o_orderkey, cl.p = ji.p AS ex, sc FROM ji JOIN cl ON cl.s = ji.s AND cl.v = ji.v), rc AS (SELECT o_orderkey, median(sc) AS cal FROM mc JOIN (SELECT o_orderkey, bool_or(ex) AS own FROM mc GROUP BY 1) USING (o_orderkey) WHERE ex OR NOT own GROUP BY 1)"""


@query(f"""WITH {LATERAL_SCALE} SELECT o_orderkey, round(CASE WHEN coalesce(near, mid) > 0 THEN coalesce(near, mid) ELSE cal END, 6) AS scale, CASE WHEN coalesce(near, mid) > 0 THEN CASE WHEN near IS NOT NULL THEN 'closest_reference_to_feet' ELSE 'median_reference_scale' END WHEN cal IS NOT NULL THEN 'image_calibration_scale' ELSE 'no_valid_calibration_scale' END AS scale_source
FROM ji LEFT JOIN rr USING (o_orderkey) LEFT JOIN rc USING (o_orderkey)""")
def lateral_scale(spark: SparkSession, d: str) -> DataFrame:
    c, o = F.col, table(spark, d, "orders")
    path = lambda k, head: F.concat(F.lit(head), k.cast("string"), F.lit(".jpg")).alias("image_path")
    view = lambda k, names: F.array(*map(F.lit, names))[(k % 2).cast("int")].alias("view")
    k = c("o_orderkey")
    who = c("o_custkey").alias("subject_id")
    im = o.select(path(k, "file:/d//a/../"), k, who, view(k, ("left", "Right")), F.when(k % 5 != 0, (k % 60).cast("double")).alias("feet_y"))
    li = table(spark, d, "lineitem").join(o.where("o_orderstatus = 'F'"), c("l_orderkey") == k)
    refs = li.select(path(c("l_orderkey"), "/d/"), who, view(c("l_orderkey"), ("left", "right")), F.when(c("l_linenumber") % 4 != 0, c("l_quantity")).alias("center_y_px"), F.when(c("l_partkey") % 3 != 0, (c("l_partkey") % 40).cast("double") / 100).alias("reference_scale_cm_per_pixel"), (c("l_orderkey") * 100 + c("l_linenumber")).alias("reference_index"))
    cal = o.where("o_orderstatus <> 'O'").select(path(k, "/d/"), who, view(k, ("left", "right")), F.when(k % 3 == 0, c("o_totalprice") / 1000000).alias("scale_cm_per_pixel"))
    return tidy(nearest.lateral_scale(im, refs, cal).select("o_orderkey", "scale", "scale_source"))


LOO1 = EXP1 + """, ls AS (SELECT view, count(*)::DOUBLE AS n, avg(h4) AS mx, avg(truth) AS my, var_pop(h4) AS vx, covar_pop(truth, h4) AS cxy FROM e1 WHERE h4 IS NOT NULL AND truth IS NOT NULL GROUP BY 1),
e2 AS (SELECT e1.*, CASE WHEN h4 IS NOT NULL AND truth IS NOT NULL THEN CASE WHEN n < 8 THEN h4 ELSE my - (truth - my) / (n - 1) + (n * cxy - n / (n - 1) * (h4 - mx) * (truth - my)) / (n * vx - n / (n - 1) * (h4 - mx) * (h4 - mx)) * ((h4 - mx) + (h4 - mx) / (n - 1)) END END AS h5 FROM e1 LEFT JOIN ls USING (view))"""
COMPARISON = LOO1 + """, hz AS (SELECT 'img/' || o_orderkey AS image_path, (o_orderkey % 7)::DOUBLE AS px, 140::DOUBLE + o_orderkey % 50 AS h, (o_orderkey % 17 - 8)::DOUBLE AS ec, CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 23 - 11)::DOUBLE END AS es, (o_orderkey % 5)::DOUBLE AS ef FROM orders WHERE o_orderstatus <> 'O'),
hc AS (SELECT 'img/' || o_orderkey AS image_path, 150::DOUBLE + o_orderkey % 40 AS h, (o_orderkey % 9)::DOUBLE AS px, (o_orderkey % 31 - 15)::DOUBLE AS e, ['subject_front_back', 'per_image_cube_lateral'][1 + o_orderkey % 2] AS src, 'high' AS rel FROM orders WHERE o_orderstatus <> 'F'),
wide AS (SELECT coalesce(e.image_path, hz.image_path, hc.image_path) AS image_path, e.site, e.subject_id, e.view, e.truth, h1 - truth AS a1, h2 - truth AS a2, h3 - truth AS a3, h4 - truth AS a4, h5 - truth AS a5, hz.ec AS a6, hz.es AS a7, hz.ef AS a8, NULL::DOUBLE AS a9, hc.e AS a10, hz.h / nullif(hz.px, 0) AS hs, hc.h / nullif(hc.px, 0) AS cs, src, rel
  FROM e2 e FULL JOIN hz ON hz.image_path = e.image_path FULL JOIN hc ON hc.image_path = coalesce(e.image_path, hz.image_path))"""
_TEN = ", ".join(f"('{m}', 'a{i}')" for i, m in enumerate(tracks.METHODS, 1))
TENS = COMPARISON + f""", lg AS (UNPIVOT (SELECT view, a1, a2, a3, a4, a5, a6, a7, a8, a9, a10 FROM wide) ON a1, a2, a3, a4, a5, a6, a7, a8, a9, a10 INTO NAME col VALUE e),
gr AS (SELECT col, e, unnest(list_filter([view, CASE WHEN view IN ('front', 'back') THEN 'FRONT+BACK' END, CASE WHEN view IN ('left', 'right') THEN 'LEFT+RIGHT' END, 'GLOBAL'], lambda x: x IS NOT NULL)) AS grp FROM lg WHERE e IS NOT NULL),
ag AS (SELECT col, grp, count(*) AS n, avg(e) AS bias, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM gr GROUP BY 1, 2),
mx AS (SELECT method, grp, coalesce(n, 0)::BIGINT AS n, bias, mae, rmse FROM (SELECT * FROM (VALUES {_TEN}) AS v(method, col), (SELECT unnest(['front', 'back', 'left', 'right', 'FRONT+BACK', 'LEFT+RIGHT', 'GLOBAL']) AS grp)) LEFT JOIN ag USING (col, grp))"""


def comparison(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    c, o = F.col, table(spark, d, "orders")
    k = c("o_orderkey")
    path = F.concat(F.lit("img/"), k.cast("string")).alias("image_path")
    number = lambda x, name: x.cast("double").alias(name)
    hz = o.where("o_orderstatus <> 'O'").select(path, number(k % 7, "height_px"), number(140 + k % 50, "H_horizon_cube"), number(k % 17 - 8, "error_horizon_cube"), F.when(k % 6 != 0, (k % 23 - 11).cast("double")).alias("error_horizon_shared"), number(k % 5, "error_feet_single"))
    source = F.when(k % 2 == 0, "subject_front_back").otherwise("per_image_cube_lateral").alias("horizon_corrected_source")
    hc = o.where("o_orderstatus <> 'F'").select(path, number(150 + k % 40, "H_horizon_corrected"), number(k % 9, "height_px"), number(k % 31 - 15, "error_horizon_corrected"), source, F.lit("high").alias("height_reliability"))
    return tracks.compare_methods(tracks.corrected_scale(experiment(spark, d)), hz, hc)


@query(f"WITH {COMPARISON} SELECT image_path, site, subject_id, view, round(truth, 6) AS height_manual_cm, NULL::DOUBLE AS e1_scale_median_cmpx, round(a1, 6) AS e1_err_median, round(a5, 4) AS e1_err_groundline_corr, round(hs, 6) AS hz_scale_cube_cmpx, a7 AS hz_err_shared, a9 AS hz_err_feet_mask, round(cs, 6) AS hzc_scale_equivalent_cmpx, src AS hzc_horizon_source FROM wide")
def comparison_wide(spark: SparkSession, d: str) -> DataFrame:
    w = comparison(spark, d)["wide"].select("image_path", "site", "subject_id", "view", "height_manual_cm", "e1_scale_median_cmpx", "e1_err_median", F.round("e1_err_groundline_corr", 4).alias("e1_err_groundline_corr"), "hz_scale_cube_cmpx", "hz_err_shared", "hz_err_feet_mask", "hzc_scale_equivalent_cmpx", "hzc_horizon_source")
    return tidy(w)


@query(f"WITH {TENS} SELECT method, grp, n, round(bias, 4) AS bias, round(mae, 4) AS mae, round(rmse, 4) AS rmse FROM mx")
def comparison_matrix(spark: SparkSession, d: str) -> DataFrame:
    return tidy(comparison(spark, d)["matrix"], 4)


@query(f"WITH {TENS} SELECT grp, arg_min(method, {{'a': mae, 'b': method}}) AS method, round(min(mae), 4) AS mae FROM mx WHERE mae IS NOT NULL GROUP BY 1")
def comparison_best(spark: SparkSession, d: str) -> DataFrame:
    return tidy(comparison(spark, d)["best"], 4)


@query(f"WITH {COMPARISON} SELECT view, src AS hzc_horizon_source, rel AS hzc_reliability, count(*) AS n FROM wide GROUP BY 1, 2, 3")
def comparison_sources(spark: SparkSession, d: str) -> DataFrame:
    return comparison(spark, d)["sources"]


POSED = """po AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 8 <> 0 THEN 400::DOUBLE + o_orderkey % 9 END AS fy, 90::DOUBLE + o_custkey % 20 AS hy, 80::DOUBLE + o_custkey % 17 AS hm, CASE WHEN o_orderkey % 12 <> 0 THEN 110::DOUBLE + o_orderkey % 13 END AS ey, 10::DOUBLE + o_orderkey % 15 AS fs, ['interocular', 'eye_nose', 'none'][1 + o_orderkey % 3] AS mode, 0.5::DOUBLE + o_custkey % 5 / 100::DOUBLE AS sc, CASE WHEN o_orderkey % 21 <> 0 THEN 165::DOUBLE END AS truth FROM orders)"""


@query(f"""WITH {POSED}, ev AS (SELECT factor, (fy - CASE WHEN mode = 'interocular' THEN CASE WHEN ey IS NOT NULL THEN least(greatest(ey - factor * fs, hm), ey - 1) END ELSE hy END) * sc - truth AS e FROM po, (SELECT CAST(unnest([{", ".join(map(str, FACTORS))}]) AS DOUBLE) AS factor) WHERE fy IS NOT NULL AND truth IS NOT NULL)
SELECT factor, {ERR} FROM ev GROUP BY 1""")
def crown_sweep(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    k, who = c("o_orderkey"), c("o_custkey")
    mode = F.when(k % 3 == 0, "interocular").when(k % 3 == 1, "eye_nose").otherwise("none")
    posed = table(spark, d, "orders").select(
        F.when(k % 8 != 0, (400 + k % 9).cast("double")).alias("feet_y_px"), (90 + who % 20).cast("double").alias("head_y_px"), (80 + who % 17).cast("double").alias("head_y_mask"), F.when(k % 12 != 0, (110 + k % 13).cast("double")).alias("pose_eye_y"),
        (10 + k % 15).cast("double").alias("pose_face_scale"), mode.alias("pose_face_mode"), (0.5 + who % 5 / F.lit(100.0)).alias("scale_closest_feet"), F.when(k % 21 != 0, F.lit(165.0)).alias("height_manual_cm"),
    )
    return tidy(calibrate.crown_sweep(posed))


SHARES = (0.45, 0.50, 0.55, 0.60)
WIDTHS = f"""runs AS (SELECT l_orderkey AS img, l_linenumber AS y, 40 AS x0, 40 + CAST(l_quantity AS BIGINT) AS x1 FROM lineitem UNION ALL SELECT o_orderkey, 100, 40, 60 FROM orders),
ext AS (SELECT img, min(y) AS y_min, max(y) AS y_max FROM runs GROUP BY 1), wide AS (SELECT img, y, max(x1) - min(x0) + 1 AS w FROM runs GROUP BY 1, 2),
hd AS (SELECT w.*, row_number() OVER (PARTITION BY img ORDER BY w DESC) AS r, count(*) OVER (PARTITION BY img) AS n FROM wide w JOIN ext e USING (img) WHERE y <= floor(y_min + 0.12::DOUBLE * (y_max - y_min))),
sk AS (SELECT img, median(w) AS sw FROM hd WHERE r <= greatest(1, n // 3) GROUP BY 1), sh AS (SELECT CAST(unnest({list(SHARES)}) AS DOUBLE) AS share),
tops AS (SELECT img, share, min(y)::DOUBLE AS mh FROM hd JOIN sk USING (img), sh WHERE w >= share * sw GROUP BY 1, 2),
po AS (SELECT o_orderkey AS img, o_custkey % 97 AS s, ['front', 'back', 'left', 'right'][1 + o_orderkey % 4] AS view, CASE WHEN o_orderkey % 11 = 0 THEN 'no_cube' ELSE 'ok' END AS st, 60::DOUBLE + o_orderkey % 40 AS cam, 100::DOUBLE + o_orderkey % 10 AS fe, 5::DOUBLE + o_orderkey % 6 AS hp, CASE WHEN o_orderkey % 13 <> 0 THEN 10::DOUBLE + o_custkey * 7 % 300 / 10::DOUBLE END AS ho FROM orders),
hw AS (SELECT share, po.*, CASE WHEN abs(mh - hp) <= 0.12::DOUBLE * (fe - hp) THEN mh ELSE hp END AS he FROM po CROSS JOIN sh LEFT JOIN tops USING (img, share)),
cu AS (SELECT *, coalesce(st = 'ok' AND h > 40 AND h < 230, FALSE) AS ok FROM (SELECT *, CASE WHEN fe - he > 0 AND abs(fe - ho) > 1e-6 THEN cam * ((fe - he) / (fe - ho)) END AS h FROM hw)),
fb AS (SELECT share, s, ho FROM cu WHERE ok AND view IN ('front', 'back')), la AS (SELECT share, s, ho FROM cu WHERE ok AND view IN ('left', 'right')), su AS (SELECT DISTINCT share, s FROM cu),
gf AS (SELECT su.share, su.s, median(CASE WHEN fb.s <> su.s THEN ho END) AS v FROM su JOIN fb ON fb.share = su.share GROUP BY 1, 2), gl AS (SELECT su.share, su.s, median(CASE WHEN la.s <> su.s THEN ho END) AS v FROM su JOIN la ON la.share = su.share GROUP BY 1, 2),
sf AS (SELECT share, s, median(ho) AS v FROM fb GROUP BY 1, 2), sl AS (SELECT share, s, median(ho) AS v FROM la GROUP BY 1, 2),
pk AS (SELECT cu.*, CASE WHEN view IN ('front', 'back') THEN coalesce(sf.v, CASE WHEN ok THEN ho END, gf.v, gl.v) ELSE coalesce(CASE WHEN ok THEN ho END, sl.v, sf.v, gf.v, gl.v) END AS y FROM cu LEFT JOIN sf USING (share, s) LEFT JOIN sl USING (share, s) LEFT JOIN gf USING (share, s) LEFT JOIN gl USING (share, s)),
er AS (SELECT share, view, CASE WHEN fe - he > 0 AND abs(fe - y) > 1e-6 THEN cam * ((fe - he) / (fe - y)) END - 170 AS e FROM pk),
sw AS (SELECT share, count(e) FILTER (view IN ('front', 'back')) AS n_fb, avg(abs(e)) FILTER (view IN ('front', 'back')) AS f, avg(abs(e)) FILTER (view = 'left') AS l, avg(abs(e)) FILTER (view = 'right') AS r FROM er GROUP BY 1)"""


@query(f"WITH {WIDTHS} SELECT share, n_fb, round(f, 6) AS mae_front_back, round(l, 6) AS mae_left, round(r, 6) AS mae_right, share = (SELECT arg_min(share, {{'f': f, 's': share}}) FROM sw) AS best FROM sw")
def head_width_sweep(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    k, who = c("o_orderkey"), c("o_custkey")
    im = table(spark, d, "orders").select(
        k.alias("img"), (who % 97).alias("subject_id"), F.array(*map(F.lit, tracks.VIEWS))[(k % 4).cast("int")].alias("view"), F.when(k % 11 == 0, "no_cube").otherwise("ok").alias("status"), (60 + k % 40).cast("double").alias("camera_cm"),
        (100 + k % 10).cast("double").alias("y_feet"), (5 + k % 6).cast("double").alias("y_head"), F.when(k % 13 != 0, 10 + who * 7 % 300 / F.lit(10.0)).alias("y_horizon_cube"), F.lit(170.0).alias("height_manual_cm"),
    )
    lines = table(spark, d, "lineitem").select(c("l_orderkey").alias("img"), c("l_linenumber").alias("y"), F.lit(40).alias("x0"), (40 + c("l_quantity").cast("int")).alias("x1"))
    feet = table(spark, d, "orders").select(k.alias("img"), F.lit(100).alias("y"), F.lit(40).alias("x0"), F.lit(60).alias("x1"))
    return tidy(tracks.head_width_sweep(lines.union(feet), im, SHARES, "img"))


@query("""WITH q AS (SELECT vec_id, list_transform(range(1, 5), lambda i: sqrt(pow(embedding[2 * i - 1]::DOUBLE - embedding[2 * (i % 4) + 1]::DOUBLE, 2) + pow(embedding[2 * i]::DOUBLE - embedding[2 * (i % 4) + 2]::DOUBLE, 2))) AS s, embedding[9]::DOUBLE AS c FROM embeddings)
SELECT vec_id, round(list_avg(s), 6) AS side, round(list_min(s) / nullif(list_max(s), 0), 6) AS squareness, round(10 / nullif(list_avg(s), 0), 6) AS scale, round(CASE WHEN c > 0 THEN 1.4::DOUBLE / c END, 6) AS circle FROM q""")
def marker_scales(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    corner = lambda i: F.struct(F.col("embedding")[2 * i].cast("double").alias("x"), F.col("embedding")[2 * i + 1].cast("double").alias("y"))
    marked = e.select("vec_id", F.array(*(corner(i) for i in range(4))).alias("corners"), F.col("embedding")[8].cast("double").alias("diameter"))
    return tidy(marked.select("vec_id", *(v.alias(n) for n, v in geometry.square(F.col("corners")).items()), geometry.circle_scale(F.col("diameter")).alias("circle")))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS h, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE 52::DOUBLE END AS img, CASE l_linenumber % 3 WHEN 0 THEN 'invalid_height_px' ELSE 'ok' END AS st, CASE l_suppkey % 2 WHEN 0 THEN 'ok' ELSE 'small_mask' END AS seg FROM lineitem),
w AS (SELECT *, CASE WHEN st = 'ok' AND seg <> 'ok' THEN 'ok_with_warning_' || seg ELSE st END AS ws, CASE WHEN img > 0 THEN h / img ELSE 0 END AS f FROM b)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN ws LIKE 'ok%' AND f > 0.95 THEN 'suspect_mask_covers_image' WHEN ws LIKE 'ok%' AND f < 0.15 THEN 'suspect_mask_too_small' ELSE ws END AS landmark_status FROM w""")
def body_status(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("l_linenumber")
    li = table(spark, d, "lineitem").select("l_orderkey", i, F.col("l_quantity").alias("h"), F.when(i % 5 == 0, 0.0).otherwise(52.0).alias("img_h"), F.when(i % 3 == 0, "invalid_height_px").otherwise("ok").alias("landmark_status"), F.when(F.col("l_suppkey") % 2 == 0, "ok").otherwise("small_mask").alias("segmentation_status"))
    return tidy(mask.body_status(li, "h", "img_h").select("l_orderkey", "l_linenumber", "landmark_status"))

"""Queries over the tables of a folder, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators import contracts, drift, metrics, neighbors, preprocess, regression, scoring, synthetic, tensor, training
from skarn.operators.ordered import quantiles

SPLIT = "1999-01-01"
NUMERIC, CATEGORICAL = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """The columns rounded, without negative zero."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in names})


# contracts

LINEITEM_CONTRACT = contracts.Contract.of({
    "row_count": {"min": 1},
    "columns": {
        "l_orderkey": {"dtype": "int", "nullable": False, "min": 1}, "l_partkey": {"dtype": "int"}, "l_suppkey": {"dtype": "int", "max": 5},
        "l_linenumber": {"dtype": "int", "min": 2, "max": 6}, "l_quantity": {"dtype": "int", "nullable": False, "max": 49}, "l_extendedprice": {"dtype": "int", "min": 0},
        "l_discount": {"dtype": "float", "min": 0.01, "max": 0.09}, "l_tax": {"dtype": "string"}, "l_returnflag": {"dtype": "str", "allowed": ["A", "N"]},
        "l_linestatus": {"dtype": "str", "allowed": ["F", "O"]}, "l_shipdate": {"nullable": False}, "l_comment": {"dtype": "str"}, "l_odd": {"dtype": "date"},
    },
})

@query("""
with t as (select nullif(l_quantity, 25) as q, * from lineitem),
a as (select count(*) filter (where l_suppkey > 5) as supp, count(*) filter (where l_linenumber < 2) as line_low, count(*) filter (where l_linenumber > 6) as line_high,
  count(*) filter (where q is null) as q_null, count(*) filter (where q > 49) as q_high, count(*) filter (where l_extendedprice % 1 <> 0) as price_frac, count(*) filter (where l_extendedprice < 0) as price_low,
  count(*) filter (where l_discount < 0.01::double) as disc_low, count(*) filter (where l_discount > 0.09::double) as disc_high, count(*) as n,
  count(*) filter (where l_returnflag not in ('A', 'N')) as flag, count(*) filter (where l_linestatus not in ('F', 'O')) as status, count(*) filter (where l_orderkey < 1) as key_low from t),
issues as (
  select 'l_suppkey' as "column", 'range.max' as rule, 'error' as severity, supp as n_offending, supp > 0 as failed from a union all
  select 'l_linenumber', 'range.min', 'error', line_low, line_low > 0 from a union all select 'l_linenumber', 'range.max', 'error', line_high, line_high > 0 from a union all
  select 'l_quantity', 'nullability', 'error', q_null, q_null > 0 from a union all select 'l_quantity', 'range.max', 'error', q_high, q_high > 0 from a union all
  select 'l_extendedprice', 'dtype', 'error', 0, price_frac > 0 from a union all select 'l_extendedprice', 'range.min', 'error', price_low, price_low > 0 and price_frac = 0 from a union all
  select 'l_discount', 'range.min', 'error', disc_low, disc_low > 0 from a union all select 'l_discount', 'range.max', 'error', disc_high, disc_high > 0 from a union all
  select 'l_tax', 'dtype', 'error', 0, n > 0 from a union all select 'l_returnflag', 'allowed_values', 'error', flag, flag > 0 from a union all
  select 'l_linestatus', 'allowed_values', 'error', status, status > 0 from a union all select 'l_orderkey', 'range.min', 'error', key_low, key_low > 0 from a union all
  select 'l_comment', 'column.missing', 'error', 0, true union all select 'l_odd', 'column.missing', 'error', 0, true)
select "column", rule, severity, n_offending::bigint as n_offending from issues where failed
""")
def schema_issues_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.nullif("l_quantity", F.lit(25.0)))
    return contracts.validate(df, LINEITEM_CONTRACT).drop("message")


EVENTS_CONTRACT = contracts.Contract.of({
    "row_count": {"min": 1_000_000_000},
    "columns": {"event_id": {"dtype": "int", "nullable": False}, "user_id": {"dtype": "float", "min": 0}, "event_type": {"dtype": "str", "allowed": ["none"]}, "value": {"dtype": "date"}, "props": {"dtype": "bool"}},
})


@query("""
with bad as (select distinct event_type from events where event_type <> 'none' order by event_type limit 5),
a as (select count(*) as n, count(*) filter (where event_type <> 'none') as other, count(*) filter (where user_id < 0) as low, count(props) as props from events)
select * from (
  select null as "column", 'row_count.min' as rule, 'error' as severity, 0::bigint as n_offending, n || ' rows, at least 1000000000 wanted' as message from a where n < 1000000000 union all
  select 'event_type', 'allowed_values', 'error', other, other || ' values outside the allowed: ' || (select string_agg(event_type, ', ' order by event_type) from bad) from a where other > 0 union all
  select 'user_id', 'range.min', 'error', low, low || ' values below 0' from a where low > 0 union all
  select 'props', 'dtype', 'error', 0, props || ' values are no bool' from a where props > 0 union all
  select 'value', 'dtype.unknown', 'error', 0, 'type date is not supported' union all
  select 'ts', 'column.unexpected', 'warning', 0, 'column ts is there and not declared')
""")
def schema_issues_events(spark, sf_dir):
    return contracts.validate(table(spark, sf_dir, "events"), EVENTS_CONTRACT)


@query("""
select 'whole' as "column", 'dtype' as rule, 0::bigint as n_offending where (select count(*) from orders where o_orderkey % 7 = 0) > 0 union all
select 'odd', 'dtype', 0 where (select count(*) from orders where o_orderkey % 5 = 0) > 0 union all
select 'flag', 'range.max', (select count(*) from orders where o_orderkey % 2 = 0) where (select count(*) from orders where o_orderkey % 2 = 0) > 0
""")
def schema_dtype_coercion(spark, sf_dir):
    """Text that is a number or not, fractions in whole-number columns, booleans as numbers."""
    key = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").select(
        F.when(key % 7 == 0, "12abc").when(key % 3 == 0, " 1e3 ").otherwise(key.cast("string")).alias("text_number"),
        F.when(key % 7 == 0, 1.5).otherwise(2.0).alias("whole"), F.when(key % 5 == 0, "1.0d").otherwise("3").alias("odd"), (key % 2 == 0).alias("flag"), F.lit(None).cast("string").alias("empty"),
    )
    rules = {"text_number": {"dtype": "str"}, "whole": {"dtype": "int"}, "odd": {"dtype": "float"}, "flag": {"dtype": "int", "max": 0}, "empty": {"dtype": "float", "min": 1}}
    return contracts.validate(df, contracts.Contract.of({"columns": rules})).select("column", "rule", "n_offending")


# drift


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items shipped before SPLIT and after; the later with quantities half as large again and without one flag on the reference side."""
    df = table(spark, sf_dir, "lineitem")
    early = F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp_ntz")
    reference = df.where(early).withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("R")))
    current = df.where(~early).withColumn("l_quantity", F.col("l_quantity") * 1.5)
    return reference, current


_SIDES = f"""
s as (select l_shipdate < timestamp '{SPLIT}' as is_reference, case when l_shipdate < timestamp '{SPLIT}' then l_quantity else l_quantity * 1.5 end as l_quantity,
  l_extendedprice, l_discount, l_tax, case when l_shipdate < timestamp '{SPLIT}' then nullif(l_returnflag, 'R') else l_returnflag end as l_returnflag, l_linestatus from lineitem),
num as (select is_reference, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) as feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) as value from s),
cat as (select is_reference, unnest(['l_returnflag', 'l_linestatus']) as feature, unnest([l_returnflag, l_linestatus]) as value from s)
"""
_EDGES = """
q as (select feature, list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) as a from num where is_reference group by feature),
edges as (select feature, list_filter(list_sort(a), lambda x: x > list_min(a) and x < list_max(a)) as edges from q)
"""
_PSI_NUM = """
binned as (select n.feature, len(list_filter(e.edges, lambda x: x <= n.value)) as bin, count(*) filter (where is_reference)::double as ref, count(*) filter (where not is_reference)::double as cur
  from num n join edges e using (feature) group by 1, 2),
shared as (select feature, ref / sum(ref) over (partition by feature) as r, cur / sum(cur) over (partition by feature) as c, sum(ref) over (partition by feature) as nr, sum(cur) over (partition by feature) as nc from binned),
psi_num as (select feature, sum(((case when c = 0 then 1e-4 else c end) - (case when r = 0 then 1e-4 else r end)) * ln((case when c = 0 then 1e-4 else c end) / (case when r = 0 then 1e-4 else r end))) as psi, max(nr)::bigint as n_reference, max(nc)::bigint as n_current from shared group by feature)
"""
_COUNTS = """
counts as (select feature, value, count(*) filter (where is_reference)::double as ref, count(*) filter (where not is_reference)::double as cur from cat where value is not null group by 1, 2),
cshared as (select *, ref / sum(ref) over (partition by feature) as r, cur / sum(cur) over (partition by feature) as c, sum(ref) over (partition by feature) as nr, sum(cur) over (partition by feature) as nc from counts)
"""
_PSI_CAT = """
psi_cat as (select feature, sum(((case when c = 0 then 1e-4 else c end) - (case when r = 0 then 1e-4 else r end)) * ln((case when c = 0 then 1e-4 else c end) / (case when r = 0 then 1e-4 else r end))) as psi, max(nr)::bigint as n_reference, max(nc)::bigint as n_current from cshared group by feature)
"""
_CHI = """
chi as (select feature, sum((ref - (ref + cur) * nr / (nr + nc)) ** 2 / ((ref + cur) * nr / (nr + nc)) + (cur - (ref + cur) * nc / (nr + nc)) ** 2 / ((ref + cur) * nc / (nr + nc))) as chi_square from cshared group by feature)
"""
_KS = """
v as (select feature, value, count(*) filter (where is_reference)::double as r, count(*) filter (where not is_reference)::double as c from num group by 1, 2),
f as (select feature, sum(r) over w / sum(r) over (partition by feature) as fr, sum(c) over w / sum(c) over (partition by feature) as fc from v window w as (partition by feature order by value)),
ks as (select feature, max(abs(fr - fc)) as ks from f group by feature)
"""
_NEW = "fresh as (select feature, count(*) as n_new, array_to_string(list_sort(list(value))[1:5], ',') as first_new from counts where ref = 0 and cur > 0 group by feature)"


@query(f"with {_SIDES}, {_EDGES} select feature, position - 1 as position, round(edge, 6) as edge from (select feature, unnest(edges) as edge, generate_subscripts(edges, 1) as position from edges)")
def drift_bin_edges(spark, sf_dir):
    edges = drift.bin_edges(drift.value_ranks(drift.long_numeric(*sides(spark, sf_dir), NUMERIC)))
    return rounded(edges.select("feature", F.posexplode("edges").alias("position", "edge")).withColumn("position", F.col("position").cast("bigint")), "edge")


@query(f"with {_SIDES}, {_EDGES}, {_PSI_NUM} select feature, round(psi, 6) + 0.0 as psi, n_reference, n_current from psi_num")
def drift_psi_numeric(spark, sf_dir):
    return rounded(drift.psi_numeric(drift.value_ranks(drift.long_numeric(*sides(spark, sf_dir), NUMERIC))), "psi")


@query(f"with {_SIDES}, {_COUNTS}, {_PSI_CAT} select feature, round(psi, 6) + 0.0 as psi, n_reference, n_current from psi_cat")
def drift_psi_categorical(spark, sf_dir):
    return rounded(drift.psi_categorical(drift.value_counts(drift.long_categorical(*sides(spark, sf_dir), CATEGORICAL))), "psi")


@query(f"with {_SIDES}, {_KS} select feature, round(ks, 6) + 0.0 as ks from ks")
def drift_ks(spark, sf_dir):
    return rounded(drift.ks(drift.value_ranks(drift.long_numeric(*sides(spark, sf_dir), NUMERIC))), "ks")


@query(f"with {_SIDES}, {_COUNTS}, {_CHI} select feature, round(chi_square, 4) + 0.0 as chi_square from chi")
def drift_chi_square(spark, sf_dir):
    return rounded(drift.chi_square(drift.value_counts(drift.long_categorical(*sides(spark, sf_dir), CATEGORICAL))), "chi_square", digits=4)


@query(f"with {_SIDES}, {_COUNTS}, {_NEW} select * from fresh")
def drift_new_categories(spark, sf_dir):
    return drift.new_categories(drift.value_counts(drift.long_categorical(*sides(spark, sf_dir), CATEGORICAL)))


LIMITS = {"psi_warn": 0.1, "psi_fail": 0.25, "ks_fail": 0.1}
DRIFT = drift.DriftConfig({**{f: LIMITS for f in NUMERIC}, "l_gone": LIMITS}, {f: {"psi_warn": 0.1, "psi_fail": 0.25} for f in CATEGORICAL})


@query(f"""
with {_SIDES}, {_EDGES}, {_PSI_NUM}, {_KS}, {_COUNTS}, {_PSI_CAT}, {_CHI}, {_NEW},
r as (
  select feature, 'numeric' as kind, psi, ks, null::double as chi_square, n_reference, n_current, null::varchar as note from psi_num join ks using (feature) union all
  select feature, 'categorical', psi, null, chi_square, n_reference, n_current, 'new categories: ' || first_new from psi_cat join chi using (feature) left join fresh using (feature))
select feature, kind, round(psi, 6) + 0.0 as psi, round(ks, 6) + 0.0 as ks, round(chi_square, 4) + 0.0 as chi_square, n_reference, n_current,
  case when psi >= 0.25 or ks >= 0.1 then 'fail' when psi >= 0.1 then 'warn' else 'ok' end as status, note from r
union all select 'l_gone', 'numeric', null, null, null, 0, 0, 'fail', 'the feature is missing on a side'
""")
def drift_report(spark, sf_dir):
    out = drift.detect(*sides(spark, sf_dir), DRIFT).drop("position")
    return rounded(rounded(out, "ks", "chi_square", digits=6).withColumns({"psi": F.nullif("psi", F.lit(float("nan"))), "chi_square": F.round("chi_square", 4)}), "psi")


@query(f"""
with {_SIDES}, {_EDGES}, {_PSI_NUM}, {_KS}, {_COUNTS}, {_PSI_CAT},
st as (select case when psi >= 0.25 or ks >= 0.1 then 2 when psi >= 0.1 then 1 else 0 end as st from psi_num join ks using (feature) union all select case when psi >= 0.25 then 2 when psi >= 0.1 then 1 else 0 end from psi_cat union all select 2)
select count(*) as n_features, count(*) filter (where st = 1) as n_warnings, count(*) filter (where st = 2) as n_failures, count(*) filter (where st = 2) = 0 as passed from st
""")
def drift_summary(spark, sf_dir):
    return drift.summary(drift.detect(*sides(spark, sf_dir), DRIFT))


# scoring

MODEL = scoring.ExpressionScorer("1 / (1 + exp(-(o_totalprice - 250000) / 100000))")
_SCORED = "scored as (select o_orderkey, 1 / (1 + exp(-(o_totalprice - 250000) / 100000)) as probability from orders), s as (select *, (probability >= 0.5)::int as prediction, ((row_number() over (order by o_orderkey) - 1) // 1000)::bigint as chunk from scored)"
_CHUNKS = "c as (select chunk, count(*) as n, sum(prediction)::bigint as positives, avg(probability) as mean, stddev_pop(probability) as std, quantile_cont(probability, 0.5) as p50, quantile_cont(probability, 0.95) as p95 from s group by chunk)"


def scored_orders(spark, sf_dir) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "orders"), MODEL, 0.5, "o_orderkey")


@query(f"with {_SCORED} select o_orderkey, round(probability, 9) as probability, prediction from s")
def score_orders(spark, sf_dir):
    return rounded(scored_orders(spark, sf_dir), "probability", digits=9)


@query(f"with {_SCORED}, {_CHUNKS} select chunk, n, positives, round(positives / n, 9) as positive_rate, round(mean, 9) as mean, round(std, 9) as std, round(p50, 9) as p50, round(p95, 9) as p95 from c")
def score_chunk_metrics(spark, sf_dir):
    return rounded(scoring.chunk_metrics(scoring.chunked(scored_orders(spark, sf_dir), "o_orderkey", 1000)), "positive_rate", "mean", "std", "p50", "p95", digits=9)


_TOTAL = "round(sum(positives) / sum(n), 9) as positive_rate, (select round(avg(probability), 9) from s) as mean, (select round(stddev_pop(probability), 9) from s) as std"


@query(f"with {_SCORED}, {_CHUNKS} select sum(n)::bigint as n, sum(positives)::bigint as positives, {_TOTAL}, round(sum(p50 * n) / sum(n), 9) as p50, round(sum(p95 * n) / sum(n), 9) as p95 from c")
def score_aggregate_compat(spark, sf_dir):
    out = scoring.aggregate_compat(scoring.chunked(scored_orders(spark, sf_dir), "o_orderkey", 1000))
    return rounded(out, "positive_rate", "mean", "std", "p50", "p95", digits=9)


@query(f"with {_SCORED}, {_CHUNKS} select sum(n)::bigint as n, sum(positives)::bigint as positives, {_TOTAL}, (select round(quantile_cont(probability, 0.5), 9) from s) as p50, (select round(quantile_cont(probability, 0.95), 9) from s) as p95 from c")
def score_aggregate_exact(spark, sf_dir):
    return rounded(scoring.aggregate_exact(scored_orders(spark, sf_dir)), "positive_rate", "mean", "std", "p50", "p95", digits=9)


@query(f"with {_SCORED} select o_orderkey, round(probability, 9) as probability, prediction from s order by o_orderkey limit 20")
def score_sample_topn(spark, sf_dir):
    return rounded(scoring.sample(scored_orders(spark, sf_dir), "o_orderkey", 20), "probability", digits=9)


@query(f"with {_SCORED} select o.*, round(probability, 9) as churn_probability, prediction as churn_prediction from s join (select * exclude (o_orderstatus) from orders) o using (o_orderkey)")
def score_keep_features(spark, sf_dir):
    """As in scoring a file: the target is dropped, all other columns stay."""
    out = scoring.score(table(spark, sf_dir, "orders"), MODEL, 0.5, drop=("o_orderstatus", "absent"), probability="churn_probability", prediction="churn_prediction", keep_features=True)
    return rounded(out, "churn_probability", digits=9)


# metrics

_LABELLED = "d as (select n_chars::double as score, quality as y from documents join labels using (doc_id))"


def labelled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")).join(table(spark, sf_dir, "labels"), "doc_id").select("score", F.col("quality").alias("y"))


@query(f"with {_LABELLED}, r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as k from d) select round((sum(k) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y)::double * sum(1 - y)), 9) as roc_auc from r")
def metric_roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(labelled(spark, sf_dir), "y", "score"), "roc_auc", digits=9)


@query(f"with {_LABELLED}, g as (select score, sum(y)::double as pos, count(*)::double as n from d group by score), c as (select pos, sum(pos) over w as tp, sum(n) over w as k, sum(pos) over () as p from g window w as (order by score desc)) select round(sum(pos / p * tp / k), 9) as average_precision from c")
def metric_average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(labelled(spark, sf_dir), "y", "score"), "average_precision", digits=9)


@query(f"with {_LABELLED}, t as (select count(*) as n, count(*) filter (where y = 1 and score >= 2000) as tp, count(*) filter (where y = 0 and score >= 2000) as fp, count(*) filter (where y = 1 and score < 2000) as fn, avg(y) as pr from d) select n, round((n - fp - fn) / n, 9) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) as \"precision\", round(coalesce(tp / nullif(tp + fn, 0), 0), 9) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) as f1, round(pr, 9) as positive_rate, 2000.0::double as threshold from t")
def metric_threshold_suite(spark, sf_dir):
    return rounded(metrics.threshold_suite(labelled(spark, sf_dir), "y", "score", 2000), "accuracy", "precision", "recall", "f1", "positive_rate", digits=9)


@query(f"with {_LABELLED}, g as (select * from (values (0), (1)) a(label), (values (0), (1)) b(prediction)) select g.label, g.prediction, count(d.y) as n from g left join d on d.y = g.label and (d.score >= 2000)::int = g.prediction group by 1, 2")
def metric_confusion_matrix(spark, sf_dir):
    df = labelled(spark, sf_dir).withColumn("p", (F.col("score") >= 2000).cast("int"))
    return metrics.confusion(df, "y", "p", [0, 1])


@query("with p as (select l_extendedprice as y, 1000.0::double * l_quantity + 100 as p from lineitem) select count(*) as n, round(avg((y - p) ** 2), 2) as mse, round(sqrt(avg((y - p) ** 2)), 4) as rmse, round(1 - avg((y - p) ** 2) / var_pop(y), 9) as r2 from p")
def regression_metrics(spark, sf_dir):
    df = regression.predict(table(spark, sf_dir, "lineitem"), "l_quantity", [100.0, 1000.0])
    return rounded(rounded(rounded(metrics.regression(df, "l_extendedprice", "predicted"), "mse", digits=2), "rmse", digits=4), "r2", digits=9)


# preprocessing


def holed(spark, sf_dir) -> DataFrame:
    """Line items with missing quantities, NaN discounts and missing flags."""
    df = table(spark, sf_dir, "lineitem")
    return df.withColumns({"l_quantity": F.nullif("l_quantity", F.lit(25.0)), "l_discount": F.when(F.col("l_linenumber") == 3, float("nan")).otherwise(F.col("l_discount")), "l_returnflag": F.nullif("l_returnflag", F.lit("N"))})


_HOLED = "h as (select * replace (nullif(l_quantity, 25) as l_quantity, case when l_linenumber = 3 then null else l_discount end as l_discount, nullif(l_returnflag, 'N') as l_returnflag) from lineitem)"
_HOLED_LONG = "long as (select unnest(['l_quantity', 'l_discount', 'l_extendedprice']) as feature, unnest([l_quantity, l_discount, l_extendedprice]) as value from h)"
HOLED = ["l_quantity", "l_discount", "l_extendedprice"]


@query(f"with {_HOLED}, {_HOLED_LONG} select feature, round(quantile_cont(value, 0.5), 6) + 0.0 as median from long group by feature")
def impute_median(spark, sf_dir):
    return rounded(preprocess.medians(holed(spark, sf_dir), HOLED), "median")


@query(f"with {_HOLED}, t as (select unnest(['l_returnflag', 'l_linestatus']) as feature, unnest([l_returnflag, l_linestatus]) as value from h), c as (select feature, value, count(*) as n from t where value is not null group by 1, 2) select feature, arg_max(value, (n, -ascii(value))) as mode from c group by feature")
def impute_mode(spark, sf_dir):
    return preprocess.modes(holed(spark, sf_dir), CATEGORICAL)


@query(f"with {_HOLED} select l_orderkey, l_linenumber, coalesce(l_quantity, 26.0) as l_quantity, coalesce(l_discount, 0.05) as l_discount, coalesce(l_returnflag, 'R') as l_returnflag from h")
def impute_apply(spark, sf_dir):
    out = preprocess.impute(holed(spark, sf_dir), {"l_quantity": 26.0, "l_discount": 0.05, "l_returnflag": "R"})
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")


@query(f"with {_HOLED}, {_HOLED_LONG} select feature, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as scale from long group by feature union all select 'constant', 1.0, 1.0")
def standard_scale(spark, sf_dir):
    return rounded(preprocess.moments(holed(spark, sf_dir).withColumn("constant", F.lit(1.0)), [*HOLED, "constant"]), "mean", "scale")


@query("with v as (select l_returnflag as value, row_number() over (order by l_returnflag) - 1 as position from (select distinct l_returnflag from lineitem where l_returnflag <> 'N')), w as (select l_linestatus as value, row_number() over (order by l_linestatus) - 1 as position from (select distinct l_linestatus from lineitem where l_returnflag <> 'N')) select l_orderkey, 'l_returnflag' as feature, v.position from lineitem join v on v.value = l_returnflag union all select l_orderkey, 'l_linestatus', w.position from lineitem join w on w.value = l_linestatus")
def one_hot_long(spark, sf_dir):
    """Fitted without one flag, which then is unknown."""
    df = table(spark, sf_dir, "lineitem")
    return preprocess.one_hot(df.where("l_returnflag <> 'N'"), df, "l_orderkey", CATEGORICAL).withColumn("position", F.col("position").cast("bigint"))


_CHURN = "c as (select c_custkey, (max(o_orderdate) is null or max(o_orderdate) < timestamp '2000-01-01')::int as label, count(o_orderkey) as n_orders, coalesce(sum(o_totalprice), 0) as spent, any_value(c_acctbal) as c_acctbal, any_value(c_mktsegment) as c_mktsegment from customer left join orders on o_custkey = c_custkey group by c_custkey)"


def customers(spark, sf_dir) -> DataFrame:
    """A row for each customer; label: no order from 2000 on."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("spent"))
    joined = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    label = F.coalesce(F.col("last") < F.lit("2000-01-01").cast("timestamp_ntz"), F.lit(True)).cast("int")
    return joined.select("c_custkey", label.alias("label"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("spent", F.lit(0.0)).alias("spent"), "c_acctbal", "c_mktsegment")


@query(f"with {_CHURN} select c_custkey, label, ((row_number() over (partition by label order by md5(c_custkey::varchar), c_custkey) - 1) % 5)::int as fold from c")
def stratified_folds(spark, sf_dir):
    return preprocess.stratified_folds(customers(spark, sf_dir), "label", "c_custkey", 5).select("c_custkey", "label", "fold")


@query(f"with {_CHURN} select c_custkey, label, row_number() over (partition by label order by md5(c_custkey::varchar), c_custkey) - 1 < round(count(*) over (partition by label) * 0.2::double) as is_test from c")
def stratified_split(spark, sf_dir):
    return preprocess.stratified_split(customers(spark, sf_dir), "label", "c_custkey", 0.2).select("c_custkey", "label", "is_test")


@query(f"with {_CHURN} select c_custkey, row_number() over (order by md5(c_custkey::varchar), c_custkey) - 1 < ceil(count(*) over () * 0.25::double) as is_test from c")
def random_split(spark, sf_dir):
    """A plain split, whatever the label."""
    return preprocess.random_split(customers(spark, sf_dir), "c_custkey", 0.25).select("c_custkey", "is_test")


# regression


@query("select round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_r2(l_extendedprice, l_quantity), 9) as r2 from lineitem")
def ols_simple(spark, sf_dir):
    return rounded(rounded(rounded(regression.simple(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), "slope"), "intercept", digits=4), "r2", digits=9)


@query("""
with d as (select (l_quantity - 25) / 10 as x, 2 * ((l_quantity - 25) / 10) ** 2 + l_tax as y from lineitem),
r as (select regr_slope(x * x, x) as s, regr_intercept(x * x, x) as i, regr_slope(y, x) as sy, regr_intercept(y, x) as iy from d),
q as (select covar_pop(x * x - s * x - i, y) / var_pop(x * x - s * x - i) as c2, max(s) as s, max(i) as i, max(sy) as sy, max(iy) as iy from d, r),
co as (select unnest([0, 1, 2]) as power, unnest([iy - c2 * i, sy - c2 * s, c2]) as coefficient from q)
select power, round(coefficient, 6) + 0.0 as coefficient from co
""")
def ols_polynomial(spark, sf_dir):
    """A near-exact parabola of the quantity."""
    x = (F.col("l_quantity") - 25) / 10
    df = table(spark, sf_dir, "lineitem").select(x.alias("x"), (2 * x * x + F.col("l_tax")).alias("y"))
    fit = regression.polynomial(df, "x", "y", 2)
    return rounded(spark.createDataFrame([(k, float(c)) for k, c in enumerate(fit)], "power int, coefficient double"), "coefficient")


@query("""
with d as (select o_orderkey, (o_orderkey % 100) / 50.0::double as x, 3 * ((o_orderkey % 100) / 50.0::double) + o_totalprice / 1000000 as y from orders),
s as (select *, row_number() over (order by md5(o_orderkey::varchar), o_orderkey) - 1 < ceil(count(*) over () * 0.2::double) as is_test from d),
f as (select regr_slope(y, x) as b, regr_intercept(y, x) as a from s where not is_test)
select count(*) as n, round(avg((y - a - b * x) ** 2), 6) as mse, round(sqrt(avg((y - a - b * x) ** 2)), 6) as rmse, round(1 - avg((y - a - b * x) ** 2) / var_pop(y), 6) as r2 from s, f where is_test
""")
def polynomial_held_out(spark, sf_dir):
    """A line fitted on four fifths of the orders, judged on the others."""
    x = (F.col("o_orderkey") % 100) / 50.0
    df = table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x"), (3 * x + F.col("o_totalprice") / 1000000).alias("y"))
    return rounded(regression.held_out(df, "o_orderkey", "x", "y", 1)[1], "mse", "rmse", "r2")


@query("select round(-5 + i * 10.0 / 99, 9) as x, round(7 + 3 * (-5 + i * 10.0 / 99), 9) as predicted from range(100) t(i)")
def regression_grid(spark, sf_dir):
    return rounded(regression.grid(spark, -5.0, 5.0, 100, [7.0, 3.0]), "x", "predicted", digits=9)


@query("""
with recursive m as (select avg(x) as x, avg(y) as y, avg(x * x) as xx, avg(x * y) as xy, avg(y * y) as yy from (select l_quantity / 50 as x, l_extendedprice / 100000 as y from lineitem)),
g(epoch, w, b, w0, b0) as (
  select 0, 0 - 0.01::double * 2 * (-xy), 0 - 0.01::double * 2 * (-y), 0.0::double, 0.0::double from m
  union all select epoch + 1, w - 0.01::double * (2 * (w * xx + b * x - xy)), b - 0.01::double * (2 * (w * x + b - y)), w, b from g, m where epoch < 999)
select epoch, round(w, 8) as w, round(b, 8) as b, round(w0 * w0 * xx + 2 * w0 * b0 * x + b0 * b0 - 2 * w0 * xy - 2 * b0 * y + yy, 8) as loss from g, m
""")
def gd_linear(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 100000).alias("y"))
    return rounded(regression.gradient_descent(df, "x", "y"), "w", "b", "loss", digits=8)


# neighbours: the queries are all rows whose id is divisible by 20, against all other rows

_NEAR = "n as (select q.vec_id as query, r.vec_id as neighbour, r.label, row_number() over (partition by q.vec_id order by list_distance(q.embedding::double[], r.embedding::double[]), r.vec_id) as rank from embeddings q join embeddings r on r.vec_id <> q.vec_id where q.vec_id % 20 = 0)"
_VOTE = "select query, label, count(*) as n from n where rank <= 3 group by 1, 2"


def _nearest(spark, sf_dir, k: int) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbors.nearest(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", "label", k)


@query(f"with {_NEAR}, v as ({_VOTE}) select query, arg_min(label, (-n, label)) as predicted from v group by query")
def knn_classify(spark, sf_dir):
    return neighbors.vote(_nearest(spark, sf_dir, 3), 3)


@query(f"with {_NEAR}, e as (select query, label, unnest(range(rank, 51)) as k from n where rank <= 50), c as (select k, query, label, count(*) as n from e group by all), p as (select k, query, arg_min(label, (-n, label)) as predicted from c group by 1, 2) select k::int as k, round(avg((predicted = t.label)::int), 9) as accuracy from p join embeddings t on t.vec_id = query group by 1")
def knn_k_sweep(spark, sf_dir):
    truth = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query"), F.col("label").alias("actual"))
    return rounded(neighbors.sweep(_nearest(spark, sf_dir, 50), truth, 50), "accuracy", digits=9)


# arrays

KERNEL = [[round(0.1 * ((r * 5 + c) % 7) - 0.3, 1) for c in range(5)] for r in range(5)]
_VECTOR = "e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings)"


@query(f"with {_VECTOR} select vec_id, round(list_sum(list_transform(v, lambda x: x + x * x)), 6) + 0.0 as summed, round(list_dot_product(v, v), 6) + 0.0 as product, round(list_sum(list_transform(v, lambda x: 3.0::double * x)), 6) + 0.0 as scaled from e")
def tensor_ops(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    v = F.col("v")
    return rounded(df.select("vec_id", tensor.total(tensor.add(v, tensor.multiply(v, v))).alias("summed"), tensor.dot(v, v).alias("product"), tensor.total(tensor.times(v, 3.0)).alias("scaled")), "summed", "product", "scaled")


@query(f"""
with {_VECTOR}, px as (select vec_id, i // 8 as r, i % 8 as c, v[i + 1] as x from e, range(64) t(i)),
k as (select i // 5 - 2 as kr, i % 5 - 2 as kc, round(0.1 * (i % 7) - 0.3, 1)::double as w from range(25) t(i)),
conv as (select vec_id, r - kr as r, c - kc as c, sum(x * w) as z from px, k where r - kr between 0 and 7 and c - kc between 0 and 7 group by all)
select vec_id, (r // 2 * 4 + c // 2)::int as place, round(greatest(max(z) + 0.1, 0), 6) + 0.0 as value from conv group by 1, 2
""")
def conv2d_relu_pool(spark, sf_dir):
    """The embeddings as images of 8 by 8: a 5x5 convolution, relu with a bias of 0.1, 2x2 max pooling."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    df = df.select("vec_id", tensor.relu(tensor.conv2d_same(F.col("v"), 8, 8, KERNEL), 0.1).alias("z"))
    return rounded(df.select("vec_id", F.posexplode(tensor.max_pool_2x2(F.col("z"), 8, 8)).alias("place", "value")), "value")


@query(f"""
with {_VECTOR}, px as (select vec_id, i // 8 as r, i % 8 // 2 as c, i % 2 as k, v[i + 1] as x from e, range(64) t(i)),
w as (select i // 12 - 1 as kr, i // 4 % 3 - 1 as kc, i // 2 % 2 as k, i % 2 as o, i % 5 - 2 as w from range(36) t(i))
select vec_id, ((r - kr) * 8 + (c - kc) * 2 + o)::int as place, round(sum(x * w), 6) + 0.0 as value from px join w using (k) where r - kr between 0 and 7 and c - kc between 0 and 3 group by 1, 2
""")
def conv2d_channels(spark, sf_dir):
    """The embeddings as images of 8 by 4 with two channels, through a 3x3 convolution to two channels."""
    kernel = [[[[(r * 12 + c * 4 + i * 2 + o) % 5 - 2 for o in range(2)] for i in range(2)] for c in range(3)] for r in range(3)]
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rounded(df.select("vec_id", F.posexplode(tensor.conv2d_same(F.col("v"), 8, 4, kernel)).alias("place", "value")), "value")


@query(f"with {_VECTOR} select vec_id, i::int as row, round(list_sum(v[i * 8 + 1:i * 8 + 8]) + list_sum(v[(7 - i) * 8 + 1:(7 - i) * 8 + 8]), 6) + 0.0 as summed from e, range(8) t(i)")
def tensor_add_nested(spark, sf_dir):
    """The embeddings as 8 by 8 matrices, plus the same upside down: sums of the rows."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, 8))
    both = df.select("vec_id", tensor.add_nested(rows, F.reverse(rows)).alias("m"))
    return rounded(both.select("vec_id", F.posexplode(F.transform("m", tensor.total)).alias("row", "summed")), "summed")


@query(f"with {_VECTOR} select vec_id, round(ln(list_sum(list_transform(v[1:10], lambda x: exp(x - list_max(v[1:10]))))) + list_max(v[1:10]) - v[label + 1], 6) + 0.0 as loss, (list_position(v[1:10], list_max(v[1:10])) - 1)::int as predicted from e")
def softmax_xent(spark, sf_dir):
    """The first ten values as logits of the label."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 10).alias("v"))
    return rounded(df.select("vec_id", tensor.softmax_cross_entropy(F.col("v"), F.col("label")).alias("loss"), tensor.argmax(F.col("v")).alias("predicted")), "loss")


@query(f"with {_VECTOR} select vec_id, o::int as unit, round(list_sum(list_transform(range(1, 65), lambda i: v[i] * (((i + 3 * o) % 5) - 2))) + 0.5, 6) + 0.0 as value from e, range(4) t(o)")
def dense_layer(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    weights = [[(i + 3 * o) % 5 - 2 for i in range(1, 65)] for o in range(4)]
    return rounded(df.select("vec_id", F.posexplode(tensor.dense(F.col("v"), weights, [0.5] * 4)).alias("unit", "value")), "value")


@query("select unnest([0.5, 0.95]::double[]) as probability, round(unnest(quantile_cont(o_totalprice, [0.5, 0.95])), 6) as quantile from orders")
def exact_quantiles(spark, sf_dir):
    return rounded(quantiles(table(spark, sf_dir, "orders").select("o_totalprice"), [], "o_totalprice", [0.5, 0.95]), "quantile")


# without SQL


@query()
def synthetic_churn(spark, sf_dir):
    return synthetic.churn(spark, 5000)


@query()
def train_evaluate(spark, sf_dir):
    """A logistic model of the customers' label: the test metrics of one run."""
    _, record = training.train(customers(spark, sf_dir), "c_custkey", "logistic_regression", ["n_orders", "spent", "c_acctbal"], ["c_mktsegment"], "label", folds=2)
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(record["test"].items())], "metric string, value double")

"""One SQL text per registered query that SQL can express."""

from __future__ import annotations

from itertools import combinations

from checks import oracle as o
from checks.oracle import EDA_CATEGORICAL, EDA_NUMERIC, FEATURE_COLUMNS, r, sql, union

SQL: dict[str, str] = {}


def cols(names, digits=6):
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


PLAIN = (
    "booking_id, no_show, branch, booking_month, arrival_month, arrival_day, checkout_month, checkout_day, country, "
    "first_time, room, price, platform, num_adults, num_children"
)
METRICS = ["accuracy", "precision", "recall", "f1_score", "roc_auc", "pr_auc"]

SQL["scan_noshow"] = sql(f"SELECT {PLAIN} FROM noshow")
SQL["adhoc_sql_country"] = sql(
    f"SELECT country, {r('avg(no_show)')} AS rate, count(*) AS n FROM bookings GROUP BY country"
)
SQL["adhoc_sql_window"] = sql(
    "SELECT branch, platform, n, (1 + (SELECT count(*) FROM t u WHERE u.branch = t.branch AND u.n > t.n))::INTEGER AS place "
    "FROM (SELECT branch, platform, count(*) AS n FROM bookings GROUP BY ALL) t"
).replace("FROM t u", "FROM (SELECT branch, platform, count(*) AS n FROM bookings GROUP BY ALL) u")
SQL["adhoc_sql_having"] = sql(
    "SELECT room, first_time, sum(no_show)::BIGINT AS lost FROM bookings WHERE room IS NOT NULL GROUP BY ALL HAVING count(*) > 20"
)
SQL["adhoc_sql_join"] = sql(
    f"""SELECT branch, country, {r('avg(no_show) - (SELECT avg(no_show) FROM bookings k WHERE k.country = b.country)')} AS above
FROM bookings b GROUP BY branch, country"""
)
SQL["adhoc_price_cast"] = sql(
    "SELECT booking_id, CAST(replace(replace(price,'SGD$ ',''),'USD$ ','') AS DOUBLE) AS price_number FROM bookings"
)

SQL["clean_month"] = sql("SELECT booking_id, booking_month, arrival_month, checkout_month FROM clean")
SQL["clean_currency"] = sql(f"SELECT booking_id, {o.CURRENCY} AS currency FROM noshow")
SQL["clean_price"] = sql(f"SELECT booking_id, {r(o.AMOUNT)} AS amount FROM noshow")
SQL["convert_currency"] = sql(f"SELECT booking_id, {r('price')} AS price, currency FROM clean")
SQL["clean_first_time"] = sql(
    f"SELECT booking_id, {o.FLAG} AS flag, CASE first_time WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS yes_no FROM noshow"
)
SQL["clean_checkout_day"] = sql("SELECT booking_id, abs(checkout_day) AS checkout_day FROM noshow")
SQL["clean_guest_counts"] = sql("SELECT booking_id, num_adults, num_children FROM clean")
SQL["coerce_numeric"] = sql("SELECT booking_id, try_cast(num_adults AS DOUBLE) AS num_adults FROM noshow")
SQL["drop_null_target"] = sql("SELECT booking_id, no_show FROM bookings WHERE no_show IS NOT NULL")

SQL["days_in_month"] = sql(
    f"SELECT booking_id, coalesce({o.DAYS}[arrival_month], 30) AS arrival_days, coalesce({o.DAYS}[checkout_month], 30) AS checkout_days FROM clean"
)
# walks the months between arrival and checkout one by one
SQL["stay_length"] = sql(
    f"""SELECT booking_id, CASE WHEN arrival_month = checkout_month THEN greatest(1, checkout_day - arrival_day)
ELSE greatest(1, {o.DAYS}[arrival_month] - arrival_day + checkout_day + coalesce(list_sum(list_transform(
  range(1, ((checkout_month - arrival_month) % 12 + 12) % 12), lambda i: {o.DAYS}[(arrival_month + i - 1) % 12 + 1])), 0)) END::INTEGER AS stay_length
FROM clean"""
)
SQL["lead_time"] = sql("SELECT booking_id, lead_time_months FROM feat")
SQL["guest_features"] = sql(f"SELECT booking_id, total_guests, {r('price_per_guest')} AS price_per_guest FROM feat")
SQL["cyclical_month"] = sql(f"SELECT booking_id, {cols(FEATURE_COLUMNS[7:11])} FROM feat")
SQL["cyclical_day"] = sql(f"SELECT booking_id, {cols(FEATURE_COLUMNS[11:])} FROM feat")
INTS = ["num_adults", "num_children", "stay_length", "lead_time_months", "total_guests"]
DOUBLES = [c for c in FEATURE_COLUMNS if c not in INTS]
SQL["engineer_features"] = sql(
    f"SELECT booking_id, no_show, branch, country, room, platform, currency, first_time, {', '.join(INTS)}, {cols(DOUBLES)} FROM feat"
)
SQL["inferred_month_days"] = sql(
    """SELECT m::INTEGER AS month, coalesce((SELECT max(d) FROM (SELECT arrival_month mm, arrival_day d FROM clean
UNION ALL SELECT checkout_month, checkout_day FROM clean) WHERE mm = m), 30)::INTEGER AS days FROM range(1, 13) t(m)"""
)

SQL["room_mode_by_group"] = sql("SELECT * FROM gmode")
SQL["room_mode_by_branch"] = sql("SELECT * FROM bmode")
SQL["impute_room"] = sql("SELECT booking_id, room FROM room2")
SQL["impute_price"] = sql(f"SELECT booking_id, room, {r('price')} AS price FROM imputed")
SQL["missing_indicator"] = sql(
    "SELECT booking_id, (room IS NULL)::INTEGER AS room_missing, (price IS NULL)::INTEGER AS price_missing FROM noshow"
)
SQL["imputation_summary"] = sql(
    union(
        [
            f"""SELECT '{c}' AS "column", b AS before, a AS after, b - a AS imputed FROM (SELECT
(SELECT count(*) FROM feat WHERE {c} IS NULL) AS b, (SELECT count(*) FROM imputed WHERE {c} IS NULL) AS a)"""
            for c in ("room", "price")
        ]
    )
)
SQL["imputation_shift"] = sql(
    union(
        [
            f"SELECT '{s}' AS stage, {r('avg(price)', 4)} AS mean, {r('stddev_samp(price)', 4)} AS std, {r('median(price)', 4)} AS median FROM {t}"
            for s, t in (("before", "feat"), ("after", "imputed"))
        ]
    )
)
SQL["median_impute"] = sql(
    "SELECT booking_id, "
    + ", ".join(
        f"{r(f'coalesce({c}, (SELECT median({c}) FROM feat))')} AS {c}" for c in ("price", "price_per_guest")
    )
    + " FROM feat"
)
SQL["constant_impute"] = sql(
    "SELECT booking_id, coalesce(branch, 'missing') AS branch, coalesce(room, 'missing') AS room FROM noshow"
)

SQL["standard_scale"] = sql(
    "SELECT booking_id, "
    + ", ".join(
        f"{r(f'({c} - (SELECT avg({c}) FROM imputed)) / (SELECT stddev_pop({c}) FROM imputed)')} AS {c}"
        for c in FEATURE_COLUMNS
    )
    + " FROM imputed"
)
HOT = ["branch", "country", "room", "platform", "booking_month", "arrival_month"]


def slot(c: str) -> str:
    """Place among the sorted training categories, 0 if it is not one of them."""
    return (
        f"CASE WHEN coalesce({c}::VARCHAR, 'missing') IN (SELECT coalesce({c}::VARCHAR, 'missing') FROM tagged WHERE split = 'train') THEN "
        f"(SELECT count(DISTINCT coalesce(u.{c}::VARCHAR, 'missing')) FROM tagged u WHERE u.split = 'train' "
        f"AND coalesce(u.{c}::VARCHAR, 'missing') <= coalesce(t.{c}::VARCHAR, 'missing')) ELSE 0 END::BIGINT"
    )


SQL["one_hot"] = o.with_extra(
    "tagged AS (SELECT b.*, s.split FROM noshow b JOIN splits s USING (booking_id)),\n"
    + f"slots AS (SELECT booking_id, {', '.join(f'{slot(c)} AS {c}_slot' for c in HOT)} FROM tagged t)",
    f"SELECT *, ({' + '.join(f'({c}_slot > 0)::INTEGER' for c in HOT)})::INTEGER AS ones FROM slots",
)
SQL["assemble_features"] = sql(
    "SELECT booking_id, (15 + 1 + "
    + " + ".join(f"(SELECT count(DISTINCT {c}) FROM imputed)" for c in ["branch", "country", "room", "platform", "booking_month", "arrival_month"])
    + ")::INTEGER AS slots, "
    + r(
        " + ".join(
            f"({c} - (SELECT avg({c}) FROM imputed)) / (SELECT stddev_pop({c}) FROM imputed)" for c in FEATURE_COLUMNS
        )
        + " + 6 + first_time",
        5,
    )
    + " AS total FROM imputed"
)
SQL["preprocess_splits"] = o.with_extra(
    """tr AS (SELECT b.* FROM bookings b JOIN splits s USING (booking_id) WHERE s.split = 'train'),
sizes AS (SELECT 15 + 1 + (SELECT count(DISTINCT branch) FROM tr) + (SELECT count(DISTINCT country) FROM tr)
  + (SELECT count(DISTINCT room) FROM tr) + (SELECT count(DISTINCT platform) FROM tr)
  + (SELECT count(DISTINCT booking_month) FROM tr) + (SELECT count(DISTINCT lower(arrival_month)) FROM tr) AS slots)""",
    "SELECT split, no_show, count(*) AS n, max(slots)::INTEGER AS slots FROM splits, sizes GROUP BY split, no_show",
)
SQL["stratified_split"] = sql("SELECT booking_id, no_show, split FROM splits")
SQL["sample_n"] = sql(
    "SELECT booking_id, no_show FROM noshow ORDER BY md5('42|' || booking_id), booking_id LIMIT 5000"
)
SQL["kfold_assign"] = sql(
    "SELECT booking_id, no_show, (ntile(5) OVER (PARTITION BY no_show ORDER BY md5('42|' || booking_id), booking_id) - 1)::INTEGER AS fold FROM noshow"
)
SQL["class_weights"] = sql(
    f"""SELECT no_show, c AS n, {r('n / (2.0 * c)')} AS balanced,
{r("CASE WHEN no_show = 1 THEN (n - c) / c::DOUBLE ELSE 1 END")} AS neg_over_pos FROM classes"""
)

SQL["dashboard_kpis"] = sql(
    f"""SELECT count(*) AS bookings, {r('avg(no_show)')} AS no_show_rate, {r('avg(price)', 4)} AS avg_price,
{r('sum(price) FILTER (no_show = 1)', 0)} AS revenue_at_risk FROM clean"""
)
for c in ("platform", "room"):
    SQL[f"rate_by_{c}"] = sql(
        f"SELECT {c}, {r('avg(no_show) * 100')} AS no_show_pct FROM noshow WHERE {c} IS NOT NULL GROUP BY 1"
    )
SQL["rate_by_first_time"] = sql(
    f"""SELECT CASE first_time WHEN 'Yes' THEN 'First-Time' ELSE 'Returning' END AS guest, {r('avg(no_show) * 100')} AS no_show_pct
FROM noshow WHERE first_time IN ('Yes', 'No') GROUP BY 1"""
)


def histogram(source: str, columns: list[str], bins: int, by: str = "") -> str:
    by_ = f"{by}, " if by else ""
    return o.with_extra(
        f"""vals AS ({o.numeric_long(source, columns, by_)}),
rng AS (SELECT "column", CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
  CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM vals GROUP BY 1),
binned AS (SELECT v.*, lo, hi, least(floor({bins}::DOUBLE * (value - lo) / (hi - lo)) + 1, {bins})::INTEGER AS bin
  FROM vals v JOIN rng USING ("column") WHERE value IS NOT NULL)""",
        f"""SELECT {'' if columns == ['price'] and by else '"column", '}{by_}bin, {r(f'lo + (bin - 1) * ((hi - lo) / {bins})', 4)} AS bin_start, count(*) AS n
FROM binned GROUP BY "column", {by_}bin, lo, hi""",
    )


SQL["price_histogram"] = histogram("feat", ["price"], 30, "no_show")
SQL["numeric_histogram"] = histogram("feat", EDA_NUMERIC, 50)
SQL["numeric_stats"] = o.with_extra(
    f"vals AS ({o.numeric_long('feat', EDA_NUMERIC)})",
    f"""SELECT "column", {r('avg(value)', 4)} AS mean, {r('stddev_samp(value)', 4)} AS std, {r('median(value)', 4)} AS median FROM vals GROUP BY 1""",
)
SQL["value_counts"] = sql("SELECT room AS value, count(*) AS n FROM noshow GROUP BY 1")
SQL["value_counts_top"] = sql(
    "SELECT country AS value, count(*) AS n FROM noshow GROUP BY 1 ORDER BY n DESC, value LIMIT 10"
)
SQL["rate_by_column"] = o.with_extra(
    f"vals AS ({o.text_long('clean', EDA_CATEGORICAL, 'no_show, ')})",
    f"""SELECT "column", value, {r('avg(no_show) * 100')} AS no_show_pct, count(*) AS n FROM vals WHERE value IS NOT NULL GROUP BY ALL""",
)
SQL["rate_by_quantile"] = o.with_extra(
    f"""vals AS ({o.numeric_long('imputed', EDA_NUMERIC, 'no_show, ')}),
edges AS (SELECT "column", list_sort(list_distinct(quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e
  FROM vals GROUP BY 1 HAVING count(DISTINCT value) > 12),
binned AS (SELECT v.*, e, greatest(1, len(list_filter(e, lambda x: x < value)))::INTEGER AS bin FROM vals v JOIN edges USING ("column")),
valued AS (SELECT "column", value, avg(no_show) * 100 AS pct, count(*) AS n FROM vals
  WHERE value IS NOT NULL AND "column" NOT IN (SELECT "column" FROM edges) GROUP BY 1, 2)""",
    f"""SELECT "column", bin, {r('e[bin]', 4)} AS "lower", {r('e[bin + 1]', 4)} AS "upper", {r('avg(no_show) * 100')} AS no_show_pct, count(*) AS n
FROM binned GROUP BY "column", bin, e
UNION ALL
SELECT "column", (row_number() OVER (PARTITION BY "column" ORDER BY value))::INTEGER, {r('value', 4)}, {r('value', 4)}, {r('pct')}, n
FROM valued""",
)
SQL["crosstab"] = sql("SELECT platform, no_show, count(*) AS n FROM noshow GROUP BY ALL")
SQL["crosstab_wide"] = sql(
    "SELECT platform, count(*) FILTER (no_show = 0) AS shows, count(*) FILTER (no_show = 1) AS no_shows FROM noshow GROUP BY 1"
)
SQL["missingness_rate"] = sql(
    union(
        [
            f"SELECT '{c}' AS \"column\", {c} IS NULL AS missing, count(*) AS n, {r('avg(no_show)')} AS no_show_rate FROM noshow GROUP BY 2"
            for c in ("room", "price")
        ]
    )
)
SQL["missingness_shift"] = o.with_extra(
    "means AS ("
    + union(
        [
            f"SELECT '{c}' AS feature, avg({c}) FILTER (price IS NOT NULL) AS p, avg({c}) FILTER (price IS NULL) AS m FROM clean"
            for c in ("arrival_day", "checkout_day")
        ]
    )
    + ")",
    f"""SELECT feature, {r('p')} AS present_mean, {r('m')} AS missing_mean, {r('abs(p - m) / p * 100')} AS diff_pct,
abs(p - m) / p * 100 > 10 AS flagged FROM means""",
)

ALL_COLUMNS = PLAIN.split(", ")
SQL["column_summary"] = sql(
    union(
        [
            f"SELECT '{c}' AS \"column\", CASE typeof(any_value({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS type, "
            f"count({c}) AS non_null, count(DISTINCT {c}) AS \"distinct\" FROM bookings"
            for c in ALL_COLUMNS
        ]
    )
)
SQL["missing_report"] = sql(
    "SELECT * FROM ("
    + union(
        [
            f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing, {r(f'count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE * 100', 2)} AS missing_pct FROM bookings"
            for c in ALL_COLUMNS
        ]
    )
    + ") WHERE missing > 0"
)
TWICE = "(SELECT * FROM bookings UNION ALL SELECT * FROM bookings WHERE branch = 'Changi')"
SQL["duplicate_count"] = sql(
    f"""SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {TWICE}))) AS duplicates,
{r(f"(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {TWICE}))) / count(*)::DOUBLE * 100", 2)} AS duplicate_pct
FROM {TWICE}"""
)
SQL["null_target_count"] = sql("SELECT count(*) AS null_target FROM bookings WHERE no_show IS NULL")
SQL["distinct_values"] = sql("SELECT DISTINCT arrival_month FROM noshow")
SQL["negative_counts"] = sql(
    union(
        [
            f"SELECT '{c}' AS \"column\", count(*) AS negatives FROM noshow WHERE {c} < 0"
            for c in ("arrival_day", "checkout_day", "num_children")
        ]
    )
)
BAD = {c: f"(try_cast({c}::VARCHAR AS DOUBLE) IS NULL AND {c} IS NOT NULL)" for c in ("num_adults", "num_children")}
SQL["non_numeric_report"] = sql(
    union(
        [
            f"SELECT '{c}' AS \"column\", count(*) FILTER ({f}) AS non_numeric, {r(f'count(*) FILTER ({f}) / count(*)::DOUBLE')} AS share FROM noshow"
            for c, f in {**BAD, "(any)": " OR ".join(BAD.values())}.items()
        ]
    )
)
SQL["non_numeric_values"] = sql(
    union([f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM noshow WHERE {f} GROUP BY 2" for c, f in BAD.items()])
)
SQL["guest_validity"] = sql(
    "SELECT count(*) FILTER (total_guests = 0) AS zero_guests, count(*) FILTER (num_adults <= 0) AS invalid_adults, count(*) AS bookings FROM clean"
)
SQL["iqr_outliers"] = o.with_extra(
    f"""vals AS ({o.numeric_long('feat', [*EDA_NUMERIC, 'stay_length', 'price_per_guest'])}),
q AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM vals GROUP BY 1)""",
    f"""SELECT "column", count(*) FILTER (value < q1 - 1.5*(q3-q1) OR value > q3 + 1.5*(q3-q1)) AS outliers,
{r('count(*) FILTER (value < q1 - 1.5*(q3-q1) OR value > q3 + 1.5*(q3-q1)) / count(*)::DOUBLE * 100', 4)} AS pct,
{r('q1 - 1.5*(q3-q1)', 4)} AS "lower", {r('q3 + 1.5*(q3-q1)', 4)} AS "upper"
FROM vals JOIN q USING ("column") GROUP BY "column", q1, q3 HAVING outliers > 0""",
)

PAIRS = union([f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM imputed" for a, b in combinations(EDA_NUMERIC, 2)])
SQL["pearson_matrix"] = o.with_extra(
    f"pairs AS ({PAIRS})",
    f"SELECT a, b, {r('r')} AS r FROM pairs UNION ALL SELECT b, a, {r('r')} FROM pairs UNION ALL "
    + union([f"SELECT '{c}', '{c}', 1.0::DOUBLE" for c in EDA_NUMERIC]),
)
SQL["high_corr_pairs"] = o.with_extra(f"pairs AS ({PAIRS})", f"SELECT a, b, {r('r')} AS r FROM pairs WHERE abs(r) > 0.7")
BISERIAL = (
    "bis0 AS ("
    + union([f"SELECT '{c}' AS feature, corr(no_show, {c}) AS c, count({c}) AS n FROM imputed" for c in EDA_NUMERIC])
    + "),\nbis AS (SELECT *, "
    + o.t_tail("(c * sqrt(n - 2) / sqrt(1 - c * c))", "(n - 2)")
    + " AS p FROM bis0)"
)
SQL["point_biserial"] = o.with_extra(
    BISERIAL, f"SELECT feature, {r('c')} AS correlation, n, {r('p')} AS p_value FROM bis"
)
TARGET_PAIRS = o.contingency("imputed", [(c, "no_show") for c in EDA_CATEGORICAL])
CHI = TARGET_PAIRS + f",\nchip AS (SELECT *, {o.chi2_tail('chi2', 'dof')} AS p FROM chis)"
SQL["chi_square"] = o.with_extra(
    CHI, f"SELECT a AS feature, {r('cramers_v')} AS cramers_v, {r('chi2', 4)} AS chi2, dof, {r('p')} AS p_value FROM chip"
)
SQL["significant_features"] = o.with_extra(CHI, "SELECT a AS feature FROM chip WHERE p < 0.05")
CAT_PAIRS = o.contingency("imputed", list(combinations(EDA_CATEGORICAL, 2)))
SQL["cramers_v_matrix"] = o.with_extra(
    CAT_PAIRS,
    f"SELECT a, b, {r('cramers_v')} AS cramers_v FROM chis UNION ALL SELECT b, a, {r('cramers_v')} FROM chis UNION ALL "
    + union([f"SELECT '{c}', '{c}', 1.0::DOUBLE" for c in EDA_CATEGORICAL]),
)
SQL["high_assoc_pairs"] = o.with_extra(
    CAT_PAIRS, f"SELECT a, b, {r('cramers_v')} AS cramers_v FROM chis WHERE cramers_v > 0.02"
)


def inflation(y: str, others: list[str]) -> str:
    """Total over residual sum of squares, by removing the other columns from y one after another.

    A column of which the ones before leave nothing is passed over; without a residual the inflation is infinite.
    """
    inner = ", ".join(f"({z} - avg({z}) OVER ()) / stddev_pop({z}) OVER () AS a{i}" for i, z in enumerate(others))
    text = f"SELECT {y} - avg({y}) OVER () AS y0, {y} - avg({y}) OVER () AS res, {inner} FROM imputed"
    for k in range(len(others)):
        left = ["res", *[f"a{m}" for m in range(k + 1, len(others))]]
        new = f"CASE WHEN sum(a{k} * a{k}) OVER () > 1e-9::DOUBLE * count(*) OVER () THEN 1 / sum(a{k} * a{k}) OVER () ELSE 0 END"
        steps = ", ".join(f"{c} - sum({c} * a{k}) OVER () * {new} * a{k} AS {c}" for c in left)
        text = f"SELECT y0, {steps} FROM ({text})"
    share = "sum(res * res) / sum(y0 * y0)"
    return f"SELECT '{y}' AS feature, CASE WHEN {share} > 1e-9::DOUBLE THEN 1 / ({share}) ELSE 'Infinity'::DOUBLE END AS vif FROM ({text})"


# three columns of which one is the sum of the others are among these
VIFS = "vifs AS (" + union([inflation(c, [z for z in EDA_NUMERIC if z != c]) for c in EDA_NUMERIC]) + ")"
SQL["vif"] = o.with_extra(VIFS, f"SELECT feature, {r('vif', 5)} AS vif, vif > 10 AS flagged FROM vifs")
SQL["vif_collinear"] = o.with_extra(VIFS, f"SELECT feature, {r('vif', 5)} AS vif, true AS flagged FROM vifs WHERE vif > 10")
STARS = "CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END"
SQL["feature_ranking"] = o.with_extra(
    f"""{BISERIAL},
{CHI},
{VIFS},
ranked AS (SELECT feature, 'numerical' AS type, c, p FROM bis UNION ALL SELECT a, 'categorical', cramers_v, p FROM chip)""",
    f"""SELECT feature, type, {r('c')} AS correlation, {r('p')} AS p_value, {r('abs(c)')} AS abs_correlation, {STARS} AS stars, {r('vif', 5)} AS vif
FROM ranked LEFT JOIN vifs USING (feature)""",
)

SQL["confusion_matrix"] = sql(
    "SELECT model, tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives FROM conf"
)
SQL["classification_metrics"] = sql(f"SELECT model, {cols(METRICS[:4])} FROM met")
SQL["roc_auc"] = sql(f"SELECT model, {cols(['roc_auc'])} FROM met")
SQL["average_precision"] = sql(f"SELECT model, {cols(['pr_auc'])} FROM met")
SQL["compare_models"] = sql(f"SELECT model, {cols(METRICS)} FROM met")
SQL["metrics_long"] = sql(f"SELECT model, metric, {r('value')} AS value FROM met_long")
SQL["champion"] = sql(f"SELECT model, {r('roc_auc')} AS roc_auc FROM met ORDER BY met.roc_auc DESC, model LIMIT 1")
BEST = """(SELECT metric, model, value, row_number() OVER (PARTITION BY metric ORDER BY value DESC, model) k
FROM met_long WHERE metric <> 'pr_auc')"""
SQL["best_per_metric"] = sql(f"SELECT metric, model, {r('value')} AS value FROM {BEST} WHERE k = 1")
SQL["comparison_metrics"] = sql(f"SELECT 'best_' || metric AS metric, model, {r('value')} AS value FROM {BEST} WHERE k = 1")
SQL["promote_champion"] = o.with_extra(
    """o1 AS (SELECT model, roc_auc FROM "old" ORDER BY roc_auc DESC, model LIMIT 1),
n1 AS (SELECT model, roc_auc FROM "new" ORDER BY roc_auc DESC, model LIMIT 1)""",
    f"""SELECT CASE WHEN n1.roc_auc > o1.roc_auc THEN n1.model ELSE o1.model END AS model,
{r('greatest(o1.roc_auc, n1.roc_auc)')} AS roc_auc, n1.roc_auc > o1.roc_auc AS promoted FROM o1, n1""",
)
FLOORS = "(VALUES ('roc_auc', 0.7::DOUBLE), ('f1_score', 0.6), ('precision', 0.6), ('recall', 0.3)) t(metric, threshold)"
SQL["threshold_check"] = sql(
    f"""SELECT metric, model, {r('value')} AS value, {r('threshold')} AS threshold, value >= threshold AS passed,
CASE WHEN value >= threshold THEN 'PASS' ELSE 'FAIL' END AS status FROM met_long JOIN {FLOORS} USING (metric)"""
)
SQL["degradation_check"] = sql(
    f"""SELECT model, metric, {r('b.value')} AS baseline, {r('c.value')} AS "current", {r('(c.value - b.value) / b.value')} AS change,
(c.value - b.value) / b.value < -0.05 AS degraded FROM new_long c JOIN old_long b USING (model, metric)
WHERE metric IN ('roc_auc', 'f1_score', 'precision', 'recall')"""
)


def _class(label: str, hit: str, alarm: str, miss: str) -> str:
    return (
        f"SELECT model, '{label}' AS label, coalesce({hit}/nullif({hit}+{alarm},0)::DOUBLE,0) AS p, "
        f"coalesce({hit}/nullif({hit}+{miss},0)::DOUBLE,0) AS q, coalesce(2*{hit}/nullif(2*{hit}+{alarm}+{miss},0)::DOUBLE,0) AS f, "
        f"{hit}+{miss} AS s FROM conf"
    )


SQL["class_report"] = o.with_extra(
    f"cls AS ({union([_class('0', 'tn', 'fn', 'fp'), _class('1', 'tp', 'fp', 'fn')])})",
    f"""SELECT model, label, {r('p')} AS precision, {r('q')} AS recall, {r('f')} AS f1_score, s AS support FROM cls
UNION ALL SELECT model, 'macro avg', {r('avg(p)')}, {r('avg(q)')}, {r('avg(f)')}, sum(s)::BIGINT FROM cls GROUP BY 1
UNION ALL SELECT model, 'weighted avg', {r('sum(p*s)/sum(s)')}, {r('sum(q*s)/sum(s)')}, {r('sum(f*s)/sum(s)')}, sum(s)::BIGINT FROM cls GROUP BY 1""",
)

# drift


def ecdf(columns: list[str]) -> str:
    """Both distribution functions at every distinct value."""
    return f"""both_ AS ({o.numeric_long('ref', columns, '1 AS side, ')} UNION ALL {o.numeric_long('cur', columns, '0 AS side, ')}),
steps AS (SELECT "column", value, sum(sum(side)) OVER w / (sum(sum(side)) OVER (PARTITION BY "column"))::DOUBLE AS f1,
  sum(sum(1 - side)) OVER w / (sum(sum(1 - side)) OVER (PARTITION BY "column"))::DOUBLE AS f2,
  sum(sum(side)) OVER (PARTITION BY "column") AS n1, sum(sum(1 - side)) OVER (PARTITION BY "column") AS n2,
  lead(value) OVER (PARTITION BY "column" ORDER BY value) AS nxt
  FROM both_ WHERE value IS NOT NULL GROUP BY "column", value WINDOW w AS (PARTITION BY "column" ORDER BY value))"""


def drift_rows(table: str, method: str, kind: str, digits: int = 6) -> str:
    test = "score < 0.05" if kind == "p_value" else "score >= 0.1"
    return f"""SELECT "column", '{method}' AS method, {r('statistic', digits)} AS statistic, {r('score')} AS score,
'{kind}' AS score_kind, {test} AS drifted FROM {table}"""


KS_P = (
    "CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), "
    "lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * lam * lam))))) END"
)
SQL["drift_ks"] = o.with_extra(
    ecdf(o.DRIFT_NUMERIC)
    + f""",
d AS (SELECT "column", max(abs(f1 - f2)) AS statistic, max(abs(f1 - f2)) * sqrt(n1 * n2 / (n1 + n2)::DOUBLE) AS lam FROM steps GROUP BY "column", n1, n2),
res AS (SELECT "column", statistic, {KS_P} AS score FROM d)""",
    drift_rows("res", "ks", "p_value"),
)
WASSERSTEIN = (
    ecdf(o.DRIFT_NUMERIC)
    + f""",
spread AS (SELECT "column", stddev_pop(value) AS sd FROM ({o.numeric_long('ref', o.DRIFT_NUMERIC)}) GROUP BY 1),
wres AS (SELECT "column", sum(abs(f1 - f2) * (nxt - value)) AS statistic, sum(abs(f1 - f2) * (nxt - value)) / greatest(max(sd), 0.001) AS score
  FROM steps JOIN spread USING ("column") GROUP BY 1)"""
)
SQL["drift_wasserstein"] = o.with_extra(WASSERSTEIN, drift_rows("wres", "wasserstein", "distance", 3))


def categories(columns: list[str], name: str = "cats") -> str:
    return f"""{name}_all AS ({o.text_long('ref', columns, '1 AS side, ')} UNION ALL {o.text_long('cur', columns, '0 AS side, ')}),
{name} AS (SELECT "column", value, sum(side)::DOUBLE AS x, sum(1 - side)::DOUBLE AS y, sum(sum(side)) OVER (PARTITION BY "column") AS nx,
  sum(sum(1 - side)) OVER (PARTITION BY "column") AS ny, count(*) OVER (PARTITION BY "column") AS k,
  min(value) OVER (PARTITION BY "column") AS lowest FROM {name}_all WHERE value IS NOT NULL GROUP BY 1, 2)"""


SQL["drift_chi2"] = o.with_extra(
    categories(o.DRIFT_CATEGORICAL)
    + f""",
c1 AS (SELECT "column", k - 1 AS dof, sum(pow(y - x * ny / nx, 2) / (x * ny / nx)) AS statistic FROM cats GROUP BY 1, 2),
res AS (SELECT "column", statistic, {o.chi2_tail('statistic', 'dof')} AS score FROM c1)""",
    drift_rows("res", "chi2", "p_value", 4),
)


def js(columns: list[str], name: str) -> str:
    return (
        categories(columns, name)
        + f""",
{name}_js AS (SELECT "column", sqrt(greatest(0, sum(CASE WHEN x > 0 THEN x/nx * ln((x/nx) / ((x/nx + y/ny)/2)) ELSE 0 END
  + CASE WHEN y > 0 THEN y/ny * ln((y/ny) / ((x/nx + y/ny)/2)) ELSE 0 END) / 2)) AS statistic FROM {name} GROUP BY 1),
{name}_res AS (SELECT "column", statistic, statistic AS score FROM {name}_js)"""
    )


SQL["drift_js"] = o.with_extra(js(o.DRIFT_CATEGORICAL, "cats"), drift_rows("cats_res", "jensen_shannon", "distance"))
# two-sided normal tail by Simpson's rule
Z_P = (
    "greatest(0.0, 1 - 2 * (least(abs(z), 40.0) / 2000) / 3 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001), "
    "lambda k: (CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(k * least(abs(z), 40.0) / 2000, 2) / 2))))"
)
SQL["drift_z"] = o.with_extra(
    categories(["branch", "first_time"])
    + f""",
z1 AS (SELECT "column", (x/nx - y/ny) / sqrt((x + y) / (nx + ny) * (1 - (x + y) / (nx + ny)) * (1.0/nx + 1.0/ny)) AS z FROM cats WHERE value = lowest),
res AS (SELECT "column", z AS statistic, {Z_P} AS score FROM z1)""",
    drift_rows("res", "z", "p_value"),
)
# small counts of people are compared as categories
FEW = ["num_adults", "num_children"]
MANY = [c for c in o.DRIFT_NUMERIC if c not in FEW]
COLUMNS = (
    ecdf(MANY)
    + f""",
spread AS (SELECT "column", stddev_pop(value) AS sd FROM ({o.numeric_long('ref', MANY)}) GROUP BY 1),
wres AS (SELECT "column", sum(abs(f1 - f2) * (nxt - value)) / greatest(max(sd), 0.001) AS score FROM steps JOIN spread USING ("column") GROUP BY 1),
{js([*o.DRIFT_CATEGORICAL, *FEW], 'cats')},
allres AS (SELECT "column", 'wasserstein' AS method, score FROM wres UNION ALL SELECT "column", 'jensen_shannon', score FROM cats_res)"""
)
SQL["drift_columns"] = o.with_extra(
    COLUMNS, f"""SELECT "column", method, {r('score')} AS score, score >= 0.1 AS drifted FROM allres"""
)
SQL["drift_summary"] = o.with_extra(
    COLUMNS,
    f"""SELECT count(*) AS n_features, count(*) FILTER (score >= 0.1) AS n_drifted_features,
{r('count(*) FILTER (score >= 0.1) / count(*)::DOUBLE')} AS drift_share,
coalesce(string_agg("column", ',' ORDER BY "column") FILTER (score >= 0.1), '') AS drifted_features,
count(*) FILTER (score >= 0.1) / count(*)::DOUBLE > 0.5 AS dataset_drift,
count(*) FILTER (score >= 0.1) / count(*)::DOUBLE > 0.3 AS critical_drift FROM allres""",
)
SUMMARY = []
for name, where in (("reference", "booking_month <= 6"), ("current", "booking_month > 6")):
    for c in o.SUMMARY_NUMERIC:
        SUMMARY.append(
            f"""SELECT '{name}' AS frame, '{c}' AS "column", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS missing, count(DISTINCT {c}) AS "distinct",
{r(f'avg({c})', 3)} AS mean, {r(f'stddev_samp({c})', 3)} AS std, {r(f'min({c})', 3)} AS "min", {r(f'max({c})', 3)} AS "max",
{', '.join(f"{r(f'quantile_cont({c}::DOUBLE, {q})', 3)} AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75))} FROM feat WHERE {where}"""
        )
    for c in EDA_CATEGORICAL:
        SUMMARY.append(
            f"""SELECT '{name}', '{c}', count(*), count(*) FILTER ({c} IS NULL), count(DISTINCT {c}),
NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM feat WHERE {where}"""
        )
SQL["data_summary"] = sql(union(SUMMARY))

SQL["risk_band"] = sql(
    "SELECT booking_id, model, CASE WHEN score > 0.7::DOUBLE THEN 'HIGH' WHEN score > 0.4::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM scored"
)

STATS = f"""stat AS (SELECT count(*) FILTER (split = 'train') AS train_samples, count(*) FILTER (split = 'val') AS val_samples, 22 AS n_features,
{r("avg(no_show) FILTER (split = 'train')")} AS train_positive_rate, {r("avg(no_show) FILTER (split = 'val')")} AS val_positive_rate FROM splits)"""
SQL["run_data_stats"] = o.with_extra(STATS, "SELECT * FROM stat")
SQL["log_params"] = o.with_extra(
    STATS,
    union(
        [
            f"SELECT 'experiment' AS run_id, 'data.{c}' AS key, {c}::VARCHAR AS value FROM stat"
            for c in ("train_samples", "val_samples", "n_features", "train_positive_rate", "val_positive_rate")
        ]
        + ["SELECT 'experiment', 'config.random_state', '42'"]
    ),
)
SQL["log_metrics"] = sql(f"SELECT 'run-' || model AS run_id, 'final_' || metric AS metric, {r('value')} AS value FROM met_long")
SQL["run_tree"] = sql(
    """SELECT 'experiment' AS run_id, 'comparison' AS name, NULL::VARCHAR AS parent_run_id, NULL::VARCHAR AS parent_name,
(SELECT count(DISTINCT model) FROM scored) AS children
UNION ALL SELECT DISTINCT 'run-' || model, model, 'experiment', 'comparison', 0 FROM scored"""
)
SQL["search_runs"] = sql(
    f"""SELECT 'run-' || model AS run_id, 'experiment' AS parent_run_id, model AS name, {cols(METRICS)} FROM met
WHERE met.roc_auc > 0.45 ORDER BY met.roc_auc DESC"""
)
SQL["experiment_summary"] = sql(
    f"""SELECT model, {cols(METRICS)}, (SELECT count(*) FROM met) AS n_models,
(SELECT model FROM met ORDER BY roc_auc DESC, model LIMIT 1) AS best_model,
model = (SELECT model FROM met ORDER BY roc_auc DESC, model LIMIT 1) AS is_best FROM met"""
)

# a fit is not repeatable in SQL, what must hold of any fit is
SQL["score_batch_facts"] = sql(
    f"SELECT {PLAIN}, TRUE AS in_range, TRUE AS prediction_follows FROM bookings".replace("no_show", "no_show::VARCHAR AS no_show")
)
SQL["importance_facts"] = "SELECT 1.0::DOUBLE AS total, 0::BIGINT AS negative, 0::BIGINT AS repeated"

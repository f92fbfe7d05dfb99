"""DuckDB SQL that computes, by other means, what the registered queries return."""

from __future__ import annotations

MONTHS = (
    "['january','february','march','april','may','june','july','august','september','october','november','december']"
)
WORDS = "['one','two','three','four','five','six','seven','eight','nine','ten']"
DAYS = "[31,29,31,30,31,30,31,31,30,31,30,31]"
BEFORE = "[0,31,60,91,121,152,182,213,244,274,305,335]"

EDA_NUMERIC = ["arrival_day", "checkout_day", "price", "num_adults", "num_children", "total_guests"]
EDA_CATEGORICAL = [
    "branch",
    "booking_month",
    "arrival_month",
    "checkout_month",
    "country",
    "first_time",
    "room",
    "platform",
]
SUMMARY_NUMERIC = [*EDA_NUMERIC, "stay_length", "lead_time_months", "price_per_guest"]
FEATURE_COLUMNS = [
    "price",
    "num_adults",
    "num_children",
    "stay_length",
    "lead_time_months",
    "total_guests",
    "price_per_guest",
    "arrival_month_sin",
    "arrival_month_cos",
    "booking_month_sin",
    "booking_month_cos",
    "arrival_day_sin",
    "arrival_day_cos",
    "checkout_day_sin",
    "checkout_day_cos",
]


def r(x: str, digits: int = 6) -> str:
    """Rounded, without negative zero."""
    return f"(round(({x})::DOUBLE, {digits}) + 0)"


def month(c: str) -> str:
    return f"coalesce(try_cast({c} AS DOUBLE)::INTEGER, list_position({MONTHS}, lower(trim({c}::VARCHAR)))::INTEGER)"


def head_count(c: str) -> str:
    return (
        f"coalesce(list_position({WORDS}, lower({c}::VARCHAR))::INTEGER, "
        f"trunc(try_cast({c}::VARCHAR AS DOUBLE))::INTEGER, 0)"
    )


CURRENCY = r"coalesce(nullif(regexp_extract(price, '^(\w+)\$', 1), ''), 'SGD')"
AMOUNT = r"try_cast(replace(regexp_replace(price, '^[A-Z]+\$\s*', ''), ',', '') AS DOUBLE)"
FLAG = "coalesce(try_cast(first_time AS DOUBLE)::INTEGER, CASE first_time WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END, 0)"

CTES: dict[str, str] = {}
CTES["lines"] = "SELECT l_orderkey, min(l_shipdate) s, max(l_shipdate) e, count(*) n FROM lineitem GROUP BY 1"
CTES["firsts"] = "SELECT o_custkey AS fc, min(o_orderkey) fk FROM orders GROUP BY 1"
CTES["bookings"] = """
SELECT o_orderkey AS booking_id,
  CASE WHEN o_orderkey%97=0 THEN NULL WHEN (o_totalprice>300000 AND n<=4) OR o_orderkey%10=3 THEN 1 ELSE 0 END::INTEGER AS no_show,
  CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'Changi' ELSE 'Orchard' END AS branch,
  month(o_orderdate)::INTEGER AS booking_month,
  CASE WHEN o_orderkey%2=1 THEN upper(monthname(s)) ELSE monthname(s) END AS arrival_month,
  day(s)::INTEGER AS arrival_day,
  monthname(e) AS checkout_month,
  CASE WHEN o_orderkey%53=0 THEN -day(e) ELSE day(e) END::INTEGER AS checkout_day,
  n_name AS country,
  CASE WHEN o_orderkey=fk THEN 'Yes' ELSE 'No' END AS first_time,
  CASE WHEN o_orderkey%11<2 THEN NULL WHEN o_orderpriority='1-URGENT' THEN 'President Suite'
       WHEN o_orderpriority='2-HIGH' THEN 'King' WHEN o_orderpriority='3-MEDIUM' THEN 'Queen' ELSE 'Single' END AS room,
  CASE WHEN o_orderkey%5=0 THEN NULL ELSE CASE WHEN o_orderkey%5=1 THEN 'USD$ ' ELSE 'SGD$ ' END
       || (o_totalprice::DECIMAL(12,2))::VARCHAR END AS price,
  CASE WHEN o_orderkey%4=3 THEN 'Phone' WHEN o_orderstatus='F' THEN 'Website' WHEN o_orderstatus='O' THEN 'Agent' ELSE 'Email' END AS platform,
  CASE WHEN o_orderkey%6=0 THEN 'one' WHEN o_orderkey%6=1 THEN 'two' ELSE (o_orderkey%3+1)::VARCHAR END AS num_adults,
  (o_orderkey%4)::DOUBLE AS num_children
FROM orders JOIN lines ON o_orderkey=l_orderkey JOIN customer ON o_custkey=c_custkey
JOIN nation ON c_nationkey=n_nationkey JOIN firsts ON o_custkey=fc"""
CTES["noshow"] = "SELECT * FROM bookings WHERE no_show IS NOT NULL"
CTES["clean"] = f"""
SELECT booking_id, no_show, branch, {month('booking_month')} AS booking_month, {month('arrival_month')} AS arrival_month,
  arrival_day, {month('checkout_month')} AS checkout_month, abs(checkout_day)::INTEGER AS checkout_day, country,
  {FLAG} AS first_time, room,
  {AMOUNT} * CASE WHEN upper({CURRENCY})='USD' THEN 1.34::DOUBLE ELSE 1::DOUBLE END AS price,
  CASE WHEN upper({CURRENCY})='USD' THEN 'SGD' ELSE {CURRENCY} END AS currency,
  platform, {head_count('num_adults')} AS num_adults, {head_count('num_children')} AS num_children,
  ({head_count('num_adults')} + {head_count('num_children')})::INTEGER AS total_guests
FROM noshow"""


def features(source: str) -> str:
    gap = f"((({BEFORE}[checkout_month] - {BEFORE}[arrival_month]) % 366) + 366) % 366"

    def days(m: str) -> str:
        return f"coalesce({DAYS}[{m}], 30)"

    return f"""
SELECT *, greatest(1, {gap} + checkout_day - arrival_day)::INTEGER AS stay_length,
  (((arrival_month - booking_month) % 12 + 12) % 12)::INTEGER AS lead_time_months,
  price / nullif(total_guests, 0) AS price_per_guest,
  sin(2*pi()*arrival_month/12) AS arrival_month_sin, cos(2*pi()*arrival_month/12) AS arrival_month_cos,
  sin(2*pi()*booking_month/12) AS booking_month_sin, cos(2*pi()*booking_month/12) AS booking_month_cos,
  sin(2*pi()*arrival_day/{days('arrival_month')}) AS arrival_day_sin,
  cos(2*pi()*arrival_day/{days('arrival_month')}) AS arrival_day_cos,
  sin(2*pi()*checkout_day/{days('checkout_month')}) AS checkout_day_sin,
  cos(2*pi()*checkout_day/{days('checkout_month')}) AS checkout_day_cos
FROM {source}"""


CTES["feat"] = features("clean")
CTES["gmode"] = """
SELECT branch, total_guests, room AS mode FROM (SELECT branch, total_guests, room,
  row_number() OVER (PARTITION BY branch, total_guests ORDER BY count(*) DESC, room) k
  FROM clean WHERE room IS NOT NULL GROUP BY 1,2,3) WHERE k=1"""
CTES["bmode"] = """
SELECT branch, room AS mode FROM (SELECT branch, room,
  row_number() OVER (PARTITION BY branch ORDER BY count(*) DESC, room) k
  FROM clean WHERE room IS NOT NULL GROUP BY 1,2) WHERE k=1"""
CTES["room1"] = """
SELECT c.* REPLACE (coalesce(c.room, g.mode, b.mode) AS room)
FROM clean c LEFT JOIN gmode g ON c.branch=g.branch AND c.total_guests=g.total_guests LEFT JOIN bmode b ON c.branch=b.branch"""
CTES["room2"] = """
SELECT * REPLACE (coalesce(room, (SELECT room FROM room1 WHERE room IS NOT NULL GROUP BY room ORDER BY count(*) DESC, room LIMIT 1)) AS room)
FROM room1"""
CTES["pmed"] = "SELECT branch, room, median(price) AS med FROM room2 GROUP BY 1,2"
CTES["price1"] = """
SELECT x.* REPLACE (coalesce(x.price, m.med) AS price) FROM room2 x LEFT JOIN pmed m ON x.branch=m.branch AND x.room=m.room"""
CTES["filled"] = "SELECT * REPLACE (coalesce(price, (SELECT median(price) FROM price1)) AS price) FROM price1"
CTES["imputed"] = features("filled")
CTES["scored"] = """
SELECT booking_id, booking_month, no_show, model, score, (score >= 0.5)::INTEGER AS prediction FROM (
  SELECT booking_id, booking_month, no_show, 'price_rule' AS model, least(coalesce(price, 0)/600000, 1)::DOUBLE AS score FROM feat
  UNION ALL SELECT booking_id, booking_month, no_show, 'guest_rule', (total_guests/8.0)::DOUBLE FROM feat
  UNION ALL SELECT booking_id, booking_month, no_show, 'lead_rule', (lead_time_months/11.0::DOUBLE)::DOUBLE FROM feat)"""
CTES["conf"] = """
SELECT model, count(*) FILTER (no_show=0 AND prediction=0) tn, count(*) FILTER (no_show=0 AND prediction=1) fp,
  count(*) FILTER (no_show=1 AND prediction=0) fn, count(*) FILTER (no_show=1 AND prediction=1) tp FROM scored GROUP BY 1"""


def metric_ctes(name: str, source: str) -> dict[str, str]:
    """All six metrics per model of a scored relation, from ranks rather than running sums."""
    return {
        f"{name}_conf": CTES["conf"].replace("FROM scored", f"FROM {source}"),
        f"{name}_rank": f"""
SELECT model, no_show, (rank() OVER (PARTITION BY model ORDER BY score)
  + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0::DOUBLE) AS mid,
  count(*) OVER (PARTITION BY model ORDER BY score DESC) AS above,
  sum(no_show) OVER (PARTITION BY model ORDER BY score DESC) AS hits FROM {source}""",
        f"{name}_auc": f"""
SELECT model, (sum(mid) FILTER (no_show=1) - sum(no_show) * (sum(no_show) + 1) / 2.0::DOUBLE)
  / (sum(no_show)::DOUBLE * count(*) FILTER (no_show=0)) AS roc_auc,
  sum(hits::DOUBLE / above) FILTER (no_show=1) / sum(no_show) AS pr_auc FROM {name}_rank GROUP BY 1""",
        name: f"""
SELECT model, (tp+tn)/(tp+tn+fp+fn)::DOUBLE AS accuracy, coalesce(tp/nullif(tp+fp,0)::DOUBLE, 0) AS precision,
  coalesce(tp/nullif(tp+fn,0)::DOUBLE, 0) AS recall, coalesce(2*tp/nullif(2*tp+fp+fn,0)::DOUBLE, 0) AS f1_score,
  roc_auc, pr_auc FROM {name}_conf JOIN {name}_auc USING (model)""",
        f"{name}_long": f"SELECT * FROM (UNPIVOT (SELECT * FROM {name}) ON accuracy, precision, recall, f1_score, roc_auc, pr_auc INTO NAME metric VALUE value)",
    }


CTES["scored_old"] = "SELECT * FROM scored WHERE booking_month <= 6"
CTES["scored_new"] = "SELECT * FROM scored WHERE booking_month > 6"
CTES.update(metric_ctes("met", "scored"))
CTES.update(metric_ctes("old", "scored_old"))
CTES.update(metric_ctes("new", "scored_new"))

# splits: sizes by largest remainders, rows by hash order
CTES["classes"] = "SELECT no_show, count(*) c, sum(count(*)) OVER () n FROM noshow GROUP BY 1"
CTES["rest1"] = """
SELECT no_show, c, n, floor(x)::BIGINT + (row_number() OVER (ORDER BY floor(x) - x, no_show)
  <= draws - sum(floor(x)) OVER ())::BIGINT AS rest
FROM (SELECT *, n - ceil(n*0.15::DOUBLE) AS draws, c/n::DOUBLE*(n - ceil(n*0.15::DOUBLE)) AS x FROM classes)"""
CTES["rest2"] = """
SELECT no_show, c, c - rest AS test, rest, floor(x)::BIGINT + (row_number() OVER (ORDER BY floor(x) - x, no_show)
  <= draws - sum(floor(x)) OVER ())::BIGINT AS train
FROM (SELECT *, m - ceil(m*0.15::DOUBLE) AS draws, rest/m::DOUBLE*(m - ceil(m*0.15::DOUBLE)) AS x
      FROM (SELECT *, sum(rest) OVER () AS m FROM rest1))"""
CTES["splits"] = """
SELECT booking_id, no_show, CASE WHEN k <= test THEN 'test' WHEN k <= test + rest - train THEN 'val' ELSE 'train' END AS split
FROM (SELECT booking_id, no_show, row_number() OVER (PARTITION BY no_show ORDER BY md5('42|' || booking_id), booking_id) k FROM noshow)
JOIN rest2 USING (no_show)"""

# two frames for drift: bookings made in the first and in the second half of the year
CTES["ref"] = "SELECT * FROM imputed WHERE booking_month <= 6"
CTES["cur"] = "SELECT * FROM imputed WHERE booking_month > 6"
DRIFT_NUMERIC = ["price", "num_adults", "num_children", "stay_length", "lead_time_months", "price_per_guest"]
DRIFT_CATEGORICAL = ["branch", "country", "room", "platform", "arrival_month"]


def needed(body: str) -> list[str]:
    """The common tables a query text names, directly or through others, in order."""
    import re

    names = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"\b\w+\b", todo.pop()))
        for name in CTES:
            if name in words and name not in names:
                names.add(name)
                todo.append(CTES[name])
    return [n for n in CTES if n in names]


def sql(body: str) -> str:
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed(body))
    return f"WITH {ctes}\n{body}" if ctes else body


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def numeric_long(source: str, columns: list[str], extra: str = "") -> str:
    return union([f"SELECT {extra}'{c}' AS \"column\", {c}::DOUBLE AS value FROM {source}" for c in columns])


def text_long(source: str, columns: list[str], extra: str = "") -> str:
    return union([f"SELECT {extra}'{c}' AS \"column\", {c}::VARCHAR AS value FROM {source}" for c in columns])


# chi-square upper tail: one minus the series of the lower incomplete gamma function
def chi2_tail(x: str, dof: str) -> str:
    return (
        f"CASE WHEN {dof} = 0 THEN 1.0 WHEN {x} <= 0 THEN 1.0 WHEN {x} > 1200 THEN 0.0 ELSE greatest(0.0, 1.0 - list_sum(list_transform(range(0, 1500), "
        f"lambda k: exp(({dof}/2.0 + k) * ln({x}/2.0) - {x}/2.0 - lgamma({dof}/2.0 + k + 1))))) END"
    )


# Student tail: Simpson's rule over the density from 0 to |t|
def t_tail(t: str, dof: str) -> str:
    step = f"(least(abs({t}), 40.0) / 2000)"
    density = f"pow(1 + pow(k * {step}, 2) / {dof}, -({dof} + 1) / 2.0)"
    weight = "CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    constant = f"exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt({dof} * pi())"
    return (
        f"greatest(0.0, 1 - 2 * {constant} * {step} / 3 * list_sum(list_transform(range(0, 2001), "
        f"lambda k: {weight} * {density})))"
    )


def contingency(source: str, pairs: list[tuple[str, str]]) -> str:
    """Dense expected counts and the textbook sum, with Yates' correction for one degree of freedom."""
    cells = union(
        [
            f"SELECT '{a}' AS a, '{b}' AS b, {a}::VARCHAR AS va, {b}::VARCHAR AS vb, count(*)::DOUBLE AS o FROM {source} "
            f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 3, 4"
            for a, b in pairs
        ]
    )
    return f"""
cells AS ({cells}),
rowsum AS (SELECT a, b, va, sum(o) AS ra FROM cells GROUP BY ALL),
colsum AS (SELECT a, b, vb, sum(o) AS ca FROM cells GROUP BY ALL),
dims AS (SELECT a, b, count(DISTINCT va) AS nr, count(DISTINCT vb) AS nc, sum(o) AS n FROM cells GROUP BY ALL),
tests AS (
  SELECT d.a, d.b, d.n, (nr-1)*(nc-1) AS dof, least(nr,nc)-1 AS smaller,
    sum(CASE WHEN (nr-1)*(nc-1)=1 THEN pow(greatest(abs(coalesce(o,0) - ra*ca/d.n) - 0.5, 0), 2)
             ELSE pow(coalesce(o,0) - ra*ca/d.n, 2) END / (ra*ca/d.n)) AS chi2
  FROM dims d JOIN rowsum r USING (a, b) JOIN colsum k USING (a, b) LEFT JOIN cells c
    ON c.a=d.a AND c.b=d.b AND c.va=r.va AND c.vb=k.vb
  GROUP BY d.a, d.b, d.n, nr, nc),
chis AS (SELECT a, b, n, dof, chi2, CASE WHEN smaller > 0 THEN sqrt(chi2/(n*smaller)) ELSE 0 END AS cramers_v FROM tests)"""


def with_extra(extra: str, body: str) -> str:
    """Like ``sql``, with further common tables in front of the body."""
    ctes = [f"{n} AS ({CTES[n]})" for n in needed(extra + body)]
    return f"WITH {', '.join(ctes)},\n{extra}\n{body}"

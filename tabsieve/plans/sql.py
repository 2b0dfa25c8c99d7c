"""Pieces of oracle SQL (DuckDB dialect)."""

from __future__ import annotations

from tabsieve.functions.rng import md5u_sql
from tabsieve.sources.tables import ROLES_SQL


def r(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::double, {digits}) + 0.0::double)"


def melt(source: str, columns: list[str], keep: str, kind: str = "double") -> str:
    return " UNION ALL ".join(f"SELECT {keep + ', ' if keep else ''}'{c}' AS col, {c}::{kind} AS value FROM {source}" for c in columns)


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


ROLES = ROLES_SQL
CUSTOMER = (
    "codes AS (SELECT c_mktsegment AS v, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::double AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)), "
    "enc AS (SELECT c_custkey AS row_id, c_acctbal::double AS a, code AS b FROM customer JOIN codes ON c_mktsegment = v), "
    "re AS (SELECT * FROM enc WHERE row_id % 5 = 0), po AS (SELECT * FROM enc WHERE row_id % 5 <> 0), "
    "thr AS (SELECT x.row_id, min(sqrt((x.a-y.a)*(x.a-y.a)+(x.b-y.b)*(x.b-y.b))) AS dist FROM re x LEFT JOIN re y ON x.row_id <> y.row_id GROUP BY x.row_id), "
    "rr AS (SELECT re.*, dist FROM re JOIN thr USING (row_id)), "
    "flags AS (SELECT p.row_id, max(CASE WHEN sqrt((p.a-q.a)*(p.a-q.a)+(p.b-q.b)*(p.b-q.b)) < q.dist THEN 1 ELSE 0 END)::int AS flag FROM po p CROSS JOIN rr q GROUP BY p.row_id)"
)
WEIGHTED = (
    "pool AS (SELECT c_custkey AS row_id, c_nationkey, 0.05::double+0.9::double*" + md5u_sql(7, "c_custkey") + " AS p, CASE WHEN " + md5u_sql(11, "c_custkey") + " < 0.3::double THEN 1 ELSE 0 END AS flag FROM customer WHERE c_custkey % 5 <> 0), "
    "wp AS (SELECT *, 4.0::double*least(greatest(p,1e-9::double),(1-1e-9)::double)/(1-least(greatest(p,1e-9::double),(1-1e-9)::double)) AS w FROM pool)"
)
FREQ = (
    "long AS (" + melt("roles", ["l_returnflag", "l_linestatus", "l_linenumber"], "ds", "varchar") + "), "
    "cnt AS (SELECT col, value AS bucket, count(*) FILTER (ds='real') AS a, count(*) FILTER (ds='raw') AS b FROM long WHERE ds IN ('real','raw') AND value IS NOT NULL GROUP BY 1,2), "
    "freq AS (SELECT col, bucket, a/sum(a) OVER (PARTITION BY col) + 1e-10::double AS p, b/sum(b) OVER (PARTITION BY col) + 1e-10::double AS q FROM cnt)"
)
BINNED = (
    "long AS (" + melt("roles", ["l_quantity", "l_extendedprice", "l_discount"], "ds") + "), "
    "own AS (SELECT col, min(value) AS lo, max(value) AS hi, least(count(DISTINCT value), 50) AS k FROM long WHERE ds='real' GROUP BY col), "
    "placed AS (SELECT ds, col, CASE WHEN k <= 1 THEN 0 WHEN value > lo - 0.001::double*(hi-lo) AND value <= hi THEN greatest(ceil((value-lo)/(hi-lo)*k), 1) ELSE -1 END::int AS bucket FROM long JOIN own USING (col) WHERE ds IN ('real','raw')), "
    "cnt AS (SELECT col, bucket, sum(a) AS a, sum(b) AS b FROM (SELECT col, bucket, count(*) FILTER (ds='real') AS a, count(*) FILTER (ds='raw') AS b FROM placed GROUP BY 1,2 UNION ALL SELECT col, unnest(generate_series(1, k))::int, 0, 0 FROM own WHERE k > 1) GROUP BY 1,2), "
    "freq AS (SELECT col, bucket, a/sum(a) OVER (PARTITION BY col) + 1e-10::double AS p, b/sum(b) OVER (PARTITION BY col) + 1e-10::double AS q FROM cnt)"
)
NORMAL = "f AS (SELECT *, (p1+q1)/2 AS m FROM (SELECT col, p, q, p/sum(p) OVER (PARTITION BY col) AS p1, q/sum(q) OVER (PARTITION BY col) AS q1 FROM freq))"
CDF = (
    "long AS (" + melt("roles", ["l_quantity", "l_extendedprice", "l_discount"], "ds") + "), "
    "cnt AS (SELECT col, value, count(*) FILTER (ds='real') AS a, count(*) FILTER (ds='raw') AS b FROM long WHERE ds IN ('real','raw') AND value IS NOT NULL GROUP BY 1,2), "
    "cdf AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY col) AS na, sum(b) OVER (PARTITION BY col) AS nb, lead(value) OVER w AS nxt FROM cnt WINDOW w AS (PARTITION BY col ORDER BY value)), "
    "dist AS (SELECT col, max(abs(ca/na-cb/nb)) AS ks, sum(abs(ca/na-cb/nb)*coalesce(nxt-value,0)) AS w1, max(na) AS na, max(nb) AS nb FROM cdf GROUP BY col)"
)
PAIRS = " UNION ALL ".join(f"SELECT ds, '{a}' AS x, '{b}' AS y, {a}::varchar AS vx, {b}::varchar AS vy FROM roles" for a, b in (("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_linenumber")))
MARGINS = (
    "pairs AS (" + PAIRS + "), c AS (SELECT ds,x,y,vx,vy,count(*)::double AS n FROM pairs GROUP BY ALL), "
    "m AS (SELECT *, sum(n) OVER (PARTITION BY ds,x,y,vx) AS nr, sum(n) OVER (PARTITION BY ds,x,y,vy) AS nc, sum(n) OVER (PARTITION BY ds,x,y) AS nn FROM c)"
)
GRID = (
    "grid AS (SELECT rr.ds, rr.x, rr.y, rr.vx, cc.vy, nr, nc, nn, coalesce(n, 0) AS n FROM (SELECT DISTINCT ds,x,y,vx,nr,nn FROM m) rr JOIN (SELECT DISTINCT ds,x,y,vy,nc FROM m) cc ON rr.ds=cc.ds AND rr.x=cc.x AND rr.y=cc.y "
    "LEFT JOIN c ON c.ds=rr.ds AND c.x=rr.x AND c.y=rr.y AND c.vx=rr.vx AND c.vy=cc.vy), "
    "dims AS (SELECT ds,x,y,count(DISTINCT vx) AS r, count(DISTINCT vy) AS k FROM grid GROUP BY ALL), "
    "chi AS (SELECT ds,x,y,any_value(r) AS r, any_value(k) AS k, any_value(nn) AS n, sum(pow(abs(n-nr*nc/nn) - CASE WHEN r=2 AND k=2 THEN least(0.5::double, abs(n-nr*nc/nn)) ELSE 0 END, 2)/(nr*nc/nn)) AS chi2 FROM grid JOIN dims USING (ds,x,y) GROUP BY ALL), "
    "cv AS (SELECT ds,x,y,sqrt(chi2/(n*(least(r,k)-1)+1e-16::double)) AS v FROM chi)"
)
NUMS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
NPAIRS = " UNION ALL ".join(f"SELECT ds, '{a}' AS x, '{b}' AS y, {a}::double AS vx, {b}::double AS vy FROM roles" for i, b in enumerate(NUMS) for a in NUMS[:i])
ETA = (
    "el AS (" + " UNION ALL ".join(f"SELECT ds, '{c}' AS cat, '{n}' AS num, {c}::varchar AS g, {n}::double AS v FROM roles" for c in ("l_returnflag", "l_linestatus") for n in NUMS) + "), "
    "ew AS (SELECT *, avg(v) OVER (PARTITION BY ds,cat,num) AS mean, avg(v) OVER (PARTITION BY ds,cat,num,g) AS gm FROM el), "
    "eta AS (SELECT ds,cat,num, CASE WHEN sum((gm-mean)*(gm-mean)) > 0 AND sum((v-mean)*(v-mean)) > 0 THEN sum((gm-mean)*(gm-mean))/sum((v-mean)*(v-mean)) ELSE 0 END AS eta2 FROM ew GROUP BY ALL)"
)
SPEAR = (
    "np AS (" + NPAIRS + "), rk AS (SELECT ds,x,y, rank() OVER (PARTITION BY ds,x,y ORDER BY vx) + (count(*) OVER (PARTITION BY ds,x,y,vx) - 1)/2.0::double AS rx, rank() OVER (PARTITION BY ds,x,y ORDER BY vy) + (count(*) OVER (PARTITION BY ds,x,y,vy) - 1)/2.0::double AS ry FROM np), "
    "sp AS (SELECT ds,x,y,corr(rx,ry) AS r FROM rk GROUP BY ALL)"
)
CATS2 = (
    "pairs AS (SELECT ds, 'l_returnflag' AS x, 'l_linestatus' AS y, l_returnflag::varchar AS vx, l_linestatus::varchar AS vy FROM roles), c AS (SELECT ds,x,y,vx,vy,count(*)::double AS n FROM pairs GROUP BY ALL), "
    "m AS (SELECT *, sum(n) OVER (PARTITION BY ds,x,y,vx) AS nr, sum(n) OVER (PARTITION BY ds,x,y,vy) AS nc, sum(n) OVER (PARTITION BY ds,x,y) AS nn FROM c)"
)
MIXED = (
    CATS2 + ", " + GRID + ", " + ETA + ", " + SPEAR + ", mat AS (SELECT ds, y AS row_var, x AS col_var, 'cat_cat' AS kind, v AS value FROM cv UNION ALL SELECT ds, num, cat, 'num_cat', eta2 FROM eta UNION ALL SELECT ds, y, x, 'num_num', r FROM sp)"
)
MOMENTS = (
    "long AS (" + melt("roles", list(NUMS), "ds") + "), mm AS (SELECT ds, col, value, avg(value) OVER (PARTITION BY ds,col) AS m FROM long), "
    "mom AS (SELECT ds, col, any_value(m) AS mean, sqrt(avg((value-m)*(value-m))) AS std, avg(pow(value-m,3))/pow(avg((value-m)*(value-m)),1.5) AS skew, avg(pow(value-m,4))/pow(avg((value-m)*(value-m)),2)-3 AS kurt, min(value) AS min, max(value) AS max, "
    "quantile_cont(value,0.25) AS q25, quantile_cont(value,0.5) AS median, quantile_cont(value,0.75) AS q75, stddev_samp(value) AS sd FROM mm GROUP BY ds, col)"
)
SCALED = (
    "sp0 AS (SELECT " + ", ".join(f"min({c}) AS lo{k}, max({c}) AS hi{k}" for k, c in enumerate(NUMS)) + " FROM roles WHERE ds='real'), "
    "sc AS (SELECT ds, " + ", ".join(f"({c}-lo{k})/(hi{k}-lo{k}) AS s{k}" for k, c in enumerate(NUMS)) + " FROM roles CROSS JOIN sp0)"
)
CDFW = (
    "w9 AS (SELECT row_id, floor(w/(SELECT max(w) FROM wp)*1e9::double+0.5::double)::bigint AS wi FROM wp), iv AS (SELECT row_id, sum(wi) OVER (ORDER BY row_id) - wi AS lo, sum(wi) OVER (ORDER BY row_id) AS hi FROM w9 WHERE wi > 0)"
)


def draws(intervals: str, seed: int, n: int) -> str:
    u = md5u_sql(seed, "d.i")
    return f"SELECT d.i AS draw, row_id FROM (SELECT unnest(generate_series(0, {n - 1})) AS i) d JOIN {intervals} t ON floor({u}*(SELECT max(hi) FROM {intervals})::double)::bigint >= t.lo AND floor({u}*(SELECT max(hi) FROM {intervals})::double)::bigint < t.hi"

"""The library's queries over the test tables, each with the SQL that says the same.

Metrics are ``events`` (trial user_id, name event_type, order event_id), trials are ``orders``,
partitions are ``lineitem`` within an order, run trees go region, nation, customer, payloads are
``documents``, checkpoints are ``conversations``, parameters and design rows are ``part``.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.functions import canonical
from trialframe.functions.expressions import compile_expression
from trialframe.operators import decisions, designs, evolution, ordering, reductions, refinement, runstore, tables
from trialframe.plans import pipeline as dag
from trialframe.plans.space import Boolean, Categorical, Condition, Constraint, Derived, Fixed, Float, Integer, Ordinal, Space, project, resolve, unit_column, violation
from trialframe.scratch import fresh_path
from trialframe.sources import artifacts as store
from trialframe.sources import database, exchange
from trialframe.streaming import metrics as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    """Trials with their last metrics."""
    e = _t(spark, sf, "events")
    return decisions.pivot_metrics(e, {"quality": "purchase", "latency": "error", "clicks": "click"}, "user_id", "event_type", "value", "event_id")


WIDE = """wide AS (SELECT user_id, max_by(value, event_id) FILTER (WHERE event_type='purchase') AS quality,
 max_by(value, event_id) FILTER (WHERE event_type='error') AS latency,
 max_by(value, event_id) FILTER (WHERE event_type='click') AS clicks FROM events GROUP BY user_id)"""


# -- metrics and decisions ----------------------------------------------------------------------------------


@_query("SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def latest_metric(spark, sf):
    return decisions.latest(_t(spark, sf, "events"), ["user_id", "event_type"], "event_id", ["value"])


@_query(f"WITH {WIDE} SELECT * FROM wide")
def metric_pivot(spark, sf):
    return _wide(spark, sf)


TOP = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus='F' AND o_totalprice IS NOT NULL ORDER BY o_totalprice {}, o_orderkey LIMIT {}"


def _orders(spark, sf):
    states = F.create_map(*(F.lit(x) for x in ("F", "completed", "O", "running", "P", "paused")))
    return _t(spark, sf, "orders").withColumn("state", F.try_element_at(states, F.col("o_orderstatus")))


@_query(TOP.format("DESC", 25))
def top_k_max(spark, sf):
    return decisions.top_k(_orders(spark, sf), "o_totalprice", 25, ordinal="o_orderkey").select("o_orderkey", "o_totalprice")


@_query(TOP.format("ASC", 25))
def top_k_min(spark, sf):
    return decisions.top_k(_orders(spark, sf), "o_totalprice", 25, "minimize", "o_orderkey").select("o_orderkey", "o_totalprice")


@_query(f"WITH {WIDE} SELECT user_id, quality, latency, clicks FROM wide WHERE latency <= 250 AND clicks >= 20 AND quality IS NOT NULL ORDER BY quality DESC, user_id LIMIT 10")
def best_feasible(spark, sf):
    rules = {"latency": ("le", 250.0), "clicks": ("ge", 20.0)}
    return decisions.best_feasible(_wide(spark, sf), "quality", rules, 10, ordinal="user_id", state=None)


@_query(f"WITH {WIDE} SELECT * FROM wide WHERE quality >= 150")
def threshold_ge(spark, sf):
    return decisions.threshold(_wide(spark, sf), "quality", 150.0, "ge")


@_query(f"WITH {WIDE} SELECT * FROM wide WHERE latency <= 50")
def threshold_le(spark, sf):
    return decisions.threshold(_wide(spark, sf), "latency", 50.0, "<=")


@_query("""WITH c AS (SELECT c_custkey, c_acctbal AS gain, c_custkey % 1000 AS cost FROM customer)
SELECT c_custkey, gain, cost FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.gain >= c.gain AND d.cost <= c.cost AND (d.gain > c.gain OR d.cost < c.cost))""")
def pareto_fast(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("gain"), (F.col("c_custkey") % 1000).alias("cost"))
    return decisions.pareto_front(c, {"gain": "maximize", "cost": "minimize"})


@_query(f"""WITH {WIDE}, w AS (SELECT * FROM wide WHERE quality IS NOT NULL AND latency IS NOT NULL AND clicks IS NOT NULL)
SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM w d WHERE d.quality >= w.quality AND d.latency <= w.latency AND d.clicks >= w.clicks
 AND (d.quality > w.quality OR d.latency < w.latency OR d.clicks > w.clicks))""")
def pareto_front(spark, sf):
    return decisions.pareto_front(_wide(spark, sf), {"quality": "maximize", "latency": "minimize", "clicks": "maximize"})


@_query("""WITH best AS (SELECT o_custkey FROM orders WHERE o_orderstatus='F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM best)""")
def selected_trials(spark, sf):
    best = decisions.top_k(_orders(spark, sf), "o_totalprice", 25, ordinal="o_orderkey").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf, "customer").join(best, "c_custkey", "left_semi").select("c_custkey", "c_name")


# -- refinement ---------------------------------------------------------------------------------------------

SPACE = Space((Float("price", low=0.0, high=3000.0), Integer("size", low=1, high=50), Categorical("brand", values=tuple(f"Brand#{i}" for i in range(1, 60)))))
ELITE = "elite AS (SELECT p_partkey, p_retailprice AS price, p_size AS size, p_brand AS brand FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40)"


def _elite(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("trial_id"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    return decisions.top_k(p, "price", 40, ordinal="trial_id", state=None).withColumn("rank", F.row_number().over(_by_price()))


def _by_price():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("price"), "trial_id")


def _bounds(spark, space: Space, digits: int = 6) -> DataFrame:
    rows = [(p.name, round(float(p.low), digits), round(float(p.high), digits)) for p in space.parameters if isinstance(p, Float | Integer)]
    return spark.createDataFrame(rows, "parameter string, low double, high double")


@_query(f"WITH {ELITE} SELECT round(quantile_cont(price, 0.1), 6) AS lo, round(quantile_cont(price, 0.9), 6) AS hi FROM elite")
def elite_quantiles(spark, sf):
    q = F.percentile("price", [0.1, 0.9])
    return _elite(spark, sf).agg(q.alias("q")).select(F.round(F.col("q")[0], 6).alias("lo"), F.round(F.col("q")[1], 6).alias("hi"))


@_query(f"""WITH {ELITE}, q AS (SELECT quantile_cont(price, 0.1) AS a, quantile_cont(price, 0.9) AS b, quantile_cont(size, 0.1) AS c, quantile_cont(size, 0.9) AS d FROM elite),
i AS (SELECT *, greatest(ceil((d - c) * 1.25), 3) AS w, round_even((c + d) / 2, 0) AS m FROM q)
SELECT 'price' AS parameter, round(greatest(0.0, (a + b) / 2 - greatest((b - a) * 1.25, 150.0) / 2), 6) AS low, round(least(3000.0, (a + b) / 2 + greatest((b - a) * 1.25, 150.0) / 2), 6) AS high FROM i
UNION ALL SELECT 'size', greatest(1.0, m - floor(w / 2))::double, least(50.0, greatest(greatest(1.0, m - floor(w / 2)) + 1, m + ceil(w / 2)))::double FROM i""")
def elite_zoom(spark, sf):
    return _bounds(spark, refinement.elite_zoom(SPACE, _elite(spark, sf)))


@_query(f"WITH {ELITE} SELECT DISTINCT brand FROM elite")
def elite_zoom_categorical(spark, sf):
    space = refinement.elite_zoom(SPACE, _elite(spark, sf))
    return spark.createDataFrame([(v,) for v in space.parameters[2].values], "brand string")


def _near(radius: float) -> str:
    r = max(1, -(-49 * radius // 1))
    return f"""WITH {ELITE}, b AS (SELECT * FROM elite ORDER BY price DESC, p_partkey LIMIT 1)
SELECT 'price' AS parameter, round(greatest(0.0, price - 3000.0 * {radius}), 6) AS low, round(least(3000.0, price + 3000.0 * {radius}), 6) AS high FROM b
UNION ALL SELECT 'size', greatest(1, size - {r})::double, least(50, size + {r})::double FROM b"""


@_query(_near(0.1))
def neighborhood(spark, sf):
    return _bounds(spark, refinement.neighbourhood(SPACE, _elite(spark, sf), "rank"))


@_query(_near(0.2 * 1.5).replace("0.30000000000000004", "0.3"))
def trust_region(spark, sf):
    return _bounds(spark, refinement.trust_region(SPACE, _elite(spark, sf), "rank"))


@_query(_near(0.03))
def robustness(spark, sf):
    return _bounds(spark, refinement.robustness(SPACE, _elite(spark, sf), "rank"))


@_query(f"WITH {ELITE} SELECT p_partkey::varchar AS trial_id, r::integer AS replicate_index FROM elite, (SELECT unnest([0, 1, 2]) AS r)")
def replication(spark, sf):
    return refinement.replication(SPACE, _elite(spark, sf))[1]


@_query("""WITH n AS (SELECT count(*) AS n FROM part), r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
SELECT p_partkey FROM r, n WHERE rank <= greatest(1, ceil(n * 0.15))""")
def elite_share(spark, sf):
    ranked = ordering.numbered(_t(spark, sf, "part"), {"price": -F.col("p_retailprice"), "id": F.col("p_partkey")}, "rank")
    return refinement.elites(ranked, "rank", 0.15).select("p_partkey")


# -- spaces and designs -------------------------------------------------------------------------------------

MIXED = Space((Float("x", low=-5.0, high=2.0), Integer("n", low=3, high=9), Categorical("kind", values=("a", "b", "c")), Boolean("flag")))


def _unit(spark, sf):
    return _t(spark, sf, "events").select("event_id", (F.col("value") / 500).alias("u"))


UNIT = "u AS (SELECT event_id, value / 500 AS v, least(greatest(value / 500, 0.0), 0.9999999999999999) AS u FROM events)"


@_query(f"WITH {UNIT} SELECT event_id, round(-5.0::double + u * 7.0::double, 9) AS linear, round(exp(ln(0.001::double) + u * (ln(10.0::double) - ln(0.001::double))), 9) AS loglike, round(least(greatest(round_even((-5.0::double + u * 7.0::double) / 0.25::double, 0) * 0.25::double, -5.0), 2.0), 9) AS stepped FROM u")
def unit_float(spark, sf):
    u = F.col("u")
    cols = {"linear": Float("x", low=-5.0, high=2.0), "loglike": Float("x", low=0.001, high=10.0, log=True), "stepped": Float("x", low=-5.0, high=2.0, step=0.25)}
    return _unit(spark, sf).select("event_id", *(F.round(p.from_unit(u), 9).alias(k) for k, p in cols.items()))


@_query(f"WITH {UNIT} SELECT event_id, (3 + floor(u * 97))::bigint AS linear, least(greatest(round_even(exp(ln(1.0::double) + u * (ln(100.0::double) - ln(1.0::double))), 0), 1), 100)::bigint AS loglike, least(greatest(3 + round_even(floor(u * 97) / 5.0::double, 0) * 5, 3), 99)::bigint AS stepped FROM u")
def unit_int(spark, sf):
    u = F.col("u")
    cols = {"linear": Integer("n", low=3, high=99), "loglike": Integer("n", low=1, high=100, log=True), "stepped": Integer("n", low=3, high=99, step=5)}
    return _unit(spark, sf).select("event_id", *(p.from_unit(u).alias(k) for k, p in cols.items()))


@_query(f"WITH {UNIT} SELECT event_id, (['a', 'b', 'c'])[least(2, floor(u * 3))::int + 1] AS cat, ([1, 2, 5, 10])[least(3, floor(u * 4))::int + 1] AS ord, u >= 0.5 AS flag FROM u")
def unit_choice(spark, sf):
    u = F.col("u")
    return _unit(spark, sf).select("event_id", Categorical("c", values=("a", "b", "c")).from_unit(u).alias("cat"), Ordinal("o", values=(1, 2, 5, 10)).from_unit(u).alias("ord"), Boolean("b").from_unit(u).alias("flag"))


@_query("""SELECT p_partkey, round((p_retailprice - 0.0) / 3000.0, 9) AS price, round((ln(p_retailprice) - ln(1.0::double)) / (ln(3000.0::double) - ln(1.0::double)), 9) AS logprice,
 round((p_size - 1) / 49.0::double, 9) AS size, CASE WHEN p_size % 2 = 0 THEN 1.0::double ELSE 0.0::double END AS flag, 0.0::double AS fixed,
 CASE WHEN p_size % 4 = 3 THEN NULL ELSE (p_size % 4) / 2.0::double END AS cat FROM part""")
def to_unit(spark, sf):
    p = _t(spark, sf, "part")
    values = {
        "price": Float("x", low=0.0, high=3000.0).to_unit(F.col("p_retailprice")),
        "logprice": Float("x", low=1.0, high=3000.0, log=True).to_unit(F.col("p_retailprice")),
        "size": Integer("n", low=1, high=50).to_unit(F.col("p_size")),
    }
    cat = Categorical("c", values=("0", "1", "2")).to_unit((F.col("p_size") % 4).cast("string"))
    exact = {"flag": Boolean("b").to_unit(F.col("p_size") % 2 == 0), "fixed": Fixed("f", value=3).to_unit(F.lit(3)), "cat": cat}
    return p.select("p_partkey", *(F.round(v, 9).alias(k) for k, v in values.items()), *(v.alias(k) for k, v in exact.items()))


def _items(spark, sf):
    i = _t(spark, sf, "lineitem")
    return i.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"))


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE 5 <= l_quantity AND l_quantity < 20 AND l_returnflag IN ('A', 'R')
 AND NOT (l_discount > 0.05 OR l_extendedprice * (1 - l_discount) < 1000)""")
def constraint_filter(spark, sf):
    rules = (Constraint("5 <= quantity < 20", "quantity"), Constraint("flag in ['A', 'R']", "flag"), Constraint("not (discount > 0.05 or price * (1 - discount) < 1000)", "price"))
    space = Space(tuple(Fixed(n) for n in ("quantity", "discount", "price", "flag")), rules)
    return _items(spark, sf).where(violation(space).isNull()).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@_query("""SELECT CASE WHEN NOT (5 <= l_quantity AND l_quantity < 20) THEN 'quantity' WHEN l_returnflag NOT IN ('A', 'R') THEN 'flag' ELSE 'kept' END AS why, count(*) AS n FROM lineitem GROUP BY 1""")
def constraint_rejects(spark, sf):
    space = Space((Fixed("quantity"), Fixed("flag")), (Constraint("5 <= quantity < 20", "quantity"), Constraint("flag in ['A', 'R']", "flag")))
    return _items(spark, sf).groupBy(F.coalesce(violation(space), F.lit("kept")).alias("why")).agg(F.count("*").alias("n"))


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / l_quantity, 9) AS unit_price,
 round((l_quantity - 25) - -7 * floor((l_quantity - 25) / -7), 6) AS wrapped, round(pow(l_discount, 2) + -l_discount, 9) AS curve, round_even(l_quantity / 2, 0) AS half FROM lineitem""")
def derived_column(spark, sf):
    names = ["price", "quantity", "discount"]
    made = {"unit_price": ("price / quantity", 9), "wrapped": ("(quantity - 25) % -7", 6), "curve": ("discount ** 2 + -discount", 9)}
    df = _items(spark, sf)
    cols = [F.round(compile_expression(e, names), d).alias(k) for k, (e, d) in made.items()]
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *cols, F.bround(compile_expression("quantity / 2", names)).alias("half"))


@_query(f"""WITH {UNIT}, m AS (SELECT event_id, u, (['a', 'b', 'c'])[least(2, floor(u * 3))::int + 1] AS method FROM u),
s AS (SELECT *, CASE WHEN method IN ('b', 'c') THEN 10.0::double + u * 10.0::double END AS strength FROM m)
SELECT event_id, method, round(strength, 9) AS strength, CASE WHEN strength IS NULL THEN 1 END AS fallback, 3 AS depth, round(u * 4.0::double * 2, 9) AS twice FROM s WHERE 3 <= 3 AND u * 4.0::double * 2 <= 7""")
def activation_conditional(spark, sf):
    space = Space(
        (
            Categorical("method", values=("a", "b", "c")),
            Float("strength", low=10.0, high=20.0, active_when=Condition("method", "in", ("b", "c"))),
            Fixed("fallback", value=1, active_when=Condition("strength", "eq", None)),
            Fixed("depth", value=3),
            Float("base", low=0.0, high=4.0),
            Derived("twice", expression="base * 2", sources=("base",)),
        ),
        (Constraint("depth <= 3 and twice <= 7"),),
    )
    units = _unit(spark, sf).select("event_id", *(F.col("u").alias(unit_column(p)) for p in space.sampled))
    return resolve(units, space).select("event_id", "method", F.round("strength", 9).alias("strength"), "fallback", "depth", F.round("twice", 9).alias("twice"))


def _numbered_parts(spark, sf):
    return ordering.numbered(_t(spark, sf, "part").select("p_partkey"), {"key": F.col("p_partkey")}, "row_index")


NUMBERED = "parts AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part)"


@_query("""WITH b AS (SELECT min(p_retailprice) AS low, max(p_retailprice) AS high, min(p_size) AS least, max(p_size) AS most FROM part),
k AS (SELECT p_type AS kind, row_number() OVER (ORDER BY p_type) - 1 AS place, count(*) OVER () AS kinds FROM (SELECT DISTINCT p_type FROM part))
SELECT (x.range * 3 * kinds * 2 + n.range * kinds * 2 + place * 2 + f.range)::bigint AS row_index, round(low + (x.range + 0.5) / 4.0::double * (high - low), 6) AS price,
 (least + floor((n.range + 0.5) / 3.0::double * (most - least + 1)))::bigint AS size, kind, f.range = 1 AS flag FROM b, k, range(4) x, range(3) n, range(2) f""")
def grid_design(spark, sf):
    """A grid over what the parts' prices, sizes and types range over."""
    parts = _t(spark, sf, "part")
    b = parts.agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"), F.min("p_size").alias("least"), F.max("p_size").alias("most"), F.array_sort(F.collect_set("p_type")).alias("kinds")).first()
    space = Space((Float("price", low=b.low, high=b.high), Integer("size", low=b.least, high=b.most), Categorical("kind", values=tuple(b.kinds)), Boolean("flag")))
    return project(designs.grid_units(spark, space, {"price": 4, "size": 3}), space).withColumn("price", F.round("price", 6))


@_query("""WITH brands AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i FROM (SELECT DISTINCT p_brand FROM part)), types AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS j, count(*) OVER () AS m FROM (SELECT DISTINCT p_type FROM part)),
have AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type)
SELECT i * m + j AS row_index, p_brand AS brand, p_type AS kind, 0 AS replicate_index, 'factorial' AS planner, coalesce(n, 0) AS parts FROM brands CROSS JOIN types LEFT JOIN have USING (p_brand, p_type)""")
def factorial_design(spark, sf):
    """All brands by all types, and how many parts there are of each."""
    parts = _t(spark, sf, "part")
    levels = parts.agg(F.array_sort(F.collect_set("p_brand")).alias("brand"), F.array_sort(F.collect_set("p_type")).alias("kind")).first()
    space = Space((Categorical("brand", values=tuple(levels.brand)), Categorical("kind", values=tuple(levels.kind))))
    plan = designs.propose(spark, space, designs.Request(len(levels.brand) * len(levels.kind), seed=1), "factorial").select("row_index", "brand", "kind", "replicate_index", "planner")
    have = parts.groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")).agg(F.count("*").alias("parts"))
    return plan.join(have, ["brand", "kind"], "left").withColumn("parts", F.coalesce("parts", F.lit(0)).cast("long"))


#: Degree, coefficients and initial numbers of the Sobol dimensions behind the first, as published (fixed values).
PUBLISHED = "(1, 1, 0, [1]), (2, 2, 1, [1, 3]), (3, 3, 1, [1, 3, 1]), (4, 3, 2, [1, 1, 1]), (5, 4, 1, [1, 1, 3, 3]), (6, 4, 4, [1, 3, 5, 13]), (7, 5, 2, [1, 1, 5, 5, 17])"


@_query(f"""WITH RECURSIVE {NUMBERED}, table_(d, s, a, start) AS (VALUES {PUBLISHED}),
m(d, s, a, m) AS (SELECT d, s, a, start::bigint[] FROM table_ UNION ALL SELECT d, s, a, list_append(m, list_reduce(list_transform(range(1, s), lambda j: ((a >> (s - 1 - j)::integer) & 1) * (m[(len(m) + 1 - j)] << j)), lambda x, y: xor(x, y), xor(m[len(m) + 1 - s], m[len(m) + 1 - s] << s))) FROM m WHERE len(m) < 30),
v AS (SELECT d, list_transform(range(1, 31), lambda k: m[k] << (30 - k)) AS v FROM m WHERE len(m) = 30 UNION ALL SELECT 0, list_transform(range(1, 31), lambda k: 1::bigint << (30 - k))),
x AS (SELECT p_partkey, i, d, list_reduce(list_transform(range(1, 31), lambda k: ((xor(i, i >> 1) >> (k - 1)) & 1) * v[k]), lambda a, b: xor(a, b)) / 1073741824.0::double AS u FROM parts, v)
SELECT p_partkey, i AS row_index, {", ".join(f"round(max(u) FILTER (WHERE d = {d}), 9) AS d{d}" for d in range(8))} FROM x GROUP BY p_partkey, i""")
def sobol_design(spark, sf):
    """A point of eight dimensions for every part."""
    space = Space(tuple(Float(f"d{j}") for j in range(8)))
    rows = _numbered_parts(spark, sf)
    return designs.sobol_units(spark, space, 1, rows=rows).select("p_partkey", "row_index", *(F.round(unit_column(p), 9).alias(p.name) for p in space.sampled))


@_query("WITH n AS (SELECT count(*) AS n FROM part), s AS (SELECT unnest([4, 16, 64]) AS cells) SELECT cells, (n // cells)::bigint AS least, ((n + cells - 1) // cells)::bigint AS most FROM n, s")
def sobol_scrambled(spark, sf):
    """Parts in each of 4, 16 and 64 intervals under nested uniform scrambling, least and most over all intervals of eight dimensions: as even as can be."""
    at = F.col("row_index")
    units = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), designs.owen_unit(at, d, 5).alias("u")) for d in range(0, 24, 3)))).alias("x")
    cells = F.explode(F.array(*(F.lit(c) for c in (4, 16, 64)))).alias("cells")
    per = _numbered_parts(spark, sf).select(units).select("x.d", "x.u", cells).groupBy("cells", "d", F.floor(F.col("u") * F.col("cells")).alias("cell")).agg(F.count("*").alias("n"))
    return per.groupBy("cells").agg(F.min("n").alias("least"), F.max("n").alias("most"))


@_query(f"""WITH RECURSIVE {NUMBERED}, h(p_partkey, i, base, r, f, k) AS (SELECT p_partkey, i, b.base, 0.0::double, 1.0::double / b.base, i FROM parts, (SELECT unnest([2, 3, 5]) AS base) b
 UNION ALL SELECT p_partkey, i, base, r + f * (k % base), f / base, k // base FROM h WHERE k > 0)
SELECT p_partkey, i AS row_index, round(max(r) FILTER (WHERE base = 2), 9) AS d0, round(max(r) FILTER (WHERE base = 3), 9) AS d1, round(max(r) FILTER (WHERE base = 5), 9) AS d2 FROM h WHERE k = 0 GROUP BY p_partkey, i""")
def halton_design(spark, sf):
    """A point of three dimensions for every part."""
    space = Space(tuple(Float(f"d{j}") for j in range(3)))
    units = designs.halton_units(spark, space, 1, rows=_numbered_parts(spark, sf))
    return units.select("p_partkey", "row_index", *(F.round(unit_column(p), 9).alias(p.name) for p in space.sampled))


@_query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS stratum, 1::bigint AS a, 1::bigint AS b FROM part")
def lhs_design(spark, sf):
    """How many parts each stratum of either dimension has, with as many strata as parts."""
    space = Space((Float("a"), Float("b")))
    n = _t(spark, sf, "part").count()
    units = designs.latin_units(spark, space, n, seed=9, rows=_numbered_parts(spark, sf))
    count = lambda p: units.groupBy(F.floor(F.col(unit_column(p)) * n).alias("stratum")).agg(F.count("*").alias(p.name))
    return count(space.parameters[0]).join(count(space.parameters[1]), "stratum", "full")


@_query()
def random_design(spark, sf):
    """A random trial of the mixed space for every part."""
    return project(designs.random_units(spark, MIXED, 1, 3, rows=_numbered_parts(spark, sf)), MIXED)


@_query()
def numpy_design(spark, sf):
    """A trial of the mixed space for every part, with NumPy's draws."""
    return project(designs.numpy_units(spark, MIXED, 1, 3, rows=_numbered_parts(spark, sf)), MIXED)


@_query("""WITH RECURSIVE s AS (SELECT p_brand || '/' || p_type AS space, min(p_retailprice) AS low1, max(p_retailprice) AS high1, min(p_size)::double AS low2, max(p_size)::double AS high2, count(*) AS n FROM part GROUP BY p_brand, p_type),
rows_ AS (SELECT space, unnest(range(n)) AS i, low1, high1, low2, high2 FROM s),
x AS (SELECT space, i, 'p_retailprice' AS name, 2 AS base, low1 AS low, high1 AS high FROM rows_ UNION ALL SELECT space, i, 'p_size', 3, low2, high2 FROM rows_),
h(space, i, name, base, low, high, r, f, k) AS (SELECT space, i, name, base, low, high, 0.0::double, 1.0::double / base, i FROM x UNION ALL SELECT space, i, name, base, low, high, r + f * (k % base), f / base, k // base FROM h WHERE k > 0)
SELECT space, i AS row_index, name, round(r, 9) AS unit, round(low + r * (high - low), 6) AS value FROM h WHERE k = 0""")
def designs_by_table(spark, sf):
    """A design for each brand and type of parts, as many trials as there are parts, by the table function."""
    part = _t(spark, sf, "part").withColumn("space", F.concat_ws("/", "p_brand", "p_type"))
    axes = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in ("p_size", "p_retailprice")))).alias("x")
    spaces = part.select("space", axes).groupBy("space", "x.name").agg(F.min("x.v").alias("low"), F.max("x.v").alias("high"), F.count("*").alias("n"))
    tables.register(spark)
    out = spark.sql("SELECT * FROM planned(TABLE({spaces}), planner => 'halton')", spaces=spaces)
    return out.withColumn("unit", F.round("unit", 9)).withColumn("value", F.round("value", 6))


@_query("SELECT p_partkey, p_size, p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS row_index FROM part")
def design_matrix(spark, sf):
    rows = _t(spark, sf, "part").select("p_partkey", "p_size", "p_brand")
    return designs.design_matrix(rows, Space((Fixed("p_size"),), (Constraint("p_size >= 0"),)), "p_partkey")


@_query("SELECT p_partkey, unnest([0, 1, 2, 3])::integer AS replicate_index FROM part")
def replicates(spark, sf):
    return designs.replicate(_t(spark, sf, "part").select("p_partkey"), 4)


@_query("""WITH v AS (SELECT event_id, hour(ts) AS hour, round(value, 6) AS value FROM events), m AS (SELECT *, median(value) OVER (PARTITION BY hour) AS m FROM v)
SELECT event_id, hour, value, round(m, 6) AS median, value < m AS prune FROM m""")
def median_prune(spark, sf):
    e = _t(spark, sf, "events").select("event_id", F.hour("ts").cast("long").alias("hour"), F.round("value", 6).alias("value"))
    return designs.median_prune(e, "value", "hour", "event_id").withColumn("median", F.round("median", 6))


@_query(f"""WITH RECURSIVE {WIDE}, w AS (SELECT user_id, quality, latency, clicks FROM wide WHERE quality IS NOT NULL AND latency IS NOT NULL AND clicks IS NOT NULL),
p AS (SELECT DISTINCT -quality AS a, latency AS b, -clicks AS c FROM w),
chain AS (SELECT a, b, c, 0 AS rank FROM p UNION SELECT q.a, q.b, q.c, rank + 1 FROM chain h JOIN p q ON h.a <= q.a AND h.b <= q.b AND h.c <= q.c AND (h.a < q.a OR h.b < q.b OR h.c < q.c)),
r AS (SELECT a, b, c, max(rank)::bigint AS rank FROM chain GROUP BY a, b, c),
u AS (SELECT user_id, quality, latency, clicks, rank FROM w JOIN r ON r.a = -quality AND r.b = latency AND r.c = -clicks),
n AS (SELECT *, lag(quality) OVER q AS q0, lead(quality) OVER q AS q1, lag(latency) OVER l AS l0, lead(latency) OVER l AS l1, lag(clicks) OVER c AS c0, lead(clicks) OVER c AS c1,
 max(quality) OVER f - min(quality) OVER f AS dq, max(latency) OVER f - min(latency) OVER f AS dl, max(clicks) OVER f - min(clicks) OVER f AS dc FROM u
 WINDOW f AS (PARTITION BY rank), q AS (PARTITION BY rank ORDER BY quality, user_id), l AS (PARTITION BY rank ORDER BY latency, user_id), c AS (PARTITION BY rank ORDER BY clicks, user_id))
SELECT user_id, rank, CASE WHEN q0 IS NOT NULL AND q1 IS NOT NULL AND l0 IS NOT NULL AND l1 IS NOT NULL AND c0 IS NOT NULL AND c1 IS NOT NULL
 THEN round(coalesce((q1 - q0) / nullif(dq, 0), 0) + coalesce((l1 - l0) / nullif(dl, 0), 0) + coalesce((c1 - c0) / nullif(dc, 0), 0), 6) END AS crowding FROM n""")
def nondominated_ranks(spark, sf):
    """Every user's front and how lonely they are in it; null at a front's ends, where that is infinite."""
    aims = {"quality": "maximize", "latency": "minimize", "clicks": "maximize"}
    ranked = evolution.nondominated_ranks(_wide(spark, sf), aims, block=512)
    out = evolution.crowding_distances(ranked, aims, "user_id")
    return out.select("user_id", "rank", F.when(F.col("crowding") < float("inf"), F.round("crowding", 6)).alias("crowding"))


# -- dataflow -----------------------------------------------------------------------------------------------


def _runs(spark, sf):
    """A run per order: its line items' quantities, in order."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    i = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(rows.alias("r"))
    return i.select("run_id", F.transform("r", lambda x: x["l_quantity"]).alias("values"))


RUNS = "runs AS (SELECT l_orderkey AS run_id, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS vals FROM lineitem GROUP BY l_orderkey)"


@_query(f"WITH {RUNS} SELECT run_id, round(list_sum(vals) * 2.5::double / len(vals), 6) AS value FROM runs")
def pipeline_scale_mean(spark, sf):
    p = dag.Pipeline("scale-mean").then(dag.scale(2.5)).then(dag.mean())
    return p.run(_runs(spark, sf))["mean"].withColumn("value", F.round("value", 6))


@_query(f"WITH {RUNS} SELECT run_id, list_transform(vals, lambda x: x * 2.0::double) AS values FROM runs")
def map_scale(spark, sf):
    """A mapped block: every item on its own, then back in order."""
    doubled = dag.Block("double", lambda df: df.withColumn("values", reductions.scaled(F.col("values"), 2.0)), dag.schema("values array<double> not null"), dag.schema("values array<double>"))
    p = dag.Pipeline("mapped").add("double", doubled, map_over="values")
    return p.run(_runs(spark, sf))["double"]


@_query("SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS flags, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity) AS quantities FROM lineitem GROUP BY l_orderkey")
def ordered_fan_in(spark, sf):
    i = _t(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity").alias("at"), F.col("l_returnflag").alias("flags"), F.array("l_quantity").alias("quantities"))
    out = reductions.fan_in(i, ["l_orderkey"], "at", ["quantities"], ["flags"])
    return out.select("l_orderkey", F.concat_ws("", "flags").alias("flags"), "quantities")


@_query("""SELECT o_orderkey AS run_id, coalesce(sum(l_quantity), 0) AS quantity, o_totalprice AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice""")
def fan_in_join(spark, sf):
    """Two branches of a graph meet in one block, by run."""
    make = dag.Block
    total = make("total", lambda df: df.select("run_id", F.aggregate("values", F.lit(0.0), lambda a, b: a + b).alias("quantity")), dag.schema("values array<double>"), dag.schema("quantity double"))
    price = make("price", lambda df: df.select("run_id", "price"), dag.schema("price double"), dag.schema("price double"))
    both = make("both", lambda df: df, dag.schema("quantity double not null, price double not null"), dag.schema("quantity double, price double"))
    p = dag.Pipeline("fan-in").add("total", total).add("price", price).add("both", both, depends_on=("total", "price"))
    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("price"))
    return p.run(_runs(spark, sf).join(orders, "run_id"))["both"]


@_query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
 round((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / count(*), 2) AS mse FROM lineitem GROUP BY l_returnflag""")
def regression_fit(spark, sf):
    out = reductions.line_fit(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("mse", 2).alias("mse"))


@_query("SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def standardize(spark, sf):
    out = reductions.standardize(_t(spark, sf, "events"), "value", ["event_type"])
    return out.select("event_id", F.round("z", 6).alias("z"))


@_query(f"WITH {RUNS} SELECT run_id, list_transform(vals, lambda x: round(x - list_sum(vals) / len(vals), 6)) AS centred FROM runs")
def centered_filter(spark, sf):
    return _runs(spark, sf).select("run_id", F.transform(reductions.centred(F.col("values")), lambda x: F.round(x, 6)).alias("centred"))


@_query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(avg((value <= 100)::int), 6) AS rate FROM events GROUP BY event_type")
def metric_rates(spark, sf):
    out = reductions.rates(_t(spark, sf, "events"), "value", 100.0, ["event_type"])
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "std", "rate")))


@_query("SELECT floor(l_quantity / 5)::bigint AS bin, round(sum(l_discount) / count(*), 9) AS profile FROM lineitem GROUP BY 1")
def weighted_profile(spark, sf):
    out = reductions.profile(_t(spark, sf, "lineitem"), F.floor(F.col("l_quantity") / 5), "l_discount")
    return out.withColumn("profile", F.round("profile", 9))


@_query(f"""WITH {RUNS} SELECT run_id, list_min(list_transform(vals, lambda x: abs(x - 25))) AS nearest, list_slice(list_sort(list_distinct(vals)), 1, 3) AS firsts,
 (list_position(vals, list_max(vals)) - 1)::bigint AS top FROM runs""")
def array_selection(spark, sf):
    v = F.col("values")
    return _runs(spark, sf).select("run_id", reductions.nearest_error(v, F.lit(25.0)).alias("nearest"), reductions.distinct_sorted(v, 3).alias("firsts"), reductions.argmax(v).alias("top"))


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity + 1 AS x, l_extendedprice - 1 AS y FROM lineitem")
def translated_points(spark, sf):
    i = _t(spark, sf, "lineitem")
    point = F.array(F.struct(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return i.select(*keys, reductions.translated(point)[0].alias("p")).select(*keys, "p.x", "p.y")


SERIES = "series AS (SELECT user_id, list(value ORDER BY event_id) AS vals FROM events GROUP BY user_id HAVING count(*) >= 21)"


@_query(f"""WITH {SERIES}, s AS (SELECT user_id, list_slice(vals, 5, 21) AS part FROM series), t AS (SELECT *, list_position(part, list_max(part)) AS top FROM s),
m AS (SELECT *, [CASE WHEN i < top OR i > top + 3 THEN part[i] END FOR i IN range(1, 18)] AS rest FROM t)
SELECT user_id, (top + 3)::bigint AS peak, (list_position(rest, list_max(rest)) + 3)::bigint AS second FROM m""")
def second_peak(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    v = F.transform("r", lambda x: x["value"])
    s = _t(spark, sf, "events").groupBy("user_id").agg(rows.alias("r")).where(F.size("r") >= 21).select("user_id", v.alias("v"))
    return s.select("user_id", reductions.argmax(F.col("v"), 4, 20).alias("peak"), reductions.second_argmax(F.col("v"), 4, 20).alias("second"))


@_query("SELECT b.range::bigint AS bin, coalesce(round(sum(l_discount) / count(l_discount), 9), 0.0::double) AS profile FROM range(20) b LEFT JOIN lineitem ON floor(l_quantity / 5) = b.range GROUP BY b.range")
def padded_profile(spark, sf):
    out = reductions.profile(_t(spark, sf, "lineitem"), F.floor(F.col("l_quantity") / 5), "l_discount", 20)
    return out.withColumn("profile", F.round("profile", 9))


@_query(f"WITH {RUNS} SELECT run_id, list_sum(list_transform(vals, lambda x: x * x)) AS total FROM runs")
def mapped_reduce(spark, sf):
    """A reducer behind a mapped block."""
    items = reductions.fan_out(_runs(spark, sf), "values").withColumn("square", F.col("values")[0] * F.col("values")[0])
    return reductions.reduced(items, ["run_id"], "partition_id", F.lit(0.0), lambda s, x: s + x, "square", "total")


@_query("""WITH x AS (SELECT l_returnflag AS flag, l_quantity AS q, row_number() OVER w AS k, CASE WHEN l_quantity < lag(l_quantity) OVER w THEN 1 ELSE 0 END AS falls
 FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey * 8 + l_linenumber, l_quantity)),
y AS (SELECT flag, sum(falls) OVER (PARTITION BY flag ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM x), z AS (SELECT flag, count(*) AS n FROM y GROUP BY flag, run)
SELECT flag, max(n) AS longest FROM z GROUP BY flag""")
def tree_reduce(spark, sf):
    """A reducer whose states are merged in a tree: three keys hold all rows."""
    rows = _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"), "l_quantity")
    return reductions.tree_reduced(rows, ["flag"], "at", reductions.longest_run(), "l_quantity", "longest")


@_query("SELECT p_partkey, p_brand || ':' || p_type AS label, repeat(p_brand, 2) AS twice FROM part")
def text_expressions(spark, sf):
    names = ["p_brand", "p_type"]
    made = {"label": "p_brand + ':' + p_type", "twice": "p_brand * 2"}
    return _t(spark, sf, "part").select("p_partkey", *(compile_expression(e, names, texts=("p_brand", "p_type")).alias(k) for k, e in made.items()))


# -- state, cache, lineage ----------------------------------------------------------------------------------


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_pending(spark, sf):
    done = _t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return runstore.pending(_t(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_reused(spark, sf):
    done = _t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return runstore.reused(_t(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


@_query("""WITH a AS (SELECT sha256(source || ':' || lang) AS cache_key, max_by(sha256(text), doc_id) AS content_hash FROM documents WHERE n_chars > 2000 GROUP BY 1)
SELECT d.doc_id, a.content_hash FROM documents d LEFT JOIN a ON a.cache_key = sha256(d.source || ':' || d.lang)""")
def cache_hits(spark, sf):
    d = _t(spark, sf, "documents").withColumn("cache_key", canonical.content_hash(F.concat_ws(":", "source", "lang")))
    known = d.where("n_chars > 2000").select("cache_key", canonical.content_hash("text").alias("content_hash"), F.col("doc_id").alias("created_at"))
    return runstore.cache_hits(d.select("doc_id", "cache_key"), known).select("doc_id", "content_hash")


@_query("SELECT sha256(text) AS content_hash, min(doc_id) AS first, count(*) AS copies, max(octet_length(encode(text)))::bigint AS size FROM documents GROUP BY 1")
def content_dedup(spark, sf):
    return store.deduplicated(_t(spark, sf, "documents"), "text", "doc_id")


@_query("SELECT CASE WHEN n_chars % 7 = 0 THEN 'missing' WHEN n_chars % 5 = 0 THEN 'corrupt' ELSE 'verified' END AS status, count(DISTINCT sha256(text)) AS n FROM documents GROUP BY 1")
def artifact_verify(spark, sf):
    d = _t(spark, sf, "documents").select("text", "n_chars").distinct().withColumn("content_hash", canonical.content_hash("text"))
    objects = d.where("n_chars % 7 <> 0").select("content_hash", F.when(F.col("n_chars") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("payload"))
    return store.verified(d.select("content_hash"), objects).groupBy("status").agg(F.count("*").alias("n"))


def _tree(spark, sf):
    n = _t(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("run_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    c = _t(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("run_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"))
    return n.unionByName(c)


TREE = """tree AS (SELECT 'n' || n_nationkey AS run_id, 'r' || n_regionkey AS parent_id FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
below AS (SELECT run_id, 1 AS depth FROM tree WHERE parent_id = 'r1' UNION ALL SELECT t.run_id, depth + 1 FROM tree t JOIN below b ON t.parent_id = b.run_id)"""


@_query(f"WITH RECURSIVE {TREE} SELECT run_id, depth FROM below")
def descendants(spark, sf):
    return runstore.descendants(_tree(spark, sf), "r1")


@_query(f"WITH RECURSIVE {TREE} SELECT 'c' || o_custkey AS run_id, o_orderkey FROM orders WHERE 'c' || o_custkey IN (SELECT run_id FROM below)")
def artifacts_under(spark, sf):
    files = _t(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("run_id"), "o_orderkey")
    return runstore.artifacts_under(_tree(spark, sf), files, "r1")


STATES = ("planned", "queued", "running", "completed", "failed")


def _history(spark, sf):
    at = F.pmod(F.col("event_id") * 7 + F.length("event_type"), F.lit(len(STATES)))
    state = F.element_at(F.array(*map(F.lit, STATES)), (at + 1).cast("int"))
    return _t(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("version"), state.alias("state"), F.lit(1).cast("long").alias("attempt"), "ts")


HISTORY = f"h AS (SELECT user_id AS run_id, event_id AS version, ({list(STATES)})[((event_id * 7 + length(event_type)) % 5)::int + 1] AS state, ts FROM events)"


@_query(f"WITH {HISTORY} SELECT run_id, max_by(state, version) AS state, max(version) AS version FROM h GROUP BY run_id")
def run_state(spark, sf):
    return runstore.current_states(_history(spark, sf)).select("run_id", "state", "version")


@_query(f"WITH {HISTORY}, m AS (SELECT lag(state) OVER (PARTITION BY run_id ORDER BY version) AS previous, state AS next FROM h) SELECT previous, next, count(*) AS n FROM m WHERE previous IS NOT NULL GROUP BY previous, next")
def transition_counts(spark, sf):
    return runstore.transition_counts(_history(spark, sf))


@_query(
    f"WITH {HISTORY}, m AS (SELECT run_id, version, lag(state) OVER (PARTITION BY run_id ORDER BY version) AS previous, state AS next FROM h) "
    + "SELECT * FROM m WHERE previous IS NOT NULL AND previous <> next AND (previous, next) NOT IN ("
    + ", ".join(f"('{a}', '{b}')" for a, bs in runstore.FOLLOWS.items() for b in bs)
    + ")"
)
def illegal_transitions(spark, sf):
    return runstore.illegal_transitions(_history(spark, sf))


@_query(f"WITH {HISTORY}, l AS (SELECT run_id, max_by(state, version) AS state, max_by(ts, version) + INTERVAL 1 HOUR AS expires_at FROM h GROUP BY run_id) SELECT run_id, 'w' || (run_id % 7) AS owner, expires_at FROM l WHERE state = 'running' AND expires_at < (SELECT min(ts) + INTERVAL 29 DAY FROM events)")
def stale_leases(spark, sf):
    at = _t(spark, sf, "events").agg(F.min("ts") + F.expr("INTERVAL 29 DAYS")).first()[0]
    h = _history(spark, sf).withColumn("owner", F.concat(F.lit("w"), F.col("run_id") % 7)).withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    return runstore.stale_leases(h, at)


@_query("SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS text FROM conversations GROUP BY conv_id")
def latest_checkpoint(spark, sf):
    return runstore.latest_checkpoint(_t(spark, sf, "conversations"), "conv_id", "turn", ("text",))


@_query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::integer AS sequence FROM conversations")
def checkpoint_sequence(spark, sf):
    return runstore.checkpoint_sequence(_t(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn")


ROW = ["l_discount", "l_extendedprice", "l_linenumber", "l_linestatus", "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_suppkey", "l_tax"]


@_query("SELECT sha256(to_json({" + ", ".join(f"'{c}': {c}" for c in ROW) + ", 'planner': 'matrix'})::varchar) AS fingerprint FROM lineitem")
def row_fingerprints(spark, sf):
    return _t(spark, sf, "lineitem").select(canonical.row_fingerprint(ROW, {"planner": "matrix"}).alias("fingerprint"))


@_query("""WITH p AS (SELECT p_partkey, ['', '', '', sha256(p_brand), '', p_type, '', p_size::varchar, ''] AS t FROM part)
SELECT p_partkey, sha256(list_aggregate(list_transform(t, lambda x: strlen(x)::varchar || ':' || x), 'string_agg', '')) AS key FROM p""")
def cache_keys(spark, sf):
    parts = dict.fromkeys(canonical.KEY_PARTS, F.lit(None)) | {"environment": canonical.content_hash("p_brand"), "model": F.col("p_type"), "seed": F.col("p_size")}
    return _t(spark, sf, "part").select("p_partkey", canonical.cache_key(parts).alias("key"))


@_query(f"WITH {HISTORY} SELECT run_id, count(*) FILTER (WHERE state = 'running') AS attempts FROM h GROUP BY run_id")
def run_attempts(spark, sf):
    return runstore.attempts(_history(spark, sf))


@_query("SELECT user_id AS run_id, event_id // 3 AS version, count(*) AS writers FROM events GROUP BY ALL HAVING count(*) > 1")
def version_conflicts(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.floor(F.col("event_id") / 3).alias("version"), F.lit("running").alias("state"))
    return runstore.conflicts(e)


@_query("""WITH RECURSIVE q AS (SELECT user_id AS run_id, event_type AS owner, ts AS asked, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS k FROM events),
g AS (SELECT run_id, owner, asked, k, true AS granted, owner AS holder, asked + INTERVAL 2 DAY AS expires FROM q WHERE k = 1
 UNION ALL SELECT q.run_id, q.owner, q.asked, q.k, g.expires <= q.asked OR g.holder = q.owner, CASE WHEN g.expires <= q.asked THEN q.owner ELSE g.holder END, CASE WHEN g.expires <= q.asked THEN q.asked + INTERVAL 2 DAY ELSE g.expires END FROM g JOIN q ON q.run_id = g.run_id AND q.k = g.k + 1)
SELECT run_id, owner, asked, granted FROM g""")
def lease_grant(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("owner"), F.col("ts").alias("asked"))
    return runstore.lease_grants(e, 2 * 86400, at="asked")


@_query("""SELECT 'user:' || user_id AS logical_key, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') = 0 THEN 'queued' WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'failed' ELSE 'stale' END AS state,
 CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') = 0 THEN 1 WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 3 ELSE 4 END::bigint AS version FROM events GROUP BY user_id""")
def store_replay(spark, sf):
    """Users as runs of a store that is written, moved on in bulk, compacted and read back: buyers run, errors fail, the rest end and go stale."""
    e = _t(spark, sf, "events").select(F.concat(F.lit("user:"), "user_id").alias("logical_key"), "event_type")
    store = runstore.RunStore(spark, fresh_path(spark, "store"))
    runs = store.create_runs(e.select("logical_key", F.lit("user").alias("kind"), F.lit(None).cast("string").alias("parent_id")).distinct())
    ids = e.select(F.sha2("logical_key", 256).alias("run_id"), "event_type")
    store.transition_all(runs.select("run_id"), "queued")
    store.transition_all(ids.where("event_type = 'purchase'").select("run_id").distinct(), "running")
    store.transition_all(ids.where("event_type = 'error'").select("run_id").distinct(), "failed")
    for state in ("completed", "stale"):
        store.transition_all(ids.select("run_id").distinct(), state)
    store.compact()
    return runstore.current_states(store.table("events")).join(store.table("runs"), "run_id").select("logical_key", "state", "version")


@_query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_totalprice >= 150000 AND o_orderpriority IS NOT NULL")
def database_orders(spark, sf):
    """Orders written to a database by tasks in short transactions, moved in one, and read back in ranges of keys with a pushed predicate."""
    database.register(spark)
    path = fresh_path(spark, "orders").removeprefix("file://")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    where = {"connect": "trialframe.sources.database:sqlite", "target": path, "table": "orders", "key": "o_orderkey", "partitions": "8", "unique": "o_orderkey"}
    orders.write.format("database").options(**where).mode("append").save()
    back = spark.read.format("database").options(**where).schema(orders.schema).load()
    return back.where("o_totalprice >= 150000 AND o_orderpriority IS NOT NULL")


@_query("""SELECT p_partkey, to_json(map_from_entries(list_sort(map_entries(map_concat(MAP {'brand': p_brand, 'size': p_size::varchar}, MAP {'size': (p_size + 1)::varchar, 'type': p_type})))))::varchar AS merged FROM part""")
def merged_maps(spark, sf):
    """Two maps of each part merged, the right one's values winning."""
    text = lambda c: F.col(c).cast("string")
    left = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), text("p_size"))
    right = F.create_map(F.lit("size"), (F.col("p_size") + 1).cast("string"), F.lit("type"), F.col("p_type"))
    both = F.array_sort(F.map_entries(reductions.merged(left, right)))
    return _t(spark, sf, "part").select("p_partkey", F.to_json(F.map_from_entries(both)).alias("merged"))


@_query("""WITH i AS (SELECT DISTINCT l_orderkey AS run_id, l_linenumber AS partition_id FROM lineitem),
a AS (SELECT DISTINCT l_orderkey AS run_id, l_linenumber AS partition_id FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 5 <> 0)
SELECT i.run_id, i.partition_id, a.run_id IS NOT NULL AS reused FROM i LEFT JOIN a USING (run_id, partition_id)""")
def partition_resume(spark, sf):
    i = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("partition_id"), "l_returnflag", "l_suppkey")
    files = i.where("l_returnflag = 'R'").withColumn("whole", F.col("l_suppkey") % 5 != 0)
    return runstore.partition_status(i.select("run_id", "partition_id").distinct(), files, ["run_id", "partition_id"])


@_query(f"WITH RECURSIVE {TREE} SELECT 'run' AS kind, 1 + 0 * count(*) AS depth, count(*) AS n FROM below WHERE depth = 1 UNION ALL SELECT 'run', 2, count(*) FROM below WHERE depth = 2 UNION ALL SELECT 'artifact', NULL, count(*) FROM orders WHERE 'c' || o_custkey IN (SELECT run_id FROM below)")
def export_documents(spark, sf):
    """What an export of a subtree holds, read back from its documents."""
    files = _t(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("run_id"), "o_orderkey")
    lines = exchange.export_tree(_tree(spark, sf), files, "r1")
    return lines.groupBy("kind", F.get_json_object("document", "$.depth").cast("bigint").alias("depth")).agg(F.count("*").alias("n"))


# -- exchange and extensions --------------------------------------------------------------------------------


@_query("SELECT event_id, left(json_extract_string(props, '$.k'), 500) AS k, json_extract_string(props, '$.n.a') AS \"n.a\", left(json_extract_string(props, '$.n.b'), 500) AS \"n.b\" FROM events")
def flatten_params(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "props")
    return reductions.flatten_json(e, "props", "k string, n struct<a: double, b: string>")


@_query("SELECT doc_id::varchar AS run_id, 'param' AS kind, 'lang' AS name, lang AS value FROM documents UNION ALL SELECT doc_id::varchar, 'param', 'at.source', source FROM documents UNION ALL SELECT doc_id::varchar, 'param', 'at.text', left(text, 500) FROM documents UNION ALL SELECT doc_id::varchar, 'metric', 'quality', (quality::double)::varchar FROM labels")
def tracking_records(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("run_id"), "lang", F.struct("source", "text").alias("at"))
    m = _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("run_id"), F.lit("quality").alias("name"), F.col("quality").cast("double").alias("scalar"), F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("string").alias("artifact"))
    return exchange.tracking_records(m, d).drop("step")


@_query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2")
def metric_hourly(spark, sf):
    out = streams.windowed(_t(spark, sf, "events"), "ts", "event_type", "value")
    return out.withColumn("mean", F.round("mean", 6))


@_query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, session""")
def metric_sessions(spark, sf):
    return streams.sessions(_t(spark, sf, "events"), "ts", "user_id", "6 hours")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Which trials are best: the last metrics of each, the feasible ones, the top by quality."""
    return best_feasible(spark, sf)

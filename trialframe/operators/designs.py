"""Designs of experiments as DataFrames: a row per trial, generated where it is used.

Row indices come from ``spark.range``; unit coordinates are column expressions of the index, so a
design of any size is a narrow, shuffle-free plan. Only taking the first n valid rows orders.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialframe.errors import PlanError
from trialframe.functions.canonical import row_fingerprint
from trialframe.functions.expressions import named
from trialframe.operators.ordering import numbered
from trialframe.scratch import materialize
from trialframe.plans.space import Parameter, Space, resolve, unit_column, violation

#: Primitive polynomials and initial numbers by Joe and Kuo (fixed values): degree, coefficients, m.
SOBOL = (
    (1, 0, (1,)),
    (2, 1, (1, 3)),
    (3, 1, (1, 3, 1)),
    (3, 2, (1, 1, 1)),
    (4, 1, (1, 1, 3, 3)),
    (4, 4, (1, 3, 5, 13)),
    (5, 2, (1, 1, 5, 5, 17)),
    (5, 4, (1, 1, 5, 5, 5)),
    (5, 7, (1, 1, 7, 11, 19)),
    (5, 11, (1, 1, 5, 1, 1)),
    (5, 13, (1, 1, 1, 3, 11)),
    (5, 14, (1, 3, 5, 5, 31)),
    (6, 1, (1, 3, 3, 9, 7, 49)),
    (6, 13, (1, 1, 1, 15, 21, 21)),
    (6, 16, (1, 3, 1, 13, 27, 49)),
    (6, 19, (1, 1, 1, 15, 7, 5)),
    (6, 22, (1, 3, 1, 15, 13, 25)),
    (6, 25, (1, 1, 5, 5, 19, 61)),
    (7, 1, (1, 3, 7, 11, 23, 15, 103)),
    (7, 4, (1, 3, 7, 13, 13, 15, 69)),
)
BITS = 30


@dataclass(frozen=True)
class Request:
    """How many trials, from which seed, under which versions, and how often each is repeated."""

    n: int
    seed: int = 0
    replicates: int = 1
    pipeline_version: str = "1"
    dataset_version: str = "1"
    allow_fewer: bool = False


def _primitive(degree: int, inner: int) -> bool:
    """Whether x**degree + inner coefficients + 1 is primitive over GF(2): the powers of x run through all remainders."""
    polynomial, power, order = (1 << degree) | (inner << 1) | 1, 1, 0
    while True:
        power <<= 1
        if power >> degree:
            power ^= polynomial
        order += 1
        if power == 1:
            return order == (1 << degree) - 1


@functools.cache
def _polynomials(n: int) -> tuple[tuple[int, int], ...]:
    """The first n (degree, inner coefficients) of the primitive polynomials, by degree and coefficients."""
    out: list[tuple[int, int]] = []
    degree = 1
    while len(out) < n:
        out += [(degree, inner) for inner in range(1 << (degree - 1)) if _primitive(degree, inner)]
        degree += 1
    return tuple(out[:n])


def read_directions(path: str) -> tuple[tuple[int, int, tuple[int, ...]], ...]:
    """Polynomials and initial numbers from a file in the published form: a heading, then lines of d, s, a and the m's."""
    with open(path) as f:
        rows = [list(map(int, line.split())) for line in f.readlines()[1:] if line.strip()]
    return tuple((x[1], x[2], tuple(x[3:])) for x in sorted(rows))


#: Initial numbers that are tried for a dimension beyond the table, and points (as a power of 2) that they are judged by.
TRIED, JUDGED = 24, 8


@functools.cache
def _start(dimension: int) -> tuple[int, int, tuple[int, ...]]:
    """Degree, coefficients and initial numbers. Beyond the table they are the best of ``TRIED`` by their worst pair with an earlier dimension."""
    if dimension <= len(SOBOL):
        return SOBOL[dimension - 1]
    degree, a = _polynomials(dimension)[dimension - 1]
    odd = lambda k, turn: int.from_bytes(hashlib.sha256(b"%d %d %d" % (dimension, k, turn)).digest()[:8], "big") % (1 << (k + 1)) | 1
    earlier = [_leading(direction_numbers(d)) for d in range(dimension)]

    def loss(m: tuple[int, ...]) -> tuple[int, int]:
        own = _leading(_directions(degree, a, m))
        worst = [_defect(own, other) for other in earlier]
        return max(worst), sum(worst)

    return degree, a, min((tuple(odd(k, turn) for k in range(degree)) for turn in range(TRIED)), key=loss)


def _leading(numbers: list[int]) -> list[int]:
    """Rows of the generator matrix of the first 2**JUDGED points: bit c of row r is bit r (from the top) of number c."""
    return [sum((numbers[c] >> (BITS - 1 - r) & 1) << c for c in range(JUDGED)) for r in range(JUDGED)]


def _defect(a: list[int], b: list[int]) -> int:
    """How far a pair of dimensions is from the finest nets: 0 if every split of JUDGED bits gives independent rows."""
    out = 0
    for first in range(JUDGED + 1):
        basis: dict[int, int] = {}
        for count, row in enumerate([*a[:first], *b[: JUDGED - first]]):
            while row and (top := row.bit_length()) in basis:
                row ^= basis[top]
            if not row:
                out = max(out, JUDGED - count)
                break
            basis[row.bit_length()] = row
    return out


def _directions(degree: int, a: int, m: tuple[int, ...]) -> list[int]:
    v = [m[k] << (BITS - 1 - k) for k in range(degree)]
    for k in range(degree, BITS):
        x = v[k - degree] ^ (v[k - degree] >> degree)
        for j in range(1, degree):
            if a >> (degree - 1 - j) & 1:
                x ^= v[k - j]
        v.append(x)
    return v


@functools.cache
def _published(path: str) -> tuple[tuple[int, int, tuple[int, ...]], ...]:
    return read_directions(path)


def direction_numbers(dimension: int, table: str | None = None) -> list[int]:
    """``BITS`` direction numbers of a Sobol dimension, counted from 0; ``table`` names a file in the published form."""
    if dimension == 0:
        return [1 << (BITS - 1 - k) for k in range(BITS)]
    if table is not None:
        known = _published(table)
        if dimension > len(known):
            raise PlanError(f"{table} has {len(known) + 1} dimensions, not {dimension + 1}")
        return _directions(*known[dimension - 1])
    return _directions(*_start(dimension))


def _sobol_bits(index: Column, numbers: list[int], shift: int = 0) -> Column:
    gray = index.bitwiseXOR(F.shiftright(index, 1))
    out = F.lit(shift).cast("long")
    for k, v in enumerate(numbers):
        out = out.bitwiseXOR(F.shiftright(gray, k).bitwiseAND(F.lit(1).cast("long")) * F.lit(v).cast("long"))
    return out


def sobol_unit(index: Column, dimension: int, shift: int = 0, table: str | None = None) -> Column:
    """Coordinate of the index-th point in Gray-code order, optionally with a digital shift."""
    return _sobol_bits(index, direction_numbers(dimension, table), shift) / F.lit(float(1 << BITS))


def owen_unit(index: Column, dimension: int, seed: int, table: str | None = None) -> Column:
    """The same coordinate under nested uniform scrambling: each bit is flipped by a hash of the seed and all bits above it.

    Points that share a dyadic interval go on sharing one, so a net stays a net; below ``BITS`` bits the rest is uniform.
    """
    bits = _sobol_bits(index, direction_numbers(dimension, table))

    shifted = lambda direction, x, by: F.call_function(direction, x, by)

    def flipped(x: Column) -> Column:
        def flip(out: Column, k: Column) -> Column:
            above = shifted("shiftright", x, F.lit(BITS) - k)
            coin = F.xxhash64(F.lit(seed), F.lit(dimension), k, above).bitwiseAND(F.lit(1).cast("long"))
            return out.bitwiseXOR(shifted("shiftleft", coin, F.lit(BITS - 1) - k))

        return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), x, flip)

    # through an array of one, so that the point's bits are worked out once and not for every flip
    whole = F.transform(F.array(bits), flipped)[0]
    return (whole + hash_unit(F.lit(seed), F.lit(dimension), F.lit("rest"), index)) / F.lit(float(1 << BITS))


def primes(n: int) -> list[int]:
    out: list[int] = []
    k = 2
    while len(out) < n:
        if all(k % p for p in out):
            out.append(k)
        k += 1
    return out


def halton_unit(index: Column, base: int, shift: float = 0.0) -> Column:
    """Radical inverse of the index, optionally rotated by ``shift`` modulo 1."""
    out, power = F.lit(0.0), 1
    while power < 2**40:  # digits of indices up to 2**40, each on its own
        digit = F.pmod(F.floor(index / F.lit(float(power))), F.lit(base))
        power *= base
        out = out + digit / F.lit(float(power))
    return out if not shift else F.pmod(out + F.lit(shift), F.lit(1.0))


def hash_unit(*parts: Column) -> Column:
    """A uniform number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(2**53))


def _indexed(spark: SparkSession, n: int, rows: DataFrame | None = None) -> DataFrame:
    """The rows of a design: ``n`` numbers, or the rows of a table that has its own in ``row_index``."""
    return spark.range(n).withColumnRenamed("id", "row_index") if rows is None else rows


def random_units(spark: SparkSession, space: Space, n: int, seed: int, rows: DataFrame | None = None) -> DataFrame:
    """Independent uniform numbers; row i of a longer design is row i of a shorter one."""
    df = _indexed(spark, n, rows)
    return df.select("*", *(hash_unit(F.lit(seed), F.lit(j), F.col("row_index")).alias(unit_column(p)) for j, p in enumerate(space.sampled)))


def numpy_units(spark: SparkSession, space: Space, n: int, seed: int, rows: DataFrame | None = None) -> DataFrame:
    """The draws of ``numpy.random.default_rng(seed).random((n, d))``, each run of neighbouring rows drawn where it is needed."""
    import numpy as np
    import pandas as pd

    names = [unit_column(p) for p in space.sampled]
    d = len(names)

    def draw(batches):
        for batch in batches:
            at = batch["row_index"].to_numpy()
            for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                if not len(run):
                    continue
                generator = np.random.PCG64(seed)
                generator.advance(int(at[run[0]]) * d)
                values = np.random.Generator(generator).random((len(run), d))
                yield pd.DataFrame({"row_index": at[run]} | {c: values[:, j] for j, c in enumerate(names)})

    drawn = _indexed(spark, n, rows).select("row_index").mapInPandas(draw, ", ".join(["row_index long", *(f"`{c}` double" for c in names)]))
    return drawn if rows is None or rows.columns == ["row_index"] else rows.join(drawn, "row_index")


def grid_counts(space: Space, points: int | dict[str, int] = 3) -> list[int]:
    return [p.grid_points(points.get(p.name, 3) if isinstance(points, dict) else points) for p in space.sampled]


def grid_units(spark: SparkSession, space: Space, points: int | dict[str, int] = 3) -> DataFrame:
    """Midpoints of each axis in all combinations, the last axis running fastest: mixed-radix digits of the index."""
    counts = grid_counts(space, points)
    total = math.prod(counts)
    df, stride, columns = _indexed(spark, total), total, []
    for p, c in zip(space.sampled, counts, strict=True):
        stride //= c
        digit = F.pmod(F.floor(F.col("row_index") / stride), F.lit(c))
        columns.append(((digit + 0.5) / float(c)).alias(unit_column(p)))
    return df.select("row_index", *columns)


def latin_units(spark: SparkSession, space: Space, n: int, seed: int, scramble: bool = True, rows: DataFrame | None = None) -> DataFrame:
    """One point in each of n strata per dimension: strata are dealt by a keyed permutation of the index.

    The permutation is a Feistel network over the index bits, walked until it falls below n, so no
    dimension has to be sorted.
    """
    df, columns = _indexed(spark, n, rows), []
    for j, p in enumerate(space.sampled):
        stratum = permutation(F.col("row_index"), n, F.lit(seed), F.lit(j))
        jitter = hash_unit(F.lit(seed), F.lit(j), F.lit("jitter"), F.col("row_index")) if scramble else F.lit(0.5)
        columns.append(((stratum + jitter) / float(n)).alias(unit_column(p)))
    return df.select("*", *columns)


def permutation(index: Column, n: int, *key: Column) -> Column:
    """A pseudo-random permutation of 0..n-1, as an expression of the index."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = F.lit((1 << half) - 1).cast("long")

    def shuffle(x: Column) -> Column:
        left, right = F.shiftright(x, half), x.bitwiseAND(mask)
        for turn in range(4):
            left, right = right, left.bitwiseXOR(F.xxhash64(*key, F.lit(turn), right).bitwiseAND(mask))
        return F.shiftleft(left, half).bitwiseOR(right)

    # cycle walking: the domain is less than 16 times n; what is still outside after the walk would repeat none
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(256)), shuffle(index.cast("long")), lambda x, _: F.when(x < n, x).otherwise(shuffle(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("permutation walk too long")).cast("long"))


def sobol_units(spark: SparkSession, space: Space, n: int, seed: int | None = None, scramble: str = "owen", table: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Sobol points, plain without a seed; with one under ``owen`` scrambling (nested, uniform) or a digital ``shift``."""
    import random

    if n > 1 << BITS:
        raise PlanError(f"Sobol designs have at most 2**{BITS} points, before they repeat")
    if scramble not in ("owen", "shift"):
        raise PlanError(f"unknown scrambling {scramble!r}")
    shifts, at = random.Random(seed), F.col("row_index")

    def unit(j: int) -> Column:
        if seed is None:
            return sobol_unit(at, j, 0, table)
        return owen_unit(at, j, seed, table) if scramble == "owen" else sobol_unit(at, j, shifts.getrandbits(BITS), table)

    return _indexed(spark, n, rows).select("*", *(unit(j).alias(unit_column(p)) for j, p in enumerate(space.sampled)))


def halton_units(spark: SparkSession, space: Space, n: int, seed: int | None = None, rows: DataFrame | None = None) -> DataFrame:
    import random

    shifts = random.Random(seed)
    columns = [halton_unit(F.col("row_index"), b, 0.0 if seed is None else shifts.random()).alias(unit_column(p)) for b, p in zip(primes(len(space.sampled)), space.sampled, strict=True)]
    return _indexed(spark, n, rows).select("*", *columns)


def replicate(df: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, numbered in ``replicate_index``."""
    return df.withColumn("replicate_index", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def trial_seed(seed: int) -> Column:
    """A 32-bit seed per row and replicate."""
    return F.xxhash64(F.lit(seed), F.col("row_index"), F.col("replicate_index")).bitwiseAND(F.lit(0xFFFFFFFF))


def trials(units: DataFrame, space: Space, request: Request, planner: str, generated: int | None = None) -> DataFrame:
    """Resolved trials: the first ``request.n`` valid rows in design order, replicated, seeded, fingerprinted.

    ``generated`` says that ``units`` has so many rows, numbered from 0 without gaps: without constraints the first ones are
    those of the least numbers then. Else valid rows are numbered in chunks of the design's order; no task takes them all.
    """
    resolved = resolve(units, space)
    if generated is not None and not space.constraints:
        n, first = generated, resolved.where(F.col("row_index") < request.n)
    else:
        n = request.n if request.allow_fewer else resolved.count()
        first = numbered(resolved, {"row_index": F.col("row_index")}, "__at").where(F.col("__at") < request.n).drop("__at")
    if n < request.n and not request.allow_fewer:
        raise PlanError(f"the design has {n} valid rows, fewer than the {request.n} asked for")
    return described(first, space, request, planner)


def described(rows: DataFrame, space: Space, request: Request, planner: str) -> DataFrame:
    """Rows of parameters (and ``row_index``) as trials."""
    out = replicate(rows, request.replicates).withColumn("seed", trial_seed(request.seed))
    parameters = [p.column for p in space.parameters]
    versions = {"planner": planner, "pipeline_version": request.pipeline_version, "dataset_version": request.dataset_version, "space_version": space.version}
    out = out.withColumn("fingerprint", row_fingerprint([*parameters, "seed", "replicate_index"], versions))
    fixed = [F.lit(v).alias(k) for k, v in versions.items()]
    return out.select(F.col("fingerprint").alias("trial_id"), "row_index", "replicate_index", "seed", *(named(p) for p in parameters), *fixed, "fingerprint")


#: Rows that are generated for every valid one asked for.
OVERSAMPLE = {"random": 10, "latin": 1, "sobol": 4, "halton": 4}


def _units_planner(name: str, make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A planner: (spark, space, request, oversample, **options) to trials."""

    def plan(spark: SparkSession, space: Space, request: Request, oversample: int | None = None, **options) -> DataFrame:
        n = request.n * (oversample or OVERSAMPLE.get(name, 10))
        units = make(spark, space, n, request.seed, **options) if space.sampled else _indexed(spark, n)
        return trials(units, space, request, name, n)

    return plan


def _grid_planner(name: str) -> Callable[..., DataFrame]:
    def plan(spark: SparkSession, space: Space, request: Request, points: int | dict[str, int] = 3, **_) -> DataFrame:
        return trials(grid_units(spark, space, points), space, request, name, math.prod(grid_counts(space, points)))

    return plan


def _unscrambled(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    return lambda spark, space, n, seed, scramble=True, **options: make(spark, space, n, seed if scramble else None, **({"scramble": scramble} if isinstance(scramble, str) else {}), **options)


PLANNERS: dict[str, Callable[..., DataFrame]] = {
    "random": _units_planner("random", lambda spark, space, n, seed, **_: random_units(spark, space, n, seed)),
    "numpy": _units_planner("numpy", lambda spark, space, n, seed, **_: numpy_units(spark, space, n, seed)),
    "latin": _units_planner("latin", lambda spark, space, n, seed, scramble=True, **_: latin_units(spark, space, n, seed, scramble)),
    "sobol": _units_planner("sobol", _unscrambled(sobol_units)),
    "halton": _units_planner("halton", _unscrambled(halton_units)),
    "grid": _grid_planner("grid"),
    "factorial": _grid_planner("factorial"),
}


def propose(spark: SparkSession, space: Space, request: Request, planner: str | Callable[..., DataFrame] = "random", **options) -> DataFrame:
    """Trials of a named design, or of a planner of one's own: (spark, space, request) to rows of parameters, or to whole trials."""
    if isinstance(planner, str):
        if planner not in PLANNERS:
            raise PlanError(f"unknown planner {planner!r}")
        return PLANNERS[planner](spark, space, request, **options)
    rows = planner(spark, space, request, **options)
    if "trial_id" in rows.columns:
        return rows
    if "row_index" not in rows.columns:
        rows = rows.withColumn("row_index", F.monotonically_increasing_id())
    return described(rows, space, request, getattr(planner, "id", getattr(planner, "__name__", "planner")))


def design_matrix(rows: DataFrame, space: Space, order_by: str, n: int | None = None) -> DataFrame:
    """The user's own rows as trials, in the order of a column; rows that fail a constraint are an error."""
    if space.constraints:
        failed = rows.select(violation(space).alias("why")).where("why is not null").limit(1).collect()
        if failed:
            raise PlanError(failed[0].why)
    out = numbered(rows, {order_by: named(order_by)}, "row_index")
    if n is not None and rows.count() < n:
        raise PlanError(f"the matrix has fewer rows than the {n} asked for")
    return out if n is None else out.where(F.col("row_index") < n)


#: How far from the middle, as a share of a key's rows, exact medians are looked for; ten times what the sketch may be off.
AROUND, ACCURACY = 0.001, 10_000


def medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median), exact: a mergeable sketch of each key brackets its middle, then only what is in the bracket is ordered.

    The sketches are summed within tasks first, so a key may hold any share of the rows; equal values are one row from then on.
    """
    some = df.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("value"))
    ends = F.percentile_approx("value", [0.5 - AROUND, 0.5 + AROUND], ACCURACY)
    sketch = some.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n"), ends.alias("q"))
    sketch = sketch.select("k", "n", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    placed = some.join(sketch, F.col("key").eqNullSafe(F.col("k")))
    inside = F.when(F.col("value") >= F.col("low"), F.col("value"))  # null for all that is below
    counted = placed.where("value <= high").groupBy("k", "n", inside.alias("v")).agg(F.count("*").alias("c"))
    order = Window.partitionBy("k").orderBy(F.asc_nulls_first("v"))
    to = F.sum("c").over(order)
    middle = lambda at: (F.col("to") > at) & (F.col("to") - F.col("c") <= at)
    picked = counted.withColumn("to", to).where(middle(F.floor((F.col("n") - 1) / 2)) | middle(F.floor(F.col("n") / 2)))
    return picked.groupBy(F.col("k").alias(key)).agg(((F.min("v") + F.max("v")) / 2).alias("median"))


#: Medians that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def median_prune(metrics: DataFrame, value: str = "value", step: str = "step", trial: str = "trial_id", direction: str = "maximize") -> DataFrame:
    """Reports with ``prune``: whether a trial's value is worse than the median of its step."""
    worse = F.col(value) < F.col("median") if direction == "maximize" else F.col(value) > F.col("median")
    known = materialize(medians(metrics, step, value), "medians")
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    return metrics.join(known, step).select(trial, step, value, "median", worse.alias("prune"))


#: Bins that past trials' unit values are counted in, per dimension, and the kernel's width.
BINS, KERNEL = 256, 0.1


def suggest(spark: SparkSession, space: Space, request: Request, history: DataFrame | None, score: str = "score", candidates: int = 256, gamma: float = 0.25) -> DataFrame:
    """Ask/tell search: candidates near good past trials and far from bad ones (a Parzen-style ratio).

    ``history`` has the space's columns and ``score`` (larger is better). Without history the design is random. All past
    trials count: their unit values are counted in ``BINS`` bins of each dimension, so what the tasks are sent has a fixed size.
    """
    told = history.where(F.col(score).isNotNull()) if history is not None else None
    n = told.count() if told is not None else 0
    if not n:
        return propose(spark, space, request)
    dims: list[Parameter] = space.sampled
    cut = numbered(told, {"worse": -F.col(score).cast("double")}, "__at").where(F.col("__at") == math.floor(gamma * (n - 1))).first()[score]
    bin_ = lambda p: F.least(F.floor(p.to_unit(named(p.column)) * BINS), F.lit(BINS - 1)).cast("int")
    bins = F.explode(F.array(*(F.struct(F.lit(j).alias("dim"), bin_(p).alias("bin")) for j, p in enumerate(dims)))).alias("b")
    counted = told.select((F.col(score) >= F.lit(cut)).alias("good"), bins).where("b.bin is not null").groupBy("good", "b.dim", "b.bin").count().collect()

    def density(u: Column, good: bool, dim: int) -> Column:
        own = sorted((r.bin, r["count"]) for r in counted if (r.good, r.dim) == (good, dim))
        if not own:
            return F.lit(1.0)
        points = F.from_json(F.lit(json.dumps([{"at": (b + 0.5) / BINS, "n": c} for b, c in own])), "array<struct<at double, n double>>")
        total = F.aggregate(points, F.lit(0.0), lambda s, x: s + x["n"] * F.exp(-((u - x["at"]) ** 2) / F.lit(2 * KERNEL**2)))
        return total / sum(c for _, c in own) + F.lit(1e-6)

    units = random_units(spark, space, request.n * candidates, request.seed)
    ratio = F.lit(0.0)
    for j, p in enumerate(dims):
        u = F.col(f"`{unit_column(p)}`")
        ratio = ratio + F.log(density(u, True, j)) - F.log(density(u, False, j))
    best = units.withColumn("slot", F.floor(F.col("row_index") / candidates)).withColumn("ratio", ratio)
    best = best.groupBy("slot").agg(F.max_by(F.struct("row_index", *(f"`{unit_column(p)}`" for p in dims)), F.struct("ratio", "row_index")).alias("x")).select("x.*")
    return trials(best, space, request, "suggest")

"""Mixing sources to target weights by Pareto order sampling.

A document of weight w in a source is due c = target * w / (sum of w * size) copies on average.
floor(c) of them are certain; the fraction f is an inclusion probability. With u uniform from a
hash of the document, documents are ranked by q = (u/(1-u)) / (f/(1-f)), smallest first, and
taken until the source's remaining words are used up: a sample of fixed size in words. Where the
next document no longer fits, later ones in rank order that do fit fill the gap. What is then left
of the target is made up by exchanging single documents around the cut, while that comes nearer.

No source is sorted whole. Ranks are counted into slices, about ``SLICE`` documents each; slices
are summed with partial aggregation, and only the slice that holds the cut is put in order. If words
are left after it, the later documents that are no longer than these are summed and cut in the same
way, until nothing that is left fits.

Rows that are alike in all that the draw knows of them are numbered, and each number has its own draw.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.scratch import discard, materialize
from trialframe.operators.ordering import numbered, running

WORDS = r"[^\x20\x09-\x0D]+"
SLICE = 4096
#: Exchanges of documents at the cut of a source, at most.
EXCHANGES = 8
#: Longer documents that are tried in place of several.
NEAREST = 32
#: Sources and cut documents are broadcast up to so many rows (at 100 bytes: 20 MB); beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, pattern: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, source_size, ...)``, one row per source.

    Sources by code point, null last, have the weights of ``pattern`` in turn and share ``budget``
    times all sizes; a target stops at ``most`` times its source's size and the excess is reshared.
    The water level is found in one pass: with sources in order of cap/weight, the first k sources
    stop at their caps where the level (what is left / weights left) no longer exceeds cap/weight; later levels are lower.
    """
    by_name = {"none": F.col("source").isNull(), "source": F.col("source")}
    weights = F.array(*(F.lit(float(w)) for w in pattern))
    rows = numbered(sizes, by_name, "__turn")
    rows = rows.withColumn("__share", F.element_at(weights, (F.pmod("__turn", F.lit(len(pattern))) + 1).cast("int")))
    rows = rows.withColumn("__cap", F.col("source_size") * F.lit(float(most))).withColumn("__stop", F.col("__cap") / F.col("__share"))
    rows = materialize(rows, "sources")
    everything = rows.agg(F.sum("source_size").alias("size"), F.sum("__share").alias("share")).first()
    if everything["size"] is None:
        return rows.select(*sizes.columns, F.lit(0.0).alias("target"))
    by_stop = {"stop": F.col("__stop"), **by_name}
    levels = running(rows, by_stop, {"__caps": F.col("__cap"), "__shares": F.col("__share")})
    level = (F.lit(everything["size"] * budget) - F.col("__caps")) / (F.lit(everything["share"]) - F.col("__shares"))
    water = levels.agg(F.max(F.when(level <= F.col("__stop"), level))).first()[0]
    target = F.col("__cap") if water is None else F.least("__cap", F.lit(float(water)) * F.col("__share"))
    return rows.select(*sizes.columns, target.alias("target"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _same(*pairs: tuple[str, str]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Walk a slice in rank order and take what still fits; one more row, with ``left`` of 0 or more, has what is left."""
    rows = rows.sort_values(["z", "u"], kind="stable")
    left, size = float(rows["left"].iloc[0]), rows["words"].to_numpy(float)
    taken = np.zeros(len(rows), bool)
    for k, n in enumerate(size):
        if n <= left:
            taken[k], left = True, left - n
    out = rows.loc[taken, ["source", "slice", "u"]].assign(left=-1.0)
    return pd.concat([out, rows.iloc[[0]][["source", "slice", "u"]].assign(left=left)])


def exchanged(size: np.ndarray, taken: np.ndarray, left: float) -> np.ndarray:
    """``taken`` after additions and exchanges, each the one that leaves least of ``left`` over, while any helps.

    One document comes in for nothing, for one that goes, or for several of falling size.
    """
    taken = taken.copy()
    for _ in range(EXCHANGES):
        inside, outside = np.flatnonzero(taken), np.flatnonzero(~taken)
        if not len(outside) or abs(left) < 1:
            break
        outside = outside[np.argsort(size[outside], kind="stable")]
        given = np.r_[0.0, size[inside]]  # nothing, or one that is taken, goes for one that is not
        at = np.searchsorted(size[outside], given + left)
        moves = [(abs(left - (size[outside[j]] - given[i])), [int(outside[j])], [int(inside[i - 1])] if i else []) for i in range(len(given)) for j in {max(at[i] - 1, 0), min(at[i], len(outside) - 1)}]
        falling = inside[np.argsort(-size[inside], kind="stable")]
        first = np.searchsorted(size[outside], left)
        for j in outside[first : first + NEAREST]:
            over, gone = size[j] - left, []
            for i in falling:
                if 0 < size[i] <= over:
                    over -= size[i]
                    gone.append(int(i))
            moves.append((abs(over), [int(j)], gone))
        rest, new, gone = min(moves)
        if rest >= abs(left) - 0.5:
            break
        left -= size[new].sum() - size[gone].sum()
        taken[new], taken[gone] = True, False
    return taken


def _exchange(rows: pd.DataFrame) -> pd.DataFrame:
    """The documents of a source's cut slice that change sides: ``left`` of 1 goes in, of 0 goes out."""
    rows = rows.sort_values(["z", "u"], kind="stable")
    before = rows["taken"].to_numpy(bool)
    after = exchanged(rows["words"].to_numpy(float), before, float(rows["left"].iloc[0]))
    moved = rows.loc[before != after, ["source", "slice", "u"]]
    return moved.assign(left=np.where(after[before != after], 1.0, 0.0))


def mix(
    docs: DataFrame,
    size_col: str,
    source_col: str = "source",
    id_col: str = "doc_id",
    weight_col: str | None = None,
    tie_col: str | None = None,
    pattern: tuple[float, ...] = (3, 1, 2),
    budget: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` (of the row's source) and ``copies`` (0 to ``most``).

    Reruns agree: the draw is a hash of source, id, size, ``tie_col`` (a digest of the text, say) and seed, and of a number
    among rows alike in all these, which have a draw each. A null size counts as 0, a null source is a source of its own, null
    ids are drawn by the rest, a null weight counts as 1, and an empty table gives no rows. ``docs`` is read twice: once for the
    columns named here, once for the result. The three new columns replace any of their names; columns that begin with
    ``__mix_`` are not allowed.
    """
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    weight = F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)) if weight_col else F.lit(1.0)
    tie = F.col(tie_col).cast("long") if tie_col else F.lit(None).cast("long")
    keep = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    known = {"__mix_source": F.col(source_col), "__mix_id": F.col(id_col), "__mix_words": size, "__mix_weight": weight, "__mix_tie": tie}
    alike = list(known)
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), *(c.alias(n) for n, c in known.items()))
    base = materialize(rows.select(*alike).groupBy(*alike).agg(F.count("*").alias("__mix_m")), "alike")
    sums = base.groupBy(F.col("__mix_source").alias("source")).agg(
        F.sum(F.col("__mix_words") * F.col("__mix_m")).alias("source_size"), F.sum(F.col("__mix_words") * F.col("__mix_weight") * F.col("__mix_m")).alias("pull"), F.sum("__mix_m").alias("n")
    )
    targets = materialize(source_targets(sums, pattern, budget, most).withColumn("slices", F.ceil(F.col("n") / SLICE)), "targets")
    names = {"source": "__mix_s", "source_size": "__mix_size", "target": "__mix_target", "pull": "__mix_pull", "slices": "__mix_slices"}
    of_source = _small(targets.select(*(F.col(a).alias(b) for a, b in names.items())))

    def due(df: DataFrame, number: Column) -> DataFrame:
        """Certain copies, draw and slice of every row."""
        copies = F.when(F.col("__mix_pull") > 0, F.least(F.lit(float(most)), F.col("__mix_target") * F.col("__mix_weight") / F.col("__mix_pull"))).otherwise(0.0)
        f = F.col("__mix_due") - F.col("__mix_sure")
        u = (F.shiftrightunsigned("__mix_u", 11).cast("double") + 0.5) / F.lit(float(2**53))
        # z = q / (1 + q) orders like q = (u/(1-u)) / (f/(1-f)) and lies in (0, 1]
        z = F.when(f > 0, u * (1 - f) / (u * (1 - f) + f * (1 - u))).otherwise(1.0)
        return (
            df.join(of_source, _same(("__mix_source", "__mix_s")))
            .drop("__mix_s")
            .withColumn("__mix_u", F.xxhash64("__mix_source", "__mix_id", "__mix_words", "__mix_tie", F.lit(seed), number))
            .withColumn("__mix_due", copies)
            .withColumn("__mix_sure", F.floor("__mix_due"))
            .withColumn("__mix_z", z)
            .withColumn("__mix_slice", F.when(f > 0, F.least(F.floor(F.col("__mix_z") * F.col("__mix_slices")), F.col("__mix_slices") - 1)).otherwise(F.col("__mix_slices")))
        )

    ranked = due(base.withColumn("__mix_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__mix_m") - 1))), F.col("__mix_j"))
    draws = ranked.select(F.col("__mix_source").alias("source"), F.col("__mix_slice").alias("slice"), F.col("__mix_u").alias("u"), F.col("__mix_z").alias("z"), F.col("__mix_words").alias("words"), "__mix_sure", F.col("__mix_slices").alias("slices"))
    per_slice = draws.groupBy("source", "slice").agg(F.sum("words").alias("words"), F.sum(F.col("words") * F.col("__mix_sure")).alias("sure"), F.min(F.when(F.col("words") > 0, F.col("words"))).alias("least"))
    per_slice = materialize(per_slice, "slices")
    least = per_slice.select(F.col("source").alias("of"), F.col("slice").alias("later"), "least")
    upto, every = Window.partitionBy("source").orderBy("slice"), Window.partitionBy("source")
    ends = (
        per_slice.withColumn("sure", F.sum("sure").over(every))
        .withColumn("before", F.sum("words").over(upto) - F.col("words"))
        .join(targets.select(F.col("source").alias("s"), "target", "slices"), _same(("source", "s")))
        .withColumn("need", F.greatest(F.col("target") - F.col("sure"), F.lit(0.0)))
        .where("slice < slices and (before + words > need or slice = slices - 1)")
    )
    cut = ends.groupBy(F.col("source").alias("c")).agg(F.min("slice").alias("cut"), F.min_by(F.col("need") - F.col("before"), "slice").alias("left"))
    cut = materialize(cut, "cuts")
    kind = draws.schema["source"].dataType.simpleString()

    def filled(edge: DataFrame) -> DataFrame:
        return materialize(edge.groupBy("source").applyInPandas(_fill, f"source {kind}, slice long, u long, left double"), "picks")

    at_cut = draws.join(_small(cut), _same(("source", "c")) & (F.col("slice") == F.col("cut"))).select("source", "slice", "u", "z", "words", "left")
    found = filled(at_cut)
    picks, state = found.where("left < 0").select("source", "slice", "u"), found.where("left >= 0")
    rests = state.select("source", "left")
    while True:
        # sources with words left that some later slice has a document for
        state = state.select(F.col("source").alias("c"), F.col("slice").alias("cut"), "left").where("left >= 1")
        state = state.join(targets.select(F.col("source").alias("t"), F.col("slices").alias("all")), _same(("c", "t"))).drop("t")
        more = _same(("c", "of")) & (F.col("later") > F.col("cut")) & (F.col("later") < F.col("all")) & (F.col("least") <= F.col("left"))
        state = materialize(state.join(least, more, "left_semi"), "open")
        if state.isEmpty():
            discard(state)
            break
        fits = _same(("source", "c")) & (F.col("slice") > F.col("cut")) & (F.col("slice") < F.col("all")) & F.col("words").between(1, F.col("left"))
        rest = materialize(draws.drop("slices").join(_small(state), fits).select("source", "slice", "u", "z", "words", "left"), "later")
        order = Window.partitionBy("source").orderBy("slice")
        sums = rest.groupBy("source", "slice").agg(F.sum("words").alias("words"), F.first("left").alias("left"))
        sums = sums.withColumn("before", F.sum("words").over(order) - F.col("words")).withColumn("end", F.max("slice").over(every))
        sums = sums.where("before + words > left or slice = end")
        stops = sums.groupBy(F.col("source").alias("e")).agg(F.min("slice").alias("at"), F.min_by(F.col("left") - F.col("before"), "slice").alias("rest"))
        rest = rest.drop("left").join(_small(materialize(stops, "stops")), _same(("source", "e")) & (F.col("slice") <= F.col("at")))
        whole = rest.where("slice < at").select("source", "slice", "u")
        found = filled(rest.where("slice = at").select("source", "slice", "u", "z", "words", F.col("rest").alias("left")))
        state = found.where("left >= 0")
        picks = picks.unionByName(whole).unionByName(found.where("left < 0").select("source", "slice", "u"))
        rests = rests.unionByName(state.select("source", "left"))
    picks = materialize(picks, "taken")
    rests = rests.groupBy(F.col("source").alias("r")).agg(F.min("left").alias("left")).where("left >= 1")
    chosen = picks.select(F.col("source").alias("p"), F.col("slice").alias("ps"), F.col("u").alias("pu"), F.lit(True).alias("picked"))
    marked = _same(("source", "p"), ("slice", "ps"), ("u", "pu"))
    sides = at_cut.drop("left").join(_small(rests), _same(("source", "r"))).join(_small(chosen), marked, "left")
    sides = sides.select("source", "slice", "u", "z", "words", "left", F.coalesce("picked", F.lit(False)).alias("taken"))
    moved = materialize(sides.groupBy("source").applyInPandas(_exchange, f"source {kind}, slice long, u long, left double"), "moved")
    gone = moved.where("left = 0").select(F.col("source").alias("p"), F.col("slice").alias("ps"), F.col("u").alias("pu"))
    picks = picks.join(_small(gone), marked, "left_anti").unionByName(moved.where("left = 1").select("source", "slice", "u"))
    picks = _small(materialize(picks.select(F.col("source").alias("__mix_p"), F.col("slice").alias("__mix_ps"), F.col("u").alias("__mix_pu"), F.lit(1).alias("__mix_picked")), "picked"))
    cuts = _small(cut.select(F.col("c").alias("__mix_c"), F.col("cut").alias("__mix_cut")))

    def taken(df: DataFrame) -> DataFrame:
        """``df`` with ``extra``: 1 where the draw took the row, else 0."""
        df = df.join(cuts, _same(("__mix_source", "__mix_c")), "left")
        df = df.join(picks, _same(("__mix_source", "__mix_p"), ("__mix_slice", "__mix_ps"), ("__mix_u", "__mix_pu")), "left")
        return df.withColumn("__mix_extra", F.when(F.col("__mix_slice") < F.col("__mix_cut"), 1).otherwise(F.coalesce("__mix_picked", F.lit(0))))

    several = base.where("__mix_m > 1")
    single = rows
    if not several.isEmpty():
        several = taken(ranked.where("__mix_m > 1")).groupBy(*(F.col(c).alias(f"{c}_g") for c in alike)).agg(F.sum("__mix_extra").alias("__mix_taken"))
        several = _small(materialize(several, "several"))
        group = _same(*((c, f"{c}_g") for c in alike))
        single = rows.join(several, group, "left_anti")
    out = taken(due(single, F.lit(0).cast("long")))
    copies = lambda extra: (F.col("__mix_sure") + extra).cast("long").alias("copies")
    result = [*(F.col(f"`{c}`") for c in keep), F.col("__mix_size").alias("source_size"), F.col("__mix_target").alias("target")]
    out = out.select(*result, copies(F.col("__mix_extra")))
    if single is rows:
        return out
    plain = [f.name for f in docs.schema if f.name in keep and not isinstance(f.dataType, T.MapType | T.VariantType)]
    nth = Window.partitionBy(*alike).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in plain)))
    again = due(rows.join(several, group).withColumn("__mix_nth", F.row_number().over(nth)), F.lit(0).cast("long"))
    return out.unionByName(again.select(*result, copies((F.col("__mix_nth") <= F.col("__mix_taken")).cast("int"))))

"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame operations only.

A document is the set of its paragraphs' digests (a paragraph ends at a line end or behind a sentence's
end; one of more than ``LONG`` characters is cut further, behind words whose hash says so, and where no word
does, at least every ``WHOLE`` characters). A sketch has
three rows of cells; a digest is put in one cell of each row. A cell holds the sum of ``ONE`` + check of its
digests, so their number and checks at once, and the xor of the digests. Two versions' sketches subtract cell
by cell, which cancels what they share. A cell left with a single digest is pure: peeling takes it out of its
other cells, until nothing is left and the differing digests are known. Where cells remain, the pair is tried
again with larger sketches. Likeness is shared digests / all digests.

The published sketch has ``WIDTH`` cells a row and is made within the document's row. Subtracted, the number
of its cells that differ says how large the first sketch to peel has to be. Cells of those are rows grouped by
document and cell; a peeling round is one grouping. Within a round only one row of the sketch is searched, in
which a digest has one cell, so that nothing is taken out twice. All groupings keep the partitioning by document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.scratch import materialize, no_shuffles_left
from trialframe.operators.ordering import chunk_of

ROWS = 3
#: Cells in a row of the published fingerprint.
WIDTH = 4
#: What a digest adds to a cell besides its check of 32 bits.
ONE = 1 << 40
#: The rows of the sketch that are searched in turn; cells are twice the digests a row, so nearly all pairs are done.
ROUNDS = (0, 1, 2, 0, 1)
#: Sizes that are tried before digests are compared one by one.
TRIES = 5
PARAGRAPH_END = r"\n+|(?<=[.!?])[ \t]+"
#: Characters of a paragraph that is cut further, and one in how many words ends a part of it.
LONG, SHARE = 400, 16
#: Where no word ends a part, the first one that ends after so many characters does.
WHOLE = 256
#: Documents whose order is found together, about.
CHUNK = 1024
BROADCAST_ROWS = 200_000
CUT = "\x01"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _pieces(part: Column) -> Column:
    """A part in numbered pieces of about ``WHOLE`` characters."""
    cut = F.split(F.regexp_replace(part, r"(?s)(.{%d}[^ ]{0,64})(?: |$)" % WHOLE, f"$1{CUT}"), CUT)
    return F.transform(cut, lambda x, k: F.when((k > 0) & (F.trim(x) != ""), F.concat(F.trim(x), F.lit(CUT), k.cast("string"))).otherwise(x))


def _cut(paragraph: Column) -> Column:
    """The parts of a long paragraph. Where they end depends on the words alone; words of over 64 characters are cut, too.

    A text of few distinct words may have none that ends a part, or the same part again and again. A part that has got too
    long, and a paragraph most of whose parts are repeated, goes in pieces that are numbered: an edit behind them leaves them
    as they are.
    """
    words = F.split(F.regexp_replace(paragraph, r"([^ ]{64})(?=[^ ])", "$1 "), " ")
    ended = F.transform(words, lambda w: F.when(F.pmod(F.xxhash64(w), F.lit(SHARE)) == 0, F.concat(w, F.lit(CUT))).otherwise(w))
    parts = F.split(F.concat_ws(" ", ended), CUT)
    some = lambda ps: F.flatten(F.transform(ps, lambda p: F.when(F.length(p) > WHOLE + 64, _pieces(p)).otherwise(F.array(p))))
    again = lambda ps: 2 * F.size(F.array_distinct(ps)) < F.size(ps)
    return F.element_at(F.transform(F.array(parts), lambda ps: F.when(again(ps), _pieces(F.array_join(words, " "))).otherwise(some(ps))), 1)


def paragraph_digests(text: Column) -> Column:
    """Distinct digests of a text's non-blank paragraphs and of the parts of long ones."""
    whole = F.transform(F.split(text, PARAGRAPH_END), lambda p: F.when(F.length(p) > LONG, _cut(p)).otherwise(F.array(p)))
    some = F.filter(F.transform(F.flatten(whole), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.transform(some, lambda p: F.xxhash64(p)))


def _weight(digest: Column) -> Column:
    """``ONE`` and the digest's check."""
    return F.xxhash64(digest, F.lit("check")).bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(ONE)


def small_sketch(digests: Column) -> Column:
    """The published sketch of an array of digests: an array of its cells' (p, k), row after row."""
    powers = F.array(*(F.lit(1 << i).cast("long") for i in range(WIDTH)))

    def placed(d: Column) -> Column:
        h = F.xxhash64(d, F.lit("place"))
        bits = [F.element_at(powers, F.shiftright(h, 8 * r).bitwiseAND(F.lit(WIDTH - 1)).cast("int") + 1) * F.lit(1 << (WIDTH * r)) for r in range(ROWS)]
        return F.struct(d.alias("k"), _weight(d).alias("p"), (bits[0] + bits[1] + bits[2]).alias("cells"))

    nothing = F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("k"))

    def cell(all_: Column, bit: Column) -> Column:
        add = lambda s, x: F.struct((s["p"] + x["p"]).alias("p"), s["k"].bitwiseXOR(x["k"]).alias("k"))
        return F.aggregate(all_, nothing, lambda s, x: F.when(x["cells"].bitwiseAND(bit) != 0, add(s, x)).otherwise(s))

    bits = F.array(*(F.lit(1 << i).cast("long") for i in range(ROWS * WIDTH)))
    return F.element_at(F.transform(F.array(F.transform(digests, placed)), lambda xs: F.transform(bits, lambda b: cell(xs, b))), 1)


def updated(cells: Column, gone: Column, new: Column) -> Column:
    """A published sketch less the digests ``gone``, and with the ``new`` ones: sketches add and subtract cell by cell."""
    less = F.zip_with(cells, small_sketch(gone), lambda a, b: F.struct((a["p"] - b["p"]).alias("p"), a["k"].bitwiseXOR(b["k"]).alias("k")))
    return F.zip_with(less, small_sketch(new), lambda a, b: F.struct((a["p"] + b["p"]).alias("p"), a["k"].bitwiseXOR(b["k"]).alias("k")))


def published(size: Column, cells: Column) -> Column:
    """The fingerprint as text: the number of digests, then the cells in use, in hex."""
    named = F.transform(cells, lambda c, i: F.when((c["p"] != 0) | (c["k"] != 0), F.concat_ws(":", F.hex(i.cast("long")), F.hex(c["p"]), F.hex(c["k"]))))
    return F.lower(F.concat_ws(";", F.hex(size.cast("long")), F.filter(named, lambda t: t.isNotNull())))


def unequal(a: Column, b: Column) -> Column:
    """How many cells of two published sketches differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda t: t))


def expected(cells: Column) -> Column:
    """Differing digests, from above, that leave so many cells of the published sketch unequal; null if all are."""
    full = ROWS * WIDTH
    counted = F.log(1 - cells / F.lit(float(full))) / F.lit(math.log(1 - 1 / WIDTH))
    return F.when(cells < full, F.ceil(counted * 1.5) + 4)


def _place(row: int, digest: Column, width: Column, turn: int) -> Column:
    return row * width + F.pmod(F.xxhash64(digest, F.lit(row), F.lit(turn)), width)


def sketch(digests: DataFrame, keys: list[str], turn: int = 0) -> DataFrame:
    """(keys, cell, p, k) of ``digests(keys incl. w, sign, digest)``: the cells in use, subtracted where signs differ."""
    rows = F.explode(F.array(*(_place(r, F.col("digest"), F.col("w"), turn) for r in range(ROWS))))
    cells = digests.select(*keys, (F.col("sign") * _weight(F.col("digest"))).alias("p"), F.col("digest").alias("k"), rows.alias("cell"))
    return cells.groupBy(*keys, "cell").agg(F.sum("p").alias("p"), F.bit_xor("k").alias("k")).where("p <> 0 or k <> 0")


def peel(cells: DataFrame, keys: list[str], turn: int = 0) -> DataFrame:
    """(keys, cell, p, k) after ``ROUNDS``: a recovered digest k is a row of its own with a negative cell and p 1 or -1."""
    make = lambda cell, p, k: F.struct(cell.cast("long").alias("cell"), p.cast("long").alias("p"), k.alias("k"))
    for row in ROUNDS:
        one = _weight(F.col("k"))
        pure = (F.col("cell") >= 0) & (F.floor(F.col("cell") / F.col("w")) == row) & ((F.col("p") == one) | (F.col("p") == -one))
        found = make(F.col("k").bitwiseOR(F.lit(-(2**63))), F.signum("p"), F.col("k"))
        others = [make(_place(r, F.col("k"), F.col("w"), turn), -F.col("p"), F.col("k")) for r in range(ROWS) if r != row]
        stays = make(F.col("cell"), F.col("p"), F.col("k"))
        cells = cells.select(*keys, F.explode(F.when(pure, F.array(found, *others)).otherwise(F.array(stays))).alias("x")).select(*keys, "x.*")
        cells = cells.groupBy(*keys, "cell").agg(F.sum("p").alias("p"), F.bit_xor("k").alias("k")).where("p <> 0 or k <> 0")
    return cells


def _peeled(pairs: DataFrame, turn: int) -> DataFrame:
    keys = ["id", "pair", "w"]
    sides = F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("a").alias("d")), F.struct(F.lit(-1).alias("sign"), F.col("b").alias("d"))))
    digests = pairs.select(*keys, sides.alias("side")).select(*keys, "side.sign", F.explode("side.d").alias("digest"))
    return peel(sketch(digests, keys, turn), keys, turn)


def _tried(pairs: DataFrame, totals: list[Column], exact: list[Column], names: list[str]) -> DataFrame:
    """(id, pair, names) for every row of ``pairs(id, pair, a, b, guess)`` whose sets differ. ``pairs`` is partitioned by id.

    ``totals`` sum up the rows of ``peel``; ``exact`` are the same of ``a`` and ``b``, for pairs that no try has peeled.
    ``guess`` is how many digests differ, null if it isn't known.
    """
    both = (F.size("a") + F.size("b")).cast("long")
    done: list[DataFrame] = []
    todo = pairs.withColumn("w", F.greatest(2 * F.least(F.coalesce("guess", both), both), F.lit(WIDTH)))
    for turn in range(1, TRIES + 1):
        left = F.count(F.when(F.col("cell") >= 0, 1)).alias("left")
        with no_shuffles_left(pairs.sparkSession):
            found = materialize(_peeled(todo, turn).groupBy("id", "pair").agg(*totals, left), f"peeled{turn}")
        done.append(found.where("left = 0").select("id", "pair", *names))
        failed = found.where("left > 0").select("id", "pair")
        if failed.isEmpty():
            break
        todo = pairs.join(_small(failed), ["id", "pair"], "left_semi").withColumn("w", both * 2**turn + WIDTH)
    else:
        done.append(todo.select("id", "pair", *exact))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def differences(pairs: DataFrame) -> DataFrame:
    """(id, pair, only_a, only_b): the recovered digests of ``pairs(id, pair, a, b)``, of each side; no row for equal sets."""
    of = lambda sign, name: F.collect_list(F.when((F.col("cell") < 0) & (F.col("p") == sign), F.col("k"))).alias(name)
    exact = [F.array_except("a", "b").alias("only_a"), F.array_except("b", "a").alias("only_b")]
    return _tried(pairs.repartition("id").withColumn("guess", F.lit(None).cast("long")), [of(1, "only_a"), of(-1, "only_b")], exact, ["only_a", "only_b"])


#: What is known of a pair: how many digests only the first, only the second has, and the xor of these.
KNOWN = ["removed", "added", "checksum"]


def recovered(pairs: DataFrame) -> DataFrame:
    """(id, pair, ``KNOWN``) for the rows of ``pairs(id, pair, a, b, guess)``, partitioned by id, whose sets differ."""
    own = F.col("cell") < 0
    totals = [F.count(F.when(own & (F.col("p") == sign), 1)).alias(n) for sign, n in ((1, "removed"), (-1, "added"))]
    xor = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))
    only_a, only_b = F.array_except("a", "b"), F.array_except("b", "a")
    exact = [F.size(only_a).cast("long").alias("removed"), F.size(only_b).cast("long").alias("added"), xor(only_a).bitwiseXOR(xor(only_b)).alias("checksum")]
    checksum = F.coalesce(F.bit_xor(F.when(own, F.col("k"))), F.lit(0).cast("long")).alias("checksum")
    return _tried(pairs.where("guess is null or guess > 0"), [*totals, checksum], exact, KNOWN)


def near(n: Column, removed: Column, added: Column) -> Column:
    """Shared / all digests, of ``n`` of the first: 1 for equal sets (also empty ones), 0 if nothing is shared."""
    return F.when(n + added == 0, 1.0).otherwise((n - removed) / (n + added))


def likeness(pairs: DataFrame) -> DataFrame:
    """(id, pair, near, ``KNOWN``) for every row of ``pairs(id, pair, a, b, guess)``, two arrays of distinct digests.

    A pair that no sketch of ``TRIES`` sizes peels is compared digest by digest.
    """
    known = recovered(pairs.repartition("id"))
    sizes = pairs.select("id", "pair", F.size("a").alias("n")).join(known, ["id", "pair"], "left").na.fill(0, KNOWN)
    return sizes.select("id", "pair", near(F.col("n"), F.col("removed"), F.col("added")).alias("near"), *KNOWN)


def next_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, following, d, following_d, cells, following_cells): each row with the next one's, ids ascending, the last with the first.

    The order is cut into chunks of about ``CHUNK`` rows at sampled rows; the first row of a chunk is also put behind the rows
    of the chunk before. Rows that repeat an id go by their texts; null ids come first. Equal rows are dealt to chunks as well:
    whichever of them stands at a chunk's beginning, its text is the same.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"i": F.coalesce("doc_id", F.lit(-(2**63))), "h": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
    keys = materialize(rows.select("i", "h", "salt"), "keys")
    chunk, _ = chunk_of(keys, {c: F.col(c) for c in ("i", "h", "salt")}, CHUNK)
    heads = keys.withColumn("chunk", chunk).groupBy("chunk").agg(F.min(F.struct("i", "h")).alias("head"))
    heads = materialize(heads, "heads")
    ends = heads.agg(F.min("chunk").alias("first"), F.max("chunk").alias("last")).first()
    before = F.when(F.col("chunk") == F.lit(ends["first"]).cast("long"), F.lit(ends["last"]).cast("long")).otherwise(F.col("chunk") - 1)
    heads = _small(heads.select(F.col("head.i").alias("hi"), F.col("head.h").alias("hh"), before.alias("to")))
    behind = rows.join(heads, (F.col("i") == F.col("hi")) & (F.col("h") == F.col("hh"))).dropDuplicates(["to"])
    behind = behind.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("to").alias("chunk"), "i", "h", "salt", F.lit(1).alias("behind"))
    together = rows.select("doc_id", "text", chunk.alias("chunk"), "i", "h", "salt", F.lit(0).alias("behind")).unionByName(behind)
    together = together.repartition("chunk").withColumn("d", paragraph_digests(F.col("text"))).withColumn("cells", small_sketch(F.col("d")))
    w = Window.partitionBy("chunk").orderBy("behind", "i", "h", "salt")
    out = together.withColumns({"following": F.lead("text").over(w), "following_d": F.lead("d").over(w), "following_cells": F.lead("cells").over(w)})
    return out.where("behind = 0").select("doc_id", "text", "following", "d", "following_d", "cells", "following_cells")


def version_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited version, with likenesses.

    The edited version has the last quarter (rounded down, in code points) replaced by as much of the next
    document's beginning. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, and of the edited version the number of digests that it lost, that it gained, and the xor of all these.
    Null texts are empty; repeated rows are documents of their own; very long texts are digested whole; a single
    document is its own next; an empty table gives no rows; other columns are not read and may have any names.
    """
    rows = next_texts(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    part = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - part).cast("int")), F.substring("following", F.lit(1), part))
    rows = rows.withColumn("edited", edited).withColumn("e", paragraph_digests(F.col("edited")))
    # the edited version's digests are kept as what it lost and gained, and its sketch is made of the text's by these
    rows = rows.withColumns({"gone": F.array_except("d", "e"), "new": F.array_except("e", "d"), "sha": F.sha2("edited", 256)})
    rows = rows.withColumn("edited_cells", updated(F.col("cells"), F.col("gone"), F.col("new")))
    rows = rows.select(
        F.monotonically_increasing_id().alias("id"), "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), "d", "gone", "new", F.col("following_d").alias("f"), F.size("d").alias("n"), F.size("e").alias("n_e"), "cells", "edited_cells",
        unequal(F.col("cells"), F.col("edited_cells")).alias("to_e"), unequal(F.col("cells"), F.col("following_cells")).alias("to_f"),
    )
    with no_shuffles_left(docs.sparkSession):  # the texts' shuffle is as large as the texts
        rows = materialize(rows, "versions")
    guess = lambda cells: F.when(cells == 0, 0).otherwise(expected(cells)).cast("long").alias("guess")
    versions = {"e": F.concat(F.array_except("d", "gone"), F.col("new")), "f": F.col("f")}
    two = [F.struct(F.lit(c).alias("pair"), digests.alias("b"), guess(F.col(f"to_{c}"))) for c, digests in versions.items()]
    moved = rows.select("id", "d", "gone", "new", "f", "to_e", "to_f").repartition("id")
    known = recovered(moved.select("id", F.col("d").alias("a"), F.explode(F.array(*two)).alias("x")).select("id", "x.pair", "a", "x.b", "x.guess"))
    wide = known.groupBy(F.col("id").alias("of")).agg(*(F.max(F.when(F.col("pair") == c, F.col(k))).alias(f"{c}_{k}") for c in versions for k in KNOWN))
    found = [f"{c}_{k}" for c in versions for k in KNOWN]
    out = rows.drop("d", "gone", "new", "f", "to_e", "to_f").join(wide, F.col("id") == F.col("of"), "left").na.fill(0, found)
    return out.select(
        "doc_id", "n_chars", "edited_sha256", published(F.col("n"), F.col("cells")).alias("fingerprint"), published(F.col("n_e"), F.col("edited_cells")).alias("edited_fingerprint"),
        *(near(F.col("n"), F.col(f"{c}_removed"), F.col(f"{c}_added")).alias(name) for c, name in (("e", "near_edited"), ("f", "near_next"))), *(F.col(f"e_{k}").alias(f"edited_{k}") for k in KNOWN),
    )

"""Ranked lexical search: integer BM25-like scores of all documents for every item of a query table.

Postings (one row for a term of a document) are written as a table that is bucketed by term; a term's postings are
dealt over ``SLICES`` buckets by document, so that a word of every document is no one task's. The items' terms are
joined to their postings, which gives every match an integer score; matches are summed by item and document, and a
window's row number keeps each item's first ``k``.

A match is made where its document is: scored postings are dealt by document before they meet the items, so the join's
many rows (items that share a common word, times its documents) are summed in the task that makes them and never
shuffled. What leaves a task is at most ``k`` documents for each item.

The terms of the items are read by the driver only up to ``MAX_TERMS`` of them and so many bytes; then the postings of
other terms aren't even made, and the items go to the tasks by broadcast. Beyond that all postings are made and joined
by shuffle. Results are the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialframe.llm.workers import bound_batches, parts
from trialframe.scratch import discard, materialize

#: Buckets that one term's postings are dealt over.
SLICES = 64
#: Distinct terms, pairs of item and term, and bytes of terms that may be read by the driver and broadcast.
MAX_TERMS = 100_000
MAX_BYTES = 8 << 20

_UPPER, _LOWER = range(0x41, 0x5B), range(0x61, 0x7B)
#: Every byte as it stands in a term: A-Z as a-z; digits, a-z and all bytes of characters beyond ASCII as they are; else a blank.
_FOLD = bytes(b + 32 if b in _UPPER else b if b in _LOWER or 0x30 <= b < 0x3A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order: runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased."""
    return (text or b"").translate(_FOLD).split()


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: frozenset[bytes] | None = None) -> DataFrame:
    """(row, id, n, term, tf): a row for each distinct term of a document, and one with a null term for each document that has any.

    ``row`` tells rows of ``docs`` apart, whatever their ids; ``n`` is the document's number of terms, repeats included.
    ``only`` keeps these terms (and the rows with a null term). Texts are read whole.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 2):
            at, lengths, found, counts = [], [], [], []
            for i, text in enumerate(part.column(2).cast(pa.large_binary()).to_pylist()):
                own = terms(text)
                if not own:
                    continue
                tally = Counter(own)
                kept = tally if only is None else [t for t in tally if t in only]
                at.extend([i] * (len(kept) + 1))
                lengths.extend([len(own)] * (len(kept) + 1))
                found.append(None)
                found.extend(kept)
                counts.append(0)
                counts.extend(tally[t] for t in kept)
            where = pa.array(at, pa.int64())
            columns = [part.column(0).take(where), part.column(1).take(where), pa.array(lengths, pa.int64()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n", "term", "tf"])

    bound_batches(docs.sparkSession)
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(scan, "row long, id long, n long, term string, tf long")


def _bounded(asked: DataFrame) -> frozenset[bytes] | None:
    """The distinct terms that the items ask for, where they are few enough to hold, else nothing."""
    if asked.limit(MAX_TERMS + 1).count() > MAX_TERMS:
        return None
    if (asked.agg(F.sum(F.octet_length("term"))).head()[0] or 0) > MAX_BYTES:
        return None
    return frozenset(r.term.encode() for r in asked.select("term").distinct().toLocalIterator())


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0, fewer if there are fewer.

    Over N documents with terms, of L terms in all, a term in df of them weighs w = floor(1000 ln((2N+2)/(2df+1))), and a
    document of n terms, tf of them this one, adds w * ((10^9 tf) div (1000 tf + 20 m)), m = 50 + (50 n N) div L. An
    item's term counts once. Equal scores go by ascending id, nulls last.

    Null texts have no terms. Rows with one id, or none, are documents (or items) of their own, repeated rows too. Items
    without terms, and those that no document shares a term with, have no rows; nor has anything where a table is empty.
    Further columns are ignored, whatever their names.
    """
    asked = materialize(postings(items, item_id_col, item_text_col).where("term IS NOT NULL").select(F.col("row").alias("item"), F.col("id").alias("item_id"), "term"), "item-terms")
    only = _bounded(asked)
    near = F.broadcast if only is not None else (lambda df: df)
    slices = F.pmod(F.xxhash64("row"), F.lit(SLICES))
    index = materialize(postings(docs, id_col, text_col, only).repartition("term", slices).sortWithinPartitions("term", "row"), "postings")
    whole = index.where("term IS NULL").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(1)).alias("terms")).head()
    n_docs, n_terms = F.lit(whole.docs).cast("long"), F.lit(whole.terms).cast("long")
    df = index.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).alias("w")
    weighed = df.join(near(asked.select("term").distinct()), "term").select("term", weight)
    wanted = materialize(asked.join(near(weighed), "term").where("w > 0"), "weights")

    scored = index.where("term IS NOT NULL")
    scored = scored.join(near(wanted.select("term").distinct()), "term", "left_semi")
    scored = scored.withColumn("docs", n_docs).withColumn("terms", n_terms).withColumn("m", F.expr("50 + (50 * n * docs) div terms"))
    scored = scored.select("row", "id", "term", F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)").alias("s"))
    matches = scored.repartition("row").join(near(wanted), "term")
    summed = matches.groupBy("row", "item").agg(F.sum(F.col("w") * F.col("s")).alias("score"), F.first("id").alias("doc_id"), F.first("item_id").alias("item_id"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = summed.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = materialize(ranked.select("item_id", "rank", "doc_id", "score"), "ranked")
    discard(asked, index, wanted)
    return out

"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most three
bits differ in at most three bytes, so at least five positions agree: the guaranteed minimum of
shared postings. Posting lists of one position would each hold 1/256 of the corpus, so postings
are indexed four positions at a time, by the 14 position sets {a,b,c,d} with a^b^c^d = 0. Any
three positions lie in the complement of one such set, hence every linked pair meets in a list.
Pairs that meet are tallied (shared positional bytes), kept at five or more, then verified.

Equal fingerprints are one node, so copies are never paired. Within a list no pair leaves the
worker but a spanning forest. A list of more than ``LONG_LIST`` fingerprints is dealt once more by
one of its other four positions, of which at least one agrees as well; what is still longer than
``BLOCK`` goes to tasks as pairs of blocks. So no task holds a list of unbounded length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.llm.components import components, forest
from trialframe.scratch import discard, materialize
from trialframe.llm.workers import bound_batches, parts

BYTES = 8
POSITION_SETS = [s for s in combinations(range(BYTES), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]
SHORT_LIST = 24
BLOCK = 2048
LONG_LIST = 8192
#: Lists of lists (a key and a number each) are broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 200_000


def simhash(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of unsigned 64-bit hashes: a bit is set if it is in over half of them; 0 of none."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def shingle_hashes(text: bytes | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles in turn, repeats included; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(join(words), seed)], np.uint64)
    n = len(words) - width + 1
    return np.fromiter((digest(join(s), seed) for s in zip(*(words[i:] for i in range(width)), strict=False)), np.uint64, n)


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles of one text; 0 without words."""
    return simhash(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id long, fp long) per row of ``docs``. Null texts are empty; whole texts are read, of any length."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1):
            out = [fingerprint(t, width, seed) for t in part.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.int64())], names=["id", "fp"])

    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(scan, "id long, fp long")


def _agree(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Count filter (shared positional bytes reach the guaranteed minimum), then verification."""
    diff = (x ^ y).view(np.uint64)
    tally = np.zeros(diff.shape, np.uint8)
    for position in range(BYTES):
        tally += ((diff >> np.uint64(8 * position)) & np.uint64(255)) == 0
    near = tally >= BYTES - bits
    near[near] = np.bitwise_count(diff[near]) <= bits
    return near


def _list_edges(fps: np.ndarray, reps: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning edges of one long posting list, a pair of blocks at a time."""
    for i in range(0, len(fps), BLOCK):
        for j in range(i, len(fps), BLOCK):
            a, b = fps[i : i + BLOCK], fps[j : j + BLOCK]
            near = _agree(np.repeat(a, len(b)), np.tile(b, len(a)), bits).reshape(len(a), len(b))
            if i == j:
                np.fill_diagonal(near, False)
                square, ids = near, reps[i : i + BLOCK]
            else:
                n = len(a) + len(b)
                square = np.zeros((n, n), bool)
                square[: len(a), len(a) :] = near
                square[len(a) :, : len(a)] = near.T
                ids = np.concatenate([reps[i : i + BLOCK], reps[j : j + BLOCK]])
            if edges := forest(square):
                at = np.array(edges)
                yield ids[at[:, 0]], ids[at[:, 1]]


def _edges(bits: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(keys: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            own = np.repeat(sizes, sizes)
            short = own <= SHORT_LIST
            for step in range(1, int(sizes[sizes <= SHORT_LIST].max(initial=1))):
                at = np.flatnonzero((keys[step:] == keys[:-step]) & short[step:])
                at = at[_agree(fps[at], fps[at + step], bits)]
                if len(at):
                    yield reps[at], reps[at + step]
            for s, n in zip(starts[sizes > SHORT_LIST], sizes[sizes > SHORT_LIST], strict=True):
                yield from _list_edges(fps[s : s + n], reps[s : s + n], bits)

        def out(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for a, b in found:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []  # rows of the last list seen, which may go on in the next batch
        for batch in batches:
            now = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(now[0]):
                continue
            if now[0][0] == now[0][-1] and (not held or held[0][0][0] == now[0][0]):
                held.append(now)
                continue
            whole = tuple(np.concatenate(c) for c in zip(*held, now, strict=True))
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            yield from out(lists(*(c[:cut] for c in whole)))
            held = [tuple(c[cut:] for c in whole)]
        if held:
            yield from out(lists(*(np.concatenate(c) for c in zip(*held, strict=True))))

    return scan


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _split(index: DataFrame, byte: list[Column]) -> DataFrame:
    """``index(key, fp, rep)`` of long lists, dealt anew: every pair that agrees in a fifth position meets."""
    others = None
    for k, positions in enumerate(POSITION_SETS):
        fifth = F.array(*(F.shiftleft("key", 11).bitwiseOR(F.lit(p << 8)).bitwiseOR(byte[p]) for p in range(BYTES) if p not in positions))
        of = F.shiftright("key", 32) == k
        others = F.when(of, fifth) if others is None else others.when(of, fifth)
    parts = materialize(index.select(F.explode(others).alias("part"), "fp", "rep"), "long_lists")
    sizes = parts.groupBy("part").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    sizes = _small(materialize(sizes.select("part", F.ceil(F.col("size") / BLOCK).alias("blocks")), "blocks"))
    dealt = parts.join(sizes, "part", "left").na.fill(1, ["blocks"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.xxhash64("part", F.least(b, F.col("block")), F.greatest(b, F.col("block"))))
    return dealt.select(F.explode(pairs).alias("key"), "fp", "rep")


def near_links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b): links between the distinct ``fps(fp)`` of at most ``bits`` differing bits (3 at most) that span their groups."""
    if not 0 <= bits <= 3:
        raise ValueError("the position sets guarantee a meeting for at most 3 differing bits")
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(BYTES)]
    keys = []
    for k, positions in enumerate(POSITION_SETS):
        key = F.lit(k).cast("long")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(byte[p])
        keys.append(key)
    index = fps.select(F.explode(F.array(*keys)).alias("key"), "fp", F.col("fp").alias("rep"))
    long = materialize(index.groupBy("key").count().where(F.col("count") > LONG_LIST).select("key"), "long")
    if long.isEmpty():
        discard(long)
    else:
        keys = _small(long)
        index = index.join(keys, "key", "left_anti").unionByName(_split(index.join(keys, "key", "left_semi"), byte))
    index = index.repartition("key").sortWithinPartitions("key")
    return index.mapInArrow(_edges(bits), "a long, b long")


def near_classes(fps: DataFrame, bits: int = 3) -> DataFrame:
    """(fp, component) of ``fps(id, fp)``: the smallest id reachable by links, null where no id is."""
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    roots = components(near_links(nodes.select("fp"), bits))
    classes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    return classes.join(classes.groupBy("root").agg(F.min("id").alias("component")), "root").select("fp", "component")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """(id, fp, component) per row of ``docs``: ``component`` is the smallest id reachable by links.

    Null texts count as empty. Texts without words have fingerprint 0 and are linked like any
    others. Rows that repeat an id are rows of their own, which may be in different groups. A null id
    names no group: a component is null only where all ids of the group are. An empty table gives no
    rows. Only the id and the text are read, so further columns may have any names.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = _small(materialize(near_classes(fps, bits), "classes"))
    return fps.join(classes, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies, columns unchanged: see ``near_copies.keep_one``."""
    from trialframe.llm import near_copies

    return near_copies.keep_one(docs, id_col, text_col, width, similarity)

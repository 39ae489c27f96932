"""Language-model scores from a log-frequency Bloom filter.

Texts are cut into tokens and hashed a window at a time, without a Python object per word; a window's body
(which word stands where, by number) is stored once. Training counts every word and every pair of words. A
pair's count c is quantised to 1 + floor(2 log2 c) levels; the filter holds (pair, level) up to that level, and
a query probes level after level until one is missing. Words and pairs are dealt to slices by their hash, so
each task builds its own slice of the filter, as large as its pairs need: no count is left out, and the filter
grows with the corpus. Where its proven bound (``LEVELS_A_TOKEN`` levels for each training token) is within
``broadcast_bytes`` it is broadcast to the workers and probed there; beyond that it cannot be, and each window's
distinct pairs are probed where their slice is built, and come back as levels. Both ways give the same scores.
The Dirichlet-smoothed probability

    P(w | h) = (low(h w) + mu P(w)) / (c(h) + mu),  P(w) = (c(w) + 1) / (N + V + 1)

uses the lower bound of the pair's level, so quantising never makes the probabilities of a history exceed 1.
Counts of words are exact, as the add-one score needs them: each window asks the slices for its own words'.

Words are named by 64-bit hashes; of a billion words, two share one with a probability of 3 in 100.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.quality import remainder
from trialframe.scratch import materialize
from trialframe.llm.workers import bound_batches, parts, trim

PROBES = 3
#: Bits of the filter for each (pair, level): a missing one is found in about 2 of 100.
BITS_PER_LEVEL = 10
#: Levels that a training token adds at most: a pair of count 2 has 3.
LEVELS_A_TOKEN = 1.5
#: Words and pairs of about this many tokens meet in one slice.
SLICE_TOKENS = 1_000_000
#: Bytes of text whose words and pairs go to their slices together. A longer text is cut between words.
WINDOW = 4 << 20
#: Levels of counts: two a doubling, up to 2**60.
MOST_LEVELS = 120
#: Hashes of the end token and of what stands before a text.
END = np.uint64(0x5851F42D4C957F2D)
BEGIN = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ASCII-lower-cased words of texts ``data[offsets[i]:offsets[i + 1]]`` in turn, and how many each has."""
    n = int(offsets[-1])
    text = np.zeros(n + 8, np.uint8)
    text[:n] = _LOWER[data[:n]]
    blank = _BLANK[text[:n]]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~blank & (np.r_[True, blank[:-1]] | edge[:-1])[:n])
    lengths = np.flatnonzero(~blank & (np.r_[blank[1:], True] | edge[1:])[:n]) + 1 - starts
    eight = np.ndarray((n + 1,), "<u8", text, strides=(1,))  # the eight bytes behind each place
    with np.errstate(over="ignore"):
        h = _mix((eight[starts] & _MASK[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * BEGIN)
        at, live = 8, np.flatnonzero(lengths > 8)
        while len(live):
            h[live] = _mix((h[live] ^ (eight[starts[live] + at] & _MASK[np.minimum(lengths[live] - at, 8)])) + BEGIN)
            at += 8
            live = live[lengths[live] > at]
    return h, np.diff(np.searchsorted(starts, offsets))


def pair_keys(hashes: np.ndarray, previous: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(hashes + BEGIN * (previous ^ np.uint64(0x632BE59BD9B4E019)))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, sorted, the place of each key among them, and how often each occurs."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    return keys[starts], place, np.diff(np.r_[starts, len(keys)])


def slices_of(keys: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each key, a power of two of them: its top bits. Sorted keys have sorted slices."""
    return (keys >> np.uint64(64 - int(math.log2(slices)))).astype(np.int64) if slices > 1 else np.zeros(len(keys), np.int64)


# -- the filter --------------------------------------------------------------------------------------------


def _probes(short: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Within a slice a pair is the last 32 bits of its key; of a slice's pairs, a few in ten thousand share them."""
    with np.errstate(over="ignore"):
        h = _mix(short.astype(np.uint64) + np.uint64(0xD1342543DE82EF95) * np.uint64(level))
    return h, (h >> np.uint64(32)) | np.uint64(1)


def _place(h: np.ndarray, step: np.ndarray, probe: int, size: np.ndarray | np.uint64) -> np.ndarray:
    """A bit below ``size`` (under 2**32)."""
    with np.errstate(over="ignore"):
        return ((((h + np.uint64(probe) * step) & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32)).astype(np.int64)


def build_region(short: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The bytes of a slice that holds (pair, 1..level) of each pair."""
    size = max(1, -(-int(level.sum(dtype=np.int64)) * BITS_PER_LEVEL // 8)) * 8
    region = np.zeros(size, bool)
    for at in range(1, int(level.max(initial=0)) + 1):
        h, step = _probes(short[level >= at], at)
        for probe in range(PROBES):
            region[_place(h, step, probe, np.uint64(size))] = True
    return np.packbits(region, bitorder="little")


class LogFrequencyFilter:
    """The filter, or a slice of it as a filter of one slice: ``sizes`` bytes of ``data`` a slice, in turn."""

    def __init__(self, sizes: np.ndarray, data: np.ndarray) -> None:
        self.sizes, self.data = sizes, data
        self.starts = np.cumsum(sizes) - sizes

    def levels(self, short: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Repeated membership probes in the slices ``of``: the highest level reached without a gap."""
        found = np.zeros(len(short), np.uint8)
        live = np.flatnonzero(self.sizes[of])
        base, size, level = self.starts[of[live]] * 8, (self.sizes[of[live]] * 8).astype(np.uint64), 0
        while len(live) and level < MOST_LEVELS:
            level += 1
            h, step = _probes(short[live], level)
            for probe in range(PROBES):
                at = base + _place(h, step, probe, size)
                hit = (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                live, base, size, h, step = live[hit], base[hit], size[hit], h[hit], step[hit]
            found[live] = level
        return found


def quantise(count: np.ndarray) -> np.ndarray:
    return (1 + np.floor(2 * np.log2(count) + 1e-9)).astype(np.uint8)


def low(level: np.ndarray) -> np.ndarray:
    """The smallest count of a level; 0 of none."""
    return np.where(level > 0, np.ceil(np.exp2((level.astype(float) - 1) / 2) - 1e-9), 0.0)


# -- windows of texts --------------------------------------------------------------------------------------


def _pieces(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, from, to) in turn; a text of more than ``WINDOW`` bytes is cut behind blanks."""
    out = []
    for text, (at, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while end - at > WINDOW:
            blanks = np.flatnonzero(_BLANK[data[at : at + WINDOW]])
            if not len(blanks):  # a word longer than a window
                blanks = np.flatnonzero(_BLANK[data[at:end]])[:1]
            if not len(blanks) or at + int(blanks[-1]) + 1 >= end:
                break
            out.append((text, at, at + int(blanks[-1]) + 1))
            at = out[-1][2]
        out.append((text, at, end))
    return out


def _planes(numbers: np.ndarray) -> tuple[int, int, bytes]:
    """Numbers byte plane by byte plane, compressed: small ones are frequent."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T[: max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))]
    return len(numbers), len(planes), pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _from_planes(n: int, planes: int, data: bytes) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    out[:, :planes] = np.frombuffer(pa.decompress(data, decompressed_size=n * planes, codec="zstd", asbytes=True), np.uint8).reshape(planes, n).T
    return out.view("<u4").ravel().astype(np.int64)


class Body:
    """A window: its pieces' rows, ids and folds, and the tokens as numbers of the window's distinct words."""

    def __init__(self, rows, ids, none, held, lengths, before, packed, hashes) -> None:
        self.rows, self.ids, self.none, self.held, self.lengths, self.before, self.hashes = rows, ids, none, held, lengths, before, hashes
        self.numbers = _from_planes(*packed)

    def per_token(self, per_piece: np.ndarray) -> np.ndarray:
        return np.repeat(per_piece, self.lengths)

    def previous(self) -> np.ndarray:
        """The number of the word before each token, -1 at the beginning of a text."""
        out = np.empty_like(self.numbers)
        out[1:] = self.numbers[:-1]
        some = self.lengths > 0
        out[(np.cumsum(self.lengths) - self.lengths)[some]] = self.before[some]
        return out

    def pairs(self) -> np.ndarray:
        hashes = np.r_[self.hashes, BEGIN]  # number -1
        return pair_keys(hashes[self.numbers], hashes[self.previous()])


def bodies_of(batches: Iterator[pa.RecordBatch], task: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(chunk, training tokens, training texts, pickled arguments of ``Body``) of ``batches(doc_id, held_out, text)``."""
    row = chunk = task << 33
    for batch in parts(batches, 2, rows=1 << 20, most=WINDOW):
        column = pc.fill_null(batch.column(2).cast(pa.large_binary()), b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        ids, held = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        none, ids = ids.is_null().to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy()
        pieces = _pieces(data, offsets)
        carried = BEGIN
        at = 0
        while at < len(pieces):
            to, size = at, 0
            while to < len(pieces) and (to == at or size + pieces[to][2] - pieces[to][1] <= WINDOW):
                size += pieces[to][2] - pieces[to][1]
                to += 1
            own = pieces[at:to]
            text = np.array([p[0] for p in own])
            start = own[0][1]
            h, words = word_hashes(data[start : own[-1][2]], np.array([own[0][1], *(p[2] for p in own)]) - start)
            first, last = (np.array([p[1] == offsets[p[0]] for p in own]), np.array([p[2] == offsets[p[0] + 1] for p in own]))
            lengths = words + last
            tokens = np.full(int(lengths.sum()), END)
            keep = np.ones(len(tokens), bool)
            keep[(np.cumsum(lengths) - 1)[last]] = False
            tokens[keep] = h
            named, place, counts = distinct(np.r_[tokens, carried])  # the carried word has a number, too
            counts[place[-1]] -= 1
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            behind = rank[place[np.cumsum(lengths) - lengths - 1]]  # at the window's beginning that is the carried word
            before = np.where(first, -1, behind)
            train = ~held[text]
            body = (row + text, ids[text], none[text], held[text], lengths, before, _planes(rank[place[:-1]]), named[order])
            yield chunk, int(lengths[train].sum()), int((first & train).sum()), pickle.dumps(body, protocol=5)
            carried = tokens[-1] if len(tokens) else carried
            chunk, at = chunk + 1, to
        row += batch.num_rows


def _lists(body: Body, slices: int, pairs: bool) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """(slice, words, their training counts, pairs' last 32 bits, theirs) of a window's distinct words and pairs.

    All that are asked for, so held-out ones with count 0, too; without ``pairs`` only training pairs, as none is asked for.
    """
    train = ~body.per_token(body.held)
    order = np.argsort(body.hashes)
    words, counts = body.hashes[order], np.bincount(body.numbers[train], minlength=len(body.hashes))[order]
    keys, place, _ = distinct(body.pairs())
    often = np.bincount(place[train], minlength=len(keys))
    if not pairs:
        keys, often = keys[often > 0], often[often > 0]
    of_word, of_pair = slices_of(words, slices), slices_of(keys, slices)
    here = np.union1d(of_word, of_pair)
    cuts = [np.searchsorted(of, here, side) for of in (of_word, of_pair) for side in ("left", "right")]
    short = keys.astype(np.uint32)
    for s, a, b, c, d in zip(here.tolist(), *cuts, strict=True):
        yield s, words[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes(), short[c:d].tobytes(), often[c:d].astype(np.uint32).tobytes()


def _pack(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them, named by a byte."""
    kind = next(k for k in "BHIQ" if int(counts.max(initial=0)) < 256 ** np.dtype(k).itemsize)
    return kind.encode() + counts.astype(np.dtype(kind)).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.dtype(data[:1].decode()), offset=1).astype(np.int64)


ANSWERS = "slice long, chunk long, counts binary, levels binary, n_words long, region binary"


def _gather(pairs: bool):
    """The counts of a slice's words, the slice of the filter, and what the windows asked of either."""

    def scan(rows: pa.Table) -> pa.Table:
        def joined(name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
            each = [np.frombuffer(x.as_py(), kind) for x in rows[name]]
            return np.concatenate(each), np.cumsum([len(x) for x in each])[:-1]

        def summed(name: str, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            (keys, cuts), (counts, _) = joined(name, kind), joined(f"{name}_n", np.uint32)
            known, place, _ = distinct(keys)
            return known, place, np.bincount(place, weights=counts, minlength=len(known)).astype(np.int64), cuts

        _, place, counts, cuts = summed("words", np.uint64)
        n_words = int((counts > 0).sum())
        answers = [_pack(x) for x in np.split(counts[place], cuts)]
        short, place, counts, cuts = summed("pairs", np.uint32)
        seen = counts > 0
        region = build_region(short[seen], quantise(counts[seen]))
        levels = [b""] * rows.num_rows
        if pairs:
            found = LogFrequencyFilter(np.array([len(region)]), region).levels(short, np.zeros(len(short), np.int64))
            levels = [x.tobytes() for x in np.split(found[place], cuts)]
        only = np.arange(rows.num_rows) == 0
        out = {"slice": rows["slice"], "chunk": rows["chunk"], "counts": pa.array(answers, pa.binary()), "levels": pa.array(levels, pa.binary())}
        out |= {"n_words": pa.array(np.where(only, n_words, 0)), "region": pa.array([region.tobytes() if o and not pairs else None for o in only], pa.binary())}
        return pa.table(out)

    return scan


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(body: Body, counts: np.ndarray, levels: np.ndarray, total: int, texts: int, mu: float) -> pa.Table:
    """What a window adds to its rows; ``levels`` are those of its distinct pairs, ``counts`` of its sorted words."""
    own = np.zeros(len(body.hashes) + 1, np.int64)
    own[np.argsort(body.hashes)] = counts
    own[-1] = texts  # what stands before a text occurs once in each
    c = own[body.numbers]
    pair = low(levels)[distinct(body.pairs())[1]]
    history = np.maximum(own[body.previous()], pair)  # a pair that is found in error may exceed its history
    score = np.log10((pair + mu * (c + 1) / total) / (history + mu))
    ends = np.cumsum(body.lengths)

    def sums(x: np.ndarray) -> np.ndarray:
        some = body.lengths > 0
        out = np.zeros(len(ends), x.dtype)
        out[some] = np.add.reduceat(x, (ends - body.lengths)[some]) if some.any() else 0
        return out

    base = sums(np.log10(c + 1.0)) - body.lengths * math.log10(total)
    ids = pa.array(body.ids, pa.int64(), mask=body.none)
    return pa.table({"row": body.rows, "doc_id": ids, "held_out": body.held, "n_tokens": body.lengths.astype(np.int64), "n_known": sums((c > 0).astype(np.int64)), "base_score": base, "score": sums(score)})


def default_broadcast_bytes(spark: SparkSession) -> int:
    """A 32nd of an executor's memory: every Python worker of an executor holds the filter."""
    conf = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    named = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g")
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(named) // 32


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 2, folds: int = 7, mu: float = 200.0, broadcast_bytes: int | None = None) -> DataFrame:
    """Scores of every whole text; the rows of ``fold`` (by the id's crc32) are held out of training.

    Null texts are empty and consist of the end token. Without training rows N and V are 0. Null ids
    have remainder 0. Repeated rows are scored, and trained on, each for itself; very long texts are
    scored window by window; an empty table gives no rows; other columns are not read and may have any
    names. ``broadcast_bytes`` bounds what is broadcast (0: nothing is), never what is learnt.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    if broadcast_bytes is None:
        broadcast_bytes = default_broadcast_bytes(spark)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(id_col, folds) == fold).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in bodies_of(batches, TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_pydict(dict(zip(("chunk", "tokens", "texts", "body"), ([x] for x in found), strict=True)))

    bodies = materialize(narrow.mapInArrow(windows, "chunk long, tokens long, texts long, body binary"), "bodies")
    known = bodies.agg(F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts")).first()
    tokens, texts = known["tokens"] or 0, known["texts"] or 0
    slices = 1
    while slices * SLICE_TOKENS < tokens:
        slices *= 2
    asks = LEVELS_A_TOKEN * BITS_PER_LEVEL * tokens / 8 + 9 * slices > broadcast_bytes

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(chunk, *x) for x in _lists(Body(*pickle.loads(data.as_py())), slices, asks)]
                kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
                arrays = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["chunk", "slice", "words", "words_n", "pairs", "pairs_n"])
            trim()

    listed = bodies.select("chunk", "body").mapInArrow(lists, "chunk long, slice long, words binary, words_n binary, pairs binary, pairs_n binary")
    answers = materialize(listed.groupBy("slice").applyInArrow(_gather(asks), ANSWERS), "answers")
    vocabulary = answers.agg(F.sum("n_words")).first()[0] or 0
    total = tokens + vocabulary + 1
    shipped = None if asks else spark.sparkContext.broadcast(_whole(slices, answers))

    def score(body: pa.Table, found: pa.Table) -> pa.Table:
        window = Body(*pickle.loads(body["body"][0].as_py()))
        found = found.sort_by("slice")
        counts = np.concatenate([_unpack(x) for x in found["counts"].to_pylist()])
        if shipped is None:
            levels = np.frombuffer(b"".join(found["levels"].to_pylist()), np.uint8)
        else:
            keys = distinct(window.pairs())[0]
            levels = LogFrequencyFilter(*shipped.value).levels(keys.astype(np.uint32), slices_of(keys, slices))
        return _scores(window, counts, levels, total, texts, mu)

    replies = answers.select("chunk", "slice", "counts", "levels").groupBy("chunk")
    scored = bodies.select("chunk", "body").groupBy("chunk").cogroup(replies).applyInArrow(score, SCORED)
    rows = scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _whole(slices: int, answers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The filter's slices side by side, within ``broadcast_bytes`` by the bound on its levels."""
    sizes, found = np.zeros(slices, np.int64), {}
    for row in answers.where("region is not null").select("slice", "region").toLocalIterator():
        found[row["slice"]] = np.frombuffer(row["region"], np.uint8)
        sizes[row["slice"]] = len(found[row["slice"]])
    return sizes, np.concatenate([found[k] for k in sorted(found)] or [np.zeros(0, np.uint8)])

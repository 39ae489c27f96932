"""The registered queries: names, types and what their contracts promise, on the smallest tables."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from tests.llm import brute
from trialframe.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: What each contract names, in any order; more may follow.
COLUMNS = {
    "op2_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op3_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_embeddings": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op6_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7_lm_scores": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op8_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op9_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op11_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op12_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op13_lexical": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op10_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
}


def _table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in _table(spark, "documents")}


def _rows(spark, name):
    df = entry.queries()[name](spark, SF)
    assert dict(x.rsplit(" ", 1) for x in COLUMNS.get(name, "").split(", ") if x).items() <= dict(df.dtypes).items()
    return df.collect()


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14)) and queries.QUERIES.keys() <= entry.queries().keys()


def test_op1(spark, docs):
    rows = _rows(spark, "op1_sharding")
    assert sorted(r.doc_id for r in rows) == sorted(docs) and all(r.shard and r.shard_bytes > 0 and r.version >= 4 for r in rows)


def test_op2(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in _rows(spark, "op2_packing"):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == docs.keys()
    for i, own_pieces in pieces.items():
        ids = np.array([*own.encode(docs[i].text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(own_pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    padding = 0
    for row in sequences.values():
        at = 0
        for p in sorted(row, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0


def test_op3(spark, docs):
    labels = {r.doc_id: r.quality for r in _table(spark, "labels") if r.quality is not None}
    rows = _rows(spark, "op3_quality")
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.8


def test_op4(spark):
    vectors = {r.vec_id: r for r in _table(spark, "embeddings")}
    unit = {i: np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float)) for i, r in vectors.items() if r.embedding and r.label is not None}
    ids = sorted(unit)
    m = np.stack([unit[i] for i in ids])
    same = np.array([vectors[i].label for i in ids])
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero((m @ m.T >= 0.98) & (same[:, None] == same)), strict=True) if a < b]
    count = dict.fromkeys(vectors, 0)
    for pair in links:
        for i in pair:
            count[i] += 1
    roots = brute.components(vectors, links)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in _rows(spark, "op4_embeddings")} == {i: (count[i], roots[i], roots[i] == i) for i in vectors}


def test_op5(spark, docs):
    rows = {r.doc_id: r for r in _rows(spark, "op5_token_counts")}
    assert rows.keys() == docs.keys() and all(r.n_pretokens == len((docs[i].text or "").split()) <= r.n_tokens for i, r in rows.items())


def test_op6(spark, docs):
    rows = _rows(spark, "op6_mixing")
    size = {i: len(brute.words(d.text)) for i, d in docs.items()}
    total, own = defaultdict(int), defaultdict(int)
    for i, d in docs.items():
        total[d.source] += size[i]
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    targets = {}
    for r in rows:
        source = docs[r.doc_id].source
        assert (r["size"], r.source_size) == (size[r.doc_id], total[source]) and 0 <= r.taken <= 2 * r["size"]
        own[source] += r.taken
        targets[source] = r.target
    assert sum(targets.values()) == pytest.approx(min(1.5 * sum(total.values()), 2 * sum(total.values())))
    near = [abs(own[s] - targets[s]) / targets[s] for s in targets if targets[s]]
    assert np.median(near) < 0.01 and max(near) < 0.1


def test_op7(spark, docs):
    rows = {r.doc_id: r for r in _rows(spark, "op7_lm_scores")}
    tokens = {i: len(brute.words(d.text)) + 1 for i, d in docs.items()}
    train = sum(n for i, n in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2)
    assert {i: (r.n_tokens, r.train_tokens, r.held_out) for i, r in rows.items()} == {i: (n, train, zlib.crc32(str(i).encode()) % 7 == 2) for i, n in tokens.items()}
    held = [r for r in rows.values() if r.held_out]
    assert all(r.score <= 0 for r in rows.values()) and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op8(spark, docs):
    order = sorted(docs)
    follows = dict(zip(order, order[1:] + order[:1], strict=True))
    rows = {r.doc_id: r for r in _rows(spark, "op8_fingerprints")}
    assert rows.keys() == docs.keys()
    prints = {}
    for i, r in rows.items():
        text, after = docs[i].text or "", docs[follows[i]].text or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest()) and 0 <= r.near_next <= 1
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    assert np.mean([r.near_edited for r in rows.values()]) > np.mean([r.near_next for r in rows.values()]) + 0.3


def test_op9(spark, docs):
    fps = {i: brute.simhash(d.text) for i, d in docs.items()}
    ids = sorted(fps)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3]
    roots = brute.components(ids, links)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in _rows(spark, "op9_simhash")} == {i: (f"{fps[i]:016x}", roots[i]) for i in ids}


def test_op10(spark):
    pages = {r.page_id: (r.html or "").encode() for r in _table(spark, "pages")}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    want = {i: (len(p), hashlib.sha256(p).hexdigest(), *(("revisit", first[p]) if len(p) >= 100 and first[p] != i else ("response", None))) for i, p in pages.items()}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in _rows(spark, "op10_warc")} == want


def test_op11(spark):
    own = defaultdict(list)
    for r in _table(spark, "conversations"):
        own[r.conv_id].append((r.turn, r.role, r.text))
    assert {r.conv_id: tuple(r)[1:] for r in _rows(spark, "op11_repair")} == {i: brute.repaired(brute.damaged(i, rows)) for i, rows in own.items()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    import duckdb

    with duckdb.connect() as sql:
        for table in ("embeddings", "documents", "benchmark", "pages", "conversations"):
            sql.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        found = sql.execute(queries.ORACLES[name])
        columns = [c[0] for c in found.description]
        want = found.fetchall()
    assert want and sorted((tuple(r[c] for c in columns) for r in _rows(spark, name)), key=repr) == sorted(want, key=repr)

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import brute
from trialframe.llm import packing
from trialframe.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "a", "It's <|endoftext|> 'S they'LL x<|startoftext|>y", "İstanbul ΑΣ ΑΣ. é é ﬁ", "1234 5²½ a\x1cb\x85c\xa0d e", "日本語 テキスト", "퟿😀👍🏽", "q" * 3000, "--- ... !!!\n\n\ttab"]


def _texts():
    r = random.Random(1)
    return ODD + ["".join(r.choice("abcdeT ,.\n'é1") for _ in range(r.choice([3, 50, 900, 9000, 60000]))) for _ in range(60)]


def test_ids_equal_the_library(spark):
    model, own, texts = Tokenizer.from_file(PATH), WordTokenizer(PATH), _texts()
    for _ in range(2):
        for text, ids in zip(texts, own.ids(texts), strict=True):
            assert np.frombuffer(ids, np.uint32).tolist() == model.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [64, 4096])
def test_every_id_once_without_padding(spark, capacity):
    model, texts = Tokenizer.from_file(PATH), _texts()
    docs = brute.documents(spark, texts).repartition(3)
    rows = packing.pack(docs, PATH, capacity).collect()
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in packing.piece_digests(packing.pack(docs, PATH, capacity)).collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert digests[r.doc_id, r.start] == zlib.crc32(r.ids)
    for i, text in enumerate(texts):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert b"".join(bytes(r.ids) for r in own) == np.array(ids, np.uint32).tobytes()
        assert {r.doc_tokens for r in own} == {len(ids)}
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        n = sum(r.length for r in own)
        assert n <= capacity and n & (n - 1) == 0


def test_a_class_takes_a_fixed_count():
    packer, done = packing.HarmonicPacker(12), []
    for k, n in enumerate([5, 5, 9, 4, 4, 3, 1]):
        done += [[(p[0], len(p[2])) for p in s] for s in packer.add(k, np.arange(n, dtype=np.uint32))]
    assert done[0] == [(0, 5), (1, 5), (2, 2)]  # two of class 2, topped up from the next document
    assert [(d, n) for d, n in done[1]][0] == (2, 7)  # its rest is of class 1
    left = [[(p[0], len(p[2])) for p in s] for s in packer.finish()]
    assert sum(n for s in done + left for _, n in s) == 31


def test_empty_and_null_ids(spark):
    docs = brute.documents(spark, ["a"]).selectExpr("cast(null as long) doc_id", "text")
    assert [r.doc_id for r in packing.pack(docs, PATH).collect()] == [None]
    assert packing.pack(docs.where("false"), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, 1000)

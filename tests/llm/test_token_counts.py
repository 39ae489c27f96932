from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from tests.llm import brute
from trialframe.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def _plain(word, vocabulary, unknown):
    w = token_counts.MARK + word
    best = [(0.0, 0)] + [None] * len(w)
    for i in range(1, len(w) + 1):
        cost = len(w[i - 1].encode())
        options = [(best[i - 1][0] + unknown * cost, best[i - 1][1] + cost)]
        options += [(best[j][0] + vocabulary[w[j:i]], best[j][1] + 1) for j in range(max(0, i - 60), i) if w[j:i] in vocabulary]
        best[i] = max(options, key=lambda o: (o[0], -o[1]))
    return best[-1][1]


def test_counts_equal_a_plain_search_and_the_library():
    r = random.Random(6)
    vocabulary = token_counts.unigram_vocabulary(PATH)
    trie = token_counts.SharedTrie(vocabulary)
    words = ["".join(r.choice("abcdeinrstéß.ж日") for _ in range(r.randint(1, 14))) for _ in range(500)] + ["the", "internationalization", "日本語", "ab" * 200]
    want = [_plain(w, vocabulary, trie.unknown) for w in words]
    assert [trie.count(w) for w in words] == want == [trie.count(w) for w in words]
    library = Tokenizer(models.Unigram([("<unk>", -100.0), *vocabulary.items()], unk_id=0))
    library.pre_tokenizer = pre_tokenizers.Metaspace()
    known = [w for w in words if all(c in vocabulary for c in w)]
    off = sum(len(library.encode(w).ids) != trie.count(w) for w in known)
    assert len(known) > 300 and off == 0


def test_prefixes_are_scored_once():
    trie = token_counts.SharedTrie({"▁": -1.0, "a": -2.0, "b": -2.0, "▁ab": -2.5})
    assert [trie.count(w) for w in ("ab", "aba", "abb", "ab")] == [1, 2, 2, 1]
    assert trie.visited == 5  # mark, a, b, and one node for each longer word


def test_texts_of_every_kind(spark):
    vocabulary = token_counts.unigram_vocabulary(PATH)
    unknown = min(vocabulary.values()) - 10
    texts = ["the cat sat", None, "", " \n\t", "the cat sat", "q" * 5000, "a b c", "x " * 20_000]
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(brute.documents(spark, texts), PATH).collect()}
    want = {i: (len((t or "").split()), sum(_plain(w, vocabulary, unknown) for w in (t or "").split()[:50])) for i, t in enumerate(texts)}
    want[7] = (20_000, 20_000 * _plain("x", vocabulary, unknown))
    assert got == want
    assert token_counts.token_counts(brute.documents(spark, texts).where("false"), PATH).count() == 0


def test_words_of_a_batch_are_counted_together():
    r = random.Random(8)
    vocabulary = token_counts.unigram_vocabulary(PATH)
    words = ["".join(r.choice("aabcdeinrsttéß.ж日😀▁ ") for _ in range(r.randint(0, 16))) for _ in range(3000)]
    words += ["the", "them", "theme", "z" * 64, "z" * 65, "ab" * 32]
    trie = token_counts.SharedTrie(vocabulary)
    distinct = sorted(set(words))
    assert trie.grow(distinct).tolist() == [_plain(w, vocabulary, trie.unknown) for w in distinct]
    assert token_counts.SharedTrie(vocabulary).counts([words[:9], [], words[9:]]) == [sum(_plain(w, vocabulary, trie.unknown) for w in part) for part in (words[:9], [], words[9:])]
    shared = token_counts.SharedTrie({"▁": -1.0, "a": -2.0, "b": -2.0, "▁ab": -2.5})
    assert shared.grow(["ab", "aba", "abb"]).tolist() == [1, 2, 2] and shared.visited == 5
    assert shared.grow([]).tolist() == [] and token_counts.SharedTrie({}).counts([["ab"]]) == [3 + 2]


def test_a_full_trie_starts_anew():
    vocabulary = {"▁": -1.0, "a": -2.0, "b": -2.0}
    small, large = token_counts.SharedTrie(vocabulary, 3), token_counts.SharedTrie(vocabulary)
    texts = [["ab", "ba"], ["bb", "ab"], ["ab"]]
    assert [small.counts([t])[0] for t in texts] == [large.counts([t])[0] for t in texts] == [6, 6, 3]

"""Ids of a word-level BPE vocabulary, with a bounded memory of pre-tokens already cut.

White space separates words and is dropped by such a vocabulary, so a text's ids are its
pre-tokens' ids in turn. Rare pre-tokens cost a merge each; frequent ones a look-up.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Text that needs no Unicode normalisation and whose letter classes every regex engine agrees on.
PLAIN = re.compile("[ \n!-~¡-¬®-ÿ]*").fullmatch
#: The vocabulary's own split into pre-tokens, for plain lower-case text (a fixed value of its file).
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^ \na-zªµºß-öø-ÿ0-9²³¹¼½¾]+").findall
MEMORY = 150_000
#: Characters whose pre-tokens are held at once, unless one text is longer.
GROUP = 2_000_000


class _Recent(dict):
    """A map that forgets what it has not used lately: two generations of bounded size."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size, self.old = size, {}

    def turn(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


class WordTokenizer:
    """``ids(texts)`` equals the library's own ``encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str) -> None:
        # the executor's cores have tasks of their own; threads would only add memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocab = self.model.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, at in vocab.items():
            self.ends[at] = token.endswith("</w>")
        special = [re.escape(t.content) for t in self.model.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or "(?!)").search
        self.parts = _Recent(MEMORY)

    def rest(self) -> None:
        """Forget what was not used lately; called when a task ends, as its worker stays."""
        self.parts.old = {}

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _split(self, text: str) -> list[str]:
        """The text's pre-tokens; words that only the library cuts safely stay whole."""
        if PLAIN(text) and not self.special(text):
            return SPLIT(text.lower())
        out = []
        for w in text.replace("\n", " ").split(" "):
            if PLAIN(w) and not self.special(w):
                out += SPLIT(w.lower())
            else:
                out.append(w)
        return out

    def _learn(self, parts: Iterable[str]) -> None:
        plain, odd = [], []
        for part in parts:
            known = self.parts.old.get(part)
            if known is not None:
                self.parts[part] = known
            elif PLAIN(part) and not self.special(part):
                plain.append(part)
            else:
                odd.append(part)
        lines = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for line, ids in zip(lines, self._encode([" ".join(x) for x in lines]), strict=True):
            got = np.array(ids, np.uint32)
            cuts = (4 * np.flatnonzero(self.ends[got]) + 4).tolist()
            if len(cuts) != len(line):  # a part that the vocabulary cuts differently
                odd += line
                continue
            data = got.tobytes()
            self.parts.update((p, data[a:b]) for p, a, b in zip(line, [0, *cuts], cuts, strict=False))
        for w, ids in zip(odd, self._encode(odd), strict=True):
            self.parts[w] = np.array(ids, np.uint32).tobytes()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for group in groups(texts):
            self.parts.turn()
            split = [self._split(t) for t in group]
            known = self.parts
            self._learn([p for p in set().union(*split) if p not in known])
            get = known.__getitem__
            out += [b"".join(map(get, s)) for s in split]
        return out


def groups(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, in runs of about ``GROUP`` characters."""
    run, size = [], 0
    for text in texts:
        run.append(text or "")
        size += len(run[-1])
        if size >= GROUP:
            yield run
            run, size = [], 0
    if run:
        yield run

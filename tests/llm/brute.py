"""Plain versions that the operators are held against."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, copies int, component string"


def documents(spark, texts, sources=None, first=0):
    rows = [(first + i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], len(t or ""), "x", -1, "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def simhash(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def damaged(conv, rows):
    """(turn, role, text) after the damage that op11's contract names; nulls are one blank, null turns come first."""
    out = []
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        out += [] if case == 0 else [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        visible = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256): the cheapest edits by a search in order of cost and letters."""
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, role, lines = heapq.heappop(heap)
        if (at, role) in done:
            continue
        done.add((at, role))
        if at == len(rows) and role in ("", "a"):
            break

        def go(more, letter, step, name, text, cost=cost, audit=audit, at=at, role=role, lines=lines):
            if name and role + name[:1] in ("s", "u", "su", "ua", "au"):
                heapq.heappush(heap, (cost + more, audit + letter, at + step, name[:1], (*lines, f"{name}:{text}")))

        go(3, "I", 0, "user", "")
        go(3, "I", 0, "assistant", "")
        if at < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, role, lines))
            if found[at] in (None, "truncated"):
                stays = 3 if found[at] else 0
                go(stays, "K", 1, *rows[at][1:])
                go(stays + 3, "R", 1, "user", rows[at][2])
                go(stays + 3, "R", 1, "assistant", rows[at][2])
    return (gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())

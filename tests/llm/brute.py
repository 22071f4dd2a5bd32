"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import xxhash


class Union:
    def __init__(self, n):
        self.root = list(range(n))

    def find(self, x):
        while self.root[x] != x:
            x = self.root[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


def fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(docs, bits=2):
    """Number of the first member of each document's component."""
    prints = [fingerprint(t) for _, t in docs]
    sets = Union(len(docs))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                sets.join(i, j)
    return [sets.find(i) for i in range(len(docs))]


def simhash(docs, bits=2):
    """[(id, fingerprint hex, component id)] of [(id, text)]."""
    roots, low = groups(docs, bits), {}
    for r, (ident, _) in zip(roots, docs):
        if ident is not None:
            low[r] = min(low.get(r, ident), ident)
    return [(ident, f"{fingerprint(t):016x}", low.get(r)) for r, (ident, t) in zip(roots, docs)]


def repeats(docs, length=100):
    """[(id, n_bytes, n_removed, n_spans, sha256)] of [(id, text)] in order of id."""
    seen, out = set(), []
    for ident, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p:p + length]
            if w in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for q in range(len(raw)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((ident, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def duplicate_lines(docs, normal, shingles, similarity):
    """{(id, line): (kept id, kept line)} of [(id, text)] in order of id."""
    where = [(normal(x), i, k) for i, t in docs for k, x in enumerate((t or "").split("\n")) if normal(x)]
    first = {}
    for line, i, k in where:
        first.setdefault(line, (i, k))
    lines = list(first)
    sets, parts = Union(len(lines)), [shingles(x) for x in lines]
    for i in range(len(lines)):
        for j in range(i):
            both = len(parts[i] & parts[j])
            if both >= similarity * (len(parts[i]) + len(parts[j]) - both):
                sets.join(i, j)
    at = {x: i for i, x in enumerate(lines)}
    keep = {}
    for i, x in enumerate(lines):
        r = sets.find(i)
        keep[r] = min(keep.get(r, first[x]), first[x])
    return {(i, k): keep[sets.find(at[x])] for x, i, k in where if keep[sets.find(at[x])] != (i, k)}


def units(text):
    raw = (text or "").encode("utf-16-le")
    return list(struct.unpack(f"<{len(raw) // 2}H", raw))


class Model:
    """Witten-Bell four-gram model."""

    def __init__(self, texts, vocabulary):
        self.vocabulary, self.count, self.total, self.types = vocabulary, Counter(), Counter(), Counter()
        for t in texts:
            u = [0, 0, 0, *units(t)]
            for i in range(3, len(u)):
                for k in range(1, 5):
                    self.count[tuple(u[i - k + 1:i + 1])] += 1
        for g, n in self.count.items():
            self.total[len(g), g[:-1]] += n
            self.types[len(g), g[:-1]] += 1

    def loss(self, gram):
        p = 1 / self.vocabulary
        for k in range(1, 5):
            g = gram[-k:]
            n, t = self.total[k, g[:-1]], self.types[k, g[:-1]]
            if n:
                p = (self.count[g] + t * p) / (n + t)
        return -math.log(p)


def cross_entropy(docs, targets):
    """{id: (tokens, target loss, background loss)} of [(id, text)]; losses None without tokens."""
    size = len({x for _, t in docs for x in units(t)})
    background = Model([t for _, t in docs], size)
    target = Model([t for i, t in docs if i in targets], size)
    out = {}
    for i, t in docs:
        u = [0, 0, 0, *units(t)]
        each = [tuple(u[k - 3:k + 1]) for k in range(3, len(u))]
        n = len(each)
        out[i] = (n, *(sum(map(m.loss, each)) / n if n else None for m in (target, background)))
    return out


def best_substring_edits(pattern, text):
    """Fewest edits that turn ``pattern`` into some substring of ``text``."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def top_k(vectors, k=10):
    """[(query id, rank, id, score)] of [(id, integers)]."""
    out = []
    for q, v in vectors:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


def rebuilt(rows):
    """conv -> [(role, text)] of op11's rebuilt conversations, from (conv, turn, role, text) rows."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [r[3:] for r in sorted(t)] for c, t in own.items()}
    out = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - c % 20, [])[:h] + t[h:]
    return out


def prefix_trie(convs):
    """Contract rows of the trie of conv -> turns."""
    members, children = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = sum(saved[k] for k in below) + (len(members[node]) - 1) * words
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(convs[c]) == len(node))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children.get(node, [])),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def language_profile(texts, most=300):
    counts = Counter()
    for text in texts:
        for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            padded = f" {word} "
            counts.update(word)
            counts.update(padded[i:i + 2] for i in range(len(padded) - 1))
            counts.update(padded[i:i + 3] for i in range(len(padded) - 2))
    return sorted(counts, key=lambda g: (-counts[g], g))[:most]


def languages(docs):
    """[(id, held_out, lang_pred, score)] of [(id, text, lang)]."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in docs]
    texts = {}
    for (i, text, lang), out in zip(docs, held):
        if lang is not None and i is not None and not out:
            texts.setdefault(lang, []).append(text)
    profiles = {lang: p for lang, t in texts.items() if (p := language_profile(t))}
    found = []
    for (i, text, _), out in zip(docs, held):
        own, best = language_profile([text]), None
        for lang, profile in profiles.items():
            rank = {g: r for r, g in enumerate(profile)}
            distance = sum(abs(rank[g] - r) if g in rank else 300 for r, g in enumerate(own))
            best = min(best or (distance, lang), (distance, lang))
        found.append((i, out, best[1], 1 - best[0] / (300 * len(own))) if own and best else (i, out, "und", 0.0))
    return found


def clusters(rows, k=8, rounds=10):
    """Contract rows of [(id, integer vector)], starts in order of hashed id."""
    def start(row):
        return (row[0] is None, hashlib.sha256(f"3:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1])

    centers = [list(v) for _, v in sorted(rows, key=start)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in rows]
        for j in range(len(centers)):
            mine = [v for (_, v), o in zip(rows, own) if o == j]
            if mine:
                centers[j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(i, *nearest(v)[::-1]) for i, v in rows]
    total = Counter()
    for _, j, d in found:
        total[j] += d
    return [(i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest())
            for i, j, d in found]

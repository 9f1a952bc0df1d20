"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import xxhash


def fingerprint(text, words=3):
    parts = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or [b" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict[int, int], radius=3):
    """doc_id -> least doc_id reachable."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def repeats(texts: dict[int, str | None], length=50):
    """doc_id -> (bytes removed, maximal runs, remaining bytes)."""
    data = {i: (t or "").encode() for i, t in texts.items()}
    first: dict[bytes, int] = {}
    for i in sorted(data):
        for at in range(len(data[i]) - length + 1):
            first.setdefault(data[i][at : at + length], i)
    out = {}
    for i, d in data.items():
        gone = bytearray(len(d))
        for at in range(len(d) - length + 1):
            if first[d[at : at + length]] < i:
                gone[at : at + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i] = sum(gone), runs, bytes(b for b, g in zip(d, gone, strict=True) if not g)
    return out


def similar(texts, words=5, least=0.8):
    """doc_id -> least doc_id reachable over pairs of similar shingle sets."""
    sets = {}
    for i, text in texts.items():
        parts = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[i] = {b" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if min(len(sets[a]), len(sets[b])) >= least * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def languages(rows, code, buckets=8192, sharpness=6.0, ambiguous=0.5):
    """doc_id -> (held out, language, score, ambiguous); rows (doc_id, text, lang). code gives the codewords."""

    def grams(text):
        data = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in f" {text.lower()} ".encode())
        mixed = ((a << 16 | b << 8 | c) * 2654435761 % 2**32 for a, b, c in zip(data, data[1:], data[2:], strict=False))
        return Counter(m >> 19 for m in mixed)

    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    lettered = {i: any(c.isalpha() for c in text or "") for i, text, _ in rows}
    total: dict[str, Counter] = {}
    for i, text, lang in rows:
        if lang is not None and not held[i] and lettered[i]:
            total.setdefault(lang, Counter()).update(grams(text))
    names = sorted(total)
    words = code(len(names)).tolist()
    share = [[(total[n][b] + 1) / (sum(total[n].values()) + buckets) for b in range(buckets)] for n in names]
    bits = range(len(words[0]))
    radius = (min((sum(a != b for a, b in zip(x, y, strict=True)) for n, x in enumerate(words) for y in words[:n]), default=1) - 1) // 2
    odds, scale, weight = [], [], [[0.0] * len(words[0]) for _ in names]
    for bit in bits:
        one, zero = ([k for k in range(len(names)) if words[k][bit] == side] for side in (1, -1))
        mean = lambda ks, b: sum(share[k][b] for k in ks) / max(len(ks), 1) + 1e-12
        odds.append([math.log(mean(one, b)) - math.log(mean(zero, b)) for b in range(buckets)])
        apart = [words[k][bit] * sum(s * o for s, o in zip(share[k], odds[bit], strict=True)) for k in range(len(names))]
        scale.append(1 / max(sum(map(abs, apart)) / len(apart), 1e-9))
        for k, x in enumerate(apart):
            weight[k][bit] = max(x * scale[bit], 1e-3)
    out = {}
    for i, text, _ in rows:
        if not lettered[i]:
            out[i] = held[i], "und", 0.0, True
            continue
        seen = grams(text)
        margin = [scale[b] * sum(n * odds[b][g] for g, n in seen.items()) / max(sum(seen.values()), 1) for b in bits]
        loss = [sum(w * math.log1p(math.exp(-2 * m * c)) for w, m, c in zip(weight[k], margin, words[k], strict=True)) / sum(weight[k]) for k in range(len(names))]
        best = min(range(len(names)), key=loss.__getitem__)
        score = 1 / sum(math.exp(-sharpness * (x - loss[best])) for x in loss)
        off = sum((m > 0) - (m < 0) != c for m, c in zip(margin, words[best], strict=True))
        out[i] = held[i], names[best], score, off > radius and score < ambiguous
    return out

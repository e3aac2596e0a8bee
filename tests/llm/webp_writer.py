"""A small writer of lossless WebP images that uses whatever part of the format it is told to."""

import struct

import numpy as np

from rankloom.llm.webp import CODE_LENGTH_ORDER, HASH, NEAR


class Bits:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, x, n):
        assert 0 <= x < 1 << n or n == 0
        self.value |= x << self.n
        self.n += n


def code_lengths(counts, most):
    """Lengths of a prefix code, by merging the rarest; flattened until none is longer than `most`."""
    used = [k for k, c in enumerate(counts) if c]
    lengths = [0] * len(counts)
    if len(used) == 1:
        lengths[used[0]] = 1
        return lengths
    floor = 1
    while True:
        heap = sorted((max(counts[k], floor), [k]) for k in used)
        lengths = [0] * len(counts)
        while len(heap) > 1:
            (a, x), (b, y) = heap[:2]
            for k in x + y:
                lengths[k] += 1
            heap = sorted([*heap[2:], (a + b, x + y)])
        if max(lengths) <= most:
            return lengths
        floor *= 2


def canonical(lengths):
    codes, value, last = {}, 0, 0
    for n, k in sorted((n, k) for k, n in enumerate(lengths) if n):
        value <<= n - last
        last = n
        codes[k] = int(format(value, f"0{n}b")[::-1], 2)
        value += 1
    return codes


class Code:
    def __init__(self, bits, counts, simple=True):
        used = [k for k, c in enumerate(counts) if c] or [0]
        self.lengths = [0] * len(counts)
        if simple and len(used) <= 2 and max(used) < 256:
            bits.put(1, 1)
            bits.put(len(used) - 1, 1)
            wide = used[0] > 1
            bits.put(int(wide), 1)
            bits.put(used[0], 8 if wide else 1)
            if len(used) == 2:
                bits.put(used[1], 8)
            for k in used:
                self.lengths[k] = 1
        else:
            self.lengths = code_lengths([c if k in used else 0 for k, c in enumerate([max(c, int(k in used)) for k, c in enumerate(counts)])], 15)
            tokens, k = [], 0
            while k < len(self.lengths):
                run = 1
                while k + run < len(self.lengths) and self.lengths[k + run] == self.lengths[k]:
                    run += 1
                n = self.lengths[k]
                if n == 0 and run >= 3:
                    run = min(run, 138)
                    tokens.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
                elif n and run >= 4:
                    run = min(run, 7)
                    tokens += [(n, 0, 0), (16, run - 4, 2)]
                else:
                    run = 1
                    tokens.append((n, 0, 0))
                k += run
            while tokens and tokens[-1][0] in (0, 17, 18):
                tokens.pop()
            counts_of = [sum(t[0] == s for t in tokens) for s in range(19)]
            inner = code_lengths(counts_of, 7)
            bits.put(0, 1)
            last = max(k for k, s in enumerate(CODE_LENGTH_ORDER) if inner[s])
            bits.put(max(last + 1, 4) - 4, 4)
            for s in CODE_LENGTH_ORDER[: max(last + 1, 4)]:
                bits.put(inner[s], 3)
            bits.put(1, 1)
            bits.put(4, 3)
            bits.put(max(len(tokens), 2) - 2, 10)
            while len(tokens) < 2:
                tokens.append((0, 0, 0)) if inner[0] else tokens.append(tokens[0])
            codes = canonical(inner)
            single = sum(n > 0 for n in inner) == 1
            for s, extra, n in tokens:
                bits.put(0 if single else codes[s], 0 if single else inner[s])
                bits.put(extra, n)
        self.codes = canonical(self.lengths)
        self.single = sum(n > 0 for n in self.lengths) == 1

    def put(self, bits, symbol):
        if not self.single:
            bits.put(self.codes[symbol], self.lengths[symbol])


def prefixed(x):
    if x <= 4:
        return x - 1, 0, 0
    high = (x - 1).bit_length() - 1
    return 2 * high + ((x - 1) >> (high - 1) & 1), (x - 1) & ((1 << (high - 1)) - 1), high - 1


def entropy_image(bits, words, width, cache_bits=0, references=False, groups=None, top=False, simple=True):
    """words: ARGB; groups: (size bits, group numbers by block) for the main image."""
    words = [int(w) for w in words]
    bits.put(int(bool(cache_bits)), 1)
    if cache_bits:
        bits.put(cache_bits, 4)
    if top:
        bits.put(int(groups is not None), 1)
        if groups is not None:
            size, numbers = groups
            bits.put(size - 2, 3)
            entropy_image(bits, [n << 8 for n in numbers.ravel()], numbers.shape[1])
    cache, items, at = [0] * (1 << cache_bits), [], 0
    near = {x + y * width: k + 1 for k, (x, y) in reversed(list(enumerate(NEAR))) if x + y * width >= 1}
    while at < len(words):
        best = (0, 0)
        if references:
            for d in {1, 2, width - 1, width, width + 1, 5 * width, 130, 300} - {0}:
                if 0 < d <= at:
                    n = 0
                    while at + n < len(words) and n < 4096 and words[at + n] == words[at + n - d]:
                        n += 1
                    best = max(best, (n, d))
        slot = (HASH * words[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if best[0] >= 3:
            n, d = best
            items.append((at, "ref", prefixed(n), prefixed(near.get(d, d + 120))))
        elif cache_bits and cache[slot] == words[at]:
            n = 1
            items.append((at, "cache", slot))
        else:
            n = 1
            items.append((at, "pixel", words[at]))
        for w in words[at : at + n]:
            if cache_bits:
                cache[(HASH * w & 0xFFFFFFFF) >> (32 - cache_bits)] = w
        at += n
    group_of = (lambda at: 0) if groups is None else lambda at: int(groups[1][(at // width) >> groups[0], (at % width) >> groups[0]])
    total = 1 if groups is None else int(groups[1].max()) + 1
    counts = [[[0] * n for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(total)]
    for at, kind, *rest in items:
        c = counts[group_of(at)]
        if kind == "ref":
            c[0][256 + rest[0][0]] += 1
            c[4][rest[1][0]] += 1
        elif kind == "cache":
            c[0][280 + rest[0]] += 1
        else:
            w = rest[0]
            for k, x in zip((0, 1, 2, 3), (w >> 8 & 255, w >> 16 & 255, w & 255, w >> 24)):
                c[k][x] += 1
    codes = [[Code(bits, x, simple) for x in c] for c in counts]
    for at, kind, *rest in items:
        code = codes[group_of(at)]
        if kind == "ref":
            code[0].put(bits, 256 + rest[0][0])
            bits.put(rest[0][1], rest[0][2])
            code[4].put(bits, rest[1][0])
            bits.put(rest[1][1], rest[1][2])
        elif kind == "cache":
            code[0].put(bits, 280 + rest[0])
        else:
            w = rest[0]
            for k, x in zip((0, 1, 2, 3), (w >> 8 & 255, w >> 16 & 255, w & 255, w >> 24)):
                code[k].put(bits, x)


def words_of(rgba):
    x = rgba.astype(np.uint32)
    return x[..., 3] << 24 | x[..., 0] << 16 | x[..., 1] << 8 | x[..., 2]


def file_of(bits):
    chunk = bits.value.to_bytes(-(-bits.n // 8), "little")
    body = b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def predicted(argb, y, x, mode):
    """The prediction for a pixel of (alpha, red, green, blue) rows, after the format's text."""
    h, w, _ = argb.shape
    at = lambda yy, xx: [int(v) for v in argb[yy, xx]]
    if x == 0 and y == 0:
        return [255, 0, 0, 0]
    if y == 0:
        return at(0, x - 1)
    if x == 0:
        return at(y - 1, 0)
    left, top, corner = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)
    right = at(y - 1, x + 1) if x + 1 < w else at(y, 0)
    avg = lambda a, b: [(p + q) // 2 for p, q in zip(a, b)]
    clip = lambda v: max(0, min(255, v))
    if mode == 11:
        p = [a + b - c for a, b, c in zip(left, top, corner)]
        return left if sum(abs(a - b) for a, b in zip(p, left)) < sum(abs(a - b) for a, b in zip(p, top)) else top
    return {
        0: lambda: [255, 0, 0, 0], 1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: avg(avg(left, right), top), 6: lambda: avg(left, corner), 7: lambda: avg(left, top), 8: lambda: avg(corner, top),
        9: lambda: avg(top, right), 10: lambda: avg(avg(left, corner), avg(top, right)), 12: lambda: [clip(a + b - c) for a, b, c in zip(left, top, corner)],
        13: lambda: [clip(a + int((a - b) / 2)) for a, b in zip(avg(left, top), corner)],
    }[mode]()


def encode(rgba, transforms=(), cache_bits=0, references=False, groups=None, modes=None, elements=None, size=2, simple=True):
    """`transforms` from predictor, cross, green, palette; modes and elements by blocks of 2**size pixels."""
    bits = Bits()
    h, w, _ = rgba.shape
    bits.put(0x2F, 8)
    bits.put(w - 1, 14)
    bits.put(h - 1, 14)
    bits.put(1, 1)
    bits.put(0, 3)
    argb = rgba[..., [3, 0, 1, 2]].astype(np.int64)
    signed = lambda v: (v & 255) - 256 * ((v & 255) > 127)
    inner = w
    for t in transforms:
        bits.put(1, 1)
        if t == "predictor":
            bits.put(0, 2)
            bits.put(size - 2, 3)
            entropy_image(bits, [int(m) << 8 for m in modes.ravel()], modes.shape[1])
            argb = np.array([[[(int(v) - p) & 255 for v, p in zip(argb[y, x], predicted(argb, y, x, int(modes[y >> size, x >> size])))] for x in range(inner)] for y in range(h)])
        elif t == "cross":
            bits.put(1, 2)
            bits.put(size - 2, 3)
            entropy_image(bits, [255 << 24 | int(r2b) << 16 | int(g2b) << 8 | int(g2r) for g2r, g2b, r2b in elements.reshape(-1, 3)], elements.shape[1])
            e = np.repeat(np.repeat(elements, 1 << size, 0)[:h], 1 << size, 1)[:, :inner].astype(np.int64)
            green, red = signed(argb[..., 2]), signed(argb[..., 1])
            argb = argb.copy()
            blue = argb[..., 3] - (signed(e[..., 1]) * green >> 5) - (signed(e[..., 2]) * red >> 5)
            argb[..., 1] = (argb[..., 1] - (signed(e[..., 0]) * green >> 5)) & 255
            argb[..., 3] = blue & 255
        elif t == "green":
            bits.put(2, 2)
            argb = argb.copy()
            for k in (1, 3):
                argb[..., k] = (argb[..., k] - argb[..., 2]) & 255
        else:
            bits.put(3, 2)
            table, index = np.unique(argb.reshape(-1, 4), axis=0, return_inverse=True)
            bits.put(len(table) - 1, 8)
            deltas = np.diff(table, axis=0, prepend=np.zeros((1, 4), np.int64)) & 255
            entropy_image(bits, [int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b) for a, r, g, b in deltas], len(table))
            packed = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            depth, index = 8 >> packed, index.reshape(h, inner)
            narrow = np.zeros((h, -(-inner >> packed)), np.int64)
            for x in range(inner):
                narrow[:, x >> packed] |= index[:, x] << (depth * (x & ((1 << packed) - 1)))
            inner = narrow.shape[1]
            argb = np.stack([np.full_like(narrow, 255), np.zeros_like(narrow), narrow, np.zeros_like(narrow)], 2)
    bits.put(0, 1)
    words = argb[..., 0] << 24 | argb[..., 1] << 16 | argb[..., 2] << 8 | argb[..., 3]
    entropy_image(bits, words.ravel(), inner, cache_bits, references, groups, True, simple)
    return file_of(bits)

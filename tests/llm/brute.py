"""Plain Python versions of the query contracts, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import accumulate


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def lower(s):
    return s.encode().lower().decode()


def digest(spans, order):
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order.index(s[2]))))


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((*m.span(), kind))
    return out


def secrets(text):
    out = []
    for kind, pattern, group, least in (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)):
        out += [(*m.span(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(item))
    lengths = {len(k) for k in windows}
    for doc_id, text in docs:
        w = bench_words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i : i + n]))
                if got:
                    hit |= set(range(i, i + n))
                    found |= got
        yield doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def ascii_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def shingle_set(text):
    w = ascii_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(docs):
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    pairs = {(a, b) for at in where.values() for a in at for b in at if a < b}
    for a, b in pairs:
        inter = len(sets[a] & sets[b])
        if 100 * inter >= 80 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def language_model(docs, order=3):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base, score) by direct formulas."""
    text = {i: [*ascii_words(t), None] for i, t in docs}
    c1 = Counter()
    levels = {n: Counter() for n in range(1, order + 1)}
    for i, w in text.items():
        if not held_out(i):
            c1.update(w)
            padded = ["<s>"] * (order - 1) + w
            levels[order].update(tuple(padded[k : k + order]) for k in range(len(w)))
    for n in range(order - 1, 0, -1):
        levels[n].update(g[1:] for g in levels[n + 1])

    def discount(counts):
        n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        d = [1 - 2 * y * n[1] / n[0] if n[0] else 0.5, 2 - 3 * y * n[2] / n[1] if n[1] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        return [0.0] + [x if 0 < x < k else k / 2 for k, x in enumerate(d, 1)]

    d = {n: discount(list(g.values())) for n, g in levels.items()}
    after = {n: defaultdict(list) for n in levels}
    for n, g in levels.items():
        for words, c in g.items():
            after[n][words[:-1]].append(c)
    n_all, types = sum(c1.values()), len(c1)

    def p(context, w):
        n = len(context) + 1
        below = 1 / (types + 1) if n == 1 else p(context[1:], w)
        counts = after[n].get(context)
        if not counts:
            return below
        c = levels[n].get((*context, w), 0)
        return (c - d[n][min(c, 3)]) / sum(counts) + sum(d[n][min(x, 3)] for x in counts) / sum(counts) * below

    for i, w in text.items():
        base = sum(math.log10((c1[x] + 1) / (n_all + types + 1)) for x in w)
        padded = ["<s>"] * (order - 1) + w
        score = sum(math.log10(p(tuple(padded[k : k + order - 1]), x)) for k, x in enumerate(w))
        yield i, held_out(i), len(w), sum(c1[x] > 0 for x in w), n_all, base, score
    language_model.sums = [sum(p(u, w) for w in [*c1, "?"]) for n in levels for u in list(after[n])[:8]]


def quality(texts):
    """{text: (votes, posterior, score)}: labellers, EM and scorer by plain loops, with all texts in the sample."""
    import numpy as np

    def measures(t):
        words, low = t.split(), t.lower().split()
        n, pairs = max(1, len(words)), list(zip(low, low[1:], strict=False))
        odd = sum(1 for c in t if not (re.match(r"[\w\s]", c) or c in ".,;:'\"()?!-"))
        ends = sum(a in ".!?" and b in " \n\r\t" for a, b in zip(t, t[1:], strict=False)) + (t[-1:] in (".", "!", "?"))
        return words, {"marks": (odd + t.count("!!") + t.count("??")) / n, "capitals": sum(w.isupper() for w in words) / n, "repeats": sum(a == b for a, b in pairs) / n, "separators": sum(w in ("|", "-", "•", "*", "::", "/") for w in words) / n, "ends": ends / n, "variety": len(set(pairs)) / max(1, len(pairs))}

    def votes(words, m):
        if not words:
            return (-1,) * 6
        bad = [-(m[k] >= limit) for k, limit in (("marks", 0.1), ("capitals", 0.25), ("repeats", 0.1), ("separators", 0.08))]
        if len(words) < 8:
            return (*bad, 0, 0)
        return (*bad, 1 if 0.02 <= m["ends"] <= 0.5 else -1, 1 if m["variety"] >= 0.8 else -1 if m["variety"] < 0.5 else 0)

    looks = {t: measures(t) for t in set(texts)}
    voted = {t: votes(*looks[t]) for t in looks}
    counts = Counter(voted[t] for t in texts)
    total, prior = sum(counts.values()), 0.8
    table = [[{-1: 0.4, 0: 0.3, 1: 0.3} for _ in range(6)], [{-1: 0.05, 0: 0.35, 1: 0.6} for _ in range(6)]]
    for _ in range(100):
        post = {}
        for v in counts:
            yes, no = prior, 1 - prior
            for i, x in enumerate(v):
                yes, no = yes * table[1][i][x], no * table[0][i][x]
            post[v] = prior if not any(v) else yes / (yes + no)
        prior = min(0.98, max(0.02, (sum(post[v] * n for v, n in counts.items()) + 8) / (total + 10)))
        for c in (0, 1):
            for i in range(6):
                own = {x: sum((post[v] if c else 1 - post[v]) * n for v, n in counts.items() if v[i] == x) + (2.0 if x == 2 * c - 1 else 0.5) for x in (-1, 0, 1)}
                table[c][i] = {x: w / sum(own.values()) for x, w in own.items()}

    def features(words, m):
        sign = lambda c: ("X" if c.isupper() else "x" if c.isalpha() else "9") if ord(c) < 0x250 and c.isalnum() else c
        shapes = Counter("".join(map(sign, w[:1] + w[-3:])) for w in words)
        n, named = max(1, len(words)), {}
        for k, c in shapes.items():
            named[f"w {k}"] = math.log2(1 + 64 * c / n)
        for k, v in m.items():
            named[f"s {k} {min(20, int(v * 20))}"], named[f"v {k}"] = 1.0, math.log2(1 + 64 * min(v, 4.0))
        named[f"n {int(math.log2(n))}"] = 1.0
        slots = defaultdict(float)
        for k, v in named.items():
            h = zlib.crc32(k.encode("utf-8", "surrogatepass"))
            slots[h >> 18] += v if h & 1 else -v
        norm = math.sqrt(sum(v * v for v in slots.values()))
        return {k: v / norm for k, v in sorted(slots.items())}

    rows = sorted((tuple(f), tuple(f.values()), post[voted[t]]) for t in looks if t.strip(" ") for f in [features(*looks[t])])
    bad = sum(1 - y for _, _, y in rows) / len(rows)
    weight = [0.5 / max(bad, 0.02) if y < 0.5 else 0.5 / max(1 - bad, 0.02) for _, _, y in rows]
    w, b, g2, gb2 = defaultdict(float), 0.0, defaultdict(lambda: 1e-8), 1e-8
    rng = np.random.default_rng(7)
    for _ in range(30):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 256)):
            g, gb = defaultdict(float), 0.0
            for i in part:
                slots, values, y = rows[i]
                z = sum(w[s] * v for s, v in zip(slots, values, strict=True)) + b
                e = weight[i] * (1 / (1 + math.exp(-min(30, max(-30, z)))) - y) / len(part)
                gb += e
                for s, v in zip(slots, values, strict=True):
                    g[s] += e * v
            for s in {*g, *w}:
                d = g[s] + 1e-5 * w[s]
                g2[s] += d * d
                w[s] -= 0.5 * d / math.sqrt(g2[s])
            gb2 += gb * gb
            b -= 0.5 * gb / math.sqrt(gb2)

    def score(words, m):
        return 0.0 if not words else 1 / (1 + math.exp(-sum(w[s] * v for s, v in features(words, m).items()) - b))

    return {t: (voted[t], post[voted[t]], score(*looks[t])) for t in looks}


def png(data):
    """Samples of an 8-bit grey PNG, one by one, and the filters of its rows."""
    at, parts = 8, {b"IDAT": b""}
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        parts[kind] = parts.get(kind, b"") + data[at + 8 : at + 8 + n]
        at += 12 + n
    width, height = (int.from_bytes(parts[b"IHDR"][i : i + 4], "big") for i in (0, 4))
    raw, rows, kinds = zlib.decompress(parts[b"IDAT"]), [[0] * (width + 1)], []
    for y in range(height):
        kind, *line = raw[y * (width + 1) : (y + 1) * (width + 1)]
        up, row = rows[-1], [0]
        for x, v in enumerate(line, 1):
            a, b, c = row[-1], up[x], up[x - 1]
            p = a + b - c
            guess = (0, a, b, (a + b) // 2, min((a, b, c), key=lambda q: abs(p - q)))[kind]
            row.append((v + guess) % 256)
        rows.append(row)
        kinds.append(kind)
    return [r[1:] for r in rows[1:]], kinds


def cosine_hash(rows):
    """24 hex digits from area means on 32 x 32 and their lowest cosine terms."""
    h, w, grid = len(rows), len(rows[0]), 32

    def share(i, n, g):
        return max(0.0, min((g + 1) * n / grid, i + 1) - max(g * n / grid, i)) * grid / n

    across = [[sum(r[x] * share(x, w, g) for x in range(g * w // grid, min(w, (g + 1) * w // grid + 1))) for g in range(grid)] for r in rows]
    small = [[sum(across[y][g] * share(y, h, k) for y in range(k * h // grid, min(h, (k + 1) * h // grid + 1))) for g in range(grid)] for k in range(grid)]
    cos = [[math.cos(math.pi / grid * u * (i + 0.5)) for i in range(grid)] for u in range(8)]
    half = [[sum(small[i][j] * cos[v][j] for j in range(grid)) for v in range(8)] for i in range(grid)]
    low = [round(sum(cos[u][i] * half[i][v] for i in range(grid)), 6) for u in range(8) for v in range(8)]
    rest = sorted(low[1:])
    bits = "".join("1" if x > rest[31] else "0" for x in low)
    flat = [v for r in rows for v in r]
    mean = sum(flat) / len(flat)
    spread = math.sqrt(sum((v - mean) ** 2 for v in flat) / len(flat))
    return f"{int(bits, 2):016x}{round(mean * 256) & 65535:04x}{round(spread * 256) & 65535:04x}"


def mixed(rows, targets, sizes):
    """{row: copies} of (row, source, size, u, weight): epochs first, then in the order of exponential keys."""
    out = {}
    for s, target in targets.items():
        own = [r for r in rows if r[1] == s]
        epochs = min(2, int(target // sizes[s])) if sizes[s] else 0
        budget, upto = max(0.0, target - epochs * sizes[s]), 0
        out |= {r[0]: epochs for r in own}
        if epochs < 2:
            for r in sorted(own, key=lambda r: -math.log(r[3]) / r[4]):
                upto += r[2]
                if upto - r[2] / 2 > budget:
                    break
                out[r[0]] += 1
    return out


def _words(text):
    return (text or "").encode().split()


def op11(docs, window=50):
    """doc_id: (n_words, n_removed, kept_sha256) from sets of whole windows."""
    least = {}
    for i, t in docs:
        w = _words(t)
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            least[key] = min(i, least.get(key, i))
    out = {}
    for i, t in docs:
        w = _words(t)
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def runs(w, least=24, times=3):
    """(start, length, period) of all runs, by comparing the words at each distance."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] == w[i + q]:
                j = i
                while j + q < len(w) and w[j] == w[j + q]:
                    j += 1
                if j + q - i >= max(least, times * q):
                    found.setdefault((i, j + q - i), q)
                i = j
            i += 1
    return sorted((a, n, q) for (a, n), q in found.items())


def op12(docs):
    out = {}
    for i, t in docs:
        w = _words(t)
        n, h = len(w), zlib.crc32(str("" if i is None else i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = runs(w)
        gone = {k for a, m, q in found for k in range(a + q, a + m)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
        lines = "".join(f"{a},{m},{q}\n" for a, m, q in found)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
    return out


def op13(docs, folder="/opt/tokenizers"):
    """Whole texts encoded at once; every byte knows its token of each side, and pairs of owners are the links."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
    plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    rest = [c for c in range(256) if c not in plain]
    letters = {chr(c): bytes([c]) for c in plain} | {chr(256 + k): bytes([c]) for k, c in enumerate(rest)}
    bytes_a = lambda k: b"".join(letters[c] for c in a.id_to_token(k))
    bytes_b = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("\u2581", " ").encode()
    rows = []
    for i, t in docs:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        p, q = [bytes_a(k) for k in x], [bytes_b(k) for k in y]
        if not t or b"".join(p) != (" " + t).encode() or b"".join(q) != (" " + t).encode():
            x, y, p, q = [], [], [], []
        owner_a, owner_b = ([k for k, piece in enumerate(pieces) for _ in piece] for pieces in (p, q))
        links = [(y[m], x[k]) for k, m in sorted(set(zip(owner_a, owner_b, strict=True)))]
        cut_a, cut_b = (set(accumulate(map(len, pieces))) for pieces in (p, q))
        parts, from_a, from_b = [], 0, 0
        for e in sorted(cut_a & cut_b):
            k, m = owner_a[e - 1] + 1, owner_b[e - 1] + 1
            parts.append(",".join(map(str, x[from_a:k])) + "|" + ",".join(map(str, y[from_b:m])))
            from_a, from_b = k, m
        rows.append((i, (len(x), len(y), len(parts)), links, sha(";".join(parts)) if x else ""))
    count = Counter(k for r in rows for k in r[2])
    most = defaultdict(int)
    for (side, _), n in count.items():
        most[side] = max(n, most[side])
    return {i: (*sizes, len(links), sum(count[k] == most[k[0]] for k in links), sum(count[k] for k in links), g) for i, sizes, links, g in rows}

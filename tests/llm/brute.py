"""Plain versions of the operators, to hold the distributed ones against."""

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(rows, window=50):
    """rows: (doc_id, text); one result for each row."""
    words = [(d, SPACE.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def decontaminate(rows, items, window=10):
    wanted = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wanted[tuple(w[k : k + window])].add(i)
    sizes = {len(k) for k in wanted}
    out = []
    for d, t in rows:
        w = ALNUM.findall(low(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wanted:
                    hit.update(range(k, k + n))
                    found |= {str(i) for i in wanted[x] if i is not None}
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0))
    return out


def near_duplicates(rows, k=4, percent=80):
    sets = []
    for d, t in rows:
        w = SPACE.findall(low(t))
        sets.append((d, frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()))
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    known = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, x) in enumerate(known):
        for b, y in known[i + 1 :]:
            if 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    out = []
    for d, s in sets:
        c = None if d is None else find(d) if s else d
        out.append((d, len(s), c, True if d is None else d == c))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def only_digits(s):
    return re.sub("[^0-9]", "", s)


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(only_digits(m)) <= 19 and luhn(only_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(only_digits(m)) <= 15),
]
SECRETS = [
    ("assign", r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
]


def pii(text):
    out = []
    for kind, pattern, ok in PII:
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if ok(m[0])]
    return out


def secrets(text):
    out = []
    for n, (kind, pattern, ok) in enumerate(SECRETS):
        out += [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "", re.A) if ok(m)]
    return [x[2] for x in sorted(out)]


def kneser_ney(rows, stem=5, prune=0.3):
    """rows: (text, toxic), each text once; the evidence of each word of a text as a function, by dictionaries."""
    pairs = [Counter(), Counter()]
    for text, toxic in rows:
        w = ALNUM.findall(low(text))
        pairs[toxic].update(set(zip([None, *w[:-1]], w)))

    def d_of(counts):
        n = Counter(v for c in counts for v in c.values())
        return n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5

    def ratio(d, t, o, scale, below):
        return math.log(max(t - d, 0) * scale[1] + d * math.exp(below / 2)) - math.log(max(o - d, 0) * scale[0] + d * math.exp(-below / 2))

    def scales(mass):
        return [min(mass) / m if m > 0 else 0 for m in mass]

    def level(units, below):
        d = d_of(units)
        scale = scales([sum(c.values()) - d * len(c) for c in units])
        said = {}
        for u in {*units[0], *units[1]}:
            r = ratio(d, units[1][u], units[0][u], scale, below(u))
            said[u] = r if abs(r - below(u)) >= prune else below(u)
        return said, scale

    cut = lambda v: v.encode()[:stem]
    words = [Counter(v for _, v in c) for c in pairs]
    stems, _ = level([Counter(map(cut, c)) for c in words], lambda u: 0.0)
    said, whole = level(words, lambda u: stems[cut(u)])
    d = d_of(pairs)
    mass = [Counter(), Counter()]
    for k, c in enumerate(pairs):
        for (_, v), n in c.items():
            mass[k][v] += n
    known = {}
    for u, v in {*pairs[0], *pairs[1]}:
        t, o = pairs[1][u, v], pairs[0][u, v]
        if t + o > 1:
            r = ratio(d, t, o, whole if u is None else scales([mass[0][u], mass[1][u]]), said[v])
            if abs(r - said[v]) >= prune:
                known[u, v] = r

    def evidence(text):
        w = ALNUM.findall(low(text))
        return [known.get((u, v), said.get(v, stems.get(cut(v), 0.0))) for u, v in zip([None, *w[:-1]], w)]

    return evidence


def passages(evidence, sizes=(1, 3)):
    """The best mean over each size, a shorter text filled up with nothing, and the mean over all."""
    out = []
    for p in sizes:
        out.append(max(sum(evidence[i : i + p]) for i in range(len(evidence) - p + 1)) / p if len(evidence) >= p else sum(evidence) / p)
    return [*out, sum(evidence) / max(1, len(evidence))]

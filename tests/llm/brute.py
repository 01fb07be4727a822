"""Plain versions of the operators, for small inputs."""

import bisect
import math
import re
from collections import defaultdict


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(ids, linked):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {i: find(i) for i in ids}


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_duplicates(docs):
    """{id: (set size, component)} of (id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    common = defaultdict(int)
    for ids in at.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    return {i: (len(sets[i]), c) for i, c in components(sets, links).items()}


def license_words(text, phrases):
    """n_words, n_base, first_word, last_word, base_labels."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places, labels = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def overlaps(docs, items, window=13, agree=0.8, least=8):
    """{(doc, item)} by trying every alignment."""
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    known = {}
    for i, t in sorted(items):
        if len(w := tuple(words(t))) >= least:
            known.setdefault(w, i)
    out = set()
    for d, t in docs:
        w = words(t)
        for item, i in known.items():
            size = min(window, len(item))
            for s in range(-len(item) + 1, len(w)):
                same = [item[j] == w[j + s] for j in range(max(0, -s), min(len(item), len(w) - s))]
                best = max((sum(same[k : k + size]) for k in range(max(1, len(same) - size + 1))), default=0)
                if best >= -(-size * agree // 1):
                    out.add((d, i))
                    break
    return out


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


MASK = (1 << 64) - 1


def mixed(x):
    """splitmix64's finaliser."""
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def grams(text, size):
    """Buckets of all n-grams of a text, with their counts."""
    code, out = [ord(c) for c in text.lower()], defaultdict(int)
    for n in (1, 2, 3):
        for i in range(len(code) - n + 1):
            gram = n
            for c in code[i : i + n]:
                gram = (gram * 0x100000001B3 + c) & MASK
            out[mixed(gram) % size] += 1
    return out


def naive_bayes(train, texts, size=1 << 15, smoothing=0.5):
    """(language, posterior) of each text by a model of the (language, text) rows of train."""
    seen, total = {}, {}
    for lang, text in train:
        own = seen.setdefault(lang, defaultdict(int))
        for b, n in grams(text, size).items():
            own[b] += n
    for lang, own in seen.items():
        total[lang] = sum(own.values()) + smoothing * size
    out = []
    for text in texts:
        if not text or not any(c.isalpha() for c in text) or not seen:
            out.append(("und", 0.0))
            continue
        log_p = {lang: sum(n * math.log((seen[lang].get(b, 0) + smoothing) / total[lang]) for b, n in grams(text, size).items()) for lang in sorted(seen)}
        best = max(log_p, key=log_p.get)
        out.append((best, 1 / sum(math.exp(max(v - log_p[best], -700)) for v in log_p.values())))
    return out


def surface(text):
    """The features of one text, by their definitions."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    if not words:
        return [0.0] * 15
    kind = [2 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 6 if b > 127 else 0 if b < 33 or b == 127 else 4 if chr(b) in ".,;:'\"-?()" else 5 for b in raw]
    n = [kind.count(k) for k in range(7)]
    visible, letters = max(sum(n[1:]), 1), max(n[1] + n[2], 1)
    low = [w.lower() for w in words]
    lines = [tuple(re.findall(rb"[^\x20\x09-\x0d]+", line.lower())) for line in raw.split(b"\n")]
    lines = [line for line in lines if line]
    triples = {tuple(low[i : i + 3]) for i in range(len(low) - 2)}
    odd = lambda b: 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"-?()"
    count = len(words)
    return [
        math.log1p(count), sum(map(len, words)) / count, n[2] / letters, n[3] / visible, n[5] / visible, n[4] / count, n[6] / visible, len(set(low)) / count,
        sum(a == b for a, b in zip(low, low[1:])) / count, max(map(low.count, set(low))) / count, len(triples) / max(count - 2, 1) if count > 2 else 1.0,
        sum(len(line) for line in lines if lines.count(line) > 1) / count, math.log1p(count / len(lines)), sum(65 <= w[0] <= 90 for w in words) / count,
        sum(odd(w[0]) or odd(w[-1]) for w in words) / count,
    ]


def _cut(g, h, penalty):
    """Gain and place of the best cut of bins; of equal ones the first."""
    best, place, all_g, all_h, left_g, left_h = -math.inf, 0, sum(g), sum(h), 0.0, 0.0
    for k in range(1, len(g)):
        left_g, left_h = left_g + g[k - 1], left_h + h[k - 1]
        right_g, right_h = all_g - left_g, all_h - left_h
        gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - all_g**2 / (all_h + penalty) if left_h > 1e-9 and right_h > 1e-9 else 0.0
        if gain > best + 1e-9:
            best, place = gain, k
    return (best, place) if place else (0.0, 0)


def _leaves(g, h, depth, penalty):
    gain, k = _cut(g, h, penalty) if depth else (0.0, 0)
    if gain <= 1e-12:
        return [sum(g) / (sum(h) + penalty)] * len(g)
    return _leaves(g[:k], h[:k], depth - 1, penalty) + _leaves(g[k:], h[k:], depth - 1, penalty)


def boosted(x, y, bins=32, rounds=120, rate=0.15, penalty=2.0):
    """Main effects of cyclic boosting: scores of a function of feature rows. Without pairs."""
    share = min(max(sum(y) / len(y), 1e-3), 1 - 1e-3)
    base, tables, edges = math.log(share / (1 - share)), [], []
    for column in zip(*x, strict=True):
        v = sorted(column)
        at = [(len(v) - 1) * q / bins for q in range(1, bins)]
        edges.append(sorted({v[int(a)] + (v[min(int(a) + 1, len(v) - 1)] - v[int(a)]) * (a - int(a)) for a in at}))
        tables.append([0.0] * bins)
    place = lambda row: [bisect.bisect_right(e, value) for e, value in zip(edges, row, strict=True)]
    b, total = [place(row) for row in x], [base] * len(y)
    for _ in range(rounds):
        for j, own in enumerate(tables):
            g, h = [0.0] * bins, [0.0] * bins
            for row, t, truth in zip(b, total, y, strict=True):
                p = 1 / (1 + math.exp(-min(max(t, -30), 30)))
                g[row[j]] += truth - p
                h[row[j]] += max(p * (1 - p), 1e-6)
            step = [rate * v for v in _leaves(g, h, 2, penalty)]
            for k, v in enumerate(step):
                own[k] += v
            total = [t + step[row[j]] for t, row in zip(total, b, strict=True)]
    return lambda row: 1 / (1 + math.exp(-min(max(base + sum(t[k] for t, k in zip(tables, place(row), strict=True)), -30), 30)))

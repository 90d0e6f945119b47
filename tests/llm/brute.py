"""Plain versions of the operators for small inputs."""

import collections
import hashlib
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORD, ALNUM_WORD = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Groups:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def shingles(text):
    w = SPACE_WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def components(docs):
    """doc_id -> (size, component)"""
    sets, g = {i: shingles(t) for i, t in docs}, Groups()
    for i in sets:
        for j in sets:
            if i < j and near(sets[i], sets[j]):
                g.join(i, j)
    return {i: (len(s), g.root(i)) for i, s in sets.items()}


def contamination(docs, items):
    windows = collections.defaultdict(set)
    for k, t in items:
        w = ALNUM_WORD.findall((t or "").translate(LOW))
        for i in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows[tuple(w[i : i + 13])].add(str(k))
    sizes, out = {len(x) for x in windows}, {}
    for d, t in docs:
        w, hit, ids = ALNUM_WORD.findall((t or "").translate(LOW)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    ids |= windows[x]
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def line_shingles(x):
    return {x[i : i + 8] for i in range(len(x) - 7)}


def lines_gone(docs, least=20):
    """{(doc_id, number, first doc_id, first number)}"""
    at = sorted((i, n, x.translate(LOW)) for i, t in docs for n, x in enumerate((t or "").split("\n")) if len(x) >= least)
    kinds, g = {x: line_shingles(x) for _, _, x in at}, Groups()
    for a in kinds:
        for b in kinds:
            if a < b and near(kinds[a], kinds[b]):
                g.join(a, b)
    first, out = {}, set()
    for i, n, x in at:
        r = g.root(x)
        if r in first:
            out.add((i, n, *first[r]))
        else:
            first[r] = (i, n)
    return out


def targets(sizes, most=3):
    """source -> target, by sharing what is left in rounds; sizes: source -> words"""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        free -= over
    return out


def licenses(text, templates, least=0.85):
    """Templates of which a window of the text has that share of words, in order: longest common subsequences of all windows of up to one and a half template lengths."""
    word = re.compile(r"[0-9a-z]+(?:[.-][0-9a-z]+)*")
    words, out = word.findall(text.lower()), set()
    for name, wording in templates.items():
        want = word.findall(wording.lower())
        for a in range(len(words)):
            part = words[a : a + len(want) + len(want) // 2]
            if sum((collections.Counter(part) & collections.Counter(want)).values()) < least * len(want):
                continue
            row = [0] * (len(want) + 1)
            for w in part:
                row = [0] + [max(row[j + 1], row[j] + (w == want[j])) for j in range(len(want))]
                for j in range(len(want)):
                    row[j + 1] = max(row[j + 1], row[j])
            if row[-1] >= least * len(want) - 1e-9:
                out.add(name)
                break
    return out

"""Secret scans: candidates by shape, false positives removed by a random forest.

Candidates are maximal runs of letters, digits and `+ / _ = -` of at least LEAST_CHARS characters, with or without digits; and what follows a
name with a keyword and = or :, in quotes or up to the next white space, whatever its characters or length (assigned_spans). Each has features of its length, character classes and
transitions, its coverage by a dictionary, its document's path and the words around it. The dictionary is that of the corpus: its MOST_WORDS most frequent words of letters
(frequent_words), counted over all documents, so that words of any language or jargon count as such; candidates are scored as they are, whole. The forest is trained on labelled findings: at most
MOST_FINDINGS of them, a documented bound, as they are fitted on the driver; the model of some 100 KB is broadcast and scores candidates where they are found.

`synthetic_findings` makes a seeded set of labelled findings of common kinds for where no reviewed ones exist; reviewed ones have the same columns.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffer

LEAST_CHARS, MOST_FINDINGS = 12, 50_000
BEFORE, AFTER = 48, 24

_RUN = np.zeros(256, dtype=bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True
_KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "api", "key", "auth", "bearer", "credential", "access", "private", "login")
_HARMLESS = ("commit", "sha", "md5", "digest", "checksum", "uuid", "guid", "etag", "build", "version", "isbn", "phone", "tel", "order", "invoice", "ref", "revision", "hash", "serial", "page")
_CODE_PATHS = re.compile(r"\.(py|js|ts|java|go|rb|env|ya?ml|json|toml|ini|cfg|conf|sh|tf)$|config|secret|deploy", re.I)
_TEST_PATHS = re.compile(r"test|fixture|example|sample|mock|docs?/", re.I)
#: Words of the corpus' dictionary, a bound of what the driver and each worker hold (some 5 MB), and how often each has to occur.
MOST_WORDS, LEAST_COUNT, LONGEST_WORD = 50_000, 3, 20


def frequent_words(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST_COUNT) -> frozenset[str]:
    """docs (text, ...) to the `most` most frequent runs of a-z, lower-cased, of 3 to LONGEST_WORD letters that occur `least` times or more. Counts pre-aggregate in each task."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(r"[a-z]{3,}"), F.lit(0))).alias("word")).where(F.length("word") <= LONGEST_WORD)
    top = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "word").limit(most)
    return frozenset(r.word for r in top.select("word").collect())


_NAMED = re.compile(rb"(?<![\w-])([\w-]++)[\"'\])]*+[ \t]*+(?::=|=>|={1,3}|:)[ \t]*+")
_ASSIGNED = re.compile(rb"\"((?:[^\"\\\n]|\\.)++)\"|'((?:[^'\\\n]|\\.)++)'|[\"']?([^\s\"']\S*+)")
_LETTERS = re.compile(r"[a-z]{3,}")
_NAMES = re.compile("|".join(_KEYWORDS).encode(), re.I)


def _shape(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def coverage(text: str, words: frozenset[str]) -> float:
    """Share of characters that dictionary words cover, the longest one at each place, greedily from the left; words in a larger run of letters count from four letters on."""
    found = 0
    for m in _LETTERS.finditer(text.lower()):
        run = m.group()
        if run in words:
            found += len(run)
            continue
        i = 0
        while i < len(run):
            size = next((n for n in range(min(LONGEST_WORD, len(run) - i), 3, -1) if run[i : i + n] in words), 0)
            found += size
            i += size or 1
    return found / max(1, len(text))


def features(candidate: str, before: str, after: str, path: str, words: frozenset[str] = frozenset()) -> list[float]:
    n = len(candidate)
    shapes = [_shape(c) for c in candidate]
    counts = [shapes.count(k) / n for k in range(4)]
    changes = sum(a != b for a, b in zip(shapes, shapes[1:], strict=False)) / max(1, n - 1)
    used = {c: candidate.count(c) for c in set(candidate)}
    entropy = -sum(v / n * math.log2(v / n) for v in used.values())
    low = candidate.lower()
    vowels = sum(c in "aeiou" for c in low) / n
    letters = [c for c in low if c.isalpha()]
    pairs = sum((a in "aeiou") != (b in "aeiou") for a, b in zip(letters, letters[1:], strict=False)) / max(1, len(letters) - 1)
    near = re.findall(r"[a-z0-9]+", before.lower())[-4:]
    hint = max((len(near) - i for i, w in enumerate(reversed(near)) if any(k in w for k in _KEYWORDS)), default=0)
    calm = max((len(near) - i for i, w in enumerate(reversed(near)) if any(w.startswith(k) for k in _HARMLESS)), default=0)
    tail = before.rstrip("\"' ")[-1:]
    inner = any(k in low.partition("=")[0] for k in _KEYWORDS) and "=" in low
    return [
        n, *counts, changes, entropy, vowels, pairs, coverage(candidate, words), len(used) / n, candidate.count("-"), candidate.count("/"), candidate.count("_"), float(all(c in string.hexdigits for c in candidate)), float(candidate.isdigit()),
        float(bool(re.match(r"(AKIA|ASIA)[0-9A-Z]{16}$", candidate))), float(bool(re.match(r"(gh[pousr]|sk|pk|rk|xox[abp]|glpat|AIza|eyJ)[-_0-9A-Za-z]", candidate))), float(bool(re.match(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", candidate))),
        float(tail in "=:" and tail != ""), float(before[-1:] in "\"'" and before != ""), float(after[:1] in "\"'" and after != ""), hint, calm, float(inner), float(bool(_CODE_PATHS.search(path))), float(bool(_TEST_PATHS.search(path))),
    ]


class Forest:
    """A random forest of Gini trees: bootstrap rows, a root of features tried at each split, leaves hold shares of ones."""

    def __init__(self, trees: int = 40, depth: int = 10, least: int = 3, seed: int = 11):
        self.n_trees, self.depth, self.least, self.seed = trees, depth, least, seed
        self.trees: list[tuple[np.ndarray, ...]] = []
        self.share, self.words = 0.5, frozenset()

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.share = float(y.mean()) if len(y) else 0.5
        for _ in range(self.n_trees if len(y) else 0):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows], 0, nodes, rng)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, nodes: list, rng: np.random.Generator) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y.mean())])
        if depth == self.depth or len(y) < 2 * self.least or y.min() == y.max():
            return at
        best = (np.inf, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, round(math.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            cut = cut[(cut >= self.least) & (cut <= len(y) - self.least)]
            if not len(cut):
                continue
            left, total = ones[cut - 1], ones[-1]
            right, n = total - left, len(y)
            impurity = left * (1 - left / cut) + right * (1 - right / (n - cut))
            k = int(np.argmin(impurity))
            if impurity[k] < best[0]:
                best = impurity[k], f, (v[cut[k] - 1] + v[cut[k]]) / 2
        if best[1] < 0:
            return at
        low = x[:, best[1]] <= best[2]
        nodes[at][:2] = [int(best[1]), float(best[2])]
        nodes[at][2] = self._grow(x[low], y[low], depth + 1, nodes, rng)
        nodes[at][3] = self._grow(x[~low], y[~low], depth + 1, nodes, rng)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trees or not len(x):
            return np.full(len(x), self.share)
        total = np.zeros(len(x))
        for feature, cut, low, high, share in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth + 1):
                f = feature[at].astype(np.int64)
                step = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], low[at], high[at]).astype(np.int64)
                at = np.where(f >= 0, step, at)
            total += share[at]
        return total / len(self.trees)


def synthetic_findings(n: int = 6000, seed: int = 5, dictionary: frozenset[str] = frozenset()) -> list[dict]:
    """Seeded labelled findings (candidate, before, after, path, label): keys, tokens and passwords against digests, ids, numbers and long words. dictionary: words that prose is made of, too."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    some = lambda chars, k: "".join(pick(chars) for _ in range(k))
    hexes, b64, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    syllables = ("an", "er", "tion", "ti", "re", "ou", "in", "the", "st", "en", "nd", "ly", "le", "de", "ver", "ge", "ich")
    known = sorted(dictionary)
    word = lambda: pick(known) if known and rng.integers(3) else "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    prose = lambda: " ".join(word() for _ in range(4)) + pick([" ", ". ", ", ", "\n"])
    paths = ("src/app.py", "config/deploy.yaml", "notes.md", "web/page", "tests/fixtures/a.json", "docs/guide.md", "src0", "src7", "")
    hints = ("password", "token", "api_key", "secret", "auth_token", "access_key", "passwd")
    calm = ("commit", "sha256:", "uuid", "build", "etag", "version", "order", "invoice", "phone", "serial")
    out = []
    strong, marks = string.ascii_letters + string.digits + "!@#$%^&*.?", "!@#$%^&*.?"
    plain = ("null", "none", "None", "true", "false", "required", "string", "optional", "value", "see", "the", "a", "is", "yes", "<password>", "${PASSWORD}", "$TOKEN", "****", "<redacted>", "os.environ", "getpass.getpass()", "1", "3600", "{{", "...")
    start = lambda before: pick([before, "", word() + " ", word() + "_"])
    for i in range(n):
        before, after, label = prose(), pick([" ", "\n", ". ", ", "]) + word(), i % 2
        if label:
            kind, assigned = int(rng.integers(13)), False
            if kind >= 11:
                c = some(pick([string.ascii_letters, string.ascii_letters, string.ascii_lowercase, string.ascii_letters + "_-"]), int(rng.integers(16, 48)))
                before += pick(hints) + pick([" = ", ": ", "=", ":"]) + pick(['"', "'", ""]) if kind == 11 else ""
            elif kind == 0:
                c = "AKIA" + some(upper, 16)
            elif kind == 1:
                c = pick(["ghp_", "gho_", "sk_live_", "xoxb-", "glpat-"]) + some(b64, int(rng.integers(20, 40)))
            elif kind == 2:
                c = pick(hints) + "=" + some(pick([hexes, b64]), int(rng.integers(12, 41)))
            elif kind in (3, 4):
                c, q = some(pick([hexes, b64]), int(rng.integers(16, 65))), pick(['"', "'", ""])
                before += pick(hints) + pick([" = ", ": ", "=", ":"]) + q
                after = q + after
            elif kind == 5:
                c, before = some(b64, int(rng.integers(24, 65))), before + pick(["Authorization: Bearer ", "bearer ", "secret key "])
            elif kind in (7, 8, 9, 10):
                phrase = "-_ ."[int(rng.integers(4))].join(word() + word() for _ in range(int(rng.integers(3, 6))))
                short = pick([some(string.ascii_lowercase, 5), some(string.ascii_letters, int(rng.integers(3, 7))), word() + word()]) + pick(string.digits) + some(strong, int(rng.integers(1, 5)))
                c = pick([phrase, short, some(strong, int(rng.integers(10, 25))) + pick(marks)])
                q, assigned = pick(['"', "'"] + [""] * (" " not in c)), True
                before = start(before) + pick(hints) + pick([" = ", ": ", "=", ":"]) + q
                after = q + after
            else:
                c = some(b64 + "+/", 40)
                before += pick(["aws_secret_access_key = ", "private key "])
        else:
            kind, assigned = int(rng.integers(16)), False
            if kind >= 14:
                c = pick(["-", "_", "", "/"]).join(pick([word(), word().capitalize()]) for _ in range(int(rng.integers(2, 7))))
                c = c if len(c) >= LEAST_CHARS else c + pick(["-", "/"]) + word() + word() + word()
            elif kind >= 12:
                c = pick(["=", "-", "_", "+=", "x", "ha", "/-"]) * int(rng.integers(12, 40))
            elif kind == 0:
                c, before = some(hexes, pick([12, 32, 40, 64])), before + pick(calm) + " "
            elif kind == 1:
                c = "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12))
            elif kind == 2:
                c = some("0123456789", int(rng.integers(12, 20)))
            elif kind == 3:
                c = word() + word() + word() + word() + some("0123456789", int(rng.integers(1, 4)))
            elif kind == 4:
                c = f"20{some('012', 1)}{some('0123456789', 1)}-0{some('123456789', 1)}-1{some('0123456789', 1)}T10-30-00"
            elif kind == 5:
                c = f"/{word()}/{word()}/{some('0123456789', 3)}/{word()}"
            elif kind == 6:
                c = f"{word()}_{word()}_{word()}-{some('0123456789', 2)}-{word()}"
            elif kind in (8, 9, 10, 11):
                c, q, assigned = pick([pick(plain), pick(plain), word()]), pick(["", "", '"']), True
                before = start(before) + pick([*hints, "key", "login", "access"]) + pick([" = ", ": ", "=", ":"]) + q
                after = q + after
            else:
                c = pick([word().upper() + "-", "v"]) + some("0123456789", 4) + "-" + some("0123456789", 6)
        if assigned or len(c) >= LEAST_CHARS:
            out.append({"candidate": c, "before": before[-BEFORE:], "after": after[:AFTER], "path": pick(paths), "label": label})
    return out


def train(findings: DataFrame | list[dict], words: frozenset[str] = frozenset()) -> Forest:
    """Labelled findings to a forest, which keeps `words` as its dictionary. A DataFrame gives at most MOST_FINDINGS rows, those with the least hashes; rows with nulls count as empty texts."""
    if isinstance(findings, DataFrame):
        columns = ["candidate", "before", "after", "path", "label"]
        chosen = findings.select(*columns).orderBy(F.xxhash64("candidate", "before", "after", "path", "label")).limit(MOST_FINDINGS)
        findings = chosen.toArrow().to_pylist()
    rows = [r for r in findings if r["candidate"] and r["label"] in (0, 1)]
    x = np.array([features(r["candidate"], r["before"] or "", r["after"] or "", r["path"] or "", words) for r in rows], dtype=float)
    forest = Forest()
    forest.words = words
    return forest.fit(x, np.array([r["label"] for r in rows], dtype=float))


def candidate_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end byte) of all candidates of a run of texts; bytes count from the start of data."""
    run = _RUN[data]
    begins, closes = run.copy(), run.copy()
    begins[1:] &= ~run[:-1]
    closes[:-1] &= ~run[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = run[inner]
    closes[inner - 1] = run[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    keep = end - start >= LEAST_CHARS
    return np.searchsorted(offsets, start[keep], "right") - 1, start[keep], end[keep]


def assigned_spans(text: bytes) -> list[tuple[int, int]]:
    """(first byte, end byte) of what is assigned to names that hold a keyword; unquoted values end before closing commas and semicolons."""
    out = []
    for m in _NAMED.finditer(text):
        if not _NAMES.search(m[1]) or not (v := _ASSIGNED.match(text, m.end())):
            continue
        s, e = v.span(v.lastindex)
        if v.lastindex == 3:
            e = s + len(text[s:e].rstrip(b",;"))
        if e > s:
            out.append((s, e))
    return out


def _with_assigned(raw: bytes, at: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
    """Candidates (row, first byte, end byte) in order: the runs given, and assigned values that none of them holds."""
    out = list(zip(row.tolist(), start.tolist(), end.tolist(), strict=True))
    for r in range(len(at) - 1):
        text, first = raw[at[r] : at[r + 1]], int(at[r])
        for s, e in assigned_spans(text) if b"=" in text or b":" in text else ():
            k = int(np.searchsorted(start, first + s, "right")) - 1
            if k < 0 or end[k] < first + e:
                out.append((r, first + s, first + e))
    return sorted(set(out))


_FOUND = pa.list_(pa.struct([("first_byte", pa.int64()), ("end_byte", pa.int64()), ("score", pa.float64())]))
_FOUND_DDL = "array<struct<first_byte:bigint,end_byte:bigint,score:double>>"


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets, 3 << 20):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                row, start, end = candidate_spans(part, at)
                paths = batch.column(2).slice(a, b - a).to_pylist()
                raw, said = part.tobytes(), []
                spans = _with_assigned(raw, at, row, start, end)
                for r, s, e in spans:
                    said.append(features(raw[s:e].decode("utf-8", "ignore"), raw[max(at[r], s - BEFORE) : s].decode("utf-8", "ignore"), raw[e : min(at[r + 1], e + AFTER)].decode("utf-8", "ignore"), paths[r] or "", forest.words))
                scores = forest.predict(np.array(said, dtype=float)) if said else []
                out: list[list[dict]] = [[] for _ in range(b - a)]
                for (r, s, e), score in zip(spans, scores, strict=True):
                    out[r].append({"first_byte": int(s - at[r]), "end_byte": int(e - at[r]), "score": float(score)})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out, _FOUND)], names=["doc_id", "candidates"])

    return run


def scan_secrets(docs: DataFrame, forest: Forest, path: str = "source") -> DataFrame:
    """docs (doc_id, text, <path>, ...) to (doc_id, candidates), a row for each row: spans by UTF-8 byte and scores from 0 to 1. Null and empty texts have none."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(path).cast("string").alias("path"))
    return source.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(forest)), f"doc_id long, candidates {_FOUND_DDL}")

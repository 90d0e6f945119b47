"""Benchmark decontamination by a generalised suffix automaton of normalised test items.

Test items become word sequences (A-Z lower-cased; words are digits, letters and whatever lies above ASCII) and one automaton
over all of them. A document's words are streamed through it while the longest matching length is tracked: a match of `window` words or more
marks its whole span, and one that ends a test item shorter than `window` marks that item's span. Spans and coverage then
decide what is removed.

Words are told apart by 64-bit hashes. Only runs of words whose consecutive short grams all occur in the items are
streamed; any span to be marked lies in such a run, so this skips words that match nothing and changes no result.

An automaton is built on the driver from at most `most_words` words of items, some 150 MB while it is built, and kept as sorted arrays of some 12 MB. A larger benchmark is dealt by item over several
automata; PER_PASS of them are broadcast at once, and what is beyond takes further passes over the documents, between which spans are stored in the shared folder. An item
of more words is cut into pieces that overlap by a window less one word. So what a worker holds has a fixed bound, whatever the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_WORDS, U64, Words, checkpointed, mix, slices, text_buffer

MOST_WORDS, PER_PASS = 200_000, 5
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(texts: pa.Array) -> list[np.ndarray]:
    data, offsets = text_buffer(texts)
    words = Words(data, offsets, ALNUM_WORDS)
    return [words.hash[words.first[i] : words.first[i + 1]] for i in range(len(texts))]


class SuffixAutomaton:
    """Of several word sequences. States hold their longest length, suffix link and transitions."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int):
        self.window = window
        self.length, self.link, self.step = [0], [-1], [{}]
        items = [(k, w.tolist()) for k, w in items if len(w)]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.windows: dict[int, set] = {}  # state of a window -> items that have it
        self.wholes: dict[int, list] = {}  # state -> (length, item) of short items
        for k, words in items:
            state = 0
            for i, w in enumerate(words):
                state = self.step[state][w]
                if i + 1 >= window:
                    self.windows.setdefault(self.cut(state), set()).add(k)
            if len(words) < window:
                self.wholes.setdefault(state, []).append((len(words), k))
        least = min([window, *(len(w) for _, w in items)])
        self.least, self.gram = least, min(least, 4)
        hashes = [gram_hashes(np.array(w, dtype=U64), self.gram) for _, w in items]
        self.grams = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, dtype=U64)

    def _extend(self, last: int, w: int) -> int:
        length, link, step = self.length, self.link, self.step
        if (old := step[last].get(w)) is not None:
            return old if length[old] == length[last] + 1 else self._clone(last, w, old)
        new = self._state(length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int, link: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = copy
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        return copy

    def cut(self, state: int) -> int:
        """The state of the last `window` words of a state with at least so many."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def spans(self, words: list[int]) -> tuple[list[tuple[int, int]], set]:
        return Matcher(self).spans(np.array(words, dtype=U64))


class Matcher:
    """An automaton as sorted arrays: transitions by (state, word), states of windows with their items, and what the prefilter needs."""

    def __init__(self, automaton: SuffixAutomaton):
        a = automaton
        self.window, self.least, self.gram, self.grams = a.window, a.least, a.gram, a.grams
        self.length, self.link = np.array(a.length, dtype=np.int32), np.array(a.link, dtype=np.int32)
        self.vocabulary = np.unique(np.array([w for step in a.step for w in step], dtype=U64))
        state = np.repeat(np.arange(len(a.step)), [len(step) for step in a.step])
        word = np.searchsorted(self.vocabulary, np.array([w for step in a.step for w in step], dtype=U64))
        to = np.array([t for step in a.step for t in step.values()], dtype=np.int32)
        keys = (state.astype(np.int64) << 32) | word
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self.ids = sorted({k for ks in a.windows.values() for k in ks} | {k for ls in a.wholes.values() for _, k in ls}, key=lambda k: (k is None, k or ""))
        number = {k: i for i, k in enumerate(self.ids)}
        pairs = sorted((s, number[k]) for s, ks in a.windows.items() for k in ks)
        self.window_states, self.window_items = np.array([s for s, _ in pairs], dtype=np.int32), np.array([k for _, k in pairs], dtype=np.int32)
        self.wholes = {s: [(n, number[k]) for n, k in ls] for s, ls in a.wholes.items()}
        self.ends: dict[int, list] = {}
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.grams >> U64(44)).astype(np.int64)] = True

    def step(self, state: int, word: int) -> int:
        """The next state, or -1."""
        key = (state << 32) | word
        at = int(np.searchsorted(self.keys, key))
        return int(self.to[at]) if at < len(self.keys) and self.keys[at] == key else -1

    def items(self, state: int) -> np.ndarray:
        """Numbers of the items with the window that ends in a state with `window` words or more."""
        while self.length[self.link[state]] >= self.window:
            state = int(self.link[state])
        return self.window_items[np.searchsorted(self.window_states, state, "left") : np.searchsorted(self.window_states, state, "right")]

    def short(self, state: int) -> list:
        """(length, item) of the short items that are suffixes of a state."""
        if not self.wholes:
            return []
        if state not in self.ends:
            found, s = [], state
            while s > 0:
                found += self.wholes.get(s, [])
                s = int(self.link[s])
            self.ends[state] = found
        return self.ends[state]

    def spans(self, words: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Marked spans (first, end) of a run of word hashes, and the items they come from."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), max(0, len(self.vocabulary) - 1))
        known = self.vocabulary[at] == words if len(self.vocabulary) else np.zeros(len(words), dtype=bool)
        out, items, state, size = [], set(), 0, 0
        for i, (w, is_known) in enumerate(zip(at.tolist(), known.tolist(), strict=True)):
            if not is_known:
                state, size = 0, 0
                continue
            while (to := self.step(state, w)) < 0 and state:
                state = int(self.link[state])
                size = int(self.length[state])
            if to < 0:
                size = 0
                continue
            state, size = to, size + 1
            if size >= self.window:
                out.append((i + 1 - size, i + 1))
                items.update(self.items(state).tolist())
            for length, k in self.short(state):
                if length <= size:
                    out.append((i + 1 - length, i + 1))
                    items.add(k)
        return out, {self.ids[k] for k in items}


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    size = max(0, len(words) - n + 1)
    out = np.zeros(size, dtype=U64)
    for j in range(n):
        out = mix(out + words[j : j + size])
    return out


def mark(automaton: Matcher, words: Words) -> dict[int, tuple[np.ndarray, set]]:
    """row -> (which of its words are marked, items), for the rows that have any."""
    found: dict[int, tuple[np.ndarray, set]] = {}
    if not len(automaton.grams):
        return found
    n, grams = automaton.gram, gram_hashes(words.hash, automaton.gram)
    maybe = np.flatnonzero(automaton.seen[(grams >> U64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(automaton.grams, grams[maybe]), len(automaton.grams) - 1)
    maybe = maybe[(automaton.grams[at] == grams[maybe])]
    maybe = maybe[words.doc[maybe] == words.doc[maybe + n - 1]]
    if not len(maybe):
        return found
    new = np.ones(len(maybe), dtype=bool)
    new[1:] = (np.diff(maybe) != 1) | (words.doc[maybe[1:]] != words.doc[maybe[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(maybe)) - 1
    for a, b in zip(maybe[first], maybe[last] + n, strict=True):
        if b - a < automaton.least:
            continue
        spans, items = automaton.spans(words.hash[a:b])
        if spans:
            row = int(words.doc[a])
            hit, all_items = found.setdefault(row, (np.zeros(int(words.count[row]), dtype=bool), set()))
            at = int(a - words.first[row])
            for x, y in spans:
                hit[at + x : at + y] = True
            all_items |= items
    return found


_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("first_byte", pa.int64()), ("end_byte", pa.int64())]))
_SPANS_DDL = "array<struct<first_word:bigint,end_word:bigint,first_byte:bigint,end_byte:bigint>>"


def _pass(shared, text_at: int):
    """Adds to the trailing columns (n_words, hit spans, items) what some automata find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = shared.value
        for whole in batches:
            data, offsets = text_buffer(whole.column(text_at))
            for a, b in slices(offsets, 3 << 20):
                batch = whole.slice(a, b - a)
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM_WORDS)
                spans, items = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                begin = offsets[a:b] - offsets[a]
                for row, (hit, ids) in (x for automaton in automata for x in mark(automaton, words).items()):
                    for s in spans[row] or []:
                        hit[s["first_word"] : s["end_word"]] = True
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                    at = int(words.first[row])
                    spans[row] = [{"first_word": int(x), "end_word": int(y), "first_byte": int(words.start[at + x] - begin[row]), "end_byte": int(words.end[at + y - 1] - begin[row])} for x, y in edge.reshape(-1, 2)]
                    items[row] = sorted({*(items[row] or []), *(i for i in ids if i is not None)})
                columns = [*batch.columns[:-3], pa.array(words.count.astype(np.int64)), pa.array([s or [] for s in spans], _SPANS), pa.array([i or [] for i in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, most_words: int = MOST_WORDS) -> DataFrame:
    """docs (text, ...) with n_words long, spans (marked spans by word and by UTF-8 byte) and item_ids (array of strings).

    benchmark (item_id, text). A null or empty text has no words and no spans; a null or empty item marks nothing; an item with a null id marks words
    and is left out of item_ids. Repeated items count once under each id. Columns of docs with the names of the added ones are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "spans", "item_ids")
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null and text != ''")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0  # a word has two characters with its gap
    shards = max(1, -(-total // (2 * most_words)))
    out = docs.withColumns({"n_words": F.lit(None).cast("long"), "spans": F.lit(None).cast(_SPANS_DDL), "item_ids": F.lit(None).cast("array<string>")})
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema])
    for first in range(0, shards, PER_PASS):
        automata = []
        for k in range(first, min(first + PER_PASS, shards)):
            rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k).toArrow()
            words = words_of(rows.column("text").combine_chunks()) if rows.num_rows else []
            automata += [Matcher(SuffixAutomaton(some, window)) for some in _pieces(list(zip(rows.column("id").to_pylist(), words, strict=True)), window, most_words)]
        out = out.mapInArrow(_pass(spark.sparkContext.broadcast(automata), docs.columns.index("text")), schema)
        if first + PER_PASS < shards:
            out = checkpointed(out)
    return out


def _pieces(items: list[tuple[str | None, np.ndarray]], window: int, most_words: int) -> Iterator[list[tuple[str | None, np.ndarray]]]:
    """Items in lists of about most_words words; a longer item in pieces that hold each of its windows."""
    some, held = [], 0
    for k, words in items:
        for a in range(0, max(1, len(words) - window + 1), most_words):
            piece = words[a : a + most_words + window - 1]
            some.append((k, piece))
            held += len(piece)
            if held >= most_words:
                yield some
                some, held = [], 0
    if some or not items:
        yield some


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end_word - s.first_word)


def is_contaminated(share_num: int = 1, share_den: int = 20) -> Column:
    """Of a row of find_contamination: some word is marked, and at least share_num / share_den of its words are."""
    return (F.size("spans") > 0) & (share_den * hit_words() >= share_num * F.col("n_words"))


def _without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if spans:
                raw, parts, at = text.encode(), [], 0
                for s in spans:
                    parts.append(raw[at : s["first_byte"]])
                    at = s["end_byte"]
                text = b"".join([*parts, raw[at:]]).decode()
            out.append(text)
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share_num: int = 1, share_den: int = 20, remove: str = "documents", **limits) -> DataFrame:
    """docs without contaminated documents (remove="documents"), or with their marked spans cut out of the text (remove="spans")."""
    names = docs.columns
    own = {c: f"__own_{c}" for c in names if c in ("n_words", "spans", "item_ids")}
    found = find_contamination(docs.withColumnsRenamed(own), benchmark, window, **limits)
    bad = is_contaminated(share_num, share_den)
    if remove == "documents":
        out = found.where(~bad)
    elif remove == "spans":
        cut = found.withColumn("spans", F.when(bad, F.col("spans")))
        out = cut.mapInArrow(_without_spans, cut.schema)
    else:
        raise ValueError("remove: documents or spans")
    return out.drop("n_words", "spans", "item_ids").withColumnsRenamed({v: k for k, v in own.items()}).select(*names)

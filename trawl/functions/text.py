"""Text analysis: tokens, sparse term weights, analyzers, a hashing embedder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stop words.
STOPWORDS = {
    "en": ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were", "with"),
    "fr": ("le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "est", "que", "qui", "dans", "pour", "par", "sur", "au", "aux", "ce", "se", "ne", "pas", "son", "sa", "ses"),
}
STOPWORDS |= {"english": STOPWORDS["en"], "french": STOPWORDS["fr"]}


def tokens(text: Column, unicode: bool = False) -> Column:
    """Lower-cased runs of a-z and 0-9; with unicode, of letters and digits of any script."""
    pattern = r"[\p{L}\p{N}]+" if unicode else "[a-z0-9]+"
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


#: Tokens that a task counts at once.
COUNTED = 1 << 20


def _shares(lists: pa.ListArray) -> pa.MapArray:
    words, size = lists.flatten().dictionary_encode(), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    width = max(1, len(words.dictionary))
    keys, n = np.unique(row * width + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
    row, code = keys // width, keys % width
    offsets = np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32)
    return pa.MapArray.from_arrays(pa.array(offsets), words.dictionary.take(pa.array(code)), pa.array((n / size[row]).astype(np.float32)))


def frequencies(words: Column) -> Column:
    """An array of tokens to a map of their shares, in one pass over it; term_counts is the form for shares as rows."""

    @F.arrow_udf("map<string,float>")
    def shares(lists: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, COUNTED), "left"), [0, len(lists)]))
        parts = [_shares(lists.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]
        return pa.concat_arrays(parts) if parts else _shares(lists)

    return shares(words)


def sparse_terms(text: Column, unicode: bool = False) -> Column:
    return frequencies(tokens(text, unicode))


def term_counts(df: DataFrame, keys: list[str], words: Column) -> DataFrame:
    """(keys, term, n, total): the set-oriented form of frequencies for long texts."""
    rows = df.select(*keys, words.alias("w")).select(*keys, F.size("w").cast("long").alias("total"), F.explode("w").alias("term"))
    return rows.groupBy(*keys, "term", "total").agg(F.count("*").alias("n"))


class Analyzer:
    """A pipeline over arrays of tokens; each step returns a new analyzer. Without a tokenizer text is lower-cased and cut as in tokens()."""

    def __init__(self, steps: tuple[Callable[[Column], Column], ...] = (), tokenizer: Callable[[Column], Column] = tokens):
        self.steps, self._tokenizer = steps, tokenizer

    def tokenizer(self, cut: Callable[[Column], Column]) -> Analyzer:
        """cut: text column to an array of strings."""
        return Analyzer(self.steps, cut)

    def filter(self, step: Callable[[Column], Column]) -> Analyzer:
        """step: array of tokens to array of tokens."""
        return Analyzer((*self.steps, step), self._tokenizer)

    def lowercase(self) -> Analyzer:
        return self.filter(lambda ts: F.transform(ts, F.lower))

    def stopwords(self, words: str | list[str] | set[str]) -> Analyzer:
        """A language (en, english, fr, french; others have none) or the words themselves."""
        listed = STOPWORDS.get(words, ()) if isinstance(words, str) else tuple(sorted(words))
        return self.filter(lambda ts: F.filter(ts, lambda t: ~t.isin(*listed))) if listed else self

    def ngrams(self, n: int) -> Analyzer:
        """Character n-grams of each token; tokens of n characters or fewer stay whole."""
        if n < 1:
            raise ValueError("n starts at 1")
        cut = lambda t: F.when(F.length(t) <= n, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - n + 1)), lambda i: t.substr(i, F.lit(n))))
        return self.filter(lambda ts: F.flatten(F.transform(ts, cut)))

    def stemmer(self, language: str = "english") -> Analyzer:
        """Snowball stems, where the snowballstemmer package is installed."""
        import snowballstemmer

        stem = snowballstemmer.stemmer(language)

        @F.pandas_udf("array<string>")
        def stems(words: pd.Series) -> pd.Series:
            return words.map(lambda ts: stem.stemWords(list(ts)))

        return self.filter(stems)

    def tokenize(self, text: Column) -> Column:
        words = self._tokenizer(text)
        for step in self.steps:
            words = step(words)
        return words

    def sparse_terms(self, text: Column) -> Column:
        return frequencies(self.tokenize(text))

    def sparse_terms_weighted(self, fields: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
        """The sum over fields of weight times share; a field's weight is 1 by default."""
        scaled = lambda c, w: F.transform_values(self.sparse_terms(c), lambda _, v: v.cast("double") * F.lit(float(w)))
        maps = [scaled(c, (weights or {}).get(k, 1.0)) for k, c in fields.items()]
        out = maps[0]
        for m in maps[1:]:
            out = F.map_zip_with(out, m, lambda _, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
        return F.transform_values(out, lambda _, v: v.cast("float"))


def embedder(embed: Callable[[list[str]], np.ndarray]) -> Callable[[Column], Column]:
    """Any function from texts to vectors (a local model or a client of a service) as a Column function, a batch at a time."""

    @F.pandas_udf("array<float>")
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(embed(texts.fillna("").tolist()), dtype=np.float32)))

    return apply


def hashing_embedder(dimension: int) -> Callable[[Column], Column]:
    """A deterministic embedder without a model: signed hashed token counts of unit length."""

    @F.pandas_udf("array<float>")
    def summed(hashes: pd.Series) -> pd.Series:
        out = []
        for own in hashes:
            h = np.asarray(own, dtype=np.int64)
            raw = np.bincount(h % dimension, weights=np.where((h >> 32) % 2 == 0, 1.0, -1.0), minlength=dimension) if len(h) else np.zeros(dimension)
            size = np.linalg.norm(raw)
            out.append((raw / size if size else raw).astype(np.float32))
        return pd.Series(out)

    return lambda text: summed(F.transform(tokens(text), lambda t: F.xxhash64(t)))

import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.llm import components, queries
from trawl.llm.components import connected_components
from trawl.llm.decontaminate import SuffixAutomaton, decontaminate, find_contamination, hit_words, is_contaminated, words_of
from trawl.llm.line_dedup import dedup_lines, repeated_lines
from trawl.llm.ngram_join import allocate, bands, differences, ngram_jaccard_components
from trawl.llm.packed import candidates, pack

LONG = "doc_id long, text string, lang string, spans string, gone string, copies int, n_words int, n_shingles string, key int"


def docs_frame(spark, docs):
    """With extra columns that clash with names that operators use."""
    return spark.createDataFrame([(i, t, None, "s", "g", 1, 2, "n", 3) for i, t in docs], LONG)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"x{rng.randrange(9999)}" if rng.random() < share else w for w in text.split(" "))


def corpus(seed=1):
    rng = random.Random(seed)
    docs, common = [], prose(rng, 30)
    for i in range(60):
        docs.append((i, prose(rng, rng.choice([1, 2, 4, 5, 6, 9, 20, 60, 200]), 100_000)))
    base = prose(rng, 150, 100_000)
    docs += [(100 + i, edited(rng, base, rng.choice([0, 0.002, 0.01, 0.03]))) for i in range(60)]
    small = prose(rng, 9, 100_000)
    docs += [(200 + i, " ".join(small.split(" ")[: 6 + i % 4])) for i in range(8)]
    docs += [(300 + i, prose(rng, 10) + "\n" + common + "\n" + prose(rng, 15)) for i in range(50)]
    docs += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "ONE"), (405, "One two"), (406, docs[3][1]), (407, docs[3][1].upper() if docs[3][1].isascii() else docs[3][1])]
    docs += [(500, prose(rng, 30_000, 50)), (501, "é" * 5000 + " x"), (502, " nbsp is no gap here at all")]
    return docs


def test_components_match_brute_force(spark):
    docs = corpus()
    want = brute.components(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_components(docs_frame(spark, docs)).collect()}
    assert got == want
    # hot signatures in small blocks give the same
    again = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_components(docs_frame(spark, docs), most_shared=3, few=8, many=32).collect()}
    assert again == want


def test_components_of_odd_tables(spark):
    assert ngram_jaccard_components(docs_frame(spark, [])).collect() == []
    rows = ngram_jaccard_components(docs_frame(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, None), (None, None), (7, "a b c d e f")])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in rows) == [(-1, 0, -1), (-1, 2, -1), (3, 0, 3), (5, 2, 5), (5, 2, 5), (7, 2, 5)]


def test_allocation_covers_all_differences():
    for low, high in bands(5000, 75, 100):
        need = int(differences(high, high, 75, 100)) + 1
        m, double = allocate(high, need, 6)
        assert m + double >= need and high * 100 // 75 <= max(b for b in (x[1] for x in bands(20_000, 75, 100) if x[0] <= high * 100 // 75 + 1))
        assert low <= high
    cuts = bands(5000, 75, 100)
    for k in range(len(cuts) - 2):  # a partner is at most one band away
        assert cuts[k][1] * 100 // 75 < cuts[k + 2][0]


def test_packed_candidates():
    sigs = np.array([7, 7, 7, 9, 9, 1 << 40], dtype=np.uint64)
    batch = pack(sigs, np.array([0, 1, 0, 1, 2, 2]), np.array([10, 20, 30], dtype=np.uint64), np.array([4, 4, 100]), 8)
    out = [r for b in candidates(iter([batch]), 5, 75, 100) for r in b.to_pylist()]
    assert [(r["a"], r["b"]) for r in out] == [(10, 20)]
    hot = [r for b in candidates(iter([batch]), 1, 75, 100) for r in b.to_pylist()]
    assert len([r for r in hot if r["hot"]]) == 4


def test_groups_are_resolved_in_rounds(spark):
    """Sets that share a hot signature but are no copies of its first one, in chains and apart."""
    rng = random.Random(31)
    bases = [prose(rng, 60, 100_000) for _ in range(5)]
    docs, common = [], prose(rng, 40, 100_000)
    for k, base in enumerate(bases):
        now = common + " " + base
        for i in range(24):
            docs.append((100 * k + i, now))
            now = edited(rng, now, 0.012)  # each is near the one before, the last far from the first
    rng.shuffle(docs)
    want = brute.components(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_components(docs_frame(spark, docs), most_shared=2, few=4, many=16).collect()}
    assert got == want and len({c for _, c in want.values()}) > 5


def test_keys_that_collide(spark, monkeypatch):
    """Different sets and lines with one 64-bit key are not taken for each other."""
    from trawl.llm import line_dedup, ngram_join

    plain = ngram_join.set_keys
    monkeypatch.setattr(ngram_join, "set_keys", lambda h, at: (np.where(plain(h, at)[0] > 0, np.uint64(7), np.uint64(0)), plain(h, at)[1]))
    docs = [(1, "a b c d e f g h"), (2, "i j k l m n o p"), (3, "A b c d e f g h"), (4, "q r s")]
    found = ngram_join._index(5, 75, 100, 8, 1)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs]})
    rows = [r for b in ngram_join._find(32, 75, 100)(found(iter([batch]))) for r in b.to_pylist() if r["key"] is not None]
    kinds = {}
    for r in rows:
        kinds.setdefault((r["key"], r["n"]), set()).add(r["doc_id"])
    assert sorted(map(sorted, kinds.values())) == [[1, 3], [2], [4]]
    lines = line_dedup.Lines(*line_dedup.text_buffer(pa.array(["abc\nabd\nABC"])))
    assert lines.check[0] == lines.check[2] != lines.check[1]


@pytest.mark.parametrize("most_edges", [1_000_000, 7])
def test_union_find(spark, most_edges):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(9), most_edges=most_edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and got[201] == 200 and len(got) == 41 + 40 + 2
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_stars_are_contracted_again_in_fewer_partitions(spark, monkeypatch):
    """Edges of several partitions whose stars fit into one need no rounds over partitions."""
    monkeypatch.setattr(components, "_star", None)
    edges = [(i, j) for i in range(40) for j in range(i + 1, 40)] + [(1000, i) for i in range(1001, 1010)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(9), most_edges=300).collect()}
    assert got == {i: 0 for i in range(40)} | {i: 1000 for i in range(1000, 1010)}


def bench():
    rng = random.Random(9)
    return [(1, prose(rng, 40)), (2, prose(rng, 13)), (3, "only three words"), (4, None), (5, ""), (6, "!!"), (10, prose(rng, 25)), (None, prose(rng, 20)), (11, "solo")]


def tainted(items, seed=2):
    rng = random.Random(seed)
    texts = {k: t for k, t in items}
    docs = [(i, prose(rng, rng.choice([0, 5, 40, 300]))) for i in range(30)]
    cut = lambda t, a, b: " ".join(t.split(" ")[a:b])
    for i in range(30, 70):
        t = texts[rng.choice([1, 2, 10, None])]
        a = rng.randrange(max(1, len(t.split(" ")) - 12))
        docs.append((i, prose(rng, rng.choice([3, 100, 600])) + ", " + cut(t, a, a + rng.choice([12, 13, 20])).upper() + "! " + prose(rng, 20)))
    docs += [(70, "Only THREE-words"), (71, None), (72, ""), (73, "x solo y"), (74, texts[1] + " " + texts[10]), (75, "..."), (76, prose(rng, 20_000) + " " + texts[2])]
    return docs


@pytest.mark.parametrize("most_words", [4_000_000, 30])
def test_contamination_matches_brute_force(spark, most_words):
    items = bench()
    docs = tainted(items)
    ids = F.array_join(F.array_sort("item_ids"), ",")
    found = find_contamination(docs_frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), most_words=most_words)
    got = {r.doc_id: (r.n_words, r.hit, r.n, r.sha, r.bad) for r in found.select("doc_id", "n_words", hit_words().alias("hit"), F.size("item_ids").alias("n"), F.sha2(ids, 256).alias("sha"), is_contaminated().alias("bad")).collect()}
    want = brute.contamination(docs, [(k, t) for k, t in items if k is not None])
    with_null = brute.contamination(docs, items)
    assert {k: (v[0], v[2], v[3]) for k, v in got.items()} == {k: (v[0], v[2], v[3]) for k, v in want.items()}
    assert {k: (v[1], v[4]) for k, v in got.items()} == {k: (v[1], v[4]) for k, v in with_null.items()}


def test_decontamination_removes(spark):
    items = [(1, " ".join(f"q{i}" for i in range(20)))]
    docs = [(1, "Keep this. " + items[0][1].upper() + "! And this é"), (2, "clean"), (3, None)]
    bench_df = spark.createDataFrame(items, "item_id long, text string")
    left = decontaminate(docs_frame(spark, docs), bench_df)
    assert left.columns == docs_frame(spark, docs).columns and sorted(r.doc_id for r in left.collect()) == [2, 3] and left.first().spans == "s"
    cut = {r.doc_id: r.text for r in decontaminate(docs_frame(spark, docs), bench_df, remove="spans").collect()}
    assert cut == {1: "Keep this. ! And this é", 2: "clean", 3: None}
    empty = decontaminate(docs_frame(spark, docs), bench_df.limit(0))
    assert empty.count() == 3 and decontaminate(docs_frame(spark, []), bench_df).count() == 0


def test_automaton_lengths():
    import pyarrow as pa

    a = SuffixAutomaton([("i", words_of(pa.array(["a b a b c"]))[0])], 3)
    w = {c: int(words_of(pa.array([c]))[0][0]) for c in "abcx"}
    spans, items = a.spans([w[c] for c in "xababxabc"])
    assert items == {"i"} and (1, 5) in spans and (6, 9) in spans and all(e - s >= 3 for s, e in spans)


def line_docs():
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice(["alpha", "bravo", "kilo", "zulu", "yank", "tango", "delta"]) + str(rng.randrange(99)) for _ in range(n))
    base = [line(n) for n in (4, 8, 20, 40, 80)]
    docs = []
    for i in range(40):
        lines = [line(rng.randrange(1, 30)) for _ in range(rng.randrange(4))]
        for b in base:
            if rng.random() < 0.5:
                x = list(b)
                for _ in range(rng.choice([0, 0, 1, 2, 6])):
                    x[rng.randrange(len(x))] = rng.choice("abcéß")
                lines.append("".join(x) if rng.random() < 0.8 else b.upper())
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    hot = "\n".join(["the very same footer line of all documents"] * 3)
    docs += [(50 + i, hot) for i in range(40)] + [(100, None), (101, ""), (102, "\n\n"), (103, "short"), (104, "short"), (105, "x" * 3000 + "\n" + "x" * 3000 + "y"), (106, base[4] + "\n"), (107, "\n" + base[3])]
    return docs


def test_repeated_lines_match_brute_force(spark):
    docs = line_docs()
    got = {tuple(r) for r in repeated_lines(docs_frame(spark, docs)).select("doc_id", "number", "first_doc_id", "first_number").collect()}
    assert got == brute.lines_gone(docs)


def test_line_dedup_texts(spark):
    docs = line_docs()
    gone = {(i, n) for i, n, _, _ in brute.lines_gone(docs)}
    want = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = "\n".join(x for n, x in enumerate(lines) if (i, n) not in gone)
        if not any((i, n) in gone for n in range(len(lines))):
            want[i] = t
        elif kept.strip():
            want[i] = kept
    out = dedup_lines(docs_frame(spark, docs))
    assert {r.doc_id: r.text for r in out.collect()} == want and out.columns == docs_frame(spark, docs).columns
    assert dedup_lines(docs_frame(spark, [])).count() == 0
    odd = dedup_lines(docs_frame(spark, [(None, "a line of the null document here"), (1, "a line of the null document here"), (1, "a line of the null document here")]).coalesce(1))
    assert [r.doc_id for r in odd.collect()] == [None]
    # a line goes from the row that repeats it, not from another row with its doc_id
    same = [(1, "a line that is said twice here\nand one that is only said once, by row one"), (2, "a line that is said twice here"), (2, "the only line of the other row numbered two")]
    assert sorted((r.doc_id, r.text) for r in dedup_lines(docs_frame(spark, same).coalesce(1)).collect()) == [(1, same[0][1]), (2, same[2][1])]


@pytest.mark.parametrize("least", [1, 5])
def test_lines_of_any_length(spark, least):
    docs = [(1, "ab\nabc\nx\nabcdefg\n\nabcdefgh"), (2, "ABC\nx\nabcdefg"), (3, "abcdefgh\nabcdefghi"), (4, "x")]
    got = {tuple(r) for r in repeated_lines(docs_frame(spark, docs), least=least).select("doc_id", "number", "first_doc_id", "first_number").collect()}
    assert got == brute.lines_gone(docs, least)


def test_short_lines_match_brute_force(spark):
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("abcde fg") for _ in range(n))
    base = [some(n) for n in (1, 3, 7, 8, 9, 12, 14, 17, 19, 21, 23, 26)] + ["=" * 8, "=" * 30, "ß" * 9]
    docs = [(i, "\n".join((b + rng.choice(["", "", "x", "yz"])) if rng.random() < 0.8 else b.upper() for b in rng.sample(base, 5))) for i in range(60)]
    docs += [(100, "short"), (101, "SHORT"), (102, "\n \n\t"), (103, " \nshort"), (104, None), (105, "}\n}\n"), (106, " " * 25), (107, " " * 25), (108, "b\n" * 50)]
    want = {x for x in brute.lines_gone([(i, "\n".join(x if x.strip() or len(x) >= 20 else "" for x in (t or "").split("\n"))) for i, t in docs], 1)}
    got = {tuple(r) for r in repeated_lines(docs_frame(spark, docs), shorter=True).select("doc_id", "number", "first_doc_id", "first_number").collect()}
    assert got == want and (101, 0, 100, 0) in got and (105, 1, 105, 0) in got
    assert {101, 103, 107}.isdisjoint(r.doc_id for r in dedup_lines(docs_frame(spark, docs), shorter=True).collect())


def test_op7_takes_short_lines(spark, tmp_path):
    docs_frame(spark, [(1, "short\nthis"), (2, "Short"), (3, "")]).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_removed for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 0}


def test_near_lines_are_not_lost(spark):
    """Recall of banding at the threshold, over pairs that differ in one stretch."""
    rng = random.Random(8)
    docs, want = [], 0
    for i in range(150):
        a = hashlib.sha512(str(i).encode()).hexdigest()[:80]
        b = a[: rng.randrange(3, 70)] + "é" + a[71:]
        docs += [(2 * i, a), (2 * i + 1, b)]
        want += brute.near(brute.line_shingles(a), brute.line_shingles(b))
    assert repeated_lines(docs_frame(spark, docs)).count() >= 0.97 * want

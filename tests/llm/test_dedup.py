import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citescan.llm import exact_dedup, induced_sort, ngram_join, suffix_dedup, words
from tests.llm.helpers import brute_components, brute_shingles, clashing, documents, edited, order, rows
from tests.llm.helpers import words as words_of

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("k,similarity", [(3, 90), (5, 80)])
def test_jaccard_components_as_brute_force(spark, k, similarity):
    got = [tuple(r) for r in ngram_join.jaccard_components(clashing(documents(spark)), k, similarity).collect()]
    assert order(got) == order(brute_components([(r[0], r[1]) for r in rows()], k, similarity))


def test_jaccard_components_of_common_signatures(spark, monkeypatch):
    """Small limits combine all signatures and cut the groups to a few nodes, which meet in several parts."""
    for name, value in (("COMMON", 1), ("BLOCK", 1024), ("QUERIES", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    got = [tuple(r) for r in ngram_join.jaccard_components(documents(spark), 3, 90).collect()]
    assert order(got) == order(brute_components([(r[0], r[1]) for r in rows()], 3, 90))


def brute_links(items, k, similarity):
    sets = [brute_shingles(t, k) for _, t in items]
    linked = lambda a, b: a and b and 100 * len(a & b) >= similarity * len(a | b)
    return [(d, sum(bool(linked(a, b)) for j, b in enumerate(sets) if j != i)) for i, ((d, _), a) in enumerate(zip(items, sets, strict=True))]


@pytest.mark.parametrize("block,columns", [(1 << 18, 2048), (400, 7)])
def test_links_within_components_as_brute_force(spark, monkeypatch, block, columns):
    """Near copies of near copies: components in which some link and others do not, in one block and in several."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "COLUMNS", columns)
    chain, items = words_of(150, 31), []
    for i in range(12):
        chain = edited(chain, 75, i)
        items.append((1000 + i, chain))
    items += [(2000 + i, edited(items[0][1], 50, 50 + i)) for i in range(8)] + [(3000, items[3][1]), (3001, items[3][1]), (4000, words_of(90, 8)), (4001, words_of(90, 8) + " z")]
    items += [(r[0], r[1]) for r in rows()]
    docs = documents(spark, [(d, t, "en", "s", 1) for d, t in items])
    got = [tuple(r) for r in ngram_join.jaccard_components(docs, 3, 90, links=True).select("doc_id", "n_links").collect()]
    want = brute_links(items, 3, 90)
    assert order(got) == order(want) and len({n for _, n in want}) > 3


def test_links_between_groups_come_from_the_matrix(spark, monkeypatch):
    """With groups of about two nodes most links of twenty near copies are found by queries that open other groups."""
    monkeypatch.setattr(ngram_join, "BLOCK", 1024)
    base = words_of(200, 77)
    items = [(i, edited(base, 150, i)) for i in range(20)] + [(100 + i, words_of(200, 500 + i)) for i in range(20)]
    join = ngram_join.Join(documents(spark, [(d, t, "en", "s", 1) for d, t in items]), 3, 90)
    links = {r[0]: r[1] for r in join.met.groupBy("a").sum("links").collect()}
    want = [n for _, n in brute_links(items, 3, 90)]
    assert sum(links.values()) == sum(want) > 100
    assert join.met.count() > len(links)  # a node's links come from several groups


@pytest.mark.parametrize("stage", [ngram_join.one_of_each, exact_dedup.without_copies])
def test_stages_pass_columns_of_any_name(spark, stage):
    docs = documents(spark)
    names = ["_doc", "_ka", "_kb", "_sha", "ka", "kb", "__doc"]
    got = stage(docs.withColumns({c: F.lit(c) for c in names}))
    assert got.columns == [*docs.columns, *names] and order(r["doc_id"] for r in got.collect()) == order(r["doc_id"] for r in stage(docs).collect())
    assert all(r[c] == c for r in got.select(*names).collect() for c in names)


def test_jaccard_components_of_nothing(spark):
    assert ngram_join.jaccard_components(documents(spark, [])).count() == 0


@pytest.mark.parametrize("similarity", [51, 60, 70, 80, 90])
def test_linked_sets_of_unlike_sizes_share_a_signature(similarity):
    rng = np.random.default_rng(similarity)
    for small in (1, 2, 3, 10, 100, 1000):
        large = np.unique(rng.integers(0, 1 << 63, 100 * small // similarity, dtype=np.uint64) * np.uint64(2))
        part = np.sort(rng.permutation(large)[:small])
        one, two = (np.concatenate(ngram_join.signatures(x, similarity)) for x in (part, large))
        assert len(np.intersect1d(one, two)) > (len(part) < len(large))


def test_one_of_each_keeps_a_row_of_every_component(spark):
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.one_of_each(documents(spark), 5, 80).collect()]
    found = brute_components([(i, r[1]) for i, r in enumerate(rows())], 5, 80)
    ids = [r[0] for r in rows()]
    groups = {}
    for i, n, c in found:
        groups.setdefault(c if n else ("bare", i), []).append(i)
    smallest = [min((ids[i] for i in g), key=lambda d: (d is None, d)) for g in groups.values()]
    assert order(d for d, _ in kept) == order(smallest)
    assert sum(not (t or "").strip() for _, t in kept) == sum(n == 0 for _, n, _ in found)


def brute_copies(items):
    groups: dict[str, list] = {}
    for doc, text in items:
        groups.setdefault((text or "").translate(FOLD), []).append(doc)
    out = []
    for norm, ids in groups.items():
        ids = sorted(ids, key=lambda d: -1 if d is None else d)
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(d, ids[-1], len(ids), i == len(ids) - 1, digest) for i, d in enumerate(ids)]
    return out


def test_copy_groups_as_brute_force(spark):
    got = [tuple(r) for r in exact_dedup.copy_groups(clashing(documents(spark))).collect()]
    assert order(got) == order(brute_copies([(r[0], r[1]) for r in rows()]))


def test_copy_groups_by_small_runs(spark):
    got = [tuple(r) for r in exact_dedup.copy_groups(documents(spark), first=2, growth=4).collect()]
    assert order(got) == order(brute_copies([(r[0], r[1]) for r in rows()]))


def test_copy_groups_of_nothing(spark):
    assert exact_dedup.copy_groups(documents(spark, [])).count() == 0


def test_without_copies_keeps_one_of_each_text(spark):
    kept = exact_dedup.without_copies(documents(spark)).collect()
    texts = Counter((r["text"] or "").translate(FOLD) for r in kept)
    assert set(texts) == {(r[1] or "").translate(FOLD) for r in rows()} and max(texts.values()) == 1


def brute_repeats(items, length):
    data = [(doc, (text or "").encode()) for doc, text in items]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for doc, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("length", [64, 400])
def test_repeats_as_brute_force(spark, length):
    got = [tuple(r) for r in suffix_dedup.without_repeats(clashing(documents(spark)), length, with_text=False).collect()]
    assert order(got) == order(brute_repeats([(r[0], r[1]) for r in rows()], length))


def test_repeats_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 150)
    monkeypatch.setattr(suffix_dedup, "SHARD", 2000)
    got = [tuple(r) for r in suffix_dedup.without_repeats(documents(spark), 100, with_text=False).collect()]
    assert order(got) == order(brute_repeats([(r[0], r[1]) for r in rows()], 100))


def test_repeats_of_one_passage_in_many_contexts(spark, monkeypatch):
    """Segments at a common passage's edges share its anchors: none of them is sorted in one shard."""
    shard, seen = 20_000, spark.sparkContext.accumulator(0)
    sort = suffix_dedup.repeated

    def sort_small(text, length):
        seen.add(int(len(text) > 4 * shard))
        return sort(text, length)

    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "repeated", sort_small)
    rng = np.random.default_rng(5)
    passage = "".join(map(chr, rng.integers(97, 123, 700)))
    text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    items = [(i, f"{text(300)}{'xy'[i % 2]}{passage}{'z' * (i % 5)}{text(300)}") for i in range(300)]
    items += [(300, passage + text(5) + passage), (301, passage[:380] * 4), (302, "ab" * 900), (303, text(9) + passage[100:480] + text(9))]
    docs = documents(spark, [(d, x, "en", "s", len(x)) for d, x in items]).repartition(3)
    got = [tuple(r) for r in suffix_dedup.without_repeats(docs, 400, with_text=False).collect()]
    assert seen.value == 0
    assert order(got) == order(brute_repeats(items, 400))


def test_repeats_of_nothing(spark):
    assert suffix_dedup.without_repeats(documents(spark, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=120), st.integers(0, 60), st.sampled_from([1, 2, 3, 5, 8]), st.booleans())
def test_induced_sort_as_brute_force(body, again, depth, small):
    text = np.array([*body, *body[:again], 0], np.uint8)
    block, queued = induced_sort.BLOCK, induced_sort.QUEUED
    try:
        if small:  # many blocks, most of the queue on disk
            induced_sort.BLOCK, induced_sort.QUEUED = 5, 8
        got = induced_sort.repeated(text, depth)
    finally:
        induced_sort.BLOCK, induced_sort.QUEUED = block, queued
    raw = text.tobytes()
    seen = Counter(raw[i : i + depth] for i in range(len(raw) - depth + 1))
    for i in range(len(raw) - depth):
        assert got[i] == (seen[raw[i : i + depth]] > 1)


def test_words_across_segments(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["A b\tC  d", None, "", "  ", "é É z" * 30, "a b c"])
    whole = words.words(texts)
    monkeypatch.setattr(words, "SEGMENT", 16)
    parts = words.words(texts)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert whole[1].tolist() == [0, 4, 4, 4, 4, 65, 68]


def test_words_of_a_known_pattern_stay_apart(spark):
    import pyarrow as pa

    from citescan.llm import suffix_dedup
    from citescan.llm import words as W

    pattern = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = pattern.translate(str.maketrans("ab", "ba"))
    hashes, _ = W.words(pa.array([f"{pattern} {other}", f" {other.upper()} {pattern}"]))
    assert hashes[0] == hashes[3] != hashes[1] == hashes[2]
    found = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(documents(spark, [(1, pattern, "x", "s", 0), (2, other, "x", "s", 0)])).collect()}
    assert found == {1: 1, 2: 2}
    data = np.frombuffer((pattern + other).encode(), np.uint8)
    for which in (1, 2):
        a, b = suffix_dedup._Prefix(data, which).of(np.array([0, 1024]), np.array([1024, 2048]))
        assert a != b
    # stretches in any place against the polynomial itself
    base, data = suffix_dedup.BASES[0], np.frombuffer(bytes(range(256)) * 300, np.uint8)
    for at, end in ((0, 1), (70_000, 70_400), (3, 76_000)):
        value = sum((int(x) + 1) * pow(base, i, W.PRIME) for i, x in enumerate(data[at:end])) % W.PRIME
        assert int(W.Stretches(data, base).of(np.array([at]), np.array([end]))[0]) == value


def test_huge_words(spark, monkeypatch):
    import pyarrow as pa

    from citescan.llm import words as W

    monkeypatch.setattr(W, "HUGE", 50)
    a = "q" * 60
    hashes, _ = W.words(pa.array([f"{a} x {a.upper()}", f"y  {a}b"]))
    assert hashes[0] == hashes[2] and len(set(hashes.tolist())) == 4


def test_bands_of_large_sets():
    rng = np.random.default_rng(3)
    tokens = np.unique(rng.integers(0, 1 << 63, 6000).astype(np.uint64) * np.uint64(2))
    for seed in range(3):
        gone = np.random.default_rng(seed).choice(len(tokens), len(tokens) // 10, replace=False)
        near = np.unique(np.append(np.delete(tokens, gone), np.random.default_rng(seed).integers(0, 1 << 63, len(gone)).astype(np.uint64)))
        assert 100 * len(np.intersect1d(tokens, near)) >= 80 * len(np.union1d(tokens, near))
        both = [[set(band.tolist()) for band in ngram_join.signatures(x, 80)] for x in (tokens, near)]
        assert all(len(band) <= ngram_join.BAND for band in both[0])
        assert any(len(x & y) >= 2 for x in both[0] for y in both[1])


def test_groups_sent_as_lists_are_those_of_the_plain_join(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 50)  # lists of one node are added up several times
    rows = spark.range(4000).selectExpr("pmod(xxhash64(id), 90) AS node", "pmod(xxhash64(id, 1), 60) AS sig").distinct().withColumn("g", F.col("node") % 12)
    groups = rows.select("sig", "g").distinct()
    for least in (1, 2, 20, 1000):
        listed = [tuple(r) for r in ngram_join._listed_puts(rows, groups, least).collect()]
        assert sorted(listed) == sorted(tuple(r) for r in ngram_join._puts(rows, groups, least).collect())
    assert ngram_join._listed_puts(rows.limit(0), groups, 2).count() == 0


def test_signatures_meet_in_passes(spark, monkeypatch):
    """No exchange holds the signatures of all sets at once, and no signature is in two of them."""
    kept, keep = [], ngram_join.keep

    def seen(df, name, *rest):
        out = keep(df, name, *rest)
        if name == "signatures":
            kept.append({r[0] for r in out.select("sig").distinct().collect()})
        return out

    monkeypatch.setattr(ngram_join, "keep", seen)
    ngram_join.Join(documents(spark), 3, 90)
    every = set().union(*kept)
    assert every and sum(map(len, kept)) == len(every) and max(map(len, kept)) < len(every) / 2

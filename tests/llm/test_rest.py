import importlib
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from citescan.llm import bpe, exact_dedup, mixing, nn_graph, quality, queries, url_filter
from tests.llm.helpers import brute_components, clashing, documents, order, rows

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- URL filter

URLS = [
    None, "", "no scheme.org/x", "http://Example.ORG/en/1/x?y#z", "https://a.example.org/es/", "ftp://com/fr/", "http://x.com/de/1", "http://notcom/de/", "http://org",
    "http://a.b.spam-farm.example.net/p", "http://spam-farm.example.net.evil.io/", "x://y://z.com/fr/", "http:///path", "http://ÄÖ.com/fr/é?#",
]


def judged(url, blocked):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), h + p, say) for say, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    listed = any(host == d or host.endswith("." + d) for d in blocked)
    _, text, say = max(fits, default=(0, None, "block" if listed else "allow"))
    return host, path, text, say, listed


@pytest.mark.parametrize("part_bits,bits", [(1 << 24, 10), (1 << 24, 1), (64, 10)])
def test_url_filter_as_the_rules(spark, monkeypatch, part_bits, bits):
    blocked = queries.BLOCKED_DOMAINS
    urls = URLS + [f"http://h{i}.{d}/" for i, d in enumerate(blocked)] + [f"http://free{i}.example.io/" for i in range(300)]
    cascade = url_filter.Cascade
    monkeypatch.setattr(url_filter, "Cascade", lambda a, b: cascade(a, b, bits_per_key=bits, hashes=2, part_bits=part_bits))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.url_filter(clashing(pages), queries.URL_RULES, blocked).select("page_id", "host", "path", "rule", "verdict", "listed").collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *judged(u, blocked)) for i, u in enumerate(urls))


def test_cascade_of_a_long_list(spark):
    """100,000 listed keys among 400,000: several filters a level, three levels or more, and no key judged wrongly."""
    key = F.concat(F.lit("host"), "id", F.lit(".example.org")).alias("key")
    universe = spark.range(400_000).select(key, (F.col("id") % 4 == 0).alias("listed"))
    cascade = url_filter.Cascade(universe.select("key"), universe.filter("listed").select("key"), part_bits=1 << 18)
    assert len(cascade.levels) >= 3 and cascade.levels[0].parts == 4
    assert universe.filter(cascade.contains(F.col("key")) != F.col("listed")).isEmpty()


def test_url_filter_of_nothing(spark):
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES, ["x.org"]).count() == 0


# ---------------------------------------------------------------- nearest neighbours


def brute(vectors, asked, k):
    x = {i: np.array(v, float) for i, v in vectors}
    out = {}
    for q in asked:
        near = sorted((-float(x[q] @ v), i) for i, v in x.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in near]
    return out


def test_nearest_with_ties_copies_and_unusable_rows(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.standard_normal(8) * (1 + i % 3)).tolist()) for i in range(400)]
    vectors += [(400 + i, vectors[20][1]) for i in range(60)]
    odd = [(900, None), (920, [0.0] * 8), (940, [float("nan")] + [1.0] * 7), (960, [None] + [1.0] * 7), (980, [1.0, 2.0]), (None, vectors[3][1]), (1000, [float("inf")] * 8)]
    df = spark.createDataFrame([*vectors, *odd], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nn_graph.nearest(clashing(df), F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute(vectors, [i for i, _ in vectors if i % 20 == 0], 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    x = dict(vectors)
    assert all(abs(np.dot(x[q], x[i]) - s) < 1e-9 for q, found in got.items() for i, s in found)
    assert all(found == sorted(found, key=lambda e: (-e[1], e[0])) for found in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_nearest_of_a_few_and_of_none(spark):
    few = spark.createDataFrame([(20 * i, [float(i), 1.0]) for i in range(3)], "vec_id long, embedding array<double>")
    got = nn_graph.nearest(few, F.col("vec_id") % 20 == 0).collect()
    assert order((r["query_id"], r["rank"], r["vec_id"]) for r in got) == order([(0, 1, 40), (0, 2, 20), (20, 1, 40), (20, 2, 0), (40, 1, 20), (40, 2, 0)]) or len(got) == 6
    assert nn_graph.nearest(few.limit(0), F.lit(True)).count() == 0


# ---------------------------------------------------------------- mixing


def filled(sizes, cycle=(1, 2, 3), cap=3.0):
    """Shares by weight, what is above the cap shared again, until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in full and target[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_mix_meets_its_targets(spark):
    got = mixing.mix(clashing(documents(spark)), shards=4, block_words=8).collect()
    assert len(got) == len(rows())
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == sum(p["n_words"] for p in r["pieces"])
    want = filled(sizes)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(documents(spark).repartition(3), shards=4, block_words=8).collect()
    assert order((r["doc_id"], r["size"], r["taken"]) for r in got) == order((r["doc_id"], r["size"], r["taken"]) for r in again)


def test_mixed_rows_are_pieces_of_documents(spark):
    docs = documents(spark)
    got = mixing.mixed(docs, shards=4, block_words=8).collect()
    words = sum(len((r["text"] or "").split()) for r in got)
    assert words == sum(r["taken"] for r in mixing.mix(docs, shards=4, block_words=8).collect())
    texts = defaultdict(list)
    for r in rows():
        texts[r[0]].append(r[1] or "")
    assert all(any(r["text"].strip() in t for t in texts[r["doc_id"]]) for r in got)


@pytest.mark.parametrize("total,marked,drawn", [(50, 20, 10), (400, 390, 200), (20_000, 8_000, 6_000), (20_000, 300, 19_000), (10**12, 4 * 10**11, 10**6)])
def test_draws_have_their_distribution(spark, total, marked, drawn):
    """Inverted and rejected draws against the exact distribution function; the last against its binomial limit."""
    n = 6000
    u = lambda name, i: mixing.uniform(F.lit(name), i, F.col("id"))
    long = lambda x: F.lit(x).cast("long")
    x = np.sort([r[0] for r in spark.range(n).select(mixing.hypergeometric(u, long(total), long(marked), long(drawn))).collect()])
    log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    low, high = max(0, drawn - (total - marked)), min(marked, drawn)
    assert low <= x[0] and x[-1] <= high
    if total > 10**9:
        share = marked / total
        weights = lambda k: log(drawn, k) + k * math.log(share) + (drawn - k) * math.log1p(-share)
        mean, sd = drawn * share, (drawn * share * (1 - share)) ** 0.5
        ks = np.arange(int(mean - 12 * sd), int(mean + 12 * sd))
    else:
        weights = lambda k: log(marked, k) + log(total - marked, drawn - k) - log(total, drawn)
        ks = np.arange(low, high + 1)
    exact = np.cumsum(np.exp([weights(int(k)) for k in ks]))
    assert abs(exact[-1] - 1) < 1e-3
    seen = np.searchsorted(x, ks, side="right") / n
    assert np.abs(seen - exact).max() < 1.95 / n**0.5  # beyond the bound with a chance below 0.001


def test_mixed_passes_columns_of_any_name(spark):
    docs = documents(spark)
    names = ["_doc", "_source", "_copy", "_size", "_pieces", "_place", "_piece", "__doc"]
    got = mixing.mixed(docs.withColumns({c: F.lit(c) for c in names}), shards=4, block_words=8)
    assert got.columns == [*docs.columns, *names] and order(got.select(*docs.columns).collect()) == order(mixing.mixed(docs, shards=4, block_words=8).collect())
    assert all(r[c] == c for r in got.select(*names).collect() for c in names)


def test_mixes_agree_however_rows_are_dealt(spark):
    some = [(5, " ".join(f"w{i}x{j}" for j in range(100)), "en", "s", i) for i in range(12)] + [(None, "a b c d", lang, "s", 4) for lang in ("de", "en", "fr")]
    docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long")
    mixes = [sorted(map(str, mixing.mixed(docs.repartition(n), cycle=(1, 2, 3), cap=0.5, block_words=16).collect())) for n in (1, 3, 7)]
    assert mixes[0] == mixes[1] == mixes[2] and mixes[0]


def test_mix_of_nothing(spark):
    assert mixing.mix(documents(spark, [])).count() == 0


# ---------------------------------------------------------------- pipeline and registration


def test_pipeline_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.count()]
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.keep(stage(spark, docs, SF), "stage")
        assert tuple(docs.columns) == pipeline.COLUMNS
        kept.append(docs.count())
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] > 0 and kept[4] > 0
    tokens = pipeline.STAGES[-1][1](spark, docs, SF)
    assert tokens.count() == kept[4] and tokens.filter("n_tokens * 4 <> length(ids)").isEmpty()


def plain_stages(spark, docs):
    """Each stage's rows with the rows that a plain version keeps of what the stage was given."""
    pipeline = importlib.import_module("corpus_pipeline")
    stages = dict(pipeline.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    as_rows = lambda df: [tuple(r) for r in df.select(*pipeline.COLUMNS).collect()]
    fold = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)

    model = quality.train(docs, labels)
    given = as_rows(docs)
    score = model.score(quality.features(pa.array([r[1] for r in given], pa.string())))
    docs = pipeline.keep(stages["quality"](spark, docs, SF), "stage")
    yield "quality", as_rows(docs), [r for r, s in zip(given, score, strict=True) if s >= queries.GOOD]

    best = {}
    for r in as_rows(docs):
        same = (r[1] or "").translate(fold)
        if same not in best or (r[0] is not None, r[0]) > (best[same][0] is not None, best[same][0]):
            best[same] = r
    docs = pipeline.keep(stages["exact_dedup"](spark, docs, SF), "stage")
    yield "exact_dedup", [(r[0], (r[1] or "").translate(fold)) for r in as_rows(docs)], [(r[0], same) for same, r in best.items()]

    given = as_rows(docs)
    found = brute_components([(i, r[1]) for i, r in enumerate(given)], 5, 80)
    groups = defaultdict(list)
    for i, n, c in found:
        groups[c if n else ("bare", i)].append(given[i][0])
    docs = pipeline.keep(stages["near_dedup"](spark, docs, SF), "stage")
    yield "near_dedup", [r[0] for r in as_rows(docs)], [min(g, key=lambda d: (d is None, d)) for g in groups.values()]

    given = as_rows(docs)
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    sizes, texts = defaultdict(int), defaultdict(list)
    for r in given:
        sizes[r[3]] += size(r[1])
        texts[r[0], r[2], r[3]].append(r[1] or "")
    want = filled(sizes) if given else {}
    docs = pipeline.keep(stages["mixing"](spark, docs, SF), "stage")
    taken = dict.fromkeys(sizes, 0)
    mixed = as_rows(docs)
    for r in mixed:
        taken[r[3]] += size(r[1])
        assert any(r[1].strip() in t for t in texts[r[0], r[2], r[3]]) and r[4] == len(r[1])
    yield "mixing", [s for s in sizes if abs(taken[s] - want[s]) <= 1], list(sizes)

    ranks, pattern = queries.byte_vocabulary()
    with open(ranks, "rb") as f:
        known = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    tokens = [(r["doc_id"], bytes(r["ids"])) for r in stages["tokens"](spark, docs, SF).collect()]
    yield "tokens", tokens, [(r[0], np.array(known.encode_ordinary(r[1]), "<u4").tobytes()) for r in mixed]


@pytest.mark.parametrize("table", ["sf", "odd", "none"])
def test_pipeline_stages_as_plain_versions(spark, table):
    """On the generated documents, on nulls, empty and long texts, repeated rows and ids, and on no rows at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet") if table == "sf" else documents(spark, None if table == "odd" else [])
    seen = []
    for name, got, want in plain_stages(spark, docs):
        assert order(got) == order(want), name
        seen.append(name)
    assert seen == [n for n, _ in importlib.import_module("corpus_pipeline").STAGES]


def test_eleven_queries_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    assert set(entry.oracle_sql()) <= names

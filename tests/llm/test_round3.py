"""Language-model scores, the conversation trie and fill-in-middle texts against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from citescan.llm import conv_trie, fill_middle, lm_score, queries
from tests.llm import helpers as H

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD)), None]


def out(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 10 == 0


def test_tokens_of_slices():
    texts = pa.array(["dropped", " A\tb\x0b\x0cC\r\n", None, "", "É\x1cx  \x85y"])
    words, sizes = lm_score.tokens(texts.slice(1))
    assert words.to_pylist() == ["a", "b", "c", "É\x1cx", "\x85y"] and sizes.tolist() == [3, 0, 0, 2]


@pytest.fixture(scope="module")
def trained(spark):
    docs = H.documents(spark)
    return docs, lm_score.train(docs)


def test_scores_against_counts(spark, trained):
    docs, model = trained
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts = Counter(w for doc, text in rows if not out(doc) for w in plain_tokens(text))
    total, kinds = sum(counts.values()), len(counts)
    found = lm_score.scored(H.clashing(docs), model).collect()
    assert (model.outputs.total, model.outputs.distinct) == (total, kinds) and len(found) == len(rows)
    expected = []
    for doc, text in rows:
        w = plain_tokens(text)
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        expected.append((doc, len(w), sum(counts[x] > 0 for x in w), round(base, 6)))
    assert H.order((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == H.order(expected)
    assert all(r.score < 0 and r.key == "clash" for r in found)


def test_probabilities_sum_to_one(trained):
    model, o = trained[1].model, trained[1].outputs
    rng = np.random.default_rng(1)
    before = rng.integers(0, o.n + 1, (lm_score.CONTEXT, 40))
    sums = np.zeros(40)
    for i in range(len(o.words)):
        known, unknown = lm_score.log_probabilities(model, o, before, np.full(40, o.output[i]))
        share = 1.0 if o.own[o.output[i]] else (o.count[i] - o.discount) / o.weight[o.output[i]]
        sums += 10**known * share
    assert np.allclose(sums + 10**unknown, 1, atol=1e-5)


def test_words_beyond_the_head_score_alike(trained, monkeypatch):
    docs, model = trained
    whole = {(r.doc_id, r.n_tokens, r.n_known): r for r in lm_score.scored(docs, model).collect()}
    monkeypatch.setattr(lm_score, "HEAD", 40)
    small = lm_score.Trained(lm_score._outputs(model.counts), model.model, model.counts)
    assert len(small.outputs.words) <= 40 < len(model.outputs.words)
    # a head smaller than the outputs: frequent words that it lacks share outputs, so only base and counts are equal
    for r in lm_score.scored(docs, small).collect():
        assert abs(whole[r.doc_id, r.n_tokens, r.n_known].base_score - r.base_score) < 1e-6
    monkeypatch.setattr(lm_score, "HEAD", 1 << 17)
    cut = lm_score._outputs(model.counts)
    keep = np.flatnonzero(cut.count > 2)
    cut.words, cut.count, cut.output = cut.words.take(pa.array(keep)), cut.count[keep], cut.output[keep]
    if (cut.output[: len(keep)] < lm_score.OWN).sum() == (model.outputs.output < lm_score.OWN).sum():
        for r in lm_score.scored(docs, lm_score.Trained(cut, model.model, model.counts)).collect():
            assert abs(whole[r.doc_id, r.n_tokens, r.n_known].score - r.score) < 1e-4 * max(1, abs(r.score))


def test_training_tells_languages(spark):
    rows = [(i, " ".join(f"{'ab'[i % 2]}{(7 * j + i) % 50}" for j in range(200)), "x", "s", 0) for i in range(120)]
    docs = H.documents(spark, rows)
    found = lm_score.scored(docs, lm_score.train(docs)).collect()
    assert all(r.score > r.base_score + 0.2 * r.n_tokens for r in found)
    again = lm_score.scored(docs, lm_score.train(docs)).collect()
    assert [(r.doc_id, r.score) for r in sorted(found)] == [(r.doc_id, r.score) for r in sorted(again)]


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if out(i))
    docs = H.documents(spark, [(held, "a b", "x", "s", 0), (None, "c", "x", "s", 0)])
    found = lm_score.scored(docs, lm_score.train(docs)).collect()
    assert [(r.n_known, r.base_score, r.score) for r in found] == [(0, 0.0, 0.0)] * 2
    empty = H.documents(spark).limit(0)
    assert lm_score.scored(empty, lm_score.train(empty)).count() == 0


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in sorted(rebuilt.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = Counter(), Counter()
    for path, who in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(who) - 1) * len(path[-1][1]) if path else 0
    return [
        (min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, who in members.items()
    ]


def chats():
    rows = []
    for c in [*range(0, 240, 3), 100, 200, 7_000_001]:
        for t in range(c % 9 if c % 5 else 4):
            rows.append((c, t, ("user", "assistant")[t % 2], f"turn {t} " + "é" * (c % 4 if t > 2 else 1)))
    rows += [(4, None, None, None), (4, None, None, None), (4, 1, "a", "x"), (4, 1, "a", "w"), (None, 1, "a", "x"), (8, 0, "user", ""), (900, 0, "user", "long"), *[(950, t, "user", f"{t}") for t in range(70)]]
    rows += [(c, t, "user", "same") for c in range(1000, 1100) for t in range(8)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_trie_against_brute_force(spark, tmp_path):
    spark.createDataFrame(chats(), SCHEMA).selectExpr("*", "'x' as key", "0 as depth", "'y' as said").repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    found = queries.op12_conversation_trie(spark, str(tmp_path)).collect()
    assert H.order(map(tuple, found)) == H.order(brute_trie(chats()))


def test_trie_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op12_conversation_trie(spark, str(tmp_path)).count() == 0


def test_partial_tries_are_bounded(monkeypatch):
    turns = [(c, pos, hashlib.sha256(b"%d" % (pos * (c % 3))).digest(), pos) for c in range(50) for pos in range(c % 7)] + [(c, 0, b"", 0) for c in range(50) if c % 7 == 0]
    turns = sorted(turns)
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*turns[i : i + 9], strict=True)], names=["conv_id", "pos", "said", "chars"]) for i in range(0, len(turns), 9)]

    def summed(tables):
        n, ends = Counter(), defaultdict(list)
        for t in tables:
            for r in t.to_pylist():
                n[r["key"]] += r["n"]
                ends[r["key"]] += r["ends"]
        return n, {k: sorted(v) for k, v in ends.items()}

    whole = list(conv_trie._partial(iter(batches)))
    monkeypatch.setattr(conv_trie, "NODES", 3)
    parts = list(conv_trie._partial(iter(batches)))
    assert len(whole) == 1 and len(parts) > 5 and max(p.num_rows for p in parts) <= 12 and summed(whole) == summed(parts)


def brute_middle(doc, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", text, None, None
    if h[3] % 100 < 80:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def middle_rows():
    more = ["<P>", "a <M> b", "< S> <", "x<y <Pz P> >S> <S", " \t\n ", "a\r\nb\x0b\x0c c\x85d e", "<<<>>> <<P <<S <<M M>>"]
    return [*H.rows(), *[(1000 + 40 * i + j, t, "x", None, 0) for i, t in enumerate([*more, "\U0001f600 é naïve <", "<S a <P b <M c"]) for j in range(20)]]


def test_middle_against_brute_force(spark):
    docs = H.documents(spark, middle_rows()).selectExpr("*", "'old' as FORM", "'c' as units", "'c' as _h")
    cut = fill_middle.fill_in_middle(docs)
    found = cut.withColumn("again", fill_middle.restored(cut["output"], cut["form"])).collect()
    expected = [(d, *brute_middle(d, t), t or "") for d, t, *_ in middle_rows()]
    assert H.order((r.doc_id, r.n_units, r.form, r.output, r.prefix_chars, r.middle_chars, r.again) for r in found) == H.order(expected)
    assert {r.form for r in found} == {"plain", "psm", "spm"} and found[0].units == "c"
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_middle_with_other_sentinels(spark):
    options = fill_middle.Options("<|p|>", "<|s|>", "<|m|>", seed="7", rate=100, spm=0)
    cut = fill_middle.fill_in_middle(H.documents(spark), options)
    assert cut.filter(fill_middle.restored(cut["output"], cut["form"], options).isNull()).count() == 0
    assert {r.form for r in cut.select("form").distinct().collect()} == {"psm", "plain"}
    with pytest.raises(ValueError):
        fill_middle.Options("P", "<S>", "<M>")

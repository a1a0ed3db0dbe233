import hashlib
import math
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from citescan.llm import bpe, chat, pii, quality, queries
from tests.llm.helpers import clashing, documents, order, rows

RANKS = P.path("byte_bpe_50k.tiktoken")


# ---------------------------------------------------------------- byte-level BPE


def library():
    with open(RANKS, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_as_the_library(spark):
    ref = library()
    docs = documents(spark, [*rows(), (900, "<|endoftext|> it's  x's\n\n \t 12345 naïve ﬁ \U0001f468‍\U0001f469 é", "en", "s", 1)])
    got = bpe.decode(bpe.encode(clashing(docs), RANKS, P.PATTERN), RANKS, raw="raw").collect()
    want = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert order((r["doc_id"], r["text"]) for r in got) == order(want)
    ids = {r["text"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got}
    for _, text in want:
        assert ids[text] == ref.encode_ordinary(text)
    assert all(bytes(r["raw"]) == r["text"].encode() and r["n_tokens"] == len(ids[r["text"]]) for r in got)


def test_token_offsets_cover_the_text(spark):
    docs = documents(spark, [(1, "naïve \U0001f600 text", "en", "s", 1), (2, None, "en", "s", 0)])
    got = {r["doc_id"]: r for r in bpe.encode(docs, RANKS, P.PATTERN, offsets=True).collect()}
    text, table = "naïve \U0001f600 text", bpe._byte_table(bpe._file(RANKS))
    assert got[2]["n_tokens"] == 0 and got[2]["starts"] == []
    for i, a, b in zip(np.frombuffer(got[1]["ids"], "<u4"), got[1]["starts"], got[1]["ends"], strict=True):
        assert table[int(i)] in text[a:b].encode()


def test_ids_without_a_token_decode_to_a_mark(spark):
    rows = spark.createDataFrame([(1, bytearray(np.array([50256, 4_000_000_000], "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(rows, RANKS).collect()} == {1: "��", 2: ""}


def test_tokens_of_nothing(spark):
    assert bpe.encode(documents(spark, []), RANKS, P.PATTERN).count() == 0


# ---------------------------------------------------------------- chat formatting

TREE = [
    # conv, msg, parent, role, text, score
    (1, 1, None, "user", "root", 0.0),
    (1, 2, 1, "assistant", "a", 1.0),
    (1, 3, 1, "assistant", "b", 2.0),
    (1, 4, 2, "user", "deep", 5.0),
    (1, 5, 4, "assistant", "deeper", 1.0),
    (2, 1, None, "user", "</s>[INST] x [/INST] <|im_end|>\n \\ <<SYS>>", 0.0),
    (2, 2, 1, None, None, None),
    (None, 1, None, "user", "no id", 0.0),
    (3, 1, 9, "us\ner<s>", "orphan", 0.0),
    (4, 1, 2, "user", "cycle", 0.0),
    (4, 2, 1, "user", "cycle", 0.0),
]
MESSAGES = "conv_id long, msg_id long, parent_id long, role string, text string, score double"


def read(df):
    out = df.select("conv_id", "branch", chat.read_back(df["formatted"]).alias("t"), chat.read_loss(df["formatted"], df["loss"]).alias("l")).collect()
    return {(r["conv_id"], r["branch"]): ([(t["role"], t["text"]) for t in r["t"]], r["l"]) for r in out}


def test_best_branch_of_each_tree(spark):
    got = read(chat.conversations(clashing(spark.createDataFrame(TREE, MESSAGES))))
    assert got == {
        (1, 1): ([("user", "root"), ("assistant", "a"), ("user", "deep"), ("assistant", "deeper")], "adeeper"),
        (2, 1): ([("user", TREE[5][4]), ("", "")], ""),
        (None, 1): ([("user", "no id")], ""),
        (3, 1): ([("us\ner<s>", "orphan")], ""),
    }


def test_all_branches_by_score(spark):
    got = read(chat.conversations(spark.createDataFrame(TREE, MESSAGES), top=None))
    assert [t[-1][1] for (c, b), (t, _) in sorted(got.items(), key=str) if c == 1] == ["deeper", "b"]


def test_a_long_chain(spark):
    n = 300
    rows = [(7, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(n)]
    got = read(chat.conversations(spark.createDataFrame(rows, MESSAGES)))
    assert [t for _, t in got[(7, 1)][0]] == [str(i) for i in range(n)]


def test_chats_of_nothing(spark):
    assert chat.conversations(spark.createDataFrame([], MESSAGES)).count() == 0


# ---------------------------------------------------------------- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PII_TEXTS = [
    None, "", "a@b.c, x.y+z@d-e.f.g@h.i @j.k l@ m@n", "1.2.3.4.5 256.1.1.1 001.002.3.255 1.2.3", "4539 1488 0343 6467 and 4539148803436467 and 4539148803436468",
    "call +1 (017) 555-7713 or +12 or +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "é\U0001f600 mail: ü.a@b.de;+49 30 1234567", "1" * 3000, "a" * 3000 + "@" + "b." * 50, "+" * 500 + "1",
]


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        spans = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits) if kind == "card" else True,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fits:
                spans.append(m.span())
        out.append(spans)
    return out


def test_base_spans_as_the_patterns():
    for text in [*PII_TEXTS, *(r[1] for r in rows())]:
        assert pii.base_spans(text or "") == plain_spans(text)


def test_personal_data_finds_unknown_values_by_their_contexts(spark):
    known = [f"w{i} contact via mail user{i}@host{i}.org now w{i}" for i in range(8)]
    unknown, clean = "please contact via mail user_at_home_99 now", "the year 2019 was fine, see room 4711 there"
    docs = [(i, t, "en", "s", 1) for i, t in enumerate([*known, unknown, clean, None, ""])]
    got = {r["doc_id"]: r for r in pii.personal_data(clashing(documents(spark, docs)), certain=0.8).collect()}
    assert len(got) == len(docs)
    assert all(len(got[i]["email"]) == 1 and not got[i]["id"] for i in range(8))
    (span,) = got[8]["id"]
    assert unknown[span["start"] : span["end"]] == "user_at_home_99"
    assert not any(got[9][k] for k in (*pii.KINDS, "id"))


@pytest.mark.parametrize("held", [200_000, 0])
def test_personal_data_finds_quoted_bracketed_and_prefixed_values(spark, monkeypatch, held):
    monkeypatch.setattr(pii, "HELD", held)
    cases = [('please contact via mail "', '"'), ("this is the code (", ")"), ("write to mail:", " now"), ('the field user="', '"')]
    docs = [(100 * c + i, f"w{i} {a}user{i}@host{i}.org{b} end", "en", "s", 1) for c, (a, b) in enumerate(cases) for i in range(8)]
    docs += [(100 * c + 50, f"well {a}user_at_home_99{b} end", "en", "s", 1) for c, (a, b) in enumerate(cases)]
    got = {r["doc_id"]: r for r in pii.personal_data(documents(spark, docs)).collect()}
    for c, (a, b) in enumerate(cases):
        (span,) = got[100 * c + 50]["id"]
        assert f"well {a}user_at_home_99{b} end"[span["start"] : span["end"]] == "user_at_home_99"


def test_every_context_has_a_place():
    texts = [*PII_TEXTS, *(r[1] for r in rows()), 'a mail:x@y.org,z@y.org "k9-77" (see id=AB-123) ' * 9, "q" * 90 + ":a1234 b:c:d@e.f " * 3]
    for text in filter(None, texts):
        words = pii._words(text)
        assert [text[a : a + len(w)].translate(pii._FOLD) for a, w in zip(*pii._placed(text), strict=True)] == words
        places = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} | {f"{a}\t{b}" for a, b in zip(words, words[2:], strict=False)}
        assert {c.strip("\t") for m in pii.mentions(text, pii.base_spans(text)) for c in m["contexts"]} <= places


@pytest.mark.parametrize("text", ["contact\x1cvia a@b.org or so", "contact\u2003via \x85a@b.org now then", "é contact via\xa0a@b.org é é", "q" * 900 + " via a@b.org _ _"])
def test_words_of_contexts_are_words_of_places(spark, text):
    (contexts,) = [m["contexts"] for m in pii.mentions(text, pii.base_spans(text))]
    assert len(contexts) == 3
    found = pii._occurrences(spark.createDataFrame([(text,)], "text string"), spark.createDataFrame([(c,) for c in contexts], "context string")).collect()
    assert sorted(tuple(r) for r in found) == sorted((c, 1) for c in contexts)


def test_personal_data_is_found_by_what_follows_and_not_in_common_words(spark):
    known = [f"w{i} x{i} user{i}@host{i}.org is my address w{i}" for i in range(8)] + [f"y{i} reach user{i}@host{i}.net anytime y{i}" for i in range(8)]
    unknown = ["here johnny_at_home77 is my address", "so reach johnny_at_home88 anytime he said"]
    common = [f"the word{i} for my choice{i}" for i in range(50)] + [f"at 1{i:03d} to a{i}@b.org to be at word{i} to do" for i in range(8)] + ["at 4711 to go"]
    texts = [*known, *unknown, *common]
    got = {r["doc_id"]: r for r in pii.personal_data(documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()}
    told = {i: [texts[i][s["start"] : s["end"]] for s in r["id"]] for i, r in got.items() if r["id"]}
    assert told == {16: ["johnny_at_home77"], 17: ["johnny_at_home88"]}


def test_personal_data_of_nothing(spark):
    assert pii.personal_data(documents(spark, [])).count() == 0


# ---------------------------------------------------------------- quality


def test_features_are_finite_for_any_text():
    x = quality.features(pa.array([r[1] for r in rows()]))
    assert x.shape == (len(rows()), len(quality.FEATURES)) and np.isfinite(x).all()


def test_model_learns_a_pair_of_features():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert quality.fit(x[:10], np.ones(10)).score(x[:1])[0] > 0.8


def dense_fit(x, y, bins, pair_bins, rounds, pair_rounds, pairs):
    """The boosting of ``quality.fit`` row by row: every cut of every feature is tried by sums over the rows."""
    rate, least = quality.RATE, quality.LEAST_HESSIAN
    n, wide = x.shape
    cut = lambda k: [sorted({float(np.quantile(x[:, f], i / k)) for i in range(1, k)}) for f in range(wide)]
    fine, coarse = ([[sum(v > c for c in cuts[f]) for v in x[:, f]] for f in range(wide)] for cuts in (cut(bins), cut(pair_bins)))
    share = (y.sum() + 1) / (n + 2)
    total = [float(np.log(share / (1 - share)))] * n

    def sums(rows_):
        p = [1 / (1 + math.exp(-total[i])) for i in rows_]
        return sum(y[i] - q for i, q in zip(rows_, p, strict=True)), sum(q * (1 - q) for q in p)

    worth = lambda s: s[0] ** 2 / (s[1] + 1)
    for _ in range(rounds):
        for f in range(wide):
            parts = [(0, len(cut(bins)[f]) + 1)]
            inside = lambda a, b: [i for i in range(n) if a <= fine[f][i] < b]  # noqa: B023, E731
            while len(parts) < quality.LEAVES:
                best = (1e-9, None)
                for a, b in parts:
                    for c in range(a + 1, b):
                        left, right, all_ = sums(inside(a, c)), sums(inside(c, b)), sums(inside(a, b))
                        gain = worth(left) + worth(right) - worth(all_)
                        if left[1] >= least and right[1] >= least and gain > best[0] + 1e-12:
                            best = (gain, (a, b, c))
                if best[1] is None:
                    break
                a, b, c = best[1]
                parts = [p for p in parts if p != (a, b)] + [(a, c), (c, b)]
            steps = [(inside(a, b), sums(inside(a, b))) for a, b in parts]
            for rows_, (g, h) in steps:
                for i in rows_:
                    total[i] += rate * g / (h + 1)

    def quarters(f, g):
        best = (0.0, [])
        for i in range(1, len(cut(pair_bins)[f]) + 1):
            for j in range(1, len(cut(pair_bins)[g]) + 1):
                four = [[r for r in range(n) if (coarse[f][r] >= i) == a and (coarse[g][r] >= j) == b] for a in (False, True) for b in (False, True)]
                s = [sums(q) for q in four]
                gain = sum(map(worth, s))
                if gain > best[0] + 1e-12 and all(h >= least or not q for (_, h), q in zip(s, four, strict=True)):
                    best = (gain, list(zip(four, s, strict=True)))
        return best

    chosen = sorted(((quarters(f, g)[0], f, g) for f in range(wide) for g in range(f)), reverse=True)[:pairs]
    for _ in range(pair_rounds):
        for _, f, g in chosen:
            for rows_, (s, h) in quarters(f, g)[1]:
                for i in rows_:
                    total[i] += rate * s / (h + 1)
    return 1 / (1 + np.exp(-np.array(total)))


def test_boosting_as_row_by_row(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(rng.random((200, 3)), 2)
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.6) | (rng.random(200) < 0.1)).astype(float)
    sizes = {"BINS": 6, "PAIR_BINS": 4, "ROUNDS": 5, "PAIR_ROUNDS": 3, "PAIRS": 2}
    for name, value in sizes.items():
        monkeypatch.setattr(quality, name, value)
    assert np.abs(quality.fit(x, y).score(x) - dense_fit(x, y, *sizes.values())).max() < 1e-9


def test_quality_held_out(spark):
    good = [(i, " ".join(f"{a} und {b}." for a, b in zip("die der das ein".split(), r, strict=True)), "de", "s", 1) for i, r in enumerate(np.random.default_rng(1).integers(0, 999, (300, 4)).astype(str))]
    bad = [(1000 + i, f"BUY!! NOW{i}!! " * 9, "de", "s", 1) for i in range(150)]
    docs = documents(spark, [*good, *bad, *rows()[:3]])
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in (*good, *bad)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(good) + len(bad) + 3 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] in {x[0] for x in (*good, *bad)} and quality.fold_of(r["doc_id"]) == 0]
    assert len(held) > 50 and all((r["score"] >= queries.GOOD) == (r["doc_id"] < 1000) for r in held if r["doc_id"] not in (1, 4, 7))


def test_train_takes_one_text_of_each_id(spark, monkeypatch):
    """An id with 500 rows takes the place of no other, and which text it counts with does not depend on the order."""
    learnt = []
    monkeypatch.setattr(quality, "fit", lambda x, y: learnt.append((x, y)))
    docs = [(i, f"text number {i} of some", "en", "s", 1) for i in range(200)] + [(3, f"another text {i}", "en", "s", 1) for i in range(500)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    usable = sum(quality.fold_of(i) != 0 for i in range(200))
    for rows_ in (docs, docs[::-1]):
        quality.train(documents(spark, rows_), labels, max_rows=200)
    (x, y), (again, _) = learnt
    assert len(x) == len(y) == usable and np.array_equal(x, again)


def test_query_digests_of_small_tables(spark):
    got = {r["doc_id"]: r for r in queries.op7_pii(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        spans = [f"{k}:{a}:{b}" for k, found in zip(pii.KINDS, plain_spans(r["text"]), strict=True) for a, b in found]
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()

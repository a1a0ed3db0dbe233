"""Documents that the operators' tests share: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(text, every, seed):
    rng, parts = random.Random(seed), text.split(" ")
    for i in range(rng.randrange(every), len(parts), every):
        parts[i] = f"x{rng.randrange(10**6)}"
    return " ".join(parts)


def texts():
    base = words(220, 1)
    out = [None, "", "   \n\t ", "one", "one two", "ONE two", "ÉÉ é", base, base.upper(), base + " ", base.replace(" ", "  ")]
    out += [edited(base, k, k) for k in (40, 60, 80, 100, 150, 200)]
    out += [words(n, 100 + n) for n in (3, 4, 5, 9, 10, 11, 30, 60, 120)]
    out += [words(4000, 7), "a" * 5000, "ab " * 2000, words(60, 5) + " \U0001f600 naïve\x00 " + words(60, 5)]
    passage = words(150, 999, 10**6)
    out += [f"{words(30, 50 + i)} {passage} {words(30, 70 + i)}" for i in range(4)]
    return out


def rows():
    found = [(i * 3 + 1, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts())]
    # repeated rows, a repeated id with another text, a null id
    return [*found, found[7], found[7], (found[12][0], "another text of a repeated id", "en", "s1", 29), (None, found[7][1], "de", "s2", 5), (None, "no id", "de", "s2", 5)]


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def clashing(df):
    """The same rows with columns that have names an operator may use itself."""
    names = ("rid", "key", "node", "h", "n", "sig", "gid", "body", "rest", "size", "score", "x", "ids", "kept", "comp", "_id", "copy", "pieces", "runs")
    return df.withColumns({n: F.lit("clash") for n in names if n not in df.columns})


def brute_shingles(text, k):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(items, k, similarity):
    """(doc_id, number of shingles, smallest doc_id of the component) of each row; null ids are largest."""
    sets = [brute_shingles(t, k) for _, t in items]
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= similarity * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(items):
        if doc is not None:
            r = root(i)
            least[r] = min(least.get(r, doc), doc)
    return [(doc, len(sets[i]), least.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(items)]


def order(found):
    return sorted(found, key=str)

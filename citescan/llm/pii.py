"""Personal data: fixed kinds by pattern, further identifiers by bootstrapped contexts.

Emails, addresses of machines, card numbers and phone numbers are found by their
form. They are the seeds: the two words before a mention, the two after it, and, if
it is one word, the one before with the one after are lexical patterns (a token's
prefix ``key:`` or ``key=`` is a word of its own), and every mention that looks like
an identifier links its patterns with its value. Spark scores this graph in rounds: a
pattern is worth the share of known values among all places where its words occur, a
value is worth what its patterns leave no doubt of. Mentions of unknown values in
patterns that end up certain are reported as kind ``id``.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citescan.llm.exact_dedup import LOWER, UPPER
from citescan.llm.sieve import BITS, bits_of
from citescan.session import keep

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
#: pairs of words whose counts a task holds at once
HELD = 200_000

# Each run is taken whole (possessive), and a start inside a run that failed is
# not tried again, where that cannot change what matches; so all are linear.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
#: a prefix of a token that is a word of its own
_KEY = re.compile(r"(?<!\S)[\"'`(\[{<*#]*+[A-Za-z_-]++[:=](?=\S)")
_WHOLE = re.compile(r"\S+")
_WRAP = ".,;:!?()[]{}<>\"'`*#$%&|"
_FOLD = str.maketrans(UPPER, LOWER)

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """The local part is the run of its characters before an @, as far as the last match lets it go."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", done)
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[list[Span]]:
    """Spans of each of KINDS, in order."""
    ips, cards, phones = [], [], []
    if _DIGIT.search(text):
        ips = [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
        if "+" in text:
            phones = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdecimal() for c in m[0]) <= 15]
    return [emails(text), ips, cards, phones]


def _words(text: str) -> list[str]:
    """White-space tokens, prefixes cut off, A-Z lower-cased."""
    return _KEY.sub(r"\g<0> ", text).translate(_FOLD).split()


def _placed(text: str) -> tuple[list[int], list[str]]:
    """Where each of the words begins, and the words."""
    starts: list[int] = []
    for m in _WHOLE.finditer(text):
        starts.append(m.start())
        key = _KEY.match(text, m.start())
        if key:
            starts.append(key.end())
    return starts, _words(text)


def _contexts(words: list[str], i: int, j: int) -> list[str]:
    """The patterns around words i to j: a tab stands where the mention is."""
    out = []
    if i > 1:
        out.append(f"{words[i - 2]} {words[i - 1]}\t")
    if i == j and 0 < i < len(words) - 1:
        out.append(f"{words[i - 1]}\t{words[i + 1]}")
    if j + 2 < len(words):
        out.append(f"\t{words[j + 1]} {words[j + 2]}")
    return out


#: characters of the shortest word that can be an identifier outside the base patterns
SHORTEST = 4


def mentions(text: str, base: list[list[Span]], shortest: int = SHORTEST) -> list[dict]:
    """Base spans and other words of ``shortest`` characters with a digit or @, each with its contexts."""
    taken = sorted((a, b, kind) for kind, spans in zip(KINDS, base, strict=True) for a, b in spans)
    tokens = list(_TOKEN.finditer(text))
    if not taken and not tokens:
        return []
    starts, words = _placed(text)

    def mention(a: int, b: int, kind: str | None) -> dict:
        i, j = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        return {"contexts": _contexts(words, i, j), "value": text[a:b], "kind": kind, "start": a, "end": b}

    found = [mention(*t) for t in taken]
    i = reach = 0
    for m in tokens:
        first = starts[bisect_right(starts, m.end() - 1) - 1]
        whole = text[first : m.end()]
        word = whole.strip(_WRAP)
        if len(word) < shortest:
            continue
        a = first + whole.index(word)
        b = a + len(word)
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= a:
            found.append(mention(a, b, None))
    return [x for x in found if x["contexts"]]


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_MENTION = pa.struct([("contexts", pa.list_(pa.string())), ("value", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_SCANNED = "rid long, doc_id {id}, " + ", ".join(f"{k} array<struct<start:int,end:int>>" for k in KINDS) + (
    ", mentions array<struct<contexts:array<string>,value:string,kind:string,start:int,end:int>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        bases = [base_spans(t) for t in texts]
        columns = [pa.array([[{"start": a, "end": b} for a, b in base[k]] for base in bases], pa.list_(_SPAN)) for k in range(len(KINDS))]
        named = pa.array([mentions(t, base) for t, base in zip(texts, bases, strict=True)], pa.list_(_MENTION))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *columns, named], names=["rid", "doc_id", *KINDS, "mentions"]
        )


def _counts(seen: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["words", "n"])


def _occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """context, places: how often the two words of each pattern stand anywhere in the corpus, cut as contexts are.

    A filter of fixed size over the patterns drops most other pairs of words where
    they stand; the join decides.
    """
    patterns = patterns.select("context", F.trim(F.col("context"), F.lit("\t")).alias("words"))
    wanted = docs.sparkSession.sparkContext.broadcast(bits_of(patterns.select(F.crc32(F.col("words").cast("binary")).alias("h"))).tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = _words(text or "")
                for pairs in (map(" ".join, zip(words, words[1:], strict=False)), map("\t".join, zip(words, words[2:], strict=False))):
                    for pair in pairs:
                        h = zlib.crc32(pair.encode()) % BITS
                        if bits[h >> 3] >> (h & 7) & 1:
                            seen[pair] = seen.get(pair, 0) + 1
                if len(seen) > HELD:
                    yield _counts(seen)
                    seen = {}
        yield _counts(seen)

    counted = docs.select("text").mapInArrow(count, "words string, n long").groupBy("words").agg(F.sum("n").alias("places"))
    return patterns.join(counted, "words").select("context", "places")


def score_patterns(edges: DataFrame, places: DataFrame, rounds: int, support: float) -> DataFrame:
    """context, worth: edges (context, value, seed, n) scored in rounds.

    A pattern's worth is the mentions of values by their own worth over all places
    of its words, 0 with less than ``support`` of known values; a seed is worth 1,
    another value 1 less the product of its patterns' doubts.
    """
    values = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("w"))
    worth = None
    for _ in range(rounds):
        known = edges.join(values, "value")
        worth = known.groupBy("context").agg(F.sum("w").alias("mass"), F.sum(F.col("w") * F.col("n")).alias("hits")).join(places, "context")
        worth = worth.select("context", F.when(F.col("mass") >= support, F.least(F.lit(1.0), F.col("hits") / F.col("places"))).otherwise(F.lit(0.0)).alias("worth"))
        worth = keep(worth, "pattern-worth")
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("worth")))))
        values = keep(
            edges.join(worth, "context").groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("s"), doubt.alias("d"))
            .select("value", F.greatest(F.col("s"), 1 - F.col("d")).alias("w")),
            "value-worth",
        )
    return worth


def personal_data(docs: DataFrame, rounds: int = 3, support: int = 5, certain: float = 0.8) -> DataFrame:
    """doc_id, email, ip, card, phone, id: one row per row of ``docs``, each kind an array of start and end (code points).

    A pattern needs ``support`` distinct known values, and ``certain`` of all places
    of its two words must be mentions of known values, for it to discover others. A
    null text is empty. Contexts are two words of any length; a mention alone in its
    text has none and is neither evidence nor discovered, as are words of fewer than
    ``SHORTEST`` characters. Repeated rows, also of one doc_id or of a null one, are read
    each for itself, though copies of a value count once for a pattern's support. An
    empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    scanned = keep(rows.mapInArrow(_scan, _SCANNED.format(id=docs.schema["doc_id"].dataType.simpleString())), "pii-scan")
    seen = scanned.select("rid", F.explode("mentions").alias("m")).select("rid", "m.*").withColumn("context", F.explode("contexts")).drop("contexts")
    edges = seen.groupBy("context", "value").agg(F.bool_or(F.col("kind").isNotNull()).alias("seed"), F.count("*").alias("n"))
    usable = edges.groupBy("context").agg(F.count("*").alias("values")).filter(F.col("values") >= support).select("context")
    usable = keep(usable, "patterns")
    edges = keep(edges.join(usable, "context", "left_semi"), "pattern-edges")
    places = keep(_occurrences(docs, usable), "pattern-places")
    good = score_patterns(edges, places, rounds, support).filter(F.col("worth") >= certain).select("context")
    new = seen.filter("kind is null").join(good, "context", "left_semi").groupBy("rid")
    new = new.agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(FOUND))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return scanned.drop("mentions").join(new, "rid", "left").withColumn(FOUND, F.coalesce(FOUND, none)).drop("rid")

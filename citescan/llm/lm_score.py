"""Language-model scores of texts: a log-bilinear model trained by noise-contrastive estimation.

Tokens are words and one end a text. The model predicts an output from the vectors of the
last ``CONTEXT`` outputs, each weighted by its place: frequent words are outputs of
their own, all others share an output with the words that begin with the same two
bytes. Within a shared output a word has its discounted share of the counts over the whole
corpus, and what the discount frees belongs to the unknown word. So the probabilities
of all known words and of one unknown word sum to one, over as many outcomes as the
smoothed counts that it is compared with have.

Spark counts all words. Training goes over all texts in rounds: each task
takes the model of the round before through its texts, and the tasks' vectors are averaged on
Spark, row by row, by how often a task has moved them. Scoring multiplies
batches of contexts with all outputs and normalises by their sum. Words beyond the
``HEAD`` most frequent ones are not held by tasks: what a document says of them
meets their counts in a join on the word.
"""

from __future__ import annotations

import copy
import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citescan.llm.names import free
from citescan.llm.quality import held_out
from citescan.session import drop, keep

#: words whose counts every task holds, at most; outputs of frequent words and of beginnings
HEAD, OWN, SHARED = 1 << 17, 128, 96
CONTEXT, SIZE = 3, 16
NOISE, BATCH, RATE, FIRST = 32, 4096, 0.1, 1e-7
#: tokens that are scored at once
AT_ONCE = 512
#: shares of the texts, in 64ths, that the rounds of training end at; passes over a round's texts that hold fewer tokens than ENOUGH are repeated
ROUNDS, ENOUGH, MOST_PASSES = (4, 16, 64), 1_000_000, 8
#: bytes of texts that are worked on at once, and rows of word counts that a task combines
SLICE, COMBINE = 4 << 20, 400_000
END = ""
ADDED = 0.1
#: binary places of the numbers that are averaged, and of sums of squared gradients
PLACES, STEP_PLACES = 20, 30


def tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts as a dictionary array, and how many each text has; A-Z are lower-cased, a null text is empty."""
    whole = pa.concat_arrays([texts])  # a slice on its own: lower-casing misreads casts of slices
    lists = pc.ascii_split_whitespace(pc.ascii_lower(whole.cast(pa.large_string()).fill_null("")))
    flat = lists.flatten()
    real = np.asarray(pc.binary_length(flat)) > 0
    upto = np.append(0, np.cumsum(real))
    offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    words = pc.dictionary_encode(flat.filter(pa.array(real)))
    return words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words, np.diff(upto[offsets])


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``SLICE`` bytes, and where they begin."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    of = (np.cumsum(size) - size) // SLICE
    cuts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(texts)) if len(texts) else np.zeros(1, int)
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(a), texts.slice(a, b - a)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text → word, n: partial counts, ends as the empty word."""
    held, rows = [], 0

    def combined() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for batch in batches:
        for _, texts in slices(batch.column(0)):
            words, _ = tokens(texts)
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            word = pa.concat_arrays([words.dictionary.cast(pa.large_string()), pa.array([END], pa.large_string())])
            held.append(pa.table({"word": word, "n": pa.array(np.append(n, len(texts)), pa.int64())}))
            rows += len(word)
            if rows > COMBINE:
                held = [combined()]
                rows = held[0].num_rows
                if rows > COMBINE // 2:
                    yield from held.pop().cast(_COUNTS).to_batches(max_chunksize=1 << 14)
                    rows = 0
    if held:
        yield from combined().cast(_COUNTS).to_batches(max_chunksize=1 << 14)


_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


@dataclasses.dataclass
class Outputs:
    """What every task holds: the head's words with their counts and outputs, beginnings with theirs, and counts in all."""

    words: pa.Array
    count: np.ndarray  # of each word of the head
    output: np.ndarray
    of_beginning: np.ndarray  # output of each pair of first bytes
    weight: np.ndarray  # count of each output
    types: np.ndarray  # distinct words of each output
    end: int
    total: int
    distinct: int
    discount: float

    @property
    def n(self) -> int:
        return len(self.weight)

    @property
    def own(self) -> np.ndarray:
        """Outputs that are one word."""
        return np.arange(self.n) < OWN

    def unknown(self) -> np.ndarray:
        """The share of the unknown word in each output; an output without words is all its."""
        share = np.where(self.own & (self.types > 0), 0.0, 1.0)
        rest = ~self.own & (self.types > 0)
        share[rest] = self.discount * self.types[rest] / self.weight[rest]
        return share

    def noise(self) -> np.ndarray:
        """Log of the distribution from which noise is drawn: the outputs' own, smoothed."""
        p = self.weight + 0.5
        return np.log(p / p.sum())

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its place in the head, -1 beyond, and its output."""
        at = pc.fill_null(pc.index_in(words.cast(pa.large_string()), value_set=self.words), -1).to_numpy(zero_copy_only=False)
        return at, np.where(at >= 0, self.output[at], self.of_beginning[beginnings(words)]) if len(self.words) else self.of_beginning[beginnings(words)]


def beginnings(words: pa.Array) -> np.ndarray:
    """The first two bytes of each word as a number."""
    if not len(words):
        return np.zeros(0, int)
    words = words.cast(pa.large_string())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.append(np.frombuffer(words.buffers()[2], np.uint8), np.zeros(2, np.uint8)).astype(np.int64)
    size = np.diff(at)
    return np.where(size > 0, data[at[:-1]], 0) * 256 + np.where(size > 1, data[at[:-1] + 1], 0)


class Stream:
    """Texts as one stream of outputs, an end after each text, with the outputs that stand before each."""

    def __init__(self, outputs: Outputs, texts: pa.Array):
        words, sizes = tokens(texts)
        self.dictionary = words.dictionary
        self.place, output = outputs.find(words.dictionary)
        n = sizes + 1
        self.text = np.repeat(np.arange(len(texts)), n)
        is_end = np.zeros(int(n.sum()), bool)
        is_end[np.cumsum(n) - 1] = True
        self.word = np.full(len(is_end), -1)  # place in the dictionary, -1 for ends
        self.word[~is_end] = words.indices.to_numpy()
        self.target = np.full(len(is_end), outputs.end)
        self.target[~is_end] = output[words.indices.to_numpy()]
        since = np.arange(len(is_end)) - np.repeat(np.cumsum(n) - n, n)
        self.before = np.full((CONTEXT, len(is_end)), outputs.n)  # the row after the outputs: before a text
        for j in range(CONTEXT):
            some = since > j
            self.before[j, some] = self.target[np.flatnonzero(some) - j - 1]


def _summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows at each of n places."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    sorted_at = at.take(order)
    starts = np.flatnonzero(np.append(True, sorted_at[1:] != sorted_at[:-1]))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[sorted_at[starts]] = np.add.reduceat(rows.take(order, axis=0), starts)
    return out


class Model:
    """Vectors of contexts (the last one: before a text), of outputs with their biases, and of places before."""

    PARTS = ("context", "output", "bias", "places")

    def __init__(self, n: int, noise: np.ndarray):
        rng = np.random.default_rng(5)
        drawn = lambda rows, width: (rng.normal(size=(rows, SIZE)) * width).astype(np.float32)
        self.n = n
        self.context, self.output = drawn(n + 1, 0.3), drawn(n, 0.03)
        self.bias = noise.astype(np.float32)[:, None]
        self.places = np.repeat((1 / (1 + np.arange(CONTEXT, dtype=np.float32)))[:, None], SIZE, axis=1)
        self.steps = [np.full(len(getattr(self, p)), FIRST, np.float32) for p in self.PARTS]  # sums of squared gradients
        self.touched = [np.zeros(len(s), np.int64) for s in self.steps]

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """The vector predicted from each column of outputs before."""
        q = self.context.take(before[0], axis=0) * self.places[0]
        for j in range(1, CONTEXT):
            q += self.context.take(before[j], axis=0) * self.places[j]
        return q

    def learn(self, before: np.ndarray, target: np.ndarray, noise: np.ndarray, rng: np.random.Generator) -> None:
        """A step for a batch: targets are told from ``NOISE`` outputs, evenly spread draws of the noise that the batch shares."""
        n = self.n
        drawn = np.searchsorted(np.cumsum(np.exp(noise)), (np.arange(NOISE) + rng.random()) / NOISE).clip(0, n - 1)
        each = [self.context.take(before[j], axis=0) for j in range(CONTEXT)]
        q = sum(e * self.places[j] for j, e in enumerate(each))
        offset = self.bias[:, 0] - (np.log(NOISE) + noise).astype(np.float32)
        w, v = self.output.take(target, axis=0), self.output.take(drawn, axis=0)
        with np.errstate(over="ignore"):
            true = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, w) + offset.take(target)))
            false = q @ v.T
            false += offset.take(drawn)
            np.negative(false, out=false)
            np.exp(false, out=false)
            false += 1
            np.reciprocal(false, out=false)  # how likely each noise is held for the target
        dq = true[:, None] * w - false @ v
        output = _summed(true[:, None] * q, target, n)
        np.subtract.at(output, drawn, false.T @ q)
        bias = np.bincount(target, true, n)
        np.subtract.at(bias, drawn, false.sum(axis=0))
        context = _summed(np.concatenate([dq * p for p in self.places]), before.ravel(), n + 1)
        places = np.stack([np.einsum("ij,ij->j", dq, e) for e in each])
        times = np.bincount(target, minlength=n)
        seen = (np.bincount(before.ravel(), minlength=n + 1), times, times, len(target))
        for i, (part, gradient) in enumerate(zip(self.PARTS, (context, output, bias[:, None], places), strict=True)):
            gradient = (gradient / len(target)).astype(np.float32)
            self.steps[i] += (gradient**2).mean(axis=1)
            value = getattr(self, part)
            value += RATE * gradient / np.sqrt(self.steps[i])[:, None]
            self.touched[i] += seen[i]

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """All rows as numbers (with the sum of squared gradients at the end), and how often each has been moved."""
        rows = [np.hstack([np.zeros((len(v), SIZE - v.shape[1])), v, s[:, None]]) for v, s in ((getattr(self, p), s) for p, s in zip(self.PARTS, self.steps, strict=True))]
        return np.concatenate(rows), np.concatenate(self.touched)

    def put(self, at: np.ndarray, numbers: np.ndarray) -> None:
        """The reverse of ``numbers``, for some rows."""
        first = 0
        for part, steps in zip(self.PARTS, self.steps, strict=True):
            value = getattr(self, part)
            some = (at >= first) & (at < first + len(value))
            value[at[some] - first] = numbers[some, SIZE - value.shape[1] : SIZE]
            steps[at[some] - first] = np.maximum(numbers[some, SIZE], FIRST)
            first += len(value)


def _trained(model: Model, outputs: Outputs, passes: int):
    """text → row, weight and numbers of each row of the model that the task has moved, as whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        noise, rng = outputs.noise(), np.random.default_rng(7)
        own = copy.deepcopy(model)
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                stream = Stream(outputs, texts)
                for _ in range(passes):
                    for i in rng.permutation(-(-len(stream.target) // BATCH)):
                        part = slice(i * BATCH, (i + 1) * BATCH)
                        own.learn(stream.before[:, part], stream.target[part], noise, rng)
        numbers, touched = own.numbers()
        at = np.flatnonzero(touched)
        weight = np.ceil(np.sqrt(touched[at])).astype(np.int64)
        scale = np.append(np.full(SIZE, float(1 << PLACES)), float(1 << STEP_PLACES))
        whole = np.rint(np.clip(numbers[at], -1e4, 1e4) * scale).astype(np.int64) * weight[:, None]
        values = pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), SIZE + 1).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(weight), values], names=["row", "weight", "numbers"])

    return run


def _averaged(model: Model, moved: DataFrame) -> Model:
    sums = [F.sum(F.get("numbers", i)).alias(f"s{i}") for i in range(SIZE + 1)]
    got = moved.groupBy("row").agg(F.sum("weight").alias("weight"), *sums).toPandas()
    scale = np.append(np.full(SIZE, float(1 << PLACES)), float(1 << STEP_PLACES))
    numbers = got[[f"s{i}" for i in range(SIZE + 1)]].to_numpy(dtype=np.float64) / scale / got["weight"].to_numpy()[:, None]
    model = copy.deepcopy(model)
    model.put(got["row"].to_numpy(), numbers)
    return model


@dataclasses.dataclass
class Trained:
    outputs: Outputs
    model: Model
    counts: DataFrame  # word, n of all training tokens


def _outputs(counts: DataFrame) -> Outputs:
    """The head and the outputs of a corpus' counts; what comes to the driver is bounded by ``HEAD`` words and 65,536 beginnings."""
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
    levels = levels.orderBy(F.desc("level")).collect()
    total, distinct, once, twice = (sum(r[c] for r in levels) for c in ("n", "words", "once", "twice"))
    least, words = None, 0
    for r in levels:
        words += r["words"]
        if words > HEAD:
            break
        least = r["level"]
    head = counts.filter(level >= least) if least is not None else counts.limit(0)
    head = head.toPandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
    own = head[head["word"] != END].head(OWN - 1)
    output = np.full(len(head), -1)
    output[own.index] = np.arange(len(own))
    end = OWN - 1
    output[head.index[head["word"] == END]] = end
    two = F.substring(F.col("word").cast("binary"), 1, 2)
    pairs = counts.filter(F.col("word") != END).groupBy(two.alias("two")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    weight, types = np.zeros(OWN + SHARED), np.zeros(OWN + SHARED)
    weight[: len(own)], types[: len(own)] = own["n"], 1
    ends = int(head["n"][head["word"] == END].sum())
    weight[end], types[end] = ends, min(ends, 1)
    rest_n, rest_types = np.zeros(1 << 16), np.zeros(1 << 16)
    for r in pairs:
        a, b = (*bytes(r["two"]), 0, 0)[:2]
        rest_n[a * 256 + b], rest_types[a * 256 + b] = r["n"], r["types"]
    own_at = beginnings(pa.array(own["word"].tolist(), pa.large_string()))
    np.subtract.at(rest_n, own_at, own["n"].to_numpy())
    np.subtract.at(rest_types, own_at, 1)
    of = np.full(1 << 16, OWN + SHARED - 1)
    often = np.argsort(-rest_n, kind="stable")[: SHARED - 1]
    of[often] = OWN + np.arange(len(often))
    weight += np.bincount(of, rest_n, OWN + SHARED)
    types += np.bincount(of, rest_types, OWN + SHARED)
    words = pa.array(head["word"].tolist(), pa.large_string())
    rest = np.flatnonzero(output < 0)
    output[rest] = of[beginnings(words.take(pa.array(rest)))]
    discount = float(np.clip(once / (once + 2 * twice), 0.1, 0.9)) if once else 0.1
    return Outputs(words, head["n"].to_numpy(dtype=np.int64), output, of, weight, types, end, int(total), int(distinct), discount)


def train(docs: DataFrame, folds: int = 10) -> Trained:
    """A model of the texts of ``docs`` that are not held out (``quality.held_out``); a null text is empty.

    Every token of them is counted and trained on. Without any the model knows no word.
    """
    texts = docs.filter(~held_out(F.col("doc_id"), folds)).select("text", F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS[-1])).alias("turn"))
    counts = texts.select("text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = keep(counts, "word-counts")
    outputs = _outputs(counts)
    model, begun = Model(outputs.n, outputs.noise()), 0
    sc = docs.sparkSession.sparkContext
    if outputs.total:
        passes = int(np.clip(-(-ENOUGH // outputs.total), 1, MOST_PASSES))
        held = sc.broadcast(outputs)
        for upto in ROUNDS:
            some = texts.filter((F.col("turn") >= begun) & (F.col("turn") < upto)).select("text")
            moved = keep(some.mapInArrow(_run(_trained, sc.broadcast(model), held, passes), "row long, weight long, numbers array<long>"), "moved")
            model, begun = _averaged(model, moved), upto
            drop(moved)
    return Trained(outputs, model, counts)


def _run(made, model, outputs, *more):
    """The function that ``made`` makes of broadcast values, made where it runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from made(model.value, outputs.value, *more)(batches)

    return run


_BEYOND = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64()), ("known", pa.float64()), ("unknown", pa.float64())]))
_SCORED = "n_tokens long, n_known long, base double, score double, beyond array<struct<word:string,n:long,known:double,unknown:double>>"


def log_probabilities(model: Model, outputs: Outputs, before: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the probability of each target output, and of the unknown word, given the outputs before."""
    q, bias = model.predicted(before), model.bias[:, 0]
    score = q @ model.output.T
    score += bias
    own = score[np.arange(len(target)), target].astype(np.float64)
    length = lambda x: np.sqrt((x**2).sum(axis=1).max(initial=0))
    most = 0.0
    if length(q) * length(model.output) + np.abs(bias).max() > 80:  # else no score can be too large for exp
        most = score.max(axis=1)
        score -= most[:, None]
    np.exp(score, out=score)
    total, unknown = (score @ np.stack([np.ones(outputs.n), outputs.unknown()], axis=1).astype(np.float32)).T
    total = np.log10(total, dtype=np.float64)
    return (own - most) / np.log(10) - total, np.log10(unknown, dtype=np.float64) - total


def _scores(model: Model, outputs: Outputs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smoothed = np.log10(outputs.total + ADDED * (outputs.distinct + 1)) if outputs.total else np.log10(ADDED)
        share = np.zeros(len(outputs.words))  # log10 of each head word's share of its output
        rest = ~outputs.own[outputs.output] if len(share) else np.zeros(0, bool)
        share[rest] = np.log10((outputs.count[rest] - outputs.discount) / outputs.weight[outputs.output[rest]])
        base_of = np.log10(outputs.count + ADDED) - smoothed
        end_at = np.flatnonzero(np.asarray(pc.equal(outputs.words, END))) if len(share) else []
        end_base = base_of[end_at[0]] if len(end_at) else np.log10(ADDED) - smoothed
        weight = np.log10(np.maximum(outputs.weight, 1e-9))
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                yield _scored_slice(model, outputs, batch.column(0).slice(start, len(texts)), texts, share, base_of, (len(end_at) > 0, end_base), weight)

    return run


def _scored_slice(model, outputs, rid, texts, share, base_of, end, weight) -> pa.RecordBatch:
    s = Stream(outputs, texts)
    known, unknown = np.zeros(len(s.target)), np.zeros(len(s.target))
    for a in range(0, len(s.target), AT_ONCE):
        part = slice(a, a + AT_ONCE)
        known[part], unknown[part] = log_probabilities(model, outputs, s.before[:, part], s.target[part])
    if not outputs.total:
        unknown[:] = 0.0
    place = np.append(s.place, -1)[s.word]
    is_end, beyond = s.word < 0, (place < 0) & (s.word >= 0)
    in_head = place >= 0
    base, score = np.zeros(len(place)), np.zeros(len(place))
    base[in_head], score[in_head] = base_of[place[in_head]], known[in_head] + share[place[in_head]]
    base[is_end], score[is_end] = end[1], known[is_end] if end[0] else unknown[is_end]
    n = len(texts)
    summed = lambda x: np.bincount(s.text, x, n)
    counted = np.bincount(s.text, in_head | (is_end & end[0]), n).astype(np.int64)
    # a row for each word beyond the head of each text
    at = np.flatnonzero(beyond)
    pair, back, times = np.unique(s.text[at] * max(1, len(s.dictionary)) + s.word[at], return_inverse=True, return_counts=True)
    words = s.dictionary.cast(pa.string()).take(pa.array(pair % max(1, len(s.dictionary)))) if len(pair) else pa.array([], pa.string())
    each = [words, pa.array(times, pa.int64()), *(pa.array(np.bincount(back, x[at], len(pair)), pa.float64()) for x in (known - weight[s.target], unknown))]
    offsets = np.searchsorted(pair // max(1, len(s.dictionary)), np.arange(n + 1))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(each, fields=list(_BEYOND.value_type)))
    columns = [rid, pa.array(np.bincount(s.text, minlength=n), pa.int64()), pa.array(counted), pa.array(summed(base), pa.float64()), pa.array(summed(score), pa.float64()), lists]
    return pa.RecordBatch.from_arrays(columns, names=["rid", "n_tokens", "n_known", "base", "score", "beyond"])


def scored(docs: DataFrame, trained: Trained) -> DataFrame:
    """``docs`` without text, with n_tokens, n_known, base_score and score.

    ``score`` is log10 of the model's probability of the text with its end,
    ``base_score`` the same by smoothed counts. A null text is empty: its end is its
    one token. Rows that repeat doc_id or text are rows of their own. Where nothing
    was trained on, the unknown word is the only outcome and both scores are 0. Other
    columns stay; columns that have the names of new ones are replaced. An empty table
    gives an empty result.
    """
    outputs, sc = trained.outputs, docs.sparkSession.sparkContext
    new = ("n_tokens", "n_known", "base_score", "score")
    rid, base, model = free(docs, "rid", "base", "model")
    rows = docs.withColumn(rid, F.monotonically_increasing_id())
    others = keep(rows.select(*[c for c in docs.columns if c.lower() not in ("text", *new)], rid), "scored-rows")
    found = rows.select(F.col(rid).alias("rid"), "text").mapInArrow(_run(_scores, sc.broadcast(trained.model), sc.broadcast(outputs)), f"rid long, {_SCORED}")
    found = keep(found, "scores")
    each = found.select("rid", F.inline("beyond")).join(trained.counts.withColumnRenamed("n", "c"), "word", "left")
    smoothed = F.lit(float(np.log10(outputs.total + ADDED * (outputs.distinct + 1)) if outputs.total else np.log10(ADDED)))
    more = each.groupBy("rid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + ADDED) - smoothed)).alias("more_base"),
        F.sum(F.when(F.col("c").isNull(), F.col("unknown")).otherwise(F.col("known") + F.col("n") * F.log10(F.col("c") - outputs.discount))).alias("more_score"),
    )
    sums = found.drop("beyond").join(more, "rid", "left")
    plus = lambda c: F.coalesce(c, F.lit(0))
    sums = sums.select(
        F.col("rid").alias(rid), "n_tokens", (F.col("n_known") + plus("more_known")).cast("long").alias("n_known"),
        (F.col("base") + plus("more_base")).alias("base_score"), (F.col("score") + plus("more_score")).alias("score"),
    )
    return others.join(sums, rid).drop(rid)

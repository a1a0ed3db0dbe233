"""Byte-level BPE encoding and decoding over Arrow batches.

The vocabulary is a file of ranks (base64 of a token's bytes, then its rank). The
library works on characters, so each byte has a printable character of its own,
and a token is the string of its bytes' characters. Every split of a token into
two other tokens is a merge of the token's rank, which makes the library merge
what the ranks alone would merge. Each text is encoded whole; decoding looks ids
up in the table of byte strings and joins them before it reads UTF-8, so that a
character split over several tokens comes back.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from citescan.llm.sliced import sliced

#: bytes of text that one call of the library gets at once; a longer text goes alone
CALL_BYTES = 1 << 20
#: what an id without a token decodes to: U+FFFD
UNKNOWN = b"\xef\xbf\xbd"


@functools.cache
def byte_characters() -> tuple[str, ...]:
    """A character for each byte: itself where it is visible in Latin-1, else one from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return tuple(chr(b) if b in shown else chr(next(hidden)) for b in range(256))


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes → rank, of the lines of a file of ranks."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


@functools.lru_cache(maxsize=4)
def _encoder(data: bytes, pattern: str):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    ranks, letter = read_ranks(data), byte_characters()
    name = {token: "".join(letter[b] for b in token) for token in ranks}
    merges = [
        (name[token[:i]], name[token[i:]])
        for token in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    found = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    found.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return found


@functools.lru_cache(maxsize=4)
def _byte_table(data: bytes) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(data).items()}


def _calls(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in runs of about CALL_BYTES."""
    run, held = [], 0
    for text in texts:
        if run and held + len(text) > CALL_BYTES:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


def _with(batch: pa.RecordBatch, new: dict[str, pa.Array], names: list[str]) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | new
    return pa.RecordBatch.from_arrays([kept[n] for n in names], names=names)


def _schema(df: DataFrame, drop: tuple[str, ...], add: list[tuple[str, T.DataType]]) -> T.StructType:
    gone = {*drop, *(n for n, _ in add)}
    return T.StructType([f for f in df.schema.fields if f.name not in gone] + [T.StructField(n, t) for n, t in add])


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks_path: str, pattern: str, offsets: bool = False, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_tokens and ``ids``: the ids as little-endian unsigned 32-bit integers.

    With ``offsets`` also ``starts`` and ``ends``: for each token the characters of
    the text that it touches (a character split over tokens belongs to each of them).
    A null or empty text has no tokens. Other columns, doc_id or not, stay as they
    are; columns that have the names of new ones are replaced. An empty table gives
    an empty result. Special tokens' strings are ordinary text.
    """
    held = docs.sparkSession.sparkContext.broadcast(_file(ranks_path))
    add: list[tuple[str, T.DataType]] = [("n_tokens", T.LongType()), ("ids", T.BinaryType())]
    if offsets:
        add += [("starts", T.ArrayType(T.IntegerType())), ("ends", T.ArrayType(T.IntegerType()))]
    out = _schema(docs, (text,), add)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value, pattern)
        call = encoder.encode_batch if offsets else encoder.encode_batch_fast
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ids, starts, ends = [], [], []
            for some in _calls(texts):
                for x in call(some, add_special_tokens=False):
                    ids.append(np.array(x.ids, dtype="<u4").tobytes())
                    if offsets:
                        starts.append([a for a, _ in x.offsets])
                        ends.append([b for _, b in x.offsets])
            new = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
            if offsets:
                new |= {"starts": pa.array(starts, pa.list_(pa.int32())), "ends": pa.array(ends, pa.list_(pa.int32()))}
            yield _with(batch, new, out.names)

    return docs.mapInArrow(run, out)


def decode(tokens: DataFrame, ranks_path: str, text: str | None = "text", raw: str | None = None) -> DataFrame:
    """``tokens`` with the text that its ``ids`` stand for, and with its bytes in column ``raw`` if one is named.

    Bytes that are no UTF-8 become U+FFFD in the text and stay in ``raw``; so does an
    id without a token. Null ids decode to an empty text. Other columns stay.
    """
    held = tokens.sparkSession.sparkContext.broadcast(_file(ranks_path))
    add: list[tuple[str, T.DataType]] = [(text, T.StringType())] if text else []
    add += [(raw, T.BinaryType())] if raw else []
    out = _schema(tokens, (), add)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _byte_table(held.value)
        for batch in sliced(batches):
            found = []
            for packed in batch.column(batch.schema.get_field_index("ids")):
                ids = np.frombuffer(packed.as_py() or b"", dtype="<u4").tolist()
                try:
                    found.append(b"".join(map(table.__getitem__, ids)))
                except KeyError:
                    found.append(b"".join(table.get(i, UNKNOWN) for i in ids))
            new: dict[str, pa.Array] = {}
            if text:
                new[text] = pa.array([x.decode("utf-8", "replace") for x in found], pa.string())
            if raw:
                new[raw] = pa.array(found, pa.binary())
            yield _with(batch, new, out.names)

    return tokens.mapInArrow(run, out)

"""SentencePiece encoding and decoding with the tokenizers library.

The model file is parsed as the protobuf it is; normaliser, metaspace marker, scores or merges, and
byte fallback are rebuilt as a tokenizers.Tokenizer. BPE models get the merges that their scores
imply. Where no piece has a marker after another character, texts are split before markers, which
cannot change the result, and each distinct unit of a batch is encoded once, multithreaded, and
remembered. Every text is verified against the sentencepiece library: by its units, each distinct one
once as long as it is remembered, or else whole.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranges, release, ship, table, task, whole

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed values of the format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters encoded at a time; units remembered at most, and the longest of them.
CHARS, REMEMBERED, UNIT = 1_000_000, 200_000, 64
#: Threads of the tokenizers library in a worker that sets none.
THREADS = "2"
#: One text in so many, picked by checksum, has its parity given: every one.
VERIFIED = 1


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(data: bytes) -> Model:
    """The parts of a SentencePiece model that encoding needs."""
    m = Model()
    for number, value in fields(data):
        if number == 1:
            f = dict(fields(value))
            m.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            f = dict(fields(value))
            m.kind, m.byte_fallback, m.suffix = f.get(3, UNIGRAM), bool(f.get(35, 0)), bool(f.get(24, 0))
        elif number == 3:
            f = dict(fields(value))
            m.charsmap, m.dummy_prefix, m.squeeze, m.escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
    if m.kind not in (UNIGRAM, BPE) or m.suffix or not m.escape:
        raise ValueError("only unigram and BPE models with escaped white space marked before words are supported")
    return m


class Pieces:
    """One model, ready to encode and decode."""

    def __init__(self, data: bytes):
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        m = self.model = parse(data)
        names = [p for p, _, _ in m.pieces]
        unknown = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), None)
        if m.kind == BPE:
            vocab = {p: i for i, p in enumerate(names)}
            merges = []
            for i, (piece, score, kind) in enumerate(m.pieces):
                if kind == NORMAL:
                    merges += [(-score, i, vocab[piece[:k]], vocab[piece[k:]]) for k in range(1, len(piece)) if piece[:k] in vocab and piece[k:] in vocab]
            core = models.BPE(vocab=vocab, merges=[(names[a], names[b]) for *_, a, b in sorted(merges)], unk_token=None if unknown is None else names[unknown], fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            core = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=unknown, byte_fallback=m.byte_fallback)
        self.whole, self.units = Tokenizer(core), Tokenizer(core)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")] if m.squeeze else []
        steps += [normalizers.Prepend(MARK)] if m.dummy_prefix else []
        self.whole.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        self.whole.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
        own = [p for p, _, kind in m.pieces if kind == USER_DEFINED]
        self.plain = not (m.charsmap or m.squeeze or own)
        self.apart = m.kind == BPE and not any(MARK in p.lstrip(MARK) for p in names)
        if self.apart:
            self.whole.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
        if own:
            self.whole.add_tokens([AddedToken(p, normalized=True) for p in own])
        self.unit = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.known: dict[str, bytes] = {}
        self.wrong: set[str] = set()
        self.lost: set[str] = set()
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in m.pieces]

    def forget(self) -> None:
        self.known.clear()
        self.wrong.clear()
        self.lost.clear()

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the tokenizers library spreads a batch over its threads."""
        return self.verified(texts, None)[0]

    def verified(self, texts: list[str], other) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """The ids of each text, whether sentencepiece (other) gives them too, and whether decoding gives the text; where it does not give them, the ids are those of sentencepiece.

        A model's pieces are verified by one processor always, or never (None), as units are remembered.
        """
        if not (self.plain and self.apart):
            out = [np.array(e.ids, np.int32) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            theirs = [np.array(i, np.int32) for i in other.encode(texts, num_threads=int(THREADS))] if other else out
            return theirs, [np.array_equal(a, b) for a, b in zip(out, theirs, strict=True)], [self.decode(i.tolist()) == t for i, t in zip(theirs, texts, strict=True)]
        head = MARK if self.model.dummy_prefix else ""
        split = [self.unit.findall(head + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        new = list(set(chain.from_iterable(split)).difference(self.known))
        self.known.update((u, array("i", e.ids).tobytes()) for u, e in zip(new, self.units.encode_batch_fast(new, add_special_tokens=False), strict=True))
        if other:
            # after a first word of its own, as a unit begins with a marker that sentencepiece would add at the start
            first = "a" if head else ""
            skip = len(other.encode(first))
            for u, i in zip(new, other.encode([first + u.replace(MARK, " ") for u in new], num_threads=int(THREADS)), strict=True):
                ids = array("i", i[skip:]).tobytes()
                if ids != self.known[u]:
                    self.known[u] = ids
                    self.wrong.add(u)
        for u in new:
            if b"".join(map(self.bytes.__getitem__, memoryview(self.known[u]).cast("i"))) != u.replace(MARK, " ").encode():
                self.lost.add(u)
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, s)), np.int32) for s in split]
        same = [not self.wrong or self.wrong.isdisjoint(s) for s in split]
        # a text whose units all come back does so too, unless it has markers of its own
        back = [MARK not in t if not self.lost or self.lost.isdisjoint(s) else self.decode(i.tolist()) == t for i, t, s in zip(out, texts, split, strict=True)]
        for u in new:
            if len(u) > UNIT:
                del self.known[u]
                self.wrong.discard(u)
                self.lost.discard(u)
        return out, same, back

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [a.tolist() for a in self.arrays(texts)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: markers become spaces, byte pieces bytes, and the space before the first word goes."""
        data = b"".join(map(self.bytes.__getitem__, ids))
        return (data[1:] if self.model.dummy_prefix and data[:1] == b" " else data).decode("utf-8", "replace")


@lru_cache(2)
def pieces(data: bytes) -> Pieces:
    return Pieces(data)


@lru_cache(2)
def reference(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def encoded(docs: DataFrame, text: str = "text", model: str = MODEL, verified: int = VERIFIED) -> DataFrame:
    """docs with ids (array of int), n_ids, round_trip (decoding gives the text) and parity (the rebuilt tokenizer agrees with sentencepiece).

    Every text is verified; where parity is false, the ids are those of sentencepiece. parity is null
    for the texts that a `verified` above 1 leaves out.
    Null texts are empty and have no ids. Columns of docs with those four names are replaced. The
    model file is read on the driver and broadcast (under 5 MB).
    """
    ship(docs.sparkSession)
    with open(model, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop("ids", "n_ids", "round_trip", "parity")
    fields_, where = docs.columns, docs.columns.index(text)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
        own, other = pieces(data.value), reference(data.value)
        for batch in batches:
            release()
            for span in ranges(pc.fill_null(pc.utf8_length(batch.column(where)), 0).to_pylist(), CHARS):
                part = [t or "" for t in batch.column(where)[span].to_pylist()]
                ids, agree, same = own.verified(part, other)
                at = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate(ids)
                parity = [None if verified > 1 and zlib.crc32(t.encode()) % verified else a for t, a in zip(part, agree, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(span.start, len(part)).columns, pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(np.diff(at).astype(np.int64)), pa.array(same, pa.bool_()), pa.array(parity, pa.bool_())], names)
        own.forget()  # the worker lives on, for tasks that need the memory otherwise

    names = [*fields_, "ids", "n_ids", "round_trip", "parity"]
    shape = docs.select("*", F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("long").alias("n_ids"), F.lit(None).cast("boolean").alias("round_trip"), F.lit(None).cast("boolean").alias("parity")).schema
    return docs.mapInArrow(run, shape)


def decoded(coded: DataFrame, ids: str = "ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """coded with text decoded from ids; null ids give an empty text."""
    ship(coded.sparkSession)
    with open(model, "rb") as f:
        data = coded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def back(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = pieces(data.value)
        for s in column:
            yield pd.Series(["" if i is None else own.decode(list(i)) for i in s], dtype=object)

    return coded.withColumn(text, back(coded[ids]))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", whole("text").alias("text"))
    return encoded(docs).drop("text")

"""Sequence packing as vector bin packing with a dot-product heuristic.

An example asks for tokens, one segment and loss-bearing tokens; a sequence has a limit on
each. One sequence is filled at a time, from a pool of waiting examples: of those that it
has room for in every respect, the one goes in whose demands point most the way of the room
(the largest dot product, each respect as a share of its limit). Packing is local to a
partition: nothing is shuffled, memory holds the pool and one sequence, and a lost task
packs its rows again the same way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, POOL = 1024, 64


class Piece(NamedTuple):
    """A cut of an example: ``data`` is its ids, from the example's place ``start`` on."""

    example: Any
    start: int
    data: np.ndarray
    loss: np.ndarray | None  #: which ids bear loss; None: all
    total: int

    @property
    def bearing(self) -> int:
        return len(self.data) if self.loss is None else int(self.loss.sum())

    def cut(self, n: int) -> tuple[Piece, Piece]:
        a, b = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return self._replace(data=self.data[:n], loss=a), self._replace(start=self.start + n, data=self.data[n:], loss=b)


@dataclass
class Packer:
    """Packs pieces one after another. ``add`` and ``finish`` give closed sequences, as lists of pieces.

    With ``cut``, where nothing waiting fits whole, the piece that points most the way of
    the room is cut to fill it and its rest waits on; what is left at the end goes, by the
    same choice, into sequences whose lengths are powers of two. Without, pieces stay whole;
    one that alone is over a limit is an error.
    """

    tokens: int = MAX_TOKENS
    segments: int = MAX_TOKENS
    loss: int = MAX_TOKENS
    pool: int = POOL
    cut: bool = True
    waiting: list[Piece] = field(default_factory=list)
    sequence: list[Piece] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.limits = np.array([self.tokens, self.segments, self.loss], float)
        self.room = self.limits.copy()
        self.asks = np.zeros((self.pool + 1, 3))

    def add(self, p: Piece) -> Iterator[list[Piece]]:
        if not self.cut and (self._ask(p) > self.limits).any():
            raise ValueError(f"example {p.example!r} alone is over a limit: {self._ask(p)}")
        self._wait(p)
        while len(self.waiting) > self.pool:
            yield from self._step()

    def finish(self) -> Iterator[list[Piece]]:
        whole = self.cut and self.loss >= self.tokens
        while self.waiting and not (whole and self._left() < self.tokens):
            yield from self._step()
        if whole:
            left = self._left()
            for p in self.sequence:
                self._wait(p)
            self.sequence, limits = [], self.limits
            for size in (1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1):
                self.limits = np.array([size, self.segments, size], float)
                self.room = self.limits.copy()
                done: list[list[Piece]] = []
                while sum(len(p.data) for s in done for p in s) < size:
                    done += self._step()
                yield from done
            self.limits = limits
        if self.sequence:
            yield self._close()

    def _left(self) -> int:
        return sum(len(p.data) for p in self.waiting) + sum(len(p.data) for p in self.sequence)

    def _ask(self, p: Piece) -> tuple[int, int, int]:
        return len(p.data), 1, p.bearing

    def _wait(self, p: Piece) -> None:
        if len(self.waiting) == len(self.asks):
            self.asks = np.concatenate([self.asks, np.zeros_like(self.asks)])
        self.asks[len(self.waiting)] = self._ask(p)
        self.waiting.append(p)

    def _take(self, k: int) -> Piece:
        p, last = self.waiting[k], self.waiting.pop()
        if k < len(self.waiting):
            self.waiting[k], self.asks[k] = last, self.asks[len(self.waiting)]
        return p

    def _close(self) -> list[Piece]:
        done, self.sequence, self.room = self.sequence, [], self.limits.copy()
        return done

    def _step(self) -> Iterator[list[Piece]]:
        """Puts one piece, or the part of one that fits, into the sequence; closes what is full."""
        asks = self.asks[: len(self.waiting)]
        fits = (asks <= self.room).all(axis=1)
        # a piece larger than the room counts for the part of it that the room could take
        towards = np.minimum(asks, self.room) @ (self.room / self.limits**2)
        if fits.any():
            p = self._take(int(np.where(fits, towards, -1.0).argmax()))
        elif not self.cut:
            yield self._close()
            return
        else:
            k = int(towards.argmax())
            p = self.waiting[k]
            size = min(int(self.room[0]), len(p.data), int(self.room[2]) if p.loss is None else len(p.data))
            if p.loss is not None:
                size = min(size, int(np.searchsorted(np.cumsum(p.loss), self.room[2], side="right")))
            if not size or not self.room[1]:
                yield self._close()
                return
            p, rest = p.cut(size)
            self.waiting[k], self.asks[k] = rest, self._ask(rest)
        self.sequence.append(p)
        self.room -= self._ask(p)
        if self.room[0] == 0 or self.room[1] == 0:
            yield self._close()


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _longs(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=names)


def _pieces(sequences: list[list[Piece]], first: int) -> pa.RecordBatch:
    rows = []
    for k, s in enumerate(sequences, first):
        at = 0
        for p in s:
            rows.append((p.example, p.start, len(p.data), zlib.crc32(p.data.astype("<u4", copy=False).tobytes()), p.total, k, at))
            at += len(p.data)
    return _longs(rows, _COLUMNS)


def _packed(pieces: Iterator[Piece], packer: Packer, frame, flush: int = 1_000) -> Iterator[pa.RecordBatch]:
    n, closed = TaskContext.get().partitionId() << 32, []
    for p in pieces:
        closed.extend(packer.add(p))
        if len(closed) >= flush:
            yield frame(closed, n)
            n, closed = n + len(closed), []
    closed.extend(packer.finish())
    if closed:
        yield frame(closed, n)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, tokens: int = MAX_TOKENS, segments: int | None = None, separator: int = 0, pool: int = POOL) -> DataFrame:
    """Pieces of all documents in sequences of at most ``tokens`` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids, then ``separator``; a null or empty text is the separator alone.
    All ids but a document's first, which nothing foretells, bear loss. Without a limit on
    ``segments`` every sequence holds ``tokens`` ids, but for those at the end of a
    partition, whose lengths are powers of two. Sequence ids are unique, not consecutive:
    the partition's number times 2^32 and a count. Rows with equal ids are packed each; a
    null id stays null; an empty table gives an empty result; other columns are ignored.
    """
    from .tokens import BpeEncoder

    def run(batches):
        encode = BpeEncoder.load(tokenizer)

        def pieces():
            for b in batches:
                for doc, text in zip(b.column("doc_id"), b.column("text")):
                    ids = encode(text.as_py() or "", separator)
                    yield Piece(doc.as_py(), 0, ids, np.arange(len(ids)) > 0, len(ids))

        yield from _packed(pieces(), Packer(tokens, segments or tokens, tokens, pool), _pieces)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{c} long" for c in _COLUMNS))


def pack_examples(examples: DataFrame, tokens: int = MAX_TOKENS, segments: int = MAX_TOKENS, loss: int = MAX_TOKENS, pool: int = POOL) -> DataFrame:
    """Whole examples (example_id, n_tokens, n_loss) under all three limits: example_id, n_tokens, n_loss, sequence_id, offset.

    For instruction data, where an example may not be cut. Null counts are 0; an example
    over a limit by itself fails the job, by name. An empty table gives an empty result.
    """
    names = ["example_id", "n_tokens", "n_loss", "sequence_id", "offset"]

    def frame(closed: list[list[Piece]], first: int) -> pa.RecordBatch:
        rows = []
        for k, s in enumerate(closed, first):
            at = 0
            for p in s:
                rows.append((p.example, len(p.data), p.bearing, k, at))
                at += len(p.data)
        return _longs(rows, names)

    def run(batches):
        def pieces():
            for b in batches:
                for e, t, m in zip(*(b.column(c).to_pylist() for c in names[:3])):
                    yield Piece(e, 0, np.zeros(t or 0, np.uint8), np.arange(t or 0) < (m or 0), t or 0)

        yield from _packed(pieces(), Packer(tokens, segments, loss, pool, cut=False), frame)

    return examples.select(*[F.col(c).cast("long") for c in names[:3]]).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def conversation_examples(turns: DataFrame, count: Column, tokens: int, loss: int) -> DataFrame:
    """Instruction examples of conversations (conv_id, turn, role, text): example_id, n_tokens, n_loss.

    ``count`` is the number of tokens of a turn; what the assistant says bears loss. A
    conversation over either limit is no example: no sequence takes it whole. A null text
    has no tokens; rows without a conv_id belong to none.
    """
    n = F.coalesce(count, F.lit(0))
    sums = turns.where("conv_id is not null").groupBy(F.col("conv_id").alias("example_id")).agg(F.sum(n).alias("n_tokens"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("n_loss"))
    return sums.where((F.col("n_tokens") <= tokens) & (F.col("n_loss") <= loss))

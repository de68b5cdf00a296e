"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A document's attention cost is estimated as ``linear * n + quadratic * n ** 2`` for
each piece of ``n`` tokens (attention is masked at document ends).  Each task
tokenises its documents, gathers blocks of about ``block_tokens`` tokens, and packs
each block: documents in descending cost go to the sequence that has the lowest
cost so far among those with enough free tokens.  What fits nowhere whole is cut
at the roomiest sequences.

The capacities of a block's sequences add up to its tokens exactly: as many full
sequences as possible, then powers of two for the rest, since a sequence whose
length is a power of two needs no padding.  Blocks are independent, so no row is
shuffled, memory is bounded by a block plus the longest document, and a lost task
is simply run again with the same result.

Defined cases: a null text counts as empty (its only id is the end id); texts of any length are tokenised
whole and cut; documents of equal cost go in the order of the block, and of equally cheap sequences the first
is taken; repeated rows and repeated ids are packed once per row; an empty table gives no rows; other columns,
whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spindrift.llm import common
from spindrift.llm.tokens import Tokenizer

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
    "`offset` long, sequence_capacity long, cost double"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("sequence_capacity", pa.int64()),
        ("cost", pa.float64()),
    ]
)


@dataclass(frozen=True)
class PackingConfig:
    """``tokenizer_path``: a file of the ``tokenizers`` library; ``end_id`` closes each document."""

    tokenizer_path: str
    max_tokens: int = 2048
    end_id: int = 1
    linear: float = 1.0
    quadratic: float = 1.0 / 1024
    block_tokens: int = 1 << 20

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n


def capacities(total: int, size: int) -> list[int]:
    """Full sequences and then falling powers of two that add up to ``total``."""
    out = [size] * (total // size)
    rest = total % size
    out += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return out


def assign(lengths: list[int], config: PackingConfig) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pack documents of these lengths: (document, start, length, sequence, offset), and the capacities."""
    size, room = config.max_tokens, capacities(sum(lengths), config.max_tokens)
    caps = list(room)
    full, pieces = 0, []
    rest: list[tuple[int, int, int]] = []  # what is left of each document: length, document, start
    for d, n in enumerate(lengths):
        whole = n // size
        for k in range(whole):
            pieces.append((d, k * size, size, full, 0))
            room[full] = 0
            full += 1
        if n % size:
            rest.append((n % size, d, whole * size))
    rest.sort(key=lambda x: (-x[0], x[1]))
    free = np.array(room, dtype=np.int64)
    cost = np.zeros(len(room))
    for n, d, start in rest:
        while n:
            fits = np.flatnonzero(free >= n)
            if len(fits):
                s = int(fits[np.argmin(cost[fits])])
                take = n
            else:
                s = int(np.argmax(free))
                take = int(free[s])
            pieces.append((d, start, take, s, caps[s] - int(free[s])))
            free[s] -= take
            cost[s] += config.cost(take)
            start, n = start + take, n - take
    return pieces, caps


class _Packer:
    def __init__(self, config: PackingConfig):
        self.config, self.block, self.tokens, self.next = config, [], 0, 0

    def add(self, doc_id, ids: bytes) -> Iterator[pa.RecordBatch]:
        self.block.append((doc_id, ids))
        self.tokens += len(ids) // 4
        if self.tokens >= self.config.block_tokens:
            yield from self.flush()

    def flush(self, most: int = 4096) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if not self.block:
            return
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        pieces, caps = assign([len(x) // 4 for _, x in self.block], self.config)
        for at in range(0, len(pieces), most):
            part = pieces[at : at + most]
            ids = [memoryview(self.block[d][1])[4 * s : 4 * (s + n)].tobytes() for d, s, n, _, _ in part]
            columns = [
                [self.block[p[0]][0] for p in part],
                [p[1] for p in part],
                [p[2] for p in part],
                ids,
                [len(self.block[p[0]][1]) // 4 for p in part],
                [base + self.next + p[3] for p in part],
                [p[4] for p in part],
                [caps[p[3]] for p in part],
                [self.config.cost(p[2]) for p in part],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW, strict=True)], schema=_ARROW)
        self.next += len(caps)
        self.block, self.tokens = [], 0


def pack(documents: DataFrame, config: PackingConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; ``ids`` holds its token ids as little-endian unsigned 32-bit numbers."""
    common.prepare(documents.sparkSession)
    end = int(config.end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = Tokenizer.shared(config.tokenizer_path), _Packer(config)
        for part in common.slices(batches, 1, 128):
            for doc, ids in zip(part.column(0).to_pylist(), tokenizer.encode(part.column(1).to_pylist()), strict=True):
                yield from packer.add(doc, ids + end)
        yield from packer.flush()

    return common.pick(documents, id_col, text_col).mapInArrow(common.frugal(run), SCHEMA)

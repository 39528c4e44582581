"""Operator 1: hierarchical multi-length packing.

Each document's tokens are cut into whole windows of the longest tier and a remainder. The remainder is routed to the
shortest tier that holds it. Every tier is packed, from the longest to the shortest: a remainder opens a window, the gap
behind it takes the longest remainders of the shorter tiers that fit, and what is still open takes the head of one more
remainder, whose tail is routed anew. What no longer fills a window of its tier is cut at powers of two.

Step groups hold the same number of tokens, `group_tokens`, whatever the tier: a task's windows of one length wait until they fill
a group. At its end the windows that wait, of all lengths, and its last full group are dealt longest first, each to the group with
the fewest tokens, to as many groups as come nearest to that size; these differ from each other by no more than a window, and
hold between three quarters and one and a half of the others' tokens, unless the task has not that many.

Packing needs no partner from elsewhere, so each task packs what it scans, a batch of documents at a time: nothing is
shuffled, no key can be hot, memory is bounded by the batch, and a lost task is computed again from its split alone.

Defined cases: a null or empty text is the closing token alone; repeated rows are packed each; a null doc_id is kept; an
empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import encoder

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier long, sequence_tokens long, step_group long"
)


@dataclass
class Piece:
    doc: int
    start: int
    length: int
    offset: int = 0


class Shelf:
    """Pieces by length. A bit mask of the lengths at hand finds the longest one within a gap without a scan."""

    def __init__(self) -> None:
        self.by_length: dict[int, list[Piece]] = {}
        self.mask = 0

    def put(self, piece: Piece) -> None:
        self.by_length.setdefault(piece.length, []).append(piece)
        self.mask |= 1 << piece.length

    def longest(self, most: int) -> Piece | None:
        at_hand = self.mask & ((1 << (most + 1)) - 1)
        return self._take(at_hand.bit_length() - 1) if at_hand else None

    def shortest(self, least: int) -> Piece | None:
        at_hand = self.mask >> least
        return self._take(least + (at_hand & -at_hand).bit_length() - 1) if at_hand else None

    def _take(self, length: int) -> Piece:
        pieces = self.by_length[length]
        piece = pieces.pop()
        if not pieces:
            self.mask &= ~(1 << length)
        return piece


def pack(lengths: list[int], tiers: list[int]) -> list[tuple[int, list[Piece]]]:
    """Windows (size, pieces) that hold lengths[i] tokens of document i; each window is full."""
    longest, shortest = max(tiers), min(tiers)
    out: list[tuple[int, list[Piece]]] = []
    shelf = Shelf()
    for doc, n in enumerate(lengths):
        whole = n - n % longest
        out += [(longest, [Piece(doc, at, longest)]) for at in range(0, whole, longest)]
        if n > whole:
            shelf.put(Piece(doc, whole, n - whole))
    for size in sorted(tiers, reverse=True):
        below = max((t for t in tiers if t < size), default=0)
        open_: list[Piece] = []
        while first := shelf.shortest(below + 1):
            gap, window = size - first.length, [first]
            while gap and (piece := shelf.longest(gap)):
                window.append(piece)
                gap -= piece.length
            if gap and (piece := shelf.shortest(gap + 1)):
                window.append(Piece(piece.doc, piece.start, gap))
                shelf.put(Piece(piece.doc, piece.start + gap, piece.length - gap))
                gap = 0
            if gap:  # nothing is left to fill it
                open_ = window
                break
            out.append((size, window))
        if open_:
            out += _tail(open_, size)
            break
    # What is shorter than the shortest tier and found no gap: cut at powers of two.
    rest = []
    while piece := shelf.longest(shortest * 2 - 1):
        rest.append(piece)
    out += _tail(rest, shortest) if rest else []
    return out


def _tail(pieces: list[Piece], size: int) -> list[tuple[int, list[Piece]]]:
    """Windows for the last pieces of a batch: of the given size, and at the end of falling powers of two."""
    out, left, queue = [], sum(p.length for p in pieces), list(reversed(pieces))
    while left:
        room = want = min(size, 1 << (left.bit_length() - 1))
        window = []
        while room:
            p = queue.pop()
            take = min(room, p.length)
            window.append(Piece(p.doc, p.start, take))
            if take < p.length:
                queue.append(Piece(p.doc, p.start + take, p.length - take))
            room -= take
        out.append((want, window))
        left -= want
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = (1024, 512, 256, 128, 64), group_tokens: int = 65536, batch_documents: int = 8192, batch_tokens: int = 1 << 23) -> DataFrame:
    """One row per piece of a document: see SCHEMA. A sequence's id is its task's number, then its number in the task.

    batch_documents and batch_tokens bound what a task holds at once; each batch is packed by itself."""
    if any(t & (t - 1) or t < 1 for t in tiers):
        raise ValueError("tiers are powers of two")
    sizes = sorted(set(tiers), reverse=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        base = TaskContext.get().partitionId() << 32
        made = groups = 0
        waiting: dict[int, list[list[tuple]]] = {}  # by length: windows without a step group
        last: list[tuple[int, list[tuple]]] = []  # the last full group: length and window
        ids_of: list[np.ndarray] = []
        doc_of: list[int | None] = []
        held = 0

        def batch_of(grouped: list[tuple[int, list[tuple]]]) -> pa.RecordBatch:
            rows = [(*row, base + group) for group, window in grouped for row in window]
            cols = [*zip(*rows, strict=True)] or [()] * 10
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in SCHEMA.split(", ")])

        def flush() -> pa.RecordBatch:
            nonlocal made, groups, last, ids_of, doc_of, held
            full = []
            for size, window in pack([len(x) for x in ids_of], sizes):
                rows, offset = [], 0
                for p in window:
                    ids = ids_of[p.doc]
                    rows.append((doc_of[p.doc], p.start, p.length, zlib.crc32(ids[p.start : p.start + p.length].tobytes()), len(ids), base + made, offset, size, size))
                    offset += p.length
                made += 1
                same = waiting.setdefault(size, [])
                same.append(rows)
                if len(same) * size >= group_tokens:
                    full += [(groups, w) for _, w in last]
                    groups += bool(last)
                    last = [(size, w) for w in same]
                    same.clear()
            ids_of, doc_of, held = [], [], 0
            return batch_of(full)

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(0)).astype("<u4")
                ids_of.append(ids)
                doc_of.append(doc.as_py())
                held += len(ids)
                if len(ids_of) >= batch_documents or held >= batch_tokens:
                    yield flush()
        if ids_of:
            yield flush()
        rest = sorted([*last, *((size, w) for size in waiting for w in waiting[size])], key=lambda x: -x[0])
        if rest:
            loads = [(0, groups + k) for k in range(max(1, round(sum(size for size, _ in rest) / group_tokens)))]
            dealt = []
            for size, w in rest:
                tokens, group = heapq.heappop(loads)
                dealt.append((group, w))
                heapq.heappush(loads, (tokens + size, group))
            yield batch_of(dealt)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())

"""Vector bin packing of examples into sequences, under limits on tokens, segments and loss-bearing tokens.

A sequence is filled from a pool of waiting examples: of those that fit it takes the one whose size vector has the
largest dot product with what is left of the limits, which sends examples where their scarce resource is still free.
When none fits, the best one is cut. Each task packs its own rows; what its last sequence lacks is no padding either,
for that one is cut at powers of two.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_ids import word_ids

#: An example's piece: its key, ids, start in the example, end, and where the example's loss-bearing tokens begin.
Piece = tuple[object, bytes, int, int, int]
Emit = Callable[[list[Piece]], None]


def loss_tokens(piece: Piece) -> int:
    return max(0, piece[3] - max(piece[2], piece[4]))


class VectorPacker:
    """Packs pieces one by one; ``emit`` gets each sequence. ``pool`` examples wait at most."""

    def __init__(self, tokens: int, segments: int, loss: int, emit: Emit, pool: int = 128, cut: bool = True):
        self.tokens, self.segments, self.loss = tokens, segments, loss
        self.emit, self.cut, self.most = emit, cut, pool
        self.pool: list[Piece] = []
        self.sizes, self.losses = np.zeros(pool + 1), np.zeros(pool + 1)
        self._open()

    def _open(self) -> None:
        self.open: list[Piece] = []
        self.left, self.segments_left, self.loss_left = self.tokens, self.segments, self.loss

    def _set(self, i: int, piece: Piece) -> None:
        self.pool[i], self.sizes[i], self.losses[i] = piece, piece[3] - piece[2], loss_tokens(piece)

    def _take(self, i: int) -> Piece:
        piece, last = self.pool[i], self.pool.pop()
        if i < len(self.pool):
            self._set(i, last)
        return piece

    def _place(self, piece: Piece) -> None:
        self.open.append(piece)
        self.left -= piece[3] - piece[2]
        self.loss_left -= loss_tokens(piece)
        self.segments_left -= 1

    def close(self) -> None:
        """End the open sequence. One that is not full is cut at the powers of two that its length is the sum of."""
        n = sum(x[3] - x[2] for x in self.open)
        while n and self.cut and n < self.tokens:
            size = 1 << (n.bit_length() - 1)
            n, room, whole = n - size, size, []
            while room:
                key, ids, a, b, loss = self.open.pop(0)
                end = min(b, a + room)
                whole.append((key, ids, a, end, loss))
                room -= end - a
                if end < b:
                    self.open.insert(0, (key, ids, end, b, loss))
            self.emit(whole)
        if self.open:
            self.emit(self.open)
        self._open()

    def _step(self) -> None:
        """Place one waiting piece, or close the open sequence."""
        if self.left < 1 or self.segments_left < 1:
            self.close()
            return
        sizes, losses = self.sizes[: len(self.pool)], self.losses[: len(self.pool)]
        # both vectors in units of the limits; a segment is as much for each piece and decides nothing here
        score = sizes * (self.left / self.tokens**2) + losses * (self.loss_left / self.loss**2)
        fits = (sizes <= self.left) & (losses <= self.loss_left)
        best = int(np.argmax(np.where(fits, score, -1.0)))
        if fits[best]:
            self._place(self._take(best))
        elif self.cut:
            # tokens before the loss cost none of its limit
            room = np.minimum(self.left, sizes - losses + self.loss_left)
            best = int(np.argmax(np.where(room >= 1, score, -1.0)))
            if room[best] < 1:
                self.close()
                return
            key, ids, a, b, loss = self.pool[best]
            end = a + int(room[best])
            self._set(best, (key, ids, end, b, loss))
            self._place((key, ids, a, end, loss))
        else:
            self.close()
            return
        if self.left < 1:
            self.close()

    def add(self, piece: Piece) -> None:
        if not self.cut and (piece[3] - piece[2] > self.tokens or self.segments < 1 or loss_tokens(piece) > self.loss):
            raise ValueError("an example exceeds the limits of a sequence")
        if piece[3] == piece[2]:
            return
        self.pool.append(piece)
        self._set(len(self.pool) - 1, piece)
        while len(self.pool) >= self.most:
            self._step()

    def finish(self) -> None:
        while self.pool:
            self._step()
        self.close()


@dataclass(frozen=True)
class Packing:
    """Sequences of at most ``tokens`` ids, ``segments`` pieces and ``loss`` loss-bearing ids (default: all may be).

    ``context``: share of an example's ids, at its beginning, that bear no loss, where no column says it.
    """

    tokenizer: str
    end_id: int
    tokens: int = 4096
    segments: int = 512
    loss: int | None = None
    context: float = 0.0

    def pack(self, docs: DataFrame, loss_from: str | None = None) -> DataFrame:
        """Pieces of ``doc_id, text`` rows (null: empty; each ends with the end id), with their ids.

        ``loss_from``: a column with the first loss-bearing token of a row (null: as ``context`` says).
        Returns doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, loss_tokens, sequence_id and
        offset. Every id is in one piece; an empty text is one piece, its end id; repeated rows are packed each; an
        empty table gives no rows; other columns are ignored.
        """
        name, end, limits = self.tokenizer, struct.pack("<I", self.end_id), (self.tokens, self.segments, self.loss or self.tokens)
        share = self.context
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"]
        schema = pa.schema([(x, pa.binary() if x == "ids" else pa.int64()) for x in names])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            sequence = TaskContext.get().partitionId() << 33
            size = 0

            def emit(pieces: list[Piece]) -> None:
                nonlocal sequence, size
                offset = 0
                for piece in pieces:
                    doc, ids, a, b, _ = piece
                    rows.append((doc, a, b - a, ids[4 * a : 4 * b], len(ids) // 4, loss_tokens(piece), sequence, offset))
                    offset += b - a
                sequence += 1
                size += offset

            def batch_of() -> pa.RecordBatch:
                columns = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

            packer, encoder = VectorPacker(*limits, emit), word_ids(name)
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    few = batch.slice(i, 256)
                    for doc, ids, loss in zip(few.column(0).to_pylist(), encoder.ids(few.column(1).to_pylist()), few.column(2).to_pylist(), strict=True):
                        ids += end
                        if loss is None:
                            loss = int(share * (len(ids) // 4))
                        for a in range(0, len(ids) // 4, limits[0]):
                            packer.add((doc, ids, a, min(a + limits[0], len(ids) // 4), loss))
                    if size >= 1 << 20:
                        yield batch_of()
                        size = 0
                        rows.clear()
            packer.finish()
            if rows:
                yield batch_of()

        first = F.col(loss_from).cast("int") if loss_from else F.lit(None).cast("int")
        return docs.select(F.col("doc_id").cast("long"), "text", first).mapInArrow(run, ", ".join(f"{x} {'binary' if x == 'ids' else 'long'}" for x in names))

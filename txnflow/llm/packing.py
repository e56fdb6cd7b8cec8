"""Hierarchical multi-length packing.

Documents are routed to tiers by length: windows of 512, 1024, 2048 and 4096 tokens. A task packs the documents of one block
after another. Windows of each tier, from the longest, take the block's documents of that tier; the gap that is left
takes whole documents of shorter tiers, the longest that fits first, and what remains open is filled with a cut one.
A full window of any tier is a power of two long and so needs no padding. What is too little for a window stays
for the next block; at the end of a task it becomes windows of its binary digits, so nothing at all is padded.
Full windows are gathered into step groups of an equal number of tokens.

A document's tokens are its text's ids and an end id. Each token lies in exactly one piece. A missing or empty text
is one end id. Nothing is shuffled; the result depends on which rows a task reads, not on their number of retries.
"""

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from txnflow.llm.rows import ROWS
from txnflow.llm.tokens import WORD_BPE, shared

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens a task gathers before it packs them.
BLOCK_TOKENS = 1 << 20
#: Tokens of a step group.
STEP_TOKENS = 1 << 17
#: Sequence ids of a task start at its number times this.
_IDS_PER_TASK = 1 << 33

Piece = tuple[int, int, int]  # document, start, length
Window = list[Piece]


class Shelf:
    """The documents of one tier that wait, by length, oldest first among equals."""

    def __init__(self):
        self.by_length: dict[int, deque[Piece]] = {}
        self.lengths: list[int] = []
        self.tokens = 0

    def put(self, piece: Piece) -> None:
        n = piece[2]
        if n not in self.by_length:
            self.by_length[n] = deque()
            self.lengths.insert(int(np.searchsorted(self.lengths, n)), n)
        self.by_length[n].append(piece)
        self.tokens += n

    def take(self, most: int) -> Piece | None:
        """The longest of at most ``most`` tokens."""
        at = int(np.searchsorted(self.lengths, most, side="right")) - 1
        if at < 0:
            return None
        n = self.lengths[at]
        piece = self.by_length[n].popleft()
        if not self.by_length[n]:
            del self.by_length[n], self.lengths[at]
        self.tokens -= n
        return piece

    def shortest_over(self, least: int) -> Piece | None:
        at = int(np.searchsorted(self.lengths, least, side="right"))
        return self.take(self.lengths[at]) if at < len(self.lengths) else None


class Packer:
    """Packs pieces into windows of the given tiers, block by block."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = sorted(tiers)
        self.shelves = [Shelf() for _ in self.tiers]

    def add(self, document: int, length: int) -> Iterator[Window]:
        """Routes a document; one longer than the longest tier gives full windows at once."""
        longest, start = self.tiers[-1], 0
        while length - start >= longest:
            yield [(document, start, longest)]
            start += longest
        if start < length:
            self._put((document, start, length - start))

    def _put(self, piece: Piece) -> None:
        self.shelves[next(k for k, t in enumerate(self.tiers) if piece[2] <= t)].put(piece)

    def _window(self, k: int) -> Window:
        """One full window of tier ``k``; its shelf and the shorter ones must hold enough."""
        gap, window = self.tiers[k], []
        for shelf in reversed(self.shelves[:k + 1]):
            while gap and (piece := shelf.take(gap)):
                window.append(piece)
                gap -= piece[2]
        if gap:
            document, start, length = next(p for s in self.shelves[:k + 1] if (p := s.shortest_over(gap)))
            window.append((document, start, gap))
            self._put((document, start + gap, length - gap))
        return window

    def full(self) -> Iterator[Window]:
        """Windows of every tier while its shelf has documents and there is enough to fill it."""
        for k in reversed(range(len(self.tiers))):
            while self.shelves[k].tokens and sum(s.tokens for s in self.shelves[:k + 1]) >= self.tiers[k]:
                yield self._window(k)

    def rest(self) -> Iterator[Window]:
        """All that waits, in windows whose lengths are powers of two."""
        yield from self.full()
        pieces = [p for s in self.shelves for q in s.by_length.values() for p in q]
        self.shelves = [Shelf() for _ in self.tiers]
        left, pieces = sum(p[2] for p in pieces), deque(sorted(pieces, key=lambda p: -p[2]))
        while left:
            gap, window = 1 << (min(left, self.tiers[-1]).bit_length() - 1), []
            left -= gap
            while gap:
                document, start, length = pieces.popleft()
                used = min(gap, length)
                window.append((document, start, used))
                gap -= used
                if used < length:
                    pieces.appendleft((document, start + used, length - used))
            yield window


class Steps:
    """Step groups: windows are dealt, longest first, to the open group that has room, so that groups hold equal tokens."""

    def __init__(self, tokens: int):
        self.tokens, self.open, self.made = tokens, [], 0

    def group_of(self, length: int) -> int:
        at = next((k for k, (_, room) in enumerate(self.open) if room >= length), None)
        if at is None:
            self.open.append((self.made, self.tokens))
            self.made += 1
            at = len(self.open) - 1
        number, room = self.open[at]
        if room == length:
            del self.open[at]
        else:
            self.open[at] = (number, room - length)
        return number


def pack(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS,
         step_tokens: int = STEP_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window (its length), step_group."""
    key = docs.schema["doc_id"].dataType
    fields = "start length ids_crc32 doc_tokens sequence_id offset window step_group".split()

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, steps = shared(tokenizer), Packer(tiers), Steps(step_tokens)
        first_id = TaskContext.get().partitionId() * _IDS_PER_TASK
        ids: dict[int, np.ndarray] = {}
        keys: dict[int, pa.Scalar] = {}
        open_tokens: dict[int, int] = {}
        number = sequence = waiting = 0

        def rows(windows: list[Window]) -> pa.RecordBatch:
            nonlocal sequence
            out, owners = {f: [] for f in fields}, []
            for window in windows:
                length, offset = sum(p[2] for p in window), 0
                group = steps.group_of(length)
                for d, start, n in window:
                    owners.append(keys[d])
                    crc = zlib.crc32(ids[d][start:start + n].astype("<u4").tobytes())
                    for f, v in zip(fields, (start, n, crc, len(ids[d]), first_id + sequence, offset, length, first_id + group), strict=True):
                        out[f].append(v)
                    offset += n
                    open_tokens[d] -= n
                    if not open_tokens[d]:
                        del ids[d], keys[d], open_tokens[d]
                sequence += 1
            return pa.RecordBatch.from_arrays(
                [pa.array(owners, kind), *(pa.array(out[f], pa.int64()) for f in fields)], ["doc_id", *fields])

        kind = None
        for batch in stream:
            kind = batch.column(0).type
            column, windows = batch.column(0), []
            texts = (t for at in range(0, batch.num_rows, ROWS) for t in batch.column(1).slice(at, ROWS).to_pylist())
            for k, found in enumerate(encoder.encode(texts)):
                ids[number] = np.append(found, np.uint32(end_id))
                keys[number], open_tokens[number] = column[k].as_py(), len(ids[number])
                waiting += len(ids[number])
                windows += packer.add(number, len(ids[number]))
                number += 1
                if waiting >= block_tokens:
                    windows += packer.full()
                    yield rows(sorted(windows, key=lambda w: -sum(p[2] for p in w)))
                    windows, waiting = [], 0
            if windows:
                yield rows(windows)
        if kind is not None:
            yield rows(list(packer.rest()))

    schema = f"doc_id {key.simpleString()}, " + ", ".join(f"{f} bigint" for f in fields)
    return docs.select("doc_id", "text").mapInArrow(batches, schema)

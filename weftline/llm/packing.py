"""Hierarchical packing into windows of several lengths.

Documents become whole windows of the longest tier and a rest; the rest is routed to the smallest tier that holds it. Tiers
are packed from long to short: a rest opens a window of its tier, whose gap takes the largest shorter rests that fit, and
at last a cut from the smallest one, so that windows are full. What can't fill a window is carried to the next group of
documents of the task, and only a task's last window is padded. Sequences of a tier are dealt evenly to step groups.

Each task packs the documents it reads, in order, holding one group of them; nothing is shuffled, and a task that runs
again gives the same rows. Defined results: a null or empty text is its end token alone; a null doc_id stays null; each
repeated row is a document of its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import plain_columns, table
from .tokens import ids

TIERS = (1024, 512, 256, 128)
END = 0
#: Tokens of a step group, and tokens a task holds before it packs.
STEP_TOKENS = 1 << 16
GROUP_TOKENS = 1 << 22
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"

Piece = tuple[int, int, int]  # document, start, length


class Packer:
    """Packs pieces into windows of the tiers' lengths; what is left waits for more."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers, self.pool, self.mask = tiers, {}, 0

    def put(self, piece: Piece) -> None:
        self.pool.setdefault(piece[2], []).append(piece)
        self.mask |= 1 << piece[2]

    def take(self, n: int) -> Piece:
        piece = self.pool[n].pop()
        if not self.pool[n]:
            self.mask &= ~(1 << n)
        return piece

    def document(self, doc: int, n: int) -> Iterator[tuple[int, list[Piece]]]:
        """The document's whole windows; its rest waits."""
        top = self.tiers[0]
        for at in range(0, n - top + 1, top):
            yield top, [(doc, at, top)]
        if n % top:
            self.put((doc, n - n % top, n % top))

    def drain(self, last: bool) -> Iterator[tuple[int, list[Piece]]]:
        """Full windows of what waits, from the longest tier to the shortest; at last also the one that isn't full."""
        for t, below in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            while seeds := self.mask & ((1 << (t + 1)) - 1) & ~((1 << (below + 1)) - 1):
                window, gap = [self.take(seeds.bit_length() - 1)], 0
                gap = t - window[0][2]
                while gap and self.mask:
                    if fits := self.mask & ((1 << (gap + 1)) - 1):
                        piece = self.take(fits.bit_length() - 1)
                    else:
                        doc, at, n = self.take((self.mask & -self.mask).bit_length() - 1)
                        piece = (doc, at, gap)
                        self.put((doc, at + gap, n - gap))
                    window.append(piece)
                    gap -= piece[2]
                if not gap:
                    yield t, window
                elif last:
                    yield self.tiers[0], window
                else:
                    for piece in window:
                        self.put(piece)
                    return


def pack_rows(batches: Iterator[pa.RecordBatch], tiers: tuple[int, ...] = TIERS, group: int = GROUP_TOKENS, step: int = STEP_TOKENS) -> Iterator[pa.RecordBatch]:
    """doc_id, text batches to one row a piece, as SCHEMA."""
    task = TaskContext.get()
    first = (task.partitionId() if task else 0) << 32
    encoder, packer, held, docs = ids(), Packer(tiers), 0, {}
    count, made, end = 0, 0, np.array([END], "<u4").tobytes()

    def rows(windows: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
        nonlocal made
        of_tier: dict[int, int] = {}
        for t, _ in windows:
            of_tier[t] = of_tier.get(t, 0) + 1
        groups, dealt, base = {}, dict.fromkeys(of_tier, 0), made
        for t, n in sorted(of_tier.items()):
            groups[t] = (base, max(1, -(-n * t // step)))
            base += groups[t][1]
        out: list[list] = [[] for _ in range(9)]
        nonlocal count
        for t, window in windows:
            offset, g = 0, first + groups[t][0] + dealt[t] % groups[t][1]
            dealt[t] += 1
            for doc, at, n in window:
                doc_id, raw = docs[doc]
                for x, v in zip(out, (doc_id, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), len(raw) // 4, first + count, offset, t, g), strict=True):
                    x.append(v)
                offset += n
            count += 1
        made = base
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=[x.split()[0] for x in SCHEMA.split(", ")])

    windows: list = []
    key = 0
    for batch in batches:
        texts, names = batch.column("text"), batch.column("doc_id").to_pylist()
        for k in range(0, len(names), 400):
            for doc_id, raw in zip(names[k : k + 400], encoder.encode(texts.slice(k, 400).to_pylist()), strict=True):
                raw += end
                docs[key] = (doc_id, raw)
                windows += packer.document(key, len(raw) // 4)
                held, key = held + len(raw) // 4, key + 1
                if held >= group:
                    windows += packer.drain(last=False)
                    yield rows(windows)
                    waiting = {p[0] for ps in packer.pool.values() for p in ps}
                    docs, windows = {d: docs[d] for d in waiting}, []
                    held = 0
    windows += packer.drain(last=True)
    if windows:
        yield rows(windows)


def pack(df: DataFrame) -> DataFrame:
    return plain_columns(df, ["doc_id", "text"]).mapInArrow(pack_rows, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row a piece of a document."""
    return pack(docs)

"""Packing of documents into token windows: bounded-space online best fit, then a merge of the leftovers."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize, read_table, ship, text_slices
from ridgeline.llm.encoding import encoder, vocabulary

CAPACITY = 2048
OPEN_WINDOWS = 16
#: A window with at most this many free tokens is sent out padded rather than topped up by a cut.
SLACK = 16
#: Partitions whose leftover windows one task merges: at most MERGE_PARTITIONS * OPEN_WINDOWS windows.
MERGE_PARTITIONS = 16
END_ID = 1

Piece = tuple[int, int, int]  # document's place in the caller's list, first token, number of tokens


class Packer:
    """Holds at most `windows` open windows of `capacity` tokens.

    A piece goes to the open window that it fits most tightly. If it fits none, and no
    further window may be opened, the fullest window is topped up by a cut of the piece
    (or left with at most `slack` free tokens) and sent out.
    """

    def __init__(self, capacity: int = CAPACITY, windows: int = OPEN_WINDOWS, slack: int = SLACK):
        self.capacity, self.windows, self.slack = capacity, windows, slack
        self.open: list[tuple[int, list[Piece]]] = []  # tokens held, pieces
        self.full: list[list[Piece]] = []

    def add(self, doc: int, n: int) -> None:
        start = 0
        while n - start >= self.capacity:
            self.full.append([(doc, start, self.capacity)])
            start += self.capacity
        while (rest := n - start) > 0:
            best = -1
            for i, (held, _) in enumerate(self.open):
                if held + rest <= self.capacity and (best < 0 or held > self.open[best][0]):
                    best = i
            if best < 0 and len(self.open) < self.windows:
                self.open.append((rest, [(doc, start, rest)]))
                return
            if best >= 0:
                held, pieces = self.open[best]
                pieces.append((doc, start, rest))
                self.open[best] = (held + rest, pieces)
                if held + rest == self.capacity:
                    self.full.append(self.open.pop(best)[1])
                return
            fullest = max(range(len(self.open)), key=lambda i: self.open[i][0])
            held, pieces = self.open.pop(fullest)
            free = self.capacity - held
            if free > self.slack:
                pieces.append((doc, start, free))
                start += free
            self.full.append(pieces)


def powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def merge(windows: list[list[Piece]], capacity: int = CAPACITY, slack: int = SLACK) -> list[list[Piece]]:
    """Sequences from leftover windows: best fit of whole windows, fullest first; what stays
    loose is laid end to end and cut at the capacity, the last of it at powers of two (no padding)."""
    held = lambda w: sum(n for _, _, n in w)
    bins: list[list] = []
    for w in sorted(windows, key=held, reverse=True):
        h, best = held(w), None
        for b in bins:
            if b[0] + h <= capacity and (best is None or b[0] > best[0]):
                best = b
        if best is None:
            bins.append([h, list(w)])
        else:
            best[0] += h
            best[1].extend(w)
    out = [pieces for h, pieces in bins if h >= capacity - slack]
    loose = [p for h, pieces in bins if h < capacity - slack for p in pieces]
    total = sum(n for _, _, n in loose)
    sizes = [capacity] * (total // capacity) + powers(total % capacity)
    queue = iter(loose)
    doc, start, n = next(queue, (0, 0, 0))
    for size in sizes:
        sequence: list[Piece] = []
        while size:
            take = min(size, n)
            sequence.append((doc, start, take))
            size, start, n = size - take, start + take, n - take
            if not n:
                doc, start, n = next(queue, (0, 0, 0))
        out.append(sequence)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(docs: DataFrame, *, tokenizer: str | None = None, end: int = END_ID, capacity: int = CAPACITY, windows: int = OPEN_WINDOWS, slack: int = SLACK, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: which tokens of which document lie where in which sequence.

    Each partition is packed as its rows come, with a fixed number of open windows; its last
    windows, the leftovers, keep their ids and are merged by bounded groups of partitions. No text
    is shuffled. The pieces (and leftovers) are written to the shared folder once, so a lost
    executor repeats only its own tasks.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur, a
    null doc_id is carried as null; other columns are ignored; an empty table gives no piece.
    """
    spark = docs.sparkSession
    ship(spark)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary(tokenizer)), TaskContext.get().partitionId()
        packer, kept, sent = Packer(capacity, windows, slack), {}, 0  # kept: documents that open windows hold
        number = 0

        def rows(sequences: list[list[Piece]], left: bool, base: int) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(9)]
            for k, sequence in enumerate(sequences):
                at = 0
                for doc, start, n in sequence:
                    key, ids = kept[doc]
                    part_ids = ids[start : start + n]
                    for c, v in zip(cols, (key, start, n, _crc(part_ids), len(ids), (part << 32) + base + k, at, part, part_ids.astype("<u4").tobytes() if left else None), strict=True):
                        c.append(v)
                    at += n
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.int32()), pa.array(cols[8], pa.binary())], names=[*_NAMES, "part", "left_ids"])

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for first, texts in text_slices(batch, "text"):
                ids, bounds = enc.encode(texts, end)
                for i in range(len(texts)):
                    kept[number] = (keys[first + i], ids[bounds[i] : bounds[i + 1]])
                    packer.add(number, int(bounds[i + 1] - bounds[i]))
                    number += 1
                if packer.full:
                    yield rows(packer.full, False, sent)
                    sent += len(packer.full)
                    packer.full = []
                kept = {d: (kept[d][0], kept[d][1].copy()) for _, w in packer.open for d, _, _ in w}
        if packer.open:
            yield rows([w for _, w in packer.open], True, sent)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sequence_id", "offset"], kind="stable").reset_index(drop=True)
        ids = [np.frombuffer(x, "<u4") for x in pdf["left_ids"]]
        inside: dict[int, list[Piece]] = {}
        for i, s in enumerate(pdf["sequence_id"]):
            inside.setdefault(s, []).append((i, 0, len(ids[i])))
        base, out = (1 << 62) + (int(pdf["part"].iloc[0]) // MERGE_PARTITIONS << 32), []
        key = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
        for k, sequence in enumerate(merge(list(inside.values()), capacity, slack)):
            at = 0
            for i, start, n in sequence:
                out.append((key[i], int(pdf["start"][i]) + start, n, _crc(ids[i][start : start + n]), int(pdf["doc_tokens"][i]), base + k, at))
                at += n
        made = pd.DataFrame(out, columns=_NAMES)
        return made.astype({c: "Int64" for c in _NAMES})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    placed = materialize(rows.mapInArrow(pieces, f"{PIECES}, part int, left_ids binary"), "pieces")
    left = placed.filter(F.col("left_ids").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no null integers
    group = F.floor(F.col("part") / MERGE_PARTITIONS).alias("_group")
    return placed.filter(F.col("left_ids").isNull()).select(*_NAMES).unionByName(left.groupBy(group).applyInPandas(merged, PIECES))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))

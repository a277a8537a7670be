"""Best-fit packing of documents into fixed-length sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, lean, written
from .tokens import encoder, vocabulary

#: Short pieces packed together in one task; the number of tasks grows with the input.
BLOCK_PIECES = 40_000

PIECE = [
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
]


def cut(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Each document's token ids and an end id, cut into pieces of capacity ids; only longer documents are cut.

    Null and empty texts are one piece of the end id alone, invalid UTF-8 counts as replacement characters, repeated rows
    are rows of their own, and an empty table gives none. Columns to keep that have the name of a new one are replaced.
    with_ids adds the ids themselves as little-endian bytes.
    """
    bounded_batches(docs.sparkSession)
    keep = tuple(c for c in keep if c not in {f.name for f in PIECE} | ({"ids"} if with_ids else set()))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("binary").alias("__text"))
    schema = T.StructType([*(docs.schema[c] for c in keep), *PIECE, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def scan(batches):
        enc = encoder(path)
        for b in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(b.column("__text").to_pylist()):
                all_ids = np.append(enc.ids(text), np.uint32(end_id)).astype("<u4")
                for k in range(0, len(all_ids), capacity):
                    part = all_ids[k : k + capacity].tobytes()
                    row.append(i)
                    piece.append(k // capacity)
                    start.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            at = pa.array(row, pa.int64())
            made = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), *([pa.array(ids, pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keep), *made], names=[f.name for f in schema])

    return rows.mapInArrow(lean(scan), schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, placed in the given order.

    A piece of length s moves a bin from gap g to gap g - s, which changes the sum of squared counts of open bins per
    gap by 2 (N[g - s] - N[g]) + 2, or by 2 N[capacity - s] + 1 for a new bin; full bins count for nothing. The piece
    goes where the sum becomes smallest; ties go to the smallest gap, so the fullest bin.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        after = count[: capacity - s + 1].copy()
        after[0] = 0
        change = 2 * (after - count[s:]) + 2
        if s < capacity:
            change[0] = 1 - 2 * count[s]
        change[count[s:] == 0] = np.iinfo(np.int64).max
        g = int(change.argmin()) + s if len(change) else s
        new = 2 * count[capacity - s] + 1 if s < capacity else 0
        if count[g] and change[g - s] <= new:
            b = open_bins[g].pop()
            count[g] -= 1
            offsets[i] = capacity - g
        else:
            b, g, made = made, capacity, made + 1
            offsets[i] = 0
        bins[i] = b
        if g > s:
            open_bins[g - s].append(b)
            count[g - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, block_pieces: int = BLOCK_PIECES, length_col: str = "length", seed: int = 11) -> DataFrame:
    """pieces(…, length) -> the same rows with sequence_id long and offset long.

    Full pieces are sequences of their own. The others are dealt evenly into blocks of about block_pieces rows, by a
    hash of the whole row and its place, and each block is packed by sum_of_squares from the longest piece down; a
    second pass takes the pieces of sequences that stayed too empty from all blocks and packs those anew. What a block
    packs is a number and a length for each of its rows, so a task's memory is bounded whatever the pieces hold; their
    other columns join afterwards. Rows of one document or copies of a text are spread. Every row comes back once:
    repeated rows, nulls in other columns and an empty table need no special case. Columns named sequence_id or offset
    are replaced. Pieces longer than capacity, or of a null length, raise an error.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    numbered = written(pieces.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__piece"), F.col(f"`{length_col}`").cast("long").alias("__length")).withColumn("__number", F.monotonically_increasing_id()), "numbered")
    fits = F.when(F.col("__length").between(0, capacity), F.col("__length")).otherwise(F.raise_error(F.lit("a piece is longer than a sequence, or of no length")))
    narrow = numbered.select("__number", fits.cast("long").alias("__length"))
    rest = narrow.where(F.col("__length") < capacity)
    schema = "__number long, __length long, sequence_id long, offset long, __filled long"

    def packed(rows: DataFrame, blocks: int, first: int) -> DataFrame:
        def one(block: pd.DataFrame) -> pd.DataFrame:
            number = int(block["__block"].iloc[0])
            rows = block.drop(columns="__block").sort_values(["__length", "__number"], ascending=False, kind="stable").reset_index(drop=True)
            lengths = rows["__length"].to_numpy(np.int64)
            bins, offsets = sum_of_squares(lengths, capacity)
            filled = np.bincount(bins, weights=lengths).astype(np.int64)
            return rows.assign(sequence_id=bins + ((first + number) << 32), offset=offsets, __filled=filled[bins])

        dealt = rows.withColumn("__block", F.pmod(F.xxhash64(F.lit(seed + first), "__number"), F.lit(blocks)))
        return dealt.groupBy("__block").applyInPandas(one, schema)

    n = rest.count()
    blocks = max(1, -(-n // block_pieces))
    done = written(packed(rest, blocks, 0), "packed")
    good = done.where(F.col("__filled") >= int(capacity * 0.98))
    poor = done.where(F.col("__filled") < int(capacity * 0.98))
    if blocks > 1:
        m = poor.count()
        poor = packed(poor.select("__number", "__length"), max(1, -(-m // block_pieces)), blocks)
    places = good.unionByName(poor).select("__number", "sequence_id", "offset")
    alone = numbered.where(F.col("__length") >= capacity).select("__piece", (-1 - F.col("__number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = numbered.where(F.col("__length") < capacity).join(places, "__number").select("__piece", "sequence_id", "offset")
    return alone.unionByName(placed).select(*[F.col("__piece").getField(c).alias(c) for c in names], "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: keep columns, piece, start, length, ids_crc32, [ids,] sequence_id, offset. See cut() and pack()."""
    return pack(cut(docs, path or vocabulary(), capacity, end_id, text_col, keep, with_ids), capacity)

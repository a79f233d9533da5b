"""Sharding by histogram sort: equal shards of bytes, found by counting, and one exchange of the rows.

Every row has a 64-bit key, a hash of the chosen columns and of its file's name and its place in it, so that
copies of a row, however many, have keys of their own, and a table copied to another folder is dealt alike. Splitters are found by passes over a narrow table
of (key, size): a pass counts the exact bytes below each probe, keeps for every splitter the gap between
two probes that holds its target, and the next pass puts its probes into these gaps only. A splitter is
settled once the bytes in its gap are within the tolerance, or the gap cannot be divided. The rows are then
sent once: a shard consists of pieces (parts of its key range), each of which is sorted and numbered in a task of its own.

Rows are read twice; a table that is not read from Parquet files is written first. Null texts count one byte.
Repeated rows are all kept, an empty table gives an empty result; columns called ``shard``, ``slot`` or
``size``, in any case, are replaced, all others are kept as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tillcast.llm.tables import free_name, staged, with_row_id, without

LOW, HIGH = -(1 << 63), (1 << 63)
MAX_BROADCAST_PIECES = 1 << 20


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def row_key(columns: list[str], row: str) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns], F.col(f"`{row}`.name"), F.col(f"`{row}`.place"))


def splitters(sizes: DataFrame, shards: int, tolerance: float = 0.0005, bits: int = 8) -> list[int]:
    """Keys at which shards 1, 2, ... begin. ``sizes`` has ``key`` and ``size``.

    ``tolerance`` is in mean shard sizes. Each pass divides a gap by ``2 ** bits`` probes, so a key is
    settled after ``64 / bits`` passes at most; the driver holds ``shards * 2 ** bits`` counts at a time.
    """
    total = sizes.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [LOW] * (shards - 1)
    wanted = [total * i / shards for i in range(1, shards)]
    # For each splitter the gap that holds it, as the leading bits of its keys, and the bytes below it.
    gaps: list[tuple[int, int]] = [(0, 0)] * len(wanted)
    chosen: list[int | None] = [None] * len(wanted)
    shift = 64
    while None in chosen:
        shift -= bits
        counts = _bytes_of_cells(sizes, None if shift + bits == 64 else {g for (g, _), c in zip(gaps, chosen) if c is None}, shift, bits)
        for i, (gap, below) in enumerate(gaps):
            if chosen[i] is not None:
                continue
            first = -(1 << (bits - 1)) if shift + bits == 64 else gap << bits
            for cell in range(first, first + (1 << bits)):
                inside = counts.get(cell, 0)
                if below + inside >= wanted[i]:
                    break
                below += inside
            if inside <= tolerance * total / shards or shift == 0:
                nearer_low = wanted[i] - below <= below + inside - wanted[i]
                chosen[i] = (cell if nearer_low else cell + 1) << shift
            gaps[i] = (cell, below)
    return chosen


def _bytes_of_cells(sizes: DataFrame, gaps: set[int] | None, shift: int, bits: int) -> dict[int, int]:
    """Exact bytes between neighbouring probes inside the gaps, by the leading bits of the keys."""
    if gaps is not None:
        sizes = sizes.where(F.shiftright("key", shift + bits).isin(*gaps))
    rows = sizes.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("n")).collect()
    return {r.cell: r.n for r in rows}


def shard_of(key: Column, cuts: list[int]) -> Column:
    return _halved(key, cuts, 0)


def _halved(key: Column, cuts: list[int], first: int) -> Column:
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    low, high = _halved(key, cuts[:half], first), _halved(key, cuts[half + 1:], first + half + 1)
    if cuts[half] >= HIGH:
        return low
    return F.when(key < F.lit(cuts[half]), low).otherwise(high)


def shard_rows(docs: DataFrame, shards: int = 16, *, key_columns: list[str], text: str = "text",
               tolerance: float = 0.0005, piece_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot`` (the row's place in its shard, from 0, in key order)."""
    docs = without(docs, *({"size", "shard", "slot"} - {text.lower()}))
    key, row, piece, at = (free_name(docs, n) for n in ("key", "row", "piece", "at"))
    keyed = with_row_id(docs, row).withColumn(key, row_key(key_columns, row)).drop(row).withColumn("size", row_size(F.col(f"`{text}`")))
    sizes = staged(keyed.select(key, "size"), "shard-sizes")
    cuts = splitters(sizes.withColumnRenamed(key, "key"), shards, tolerance)
    total = sizes.agg(F.sum("size")).first()[0] or 0
    # Keys are hashes, so equal parts of the key range hold about equal bytes.
    bits = math.ceil(math.log2(max(1, total / max(1, piece_bytes))))
    pieces = shards + (1 << bits)

    def placed(df: DataFrame) -> DataFrame:
        # Shard and part both grow with the key, so their sum tells the pieces apart.
        part = F.shiftright(key, 64 - bits) + (1 << (bits - 1)) if bits else F.lit(0)
        return df.withColumn("shard", shard_of(F.col(key), cuts)).withColumn(piece, (F.col("shard") + part).cast("int"))

    counts = placed(sizes).groupBy("shard", piece).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    first = free_name(docs, "first")
    offsets = counts.select(piece, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    if pieces <= MAX_BROADCAST_PIECES:
        offsets = F.broadcast(offsets)
    dealt = placed(keyed).repartitionById(pieces, F.col(piece)).sortWithinPartitions(key)
    # The lower 33 bits of this number are the row's place in its partition, which is a piece.
    numbered = dealt.withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return numbered.join(offsets, piece).select(*[F.col(f"`{c}`") for c in docs.columns], "size", "shard", (F.col(first) + F.col(at)).cast("long").alias("slot"))

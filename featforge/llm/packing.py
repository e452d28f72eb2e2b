"""Best-fit packing of tokenized documents into sequences of bounded length by minimum bin slack.

Only the number of pieces of each length decides how they are combined, so the plan is made from that histogram, which
has at most ``capacity`` rows however many documents there are. For each bin, a bitset of reachable sums over the
available lengths finds the fullest feasible combination; it is taken as often as the counts allow and removed. Every
piece then looks up its place by its rank among the pieces of its length.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featforge.llm.tokens import encoded
from featforge.session import cut_lineage

END_ID = 0


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = END_ID, text: str = "text",
               key: str = "doc_id") -> DataFrame:
    """Token pieces: key, piece, start, length, ids (little-endian unsigned 32-bit, binary).

    Each document is its ids and ``end_id``; only longer ones than ``capacity`` are cut. A null or empty text is the end
    id alone. Repeated rows give their pieces each; the key may be null; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, at in encoded(batch.column(1), tokenizer):
                sizes = np.diff(at) + 1
                full = np.insert(ids, at[1:], np.uint32(end_id)).astype("<u4")
                count = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                begin = np.cumsum(length) - length
                edges = np.append(begin, len(full)) * 4
                raw = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(edges.astype(np.int64)),
                                                                          pa.py_buffer(full)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + first)), pa.array(piece.astype(np.int32)), pa.array(start),
                     pa.array(length), raw.cast(pa.binary())], [key, "piece", "start", "length", "ids"])

    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids binary")


def _fullest(counts: Mapping[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The combination with the largest sum up to ``room``, as length -> times; ``lengths`` descend.

    ``reach`` has bit s set if sum s can be made. Times are split in powers of two, so each step is one shift; of equal
    sums, the one found from the longest lengths is taken.
    """
    reach, steps, mask, goal = 1, [], (2 << room) - 1, 1 << room
    for size in lengths:
        if size > room:
            continue
        left, times = min(counts[size], room // size), 1
        while left and not reach & goal:
            times = min(times, left)
            steps.append((size, times, reach))
            reach |= (reach << size * times) & mask
            left, times = left - times, times * 2
        if reach & goal:
            break
    rest, out = reach.bit_length() - 1, {}
    for size, times, before in reversed(steps):
        if not before >> rest & 1:
            out[size] = out.get(size, 0) + times
            rest -= size * times
    return out


def pack_lengths(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (times, {length: pieces in each}); the longest length left is in every bin, so that none is left over."""
    counts = {size: n for size, n in histogram.items() if n > 0}
    bins = []
    while counts:
        lengths = sorted(counts, reverse=True)
        longest = lengths[0]
        counts[longest] -= 1
        found = _fullest(counts, lengths, capacity - longest)
        counts[longest] += 1
        found[longest] = found.get(longest, 0) + 1
        times = min(counts[size] // k for size, k in found.items())
        bins.append((times, found))
        for size, k in found.items():
            counts[size] -= k * times
            if not counts[size]:
                del counts[size]
    return bins


def _slots(bins: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of slots of one length: length, first rank, end rank, slots a bin, first sequence, first offset."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for times, found in bins:
        offset = 0
        for size in sorted(found, reverse=True):
            k, first = found[size], ranks.get(size, 0)
            out.append((size, first, first + k * times, k, sequence, offset))
            ranks[size] = first + k * times
            offset += k * size
        sequence += times
    return out


def place(pieces: DataFrame, capacity: int = 2048, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"),
          salts: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless from 0 in each sequence, at most ``capacity`` in sum.

    ``pieces`` is read twice and should be fixed (checkpointed or read from files). Ranks are counted in ``salts`` parts
    of each length (default: the number of shuffle partitions), so a length that most pieces have is spread. The
    histogram and the plan, which reach the driver and are broadcast, have no more rows than ``capacity`` lengths and
    their runs. ``sequence_id`` and ``offset`` must not be columns already. No rows give no rows.
    """
    spark = pieces.sparkSession
    salts = salts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(F.col(length).alias("_length"), F.col("_salt").alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = cut_lineage(sizes)
    histogram = {r[0]: r[1] for r in sizes.groupBy("_length").agg(F.sum("_n")).collect()}  # at most ``capacity`` rows
    plan = spark.createDataFrame(_slots(pack_lengths(histogram, capacity)) or [(0, 0, 0, 1, 0, 0)],
                                 "_size bigint, _from bigint, _to bigint, _k bigint, _sequence bigint, _offset bigint")
    before = sizes.selectExpr("_length", "_part", "sum(_n) over (partition by _length order by _part) - _n as _before")
    ranked = salted.selectExpr("*", "row_number() over (partition by {0}, _salt order by {1}) - 1 as _row".format(
        f"`{length}`", ", ".join(f"`{c}`" for c in order)))
    ranked = ranked.join(before, (F.col(length) == F.col("_length")) & (F.col("_salt") == F.col("_part")))
    ranked = ranked.withColumn("_rank", F.col("_row") + F.col("_before"))
    found = ranked.join(F.broadcast(plan), (F.col(length) == F.col("_size")) & (F.col("_rank") >= F.col("_from"))
                        & (F.col("_rank") < F.col("_to")))
    slot = F.col("_rank") - F.col("_from")
    return found.select(*pieces.columns, (F.col("_sequence") + F.floor(slot / F.col("_k"))).alias("sequence_id"),
                        (F.col("_offset") + F.pmod(slot, F.col("_k")) * F.col(length)).alias("offset"))


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, length, ids (binary) of pieces that carry ``ids``; each is one bounded group."""
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts")
    ).select("sequence_id", "length", F.aggregate("_parts", F.expr("cast('' as binary)"),
                                                  lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = END_ID) -> DataFrame:
    """Place of every piece of every document, with the crc32 of its ids; the texts are tokenized once."""
    pieces = cut_pieces(docs, tokenizer, capacity, end_id)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(cut_lineage(pieces), capacity, order=("doc_id", "piece", "ids_crc32"))

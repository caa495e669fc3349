"""Spans of lines whose slices land over several files, in any order.

A span is known for certain only when its line is complete, and nobody says when
that is. So the stream keeps what is known of each line, not its spans: the
separators, and which slices between them have been seen, as ranges of numbers.
A line is cut into chunks of its order, and chunks are dealt to buckets by a hash of
line and chunk. A bucket is a key of the stream's state: an Arrow table of its chunks.
There are several times as many buckets as Spark keeps state partitions, so a long line
is spread over many and a landing costs one call for each bucket that it meets, not one for each
chunk. Every change of a chunk is appended to a table, and the spans of the moment are read
from the newest row of each chunk, whatever the order in which slices came.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandcut.operators.ordering import as_list, chunk_of
from strandcut.operators.spans import char_spans

# What is known of a chunk is at most this many separators or ranges.
CHUNK_BITS = 12
# Keys of the state; fixed, like the number of its partitions, when a stream first starts.
BUCKETS = 2048
LISTS = ("first", "last", "at", "pos")
KNOWN = T.StructType([
    *[T.StructField(c, T.ArrayType(T.LongType())) for c in LISTS],
    T.StructField("end", T.LongType()), T.StructField("end_pos", T.LongType()),
])
STATE = T.StructType([T.StructField("chunks", T.BinaryType())])
# Lines are told apart by their key as JSON, which every key type comes back from.
KEY_JSON = {"timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
CHUNKS = pa.schema([
    ("line", pa.string()), ("chunk", pa.int64()), *[(c, pa.list_(pa.int64())) for c in LISTS],
    ("end", pa.int64()), ("end_pos", pa.int64()),
])


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every element of a list column."""
    counts = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), counts), column.flatten().to_numpy()


def fold_chunks(known: pa.RecordBatch, slot: np.ndarray, order: np.ndarray, label: np.ndarray, pos: np.ndarray) -> list[pa.Array]:
    """What is known of some chunks (``LISTS``, ``end``, ``end_pos``), with new slices added to row ``slot`` each.

    Of two labels for one slice the later one stays. Every row must have a slice, known or new.
    """
    (run, first), (_, last), (cut, at), (_, at_pos) = (_flat(known.column(c)) for c in LISTS)
    length = last - first + 1
    zero = np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())
    line = np.repeat(run, length)
    end = known.column("end").fill_null(0).to_numpy()
    end_pos = known.column("end_pos").fill_null(0).to_numpy()
    slot = np.concatenate([line, cut, slot])
    label = np.concatenate([np.zeros(len(zero), np.int64), np.ones(len(at), np.int64), label])
    pos = np.concatenate([np.where(zero == end[line], end_pos[line], 0), at_pos, pos])
    order = np.concatenate([zero, at, order])
    by = np.lexsort((order, slot))
    by = by[np.append((np.diff(slot[by]) != 0) | (np.diff(order[by]) != 0), [True] * bool(len(by)))]
    slot, order, label, pos = slot[by], order[by], label[by], pos[by]

    # A range goes on where the slice before is the line's number before, and no separator either.
    joined = (np.diff(slot) == 0) & (np.diff(order) == 1) & (label[1:] == 0) & (label[:-1] == 0)
    starts = np.flatnonzero((label == 0) & ~np.append([False], joined))
    stops = np.flatnonzero((label == 0) & ~np.append(joined, [False]))
    cuts = np.flatnonzero(label == 1)
    ends = np.flatnonzero(np.append(np.diff(slot) != 0, [True]))

    def listed(rows: np.ndarray, values: np.ndarray) -> pa.ListArray:
        offsets = np.searchsorted(slot[rows], np.arange(known.num_rows + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[rows], pa.int64()))

    return [
        listed(starts, order), listed(stops, order), listed(cuts, order), listed(cuts, pos),
        pa.array(order[ends], pa.int64()), pa.array(pos[ends], pa.int64()),
    ]


def fold_chunk(known: tuple | None, base: int, size: int, order: np.ndarray, label: np.ndarray, pos: np.ndarray) -> tuple:
    """What is known of a chunk of ``size`` numbers from ``base`` on, with new slices added.

    Returned are the ranges ``[first, last]`` of label-0 slices, the separators
    ``at`` with their positions, and the chunk's last slice. The result is the same in
    whatever order slices come and however often; of two labels for one slice the
    newer one stays.
    """
    if len(order) and not base <= min(order) <= max(order) < base + size:
        raise ValueError("slice outside of its chunk")
    row = known or ([], [], [], [], None, None)
    batch = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, list(CHUNKS)[2:])], schema=pa.schema(list(CHUNKS)[2:]))
    return tuple(c[0].as_py() for c in fold_chunks(batch, np.zeros(len(order), np.int64), order, label, pos))


def fold_bucket(known: pa.RecordBatch, new: pd.DataFrame) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """A bucket's chunks with the slices ``new`` added, and those of them that ``new`` touches.

    Of one slice that came twice in a batch, the separator stays.
    """
    new = new.sort_values(["__ord", "__label", "__pos"], kind="stable")
    slot, named = pd.factorize(pd.MultiIndex.from_frame(new[["__line", "chunk"]]))
    spots = {key: i for i, key in enumerate(named)}
    met = np.array([spots.get(k, -1) for k in zip(known.column("line").to_pylist(), known.column("chunk").to_pylist())], np.int64)
    # The touched chunks, known ones where their new slices point to.
    source = np.full(len(spots), -1, np.int64)
    source[met[met >= 0]] = np.flatnonzero(met >= 0)
    empty = pa.RecordBatch.from_pylist([{c: [] for c in LISTS}], schema=CHUNKS)
    base = pa.Table.from_batches([known, empty]).combine_chunks().take(pa.array(np.where(source < 0, known.num_rows, source)))
    base = base.combine_chunks().to_batches()[0]
    columns = fold_chunks(base, slot, *[new[c].to_numpy(np.int64) for c in ("__ord", "__label", "__pos")])
    lines, numbers = zip(*named)
    touched = pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array(numbers, pa.int64()), *columns], schema=CHUNKS)
    rest = known.filter(pa.array(met < 0, pa.bool_()))
    return pa.Table.from_batches([rest, touched]).combine_chunks().to_batches()[0], touched


def _packed(chunks: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, chunks.schema) as writer:
        writer.write_batch(chunks)
    return sink.getvalue().to_pybytes()


def _unpacked(known: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(known).read_next_batch()


def track_runs(
    stream: DataFrame, part: str | Sequence[str], order: str, label: str, pos: str, out: str, checkpoint: str, *,
    bits: int = CHUNK_BITS, buckets: int = BUCKETS, available_now: bool = True,
) -> StreamingQuery:
    """Keep what is known of each line in the table ``out``, as slices land.

    ``order`` is an integer, unique within ``part``; a slice without order or
    label has no place and is left out. The state is checkpointed with the
    stream, and each batch overwrites its own part of ``out``, so a batch that is run
    again leaves one copy. ``buckets``, like ``bits``, must stay the same for one ``checkpoint``; a bucket
    that no slice of a batch falls into costs no work, only its state.
    """
    part = as_list(part)
    rows = stream.where(F.col(order).isNotNull() & F.col(label).isNotNull()).select(
        F.to_json(F.struct(*part), KEY_JSON).alias("__line"), chunk_of(order, bits).cast("bigint").alias("chunk"),
        F.col(order).cast("bigint").alias("__ord"), (F.col(label) != 0).cast("int").alias("__label"),
        F.coalesce(F.col(pos).cast("bigint"), F.lit(0)).alias("__pos"),
    ).withColumn("__bucket", F.pmod(F.xxhash64("__line", "chunk"), F.lit(buckets)).cast("int"))
    lines = stream.select(*part).schema
    chunk_type = stream.select(chunk_of(order, bits).alias("chunk")).schema["chunk"].dataType
    result = T.StructType([T.StructField("__line", T.StringType()), T.StructField("chunk", T.LongType()), *KNOWN])

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = _unpacked(state.get[0]) if state.exists else pa.RecordBatch.from_pylist([], schema=CHUNKS)
        known, touched = fold_bucket(known, pd.concat(list(parts)))
        state.update((_packed(known),))
        yield touched.rename_columns([f.name for f in result]).to_pandas()

    folded = rows.groupBy("__bucket").applyInPandasWithState(fold, result, STATE, "update", GroupStateTimeout.NoTimeout)

    def append(batch: DataFrame, batch_id: int) -> None:
        line = F.from_json("__line", lines, KEY_JSON)
        named = batch.withColumn("__line", line).select(
            *[F.col("__line")[c].alias(c) for c in part], F.col("chunk").cast(chunk_type), *KNOWN.names
        )
        marked = named.withColumn("batch", F.lit(batch_id).cast("bigint"))
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    writer = folded.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def known_slices(known: DataFrame, part: str | Sequence[str]) -> DataFrame:
    """``part, ord, label, pos``: the newest state of each chunk as few slices that have the same spans.

    A range of label-0 slices is stood for by its first; only the position of a line's
    last slice can matter besides those of the separators.
    """
    part = as_list(part)
    fields = [*LISTS, "end", "end_pos"]
    newest = known.groupBy(*part, "chunk").agg(F.max_by(F.struct(*fields), "batch").alias("s"))
    ranges = F.transform(F.arrays_zip("s.first", "s.last"), lambda r: F.struct(
        r["first"].alias("ord"), F.lit(0).alias("label"),
        F.when(r["last"] == F.col("s.end"), F.col("s.end_pos")).otherwise(0).alias("pos"),
    ))
    cuts = F.transform(F.arrays_zip("s.at", "s.pos"), lambda c: F.struct(
        c["at"].alias("ord"), F.lit(1).alias("label"), c["pos"].alias("pos")
    ))
    return newest.select(*part, F.explode(F.concat(ranges, cuts)).alias("slice")).select(*part, "slice.*")


def current_spans(spark: SparkSession, out: str, part: str | Sequence[str], **options) -> DataFrame:
    """The spans of all slices that have landed so far, as :func:`char_spans` gives them for the same rows."""
    return char_spans(known_slices(spark.read.parquet(out), part), part, "ord", "label", "pos", **options)

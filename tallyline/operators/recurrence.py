"""Order-dependent recurrences (ratings, bankrolls) split over time.

Such a fold has no associative form, yet one key may hold a third of all rows.
Each key is cut into chunks of bounded size.  All chunks run in parallel from a
guessed start state; the end state of a chunk becomes the start of the next one.
Chunks whose start changed run once more.  A recurrence that forgets its start
(ratings) settles here; for one that does not (bankrolls), the chunks still
unsettled then run one by one in order.  A chunk runs at most three times, so
the rows processed stay in proportion to the table.  The result is the
sequential one.

Spark sorts the chunks; a worker reads them batch by batch and keeps the state only,
so its memory does not grow with a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyline.operators.scan import running
from tallyline.staging import stage

Step = Callable[[tuple, pd.DataFrame, dict], tuple[pd.DataFrame, dict]]


def cut_by_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_chunk: int) -> DataFrame:
    """Add ``chunk``: ``rows_per_chunk`` rows of a key in a row of its order, the last one fewer."""
    counted = running(df, keys, order, {"__before": ("count", F.lit(1))})
    return counted.withColumn("chunk", F.floor(F.col("__before") / rows_per_chunk).cast("int")).drop("__before")


def chunked_recurrence(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step,
                       out_schema: T.StructType, rows_per_chunk: int = 1_000_000,
                       tolerance: float = 1e-9) -> DataFrame:
    """Run ``step(key, rows, state) -> (output rows, end state)`` over each key in order.

    ``state`` is a dict name -> float; ``{}`` is the start of every key.  A chunk comes to
    ``step`` in several pieces, each with the end state of the one before it.
    """
    keys, order = list(keys), list(order)
    group = [*keys, "chunk"]
    types = {f.name: f.dataType for f in df.schema}
    state_schema = T.StructType([T.StructField(k, types[k]) for k in keys] + [
        T.StructField("chunk", T.IntegerType()), T.StructField("name", T.StringType()),
        T.StructField("value", T.DoubleType())])
    rows = stage(cut_by_rows(df, keys, order, rows_per_chunk), "recurrence")
    last_chunk = rows.agg(F.max("chunk")).first()[0] or 0

    # a chunk's start state and its rows in one stream: state rows have a name, and come first
    columns = list(rows.columns)
    arrow_out, arrow_state = to_arrow_schema(out_schema), to_arrow_schema(state_schema)

    def streamed(chosen: DataFrame, starts: DataFrame) -> DataFrame:
        tagged = chosen.withColumn("__start", F.lit(False)).unionByName(
            starts.select(*group, F.lit(True).alias("__start"), F.col("name").alias("__name"), F.col("value").alias("__value")),
            allowMissingColumns=True)
        return tagged.repartition(*group).sortWithinPartitions(
            *group, F.desc("__start"), *[F.asc_nulls_last(c) for c in order])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict, pd.DataFrame | None]]:
        """Each piece's output under its chunk, and every chunk's end state with no output; chunks without rows have neither."""
        chunk, state, seen = None, {}, False
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in group)))
            cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if names[low] != chunk:
                    if seen:
                        yield chunk, state, None
                    chunk, state, seen = names[low], {}, False
                piece = batch.slice(low, high - low)
                start = piece.filter(piece.column("__start"))
                state.update(zip(start.column("__name").to_pylist(), start.column("__value").to_pylist()))
                piece = piece.filter(pc.invert(piece.column("__start"))).select(columns)
                if piece.num_rows:
                    out, state = step(chunk[:-1], piece.to_pandas(), state)
                    seen = True
                    yield chunk, state, out
        if seen:
            yield chunk, state, None

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, out in folded(batches):
            if out is not None:
                yield pa.RecordBatch.from_pandas(out, arrow_out, preserve_index=False)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, end, out in folded(batches):
            if out is None:
                own = [[k] * len(end) for k in (*chunk[:-1], chunk[-1] + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((*own, list(end), list(end.values())), arrow_state)], schema=arrow_state)

    def passed(chosen: DataFrame, starts: DataFrame) -> DataFrame:
        return streamed(chosen, starts).mapInArrow(ends, state_schema)

    spark = df.sparkSession
    nothing = spark.createDataFrame([], state_schema)
    starts = stage(passed(rows.where(F.col("chunk") < last_chunk), nothing), "state") if last_chunk else nothing
    used = nothing
    for turn in range(last_chunk):
        # chunks whose start is not the one they ran with; after one more run of all, only the first of them is final
        both = starts.join(used.withColumnRenamed("value", "before"), [*group, "name"], "full").where(
            F.coalesce(F.abs(F.col("value") - F.col("before")) > tolerance, F.lit(True)))
        pending = both.where(F.col("chunk") < last_chunk).select(*group).distinct()
        if turn:
            first = pending.agg(F.min("chunk")).first()[0]
            pending = pending.where(F.col("chunk") == first)
        pending = stage(pending, "pending")
        if pending.isEmpty():
            break
        ran = stage(passed(rows.join(pending, group, "left_semi"), starts.join(pending, group, "left_semi")), "state")
        done = pending.withColumn("__done", F.lit(True))
        follows = pending.withColumn("chunk", F.col("chunk") + 1)
        used = stage(used.join(pending, group, "left_anti").unionByName(
            starts.join(done, group, "left_semi")), "state")
        starts = stage(starts.join(follows, group, "left_anti").unionByName(ran), "state")
    return streamed(rows, starts).mapInArrow(outputs, out_schema)

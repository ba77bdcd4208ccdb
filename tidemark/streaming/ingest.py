"""Streams of changes into a store, and a live view as a streaming aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.options import PUT
from tidemark.sources.store import Store


def ingest(stream: DataFrame, store: Store, order: list[str], checkpoint: str, name: str = "ingest", compact: bool = True) -> StreamingQuery:
    """Write stream(ukey, kt, value, order...) to the store, one commit a micro-batch.

    The commit also records the batch number, so a batch that runs again after a failure changes nothing. A micro-batch is
    the unit of group commit; compaction runs when a level is due, which is also what holds back the source.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.bulk_write(batch, order, {name: number})
            if compact:
                store.compact()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_view(stream: DataFrame, key: str, seq: str, kind: str, values: list[str]) -> DataFrame:
    """The newest version of each key as streaming state (output mode update or complete): key, seq, kt and values.

    The state answers the newest snapshot only; older ones are read from the store.
    """
    return stream.groupBy(key).agg(F.max(seq).alias(seq), *[F.max_by(c, seq).alias(c) for c in (kind, *values)])


def present(view: DataFrame, kind: str) -> DataFrame:
    return view.where(F.col(kind) == PUT).drop(kind)

"""Incremental indexing as a stream: each micro-batch of changed rows is upserted into a catalog's table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import upsert
from ..sources.catalog import Catalog


def upsert_stream(changes: DataFrame, catalog: Catalog, table: str, ddl: str, key: list[str], order: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """changes: a streaming DataFrame of the table's columns, `order` (the latest row of a key in a batch wins) and
    `deleted` (boolean). A batch that is replayed after a failure gives the same table."""

    def put(batch: DataFrame, _: int) -> None:
        now = catalog.table(table, ddl)
        rest = [c for c in batch.columns if c not in key]
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])
        gone = last.filter("deleted").select(*key)
        kept = now.join(gone, key, "left_anti").select(*now.columns)
        catalog.commit({table: upsert(kept, last.filter("not deleted").select(*now.columns), key)})

    w = changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()

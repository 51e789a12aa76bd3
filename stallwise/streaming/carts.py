"""Cart lines priced as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from stallwise.operators.catalog import store_discount
from stallwise.operators.orders import price_cart
from stallwise.streaming.sinks import started


def start_priced_carts(
    lines: DataFrame, products: Callable[[], DataFrame], settings: Callable[[], DataFrame], out: str, checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the priced lines of a stream of (order_id, pos, product_id, qty_raw).

    ``products`` and ``settings`` read their tables; they are called for every micro-batch, so that a new
    price or store discount counts from the next one on. A repeated batch overwrites its own folder. The catalogue is not broadcast:
    it would pass through the driver with every micro-batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        priced = price_cart(batch, products().hint("merge"), store_discount(settings()))
        priced.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return started(lines.writeStream.foreachBatch(write), checkpoint, trigger)

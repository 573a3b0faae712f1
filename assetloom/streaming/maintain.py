"""A manifest maintained from micro-batches of desired entries; every batch is a diff against the entries it may touch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.operators.tables import keep_last_by
from assetloom.sources import snapshots

_REMOVED = "__removed"


def maintain(path: str, key: str = "name", checksum: str = "source_checksum", order: str = "seen_at", removed: str | None = None, parts: int = 64) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: upserts a batch into the manifest below ``path``.

    Entries are dealt to ``parts`` by a hash of the key. A batch reads and writes anew only the parts that its keys fall
    into, each in a folder of that part and batch; then the list of the folders that count is replaced by a rename, so
    readers see all of a batch or nothing of it, and the folders that it supersedes are removed once the next batch has
    replaced the list (whoever reads has until then). Disk stays within two states of a part.

    Of a key the row with the largest ``order`` counts, over all batches: late rows lose, rows without an order lose to any
    that has one. An equal order is the later batch's (within a batch, the larger checksum's), so a batch that is run again
    changes nothing. A row whose column ``removed`` is true removes its key; its place in the order is kept, so that late
    rows don't bring it back. Rows with a null key are no entries: they go to ``path``/rejected by batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        gone = F.coalesce(F.col(removed), F.lit(False)) if removed else F.lit(False)
        rows = batch.withColumn(_REMOVED, gone).withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        bad = rows.filter(F.col(key).isNull())
        if not bad.isEmpty():
            bad.drop("__part", _REMOVED).write.mode("overwrite").parquet(f"{path}/rejected/batch={batch_id}")
        rows = rows.filter(F.col(key).isNotNull())
        touched = sorted(r[0] for r in rows.select("__part").distinct().collect())  # at most ``parts`` numbers
        if not touched:
            return
        listed = _listed(spark, path)
        ranked = rows.withColumn("__batch", F.lit(batch_id).cast("long"))
        old = [listed["parts"][str(p)] for p in touched if str(p) in listed["parts"]]
        if old:
            was = spark.read.parquet(*[f"{path}/{f}" for f in old])
            ranked = ranked.unionByName(was.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), allowMissingColumns=True)
        # one diff by key: a row wins by its order, then by its batch
        out = keep_last_by(ranked, [key], [order, "__batch", checksum])
        name = f"batch-{batch_id}-{listed['next']}"
        out.repartition("__part").write.mode("overwrite").partitionBy("__part").parquet(f"{path}/{name}")
        new = {str(p): f"{name}/__part={p}" for p in touched}
        superseded = sorted({f for p, f in listed["parts"].items() if p in new})
        _publish(spark, path, {"next": listed["next"] + 1, "parts": listed["parts"] | new, "old": superseded})
        for f in listed["old"]:
            snapshots.remove(spark, f"{path}/{f}")

    return run


def _listed(spark: SparkSession, path: str) -> dict:
    """Which folder each part is read from: a line for each part, small whatever the manifest holds."""
    text = snapshots.current(spark, path)
    return json.loads(text) if text else {"next": 0, "parts": {}, "old": []}


def _publish(spark: SparkSession, path: str, listed: dict) -> None:
    snapshots.publish(spark, path, json.dumps(listed), clear=False)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifest as the last batch left it, or None before the first."""
    found = sorted(_listed(spark, path)["parts"].values())
    if not found:
        return None
    return spark.read.parquet(*[f"{path}/{f}" for f in found]).filter(~F.col(_REMOVED)).drop(_REMOVED, "__batch")

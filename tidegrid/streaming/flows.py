"""The flow analyzer as streams: the same states as in batch, late samples bounded by a watermark."""

from __future__ import annotations

import json
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidegrid.operators import catalog
from tidegrid.operators import flows as batch


def read_events(spark: SparkSession, folder: str, schema, names: str = "*.parquet") -> DataFrame:
    """A folder's event files as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", names).parquet(folder)


def flow_state(events: DataFrame, key: str = "user_id", at: str = "ts", tie: str = "event_id", value: str = "value") -> DataFrame:
    """First and last seen, samples, the counter's change and activity of each key so far; for update or complete mode, or a batch.

    A key's state is kept for good, as its first sample counts: keys must be bounded (sockets of a site, say). For keys that
    come and go use sessions(), whose watermark drops them.
    """
    order = F.struct(at, tie)
    g = events.groupBy(key).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("samples"), F.min_by(value, order).alias("a"), F.max_by(value, order).alias("b"))
    activity = F.when(F.col("b") > F.col("a"), "DATA_OBSERVED").when(F.col("b") == F.col("a"), "NO_DATA_OBSERVED").otherwise("UNKNOWN")
    return g.select(key, "first_at", "last_at", "samples", F.when(F.col("b") >= F.col("a"), F.round(F.col("b") - F.col("a"), 4)).alias("delta"), activity.alias("activity"))


def sessions(events: DataFrame, key: str, at: str, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Stretches of events of a key without a longer gap; samples later than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def attributed(flows: DataFrame, peers: DataFrame, late: str = "10 minutes", slack: str = "1 minute") -> DataFrame:
    """Stream-stream join: a flow's samples with observations of the reversed tuple within the slack of them."""
    f = flows.withWatermark("at", late).alias("f")
    p = peers.withWatermark("at", late).alias("p")
    return f.join(p, F.expr(f"f.local_ip = p.peer_ip and f.local_port = p.peer_port and f.peer_ip = p.local_ip and f.peer_port = p.local_port and p.at between f.at - interval {slack} and f.at + interval {slack}"))


BUFFER_STATE = "state string"


def buffered(events: DataFrame, observations: int = batch.MOST_OBSERVATIONS, flows: int = batch.MOST_FLOWS, sockets: int = batch.MOST_SOCKETS, late: str = "10 minutes", idle: str = "1 hour") -> DataFrame:
    """operators.flows.buffered_matches() as a stream, in append mode: a check's state is its last observations, and the cursors of the connections it follows.

    Events of a check must come in order of (at, seq) from one micro-batch to the next. The state has at most observations
    tuples with their numbers and refs, flows cursors and one frame's count; it is
    dropped when the watermark is idle past the check's last event. A restarted stream goes on at the cursors.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    ref = events.schema["ref"].dataType.simpleString()

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {"n": 0, "kept": [], "cursors": [], "frames": {}, "over": []}
        kept = deque((tuple(t), n, other) for t, n, other in held["kept"])
        index: dict[tuple, deque] = defaultdict(deque)
        for t, n, other in kept:
            index[t].append((n, other))
        cursors, over, count, n, out, last = {tuple(k): (n, c) for k, n, c in held["cursors"]}, {tuple(k) for k in held["over"]}, held["frames"], held["n"], [], 0
        rows = pd.concat(list(frames)).sort_values(["at", "seq"], kind="stable")
        last = int(rows["at"].max().timestamp() * 1000)
        for x in rows.itertuples(index=False):
            own, back = (x.local_ip, int(x.local_port), x.peer_ip, int(x.peer_port), x.protocol), (x.peer_ip, int(x.peer_port), x.local_ip, int(x.local_port), x.protocol)
            other_ref = None if pd.isna(x.ref) else x.ref.item() if hasattr(x.ref, "item") else x.ref
            if x.kind == "peer":
                frame = str(x.frame)
                count = {frame: count.get(frame, 0) + 1}  # frames of a check come one after the other
                if count[frame] > sockets:
                    out.append((key[0], other_ref, None, None, "socket left out"))
                    continue
                if len(kept) >= observations:
                    old, _, _ = kept.popleft()
                    index[old].popleft()
                    if not index[old]:
                        del index[old]
                n += 1
                kept.append((own, n, other_ref))
                index[own].append((n, other_ref))
            elif own in cursors or len(cursors) < flows:
                context = None if pd.isna(x.context) else str(x.context)
                seen, before = cursors.get(own, (0, context))
                low = seen if before == context else 0
                out += [(key[0], other_ref, other, k, "seen") for k, other in index.get(back, ()) if k > low]
                cursors[own] = (n, context)
            elif own not in over:
                over.add(own)
                out.append((key[0], other_ref, None, None, "flow left out"))
        state.update((json.dumps({"n": n, "kept": list(kept), "cursors": [(k, *v) for k, v in cursors.items()], "frames": count, "over": sorted(over)}),))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["check", "ref", "other", "n", "status"]).astype({"n": "Int64"})

    kind = events.schema["check"].dataType.simpleString()
    timed = events.withWatermark("at", late)
    return timed.groupBy("check").applyInPandasWithState(step, f"check {kind}, ref {ref}, other {ref}, n long, status string", BUFFER_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_once(df: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything that is there and stop; what was processed is remembered in checkpoint."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(availableNow=True).start()
    q.awaitTermination()


def import_once(root: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that writes a snapshot's rows unless one of the same content was written before."""

    def handle(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        content = catalog.snapshot_hash(batch)
        spark = batch.sparkSession
        path = f"{root}/{content.replace(':', '-')}"
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            batch.write.mode("overwrite").parquet(path)

    return handle

"""The bounded buffer of observations: plain Python, batch and stream agree, also after a restart."""

from __future__ import annotations

import random
from collections import deque
from datetime import datetime, timedelta

from tidegrid.operators import flows
from tidegrid.streaming import flows as streams

EVENTS = "check string, at timestamp, seq long, kind string, frame long, local_ip string, local_port int, peer_ip string, peer_port int, protocol string, context string, ref long"


def made(seed, n=400):
    r, out = random.Random(seed), []
    for i in range(n):
        check, kind = r.choice(["a", "b"]), r.choice(["peer", "peer", "flow"])
        here, there = ("10.0.0.1", r.choice([80, 81])), ("10.0.0.2", 5000 + r.randrange(4))
        (lip, lport), (pip, pport) = (here, there) if kind == "flow" else (there, here)
        out.append((check, datetime(2024, 1, 1) + timedelta(seconds=i), i, kind, i // 20 if kind == "peer" else None, lip, lport, pip, pport, "tcp", r.choice(["v1", "v1", "v1", "v2"]) if kind == "flow" else None, i))
    return out


def brute(events, observations, most_flows, sockets):
    out, checks = [], {}
    for check, _, _, kind, frame, lip, lp, pip, pp, proto, context, ref in sorted(events, key=lambda e: (e[1], e[2])):
        kept, cursors, over, frames, total = checks.setdefault(check, (deque(), {}, set(), {}, [0]))
        if kind == "peer":
            frames[frame] = frames.get(frame, 0) + 1
            if frames[frame] > sockets:
                out.append((check, ref, None, None, "socket left out"))
                continue
            total[0] += 1
            kept.append((total[0], (lip, lp, pip, pp, proto), ref))
            if len(kept) > observations:
                kept.popleft()
        else:
            key = (lip, lp, pip, pp, proto)
            if key not in cursors and len(cursors) >= most_flows:
                if key not in over:
                    over.add(key)
                    out.append((check, ref, None, None, "flow left out"))
                continue
            seen, before = cursors.get(key, (0, context))
            out += [(check, ref, o, n, "seen") for n, k, o in kept if k == (pip, pp, lip, lp, proto) and n > (seen if before == context else 0)]
            cursors[key] = (total[0], context)
    return sorted(out, key=str)


def test_batch(spark):
    for seed, limits in ((1, (2000, 100, 400)), (2, (15, 5, 6))):
        events = made(seed)
        got = flows.buffered_matches(spark.createDataFrame(events, EVENTS).repartition(3), *limits).collect()
        assert sorted(map(tuple, got), key=str) == brute(events, *limits)


def test_stream_and_restart(spark, tmp_path):
    """Events that come in three files, the stream stopped after each: the same rows as in one batch, and a state that stays small."""
    events, limits = made(3, 600), (15, 5, 6)
    rows = []
    for k in range(3):
        spark.createDataFrame(events[200 * k : 200 * (k + 1)], EVENTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = streams.buffered(streams.read_events(spark, f"file://{tmp_path}/in", EVENTS), *limits)
        streams.run_once(stream, f"file://{tmp_path}/check", lambda df, i: rows.extend(map(tuple, df.collect())))
    assert sorted(rows, key=str) == brute(events, *limits)
    batch = flows.buffered_matches(spark.createDataFrame(events, EVENTS), *limits).collect()
    assert sorted(rows, key=str) == sorted(map(tuple, batch), key=str)

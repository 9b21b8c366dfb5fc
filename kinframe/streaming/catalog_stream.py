"""Streams: catalog upserts by micro-batch, stateful fingerprints, recent duplicates of arrivals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinframe.functions import audio
from kinframe.operators import catalog as C


def upsert_stream(changes: DataFrame, path: str, checkpoint: str, key: str = "path", version: str = "version", trigger: dict | None = None):
    """Starts a query that keeps appending arrivals to the catalog at ``path``; readers take the latest of each key.

    A batch is written under its number, so a batch that is run again replaces itself. Of a key's rows of one version in a
    batch the one that is greatest in all its columns stays, as in compact().
    """

    def write(batch: DataFrame, number: int) -> None:
        C.compact(batch, batch.limit(0), key, version).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(batches: DataFrame, key: str = "path", version: str = "version") -> DataFrame:
    return C.compact(batches, batches.limit(0), key, version)


def arrivals_per_window(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Arrivals a window and kind, with late rows dropped after the watermark; works on streams and tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def fingerprint_stream(chunks: DataFrame, key: str = "path") -> DataFrame:
    """(key, second, fp) from a stream of (key, seq, pcm): samples that a frame still needs are carried in state."""
    schema = f"{key} string, second long, fp long"
    state_schema = "carry binary, at long, chroma binary, second long, votes binary"

    def feed(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        carry, at, past, second, votes = state.get if state.exists else (b"", 0, b"", 0, b"")
        rows = pd.concat(list(batches)).sort_values("seq")
        samples = np.frombuffer(carry + b"".join(rows["pcm"]), dtype="<i2")
        chroma, ballots, out = np.frombuffer(past, dtype=np.float64).reshape(-1, audio.NOTES), list(np.frombuffer(votes, dtype=np.int64)), []
        n = max(0, (len(samples) - audio.FRAME) // audio.HOP + 1)
        if n:
            frames = np.lib.stride_tricks.sliding_window_view(samples / audio.SCALE, audio.FRAME)[np.arange(n) * audio.HOP]
            chroma = np.concatenate([chroma, audio.chroma(frames)])
            fresh = audio.bits(audio.normalised(audio.smoothed(chroma)))
            starts = at + np.arange(n)[n - len(fresh) :] * audio.HOP
            for s, v in zip((starts // audio.RATE).tolist(), fresh.tolist()):
                while s > second:
                    out.append((k[0], second, audio.majority(np.array(ballots, dtype=np.int64))))
                    second, ballots = second + 1, []
                ballots.append(v)
            chroma = chroma[-(len(audio.TAPS) - 1) :]
        state.update((samples[n * audio.HOP :].tobytes(), at + n * audio.HOP, chroma.tobytes(), second, np.array(ballots, dtype=np.int64).tobytes()))
        yield pd.DataFrame(out, columns=[key, "second", "fp"])

    return chunks.groupBy(key).applyInPandasWithState(feed, schema, state_schema, "append", GroupStateTimeout.NoTimeout)

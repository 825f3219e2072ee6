"""Jobs and their completions as two streams: one keyed state that takes a job out when it is done, and releases in order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .entries import BLOB, GROUP, KEY_NAME, Entries, Keys, entry_map, group_of, state_name

RELEASED = "video_id string, chain_i long, out string, done_at long, released_at long"
COLUMNS = ("is_job", "key", "chain_i", "out", "done_at")


class JobLookup(StatefulProcessor):
    """Of each video of a group: the jobs that are open, completions that came before their job, jobs done that wait for
    others before them, and the next to be released."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.videos = handle.getValueState("videos", BLOB)
        self.maps = [entry_map(handle, name) for name in ("open", "early", "done")]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        videos = Keys(self.videos)
        for batch in rows:
            batch = batch.set_axis([GROUP, KEY_NAME, *COLUMNS], axis=1).sort_values(KEY_NAME, kind="stable")  # Spark loses names
            plain = [batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in (KEY_NAME, *COLUMNS)]
            out: list[tuple] = []
            for video, here in groupby(zip(*plain, strict=True), key=itemgetter(0)):
                name = state_name(video)
                number, latest, *entries = videos.get(name, (0, None, None, None, None))
                opened, early, done = (Entries(name, rest, x) for rest, x in zip(self.maps, entries, strict=True))
                for _, is_job, job, chain, path, time in here:
                    self._take(opened, early, done, job, (int(chain), path) if is_job else None, None if is_job else int(time))
                    while (found := done.pop(number)) is not None:
                        path, time = found
                        latest = time if latest is None else max(latest, time)
                        out.append((video, number, path, time, latest))
                        number += 1
                videos.put(name, number, latest, opened.held(), early.held(), done.held())
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RELEASED.split(", ")])
        videos.save()

    def _take(self, opened: Entries, early: Entries, done: Entries, name: str, job: tuple | None, time: int | None) -> None:
        """A job meets its completion, or waits for it, and the other way round."""
        mine, others = (early, opened) if job else (opened, early)
        found = mine.pop(name)
        if found is None:
            if name not in others:
                others.put(name, job or (time,))
            return
        (chain, path), done_at = (job, found[0]) if job else (found, time)
        done.put(chain, (path, done_at))

    def close(self) -> None:
        pass


def release_done(jobs: DataFrame, completions: DataFrame) -> DataFrame:
    """What patching.completed() and release_order() tell, of streams: (video_id, chain_i, out, done_at, released_at).

    jobs has video_id, chain_i (from 0 without gaps in a video), key and out; completions has video_id, key and done_at. A
    job is taken out of the open ones when its completion comes, and is released once all before it are. A completion that
    comes before its job waits for it; one that no job comes for is never told. If a key is told twice while it is waited
    for, the first to come counts. Any cut of either stream into batches gives the same rows.
    """
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    rows = jobs.select("video_id", F.lit(True).alias("is_job"), "key", "chain_i", "out", number.alias("done_at"))
    rows = rows.unionAll(completions.select("video_id", F.lit(False), "key", number, text, "done_at"))
    video = F.col("video_id").cast("string")
    found = rows.select(group_of(video).alias(GROUP), video.alias(KEY_NAME), *COLUMNS).groupBy(GROUP)
    out = found.transformWithStateInPandas(JobLookup(), outputStructType=RELEASED, outputMode="Append", timeMode="None")
    return out.withColumn("video_id", F.col("video_id").cast(jobs.schema["video_id"].dataType))

"""The matcher's log: its lines, what they say, and the coloured ranges of a timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.order import CHUNK, running_max
from ..sources.staging import stage_table

#: Colours of a timeline and their ranks where ranges overlap (fixed values).
PRIORITY = {"replaced": 5, "additional": 4, "failed": 3, "skipped": 2, "duplicate": 1}
#: The names of the matcher's states in its log (fixed values).
STATES = {"Find": "FindDuplicate", "Compensate": "CompensateMotion", "Failed": "FailedCompensate"}


def log_lines(steps: DataFrame) -> DataFrame:
    """The lines that a run writes: duplicates and skipped runs at debug level, chains at info level.

    A chain goes from the frame before its first duplicate to its last frame; a skipped run's line names the frame that
    ended it. A chain's diff is the hash distance of the pair before the one that ended it, end_conf how distinct that
    one was, and the time is that of its first frame.
    """
    frame, length, outcome, state = F.col("frame_num"), F.col("len"), F.col("outcome"), F.col("state")
    number = lambda c: c.cast("string")
    named = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))[state]
    named = F.when(state == "Compensate", F.concat(named, F.lit(" { n_additional: "), number(F.col("n_additional")), F.lit(" }"))).otherwise(named)
    found = F.when(outcome == "FailDuplicate", F.concat(F.lit("Found duplicate at #"), number(frame)))
    given_up = (outcome.isin("FailLong", "FailTooMuchMotion") & (state != "Compensate")) | ((outcome == "CompensationRequired") & (state == "Failed"))
    skip = F.when(given_up, F.concat(F.lit("Skipping duplicate chain #"), number(frame - length), F.lit("-#"), number(frame), F.lit(": #"), outcome, F.lit(", state: "), named))
    told = [
        ("Duplicate chain ", number(F.col("chain_i"))), (" found #", number(frame - length)), ("-#", number(frame - 1)), (", length: ", number(length)),
        (", diff: ", T.fixed(F.coalesce("diff", F.lit(0.0)), 4)), (", end_conf: ", T.fixed(F.col("end_conf"), 4)), (", chain_motion: ", T.fixed(F.col("chain_motion"), 4)),
        (", state: ", named), (" at ", T.fixed(F.get("timestamps", F.lit(0)), 3)), ("s", F.lit("")),
    ]
    chain = F.when(outcome == "Ok", F.concat(*(x for text, value in told for x in (F.lit(text), value))))
    level = F.when(outcome == "Ok", "INFO").otherwise("DEBUG")
    out = steps.select("video_id", "step", T.log_line(level, F.coalesce(chain, found, skip)).alias("line"))
    return out.where("line IS NOT NULL")


def parse_log(lines: DataFrame) -> DataFrame:
    """What each line says: kind, frame, chain_i, start, end, length, diff, end_conf, chain_motion, state, n_additional,
    at_s, result."""
    x = F.col("line")
    chain, skip, dup = F.regexp_like(x, F.lit(T.CHAIN)), F.regexp_like(x, F.lit(T.SKIPPED)), F.regexp_like(x, F.lit(T.DUPLICATE))
    kind = F.when(chain, "chain").when(skip, "skipped").when(dup, "duplicate")
    number = lambda p, n, kind="long": T.group(x, p, n).cast(kind)
    out = lines.select(
        "video_id", "step", kind.alias("kind"), number(T.DUPLICATE, 1).alias("frame"), number(T.CHAIN, 1).alias("chain_i"), F.coalesce(number(T.CHAIN, 2), number(T.SKIPPED, 1)).alias("start"),
        F.coalesce(number(T.CHAIN, 3), number(T.SKIPPED, 2)).alias("end"), number(T.CHAIN, 4).alias("length"), number(T.CHAIN, 5, "double").alias("diff"), number(T.CHAIN, 6, "double").alias("end_conf"),
        number(T.CHAIN, 7, "double").alias("chain_motion"), F.coalesce(T.group(x, T.CHAIN, 8), T.group(x, T.SKIPPED, 4)).alias("state"), number(T.CHAIN, 9).alias("n_additional"),
        number(T.CHAIN, 10, "double").alias("at_s"), T.group(x, T.SKIPPED, 3).alias("result"),
    )
    return out.where("kind IS NOT NULL")


def painted_ranges(parsed: DataFrame) -> DataFrame:
    """Half-open ranges (video_id, start, stop, color).

    A chain is painted from the frame after its first on: those that were replaced, in a colour of their own after a
    failed compensation, then those that were added for motion, whose last frame stays out. A skipped run is painted from
    the frame after its first to the one before it ended.
    """
    rng = lambda start, stop, color: F.struct(start.alias("start"), stop.alias("stop"), color.alias("color"))
    frame, start, end = F.col("frame"), F.col("start"), F.col("end")
    added = start + F.col("length") - F.coalesce("n_additional", F.lit(0))
    color = F.when(F.startswith("state", F.lit("FailedCompensate")), "failed").otherwise("replaced")
    own = F.when(F.col("kind") == "duplicate", rng(frame, frame + 1, F.col("kind"))).when(F.col("kind") == "skipped", rng(start + 1, end, F.col("kind"))).otherwise(rng(start + 1, added, color))
    more = F.when(F.col("n_additional") > 0, rng(added, end, F.lit("additional")))
    return parsed.select("video_id", F.inline(F.array(own, more))).where("start < stop")


def painted_frames(ranges: DataFrame) -> DataFrame:
    """The colour of each painted frame: that of the highest rank."""
    rank = F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair))
    rows = ranges.select("video_id", "color", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("frame_num"))
    return rows.groupBy("video_id", "frame_num").agg(F.max_by("color", rank[F.col("color")]).alias("color"))


def color_ranges(painted: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """Runs of frames of one colour as half-open ranges. Without chunks, in one pass by video; with chunks, what is painted
    is staged, as each frame looks at the one before it by a join."""
    if chunk is None:
        w = W.partitionBy("video_id").orderBy("frame_num")
        goes_on = (F.lag("frame_num").over(w) == F.col("frame_num") - 1) & (F.lag("color").over(w) == F.col("color"))
        rows = painted.withColumn("goes_on", F.when(goes_on, True))
    else:
        painted = stage_table(painted)
        before = painted.select("video_id", (F.col("frame_num") + 1).alias("frame_num"), "color", F.lit(True).alias("goes_on"))
        rows = painted.join(before, ["video_id", "frame_num", "color"], "left")
    rows = running_max(rows, "video_id", "frame_num", F.when(F.col("goes_on").isNull(), F.col("frame_num")), "start", chunk=chunk)
    return rows.groupBy("video_id", "color", "start").agg((F.max("frame_num") + 1).alias("stop"))


def clip_ranges(ranges: DataFrame, center: int, fps: float, total: int, seconds: int = 6) -> DataFrame:
    """Ranges that reach into the window of some seconds around a frame, cut to it and counted from its start."""
    low, high = max(0, int(center - fps * seconds)), min(total, int(center + fps * seconds))
    inside = ranges.where((F.col("stop") > low) & (F.col("start") < high))
    return inside.select("video_id", "color", (F.greatest("start", F.lit(low)) - low).alias("start"), (F.least("stop", F.lit(high)) - low).alias("stop"))

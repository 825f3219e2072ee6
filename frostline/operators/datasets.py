"""Training sets from groups of near-duplicate images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pixels import above_floor, magnitude
from ..sources.order import order_key
from .batches import global_order


def variation_groups(images: DataFrame) -> DataFrame:
    """The variations of each frame of a segment, in path order; images has segment, frame_num, path."""
    return images.groupBy("segment", "frame_num").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def adjacent_groups(groups: DataFrame) -> DataFrame:
    """Groups of frames that follow each other in a segment."""
    a = groups.select("segment", (F.col("frame_num") + 1).alias("frame_num"), F.col("paths").alias("before"))
    return groups.withColumnRenamed("paths", "after").join(a, ["segment", "frame_num"]).select("segment", "frame_num", "before", "after")


def skipped_segments(groups: DataFrame) -> DataFrame:
    """(segment, n): segments without adjacent groups, which give no sample, and how many groups they have."""
    used = adjacent_groups(groups).select(F.col("segment").alias("_s")).distinct()
    alone = groups.join(used, F.col("segment").eqNullSafe(F.col("_s")), "left_anti")
    return alone.groupBy("segment").agg(F.count("*").alias("n"))


def same_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs within each side of adjacent groups, and the first before-image with itself; a frame in the middle gives
    its pairs twice, once for each neighbour."""

    def inside(side: str) -> DataFrame:
        at = pairs.select("segment", "frame_num", F.col(side).alias("side"), F.posexplode(side).alias("i", "before"))
        rest = F.slice("side", F.col("i") + 2, F.greatest(F.size("side") - F.col("i") - 1, F.lit(0)))
        return at.select("segment", "frame_num", "before", F.explode(rest).alias("after"))

    own = pairs.select("segment", "frame_num", F.col("before")[0].alias("before"), F.col("before")[0].alias("after"))
    return inside("before").unionAll(inside("after")).unionAll(own)


def cross_pairs(pairs: DataFrame, seed: int) -> DataFrame:
    """Pairs across adjacent groups, a random choice of as many as they have same-pairs."""
    n, m = F.size("before"), F.size("after")
    most = ((n * (n - 1) + m * (m - 1)) / 2 + 1).cast("long")
    all_ = pairs.withColumn("most", most).select("segment", "frame_num", "most", F.col("after").alias("afters"), F.explode("before").alias("before"))
    all_ = all_.select("segment", "frame_num", "most", "before", F.explode("afters").alias("after"))
    place = F.row_number().over(W.partitionBy("segment", "frame_num").orderBy(order_key(F.col("before"), F.col("after"), seed=seed)))
    return all_.withColumn("place", place).where("place <= most").drop("place", "most")


def samples(pairs: DataFrame, seed: int = 1337) -> DataFrame:
    """(before, after, different) of adjacent groups; a bag."""
    same = same_pairs(pairs).select("before", "after", F.lit(False).alias("different"))
    return same.unionAll(cross_pairs(pairs, seed).select("before", "after", F.lit(True).alias("different")))


def train_validation(rows: DataFrame, key: str, share: float = 0.25, seed: int = 42) -> DataFrame:
    """rows with is_validation: exactly the first share of them, rounded down, in a random order of keys.

    The place of the cut is found in a histogram of the order, then among the keys of the one of its 65,536 buckets that it
    falls into. Where it falls between the rows of one key, those get places of their own; rows alike are told apart then.
    rows has to give the same rows each time it is read. Two rows reach the driver.
    """
    keyed = rows.select(F.struct(*(rows[c] for c in rows.columns)).alias("_row"), order_key(rows[key].cast("string"), seed=seed).alias("_order"))
    keyed = keyed.withColumn("_bucket", F.substring("_order", 1, 4))
    total = F.sum("n").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    held = keyed.groupBy("_bucket").agg(F.count("*").alias("n"))
    held = held.withColumns({"upto": F.sum("n").over(W.orderBy("_bucket")), "wanted": F.floor(total * share).cast("long")})
    edge = held.where("upto > wanted").orderBy("_bucket").first()
    if edge is None:  # all of them, or none at all
        return rows.withColumn("is_validation", F.lit(True))
    near = keyed.where(F.col("_bucket") == edge["_bucket"])
    by_key = near.groupBy("_order").agg(F.count("*").alias("n"))
    more = edge["wanted"] - edge["upto"] + edge["n"]
    last = by_key.withColumn("upto", F.sum("n").over(W.orderBy("_order"))).where(F.col("upto") > more).orderBy("_order").first()
    inside = F.col("_order") < last["_order"]
    left = more - last["upto"] + last["n"]  # rows of the key that the cut falls into
    if not left:
        return keyed.select("_row.*", inside.alias("is_validation"))
    others = keyed.where(F.col("_order") != last["_order"]).select("_row", inside.alias("is_validation"))
    cut = keyed.where(F.col("_order") == last["_order"]).select("_row", F.xxhash64("_row").alias("_hash"))
    cut = global_order(cut, "_hash", seed=seed).select("_row", (F.col("place") < left).alias("is_validation"))
    return others.unionAll(cut).select("_row.*", "is_validation")


def flow_means(flow: DataFrame, *keys: str) -> DataFrame:
    """avg_flow_x, avg_flow_y and motion of flow vectors (x, y) by keys: motion is the mean magnitude above a floor of
    0.2, less a ten-thousandth."""
    above = above_floor(magnitude(F.col("x"), F.col("y")))
    out = flow.groupBy(*keys).agg(F.avg("x").alias("avg_flow_x"), F.avg("y").alias("avg_flow_y"), F.avg(above).alias("m"))
    return out.select(*keys, "avg_flow_x", "avg_flow_y", (F.greatest("m", F.lit(1e-4)) - 1e-4).alias("motion"))


def segment_plan(videos: DataFrame, duration: float, most: int, every: float) -> DataFrame:
    """Evenly spaced segments of each video that is long enough; videos has video_id and duration_s."""
    n = F.least(F.lit(most), (F.floor((F.col("duration_s") - duration) / every) + 1).cast("int"))
    rows = videos.withColumn("n", n).where("n > 0").withColumn("gap", (F.col("duration_s") - F.col("n") * duration) / (F.col("n") + 1))
    rows = rows.select("video_id", "n", "gap", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return rows.select("video_id", "i", (F.col("gap") * (F.col("i") + 1) + F.col("i") * duration).alias("start_s"))


def variations(images: DataFrame, n: int = 3, noise: float = 4.0, seed: int = 5) -> DataFrame:
    """n seeded variations of each thumbnail (path, thumb): noise and an offset, kept within 0 to 255; 2 % pass
    unchanged. Names are those of augmented images."""
    rows = images.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    unit = lambda what, at: F.pmod(F.xxhash64(F.col("path"), F.col("i"), F.lit(what), at, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    offset = (unit("offset", F.lit(0)) - 0.5) * 2 * noise
    noisy = F.transform("thumb", lambda x, at: F.least(F.lit(255.0), F.greatest(F.lit(0.0), x + offset + (unit("noise", at) - 0.5) * 2 * noise)))
    out = F.when(unit("pass", F.lit(0)) < 0.02, F.transform("thumb", lambda x: x.cast("double"))).otherwise(noisy)
    return rows.select(F.format_string("%s_%d.png", "path", "i").alias("path"), out.alias("thumb"))

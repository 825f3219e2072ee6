"""The registered queries of the frame-sequence operators, over the tables that stand in for video."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import losses as L
from ..functions import pixels as P
from ..functions import text as T
from ..operators import datasets, faults, logs, matcher, patching, scoring, sequences
from ..sources import frames as S
from ..sources.order import chunk_for
from ..sources.staging import as_stream, run_stream, state_store
from ..streaming import matching

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
GATE, BITS = 0.45, 63
STATE_PARTITIONS = 8  # for the few videos of the test tables


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _state_partitions(spark: SparkSession) -> int:
    """Parts of a stream's state: a core each, where there are more than a few."""
    return max(STATE_PARTITIONS, spark.sparkContext.defaultParallelism)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores, for work that takes far longer than reading: a file may be one task otherwise."""
    return rows.repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism))


def _chunk(spark: SparkSession, sf_dir: str) -> int | None:
    """The size of chunks if a video is so long that it needs them."""
    return chunk_for(_read(spark, sf_dir, "events"), "user_id")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.event_scores(_read(spark, sf_dir, "events"), chunk=_chunk(spark, sf_dir))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.event_frames(_read(spark, sf_dir, "events"), chunk=_chunk(spark, sf_dir))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.simple_chains(_scores(spark, sf_dir), chunk=_chunk(spark, sf_dir))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matcher.match_steps(S.event_scores(_read(spark, sf_dir, "events")))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pair_scores(sequences.neighbours(S.thumbnails(_read(spark, sf_dir, "embeddings"))), BITS, GATE)


def _lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.inject_lags(_frames(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n_frames")))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    images = docs.select(F.col("source").alias("segment"), F.expr("doc_id div 40").alias("frame_num"), F.concat("source", F.lit("/"), T.frame_name(F.col("doc_id"))).alias("path"))
    return datasets.variation_groups(images)


def _joined(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


@_query
def duplicate_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.duplicate_frames(_scores(spark, sf_dir)).select("video_id", "frame_num", F.round("motion", 6).alias("motion"))


@_query
def simple_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir).select("video_id", "chain_i", _joined("frames"), "end_frame", F.round("chain_motion", 6).alias("chain_motion"))


@_query
def frame_pairs_lag12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.lagged_pairs(_frames(spark, sf_dir)).withColumn("motion", F.round("motion", 6))


@_query
def luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    thumbs = S.thumbnails(_read(spark, sf_dir, "embeddings"))
    return thumbs.select("frame_num", F.array_join(P.grayscale(F.transform("thumb", P.to_byte)).cast("array<string>"), ",").alias("gray"))


@_query
def gradient_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    thumbs = S.thumbnails(_read(spark, sf_dir, "embeddings"))
    return thumbs.select("frame_num", F.array_join(P.gradient_bits(F.col("thumb")).cast("array<string>"), "").alias("bits"))


@_query
def hash_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("frame_num", F.round("distance", 6).alias("distance"))


@_query
def motion_mean_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("frame_num", F.round("motion", 6).alias("motion"))


@_query
def gated_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("frame_num", F.round("distinct", 6).alias("distinct_conf"))


@_query
def sigmoid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    thumbs = S.thumbnails(_read(spark, sf_dir, "embeddings"))
    return thumbs.select("frame_num", F.round(P.sigmoid(F.aggregate("thumb", F.lit(0.0), lambda s, x: s + x)), 6).alias("score"))


@_query
def extract_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.similar_frames(_pairs(spark, sf_dir), 0.25, 0.45)


@_query
def select_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that the first freeze of each video shows and the one after it."""
    lags = _lags(spark, sf_dir).groupBy("video_id").agg(F.min("start").alias("start"))
    targets = lags.select("video_id", F.explode(F.array(F.col("start"), F.col("start") - 1, F.col("start"))).alias("frame_num"))
    return sequences.select_frames(_frames(spark, sf_dir), targets).select("video_id", "frame_num", "value")


@_query
def frame_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.history(_frames(spark, sf_dir), 5).select("video_id", "frame_num", _joined("before"))


@_query
def flow_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = _read(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_discount") * 5 - F.col("l_tax") * 3).alias("x"), (F.col("l_quantity") / 50 - F.col("l_tax")).alias("y"))
    out = datasets.flow_means(flow, "l_linenumber")
    return out.select("l_linenumber", *(F.round(c, 6).alias(c) for c in ("avg_flow_x", "avg_flow_y", "motion")))


@_query
def full_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    thumbs = S.thumbnails(_read(spark, sf_dir, "embeddings"))
    stretched = P.to_full_range(F.col("thumb"))
    turn = P.direction(F.col("thumb")[0], F.col("thumb")[1])
    return thumbs.select("frame_num", F.array_join(F.transform(stretched, lambda x: F.floor(x).cast("string")), ",").alias("bytes"), F.round(turn, 6).alias("direction"))


@_query
def ema_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.ema_final(_frames(spark, sf_dir), 1 / 7).withColumn("ema", F.round("ema", 6))


@_query
def ema_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.ema_running(_frames(spark, sf_dir), 1 / 3, chunk=_chunk(spark, sf_dir)).withColumn("ema", F.round("ema", 6))


@_query
def matcher_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = matcher.chains(_steps(spark, sf_dir))
    return chains.select("video_id", "chain_i", _joined("frames"), "end_frame", "state", "n_additional", F.round("chain_motion", 6).alias("chain_motion"))


@_query
def matcher_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("video_id", "step", "frame_num", "len", "state", "outcome", F.round("chain_motion", 6).alias("chain_motion"))


@_query
def matcher_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matcher.duplicates(_steps(spark, sf_dir)).select("video_id", "frame_num").distinct()


@_query
def stream_matcher_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matcher over scores that come in four batches, none of which has a video's frames in order."""
    scores = _scores(spark, sf_dir).repartition(4, "frame_num")
    with state_store(spark):
        steps = run_stream(matching.match_stream(as_stream(scores)), _state_partitions(spark))
    return steps.select("video_id", "step", "frame_num", "len", "state", "outcome", F.round("chain_motion", 6).alias("chain_motion"))


@_query
def stream_release_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions out of order, released in order."""
    done = _chains(spark, sf_dir).select("video_id", "chain_i", F.format_string("chain_%d", "chain_i").alias("out"))
    with state_store(spark):
        return run_stream(matching.release_stream(as_stream(done.repartition(3, "chain_i"))), _state_partitions(spark))


@_query
def interpolation_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patching.interpolation_jobs(_chains(spark, sf_dir)).withColumn("s", F.round("s", 6))


@_query
def job_release_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = patching.interpolation_jobs(_chains(spark, sf_dir)).where("is_last")
    done_at = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("video_id").cast("string"), F.col("chain_i").cast("string"))), 1, 6), 16, 10).cast("long")
    completions = jobs.select(patching.job_key(F.col("in0"), F.col("in1"), F.col("out")).alias("key"), F.col("video_id").alias("of"), done_at.alias("done_at"))
    done = patching.completed(jobs, completions).where("of = video_id")
    return patching.release_order(done, chunk=_chunk(spark, sf_dir)).select("video_id", "chain_i", "done_at", "released_at")


@_query
def patch_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patching.patch_ranges(_chains(spark, sf_dir)).select("video_id", "chain_i", "start", "length", _joined("imgs"))


@_query
def patched_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    return patching.patched(frames, patching.interpolated(_chains(spark, sf_dir), frames)).withColumn("value", F.round("value", 6))


@_query
def inject_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lags(spark, sf_dir)


@_query
def lag_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.lag_frames(_lags(spark, sf_dir))


@_query
def injected_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.injected_frames(_frames(spark, sf_dir), _lags(spark, sf_dir)).withColumn("value", F.round("value", 6))


@_query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.confusion(_lags(spark, sf_dir), sequences.duplicate_frames(_scores(spark, sf_dir)))


@_query
def precision_recall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "labels")
    truth, found = F.col("quality") == 1, F.col("toxic") == 0
    cells = {"true_positives": truth & found, "false_positives": ~truth & found, "false_negatives": truth & ~found, "true_negatives": ~truth & ~found}
    return faults.scores(rows.agg(*(F.count_if(c).alias(n) for n, c in cells.items())))


@_query
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.log_lines(_steps(spark, sf_dir))


@_query
def parse_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_log(logs.log_lines(_steps(spark, sf_dir)))


def _painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.painted_frames(logs.painted_ranges(parse_log(spark, sf_dir)))


@_query
def painted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _painted(spark, sf_dir)


@_query
def color_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.color_ranges(_painted(spark, sf_dir), chunk=_chunk(spark, sf_dir))


@_query
def clip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.clip_ranges(logs.color_ranges(_painted(spark, sf_dir), chunk=_chunk(spark, sf_dir)), center=40, fps=2, total=1000)


@_query
def video_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = _frames(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n"))
    probe = F.format_string("width=2560\nheight=1440\nr_frame_rate=%d/%d\nduration=%d", 30 + F.col("video_id") % 31, F.col("video_id") % 3, "n")
    found = videos.select("video_id", T.key_values(probe).alias("m"))
    rate, seconds = T.fraction(F.col("m")["r_frame_rate"]), F.col("m")["duration"].cast("double")
    return found.select("video_id", F.col("m")["width"].cast("int").alias("width"), F.col("m")["height"].cast("int").alias("height"), rate.alias("framerate"), seconds.alias("duration_s"), F.floor(rate * seconds).cast("long").alias("total_frames"))


@_query
def segment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = _frames(spark, sf_dir).groupBy("video_id").agg(F.count("*").cast("double").alias("duration_s"))
    return datasets.segment_plan(videos, duration=5.0, most=4, every=15.0).withColumn("start_s", F.round("start_s", 6))


@_query
def command_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", T.command(F.lit("gets"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("cmd"))
    parts = F.split("cmd", r"\|")
    return orders.select("o_orderkey", "cmd", parts[0].alias("kind"), (F.size(parts) - 1).alias("n_args"), parts[2].alias("last_arg"))


@_query
def seek_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among the frames that differ from the one before them. A video's first one always is among them, so the videos are
    those of the table, which takes no order."""
    events, chunk = _read(spark, sf_dir, "events"), _chunk(spark, sf_dir)
    frames = S.event_scores(events, chunk).where("distinct_conf IS NULL OR distinct_conf > 0")
    targets = events.select(F.col("user_id").alias("video_id")).distinct().select("video_id", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 5, 17, 1000)))).alias("target"))
    return sequences.seek_frames(frames, targets, chunk)


@_query
def seek_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a second of each video, from a quarter of a second on."""
    return S.seek(_frames(spark, sf_dir), 0.25, 0.5, chunk=_chunk(spark, sf_dir)).select("video_id", "frame_num", F.round("ts_s", 6).alias("ts_s"), "value")


@_query
def frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that time stamps in thousandths belong to, at the rate that a file tells."""
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey") % 3 * 24.0, (F.col("o_orderkey") % 2 * 25.0).alias("nominal"), "o_totalprice").toDF("o_orderkey", "average", "nominal", "price")
    rate = S.frame_rate(F.col("average"), F.col("nominal"))
    told = F.col("o_orderkey") % 5
    count = S.frame_count(told, rate, F.col("price") / 1000)
    return rows.select("o_orderkey", rate.alias("rate"), S.frame_index(F.floor("price"), F.lit(0.001), rate).alias("frame_num"), count.alias("n_frames"))


@_query
def parse_kwargs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of each part as literals, and its size as a resolution."""
    part = _spread(_read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"))
    given = F.concat(F.lit("size="), F.col("p_size").cast("string"), F.lit(",half="), (F.col("p_size") / 2.0).cast("string"), F.lit(",big="), F.when(F.col("p_size") > 25, "True").otherwise("False"), F.lit(",brand="), "p_brand", F.lit(",none=None"))
    rows = part.select("p_partkey", "p_size", T.kwargs(given).alias("k"), T.resolution(F.concat(F.col("p_size").cast("string"), F.lit("x"), (F.col("p_size") * 2).cast("string"))).alias("r"), T.resolution(F.col("p_brand")).alias("bad"))
    k = F.col("k")
    return rows.select(
        "p_partkey", k["size"]["int"].alias("size"), F.round(k["half"]["float"], 6).alias("half"), k["big"]["bool"].alias("big"), k["brand"]["str"].alias("brand"), k["none"]["kind"].alias("none_kind"),
        F.col("r.width").alias("width"), F.col("r.height").alias("height"), F.col("bad").isNull().alias("bad_is_null"),
    )


@_query
def sample_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of adjacent groups with the contents of both their images, here the lengths of two texts."""
    name = F.concat("source", F.lit("/"), T.frame_name(F.col("doc_id")))
    images = _read(spark, sf_dir, "documents").select(name.alias("path"), F.col("n_chars").alias("content"))
    out = S.images_of(same_cross_pairs(spark, sf_dir), images)
    return out.select("before", "after", "different", F.col("first_data").alias("before_chars"), F.col("second_data").alias("after_chars"))


@_query
def overlapping_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of a video that begin before the one before them has ended, if each were four frames longer."""
    patches = patching.patch_ranges(_chains(spark, sf_dir)).withColumn("length", F.col("length") + 4)
    return patching.overlapping(patches, chunk=_chunk(spark, sf_dir)).select("video_id", "chain_i", "start", "length")


@_query
def denormalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's outputs, scaled back and cut at zero."""
    out = L.denormalised((F.col("l_quantity") - 30) / 10, F.col("l_discount"), F.col("l_tax") * 10)
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(out, 6).alias("target"))


@_query
def normalised_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a motion model takes: thumbnails in bytes, scaled to 0 to 1, the earlier less the later one."""
    thumbs = S.thumbnails(_read(spark, sf_dir, "embeddings")).select("frame_num", F.transform("thumb", P.to_byte).alias("thumb"))
    change = P.difference(P.normalised(F.col("before")), P.normalised(F.col("thumb")))
    rows = sequences.neighbours(thumbs).select("frame_num", change.alias("change"))
    return rows.select("frame_num", F.round(F.aggregate("change", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(P.mean_abs(F.col("change")), 6).alias("mean_abs"))


@_query
def boundary_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames between which each chain is filled in."""
    return sequences.boundary_frames(_chains(spark, sf_dir), _frames(spark, sf_dir)).select("video_id", "chain_i", "name", "frame_num", "value")


@_query
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each part of a split."""
    return train_val_split(spark, sf_dir).groupBy("is_validation").agg(F.count("*").alias("n"))


@_query
def variation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).select("segment", "frame_num", _joined("paths"))


@_query
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.adjacent_groups(_groups(spark, sf_dir)).select("segment", "frame_num", _joined("before"), _joined("after"))


@_query
def same_cross_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.samples(datasets.adjacent_groups(_groups(spark, sf_dir)))


@_query
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.train_validation(_read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@_query
def motion_target_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", L.motion_target(F.col("l_discount"), F.col("l_tax"), F.col("l_tax") * 2).alias("target"))
    facts = rows.agg(F.avg("target").alias("mean"), F.stddev_pop("target").alias("deviation"))
    out = rows.join(F.broadcast(facts))  # one row
    return out.select("l_orderkey", "l_linenumber", F.round("target", 6).alias("target"), F.round(L.z_score(F.col("target"), F.col("mean"), F.col("deviation")), 6).alias("z"))


@_query
def loss_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, guess, logit = F.col("l_discount"), F.col("l_tax"), (F.col("l_quantity") - 25) / 10
    losses = {"bce": L.binary_cross_entropy(logit, (F.col("l_returnflag") == "R").cast("double")), "nll": L.gaussian_nll(truth, guess, logit)} | {n: f(truth, guess) for n, f in L.METRICS.items()}
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("epoch"), F.expr("l_orderkey div 1000").alias("batch"), *(c.alias(n) for n, c in losses.items()))
    batches = rows.groupBy("epoch", "batch").agg(F.count("*").alias("n"), *(F.sum(n).alias(n) for n in losses))
    out = batches.groupBy("epoch").agg(*(F.round(F.avg(F.col(n) / F.col("n")), 6).alias(f"{n}_of_batches") for n in losses), *(F.round(F.sum(n) / F.sum("n"), 6).alias(f"{n}_of_rows") for n in losses))
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matcher_chains(spark, sf_dir)

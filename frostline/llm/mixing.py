"""Mixing sources to target weights by Pareto order sampling.

A source's target is divided among its documents as expected copies, a little more for long documents than for short
ones. Whole copies are allocated for certain; what is left of a document's expectation is its inclusion probability.
Documents are ranked by random odds divided by inclusion odds and taken in that order until the next one would exceed
the target. What is missing then is filled up with documents of the sizes that fit, largest first, each size in the
same order, until none fits. DataFrame operations only: rows that are alike in source, id and text are one unit with a
count, and the order is cut by a histogram of it, so that no source and no row that is repeated, however often, is sorted
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import nonnull_text, row_key, stage_table

BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(nonnull_text(text), F.lit(WORD)).cast("long")


def targets(slim: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per source of slim (source, size): source, source_size, source_rows, target (double).

    Sources in code-point order, null last, weigh the weights in turn. Together they get share of all sizes; a source
    whose part exceeds most times its size gets that, and the excess goes to the others by weight. Ordered by limit a
    unit of weight, those above their limits come first, so that running sums settle it. Windows here see one row per
    source.
    """
    by = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    n = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    by = by.withColumn("n", n).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int")).cast("long"))
    by = by.withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), "n")
    free = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by = by.withColumns({
        "before": F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)),
        "total": F.sum("source_size").over(free),
    })
    unit = (F.lit(share) * F.col("total").cast("double") - F.col("before").cast("double")) / F.col("open").cast("double")
    by = by.withColumn("unit", unit).withColumn("capped", F.col("unit") * F.col("w") >= F.col("cap"))
    level = F.min(F.when(~F.col("capped"), F.struct("n0", "unit"))).over(free)["unit"]
    by = by.withColumn("n0", F.row_number().over(order)).withColumn("level", level)
    return by.select("source", "source_size", "source_rows", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w")).alias("target"))


def _expected(tilt: float) -> dict[str, Column]:
    """Expected copies of a row that has size and its source's columns; their sum over sizes is the target."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    lean = (F.col("long").cast("double") - F.col("long_size").cast("double") / F.greatest("source_size", F.lit(1)).cast("double")) / F.lit(1024.0)
    e = rate + F.lit(tilt) * F.least(rate, F.lit(2.0) - rate) * lean
    return {"expected": e}


def _long() -> Column:
    """0 to 1023: how a document's size compares with its source's mean."""
    mean = "(source_size div greatest(source_rows, 1))"
    return F.expr(f"if(size + {mean} > 0, (1024 * size) div (size + {mean}), 0)").cast("long")


def _odds(rows: DataFrame, tilt: float, seed: str) -> DataFrame:
    """rows, which have size, ident and their source's columns, with certain (whole copies), odds (null: never) and the
    odds' bucket in the histogram."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("ident"))), 1, 13), 16, 10).cast("long")
    rows = rows.withColumn("long", _long()).withColumns(_expected(tilt))
    rows = rows.withColumn("certain", F.floor("expected").cast("long")).withColumn("rest", F.col("expected") - F.floor("expected").cast("double"))
    u = (drawn.cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    rows = rows.withColumn("u", u)
    odds = (F.col("u") / (F.lit(1.0) - F.col("u"))) / (F.col("rest") / (F.lit(1.0) - F.col("rest")))
    rows = rows.withColumn("odds", F.when(F.col("rest") > 0, odds))
    return rows.withColumn("bucket", F.floor(F.col("odds") / (F.lit(1.0) + F.col("odds")) * BUCKETS).cast("long"))


def _with(rows: DataFrame, by: DataFrame, how: str = "inner", on: tuple[str, ...] = ("source",)) -> DataFrame:
    """rows with their source's columns (on: and size's); by has one row for each, so Spark broadcasts it if it is small."""
    right = by.withColumnsRenamed({c: f"_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    return rows.join(right, same[0] if len(same) == 1 else same[0] & same[1], how).drop(*(f"_{c}" for c in on))


def source_facts(slim: DataFrame) -> DataFrame:
    """One row per source: targets(), and what the expectations need; slim has source, size."""
    by = stage_table(targets(slim))
    longs = _with(slim, by).withColumn("long", _long()).groupBy("source").agg(F.sum(F.col("size") * F.col("long")).alias("long_size"))
    return stage_table(_with(by, longs))


def _cut(units: DataFrame, by: DataFrame, weight: Column, room: str, on: tuple[str, ...]) -> DataFrame:
    """Where the order of units is cut for each row of by, whose column room says how much fits: full (whole buckets up
    to this one), last (the last unit after those that fits whole), part (the unit after that) and k (how many of its
    rows fit)."""
    key = list(on)
    units = units.withColumn("weight", weight)
    held = units.groupBy(*key, "bucket").agg(F.sum("weight").alias("held"))
    held = held.withColumn("upto", F.sum("held").over(W.partitionBy(*key).orderBy("bucket")))
    held = _with(held, by.select(*key, room), on=on)
    inside = F.col("upto").cast("double") <= F.col(room)
    found = held.groupBy(*key).agg(
        F.coalesce(F.max(F.when(inside, F.col("bucket"))), F.lit(-1)).alias("full"),
        F.coalesce(F.max(F.when(inside, F.col("upto"))), F.lit(0)).alias("full_size"),
        F.min(F.when(~inside, F.col("bucket"))).alias("edge"),
    )
    found = stage_table(_with(by.select(*key, room), found, "left", on))
    edge = _with(units, found, on=on).where("bucket = edge")
    upto = F.sum("weight").over(W.partitionBy(*key).orderBy("odds", "ident")) + F.col("full_size")
    edge = edge.withColumn("upto", upto).withColumn("fits", F.col("upto").cast("double") <= F.col(room))
    left = F.col(room) - (F.col("upto") - F.col("weight")).cast("double")
    some = F.when(~F.col("fits"), F.struct("odds", "ident", F.floor(left / F.nullif(F.col("weight") / F.col("n"), F.lit(0.0))).cast("long").alias("k"), "size"))
    ends = edge.groupBy(*key).agg(F.max(F.when(F.col("fits"), F.struct("odds", "ident"))).alias("last"), F.min(some).alias("part"), F.max(F.when(F.col("fits"), F.col("upto"))).alias("last_size"))
    out = _with(found, ends, "left", on)
    part = F.when(F.col("part.k") > 0, F.struct("part.odds", "part.ident"))
    taken = F.coalesce("last_size", "full_size", F.lit(0)) + F.coalesce(F.when(F.col("part.k") > 0, F.col("part.k") * F.col("part.size")), F.lit(0))
    return out.select(*key, F.coalesce("full", F.lit(-1)).alias("full"), "last", part.alias("part"), F.coalesce("part.k", F.lit(0)).alias("k"), taken.alias("taken"))


def _takes(full: str, last: str) -> Column:
    """Whether a unit comes before a cut."""
    return (F.col("bucket") <= F.col(full)) | F.coalesce(F.struct("odds", "ident") <= F.col(last), F.lit(False))


def _fill(classes: DataFrame, gaps: DataFrame) -> DataFrame:
    """How many documents of each size fill a source's gap, largest first (source, size, t); classes has source, size and
    c, the number of documents. A source's sizes within its gap are one array: fewer than words in its longest document."""
    sizes = _with(classes, gaps).where(F.col("size") <= F.col("gap"))
    rows = sizes.groupBy("source", "gap").agg(F.sort_array(F.collect_list(F.struct("size", "c")), asc=False).alias("sizes"))
    start = F.struct(F.col("gap").alias("gap"), F.array().cast("array<struct<size:bigint,t:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        t = F.least(x["c"], F.floor(acc["gap"] / x["size"]).cast("long"))
        out = F.when(t > 0, F.array_append(acc["out"], F.struct(x["size"].alias("size"), t.alias("t")))).otherwise(acc["out"])
        return F.struct((acc["gap"] - (t * x["size"]).cast("double")).alias("gap"), out.alias("out"))

    return rows.select("source", F.inline(F.aggregate("sizes", start, step, lambda acc: acc["out"]))).select("source", "size", "t")


def sampling_plan(ranked: DataFrame, by: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(by with the cut of each source, the cuts of the sizes that fill it up, the last rows of units that are taken in
    part); ranked has source, size, ident, certain,
    odds, bucket and, for rows that are alike, _file and _row."""
    sure = ranked.groupBy("source").agg(F.sum(F.col("size") * F.col("certain")).alias("sure"))
    by = stage_table(_with(by, sure).withColumn("left", F.col("target") - F.col("sure").cast("double")).drop("sure"))
    units = ranked.where("odds IS NOT NULL").groupBy("source", "ident", "size").agg(F.first("odds").alias("odds"), F.first("bucket").alias("bucket"), F.count("*").alias("n"))
    units = stage_table(units)
    cut = stage_table(_cut(units, by, F.col("size") * F.col("n"), "left", ("source",)))
    by = stage_table(_with(by, cut, "left").withColumn("gap", F.col("left") - F.coalesce("taken", F.lit(0)).cast("double")).drop("taken"))
    is_part = F.struct("odds", "ident").eqNullSafe(F.col("part"))
    rest = _with(units, by.select("source", "gap", "full", "last", "part", "k")).where((F.col("size") > 0) & (F.col("size") <= F.col("gap")) & ~_takes("full", "last"))
    rest = stage_table(rest.withColumn("n", F.col("n") - F.when(is_part, F.col("k")).otherwise(0)).where("n > 0").select("source", "ident", "size", "odds", "bucket", "n"))
    wanted = stage_table(_fill(rest.groupBy("source", "size").agg(F.sum("n").alias("c")), by.select("source", "gap")))
    tops = _cut(_with(rest, wanted, on=("source", "size")).drop("t"), wanted, F.col("n"), "t", ("source", "size"))
    tops = stage_table(tops.select("source", "size", *(F.col(c).alias(f"top_{c}") for c in ("full", "last", "part", "k"))))
    # Of a unit that is taken in part, the first rows by file and number go: the k of the cut, then those of its size.
    parts = by.where("k > 0").select("source", F.col("part.ident").alias("ident"), "k").unionAll(tops.where("top_k > 0").select("source", F.col("top_part.ident").alias("ident"), F.col("top_k").alias("k")))
    parts = stage_table(parts.groupBy("source", "ident").agg(F.sum("k").alias("k")))
    return by, tops, _first_rows(ranked, parts)


def _first_rows(ranked: DataFrame, parts: DataFrame) -> DataFrame:
    """parts (source, ident, k) with upto: the file and number of a unit's k-th row. Only one file's rows are ordered."""
    key = ["source", "ident"]
    rows = stage_table(_with(ranked.select(*key, "_file", "_row"), parts, on=("source", "ident")))
    held = rows.groupBy(*key, "k", "_file").agg(F.count("*").alias("c"))
    held = held.withColumn("before", F.sum("c").over(W.partitionBy(*key).orderBy("_file")) - F.col("c"))
    edge = held.where("before < k AND before + c >= k").select(*key, F.col("_file").alias("_of"), "before")
    inside = _with(rows, edge, on=("source", "ident")).where("_file = _of")
    inside = inside.withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy("_row")) + F.col("before")).where("nth = k")
    return stage_table(inside.select("source", "ident", F.struct("_file", "_row").alias("upto")))


def _copies(rows: DataFrame, by: DataFrame, tops: DataFrame, upto: DataFrame) -> DataFrame:
    """rows, which have source, size, ident, certain, odds, bucket, _file and _row, with copies."""
    rows = _with(rows, by.select("source", "full", "last"))
    rows = _with(rows, tops.select("source", "size", "top_full", "top_last"), "left", ("source", "size"))
    rows = _with(rows, upto, "left", ("source", "ident"))
    part = F.col("odds").isNotNull() & (F.struct("_file", "_row") <= F.col("upto"))
    whole = F.col("odds").isNotNull() & (_takes("full", "last") | F.coalesce(_takes("top_full", "top_last"), F.lit(False)))
    return rows.withColumn("copies", F.col("certain") + (F.coalesce(whole, F.lit(False)) | F.coalesce(part, F.lit(False))).cast("long"))


def _parts(id_col: str, text_col: str, source_col: str, of: str = "") -> dict[str, Column]:
    """size, source and ident of a row; ident tells rows apart that differ in id or text."""
    text = nonnull_text(F.col(of + text_col))
    ident = F.concat(F.coalesce(F.concat(F.lit("="), F.col(of + id_col).cast("string")), F.lit("null")), F.lit(":"), F.md5(text))
    return {"size": n_words(text), "source": F.col(of + source_col), "ident": ident}


_RANKED = ("source", "size", "ident", "certain", "odds", "bucket", "_file", "_row")


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tilt: float = 0.5, seed: str = "mix:") -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target and copies, as mix_sources() tells; texts are read once."""
    return _planned(docs, id_col, text_col, source_col, tilt, seed)[0].select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies")


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, tilt: float, seed: str) -> tuple:
    located = row_key(docs)
    slim = stage_table(located.select(F.col(f"_doc.{id_col}").alias("_id"), "_file", "_row", *(c.alias(n) for n, c in _parts(id_col, text_col, source_col, "_doc.").items())))
    by = source_facts(slim)
    ranked = stage_table(_odds(_with(slim, by), tilt, seed).select("_id", "source_size", "target", *_RANKED))
    by, tops, upto = sampling_plan(ranked, by)
    return _copies(ranked, by, tops, upto), located, by, tops, upto


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tilt: float = 0.5, seed: str = "mix:") -> DataFrame:
    """Rows (_doc, _size, _source_size, _target, _copies): docs' columns as one struct, and how often the mix takes the
    document, 0 to 2 times.

    Size is the number of words; null and empty texts have none. A source misses its target by less than its smallest
    document that could still be taken. Draws depend on id, text and seed only, so reruns agree; of rows that are alike in
    source, id and text as many are taken as fit, the first by file and number. Null ids are an id of their own, a null
    source is a source, the last. An empty table gives no rows. docs' columns may have any names.
    """
    _, located, by, tops, upto = _planned(docs, id_col, text_col, source_col, tilt, seed)
    rows = _with(located.select("_doc", "_file", "_row", *(c.alias(n) for n, c in _parts(id_col, text_col, source_col, "_doc.").items())), by)
    rows = _odds(rows, tilt, seed).select("_doc", "source_size", "target", *_RANKED)
    rows = _copies(rows, by, tops, upto)
    return rows.select("_doc", F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("copies").alias("_copies"))


#: The mix of documents in DuckDB's SQL, without histograms: the same sums, odds and rules at the cut and behind it.
ORACLE = r"""
WITH RECURSIVE slim AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         coalesce('=' || CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) AS ident FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS source_rows,
               row_number() OVER (ORDER BY source IS NULL, source) - 1 AS n FROM slim GROUP BY source),
weighed AS (SELECT *, CASE n % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS cap FROM src),
run AS (SELECT *, CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS bef,
          CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS open_w,
          CAST(sum(source_size) OVER () AS DOUBLE) AS total, row_number() OVER o AS n0
        FROM weighed WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), n)),
unit AS (SELECT *, (CAST(1.5 AS DOUBLE) * total - bef) / open_w AS u1 FROM run),
lev AS (SELECT *, u1 * w >= cap AS capped FROM unit),
tgt AS (SELECT source, source_size, source_rows, CASE WHEN capped THEN CAST(cap AS DOUBLE)
          ELSE (SELECT arg_min(u1, n0) FROM lev WHERE NOT capped) * w END AS target FROM lev),
lng AS (SELECT slim.*, source_size, source_rows, target,
          CASE WHEN size + source_size // greatest(source_rows, 1) > 0 THEN (1024 * size) // (size + source_size // greatest(source_rows, 1)) ELSE 0 END AS long
        FROM slim JOIN tgt ON slim.source IS NOT DISTINCT FROM tgt.source),
avgs AS (SELECT source, CAST(sum(size * long) AS BIGINT) AS long_size FROM lng GROUP BY source),
rated AS (SELECT lng.*, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0 END AS rate,
            (CAST(long AS DOUBLE) - CAST(long_size AS DOUBLE) / CAST(greatest(source_size, 1) AS DOUBLE)) / CAST(1024.0 AS DOUBLE) AS lean
          FROM lng JOIN avgs ON lng.source IS NOT DISTINCT FROM avgs.source),
ex AS (SELECT *, rate + CAST(0.5 AS DOUBLE) * least(rate, CAST(2.0 AS DOUBLE) - rate) * lean AS e,
         (CAST(CAST('0x' || substr(md5('mix:' || ident), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u FROM rated),
od AS (SELECT *, CAST(floor(e) AS BIGINT) AS certain, CASE WHEN e - floor(e) > 0 THEN (u / (1.0::DOUBLE - u)) / ((e - floor(e)) / (1.0::DOUBLE - (e - floor(e)))) END AS odds FROM ex),
lefts AS (SELECT source, target - CAST(sum(size * certain) AS DOUBLE) AS lft FROM od GROUP BY source, target),
units AS (SELECT source, ident, size, min(odds) AS odds, count(*) AS n FROM od WHERE odds IS NOT NULL GROUP BY source, ident, size),
summed AS (SELECT units.*, lft, sum(size * n) OVER (PARTITION BY units.source ORDER BY odds, ident) AS upto FROM units JOIN lefts ON units.source IS NOT DISTINCT FROM lefts.source),
cut AS (SELECT *, CAST(upto AS DOUBLE) <= lft AS inside FROM summed),
first_out AS (SELECT *, NOT inside AND row_number() OVER (PARTITION BY source, inside ORDER BY odds, ident) = 1 AS edge FROM cut),
took AS (SELECT *, CASE WHEN inside THEN n WHEN edge THEN CAST(greatest(0, floor((lft - CAST(upto - size * n AS DOUBLE)) / size)) AS BIGINT) ELSE 0 END AS k FROM first_out),
gaps AS (SELECT source, lft - CAST(sum(k * size) AS DOUBLE) AS gap FROM took GROUP BY source, lft),
rest AS (SELECT took.*, n - k AS m, gap FROM took JOIN gaps ON took.source IS NOT DISTINCT FROM gaps.source WHERE n > k AND size > 0 AND size <= gap),
classes AS (SELECT source, size, CAST(sum(m) AS BIGINT) AS c, gap, row_number() OVER (PARTITION BY source ORDER BY size DESC) AS i FROM rest GROUP BY source, size, gap),
fill AS (SELECT source, i, size, least(c, CAST(floor(gap / size) AS BIGINT)) AS t, gap - least(c, CAST(floor(gap / size) AS BIGINT)) * size AS gap FROM classes WHERE i = 1
  UNION ALL SELECT x.source, x.i, x.size, least(x.c, CAST(floor(f.gap / x.size) AS BIGINT)), f.gap - least(x.c, CAST(floor(f.gap / x.size) AS BIGINT)) * x.size
  FROM fill f JOIN classes x ON x.source IS NOT DISTINCT FROM f.source AND x.i = f.i + 1),
more AS (SELECT rest.source, rest.ident, greatest(0, least(m, t - (sum(m) OVER (PARTITION BY rest.source, rest.size ORDER BY odds, ident) - m))) AS k2
  FROM rest JOIN fill ON rest.source IS NOT DISTINCT FROM fill.source AND rest.size = fill.size),
whole AS (SELECT took.source, took.ident, k + coalesce(k2, 0) AS k FROM took LEFT JOIN more ON took.source IS NOT DISTINCT FROM more.source AND took.ident = more.ident),
nth AS (SELECT *, row_number() OVER (PARTITION BY source, ident) AS nth FROM od)
SELECT doc_id, size, source_size, target, CAST(size * (certain + CASE WHEN odds IS NOT NULL AND nth <= coalesce(k, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM nth LEFT JOIN whole ON nth.source IS NOT DISTINCT FROM whole.source AND nth.ident = whole.ident
"""

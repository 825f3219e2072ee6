"""Repair of conversations: the cheapest edits that make the roles of each alternate, by folds in Spark SQL functions.

Turns are put in order, windows flag their faults, and an aggregate() over the sorted turns carries four (cost, audit)
structs, the cheapest way to have put out nothing yet, a system turn, a user turn or an assistant turn; native least()
expressions choose. Insertions are made right before a turn or at the very end, so that two audits of as many turns are
never one the beginning of the other, and the least of them stays the least whatever follows.

Rows are counted first, by conversation and without their texts. A conversation of at most LARGE turns is one row: a
shuffle by conversation is enough for the windows and the fold. A larger one is many tasks: its order is dealt out by
range, a fold runs over chunks of CHUNK turns from each state that the chunk may begin in, and a second fold joins one row
per chunk. Only SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage_table

CHUNK = 512
LARGE = 4096  # turns that are gathered in one row
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
_NEVER = 1 << 50  # cost of what can't be
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = 4
_SPACE = "\x20\x09\x0A\x0B\x0C\x0D"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32 of "conv_id:turn" modulo 20: 0 drops the row, 1 empties its
    text, 2 takes the full stops, question and exclamation marks out, 3 repeats it, 4 makes it the user's.

    Null roles and texts become one space, and so do nulls in what is hashed.
    """
    space = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def _step(state: Column, cost: Column | int, edit: str) -> Column:
    """A way that goes on from state with one more edit."""
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(edit)).alias("audit"))


def _with_inserts(s: Column) -> tuple[Column, Column, Column, Column]:
    """The four ways, after as many insertions as pay."""
    user = F.least(s["s2"], *(_step(s[f"s{k}"], INSERT, "I") for k in (_NOTHING, _SYSTEM, _ASSISTANT)))
    return s["s0"], s["s1"], user, F.least(s["s3"], _step(user, INSERT, "I"))


def _fold_turn(s: Column, t: Column) -> Column:
    """The four ways after the turn t = (place, role, text, fault, initial)."""
    nothing, system, user, assistant = _with_inserts(s)
    never, late = F.lit(_NEVER), F.when(t["fault"] == "truncated", TRUNCATED).otherwise(0)
    free = ~t["fault"].isin("blank", "duplicate")
    kept = lambda initial: F.when(free & (t["initial"] == initial), late + KEEP).otherwise(never)
    changed = F.when(free, late + REROLE).otherwise(never)
    before_user = F.least(nothing, system, assistant)
    return F.struct(
        _step(nothing, DELETE, "D").alias("s0"),
        F.least(_step(system, DELETE, "D"), _step(nothing, kept("s"), "K")).alias("s1"),
        F.least(_step(user, DELETE, "D"), _step(before_user, kept("u"), "K"), _step(before_user, changed, "R")).alias("s2"),
        F.least(_step(assistant, DELETE, "D"), _step(user, kept("a"), "K"), _step(user, changed, "R")).alias("s3"),
    )


def _start(entry: Column) -> Column:
    way = lambda k: F.struct(F.when(entry == k, F.lit(0)).otherwise(F.lit(_NEVER)).cast("long").alias("cost"), F.lit("").alias("audit"))
    return F.struct(*(way(k).alias(f"s{k}") for k in range(_STATES)))


def _fold_chunk(s: Column, chunk: Column) -> Column:
    """The four ways after a chunk, each as (cost, audits of the chunks, states that they began in)."""
    out = []
    for to in range(_STATES):
        ways = []
        for start in range(_STATES):
            way = chunk["ways"][start][f"s{to}"]
            ways.append(F.struct((s[f"s{start}"]["cost"] + way["cost"]).alias("cost"), F.concat(s[f"s{start}"]["audits"], F.array(way["audit"])).alias("audits"), F.concat(s[f"s{start}"]["entries"], F.array(F.lit(start))).alias("entries")))
        out.append(F.least(*ways).alias(f"s{to}"))
    return F.struct(*out)


def _no_chunks() -> Column:
    empty = (F.array().cast("array<string>").alias("audits"), F.array().cast("array<int>").alias("entries"))
    return F.struct(*(F.struct(F.lit(_NEVER if k else 0).cast("long").alias("cost"), *empty).alias(f"s{k}") for k in range(_STATES)))


def _finish(s: Column) -> Column:
    """The cheapest way that ends with nothing or an assistant turn, with what is inserted at the end as one more audit."""
    end = lambda k, n: F.struct((s[f"s{k}"]["cost"] + INSERT * n).alias("cost"), F.concat(s[f"s{k}"]["audits"], F.array(F.lit("I" * n))).alias("audits"), s[f"s{k}"]["entries"].alias("entries"))
    return F.least(end(_NOTHING, 0), end(_ASSISTANT, 0), end(_USER, 1), end(_SYSTEM, 2))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("again")]


def flagged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with again (role and text were seen earlier in the conversation), initial (of the
    role) and fault: the first of blank, duplicate and truncated, or empty."""
    again = F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    last = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    fault = F.when(last == "", "blank").when(F.col("again"), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return turns.withColumn("again", again).withColumns({"fault": fault, "initial": F.substring("role", 1, 1)})


def in_places(rows: DataFrame, *parts: str) -> DataFrame:
    """rows with place, from 0 on in each conversation and part by turn, nulls first, then role and text, and the initial and
    the turn before."""
    w = W.partitionBy("conv_id", *parts).orderBy(*_order())
    return rows.withColumns({"place": F.row_number().over(w) - 1, "initial_before": F.lag("initial").over(w), "turn_before": F.lag("turn").over(w)})


def _gathered(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each of the keys: its turns in order, counts, and how it begins and ends."""
    inside = F.col("place") > 0  # a pair across two parts is counted where parts meet
    pair = F.concat("initial_before", "initial")
    light = F.struct("initial", "turn")
    return rows.groupBy("conv_id", *keys).agg(
        F.array_sort(F.collect_list(F.struct("place", "role", "text", "fault", "initial"))).alias("turns"),
        *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        F.count_if(inside & ~pair.isin("su", "ua", "au")).alias("illegal"),
        F.count_if(F.col("turn").isNotNull() & (~inside | ~F.col("turn").eqNullSafe(F.col("turn_before")))).alias("distinct"),
        F.min("turn").alias("low"), F.max("turn").alias("high"),
        F.min_by(light, "place").alias("first"), F.max_by(light, "place").alias("last"),
    )


def _chunks(turns: DataFrame) -> DataFrame:
    """One row per chunk of each conversation, whatever its size: parts (_part) are ranges of the order."""
    rows = flagged(turns).repartitionByRange(F.col("conv_id"), *_order()).withColumn("_part", F.spark_partition_id())
    rows = in_places(stage_table(rows), "_part").withColumn("chunk", F.expr(f"place div {CHUNK}").cast("int"))
    return stage_table(_gathered(rows, "_part", "chunk"))


def _folded(chunks: DataFrame) -> DataFrame:
    """One row per conversation: parts (its chunks in order, without turns) and best, the cheapest way through them."""
    # a conversation lies in one part unless it reaches over the end of one: no more rows than there are parts
    over = chunks.groupBy("conv_id").agg(F.min("_part").alias("begins"), F.max("_part").alias("ends")).where("begins < ends").withColumnRenamed("conv_id", "_conv")
    known = chunks.join(over, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    begins = (F.col("chunk") == 0) & (F.col("begins").isNull() | (F.col("_part") == F.col("begins")))
    way = lambda entry: F.when((entry == _NOTHING) | ~begins, F.aggregate("turns", _start(entry), _fold_turn)).otherwise(_start(F.lit(-1)))
    ways = F.transform(F.array(*map(F.lit, range(_STATES))), way)
    known = known.select("conv_id", "_part", "chunk", ways.alias("ways"), "blank", "duplicate", "truncated", "illegal", "distinct", "low", "high", "first", "last")
    parts = F.array_sort(F.collect_list(F.struct("_part", "chunk", *[c for c in known.columns if c not in ("conv_id", "_part", "chunk")])))
    found = known.groupBy("conv_id").agg(parts.alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"))
    return stage_table(found.withColumn("best", _finish(F.aggregate("parts", _no_chunks(), _fold_chunk))))


def _gaps(distinct: Column) -> Column:
    """Turns that are missing between the least (low) and the greatest (high); null if that is more than a long holds."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    return F.coalesce(wide("high") - wide("low") + 1 - distinct, F.lit(0)).try_cast("long")


def _counts(found: DataFrame) -> DataFrame:
    """Counts, cost and audit of each conversation."""
    parts = F.col("parts")
    total = lambda c: F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + p[c])

    def meets(holds) -> Column:
        """How many parts begin with a row that holds with the last one of the part before."""
        return F.size(F.filter(parts, lambda p, i: (i > 0) & (p["chunk"] == 0) & holds(F.get(parts, i - 1)["last"], p["first"]))).cast("long")

    illegal = total("illegal") + meets(lambda a, b: ~F.concat(a["initial"], b["initial"]).isin("su", "ua", "au"))
    distinct = total("distinct") - meets(lambda a, b: a["turn"] == b["turn"])
    return found.select(
        F.col("conv_id").alias("_conv"), _gaps(distinct).alias("gaps"), *(total(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        illegal.alias("illegal"), F.col("best.cost").alias("cost"), F.array_join("best.audits", "").alias("audit"),
        F.element_at("best.audits", -1).alias("tail"),
    )


def _emit(s: Column, x: Column) -> Column:
    """The turns that are put out so far and the state, after the edits x.edits of the turn x.turn."""
    n = F.length(x["edits"]) - 1  # insertions before it
    user_next = s["state"] != _USER
    line = lambda role: F.struct(role.alias("role"), F.lit("").alias("text"))
    here = F.when(user_next, F.lit("user")).otherwise(F.lit("assistant"))
    none = F.array().cast("array<struct<role:string,text:string>>")
    inserted = F.when(n == 0, none).when(n == 1, F.array(line(here))).otherwise(F.array(line(F.lit("user")), line(F.lit("assistant"))))
    state = F.when(n == 0, s["state"]).when((n == 1) & user_next, _USER).otherwise(_ASSISTANT)
    edit, turn = F.right(x["edits"], F.lit(1)), x["turn"]
    role = F.when(edit == "K", turn["role"]).when(state == _USER, F.lit("assistant")).otherwise(F.lit("user"))
    initial = F.left(role, F.lit(1))
    after = F.when(edit == "D", state).when(initial == "s", _SYSTEM).when(initial == "u", _USER).otherwise(_ASSISTANT)
    own = F.when(edit == "D", none).otherwise(F.array(F.struct(role.alias("role"), turn["text"].alias("text"))))
    return F.struct(after.alias("state"), F.concat(s["lines"], inserted, own).alias("lines"))


def _repaired_chunks(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, _part, chunk, lines): what each chunk puts out, an array of (role, text) in order."""
    each = found.select("conv_id", F.explode(F.arrays_zip(F.col("parts._part").alias("part"), F.col("parts.chunk").alias("chunk"), F.slice("best.audits", 1, F.size("parts")).alias("audit"), F.col("best.entries").alias("entry"))).alias("p"))
    each = each.select(F.col("conv_id").alias("_conv"), F.col("p.part").alias("_of"), F.col("p.chunk").alias("_nr"), "p.audit", "p.entry")
    rows = chunks.select("conv_id", "_part", "chunk", "turns").join(each, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_part") == F.col("_of")) & (F.col("chunk") == F.col("_nr")))
    return rows.select("conv_id", "_part", "chunk", _edited(F.col("turns"), F.col("audit"), F.col("entry")).alias("lines"))


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation of turns (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, and repaired, an array of (role, text).

    Turns go by turn, nulls first, those of one turn by role and text. The first fault of a turn counts: blank (no text but
    white space), duplicate (role and text seen earlier), truncated (the last character isn't a full stop, question or
    exclamation mark). illegal is how many neighbours' role initials aren't su, ua or au; gaps is how many turns are missing
    between the least and the greatest, null if that is more than a long holds.

    Each turn is kept (K, cost 0), given to the user or assistant (R, 2) or deleted (D, 3); empty turns of a user or an
    assistant may be inserted anywhere (I, 2); a truncated turn that stays costs one more. Blank turns and duplicates have
    to go. What is left has the initials of an optional system turn and then pairs of user and assistant, or is empty.
    audit is the cheapest edits in order, the first by ASCII of those equally cheap; cost is what they cost.

    Null roles and texts count as one space, a null conversation is one like the others, null turns are the first. Repeated
    rows are duplicates but for the first. Very long texts are whole; very long conversations are folded in chunks (the
    array of a conversation's repaired turns is the one thing that has to be in one place). An empty table gives no rows, and
    other columns don't matter.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", "turn", part("role"), part("text"))
    many = stage_table(rows.groupBy(F.col("conv_id").alias("_large")).agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("_large"))
    if many.isEmpty():
        return _repair_whole(rows)
    same = F.col("conv_id").eqNullSafe(F.col("_large"))
    return _repair_whole(rows.join(many, same, "left_anti")).unionAll(_repair_chunks(rows.join(many, same, "left_semi")))


def _turns_at_end(tail: Column) -> Column:
    """What is inserted after the last turn."""
    turn = lambda role: F.struct(F.lit(role).alias("role"), F.lit("").alias("text"))
    none = F.array().cast("array<struct<role:string,text:string>>")
    return F.when(tail == "I", F.array(turn("assistant"))).when(tail == "II", F.array(turn("user"), turn("assistant"))).otherwise(none)


def _edited(turns: Column, audit: Column, entry: Column) -> Column:
    """The turns that a chunk puts out under its audit, from the state that it begins in."""
    edits = F.arrays_zip(turns.alias("turn"), F.regexp_extract_all(audit, F.lit("(I*[KRD])"), F.lit(1)).alias("edits"))
    start = F.struct(entry.alias("state"), F.array().cast("array<struct<role:string,text:string>>").alias("lines"))
    return F.aggregate(edits, start, _emit)["lines"]


def _repair_whole(rows: DataFrame) -> DataFrame:
    """Conversations that are gathered in one row each: one shuffle."""
    found = _gathered(in_places(flagged(rows.repartition("conv_id"))))
    found = found.withColumn("way", F.aggregate("turns", _start(F.lit(_NOTHING)), _fold_turn))
    way = F.col("way")
    found = found.withColumn("best", F.least(way["s0"], way["s3"], _step(way["s2"], INSERT, "I"), _step(way["s1"], 2 * INSERT, "II")))
    audit = F.col("best.audit")
    repaired = F.concat(_edited(F.col("turns"), audit, F.lit(_NOTHING)), _turns_at_end(F.regexp_extract(audit, "I*$", 0)))
    return found.select("conv_id", _gaps(F.col("distinct")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), audit.alias("audit"), repaired.alias("repaired"))


def _repair_chunks(rows: DataFrame) -> DataFrame:
    """Conversations of any size, in chunks."""
    chunks = _chunks(rows)
    found = _folded(chunks)
    lines = _repaired_chunks(chunks, found).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_part", "chunk", "lines"))).alias("parts"))
    out = lines.join(_counts(found), F.col("conv_id").eqNullSafe(F.col("_conv")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.concat(F.flatten("parts.lines"), _turns_at_end(F.col("tail"))).alias("repaired"))


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation: what repair() finds after damage(), with repaired_sha256, the lowercase hex digest of the
    repaired role:text lines joined by newlines. A conversation of which no row is left has zeros, an empty audit and the
    digest of nothing."""
    found = repair(damage(conversations)).withColumnRenamed("conv_id", "_conv")
    out = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    lines = F.array_join(F.transform("repaired", lambda t: F.concat_ws(":", t["role"], t["text"])), "\n")
    counts = (F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce(lines, F.lit("")).cast("binary"), 256).alias("repaired_sha256"))


#: The same as damage_and_repair(conversations), turn by turn with whole lines carried along.
ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
         lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS kind FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
again AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS seen,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM damaged),
numbered AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial,
         CASE WHEN cut = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         row_number() OVER o AS i, lag(left(role, 1)) OVER o AS was
  FROM again WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen)),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND was || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM numbered GROUP BY conv_id),
ways AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {c: CAST(0 AS BIGINT), a: '', l: ''} AS s0, {c: CAST(1e15 AS BIGINT), a: '', l: ''} AS s1,
         {c: CAST(1e15 AS BIGINT), a: '', l: ''} AS s2, {c: CAST(1e15 AS BIGINT), a: '', l: ''} AS s3 FROM facts
  UNION ALL
  SELECT conv_id, i, {c: s0.c + 3, a: s0.a || 'D', l: s0.l},
         least({c: s1.c + 3, a: s1.a || 'D', l: s1.l}, {c: s0.c + late + CASE WHEN initial = 's' THEN 0 ELSE 1e15::BIGINT END, a: s0.a || 'K', l: s0.l || own}),
         least({c: u.c + 3, a: u.a || 'D', l: u.l}, {c: f.c + late + CASE WHEN initial = 'u' THEN 0 ELSE 1e15::BIGINT END, a: f.a || 'K', l: f.l || own},
               {c: f.c + late + 2, a: f.a || 'R', l: f.l || chr(10) || 'user:' || text}),
         least({c: v.c + 3, a: v.a || 'D', l: v.l}, {c: u.c + late + CASE WHEN initial = 'a' THEN 0 ELSE 1e15::BIGINT END, a: u.a || 'K', l: u.l || own},
               {c: u.c + late + 2, a: u.a || 'R', l: u.l || chr(10) || 'assistant:' || text})
  FROM (SELECT *, least(s3, {c: u.c + 2, a: u.a || 'I', l: u.l || chr(10) || 'assistant:'}) AS v, least(s0, s1, v) AS f
        FROM (SELECT w.conv_id, r.i, s0, s1, s2, s3, initial, text, chr(10) || role || ':' || text AS own,
                     CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 1 ELSE 1e15::BIGINT END AS late,
                     least(s2, {c: s0.c + 2, a: s0.a || 'I', l: s0.l || chr(10) || 'user:'}, {c: s1.c + 2, a: s1.a || 'I', l: s1.l || chr(10) || 'user:'},
                           {c: s3.c + 2, a: s3.a || 'I', l: s3.l || chr(10) || 'user:'}) AS u
              FROM ways w JOIN numbered r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1))),
ends AS (
  SELECT f.*, least(s0, s3, {c: s2.c + 2, a: s2.a || 'I', l: s2.l || chr(10) || 'assistant:'},
                    {c: s1.c + 4, a: s1.a || 'II', l: s1.l || chr(10) || 'user:' || chr(10) || 'assistant:'}) AS best
  FROM facts f JOIN ways w ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.l[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""

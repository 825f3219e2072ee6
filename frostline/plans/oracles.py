"""DuckDB SQL for the registered queries: the same columns, computed in its own way."""

from __future__ import annotations

FRAMES = """frames AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_num, event_type, value FROM events)"""
SCORES = f"""{FRAMES},
scores AS (SELECT video_id, frame_num, value, CAST(CASE WHEN p IS NULL THEN NULL WHEN event_type = p THEN 0 ELSE 1 END AS DOUBLE) AS conf, abs(value - pv) / 100 AS motion
  FROM (SELECT *, lag(event_type) OVER w AS p, lag(value) OVER w AS pv FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_num)))"""
CHAINS = f"""{SCORES},
isl AS (SELECT *, coalesce(1 - conf >= 0.65, false) AS dup, sum(CASE WHEN coalesce(1 - conf >= 0.65, false) THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY frame_num) AS island FROM scores),
runs AS (SELECT video_id, island, list(frame_num ORDER BY frame_num) AS frames, sum(CASE WHEN dup THEN motion ELSE 0 END) AS run_motion FROM isl GROUP BY video_id, island HAVING count(*) BETWEEN 2 AND 13),
chains AS (SELECT r.video_id, row_number() OVER (PARTITION BY r.video_id ORDER BY r.island) - 1 AS chain_i, r.frames, e.frame_num AS end_frame, run_motion + coalesce(e.motion, 0) AS chain_motion
  FROM runs r JOIN isl e ON e.video_id = r.video_id AND e.island = r.island + 1 AND NOT e.dup)"""
STEPS = f"""{SCORES},
run AS (
  SELECT video_id, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS h, CAST(0 AS DOUBLE) AS cm, CAST(NULL AS DOUBLE) AS rm, CAST(NULL AS DOUBLE) AS sm, CAST(0 AS DOUBLE) AS ld, 'Find' AS st, 0 AS n, CAST(0 AS BIGINT) AS ci,
    CAST([] AS STRUCT(p BIGINT, cm DOUBLE, rm DOUBLE, sm DOUBLE, ld DOUBLE)[]) AS snaps, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS o_frame, CAST(NULL AS BIGINT) AS o_len, CAST(NULL AS VARCHAR) AS o_state, CAST(NULL AS INTEGER) AS o_n, CAST(NULL AS DOUBLE) AS o_cm, CAST(NULL AS BIGINT) AS o_ci, CAST(NULL AS DOUBLE) AS o_diff, CAST(NULL AS DOUBLE) AS o_conf
  FROM (SELECT DISTINCT video_id FROM scores)
  UNION ALL
  SELECT video_id, step + 1, CASE act WHEN 'back' THEN pos - n ELSE pos + 1 END, CASE act WHEN 'clear' THEN pos ELSE h END,
    CASE WHEN act = 'back' THEN back.cm WHEN o = 'NoScore' THEN cm WHEN act = 'clear' THEN 0 ELSE cm1 END,
    CASE WHEN act = 'back' THEN back.rm WHEN o = 'NoScore' OR act <> 'clear' THEN rm WHEN rm IS NULL THEN motion ELSE CAST(0.7 AS DOUBLE) * motion + (1 - CAST(0.7 AS DOUBLE)) * rm END,
    CASE WHEN act = 'back' THEN back.sm WHEN o IN ('NoScore', 'FailDuplicate') THEN sm WHEN sm IS NULL THEN motion ELSE CAST(0.1 AS DOUBLE) * motion + (1 - CAST(0.1 AS DOUBLE)) * sm END,
    CASE WHEN act = 'back' THEN back.ld WHEN o = 'NoScore' THEN ld ELSE conf END,
    CASE act WHEN 'back' THEN 'Failed' WHEN 'clear' THEN 'Find' WHEN 'more' THEN 'Compensate' ELSE st END, CASE act WHEN 'more' THEN n + 1 WHEN 'stay' THEN n ELSE 0 END, ci + CASE o WHEN 'Ok' THEN 1 ELSE 0 END,
    CASE act WHEN 'back' THEN list_filter(snaps, lambda s: s.p < pos - n) WHEN 'clear' THEN [here] ELSE list_append(snaps, here) END, o, pos, len, st, n, CASE o WHEN 'NoScore' THEN cm ELSE cm1 END, CASE o WHEN 'Ok' THEN ci END, ld, conf
  FROM (SELECT *, list_filter(snaps, lambda s: s.p = pos - n)[1] AS back, CAST(struct_pack(p := pos, cm := cm, rm := rm, sm := sm, ld := ld) AS STRUCT(p BIGINT, cm DOUBLE, rm DOUBLE, sm DOUBLE, ld DOUBLE)) AS here,
          CASE WHEN o IN ('FailLong', 'FailTooMuchMotion') AND st = 'Compensate' THEN 'back' WHEN o = 'FailDuplicate' THEN 'stay' WHEN o = 'CompensationRequired' AND st <> 'Failed' THEN 'more' ELSE 'clear' END AS act
    FROM (SELECT *, CASE WHEN len = 0 OR conf IS NULL THEN 'NoScore' WHEN len > 13 THEN 'FailLong' WHEN 1 - conf >= 0.65 THEN 'FailDuplicate' WHEN len < 2 THEN 'FailShort'
            WHEN len > 2 AND cm1 < coalesce(rm, 0) * (len - 1) * (CAST(0.75 AS DOUBLE) * CASE st WHEN 'Failed' THEN CAST(0.33 AS DOUBLE) ELSE 1 END) THEN 'CompensationRequired'
            WHEN cm1 > coalesce(sm, 0) * CAST(7.3 AS DOUBLE) THEN 'FailTooMuchMotion' ELSE 'Ok' END AS o
      FROM (SELECT r.*, s.motion, s.conf, r.pos - r.h AS len, r.cm + s.motion AS cm1 FROM run r JOIN scores s ON s.video_id = r.video_id AND s.frame_num = r.pos)))),
steps AS (SELECT video_id, step - 1 AS step, o_frame AS frame_num, CAST(o_len AS INTEGER) AS len, o_state AS state, o_n AS n_additional, outcome, o_cm AS chain_motion, o_ci AS chain_i, o_diff AS diff, o_conf AS end_conf FROM run WHERE step > 0)"""
def _fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {x})"


#: Each step with a line: what a run's log says of it.
LINES = f"""{STEPS},
said AS (SELECT *, frame_num - len AS first, CASE outcome WHEN 'Ok' THEN frame_num - 1 ELSE frame_num END AS last,
    {_fixed("diff", 4)} AS diff4, {_fixed("end_conf", 4)} AS conf4, {_fixed("chain_motion", 4)} AS motion4, {_fixed("(frame_num - len) / CAST(60 AS DOUBLE)", 3)} AS at3,
    CASE state WHEN 'Find' THEN 'FindDuplicate' WHEN 'Failed' THEN 'FailedCompensate' ELSE 'CompensateMotion' END AS named,
    CASE WHEN outcome = 'Ok' THEN 'chain' WHEN outcome = 'FailDuplicate' THEN 'duplicate' ELSE 'skipped' END AS kind
  FROM steps WHERE outcome IN ('Ok', 'FailDuplicate') OR (outcome IN ('FailLong', 'FailTooMuchMotion') AND state IN ('Find', 'Failed')) OR (outcome = 'CompensationRequired' AND state = 'Failed'))"""
#: Frames take the colour of the highest rank: replaced 5, added 4, replaced after failed compensation 3, skipped 2, duplicate 1.
PAINTED = f"""{LINES},
ranges AS (SELECT video_id, frame_num AS start, frame_num + 1 AS stop, 1 AS rank FROM said WHERE kind = 'duplicate'
  UNION ALL SELECT video_id, first + 1, last, 2 FROM said WHERE kind = 'skipped'
  UNION ALL SELECT video_id, first + 1, first + len - CASE state WHEN 'Compensate' THEN n_additional ELSE 0 END, CASE state WHEN 'Failed' THEN 3 ELSE 5 END FROM said WHERE kind = 'chain'
  UNION ALL SELECT video_id, first + len - n_additional, last, 4 FROM said WHERE kind = 'chain' AND state = 'Compensate'),
painted AS (SELECT video_id, frame_num, (['duplicate', 'skipped', 'failed', 'additional', 'replaced'])[max(rank)] AS color
  FROM (SELECT video_id, rank, unnest(range(start, stop)) AS frame_num FROM ranges WHERE start < stop) GROUP BY video_id, frame_num),
colors AS (SELECT video_id, color, min(frame_num) AS start, max(frame_num) + 1 AS stop FROM (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY frame_num) AS r
  FROM (SELECT *, CASE WHEN lag(frame_num) OVER w = frame_num - 1 AND lag(color) OVER w = color THEN 0 ELSE 1 END AS new FROM painted WINDOW w AS (PARTITION BY video_id ORDER BY frame_num))) GROUP BY video_id, color, r)"""
LAGS = f"""{FRAMES},
videos AS (SELECT video_id, count(*) AS n_frames FROM frames GROUP BY video_id),
cand AS (SELECT video_id, a, 1 + CAST('0x' || substr(md5(video_id || ':s:' || a || ':1'), 1, 12) AS BIGINT) % (n_frames - 9) AS start, 1 + CAST('0x' || substr(md5(video_id || ':l:' || a || ':1'), 1, 12) AS BIGINT) % 8 AS length
  FROM videos, range(24) t(a) WHERE n_frames > 9),
acc AS (SELECT video_id, CAST(0 AS BIGINT) AS a, CAST([] AS STRUCT(s BIGINT, l BIGINT)[]) AS taken FROM videos
  UNION ALL SELECT acc.video_id, acc.a + 1, CASE WHEN len(taken) >= 3 OR len(list_filter(taken, lambda t: t.s <= start + length + 1 AND start <= t.s + t.l + 1)) > 0 THEN taken
    ELSE list_append(taken, CAST(struct_pack(s := start, l := length) AS STRUCT(s BIGINT, l BIGINT))) END FROM acc JOIN cand ON cand.video_id = acc.video_id AND cand.a = acc.a),
lags AS (SELECT video_id, x.s AS start, x.l AS length FROM (SELECT video_id, unnest(taken) AS x FROM acc WHERE a = 24)),
lagged AS (SELECT video_id, start - 1 AS shown, unnest(range(start, start + length)) AS frame_num FROM lags)"""
THUMBS = """thumbs AS (SELECT vec_id AS frame_num, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS t FROM embeddings)"""
PAIRS = f"""{THUMBS},
two AS (SELECT b.frame_num, list_transform(range(1, len(a.t)), lambda i: CAST(a.t[i] < a.t[i + 1] AS INTEGER)) AS ha, list_transform(range(1, len(b.t)), lambda i: CAST(b.t[i] < b.t[i + 1] AS INTEGER)) AS hb, a.t AS ta, b.t AS tb FROM thumbs a JOIN thumbs b ON b.frame_num = a.frame_num + 1),
pairs AS (SELECT frame_num, list_sum(list_transform(range(1, len(ha) + 1), lambda i: CAST(ha[i] <> hb[i] AS INTEGER))) / CAST(63 AS DOUBLE) AS distance, list_sum(list_transform(range(1, len(ta) + 1), lambda i: abs(ta[i] - tb[i]))) / len(ta) AS motion FROM two)"""
GROUPS = """groups AS (SELECT source AS segment, doc_id // 40 AS frame_num, list(source || '/' || printf('%05d.png', doc_id) ORDER BY source || '/' || printf('%05d.png', doc_id)) AS paths FROM documents GROUP BY source, doc_id // 40),
adjacent AS (SELECT b.segment, b.frame_num, a.paths AS before, b.paths AS after FROM groups a JOIN groups b ON a.segment = b.segment AND b.frame_num = a.frame_num + 1)"""
_LOSS = {
    "bce": "greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))",
    "nll": "ln(exp(least(0.55, greatest(-3.3, x)) / 2) + 1e-6) + pow((l_discount - l_tax) / (exp(least(0.55, greatest(-3.3, x)) / 2) + 1e-6), 2) / 2 + 0.5 * ln(2 * pi())",
    "mse": "pow(l_discount - l_tax, 2)",
    "mae": "abs(l_discount - l_tax)",
    "smooth_l1": "CASE WHEN abs(l_discount - l_tax) < 0.65 THEN 0.5 * pow(l_discount - l_tax, 2) / 0.65 ELSE abs(l_discount - l_tax) - 0.325 END",
}

ORACLES: dict[str, str] = {
    "duplicate_frames": f"WITH {SCORES} SELECT video_id, frame_num, round(motion, 6) AS motion FROM scores WHERE 1 - conf >= 0.65",
    "simple_chains": f"WITH {CHAINS} SELECT video_id, chain_i, array_to_string(frames, ',') AS frames, end_frame, round(chain_motion, 6) AS chain_motion FROM chains",
    "frame_pairs_lag12": f"WITH {FRAMES} SELECT b.video_id, b.frame_num, CAST(b.frame_num - a.frame_num AS INTEGER) AS lag, a.frame_num AS frame_before, round(abs(b.value - a.value), 6) AS motion FROM frames a JOIN frames b ON a.video_id = b.video_id AND b.frame_num - a.frame_num IN (1, 2)",
    "luma": f"WITH {THUMBS}, bytes AS (SELECT frame_num, list_transform(t, lambda x: CAST(least(255, greatest(0, floor((x + 1) * CAST(127.5 AS DOUBLE)))) AS INTEGER)) AS b FROM thumbs) SELECT frame_num, array_to_string(list_transform(range(0, len(b) // 3), lambda i: (77 * b[3 * i + 1] + 150 * b[3 * i + 2] + 29 * b[3 * i + 3]) >> 8), ',') AS gray FROM bytes",
    "gradient_hash": f"WITH {THUMBS} SELECT frame_num, array_to_string(list_transform(range(1, len(t)), lambda i: CAST(t[i] < t[i + 1] AS INTEGER)), '') AS bits FROM thumbs",
    "hash_distance": f"WITH {PAIRS} SELECT frame_num, round(distance, 6) AS distance FROM pairs",
    "motion_mean_abs": f"WITH {PAIRS} SELECT frame_num, round(motion, 6) AS motion FROM pairs",
    "gated_distinct": f"WITH {PAIRS} SELECT frame_num, round(CASE WHEN distance < 0.45 THEN 1 / (1 + exp(-(8 * motion - 1))) ELSE 1 END, 6) AS distinct_conf FROM pairs",
    "sigmoid_scores": f"WITH {THUMBS} SELECT frame_num, round(1 / (1 + exp(-list_sum(t))), 6) AS score FROM thumbs",
    "extract_similar": f"WITH {PAIRS} SELECT frame_num FROM pairs WHERE distance >= 0.25 AND distance < 0.45 UNION ALL SELECT min(frame_num) - 1 FROM pairs HAVING arg_min(distance, frame_num) >= 0.25 AND arg_min(distance, frame_num) < 0.45",
    "select_frames": f"WITH RECURSIVE {LAGS}, t AS (SELECT video_id, min(start) AS s FROM lags GROUP BY video_id) SELECT f.video_id, f.frame_num, f.value FROM frames f JOIN t ON t.video_id = f.video_id AND f.frame_num IN (t.s, t.s - 1)",
    "frame_history": f"WITH {FRAMES} SELECT b.video_id, b.frame_num, coalesce(string_agg(CAST(a.frame_num AS VARCHAR), ',' ORDER BY a.frame_num), '') AS before FROM frames b LEFT JOIN frames a ON a.video_id = b.video_id AND a.frame_num BETWEEN b.frame_num - 5 AND b.frame_num - 1 GROUP BY b.video_id, b.frame_num",
    "flow_means": "WITH f AS (SELECT l_linenumber, l_discount * 5 - l_tax * 3 AS x, l_quantity / 50 - l_tax AS y FROM lineitem), m AS (SELECT l_linenumber, avg(x) AS a, avg(y) AS b, avg(greatest(sqrt(x * x + y * y), 0.2) - 0.2) AS m FROM f GROUP BY l_linenumber) SELECT l_linenumber, round(a, 6) AS avg_flow_x, round(b, 6) AS avg_flow_y, round(greatest(m, 0.0001) - 0.0001, 6) AS motion FROM m",
    "full_range": f"WITH {THUMBS} SELECT frame_num, array_to_string(list_transform(t, lambda v: CAST(floor((v - list_min(t)) / (list_max(t) - list_min(t)) * 255) AS BIGINT)), ',') AS bytes, round(CASE WHEN atan2(t[2], t[1]) < 0 THEN atan2(t[2], t[1]) + 2 * pi() ELSE atan2(t[2], t[1]) END, 6) AS direction FROM thumbs",
    "ema_final": f"WITH RECURSIVE {FRAMES}, e AS (SELECT video_id, frame_num, value AS ema FROM frames WHERE frame_num = 0 UNION ALL SELECT f.video_id, f.frame_num, f.value / 7 + (1 - 1 / CAST(7 AS DOUBLE)) * e.ema FROM e JOIN frames f ON f.video_id = e.video_id AND f.frame_num = e.frame_num + 1) SELECT video_id, round(arg_max(ema, frame_num), 6) AS ema FROM e GROUP BY video_id",
    "ema_running": f"WITH RECURSIVE {FRAMES}, e AS (SELECT video_id, frame_num, value AS ema FROM frames WHERE frame_num = 0 UNION ALL SELECT f.video_id, f.frame_num, f.value / 3 + (1 - 1 / CAST(3 AS DOUBLE)) * e.ema FROM e JOIN frames f ON f.video_id = e.video_id AND f.frame_num = e.frame_num + 1) SELECT video_id, frame_num, round(ema, 6) AS ema FROM e",
    "matcher_chains": f"WITH RECURSIVE {STEPS} SELECT video_id, chain_i, array_to_string(range(frame_num - len, frame_num), ',') AS frames, frame_num AS end_frame, state, n_additional, round(chain_motion, 6) AS chain_motion FROM steps WHERE outcome = 'Ok'",
    "matcher_outcomes": f"WITH RECURSIVE {STEPS} SELECT video_id, step, frame_num, len, state, outcome, round(chain_motion, 6) AS chain_motion FROM steps",
    "matcher_duplicates": f"WITH RECURSIVE {STEPS} SELECT DISTINCT video_id, frame_num FROM steps WHERE outcome = 'FailDuplicate'",
    "stream_matcher_outcomes": f"WITH RECURSIVE {STEPS} SELECT video_id, step, frame_num, len, state, outcome, round(chain_motion, 6) AS chain_motion FROM steps",
    "stream_release_order": f"WITH {CHAINS} SELECT video_id, chain_i, 'chain_' || chain_i AS out FROM chains",
    "interpolation_jobs": f"WITH {CHAINS}, j AS (SELECT *, unnest(range(1, len(frames))) AS k FROM chains) SELECT video_id, chain_i, CAST(k AS INTEGER) AS i, CAST(frames[1] AS VARCHAR) AS in0, CAST(end_frame AS VARCHAR) AS in1, printf('chain_%d/%03d.png', chain_i, k) AS out, round(k / CAST(len(frames) AS DOUBLE), 6) AS s, k = len(frames) - 1 AS is_last FROM j",
    "job_release_order": f"WITH {CHAINS}, d AS (SELECT video_id, chain_i, CAST('0x' || substr(md5(video_id || ':' || chain_i), 1, 6) AS BIGINT) AS done_at FROM chains) SELECT *, max(done_at) OVER (PARTITION BY video_id ORDER BY chain_i) AS released_at FROM d",
    "patch_ranges": f"WITH {CHAINS} SELECT video_id, chain_i, frames[2] AS start, frames[-1] - frames[2] + 1 AS length, array_to_string(list_transform(range(1, len(frames)), lambda i: printf('chain_%d/%03d.png', chain_i, i)), ',') AS imgs FROM chains",
    "patched_frames": f"WITH {CHAINS}, p AS (SELECT c.video_id, a.value AS v0, b.value AS v1, len(c.frames) AS n, unnest(range(1, len(c.frames))) AS i, c.frames FROM chains c JOIN frames a ON a.video_id = c.video_id AND a.frame_num = c.frames[1] JOIN frames b ON b.video_id = c.video_id AND b.frame_num = c.end_frame), q AS (SELECT video_id, frames[i + 1] AS frame_num, v0 + i / CAST(n AS DOUBLE) * (v1 - v0) AS patch FROM p) SELECT f.video_id, f.frame_num, round(coalesce(patch, value), 6) AS value, patch IS NOT NULL AS is_patched FROM frames f LEFT JOIN q ON q.video_id = f.video_id AND q.frame_num = f.frame_num",
    "inject_lags": f"WITH RECURSIVE {LAGS} SELECT * FROM lags",
    "lag_truth": f"WITH RECURSIVE {LAGS} SELECT video_id, frame_num, shown FROM lagged",
    "injected_frames": f"WITH RECURSIVE {LAGS} SELECT f.video_id, f.frame_num, round(coalesce(s.value, f.value), 6) AS value, l.shown IS NOT NULL AS is_lag FROM frames f LEFT JOIN lagged l ON l.video_id = f.video_id AND l.frame_num = f.frame_num LEFT JOIN frames s ON s.video_id = l.video_id AND s.frame_num = l.shown",
    "confusion_matrix": "WITH RECURSIVE " + LAGS + SCORES.removeprefix(FRAMES) + """, found AS (SELECT DISTINCT video_id, frame_num FROM scores WHERE 1 - conf >= 0.65),
u AS (SELECT video_id, frame_num, max(t) AS t, max(f) AS f FROM (SELECT video_id, frame_num, 1 AS t, 0 AS f FROM lagged UNION ALL SELECT video_id, frame_num, 0, 1 FROM found) GROUP BY video_id, frame_num),
g AS (SELECT u.video_id, sum(t * f) AS tp, sum((1 - t) * f) AS fp, sum(t * (1 - f)) AS fn, max(CASE WHEN f = 1 THEN frame_num END) AS last FROM u GROUP BY u.video_id)
SELECT g.video_id, CAST(greatest(coalesce((SELECT max(start + length) FROM lags WHERE lags.video_id = g.video_id), 0), coalesce(last, 0)) + 1 - tp - fp - fn AS BIGINT) AS true_negatives, CAST(tp AS BIGINT) AS true_positives, CAST(fn AS BIGINT) AS false_negatives, CAST(fp AS BIGINT) AS false_positives FROM g""",
    "precision_recall_f1": "WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality <> 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 0) AS tn FROM labels), r AS (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS p, tp / CAST(tp + fn AS DOUBLE) AS q FROM c) SELECT tn AS true_negatives, tp AS true_positives, fn AS false_negatives, fp AS false_positives, p AS precision, q AS recall, 2 * p * q / (p + q) AS f1_score FROM r",
    "log_lines": f"WITH RECURSIVE {LINES} SELECT video_id, step, CASE kind WHEN 'duplicate' THEN '[DEBUG] Found duplicate at #' || frame_num "
    "WHEN 'skipped' THEN '[DEBUG] Skipping duplicate chain #' || first || '-#' || last || ': #' || outcome || ', state: ' || named "
    "ELSE '[INFO] Duplicate chain ' || chain_i || ' found #' || first || '-#' || last || ', length: ' || len || ', diff: ' || diff4 || ', end_conf: ' || conf4 || ', chain_motion: ' || motion4 "
    "|| ', state: ' || named || CASE state WHEN 'Compensate' THEN ' { n_additional: ' || n_additional || ' }' ELSE '' END || ' at ' || at3 || 's' END AS line FROM said",
    "parse_log": f"WITH RECURSIVE {LINES} SELECT video_id, step, kind, CASE kind WHEN 'duplicate' THEN frame_num END AS frame, CASE kind WHEN 'chain' THEN chain_i END AS chain_i, CASE WHEN kind <> 'duplicate' THEN first END AS start, "
    "CASE WHEN kind <> 'duplicate' THEN last END AS \"end\", CASE kind WHEN 'chain' THEN CAST(len AS BIGINT) END AS length, CASE kind WHEN 'chain' THEN CAST(diff4 AS DOUBLE) END AS diff, CASE kind WHEN 'chain' THEN CAST(conf4 AS DOUBLE) END AS end_conf, "
    "CASE kind WHEN 'chain' THEN CAST(motion4 AS DOUBLE) END AS chain_motion, CASE WHEN kind <> 'duplicate' THEN named END AS state, CASE WHEN kind = 'chain' AND state = 'Compensate' THEN CAST(n_additional AS BIGINT) END AS n_additional, "
    "CASE kind WHEN 'chain' THEN CAST(at3 AS DOUBLE) END AS at_s, CASE kind WHEN 'skipped' THEN outcome END AS result FROM said",
    "painted_frames": f"WITH RECURSIVE {PAINTED} SELECT * FROM painted",
    "color_ranges": f"WITH RECURSIVE {PAINTED} SELECT * FROM colors",
    "clip_ranges": f"WITH RECURSIVE {PAINTED} SELECT video_id, color, greatest(start, 28) - 28 AS start, least(stop, 52) - 28 AS stop FROM colors WHERE stop > 28 AND start < 52",
    "video_params": f"WITH {FRAMES}, v AS (SELECT video_id, count(*) AS n, 30 + video_id % 31 AS a, video_id % 3 AS b FROM frames GROUP BY video_id), r AS (SELECT *, CASE WHEN b = 0 THEN CAST(0 AS DOUBLE) ELSE a / CAST(b AS DOUBLE) END AS rate FROM v) SELECT video_id, 2560 AS width, 1440 AS height, rate AS framerate, CAST(n AS DOUBLE) AS duration_s, CAST(floor(rate * n) AS BIGINT) AS total_frames FROM r",
    "segment_plan": f"WITH {FRAMES}, v AS (SELECT video_id, CAST(count(*) AS DOUBLE) AS d FROM frames GROUP BY video_id), p AS (SELECT *, CAST(least(4, floor((d - 5) / 15) + 1) AS INTEGER) AS n FROM v), q AS (SELECT *, (d - n * 5) / (n + 1) AS gap, unnest(range(0, n)) AS k FROM p WHERE n > 0) SELECT video_id, CAST(k AS INTEGER) AS i, round(gap * (k + 1) + k * 5, 6) AS start_s FROM q",
    "command_codec": "SELECT o_orderkey, 'gets|' || o_orderstatus || '|' || o_orderpriority AS cmd, 'gets' AS kind, 2 AS n_args, o_orderpriority AS last_arg FROM orders",
    "seek_frame": f"WITH {SCORES}, f AS (SELECT video_id, frame_num FROM scores WHERE coalesce(conf, 1) > 0) SELECT video_id, target, coalesce(min(frame_num) FILTER (frame_num >= target), max(frame_num)) AS frame_num FROM f, (SELECT unnest([0, 5, 17, 1000]) AS target) GROUP BY video_id, target",
    "seek_clip": f"WITH {FRAMES} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_num) - 1 AS frame_num, round(frame_num / CAST(60 AS DOUBLE), 6) AS ts_s, value FROM frames WHERE frame_num BETWEEN 15 AND 44",
    "frame_index": "WITH r AS (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 * CAST(24 AS DOUBLE) WHEN o_orderkey % 2 > 0 THEN CAST(25 AS DOUBLE) ELSE CAST(60 AS DOUBLE) END AS rate FROM orders) "
    "SELECT o_orderkey, rate, CAST(greatest(0, round_even(floor(o_totalprice) * CAST(0.001 AS DOUBLE) * rate, 0)) AS BIGINT) AS frame_num, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 ELSE CAST(floor(rate * (o_totalprice / 1000)) AS BIGINT) END AS n_frames FROM r",
    "parse_kwargs": "SELECT p_partkey, CAST(p_size AS BIGINT) AS size, round(p_size / CAST(2 AS DOUBLE), 6) AS half, p_size > 25 AS big, p_brand AS brand, 'none' AS none_kind, p_size AS width, p_size * 2 AS height, true AS bad_is_null FROM part",
    "overlapping_patches": f"WITH {CHAINS}, p AS (SELECT video_id, chain_i, frames[2] AS start, frames[-1] - frames[2] + 5 AS length FROM chains) SELECT b.video_id, b.chain_i, b.start, b.length FROM p b JOIN p a ON a.video_id = b.video_id AND a.chain_i = b.chain_i - 1 AND b.start < a.start + a.length",
    "denormalised": "SELECT l_orderkey, l_linenumber, round(CASE WHEN x > 0 THEN x ELSE 0 END, 6) AS target FROM (SELECT *, (l_quantity - 30) / 10 * (l_tax * 10) + l_discount AS x FROM lineitem)",
    "normalised_pixels": f"WITH {THUMBS}, b AS (SELECT frame_num, list_transform(t, lambda x: least(255, greatest(0, floor((x + 1) * CAST(127.5 AS DOUBLE))))) AS p FROM thumbs), d AS (SELECT y.frame_num, unnest(list_transform(range(1, len(y.p) + 1), lambda i: x.p[i] / 255 - y.p[i] / 255)) AS v "
    "FROM b x JOIN b y ON y.frame_num = x.frame_num + 1) SELECT frame_num, round(sum(v), 6) AS total, round(avg(abs(v)), 6) AS mean_abs FROM d GROUP BY frame_num",
    "boundary_frames": f"WITH {CHAINS}, e AS (SELECT video_id, chain_i, '0.webp' AS name, frames[1] AS frame_num FROM chains UNION ALL SELECT video_id, chain_i, '1.webp', end_frame FROM chains) SELECT e.*, f.value FROM e JOIN frames f ON f.video_id = e.video_id AND f.frame_num = e.frame_num",
    "split_counts": "SELECT k <= floor(n * 0.25) AS is_validation, count(*) AS n FROM (SELECT row_number() OVER () AS k, count(*) OVER () AS n FROM orders) GROUP BY 1",
    "variation_groups": f"WITH {GROUPS} SELECT segment, frame_num, array_to_string(paths, ',') AS paths FROM groups",
    "adjacent_pairs": f"WITH {GROUPS} SELECT segment, frame_num, array_to_string(before, ',') AS before, array_to_string(after, ',') AS after FROM adjacent",
    "same_cross_pairs": f"""WITH {GROUPS}, x AS (SELECT segment, frame_num, unnest(before) AS p, unnest(range(len(before))) AS i, 0 AS side FROM adjacent UNION ALL SELECT segment, frame_num, unnest(after), unnest(range(len(after))), 1 FROM adjacent),
same AS (SELECT a.segment, a.frame_num, a.p AS before, b.p AS after FROM x a JOIN x b ON a.segment = b.segment AND a.frame_num = b.frame_num AND a.side = b.side AND a.i < b.i UNION ALL SELECT segment, frame_num, before[1], before[1] FROM adjacent),
cross_ AS (SELECT a.segment, a.frame_num, a.p AS before, b.p AS after, row_number() OVER (PARTITION BY a.segment, a.frame_num ORDER BY md5(concat_ws('|', a.p, b.p, '1337'))) AS k FROM x a JOIN x b ON a.segment = b.segment AND a.frame_num = b.frame_num AND a.side = 0 AND b.side = 1)
SELECT before, after, false AS different FROM same UNION ALL SELECT c.before, c.after, true FROM cross_ c JOIN (SELECT segment, frame_num, count(*) AS n FROM same GROUP BY segment, frame_num) s ON s.segment = c.segment AND s.frame_num = c.frame_num WHERE c.k <= s.n""",
    "train_val_split": "SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), o_orderkey) <= floor(count(*) OVER () * 0.25) AS is_validation FROM orders",
    "motion_target_zscore": "WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_discount) <= 1e-7 THEN 0 ELSE 0.8 * l_discount + 0.2 * sqrt(l_tax * l_tax + 4 * l_tax * l_tax) END AS target FROM lineitem) SELECT l_orderkey, l_linenumber, round(target, 6) AS target, round((target - avg(target) OVER ()) / stddev_pop(target) OVER (), 6) AS z FROM t",
    "loss_metrics": "WITH r AS (SELECT *, (l_quantity - 25) / 10 AS x, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem), l AS (SELECT l_linenumber AS epoch, l_orderkey // 1000 AS batch, "
    + ", ".join(f"{c} AS {n}" for n, c in _LOSS.items())
    + " FROM r), b AS (SELECT epoch, batch, "
    + ", ".join(f"avg({n}) AS {n}" for n in _LOSS)
    + " FROM l GROUP BY epoch, batch), w AS (SELECT epoch, "
    + ", ".join(f"round(avg({n}), 6) AS {n}_of_rows" for n in _LOSS)
    + " FROM l GROUP BY epoch), v AS (SELECT epoch, "
    + ", ".join(f"round(avg({n}), 6) AS {n}_of_batches" for n in _LOSS)
    + " FROM b GROUP BY epoch) SELECT * FROM v JOIN w USING (epoch)",
}
_IMAGES = "(SELECT source || '/' || printf('%05d.png', doc_id) AS path, n_chars FROM documents)"
ORACLES["sample_images"] = (
    f"SELECT s.before, s.after, s.different, a.n_chars AS before_chars, b.n_chars AS after_chars FROM ({ORACLES['same_cross_pairs']}) s "
    f"JOIN {_IMAGES} a ON a.path = s.before JOIN {_IMAGES} b ON b.path = s.after"
)

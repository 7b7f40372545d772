"""The same queries as SQL text, for a second engine to check."""

from __future__ import annotations

_E = """
base AS (
  SELECT user_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i,
    count(*) OVER (PARTITION BY user_id) AS n,
    CASE WHEN event_type IN ('click', 'purchase') THEN 1 WHEN event_type IN ('signup', 'error') THEN 2 ELSE 0 END AS stim,
    CAST(floor((day(ts) - 1) / 5.0) + 1 AS INT) AS rep, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k
  FROM events),
smp AS (
  SELECT *, CASE WHEN i >= n - user_id % 4 THEN NULL WHEN value < 5 THEN 0 ELSE stim END AS restim,
    CASE WHEN i >= n - user_id % 4 THEN NULL WHEN value < 5 OR (user_id % 9 = 0 AND rep = 6) THEN 0 ELSE rep END AS rerep,
    CAST(floor(user_id / 3.0) + 1 AS INT) AS subject, CAST(user_id % 3 + 1 AS INT) AS exercise FROM base),
len AS (
  SELECT user_id, CAST(max(n) AS BIGINT) AS full_len, CAST(max(n) - greatest(least(user_id % 4, max(n)), 0) AS BIGINT) AS short_len FROM smp GROUP BY user_id),
"""
_ALIGNED = "ali AS (SELECT s.*, l.full_len, l.short_len FROM smp s JOIN len l ON s.user_id = l.user_id WHERE l.full_len - l.short_len <= 2 AND s.i < l.short_len),"
# What comes in for the audit, fault by fault: raw labels and positions, scalars, and the catalogue of variables; and what each check finds in it.
_NAMES = ("subject", "exercise", "emg", "stimulus", "restimulus", "repetition", "rerepetition")
_BAD = "coalesce(bool_or({0} IS NOT NULL AND (isnan({0}) OR isinf({0}) OR {0} <> round({0}) OR abs({0}) > 2147483647)), FALSE)"
_RAW = f"""
raw AS (
  SELECT user_id, i, CASE WHEN user_id % 47 = 0 AND i = 2 THEN 1 ELSE i END AS pos,
    CASE WHEN user_id % 29 = 0 AND i = 1 THEN CAST('nan' AS DOUBLE) ELSE stim + CASE WHEN user_id % 23 = 0 AND i = 0 THEN 0.5 ELSE CAST(0 AS DOUBLE) END END AS stimulus,
    CASE WHEN restim IS NOT NULL AND user_id % 37 = 0 AND i = 0 THEN CAST(3e9 AS DOUBLE) ELSE restim END AS restimulus,
    CASE WHEN user_id % 41 = 0 AND i = 1 THEN CAST('inf' AS DOUBLE) ELSE rep END AS repetition,
    CASE WHEN rerep IS NOT NULL AND user_id % 43 = 0 AND i = 0 THEN CAST(0.25 AS DOUBLE) ELSE rerep END AS rerepetition FROM smp),
flt AS (
  SELECT user_id, count(*) AS n_rows, count(DISTINCT pos) AS places, max(pos) + 1 AS ends, {", ".join(f"{_BAD.format(c)} AS {c}_invalid" for c in _NAMES[3:])}
  FROM raw GROUP BY user_id)
"""
_SCALARS = """
usr AS (SELECT DISTINCT user_id, CAST(floor(user_id / 3.0) + 1 AS INT) AS subject, CAST(user_id % 3 + 1 AS INT) AS exercise FROM events),
sca AS (
  SELECT user_id, 'subject' AS variable, CASE WHEN user_id % 53 = 0 THEN CAST(3e9 AS DOUBLE) ELSE subject + CASE WHEN user_id % 17 = 0 THEN CAST(1.9 AS DOUBLE) ELSE 0 END END AS x FROM usr, range(CASE WHEN user_id % 31 = 0 THEN 2 ELSE 1 END)
  UNION ALL SELECT user_id, 'exercise', CASE WHEN user_id % 59 = 0 THEN CAST('nan' AS DOUBLE) ELSE exercise + CASE WHEN user_id % 19 = 0 THEN 1 ELSE 0 END END FROM usr),
scv AS (
  SELECT user_id, variable, count(*) AS n, CASE WHEN count(*) = 1 AND NOT isnan(max(x)) AND NOT isinf(max(x)) THEN CAST(trunc(max(x)) AS BIGINT) END AS scalar,
    CASE WHEN count(*) <> 1 THEN variable || ' must contain one value, received (' || count(*) || ',)' WHEN isnan(max(x)) OR isinf(max(x)) THEN variable || ' must contain a finite value' END AS fault
  FROM sca GROUP BY user_id, variable)
"""
_CATALOGUE = f"""
req AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(_NAMES))}) t(k, variable)),
cat AS (SELECT user_id, variable FROM (SELECT DISTINCT user_id FROM events) u, req WHERE NOT (user_id % 13 = 0 AND variable IN ('rerepetition', 'subject'))),
mis AS (
  SELECT user_id, string_agg(variable, ', ' ORDER BY k) AS missing FROM (SELECT DISTINCT user_id FROM events) u, req
  WHERE NOT EXISTS (SELECT 1 FROM cat WHERE cat.user_id = u.user_id AND cat.variable = req.variable) GROUP BY user_id)
"""
_STOPPED = (
    _RAW + "," + _SCALARS + "," + _CATALOGUE
    + f""",
chk AS (
  SELECT l.*, CAST(floor(l.user_id / 3.0) + 1 AS INT) AS subject, CAST(l.user_id % 3 + 1 AS INT) AS exercise, s.scalar AS stored_subject, x.scalar AS stored_exercise,
    coalesce(missing, s.fault, x.fault, {", ".join(f"CASE WHEN {c}_invalid THEN '{c} must contain finite integer labels' END" for c in _NAMES[3:])},
      CASE WHEN ends > places THEN 'emg has a gap before its end' END, CASE WHEN n_rows > places THEN 'emg has repeated positions' END,
      CASE WHEN full_len - short_len > 2 THEN 'time-series length mismatch exceeds 2 sample(s): emg=' || full_len || ', stimulus=' || full_len || ', restimulus=' || short_len || ', repetition=' || full_len || ', rerepetition=' || short_len END) AS stop_detail,
    CASE WHEN missing IS NOT NULL THEN 'missing_variables' WHEN stop_detail IS NOT NULL THEN 'invalid_metadata' END AS stop_category
  FROM len l JOIN flt ON l.user_id = flt.user_id LEFT JOIN mis ON l.user_id = mis.user_id
    JOIN scv s ON l.user_id = s.user_id AND s.variable = 'subject' JOIN scv x ON l.user_id = x.user_id AND x.variable = 'exercise'),
ok AS (SELECT * FROM chk WHERE stop_category IS NULL),
ali AS (SELECT s.*, l.full_len, l.short_len FROM smp s JOIN ok l ON s.user_id = l.user_id WHERE s.i < l.short_len),
"""
)
_RUNS = """
chg AS (
  SELECT *, CASE WHEN lag(restim) OVER w IS NOT DISTINCT FROM restim AND lag(rerep) OVER w IS NOT DISTINCT FROM rerep AND i > 0 THEN 0 ELSE 1 END AS c
  FROM ali WINDOW w AS (PARTITION BY user_id ORDER BY i)),
isl AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM chg),
run AS (
  SELECT user_id, subject, exercise, restim AS movement, rerep AS repetition, min(i) AS start_sample, max(i) + 1 AS stop_sample
  FROM isl GROUP BY user_id, subject, exercise, r, restim, rerep),
trl AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id, movement, repetition ORDER BY start_sample) AS INT) AS segment_index,
    CAST(stop_sample - start_sample AS BIGINT) AS sample_count,
    CAST(CASE WHEN stop_sample - start_sample < 4 THEN 0 ELSE 1 + (stop_sample - start_sample - 4) // 2 END AS BIGINT) AS gw,
    CAST(CASE WHEN stop_sample - start_sample < 2 THEN 0 ELSE 1 + (stop_sample - start_sample - 2) // 1 END AS BIGINT) AS cw
  FROM run WHERE movement > 0 AND repetition > 0)
"""
_FILE = "'S' || CAST(subject AS VARCHAR) || '_E' || CAST(exercise AS VARCHAR) || '_A1.mat'"
_INVENTORY = f"""subject, exercise, {_FILE} AS file, 'refined' AS label_source, movement, repetition, segment_index, start_sample, stop_sample,
  sample_count, sample_count / 2000.0 AS duration_seconds"""
_SETS = """
lab AS (SELECT user_id, max(exercise) AS exercise, max(subject) AS subject, list_sort(list(DISTINCT restim) FILTER (WHERE restim > 0)) AS a, list_sort(list(DISTINCT rerep) FILTER (WHERE rerep > 0)) AS r FROM ali GROUP BY user_id),
cov AS (SELECT user_id, subject, exercise, '[' || coalesce(array_to_string(a, ', '), '') || ']' AS a, '[' || coalesce(array_to_string(r, ', '), '') || ']' AS r, CASE WHEN exercise = 3 THEN '[1, 2, 3]' ELSE '[1, 2]' END AS want FROM lab)
"""
_STATS_TAIL = """
fin AS (SELECT *, x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x) AS ok FROM lng),
prv AS (SELECT *, lag(x) OVER w AS px, lag(ok) OVER w AS pok FROM fin WINDOW w AS (PARTITION BY recording_id, channel ORDER BY i)),
mm AS (SELECT recording_id, channel, min(x) FILTER (WHERE ok) AS lo, max(x) FILTER (WHERE ok) AS hi FROM fin GROUP BY 1, 2),
st AS (
  SELECT p.recording_id, p.channel, CAST(count(*) AS BIGINT) AS sample_count, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS finite_count,
    CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS nonfinite_count,
    min(lo) AS lo, max(hi) AS hi, avg(x) FILTER (WHERE ok) AS mean, stddev_pop(x) FILTER (WHERE ok) AS sd, sqrt(avg(x * x) FILTER (WHERE ok)) AS rms,
    quantile_cont(x, 0.001) FILTER (WHERE ok) AS p001, quantile_cont(x, 0.01) FILTER (WHERE ok) AS p01, quantile_cont(x, 0.5) FILTER (WHERE ok) AS median,
    quantile_cont(x, 0.99) FILTER (WHERE ok) AS p99, quantile_cont(x, 0.999) FILTER (WHERE ok) AS p999,
    avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE ok) AS zf,
    coalesce(avg(CASE WHEN x = px THEN 1.0 ELSE 0.0 END) FILTER (WHERE ok AND pok), 0.0) AS flat,
    greatest(avg(CASE WHEN x = lo THEN 1.0 ELSE 0.0 END) FILTER (WHERE ok), avg(CASE WHEN x = hi THEN 1.0 ELSE 0.0 END) FILTER (WHERE ok)) AS ext
  FROM prv p JOIN mm m ON p.recording_id = m.recording_id AND p.channel = m.channel GROUP BY 1, 2)
"""
_STATS = """recording_id, CAST(channel AS INT) AS channel, sample_count, finite_count, nonfinite_count, round(lo, 6) AS minimum, round(hi, 6) AS maximum,
  round(mean, 6) AS mean, round(sd, 6) AS standard_deviation, round(rms, 6) AS rms, round(p001, 6) AS p001, round(p01, 6) AS p01, round(median, 6) AS median,
  round(p99, 6) AS p99, round(p999, 6) AS p999, round(zf, 6) AS zero_fraction, CASE WHEN finite_count > 0 THEN round(flat, 6) END AS flat_difference_fraction,
  round(ext, 6) AS extreme_repeat_fraction, CASE WHEN finite_count = 0 THEN TRUE ELSE lo = hi END AS constant_channel,
  CASE WHEN finite_count = 0 THEN FALSE ELSE lo <> hi AND ext >= 0.01 END AS potential_saturation"""
_L = """
ord AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS i FROM lineitem),
lng AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS recording_id, i, 1 AS channel, l_quantity AS x FROM ord
  UNION ALL SELECT CAST(l_suppkey AS VARCHAR), i, 2, l_extendedprice FROM ord
  UNION ALL SELECT CAST(l_suppkey AS VARCHAR), i, 3, l_discount FROM ord
  UNION ALL SELECT CAST(l_suppkey AS VARCHAR), i, 4, l_tax FROM ord),
"""
_M = """
ord AS (SELECT CAST(label AS VARCHAR) AS recording_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings),
lng AS (SELECT recording_id, i, unnest(range(1, len(embedding) + 1)) AS channel, CAST(unnest(embedding) AS DOUBLE) AS x FROM ord),
"""


def _chan(n: int, x: str) -> str:
    return f"SELECT CAST(user_id AS VARCHAR) AS recording_id, i, {n} AS channel, {x} AS x FROM ali"


_NAN = "CAST('nan' AS DOUBLE)"
_EX = ["value", "k", f"CASE WHEN value > 300 THEN {_NAN} ELSE value END", "CAST(1.0 AS DOUBLE)", f"CASE WHEN user_id % 7 = 0 THEN {_NAN} ELSE value END"]
_ELONG = "lng AS (" + " UNION ALL ".join(_chan(i + 1, x) for i, x in enumerate(_EX)) + "),"
_PATHS = """
u AS (SELECT DISTINCT user_id FROM events),
v AS (SELECT user_id, 1 AS a FROM u UNION ALL SELECT user_id, 2 FROM u WHERE user_id % 10 = 0),
q AS (SELECT user_id, a, CAST(floor(user_id / 3.0) + 1 AS INT) AS s, CAST(user_id % 3 + 1 AS INT) AS e FROM v),
p AS (
  SELECT *, 'DB/s' || CAST(s AS VARCHAR) || '/' || CASE WHEN user_id % 25 = 3 THEN 'bad_' ELSE '' END ||
    CASE WHEN user_id % 11 = 5 THEN 's' || CAST(s AS VARCHAR) || '_e' || CAST(e AS VARCHAR) || '_a' || CAST(a AS VARCHAR) || '.mat'
    ELSE 'S' || CAST(s AS VARCHAR) || '_E' || CAST(e AS VARCHAR) || '_A' || CAST(a AS VARCHAR) || '.mat' END AS path FROM q)
"""
_GOOD = "SELECT s AS subject, e AS exercise FROM p WHERE user_id % 25 <> 3"
_EXPECTED = "SELECT CAST(x AS INT) AS subject, CAST(y AS INT) AS exercise FROM (SELECT unnest(range(1, CAST(max(user_id) // 3 + 12 AS BIGINT))) AS x FROM events) t, range(1, 4) z(y)"
# Recordings of the audit: one file for each user, a second (without samples) for every tenth.
_REC = """
rec AS (
  SELECT user_id, CAST(floor(user_id / 3.0) + 1 AS INT) AS subject, CAST(user_id % 3 + 1 AS INT) AS exercise, 1 AS a, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes FROM events GROUP BY user_id
  UNION ALL SELECT user_id, CAST(floor(user_id / 3.0) + 1 AS INT), CAST(user_id % 3 + 1 AS INT), 2, CAST(sum(octet_length(encode(props))) AS BIGINT) FROM events WHERE user_id % 10 = 0 GROUP BY user_id),
"""
_ISSUES = f"""
xpd AS ({_EXPECTED}),
iss AS (
  SELECT 'error' AS severity, x.subject, x.exercise, CAST(NULL AS VARCHAR) AS file, 'missing_file' AS category, 'expected one MATLAB file' AS detail
    FROM xpd x WHERE NOT EXISTS (SELECT 1 FROM rec r WHERE r.subject = x.subject AND r.exercise = x.exercise)
  UNION ALL SELECT 'error', subject, exercise, NULL, 'duplicate_file', 'observed ' || CAST(count(*) AS VARCHAR) || ' MATLAB files' FROM rec GROUP BY subject, exercise HAVING count(*) > 1
  UNION ALL SELECT 'error', subject, exercise, {_FILE.replace("_A1", "_A2")}, 'load_failure', 'no samples' FROM rec WHERE a = 2
  UNION ALL SELECT 'error', subject, exercise, {_FILE}, stop_category, stop_detail FROM chk WHERE stop_category IS NOT NULL
  UNION ALL SELECT 'warning', subject, exercise, {_FILE}, 'trailing_length_alignment', 'aligned all streams to ' || CAST(short_len AS VARCHAR) || ' samples; removed trailing samples: emg=' || CAST(full_len - short_len AS VARCHAR)
    || ', stimulus=' || CAST(full_len - short_len AS VARCHAR) || ', repetition=' || CAST(full_len - short_len AS VARCHAR) FROM ok WHERE full_len > short_len
  UNION ALL SELECT 'error', subject, exercise, {_FILE}, 'subject_mismatch', 'filename=' || CAST(subject AS VARCHAR) || ', variable=' || CAST(stored_subject AS VARCHAR) FROM ok WHERE stored_subject <> subject
  UNION ALL SELECT 'error', subject, exercise, {_FILE}, 'exercise_mismatch', 'filename=' || CAST(exercise AS VARCHAR) || ', variable=' || CAST(stored_exercise AS VARCHAR) FROM ok WHERE stored_exercise <> exercise
  UNION ALL SELECT 'error', subject, exercise, {_FILE}, 'movement_coverage', 'observed=' || a || ', expected=' || want FROM cov WHERE a <> want
  UNION ALL SELECT 'error', subject, exercise, {_FILE}, 'repetition_coverage', 'observed=' || r || ', expected=[1, 2, 3, 4, 5, 6]' FROM cov WHERE r <> '[1, 2, 3, 4, 5, 6]'
  UNION ALL SELECT 'warning', subject, exercise, {_FILE}, 'fragmented_trial', 'movement=' || CAST(movement AS VARCHAR) || ', repetition=' || CAST(repetition AS VARCHAR) || ', segments=' || CAST(count(*) AS VARCHAR)
    FROM trl GROUP BY user_id, subject, exercise, movement, repetition HAVING count(*) > 1)
"""
_FILES = f"""
tn AS (SELECT user_id, count(*) AS c FROM trl GROUP BY user_id),
nf AS (SELECT user_id, sum(CASE WHEN value > 300 THEN 1 ELSE 0 END) + sum(CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END) AS c FROM ali GROUP BY user_id),
dis AS (SELECT user_id, count(*) FILTER (WHERE stim <> restim) AS d1, count(*) FILTER (WHERE rep <> rerep) AS d2 FROM ali GROUP BY user_id),
fil AS (
  SELECT o.user_id, CAST(o.user_id AS VARCHAR) AS recording_id, o.subject, o.exercise, 1 AS acquisition, {_FILE.replace("subject", "o.subject").replace("exercise", "o.exercise")} AS file,
    'DB/s' || CAST(o.subject AS VARCHAR) || '/' || {_FILE.replace("subject", "o.subject").replace("exercise", "o.exercise")} AS relative_path, r.bytes AS file_bytes,
    full_len AS original_emg_samples, full_len AS original_stimulus_samples, short_len AS original_restimulus_samples, full_len AS original_repetition_samples, short_len AS original_rerepetition_samples,
    CAST(3 * (full_len - short_len) AS BIGINT) AS trailing_samples_removed, full_len - short_len AS emg_samples_removed, full_len - short_len AS stimulus_samples_removed, CAST(0 AS BIGINT) AS restimulus_samples_removed,
    full_len - short_len AS repetition_samples_removed, CAST(0 AS BIGINT) AS rerepetition_samples_removed, short_len AS emg_samples, 5 AS emg_channels, 'float64' AS emg_dtype, 2000 AS sampling_rate_hz,
    short_len / 2000.0 AS recording_duration_seconds, coalesce(array_to_string(l.a, ';'), '') AS active_labels, coalesce(array_to_string(l.r, ';'), '') AS active_repetitions,
    CAST(coalesce(tn.c, 0) AS BIGINT) AS active_trial_segments, CAST(coalesce(nf.c, 0) AS BIGINT) AS nonfinite_emg_values,
    CAST(coalesce(d1, 0) AS BIGINT) AS stimulus_restimulus_disagreement_samples, CAST(coalesce(d2, 0) AS BIGINT) AS repetition_rerepetition_disagreement_samples
  FROM ok o JOIN rec r ON o.user_id = r.user_id AND r.a = 1 LEFT JOIN lab l ON o.user_id = l.user_id LEFT JOIN tn ON o.user_id = tn.user_id LEFT JOIN nf ON o.user_id = nf.user_id LEFT JOIN dis ON o.user_id = dis.user_id)
"""
# Flags of the five event channels, from value counts.
_FLAGS = (
    _ELONG
    + """
fn AS (SELECT * FROM lng WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)),
mm AS (SELECT recording_id, channel, min(x) AS lo, max(x) AS hi FROM fn GROUP BY 1, 2),
ex AS (SELECT f.recording_id, f.channel, min(lo) AS lo, max(hi) AS hi, greatest(avg(CASE WHEN x = lo THEN 1.0 ELSE 0.0 END), avg(CASE WHEN x = hi THEN 1.0 ELSE 0.0 END)) AS ext FROM fn f JOIN mm m ON f.recording_id = m.recording_id AND f.channel = m.channel GROUP BY 1, 2),
allc AS (SELECT o.user_id, o.subject, CAST(o.user_id AS VARCHAR) AS recording_id, c AS channel FROM ok o, range(1, 6) t(c)),
flg AS (SELECT a.user_id, a.subject, CASE WHEN e.lo IS NULL THEN 1 WHEN e.lo = e.hi THEN 1 ELSE 0 END AS constant, CASE WHEN e.lo IS NULL THEN 0 WHEN e.lo <> e.hi AND e.ext >= 0.001 THEN 1 ELSE 0 END AS sat
  FROM allc a LEFT JOIN ex e ON a.recording_id = e.recording_id AND a.channel = e.channel)
"""
)
_AUDIT = "WITH " + _E + _REC + _STOPPED + _RUNS + "," + _SETS + "," + _ISSUES + "," + _FILES
_PEOPLE = """
ppl AS (
  SELECT f.subject, count(*) AS file_count, count(DISTINCT exercise) AS exercise_count, CAST(sum(emg_samples) AS BIGINT) AS total_samples, CAST(sum(nonfinite_emg_values) AS BIGINT) AS nf FROM fil f GROUP BY f.subject)
"""
_SUMMARY = """
SELECT (SELECT count(DISTINCT subject) FROM fil) AS subject_count, (SELECT count(*) FROM fil) AS successfully_loaded_file_count,
  CAST((SELECT sum(emg_samples) FROM fil) AS BIGINT) AS total_emg_samples, (SELECT count(*) FROM trl) AS trial_segment_count, (SELECT count(*) FROM flg) AS channel_record_count,
  CAST((SELECT sum(nonfinite_emg_values) FROM fil) AS BIGINT) AS nonfinite_emg_values, (SELECT count(*) FROM fil WHERE trailing_samples_removed > 0) AS aligned_file_count,
  CAST((SELECT sum(emg_samples_removed) FROM fil) AS BIGINT) AS emg_tail_samples_removed, CAST((SELECT sum(stimulus_samples_removed + restimulus_samples_removed + repetition_samples_removed + rerepetition_samples_removed) FROM fil) AS BIGINT) AS label_tail_samples_removed,
  CAST((SELECT sum(stimulus_restimulus_disagreement_samples) FROM fil) AS BIGINT) AS stimulus_restimulus_disagreement_samples, CAST((SELECT sum(repetition_rerepetition_disagreement_samples) FROM fil) AS BIGINT) AS repetition_rerepetition_disagreement_samples,
  (SELECT count(*) FROM xpd) AS expected_file_count, (SELECT count(*) FROM rec) AS observed_file_count,
  CAST((SELECT sum(gw) FROM trl) AS BIGINT) AS generator_window_count, CAST((SELECT sum(cw) FROM trl) AS BIGINT) AS classifier_window_count,
  CAST((SELECT sum(constant) FROM flg) AS BIGINT) AS constant_channels, CAST((SELECT sum(sat) FROM flg) AS BIGINT) AS potential_saturation_channels,
  (SELECT count(*) FROM iss WHERE severity = 'error') AS error_count, (SELECT count(*) FROM iss WHERE severity = 'warning') AS warning_count,
  CASE WHEN (SELECT count(*) FROM iss WHERE severity = 'error') = 0 THEN 'pass' ELSE 'fail' END AS audit_status,
  round((SELECT sum(emg_samples) FROM fil) / 2000.0 / 3600.0, 6) AS total_recording_hours, 2000 AS sampling_rate_hz, 5 AS expected_channels, 'refined' AS label_source, 2 AS max_tail_mismatch_samples,
  CAST(1.0 AS DOUBLE) AS max_tail_mismatch_milliseconds, '{"length_samples":4,"step_samples":2}' AS generator_window, '{"length_samples":2,"step_samples":1}' AS classifier_window,
  (SELECT string_agg(CAST(subject AS VARCHAR), ';' ORDER BY subject) FROM (SELECT DISTINCT subject FROM xpd)) AS subjects_requested
"""
_T = "WITH " + _E + _ALIGNED + _RUNS
_INV = f"{_T} SELECT {_INVENTORY} FROM trl"
# Rows of the faulty positions: one of the streams lost at sample 1, sample 3 twice, sample 4 without a position.
_STREAMS = {"emg": "TRUE", "stimulus": "TRUE", "restimulus": "restim IS NOT NULL", "repetition": "TRUE", "rerepetition": "rerep IS NOT NULL"}
_PLACES = (
    "plc AS (SELECT user_id, CASE WHEN user_id % 11 = 4 AND i = 4 THEN NULL ELSE i END AS pos, "
    + ", ".join(f"{there} AND NOT (user_id % 5 = {k} AND i = 1) AS has_{name}" for k, (name, there) in enumerate(_STREAMS.items()))
    + " FROM smp, range(CASE WHEN user_id % 7 = 3 AND i = 3 THEN 2 ELSE 1 END))"
)
_PLACED = ", ".join(
    f"CAST(coalesce(max(pos + 1) FILTER (WHERE has_{n}), 0) AS BIGINT) AS {n}_length, CAST(coalesce(max(pos + 1) FILTER (WHERE has_{n}), 0) - count(DISTINCT pos) FILTER (WHERE has_{n}) AS BIGINT) AS {n}_missing, count(pos) FILTER (WHERE has_{n}) - count(DISTINCT pos) FILTER (WHERE has_{n}) AS {n}_repeated"
    for n in _STREAMS
)
_D = "SELECT source AS subject, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents"

SQL = {
    "trial_windows": f"{_T} SELECT {_INVENTORY}, 4 AS generator_length_samples, 2 AS generator_step_samples, gw AS generator_window_count, 2 AS classifier_length_samples, 1 AS classifier_step_samples, cw AS classifier_window_count FROM trl",
    "trial_inventory": _INV,
    "trial_inventory_chunked": _INV,
    "window_counts": f"{_T} SELECT CAST(user_id AS VARCHAR) AS recording_id, start_sample, sample_count, gw AS generator_window_count, cw AS classifier_window_count FROM trl",
    "fragmented_trials": f"{_T} SELECT CAST(user_id AS VARCHAR) AS recording_id, movement, repetition, count(*) AS segments FROM trl GROUP BY user_id, movement, repetition HAVING count(*) > 1",
    "stream_alignment": "WITH " + _E.rstrip().rstrip(",") + """ SELECT CAST(user_id AS VARCHAR) AS recording_id, full_len AS emg_length, full_len AS stimulus_length, short_len AS restimulus_length, full_len AS repetition_length, short_len AS rerepetition_length,
      short_len AS aligned_length, full_len - short_len <= 2 AS within_tolerance, CASE WHEN full_len - short_len > 2 THEN NULL WHEN full_len = short_len THEN ''
      ELSE 'emg=' || CAST(full_len - short_len AS VARCHAR) || ', stimulus=' || CAST(full_len - short_len AS VARCHAR) || ', repetition=' || CAST(full_len - short_len AS VARCHAR) END AS removed FROM len""",
    "stream_disagreement": "WITH " + _E + _ALIGNED.rstrip(",") + " SELECT CAST(user_id AS VARCHAR) AS recording_id, count(*) FILTER (WHERE stim <> restim) AS stimulus_restimulus_disagreement_samples, count(*) FILTER (WHERE rep <> rerep) AS repetition_rerepetition_disagreement_samples FROM ali GROUP BY user_id",
    "label_coverage": "WITH " + _E + _ALIGNED + _SETS + " SELECT CAST(user_id AS VARCHAR) AS recording_id, subject, exercise, 'observed=' || a || ', expected=' || want AS detail FROM cov WHERE a <> want",
    "repetition_coverage": "WITH " + _E + _ALIGNED + _SETS + " SELECT CAST(user_id AS VARCHAR) AS recording_id, subject, exercise, 'observed=' || r || ', expected=[1, 2, 3, 4, 5, 6]' AS detail FROM cov WHERE r <> '[1, 2, 3, 4, 5, 6]'",
    "channel_quality": f"WITH {_L} {_STATS_TAIL} SELECT {_STATS} FROM st",
    "channel_quality_rank": f"WITH {_L} {_STATS_TAIL} SELECT {_STATS} FROM st",
    "channel_quality_arrays": f"WITH {_M} {_STATS_TAIL} SELECT {_STATS} FROM st",
    "channel_quality_nonfinite": f"WITH {_E} {_ALIGNED} {_ELONG} {_STATS_TAIL} SELECT {_STATS} FROM st",
    "saturation_candidates": f"WITH {_L} {_STATS_TAIL}, z AS (SELECT {_STATS} FROM st) SELECT recording_id, channel, minimum, maximum, extreme_repeat_fraction FROM z WHERE potential_saturation",
    "missing_recordings": f"WITH {_PATHS} SELECT subject, exercise FROM ({_EXPECTED}) x WHERE NOT EXISTS (SELECT 1 FROM ({_GOOD}) g WHERE g.subject = x.subject AND g.exercise = x.exercise)",
    "duplicate_recordings": f"WITH {_PATHS} SELECT subject, exercise, count(*) AS files FROM ({_GOOD}) g GROUP BY subject, exercise HAVING count(*) > 1",
    "parse_identity": f"WITH {_PATHS}, f AS (SELECT path, regexp_extract(path, '[^/]+$') AS file FROM p) SELECT path, file, " + ", ".join(f"TRY_CAST(regexp_extract(file, '^S([0-9]+)_E([0-9]+)_A([0-9]+)\\.mat$', {i}, 'i') AS INT) AS {n}" for i, n in ((1, "subject"), (2, "exercise"), (3, "acquisition"))) + " FROM f",
    "identity_mismatch": f"WITH {_REC.rstrip().rstrip(',')} SELECT subject, exercise, replace({_FILE}, '_A1', '_A' || CAST(a AS VARCHAR)) AS file, 'subject_mismatch' AS category, 'filename=' || CAST(subject AS VARCHAR) || ', variable=' || CAST(subject + 1 AS VARCHAR) AS detail FROM rec WHERE user_id % 17 = 0 UNION ALL SELECT subject, exercise, replace({_FILE}, '_A1', '_A' || CAST(a AS VARCHAR)), 'exercise_mismatch', 'filename=' || CAST(exercise AS VARCHAR) || ', variable=' || CAST(exercise + 1 AS VARCHAR) FROM rec WHERE user_id % 19 = 0",
    "label_validity": f"WITH {_E} {_RAW} SELECT CAST(user_id AS VARCHAR) AS recording_id, {', '.join(f'{c}_invalid' for c in _NAMES[3:])} FROM flt",
    "position_integrity": f"WITH {_E} {_PLACES} SELECT CAST(user_id AS VARCHAR) AS recording_id, count(*) FILTER (WHERE pos IS NULL) AS misplaced, {_PLACED} FROM plc GROUP BY user_id",
    "scalar_validity": f"WITH {_SCALARS} SELECT CAST(user_id AS VARCHAR) AS recording_id, variable, n AS values_received, scalar, fault IS NOT NULL AS invalid FROM scv",
    "missing_variables": f"WITH {_CATALOGUE} SELECT CAST(user_id AS VARCHAR) AS recording_id, missing FROM mis",
    "channel_count_check": "SELECT CAST(label AS VARCHAR) AS recording_id, CASE WHEN min(len(embedding)) <> max(len(embedding)) THEN 'invalid_emg_shape' ELSE 'channel_count' END AS category, CASE WHEN min(len(embedding)) <> max(len(embedding)) THEN 'channels vary from ' || CAST(min(len(embedding)) AS VARCHAR) || ' to ' || CAST(max(len(embedding)) AS VARCHAR) ELSE 'observed=' || CAST(max(len(embedding)) AS VARCHAR) || ', expected=12' END AS detail FROM embeddings GROUP BY label HAVING min(len(embedding)) <> max(len(embedding)) OR max(len(embedding)) <> 12",
    "issues": f"{_AUDIT} SELECT * FROM iss",
    "file_inventory": f"{_AUDIT} SELECT * EXCLUDE (user_id) FROM fil",
    "participant_summary": f"{_AUDIT}, {_FLAGS}, {_PEOPLE} SELECT p.subject, file_count, exercise_count, total_samples, round(total_samples / 2000.0, 6) AS total_duration_seconds, CAST(coalesce(g, 0) AS BIGINT) AS generator_window_count, CAST(coalesce(c, 0) AS BIGINT) AS classifier_window_count, nf AS nonfinite_emg_values, CAST(coalesce(k, 0) AS BIGINT) AS constant_channels, CAST(coalesce(s, 0) AS BIGINT) AS potential_saturation_channels, CAST(coalesce(n, 0) AS BIGINT) AS issue_count FROM ppl p LEFT JOIN (SELECT subject, sum(gw) AS g, sum(cw) AS c FROM trl GROUP BY subject) w ON p.subject = w.subject LEFT JOIN (SELECT subject, sum(constant) AS k, sum(sat) AS s FROM flg GROUP BY subject) f ON p.subject = f.subject LEFT JOIN (SELECT subject, count(*) AS n FROM iss GROUP BY subject) i ON p.subject = i.subject",
    "dataset_summary": f"{_AUDIT}, {_FLAGS} {_SUMMARY}",
    "rollup_levels": f"{_AUDIT}, {_FLAGS}, w AS (SELECT user_id, sum(gw) AS g, sum(cw) AS c FROM trl GROUP BY user_id), q AS (SELECT user_id, sum(constant) AS k, sum(sat) AS p FROM flg GROUP BY user_id) SELECT subject, recording_id, CAST(grouping(subject) * 2 + grouping(recording_id) AS INT) AS level, count(*) AS files, CAST(sum(emg_samples) AS BIGINT) AS samples, CAST(sum(coalesce(g, 0)) AS BIGINT) AS generator_windows, CAST(sum(coalesce(c, 0)) AS BIGINT) AS classifier_windows, CAST(sum(nonfinite_emg_values) AS BIGINT) AS nonfinite_values, CAST(sum(coalesce(k, 0)) AS BIGINT) AS constant_channels, CAST(sum(coalesce(p, 0)) AS BIGINT) AS potential_saturation_channels FROM fil f LEFT JOIN w ON f.user_id = w.user_id LEFT JOIN q ON f.user_id = q.user_id GROUP BY ROLLUP (subject, recording_id)",
    "audit_report_lines": f"{_AUDIT}, {_FLAGS}, sm AS ({_SUMMARY})" + """
      SELECT CAST(k - 1 AS INT) AS line_no, l[k] AS line FROM (SELECT [
        'DATA AUDIT',
        '==========',
        'Status: ' || upper(audit_status),
        'Source directory: DB',
        'Primary labels: refined',
        'Terminal alignment limit: 2 samples (1.000 ms)',
        '',
        'DATA ACCOUNTING',
        'Subjects: ' || subject_count,
        'MATLAB files: ' || successfully_loaded_file_count || ' loaded / ' || expected_file_count || ' expected',
        'Trial segments: ' || trial_segment_count,
        'Total EMG samples: ' || total_emg_samples,
        'Total recording hours: ' || printf('%.3f', total_recording_hours),
        '',
        'WINDOW ACCOUNTING',
        'Generator windows: ' || generator_window_count,
        'Classifier windows: ' || classifier_window_count,
        '',
        'QUALITY SCREEN',
        'Non-finite EMG values: ' || nonfinite_emg_values,
        'Constant channel records: ' || constant_channels,
        'Potential saturation channel records: ' || potential_saturation_channels,
        'Stimulus/restimulus disagreement samples: ' || stimulus_restimulus_disagreement_samples,
        'Repetition/rerepetition disagreement samples: ' || repetition_rerepetition_disagreement_samples,
        'Files aligned at the terminal boundary: ' || aligned_file_count,
        'EMG tail samples removed: ' || emg_tail_samples_removed,
        'Label tail samples removed: ' || label_tail_samples_removed,
        'Errors: ' || error_count,
        'Warnings: ' || warning_count,
        '',
        'Interpret potential saturation as a screening flag, not an exclusion rule.',
        'Review issues.csv and participant_summary.csv before creating splits.'] AS l FROM sm) x, range(1, 33) t(k)
    """,
    "content_manifest": "SELECT source AS subject, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM documents",
    "source_completeness": f"SELECT subject, count(*) AS file_count, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) = 50 AS complete FROM ({_D}) d GROUP BY subject",
    "collection_totals": f"SELECT count(DISTINCT subject) AS subject_count, count(*) AS file_count, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(DISTINCT subject) = 20 AND count(*) = 1000 AS complete FROM ({_D}) d",
}

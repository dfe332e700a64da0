"""The flagship question: 24 h ahead, which exceedance hours were alarmed, how long, how early?"""

from pyspark.sql import functions as F

from ..operators.metrics import block_hours, calibrate_cuts, duration_metrics, event_metrics, lead_time
from ..session import stage
from .registry import query

KEYS = ["series_id", "model", "horizon_h", "threshold"]


def scorecard(t):
    """Cuts from the validation part, scores on the test part, one row per key."""
    f = stage(t.fct())  # read by five aggregations below
    cuts = stage(calibrate_cuts(f.where("split = 'val'"), KEYS).select(*KEYS, F.round("cut", 6).alias("cut")))
    test = f.where("split = 'test'").join(cuts, KEYS)
    ev = event_metrics(test, KEYS).select(*KEYS, "n_event", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))
    du = duration_metrics(block_hours(test, KEYS), KEYS).select(
        *KEYS, "n_event_window", F.round("joint_dur_mae_h", 6).alias("joint_dur_mae_h"))
    le = lead_time(test, KEYS).select(*KEYS, "n_onset", "n_warned", F.round("mean_lead_h", 6).alias("mean_lead_h"))
    return ev.join(du, KEYS, "left").join(le, KEYS, "left")


CUTS_SQL = """cuts AS (SELECT series_id, model, horizon_h, threshold, br, round(CASE WHEN br > 0
    THEN qs[CAST(lo AS INT) + 1] + (qs[CAST(hi AS INT) + 1] - qs[CAST(lo AS INT) + 1]) * (pos - lo) ELSE threshold END, 6) AS cut
  FROM (SELECT *, floor(pos) AS lo, ceil(pos) AS hi FROM (
     SELECT series_id, model, horizon_h, threshold, list_sort(list(y_pred)) AS qs, avg(CASE WHEN y_true >= threshold THEN 1e0 ELSE 0e0 END) AS br,
       (1 - avg(CASE WHEN y_true >= threshold THEN 1e0 ELSE 0e0 END)) * (count(*) - 1) AS pos
     FROM fct WHERE split = 'val' GROUP BY 1, 2, 3, 4)))"""
TEST_SQL = "test AS (SELECT f.*, c.cut FROM fct f JOIN cuts c USING (series_id, model, horizon_h, threshold) WHERE split = 'test')"
BLOCK_SQL = """blk AS (SELECT b.* FROM (SELECT series_id, model, horizon_h, threshold, CAST(floor(epoch(valid_ts) / 86400) AS BIGINT) AS block,
    count(*) FILTER (y_true >= threshold) AS a, count(*) FILTER (y_pred >= cut) AS b FROM test GROUP BY 1, 2, 3, 4, 5) b
  JOIN (SELECT series_id, model, horizon_h, threshold, max(epoch(valid_ts)) AS last_s FROM test GROUP BY 1, 2, 3, 4) z
    USING (series_id, model, horizon_h, threshold) WHERE (block + 1) * 86400 <= last_s + 3600)"""
LEAD_SQL = """onset AS (SELECT t.*, (SELECT count(*) FROM test q WHERE q.series_id = t.series_id AND q.model = t.model AND q.horizon_h = t.horizon_h
      AND q.threshold = t.threshold AND q.valid_ts = t.valid_ts - INTERVAL 1 HOUR AND q.y_true >= q.threshold) AS prev
   FROM test t WHERE y_true >= threshold),
  led AS (SELECT o.series_id, o.model, o.horizon_h, o.threshold, o.valid_ts, s.start_ts,
      (SELECT min(q.valid_ts) FROM test q WHERE q.series_id = o.series_id AND q.model = o.model AND q.horizon_h = o.horizon_h
        AND q.threshold = o.threshold AND q.valid_ts < o.valid_ts AND q.valid_ts >= o.valid_ts - INTERVAL 72 HOUR AND q.y_pred >= q.cut) AS first_ts
    FROM onset o JOIN (SELECT series_id, model, horizon_h, threshold, min(valid_ts) AS start_ts FROM test GROUP BY ALL) s
      USING (series_id, model, horizon_h, threshold) WHERE prev = 0),
  leads AS (SELECT series_id, model, horizon_h, threshold, valid_ts, CASE WHEN valid_ts - start_ts >= INTERVAL 72 HOUR
      THEN (epoch(valid_ts) - epoch(first_ts)) / 3600e0 END AS lead_h FROM led)"""

query("slice0_alarm_scorecard", f"""WITH {CUTS_SQL}, {TEST_SQL}, {BLOCK_SQL}, {LEAD_SQL},
  ev AS (SELECT series_id, model, horizon_h, threshold, count(*) FILTER (y_true >= threshold) AS n_event,
      count(*) FILTER (y_true >= threshold AND y_pred >= cut) AS tp, count(*) FILTER (y_true < threshold AND y_pred >= cut) AS fp,
      count(*) FILTER (y_true >= threshold AND y_pred < cut) AS fn FROM test GROUP BY ALL),
  du AS (SELECT series_id, model, horizon_h, threshold, count(*) FILTER (a > 0) AS n_event_window,
      round(avg(CASE WHEN a > 0 AND b > 0 THEN abs(b - a) WHEN a > 0 THEN a WHEN b > 0 THEN b END), 6) AS joint_dur_mae_h FROM blk GROUP BY ALL),
  le AS (SELECT series_id, model, horizon_h, threshold, count(*) AS n_onset, count(lead_h) AS n_warned, round(avg(lead_h), 6) AS mean_lead_h
      FROM leads GROUP BY ALL)
  SELECT ev.*, round(CASE WHEN 2*tp+fp+fn > 0 THEN 2e0*tp/(2*tp+fp+fn) ELSE 0e0 END, 6) AS f1, du.n_event_window, du.joint_dur_mae_h,
    coalesce(le.n_onset, 0) AS n_onset, coalesce(le.n_warned, 0) AS n_warned, le.mean_lead_h
  FROM ev LEFT JOIN du USING (series_id, model, horizon_h, threshold) LEFT JOIN le USING (series_id, model, horizon_h, threshold)""")(scorecard)

"""DuckDB SQL of the curation, label, quality and calibration queries."""

from rallyloom.plans.oracles_events import BALL

SIG = """sg AS (SELECT vec_id % 4 AS clip, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1 AS f, embedding::DOUBLE[] AS e FROM embeddings),
raw AS (SELECT clip, f, coalesce(list_sum(list_transform(list_zip(e, p), lambda z: abs(z[1] - z[2]))) / len(e), 0::DOUBLE) AS r FROM (SELECT *, lag(e) OVER (PARTITION BY clip ORDER BY f) AS p FROM sg)),
chg AS (SELECT clip, f, round_even(r, 8) AS s FROM raw),
mot AS (SELECT clip, f, round_even(avg(r) OVER (PARTITION BY clip ORDER BY f ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 8) AS s FROM raw)"""


def spaced(source: str, name: str, quota: int, spacing: int) -> str:
    """Greedy selection, one candidate a step."""
    return f"""{name}_o AS (SELECT clip, f, row_number() OVER (PARTITION BY clip ORDER BY s DESC, f) AS rn FROM {source}),
{name} AS (SELECT clip, 0::BIGINT AS rn, []::BIGINT[] AS sel FROM (SELECT DISTINCT clip FROM {name}_o) UNION ALL
  SELECT o.clip, o.rn, CASE WHEN len(s.sel) < {quota} AND len(list_filter(s.sel, lambda q: abs(q - o.f) < {spacing})) = 0 THEN list_append(s.sel, o.f) ELSE s.sel END
  FROM {name} s JOIN {name}_o o ON s.clip = o.clip AND o.rn = s.rn + 1),
{name}_x AS (SELECT clip, unnest(sel) AS f, generate_subscripts(sel, 1) AS rank FROM (SELECT clip, arg_max(sel, rn) AS sel FROM {name} GROUP BY 1))"""


POS = spaced("mot", "pos", 22, 3)
EVT = spaced("chg", "evt", 12, 10)
PRB = spaced("chg", "prb", 4, 10)
HITS = """hits AS (SELECT l_returnflag AS clip, l_orderkey AS fid, l_linenumber AS ord, round_even(fmod(l_extendedprice, 1280::DOUBLE) / 40, 0) * 40::DOUBLE AS bx, round_even(fmod(20::DOUBLE * l_quantity, 720::DOUBLE) / 40, 0) * 40::DOUBLE AS by_ FROM lineitem),
hot AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY n DESC, first, bx, by_) AS rank FROM (SELECT clip, bx, by_, count(*) AS n, count(DISTINCT fid) AS frames, min(struct_pack(a := fid, b := ord)) AS first FROM hits GROUP BY 1, 2, 3))"""
NEG = """pool AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY s, f) AS p, count(*) OVER (PARTITION BY clip) AS n FROM mot ANTI JOIN pos_x ON mot.clip = pos_x.clip AND mot.f = pos_x.f),
neg AS (SELECT clip, f, s FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY md5('42|' || clip || '|' || f)) AS k FROM pool WHERE p <= greatest(30, n // 2)) WHERE k <= 10)"""
RND2 = """r2 AS (SELECT clip, f, row_number() OVER (PARTITION BY clip ORDER BY k) AS pos FROM (SELECT clip, f, min(struct_pack(a := rank, b := o)) AS k FROM (
  SELECT clip, rank, f - [1, 3, 5, 7][o] AS f, o FROM evt_x, range(1, 5) t(o)) x WHERE f >= 0 AND NOT EXISTS (SELECT 1 FROM pos_x WHERE pos_x.clip = x.clip AND pos_x.f = x.f) GROUP BY 1, 2) QUALIFY pos <= 35)"""


def split(name: str, seed: int) -> str:
    return f"""{name} AS (SELECT doc_id AS frame_id, source AS clip, lang AS selection_reason,
  CASE WHEN row_number() OVER (PARTITION BY source, lang ORDER BY md5('{seed}|' || doc_id), doc_id) <= greatest(1, round_even(count(*) OVER (PARTITION BY source, lang) * 0.15::DOUBLE, 0)) THEN 'val' ELSE 'train' END AS split FROM documents)"""


TIERS = """tr AS (SELECT d.doc_id AS frame_id, CASE WHEN (n_chars % 100) / 100::DOUBLE >= 0.5 THEN 'tier1' WHEN l.doc_id IS NULL OR toxic = 1 THEN 'tier3'
  WHEN quality = 1 AND n_chars % 3 <> 0 THEN 'tier2_positive' WHEN quality <> 1 THEN 'tier2_negative' ELSE 'tier3' END AS tier FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
BOXES = """bx AS (SELECT *, x1 + 10::DOUBLE + 100::DOUBLE * l_discount AS x2, y1 + 10::DOUBLE + 100::DOUBLE * l_tax AS y2, 1::DOUBLE - l_discount - l_tax AS confidence FROM (
  SELECT l_orderkey AS frame_id, l_linenumber AS ord, fmod(l_extendedprice, 1200::DOUBLE) AS x1, 10::DOUBLE * l_quantity AS y1, l_discount, l_tax FROM lineitem))"""
YOLO = f"""{BOXES}, yo AS (SELECT frame_id, ord, ((x1 + x2) / 2::DOUBLE) / 1280::DOUBLE AS xc, ((y1 + y2) / 2::DOUBLE) / 720::DOUBLE AS yc, abs(x2 - x1) / 1280::DOUBLE AS w, abs(y2 - y1) / 720::DOUBLE AS h FROM bx)"""
SAMPLES = """tot AS (SELECT user_id % 4 AS clip, count(*) AS total FROM events GROUP BY 1), mar AS (SELECT *, greatest(1, floor(total * 0.02::DOUBLE)::BIGINT) AS m FROM tot)"""
POINTS = "(VALUES ('baseline_near_left', 0, 0), ('baseline_near_right', 9, 0), ('attackline_near_left', 0, 3), ('attackline_near_right', 9, 3), ('net_left', 0, 9), ('net_right', 9, 9), ('attackline_far_left', 0, 15), ('attackline_far_right', 9, 15), ('baseline_far_left', 0, 18), ('baseline_far_right', 9, 18))"
FRAME = "source || '/' || printf('frame_%05d.jpg', doc_id)"
STEM = "source || '_' || printf('frame_%05d', doc_id)"



def _raw_py(y: str) -> str:
    return f"(({y} + 6) / (0.04::DOUBLE - 0.0002::DOUBLE * {y}))"


def _py(y: str) -> str:
    return f"floor({_raw_py(y)} * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE"


def _px(x: str, y: str) -> str:
    return f"floor((({x} * (0.0002::DOUBLE * {_raw_py(y)} + 1) + 2) / 0.01::DOUBLE) * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE"


ORACLES: dict[str, str] = {
    "motion_scores": f"WITH {SIG} SELECT clip, f AS frame_idx, s AS score FROM mot",
    "change_scores": f"WITH {SIG} SELECT clip, f AS frame_idx, s AS raw FROM chg",
    "positives_spaced": f"WITH RECURSIVE {SIG}, {POS} SELECT clip, f AS frame_idx FROM pos_x",
    "change_events_topk": f"WITH RECURSIVE {SIG}, {EVT} SELECT clip, f AS frame_idx, rank FROM evt_x",
    "event_probe": f"WITH RECURSIVE {SIG}, {PRB} SELECT clip, rank, printf('frame_%05d.jpg', f) AS frame_name, printf('frame_%05d.jpg', greatest(0, f - 1)) AS preceding FROM prb_x",
    "fp_hotspots": f"WITH {HITS} SELECT clip, bx, by_ AS \"by\", n, frames, rank FROM hot",
    "fp_negatives": f"""WITH {HITS}, ch AS (SELECT clip, fid, row_number() OVER (PARTITION BY clip ORDER BY r, fid) AS pos FROM (SELECT h.clip, fid, min(rank) AS r FROM hits h JOIN hot ON h.clip = hot.clip AND h.bx = hot.bx AND h.by_ = hot.by_ GROUP BY 1, 2) QUALIFY pos <= 30)
SELECT clip, fid AS frame_id, pos FROM ch ANTI JOIN (SELECT o_orderkey AS fid FROM orders WHERE o_orderpriority = '1-URGENT') o ON ch.fid = o.fid""",
    "random_negatives": f"WITH RECURSIVE {SIG}, {POS}, {NEG} SELECT clip, f AS frame_idx, s AS score FROM neg",
    "round2_candidates": f"WITH RECURSIVE {SIG}, {POS}, {EVT}, {RND2} SELECT clip, f AS frame_idx, pos FROM r2",
    "candidate_union": f"""WITH RECURSIVE {SIG}, {POS}, {EVT}, {RND2}, {NEG} SELECT clip, f AS frame_idx, 'motion_candidate' AS selection_reason, 0 AS kind_rank FROM pos_x
UNION ALL SELECT clip, f, 'pre_score_change', 1 FROM r2 UNION ALL SELECT clip, f, 'random_negative', 2 FROM neg""",
    "stratified_split": f"WITH {split('sp', 42)} SELECT * FROM sp",
    "interleaved_manifest": """SELECT doc_id AS frame_id, source AS clip, lang AS selection_reason, row_number() OVER (ORDER BY lang, t, source) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS t FROM documents)""",
    "manifest_counts": f"""WITH {split('sp', 42)} SELECT CASE WHEN grouping(selection_reason) = 0 THEN 'selection_reason' WHEN grouping(split) = 0 THEN 'split' ELSE 'clip' END AS "by",
coalesce(selection_reason, split, clip) AS key, count(*) AS n FROM sp GROUP BY GROUPING SETS ((selection_reason), (split), (clip))""",
    "unlabelled": "SELECT doc_id AS frame_id, source AS clip FROM documents ANTI JOIN labels USING (doc_id)",
    "labelled_images": "SELECT doc_id AS frame_id, source AS clip FROM documents SEMI JOIN labels USING (doc_id)",
    "scan_exclusion": "SELECT doc_id AS frame_id, source || '_' || doc_id AS key FROM documents WHERE source || '_' || doc_id NOT IN (SELECT 'src' || (item_id % 20) || '_' || item_id FROM benchmark)",
    "frame_names": f"SELECT doc_id AS frame_id, {FRAME} AS frame, source AS clip, printf('frame_%05d.jpg', doc_id) AS name, {STEM} AS stem, 'data/train/labels/' || {STEM} || '.txt' AS label_path, 'image/jpeg' AS mime FROM documents",
    "bootstrap_tiers": f"WITH {TIERS} SELECT * FROM tr",
    "tier_counts": f"WITH {TIERS} SELECT tier, count(*) AS n FROM tr GROUP BY 1",
    "precision_recall": """WITH s AS (SELECT lang, sum(CASE WHEN p AND t THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN p AND NOT t THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN NOT p AND t THEN 1 ELSE 0 END)::BIGINT AS fn
FROM (SELECT lang, n_chars >= 500 AS p, quality = 1 AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1)
SELECT lang, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 'nan'::DOUBLE ELSE round_even(tp::DOUBLE / (tp + fp), 6) END AS precision, CASE WHEN tp + fn = 0 THEN 'nan'::DOUBLE ELSE round_even(tp::DOUBLE / (tp + fn), 6) END AS recall FROM s""",
    "counts_per_frame": "SELECT o_orderkey AS frame_id, count(*) FILTER (l_returnflag = 'N') AS player_boxes, count(*) FILTER (l_returnflag <> 'N') AS ball_boxes FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "split_leakage": f"WITH {split('a', 42)}, {split('b', 7)} SELECT a.frame_id AS stem, 'train,val' AS splits, 2::BIGINT AS n FROM a JOIN b ON a.frame_id = b.frame_id WHERE a.split = 'train' AND b.split = 'val'",
    "best_candidate": f"WITH {BOXES} SELECT frame_id, ord, round_even(x1, 6) AS x1, round_even(y1, 6) AS y1, round_even(confidence, 6) AS confidence FROM bx QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY confidence DESC, ord, x1 DESC, y1 DESC) = 1",
    "box_geometry": f"""WITH {BOXES}, g AS (SELECT *, (x1 + x2) / 2::DOUBLE AS cx, (y1 + y2) / 2::DOUBLE AS cy, 3::DOUBLE + 27::DOUBLE * (1::DOUBLE - least(greatest(confidence, 0::DOUBLE), 1::DOUBLE)) AS sg FROM bx)
SELECT frame_id, ord, round_even(cx, 6) AS cx, round_even(cy, 6) AS cy, round_even(cx, 6) AS fx, round_even(y2, 6) AS fy, round_even(cx / 40, 0) * 40::DOUBLE AS bx, round_even(sg * sg, 6) AS var,
trunc(cx - (x2 - x1) / 2::DOUBLE)::INT AS ix1, trunc(cy - (y2 - y1) / 2::DOUBLE)::INT AS iy1, trunc(cx + (x2 - x1) / 2::DOUBLE)::INT AS ix2, trunc(cy + (y2 - y1) / 2::DOUBLE)::INT AS iy2 FROM g""",
    "drawn_boxes": f"WITH {BOXES} SELECT frame_id, ord, round_even(x1 / 0.5::DOUBLE, 4) AS x1, round_even(y1 / 0.5::DOUBLE, 4) AS y1, round_even(x2 / 0.5::DOUBLE, 4) AS x2, round_even(y2 / 0.5::DOUBLE, 4) AS y2 FROM bx WHERE abs(x2 - x1) > 12 AND abs(y2 - y1) > 12",
    "yolo_labels": f"WITH {YOLO} SELECT frame_id, ord, floor((xc) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS xc, floor((yc) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS yc, floor((w) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS w, floor((h) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS h FROM yo",
    "ellipse_polygons": f"WITH {YOLO} SELECT frame_id, ord, k::INT AS k, floor((xc + w / 2::DOUBLE * cos(2 * pi() * k / 16)) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS x, floor((yc + h / 2::DOUBLE * sin(2 * pi() * k / 16)) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS y FROM yo, range(16) t(k)",
    "sample_indices": f"WITH {SAMPLES} SELECT clip, k, m + floor(k * (total - 2 * m) / 7::DOUBLE)::BIGINT AS frame_idx FROM mar, range(8) t(k)",
    "video_summary": "SELECT user_id % 4 AS clip, '1280x720' AS resolution, 29.97::DOUBLE AS fps, round_even(count(*)::DOUBLE / 29.97::DOUBLE, 1) AS duration_s FROM events GROUP BY 1",
    "homography_reprojection": f"""SELECT clip, label, x::DOUBLE AS x, y::DOUBLE AS y, round_even((x * (0.0002::DOUBLE * ((y + 6) / (0.04::DOUBLE - 0.0002::DOUBLE * y)) + 1) + 2) / 0.01::DOUBLE, 4) AS px, round_even((y + 6) / (0.04::DOUBLE - 0.0002::DOUBLE * y), 4) AS py
FROM {POINTS} t(label, x, y), range(4) c(clip)""",
    "detect_frames": """SELECT doc_id AS frame_id, 'player' AS class, round_even(doc_id % 640 + 0.25::DOUBLE, 1) AS x1, round_even(doc_id % 360 + 0.75::DOUBLE, 1) AS y1, round_even(doc_id % 640 + 50.25::DOUBLE, 1) AS x2, round_even(doc_id % 360 + 100.75::DOUBLE, 1) AS y2, (doc_id % 10) / 10::DOUBLE AS confidence FROM documents WHERE (doc_id % 10) / 10::DOUBLE >= 0.25
UNION ALL SELECT doc_id, 'ball', doc_id % 1000 + 0.5::DOUBLE, doc_id % 500 + 0.5::DOUBLE, doc_id % 1000 + 20.5::DOUBLE, doc_id % 500 + 20.5::DOUBLE, round_even((doc_id % 7) / 8::DOUBLE, 3) FROM documents WHERE (doc_id % 7) / 8::DOUBLE >= 0.25""",
    "verify_frames": """WITH a AS (SELECT doc_id AS n, doc_id % 11 = 0 AS bad FROM documents), b AS (SELECT n, bad, CASE WHEN NOT bad THEN n % 2 = 0 END AS ball_visible, CASE WHEN NOT bad THEN ['high', 'medium', 'low'][n % 3 + 1] END AS confidence, (NOT bad AND n % 4 = 0) AS has_bbox FROM a)
SELECT n AS frame_id, ball_visible, confidence, has_bbox, CASE WHEN bad THEN 'no answer' END AS error,
CASE WHEN bad OR confidence = 'low' THEN 'tier3' WHEN ball_visible AND has_bbox THEN 'tier2_positive' WHEN NOT ball_visible THEN 'tier2_negative' ELSE 'tier3' END AS tier FROM b""",
    "frame_range": f"WITH {BALL} SELECT clip, f AS frame_idx, cx FROM ball WHERE f BETWEEN 100 AND 299",
    "sampled_frames": f"WITH {SAMPLES}, {BALL} SELECT clip, f AS frame_idx FROM ball SEMI JOIN (SELECT clip, m + floor(k * (total - 2 * m) / 39::DOUBLE)::BIGINT AS f FROM mar, range(40) t(k)) w ON ball.clip = w.clip AND ball.f = w.f",
    "court_lines": f"""WITH l(line, x1, y1, x2, y2) AS (VALUES ('left sideline', 0, 0, 0, 18), ('right sideline', 9, 0, 9, 18), ('near baseline', 0, 0, 9, 0), ('far baseline', 0, 18, 9, 18), ('net', 0, 9, 9, 9), ('near attack line', 0, 3, 9, 3), ('far attack line', 0, 15, 9, 15))
SELECT clip, line, {_px("x1", "y1")} AS px1, {_py("y1")} AS py1, {_px("x2", "y2")} AS px2, {_py("y2")} AS py2 FROM l, range(4) c(clip)""",
}

"""DuckDB SQL of the queries over ``events``."""

FRAMES = """fr AS (SELECT user_id % 4 AS clip, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS f, value, event_type FROM events)"""
CY = "200::DOUBLE + 12::DOUBLE * abs(f % 60 - 30) + least(value, 20::DOUBLE) / 10::DOUBLE"
BALL = f"""{FRAMES},
ball AS (SELECT clip, f, 640::DOUBLE + least(value, 50::DOUBLE) AS cx, {CY} AS cy FROM fr WHERE f % 400 < 300)"""


def court(source: str, name: str, px: str, py: str, extra: str = "") -> str:
    den = f"(0.0002::DOUBLE * {py} + 1::DOUBLE)"
    return f"""{name} AS (SELECT clip, f{extra}, {px} AS px, {py} AS py, (0.01::DOUBLE * {px} - 2::DOUBLE) / {den} AS x, (0.04::DOUBLE * {py} - 6::DOUBLE) / {den} AS y FROM {source})"""


CONTACTS = """con AS (SELECT clip, f, cy FROM (
  SELECT clip, f, cy, count(*) OVER a AS n, max(cy) OVER a AS hi, min(cy) OVER a AS lo, max(cy) OVER b AS earlier FROM ball
  WINDOW a AS (PARTITION BY clip ORDER BY f RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING), b AS (PARTITION BY clip ORDER BY f RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING))
  WHERE n = 11 AND cy = hi AND cy - lo >= 15 AND (earlier IS NULL OR earlier < cy))"""
CROSSINGS = """cross_ AS (SELECT clip, f FROM (SELECT clip, f, x, y, lag(f) OVER w AS pf, lag(x) OVER w AS qx, lag(y) OVER w AS qy FROM court WINDOW w AS (PARTITION BY clip ORDER BY f))
  WHERE f - pf = 1 AND ((qy < 9 AND y > 9) OR (qy > 9 AND y < 9)) AND x BETWEEN -1 AND 10 AND qx BETWEEN -1 AND 10)"""
RALLIES = """seg AS (SELECT clip, min(f) AS start_frame, max(f) AS end_frame FROM (
  SELECT clip, f, sum(s) OVER (PARTITION BY clip ORDER BY f) AS k FROM (
    SELECT clip, f, CASE WHEN f - lag(f) OVER (PARTITION BY clip ORDER BY f) <= 90 THEN 0 ELSE 1 END AS s FROM court WHERE x BETWEEN -3 AND 12 AND y BETWEEN -3 AND 21)) GROUP BY clip, k),
ral AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY start_frame) AS rally_id, start_frame, end_frame, net_crossings FROM (
  SELECT s.clip, start_frame, end_frame, count(*) AS net_crossings FROM seg s JOIN cross_ c ON s.clip = c.clip AND c.f BETWEEN start_frame AND end_frame GROUP BY 1, 2, 3) WHERE net_crossings >= 2)"""
FEET = """feet AS (SELECT clip, f, p AS track_id, CASE WHEN p = 6 THEN 200::DOUBLE + f % 3 ELSE 250::DOUBLE + 130 * p + (f * (p + 2)) % 200 END AS fx,
  CASE WHEN p = 6 THEN 300::DOUBLE ELSE 180::DOUBLE + 60 * p + (f * (2 * p + 1)) % 170 END AS fy FROM ball, range(1, 7) t(p))"""
STILL = """still AS (SELECT * FROM (SELECT clip, track_id, count(*) AS n, sqrt((max(fx) - min(fx)) * (max(fx) - min(fx)) + (max(fy) - min(fy)) * (max(fy) - min(fy))) AS extent FROM feet GROUP BY 1, 2) WHERE n >= 150 AND extent <= 150)"""
PLAYERS = f"""{court("feet", "fc", "fx", "fy", ", track_id")},
act AS (SELECT fc.* FROM fc ANTI JOIN still ON fc.clip = still.clip AND fc.track_id = still.track_id WHERE x BETWEEN -3 AND 12 AND y BETWEEN -3 AND 21)"""
COURT = court("ball", "court", "cx", "cy")
BASE = f"WITH {BALL}, {COURT}, {CROSSINGS}, {RALLIES}"
FULL = f"{BASE}, {CONTACTS}, {FEET}, {STILL}, {PLAYERS}, pl AS (SELECT act.* FROM act SEMI JOIN ral ON act.clip = ral.clip AND act.f BETWEEN start_frame AND end_frame)"
ZONE = """CASE WHEN front THEN 4 - c ELSE CASE c WHEN 0 THEN 5 WHEN 1 THEN 6 ELSE 1 END END"""
ZONES = f"""zo AS (SELECT clip, track_id, {ZONE} AS zone, count(*) AS n FROM (
  SELECT clip, track_id, CASE WHEN yy <= 9 THEN col ELSE 2 - col END AS c, abs(yy - 9) <= 3 AS front FROM (
    SELECT clip, track_id, floor(least(greatest(x, 0::DOUBLE), 8.999999999::DOUBLE) / 3)::INT AS col, least(greatest(y, 0::DOUBLE), 17.999999999::DOUBLE) AS yy FROM pl)) GROUP BY 1, 2, 3)"""
TOUCHES = """tch AS (SELECT clip, f, track_id, d FROM (
  SELECT c.clip, c.f, p.track_id, sqrt((b.x - p.x) * (b.x - p.x) + (b.y - p.y) * (b.y - p.y)) AS d,
         row_number() OVER (PARTITION BY c.clip, c.f ORDER BY sqrt((b.x - p.x) * (b.x - p.x) + (b.y - p.y) * (b.y - p.y)) NULLS LAST, p.track_id) AS k
  FROM con c SEMI JOIN ral ON c.clip = ral.clip AND c.f BETWEEN start_frame AND end_frame
  JOIN court b ON c.clip = b.clip AND c.f = b.f LEFT JOIN pl p ON c.clip = p.clip AND c.f = p.f) WHERE k = 1)"""
TOUCHES = TOUCHES.replace("FROM con c SEMI JOIN ral ON c.clip = ral.clip AND c.f BETWEEN start_frame AND end_frame", "FROM (SELECT con.* FROM con SEMI JOIN ral ON con.clip = ral.clip AND con.f BETWEEN start_frame AND end_frame) c")

OBS = f"{BALL}, obs AS (SELECT * FROM ball WHERE f % 7 NOT IN (3, 4))"
LINEAR = """nx AS (SELECT *, lead(f) OVER w AS nf, lead(cx) OVER w AS nx, lead(cy) OVER w AS ny FROM obs WINDOW w AS (PARTITION BY clip ORDER BY f)),
fil AS (SELECT clip, f, cx, cy, false AS is_interpolated FROM obs UNION ALL
  SELECT clip, f + t, cx + (nx - cx) * (t::DOUBLE / (nf - f)), cy + (ny - cy) * (t::DOUBLE / (nf - f)), true FROM (SELECT *, unnest(range(1, nf - f)) AS t FROM nx WHERE nf - f > 1 AND nf - f <= 15))"""

CANDIDATES = f"""WITH RECURSIVE {FRAMES},
k0 AS (SELECT clip, f, event_type AS e, 640::DOUBLE + 140::DOUBLE * (f // 25 % 2) + least(value, 20::DOUBLE) / 4::DOUBLE AS cx, {CY} AS cy, 0.05::DOUBLE + least(value, 90::DOUBLE) / 100::DOUBLE AS conf FROM fr WHERE f % 400 < 300 AND f % 7 <> 3),
cand AS (SELECT clip, f, 1 AS ord, cx, cy, conf FROM k0 WHERE NOT (e = 'signup' AND f % 5 = 0)
  UNION ALL SELECT clip, f, 2, cx + 500::DOUBLE, cy + (-100)::DOUBLE, 0.95::DOUBLE FROM k0 WHERE e = 'error'
  UNION ALL SELECT clip, f, 3, cx + 20::DOUBLE, cy + 15::DOUBLE, 0.3::DOUBLE FROM k0 WHERE e = 'click'
  UNION ALL SELECT clip, f, 4, cx + (-150)::DOUBLE, cy + 0::DOUBLE, 0.6::DOUBLE FROM k0 WHERE e = 'signup'),
fm AS (SELECT clip, f, list(struct_pack(ord := ord, cx := cx, cy := cy, conf := conf) ORDER BY ord) AS cs, list(struct_pack(cx := cx, cy := cy, conf := conf) ORDER BY conf DESC, ord)[1] AS best FROM cand GROUP BY 1, 2),
fs AS (SELECT a.clip, row_number() OVER (PARTITION BY a.clip ORDER BY a.f) AS rn, a.f, a.cs, a.best, b.best AS n1, c.best AS n2
  FROM fm a LEFT JOIN fm b ON a.clip = b.clip AND b.f = a.f + 1 LEFT JOIN fm c ON a.clip = c.clip AND c.f = a.f + 2)"""
_NEAR = "coalesce(sqrt(({n}.cx - {c}.cx) * ({n}.cx - {c}.cx) + ({n}.cy - {c}.cy) * ({n}.cy - {c}.cy)) <= 60, false)"


def _confirmed(c: str) -> str:
    return "(" + " OR ".join(_NEAR.format(n=n, c=c) for n in ("n1", "n2")) + ")"


_REACH = "list_filter(cs, lambda z: sqrt((z.cx - lx) * (z.cx - lx) + (z.cy - ly) * (z.cy - ly)) <= 220::DOUBLE * gap)"
_TOP = "list_reverse_sort(list_transform({x}, lambda z: struct_pack(conf := z.conf, o := -z.ord, cx := z.cx, cy := z.cy)))[1]"
HEURISTIC = f"""{CANDIDATES},
st AS (
  SELECT clip, 0::BIGINT AS rn, NULL::BIGINT AS f, NULL::BIGINT AS lf, NULL::DOUBLE AS lx, NULL::DOUBLE AS ly, false AS hit FROM (SELECT DISTINCT clip FROM fs)
  UNION ALL
  SELECT clip, rn, f, CASE WHEN hit THEN f ELSE lf END, CASE WHEN hit THEN b.cx ELSE lx END, CASE WHEN hit THEN b.cy ELSE ly END, hit FROM (
    SELECT *, CASE WHEN b IS NULL THEN false WHEN NOT anchored THEN b.conf >= 0.25::DOUBLE
      ELSE b.conf >= 0.1::DOUBLE AND (sqrt((b.cx - lx) * (b.cx - lx) + (b.cy - ly) * (b.cy - ly)) <= 100::DOUBLE * gap OR {_confirmed("b")}) END AS hit FROM (
      SELECT *, CASE WHEN anchored THEN {_TOP.format(x=_REACH)} ELSE {_TOP.format(x="cs")} END AS b FROM (
        SELECT s.lf, s.lx, s.ly, x.clip, x.rn, x.f, x.cs, x.n1, x.n2, x.f - s.lf AS gap, coalesce(x.f - s.lf <= 15, false) AS anchored FROM st s JOIN fs x ON s.clip = x.clip AND x.rn = s.rn + 1)))
)
SELECT clip, f AS frame_idx, floor(lx * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS cx, floor(ly * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS cy FROM st WHERE hit"""

#: State: x v a on both axes and the upper triangle of the covariance.
_STATE = "px, py, vx, vy, ax, ay, p0, p1, p2, p3, p4, p5"
_SEED = {"px": "pick.cx", "py": "pick.cy", "vx": "0::DOUBLE", "vy": "0::DOUBLE", "ax": "0::DOUBLE", "ay": "0::DOUBLE", "p0": "4::DOUBLE", "p1": "0::DOUBLE", "p2": "0::DOUBLE", "p3": "10000::DOUBLE", "p4": "0::DOUBLE", "p5": "10000::DOUBLE"}
_UPDATE = {
    "px": "mx + (va / s) * (pick.cx - mx)", "py": "my + (va / s) * (pick.cy - my)", "vx": "mvx + (vb / s) * (pick.cx - mx)", "vy": "mvy + (vb / s) * (pick.cy - my)",
    "ax": "ax + (vc / s) * (pick.cx - mx)", "ay": "ay + (vc / s) * (pick.cy - my)", "p0": "va - (va / s) * va", "p1": "vb - (va / s) * vb", "p2": "vc - (va / s) * vc",
    "p3": "vd - (vb / s) * vb", "p4": "ve - (vb / s) * vc", "p5": "vg - (vc / s) * vc",
}
_HIT = _SEED | {"vx": "(pick.cx - lx) / gap", "vy": "(pick.cy - ly) / gap"}
_CASES = ",\n    ".join(f"CASE kind WHEN 1 THEN {_SEED[c]} WHEN 2 THEN {_UPDATE[c]} WHEN 3 THEN {_HIT[c]} ELSE {c} END AS {c}" for c in _STATE.split(", "))
KALMAN = f"""{CANDIDATES},
st AS (
  SELECT clip, 0::BIGINT AS rn, NULL::BIGINT AS f, NULL::BIGINT AS lf, NULL::DOUBLE AS lx, NULL::DOUBLE AS ly, 0 AS kind, {", ".join(f"0::DOUBLE AS {c}" for c in _STATE.split(", "))} FROM (SELECT DISTINCT clip FROM fs)
  UNION ALL
  SELECT clip, rn, f, CASE WHEN kind > 0 THEN f ELSE lf END, CASE WHEN kind > 0 THEN pick.cx ELSE lx END, CASE WHEN kind > 0 THEN pick.cy ELSE ly END, kind,
    {_CASES} FROM (
    SELECT *, CASE WHEN kind = 2 THEN va + (3::DOUBLE + 27::DOUBLE * (1 - least(greatest(pick.conf, 0::DOUBLE), 1::DOUBLE))) * (3::DOUBLE + 27::DOUBLE * (1 - least(greatest(pick.conf, 0::DOUBLE), 1::DOUBLE))) END AS s FROM (
    SELECT *, CASE WHEN NOT anchored THEN CASE WHEN top.conf >= 0.25::DOUBLE THEN 1 ELSE 0 END WHEN gated IS NOT NULL THEN 2
        WHEN far IS NOT NULL AND far.conf >= 0.1::DOUBLE AND {_confirmed("far")} THEN 3 ELSE 0 END AS kind,
      CASE WHEN NOT anchored THEN struct_pack(cx := top.cx, cy := top.cy, conf := top.conf) WHEN gated IS NOT NULL THEN struct_pack(cx := gated.cx, cy := gated.cy, conf := gated.conf) WHEN far IS NOT NULL THEN struct_pack(cx := far.cx, cy := far.cy, conf := far.conf) END AS pick FROM (
      SELECT *, {_TOP.format(x="cs")} AS top, {_TOP.format(x="reach")} AS far,
        list_sort(list_transform(list_filter(reach, lambda z: ((z.cx - mx) * (z.cx - mx) + (z.cy - my) * (z.cy - my)) / (va + 9::DOUBLE) <= 9.21::DOUBLE),
          lambda z: struct_pack(cost := ((z.cx - mx) * (z.cx - mx) + (z.cy - my) * (z.cy - my)) / (va + 9::DOUBLE) - 2::DOUBLE * ln(greatest(z.conf, 0.000001::DOUBLE)), o := z.ord, cx := z.cx, cy := z.cy, conf := z.conf)))[1] AS gated FROM (
        SELECT *, CASE WHEN anchored THEN {_REACH} END AS reach,
          px + t * vx + h * ax AS mx, py + t * vy + h * ay AS my, vx + t * ax AS mvx, vy + t * ay AS mvy,
          (p0 + t * p1 + h * p2) + t * (p1 + t * p3 + h * p4) + h * (p2 + t * p4 + h * p5) + 50::DOUBLE * (t * t * t * t * t) / 20 AS va,
          (p1 + t * p3 + h * p4) + t * (p2 + t * p4 + h * p5) + 50::DOUBLE * (t * t * t * t) / 8 AS vb, (p2 + t * p4 + h * p5) + 50::DOUBLE * (t * t * t) / 6 AS vc,
          (p3 + t * p4) + t * (p4 + t * p5) + 50::DOUBLE * (t * t * t) / 3 AS vd, (p4 + t * p5) + 50::DOUBLE * (t * t) / 2 AS ve, p5 + 50::DOUBLE * t AS vg FROM (
          SELECT s.lf, s.lx, s.ly, {", ".join("s." + c for c in _STATE.split(", "))}, x.clip, x.rn, x.f, x.cs, x.n1, x.n2, x.f - s.lf AS gap, coalesce(x.f - s.lf <= 15, false) AS anchored,
            (x.f - s.lf)::DOUBLE AS t, (x.f - s.lf)::DOUBLE * (x.f - s.lf)::DOUBLE / 2 AS h FROM st s JOIN fs x ON s.clip = x.clip AND x.rn = s.rn + 1))))))
"""
TRACKED = f"{KALMAN}, trk AS (SELECT clip, f, px, py, vx, vy, ax, ay, kind = 3 AS is_contact FROM st WHERE kind > 0)"
BALLISTIC = """nb AS (SELECT *, lead(f) OVER w AS nf, lead(px) OVER w AS nx, lead(py) OVER w AS ny, lead(is_contact) OVER w AS nc FROM trk WINDOW w AS (PARTITION BY clip ORDER BY f)),
fb AS (SELECT clip, f, px AS cx, py AS cy, false AS is_interpolated FROM trk UNION ALL
  SELECT clip, f + t, px + (nx - px) * (t::DOUBLE / (nf - f)) + CASE WHEN is_contact OR nc THEN 0::DOUBLE ELSE 0.5::DOUBLE * ax * t * (t - (nf - f)) END,
         py + (ny - py) * (t::DOUBLE / (nf - f)) + CASE WHEN is_contact OR nc THEN 0::DOUBLE ELSE 0.5::DOUBLE * ay * t * (t - (nf - f)) END, true
  FROM (SELECT *, unnest(range(1, nf - f)) AS t FROM nb WHERE nf - f > 1 AND nf - f <= 15))"""

def fixed(x: str, digits: int) -> str:
    """Half up on the binary value, as the queries do it."""
    return f"floor({x} * {10**digits}::DOUBLE + 0.5::DOUBLE) / {10**digits}::DOUBLE"


ORACLES: dict[str, str] = {
    "ball_contacts": f"WITH {BALL}, {CONTACTS} SELECT clip, f AS frame_idx, cy FROM con",
    "court_positions": f"WITH {BALL}, {COURT} SELECT clip, f AS frame_idx, {fixed('x', 6)} AS x, {fixed('y', 6)} AS y FROM court",
    "net_crossings": f"WITH {BALL}, {COURT}, {CROSSINGS} SELECT clip, f AS frame_idx FROM cross_",
    "rallies": f"{BASE} SELECT * FROM ral",
    "rally_seconds": f"{BASE} SELECT clip, rally_id, round_even(start_frame::DOUBLE / 29.97::DOUBLE, 2) AS start_s, round_even(end_frame::DOUBLE / 29.97::DOUBLE, 2) AS end_s FROM ral",
    "in_play_frames": f"{BASE} SELECT DISTINCT clip, unnest(range(start_frame, end_frame + 1)) AS frame_idx FROM ral",
    "touches": f"{FULL}, {TOUCHES} SELECT clip, f AS frame_idx, track_id, {fixed('d', 6)} AS distance_m FROM tch",
    "stationary_tracks": f"WITH {BALL}, {FEET}, {STILL} SELECT clip, track_id, n, {fixed('extent', 6)} AS extent FROM still",
    "active_positions": f"WITH {BALL}, {FEET}, {STILL}, {PLAYERS} SELECT clip, f AS frame_idx, track_id, {fixed('x', 6)} AS x, {fixed('y', 6)} AS y FROM act",
    "zone_occupancy": f"{FULL}, {ZONES} SELECT clip, track_id, zone, n FROM zo",
    "zone_occupancy_wide": f"{FULL}, {ZONES} SELECT clip, track_id, " + ", ".join(f"coalesce(sum(n) FILTER (zone = {z}), 0)::BIGINT AS zone_{z}" for z in range(1, 7)) + " FROM zo GROUP BY 1, 2",
    "match_stats_summary": f"""{FULL}, {ZONES}, {TOUCHES}, c AS (SELECT clip, min(f) AS first_frame, max(f) AS last_frame FROM fr GROUP BY 1),
r AS (SELECT clip, count(*) AS rallies, sum(net_crossings)::BIGINT AS crossings, round_even(sum(round_even(end_frame::DOUBLE / 29.97::DOUBLE, 2)), 4) AS end_s FROM ral GROUP BY 1),
t AS (SELECT clip, count(*) AS touches, round_even(sum(round_even(d, 2)), 4) AS distance_m FROM tch GROUP BY 1), z AS (SELECT clip, count(DISTINCT track_id) AS players FROM zo GROUP BY 1),
s AS (SELECT clip, string_agg(track_id::VARCHAR, ',' ORDER BY track_id) AS excluded FROM still GROUP BY 1)
SELECT c.clip, 'clip_' || c.clip || '.mp4' AS video, first_frame, last_frame, rallies, crossings, end_s, touches, distance_m, players, excluded
FROM c LEFT JOIN r ON c.clip = r.clip LEFT JOIN t ON c.clip = t.clip LEFT JOIN z ON c.clip = z.clip LEFT JOIN s ON c.clip = s.clip""",
    "linear_gap_fill": f"WITH {OBS}, {LINEAR} SELECT clip, f AS frame_idx, {fixed('cx', 6)} AS cx, {fixed('cy', 6)} AS cy, is_interpolated FROM fil",
    "heuristic_track": HEURISTIC,
    "kalman_track": f"{TRACKED} SELECT clip, f AS frame_idx, {fixed('px', 4)} AS px, {fixed('py', 4)} AS py, {fixed('vx', 4)} AS vx, {fixed('vy', 4)} AS vy, is_contact FROM trk",
    "ballistic_gap_fill": f"{TRACKED}, {BALLISTIC} SELECT clip, f AS frame_idx, {fixed('cx', 4)} AS cx, {fixed('cy', 4)} AS cy, is_interpolated FROM fb",
    "track_coverage": f"{TRACKED}, {BALLISTIC} SELECT clip, count(*) FILTER (NOT is_interpolated) AS real, count(*) FILTER (is_interpolated) AS interpolated FROM fb GROUP BY 1",
    "overlay_markers": f"{TRACKED}, {BALLISTIC} SELECT clip, f AS frame_idx, round_even(cx, 0)::INT AS mx, round_even(cy, 0)::INT AS my, NOT is_interpolated AS filled FROM fb",
}

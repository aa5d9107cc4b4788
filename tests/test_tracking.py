"""Trackers and gap filling on hand-made frames, and on the driver's tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyloom.operators import gapfill, players, tracking
from rallyloom.params import PlayerParams, TrackParams


def candidates(spark, rows):
    """frame -> list of (x, y, confidence)."""
    flat = [(0, f, i, float(x), float(y), float(c)) for f, found in rows.items() for i, (x, y, c) in enumerate(found)]
    return spark.createDataFrame(flat, "clip bigint, frame_idx bigint, ord int, cx double, cy double, confidence double")


def accepted(spark, rows, tracker, **changes):
    run = tracking.kalman_track if tracker == "kalman" else tracking.heuristic_track
    return {r.frame_idx: r for r in run(candidates(spark, rows), TrackParams(**changes)).collect()}


BOTH = pytest.mark.parametrize("tracker", ["kalman", "heuristic"])


@BOTH
@pytest.mark.parametrize("rows,want", [
    ({3: [(5, 5, 0.5)]}, [3]), ({3: [(5, 5, 0.15)]}, []), ({3: [(5, 5, 0.5)], 10: [(6, 6, 0.15)]}, [3, 10]), ({3: [(5, 5, 0.5)], 30: [(6, 6, 0.15)]}, [3]), ({}, []),
])
def test_seed_and_extend(spark, tracker, rows, want):
    assert sorted(accepted(spark, rows, tracker)) == want


@BOTH
def test_near_candidate_beats_confident_decoy(spark, tracker):
    got = accepted(spark, {7: [(310, 240, 0.8)], 8: [(1100, 60, 0.97), (318, 233, 0.35)]}, tracker)
    assert sorted(got) == [7, 8]
    x = got[8].px if tracker == "kalman" else got[8].cx
    assert abs(x - 318) < 2


@BOTH
def test_jump_beyond_the_bound(spark, tracker):
    far = {20: [(60, 400, 0.7)], 21: [(130, 400, 0.7)], 22: [(131, 401, 0.7)]}
    assert sorted(accepted(spark, far, tracker, hard_speed=30.0)) == [20]


def test_heuristic_needs_a_follow_up(spark):
    jump = {11: [(400, 90, 0.6)], 12: [(280, 170, 0.6)]}
    assert sorted(accepted(spark, jump, "heuristic")) == [11]
    assert 12 in accepted(spark, jump | {13: [(262, 181, 0.6)]}, "heuristic")


def test_contact_reseeds(spark):
    rising = {50 + i: [(700 - 22 * i, 500 - 6 * i, 0.75)] for i in range(14)}
    returned = {64: [(610, 380, 0.75)], 65: [(655, 372, 0.75)]}
    got = accepted(spark, rising | returned, "kalman")
    assert got[64].is_contact and got[64].vx > 0 and not got[65].is_contact
    assert 64 not in accepted(spark, rising | {64: returned[64]}, "kalman")


def test_fold_equals_six_state_filter():
    p, rng = TrackParams(), np.random.default_rng(1)
    fold = tracking.KalmanFold(p)
    x, cov, frame = None, None, 0
    for _ in range(200):
        frame += int(rng.integers(1, 4))
        z, conf = np.array([10.0 * frame, 5.0 * frame]) + rng.normal(0, 2, 2), float(rng.uniform(0.3, 1))
        row = fold.step(frame, [{"ord": 0, "cx": z[0], "cy": z[1], "conf": conf}], [])
        if x is None:
            x, cov = np.r_[z, 0, 0, 0, 0], np.diag([4.0, 4, 1e4, 1e4, 1e4, 1e4])
        else:
            t = frame - last
            one = np.array([[1, t, t * t / 2], [0, 1, t], [0, 0, 1]])
            f, q = np.kron(one, np.eye(2)), 50 * np.kron(np.array([[t**5 / 20, t**4 / 8, t**3 / 6], [t**4 / 8, t**3 / 3, t**2 / 2], [t**3 / 6, t**2 / 2, t]]), np.eye(2))
            x, cov = f @ x, f @ cov @ f.T + q
            s = cov[:2, :2] + (3 + 27 * (1 - conf)) ** 2 * np.eye(2)
            k = cov[:, :2] @ np.linalg.inv(s)
            x, cov = x + k @ (z - x[:2]), cov - k @ cov[:2]
        last = frame
        assert np.allclose(row[:6], x, atol=1e-6) and not row[6]


def test_pieces_change_nothing(spark):
    rng = np.random.default_rng(2)
    rows, f = {}, 0
    for _ in range(300):
        f += int(rng.choice([1, 1, 2, 5, 17, 40]))
        rows[f] = [(640 + 30 * math.sin(f / 9) + rng.normal(0, 4), 300 + 2.0 * (f % 90), rng.uniform(0.05, 1)) for _ in range(int(rng.integers(1, 4)))]
    df = candidates(spark, rows)
    get = lambda whole: sorted(map(tuple, tracking.kalman_track(df, whole_clips=whole).collect()))
    assert get(True) == get(False)


def test_linear_fill(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 4, 8.0, 4.0), (0, 24, 1.0, 1.0), (1, 3, 1.0, 1.0)], "clip bigint, frame_idx bigint, cx double, cy double")
    got = sorted(tuple(r) for r in gapfill.fill_linear(df).collect())
    assert [(f, x, y) for c, f, x, y, made in got if made] == [(1, 2.0, 1.0), (2, 4.0, 2.0), (3, 6.0, 3.0)]
    assert len(got) == 7


@pytest.mark.parametrize("acc,contact", [(4.0, False), (0.0, False), (4.0, True)])
def test_ballistic_fill(spark, acc, contact):
    schema = "clip bigint, frame_idx bigint, px double, py double, vx double, vy double, ax double, ay double, is_contact boolean"
    df = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, acc, contact), (0, 4, 8.0, 8.0, 0.0, 0.0, 0.0, 0.0, False)], schema)
    got = {r.frame_idx: (r.cx, r.cy) for r in gapfill.fill_ballistic(df).collect()}
    assert got[2] == (4.0, 4.0 + (0 if contact else 0.5 * acc * 2 * -2))


def boxes(spark, tracks):
    rows = [(0, f, x - 20.0, y - 60.0, x + 20.0, y, 0.9, i) for f, found in tracks.items() for i, (x, y) in enumerate(found)]
    return spark.createDataFrame(rows, "clip bigint, frame_idx bigint, x1 double, y1 double, x2 double, y2 double, confidence double, ord int")


def test_players_keep_their_ids(spark):
    hidden = range(40, 70)
    df = boxes(spark, {f: [(100.0 + 2 * f, 300.0)] + ([(900.0 - f, 500.0)] if f not in hidden else []) for f in range(100)})
    got = players.player_tracks(df, 30.0)
    assert got.select("track_id").distinct().count() == 2
    ends = {r.track_id for r in got.where("frame_idx in (39, 72) and x1 > 500").collect()}
    assert len(ends) == 1


def reference_tracks(frames, fps, p):
    """The published two-stage association with an eight-state filter and every assignment tried."""
    from itertools import permutations

    std_p, std_v = 1 / 20, 1 / 160
    move = np.eye(8) + np.eye(8, k=4)

    def state(b):
        w, h = b[2] - b[0], b[3] - b[1]
        return np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, w / h, h])

    def box(t):
        cx, cy, a, h = t["x"][:4]
        return np.array([cx - a * h / 2, cy - h / 2, cx + a * h / 2, cy + h / 2])

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inter = max(w, 0) * max(h, 0)
        return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)

    def match(tracks, found, limit, fuse):
        cost = [[1 - iou(box(t), b) * (s if fuse else 1) for b, s in found] for t in tracks]
        best, chosen = 0.0, []
        slots = [*range(len(found)), *[None] * len(tracks)]
        for order in set(permutations(slots, len(tracks))):
            pairs = [(i, j) for i, j in enumerate(order) if j is not None]
            if all(cost[i][j] <= limit for i, j in pairs):
                value = sum(cost[i][j] - limit for i, j in pairs)
                if value < best - 1e-12:
                    best, chosen = value, pairs
        return chosen

    def noise(h, sp, sv):
        return np.diag(np.array([sp * h, sp * h, 1e-2, sp * h, sv * h, sv * h, 1e-5, sv * h]) ** 2)

    tracks, given, out, begin = [], 0, [], min(frames)
    for f in range(begin, max(frames) + 1):
        boxes = frames.get(f, [])
        for t in tracks:
            if t["lost"]:
                t["x"][7] = 0
            t["x"], t["cov"] = move @ t["x"], move @ t["cov"] @ move.T + noise(t["x"][3], std_p, std_v)
        strong, weak = [b for b in boxes if b[1] > p.high_conf], [b for b in boxes if p.low_conf < b[1] < p.high_conf]
        left = list(strong)

        def update(t, b):
            nonlocal given
            h = t["x"][3]
            r = np.diag(np.array([std_p * h, std_p * h, 1e-1, std_p * h]) ** 2)
            gain = t["cov"][:, :4] @ np.linalg.inv(t["cov"][:4, :4] + r)
            t["x"], t["cov"] = t["x"] + gain @ (state(b[0]) - t["x"][:4]), t["cov"] - gain @ t["cov"][:4]
            t.update(hits=t["hits"] + 1, last=f, lost=False)
            if t["id"] is None and t["hits"] >= p.min_consecutive:
                given += 1
                t["id"] = given
            if t["id"] is not None:
                out.append((f, t["id"], tuple(b[0])))

        known, young = [t for t in tracks if t["id"] is not None], [t for t in tracks if t["id"] is None]
        pairs = match(known, strong, p.match, True)
        for i, j in pairs:
            update(known[i], strong[j])
        left = [b for j, b in enumerate(strong) if j not in {j for _, j in pairs}]
        rest = [t for i, t in enumerate(known) if i not in {i for i, _ in pairs} and not t["lost"]]
        pairs = match(rest, weak, p.second_match, False)
        for i, j in pairs:
            update(rest[i], weak[j])
        for i, t in enumerate(rest):
            t["lost"] = t["lost"] or i not in {i for i, _ in pairs}
        pairs = match(young, left, p.unconfirmed_match, True)
        for i, j in pairs:
            update(young[i], left[j])
        gone = [id(t) for i, t in enumerate(young) if i not in {i for i, _ in pairs}]
        tracks = [t for t in tracks if id(t) not in gone and not (t["lost"] and f - t["last"] > int(round(fps) / 30 * p.lost_buffer))]
        for j, b in enumerate(left):
            if j not in {j for _, j in pairs} and b[1] >= p.high_conf + 0.1:
                h = b[0][3] - b[0][1]
                t = {"x": np.r_[state(b[0]), np.zeros(4)], "cov": noise(h, 2 * std_p, 10 * std_v), "id": None, "hits": 1, "last": f, "lost": False}
                if f == begin:
                    given += 1
                    t["id"] = given
                    out.append((f, given, tuple(b[0])))
                tracks.append(t)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_players_against_brute_force(spark, seed):
    """Crossing players, weak and missing boxes, false boxes, a hole in the clip."""
    rng, p = np.random.default_rng(seed), PlayerParams(lost_buffer=5)
    frames = {}
    for f in [*range(60), *range(70, 110)]:
        found = []
        for k in range(3):
            x, y = 200 + 150 * k + (6 - 5 * k) * f + rng.normal(0, 2), 300 + 20 * k + rng.normal(0, 2)
            if rng.uniform() > 0.12:
                found.append((np.array([x - 25, y - 100, x + 25, y]).astype(np.float32).astype(float), float(rng.uniform(0.15, 0.99))))
        if rng.uniform() < 0.1:
            x = rng.uniform(0, 900)
            found.append((np.array([x, 10, x + 30, 90]).astype(np.float32).astype(float), 0.9))
        frames[f] = found
    rows = [(0, f, *map(float, b), s, i) for f, found in frames.items() for i, (b, s) in enumerate(found)]
    df = spark.createDataFrame(rows, "clip bigint, frame_idx bigint, x1 double, y1 double, x2 double, y2 double, confidence double, ord int")
    got = players.player_tracks(df, 30.0, p).collect()
    want = reference_tracks(frames, 30.0, p)
    assert len({t for _, t, _ in want}) > 3
    assert sorted((r.frame_idx, r.track_id, (r.x1, r.y1, r.x2, r.y2)) for r in got) == sorted(want)


def test_a_single_box_is_no_track(spark):
    df = boxes(spark, {0: [(100.0, 300.0)], 1: [(100.0, 300.0)], 2: [(100.0, 300.0), (700.0, 300.0)], 3: [(100.0, 300.0)]})
    assert players.player_tracks(df, 30.0).select("track_id").distinct().count() == 1


def test_assignment_is_best():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for _ in range(50):
        n, m = map(int, rng.integers(1, 5, 2))
        cost, limit = rng.uniform(0, 1, (n, m)), 0.7
        pairs, _, _ = players.assign(cost, limit)
        value = lambda chosen: sum(cost[a, b] - limit for a, b in chosen)
        best = 0.0
        big = max(n, m)
        for order in permutations(range(big), n):
            best = min(best, value([(a, b) for a, b in enumerate(order) if b < m and cost[a, b] <= limit]))
        assert abs(value(pairs) - best) < 1e-9
    assert PlayerParams().match == 0.85


def test_best_candidate_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([(1, 0, 5.0, 0.9), (1, 1, 6.0, 0.9), (2, 0, 7.0, 0.1)], "frame_id bigint, ord int, x1 double, confidence double")
    assert {(r.frame_id, r.x1) for r in tracking.best_candidates(df, ["frame_id"]).collect()} == {(1, 5.0), (2, 7.0)}
    assert df.agg(F.count("*")).first()[0] == 3

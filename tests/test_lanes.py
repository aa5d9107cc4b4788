"""Stretches of a clip folded at once against the fold of its frames one by one."""

import sys

import numpy as np
import pyarrow as pa
import pytest

from rallyloom.operators import players
from rallyloom.operators.lanes import ClipFold, _numbers
from rallyloom.operators.players import PlayerFold
from rallyloom.params import PlayerParams


def walking(frames):
    """Six boxes a frame with holes, by the formulas of FIXTURES.md; one track lives as long as the clip."""
    f = np.arange(frames)
    f = np.repeat(f[f % 400 < 300], 6)
    p = np.tile(np.arange(1, 7), len(f) // 6)
    x = np.where(p == 6, 200 + f % 3, 250 + 130 * p + (f * (p + 2)) % 200).astype(float)
    y = np.where(p == 6, 300, 180 + 60 * p + (f * (2 * p + 1)) % 170).astype(float)
    return f, np.array([x - 30, y - 120, x + 30, y]), np.full(len(f), 0.8)


def crossing(seed, frames):
    """Boxes with noise: missing, weak and false ones, long-lived tracks and holes longer than any lost track is kept."""
    rng = np.random.default_rng(seed)
    at, speed, rows = rng.uniform(100, 900, (6, 2)), rng.normal(0, 3, (6, 2)), []
    for f in range(frames):
        speed += rng.normal(0, 0.3, speed.shape)
        speed = np.where((at < 50) | (at > 900), -np.sign(at - 400) * np.abs(speed), speed)
        at = at + speed
        if f % 500 < 480 or f % 1000 < 500:
            for x, y in at[rng.uniform(size=6) > 0.12] + rng.normal(0, 2):
                rows.append((f + 5_000 * (f >= 1000), x - 25, y - 100 - rng.normal(0, 2), x + 25, y, rng.uniform(0.05, 0.99)))
            if rng.uniform() < 0.1:
                x = rng.uniform(0, 900)
                rows.append((f + 5_000 * (f >= 1000), x, 10, x + 30, 90, 0.9))
    rows = np.array(rows)
    return rows[:, 0].astype(int), rows[:, 1:5].astype(np.float32).astype(float).T, rows[:, 5]


def one_by_one(params, frames, boxes, scores):
    fold, out = PlayerFold(params, 30.0), []
    starts = {f: i for i, f in reversed([*enumerate(frames.tolist())])}
    for f in range(int(frames[0]), int(frames[-1]) + 1):
        a = starts.get(f, 0)
        b = a + int((frames[a : a + 100] == f).sum()) if f in starts else a
        out += [(a + i, t) for t, i in fold.advance(f, [*map(tuple, boxes[:, a:b].T.tolist())], scores[a:b].tolist())]
    return out, fold


def at_once(params, frames, boxes, scores, length, warm, cuts):
    fold, out, edges = ClipFold(params, 30.0, length, warm, 1), [], [0, *cuts, len(frames)]
    for a, b in zip(edges, edges[1:]):
        rows, ids = fold.rows(frames[a:b], boxes[:, a:b], scores[a:b])
        out += zip((rows + a).tolist(), ids.tolist())
    return out, fold


def same(want, got):
    held = [[(_numbers(t), t.id, t.last, t.lost) for t in x.tracks] for x in (want[1], got[1].fold)]
    return want[0] == got[0] and want[1].given == got[1].fold.given and held[0] == held[1]


@pytest.mark.parametrize(("length", "warm"), [(300, 400), (300, 30)])
def test_lanes_give_the_rows_and_the_state_of_the_fold(length, warm):
    clip = walking(4000)
    want, got = one_by_one(PlayerParams(), *clip), at_once(PlayerParams(), *clip, length, warm, (6 * 1503,))
    assert same(want, got)
    assert 0 < got[1].failed if warm == 30 else got[1].failed < got[1].lanes / 2  # lanes that begin wrong are found and folded anew
    assert got[1].lanes > 4


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("params", [PlayerParams(lost_buffer=8), PlayerParams(), PlayerParams(min_consecutive=1, lost_buffer=5), PlayerParams(min_consecutive=3, high_conf=0.6)])
def test_lanes_over_crossing_players(seed, params):
    clip = crossing(seed, 2000)
    cut = int(np.searchsorted(clip[0], 700))
    want, got = one_by_one(params, *clip), at_once(params, *clip, 100, 60, (cut,))
    assert same(want, got)
    assert got[1].lanes > 5


def test_crowds_are_folded_one_by_one(monkeypatch):
    clip = walking(2000)
    monkeypatch.setattr("rallyloom.operators.lanes.CROWD", 20)
    want, got = one_by_one(PlayerParams(), *clip), at_once(PlayerParams(), *clip, 100, 50, ())
    assert same(want, got)
    assert got[1].lanes == 0


def test_a_clip_takes_few_calls_a_frame():
    """Some hundred when frames were folded one by one: 1.5 million of them took most of the query's time."""
    clip, calls = walking(30_000), 0

    def count(_frame, event, _arg) -> None:
        nonlocal calls
        calls += event in ("call", "c_call")

    fold = ClipFold(PlayerParams(), 30.0)
    sys.setprofile(count)
    try:
        fold.rows(*clip)
    finally:
        sys.setprofile(None)
    assert fold.lanes > 20
    assert calls / 30_000 < 80


def test_pieces_are_of_one_clip(monkeypatch):
    monkeypatch.setattr(players, "PIECE_ROWS", 4)
    clips = [None, None, 1, 1, 1, 1, 1, 1, 2]
    whole = pa.RecordBatch.from_arrays([pa.array(clips, pa.int64()), pa.array(range(9), pa.int64())], ["clip", "frame_idx"])
    got = [(x.column(0).to_pylist(), fresh) for x, fresh in players._pieces(iter([whole.slice(0, 4), whole.slice(4, 2), whole.slice(6)]))]
    assert got == [([None] * 2, True), ([1] * 4, True), ([1] * 2, False), ([2], True)]

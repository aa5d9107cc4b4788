"""A clip's frames folded as many stretches (lanes) at once, with the rows of the fold one by one.

Every lane but the first begins without tracks some frames early, and all advance together,
a step being arrays over the tracks of all lanes. A lane counts only if it is proven to be what the fold does:
the tracks it holds at its start must be those that the lane before it ends with. Tracks that differ in
numbers alone (old ones, of which the last bits never become equal) are followed again
with the true numbers, and every pair that they may form must lead to the same choice. Any
other lane is folded anew, frame by frame, so the result never depends on the cut.
"""

from __future__ import annotations

import math

import numpy as np

from rallyloom.operators.players import STD_POSITION, STD_VELOCITY, PlayerFold, Track, assign_pairs, decide
from rallyloom.params import PlayerParams

#: Numbers of a track, in the order of the rows of ``Lanes.state``; then whole numbers, in that of ``Lanes.known``.
CX, CY, ASPECT, H, VX, VY, VA, VH, A, B, C, D, E, F = range(14)
LANE, UID, HITS, LAST, ID, LOST = range(6)
#: Frames that a lane begins early, frames of a lane, lanes at once, and elements of an array that end the attempt.
WARM, LENGTH, MOST, CROWD = 512, 1024, 256, 4_000_000
#: Lanes from which arrays are quicker than the fold.
LEAST = 6


class Crowded(Exception):
    """Too many tracks and boxes at once for arrays over all lanes."""


def _numbers(t: Track) -> tuple:
    if t.behind:
        t.spread(t.behind)
        t.behind = 0
    return t.cx, t.cy, t.aspect, t.h, t.vx, t.vy, t.va, t.vh, *t.size, *t.shape


def _track(numbers: list, known: list, number: int | None) -> Track:
    t = Track.__new__(Track)
    t.cx, t.cy, t.aspect, t.h, t.vx, t.vy, t.va, t.vh = numbers[:8]
    t.size, t.shape, t.behind, t.id = tuple(numbers[8:11]), tuple(numbers[11:]), 0, number
    t.hits, t.last, t.lost = known[HITS], known[LAST], bool(known[LOST])
    return t


def assign_flat(row: np.ndarray, column: np.ndarray, cost: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """``assign_pairs`` of many lanes' pairs: rows alone with their columns and columns alone with their rows as arrays."""
    n, m = np.bincount(row), np.bincount(column)
    wide, high = n[row] > 1, m[column] > 1
    if not (wide.any() or high.any()):
        return row, column
    by_column = np.bincount(column[wide], minlength=len(m))[column] == 0  # no row of this column has another
    by_row = np.bincount(row[high], minlength=len(n))[row] == 0
    rows, columns = [], []
    for chosen, key, other in ((by_column, column, row), (by_row & ~by_column, row, column)):
        (at,) = chosen.nonzero()
        at = at[np.lexsort((other[at], cost[at], key[at]))]
        at = at[np.r_[True, key[at][1:] != key[at][:-1]]] if len(at) else at
        rows.append(row[at])
        columns.append(column[at])
    hard = ~(by_column | by_row)
    if hard.any():
        found = assign_pairs([*zip(row[hard].tolist(), column[hard].tolist(), cost[hard].tolist())], limit)
        rows.append(np.array([a for a, _ in found], np.int64))
        columns.append(np.array([b for _, b in found], np.int64))
    return np.concatenate(rows), np.concatenate(columns)


def feasible(p, i, own, boxes, area, scores, has, lost):
    """Which pairs (track ``i`` of ``own``, a box each) a stage may take, at what cost: positions, costs, stages."""
    x1, y1, x2, y2 = own[:, i]
    u1, v1, u2, v2 = boxes
    w, h = np.minimum(x2, u2) - np.maximum(x1, u1), np.minimum(y2, v2) - np.maximum(y1, v1)
    inter = w * h
    union = (x2 - x1) * (y2 - y1) + area - inter
    far = 1 - inter / union
    touch, has, lost = (w > 0) & (h > 0) & (union > 0), has[i], lost[i]
    cost, strong = 1 - (1 - far) * scores, touch & (scores > p.high_conf)
    pool, young = strong & has & (cost <= p.match), strong & ~has & (cost <= p.unconfirmed_match)
    weak = touch & ~strong & (p.low_conf < scores) & (scores < p.high_conf) & (far <= p.second_match) & has & ~lost
    (at,) = (pool | young | weak).nonzero()
    return at, np.where(weak, far, cost)[at], np.where(pool, 0, np.where(weak, 1, 2))[at]


class Lanes:
    """``fold`` over steps: frame numbers, and of each the first of its boxes (rows of ``boxes``) and their count."""

    def __init__(self, fold: PlayerFold, frames: np.ndarray, low: np.ndarray, count: np.ndarray, boxes: np.ndarray, scores: np.ndarray, length: int, warm: int):
        self.fold, self.p, self.frames, self.low, self.count, self.boxes, self.scores = fold, fold.p, frames, low, count, np.ascontiguousarray(boxes), scores
        self.area = (boxes[2] - boxes[0]) * (boxes[3] - boxes[1])
        self.length, self.warm = max(length, -(-len(frames) // MOST)), warm
        self.n = -(-len(frames) // self.length)
        self.begin = len(frames) - (self.n - np.arange(self.n)) * self.length  # of the first lane: before its first step
        self.state, self.known, self.uids = np.empty((14, 0)), np.empty((6, 0), np.int64), 0
        self.pairs, self.matches, self.events, self.out = [], [], [], []
        self.failed = 0

    def _add(self, numbers: np.ndarray, lane, hits, last, has, lost=0) -> np.ndarray:
        new = np.empty((6, numbers.shape[1]), np.int64)
        new[LANE], new[UID], new[HITS], new[LAST], new[ID], new[LOST] = lane, np.arange(self.uids, self.uids + new.shape[1]), hits, last, has, lost
        self.uids += new.shape[1]
        self.state, self.known = np.concatenate([self.state, numbers], 1), np.concatenate([self.known, new], 1)
        return new[UID]

    def _measure(self, at: np.ndarray) -> np.ndarray:
        x1, y1, x2, y2 = self.boxes.take(at, 1)
        w, h = x2 - x1, y2 - y1
        return np.stack([(x1 + x2) / 2, (y1 + y2) / 2, np.where(h != 0, w / h, 0.0), h])

    def _spread(self) -> None:
        s = self.state
        q, r = STD_POSITION * s[H], STD_VELOCITY * s[H]
        s[A], s[B], s[C] = s[A] + 2 * s[B] + s[C] + q * q, s[B] + s[C], s[C] + r * r
        s[D], s[E], s[F] = s[D] + 2 * s[E] + s[F] + 1e-4, s[E] + s[F], s[F] + 1e-10

    def _step(self, step: int) -> None:
        p, at = self.p, self.begin + step
        seen = at >= 0
        at = np.maximum(at, 0)
        low, count, frame = self.low[at], np.where(seen, self.count[at], 0), self.frames[at]
        if step < 0:
            count[0] = 0
        state, known = self.state, self.known
        lane, has, lost = known[LANE], known[ID] > 0, known[LOST] > 0
        self._spread()
        state[VH][lost] = 0.0
        state[CX : VX] += state[VX : A]
        matched = np.full(lane.shape, -1)
        most = int(count.max(initial=0))
        if most:
            valid = np.arange(most) < count[:, None]
            cells = np.where(valid, low[:, None] + np.arange(most), 0)
            rows, taken = cells.ravel(), np.zeros(cells.size, bool)
            (held,) = count.take(lane).nonzero()
            if len(held) * most > CROWD or cells.size > CROWD:
                raise Crowded
        if most and len(held):
            w, h = state[ASPECT] * state[H] / 2, state[H] / 2
            own = np.stack([state[CX] - w, state[CY] - h, state[CX] + w, state[CY] + h])
            some = lane.take(held)
            u1, v1, u2, v2 = np.where(valid, self.boxes.take(cells, 1), math.nan)
            x1, y1, x2, y2 = own.take(held, 1)[:, :, None]
            touch = x1 < u2.take(some, 0)
            touch &= u1.take(some, 0) < x2
            touch &= y1 < v2.take(some, 0)
            touch &= v1.take(some, 0) < y2
            (flat,) = touch.ravel().nonzero()
            at, k = np.divmod(flat, most)
            i, column = held[at], some[at] * most + k
            row = rows[column]
            good, cost, stage = feasible(p, i, own, self.boxes.take(row, 1), self.area[row], self.scores[row], has, lost)
            i, column = i[good], column[good]
            if step >= 0:
                self.pairs.append((np.full(len(i), step), lane[i], known[UID][i], rows[column], cost, stage))
            for n, limit in enumerate((p.match, p.second_match, p.unconfirmed_match)):
                now = stage == n
                if n == 1:
                    now &= matched[i] < 0
                elif n == 2 and now.any():
                    now &= ~taken[column]
                if now.any():
                    chosen, columns = assign_flat(i[now], column[now], cost[now], limit)
                    matched[chosen] = columns
                    taken[columns] = True
        (met,) = (matched >= 0).nonzero()
        if len(met):
            own_rows = rows[matched[met]]
            self._update(met, own_rows)
            known[HITS, met] += 1
            known[LAST, met] = frame[lane[met]]
            known[LOST, met] = 0
            fresh = met[(known[ID, met] == 0) & (known[HITS, met] >= p.min_consecutive)]
            known[ID, fresh] = 1
            if step >= 0:
                self.matches.append((np.full(len(met), step), lane[met], known[UID, met], own_rows))
                self.events.append((lane[fresh], known[UID, fresh]))
                named = known[ID, met] > 0
                self.out.append((lane[met][named], known[UID, met][named], own_rows[named]))
        alone = matched < 0
        known[LOST, alone] = 1
        gone = alone & ((known[ID] == 0) | (frame[lane] - known[LAST] > self.fold.buffer))
        if gone.any():
            (kept,) = (~gone).nonzero()
            self.state, self.known = state.take(kept, 1), known.take(kept, 1)
        if most:
            s = self.scores[cells]
            (new,) = (valid & (s > p.high_conf) & (s >= p.high_conf + 0.1)).ravel().nonzero()
            new = new[~taken[new]]
            if len(new):
                on, rows = new // most, rows[new]
                measured = self._measure(rows)
                numbers, h = np.zeros((14, len(rows))), measured[3]
                numbers[:4] = measured
                q, v = 2 * STD_POSITION * h, 10 * STD_VELOCITY * h
                numbers[A], numbers[C], numbers[D], numbers[F] = q * q, v * v, 1e-2 * 1e-2, 1e-5 * 1e-5
                named = p.min_consecutive <= 1
                uids = self._add(numbers, on, 1, frame[on], int(named))
                if named and step >= 0:
                    self.events.append((on, uids))
                    self.out.append((on, uids, rows))

    def _update(self, at: np.ndarray, rows: np.ndarray) -> None:
        s = self.state.take(at, 1)
        a, b, c, d, e, f = s[A], s[B], s[C], s[D], s[E], s[F]
        noise = STD_POSITION * s[H]
        t = a + noise * noise
        k, kv = np.where(t != 0, a / t, math.nan), np.where(t != 0, b / t, math.nan)
        gap = self._measure(rows) - s[:4]
        u = d + 1e-2
        g, gv = d / u, e / u
        for x, v in ((CX, VX), (CY, VY), (H, VH)):
            s[x] += k * gap[x]
            s[v] += kv * gap[x]
        s[ASPECT] += g * gap[ASPECT]
        s[VA] += gv * gap[ASPECT]
        s[A], s[B], s[C] = a - k * a, b - k * b, c - kv * b
        s[D], s[E], s[F] = d - g * d, e - g * e, f - gv * e
        self.state[:, at] = s

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of tracked boxes and their ids; ``fold`` is then as after the last step."""
        late = -int(self.begin[0])  # steps before the first lane's first
        with np.errstate(all="ignore"):
            for step in range(-self.warm if self.n > 1 else 0, self.length):
                if step == 0:
                    first = self.state.copy(), self.known.copy()
                if step == late:
                    own = self.fold.tracks
                    numbers = np.array([_numbers(t) for t in own]).reshape(-1, 14).T
                    fields = np.array([(t.hits, t.last, t.id is not None, t.lost) for t in own], np.int64).reshape(-1, 4).T
                    uids = self._add(numbers, 0, *fields)
                self._step(step)
            return self._settle(first, uids)

    def _settle(self, first: tuple, uids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lane by lane: is it what the fold does from the true state on?"""
        pairs, matches, events, out = (_by_lane(x, n, at, self.n) for x, n, at in ((self.pairs, 6, 1), (self.matches, 4, 1), (self.events, 2, 0), (self.out, 3, 0)))
        begun, ended = _columns(*first, self.n), _columns(self.state, self.known, self.n)
        ids, rows, numbers = np.zeros(self.uids, np.int64), [], []
        ids[uids] = [t.id or 0 for t in self.fold.tracks]
        given = self.fold.given
        for lane in range(self.n):
            end = ended[lane]
            if lane:
                state, known, true_ids = true
                after = self._after(lane, begun[lane], state, known, end, pairs[lane], matches[lane])
                if after is None:
                    self.failed += 1
                    got, named, true, given = self._fold_lane(lane, state, known, true_ids, given)
                    rows.append(got)
                    numbers.append(named)
                    continue
                ids[begun[lane][1][UID]] = true_ids
                end = after, end[1]
            fresh = events[lane][1]
            ids[fresh] = np.arange(given + 1, given + 1 + len(fresh))
            given += len(fresh)
            rows.append(out[lane][2])
            numbers.append(ids[out[lane][1]])
            true = *end, ids[end[1][UID]]
        self.fold.tracks, self.fold.given = _tracks(*true), given
        return np.concatenate(rows), np.concatenate(numbers)

    def _fold_lane(self, lane: int, state, known, ids, given):
        fold, begin = self.fold, int(self.begin[lane])
        fold.tracks, fold.given = _tracks(state, known, ids), given
        rows, numbers = fold_steps(fold, *(x[begin : begin + self.length] for x in (self.frames, self.low, self.count)), self.boxes, self.scores)
        state = np.array([_numbers(t) for t in fold.tracks]).reshape(-1, 14).T
        known = np.array([(lane, -1, t.hits, t.last, t.id is not None, t.lost) for t in fold.tracks], np.int64).reshape(-1, 6).T
        return rows, numbers, (state, known, np.array([t.id or 0 for t in fold.tracks], np.int64)), fold.given

    def _after(self, lane: int, begun: tuple, state: np.ndarray, known: np.ndarray, end: tuple, pairs: tuple, matches: tuple) -> np.ndarray | None:
        """Numbers of the lane's last tracks from the true ones at its start; None where a choice may differ."""
        assumed, fields = begun
        if assumed.shape != state.shape:
            return None
        young = known[ID] == 0
        if (fields[HITS] != known[HITS])[young].any() or (fields[LAST:] != known[LAST:]).any():
            return None
        (other,) = (np.ascontiguousarray(assumed).view(np.int64) != np.ascontiguousarray(state).view(np.int64)).any(0).nonzero()
        numbers = end[0]
        if not len(other):
            return numbers
        numbers, doubtful, found = numbers.copy(), set(), {}
        for i in other.tolist():
            uid = int(fields[UID, i])
            mine = matches[2] == uid
            track, made = self._follow(lane, _track(state[:, i].tolist(), known[:, i].tolist(), 1 if known[ID, i] else None), dict(zip(matches[0][mine].tolist(), matches[3][mine].tolist())))
            mine = pairs[2] == uid
            step, _, _, *rest = (x[mine] for x in pairs)
            if not (len(step) == len(made[0]) and all(np.array_equal(x, y) for x, y in zip((step, *rest), made))):
                had, has = (set(zip(*(x.tolist() for x in y))) for y in ((step, *rest), made))
                doubtful |= {x[0] for x in had ^ has}
            found[uid] = made
            if track is not None:
                numbers[:, end[1][UID] == uid] = np.array(_numbers(track))[:, None]
        return numbers if all(self._same_choice(step, found, pairs, matches) for step in doubtful) else None

    def _follow(self, lane: int, track: Track, boxes: dict[int, int]) -> tuple[Track | None, tuple]:
        """The track with the lane's choices: what is left of it, and the pairs it may form by step."""
        begin, own, has, lost, alive = int(self.begin[lane]), [], [], [], True
        frames = self.frames[begin : begin + self.length].tolist()
        for step, frame in enumerate(frames):
            track.predict()
            own.append(track.box())
            has.append(track.id is not None)
            lost.append(track.lost)
            row = boxes.get(step)
            if row is not None:
                track.update(tuple(self.boxes[:, row].tolist()), frame)
                if track.hits >= self.p.min_consecutive:
                    track.id = 1
            elif track.id is None or frame - track.last > self.fold.buffer:
                alive = False
                break
            else:
                track.lost = True
        count = self.count[begin : begin + len(own)]
        step = np.repeat(np.arange(len(own)), count)
        rows = np.repeat(self.low[begin : begin + len(own)] - np.cumsum(count) + count, count) + np.arange(len(step))
        good, cost, stage = feasible(self.p, step, np.array(own).T, self.boxes[:, rows], self.area[rows], self.scores[rows], np.array(has), np.array(lost))
        return track if alive else None, (step[good], rows[good], cost, stage)

    def _same_choice(self, step: int, found: dict, pairs: tuple, matches: tuple) -> bool:
        at = slice(*np.searchsorted(pairs[0], (step, step + 1)))
        now = [x for x in zip(*(y[at].tolist() for y in pairs[2:])) if x[0] not in found]
        for uid, made in found.items():
            at = slice(*np.searchsorted(made[0], (step, step + 1)))
            now += [(uid, *x) for x in zip(*(y[at].tolist() for y in made[1:]))]
        now.sort(key=lambda x: x[:2])
        stages = [[x[:3] for x in now if x[3] == n] for n in range(3)]
        at = slice(*np.searchsorted(matches[0], (step, step + 1)))
        return decide(self.p, *stages) == dict(zip(matches[2][at].tolist(), matches[3][at].tolist()))


def _by_lane(parts: list[tuple], width: int, at: int, lanes: int) -> list[tuple]:
    """The recorded arrays of each lane, in their order."""
    whole = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.int64)] * width
    order = np.argsort(whole[at], kind="stable")
    whole = [x[order] for x in whole]
    cuts = np.searchsorted(whole[at], np.arange(lanes + 1))
    return [tuple(x[a:b] for x in whole) for a, b in zip(cuts, cuts[1:])]


def _columns(state: np.ndarray, known: np.ndarray, lanes: int) -> list[tuple]:
    return [(state[:, mine], known[:, mine]) for mine in (known[LANE] == lane for lane in range(lanes))]


def _tracks(state: np.ndarray, known: np.ndarray, ids: np.ndarray) -> list[Track]:
    return [_track(x, y, i or None) for x, y, i in zip(state.T.tolist(), known.T.tolist(), ids.tolist())]


def fold_steps(fold: PlayerFold, frames, low, count, boxes, scores) -> tuple[np.ndarray, np.ndarray]:
    """The steps one by one."""
    rows, numbers = [], []
    for frame, a, n in zip(frames.tolist(), low.tolist(), count.tolist()):
        for number, i in fold.advance(frame, [*map(tuple, boxes[:, a : a + n].T.tolist())], scores[a : a + n].tolist()):
            rows.append(a + i)
            numbers.append(number)
    return np.array(rows, np.int64), np.array(numbers, np.int64)


class ClipFold:
    """The fold of one clip, fed with its rows in order, whole frames at a time."""

    def __init__(self, params: PlayerParams, fps: float, length: int = LENGTH, warm: int = WARM, least: int = LEAST):
        self.fold, self.length, self.warm, self.least = PlayerFold(params, fps), length, warm, least
        self.last, self.wait, self.pause, self.lanes, self.failed = None, 0, 1, 0, 0

    def rows(self, frames: np.ndarray, boxes: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the tracked rows and their ids, by frame and id."""
        low = np.r_[0, np.nonzero(frames[1:] != frames[:-1])[0] + 1]
        frame, count = frames[low], np.diff(low, append=len(frames))
        before = np.r_[frame[0] - 1 if self.last is None else self.last, frame[:-1]]
        steps = 1 + np.minimum(frame - before - 1, max(self.fold.buffer + 1, 1))  # no track outlives more empty frames
        self.last, ends = int(frame[-1]), np.cumsum(steps)
        begin, found = 0, []
        while begin < len(low):
            done = ends[begin] - steps[begin]
            end = max(begin + 1, int(np.searchsorted(ends, done + MOST * self.length, "right"))) if self.fold.first is not None else begin + 1
            part = slice(begin, end)
            at = ends[part] - done - 1
            every = np.repeat(before[part] - (at - steps[part]), steps[part]) + np.arange(at[-1] + 1)
            some, lows = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
            every[at], some[at], lows[at] = frame[part], count[part], low[part]
            first, last = int(low[begin]), int(low[end - 1] + count[end - 1])
            lows[at] -= first
            rows, ids = self._part(every, lows, some, boxes[:, first:last], scores[first:last])
            found.append((rows + first, ids))
            begin = end
        rows, ids = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((ids, frames[rows]))
        return rows[order], ids[order]

    def _part(self, *part) -> tuple[np.ndarray, np.ndarray]:
        frames = part[0]
        if not self.fold.apart or not self.least * self.length <= len(frames) <= 2 * MOST * self.length or self.wait:
            self.wait = max(0, self.wait - 1)
            return fold_steps(self.fold, *part)
        lanes = Lanes(self.fold, *part, self.length, self.warm)
        try:
            found = lanes.run()
            self.lanes, self.failed = self.lanes + lanes.n, self.failed + lanes.failed
            poor = lanes.failed * 2 > lanes.n
        except Crowded:
            found, poor = fold_steps(self.fold, *part), True
        self.wait, self.pause = (self.pause, min(16, 2 * self.pause)) if poor else (0, 1)
        return found

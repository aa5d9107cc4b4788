"""Multi-object tracking of players by two-stage box association (ByteTrack's published method).

Each track predicts its box with a constant-velocity filter. Confident boxes are
matched first, by overlap; what is left of the tracks is matched with weak boxes;
young tracks and new ones follow. Clips are independent; a clip's frames are folded
in order, sorted by the shuffle, with ``PIECE_ROWS`` rows in memory at a time; ``lanes``
folds the stretches of such a piece at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyloom.params import PlayerParams
from rallyloom.schemas import TRACKS

#: Noise of position and velocity relative to the box height.
STD_POSITION, STD_VELOCITY = 1 / 20, 1 / 160
#: Tasks that clips are dealt to: many, so that two of a few clips seldom meet in one.
CLIP_TASKS = 200
#: Rows of a clip that are folded at once, and rows of a batch of tracks.
PIECE_ROWS, OUT_ROWS = 1 << 20, 50_000


def assign(cost: np.ndarray, limit: float) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Pairs of least total cost, none above the limit; unmatched rows and columns."""
    n, m = cost.shape
    a, b = np.nonzero(cost <= limit)
    pairs = assign_pairs([*zip(a.tolist(), b.tolist(), cost[a, b].tolist())], limit)
    rows, columns = {a for a, _ in pairs}, {b for _, b in pairs}
    return pairs, [i for i in range(n) if i not in rows], [j for j in range(m) if j not in columns]


def assign_pairs(feasible: list[tuple[int, int, float]], limit: float) -> list[tuple[int, int]]:
    """The same from the feasible pairs alone: row, column and cost, in order.

    Rows and columns that no chain of feasible pairs joins do not compete, so each
    such group is solved alone: the work follows the groups, not all tracks held.
    """
    if len(feasible) < 2:
        return [x[:2] for x in feasible]
    by_row: dict[int, dict[int, float]] = {}
    by_column: dict[int, list[int]] = {}
    for i, j, c in feasible:
        by_row.setdefault(i, {})[j] = c
        by_column.setdefault(j, []).append(i)
    pairs: list[tuple[int, int]] = []
    seen: set[int] = set()
    for first in by_row:
        if first in seen:
            continue
        group, met, todo = {first}, set(), [first]
        while todo:
            for j in by_row[todo.pop()]:
                if j not in met:
                    met.add(j)
                    for i in by_column[j]:
                        if i not in group:
                            group.add(i)
                            todo.append(i)
        seen |= group
        if len(met) == 1:  # any row of the group may have the column
            (j,) = met
            pairs.append((min(by_column[j], key=lambda i: by_row[i][j]), j))
        elif len(group) == 1:
            pairs.append((first, min(by_row[first], key=by_row[first].get)))
        else:
            r, c = sorted(group), sorted(met)
            flip = len(r) > len(c)
            one, other = (c, r) if flip else (r, c)
            dense = [[by_row[j].get(i, np.inf) for j in other] if flip else [by_row[i].get(j, np.inf) for j in other] for i in one]
            found = _least_pairs(dense, limit)
            pairs += [(other[b], one[a]) if flip else (one[a], other[b]) for a, b in found]
    return sorted(pairs)


def _least_pairs(cost: list[list[float]], limit: float) -> list[tuple[int, int]]:
    """Pairs of least total cost (shortest augmenting paths), from no more rows than columns.

    A row may stay alone for the limit. Groups are small as a rule, where plain
    numbers are quicker than arrays.
    """
    n, m = len(cost), len(cost[0])
    full = [[*(min(c, 2 * limit + 1) for c in row), *[limit] * n] for row in cost]
    if n * m > 256:
        return _least_pairs_wide(np.array(full), m, cost, limit)
    size = n + m
    u, v, owner = [0.0] * n, [0.0] * size, [-1] * size
    for i in range(n):
        least, way, used, path = [np.inf] * size, [-1] * size, [False] * size, []
        row, j0 = i, -1
        while True:
            delta, j1, costs, base = np.inf, -1, full[row], u[row]
            for j in range(size):
                if not used[j]:
                    reduced = costs[j] - base - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            u[i] += delta
            for j in path:
                u[owner[j]] += delta
                v[j] -= delta
            for j in range(size):
                if not used[j]:
                    least[j] -= delta
            j0 = j1
            if owner[j0] < 0:
                break
            used[j0], row = True, owner[j0]
            path.append(j0)
        while way[j0] >= 0:
            owner[j0], j0 = owner[way[j0]], way[j0]
        owner[j0] = i
    return [(owner[j], j) for j in range(m) if owner[j] >= 0 and cost[owner[j]][j] <= limit]


def _least_pairs_wide(full: np.ndarray, m: int, cost: list[list[float]], limit: float) -> list[tuple[int, int]]:
    """The same over arrays, for crowds."""
    n, size = full.shape
    u, v, owner = np.zeros(n), np.zeros(size), np.full(size, -1)
    for i in range(n):
        least, way, used = np.full(size, np.inf), np.full(size, -1), np.zeros(size, bool)
        row, j0 = i, -1
        while True:
            reduced = full[row] - u[row] - v
            better = ~used & (reduced < least)
            least[better], way[better] = reduced[better], j0
            j1 = int(np.argmin(np.where(used, np.inf, least)))
            delta = least[j1]
            u[i] += delta
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] < 0:
                break
            used[j0], row = True, owner[j0]
        while way[j0] >= 0:
            owner[j0], j0 = owner[way[j0]], way[j0]
        owner[j0] = i
    return [(int(owner[j]), j) for j in range(m) if owner[j] >= 0 and cost[owner[j]][j] <= limit]


def overlap_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - intersection over union of every box of ``a`` with every box of ``b``."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.prod(np.clip(high - low, 0, None), 2)
    area = lambda x: np.prod(x[:, 2:] - x[:, :2], 1)
    union = area(a)[:, None] + area(b)[None] - inter
    return 1 - np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def overlapping(a: list[tuple], b: list[tuple]) -> Iterator[tuple[int, int, float]]:
    """``row, column, distance`` of pairs of boxes with an intersection, of few boxes."""
    sized = [(*y, (y[2] - y[0]) * (y[3] - y[1])) for y in b]
    for i, (x1, y1, x2, y2) in enumerate(a):
        for j, (u1, v1, u2, v2, area) in enumerate(sized):
            if x1 < u2 and u1 < x2 and y1 < v2 and v1 < y2:
                w, h = (x2 if x2 < u2 else u2) - (x1 if x1 > u1 else u1), (y2 if y2 < v2 else v2) - (y1 if y1 > v1 else v1)
                if w > 0 and h > 0:
                    inter = w * h
                    union = (x2 - x1) * (y2 - y1) + area - inter
                    if union > 0:
                        yield i, j, 1 - inter / union


class Track:
    """Centre, aspect and height with their velocities; each has a filter of its own
    (position and velocity), as noise is independent between them.

    The noise of the centre and the height is the same, so they share one covariance
    (``size``: position, both, velocity); the aspect has ``shape``. A lost track's
    height stands still, so its covariance waits (``behind`` frames) until the track is
    found again. Plain numbers: a clip has few tracks at once.
    """

    __slots__ = ("cx", "cy", "aspect", "h", "vx", "vy", "va", "vh", "size", "shape", "behind", "id", "hits", "last", "lost")

    def __init__(self, box: tuple, frame: int):
        self.cx, self.cy, self.aspect, self.h = self.measure(box)
        self.vx = self.vy = self.va = self.vh = 0.0
        p, v = 2 * STD_POSITION * self.h, 10 * STD_VELOCITY * self.h
        self.size, self.shape = (p * p, 0.0, v * v), (1e-2 * 1e-2, 0.0, 1e-5 * 1e-5)
        self.behind, self.id, self.hits, self.last, self.lost = 0, None, 1, frame, False

    @staticmethod
    def measure(box: tuple) -> tuple[float, float, float, float]:
        x1, y1, x2, y2 = box
        w, h = x2 - x1, y2 - y1
        return (x1 + x2) / 2, (y1 + y2) / 2, w / h if h else 0.0, h

    def predict(self) -> None:
        if self.lost:
            self.vh = 0.0
            self.behind += 1
        else:
            self.spread(1)
        self.cx += self.vx
        self.cy += self.vy
        self.aspect += self.va
        self.h += self.vh

    def spread(self, frames: int) -> None:
        """The covariance so many frames on, at this height."""
        q, r = STD_POSITION * self.h, STD_VELOCITY * self.h
        q, r = q * q, r * r
        (a, b, c), (d, e, f) = self.size, self.shape
        for _ in range(frames):
            a, b, c = a + 2 * b + c + q, b + c, c + r
            d, e, f = d + 2 * e + f + 1e-4, e + f, f + 1e-10
        self.size, self.shape = (a, b, c), (d, e, f)

    def update(self, box: tuple, frame: int) -> None:
        if self.behind:
            self.spread(self.behind)
            self.behind = 0
        cx, cy, aspect, h = self.measure(box)
        (a, b, c), (d, e, f) = self.size, self.shape
        noise = STD_POSITION * self.h
        s = a + noise * noise
        k, kv = (a / s, b / s) if s else (math.nan, math.nan)
        self.size = a - k * a, b - k * b, c - kv * b
        gx, gy, gh = cx - self.cx, cy - self.cy, h - self.h
        self.cx += k * gx
        self.cy += k * gy
        self.h += k * gh
        self.vx += kv * gx
        self.vy += kv * gy
        self.vh += kv * gh
        s = d + 1e-2
        k, kv, gap = d / s, e / s, aspect - self.aspect
        self.shape = d - k * d, e - k * e, f - kv * e
        self.aspect += k * gap
        self.va += kv * gap
        self.hits, self.last, self.lost = self.hits + 1, frame, False

    def box(self) -> tuple[float, float, float, float]:
        w, h = self.aspect * self.h / 2, self.h / 2
        return self.cx - w, self.cy - h, self.cx + w, self.cy + h


def decide(p: PlayerParams, pool: list[tuple], weak: list[tuple], young: list[tuple]) -> dict[int, int]:
    """Box of each matched track, from the feasible pairs of the three stages."""
    matched = dict(assign_pairs(pool, p.match))
    if weak:
        matched |= assign_pairs([x for x in weak if x[0] not in matched], p.second_match)
    if young:
        taken = set(matched.values())
        matched |= assign_pairs([x for x in young if x[1] not in taken], p.unconfirmed_match)
    return matched


class PlayerFold:
    #: Pairs of tracks and boxes beyond which arrays are quicker than plain numbers.
    CROWD = 2000

    def __init__(self, params: PlayerParams, fps: float):
        self.p, self.buffer = params, int(round(fps) / 30 * params.lost_buffer)
        self.tracks: list[Track] = []
        self.given, self.first = 0, None
        self.apart = max(params.match, params.second_match, params.unconfirmed_match) < 1  # boxes apart never match

    def _near(self, boxes: list[tuple]) -> Iterator[tuple[int, int, float]]:
        """``track, box, distance`` of pairs that may match."""
        own = [t.box() for t in self.tracks]
        if self.apart and len(own) * len(boxes) <= self.CROWD:
            return overlapping(own, boxes)
        far = overlap_distance(np.array(own).reshape(-1, 4), np.array(boxes).reshape(-1, 4))
        some = np.nonzero(far < 1 if self.apart else far == far)
        return zip(*(x.tolist() for x in some), far[some].tolist())

    def step(self, frame: int, boxes: np.ndarray, scores: np.ndarray) -> list[tuple[int, int]]:
        """(track id, index of its box) of the frame's tracked boxes."""
        return self.advance(frame, np.asarray(boxes, float).reshape(-1, 4).tolist(), np.asarray(scores, float).tolist())

    def advance(self, frame: int, boxes: list[tuple], scores: list[float]) -> list[tuple[int, int]]:
        """``step`` of plain numbers."""
        p, tracks = self.p, self.tracks
        self.first = frame if self.first is None else self.first
        for t in tracks:
            t.predict()
        pool, weak, young = [], [], []  # feasible pairs of the three stages
        if boxes:
            for i, j, far in self._near(boxes):
                s, t = scores[j], tracks[i]
                if s > p.high_conf:
                    cost = 1 - (1 - far) * s
                    if t.id is None:
                        if cost <= p.unconfirmed_match:
                            young.append((i, j, cost))
                    elif cost <= p.match:
                        pool.append((i, j, cost))
                elif p.low_conf < s < p.high_conf and far <= p.second_match and t.id is not None and not t.lost:
                    weak.append((i, j, far))
        matched = decide(p, pool, weak, young)
        out: list[tuple[int, int]] = []
        self.tracks = []
        for i, t in enumerate(tracks):
            j = matched.get(i)
            if j is not None:
                t.update(boxes[j], frame)
                if t.id is None and t.hits >= p.min_consecutive:
                    self.given += 1
                    t.id = self.given
                if t.id is not None:
                    out.append((t.id, j))
            elif t.id is None or frame - t.last > self.buffer:
                continue
            else:
                t.lost = True
            self.tracks.append(t)
        taken = set(matched.values())
        for j, s in enumerate(scores):
            if s > p.high_conf and s >= p.high_conf + 0.1 and j not in taken:
                track = Track(boxes[j], frame)
                if p.min_consecutive <= 1 or frame == self.first:
                    self.given += 1
                    track.id = self.given
                    out.append((track.id, j))
                self.tracks.append(track)
        return sorted(out)


def player_tracks(detections: DataFrame, fps: float, params: PlayerParams = PlayerParams()) -> DataFrame:
    """``clip, frame_idx, track_id, x1, y1, x2, y2, confidence`` of tracked boxes.

    ``detections``: ``clip, frame_idx, x1, y1, x2, y2, confidence, ord``. Boxes are
    rounded to single precision, as trackers of this kind hold them.
    """
    corners = ("x1", "y1", "x2", "y2")
    box = [F.col(c).cast("float").cast("double").alias(c) for c in corners]
    tasks = max(CLIP_TASKS, int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = detections.select("clip", "frame_idx", "ord", *box, "confidence").repartition(tasks, "clip")
    ordered = dealt.sortWithinPartitions("clip", "frame_idx", "ord", *corners, "confidence").drop("ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from rallyloom.operators.lanes import ClipFold

        names = [x.split()[0] for x in TRACKS.split(", ")]
        types = [pa.int64()] * 3 + [pa.float64()] * 5
        fold = None
        for rows, fresh in _pieces(_whole_frames(batches)):
            if fresh:
                fold = ClipFold(params, fps)
            frames, *columns = rows.columns[1:]
            if frames.null_count:
                raise ValueError("a box without a frame")
            *corners, scores = (np.asarray(c.to_numpy(zero_copy_only=False), float) for c in columns)
            picked, ids = fold.rows(frames.to_numpy(), np.array(corners), scores)
            for begin in range(0, len(ids), OUT_ROWS):
                taken = rows.take(pa.array(picked[begin : begin + OUT_ROWS])).columns
                out = [*taken[:2], pa.array(ids[begin : begin + OUT_ROWS]), *taken[2:]]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(out, types)], names)

    return ordered.mapInArrow(run, TRACKS)


def _whole_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, cut where a frame ends."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        clips, frames = batch.column("clip"), batch.column("frame_idx")
        key = lambda i: (clips[i].as_py(), frames[i].as_py())  # noqa: E731, B023
        cut, end = batch.num_rows - 1, key(batch.num_rows - 1)
        while cut and key(cut - 1) == end:
            cut -= 1
        if cut or (held and key(0) != before):
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
        before = end
    if held:
        yield pa.concat_batches(held)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Rows of one clip, many at once, and whether the clip begins with them."""
    held: list[pa.RecordBatch] = []
    size, clip, fresh = 0, None, True
    for batch in batches:
        codes = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
        cuts = [0, *(np.nonzero(codes[1:] != codes[:-1])[0] + 1).tolist(), len(codes)]
        for begin, end in zip(cuts, cuts[1:]):
            own = batch.column(0)[begin].as_py()
            if held and (own != clip or size >= PIECE_ROWS):
                yield pa.concat_batches(held), fresh
                held, size, fresh = [], 0, own != clip
            clip = own
            held.append(batch.slice(begin, end - begin))
            size += end - begin
    if held:
        yield pa.concat_batches(held), fresh

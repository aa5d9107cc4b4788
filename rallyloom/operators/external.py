"""Operators around models outside the engine: detectors and remote verifiers, both injectable."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A detector takes a row and returns boxes (class, x1, y1, x2, y2, confidence).
Detector = Callable[[dict], list[tuple]]

_models: dict[str, Detector] = {}


def detect(frames: DataFrame, key: str, load: Callable[[], Detector], name: str, min_conf: float, classes: tuple[str, ...] | None = None) -> DataFrame:
    """``key, class, x1, y1, x2, y2, confidence, ord``: boxes of each frame at or above the floor,
    of ``classes`` only if given (a general model finds more than players).

    ``load`` makes the detector once per worker. Floors apply before rounding (boxes
    to one digit, confidence to three, halves to even).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _models:
            _models[name] = load()
        model = _models[name]
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                found = [b for b in model(row) if b[5] >= min_conf and (classes is None or b[0] in classes)]
                rows += [(row[key], b[0], *[round(v, 1) for v in b[1:5]], round(b[5], 3), i) for i, b in enumerate(found)]
            yield pd.DataFrame(rows, columns=[key, "class", "x1", "y1", "x2", "y2", "confidence", "ord"])

    kind = dict(frames.dtypes)[key]
    return frames.mapInPandas(run, f"{key} {kind}, class string, x1 double, y1 double, x2 double, y2 double, confidence double, ord int")


def players_and_ball(players: DataFrame, ball: DataFrame, key: str) -> DataFrame:
    """Boxes of two models in one table, the players' first; ``ord`` counts on."""
    ahead = players.groupBy(F.col(key).alias("_key")).agg((F.max("ord") + 1).alias("_ahead"))
    after = ball.join(ahead, F.col(key) == F.col("_key"), "left").withColumn("ord", (F.col("ord") + F.coalesce("_ahead", F.lit(0))).cast("int"))
    return players.unionByName(after.drop("_key", "_ahead"))


class RateLimited(Exception):
    def __init__(self, retry_after: float | None = None):
        super().__init__("rate limited")
        self.retry_after = retry_after


def delays(tries: int, base: float, jitter: Callable[[], float] = random.random) -> Iterator[float]:
    """The waits between tries, each about twice the one before."""
    return (base * (1 << n) + jitter() for n in range(tries - 1))


def with_backoff(call: Callable[[], dict], tries: int = 6, base: float = 2.0, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> dict:
    """Retries only where the service limits the rate; what the service asks for goes before the own delay."""
    waits = delays(tries, base, jitter)
    limit = None
    while limit is None or (wait := next(waits, None)) is not None:
        if limit is not None:
            sleep(wait if limit.retry_after is None else limit.retry_after)
        try:
            return call()
        except RateLimited as told:
            limit = told
    raise limit


def verify(frames: DataFrame, key: str, connect: Callable[[], Callable[[dict], dict]], concurrency: int = 8) -> DataFrame:
    """``key, ball_visible, bbox, confidence, notes, error``: one remote answer a frame.

    A failed call fills ``error`` of its row and spares the others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = connect()

        def one(row: dict) -> tuple:
            try:
                a = with_backoff(lambda: client(row))
                return row[key], a.get("ball_visible"), a.get("bbox"), a.get("confidence"), a.get("notes"), None
            except Exception as problem:  # one frame's failure is a value
                return row[key], None, None, None, None, str(problem)

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                yield pd.DataFrame([*pool.map(one, batch.to_dict("records"))], columns=[key, "ball_visible", "bbox", "confidence", "notes", "error"])

    kind = dict(frames.dtypes)[key]
    return frames.mapInPandas(run, f"{key} {kind}, ball_visible boolean, bbox array<double>, confidence string, notes string, error string")


def answers(verified: DataFrame) -> DataFrame:
    """Verification rows in the form that ``assign_tiers`` takes."""
    return verified.withColumn("has_bbox", F.coalesce(F.size("bbox") == 4, F.lit(False)))

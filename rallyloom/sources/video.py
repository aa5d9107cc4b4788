"""Video frames as a Spark data source; decoding is left to an injected function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition



def use_decoder(name: str, info: Callable[[str], int], decode: Callable[[str, int, int], Iterator[tuple[int, bytes]]]) -> type[DataSource]:
    """A source class ``name`` for ``spark.dataSource.register``.

    With the option ``pushdown`` (the session needs ``spark.sql.python.filterPushdown.enabled``)
    a filter on one frame or clip decodes no other.
    ``decode(clip, first, last)`` yields ``(frame_idx, bytes)``; ``info(clip)`` is the number of frames.
    """

    class Range(InputPartition):
        def __init__(self, clip: str, first: int, last: int):
            self.clip, self.first, self.last = clip, first, last

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.clips = [c for c in options.get("clips", "").split(",") if c]
            self.start, self.limit = int(options.get("start", 0)), int(options.get("limit", 0))
            self.step = int(options.get("framesPerPartition", 3000))
            self.only: dict[str, object] = {}


        def partitions(self) -> list[InputPartition]:
            """Ranges of frames; a limit of 0 means the whole clip."""
            out = []
            for clip in self.clips:
                if self.only.get("clip", clip) != clip:
                    continue
                total = info(clip)
                end = min(total, self.start + self.limit) if self.limit else total
                if "frame_idx" in self.only:
                    frame = self.only["frame_idx"]
                    out += [Range(clip, frame, frame + 1)] if self.start <= frame < end else []
                    continue
                out += [Range(clip, a, min(a + self.step, end)) for a in range(self.start, end, self.step)]
            return out

        def read(self, part: Range | None) -> Iterator[tuple]:
            if part is not None:  # no partition at all: nothing was asked for that there is
                for frame, content in decode(part.clip, part.first, part.last):
                    yield part.clip, frame, content

    class PushedReader(Reader):
        def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
            """A single frame or clip is read alone: equalities on ``frame_idx`` and ``clip`` are taken over."""
            for f in filters:
                if isinstance(f, EqualTo) and f.attribute in (("frame_idx",), ("clip",)) and f.attribute[0] not in self.only:
                    self.only[f.attribute[0]] = f.value
                else:
                    yield f

    class Frames(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "clip string, frame_idx bigint, content binary"

        def reader(self, schema) -> DataSourceReader:
            return (PushedReader if self.options.get("pushdown", "").lower() == "true" else Reader)(self.options)

    return Frames

"""A lazy array over a stored video, sliced by time, rows and columns; slices are put together before anything is read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.functions.units import clock_name

#: Named resolutions (height, width).
RESOLUTIONS = {"4K": (2160, 3840), "2K": (1080, 1920), "1K": (540, 960)}
FPS = 30
FULL = slice(None)


@dataclass(frozen=True)
class Axis:
    """A range start..stop of an axis with a step; ``full`` is the extent of the whole axis."""

    start: Fraction
    stop: Fraction
    step: Fraction
    full: Fraction

    def narrowed(self, by: slice) -> Axis:
        """The part ``by`` of this range, positions counted from its start, cut at its end."""
        low = self.start if by.start is None else self.start + Fraction(by.start)
        length = None if by.stop is None else Fraction(by.stop) - Fraction(by.start or 0)
        high = self.stop if length is None else min(self.stop, low + length)
        return replace(self, start=low, stop=max(low, high), step=self.step if by.step is None else Fraction(by.step))

    def scaled(self, factor: Fraction) -> Axis:
        return replace(self, start=Fraction(int(self.start * factor)), stop=Fraction(int(self.stop * factor)), full=Fraction(int(self.full * factor)))

    @property
    def length(self) -> Fraction:
        return self.stop - self.start

    def __str__(self) -> str:
        low = "" if self.start == 0 else str(self.start)
        high = "" if self.stop == self.full else str(self.stop)
        return f"{low}:{high}" + ("" if self.step == 1 else f":{self.step}")


@dataclass(frozen=True)
class VideoArray:
    """The view (t, y, x). ``read`` lowers it to a read of frames: read(name, resolution, roi, t, fps) -> DataFrame."""

    name: str
    t: Axis
    y: Axis
    x: Axis
    read: Callable[..., DataFrame] | None = None

    @classmethod
    def of(cls, name: str, duration: float | Fraction, height: int, width: int, read: Callable[..., DataFrame] | None = None) -> VideoArray:
        whole = lambda n, step=1: Axis(Fraction(0), Fraction(n), Fraction(step), Fraction(n))
        return cls(name, whole(duration, Fraction(1, FPS)), whole(height), whole(width), read)

    @property
    def shape(self) -> tuple[int, int, int]:
        """Seconds, rows and columns."""
        return int(self.t.length), int(self.y.length), int(self.x.length)

    @property
    def fps(self) -> Fraction:
        return 1 / self.t.step

    def __getitem__(self, address) -> VideoArray:
        parts = address if isinstance(address, tuple) else (address,)
        if len(parts) > 3:
            raise IndexError(f"an address has at most three parts, not {len(parts)}")
        axes = []
        for axis, by in zip((self.t, self.y, self.x), (*parts, FULL, FULL), strict=False):
            if not isinstance(by, slice):
                by = slice(by, by + (axis.step if axis is self.t else 1))
            axes.append(axis.narrowed(by))
        return replace(self, t=axes[0], y=axes[1], x=axes[2])

    def at(self, resolution: str | tuple[int, int]) -> VideoArray:
        """The same view at another resolution of the whole picture."""
        height, width = RESOLUTIONS[resolution] if isinstance(resolution, str) else resolution
        return replace(self, y=self.y.scaled(Fraction(height) / self.y.full), x=self.x.scaled(Fraction(width) / self.x.full))

    def array_split(self, sections: int | list, axis: int = 0) -> list[VideoArray]:
        """Views of equal sections, or between the given positions, of one axis."""
        own = (self.t, self.y, self.x)[axis]
        if isinstance(sections, int):
            cuts = [own.length * k / sections for k in range(sections + 1)]
        else:
            cuts = [Fraction(0), *map(Fraction, sections), own.length]
        parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return [self[(*[FULL] * axis, part)] for part in parts]

    def to_df(self) -> DataFrame:
        """Frames of the view; nothing is read before an action."""
        roi = None if (self.y.length, self.x.length) == (self.y.full, self.x.full) else (int(self.y.start), int(self.x.start), int(self.y.stop), int(self.x.stop))
        return self.read(self.name, resolution=(int(self.y.full), int(self.x.full)), roi=roi, t=(float(self.t.start), float(self.t.stop)), fps=float(self.fps))

    def to_numpy(self) -> np.ndarray:
        """The frames as (t, y, x, channel). This collects them: for views that fit into memory."""
        rows = self.to_df().orderBy("t").select("height", "width", "channels", F.col("pixels")).collect()
        frames = [np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"], row["channels"]) for row in rows]
        return np.stack(frames) if frames else np.zeros((0, int(self.y.length), int(self.x.length), 3), np.uint8)

    def __str__(self) -> str:
        fps = self.fps
        t = replace(self.t, step=Fraction(1))
        return f"{self.name}({int(self.y.full)}x{int(self.x.full)}@{fps}fps)[{t}, {self.y}, {self.x}]"

    def duration_name(self) -> str:
        return clock_name(self.t.length)

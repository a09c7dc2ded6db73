"""Detections as CSV without a header, and detectors that users bring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "start_time double, confidence double, y1 int, x1 int, y2 int, x2 int"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=SCHEMA)


def write(rows: DataFrame, path: str) -> None:
    rows.select(*[part.split()[0] for part in SCHEMA.split(", ")]).write.csv(path)


def detect(frames: DataFrame, detector: Callable[[np.ndarray], list[tuple[str, float, int, int, int, int]]]) -> DataFrame:
    """``detector`` on each frame: rows of video_id, frame_no, start_time, label, confidence, y1, x1, y2, x2."""
    names = ["video_id", "frame_no", "start_time", "label", "confidence", "y1", "x1", "y2", "x2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in batch.itertuples():
                picture = np.frombuffer(x.pixels, np.uint8).reshape(x.height, x.width, x.channels)
                rows += [(x.video_id, x.frame_no, x.t, *found) for found in detector(picture)]
            yield pd.DataFrame(rows, columns=names)

    return frames.mapInPandas(run, "video_id long, frame_no long, start_time double, label string, confidence double, y1 int, x1 int, y2 int, x2 int")

"""Local descriptors of images and sounds, where the decoding libraries are installed."""

from __future__ import annotations

from collections.abc import Iterator
from importlib.util import find_spec

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAX_SIDE, RATE, COEFFICIENTS, SECONDS = 1024, 22_050, 20, 5.0


class MissingLibrary(RuntimeError):
    """A decoder that this environment does not have."""


def _need(name: str) -> None:
    if find_spec(name) is None:
        raise MissingLibrary(f"{name} is not installed; give descriptors as arrays instead")


def scaled_size(width: int, height: int, most: int = MAX_SIDE) -> tuple[int, int]:
    """The size with its longer side at most ``most``, proportions kept."""
    scale = min(1.0, most / max(width, height))
    return max(1, round(width * scale)), max(1, round(height * scale))


def image_descriptors(spark: SparkSession, files: str) -> DataFrame:
    """(path, descriptor) of the SIFT descriptors of image files, 128 numbers each."""
    _need("cv2")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import cv2

        sift = cv2.SIFT_create()
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                grey = cv2.imdecode(np.frombuffer(content, np.uint8), cv2.IMREAD_GRAYSCALE)
                found = None
                if grey is not None:
                    found = sift.detectAndCompute(cv2.resize(grey, scaled_size(grey.shape[1], grey.shape[0])), None)[1]
                yield pd.DataFrame({"path": path, "descriptor": [] if found is None else found.tolist()})

    return spark.read.format("binaryFile").load(files).select("path", "content").mapInPandas(run, "path string, descriptor array<float>")


def segment_bounds(duration: float, seconds: float = SECONDS, tail: float = 0.5) -> list[tuple[float, float]]:
    """Whole segments of a sound, and what is left of it if that is at least half a segment."""
    n = int(duration // seconds)
    out = [(k * seconds, (k + 1) * seconds) for k in range(n)]
    return [*out, (n * seconds, duration)] if duration - n * seconds >= tail * seconds else out


def audio_descriptors(spark: SparkSession, files: str) -> DataFrame:
    """(path, segment, descriptor) of the MFCC frames of sound files, 20 numbers each."""
    _need("librosa")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import librosa

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                signal, _ = librosa.load(io.BytesIO(content), sr=RATE, mono=True)
                for k, (a, b) in enumerate(segment_bounds(len(signal) / RATE)):
                    made = librosa.feature.mfcc(y=signal[int(a * RATE) : int(b * RATE)], sr=RATE, n_mfcc=COEFFICIENTS)
                    yield pd.DataFrame({"path": path, "segment": k, "descriptor": made.T.astype(np.float32).tolist()})

    return spark.read.format("binaryFile").load(files).select("path", "content").mapInPandas(run, "path string, segment int, descriptor array<float>")

"""16-bit PCM WAV as a Spark data source, and its encoding as functions over bytes."""

from __future__ import annotations

import io
import os
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, sample_rate int, channels int, samples array<float>"


def quantize(samples: np.ndarray) -> np.ndarray:
    clipped = np.clip(np.asarray(samples, np.float32), -1.0, 1.0)
    return (clipped * np.float32(32767)).astype("<i2")


def encode(samples: np.ndarray, sample_rate: int, channels: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(sample_rate)
        w.writeframes(quantize(samples).tobytes())
    return out.getvalue()


def decode(content: bytes) -> tuple[np.ndarray, int, int]:
    """(interleaved samples, sample rate, channels); only 16-bit files."""
    with wave.open(io.BytesIO(content), "rb") as r:
        if r.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM WAV is supported")
        values = np.frombuffer(r.readframes(r.getnframes()), "<i2")
        return (values.astype(np.float32) / np.float32(32767)).astype(np.float32), r.getframerate(), r.getnchannels()


def decode_voice(content: bytes) -> tuple[np.ndarray, int, int]:
    """(mono samples, sample rate, channels of the file): frames are read as 16-bit whatever their width, channels averaged."""
    with wave.open(io.BytesIO(content), "rb") as r:
        rate, channels, raw = r.getframerate(), r.getnchannels(), r.readframes(r.getnframes())
    values = np.frombuffer(raw, "<i2").astype(np.float32) / np.float32(32767)
    return values.reshape(-1, channels).mean(axis=1, dtype=np.float32) if channels > 1 else values, rate, channels


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]

    def partitions(self) -> list[_File]:
        if os.path.isfile(self.root):
            return [_File(self.root)]
        return [_File(os.path.join(d, f)) for d, _, names in sorted(os.walk(self.root)) for f in sorted(names) if f.lower().endswith(".wav")]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            samples, rate, channels = decode(f.read())
        yield partition.path, rate, channels, samples.tolist()


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class _Writer(DataSourceWriter):
    """Each row goes to its own path below the root, by a rename, so a task that runs again writes the same files."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def write(self, rows: Iterator) -> _Written:
        done = []
        for row in rows:
            path = os.path.join(self.root, row["path"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(f"{path}.{os.getpid()}.part", "wb") as f:
                f.write(encode(np.array(row["samples"], np.float32), row["sample_rate"], row["channels"]))
            os.replace(f.name, path)
            done.append(path)
        return _Written(done)


class WavSource(DataSource):
    """spark.dataSource.register(WavSource); then format("wav") reads a file or folder and writes rows of SCHEMA.

    It opens paths by themselves, so the folder must be one that all executors mount. read_wav_files needs none.
    """

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def read_wav_files(spark, path: str, decoder=decode):
    """WAV files of any store that Spark reads, through binaryFile. With decode_voice, voices: mono samples, the file's channels."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *(lambda s, r, c: (r, c, s))(*decoder(b))) for p, b in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "channels", "samples"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)

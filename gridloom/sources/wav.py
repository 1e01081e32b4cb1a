"""A data source for PCM WAV files, to be read and written as tables of whole clips.

    spark.dataSource.register(WavDataSource)
    spark.read.format("wav").load(folder)              # (path, sample_rate, channels, frames, samples)
    df.write.format("wav").mode("append").save(folder) # needs path and samples; sample_rate, else 44100

Samples are mono in [-1, 1]: channels are averaged. Eight, 16, 24 and 32 bit files are read, 16 bit ones written. A file that
cannot be read yields a row with null samples. Files are spread over partitions by size.
"""

from __future__ import annotations

import os
import wave
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, sample_rate int, channels int, frames bigint, samples array<float>"
#: Bytes of files that one partition reads.
PARTITION_BYTES = 64 << 20


def decode(path: str) -> tuple[int, int, int, np.ndarray]:
    """(sample rate, channels, frames, mono samples) of a WAV file."""
    with wave.open(path, "rb") as f:
        rate, channels, width, n = f.getframerate(), f.getnchannels(), f.getsampwidth(), f.getnframes()
        raw = f.readframes(n)
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / 8388608
    else:
        x = np.frombuffer(raw, "<i4").astype(np.float64).astype(np.float32) / 2147483648
    return rate, channels, n, x.reshape(-1, channels).mean(1) if channels > 1 else x


def encode(path: str, samples: np.ndarray, rate: int) -> None:
    """Writes 16-bit mono, clipped; a file appears under its name only when it is whole."""
    x = np.clip(np.round(np.asarray(samples, np.float64) * 32768), -32768, 32767).astype("<i2")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.{os.getpid()}.part"
    with wave.open(part, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(int(rate))
        f.writeframes(x.tobytes())
    os.replace(part, path)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, folder: str, recursive: bool):
        self.folder, self.recursive = folder, recursive

    def partitions(self) -> list[InputPartition]:
        found = []
        for base, dirs, names in os.walk(self.folder):
            found += [(os.path.join(base, n), os.path.getsize(os.path.join(base, n))) for n in names if n.lower().endswith(".wav")]
            if not self.recursive:
                dirs.clear()
        out, now, held = [], [], 0
        for path, size in sorted(found):
            if now and held + size > PARTITION_BYTES:
                out.append(_Files(now))
                now, held = [], 0
            now.append(path)
            held += size
        return out + [_Files(now)] if now or not out else out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                rate, channels, n, x = decode(path)
                yield path, rate, channels, n, x.tolist()
            except (wave.Error, EOFError, OSError):
                yield path, None, None, None, None


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names

    def write(self, rows: Iterator) -> WriterCommitMessage:
        for row in rows:
            values = row.asDict() if hasattr(row, "asDict") else dict(zip(self.names, row))
            if values.get("samples") is not None and values.get("path"):
                encode(os.path.join(self.folder, values["path"].lstrip("/")), values["samples"], values.get("sample_rate") or 44100)
        return WriterCommitMessage()


class WavDataSource(DataSource):
    """Format `wav`; options: path, recursive (default true)."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> str:
        return self.options["path"].removeprefix("file://").removeprefix("file:")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._folder(), self.options.get("recursive", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self._folder(), schema.fieldNames())

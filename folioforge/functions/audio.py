"""Sample-array arithmetic on array<float> as Column expressions; samples of several channels are interleaved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 32767
SILENT_BELOW = 1e-5


def silence_frames(sample_rate: Column, milliseconds: Column) -> Column:
    """Whole frames in a pause: the rate times seconds, in doubles, cut off."""
    return F.floor(sample_rate.cast("double") * (milliseconds.cast("double") / F.lit(1000.0))).cast("long")


def silence(sample_rate: Column, milliseconds: Column, channels: Column) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), (silence_frames(sample_rate, milliseconds) * channels).cast("int"))


def shape_fault(samples: Column, channels: Column) -> Column:
    """Why interleaved samples are no whole frames: channels or length; null if they are."""
    return F.when(channels.isNull() | (channels < 1), "channels").when(F.size(samples) % channels != 0, "length")


def frames(samples: Column, channels: Column) -> Column:
    """Interleaved samples as an array of frames, each an array of one sample a channel. What is no whole frames is refused."""
    fault = shape_fault(samples, channels)
    count = (F.size(samples) / channels).cast("int")
    cut = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(samples, i * channels + 1, channels))).otherwise(F.array().cast("array<array<float>>"))
    refused = F.raise_error(F.concat(F.lit("samples are no frames: "), fault)).cast("array<array<float>>")
    return F.when(fault.isNull(), cut).otherwise(refused)


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, F.abs)), F.lit(0.0).cast("float"))


def quantize(samples: Column) -> Column:
    """16-bit values: clipped to [-1, 1], times 32767 in single precision, cut off toward zero."""
    one = F.lit(1.0).cast("float")
    return F.transform(samples, lambda x: (F.greatest(-one, F.least(one, x)) * F.lit(float(SCALE)).cast("float")).cast("int").cast("smallint"))


def dequantize(values: Column) -> Column:
    return F.transform(values, lambda v: (v.cast("float") / F.lit(float(SCALE)).cast("float")).cast("float"))


def scaled(samples: Column, factor: Column) -> Column:
    return F.transform(samples, lambda x: (x.cast("double") * factor).cast("float"))


def peak_factor(top: Column, target: float) -> Column:
    """Factor that brings a peak to the target; 1 for silence."""
    wide = top.cast("double")
    return F.when(wide > 0, F.least(F.lit(target) / wide, F.lit(1.0) / wide)).otherwise(F.lit(1.0))


def audio_fault(samples: Column) -> Column:
    """Why rendered audio is unusable: empty, not_finite or silent; null if it is usable."""
    odd = F.exists(samples, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")).cast("float")))
    return F.when(F.size(samples) == 0, "empty").when(odd, "not_finite").when(peak(samples).cast("double") < SILENT_BELOW, "silent")


def channel_mean(samples: Column, channels: Column) -> Column:
    """Mono: the mean of each frame's samples."""
    frames = F.when(F.size(samples) >= channels, F.sequence(F.lit(0), (F.size(samples) / channels).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    total = lambda i: F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0), lambda a, x: a + x)
    return F.transform(frames, lambda i: (total(i) / channels).cast("float"))

"""Audio kernels as Arrow UDFs: decoding, mono and resampling, log-mel features.

WAV is read with the standard library. Resampling is a windowed sinc filter; other implementations agree
to about 1e-3. The mel front end follows the published description: 30 s at 16 kHz, 400-sample Hann
windows every 160 samples, slaney mel filters, log10 clamped 8 below its maximum, (x + 4) / 4.
"""

from __future__ import annotations

import io
import wave
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

SAMPLE_RATE, SECONDS, WINDOW, HOP = 16_000, 30, 400, 160


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """(samples by channels in [-1, 1), rate)."""
    with wave.open(io.BytesIO(data)) as file:
        width, channels, rate = file.getsampwidth(), file.getnchannels(), file.getframerate()
        raw = file.readframes(file.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((parts[:, 0] << 8) | (parts[:, 1] << 16) | (parts[:, 2] << 24)) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels), rate


def to_mono(x: np.ndarray, rate: int, target: int = SAMPLE_RATE, width: int = 16) -> np.ndarray:
    """Mean of channels at the target rate."""
    x = x.mean(1) if x.ndim > 1 else x
    if rate == target or not len(x):
        return x.astype(np.float32)
    n = int(np.ceil(len(x) * target / rate))
    cut = min(1.0, target / rate)
    out = np.empty(n, np.float32)
    reach = int(np.ceil(width / cut))
    for first in range(0, n, 1 << 15):
        at = np.arange(first, min(n, first + (1 << 15))) * rate / target
        near = np.floor(at).astype(int)[:, None] + np.arange(-reach, reach + 1)[None, :]
        d = (at[:, None] - near) * cut
        taps = np.sinc(d) * np.where(np.abs(d) < width, np.cos(np.pi * d / (2 * width)) ** 2, 0) * cut
        out[first : first + len(at)] = (taps * np.where((near >= 0) & (near < len(x)), x[np.clip(near, 0, len(x) - 1)], 0)).sum(1)
    return out


def decode_value(array, data, path_data, rate) -> np.ndarray | None:
    """A waveform from an array, else bytes, else a file's bytes; None if there is none or it can't be read."""
    try:
        if array is not None and len(array):
            return to_mono(np.asarray(array, np.float32), int(rate or SAMPLE_RATE))
        for raw in (data, path_data):
            if raw is not None and len(raw):
                return to_mono(*read_wav(bytes(raw)))
    except (wave.Error, EOFError, KeyError, ValueError):
        return None
    return None


@pandas_udf(ArrayType(FloatType()))
def decode_wav(data: pd.Series) -> pd.Series:
    """Mono 16 kHz samples of WAV bytes, null where they can't be read."""
    return data.map(lambda x: decode_value(None, x, None, None))


@pandas_udf(ArrayType(FloatType()))
def decode_audio(array: pd.Series, data: pd.Series, path_data: pd.Series, rate: pd.Series) -> pd.Series:
    """Samples by precedence: array, bytes, then the bytes of the file at the path."""
    return pd.Series([decode_value(a, b, p, None if pd.isna(r) else r) for a, b, p, r in zip(array, data, path_data, rate, strict=True)], dtype=object)


@lru_cache
def mel_filters(bands: int, rate: int = SAMPLE_RATE, size: int = WINDOW) -> np.ndarray:
    """Area-normalised triangles on a scale that is linear below 1 kHz and logarithmic above."""
    step, knee = 200.0 / 3, 1000.0
    to_mel = lambda f: np.where(f < knee, f / step, knee / step + np.log(np.maximum(f, 1e-9) / knee) / (np.log(6.4) / 27))
    to_hz = lambda m: np.where(m < knee / step, m * step, knee * np.exp((m - knee / step) * np.log(6.4) / 27))
    edges = to_hz(np.linspace(0, float(to_mel(np.array(rate / 2))), bands + 2))
    bins = np.linspace(0, rate / 2, size // 2 + 1)
    rise = (bins[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - bins[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(samples: np.ndarray, bands: int = 128, seconds: int = SECONDS) -> np.ndarray:
    """[frames, bands] of samples padded or cut to ``seconds``."""
    x = np.zeros(seconds * SAMPLE_RATE)
    x[: min(len(x), len(samples))] = samples[: len(x)]
    x = np.pad(x, WINDOW // 2, mode="reflect")
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP][:-1]
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    logs = np.log10(np.maximum(power @ mel_filters(bands).T, 1e-10))
    return ((np.maximum(logs, logs.max() - 8) + 4) / 4).astype(np.float32)


def mel_features(samples: Column | str, bands: int = 128, seconds: int = SECONDS) -> Column:
    @pandas_udf(ArrayType(ArrayType(FloatType())))
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else list(log_mel(np.asarray(s), bands, seconds)))

    return run(F.col(samples) if isinstance(samples, str) else samples)

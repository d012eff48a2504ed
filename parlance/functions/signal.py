"""Signal operators over arrays of samples; spectral features as Arrow functions in numpy."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from parlance.functions.vectors import total


def downmix(samples: Column, channels: Column | int) -> Column:
    """The mean of each frame of interleaved channels; a last frame that is not whole goes."""
    n = F.lit(channels) if isinstance(channels, int) else channels
    frames = F.floor(F.size(samples) / n).cast("int")
    mean = lambda f: total(F.slice(samples, f * n + 1, n)) / n
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), F.greatest(frames - 1, F.lit(0))), mean)).otherwise(F.array().cast("array<double>"))


def power(samples: Column) -> Column:
    """Mean square."""
    return F.when(F.size(samples) > 0, total(F.transform(samples, lambda x: x.cast("double") * x.cast("double"))) / F.size(samples)).otherwise(0.0)


def rms(samples: Column) -> Column:
    return F.sqrt(power(samples))


def mix_noise(signal: Column, noise: Column, snr_db: float = 10.0) -> Column:
    """Noise, repeated to length, added at a ratio of powers and clamped to +-1; silence on either side changes nothing."""
    scale = F.sqrt(power(signal) / (power(noise) * 10 ** (snr_db / 10)))
    add = lambda x, i: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") + F.get(noise, (i % F.size(noise)).cast("int")).cast("double") * scale))
    return F.when((power(signal) > 0) & (power(noise) > 0), F.transform(signal, add)).otherwise(F.transform(signal, lambda x: x.cast("double")))


def peak_normalise(samples: Column, peak: float = 0.95) -> Column:
    """The largest amplitude becomes ``peak``; silence stays."""
    top = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))
    return F.transform(samples, lambda x: F.when(top > 1e-9, x.cast("double") * (F.lit(peak) / top)).otherwise(x.cast("double")))


def preemphasis(samples: Column, c: float = 0.97, first_scaled: bool = True) -> Column:
    """x[i] - c x[i-1]; the first sample is scaled by 1 - c or left."""
    lead = (1 - c) if first_scaled else 1.0
    return F.transform(samples, lambda x, i: F.when(i == 0, x.cast("double") * lead).otherwise(x.cast("double") - c * F.get(samples, i - 1).cast("double")))


def frames_inside(samples: Column, length: int, shift: int) -> Column:
    """Frames that lie wholly inside."""
    n = F.when(F.size(samples) >= length, F.floor((F.size(samples) - length) / shift).cast("int") + 1).otherwise(0)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda f: F.slice(samples, f * shift + 1, F.lit(length)))).otherwise(F.array().cast("array<array<double>>"))


def frames_centred(samples: Column, length: int, shift: int, reflect: bool = False) -> Column:
    """A frame around every ``shift``-th sample, padded by zeros or by reflection."""
    half, n = length // 2, F.size(samples)

    def at(i: Column) -> Column:
        if not reflect:
            return F.coalesce(F.when((i >= 0) & (i < n), F.get(samples, i)).cast("double"), F.lit(0.0))
        return F.get(samples, F.when(i < 0, -i).when(i >= n, 2 * (n - 1) - i).otherwise(i)).cast("double")

    frame = lambda f: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: at(f * shift + k - half))
    return F.transform(F.sequence(F.lit(0), F.floor(n / shift).cast("int")), frame)


def splice(frames: Column, m: int = 7, n: int = 6) -> Column:
    """m frames side by side around every n-th, edges repeated; ceil(T / n) rows."""
    left, count = (m - 1) // 2, F.size(frames)
    row = lambda r: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: F.get(frames, F.greatest(F.lit(0), F.least(count - 1, r * n + k - left)).cast("int"))))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(count / n).cast("int") - 1, F.lit(0))), row)).otherwise(frames)


def cmvn(frame: Column, shift: Column, scale: Column) -> Column:
    """(x + shift) * scale for each feature."""
    return F.transform(F.arrays_zip(frame.alias("x"), shift.alias("a"), scale.alias("b")), lambda z: (z["x"].cast("double") + z["a"].cast("double")) * z["b"].cast("double"))


def hamming(n: int) -> list[float]:
    return [0.54 - 0.46 * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)]


def mel(hz: Column) -> Column:
    return 1127.0 * F.log1p(hz / 700.0)


def mel_slaney(hz: Column) -> Column:
    """Linear below 1000 Hz, logarithmic above."""
    return F.when(hz < 1000.0, hz * 3 / 200).otherwise(15.0 + F.ln(hz / 1000.0) / (math.log(6.4) / 27))


def transpose(rows: Column) -> Column:
    """[T, M] as [M, T]."""
    return F.transform(F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))) - 1), lambda j: F.transform(rows, lambda r: F.get(r, j)))


def _hz(m: np.ndarray) -> np.ndarray:
    return np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * math.log(6.4) / 27))


def _slaney(f: np.ndarray) -> np.ndarray:
    return np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) / (math.log(6.4) / 27))


def slaney_bank(bands: int, fft: int, rate: int) -> np.ndarray:
    """Area-normalised triangles between equal steps on the Slaney scale."""
    edges = _hz(np.linspace(0, float(_slaney(np.array(rate / 2))), bands + 2))
    f = np.fft.rfftfreq(fft, 1 / rate)
    up = (f[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def htk_bank(bands: int, fft: int, rate: int, low: float = 20.0) -> np.ndarray:
    """Triangles of equal width on the 1127 ln(1 + f / 700) scale."""
    scale = lambda x: 1127 * np.log1p(x / 700)
    edges = np.linspace(scale(low), scale(rate / 2), bands + 2)
    f = scale(np.fft.rfftfreq(fft, 1 / rate))
    up = (f[None] - edges[:-2, None]) / (edges[1] - edges[0])
    down = (edges[2:, None] - f[None]) / (edges[1] - edges[0])
    return np.maximum(0, np.minimum(up, down))


def log_mel_kaldi(x: np.ndarray, rate: int = 16000, bands: int = 80) -> np.ndarray:
    """Frames of 25 ms every 10 ms without mean, pre-emphasised, Hamming, power, ln."""
    n, shift = rate // 40, rate // 100
    if len(x) < n:
        return np.zeros((0, bands))
    f = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), n)[::shift].copy()
    f -= f.mean(1, keepdims=True)
    f = np.concatenate([f[:, :1] * 0.03, f[:, 1:] - 0.97 * f[:, :-1]], 1) * np.array(hamming(n))
    return np.log(np.abs(np.fft.rfft(f, 512)) ** 2 @ htk_bank(bands, 512, rate).T + 1e-10)


def log_mel_nemo(x: np.ndarray, rate: int = 16000, bands: int = 128) -> np.ndarray:
    """Pre-emphasised, centred 25 ms Hann frames in 512 points, ln, each band to mean 0 and deviation 1."""
    x = np.asarray(x, float)
    hop, n = rate // 100, rate // 40
    count = len(x) // hop
    if not count:
        return np.zeros((0, bands))
    y = np.concatenate([np.zeros(256), x[:1], x[1:] - 0.97 * x[:-1], np.zeros(256)])
    window = np.zeros(512)
    window[(512 - n) // 2 : (512 + n) // 2] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    f = np.lib.stride_tricks.sliding_window_view(y, 512)[::hop][:count] * window
    out = np.log(np.abs(np.fft.rfft(f)) ** 2 @ slaney_bank(bands, 512, rate).T + 2.0**-24)
    return (out - out.mean(0)) / (out.std(0, ddof=1) + 1e-5) if len(out) > 1 else out


def log_mel_whisper(x: np.ndarray, rate: int = 16000, bands: int = 128, seconds: int = 30) -> np.ndarray:
    """Padded or cut to 30 s, reflected edges, periodic Hann, log10 within 8 of the largest, (v + 4) / 4; bands by frames."""
    x = np.asarray(x, float)[: rate * seconds]
    x = np.pad(x, (0, rate * seconds - len(x)))
    y = np.pad(x, 200, mode="reflect")
    f = np.lib.stride_tricks.sliding_window_view(y, 400)[::160][: rate * seconds // 160] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400))
    out = np.log10(np.maximum(np.abs(np.fft.rfft(f)) ** 2 @ slaney_bank(bands, 400, rate).T, 1e-10))
    return ((np.maximum(out, out.max() - 8) + 4) / 4).T


def features(kind: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A log-mel function as a Column function array<float> -> array<array<double>>."""

    @F.pandas_udf(ArrayType(ArrayType(DoubleType())))
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda s: None if s is None else kind(np.asarray(s)).tolist())

    return run


@F.pandas_udf(ArrayType(DoubleType()))
def convolve(signal: pd.Series, kernel: pd.Series) -> pd.Series:
    """FFT convolution of length n + max(m - 1, 1); a kernel of one sample gives one sample more than it should."""

    def one(x, k):
        if x is None or k is None:
            return None
        n = len(x) + max(len(k) - 1, 1)
        size = 1 << max(0, (n - 1).bit_length())
        return np.fft.irfft(np.fft.rfft(np.asarray(x, float), size) * np.fft.rfft(np.asarray(k, float), size), size)[:n].tolist()

    return pd.Series([one(x, k) for x, k in zip(signal, kernel, strict=True)])

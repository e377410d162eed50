"""Audio features against the textbook: zero-stuffing, one long filter, every eighth sample, a plain DFT."""

import numpy as np
import pytest

from quayside.llm import audio


def brute_bands(payload):
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    n = audio.TAPS * audio.UP
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(audio.UP, audio.DOWN)
    h = np.sinc(cut * t) * cut * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(1, n + 1) / (n + 1)))
    h *= audio.UP / h.sum()
    stuffed = np.zeros(len(x) * audio.UP)
    stuffed[:: audio.UP] = x
    signal = np.convolve(stuffed, h)[:: audio.DOWN]
    total = max(1, len(x) * audio.UP // audio.DOWN)
    frames = 1 + max(0, -(-(total - audio.FRAME) // audio.HOP))
    signal = np.concatenate([signal, np.zeros(frames * audio.HOP + audio.FRAME)])
    k, at = np.arange(audio.FFT // 2 + 1)[:, None], np.arange(audio.FRAME)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * at / (audio.FRAME - 1))
    dft = np.exp(-2j * np.pi * k * at / audio.FFT)
    bands = [np.abs(dft @ (signal[i * audio.HOP : i * audio.HOP + audio.FRAME] * window)) ** 2 @ audio.mel_bank() for i in range(frames)]
    return np.log(np.array(bands) + audio.FLOOR)


@pytest.mark.parametrize("chunk", [1 << 18, 700])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 500, 640, 641, 5000, 20011])
def test_bands(monkeypatch, n, chunk):
    monkeypatch.setattr(audio, "_CHUNK", chunk)
    payload, size = audio.payload_of("".join(chr(32 + i * i % 90) for i in range(n)))
    assert size == n and len(payload) % 64 == 0
    got = np.concatenate(list(audio.log_mels(payload)))
    assert got.dtype == np.float16 and np.allclose(got, brute_bands(payload), atol=0.05)
    assert audio.UP > 1 and len(audio.low_pass()) == audio.UP


def test_segments_by_hand():
    energy = np.array([0, 0, 5, 9, 9, 4, 9, 1, 0, 0, 9, 9, 0, 7, 7, 7], float)
    s = audio.Segmenter()
    s.feed(energy[:4], 0, 10)
    s.feed(energy[4:], 0, 10)
    s.close(len(energy))
    assert s.spans == [(3, 7), (13, 16)]  # above 6 opens, below 3 closes; two frames are too short

"""Butterworth low-pass as a small linear system that can start from any state."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLOCK = 64


class LowPass:
    """State-space form of a digital Butterworth low-pass filter.

    Being linear, the answer to a stretch of samples is the answer from rest plus
    the decay of the state it starts in; that is what lets a series be cut.
    """

    def __init__(self, order: int, cutoff_hz: float, rate_hz: float):
        if order < 1 or cutoff_hz <= 0:
            raise ValueError("a low-pass needs a positive order and cutoff")
        if cutoff_hz >= rate_hz / 2:
            raise ValueError("the cutoff must be below the Nyquist frequency")
        # Analog poles on the left half circle, warped so the cutoff survives the bilinear map.
        radius = np.tan(np.pi * cutoff_hz / rate_hz)
        angles = np.pi * (2 * np.arange(1, order // 2 + 1) + order - 1) / (2 * order)
        sections = []
        for pole in radius * np.exp(1j * angles):
            z = (1 + pole) / (1 - pole)
            a1, a2 = -2 * z.real, abs(z) ** 2
            gain = (1 + a1 + a2) / 4
            sections.append((gain, 2 * gain, gain, a1, a2))
        if order % 2:
            z = (1 - radius) / (1 + radius)
            sections.append(((1 - z) / 2, (1 - z) / 2, 0.0, -z, 0.0))
        self.sections = sections
        self.odd = order % 2
        self.size = 2 * len(sections)
        columns = [self._step(0.0, unit) for unit in np.eye(self.size)]
        self.A = np.column_stack([s for _, s in columns])
        self.C = np.array([y for y, _ in columns])
        self.D, self.B = self._step(1.0, np.zeros(self.size))
        self.settled = np.linalg.solve(np.eye(self.size) - self.A, self.B)
        powers = [np.eye(self.size)]
        for _ in range(BLOCK):
            powers.append(powers[-1] @ self.A)
        self._decay = np.array([self.C @ p for p in powers[:BLOCK]])
        response = np.array([self.D] + [self.C @ powers[k] @ self.B for k in range(BLOCK - 1)])
        self._toeplitz = np.array([[response[i - j] if i >= j else 0.0 for j in range(BLOCK)] for i in range(BLOCK)])
        self._jump, self._feed = powers[BLOCK], np.column_stack([powers[BLOCK - 1 - j] @ self.B for j in range(BLOCK)])

    def _step(self, x: float, state: np.ndarray) -> tuple[float, np.ndarray]:
        out = state.copy()
        for i, (b0, b1, b2, a1, a2) in enumerate(self.sections):
            y = b0 * x + state[2 * i]
            out[2 * i] = b1 * x - a1 * y + state[2 * i + 1]
            out[2 * i + 1] = b2 * x - a2 * y
            x = y
        return x, out

    @property
    def pad_length(self) -> int:
        """Samples added at each end before a zero-phase pass."""
        return 3 * (self.size + 1 - self.odd)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filtered samples and the state after them."""
        out, state = np.empty(len(x)), np.asarray(state, dtype=float)
        whole = len(x) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK):
            part = x[at : at + BLOCK]
            out[at : at + BLOCK] = self._decay @ state + self._toeplitz @ part
            state = self._jump @ state + self._feed @ part
        for at in range(whole, len(x)):
            out[at], state = self._step(float(x[at]), state)
        return out, state

    def coast(self, state: np.ndarray, samples: int) -> np.ndarray:
        """State after a stretch of zero input."""
        return np.linalg.matrix_power(self.A, int(samples)) @ state


@lru_cache(maxsize=64)
def low_pass(order: int, cutoff_hz: float, rate_hz: float) -> LowPass:
    return LowPass(order, cutoff_hz, rate_hz)

"""Initial values of parameters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

#: Fixed gains by activation.
GAINS = {"linear": 1.0, "sigmoid": 1.0, "tanh": 5 / 3, "relu": math.sqrt(2), "selu": 0.75}


def fans(shape: Sequence[int]) -> tuple[int, int]:
    """Numbers of inputs and outputs that a weight of this shape joins; [slots, in, out] or [in, out]."""
    if len(shape) < 2:
        raise ValueError("a weight has an input and an output axis")
    slots = math.prod(shape[:-2])
    return slots * shape[-2], slots * shape[-1]


def gain(activation: str, slope: float = 0.01) -> float:
    return math.sqrt(2 / (1 + slope**2)) if activation == "leaky_relu" else GAINS[activation]


def kaiming_normal(shape: Sequence[int], activation: str = "leaky_relu", slope: float = 0.0, mode: str = "in", seed: int = 0) -> np.ndarray:
    fan = fans(shape)[0 if mode == "in" else 1]
    return np.random.default_rng(seed).normal(0.0, gain(activation, slope) / math.sqrt(fan), shape)


def kernel_uniform(shape: Sequence[int], seed: int = 0, transposed: bool = False) -> np.ndarray:
    """Uniform within one over the root of the number of joined inputs."""
    bound = 1 / math.sqrt(fans(shape)[1 if transposed else 0])
    return np.random.default_rng(seed).uniform(-bound, bound, shape)

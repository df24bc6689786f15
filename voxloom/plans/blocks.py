"""Composite blocks: residual and squeeze-excite blocks, an encoder-decoder and a classifier, from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.channels import activate, relu, sigmoid
from voxloom.functions.init import kernel_uniform
from voxloom.functions.offsets import Kernel
from voxloom.model import Voxels
from voxloom.operators import conv, norm, pool, setops


@dataclass
class Conv:
    """A convolution, batch norm and optionally relu. ``transposed`` goes to the coordinates it is given."""

    channels_in: int
    channels_out: int
    size: int = 3
    stride: int = 1
    dim: int = 3
    act: bool = True
    transposed: bool = False
    seed: int = 0
    weight: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.weight = kernel_uniform((Kernel(self.size).volume(self.dim), self.channels_in, self.channels_out), self.seed)

    def __call__(self, v: Voxels, out: Voxels | None = None) -> Voxels:
        kernel = Kernel(self.size)
        y = conv.convolve_transpose(v, self.weight, kernel, self.stride, out=out) if self.transposed else conv.convolve(v, self.weight, kernel, self.stride)
        y = norm.batch_norm(y)
        return activate(y, "relu") if self.act else y


def squeeze_excite(v: Voxels, down: np.ndarray, up: np.ndarray) -> Voxels:
    """Scales channels by a gate that a batch's mean features give; ``down`` and ``up`` are [in, out]."""
    means = pool.global_pool(v, "average")
    hidden = [relu(sum((F.col(f) * float(down[i, o]) for i, f in enumerate(v.feats)), F.lit(0.0))) for o in range(down.shape[1])]
    gates = means.select(v.batch, *(h.alias(f"__h{o}") for o, h in enumerate(hidden)))
    gates = gates.select(v.batch, *(sigmoid(sum((F.col(f"__h{i}") * float(up[i, o]) for i in range(up.shape[0])), F.lit(0.0))).alias(f) for o, f in enumerate(v.feats)))
    return setops.broadcast_multiply(v, gates)


@dataclass
class Residual:
    """conv, conv (and conv) plus the input, which a 1x1 convolution fits where channels or stride differ.

    ``bottleneck`` has the 1-3-1 form, whose output has ``expansion`` times the channels; ``excite`` is the reduction of
    a squeeze-excite gate before the sum.
    """

    channels_in: int
    channels: int
    stride: int = 1
    dim: int = 3
    bottleneck: bool = False
    expansion: int = 4
    excite: int = 0
    seed: int = 0

    def __post_init__(self) -> None:
        c, s = self.channels, self.seed
        self.channels_out = c * self.expansion if self.bottleneck else c
        if self.bottleneck:
            self.path = [Conv(self.channels_in, c, 1, 1, self.dim, seed=s), Conv(c, c, 3, self.stride, self.dim, seed=s + 1), Conv(c, self.channels_out, 1, 1, self.dim, False, seed=s + 2)]
        else:
            self.path = [Conv(self.channels_in, c, 3, self.stride, self.dim, seed=s), Conv(c, c, 3, 1, self.dim, False, seed=s + 1)]
        fits = self.stride == 1 and self.channels_in == self.channels_out
        self.short = None if fits else Conv(self.channels_in, self.channels_out, 1, self.stride, self.dim, False, seed=s + 3)
        if self.excite:
            less = max(self.channels_out // self.excite, 1)
            self.gate = (kernel_uniform((self.channels_out, less), s + 4), kernel_uniform((less, self.channels_out), s + 5))

    def __call__(self, v: Voxels) -> Voxels:
        y = v
        for layer in self.path:
            y = layer(y)
        if self.excite:
            y = squeeze_excite(y, *self.gate)
        short = v if self.short is None else self.short(v)
        return activate(setops.add(y, short.with_df(short.df, origin=y.origin)), "relu")


@dataclass
class UNet:
    """An encoder-decoder: strided convolutions down, transposed ones back to each finer set, sums across."""

    channels_in: int
    channels_out: int
    widths: Sequence[int] = (8, 16)
    dim: int = 3

    def __post_init__(self) -> None:
        w = [self.channels_in, *self.widths]
        self.down = [Conv(a, b, 3 if i == 0 else 2, 1 if i == 0 else 2, self.dim, seed=10 + i) for i, (a, b) in enumerate(zip(w[:-1], w[1:], strict=True))]
        self.up = [Conv(b, a, 2, 2, self.dim, transposed=True, seed=20 + i) for i, (a, b) in enumerate(zip(self.widths[:-1], self.widths[1:], strict=True))]
        self.head = kernel_uniform((self.widths[0], self.channels_out), 30)

    def __call__(self, v: Voxels) -> Voxels:
        levels = []
        for layer in self.down:
            v = layer(v)
            v = v.with_df(v.df.persist())  # read twice: by the level below and by the sum on the way back
            levels.append(v)
        for layer, finer in zip(reversed(self.up), reversed(levels[:-1]), strict=True):
            y = layer(v, finer)
            v = setops.union(finer, y)
        return conv.linear(v, self.head)


def classify(v: Voxels, layers: Sequence[Conv], head: np.ndarray, bias: Sequence[float]) -> DataFrame:
    """Class scores of each batch: convolutions, a global maximum and a linear map."""
    for layer in layers:
        v = layer(v)
    top = pool.global_pool(v, "max")
    return top.select(v.batch, *((sum((F.col(f) * float(head[i, o]) for i, f in enumerate(v.feats)), F.lit(float(bias[o])))).alias(f"score{o}") for o in range(head.shape[1])))

"""Kernel shapes: offsets of the slots of a kernel, in slot order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

Offset = tuple[int, ...]


def per_axis(value: int | Sequence[int], dim: int, name: str = "value") -> tuple[int, ...]:
    """A number for all axes, or one for each."""
    out = (value,) * dim if isinstance(value, int) else tuple(value)
    if len(out) != dim or any(v < 1 for v in out):
        raise ValueError(f"{name} must be one positive number, or {dim} of them")
    return out


def span(size: int) -> range:
    """Offsets along one axis: centred if the size is odd, else from 0 on."""
    return range(-(size // 2), size // 2 + 1) if size % 2 else range(size)


def cube(size: int | Sequence[int], dim: int) -> list[Offset]:
    """All cells of a box; the first axis runs fastest."""
    spans = [span(k) for k in per_axis(size, dim, "kernel size")]
    return [tuple(reversed(o)) for o in product(*reversed(spans))]


def cube_first_axis_slowest(size: int | Sequence[int], dim: int) -> list[Offset]:
    """All cells of a centred box in the slot order of octree kernels: the first axis runs slowest."""
    sizes = per_axis(size, dim, "kernel size")
    if any(k % 2 == 0 for k in sizes):
        raise ValueError("octree kernels need odd sizes")
    return list(product(*(span(k) for k in sizes)))


def kernel_index(offset: Offset, size: int | Sequence[int]) -> int:
    """The slot of an offset in an octree kernel."""
    return cube_first_axis_slowest(size, len(offset)).index(tuple(offset))


def cross(size: int | Sequence[int], dim: int) -> list[Offset]:
    """The centre, then for each axis the steps 1..r and -r..-1."""
    sizes = per_axis(size, dim, "kernel size")
    if any(k % 2 == 0 for k in sizes):
        raise ValueError("a cross needs odd sizes")
    out = [(0,) * dim]
    for axis, k in enumerate(sizes):
        reach = k // 2
        for step in [*range(1, reach + 1), *range(-reach, 0)]:
            out.append(tuple(step if a == axis else 0 for a in range(dim)))
    return out


def corners(dim: int) -> list[Offset]:
    """The corners of a cell, first axis fastest."""
    return cube(2, dim)


@dataclass(frozen=True)
class Kernel:
    """Size, dilation and shape of a kernel; ``offsets`` only for the shape ``custom``."""

    size: int | tuple[int, ...] = 3
    dilation: int | tuple[int, ...] = 1
    shape: str = "cube"
    offsets: tuple[Offset, ...] = ()

    def taps(self, dim: int) -> list[Offset]:
        """Offsets by slot in steps of the grid, dilation included."""
        dilation = per_axis(self.dilation, dim, "dilation")
        if self.shape == "custom":
            if not self.offsets or any(len(o) != dim for o in self.offsets):
                raise ValueError("a custom kernel lists its offsets, one number for each axis")
            found = list(self.offsets)
        elif self.shape in ("cube", "cross"):
            found = (cube if self.shape == "cube" else cross)(self.size, dim)
        else:
            raise ValueError(f"no kernel shape {self.shape!r}")
        return [tuple(o * d for o, d in zip(off, dilation, strict=True)) for off in found]

    def volume(self, dim: int) -> int:
        return len(self.taps(dim))

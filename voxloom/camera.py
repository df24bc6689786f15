"""Pinhole cameras: x right, y down, z forward."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Camera:
    width: int
    height: int
    fx: float
    fy: float
    cx: float
    cy: float
    world_to_camera: tuple[tuple[float, ...], ...]
    near: float = 0.01

    @property
    def rotation(self) -> np.ndarray:
        return np.array(self.world_to_camera)[:3, :3]

    @property
    def translation(self) -> np.ndarray:
        return np.array(self.world_to_camera)[:3, 3]

    @property
    def position(self) -> np.ndarray:
        """The camera's centre in the world."""
        return -self.rotation.T @ self.translation

    @classmethod
    def from_fov(cls, width: int, height: int, fov_x: float, world_to_camera: Sequence[Sequence[float]], near: float = 0.01) -> Camera:
        if width <= 0 or height <= 0:
            raise ValueError("the image size must be positive")
        matrix = np.asarray(world_to_camera, float)
        if matrix.shape != (4, 4):
            raise ValueError("world_to_camera is a 4 x 4 matrix")
        focal = width / 2 / math.tan(fov_x / 2)
        return cls(width, height, focal, focal, width / 2, height / 2, tuple(map(tuple, matrix.tolist())), near)

    @classmethod
    def look_at(cls, eye: Sequence[float], target: Sequence[float], up: Sequence[float], width: int, height: int, fov_x: float, near: float = 0.01) -> Camera:
        e, t, u = (np.asarray(v, float) for v in (eye, target, up))
        forward = t - e
        if not np.linalg.norm(forward) > 0:
            raise ValueError("eye and target coincide")
        forward /= np.linalg.norm(forward)
        right = np.cross(forward, u)
        if not np.linalg.norm(right) > 1e-12:
            raise ValueError("up is parallel to the line of sight")
        right /= np.linalg.norm(right)
        matrix = np.eye(4)
        matrix[:3, :3] = np.stack([right, np.cross(forward, right), forward])
        matrix[:3, 3] = -matrix[:3, :3] @ e
        return cls.from_fov(width, height, fov_x, matrix, near)

"""Joint storage of overlapping pictures: homographies, the geometry of the parts, warping, splitting and merging."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from cinelake.sources.frames import psnr

#: Reprojection error in pixels, dB below which a pair is given up, and the least width of a part.
REPROJECTION, LEAST_PSNR, LEAST_WIDTH = 3.0, 25.0, 32


def fit_homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix, 1 at its end, that takes source points to target points: direct linear transform on centred points."""

    def centred(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = p.mean(0)
        size = np.sqrt(2) / max(np.sqrt(((p - mean) ** 2).sum(1)).mean(), 1e-12)
        return (p - mean) * size, np.array([[size, 0, -size * mean[0]], [0, size, -size * mean[1]], [0, 0, 1]])

    a, ta = centred(np.asarray(source, float))
    b, tb = centred(np.asarray(target, float))
    rows = []
    for (x, y), (u, v) in zip(a, b, strict=True):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    h = np.linalg.inv(tb) @ np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3) @ ta
    return h / h[2, 2]


def project(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    out = np.column_stack([points, np.ones(len(points))]) @ h.T
    return out[:, :2] / out[:, 2:]


def homography(source: np.ndarray, target: np.ndarray, error: float = REPROJECTION, rounds: int = 500, seed: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
    """Homography and its inverse that most point pairs agree with within ``error`` pixels; None with fewer than four pairs."""
    source, target = np.asarray(source, float), np.asarray(target, float)
    if len(source) < 4:
        return None
    rng, best = np.random.default_rng(seed), np.zeros(len(source), bool)
    for _ in range(rounds):
        pick = rng.choice(len(source), 4, replace=False)
        with np.errstate(all="ignore"):
            h = fit_homography(source[pick], target[pick])
            good = ((project(h, source) - target) ** 2).sum(1) <= error * error
        if good.sum() > best.sum():
            best = good
    if best.sum() < 4:
        return None
    h = fit_homography(source[best], target[best])
    inverse = np.linalg.inv(h)
    return h, inverse / inverse[2, 2]


def _even(x: float) -> int:
    n = round(x)
    return n + n % 2


@dataclass(frozen=True)
class Parts:
    """Widths of what only the left and only the right picture show, and the size of the overlap."""

    left: int
    right: int
    overlap_height: int
    overlap_width: int

    @property
    def inverted(self) -> bool:
        """The left picture is really the right one."""
        return self.left < 0

    @property
    def worthwhile(self) -> bool:
        return not self.inverted and self.left >= LEAST_WIDTH and self.right >= LEAST_WIDTH


def partition(h: np.ndarray, inverse: np.ndarray, left_shape: tuple[int, int], right_shape: tuple[int, int]) -> Parts:
    """The parts of two pictures (height, width); ``h`` takes left points to right ones. Widths are even."""
    edge = h @ np.array([left_shape[1], 0, 1.0])
    left = _even(inverse[0, 2] / inverse[2, 2])
    right = max(_even(right_shape[1] - edge[0] / edge[2]), 0)
    down = -round(float(np.array([0, left_shape[0], 1]) @ inverse[:, 0]))
    return Parts(left, right, max(0, right_shape[0] + 2 * down), max(0, left_shape[1] - left))


def warp(picture: np.ndarray, h: np.ndarray, height: int, width: int) -> np.ndarray:
    """The picture seen through ``h``: each pixel of the result is the nearest source pixel, black outside."""
    y, x = np.mgrid[:height, :width]
    at = np.rint(project(np.linalg.inv(h), np.column_stack([x.ravel(), y.ravel()]))).astype(int)
    inside = (at[:, 0] >= 0) & (at[:, 0] < picture.shape[1]) & (at[:, 1] >= 0) & (at[:, 1] < picture.shape[0])
    out = np.zeros((height * width, picture.shape[2]), np.uint8)
    out[inside] = picture[at[inside, 1], at[inside, 0]]
    return out.reshape(height, width, -1)


@dataclass(frozen=True)
class Joint:
    """Two pictures as left part, overlap and right part."""

    h: np.ndarray
    left: np.ndarray
    overlap: np.ndarray
    right: np.ndarray
    left_shape: tuple[int, ...]
    right_shape: tuple[int, ...]

    @property
    def size(self) -> int:
        return self.left.size + self.overlap.size + self.right.size

    def saved(self) -> float:
        """Share of the pixels that need not be stored."""
        whole = int(np.prod(self.left_shape)) + int(np.prod(self.right_shape))
        return (whole - self.size) / whole


def split(left: np.ndarray, right: np.ndarray, h: np.ndarray, join=None, least_psnr: float = LEAST_PSNR) -> Joint | None:
    """The joint form of two pictures; None where one of them would come back with less than ``least_psnr``.

    ``join`` puts the left picture's overlap and the warped right one together; by default the left one's is kept.
    """
    parts = partition(h, np.linalg.inv(h) / np.linalg.inv(h)[2, 2], left.shape[:2], right.shape[:2])
    if parts.inverted or not parts.overlap_width:
        return None
    seen = warp(right, np.linalg.inv(h), *left.shape[:2])[:, parts.left :]
    own = left[:, parts.left :]
    overlap = own if join is None else join(own, seen)
    joint = Joint(h, left[:, : parts.left], overlap, right[:, right.shape[1] - parts.right :], left.shape, right.shape)
    a, b = merge(joint)
    if psnr(a, left) < least_psnr or psnr(b, right) < least_psnr:
        return None
    return joint


def merge(joint: Joint) -> tuple[np.ndarray, np.ndarray]:
    """Both pictures back."""
    left = np.concatenate([joint.left, joint.overlap], axis=1)
    right = warp(left, joint.h, *joint.right_shape[:2])
    width = joint.right.shape[1]
    if width:
        right[:, joint.right_shape[1] - width :] = joint.right
    return left, right

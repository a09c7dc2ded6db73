"""Codecs by name. Raw RGB is built in; compressed formats must be registered with functions that decode and encode them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np


class CodecUnavailable(RuntimeError):
    pass


@dataclass(frozen=True)
class Codec:
    """decode(bytes, height, width) gives frames (height, width, 3); encode(frames, fps) gives bytes."""

    decode: Callable[[bytes, int, int], Iterator[np.ndarray]]
    encode: Callable[[Iterator[np.ndarray], float], bytes]


def _decode_rgb(data: bytes, height: int, width: int) -> Iterator[np.ndarray]:
    size = height * width * 3
    for at in range(0, len(data) - size + 1, size):
        yield np.frombuffer(data, np.uint8, size, at).reshape(height, width, 3)


_codecs = {"rgb": Codec(_decode_rgb, lambda frames, fps: b"".join(np.ascontiguousarray(x, np.uint8).tobytes() for x in frames))}


def register_codec(name: str, decode: Callable, encode: Callable) -> None:
    _codecs[name] = Codec(decode, encode)


def codec(name: str) -> Codec:
    if name not in _codecs:
        raise CodecUnavailable(f"no codec {name!r} is registered; register_codec() adds one")
    return _codecs[name]

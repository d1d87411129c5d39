"""Small uncompressed pictures for tests."""

import struct

import numpy as np


def write_bmp(path, pixels: np.ndarray) -> None:
    """``pixels``: height x width x 3, red green blue."""
    height, width, _ = pixels.shape
    row = (width * 3 + 3) // 4 * 4
    body = np.zeros((height, row), dtype=np.uint8)
    body[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    header = b"BM" + struct.pack("<IHHI", 54 + body.size, 0, 0, 54)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0)
    path.write_bytes(header + info + body.tobytes())


def picture(seed: int, height: int = 96, width: int = 128) -> np.ndarray:
    """A smooth random picture."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    waves = sum(
        rng.normal() * np.cos(rng.uniform(0, 6) * np.pi * x / width + rng.uniform(0, 6) * np.pi * y / height + rng.uniform(0, 6))
        for _ in range(8)
    )
    grey = (waves - waves.min()) / (waves.max() - waves.min()) * 200
    return np.repeat(grey[:, :, None], 3, axis=2).astype(np.uint8)

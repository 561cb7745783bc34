"""CRC-32C (Castagnoli) and the masked form that framed record files use."""

from __future__ import annotations

import numpy as np

_POLYNOMIAL = 0x82F63B78
_MASK = 0xA282EAD8


def _table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(_POLYNOMIAL), value >> 1)
    return value


TABLE = _table()


def crc32c_of_all(records: list[bytes]) -> np.ndarray:
    """The checksums of many records at once: byte by byte, all records that are long enough in step."""
    lengths = np.array([len(r) for r in records], np.int64)
    order = np.argsort(-lengths, kind="stable")
    data = np.frombuffer(b"".join(records), np.uint8)
    heads = (np.cumsum(lengths) - lengths)[order]
    crc = np.full(len(records), 0xFFFFFFFF, np.uint32)
    active = len(records)
    for i in range(int(lengths.max(initial=0))):
        while active and lengths[order[active - 1]] <= i:
            active -= 1
        crc[:active] = TABLE[(crc[:active] ^ data[heads[:active] + i]) & 0xFF] ^ (crc[:active] >> 8)
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c(data: bytes) -> int:
    return int(crc32c_of_all([data])[0])


def masked(crc: np.ndarray | int) -> np.ndarray | int:
    """Rotated right by 15 bits plus a constant, modulo 2 ** 32."""
    wide = np.asarray(crc, np.uint64)
    out = (((wide >> np.uint64(15)) | (wide << np.uint64(17))) + np.uint64(_MASK)) & np.uint64(0xFFFFFFFF)
    return int(out) if np.isscalar(crc) or np.ndim(crc) == 0 else out

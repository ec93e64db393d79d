"""Zstandard files of independent frames with a trailing seek table (the published seekable format): a skippable frame that lists each
frame's compressed size, plain size and the low 32 bits of the XXH64 of its plain bytes, so a reader decompresses only the frames it needs."""

from __future__ import annotations

import bisect
import struct

import xxhash
import zstandard

# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80


class SeekableWriter:
    def __init__(self, sink, frame_bytes: int = 1 << 18, level: int = 3):
        self.sink, self.frame_bytes, self.frames, self.plain = sink, frame_bytes, [], 0
        self.pending, self.held = [], 0
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def write(self, data: bytes) -> int:
        """The plain offset at which data starts. Large data are cut into several frames."""
        at = self.plain
        self.plain += len(data)
        view = memoryview(data)
        while len(view):
            take = view[: self.frame_bytes - self.held]
            self.pending.append(take)
            self.held += len(take)
            view = view[len(take) :]
            if self.held >= self.frame_bytes:
                self.end_frame()
        return at

    def end_frame(self) -> None:
        if self.held:
            data = b"".join(self.pending)
            packed = self.zstd.compress(data)
            self.sink.write(packed)
            self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.pending, self.held = [], 0

    def close(self) -> None:
        self.end_frame()
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class SeekableReader:
    """source: an open seekable binary file of `size` bytes."""

    def __init__(self, source, size: int):
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("no seek table")
        source.seek(size - 9 - 12 * n)
        self.frames = list(struct.iter_unpack("<III", source.read(12 * n)))
        self.packed_at, self.plain_at = [0], [0]
        for packed, plain, _ in self.frames:
            self.packed_at.append(self.packed_at[-1] + packed)
            self.plain_at.append(self.plain_at[-1] + plain)

    def frame(self, k: int) -> bytes:
        self.source.seek(self.packed_at[k])
        data = self.zstd.decompress(self.source.read(self.frames[k][0]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames[k][2]:
            raise ValueError(f"frame {k}: checksum")
        return data

    def read(self, start: int, length: int) -> bytes:
        if length <= 0:
            return b""
        k, out = bisect.bisect_right(self.plain_at, start) - 1, []
        while k < len(self.frames) and self.plain_at[k] < start + length:
            lo = max(0, start - self.plain_at[k])
            out.append(self.frame(k)[lo : start + length - self.plain_at[k]])
            k += 1
        return b"".join(out)

"""Reading event files through, inside tasks, whatever state they are in.

A broken file can name any size it likes; decoders that believe it run out of
memory and take their executor with them.  Here memory stays at a few blocks
and the longest line.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

from eventweir.functions.transfer import BLOCK, open_location

# No snappy element makes more than 64 bytes out of three.
MAX_SNAPPY_RATIO = 32


def inspect_file(location: str) -> tuple[bool, int, str | None]:
    """Is all of a file decodable lines of JSON values; how many values; its first line."""
    system, path = open_location(location)
    name = path.lower()
    blocks = next((k for end, k in DECODERS.items() if name.endswith(end)), _plain_blocks)
    decoder = json.JSONDecoder(parse_constant=_refuse)
    ok, count, first = True, 0, None
    try:
        with system.open_input_stream(path, compression=None) as data:
            for number, line in enumerate(_lines(blocks(data))):
                try:
                    text = line.decode("utf-8")
                    if number == 0:
                        first = text
                    count += _count_values(decoder, text)
                except (ValueError, RecursionError):
                    ok = False
    except (OSError, ValueError, zlib.error):
        ok = False
    return ok, count, first


def _lines(blocks: Iterator[bytes]) -> Iterator[bytes]:
    pending: list[bytes] = []
    for block in blocks:
        pieces = block.split(b"\n")
        if len(pieces) > 1:
            yield b"".join([*pending, pieces[0]])
            yield from pieces[1:-1]
            pending = []
        pending.append(pieces[-1])
    if any(pending):
        yield b"".join(pending)


def _refuse(word: str):
    raise ValueError(f"{word} is not JSON")


def _count_values(decoder: json.JSONDecoder, text: str) -> int:
    """Number of JSON values in a line; an error if there is anything else."""
    text, at, count = text.strip(" \t\r"), 0, 0
    while at < len(text):
        _, at = decoder.raw_decode(text, at)
        count += 1
        while at < len(text) and text[at] in " \t\r":
            at += 1
    return count


def _plain_blocks(data) -> Iterator[bytes]:
    while block := data.read(BLOCK):
        yield block


def _gzip_blocks(data) -> Iterator[bytes]:
    """Decoded blocks; a file may be several compressed files put end to end."""
    decoder, rest, begun = zlib.decompressobj(31), b"", False
    while block := rest or data.read(BLOCK):
        begun = True
        yield decoder.decompress(block, BLOCK)
        rest = decoder.unconsumed_tail
        if decoder.eof:
            rest, begun = decoder.unused_data, False
            decoder = zlib.decompressobj(31)
    if begun:
        raise ValueError("cut short")


def _zstd_blocks(data) -> Iterator[bytes]:
    import zstandard

    try:
        decoder, rest, begun = zstandard.ZstdDecompressor().decompressobj(), b"", False
        while block := rest or data.read(BLOCK):
            begun = True
            yield decoder.decompress(block)
            rest = b""
            if decoder.eof:
                rest, begun = decoder.unused_data, False
                decoder = zstandard.ZstdDecompressor().decompressobj()
        if begun:
            raise ValueError("cut short")
    except zstandard.ZstdError as error:
        raise ValueError(str(error)) from error


def _block_snappy_blocks(data) -> Iterator[bytes]:
    """Blocks of: size when decoded, then pieces of (size, compressed bytes) that add up to it."""
    import pyarrow as pa

    codec = pa.Codec("snappy")

    def exactly(n: int) -> bytes:
        # Sizes in a broken file can be anything: never ask for more than is there.
        raw = bytearray()
        while len(raw) < n:
            more = data.read(min(n - len(raw), BLOCK))
            if not more:
                raise ValueError("cut short")
            raw += more
        return bytes(raw)

    while start := data.read(4):
        wanted = int.from_bytes(start if len(start) == 4 else start + exactly(4 - len(start)), "big")
        while wanted > 0:
            piece = exactly(int.from_bytes(exactly(4), "big"))
            length = _snappy_length(piece)
            if length > min(wanted, MAX_SNAPPY_RATIO * len(piece)):
                raise ValueError("not snappy")
            yield codec.decompress(piece, length).to_pybytes()
            wanted -= length


def _snappy_length(piece: bytes) -> int:
    """A snappy piece starts with its decoded length, seven bits per byte."""
    value = shift = 0
    for byte in piece[:5]:
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value
        shift += 7
    raise ValueError("not snappy")


DECODERS = {".gz": _gzip_blocks, ".snappy": _block_snappy_blocks, ".zst": _zstd_blocks, ".zstd": _zstd_blocks}

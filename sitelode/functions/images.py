"""Image dimensions from the first bytes of PNG and WebP files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(content: Column, offset: int, width: int, little: bool) -> Column:
    """Unsigned number of ``width`` bytes at a zero-based offset."""
    order = range(width - 1, -1, -1) if little else range(width)
    digits = F.concat(*[F.hex(F.substring(content, offset + 1 + i, 1)) for i in order])
    return F.conv(digits, 16, 10).cast("bigint")


def _tag(content: Column, offset: int, width: int = 4) -> Column:
    return F.hex(F.substring(content, offset + 1, width))


def _ascii_hex(text: str) -> str:
    return text.encode("ascii").hex().upper()


def image_size(content: Column) -> Column:
    """``struct<width, height>``, or null when the header is of no known kind."""
    head = F.substring(content, 1, 32)
    png = _tag(head, 0) == "89504E47"
    webp = (
        (F.octet_length(head) > 30)
        & (_tag(head, 0) == _ascii_hex("RIFF"))
        & (_tag(head, 8) == _ascii_hex("WEBP"))
    )
    chunk = _tag(head, 12)
    mask = F.lit(0x3FFF).cast("bigint")
    packed = _number(head, 21, 4, little=True)

    def size(width: Column, height: Column) -> Column:
        return F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))

    return (
        F.when(png, size(_number(head, 16, 4, little=False), _number(head, 20, 4, little=False)))
        .when(
            webp & (chunk == _ascii_hex("VP8X")),
            size(_number(head, 24, 3, little=True) + 1, _number(head, 27, 3, little=True) + 1),
        )
        .when(
            webp & (chunk == _ascii_hex("VP8L")),
            size(packed.bitwiseAND(mask) + 1, F.shiftright(packed, 14).bitwiseAND(mask) + 1),
        )
        .when(
            webp & (chunk == _ascii_hex("VP8 ")),
            size(
                _number(head, 26, 2, little=True).bitwiseAND(mask),
                _number(head, 28, 2, little=True).bitwiseAND(mask),
            ),
        )
    )

"""Text expressions of the store: previews, sizes, JSON, checksums, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def preview(text: Column, n: int = 50) -> Column:
    """The first n characters and `...`, or the whole text if it has no more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def human_bytes(n: Column) -> Column:
    """B, or KB and MB with one decimal."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1048576, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / 1048576), F.lit(" MB")))
    )


def entry_json(key: Column, value: Column) -> Column:
    return F.to_json(F.struct(key.alias("key"), value.alias("value")))


def checksum(data: Column) -> Column:
    """CRC-32 (IEEE) as an unsigned number."""
    return F.crc32(data.cast("binary"))


def page_checksum(header: Column, data: Column) -> Column:
    """CRC-32 of a page: its header without the checksum field, then its data."""
    return F.crc32(F.concat(header, data))


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp, with or without a time zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def contains_folded(text: Column, part: str) -> Column:
    """Whether text holds part, whatever the case."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def split_arguments(line: str) -> list[str]:
    """Words of a command line; either quote starts or ends a quoted stretch and is dropped."""
    words, word, quoted = [], "", False
    for c in line:
        if c in "\"'":
            quoted = not quoted
        elif c.isspace() and not quoted:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    return [*words, word] if word else words

"""Header clean-up: plan-time renames, no data is touched."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from ..schema import SOURCE_HEADERS
from .scalar import ref

PADDING = re.compile(r"_c\d+|Unnamed.*|\s*")


def header_key(header: str) -> str:
    """Lower-case letters and digits of the header, without a parenthesised note."""
    plain = re.sub(r"\([^)]*\)", "", header)
    return "".join(ch for ch in plain.lower() if ch.isalnum())


def alias_table(source_headers: Mapping[str, str] = SOURCE_HEADERS) -> dict[str, str]:
    """Header key -> canonical name; the canonical names match themselves too."""
    table = {header_key(source): name for name, source in source_headers.items()}
    table.update({header_key(name): name for name in source_headers})
    return table


def drop_padding(df: DataFrame) -> DataFrame:
    return df.select(*[ref(c) for c in df.columns if not PADDING.fullmatch(c)])


def resolve(headers: Sequence[str], name_of: Callable[[str], str | None]) -> dict[str, str]:
    """Header -> name, blanks around unknown headers removed; two headers of one name are a ``ValueError``."""
    names, taken = {}, {}
    for header in headers:
        name = name_of(header) or header.strip()
        if name in taken:
            raise ValueError(f"headers {taken[name]!r} and {header!r} both mean {name}")
        names[header], taken[name] = name, header
    return names


def rename_exact(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by header, ignoring blanks around headers and mapping keys."""
    trimmed = {k.strip(): v for k, v in mapping.items()}
    return df.withColumnsRenamed(resolve(df.columns, lambda header: trimmed.get(header.strip())))


def rename_loose(df: DataFrame, source_headers: Mapping[str, str] = SOURCE_HEADERS) -> DataFrame:
    """Rename by header key, so case, punctuation and notes do not matter."""
    table = alias_table(source_headers)
    return df.withColumnsRenamed(resolve(df.columns, lambda header: table.get(header_key(header))))


def keep_known(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Known columns that exist, in the given order."""
    return df.select(*[ref(c) for c in names if c in df.columns])

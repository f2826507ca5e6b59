"""Word splitting on UTF-8 bytes, as fast as bytes.translate and bytes.split."""

from __future__ import annotations

import ctypes
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The C library's call that returns free pages, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _table(keep) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c if keep(c) else 32 for c in range(256))


#: A-Z lower-cased; everything but digits, a-z and non-ASCII becomes a space.
ALNUM = _table(lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128)
#: A-Z lower-cased; only white space (0x20, 0x09-0x0D) separates.
NONSPACE = _table(lambda c: c != 32 and not 9 <= c <= 13)

#: The words of ALNUM in a str, for their character offsets.
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(data: bytes | None, table: bytes = ALNUM) -> list[bytes]:
    return data.translate(table).split() if data else []


#: Bytes of texts that a Python task works on at a time, and of a text that is split into words at a time.
SLICE_BYTES, PIECE_BYTES = 4 << 20, 1 << 20


def slices(batches, column: int | str, limit: int | None = None):
    """The rows of Arrow batches in parts whose texts (of column) add up to limit bytes at most; a longer text is a part of its
    own. So the working set of a task follows from limit and its longest text, not from the rows of a batch."""
    limit = limit or SLICE_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        a = 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
            yield batch.slice(a, b - a)
            a = b
    release()


def release() -> None:
    """Gives freed memory back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def word_parts(data: bytes | None, table: bytes = ALNUM, size: int = PIECE_BYTES):
    """The words of data, as lists of the words of size bytes of it; a word is never cut."""
    if not data:
        return
    if len(data) <= size:
        yield data.translate(table).split()
        return
    held = b""
    for a in range(0, len(data), size):
        part = held + data[a : a + size].translate(table)
        cut = part.rfind(b" ") + 1
        held = part[cut:]
        if cut:
            yield part[:cut].split()
    if held:
        yield held.split()

"""Fill-in-the-middle: texts with a middle part moved to the end, and back.

All bytes of a batch move at once. The cuts give every part a shift; a difference array holds the changes of shift, its cumulative
sum the shift of every byte, and one scatter builds the outputs. The way back finds the marks in the outputs and gathers by the
same sums. Sums run over pieces of bounded size, so a very long text needs no more than a few times its own size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.arrays import parts, texts
from tablewright.session import ship_package

SLICE_BYTES = 2 << 20
#: Bytes moved at once.
PIECE_BYTES = 1 << 20
NAMES = ("n", "form", "prefix_chars", "middle_chars", "output")


def places(data: np.ndarray, offsets: np.ndarray, mark: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of a mark's occurrences, and their rows; none crosses rows."""
    at = np.flatnonzero(data == mark[0])
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + len(mark) <= offsets[row + 1]
    at, row = at[inside], row[inside]
    for k, byte in enumerate(mark[1:], 1):
        same = data[at + k] == byte
        at, row = at[same], row[same]
    return at, row


def shifts(starts: np.ndarray, targets: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """For pieces of n bytes: the other place of every byte. Segment k begins at starts[k] (ascending from 0) here and at targets[k] there."""
    some = np.append(starts[1:] > starts[:-1], starts[-1:] < n) if len(starts) else np.zeros(0, bool)
    starts, shift = starts[some], (targets - starts)[some]
    change = np.diff(shift, prepend=0)
    carried = 0
    for lo in range(0, n, PIECE_BYTES):
        hi = min(lo + PIECE_BYTES, n)
        a, b = np.searchsorted(starts, (lo, hi))
        difference = np.zeros(hi - lo, np.int64)
        difference[starts[a:b] - lo] = change[a:b]
        moved = np.cumsum(difference) + carried
        carried = int(moved[-1])
        yield lo, hi, np.arange(lo, hi) + moved


def _as_strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def line_cuts(data: np.ndarray, offsets: np.ndarray, h: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of every row, and the bytes at which prefix and middle end: after as many whole lines as the draws h say."""
    breaks = np.flatnonzero(data == 0x0A)
    first = np.searchsorted(breaks, offsets)
    full = np.diff(first)
    ended = np.zeros(len(full), bool)
    some = offsets[1:] > offsets[:-1]
    ended[some] = data[offsets[1:][some] - 1] == 0x0A
    n = full + (some & ~ended)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    out = []
    for k in (np.minimum(one, two), np.maximum(one, two)):
        end = offsets[:-1].copy()
        line = (k > 0) & (k <= full)
        end[line] = breaks[first[:-1][line] + k[line] - 1] + 1
        end[k > full] = offsets[1:][k > full]
        out.append(end)
    return n, out[0], out[1]


def arranged(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray, marks: tuple[bytes, bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the outputs; form: 0 plain, 1 prefix first, 2 suffix first."""
    p, s, m = (len(x) for x in marks)
    moved = form > 0
    sizes = np.diff(offsets) + np.where(moved, p + s + m, 0)
    out_offsets = np.concatenate(([0], np.cumsum(sizes)))
    begin, prefix, suffix = out_offsets[:-1], first - offsets[:-1], offsets[1:] - second
    p_at = begin + np.where(form == 2, s + suffix, 0)
    s_at = begin + np.where(form == 2, 0, p + prefix)
    m_at = begin + p + s + prefix + suffix
    # the middle and suffix of a plain text follow its prefix as they did
    segments = np.stack([offsets[:-1], first, second], 1).ravel()
    targets = np.stack([np.where(moved, p_at + p, begin), np.where(moved, m_at + m, begin + prefix), np.where(moved, s_at + s, begin + second - offsets[:-1])], 1).ravel()
    out = np.empty(int(out_offsets[-1]), np.uint8)
    for lo, hi, to in shifts(segments, targets, len(data)):
        out[to] = data[lo:hi]
    for mark, at in zip(marks, (p_at, s_at, m_at), strict=True):
        out[at[moved][:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    return out, out_offsets


def gathered(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, marks: tuple[bytes, bytes, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts that outputs were built from, and which rows do not hold each mark once, in the form's order."""
    p, s, m = (len(x) for x in marks)
    rows = len(offsets) - 1
    moved, at, bad = form > 0, [], np.zeros(rows, bool)
    for mark in marks:
        found, row = places(data, offsets, mark)
        bad |= moved & (np.bincount(row, minlength=rows) != 1)
        own = offsets[:-1].copy()
        own[row] = found
        at.append(own)
    p_at, s_at, m_at = at
    begin, end = offsets[:-1], offsets[1:]
    bad |= moved & ((np.where(form == 2, s_at, p_at) != begin) | (np.where(form == 2, p_at < s_at + s, s_at < p_at + p)) | (m_at < np.maximum(p_at + p, s_at + s)))
    moved = moved & ~bad
    prefix = np.where(form == 2, m_at, s_at) - p_at - p
    suffix = np.where(form == 2, p_at, m_at) - s_at - s
    sizes = np.where(bad, 0, end - begin - np.where(moved, p + s + m, 0))
    back = np.concatenate(([0], np.cumsum(sizes)))
    own = back[:-1]
    segments = np.stack([own, np.where(moved, own + prefix, own), np.where(moved, back[1:] - suffix, own)], 1).ravel()
    # a plain text is its last segment
    targets = np.stack([np.where(moved, p_at + p, begin), np.where(moved, m_at + m, begin), np.where(moved, s_at + s, begin)], 1).ravel()
    out = np.empty(int(back[-1]), np.uint8)
    for lo, hi, source in shifts(segments, targets, len(out)):
        out[lo:hi] = data[source]
    return out, back, bad


def _checked(marks: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    """Marks that can not be taken for each other, whatever stands between them."""
    made = tuple(m.encode() for m in marks)
    for x, y in product(made, made):
        if any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y)))):
            raise ValueError("the end of a mark may not begin a mark")
    for x, y in permutations(made, 2):
        if x in y:
            raise ValueError("marks may not be empty or hold each other")
    return made


def _draw(id_col: str, seed: int, k: int) -> Column:
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 8 * k + 1, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame, percent: int = 100, suffix_first: int = 50, seed: int = 7, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every whole text after two drawn numbers of lines into prefix, middle and suffix, and move the middle to the end.

    Columns: the id, n (lines, a break ends its line), form, prefix_chars, middle_chars (characters, NULL if plain), output. The
    marks stand for prefix, suffix and middle. Form psm: prefix mark, prefix, suffix mark, suffix, middle mark, middle; spm: suffix
    mark, suffix, prefix mark, prefix, middle mark, middle; plain: the text as it is. Of the texts that are neither empty nor hold
    a mark, `percent` of a hundred are moved, `suffix_first` of a hundred of those as spm. Draws depend on the seed and the id.

    NULL text is empty, and empty texts are plain with no line. Rows without an id draw with an empty id; equal ids draw alike; a
    repeated row comes back as often. Parts may be empty. An empty table gives no rows. Other columns are not read. The id column
    may not be called as one of the columns returned. `restored` gives the texts back.
    """
    made = _checked(marks)
    if id_col in NAMES:
        raise ValueError(f"the id may not be one of {NAMES}")
    ship_package(docs.sparkSession)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(["plain", "psm", "spm"], object)
        for batch in batches:
            data, offsets = texts(batch.column(1))
            draws = [batch.column(2 + k).to_numpy() for k in range(4)]
            for lo, hi in parts(offsets, SLICE_BYTES):
                own, bounds, h = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], [d[lo:hi] for d in draws]
                n, first, second = line_cuts(own, bounds, h)
                plain = (n == 0) | (h[2] % 100 >= percent)
                for mark in made:
                    plain[places(own, bounds, mark)[1]] = True
                form = np.where(plain, 0, np.where(h[3] % 100 < suffix_first, 2, 1))
                # a character's first byte is none of 10xxxxxx
                chars = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
                counts = [pa.array(chars[b] - chars[a], pa.int64(), mask=plain) for a, b in ((bounds[:-1], first), (first, second))]
                output = _as_strings(*arranged(own, bounds, first, second, form, made))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(names[form], pa.string()), *counts, output], names=[id_col, *NAMES])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col, *[_draw(id_col, seed, k).alias(f"__h{k}") for k in range(4)])
    return rows.mapInArrow(write, f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(rows: DataFrame, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), form_col: str = "form", output_col: str = "output", name: str = "restored") -> DataFrame:
    """The rows with the texts their outputs were built from, found from output and form alone.

    A row that has no output, no known form, or not each mark once in the order of its form gets NULL. All other columns stay.
    """
    made = _checked(marks)
    ship_package(rows.sparkSession)
    form_at, output_at = rows.columns.index(form_col), rows.columns.index(output_col)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"plain": 0, "psm": 1, "spm": 2}
        for batch in batches:
            data, offsets = texts(batch.column(output_at))
            lost = np.asarray(batch.column(output_at).is_null())
            forms = np.array([kinds.get(f, -1) for f in batch.column(form_at).to_pylist()], np.int64)
            for lo, hi in parts(offsets, SLICE_BYTES):
                own, bounds, form = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], forms[lo:hi]
                out, back, bad = gathered(own, bounds, np.maximum(form, 0), made)
                found = _as_strings(out, back)
                bad |= (form < 0) | lost[lo:hi]
                if bad.any():
                    found = pa.compute.if_else(pa.array(bad), pa.scalar(None, pa.string()), found)
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns], found], names=[*batch.schema.names, name])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return rows.mapInArrow(read, ", ".join([*kinds, f"`{name}` string"]))

"""Chat formatting by columnar byte assembly.

A turn is `<turn ROLE>\\n TEXT </turn>\\n`; backslash, `<` and `>` inside roles and texts get a backslash, so no text
can hold a control string and unescaping is exact.  The segments of a whole Arrow batch are laid out at once: lengths, cumulative
offsets and scatter indices are numpy arrays, and headers and contents are copied into one preallocated buffer that becomes the
Arrow column.  Turns are dealt by conversation and sorted; each task streams over them, so a conversation longer than a
batch leaves as several parts and no conversation has to fit in memory.

Defined results: null text or role is empty; equal turns stay, ordered by role and text; a null conv_id or turn sorts first;
an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from glossa.llm.common import need, trimmed

HEAD, MID, TAIL = b"<turn ", b">\n", b"</turn>\n"
LOSS_ROLE = "assistant"
_HOLD = 1 << 20  # bytes of an unfinished conversation that wait for the next batch
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>\n((?:[^\\<>]|\\.)*)</turn>\n", re.S)


def escape(x: pa.Array) -> pa.Array:
    for c in ("\\", "<", ">"):
        x = pc.replace_substring(x, c, "\\" + c)
    return x


def unescape(x: str) -> str:
    return re.sub(r"\\(.)", r"\1", x, flags=re.S) if "\\" in x else x


def _bytes(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Contents and offsets (from 0) of a string array without nulls."""
    x = x.cast(pa.large_string())
    offsets = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    data = np.frombuffer(x.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if x.buffers()[2] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer; the turns' offsets in it; the borders of their texts (rows, 2)."""
    n = len(roles)
    role, role_at = _bytes(roles)
    text, text_at = _bytes(texts)
    length = np.empty((n, 5), np.int64)
    length[:, 0], length[:, 2], length[:, 4] = len(HEAD), len(MID), len(TAIL)
    length[:, 1], length[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(length.reshape(-1)).reshape(n, 5)
    begin = ends - length
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, fixed in ((0, HEAD), (2, MID), (4, TAIL)):
        out[begin[:, k, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    for k, data, at in ((1, role, role_at), (3, text, text_at)):
        out[np.repeat(begin[:, k] - at[:-1], length[:, k]) + np.arange(len(data))] = data
    return out, np.append(begin[:, 0], ends[-1, -1] if n else 0), np.stack([begin[:, 3], ends[:, 3]], 1)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, part_of, part = None, object(), 0

    def emit(rows: pa.Table) -> pa.RecordBatch:
        nonlocal part_of, part
        rows = rows.combine_chunks()
        conv = rows.column("conv_id")
        keys = conv.to_numpy() if not conv.null_count else np.array([-(1 << 63) if x is None else x for x in conv.to_pylist()], np.int64)
        roles, texts = (pa.concat_arrays(rows.column(c).chunks) if rows.column(c).num_chunks != 1 else rows.column(c).chunk(0) for c in ("role", "text"))
        roles, texts = roles.fill_null(""), texts.fill_null("")
        loss = pc.equal(roles, LOSS_ROLE).to_numpy(zero_copy_only=False)
        buffer, at, span = assemble(escape(roles), escape(texts))
        cut = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        stop = np.append(cut[1:], len(keys))
        numbers = np.zeros(len(cut), np.int64)
        if keys[0] == part_of:
            numbers[0] = part + 1
        part_of, part = keys[-1], int(numbers[-1]) if len(cut) == 1 else 0
        offsets = np.append(at[cut], at[-1]).astype(np.int64)
        formatted = pa.LargeStringArray.from_buffers(len(cut), pa.py_buffer(offsets.tobytes()), pa.py_buffer(buffer)).cast(pa.string())
        spans = [(span[a:b][loss[a:b]] - at[a]).astype("<u4").tobytes() for a, b in zip(cut, stop, strict=True)]
        first = pa.concat_arrays(conv.chunks).take(pa.array(cut))
        return pa.RecordBatch.from_arrays([first, pa.array(numbers), pa.array(stop - cut), formatted, pa.array(spans, pa.binary())], ["conv_id", "part", "n_turns", "formatted", "loss_spans"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        conv = table.column("conv_id").to_pylist()
        last = len(conv)
        while last and conv[last - 1] == conv[-1]:
            last -= 1
        if last:
            yield emit(table.slice(0, last))
        held = table.slice(last)
        if held.nbytes > _HOLD:
            yield emit(held)
            held = None
    if held is not None and held.num_rows:
        yield emit(held)


def format_turns(df: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss_spans): loss_spans packs the byte borders of texts under the mask, as escaped in `formatted`.

    Parts of a conversation follow each other within one partition.
    """
    base = need(df, "conv_id", "turn", "role", "text")
    kind = base.schema["conv_id"].dataType.simpleString()
    dealt = base.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(trimmed(_format), f"conv_id {kind}, part long, n_turns long, formatted string, loss_spans binary")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; raises if anything stands between turns."""
    out, pos = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != pos:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        pos = m.end()
    if pos != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now: list | None = None

    def row():
        return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

    def to_batch(rows, kind):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names)

    kind = pa.int64()
    for batch in batches:
        rows, kind = [], batch.column("conv_id").type
        for conv, part, formatted, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss_spans")), strict=True):
            if part == 0:
                if now:
                    rows.append(row())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_turns(formatted):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
            raw = formatted.encode()
            for a, b in np.frombuffer(spans, "<u4").reshape(-1, 2).tolist():
                text = unescape(raw[a:b].decode())
                now[3] += len(text)
                now[4].update(text.encode())
            now[5] += len(formatted)
        if rows:
            yield to_batch(rows, kind)
    if now:
        yield to_batch([row()], kind)


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns, read back from what `format_turns` made."""
    out = format_turns(df)
    kind = out.schema["conv_id"].dataType.simpleString()
    return out.mapInArrow(trimmed(_read), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The contract's extra conversation: control strings inside texts.
PROBE = [(-7, k, role, "\\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))]


def with_probe(df: DataFrame) -> DataFrame:
    base = need(df, "conv_id", "turn", "role", "text")
    return base.unionByName(df.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))

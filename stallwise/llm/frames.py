"""Fill-in-the-middle over seekable compressed text.

A text is stored as independent zstandard frames of at most ``frame_units`` code points, each with the number of code points
before it. A span of a stored text is read by decompressing only the frames it touches (``Archive.read``), so a cut costs one
frame however long the text is. A document's cut points are drawn from a hash of its id; the output is an archive again: frames
that lie whole in a part are taken over as they are, only frames that hold a cut are opened and packed anew. Digests and
the way back stream the frames in order and never hold a whole text.

Tables: ``stored`` turns texts into archives, ``transformed`` rearranges them, ``restored`` goes back from output and form alone,
both with the SHA-256 of what they give; ``opened`` gives the text of an archive.

Defined results: a null text is an empty one (no frames, form plain); a null id is hashed as an empty one; repeated rows and ids
give the same result each; a text with a mark of its own stays plain; an empty table gives an empty one; columns whose names
clash with results are replaced.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, types as T

from stallwise.llm import common

FRAME_UNITS = 4096
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of a hundred documents so many are rearranged, and of a hundred of those so many with the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20

FRAMES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("data", T.BinaryType())]))


class Archive:
    """Frames with the number of code points before each."""

    def __init__(self, level: int = LEVEL):
        self.packer = zstandard.ZstdCompressor(level=level)
        self.opener = zstandard.ZstdDecompressor()
        self.clear()

    def clear(self) -> None:
        self.starts: list[int] = []
        self.frames: list[bytes] = []
        self.units = 0

    def load(self, frames: list[dict], units: int) -> Archive:
        self.starts, self.frames, self.units = [f["start"] for f in frames], [f["data"] for f in frames], units
        return self

    def rows(self) -> list[dict]:
        return [{"start": s, "data": d} for s, d in zip(self.starts, self.frames)]

    def take(self, frame: bytes, units: int) -> None:
        """Append a packed frame as it is."""
        self.starts.append(self.units)
        self.frames.append(frame)
        self.units += units

    def write(self, text: str, frame_units: int = FRAME_UNITS) -> None:
        for at in range(0, len(text), frame_units):
            piece = text[at:at + frame_units]
            self.take(self.packer.compress(piece.encode("utf-8")), len(piece))

    def open(self, number: int) -> bytes:
        return self.opener.decompress(self.frames[number])

    def end(self, number: int) -> int:
        return self.starts[number + 1] if number + 1 < len(self.starts) else self.units

    def spans(self, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """(frame, from, to): the frames that units a to b touch and the part of each, counted within the frame."""
        number = max(0, bisect.bisect_right(self.starts, a) - 1)
        while a < b:
            start, end = self.starts[number], min(b, self.end(number))
            if end > a:
                yield number, a - start, end - start
                a = end
            number += 1

    def read(self, a: int, b: int) -> Iterator[bytes]:
        """Units a to b as UTF-8, frame by frame."""
        for number, low, high in self.spans(a, b):
            data = self.open(number)
            whole = low == 0 and self.starts[number] + high == self.end(number)
            yield data if whole else data.decode("utf-8")[low:high].encode("utf-8")

    def copy(self, source: Archive, a: int, b: int) -> None:
        """Append units a to b of another archive; only frames that are cut are opened."""
        for number, low, high in source.spans(a, b):
            if low == 0 and source.starts[number] + high == source.end(number):
                self.take(source.frames[number], high)
            else:
                self.write(source.open(number).decode("utf-8")[low:high])

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for number in range(len(self.frames)):
            digest.update(self.open(number))
        return digest.hexdigest()

    def find(self, mark: str, after: int = 0) -> int:
        """Unit at which a mark first stands from unit ``after`` on, or -1; a mark may lie across frames."""
        tail, at = "", after
        for data in self.read(after, self.units):
            text = tail + data.decode("utf-8")
            found = text.find(mark)
            if found >= 0:
                return at - len(tail) + found
            at += len(text) - len(tail)
            tail = text[-(len(mark) - 1):]
        return -1


def drawn(doc_id: int | None, n: int, seed: int = 1) -> tuple[int, int, int, int]:
    """Units before the middle, units before the suffix, and two numbers below 100 for the form."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    low, high = sorted((one % (n + 1), two % (n + 1)))
    return low, high, three % 100, four % 100


def rearranged(source: Archive, out: Archive, form: str, low: int, high: int) -> None:
    out.clear()
    prefix, middle, suffix = (0, low), (low, high), (high, source.units)
    order = {
        PLAIN: [(None, (0, source.units))],
        PSM: [(PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)],
        SPM: [(SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle)],
    }[form]
    for mark, span in order:
        if mark:
            out.write(mark)
        out.copy(source, *span)


def put_back(source: Archive, out: Archive, form: str) -> None:
    """The text from output and form alone: the marks are looked for, since a rearranged text has none of its own."""
    out.clear()
    if form == PLAIN:
        return out.copy(source, 0, source.units)
    first, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    if source.find(first) != 0:
        raise ValueError(f"an output of form {form} does not begin with {first}")
    at = source.find(second, len(first))
    then = source.find(MIDDLE, at + len(second)) if at >= 0 else -1
    if then < 0:
        raise ValueError(f"an output of form {form} lacks a mark")
    parts = {first: (len(first), at), second: (at + len(second), then), MIDDLE: (then + len(MIDDLE), source.units)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        out.copy(source, *parts[mark])


def _mapped(df: DataFrame, drop: tuple[str, ...], fields: list[T.StructField], work) -> DataFrame:
    """Rows without some columns and with others; ``work`` is made once per task and turns a batch into lists of values."""
    gone = {n.lower() for n in drop} | {f.name.lower() for f in fields}
    stays = [f for f in df.schema.fields if f.name.lower() not in gone]
    schema = T.StructType(stays + fields)
    types = [common.to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on_batch = work()
        for batch in batches:
            if batch.num_rows:
                kept = [batch.column(batch.schema.get_field_index(f.name)) for f in stays]
                new = [pa.array(v, type=t) for v, t in zip(on_batch(batch), types)]
                yield pa.RecordBatch.from_arrays(kept + new, names=[f.name for f in schema.fields])

    return common.arrow_mapped(df, run, schema)


def stored(docs: DataFrame, text: str = "text", frame_units: int = FRAME_UNITS, level: int = LEVEL) -> DataFrame:
    """Documents with ``n`` (code points), ``marked`` (has a mark of its own) and ``frames`` in place of the text."""

    def work():
        archive = Archive(level)

        def on_batch(batch):
            units, marked, frames = [], [], []
            for value in common.column(batch, text):
                archive.clear()
                archive.write(value or "", frame_units)
                units.append(archive.units)
                marked.append(any(m in (value or "") for m in MARKS))
                frames.append(archive.rows())
            return units, marked, frames

        return on_batch

    fields = common.schema("n long, marked boolean").fields + [T.StructField("frames", FRAMES)]
    return _mapped(docs, (text,), fields, work)


def transformed(
    archives: DataFrame, key: str = "doc_id", seed: int = 1, rearrange: int = REARRANGED, suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """Stored documents with ``form``, ``prefix_chars``, ``middle_chars``, and the output's units ``output_n``, digest and frames."""

    def work():
        source, out = Archive(), Archive()

        def on_batch(batch):
            values = []
            columns = (common.column(batch, c) for c in (key, "n", "marked", "frames"))
            for doc_id, n, marked, frames in zip(*columns):
                low, high, three, four = drawn(doc_id, n, seed)
                form = PLAIN if n == 0 or marked or three >= rearrange else SPM if four < suffix_first else PSM
                rearranged(source.load(frames, n), out, form, low, high)
                cut = (None, None) if form == PLAIN else (low, high - low)
                values.append((form, *cut, out.units, out.sha256(), out.rows()))
            return zip(*values)

        return on_batch

    fields = common.schema("form string, prefix_chars long, middle_chars long, output_n long, output_sha256 string").fields
    return _mapped(archives, ("frames", "marked"), fields + [T.StructField("output", FRAMES)], work)


def restored(outputs: DataFrame) -> DataFrame:
    """The texts as they were, as archives ``restored`` of ``restored_n`` units with their digests, from output and form alone."""

    def work():
        source, out = Archive(), Archive()

        def on_batch(batch):
            values = []
            for form, n, frames in zip(*(common.column(batch, c) for c in ("form", "output_n", "output"))):
                put_back(source.load(frames, n), out, form)
                values.append((out.units, out.sha256(), out.rows()))
            return zip(*values)

        return on_batch

    fields = common.schema("restored_n long, restored_sha256 string").fields
    return _mapped(outputs, (), fields + [T.StructField("restored", FRAMES)], work)


def opened(archives: DataFrame, frames: str, text: str = "text") -> DataFrame:
    """An archive column replaced by its whole text."""

    def work():
        archive = Archive()

        def on_batch(batch):
            out = []
            for rows in common.column(batch, frames):
                archive.load(rows, 0)
                out.append(b"".join(archive.open(i) for i in range(len(rows))).decode("utf-8"))
            return [out]

        return on_batch

    return _mapped(archives, (frames,), [T.StructField(text, T.StringType())], work)

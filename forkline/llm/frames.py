"""Fill-in-the-middle over texts in seekable compressed frames.

A text is stored as independent zstandard frames. Each ends between two units (a word with
the white space before it, or white space at the end of the text) and carries how many units
and code points precede it, so a cut at a unit is found by bisection and only the frame that
holds it is decompressed. A transformed text is a list of frames again: whole frames are taken
over as they are, and only the two cut ones and the marks are compressed anew. One frame after
another, read as one zstandard stream, gives the output text. Digests stream over the frames in
order and hold one of them at a time.

Whether a text is transformed, in which order, and where it is cut follows from a hash of seed
and document id alone, so any task order and any retry give the same output.

``store_frames`` gives the store, ``fill_in_middle`` the transformed texts, ``restore`` the
text out of an output. Nulls: a null text is empty; a null id hashes as an empty one. An empty
text has no unit and stays plain. Repeated rows are transformed alike, each for itself. A text of
any length is cut into frames of about ``frame`` bytes; a single unit longer than that has one of
its own. An empty table gives an empty result. Other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.llm.common import keep_table

FRAME = 1 << 15
LEVEL = 1
SEED = 42
#: Per cent of texts that are transformed, and of these the share with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: The order of the parts in each form: 0 prefix, 1 middle, 2 suffix.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
#: Bytes of frames that a task gathers before it hands rows on.
FLUSH = 1 << 23

STORE = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())])
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(text: np.ndarray) -> np.ndarray:
    """Where the units of a text end, as offsets into its bytes."""
    if not len(text):
        return np.zeros(0, np.int64)
    blank = _BLANK[text]
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    return np.append(ends, len(text)) if blank[-1] else ends


def _chars(text: np.ndarray) -> int:
    """Code points of UTF-8 bytes: those that continue none."""
    return int(np.count_nonzero((text & 0xC0) != 0x80))


def frames_of(text: bytes, frame: int = FRAME) -> tuple[int, int, list[dict]]:
    """Units, code points and frames of a whole text."""
    codes = np.frombuffer(text, np.uint8)
    ends = unit_ends(codes)
    pack = zstandard.ZstdCompressor(level=LEVEL)
    frames, at, units, chars = [], 0, 0, 0
    while units < len(ends):
        last = min(int(np.searchsorted(ends, at + frame)), len(ends) - 1)
        stop = int(ends[last])
        frames.append({"units": units, "chars": chars, "data": pack.compress(text[at:stop])})
        chars += _chars(codes[at:stop])
        at, units = stop, last + 1
    return units, chars, frames


class Store:
    """Random access to the frames of one text."""

    def __init__(self, units: int, chars: int, frames: list[dict]):
        self.units, self.chars, self.frames = units, chars, frames
        self.starts = [f["units"] for f in frames]

    def cut(self, unit: int) -> tuple[int, bytes, bytes, int]:
        """The place before ``unit``: its frame, that frame's text before and after, and code points before."""
        if unit >= self.units:
            return len(self.frames), b"", b"", self.chars
        at = bisect_right(self.starts, unit) - 1
        frame = self.frames[at]
        if frame["units"] == unit:
            return at, b"", zstandard.decompress(frame["data"]), frame["chars"]
        text = zstandard.decompress(frame["data"])
        place = int(unit_ends(np.frombuffer(text, np.uint8))[unit - frame["units"] - 1])
        return at, text[:place], text[place:], frame["chars"] + _chars(np.frombuffer(text[:place], np.uint8))

    def parts(self, first: int, second: int) -> tuple[list[list[bytes]], int, int]:
        """Frames of prefix, middle and suffix, and code points before both cuts."""
        pack = zstandard.ZstdCompressor(level=LEVEL)
        small = lambda text: [pack.compress(text)] if text else []
        whole = [f["data"] for f in self.frames]
        a, head, rest, before = self.cut(first)
        b, inner, tail, upto = self.cut(second)
        prefix = whole[:a] + small(head)
        if a == b:
            middle = small(rest[: len(inner) - len(head)])
        else:
            middle = (small(rest) if head else whole[a : a + 1]) + whole[a + 1 : b] + small(inner)
        suffix = whole[b:] if not inner else small(tail) + whole[b + 1 :]
        return [prefix, middle, suffix], before, upto


def plan(doc_id: object, units: int, marked: bool, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int, int]:
    """Form and cuts of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not units or marked or h[2] % 100 >= rate:
        return "plain", 0, 0
    first, second = sorted((h[0] % (units + 1), h[1] % (units + 1)))
    return "spm" if h[3] % 100 < suffix_first else "psm", first, second


def unpacked(frames: Iterable[bytes]) -> Iterator[bytes]:
    read = zstandard.ZstdDecompressor()
    return map(read.decompress, frames)


def pieces(frames: list[bytes], form: str) -> list[list[tuple[int, int, int]]]:
    """Where prefix, middle and suffix lie in an output: (frame, from, to) of each.

    Only the text is looked at, not where frames end: a mark may lie across several of them.
    """
    found: list[list[tuple[int, int, int]]] = [[], [], []]
    if form == "plain":
        found[0] = [(i, 0, len(t)) for i, t in enumerate(unpacked(frames))]
        return found
    order = ORDERS[form]
    marks = [MARKS[0 if part == 0 else 3 - part] for part in order]
    current = -1
    pending: list[tuple[int, int, bytes]] = []  # bytes that may begin a mark: frame, place, byte

    def give(i: int, a: int, b: int) -> None:
        if a < b:
            if current < 0:
                raise ValueError(f"output does not begin with {marks[0]!r}")
            found[order[current]].append((i, a, b))

    for i, text in enumerate(unpacked(frames)):
        carried = b"".join(c for _, _, c in pending)
        whole = carried + text
        where = lambda p: pending[p][:2] if p < len(pending) else (i, p - len(carried))  # noqa: B023, E731
        at = 0
        while current + 1 < len(marks):
            place = whole.find(marks[current + 1], at)
            if place < 0:
                break
            for p in range(at, min(place, len(pending))):
                give(where(p)[0], where(p)[1], where(p)[1] + 1)
            give(i, max(at - len(carried), 0), place - len(carried))
            at, current = place + len(marks[current + 1]), current + 1
        held = 0
        if current + 1 < len(marks):
            mark = marks[current + 1]
            held = next((n for n in range(min(len(mark) - 1, len(whole) - at), 0, -1) if whole.endswith(mark[:n])), 0)
        stop = len(whole) - held
        for p in range(at, min(stop, len(pending))):
            give(where(p)[0], where(p)[1], where(p)[1] + 1)
        give(i, max(at - len(carried), 0), stop - len(carried))
        pending = [(*where(p), whole[p : p + 1]) for p in range(stop, len(whole))]
    for j, a, _ in pending:
        give(j, a, a + 1)
    if current + 1 < len(marks):
        raise ValueError(f"output lacks {marks[current + 1]!r}")
    return found


def restore(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The text that an output was made of, in chunks of at most one frame."""
    for part in pieces(frames, form):
        read, last, text = zstandard.ZstdDecompressor(), -1, b""
        for i, a, b in part:
            if i != last:
                last, text = i, read.decompress(frames[i])
            yield text[a:b]


def sha256_of(chunks: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for chunk in chunks:
        digest.update(chunk)
    return digest.hexdigest()


def _batches(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of rows that come with their weight in bytes."""
    kept: list[tuple] = []
    weight = 0
    for size, row in rows:
        kept.append(row)
        weight += size + 64
        if weight >= FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)
            kept, weight = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)


def _schema(batch_type: pa.DataType, *fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("doc_id", batch_type), *fields])


def store_frames(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", frame: int = FRAME) -> DataFrame:
    """Per row: doc_id, n (units), n_chars, marked (a mark occurs in the text) and frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple]]:
            for key, value in zip(batch.column(0), batch.column(1)):
                whole = value.as_py() or b""
                n, chars, frames = frames_of(whole, frame)
                yield sum(len(f["data"]) for f in frames), (key.as_py(), n, chars, any(m in whole for m in MARKS), frames)

        for batch in batches:
            schema = _schema(batch.schema.field(0).type, ("n", pa.int64()), ("n_chars", pa.int64()), ("marked", pa.bool_()), ("frames", pa.list_(STORE)))
            yield from _batches(rows(batch), schema)

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, n bigint, n_chars bigint, marked boolean, frames array<struct<units: bigint, chars: bigint, data: binary>>")


def fill_in_middle(store: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Per row of a store: doc_id, n, form, prefix_chars, middle_chars and output, a list of frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple]]:
            pack = zstandard.ZstdCompressor(level=LEVEL)
            marks = [pack.compress(m) for m in MARKS]
            for key, n, chars, marked, frames in zip(*batch.columns):
                key, held = key.as_py(), Store(n.as_py(), chars.as_py(), frames.as_py())
                form, first, second = plan(key, held.units, marked.as_py(), seed, rate, suffix_first)
                if form == "plain":
                    made, before, inside = [f["data"] for f in held.frames], None, None
                else:
                    parts, before, upto = held.parts(first, second)
                    inside, made = upto - before, []
                    for part in ORDERS[form]:
                        made += [marks[0 if part == 0 else 3 - part], *parts[part]]
                yield sum(map(len, made)), (key, held.units, form, before, inside, made)

        for batch in batches:
            schema = _schema(batch.schema.field(0).type, ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.list_(pa.binary())))
            yield from _batches(rows(batch), schema)

    kind = store.schema["doc_id"].dataType.simpleString()
    given = store.select("doc_id", "n", "n_chars", "marked", "frames")
    return given.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output array<binary>")


def with_digests(made: DataFrame) -> DataFrame:
    """Outputs with the digest of their text and of the text restored from them, without the frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            output, restored = [], []
            for frames, form in zip(batch.column("output"), batch.column("form")):
                frames = frames.as_py()
                output.append(sha256_of(unpacked(frames)))
                restored.append(sha256_of(restore(frames, form.as_py())))
            rest = batch.drop_columns(["output"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(output, pa.string()), pa.array(restored, pa.string())], [*rest.schema.names, "output_sha256", "restored_sha256"])

    given = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    kind = made.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = keep_table(spark, store_frames(docs), "frames")
    return with_digests(fill_in_middle(store))


OP12_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         len(units) AS n, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT *, ('0x' || h[1:8])::UBIGINT % (n + 1) AS c1, ('0x' || h[9:16])::UBIGINT % (n + 1) AS c2,
         ('0x' || h[17:24])::UBIGINT % 100 AS h3, ('0x' || h[25:32])::UBIGINT % 100 AS h4 FROM units
), cut AS (
  SELECT doc_id, n, text,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50 THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1 : least(c1, c2)], '') AS prefix, array_to_string(units[least(c1, c2) + 1 : greatest(c1, c2)], '') AS middle,
         array_to_string(units[greatest(c1, c2) + 1 :], '') AS suffix FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM cut
"""

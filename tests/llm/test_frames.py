"""Seekable frames: cuts, outputs and restored texts against whole strings."""

import hashlib
import random
import re

import pytest
import zstandard
from pyspark.sql import functions as F

from forkline.llm import frames

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def texts():
    rng = random.Random(4)
    parts = ["a", "bc", " ", "  ", "\n", "\t", "é", "日本", "<", "P>", "S>", "\x1f", "\x0b", " ", "🙂", "\x00", "<S"]
    return ["", " ", "a", " a", "a ", "  \n", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(400))]


def opened(parts):
    return b"".join(zstandard.decompress(p) for p in parts).decode()


@pytest.mark.parametrize("size", [1, 7, 1 << 15])
def test_cuts(size):
    rng = random.Random(size)
    for text in texts():
        units = UNIT.findall(text)
        n, chars, made = frames.frames_of(text.encode(), size)
        assert (n, chars) == (len(units), len(text)) and opened([f["data"] for f in made]) == text
        store = frames.Store(n, chars, made)
        for _ in range(4):
            a, b = sorted((rng.randint(0, n), rng.randint(0, n)))
            parts, before, upto = store.parts(a, b)
            cut = ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]
            assert [opened(p) for p in parts] == cut and (before, upto) == (len(cut[0]), len(cut[0] + cut[1]))


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_restoring_looks_at_the_text_alone(form):
    """Outputs framed anew anywhere, also inside marks and code points, give the same text."""
    rng = random.Random(6)
    pack = zstandard.ZstdCompressor()
    for text in texts():
        if any(m.decode() in text for m in frames.MARKS):
            continue
        units = UNIT.findall(text)
        a, b = sorted((rng.randint(0, len(units)), rng.randint(0, len(units))))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        output = (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}").encode()
        stops = sorted(rng.randint(0, len(output)) for _ in range(rng.randint(0, 8)))
        pieces = [pack.compress(output[x:y]) for x, y in zip([0, *stops], [*stops, len(output)])]
        assert b"".join(frames.restore(pieces, form)).decode() == text
    single = [pack.compress(output[i : i + 1]) for i in range(len(output))]
    assert b"".join(frames.restore(single, form)).decode() == text


def test_broken_outputs_are_refused():
    pack = zstandard.ZstdCompressor()
    for text in (b"no mark", b"<P>only one", b"x<P>a<S>b<M>c"):
        with pytest.raises(ValueError):
            list(frames.restore([pack.compress(text)], "psm"))


def test_only_cut_frames_are_opened(monkeypatch):
    text = " ".join(f"w{i}" for i in range(20_000)).encode()
    n, chars, made = frames.frames_of(text, 1000)
    opened_frames = []
    plain = zstandard.decompress
    monkeypatch.setattr(frames.zstandard, "decompress", lambda data: opened_frames.append(1) or plain(data))
    frames.Store(n, chars, made).parts(5000, 15_000)
    assert len(made) > 50 and len(opened_frames) == 2


def test_whole_table(spark):
    long = "word " * 100_000
    rows = [(1, "one two three four five six"), (2, None), (2, None), (3, ""), (None, "no id here"), (4, "has <P> inside"), (5, long), (5, long), (None, None), (6, " \n ")]
    rows += [(100 + i, f"text {i} with some words in it, and é 日本 too \n") for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for docs in (table, table.withColumn("n", F.lit("x")).withColumn("frames", F.lit("x")).withColumn("form", F.lit(1))):
        made = frames.with_digests(frames.fill_in_middle(frames.store_frames(docs, frame=64)))
        found = sorted(made.collect(), key=str)
        expected = []
        for key, text in rows:
            text = text or ""
            units = UNIT.findall(text)
            h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
            h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
            a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
            p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
            form = "plain" if not units or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
            output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
            sizes = (None, None) if form == "plain" else (len(p), len(m))
            expected.append((key, len(units), form, *sizes, *(hashlib.sha256(x.encode()).hexdigest() for x in (output, text))))
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
        assert {"plain", "psm", "spm"} == {r["form"] for r in found}
    assert frames.with_digests(frames.fill_in_middle(frames.store_frames(table.limit(0)))).count() == 0


def test_output_is_one_stream(spark):
    docs = spark.createDataFrame([(i, "some words to cut " * 20) for i in range(30)], "doc_id bigint, text string")
    for r in frames.fill_in_middle(frames.store_frames(docs, frame=50), rate=100).collect():
        whole = b"".join(bytes(f) for f in r["output"])
        with zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True) as reader:
            text = reader.read().decode()
        assert r["form"] != "plain" and len(text) == 360 + 9

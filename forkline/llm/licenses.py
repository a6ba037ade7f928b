"""License scans by ordered signature rules over the words of a text.

A text is lower-cased (A-Z) and taken apart into words, so line breaks and punctuation never
hide a notice. A rule is a pattern over these words with a keyword, a label, a priority and
a confidence. One automaton finds which keywords a text holds, and only rules of those
keywords run, in their order. Where detections overlap, rules of higher priority are taken
first, longer ones before shorter ones; a detection that lies inside an accepted interval is
suppressed. The rules stand in ``license_rules``, written one by one. What is accepted keeps its
place (in words), so that callers can cut notices out.

The base phrases are counted apart from this, at all their places, and nothing suppresses
their labels.

Nulls: a null text is empty, has no words, no labels and score 0. Repeated rows are scanned
alike, and an empty table gives an empty result. The work is one pass over each text; no
row needs another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.llm.license_rules import SECTIONS

#: Fixed: the phrases and labels of the base count.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: All bytes below 0x80 that no word holds, once A-Z are lower case.
_GAPS = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "detections array<struct<label:string,rule:bigint,start:bigint,stop:bigint>>"
)


@dataclass(frozen=True)
class Rule:
    keyword: str
    label: str
    pattern: re.Pattern
    priority: int
    confidence: float


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in their order; the order decides between equals."""
    return tuple(
        Rule(keyword, label, re.compile(rf"(?<!\S)(?:{pattern})(?!\S)"), priority, confidence)
        for priority, confidence, section in SECTIONS
        for label, keyword, pattern, _ in section
    )


@cache
def _keywords() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for keyword in {r.keyword for r in rules()}:
        found.add_word(keyword, keyword)
    found.make_automaton()
    return found


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_GAPS).split()


def suppress(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (rule, start, stop), those that no better detection contains."""
    order = sorted(found, key=lambda d: (-rules()[d[0]].priority, d[1] - d[2], d[1], d[0]))
    kept: list[tuple[int, int, int]] = []
    reach: list[tuple[int, int]] = []
    for d in order:
        if not any(start <= d[1] and d[2] <= stop for start, stop in reach):
            kept.append(d)
            reach.append((d[1], d[2]))
    return kept


def _clusters(found: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of detections that overlap, so that a long list is never compared with itself."""
    group: list[tuple[int, int, int]] = []
    end = -1
    for d in sorted(found, key=lambda d: (d[1], d[2])):
        if group and d[1] >= end:
            yield group
            group = []
        group.append(d)
        end = max(end, d[2])
    if group:
        yield group


def scan(text: str | None) -> tuple:
    """The columns of SCHEMA for one whole text."""
    words = words_of(text)
    flat = b" ".join(words)
    framed = b" " + flat + b" "
    places: list[tuple[int, str]] = []
    for phrase, label in BASE:
        needle = f" {phrase} ".encode()
        at = framed.find(needle)
        while at >= 0:
            places.append((at, label))
            at = framed.find(needle, at + 1)
    line = flat.decode("utf-8", "surrogatepass")
    keywords = {k for _, k in _keywords().iter(line)}
    found = []
    if keywords:
        for n, rule in enumerate(rules()):
            if rule.keyword in keywords:
                found += [(n, m.start(), m.end()) for m in rule.pattern.finditer(line)]
    accepted = sorted((d for group in _clusters(found) for d in suppress(group)), key=lambda d: d[1])
    detections, miss, at, word = [], 1.0, 0, 0
    for n, start, stop in accepted:
        word += line.count(" ", at, start)
        at = start
        detections.append((rules()[n].label, n, word, word + line.count(" ", start, stop) + 1))
        miss *= 1 - rules()[n].confidence
    for _ in places:
        miss *= 0.5
    base = {label for _, label in places}
    spots = [at for at, _ in places]
    # In ``framed`` a phrase's needle starts at the blank before it: as many blanks as words.
    first, last = (framed.count(b" ", 0, spot) for spot in (min(spots), max(spots))) if spots else (None, None)
    return (len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | {d[0] for d in detections})), 1 - miss, detections)


def _scans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    for batch in batches:
        frame = pd.DataFrame([scan(t) for t in batch["text"]], columns=names)
        for name in ("first_word", "last_word"):
            frame[name] = frame[name].astype("Int64")
        frame["detections"] = [[dict(zip(("label", "rule", "start", "stop"), d)) for d in ds] for ds in frame["detections"]]
        frame.insert(0, "key", batch["key"].to_numpy() if len(batch) else [])
        yield frame


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the counts, labels and score of every text, and the accepted detections."""
    key = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(_scans, f"key string, {SCHEMA}").withColumn("key", F.col("key").cast(key)).withColumnRenamed("key", "doc_id")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")

"""The operators against brute force, round trips and held-out accuracy."""

import collections
import itertools
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import __spark_entry__ as contract
import corpus_pipeline
from forkline.llm import licenses, linecrf, packing, pii, quality, recurrent, simhash, tokenfile
from forkline.llm.license_rules import SECTIONS
from forkline.llm.tokens import Encoder


@pytest.fixture(scope="module")
def docs(small):
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{small}/documents.parquet' ORDER BY doc_id").fetchall()


def rows_of(spark, small, name):
    return contract.queries()[name](spark, small).collect()


@pytest.mark.parametrize("name", sorted(n for n in contract.oracle_sql() if re.match(r"op\d+_", n)))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    df = contract.queries()[name](spark, small)
    found = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, found.fetchall()))


# ---------------------------------------------------------------- op2


def test_license_base(spark, small, docs):
    texts = dict(docs)
    for r in rows_of(spark, small, "op2_license_scans"):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]]))
        places = [(n, label) for phrase, label in licenses.BASE for n in range(len(words)) if words[n : n + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert r["first_word"] == min((n for n, _ in places), default=None) and r["last_word"] == max((n for n, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert {label for _, label in places} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_rules():
    assert len(licenses.rules()) > 300
    found = licenses.scan("This work is licensed under the GNU General Public\nLicense, version 3. cc by cc by. Copyright (c) 2020")
    assert found[1] == 3 and found[5] == "cc-by,copyright,gpl,gpl-3.0"
    spans = {d[0]: d[2:] for d in found[7]}
    assert spans["gpl-3.0"] == (2, 12)  # the longest of the best rules, all inside it suppressed
    assert licenses.scan("the smit license is not the mit licence of premit license")[5] == "mit"


@pytest.mark.parametrize("number", range(len(licenses.rules())))
def test_license_rule_alone(number):
    """Every rule finds its own notice, in running text too, and no other rule does."""
    notices = [notice for _, _, section in SECTIONS for *_, notice in section]
    rule = licenses.rules()[number]
    for text in (notices[number], f"Über dies.\n\n * {notices[number].replace(' ', chr(10) + ' * ')}\n\nEt cetera und so weiter"):
        assert [(d[0], d[1]) for d in licenses.scan(text)[7]] == [(rule.label, number)], text


@pytest.mark.parametrize(
    "text, labels",
    [
        ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause */", "apache-2.0,bsd-3-clause,mit"),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", "gpl-2.0-only,linux-syscall-note"),
        ("It is distributed under the LGPL; the docs are CC BY-SA 4.0.", "cc-by,cc-by-sa,lgpl"),
        ("dual licensed: AGPL-3.0 or MPL 2.0", "agpl-3.0,mpl-2.0"),
        ("This crate is MIT licensed", "mit"),
        ("Released by Jo under version 2.1 of the GNU Lesser General Public License", "lgpl-2.1"),
        ("Wir kommen mit oder ohne Lizenz, mit 2 Clauses und ISC", ""),
        ("He gave license to all; public opinion and general domain knowledge", ""),
        ("the apache people, the artistic boost, an eclipse over mozilla", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_license_notices(text, labels):
    assert licenses.scan(text)[5] == labels


def test_license_containment_against_all_pairs():
    """What is kept is what no better detection contains, checked pair by pair."""
    rng = random.Random(5)
    better = lambda a, b: (-licenses.rules()[a[0]].priority, a[1] - a[2], a[1], a[0]) < (-licenses.rules()[b[0]].priority, b[1] - b[2], b[1], b[0])
    for _ in range(200):
        found = list({(rng.randrange(len(licenses.rules())), s := rng.randrange(20), s + rng.randrange(1, 9)) for _ in range(12)})
        kept = {d for d in found if not any(better(e, d) and e[1] <= d[1] and d[2] <= e[2] for e in found)}
        assert set(licenses.suppress(found)) == kept


# ---------------------------------------------------------------- op3


def test_repeated_words(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = df.select("doc_id", quality.counts(df["text"])["n_repeat_words"].alias("n")).collect()
    for r in got:
        words = texts[r["doc_id"]].split()
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        count = collections.Counter(grams)
        assert r["n"] == len({i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)})


# ---------------------------------------------------------------- op4


def test_gradient():
    rng = np.random.default_rng(0)
    flat = recurrent.initial(rng.integers(1, 100, recurrent.REST), rng.integers(1, 50, recurrent.TAILS)).astype(np.float64)
    before, target = rng.integers(0, recurrent.SYMBOLS, (5, 3)), rng.integers(0, recurrent.SYMBOLS, (5, 3))
    before[2, 1] = 0
    h = rng.normal(size=(3, recurrent.HIDDEN))
    grad, _, _ = recurrent.window_gradient(flat, h, before, target)
    for places in recurrent.unpack(np.arange(len(flat))).values():
        for i in [i for i in places.ravel() if abs(grad[i]) > 1e-5][:3]:
            up, down = flat.copy(), flat.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            slope = (recurrent.window_gradient(up, h, before, target)[2] - recurrent.window_gradient(down, h, before, target)[2]) / 2e-5
            assert abs(slope - grad[i]) < 1e-5


def test_windows_carry_the_state():
    rng = np.random.default_rng(2)
    flat = recurrent.initial(rng.integers(1, 100, recurrent.REST), rng.integers(1, 50, recurrent.TAILS))
    seqs = [np.append(rng.integers(1, recurrent.SYMBOLS, n), 0) for n in (0, 1, 7, 100, 33)]
    whole = recurrent.log_likelihoods(flat, seqs, window=1000)
    assert np.allclose(whole, recurrent.log_likelihoods(flat, seqs, window=4), atol=1e-3)
    assert np.allclose(whole, [recurrent.log_likelihoods(flat, [s])[0] for s in seqs], atol=1e-3)


def test_next_tokens_add_up_to_one():
    flat = recurrent.initial(np.arange(1, recurrent.REST + 1), np.arange(recurrent.TAILS), seed=3)
    every = [np.array([5, 9, t]) for t in range(recurrent.SYMBOLS)]
    start = recurrent.log_likelihoods(flat, [np.array([5, 9])])[0]
    assert math.isclose(np.exp(recurrent.log_likelihoods(flat, every) - start).sum(), 1, abs_tol=1e-4)


def plain_score(flat, words, corpus_counts, own, tails):
    """Token by token with loops: the natural-log network and the shares inside the classes of other words, in log10."""
    p = {k: v.astype(float) for k, v in recurrent.unpack(flat).items()}
    h, before, total = np.zeros(recurrent.HIDDEN), 0, 0.0
    n = recurrent.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for word in [*words, b""]:
        given, state = p["inputs"][before], h @ p["state"]
        reset, keep = sigmoid(given[:n] + state[:n]), sigmoid(given[n : 2 * n] + state[n : 2 * n])
        new = np.tanh(given[2 * n :] + reset * (state[2 * n :] + p["state_bias"]))
        h = keep * h + (1 - keep) * new
        classes = softmax(h @ p["classes"] + p["class_bias"])
        number = own.get(word)
        if number is not None:
            k, at = divmod(number, recurrent.PER_CLASS)
            total += math.log10(classes[k]) + math.log10(softmax(h @ p["words"][k] + p["word_bias"][k])[at])
            before = number
        else:
            k = (31 * word[-1] + (word[-2] if len(word) > 1 else 0)) % recurrent.TAILS
            total += math.log10(classes[recurrent.CLASSES + k]) + math.log10((corpus_counts[word] + 1) / (tails[k][0] + tails[k][1] + 1))
            before = recurrent.REST + k
    return total


@pytest.mark.parametrize("head", [1500, 100_000])
def test_scores_token_by_token(spark, small, docs, head):
    """The whole job against loops over single tokens, also where words lie past the head."""
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"{small}/documents.parquet")
    learns = ~recurrent.held_out(F.col("doc_id"))
    corpus = recurrent.count_tokens(table.filter(learns), head=head)
    encoded = recurrent.encode(table, corpus, learns)
    flat = recurrent.fit(encoded, corpus)
    tokens = {i: t.encode().lower().split() for i, t in docs}
    count = collections.Counter(w for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*tokens[i], b""])
    own = {w: n for n, w in enumerate(corpus.words[: recurrent.REST])}
    tails = collections.defaultdict(lambda: [0, 0])
    for w, c in count.items():
        if w not in own:
            k = recurrent.tail_class(w)
            tails[k][0] += c
            tails[k][1] += 1
    assert len(corpus.words) <= head + 1 and (head > 2000 or len(count) > len(corpus.words))
    for r in recurrent.score_documents(encoded, corpus, flat).filter(F.col("doc_id") % 9 == 0).collect():
        if len(tokens[r["doc_id"]]) < 2000:
            assert math.isclose(r["score"], plain_score(flat, tokens[r["doc_id"]], count, own, tails), rel_tol=1e-3)


def test_scores(spark, small, docs):
    found = rows_of(spark, small, "op4_lm_scoring")
    tokens = {i: [*t.encode().lower().split(), None] for i, t in docs}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    count = collections.Counter(w for i in tokens if not out[i] for w in tokens[i])
    total, kinds = sum(count.values()), len(count)
    for r in found:
        own = tokens[r["doc_id"]]
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(own), sum(count[w] > 0 for w in own), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


# ---------------------------------------------------------------- op6 and op8


def odd_texts():
    rng = random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "é", "́", "1", "12", "!", "日本", "\x1f", "\x0b", "ﬁ", "'", "Σ", "İ", " ", "<|endoftext|>"]
    return ["", " ", "\n\n", "a \n \tb", "mark \ufdd0 inside", "\ufdd0", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000))]


@pytest.mark.parametrize("name, drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_ids_are_those_of_the_library(docs, name, drops):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path(name))
    library.encode_special_tokens = True
    texts = [t for _, t in docs] + odd_texts()
    expected = [[*e.ids, 0] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [list(i) for i in Encoder(packing.tokenizer_path(name), drops).encode(texts)] == expected


@pytest.mark.parametrize("name, drops, change", [("byte_bpe_50k.json", False, "prefix"), ("byte_bpe_50k.json", False, "lower"), ("word_bpe_49k.json", True, "order")])
def test_other_vocabularies_encode_whole_texts(tmp_path, docs, name, drops, change):
    """A vocabulary that cuts or normalises otherwise is not taken apart."""
    import json

    from tokenizers import Tokenizer

    with open(packing.tokenizer_path(name), encoding="utf-8") as file:
        conf = json.load(file)
    if change == "prefix":
        conf["pre_tokenizer"]["add_prefix_space"] = True
    elif change == "lower":
        conf["normalizer"] = {"type": "Lowercase"}
    else:
        conf["normalizer"]["normalizers"].reverse()
    (tmp_path / "other.json").write_text(json.dumps(conf))
    library = Tokenizer.from_file(str(tmp_path / "other.json"))
    library.encode_special_tokens = True
    texts = [t for _, t in docs][:50] + odd_texts()[:200]
    other = Encoder(str(tmp_path / "other.json"), drops)
    assert other.whole and not Encoder(packing.tokenizer_path(name), drops).whole
    assert [list(i) for i in other.encode([*texts, None])] == [[*e.ids, 0] for e in library.encode_batch([*texts, ""], add_special_tokens=False)]


def test_long_text_in_steps(monkeypatch, docs):
    from forkline.llm import tokens

    text = " ".join(t for _, t in docs)[:200_000]
    path = packing.tokenizer_path("byte_bpe_50k.json")
    whole = list(next(Encoder(path, False).encode([text])))
    monkeypatch.setattr(tokens, "GROUP", 1000)
    assert list(next(Encoder(path, False).encode([text]))) == whole


def test_words_round_trip():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, m, n, dtype=np.uint64) for m, n in [(2, 1000), (50257, 3000), (5, 1), (2**32, 700), (2**63, 300), (300, 257), (1, 256), (2, 60)]]
    texts.append(np.array([2**64 - 1, 0, 1, 2**60, 2**60 - 1, 2**64 - 1, 2**64 - 1, 5], np.uint64))
    for text, (n, blocks, words) in zip(texts, tokenfile.encode_documents(texts)):
        values, after = tokenfile.decode_words(np.frombuffer(words, "<u8"))
        assert n == len(text) and (values == text).all()
        for k, at in enumerate(blocks):  # each block decodes alone
            part = tokenfile.decode_words(np.frombuffer(words, "<u8")[at : blocks[k + 1] if k + 1 < len(blocks) else None])[0]
            assert (part == text[k * tokenfile.BLOCK : (k + 1) * tokenfile.BLOCK]).all()


def test_token_files(spark, small, docs):
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(spark, small, "op6_token_files")}
    start = 0
    for (doc_id, _), ids in zip(docs, Encoder(packing.tokenizer_path("byte_bpe_50k.json"), False).encode([t for _, t in docs])):
        assert found[doc_id] == (start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        start += len(ids)


def test_packing(spark, small, docs):
    found = rows_of(spark, small, "op8_best_fit_packing")
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for (doc_id, _), ids in zip(docs, Encoder(packing.tokenizer_path("word_bpe_49k.json"), True).encode([t for _, t in docs])):
        cut = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
        assert sorted(pieces[doc_id]) == [(k, 2048 * k, len(c), zlib.crc32(c.astype("<u4").tobytes())) for k, c in enumerate(cut)]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in found) // 2048) + 1


@pytest.mark.parametrize("seed", range(4))
def test_search_only_improves(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers([1, 400, 600, 1][seed], [101, 1200, 700, 60][seed], 300)
    bins = packing.Bins(sizes, [100, 2048, 2048, 100][seed])
    before, squares = bins.count(), sum(f * f for f in bins.fill)
    bins.improve()
    assert bins.count() <= before and sum(f * f for f in bins.fill) >= squares and max(bins.fill) <= bins.capacity
    assert sorted(itertools.chain(*bins.items)) == list(range(300))
    assert all(sum(bins.sizes[i] for i in items) == fill for items, fill in zip(bins.items, bins.fill))


def best_fit_decreasing(sizes, capacity):
    fills = []
    for size in sorted(sizes, reverse=True):
        fitting = [n for n, f in enumerate(fills) if f + size <= capacity]
        if fitting:
            fills[max(fitting, key=lambda n: fills[n])] += size
        else:
            fills.append(size)
    return len(fills)


def test_search_empties_sequences():
    sizes = np.random.default_rng(0).integers(500, 1200, 1000)
    bins = packing.Bins(sizes, 2048)
    start = bins.count()
    bins.improve()
    assert bins.count() == sum(1 for i in bins.items if i) < start
    assert bins.count() <= best_fit_decreasing(sizes.tolist(), 2048)


def test_search_reaches_the_bound(spark, small, docs):
    """From next fit on, the search alone brings the documents to the least number of sequences."""
    ids = Encoder(packing.tokenizer_path("word_bpe_49k.json"), True).encode([t for _, t in docs])
    sizes = np.array([len(part[a : a + 2048]) for part in ids for a in range(0, len(part), 2048)])
    bins = packing.Bins(sizes, 2048)
    start = bins.count()
    bins.improve()
    assert bins.count() == -(-int(sizes.sum()) // 2048) < start


# ---------------------------------------------------------------- op7


def plain_fingerprint(text):
    words = text.encode().lower().split()
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)] if words else []
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def groups_of(prints):
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in prints}


def test_simhash(spark, small, docs):
    prints = {i: plain_fingerprint(t) for i, t in docs}
    expected = groups_of(prints)
    for r in rows_of(spark, small, "op7_simhash"):
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == expected[r["doc_id"]]


def test_keys_miss_nothing():
    rng = np.random.default_rng(1)
    a = rng.integers(-(2**63), 2**63, 4000, dtype=np.int64)
    for errors in range(3):
        b = a.copy()
        for _ in range(errors):
            b ^= np.left_shift(np.uint64(1), rng.integers(0, 64, len(b)).astype(np.uint64)).view(np.int64)
        keys = []
        for values in (a, b):
            which, key = simhash.keys_of(values)
            found = collections.defaultdict(set)
            for i, k in zip(which.tolist(), key.tolist()):
                found[i].add(k)
            keys.append(found)
        assert all(keys[0][i] & keys[1][i] for i in range(len(a)))


@pytest.mark.parametrize("bucket", [2, 64])
def test_large_buckets_lose_no_link(spark, bucket):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    values = {s ^ (1 << a) ^ (1 << b) ^ (1 << c) for s in seeds for a, b, c in ((rng.randrange(64), rng.randrange(64), rng.randrange(64)) for _ in range(60))}
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    fps = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    found = simhash.components(simhash.links(fps, bucket)).collect()
    roots = {r["node"]: r["root"] for r in found}
    expected = groups_of(signed)
    by_group = collections.defaultdict(set)
    for s in signed:
        by_group[expected[s]].add(roots.get(s, s))
    assert all(len(g) == 1 for g in by_group.values()) and len(set(itertools.chain(*by_group.values()))) == len(by_group)


# ---------------------------------------------------------------- op9


def test_permutations():
    for size in (2, 3, 10, 100, 1000):
        images = [pii.permute(b"k", b"t", n, size) for n in range(size)]
        assert sorted(images) == list(range(size)) and all(n != m for n, m in enumerate(images))
        assert images != [pii.permute(b"other", b"t", n, size) for n in range(size)] or size < 4


def test_pseudonyms_keep_their_format():
    text = "a.b7@x.org +1 (212) 555-0101 4111 1111 1111 1111 10.0.200.7 078-05-1120 2024-02-29 31.12.1999 1/2/2003 GB82 WEST 1234 5698 7654 32 token = \"00ff00ff00ff00ff\""
    made, spans = pii.pseudonymise(text, pii.KEY)
    assert [k for k, _, _ in spans] == ["email", "phone", "card", "ip", "ssn", "date", "date", "date", "iban", "secret"]
    assert len(made) == len(text)
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", s)))
    for kind, a, b in spans:
        assert made[a:b] != text[a:b]
        if kind != "secret":
            assert shape(made[a:b])[:4] == shape(text[a:b])[:4]
    again, spans2 = pii.pseudonymise(made, pii.KEY)
    assert [s for s in spans2] == spans  # pseudonyms are valid values
    assert pii.pseudonymise("x " + text, pii.KEY)[0][2:] == made


@pytest.mark.parametrize("text", ["9807915762804490", "999.1.1.1", "2024-02-30", "666-12-1234", "version 1.2.3", "GB83 WEST 1234 5698 7654 32", "1 234 567", "@home me@", "key = value"])
def test_what_is_not_valid_stays(text):
    assert pii.pseudonymise(text, pii.KEY) == (text, [])


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if n % 2 else int(d) for n, d in enumerate(reversed(digits))) % 10 == 0


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def calendar(value):
    import datetime

    for form in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y"):
        try:
            datetime.datetime.strptime(value, form)
            return True
        except ValueError:
            pass
    return False


#: By kind: a plain finder, and whether what it finds is a value, checked anew.
PLAIN = {
    "email": (re.compile(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), lambda v: True),
    "card": (re.compile(r"(?<![\d+.,-])(?:\d{4}[ -]){3}\d{4}(?![\d-])"), lambda v: luhn(re.sub(r"\D", "", v))),
    "ip": (re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])"), lambda v: all(int(p) < 256 and str(int(p)) == p for p in v.split("."))),
    "date": (re.compile(r"(?<![\d/.-])\d{4}-\d{2}-\d{2}(?![\d/-])"), calendar),
    "iban": (re.compile(r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"), mod97),
}


def test_pii_query(spark, small, docs):
    """Values found by other means are replaced by valid ones, one to one over all documents, and nothing else changes."""
    rows = pii.pseudonym_table(spark.read.parquet(f"{small}/documents.parquet"), pii.KEY).collect()
    made = {r["doc_id"]: (r["text"], [tuple(s) for s in r["spans"]]) for r in rows}
    by_query = {r["doc_id"]: r for r in rows_of(spark, small, "op9_pii")}
    assert set(by_query) == set(made) == {i for i, _ in docs}
    there, back, seen = {}, {}, collections.Counter()
    for doc_id, text in docs:
        new, spans = made[doc_id]
        assert (by_query[doc_id]["text"], by_query[doc_id]["n_values"]) == (new, len(spans))
        assert by_query[doc_id]["kinds"] == ",".join(sorted({k for k, _, _ in spans}))
        assert len(new) == len(text) and spans == sorted(spans, key=lambda s: s[1])
        at = 0
        for kind, a, b in spans:
            assert a >= at and new[at:a] == text[at:a]
            at = b
            old, now = (re.sub(r"[ ().-]", "", t[a:b]) if kind in ("card", "phone", "ssn", "iban") else t[a:b] for t in (text, new))
            assert there.setdefault((kind, old), now) == now and back.setdefault((kind, now), old) == old and old != now
            if kind in PLAIN:
                assert PLAIN[kind][1](re.sub(" ", "", new[a:b]) if kind == "iban" else new[a:b])
        assert new[at:] == text[at:]
        for kind, (finder, valid) in PLAIN.items():
            for m in finder.finditer(text):
                if valid(m[0]):
                    seen[kind] += 1
                    assert any(a < m.end() and m.start() < b for _, a, b in spans), (doc_id, kind, m[0])
    assert seen["email"] and seen["ip"], seen
    told = "Mail a.b@c.org, card 4111 1111 1111 1111, BE68539007547034 and GB82WEST12345698765432 on 2024-02-29 from 10.0.0.1."
    new, spans = pii.pseudonymise(told, pii.KEY)
    assert sorted(k for k, _, _ in spans) == sorted(["email", "card", "iban", "iban", "date", "ip"])
    for kind, a, b in spans:
        assert PLAIN[kind][0].fullmatch(new, a, b) and PLAIN[kind][1](new[a:b]) and new[a:b] != told[a:b]


# ---------------------------------------------------------------- op10


def test_field_against_enumeration():
    rng = np.random.default_rng(4)
    sizes = np.array([3, 0, 1, 5])
    x = rng.normal(size=(9, 4))
    field = linecrf.Field(rng.normal(size=4), rng.normal(size=(2, 2)))
    good, expected, logs = linecrf.marginals(field, x, sizes)
    at, pairs, total, single = 0, np.zeros((2, 2)), 0.0, []
    for n in sizes.tolist():
        if not n:
            continue
        weights = {}
        for y in itertools.product((0, 1), repeat=n):
            weights[y] = math.exp(sum(y[i] * float(x[at + i] @ field.weights) for i in range(n)) + sum(field.pairs[a, b] for a, b in itertools.pairwise(y)))
        z = sum(weights.values())
        total += math.log(z)
        single += [sum(w for y, w in weights.items() if y[i]) / z for i in range(n)]
        for y, w in weights.items():
            for a, b in itertools.pairwise(y):
                pairs[a, b] += w / z
        at += n
    assert np.allclose(good, single) and np.allclose(expected, pairs) and math.isclose(logs, total)


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in contract.queries()["op10_quality_classifier"](spark, sf).collect()}
    labels = dict(duckdb.connect().execute(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    held = [i for i in labels if i in found and found[i]["held_out"]]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in found)
    assert sum(found[i]["predicted"] == labels[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, small, docs):
    """All stages by plain means, one after another."""
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({contract.oracle_sql()['op3_quality_rules']}) WHERE kept").fetchall()}
    texts = {i: t for i, t in docs if i in kept}
    groups = groups_of({i: plain_fingerprint(t) for i, t in texts.items()})
    texts = {i: t for i, t in texts.items() if groups[i] == i}
    leaks = {r[0] for r in con.execute(f"SELECT doc_id FROM ({contract.oracle_sql()['op1_decontamination']})").fetchall()}
    texts = {i: pii.pseudonymise(t, pii.KEY)[0] for i, t in texts.items() if i not in leaks}
    ids = Encoder(packing.tokenizer_path("word_bpe_49k.json"), True).encode(list(texts.values()))
    expected = sorted((i, k, len(part[s : s + 2048])) for i, part in zip(texts, ids) for k, s in enumerate(range(0, len(part), 2048)))
    found = corpus_pipeline.run(spark, small).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in found) == expected
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "PII", "best-fit packing"]


def test_the_tokenizers_library_starts_no_threads():
    """Spark deals the work; a task that encodes keeps to its own core."""
    import subprocess
    import sys

    code = (
        "import os, forkline.llm.tokens as t, forkline.llm.packing as p\n"
        "e = t.Encoder(p.tokenizer_path('byte_bpe_50k.json'), drops_blanks=False)\n"
        "before = len(os.listdir('/proc/self/task'))\n"
        "[*e.encode([' '.join(f'w{n}-{n}' for n in range(5000))])]\n"
        "print(len(os.listdir('/proc/self/task')) - before)"
    )
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, env=env, check=True)
    assert done.stdout.strip() == "0"

"""Concatenating and cutting, whitening and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eddyscale.llm import concatenation, offsets, packing, resampling, whitening
from eddyscale.llm.common import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASH = {"kept": 1, "part": 2, "ids": "x", "rank": 3, "start": 4, "bucket": 5, "rid": 6}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    out = [(i, words(rng.choice([2, 15, 40, 90]))) for i in range(150)]
    out += [(500, None), (501, ""), (502, " \n"), (503, words(9000)), (None, words(30)), (None, words(30)), (7, out[7][1]), (7, out[7][1]), (504, "É" * 300 + " ñ Don't 3½ x-y"), (505, out[9][1]), (506, "<|endoftext|> A b")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()}).repartition(6)


# --- offsets ------------------------------------------------------------------------------------


def test_offsets_are_prefix_sums_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(offsets, "BLOCK", 8)
    rng = random.Random(1)
    totals = {p: rng.randrange(1000) for p in rng.sample(range(500), 120)}
    got = {r["part"]: r["base"] for r in offsets.before(spark.createDataFrame(list(totals.items()), "part long, total long").repartition(7)).collect()}
    run, want = 0, {}
    for p in sorted(totals):
        want[p], run = run, run + totals[p]
    assert got == want


# --- concatenate and cut ------------------------------------------------------------------------


@pytest.mark.parametrize(("capacity", "tail"), [(4096, "powers"), (64, "powers"), (64, "pad")])
def test_every_id_lies_in_one_place(docs, rows, capacity, tail):
    encode = packing.encoder(packing.default_tokenizer()).tokenizer
    got = concatenation.pack(docs, capacity=capacity, tail=tail, keep=tuple(docs.columns)).collect()
    total = sum(r["length"] for r in got)
    want = sorted(tuple([*encode.encode(t or "", add_special_tokens=False).ids, 2]) for _, t in rows)
    lines, sequences = {}, {}
    for r in got:
        ids = np.frombuffer(bytes(r["_ids"]), "<u4")
        assert len(ids) == r["length"] and r["kept"] == 1 and r["ids"] == "x" and r["start"] == 4
        lines.setdefault((r["doc_id"], r["text"]), []).append((r["_start"], ids, r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    # pieces give back the documents, copies of one id several times over
    back = []
    for own in lines.values():
        copies = sum(s == 0 for s, _, _ in own)
        size = own[0][2]
        assert sum(len(i) for _, i, _ in own) == size * copies
        whole = np.zeros(size, np.int64)
        for s, i, _ in own:
            whole[s : s + len(i)] = i
        back += [tuple(whole.tolist())] * copies
    assert sorted(back) == want
    # sequences are gapless, full but for the last ones
    sizes = []
    for own in sequences.values():
        own.sort()
        at = 0
        for offset, length in own:
            assert offset == at
            at += length
        sizes.append(at)
    assert sorted(sequences) == list(range(len(sequences)))
    full, rest = divmod(total, capacity)
    left = sorted((s for s in sizes if s != capacity), reverse=True)
    assert sizes.count(capacity) == full
    assert left == ([1 << b for b in reversed(range(13)) if rest >> b & 1] if tail == "powers" else [rest] * (rest > 0))


def test_sequences_and_boundaries(docs):
    scratch = Scratch(docs.sparkSession, "test")
    packed = scratch.save(concatenation.pack(docs.select("doc_id", "text"), capacity=256), "packed")
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r["sequence_id"], []).append(r)
    got = concatenation.sequences(packed).collect()
    assert {r["sequence_id"] for r in got} == set(pieces)
    for r in got:
        own = sorted(pieces[r["sequence_id"]], key=lambda p: p["offset"])
        assert r["ids"] == np.concatenate([np.frombuffer(bytes(p["ids"]), "<i4") for p in own]).tolist()
        assert [(b["offset"], b["length"], b["document"], b["start"], b["goes_on"]) for b in r["boundaries"]] == [(p["offset"], p["length"], p["doc_id"], p["start"], p["start"] + p["length"] < p["doc_tokens"]) for p in own]


def test_report_of_pieces(docs, spark, rows):
    got = concatenation.report(docs)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    encode = packing.encoder(packing.default_tokenizer()).tokenizer
    texts = {}
    for d, t in rows:
        texts.setdefault(d, set()).add(np.array([*encode.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    for r in got.collect():
        assert any(zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] and len(ids) == 4 * r["doc_tokens"] for ids in texts[r["doc_id"]])
    assert concatenation.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        concatenation.pack(docs, capacity=100)


# --- whitening ----------------------------------------------------------------------------------


def fixed(vectors):
    return np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(7, [float(x) for x in base[7]]), (None, [float(x) for x in base[3]])]
    odd = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "n": F.lit(2), "key": F.lit("k"), "component": F.lit(0)}).repartition(5)
    got = whitening.report(df).collect()
    x = fixed([v for _, v in rows])
    n, s = len(x), x.sum(0)
    y = x - s / n
    cov = y.T @ y / n
    values, parts = np.linalg.eigh(cov)
    values, parts = values[::-1], parts[:, ::-1]
    assert len(got) == n * 12
    deviation = {(i, tuple(r)): int(((n * r - s) ** 2).sum()) for (i, _), r in zip(rows, x, strict=True)}
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["identity_error"] < 1e-9 and abs(r["explained"] - values[r["component"] - 1] / np.trace(cov)) < 1e-12
    want = sorted(deviation.values()) + []
    assert set(want) == {r["deviation"] for r in got}
    for k in range(1, 13):
        z = y @ parts[:, k - 1] / math.sqrt(values[k - 1])
        # two rows have one id: compare as multisets of (deviation, value up to the component's sign)
        own = sorted((r["deviation"], r["whitened"]) for r in by[k])
        sign = np.sign(sum(w * v for (_, w), v in zip(own, [b for _, b in sorted(zip([deviation[(i, tuple(r))] for (i, _), r in zip(rows, x, strict=True)], z, strict=True))], strict=True)))
        mine = sorted(zip([deviation[(i, tuple(r))] for (i, _), r in zip(rows, x, strict=True)], sign * z, strict=True))
        assert [a for a, _ in own] == [a for a, _ in mine] and np.allclose([b for _, b in own], [b for _, b in mine], atol=1e-9)


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.report(spark.createDataFrame([], schema)).count() == 0
    assert whitening.report(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    assert whitening.report(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], schema)).count() == 0
    got = whitening.report(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], schema)).collect()
    assert len(got) == 9 and all(r["component"] == 1 and abs(r["explained"] - 1) < 1e-9 for r in got)
    wide = [(i, [random.Random(i * 50 + j).random() for j in range(40)]) for i in range(100)]
    got = whitening.report(spark.createDataFrame(wide, schema)).collect()
    assert max(r["component"] for r in got) == 32 and len(got) == 3200


def test_whitening_is_exact_beyond_64_bits(spark):
    big = [(i, [1e30 * (i + 1), float(i * i)]) for i in range(5)]
    got = {(r["vec_id"], r["component"]): r for r in whitening.report(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()}
    assert got and all(r["deviation"] is None for r in got.values())
    some = [(i, [2.0**20 * (i % 3), float(i)]) for i in range(50)]
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in some]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((50 * c - t) ** 2 for c, t in zip(r, s, strict=True)) for (i, _), r in zip(some, x, strict=True)}
    for r in whitening.report(spark.createDataFrame(some, "vec_id long, embedding array<double>")).collect():
        assert r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 1 << 63 else None)
    assert whitening._floor(-1e300) == -64 * int(1e300)


# --- resampling ---------------------------------------------------------------------------------


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features(text):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def expected(rows, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, text in rows:
        for f in features(text):
            s[bucket(f)] += 1
    for text in target:
        for f in features(text):
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for d, text in rows:
        f = features(text)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words_of(text)) >= least])
    order = sorted((i for i, r in enumerate(out) if r[4]), key=lambda i: (-out[i][3], -1 if out[i][0] is None else out[i][0]))
    rank = {i: k + 1 for k, i in enumerate(order[: percent * len(order) // 100])}
    return [(*r[:4], rank.get(i)) for i, r in enumerate(out)]


def same(got, want):
    key = lambda r: [(x is None, x or 0) for x in r]
    return sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


TARGET = ["w1 w2 w3 w4", None, "", "W7 w8 w9, w10"]


@pytest.mark.parametrize("chunk", [64, 1000, 1 << 16])
def test_resampling_against_brute_force(docs, spark, rows, chunk):
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, kept int")
    got = resampling.report(docs, target, chunk=chunk, percent=20).collect()
    assert same(got, expected(rows, TARGET, percent=20))


def test_resampled_documents(docs, spark, rows):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resampling.resample(docs, target, percent=30)
    assert got.columns == docs.columns
    want = sorted((str(r[0]) for r in expected(rows, TARGET, percent=30) if r[4]))
    assert sorted(str(r["doc_id"]) for r in got.collect()) == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.report(empty, target).count() == 0
    assert same(resampling.report(docs, empty.select("text")).collect(), expected(rows, []))


def test_one_id_in_many_rows_is_ranked_over_many_tasks(spark):
    """Rows that tie in everything part by number."""
    rows = [(5, " ".join("abcdefghij" * 3))] * 400
    got = resampling.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), spark.createDataFrame([("a b",)], "text string"), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 201)) and len(got) == 400


@pytest.mark.parametrize("size", [1, 5, 64, 4096, 10_000])
def test_chunks_own_each_start_once(size):
    text = ("  héllo, wörld 12" * 300 + " " + "é" * 4000 + ".a b c  ").encode()
    data = np.frombuffer(text, np.uint8)
    at, starts = 0, []
    whole = resampling.Runs(pa.array([text.decode()]), None, 3, 10_000)
    times = np.zeros(10_000, np.int64)
    for start, cut, end in resampling.chunks(data, size, 2):
        assert start == at and cut <= end
        part = text[start:end].decode()
        times += resampling.Runs(pa.array([part]), np.array([cut - start]), 3, 10_000).times(10_000)
        starts.append(start)
        at = cut
    assert at == len(data) and (times == whole.times(10_000)).all()


def test_checksums_of_any_length():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 20_000, dtype=np.uint8)
    first = rng.integers(0, 10_000, 300)
    end = first + np.concatenate([np.arange(150), rng.integers(0, 10_000, 150)])
    c = resampling.checksums(data, first, end)
    assert c.tolist() == [zlib.crc32(data[a:b]) for a, b in zip(first, end, strict=True)]
    other = resampling.checksums(data, end, np.minimum(end + (end - first), len(data)))
    size = np.minimum(end + (end - first), len(data)) - end
    assert (resampling.shifted(c, size) ^ other).tolist() == [zlib.crc32(data[b : b + n], zlib.crc32(data[a:b])) for a, b, n in zip(first, end, size, strict=True)]

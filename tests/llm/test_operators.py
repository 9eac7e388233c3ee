"""Each operator against brute force on small tables with nulls, copies, empty and long texts."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from eddyscale.llm import chat, decontamination, graph, html_extraction, jaccard_join, language_id, line_dedup, nearest, packing, quality, queries, sharding
from eddyscale.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    passage = words(rng, 60)
    for i in range(90):
        text = "\n".join(words(rng, rng.choice([3, 8, 30])) for _ in range(rng.randrange(1, 6)))
        if i % 5 == 0:
            text += "\n" + passage
        out.append([i * 3, text, "en", f"src{i % 4}", None])
    base = out[7][1].split(" ")
    for i in range(12):  # near copies
        w = list(base)
        w[rng.randrange(len(w))] = f"x{i}"
        out.append([1000 + i, " ".join(w), "de", "src0", 5])
    out += [[2000 + i, out[9][1], "fr", "src0", 1] for i in range(8)]
    out += [[3000, None, None, None, None], [3001, "", "en", "", 0], [3002, " \n\t ", "en", "a", 3], [3003, "One", "en", "a", 3], [3004, "one", "xx", "é", 3]]
    out += [[3005, words(rng, 9000), "en", "a", 1], [None, out[9][1], "en", "a", 1], [3006, "É ñ ß It's  «ok» don't 12 3½ <|endoftext|> x\r\ny", None, "a", 1], [3003, "One", "en", "a", 3]]
    out += [[3007, "A short line here\n  a SHORT line here \n\nA short line here", "en", "a", 1], [3008, "x\nA Short Line Here\t\ny", "en", "a", 1]]
    return [tuple(r) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({"batch": F.lit("clash"), "items": F.lit(1), "key": F.lit(2), "n": F.lit(3)}).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_automaton_against_all_substrings():
    rng = random.Random(1)
    for _ in range(60):
        items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 9)))) for k in range(rng.randrange(0, 5))]
        text = " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 30)))
        window = rng.choice([1, 3, 5])
        matcher = decontamination.Matcher(items, window)
        spans, found, longest = matcher.scan(decontamination.words(text))
        want = decontamination.brute(text, items, window)
        assert sum(b - a for a, b in spans) == want[1] and len(found) == want[2]
        t = text.split()
        subs = {tuple(b.split()[i:j]) for _, b in items for i in range(9) for j in range(i + 1, 10) if b.split()[i:j]}
        best = max([j - i for i in range(len(t)) for j in range(i + 1, len(t) + 1) if tuple(t[i:j]) in subs], default=0)
        assert longest == best if best >= matcher.shortest > 0 else longest <= best


def test_decontamination(spark, docs, rows):
    items = [(1, rows[3][1][:200]), (2, None), (3, ""), (4, "ONE"), (None, rows[8][1]), (5, rows[40][1]), (5, rows[40][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((r[0], *decontamination.brute(r[1], items)) for r in rows), key=str)
    assert table(decontamination.report(docs, bench)) == want
    chunked = decontamination.contamination(docs.select("doc_id", "text"), bench, chunk_words=20)
    assert sorted((r["doc_id"] or -1, r["n_hit"], r["items"]) for r in chunked.collect()) == sorted((r["doc_id"] or -1, r["n_hit"], r["items"]) for r in decontamination.contamination(docs.select("doc_id", "text"), bench).collect())
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)
    assert decontamination.cut("a, B c! d", [(1, 3)]) == "a, ! d"
    cut = decontamination.decontaminate(docs, bench, mode="cut", chunk_words=20)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert {r["n_hit"] for r in decontamination.report(cut, bench).collect()} == {0}


def test_decontamination_of_nothing(spark, docs, none, rows):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r["contaminated"] for r in decontamination.report(docs, empty).collect()} == {False}
    assert decontamination.report(none, empty).count() == 0


def lines_kept(rows, least=10):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if doc is not None:
                holders[key(line)].add(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or not holders[key(x)] or doc is not None and doc == min(holders[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 4), (5, 2)])
def test_line_dedup(docs, rows, none, batches, fanout):
    assert table(line_dedup.report(docs, batches=batches, fanout=fanout)) == lines_kept(rows)
    assert line_dedup.report(none).count() == 0


def run_of(runs, name, hashes):
    frame = runs.spark.createDataFrame(hashes, "h1 long, h2 long")
    return name, runs.write(frame.repartition(runs.buckets, "h1", "h2"), name)


def test_runs_are_levelled(spark):
    runs = line_dedup.LevelledRuns(Scratch(spark, "t"), fanout=2)
    for k in range(5):
        runs.add(*run_of(runs, f"r{k}", [(k, k), (100 + k, -k)]))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted(len(r.collect()) for r in runs.runs()) == [2, 8]
    known = runs.split(spark.createDataFrame([(3, 3), (9, 9), (104, -4)], "h1 long, h2 long")).collect()
    assert {(r["h1"], r["known"]) for r in known} == {(3, True), (9, False), (104, True)}


def test_runs_are_neither_shuffled_nor_sorted_again(spark, capsys):
    runs = line_dedup.LevelledRuns(Scratch(spark, "t"), fanout=9)
    for k in range(3):
        runs.add(*run_of(runs, f"r{k}", [(k * 1000 + i, i) for i in range(100)]))
    with line_dedup._merging(spark):
        runs.split(spark.createDataFrame([(3, 3)], "h1 long, h2 long").groupBy("h1", "h2").count()).explain()
        probe = capsys.readouterr().out
        runs.merged(*runs.runs()[:2]).explain()
        merge = capsys.readouterr().out
    assert probe.count("Exchange hashpartitioning") == 1 and probe.count("+- Sort [") <= 1 and probe.count("SortMergeJoin") == 3
    assert "Exchange" not in merge and "Sort [" not in merge and merge.count("SortMergeJoin") == 1


def test_hilbert_neighbours():
    for dims, bits in ((2, 3), (3, 2)):
        index = sharding.hilbert_table(dims, bits)
        at = sorted(range(len(index)), key=index.__getitem__)
        assert sorted(index) == list(range(len(index)))
        point = lambda c, dims=dims, bits=bits: [(c >> (bits * d)) & ((1 << bits) - 1) for d in range(dims)]
        assert all(sum(abs(a - b) for a, b in zip(point(x), point(y), strict=True)) == 1 for x, y in zip(at, at[1:], strict=False))


def test_sharding(docs, rows, none, spark, tmp_path):
    got = sharding.report(docs).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((r[0] or -1, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    curve = [r["curve"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert curve == sorted(curve)
    assert sharding.report(none).count() == 0
    assert {r["shard"] for r in sharding.report(docs.limit(5)).collect()} == set(range(5))
    sharding.write_shards(docs, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def test_strings_that_begin_alike_part(spark):
    """Values beyond any prefix: every one of sixteen equally frequent strings has a level of its own."""
    names = [f"https://www.example.org/a/very/long/common/beginning/{i:02d}" for i in range(16)]
    df = spark.createDataFrame([(i, names[i % 16]) for i in range(640)] + [(900, None)], "doc_id long, source string")
    found = sharding.hilbert_order(df, ["doc_id", "source"], ["source"], bits=4).collect()
    levels = defaultdict(set)
    for r in found:
        levels[r["source"]].add(r["curve"])
    assert all(len(v) == 1 for v in levels.values()) and len({min(v) for k, v in levels.items() if k}) >= 15
    order = [min(levels[n]) for n in names]
    assert order == sorted(order) and min(levels[None]) == 0


def test_equal_texts_stay_together(spark):
    """In one cell, equal texts are neighbours, so all but the few groups at a shard's end keep whole."""
    rng = random.Random(5)
    texts = [words(rng, 20) for _ in range(100)]
    got = sharding.report(spark.createDataFrame([(i, texts[rng.randrange(100)], "en", "s", 1) for i in range(1200)], DOCS).repartition(4)).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r["size"], r["text_crc32"]].add(r["shard"])
    assert sum(len(v) > 1 for v in groups.values()) <= 23


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want, got = [], packing.report(docs).collect()
    for doc, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(doc, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        end = 0
        for at, n in sorted(p):
            assert at == end
            end += n
        assert end <= 2048
    assert len(places) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert packing.report(none).count() == 0


def test_sums_are_those_that_counts_allow():
    rng = random.Random(9)
    for _ in range(200):
        left = [0] + [rng.choice([0, 0, 1, 2]) for _ in range(12)]
        sums = packing.Sums(left, 12)
        for _ in range(6):
            total = rng.randrange(2, 13)
            assert list(sums.pairs(total)) == [a for a in range(total - 1, 0, -1) if 2 * a >= total and left[a] > (2 * a == total) and left[total - a]]
            assert {x for x in range(1, total) if 3 * x >= total and left[x] and list(sums.pairs(total - x))} <= set(sums.firsts(total))
            x = rng.randrange(1, 13)
            left[x] = max(0, left[x] - 1)  # counts only fall


def test_plan_uses_up_every_length():
    rng = random.Random(2)
    for capacity in (7, 16, 64):
        for _ in range(20):
            counts = {x: rng.randrange(0, 30) for x in range(1, capacity + 1)}
            used = defaultdict(int)
            for pattern, n in packing.plan(counts, capacity):
                assert sum(pattern) <= capacity and n > 0
                for x in pattern:
                    used[x] += n
            assert all(used[x] == n for x, n in counts.items())
    assert packing.plan({5: 1, 3: 1, 2: 2}, 10) in ([((5, 3, 2), 1), ((2,), 1)], [((5, 3, 2), 1), ((2,), 1)])
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def components_of(rows):
    sets = {}
    for doc, text, *_ in rows:
        w = (text or "").encode().lower().split()
        if doc is not None:
            sets[doc] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return sets, {d: find(d) for d in sets}, links


def test_jaccard_join(docs, rows, none):
    sets, find, links = components_of(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.report(docs).collect()}
    assert got.pop(None) [1] is None
    assert got == {d: (len(sets[d]), find[d]) for d in sets}
    assert jaccard_join.report(docs).count() == len(rows)
    join = jaccard_join.Join(docs)
    least = {}
    for d in sorted(sets):
        least.setdefault(sets[d], d)
    assert {tuple(r) for r in join.links().collect()} == {(a, b) for a, b in links if least[sets[a]] == a and least[sets[b]] == b}
    assert jaccard_join.report(none).count() == 0
    kept = jaccard_join.near_copies_dropped(docs)
    assert {r["doc_id"] for r in kept.collect()} == {None} | set(find.values()) and kept.columns == docs.columns


@pytest.mark.parametrize("seed", range(2))
def test_small_sets_meet(spark, seed):
    """Sets of a few to forty shingles, many at the border of 0.8, both kinds of keys."""
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        base = [f"v{rng.randrange(9)}" for _ in range(rng.randrange(4, 45))]
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randrange(0, 2)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], ["z"], ["y", "y"]])
            rows.append((len(rows), " ".join(w)))
    sets, find, _ = components_of(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {d: (len(sets[d]), find[d]) for d in sets}


def test_prefix_keys_meet_at_any_boundary():
    rng = np.random.default_rng(0)
    order = (np.sort(rng.integers(0, 1 << 63, 4).astype(np.uint64)), np.array([5, 9, 9, 2]))
    for _ in range(400):
        n = int(rng.integers(4, 60))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.1], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 8))).astype(np.uint64), order[0][:2]]))
        x = np.unique(np.concatenate([x, order[0][:2]]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            for light in (3, 8, 20, 100):
                a, b = (jaccard_join.keys_of(s, order, light)[0] for s in (x, y))
                assert len(np.intersect1d(a, b))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def test_quality_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF[:-5]}0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = [r for r in quality.report(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got]) > 0.95


def test_quality_of_odd_rows(spark, docs, rows, none):
    labels = spark.createDataFrame([(i * 3, i % 2, 0) for i in range(40)] + [(None, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.report(docs, labels).count() == len(rows)
    assert {r["score"] for r in quality.report(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.report(none, labels).count() == 0
    assert quality.accepted(docs, labels).columns == docs.columns


def described(text):
    """(letters, shape) of each word, by regular expressions."""
    import re

    out = []
    for word in (text or "").encode().split():
        word = word.decode()
        core = re.search(r"[A-Za-z0-9_\u0080-\U0010ffff](?:.*[A-Za-z0-9_\u0080-\U0010ffff])?", word, re.S)
        low = "".join(c.lower() if c < "\u0100" and c != "×" else c for c in (core[0] if core else word))
        upper, lower = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
        shape = re.sub(rf"([{upper}]{{2,}})|([{upper}])|([{lower}]+)|([0-9]+)", lambda m: ("W", "X", "x", "9")[m.lastindex - 1] + "\0", word)
        out.append((low, shape))
    return out


def buckets(text):
    import pyarrow as pa

    found = quality.Describer().words(pa.array([text], pa.string()))
    return found.letters.tolist(), found.shapes.tolist()


def test_letters_and_shapes():
    rng = random.Random(3)
    letters, shapes = {}, {}
    alphabet = ["a", "b", "Z", "Q", "É", "ß", "÷", "×", "7", "0", "_", "-", "!", "日", "ÿ", "Þ", " ", "\n"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))
        a, b = buckets(text)
        assert len(a) == len(described(text))
        for (low, shape), x, y in zip(described(text), a, b, strict=True):
            assert letters.setdefault(low, x) == x and shapes.setdefault(shape, y) == y, (text, low, shape)
    # other words, other buckets, as far as there are buckets
    assert len(set(letters.values())) > 0.6 * min(len(letters), quality.BUCKETS / 2) and len(set(shapes.values())) > 0.5 * min(len(shapes), quality.BUCKETS / 2)


def test_contexts_are_of_all_documents(spark, docs, rows):
    """Against a sum word by word, and the fitted vectors don't depend on which documents have labels."""
    index = np.sign(quality.index_vectors())
    want = np.zeros((quality.BUCKETS, quality.WIDTH))
    for _, text, *_ in rows:
        a, b = buckets(text)
        for i in range(len(a)):
            for j in range(max(0, i - quality.NEAR), min(len(a), i + quality.NEAR + 1)):
                if i != j:
                    for x in (a[i], b[i]):
                        want[x] += index[a[j]] + index[b[j]]
    assert (quality.contexts(docs) == want).all()
    labels = spark.createDataFrame([(3, 1), (9, 0)], "doc_id long, quality int")
    assert np.allclose(quality.fit(docs, labels)[0], quality.vectors(want))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": [r[1] for r in rows]})
    (folded,) = quality._contexts(fold_at=1)(iter([batch, batch]))
    assert (np.frombuffer(folded.column(0)[0].as_py(), np.int64).reshape(want.shape) == 2 * want).all()


def test_descriptions_against_each_text(rows):
    """Whole columns, cut anywhere, give what text by text gives."""
    import pyarrow as pa

    texts = [r[1] for r in rows] + ["naïve É\u00a0x\n\n日本 語", "x"]
    describe, small = quality.Describer(), quality.Describer()
    small.hasher.chunk = 50
    column = pa.array(["skipped"] + texts, pa.string()).slice(1)
    share, form = describe(column)
    for got, want in zip(small(column), (share, form), strict=True):
        assert (got == want).all()
    for i, text in enumerate(texts):
        a, b = buckets(text)
        want = (np.bincount(a, minlength=quality.BUCKETS) + np.bincount(b, minlength=quality.BUCKETS)) / max(1, len(a))
        assert np.allclose(share[i], want, atol=1e-6)
        if a:
            n, lines = len(a), text.count("\n") + 1
            assert np.allclose(form[i][[0, 5, 6, 7]], [np.log1p(n), np.log1p(n / lines), len(text) / n / 10, np.log1p(lines)], atol=1e-5)
        else:
            assert not form[i].any()


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 6))
    p = 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))
    y = (rng.random(1500) < p).astype(float)
    net = quality.train(x, y)
    assert np.mean(np.abs(net(x) - p)) < 0.12 and 0.25 <= net.temperature <= 8


@pytest.mark.parametrize("options", [{}, {"lists": 1, "bits": 1}])
def test_nearest(spark, options):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:400] = x[100]  # one vector that a third of all rows share
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(950, None), (1000, [0.0] * 16), (1050, [1.0, float("nan")] + [0.0] * 14), (1100, [None] + [1.0] * 15), (1150, [1.0]), (None, [1.0] * 16), (1200, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in nearest.report(vectors, **options).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    z = x.astype(np.float64)
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    hits = total = 0
    assert sorted(got) == list(range(0, 900, 50))
    for q, found in got.items():
        like = np.round(u @ u[q], 12)
        like[q] = -9
        best = np.lexsort((np.arange(900), -like))[:5]
        assert len(found) == 5 and all(abs(s - u[v] @ u[q]) < 1e-12 for v, s in found)
        hits += len(set(best.tolist()) & {v for v, _ in found})
        total += 5
    assert hits / total >= 0.9


def test_nearest_of_few(spark):
    kind = "vec_id long, embedding array<float>"
    assert nearest.report(spark.createDataFrame([], kind)).count() == 0
    assert [tuple(r)[:3] for r in nearest.report(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], kind)).collect()] == [(0, 1, 1)]


def test_recall_on_supplied_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    ids = np.array([r["vec_id"] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = {q: set(ids[np.argsort(-np.where(ids == q, -9, u @ u[ids == q][0]))[:5]].tolist()) for q in ids[ids % 50 == 0]}
    index = nearest.Index(vectors)
    for sure, least in ((2.5, 0.99), (None, 1.0)):
        got = defaultdict(set)
        for r in index.search(vectors.where("vec_id % 50 = 0"), sure=sure).collect():
            got[r["query_id"]].add(r["vec_id"])
        assert sum(len(got[q] & b) for q, b in best.items()) >= least * 5 * len(best)
        assert sure is None or index.share_scored() < 0.05
    with pytest.raises(ValueError):
        index.search(vectors, k=6)


def test_bound_holds():
    """No vector passes the bound of Cauchy and Schwarz, and few pass the other."""
    rng = np.random.default_rng(5)
    x, q = nearest.unit(rng.normal(size=(500, 24)) + 0.5), nearest.unit(rng.normal(size=(40, 24)) + 0.5)
    c, turn = nearest.centres(x, 4), nearest.rotations(24, 3)
    own = nearest.nearest_centre(x, c)
    bits, scale, spread, bias = nearest.encode(x, own, c, turn)
    z = (np.unpackbits(bits, axis=1, count=72) * 2.0 - 1) / np.sqrt(72)
    guess = (q @ c.T)[:, own] + (q @ turn) @ z.T * scale - bias
    off = np.abs(guess - q @ x.T) / (np.linalg.norm(q[:, None] - c[None], axis=2)[:, own] * spread)
    assert off.max() <= 1 + 1e-9 and np.mean(off > 2.5 / np.sqrt(23)) < 0.03


def test_chat(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"), (2, 0, None, "x"), (2, 600, "eve", "y"), (None, None, "eve", "z")]
    turns += [(3, i, ["ann", "bob", "system", "c d"][i % 4], f"turn {i}") for i in range(1500)] + [(3, -5, "ann", "before"), (3, None, "zoe", "when?")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = table(chat.report(df))
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    plain = lambda rows: sorted(((*r[:5], list(r[5]), list(r[6]), *r[7:]) for r in rows), key=str)
    assert plain(got) == plain(con.sql(chat.ORACLE).fetchall())
    one = next(r for r in got if r[:2] == (1, "ann"))
    assert [one[4][a:b] for a, b in zip(one[5], one[6], strict=True)] == ["hi < |im_end|><|im_end|>", "bye<|im_end|>", "bye<|im_end|>"]
    assert "user name=bob\n<|im_end|>" in one[4]
    # a conversation of several parts is one rendering, and its spans are those of the whole
    for speaker in ("ann", "bob", "c d", "zoe"):
        parts = sorted((r for r in got if r[:2] == (3, speaker)), key=lambda r: r[2])
        assert [r[2] for r in parts] == [-1, 0, 1, 2]
        ordered = sorted((t for t in turns if t[0] == 3), key=lambda t: (-1 if t[1] == -5 else (t[1] or 0) // 512, t[1] is not None, t[1] or 0, t[2], t[3]))
        text, starts, ends = chat.render([{"role": t[2], "text": t[3]} for t in ordered], speaker)
        assert "".join(r[4] for r in parts) == text and [x for r in parts for x in r[5]] == starts and [x for r in parts for x in r[6]] == ends
        assert all(r[3] == sum(len(x[4]) for x in parts[:i]) for i, r in enumerate(parts))
    assert chat.report(df.limit(0)).count() == 0
    odd = df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(("part", "starts", "speakers", "c", "p", "s"))))
    assert table(chat.report(odd)) == got


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x="</p>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home {0}</a></ul></nav><div class="cookie-notice">We use cookies</div>
{1}<aside>More</aside><div id="comments"><p>nice {0}</p></div><footer>&copy; {0}</footer>"""


def test_html(spark):
    art = '<article class="post comments-open"><h1>Tit&amp;le {0}</h1><p>One<b> bold</b>\n text {0}<br>more<p>Two <script>no</script>&nbsp;é<div class=share>Share {0}</div><p class=x>Same</p></article>'
    div = '<div id="content"><h1>Head {0}</h1><p>Para {0}<ul><li>a<li>b {0}</ul></div><div class="box"><a href=x>l1</a> <a href=y>l2</a></div><p>Always here</p>'
    rows = [(i, f"http://a.org/{i}", PAGE.format(i, art.format(i))) for i in range(8)] + [(20 + i, f"https://b.org:80/{i}?x", PAGE.format(i, div.format(i))) for i in range(8)]
    rows += [(40 + i, "http://c.org/", PAGE.format(i, art.format(7))) for i in range(8)]  # one article, again and again
    rows += [(60, None, None), (61, "x", ""), (62, "x", "plain < text & more"), (63, "x", "<p>un<p>closed <a href='>'>q</a"), (64, "x", "<article>" + "<p>w</p>" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in html_extraction.report(df).collect()}
    assert got[3] == "Tit&le 3\nOne bold text 3 more\nTwo é", got[3]
    assert got[42] == "Tit&le 7\nOne bold text 7 more\nTwo é\nSame"
    assert got[25] == "Head 5\nPara 5\na\nb 5"
    assert got[60] == got[61] == "" and got[62] == "plain < text & more" and got[63] == "un\nclosed q" and got[64] == "\n".join(["w"] * 3000)
    assert html_extraction.report(df.limit(0)).count() == 0


def test_html_keeps_blocks_of_few_articles(spark):
    """Copies of a page, under one tree or several, are one article; so few articles that have a node are no template."""
    art = "<article><h1>Title {0}</h1><p>Text {0}</p>{1}<p class=x>Same</p></article>"
    pages = [(i, f"http://a.org/{i}", PAGE.format(i, art.format(i, ""))) for i in range(30)]
    pages += [(100 + i, f"http://a.org/copy/{i}", PAGE.format(i, art.format("c", "<blockquote>Only here</blockquote>"))) for i in range(6)]
    pages += [(200 + i, f"http://a.org/tree/{i}", PAGE.format(i, art.format("d", "<h3>Once</h3>" + "<hr>" * (i % 2) + f"<section class={'abcdef'[i]}></section>"))) for i in range(6)]
    pages += [(300 + i, f"http://a.org/few/{i}", PAGE.format(i, art.format(f"f{i}", "<ul><li>Few</ul>"))) for i in range(6)]
    pages += [(400, "http://a.org/same", PAGE.format(0, art.format("g", "<h4>Again</h4>")))] * 6  # repeated rows
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in html_extraction.report(df).collect()}
    assert got[3] == "Title 3\nText 3"
    assert {got[100 + i] for i in range(6)} == {"Title c\nText c\nOnly here"}
    assert {got[200 + i] for i in range(6)} == {"Title d\nText d\nOnce"}
    assert got[302] == "Title f2\nText f2\nFew" and got[400] == "Title g\nText g\nAgain"
    # where most articles have it, it is template
    assert {r["text"] for r in html_extraction.report(df.where("page_id between 300 and 305")).collect()} == {f"Title f{i}\nText f{i}" for i in range(6)}


def tree_of(nested):
    """(parents, labels) in preorder of nested (label, children)."""
    parents, labels = [-1], [""]

    def walk(children, up):
        for label, below in children:
            parents.append(up)
            labels.append(label)
            walk(below, len(labels) - 1)

    walk(nested, 0)
    return parents, labels


def most_pairs(one, other):
    """The most nodes that any order-preserving matching of two forests pairs, by trying all."""
    if not one or not other:
        return 0
    (a, x), (b, y) = one[0], other[0]
    both = 1 + most_pairs(x, y) + most_pairs(one[1:], other[1:]) if a == b else 0
    return max(both, most_pairs(one[1:], other), most_pairs(one, other[1:]))


def test_tree_matching():
    rng = random.Random(6)

    def grow(depth):
        return [(rng.choice("ab"), grow(depth - 1)) for _ in range(rng.randrange(0, 4))] if depth else []

    for _ in range(150):
        one, other = grow(3), grow(3)
        x, y = tree_of(one), tree_of(other)
        pairs = html_extraction.align(x, y)
        assert len(pairs) == 1 + most_pairs(one, other)
        for a, b in pairs.items():
            assert x[1][a] == y[1][b] and (a == 0 or pairs[x[0][a]] == y[0][b])
        assert list(dict(sorted(pairs.items())).values()) == sorted(pairs.values())


def test_records_fold():
    page = html_extraction.Page("<div><ul><li>a<li>b<li>c</ul></div><div><p>x</div><div><ul><li>d</ul></div>")
    assert page.labels == ["", "div", "ul", "li", "div", "p"] and page.parents == [-1, 0, 1, 2, 0, 4]
    assert [(b.node, b.text) for b in page.blocks] == [(3, "a"), (3, "b"), (3, "c"), (5, "x"), (3, "d")]


BARE = "<body><div><ul><li><a href=/>Home {0}</a></ul></div><div>Buy {0} now</div><div><h1>Title {0}</h1><p>{1}<p>{1}</div><div>Site of all</div></body>"


def test_wrapper_alone_decides(spark):
    """Neither an article nor a class tells what is what; the place of the varying text does."""
    rng = random.Random(8)
    texts = [words(rng, 60) for _ in range(12)]
    rows = [(i, f"http://a.org/{i}", BARE.format(i, texts[i])) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_extraction.report(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: f"Title {i}\n{texts[i]}\n{texts[i]}" for i in range(12)}
    # by its tags alone a page can't be read so
    alone = {r["page_id"]: r["text"] for r in html_extraction.report(spark.createDataFrame(rows[:1], "page_id long, url string, html string")).collect()}
    assert alone[0] == f"Buy 0 now\nTitle 0\n{texts[0]}\n{texts[0]}\nSite of all"


def test_supplied_pages_without_telling_tags(spark):
    """With articles, menus, adverts and footers as plain div elements the wrappers find the same texts."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    bare = F.regexp_replace(F.regexp_replace("html", "(</?)(article|nav|footer)", "$1div"), '<div class="ad">', "<div>")
    want = {r["page_id"]: r["text"] for r in html_extraction.report(pages).collect()}
    got = {r["page_id"]: (r["url"], r["text"]) for r in html_extraction.report(pages.withColumn("html", bare)).collect()}
    hosts = defaultdict(list)
    for page, (url, text) in got.items():
        hosts[html_extraction.host_of(url)].append(text == want[page])
    large = [same for v in hosts.values() if len(v) >= 20 for same in v]
    assert len(large) > 1000 and np.mean(large) > 0.9


def test_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    rows = [(i, f"http://h.org/{i}", f"<p>y {i}" + "<div>" * i + deep) for i in range(4)] + [(9, "http://h.org/", "<b>" * 20_000 + "<p>z" * 2000), (10, "http://g.org/", "</i>" * 50_000 + "w " * 500_000)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extraction.report(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()}
    assert got[1][0] == "y 1\nx" and got[9][0] == "\n".join(["z"] * 2000) and got[10][1] == 999_999


def test_kept_columns_of_any_name(spark):
    names = ["host", "tree", "kept", "blocks", "article", "fixed", "inside", "tagged", "parents", "labels", "slots", "text", "a b`c"]
    df = spark.createDataFrame([(i, "http://a.org/", f"<p>t{i}") for i in range(4)], "page_id long, url string, html string").select("*", *(F.concat(F.lit(n), "page_id").alias(n) for n in names))
    got = html_extraction.extract(df, keep=tuple(df.columns))
    assert got.columns == [c for c in df.columns if c != "text"] + ["text"]
    for r in got.collect():
        assert r["text"] == f"t{r['page_id']}" and all(r[n] == f"{n}{r['page_id']}" for n in names if n != "text")


def test_extraction_gives_back_the_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r, p in zip(*(sorted(x.collect(), key=lambda r: r["page_id"]) for x in (html_extraction.report(pages), pages)), strict=True):
        assert r["n_chars"] == len(r["text"]) and r["text"].count("\n") >= 1
        assert "\xa9" not in r["text"] and "track(" not in r["text"]


def test_language(spark):
    docs = spark.read.parquet(f"{SF[:-5]}0.01/documents.parquet")
    pages = spark.read.parquet(f"{SF[:-5]}0.01/pages.parquet")
    odd = spark.createDataFrame([(9001, None, None), (9002, "http://x.de/", ""), (9003, "http://y.org/fr/", '<html lang="fr"><p>la')], pages.schema)
    got = {r["page_id"]: r for r in language_id.report(pages.unionByName(odd), docs).collect()}
    said = {r["page_id"]: language_id.declared(r["html"]) for r in pages.collect()}
    assert np.mean([got[k]["lang"] == v for k, v in said.items()]) > 0.97
    assert got[9003]["lang"] == "fr" and got[9001]["lang"] == "en" and 0 < got[9001]["probability"] <= 1
    assert {r["lang"] for r in language_id.report(pages, docs.limit(0)).collect()} == {None}


def test_evidence_is_fused(spark):
    """Short texts, markup that is missing or wrong, and hosts that tell: the fusion against the text alone."""
    rng = random.Random(12)
    langs = ["de", "en", "fr"]
    vowels = {"de": "äöü", "en": "wth", "fr": "éèê"}
    say = lambda x, n, own: " ".join("".join(rng.choice(vowels[x] if rng.random() < own else "abcdefg") for _ in range(4)) for _ in range(n))
    docs = spark.createDataFrame([(i, say(langs[i % 3], 60, 0.3), langs[i % 3]) for i in range(300)], "doc_id long, text string, lang string")
    pages, truth = [], {}
    for i in range(600):
        x = langs[i % 3]
        said = [x, None, langs[(i + 1) % 3]][0 if i % 20 else 2] if i % 2 else None  # half is withheld, a tenth of the rest is wrong
        tag = f'<html lang="{said}">' if said else "<html>"
        truth[i] = x
        pages.append((i, f"http://{x}{i % 5}.example.org/", f"{tag}<p>{say(x, 1 + i % 3, 0.12)}</p>"))
    got = language_id.report(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4), docs).collect()
    right = np.mean([r["lang"] == truth[r["page_id"]] for r in got])
    alone = np.mean([r["text_lang"] == truth[r["page_id"]] for r in got])
    assert alone < 0.85 and right > alone + 0.1, (alone, right)


def test_declared_language_is_sought_in_the_whole_page():
    long = "x" * 9000
    assert language_id.declared(f"<!-- {long} --><html lang='fr'>") == "fr"
    assert language_id.declared(f'<html><head><style>{long}</style><meta http-equiv="Content-Language" content="de-AT">') == "de"
    assert language_id.declared(f'<html><head><script>{long}</script><meta content="es" http-equiv=content-language><body>') == "es"
    assert language_id.declared(f"<!-- <html lang=en> --><script>'<html lang=en>'</script>{long}<HTML class=a xml:lang=FRA>") == "fr"
    assert language_id.declared('<meta http-equiv="content-language" content="en"><html lang="de">') == "de"
    assert language_id.declared("<html><p>lang=en") is None and language_id.declared(None) is None


def test_rare_language_is_known(spark):
    """A language of one document in 5,000, whose id comes last in the order of hashes."""
    last = spark.range(5000).orderBy(F.xxhash64("id").desc()).first()[0]
    rows = [(i, "dette er en sjelden tekst" if i == last else "this is a frequent text", "no" if i == last else "en") for i in range(5000)]
    docs = spark.createDataFrame([*rows, (None, "x", "en"), (3, "x", None)], "doc_id long, text string, lang string")
    languages, model = language_id.fit(docs)
    assert languages == ["en", "no"] and model.shape == (2, language_id.BUCKETS)
    pages = spark.createDataFrame([(1, "http://a.org/", "<p>dette er en sjelden tekst"), (2, "http://b.org/", "<p>this is a frequent text")], "page_id long, url string, html string")
    assert {r["page_id"]: r["lang"] for r in language_id.report(pages, docs).collect()} == {1: "no", 2: "en"}
    for most in (10, 300):  # of each language the least hashes, however many there are
        names, chosen = language_id._chosen(docs, most, Scratch(spark, "t"))
        want = [r[0] for r in spark.range(5000).where(F.col("id") != last).orderBy(F.xxhash64("id")).limit(most).collect()]
        assert sorted(tuple(r) for r in chosen.collect()) == sorted([("en", i) for i in want] + [("no", last)])


#: Every column name that an operator or a stage uses within.
INNER = (
    "kept items n_words n_hit longest_match starts ends score drops n_lines n_dropped doc known owner last loose batch h1 h2 dropped component node key class"
    " n place hub piece start length ids_crc32 part nth rank before sequence_id offset shard curve size text_crc32 _doc_id _size up_to label x __doc __score __in0 html host"
).split()


def test_columns_of_any_name_come_back(spark, rows):
    import corpus_pipeline

    docs = spark.createDataFrame(rows, DOCS).select("*", *(F.concat_ws("/", F.lit(n), F.xxhash64("doc_id", "text").cast("string")).alias(n) for n in INNER))
    want = {(r["doc_id"], r["text"]): r for r in docs.collect()}
    labels = spark.createDataFrame([(i * 3, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, rows[3][1][:200])], "item_id long, text string")
    outs = {
        "quality": quality.accepted(docs, labels),
        "dedup": line_dedup.without_known_lines(docs),
        "counted": line_dedup.dedup_lines(docs),
        "join": jaccard_join.near_copies_dropped(docs),
        "drop": decontamination.decontaminate(docs, bench),
        "cut": decontamination.decontaminate(docs, bench, mode="cut"),
    }
    by_id = {r["doc_id"]: r for r in docs.where("doc_id is not null and doc_id <> 3003").collect()}
    for name, out in outs.items():
        extra = [c for c in out.columns if c not in docs.columns]
        assert [c for c in out.columns if c in docs.columns] == docs.columns, name
        assert extra == (["_n_lines", "_n_dropped"] if name == "counted" else [])
        seen = out.collect()
        assert seen, name
        for r in seen:
            if r["doc_id"] in by_id:
                assert all(r[n] == by_id[r["doc_id"]][n] for n in INNER), name
            if name in ("quality", "join", "drop"):
                assert tuple(r) == tuple(want[r["doc_id"], r["text"]])
    packed = packing.pack(docs, keep=tuple(docs.columns))
    assert packed.columns[: len(docs.columns)] == docs.columns and packed.columns[len(docs.columns) :] == ["_piece", "_start", "_length", "_ids_crc32", "_sequence_id", "_offset"]
    assert packed.count() >= len(rows)
    scored = quality.score(docs, quality.fit(docs, labels))
    assert scored.columns == [*docs.columns, "_score"]
    assert corpus_pipeline.new_lines(spark, docs, "").columns == docs.columns


def test_pipeline_stages_against_brute_force(spark, rows, tmp_path):
    """Stages 2 to 5 on what the classifier accepts, each against its brute-force version; odd rows included."""
    import corpus_pipeline

    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = [(1, rows[3][1][:300]), (2, rows[40][1]), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i * 3, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = corpus_pipeline.good(spark, docs, folder)
    scores = {(r["doc_id"], r["predicted"]) for r in quality.report(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    now = [tuple(r) for r in good.collect()]
    assert good.columns == docs.columns and all((r[0], 1) in scores for r in now)
    assert len(now) == quality.report(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").count()
    # line dedup
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    holders = defaultdict(set)
    for doc, text, *_ in now:
        for line in (text or "").split("\n"):
            if doc is not None:
                holders[key(line)].add(doc)
    lined = []
    for doc, text, *more in now:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or not holders[key(x)] or doc is not None and doc == min(holders[key(x)])]
        lost = len(kept) < len(lines)
        lined.append((doc, "\n".join(kept) if lost else text, *more[:2], len("\n".join(kept)) if lost else more[2]))
    frame = corpus_pipeline.new_lines(spark, good, folder)
    assert frame.columns == docs.columns and table(frame) == sorted(lined, key=str)
    # one of each component of near copies
    _, find, _ = components_of(lined)
    single = [r for r in lined if r[0] is None or find[r[0]] == r[0]]
    frame = corpus_pipeline.no_near_copies(spark, frame, folder)
    assert table(frame) == sorted(single, key=str)
    clean = [r for r in single if not decontamination.brute(r[1], items)[-1]]
    frame = corpus_pipeline.no_benchmark(spark, frame, folder)
    assert table(frame) == sorted(clean, key=str) and 0 < len(clean) < len(single) < len(lined)
    got = corpus_pipeline.packed(spark, frame, folder).collect()
    whole = corpus_pipeline.run(spark, folder).collect()
    pieces = lambda rows: sorted((r["doc_id"] or -1, r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert pieces(got) == pieces(whole) and {r["doc_id"] for r in got} == {r[0] for r in clean}
    assert all(sum(r["length"] for r in got if r["sequence_id"] == s) <= 2048 for s in {r["sequence_id"] for r in got})
    empty = str(tmp_path / "empty")
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_shapes_are_whole():
    assert buckets("a1" * 20)[1] != buckets("a1" * 20 + "-")[1]


def test_scratch_is_shared(spark):
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})  # noqa: N815

    from eddyscale.llm import common

    with pytest.raises(ValueError):
        common.scratch_root(Session())
    Session.sparkContext.master = "local[4]"
    assert common.scratch_root(Session()).startswith("file://")


def test_sql_agrees(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        ours = queries.QUERIES[name](spark, SF)
        theirs = con.sql(sql)
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert sorted(map(str, (tuple(r) for r in ours.select(*sorted(ours.columns)).collect()))) == sorted(map(str, theirs.project(", ".join(sorted(theirs.columns))).fetchall())), name

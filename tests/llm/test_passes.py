"""How often things are read: hashes of a batch, a benchmark's chunks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from eddyscale.llm import decontamination, line_dedup
from eddyscale.llm.common import Scratch


def words(rng, n, of=500):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    line = words(rng, 12)
    out = [(i, "\n".join([*(words(rng, 9) for _ in range(3)), line] if i % 3 == 0 else [words(rng, 9)])) for i in range(120)]
    return [*out, (200, None), (None, line), (7, out[7][1]), (201, line + "\n" + line)]


# --- line dedup ---------------------------------------------------------------------------------


def kept(rows):
    low = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(low(line)) >= 10:
                first[low(line)] = min(first.get(low(line), doc), doc)
    return sorted(((doc, sum(len(low(x)) >= 10 and low(x) in first and first[low(x)] != doc for x in (text or "").split("\n"))) for doc, text in rows), key=str)


def files_read(df) -> int:
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


@pytest.mark.parametrize("ordered", [True, False])
def test_a_batch_reads_its_own_hashes_only(spark, rows, ordered, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.repartitionByRange(5, "doc_id") if ordered else docs.repartition(5)
    saved = {}
    save = Scratch.save

    def noted(self, df, name, *args, **kwargs):
        saved[name] = save(self, df, name, *args, **kwargs)
        return saved[name]

    monkeypatch.setattr(Scratch, "save", noted)
    monkeypatch.setattr(line_dedup, "in_order", lambda *a, f=line_dedup.in_order: f(*a, most=1.9 if not ordered else 4.0))
    got = sorted(((r["doc_id"], r["n_dropped"]) for r in line_dedup.report(docs, batches=6).collect()), key=str)
    assert got == kept(rows)
    lines = saved["lines"]
    batches = sorted(r["batch"] for r in lines.select("batch").distinct().collect())
    files = [files_read(lines.where(F.col("batch") == b)) for b in batches]
    assert len(batches) >= 5 and sum(files) == files_read(lines) and max(files) < sum(files) / 2


def test_order_of_the_input_is_seen(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"))
    assert line_dedup.in_order(docs.repartitionByRange(8, "doc_id"), [250, 500, 750])
    assert not line_dedup.in_order(docs.repartition(8), list(range(100, 1000, 100)))
    assert line_dedup.in_order(docs.where("doc_id < 0"), [5])


# --- decontamination ----------------------------------------------------------------------------


def maps(df) -> int:
    return len(re.findall(r"^\W*(?:\(\d+\) )?MapInArrow", df._jdf.queryExecution().optimizedPlan().toString(), re.M))


@pytest.fixture(scope="module")
def benchmark():
    rng = random.Random(5)
    items = [(i, words(rng, rng.choice([4, 20, 40]), 60)) for i in range(80)]
    return [*items, (100, words(rng, 900, 60)), (None, words(rng, 20, 60)), (101, None)]


@pytest.fixture(scope="module")
def texts(benchmark):
    rng = random.Random(6)
    out = []
    for i in range(60):
        body = benchmark[rng.randrange(80)][1] if i % 3 else benchmark[80][1]
        w = body.split()
        at = rng.randrange(len(w))
        out.append((i, f"{words(rng, 30, 60)} {' '.join(w[at : at + 45])} {words(rng, 10, 90)}"))
    return out


@pytest.mark.parametrize(("chunk_words", "group", "passes"), [(60, 64, 1), (100_000, 16, 1), (200, 3, 4)])
def test_one_worker_for_any_number_of_chunks(spark, benchmark, texts, chunk_words, group, passes, monkeypatch):
    docs, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string")
    monkeypatch.setattr(decontamination._found, "__defaults__", (group,))
    found = decontamination.contamination(docs, items, chunk_words=chunk_words)
    assert maps(found) == 1  # the last pass; earlier ones have been written
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in found.collect()}
    for doc, text in texts:
        n, hit, *_ = decontamination.brute(text, benchmark)
        grams = lambda t, k: {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
        own = text.split()
        want = sorted(str(i) for i, t in benchmark if i is not None and t and grams(t.split(), min(13, len(t.split()))) & grams(own, min(13, len(t.split()))))
        assert got[doc] == (n, hit, want)


def test_an_automaton_is_arrays(benchmark):
    matcher = decontamination.Matcher(benchmark, 13)
    states = len(matcher.automaton.link)
    assert not matcher.automaton.next and len(matcher.automaton.branches) < states / 3
    assert matcher.automaton.symbol.itemsize == 4 and len(matcher.automaton.symbol) == states

"""Language identification against the posterior worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from eddyscale.llm import language_id
from eddyscale.llm.common import Scratch


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    letters = {"de": "aeinrsü", "en": "thewosd", "fr": "éèqulan"}
    say = lambda x, n: " ".join("".join(rng.choice(letters[x]) for _ in range(5)) for _ in range(n))
    docs = spark.createDataFrame([(i, say(x, 80), x, "clash") for i in range(90) for x in [sorted(letters)[i % 3]]], "doc_id long, text string, lang string, host string")
    pages = []
    for i in range(80):
        x = sorted(letters)[i % 3]
        tag = f"<html lang={x}>" if i % 4 == 0 else "<html lang=xx>" if i % 11 == 0 else "<html>"
        place = ["", "/fr/", "/de/"][i % 3 if i % 5 else 0]
        pages.append((i, f"http://{x}{i % 4}.example.{'de' if i % 7 == 0 else 'org'}{place}", f"{tag}<p>{say(x, 1 + i % 4)}</p>"))
    pages += [pages[3], pages[3], (500, None, None), (None, "http://de1.example.org/", ""), (501, "http://fr2.example.org/", "<p>" + say("fr", 60_000) + "</p>")]
    return spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"lang": F.lit("clash"), "markup": F.lit(1)}).repartition(3), docs


def test_posterior(tables, monkeypatch):
    pages, docs = tables
    saved, save = {}, Scratch.save

    def noted(self, df, name, *args, **kwargs):
        saved[name] = save(self, df, name, *args, **kwargs)
        return saved[name]

    monkeypatch.setattr(Scratch, "save", noted)
    got = language_id.report(pages, docs).collect()
    seen = saved["seen"].collect()
    languages = ["de", "en", "fr"]
    assert len(seen) == len(got) == pages.count()
    add = lambda rows: [sum(r["text_p"][i] for r in rows) for i in range(3)]
    every = add(seen)
    prior = [(x + 1) / (sum(every) + 3) for x in every]

    def share(row, column, above):
        """Sums of the pages with this value, the page's own taken off, smoothed towards ``above``."""
        held = [max(a - b, 0.0) for a, b in zip(add([r for r in seen if r[column] == row[column]]), row["text_p"], strict=True)] if row[column] is not None else [0.0] * 3
        return [(n + 5.0 * a) / (sum(held) + 5.0) for n, a in zip(held, above, strict=True)]

    want = []
    for r in seen:
        like = [math.log(h) + math.log(t + 1e-12) for h, t in zip(share(r, "host", share(r, "domain", prior)), r["text_p"], strict=True)]
        for column in ("markup", "place"):
            if r[column] is not None:
                like = [x + math.log(s / a) for x, s, a in zip(like, share(r, column, prior), prior, strict=True)]
        best = max(range(3), key=lambda i: (like[i], -i))
        want.append((str(r["page_id"]), languages[best], 1 / sum(math.exp(x - like[best]) for x in like)))
    have = sorted((str(r["page_id"]), r["lang"], r["probability"]) for r in got)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9


def test_no_pages(tables, spark):
    pages, docs = tables
    assert language_id.report(pages.limit(0), docs).count() == 0
    assert language_id.report(pages.limit(0), docs.limit(0)).count() == 0

"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence are multiplied:

* the text: character n-grams under a naive Bayes model of each language, tempered since
  n-grams aren't independent and evidence of a long text would drown everything else;
* the language that the markup declares, wherever in the page;
* the address: the host's last label and a language-like part of the path;
* the host: a prior smoothed along host, registered domain and all pages.

The last three are learned from all pages: each page's text posterior is summed by declared
language, by address part, by host and by domain, with map-side combining.  A page's own share
is taken off the host's and domain's sums, so that its text doesn't count twice.

The possible languages are those of all labelled documents with an id.  The text model is fitted
on a bounded sample of them, ``most`` documents of each language, by hash of the id.

Scale: pages are read once, by a map; sums are of a handful of numbers for each host.  Hosts'
priors are broadcast if few, else joined by host, where adaptive execution splits hot hosts.

Defined results: a page without text, markup and address gets the prior of all pages; nulls are
no evidence; without labelled documents that have an id the language is null; ties go to the alphabetically
first language; repeated rows are judged each and count each in the sums; very long pages are read
whole, in batches of bounded size; an empty table of pages gives none.  Of both tables only the
columns named here are read, so others may have any name.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column_list, pieces
from .html_extraction import _RAW, _TAG, Page, host_of
from .jaccard_join import checked_broadcast
from .words import mix

BUCKETS = 1 << 14
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_CODE = re.compile(r"\s*([A-Za-z]{2,3})")
_PART = re.compile(r"[a-z]{2}(?:-[a-z]{2})?\Z")


def grams(text: str | None) -> np.ndarray:
    """Bucket counts of the n-grams of one, two and three characters of the lowered letters."""
    letters = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
    if not letters:
        return np.zeros(BUCKETS, np.int64)
    c = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    all_ = [c]
    if len(c) > 1:
        all_.append(c[:-1] * np.uint64(1 << 21) + c[1:])
    if len(c) > 2:
        all_.append((c[:-2] * np.uint64(1 << 21) + c[1:-1]) * np.uint64(1 << 21) + c[2:])
    hashed = [mix(x + np.uint64(i << 60)) >> np.uint64(50) for i, x in enumerate(all_)]
    return np.bincount(np.concatenate(hashed).astype(np.int64), minlength=BUCKETS)


def declared(source: str | None) -> str | None:
    """Language of the first html tag that gives one, else of the first such meta tag, wherever they are."""
    source, at, meta = source or "", 0, None
    while m := _TAG.search(source, at):
        at, tag = m.end(), (m[2] or m[5] or "").lower()
        if not tag or m[1] or m[4]:
            continue
        if tag in ("html", "meta"):
            found = {}
            for x in _ATTRIBUTE.finditer(m[3] if m[2] else m[6]):
                found.setdefault(x[1].lower(), x[2] or x[3] or x[4] or "")
            if tag == "html":
                if code := _CODE.match(found.get("lang", "")) or _CODE.match(found.get("xml:lang", "")):
                    return code[1].lower()[:2]
            elif not meta and "content-language" in (found.get("http-equiv", "").strip().lower(), found.get("name", "").strip().lower()):
                meta = _CODE.match(found.get("content", ""))
        elif tag in _RAW:  # what looks like a tag in a script or style is none
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
    return meta[1].lower()[:2] if meta else None


def address(url: str | None) -> tuple[str, str, str | None]:
    """Host, registered domain, and the evidence of the address: last label and first path part."""
    host = host_of(url)
    labels = [x for x in host.split(".") if x]
    rest = (url or "").partition("://")[2].partition("/")[2]
    part = re.split(r"[/?#]", rest, maxsplit=1)[0].lower()
    part = part if _PART.match(part) else ""
    return host, ".".join(labels[-3:] if len(labels) > 2 and len(labels[-2]) <= 3 else labels[-2:]), f"{labels[-1] if labels else ''}/{part}" if host or part else None


def _counted(languages: list[str]):
    def run(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in pieces(batches):
            for lang, text in zip(column_list(batch, "lang"), column_list(batch, "text"), strict=True):
                total[languages.index(lang)] += grams(text)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def _chosen(docs: DataFrame, most: int, scratch: Scratch) -> tuple[list[str], DataFrame]:
    """All languages, and (lang, doc_id) of the ``most`` documents of each whose ids have the least hashes."""
    known = docs.where("doc_id is not null and lang is not null").select("lang", "doc_id", F.xxhash64("doc_id").alias("at"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    # of a large language, ids beyond a hash that about twice ``most`` stay under are left out before they are ranked
    cuts = [(lang, int(2**64 * min(1, (2 * most + 100) / max(n, 1)) - 2**63 - 1)) for lang, n in sizes.items()]
    cuts = F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, cut long"))
    low = known.join(cuts, "lang").where("at <= cut").select("lang", "doc_id", "at").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id"))
    return sorted(sizes), scratch.save(low.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "doc_id"), "chosen")


def fit(docs: DataFrame, most: int = 4000, scratch: Scratch | None = None) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each bucket) from at most ``most`` labelled documents of each language."""
    scratch = scratch or Scratch(docs.sparkSession, "language")
    languages, ids = _chosen(docs, most, scratch)
    rows = scratch.save(docs.join(checked_broadcast(ids), ["lang", "doc_id"], "left_semi").select("lang", "text").repartition(8), "sample")
    sums = [np.frombuffer(r["sums"], np.int64).reshape(len(languages), BUCKETS) for r in rows.mapInArrow(_counted(languages), "sums binary").collect()] if languages else []
    total = sum(sums, np.zeros((len(languages), BUCKETS))) + 0.5
    return languages, np.log(total / total.sum(1, keepdims=True)) if languages else total


def _observed(shared, reach: float):
    def run(batches):
        model = shared.value
        for batch in pieces(batches, rows=500):
            rows = []
            for source, url in zip(column_list(batch, "html"), column_list(batch, "url"), strict=True):
                counts = grams("\n".join(b.text for b in Page(source).region()))
                n = counts.sum()
                score = model @ counts / max(n, 1) * min(n / 3, reach)  # every letter is in three n-grams
                score = np.exp(score - score.max()) if len(score) else score
                rows.append((*address(url), declared(source), (score / max(score.sum(), 1e-300)).tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *(pa.array([r[i] for r in rows], pa.string()) for i in range(4)), pa.array([r[4] for r in rows], pa.list_(pa.float64()))], names=["page_id", "url", "host", "domain", "place", "markup", "text_p"])

    return run


def identify(pages: DataFrame, docs: DataFrame, reach: float = 20.0, smooth: float = 5.0, scratch: Scratch | None = None) -> DataFrame:
    """page_id, url, lang, probability, text_lang, n evidence of each page."""
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "language-id")
    languages, model = fit(docs, scratch=scratch)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = f"page_id {kinds['page_id']}, url string, host string, domain string, place string, markup string, text_p array<double>"
    seen = scratch.save(pages.select("page_id", "url", "html").mapInArrow(_observed(spark.sparkContext.broadcast(model), reach), schema), "seen")
    if not languages:
        return seen.select("page_id", "url", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"))
    k = range(len(languages))
    p = [F.element_at("text_p", i + 1) for i in k]
    sums = lambda name: [F.sum(p[i]).alias(f"{name}{i}") for i in k]
    whole = seen.agg(*sums("g")).first()
    total = sum(whole[f"g{i}"] or 0 for i in k)
    prior = [((whole[f"g{i}"] or 0) + 1) / (total + len(languages)) for i in k]
    domains = checked_broadcast(scratch.save(seen.groupBy("domain").agg(*sums("d")), "domains"), 100_000)
    hosts = checked_broadcast(scratch.save(seen.groupBy("host").agg(*sums("h")), "hosts"), 100_000)
    marks = checked_broadcast(scratch.save(seen.where("markup is not null").groupBy("markup").agg(*sums("m")), "marks"), 100_000)
    places = checked_broadcast(scratch.save(seen.where("place is not null").groupBy("place").agg(*sums("a")), "places"), 100_000)
    joined = seen.join(domains, "domain", "left").join(hosts, "host", "left").join(marks, "markup", "left").join(places, "place", "left")

    def share(letter: str, above: list, own: bool) -> list:
        """Posterior counts smoothed towards ``above``, without the page's own if it has been counted."""
        n = [F.greatest(F.coalesce(F.col(f"{letter}{i}"), F.lit(0.0)) - (p[i] if own else 0), F.lit(0.0)) for i in k]
        every = reduce(lambda a, b: a + b, n)
        return [(n[i] + smooth * above[i]) / (every + smooth) for i in k]

    joined = joined.select("*", *(c.alias(f"pd{i}") for i, c in enumerate(share("d", [F.lit(x) for x in prior], True))))
    joined = joined.select("*", *(c.alias(f"ph{i}") for i, c in enumerate(share("h", [F.col(f"pd{i}") for i in k], True))))
    # of markup and address: how much likelier a language is with this value than without knowing it
    joined = joined.select("*", *(c.alias(f"pm{i}") for i, c in enumerate(share("m", [F.lit(x) for x in prior], True))), *(c.alias(f"pa{i}") for i, c in enumerate(share("a", [F.lit(x) for x in prior], True))))
    like = [F.log(F.col(f"ph{i}")) + F.log(p[i] + 1e-12) + F.when(F.col("markup").isNotNull(), F.log(F.col(f"pm{i}") / prior[i])).otherwise(0.0) + F.when(F.col("place").isNotNull(), F.log(F.col(f"pa{i}") / prior[i])).otherwise(0.0) for i in k]
    joined = joined.select("page_id", "url", "text_p", F.array(*like).alias("like"))
    names = F.array(*map(F.lit, languages))
    most = F.array_max("like")
    return joined.select(
        "page_id",
        "url",
        F.element_at(names, F.array_position("like", most).cast("int")).alias("lang"),
        (1 / F.aggregate("like", F.lit(0.0), lambda a, x: a + F.exp(x - most))).alias("probability"),
        F.element_at(names, F.array_position("text_p", F.array_max("text_p")).cast("int")).alias("text_lang"),
    )


def report(pages: DataFrame, docs: DataFrame, **options) -> DataFrame:
    return identify(pages, docs, **options)

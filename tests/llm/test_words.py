"""Words that weak hashes confuse."""

import numpy as np
import pyarrow as pa
import pytest

from eddyscale.llm import jaccard_join, packing, quality, words


def alternating(a: str, b: str, levels: int) -> str:
    """Thue-Morse: polynomials modulo a power of two can't tell it from its complement."""
    s = a
    for _ in range(levels):
        s += s.translate(str.maketrans(a + b, b + a))
    return s


PAIR = alternating("a", "b", 10), alternating("b", "a", 10)


@pytest.mark.parametrize("levels", [4, 5, 6, 7, 8, 10, 12])
def test_thue_morse_words_part(levels):
    a, b = alternating("a", "b", levels), alternating("b", "a", levels)
    h = words.Hasher()(pa.array([a, b, f" {a}", a.upper()])).hashes
    assert h[0] != h[1] and h[0] == h[2] and h[0] != h[3]
    low = words.Hasher(lowered=True)(pa.array([a, a.upper(), b])).hashes
    assert low[0] == low[1] != low[2]


def test_hashes_depend_on_every_byte_and_on_length():
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 9, 16, 17, 31, 255, 256, 257, 600):
        word = rng.integers(97, 123, n, dtype=np.uint8)
        every = [word] + [np.where(np.arange(n) == i, word ^ 1, word) for i in range(n)] + [np.append(word, 0).astype(np.uint8)]
        data = np.concatenate(every)
        ends = np.cumsum([len(x) for x in every])
        h = words.hashes(data, ends - [len(x) for x in every], ends)
        assert len(set(h.tolist())) == len(every)


def test_encoder_tells_them_apart():
    encode = packing.encoder(packing.default_tokenizer())
    texts = [PAIR[0], PAIR[1], f"{PAIR[1]} {PAIR[0]}", alternating("x", "y", 5), alternating("y", "x", 5), alternating("x", "y", 5)]
    ids, bounds = encode.column(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_compares_bytes_where_hashes_agree(monkeypatch):
    """Even if all units had one hash, ids would be right."""
    monkeypatch.setattr(packing, "hashes", lambda data, first, end: np.zeros(len(first), np.uint64))
    encode = packing.Encoder(packing.default_tokenizer())
    texts = ["the cat sat, on the Mat", "cat the 12 mat", "the", "", "unusuallylongwordsthatarenotremembered " * 2]
    for _ in range(2):
        ids, bounds = encode.column(pa.array(texts))
        for i, text in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_jaccard_join_does_not_link_them(spark):
    docs = spark.createDataFrame([(1, PAIR[0]), (2, PAIR[1]), (3, f"{PAIR[0]} {PAIR[1]} c d e"), (4, f"{PAIR[1]} {PAIR[0]} c d e"), (5, PAIR[0].upper())], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.report(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_quality_describes_them_apart():
    found = quality.Describer().words(pa.array(list(PAIR)))
    assert found.letters[0] != found.letters[1]

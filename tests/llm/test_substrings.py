"""Removal of repeated substrings against brute force: split anchors, common lines, merged orders."""

import hashlib
import random
from collections import Counter

import pytest

from sylvan.llm import substrings as S


def brute(texts, length=200):
    data = {i: (t or "").encode() for i, t in texts.items()}
    starts = Counter(d[a : a + length] for d in data.values() for a in range(len(d) - length + 1))
    out = {}
    for i, d in data.items():
        gone = bytearray(len(d))
        for a in range(len(d) - length + 1):
            if starts[d[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        runs = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(d), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest())
    return out


def run(spark, texts):
    rows = S.without_repeats(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def prose(r, n):
    return "".join(r.choice("abcdefghij klmno") for _ in range(n))


def made(r):
    """Passages of all lengths about the limit, in other surroundings, also within one text."""
    passages = [prose(r, n) for n in (40, 64, 100, 150, 199, 200, 201, 260, 337, 900)]
    texts = {i: prose(r, r.randint(0, 300)) + r.choice(passages) + prose(r, r.randint(0, 250)) + r.choice(passages) + prose(r, r.randint(0, 90)) for i in range(90)}
    return texts | {900: None, 901: "", 902: texts[3], 903: texts[3], 904: "ab" * 700, 905: "x" * 199, 906: "x" * 200, 907: prose(r, 80000) + texts[5]}


@pytest.mark.parametrize("hot", [S.HOT, 3, -1000])
def test_against_brute_force(spark, monkeypatch, hot):
    """With any bound for common anchors, also where all are."""
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "BLOCK_BYTES", 20_000)
    texts = made(random.Random(hot))
    assert run(spark, texts) == brute(texts)


def test_a_common_line_in_many_surroundings(spark):
    """100 bytes in 20 000 documents, no two with the same neighbours: its anchor is common, and nothing is removed but a copy."""
    r = random.Random(8)
    line = prose(r, 100)
    texts = {i: prose(r, 140) + line + prose(r, 140) for i in range(20_000)}
    texts[20_000] = texts[17]
    found = run(spark, texts)
    assert {i for i, x in found.items() if x[1]} == {17, 20_000} and found[17][1] == 380


def test_merged_order_tells_shared_prefixes():
    r = random.Random(4)
    words = sorted({prose(r, r.randint(0, 6)).encode() for _ in range(500)})
    runs = [sorted(r.choices(words, k=r.randint(0, 90))) for _ in range(7)]
    out = list(S.merge_runs([S.run_of(S.front_code(x)) if x else iter(()) for x in runs]))
    assert [x[0] for x in out] == sorted(sum(runs, []))
    for a, b in zip(out, out[1:], strict=False):
        assert b[1] == next((k for k in range(min(len(a[0]), len(b[0]))) if a[0][k] != b[0][k]), min(len(a[0]), len(b[0])))


def test_no_rows(spark):
    assert S.without_repeats(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []

"""Each operator on nulls, repeated rows, null ids, ties, empty and long texts, empty tables and clashing columns."""

import gzip
import math
import os
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.llm import ann, decontaminate, jaccard, langmodel, pieces, pii, queries, substrings, toxicity, urls, warc

SF = "/root/testdata/sf0.001"
VOCABULARY = queries.VOCABULARY
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon"
LONG = " ".join(f"word{i % 997} next{i % 89}" for i in range(30_000))
ROWS = [
    (1, WORDS), (1, WORDS), (2, None), (3, ""), (4, " \t\n "), (None, WORDS), (None, "another text of a row without an id"), (5, LONG), (5, "two texts have one id"), (6, WORDS + " more"), (7, WORDS.upper()),
    (8, "x"), (9, "ab" * 3000), (10, "mail me@ex.org or 10.0.0.1"), (10, "mail me@ex.org or 10.0.0.1"), (-3, "negative"), (11, "▁ é 漢字 🙂 \u0000 end"),
]
CLASHING = "block bucket answers kind mark node size prefix shingles root component_id score predicted held_out pieces round_trip n_pieces _toxicity _ident _mark i m n rows f".split()


@pytest.fixture(scope="module")
def docs(spark):
    """The special rows, with columns of the names that the operators use inside."""
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)), F.length("text").cast("long").alias("n_chars")).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def twice_equal(rows, *columns):
    """Repeated rows have equal results."""
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(tuple(r[c] for c in columns))
    for i in (1, 10):
        assert len(seen[i]) == 2 and seen[i][0] == seen[i][1]
    assert len(seen[None]) == 2 and len(rows) == len(ROWS)


def test_warc(spark):
    pages = [(1, "http://a.org", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b.org/\r\nX: y", None), (3, "http://b.org", None), (None, "http://c.org", "lone"), (4, "http://d.org", ""), (None, "u", "<p>é</p>"), (5, "v", "z" * 100_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as id", "2 as payload", "3 as refers_to", "4 as path")
    rows = warc.round_trip(spark, df).collect()
    last = {p: max((i for i, _, q in pages if (q or "") == p and i is not None), default=None) for p in {p or "" for _, _, p in pages}}
    want = sorted(((i, len((p or "").encode()), warc.digest((p or "").encode()), *(("response", None) if i == last[p or ""] or last[p or ""] is None else ("revisit", last[p or ""]))) for i, _, p in pages), key=repr)
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr) == want
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_archives_that_are_broken(spark, tmp_path):
    good = [warc.record(i, f"http://x.org/{i}", b"payload %d" % i, None) for i in range(4)]
    wrong = gzip.compress(gzip.decompress(good[1]).replace(b"payload 1", b"payload 7"))
    for name, parts in {"cut": [*good[:2], good[2][:-9]], "noise": [good[0], b"no gzip at all"], "digest": [good[0], wrong, good[2]], "empty": [], "whole": good}.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(b"".join(parts))
    manifest = lambda n: spark.createDataFrame([(f"file://{tmp_path}/{n}.warc.gz", 0, 0)], warc.MANIFEST)
    assert [r.id for r in warc.read_archives(manifest("whole")).collect()] == [0, 1, 2, 3] and warc.read_archives(manifest("empty")).count() == 0
    for name in ("cut", "noise", "digest"):
        with pytest.raises(Exception, match="."):
            warc.read_archives(manifest(name)).collect()
        kept = warc.read_archives(manifest(name), errors="keep").collect()
        assert kept[0].id == 0 and kept[0].digest_ok and any(r.error or not r.digest_ok for r in kept)


@pytest.mark.parametrize("name", ["op1_warc", "op10_url_filters"])
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    path = f"{SF}/pages.parquet"
    con.execute(f"create view pages as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def test_url_filters(spark):
    at = "timestamp '2024-03-01 00:00:00'"
    entries = spark.sql(
        f"""select * from values ('l', 'prefix', 'h.org/en', 'block', 'add', {at}), ('l', 'domain', 'org', 'allow', 'add', {at}), (null, 'host', 'x.com', 'block', 'add', {at}), ('l', 'host', null, 'block', 'add', {at}), ('l', 'host', 'y.com', 'block', 'add', null),
        ('l', 'host', 'z.com', 'block', 'add', {at}), ('l', 'host', 'z.com', 'block', 'remove', {at}), ('l', 'host', 't.com', 'allow', 'add', {at}), ('l', 'host', 't.com', 'block', 'add', {at}) as t(list_name, kind, pattern, verdict, change, changed_at)"""
    )
    later, before = "timestamp '2024-03-01 00:00:00'", "timestamp '2024-02-29 23:59:59'"
    cases = [("http://h.org/en", later, "block"), ("http://h.org/en/x", later, "block"), ("http://h.org//en", later, "allow"), ("http://h.org/english", later, "allow"), ("http://H.ORG/EN", later, "block"), ("http://x.com", later, "block"), ("http://y.com", later, "none"),
             ("http://z.com", later, "none"), ("http://t.com/", later, "block"), ("http://h.org/en", before, "none"), (None, later, "none"), ("no url", later, "none"), ("http://x.com", None, "none"), ("http://h.org/en", later, "block")]
    captures = spark.sql(" union all ".join(f"select {k if k != 5 else 'null'} as page_id, {'null' if u is None else repr(u)} as url, {'cast(null as timestamp)' if t is None else t} as fetched_at, 'c' as key, 1 as pattern, 2 as verdict, 3 as best" for k, (u, t, _) in enumerate(cases)))
    found = {r.page_id: r.verdict for r in urls.url_filter(captures, entries).collect()}
    assert found == {(k if k != 5 else None): v for k, (_, _, v) in enumerate(cases)}
    assert urls.url_filter(captures.limit(0), entries).count() == 0
    assert {r.verdict for r in urls.url_filter(captures, entries.limit(0)).collect()} == {"none"}


def test_pii(docs, none):
    rows = pii.pii(docs).collect()
    twice_equal(rows, "n_email", "n_ip", "base_sha256", "spans")
    assert [r.n_email for r in rows if r.doc_id == 10] == [1, 1] and pii.pii(none).count() == 0
    masked = pii.redact(docs)
    assert masked.columns == docs.columns and masked.filter("doc_id = 10").first().text == "mail [EMAIL] or [IP]" and masked.filter("doc_id = 2").first().text is None
    assert masked.filter("n_chars <> length(text)").count() == 0 and pii.redact(none).count() == 0


def test_gradients_of_the_tagger():
    """The numpy gradients against differences, with the conditional random field."""
    r = np.random.default_rng(3)
    shape = {"embed": (pii.CLASSES, pii.EMBED), "wo": (2 * pii.HIDDEN, pii.TAGS), "bo": (pii.TAGS,), "trans": (pii.TAGS, pii.TAGS)} | {f"{n}{d}": s for d in "fb" for n, s in (("wx", (pii.EMBED, 4 * pii.HIDDEN)), ("wh", (pii.HIDDEN, 4 * pii.HIDDEN)), ("b", (4 * pii.HIDDEN,)))}
    p = {n: r.standard_normal(s) * 0.3 for n, s in shape.items()}
    chars, tags = r.integers(0, 128, (3, 7)), r.integers(0, pii.TAGS, (3, 7))

    def loss(q):
        return pii.crf_gradient(pii.emissions(q, chars)[0], tags.T, q["trans"])[0]

    e, fore, back = pii.emissions(p, chars)
    _, by_score, by_trans = pii.crf_gradient(e, tags.T, p["trans"])
    both = np.concatenate([fore["outs"][1:], back["outs"][1:][::-1]], 2)
    grad = {n: np.zeros_like(v) for n, v in p.items()}
    grad["trans"], grad["bo"] = by_trans, by_score.sum((0, 1))
    grad["wo"] = both.reshape(-1, 2 * pii.HIDDEN).T @ by_score.reshape(-1, pii.TAGS)
    up = by_score @ p["wo"].T
    pii.lstm_gradient(p, "f", fore, up[:, :, : pii.HIDDEN], grad)
    pii.lstm_gradient(p, "b", back, up[::-1, :, pii.HIDDEN :], grad)
    for n in ("trans", "bo", "wo", "wxf", "whf", "bf", "wxb", "whb", "bb"):
        at = tuple(r.integers(0, k) for k in p[n].shape)
        ends = []
        for step in (1e-2, -1e-2):
            q = {k: v.copy() for k, v in p.items()}
            q[n][at] += step
            ends.append(loss(q))
        assert grad[n][at] == pytest.approx((ends[0] - ends[1]) / 2e-2, rel=2e-2, abs=3e-4), n


def test_windows_of_long_stretches_are_reconciled():
    model = pii.train_tagger(600, 64, 11)
    text = "call me at 555-123-4567 or write to anna.b at once, number 12 of 400; " * 40
    whole = pii.tagged_spans(model, [text])[0]
    assert whole == pii.tagged_spans(model, [text, "", "no digits here"])[0] and pii.tagged_spans(model, ["", "none"]) == [[], []]
    assert len([s for s in whole if text[s[1] : s[2]].startswith("555-123")]) >= 30


def test_pieces(spark, docs, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    whole = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(docs.select("doc_id", "text"))
    for r in pieces.with_pieces(whole, VOCABULARY).collect():
        text = (r.text or "").replace("▁", " ")
        assert r.pieces == model.encode(text), repr(text[:80])
        assert r.round_trip == (text == (r.text or ""))
    out = pieces.with_pieces(docs, VOCABULARY)
    assert len(out.columns) == len(docs.columns) and out.select("pieces").schema[0].dataType.simpleString() == "array<int>"
    assert pieces.with_pieces(none, VOCABULARY).count() == 0
    back = pieces.decoded(out.select("doc_id", "pieces"), VOCABULARY)
    assert {r.text for r in back.filter("doc_id in (2, 3)").collect()} == {""}
    twice_equal(pieces.piece_digests(docs, VOCABULARY).collect(), "n_pieces", "ids_sha256")


def test_language_model(spark, docs, none):
    rows = langmodel.language_model(spark, docs).collect()
    twice_equal(rows, "n_tokens", "n_known", "base_score", "score")
    assert all(not r.held_out for r in rows if r.doc_id is None) and {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows) and langmodel.language_model(spark, none).count() == 0
    alone = langmodel.language_model(spark, docs.filter("doc_id = 8")).first()
    assert math.isfinite(alone.score) and alone.train_tokens in (0, 2)


def test_weights_of_the_language_model():
    """Tokens that only the bigram explains get the bigram's weight."""
    w = langmodel.expectation(np.array([3, 3]), np.array([90.0, 10.0]), np.array([0.0009, 0.01]), np.array([81.0, 0.0]), 1e-6)
    assert w[3, 2] > 0.8 and w.sum(1) == pytest.approx(np.ones(langmodel.BUCKETS)) and w[0, 2] == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (6, 1, 0), (None, 1, 1), (7, None, None), (99, 0, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    twice_equal(rows, "score", "predicted", "held_out")
    assert all(0 <= r.score <= 1 for r in rows) and toxicity.toxicity(none, labels).count() == 0
    for given in (labels.limit(0), labels.filter("toxic = 0")):
        assert {(r.score, r.predicted) for r in toxicity.toxicity(docs, given).collect()} == {(0.0, 0)}


def test_nearest(spark):
    r = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in r.standard_normal(8)]) for i in range(300)]
    odd = [(300, None), (350, [0.0] * 8), (400, [1.0, None] + [0.0] * 6), (450, [float("nan")] + [1.0] * 7), (500, [float("inf")] + [1.0] * 7), (550, []), (None, vectors[0][1]), (600, vectors[7][1]), (601, [2 * x for x in vectors[7][1]]), (600, vectors[7][1]), (650, [1.0, 2.0])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as score", "3 as shard", "4 as dim")
    good = {i: np.array(v) for i, v in [*vectors, (600, vectors[7][1]), (601, [2 * x for x in vectors[7][1]])]}
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    for shard in (4096, 64):
        got: dict = {}
        for row in ann.nearest(spark, df, F.col("vec_id") % 50 == 0, k=5, shard=shard).collect():
            got.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
        assert set(got) == {i for i in good if i % 50 == 0}
        hits = 0
        for q, rows in got.items():
            rows.sort()
            assert [x[0] for x in rows] == [1, 2, 3, 4, 5] and all(s == pytest.approx(cos(good[q], good[i]), abs=1e-12) for _, i, s in rows)
            hits += len({i for _, i, _ in rows} & {i for _, i in sorted((-cos(good[q], v), i) for i, v in good.items() if i != q)[:5]})
        assert [i for _, i, _ in got[600]][:2] == [7, 601] and hits >= 0.9 * 5 * len(got)
    assert ann.nearest(spark, df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


ITEM = "which of the following statements about the inner structure of a folded protein chain is true according to the second table"
SHORT = "capital of France"


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, ITEM), (3, None), (4, ""), (5, SHORT), (None, "a null id stands here with quite enough words to be an item")], "item_id long, text string")
    tail = " ".join(ITEM.split()[:-4])
    texts = [(1, "before " * 30 + ITEM + " after" * 30), (2, tail + " others end it so"), (3, "the Capital of France."), (4, "the capital of France is"), (5, "capital city of France"), (6, WORDS), (None, ITEM), (7, None), (8, LONG + " " + ITEM), (8, LONG + " " + ITEM)]
    rows = decontaminate.contaminated(spark, spark.createDataFrame(texts, "doc_id long, text string").repartition(2), items).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.has_answer) for r in rows) == sorted([(i, k, True) for i in (1, 0, 8, 8) for k in (1, 2)] + [(2, 1, False), (2, 2, False), (4, 5, True)])
    kept = decontaminate.uncontaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) and decontaminate.uncontaminated(none, items).count() == 0
    assert decontaminate.contaminated(spark, docs, items.limit(0)).count() == 0 and decontaminate.uncontaminated(docs, items.limit(0)).count() == len(ROWS)


def test_decontamination_of_long_items(spark):
    """The answer of an item in parts is the item's, wherever the part lies; half of a part is enough with it."""
    words = [f"w{i}q" for i in range(150)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    half = [w if i % 2 else f"z{i}" for i, w in enumerate(words)]
    half[-4:] = words[-4:]
    texts = [(1, " ".join(words)), (2, " ".join(half)), (3, " ".join(half[:-4])), (4, " ".join(words[:60]))]
    found = {(r.doc_id, r.has_answer) for r in decontaminate.contaminated(spark, spark.createDataFrame(texts, "doc_id long, text string"), items).collect()}
    assert found == {(1, True), (2, True), (4, False)}


@pytest.mark.parametrize("change", ["dropped", "swapped"])
def test_paraphrases_are_found(spark, change):
    """Items with every fourth word dropped or every third swapped, and their answer, between foreign words."""
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rows = []
    for k, r in enumerate(items.orderBy("item_id").collect()):
        words, out, i = r.text.split(), [], 0
        while i < len(words):
            if i >= len(words) - 4:
                out.append(words[i])
            elif change == "dropped" and i % 4 != 3:
                out.append(words[i])
            elif change == "swapped":
                out += [words[i + 1], words[i]] if i % 3 == 0 and i + 1 < len(words) - 4 else [words[i]]
                i += i % 3 == 0 and i + 1 < len(words) - 4
            i += 1
        rows.append((r.item_id, " ".join([*(f"left{j}" for j in range(k)), *out, *(f"right{j}" for j in range(40))])))
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert sum((i, i) in found for i, _ in rows) >= 0.9 * len(rows)


def test_substrings(spark, docs, none):
    rows = substrings.without_repeats(spark, docs).collect()
    twice_equal(rows, "n_bytes", "n_removed", "kept_sha256")
    assert {(r.n_bytes, r.n_removed, r.n_spans) for r in rows if r.doc_id in (2, 3)} == {(0, 0, 0)} and substrings.without_repeats(spark, none).count() == 0


def test_jaccard(spark, docs, none):
    rows = jaccard.jaccard_components(spark, docs, k=3, num=90, den=100).collect()
    twice_equal(rows, "n_shingles", "component_id")
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[1] == by[6] and by[7] == by[1] or by[7] == {(18, 1)}
    assert by[2] == {(0, 2)} and by[3] == {(0, 3)} and {x[1] for x in by[None]} == {1, None}
    assert jaccard.jaccard_components(spark, none).count() == 0
    kept = jaccard.one_of_each(spark, docs)
    assert kept.columns == docs.columns and jaccard.one_of_each(spark, none).count() == 0
    left = sorted((r.doc_id, r.text) for r in kept.filter("doc_id is not null").select("doc_id", "text").collect() if r.text is not None)
    assert [i for i, _ in left] == [-3, 1, 3, 4, 5, 5, 8, 9, 10, 11] and kept.filter("doc_id = 2").count() == 1 and kept.filter("doc_id is null").count() == 1


def test_one_id_with_a_copy_and_another_text(spark):
    """Of one id with two texts only the one that is a near copy goes."""
    rows = spark.createDataFrame([(3, WORDS), (5, WORDS + " end"), (5, "a text of its own that nothing else is like")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:6]) for r in jaccard.one_of_each(spark, rows, k=5, num=80, den=100).collect()) == [(3, WORDS[:6]), (5, "a text")]


def test_pipeline_stages(spark, docs, none, tmp_path):
    """Each stage keeps the columns of its input, whatever they are called; the last adds the ids."""
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline as P

    for name, stage in P.STAGES:
        out, nothing = stage(spark, docs, SF), stage(spark, none, SF)
        assert nothing.count() == 0
        if name == "pieces":
            assert {"pieces", "round_trip"} <= set(out.columns) and len(out.columns) == len(docs.columns)
        else:
            assert out.columns == docs.columns, name
        assert out.filter("doc_id = 5").count() == 2, name

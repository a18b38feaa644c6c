"""The training-data operators against brute force, exact round trips and held-out labels, and on odd tables."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docpipe.llm import ann, decontaminate, html, lines, lm, near, pieces, quality, urls, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], DOCS)


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# 1 HTML extraction


def brute_html(rows, least):
    """rows: page_id, host, words."""
    seen = defaultdict(set)
    for p, host, w in rows:
        for i in range(len(w) - least + 1):
            seen[host, tuple(w[i : i + least])].add(p)
    out = []
    for _, host, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - least + 1):
            if len(seen[host, tuple(w[i : i + least])]) > 1:
                gone[i : i + least] = [True] * least
        kept = [" ".join(x for x, _ in g) for k, g in itertools.groupby(zip(w, gone, strict=True), key=lambda x: x[1]) if not k]
        out.append("\n".join(kept))
    return out


@pytest.mark.parametrize(("most", "most_bytes"), [(10**6, 0), (1, 10**6), (1, 0)])
def test_html_is_brute_force(spark, most, most_bytes):
    rng = random.Random(1)
    nav = prose(rng, 12)
    rows = []
    for p in range(60):
        body = prose(rng, rng.randrange(0, 40), 30)
        rows.append((p, f"http://h{p % 3}.org/{p}", f"<html><head><title>t</title></head><body><nav>{nav}</nav><p>{body}<br>{body[:20]}</body></html>"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in html.extract(pages, 4, most, most_bytes).collect()}
    words = [(p, f"h{p % 3}.org", h.split("<nav>")[1].replace("</nav><p>", " ").replace("<br>", " ").replace("</body></html>", "").split()) for p, _, h in rows]
    assert [got[p].text for p, _, _ in words] == brute_html(words, 4)
    assert sum(r.removed for r in got.values()) > 60 * 12


@pytest.mark.parametrize(("most", "most_bytes"), [(10**6, 0), (0, 10**6), (0, 0)])
def test_html_odd_rows(spark, most, most_bytes):
    same = "<p>one two three four five six seven eight nine</p><script>x()</script>&amp; é"
    rows = [(1, "http://a.b/x", same), (1, "http://a.b/x", same), (2, "http://c.d/", same), (3, None, None), (None, "nonsense", ""), (None, None, same), (4, "http://a.b/y", "<p>" + "long " * 5000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash")).withColumn("words", F.lit(1))
    out = html.extract(pages, 8, most, most_bytes).collect()
    assert len(out) == len(rows)
    assert [r.text for r in out if r.page_id == 1] == ["one two three four five six seven eight nine & é"] * 2  # a repeated page covers nothing
    assert [r.text for r in out if r.page_id == 3] == [None]
    assert [r.words for r in out if r.page_id == 4] == [5000]
    assert html.extract(pages.limit(0)).count() == 0


# 2 nearest vectors


@pytest.mark.parametrize(("every", "most"), [(1, 1 << 18), (20, 7)])
def test_neighbours_recall(spark, every, most):
    """With several leaves; with leaves in parts, and queries of every 20th id."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert round(rows.count() ** 0.5 / 4) > 3
    x = rows.toPandas()
    m = np.stack(x.embedding).astype(float)
    s = m @ m.T
    np.fill_diagonal(s, -9)
    exact = {i: set(x.vec_id.to_numpy()[np.argsort(-s[k])[:10]]) for k, i in enumerate(x.vec_id)}
    got = defaultdict(set)
    for r in ann.neighbours(rows, every=every, most=most).collect():
        got[r.vec_id].add(r.neighbor_id)
    asked = [i for i in exact if i % every == 0]
    assert set(got) == set(asked) and np.mean([len(got[i] & exact[i]) / 10 for i in asked]) >= 0.9


@pytest.mark.parametrize(("noise", "least"), [(0.0, 1.0), (1e-4, 0.9)])
def test_neighbours_in_a_large_cluster(spark, noise, least):
    """Thousands of vectors of equal codes: more than are ranked again."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3600, 16)).astype(np.float32)
    x[:3000] = (x[0] * 3 + noise * rng.normal(size=(3000, 16))).astype(np.float32)
    x = x[rng.permutation(len(x))]
    got = defaultdict(list)
    for r in ann.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")).orderBy("vec_id", "rank").collect():
        got[r.vec_id].append(r.neighbor_id)
    scores = np.einsum("qd,rd->qr", x.astype(float), x.astype(float))
    np.fill_diagonal(scores, -np.inf)
    dense = np.flatnonzero(np.linalg.norm(x - np.median(x, 0), axis=1) < 0.1)[:: 3]
    assert len(dense) == 1000
    hits = [len(set(got[q]) & set(np.lexsort((np.arange(len(x)), -scores[q]))[:10])) for q in dense]
    print("recall in the cluster", noise, np.mean(hits) / 10)
    assert np.mean(hits) / 10 >= least


def test_neighbours_odd_rows(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, []), (6, [1.0, None, 0.0]), (7, [float("nan"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (8, [1.0, 2.0]), (9, [0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).withColumn("leaf", F.lit("x"))
    out = {(r.vec_id, r["rank"]): r.neighbor_id for r in ann.neighbours(vectors, k=2).collect()}
    assert {i for i, _ in out} == {1, 2, 3, 9} and len(out) == 8
    assert out[1, 1] == 2 and out[2, 1] == 1 and out[3, 1] == 1  # ties by id
    assert ann.neighbours(vectors.limit(0)).count() == 0


def test_anisotropic_codes_weigh_parallel_errors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    books = rng.normal(size=(4, 16, 2)).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)

    def along(c):
        e = x - books[np.arange(4), c].reshape(200, 8)
        return np.abs((e * u).sum(1)).mean()

    assert along(ann.codes(x, x, books, 8.0)) < along(ann.codes(x, x, books, 1.0))


# 3 language model


def test_lm_is_brute_force(spark):
    rng = random.Random(3)
    corpus = [" ".join(rng.choices("a b c d e".split(), k=rng.randrange(30))) for _ in range(40)] + [None, "  "]
    texts = [" ".join(rng.choices("a b c d e zz".split(), k=rng.randrange(25))) for _ in range(12)] + [corpus[0], None, "", corpus[3], corpus[3]]
    known = [c.split() for c in corpus if c]
    frame = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").withColumn("words", F.lit("clash"))
    got = {r.id: r for r in lm.score(spark.createDataFrame([(c,) for c in corpus], "text string").repartition(3), frame, shard=100).collect()}

    def count(p):
        return sum(map(len, known)) if not p else sum(c[i : i + len(p)] == p for c in known for i in range(len(c) - len(p) + 1))

    for i, text in enumerate(texts):
        if text is None:
            assert got[i].words is None and got[i].log2_prob is None
            continue
        total, w = 0.0, text.split()
        for j in range(len(w)):
            p = 2.0**-20
            for n in range(j + 1):
                if not count(w[j - n : j]):
                    break
                p = (count(w[j - n : j + 1]) + 4 * p) / (count(w[j - n : j]) + 4)
            total += math.log2(p)
        assert got[i].words == len(w) and abs(got[i].log2_prob - total) < 1e-6
    empty = lm.score(spark.createDataFrame([], "text string"), frame).where("id = 0").first()
    assert abs(empty.log2_prob + 20 * empty.words) < 1e-9


def test_lm_scores_each_row_by_all_others(spark, monkeypatch):
    monkeypatch.setattr(lm, "SLICE_BYTES", 400)
    rng = random.Random(5)
    texts = [" ".join(rng.choices("a b c d e".split(), k=rng.randrange(1, 30))) for _ in range(30)]
    texts += [texts[0], texts[1], f"{texts[2]} zz", "zz yy", "yy yy yy", "only " * 9, None, " "]
    rows = [(i % 36, t) for i, t in enumerate(texts)]
    got = Counter((r.id, r.words, None if r.log2_prob is None else round(r.log2_prob, 6), None if r.context is None else round(r.context, 6)) for r in lm.each(spark.createDataFrame(rows, "id bigint, text string").repartition(3), shard=100).collect())
    known = [(t or "").split() for t in texts]
    want = Counter()
    for i, (k, t) in enumerate(rows):
        others = Counter(tuple(c[a:b]) for j, c in enumerate(known) if j != i for a in range(len(c)) for b in range(a + 1, len(c) + 1))
        others[()] = sum(len(c) for j, c in enumerate(known) if j != i)
        total, longest, w = 0.0, [], known[i]
        for j in range(len(w)):
            p, m = 2.0**-20, 0
            for n in range(j + 1):
                if not others[tuple(w[j - n : j])]:
                    break
                p, m = (others[tuple(w[j - n : j + 1])] + 4 * p) / (others[tuple(w[j - n : j])] + 4), n
            total, longest = total + math.log2(p), [*longest, m]
        want[k, None if t is None else len(w), None if t is None else round(total, 6), round(sum(longest) / len(w), 6) if w else None] += 1
    assert got == want


def test_lm_reads_the_corpus_once_for_many_slices(spark, monkeypatch):
    """A slice of scored texts was a pass over the corpus of its own, and jobs grew with the slices."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, prose(rng, 60, 9)) for i in range(40)], "id bigint, text string").repartition(3)
    jobs, got = [], []
    for size in (1 << 20, 400):
        monkeypatch.setattr(lm, "SLICE_BYTES", size)
        spark.sparkContext.setJobGroup(f"slices {size}", "")
        got.append({r.id: (r.words, round(r.log2_prob, 6)) for r in lm.each(docs, shard=500).collect()})
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"slices {size}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got[0] == got[1] and len(got[0]) == 40
    assert jobs[1] <= jobs[0] + 2


def test_lm_indexes_only_what_texts_share(spark, monkeypatch):
    """All of the corpus was indexed, and searched by each slice."""
    rng = random.Random(7)
    corpus = [prose(rng, 50, 2000) for _ in range(40)]
    shared = " ".join(corpus[0].split()[10:30])
    monkeypatch.setattr(lm, "SPARE", 256, raising=False)  # a bitmap for so few words has false hits
    tables, written = {}, lm.written
    monkeypatch.setattr(lm, "written", lambda df, name: tables.update({name: (out := written(df, name))}) or out)
    frame = spark.createDataFrame([(0, f"x {shared} y")], "id bigint, text string")
    got = lm.score(spark.createDataFrame([(c,) for c in corpus], "text string"), frame).first()
    assert got.words == 22 and got.context > 4
    assert tables["suffixes"].where("name = 'rest'").agg(F.sum(F.octet_length("data"))).first()[0] < 4 * 100


def test_lm_of_a_word_after_a_long_frequent_context_is_finite(spark):
    """The probability was 0 in floating point, and log2_prob -inf."""
    words = [f"w{k}" for k in range(250)]
    frame = spark.createDataFrame([(0, " ".join(words[:-1])), (1, " ".join([*words[:-1], "zz"]))], "id bigint, text string")
    got = {r.id: r.log2_prob for r in lm.score(spark.createDataFrame([(" ".join(words),)] * 300, "text string"), frame).collect()}
    assert abs(got[1] - got[0] - (-20 + math.log2(4 / (300 * 250 + 4)) + 249 * math.log2(4 / 304))) < 1e-6


def test_op3_scores_every_20th_document_as_if_all_were(spark):
    from docpipe.llm.queries import op3_lm_scores

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op3_lm_scores(spark, SF)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.where("doc_id % 20 = 0").collect()}
    every = lm.each(docs.select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id").withColumn("log2_prob", F.round("log2_prob", 6))
    assert not got.withColumn("log2_prob", F.round("log2_prob", 6)).select("doc_id", "log2_prob").exceptAll(every.select("doc_id", "log2_prob")).head(1)


# 4 near duplicates


def overlap(a, b, n=3):
    x, y = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)]) for w in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def brute_groups(words, threshold):
    root = {i: i for i in words}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(words), 2):
        if words[a] and words[b] and overlap(words[a], words[b]) >= threshold:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    size = Counter(find(i) for i in words)
    return {i: find(i) for i in words if size[find(i)] > 1}


def test_groups_are_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        base = prose(rng, rng.randrange(5, 200)).split()
        for _ in range(rng.randrange(1, 8)):
            copy = [w if rng.random() > 0.03 else "edit" + str(rng.random()) for w in base]
            texts.append(" ".join(copy))
        texts.append(" ".join(base + base))  # the same set, another multiset
    out = {r.doc_id: r.group_id for r in near.groups(docs_of(spark, texts)).collect()}
    exact = brute_groups({i: t.split() for i, t in enumerate(texts)}, 0.4)
    assert all(exact[i] == exact[g] for i, g in out.items())  # nothing is joined that shouldn't be
    pairs = [(a, b) for a, b in itertools.combinations(exact, 2) if exact[a] == exact[b]]
    assert sum(a in out and out.get(a) == out.get(b) for a, b in pairs) >= 0.9 * len(pairs)


def test_groups_join_unlike_texts_by_a_bridge(spark):
    """Buckets {1, 3} and {2, 3}: 3 is compared with both of the documents that are least in its buckets."""
    rng = random.Random(12)
    texts = []
    for _ in range(8):
        a, b = prose(rng, 60, 10**6), prose(rng, 60, 10**6)
        texts += [a, b, f"{a} {b}"]
    out = {r.doc_id: r.group_id for r in near.groups(docs_of(spark, texts), bands=96, rows=2).collect()}
    assert out == {i: i - i % 3 for i in range(len(texts))}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    row = np.repeat([0, 1], 60)
    gram = np.tile(np.arange(60, dtype=np.uint64), 2)
    count = rng.integers(1, 9, 120)
    s = near.signatures(row, gram, count, 2, 6000)
    true = np.minimum(count[:60], count[60:]).sum() / np.maximum(count[:60], count[60:]).sum()
    assert abs((s[0] == s[1]).mean() - true) < 0.03


def test_groups_odd_rows(spark):
    a = "one two three four five six seven"
    docs = docs_of(spark, [a, a, None, None, "", "", "x", "x", a, "unlike all the others here", a], [1, 2, 3, 4, 5, 6, 7, 8, None, 9, 2])
    docs = docs.withColumn("d", F.lit(0)).withColumn("k", F.lit(0)).withColumn("group_id", F.lit(0))
    assert {r.doc_id: r.group_id for r in near.groups(docs).collect()} == {1: 1, 2: 1, 7: 7, 8: 7}
    left = near.first_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 3, 4, 5, 6, 7, 9]
    assert near.groups(docs.limit(0)).count() == 0


# 5 pieces


def library(vocab):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        if vocab.pieces.get(p.piece, (None,))[0] == i:
            p.score = vocab.pieces[p.piece][1] / 256
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_pieces_are_the_librarys_and_come_back(spark):
    rng = random.Random(7)
    odd = ["", None, " ", "  ", " lead", "trail ", "a  b   c\n\n d", "\n", "x\ty", "日本語 \U0001f600 ąę", "a" * 300, "x \n y", "aaa " * 50, "end\n", "\r\n z", "don't,stop.now", "é" * 40, "\x00a", "", None]
    texts = odd + ["".join(rng.choices("aeinrst ,.\né", k=rng.randrange(200))) for _ in range(40)]
    docs = docs_of(spark, texts).withColumn("ids", F.lit("clash")).withColumn("c", F.lit(1))
    own = library(pieces.vocabulary())
    for r in pieces.encode(docs, partitions=4).select("doc_id", "ids", pieces.decode(F.col("ids")).alias("back")).collect():
        text = texts[r.doc_id]
        assert r.ids == (None if text is None else own.encode(text)) and r.back == text
    assert pieces.encode(docs.limit(0), partitions=2).count() == 0


def same(ids, text, own, vocab):
    """Whether ids are the library's; of long texts, whose scores it rounds from 2**16, whether they are as probable."""
    exact = own.encode(text)
    if ids == exact:
        return True
    scores = dict(vocab.pieces.values())
    total = lambda x: sum(scores.get(i, 0) for i in x)
    return len(exact) > 4000 and total(ids) >= total(exact) and own.decode(ids) == text


def test_chunks_of_many_distinct_words_take_little_memory(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    rng, vocab = random.Random(5), pieces.vocabulary()
    texts = pa.array([" ".join(f"w{rng.randrange(1 << 40):x}" for _ in range(500)) for _ in range(500)])
    pieces.chunk(texts.slice(0, 1), vocab, 256)
    tracemalloc.start()
    whole = pieces.chunk(texts, vocab, 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75e6  # 89 MB when all distinct words were cut at once
    monkeypatch.setattr(pieces, "CUT_BYTES", 40_000)
    again = pieces.chunk(texts, vocab, 256)
    assert whole.key == again.key and whole.units.equals(again.units) and np.array_equal(whole.unit_ids, again.unit_ids)


def test_pieces_of_very_long_units_and_of_shuffled_texts(spark):
    rng = random.Random(8)
    vocab = pieces.vocabulary()
    texts = ["th" * n for n in (31, 32, 33, 63, 64, 65, 127, 128, 129, 3000)] + ["".join(rng.choices("ing", k=k)) for k in (62, 95, 96, 500, 9_000)] + ["e" * 60_000]
    docs = docs_of(spark, texts).repartition(3)
    own = library(vocab)
    out = {r.doc_id: r for r in pieces.encode(docs, vocab, partitions=4, back=pieces.MODEL).collect()}
    assert all(same(out[i].ids, t, own, vocab) and out[i].decoded == t for i, t in enumerate(texts[:-1]))
    assert out[len(texts) - 1].decoded == texts[-1]


# 6 quality


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fitted = labels.where("doc_id % 2 = 0")
    model = quality.fit(docs, fitted)
    out = quality.classify(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert (out.accepted == (out.quality == 1)).mean() > 0.9
    assert out[out.quality == 1].accepted.mean() > 0.97


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 0.6), ("sf0.1", 0.9)])
def test_quality_rejects_held_out_toxic_texts(spark, sf, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"), toxic_z=quality.TOXIC_Z)
    out = quality.classify(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    clean, toxic = out[(out.quality == 1) & (out.toxic == 0)], out[(out.quality == 1) & (out.toxic == 1)]
    print(sf, "accepted clean", clean.accepted.mean(), len(clean), "rejected toxic", 1 - toxic.accepted.mean(), len(toxic), "rejected quality 0", 1 - out[out.quality == 0].accepted.mean())
    assert 1 - toxic.accepted.mean() > least and clean.accepted.mean() > 0.96


def test_quality_odd_rows(spark):
    docs = docs_of(spark, ["fine text here " * 20, None, "", " \n ", "fine text here " * 20, "x" * 100_000], [1, 2, 3, 4, None, 5]).withColumn("score", F.lit(9)).withColumn("accepted", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, None), (77, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.fit(docs, labels) is None
    out = {r.doc_id: (r.score, r.accepted) for r in quality.classify(docs, None).collect()}
    assert out == {1: (None, True), 2: (0.0, False), 3: (0.0, False), 4: (0.0, False), None: (None, True), 5: (None, True)}
    many = docs_of(spark, [("good plain words " + str(i)) * 20 for i in range(40)] + [("!!BAD!! " + str(i)) * 20 for i in range(40)])
    model = quality.fit(many, spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], labels.schema))
    kept = quality.accepted(many.withColumn("score", F.lit("x")), model)
    assert kept.columns == [*many.columns, "score"] and {r.doc_id for r in kept.collect()} == set(range(40))
    assert {r.doc_id: r.accepted for r in quality.classify(docs, model).collect()}[3] is False
    assert quality.classify(docs.limit(0), model).count() == 0


# 7 WARC


def test_warc_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = [(None, None, None), (1, "http://a\r\nb/", ""), (1, "http://a/", None), (1, "http://a/", None), (2, " x ", "é\r\n\r\n" * 70_000)]
    every = pages.unionByName(spark.createDataFrame(odd, "page_id bigint, url string, html string")).withColumn("record_id", F.lit("clash"))
    frames = warc.pack(every, frame=20_000, bundle=100_000).cache()
    got = Counter((r.page_id, r.url, r.html) for r in warc.unpack(frames).collect())
    assert got == Counter((r.page_id, r.url, r.html) for r in every.collect())
    index = warc.index(frames).collect()
    assert len({r.record_id for r in index}) == len(index) == every.count()
    import io

    import zstandard

    bundles = {r.bundle_id for r in index}
    assert len(bundles) > 1
    for b in bundles:
        data = warc.bundle(frames, b)
        table = warc.read_seek_table(data)
        assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read().count(b"WARC/1.0\r\n") == sum(r.bundle_id == b for r in index)
        for r in [r for r in index if r.bundle_id == b][:5]:
            at, size, _ = table[r.frame_no]
            assert (at, size) == (r.frame_offset, r.frame_size)
            raw = zstandard.ZstdDecompressor().decompress(data[at : at + size])
            assert warc.parsed(raw[r.record_offset : r.record_offset + r.record_length])[0] == r.page_id
    some = spark.createDataFrame([(index[0].record_id,), (index[-1].record_id,), ("none",)], "record_id string")
    assert {r.record_id for r in warc.fetch(frames, some).collect()} == {index[0].record_id, index[-1].record_id}
    assert warc.pack(every.limit(0)).count() == 0


# 8 decontamination


def brute_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        best = max(best, h[i][j])
    return best


def test_align_is_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(0, 15))
        assert decontaminate.align(a, b)[0] == brute_align(list(a), list(b))


def test_passages_are_brute_force(spark):
    rng = random.Random(9)
    items = [prose(rng, rng.randrange(12, 50), 3000) for _ in range(30)]
    texts = []
    for k in range(150):
        w = prose(rng, rng.randrange(0, 300), 3000).split()
        for item in rng.sample(items, k % 3):
            copy = [x if rng.random() > 0.2 else f"w{rng.randrange(3000)}" for x in item.split()]
            at = rng.randrange(len(w) + 1)
            w[at:at] = copy
        texts.append(" ".join(w))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find(docs_of(spark, texts), bench).collect()}
    exact = {}
    for (d, t), (i, x) in itertools.product(enumerate(texts), enumerate(items)):
        shared = set(zip(x.split(), x.split()[1:], strict=False)) & set(zip(t.split(), t.split()[1:], strict=False))
        if shared and (s := brute_align(x.split(), t.split()) / (2 * len(x.split()))) >= 0.5:
            exact[d, i] = s
    assert len(exact) > 100 and len(set(exact) - set(got)) <= 0.02 * len(exact)
    assert all(abs(exact[k] - s) < 1e-9 for k, s in got.items())


def test_decontaminate_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta"
    docs = docs_of(spark, [f"so {item}. and on", None, "", item.upper(), item, "clean words only", item], [1, 2, 3, 4, None, 5, 1]).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(7, item), (None, item), (8, None), (9, " "), (10, "clean")], "item_id bigint, text string")
    found = Counter((r.doc_id, r.item_id) for r in decontaminate.find(docs, bench).collect())
    assert found == Counter({(1, 7): 2, (1, None): 2, (4, 7): 1, (4, None): 1, (None, 7): 1, (None, None): 1, (5, 10): 1})
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert decontaminate.find(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == 7
    assert decontaminate.find(docs.limit(0), bench).count() == 0


# 9 urls


def test_urls_odd_rows(spark):
    rows = [(i, f"http://H.org/bad/{i}", "") for i in range(40)] + [(i, f"http://h.org/good/{i}?q#f", "") for i in range(40, 80)]
    rows += [(100, None, ""), (101, "nonsense", ""), (None, "http://h.org/bad/1", ""), (1, "http://h.org/bad/1", ""), (102, "http://other.org/" + "a/" * 500, "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("template", F.lit("clash")).withColumn("t", F.lit(1))
    labels = spark.createDataFrame([(i, i < 40) for i in range(80)] + [(None, True), (500, True), (3, None), (45, False)], "page_id bigint, bad boolean")
    out = urls.templates(pages, labels)
    got = out.collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r.template].add(r.rejected)
    assert by["h.org/bad/*"] == {True} and by["h.org/good/*"] == {False} and by[None] == {False}
    kept = urls.kept(pages, labels)
    assert kept.columns == pages.columns and {r.page_id for r in kept.collect()} == {*range(40, 80), 100, 101, 102, None}
    assert urls.templates(pages.limit(0), labels).count() == 0
    assert {r.rejected for r in urls.templates(pages, labels.limit(0)).collect()} == {False}


def test_urls_of_small_sections_and_deep_segments(spark):
    """A section of 0.5 % of a large host, and one told apart by its fifth segment."""
    rows = [(i, f"http://h.org/{'spam' if i < 20 else 'good'}/{i}", "") for i in range(4000)]
    rows += [(i, f"http://deep.org/a/b/c/d/{'spam' if i % 2 else 'good'}/x/{i}", "") for i in range(5000, 5080)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    labels = spark.createDataFrame([(i, i < 20) for i in range(0, 4000, 2)] + [(i, bool(i % 2)) for i in range(5000, 5080)], "page_id bigint, bad boolean")
    by = {r.page_id: (r.template, r.rejected) for r in urls.templates(pages, labels).collect()}
    assert by == {i: (f"h.org/{'spam' if i < 20 else 'good'}/*", i < 20) for i in range(4000)} | {i: (f"deep.org/*/*/*/*/{'spam' if i % 2 else 'good'}/*/*", bool(i % 2)) for i in range(5000, 5080)}


# 10 lines


def brute_lines(rows, threshold):
    """rows: doc_id, text, in order."""
    sets, gone = [], set()
    for d, t in rows:
        for n, line in enumerate(t.split("\n")):
            s = set(line.lower().split())
            if not s:
                continue
            if any(len(s & x) >= threshold * len(s | x) - 1e-9 for x in sets):
                gone.add((d, n))
            sets.append(s)
    return gone


@pytest.mark.parametrize(("threshold", "hot", "partners"), [(0.8, lines.HOT, lines.PARTNERS), (0.8, 0, 64), (0.8, 40, 1), (0.5, 0, 1), (0.5, 10**6, 64), (1.0, 0, 1)])
def test_lines_are_brute_force(spark, threshold, hot, partners):
    rng = random.Random(11)
    base = [prose(rng, rng.randrange(1, 30), 60) for _ in range(40)] + [prose(rng, rng.randrange(55, 140), 4000) for _ in range(8)]
    texts = []
    for _ in range(120):
        own = []
        for line in rng.sample(base, 4):
            w = line.split()
            for k in range(len(w)):
                if rng.random() < 0.06:
                    w[k] = f"w{rng.randrange(60)}"
            own.append(" ".join(w))
        texts.append("\n".join(own + [""] + [prose(rng, 8, 60)]))
    docs = docs_of(spark, texts)
    got = {(r.d, r.l) for r in lines.removals(docs, threshold, hot, partners).collect()}
    assert got == brute_lines(list(enumerate(texts)), threshold) and len(got) > (200 if threshold < 1 else 20)
    out = {r.doc_id: (r.text, r["__removed"]) for r in lines.dedup(docs, threshold, hot, partners).collect()}
    for d, t in enumerate(texts):
        left = [x for n, x in enumerate(t.split("\n")) if (d, n) not in got]
        assert out[d] == ("\n".join(left), len(t.split("\n")) - len(left))


@pytest.mark.parametrize(("partners", "broadcast"), [(1, 0), (1, 1 << 25), (64, 0)])
def test_lines_of_a_large_group_reach_the_last_round(spark, monkeypatch, partners, broadcast):
    """Lines that share their rare words and half of the others: many possible partners by sketch that fail, some that don't."""
    rng = random.Random(3)
    texts = [" ".join(["rare", "seldom", *sorted(rng.sample([f"c{k}" for k in range(16)], 12))]) for _ in range(900)]
    rounds = []
    for name in ("paired", "against"):
        monkeypatch.setattr(lines, name, lambda *a, name=name, real=getattr(lines, name): rounds.append(name) or real(*a))
    got = {(r.d, r.l) for r in lines.removals(docs_of(spark, texts), 0.8, lines.HOT, partners, broadcast).collect()}
    assert got == brute_lines(list(enumerate(texts)), 0.8)
    assert partners > 1 or rounds == ["paired", "against" if broadcast else "paired"]


def test_only_lines_with_a_wanted_word_are_compared_in_the_last_round():
    """All lines of the corpus were made sets."""
    import pyarrow as pa

    texts = pa.array(["a b", "", "B. c", "c", None, "c d (b)"], pa.large_string())
    wanted = np.zeros(lines.BUCKETS, bool)
    wanted[(lines.X.words(pa.array(["b"], pa.large_string()))[1] >> lines.U(24)) & lines.MASK] = True
    assert lines.with_buckets(texts, wanted).tolist() == [0, 2, 5]
    assert lines.with_buckets(texts.slice(3, 2), wanted).tolist() == []


def test_lines_odd_rows(spark):
    a = "one two three four five"
    docs = docs_of(spark, [f"{a}\nx", a, None, "", "\n \n", f"{a}\nunlike", f"{a}", a, "word " * 30_000, "z"], [1, 2, 3, 4, 5, 6, 6, None, 7, 1]).withColumn("d", F.lit(0)).withColumn("__x", F.lit(1))
    out = lines.dedup(docs)
    assert out.columns == [*docs.columns, "__removed"]
    got = sorted((r.doc_id or 0, r.text or "", r["__removed"]) for r in out.collect() if r.doc_id != 7)
    assert got == sorted([(1, f"{a}\nx", 0), (1, "z", 0), (2, "", 1), (3, "", 0), (4, "", 0), (5, "\n \n", 0), (6, "unlike", 1), (6, "", 1), (0, a, 0)])
    assert lines.dedup(docs.limit(0)).count() == 0


# pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, kept, SF)
        new.write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        assert new.columns == docs.columns
        assert not new.select("doc_id").exceptAll(kept.select("doc_id")).head(1)
        kept = new
    assert 0 < kept.count() < docs.count()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.find(kept, bench).count() == 0
    out = corpus_pipeline.run(spark, SF).collect()
    own = library(pieces.vocabulary())
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert {r.doc_id for r in out} == set(texts) and all(same(r.ids, texts[r.doc_id], own, pieces.vocabulary()) and r.n_ids == len(r.ids) for r in out)


def test_pipeline_odd_rows(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "some words that are fine", "en", "s", 24), (2, "some words that are fine", "en", "s", 24), (None, "no number", None, None, None)], DOCS)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, str(tmp_path)).count() <= table.count()

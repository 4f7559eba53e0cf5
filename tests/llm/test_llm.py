"""Nearest-time rings, sketches, encoding, mixture and passage scoring: brute force, public encoders and edges."""

import base64
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("slotweave.llm.queries")
from slotweave.llm import bpe, mixture, nearest, queries, sketch, toxicity  # noqa: E402
from tests.helpers import BASE, database, rows  # noqa: E402

S = 1_000_000


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    got = queries.QUERIES[name](spark, BASE).toArrow()
    assert rows(got) == rows(database().sql(queries.ORACLES[name]).arrow().read_all())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, BASE)
    ids = {r.doc_id for r in spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id").collect()}
    got = df.collect()
    assert got or name == "p10_found"  # twenty labels may find nothing
    assert "doc_id" not in df.columns or {r.doc_id for r in got} <= ids
    if name in ("p8_ids", "p10_scores"):
        assert len(got) == len(ids)


def pairs(spark, left, right, tol=900, first=60):
    at = lambda t: F.timestamp_micros(t)
    a = spark.createDataFrame(left, "i long, e string, t long, right_id int, b string").withColumn("at", at(F.col("t")))
    b = spark.createDataFrame(right, "i long, e string, t long, left_id int, l_us int").withColumn("at", at(F.col("t")))
    key = nearest.entity_key(F.col("e"))
    return nearest.nearest(a, b, left_id="i", left_entity=key, left_time="at", right_id="i", right_entity=key, right_time="at", tolerance_s=tol, first_ring_s=first)


def test_nearest_matches_brute_force(spark):
    rng = random.Random(4)
    left = [(i, rng.choice(["01", "1", " 01 ", "2", None, ""]), rng.choice([None, rng.randrange(0, 40000) * S]), 0, "") for i in range(300)] + [(7000 + k, "2", 5 * S, 0, "") for k in range(50)]
    right = [(i, rng.choice(["01", "2", "0002", None]), rng.choice([None, rng.randrange(0, 4000) * 10 * S]), 0, 0) for i in range(400)] + [(9000 + k, "2", 60 * S, 0, 0) for k in range(40)]
    norm = lambda e: (e or "").strip().lstrip("0") or None
    want = set()
    for i, e, t, *_ in left:
        c = [(abs(u - t), u, j) for j, f, u, *_ in right if t is not None and u is not None and norm(e) and norm(e) == norm(f) and abs(u - t) <= 900 * S]
        if c:
            want.add((i, min(c)[2]))
    got = [(r.left_id, r.right_id) for r in pairs(spark, left, right).collect()]
    assert len(got) == len(want) and set(got) == want


def test_nearest_ties_and_tolerance(spark):
    left = [(1, "a", 1000 * S, 0, ""), (2, "a", 5000 * S, 0, "")]
    right = [(8, "a", 900 * S, 0, 0), (9, "a", 1100 * S, 0, 0), (7, "a", 900 * S, 0, 0), (5, "a", 5900 * S, 0, 0), (6, "a", 4100 * S - 1, 0, 0)]
    assert {(r.left_id, r.right_id) for r in pairs(spark, left, right).collect()} == {(1, 7), (2, 5)}
    assert pairs(spark, [], right).count() == 0 and pairs(spark, left, []).count() == 0


def test_sketch_error_and_merge(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.lognormal(0, 3, 2000), -rng.lognormal(0, 2, 1500), np.zeros(50)])
    data = [("g", i % 3, float(v)) for i, v in enumerate(x)] + [("g", 0, float("nan")), ("g", 0, None), ("g", 0, float("inf")), (None, 0, 1.0)]
    df = spark.createDataFrame(data, "g string, day int, v double")
    whole = sketch.sketch(df, groups=["g"], values=["v"])
    days = sketch.merge(*[sketch.sketch(df.where(F.col("day") == d), groups=["g"], values=["v"]) for d in range(3)], groups=["g"])
    ps = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    a, b = (sketch.percentiles(s, groups=["g"], probabilities=ps).where("g = 'g'").first() for s in (whole, days))
    assert a == b and a.n == len(x)
    s = np.sort(x)
    for p, got in zip(ps, a[3:]):
        exact = s[int(np.floor(p * (len(s) - 1)))]
        assert abs(got - exact) <= 0.01 * abs(exact) + 1e-12
    assert sketch.sketch(df.where("false"), groups=["g"], values=["v"]).count() == 0
    assert [r[0] for r in spark.createDataFrame([(1.234567891234e-9,), (-987654321.987,), (0.0,)], "x double").select(sketch.significant(F.col("x"))).collect()] == [1.23456789e-9, -987654322.0, 0.0]


def test_extreme_value_law_is_found_again():
    rng = np.random.default_rng(2)
    n = rng.integers(50, 3000, 4000)
    best = np.maximum(0, (np.log(0.002 * n) - np.log(-np.log(rng.random(4000)))) / 0.7)
    m = toxicity.Model({"a": 1.0}, {})
    m.calibrate(best, n)
    assert abs(m.rate - 0.7) < 0.05 and abs(np.log(m.k / 0.002)) < 0.25
    best[:60] = 40.0  # mistaken labels do not stretch the tail without end
    m.calibrate(best, n)
    assert m.rate > 0.5 and m.chance(40.0, 1000) < 1e-6


def public_encoder():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_public_encoder(spark):
    rng = random.Random(1)
    parts = ["a", "é", "1", "'", " ", "  ", "\n", "\t", " ", "s", "re", "ll", "'s", "'ve", "!", "漢", "😀", "　", "''t", "\x1c", "²", "ⅷ", "́", "<|endoftext|>", "z" * 200, "ab1" * 90, "\r\n", "-" * 300]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(400)] + [None, "", " ", "x" * 70_000, "der Fluß " * 5000]
    df = spark.createDataFrame([(i, t, [1], "y") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, n_tokens string")
    enc = public_encoder()
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    n = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, keep=["doc_id"]).collect()}
    assert n == {i: len(x) for i, x in got.items()}
    assert bpe.encode(df.where("false")).count() == 0


def test_short_and_long_merges_agree():
    e = bpe.Encoder.load(bpe.default_path())
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh éü1", k=rng.randint(1, 60))).encode() for _ in range(300)]
    short = [np.frombuffer(x, np.int32).tolist() for w in words for x in bpe.merge_short([w], e.pairs)]
    assert short == [bpe.merge_long(w, e.ranks) for w in words]


def sizes(spark, rows_):
    return spark.createDataFrame(rows_, "doc_id long, source string, size long, share string, cap string").withColumn("h", mixture.hash_of("doc_id"))


def test_thresholds_are_those_of_records_in_order_of_hash(spark):
    """Against brute force: records of a source taken by hash until the budget is met as nearly as whole records can."""
    rng = random.Random(4)
    rows_ = [(i, rng.choice("ab"), rng.randint(1, 90), "", "") for i in range(4000)]
    t = spark.createDataFrame([("a", 0.25, 1), ("b", 0.75, 3)], "source string, target_share double, max_repeats int")
    s = sizes(spark, rows_)
    _, shares = mixture.mix(s, t, fractions=[0.1, 0.77])
    h = {r.doc_id: r.h for r in s.collect()}
    for r in shares.collect():
        own = sorted((h[i], n) for i, src, n, *_ in rows_ if src == r.source)
        total = sum(n for _, n in own)
        rest, best, run = r.want % total, 0, 0
        for _, n in own:
            run += n
            best = run if abs(run - rest) < abs(best - rest) else best
        assert r.got == r.want // total * total + best


def test_mixture_reaches_targets_and_nests(spark):
    rng = random.Random(3)
    rows_ = [(i, rng.choice("aaaab"), rng.randint(1, 60), "", "") for i in range(3000)] + [(9000 + i, "c", 20, "", "") for i in range(30)] + [(1, None, 5, "", ""), (2, "zz", 5, "", ""), (3, "a", 0, "", ""), (4, "a", None, "", "")]
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("d", 0.0, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mixture.mix(sizes(spark, rows_), t, fractions=[0.3, 1.0])
    s = {(r.fraction, r.source): r for r in shares.collect()}
    assert set(s) == {(f, x) for f in (0.3, 1.0) for x in "abc"}
    assert all(abs(r.share - r.target_share) < 0.01 and abs(r.got - r.want) <= 60 for r in s.values()) and s[1.0, "c"].repeats == 4
    c = chosen.collect()
    small, large = ({r.doc_id: r.copies for r in c if r.fraction == f} for f in (0.3, 1.0))
    assert all(large.get(k, 0) >= v for k, v in small.items()) and all(r.copies <= {"a": 1, "b": 2, "c": 4}[r.source] for r in c)
    empty, none = mixture.mix(sizes(spark, []), t)
    assert empty.count() == 0 and none.count() == 0


@pytest.mark.parametrize(("raw", "want"), [("f.i.l.t.h.y", ["filthy"]), ("l1k3", ["like"]), ("іdіоt", ["idiot"]), ("s​t​op", ["stop"]), ("Scheiß", ["scheiss"]), ("you_are", ["you", "are"]), ("p\\u00e5", ["pa"]), ("12.5", []), ("sFobjXxdsEE9", [])])
def test_spelling(raw, want):
    assert toxicity.words_of(raw) == want


def test_maximal_segments():
    def brute(x):
        out, todo = [], [(0, len(x))]
        while todo:
            a, b = todo.pop()
            best = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] > 0:
                _, _, _, i, j = best
                out.append((i, j))
                todo += [(a, i), (j, b)]
        return sorted(out)

    rng = random.Random(0)
    for _ in range(200):
        x = [round(rng.uniform(-2, 2), 3) for _ in range(rng.randint(0, 14))]
        assert sorted((a, b) for a, b, _ in toxicity.segments(np.array(x))) == brute(x)


def test_passages_are_told_from_harmless_use(spark):
    rng = random.Random(5)
    plain = ["we load the data and plot the result", "the model fits the second series well", "run the cell twice if the kernel restarts"]
    bad = ["you are a filthy idiot and nobody wants you here", "go away you worthless moron we hate your kind"]
    fine = ["this bug cost a day i feel like an idiot today", "kill the child process and run the cell again"]
    docs, labels = [], []
    for i in range(400):
        lines = [rng.choice(plain) for _ in range(12)]
        toxic = i % 6 == 0
        if toxic or i % 4 == 1:
            lines.insert(rng.randrange(12), rng.choice(bad if toxic else fine))
        docs.append((i, "\n".join(lines), "s", "x"))
        if i < 300:
            labels += [(i, r, int(toxic)) for r in ("a", "b")] + [(i, "c", None)]
    hidden = [(900, "print(1)  # y.o.u a.r.e a f1lthy ідіоt and nobody wants you here", "s", "x"), (901, None, "s", "x"), (902, "", None, "x"), (903, fine[0] * 50, "s", "x")]
    d = spark.createDataFrame(docs + hidden, "doc_id long, text string, source string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, rater string, toxic int")
    model = toxicity.fit(d, lab)
    got = {r.doc_id for r in toxicity.score(d, model, keep=["doc_id"]).where("flagged").collect()}
    assert got == {i for i in range(400) if i % 6 == 0} | {900}
    none = toxicity.score(d.where("false"), model, keep=["doc_id"])
    assert none.count() == 0
    assert toxicity.score(d, toxicity.fit(d, lab.where("false")), keep=["doc_id"]).count() == len(docs) + 4


def test_sequences_keep_documents_apart():
    w = toxicity.Words({"one": 1, "two": 2})
    n, ids = w.sequences(pa.array(["one", "two one", None, "", "...", "onetwo"]))
    assert n.tolist() == [1, 2, 0, 0, 0, 1] and ids.tolist() == [1, 2, 1, 0]


def test_two_words_and_joined_spellings_count(spark):
    assert toxicity.words_of("youAreAnIdiot") == ["you", "are", "an", "idiot"] and toxicity.words_of("IdIoT") == ["idiot"]
    model = toxicity.Model({"filthy": 4.0, "idiot": 4.0} | {w: -1.0 for w in ("you", "nobody", "wants", "are", "and")}, {("filthy", "idiot"): 2.4})
    long = "youarefilthyidiotandnobodywantsyou"
    assert toxicity.parted(long, model.vocabulary) == ["you", "are", "filthy", "idiot", "and", "nobody", "wants", "you"] and toxicity.parted("x" * 40, model.vocabulary) == ["x" * 40]
    assert toxicity.parted("x" * 40 + "ts", {"xxx": 1, "xts": 2, "xxts": 3}) == ["x" * 40 + "ts"]
    texts = ["x = load(a)  # filthy idiot\nplot(x)", "x = load(a)  # FiLtHy IdIoT", f"plot(x)  # {long}", "x = load(a)  # idiot", "plot(x)"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in toxicity.score(d, model, keep=["doc_id"]).where("flagged").collect()} == {0, 1, 2}
    n, ids = toxicity.Words(model.vocabulary).sequences(pa.array([long]))
    assert sum(b is None for _, _, b in toxicity.doc_features([long], [[(2, 4)]], model.vocabulary)) == 2 and n.tolist() == [8]


def test_known_words_are_found_in_encoded_data():
    v = {"fuck": 1, "idiot": 2, "moron": 3}
    assert toxicity.words_in("fUcK9yOu2iDiOt", v) == ["fuck", "", "idiot"]
    assert toxicity.words_in("xX9zQ2IdIoT7qW8eR6tY", v) == ["", "", "idiot", "", "", ""]
    assert toxicity.words_in("m0RoN2xY", v) == ["moron", ""]
    far = toxicity.words_in("fUcK2" + "aB9" * 50 + "iDiOt", v)  # what lies between two finds keeps them apart
    assert far == ["fuck", *[""] * toxicity.STRETCH, "idiot"]
    assert toxicity.words_in("aGVsbG8gd29ybGQhIQ82K", v) == [] and toxicity.words_in("fUcK9yOu2iDiOt", {}) == []
    w = toxicity.Words(v)
    n, ids = w.sequences(pa.array(["see fUcK9yOu2iDiOt", None, ""]))
    assert n.tolist() == [4, 0, 0] and ids.tolist() == [0, 1, 0, 2]

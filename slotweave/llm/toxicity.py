"""Abusive, hateful or sexual passages (maximum-scoring segment search).

Every word of a text has a log-odds score of standing in offending rather than in clean documents, estimated from labelled documents with an
informative Dirichlet prior; words and pairs of words are scored. A linear-time scan (all maximal scoring segments)
finds each passage whose sum stands out; the sums are held against the extreme-value distribution of the best segments of
clean documents, so long texts do not score by chance. A document is flagged when its best segment is significant.

Spelling is normalised before anything else: look-alike letters, invisible characters, letters written with points between them, digits for
letters, accents, escapes and joined words.

Scale: labelled documents (``MAX_LABELLED`` at most, chosen by hash; the only sample) are reduced to counts and scores per feature in Spark; the model
(features of at least ``LEAST_DOCS`` of those documents that tell something, so bounded by the sample) goes to the workers in the closure. Scoring is a map over all documents, whole texts, without shuffle:
the distinct chunks of an Arrow batch are normalised once, then scores are array lookups. Only documents, never passages, leave the map.
"""

from __future__ import annotations

import math
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.llm.bpe import slices
from slotweave.runtime import cut

MAX_LABELLED = 20_000
#: A feature of a single document tells nothing of the others.
LEAST_DOCS = 2
PRIOR = 20.0
UNKNOWN = -0.55
DRIFT = 0.30
DULL = 0.8
LEAST = 1.0
LEVEL = 0.01
#: Log-odds a passage needs at least: against odds of one in four hundred that a passage offends.
LEAST_SUM = 6.0
KEEP_CHUNKS = 300_000
#: Words longer than this are looked at as several written together.
LONG = 30
#: Letters of a word to be told from chance in encoded data, and unknown words that stand for a stretch of it at most (enough to part two passages).
LEAST_HIDDEN, STRETCH = 4, 8

#: Look-alike letters of other scripts.
LOOKALIKE = str.maketrans(
    "аеорсухіјѕһԁԛԝьвнкмтգոսցαεορτυχνικ" "АВЕКМНОРСТУХІЈЅ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "øæðłđıœ",
    "aeopcyxijshdqwbbhkmtqnugaeoptuxvik" "abekmhopctyxijs" "abezhikmnoptyx" "oadldio",
)
#: Digits and signs used for letters.
LEET = str.maketrans("013457@$", "oieastas")
ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
POINTED = re.compile(r"(?<![^\W_])(?:[^\W_][.\-_*·•]){2,}[^\W_]?(?![^\W_])")
WORD = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"(?=[^\W_]*[013457@$])(?=[^\W_]*[^\W\d_])[\w@$]+")
ENCODED = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]|[A-Z][0-9][a-zA-Z]|[a-z][0-9]+[A-Z]")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
LETTERLIKE = re.compile(r"[013457@$]")
#: Offending words of the corpus's languages, as prior evidence (normalised spelling).
LEXICON = (
    "idiot moron imbecile cretin asshole bastard bitch whore slut cunt fuck fucking shit bullshit dickhead retard scum vermin subhuman nazi porn nudes horny naked tits cock pussy "
    "vollidiot idioten arschloch scheisse scheiss schlampe hure fotze missgeburt abschaum wichser nackt "
    "connard connasse salope pute putain merde encule abruti debile nique "
    "puta puto mierda cabron gilipollas imbecil desnuda basura zorra perra pendejo "
    "idiot luder kaelling svin lort fisse narrov perker naogen bolle"
).split()


def words_of(chunk: str) -> list[str]:
    """The normalised words in one stretch of text without separators."""
    if chunk.isascii():
        if chunk.isalpha() and (chunk.islower() or chunk.isupper() or chunk.istitle()):
            return [chunk.lower()]
        if chunk.isalnum() and (turn := ENCODED.search(chunk)) and ENCODED.search(chunk, turn.end()):
            if not chunk.translate(LEET).isalpha():
                return []  # other digits among changing case: encoded data, see ``hidden``
            parts = PART.findall(chunk)
            if chunk.isalpha() and len(chunk) >= 2.5 * len(parts):  # words joined by capitals
                return [x.lower() for x in parts]
            chunk = chunk.lower()  # capitals without meaning
        if "\\" in chunk:
            chunk = re.sub(r"\\[nrtbfv\"'/\\]", " ", ESCAPE.sub(lambda m: chr(int(m[1], 16)), chunk))
    if not chunk.isascii():
        s = unicodedata.normalize("NFKD", chunk)
        s = "".join([c for c in s if unicodedata.category(c) not in ("Mn", "Cf", "Me")])
        chunk = s.translate(LOOKALIKE).casefold().translate(LOOKALIKE)
    else:
        chunk = chunk.lower()
    if not chunk.isalnum():
        chunk = POINTED.sub(lambda m: re.sub(r"[.\-_*·•]", "", m[0]), chunk)
    if not chunk.isalpha() and LETTERLIKE.search(chunk):
        chunk = MIXED.sub(lambda m: m[0].translate(LEET), chunk)
    return WORD.findall(chunk)


def parted(word: str, vocabulary: dict[str, int]) -> list[str]:
    """A word of more than ``LONG`` letters as the fewest words of the vocabulary, if these are it; else the word."""
    n = len(word)
    if n <= LONG or not vocabulary or word in vocabulary:
        return [word]
    least: list[tuple[int, int] | None] = [(0, 0)] + [None] * n  # words up to here, begin of the last
    for j in range(1, n + 1):
        ways = [(least[i][0] + 1, i) for i in range(max(0, j - LONG), j) if least[i] and word[i:j] in vocabulary]
        least[j] = min(ways, default=None)
    if least[n] is None or 3 * least[n][0] > n:
        return [word]
    out, j = [], n
    while j:
        i = least[j][1]
        out.append(word[i:j])
        j = i
    return out[::-1] if 2 * len(set(out)) > len(out) else [word]  # one word over and over is a row of letters


#: Bytes to lower-case letters, the others to blanks; with and without digits for letters.
LETTERS = bytes(ord(chr(i).lower()) if chr(i).isalpha() and i < 128 else 32 for i in range(256))
LETTERS_LEET = bytes(LETTERS[LEET.get(i, i)] if i < 128 else 32 for i in range(256))


def hidden(chunk: str, vocabulary: dict[str, int]) -> list[str]:
    """Words of the vocabulary that stand between the digits of encoded data, with unknown words (empty) for what lies between them."""
    raw, out = chunk.encode("ascii", "replace"), []
    for letters in (LETTERS, LETTERS_LEET):  # digits as borders, else as letters
        runs = raw.translate(letters).decode().split()
        at = [i for i, r in enumerate(runs) if len(r) >= LEAST_HIDDEN and r in vocabulary]
        for i, before, after in zip(at, [-1, *at], [*at[1:], len(runs)]):
            out += [""] * min(i - before - 1, STRETCH) + [runs[i]]
            if after == len(runs):
                out += [""] * min(after - i - 1, STRETCH)
        if out:
            break
    return out


def words_in(chunk: str, vocabulary: dict[str, int]) -> list[str]:
    """The words of a chunk as the vocabulary parts them; without vocabulary encoded data have none."""
    found = words_of(chunk)
    return [x for w in found for x in parted(w, vocabulary)] if found else hidden(chunk, vocabulary) if vocabulary else []


#: Bytes of a chunk: letters, digits, all of UTF-8's longer characters, and signs that hide or escape letters.
SOLID = np.zeros(256, bool)
SOLID[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), *b"_.@$*-\\"]] = True
HAS_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
PACK = struct.Struct("i").pack


class Words:
    """Texts to sequences of word numbers; words outside ``vocabulary`` are 0. Distinct chunks are worked out once."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.known = vocabulary, {}

    def chunk(self, raw: bytes) -> bytes:
        got = self.known.get(raw)
        if got is None:
            if not HAS_LETTER.search(raw):
                return b""
            v = self.vocabulary
            got = b"".join([PACK(v.get(x, 0)) for x in words_in(raw.decode("utf-8", "replace"), v)])
            if len(self.known) >= KEEP_CHUNKS:
                self.known.clear()
            if len(raw) <= 40:
                self.known[raw] = got
        return got

    def sequences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words per text, all word numbers one after another)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        none = np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
        if not len(raw):
            return none
        solid = SOLID[raw]
        edge = solid.copy()
        edge[1:] &= ~solid[:-1]
        docs = off[:-1][np.diff(off) > 0]
        edge[docs] |= solid[docs]
        begin = np.flatnonzero(edge)
        if not len(begin):
            return none
        packed_at = np.cumsum(solid)
        bounds = np.append(packed_at[begin] - 1, packed_at[-1]).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(raw[solid])])
        d = chunks.dictionary_encode()
        packed = [self.chunk(w) for w in d.dictionary.to_pylist()]
        index = d.indices.to_numpy()
        each = np.fromiter((len(p) >> 2 for p in packed), np.int64, len(packed))
        per = each[index]
        total = np.concatenate([[0], np.cumsum(per)])
        at = np.searchsorted(begin, off)
        n = total[at[1:]] - total[at[:-1]]
        flat = np.frombuffer(b"".join(packed), np.int32)
        from_ = np.concatenate([[0], np.cumsum(each)[:-1]])[index]
        place = np.repeat(from_ - total[:-1], per) + np.arange(int(total[-1]))
        return n, flat[place]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(from, to, sum)`` in linear time; ``to`` is excluded.

    Stretches of one sign are joined first, so the scan runs over positive stretches only.
    """
    hot = np.flatnonzero(scores > 0)
    if not len(hot):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    first = hot[np.r_[True, np.diff(hot) > 1]]
    last = hot[np.r_[np.diff(hot) > 1, True]] + 1
    stack: list[list[float]] = []  # start, stop, sum before, sum after
    for a, b in zip(first.tolist(), last.tolist()):
        new = [a, b, total[a], total[b]]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], b, stack[j][2], new[3]]
            del stack[j:]
    return [(int(a), int(b), hi - lo) for a, b, lo, hi in stack]


class Model:
    """Scores of words and pairs, and the extreme-value law of clean documents' best segments."""

    def __init__(self, single: dict[str, float], pairs: dict[tuple[str, str], float]):
        names = sorted(set(single) | {w for p in pairs for w in p})
        self.vocabulary = {w: i + 1 for i, w in enumerate(names)}
        self.single = np.full(len(names) + 1, -DRIFT)
        self.single[0] = UNKNOWN
        for w, s in single.items():
            self.single[self.vocabulary[w]] = s - DRIFT
        m = len(names) + 1
        keyed = sorted((self.vocabulary[a] * m + self.vocabulary[b], s) for (a, b), s in pairs.items())
        self.pair_keys = np.array([k for k, _ in keyed] or [-1], np.int64)
        self.pair_scores = np.array([s for _, s in keyed] or [0.0])
        self.rate, self.k = 0.5, 0.0002

    def scores(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = self.single[ids]
        if len(ids) > 1:
            key = ids[:-1].astype(np.int64) * len(self.single) + ids[1:]
            i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            hit = np.flatnonzero((self.pair_keys[i] == key) & (ids[:-1] > 0) & (ids[1:] > 0))
            ends = np.zeros(len(ids), bool)
            c = np.cumsum(n)
            ends[c[c > 0] - 1] = True
            hit = hit[~ends[hit]]
            out[hit + 1] += self.pair_scores[i[hit]]
        return out

    def best(self, n: np.ndarray, ids: np.ndarray) -> list[list[tuple[int, int, float]]]:
        s = self.scores(ids, n)
        at, out = 0, []
        for k in n.tolist():
            out.append(segments(s[at : at + k]))
            at += k
        return out

    def calibrate(self, best: np.ndarray, n: np.ndarray, top: float = 0.98) -> None:
        """Fit the law of clean documents' best segments, P(best <= x) = exp(-K n exp(-rate x)), by maximum likelihood.

        Documents without a positive segment count as not above 0. As labels err, what lies above the quantile ``top`` counts only as
        lying above it (censored), so a few offending documents among the clean ones do not stretch the tail.
        """
        if np.count_nonzero(best > 0) < 5:
            return
        cap = float(np.quantile(best[best > 0], top))
        n = np.maximum(n, 1).astype(float)
        none, high = best <= 0, best > cap
        x, m = best[~none & ~high], n[~none & ~high]

        def loss(rate: float, log_k: float) -> float:
            k = math.exp(log_k)
            seen = np.log(k * m * rate) - rate * x - k * m * np.exp(-rate * x)
            above = np.log(np.maximum(-np.expm1(-k * n[high] * math.exp(-rate * cap)), 1e-300))
            return -(seen.sum() + above.sum() - k * n[none].sum())

        # a coarse grid, then finer ones around the best
        rates, logs = np.geomspace(0.05, 4.0, 40), np.linspace(-16.0, 2.0, 60)
        for _ in range(4):
            values = [(loss(r, k), r, k) for r in rates for k in logs]
            _, self.rate, log_k = min(values)
            i, j = int(np.argmin(np.abs(rates - self.rate))), int(np.argmin(np.abs(logs - log_k)))
            rates = np.geomspace(rates[max(0, i - 1)], rates[min(len(rates) - 1, i + 1)], 15)
            logs = np.linspace(logs[max(0, j - 1)], logs[min(len(logs) - 1, j + 1)], 15)
        self.k = math.exp(log_k)

    def chance(self, best: float, n: int) -> float:
        """Probability that a clean document of ``n`` words has a segment as good."""
        return -math.expm1(-self.k * n * math.exp(-min(600.0, self.rate * best))) if best > 0 else 1.0


def consensus(labels: DataFrame, *, key: str = "doc_id", rater: str = "rater", label: str = "toxic") -> DataFrame:
    """``key, y`` in 0..1: labels weighted by how often their rater agrees with the others on the same documents.

    Null labels tell nothing. A lone label counts by its rater's reliability.
    """
    l = labels.select(F.col(key), F.col(rater).alias("r"), F.col(label).cast("double").alias("x")).where("x is not null")  # noqa: E741
    doc = l.groupBy(key).agg(F.sum("x").alias("sx"), F.count("x").alias("m"))
    both = l.join(doc, key)
    others = (F.col("sx") - F.col("x")) / (F.col("m") - 1)
    trust = both.where("m > 1").groupBy("r").agg((F.sum(1 - F.abs(F.col("x") - others)) + 8) / (F.count("x") + 10)).toDF("r", "q")
    w = F.log(F.col("q") / (1 - F.least(F.col("q"), F.lit(0.98))))
    odds = both.join(trust, "r", "left").withColumn("q", F.coalesce("q", F.lit(0.8))).withColumn("w", F.greatest(w, F.lit(0.2)))
    return odds.groupBy(key).agg(F.sum(F.when(F.col("x") > 0, F.col("w")).otherwise(-F.col("w"))).alias("o")).select(key, (1 / (1 + F.exp(F.lit(0.4) - F.col("o")))).alias("y"))


def log_odds(counts: DataFrame, n1: float, n0: float) -> DataFrame:
    """Adds ``score``: shrunk log-odds of a feature with prior counts from both classes together and from the lexicon.

    ``counts``: ``a`` and ``b`` (null for single words), ``c1`` and ``c0`` (weighted documents with the feature).
    """
    c1, c0 = F.col("c1"), F.col("c0")
    share = (c1 + c0) / (n1 + n0)
    lex = F.when(F.col("b").isNull() & F.col("a").isin(sorted(set(LEXICON))), 0.5).otherwise(0.0)
    y1 = c1 + share * (PRIOR * n1 / (n1 + n0)) + 0.05 + lex
    y0 = c0 + share * (PRIOR * n0 / (n1 + n0)) + 0.05 * n0 / n1
    m1, m0 = n1 * (1 + PRIOR / (n1 + n0)) + 1, n0 * (1 + PRIOR / (n1 + n0)) + n0 / n1
    delta = F.log(y1 / F.greatest(m1 - y1, F.lit(0.5))) - F.log(y0 / F.greatest(m0 - y0, F.lit(0.5)))
    trust = F.least(F.lit(1.0), F.pow(F.abs(delta) / F.sqrt(1 / (y1 + 0.3) + 1 / (y0 + 0.3)) / 2.0, F.lit(2.0)))
    firm = delta * trust
    return counts.withColumn("score", F.greatest(F.lit(-1.5), F.least(F.lit(4.0), F.signum(firm) * F.greatest(F.abs(firm) - DULL, F.lit(0.0)))))


CHUNK_TEXT = re.compile(r"[0-9A-Za-z_.@$*\\\-\u0080-\U0010ffff]+")


def doc_features(texts: list[str | None], spans: list[list[tuple[int, int]]] | None = None, vocabulary: dict[str, int] | None = None) -> Iterator[tuple[int, str, str | None]]:
    """(text, word, next word or None): the distinct words and pairs of each text, or of the given spans of its words (as the vocabulary parts them)."""
    for k, t in enumerate(texts):
        seq = [x for c in CHUNK_TEXT.findall(t or "") for x in words_in(c, vocabulary or {})]
        parts = [seq] if spans is None else [seq[a:b] for a, b in spans[k]]
        for w in {w for p in parts for w in p}:
            yield k, w, None
        for p in {x for p in parts for x in zip(p, p[1:])}:
            yield k, *p


def telling(found: list[tuple[int, int, float]], least: float) -> list[tuple[int, int]]:
    """The segments with a sum of ``least`` at least."""
    return [(a, b) for a, b, x in found if x >= least]


def model_of(counts: DataFrame, n1: float, n0: float, passages: DataFrame | None = None, s1: float = 0.0) -> Model:
    """Scores from document counts; given passages, of offending documents only these count, against whole clean documents.

    So what merely surrounds offending words loses its score, and harmless use of the same words tells against them. Known words without a score and
    telling pairs make up the model that reaches the driver.
    """
    if passages is not None and s1 > 1:
        p = passages.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("c1").alias("__c1"))
        counts = counts.join(p, (F.col("a") == F.col("__a")) & F.col("b").eqNullSafe(F.col("__b")), "left").select("a", "b", "c0", F.coalesce("__c1", F.lit(0.0)).alias("c1"))
        n1 = s1
    c = log_odds(counts, n1, n0).where("b is null or abs(score) > 0.5").select("a", "b", "score").toPandas()
    single, pairs = c[c["b"].isna()], c[c["b"].notna()]
    one = dict(zip(single["a"], single["score"]))
    for w in LEXICON:
        one.setdefault(w, 2.0)
    return Model(one, {(a, b): 0.6 * s for a, b, s in zip(pairs["a"], pairs["b"], pairs["score"])})


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", passages: int = 2) -> Model:
    """Fit on the labelled documents; without any label only the lexicon counts."""
    y = consensus(labels, key=key).orderBy(F.xxhash64(key), key).limit(MAX_LABELLED)
    lab = cut(docs.select(key, text).where(F.col(text).isNotNull()).join(y, key))

    def counted(model: Model | None) -> tuple[DataFrame, float, float]:
        """Weighted documents with each feature, in the whole text or in the model's best passages; and the weights' sums."""

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = Words(model.vocabulary) if model else None
            for whole in batches:
                for b in slices(whole, text):
                    texts, spans = b.column(text).to_pylist(), None
                    if model:
                        n, ids = w.sequences(b.column(text))
                        spans = [telling(found, LEAST) for found in model.best(n, ids)]
                    f = list(doc_features(texts, spans, model and model.vocabulary))
                    f += [(k, None, None) for k in range(len(texts)) if spans is None or spans[k]]  # the document itself
                    yield pa.RecordBatch.from_arrays([b.column("y").take(pa.array([x[0] for x in f], pa.int64())), pa.array([x[1] for x in f], pa.string()), pa.array([x[2] for x in f], pa.string())], ["y", "a", "b"])

        sums = lab.mapInArrow(explode, "y double, a string, b string").groupBy("a", "b").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"), F.count("y").alias("n"))
        sums = cut(sums)
        size = sums.where("a is null").select("c1", "c0").first()
        n1, n0 = (size[0] + 1e-6, size[1] + 1e-6) if size else (1e-6, 1e-6)
        return sums.where(F.col("a").isNotNull() & ((F.col("n") >= LEAST_DOCS) if model is None else F.lit(True))), n1, n0

    whole, n1, n0 = counted(None)
    model = model_of(whole, n1, n0)
    for _ in range(passages):
        part, s1, _ = counted(model)
        model = model_of(whole, n1, n0, part, s1)

    def bests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Words(model.vocabulary)
        for whole in batches:
            for b in slices(whole, text):
                n, ids = w.sequences(b.column(text))
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array([max((s for _, _, s in found), default=0.0) for found in model.best(n, ids)], pa.float64())], ["n", "best"])

    clean = lab.where("y < 0.35").mapInArrow(bests, "n long, best double").toPandas()
    model.calibrate(clean["best"].to_numpy(), clean["n"].to_numpy())
    return model


def score(docs: DataFrame, model: Model, *, keep: list[str], text: str = "text", level: float = LEVEL) -> DataFrame:
    """``keep`` and ``score`` (-log10 of chance), ``n_segments``, ``n_words``, ``flagged`` for every document.

    Null and empty texts have score 0 and are not flagged.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double, n_segments int, n_words long, flagged boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Words(model.vocabulary)
        for whole in batches:
            for b in slices(whole, text):
                n, ids = w.sequences(b.column(text))
                best = [sorted((s for _, _, s in found), reverse=True) for found in model.best(n, ids)]
                sc = [max(0.0, -math.log10(max(model.chance(x[0], int(k)), 1e-300))) if x else 0.0 for x, k in zip(best, n)]
                hits = [sum(s >= LEAST_SUM and model.chance(s, int(k)) < level for s in x) for x, k in zip(best, n)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(sc, pa.float64()), pa.array(hits, pa.int32()), pa.array(n), pa.array([h > 0 for h in hits])], [*keep, "score", "n_segments", "n_words", "flagged"])

    return docs.select(*keep, text).mapInArrow(work, schema)

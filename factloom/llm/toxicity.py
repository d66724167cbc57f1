"""Toxicity by a linear-chain conditional random field over words.

Labels say which documents are toxic, not where, so tokens are labelled first: features (a word, its first
letters) that toxic training documents hold far more often than clean ones mark toxic tokens; all tokens of
clean documents are clean. A CRF with the states clean and toxic is then trained on these tokens with
features of the word and its neighbours. For every document forward-backward gives each token's marginal
and the probability that any token is toxic, which a logistic curve fitted on the training labels turns into
the score. Most words have no feature, and a run of them multiplies the messages by a power of one
matrix: the recursions are exact, and take steps only at words with features or beside them.

Cases: null and empty texts and texts without letters have no token and get the curve's score at no
toxicity; without training labels every score is 0.5; case does not count; texts are read whole; repeated rows get equal results; extra columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from factloom.llm.langid import fold_of

_TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features beside the whole word.
PREFIXES = (4, 5, 6)
CHUNK = 16


def features_of(word: str) -> list[str]:
    """The word, and its beginnings with a mark."""
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)]


def _clusters(docs: list[list[str]]) -> list[int]:
    """A number for each document that copies and near copies share: those that agree on half the minima of hashed shingles.

    Counted by document, the words of one text that was copied a hundred times would look like evidence.
    """
    odd = np.random.default_rng(7).integers(1 << 40, 1 << 62, 6, dtype=np.uint64) | np.uint64(1)
    seen: dict[tuple[int, int], int] = {}
    out = []
    for k, words in enumerate(docs):
        codes = np.array([zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))], np.uint64)
        lows = ((codes[:, None] + np.uint64(1)) * odd[None, :] >> np.uint64(24)).min(0).tolist()
        keys = list(enumerate(lows))
        met = Counter(seen[key] for key in keys if key in seen).most_common(1)
        mine = met[0][0] if met and met[0][1] >= 3 else k
        for key in keys:
            seen.setdefault(key, mine)
        out.append(mine)
    return out


def _select(docs: list[tuple[list[str], int]], least_docs: int = 4, least_share: float = 0.01, least_lift: float = 8.0) -> tuple[list[str], set[str]]:
    """(features of the model, those that mark a token of a toxic document as toxic), by counts of clusters."""
    toxic, clean, n = Counter(), Counter(), [0, 0]
    groups: dict[tuple[int, int], list[int]] = {}
    for k, cluster in enumerate(_clusters([w for w, _ in docs])):
        groups.setdefault((cluster, docs[k][1]), []).append(k)
    for (_, label), members in groups.items():
        n[label] += 1
        (toxic if label else clean).update({f for k in members for w in set(docs[k][0]) for f in features_of(w)})
    least = max(least_docs, least_share * n[1])
    used, marks = [], set()
    for f, a in toxic.items():
        lift = (a / max(1, n[1])) / ((clean[f] + 0.5) / max(1, n[0]))
        if a >= least and lift >= least_lift:
            used.append(f)
            if clean[f] * 20 <= a:
                marks.add(f)
    return sorted(used), marks


class Crf:
    """States 0 clean, 1 toxic. Scores: emission of state 1 (state 0 is 0) and four transitions."""

    def __init__(self, names: list[str]):
        self.index = {f: i for i, f in enumerate(names)}
        self.weight = np.zeros(len(names))  # of a feature on its own token
        self.before = np.zeros(len(names))  # of a feature on the token before
        self.after = np.zeros(len(names))
        self.bias = -4.0
        self.move = np.zeros((2, 2))
        self.curve = (0.0, 1.0)  # offset and slope of the logistic curve
        self.known = {f[:-1] if f.endswith("-") else f for f in names}

    def active(self, word: str) -> list[int]:
        return [self.index[f] for f in features_of(word) if f in self.index]

    def hits(self, words: list[str]) -> dict[int, list[int]]:
        """Features by position, of the words that have any."""
        index = self.index
        having = {w: a for w in set(words) if (a := [index[f] for f in (w, w[:4] + "-", w[:5] + "-", w[:6] + "-") if f in index and (f == w or len(w) >= len(f))])}
        return {i: having[w] for i, w in enumerate(words) if w in having} if having else {}

    def events(self, hits: dict[int, list[int]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose emission is not the bias, and their emissions."""
        score: dict[int, float] = {}
        for i, fs in hits.items():
            for at, weights in ((i, self.weight), (i + 1, self.before), (i - 1, self.after)):
                if 0 <= at < n:
                    score[at] = score.get(at, 0.0) + float(weights[fs].sum())
        at = np.array(sorted(score), np.int64)
        return at, np.array([score[i] + self.bias for i in at.tolist()])

    def prepare(self) -> None:
        """Powers 1, 2, 4, ... of a word's matrix without features, each scaled, with the log of its scale."""
        m = np.exp(self.move) * np.exp([0.0, self.bias])[None, :]
        self.powers, self.calm = [], {}
        log = 0.0
        for _ in range(40):
            top = m.max()
            m, log = m / top, log + np.log(top)
            self.powers.append((m, log))
            m, log = m @ m, 2 * log

    def _through(self, v: np.ndarray, steps: int, transposed: bool = False) -> tuple[np.ndarray, float]:
        log, k = 0.0, 0
        while steps:
            if steps & 1:
                m, scale = self.powers[k]
                v = m @ v if transposed else v @ m
                top = v.max()
                v, log = v / top, log + scale + np.log(top)
            steps >>= 1
            k += 1
        return v, log

    def infer(self, at: np.ndarray, emission: np.ndarray, n: int) -> tuple[float, np.ndarray]:
        """(log-odds that any of n tokens is toxic, marginals of state 1 at the events).

        The odds are of what the features add: what n words without features would give, which grows with a
        text's length alone, is taken off.
        """
        if not n or not len(at):
            return -np.inf, np.zeros(0)
        lost, marginals = self._messages(at, emission, n)
        added = np.clip(lost - self._calm(n), 1e-12, 700)
        return float(np.log(np.expm1(added))), marginals

    def _calm(self, n: int) -> float:
        if n not in self.calm:
            self.calm[n] = self._messages(np.zeros(0, np.int64), np.zeros(0), n)[0]
        return self.calm[n]

    def _messages(self, at: np.ndarray, emission: np.ndarray, n: int) -> tuple[float, np.ndarray]:
        """(minus the log of the probability that all n tokens are clean, marginals at the events)."""
        step = np.exp(self.move)
        # The first token has no transition: start so that one matrix step gives its emission alone.
        first = int(at[0]) if len(at) else n
        v, log = (np.array([1.0, np.exp(self.bias)]), 0.0) if first else (np.array([1.0, np.exp(emission[0])]), 0.0)
        forward = []
        place = 0
        for j, (i, e) in enumerate(zip(at.tolist(), emission.tolist(), strict=True)):
            if i:
                v, more = self._through(v, i - place - 1)
                v = (v @ step) * np.array([1.0, np.exp(e)])
                top = v.max()
                v, log = v / top, log + more + np.log(top)
            place = i
            forward.append(v)
        last, more = self._through(v, n - 1 - place)
        whole = log + more + np.log(last.sum())
        clean = (n - 1) * self.move[0, 0]
        marginals = np.zeros(len(at))
        back = np.ones(2)
        place = n - 1
        for j in range(len(at) - 1, -1, -1):
            i = int(at[j])
            back, _ = self._through(back, place - i if j == len(at) - 1 else place - i - 1, transposed=True)
            joint = forward[j] * back
            marginals[j] = joint[1] / joint.sum()
            back = step @ (np.array([1.0, np.exp(emission[j])]) * back)
            back = back / back.max()
            place = i
        return float(whole - clean), marginals

    def score(self, odds: float) -> float:
        offset, slope = self.curve
        return float(1 / (1 + np.exp(-np.clip(offset + slope * np.clip(odds, -10, 30), -40, 40))))


def train(texts: list[tuple[str, int]], rounds: int = 100, decay: float = 1e-3, calm: int = 20) -> Crf:
    """Fit the CRF by gradient steps on chunks of CHUNK tokens; chunks without features are sampled, 1 in calm."""
    same: dict[str, str] = {}  # one string for each word: the driver holds the sample's words once
    docs = [([same.setdefault(w, w) for w in _TOKEN.findall(t.lower())], y) for t, y in texts]
    names, marks = _select(docs)
    crf = Crf(names)
    rows, gold, weight = [], [], []
    count = 0
    for words, y in docs:
        for a in range(0, len(words), CHUNK):
            part = words[a : a + CHUNK]
            feats = [crf.active(w) for w in part]
            count += 1
            if any(feats) or count % calm == 0:
                rows.append(feats)
                gold.append([int(bool(y) and any(f in marks for f in features_of(w))) for w in part])
                weight.append(1.0 if any(feats) else float(calm))
    if rows and names:
        _descend(crf, rows, gold, np.array(weight), rounds, decay)
    crf.prepare()
    odds, labels = [], []
    for words, y in docs:
        at, emission = crf.events(crf.hits(words), len(words))
        odds.append(np.clip(crf.infer(at, emission, len(words))[0], -10, 30))
        labels.append(y)
    crf.curve = _logistic(np.array(odds), np.array(labels, float))
    return crf


def _descend(crf: Crf, rows: list, gold: list, weight: np.ndarray, rounds: int, decay: float) -> None:
    n, k = len(rows), len(crf.index)
    size = np.array([len(r) for r in rows])
    y = np.zeros((n, CHUNK), np.int64)
    triples = {"weight": [], "before": [], "after": []}
    for i, (r, g) in enumerate(zip(rows, gold, strict=True)):
        y[i, : len(g)] = g
        for j, fs in enumerate(r):
            for f in fs:
                triples["weight"].append((i * CHUNK + j, f))
                if j + 1 < len(r):
                    triples["before"].append((i * CHUNK + j + 1, f))
                if j:
                    triples["after"].append((i * CHUNK + j - 1, f))
    triples = {name: np.array(t, np.int64).reshape(-1, 2) for name, t in triples.items()}
    inside = np.arange(CHUNK)[None, :] < size[:, None]
    total = (weight[:, None] * inside).sum()
    values = {"weight": crf.weight, "before": crf.before, "after": crf.after, "bias": np.array([crf.bias]), "move": crf.move}
    speed = {name: np.zeros_like(v) for name, v in values.items()}
    for _ in range(rounds):
        emission = np.zeros(n * CHUNK)
        for name in ("weight", "before", "after"):
            np.add.at(emission, triples[name][:, 0], values[name][triples[name][:, 1]])
        emission = emission.reshape(n, CHUNK) + values["bias"][0]
        step = np.exp(values["move"])
        e = np.stack([np.ones((n, CHUNK)), np.exp(np.clip(emission, -30, 30))], 2)
        f, b = np.zeros((n, CHUNK, 2)), np.ones((n, CHUNK, 2))
        f[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for j in range(1, CHUNK):
            v = (f[:, j - 1] @ step) * e[:, j]
            f[:, j] = np.where(inside[:, j, None], v / v.sum(1, keepdims=True), f[:, j - 1])
        for j in range(CHUNK - 2, -1, -1):
            v = (e[:, j + 1] * b[:, j + 1]) @ step.T
            b[:, j] = np.where(inside[:, j + 1, None], v / v.sum(1, keepdims=True), 1.0)
        post = f * b
        post = post / post.sum(2, keepdims=True)
        miss = (y - post[:, :, 1]) * inside * weight[:, None]
        grad = {"bias": np.array([miss.sum()])}
        for name in ("weight", "before", "after"):
            grad[name] = np.bincount(triples[name][:, 1], miss.ravel()[triples[name][:, 0]], minlength=k)
        pair = f[:, :-1, :, None] * step[None, None] * (e[:, 1:] * b[:, 1:])[:, :, None, :]
        pair = pair / pair.sum((2, 3), keepdims=True)
        real = np.zeros_like(pair)
        np.put_along_axis(real.reshape(n, CHUNK - 1, 4), (2 * y[:, :-1] + y[:, 1:])[:, :, None], 1.0, 2)
        grad["move"] = ((real - pair) * (inside[:, 1:] * weight[:, None])[:, :, None, None]).sum((0, 1))
        for name, v in values.items():
            g = grad[name] / total - decay * v * (name not in ("bias",)) / 100
            speed[name] += g**2
            v += 1.0 * g / np.sqrt(speed[name] + 1e-12)
    crf.bias = float(values["bias"][0])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method for one input, with a light pull of the slope to 0 and smoothed labels."""
    if not len(x):
        return 0.0, 0.0
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t = np.where(y > 0, hi, lo)
    beta = np.array([np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), 0.1])
    z = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        g = z.T @ (t - p) - np.array([0.0, 1e-3]) * beta
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-6, 1e-3])
        move = np.linalg.solve(h, g)
        size = np.abs(move).max()
        beta = beta + move * min(1.0, 2.0 / max(size, 1e-9))
        if size < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def training_texts(docs: DataFrame, labels: DataFrame, per_label: int = 1500, longest: int = 50_000) -> list[tuple[str, int]]:
    """Up to per_label training documents of each label, chosen by a hash of doc_id, none over `longest` characters.

    This sample is the only bounded thing: per_label and longest bound what the driver holds, also where many rows
    share a labelled doc_id (their texts then count towards per_label).
    """
    usable = labels.where((fold_of(3) != 1) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    order = F.xxhash64("doc_id")
    picked = usable.where("toxic = 1").orderBy(order, "doc_id").limit(per_label).union(usable.where("toxic = 0").orderBy(order, "doc_id").limit(per_label))
    texts = docs.select("doc_id", "text").where(F.char_length("text") <= longest).join(F.broadcast(picked), "doc_id")
    # Each task keeps its first per_label rows of a label before any of them moves.
    first = F.row_number().over(W.partitionBy("toxic").orderBy(order, "doc_id", F.xxhash64("text"), "text"))
    texts = texts.withColumn("_n", first).where(F.col("_n") <= per_label)
    return [(r.text, r.toxic) for r in texts.select("text", "toxic").orderBy(F.xxhash64("text"), "text", "toxic").collect()]


RESULT = T.StructType(
    [
        T.StructField("toxic_score", T.DoubleType()),
        T.StructField("toxic_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("p", T.DoubleType())]))),
    ]
)


def tag(docs: DataFrame, crf: Crf, least: float = 0.5) -> DataFrame:
    """docs with toxic_score and toxic_spans (character offsets of tokens with a marginal of `least` or more)."""
    schema = T.StructType([*(f for f in docs.schema.fields if f.name not in RESULT.names), *RESULT.fields])
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        none = model.score(-np.inf)
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("text").to_pylist():
                words = _TOKEN.findall(text.lower()) if text else []
                hits = model.hits(words)
                if not hits:
                    scores.append(none)
                    spans.append([])
                    continue
                found = [(m.start(), m.end(), m.group().lower()) for m in _TOKEN.finditer(text)]
                words = [f[2] for f in found]
                at, emission = model.events(model.hits(words), len(words))
                odds, marginals = model.infer(at, emission, len(words))
                scores.append(model.score(odds))
                spans.append([{"start": found[i][0], "stop": found[i][1], "p": p} for i, p in zip(at.tolist(), marginals.tolist(), strict=True) if p >= least])
            keep = [n for n in batch.schema.names if n not in RESULT.names]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(scores, pa.float64()), pa.array(spans, span)], [*keep, *RESULT.names])

    return docs.mapInArrow(run, schema)


def op2_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7), n_spans."""
    crf = train(training_texts(docs, labels))
    tagged = tag(docs.select("doc_id", (fold_of(3) == 1).alias("held_out"), "text"), crf)
    return tagged.select(
        "doc_id", "held_out", F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans")
    )

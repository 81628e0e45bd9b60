"""Abusive, hateful or sexual content: non-negative positive-unlabelled learning over sentences.

Confirmed documents (moderation labels) and unlabelled ones train a linear model with numpy. As one sentence
makes a document abusive, the model learns from sentences: of each confirmed document only the sentences it
finds most telling stay positive, and it is trained again on them. The risk is the non-negative
estimator R = p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)]), whose class prior p is the share of positive sentences
in unlabelled text, estimated between the rounds. Documents confirmed clean join the unlabelled side and a
second term holds their sentences negative.

The model is a sum over words, their letter groups and word pairs, so scoring needs only sums of cached
scores. Words are normalised first: look-alike letters, digits and signs for letters, hidden
characters, spread and repeated letters.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the hashed model; bounds of the training sample in documents.
DIM, MAX_POSITIVE, MAX_NEGATIVE, MAX_UNLABELLED = 1 << 17, 3_000, 8_000, 16_000
ROUNDS, STEPS, RATE, DECAY, THRESHOLD = 2, 240, 0.05, 2e-5, 0.5
#: Share of the unlabelled and clean sentences in one step; words with no letter groups, as they are common.
BATCH, COMMON = 8, 2_000
FOLDS, PRIOR_LEAST, NEAR_BEST = 2, 4e-3, 0.99
#: Look-alike letters of other scripts: fixed values.
ALIKE = str.maketrans("аеорсухіјѕԁһкмтвнгпАЕОРСУХІЈЅКМТВНαεικνορτυχßłøı", "aeopcyxijsdhkmtbhrnAEOPCYXIJSKMTBHaeiknoptuxslo" + "i")
#: Digits and signs that stand for letters within words: fixed values.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e", "|": "l", "+": "t"})
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤⁪-⁯︀-️﻿]")
_MENTION = re.compile(r"(?<![\w.])@[A-Za-z_][\w.\-]*")
_CODE = re.compile(r"\b(?:\w{4,}_\w{4,}|\w*_\w+_\w*|\w+\d\w*_\w*|_\w+|\w+_)\b|\b[A-Z]{2,}-[A-Z0-9-]+\b|\b[0-9a-f]{7,40}\b(?<=[0-9])")
_SPREAD = re.compile(r"(?<!\w)[^\W\d_](?:(?:[.\-_*·•][^\W\d_]){3,}|(?: [^\W\d_]){3,})(?!\w)")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+|\n+|(?<=\w): +")
_TOKEN = re.compile(r"[^\W_]+(?:[*@$!|+#_][^\W_]+)*[*]*|[@§~]\w+|[\"“”«»„`?]")
_REPEAT = re.compile(r"(.)\1{2,}")
_PIECE_WORDS = 30


def fold(text: str) -> str:
    """Look-alikes, hidden characters and accents away."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", _HIDDEN.sub("", text).translate(ALIKE))
    return "".join(c for c in text if not unicodedata.combining(c)).translate(ALIKE)


def _plain(word: str) -> str:
    if word.isalpha():
        w = word
    elif word.isdigit():
        return "0"
    elif sum(c.isalpha() for c in word) * 2 >= len(word) or word[0].isalpha():
        w = word.translate(LEET)
    else:
        return "0"
    w = w.lower()
    return _REPEAT.sub(r"\1", w) if len(w) > 3 else w


def sentences(text: str) -> list[list[str]]:
    """The normalised words of each sentence; long ones in pieces."""
    out: list[list[str]] = []
    carried: list[str] = []
    text = fold(text)
    text = _SPREAD.sub(lambda m: re.sub(r"[.\-_*·• ]", "", m[0]), text)
    for part in _SPLIT.split(text):
        if not part:
            continue
        part = _CODE.sub(" ~id ", _MENTION.sub(" @u ", part))
        words = [sys.intern(w if (w[0] in "@~§" or not w[0].isalnum()) else _plain(w)) for w in _TOKEN.findall(part)]
        for i in range(0, len(words), _PIECE_WORDS):
            piece = [*carried, *words[i : i + _PIECE_WORDS]]
            carried = []
            if sum(w[0].isalpha() for w in piece) < 3:
                carried = piece  # a lone word belongs to what follows
            else:
                out.append(piece)
    if any(w[0].isalpha() for w in carried):
        out.append(carried) if not out else out[-1].extend(carried)
    return out


def _h(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % DIM


def word_features(w: str, common: frozenset[str] = frozenset()) -> list[int]:
    if len(w) < 4 or not w[0].isalpha() or w in common:
        return [_h("w " + w)]
    padded = f"<{w}>"
    return [_h("w " + w), *(_h("c " + padded[i : i + 4]) for i in range(len(padded) - 3))]


def features(words: list[str], common: frozenset[str]) -> list[int]:
    f = [x for w in words for x in word_features(w, common)]
    f += [_h(f"p {a} {b}") for a, b in zip(["^", *words], [*words, "$"], strict=True)]
    f += [_h(f"s {a} {b}") for a, b in zip(words, words[2:], strict=False)]
    return f


class Model:
    def __init__(self, weights: np.ndarray, bias: float, prior: float, common: frozenset[str] = frozenset()):
        self.weights, self.bias, self.prior, self.common = weights, bias, prior, common
        self.words: dict[str, float] = {}
        self.pairs: dict[tuple[str, str], float] = {}
        self.skips: dict[tuple[str, str], float] = {}

    def sentence(self, words: list[str]) -> float:
        """The logit of a sentence."""
        total, w, cw, cp, cs = self.bias, self.weights, self.words, self.pairs, self.skips
        for x in words:
            s = cw.get(x)
            if s is None:
                s = cw[x] = float(sum(w[i] for i in word_features(x, self.common)))
            total += s
        for p in zip(["^", *words], [*words, "$"], strict=True):
            s = cp.get(p)
            if s is None:
                s = cp[p] = float(w[_h(f"p {p[0]} {p[1]}")])
            total += s
        for p in zip(words, words[2:], strict=False):
            s = cs.get(p)
            if s is None:
                s = cs[p] = float(w[_h(f"s {p[0]} {p[1]}")])
            total += s
        if len(cp) > 2_000_000:  # the caches are bounded, whatever the vocabulary
            cp.clear()
            cs.clear()
            cw.clear()
        return total

    def document(self, text: str | None) -> float:
        """Probability that some sentence is abusive; 0 for an empty or missing text."""
        best = max((self.sentence(s) for s in sentences(text)), default=-50.0) if text else -50.0
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, best)))) if best > -50 else 0.0


class _Rows:
    """Sentences as flat feature lists."""

    def __init__(self, lists: Iterable[list[int]]):
        features_, begin = array("i"), array("q", [0])
        for x in lists:
            features_.extend(x)
            begin.append(len(features_))
        self.n = len(begin) - 1
        self.begin = np.frombuffer(begin, dtype=np.int64)
        self.feature = np.frombuffer(features_, dtype=np.int32) if features_ else np.empty(0, np.int32)

    def part(self, k: int, of: int) -> _Rows:
        """The k-th of so many parts; a view."""
        a, b = self.n * k // of, self.n * (k + 1) // of
        out = _Rows([])
        out.n, lo, hi = b - a, self.begin[a], self.begin[b]
        out.begin, out.feature = self.begin[a : b + 1] - lo, self.feature[lo:hi]
        return out

    def _index(self) -> np.ndarray:
        return np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.begin))

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self._index(), weights=w[self.feature], minlength=self.n) + b

    def gradient(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.feature, weights=np.repeat(g, np.diff(self.begin)), minlength=DIM)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit(pos: _Rows, unl: _Rows, neg: _Rows, weight: np.ndarray, prior: float, start: tuple[np.ndarray, float] | None) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk; weight counts each positive sentence."""
    w, b = (start[0].copy(), start[1]) if start else (np.zeros(DIM), -2.0)
    m, v, mb, vb = np.zeros(DIM), np.zeros(DIM), 0.0, 0.0
    pw = weight / max(1e-9, weight.sum())
    cut = min(BATCH, max(1, unl.n // 200))
    parts = [(unl.part(k, cut), neg.part(k, cut)) for k in range(cut)]
    for t in range(1, STEPS + 1):
        some, clean = parts[t % cut]
        fp, fu, fn = pos.scores(w, b), some.scores(w, b), clean.scores(w, b)
        sp, su, sn = _sigmoid(fp), _sigmoid(fu), _sigmoid(fn)
        rest = np.mean(np.logaddexp(0, fu)) - prior * float(pw @ np.logaddexp(0, fp))
        gp = prior * pw * (sp - 1)
        gu = np.zeros(some.n)
        if rest >= 0:
            gu, gp = su / max(1, some.n), gp - prior * pw * sp
        gn = (1 - prior) * sn / max(1, clean.n) if clean.n else np.zeros(0)
        # the scale of the risk is that of the prior: all terms grow alike
        k = 1 / prior
        g = k * (pos.gradient(gp) + some.gradient(gu) + clean.gradient(gn)) + DECAY * w
        gb = k * (gp.sum() + gu.sum() + gn.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = RATE * math.sqrt(1 - 0.999**t) / (1 - 0.9**t) * min(1.0, 2 * (1 - t / (STEPS + 1)))
        w -= step * m / (np.sqrt(v) + 1e-8)
        b -= step * mb / (math.sqrt(vb) + 1e-8)
    return w, b


def confirmed(known: list[list], models: list[Model]) -> list[list]:
    """The documents labelled clean without the sentences that a model which has not seen the document finds abusive: reviewers err both ways."""
    wrong = {tuple(s) for k, m in enumerate(models) for b in known[k :: len(models)] for s in b if m.sentence(s) >= 0}
    return [[s for s in b if tuple(s) not in wrong] for b in known]


def _learn(bags: list[list], known: list[list], unl: _Rows, common: frozenset[str], whole: Local | Spread) -> tuple[np.ndarray, float, float, frozenset[str]]:
    """Weights, bias and class prior from bags of positive sentences and of those of clean documents; the prior is a share of all sentences of whole."""
    clean = {tuple(s) for b in known for s in b}
    neg = _Rows(features(list(s), common) for s in sorted(clean))
    every = [s for b in bags for s in b]
    pos = _Rows(features(s, common) for s in every)
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    # a sentence that is also in clean documents tells nothing
    known = np.array([tuple(s) in clean for s in every])
    weight = np.where(known, 0.0, 1.0 / np.array([len(b) for b in bags])[bag])
    if not weight.any():
        weight[:] = 1.0
    prior, state, chosen = 0.02, None, pos
    for _ in range(ROUNDS):
        state = _fit(chosen, unl, neg, weight[weight > 0], prior, state) if chosen is not pos else _fit(pos, unl, neg, weight, prior, state)
        f = pos.scores(*state)
        f[known] = -1e9
        best = np.full(len(bags), -1e9)
        np.maximum.at(best, bag, f)
        # the most telling sentence of each document, and others nearly as telling; documents without one were labelled by mistake
        weight = ((f >= best[bag] - 1.0) & (best[bag] > np.quantile(best, 0.5) - 6.0)).astype(float)
        if not weight.any():
            weight = (f >= best[bag]).astype(float)
        prior = float(np.clip(2 * whole.share(Model(*state, prior, common), float(np.median(f[weight > 0]))), PRIOR_LEAST, 0.1))
        chosen = _Rows(features(every[i], common) for i in np.flatnonzero(weight))
    return (*_fit(chosen, unl, neg, weight[weight > 0], prior, state), prior, common)


class Local:
    """All unlabelled documents in this process: seen ones may train, unseen ones never do."""

    def __init__(self, seen: list[list], unseen: list[list]):
        self.seen, self.unseen = seen, unseen

    def training(self) -> Iterable[list]:
        return self.seen

    def frequent(self, least: int) -> dict[str, int]:
        """Words of at least so many documents, with their number."""
        count: dict[str, int] = {}
        for b in (*self.seen, *self.unseen):
            for w in {w for s in b for w in s}:
                count[w] = count.get(w, 0) + 1
        return {w: n for w, n in count.items() if n >= least}

    def share(self, model: Model, cut: float) -> float:
        """The share of sentences at or above cut."""
        f = [model.sentence(s) >= cut for b in (*self.seen, *self.unseen) for s in b]
        return sum(f) / max(1, len(f))

    def tops(self, models: list[Model]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each model the distinct logits of the unseen documents, falling, and how many have each."""
        out = []
        for m in models:
            u, n = np.unique([_grid(max(m.sentence(s) for s in b)) for b in self.unseen], return_counts=True)
            out.append((u[::-1] * GRID, n[::-1]))
        return out


class Spread:
    """All documents of a table. Those up to a place in the order of hashes may train, the others never do; only counts reach the driver."""

    def __init__(self, documents: DataFrame, most: int):
        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = ["\n".join(" ".join(s) for s in sentences(t) if s) for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.string())], names=["h", "i", "words"])

        src = documents.select(F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("string").alias("i"), "text").where("text <> ''")
        # reading the text is most of the work: the words are kept on disk for the passes of one fit
        self.parsed = src.mapInArrow(parse, "h long, i string, words string").where("words <> ''").persist(StorageLevel.DISK_ONLY)
        n = min(most, self.parsed.count() * 3 // 4)
        last = self.parsed.select("h", "i").orderBy("h", "i").limit(n).agg(F.max(F.struct("h", "i")).alias("m")).first()["m"] if n else None
        self.is_seen = (F.struct("h", "i") <= F.struct(F.lit(last["h"]).alias("h"), F.lit(last["i"]).alias("i"))) if last else F.lit(False)

    def close(self) -> None:
        self.parsed.unpersist()

    def training(self) -> Iterable[list]:
        for r in self.parsed.where(self.is_seen).orderBy("h", "i").select("words").toLocalIterator():
            yield _parsed(r["words"])

    def _models(self, models: list[Model]):
        return self.parsed.sparkSession.sparkContext.broadcast([(m.weights.astype(np.float32), m.bias, m.prior, m.common) for m in models])

    def frequent(self, least: int) -> dict[str, int]:
        words = self.parsed.select(F.explode(F.array_distinct(F.split("words", "[ \n]"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
        # letter order breaks ties, as in train; no more than COMMON words are wanted
        return {r["w"]: r["n"] for r in words.where(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(COMMON).collect()}

    def share(self, model: Model, cut: float) -> float:
        shared = self._models([model])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Model(*shared.value[0])
            for batch in batches:
                f = [own.sentence(s) >= cut for t in batch.column(0).to_pylist() for s in _parsed(t)]
                yield pa.RecordBatch.from_arrays([pa.array([sum(f)], pa.int64()), pa.array([len(f)], pa.int64())], names=["a", "n"])

        row = self.parsed.select("words").mapInArrow(count, "a long, n long").agg(F.sum("a"), F.sum("n")).first()
        return (row[0] or 0) / max(1, row[1] or 0)

    def tops(self, models: list[Model]) -> list[tuple[np.ndarray, np.ndarray]]:
        shared = self._models(models)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [Model(*x) for x in shared.value]
            for batch in batches:
                got: dict[tuple[int, int], int] = {}
                for t in batch.column(0).to_pylist():
                    b = _parsed(t)
                    for k, m in enumerate(own):
                        x = (k, _grid(max(m.sentence(s) for s in b)))
                        got[x] = got.get(x, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([k for k, _ in got], [u for _, u in got], list(got.values()))], names=["k", "u", "n"])

        rows = self.parsed.where(~self.is_seen).select("words").mapInArrow(count, "k long, u long, n long").groupBy("k", "u").agg(F.sum("n").alias("n")).collect()
        out = []
        for k in range(len(models)):
            own = sorted(((r["u"], r["n"]) for r in rows if r["k"] == k), reverse=True)
            out.append((np.array([u for u, _ in own]) * GRID, np.array([n for _, n in own], dtype=np.int64)))
        return out


def _parsed(words: str) -> list[list[str]]:
    return [s.split(" ") for s in words.split("\n")]


#: Logits are counted on a grid of this width, within 50 of 0.
GRID = 0.002


def _grid(x: float) -> int:
    return round(min(50.0, max(-50.0, x)) / GRID)


def _recall(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The share of scores above each cut; a score counts gradually over about one logit, so that single documents make no steps."""
    parts = np.array_split(cuts, max(1, len(cuts) * len(scores) // 1_000_000))
    return np.concatenate([_sigmoid(scores[:, None] - c).mean(0) for c in parts])


def _best_cut(recall: np.ndarray, number: np.ndarray) -> int:
    """Where recall^2 / number is best; of places about as good the last."""
    worth = recall**2 / number
    return int(np.flatnonzero(worth >= NEAR_BEST * worth.max())[-1])


def train(positive: list[str], negative: list[str], unlabelled: list[str] | Spread) -> Model:
    """The model of the samples. Without any positive document nothing scores above 0.

    At least a quarter of the unlabelled documents never trains, and all of them that the sample leaves out. Cross-fitting finds how many of them to flag: the number k that
    maximises r^2 / k, the squared recall among confirmed documents unseen by the model over the number flagged,
    which needs no negative examples; of numbers about as good the largest. The bias then puts the cut of the final model, at a probability of one
    half, below its k-th of these documents. Word frequencies and the class prior are of all documents.
    """
    split = lambda ts: [b for b in ([s for s in sentences(t) if s] for t in ts) if b]
    bags = split(positive)
    if not bags:
        return Model(np.zeros(DIM), -30.0, 0.0)
    if isinstance(unlabelled, list):
        free = split(unlabelled)
        unlabelled = Local(free[len(free) // 4 :], free[: len(free) // 4])
    whole = unlabelled
    # letter groups are for words that the unlabelled text hardly knows
    common = frozenset(sorted((count := whole.frequent(20)), key=lambda w: (-count[w], w))[:COMMON])
    known = split(negative)
    unl = _Rows(features(s, common) for b in whole.training() for s in b)
    unl = unl if unl.n else _Rows([[0]])
    top = lambda model, bs: np.array([_grid(max(model.sentence(s) for s in b)) * GRID for b in bs])
    folds = min(FOLDS, len(bags))
    others = lambda bs, k: [b for i, b in enumerate(bs) if i % folds != k]
    models = [Model(*_learn(others(bags, k), others(known, k), unl, common, whole)) for k in range(folds if folds > 1 else 0)]
    weights, bias, prior, _ = _learn(bags, confirmed(known, models), unl, common, whole)
    *fold_tops, (u, n) = whole.tops([*models, Model(weights, bias, prior, common)])
    number = np.cumsum(n)
    if models and len(number):
        # recall of each fold at each rank where its own scores or those of another step
        ranks = np.unique(np.concatenate([np.cumsum(m) for _, m in fold_tops] + [number]))
        recall = np.zeros(len(ranks))
        for k, (model, (v, m)) in enumerate(zip(models, fold_tops, strict=True)):
            at = np.minimum(np.searchsorted(np.cumsum(m), ranks), len(v) - 1)
            recall += _recall(top(model, bags[k::folds]), v[at]) / folds
        if recall.any():
            k = int(np.searchsorted(number, ranks[_best_cut(recall, ranks)]))
            bias -= (u[k] + u[k + 1]) / 2 if k + 1 < len(u) else u[k]
    return Model(weights, bias, prior, common)


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, abusive: the majority of the reviews of each document; ties and nulls are left out."""
    votes = labels.where(F.col("abusive").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("abusive").alias("a"))
    votes = votes.where(F.col("a") != 0.5).select("doc_id", (F.col("a") > 0.5).alias("abusive"))
    return documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(votes, "doc_id")


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Weights from bounded samples, MAX_POSITIVE and MAX_NEGATIVE labelled and MAX_UNLABELLED unlabelled documents, by hash of doc_id; the rest from all."""
    order = F.xxhash64("doc_id")
    known = labelled(documents, labels)
    take = lambda df, n: [r["text"] for r in df.orderBy(order, "doc_id").limit(n).select("text").collect()]
    positive, negative = take(known.where("abusive"), MAX_POSITIVE), take(known.where("not abusive"), MAX_NEGATIVE)
    if not positive:
        return train([], negative, [])
    whole = Spread(documents, MAX_UNLABELLED)
    try:
        return train(positive, negative, whole)
    finally:
        whole.close()


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, source, score: one row for each row of documents, no shuffle. Empty and null texts score 0."""
    shared = documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.prior, model.common))
    src = documents.select("doc_id", "source", "text")
    held: list[Model] = []

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Model(*shared.value))
        for batch in batches:
            s = [held[0].document(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, type=pa.float64())], names=["doc_id", "source", "score"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(judge, f"doc_id {kind}, source string, score double")


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """By source: documents, flagged ones, their share and the mean score."""
    flagged = F.count_if(F.col("score") >= threshold)
    return scored.groupBy("source").agg(
        F.count("*").alias("documents"), flagged.alias("flagged"), (flagged / F.count("*")).alias("rate"), F.avg("score").alias("mean_score")
    )

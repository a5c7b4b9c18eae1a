"""Operator 7: toxicity by a subsequence string kernel, a support vector machine and Nyström landmarks.

Words are compared by their common subsequences of two and three characters, with gaps at a cost, so gapped and padded
spellings of an insult stay near it. A linear machine over Nyström features of landmark words is trained on labelled texts,
each of which is as bad as its worst word; a document is scored by its worst words and by how many are bad. The kernel has explicit features, so the trained machine folds into one table of
weights by subsequence and texts are scored in a few passes over their characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Character classes: 0 is the border of a word, 1 to 26 a to z, then accented letters and all other letters.
CLASSES = 40
#: Subsequences as distances from their first character; every skipped character costs a factor of DECAY.
PAIRS = (1, 2, 3)
TRIPLES = tuple((a, b) for b in range(2, 6) for a in range(1, b))
DECAY, PAIR_WEIGHT = 0.6, 0.3
#: Labelled rows that training reads: at most so many of each label, each of at most so many bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 1 << 16
LANDMARKS = 96
PIECE = 1 << 18
SPACED = re.compile(r"(?<!\S)[^\W\d_](?:\s[^\W\d_]){2,}(?!\S)")


def _alphabet() -> np.ndarray:
    """Code of every code point below 0x250: a class, 0 for white space, -1 for what is dropped (punctuation)."""
    codes = np.full(0x250, -1, np.int16)
    looks_like = dict(zip("0134578@$!", "oieastbasi", strict=True))
    for point in range(0x250):
        c = looks_like.get(chr(point), chr(point)).lower()[:1]
        if chr(point).isspace():
            codes[point] = 0
        elif "a" <= c <= "z":
            codes[point] = ord(c) - 96
        elif c.isalpha():
            codes[point] = 27 + ord(c) % (CLASSES - 28)
    return codes


ALPHABET = _alphabet()


def encode(text: str) -> np.ndarray:
    """Character classes of a text, words between borders; punctuation inside words goes, spaced-out words are joined."""
    if SPACED.search(text):
        text = SPACED.sub(lambda m: re.sub(r"\s", "", m[0]), text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < 0x250, ALPHABET[np.minimum(points, 0x24F)], CLASSES - 1)
    codes = codes[codes >= 0]
    border = codes == 0
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(border[1:] & border[:-1])
    return np.concatenate([[0], codes[keep], [0], [0] * 6]).astype(np.int32)


def grams(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each shape of subsequence: its feature numbers from every place, where it stays inside a word, its weight."""
    n = len(codes) - 6
    borders = np.nonzero(codes[:n] == 0)[0].astype(np.int32)
    room = np.zeros(n, np.int32)  # distance to the border that ends the word; a border begins the word after it
    room[: borders[-1]] = np.repeat(borders[1:], np.diff(borders)) - np.arange(borders[-1], dtype=np.int32)
    inside = [room >= d for d in range(6)]
    once, twice = codes * CLASSES, codes * CLASSES**2
    for d in PAIRS:
        yield CLASSES**3 + once[:n] + codes[d : d + n], inside[d], PAIR_WEIGHT * DECAY ** (d - 1)
    for a, b in TRIPLES:
        yield twice[:n] + once[a : a + n] + codes[b : b + n], inside[b], DECAY ** (b - 2)


FEATURES = CLASSES**3 + CLASSES**2


def sizes(lengths: np.ndarray) -> np.ndarray:
    """The scale of a word: the root of its squared weights, were all its subsequences different."""
    squared = np.zeros(len(lengths))
    for d in PAIRS:
        squared += np.maximum(lengths + 2 - d, 0) * (PAIR_WEIGHT * DECAY ** (d - 1)) ** 2
    for _, b in TRIPLES:
        squared += np.maximum(lengths + 2 - b, 0) * DECAY ** (2 * (b - 2))
    return np.sqrt(np.maximum(squared, 1e-12))


def word_features(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and scaled values of one word."""
    codes = encode(word)
    parts = [(f[ok], np.full(int(ok.sum()), w)) for f, ok, w in grams(codes)]
    length = np.array([int((codes[: len(codes) - 6] != 0).sum())])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]) / sizes(length)[0]


def basis_of(landmarks: list[str]) -> np.ndarray:
    dense = np.zeros((FEATURES, len(landmarks)), np.float32)
    for k, word in enumerate(landmarks):
        np.add.at(dense[:, k], *word_features(word))
    return dense


def apply(words: list[str], table_: np.ndarray) -> np.ndarray:
    """The products of the words' features with the columns of a table of features."""
    out = np.empty((len(words), table_.shape[1]))
    for at in range(0, len(words), 1000):
        some = words[at : at + 1000]
        codes = encode(" ".join(some))
        starts = np.nonzero(codes[: len(codes) - 6] == 0)[0]
        sums = np.zeros((len(codes) - 6, table_.shape[1]), np.float32)
        for f, ok, w in grams(codes):
            sums[ok] += np.float32(w) * table_[f[ok]]
        out[at : at + len(some)] = np.add.reduceat(sums, starts, axis=0)[:-1] / sizes(np.diff(starts) - 1)[:, None]
    return out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The normalised subsequence kernel of all words with all landmarks. Words are letters only, three or more."""
    return apply(words, basis_of(landmarks))


@dataclass
class ToxicModel:
    weights: np.ndarray  # by feature
    bias: float
    calibration: np.ndarray  # logistic weights of the document features

    def word_scores(self, text: str) -> np.ndarray:
        """Margins of the words of a text (a border between pieces falls on white space)."""
        out = [np.empty(0)]
        at = 0
        while at < len(text):
            end = at + PIECE
            while end < len(text) and not text[end].isspace():
                end += 1
            codes = encode(text[at:end])
            n = len(codes) - 6
            border = codes[:n] == 0
            sums = np.zeros(n, np.float32)
            for features, inside, weight in grams(codes):
                sums += np.float32(weight) * self.weights[features] * inside
            starts = np.nonzero(border)[0]
            lengths = np.diff(starts) - 1
            if len(lengths):
                totals = np.add.reduceat(sums, starts)[:-1]
                out.append((totals / sizes(lengths) + self.bias)[lengths >= 3])
            at = end
        return np.concatenate(out)

    def features(self, text: str | None) -> np.ndarray:
        """What the calibration reads of a text: its worst words, how many are bad, and its length."""
        scores = self.word_scores(text or "")
        n = len(scores)
        worst = np.full(5, -2.0)
        worst[: min(5, n)] = np.sort(np.partition(scores, max(0, n - 5))[-5:])[::-1]
        worst = np.clip(worst, -2, 2)
        bad = int((scores > 0).sum())
        return np.array([1.0, worst[0], worst[1], worst.mean(), np.log1p(bad), np.log((bad + 0.2) / (n + 20)) / 4, np.log1p(n) / 10])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.calibration, -30, 30))))


def words_in(text: str) -> set[str]:
    found = set(re.findall(r"[^\W\d_]{3,32}", text.lower()))
    return found | {w for m in SPACED.findall(text.lower()) if 3 <= len(w := re.sub(r"\s", "", m)) <= 32}


def solve_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """A linear machine with squared hinge loss, by Newton steps; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        on = y * (x @ w) < 1
        xs, ws = x[on], weight[on] * c
        new = np.linalg.solve(np.eye(len(w)) + xs.T @ (xs * ws[:, None]), xs.T @ (ws * y[on]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def solve_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = 5) -> ToxicModel:
    """The machine, trained on labelled texts, then its calibration on them.

    A text is toxic if some word of it is, so the machine and the toxic texts' witnesses are found in turn: witnesses are
    the word of a toxic text that the machine scores highest and up to four more that it takes for bad; against them stand
    the two words of every clean text that it scores highest, and all that stood there before. The first witnesses are the words whose share of the toxic texts is
    largest against that of the clean ones; these and frequent words are the landmarks, spread out by the kernel.
    """
    bags = [sorted(words_in(t)) for t in texts]
    positive, negative, met = Counter(), Counter(), set()
    for bag, label in zip(bags, toxic, strict=True):
        group = min((xxhash.xxh32_intdigest(w) for w in bag), default=0)  # mostly equal for near copies: they count once
        new = [w for w in bag if (label, group, w) not in met]
        met.update((label, group, w) for w in new)
        (positive if label else negative).update(new)
    n1, n0 = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    nothing = ToxicModel(np.zeros(FEATURES, np.float32), -1.0, np.array([np.log((sum(toxic) + 0.5) / (n0 + 0.5)), 0, 0, 0, 0, 0, 0]))
    least = max(2, 0.005 * n1)
    odds = {w: np.log((k + 0.1) / n1) - np.log((negative[w] + 0.1) / n0) for w, k in positive.items() if k >= least}
    marked = sorted((w for w in odds if odds[w] > 1.5), key=lambda w: (-positive[w] * odds[w], w))
    clean = sorted((w for w in negative if odds.get(w, 0) < 1), key=lambda w: (-negative[w], w))
    if not marked or not clean:
        return nothing
    chosen: list[str] = []
    for w in marked[:600]:  # spread out: no landmark very near another
        if len(chosen) < landmarks // 2 and (not chosen or kernel([w], chosen).max() < 0.8):
            chosen.append(w)
    chosen += clean[:: max(1, len(clean) // (landmarks - len(chosen)))][: landmarks - len(chosen)]
    kmm = kernel(chosen, chosen)
    values, vectors = np.linalg.eigh((kmm + kmm.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-3))
    basis = basis_of(chosen)

    words = sorted({w for bag in bags for w in bag})
    number = {w: k for k, w in enumerate(words)}
    places = [np.array([number[w] for w in bag], np.int64) for bag in bags]
    scores = np.array([odds.get(w, -9.0) for w in words])
    against = Counter(number[w] for w in clean[:2000])  # a word counts as often as it was among a clean text's worst
    bad = 1.5
    for _ in range(rounds):
        worst = [p[np.argsort(-scores[p], kind="stable")[:5]] for p in places]
        witness = Counter(int(k) for p, y in zip(worst, toxic, strict=True) if y for j, k in enumerate(p) if j == 0 or scores[k] > bad)
        against.update(int(k) for p, y in zip(worst, toxic, strict=True) if not y for k in p[:2])
        bad = 0.0
        rows = list(witness) + list(against)
        y = np.array([1.0] * len(witness) + [-1.0] * len(against))
        weight = np.array([*witness.values(), *against.values()], float)
        weight *= np.where(y > 0, 100 / sum(witness.values()), 100 / sum(against.values()))
        x = np.column_stack([apply([words[k] for k in rows], basis) @ root, np.ones(len(rows))])
        w = solve_svm(x, y, weight)
        model = ToxicModel((basis @ (root @ w[:-1])).astype(np.float32), float(w[-1]), np.zeros(7))
        scores = apply(words, model.weights[:, None])[:, 0]
    x = np.stack([model.features(t) for t in texts])
    model.calibration = solve_logistic(x, np.array(toxic, float))
    return model


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, octets: int = SAMPLE_BYTES) -> DataFrame:
    """(text, toxic): a bounded sample of the labelled rows outside the held-out fold, in the order of a hash.

    The `rows` ids of each label with the least hashes are taken; every task keeps that many at most, and so does the
    merge. Ids with several labels count as toxic; null ids, null labels, labels other than 0 and 1 and null texts are
    left out. Without labelled rows the sample is empty.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & (F.coalesce(fold(F.col("doc_id")), F.lit(1)) != 1)).select("doc_id", "toxic")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.filter(F.octet_length("text") <= octets).select("doc_id", "text")
    ids = texts.select("doc_id").join(known, "doc_id").select("doc_id", "toxic").distinct()
    ids = materialize(ids.withColumn("_h", F.xxhash64("doc_id", F.lit(17))), "toxicity-labelled")
    least = [ids.filter(F.col("toxic") == y).orderBy("_h", "doc_id").limit(rows) for y in (0, 1)]
    picked = texts.join(F.broadcast(materialize(least[0].unionByName(least[1]), "toxicity-sample")), "doc_id")
    once = picked.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"), F.min("_h").alias("_h"))  # repeated ids: one text
    return once.orderBy("_h", "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Train on the sample of `training_rows`, which is collected: at most 2 * SAMPLE_ROWS texts of SAMPLE_BYTES.

    Empty tables, or labels of one kind only, give a model that scores every text by the share of the toxic label.
    """
    found = training_rows(docs, labels).collect()
    return train([r["text"] for r in found], [int(r["toxic"]) for r in found])


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """Add `score`, 0 to 1: how likely the label is 1. Whole texts, in pieces cut at white space; no shuffle.

    Null, empty and wordless texts get the score of a text without any marked word. Repeated rows get equal scores, and a
    column `score` of the input is replaced. Only the text is an input of the score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts):  # noqa: ANN001, ANN202
        return texts.map(shared.value.score, na_action=None)

    return docs.withColumn("score", run(F.col(text_col).cast("string")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, by a model that never saw the held-out fold's labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )

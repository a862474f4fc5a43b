"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased and split at white space; the n-grams (1 to 3 code points, a word's ends marked by a space) of each
word fall into ``BUCKETS`` buckets. Training counts are added up by language and bucket in Spark; the matrix of log
probabilities has languages * BUCKETS cells, whatever the size of the corpus, and goes to all tasks; of the languages the
``LANGUAGES`` with most documents are learned, so that dirty labels cannot make it grow. Each task scores
every distinct word once, as a sparse sum over the matrix, and adds the words of each document.

``keep`` learns from all labelled documents, ``predict`` from all but the held-out ones. As the posterior of a long text is
1 whatever its language, ``keep`` also asks how usual a text is: the mean log probability of its n-grams in the language it
is told to be in, measured by their mean and standard deviation in what was learned of that language; and it may be given
the languages that are wanted. Null text, and text without a letter, is ``und`` with score 0, as is every text
where nothing could be learned; repeated rows are each scored; an empty table gives no rows; ``keep`` passes all columns
through. The label never enters a prediction.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 15
LONGEST = 3
UNKNOWN = "und"
#: ``keep`` drops what is less certain.
MIN_SCORE = 0.5
#: ``keep`` drops what is less usual, in standard deviations of an n-gram from the mean of the language.
MIN_USUAL = -1.0
#: Languages learned, at most; the matrix takes 256 KB for each.
LANGUAGES = 256
#: Distinct words held at a time.
VOCABULARY = 100_000
#: Odd multipliers of the hash, one for each position.
_MIX = np.array([2654435761, 2246822519, 3266489917], np.uint64)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For all n-grams of the words: the place of their word, ascending, and their bucket."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = points == 32
    word = np.cumsum(blank) - 1
    places, buckets = [], []
    for n in range(1, LONGEST + 1):
        m = len(points) - n + 1
        h = np.full(m, n * 40503, np.uint64)
        for k in range(n):
            h = (h ^ (points[k : m + k] + np.uint64(k))) * _MIX[k]
            h ^= h >> np.uint64(29)
        valid = ~blank[:m] if n == 1 else ~np.logical_or.reduce([blank[k : m + k] for k in range(1, n - 1)] or [blank[:m] & blank[n - 1 :]])
        places.append(word[:m][valid])
        buckets.append((h[valid] & np.uint64(BUCKETS - 1)).astype(np.int64))
    place, bucket = np.concatenate(places), np.concatenate(buckets)
    order = np.argsort(place, kind="stable")
    return place[order], bucket[order]


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    docs: dict[str, int] = defaultdict(int)
    seen: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))

    def settle(lang: str) -> None:
        counts = seen.pop(lang, None)
        if counts:
            place, bucket = grams(list(counts))
            weight = np.fromiter(counts.values(), float)[place]
            totals[lang] = totals.get(lang, 0) + np.bincount(bucket, weight, BUCKETS)

    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
            docs[lang] += 1
            own = seen[lang]
            for w in (text.as_py() or "").lower().split():
                own[w] += 1
            if len(own) > VOCABULARY:
                settle(lang)
    for lang in list(seen):
        settle(lang)
    for lang, n in docs.items():
        counts = totals.get(lang, np.zeros(BUCKETS))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(used) + 1)), pa.array(np.r_[-1, used].astype(np.int32)), pa.array(np.r_[n, counts[used]].astype(np.int64))], names=["lang", "bucket", "n"])


class Model:
    """Languages in order, the log prior of each, and the log probability of each bucket in each language; seen is each
    bucket's share of the n-grams learned, and if not given what log says."""

    def __init__(self, langs: list[str], prior: np.ndarray, log: np.ndarray, seen: np.ndarray | None = None):
        self.langs, self.prior, self.log = langs, prior, log
        seen = np.exp(log) if seen is None else seen
        self.mean = (seen * log).sum(axis=0)
        self.spread = np.sqrt((seen * (log - self.mean) ** 2).sum(axis=0))

    def words(self, words: list[str]) -> np.ndarray:
        """What each word adds, by language; then how many n-grams it has, and 1 if it has a letter."""
        place, bucket = grams(words)
        starts = np.searchsorted(place, np.arange(len(words)))
        letters = np.fromiter((any(map(str.isalpha, w)) for w in words), float, len(words))
        return np.c_[np.add.reduceat(self.log[bucket], starts, axis=0), np.diff(starts, append=len(place)), letters]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, score, _ = self.rated(texts)
        return langs, score

    def rated(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language of each text, its posterior, and how usual the text is in that language."""
        total = np.zeros((len(texts), len(self.langs) + 2))
        place: dict[str, int] = {}
        waiting: list[tuple[int, np.ndarray]] = []

        def settle() -> None:
            if place:
                scores = self.words(list(place))
                codes = np.concatenate([c for _, c in waiting])
                starts = np.cumsum([0, *(len(c) for _, c in waiting[:-1])])
                for a in range(0, len(waiting), 256):
                    b = min(a + 256, len(waiting))
                    end = starts[b] if b < len(waiting) else len(codes)
                    sums = np.add.reduceat(scores[codes[starts[a] : end]], starts[a:b] - starts[a], axis=0)
                    np.add.at(total, [i for i, _ in waiting[a:b]], sums)
            place.clear()
            waiting.clear()

        held = 0
        for i, text in enumerate(texts):
            words = (text or "").lower().split()
            for a in range(0, len(words), VOCABULARY):
                codes = np.fromiter((place.setdefault(w, len(place)) for w in words[a : a + VOCABULARY]), np.int64)
                waiting.append((i, codes))
                held += len(codes)
                if len(place) > VOCABULARY or held > 20 * VOCABULARY:
                    settle()
                    held = 0
        settle()
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), -np.inf)
        log = total[:, :-2] + self.prior
        best = log.argmax(axis=1)
        share = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
        letters = total[:, -1] > 0
        each = total[np.arange(len(texts)), best] / np.maximum(1, total[:, -2])
        usual = (each - self.mean[best]) / np.maximum(1e-9, self.spread[best])
        return [self.langs[b] if x else UNKNOWN for b, x in zip(best, letters, strict=True)], np.where(letters, share, 0.0), np.where(letters, usual, -np.inf)


def learn(docs: DataFrame, folds: int = 4, held: int | None = 2) -> Model:
    """Learn from the labelled documents whose crc32(doc_id) mod folds is not held; from all if held is None."""
    told = F.col("lang").isNotNull()
    rows = docs.filter(told if held is None else told & (F.crc32(common.id_text()) % folds != held)).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    rows = rows.filter(F.col("lang").isin([r.lang for r in most.collect()]))
    counts = rows.mapInArrow(_learn, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(counts["lang"]))
    table = np.zeros((BUCKETS, len(langs)))
    place = counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    bucket, n = counts["bucket"].to_numpy(np.int64), counts["n"].to_numpy(float)
    table[bucket[bucket >= 0], place[bucket >= 0]] = n[bucket >= 0]
    documents = np.zeros(len(langs))
    documents[place[bucket < 0]] = n[bucket < 0]
    smoothed = table + 0.5
    return Model(langs, np.log(documents / max(1, documents.sum())), np.log(smoothed / smoothed.sum(axis=0)), table / np.maximum(1, table.sum(axis=0)))


def _predictor(model: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, usual = model.rated(batch.column("text").to_pylist())
            found = [pa.array(langs, pa.string()), pa.array(score), pa.array(usual, mask=np.isinf(usual))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *found], names=names)

    return run


def predict(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior probability) and usual (how usual the text is in that language, in
    standard deviations; null for und) of every document."""
    model = learn(docs, folds, held)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), (F.crc32(common.id_text()) % folds == held).alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predictor(model, ["doc_id", "held_out", "lang_pred", "score", "usual"]), f"doc_id {kind}, held_out boolean, lang_pred string, score double, usual double")


def keep(docs: DataFrame, languages: tuple[str, ...] | None = None, min_score: float = MIN_SCORE, min_usual: float = MIN_USUAL) -> DataFrame:
    """The documents in one of the languages (in any that was learned, if None), told with at least min_score and at least
    min_usual for it."""
    model = learn(docs, held=None)
    wanted = set(model.langs if languages is None else languages) - {UNKNOWN}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, usual = model.rated(batch.column("text").to_pylist())
            yield batch.filter(pa.array([x in wanted and s >= min_score and u >= min_usual for x, s, u in zip(langs, score, usual, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w.x): one weight vector w over hashed text features, shared by all grades, and
ordered thresholds. Features of a text are the presence of each word (lower case, outer punctuation off), hashed to
``WORDS`` slots; the presence of each stem (the first ``STEM`` letters of longer words), hashed to ``STEMS``; for each shape of token (letters to x, runs of capitals to X, digits to 9) its share of the tokens,
hashed to ``SHAPES`` slots; and the share of tokens that repeat the one before. Weights have one Laplace prior at every number of
ratings and are fitted with Adagrad, which leaves most of them 0.

Training takes at most ``max_labelled`` pairs of a document and a rating, those with the lowest hash of the id: a documented bound. Their
features are made on the executors. Scoring covers every document and its whole text.

Cases: a null text, an empty one and one of white space only have grade 0 for certain and aren't kept; ratings that
are null, or of no document, aren't trained on; without any rating nothing tells texts apart, and every text with a token has the top
grade; grades that no rating has keep a threshold, so that with a single grade in the ratings the thresholds put nearly all weight on it. Repeated
rows are scored each by itself; ids that aren't integers raise.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import chunks, slices, utf8

WORDS, STEMS, SHAPES, STEM = 1 << 18, 1 << 16, 1 << 10, 4
#: Slots: words, stems, shapes, and one for repeats.
SLOTS = WORDS + STEMS + SHAPES + 1
_LETTERS, _DIGITS, _RUN = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")
_OUTER = ".,;:!?\"'()[]{}#$%&*|-_/"
_SHARE = 10.0
#: Inverse scale of the weights' Laplace prior.
PRIOR = 0.3
#: Tokens remembered by a worker.
_MEMORY = 200_000


class _Slots(dict):
    """Token -> its stem's slot, its word's and its shape's in one number; 0 stands for no stem and for no word."""

    def __missing__(self, token: str) -> int:
        word = token.strip(_OUTER).lower()
        shape = _RUN.sub(r"\1", _DIGITS.sub("9", _LETTERS.sub(lambda m: "X" if len(m[0]) > 1 and m[0].isupper() else "x", token)))
        stem = 1 + xxhash.xxh3_64_intdigest(word[:STEM]) % STEMS if len(word) > STEM else 0
        slots = (stem * (WORDS + 1) + (1 + xxhash.xxh3_64_intdigest(word) % WORDS if word else 0)) * SHAPES + xxhash.xxh3_64_intdigest(shape) % SHAPES
        if len(self) < _MEMORY:
            self[token] = slots
        return slots


_slots = _Slots()


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of the texts: the text's row, its number among the different tokens; the packed slots of those; tokens of each text."""
    words = pa.compute.utf8_split_whitespace(texts.fill_null(""))
    row = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    flat = words.flatten()
    some = pa.compute.not_equal(flat, "").to_numpy(zero_copy_only=False)
    codes = flat.dictionary_encode()
    packed = np.fromiter((_slots[t] for t in codes.dictionary.to_pylist()), np.int64, len(codes.dictionary))
    row = row[some]
    return row, codes.indices.to_numpy()[some], packed, np.bincount(row, minlength=len(texts))


def features(texts: pa.Array, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, slots and values of the features of all texts, in order of rows and slots; and the number of tokens of each text.
    With weights, features without weight are left out."""
    row, code, packed, n = _tokens(texts)
    wanted = np.ones(SLOTS, bool) if weight is None else weight != 0
    pairs = packed // SHAPES
    found = []
    for slot in (pairs % (WORDS + 1) - 1, np.where(pairs // (WORDS + 1) > 0, WORDS + pairs // (WORDS + 1) - 1, -1)):
        own = np.where((slot >= 0) & wanted[slot], slot, -1)[code]
        found.append((row * SLOTS + own)[own >= 0])
    present = np.unique(np.concatenate(found))
    shape = WORDS + STEMS + packed % SHAPES
    own = np.where(wanted[shape], shape, -1)[code]
    shapes, count = np.unique((row * SLOTS + own)[own >= 0], return_counts=True)
    again = np.flatnonzero((row[1:] == row[:-1]) & (code[1:] == code[:-1])) if wanted[-1] else np.zeros(0, np.int64)
    repeats = np.bincount(row[again], minlength=len(n))
    some = np.flatnonzero(repeats)
    key = np.concatenate([present, shapes, some * SLOTS + SLOTS - 1])
    value = np.concatenate([np.ones(len(present)), _SHARE * count / n[shapes // SLOTS], _SHARE * repeats[some] / n[some]])
    order = np.argsort(key, kind="stable")
    return key[order] // SLOTS, key[order] % SLOTS, value[order], n


def _text_array(texts: list[str | None] | pa.Array) -> pa.Array:
    return texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())


@dataclass
class OrdinalModel:
    """Weights by slot and ordered thresholds; grades are 0 to len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: list[str | None] | pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1.. of each text; 0 for a text without tokens."""
        row, slot, value, n = features(_text_array(texts), self.weights)
        s = np.bincount(row, weights=self.weights[slot] * value, minlength=len(n))
        return (n > 0)[:, None] / (1 + np.exp(np.clip(self.thresholds - s[:, None], -500, 500)))


def likelihood(s: np.ndarray, theta: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log-likelihood of grades y under scores s and thresholds, and its gradients by score and by threshold."""
    n, top = len(y), len(theta)
    low, high, own = np.maximum(y - 1, 0), np.minimum(y, top - 1), np.arange(n)
    c = 1 / (1 + np.exp(np.clip(s[:, None] - theta, -500, 500)))  # P(grade <= k)
    d = c * (1 - c)
    below, upto = np.where(y > 0, c[own, low], 0), np.where(y < top, c[own, high], 1)
    dbelow, dupto = np.where(y > 0, d[own, low], 0), np.where(y < top, d[own, high], 0)
    p = np.maximum(upto - below, 1e-9)
    by_theta = np.bincount(low, weights=dbelow / p, minlength=top) / n - np.bincount(high, weights=dupto / p, minlength=top) / n
    return -float(np.log(p).mean()), (dupto - dbelow) / p / n, by_theta


def fit(texts: list[str | None], grades: list[int], **kw) -> OrdinalModel:
    """``fit_features`` of texts."""
    row, slot, value, _ = features(_text_array(texts))
    return fit_features(row, slot, value, grades, **kw)


def fit_features(rows: np.ndarray, slots: np.ndarray, values: np.ndarray, grades: list[int] | np.ndarray, *, top: int = 2, prior: float = PRIOR, rounds: int = 600, rate: float = 0.3) -> OrdinalModel:
    """Fit weights and thresholds by full-batch proximal Adagrad on the log-likelihood with a Laplace prior of the weights: ``prior`` times the sum of
    their sizes is taken from the log-likelihood of all ratings. top: the highest grade; a higher one in the ratings raises it."""
    y = np.asarray(grades, dtype=np.int64)
    n = len(y)
    if not n:
        return OrdinalModel(np.zeros(SLOTS), np.full(top, -1e3))
    top = max(top, int(y.max()))
    used, at = np.unique(slots, return_inverse=True)
    share = np.clip(np.array([(y < k).mean() for k in range(1, top + 1)]), 0.5 / n, 1 - 0.5 / n)
    theta = np.log(share / (1 - share)) + 1e-3 * np.arange(top)
    w, gw, gt = np.zeros(len(used)), np.full(len(used), 1e-8), np.full(top, 1e-8)
    for _ in range(rounds):
        _, by_score, by_theta = likelihood(np.bincount(rows, weights=w[at] * values, minlength=n), theta, y)
        grad = np.bincount(at, weights=by_score[rows] * values, minlength=len(used))
        gw += grad * grad
        gt += by_theta * by_theta
        step = rate / np.sqrt(gw)
        w = w - step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * prior / n, 0)
        theta = np.maximum.accumulate(theta - rate / np.sqrt(gt) * by_theta) + 1e-6 * np.arange(top)
    weights = np.zeros(SLOTS)
    weights[used] = w
    return OrdinalModel(weights, theta)


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Ratings of quality and toxicity as one grade: 0 poor, 1 good but toxic, 2 good and clean."""
    return F.when(F.col(quality) == 0, 0).when(F.col(quality) == 1, F.when(F.col(toxic) == 1, 1).when(F.col(toxic) == 0, 2))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", grade_col: Column | None = None, max_labelled: int = 6000, **kw) -> OrdinalModel:
    """Fit on at most ``max_labelled`` graded documents, the same ones whatever the partitions are."""
    graded = labels.select(F.col(id_col).cast("bigint").alias("wl_id"), (grade() if grade_col is None else grade_col).cast("int").alias("wl_grade")).where("wl_id is not null and wl_grade is not null")
    order = (F.xxhash64("wl_id"), F.col("wl_id"), F.col("wl_grade"))
    some = graded.orderBy(*order).limit(max_labelled)
    own = docs.select(F.col(id_col).cast("bigint").alias("wl_id"), utf8(text_col).alias("wl_text")).where("wl_text is not null")
    # The sample has max_labelled rows at most, whatever the input: it is the side that is sent. Ids may come again, so its pairs are bounded too.
    rows = own.join(F.broadcast(some), "wl_id").select("*", F.xxhash64("wl_text").alias("wl_h")).orderBy(*order, "wl_h").limit(max_labelled)
    found = rows.select("wl_id", "wl_grade", "wl_h", F.arrow_udf(_features_of, _FEATURES)("wl_text").alias("x")).toArrow()
    found = found.take(pa.compute.sort_indices(found, [(k, "ascending") for k in ("wl_id", "wl_grade", "wl_h")]))
    x = found.column("x").combine_chunks()
    slots, values = x.field("slots"), x.field("values").flatten().to_numpy()
    at = np.repeat(np.arange(len(found)), pa.compute.list_value_length(slots).to_numpy(zero_copy_only=False).astype(np.int64))
    return fit_features(at, slots.flatten().to_numpy().astype(np.int64), values, found.column("wl_grade").to_numpy(), **kw)


_FEATURES = "struct<slots: array<int>, values: array<double>>"


def _features_of(texts: pa.Array) -> pa.Array:
    slots, values = [], []
    for _, own in chunks(texts):
        row, slot, value, n = features(_text_array(own))
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]).astype(np.int32))
        slots.append(pa.ListArray.from_arrays(ends, pa.array(slot.astype(np.int32))))
        values.append(pa.ListArray.from_arrays(ends, pa.array(value)))
    return pa.StructArray.from_arrays([pa.concat_arrays(x) if x else pa.array([], pa.list_(t)) for x, t in ((slots, pa.int32()), (values, pa.float64()))], ["slots", "values"])


def tails_column(spark: SparkSession, model: OrdinalModel, text: Column) -> Column:
    """P(grade >= k), k = 1.., as an array column."""
    sent = spark.sparkContext.broadcast(model)

    def tails(texts: pa.Array) -> pa.Array:
        k = len(sent.value.thresholds)
        parts = [sent.value.tails(own) for own in slices(texts)]
        every = np.concatenate([np.zeros((0, k)), *parts])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, every.size + 1, k, dtype=np.int32)), pa.array(every.ravel()))

    return F.arrow_udf(tails, "array<double>")(text)


def _p_top(tails: Column, at_least: int) -> Column:
    """P(grade >= at_least); 0 for a grade that the model doesn't know."""
    return F.coalesce(F.get(tails, F.lit(at_least - 1)), F.lit(0.0))


def score(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text", at_least: int = 2, cut: float = 0.75) -> DataFrame:
    """(doc_id, expected_grade, p_top, keep) of every document: the expected grade, P(grade >= at_least), and whether
    that reaches ``cut``. Map only: no shuffle."""
    scored = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), tails_column(docs.sparkSession, model, utf8(text_col)).alias("tails"))
    return scored.select("doc_id", F.aggregate("tails", F.lit(0.0), lambda a, x: a + x).alias("expected_grade"), _p_top(F.col("tails"), at_least).alias("p_top")).withColumn("keep", F.col("p_top") >= cut)


def select(docs: DataFrame, model: OrdinalModel, *, text_col: str = "text", at_least: int = 2, cut: float = 0.75) -> DataFrame:
    """The documents, with all their columns, for which P(grade >= at_least) reaches ``cut``."""
    return docs.where(_p_top(tails_column(docs.sparkSession, model, utf8(text_col)), at_least) >= cut)

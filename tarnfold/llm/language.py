"""Language identification by hierarchical discrimination.

A one-versus-rest linear support vector machine picks the language family; within a family,
one-versus-one linear support vector machines separate the close languages by votes and margins.
Features are hashed byte n-grams (one to three bytes) of the whole lower-cased text, letters only.

These machines only compare the learned languages with each other, so the score is also held to an
absolute measure: how much likelier the text's n-grams are in the labelled sample than if all n-grams
were equally likely. What falls short of half of what is usual for the winner (measured on rows that the
table was not counted from) loses its score: letter noise, and languages far from the learned ones.

Scale: the models are fitted on a bounded sample of labelled rows (``sample`` in all, dealt evenly to
the languages), chosen by a hash of the text; prediction is one pass over all rows without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Families of ISO 639-1 codes. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "semitic": "ar he mt am",
    "indo-aryan": "hi ur bn mr gu pa ne si",
    "iranian": "fa ps ku tg",
    "celtic": "ga gd cy br",
    "sinitic": "zh yue",
    "austronesian": "id ms tl jv",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
WIDTH = 1 << 13
# ASCII characters other than letters become a space.
_SPACE = bytes(i if i >= 128 or 97 <= i <= 122 else 32 for i in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def letters(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACE).split())


def vector(text: str | bytes) -> np.ndarray:
    """The features of a text or its ``letters``: hashed counts of 1-, 2- and 3-grams, damped, each order of unit length."""
    raw = letters(text) if isinstance(text, str) else text
    a = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    out = np.zeros(WIDTH, np.float32)
    third = WIDTH // 8
    parts = [(a, 0, 256), (a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA6B), 256, third)]
    if len(a) > 2:
        parts.append((a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA6B) + a[2:] * np.uint32(0xC2B2AE35), 256 + third, WIDTH - 256 - third))
    for codes, first, size in parts:
        if first:
            codes = ((codes ^ (codes >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(8)) % np.uint32(size)
        counts = np.sqrt(np.bincount(codes, minlength=size).astype(np.float32))
        norm = np.sqrt(np.dot(counts, counts))
        out[first : first + size] = counts / norm if norm else 0
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, c: float = 1.0, epochs: int = 20, seed: int = 7) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss, by dual coordinate descent.

    ``y`` is +1 or -1 for each of ``rows`` (default: all); ``x`` is not copied.
    """
    rows = np.arange(len(x)) if rows is None else rows
    weight = {s: len(y) / (2 * max(1, int((y == s).sum()))) for s in (1, -1)}  # rare classes count as much
    ridge = np.array([0.5 / (c * weight[int(s)]) for s in y])
    square = np.einsum("ij,ij->i", x, x)[rows] + 1 + ridge
    alpha, w, bias, pick = np.zeros(len(y)), np.zeros(x.shape[1], np.float32), 0.0, np.random.default_rng(seed)
    for _ in range(epochs):
        for i in pick.permutation(len(y)):
            row = x[rows[i]]
            gradient = y[i] * (float(row @ w) + bias) - 1 + ridge[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / square[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += np.float32(step) * row
                bias += step
                alpha[i] = new
    return np.append(w, np.float32(bias))


_ORDERS = (slice(0, 256), slice(256, 256 + WIDTH // 8), slice(256 + WIDTH // 8, WIDTH))
# Bytes of a text that count, the slack of short texts in nats, and the fall of the score below the least familiarity.
_COUNTED, _SLACK, _FALL = 2000, 4.0, 8.0


def usual(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio (nats) of every n-gram: the rows of ``x`` against n-grams that are all equally likely."""
    out = np.zeros(WIDTH, np.float32)
    for part in _ORDERS:
        counts = np.minimum(sizes, _COUNTED).astype(np.float32) @ np.square(x[:, part])
        out[part] = np.log((counts + 0.5) / (counts.sum() + 0.5 * len(counts)) * len(counts)) / len(_ORDERS)
    return out


@dataclass
class Model:
    families: list[str]
    languages: list[list[str]]  # by family
    family_weights: np.ndarray  # families x (WIDTH + 1)
    pair_weights: list[np.ndarray]  # by family, pairs x (WIDTH + 1)
    usual: np.ndarray | None = None
    least: dict[str, float] | None = None  # by language, of what ``usual`` gives

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str], sizes: np.ndarray | None = None) -> Model:
        """``sizes``: bytes of each row's letters; without them, scores are not held to an absolute measure."""
        by_family: dict[str, list[str]] = {}
        for code in sorted(set(labels)):
            by_family.setdefault(FAMILY_OF.get(code, f"language {code}"), []).append(code)
        families = sorted(by_family)
        of = np.array(labels, dtype=object)
        family = np.array([FAMILY_OF.get(c, f"language {c}") for c in labels], dtype=object)
        heads = [linear_svm(x, np.where(family == f, 1, -1)) for f in families] if len(families) > 1 else []
        pairs = []
        for f in families:
            codes, own = by_family[f], []
            for i, a in enumerate(codes):
                for b in codes[i + 1 :]:
                    here = np.flatnonzero((of == a) | (of == b))
                    own.append(linear_svm(x, np.where(of[here] == a, 1, -1), here))
            pairs.append(np.array(own, np.float32).reshape(len(own), WIDTH + 1))
        model = cls(families, [by_family[f] for f in families], np.array(heads, np.float32).reshape(len(heads), WIDTH + 1), pairs)
        if sizes is not None and len(x) > 1:
            model.usual, known = usual(x, sizes), np.zeros(len(x))
            for half in (0, 1):
                known[half::2] = np.square(x[half::2]) @ usual(x[1 - half :: 2], sizes[1 - half :: 2])
            middle = {c: float(np.median(known[of == c])) for c in set(labels)}
            model.least = {c: m - max(1.0, abs(m) / 2) for c, m in middle.items()}
        return model

    def predict(self, x: np.ndarray, sizes: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
        """Language and score: the family's share times the mean pairwise share, each from logistic margins.

        With ``sizes`` (bytes of each row's letters), the score falls towards 0 as the text's familiarity
        falls below the winner's least, with slack for short texts.
        """
        names, scores = [], np.zeros(len(x))
        if len(self.families) > 1:
            margins = 3.0 * _margins(x, self.family_weights)
            share = np.exp(margins - margins.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            best = share.argmax(1)
        else:
            share, best = np.ones((len(x), 1)), np.zeros(len(x), int)
        within = [1 / (1 + np.exp(-3.0 * _margins(x, w))) for w in self.pair_weights]
        for i, f in enumerate(best):
            codes = self.languages[f]
            votes, support, k = [0] * len(codes), [0.0] * len(codes), 0
            for a in range(len(codes)):
                for b in range(a + 1, len(codes)):
                    p = within[f][i, k]
                    votes[a if p >= 0.5 else b] += 1
                    support[a] += p
                    support[b] += 1 - p
                    k += 1
            win = max(range(len(codes)), key=lambda c: (votes[c], support[c], -c))
            names.append(codes[win])
            scores[i] = share[i, f] * (support[win] / (len(codes) - 1) if len(codes) > 1 else 1.0)
        if sizes is not None and self.least is not None:
            least = np.array([self.least[c] for c in names]) - _SLACK / np.sqrt(np.maximum(sizes, 1))
            scores *= np.exp(_FALL * np.minimum(0, np.square(x) @ self.usual - least))
        return names, scores


def _margins(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (x @ weights[:, :-1].T).astype(np.float64) + weights[:, -1]


def train(rows: DataFrame, text: str, label: str, sample: int = 2000) -> Model | None:
    """A model from at most ``sample`` rows (two a language at least) that have a label and a letter; None without any.

    Every language gets an even share of the sample. Rows are chosen by a hash of their text alone, in its
    order, so the choice depends neither on keys nor on partitions, and equal texts of a language count once.
    A language whose texts are all unlucky is learned from the one of the smallest hash.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("t"))
    rows = rows.withColumn("die", F.xxhash64(F.lit("sample"), "t").cast("double") / float(1 << 64) + 0.5)
    # a row a language: about how many texts it has, and its smallest hash
    seen = {r[0]: (r[1], r[2]) for r in rows.groupBy("label").agg(F.approx_count_distinct("die"), F.min("die")).collect()}
    if not seen:
        return None
    each = max(2, sample // len(seen))
    most = F.create_map(*[F.lit(v) for k, (n, least) in seen.items() for v in (k, max(least, min(1.0, 1.2 * each / max(n, 1))))])
    chosen = rows.where(F.col("die") <= most[F.col("label")])
    rank = F.row_number().over(Window.partitionBy("label").orderBy("die", "t"))
    chosen = chosen.dropDuplicates(["label", "die", "t"]).withColumn("rank", rank).where(F.col("rank") <= each).select("label", "t")

    def run(batches):
        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            raw = [letters(texts[i]) for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array([labels[i] for i in keep], pa.string()), pa.array([vector(r).astype("<f2").tobytes() for r in raw], pa.binary()), pa.array([len(r) for r in raw], pa.int32())], names=["label", "x", "n"])

    found = sorted((r.label, bytes(r.x), r.n) for r in chosen.mapInArrow(run, "label string, x binary, n int").collect())
    if not found:
        return None
    x = np.empty((len(found), WIDTH), np.float32)
    for i, (_, raw, _) in enumerate(found):
        x[i] = np.frombuffer(raw, "<f2")
    return Model.fit(x, [c for c, _, _ in found], np.array([n for _, _, n in found]))


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """``key, lang_pred, score`` of every row, or with ``keep`` all its columns and those two.

    ``und`` with score 0 if the text is null or has no letter, or if there is no model. Only the text is
    read for a prediction. Null keys and repeated rows stay; an empty table gives no rows. With ``keep``,
    columns of the names lang_pred and score are replaced.
    """
    from pyspark.sql import types as T

    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    kept = [f for f in docs.schema.fields if (f.name not in ("lang_pred", "score") if keep else f.name == key)]
    source = docs.select(*[docs[f.name] for f in kept], docs[text].cast("string").alias("__text"))
    n = len(kept)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column(n).to_pylist()
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
                known = [i for i, t in enumerate(texts) if model is not None and t and has_letter(t)]
                if known:
                    raw = [letters(texts[i]) for i in known]
                    got, s = model.predict(np.stack([vector(r) for r in raw]), np.array([len(r) for r in raw]))
                    scores[known] = s
                    for i, name in zip(known, got, strict=True):
                        names[i] = name
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[f.name for f in kept + made])

    return source.mapInArrow(run, T.StructType(kept + made))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1

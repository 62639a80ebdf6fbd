"""Quality classification by co-training.

Two views of a document, its text's content and its metadata (source, language, length), each have
a logistic model. Features are computed once for every document and written. The models are fitted
on a bounded sample of labelled documents; in each round both score all other documents, and each
gives some of those that it is confident of, drawn from the whole corpus by hash, to the other as
pseudo-labels. Each view's score is then calibrated on held-out labelled documents, the calibrated
views are combined by weights fitted there too, and every document is scored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, lean, materialize

#: Bound of the labelled sample, rounds, pseudo-labels a round, view and class, and how sure they are.
LABELLED, ROUNDS, GIVEN, SURE = 8_000, 4, 200, 0.95
#: Hashed features of each view; a document is kept at this probability or more.
CONTENT, META, KEEP_AT = 4_096, 1_024, 0.5
_SHAPE = [(re.compile(p), r) for p, r in ((r"[^\W\d_]", "a"), (r"\d", "0"))]
_CACHE = 100_000


def _bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode()) % size


def _steps(name: str, value: float, edges) -> str:
    return f"{name}:{sum(value > e for e in edges)}"


_PART, _TENTH = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9), (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


class Views:
    """Feature indices and values of a document in each view."""

    def __init__(self) -> None:
        self.shapes: dict[str, tuple[int, str, bool]] = {}

    def _shape(self, word: str) -> tuple[int, str, bool]:
        found = self.shapes.get(word)
        if found is None:
            if len(self.shapes) > _CACHE:
                self.shapes.clear()
            letters = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
            shape = re.sub(r"(.)\1+", r"\1", letters)
            found = self.shapes[word] = (_bucket("s:" + shape, CONTENT), word.strip(".,;:!?").lower(), "A" in shape and "a" not in shape and len(word) > 1)
        return found

    def content(self, text: str | None) -> dict[int, float]:
        words = (text or "").split()
        n = len(words)
        out: dict[int, float] = {_bucket(_steps("n", math.log2(n + 1), range(12)), CONTENT): 1.0}
        if not n:
            return out
        count = Counter(words)
        shapes: Counter = Counter()
        upper = marks = 0
        for w, k in count.items():
            at, _, loud = self._shape(w)
            shapes[at] += k
            upper += k * loud
            marks += k * (not w[-1].isalnum() and w[-1] not in ".,;:?)\"'")
        for at, k in shapes.items():
            out[at] = out.get(at, 0.0) + math.sqrt(k / n)
        same = sum(a == b for a, b in zip(words, words[1:])) / n
        lines = [x for x in text.split("\n") if x.strip()]
        facts = [
            _steps("distinct", len(count) / n, _TENTH), _steps("upper", upper / n, _PART), _steps("marks", marks / n, _PART), _steps("same", same, _PART),
            _steps("top", max(count.values()) / n, _PART), _steps("lines", 1 - len(set(lines)) / max(1, len(lines)), _TENTH),
            _steps("bars", text.count("|") / n, _PART), _steps("chars", len(text) / n, (2, 3, 4, 5, 6, 7, 8, 10, 14, 20)), _steps("stops", sum(w[-1] in ".!?" for w in words) / n, _PART),
        ]
        for f in facts:
            out[_bucket(f, CONTENT)] = out.get(_bucket(f, CONTENT), 0.0) + 1.0
        return out

    def meta(self, source: str | None, lang: str | None, length: int | None) -> dict[int, float]:
        size = int(2 * math.log2((length or 0) + 1))
        return {_bucket(x, META): 1.0 for x in (f"source={source}", f"lang={lang}", f"size={size}", f"lang={lang} size={size}")}


class Model:
    """Logistic regression on sparse rows with a bias in the last place."""

    def __init__(self, size: int):
        self.w = np.zeros(size + 1)

    @staticmethod
    def flat(rows: list[dict[int, float]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows]) if rows else np.zeros(0, np.int64)
        idx = np.array([x for r in rows for x in (*r, size)], np.int64)
        val = np.array([x for r in rows for x in (*r.values(), 1.0)], float)
        return at, idx, val

    def logit(self, flat, n: int) -> np.ndarray:
        at, idx, val = flat
        return np.bincount(at, weights=self.w[idx] * val, minlength=n)

    def fit(self, rows: list[dict[int, float]], y: np.ndarray, steps: int = 60, rate: float = 0.3, decay: float = 1e-4) -> Model:
        flat, n, size = self.flat(rows, len(self.w) - 1), len(rows), len(self.w)
        share = min(max(float(y.mean()), 0.02), 0.98)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        self.w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
        for t in range(1, steps + 1):
            err = (_sigmoid(self.logit(flat, n)) - y) * weight / n
            grad = np.bincount(flat[1], weights=err[flat[0]] * flat[2], minlength=size) + decay * self.w
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            self.w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return self


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _platt(x: np.ndarray, y: np.ndarray, floor: bool = False) -> np.ndarray:
    """Weights (with bias last) of a logistic fit of y on the columns of x; floor: none below zero."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w = w - 0.5 * np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
        if floor:
            w[:-1] = np.maximum(w[:-1], 0)
    return w


#: How co-training gets pseudo-labels: (models, round) to, for each view, rows it takes for bad and rows it takes for good.
Teach = Callable[[list[Model], int], list[tuple[list, list]]]


class CoTrained:
    """The two models, their calibrations and the combination. Rows are pairs (content, meta) of features."""

    def __init__(self, rows: list[tuple[dict, dict]], y, teach: Teach | None = None, rounds: int = ROUNDS):
        rng = np.random.default_rng(11)
        y = np.asarray(y, float)
        order = rng.permutation(len(y))
        held, fit = order[: len(y) // 5], order[len(y) // 5 :]
        own = [[rows[k][v] for k in fit] for v in (0, 1)]
        label = [y[fit], y[fit]]
        self.models = [Model(CONTENT), Model(META)]
        for r in range(rounds + 1):
            for m, x, ys in zip(self.models, own, label):
                if len(ys):
                    m.fit(x, ys)
            if r == rounds or teach is None:
                break
            given = 0
            for v, (low, high) in enumerate(teach(self.models, r)):  # v teaches the other view, as many of each class
                n = min(len(low), len(high))
                own[1 - v] += [x[1 - v] for x in (*low[:n], *high[:n])]
                label[1 - v] = np.append(label[1 - v], [0.0] * n + [1.0] * n)
                given += n
            if not given:
                break
        self.cal = [np.array([1.0, 0.0])] * 2
        self.mix = np.array([1.0, 0.2, 0.0])
        if len(held) >= 20 and 0 < y[held].mean() < 1:
            logits = [m.logit(Model.flat([rows[k][v] for k in held], size), len(held)) for v, (m, size) in enumerate(zip(self.models, (CONTENT, META)))]
            self.cal = [_platt(x[:, None], y[held], floor=True) for x in logits]
            self.mix = _platt(np.column_stack([x * c[0] + c[1] for x, c in zip(logits, self.cal)]), y[held], floor=True)

    def score(self, logits: list[np.ndarray]) -> np.ndarray:
        """Probability of good quality for each row, of the two models' logits."""
        views = [x * c[0] + c[1] for x, c in zip(logits, self.cal)]
        return _sigmoid(views[0] * self.mix[0] + views[1] * self.mix[1] + self.mix[2])


_FEATURES = "key long, ci array<int>, cv array<float>, mi array<int>"


def _logits(models: list[Model], ci: pa.Array, cv: pa.Array, mi: pa.Array) -> list[np.ndarray]:
    """Both views' logits of feature columns."""
    out = []
    for m, idx, val in ((models[0], ci, cv), (models[1], mi, None)):
        at = np.repeat(np.arange(len(idx)), np.diff(idx.offsets.to_numpy()))
        x = m.w[idx.flatten().to_numpy(zero_copy_only=False)]
        if val is not None:
            x = x * val.flatten().to_numpy(zero_copy_only=False)
        out.append(np.bincount(at, weights=x, minlength=len(idx)) + m.w[-1])
    return out


def featured(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with their features, written; and the names of the feature columns, which clash with none of docs."""
    names = fresh(docs, "key", "ci", "cv", "mi")
    inner = [x + " " + kind.split()[1] for x, kind in zip(names, _FEATURES.split(", "))]
    text, source, lang = fresh(docs, "a_text", "a_source", "a_lang")
    asked = docs.withColumns({text: F.col("text").cast("string"), source: F.col("source").cast("string"), lang: F.col("lang").cast("string")})
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Views()
        for b in batches:
            texts, sources, langs = (b.column(width + k).to_pylist() for k in range(3))
            content = [make.content(x) for x in texts]
            meta = [make.meta(s, g, len(x or "")) for s, g, x in zip(sources, langs, texts)]
            ci = pa.array([list(r) for r in content], pa.list_(pa.int32()))
            cv = pa.array([list(r.values()) for r in content], pa.list_(pa.float32()))
            mi = pa.array([list(r) for r in meta], pa.list_(pa.int32()))
            key = [xxhash.xxh64_intdigest(f"{s}\0{g}\0{x}".encode(errors="surrogatepass")) - (1 << 63) for s, g, x in zip(sources, langs, texts)]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(key, pa.int64()), ci, cv, mi], [*b.schema.names[:width], *names])

    schema = T.StructType([*docs.schema, *T._parse_datatype_string(", ".join(inner)).fields])
    return materialize(asked.mapInArrow(lean(run), schema)), names


def _pick(models, seen: frozenset[int], seed: int, given: int):
    """Feature rows to the confident ones of each view and class, the first given by hash of a partition's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], dict[int, tuple]] = {(v, c): {} for v in (0, 1) for c in (0, 1)}
        low = {k: 1 << 64 for k in best}
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            place = (keys.view(np.uint64) ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
            place ^= place >> np.uint64(29)
            for v, x in enumerate(_logits(models, *(b.column(k) for k in (1, 2, 3)))):
                p = _sigmoid(x)
                for c, sure in ((0, p < 1 - SURE), (1, p > SURE)):
                    found = best[v, c]
                    for k in np.flatnonzero(sure):
                        at = int(place[k])
                        if at < low[v, c] and at not in found and int(keys[k]) not in seen:
                            found[at] = (int(keys[k]), *[b.column(n)[int(k)].as_py() for n in (1, 2, 3)])
                            if len(found) > 2 * given:
                                best[v, c] = found = dict(sorted(found.items())[:given])
                                low[v, c] = max(found)
        rows = [(v, c, at - (1 << 63), *x) for (v, c), found in best.items() for at, x in sorted(found.items())[:given]]
        cols = list(zip(*rows)) if rows else [()] * 7
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], ["view", "class", "place", "key", "ci", "cv", "mi"])

    return run


def _row(ci, cv, mi) -> tuple[dict[int, float], dict[int, float]]:
    return dict(zip(map(int, ci), map(float, cv))), {int(x): 1.0 for x in mi}


def train(features: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS, given: int = GIVEN) -> CoTrained | None:
    """Fits the models on features (doc_id, key, ci, cv, mi); None if no document has a label.

    At most labelled documents with a label are used, chosen by hash, one row for each doc_id; a
    label that is given twice counts as good if one says so. Pseudo-labels are drawn from all other
    documents; where all are labelled there are none.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("double")).alias("y"))
    order = F.xxhash64(F.lit("quality"), "doc_id")
    y = y.join(features.select("doc_id").distinct(), "doc_id").orderBy(order, "doc_id").limit(labelled)
    y = F.broadcast(materialize(y))  # labelled rows at most
    known = features.join(y, "doc_id").groupBy("doc_id", "y").agg(F.min_by(F.struct("ci", "cv", "mi"), "key").alias("x")).select("doc_id", "y", "x.*").toPandas()
    if not len(known):
        return None
    known = known.sort_values("doc_id")
    rows = [_row(*x) for x in zip(known.ci, known.cv, known.mi)]
    pool = features.join(y, "doc_id", "left_anti").select("key", "ci", "cv", "mi")
    seen: set[int] = set()

    def teach(models: list[Model], r: int) -> list[tuple[list, list]]:
        found = pool.mapInArrow(_pick(models, frozenset(seen), (r + 1) * 0x1234567, given), f"view int, class int, place long, {_FEATURES}")
        found = found.dropDuplicates(["view", "class", "place"])
        place = F.row_number().over(Window.partitionBy("view", "class").orderBy("place"))
        got = found.withColumn("n", place).where(F.col("n") <= given).orderBy("view", "class", "n").collect()  # four times given rows at most
        seen.update(x.key for x in got)
        return [tuple([_row(x.ci, x.cv, x.mi) for x in got if (x.view, x["class"]) == (v, c)] for c in (0, 1)) for v in (0, 1)]

    return CoTrained(rows, known.y.to_numpy(), teach, rounds)


def score(features: DataFrame, names: list[str], model: CoTrained | None, keep_at: float = KEEP_AT) -> DataFrame:
    """features without their feature columns (names), with quality and keep; quality is 1 for all if there is no model."""
    sent = features.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in features.columns if c not in names]
    at = [features.columns.index(c) for c in (*kept, *names[1:])]
    quality, keep = fresh(features, "quality", "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            cols = [b.column(k) for k in at]
            p = known.score(_logits(known.models, *cols[len(kept) :])) if known is not None else np.ones(b.num_rows)
            yield pa.RecordBatch.from_arrays([*cols[: len(kept)], pa.array(p), pa.array(p >= keep_at)], [*kept, quality, keep])

    schema = T.StructType([*[features.schema[c] for c in kept], T.StructField(quality, T.DoubleType()), T.StructField(keep, T.BooleanType())])
    return features.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """Trains on labels (doc_id, quality) and scores every row of docs: (doc_id, quality, keep).

    Null and empty texts are scored by their metadata and emptiness; texts and words of any length
    are read whole. Null sources and languages are values of their own. Labels other than 0 and 1,
    and labels of unknown documents, are ignored; without any, everything is kept. Rows that repeat
    are scored each; other columns are ignored; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    rows, names = featured(docs)
    model = train(rows, labels)
    return score(rows.select("doc_id", *names), names, model, keep_at)


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns, whatever their names.

    Nulls, empty texts, repeated rows and missing labels are as in classify(); no rows give no rows.
    """
    rows, names = featured(docs)
    model = train(rows.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(n).alias(x) for n, x in zip(names, ("key", "ci", "cv", "mi"))]), labels)
    done = score(rows, names, model, keep_at)
    return done.where(F.col(done.columns[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])

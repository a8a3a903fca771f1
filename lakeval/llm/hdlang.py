"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs, fixed by its code point. A letter n-gram is the product of its
letters' vectors, each rotated by its place; a text is the sum of its n-grams' vectors, and a language
the sum of its texts' vectors, each of length one, less the mean of all languages. A text is of the
language with the largest cosine. Whether it is like that language at all is another question: its cosine
with the whole sum (its likeness) against the fence that the language's learned texts of like length set.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import bound_batches

DIMS = 256
N = 3
UNKNOWN = "und"
#: A fence stands so many standard deviations under the mean likeness of at least so many texts, if there are.
DEVIATIONS, ENOUGH = 4.0, 30
_SPACE = 32


class Profiles:
    """n-gram vectors, made when first met; up to ``most`` are kept."""

    def __init__(self, dims: int = DIMS, n: int = N, seed: int = 11, most: int = 120_000):
        if not 1 <= n <= 3:
            raise ValueError("n-grams of 1 to 3 letters")
        self.dims, self.n, self.seed, self.most = dims, n, seed, most
        self._letters: dict[int, np.ndarray] = {}
        letter = np.zeros(0x110000, bool)
        letter[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]] = True
        self._is_letter = letter
        self._forget()

    def _forget(self) -> None:
        self._codes = np.empty(0, np.uint64)
        self._rows = np.empty(0, np.int64)
        self._vectors = np.empty((0, self.dims), np.int8)  # signs only

    def _letter(self, c: int) -> np.ndarray:
        v = self._letters.get(c)
        if v is None:
            rng = np.random.Generator(np.random.Philox(key=[self.seed, c]))
            v = self._letters[c] = (rng.integers(0, 2, self.dims) * 2 - 1).astype(np.float32)
        return v

    def _ngram(self, code: int) -> np.ndarray:
        out = np.ones(self.dims, np.float32)
        for place in range(self.n):
            out *= np.roll(self._letter(code >> 21 * place & 0x1FFFFF), place)
        return out

    def _of(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct codes."""
        at = np.searchsorted(self._codes, codes)
        at[at == len(self._codes)] = 0
        new = codes[self._codes[at] != codes] if len(self._codes) else codes
        if len(new):
            if len(self._codes) + len(new) > self.most:
                self._forget()
                new = codes
            made = np.stack([self._ngram(int(c)).astype(np.int8) for c in new])
            both = np.concatenate([self._codes, new])
            rows = np.concatenate([self._rows, len(self._vectors) + np.arange(len(new))])
            order = np.argsort(both, kind="stable")
            self._codes, self._rows = both[order], rows[order]
            self._vectors = np.concatenate([self._vectors, made])
            at = np.searchsorted(self._codes, codes)
        return self._vectors[self._rows[at]].astype(np.float32)

    def length_class(self, text: str) -> int:
        """Bits of the number of letters of a text."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        return int(np.count_nonzero(self._is_letter[points])).bit_length()

    def text(self, text: str | None) -> np.ndarray | None:
        """The unit vector of a whole text; None without letters."""
        if not text:
            return None
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = self._is_letter[points]
        if not is_letter.any():
            return None
        points = np.where(is_letter, points, _SPACE)
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]  # one space after each word
        points = np.concatenate([[_SPACE], points[keep], [_SPACE]]).astype(np.uint64)
        if len(points) < self.n:
            points = np.pad(points, (0, self.n - len(points)), constant_values=_SPACE)
        codes = np.zeros(len(points) - self.n + 1, np.uint64)
        for place in range(self.n):
            codes |= points[place : len(points) - self.n + 1 + place] << np.uint64(21 * place)
        codes, counts = np.unique(codes, return_counts=True)
        bundle = counts.astype(np.float32) @ self._of(codes)
        length = float(np.sqrt(bundle @ bundle))
        return bundle / length if length else None


_MADE: dict = {}


def _profiles() -> Profiles:
    if not _MADE:
        _MADE[0] = Profiles()
    return _MADE[0]


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Language prototypes from all rows with a language and letters.

    Each task sends one sum a language; a language's sum is held by the driver (languages are few by
    nature, never as many as documents). Rows with a null language, and texts without letters, teach
    nothing; no such row left gives no prototype.
    """

    def run(batches):
        made = _profiles()
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for t, of in zip(b.column("text"), b.column("lang"), strict=True):
                v = made.text(t.as_py())
                if v is not None:
                    s = sums.setdefault(of.as_py(), np.zeros(made.dims))
                    s += v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    bound_batches(df.sparkSession)
    rows = df.filter(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    parts = rows.mapInArrow(run, "lang string, v array<double>")
    each = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    units = {}
    for r in whole.collect():
        v = np.array([p["x"] for p in r["v"]])
        if np.linalg.norm(v):
            units[r["lang"]] = v / np.linalg.norm(v)
    return dict(sorted(units.items()))


#: By language, the fences of the length classes from the shortest learned one up.
Fences = dict[str, list[tuple[int, float]]]


def fences(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", lang: str = "lang") -> Fences:
    """How like its language a text must be, by length class, from all rows that ``learn`` learns from.

    A class with less than ENOUGH texts takes in the shorter classes. Short texts vary so much that their
    fence can be below any likeness; they hold too little to tell."""
    schema = "lang string, class int, likeness double"

    def run(batches):
        made = _profiles()
        for b in batches:
            langs, classes, likes = [], [], []
            for t, of in zip(b.column("text"), b.column("lang"), strict=True):
                whole, own = t.as_py(), prototypes.get(of.as_py())
                v = made.text(whole) if own is not None else None
                if v is not None:
                    langs.append(of.as_py())
                    classes.append(made.length_class(whole))
                    likes.append(float(own @ v))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(classes, pa.int32()), pa.array(likes, pa.float64())], names=["lang", "class", "likeness"])

    bound_batches(df.sparkSession)
    rows = df.filter(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    each = rows.mapInArrow(run, schema).groupBy("lang", "class").agg(F.count("*").alias("n"), F.sum("likeness").alias("x"), F.sum(F.col("likeness") * F.col("likeness")).alias("xx"))
    out: Fences = {}
    sums: dict[str, list[tuple[int, int, float, float]]] = {}
    for r in each.orderBy("lang", "class").collect():
        seen = sums.setdefault(r["lang"], [])
        seen.append((r["class"], r["n"], r["x"], r["xx"]))
        n, x, xx = 0, 0.0, 0.0
        for _, more, y, yy in reversed(seen):
            if n < ENOUGH:
                n, x, xx = n + more, x + y, xx + yy
        mean = x / n
        out.setdefault(r["lang"], []).append((r["class"], mean - DEVIATIONS * max(0.0, xx / n - mean * mean) ** 0.5))
    return out


def _fence(of: list[tuple[int, float]], length_class: int) -> float:
    """The fence of the class, or of the next shorter one learned; below all of them there is none."""
    return next((least for c, least in reversed(of) if c <= length_class), -1.0)


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", pred: str = "lang_pred", score: str = "score", least: Fences | None = None) -> DataFrame:
    """Add the language of each whole text, and (1 + cosine) / 2 as its score from 0 to 1.

    A null text, one without letters, or no prototypes at all: ``und`` and 0; with fences also a text less
    like its language than the fence of its length. Ties go to the language that sorts first. Input columns
    named like the outputs are replaced.
    """
    names = sorted(prototypes)
    schema = T.StructType([f for f in df.schema.fields if f.name not in (pred, score)] + [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    centred = np.stack([prototypes[n] for n in names]).astype(np.float64) if names else np.empty((0, DIMS))
    if len(names) > 1:
        centred = centred - centred.mean(axis=0)
        lengths = np.linalg.norm(centred, axis=1, keepdims=True)
        centred = centred / np.where(lengths > 0, lengths, 1.0)
    bound_batches(df.sparkSession)
    held = centred.astype(np.float32)

    def unlike(made: Profiles, whole: str, v: np.ndarray, name: str) -> bool:
        return least is not None and float(prototypes[name] @ v) < _fence(least.get(name, []), made.length_class(whole)) - 1e-6

    def run(batches):
        made = _profiles()
        for b in batches:
            langs, scores = [], []
            for t in b.column(text):
                whole = t.as_py()
                v = made.text(whole) if names else None
                if v is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosine = held @ v
                best = int(cosine.argmax())
                if unlike(made, whole, v, names[best]):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, (1.0 + float(cosine[best])) / 2))))
            made_of = {pred: pa.array(langs, pa.string()), score: pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays([made_of[c] if c in made_of else b.column(c) for c in schema.names], names=schema.names)

    return df.mapInArrow(run, schema)

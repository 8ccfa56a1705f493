"""Language identification by bit-sliced Bloom filters of character n-grams.

One table of fixed size holds the filters of all languages: a slot's bit l belongs to language l. Looking an n-gram up is
the AND of its slots, and returns every language that has it at once. A text's n-grams are looked up and counted for
each language; a count is corrected for the filter's rate of false positives, known from its fill, and the language
with the largest corrected share wins. A language's filter gets the n-grams that make up at least 1/65,536 of its
training n-grams, so at most 65,536 of them, from counts over all training texts.

N-grams are four code points of the lower-cased text, the middle two letters; other characters are one mark.

Defined cases: null text and text without a letter are `und` with score 0. A text with letters but no n-gram known is the
language with most training n-grams, score 0; without training rows all is `und`. Texts are whole. Ties go to the
language first in order. Rows with a null text or language are not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import common as C

SLOTS = 1 << 20
HASHES = 2
LEAST_SHARE = 1 / 65_536

_LOW = np.array([chr(c).isalpha() for c in range(0x3000)])
_K = np.uint64(0x100000001B3)


def _letters(points: np.ndarray) -> np.ndarray:
    out = _LOW[np.minimum(points, len(_LOW) - 1)]
    high = np.flatnonzero(points >= len(_LOW))
    if len(high):
        values, at = np.unique(points[high], return_inverse=True)
        out[high] = np.array([chr(c).isalpha() for c in values.tolist()])[at]
    return out


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, offsets of each text's, and which texts have a letter."""
    lower = [" " + (t or "").lower() + " " for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.concatenate([[0], np.cumsum([len(t) for t in lower])])
    letter = _letters(points)
    p = np.where(letter, points, 32).astype(np.uint64)
    n = len(p) - 3
    h = ((p[:n] * _K + p[1 : n + 1]) * _K + p[2 : n + 2]) * _K + p[3:]
    good = letter[1 : n + 1] & letter[2 : n + 2]  # texts are padded, so these four stand in one text
    before = np.concatenate([[0], np.cumsum(good), np.full(3, good.sum())])
    some = np.concatenate([[0], np.cumsum(letter)])
    return C.mix(h[good]), before[off], some[off[1:]] > some[off[:-1]]


def _slots(h: np.ndarray) -> list[np.ndarray]:
    return [(C.mix(h + np.uint64(i + 1) * C._STEP) % np.uint64(SLOTS)).astype(np.int64) for i in range(HASHES)]


class LanguageFilters:
    def __init__(self, languages: list[str], table: np.ndarray, default: str):
        self.languages, self.table, self.default = languages, table, default
        bits = [(table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(len(languages))]
        self.false = [float(b.mean()) ** HASHES for b in bits]

    def predict(self, docs: DataFrame) -> DataFrame:
        """The columns of `docs` but `text`, with `lang_pred, score`."""
        me, kept = self, [c for c in docs.columns if c != "text"]

        def run(batches):
            for batch in batches:
                for b in C.slices(batch):
                    names, scores = me._predict(b.column("text").to_pylist())
                    yield pa.record_batch([*[b.column(c) for c in kept], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

        kind = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text")
        return docs.mapInArrow(run, kind + ", lang_pred string, score double")

    def _predict(self, texts):
        h, off, lettered = grams(texts)
        one, two = _slots(h)
        hits = self.table[one] & self.table[two]
        n = np.diff(off)
        shares = np.zeros((len(self.languages), len(texts)))
        for i, wrong in enumerate(self.false):
            bit = ((hits[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64)
            count = np.diff(np.concatenate([[0], np.cumsum(bit)])[off])
            shares[i] = np.clip((count / np.maximum(n, 1) - wrong) / (1 - wrong) if wrong < 1 else 0, 0, 1)
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        best, top = shares.argmax(axis=0), shares.max(axis=0)
        names = [("und" if not ok else self.languages[b] if s > 0 else self.default) for ok, b, s in zip(lettered, best, top, strict=True)]
        return names, np.where(lettered, top, 0.0)


def _merged(h: list, k: list) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(np.concatenate(h), return_inverse=True)
    return values, np.bincount(at, np.concatenate(k)).astype(np.int64)


def counts(docs: DataFrame) -> DataFrame:
    """`lang, gram, n` over all texts of each language."""

    def run(batches):
        held: dict[str, tuple[list, list]] = {}

        def out(lang):
            h, k = _merged(*held.pop(lang))
            return pa.record_batch([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(k)], ["lang", "gram", "n"])

        for batch in batches:
            for b in C.slices(batch):
                langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
                for lang in dict.fromkeys(langs):
                    h, _, _ = grams([t for t, x in zip(texts, langs, strict=True) if x == lang])
                    u, k = np.unique(h, return_counts=True)
                    hs, ks = held.setdefault(lang, ([], []))
                    hs.append(u)
                    ks.append(k)
                    if len(hs) > 20:
                        h, k = _merged(hs, ks)
                        held[lang] = ([h], [k])
                        if len(h) > 500_000:
                            yield out(lang)
        for lang in list(held):
            yield out(lang)

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, least: float = LEAST_SHARE) -> LanguageFilters:
    """Learns from `text, lang`. What comes back to the driver is a row for each language and at most SLOTS rows a word of 64."""
    scratch = C.Scratch(docs.sparkSession)
    seen = scratch.table(counts(docs), "grams")
    totals = seen.groupBy("lang").agg(F.sum("n").alias("total"))
    found = sorted((r["lang"], r["total"]) for r in totals.collect())
    languages = [x for x, _ in found]
    if not found:
        return LanguageFilters([], np.zeros((SLOTS, 1), np.uint64), "und")
    number = {x: i for i, x in enumerate(languages)}
    kept = seen.join(F.broadcast(totals), "lang").where(F.col("n") >= F.lit(least) * F.col("total")).select("lang", "gram")

    def place(batches):
        for b in batches:
            h = b.column("gram").to_numpy().view(np.uint64)
            at = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
            for s in _slots(h):
                bit = np.uint64(1) << (at % 64).astype(np.uint64)
                yield pa.record_batch([pa.array(s), pa.array(at // 64), pa.array(bit.view(np.int64))], ["slot", "word", "mask"])

    rows = kept.mapInArrow(place, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    table = np.zeros((SLOTS, -(-len(languages) // 64)), np.uint64)
    table[rows["slot"].to_numpy(np.int64), rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    return LanguageFilters(languages, table, max(found, key=lambda x: x[1])[0])

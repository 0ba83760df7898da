"""Language identification with bit-sliced Bloom filters over character n-grams.

One table of slots holds all languages at once: bit l of a slot belongs to language l. An n-gram sets the bits of all
languages that contain it at each of its k slots; the AND of its slots is the mask of languages containing it, read for
64 languages a word by k look-ups. A text's languages are counted by the masks of its n-grams, a population count per
language. A filter of which a share q of the bits is set says yes by chance to q^k of the n-grams it never saw; the counts
are corrected by that rate, (hits / n - p) / (1 - p), and the largest corrected share decides.

Training counts n-grams over a sample of `per_lang` labelled documents a language (expected number, chosen by a hash of
the document's identity), of every language there is; a language holds every n-gram seen `least` times or more and at
`share` or more of the highest rate any language has. The slots are as many as the largest language's n-grams ask for, and
their words are made by a distributed OR, so the driver gets the finished table: 8 bytes a slot for each 64 languages.
Prediction reads nothing but the text.

Defined results: a null text, or one without letters, gives `und` with score 0; ties go to the language first by code
point; without any labelled text all other texts give `und` too; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .util import own, shared_dir, stored, trim

UNKNOWN = "und"
#: Slots of the filters for each n-gram of the largest language, rounded up to a power of two; at 10 the chance of a false yes stays under 3.3 percent.
ROOM, LEAST_SLOTS = 10, 1 << 16
HASHES = 2
_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    """Lower-cased letter of each code point, 0 for what is no letter."""
    global _FOLD
    if _FOLD is None:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()[0])
        _FOLD = table
    return _FOLD


def grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of letters (runs of other signs count as one space), the text each is of, letters a text.

    A text begins and ends with a space; its n-grams are the same whatever texts stand beside it.
    """
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = "\x00" + "\x00".join(texts) + "\x00"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _fold()[raw]
    starts = np.r_[0, np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))]  # of the space before each text, and of the last
    letters = np.add.reduceat((code > 0).astype(np.int64), starts[:-1])
    kept = (code > 0) | np.r_[True, code[:-1] > 0]
    kept[starts] = True
    keep = np.nonzero(kept)[0]
    code = code[keep].astype(np.uint64)
    m = len(code) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), letters
    h = code[:m].copy()
    spaces = np.zeros(m, bool)
    with np.errstate(over="ignore"):
        for i in range(1, n):
            part = code[i : i + m]
            h = h * np.uint64(0x9E3779B97F4A7C15) + part
            if i < n - 1:
                spaces |= part == 0  # a gram is of one word: only its first and last sign may be a space
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    ok = np.nonzero(~spaces)[0]
    owner = np.searchsorted(starts, keep[ok], "right") - 1
    return h[ok], owner, letters


def slots(h: np.ndarray, size: int) -> list[np.ndarray]:
    return [((h >> np.uint64(32 * i)) & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass(frozen=True)
class Model:
    """langs[l] owns bit l % bits of word l // bits of every slot, where a word of table (words x slots) has so many bits; chance[l] is that filter's rate of false yes."""

    langs: list[str]
    table: np.ndarray
    chance: np.ndarray
    n: int

    def masks(self, h: np.ndarray) -> np.ndarray:
        """The languages that hold each n-gram, a row of bits a word."""
        mask = np.full((len(self.table), len(h)), np.iinfo(self.table.dtype).max, self.table.dtype)
        for s in slots(h, self.table.shape[1]):
            mask &= self.table[:, s]
        return mask

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        full = [t or "" for t in texts]
        h, owner, letters = grams(full, self.n)
        score = np.zeros((len(full), max(1, len(self.langs))))
        mask, kind = self.masks(h), self.table.dtype.type
        bits = np.iinfo(self.table.dtype).bits
        total = np.maximum(np.bincount(owner, minlength=len(full)), 1)
        for lang in range(len(self.langs)):
            yes = np.bincount(owner, (mask[lang // bits] >> kind(lang % bits)) & kind(1), len(full))
            score[:, lang] = np.clip((yes / total - self.chance[lang]) / (1 - self.chance[lang]), 0, 1)
        best = score.argmax(axis=1)
        known = (letters > 0) & bool(self.langs)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score.max(axis=1), 0.0)


def train(labelled: DataFrame, order: Column, n: int = 4, per_lang: int = 1500, least: int = 3, share: float = 0.2) -> Model:
    """Fit on (text, lang) where both are set; `order` is a hash column that picks the sample of per_lang documents a language."""
    shared_dir(labelled.sparkSession)
    rows = labelled.where("text is not null and lang is not null").select("text", "lang", order.alias("_h"))
    # a row a language; Spark broadcasts it after a look at the files' size, or joins by a shuffle
    rates = stored(rows.groupBy("lang").agg((F.lit(float(per_lang)) / F.count(F.lit(1))).alias("_take")), "languages")
    picked = rows.join(rates, "lang").where((F.pmod("_h", F.lit(1 << 20)) / float(1 << 20)) < F.col("_take"))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            langs = b.column(1).to_pylist()
            texts = b.column(0).to_pylist()
            for lang in sorted(set(langs)):
                h, _, _ = grams([t for t, x in zip(texts, langs, strict=True) if x == lang], n)
                g, c = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], ["lang", "gram", "n"])

    seen = stored(picked.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "grams")
    every = seen.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("grams")).collect()  # a row a language
    every = sorted(every, key=lambda r: r["lang"])
    langs = [r["lang"] for r in every]
    if not langs:
        return Model([], np.zeros((1, LEAST_SLOTS), np.uint8), np.zeros(1), n)
    size = LEAST_SLOTS
    while size < ROOM * max(r["grams"] for r in every):
        size *= 2
    bits = next((k for k in (8, 16, 32) if k >= len(langs)), 64)
    places = stored(labelled.sparkSession.createDataFrame([(r["lang"], i // bits, i % bits, float(r["total"])) for i, r in enumerate(every)], "lang string, word int, bit int, total double"), "places")
    rated = seen.join(places, "lang").withColumn("rate", F.col("n") / F.col("total"))
    kept = rated.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= share * F.col("top"))  # at most a row a language in a window
    at = F.array(*(F.shiftrightunsigned("gram", 32 * i).bitwiseAND(F.lit(size - 1)) for i in range(HASHES)))
    words = kept.select("word", F.expr("shiftleft(1L, bit)").alias("mask"), F.explode(at).alias("slot")).groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    got = words.toArrow()
    table = np.zeros((-(-len(langs) // bits), size), np.dtype(f"uint{bits}"))
    table[got["word"].to_numpy(), got["slot"].to_numpy()] = got["mask"].to_numpy().view(np.uint64).astype(table.dtype)
    chance = np.array([min(0.99, float(((table[i // bits] >> table.dtype.type(i % bits)) & table.dtype.type(1)).mean()) ** HASHES) for i in range(len(langs))])
    return Model(langs, table, chance, n)


def learn(docs: DataFrame) -> Model:
    """Learned outside the held-out fold, on a sample of 1,500 documents a language by a hash of doc_id."""
    return train(docs.where(~held_out()), F.xxhash64(F.lit("sample"), "doc_id"), per_lang=1500)


def annotate(docs: DataFrame, model: Model, lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """All columns of the documents, and the language and score of each whole text; columns so named are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a bounded sample: 8 bytes a slot for each 64 languages
    names = [c for c in docs.columns if c.lower() not in (lang_as.lower(), score_as.lower())]
    base = own(docs, *names)
    at_text = names.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lang, score = [], []
            texts = b.column(at_text).to_pylist()
            at = 0
            while at < len(texts):  # about a million signs at a time
                end, signs = at, 0
                while end < len(texts) and (end == at or signs < 1_000_000):
                    signs += len(texts[end] or "")
                    end += 1
                x, y = shared.value.predict(texts[at:end])
                lang += x
                score.append(y)
                at = end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(np.concatenate(score or [np.zeros(0)]))], [*names, lang_as, score_as])
        trim()

    shared_dir(docs.sparkSession)
    return base.mapInArrow(run, T.StructType([*base.schema, T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every document."""
    found = annotate(own(docs, "doc_id", "text"), model)
    return found.select(F.col("doc_id").cast("long"), "lang_pred", "score")


def held_out() -> Column:
    """The fold that no training sees: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))

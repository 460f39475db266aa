"""Language identification by language-bitmask n-gram filters (operator 4).

Training counts the letter trigrams (with word edges) of every labelled row, per language.  A
language's set holds its trigrams of share ``least_share`` or more, unless another language has the
trigram ``foreign`` times as often.  All sets live in one bit-sliced Bloom filter: slot s holds a bit
mask with a bit for each language whose filter has bit s, so the AND of a trigram's slots is the mask
of all languages that contain it.  A text's score for a language is its share of contained trigrams,
corrected for the filter's false positives; the highest decides, ties going to the smallest name.

A large input leaves rarer trigrams out, which lowers the coverage of languages with many letters; so coverage is to be
judged against ``usual``, the share that the language's set holds of its own training trigrams.

Size bound: a language has at most 1 / least_share trigrams, whatever the input, so the collected sets
and the broadcast filter are bounded by languages / least_share entries.

Defined results.  Null or letterless text, or a table without any usable label: ``und``, score 0.  A
text with letters but without a known trigram gets the most frequent learned language, score 0.  A row
whose doc_id is null is not held out and may train.  Repeated rows count as often as they occur; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialised
from .window_kernel import splitmix

HASHES = 4
LEAST_SHARE = 2e-5
FOREIGN = 8.0
UNKNOWN = "und"
#: Characters that are worked on at once.
BLOCK = 1 << 19
_LETTERS: list[np.ndarray] = []
_SPACE = np.uint32(32)


def letter_table() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams around the letters of text[1:-1], edges as spaces, and the places of the letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letter = letter_table()[codes]
    codes = np.where(letter, codes, _SPACE).astype(np.uint64)
    at = np.flatnonzero(letter[1:-1]) + 1
    return (codes[at - 1] << np.uint64(42)) | (codes[at] << np.uint64(21)) | codes[at + 1], at


def trigrams(texts: list[str], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of about ``block`` letters: the trigrams of lower-cased texts, and the text of each; longer texts go over several blocks."""
    first, held, size = 0, [], 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        gram, at = _grams(" " + " ".join(held) + " ")
        owner = np.repeat(np.arange(first, first + len(held)), np.fromiter(map(len, held), np.int64, len(held)) + 1)
        return gram, owner[at - 1]

    for i, text in enumerate(texts):
        low = text.lower()
        if held and size + len(low) > block:
            yield joined()
            held, size = [], 0
        if len(low) > block:
            if held:
                yield joined()
                held, size = [], 0
            for start in range(0, len(low), block):
                part = (low[start - 1] if start else " ") + low[start : start + block + 1]
                gram, at = _grams(part if start + block < len(low) else part + " ")
                yield gram, np.full(len(gram), i)
            continue
        if not held:
            first = i
        held.append(low)
        size += len(low)
    if held:
        yield joined()


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trigram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text), summed within each task first."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (gram, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            sums.clear()

        for b in batches:
            texts, langs = [t or "" for t in b["text"].to_pylist()], b["lang"].to_pylist()
            for lang in dict.fromkeys(langs):
                parts = [np.unique(gram, return_counts=True) for gram, _ in trigrams([t for t, own in zip(texts, langs, strict=True) if own == lang])]
                parts += [sums[lang]] if lang in sums else []
                if parts:
                    gram, to = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                    sums[lang] = gram, np.bincount(to, weights=np.concatenate([n for _, n in parts]), minlength=len(gram)).astype(np.int64)
            if sum(len(x[0]) for x in sums.values()) > 1_000_000:
                yield from out()
        yield from out()

    return rows.select("lang", "text").mapInArrow(over, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class LanguageFilter:
    langs: list[str]
    #: (slots, words): bit l % 64 of word l // 64 is language l.
    table: np.ndarray
    false_rate: np.ndarray
    fallback: str
    #: Share of each language's own training trigrams that its set contains.
    usual: np.ndarray

    def slots(self, gram: np.ndarray) -> list[np.ndarray]:
        x = splitmix(gram.astype(np.uint64))
        low, step = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
        return [((low + np.uint64(i) * step) & np.uint64(len(self.table) - 1)).astype(np.int64) for i in range(HASHES)]

    def masks(self, gram: np.ndarray) -> np.ndarray:
        first, *rest = self.slots(gram)
        out = self.table[first]
        for s in rest:
            out &= self.table[s]
        return out

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams of each text, and its corrected share of contained trigrams for each language."""
        total, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)))
        for gram, owner in trigrams(texts):
            total += np.bincount(owner, minlength=len(texts))
            kinds, to = np.unique(gram, return_inverse=True)
            masks = self.masks(kinds)[to]
            for i in range(len(self.langs)):
                bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                hits[:, i] += np.bincount(owner, weights=bit, minlength=len(texts))
        share = hits / np.maximum(total, 1)[:, None]
        return total, np.clip((share - self.false_rate) / (1 - self.false_rate), 0, 1)


def fit(counts: DataFrame, least_share: float = LEAST_SHARE, foreign: float = FOREIGN) -> LanguageFilter | None:
    """The filter of (lang, gram, n); None if there is no language."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= least_share)
    most = share.groupBy("gram").agg(F.max("share").alias("most"))
    kept = share.join(most, "gram").where(F.col("share") * foreign >= F.col("most")).select("lang", "gram", "share")
    sizes = {r["lang"]: r["total"] for r in totals.collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    rows = kept.toArrow()
    lang = np.array([langs.index(x) for x in rows["lang"].to_pylist()], np.int64)
    gram = rows["gram"].to_numpy().view(np.uint64)
    most_grams = int(np.bincount(lang, minlength=1).max())
    slots = 1 << max(10, (16 * most_grams - 1).bit_length())
    model = LanguageFilter(langs, np.zeros((slots, (len(langs) + 63) // 64), np.uint64), np.zeros(len(langs)), max(langs, key=lambda x: (sizes[x], x)), np.bincount(lang, weights=rows["share"].to_numpy(), minlength=len(langs)))
    for s in model.slots(gram):
        np.bitwise_or.at(model.table, (s, lang // 64), np.uint64(1) << (lang % 64).astype(np.uint64))
    for i in range(len(langs)):
        model.false_rate[i] = np.mean((model.table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) ** HASHES
    return model


def predict(docs: DataFrame, model: LanguageFilter | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with lang_pred, score (the winner's part of all languages' shares), coverage (its share), n_grams and usual (what its own training trigrams' share was)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in keep or docs.columns if c not in ("lang_pred", "score", "coverage", "n_grams", "usual")]

    def told(column: pa.Array) -> pa.Array:
        m, texts = sent.value, [t or "" for t in column.to_pylist()]
        langs, score, coverage, total, usual = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        if m and texts:
            total, shares = m.shares(texts)
            best = shares.argmax(axis=1)
            coverage = shares.max(axis=1)
            score = np.where(coverage > 0, coverage / np.maximum(shares.sum(axis=1), 1e-12), 0.0)
            usual = m.usual[np.where(coverage > 0, best, m.langs.index(m.fallback))]
            langs = [UNKNOWN if not n else m.langs[i] if c > 0 else m.fallback for n, i, c in zip(total.tolist(), best.tolist(), coverage.tolist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score), pa.array(coverage), pa.array(total), pa.array(usual)], names=["lang_pred", "score", "coverage", "n_grams", "usual"])

    # only the texts go to Python; marked as not repeatable so that a filter on the result is not a second call
    told = F.arrow_udf(told, "struct<lang_pred:string,score:double,coverage:double,n_grams:long,usual:double>").asNondeterministic()
    return docs.select(*own, told(F.col(text_col)).alias("_told")).select(*own, "_told.*")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with lang_pred, score and coverage, learned from their labelled rows that are not held out."""
    train = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # written, as the filter's making reads them three times
    counts = materialised(trigram_counts(train), "trigrams")
    model = fit(counts)
    discard(counts)
    return predict(docs, model, text_col, keep)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Operator 4 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, keep=["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "coverage")

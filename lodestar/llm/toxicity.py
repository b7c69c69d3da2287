"""Toxicity by compression distance.

Two dictionaries are trained by zstandard's trainer: one on ordinary texts, one
on what toxic texts have and the ordinary ones of the sample never do. A text is
the stream of its words, each written as a code of twelve bytes, so that a
compressed length counts the words that a dictionary lacks and not their
letters. The toxic compressor has the ordinary dictionary and the toxic one, so
that plain text compresses alike with both. Every window of 16 words of the
whole text is compressed with both; its gain is how many bytes the toxic
dictionary saves, and a text is judged by its best window.

A long text has many windows in which a word may be known by chance. How often
an ordinary window has such a hit is measured, and the gain that a text needs
grows with the logarithm of its windows accordingly, so that clean texts of any
length are left alone. The size of the toxic dictionary and the threshold are
calibrated on labelled rows that trained no dictionary: a clean text judged
toxic weighs as much as WRONG toxic ones missed.

Labels are learnt from rows whose CRC-32 of the doc_id as text isn't a multiple
of five; of these, the first by digest up to `sample` rows of each class (a
documented bound) among texts up to `sample_bytes`. Every whole text of the
table is scored.

Cases. A null or empty text has no window and the least score. A label whose
document is missing is left out; a document labelled twice is toxic if any
label says so, and rows that share a doc_id are learnt from each with its text. A
null doc_id isn't held out, as it has no label. Without labels of both classes
every score is the least one. Very long texts are scored whole, window by
window. Repeated rows score alike, a score of exactly 0.5 counts as toxic. No
rows: no result. Columns beside doc_id and text don't matter to score(), and
without_toxic() returns them as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted, ship, text_digest

ship(__name__)

FOLDS = 5
#: Rows learnt from, ordinary and toxic, and the bytes of their texts: at most 164 MB, in one task.
SAMPLE, SAMPLE_BYTES = (8_000, 2_000), 16_384
#: Bytes of a word's code, words of a window, bytes of the ordinary dictionary and tried for the toxic one.
CODE, SPAN, ORDINARY, TOXIC = 12, 16, 393_216, (1_024, 1_536, 2_048, 3_072, 4_096)
#: The gain of one known word; what a clean text judged toxic weighs; of the rows every so many calibrates.
HIT, WRONG, CALIBRATES = 8, 8, 4
#: Codes that a worker remembers, and while it learns; bytes of codes that the ordinary dictionary is trained on.
KEPT, LEARNING, TRAINED = 500_000, 50_000, 4 << 20
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Codes(dict):
    """A code for each word, unlike those of others; up to `kept` are remembered."""

    def __init__(self, kept: int = KEPT):
        super().__init__()
        self.kept = kept

    def __missing__(self, word: str) -> bytes:
        import xxhash

        if len(self) > self.kept:
            self.clear()
        self[word] = code = xxhash.xxh128_digest(word.encode("utf-8", "surrogatepass"))[:CODE]
        return code

    def of(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, _WORD.findall((text or "").lower())))


def _numbers(codes: bytes) -> np.ndarray:
    """Of each word the first eight bytes of its code."""
    return np.frombuffer(codes, np.uint8).reshape(-1, CODE)[:, :8].copy().view(np.uint64).ravel()


class Compressors:
    """The ordinary and the toxic one. zstandard's dictionaries are made here, from their content."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z

        how = z.ZstdCompressionParameters(window_log=22, chain_log=17, hash_log=17, search_log=4, min_match=6, target_length=16, strategy=z.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.made = []
        for content in (ordinary, ordinary + toxic):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.made.append(z.ZstdCompressor(dict_data=d, compression_params=how).compress)

    def gains(self, codes: bytes) -> list[int]:
        """Of each window, how many bytes the toxic dictionary saves."""
        (plain, toxic), step = self.made, SPAN * CODE
        windows = (codes[at : at + step] for at in range(0, len(codes), step))
        return [len(plain(w)) - len(toxic(w)) for w in windows]


@dataclass
class Model:
    ordinary: bytes = b"\0" * 8
    toxic: bytes = b""
    slope: float = 0.0  # gain for each e-fold of windows
    threshold: float = 1e9

    def compressors(self) -> Compressors:
        return Compressors(self.ordinary, self.toxic)

    def value(self, gains: list[int]) -> float:
        """The best window's gain, less what the number of windows makes likely by chance."""
        return max(gains) - self.slope * float(np.log(len(gains))) if gains else -1e6

    def score(self, value: float) -> float:
        """Half at the threshold."""
        return float(1 / (1 + np.exp(np.clip((self.threshold - value) / 2, -50, 50))))


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary that zstandard trained on the samples; the samples themselves where they are too few for it."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, k=16, d=8, level=3).as_bytes()
    except (z.ZstdError, MemoryError):
        return b"".join(samples)[-size:]


def train(rows: list[tuple[int, str, int]]) -> Model:
    """rows: doc_id, text, toxic. Of equal texts one counts, as toxic if any is; every fourth calibrates, the others train."""
    seen: dict[str, int] = {}
    for _, text, toxic in rows:
        seen[text] = max(toxic, seen.get(text, 0))
    order, codes = sorted(seen, key=lambda t: (zlib.crc32(t.encode("utf-8", "surrogatepass")), t)), Codes(LEARNING)
    texts = {k: [codes.of(t) for t in order if seen[t] == k] for k in (0, 1)}
    fit = {k: [c for i, c in enumerate(v) if i % CALIBRATES and c] for k, v in texts.items()}
    held = {k: v[::CALIBRATES] for k, v in texts.items()}
    del texts, seen, order
    if not all(fit.values()) or not all(held.values()):
        return Model()
    common = np.unique(np.sort(np.concatenate([_numbers(c) for c in fit[0]])))
    odd = []
    for c in fit[1]:
        numbers, first = np.unique(_numbers(c), return_index=True)
        known = common[np.searchsorted(common, numbers).clip(max=len(common) - 1)] == numbers
        odd.append(b"".join(c[at * CODE : (at + 1) * CODE] for at in sorted(first[~known])))
    odd = [x for x in odd if x]
    # The trainer needs several times its samples' memory.
    upto = np.searchsorted(np.cumsum([len(c) for c in fit[0]]), TRAINED) + 1
    ordinary, best = _trained(fit[0][:upto], ORDINARY), (-1e9, Model())
    del fit, common
    for size in TOXIC if odd else ():
        model = Model(ordinary, _trained(odd, size))
        c = model.compressors()
        gains = {k: [c.gains(x) for x in v] for k, v in held.items()}
        # How many ordinary windows have a word that the toxic dictionary knows.
        flat = np.array([g for x in gains[0] for g in x])
        by_chance = ((flat > HIT / 2).sum() + 1) / (len(flat) + 2)
        model.slope = HIT / -float(np.log(min(by_chance, 0.5)))
        values = {k: np.array([model.value(x) for x in v]) for k, v in gains.items()}
        for cut in np.arange(0, 6 * HIT, 0.5):
            worth = (values[1] > cut).mean() - WRONG * (values[0] > cut).mean()
            if (key := round(float(worth), 6)) > best[0]:
                best = key, Model(model.ordinary, model.toxic, model.slope, float(cut) + 0.25)
    return best[1]


def sample(docs: DataFrame, labels: DataFrame, each: tuple[int, int] = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The labelled rows to learn from (doc_id, text, toxic), each[0] ordinary and each[1] toxic ones at most, of texts up to most_bytes."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = counted(known.withColumnRenamed("doc_id", "_id"))
    text = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes))
    rows = text.join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "toxic", text_digest(F.col("text")).alias("_text")).distinct()
    key = F.md5(F.concat_ws(":", F.lit("sample"), F.col("doc_id").cast("string"), "_text"))
    some = [rows.where(F.col("toxic") == k).orderBy(key, "doc_id").limit(n) for k, n in enumerate(each)]
    ids = some[0].unionByName(some[1]).select(F.col("doc_id").alias("_id"), "toxic", "_text")  # sum(each) rows at most
    rows = text.join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (text_digest(F.col("text")) == F.col("_text")))
    return rows.groupBy("doc_id", "_text").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("doc_id", "text", "toxic")


def fitted(docs: DataFrame, labels: DataFrame, **how) -> Model:
    """The model of the sample, which one task learns from; its texts don't reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = train([(None, t, k) for b in batches for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array([m.ordinary], pa.binary()), pa.array([m.toxic], pa.binary()), pa.array([m.slope], pa.float64()), pa.array([m.threshold], pa.float64())], names=["ordinary", "toxic", "slope", "threshold"])

    rows = sample(docs, labels, **how).select("text", "toxic").repartition(1)
    made = rows.mapInArrow(run, "ordinary binary, toxic binary, slope double, threshold double").collect()
    return Model(bytes(made[0]["ordinary"]), bytes(made[0]["toxic"]), made[0]["slope"], made[0]["threshold"]) if made else Model()


def score(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted, gain (bytes saved in the best window, less what its length makes likely)."""
    model = fitted(docs, labels, **how)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, compressors = Codes(), model.compressors()
        for batch in batches:
            values = [model.value(compressors.gains(codes.of(t.as_py()))) for t in batch.column(2)]
            scores = [model.score(v) for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(values, pa.float64())], names=["doc_id", "held_out", "score", "predicted", "gain"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, gain double")


def without_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that aren't predicted toxic, in one pass over the texts."""
    model = fitted(docs, labels, **how)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, compressors = Codes(), model.compressors()
        for batch in batches:
            keep = [model.score(model.value(compressors.gains(codes.of(t.as_py())))) < 0.5 for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

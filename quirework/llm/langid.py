"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training documents are cut into n-grams of 1 to 3 lower-case characters, which a hash sends to a fixed number of buckets; the counts per
language and bucket, smoothed, become a matrix of log-probabilities of a size fixed by the buckets and the languages. It travels to
the executors, where a batch of texts is scored by gathering the matrix rows of its distinct (text, bucket) pairs and adding
them up per text.

The model is fit on a bounded sample: about `per_language` whole documents of each language, chosen by a hash of the
id among those that may be learned from. Defined results: a text that is null or has no letter is `und` with score 0; without
training documents everything is `und`; ties go to the language that sorts first; repeated rows get equal results; very long texts are read whole, in
parts of bounded size; an empty table gives no rows. Columns of documents pass through identify(), whatever they are called; those named lang_pred or score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, mix64, small_batches
from .quality import slices

ORDERS = (1, 2, 3)


def buckets(texts: list[str], size: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams of the texts and which text each is from, some `most` at a time. n-grams don't cross texts."""
    texts = [t.lower() for t in texts]
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    for n in ORDERS:
        for low in range(0, len(code) - n + 1, most):
            high = min(low + most, len(code) - n + 1)
            with np.errstate(over="ignore"):
                gram = np.full(high - low, n, np.uint64)
                for k in range(n):
                    gram = gram * np.uint64(0x100000001B3) + code[low + k : high + k]
            at = np.arange(low, high)
            owner = np.searchsorted(ends, at, "right")
            within = at + n <= ends[owner]
            yield (mix64(gram)[within] % np.uint64(size)).astype(np.int64), owner[within]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(docs: DataFrame, size: int) -> DataFrame:
    """(lang, bucket, n) over all rows of docs; each task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in set(langs):
                own = batch.filter(pa.array([x == lang for x in langs]))
                for part in slices(own.column("text")):
                    for found, _ in buckets(part.to_pylist(), size):
                        total[lang] = total.get(lang, 0) + np.bincount(found, minlength=size)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, per_language: int = 3000, size: int = 1 << 15, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the matrix of log-probabilities with a row for each bucket. Ids whose crc32 leaves 2 by 4 are never read."""
    small_batches(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(id_crc() % 4 != 2, F.lit(True)))
    share = {r["lang"]: per_language / r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    chance = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) / 1e6
    some = {lang: s for lang, s in share.items() if s < 1}
    if some:
        least = F.create_map(*[F.lit(x) for pair in some.items() for x in pair])
        usable = usable.where(chance < F.coalesce(F.try_element_at(least, F.col("lang")), F.lit(2.0)))
    rows = counts(usable, size).toPandas() if share else pd.DataFrame({"lang": [], "bucket": [], "n": []})
    langs = sorted(share)
    n = np.full((size, len(langs)), smoothing)
    np.add.at(n, (rows["bucket"].to_numpy(np.int64), rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)), rows["n"].to_numpy(float))
    return langs, np.log(n / n.sum(0)).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs with lang_pred and score, the posterior of that language with a flat prior."""
    langs, log_p = model
    size = len(log_p)
    shared = docs.sparkSession.sparkContext.broadcast(log_p)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = shared.value
        for part in parts:
            names, scores = [], []
            for some in slices(part, 1 << 19):
                texts = some.to_pylist()
                readable = np.array([has_letter(t) for t in texts])
                total = np.zeros((len(texts), len(langs)))
                if len(langs):
                    for found, of in buckets([t or "" for t in texts], size):
                        key, n = np.unique(of * size + found, return_counts=True)
                        if len(key):
                            rows = weights[key % size] * n[:, None]
                            text = key // size
                            first = np.flatnonzero(np.diff(text, prepend=-1))
                            total[text[first]] += np.add.reduceat(rows.astype(float), first)
                    best = total.argmax(1)
                    score = 1 / np.exp(np.clip(total - total.max(1, keepdims=True), -700, 0)).sum(1)
                for i, ok in enumerate(readable):
                    ok = ok and len(langs) > 0
                    names.append(langs[best[i]] if ok else "und")
                    scores.append(float(score[i]) if ok else 0.0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), predict("text").alias("found"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("lang_pred", "score")], "found.lang_pred", "found.score")


def identified(docs: DataFrame, per_language: int = 3000) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs."""
    out = identify(docs.select("doc_id", "text"), train(docs, per_language))
    return out.select("doc_id", F.coalesce(id_crc() % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")

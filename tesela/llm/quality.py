"""Quality by importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k. A second ratio rejects toxic texts."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm.common import U64, blocks, checkpoint, mix, table, trim, utf8, word_places, words

#: Parts of a unit of score that scores are held in, so that sums and cuts are whole numbers.
GRAIN = 1_000_000
#: What parts words for the toxic model: white space and ASCII punctuation.
_BREAKS = np.zeros(256, bool)
_BREAKS[[*range(9, 14), 32, *map(ord, string.punctuation)]] = True


@dataclass(frozen=True)
class QualityConfig:
    """buckets: of hashed words and word pairs. smoothing: added to every bucket. temperature: of the Gumbel noise.

    max_labelled: bound of the labelled rows that the target model and the cut are fitted on, the rows with the
    smallest hashes of their ids; every count of the raw model covers all documents. clean_weight: how many rejected
    bad rows a lost clean row outweighs when a cut is chosen. toxic_buckets: of hashed words of the toxic model.
    strongest: how many different words with the largest toxic ratios make a text's toxicity.
    """

    buckets: int = 1 << 15
    smoothing: float = 1.0
    temperature: float = 0.05
    max_labelled: int = 20_000
    clean_weight: float = 4.0
    toxic_buckets: int = 1 << 20
    strongest: int = 3
    seed: int = 17


@dataclass(frozen=True)
class QualityModel:
    """ratios, toxic: log ratios by bucket. cut: the least score of clean rows; limit: the most toxicity of rows that may stay."""

    ratios: np.ndarray
    toxic: np.ndarray
    strongest: int
    cut: float = -np.inf
    limit: float = np.inf


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of all rows, and the row of each."""
    w, at = words(data, offsets, lower=False)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pairs = mix(w[:-1] * U64(3) + w[1:])[row[:-1] == row[1:]] if len(w) else w
    found = np.concatenate([w, pairs]) % U64(buckets)
    return found.astype(np.int64), np.concatenate([row, row[:-1][row[:-1] == row[1:]]])


def toxic_words(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of all rows without ASCII punctuation, ASCII letters in lower case, and the row of each."""
    w, at = word_places(data, offsets, breaks=_BREAKS)
    return (w % U64(buckets)).astype(np.int64), np.searchsorted(offsets, at, "right") - 1


def toxicity(data: np.ndarray, offsets: np.ndarray, model: QualityModel) -> np.ndarray:
    """The mean of the largest ratios of a row's different words; what is below 0 or missing counts as 0."""
    m, n = len(model.toxic), len(offsets) - 1
    found, row = toxic_words(data, offsets, m)
    some = model.toxic[found] > 0
    key = np.unique(row[some] * m + found[some])
    row, value = key // m, model.toxic[key % m]
    order = np.lexsort((-value, row))
    row, value = row[order], value[order]
    top = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row] < model.strongest
    return np.bincount(row[top], value[top], n) / model.strongest


def toxic_ratios(rows: DataFrame, config: QualityConfig) -> np.ndarray:
    """By bucket, the log of the share of toxic rows with a word over the share of clean rows with it. rows: text, good, toxic.

    The driver gets a row for each bucket. Without rows of both kinds all ratios are 0."""
    m = config.toxic_buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, m + 1), np.int64)  # place m counts rows
        for batch in batches:
            data, offs = utf8(batch.column(0))
            kinds = batch.column(1).to_numpy(zero_copy_only=False) == 1, batch.column(2).to_numpy(zero_copy_only=False) == 1
            for a, b in blocks(offs):
                found, row = toxic_words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], m)
                key = np.unique(row * m + found)
                for k, kind in enumerate(kinds):
                    counts[k, :m] += np.bincount((key % m)[kind[a:b][key // m]], minlength=m)
                    counts[k, m] += int(kind[a:b].sum())
        at = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], ["bucket", "clean", "toxic"])

    counted = rows.select("text", "good", "toxic").mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean"), F.sum("toxic")).toPandas().to_numpy()
    clean, toxic = np.zeros(m + 1), np.zeros(m + 1)
    if len(counted):
        clean[counted[:, 0]], toxic[counted[:, 0]] = counted[:, 1], counted[:, 2]
    (n_clean, n_toxic), half = (clean[m], toxic[m]), config.smoothing / 2
    if not n_clean or not n_toxic:
        return np.zeros(m)
    share = lambda x, n: np.log((x + half * n / (n_clean + n_toxic)) / (n + half))
    return share(toxic[:m], n_toxic) - share(clean[:m], n_clean)


def gumbel_score(score: str, id_col: str, config: QualityConfig):
    """A column: score plus tempered Gumbel noise that depends on the seed and the id alone, in grains."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(config.seed), F.col(id_col)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.round((F.col(score) - F.lit(config.temperature) * F.log(-F.log(u))) * GRAIN).cast("long")


def fit(docs: DataFrame, labels: DataFrame, config: QualityConfig, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Log ratios by bucket, the score from which labelled rows count as clean, and the toxicity up to which they do.

    labels has doc_id, quality and toxic; a row is clean with quality 1 and toxic other than 1. Of several labels of an id
    the worst holds; null labels and ids count for nothing. The models see one half of the labelled rows and the cuts are set
    on the other, as rows that a model has seen score higher than unlabelled ones. Three passes over the texts; the driver gets a row for each
    bucket and one for each labelled row, both bounded. Without toxic rows that the model has seen there is no limit.
    """
    good = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) != 1)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(good.cast("int")).alias("good"), F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.max_labelled)
    known = known.withColumn("half", F.pmod(F.xxhash64(F.lit(config.seed), "doc_id"), F.lit(2)))
    bounded = F.broadcast(known.withColumnRenamed("doc_id", "known_id"))  # max_labelled rows at most
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    rows = rows.join(bounded, F.col("doc_id") == F.col("known_id"), "left").select("text", F.coalesce("good", F.lit(-1)).alias("good"), "toxic", "half")
    m = config.buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(m, np.int64), np.zeros(m, np.int64)
        for batch in batches:
            data, offs = utf8(batch.column(0))
            chosen = (batch.column(1).to_numpy(zero_copy_only=False) == 1) & (batch.column(2).to_numpy(zero_copy_only=False) == 0)
            for a, b in blocks(offs):
                found, row = features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], m)
                raw += np.bincount(found, minlength=m)
                target += np.bincount(found[chosen[a:b][row]], minlength=m)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    counted = rows.select("text", "good", "half").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).toPandas().to_numpy()
    raw, target = np.zeros(m), np.zeros(m)
    if len(counted):
        raw[counted[:, 0]], target[counted[:, 0]] = counted[:, 1], counted[:, 2]
    model = lambda x: np.log((x + config.smoothing) / (x.sum() + config.smoothing * m))
    fitted = QualityModel(model(target) - model(raw), toxic_ratios(rows.where("good >= 0 and half = 0"), config), config.strongest)
    labelled = scored(rows.where("good >= 0 and half = 1"), fitted, "text").select("score", "toxicity", "good", "toxic").toPandas()
    good, toxic = labelled["good"].to_numpy() == 1, labelled["toxic"].to_numpy() == 1
    cut = clean_cut(labelled["score"].to_numpy(), good, config.clean_weight)
    either = good | toxic
    limit = -clean_cut(-labelled["toxicity"].to_numpy()[either], good[either], config.clean_weight) if fitted.toxic.any() else np.inf
    return replace(fitted, cut=cut, limit=limit)


def clean_cut(score: np.ndarray, good: np.ndarray, weight: float) -> float:
    """The score with the least loss: kept bad rows plus `weight` for each lost clean one. Without both kinds, all stay."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(score, kind="stable")
    lost = np.concatenate([[0], np.cumsum(np.where(good[order], weight, 0))])
    left = (~good).sum() - np.concatenate([[0], np.cumsum(~good[order])])
    best = int(np.argmin(lost + left))
    return float(score[order[best]]) if best < len(score) else np.inf


def scored(docs: DataFrame, model: QualityModel, text_col: str = "text", names: tuple[str, str] = ("score", "toxicity")) -> DataFrame:
    """All columns and rows, with the log importance weight over the root of the number of features, and the toxicity.

    The sum alone grows with a text's length; without words the score is 0."""
    at = docs.columns.index(text_col)
    m = len(model.ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(at))
            out, toxic = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for a, b in blocks(offs):
                part = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                found, row = features(*part, m)
                out[a:b] = np.bincount(row, model.ratios[found], b - a) / np.sqrt(np.bincount(row, minlength=b - a) + 1)
                toxic[a:b] = toxicity(*part, model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(out, 9)), pa.array(np.round(toxic, 9))], [*batch.schema.names, *names])
            trim()

    return docs.mapInArrow(run, docs.select("*", *(F.lit(0.0).alias(x) for x in names)).schema)


def kth_largest(values: DataFrame, k: int) -> int | None:
    """The k-th largest of the long column z, by histograms: no sort, 4096 counts a pass to the driver."""
    lo, hi, n = values.agg(F.min("z"), F.max("z"), F.count("z")).first()
    if not n or k <= 0:
        return None
    k = min(k, n)
    while lo < hi:
        width = (hi - lo) // 4096 + 1
        part = values.where(F.col("z").between(lo, hi)).groupBy(F.floor((F.col("z") - lo) / width).cast("int").alias("b")).count().collect()
        for b, c in sorted(part, reverse=True):
            if c >= k:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            k -= c
    return lo


def decide(docs: DataFrame, labels: DataFrame, config: QualityConfig, id_col: str, text_col: str) -> tuple[QualityModel, int | None, DataFrame]:
    model = fit(docs, labels, config, id_col, text_col)
    rows = scored(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), model)
    rows = checkpoint(rows.select("doc_id", "score", "toxicity", gumbel_score("score", "doc_id", config).alias("z")))
    mild = rows.where(F.col("toxicity") <= model.limit)
    k = mild.where(F.col("score") >= model.cut).count()
    return model, kth_largest(mild, k), rows


def quality_scores(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (log importance weight), sampled_score (with noise), toxicity and kept.

    Rows whose toxicity is over the limit that labelled rows set go. k, the size of the sample, is the number of the others whose
    score reaches the cut that labelled rows set; their k largest noisy scores stay, with all that tie with the last. Null and empty
    texts score 0. Repeated rows have equal scores and fates. Without labels of both kinds all rows stay. An empty table gives no
    rows. Other columns aren't read.
    """
    model, last, rows = decide(docs, labels, config, id_col, text_col)
    kept = F.lit(False) if last is None else (F.col("z") >= last) & (F.col("toxicity") <= model.limit)
    return rows.select("doc_id", "score", (F.col("z") / GRAIN).alias("sampled_score"), "toxicity", kept.alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that quality_scores keeps, with all their columns as they came."""
    model, last, _ = decide(docs, labels, config, id_col, text_col)
    if last is None:
        return docs.limit(0)
    names = tuple([x for x in (f"score{i}" for i in range(len(docs.columns) + 2)) if x not in docs.columns][:2])
    rows = scored(docs, model, text_col, names)
    return rows.where((gumbel_score(names[0], id_col, config) >= last) & (F.col(names[1]) <= model.limit)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

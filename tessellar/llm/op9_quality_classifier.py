"""Quality classifier: document evidence under hierarchical empirical Bayes site priors.

1. Logistic regression on hashed words and a few shape features (repetition, capitals, symbols,
   cells, line copies), one head for low quality and one for toxicity. It is fitted by the driver on
   a sample of about TRAIN_ROWS labelled documents (a documented bound), with numpy.
2. All documents are scored in the executors.
3. Sites: expected numbers of good documents are summed by (host, path), then by host, then over
   all. The spread between hosts, and between paths of a host, gives each level's prior strength by
   moments; a path's posterior shrinks to its host's, a host's to the global mean, so sparse sites
   follow their parents. A document's own evidence is left out of its path's and its host's.
4. A document's log odds are its own evidence plus the shift of its path from the global mean.

Host and path are columns, for `documents` its source and, below it, its language section. Every sum
is an aggregation with partial sums; the site table is broadcast up to a checked number of rows, beyond it
only its hot sites (`components.looked_up`), so a host with a third of all rows is never one task.

Defined cases: null text or text without words has score 0 and is rejected; a very long text is scored
whole; a head without labels of both classes abstains (its documents are kept); null host or path is
a site of its own; a document alone at its host has the global mean as its prior; labels of one id
given more than once count as the worst of them, and an id with several texts is learned from one of
them; a score of exactly 0.5 is good, a toxic score of 0.5 is toxic; repeated rows give repeated rows; an
empty table gives an empty result; other columns are ignored, whatever their names, but one to be carried
under a name of the result is refused. Labels of which none is in the sample are an error, never an empty model.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm.common import claim, sample_bound, slices, table, texts_of, written
from tessellar.llm.components import looked_up

BUCKETS = 1 << 18
#: About so many labelled documents are learned from.
TRAIN_ROWS = 20_000
#: A word has a weight in a head if so many sampled documents hold it and its shares in the two
#: classes differ by so many standard errors.
LEAST_DOCUMENTS, LEAST_ERRORS = 4, 4.0
#: Entries of a worker's cache of word buckets; a full one is emptied between slices.
CACHE = 80_000
STRIPPED = ".,;:!?*$%&#|\"'()[]"
_UPPER, _LETTER, _SYMBOL, _BAR, _BANG, _DIGIT = (np.isin(np.arange(256), list(x)) for x in (range(65, 91), [*range(65, 91), *range(97, 123), *range(128, 256)], b"*$%&#@~^=<>{}\\", b"|", b"!", range(48, 58)))


class WordBuckets(dict):
    def __missing__(self, word: str) -> int:
        key = word.strip(STRIPPED).lower()
        self[word] = h = xxhash.xxh3_64_intdigest(key.encode()) % BUCKETS if key else -1
        return h


_buckets = WordBuckets()


def features(text: str) -> tuple[np.ndarray, list[float]] | None:
    """Sorted buckets of the distinct words, and the shape; None without words."""
    words = text.split()
    if not words:
        return None
    claim("quality", _buckets.clear)
    if len(_buckets) > CACHE:
        _buckets.clear()
    distinct = set(words)
    own = np.unique(np.fromiter(map(_buckets.__getitem__, distinct), np.int64, len(distinct)))
    bytes_ = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n, size = len(words), max(1, int(bytes_.sum()))
    lines = [x for x in text.split("\n") if x]
    shape = [
        len(distinct) / n,
        len(distinct) / math.sqrt(n),
        sum(map(eq, words, words[1:])) / n,
        bytes_[_UPPER].sum() / max(1, bytes_[_LETTER].sum()),
        min(1.0, bytes_[_SYMBOL].sum() / n),
        min(1.0, bytes_[_BAR].sum() / n),
        min(1.0, bytes_[_BANG].sum() / n),
        bytes_[_DIGIT].sum() / size,
        bytes_[_LETTER].sum() / size,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n),
    ]
    return own[own >= 0], [float(x) for x in shape]


#: Length of the shape.
SHAPE = 11


def telling(rows: np.ndarray, columns: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which words' shares differ between the classes."""
    n1, n0 = y.sum(), len(y) - y.sum()
    held1 = np.bincount(columns, y[rows], BUCKETS)
    held = np.bincount(columns, minlength=BUCKETS)
    share = held / len(y)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    return (held >= LEAST_DOCUMENTS) & (np.abs(held1 / n1 - (held - held1) / n0) >= LEAST_ERRORS * error)


def head(rows: np.ndarray, columns: np.ndarray, shape: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights of words and of shape (bias last) by full-batch Adam on the log loss; classes weigh alike."""
    n = len(y)
    words = np.flatnonzero(telling(rows, columns, y))
    place = np.full(BUCKETS, -1)
    place[words] = np.arange(len(words))
    own = place[columns]
    rows, own = rows[own >= 0], own[own >= 0]
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    theta = np.zeros(len(words) + shape.shape[1])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.bincount(rows, theta[own], n) + shape @ theta[len(words) :]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.concatenate([np.bincount(own, g[rows], len(words)), shape.T @ g]) + decay * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    theta[-1] += math.log(y.mean() / (1 - y.mean()))  # from balanced classes back to their shares
    out = np.zeros(BUCKETS, np.float32)
    out[words] = theta[: len(words)]
    return out, theta[len(words) :]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> dict:
    """Model of both heads: word weights, shape weights, the shape's mean and spread."""
    given = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("good"), F.coalesce(F.col("toxic").cast("int"), F.lit(0)).alias("toxic")).where("id is not null and good is not null")
    given = given.groupBy("id").agg(F.min("good").alias("good"), F.max("toxic").alias("toxic"))
    n = given.count()
    sample = given.where(F.xxhash64("id") <= F.lit(sample_bound(n, train_rows)))
    if n and not sample.limit(1).count():
        raise ValueError(f"no label of {n} is in the sample of about {train_rows}")

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                found = [features(t) for t in texts_of(part, 0)]
                keep = [i for i, f in enumerate(found) if f]
                yield pa.RecordBatch.from_arrays([pa.array([found[i][0].astype(np.int32) for i in keep], pa.list_(pa.int32())), pa.array([found[i][1] for i in keep], pa.list_(pa.float64())), *(part.column(c).take(pa.array(keep, pa.int64())) for c in (1, 2))], ["words", "shape", "good", "toxic"])

    # the sample is bounded by train_rows, so its side may be broadcast; one text of each id keeps it bounded
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    joined = texts.groupBy("id", "good", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select("one.text", "good", "toxic")
    rows = joined.select("text", "good", "toxic").mapInArrow(run, "words array<int>, shape array<double>, good int, toxic int").toArrow()
    words = rows["words"].combine_chunks()
    shape = np.array(rows["shape"].to_pylist()).reshape(-1, SHAPE)
    mean, spread = (shape.mean(0), shape.std(0) + 1e-3) if len(shape) else (np.zeros(SHAPE), np.ones(SHAPE))
    unit = np.append((shape - mean) / spread, np.ones((len(shape), 1)), axis=1)
    at = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    columns = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    heads = {}
    for name, y in (("low", 1 - rows["good"].to_numpy().astype(float)), ("toxic", rows["toxic"].to_numpy().astype(float))):
        both = len(y) and 0 < y.sum() < len(y)
        heads[name] = head(at, columns, unit, y) if both else None
    return {"heads": heads, "mean": mean, "spread": spread}


def evidence(model: dict, text: str) -> tuple[float | None, float | None]:
    """Log odds of low quality and of toxicity; None where a head abstains."""
    own, shape = features(text)
    unit = np.append((np.array(shape) - model["mean"]) / model["spread"], 1.0)
    return tuple(None if h is None else float(h[0][own].sum(dtype=np.float64) + unit @ h[1]) for h in (model["heads"]["low"], model["heads"]["toxic"]))


def scored(docs: DataFrame, model: dict, text_col: str) -> DataFrame:
    """docs with z_low, z_toxic (log odds) and blank (no words) in place of the text; only the text crosses to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats a head
    names = ["z_low", "z_toxic", "blank"]

    @F.arrow_udf("z_low double, z_toxic double, blank boolean")
    def odds(texts: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), 0):
            out += [evidence(shared.value, t) if t.split() else None for t in texts_of(part, 0)]
        return pa.StructArray.from_arrays([*(pa.array([o and o[k] for o in out], pa.float64()) for k in range(2)), pa.array([o is None for o in out], pa.bool_())], names)

    kept = [c for c in docs.columns if c != text_col]
    found = docs.select(*kept, odds.asNondeterministic()(F.col(text_col)).alias("found"))
    return found.select(*kept, *(F.col(f"found.{n}") for n in names))


def between(n_groups: float, total: float, squares: float, spread: float, mean: float) -> float:
    """Prior strength of one level: total rows, sum of n squared, sum of n (m - parent)^2."""
    noise = mean * (1 - mean)
    scale = total - squares / total if total else 0
    variance = (spread - max(n_groups - 1, 0) * noise) / scale if scale > 0 else 0
    return min(max(noise / variance - 1, 1.0), 1e6) if variance > 1e-12 and noise > 0 else 1e6


def site_posteriors(rows: DataFrame) -> tuple[DataFrame, float, float, float]:
    """rows (host, path, p) -> (host, path, n, p_sum, host_n, host_sum, host_posterior), the global mean, the
    strengths of hosts and of paths."""
    paths = written(rows.sparkSession, rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("p_sum")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("p_sum").alias("host_sum"))
    total = hosts.agg(F.sum("host_n"), F.sum("host_sum")).first()
    n, mean = float(total[0] or 0), (total[1] or 0.0) / (total[0] or 1)
    m = F.col("host_sum") / F.col("host_n")
    of_hosts = hosts.agg(F.count("*"), F.sum(F.col("host_n").cast("double") ** 2), F.sum(F.col("host_n") * (m - mean) ** 2)).first()
    strength = between(of_hosts[0], n, of_hosts[1] or 0, of_hosts[2] or 0, mean)
    posteriors = hosts.select("host", "host_n", "host_sum", ((strength * mean + F.col("host_sum")) / (strength + F.col("host_n"))).alias("host_posterior"))
    sites = paths.join(posteriors, "host")
    of_paths = sites.agg(F.count("*"), F.sum(F.col("n").cast("double") ** 2), F.sum(F.col("n") * (F.col("p_sum") / F.col("n") - F.col("host_posterior")) ** 2)).first()
    return sites, mean, strength, between(of_paths[0], n, of_paths[1] or 0, of_paths[2] or 0, mean)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", carry: list[str] | None = None, model: dict | None = None) -> DataFrame:
    """The carried columns (the id if None) with doc_score, host_posterior, path_posterior, score, toxic_score, kept.

    Scores are probabilities of good quality, toxic_score of toxicity; kept: score >= 0.5 > toxic_score.
    """
    spark = docs.sparkSession
    carry = [id_col] if carry is None else carry
    if clash := {"doc_score", "host_posterior", "path_posterior", "score", "toxic_score", "kept"}.intersection(carry):
        raise ValueError(f"{sorted(clash)} are names of the result: rename what is to be carried")
    model = model or train(docs, labels, id_col, text_col)
    names = [f"k{i}" for i in range(len(carry))]
    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = docs.select(*(F.col(c).alias(n) for n, c in zip(names, carry, strict=True)), site(host_col).alias("host"), site(path_col).alias("path"), F.col(text_col).cast("string").alias("text"))
    rows = written(spark, scored(source, model, "text"), "scored")
    own = 1 / (1 + F.exp(F.least(F.greatest(F.col("z_low"), F.lit(-30.0)), F.lit(30.0))))
    rows = rows.withColumn("p", F.when(F.col("blank"), 0.0).otherwise(F.coalesce(own, F.lit(1.0))))
    sites, mean, of_hosts, of_paths = site_posteriors(rows)
    joined = looked_up(rows, written(spark, sites.drop("host_posterior"), "posteriors"), ["host", "path"], "inner")
    clip = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = lambda x: F.log(clip(x) / (1 - clip(x)))
    # both levels without the document itself
    host_posterior = (of_hosts * mean + F.col("host_sum") - F.col("p")) / (of_hosts + F.col("host_n") - 1)
    path_posterior = (of_paths * F.col("host_posterior") + F.col("p_sum") - F.col("p")) / (of_paths + F.col("n") - 1)
    z = odds(F.col("p")) + odds(F.col("path_posterior")) - odds(F.lit(float(mean)))
    toxic = F.coalesce(1 / (1 + F.exp(-F.least(F.greatest(F.col("z_toxic"), F.lit(-30.0)), F.lit(30.0)))), F.lit(0.0))
    out = joined.withColumn("host_posterior", host_posterior).withColumn("path_posterior", path_posterior)
    out = out.withColumn("score", F.when(F.col("blank"), 0.0).when(F.col("z_low").isNull(), 1.0).otherwise(1 / (1 + F.exp(-z)))).withColumn("toxic_score", toxic)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, carry, strict=True)), F.col("p").alias("doc_score"), "host_posterior", "path_posterior", "score", "toxic_score", ((F.col("score") >= 0.5) & (F.col("toxic_score") < 0.5)).alias("kept"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

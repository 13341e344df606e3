"""Stance scoring and embeddings.

The scorer contract is "text -> logits array<double>". Decoding (softmax,
argmax -> stance via ``class_order``, {neg, neu, pos}) is native Spark
(functions/decode.py). Scorers:

* ``batch_logits_udf``: any batched numpy model (an ONNX session, say), in
  Arrow batches of ``batch_size`` rows, the model loaded once per Python worker;
  ``hashed_scorer`` is one with fixed weights;
* a pyspark.ml Pipeline (RegexTokenizer -> HashingTF -> 3-class
  LogisticRegression) trained on labelled posts — JVM-only, distributed; train it
  once, ``save_model`` it, and load it where posts are scored.

The default embedder averages hashed word vectors over the whole text: nothing is
trained, no vocabulary is held anywhere, and a text has the same vector at any scale.

Write-back never updates in place: scores are a dataset joined to posts on id
(stance moves NULL -> value exactly once, so the join is the current view).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodlake.functions.decode import argmax_stance, probs_struct, softmax
from moodlake.functions.dictionaries import BATCH_SIZE, CLASS_ORDER, MODEL_VER
from moodlake.functions.timefns import as_of_col


def decode_logits(df: DataFrame, logits_col: str = "logits", class_order=CLASS_ORDER) -> DataFrame:
    """Add probs {neg, neu, pos} and stance from a logits column."""
    p = softmax(logits_col)
    return (df.withColumn("__p", p)
            .withColumn("probs", probs_struct("__p", class_order))
            .withColumn("stance", argmax_stance("__p", class_order))
            .drop("__p"))


def three_class_label(labels: DataFrame) -> DataFrame:
    """Training label from (quality, toxic): toxic -> 0 (negative),
    quality without toxicity -> 2 (positive), otherwise 1 (neutral)."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0.0)
                         .when(F.col("quality") == 1, 2.0).otherwise(1.0).alias("label"))


def train_default_scorer(texts: DataFrame, text_col: str = "text", label_col: str = "label",
                         num_features: int = 1 << 16, max_iter: int = 20, reg: float = 0.01):
    """Fit the default 3-class text scorer (distributed training)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern=r"(?U)\W+", minTokenLength=1),
        HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features),
        LogisticRegression(featuresCol="__tf", labelCol=label_col, family="multinomial",
                           maxIter=max_iter, regParam=reg, rawPredictionCol="__raw",
                           probabilityCol="__prob", predictionCol="__pred"),
    ]).fit(texts)


def score_with_model(model, posts: DataFrame, text_col: str = "text", class_order=CLASS_ORDER,
                     model_ver: str = MODEL_VER) -> DataFrame:
    """Apply a fitted pipeline: rawPrediction are the logits, then native decode."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(posts).withColumn("logits", vector_to_array("__raw"))
    scored = scored.drop("__tok", "__tf", "__raw", "__prob", "__pred")
    return decode_logits(scored, "logits", class_order).withColumn("model_ver", F.lit(model_ver))


def batch_logits_udf(make_predict_fn, n_classes: int = 3, batch_size: int = BATCH_SIZE):
    """Wrap an external batched model: ``make_predict_fn()`` returns
    ``predict(texts: np.ndarray[str]) -> np.ndarray[float, (n, n_classes)]``; it
    is called once per Python worker and fed batches of ``batch_size``. The logits go back by the Arrow batch that the
    texts came in, so a small ``batch_size`` costs calls of the model and no more."""
    import uuid

    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    model = uuid.uuid4()    # of this call: a worker keeps the model for it from task to task

    def logits(batches):
        import numpy as np
        from pyspark.ml.model_cache import ModelCache

        predict = ModelCache.get(model)
        if not predict:
            predict = make_predict_fn()
            ModelCache.add(model, predict)
        for texts in batches:
            own, out = texts.to_numpy(), []
            for lo in range(0, len(own), batch_size):
                some = own[lo:lo + batch_size]
                got = predict(some)
                if not isinstance(got, np.ndarray) or got.ndim != 2 or len(got) != len(some):
                    raise ValueError("a model returns a two-dimensional array, a row per text")
                out += list(got)
            yield pd.Series(out, dtype=object)

    from collections.abc import Iterator
    logits.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(logits, "array<double>")


class HashedWords:
    """Vectors of words (runs of characters other than ASCII spaces, in lower case): component d of a word is byte d % 16
    of md5(word + "#" + d // 16), scaled to -0.5..0.5. Words that were met stay known, up to ``most`` of them."""

    def __init__(self, dims: int, most: int = 500_000):
        import numpy as np

        self.dims, self.most, self.rows = dims, most, {}
        self.raw, self.table = np.zeros((1024, dims), np.uint8), np.zeros((1024, dims))     # the bytes, and scaled

    def numbers(self, words: list[bytes]):
        """The words' row numbers in ``table``."""
        import hashlib

        import numpy as np

        if len(self.rows) > self.most:
            self.rows.clear()
        rows = self.rows
        new = [w for w in set(words) if w not in rows]      # a look at the batch's words, not at all that are known
        if new:
            k, n, parts = len(rows), len(rows) + len(new), -(-self.dims // 16)
            while n > len(self.raw):
                self.raw, self.table = (np.concatenate((t, np.zeros_like(t))) for t in (self.raw, self.table))
            hashes = b"".join([hashlib.md5(w + b"#%d" % i).digest() for w in new for i in range(parts)])
            self.raw[k:n] = np.frombuffer(hashes, np.uint8).reshape(len(new), parts * 16)[:, :self.dims]
            self.table[k:n] = self.raw[k:n] / 255.0 - 0.5
            rows.update(zip(new, range(k, n)))
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))


_HASHED: dict[int, HashedWords] = {}
#: Numbers that are gathered at once.
_GATHER = 1 << 22


def hashed_mean(texts, dims: int):
    """Mean of the words' hashed vectors for each text (numpy, n x dims; zeros for a text without words). The words of many
    texts are summed at once; their vectors are kept from batch to batch. The sums are of whole numbers, so components that
    tie are equal, whatever the order of the words and the batches."""
    import numpy as np

    known, out = _HASHED.setdefault(dims, HashedWords(dims)), np.zeros((len(texts), dims))
    words, counts, first = [], [], 0

    def flush(behind: int) -> None:
        n = np.array(counts, np.int64)
        some = np.flatnonzero(n)
        if len(some):
            numbers, ends = known.numbers(words), np.cumsum(n[some])
            step = max(1, _GATHER // dims)
            sums = np.zeros((len(some), dims), np.int64)
            for lo in range(0, len(numbers), step):     # a long text goes in several steps
                hi = min(lo + step, len(numbers))
                a, b = np.searchsorted(ends, [lo, hi - 1], side="right")
                starts = np.maximum(np.concatenate(([0], ends[:-1]))[a:b + 1], lo) - lo
                sums[a:b + 1] += np.add.reduceat(known.raw[numbers[lo:hi]], starts, axis=0, dtype=np.int64)
            out[first + some] = sums / (255.0 * n[some])[:, None] - 0.5
        words.clear()
        counts.clear()

    for i, text in enumerate(texts):
        own = text.lower().encode().split() if isinstance(text, str) else []      # bytes are split at ASCII spaces
        words += own
        counts.append(len(own))
        if len(words) > _GATHER // 4:
            flush(i + 1)
            first = i + 1
    flush(len(texts))
    return out


def hashed_scorer(scale: float = 40.0, n_classes: int = 3):
    """A ``make_predict_fn`` for ``batch_logits_udf`` with fixed weights: scaled hashed means, the contract an
    external batched model meets."""
    def make():
        return lambda texts: hashed_mean(texts, n_classes) * scale
    return make


def batch_embed_udf(make_encode_fn, batch_size: int = BATCH_SIZE, element: str = "float"):
    """Wrap an external encoder: ``make_encode_fn()`` (called once per Python worker) returns ``encode(texts) -> (states,
    mask)``, the states of every token (n x t x d, special tokens included) and which tokens are no padding (n x t). Texts
    are encoded in batches of ``batch_size`` of similar length, so little is padded, and pooled under the mask: a text's
    vector is the mean of its own tokens, whatever it was batched with. A null text is encoded as empty."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def embed(batches):
        import numpy as np

        encode = make_encode_fn()
        for texts in batches:
            own = [t if isinstance(t, str) else "" for t in texts.tolist()]
            order, out = sorted(range(len(own)), key=lambda i: len(own[i])), [None] * len(own)
            for lo in range(0, len(order), batch_size):
                some = order[lo:lo + batch_size]
                states, mask = encode([own[i] for i in some])
                for i, v in zip(some, masked_mean(states, mask)):
                    out[i] = v.astype({"float": np.float32}.get(element, np.float64))
            yield pd.Series(out)

    from collections.abc import Iterator
    embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(embed, f"array<{element}>")


def masked_mean(states, mask):
    """Mean of each text's token states where the mask is set (n x t x d and n x t -> n x d; zeros without any)."""
    import numpy as np

    mask = np.asarray(mask, np.float64)
    return np.einsum("ntd,nt->nd", np.asarray(states, np.float64), mask) / np.maximum(mask.sum(1), 1)[:, None]


def hashed_encoder(dims: int, special: tuple[str, ...] = ("[cls]", "[sep]")):
    """A ``make_encode_fn`` with fixed token vectors: a text's words between two special tokens."""
    def make():
        import numpy as np

        known = HashedWords(dims)
        first, last = (w.encode() for w in special)

        def encode(texts):
            tokens = [[first, *t.lower().encode().split(), last] for t in texts]
            n, width = len(tokens), max(map(len, tokens), default=0)
            mask = np.arange(width) < np.array([len(x) for x in tokens]).reshape(n, 1)
            states = np.full((n, width, dims), np.nan)          # what stands on padding must not matter
            states[mask] = known.numbers([w for x in tokens for w in x])[:, None]
            states[mask] = known.table[states[mask][:, 0].astype(np.int64)]
            return np.nan_to_num(states, nan=1e3), mask
        return encode
    return make


def score_with_udf(posts: DataFrame, logits_udf, text_col: str = "text", class_order=CLASS_ORDER,
                   model_ver: str = MODEL_VER) -> DataFrame:
    """Score with a batched model: its logits, then the native decode. A NULL text is scored as empty."""
    scored = posts.withColumn("logits", logits_udf(F.coalesce(text_col, F.lit(""))))
    return decode_logits(scored, "logits", class_order).withColumn("model_ver", F.lit(model_ver))


def embed_hashed(posts: DataFrame, vector_size: int = 384, text_col: str = "text", out: str = "embedding",
                 element: str = "float") -> DataFrame:
    """Adds the hashed mean vector of each whole text (array of ``element``, float or double); zeros for a text
    without words."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def embed(texts):
        return pd.Series(list(hashed_mean(texts.tolist(), vector_size).astype({"float": "float32"}.get(element, element))))

    embed.__annotations__ = {"texts": pd.Series, "return": pd.Series}  # real types, not postponed strings
    return posts.withColumn(out, pandas_udf(embed, f"array<{element}>")(F.coalesce(text_col, F.lit(""))))


def save_model(model, path: str) -> None:
    """Store a trained pipeline (shared folder), to be loaded where posts are scored."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def _ensure(df: DataFrame, name: str, dtype) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(dtype))


def stance_writeback(posts: DataFrame, scores: DataFrame, as_of=None) -> DataFrame:
    """Current posts view after a scoring pass: scores (id, stance, probs,
    model_ver) fill only posts that are still unscored; classified_at is stamped.

    Stance moves NULL -> value once, so already-scored posts pass straight
    through (a plain scan, no shuffle); only the unscored rows — bounded by the
    scoring horizon — are joined to the scores."""
    s = scores.select(F.col("id"), F.col("stance").alias("__st"), F.col("probs").alias("__pr"),
                      F.col("model_ver").alias("__mv"))
    base = posts
    for name, dtype in (("classified_at", "timestamp_ntz"), ("model_ver", "string"),
                        ("probs", s.schema["__pr"].dataType)):
        base = _ensure(base, name, dtype)
    cols = base.columns
    done = base.where(F.col("stance").isNotNull())
    todo = base.where(F.col("stance").isNull()).join(s, "id", "left")
    hit = F.col("__st").isNotNull()
    filled = (todo.withColumn("stance", F.col("__st").cast("short"))
              .withColumn("classified_at", F.when(hit, as_of_col(as_of).cast("timestamp_ntz"))
                          .otherwise(F.col("classified_at")))
              .withColumn("model_ver", F.when(hit, F.col("__mv")).otherwise(F.col("model_ver")))
              .withColumn("probs", F.when(hit, F.col("__pr")).otherwise(F.col("probs")))
              .select(*cols))
    return done.withColumn("stance", F.col("stance").cast("short")).select(*cols).unionByName(filled)


def fanout_writeback(ticker_posts: DataFrame, scores: DataFrame) -> DataFrame:
    """Stance of fan-out rows from the scores of their post (unscored rows only)."""
    s = scores.select(F.col("id").alias("post_id"), F.col("stance").alias("__st"))
    done = ticker_posts.where(F.col("stance").isNotNull())
    todo = (ticker_posts.where(F.col("stance").isNull()).join(s, "post_id", "left")
            .withColumn("stance", F.col("__st").cast("short")).drop("__st"))
    return done.unionByName(todo.select(*ticker_posts.columns))


def train_embedder(texts: DataFrame, text_col: str = "text", vector_size: int = 384,
                   min_count: int = 1, seed: int = 11, max_iter: int = 1, num_partitions: int | None = None):
    """Trained text encoder: Word2Vec; its transform is the mean of the word
    vectors of the text (mean pooling over all tokens of the whole text).

    Word2Vec holds its whole vocabulary on the driver and in every task, so it is for vocabularies known to fit there;
    ``embed_hashed`` has no such bound. ``min_count`` is never raised to make one fit."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import RegexTokenizer, Word2Vec

    tok = RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern=r"(?U)\W+", minTokenLength=1)
    parts = num_partitions or max(1, texts.rdd.getNumPartitions())
    return Pipeline(stages=[
        tok,
        Word2Vec(inputCol="__tok", outputCol="__vec", vectorSize=vector_size, minCount=min_count,
                 seed=seed, maxIter=max_iter, numPartitions=parts),
    ]).fit(texts)


def embed_with_model(model, posts: DataFrame, out: str = "embedding") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return (model.transform(posts).withColumn(out, vector_to_array("__vec", "float32"))
            .drop("__tok", "__vec"))

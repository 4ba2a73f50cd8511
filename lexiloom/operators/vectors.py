"""Dense retrieval: bags of token vectors, cosine top-k, rank fusion, and a dual encoder trained on pairs."""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexical import draw, draw_sql, prose_words
from ..sources.store import settled

SPACES = "[\\x09-\\x0D ]+"

#: A task holds queries of at most so many numbers; more go in several blocks.
QUERY_NUMBERS = 16_000_000
#: Training goes over so many rows of a matrix at a time, which stay in the processor's cache.
CACHED = 256
#: Words that more texts of a batch hold are a dense matrix in training; the others are gone through text by text.
FEW = 8


def unit(vector: Column) -> Column:
    """The vector divided by its length; the zero vector stays."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(size > 0, F.transform(vector, lambda x: x / size)).otherwise(vector)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def top_k(queries: DataFrame, corpus: DataFrame, k: int, query_numbers: int = QUERY_NUMBERS) -> DataFrame:
    """(query_id, id, score, rk): the ``k`` nearest by cosine of each query (query_id, vector) in the corpus (id, vector).

    Queries of at most ``query_numbers`` numbers together are sent to all tasks, and the
    corpus is scanned where it lies. More go in blocks, each to meet each chunk of the
    corpus in a task of its own; nothing goes through the driver then. Either way a task
    multiplies matrices and sends on its best ``k`` a query. Zero vectors and null vectors
    score nothing. Equal scores (to 9 places) in the order of ids.
    """
    asked, found_in = (d.where("vector is not null").select(F.col(i).cast("long").alias(i), F.col("vector").cast("array<double>").alias("vector")) for d, i in ((queries, "query_id"), (corpus, "id")))
    shape = lambda d: d.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    q = shape(asked)
    blocks = -(-q["n"] * (q["dim"] or 1) // query_numbers)
    schema = "query_id long, id long, score double"
    if blocks <= 1:
        rows = asked.collect()  # at most query_numbers numbers
        sent = corpus.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in rows], np.int64), np.array([r["vector"] for r in rows], np.float64)))

        def scan(batches):
            ids, vectors = sent.value
            best = _Best(ids, vectors, k)
            for b in batches:
                best.add(b["id"].to_numpy(), b["vector"])
            yield best.rows()

        found = found_in.mapInPandas(scan, schema)
    else:
        chunks = max(1, -(-shape(found_in)["n"] * (q["dim"] or 1) // query_numbers))
        part = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
        left = asked.withColumn("block", part("query_id", blocks)).withColumn("chunk", every(chunks))
        right = found_in.withColumn("chunk", part("id", chunks)).withColumn("block", every(blocks))

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            best = _Best(a["query_id"].to_numpy(), np.array(a["vector"].tolist(), np.float64), k)
            best.add(b["id"].to_numpy(), b["vector"])
            return best.rows()

        found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(meet, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


class _Best:
    """The best ``k`` of all that is added, for each query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        norms = np.linalg.norm(vectors, axis=1) if len(ids) else np.zeros(0)
        self.ids, self.k = ids[norms > 0], k
        self.vectors = vectors[norms > 0] / norms[norms > 0, None]
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, vectors: pd.Series, step: int = 4_096) -> None:
        for a in range(0, len(ids) if len(self.ids) else 0, step):
            v = np.array(vectors.iloc[a : a + step].tolist(), np.float64)
            size = np.linalg.norm(v, axis=1)
            own = ids[a : a + step][size > 0]
            scores = self.vectors @ (v[size > 0] / size[size > 0, None]).T
            rounded = np.round(scores, 9)
            if scores.shape[1] > self.k:  # of a query, nothing below its k-th best of this step can stay
                row, column = np.nonzero(rounded >= -np.partition(-rounded, self.k - 1, axis=1)[:, self.k - 1 : self.k])
            else:
                row, column = np.indices(scores.shape).reshape(2, -1)
            row, who, score = np.append(self.row, row), np.append(self.id, own[column]), np.append(self.score, scores[row, column])
            order = np.lexsort((who, -np.round(score, 9), row))
            row, who, score = row[order], who[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            self.row, self.id, self.score = (x[place < self.k] for x in (row, who, score))

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.ids[self.row], "id": self.id, "score": self.score})


def fuse(rankings: list[DataFrame], k: float = 60.0) -> DataFrame:
    """(query_id, id, score): reciprocal rank fusion of rankings (query_id, id, rk), rk from 1."""
    every = rankings[0].select("query_id", "id", "rk")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", "id", "rk"))
    return every.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rk"))).alias("score"))


def bag_weights(bags: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, token, weight) of token rows (id, token): (1 + ln count) * idf, each id's weights of length 1; unknown tokens go."""
    counts = bags.groupBy("id", "token").agg(F.count("*").alias("n")).join(idf.select("token", "idf"), "token")
    w = counts.withColumn("w", (1 + F.log("n")) * F.col("idf"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return w.select("id", "token", F.when(size > 0, F.col("w") / size).otherwise(F.col("w")).alias("weight"))


def encode(weights: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, vector): the weighted sum of token vectors (token, vector), of length 1."""
    long = weights.join(vectors, "token").select("id", "weight", F.posexplode("vector").alias("i", "x"))
    sums = long.groupBy("id", "i").agg(F.sum(F.col("weight") * F.col("x")).alias("s"))
    return sums.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda v: v["s"]).alias("v")).select("id", unit(F.col("v")).alias("vector"))


def document_tokens(rows: DataFrame, key: str = "decl_id") -> DataFrame:
    """(id, token): a declaration's name words and, marked as such, its module words."""
    return rows.select(F.col(key).alias("id"), F.explode(F.concat("tokens", F.transform("mod_tokens", lambda t: F.concat(F.lit("mod:"), t)))).alias("token"))


def query_tokens(queries: DataFrame, title_repeats: int = 2) -> DataFrame:
    title = prose_words(F.coalesce("title", F.lit("")))
    return queries.select(F.col("query_id").alias("id"), F.explode(F.concat(prose_words(F.coalesce("text", F.lit(""))), *[title] * title_repeats)).alias("token"))


def vocabulary(bags: DataFrame, least: int = 1) -> DataFrame:
    """(token, df, idf, idx): tokens of at least ``least`` ids, numbered by falling frequency."""
    n = bags.agg(F.count_distinct("id").alias("n"))
    df = bags.distinct().groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= least).crossJoin(F.broadcast(n))
    return df.select("token", "df", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"), (F.row_number().over(Window.orderBy(F.desc("df"), "token")) - 1).alias("idx"))


def frequencies(pairs: DataFrame, least: int = 3) -> tuple[int, dict[str, int], dict[str, int]]:
    """The number of pairs (id, words, tokens), and how many of them hold each word (those of at least ``least``) and each token."""
    held = lambda side: pairs.select(F.explode(F.array_distinct(side)).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    words, tokens = (dict(zip(*(c.to_pylist() for c in side.toArrow().columns), strict=True)) for side in (held("words").where(F.col("n") >= least), held("tokens")))
    return pairs.count(), words, tokens


@dataclass
class DualEncoder:
    """Token vectors of both sides, with their inverse frequencies."""

    words: dict[str, int]
    tokens: dict[str, int]
    a: np.ndarray
    b: np.ndarray
    word_idf: np.ndarray
    token_idf: np.ndarray

    def _table(self, spark: SparkSession, vocab: dict[str, int], idf: np.ndarray, m: np.ndarray) -> DataFrame:
        return spark.createDataFrame([(t, i, float(idf[i]), m[i].astype(float).tolist()) for t, i in vocab.items()], "token string, idx long, idf double, vector array<double>")

    def query_table(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, self.words, self.word_idf, self.a)

    def document_table(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, self.tokens, self.token_idf, self.b)

    def save(self, spark: SparkSession, path: str) -> None:
        sides = self.query_table(spark).select(F.lit("query").alias("side"), "*").union(self.document_table(spark).select(F.lit("document").alias("side"), "*"))
        sides.write.mode("overwrite").partitionBy("side").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> DualEncoder:
        parts = []
        for side in ("query", "document"):
            rows = spark.read.parquet(path).where(F.col("side") == side).orderBy("idx").collect()
            parts.append(({r["token"]: r["idx"] for r in rows}, np.array([r["vector"] for r in rows], np.float32), np.array([r["idf"] for r in rows], np.float32)))
        (w, a, wi), (t, b, ti) = parts
        return DualEncoder(w, t, a, b, wi, ti)


def _blocks(n: int) -> list[slice]:
    return [slice(i, min(i + CACHED, n)) for i in range(0, n, CACHED)]


class _Adam:
    """Adam over the rows of a matrix; a row's steps without a gradient are taken together when it is next needed.

    In such steps the means only decay, so what they move a row by is its last mean over its
    root, times a sum of the step numbers alone. That quotient and the roots are kept, in
    files of this process.
    """

    def __init__(self, x: np.ndarray, rate: float, steps: int):
        self.x, self.rate, self.t, self.last = x, rate, 0, np.zeros(len(x), np.int64)
        self.p, self.root = _filed(x.shape), _filed(x.shape)
        s = np.arange(1.0, steps + 500)
        bias, self.decay = np.sqrt(1 - 0.999**s) / (1 - 0.9**s), 0.9 / np.sqrt(0.999)
        self.ahead = np.zeros(len(s) + 1)  # at L: the sum over s > L of decay ** (s - L) * bias
        for k in range(len(s) - 1, -1, -1):
            self.ahead[k] = self.decay * (bias[k] + self.ahead[k + 1])

    def rows(self, u: np.ndarray) -> np.ndarray:
        """Rows ``u`` as they are after all steps so far."""
        last, self.held, out = self.last[u], *(np.empty((len(u), self.x.shape[1]), np.float32) for _ in range(2))
        moved = (self.rate * (self.ahead[last] - self.decay ** (self.t - last) * self.ahead[self.t])).astype(np.float32)[:, None]
        for k in _blocks(len(u)):
            self.p.take(u[k], 0, self.held[k], "clip")
            self.x.take(u[k], 0, out[k], "clip")
            out[k] -= self.held[k] * moved[k]
        return out

    def step(self, u: np.ndarray, x: np.ndarray, g: np.ndarray) -> None:
        """The next step of rows ``u``, with gradients ``g``; ``x`` is what :meth:`rows` has just given of them."""
        tiny = lambda t: 1e-8 * np.sqrt((1 - 0.999 ** (t + 1.0)) / 0.999)
        last = self.last[u]
        past = (self.t - last).astype(np.float64)
        self.t += 1
        fade, dim, old = (d.astype(np.float32)[:, None] for d in (0.9 ** (past + 1), 0.999 ** (past + 1), tiny(last)))
        scale = (1 - 0.9**self.t) / self.rate
        slope, least, new = np.float32(scale / np.sqrt(1 - 0.999**self.t)), np.float32(1e-8 * scale), np.float32(tiny(self.t))
        for k in _blocks(len(u)):
            m, v, h = self.held[k], self.root.take(u[k], 0), g[k] * np.float32(0.1)
            m *= v + old[k]
            m *= fade[k]
            m += h
            h *= h
            h *= np.float32(0.1)  # 0.001 g^2
            v *= v
            v *= dim[k]
            v += h
            np.sqrt(v, out=v)
            self.root[u[k]] = v
            np.multiply(v, slope, out=h)
            h += least
            np.divide(m, h, out=h)
            self.x[u[k]] = np.subtract(x[k], h, out=h)
            v += new
            m /= v
            self.p[u[k]] = m
        self.last[u] = self.t

    def settle(self, step: int = 65_536) -> None:
        """All rows as they are after all steps."""
        for i in range(0, len(self.x), step):
            u = np.arange(i, min(i + step, len(self.x)))
            self.x[u] = self.rows(u)


def _filed(shape: tuple[int, ...], kind: type = np.float32) -> np.ndarray:
    """Zeros, in a file without a name in the folder for temporary files, so that they needn't all be in memory."""
    if 0 in shape:
        return np.zeros(shape, kind)
    with tempfile.TemporaryFile() as f:
        return np.asarray(np.memmap(f, kind, "w+", shape=shape))


def _drawn(rng: np.random.Generator, shape: tuple[int, int], step: int = 65_536) -> np.ndarray:
    out = _filed(shape)
    for i in range(0, shape[0], step):
        out[i : i + step] = 0.05 * rng.standard_normal(out[i : i + step].shape)
    return out


class _Numbered:
    """Texts as the numbers of their known words, one after the other."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.codes, self.sizes, self.start = codes, sizes, np.cumsum(sizes) - sizes

    @staticmethod
    def of(texts: list[list[str]], vocab: dict[str, int]) -> _Numbered:
        known = [[vocab[t] for t in words if t in vocab] for words in texts]
        return _Numbered(np.array([i for x in known for i in x], np.int32), np.array([len(x) for x in known], np.int64))

    def bags(self, chosen: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and weights of the sparse matrix of unit bags, by row and column."""
        n = self.sizes[chosen]
        at = np.repeat(self.start[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key, count = np.unique(np.repeat(np.arange(len(chosen)), n) * len(idf) + self.codes[at], return_counts=True)
        r, c = np.divmod(key, len(idf))
        w = (1 + np.log(count)) * idf[c]
        size = np.sqrt(np.bincount(r, w * w, len(chosen)))
        return r, c, (w / np.where(size > 0, size, 1.0)[r]).astype(np.float32)


class _Bags:
    """The unit bags of a batch as a sparse matrix, times the rows of its words, and its transpose times rows of texts.

    ``u`` are the words: those of over ``FEW`` texts, those of fewer, then those of one text, text by text.
    """

    def __init__(self, r: np.ndarray, c: np.ndarray, w: np.ndarray, size: int):
        by_word = np.argsort(c)
        first = np.flatnonzero(np.diff(c[by_word], prepend=-1))
        count = np.diff(first, append=len(c))
        held = np.empty(len(c), np.int64)
        held[by_word] = np.repeat(count, count)
        order = np.argsort(-np.minimum(count, FEW + 1), kind="stable")
        self.dense, self.many = int((count > FEW).sum()), int((count > 1).sum())
        place = np.empty(len(first), np.int64)
        place[order] = np.arange(len(first))
        at = np.empty(len(c), np.int64)
        at[by_word] = np.repeat(place, count)
        one, few, much = held == 1, (held > 1) & (held <= FEW), held > FEW
        self.u = np.append(c[by_word[first[order[: self.many]]]], c[one])
        self.x = np.zeros((size, self.dense), np.float32)
        self.x[r[much], at[much]] = w[much]
        ends = lambda rows: np.append(0, np.cumsum(np.bincount(rows, minlength=size))).tolist()
        self.few, self.few_ends = (at[few], w[few]), ends(r[few])
        self.one, self.one_ends = (r[one], w[one]), ends(r[one])
        self.columns, a = [], self.dense  # by how many texts hold them: the place of the first such word, the texts and weights of each
        for n in range(FEW, 1, -1):
            own = by_word[first[count == n][:, None] + np.arange(n)]
            self.columns.append((a, r[own], w[own]))
            a += len(own)

    def times(self, rows: np.ndarray) -> np.ndarray:
        sums = self.x @ rows[: self.dense]
        (at, w), (_, v), ones = self.few, self.one, rows[self.many :]
        for i in range(len(sums)):
            a, b = self.few_ends[i : i + 2]
            if b > a:
                sums[i] += w[a:b] @ rows.take(at[a:b], 0)
            a, b = self.one_ends[i : i + 2]
            if b > a:
                sums[i] += v[a:b] @ ones[a:b]
        return sums

    def back(self, inner: np.ndarray) -> np.ndarray:
        grad = np.empty((len(self.u), inner.shape[1]), np.float32)
        np.matmul(self.x.T, inner, out=grad[: self.dense])
        for start, r, w in [*self.columns, (self.many, self.one[0][:, None], self.one[1][:, None])]:
            for k in _blocks(len(r)):
                out = grad[start + k.start : start + k.stop]
                np.multiply(inner.take(r[k, 0], 0), w[k, :1], out=out)
                for n in range(1, r.shape[1]):
                    more = inner.take(r[k, n], 0)
                    more *= w[k, n : n + 1]
                    out += more
        return grad


def _pairs_of(pairs: DataFrame, words: dict[str, int], tokens: dict[str, int], bound: int | None = None) -> tuple[_Numbered, _Numbered]:
    """Both sides of all pairs, or of what :func:`training_pairs` gives for ``bound``, in its order; words become numbers where they lie, and come a file at a time."""
    keyed = pairs.withColumn("hash", F.xxhash64("id"))
    if bound is not None and pairs.count() > bound:
        keyed = keyed.where(F.col("hash") <= keyed.select("hash").orderBy("hash").limit(bound).agg(F.max("hash")).first()[0])
    sent = pairs.sparkSession.sparkContext.broadcast((pa.array(list(words), pa.string()), pa.array(list(tokens), pa.string())))

    def numbers(batches):
        for b in batches:
            columns = [b.column("hash"), b.column("id")]
            for side, vocab in zip(("words", "tokens"), sent.value, strict=True):
                place = pc.index_in(pc.list_flatten(b.column(side)), value_set=vocab)
                held = pc.list_parent_indices(b.column(side)).filter(place.is_valid())
                ends = np.append(0, np.cumsum(np.bincount(held.to_numpy(), minlength=b.num_rows))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(ends, place.drop_null()))
            made = pa.RecordBatch.from_arrays(columns, names=["hash", "id", "words", "tokens"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, made.schema) as out:
                out.write_batch(made)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])

    parts = settled(keyed.select("hash", "id", "words", "tokens").mapInArrow(numbers, "batch binary"))
    keys, sizes, files = [], ([], []), (tempfile.TemporaryFile(), tempfile.TemporaryFile())
    for row in parts.toLocalIterator():
        t = pa.ipc.open_stream(pa.py_buffer(bytes(row["batch"]))).read_all().combine_chunks()
        keys.append(t.select(["hash", "id"]))
        for k, side in enumerate(("words", "tokens")):
            sizes[k].append(pc.list_value_length(t.column(side)).to_numpy().astype(np.int64))
            files[k].write(pc.list_flatten(t.column(side)).to_numpy().astype(np.int32).tobytes())
    out = []
    order = pc.sort_indices(pa.concat_tables(keys), [("hash", "ascending"), ("id", "ascending")]).to_numpy()[:bound] if keys else np.zeros(0, np.int64)
    for f, n in zip(files, sizes, strict=True):
        f.flush()
        n = np.concatenate(n) if n else np.zeros(0, np.int64)
        side = _Numbered(np.memmap(f, np.int32, "r") if n.sum() else np.zeros(0, np.int32), n)
        side.sizes, side.start = side.sizes[order], side.start[order]
        out.append(side)
        f.close()
    return tuple(out)


def train(
    pairs: list[tuple[list[str], list[str]]] | DataFrame, library: list[list[str]] | None = None, dim: int = 128, epochs: int = 6, batch: int = 256,
    rate: float = 0.05, temperature: float = 0.05, seed: int = 0, least: int = 3, resume: DualEncoder | None = None, log: Callable[[str], None] | None = None,
    counted: tuple[int, dict[str, int], dict[str, int]] | None = None, bound: int | None = None,
) -> DualEncoder:
    """A dual encoder from pairs of query words and document tokens, each other pair of a batch being a negative.

    Stochastic gradients need one place: this runs on the driver. The loss is the
    cross-entropy of rows only; of an epoch's order, drawn anew each time, a last incomplete
    batch is left out. Vocabularies and inverse frequencies are those of ``counted``
    (:func:`frequencies`), else of ``pairs`` and ``library``. With ``counted``, ``pairs``
    may be a DataFrame: all of it is learnt from, as numbers in files of the driver, unless
    the caller sets a ``bound`` (then what :func:`training_pairs` gives for it).
    """
    if resume:
        words, tokens, wi, ti = resume.words, resume.tokens, resume.word_idf, resume.token_idf
    else:
        if counted:
            (n_q, q, d), n_d = counted, counted[0]
        else:
            n_q, n_d = len(pairs), len(library or pairs)
            q, d = Counter(w for x, _ in pairs for w in set(x)), Counter(t for x in (library or [d for _, d in pairs]) for t in set(x))
        words = {w: i for i, (w, _) in enumerate(sorted(((w, n) for w, n in q.items() if n >= least), key=lambda x: (-x[1], x[0])))}
        tokens = {t: i for i, t in enumerate(sorted(d))}
        wi = np.array([np.log(1 + max(1, n_q) / (1 + q[w])) for w in words], np.float32)
        ti = np.array([np.log(1 + max(1, n_d) / (1 + d[t])) for t in tokens], np.float32)
    sides = _pairs_of(pairs, words, tokens, bound) if isinstance(pairs, DataFrame) else (_Numbered.of([x for x, _ in pairs], words), _Numbered.of([y for _, y in pairs], tokens))
    usable = np.flatnonzero((sides[0].sizes > 0) & (sides[1].sizes > 0))
    rng = np.random.default_rng(seed)
    a = resume.a.copy() if resume else _drawn(rng, (len(words), dim))
    b = resume.b.copy() if resume else _drawn(rng, (len(tokens), dim))
    adam = [_Adam(x, rate, epochs * (len(usable) // batch)) for x in (a, b)]
    for epoch in range(epochs):
        order = rng.permutation(len(usable))
        right = seen = 0
        for s in range(0, len(usable) - batch + 1, batch):
            chosen = usable[order[s : s + batch]]
            bags, units, sizes = [], [], []
            for k, idf in enumerate((wi, ti)):
                bag = _Bags(*sides[k].bags(chosen, idf), batch)
                rows = adam[k].rows(bag.u)
                sums = bag.times(rows)
                size = np.linalg.norm(sums, axis=1, keepdims=True) + 1e-8
                bags.append((bag, rows)), units.append(sums / size), sizes.append(size)
            logits = units[0] @ units[1].T / temperature
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            right += int((p.argmax(1) == np.arange(batch)).sum())
            seen += batch
            g = (p - np.eye(batch, dtype=np.float32)) / np.float32(batch * temperature)
            for k, pull in enumerate((g @ units[1], g.T @ units[0])):
                inner = (pull - (pull * units[k]).sum(1, keepdims=True) * units[k]) / sizes[k]
                bag, rows = bags[k]
                adam[k].step(bag.u, rows, bag.back(inner))
        if log:
            log(f"epoch {epoch + 1}: in-batch top 1 {right / max(1, seen):.3f}")
    for x in adam:
        x.settle()
    return DualEncoder(words, tokens, a, b, wi, ti)


def training_pairs(pairs: DataFrame, bound: int = 200_000) -> list[tuple[list[str], list[str]]]:
    """At most ``bound`` pairs (id, words, tokens), those with the smallest hashed ids, on the driver."""
    rows = pairs.orderBy(F.xxhash64("id"), "id").limit(bound).select("words", "tokens").collect()
    return [(r["words"], r["tokens"]) for r in rows]


def shortened(text: Column, key: Column, keep: float = 0.5, cap: int = 16, seed: int = 0) -> Column:
    """Some of a text's words, each kept or not by its hash, three at least and ``cap`` at most; texts of up to four words stay."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    drawn = lambda i: draw(F.lit(seed), key, i) % 1_000_000
    kept = F.filter(words, lambda w, i: drawn(i) < int(keep * 1_000_000))
    placed = F.transform(words, lambda w, i: F.struct(drawn(i).alias("d"), i.alias("i"), w.alias("w")))
    three = F.transform(F.slice(F.array_sort(placed), 1, 3), lambda x: x["w"])
    return F.when(F.size(words) <= 4, text).otherwise(F.array_join(F.slice(F.when(F.size(kept) < 3, three).otherwise(kept), 1, cap), " "))


def shortened_sql(text: str, key: str, keep: float = 0.5, cap: int = 16, seed: int = 0) -> str:
    """DuckDB SQL for :func:`shortened`."""
    words = f"list_filter(regexp_split_to_array({text}, '{SPACES}'), lambda w: w <> '')"
    drawn = draw_sql(str(seed), key, "i - 1") + " % 1000000"
    kept = f"list_filter({words}, lambda w, i: {drawn} < {int(keep * 1_000_000)})"
    three = f"list_transform(list_sort(list_transform({words}, lambda w, i: {{'d': {drawn}, 'i': i, 'w': w}}))[1:3], lambda x: x.w)"
    return f"case when len({words}) <= 4 then {text} else array_to_string((case when len({kept}) < 3 then {three} else {kept} end)[1:{cap}], ' ') end"


def adapt(documented: DataFrame, pairs: DataFrame, excluded_prefix: str, dim: int = 192, epochs: tuple[int, int] = (10, 6), upsample: int = 25, copies: int = 2, bound: int = 200_000, seed: int = 0) -> DualEncoder:
    """An encoder trained on docstrings (id, doc, module, tokens) and then on a mixture with labelled pairs (id, text, tokens).

    The mixture is the pairs, ``upsample`` times, shortened docstrings and as many plain
    ones as pairs. Modules with ``excluded_prefix`` are never learnt from.
    """
    open_ = documented.where(~F.startswith("module", F.lit(excluded_prefix)) & (F.col("doc") != ""))
    plain = open_.select("id", prose_words(F.col("doc")).alias("words"), "tokens")
    labelled = training_pairs(pairs.select("id", prose_words(F.col("text")).alias("words"), "tokens"), bound)
    docs = training_pairs(plain, bound)
    first = train(docs, [d for _, d in docs + labelled], dim, epochs[0], min(384, max(1, len(docs))), 0.06, seed=seed)
    brief = [p for k in range(copies) for p in training_pairs(open_.select("id", prose_words(shortened(F.col("doc"), F.col("id"), seed=k)).alias("words"), "tokens"), bound)]
    mixture = labelled * upsample + brief + docs[: len(labelled) * upsample]
    return train(mixture, None, dim, epochs[1], min(256, max(1, len(mixture))), 0.012, seed=seed + 1, resume=first)

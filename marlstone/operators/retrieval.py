"""Ranked search in evidence: BM25, character TF-IDF, their fusion.

Questions are few and units are many, so questions go to the units: the weights
of a block of questions are sent to the tasks, each task scores the units of its
own batches, and only what can still be among a question's best leaves the task.
Statistics of the corpus (how many units have a term or a gram) are Spark
aggregates over all units, at every size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import SPACE, collapse, search_words
from ..storage import materialize, small
from .inventory import first_rows, in_scope

# Tokens that say nothing about a package; BM25's and the fusion's constants, lengths of character grams.
GENERAL_TOKENS = ["核心", "主题", "主要", "文件", "文档", "内容", "分析", "资料", "报告", "数据"]
K1, B = 1.5, 0.75
LEXICAL, VECTOR = 0.58, 0.42
GRAMS = (2, 3, 4)
#: Questions sent out at once; grams whose counts go to the tasks, beyond which they are joined.
BLOCK, SENT_GRAMS = 1000, 4_000_000
#: Scores are shown with six digits, so units closer than this may change places.
SLACK = 2e-6


class Weights:
    """Weights of a block of questions by key (a term or a gram), as rows of a sparse matrix."""

    def __init__(self, keys: list, questions: list[int], weights: list[float], width: int):
        order = np.argsort(np.array(keys, dtype=object if keys and isinstance(keys[0], str) else None), kind="stable") if keys else np.empty(0, int)
        self.width, self.question, self.weight = width, np.array(questions, np.int64)[order], np.array(weights, float)[order]
        self.of: dict = {}
        for i, k in enumerate([keys[j] for j in order]):
            first, _ = self.of.get(k, (i, i))
            self.of[k] = first, i + 1
        self.sorted = np.array(list(self.of), np.int64) if keys and not isinstance(keys[0], str) else np.empty(0, np.int64)
        self.span = np.array(list(self.of.values()), np.int64).reshape(-1, 2)

    def scores(self, spans: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sum of value x weight for each question, over the keys at these spans."""
        if not len(spans):
            return np.zeros(self.width)
        n = spans[:, 1] - spans[:, 0]
        at = np.repeat(spans[:, 0] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.question[at], self.weight[at] * np.repeat(values, n), self.width)

    def by_word(self, counts: dict[str, float]) -> np.ndarray:
        found = [(self.of[w], v) for w, v in counts.items() if w in self.of]
        return self.scores(np.array([s for s, _ in found], np.int64).reshape(-1, 2), np.array([v for _, v in found], float))

    def by_gram(self, grams: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.zeros(self.width)
        at = np.minimum(np.searchsorted(self.sorted, grams), len(self.sorted) - 1)
        hit = self.sorted[at] == grams
        return self.scores(self.span[at[hit]], values[hit])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def grams_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character grams of a text, sorted, and how often each occurs."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    for n in GRAMS:
        h = np.full(max(0, len(c) - n + 1), n, np.uint64)
        for k in range(n):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + c[k : k + len(h)])
        out.append(h)
    grams, counts = np.unique(np.concatenate(out).view(np.int64), return_counts=True)
    return grams, counts


def _plain(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, f"{SPACE}+", " "))


def _term_weights(units: DataFrame, queries: DataFrame) -> tuple[DataFrame, int, float]:
    """query_id, term, weight of BM25 (uses in the question x idf); number of units and their average length."""
    asked = materialize(queries.select("query_id", F.explode(search_words(collapse(F.col("query")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")), "query-terms")
    terms = small(asked.select("term").distinct())
    facts = units.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avg")).first()
    df = units.select(F.explode(F.array_distinct("tokens")).alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.lit(facts["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(df, "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight")), facts["n"], float(facts["avg"] or 1.0)


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, df: units of the task that have it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def folded() -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

    def out(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 200_000]), pa.array(n[i : i + 200_000])], names=["gram", "df"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            grams, _ = grams_of(text or "")
            held.append((grams, np.ones(len(grams), np.int64)))
            size += len(grams)
            if size > 4_000_000:
                held = [folded()]
                size = len(held[0][0])
                if size > 2_000_000:  # what a task holds stays bounded; the rest is added up after the shuffle
                    yield from out(*held[0])
                    held, size = [], 0
    if held:
        yield from out(*folded())


def _vectors(units: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """The units with ``grams`` and their TF-IDF weights ``tfs`` (of unit length). Counts are sent to the tasks while they are few, else joined."""
    names = [c for c in units.columns if c != "plain"]
    if counts.limit(SENT_GRAMS + 1).count() <= SENT_GRAMS:
        rows = counts.toArrow().sort_by("gram")  # SENT_GRAMS rows at most
        sent = units.sparkSession.sparkContext.broadcast((rows["gram"].to_numpy(), rows["df"].to_numpy()))

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, df = sent.value
            for batch in batches:
                grams, weights = [], []
                for text in batch.column(batch.schema.get_field_index("plain")).to_pylist():
                    g, tf = grams_of(text or "")
                    w = (1 + np.log(tf)) * (np.log((1 + total) / (1 + df[np.searchsorted(keys, g)])) + 1)
                    grams.append(g)
                    weights.append(w / (np.sqrt((w * w).sum()) or 1.0))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(grams, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.float64()))], names=[*names, "grams", "tfs"])

        kinds = dict(units.dtypes)
        return units.mapInArrow(weigh, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "grams array<long>", "tfs array<double>"]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, evidence_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                g, tf = grams_of(text or "")
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(g), pa.string()), pa.array([evidence_id] * len(g), pa.string()), pa.array(g), pa.array(1 + np.log(tf))], names=["path", "evidence_id", "gram", "tf"])

    own = units.select("path", "evidence_id", "plain").mapInArrow(spread, "path string, evidence_id string, gram long, tf double")
    w = own.join(counts, "gram").withColumn("w", F.col("tf") * (F.ln(F.lit(1.0 + total) / (1 + F.col("df"))) + 1))
    # the grams of one unit of at most some thousand characters
    packed = w.groupBy("path", "evidence_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"), F.array_sort(F.collect_list(F.struct("gram", "w"))).alias("x"))
    return units.drop("plain").join(packed, ["path", "evidence_id"], "left").select(*names, F.coalesce(F.col("x.gram"), F.array().cast("array<long>")).alias("grams"), F.coalesce(F.transform("x.w", lambda v: v / F.col("size")), F.array().cast("array<double>")).alias("tfs"))


def _query_vectors(block: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """query_id, gram, weight (unit length); grams that no unit has are left out."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g, tf = grams_of(text or "")
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(g), batch.column(0).type), pa.array(g), pa.array(1 + np.log(tf))], names=["query_id", "gram", "tf"])

    kind = dict(block.dtypes)["query_id"]
    own = block.select("query_id", _plain(collapse(F.col("query"))).alias("plain")).mapInArrow(spread, f"query_id {kind}, gram long, tf double")
    w = materialize(own.join(counts, "gram").select("query_id", "gram", (F.col("tf") * (F.ln(F.lit(1.0 + total) / (1 + F.col("df"))) + 1)).alias("w")), "query-grams")
    sizes = w.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return w.join(sizes, "query_id").select("query_id", "gram", (F.col("w") / F.col("size")).alias("weight"))


def weights_of(rows: pa.Table, key: str, place: dict) -> Weights:
    return Weights(rows[key].to_pylist(), [place[q] for q in rows["query_id"].to_pylist()], rows["weight"].to_pylist(), len(place))


def blocks(queries: DataFrame, size: int = BLOCK) -> Iterator[DataFrame]:
    """Questions in blocks of about ``size`` rows; each block is one pass over the units."""
    parts = max(1, -(-queries.count() // size))
    for part in range(parts):
        yield queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part) if parts > 1 else queries


class Running:
    """Units that can still be among each question's k best, as a task has met them so far.

    With k better units of other paths a unit is out, whatever the cap on units of
    one path. A unit is known by what it scores at least (``low``) and at most (``high``).
    """

    def __init__(self, width: int, k: int):
        self.k, self.least = k, np.full(width, -np.inf)
        self.question, self.path, self.low, self.high = np.empty(0, np.int64), np.empty(0, object), np.empty(0), np.empty(0)
        self.rows: dict[str, np.ndarray] = {}

    def add(self, paths: pa.Array, low: np.ndarray, high: np.ndarray, **values: np.ndarray) -> None:
        """Figures of units (rows) for questions (columns); a unit that scores nought at most is left out."""
        unit, question = np.nonzero((high > 0) & (high >= self.least))
        names = np.array(paths.to_pylist(), object)
        self.question, self.path = np.concatenate([self.question, question]), np.concatenate([self.path, names[unit]])
        self.low, self.high = np.concatenate([self.low, low[unit, question]]), np.concatenate([self.high, high[unit, question]])
        for name, x in values.items():
            self.rows[name] = np.concatenate([self.rows.get(name, np.empty(0, x.dtype)), x[unit, question]])
        if not len(self.question):
            return
        _, owner = np.unique(self.path, return_inverse=True)
        order = np.lexsort((-self.low, owner, self.question))
        q, o = self.question[order], owner[order]
        first = np.concatenate([[True], (q[1:] != q[:-1]) | (o[1:] != o[:-1])])  # the best of each path
        q, best = q[first], self.low[order][first]
        ranked = np.lexsort((-best, q))
        q, best = q[ranked], best[ranked]
        begin = np.searchsorted(q, np.arange(len(self.least)))
        full = np.flatnonzero(np.bincount(q, minlength=len(self.least)) >= self.k)
        self.least[full] = np.maximum(self.least[full], best[begin[full] + self.k - 1])
        keep = self.high >= self.least[self.question]
        self.question, self.path, self.low, self.high = self.question[keep], self.path[keep], self.low[keep], self.high[keep]
        self.rows = {name: x[keep] for name, x in self.rows.items()}


def retrieve(units: DataFrame, queries: DataFrame, *, scope: str = ".", top_k: int = 8, per_source: int = 3, among: DataFrame | None = None, vectors: bool = True) -> DataFrame:
    """The best units for each query: rank, scores, at most ``per_source`` of a path.

    units: the evidence corpus. queries: query_id, query. among: evidence_id of an
    earlier result, to search in it only. BM25 counts the terms of the whole
    scope; TF-IDF compares 2- to 4-grams of characters, all those of the scope,
    and the query itself does not change their weights. Scores are relative to the
    best unit of the query.
    """
    top_k = max(1, min(top_k, 50))
    units = units.filter(in_scope(F.col("path"), scope))
    if among is not None:
        units = units.join(among.select("evidence_id").distinct(), "evidence_id", "left_semi")
    kept = ["path", "evidence_id", "tokens"] + (["plain"] if vectors else [])
    own = materialize(units.select("path", "evidence_id", search_words(F.col("text")).alias("tokens"), _plain(F.col("text")).alias("plain")).select(*kept), "tokens")
    weighted, total, average = _term_weights(own, queries)
    weighted = materialize(weighted, "weights")
    scored_units = own
    if vectors:
        counts = materialize(own.select("plain").mapInArrow(_gram_rows, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df")), "gram-counts")
        scored_units = materialize(_vectors(own, counts, total), "vectors")
    spark, kind, found = units.sparkSession, dict(queries.dtypes)["query_id"], None
    for block in blocks(queries.select("query_id", "query")):
        names = [r["query_id"] for r in block.select("query_id").distinct().orderBy("query_id").collect()]
        place = {q: i for i, q in enumerate(names)}
        terms = weights_of(weighted.join(block.select("query_id").distinct(), "query_id", "left_semi").toArrow(), "term", place)
        grams = weights_of(_query_vectors(block, counts, total).toArrow(), "gram", place) if vectors else None
        sent = spark.sparkContext.broadcast((terms, grams, names))

        def both(batch: pa.RecordBatch, terms: Weights, grams: Weights | None) -> tuple[np.ndarray, np.ndarray]:
            lexical, vector = np.zeros((batch.num_rows, terms.width)), np.zeros((batch.num_rows, terms.width if grams else 0))
            of = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i, tokens in enumerate(of["tokens"].to_pylist()):
                tf: dict[str, int] = {}
                for t in tokens:
                    if t in terms.of:
                        tf[t] = tf.get(t, 0) + 1
                lexical[i] = terms.by_word({t: n * (K1 + 1) / (n + K1 * (1 - B + B * len(tokens) / average)) for t, n in tf.items()})
                if grams:
                    vector[i] = grams.by_gram(of["grams"][i].values.to_numpy(), of["tfs"][i].values.to_numpy())
            return lexical, vector

        def tops(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            terms, grams, _ = sent.value
            top = np.zeros((2, terms.width))
            for batch in parts_of(batches):
                for i, s in enumerate(both(batch, terms, grams)):
                    if s.size:
                        top[i] = np.maximum(top[i], s.max(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(terms.width)), pa.array(top[0]), pa.array(top[1])], names=["q", "b", "v"])

        highest = np.zeros((2, len(names)))
        for r in scored_units.mapInArrow(tops, "q long, b double, v double").groupBy("q").agg(F.max("b").alias("b"), F.max("v").alias("v")).collect():  # a row for each question of the block
            highest[:, r["q"]] = r["b"], r["v"]
        highest[highest == 0] = np.inf

        def best(batches: Iterator[pa.RecordBatch], sent=sent, highest=highest) -> Iterator[pa.RecordBatch]:
            terms, grams, names = sent.value
            found = Running(len(names), top_k)
            for batch in parts_of(batches):
                if not batch.num_rows or not names:
                    continue
                lexical, vector = both(batch, terms, grams)
                b, v = lexical / highest[0], vector / highest[1] if vector.size else np.zeros_like(lexical)
                score = LEXICAL * b + VECTOR * v if grams else b
                ids = np.array(batch.column(1).to_pylist(), object)
                found.add(batch.column(0), score, np.where(score > 0, score + SLACK, 0), id=np.broadcast_to(ids[:, None], score.shape), b=b, v=v)
            rows = found.rows or {"id": np.empty(0, object), "b": np.empty(0), "v": np.empty(0)}
            yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in found.question], arrow_type(kind)), pa.array(found.path, pa.string()), pa.array(rows["id"], pa.string()), pa.array(rows["b"]), pa.array(rows["v"]), pa.array(found.low)], names=["query_id", "path", "evidence_id", "bm25", "tfidf", "score"])

        one = scored_units.mapInArrow(best, f"query_id {kind}, path string, evidence_id string, bm25 double, tfidf double, score double")
        found = one if found is None else found.unionByName(one)
    scores = found.withColumns({c: F.round(c, 6) for c in ("bm25", "tfidf", "score")})
    order = [F.desc("score"), F.col("path"), F.col("evidence_id")]
    best_of = first_rows(scores.filter("score > 0"), ["query_id", "path"], order, per_source)
    return best_of.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("long")).filter(F.col("rank") <= top_k)


def frequent_tokens(units: DataFrame, most: int = 8) -> DataFrame:
    """One query (query_id 0) of the most frequent tokens of the units, for a package without topics; ties by token.

    A corpus without tokens is asked for its main findings.
    """
    fits = F.length("token").between(2, 16) & ~F.col("token").isin(GENERAL_TOKENS)
    counted = units.select(F.explode(search_words(F.col("text"))).alias("token")).filter(fits).groupBy("token").agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(most)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "token"))), lambda x: x["token"]), " ")  # ``most`` tokens
    return top.agg(listed.alias("query")).select(F.lit(0).cast("long").alias("query_id"), F.coalesce(F.nullif("query", F.lit("")), F.lit("核心主题 关键发现 主要结论")).alias("query"))


def arrow_type(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def merged(found: DataFrame, limit: int = 12) -> DataFrame:
    """The units of several searches in one list: by query and rank, each unit once, where it comes first."""
    first = found.groupBy("evidence_id").agg(F.min(F.struct("query_id", "rank", "path")).alias("x"))
    top = first.select("evidence_id", "x.*").orderBy("query_id", "rank", "evidence_id").limit(limit)
    return top.select(F.row_number().over(W.orderBy("query_id", "rank", "evidence_id")).cast("long").alias("place"), "query_id", "path", "evidence_id")  # ``limit`` rows

"""Subword lattice likelihood (operator 1).

A text is a run of tokens: its words and then one end. A word's probability is
the sum over all ways through its lattice, by a forward recursion in log space:

    P(word) = sum over all segmentations of the product of its arcs

The arcs are the pieces of an existing vocabulary, single bytes, and, for words of
the training rows, one arc from the word's beginning to its end. The long arc
weighs (c - D) / N, the way into the pieces D V / N, with c, N and V counted over
the training rows and D the usual absolute discount n1 / (n1 + 2 n2). The first
piece comes from the pieces that open a word, the others from the rest, and a stop
ends the word, so P sums to one over words.

Training rows fall into groups by language, and each group has a lattice of its
own, in which words of its rows have a second long arc, of weight
(c_k - D_k) / N_k, and D_k V_k / N_k leads to the arcs above. ``score`` is the
marginal over groups and segmentations,

    P(text) = sum_k share_k * product over tokens of P_k(token)

``lattice_score`` is that of the one lattice without groups, ``piece_score`` that
of the pieces alone. The scored row's own language is not looked at. The
``languages`` most frequent languages have a group of their own, all others and
null share one.

The vocabulary's scores are ranks (0, -1, ...), so a piece of score s weighs
1 / (3 - s), normalised. These weights start expectation maximisation over the
distinct training words and are its prior too, worth ``prior`` uses in all; the
vocabulary itself stays as it is. Single bytes are pieces too, so every text has a
finite score.

Counts come from all rows. The figures of the most frequent words (at most
``head_words``, each known by at most 64 bytes, so of a fixed size) are sent to
the tasks; all other words meet theirs in a shuffle join, in which no key is
frequent.

Null text counts as empty (only the end is scored), a null id trains, repeated
rows count and are scored each, an empty table gives an empty result. Other
columns of the input are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, in_parts, materialize, texts_of

LN10 = math.log(10)
MARK = "▁"
FLUSH_WORDS, FLUSH_BYTES = 400_000, 1 << 26


class Pieces:
    """Piece weights: ``opening`` and ``inner`` map piece bytes to log probability.

    Words of one length go through the lattice together: the pieces are a trie
    whose step is one array look-up for all words, and each cell of the lattice
    is one array operation.
    """

    def __init__(self, opening: dict[bytes, float], inner: dict[bytes, float], stop: float):
        self.opening, self.inner, self.stop = opening, inner, stop
        self.open_step, self.open_weight, self.open_at = self._trie(opening)
        self.in_step, self.in_weight, self.in_at = self._trie(inner)

    @staticmethod
    def _trie(weights: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
        """Next state by state and byte (0: none, 1: root), the weight that ends there, and each piece's state."""
        rows: list[dict[int, int]] = [{}, {}]
        at = {}
        for piece in weights:
            state = 1
            for b in piece:
                if (to := rows[state].get(b)) is None:
                    to = rows[state][b] = len(rows)
                    rows.append({})
                state = to
            at[piece] = state
        step = np.zeros((len(rows), 256), np.int32)
        for state, row in enumerate(rows):
            for b, to in row.items():
                step[state, b] = to
        weight = np.full(len(rows), -np.inf)
        for piece, state in at.items():
            weight[state] = weights[piece]
        return step, weight, at

    @classmethod
    def from_vocabulary(cls, pieces: list[tuple[bytes, bool, float]]) -> Pieces:
        """pieces: bytes, whether it opens a word, score (0 for the first, lower for all others)."""
        opening, inner = {}, {}
        for piece, opens, score in pieces:
            (opening if opens else inner).setdefault(piece, 1 / (3 - score))
        least = 1 / (3 - min((s for _, _, s in pieces), default=0))
        for b in range(256):
            inner.setdefault(bytes([b]), least)
        opening.setdefault(b"", least)
        return cls.normalised(opening, inner, 0.35)

    @classmethod
    def normalised(cls, opening: dict[bytes, float], inner: dict[bytes, float], stop: float) -> Pieces:
        a, b = sum(opening.values()), sum(inner.values())
        return cls({p: math.log(w / a) for p, w in opening.items()}, {p: math.log(w / b * (1 - stop)) for p, w in inner.items()}, math.log(stop))

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """x: words of one length, a row each. Log probability of all ways to each place, and the states of the opening pieces."""
        rows, n = x.shape
        alpha = np.full((n + 1, rows), -np.inf)
        state, first = np.ones(rows, np.int32), [(0, np.ones(rows, np.int32))]
        alpha[0] = self.open_weight[1]
        for j in range(n):
            state = self.open_step[state, x[:, j]]
            if not state.any():
                break
            alpha[j + 1] = self.open_weight[state]
            first.append((j + 1, state))
        for i in range(n):
            for j, state in self._from(x, i):
                np.logaddexp(alpha[j], alpha[i] + self.in_weight[state], out=alpha[j])
        return alpha, first

    def _from(self, x: np.ndarray, i: int) -> Iterator[tuple[int, np.ndarray]]:
        """Ends and states of the pieces that begin at i."""
        state = np.ones(x.shape[0], np.int32)
        for j in range(i, x.shape[1]):
            state = self.in_step[state, x[:, j]]
            if not state.any():
                return
            yield j + 1, state

    def log_probabilities(self, words: list[bytes], long_arcs: np.ndarray | None = None, into_pieces: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Natural log of each word's sum over its lattice, with and without the arc over the whole word.

        long_arcs: log weight of that arc; into_pieces: log weight of the way into the pieces.
        """
        pieces = np.empty(len(words))
        for at, x in _by_length(words):
            pieces[at] = self._forward(x)[0][-1] + self.stop
        return (pieces if long_arcs is None else np.logaddexp(pieces + into_pieces, long_arcs)), pieces

    def expect(self, words: list[bytes], opening: np.ndarray, inner: np.ndarray) -> None:
        """Adds the expected number of uses of each state's piece. The way back walks the pieces again, so only a row of figures for each place is held."""
        for _, x in _by_length(words):
            alpha, first = self._forward(x)
            n, total = x.shape[1], alpha[-1]
            beta = np.full_like(alpha, -np.inf)
            beta[n] = 0.0
            states, uses, held = [], [], 0
            for i in range(n - 1, -1, -1):
                for j, state in self._from(x, i):
                    through = self.in_weight[state] + beta[j]
                    np.logaddexp(beta[i], through, out=beta[i])
                    states.append(state)
                    uses.append(np.exp(alpha[i] + through - total))
                    held += len(state)
                if held > 1 << 18 or (not i and states):
                    inner += np.bincount(np.concatenate(states), np.concatenate(uses), len(inner))
                    states, uses, held = [], [], 0
            for j, state in first:
                opening += np.bincount(state, np.exp(self.open_weight[state] + beta[j] - total), len(opening))


def _by_length(words: list[bytes], most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length as byte matrices of a bounded size, with their places."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(words) else []:
        n = int(sizes[at[0]])
        for part in np.array_split(at, -(-len(at) * n // most)):
            if len(part):
                yield part, np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), n)


def load_pieces(model_file: str) -> list[tuple[bytes, bool, float]]:
    """Pieces of a sentencepiece vocabulary that can stand in a word."""
    import sentencepiece

    m, out = sentencepiece.SentencePieceProcessor(model_file=model_file), []
    for i in range(m.get_piece_size()):
        piece = m.id_to_piece(i)
        if m.is_control(i) or m.is_unknown(i) or m.is_byte(i):
            continue
        opens = piece.startswith(MARK)
        body = piece[1:] if opens else piece
        if MARK in body or (not body and not opens):
            continue
        out.append((body.encode(), opens, m.get_score(i)))
    return out


def word_key(word: bytes) -> bytes:
    """The word, or a digest where it is long; no word has a blank."""
    return word if len(word) <= 64 else b" " + xxhash.xxh3_128_digest(word)


def count_words(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Uses of each word in the training rows of each group, and in the other rows."""
    counts = [Counter() for _ in range(groups + 1)]
    held = 0

    def out() -> pa.RecordBatch:
        words = list(set().union(*counts))
        batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array([c.get(w, 0) for w in words], pa.int64()) for c in counts)], names=["word", *(f"c{k}" for k in range(groups)), "other"])
        for c in counts:
            c.clear()
        return batch

    for batch in in_parts(batches):
        for text, out_of, group in zip(texts_of(batch), column(batch, "held_out").to_pylist(), column(batch, "grp").to_pylist(), strict=True):
            counts[groups if out_of else group].update(text.lower().split())
            held += len(text)
            if held > FLUSH_BYTES or sum(map(len, counts)) > FLUSH_WORDS:
                yield out()
                held = 0
    yield out()


def fit_pieces(words: DataFrame, pieces: Pieces, rounds: int, prior: float) -> Pieces:
    """Expectation maximisation over the distinct training words, one Spark job a round; the first weights count as ``prior`` uses."""
    spark = words.sparkSession
    believed = [{p: prior * math.exp(w) for p, w in table.items()} for table in (pieces.opening, pieces.inner)]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces.opening, pieces.inner, pieces.stop))

        def expected(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            model, n = Pieces(*sent.value), 0
            opening, inner = np.zeros(len(model.open_weight)), np.zeros(len(model.in_weight))
            for batch in in_parts(batches):
                words = column(batch, "word").to_pylist()
                n += len(words)
                model.expect(words, opening, inner)
            rows = [(k, p, u) for k, at, uses in ((0, model.open_at, opening), (1, model.in_at, inner)) for p, s in at.items() if (u := float(uses[s]))] + [(2, b"", float(n))]
            kinds, keys, uses = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.binary()), pa.array(uses, pa.float64())], names=["kind", "piece", "uses"])

        rows = words.select("word").mapInArrow(expected, "kind int, piece binary, uses double").groupBy("kind", "piece").agg(F.sum("uses").alias("uses")).toArrow().to_pylist()
        uses = {(r["kind"], bytes(r["piece"])): r["uses"] for r in rows}
        ended, inner_uses = uses.get((2, b""), 0.0), sum(v for (k, _), v in uses.items() if k == 1)
        sent.unpersist()
        if not ended:
            break
        opening = {p: uses.get((0, p), 0.0) + m for p, m in believed[0].items()}
        inner = {p: uses.get((1, p), 0.0) + m for p, m in believed[1].items()}
        pieces = Pieces.normalised(opening, inner, (ended + 1) / (ended + inner_uses + 2))
    return pieces


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def _step(uses: Column) -> Column:
    """Uses in steps that rise with them: themselves up to 100,000, hundredths of a doubling beyond, so there are few steps however large the counts."""
    return F.when(uses < 100_000, uses).otherwise(100_000 + F.floor(100 * F.log2(uses / 100_000))).cast("long")


def _least_count(spectrum: dict[int, int], room: int) -> int:
    """Lowest step such that at most ``room`` words have it or more."""
    least = max(spectrum, default=0) + 1
    for n in sorted(spectrum, reverse=True):
        if (room := room - spectrum[n]) < 0:
            break
        least = n
    return least


def score_documents(docs: DataFrame, model_file: str, *, head_words: int = 150_000, rounds: int = 2, prior: float = 300.0, languages: int = 7) -> DataFrame:
    """docs: doc_id, text, lang, held_out. One row for each row of docs; see the module's text."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    by_lang = docs.filter("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    groups = len(by_lang) + 1
    of_lang = F.lit(groups - 1)
    for k, r in enumerate(by_lang):
        of_lang = F.when(F.col("lang") == r["lang"], k).otherwise(of_lang)
    docs = docs.select("doc_id", "text", "held_out", F.coalesce(of_lang, F.lit(groups - 1)).alias("grp"))
    cs = [f"c{k}" for k in range(groups)]
    counted = docs.select("text", "held_out", "grp").mapInArrow(lambda it: count_words(it, groups), "word binary, " + ", ".join(f"{c} bigint" for c in cs) + ", other bigint")
    train = sum((F.col(c) for c in cs[1:]), F.col(cs[0]))
    words = materialize(counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in (*cs, "other"))).withColumn("train", train), "words")
    spectrum = {r["n"]: r["words"] for r in words.groupBy(_step(F.col("train") + F.col("other")).alias("n")).agg(F.count("*").alias("words")).collect()}
    least = _least_count(spectrum, head_words)
    figures = [f(c).alias(f"{n}_{c}") for c in ("train", *cs) for n, f in (("n", F.sum), ("v", lambda c: F.count_if(F.col(c) > 0)), ("n1", lambda c: F.count_if(F.col(c) == 1)), ("n2", lambda c: F.count_if(F.col(c) == 2)))]
    facts = words.agg(*figures).first()
    ended = {r["grp"]: r["count"] for r in docs.filter(~F.col("held_out")).groupBy("grp").count().collect()}

    def law(c: str, ends: int) -> tuple[int, int, float, float]:
        """Tokens, distinct tokens, discount, and the weight of the law below."""
        n, v, d = (facts[f"n_{c}"] or 0) + ends, facts[f"v_{c}"] + (ends > 0), _discount(facts[f"n1_{c}"], facts[f"n2_{c}"])
        return n, v, d, d * v / n if n else 1.0

    ends = sum(ended.values())
    total, distinct, discount, left = law("train", ends)
    laws = [law(c, ended.get(k, 0)) for k, c in enumerate(cs)]
    shares = [math.log10((ended.get(k, 0) + 1) / (ends + groups)) for k in range(groups)]

    pieces = fit_pieces(words.filter("train > 0"), Pieces.from_vocabulary(load_pieces(model_file)), rounds, prior)
    sent = spark.sparkContext.broadcast((pieces.opening, pieces.inner, pieces.stop))
    ms = [f"m{k}" for k in range(groups)]
    sums = ["b", "p", *ms, "q"]

    def own(c: np.ndarray, d: float, n: int) -> np.ndarray:
        return np.where(c > 0, c - d, 0) / max(n, 1)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(*sent.value)
        for batch in in_parts(batches):
            names = column(batch, "word").to_pylist()
            c = column(batch, "train").to_numpy().astype(float)
            with np.errstate(divide="ignore"):
                long_arcs = np.log(own(c, discount, total))
                p, q = model.log_probabilities(names, long_arcs, math.log(left))
                m = [np.logaddexp(np.log(own(column(batch, k).to_numpy().astype(float), d, n)), math.log(rest) + p) / LN10 for k, (n, _, d, rest) in zip(cs, laws, strict=True)]
            known = [pa.array(list(map(word_key, names)), pa.binary()), column(batch, "train"), column(batch, "other")]
            yield pa.RecordBatch.from_arrays([*known, *map(pa.array, (np.log10(c + 1), p / LN10, *m, q / LN10))], names=["word", "train", "other", *sums])

    weighed = materialize(words.mapInArrow(weigh, "word binary, train bigint, other bigint, " + ", ".join(f"{x} double" for x in sums)), "weighed")
    frequent = _step(F.col("train") + F.col("other")) >= least
    head = weighed.filter(frequent).select("word", (F.col("train") > 0).cast("double").alias("known"), *sums).toArrow()  # head_words rows at most
    sent_head = spark.sparkContext.broadcast(({w: i for i, w in enumerate(head.column("word").to_pylist())}, np.stack([head.column(c).to_numpy() for c in ("known", *sums)], axis=1)))
    end_all = max(ends - discount, 1e-300) / max(total, 1)
    end = [float(ends > 0), math.log10(ends + 1), math.log10(end_all), *(math.log10(own(np.array(float(ended.get(k, 0))), d, n) + rest * end_all) for k, (n, _, d, rest) in enumerate(laws)), 0.0]
    totals = ["n_known", *sums]
    parts_of = ["uid bigint", "doc_id " + dict(docs.dtypes)["doc_id"], "held_out boolean", "n_tokens bigint", *(f"{x} double" for x in totals), "word binary", "tf bigint"]
    kinds = spark.createDataFrame([], ", ".join(parts_of)).schema
    fields = pa.schema([pa.field(f.name, {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "integer": pa.int32(), "string": pa.string()}[f.dataType.typeName()]) for f in kinds])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with the sums over its frequent words, and one for each of its other words."""
        (places, table), base = sent_head.value, TaskContext.get().partitionId() << 40
        at, rows, others = 0, [], ([], [], [])  # others: row, word and uses

        def of_documents() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols, fields, strict=False)), *(pa.nulls(len(rows), f.type) for f in list(fields)[-2:])], schema=fields)

        def of_words() -> pa.RecordBatch:
            uids, words, uses = others
            return pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), *(pa.nulls(len(uids), f.type) for f in list(fields)[1:-2]), pa.array(words, pa.binary()), pa.array(uses, pa.int64())], schema=fields)

        for batch in in_parts(batches):
            for doc, out_of, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "held_out").to_pylist(), texts_of(batch), strict=True):
                counts, uid = Counter(text.lower().split()), base + at
                at += 1
                found, uses, before = [], [], len(others[1])
                for word, n in counts.items():
                    if len(word) > 64:
                        word = word_key(word)
                    if (i := places.get(word)) is not None:
                        found.append(i)
                        uses.append(n)
                    else:
                        others[1].append(word)
                        others[2].append(n)
                others[0].extend([uid] * (len(others[1]) - before))
                values = end + np.array(uses, float) @ table[found] if found else end
                rows.append((uid, doc, out_of, 1 + counts.total(), *map(float, values)))
                if len(others[0]) > 100_000:
                    yield of_words()
                    others = ([], [], [])
            if len(rows) > 20_000:
                yield of_documents()
                rows = []
        if others[0]:
            yield of_words()
        if rows:
            yield of_documents()

    parts = materialize(docs.mapInArrow(score, kinds), "parts")
    others = weighed.filter(~frequent).select("word", (F.col("train") > 0).cast("double").alias("n_known"), *sums)
    rare = parts.filter("word is not null").select("uid", "word", "tf").join(others, "word").groupBy("uid").agg(*(F.sum(F.col("tf") * F.col(x)).alias(f"r_{x}") for x in totals))
    both = parts.filter("word is null").join(rare, "uid", "left").select("doc_id", "held_out", "n_tokens", *((F.col(x) + F.coalesce(f"r_{x}", F.lit(0.0))).alias(x) for x in totals))
    ways = F.array(*(F.col(m) + F.lit(s) for m, s in zip(ms, shares, strict=True)))
    best = F.array_max("ways")
    marginal = best + F.log10(F.aggregate("ways", F.lit(0.0), lambda t, x: t + F.pow(F.lit(10.0), x - best)))
    return both.withColumn("ways", ways).select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.round("n_known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("b") - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        marginal.alias("score"),
        F.col("p").alias("lattice_score"),
        F.col("q").alias("piece_score"),
    )

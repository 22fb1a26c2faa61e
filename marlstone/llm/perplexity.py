"""N-gram perplexity (operator 2).

Spark counts the n-grams of code points, five long, of all documents by language;
from the counts comes an interpolated modified Kneser-Ney model a language. Every
figure of the models is a Spark aggregate or join over the table of distinct
n-grams. What scoring needs is one table of 64-bit hashes and values,

    log P(x | four before) = log 1/4096 + sum over orders n of
        value(n-gram) + value(its context)

where a context that was seen is worth the log of its back-off weight and an
n-gram that was seen what it adds to that; so a score is a sum of look-ups, and
the table may be parted by key: it goes to the tasks in sorted hash arrays of at
most ``entries`` rows, one after the other, and the parts' sums are added up.
Usual models are one part. The table grows with the input and has no cap.

Documents are dealt into two halves by a hash of the text, and each half is scored
by the model of the other one, so that no text is held against itself or its exact
copies. Texts with more than one symbol for ten words are what a model should
reject, so it is counted without them unless its language has nothing else.

A document's perplexity is held against its language's band: more than ``high``
spreads above or ``low`` below the median is rejected, where a spread is the
distance from the median to the quartile on that side (``LEAST_SPREAD`` at least,
as the quartiles are counted in steps of a thousandth; above the median at most
twice that below, as much junk moves the upper quartile itself). Short texts have
a wider band, as their perplexity is noisier.

``HIGH`` and ``LOW`` are set so that 1 % of the documents of quality 1 that pass
the base rules are rejected on each side. They were read off a bounded sample:
the labelled documents of the table of 10,000 with even ids. The README has the
shares on those with odd ids.

A code point has one of 4,096 classes: itself below 2,048 (ASCII letters without
case, digits as one, white space as one, line ends, capitals after capitals as
one), a hash of it above.

Null text has no words and fails the base rules. A null language is a language of
its own, other than an empty one. A language whose texts are all in one half has
no model; its texts have one perplexity and are inside its band. Repeated rows
count each. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, in_parts, materialize, only, released, texts_of, worker_cache

ORDER, BITS = 5, 12
CLASSES = 1 << BITS
SYMBOLS = b"#*$%&|<>"
CHUNK, LATE = 500_000, 1 << 20
_arrays: dict[str, HashArrays] = worker_cache()
#: Bands in spreads; the least spread; symbols a word in texts that models are counted on.
HIGH, LOW, LEAST_SPREAD, MOST_SYMBOLS = 4.7, 4.35, 0.002, 0.1
#: Classes of a capital after a capital, so that shouting is seen, and of control characters.
SHOUTED, CONTROL = 1, 2
FACTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, log_p double, n_chars bigint"
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "lower_bound", "upper_bound")


def _low_classes() -> np.ndarray:
    """Class of each code point below 2,048."""
    t = np.arange(2048)
    t[:32], t[127] = CONTROL, CONTROL
    t[[9, 11, 12, 13, 32]], t[10] = 32, 10
    t[48:58] = 48
    t[65:91] += 32
    return t


LOW_CLASSES = _low_classes()


def keys_of(text: bytes) -> np.ndarray:
    """Packed n-grams of a text, one for each code point and one for its end."""
    c = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    s = np.zeros(len(c) + ORDER, np.int64)
    s[ORDER - 1 : -1] = np.where(c < 2048, LOW_CLASSES[np.minimum(c, 2047)], 2048 + (c * 2654435761 >> 7) % 2048)
    capital = (c >= 65) & (c <= 90)
    s[ORDER:-1][capital[1:] & capital[:-1]] = SHOUTED
    out = s[: len(s) - ORDER + 1].copy()
    for k in range(1, ORDER):
        out = out << BITS | s[k : len(s) - ORDER + 1 + k]
    return out


def _merged(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in pairs]), np.concatenate([c for _, c in pairs])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


def symbols_in(text: bytes) -> int:
    return len(text) - len(text.translate(None, SYMBOLS))


@released
def count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by model, apart for prose and for texts full of symbols; what a task holds is bounded."""
    only(_arrays)
    waiting: dict[tuple[int, bool], list[np.ndarray]] = {}
    size: dict[tuple[int, bool], int] = {}
    have: dict[tuple[int, bool], list] = {}

    def fold(name: tuple[int, bool]) -> None:
        have.setdefault(name, []).append(np.unique(np.concatenate(waiting.pop(name)), return_counts=True))
        size[name] = 0
        if sum(len(k) for k, _ in have[name]) > 4 * CHUNK or len(have[name]) > 24:
            have[name] = [_merged(have[name])]

    def out(names: list[tuple[int, bool]]) -> Iterator[pa.RecordBatch]:
        for name in names:
            keys, counts = _merged(have.pop(name))
            for i in range(0, len(keys), 100_000):
                k = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), name[0])), pa.array(np.full(len(k), name[1])), pa.array(k), pa.array(counts[i : i + 100_000])], names=["model", "prose", "gram", "n"])

    for batch in in_parts(batches):
        for name, text in zip(column(batch, "own").to_pylist(), texts_of(batch), strict=True):
            model = name, symbols_in(text) <= MOST_SYMBOLS * len(text.split())
            waiting.setdefault(model, []).append(keys_of(text))
            size[model] = size.get(model, 0) + len(text)
            if size[model] > CHUNK:
                fold(model)
        if sum(len(k) for pairs in have.values() for k, _ in pairs) > 8 * CHUNK:
            yield from out(list(have))
    for model in list(waiting):
        fold(model)
    yield from out(list(have))


def _discounts(c: Column) -> list[Column]:
    """The three discounts of modified Kneser-Ney from the numbers of n-grams counted once to four times."""
    ones, twos = F.count_if(c == 1), F.count_if(c == 2)
    seen = [F.count_if(c == i) for i in (1, 2, 3, 4)]
    y = F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5)
    return [F.when(seen[i - 1] > 0, F.least(F.lit(float(i)), F.greatest(F.lit(0.05), i - (i + 1) * y * seen[i] / seen[i - 1]))).otherwise(0.5).alias(f"d{i}") for i in (1, 2, 3)]


def _mask(n: int) -> int:
    return (1 << BITS * n) - 1


def kneser_ney(counts: DataFrame) -> DataFrame:
    """counts: model, gram, n of the longest n-grams. key, value: what scoring looks up."""
    levels = [counts.select("model", "gram", F.col("n").alias("c"))]
    for n in range(ORDER - 1, 0, -1):  # lower orders count the distinct left neighbours
        levels.insert(0, materialize(levels[0].groupBy("model", F.col("gram").bitwiseAND(_mask(n)).alias("gram")).agg(F.count("*").alias("c")), f"grams-{n}"))
    entries, below = None, None
    for n, level in enumerate(levels, 1):
        known = materialize(level.groupBy("model").agg(*_discounts(F.col("c"))), "discounts")
        cut = F.least(F.col("c").cast("double"), F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        own = level.join(known, "model").select("model", "gram", F.shiftright("gram", BITS).alias("context"), F.col("c").cast("double").alias("c"), cut.alias("cut"))
        contexts = materialize(own.groupBy("model", "context").agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("gamma")), f"contexts-{n}")
        met = own.join(contexts, ["model", "context"])
        if below is None:
            met = met.withColumn("lower", F.lit(1.0 / CLASSES))
        else:
            met = met.withColumn("suffix", F.col("gram").bitwiseAND(_mask(n - 1))).join(below, ["model", "suffix"])
        p = (F.col("c") - F.col("cut")) / F.col("total") + F.col("gamma") * F.col("lower")
        placed = materialize(met.withColumn("p", p).select("model", "gram", "p", (F.ln("p") - F.ln("lower") - F.ln(F.greatest("gamma", F.lit(1e-12)))).alias("value")), f"placed-{n}")
        below = placed.select("model", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        both = placed.select("model", F.lit(n).alias("kind"), "gram", "value").union(contexts.select("model", F.lit(-n).alias("kind"), "context", F.ln(F.greatest("gamma", F.lit(1e-12)))))
        entries = both if entries is None else entries.union(both)
    return materialize(entries.mapInArrow(_keyed, "key bigint, value float"), "model")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(models: np.ndarray, kinds: np.ndarray | int, grams: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams (kind n) and contexts (kind -n) of models."""
    seed = _mixed(models.astype(np.int64).view(np.uint64) + np.asarray(kinds, np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _mixed(grams.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed).view(np.int64)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        model, kind, gram, value = (batch.column(i).to_numpy() for i in range(4))
        yield pa.RecordBatch.from_arrays([pa.array(hashes(model, kind, gram)), pa.array(value.astype(np.float32))], names=["key", "value"])


class HashArrays:
    """One part of the table: sorted keys and their values, and what has been looked up lately."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.late_keys, self.late_sums = np.zeros(LATE, np.int64), np.zeros(LATE)

    def _of(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.values[at], np.float32(0)).astype(float)

    def sums(self, models: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """What this part adds to the log probability of each packed n-gram under its model."""
        out = np.zeros(len(grams))
        if len(self.keys):
            for n in range(1, ORDER + 1):
                own = grams & _mask(n)
                out += self._of(hashes(models, n, own)) + self._of(hashes(models, -n, own >> BITS))
        return out

    def sums_of_texts(self, models: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """``sums`` for grams that repeat often."""
        names = hashes(models, 0, grams)
        slots = names & (LATE - 1)
        known = self.late_keys[slots] == names
        out = self.late_sums[slots]
        if not known.all():
            new, first, back = np.unique(names[~known], return_index=True, return_inverse=True)
            found = self.sums(models[~known][first], grams[~known][first])
            out[~known] = found[back]
            self.late_keys[new & (LATE - 1)], self.late_sums[new & (LATE - 1)] = new, found
        return out


def _arrays_of(name: str, sent: Broadcast) -> HashArrays:
    """The worker's arrays; those of another part are let go."""
    only(_arrays)
    if name not in _arrays:
        _arrays.clear()
        _arrays[name] = HashArrays(*sent.value)
    return _arrays[name]


def log_probabilities(arrays: HashArrays, models: list[int], texts: list[bytes]) -> np.ndarray:
    """This part's share of the log probability of each text."""
    out = np.zeros(len(texts))
    keys, owners, held = [], [], 0

    def flush() -> None:
        owner = np.concatenate(owners)
        out[:] += np.bincount(owner, arrays.sums_of_texts(np.array(models, np.int64)[owner], np.concatenate(keys)), len(texts))

    for i, text in enumerate(texts):
        grams = keys_of(text)
        for k in range(0, len(grams), CHUNK):
            keys.append(grams[k : k + CHUNK])
            owners.append(np.full(len(keys[-1]), i))
            held += len(keys[-1])
            if held >= CHUNK:
                flush()
                keys, owners, held = [], [], 0
    if keys:
        flush()
    return out


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows of ``window`` words that are found twice or more in the text."""
    n = len(words)
    if n < window + 1:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    at = a
    for k in range(1, window):  # rank the runs of k + 1 words by the rank of k words and the next word
        pair = at[:-1] * len(ids) + a[k:] if k == 1 else at[: n - k] * len(ids) + a[k:]
        _, at, c = np.unique(pair, return_inverse=True, return_counts=True)
        if len(c) == n - k:
            return 0
    edge = np.zeros(n + 1, np.int64)
    found = np.flatnonzero(c[at] > 1)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def facts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = len(text) - sum(map(text.count, (b" ", b"\t", b"\n", b"\x0b", b"\f", b"\r")))
    if not text.isascii():
        chars -= len(text) - len(text.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, symbols_in(text), len(lines) - len(set(lines)), repeated_words(words)


def _scored(source: DataFrame, ids: list[str], text: str, name: str, sent: Broadcast, kinds: dict[str, str]) -> DataFrame:
    """Base figures and the first part's share of the log probability. A text that is handed on is sent once."""

    @released
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _arrays_of(name, sent)
        for batch in in_parts(batches):
            texts, rows = texts_of(batch, text), []
            for x in texts:
                n_words, chars, symbols, dup, repeat = facts(x)
                rows.append((n_words, chars, symbols, dup, repeat, n_words < 10 or 100 * repeat > 20 * n_words))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            made = [pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 5 + [pa.bool_()], strict=True)]
            shares = log_probabilities(arrays, column(batch, "other").to_pylist(), texts)
            lengths = [len(t) if t.isascii() else len(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ids), *made, pa.array(shares), pa.array(lengths, pa.int64())], names=[*ids, *(x.split()[0] for x in FACTS.split(", "))])

    return source.select(*dict.fromkeys([*ids, text]), "other").mapInArrow(score, ", ".join([*(f"{c} {kinds[c]}" for c in ids), FACTS]))


def _share(source: DataFrame, text: str, name: str, sent: Broadcast) -> DataFrame:
    """uid, log_p: a further part's share."""

    @released
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _arrays_of(name, sent)
        for batch in in_parts(batches):
            yield pa.RecordBatch.from_arrays([column(batch, "uid"), pa.array(log_probabilities(arrays, column(batch, "other").to_pylist(), texts_of(batch, text)))], names=["uid", "log_p"])

    return source.select("uid", text, "other").mapInArrow(score, "uid bigint, log_p double")


def judge_documents(docs: DataFrame, *, id_columns: tuple[str, ...] = ("doc_id",), high: float = HIGH, low: float = LOW, entries: int = 8_000_000) -> DataFrame:
    """docs: the id columns, text, lang. Base figures, perplexity, band and verdict for each row.

    ``id_columns`` are handed on as they are, text and lang among them if so asked;
    one that is called like a result gets a trailing underscore.
    """
    spark = docs.sparkSession
    ids = [f"c{i}" for i in range(len(id_columns))]
    text = ids[id_columns.index("text")] if "text" in id_columns else "text"
    own_text = [] if "text" in id_columns else ["text"]
    half = F.crc32(F.coalesce("text", F.lit("")).cast("binary")) % 2
    lang = F.col("lang").cast("string")
    source = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(id_columns, ids, strict=True)), *own_text, F.xxhash64(lang).alias("lang_id"), F.xxhash64(lang, half).alias("own"), F.xxhash64(lang, 1 - half).alias("other"))
    counted = source.select("own", F.col(text).alias("text")).mapInArrow(count_ngrams, "model bigint, prose boolean, gram bigint, n bigint").groupBy("model", "prose", "gram").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "grams")
    usable = materialize(counted.groupBy("model").agg(F.max(F.col("prose") & (F.col("gram") != 0)).alias("has_prose")), "usable")  # an empty text has the n-gram 0 alone
    chosen = counted.join(usable, "model").filter("prose or not has_prose").groupBy("model", "gram").agg(F.sum("n").alias("n"))
    table = kneser_ney(materialize(chosen, "grams-5"))
    parts = max(1, -(-table.count() // entries))
    if parts > 1:  # a row then has to be known in several passes
        source = materialize(source.withColumn("uid", F.monotonically_increasing_id()), "source")
        ids.append("uid")

    def send(part: int) -> tuple[str, Broadcast]:
        rows = table.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).orderBy("key").toArrow()  # about ``entries`` rows
        return uuid.uuid4().hex, spark.sparkContext.broadcast((rows["key"].to_numpy(), rows["value"].to_numpy()))

    kept_ids = [*ids, "lang_id"]
    scored = materialize(_scored(source, kept_ids, text, *send(0), dict(source.dtypes)), "scored")
    for part in range(1, parts):
        more = materialize(_share(source, text, *send(part)), "share").withColumnRenamed("log_p", "more")
        scored = materialize(scored.join(more, "uid").withColumn("log_p", F.col("log_p") + F.col("more")).drop("more"), "scored")
    scored = scored.withColumn("log_ppl", float(np.log(CLASSES)) - F.col("log_p") / (F.col("n_chars") + 1))
    # counts by steps of a thousandth, so a table of a fixed size for each language, which comes out alike in every run
    steps = scored.filter("not base_failed").groupBy("lang_id", F.floor(F.col("log_ppl") * 1000).alias("step")).agg(F.count("*").alias("n"))
    by_lang = W.partitionBy("lang_id")
    upto = steps.withColumns({"upto": F.sum("n").over(by_lang.orderBy("step")), "all": F.sum("n").over(by_lang)})
    at = {name: (F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("step"))) + 0.5) / 1000 for name, share in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))}
    bands = materialize(upto.groupBy("lang_id").agg(*(c.alias(n) for n, c in at.items())), "bands")
    met = scored.join(bands, "lang_id", "left")
    middle = F.coalesce("q2", F.lit(0.0))
    wider = 1 + 8 / F.sqrt(F.col("n_chars") + 1)
    down = F.greatest(F.coalesce(F.col("q2") - F.col("q1"), F.lit(0.0)), F.lit(LEAST_SPREAD))
    up = F.greatest(F.least(F.coalesce(F.col("q3") - F.col("q2"), F.lit(0.0)), 2 * down), F.lit(LEAST_SPREAD))
    upper, lower = middle + high * up * wider, middle - low * down * wider
    inside = F.col("log_ppl").between(lower, upper)
    out = {"kept": ~F.col("base_failed") & inside, "perplexity": F.exp("log_ppl"), "lower_bound": F.exp(lower), "upper_bound": F.exp(upper)}
    names = [c + "_" if c in RESULTS else c for c in id_columns]
    return met.select(*(F.col(i).alias(n) for i, n in zip(ids, names, strict=False)), *(out.get(r, F.col(r)).alias(r) for r in RESULTS))

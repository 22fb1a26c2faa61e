"""BPE encoding and decoding (operator 9).

A word's symbols are merged by a segment tree over the ranks of adjacent pairs:
the root holds the lowest rank and, among equals, the leftmost place; a merge
changes at most three leaves, each updated in logarithmic time, until the root
holds no rank. A word of n symbols takes n log n steps however long it is.
Words that a part of the texts brings for the first time are merged together: the
trees of words of about one length are rows of one array, and each step takes the
roots of all rows whose words still have a pair. Longer words have a tree each.
Words are kept with their ids while a worker lives, up to a bound.

Texts are prepared as the tokenizer's file says: special tokens are taken out of
the raw text, the rest is put in NFC and lower case, cut into letters, single
digits, contractions and other signs, and white space is dropped; bytes are
written with the usual byte alphabet and a word's last symbol has an end mark.
Texts with characters outside the blocks where all Unicode versions agree are
prepared by the tokenizer file's own normaliser and splitter.

Null and empty text has no tokens. Rows that repeat are encoded each.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import column, in_parts, only, released, worker_cache

#: The splitting pattern of the tokenizer's file, and characters beyond which Unicode versions differ
#: (with the four separators that `re` takes for white space and the file's splitter does not).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
UNSURE = regex.compile(r"[^\u0000-\u001B\u0020-\u0557\u2000-\u2064\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3]")


def _plain_pattern() -> re.Pattern[str]:
    """The pattern with its classes written out, which `re` runs in half the time."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    classes = {c: "".join(f"{x[0]}-{x[-1]}" for x in regex.findall(rf"\p{{{c}}}+", every)) for c in "LN"}
    return re.compile(PATTERN.pattern.replace(r"[\p{L}]", f"[{classes['L']}]").replace(r"[\p{N}]", f"[{classes['N']}]").replace(r"\p{L}", classes["L"]).replace(r"\p{N}", classes["N"]))


PLAIN = _plain_pattern()
KEPT_WORDS = 150_000
NONE = 1 << 62
#: Words of up to so many bytes are merged together, so many at once; characters of texts that are looked up at once.
SHORT, TOGETHER, PART_CHARS = 64, 20_000, 1 << 20
NO_PAIR = np.int32((1 << 31) - 1)


def byte_alphabet() -> list[str]:
    """The printable character for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class SegmentTree:
    """Lowest value over the leaves; values are rank * size + place, so the root is leftmost among equals."""

    def __init__(self, values: list[int]):
        self.size = 1 << max(0, len(values) - 1).bit_length()
        self.tree = [NONE] * self.size + values + [NONE] * (self.size - len(values))
        for i in range(self.size - 1, 0, -1):
            a, b = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = a if a < b else b

    def set(self, at: int, value: int) -> None:
        i, tree = at + self.size, self.tree
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                break
            tree[i] = low


class SegmentTrees:
    """Segment trees of one size in the rows of an array, for words of 2 to ``size`` symbols; values as in SegmentTree."""

    def __init__(self, values: np.ndarray):
        self.rows, self.size = values.shape
        tree = np.empty((self.rows, 2 * self.size), np.int32)
        tree[:, self.size :] = values
        half = self.size
        while half > 1:
            np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2], out=tree[:, half // 2 : half])
            half //= 2
        self.tree = tree.ravel()

    def roots(self, rows: np.ndarray) -> np.ndarray:
        return self.tree[rows * (2 * self.size) + 1]

    def set(self, rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        """Leaves of rows; a leaf that is named twice has one value."""
        tree, base = self.tree, rows * (2 * self.size)
        i = at + self.size
        tree[base + i] = values
        for _ in range(self.size.bit_length() - 1):
            i >>= 1
            low = base + 2 * i
            tree[base + i] = np.minimum(tree[low], tree[low + 1])


class Pairs:
    """Ranks of many pairs of ids at once, from sorted arrays."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << 32 | b for a, b in ranks], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(NONE))
        self.ranks = np.append(np.array([r for r, _ in ranks.values()], np.int32)[order], np.int32(0))
        self.merged = np.zeros(max((r for r, _ in ranks.values()), default=0) + 1, np.int32)
        for rank, made in ranks.values():
            self.merged[rank] = made

    def values(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """rank * size + place, and more than any such value where there is no pair, as with an id below 0."""
        keys = left.astype(np.int64) << 32 | right
        found = np.searchsorted(self.keys, keys)
        return np.where(self.keys[found] == keys, self.ranks[found] * np.int32(size) + at, NO_PAIR)


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.path, self.library = path, None
        self.end = model["end_of_word_suffix"] or ""
        self.alphabet = byte_alphabet()
        self.inner = [vocab[ch] for ch in self.alphabet]
        self.last = [vocab[ch + self.end] for ch in self.alphabet]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.pairs, self.together = Pairs(self.ranks), max((r for r, _ in self.ranks.values()), default=0) < (1 << 31) // SHORT - 1
        self.inner_ids, self.last_ids = np.array(self.inner, np.int32), np.array(self.last, np.int32)

    def merge_together(self, raw: list[bytes], size: int) -> list[bytes]:
        """Ids of words of 2 to ``size`` bytes, a power of two, as little-endian unsigned 32-bit integers."""
        m, pairs = len(raw), self.pairs
        n = np.fromiter(map(len, raw), np.int64, m)
        row, ends = np.repeat(np.arange(m), n), np.cumsum(n)
        at = np.arange(len(row)) - np.repeat(ends - n, n)
        code = np.frombuffer(b"".join(raw), np.uint8)
        ids = np.full((m, size + 1), -1, np.int32)  # the last column stands for what is beyond either end
        ids[row, at] = self.inner_ids[code]
        ids[np.arange(m), n - 1] = self.last_ids[code[ends - 1]]
        places = np.arange(size, dtype=np.int32)
        trees = SegmentTrees(pairs.values(ids[:, :-1], ids[:, 1:], places, size))
        width = size + 1
        right = np.tile(np.append(places + 1, np.int32(size)), (m, 1)).ravel()
        left = np.tile(np.append(places - 1, np.int32(size)), (m, 1))
        left[:, 0] = size
        left, ids = left.ravel(), ids.ravel()
        rows = np.arange(m)
        while True:
            low = trees.roots(rows)
            on = low != NO_PAIR
            rows, low = rows[on], low[on]
            if not len(rows):
                break
            base, i = rows * width, low & (size - 1)
            j = right[base + i]
            k, before = right[base + j], left[base + i]
            ids[base + i], ids[base + j] = pairs.merged[low // size], -1
            right[base + i] = k
            left[base + k] = i
            own, first = pairs.values(ids[base + i], ids[base + k], i, size), before == size
            other = pairs.values(ids[base + before], ids[base + i], before, size)
            trees.set(np.concatenate([rows, rows, rows]), np.concatenate([j, i, np.where(first, i, before)]), np.concatenate([np.full(len(rows), NO_PAIR), own, np.where(first, own, other)]))
        ids = ids.reshape(m, width)
        left_over = ids >= 0
        out, ends = ids[left_over].astype("<u4").tobytes(), 4 * np.cumsum(left_over.sum(axis=1))
        return [out[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge_all(self, words: list[str]) -> list[tuple[str, bytes]]:
        """Words and their ids."""
        made, groups = [], {}
        for word in words:
            raw = word.encode()
            if 1 < len(raw) <= SHORT and self.together:
                groups.setdefault(1 << (len(raw) - 1).bit_length(), []).append((word, raw))
            else:
                made.append((word, array("I", self.merge(word)).tobytes()))
        for size, group in groups.items():
            for i in range(0, len(group), TOGETHER):
                names, raw = zip(*group[i : i + TOGETHER], strict=True)
                made += zip(names, self.merge_together(raw, size), strict=True)
        return made

    def merge(self, word: str) -> list[int]:
        """Ids of one word."""
        raw, ranks = word.encode(), self.ranks
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        if n == 1:
            return ids
        found = [ranks.get((ids[i], ids[i + 1])) for i in range(n - 1)]
        tree = SegmentTree([NONE if f is None else f[0] * n + i for i, f in enumerate(found)])
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))

        def rank(i: int) -> int:
            """Value of the pair that begins at i."""
            if i < 0 or right[i] >= n or (f := ranks.get((ids[i], ids[right[i]]))) is None:
                return NONE
            return f[0] * n + i

        while (low := tree.tree[1]) != NONE:
            i = low % n
            j = right[i]
            ids[i] = ranks[ids[i], ids[j]][1]
            ids[j] = -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            if j < n - 1:
                tree.set(j, NONE)
            if i < n - 1:
                tree.set(i, rank(i))
            if left[i] >= 0:
                tree.set(left[i], rank(left[i]))
        return [i for i in ids if i >= 0]

    def words(self, text: str) -> list[str]:
        if UNSURE.search(text) is None:
            return PLAIN.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if self.library is None:
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import Split
            from tokenizers import Regex

            self.library = Tokenizer.from_file(self.path).normalizer, Split(Regex(PATTERN.pattern), "removed", invert=True)
        return [w for w, _ in self.library[1].pre_tokenize_str(self.library[0].normalize_str(text))]

    def _cut(self, text: str) -> list[list[str] | bytes]:
        """Words, and ids of the special tokens between them."""
        if self.cut is None or not any(x in text for x in self.special):
            return [self.words(text)]
        return [array("I", [self.special[x]]).tobytes() if x in self.special else self.words(x) for x in self.cut.split(text) if x]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut, known = [self._cut(t) for t in texts], self.known
        fresh = set().union(*(x for parts in cut for x in parts if isinstance(x, list))).difference(known)
        known.update(self.merge_all(list(fresh)))
        out = [b"".join(x if isinstance(x, bytes) else b"".join(map(known.__getitem__, x)) for x in parts) for parts in cut]
        if len(known) > KEPT_WORDS:
            known.clear()
        else:
            for word in fresh:
                if len(word) > 64:
                    del known[word]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encoded(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text; texts are taken together up to a bound."""
        some, chars = [], 0
        for text in texts:
            some.append(text)
            chars += len(text)
            if chars >= PART_CHARS:
                yield from self.encode_all(some)
                some, chars = [], 0
        yield from self.encode_all(some)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by blanks, as the file names no decoder."""
        values = array("I")
        values.frombytes(ids)
        return " ".join(map(self.tokens.__getitem__, values))


_loaded: dict[str, Bpe] = worker_cache()


def loaded(path: str) -> Bpe:
    only(_loaded)
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, *, with_ids: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs: text and the columns to keep. Token ids (if wanted) with digests of the ids and of the decoded text for each row."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens bigint", *["token_ids array<int>"] * with_ids, "ids_sha256 string", "decoded_sha256 string"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in in_parts(batches):
            sizes, ids, decoded, parts, offsets = [], [], [], [], [0]
            for own in bpe.encoded(x or "" for x in column(batch, "text").to_pylist()):
                sizes.append(len(own) // 4)
                ids.append(hashlib.sha256(own).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(own).encode()).hexdigest())
                if with_ids:
                    parts.append(own)
                    offsets.append(offsets[-1] + len(own) // 4)
            cols, names = [column(batch, c) for c in keep] + [pa.array(sizes, pa.int64())], [*keep, "n_tokens"]
            if with_ids:
                joined = b"".join(parts)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), len(joined) // 4, [None, pa.py_buffer(joined)])))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[*names, "ids_sha256", "decoded_sha256"])

    return docs.select(*keep, "text").mapInArrow(run, schema)

"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs, for many words at once.

The leaves of a word's tree are its adjacent pairs, in order, each with the rank of its merge (a
large number if there is none). Every inner node holds the smaller of its children, the left one on
ties, so the root names the leftmost pair of lowest rank. A merge changes three leaves: the merged
pair goes, its neighbours get new ranks, and each change is carried up in log2(length) steps. Words of
like length form one array and take their merges side by side in numpy.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int64(1) << 60
#: Chunks in each of the two generations that a worker keeps encodings of; older ones are encoded again, results stay the same.
CACHE = 300_000
#: Leaves of one array of trees at most (memory bound); longer words form arrays of one word.
LEAVES = 1 << 20
#: Marks behind a word that make one word of their own.
MARKS = ".,;:!?"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Model:
    """Vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.into = keys[order], np.arange(len(keys))[order], into[order]

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of the merge of each pair; ids below 0 stand for no symbol."""
        key = np.where((a < 0) | (b < 0), np.int64(-1), a << 32 | b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.into[at], -1)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each non-empty word."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(max(len(w) - 1, 1).bit_length(), []).append(i)
        for bits, members in groups.items():
            step = max(1, LEAVES >> bits)
            for k in range(0, len(members), step):
                self._merge([words[i] for i in members[k : k + step]], members[k : k + step], out)
        return out

    def _merge(self, words: list[bytes], at: list[int], out: list[np.ndarray]) -> None:
        sizes = np.array([len(w) for w in words])
        n, width = len(words), int(sizes.max())
        leaves = 1 << max(width - 1, 1).bit_length()
        sym = np.full((n, width + 1), -1, np.int64)
        filled = np.arange(width) < sizes[:, None]
        sym[:, :width][filled] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        rows = np.arange(n)
        sym[rows, sizes - 1] = self.last[np.frombuffer(bytes(w[-1] for w in words), np.uint8)]
        nxt = np.tile(np.arange(1, width + 2), (n, 1))
        prev = np.tile(np.arange(-1, width), (n, 1))
        # tree values: rank of the best pair and its position in one number, so the smaller one is leftmost
        shift = np.int64(leaves.bit_length())
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        into = np.full((n, leaves), -1, np.int64)
        rank, prod = self.pair(sym[:, : width - 1], sym[:, 1:width])
        if width > 1:
            tree[:, leaves : leaves + width - 1] = np.where(rank < NONE, (rank << shift) | np.arange(width - 1), NONE)
            into[:, : width - 1] = prod
        half = leaves >> 1
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half >>= 1
        live = rows[tree[:, 1] < NONE]
        mask = (np.int64(1) << shift) - 1
        while len(live):
            i = tree[live, 1] & mask
            j = nxt[live, i]
            after = nxt[live, j]
            sym[live, i] = into[live, i]
            sym[live, j] = -1
            nxt[live, i] = after
            inside = after < width
            prev[live[inside], after[inside]] = i[inside]
            before = prev[live, i]
            left = np.where(before >= 0, before, width)
            rank, prod = self.pair(sym[live, i], sym[live, np.minimum(after, width)])
            into[live, i] = prod
            r0, p0 = self.pair(sym[live, left], sym[live, i])
            changed = [(i, np.where(rank < NONE, (rank << shift) | i, NONE)), (j, np.full(len(live), NONE)), (before, np.where(r0 < NONE, (r0 << shift) | np.maximum(before, 0), NONE))]
            has = before >= 0
            into[live[has], before[has]] = p0[has]
            for leaf, value in changed:
                ok = (leaf >= 0) & (leaf < leaves)
                r, node = live[ok], leaf[ok] + leaves
                tree[r, node] = value[ok]
                for _ in range(leaves.bit_length() - 1):
                    node = node >> 1
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            live = live[tree[live, 1] < NONE]
        for row, i in enumerate(at):
            s = sym[row]
            out[i] = s[s >= 0]


class Codec:
    """Encodes whole texts as the tokenizers library does with the file, and decodes ids, by the trees above.

    Normalisation and splitting into words are the file's own; merges and decoding are ours. A text's
    encoding is the concatenation of those of its chunks between ASCII white space, so chunks are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model, self.parts = Model(path), Tokenizer.from_file(path)
        self.letters = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t.content: i for i, t in self.parts.get_added_tokens_decoder().items()}
        self.decimal = {i: str(i) for i in self.model.tokens}
        self.known: dict[bytes, tuple[int, str, str]] = {}
        self.old: dict[bytes, tuple[int, str, str]] = {}
        self.limit = CACHE
        self.blank = False  # a chunk without ids was met
        self.short = self._short()

    def _library_words(self, text: str) -> list[bytes]:
        """Words as the file's own normaliser and pre-tokenizer make them."""
        if self.parts.normalizer:
            text = self.parts.normalizer.normalize_str(text)
        return [bytes(self.letters[c] for c in w) for w, _ in self.parts.pre_tokenizer.pre_tokenize_str(text)]

    def _short(self) -> bool:
        """Whether the short way holds for this file: letters in lower case are one word and the marks behind them another."""
        letters = [chr(c) for c in range(0x250) if chr(c).isalpha() and unicodedata.is_normalized("NFC", chr(c)) and chr(c).lower().isalpha()]
        probes = [(f"{c}a{c}", m) for c in letters for m in ("", ".")] + [("Ab", a + b) for a in MARKS for b in MARKS]
        return all(self._library_words(x + m) == [x.lower().encode(), *([m.encode()] if m else [])] for x, m in probes)

    def _words(self, chunk: str) -> list[bytes | int]:
        """The words of a chunk as bytes, special tokens as their ids."""
        body = chunk.rstrip(MARKS)
        if self.short and body.isalpha() and (body.isascii() or max(body) < "ɐ" and unicodedata.is_normalized("NFC", body)) and (low := body.lower()).isalpha():
            return [low.encode(), chunk[len(body) :].encode()] if len(body) < len(chunk) else [low.encode()]
        for content, i in self.special.items():
            before, found, after = chunk.partition(content)
            if found:
                first = min(self.special, key=lambda c: (p if (p := chunk.find(c)) >= 0 else len(chunk) + 1))
                before, _, after = chunk.partition(first)
                return [*self._words(before), self.special[first], *self._words(after)]
        if not chunk:
            return []
        return self._library_words(chunk)

    def told(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join([self.decimal[i] for i in ids]), " ".join([self.model.tokens[i] for i in ids])

    def split(self, chunks: list[bytes]) -> tuple[list[tuple[bytes, bytes, bytes]], list[tuple[bytes, list[bytes | int]]], set[bytes]]:
        """Chunks of ASCII letters with marks behind them as (chunk, word, word or b''); the others as (chunk, words); all their words.

        Letters and the marks behind them are two words; everything else takes the file's own normaliser and pre-tokenizer.
        """
        bodies = [c.rstrip(MARKS.encode()) for c in chunks]
        bodies = [b.lower() if self.short and b.isalpha() else None for b in bodies]
        plain = [(c, b, c[len(b) :]) for c, b in zip(chunks, bodies, strict=True) if b is not None]
        other = [(c, self._words(c.decode("utf-8"))) for c, b in zip(chunks, bodies, strict=True) if b is None]
        words = {x for _, b, t in plain for x in (b, t)}
        words.update(w for _, s in other for w in s if isinstance(w, bytes))
        words.discard(b"")
        return plain, other, words

    def learn(self, chunks: set[bytes]) -> None:
        """Keeps number, decimal ids and decoded tokens of each chunk (UTF-8 without ASCII white space) not known yet."""
        if len(self.known) > self.limit:
            self.old, self.known = self.known, {}
        known = self.known
        missing = chunks.difference(known)
        again = missing.intersection(self.old)
        known.update((c, self.old[c]) for c in again)
        new = list(missing - again)
        plain, other, words = self.split(new)
        met = {w: known[w] for w in words.intersection(known) if w.isalpha()}
        todo = list(words.difference(met))
        found: dict[bytes | int, tuple[int, str, str]] = dict(zip(todo, map(self.told, (x.tolist() for x in self.model.encode(todo))), strict=True))
        found |= met
        found |= {i: self.told([i]) for i in self.special.values()}
        for c, b, t in plain:
            if t:
                x, y = found[b], found[t]
                known[c] = x[0] + y[0], f"{x[1]} {y[1]}", f"{x[2]} {y[2]}"
            else:
                known[c] = found[b]
        for c, s in other:
            parts = [found[w] for w in s]
            self.blank |= not parts
            known[c] = parts[0] if len(parts) == 1 else (sum(x[0] for x in parts), " ".join([x[1] for x in parts]), " ".join([x[2] for x in parts]))

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of ids, the ids in decimal joined by one space, the decoded text."""
        split = [t.encode("utf-8").split() if t else [] for t in texts]
        rows: list[list[tuple[int, str, str]] | None] = []
        for s in split:
            try:
                rows.append(list(map(self.known.__getitem__, s)))
            except KeyError:  # a chunk that this worker hasn't met
                rows.append(None)
        self.learn(set().union(*(s for s, row in zip(split, rows, strict=True) if row is None)))
        for s, row in zip(split, rows, strict=True):
            got = list(map(self.known.__getitem__, s)) if row is None else row
            if self.blank:
                got = [x for x in got if x[0]]
            sizes, ids, tokens = zip(*got, strict=True) if got else ((), (), ())
            yield sum(sizes), " ".join(ids), " ".join(tokens)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), chunks: int = CACHE, release: bool = False) -> DataFrame:
    """The columns `keep`, then n_tokens, ids (decimal, joined by one space) and decoded for every row's whole text.

    Null and empty texts have no ids and decode to ''. Rows are independent: no shuffle, repeated rows
    and null keys come out as they went in, and only `keep` and text are read; an empty table gives an empty one. Very long texts take the time of their words; a single word of millions
    of bytes takes one round for each merge. The vocabulary file is
    opened by each worker; it must lie at `path` on every machine. chunks: how many encodings a worker keeps (memory against time);
    release: after a task only the younger ones stay, for workers that go on to other work. Neither changes a result.
    """
    path = path or default_vocabulary()
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        own.limit = chunks
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                rows = list(own.texts(part.column(len(keep)).to_pylist()))
                arrays = [*part.columns[: len(keep)], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_tokens", "ids", "decoded"])
        if release:
            own.old = {}

    from pyspark.sql import types as T

    schema = T.StructType([*(T.StructField(f"_k{i}", f.dataType) for i, f in enumerate(fields)), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())])
    out = docs.select(*keep, "text").mapInArrow(lambda it: (pa.RecordBatch.from_arrays(b.columns, names=schema.names) for b in run(it)), schema)
    return out.toDF(*keep, "n_tokens", "ids", "decoded")


def digests(encoded: DataFrame) -> DataFrame:
    """SHA-256 of the ids and of the decoded text beside the counts."""
    return encoded.select(*[c for c in encoded.columns if c not in ("ids", "decoded")], F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

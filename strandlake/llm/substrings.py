"""Removal of byte strings that occur more than once anywhere, found with suffix arrays.

A suffix array over the whole corpus would be one sequential structure, so the suffixes are first dealt to tasks such that equal
strings of LENGTH bytes meet: the anchor of such a string is its gram of GRAM bytes of least hash (the leftmost), every string has one anchor, and
equal strings have equal anchors at equal places. Anchors whose gram occurs once are done. Around the others stands the stretch that
holds the strings of that anchor. Equal stretches are repeats as a whole; one of each goes on, if its gram has stretches of other forms, to
the task of the gram's hash. A gram with more than HOT stretches is a passage that very many texts share: its strings get a second anchor, for
which the grams of that passage come last, so what lies across the passage's ends is dealt out by what stands beside it. Each task builds the
suffix array of its distinct stretches in two stages: suffixes smaller than their successors are sorted directly, the rest is induced from them by a scan of the buckets
of first symbols. Neighbours in the array with a common prefix of LENGTH bytes are repeats.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, mix64, partitions, salted_join

LENGTH, GRAM = 400, 160
#: Texts are scanned for anchors in pieces of so many bytes that overlap by LENGTH - 1 (memory bound).
PIECE = 1 << 22
#: A suffix array takes further grams until it has so many bytes (memory bound).
ARRAY = 1 << 19
#: Distinct stretches of one gram from which it gets second anchors.
HOT = 1000
_BASE = U64(0xD1342543DE82EF95)
_INVERSE = U64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=U64))
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, b)])) for b in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums and the factors that bring a difference of them to its position."""
    up, down = powers(len(raw) + 1)
    return np.concatenate([[U64(0)], np.cumsum(_BYTE[raw] * up[: len(raw)])]), down


def gram_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` bytes from each position on."""
    total, down = prefix_sums(raw)
    return mix64((total[length:] - total[:-length]) * down[: len(raw) - length + 1])


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM, late: np.ndarray | None = None) -> list[np.ndarray]:
    """Gram hash, first and last string start and hash of the stretch for each anchor, in order; together the ranges hold every start once.

    late: sorted hashes of grams that come after all others.
    """
    out: list[list[np.ndarray]] = [[], [], [], []]
    for at in range(0, max(len(raw) - length + 1, 0), PIECE):
        part = raw[at : at + PIECE + length - 1]
        total, down = prefix_sums(part)
        g = mix64((total[gram:] - total[:-gram]) * down[: len(part) - gram + 1])
        window = length - gram + 1
        low = (g & U64((1 << 63) - (1 << 23))) | np.arange(len(g), dtype=U64)
        if late is not None and len(late):
            low[late[np.minimum(np.searchsorted(late, g), len(late) - 1)] == g] |= U64(1 << 63)
        span = 1
        while span * 2 <= window:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < window:
            low = np.minimum(low[: len(low) - (window - span)], low[window - span :])
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        last = np.append(first[1:], len(low)) - 1
        form = mix64((total[last + length] - total[first]) * down[first] + (last - first).astype(U64))
        for o, x in zip(out, (g[(low[first] & U64((1 << 23) - 1)).astype(np.int64)], first + at, last + at, form), strict=True):
            o.append(x)
    return [np.concatenate([*o, np.empty(0, t)]) for o, t in zip(out, (U64, np.int64, np.int64, U64), strict=True)]


def two_stage(sym: np.ndarray, depth: int, same: np.ndarray) -> np.ndarray:
    """Suffix array of symbols 0 to 256, exact to `depth` symbols.

    same: for each position a number that equal strings of `depth` symbols share; such suffixes are sorted as one.
    """
    n = len(sym)
    padded = np.concatenate([sym, np.zeros(depth + 8, np.int64)])
    word = np.zeros(n + depth, np.int64)
    for k in range(7):
        word = word << 9 | padded[k : k + n + depth]
    # Type B: smaller than the successor. A run of equal symbols has the type of its end; the last suffix is of type A.
    step = np.sign(np.diff(sym, append=-1))
    nxt = np.where(step != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    small = step[np.minimum(nxt, n - 1)] > 0
    b = np.flatnonzero(small)
    ids, rep = np.unique(same[b], return_index=True)
    lead = b[rep]
    group = np.zeros(len(lead), np.int64)
    order = np.arange(len(lead))
    active = order
    for off in range(0, depth if len(lead) else 0, 7):
        key = word[np.minimum(lead[active] + off, n + depth - 1)]
        sub = np.lexsort((key, group[active]))
        active = active[sub]
        key, grp = key[sub], group[active]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (grp[1:] != grp[:-1])])
        # a group's number is the rank of its first element, so it only grows within the group
        start_of_grp = np.concatenate([[True], grp[1:] != grp[:-1]])
        at = np.arange(len(active))
        inside = at - np.maximum.accumulate(np.where(start_of_grp, at, 0))
        head = np.maximum.accumulate(np.where(new, at, 0))
        group[active] = grp + inside[head]
        single = new & np.append(new[1:], True)
        active = active[~single]
        if not len(active):
            break
    by_rank = np.argsort(group, kind="stable")
    place = np.empty(len(lead), np.int64)
    place[by_rank] = np.arange(len(lead))
    sorted_b = b[np.argsort(place[np.searchsorted(ids, same[b])], kind="stable")]
    # Second stage: buckets by first symbol, type A in front; every suffix found places the type A suffix before it.
    counts = np.bincount(sym, minlength=257)
    b_of = np.searchsorted(sym[sorted_b], np.arange(258))
    pending: list[list[np.ndarray]] = [[] for _ in range(257)]
    pending[int(sym[-1])].append(np.array([n - 1]))
    out = []

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        before = found[found > 0] - 1
        before = before[~small[before]]
        first = sym[before]
        again = before[first == c]
        later = first > c
        before, first = before[later], first[later]
        if len(before):
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for part, f in zip(np.split(before, cuts[1:]), first[cuts], strict=True):
                pending[f].append(part)
        return again

    for c in np.flatnonzero(counts):
        queue = pending[c]
        while queue:
            found = np.concatenate(queue)
            out.append(found)
            again = induce(found, c)
            queue = [again] if len(again) else []
        found = sorted_b[b_of[c] : b_of[c + 1]]
        out.append(found)
        induce(found, c)
    return np.concatenate(out)


def repeats(stretches: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of some distinct byte strings: which of its strings of `length` bytes also start elsewhere in them."""
    sizes = np.array([len(s) for s in stretches])
    raw = np.frombuffer(b"\0".join(stretches), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    sym = raw.astype(np.int64) + 1
    sym[(starts + sizes)[:-1]] = 0
    n = len(sym)
    valid = np.zeros(n, bool)
    for s, k in zip(starts, sizes, strict=True):
        valid[s : s + k - length + 1] = True
    same = np.arange(n, dtype=np.int64)
    at = np.flatnonzero(valid)
    _, inverse = np.unique(gram_hashes(raw, length)[at], return_inverse=True)
    same[at] = n + inverse
    order = two_stage(sym, length, same)
    order = order[valid[order]]
    flagged = np.zeros(n, bool)
    close = np.flatnonzero(same[order[1:]] == same[order[:-1]]) if len(order) > 1 else np.empty(0, np.int64)
    spread = np.arange(length)
    for k in range(0, len(close), 1 << 14):  # common prefixes of neighbours, by bytes
        a, b = order[close[k : k + (1 << 14)]], order[close[k : k + (1 << 14)] + 1]
        equal = (raw[a[:, None] + spread] == raw[b[:, None] + spread]).all(axis=1)
        flagged[a[equal]] = True
        flagged[b[equal]] = True
    return [flagged[s : s + max(k - length + 1, 0)] for s, k in zip(starts, sizes, strict=True)]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


RANGES = pa.schema([("cls", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def judge(length: int):
    """Task over the stretches of some grams: ranges of string starts that also occur elsewhere, for stretches of one owner."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("gram", "cls", "first", "single", "stretch")), strict=True), key=lambda r: r[0])
        count = Counter(r[0] for r in rows)
        rows = [r for r in rows if count[r[0]] > 1]
        found: list[tuple[int, int, int]] = []
        begin, held = 0, 0
        for k, row in enumerate(rows):
            held += len(row[4])
            # the stretches of one gram stay together; those of others don't hold equal strings, so a shared array only saves calls
            if k + 1 == len(rows) or held > ARRAY and rows[k + 1][0] != row[0]:
                part = rows[begin : k + 1]
                for (_, cls, first, single, _), flags in zip(part, repeats([r[4] for r in part], length), strict=True):
                    if single:
                        found += [(cls, first + int(a), first + int(b)) for a, b in zip(*runs(flags), strict=True)]
                begin, held = k + 1, 0
        return pa.table([pa.array(c) for c in zip(*found, strict=True)], schema=RANGES) if found else RANGES.empty_table()

    return run


def second_anchors(length: int, gram: int):
    """Task that cuts the stretches of hot grams by second anchors, with the grams of the passage last."""
    names = ["gram", "cls", "first", "last", "form", "stretch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late: dict[int, np.ndarray] = {}
        for batch in batches:
            out: list[tuple] = []
            for hot, cls, first, stretch, passage in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hot not in late:
                    late = {hot: np.unique(gram_hashes(np.frombuffer(passage, np.uint8), gram))}
                raw = np.frombuffer(stretch, np.uint8)
                for g, a, b, form in zip(*(x.tolist() for x in anchors(raw, length, gram, late[hot])), strict=True):
                    key = int(mix64(np.array([g ^ (hot & (1 << 64) - 1)], U64)).view(np.int64)[0])
                    out.append((key, cls, first + a, first + b, form - (1 << 63), stretch[a : b + length]))
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kinds[k]) for k in range(6)], names=names)

    return run


def find(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(texts, ranges): texts has doc_id, cls, copies and text for every row; ranges has cls, first, last byte start of repeated strings.

    cls stands for a distinct text. Texts of which there are copies are repeats as a whole and enter the search once.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "substrings")
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("cls", F.xxhash64(F.md5("text"), F.octet_length("text")))
    gram = min(GRAM, length)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                if len(raw) >= length:
                    g, first, last, form = anchors(raw, length, gram)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), cls)), pa.array(g.view(np.int64)), pa.array(form.view(np.int64)), pa.array(first), pa.array(last)], names=["cls", "gram", "form", "first", "last"])

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in it:
            held.append(b)
            size += len(b)
            if size > 50_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    found = scratch.save(rows.select("cls", "text").mapInArrow(lambda it: packed(scan(it)), "cls long, gram long, form long, first long, last long"))
    place = F.xxhash64("cls", "first")
    often = found.groupBy("gram").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.min("form").alias("f1"), F.max("form").alias("f2"), F.count("*").alias("n")).where("p <> q").select("gram", (F.col("f1") != F.col("f2")).alias("several"), "n")
    often = scratch.save(often)
    shared = scratch.save(salted_join(found, often, ["gram"]))
    scratch.drop(found, often)
    forms = shared.groupBy("gram", "form").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.min(F.struct("cls", "first", "last")).alias("one"), F.first("several").alias("several"), F.count("*").alias("n"))
    forms = scratch.save(forms.select("gram", "form", "one", "several", "n", (F.col("p") == F.col("q")).alias("single")))
    whole = salted_join(shared, forms.where("not single").select("gram", "form", "n"), ["gram", "form"]).select("cls", "first", "last")
    todo = forms.where("several").select("gram", "single", "one.*")
    wanted = todo.groupBy("cls").agg(F.collect_list(F.struct("first", "last", "gram", "single")).alias("at")).withColumnRenamed("cls", "cls2")
    classes = rows.select("cls", "doc_id").groupBy("cls").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies"))
    classes = scratch.save(classes)
    heads = classes.select(F.col("cls").alias("cls2"), "head")
    wanted = scratch.save(wanted.join(heads, "cls2"))
    texts = rows.join(wanted, (F.col("cls") == F.col("cls2")) & F.col("doc_id").eqNullSafe(F.col("head"))).select("cls", "text", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cls, text, at = (c[k].as_py() for c in batch.columns)
                raw = text.encode()
                for j in range(0, len(at), 2000):
                    part = at[j : j + 2000]
                    yield pa.RecordBatch.from_arrays([pa.array([a["gram"] for a in part], pa.int64()), pa.array([cls] * len(part), pa.int64()), pa.array([a["first"] for a in part], pa.int64()), pa.array([a["single"] for a in part], pa.bool_()), pa.array([raw[a["first"] : a["last"] + length] for a in part], pa.binary())], names=["gram", "cls", "first", "single", "stretch"])

    stretches = texts.mapInArrow(cut, "gram long, cls long, first long, single boolean, stretch binary")
    stretches = scratch.save(stretches)
    many = stretches.groupBy("gram").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("gram")
    hot = scratch.save(stretches.join(many, "gram", "left_semi").groupBy("gram").agg(F.min("stretch").alias("passage")))
    again = scratch.save(stretches.join(hot, "gram").select("gram", "cls", "first", "stretch", "passage").mapInArrow(second_anchors(length, gram), "gram long, cls long, first long, last long, form long, stretch binary"))
    forms = again.groupBy("gram", "form").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.min(F.struct("cls", "first", "stretch")).alias("one"))
    forms = scratch.save(forms.select("gram", "form", "one.*", (F.col("p") == F.col("q")).alias("single")))
    whole = whole.unionAll(again.join(forms.where("not single").select("gram", "form"), ["gram", "form"]).select("cls", "first", "last"))
    stretches = stretches.join(hot.select("gram"), "gram", "left_anti").unionByName(forms.drop("form"))
    bucket = F.pmod(F.col("gram"), F.lit(4 * partitions(spark)))
    ranges = stretches.groupBy(bucket.alias("bucket")).applyInArrow(judge(length), "cls long, first long, last long")
    listed = scratch.save(ranges.unionAll(whole).groupBy("cls").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("ranges")))
    known = classes.select(F.col("cls").alias("cls2"), "copies").join(listed.withColumnRenamed("cls", "cls3"), F.col("cls2") == F.col("cls3"), "left").drop("cls3")
    return rows.join(known, F.col("cls") == F.col("cls2")).select("doc_id", "cls", "copies", "text", "ranges"), listed


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row: maximal removed byte ranges [from, to) and the remaining bytes.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same text or another; strings
    are judged on the input and never cross texts. Null texts count as empty; texts shorter than `length` stay as they are. Of equal strings none is
    spared, so ties don't arise; equal texts of that length go whole, repeated rows among them. Texts are read whole. An empty table gives an
    empty one; other columns are not read. A null doc_id keeps its row.
    """
    texts, _ = find(docs, length)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for copies, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("copies", "text", "ranges")), strict=True):
                raw = text.encode()
                spans: list[list[int]] = []
                if copies > 1 and len(raw) >= length:
                    spans = [[0, len(raw)]]
                else:
                    for r in ranges or []:
                        if spans and r["first"] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], r["last"] + length)
                        else:
                            spans.append([r["first"], r["last"] + length])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                out.append((len(raw), spans, b"".join([*kept, raw[at:]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.list_(pa.int64()))), pa.array([o[2] for o in out], pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return texts.select("doc_id", "copies", "text", "ranges").mapInArrow(strip, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, spans array<array<long>>, kept binary")


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and SHA-256 of the remaining bytes for every row."""
    done = dedup(docs, length)
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

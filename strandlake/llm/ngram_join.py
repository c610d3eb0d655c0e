"""Similarity join of documents on word n-gram sets: a blocked sparse product of the document by n-gram incidence matrix.

A document's set holds its distinct shingles of n words; documents of equal sets are one class. Two classes link when
100 |A and B| >= percent |A or B|. The product is made in blocks and never as pairs of all that share a column:

1. Column blocks. Tasks cut their classes' shingles by hash into column blocks; a block finds which columns hold more than one class
   and, roughly, how many (its power of two). An entry alone in its column adds to no overlap, so a class with fewer than percent % of
   its set in shared columns can't link with anything and is done. The shared columns go back to the class's row block.
2. Prefixes. With the columns in one order (rare first), linked classes share one of the first |A| - ceil(percent/100 |A|) + 1 entries of
   each. Overlaps are accumulated over these entries only, and a pair goes on if that count plus all that is left reaches the overlap its
   sizes ask for.
3. Every class is first tried with the one class of least key it shares most entries with. What links that way is one component, and only columns
   that hold more than one component are multiplied out, across components. The overlap of what remains is counted exactly.
4. Columns with more than HEAVY classes give no pairs. Classes that they connect form a cluster, cut into size classes (only neighbouring ones can
   link) and blocks; a task multiplies two blocks of rows column block by column block and gives a spanning forest of the links.

A column that fills a hundredth of a row block is hot: its entries stay in the row block and only its name goes to the column block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, components, forest, mix64, partitions, salted_join, shingle_hashes, word_hashes

#: Entries and classes of a row block (memory bound), classes of a row block from which a column is hot, and its power of two.
ENTRIES, CLASSES, HOT, HOT_POWER = 1 << 20, 60_000, 32, 31
#: Classes of a column from which no pairs are made, rows of a block of the product, columns multiplied at once.
HEAVY, ROWS, COLUMNS = 32, 512, 4096


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles (A-Z lower-cased); empty without words."""
    return np.unique(shingle_hashes(word_hashes(text), n))


def narrow(h: np.ndarray, blocks: int) -> bytes:
    """48 bits of each hash besides its column block, of h div blocks; with the block, one of 256 or more, 56 bits are told apart."""
    return np.ascontiguousarray((h // U64(blocks)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def widen(raw: bytes | None, block: np.ndarray | int, blocks: int) -> np.ndarray:
    if not raw:
        return np.empty(0, U64)
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(U64, copy=False) * U64(blocks) + np.asarray(block).astype(U64)


def column_name(power: np.ndarray, h: np.ndarray) -> np.ndarray:
    """63 bits that order columns by how many classes they hold (a power of two), then by a hash of 58 bits."""
    return power.astype(U64) << U64(58) | mix64(h) >> U64(6)


ROW = pa.schema([
    ("batch", pa.int64()), ("block", pa.int32()), ("idx", pa.binary()), ("cnt", pa.binary()), ("low", pa.binary()), ("hot", pa.binary()),
    ("hot_low", pa.binary()), ("hot_block", pa.binary()), ("hot_cnt", pa.binary()), ("hot_idx", pa.binary()),
    ("keys", pa.binary()), ("sizes", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_idx", pa.binary()),
])
ROW_DDL = "batch long, block int, idx binary, cnt binary, low binary, hot binary, hot_low binary, hot_block binary, hot_cnt binary, hot_idx binary, keys binary, sizes binary, doc_ids array<long>, doc_idx binary"
BACK = pa.schema([("batch", pa.int64()), ("idx", pa.binary()), ("col", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_idx", pa.binary())])
BACK_DDL = "batch long, idx binary, col binary, keys binary, sizes binary, doc_ids array<long>, doc_idx binary"
FOUND = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("rest", pa.int64()), ("cols", pa.binary())])
FOUND_DDL = "doc_id long, key long, n long, prefix array<long>, rest long, cols binary"


def row_blocks(n: int, blocks: int):
    """Task that turns (doc_id, text) into row blocks cut by column block."""

    def emit(batch: int, docs: list[tuple[int | None, int]], sets: list[np.ndarray], keys: list[int]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s) for s in sets], np.int64)
        h = np.concatenate([*sets, np.empty(0, U64)])
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        runs = np.diff(np.append(starts, len(h)))
        hot_run = runs >= HOT
        hot_entry = np.repeat(hot_run, runs)
        hot_h, hot_cnt = h[starts[hot_run]], runs[hot_run]
        home = batch % blocks
        first = {
            "keys": np.array(keys, np.int64).tobytes(), "sizes": sizes.astype("<i8").tobytes(), "doc_ids": [d for d, _ in docs], "doc_idx": np.array([i for _, i in docs], "<u2").tobytes(),
            "hot_low": narrow(hot_h, blocks), "hot_block": (hot_h % U64(blocks)).astype("<u4").tobytes(), "hot_cnt": hot_cnt.astype("<u4").tobytes(), "hot_idx": owner[hot_entry].astype("<u2").tobytes(),
        }
        h, owner = h[~hot_entry], owner[~hot_entry]
        block = (h % U64(blocks)).astype(np.int64)
        order = np.lexsort((owner, block))
        h, owner, block = h[order], owner[order], block[order]
        cut = np.searchsorted(block, np.arange(blocks + 1))
        hot_of = (hot_h % U64(blocks)).astype(np.int64)
        for b in range(blocks):
            own, low = owner[cut[b] : cut[b + 1]], h[cut[b] : cut[b + 1]]
            mine = hot_h[hot_of == b]
            if not len(own) and not len(mine) and b != home:
                continue
            at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
            row = {"batch": batch, "block": b, "idx": own[at].astype("<u2").tobytes(), "cnt": np.diff(np.append(at, len(own))).astype("<u4").tobytes(), "low": narrow(low, blocks), "hot": narrow(mine, blocks)}
            yield pa.RecordBatch.from_pylist([row | (first if b == home else {})], schema=ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        docs: list[tuple[int | None, int]] = []
        sets: list[np.ndarray] = []
        at: dict[int, int] = {}
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = ngram_set(text, n)
                key = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                if key not in at:
                    at[key] = len(sets)
                    sets.append(s)
                    held += len(s)
                docs.append((doc_id, at[key]))
                if held >= ENTRIES or len(sets) >= CLASSES or len(docs) >= 10 * CLASSES:
                    yield from emit(part << 32 | seq, docs, sets, list(at))
                    docs, sets, at, held, seq = [], [], {}, 0, seq + 1
        if docs:
            yield from emit(part << 32 | seq, docs, sets, list(at))

    return run


def column_block(table: pa.Table, blocks: int) -> pa.Table:
    """Of one column block: the entries in shared columns, by row block."""
    rows = table.to_pylist()
    block = rows[0]["block"]
    # a class is known by its row block and index; the same class in two row blocks counts twice and only costs work
    lows, owners = [], []
    kind = np.uint32 if len(rows) < 1 << 16 else np.uint64
    for k, r in enumerate(rows):
        idx, cnt = np.frombuffer(r["idx"], "<u2").astype(kind), np.frombuffer(r["cnt"], "<u4")
        lows.append(widen(r.pop("low"), block, blocks))
        owners.append(np.repeat(kind(k << 16) | idx, cnt))
    hot = np.unique(np.concatenate([widen(r["hot"], block, blocks) for r in rows]))
    low = np.concatenate(lows)
    lows.clear()
    order = np.argsort(low, kind="stable").astype(np.uint32 if len(low) < 1 << 32 else np.int64)
    low = low[order]
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.empty(0, np.int64)
    runs = np.diff(np.append(starts, len(low)))
    keep = runs > 1
    if len(hot):
        at = np.minimum(np.searchsorted(hot, low[starts]), len(hot) - 1)
        is_hot = hot[at] == low[starts]
        keep |= is_hot
    power = np.minimum(np.frexp(runs[keep].astype(np.float32))[1] - 1, HOT_POWER - 1)
    if len(hot):
        power[is_hot[keep]] = HOT_POWER
    shared = np.repeat(keep, runs)
    names = column_name(np.repeat(power, runs[keep]), low[shared])
    order = order[shared]
    del low, shared
    by_row = np.argsort(order)
    names = names[by_row]
    owner = np.concatenate(owners)[order[by_row]]
    owners.clear()
    out = []
    cut = np.searchsorted(owner >> kind(16), np.arange(len(rows) + 1).astype(kind))
    for k, r in enumerate(rows):
        idx, col = (owner[cut[k] : cut[k + 1]] & kind(0xFFFF)).astype(np.int64), names[cut[k] : cut[k + 1]]
        if r["keys"] is not None:
            own = np.frombuffer(r["hot_idx"], "<u2").astype(np.int64)
            wide = column_name(np.full(len(r["hot_low"]) // 6, HOT_POWER), widen(r["hot_low"], np.frombuffer(r["hot_block"], "<u4"), blocks))
            idx, col = np.concatenate([idx, own]), np.concatenate([col, np.repeat(wide, np.frombuffer(r["hot_cnt"], "<u4"))])
        if len(idx) or r["keys"] is not None:
            out.append({"batch": r["batch"], "idx": idx.astype("<u2").tobytes(), "col": col.astype("<u8").tobytes(), "keys": r["keys"], "sizes": r["sizes"], "doc_ids": r["doc_ids"], "doc_idx": r["doc_idx"]})
    return pa.Table.from_pylist(out, schema=BACK)


def row_block(percent: int):
    """Of one row block: all its documents with class and size, and the classes that may link, with their shared columns and prefix."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["keys"] is not None)
        keys, sizes = np.frombuffer(head["keys"], np.int64), np.frombuffer(head["sizes"], "<i8")
        idx = np.concatenate([np.frombuffer(r["idx"], "<u2") for r in rows]).astype(np.int64)
        col = np.concatenate([np.frombuffer(r["col"], "<u8") for r in rows])
        order = np.lexsort((col, idx))
        idx, col = idx[order], col[order]
        cut = np.searchsorted(idx, np.arange(len(keys) + 1))
        out = []
        doc_idx = np.frombuffer(head["doc_idx"], "<u2")
        docs = pa.table({"doc_id": pa.array(head["doc_ids"], pa.int64()), "key": pa.array(keys[doc_idx]), "n": pa.array(sizes[doc_idx])})
        for k in np.flatnonzero((np.diff(cut) * 100 >= percent * sizes) & (sizes > 0)):
            cols, n = col[cut[k] : cut[k + 1]], int(sizes[k])
            first = n - -(-percent * n // 100) + 1  # prefix length, entries alone in their column included
            shared = first - (n - len(cols))
            if shared > 0:
                out.append({"doc_id": None, "key": int(keys[k]), "n": n, "prefix": cols[:shared].astype(np.int64), "rest": n - first, "cols": cols.tobytes()})
        found = pa.Table.from_pylist(out, schema=FOUND)
        empty = {f.name: pa.nulls(len(docs), f.type) for f in FOUND if f.name not in docs.column_names}
        return pa.concat_tables([pa.table({f.name: docs[f.name] if f.name in docs.column_names else empty[f.name] for f in FOUND}, schema=FOUND), found])

    return run


def fits(n1: Column, n2: Column, percent: int) -> Column:
    return (100 * F.least(n1, n2)) >= percent * F.greatest(n1, n2)


def overlap_reaches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n1, n2, c1, c2 in zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "c1", "c2")), strict=True):
                both = len(np.intersect1d(np.frombuffer(c1, "<u8"), np.frombuffer(c2, "<u8"), assume_unique=True))
                keep.append(100 * both >= percent * (n1 + n2 - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of (doc_id, text): components of documents linked by their sets.

    Texts without words (or null) have an empty set and link with nothing. Documents of equal sets link, repeated rows among them. Rows of equal id
    with different texts are judged text by text. A null doc_id stays, its component is the least id it reaches (null if there is none).
    Sets are whole, whatever a text's length; an empty table gives an empty one; other columns are not read. Shingles are told apart by 56 bits
    of their hashes.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ngrams")
    blocks = max(256, 2 * partitions(spark))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(row_blocks(n, blocks), ROW_DDL)
    back = cut.groupBy("block").applyInArrow(lambda table: column_block(table, blocks), BACK_DDL)
    found = scratch.save(back.groupBy("batch").applyInArrow(row_block(percent), FOUND_DDL))
    members = found.where("prefix is null").select("doc_id", "key", "n")
    heads = members.groupBy("key").agg(F.min("doc_id").alias("head"))
    rows = scratch.save(found.where("prefix is not null").drop("doc_id").dropDuplicates(["key"]))
    links = link(rows, scratch, percent)
    linked = components(links, scratch).withColumnRenamed("id", "key")
    scratch.drop(rows)
    # The least document of each component, over classes; classes without a link are components of their own.
    classes = scratch.save(heads.join(linked, "key", "left").select("key", "head", F.coalesce("component", "key").alias("component")))
    least = classes.groupBy("component").agg(F.min("head").alias("component_id"))
    of_class = classes.join(least, "component").select("key", "component_id")
    own = members.join(of_class, "key", "left")
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def link(rows: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links (a, b) between classes that connect all that the exact overlaps link, from (key, n, prefix, rest, cols)."""
    entries = scratch.save(rows.select("key", "n", "rest", F.element_at("prefix", -1).alias("end"), F.explode("prefix").alias("col")))
    narrow_rows = rows.select("key", "n", "cols")

    def reaching(pairs: DataFrame) -> DataFrame:
        """Of (a, b) those whose exact overlap is enough."""
        one = narrow_rows.select(F.col("key").alias("b"), F.col("n").alias("n2"), F.col("cols").alias("c2"))
        two = narrow_rows.select(F.col("key").alias("a"), F.col("n").alias("n1"), F.col("cols").alias("c1"))
        return pairs.select("a", "b").join(one, "b").join(two, "a").select("a", "b", "n1", "n2", "c1", "c2").mapInArrow(overlap_reaches(percent), "a long, b long")

    def may(pairs: DataFrame) -> DataFrame:
        """Size-derived bound on (n1, rest1, end1, n2, rest2, end2, c): the class whose prefix ends first has `rest` entries that c doesn't see."""
        rest = F.when(F.col("end1") <= F.col("end2"), F.col("rest1")).otherwise(F.col("rest2"))
        return pairs.where((100 + percent) * (F.col("c") + rest) >= percent * (F.col("n1") + F.col("n2")))

    side = [F.col("key").alias("a"), F.col("n").alias("n1"), F.col("rest").alias("rest1"), F.col("end").alias("end1"), "col"]
    lead = scratch.save(entries.groupBy("col").agg(F.min(F.struct("key", "n", "rest", "end")).alias("l"), F.count("*").alias("g")).where("g > 1").select("col", F.col("l.key").alias("b"), F.col("l.n").alias("n2"), F.col("l.rest").alias("rest2"), F.col("l.end").alias("end2"), "g"))
    tried = salted_join(entries.select(*side), lead, ["col"], "g").where("a <> b").where(fits(F.col("n1"), F.col("n2"), percent))
    pair = ["a", "b", "n1", "rest1", "end1", "n2", "rest2", "end2"]
    counted = may(tried.groupBy(*pair).agg(F.count("*").alias("c")))
    best = counted.groupBy("a").agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("b"))
    first = scratch.save(reaching(best))
    parts = scratch.save(components(first, scratch))
    with_part = scratch.save(entries.join(parts, entries.key == parts.id, "left").select("key", "n", "rest", "end", "col", F.coalesce("component", "key").alias("part")))
    mixed = scratch.save(with_part.groupBy("col").agg(F.min("part").alias("p1"), F.max("part").alias("p2"), F.count("*").alias("g")).where("p1 <> p2").select("col", "g"))
    heavy = scratch.save(salted_join(with_part, mixed.where(F.col("g") > HEAVY), ["col"], "g").select("key", "n", "col"))
    light = scratch.save(with_part.join(mixed.where(F.col("g") <= HEAVY).select("col"), "col"))
    left = light.select(*side, F.col("part").alias("part1"))
    right = light.select(F.col("key").alias("b"), F.col("n").alias("n2"), F.col("rest").alias("rest2"), F.col("end").alias("end2"), "col", F.col("part").alias("part2"))
    across = left.join(right, "col").where((F.col("a") < F.col("b")) & (F.col("part1") != F.col("part2")) & fits(F.col("n1"), F.col("n2"), percent))
    more = scratch.save(reaching(may(across.groupBy(*pair).agg(F.count("*").alias("c")))))
    blocks = scratch.save(product(heavy, narrow_rows, scratch, percent))
    scratch.drop(with_part, entries, lead, parts, mixed, light, heavy)
    return first.unionAll(more).unionAll(blocks)


def product(heavy: DataFrame, rows: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links between classes that heavy columns connect, by blocks of the product; two classes of a heavy column always meet."""
    clusters = components(heavy.select((-F.col("col") - 1).alias("a"), F.col("key").alias("b")), scratch).withColumnsRenamed({"id": "key", "component": "cluster"})
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent + 1e-9))).cast("long")
    members = scratch.save(heavy.select("key", "n").distinct().join(clusters, "key").withColumn("size", step))
    counts = members.groupBy("cluster", "size").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("k"))
    above = counts.select("cluster", (F.col("size") - 1).alias("size"), F.col("k").alias("k_above"))
    below = counts.select("cluster", (F.col("size") + 1).alias("size"), F.col("k").alias("k_below"))
    counts = counts.join(above, ["cluster", "size"], "left").join(below, ["cluster", "size"], "left")
    placed = members.join(counts, ["cluster", "size"]).withColumn("block", F.pmod(F.col("key"), F.col("k")).cast("int"))

    def span(lo, hi):
        return F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))

    # A task is (size, block) against (size, later block) or (size + 1, any block); a class stands left or right in it, or is both in its own block.
    task = lambda size, i, up, j, left: F.struct(size.alias("s"), i.alias("i"), F.lit(up).alias("up"), j.alias("j"), F.lit(left).alias("left"))
    s, b = F.col("size"), F.col("block")
    tasks = F.concat(
        F.transform(span(b, F.col("k")), lambda j: task(s, b, False, j, True)),
        F.transform(span(F.lit(0), b), lambda i: task(s, i, False, b, False)),
        F.transform(span(F.lit(0), F.coalesce("k_above", F.lit(0))), lambda j: task(s, b, True, j, True)),
        F.transform(span(F.lit(0), F.coalesce("k_below", F.lit(0))), lambda i: task(s - 1, i, True, b, False)),
    )
    dealt = placed.select("key", "cluster", F.explode(tasks).alias("t")).select("key", "cluster", "t.*").join(rows, "key")
    return dealt.groupBy("cluster", "s", "i", "up", "j").applyInArrow(multiply(percent), "a long, b long")


def multiply(percent: int):
    """Task of one pair of row blocks: its links as a spanning forest."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def side(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        cols = [np.frombuffer(c, "<u8") for c in table.column("cols").to_pylist()]
        owner = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
        return table.column("key").to_numpy(), table.column("n").to_numpy(), np.concatenate([*cols, np.empty(0, "<u8")]), owner

    def run(table: pa.Table) -> pa.Table:
        is_left = np.array(table.column("left").to_pylist())
        own = not table.column("up")[0].as_py() and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        if not own and is_left.all() or not is_left.any():
            return schema.empty_table()
        k1, n1, c1, o1 = side(table.filter(pa.array(is_left)))
        k2, n2, c2, o2 = (k1, n1, c1, o1) if own else side(table.filter(pa.array(~is_left)))
        common = np.intersect1d(c1, c2)
        both = np.zeros((len(k1), len(k2)), np.float32)
        sides = []
        for cols, owner in ((c1, o1), (c2, o2)):
            at = np.searchsorted(common, cols)
            held = at < len(common)
            held[held] = common[at[held]] == cols[held]
            order = np.argsort(at[held], kind="stable")
            sides.append((at[held][order], owner[held][order]))
        for begin in range(0, len(common), COLUMNS):
            parts = []
            for (at, owner), rows in zip(sides, (len(k1), len(k2)), strict=True):
                lo, hi = np.searchsorted(at, [begin, begin + COLUMNS])
                part = np.zeros((rows, min(COLUMNS, len(common) - begin)), np.float32)
                part[owner[lo:hi], at[lo:hi] - begin] = 1
                parts.append(part)
            both += parts[0] @ parts[1].T
        overlap = both.astype(np.int64)
        linked = 100 * overlap >= percent * (n1[:, None] + n2[None, :] - overlap)
        linked &= k1[:, None] != k2[None, :]
        pairs = forest(k1, k2, linked)
        return pa.table([pa.array([p[x] for p in pairs], pa.int64()) for x in (0, 1)], schema=schema)

    return run

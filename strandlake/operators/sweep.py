"""The numpy side of pileups: packs of counted bases from the records of templates, and alleles, depths and blocks from the packs of a bin.

Both steps stream: the first holds the records of one template, or as many templates as have about a million bases, the second the counts of a few hundred bins of samples.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: kind: WINDOW (more: the reference bases of the bin), PACK (spans: starts in the bin and lengths of stretches; codes: their bases, four in a byte), COUNTS (codes: how often
#: each base was seen at each position) or INDEL (n templates with an allele that takes `gone` bases behind pos0 away or puts `more` there).
PACKED = "sample string, chrom string, bin long, kind int, bases int, spans binary, codes binary, pos0 long, gone long, more string, n long"
WINDOW, PACK, COUNTS, INDEL = range(4)
#: kind: allele (ref is null where it reaches beyond the window, alt then holds what is inserted), run or block.
SWEPT = "kind string, sample string, chrom string, bin long, pos0 long, pos1 long, ref string, alt string, gone long, dp long, ad long"
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_SCHEMAS = {ddl: pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in ddl.split(", ")]) for ddl in (PACKED, SWEPT)}
_CHUNK, _GROUPS, _CIGARS = 1_000_000, 256, 100_000
_CODE = np.full(256, 9, dtype=np.uint8)
_CODE[[ord(c) for c in "ACGT"]] = range(4)
_LETTERS = np.array(list("ACGT"), dtype=object)
Batches = Iterator[pa.RecordBatch]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one behind the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _table(ddl: str, size: int, /, **columns) -> pa.RecordBatch:
    """A batch of the schema; columns that aren't given are null."""
    schema = _SCHEMAS[ddl]
    return pa.record_batch([pa.nulls(size, f.type) if f.name not in columns else pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Where a row begins another key than the row before it has; nulls are equal."""
    n = len(columns[0])
    out = np.ones(n, dtype=bool)
    out[1:] = False
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out[1:] |= differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return out


def _parts(table: pa.Table, limit: Callable[[pa.Table], np.ndarray], most: int, keys: list[str] | None = None) -> Iterator[pa.Table]:
    """The table in slices whose sums of `limit` are `most` at most, or of one row; with keys, of whole keys, one at least."""
    sizes = np.cumsum(limit(table))
    changes = np.append(np.flatnonzero(_changes([table.column(k).combine_chunks() for k in keys])), table.num_rows) if keys else np.arange(table.num_rows + 1)
    at = 0
    while at < table.num_rows:
        done = sizes[at - 1] if at else 0
        end = int(np.searchsorted(sizes, done + most, side="right"))
        end = int(changes[min(max(np.searchsorted(changes, end, side="right") - 1, np.searchsorted(changes, at, side="right")), len(changes) - 1)])
        yield table.slice(at, end - at)
        at = end


def _chars(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one behind the other, and where each begins and the last ends."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    if len(data) and data.max() > 127:
        texts = column.to_pylist()
        data = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        return data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return data, offsets - offsets[0]


# Records to packs

_WHOLE = re.compile(r"([0-9]+[MIDNSHP=X])+$")
_READS = {"M": (1, 1), "=": (1, 1), "X": (1, 1), "I": (0, 1), "S": (0, 1), "D": (1, 0), "N": (1, 0)}


def _walk(cigar: str) -> tuple[list[tuple[str, str, int, int, int]], int]:
    """(operation, the one before, length, reference offset, read offset) of each operation, and the bases that a read must have."""
    ref = read = 0
    prior, out = "", []
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        out.append((op, prior, int(n), ref, read))
        on_ref, on_read = _READS.get(op, (0, 0))
        ref, read, prior = ref + on_ref * int(n), read + on_read * int(n), op
    return out, read


class _Cigars:
    """Walks of distinct CIGARs as arrays: aligned stretches and indels behind aligned bases."""

    def __init__(self) -> None:
        self.known: dict[str, tuple] = {}

    def arrays(self, cigars: list[str]) -> tuple:
        if len(self.known) > _CIGARS:
            self.known.clear()
        for c in cigars:
            if c not in self.known:
                ops, needs = _walk(c) if _WHOLE.match(c) else ([], -1)
                aligned = [(n, ref, read) for op, _, n, ref, read in ops if op in "M=X" and n]
                gaps = [(n, ref, read, op == "I") for op, prior, n, ref, read in ops if op in "ID" and prior and prior in "M=X"]
                self.known[c] = aligned, gaps, needs
        found = [self.known[c] for c in cigars]
        flat = lambda k, w: (np.array([len(f[k]) for f in found], dtype=np.int64), np.array([x for f in found for x in f[k]], dtype=np.int64).reshape(-1, w))
        return flat(0, 3), flat(1, 4), np.array([f[2] for f in found], dtype=np.int64)


def _spread(lists: tuple[np.ndarray, np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of each read's CIGAR, and the read they belong to."""
    counts, values = lists
    begins = np.cumsum(counts) - counts
    n = counts[which]
    return values[_ranges(begins[which], n)], np.repeat(np.arange(len(which)), n)


def _resolved(b1: np.ndarray, q1: np.ndarray, b2: np.ndarray, q2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What two mates say of one base: qualities add up where they agree; else the better one stays with four fifths of its own (ties: the lesser letter)."""
    first = (q1 > q2) | ((q1 == q2) & (b1 < b2))
    return np.where(first, b1, b2), np.where(b1 == b2, np.minimum(q1 + q2, 93), np.where(first, q1, q2) * 4 // 5)


def _folded(reads: list[tuple[int, str, str, str]], width: int) -> dict[int, tuple[int, int]]:
    """Base and quality by position of a template with three records or more at a place: its blocks are laid over each other in a bin from left to right."""
    cut = []
    for pos0, cigar, seq, qual in reads:
        start, b, q = pos0, "", ""
        for op, _, n, ref, read in [*_walk(cigar)[0], ("N", "", 0, 0, 0)]:
            if op in "M=X":
                b, q = b + seq[read : read + n], q + qual[read : read + n]
            elif op == "D":
                b, q = b + "-" * n, q + "!" * n
            elif op == "N":
                at = 0
                while at < len(b):
                    here = start + at
                    end = min(len(b), at + width - here % width)
                    cut.append((here // width, here, b[at:end], q[at:end]))
                    at = end
                start, b, q = pos0 + ref + n, "", ""
    out: dict[int, tuple[int, int]] = {}
    for _, start, b, q in sorted(cut):
        for i, (x, y) in enumerate(zip(b, q, strict=True)):
            if x != "-":
                new, old = (ord(x), ord(y) - 33), out.get(start + i)
                out[start + i] = new if old is None else tuple(int(v) for v in _resolved(*(np.int64(v) for v in (*old, *new))))
    return out


def _packed(table: pa.Table, cigars: _Cigars, width: int, least: int) -> Iterator[pa.RecordBatch]:
    """Packs and indels of whole templates. Absent qualities are the greatest; records go that have no sequence or no CIGAR, or one that needs more or fewer bases than they have."""
    fixed = {c: pc.fill_null(table.column(c), "*") for c in ("cigar", "seq", "qual")}
    length = pc.utf8_length(fixed["seq"])
    fixed["qual"] = pc.if_else(pc.equal(fixed["qual"], "*"), pc.binary_repeat("~", length), fixed["qual"])
    for c, values in fixed.items():
        table = table.set_column(table.column_names.index(c), c, values)
    encoded = table.column("cigar").combine_chunks().dictionary_encode()
    aligned, gaps, needs = cigars.arrays(encoded.dictionary.to_pylist())
    which = encoded.indices.to_numpy().astype(np.int64)
    fits = (needs[which] == length.to_numpy()) & (pc.utf8_length(fixed["qual"]).to_numpy() == length.to_numpy()) & pc.not_equal(fixed["seq"], "*").to_numpy()
    if not fits.all():
        table, which = table.filter(pa.array(fits)), which[fits]
    if not table.num_rows:
        return
    column = {c: table.column(c).combine_chunks() for c in table.column_names}
    (bases, at), (quals, _) = _chars(column["seq"]), _chars(column["qual"])
    pos0 = column["pos0"].to_numpy()
    template = np.cumsum(_changes([column[k] for k in ("sample", "qname", "chrom")])) - 1
    places = [column[k].dictionary_encode("encode") for k in ("sample", "chrom")]
    group = places[0].indices.to_numpy().astype(np.int64) * len(places[1].dictionary) + places[1].indices.to_numpy()
    names = lambda g: {"sample": places[0].dictionary.take(pa.array(g // len(places[1].dictionary))), "chrom": places[1].dictionary.take(pa.array(g % len(places[1].dictionary)))}

    values, read = _spread(aligned, which)
    n = values[:, 0]
    of = np.repeat(read, n)
    pos = _ranges(pos0[read] + values[:, 1], n)
    index = _ranges(at[read] + values[:, 2], n)
    b, q, t = bases[index], quals[index].astype(np.int32) - 33, template[of]
    if (b == 45).any():
        keep = b != 45
        b, q, t, pos = b[keep], q[keep], t[keep], pos[keep]
    if len(pos):
        low = pos.min()
        key = t * (pos.max() - low + 1) + (pos - low)
        order = np.argsort(key, kind="stable")
        key, b, q, t, pos = key[order], b[order], q[order], t[order], pos[order]
        same = key[1:] == key[:-1]
        if same.any():
            thrice = np.unique(t[1:-1][same[1:] & same[:-1]])
            i = np.flatnonzero(same)
            b[i], q[i] = _resolved(b[i], q[i], b[i + 1], q[i + 1])
            keep = np.append(True, ~same)
            if len(thrice):
                keep &= ~np.isin(t, thrice)
            b, q, t, pos = b[keep], q[keep], t[keep], pos[keep]
            for x in thrice:
                rows = np.flatnonzero(template == x)
                found = sorted(_folded([tuple(column[c][int(r)].as_py() for c in ("pos0", "cigar", "seq", "qual")) for r in rows], width).items())
                t, pos = np.append(t, np.full(len(found), x)), np.append(pos, np.array([p for p, _ in found], dtype=np.int64))
                b, q = np.append(b, np.array([v[0] for _, v in found], dtype=b.dtype)), np.append(q, np.array([v[1] for _, v in found], dtype=q.dtype))
        code = _CODE[np.minimum(b, 255)]
        keep = (q >= least) & (code < 4)
        yield from _packs(code[keep], t[keep], pos[keep], group[np.searchsorted(template, t[keep])], names, width)

    values, read = _spread(gaps, which)
    n, ref, offset, more = values[:, 0], pos0[read] + values[:, 1], at[read] + values[:, 2], values[:, 3] == 1
    keep = quals[np.maximum(offset - 1, at[read])].astype(np.int32) - 33 >= least if len(read) else np.zeros(0, dtype=bool)
    n, ref, offset, more, read = n[keep], ref[keep], offset[keep], more[keep], read[keep]
    if len(read):
        inserted = np.where(more, n, 0)
        letters = bases[_ranges(offset, inserted)]
        ends = np.concatenate([[0], np.cumsum(inserted)])
        if letters.dtype == np.uint8:
            texts = pa.LargeStringArray.from_buffers(len(read), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(letters))).cast(pa.string())
        else:
            whole = letters.tobytes().decode("utf-32-le")
            texts = pa.array([whole[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.string())
        own = pa.table({"g": group[read], "pos0": ref - 1, "gone": np.where(more, 0, n), "more": texts, "t": template[read]})
        allele = ["g", "pos0", "gone", "more"]
        counts = own.group_by([*allele, "t"], use_threads=False).aggregate([]).group_by(allele, use_threads=False).aggregate([([], "count_all")]).combine_chunks()
        col = {c: counts.column(c).combine_chunks() for c in counts.column_names}
        yield _table(PACKED, counts.num_rows, **names(col["g"].to_numpy()), bin=col["pos0"].to_numpy() // width, kind=np.full(counts.num_rows, INDEL), bases=np.ones(counts.num_rows, dtype=np.int64),
                     pos0=col["pos0"], gone=col["gone"], more=col["more"], n=col["count_all"])


def _packs(code: np.ndarray, t: np.ndarray, pos: np.ndarray, group: np.ndarray, names: Callable, width: int) -> Iterator[pa.RecordBatch]:
    """Counted bases of templates, in order, as stretches by sample, contig and bin."""
    if not len(pos):
        return
    bin_ = pos // width
    opens = np.append(True, (t[1:] != t[:-1]) | (pos[1:] != pos[:-1] + 1) | (bin_[1:] != bin_[:-1]))
    first = np.flatnonzero(opens)
    length = np.diff(np.append(first, len(pos)))
    low = bin_.min()
    order = np.argsort(group[first] * (bin_.max() - low + 1) + bin_[first] - low, kind="stable")
    first, length = first[order], length[order]
    g, place, start = group[first], bin_[first], pos[first] - bin_[first] * width
    heads = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (place[1:] != place[:-1])))
    stretches = np.diff(np.append(heads, len(first)))
    total = np.add.reduceat(length, heads)
    code = code[_ranges(first, length)]
    deep = total > 16 * width
    # Four bases in a byte, each row from a byte of its own.
    size = (total + 3) // 4
    byte = np.concatenate([[0], np.cumsum(size)])
    quarters = np.zeros(byte[-1] * 4, dtype=np.uint8)
    quarters[_ranges(byte[:-1] * 4, total)] = code
    quarters = quarters.reshape(-1, 4)
    data = quarters[:, 0] | quarters[:, 1] << 2 | quarters[:, 2] << 4 | quarters[:, 3] << 6
    spans = np.stack([start, length], axis=1).astype("<i4")
    binary = lambda ends, values: pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
    rows = _table(PACKED, len(heads), **names(g[heads]), bin=place[heads], kind=np.full(len(heads), PACK), bases=total, spans=binary(np.concatenate([[0], np.cumsum(stretches)]) * 8, spans), codes=binary(byte, data))
    yield rows.filter(pa.array(~deep)) if deep.any() else rows
    begin = np.cumsum(total) - total
    at = _ranges(start, length) if deep.any() else None
    for k in np.flatnonzero(deep):
        here = slice(begin[k], begin[k] + total[k])
        counts = np.bincount(at[here] * 4 + code[here], minlength=4 * width).astype("<i4").tobytes()
        yield _table(PACKED, 1, **names(g[heads[k : k + 1]]), bin=place[heads[k : k + 1]], kind=[COUNTS], bases=[4 * width], codes=[counts])


def packing(width: int, least_quality: int) -> Callable[[Batches], Batches]:
    """Reads (sample, qname, chrom, pos0, cigar, seq, qual), those of a template one behind the other, to PACKED."""
    keys = ["sample", "qname", "chrom"]

    def run(batches: Batches) -> Batches:
        cigars, kept = _Cigars(), None
        size = lambda t: pc.fill_null(pc.binary_length(t.column("seq")), 0).to_numpy().astype(np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            table = new if kept is None else pa.concat_tables([kept, new])
            # The last template may go on in the next batch.
            last = np.flatnonzero(_changes([table.column(k).combine_chunks() for k in keys]))[-1]
            kept = table.slice(last)
            if last:
                for part in _parts(table.slice(0, last), size, _CHUNK, keys):
                    yield from _packed(part, cigars, width, least_quality)
        if kept is not None:
            yield from _packed(kept, cigars, width, least_quality)

    return run


# Packs to alleles, runs and blocks


def _counted(kinds: np.ndarray, spans: pa.Array, codes: pa.Array, group: np.ndarray, groups: int, width: int) -> np.ndarray:
    """counts[group, position, base] of PACK and COUNTS rows."""
    counts = np.zeros(groups * width * 4, dtype=np.int64)
    rows = np.flatnonzero(kinds == PACK)
    if len(rows):
        take = lambda c: c.take(pa.array(rows)).cast(pa.large_binary())
        bounds = lambda c: np.frombuffer(c.buffers()[1], dtype=np.int64)[c.offset : c.offset + len(c) + 1]
        s, c = take(spans), take(codes)
        ends, byte = bounds(s), bounds(c)
        pairs = np.frombuffer(s.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view("<i4").reshape(-1, 2).astype(np.int64)
        data = np.frombuffer(c.buffers()[2], dtype=np.uint8)[byte[0] : byte[-1]]
        number = np.diff(ends) // 8
        start, length = pairs[:, 0], pairs[:, 1]
        total = np.add.reduceat(length, np.cumsum(number) - number)
        letters = ((data[:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3).reshape(-1)[_ranges((byte[:-1] - byte[0]) * 4, total)]
        where = _ranges(np.repeat(group[rows], number) * width + start, length)
        counts += np.bincount(where * 4 + letters, minlength=len(counts))
    counts = counts.reshape(groups, width, 4)
    for r in np.flatnonzero(kinds == COUNTS):
        counts[group[r]] += np.frombuffer(codes[int(r)].as_py(), dtype="<i4").reshape(width, 4)
    return counts


def _stretches(depth: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to, least depth) of the stretches of one level in each row, those of level 0 left out."""
    groups, width = depth.shape
    opens = np.ones((groups, width), dtype=bool)
    opens[:, 1:] = level[:, 1:] != level[:, :-1]
    first = np.flatnonzero(opens)
    least = np.minimum.reduceat(depth.reshape(-1), first)
    end = np.append(first[1:], groups * width)
    keep = level.reshape(-1)[first] > 0
    row = first // width
    return row[keep], (first - row * width)[keep], (end - row * width)[keep], least[keep]


def sweeping(width: int, classes: tuple[int, ...] | None, runs: bool) -> Callable[[Batches], Batches]:
    """PACKED in order of (chrom, bin, sample, kind) to SWEPT: alleles where a bin has a window, blocks of depth classes and runs of equal depth if asked for."""

    def flush(keys: pa.Table, counts: np.ndarray, windows: list[str | None], indels: pa.Table) -> Batches:
        """keys, counts and windows of whole groups; indels with their group."""
        depth = counts.sum(axis=2)
        sample, chrom, bin_ = (keys.column(c).combine_chunks() for c in ("sample", "chrom", "bin"))
        base = bin_.to_numpy() * width

        def rows(kind: str, g: np.ndarray, at: np.ndarray, **columns) -> pa.RecordBatch:
            take = pa.array(g)
            return _table(SWEPT, len(g), kind=pa.array([kind] * len(g)), sample=sample.take(take), chrom=chrom.take(take), bin=bin_.take(take), pos0=base[g] + at, **columns)

        for kind, level in (("run", depth if runs else None), ("block", np.searchsorted(np.array(classes), depth, side="right") if classes else None)):
            if level is not None:
                g, first, end, least = _stretches(depth, level)
                yield rows(kind, g, first, pos1=base[g] + end, dp=least)
        reference = np.full(depth.shape, 9, dtype=np.uint8)
        for k, w in enumerate(windows):
            if w is not None:
                letters = _CODE[np.frombuffer(w[1 : width + 1].encode("latin-1", "replace"), dtype=np.uint8)]
                reference[k, : len(letters)] = letters
        off = counts > 0
        known = reference < 4
        off &= known[:, :, None] & (reference[:, :, None] != np.arange(4, dtype=np.uint8))
        g, at, code = np.nonzero(off)
        if len(g):
            yield rows("allele", g, at, ref=pa.array(_LETTERS[reference[g, at]], pa.string()), alt=pa.array(_LETTERS[code], pa.string()), gone=np.zeros(len(g), dtype=np.int64), dp=depth[g, at], ad=counts[g, at, code])
        if indels.num_rows:
            counted = indels.group_by(["group", "pos0", "gone", "more"], use_threads=False).aggregate([("n", "sum")])
            g, pos0, gone, n = (counted.column(c).to_numpy() for c in ("group", "pos0", "gone", "n_sum"))
            more, at = counted.column("more").to_pylist(), pos0 - base[g]
            ref, alt, keep = [], [], []
            for k, (own, a, size, inserted) in enumerate(zip(g.tolist(), at.tolist(), gone.tolist(), more, strict=True)):
                w = windows[own]
                if w is None:
                    continue
                text = w[a + 1 : a + size + 2] if a + size + 1 <= width else None
                if text is None or len(text) == size + 1:
                    keep.append(k)
                    ref.append(text)
                    alt.append(inserted if text is None else text[0] + inserted)
            if keep:
                g, at, gone, n = g[keep], at[keep], gone[keep], n[keep]
                yield rows("allele", g, at, ref=pa.array(ref, pa.string()), alt=pa.array(alt, pa.string()), gone=gone, dp=depth[g, at], ad=n)

    def run(batches: Batches) -> Batches:
        window: tuple | None = None  # (chrom, bin, bases) of the last window
        held: tuple[pa.Table, np.ndarray, list, pa.Table] | None = None  # the group that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            everything = pa.Table.from_batches([batch])
            fresh = lambda t: _changes([t.column(k).combine_chunks() for k in ("chrom", "bin", "sample")])
            weight = lambda t: np.maximum(pc.fill_null(t.column("bases"), 0).to_numpy().astype(np.int64), fresh(t) * (_CHUNK // _GROUPS))
            for part in _parts(everything, weight, _CHUNK):
                kinds = part.column("kind").to_numpy()
                bounds: dict[int, tuple] = {}
                for r in np.flatnonzero(kinds == WINDOW):
                    bounds[int(r)] = tuple(part.column(c)[int(r)].as_py() for c in ("chrom", "bin", "more"))
                own = part.filter(pa.array(kinds != WINDOW))
                if not own.num_rows:
                    window = list(bounds.values())[-1] if bounds else window
                    continue
                seen = np.flatnonzero(kinds != WINDOW)
                changes = fresh(own)
                heads = np.flatnonzero(changes)
                group = np.cumsum(changes) - 1
                keys = own.select(["sample", "chrom", "bin"]).take(pa.array(heads))
                at_window = np.array(sorted(bounds), dtype=np.int64)
                texts = []
                for h, (chrom, bin_) in zip(heads.tolist(), zip(keys.column("chrom").to_pylist(), keys.column("bin").to_pylist(), strict=True), strict=True):
                    k = int(np.searchsorted(at_window, seen[h])) - 1
                    last = bounds[int(at_window[k])] if k >= 0 else window
                    texts.append(last[2] if last is not None and chrom is not None and last[:2] == (chrom, bin_) else None)
                window = bounds[int(at_window[-1])] if bounds else window
                kind = own.column("kind").to_numpy()
                counts = _counted(kind, own.column("spans").combine_chunks(), own.column("codes").combine_chunks(), group, len(heads), width)
                gaps = own.select(["pos0", "gone", "more", "n"]).append_column("group", pa.array(group)).filter(pa.array(kind == INDEL))
                if held is not None:
                    if held[0].slice(0, 1).to_pylist() == keys.slice(0, 1).to_pylist():
                        counts[0] += held[1][0]
                        gaps = pa.concat_tables([held[3], gaps])
                    else:
                        yield from flush(*held)
                k = len(heads) - 1
                here = pc.equal(gaps.column("group"), k)
                if k:
                    yield from flush(keys.slice(0, k), counts[:k], texts[:k], gaps.filter(pc.invert(here)))
                rest = gaps.filter(here)
                rest = rest.set_column(rest.column_names.index("group"), "group", pa.array(np.zeros(rest.num_rows, dtype=np.int64)))
                if rest.num_rows > 1000:  # a deep bin's alleles are added up as they come
                    rest = rest.group_by(["group", "pos0", "gone", "more"], use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(gaps.column_names)
                held = keys.slice(k), counts[k:].copy(), texts[k:], rest
        if held is not None:
            yield from flush(*held)

    return run

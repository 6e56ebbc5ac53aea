"""Suffix-array dedup by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes when it lies in a ``min_len``-byte string that also starts in a
document with a smaller id. The work is split so that no task sees more than a
block of documents or a bucket of passages:

1. Documents are dealt into blocks by a hash of id and text. Each window of
   ``min_len`` bytes is named by its minimizer, the least hash among its k-byte
   strings, so equal windows carry equal names wherever they stand. Every window
   also holds its minimizer with half of the other bytes before it or behind it:
   a string of about 0.7 ``min_len`` bytes at a place that the window decides.
2. Per bucket of such strings' hashes: which are in two blocks or more. A bit for
   each goes back to the blocks.
3. Each block sends only passages (windows in a row with one name) whose strings
   are shared, in or between blocks. A passage equal to one of a smaller id in the
   same block is settled there and is not sent, so a block sends a text that a
   third of all documents share once. Windows of a string that is in very many
   blocks, or in very many surroundings, travel one by one by their own hash.
4. Per bucket: the Burrows-Wheeler transform of the distinct passages. Breadth
   first, each interval of suffixes with a common prefix of length l is
   extended backwards by each byte before it; the right ends found for the
   first time are where the common prefix of neighbours is l. After ``min_len``
   steps, suffixes without an end between them share ``min_len`` bytes or more.
   The smallest id of such a group decides.
5. The blocks merge the marks and cut their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_LEN = 50
BLOCK_BYTES = 8 << 20
BATCH_BYTES = 2 << 20
#: A string in more blocks than this, or in a block with as many different surroundings, has its windows dealt one by one.
HOT_BLOCKS = 256
_U = np.uint64
_NULL_ID = np.iinfo(np.int64).min


# ---------------------------------------------------------------- byte strings


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def string_hashes(text: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size a hash of that many bytes from each position on, by doubling."""
    out: list = [np.empty(0, _U)] * len(sizes)
    upto, factor, length = [0] * len(sizes), 0xD6E8FEB86659FD93, 1
    have = text.astype(_U) + _U(1)
    with np.errstate(over="ignore"):
        while length <= min(max(sizes), len(text)):
            for i, size in enumerate(sizes):
                if size & length and size <= len(text):
                    n = len(text) - upto[i] - length + 1
                    out[i] = out[i][:n] * _U(factor) + have[upto[i] : upto[i] + n] if upto[i] else have
                    upto[i] += length
            n = len(have) - length
            if n <= 0:
                break
            have = have[:n] * _U(factor) + have[length : length + n]
            factor = factor * factor % 2**64
            length *= 2
        return [_mixed(x) for x in out]


def sliding(least_or_most, x: np.ndarray, width: int) -> np.ndarray:
    """``np.minimum`` or ``np.maximum`` of ``width`` values from each position on."""
    span = 1
    while span * 2 <= width:
        x = least_or_most(x[:-span], x[span:])
        span *= 2
    return least_or_most(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class Windows:
    """The windows of some texts in a row (``starts`` to ``ends`` in ``text``; none crosses a text's end).

    ``name`` of each window, whether it is ``inside`` a text, the places ``at`` of the
    minimizers, and hashes of the strings that end or begin with a minimizer
    (``before``, ``behind``; ``has_before`` and ``has_behind`` where they fit the text).
    """

    def __init__(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_len: int):
        self.k = k = max(1, min_len * 2 // 5)
        self.min_len, self.half = min_len, (min_len - k) // 2
        n = max(0, len(text) - min_len + 1)
        long = ends - starts >= min_len
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, starts[long], 1)
        np.add.at(edge, ends[long] - min_len + 1, -1)
        self.inside = np.cumsum(edge[:n]) > 0
        self.first_of_text = starts[long]
        if not n:
            self.name = self.own = self.before = self.behind = np.empty(0, _U)
            self.at, self.has_before, self.has_behind = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool)
            return
        short, strings = string_hashes(text, k, k + self.half)
        self.name = sliding(np.minimum, short, min_len - k + 1)
        pad = np.zeros(min_len - k, _U)
        most = sliding(np.maximum, np.concatenate([pad, np.where(self.inside, self.name, _U(0)), pad]), min_len - k + 1)
        self.at = np.flatnonzero(most == short)
        self.own = short[self.at]
        of = np.searchsorted(ends, self.at, side="right")
        of[of == len(ends)] = 0
        self.has_behind = self.at + k + self.half <= ends[of]
        self.has_before = (self.at - self.half >= starts[of]) & (self.at + k <= ends[of])
        self.behind = strings[np.minimum(self.at, len(strings) - 1)]
        self.before = strings[np.clip(self.at - self.half, 0, len(strings) - 1)]

    def strings(self) -> np.ndarray:
        return np.concatenate([self.before[self.has_before], self.behind[self.has_behind]])

    def _reach(self, before: np.ndarray, behind: np.ndarray):
        """First and last window around each chosen minimizer that holds the string before or behind it."""
        a, b = self.at[before], self.at[behind]
        far = self.min_len - self.k
        first = np.concatenate([a - far, b - (far - self.half)])
        last = np.concatenate([a - self.half, b])
        return np.maximum(first, 0), np.minimum(last, len(self.name) - 1)

    def holding(self, known: np.ndarray) -> np.ndarray:
        """Flags of the windows that may hold a string with a hash in ``known`` (sorted); no window that does is left out."""
        first, last = self._reach(self.has_before & _within(self.before, known), self.has_behind & _within(self.behind, known))
        depth = np.bincount(first, minlength=len(self.name) + 1) - np.bincount(last + 1, minlength=len(self.name) + 1)[: len(self.name) + 1]
        return (np.cumsum(depth)[: len(self.name)] > 0) & self.inside

    def holding_exactly(self, known: np.ndarray) -> np.ndarray:
        """Flags of the windows that hold such a string at their own minimizer: the bytes of a window alone decide."""
        out = np.zeros(len(self.name), bool)
        if len(known):
            before, behind = self.has_before & _within(self.before, known), self.has_behind & _within(self.behind, known)
            first, last = self._reach(before, behind)
            own_name = np.concatenate([self.own[before], self.own[behind]])
            width = np.maximum(0, last - first + 1)
            window = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first, width)
            out[window[self.name[window] == np.repeat(own_name, width)]] = True
        return out & self.inside

    def passages(self, wanted: np.ndarray):
        """First and last window of each run of wanted windows with one name, and the names."""
        if not wanted.any():
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U)
        change = np.ones(len(self.name) + 1, bool)
        change[1:-1] = (self.name[1:] != self.name[:-1]) | ~wanted[1:] | ~wanted[:-1]
        change[self.first_of_text] = True
        first, last = np.flatnonzero(wanted & change[:-1]), np.flatnonzero(wanted & change[1:])
        return first, last, self.name[first]


# ----------------------------------------------------- Burrows-Wheeler expansion


def bounded_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next ``depth`` bytes or more (prefix doubling; the text is a ring)."""
    n = len(text)
    padded = np.resize(text, n + 8)
    key = np.zeros(n, _U)
    for i in range(8):
        key = (key << _U(8)) | padded[i : i + n].astype(_U)
    have = 8
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, _U)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]).astype(_U) + _U(1)
        key = (rank << _U(32)) | np.roll(rank, -have)
        have *= 2


def group_starts(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Flags of the sorted suffixes that share fewer than ``depth`` bytes with the one before.

    Breadth-first backward extension on the transform, by increasing common
    prefix; an interval whose right end is known already is not extended again.
    """
    n = len(text)
    bwt = text[order - 1]
    back = np.argsort(bwt, kind="stable").astype(np.int32)  # the row whose extension is row x
    forward = np.empty(n, np.int32)
    forward[back] = np.arange(n, dtype=np.int32)
    same = np.append(bwt[back][1:] == bwt[back][:-1], False)
    following = np.where(same, np.append(back[1:], 0), n).astype(np.int32)
    preceding = np.where(np.append(False, same[:-1]), np.insert(back[:-1], 0, 0), -1).astype(np.int32)
    known = np.zeros(n + 1, bool)
    known[n] = known[0] = True
    left, right = np.array([0], np.int32), np.array([n], np.int32)
    for _ in range(depth):
        width = right - left
        rows = np.arange(width.sum(), dtype=np.int32) + np.repeat(left - (np.cumsum(width, dtype=np.int32) - width), width)
        to = forward[rows]
        ends = np.sort(to[following[to] >= np.repeat(right, width)]) + 1
        begins = np.sort(to[preceding[to] < np.repeat(left, width)])
        new = ~known[ends]
        known[ends[new]] = True
        left, right = begins[new], ends[new]
        if not len(left):
            break
    return known[:n]


def smallest_owner(pieces: list[bytes], owners: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the pieces in a row: the least owner of a piece that holds the same window; and each piece's first window."""
    size = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    stop = np.cumsum(size)
    valid = np.ones(len(text), bool)
    for i in range(1, min_len):
        valid[stop - i] = False
    order = bounded_order(text, min_len)
    begins = np.flatnonzero(group_starts(text, order, min_len))
    value = np.where(valid, np.repeat(owners, size), np.iinfo(np.int64).max)[order]
    least = np.minimum.reduceat(value, begins)
    out = np.empty(len(text), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(begins, len(text))))
    windows = size - min_len + 1
    return out[valid], np.cumsum(windows) - windows


# ------------------------------------------------------------------ Spark stages

_NAMES = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("names", T.BinaryType()), T.StructField("varied", T.BinaryType())])
_SHARED = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("shared", T.BinaryType()), T.StructField("hot", T.BinaryType())])
_SENT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("head", T.BinaryType()), T.StructField("bytes", T.BinaryType())])
_MARKS = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("marks", T.BinaryType())])
#: name, id, row in the block, offset in the document, length of a passage
_HEAD = np.dtype([("name", "<u4"), ("id", "<i8"), ("row", "<u4"), ("at", "<u4"), ("size", "<u4")])
#: row in the block, first byte and end of a run of bytes that go
_MARK = np.dtype([("row", "<u4"), ("from", "<u4"), ("to", "<u4")])


def _packed(head: np.ndarray) -> bytes:
    """Records column by column, compressed."""
    return pa.compress(b"".join(np.ascontiguousarray(head[f]).tobytes() for f in head.dtype.names), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: np.dtype) -> np.ndarray:
    raw, at, out = pa.decompress(data, n * kind.itemsize, codec="zstd", asbytes=True), 0, np.empty(n, kind)
    for f in kind.names:
        out[f] = np.frombuffer(raw, kind[f], n, at)
        at += n * kind[f].itemsize
    return out


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _rows(table: pa.Table, id_col: str, text_col: str):
    """Ids and texts (bytes) of a block in a fixed order, and the order."""
    row = table.column("row").combine_chunks()
    row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
    ids = row.field(id_col).cast(pa.int64()).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
    texts = [x or b"" for x in row.field(text_col).cast(pa.binary()).to_pylist()]
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    return ids[order], [texts[i] for i in order], order, row


def _chunks(texts: list[bytes], min_len: int):
    """Texts in a row, about BATCH_BYTES at a time: rows, offsets in them, the bytes, starts and ends.

    A longer text is cut into parts that share ``min_len - 1`` bytes, so that each window is in one part.
    """
    rows, offsets, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - min_len + 1), BATCH_BYTES):
            part = t[at : at + BATCH_BYTES + min_len - 1]
            rows.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
            if size >= BATCH_BYTES:
                yield _chunk(rows, offsets, parts)
                rows, offsets, parts, size = [], [], [], 0
    if rows:
        yield _chunk(rows, offsets, parts)


def _chunk(rows, offsets, parts):
    lengths = np.array([len(x) for x in parts], np.int64)
    ends = np.cumsum(lengths)
    return np.array(rows), np.array(offsets), np.frombuffer(b"".join(parts), np.uint8), ends - lengths, ends


def _block_strings(found: list[Windows], buckets: int, varied: int):
    """The distinct string hashes of a block by (bucket, hash), how often each occurs, and which have ``varied`` surroundings or more."""
    every = np.concatenate([w.strings() for w in found]) if found else np.empty(0, _U)
    names, counts = np.unique(every, return_counts=True)
    often, many = names[counts >= varied], np.zeros(len(names), bool)
    if len(often):  # different strings on the other side of the minimizer
        pairs = []
        for w in found:
            both = w.has_before & w.has_behind
            pairs += [np.stack(p, 1) for p in ((w.before[both], w.behind[both]), (w.behind[both], w.before[both]))]
        pairs = np.concatenate(pairs)
        pairs = np.unique(pairs[_within(pairs[:, 0], often)], axis=0)
        values, others = np.unique(pairs[:, 0], return_counts=True)
        many = _within(names, values[others >= varied])
    order = np.argsort(names % _U(buckets), kind="stable")
    return names[order], counts[order], many[order]


def _parts(keys: np.ndarray) -> list[np.ndarray]:
    """Places of each run of equal keys."""
    return np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1) if len(keys) else []


def _names_of_block(id_col, text_col, min_len, buckets, varied):
    def run(table: pa.Table) -> pa.Table:
        _, texts, _, _ = _rows(table, id_col, text_col)
        names, _, many = _block_strings([Windows(t, s, e, min_len) for _, _, t, s, e in _chunks(texts, min_len)], buckets, varied)
        block = table.column("block")[0].as_py()
        parts = _parts(names % _U(buckets))
        # 32 bits of a hash beside its bucket: a chance meeting only sends a passage in vain
        low = [(names[p] >> _U(32)).astype("<u4").tobytes() for p in parts]
        own = [np.flatnonzero(many[p]).astype("<u4").tobytes() for p in parts]
        return pa.table({"bucket": [int(names[p[0]] % _U(buckets)) for p in parts], "block": [block] * len(parts), "names": low, "varied": own}, schema=_arrow(_NAMES))

    return run


def _shared_of_bucket(hot_blocks):
    """A bit for each name of a block (whether it is in another block), and the places of the hot ones."""

    def run(table: pa.Table) -> pa.Table:
        read = lambda c: [np.frombuffer(b, "<u4") for b in table.column(c).to_pylist()]
        parts, varied = read("names"), read("varied")
        values, counts = np.unique(np.concatenate([np.unique(p) for p in parts]), return_counts=True)
        shared = values[counts > 1]
        hot = np.unique(np.concatenate([values[counts > hot_blocks], *[p[v] for p, v in zip(parts, varied, strict=True)]]))
        bits = [np.packbits(_within(p, shared)).tobytes() for p in parts]
        places = [np.flatnonzero(_within(p, hot)).astype("<u4").tobytes() if len(hot) else b"" for p in parts]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "shared": bits, "hot": places}).cast(_arrow(_SHARED))

    return run


def _within(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in ``known`` (sorted)."""
    if not len(known):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys


def _sent_by_block(id_col, text_col, min_len, buckets, name_buckets, varied):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _arrow(_SENT).empty_table()
        ids, texts, _, _ = _rows(left, id_col, text_col)
        block = left.column("block")[0].as_py()
        found = [Windows(t, s, e, min_len) for _, _, t, s, e in _chunks(texts, min_len)]
        names, counts, _ = _block_strings(found, name_buckets, varied)
        # the same names in the same order as they were sent, so a bit for each is an answer
        wanted, hot = counts > 1, np.zeros(len(names), bool)
        answers = {b: (s, h) for b, s, h in zip(*(right.column(c).to_pylist() for c in ("bucket", "shared", "hot")), strict=True)}
        for p in _parts(names % _U(name_buckets)):
            bits, places = answers[int(names[p[0]] % _U(name_buckets))]
            wanted[p] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(p)).astype(bool)
            hot[p[np.frombuffer(places, "<u4")]] = True
        wanted, hot = np.sort(names[wanted]), np.sort(names[hot])
        heads, bodies, settled = [], [], []
        seen: dict[bytes, int] = {}
        for w, (rows, offsets, text, starts, ends) in zip(found, _chunks(texts, min_len), strict=True):
            keep = w.holding(wanted)
            single = w.holding_exactly(hot) & keep
            first, last, name = w.passages(keep & ~single)
            one = np.flatnonzero(single)
            if len(one):
                first, last, name = np.concatenate([first, one]), np.concatenate([last, one]), np.concatenate([name, string_hashes(text, min_len)[0][one]])
            of = np.searchsorted(ends, first, side="right")
            shift = offsets[of] - starts[of]
            raw = text.tobytes()
            for f, l, nm, r, by in zip(first.tolist(), (last + min_len).tolist(), name.tolist(), rows[of].tolist(), shift.tolist(), strict=True):
                body, owner = raw[f:l], int(ids[r])
                if seen.setdefault(body, owner) < owner:
                    settled.append((r, f + by, l + by))
                else:
                    heads.append((nm, owner, r, f + by, l - f))
                    bodies.append(body)
        out: list[tuple] = []
        if settled:
            out.append((block % buckets, block, 1, len(settled), _packed(np.array(settled, _MARK)), b""))
        if heads:
            name, *rest = (np.array(x) for x in zip(*heads, strict=True))
            head = np.empty(len(heads), _HEAD)
            head["name"] = (name.astype(_U) >> _U(32)).astype(np.uint32)
            for field, values in zip(("id", "row", "at", "size"), rest, strict=True):
                head[field] = values
            bucket = ((name.astype(_U) >> _U(20)) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for p in _parts(bucket[order]):
                part = order[p]
                body = pa.compress(b"".join([bodies[i] for i in part.tolist()]), codec="zstd", asbytes=True)
                out.append((int(bucket[part[0]]), block, 0, len(part), _packed(head[part]), body))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        return pa.table({f.name: list(c) for f, c in zip(_SENT, columns, strict=True)}, schema=_arrow(_SENT))

    return run


def _marks_of_bucket(min_len):
    def run(table: pa.Table) -> pa.Table:
        blocks, counts, marks = [], [], []
        heads, bodies, home = [], [], []
        for block, kind, n, head, body in zip(*(table.column(c).to_pylist() for c in ("block", "kind", "n", "head", "bytes")), strict=True):
            if kind:
                blocks.append(block)
                counts.append(n)
                marks.append(head)
                continue
            h = _unpacked(head, n, _HEAD)
            stop = np.cumsum(h["size"].astype(np.int64)).tolist()
            body = pa.decompress(body, int(h["size"].sum(dtype=np.int64)), codec="zstd", asbytes=True)
            bodies += [body[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)]
            heads.append(h)
            home.append(np.full(len(h), block, np.int64))
        if heads:
            head, home = np.concatenate(heads), np.concatenate(home)
            order = np.argsort(head["name"], kind="stable")
            first = np.concatenate([[0], np.flatnonzero(np.diff(head["name"][order])) + 1])
            count = np.diff(np.append(first, len(order)))
            index: dict[bytes, int] = {}
            which = np.array([index.setdefault(bodies[i], len(index)) for i in order.tolist()])
            # a name with one passage, over and over, needs no transform: all its windows are the smallest id's
            alone = np.repeat(np.minimum.reduceat(which, first) == np.maximum.reduceat(which, first), count)
            least = np.repeat(np.minimum.reduceat(head["id"][order], first), count)
            sure = order[alone & (head["id"][order] > least)]
            found = [(home[sure], _whole(head, sure))]
            order = order[~alone]
            # as many names together as make a batch
            first = np.flatnonzero(np.diff(head["name"][order])) + 1
            batch = np.cumsum(head["size"][order].astype(np.int64))[first - 1] // BATCH_BYTES
            for rows in np.split(order, first[np.diff(batch, prepend=0) > 0]):
                if len(rows):
                    found.append(_marks(head, bodies, rows, home, min_len))
            block, mark = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.argsort(block, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(block[by])) + 1):
                if len(part):
                    blocks.append(int(block[part[0]]))
                    counts.append(len(part))
                    marks.append(_packed(mark[part]))
        return pa.table({"block": blocks, "n": counts, "marks": marks}, schema=_arrow(_MARKS))

    return run


def _whole(head, rows) -> np.ndarray:
    """Marks of whole passages."""
    out = np.empty(len(rows), _MARK)
    out["row"], out["from"], out["to"] = head["row"][rows], head["at"][rows], head["at"][rows] + head["size"][rows]
    return out


def _marks(head, bodies, rows, home, min_len):
    """Runs of bytes that go, of some passages: their blocks and marks."""
    index: dict[bytes, int] = {}
    which = np.array([index.setdefault(bodies[i], len(index)) for i in rows.tolist()])
    owners = np.full(len(index), np.iinfo(np.int64).max)
    np.minimum.at(owners, which, head["id"][rows])
    least, first = smallest_owner(list(index), owners, min_len)
    low, high = np.minimum.reduceat(least, first), np.maximum.reduceat(least, first)
    ids = head["id"][rows]
    w, some = rows[ids > high[which]], (ids <= high[which]) & (ids > low[which])
    # the windows of the others in a row, a gap after each
    i, at = rows[some], first[which[some]]
    width = head["size"][i].astype(np.int64) - min_len + 2
    start = np.cumsum(width) - width
    place = np.arange(width.sum()) - np.repeat(start, width)
    gone = np.zeros(len(place) + 2, bool)
    real = place < np.repeat(width - 1, width)
    gone[1:-1][real] = least[(np.repeat(at, width) + place)[real]] < np.repeat(head["id"][i], width)[real]
    edges = np.flatnonzero(gone[1:] != gone[:-1])
    begin, end = edges[::2], edges[1::2]
    of = np.searchsorted(start, begin, side="right") - 1
    mark = np.empty(len(begin), _MARK)
    mark["row"], base = head["row"][i[of]], head["at"][i[of]].astype(np.int64) - start[of]
    mark["from"], mark["to"] = base + begin, base + end - 1 + min_len
    return np.concatenate([home[w], home[i[of]]]), np.concatenate([_whole(head, w), mark])


def _cut_block(id_col, text_col, schema, whole_chars):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        to = _arrow(schema)
        if not left.num_rows:
            return to.empty_table()
        _, texts, order, row = _rows(left, id_col, text_col)
        marks = np.concatenate([np.empty(0, _MARK), *[_unpacked(b, n, _MARK) for n, b in zip(right.column("n").to_pylist(), right.column("marks").to_pylist(), strict=True)]])
        marks = marks[np.argsort(marks["row"], kind="stable")]
        at = np.searchsorted(marks["row"], np.arange(len(texts) + 1))
        spans, kept = [], []
        for i, text in enumerate(texts):
            own = marks[at[i] : at[i + 1]]
            if not len(own):
                spans.append([])
                kept.append(text)
                continue
            depth = np.bincount(own["from"], minlength=len(text) + 1) - np.bincount(own["to"], minlength=len(text) + 1)
            gone = np.cumsum(depth)[: len(text)] > 0
            if whole_chars:
                lead = np.flatnonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)
                gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(text))))
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
        return pa.table({"row": row.take(pa.array(order)), "spans": pa.array(spans, to.field("spans").type), "kept": pa.array(kept, pa.binary())}).cast(to)

    return run


def remove_repeats(docs: DataFrame, min_len: int = MIN_LEN, id_col: str = "doc_id", text_col: str = "text", hot_blocks: int = HOT_BLOCKS, block_bytes: int = BLOCK_BYTES, whole_chars: bool = False) -> DataFrame:
    """Columns ``row`` (struct of the input's columns), ``spans`` (removed byte runs, start and end) and ``kept`` (binary).

    Null text counts as empty. A null id counts as smaller than any id. Rows with
    one id are one owner: they never remove each other's bytes. Texts shorter
    than ``min_len`` stay; long ones are looked at in parts that share ``min_len - 1``
    bytes, which changes no result. An empty table gives no rows. Extra columns travel in
    ``row``, whatever their names. With ``whole_chars`` a character goes only if
    all its bytes go, so what is left is text again.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    buckets, name_buckets = blocks, blocks // 2 + 1
    base = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int").alias("block"), F.struct("*").alias("row"))
    names = base.groupBy("block").applyInArrow(_names_of_block(id_col, text_col, min_len, name_buckets, hot_blocks), _NAMES)
    shared = names.groupBy("bucket").applyInArrow(_shared_of_bucket(hot_blocks), _SHARED)
    sent = base.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_sent_by_block(id_col, text_col, min_len, buckets, name_buckets, hot_blocks), _SENT)
    marks = sent.groupBy("bucket").applyInArrow(_marks_of_bucket(min_len), _MARKS)
    out = T.StructType([base.schema["row"], T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])
    return base.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_cut_block(id_col, text_col, out, whole_chars), out)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: bytes and runs removed from each document, and the SHA-256 of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        F.col("row.doc_id").alias("doc_id"),
        F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: Every window of 50 bytes (100 hex digits) with the smallest document it starts in.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, strlen(h) // 2 - 49))) i FROM d)),
m AS (SELECT s, min(doc_id) first_doc FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT w.doc_id, w.i FROM w JOIN m USING (s) WHERE m.first_doc < w.doc_id),
edge AS (SELECT doc_id, i, CASE WHEN i > 49 + coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 1 THEN 1 ELSE 0 END fresh FROM r),
isle AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) g FROM edge),
span AS (SELECT doc_id, g, min(i) a, max(i) + 50 b FROM isle GROUP BY doc_id, g),
kept AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) p FROM span),
part AS (SELECT k.doc_id, string_agg(substr(d.h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) body, max(b) tail, sum(b - a) n, count(*) c FROM kept k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, CAST(strlen(d.h) // 2 AS BIGINT) n_bytes, CAST(coalesce(n, 0) AS BIGINT) n_removed, CAST(coalesce(c, 0) AS BIGINT) n_spans,
       sha256(unhex(coalesce(body, '') || substr(d.h, 2 * coalesce(tail, 0) + 1))) kept_sha256
FROM d LEFT JOIN part USING (doc_id)
"""

"""Removal of repeated byte strings, by bucket-pointer refinement of sampled suffixes.

Each byte that a WINDOW-byte string covers which also starts in a document with a smaller id is
removed. Suffixes are sampled: every window has one anchor, the GRAM-byte string in it with the
least identifier, so equal windows have equal anchors at the same place. Three steps over Spark:

1. Initial buckets. Each 8-byte string is its own bucket identifier; those at offsets 0, 8 and 16
   name an anchor's bucket. Anchors meet by bucket over all documents, and only buckets that more
   than one row shares go on.
2. Contexts. Such an anchor's surroundings (the bytes of all windows that it serves) are read from
   the text. Equal surroundings, compared byte by byte, are settled at once: where a smaller
   document has them, all their windows go. One copy per document goes to the anchor's bucket.
3. Refinement. In each bucket, the windows left (first all, then halves of their range, down to one)
   share a core of bytes. Buckets of equal cores are refined by sorting on the 8-byte identifiers at
   the offsets that the next, longer core adds; each level starts from the bucket numbers of the one
   before. Buckets of a single document are finished. What is left at the end are buckets of equal
   windows, and all but the smallest document's are removed.

Hashes only decide where rows meet and which anchors are taken: every removal follows from compared
bytes. An anchor that very many suffixes share (HOT) is dealt out by whole windows instead of by the
anchor, so its suffixes spread over buckets; a group of documents sends equal windows once.

Rows travel packed: a row is one bucket's share of a slice of texts as arrays. Stretches of one
repeated byte, which are anchors at every place, travel as one item with a length.

Defined results for odd rows: a null or short text keeps all; a null doc_id counts as larger than
any other; documents with equal ids do not remove each other's bytes (rows of one id are told apart
by a 64-bit hash of their text); equal rows have equal results; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import cut, free_shuffles

WINDOW, GRAM = 50, 24
#: Window starts lie up to REACH bytes before their anchor; surroundings are REACH + WINDOW bytes.
REACH = WINDOW - GRAM
AROUND, WIDTH = REACH + WINDOW, 80
#: Bytes of text handled at once in numpy, and dealt out together; bytes of text behind one bucket and one group of documents.
STEP, SLICE_BYTES, BUCKET_BYTES, GROUP_BYTES = 1 << 20, 8 << 20, 24 << 20, 8 << 20
#: Bytes of text behind one task of a shuffle.
TASK_BYTES = 48 << 20
#: Suffixes of one anchor beyond which it is dealt out by windows; the most anchors dealt so, those with most suffixes first.
HOT, HOT_ANCHORS = 200_000, 100_000
LAST = np.iinfo(np.int64).max
PACK = "kind int, bucket int, data binary"
PACK_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
ITEMS, SETTLED, SHARED, CROWDED = 0, 1, 2, 3

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as one number."""
    out = np.empty(max(0, len(data) - 7), np.uint64)
    for s in range(min(8, len(out))):
        own = out[s::8]
        own[:] = np.frombuffer(data, "<u8", len(own), s)
    return out


def combine(ids: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Where strings of these identifiers and of those at a later offset meet."""
    x = ids * _ODD
    x ^= x >> np.uint64(32)
    x += later
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def _window_minimum(x: np.ndarray, n: int) -> np.ndarray:
    k = 1
    while 2 * k <= n:
        x = np.minimum(x[: len(x) - k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def anchors(data: np.ndarray, begin: np.ndarray, mask: np.uint64):
    """Arrays (place, run, identifier) of the anchors of all windows in texts joined to data, which
    start at begin; run counts places from place on with the same surroundings of one byte."""
    fits = np.ones(len(data), bool)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        fits[max(a, b - WINDOW + 1) : b] = False
    low, last, out = np.uint64((1 << 22) - 1), -1, []
    for at in range(0, len(data) - WINDOW + 1, STEP):
        till = min(at + STEP, len(data) - WINDOW + 1)
        if not fits[at:till].any():
            continue
        x = eights(data[at : till + WINDOW - 1])
        gram = combine(combine(x[:-16], x[8:-8]), x[16:]) & mask
        # The place takes the low bits, so the leftmost of equal anchors counts.
        keys = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
        pick = (_window_minimum(keys, REACH + 1) & low)[fits[at:till]].astype(np.int64)
        pick = pick[np.concatenate([[True], pick[1:] != pick[:-1]])]
        if pick[0] + at == last:
            pick = pick[1:]
        if not len(pick):
            continue
        last = pick[-1] + at
        # Places next to each other whose GRAM + 1 bytes are one repeated byte.
        next_ = np.minimum(pick + 1, len(gram) - 1)
        flat = (x[pick] == x[next_]) & (x[pick + 8] == x[next_ + 8]) & (x[pick + 16] == x[next_ + 16])
        new = np.nonzero(np.concatenate([[True], ~flat[:-1] | (pick[1:] != pick[:-1] + 1)]))[0]
        out.append((pick[new] + at, np.diff(np.append(new, len(pick))), gram[pick[new]]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else None


def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(arrays), *(a.size for a in arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds), 8), 8 * (1 + len(kinds)), []
    for kind, n in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.nonzero(np.concatenate([[True], values[1:] != values[:-1]]))[0] if len(values) else np.empty(0, np.int64)


def _spread(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """One value per run, repeated over the run."""
    return np.repeat(values, np.diff(np.append(starts, n)))


def _dealt(kind: int, bucket: np.ndarray, row: np.ndarray, *arrays: np.ndarray):
    """Rows of PACK, one per bucket, in which the arrays keep their order; row is written once per run."""
    bucket = bucket.astype(np.uint16 if len(bucket) and bucket.max() < 1 << 16 else np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, row, arrays = bucket[order], row[order], [a[order] for a in arrays]
    bounds = np.append(_starts(bucket), len(order))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        runs = _starts(row[a:b])
        yield kind, int(bucket[a]), pack(row[a:b][runs], np.diff(np.append(runs, b - a)).astype(np.uint32), *(x[a:b] for x in arrays))


def _undealt(packs, *kinds: str) -> list[np.ndarray]:
    """The row and arrays of many packs."""
    parts = [unpack(x, "<i8", "<u4", *kinds) for x in packs]
    if not parts:
        return [np.empty(0, k) for k in ("<i8", *kinds)]
    row, n, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
    return [np.repeat(row, n), *rest]


ANCHOR = ("<u4", "<i4", "<u4", "<u4", "u1")  # identifier's low half, place, run, load, shared by rows of the slice
PLACE = ("<i4", "<u4")  # place, run
CONTEXT = ("<i8", "<i4", "<u4", "u1")  # doc, place, run, surroundings of WIDTH bytes
SPAN = ("<i8", "<i4", "<i4")  # doc, start and end in a document


def _bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    return ((gram >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _table(rows) -> pa.Table:
    rows = list(rows)
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(PACK_ARROW.types)], schema=PACK_ARROW)


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["kind", "bucket", "data"]).astype({"kind": "int32", "bucket": "int32"})


def _texts(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow array as one array, and where its texts start, and the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.type != pa.binary():
        column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    begin = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[begin[0] : begin[-1]] if data is not None else np.empty(0, np.uint8)
    return data, begin - begin[0]


def find_anchors(buckets: int, groups: int, mask: np.uint64):
    """Map step: texts to ITEMS by anchor bucket, and to SHARED places where the slice itself shows
    that two rows share an anchor."""

    def slices(batch):
        data, begin = _texts(batch.column(1))
        row, at = np.asarray(batch.column(0)), 0
        while at < len(row):
            till = max(at + 1, int(np.searchsorted(begin, begin[at] + SLICE_BYTES, "right")) - 1)
            yield row[at:till], data[begin[at] : begin[till]], begin[at : till + 1] - begin[at]
            at = till

    def find(batches):
        for batch in batches:
            for rows, data, begin in slices(batch):
                found = anchors(data, begin, mask)
                if found is None:
                    continue
                place, run, gram = found
                own = np.searchsorted(begin, place, "right") - 1
                row, place = rows[own], (place - begin[own]).astype(np.int32)
                order = np.argsort(gram, kind="stable")
                starts = _starts(gram[order])
                least, most = np.minimum.reduceat(row[order], starts), np.maximum.reduceat(row[order], starts)
                shared, first = np.empty(len(order), bool), np.zeros(len(order), bool)
                shared[order] = _spread(least < most, starts, len(order))
                first[order[starts]] = True
                load = np.zeros(len(order), np.uint32)
                load[order[starts]] = np.add.reduceat(run[order], starts)
                send = ~shared | first
                run = run.astype(np.uint32)
                out = list(_dealt(SHARED, row[shared] % groups, row[shared], place[shared], run[shared]))
                row, place, run, gram, load, shared = (x[send] for x in (row, place, run, gram, load, shared))
                out += _dealt(ITEMS, _bucket(gram, buckets), row, gram.astype(np.uint32), place, run, load, shared.view(np.uint8))
                yield from _table(out).to_batches()

    return find


def form_buckets(groups: int, hot: int):
    """Group step over one initial bucket: SHARED places of anchors that several rows have, and the
    CROWDED anchors with their numbers of suffixes."""

    def form(pdf):
        if pdf["kind"].iloc[0] != ITEMS:
            return pdf
        row, gram, place, run, load, shared = _undealt(pdf["data"], *ANCHOR)
        order = np.argsort(gram, kind="stable")
        starts = _starts(gram[order])
        several = (np.minimum.reduceat(row[order], starts) < np.maximum.reduceat(row[order], starts)) | (np.maximum.reduceat(shared[order], starts) > 0)
        total = np.add.reduceat(load[order].astype(np.int64), starts)
        crowded = np.nonzero(several & (total > hot))[0]
        ask = np.empty(len(order), bool)
        ask[order] = _spread(several, starts, len(order))
        ask &= shared == 0  # the slice has sent those itself
        rows = list(_dealt(SHARED, row[ask] % groups, row[ask], place[ask], run[ask]))
        if len(crowded):
            rows.append((CROWDED, int(pdf["bucket"].iloc[0]), pack(gram[order[starts[crowded]]], total[crowded])))
        return _frame(rows)

    return form


def _all_places(place: np.ndarray, run: np.ndarray):
    """(index, place, run) of every item: runs become single places, but for the inner ones of a long
    run, whose surroundings are all the same byte."""
    long = np.nonzero(run > 2 * AROUND)[0]
    short = np.nonzero(run <= 2 * AROUND)[0]
    index = np.repeat(short, run[short])
    step = np.arange(len(index)) - np.repeat(np.cumsum(run[short]) - run[short], run[short])
    parts = [(index, place[index] + step, np.ones(len(index), np.uint32))]
    for i in long.tolist():
        n = int(run[i])
        edge = np.concatenate([np.arange(REACH), [REACH], np.arange(n - WINDOW, n)])
        length = np.ones(len(edge), np.uint32)
        length[REACH] = n - WINDOW - REACH
        parts.append((np.full(len(edge), i), place[i] + edge, length))
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _same_surroundings(around: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same surroundings, byte for byte."""
    wide = around.view("<u8")
    h = wide[:, 0].copy()
    for k in range(1, wide.shape[1]):
        h = combine(h, wide[:, k])
    order = np.lexsort((doc, h))
    starts = _starts(h[order])
    first = _spread(order[starts], starts, len(order))
    out = np.zeros(len(order), bool)
    later = doc[order] > doc[first]
    for at in range(0, len(order), 1 << 16):
        own, rep = order[at : at + (1 << 16)], first[at : at + (1 << 16)]
        out[own] = later[at : at + (1 << 16)] & (wide[own] == wide[rep]).all(axis=1)
    return out


def _settle(groups: int, row, doc, start, end):
    """SETTLED rows for spans, by group of documents; spans that touch become one."""
    order = np.lexsort((start, doc, row))
    row, doc, start, end = row[order], doc[order], start[order].astype(np.int32), end[order].astype(np.int32)
    if len(row):
        at = np.nonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])]))[0]
        end = np.maximum.reduceat(end, at)
        row, doc, start = row[at], doc[at], start[at]
    return _dealt(SETTLED, row % groups, row, doc, start, end)


def _by_windows(around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each item once for every window of it, as surroundings of that window alone: (index, surroundings)."""
    low, high = _range(around)
    column, index, out = np.arange(AROUND), [], []
    for k in range(REACH + 1):
        own = np.nonzero((low <= k) & (k <= high))[0]
        part = around[own]
        part[:, :AROUND] *= (column >= REACH - k) & (column < AROUND - k)
        part[:, AROUND], part[:, AROUND + 1] = k, WINDOW - k
        index.append(own)
        out.append(part)
    return np.concatenate(index), np.concatenate(out)


def _range(around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last of an anchor's windows: bytes of it before the anchor."""
    left, right = around[:, AROUND].astype(np.int64), around[:, AROUND + 1].astype(np.int64)
    return WINDOW - right, left


def find_contexts(buckets: int, groups: int, hot, mask: np.uint64):
    """Cogroup step over a group of documents and their SHARED places: surroundings by anchor bucket,
    and what the group settles itself."""

    def find(docs: pa.Table, places: pa.Table) -> pa.Table:
        row, place, run = _undealt(places.column("data").to_pylist(), *PLACE)
        if not len(row) or not len(docs):
            return _table([])
        data, begin = _texts(docs.column("text"))
        names, doc_of = docs.column("row").to_numpy(), docs.column("doc").to_numpy()
        order = np.argsort(row, kind="stable")
        row, place, run = row[order], place[order].astype(np.int64), run[order].astype(np.int64)
        parts, seen = [], set()
        for i, key in enumerate(zip(names.tolist(), doc_of.tolist(), strict=True)):
            a, b = np.searchsorted(row, key[0]), np.searchsorted(row, key[0], "right")
            if a < b and key not in seen:
                seen.add(key)
                index, at, length = _all_places(place[a:b], run[a:b])
                fits = at + length.astype(np.int64) - 1 + GRAM <= begin[i + 1] - begin[i]
                parts.append((np.full(int(fits.sum()), i), at[fits], length[fits]))
        if not parts:
            return _table([])
        own, place, run = (np.concatenate(x) for x in zip(*parts, strict=True))
        left, right = np.minimum(REACH, place), np.minimum(WINDOW, begin[own + 1] - begin[own] - place)
        around = np.zeros((len(own), WIDTH), np.uint8)
        padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(WINDOW, np.uint8)])
        around[:, :AROUND] = np.lib.stride_tricks.sliding_window_view(padded, AROUND)[begin[own] + place]
        around[:, AROUND], around[:, AROUND + 1] = left, right
        edge = np.nonzero((left < REACH) | (right < WINDOW))[0]
        column = np.arange(AROUND)
        around[edge, :AROUND] *= (column >= REACH - left[edge, None]) & (column < REACH + right[edge, None])
        gram = _gram_of(around, mask)
        bucket = _bucket(gram, buckets)
        row, doc = names[own], doc_of[own]
        crowded = np.isin(bucket.astype(np.uint64) << np.uint64(32) | (gram & np.uint64(0xFFFFFFFF)), hot.value)
        if crowded.any():
            index, windows = _by_windows(around[crowded])
            split = np.nonzero(crowded)[0][index]
            wide = windows.view("<u8")
            h = wide[:, 0].copy()
            for k in range(1, wide.shape[1]):
                h = combine(h, wide[:, k])
            keep = np.nonzero(~crowded)[0]
            around, bucket = np.concatenate([around[keep], windows]), np.concatenate([bucket[keep], _bucket(h, buckets)])
            row, doc, place, run = (np.concatenate([x[keep], x[split]]) for x in (row, doc, place, run))
        done = _same_surroundings(around, doc)
        start, end = place - around[:, AROUND], place + around[:, AROUND + 1] + run.astype(np.int64) - 1
        out = list(_settle(groups, row[done], doc[done], start[done], end[done]))
        send = ~done
        out += _dealt(ITEMS, bucket[send], row[send], doc[send], place[send].astype(np.int32), run[send].astype(np.uint32), around[send])
        return _table(out)

    return find


def _gram_of(around: np.ndarray, mask: np.uint64) -> np.ndarray:
    """Identifiers of the anchors of surroundings."""
    x = np.ascontiguousarray(around[:, REACH : REACH + GRAM]).view("<u8")
    return combine(combine(x[:, 0], x[:, 1]), x[:, 2]) & mask


def _refine(ids: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Bucket numbers of strings from those of a part and the 8-byte identifiers at a later offset."""
    order = np.lexsort((later, ids))
    a, b = ids[order], later[order]
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return out


def _least(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the smallest doc of its bucket, and whether the bucket has another one."""
    order = np.argsort(ids, kind="stable")
    starts = _starts(ids[order])
    low, high = np.minimum.reduceat(doc[order], starts), np.maximum.reduceat(doc[order], starts)
    least, several = np.empty(len(ids), np.int64), np.empty(len(ids), bool)
    least[order], several[order] = _spread(low, starts, len(ids)), _spread(low < high, starts, len(ids))
    return least, several


def repeated_windows(around: np.ndarray, doc: np.ndarray):
    """(item, bytes before the anchor) of every window of surroundings that a smaller document has too."""

    def eight(item, at):
        return np.ascontiguousarray(around[item, at : at + 8]).view("<u8")[:, 0]

    low, high = _range(around)
    item = np.arange(len(around))
    ids = np.zeros(len(item), np.int64)
    for at in range(REACH, REACH + GRAM, 8):
        ids = _refine(ids, eight(item, at))
    out = []
    # A node (a, b) stands for windows with a to b bytes before the anchor; they share the core from
    # REACH - a to AROUND - b.
    nodes = [(0, REACH, item, ids)]
    while nodes:
        a, b, item, ids = nodes.pop()
        inside = (low[item] <= b) & (high[item] >= a)
        item, ids = item[inside], ids[inside]
        if len(item) < 2:
            continue
        least, several = _least(ids, doc[item])
        if a == b:
            out.append((item[doc[item] > least], a))
            continue
        item, ids = item[several], ids[several]
        if not len(item):
            continue
        m = (a + b) // 2
        for first, last, starts in ((a, m, [AROUND - m - 8, AROUND - b]), (m + 1, b, [REACH - m - 1, REACH - a - 8])):
            # The bytes that the longer core adds, at most 16 of them; what else is read there it has anyway.
            own = ids
            for at in sorted(set(starts) if (b - m if last == m else m + 1 - a) > 8 else {starts[0]}):
                own = _refine(own, eight(item, at))
            nodes.append((first, last, item, own))
    return out


def refine_buckets(groups: int):
    """Group step over one bucket of surroundings: SETTLED spans of windows that a smaller document has."""

    def refine(pdf):
        if pdf["kind"].iloc[0] != ITEMS:
            return pdf
        row, doc, place, run, around = _undealt(pdf["data"], *CONTEXT)
        around = around.reshape(-1, WIDTH)
        place, run = place.astype(np.int64), run.astype(np.int64)
        done = _same_surroundings(around, doc)
        spans = [(np.nonzero(done)[0], (place - around[:, AROUND])[done], (place + around[:, AROUND + 1])[done])]
        left = np.nonzero(~done)[0]
        for item, before in repeated_windows(around[left], doc[left]):
            item = left[item]
            spans.append((item, place[item] - before, place[item] - before + WINDOW))
        item, start, end = (np.concatenate(x) for x in zip(*spans, strict=True))
        return _frame(_settle(groups, row[item], doc[item], start, end + run[item] - 1))

    return refine


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_REPORT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def remove(keep_text: bool):
    """Cogroup step: documents without their settled spans."""

    def cut_out(docs: pa.Table, spans: pa.Table) -> pa.Table:
        row, doc, start, end = _undealt(spans.column("data").to_pylist(), *SPAN)
        order = np.argsort(row, kind="stable")
        row, doc, start, end = row[order], doc[order], start[order], end[order]
        data, begin = _texts(docs.column("text"))
        removed, runs, digests, kept = [], [], [], []
        for i, (name, own) in enumerate(zip(docs.column("row").to_pylist(), docs.column("doc").to_pylist(), strict=True)):
            text = data[begin[i] : begin[i + 1]]
            a, b = np.searchsorted(row, name), np.searchsorted(row, name, "right")
            mine = np.nonzero(doc[a:b] == own)[0] + a
            n = 0
            if len(mine):
                change = np.zeros(len(text) + 1, np.int32)
                np.add.at(change, start[mine], 1)
                np.add.at(change, end[mine], -1)
                gone = np.cumsum(change[:-1]) > 0
                n = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                text = text[~gone]
            removed.append(int(begin[i + 1] - begin[i]) - len(text))
            runs.append(n)
            digests.append(hashlib.sha256(text).hexdigest())
            kept.append(text.tobytes() if keep_text else None)
        columns = [docs.column("doc_id").combine_chunks(), np.diff(begin), np.array(removed, np.int64), np.array(runs, np.int64), digests, kept]
        return pa.Table.from_arrays([pa.array(x, t) if not isinstance(x, pa.Array) else x.cast(t) for x, t in zip(columns, _REPORT.types, strict=True)], schema=_REPORT)

    return cut_out


def dedup(docs: DataFrame, keep_text: bool = True, hot: int = HOT, id_bits: int = 64) -> DataFrame:
    """docs(doc_id, text) as REPORT rows; kept holds the remaining bytes if keep_text.

    Identifiers of anchors keep id_bits bits; fewer make unequal strings meet and change no result."""
    spark = docs.sparkSession
    rows = docs.select(
        F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.col("text").cast("binary").alias("text"),
    )
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, groups = max(12, total // BUCKET_BYTES), max(12, total // GROUP_BYTES)
    mask = np.uint64(((1 << id_bits) - 1) << (64 - id_bits))
    parts = total // TASK_BYTES

    def dealt(df: DataFrame, *keys: str) -> DataFrame:
        """df by keys in as many partitions as the text asks for, where that is more than the session's number."""
        return df.repartition(parts, *keys) if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else df

    by_group = dealt(rows.withColumn("bucket", F.pmod("row", F.lit(groups)).cast("int")), "bucket").groupBy("bucket")

    def of(df: DataFrame, kind: int) -> DataFrame:
        return dealt(df.where(F.col("kind") == kind), "bucket")

    found = dealt(rows.select("row", "text").mapInArrow(find_anchors(buckets, groups, mask), PACK), "kind", "bucket")
    first = cut(found.groupBy("kind", "bucket").applyInPandas(form_buckets(groups, hot), PACK), "anchors")
    del found
    free_shuffles(spark)
    crowded = spark.sparkContext.broadcast(_crowded(first.where(F.col("kind") == CROWDED)))
    contexts = dealt(by_group.cogroup(of(first, SHARED).groupBy("bucket")).applyInArrow(find_contexts(buckets, groups, crowded, mask), PACK), "kind", "bucket")
    second = cut(contexts.groupBy("kind", "bucket").applyInPandas(refine_buckets(groups), PACK), "spans")
    del contexts
    free_shuffles(spark)
    return by_group.cogroup(of(second, SETTLED).groupBy("bucket")).applyInArrow(remove(keep_text), REPORT)


def _crowded(rows: DataFrame) -> np.ndarray:
    """Sorted names of the at most HOT_ANCHORS anchors with most suffixes; the choice shifts load only."""

    def spread(batches):
        for pdf in batches:
            for bucket, data in zip(pdf["bucket"], pdf["data"], strict=True):
                gram, n = unpack(data, "<u4", "<i8")
                yield pd.DataFrame({"name": (int(bucket) << 32) + gram.astype(np.int64), "n": n})

    best = rows.mapInPandas(spread, "name long, n long").orderBy(F.desc("n"), "name").limit(HOT_ANCHORS)
    return np.array(sorted(r["name"] for r in best.select("name").collect()), dtype=np.uint64)

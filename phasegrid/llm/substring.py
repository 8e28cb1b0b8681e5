"""Substring deduplication over fixed-length word windows.

Every window of `window` consecutive words gets a Rabin-Karp hash. Windows are dealt out by an
anchor: of the `gram`-word runs inside the window, the one with the least hash. Equal windows have
equal anchors, so all windows that could be equal meet under one anchor, while neighbouring windows
mostly share theirs and travel as one row (a run of 48-bit hashes beside a 64-bit anchor) instead of
one row each. A count of all anchors comes first: those with more than HOT_LEAST runs are dealt out
window by window through grouped minima, which combine before the shuffle, so no task ever gets all
windows of a passage that many documents share. A bitmap of bounded size says which anchors these are; an
anchor that shares a bit with one of them takes that way too, with the same result.
Windows of a smaller document win; the covered words merge into maximal intervals.

Defined results: null text has no words; a null doc_id counts as greater than any other and never
removes anything; rows that repeat a doc_id do not remove each other's words; fewer words than a
window: nothing is removed. Other columns are kept as they are, whatever their names; the operator's own
columns (n_words, n_removed, removed, kept) replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.store import cut, extended, packed, unpacked
from phasegrid.llm.tokens import U64, Words, mix, powers, ranges, slices, words_of

LAST = (1 << 63) - 1
#: Anchors with more runs than this take the way by single windows, at every size of the corpus.
HOT_LEAST = 4000
#: Bits of the map that tells them, at most (32 MB).
MAP_BITS = 1 << 28


def window_hashes(words: Words, size: int, seed: int) -> np.ndarray:
    """Rolling hash of the `size` words from each word on; entries that cross a document's end mean nothing."""
    h = words.hashes(seed)
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out, step, done = np.zeros(len(h) - size + 1, np.uint64), h, 0
    base, width = U64(0xC2B2AE3D27D4EB4F), 1
    # hash of 2n words = hash of the first n * base^n + hash of the next n
    for bit in range(size.bit_length()):
        if size >> bit & 1:
            out = out * powers(int(base), width + 1)[width] + step[done : done + len(out)]
            done += width
        if size >> (bit + 1):
            step = step[: len(step) - width] * powers(int(base), width + 1)[width] + step[width:]
            width *= 2
    return mix(out)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while width * 2 <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (size - width)], x[size - width :]) if size > width else x


def runs_of(words: Words, window: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows of one document that have the same anchor: document row, first word, number of windows, anchor, and all windows' hashes in order."""
    n_docs, count = len(words.doc) - 1, np.diff(words.doc)
    windows = np.maximum(count - window + 1, 0)
    empty = {k: np.zeros(0, np.int64) for k in ("row", "start", "n")} | {"anchor": np.zeros(0, np.uint64), "hash": np.zeros(0, np.uint64)}
    if not windows.sum():
        return empty
    at = ranges(words.doc[:-1], windows)
    anchor = sliding_min(window_hashes(words, gram, 11), window - gram + 1)[at]
    doc = np.repeat(np.arange(n_docs), windows)
    begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    n = np.diff(np.append(begin, len(at)))
    return {"row": doc[begin], "start": at[begin] - words.doc[doc[begin]], "n": n, "anchor": anchor[begin], "hash": window_hashes(words, window, 23)[at]}


def pack48(h: np.ndarray) -> np.ndarray:
    return h.view(np.uint8).reshape(-1, 8)[:, :6].ravel()


def unpack48(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.ravel().view(np.uint64)


def _binary(raw: np.ndarray, lengths: np.ndarray) -> pa.Array:
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(raw))])


def _covered(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals that cover the given ones."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def _hot_map(hot: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap (8 bits a byte) over the low bits of the anchors, with 16 bits an anchor up to MAP_BITS, and its length."""
    bits = min(MAP_BITS, max(1 << 16, 1 << (16 * hot.count()).bit_length()))
    place = F.col("anchor").bitwiseAND(F.lit(bits - 1))
    made = hot.select(F.shiftright(place, 15).alias("bucket"), place.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for r in made.collect():  # 4 kB for 32,768 bits
        out[r.bucket << 12 : (r.bucket + 1) << 12] = np.frombuffer(r.map, np.uint8)
    return out, bits


def repeated_runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Runs of windows whose words also start in a smaller document: (_key, _mark, start, n)."""
    spark = docs.sparkSession

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                a, n = np.unique(runs_of(words_of(part.column("text")), window, gram)["anchor"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    anchors = docs.select("text").mapInArrow(counts, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    anchors = cut(anchors.filter("n > 1"), "anchors")
    hot, bits = _hot_map(anchors.filter(F.col("n") > HOT_LEAST))
    told = spark.sparkContext.broadcast(hot)  # bits / 8 bytes

    def runs(batches: Iterator[pa.RecordBatch], single: bool) -> Iterator[pa.RecordBatch]:
        hot = told.value
        for batch in batches:
            for part in slices(batch, "text"):
                r = runs_of(words_of(part.column("text")), window, gram)
                key, mark = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_key", "_mark"))
                anchor = r["anchor"].view(np.int64)
                at_bit = anchor & (bits - 1)
                mine = (hot[at_bit >> 3] >> (at_bit & 7) & 1) == single
                if single:
                    first = np.cumsum(r["n"]) - r["n"]
                    n = r["n"][mine]
                    row, at = np.repeat(r["row"][mine], n), ranges(r["start"][mine], n)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(anchor[mine], n), r["hash"][ranges(first[mine], n)].view(np.int64), key[row], mark[row], at.astype(np.int32))], ["anchor", "hash", "_key", "_mark", "start"])
                else:
                    n, raw = r["n"], r["hash"]
                    if not mine.all():
                        raw, n = raw[np.repeat(mine, n)], n[mine]
                    row = r["row"][mine]
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[mine]), pa.array(key[row]), pa.array(mark[row]), pa.array(r["start"][mine].astype(np.int32)), _binary(pack48(raw), n * 6)], ["anchor", "_key", "_mark", "start", "hashes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor. What is held: the rows of one Arrow batch and of the anchor it ends in."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column(0).to_numpy()
            cut_at = int(np.searchsorted(anchor, anchor[-1]))
            if cut_at:
                yield from judge([*held, batch.slice(0, cut_at)])
                held = []
            held.append(batch.slice(cut_at))
        yield from judge(held)

    def judge(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        anchor, key, mark, start = (t.column(i).to_numpy() for i in range(4))
        begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(np.append(begin, len(anchor)))
        several = np.minimum.reduceat(key, begin) < np.maximum.reduceat(key, begin)
        rows = np.flatnonzero(np.repeat(several, size))
        if not len(rows):
            return
        blob = t.column(4).combine_chunks().take(pa.array(rows))
        blob = blob.combine_chunks() if isinstance(blob, pa.ChunkedArray) else blob
        off = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(rows) + 1]
        h = unpack48(np.frombuffer(blob.buffers()[2], np.uint8)[off[0] : off[-1]])
        n = np.diff(off) // 6
        group = np.repeat(np.repeat(np.arange(len(begin)), size)[rows], n)
        owner = np.repeat(key[rows], n)
        order = np.lexsort((owner, h, group))
        g, w, o = group[order], h[order], owner[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])])
        least = o[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = np.empty(len(order), bool)
        later[order] = o > least
        row, at = np.repeat(np.arange(len(rows)), n), ranges(start[rows].astype(np.int64), n)
        head = later & np.concatenate([[True], ~later[:-1] | (row[1:] != row[:-1])])
        tail = later & np.concatenate([~later[1:] | (row[1:] != row[:-1]), [True]])
        if head.any():
            src = rows[row[head]]
            yield pa.RecordBatch.from_arrays([pa.array(key[src]), pa.array(mark[src]), pa.array(at[head].astype(np.int32)), pa.array((at[tail] - at[head] + 1).astype(np.int32))], ["_key", "_mark", "start", "n"])

    rows = docs.select("text", "_key", "_mark")
    cold = rows.mapInArrow(lambda b: runs(b, False), "anchor long, _key long, _mark long, start int, hashes binary")
    found = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(meet, "_key long, _mark long, start int, n int")
    if hot.any():
        single = cut(rows.mapInArrow(lambda b: runs(b, True), "anchor long, hash long, _key long, _mark long, start int"), "hot")
        least = single.groupBy("anchor", "hash").agg(F.min("_key").alias("least"), F.max("_key").alias("most")).filter("least < most")
        later = single.join(least, ["anchor", "hash"]).filter("_key > least").select("_key", "_mark", "start", F.lit(1).alias("n"))
        found = found.unionAll(later)
    return found


def substring_dedup(docs: DataFrame, window: int = 50, gram: int = 8) -> DataFrame:
    """docs (doc_id, text, ...) plus n_words, n_removed (long), removed (intervals of word places, end excluded) and kept (the kept words, joined by one space)."""
    own = ("n_words", "n_removed", "removed", "kept")
    docs = docs.drop(*own)
    # the mark tells rows that share a doc_id apart by their text; equal rows have equal results
    marked = docs.select(packed(docs, "text"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_key"), F.xxhash64("text").alias("_mark"))
    found = repeated_runs(marked, window, gram)
    spans = found.groupBy("_key", "_mark").agg(F.collect_list(F.struct("start", "n")).alias("_runs"))
    joined = marked.join(spans, ["_key", "_mark"], "left").drop("_key", "_mark")

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                count, keep = np.diff(words.doc), np.ones(words.count, bool)
                runs = part.column("_runs")
                spans: list[list[tuple[int, int]]] = [[] for _ in range(part.num_rows)]
                for i in np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False)):
                    flat = runs[int(i)].values
                    s, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                    for a, b in zip(*_covered(s, s + n + window - 1)):
                        keep[words.doc[i] + a : words.doc[i] + b] = False
                        spans[i].append((int(a), int(b)))
                out, begin = words.joined(keep)
                kept = np.concatenate([[0], np.cumsum(keep)])[words.doc]
                raw, off = out.tobytes(), begin[kept]
                texts = [raw[a : max(a, b - 1)] for a, b in zip(off[:-1], off[1:])]
                arrays = [part.column("row"), part.column("text")]
                arrays += [pa.array(count), pa.array(count - np.diff(kept)), pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], SPANS), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "text", *own])

    SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    made = joined.mapInArrow(trim, extended(marked.select("row", "text").schema, "n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept string"))
    return made.select(*unpacked(docs.columns, "text"), *own)

"""Exact removal of repeated word spans by de Bruijn edges and path compaction.

Every ``k`` consecutive words are an edge of the word de Bruijn graph, named by
96 bits of hash.  An edge seen before, in (id, position) order, is repeated;
its source is its first place.  Repeated edges that follow each other in a text
and whose sources follow each other too form a nonbranching path; it is
compacted to one span with its source coordinates, and the words of all spans go.

Work is dealt in batches of documents (a hash of the id; ``batch_bytes`` of
text on average), and three passes use one exchange of the texts:

1. Each batch sends its distinct *minimisers* (smallest 8-word hash of an edge's
   words; equal edges have equal minimisers), about a seventh of its words, four
   bytes each.  Reducers return those that several batches share.
2. Edges are compared within the batch first.  A batch then sends the first
   place of each edge with a shared minimiser; reducers find the source of each
   and return compacted spans.  A group of copies costs one posting per batch
   and edge, so no key is hot.
3. Spans join their documents by batch, are merged, and cut.

Defined cases: null text has no words; a document of fewer than ``k`` words
keeps all; rows with equal id stand at the same place, so their edges at equal
positions do not remove each other; null ids come last and share a place;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.llm.common import WordHasher, mix

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LAST = np.iinfo(np.int64).max


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _A + right * _B + _B)


class Grams:
    """Hashes of every n consecutive entries of ``w``, by doubling."""

    def __init__(self, w: np.ndarray):
        self.have = {1: w}

    def doubled(self, size: int) -> np.ndarray:
        if size not in self.have:
            half = self.doubled(size // 2)
            self.have[size] = _join(half[:-size // 2], half[size // 2:])
        return self.have[size]

    def halves(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """What the n-gram hash joins: its largest power of two, and the rest."""
        a = 1 << ((size - 1).bit_length() - 1)
        left, right = self.doubled(a), self.of(size - a)
        n = len(self.have[1]) - size + 1
        return left[:n], right[a:a + n]

    def of(self, size: int) -> np.ndarray:
        return self.doubled(size) if size & (size - 1) == 0 else _join(*self.halves(size))


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= size:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[:len(x) - (size - reach)], x[size - reach:]) if reach < size else x


class Batch:
    """A batch of documents in (id, text) order."""

    def __init__(self, table):
        ids, texts = table.column("k").to_pylist(), table.column("t").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
        self.ids = [ids[i] for i in order]
        self.raws = [(texts[i] or "").encode("utf-8", "replace") for i in order]


class Edges(Batch):
    """The batch's edges: hash, check bits, minimiser, document and start of each."""

    def __init__(self, table, k: int, words: WordHasher):
        super().__init__(table)
        w, size = words.many(self.raws)
        n = len(w)
        self.place = np.array([_LAST if i is None else i for i in self.ids], np.int64)
        if n < k:
            empty = np.empty(0, np.int64)
            self.edge = self.least = empty.astype(np.uint64)
            self.check, self.row, self.start = empty.astype(np.uint32), empty, empty
            return
        row = np.repeat(np.arange(len(size)), size)
        start = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        whole = np.flatnonzero(row[:n - k + 1] == row[k - 1:])
        self.row, self.start = row[whole], start[whole]
        grams = Grams(w)
        left, right = grams.halves(k)
        self.edge = _join(left, right)[whole]
        self.check = (mix(left * _B ^ right * _A)[whole] >> np.uint64(32)).astype(np.uint32)
        least = min(8, k)
        # mixed again: smallest hashes are small, and their first bits deal them to buckets
        self.least = mix(_sliding_min(grams.of(least), k - least + 1)[whole])


def _sources(edge, check, place, start):
    """For each edge entry, the entry with the smallest (place, start) among equal edges."""
    source = np.arange(len(edge))
    order = np.argsort(edge)
    same = edge[order[1:]] == edge[order[:-1]]
    often = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    if len(often):
        often = often[np.lexsort((start[often], place[often], check[often], edge[often]))]
        e, c = edge[often], check[often]
        new = np.concatenate([[True], (e[1:] != e[:-1]) | (c[1:] != c[:-1])])
        source[often] = often[np.flatnonzero(new)][np.cumsum(new) - 1]
    return source


SPAN = np.dtype([("row", "<i4"), ("start", "<i4"), ("length", "<i4"), ("source", "<i8"), ("at", "<i4")])


def compact(row, start, source, at, length=None) -> np.ndarray:
    """Spans of edges that follow each other in a document while their sources do so, too."""
    length = np.ones(len(row), np.int64) if length is None else length
    order = np.lexsort((start, row))
    row, start, source, at, length = (x[order] for x in (row, start, source, at, length))
    cut = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + length[:-1])
                          | (source[1:] != source[:-1]) | (at[1:] != at[:-1] + length[:-1])]) if len(row) else np.empty(0, bool)
    first = np.flatnonzero(cut)
    out = np.empty(len(first), SPAN)
    out["row"], out["start"], out["source"], out["at"] = row[first], start[first], source[first], at[first]
    out["length"] = np.add.reduceat(length, first) if len(first) else 0
    return out


def remove_repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 20,
                          batch_bytes: int = 4 << 20, bucket_bytes: int = 4 << 20) -> DataFrame:
    """``(key, n_words, n_removed, kept, spans)`` per row: kept words joined by one space, and what went.

    A span is (start, length in words, source id, source start).
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_batches = int(size // batch_bytes) + 1
    buckets = 1 << max(5, int(size // bucket_bytes).bit_length())
    shift = np.uint64(64 - buckets.bit_length() + 1)
    own = docs.select(F.pmod(F.xxhash64(F.col(key).cast("long"), F.col(text)), F.lit(n_batches)).cast("int").alias("batch"),
                      F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    words = WordHasher()

    def short(least):
        return ((least << np.uint64(64 - int(shift))) >> np.uint64(32)).astype(np.uint32)

    def send_minimisers(batch_key, table):
        import pyarrow as pa
        least = np.unique(Edges(table, k, words).least)
        full, cut = np.unique(least >> shift, return_index=True)
        parts = np.split(least, cut[1:]) if len(full) else []
        return pa.table({"bucket": pa.array(full.astype(np.int32), pa.int32()),
                         "batch": pa.array([batch_key[0].as_py()] * len(full), pa.int32()),
                         "keys": pa.array([np.unique(short(x)).tobytes() for x in parts], pa.binary())})

    def shared_minimisers(table):
        import pyarrow as pa
        keys = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
        batch = np.repeat(table.column("batch").to_numpy(), [len(x) for x in keys])
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        flat, batch = flat[order], batch[order]
        same = flat[1:] == flat[:-1]
        often = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        flat, batch = flat[often], batch[often]
        order = np.argsort(batch, kind="stable")
        flat, batch = flat[order], batch[order]
        names, first = np.unique(batch, return_index=True)
        return pa.table({"batch": pa.array(names, pa.int32()),
                         "bucket": pa.array([table.column("bucket")[0].as_py()] * len(names), pa.int32()),
                         "keys": pa.array([x.tobytes() for x in np.split(flat, first[1:])] if len(names) else [], pa.binary())})

    def send_edges(batch_key, table, shared):
        import pyarrow as pa
        rows = []
        name = batch_key[0].as_py()
        if table.num_rows:
            b = Edges(table, k, words)
            source = _sources(b.edge, b.check, b.place[b.row], b.start)
            later = (b.place[b.row] != b.place[b.row[source]]) | (b.start != b.start[source])
            local = compact(b.row[later], b.start[later], b.place[b.row[source[later]]], b.start[source[later]])
            if len(local):
                rows.append((name % buckets, name, 1, local.tobytes(), b""))
            bucket = (b.least >> shift).astype(np.int64)
            keys = (bucket.astype(np.uint64) << np.uint64(32)) | short(b.least)
            wanted = [np.frombuffer(x, np.uint32).astype(np.uint64) | (np.uint64(n) << np.uint64(32))
                      for n, x in zip(shared.column("bucket").to_pylist(), shared.column("keys").to_pylist())]
            if wanted:
                sel = np.flatnonzero(~later & np.isin(keys, np.concatenate(wanted)))
                sel = sel[np.lexsort((sel, bucket[sel]))]
                edges = np.empty(len(sel), [("edge", "<u8"), ("check", "<u4")])
                edges["edge"], edges["check"] = b.edge[sel], b.check[sel]
                full, cut = np.unique(bucket[sel], return_index=True)
                for n, at, end in zip(full.tolist(), cut.tolist(), [*cut[1:].tolist(), len(sel)]):
                    s = sel[at:end]
                    new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1] + 1]) |
                                         (np.concatenate([[-1], b.row[s][:-1]]) != b.row[s]))
                    head = np.empty(len(new), SPAN)
                    head["row"], head["start"], head["at"] = b.row[s[new]], b.start[s[new]], 0
                    head["source"] = b.place[b.row[s[new]]]
                    head["length"] = np.diff(np.append(new, len(s)))
                    rows.append((n, name, 0, head.tobytes(), edges[at:end].tobytes()))
        schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("kind", pa.int8()), ("head", pa.binary()),
                            ("edges", pa.binary())])
        cols = list(zip(*rows)) if rows else [[], [], [], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def find_sources(table):
        import pyarrow as pa
        out_batch, out_spans = [], []
        batch, row, start, place, edges = [], [], [], [], []
        for name, kind, head, edge in zip(*(table.column(c).to_pylist() for c in ("batch", "kind", "head", "edges"))):
            if kind == 1:
                out_batch.append(name), out_spans.append(head)
                continue
            h = np.frombuffer(head, SPAN)
            n = h["length"]
            batch.append(np.full(n.sum(), name))
            row.append(np.repeat(h["row"], n)), place.append(np.repeat(h["source"], n))
            start.append(np.repeat(h["start"], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            edges.append(np.frombuffer(edge, [("edge", "<u8"), ("check", "<u4")]))
        if edges:
            batch, row, start, place, edges = (np.concatenate(x) for x in (batch, row, start, place, edges))
            source = _sources(edges["edge"], edges["check"], place, start)
            later = (place != place[source]) | (start != start[source])
            for name in np.unique(batch[later]).tolist():
                own = later & (batch == name)
                s = source[own]
                out_batch.append(name), out_spans.append(compact(row[own], start[own], place[s], start[s]).tobytes())
        return pa.table({"batch": pa.array(out_batch, pa.int32()), "spans": pa.array(out_spans, pa.binary())})

    result = T.StructType([
        T.StructField(key, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
            T.StructField("source_id", T.LongType()), T.StructField("source_start", T.LongType())])))])

    def cut_spans(batch_key, table, found):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type
        kind = [to_arrow_type(f.dataType) for f in result]
        b = Batch(table) if table.num_rows else None
        rows = [[], [], [], [], []]
        if b is not None:
            got = [np.frombuffer(x, SPAN) for x in found.column("spans").to_pylist()]
            s = np.concatenate(got) if got else np.empty(0, SPAN)
            s = compact(s["row"], s["start"], s["source"], s["at"], s["length"])
            edge = np.searchsorted(s["row"], np.arange(len(b.ids) + 1))
            for i, raw in enumerate(b.raws):
                own, words = s[edge[i]:edge[i + 1]], raw.split()
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, own["start"], 1)
                np.add.at(gone, own["start"] + own["length"] + k - 1, -1)
                kept = words
                if len(own):
                    kept = [words[j] for j in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                rows[0].append(b.ids[i]), rows[1].append(len(words)), rows[2].append(len(words) - len(kept))
                rows[3].append(b" ".join(kept).decode("utf-8", "replace"))
                rows[4].append([{"start": int(x["start"]), "length": int(x["length"]) + k - 1,
                                 "source_id": None if x["source"] == _LAST else int(x["source"]),
                                 "source_start": int(x["at"])} for x in own])
        return pa.table([pa.array(c, t) for c, t in zip(rows, kind)], names=result.fieldNames())

    keys = (own.groupBy("batch").applyInArrow(send_minimisers, "bucket int, batch int, keys binary")
            .groupBy("bucket").applyInArrow(shared_minimisers, "batch int, bucket int, keys binary"))
    spans = (own.groupBy("batch").cogroup(keys.groupBy("batch"))
             .applyInArrow(send_edges, "bucket int, batch int, kind tinyint, head binary, edges binary")
             .groupBy("bucket").applyInArrow(find_sources, "batch int, spans binary"))
    return own.groupBy("batch").cogroup(spans.groupBy("batch")).applyInArrow(cut_spans, result)

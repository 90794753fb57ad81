"""Sequence packing by non-negative least squares over length combinations.

Every document becomes token ids plus a closing id.  Full windows are sequences
of their own; the remainders (1..window-1 ids) are packed in groups of
``group_rows``: all combinations of two and of three present lengths that fill
the window exactly are enumerated, repeat counts are solved against the
group's length histogram by non-negative least squares (projected gradient on
the sparse incidence), rounded down to what is there, and the residual
remainders are packed greedily, longest first, cut at window borders.  What is
left of the last window is cut into powers of two, which need no padding; so
no sequence is padded at all.

One pass over the input, no shuffle: a task holds one document's ids and one
group of remainders (``group_rows * window`` ids at most), whatever the size of
its partition.  Equal lengths, hot sources and groups of copies cost nothing
extra.  A task that runs again reads the same split in the same order and gives
the same pieces.

Defined cases: null text counts as empty, a document of the closing id alone;
repeated ids or rows are documents of their own; ids may be null; an empty
table gives no pieces; further columns are ignored.

The ids are those of the ``tokenizers`` file; ``tiktoken`` computes them, as it
is three times as fast on the same merges (a text that holds a special token's
string goes through ``tokenizers`` itself).
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.slow = path, None
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items()
                 if word not in self.special}
        self.fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            if self.slow is None:
                from tokenizers import Tokenizer
                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.fast.encode_ordinary(text), "<u4")


def encoder(path: str | None) -> Encoder:
    """One encoder for each file and worker process (kept in tiktoken's own registry)."""
    import public_tokenizers
    from tiktoken.registry import ENCODINGS
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    key = f"hourcast:{path}"
    if key not in ENCODINGS:
        ENCODINGS[key] = Encoder(path)
    return ENCODINGS[key]


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c) with a <= b <= c of present lengths, or c = 0, that fill the window."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    low = lengths[lengths <= window // 2]
    pairs = low[have[window - low]]
    out = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], axis=1)]
    for a in lengths[lengths <= window // 3]:
        b = lengths[(lengths >= a) & (lengths <= (window - a) // 2)]
        b = b[have[window - a - b]]
        out.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(out)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 60) -> np.ndarray:
    """min |A x - histogram|, x >= 0, by accelerated projected gradient; A is combos' incidence."""
    n = len(histogram)
    target = histogram.astype(float)
    target[0] = 0

    def used(x):
        got = sum(np.bincount(combos[:, k], x, n) for k in range(combos.shape[1]))
        got[0] = 0
        return got

    def back(r):
        return sum(r[combos[:, k]] for k in range(combos.shape[1]))

    v = np.ones(len(combos))
    for _ in range(8):  # the largest eigenvalue bounds the step
        v = back(used(v))
        size = np.linalg.norm(v)
        v /= size
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(used(y) - target) / (1.05 * size))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def plan(lengths: np.ndarray, window: int) -> tuple[list[tuple[int, ...]], list[int]]:
    """Sequences as tuples of row numbers that fill the window, and the rows left over, longest first."""
    rows: list[list[int]] = [[] for _ in range(window + 1)]
    for i, n in enumerate(lengths.tolist()):
        rows[n].append(i)
    histogram = np.array([len(r) for r in rows])
    combos = combinations(np.flatnonzero(histogram), window)
    filled = []
    if len(combos):
        x = repeat_counts(combos, histogram)
        for k in np.argsort(-x, kind="stable").tolist():
            want = max(1, int(x[k] + 0.5)) if x[k] > 0.05 else 0
            if not want:
                break
            parts = [n for n in combos[k].tolist() if n]
            for _ in range(want):
                if any(len(rows[n]) < parts.count(n) for n in parts):
                    break
                filled.append(tuple(rows[n].pop() for n in parts))
    return filled, [i for n in range(window, 0, -1) for i in rows[n]]


def borders(total: int, window: int) -> list[int]:
    """Lengths of the sequences that take ``total`` ids: windows, then powers of two."""
    out = [window] * (total // window)
    rest = total % window
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pack_group(group: list, window: int, first: int):
    """Pieces (document, start, ids, doc_tokens, sequence, offset) of a group of remainders."""
    filled, rest = plan(np.array([len(g[2]) for g in group]), window)
    pieces, seq = [], first
    for members in filled:
        at = 0
        for i in members:
            key, start, ids, total = group[i]
            pieces.append((key, start, ids, total, seq, at))
            at += len(ids)
        seq += 1
    sizes = borders(sum(len(group[i][2]) for i in rest), window)
    k = at = 0
    for i in rest:
        key, start, ids, total = group[i]
        while len(ids):
            take = min(len(ids), sizes[k] - at)
            pieces.append((key, start, ids[:take], total, seq + k, at))
            ids, start, at = ids[take:], start + take, at + take
            if at == sizes[k]:
                k, at = k + 1, 0
    return pieces, seq + len(sizes)


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = 1024,
         tokenizer: str | None = None, closing_id: int = 0, group_rows: int = 4096) -> DataFrame:
    """One row per piece: key, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset."""
    if window & (window - 1) or window < 2:
        raise ValueError("window must be a power of two")
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
                           T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        enc = encoder(tokenizer)
        seq = TaskContext.get().partitionId() << 40  # numbers of a task's own
        arrow = pa.schema([(f.name, t) for f, t in zip(schema, key_types)])
        group: list = []
        pieces: list = []

        def out():
            cols = [[p[0] for p in pieces], [p[1] for p in pieces], [len(p[2]) for p in pieces],
                    [p[2].tobytes() for p in pieces], [p[3] for p in pieces], [p[4] for p in pieces],
                    [p[5] for p in pieces]]
            pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow.types)], schema=arrow)

        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                k, t = k.as_py(), t.as_py()
                ids = np.append(enc.ids(t or ""), np.uint32(closing_id)).astype("<u4")
                n, cut = len(ids), len(ids) // window * window
                for at in range(0, cut, window):
                    pieces.append((k, at, ids[at:at + window], n, seq, 0))
                    seq += 1
                    if len(pieces) >= group_rows:
                        yield out()
                if cut < n:
                    group.append((k, cut, ids[cut:].copy(), n))
                if len(group) >= group_rows:
                    more, seq = _pack_group(group, window, seq)
                    pieces.extend(more)
                    group = []
                if len(pieces) >= group_rows:
                    yield out()
        if group:
            more, seq = _pack_group(group, window, seq)
            pieces.extend(more)
        if pieces:
            yield out()

    from pyspark.sql.pandas.types import to_arrow_type
    key_types = [to_arrow_type(f.dataType) for f in schema]
    return docs.select(key, text).mapInArrow(run, schema)

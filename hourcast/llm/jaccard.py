"""N-gram Jaccard join by signature trees.

A document's set holds the hashes of its distinct n-word shingles.  Two sets
link when ``100 * |intersection| >= percent * |union|``; the join is exact (up
to collisions of 64-bit hashes) and finds every link between different sets.

1. *Forest roots.*  Sizes fall into classes such that linked sets lie in the
   same or in adjacent ones.  For a class with at most D different shingles
   between linked sets, the hash range is cut into P > D parts; linked sets
   then agree on P - D whole parts or more.  Each set sends one hash per part,
   for its own class and the next (one posting per hash and map batch).  A set
   that shares fewer of its hashes than that with all others together links
   with nothing and is done.  Components of the remaining sets over the hashes
   they share are the forests: no link leaves a forest.
2. *Signature trees.*  A forest's sets, ordered by size and smallest hash, are
   the leaves of a tree whose nodes hold OR-combined bitmaps and size ranges.
   Tree pairs are traversed together; a node pair is dropped when its size
   ranges exclude the threshold, when common bits plus hash collisions bound
   the overlap below what the smallest sizes need, or when all its leaves are
   linked already.  Leaf pairs that remain are compared exactly.
   A forest of more than ``chunk`` sets is cut into size-ordered chunks whose
   compatible pairs are worked on by different tasks.
3. Components over the verified links give the classes.

Equal sets share one digest and are handled once, so a group of copies of any
size is one leaf; the result lists a class id per document, never its pairs.

Defined cases: null or wordless text has the empty set and links with nothing;
rows with a null id are returned unlinked with a null class; repeated ids are
documents of their own with one id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourcast.llm.common import WordHasher, connected_components, mix, shared_table, union_find

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None, n: int, words: WordHasher) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles (ASCII lower case and white space)."""
    w, _ = words((text or "").encode("utf-8", "replace").lower())
    if not len(w):
        return w
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _M2 + w[k:len(w) - size + 1 + k]
        h ^= h >> np.uint64(30)
    return np.unique(mix(h))


def size_classes(limit: int, percent: int) -> list[int]:
    """Largest size of each class; a linked pair's classes differ by one at most."""
    tops = [0, 1]
    while tops[-1] < limit:
        tops.append(max(tops[-1] + 1, tops[-1] * 100 // percent))
    return tops


def parts_of(top: int, percent: int) -> tuple[int, int]:
    """(most shingles that differ between linked sets up to ``top``, number of hash-range parts)."""
    differ = (100 - percent) * 2 * top // (100 + percent)
    return differ, differ + 2 + differ // 7


def signatures(s: np.ndarray, percent: int, tops: list[int]) -> tuple[np.ndarray, int]:
    """One hash per hash-range part for the set's size class and the next one, and how many of
    them any linked set shares at least."""
    own = int(np.searchsorted(tops, len(s)))
    out, need = [], []
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s + _M1), dtype=np.uint64)])
    for c in (own, own + 1):
        differ, parts = parts_of(tops[c], percent)
        if not differ:
            continue  # only equal sets can link
        part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        last = np.append(first[1:], len(s))
        salt = np.uint64((c << 32) + 1)
        out.append(mix((sums[last] - sums[first]) ^ mix(part[first] + (salt << np.uint64(1)))))
        # at most `differ` parts differ; of the others, the empty ones are not sent
        need.append(len(first) - differ)
        if len(first) <= differ:  # an empty part may be all they share: those are sent, too
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[first])
            out.append(mix(mix(empty + (salt << np.uint64(1))) + _M2))
            need[-1] = 1
    return (np.concatenate(out), min(need)) if out else (np.empty(0, np.uint64), 1)


def digest(s: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    total = mix(np.sum(mix(s), dtype=np.uint64, keepdims=True) + np.uint64(len(s)))
    return int(total.astype(np.int64)[0])


class SignatureTree:
    """Leaves are sets; a node combines ``fan`` neighbours by OR and size range."""

    def __init__(self, sets: list[np.ndarray], bits: int = 8192, fan: int = 8):
        self.fan = fan
        size = np.array([len(s) for s in sets])
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for k, s in enumerate(sets):
            bit = s % np.uint64(bits)
            np.bitwise_or.at(maps[k], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        slack = size - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, size, size, slack)]
        while len(self.levels[-1][1]) > 1:
            m, lo, hi, sl = self.levels[-1]
            at = np.arange(0, len(lo), fan)
            self.levels.append((np.bitwise_or.reduceat(m, at, axis=0), np.minimum.reduceat(lo, at),
                                np.maximum.reduceat(hi, at), np.maximum.reduceat(sl, at)))

    def may_link(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether some leaf under node i and some leaf under node j can reach the threshold."""
        m, lo, hi, slack = self.levels[level]
        ok = (100 * hi[i] >= percent * lo[j]) & (100 * hi[j] >= percent * lo[i])
        k = np.flatnonzero(ok)
        common = np.bitwise_count(m[i[k]] & m[j[k]]).sum(axis=1).astype(np.int64) + np.minimum(slack[i[k]], slack[j[k]])
        ok[k] = (100 + percent) * np.minimum(common, np.minimum(hi[i[k]], hi[j[k]])) >= percent * (lo[i[k]] + lo[j[k]])
        return ok


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def spanning_links(sets: list[np.ndarray], percent: int, batch: int = 2048) -> list[tuple[int, int]]:
    """Links that connect all that the threshold connects, by dual traversal of the sets' tree."""
    order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), int(sets[k][0]), k))
    by_hash = sorted(range(len(sets)), key=lambda k: (int(sets[order[k]][0]), k))
    leaves = [sets[k] for k in order]
    tree = SignatureTree(leaves)
    found: list[tuple[int, int]] = []
    label = np.arange(len(sets))

    def compare(pairs):
        nonlocal label
        fresh = [(a, b) for a, b in pairs if label[a] != label[b] and links(leaves[a], leaves[b], percent)]
        if fresh:
            found.extend(fresh)
            label = np.array(union_find(len(sets), found))

    for a in range(0, len(by_hash) - 1, 256):  # neighbours by smallest hash first: most copies link here
        compare(list(zip(by_hash[a:a + 256], by_hash[a + 1:a + 257])))
    top = len(tree.levels) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > batch:
            stack.append((level, i[batch:], j[batch:]))
            i, j = i[:batch], j[:batch]
        width = tree.fan ** level
        at = np.arange(0, len(sets), width)
        low, high = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
        open_ = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
        i, j = i[open_], j[open_]
        keep = tree.may_link(level, i, j, percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level == 0:
            for k in range(0, len(i), 64):
                compare(list(zip(i[k:k + 64].tolist(), j[k:k + 64].tolist())))
            continue
        child = np.arange(tree.fan)
        a = (i[:, None, None] * tree.fan + child[None, :, None]) + np.zeros((1, 1, tree.fan), np.int64)
        b = (j[:, None, None] * tree.fan + child[None, None, :]) + np.zeros((1, tree.fan, 1), np.int64)
        a, b = a.ravel(), b.ravel()
        n = len(tree.levels[level - 1][1])
        good = (a < n) & (b < n) & ((a < b) if level == 1 else (a <= b))
        stack.append((level - 1, a[good], b[good]))
    return [(order[a], order[b]) for a, b in found]


def _forest_links(docs: DataFrame, n: int, percent: int, buckets: int, docs_per_batch: int) -> DataFrame:
    """Rows of kind 0 (a = id, b = digest, n, need), 1 (a = a hash that several sets share, b = one of
    these sets), 2 (n of a row with null id)."""
    bits = buckets.bit_length() - 1

    def emit(batches):
        import pyarrow as pa
        schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("a", pa.binary()), ("b", pa.binary()),
                            ("c", pa.binary()), ("d", pa.binary())])
        words, tops = WordHasher(), size_classes(1 << 12, percent)

        def flush(ids, sets, nulls):
            nonlocal tops
            names = np.array([digest(s) for s in sets], np.int64)
            sizes = np.array([len(s) for s in sets], np.int64)
            rows = [(2, b"", b"", np.array(nulls, np.int64).tobytes(), b"")] if nulls else []
            if len(sizes) and sizes.max() * 2 > tops[-1]:
                tops = size_classes(int(sizes.max()) * 2, percent)
            once = np.unique(names, return_index=True)[1]
            own = [k for k in once.tolist() if sizes[k]]
            sent = [signatures(sets[k], percent, tops) for k in own]
            sigs = [x for x, _ in sent]
            need = dict(zip(names[own].tolist(), (m for _, m in sent)))
            if ids:
                rows.append((0, np.array(ids, np.int64).tobytes(), names.tobytes(), sizes.tobytes(),
                             np.array([need.get(k, 1) for k in names.tolist()], np.int64).tobytes()))
            flat = np.concatenate(sigs) if sigs else np.empty(0, np.uint64)
            ref = np.repeat(names[own], [len(s) for s in sigs]) if sigs else np.empty(0, np.int64)
            order = np.lexsort((ref, flat))
            flat, ref = flat[order], ref[order]
            flat >>= np.uint64(32 - bits)  # bucket and 32 bits more name a hash
            new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, bool)
            if not new.all():  # shared inside the batch: all but the first are told here
                rows.append((1, flat[~new].astype(np.int64).tobytes(), ref[~new].tobytes(), b"", b""))
            out = [(int(names[0]) % buckets if len(names) else 0, *r) for r in rows]
            first = np.flatnonzero(new)
            several = (np.diff(np.append(first, len(flat))) > 1).astype(np.uint8)
            flat, ref = flat[first], ref[first]
            bucket, short = (flat >> np.uint64(32)).astype(np.int64), flat.astype(np.uint32)
            full, cut = np.unique(bucket, return_index=True)
            out += [(k, 3, *(x[at:end].tobytes() for x in (short, ref, several)), b"")
                    for k, at, end in zip(full.tolist(), cut.tolist(), [*cut[1:].tolist(), len(bucket)])]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

        ids, sets, nulls, held = [], [], [], 0
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                s = shingle_set(t.as_py(), n, words)
                if k.as_py() is None:
                    nulls.append(len(s))
                    continue
                ids.append(k.as_py()), sets.append(s)
                held += len(s)
                if len(ids) >= docs_per_batch or held > 4_000_000:
                    yield flush(ids, sets, nulls)
                    ids, sets, nulls, held = [], [], [], 0
        if ids or nulls:
            yield flush(ids, sets, nulls)

    def gather(table):
        import pyarrow as pa
        kinds = table.column("kind").to_numpy()
        out = {kind: ([], [], [], []) for kind in (0, 1, 2)}
        short, ref, several = [], [], []
        for kind, *blobs in zip(kinds.tolist(), *(table.column(v).to_pylist() for v in "abcd")):
            if kind == 3:
                short.append(np.frombuffer(blobs[0], np.uint32)), ref.append(np.frombuffer(blobs[1], np.int64))
                several.append(np.frombuffer(blobs[2], np.uint8))
                continue
            for into, v in zip(out[kind], blobs):
                into.append(np.frombuffer(v, np.int64))
        if short:
            sig, ref, several = np.concatenate(short), np.concatenate(ref), np.concatenate(several).astype(bool)
            order = np.lexsort((ref, sig))
            sig, ref, several = sig[order], ref[order], several[order]
            new = np.concatenate([[True], sig[1:] != sig[:-1]])
            group = np.cumsum(new) - 1
            # a group counts if it has two sets, or a batch has told of others
            start = np.flatnonzero(new)
            low, high = np.minimum.reduceat(ref, start), np.maximum.reduceat(ref, start)
            shared = (low != high) | np.logical_or.reduceat(several, start)
            once = np.concatenate([[True], (sig[1:] != sig[:-1]) | (ref[1:] != ref[:-1])])
            keep = shared[group] & once
            name = (np.int64(table.column("bucket")[0].as_py()) << np.int64(32)) | sig[keep].astype(np.int64)
            out[1][0].append(name), out[1][1].append(ref[keep])
        cols: list = [[] for _ in range(5)]
        for kind, parts in out.items():
            flat = [np.concatenate(p) if p else np.empty(0, np.int64) for p in parts]
            m = max(map(len, flat))
            for col, v in zip(cols, (np.full(m, kind, np.int8), *flat)):
                col.append(pa.array(v) if len(v) == m else pa.nulls(m, pa.int64()))
        return pa.table([pa.chunked_array(col) for col in cols], names=["kind", "a", "b", "n", "need"])

    sent = docs.mapInArrow(emit, "bucket int, kind tinyint, a binary, b binary, c binary, d binary")
    return sent.groupBy("bucket").applyInArrow(gather, "kind tinyint, a long, b long, n long, need long")


def _forests(found: DataFrame, leaves: DataFrame, rounds: int = 1) -> DataFrame:
    """``(id, component_id)`` of the sets that share enough hashes, over the hashes they share.

    Each round keeps the sets that share enough with those of the round before;
    the rounds only save work, as none of them can drop a linked set.
    """
    alive = found.filter("kind = 1").select(F.col("a").alias("hash"), F.col("b").alias("digest")).withColumn("root", F.col("digest"))
    need = leaves.select("digest", "need")
    for _ in range(rounds):
        enough = (alive.groupBy("digest").agg(F.count(F.lit(1)).alias("shared")).join(need, "digest")
                  .filter("shared >= need").select("digest"))
        kept = shared_table(alive.join(enough, "digest"), "alive")
        roots = (kept.groupBy("hash").agg(F.min("digest").alias("root"), F.max("digest").alias("last"))
                 .filter("root <> last").select("hash", "root"))
        alive = shared_table(kept.select("hash", "digest").join(roots, "hash"), "alive")
    return connected_components(alive.select(F.col("root").alias("src"), F.col("digest").alias("dst")))


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 4, percent: int = 85,
         chunk: int = 2000, docs_per_batch: int = 2000, bucket_bytes: int = 4 << 20) -> DataFrame:
    """``(key, n_shingles, component_id)`` for every row of ``docs``."""
    own = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    size = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = 1 << max(5, (size // bucket_bytes).bit_length())
    found = shared_table(_forest_links(own, n, percent, buckets, docs_per_batch), "forests")
    sets = found.filter("kind = 0").select(F.col("a").alias("k"), F.col("b").alias("digest"), "n")
    leaves = (found.filter("kind = 0").groupBy(F.col("b").alias("digest"))
              .agg(F.min("a").alias("k"), F.min("n").alias("n"), F.min("need").alias("need")))
    forest = _forests(found, leaves)
    member = shared_table(leaves.join(forest, leaves["digest"] == forest["id"])
                          .select("k", "digest", "n", F.col("component_id").alias("forest")), "members")
    counts = member.groupBy("forest").agg(F.count(F.lit(1)).alias("m"))
    # chunks of a large forest are runs of the size order, found from a histogram of sizes
    by_size = (member.join(counts.filter(F.col("m") > chunk), "forest").groupBy("forest", "n")
               .agg(F.count(F.lit(1)).alias("c")))
    before = F.sum("c").over(Window.partitionBy("forest").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    ranges = by_size.select("forest", "n", F.coalesce(before, F.lit(0)).alias("before"), "c")
    large = (member.join(ranges, ["forest", "n"]).select(
        "k", "digest", "n", "forest",
        F.floor((F.col("before") + F.pmod(F.col("digest"), F.col("c"))) / chunk).alias("chunk")))
    nodes = large.groupBy("forest", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    other = nodes.select("forest", F.col("chunk").alias("chunk2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = (nodes.join(other, "forest").filter("chunk <= chunk2")
             .filter(100 * F.col("hi") >= percent * F.col("lo2")).select("forest", "chunk", "chunk2"))
    # a chunk pair works on its union: a pair (c, c) only where no other pair holds the chunk
    alone = pairs.groupBy("forest", "chunk").agg(F.max("chunk2").alias("most")).filter("most = chunk")
    work = pairs.filter("chunk < chunk2").unionByName(
        alone.select("forest", "chunk", F.col("chunk").alias("chunk2"))
        .join(pairs.filter("chunk < chunk2").select("forest", F.col("chunk2").alias("chunk")).distinct(),
              ["forest", "chunk"], "left_anti"))
    sides = work.select("forest", F.concat_ws("-", "chunk", "chunk2").alias("task"),
                        F.explode(F.array_distinct(F.array("chunk", "chunk2"))).alias("chunk"))
    dealt = (large.join(sides, ["forest", "chunk"]).select("k", "digest", "forest", "task")
             .unionByName(member.join(counts.filter((F.col("m") > 1) & (F.col("m") <= chunk)), "forest")
                          .select("k", "digest", "forest", F.lit("").alias("task"))))

    def verify(table):
        import pyarrow as pa
        names, words, chosen, seen = [], WordHasher(), [], set()
        for name, t in zip(table.column("digest").to_pylist(), table.column("t")):
            if name in seen:
                continue
            s = shingle_set(t.as_py(), n, words)
            if digest(s) == name:  # an id can have rows of other texts
                seen.add(name), names.append(name), chosen.append(s)
        got = spanning_links(chosen, percent) if len(chosen) > 1 else []
        return pa.table({"src": pa.array([names[a] for a, _ in got], pa.int64()),
                         "dst": pa.array([names[b] for _, b in got], pa.int64())})

    verified = (own.join(dealt, "k").select("forest", "task", "digest", "t").groupBy("forest", "task")
                .applyInArrow(verify, "src long, dst long"))
    linked = connected_components(shared_table(verified, "links"))
    classed = sets.join(linked, sets["digest"] == linked["id"], "left").select(
        "k", "n", F.coalesce("component_id", "digest").alias("c"))
    # a table of its own, so that the join's exchanges are plain and AQE can split a hot class
    smallest = shared_table(classed.groupBy("c").agg(F.min("k").alias("component_id")), "smallest")
    result = classed.join(smallest, "c").select(
        F.col("k").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("k")).otherwise(F.col("component_id")).alias("component_id"))
    return result.unionByName(found.filter("kind = 2").select(
        F.lit(None).cast("long").alias(key), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))

"""Benchmark decontamination: a BM25 inverted index of test items searched by block-max WAND.

The test items are the indexed side and every training passage is a query.
Impacts are BM25 weights divided by the item's own total, so a passage that
holds all of an item's words scores 1 and one threshold serves all items.
Passages are word windows of two and a half times the longest item, half a
window apart: each stretch of a text of up to one and a quarter item lengths,
which has room for inserted words, lies whole in a passage.

Search is block-max WAND.  The block maxima of the distinct terms of all of a
document's passages are summed at once, and a (passage, block) whose sum stays
under the threshold is skipped whole.  In the others the lists run document at
a time with the block's maxima as bounds: pivot, move, and score fully only
what may pass.
Every (passage, item) at or above the threshold is then verified: at least
``overlap`` of the item's five-word shingles occur in the passage (an item
under five words counts as one), or a stretch of the passage is the item but
for changed, inserted or dropped words, ``1 - overlap`` of the item's length at
most.  At 0.8 that bears one such word in an item of five words, two in one of
ten, and so on.  The threshold is lowered to what those edits leave of the
weights, so the search loses nothing that stands up to verification.
Also, at least half of the words of the question and half of those of the
answer must be there, so a quoted question without its answer, or with another
one, is no leak.  The answer is the last line, or the last sentence of a
one-line item.

The index travels with the tasks; it is built of about ``shard_bytes`` of item text,
and a larger benchmark is worked off in shards.  A shard's matches are written
to the shared folder, by digest of the text, before the next shard is built.
Document frequencies are taken over all items before the split.

Defined cases: null and empty texts match nothing; null or wordless items
match nothing; equal items each report their own id; an empty benchmark leaves
all documents clean; long texts are cut into passages, never shortened; other
columns pass through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.llm.common import shared_table

_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
MATCH = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("overlap", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType()),
    T.StructField("start_word", T.LongType())]))


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_WORDS).split()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The item's words before and in its last line (or its last sentence, if it has one line)."""
    body = text.strip()
    cut = body.rfind("\n")
    if cut < 0:
        cut = max(body.rfind(mark, 0, len(body) - 1) for mark in (". ", "? ", "! ")) + 1
    q, a = words(body[:max(cut, 0)]), words(body[max(cut, 0):])
    return (q, a) if q else (a, a)


def shingles(seq: list[bytes], n: int = 5) -> set[tuple[bytes, ...]]:
    return {tuple(seq[i:i + n]) for i in range(max(1, len(seq) - n + 1))} if seq else set()


def edits(part: list[bytes], passage: list[bytes]) -> int:
    """Fewest words to change, insert or drop so that the part is a stretch of the passage (Myers, bit-parallel)."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(part):
        at[w] = at.get(w, 0) | 1 << i
    full, last = (1 << len(part)) - 1, 1 << len(part) >> 1
    more, less, score = full, 0, len(part)
    best = score
    for w in passage:
        same = at.get(w, 0)
        x = (((same & more) + more) ^ more) | same
        up, down = less | (full & ~(x | more)), more & x
        score += bool(up & last) - bool(down & last)
        best = min(best, score)
        up, down, x = up << 1 & full, down << 1 & full, same | less
        more, less = down | (full & ~(x | up)), up & x
    return best


def contained(part: list[bytes], passage: list[bytes], n: int = 5) -> float:
    """Share of the part that the passage holds: of its n-word shingles (the whole part, if shorter), or of its words in a row but for edits."""
    if not part:
        return 1.0
    own = shingles(part, n)
    size = min(n, len(part))
    there = {tuple(passage[i:i + size]) for i in range(len(passage) - size + 1)}
    share = len(own & there) / len(own)
    return share if share == 1 or len(part) < n else max(share, 1 - edits(part, passage) / len(part))


def present(part: list[bytes], passage: list[bytes]) -> float:
    """Share of the part's distinct words that the passage holds."""
    own = set(part)
    return len(own.intersection(passage)) / len(own) if own else 1.0


class ItemIndex:
    """Inverted lists (item, impact) by term, with maxima of ``block`` items and of the list."""

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], n: int, mean: float,
                 longest: int, block: int = 4, k1: float = 1.2, b: float = 0.75, shards: int = 1):
        self.shards = shards
        self.block, self.ids, self.seqs, self.parts, self.heaviest, lists = block, [], [], [], [], {}
        for item, text in sorted(items):
            seq = words(text)
            if not seq:
                continue
            weight = {t: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (k1 + 1)
                      / (tf + k1 * (1 - b + b * len(seq) / mean)) for t, tf in Counter(seq).items()}
            total = sum(weight.values())
            for t, w in weight.items():
                lists.setdefault(t, []).append((len(self.ids), w / total))
            self.ids.append(item)
            self.seqs.append(seq)
            self.parts.append(question_answer(text))
            self.heaviest.append(sorted((weight[t] / total / tf for t, tf in Counter(seq).items() for _ in range(tf)), reverse=True))
        self.stride = longest + longest // 4
        self.window = 2 * self.stride
        self.terms = {t: k for k, t in enumerate(lists)}
        self.items = [[i for i, _ in v] for v in lists.values()]
        self.impacts = [[w for _, w in v] for v in lists.values()]
        self.heads = np.array([max(w) for w in self.impacts])  # of whole lists
        self.block_max = []
        for at, w in zip(self.items, self.impacts):
            top: dict[int, float] = {}
            for i, x in zip(at, w):
                top[i // block] = max(top.get(i // block, 0.0), x)
            self.block_max.append(top)
        sizes = [len(m) for m in self.block_max]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.flat_block = np.array([k for m in self.block_max for k in m], np.int64)
        self.flat_max = np.array([x for m in self.block_max for x in m.values()])
        self.n_blocks = (len(self.ids) + block - 1) // block

    def promising(self, term_ids: np.ndarray, threshold: float, at_once: int = 256) -> Iterator[tuple[int, int]]:
        """(start of the passage, block) where the block's maxima sum up to the threshold.

        ``at_once`` passages are worked off together, whatever the text's length;
        a passage whose lists' maxima cannot sum up to the threshold is left out first.
        """
        goal, n_terms = threshold - 1e-9, len(self.items)
        for low in range(0, -(-len(term_ids) // self.stride), at_once):
            ids = term_ids[low * self.stride:(low + at_once + 1) * self.stride]
            at = np.flatnonzero(ids >= 0)
            own = at // self.stride  # a word lies in the passage that starts at its stride and in the one before
            here, before = own < at_once, own > 0
            pairs = np.unique(np.concatenate([own[here] * n_terms + ids[at][here], (own[before] - 1) * n_terms + ids[at][before]]))
            passage, term = pairs // n_terms, pairs % n_terms
            likely = np.bincount(passage, self.heads[term], at_once) >= goal
            passage, term = passage[likely[passage]], term[likely[passage]]
            if not len(passage):
                continue
            count = self.first[term + 1] - self.first[term]
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            entry = np.repeat(self.first[term], count) + offset
            names, place = np.unique(passage, return_inverse=True)
            sums = np.bincount(np.repeat(place, count) * self.n_blocks + self.flat_block[entry], self.flat_max[entry])
            for k in np.flatnonzero(sums >= goal).tolist():
                yield (low + int(names[k // self.n_blocks])) * self.stride, k % self.n_blocks

    def wand(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """All (item number, score) of the block with score >= threshold for a passage of these distinct terms."""
        goal, end = threshold - 1e-9, (block + 1) * self.block
        cursors = []
        for t in terms:
            top = self.block_max[t].get(block)
            if top is not None:
                k = bisect_left(self.items[t], block * self.block)
                cursors.append([self.items[t][k], k, t, top])
        found = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[3]
                if total >= goal:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            if cursors[0][0] == item:
                score = sum(self.impacts[c[2]][c[1]] for c in cursors[:pivot + 1])
                if score >= goal:
                    found.append((item, score))
                target, move = item + 1, cursors[:pivot + 1]
            else:
                target, move = item, [c for c in cursors[:pivot + 1] if c[0] < item]
            for c in move:
                own = self.items[c[2]]
                c[1] = bisect_left(own, target, c[1])
                c[0] = own[c[1]] if c[1] < len(own) else end
            cursors = [c for c in cursors if c[0] < end]
        return found

    def goal(self, threshold: float, overlap: float) -> float:
        """The threshold, or what is left of an item after the edits that ``overlap`` bears, if that is less."""
        return min([threshold, *(1 - sum(w[:int((1 - overlap) * len(seq) + 1e-9)]) for seq, w in zip(self.seqs, self.heaviest))])

    def matches(self, text: str, threshold: float, overlap: float) -> list[tuple]:
        """The text's verified items, each with its best passage."""
        seq = words(text)
        ids = np.fromiter(map(self.terms.get, seq, repeat(-1)), np.int64, len(seq))
        best: dict[int, tuple] = {}
        for start, block in self.promising(ids, threshold):
            part = ids[start:start + self.window]
            for k, score in self.wand(np.unique(part[part >= 0]).tolist(), block, threshold):
                passage = seq[start:start + self.window]
                share = contained(self.seqs[k], passage)
                if share < overlap - 1e-9:
                    continue
                q, a = (present(p, passage) for p in self.parts[k])
                if min(q, a) >= 0.5:
                    row = (self.ids[k], score, share, q, a, start)
                    if k not in best or (-score, start) < (-best[k][1], best[k][5]):
                        best[k] = row
        return [best[k] for k in sorted(best)]


def build_shards(items: DataFrame, text: str = "text", key: str = "item_id",
                 shard_bytes: int = 4 << 20) -> Iterator[ItemIndex]:
    """Indexes over all items with text, each of about ``shard_bytes`` of it at most.

    Statistics that need all items (document frequencies) are looked up for a
    shard's own terms only, so the driver holds one shard at a time.
    """
    rows = items.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("t"))).first()
    if not n:
        return
    shards = -(-size // shard_bytes)

    @F.pandas_udf("array<binary>")
    def split_words(series):
        return series.map(words)

    seqs = rows.withColumn("w", split_words("t")).filter(F.size("w") > 0)
    n, mean, longest = seqs.agg(F.count(F.lit(1)), F.avg(F.size("w")), F.max(F.size("w"))).first()
    if not n:
        return
    for s in range(shards):
        own = seqs.filter(F.pmod(F.xxhash64("k", "t"), F.lit(shards)) == s)
        part = [tuple(r) for r in own.select("k", "t").collect()]
        terms = own.select(F.explode(F.array_distinct("w")).alias("term")).distinct()
        df = {bytes(r[0]): r[1] for r in seqs.select(F.explode(F.array_distinct("w")).alias("term"))
              .join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1))).collect()}
        if part:
            yield ItemIndex(part, df, n, mean, longest, shards=shards)


def find_matches(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = 0.6,
                 overlap: float = 0.8, column: str = "matches") -> DataFrame:
    """``docs`` plus ``column``: the verified test items of each document (empty: clean)."""
    own = F.sha2(F.col(text).cast("binary"), 256)
    found = None
    for index in build_shards(items):
        goal = index.goal(threshold, overlap)

        @F.pandas_udf(MATCH)
        def search(series, index=index, goal=goal):
            import pandas as pd
            return pd.Series([index.matches(t, goal, overlap) if t else [] for t in series])

        if index.shards == 1:
            return docs.withColumn(column, search(F.col(text)))
        part = shared_table(docs.select(own.alias("__own"), F.explode(search(F.col(text))).alias("__found")).distinct(), "leaks")
        found = part if found is None else found.unionByName(part)
    none = F.array().cast(MATCH)
    if found is None:
        return docs.withColumn(column, none)
    found = found.groupBy("__own").agg(F.array_sort(F.collect_list("__found")).alias("__found"))
    joined = docs.withColumn("__text_own", own).join(found, F.col("__text_own") == F.col("__own"), "left")
    return joined.withColumn(column, F.coalesce("__found", none)).drop("__text_own", "__own", "__found")

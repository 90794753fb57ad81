"""The registered queries of the corpus operators (``opN_<name>``) and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.llm.common import documents, id_mod, shared_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourcast.llm import langid
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(id_mod("doc_id", 4) != 2))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (id_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourcast.llm import packing
    return packing.pack(documents(spark, sf_dir)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourcast.llm import linededup
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return linededup.remove_repeated_runs(docs).select(
        "doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


#: The kept text of ``documents`` by the rule of ``linededup`` with gram 2, window 2.
LINE_DEDUP_CTES = """
lines AS (
  SELECT doc_id, i, line, substr(md5(line), 1, 16) AS h, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS i FROM {docs} WHERE text IS NOT NULL)
  WHERE length(trim(line)) > 0),
around AS (
  SELECT doc_id, pos, i, h, lead(h) OVER w AS h1, lag(h) OVER w AS b1, lag(h, 2) OVER w AS b2, lead(h, 2) OVER w AS a1,
         lead(h, 3) OVER w AS a2, lag(i) OVER w AS ib1, lag(i, 2) OVER w AS ib2, lead(i) OVER w AS i1,
         lead(i, 2) OVER w AS ia1, lead(i, 3) OVER w AS ia2
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
grams AS (SELECT *, substr(md5(h || h1), 1, 16) AS fp FROM around WHERE h1 IS NOT NULL),
near AS (SELECT *, lag(fp) OVER w AS before, lead(fp) OVER w AS after FROM grams WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
prints AS (
  SELECT * FROM near WHERE (before IS NULL AND after IS NULL) OR fp < before OR fp <= after),
ranked AS (
  SELECT *, min({{'d': doc_id, 'p': pos, 'h': [b2, b1, a1, a2]}}) OVER (PARTITION BY fp) AS o FROM prints),
later AS (SELECT * FROM ranked WHERE NOT (doc_id = o.d AND pos = o.p)),
gone AS (
  SELECT DISTINCT doc_id, unnest([i, i1,
    CASE WHEN b1 = o.h[2] THEN ib1 END, CASE WHEN b1 = o.h[2] AND b2 = o.h[1] THEN ib2 END,
    CASE WHEN a1 = o.h[3] THEN ia1 END, CASE WHEN a1 = o.h[3] AND a2 = o.h[4] THEN ia2 END]) AS i FROM later),
cut AS (
  SELECT doc_id, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS kept
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS i FROM {docs} WHERE text IS NOT NULL) l
  LEFT JOIN (SELECT * FROM gone WHERE i IS NOT NULL) g USING (doc_id, i) GROUP BY doc_id)"""

ORACLE["op7_line_dedup"] = "WITH " + LINE_DEDUP_CTES.format(docs="documents") + """
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(c.kept, '')) END AS kept_md5
FROM documents d LEFT JOIN cut c USING (doc_id)"""


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourcast.llm import decontaminate
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_matches(documents(spark, sf_dir).select("doc_id", "text"), items)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


@query
def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourcast.llm import jaccard
    return jaccard.join(documents(spark, sf_dir))


@query
def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourcast.llm import vectordedup
    return vectordedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourcast.llm import toxicity
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.filter(id_mod("doc_id", 5) != 0).join(labels, "doc_id"))
    return toxicity.score(docs, model).select(
        "doc_id", (id_mod("doc_id", 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourcast.llm import quality
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(id_mod("doc_id", 5) != 0)
    model = quality.fit(docs, labels)
    return quality.score(docs, model).select(
        "doc_id", (id_mod("doc_id", 5) == 0).alias("held_out"), "text_score", "meta_score", "score",
        (F.col("score") >= 0.5).alias("kept"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourcast.llm import substring
    return substring.remove_repeated_spans(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE["op8_substring_dedup"] = """
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
edges AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS e FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min({'d': doc_id, 'i': i}) OVER (PARTITION BY e) AS f FROM edges)
  WHERE NOT (doc_id = f.d AND i = f.i)),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM later, range(20) AS r(j)),
kept AS (
  SELECT l.doc_id, count(g.i) AS n, string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY l.i) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words) l
  LEFT JOIN gone g USING (doc_id, i) GROUP BY l.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)"""


@query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourcast.llm import lm
    return lm.score(documents(spark, sf_dir), id_mod("doc_id", 7) != 2).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourcast.llm import secrets
    found = secrets.find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) AS long)").alias("n_" + kind) for kind in secrets.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"),
                        secrets.listed(F.col("spans")).alias("spans"))


def _secrets_sql() -> str:
    from hourcast.llm import secrets as s

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def located(name: str, pattern: str, group: int) -> str:
        p = text(pattern)
        return f"""{name} AS (
  SELECT r, i, x, m, sum(length(gap) + length(x)) OVER (PARTITION BY r ORDER BY i) AS e
  FROM (SELECT r, unnest(range(len(xs))) AS i, unnest(xs) AS x, unnest(ms) AS m, unnest(gaps[1:len(xs)]) AS gap
        FROM (SELECT r, regexp_extract_all(t, {p}, 0) AS xs, regexp_extract_all(t, {p}, {group}) AS ms,
                     string_split_regex(t, {p}) AS gaps FROM texts)))"""

    ctes = ["texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)"]
    taken = []
    for no, (kind, (pattern, group, least)) in enumerate(s.BASE.items()):
        pattern = pattern[pattern.index(")") + 1:] if kind == "assign" else pattern  # RE2 has no look-ahead
        ctes += [located(f"found_{kind}", pattern, group),
                 f"{kind} AS (SELECT r, e - length(x) AS s, {no} AS no, e, '{kind}' AS kind FROM found_{kind} WHERE length(m) >= {least})"]
        taken.append(f"SELECT * FROM {kind}")
    f = "[" + ", ".join(map(str, s.terms(s.WINDOW))) + "]"
    for no, (kind, (symbols, others, level)) in enumerate(s.CLASSES.items(), len(s.BASE)):
        pattern = "[" + "".join(c if c.isalnum() else "\\" + c for c in symbols + others) + f"]{{{s.WINDOW},}}"
        known = "lower(x)" if symbols == symbols.lower() else f"translate(x, '{others}', '{symbols[-len(others):]}')"
        ctes += [located(f"found_{kind}", pattern, 0), f"""windows_{kind} AS (
  SELECT r, e - length(x) AS s, x, w, substr({known}, w + 1, {s.WINDOW}) AS v
  FROM (SELECT *, unnest(range(length(x) - {s.WINDOW - 1})) AS w FROM found_{kind})), hits_{kind} AS (
  SELECT *, coalesce(w - lag(w) OVER (PARTITION BY r, s ORDER BY w) > {s.WINDOW}, true) AS first FROM windows_{kind}
  WHERE list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: {f}[length(v) - length(replace(v, c, '')) + 1]))
        <= {s.most_sum(s.WINDOW, level)}), spans_{kind} AS (
  SELECT r, s + min(w) AS s, s + max(w) + {s.WINDOW} AS e, substr(any_value(x), min(w) + 1, max(w) - min(w) + {s.WINDOW}) AS x
  FROM (SELECT *, sum(CAST(first AS INT)) OVER (PARTITION BY r, s ORDER BY w) AS island FROM hits_{kind}) GROUP BY r, s, island),
{kind} AS (
  SELECT r, s, {no} AS no, e, '{kind}' AS kind FROM spans_{kind} n
  WHERE NOT ({" OR ".join(f"regexp_matches(x, {text(a)})" for a in s.ALLOW)})
    AND NOT EXISTS (SELECT 1 FROM ({" UNION ALL ".join(taken)}) o WHERE o.r = n.r AND o.s < n.e AND n.s < o.e))"""]
        taken.append(f"SELECT * FROM {kind}")
    base = [f"'{k}'" for k in s.BASE]
    return f"""WITH {", ".join(ctes)}, found AS ({" UNION ALL ".join(taken)}),
joined AS (
  SELECT r, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{k[1:-1]}" for k in base)},
         string_agg(CASE WHEN kind IN ({", ".join(base)}) THEN concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)) END, ',' ORDER BY s, no) AS base,
         string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY s, no) AS spans FROM found GROUP BY r)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{k[1:-1]}, 0) AS BIGINT) AS n_{k[1:-1]}" for k in base)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN joined USING (r)"""


ORACLE["op13_secrets"] = _secrets_sql()


def crc32_sql(x: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of the UTF-8 bytes of ``x``."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    tab = "[" + ", ".join(map(str, table)) + "]::BIGINT[]"
    byte = ("(instr('0123456789ABCDEF', hex(encode({x}))[2 * i + 1]) - 1) * 16 "
            "+ instr('0123456789ABCDEF', hex(encode({x}))[2 * i + 2]) - 1").format(x=x)
    octets = f"list_transform(range(CAST(length(hex(encode({x}))) / 2 AS BIGINT)), lambda i: {byte})"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), "
            f"lambda a, b: xor(a >> 8, ({tab})[xor(a, b) % 256 + 1])), 4294967295::BIGINT)")


@query
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourcast.llm import resample
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    weighed = resample.weigh(documents(spark, sf_dir).select("doc_id", "text"), target)
    stored = shared_table(weighed.select("doc_id", "n_words", "n_features", "weight", "score"), "weighed")
    return resample.draw(stored).select("doc_id", "n_features", "weight", "score", "rank")


def _features_sql(table: str, key: str) -> str:
    """(r, w, f): the row, its words and one row per run of one or two words."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    return f"""{table}_words AS (
  SELECT row_number() OVER () AS r, {key} AS k, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM {table}),
{table}_features AS (
  SELECT r, unnest(w) AS f FROM {table}_words
  UNION ALL SELECT r, w[i] || ' ' || w[i + 1] FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM {table}_words))"""


ORACLE["op12_resampling"] = f"""WITH {_features_sql("documents", "doc_id")}, {_features_sql("benchmark", "item_id")},
named AS (
  SELECT f, {crc32_sql("f")} % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM (SELECT f FROM documents_features UNION ALL SELECT f FROM benchmark_features))),
corpus AS (SELECT bucket, count(*) AS s FROM documents_features JOIN named USING (f) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM benchmark_features JOIN named USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM corpus) + 10000 AS DOUBLE))
         / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM target) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM corpus LEFT JOIN target USING (bucket)),
sums AS (
  SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g FROM documents_features JOIN named USING (f) JOIN gains USING (bucket) GROUP BY r),
weighed AS (
  SELECT r, k AS doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features,
         coalesce((g - ((g % n) + n) % n) // n, 0) AS weight,
         CAST('0x' || substr(sha256('7:' || coalesce(CAST(k AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM documents_words LEFT JOIN sums USING (r)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN rank <= (SELECT count(*) FROM ranked) * 25 // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)"""


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with a fifth to a quarter of the rows dropped, emptied, stripped, repeated or reroled."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    lot = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    return rows.withColumn("lot", lot).filter("lot <> 0").select(
        "conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.expr("sequence(1, if(lot = 3, 2, 1))")).alias("copy")).drop("copy")


def repair_digests(edits: DataFrame) -> DataFrame:
    """One row per conversation of its edits, which stand together and in order; texts are hashed as they pass."""
    schema = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
              "audit string, repaired_sha256 string")

    def digest(batches):
        import hashlib
        import itertools

        import pyarrow as pa
        out = []
        rows = (r for batch in batches for r in stream_rows(batch))
        for conv, own in itertools.groupby(rows, key=lambda r: r[0]):
            faults, audit, sha, cost = [0, 0, 0, 0], [], hashlib.sha256(), 0
            illegal = turns = 0
            before = low = high = None
            kept = False
            for _, _, edit, initial, fault, turn, role, text in own:
                if edit is None:
                    continue
                audit.append(edit)
                cost += {"K": 0, "R": 1, "D": 2, "I": 5}[edit] + (5 if fault == 3 and edit != "D" else 0)
                if edit != "I":
                    faults[fault] += 1
                    illegal += before is not None and before + initial not in ("su", "ua", "au")
                    before = initial
                    if turn is not None and turn != high:  # in order of turn
                        turns, high = turns + 1, turn
                        low = turn if low is None else low
                if edit != "D":
                    sha.update(f"{chr(10) if kept else ''}{role}:{text}".encode())
                    kept = True
            gaps = high - low + 1 - turns if turns else 0
            out.append((conv, gaps, *faults[1:], int(illegal), cost, "".join(audit), sha.hexdigest()))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    import pyarrow as pa

    from hourcast.llm.repair import stream_rows
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.string() if "string" in f else pa.int64() for f in schema.split(", ")]
    return edits.mapInArrow(digest, schema)


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourcast.llm import repair
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_digests(repair.repair(damaged(conversations), conversations=conversations))


ORACLE["op11_conversation_repair"] = f"""WITH RECURSIVE
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
lots AS (SELECT * EXCLUDE name, {crc32_sql("name")} % 20 AS lot FROM named),
damaged AS (
  SELECT conv_id AS c, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
         CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM lots, (VALUES (1), (2)) AS copies(copy) WHERE lot <> 0 AND copy <= CASE WHEN lot = 3 THEN 2 ELSE 1 END),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text)) AS i, left(role, 1) AS ini FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS nth FROM numbered),
faulted AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN nth > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault FROM seen),
inserts(p, q, letters, price) AS (VALUES
  (0, 0, '', 0), (0, 2, 'I', 5), (0, 3, 'II', 10), (1, 1, '', 0), (1, 2, 'I', 5), (1, 3, 'II', 10),
  (2, 2, '', 0), (2, 3, 'I', 5), (3, 3, '', 0), (3, 2, 'I', 5)),
edits(q, ini, letter, r, price) AS (VALUES
  (0, 's', 'K', 1, 0), (0, 'u', 'K', 2, 0), (1, 'u', 'K', 2, 0), (3, 'u', 'K', 2, 0), (2, 'a', 'K', 3, 0),
  (0, NULL, 'R', 2, 1), (1, NULL, 'R', 2, 1), (2, NULL, 'R', 3, 1), (3, NULL, 'R', 2, 1),
  (0, NULL, 'D', 0, 2), (1, NULL, 'D', 1, 2), (2, NULL, 'D', 2, 2), (3, NULL, 'D', 3, 2)),
ways AS (
  SELECT p, r, e.ini, e.letter, letters || letter AS letters, s.price + e.price AS price FROM inserts s JOIN edits e USING (q)),
convs AS (SELECT DISTINCT conv_id AS c FROM conversations),
best AS (
  SELECT c, 0 AS i, 0 AS state, {{'cost': 0, 'audit': ''}} AS b FROM convs
  UNION ALL
  SELECT f.c, CAST(f.i AS INT), w.r, min({{'cost': b.b.cost + w.price + CASE WHEN f.fault = 3 AND w.letter <> 'D' THEN 5 ELSE 0 END,
                            'audit': b.b.audit || w.letters}})
  FROM best b JOIN faulted f ON f.c IS NOT DISTINCT FROM b.c AND f.i = b.i + 1
  JOIN ways w ON w.p = b.state AND (w.ini IS NULL OR w.ini = f.ini) AND (f.fault NOT IN (1, 2) OR w.letter = 'D')
  GROUP BY f.c, f.i, w.r),
sizes AS (
  SELECT convs.c, count(f.i) AS n, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM convs LEFT JOIN faulted f ON f.c IS NOT DISTINCT FROM convs.c GROUP BY convs.c),
pairs AS (
  SELECT c, count(*) AS illegal FROM (SELECT c, ini, lag(ini) OVER (PARTITION BY c ORDER BY i) AS before FROM faulted)
  WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au') GROUP BY c),
chosen AS (
  SELECT s.c, min({{'cost': b.b.cost + price, 'audit': b.b.audit || letters}}) AS b
  FROM sizes s JOIN best b ON b.c IS NOT DISTINCT FROM s.c AND b.i = s.n
  JOIN inserts t ON t.p = b.state AND t.q IN (0, 3) AND NOT (t.p = 0 AND t.q = 3) GROUP BY s.c),
letters AS (SELECT c, unnest(string_split(b.audit, '')) AS letter, unnest(range(1, len(b.audit) + 1)) AS j FROM chosen WHERE b.audit <> ''),
steps AS (
  SELECT c, j, letter, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY j) AS i,
         sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY j) AS k FROM letters),
out AS (
  SELECT s.c, s.j, s.letter, s.k, f.role, CASE WHEN s.letter = 'I' THEN '' ELSE f.text END AS text,
         max(CASE WHEN s.k = 1 AND s.letter = 'K' AND f.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.c) AS lead
  FROM steps s LEFT JOIN faulted f ON f.c IS NOT DISTINCT FROM s.c AND f.i = s.i WHERE s.letter <> 'D'),
texts AS (
  SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS t
  FROM out GROUP BY c)
SELECT s.c AS conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank, CAST(duplicate AS BIGINT) AS duplicate,
       CAST(truncated AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(ch.b.cost AS BIGINT) AS cost,
       ch.b.audit AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM sizes s JOIN chosen ch ON ch.c IS NOT DISTINCT FROM s.c LEFT JOIN pairs p ON p.c IS NOT DISTINCT FROM s.c
LEFT JOIN texts x ON x.c IS NOT DISTINCT FROM s.c"""

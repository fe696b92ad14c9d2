"""The registered queries of the operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, dialogue, language, lexical, line_rules, mixing, near_dup, ngram_bloom, secrets, sharding, surrogates, tokens, toxicity
from .base import documents

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op2_pivotal_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    narrow = docs.select("source", F.struct("doc_id").alias("key"), mixing.n_words(F.col("text")).alias("size"))
    return mixing.mixed(narrow).select(
        F.col("key.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


@query("op1_balanced_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.balanced_shards(sharding.narrow_documents(documents(spark, sf_dir)))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                       F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group")


@query("op10_credential_links")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.credential_spans(documents(spark, sf_dir))
    n = lambda k: F.size(F.filter("strong", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                       F.sha2(secrets.listed(F.col("strong")), 256).alias("base_sha256"),
                       secrets.listed(F.concat("strong", "linked")).alias("spans"), F.size("linked").cast("long").alias("n_linked"))


OP5_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 2 THEN list_transform(list_zip(ws[:-2], ws[2:]), lambda p: p[1] || ' ' || p[2])
                                        WHEN len(ws) = 1 THEN ws ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n, hash(list_sort(sh)) AS hs, sh FROM s),
r AS (SELECT min(doc_id) AS rep, n, hs, any_value(sh) AS sh FROM n WHERE n > 0 GROUP BY n, hs),
e AS (SELECT rep, n, unnest(sh) AS x FROM r),
f AS (SELECT x, count(*) AS df FROM e GROUP BY x HAVING count(*) > 1),
o AS (SELECT rep, n, e.x, row_number() OVER (PARTITION BY rep ORDER BY coalesce(df, 1), e.x) AS k FROM e LEFT JOIN f ON f.x = e.x),
p AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM o a JOIN o b ON a.x = b.x AND a.rep < b.rep
      WHERE a.k <= a.n - (a.n * 80 + 99) // 100 + 1 AND b.k <= b.n - (b.n * 80 + 99) // 100 + 1
        AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
j AS (SELECT p.a, p.b, len(list_intersect(x.sh, y.sh)) AS i, x.n + y.n AS t FROM p JOIN r x ON x.rep = p.a JOIN r y ON y.rep = p.b),
l AS (SELECT a, b FROM j WHERE 100 * i >= 80 * (t - i)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT rep AS a, rep AS b FROM r UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c.component_id, n.doc_id) AS component_id, coalesce(c.component_id, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN r ON r.n = n.n AND r.hs = n.hs LEFT JOIN c ON c.a = r.rep
"""


@query("op5_odd_sketches", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dup.near_duplicates(documents(spark, sf_dir), width=2)
    return rows.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query("op8_piece_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_BLANKS = "[\\x20\\x09-\\x0D]"
OP3_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS nr FROM t),
l1 AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY nr) > 1 AS seen, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n,
              length(line) - length(regexp_replace(line, '[|»›·]', '', 'g')) AS bars, length(line) - length(regexp_replace(line, '[#*$%&<>]', '', 'g')) AS signs
       FROM l0 WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
l2 AS (SELECT *, CASE WHEN regexp_matches(line, {_sql_text('(?i)' + line_rules._NAVIGATION.pattern)}) OR bars * 3 > n THEN 'navigation'
                      WHEN seen OR regexp_matches(line, {_sql_text('(?i)' + line_rules._BOILERPLATE.pattern)}) THEN 'boilerplate'
                      WHEN signs > {line_rules.SYMBOLS_PER_WORD} * n OR (n < {line_rules.FRAGMENT_WORDS} AND NOT regexp_matches(line, {_sql_text(line_rules._END.pattern)})) THEN 'punctuation' END AS fault FROM l1),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE seen) AS n_dup_lines, count(*) FILTER (WHERE fault = 'punctuation') AS n_punctuation,
             count(*) FILTER (WHERE fault = 'navigation') AS n_navigation, count(*) FILTER (WHERE fault = 'boilerplate') AS n_boilerplate,
             coalesce(sum(length(regexp_replace(line, '{_BLANKS}', '', 'g'))) FILTER (WHERE fault IS NULL), 0) AS good FROM l2 GROUP BY 1),
b AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '{_BLANKS}', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_punctuation, 0) AS n_punctuation,
             coalesce(n_navigation, 0) AS n_navigation, coalesce(n_boilerplate, 0) AS n_boilerplate, coalesce(good, 0) AS good
      FROM w LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEAT_PERCENT} * n_words) AND good >= {line_rules.KEEP_SHARE} * word_chars AS kept,
       n_lines, n_punctuation, n_navigation, n_boilerplate FROM b
"""


@query("op3_line_cleaning", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(documents(spark, sf_dir), ["doc_id"]).drop("clean_text")


@query("op6_aligned_leaks")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _remainder(n: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(-1))


@query("op9_folded_lexicon")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _remainder(5) > 0, ["doc_id"])
    return rows.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


@query("op4_cross_parsing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _remainder(4)
    rows = language.languages(documents(spark, sf_dir), (r >= 0) & (r != 2), ["doc_id"])
    return rows.select("doc_id", (r == 2).alias("held_out"), "lang_pred", "score", "bits")


@query("op7_surrogates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.with_surrogates(documents(spark, sf_dir))


OP11_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
l AS (SELECT doc_id, len(ts) AS n, ts FROM d),
g AS (SELECT count(*) AS cn, sum(n)::BIGINT AS cl FROM l WHERE n > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
v AS (SELECT DISTINCT t FROM q),
x AS (SELECT doc_id, n, unnest(ts) AS t FROM l),
p AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM x WHERE t IN (SELECT t FROM v) GROUP BY 1, 2, 3),
f AS (SELECT t, count(*) AS df FROM p GROUP BY 1),
w AS (SELECT t, floor(1000 * ln((2 * cn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM f, g),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * cn) // cl))))::BIGINT AS score
      FROM p JOIN w USING (t) JOIN q USING (t), g GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""


@query("op11_hybrid_search", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: One character of 16 for each turn after the damage; `step` are all edits of a turn with the inserts before it, by state.
OP12_SQL = """
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS c FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
k AS (SELECT c.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(id, ''), lambda x: ascii(x)::BIGINT)), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) % 20 AS kind FROM c, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
f AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN body[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
             CASE role[1] WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS ini FROM o),
g AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM f),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
             count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE prev IS NOT NULL AND (prev, ini) NOT IN ((1, 2), (2, 3), (3, 2))) AS illegal, max(i) AS n FROM g GROUP BY 1),
ins(p, l, q) AS (VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3), (2, '', 2), (2, 'I', 3), (2, 'II', 2), (3, '', 3), (3, 'I', 2), (3, 'II', 3)),
nxt(q, z) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
rowkind AS (SELECT ini.i AS ini, fl.f AS fault FROM range(4) ini(i), range(4) fl(f)),
step AS (SELECT ini, fault, p, q AS z, 3 * len(l) + 4 AS cost, l || 'D' AS tok FROM rowkind, ins
         UNION ALL SELECT ini, fault, p, nxt.z, 3 * len(l) + 3 + fault, l || 'R' FROM rowkind, ins JOIN nxt USING (q) WHERE fault IN (0, 3)
         UNION ALL SELECT ini, fault, p, ini, 3 * len(l) + fault, l || 'K' FROM rowkind, ins JOIN nxt USING (q) WHERE fault IN (0, 3) AND (ini = nxt.z OR ini = 1 AND q = 0)),
best AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, '000000000' AS b FROM n
         UNION ALL SELECT f.conv_id, f.i, s.z, min(printf('%09d', substr(b, 1, 9)::BIGINT + s.cost) || substr(b, 10) || s.tok)
         FROM best JOIN f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.i = best.i + 1 JOIN step s ON s.ini = f.ini AND s.fault = f.fault AND s.p = best.q GROUP BY 1, 2, 3),
e AS (SELECT conv_id, min(printf('%09d', substr(b, 1, 9)::BIGINT + CASE q WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END) || substr(b, 10) || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END) AS b
      FROM best JOIN n USING (conv_id) WHERE i = n.n GROUP BY 1),
a AS (SELECT conv_id, substr(b, 1, 9)::BIGINT AS cost, substr(b, 10) AS audit, len(replace(substr(b, 10), 'D', '')) AS m FROM e),
x AS (SELECT conv_id, audit, m, unnest(range(1, len(audit) + 1)) AS j FROM a),
y AS (SELECT conv_id, j, audit[j] AS ed, m, len(regexp_replace(audit[:j], '[D]', '', 'g')) AS nth, len(replace(audit[:j], 'I', '')) AS i FROM x),
l AS (SELECT y.conv_id, j, CASE WHEN ed = 'K' THEN f.role WHEN (nth + m) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN ed = 'I' THEN '' ELSE f.text END AS line
      FROM y LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM y.conv_id AND f.i = y.i WHERE ed <> 'D'),
h AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY j)) AS sha FROM l GROUP BY 1)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN n USING (conv_id) LEFT JOIN a USING (conv_id) LEFT JOIN h USING (conv_id)
"""


@query("op12_hirschberg_repair", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return dialogue.digests(dialogue.repair_edits(dialogue.damaged(turns)), turns.select("conv_id"))


@query("op13_log_frequency_filter")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = ngram_bloom.trained(docs, _remainder(10) > 0)
    return ngram_bloom.scored(docs, model, ["doc_id"]).select(
        "doc_id", (_remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")

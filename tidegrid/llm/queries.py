"""The queries of this subpackage: thin digests over the operators, whole tables each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact, langid, lines, minhash, mixing, pii, prefix_trie, quality, secrets, tokens, vectors
from .common import scratch_path, text_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, from a ledger that had seen half of the blobs before: the second run scans the rest and returns all."""
    docs, ledger = table(spark, sf_dir, "documents"), secrets.Ledger(spark, scratch_path(spark, "ledger"))
    ledger.scan(docs.where(F.crc32(text_of()) % 2 == 0), path_col="doc_id")
    result = ledger.scan(docs, path_col="doc_id")
    base = [r.kind for r in secrets.BASE_RULES]
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return result.select(
        F.col("path").alias("doc_id"), *map(count, base),
        F.sha2(secrets.spell(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        secrets.spell(F.col("found")).alias("spans"),
    )


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, shingles of 4 words."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    made = chat.format_chats(rows.unionByName(extra))
    back = chat.read_back(F.col("formatted"))
    learnt = chat.loss_text(F.col("formatted"), F.col("segments"))
    whole = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        F.col("conv").alias("conv_id"), F.size(back).cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item's best place and distance."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files."""
    return tokens.document_tokens(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; documents whose id's crc32 leaves 2 modulo 4 are never learnt from."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    made = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return made.select("doc_id", *map(count, pii.KINDS), F.sha2(secrets.spell(F.col("base")), 256).alias("base_sha256"), secrets.spell(F.col("found")).alias("spans"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document for the target mix."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines: how many lines went, and a digest of the rest."""
    docs = lines.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), out_col="rest")
    count = lambda c: F.when(F.col(c).isNotNull(), F.regexp_count(c, F.lit("\n")) + 1).otherwise(0).cast("long")
    return docs.select("doc_id", count("text").alias("n_lines"), F.when(F.length("rest") > 0, count("rest")).otherwise(0).cast("long").alias("n_kept"), F.length("rest").cast("long").alias("n_chars"), F.sha2("rest", 256).alias("rest_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner and group size of every document; the largest doc_id of equal texts stays."""
    return exact.exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document; labels whose id's crc32 leaves 0 modulo 5 are never learnt from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = quality.train(docs, labels.where(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings, 8 parts of 16 entries after 6 rounds."""
    return vectors.quantise(table(spark, sf_dir, "embeddings"))[0].drop("label")


OP9_SQL = """
WITH pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
lines AS (SELECT DISTINCT d.rowid AS r, source, line FROM (SELECT row_number() OVER () AS rowid, source, text FROM documents) d, unnest(string_split(text, chr(10))) AS u(line) WHERE trim(line) <> ''),
often AS (SELECT l.source, line FROM lines l JOIN pages p ON l.source IS NOT DISTINCT FROM p.source GROUP BY l.source, line, pages HAVING count(*) >= 2 AND count(*) > 0.1 * pages),
lists AS (SELECT source, list(line) AS gone FROM often GROUP BY source),
kept AS (SELECT doc_id, text, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, x)), chr(10)) END AS rest
 FROM documents d LEFT JOIN lists g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines,
 CASE WHEN length(rest) > 0 THEN len(string_split(rest, chr(10))) ELSE 0 END::BIGINT AS n_kept,
 length(rest)::BIGINT AS n_chars, sha256(rest) AS rest_sha256 FROM kept
"""
OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

# the checksum of the decimal id bit by bit, lowest first: DuckDB has no crc32
OP12_SQL = """
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, c::VARCHAR AS s FROM own),
conv AS (SELECT c, c - c % 100 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(8 * length(s)), lambda k: ((ascii(substr(s, (k // 8)::INTEGER + 1, 1)) >> (k % 8)::INTEGER) & 1)::BIGINT)),
  lambda x, b: xor(x >> 1, 3988292384::BIGINT * xor(x & 1, b))), 4294967295::BIGINT) % 6 AS h FROM ids),
heads AS (SELECT v.c, o.i, o.r, o.t FROM conv v JOIN own o ON o.c = v.base AND o.i <= v.h),
taken AS (SELECT c, count(*) AS n FROM heads GROUP BY c),
turns AS (SELECT * FROM heads UNION ALL SELECT o.c, coalesce(n, 0) + o.i - h, o.r, o.t FROM own o JOIN conv v USING (c) LEFT JOIN taken USING (c) WHERE o.i > h),
members AS (SELECT c, i AS d, list((r, t)) OVER (PARTITION BY c ORDER BY i) AS p, length(t) AS chars FROM turns UNION ALL SELECT c, 0, [], 0 FROM conv),
named AS MATERIALIZED (SELECT c, d, chars, min(c) OVER (PARTITION BY d, p) AS node, max(d) OVER (PARTITION BY c) AS last FROM members),
nodes AS MATERIALIZED (SELECT a.*, b.node AS parent FROM (SELECT d, node, count(*) AS n, max(chars) AS chars FROM named GROUP BY d, node) a LEFT JOIN named b ON b.c = a.node AND b.d = a.d - 1),
kids AS (SELECT d - 1 AS d, parent AS node, count(*) AS kids FROM nodes WHERE parent IS NOT NULL GROUP BY ALL),
below AS (SELECT a.d, a.node, sum((m.n - 1) * m.chars) AS saved, count(*) FILTER (k.kids IS NULL) AS leaves
  FROM nodes m LEFT JOIN kids k USING (d, node) JOIN named a ON a.c = m.node AND a.d <= m.d GROUP BY a.d, a.node),
ends AS (SELECT d, node, string_agg(c::VARCHAR, ',' ORDER BY c) AS ends FROM named WHERE d = last GROUP BY ALL)
SELECT m.node AS conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(kids, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes m LEFT JOIN kids USING (d, node) LEFT JOIN ends USING (d, node) JOIN below USING (d, node)
"""


def _op13_sql(rounds: int = vectors.ROUNDS) -> str:
    """Every round as two expressions: the nearest entries of all parts, and the floor means."""
    near = lambda k: f"""
near{k} AS MATERIALIZED (SELECT vec_id, p, min((far, e)) AS best FROM (
  SELECT vec_id, p, e, sum((x - c) * (x - c))::BIGINT AS far FROM parts JOIN books{k} USING (p, j) GROUP BY ALL) GROUP BY ALL)"""  # noqa: E731
    mean = lambda k: f"""
books{k + 1} AS MATERIALIZED (SELECT p, e, j, coalesce((s - ((s % n) + n) % n) // n, c)::BIGINT AS c FROM books{k} LEFT JOIN (
  SELECT p, best[2] AS e, j, sum(x)::BIGINT AS s, count(*) AS n FROM parts JOIN near{k} USING (vec_id, p) GROUP BY ALL) USING (p, e, j))"""  # noqa: E731
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({vectors.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, (k * {vectors.PARTS} // len(v)) AS p, k - (k * {vectors.PARTS} // len(v)) * (len(v) // {vectors.PARTS}) AS j, v[k + 1] AS x FROM kept, unnest(range(len(v))) AS u(k)),
books0 AS MATERIALIZED (SELECT p, e, j, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {vectors.ENTRIES}) USING (vec_id)),{",".join(near(k) + "," + mean(k) for k in range(rounds))},{near(rounds)},
digest AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM books{rounds}),
coded AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{rounds} GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest
"""


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_minhash, op3_chat_format, op4_decontaminate, op5_pii, op6_mixing, op7_token_counts, op8_language_id, op9_line_dedup, op10_exact_dedup, op11_quality, op12_prefix_trie, op13_vector_codes)}
ORACLE_SQL = {"op9_line_dedup": OP9_SQL, "op10_exact_dedup": OP10_SQL, "op12_prefix_trie": OP12_SQL, "op13_vector_codes": _op13_sql()}

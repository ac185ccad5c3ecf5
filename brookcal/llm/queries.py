"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookcal.llm import (
    collocations, decontamination, kdtree, language, mixing, packing, repeats, secrets, sharding, simhash, token_files, toxicity, trie,
)
from brookcal.session import scratch_path

SHARDS = 40
SHINGLE, DISTANCE = 4, 4
END_ID = 0
LONGEST = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def fold(of: int) -> Column:
    """crc32 of the document id as text, modulo ``of``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring fills every shard to its share of the rows: law ``rows``."""
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), DISTANCE, SHINGLE)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "positions", "places")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    model = language.train(docs, ~held_out)
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def _joined_spans(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in (*secrets.KINDS, "format")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["stop"])), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < len(secrets.KINDS))
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS)],
        F.sha2(_joined_spans(base).cast("binary"), 256).alias("base_sha256"), _joined_spans(F.col("spans")).alias("spans"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(5) == 0, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the spans removed from them, as ``start:end`` joined by commas; the others with none."""
    docs = table(spark, sf_dir, "documents")
    spans = repeats.repeated_spans(docs).groupBy("d_id", "d_tie").agg(
        F.count("*").alias("spans"), F.sum("units").alias("units"), F.sum("words").alias("words"),
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("found"),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("tie") == F.col("d_tie")), "left")
    return joined.select(
        "doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(f"removed_{c}") for c in ("spans", "units", "words")],
        F.coalesce(F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["start"], s["stop"])), ","), F.lit("")).alias("removed"),
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return token_files.read_token_files(spark, path)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("d_items", lambda i: i.cast("string")))
    hits = F.aggregate("d_hits", F.lit(0).cast("long"), lambda n, run: n + run[1] - run[0])
    return found.select(
        F.col("d_id").alias("doc_id"), F.col("d_words").alias("n_words"), hits.alias("n_hit"), F.size("d_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation begins with up to eight turns of the first of its five, as many as its id's checksum says."""
    paths = trie.turn_paths(table(spark, sf_dir, "conversations"))
    own, head = F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    heads = paths.where(own == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("head"))
    joined = paths.withColumn("base", F.col("conv_id") - own).withColumn("h", head.cast("int")).join(heads, "base", "left")
    after = F.slice("turns", F.col("h") + 1, F.size("turns"))
    before = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return trie.prefix_trie(joined.select("conv_id", F.concat(before, after).alias("turns")))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "packed")
    packing.write_packed(table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID, LONGEST)
    return packing.read_pieces(spark, path)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT k FROM windows),
spots AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
found AS (SELECT doc_id, i, k, item_id FROM spots JOIN windows USING (k, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, x -> floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

# the inner reduction is eight steps of the checksum's shift register, the outer one runs over the digits
OP11_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, substr(sha256(octet_length(encode(r)) || ':' || r || x), 1, 32)) AS p,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])),
        lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END))), CAST(4294967295 AS BIGINT)) % 9 AS h
  FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, coalesce(b.p[1:c.h], []) || c.p[c.h + 1:] AS p FROM o c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 5),
n AS (SELECT p[1:d] AS k, d, conv_id, len(p) = d AS ends FROM (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM r)),
g AS (SELECT k, max(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, count(*) FILTER (ends) AS n_ends,
    string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS e FROM n GROUP BY k),
c AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1),
f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN c USING (k)),
s AS (
  SELECT k[1:a] AS k, count(*) FILTER (n_children = 0) AS n_leaves,
    sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(k[depth].x)) END) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(f.e, '')) AS ends_sha256
FROM f JOIN s USING (k) LEFT JOIN g u ON f.depth > 0 AND u.k = f.k[1:f.depth - 1]
"""

OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 6) AS s(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a FROM f WHERE m > 1 AND f >= 100),
covered AS (
  SELECT DISTINCT s.lang, s.phrase FROM cand s JOIN cand b
  ON s.lang = b.lang AND s.m < b.m AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.a >= 100 * s.a),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand ANTI JOIN covered USING (lang, phrase))),
s AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_sharding, op2_simhash, op3_mixing, op4_top_k, op5_language, op6_secrets, op7_toxicity, op8_repeats,
        op9_token_files, op10_decontamination, op11_prefix_trie, op12_packing, op13_collocations,
    )
}
ORACLES: dict[str, str] = {"op4_top_k": OP4_SQL, "op10_decontamination": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op13_collocations": OP13_SQL}

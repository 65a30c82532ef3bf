"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, license, minhash, mix, quality, shard, suffix, vecdup


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix.plan(docs).select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, words=2, similarity=0.8)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return shard.shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.key_mod(F.col("doc_id"), 3) == 1
    langs, logs = langid.learn(docs.where(~held_out), "text", "lang", F.col("doc_id"))
    got = langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), langs, logs, "text", ["doc_id", "held_out"])
    return got.select("doc_id", "held_out", "lang_pred", "score")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = langid.key_mod(F.col("doc_id"), 5) == 0
    model = quality.learn(docs, _read(spark, sf_dir, "labels").select("doc_id", "quality"), "text", "doc_id", "quality", ~held_out)
    got = quality.rate(docs.select("doc_id", "text", held_out.alias("held_out")), model, "text", ["doc_id", "held_out"])
    return got.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def licence_paths(docs: DataFrame) -> DataFrame:
    """documents as files of a tree: source/<ten thousands>/<thousands>/<hundreds>/<doc_id>.txt; of every ten documents one is a licence file, in one of the
    upper directories of its own path by its number."""
    part = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    depth = (F.floor(F.col("doc_id") / 10) % 4 + 1).cast("int")
    dirs = F.array(F.coalesce("source", F.lit("unknown")), part(10_000), part(1000), part(100))
    file = F.concat(F.array_join(dirs, "/"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    notice = F.concat(F.array_join(F.slice(dirs, F.lit(1), depth), "/"), F.lit("/LICENSE-"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", "text", F.when(F.col("doc_id") % 10 == 0, notice).otherwise(file).alias("path"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return license.scan(licence_paths(docs))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def vocabulary() -> str:
    """Where the public tokenizers' package keeps the vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    got = bpe.encode(docs, vocabulary())
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix, op2_minhash, op3_neighbours, op4_shard, op5_language, op6_repeats, op7_quality, op8_license, op9_vectors, op10_bpe)}


def license_sql() -> str:
    """op8 for DuckDB, with the templates' weights as values."""
    by_kind = license.kinds()
    weights = ", ".join(f"('{kind}', '{w}', {v!r}::double)" for kind, (idf, _, _) in by_kind.items() for w, v in idf.items())
    templates = ", ".join(f"('{kind}', {i}, '{name}', '{w}', {x!r}::double)" for kind, (_, _, vectors) in by_kind.items() for i, (name, v) in enumerate(vectors) for w, x in v.items())
    other = ", ".join(f"('{kind}', {o!r}::double)" for kind, (_, o, _) in by_kind.items())
    passages = " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(words, '{w}')) AS words FROM whole" for w in license.windows())
    dirs = "[coalesce(source, 'unknown'), CAST(doc_id // 10000 AS varchar), CAST(doc_id // 1000 AS varchar), CAST(doc_id // 100 AS varchar)]"
    return rf"""WITH idf(kind, w, v) AS (VALUES {weights}), template(kind, t, name, w, x) AS (VALUES {templates}), other(kind, o) AS (VALUES {other}),
files AS (SELECT doc_id, text, CASE WHEN doc_id % 10 = 0 THEN array_to_string(list_slice({dirs}, 1, doc_id // 10 % 4 + 1), '/') || '/LICENSE-' || doc_id
  ELSE array_to_string({dirs}, '/') || '/' || doc_id || '.txt' END AS path FROM documents),
spoken AS (SELECT * FROM files WHERE regexp_matches(text, '{license.MENTION}|{license.OPENING[4:]}')),
segment AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!;])\s+', '\1' || chr(10), 'g'), chr(10))) AS s FROM spoken),
whole AS (SELECT doc_id, regexp_matches(path, '{license.LICENCE_FILE}') AS is_file, array_to_string(regexp_extract_all(lower(text), '{license.WORDS}'), ' ') AS words FROM spoken WHERE regexp_matches(path, '{license.LICENCE_FILE}') OR regexp_matches(text, '{license.OPENING}')),
unit AS (SELECT doc_id, 'line' AS kind, array_to_string(regexp_extract_all(lower(s), '{license.WORDS}'), ' ') AS words FROM segment WHERE regexp_matches(s, '{license.MENTION}')
  UNION ALL SELECT doc_id, 'file', words FROM whole WHERE is_file UNION ALL SELECT doc_id, 'window', words FROM ({passages}) q),
word AS (SELECT doc_id, kind, n, unnest(string_split(words, ' ')) AS w FROM (SELECT *, row_number() OVER () AS n FROM unit WHERE words <> '') q),
tf AS (SELECT doc_id, kind, n, w, count(*) AS k FROM word GROUP BY doc_id, kind, n, w),
length AS (SELECT n, sqrt(sum((k * coalesce(v, o)) ** 2)) AS size FROM tf JOIN other USING (kind) LEFT JOIN idf USING (kind, w) GROUP BY n),
dot AS (SELECT doc_id, n, kind, t, name, sum(k * v * x) AS d FROM tf JOIN idf USING (kind, w) JOIN template USING (kind, w) GROUP BY doc_id, n, kind, t, name),
score AS (SELECT doc_id, name, round(d / size, 9) AS score FROM dot JOIN length USING (n)),
best AS (SELECT doc_id, name, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name) AS r FROM score) q WHERE r = 1 AND score >= {license.THRESHOLD}),
file AS (SELECT files.doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, name, score FROM files LEFT JOIN best USING (doc_id)),
given AS (SELECT dir AS up, path AS p, name AS l, score AS s FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, path, name) AS r FROM file WHERE name IS NOT NULL AND regexp_matches(path, '{license.LICENCE_FILE}')) q WHERE r = 1),
above AS (SELECT dir, depth, array_to_string(list_slice(string_split(dir, '/'), 1, depth), '/') AS up FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS depth FROM (SELECT DISTINCT dir FROM file) q) q),
nearest AS (SELECT dir, p, l, s FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY depth DESC) AS r FROM above JOIN given USING (up)) q WHERE r = 1)
SELECT doc_id, path, coalesce(name, l) AS license, coalesce(score, s, 0.0) AS score, CASE WHEN name IS NOT NULL THEN 'notice' WHEN l IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
  CASE WHEN name IS NOT NULL THEN path ELSE p END AS license_path FROM file LEFT JOIN nearest USING (dir)"""


VECTORS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS double[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS r FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.r = link.a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, c = vec_id AS kept FROM embeddings JOIN (SELECT a, min(r) AS c FROM reach GROUP BY a) m ON m.a = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = vec_id"""


NEAR_SQL = r"""WITH RECURSIVE word AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) WHEN len(w) = 1 THEN w ELSE [] END AS s FROM word),
member AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM member a JOIN member b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common WHERE 100 * k >= 80 * (n + m - k)),
reach AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.r = link.a)
SELECT doc_id, CAST(coalesce(len(s), 0) AS bigint) AS n_shingles, c AS component_id, c = doc_id AS kept FROM sets JOIN (SELECT a, min(r) AS c FROM reach GROUP BY a) q ON q.a = doc_id"""

NEAREST_SQL = """WITH v AS (SELECT vec_id, CAST(embedding AS double[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS integer) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) t WHERE rank <= 5"""


REPEATS_SQL = r"""WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
string AS (SELECT doc_id, i, array_slice(b, i + 1, i + 50) AS g FROM (SELECT doc_id, b, unnest(range(0, greatest(0, octet_length(b) - 49))) AS i FROM bytes) q),
hit AS (SELECT doc_id, i FROM string JOIN (SELECT g, min(doc_id) AS first FROM string GROUP BY g) q USING (g) WHERE doc_id > first),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM hit) q) q GROUP BY doc_id, run),
piece AS (SELECT doc_id, a, z, hex(array_slice(b, last + 1, a)) AS p FROM (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS last FROM span) q JOIN bytes USING (doc_id)),
cut AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans, max(z) AS z, string_agg(p, '' ORDER BY a) AS head FROM piece GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS bigint) AS n_bytes, CAST(coalesce(removed, 0) AS bigint) AS n_removed, CAST(coalesce(spans, 0) AS bigint) AS n_spans,
  sha256(unhex(coalesce(head, '') || hex(array_slice(b, coalesce(z, 0) + 1, octet_length(b))))) AS kept_sha256 FROM bytes LEFT JOIN cut USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """Where SQL says the same within reason; the others are tested against brute force."""
    return {"op2_minhash": NEAR_SQL, "op3_neighbours": NEAREST_SQL, "op6_repeats": REPEATS_SQL, "op8_license": license_sql(), "op9_vectors": VECTORS_SQL}

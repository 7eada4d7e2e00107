"""The registered queries of this subpackage, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import annq, ctph, ego_join, mixing, ngram_join, outputs, periodic, pii, secrets, spm, tokencount, toxicity, words, yinyang
from quarry.llm.common import table

#: Where the vocabulary files lie; None: the installed public_tokenizers package.
TOKENIZERS: str | None = None


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled good documents weigh 2, bad ones a half, the others 1."""
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabularies=[vocabulary(f) for f in words.FILES])


def op2_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.link(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.train(docs))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spm.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", "ids_crc32", "round_trip")


def op7_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annq.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokencount.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2)


def op11_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.with_inertia(*yinyang.cluster(table(spark, sf_dir, "embeddings")))


def op12_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ctph.against_next(table(spark, sf_dir, "documents"))
    near = lambda c: ctph.likeness(F.col("fingerprint"), F.col(c))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))


def laced(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h the CRC-32 of the doc_id's digits and g a tenth of it, the texts where h ends in 0 go on from word g % n in
    the period 1 + (n - that) / (3 + g % 8). Rows without doc_id stay as they are."""
    at = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = at.select("doc_id", "text", F.expr("h div 10").alias("g"), F.when(F.col("h") % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    cut = cut.withColumn("a", F.expr("case when n > 0 then g % n end")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(w, (x, i) -> w[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return cut.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op13_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.find(laced(table(spark, sf_dir, "documents")))
    most = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("m"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", F.expr("-m.start").alias("start"), F.col("m.length").alias("length"), F.expr("-m.period").alias("period"), F.expr("1000 * m.length div -m.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_ego_join, op3_personal_data, op4_source_mix, op5_ngram_jaccard, op6_sentencepiece, op7_additive_search, op8_token_counts, op9_toxicity, op10_token_output, op11_yinyang_clusters, op12_piecewise_hash, op13_harmonic_runs)}



def _lloyd_sql(k: int = 8, rounds: int = 10) -> str:
    """Plain rounds over all vectors and centroids."""
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS MATERIALIZED (SELECT r, unnest(q) AS y, generate_subscripts(q, 1) AS i FROM v)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INT AS c, q AS m FROM v ORDER BY c LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, min({{'d': list_sum(list_transform(list_zip(q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c}}) AS b FROM v, c{i} GROUP BY r)")
        if i < rounds:
            parts.append(f"s{i} AS MATERIALIZED (SELECT b.c AS c, i, sum(y)::BIGINT AS s, count(*) AS n FROM x JOIN a{i} USING (r) GROUP BY ALL)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(any_value(f.m), any_value(o.m)) AS m FROM c{i} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{i} GROUP BY c) f USING (c) GROUP BY c)")
    n = rounds
    return f"""WITH {", ".join(parts)}, f AS (SELECT vec_id, b.c AS cluster, b.d AS distance FROM a{n} JOIN v USING (r))
 SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM f JOIN c{n} ON c = cluster"""


_CLOSURE = """e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
 c AS (SELECT id AS a, id AS b FROM n UNION SELECT c.a, e.j FROM c JOIN e ON c.b = e.i)"""
#: Exact operators; the others learn models, draw by hashes or stand on a library, and are tested against plain versions.
ORACLE: dict[str, str] = {
    "op11_yinyang_clusters": _lloyd_sql(),
    "op2_ego_join": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings),
 g AS (SELECT * FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
 n AS (SELECT id FROM v), l AS (SELECT a.id AS i, b.id AS j FROM g a JOIN g b ON a.id < b.id AND list_cosine_similarity(a.x, b.x) >= 0.9), {_CLOSURE},
 k AS (SELECT i, count(*) AS n_links FROM e GROUP BY i)
 SELECT a AS vec_id, coalesce(any_value(n_links), 0) AS n_links, min(b) AS component_id, a = min(b) AS kept FROM c LEFT JOIN k ON k.i = c.a GROUP BY a""",
    "op5_ngram_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 s AS (SELECT id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
 n AS (SELECT id, len(sh) AS size FROM s), x AS (SELECT id, unnest(sh) AS g FROM s),
 p AS (SELECT a.id AS i, b.id AS j, count(*) AS o FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
 l AS (SELECT i, j FROM p JOIN n a ON a.id = i JOIN n b ON b.id = j WHERE 100 * o >= 90 * (a.size + b.size - o)), {_CLOSURE}
 SELECT n.id AS doc_id, any_value(size) AS n_shingles, min(b) AS component_id FROM n JOIN c ON c.a = n.id GROUP BY n.id""",
}

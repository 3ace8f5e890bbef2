"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import annulus, bagminhash, bitplanes, bottomk, flac, langid_crf, line_templates, packing, rabitq, rollups, sentencepiece_lattice, tput, warc
from .common import drop_path, materialize
from .encoders import public_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), lambda: public_path("byte_bpe_50k.json"))


def op7_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = bitplanes.write_files(_table(spark, sf_dir, "documents"), lambda: public_path("word_bpe_49k.json"))
    return bitplanes.read_documents(files)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.digests(_table(spark, sf_dir, "documents"), lambda: public_path("piece_bpe_32k.model"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_crf.identify(_table(spark, sf_dir, "documents"))


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_boilerplate(docs)


def op4_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.corpus_rollup(_table(spark, sf_dir, "documents"))


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores and reads back the media of a few input files at a time, so that scratch space stays bounded.

    Text is noise to a linear predictor: its streams are about as large as itself. Every file's rows are
    processed; a wave's media are dropped once its digests are written.
    """
    files = _table(spark, sf_dir, "documents").inputFiles()
    step = max(1, -(-len(files) // 4))
    parts = []
    for i in range(0, len(files), step):
        media = flac.store(spark.read.parquet(*files[i : i + step]))
        parts.append(materialize(flac.describe(media), "flac-digests"))
        drop_path(spark, media.scratch_path)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_resolved(warc.write_archives(_table(spark, sf_dir, "pages")))


def op11_tput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tput.search(tput.build_lists(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op12_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op13_annulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus.cluster(_table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_sentencepiece": op1_sentencepiece, "op2_langid": op2_langid, "op3_linededup": op3_linededup, "op4_bottomk": op4_bottomk, "op6_bagminhash": op6_bagminhash, "op8_rollups": op8_rollups, "op9_flac": op9_flac, "op10_warc": op10_warc, "op5_packing": op5_packing, "op7_bitplanes": op7_bitplanes, "op11_tput": op11_tput, "op12_rabitq": op12_rabitq, "op13_annulus": op13_annulus}
_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _annulus_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Rounds written out one after the other."""
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, min(x) AS x FROM (SELECT vec_id, kept.v AS v, {{'d': list_sum(list_transform(range(1, {dims + 1}), lambda i: (kept.v[i] - o.v[i]) * (kept.v[i] - o.v[i]))), 'c': o.c}} AS x FROM kept, c{r} AS o) GROUP BY vec_id, v)")
        if r < rounds:
            parts.append(f"s{r} AS MATERIALIZED (SELECT x.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, {dims + 1})) AS i) GROUP BY ALL)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(any_value(w.v), any_value(o.v)) AS v FROM c{r} AS o LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c) AS w ON o.c = w.c GROUP BY o.c)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(x.c AS INTEGER) AS cluster, CAST(x.d AS BIGINT) AS distance, CAST(sum(x.d) OVER (PARTITION BY x.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(x.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(o.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS o ON o.c = x.c
"""


_PAYLOADS = "SELECT page_id, coalesce(html, '') AS payload, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages"

ORACLES: dict[str, str] = {
    "op8_rollups": r"""
WITH d AS (SELECT source, lang, coalesce(text, '') AS t, doc_id, min(doc_id) OVER (PARTITION BY md5(coalesce(text, ''))) AS first FROM documents),
     k AS (SELECT * FROM d WHERE doc_id = first),
     v AS (SELECT source, lang, 'words-v1' AS tokenizer, len(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+')) AS n FROM k
           UNION ALL SELECT source, lang, 'bytes-v1', strlen(t) FROM k)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM v GROUP BY ALL
""",
    "op11_tput": f"""
WITH b AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
     d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
     z AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t)) AS n_terms FROM d),
     p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY doc_id, term),
     w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, z GROUP BY term, n_docs),
     s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms))))) AS BIGINT) AS score
           FROM b JOIN p USING (term) JOIN w USING (term), z GROUP BY item_id, doc_id),
     r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
""",
    "op12_rabitq": """
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
     g AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = len(v)),
     l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g AS a JOIN g AS b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
           WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
     reach AS (SELECT a AS vec_id, b AS other FROM l UNION SELECT r.vec_id, l.b FROM reach AS r JOIN l ON r.other = l.a),
     low AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id),
     n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, least(e.vec_id, coalesce(other, e.vec_id)) AS component_id, e.vec_id <= coalesce(other, e.vec_id) AS kept
FROM e LEFT JOIN n ON e.vec_id = n.vec_id LEFT JOIN low ON e.vec_id = low.vec_id
""",
    "op13_annulus": _annulus_sql(),
    "op10_warc": f"""
WITH p AS ({_PAYLOADS}),
     f AS (SELECT digest, min(page_id) AS original FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN original < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original < page_id THEN original END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND n >= 100
""",
}

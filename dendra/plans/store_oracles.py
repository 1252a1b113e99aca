"""DuckDB SQL of the queries in ``store_queries``."""

from dendra.plans.oracles import ORACLES as _SEARCH
from dendra.plans.oracles import _EMB, _PAIRS_COS, _PAIRS_EUC, _STRIP, _ari_sql, _db_sql, _sil_sql, _tfidf_sql

_PUBMED = rf"""src AS (
  SELECT page_id AS p, page_id, regexp_extract(html, '<html lang="([^"]+)"', 1) AS topic,
         regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t,
         regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]+>', ' ', 'g') AS art,
         'https://pubmed.ncbi.nlm.nih.gov/' AS host FROM pages),
hits AS (
  SELECT page_id, topic, floor(p / 25)::INT AS query_no, (p % 25 + 1)::INT AS rank,
         CASE WHEN p % 7 = 0 THEN 'https://example.org/' || p WHEN p % 7 = 1 THEN host || 'about/'
              WHEN p % 7 = 2 THEN host || floor(p / 4)::BIGINT || '/?term=x' ELSE host || p || '/' END AS url,
         CASE WHEN p % 11 <> 0 THEN t || CASE WHEN p % 2 = 0 THEN ' - PubMed' ELSE '' END END AS title,
         CASE WHEN p % 13 = 0 THEN NULL
              WHEN p % 3 = 0 THEN '# Page' || chr(10) || chr(10) || '## Abstract' || chr(10) || chr(10) || art ||
                   CASE WHEN p % 2 = 0 THEN chr(10) || '## Keywords' || chr(10) || chr(10) || 'none' ELSE '' END
              WHEN p % 5 = 0 THEN '## Abstract' || chr(10) || chr(10) ELSE 'no heading' END AS content,
         CASE WHEN p % 17 = 0 THEN NULL WHEN p % 4 = 0 THEN 'short' ELSE art END AS description FROM src),
cl AS (
  SELECT *, split_part(url, '?', 1) AS url_clean,
         regexp_extract(split_part(url, '?', 1), 'pubmed\.ncbi\.nlm\.nih\.gov/(\d+)/?', 1) AS pmid,
         CASE WHEN contains(coalesce(content, ''), '## Abstract' || chr(10) || chr(10))
              THEN regexp_replace(regexp_extract(content, '(?s)## Abstract\n\n(.*?)(\n## |\z)', 1), {_STRIP}, '', 'g')
              WHEN length(regexp_replace(coalesce(description, ''), {_STRIP}, '', 'g')) > 80
              THEN regexp_replace(description, {_STRIP}, '', 'g') END AS abstract,
         regexp_replace(CASE WHEN suffix(coalesce(title, ''), ' - PubMed') THEN left(title, length(title) - 9)
                        ELSE coalesce(title, '') END, {_STRIP}, '', 'g') AS title_clean FROM hits),
valid AS (SELECT * FROM cl WHERE starts_with(url, 'https://pubmed.ncbi.nlm.nih.gov/') AND rank <= 20
          AND pmid <> '' AND abstract IS NOT NULL AND abstract <> ''),
firsts AS (SELECT * FROM valid
           QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY topic, query_no, rank) = 1)"""

_RUN = f"""{_EMB},
run AS (SELECT vec_id AS id, (CASE WHEN vec_id % 6 = 0 THEN -1 ELSE label END)::INT AS cluster,
               ((vec_id * 37) % 101) / 100.0::DOUBLE AS confidence, label, v FROM e WHERE vec_id % 9 <> 0)"""

_LABEL = "CASE WHEN {0} = -1 THEN 'NOISE' ELSE 'Cluster ' || {0}::VARCHAR END"

_METRICS = f"""{_RUN},
nz AS (SELECT id AS vec_id, v, cluster AS c FROM run WHERE cluster <> -1),
base AS (SELECT count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters, count(*) AS n_rows,
                count(*) FILTER (WHERE cluster = -1) AS n_noise,
                avg(CASE WHEN cluster <> -1 THEN confidence END) AS conf,
                count(*) FILTER (WHERE confidence < 0.5) AS n_low FROM run),
sil AS {_sil_sql('nz')},
db AS {_db_sql('nz')},
ar AS {_ari_sql('run', 'label', 'cluster')},
m AS (SELECT n_clusters::BIGINT AS n_clusters, round(100.0 * n_noise / n_rows, 1) AS noise_pct,
       CASE WHEN n_clusters >= 2 AND n_rows - n_noise > n_clusters THEN round(sil.silhouette, 4) END AS silhouette,
       CASE WHEN n_clusters >= 2 AND n_rows - n_noise > n_clusters THEN round(db.davies_bouldin, 4) END AS davies_bouldin,
       round(ar.ari, 4) AS ari, round(conf, 4) AS avg_membership_confidence,
       n_low::BIGINT AS n_low_confidence, round(100.0 * n_noise / n_rows, 1) < 15.0 AS noise_healthy
      FROM base, sil, db, ar)"""

_SWEEP = """res AS (
  SELECT p_partkey::BIGINT AS grid_pos, [2, 5, 10, 20, 40, 60][p_size % 6 + 1] AS umap_dims,
         [3, 5, 8, 10][p_size % 4 + 1] AS hdbscan_min_cs, ['eom', 'leaf'][p_partkey % 2 + 1] AS hdbscan_method,
         least(1.0::DOUBLE, (p_partkey * 7919 % 110) / 100.0::DOUBLE) AS ari,
         (p_partkey * 31 % 50) / 50.0::DOUBLE AS silhouette, (p_partkey % 40)::DOUBLE AS noise_pct FROM part)"""
_BEST = "ORDER BY ari DESC, silhouette DESC, noise_pct, grid_pos"

ORACLES = {
    "clean_hits": f"WITH {_PUBMED} SELECT page_id, pmid, url_clean, title_clean, abstract FROM valid",
    "unique_hits_total": f"""WITH {_PUBMED}
SELECT (SELECT count(*) FROM valid) AS n_hits, (SELECT count(*) FROM firsts) AS n_unique""",
    "articles_roundtrip": f"""WITH {_PUBMED}
SELECT pmid, title_clean AS title, abstract, topic AS category, url_clean AS url,
       NULL::DOUBLE AS relevance_score FROM firsts""",
    "dense_roundtrip": """
SELECT e.vec_id::VARCHAR AS id, len(embedding)::BIGINT AS dim,
       round(list_sum(embedding::DOUBLE[]), 6) AS total, d.lang AS category,
       left(coalesce(d.text, ''), 60) AS title, left(coalesce(d.text, ''), 500) AS abstract
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id""",
    "sparse_roundtrip": f"""WITH {_tfidf_sql('documents', 'doc_id', 'c')},
n AS (SELECT doc_id, count(*)::BIGINT AS nnz, round(sum(weight), 6) AS total FROM cw GROUP BY doc_id)
SELECT n.doc_id::VARCHAR AS id, nnz, total, d.lang AS category, left(d.text, 60) AS title
FROM n JOIN documents d USING (doc_id)""",
    "run_roundtrip": f"""WITH {_METRICS}
SELECT id, cluster, confidence, label, 'run1' AS run_id, 3 AS min_cluster_size, 'eom' AS method,
       m.n_clusters, m.noise_pct FROM run, m""",
    "cached_table": "SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY lang, source",
    "model_roundtrip": f"""WITH {_PAIRS_EUC},
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s, nbr_id) AS rk FROM p)
SELECT r.vec_id AS id, (CASE WHEN r.vec_id % 6 = 0 THEN -1 ELSE e.label END)::INT AS cluster,
       round(s, 6) AS core_distance FROM r JOIN e USING (vec_id) WHERE rk = 3 AND r.vec_id % 9 <> 0""",
    "stored_run_summary": f"""WITH {_RUN},
cc AS (SELECT cluster, label, count(*) AS n, min(id) AS first_pos FROM run GROUP BY ALL),
oo AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first_pos) AS rk FROM cc),
d AS (SELECT cluster, sum(n)::BIGINT AS size, max(CASE WHEN rk = 1 THEN label END) AS dominant,
             string_agg(printf('%s(%d)', label::VARCHAR, n), ', ' ORDER BY rk) AS distribution FROM oo GROUP BY cluster),
h AS (SELECT count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END)::BIGINT AS n_clusters,
             round(100.0 * count(*) FILTER (WHERE cluster = -1) / count(*), 1) AS noise_pct FROM run),
ar AS {_ari_sql('run', 'label', 'cluster')}
SELECT cluster, {_LABEL.format('cluster')} AS cluster_label,
       size, dominant, distribution, n_clusters, noise_pct, round(ar.ari, 4) AS ari FROM d, h, ar""",
    "stored_run_members": f"""WITH {_RUN},
t AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY confidence DESC, id) AS member_rank,
             count(*) OVER (PARTITION BY cluster) AS size FROM run WHERE cluster <> -1)
SELECT cluster, member_rank::BIGINT AS member_rank, id, round(confidence, 4) AS confidence,
       greatest(size - 5, 0)::BIGINT AS more FROM t WHERE member_rank <= 5""",
    "stored_run_composition": f"""WITH {_RUN},
cc AS (SELECT cluster, label, count(*) AS n, min(id) AS first_pos FROM run WHERE cluster <> -1 GROUP BY ALL),
oo AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first_pos) AS rk FROM cc),
d AS (SELECT cluster, sum(n)::BIGINT AS size, max(CASE WHEN rk = 1 THEN label END) AS dominant,
             string_agg(printf('%s(%d)', label::VARCHAR, n), ', ' ORDER BY rk) AS distribution FROM oo GROUP BY cluster),
t AS (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY confidence DESC, id) AS r FROM run)
SELECT d.*, l.top_members, greatest(size - 5, 0)::BIGINT AS more
FROM d JOIN (SELECT cluster, list(id ORDER BY r) AS top_members FROM t WHERE r <= 5 GROUP BY cluster) l USING (cluster)""",
    "stored_run_flags": f"""WITH {_RUN}
SELECT id, cluster, {_LABEL.format('cluster')} AS cluster_label, round(confidence, 4) AS confidence,
       confidence < 0.5 AS low_confidence FROM run""",
    "stored_run_metrics": f"WITH {_METRICS} SELECT * FROM m",
    "run_compare_missing": f"""WITH {_METRICS},
d AS (SELECT n_clusters::DOUBLE AS n_clusters, noise_pct, silhouette, davies_bouldin, ari,
             avg_membership_confidence FROM m),
u AS (SELECT * FROM d UNPIVOT INCLUDE NULLS (run_a FOR metric IN (n_clusters, noise_pct, silhouette,
      davies_bouldin, ari, avg_membership_confidence)))
SELECT metric, run_a, NULL::DOUBLE AS run_b FROM u""",
    "lookup_report": f"""WITH {_RUN},
sz AS (SELECT cluster, count(*) AS cluster_size FROM run GROUP BY cluster),
pr AS (SELECT a.id, b.id AS pid, row_number() OVER (PARTITION BY a.id ORDER BY b.confidence DESC, b.id) AS r
       FROM run a JOIN run b ON a.cluster = b.cluster AND a.id <> b.id WHERE a.cluster <> -1),
pl AS (SELECT id, list(pid ORDER BY r) AS peers FROM pr WHERE r <= 5 GROUP BY id),
sg AS (SELECT list(s ORDER BY s) AS l FROM (SELECT id::VARCHAR AS s FROM run ORDER BY s LIMIT 10))
SELECT q.vec_id AS id, run.id IS NOT NULL AS found, run.cluster, round(run.confidence, 4) AS confidence,
       run.cluster = -1 AS is_noise, sz.cluster_size::BIGINT AS cluster_size,
       coalesce(pl.peers, []::BIGINT[]) AS peers,
       CASE WHEN run.id IS NULL THEN sg.l ELSE []::VARCHAR[] END AS suggestions
FROM embeddings q LEFT JOIN run ON run.id = q.vec_id LEFT JOIN sz USING (cluster)
LEFT JOIN pl ON pl.id = run.id, sg""",
    "matches_with_clusters": f"""WITH {_PAIRS_COS},
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, nbr_id) AS rk FROM p),
run AS (SELECT vec_id AS id, CASE WHEN vec_id % 6 = 0 THEN -1 ELSE label END AS cluster,
               ((vec_id * 37) % 101) / 100.0::DOUBLE AS confidence FROM e WHERE vec_id % 9 <> 0)
SELECT vec_id, rk::BIGINT AS rank, nbr_id,
       CASE WHEN run.id IS NULL THEN '?' ELSE {_LABEL.format('run.cluster')} END AS cluster_label,
       round(run.confidence, 4) AS confidence
FROM r LEFT JOIN run ON run.id = r.nbr_id WHERE rk <= 5""",
    "named_clusters": f"""WITH {_RUN}
SELECT cluster, coalesce(max(r_name), 'Cluster ' || cluster::VARCHAR) AS name, count(*)::BIGINT AS size
FROM run LEFT JOIN region ON r_regionkey = cluster WHERE cluster <> -1 GROUP BY cluster""",
    "dense_sparse_misses": f"""WITH {_tfidf_sql('documents', 'doc_id', 'c')},
s AS (SELECT DISTINCT doc_id FROM cw),
j AS (SELECT e.vec_id AS a, s.doc_id AS b FROM embeddings e FULL JOIN s ON s.doc_id = e.vec_id)
SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n_both,
       count(*) FILTER (WHERE b IS NULL) AS n_only_a, count(*) FILTER (WHERE a IS NULL) AS n_only_b FROM j""",
    "upsert_partial": """
WITH latest AS (SELECT conv_id AS id, role, text FROM conversations WHERE turn >= 2
                QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
SELECT conv_id AS id, role, text FROM conversations
WHERE turn = 0 AND conv_id NOT IN (SELECT id FROM latest)
UNION ALL SELECT * FROM latest""",
    "sweep_best": f"""WITH {_SWEEP},
t AS (SELECT * FROM (SELECT 'all' AS list, * FROM res {_BEST} LIMIT 30)
      UNION ALL SELECT * FROM (SELECT 'dims=2' AS list, * FROM res WHERE umap_dims = 2 {_BEST} LIMIT 10))
SELECT t.*, (SELECT count(*) FROM res WHERE ari = 1.0) AS perfect, (SELECT count(*) FROM res) AS runs FROM t""",
}

ORACLES["articles_array"] = ORACLES["articles_roundtrip"]
ORACLES["run_results_read"] = f"""WITH {_RUN},
h AS (SELECT id // 1000 AS file_no, count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END)::INT AS n_clusters,
             round(100.0 * count(*) FILTER (WHERE cluster = -1) / count(*), 1)::DOUBLE AS noise_pct
      FROM run GROUP BY 1)
SELECT id::VARCHAR AS pmid, cluster, confidence, '}}], "' || label AS category,
       'run "' || file_no || '" {{[' AS model, 40 AS n_components, n_clusters, noise_pct
FROM run JOIN h ON h.file_no = id // 1000"""

ORACLES["stored_index_rows"] = """
SELECT vec_id, label, len(embedding)::BIGINT AS dim, round(embedding[1]::DOUBLE, 6) AS first,
       round(embedding[-1]::DOUBLE, 6) AS last FROM embeddings"""
ORACLES["stored_index_stats"] = """
SELECT count(*)::BIGINT AS n_vectors, min(len(embedding))::BIGINT AS min_dim,
       max(len(embedding))::BIGINT AS max_dim, count(DISTINCT label)::BIGINT AS n_values FROM embeddings"""
ORACLES["stored_index_search"] = _SEARCH["knn_filtered"]

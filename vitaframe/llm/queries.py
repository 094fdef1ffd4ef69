"""The queries of this subpackage and, where SQL can express one, the SQL that gives the same rows."""

from __future__ import annotations

from . import bpe_tables, decontamination, filter_audit, licenses, minhash, neighbours, secrets, sharding, substrings, token_counts, toxicity, urls, whitening


def license_base_places(spark, sf_dir):
    """What op6 says of the contract's own phrases, which SQL can tell."""
    return licenses.query(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def url_rules(spark, sf_dir):
    """What op4 says of hosts, paths and rules, which SQL can tell."""
    return urls.query(spark, sf_dir).select("page_id", "host", "path", "rule")


QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_token_counts": token_counts.query,
    "op3_secret_scan": secrets.query,
    "op4_url_filter": urls.query,
    "op5_embedding_dedup": neighbours.query,
    "op6_license_scan": licenses.query,
    "op7_minhash_dedup": minhash.query,
    "op8_toxicity": toxicity.query,
    "op9_substring_dedup": substrings.query,
    "op10_bpe_tables": bpe_tables.query,
    "op11_whitening": whitening.query,
    "op12_sharding": sharding.query,
    "op13_filter_audit": filter_audit.query,
    "license_base_places": license_base_places,
    "url_rules": url_rules,
}

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
NONSPACE = r"'[^\x20\x09-\x0D]+'"
#: From links(a, b) of both directions: the smallest id that each vertex reaches.
REACH = """reach(id, root) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.root = l.a),
part AS (SELECT id, least(id, min(root)) AS root FROM reach GROUP BY id)"""

ORACLES: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, {ALNUM}), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all({LOWER}, {ALNUM}), []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
m AS (SELECT doc_id, item_id, dw.n AS n, i FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM m, unnest(range(0, n)) AS t(o) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id),
terms AS (SELECT DISTINCT item_id, len(w) AS n, len(list_distinct(w)) AS need, unnest(list_distinct(w)) AS x FROM b WHERE item_id IS NOT NULL),
word AS (SELECT doc_id, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
close AS (SELECT doc_id, item_id, need, count(DISTINCT x) OVER (PARTITION BY doc_id, item_id ORDER BY i RANGE BETWEEN 2 * n - 1 PRECEDING AND CURRENT ROW) AS got FROM word JOIN terms USING (x)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close WHERE got = need GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id LEFT JOIN near ON d.doc_id = near.doc_id""",
    "op5_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{REACH}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept, CAST(1 AS DOUBLE) AS audited_recall
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON v.vec_id = c.a LEFT JOIN part ON v.vec_id = part.id""",
    "op7_minhash_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, {NONSPACE}), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
{REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN part ON d.doc_id = part.id""",
    "op9_substring_dedup": f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {NONSPACE}), []) AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS g FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
f AS (SELECT g, min(doc_id) AS m FROM g GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM g JOIN f ON g.g = f.g AND m < doc_id, unnest(range(0, 13)) AS t(o)),
word AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS k FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) c ON d.doc_id = c.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "license_base_places": f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, {ALNUM}), []) AS w FROM documents),
p(words, label) AS (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')),
m AS (SELECT doc_id, label, i FROM d, p, unnest(range(1, len(w) - len(words) + 2)) AS t(i) WHERE w[i : i + len(words) - 1] = words),
g AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS lo, max(i) - 1 AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
    "url_rules": """
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages), r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
s AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, len(raw) + 1), '^[^?#]*') AS path FROM h)
SELECT page_id, host, path, CASE
  WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/' END AS rule FROM s""",
    "op13_filter_audit": r"""
WITH RECURSIVE letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p(o, used, filter_order) AS (SELECT [f], bit, f FROM letters UNION ALL SELECT list_append(o, f), used + bit, filter_order || f FROM p, letters WHERE used & bit = 0 AND len(o) < 5),
steps AS (SELECT filter_order, s AS step, bit, coalesce((SELECT sum(x.bit) FROM letters x WHERE list_contains(o[1 : s - 1], x.f)), 0) AS before FROM p, unnest(range(1, 6)) AS t(s), letters WHERE len(o) = 5 AND f = o[s]),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
m AS (SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INT)
  + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > least, false) AS INT) AS mask FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
r AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, steps GROUP BY part, filter_order, step, bit),
h AS (SELECT part, bit, sum(removed) AS shapley FROM r GROUP BY part, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley FROM r JOIN h USING (part, bit)""",
}

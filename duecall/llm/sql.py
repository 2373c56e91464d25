"""DuckDB SQL for the operators whose result SQL can tell, written apart from the operators."""

from __future__ import annotations

# --- op12: whole-number k-means, every round spelled out --------------------------------------------

_ROUNDS = 5


def _nearest(centroids: str) -> str:
    """Nearest centroid of every vector by exact distance; ties to the smaller number."""
    return f"""SELECT row_id, vec_id, v, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
  FROM (SELECT row_id, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
        FROM ints, {centroids}) GROUP BY row_id, vec_id, v"""


def _round(i: int) -> str:
    return f"""near{i} AS MATERIALIZED ({_nearest(f"centroids{i}")}),
means{i} AS MATERIALIZED (
  SELECT cluster, list(m ORDER BY place) AS c FROM (
    SELECT cluster, place, (sum(x) // count(*) - CASE WHEN sum(x) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS m
    FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM near{i}) GROUP BY cluster, place)
  GROUP BY cluster),
centroids{i + 1} AS MATERIALIZED (
  SELECT o.cluster, coalesce(n.c, o.c) AS c FROM centroids{i} o LEFT JOIN means{i} n USING (cluster))"""


CLUSTERS = f"""WITH ints AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
centroids0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS cluster, v AS c
  FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM ints ORDER BY h, v LIMIT 40)
),
{", ".join(_round(i) for i in range(_ROUNDS))},
last AS MATERIALIZED ({_nearest(f"centroids{_ROUNDS}")})
SELECT vec_id, cluster, distance,
  sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM last JOIN centroids{_ROUNDS} USING (cluster)"""

# --- op13: importance resampling --------------------------------------------------------------------

_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
# CRC-32 with the polynomial 0xEDB88320, over the hexadecimal digits of the bytes
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UBIGINT)),
  lambda a, b: xor(a >> 8, t[((xor(a, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)"""
_STEP = "CASE WHEN ({x} & 1) = 1 THEN xor({x} >> 1, 3988292384::UBIGINT) ELSE {x} >> 1 END"

RESAMPLED = f"""WITH crc_table AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda j: j::UBIGINT)), lambda x, j: {_STEP.format(x="x")}) ORDER BY i) AS t
  FROM range(256) r(i)
),
doc_words AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
),
raw_words AS MATERIALIZED (SELECT row_id, unnest(w) AS word FROM doc_words),
target_words AS MATERIALIZED (SELECT unnest({_WORDS.format(text="coalesce(text, '')")}) AS word FROM benchmark),
raw_counts AS MATERIALIZED (SELECT word, count(*) AS n FROM raw_words GROUP BY word),
target_counts AS MATERIALIZED (SELECT word, count(*) AS n FROM target_words GROUP BY word),
vocabulary AS MATERIALIZED (
  SELECT word, {_CRC} % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM raw_counts UNION SELECT word FROM target_counts)), crc_table
),
s AS MATERIALIZED (SELECT bucket, sum(n) AS s FROM raw_counts JOIN vocabulary USING (word) GROUP BY bucket),
t AS MATERIALIZED (SELECT bucket, sum(n) AS t FROM target_counts JOIN vocabulary USING (word) GROUP BY bucket),
totals AS MATERIALIZED (
  SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS t_all
),
gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals
),
summed AS MATERIALIZED (
  SELECT row_id, sum(gain)::BIGINT AS total FROM raw_words JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY row_id
),
scored AS MATERIALIZED (
  SELECT row_id, doc_id, len(w)::BIGINT AS n_features,
    coalesce(floor(total::DOUBLE / nullif(len(w), 0)), 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS noise
  FROM doc_words LEFT JOIN summed USING (row_id)
),
placed AS MATERIALIZED (
  SELECT row_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS FIRST, weight DESC, n_features DESC) AS place,
    10 * count(*) OVER () // 100 AS k
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN place <= k THEN place END AS rank
FROM scored LEFT JOIN placed USING (row_id)"""

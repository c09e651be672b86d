"""DuckDB SQL of the queries that SQL can express."""

_TERMS = """
terms AS (
  SELECT 'tokens' AS tbl, row_id, batch_id, token AS term, frequency FROM tokens
  UNION ALL
  SELECT 'ngrams' AS tbl, row_id, batch_id, ngram AS term, frequency FROM ngrams),
held AS (SELECT DISTINCT * FROM terms WHERE term <> '' AND frequency IS NOT NULL),
counts AS (
  SELECT tbl, term, CAST(sum(frequency) AS BIGINT) AS occurrences, count(DISTINCT batch_id) AS records
  FROM held GROUP BY tbl, term),
batches AS (SELECT tbl, count(DISTINCT batch_id) AS all_batches FROM terms GROUP BY tbl),
marked AS (
  SELECT tbl, term, occurrences, records,
         CASE WHEN records < 3 THEN 'rare' WHEN records > 0.2 * all_batches THEN 'common' END AS mark
  FROM counts JOIN batches USING (tbl))
"""

_TOTALS = """
totals AS (
  SELECT ngram, CAST(sum(frequency) AS BIGINT) AS total
  FROM (SELECT DISTINCT row_id, ngram, frequency FROM ngrams WHERE ngram <> '' AND frequency >= 0)
  GROUP BY ngram ORDER BY total DESC, ngram LIMIT 50)
"""

_RECORDS = r"""
parsed AS (
  SELECT raw_id, record, CASE WHEN json_valid(record) THEN CAST(record AS JSON) END AS o,
         regexp_extract(record, '(?:^|\|)\s*candidate\s*=([^|]*)', 1) AS kc,
         trim(regexp_extract(record, '(?:^|\|)\s*measure\s*=([^|]*)', 1)) AS km,
         trim(regexp_extract(record, '(?:^|\|)\s*value\s*=([^|]*)', 1), ' "') AS kv
  FROM candidate_raw),
fields AS (
  SELECT 'candidate_terms' AS tbl, cand_id AS id, candidate, measure, value FROM candidate_terms
  UNION ALL
  SELECT 'candidate_raw', raw_id, o->>'candidate', o->>'measure', TRY_CAST(o->>'value' AS DOUBLE) FROM parsed WHERE o IS NOT NULL
  UNION ALL
  SELECT 'candidate_raw', raw_id, kc, km, TRY_CAST(kv AS DOUBLE) FROM parsed
  WHERE o IS NULL AND kc <> '' AND km <> ''),
keyed AS (
  SELECT tbl, id, measure, value,
         lower(regexp_replace(nfc_normalize(candidate), '[^\p{L}\p{N}]', '', 'g')) AS k
  FROM fields WHERE candidate IS NOT NULL AND value IS NOT NULL),
classes AS (
  SELECT tbl, id, min(id) OVER w AS keep_id, count(*) OVER w AS copies
  FROM keyed WHERE k <> '' WINDOW w AS (PARTITION BY tbl, k, measure, value))
"""

_OVERLAP = r"""
rec AS (
  SELECT item_id, source, lower(regexp_replace(split, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')) AS side,
         regexp_extract_all(lower(strip_accents(segment)), '[\p{L}\p{N}]+') AS w
  FROM annotated_dataset WHERE segment IS NOT NULL),
usable AS (SELECT * FROM rec WHERE side IN ('train', 'dev', 'test') AND len(w) > 0),
cnt AS (SELECT item_id, side, n, x, count(*) AS k FROM (SELECT item_id, side, len(w) AS n, unnest(w) AS x FROM usable) GROUP BY ALL),
pairs AS (
  SELECT a.item_id AS i, b.item_id AS j, sum(least(a.k, b.k)) AS o, max(greatest(a.n, b.n)) AS m
  FROM cnt a JOIN cnt b ON a.x = b.x
  WHERE a.side = 'train' AND b.side <> 'train' AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4 GROUP BY 1, 2),
agree AS (SELECT *, o = m AS same FROM pairs WHERE o * 5 >= m * 4)
"""

_CHARS = "SELECT 'corpus' AS tbl, seg_id FROM corpus WHERE length(segment) > 1000"
_TOKENS = "SELECT 'tokenized_corpus' AS tbl, seg_id FROM tokenized_corpus WHERE len(string_split(tokenized_segment, ' ')) > 160"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_OVERLAP} SELECT least(i, j) AS item_a, greatest(i, j) AS item_b FROM agree",
        "p1_report": f"""WITH {_OVERLAP}, hit AS (SELECT j, max(same) AS same FROM agree GROUP BY j)
          SELECT side AS split, source, count(*) AS records, count(j) AS overlapping, count(*) FILTER (WHERE same) AS exact
          FROM usable LEFT JOIN hit ON item_id = j WHERE side <> 'train' GROUP BY side, source""",
        "p2_found": f"WITH {_RECORDS} SELECT tbl, keep_id, id AS copy_id FROM classes WHERE id <> keep_id",
        "p2_records": f"WITH {_RECORDS} SELECT tbl, keep_id, copies FROM classes WHERE id = keep_id",
        "p3_found": f"{_CHARS} UNION ALL {_TOKENS}",
        "p4_found": f"WITH {_TERMS} SELECT tbl, term, mark FROM marked WHERE mark IS NOT NULL",
        "p4_counts": f"WITH {_TERMS} SELECT tbl, term, occurrences, records, mark FROM marked",
        "p6_found": f"WITH {_TOTALS} SELECT ngram FROM totals",
        "p6_totals": f"WITH {_TOTALS} SELECT ngram, total FROM totals",
    }

"""DuckDB SQL of the readers' and sinks' queries: what was written, by SQL alone."""

from __future__ import annotations

from termloom.functions.tokens import TOKEN
from termloom.plans.oracle import LEARN, NORMAL, OUTER, TAGGED, TERM_PAIRS, TOK, ALL4, CAND, _bigram, _q, _stream, words


def _line(c: str) -> str:
    return rf"trim(regexp_replace({c}, '[\x00-\x1F]+', ' ', 'g'), ' ')"


def oracle_sql() -> dict[str, str]:
    two = f"""two AS (SELECT a.seg_id, {_line('a.segment')} AS segment_sl, {_line('b.segment')} AS segment_tl FROM corpus a JOIN corpus b ON b.seg_id = a.seg_id + 1
      WHERE a.segment IS NOT NULL AND b.segment IS NOT NULL)"""
    pairs = f"{TERM_PAIRS}, p AS (SELECT * FROM (SELECT {_line('sl_term')} AS sl_term, {_line('tl_term')} AS tl_term FROM tp) WHERE sl_term <> '')"
    lines = f"WITH {TAGGED} SELECT array_to_string(t, ' ') AS line, count(*) AS times FROM packed WHERE len(t) > 0 GROUP BY 1"
    terms = "terms AS (SELECT DISTINCT ngram AS term, len(string_split(ngram, ' ')) AS n FROM ngrams WHERE trim(ngram) <> '')"
    columns = lines.replace("array_to_string(t, ' ')", "array_to_string(list_transform(t, lambda x: regexp_replace(x, '[\\s\\x{0B}\\x{85}\\x{A0}]', '_', 'g')), ' ')")
    trimmed = r"regexp_replace({}, '[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '')"
    return {
        "io_corpus": f"SELECT {trimmed.format(_line('segment'))} AS segment, count(*) AS times FROM corpus WHERE segment IS NOT NULL GROUP BY 1",
        "io_word_set": "SELECT DISTINCT measure AS word FROM candidate_terms WHERE measure IS NOT NULL AND trim(measure) <> ''",
        "io_patterns": f"WITH {LEARN} SELECT pattern, frequency FROM patterns",
        "io_terms": f"""SELECT DISTINCT x AS term FROM (SELECT array_to_string({words('ngram')}, chr(1)) AS k, {_line('ngram')} AS x FROM ngrams WHERE ngram IS NOT NULL)
          WHERE x <> '' AND len({words('x')}) BETWEEN 2 AND 3""",
        "io_jsonl": "SELECT segment, array_to_string(terms, '|') AS terms, count(*) AS times FROM annotated_dataset GROUP BY ALL",
        "io_moses": f"WITH {two} SELECT row_number() OVER (ORDER BY seg_id) - 1 AS id, segment_sl, segment_tl FROM two",
        "io_tabtxt": f"WITH {two} SELECT segment_sl, segment_tl, count(*) AS times FROM two GROUP BY ALL",
        "io_tmx": f"WITH {two} SELECT segment_sl, segment_tl, count(*) AS times FROM two WHERE segment_sl <> '' AND segment_tl <> '' GROUP BY ALL",
        "io_tagged": f"WITH {TOK} SELECT CAST(len(t) AS INTEGER) AS tokens, count(*) AS times FROM tok WHERE len(t) > 0 GROUP BY 1",
        "io_freeling": columns,
        "io_conll": columns,
        "io_pairs_tabtxt": f"WITH {pairs} SELECT sl_term, CASE WHEN tl_term = '' THEN '_' ELSE tl_term END AS tl_term, count(*) AS times FROM p WHERE len({words('sl_term')}) BETWEEN 2 AND 3 GROUP BY ALL",
        "io_pairs_csv": f"WITH {pairs} SELECT sl_term, tl_term, count(*) AS times FROM p WHERE tl_term <> '' GROUP BY ALL",
        "io_tbx": f"WITH {pairs} SELECT sl_term, CASE WHEN tl_term = '' THEN '_' ELSE tl_term END AS tl_term, count(*) AS times FROM p WHERE len({words('sl_term')}) BETWEEN 1 AND 100 GROUP BY ALL",
        "io_validated": "SELECT * FROM (VALUES ('red cell', 'célula roja'), ('wall', 'pared')) v(sl_term, tl_term)",
        "io_phrase_table": rf"""WITH {TERM_PAIRS.replace('b.value FROM', 'b.value, b.cand_id FROM')}, p AS (SELECT {_line('sl_term')} AS source, {_line('tl_term')} AS target, 0.5 * value AS x FROM tp WHERE value IS NOT NULL AND cand_id % 7 <> 0)
          SELECT source, target, round(max(x), 6) AS probability FROM p
          WHERE NOT regexp_matches(source, '^[!-/:-@\[-`{{-~]|[!-/:-@\[-`{{-~]$') AND NOT regexp_matches(target, '^[!-/:-@\[-`{{-~]|[!-/:-@\[-`{{-~]$') GROUP BY ALL""",
        "io_embeddings": """SELECT 'v' || vec_id AS word, CAST(len(embedding) AS INTEGER) AS width,
          round(list_sum(list_transform(embedding, lambda x: CAST(CAST(format('{:.6g}', CAST(x AS DOUBLE)) AS FLOAT) AS DOUBLE))), 4) AS total FROM embeddings""",
        "io_candidates": f"WITH {NORMAL} SELECT {ALL4} FROM normal",
        "io_term_list": f"""WITH {NORMAL}, best AS (SELECT * FROM normal ORDER BY value DESC, candidate LIMIT 200)
          SELECT value || chr(9) || candidate AS line FROM best WHERE candidate NOT IN (SELECT ngram FROM ngrams WHERE trim(ngram) <> '')""",
        "io_project": f"WITH {terms} SELECT term, CAST(n AS INTEGER) AS n, true AS populated, true AS empty FROM terms WHERE n BETWEEN 2 AND 3",
        "io_export_annotated": """SELECT least(300, count(*) FILTER (WHERE len(terms) > 0)) AS with_terms, CAST(count(*) FILTER (WHERE coalesce(len(terms), 0) = 0) AS BIGINT) AS without
          FROM annotated_dataset WHERE segment IS NOT NULL""",
        "ngrams_by_segment": f"""WITH {TOK} SELECT doc_id, array_to_string(t[i:i+n-1], ' ') AS ngram, CAST(n AS INTEGER) AS n, count(*) AS frequency
          FROM tok, (VALUES (2), (3)) v(n), LATERAL (SELECT unnest(range(1, len(t) - n + 2)) AS i) GROUP BY ALL""",
        "upsert": "SELECT seg_id, coalesce(t.tokenized_segment, c.segment) AS segment, c.lang FROM corpus c FULL JOIN (SELECT * FROM tokenized_corpus WHERE tokenized_segment IS NOT NULL) t USING (seg_id)",
        "scored": f"""WITH {CAND}, {_stream(2).removeprefix(TOK + ',').strip()}
          SELECT c.candidate, c.n, CASE WHEN m.candidate IS NOT NULL THEN 'dice' END AS measure, round({_bigram()['dice'].replace('n1', 'm.n1').replace('m.n11', 'm.n11').replace('n2', 'm.n2')}, 4) AS value
          FROM cand c LEFT JOIN m ON m.candidate = c.candidate""",
        "balanced": "SELECT CAST(200 AS BIGINT) AS segments",
        "align_labels": """SELECT seg_id, array_to_string(list_transform(string_split(tokenized_segment, ' '), lambda x:
          CASE WHEN length(x) > 6 THEN '1 2' WHEN length(x) > 3 THEN '2 2' ELSE '0 0' END), ' ') AS ids FROM tokenized_corpus WHERE tokenized_segment <> ''""",
        "tag_with_model": f"""WITH {TOK} SELECT doc_id, CAST(len(list_filter(t, lambda x: x IN ('the', 'of', 'de') OR lower(x) IN ('the', 'of', 'de'))) AS INTEGER) AS function_words,
          CAST(len(t) AS INTEGER) AS tokens FROM tok""",
        "stream_tokens": f"SELECT token, count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(segment, {_q(TOKEN)})) AS token FROM corpus) GROUP BY token",
    }

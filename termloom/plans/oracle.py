"""DuckDB SQL of the core queries."""

from __future__ import annotations

from termloom.functions import stopwords as sw
from termloom.functions.tokens import TOKEN
from termloom.operators.linguistic import SUFFIXES
from termloom.plans.queries import K, PATTERNS, REGEXES
from termloom.functions.patterns import captures, translate_pattern

WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_q(x) for x in sorted(items)) + "]"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}'), lambda v: v <> '')"


OUTER, INNER = _list(sw.all_outer()), _list(sw.all_inner())

TOK = f"tok AS (SELECT doc_id, regexp_extract_all(text, {_q(TOKEN)}) AS t FROM documents WHERE text IS NOT NULL)"
COUNTS = f"""{TOK},
grams AS (SELECT array_to_string(t[i:i+n-1], ' ') AS ngram, n
          FROM tok, (VALUES (2), (3)) v(n), LATERAL (SELECT unnest(range(1, len(t) - n + 2)) AS i)),
counts AS (SELECT ngram, CAST(n AS INTEGER) AS n, count(*) AS frequency FROM grams GROUP BY ngram, n HAVING count(*) >= 2)"""


def _stop(legacy: bool) -> str:
    last = "len(w)" if legacy else "len(w) - 1"
    return (
        f"SELECT ngram AS candidate, n, 'frequency' AS measure, frequency AS value FROM (SELECT *, {words('lower(ngram)')} AS w FROM counts) "
        f"WHERE len(w) > 0 AND NOT list_contains({OUTER}, w[1]) AND NOT list_contains({OUTER}, w[-1]) AND NOT list_has_any(w[2:{last}], {INNER})"
    )


KEY = "CASE WHEN upper(candidate) = candidate AND lower(candidate) <> candidate THEN trim(candidate) ELSE trim(lower(candidate)) END"
CAND = f"{COUNTS}, cand AS ({_stop(False)})"
NORMAL = f"""{CAND},
keyed AS (SELECT {KEY} AS candidate, measure, value FROM cand),
summed AS (SELECT candidate, measure, CAST(sum(value) AS BIGINT) AS value FROM keyed GROUP BY candidate, measure),
normal AS (SELECT candidate, CAST(len({words('candidate')}) AS INTEGER) AS n, measure, value FROM summed)"""
ALL4 = "candidate, n, measure, value"

NEST = f"""{NORMAL},
split AS (SELECT value, n, string_split(candidate, ' ') AS w FROM normal),
runs AS (SELECT DISTINCT value AS ov, n AS xn, w, array_to_string(w[i:i+k-1], ' ') AS candidate
         FROM split, LATERAL (SELECT unnest(range(1, len(w))) AS k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
taken AS (SELECT a.candidate, sum(ov) AS s FROM normal a JOIN runs b USING (candidate)
          WHERE xn > n AND ov >= value * 0.9 AND ov <= value * 1.1 GROUP BY a.candidate)"""

REFS = "refs AS (SELECT DISTINCT term FROM (SELECT unnest(terms) AS term FROM annotated_dataset) WHERE trim(term) <> '')"
SLOTS = f"""{REFS},
rw AS (SELECT {words('lower(term)')} AS w FROM refs),
seed AS (SELECT 'F' AS slot, w[1] AS word FROM rw WHERE len(w) > 0 UNION SELECT 'L', w[-1] FROM rw WHERE len(w) > 0
         UNION SELECT 'M', unnest(w[2:len(w)-1]) FROM rw),
cw AS (SELECT *, {words('lower(candidate)')} AS w FROM normal),
fl AS (SELECT *, w[1] AS fw, w[-1] AS lw, CASE WHEN len(w) > 2 THEN w[2] END AS mw FROM cw WHERE len(w) > 0)"""
STRICT = f"""SELECT {ALL4}, fw, lw, mw FROM fl WHERE fw IN (SELECT word FROM seed WHERE slot = 'F') AND lw IN (SELECT word FROM seed WHERE slot = 'L')
AND (mw IS NULL OR list_has_all((SELECT list(word) FROM seed WHERE slot = 'M'), w[2:len(w)-1]))"""

def _fix(grows: str, start: str) -> str:
    """Slots as a linear recursion; candidates have one middle word at most."""
    return f"""reach(slot, word) AS ({start}
  UNION SELECT x.slot, x.word FROM reach r JOIN fl c ON (r.slot = 'F' AND c.fw = r.word) OR (r.slot = 'L' AND c.lw = r.word) OR (r.slot = 'M' AND c.mw = r.word),
  LATERAL (SELECT 'F' AS slot, c.fw AS word UNION ALL SELECT 'L', c.lw {grows}) x)"""


ACCEPT = f"""SELECT {ALL4} FROM fl WHERE fw IN (SELECT word FROM reach WHERE slot = 'F') OR lw IN (SELECT word FROM reach WHERE slot = 'L')
OR (mw IS NOT NULL AND mw IN (SELECT word FROM reach WHERE slot = 'M'))"""
MIDDLE = "UNION ALL SELECT 'M', c.mw WHERE c.mw IS NOT NULL"

POS = "CASE " + " ".join(f"WHEN regexp_matches(lower(f), {_q(p)}) THEN '{t}'" for p, t in SUFFIXES) + " ELSE 'NOUN' END"
TAGGED = f"""{TOK},
packed AS (SELECT doc_id, list_transform(t, lambda f: concat_ws('|', f, regexp_replace(lower(f), '^(.*\\w\\w\\w)s$', '\\1'), {POS})) AS t FROM tok),
tgrams AS (SELECT array_to_string(t[i:i+n-1], ' ') AS tagged_ngram, n
           FROM packed, (VALUES (2), (3)) v(n), LATERAL (SELECT unnest(range(1, len(t) - n + 2)) AS i)),
tng AS (SELECT array_to_string(list_transform(string_split(tagged_ngram, ' '), lambda x: string_split(x, '|')[1]), ' ') AS ngram, tagged_ngram,
               CAST(n AS INTEGER) AS n, count(*) AS frequency FROM tgrams GROUP BY tagged_ngram, n HAVING count(*) >= 2)"""
LEARN = f"""{TAGGED},
learned AS (SELECT array_to_string(list_transform(string_split(tagged_ngram, ' '), lambda x:
    CASE WHEN string_split(x, '|')[1] = string_split(x, '|')[2] THEN '|#|' ELSE '#||' END || coalesce(string_split(x, '|')[3], 'UNK')), ' ') AS pattern, frequency
  FROM tng WHERE ngram IN (SELECT ngram FROM ngrams)),
patterns AS (SELECT pattern, CAST(sum(frequency) AS BIGINT) AS frequency FROM learned GROUP BY pattern)"""


def _match() -> str:
    cases = []
    for r in dict.fromkeys(translate_pattern(p) for p in PATTERNS):
        parts = " || ' ' || ".join(f"regexp_extract(tagged_ngram, {_q(f'^{r}$')}, {i + 2})" for i in range(captures(r)))
        cases.append(f"WHEN regexp_matches(tagged_ngram, {_q(f'^{r}$')}) THEN {parts}")
    lemma = lambda i: f"lower(coalesce(string_split(string_split(tagged_ngram, ' ')[{i}], '|')[2], string_split(string_split(tagged_ngram, ' ')[{i}], '|')[1]))"
    return f"""WITH {TAGGED}, m AS (SELECT CASE {' '.join(cases)} END AS candidate, frequency FROM tng
      WHERE NOT list_contains({OUTER}, {lemma(1)}) AND NOT list_contains({OUTER}, {lemma(-1)}))
    SELECT candidate, CAST(len(string_split(candidate, ' ')) AS INTEGER) AS n, 'frequency' AS measure, CAST(sum(frequency) AS BIGINT) AS value
    FROM m WHERE candidate <> '' GROUP BY candidate"""


def _stream(k: int) -> str:
    lead = ", ".join(f"lead(w, {i}) OVER (ORDER BY doc_id, i) AS w{i + 1}" for i in range(1, k))
    names = [f"w{i}" for i in range(1, k + 1)]
    joins = " ".join(f"JOIN single s{i} ON s{i}.w = g.w{i}" for i in range(1, k + 1))
    return f"""{TOK},
    stream AS (SELECT doc_id, i, t[i] AS w FROM tok, LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i)),
    led AS (SELECT w AS w1, {lead} FROM stream),
    g AS (SELECT {', '.join(names)}, count(*) AS n_all FROM led WHERE w{k} IS NOT NULL GROUP BY ALL),
    single AS (SELECT w, count(*) AS f FROM stream GROUP BY w),
    m AS (SELECT {" || ' ' || ".join(names)} AS candidate, CAST(n_all AS DOUBLE) AS n11, {', '.join(f'CAST(s{i}.f AS DOUBLE) AS n{i}' for i in range(1, k + 1))},
          (SELECT CAST(count(*) AS DOUBLE) FROM stream) AS t FROM g {joins})"""


def _x(o: str, e: str, log: str = "ln") -> str:
    return f"CASE WHEN {o} > 0 AND {e} > 0 THEN {o} * {log}({o} / ({e})) ELSE 0 END"


def _bigram() -> dict[str, str]:
    n12, n21 = "(n1 - n11)", "(n2 - n11)"
    n22 = f"(t - n11 - {n12} - {n21})"
    e = "(n1 * n2 / t)"
    g = " + ".join(
        _x(o, x) for o, x in (("n11", e), (n12, "n1 * (t - n2) / t"), (n21, "(t - n1) * n2 / t"), (n22, "(t - n1) * (t - n2) / t"))
    )
    den = "(n1 * n2 * (t - n1) * (t - n2))"
    phi = f"CASE WHEN {den} <> 0 THEN (n11 * {n22} - {n12} * {n21}) * (n11 * {n22} - {n12} * {n21}) / {den} END"
    # the observed cells of the classic table and what the marginals expect, over all tokens
    q22 = "(t - n1 - n2)"
    cells = (("n11", "n1 * n2 / t"), (n12, f"n1 * ({n12} + {q22}) / t"), (n21, f"n2 * ({n21} + {q22}) / t"), (q22, f"({n21} + {q22}) * ({n12} + {q22}) / t"))
    bad = " OR ".join(f"({x}) = 0 OR {o} / nullif({x}, 0) <= 0" for o, x in cells)
    g2 = " + ".join(f"{o} * log2({o} / ({x}))" for o, x in cells)
    one = lambda x: f"(CASE WHEN {x} = 0 THEN 1 ELSE {x} END)"
    low = "greatest(0, n1 + n2 - t)"
    density = "exp(lgamma(n1 + 1) + lgamma(t - n1 + 1) + lgamma(n2 + 1) + lgamma(t - n2 + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(n1 - k + 1) - lgamma(n2 - k + 1) - lgamma(t - n1 - n2 + k + 1))"
    return {
        "raw_freq": "n11 / t",
        "pmi": "log2(n11 * t / (n1 * n2))",
        "student_t": f"(n11 - {e}) / sqrt(n11)",
        "chi_sq": f"t * ({phi})",
        "phi_sq": phi,
        "mi_like": "n11 * n11 * n11 / (n1 * n2)",
        "likelihood_ratio": f"2 * ({g})",
        "poisson_stirling": f"n11 * (log2(n11 / {e}) - 1)",
        "jaccard": f"n11 / (n11 + {n12} + {n21})",
        "dice": "2 * n11 / (n1 + n2)",
        "loglikelihood": f"CASE WHEN {bad} THEN 0 ELSE 2 * ({g2}) END",
        "mi": f"log2(n11 / {e})",
        "mi2": f"log2(pow(n11 / {e}, 2))",
        "mi3": f"log2(pow(n11 / {e}, 3))",
        "odds": f"n11 * {q22} / ({one(n12)} * {one(n21)})",
        "z_score": f"(n11 - {e}) / sqrt({e})",
        "fisher": f"list_sum(list_transform(range(CAST({low} AS BIGINT), CAST(n11 AS BIGINT) + 1), lambda k: {density}))",
    }


def _many(k: int) -> dict[str, str]:
    product = " * ".join(f"n{i}" for i in range(1, k + 1))
    e = f"(({product})" + " / t" * (k - 1) + ")"
    return {
        "raw_freq": "n11 / t",
        "pmi": f"log2(n11 / {e})",
        "student_t": f"(n11 - {e}) / sqrt(n11)",
        "mi_like": f"pow(n11, 3) / ({product})",
        "poisson_stirling": f"n11 * (log2(n11 / {e}) - 1)",
    }


def _table(k: int) -> tuple[str, dict[str, str]]:
    """A k-gram's 2^k cells as a query, and the measures over them; n_S counts the words at the places S."""
    parts = [tuple(i for i in range(k) if bits >> i & 1) for bits in range(2**k)]
    edge = lambda p: "t" if not p else "n11" if len(p) == k else "n" + "".join(str(i + 1) for i in p)
    joins, columns = "", ""
    for p in parts:
        if 2 <= len(p) < k:
            at = [i - p[0] + 1 for i in p]
            keys = ", ".join(f"w{i}" for i in at)
            joins += f" JOIN (SELECT {keys}, CAST(count(*) AS DOUBLE) AS c FROM led WHERE w{at[-1]} IS NOT NULL GROUP BY ALL) {edge(p)} ON "
            joins += " AND ".join(f"{edge(p)}.w{x} = g.w{i + 1}" for x, i in zip(at, p))
            columns += f", {edge(p)}.c AS {edge(p)}"
    names = " || ' ' || ".join(f"g.w{i + 1}" for i in range(k))
    rows = f"(SELECT m.*{columns} FROM m JOIN g ON m.candidate = {names} AND m.n11 = g.n_all{joins})"
    cell = lambda p: "c" + "".join("1" if i in p else "0" for i in range(k))
    exact = {cell(p): " ".join(("+ " if (len(x) - len(p)) % 2 == 0 else "- ") + edge(x) for x in parts if set(p) <= set(x)) for p in parts}
    cells = f"(SELECT candidate, {', '.join(f'{e} AS {n}' for n, e in exact.items())} FROM {rows})"
    margins = ", ".join("(" + " + ".join(n for n in exact if n[i + 1] == v) + f") AS m{i}{v}" for i in range(k) for v in "01")
    query = f"(SELECT *, {' + '.join(exact)} AS whole, {margins} FROM {cells})"
    e = {n: f"(m0{n[1]} * " + " * ".join(f"(m{i}{n[i + 1]} / whole)" for i in range(1, k)) + ")" for n in exact}
    return query, {
        "chi_sq": " + ".join(f"CASE WHEN {e[n]} > 0 THEN ({n} - {e[n]}) * ({n} - {e[n]}) / {e[n]} ELSE 0 END" for n in exact),
        "likelihood_ratio": "2 * (" + " + ".join(_x(n, e[n]) for n in exact) + ")",
        "jaccard": f"c{'1' * k} / (" + " + ".join(n for n in exact if "1" in n) + ")",
    }


def _assoc(measure: str, k: int, expr: str) -> str:
    return f"WITH {_stream(k)} SELECT candidate, CAST({k} AS INTEGER) AS n, '{measure}' AS measure, round({expr}, 4) AS value FROM m"


RATES = """SELECT {k} round(CASE WHEN p > 0 THEN {s} * h / p ELSE 0 END, 4) AS precision, round(CASE WHEN w > 0 THEN {s} * h / w ELSE 0 END, 4) AS recall,
round(CASE WHEN h > 0 THEN 2 * {s} * h / (p + w) ELSE 0 END, 4) AS f1 FROM sums"""

EVAL_ASC = f"""WITH {REFS}, gold AS (SELECT term FROM refs UNION ALL SELECT DISTINCT ngram FROM ngrams WHERE trim(ngram) <> ''),
cands AS (SELECT ngram AS candidate, count(DISTINCT batch_id) AS value, sum(frequency) AS f FROM ngrams WHERE ngram <> '' AND frequency IS NOT NULL AND n <= 3 GROUP BY ngram, n),
levels AS (SELECT value, f, count(*) AS a, count(*) FILTER (WHERE candidate IN (SELECT term FROM gold) OR lower(candidate) IN (SELECT term FROM gold)) AS hits FROM cands GROUP BY value, f),
cut AS (SELECT *, coalesce(sum(a) OVER (ORDER BY value, f DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM levels),
part AS (SELECT *, greatest(0.0, least(1.0, CAST(500 - above AS DOUBLE) / a)) AS share FROM cut),
sums AS (SELECT CAST(sum(share * hits) AS DOUBLE) AS h, CAST(sum(share * a) AS DOUBLE) AS p, (SELECT CAST(count(*) AS DOUBLE) FROM gold) AS w FROM part)
""" + RATES.format(k="CAST(500 AS INTEGER) AS k,", s="100.0")

EVAL = f"""WITH {NORMAL},
known AS (SELECT ngram AS r, count(*) AS c FROM (SELECT DISTINCT ngram FROM ngrams WHERE ngram <> '') GROUP BY 1),
levels AS (SELECT value, count(*) AS a, count(*) FILTER (WHERE candidate IN (SELECT r FROM known) OR lower(candidate) IN (SELECT r FROM known)) AS hits FROM normal GROUP BY value),
cut AS (SELECT *, coalesce(sum(a) OVER (ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM levels),
part AS (SELECT *, greatest(0.0, least(1.0, CAST(1000 - above AS DOUBLE) / a)) AS share FROM cut),
sums AS (SELECT CAST(sum(share * hits) AS DOUBLE) AS h, CAST(sum(share * a) AS DOUBLE) AS p, (SELECT CAST(sum(c) AS DOUBLE) FROM known) AS w FROM part)
""" + RATES.format(k="CAST(1000 AS INTEGER) AS k,", s="100.0")

TOKEN_METRICS = f"""WITH a AS (SELECT seg_id, x, count(*) AS n FROM (SELECT seg_id, unnest(regexp_extract_all(segment, {_q(TOKEN)})) AS x FROM corpus) GROUP BY ALL),
b AS (SELECT seg_id, x, count(*) AS n FROM (SELECT seg_id, unnest(string_split(tokenized_segment, ' ')) AS x FROM tokenized_corpus WHERE tokenized_segment <> '') GROUP BY ALL),
sums AS (SELECT CAST(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS DOUBLE) AS h, CAST(sum(coalesce(a.n, 0)) AS DOUBLE) AS p, CAST(sum(coalesce(b.n, 0)) AS DOUBLE) AS w
         FROM a FULL JOIN b ON a.seg_id = b.seg_id AND a.x = b.x)
""" + RATES.format(k="", s="1.0")

TERMS = "terms AS (SELECT DISTINCT ngram AS term FROM ngrams WHERE trim(ngram) <> '')"
PARALLEL = f"""WITH pairs AS (SELECT a.seg_id, a.segment AS s, {words('b.segment')} AS tw FROM corpus a JOIN corpus b ON b.seg_id = a.seg_id + 1
  WHERE a.segment IS NOT NULL AND b.segment IS NOT NULL),
{TERMS},
hits AS (SELECT term, seg_id, len({words('term')}) AS k, tw FROM pairs JOIN terms ON contains(s, term)),
g AS (SELECT term, tw[i:i+n-1] AS g FROM hits, LATERAL (SELECT unnest(range(greatest(1, k - 1), k + 3)) AS n), LATERAL (SELECT unnest(range(1, len(tw) - n + 2)) AS i)),
c AS (SELECT term, array_to_string(g, ' ') AS translation, count(*) AS frequency FROM g
      WHERE NOT list_contains({OUTER}, g[1]) AND NOT list_contains({OUTER}, g[-1]) GROUP BY term, g),
r AS (SELECT *, round(frequency / sum(frequency) OVER (PARTITION BY term), 4) AS share,
      CAST(row_number() OVER (PARTITION BY term ORDER BY frequency DESC, translation) AS INTEGER) AS rank FROM c)
SELECT term, translation, frequency, share, rank FROM r WHERE rank <= 5"""

COMPOUNDS = f"""WITH {TERMS},
hits AS (SELECT seg_id, segment, list(term ORDER BY length(term) DESC, term) AS ts FROM corpus JOIN terms ON contains(segment, term) WHERE contains(trim(term), ' ')
         GROUP BY seg_id, segment),
joined AS (SELECT seg_id, list_reduce(list_concat([segment], ts), lambda x, y: replace(x, y, replace(y, ' ', '▁'))) AS segment FROM hits)"""

TERM_PAIRS = """tp AS (SELECT a.candidate AS sl_term, b.candidate AS tl_term, b.value FROM candidate_terms a JOIN candidate_terms b ON b.cand_id = a.cand_id + 1
  WHERE a.candidate IS NOT NULL AND b.candidate IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    en = ", ".join(_q(x) for x in ("en", *sw.NAMES["en"]))
    flag = NORMAL.replace("WHERE text IS NOT NULL", f"WHERE text IS NOT NULL AND lower(trim(lang)) IN ({en})")
    flag = flag.replace(OUTER, _list(sw.outer("en"))).replace(INNER, _list(sw.inner("en")))
    full = " OR ".join(
        f"(n = {len(r.split())} AND regexp_full_match(candidate, {_q(r)}))" for r in REGEXES
    )
    prefix = " OR ".join(f"regexp_matches(candidate, {_q(f'^(?:{r})')})" for r in REGEXES)
    q = {
        "flagship": f"WITH {flag} SELECT {ALL4} FROM normal",
        "tokenize": f"WITH {TOK} SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS joined FROM tok",
        "tokenize_blanks": f"SELECT doc_id, array_to_string({words('text')}, ' ') AS joined FROM documents WHERE text IS NOT NULL",
        "token_freq": f"WITH {TOK} SELECT token, count(*) AS frequency FROM (SELECT unnest(t) AS token FROM tok) GROUP BY token",
        "ngrams_2_3": f"WITH {COUNTS} SELECT ngram, n, frequency FROM counts",
        "stat_candidates": f"WITH {CAND} SELECT {ALL4} FROM cand",
        "stopword_filter_legacy": f"WITH {COUNTS} {_stop(True)}",
        "case_norm": f"WITH {NORMAL} SELECT {ALL4} FROM normal",
        "case_norm_legacy": f"""WITH {CAND}, twin AS (SELECT candidate AS tw FROM cand WHERE lower(candidate) = candidate),
          s AS (SELECT coalesce(tw, candidate) AS candidate, measure, CAST(sum(value) AS BIGINT) AS value FROM cand LEFT JOIN twin ON lower(candidate) = tw GROUP BY 1, 2)
          SELECT candidate, CAST(len({words('candidate')}) AS INTEGER) AS n, measure, value FROM s""",
        "nest_norm": f"WITH {NEST} SELECT candidate, n, measure, CAST(value - coalesce(s, 0) AS BIGINT) AS value FROM normal LEFT JOIN taken USING (candidate) WHERE value - coalesce(s, 0) > 0",
        "nest_norm_legacy": f"""WITH {NORMAL} SELECT {ALL4} FROM normal a WHERE NOT EXISTS (SELECT 1 FROM normal b WHERE b.n = a.n + 1
          AND b.value >= a.value * 0.9 AND b.value <= a.value * 1.1 AND contains(b.candidate, a.candidate))""",
        "regex_exclusion": f"WITH {NORMAL} SELECT {ALL4} FROM normal WHERE NOT ({full})",
        "regex_exclusion_prefix": f"WITH {NORMAL} SELECT {ALL4} FROM normal WHERE NOT ({prefix})",
        "exclusion_antijoin": f"WITH {CAND} SELECT {ALL4} FROM cand WHERE candidate NOT IN (SELECT ngram FROM ngrams WHERE ngram IS NOT NULL)",
        "select_unigrams": f"""WITH {NORMAL} SELECT candidate, CAST(1 AS INTEGER) AS n, 'freq' AS measure, CAST(sum(value) AS BIGINT) AS value
          FROM (SELECT {words('candidate')}[-1] AS candidate, value FROM normal) GROUP BY 1""",
        "length_bounds": f"SELECT cand_id, candidate FROM candidate_terms WHERE len({words('candidate')}) BETWEEN 2 AND 3",
        "top_candidates": f"WITH {NORMAL} SELECT {ALL4} FROM normal ORDER BY value DESC, candidate LIMIT 20",
        "tsr_strict": f"WITH {NORMAL}, {SLOTS}, strict AS ({STRICT}) SELECT {ALL4} FROM strict",
        "tsr_flexible": f"WITH RECURSIVE {NORMAL}, {SLOTS}, {_fix('', 'SELECT slot, word FROM seed')} {ACCEPT}",
        "tsr_combined": f"""WITH RECURSIVE {NORMAL}, {SLOTS}, strict AS ({STRICT}),
          start AS (SELECT slot, word FROM seed UNION SELECT 'F', fw FROM strict UNION SELECT 'L', lw FROM strict UNION SELECT 'M', mw FROM strict WHERE mw IS NOT NULL),
          {_fix(MIDDLE, 'SELECT slot, word FROM start')}, acc AS ({ACCEPT}) SELECT * FROM acc WHERE EXISTS (SELECT 1 FROM strict)""",
        "tagged_ngrams": f"WITH {TAGGED} SELECT ngram, tagged_ngram, n, frequency FROM tng",
        "pattern_learn": f"WITH {LEARN} SELECT pattern, frequency FROM patterns",
        "representativity_cut": f"""WITH {LEARN}, c AS (SELECT *, coalesce(sum(frequency) OVER (ORDER BY frequency DESC, pattern ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
          sum(frequency) OVER () AS s FROM patterns) SELECT pattern, frequency FROM c WHERE b * 100 <= 80 * s""",
        "pattern_match": _match(),
        "evaluate_topk": EVAL,
        "evaluate_topk_asc": EVAL_ASC,
        "token_metrics": TOKEN_METRICS,
        "predicted_counts": """SELECT candidate, CAST(len(string_split(candidate, ' ')) AS INTEGER) AS n, 'count' AS measure, count(*) AS value
          FROM (SELECT unnest(terms) AS candidate FROM annotated_dataset) WHERE candidate <> '' GROUP BY candidate""",
        "parallel_terms": PARALLEL,
        "phrase_table": f"""WITH {TERM_PAIRS}, pt AS (SELECT sl_term, tl_term, max(value) AS p FROM tp WHERE value IS NOT NULL GROUP BY ALL),
          f AS (SELECT sl_term AS term, tl_term AS translation, p AS probability FROM pt
                WHERE len({words('tl_term')}) BETWEEN len({words('sl_term')}) - 1 AND len({words('sl_term')}) + 1),
          r AS (SELECT *, CAST(row_number() OVER (PARTITION BY term ORDER BY probability DESC, translation) AS INTEGER) AS rank FROM f) SELECT * FROM r WHERE rank <= 5""",
        "reference_translations": f"""WITH {TERM_PAIRS}, f AS (SELECT sl_term AS term, array_to_string(list_sort(list_distinct(list(tl_term))), ', ') AS translations FROM tp GROUP BY sl_term)
          SELECT term, translations FROM (SELECT DISTINCT candidate AS term FROM candidate_terms WHERE candidate IS NOT NULL) LEFT JOIN f USING (term)""",
        "knn_cosine": f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c
          FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
          r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, neighbour_id) AS k FROM s) SELECT query_id, neighbour_id, round(c, 4) AS cosine FROM r WHERE k <= {K}""",
    }
    lemma = "CASE WHEN f IN (SELECT form FROM forms) THEN regexp_replace(f, '^(.*\\w\\w\\w)s$', '\\1') ELSE f END"
    q["lemmatize"] = f"""WITH {NORMAL}, forms AS (SELECT DISTINCT lower(x) AS form FROM (SELECT unnest(t) AS x FROM tok)),
      u AS (SELECT candidate, value, measure, i, {words('candidate')}[i] AS f FROM normal, LATERAL (SELECT unnest(range(1, len({words('candidate')}) + 1)) AS i)),
      l AS (SELECT candidate, value, measure, string_agg({lemma}, ' ' ORDER BY i) AS lem FROM u GROUP BY candidate, value, measure),
      s AS (SELECT lem AS candidate, measure, CAST(sum(value) AS BIGINT) AS value FROM l GROUP BY lem, measure)
      SELECT candidate, CAST(len({words('candidate')}) AS INTEGER) AS n, measure, value FROM s"""
    for m, e in _bigram().items():
        q[f"assoc_{m}"] = _assoc(m, 2, e)
    for k in (3, 4):
        for m, e in _many(k).items():
            q[f"assoc{k}_{m}"] = _assoc(m, k, e)
        cells, measures = _table(k)
        for m, e in measures.items():
            q[f"assoc{k}_{m}"] = _assoc(m, k, e).replace(" FROM m", f" FROM {cells}")
        q[f"assoc{k}_chi_sq"] = f"WITH {_stream(k)} SELECT candidate, CAST({k} AS INTEGER) AS n, 'chi_sq' AS measure, CASE WHEN v < 1e6 THEN round(v, 4) ELSE round(v, 0) END AS value FROM (SELECT candidate, {measures['chi_sq']} AS v FROM {cells})"
    q["segments_with_terms"] = f"WITH {TERMS} SELECT seg_id, term FROM corpus JOIN terms ON contains(segment, term)"
    q["compoundify"] = f"{COMPOUNDS} SELECT c.seg_id, coalesce(j.segment, c.segment) AS segment FROM corpus c LEFT JOIN joined j USING (seg_id)"
    q["compoundify_append"] = f"{COMPOUNDS} SELECT seg_id, segment FROM corpus UNION ALL SELECT seg_id, segment FROM joined"
    return q

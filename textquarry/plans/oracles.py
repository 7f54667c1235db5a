"""DuckDB SQL of the queries, written from their definitions."""

from __future__ import annotations

from ..functions import vocabularies as v
from .survey import SQL as BASE


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def real(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def entropy(shares: list[str]) -> str:
    return "-(" + " + ".join(f"({s}) * log2(({s}) + 1e-12)" for s in shares) + ")"


def split_of(*keys: str) -> str:
    return f"CASE WHEN CAST('0x' || substr(md5(concat_ws('/', {', '.join(keys)}, '42')), 1, 8) AS BIGINT) % 100 < 20 THEN 'test' ELSE 'train' END"


def connectives() -> str:
    parts = []
    for name, words in v.CONNECTIVES.items():
        single = quoted([w for w in words if " " not in w])
        # a consumed space between two phrases would hide the second, so each edge is looked at, not eaten, by doubling spaces
        phrases = [rf"len(regexp_extract_all(spaced, ' {' +'.join(w.split(' '))} '))" for w in words if " " in w]
        parts.append(f"len(list_filter(letters, lambda x: x IN ({single})))" + "".join(f" + {p}" for p in phrases) + f" AS count_{name}")
    return ", ".join(parts)


def present() -> str:
    every = [w for words in v.CONNECTIVES.values() for w in words]
    single = quoted([w for w in every if " " not in w])
    phrases = [rf"CAST(regexp_matches(spaced, ' {' +'.join(w.split(' '))} ') AS INT)" for w in every if " " in w]
    return f"len(list_distinct(list_filter(letters, lambda x: x IN ({single})))) + " + " + ".join(phrases)


def lexicon(k: int) -> str:
    return "MAP {" + ", ".join(f"'{w}': {row[k]!r}::DOUBLE" for w, row in v.SENTIMENT.items()) + "}"


LETTERS = r"[\p{L}\p{N}_]+"
# around every word two spaces, around anything else a bar, so that words of a phrase are parted by white space alone
SPACED = rf"' ' || regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s]', ' | ', 'g'), '\s+', '  ', 'g') || ' '"

SQL: dict[str, str] = {}

SQL["survey_rows"] = f"WITH {BASE} SELECT user_id, file_id, question, md5(text) AS text_md5, rating FROM survey"

SQL["report_users"] = f"WITH {BASE} SELECT file_id, count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM survey GROUP BY file_id UNION ALL SELECT NULL, count(*), count(DISTINCT user_id) FROM survey"

SQL["sentence_length"] = rf"""
WITH {BASE}, cut AS (
  SELECT user_id, file_id, len(w) AS n,
         list_transform(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: len(regexp_extract_all(x, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*'))) AS a,
         len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS b
  FROM worded)
SELECT user_id, file_id, {real("CASE WHEN len(a) > 0 THEN list_sum(a) / len(a) ELSE 0 END", "avg_sentence_len")}, b AS n_sentences, n AS n_tokens, CAST(n AS DOUBLE) AS sentence_length FROM cut"""

SQL["readability"] = rf"""
WITH {BASE}, cut AS (
  SELECT user_id, file_id, list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]')) AS w,
         greatest(len(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')), 1) AS s FROM worded
), letters AS (
  SELECT *, list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')) AS l FROM cut
), trimmed AS (
  SELECT *, list_transform(l, lambda x: CASE WHEN x LIKE '%e' AND x NOT LIKE '%le' THEN x[:-2] ELSE x END) AS t FROM letters
), counted AS (
  SELECT *, list_transform(t, lambda x: greatest(len(regexp_extract_all(x, '[aeiouy]+')) + CASE WHEN regexp_matches(x, '[^aeiouy]le$') THEN 1 ELSE 0 END, 1)) AS y FROM trimmed
), sums AS (
  SELECT user_id, file_id, s, len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS c, coalesce(list_sum(y), 0) AS y, len(list_filter(y, lambda k: k >= 3)) AS p FROM counted
), rates AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE n / s END AS wps, CASE WHEN n = 0 THEN 0 ELSE y / n END AS spw, CASE WHEN n = 0 THEN 0 ELSE c / n END AS cpw, CASE WHEN n = 0 THEN 0 ELSE p / n END AS pr FROM sums)
SELECT user_id, file_id, CAST(s AS BIGINT) AS n_sentences_r, n AS n_words, CAST(c AS BIGINT) AS n_chars_r, CAST(y AS BIGINT) AS syllables, p AS polysyllables,
  {real("wps", "words_per_sentence")}, {real("spw", "syllables_per_word")}, {real("cpw", "chars_per_word")}, {real("pr", "polysyllable_rate")},
  {real("CASE WHEN n = 0 THEN 0 ELSE 206.835::DOUBLE - 1.015::DOUBLE * wps - 84.6::DOUBLE * spw END", "flesch_reading_ease")},
  {real("CASE WHEN n = 0 THEN 0 ELSE 0.39::DOUBLE * wps + 11.8::DOUBLE * spw - 15.59::DOUBLE END", "fk_grade_level")},
  {real("CASE WHEN n = 0 THEN 0 ELSE 0.4::DOUBLE * (wps + 100 * pr) END", "gunning_fog")},
  {real("CASE WHEN n = 0 THEN 0 ELSE 4.71::DOUBLE * cpw + 0.5::DOUBLE * wps - 21.43::DOUBLE END", "ari")},
  {real("CASE WHEN n = 0 THEN 0 ELSE 0.0588::DOUBLE * (100 * cpw) - 0.296::DOUBLE * (100 * s / n) - 15.8::DOUBLE END", "coleman_liau")},
  {real("CASE WHEN n = 0 OR p = 0 THEN 0 ELSE 1.0430::DOUBLE * sqrt(30.0::DOUBLE * p / s) + 3.1291::DOUBLE END", "smog_index")} FROM rates"""

SQL["lexical_richness"] = rf"""
WITH {BASE}, long AS (
  SELECT user_id, file_id, lower(unnest(w)) AS x FROM worded
), freq AS (
  SELECT user_id, file_id, x, count(*) AS f FROM long GROUP BY ALL
), agg AS (
  SELECT user_id, file_id, CAST(sum(f) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS t, CAST(sum(f * f) AS DOUBLE) AS q, count(*) FILTER (f = 1) AS h, count(*) FILTER (f = 2) AS d, CAST(sum(length(x) * f) AS DOUBLE) AS c FROM freq GROUP BY ALL
), whole AS (
  SELECT survey.user_id, survey.file_id, coalesce(n, 0) AS n, coalesce(t, 0) AS t, coalesce(q, 0) AS q, coalesce(h, 0) AS h, coalesce(d, 0) AS d, coalesce(c, 0) AS c FROM survey LEFT JOIN agg USING (user_id, file_id))
SELECT user_id, file_id, CAST(n AS BIGINT) AS tokens, CAST(t AS BIGINT) AS types, {real("CASE WHEN n = 0 THEN 0 ELSE t / n END", "ttr")}, {real("CASE WHEN n = 0 THEN 0 ELSE t / sqrt(n) END", "rttr")},
  {real("CASE WHEN n = 0 THEN 0 ELSE t / sqrt(2 * n) END", "cttr")}, {real("CASE WHEN n > 1 AND t > 1 THEN ln(t) / ln(n) ELSE 0 END", "herdan_c")},
  {real("CASE WHEN n > 1 AND t > 1 THEN (ln(n) - ln(t)) / (ln(n) * ln(n)) ELSE 0 END", "maas_a2")}, {real("CASE WHEN n = 0 THEN 0 ELSE 10000 * (q - n) / (n * n) END", "yules_k")},
  {real("CASE WHEN t = 0 THEN 0 ELSE h / t END", "hapax_ratio")}, {real("CASE WHEN t = 0 THEN 0 ELSE d / t END", "dis_legomena_ratio")}, {real("CASE WHEN n = 0 THEN 0 ELSE c / n END", "avg_word_len")} FROM whole"""

SQL["frequency_spectrum"] = f"WITH {BASE}, freq AS (SELECT x, count(*) AS frequency FROM (SELECT lower(unnest(w)) AS x FROM worded) GROUP BY x) SELECT frequency, count(*) AS n_words FROM freq GROUP BY frequency"

SQL["discourse"] = rf"""
WITH {BASE}, marked AS (
  SELECT user_id, file_id, list_transform(w, lambda x: lower(x)) AS w, regexp_extract_all(lower(text), '{LETTERS}') AS letters, {SPACED} AS spaced FROM worded
), counted AS (
  SELECT user_id, file_id, len(w) AS n, {connectives()}, {present()} AS u, len(list_filter(w, lambda x: x IN ({quoted(v.ENUMERATION)}))) AS e FROM marked
), summed AS (
  SELECT *, count_temporal + count_comparison + count_cause + count_expansion AS k FROM counted)
SELECT user_id, file_id, n AS token_count, count_temporal, count_comparison, count_cause, count_expansion, k AS total_connectives,
  {", ".join(real(f"CASE WHEN n = 0 THEN 0 ELSE 100.0::DOUBLE * count_{c} / n END", f"density_{c}") for c in v.CONNECTIVES)},
  {real("CASE WHEN n = 0 THEN 0 ELSE 100.0::DOUBLE * k / n END", "connective_density_per_100w")}, CAST(u AS BIGINT) AS unique_connectives,
  {real("CASE WHEN k = 0 THEN 0 ELSE " + entropy([f"count_{c} / k" for c in v.CONNECTIVES]) + " END", "connective_entropy")}, e AS enumeration_count FROM summed"""

SQL["sentiment"] = rf"""
WITH {BASE}, low AS (
  SELECT user_id, file_id, list_transform(w, lambda x: lower(x)) AS w FROM worded
), long AS (
  SELECT user_id, file_id, unnest(range(1, len(w) + 1)) AS i, w FROM low
), hit AS (
  SELECT user_id, file_id, i, w[i] AS x, coalesce(({lexicon(0)})[w[i]], 0) AS base, list_slice(w, greatest(i - 3, 1), i - 1) AS before, CASE WHEN i > 1 THEN w[i - 1] END AS just FROM long
), moved AS (
  SELECT *, base + sign(base) * CASE {" ".join(f"WHEN just = '{w}' THEN {b}::DOUBLE" for w, b in v.BOOSTERS.items())} ELSE 0 END AS m FROM hit
), valued AS (
  SELECT *, CASE WHEN base = 0 THEN 0 WHEN i > 1 AND list_has_any(before, [{quoted(v.NEGATIONS)}]) THEN m * {v.NEGATION_FACTOR}::DOUBLE ELSE m END AS val FROM moved
), agg AS (
  SELECT user_id, file_id, count(*) AS n, sum(val) AS s, coalesce(sum(val + 1) FILTER (val > 0), 0) AS p, coalesce(sum(1 - val) FILTER (val < 0), 0) AS q, count(*) FILTER (val = 0) AS z,
         avg(({lexicon(1)})[x]) AS pol, avg(({lexicon(2)})[x]) AS sub FROM valued GROUP BY ALL)
SELECT user_id, file_id, {real("coalesce(s / sqrt(s * s + 15), 0)", "vader_compound")}, {real("coalesce(p / (p + q + z), 0)", "vader_pos")}, {real("coalesce(z / (p + q + z), 0)", "vader_neu")}, {real("coalesce(q / (p + q + z), 0)", "vader_neg")},
  {real("coalesce(pol, 0)", "tb_polarity")}, {real("coalesce(sub, 0)", "tb_subjectivity")} FROM survey LEFT JOIN agg USING (user_id, file_id)"""

SQL["truncated_words"] = rf"""
WITH {BASE}, cut AS (SELECT user_id, file_id, text, regexp_extract_all(text, '\S+') AS t FROM survey)
SELECT user_id, file_id, md5(CASE WHEN len(t) > 380 THEN array_to_string(t[1:380], ' ') ELSE text END) AS cut_md5, CAST(least(len(t), 380) AS BIGINT) AS n_words FROM cut"""

PAIRS = "pairs AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS q, CAST(b.embedding AS DOUBLE[]) AS r FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
SQL["semantic"] = f"WITH {PAIRS}, n AS (SELECT vec_id, list_inner_product(q, r) AS d, sqrt(list_inner_product(q, q)) AS qn, sqrt(list_inner_product(r, r)) AS rn FROM pairs) SELECT vec_id, {real('d / ((qn + 1e-12) * (rn + 1e-12))', 'cosine_sim')}, {real('qn', 'q_norm')}, {real('rn', 'r_norm')}, {real('abs(qn - rn)', 'norm_gap')} FROM n"
SQL["clip"] = f"WITH {PAIRS} SELECT vec_id, {real('list_inner_product(q, r) / sqrt(list_inner_product(q, q)) / sqrt(list_inner_product(r, r))', 'clip_qr_cosine')} FROM pairs"
SQL["pairwise_block"] = f"""
WITH {PAIRS}, long AS (SELECT vec_id, len(q) AS d, unnest(range(len(q))) AS k, unnest(q) AS q, unnest(r) AS r FROM pairs)
SELECT vec_id, CAST(k + d * b AS BIGINT) AS place, round(CASE b WHEN 0 THEN q WHEN 1 THEN r WHEN 2 THEN abs(q - r) ELSE q * r END, 6) + 0.0 AS value FROM long, range(4) AS t(b)"""

def model(window: int | None = None) -> str:
    """Counted pairs and their scores; with a window, of windows side by side, whose first words follow none."""
    first = "i = 1" if window is None else f"(i - 1) % {window} = 0"
    return rf"""
long AS (
  SELECT user_id, file_id, CASE WHEN {first} THEN '<s>' ELSE lower(w[i - 1]) END AS prev, lower(w[i]) AS word FROM (SELECT user_id, file_id, w, unnest(range(1, len(w) + 1)) AS i FROM worded)
), pair AS (SELECT prev, word, count(*) AS pc FROM long GROUP BY ALL
), prevs AS (SELECT prev, sum(pc) AS vc FROM pair GROUP BY ALL
), singles AS (SELECT word, sum(pc) AS wc FROM pair GROUP BY ALL
), whole AS (SELECT sum(wc) AS total, count(*) AS vocabulary FROM singles
), model AS (
  SELECT prev, word, ln(0.75::DOUBLE * pc / vc + 0.25::DOUBLE * (wc + 1) / (total + vocabulary + 1)) AS lp, rank() OVER (PARTITION BY prev ORDER BY pc DESC) AS r
  FROM pair JOIN prevs USING (prev) JOIN singles USING (word), whole
), scored AS (SELECT user_id, file_id, lp, r FROM long JOIN model USING (prev, word))"""


def perplexity(window: int | None = None) -> str:
    return f"""
WITH {BASE}, {model(window)}, agg AS (SELECT user_id, file_id, avg(lp) AS m, count(*) AS n FROM scored GROUP BY ALL)
SELECT user_id, file_id, {real("exp(-m)", "perplexity")}, {real("coalesce(m, 0)", "avg_logprob")}, {real("coalesce(exp(-m), 0)", "ppl")}, coalesce(n, 0) AS lm_tokens FROM survey LEFT JOIN agg USING (user_id, file_id)"""


SQL["perplexity"] = perplexity()
SQL["perplexity_windowed"] = perplexity(64)
SHARES = ["proportion_top10", "proportion_top100", "proportion_top1000", "proportion_over1000"]
SQL["token_ranks"] = f"""
WITH {BASE}, {model()}, agg AS (
  SELECT user_id, file_id, avg(CAST(r <= 10 AS INT)) AS proportion_top10, avg(CAST(r > 10 AND r <= 100 AS INT)) AS proportion_top100, avg(CAST(r > 100 AND r <= 1000 AS INT)) AS proportion_top1000, avg(CAST(r > 1000 AS INT)) AS proportion_over1000,
         avg(r) AS mean_rank, median(r) AS median_rank, count(*) AS n FROM scored GROUP BY ALL)
SELECT user_id, file_id, {", ".join(real(f"coalesce({c}, 0)", c) for c in [*SHARES, "mean_rank", "median_rank"])}, coalesce(n, 0) AS n_pred_tokens, {real(f"coalesce({entropy(SHARES)}, 0)", "rank_entropy")} FROM survey LEFT JOIN agg USING (user_id, file_id)"""
SQL["token_ranks_integrated"] = f"""
WITH {BASE}, {model()}, vocab AS (SELECT word, rank() OVER (ORDER BY wc DESC) AS r FROM singles
), spread AS (SELECT prev, -sum(pc / vc * log2(pc / vc)) AS e FROM pair JOIN prevs USING (prev) GROUP BY prev
), agg AS (
  SELECT user_id, file_id, avg(CAST(r <= 10 AS INT)) AS proportion_top10, avg(CAST(r <= 100 AS INT)) AS proportion_top100, avg(CAST(r <= 1000 AS INT)) AS proportion_top1000, avg(CAST(r > 1000 AS INT)) AS proportion_over1000,
         avg(r) AS mean_rank, median(r) AS median_rank, avg(e) AS rank_entropy, count(*) AS n FROM long JOIN vocab USING (word) JOIN spread USING (prev) GROUP BY ALL)
SELECT user_id, file_id, {", ".join(real(f"coalesce({c}, 0)", c) for c in [*SHARES, "mean_rank", "median_rank", "rank_entropy"])}, coalesce(n, 0) AS n_pred_tokens FROM survey LEFT JOIN agg USING (user_id, file_id)"""

WORDS_OF = "list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*'), lambda x: lower(x)))"
SQL["consistency"] = rf"""
WITH {BASE}, cut AS (
  SELECT user_id, file_id, text, question, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')[1:10] AS s FROM survey
), pairs AS (
  SELECT user_id, file_id, 'pair' AS kind, s[i] AS p, s[i + 1] AS h FROM (SELECT *, unnest(range(1, len(s))) AS i FROM cut)
  UNION ALL SELECT user_id, file_id, 'pair', s[i + 1], s[i] FROM (SELECT *, unnest(range(1, len(s))) AS i FROM cut)
  UNION ALL SELECT user_id, file_id, 'rq', text, question FROM cut UNION ALL SELECT user_id, file_id, 'qr', question, text FROM cut
), sets AS (
  SELECT user_id, file_id, kind, {WORDS_OF.format("p")} AS p, {WORDS_OF.format("h")} AS h FROM pairs
), scored AS (
  SELECT *, CASE WHEN len(h) = 0 THEN 0 ELSE len(list_intersect(p, h)) / len(h) END AS o, list_has_any(p, [{quoted(v.NEGATIONS)}]) <> list_has_any(h, [{quoted(v.NEGATIONS)}]) AS neg FROM sets
), each AS (
  SELECT user_id, file_id, kind, CASE WHEN neg THEN o ELSE 0 END AS c, CASE WHEN neg THEN 0 ELSE o END AS e FROM scored
), agg AS (
  SELECT user_id, file_id, avg(e) FILTER (kind = 'pair') AS me, avg(c) FILTER (kind = 'pair') AS mc, max(c) FILTER (kind = 'pair') AS xc, avg(CAST(e > 0.5 AS INT)) FILTER (kind = 'pair') AS fe, avg(CAST(c > 0.5 AS INT)) FILTER (kind = 'pair') AS fc, count(*) FILTER (kind = 'pair') AS n,
         max(e) FILTER (kind = 'rq') AS rqe, max(e) FILTER (kind = 'qr') AS qre, max(c) FILTER (kind = 'rq') AS rqc, max(c) FILTER (kind = 'qr') AS qrc FROM each GROUP BY ALL)
SELECT user_id, file_id, {", ".join(real(f"coalesce({a}, 0)", b) for a, b in [("me", "nli_mean_entail"), ("mc", "nli_mean_contra"), ("xc", "nli_max_contra"), ("fe", "nli_frac_entail_gt50"), ("fc", "nli_frac_contra_gt50")])}, n AS nli_pairs_evaluated,
  {", ".join(real(f"CASE WHEN text = '' OR question = '' THEN 0 ELSE {a} END", b) for a, b in [("rqe", "nli_r_to_q_entail"), ("qre", "nli_q_to_r_entail"), ("rqc", "nli_r_to_q_contra"), ("qrc", "nli_q_to_r_contra")])}, len(s) AS n_sentences_resp
FROM cut JOIN agg USING (user_id, file_id)"""

SQL["split_rows"] = f"WITH {BASE} SELECT user_id, file_id, {split_of('user_id', 'file_id')} AS split FROM survey"
PREDICTED = f"predicted AS (SELECT user_id, file_id, rating, {split_of('user_id', 'file_id')} AS split, greatest(1.0::DOUBLE, least(5.0::DOUBLE, CASE WHEN len(w) = 0 THEN 0 ELSE list_sum(list_transform(w, lambda x: length(x))) / len(w) END)) AS p FROM worded)"
SQL["per_user"] = f"WITH {BASE}, {PREDICTED} SELECT user_id, {real('avg(rating)', 'true_avg_rating')}, {real('avg(p)', 'pred_avg_rating')}, count(*) AS n_rows FROM predicted GROUP BY user_id"
SQL["per_user_test_only"] = f"WITH {BASE}, {PREDICTED} SELECT user_id, {real('avg(rating)', 'true_avg_rating')}, {real('avg(p)', 'pred_avg_rating')}, count(*) AS n_test_rows FROM predicted WHERE split = 'test' GROUP BY user_id"
SQL["evaluation"] = f"WITH {BASE}, {PREDICTED} SELECT split, count(*) AS n, {real('avg((rating - p) * (rating - p))', 'mse')}, {real('avg(abs(rating - p))', 'mae')}, {real('1 - avg((rating - p) * (rating - p)) / nullif(var_pop(rating), 0)', 'r2')} FROM predicted GROUP BY split"
SQL["standardised"] = f"WITH {BASE}, {PREDICTED}, m AS (SELECT avg(p) AS a, stddev_pop(p) AS d FROM predicted WHERE split = 'train') SELECT user_id, file_id, {real('(p - a) / CASE WHEN d > 0 THEN d ELSE 1 END', 'pred_rating_z')} FROM predicted, m"
SQL["cleaning"] = f"""
WITH x AS (SELECT event_id, CASE WHEN event_id % 10 IN (0, 1, 2) THEN NULL ELSE CAST(value AS DOUBLE) END AS x FROM events), m AS (SELECT max(x) AS top FROM x)
SELECT event_id, {real("coalesce(x, 0)", "finite_or_zero")}, {real("coalesce(x, top, 1e6)", "to_max")}, {real("CASE WHEN x IS NOT NULL THEN greatest(1.0::DOUBLE, least(5.0::DOUBLE, x)) END", "clipped")} FROM x, m"""
SQL["coercion"] = f"SELECT event_id, {real('CAST(value AS DOUBLE)', 's')} FROM events WHERE event_id % 10 NOT IN (3, 4) AND value IS NOT NULL"
SQL["top_words_by_lang"] = rf"""
WITH w AS (SELECT lang, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*'))) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL)
SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS nth FROM c QUALIFY nth <= 5"""

# --- lexical diversity by factors: each step of the recursion finds where the next factor of every text ends -----------
SQL["lexical_mtld"] = rf"""
WITH RECURSIVE {BASE}, words AS (
  SELECT user_id, file_id, way, i, len(w) AS n, CASE way WHEN 0 THEN lower(w[i]) ELSE lower(w[len(w) + 1 - i]) END AS x
  FROM (SELECT user_id, file_id, w, way, unnest(range(1, len(w) + 1)) AS i FROM worded, range(2) AS t(way) WHERE len(w) >= 10)
), known AS (
  SELECT user_id, file_id, way, i, n, lag(i, 1, 0) OVER (PARTITION BY user_id, file_id, way, x ORDER BY i) AS last FROM words
), walk AS (
  SELECT DISTINCT user_id, file_id, way, n, CAST(1 AS BIGINT) AS start, CAST(0 AS DOUBLE) AS factors, false AS done FROM known
  UNION ALL
  SELECT user_id, file_id, way, any_value(n), CASE WHEN e IS NULL THEN any_value(n) + 1 ELSE e + 1 END, any_value(factors) + CASE WHEN e IS NULL THEN (1 - arg_max(ratio, i)) / (1 - 0.72::DOUBLE) ELSE 1 END, e IS NULL OR e = any_value(n)
  FROM (
    SELECT *, min(CASE WHEN ratio <= 0.72::DOUBLE THEN i END) OVER (PARTITION BY user_id, file_id, way) AS e FROM (
      SELECT walk.user_id, walk.file_id, walk.way, walk.n, walk.factors, known.i,
             CAST(sum(CAST(known.last < walk.start AS INT)) OVER (PARTITION BY walk.user_id, walk.file_id, walk.way ORDER BY known.i) AS DOUBLE) / (known.i - walk.start + 1) AS ratio
      FROM walk JOIN known ON known.user_id = walk.user_id AND known.file_id = walk.file_id AND known.way = walk.way AND known.i >= walk.start
      WHERE NOT walk.done))
  GROUP BY user_id, file_id, way, e
), ends AS (SELECT user_id, file_id, way, n / factors AS m FROM walk WHERE done AND factors > 0
), mean AS (SELECT user_id, file_id, avg(m) AS m FROM ends GROUP BY ALL)
SELECT user_id, file_id, {real("coalesce(m, 0)", "mtld")} FROM survey LEFT JOIN mean USING (user_id, file_id)"""

# --- places of connectives: words and what lies between them in turn, with the place where each begins -----------------
SINGLES = [w for words in v.CONNECTIVES.values() for w in words if " " not in w]
PHRASES = [w.split(" ") for words in v.CONNECTIVES.values() for w in words if " " in w]


def phrase_here(words: list[str]) -> str:
    return " AND ".join([f"x = '{words[0]}'", *(rf"regexp_full_match(x{2 * k + 1}, '\s+') AND x{2 * k + 2} = '{w}'" for k, w in enumerate(words[1:]))])


SQL["discourse_positions"] = rf"""
WITH {BASE}, cut AS (
  SELECT user_id, file_id, length(text) AS size, regexp_extract_all(lower(text), '{LETTERS}|[^\p{{L}}\p{{N}}_]+') AS p FROM survey
), pieces AS (
  SELECT user_id, file_id, size, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS x FROM cut
), placed AS (
  SELECT *, sum(length(x)) OVER (PARTITION BY user_id, file_id ORDER BY i) - length(x) AS place, {", ".join(f"lead(x, {k}) OVER (PARTITION BY user_id, file_id ORDER BY i) AS x{k}" for k in range(1, 9))} FROM pieces
), found AS (
  SELECT user_id, file_id, size, place FROM placed WHERE x IN ({quoted(SINGLES)})
  UNION ALL SELECT user_id, file_id, size, place FROM placed WHERE {" OR ".join("(" + phrase_here(w) + ")" for w in PHRASES)}
), agg AS (SELECT user_id, file_id, count(*) AS k, sum(place) / count(*) / any_value(size) AS p FROM found GROUP BY ALL)
SELECT user_id, file_id, coalesce(k, 0) AS total_connectives, round_even(coalesce(p, 0), 4) + 0.0 AS avg_connective_position FROM survey LEFT JOIN agg USING (user_id, file_id)"""

# --- the rule annotator: tags by word, heads by rule; a chain of links ends at the first token that is none -------------
NOMINALS = "('NOUN', 'PROPN', 'PRON')"


def tagged() -> str:
    classes: dict[str, list[str]] = {}
    for pos, words in v.CLOSED_CLASSES.items():
        for w in words:
            later = [p for p, others in list(v.CLOSED_CLASSES.items())[list(v.CLOSED_CLASSES).index(pos) + 1 :] if w in others]
            if not later:
                classes.setdefault(pos, []).append(w)
    closed = " ".join(f"WHEN low IN ({quoted(words)}) THEN '{pos}'" for pos, words in classes.items())
    endings = " ".join(f"WHEN {' OR '.join(f'(low LIKE {chr(39)}%{e}{chr(39)} AND length(low) > {len(e) + 2})' for e in ends)} THEN '{pos}'" for pos, ends in v.SUFFIXES.items())
    return rf"""
sentences AS (
  SELECT user_id, file_id, unnest(range(len(s))) AS sent, unnest(s) AS s FROM (
    SELECT user_id, file_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM survey)
), pieces AS (
  SELECT user_id, file_id, sent, unnest(range(1, len(p) + 1)) AS k, unnest(p) AS w FROM (
    SELECT user_id, file_id, sent, regexp_extract_all(s, '[\p{{L}}\p{{N}}]+(?:[-''][\p{{L}}\p{{N}}]+)*|[^\p{{L}}\p{{N}}_\s]|_') AS p FROM sentences)
), lowered AS (SELECT *, lower(w) AS low FROM pieces
), tagged AS (
  SELECT user_id, file_id, sent, k, low, CASE WHEN NOT regexp_matches(w, '[\p{{L}}\p{{N}}_]') THEN 'PUNCT' {closed} WHEN regexp_matches(w, '^\p{{Nd}}') THEN 'NUM' WHEN k > 1 AND regexp_matches(w, '^\p{{Lu}}') THEN 'PROPN' {endings} ELSE 'NOUN' END AS tag FROM lowered
), rooted AS (
  SELECT *, coalesce(min(CASE WHEN tag = 'VERB' THEN k END) OVER s, min(CASE WHEN tag <> 'PUNCT' THEN k END) OVER s, 1) AS root, count(*) OVER s AS n, lead(tag) OVER (PARTITION BY user_id, file_id, sent ORDER BY k) AS next, lag(tag) OVER (PARTITION BY user_id, file_id, sent ORDER BY k) AS before
  FROM tagged WINDOW s AS (PARTITION BY user_id, file_id, sent)
), linked AS (
  SELECT *, k <> root AND tag IN ('DET', 'ADJ', 'NUM', 'ADP', 'ADV', 'PART') AND coalesce(next, 'PUNCT') <> 'PUNCT' AS link FROM rooted
), headed AS (
  SELECT *, CASE WHEN k = root THEN k WHEN link THEN k + 1 ELSE root END AS head, min(CASE WHEN NOT link THEN k END) OVER (PARTITION BY user_id, file_id, sent ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM linked
)"""


def count_of(*tags: str) -> str:
    return f"count(*) FILTER (tag IN ({quoted(list(tags))}))"


POS_SHARES = ", ".join(f"{count_of(p)} AS c_{p}" for p in v.POS_ALL)
SQL["pos"] = rf"""
WITH {BASE}, {tagged()}, agg AS (
  SELECT user_id, file_id, count(*) AS n, max(sent) + 1 AS s, {POS_SHARES}, {count_of(*v.CONTENT_POS)} AS content, {count_of(*v.FUNCTION_POS)} AS func FROM tagged GROUP BY ALL
), whole AS (SELECT survey.user_id, survey.file_id, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(content, 0) AS content, coalesce(func, 0) AS func, {", ".join(f"coalesce(c_{p}, 0) AS c_{p}" for p in v.POS_ALL)} FROM survey LEFT JOIN agg USING (user_id, file_id))
SELECT user_id, file_id, n AS pos_token_count, {", ".join(f"c_{p} AS pos_count_{p}" for p in v.POS_TRACKED)}, {", ".join(real(f"CASE WHEN n = 0 THEN 0 ELSE c_{p} / n END", f"pos_prop_{p}") for p in v.POS_ALL)},
  {real("CASE WHEN func = 0 THEN CASE WHEN content > 0 THEN 1.0::DOUBLE ELSE 0 END ELSE content / func END", "content_vs_function_ratio")}, {real("CASE WHEN n = 0 THEN 0 ELSE c_PRON / n END", "pronoun_ratio")},
  {real("CASE WHEN s = 0 THEN 0 ELSE (c_VERB + c_AUX) / s END", "verbs_per_sentence")}, {real("CASE WHEN n = 0 THEN 0 ELSE " + entropy([f"c_{p} / n" for p in v.POS_ALL]) + " END", "pos_entropy")}, s AS sentence_count FROM whole"""

SQL["dependency"] = rf"""
WITH {BASE}, {tagged()}, sent AS (
  SELECT user_id, file_id, sent, count(*) AS n, max(stop - k + CASE WHEN stop = root THEN 1 ELSE 2 END) AS depth, coalesce(avg(abs(k - head)) FILTER (k <> root), 0) AS distance, count(*) FILTER (k <> root AND head = root) AS children FROM headed GROUP BY ALL
), agg AS (SELECT user_id, file_id, avg(depth) AS a, max(depth) AS m, stddev_pop(depth) AS d, avg(distance) AS g, avg(children) AS c, count(*) AS s, sum(n) AS n FROM sent GROUP BY ALL)
SELECT user_id, file_id, {real("coalesce(a, 0)", "avg_tree_depth")}, {real("CAST(coalesce(m, 0) AS DOUBLE)", "max_tree_depth")}, {real("coalesce(d, 0)", "std_tree_depth")}, {real("coalesce(g, 0)", "avg_dep_distance")}, {real("coalesce(c, 0)", "root_children_mean")},
  coalesce(s, 0) AS n_sentences_dep, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens_dep FROM survey LEFT JOIN agg USING (user_id, file_id)"""

SQL["entity_grid"] = rf"""
WITH {BASE}, {tagged()}, size AS (SELECT user_id, file_id, max(sent) + 1 AS s FROM tagged GROUP BY ALL
), mention AS (
  SELECT user_id, file_id, low, sent, CASE WHEN k = root THEN 'X' WHEN before = 'ADP' THEN 'O' WHEN k < root THEN 'S' ELSE 'O' END AS role FROM headed WHERE tag IN {NOMINALS}
), chained AS (SELECT *, lag(role) OVER (PARTITION BY user_id, file_id, low ORDER BY sent, role) AS last FROM mention
), entity AS (SELECT user_id, file_id, low, count(*) AS m, count(*) FILTER (role <> last) AS changed FROM chained GROUP BY ALL
), grid AS (SELECT user_id, file_id, count(*) AS e, sum(m) AS m, count(*) FILTER (m > 1) AS many, count(*) FILTER (m = 1) AS once, sum(changed) AS changed FROM entity GROUP BY ALL
), whole AS (SELECT survey.user_id, survey.file_id, coalesce(s, 0) AS s, coalesce(e, 0) AS e, coalesce(m, 0) AS m, many, once, changed FROM survey LEFT JOIN size USING (user_id, file_id) LEFT JOIN grid USING (user_id, file_id))
SELECT user_id, file_id, e AS unique_entities, {real("CASE WHEN s = 0 THEN 0 ELSE m / s END", "avg_entities_per_sent")}, {real("CASE WHEN s < 2 OR e = 0 THEN 0 ELSE many / e END", "entity_continuity")},
  {real("CASE WHEN s = 0 THEN 0 WHEN s = 1 THEN 1 WHEN e = 0 THEN 0 ELSE once / e END", "entity_introductions")}, {real("CASE WHEN s < 2 OR m = e THEN 0 ELSE changed / (m - e) END", "role_transitions")}, {real("CASE WHEN s < 2 OR e = 0 THEN 0 ELSE m / (s * e) END", "grid_density")} FROM whole"""


# --- the hashing encoder: a word's signs are the bits of its digests -----------------------------------------------------
def vectors(dimension: int) -> str:
    digest = "md5(word || CASE WHEN k = 0 THEN '' ELSE '#' || k END)"
    return rf"""
counted AS (
  SELECT user_id, file_id, side, word, count(*) AS n FROM (
    SELECT user_id, file_id, 'r' AS side, unnest(regexp_extract_all(lower(text), '\S+')) AS word FROM survey
    UNION ALL SELECT user_id, file_id, 'q', unnest(regexp_extract_all(lower(question), '\S+')) FROM survey) GROUP BY ALL
), signs AS (
  SELECT word, list_transform(range({dimension}), lambda d: ((instr('0123456789abcdef', h[d // 4 + 1]) - 1) >> (3 - d % 4)) % 2 * 2 - 1) AS v FROM (
    SELECT word, string_agg({digest}, '' ORDER BY k) AS h FROM (SELECT DISTINCT word FROM counted), range({-(-dimension // 128)}) AS t(k) GROUP BY word)
), sums AS (
  SELECT user_id, file_id, side, d, sum(n * x) AS x FROM (SELECT user_id, file_id, side, n, unnest(range({dimension})) AS d, unnest(v) AS x FROM counted JOIN signs USING (word)) GROUP BY ALL
), scaled AS (
  SELECT user_id, file_id, side, d, x / sqrt(sum(x * x) OVER (PARTITION BY user_id, file_id, side)) AS x FROM sums QUALIFY sum(x * x) OVER (PARTITION BY user_id, file_id, side) > 0
), both_sides AS (
  SELECT user_id, file_id, d, max(x) FILTER (side = 'q') AS q, max(x) FILTER (side = 'r') AS r FROM scaled GROUP BY ALL
)"""


SQL["text_similarity"] = rf"""
WITH {BASE}, {vectors(64)}, agg AS (SELECT user_id, file_id, sum(q * r) AS d, sqrt(sum(q * q)) AS qn, sqrt(sum(r * r)) AS rn FROM both_sides GROUP BY ALL
), whole AS (SELECT survey.user_id, survey.file_id, coalesce(d, 0) AS d, coalesce(qn, 0) AS qn, coalesce(rn, 0) AS rn FROM survey LEFT JOIN agg USING (user_id, file_id))
SELECT user_id, file_id, {real("d / ((qn + 1e-12) * (rn + 1e-12))", "cosine_sim")}, {real("qn", "q_norm")}, {real("rn", "r_norm")}, {real("abs(qn - rn)", "norm_gap")} FROM whole"""

SQL["clip_text"] = rf"""
WITH {BASE}, {vectors(512)}, agg AS (SELECT user_id, file_id, sum(q * r) AS c, list(r ORDER BY d) AS v FROM both_sides GROUP BY ALL)
SELECT user_id, file_id, {real("coalesce(c, 0)", "clip_qr_cosine")}, {", ".join(real(f"coalesce(v[{k + 1}], 0)", f"clip_dim_{k:03d}") for k in range(512))} FROM survey LEFT JOIN agg USING (user_id, file_id)"""

SQL["truncated_tokens"] = rf"""
WITH {BASE}, cut AS (SELECT user_id, file_id, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]') AS t FROM survey), done AS (
  SELECT user_id, file_id, CASE WHEN len(t) > 256 THEN array_to_string(t[1:256], '') ELSE text END AS x FROM cut)
SELECT user_id, file_id, md5(x) AS cut_md5, length(x) AS n_chars FROM done"""

JOINED = ["readability", "lexical_richness", "lexical_mtld", "discourse", "discourse_positions", "sentiment", "consistency"]
SQL["master_surface"] = (
    f"SELECT * EXCLUDE (part) FROM (SELECT a.*, r.rating, 0 AS part FROM ({SQL['sentence_length']}) a JOIN (WITH {BASE} SELECT user_id, file_id, rating FROM survey) r USING (user_id, file_id))"
    + "".join(f" JOIN (SELECT * {'EXCLUDE (total_connectives)' if name == 'discourse_positions' else ''} FROM ({SQL[name]})) USING (user_id, file_id)" for name in JOINED)
)

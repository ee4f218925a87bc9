"""DuckDB SQL of the queries, over the shared tables. PREFIX repeats the tables of sources.model_tables."""

from __future__ import annotations

import re
from functools import reduce

from actlake.functions.text import ARTEFACTS
from actlake.operators.stats import quantile_grid

PREFIX = r"""
WITH toks AS (SELECT doc_id, string_split_regex(trim(text, chr(32)||chr(9)||chr(10)||chr(13)), '[ \t\n\r]+') AS t FROM documents WHERE length(trim(text, chr(32)||chr(9)||chr(10)||chr(13))) > 0),
flat AS MATERIALIZED (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS i FROM toks),
vocab AS MATERIALIZED (SELECT token, (row_number() OVER (ORDER BY token) - 1)::INT AS token_id FROM (SELECT DISTINCT token FROM flat)),
token_pos AS MATERIALIZED (SELECT doc_id * 67108864 + i // 32 AS prompt_idx, (i % 32)::INT AS pos, token_id FROM flat JOIN vocab USING (token)),
prompts AS (SELECT prompt_idx, list(token_id ORDER BY pos) AS token_ids FROM token_pos GROUP BY prompt_idx),
emb AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, embedding::DOUBLE[] AS x FROM embeddings),
nvec AS (SELECT count(*) AS nv FROM emb),
posv AS MATERIALIZED (SELECT prompt_idx, pos, token_id, ((token_id::BIGINT * 31 + pos * 7) % nv) AS vec_id FROM token_pos, nvec),
encoder AS (SELECT f::INT AS feature_id, list_transform(range(0, 64), lambda i: (CASE WHEN i = f % 64 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + ([0.1, -0.2, 0.3, -0.4]::DOUBLE[])[i % 4 + 1] * ([0.2, -0.1, 0.4, -0.2]::DOUBLE[])[f % 4 + 1]) AS w, -0.15::DOUBLE AS b, f * 0.01::DOUBLE AS threshold FROM range(16) r(f)),
decoder AS (SELECT f::INT AS feature_id, list_transform(range(0, 64), lambda i: (CASE WHEN i = f % 64 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + ([-0.4, 0.4, 0.8, -0.8]::DOUBLE[])[f % 4 + 1] * ([0.3, -0.3, 0.6, -0.6]::DOUBLE[])[i % 4 + 1]) AS w FROM range(16) r(f)),
vec_acts AS MATERIALIZED (SELECT feature_id, vec_id, round(list_dot_product(x, w) + b, 6) AS act FROM emb, encoder),
fa AS MATERIALIZED (SELECT feature_id, prompt_idx, pos, token_id, act FROM posv JOIN vec_acts USING (vec_id) WHERE act > 0),
vec_n AS (SELECT vec_id, count(*) AS n FROM posv GROUP BY vec_id),
total AS (SELECT count(*) AS n FROM token_pos),
vocv AS (SELECT token_id, token, (token_id::BIGINT * 17 + 3) % nv AS vec_id FROM vocab, nvec),
unembed AS (SELECT token_id, x AS w_u FROM vocv JOIN emb USING (vec_id)),
vec_logits AS (SELECT feature_id, vec_id, round(list_dot_product(x, w), 6) + 0.0 AS logit FROM emb, decoder),
logits AS (SELECT feature_id, token_id, logit FROM vocv JOIN vec_logits USING (vec_id)),
"""

_TOP = """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY act DESC, prompt_idx, pos) AS rank FROM fa) WHERE rank <= 20),
"""
_GROUPS = """best AS (SELECT feature_id, max(act) AS m, count(*) AS active FROM fa GROUP BY feature_id),
bounds AS (SELECT feature_id, active, (5 - i)::INT AS group_ord, round(m * i / 5, 6) AS lower, round(m * (i + 1) / 5, 6) AS upper FROM best, range(5) r(i)),
inside AS (SELECT feature_id, group_ord, prompt_idx, pos, act FROM fa JOIN bounds USING (feature_id) WHERE act BETWEEN lower AND upper),
"""
_PEARSON = "round((n * sxy - sx * sy) / (sqrt(greatest((n * sxx - sx * sx) * (n * syy - sy * sy), 0.0)) + 1e-6), 5)"
_COSINE = "round(sxy / (sqrt(sxx * syy) + 1e-6), 5)"
_ATTN = """attn_at AS (SELECT a.feature_id, a.prompt_idx, s.pos AS src, x, w, 1.0::DOUBLE / (a.pos + 1) AS p
  FROM (SELECT feature_id, prompt_idx, arg_max(pos, {'a': act, 'p': -pos}) AS pos FROM fa GROUP BY ALL) a JOIN posv s ON s.prompt_idx = a.prompt_idx AND s.pos <= a.pos JOIN emb USING (vec_id) JOIN encoder ON encoder.feature_id = a.feature_id),
"""


def _attribution(value: str) -> str:
    return (
        _ATTN
        + f"""parts AS (SELECT feature_id, prompt_idx, src, round({value}, 3) + 0.0 AS v FROM attn_at),
lists AS (SELECT feature_id, prompt_idx, list(v ORDER BY src) AS l FROM parts GROUP BY ALL)
SELECT feature_id, prompt_idx, list_max(l) AS dfa_max_value, (list_position(l, list_max(l)) - 1)::INT AS dfa_target_index, len(l) AS n_src, round(list_sum(l), 3) + 0.0 AS dfa_sum FROM lists"""
    )


_CHANGES = r"""bflat AS (SELECT item_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS i FROM (SELECT item_id, string_split_regex(trim(text, chr(32)||chr(9)||chr(10)||chr(13)), '[ \t\n\r]+') AS t FROM benchmark)),
bpos AS (SELECT item_id * 67108864 + i // 32 AS prompt_idx, (i % 32)::INT AS pos, coalesce(token_id, 0) AS token_id FROM bflat LEFT JOIN vocab USING (token)),
bv AS (SELECT prompt_idx, pos, (token_id::BIGINT * 31 + pos * 7) % (SELECT nv FROM nvec) AS vec_id, lead(token_id) OVER (PARTITION BY prompt_idx ORDER BY pos) AS nx FROM bpos),
a AS (SELECT feature_id, prompt_idx, pos, vec_id, (nx::BIGINT * 17 + 3) % (SELECT nv FROM nvec) AS u FROM bv JOIN vec_acts USING (vec_id) WHERE act > 0 AND nx IS NOT NULL),
un AS (SELECT vec_id AS u, count(*) AS n FROM vocv GROUP BY 1),
abl AS (SELECT feature_id, vec_id, x, list_transform(range(1, 65), lambda i: x[i] - act * w[i]) AS y FROM vec_acts JOIN emb USING (vec_id) JOIN decoder USING (feature_id) WHERE act > 0),
z AS (SELECT feature_id, abl.vec_id, u, n, list_dot_product(y, e.x) / list_aggregate(y, 'stddev_samp') AS zn, list_dot_product(abl.x, e.x) / list_aggregate(abl.x, 'stddev_samp') AS zo FROM abl, un JOIN emb e ON e.vec_id = u),
"""
_LOSS = _CHANGES + r"""ls AS (SELECT feature_id, vec_id, ln(sum(n * exp(zn))) AS sn, ln(sum(n * exp(zo))) AS so FROM z GROUP BY ALL),
l AS (SELECT a.feature_id, prompt_idx, pos, round((zn - sn) - (zo - so), 6) + 0.0 AS loss FROM a JOIN z USING (feature_id, vec_id, u) JOIN ls USING (feature_id, vec_id)),
x AS (SELECT *, row_number() OVER (PARTITION BY prompt_idx, pos ORDER BY loss, feature_id) AS rank FROM l)
SELECT 'loss_effect' AS metric, prompt_idx, pos + 1 AS pos, rank, feature_id, loss AS score FROM x WHERE rank <= 3"""
_GRID = f"[{', '.join(map(str, quantile_grid()))}]"

def _sequences(members: str) -> str:
    """Whole prompts without their first token for rows of feature_id, group_ord, rank, prompt_idx, pos: seqs, vals and named."""
    return f"""members AS ({members}),
seqs AS (SELECT m.*, token_ids[2:] AS ids FROM members m JOIN prompts USING (prompt_idx) WHERE len(token_ids) > 1),
places AS (SELECT feature_id, group_ord, rank, prompt_idx, generate_subscripts(ids, 1) AS i, unnest(ids) AS token_id FROM seqs),
vals AS (SELECT e.feature_id, e.group_ord, e.rank, list(round(coalesce(fa.act, 0) + 1e-9::DOUBLE, 4) ORDER BY i) AS vals FROM places e LEFT JOIN fa ON fa.feature_id = e.feature_id AND fa.prompt_idx = e.prompt_idx AND fa.pos = e.i GROUP BY ALL),
named AS (SELECT feature_id, group_ord, rank, string_agg(token, ' ' ORDER BY i) AS tokens, count(*) AS n_tokens FROM places JOIN vocab USING (token_id) GROUP BY ALL),
"""


_SAMPLES = "z AS (SELECT b.feature_id, b.group_ord, p.prompt_idx, p.pos, 0.0 AS act FROM (SELECT feature_id, group_ord FROM bounds WHERE lower <= 0) b, token_pos p ANTI JOIN fa ON fa.feature_id = b.feature_id AND fa.prompt_idx = p.prompt_idx AND fa.pos = p.pos), drawn AS (SELECT *, md5('0|' || prompt_idx || '|' || pos) AS k FROM (FROM inside UNION ALL FROM z)), r AS (SELECT *, row_number() OVER (PARTITION BY feature_id, group_ord ORDER BY k, prompt_idx, pos) AS rank FROM drawn),\n"
_ALL_GROUPS = _TOP + _GROUPS + _SAMPLES + _sequences("SELECT feature_id, 0 AS group_ord, rank, prompt_idx, pos FROM top UNION ALL SELECT feature_id, group_ord, rank, prompt_idx, pos FROM r WHERE rank <= 5")
_BINS = """shares AS (SELECT feature_id, group_ord, count(*) AS k FROM inside GROUP BY ALL),
bins AS (SELECT b.feature_id, b.group_ord, printf('%.3f', lower)::DOUBLE AS bin_min, printf('%.3f', upper)::DOUBLE AS bin_max, round(printf('%.3f', (coalesce(k, 0) + CASE WHEN lower <= 0 THEN n - active ELSE 0 END) / n * 100)::DOUBLE / 100, 8) AS bin_contains FROM bounds b LEFT JOIN shares USING (feature_id, group_ord), total
UNION ALL SELECT feature_id, 0, -1.0, printf('%.3f', m)::DOUBLE, -1.0 FROM best),
"""
# The label of each distinct activation: of the first grid point whose quantile isn't below it.
_LABELS = f"""a AS (SELECT feature_id, CASE WHEN act > 0 THEN act ELSE 0.0 END AS act FROM posv JOIN vec_acts USING (vec_id)),
q AS (SELECT feature_id, list_transform(quantile_cont(act, {_GRID}), lambda v: round(v, 6)) AS qd FROM a GROUP BY feature_id),
lab0 AS (SELECT feature_id, act, list_append({_GRID}::DOUBLE[], 1.0::DOUBLE)[len(list_filter(qd, lambda v: v < act)) + 1] AS label FROM (SELECT DISTINCT feature_id, act FROM fa) JOIN q USING (feature_id)),
lab AS (SELECT *, CASE WHEN label >= 0.99 THEN 5 WHEN label >= 0.95 THEN 4 ELSE 3 END::INT AS decimals FROM lab0),
"""

SQL: dict[str, str] = {
    "prompt_dedupe": "x AS (SELECT min(prompt_idx) AS prompt_idx, token_ids FROM prompts GROUP BY token_ids) SELECT prompt_idx, len(token_ids) AS n_tokens, md5(array_to_string(token_ids, ',')) AS tokens_md5 FROM x",
    "duplicate_rows": "x AS (SELECT token_ids, count(*) AS n FROM prompts GROUP BY token_ids HAVING count(*) > 1) SELECT md5(array_to_string(token_ids, ',')) AS tokens_md5, n FROM x",
    "prompt_sample": "x AS (SELECT prompt_idx, len(token_ids) AS n_tokens FROM prompts ORDER BY md5('0|' || prompt_idx), prompt_idx LIMIT 100) SELECT * FROM x",
    "prompt_prefix_suffix": "x AS (SELECT prompt_idx, CASE WHEN len(token_ids) >= 6 THEN list_concat(token_ids[1:1], [7, 8, 9], token_ids[2:len(token_ids) - 5], [10, 11]) ELSE token_ids END AS t FROM prompts) SELECT prompt_idx, len(t) AS n_tokens, md5(array_to_string(t, ',')) AS tokens_md5 FROM x",
    "prompt_template": "x AS (SELECT prompt_idx, list_concat([1, 2, 3], token_ids[2:])[1:32] AS t FROM prompts) SELECT prompt_idx, len(t) AS n_tokens, md5(array_to_string(t, ',')) AS tokens_md5 FROM x",
    "vocab_clean_pad": "x AS (SELECT r.i::INT AS token_id, coalesce(replace(replace(token, 'Ġ', ' '), 'Ċ', chr(10)), '<|missing token|>') AS token FROM range((SELECT count(*) FROM vocab) + 100) r(i) LEFT JOIN vocab ON token_id = r.i) SELECT * FROM x",
    "encode_relu": "x AS (SELECT * FROM fa) SELECT feature_id, prompt_idx, pos, token_id, act FROM x",
    "encode_jumprelu": "x AS (SELECT feature_id, prompt_idx, pos, act FROM posv JOIN vec_acts USING (vec_id) JOIN encoder USING (feature_id) WHERE act > greatest(threshold, 0)) SELECT feature_id, prompt_idx, count(*) AS n, sum(round(act * 1000000)::BIGINT)::BIGINT AS act_sum, max(act) AS act_max FROM x GROUP BY ALL",
    "encode_probe": "p AS (SELECT label, list(m ORDER BY i) AS w FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, i) GROUP BY label), va AS (SELECT label, vec_id, round(list_dot_product(x, w), 6) + 0.0 AS act FROM emb, p) SELECT label AS feature_id, prompt_idx, count(*) AS n, min(act) AS act_min, max(act) AS act_max, sum(round(act * 1000000)::BIGINT)::BIGINT AS act_sum FROM posv JOIN va USING (vec_id) GROUP BY ALL",
    "encode_batchtopk": "r AS (SELECT *, prompt_idx // (8 * 67108864::BIGINT) AS batch_id FROM fa), s AS (SELECT batch_id, 2 * count(DISTINCT (prompt_idx, pos)) AS k FROM r GROUP BY 1), t AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY act DESC, prompt_idx, pos, feature_id) AS rn FROM r) SELECT batch_id, feature_id, count(*) AS n, min(act) AS act_min, max(act) AS act_max FROM t JOIN s USING (batch_id) WHERE rn <= k GROUP BY ALL",
    "encode_normalised": "xn AS (SELECT vec_id, list_transform(x, lambda v, i: (v - 0.01) / (0.1 + (i - 1) * 0.001 + 1e-6)) AS x FROM emb), va AS (SELECT feature_id, vec_id, round(list_dot_product(x, w) + b, 6) AS act FROM xn, encoder) SELECT feature_id, prompt_idx, count(*) AS n, max(act) AS act_max, sum(round(act * 1000000)::BIGINT)::BIGINT AS act_sum FROM posv JOIN va USING (vec_id) WHERE act > 0 GROUP BY ALL",
    "fold_decoder_norm": "n AS (SELECT feature_id, sqrt(list_sum(list_transform(w, lambda v: v * v))) AS s FROM decoder) SELECT feature_id, (i - 1)::INT AS i, round(w * s, 6) AS w_enc, round(b * s, 6) AS b_enc, round(w, 6) AS unfolded FROM (SELECT feature_id, s, b, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM encoder JOIN (SELECT feature_id, CASE WHEN s = 0 THEN 1 ELSE s END AS s FROM n) USING (feature_id))",
    "high_norm_mask": "xs AS (SELECT vec_id, list_transform(x, lambda v: v * (1 + vec_id % 7)) AS x FROM emb), nv AS (SELECT vec_id, round(sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) AS nrm FROM xs), p AS (SELECT prompt_idx, pos, nrm, prompt_idx // (64 * 67108864::BIGINT) AS b FROM posv JOIN nv USING (vec_id)), m AS (SELECT b, quantile_disc(nrm, 0.5) AS med FROM p GROUP BY b) SELECT prompt_idx, count(*) AS n, count(*) FILTER (nrm > 1.5 * med) AS outliers, round(sum(CASE WHEN nrm > 1.5 * med THEN 0 ELSE nrm END), 4) AS kept_norm FROM p JOIN m USING (b) GROUP BY prompt_idx",
    "ignore_masks": "freq AS (SELECT token_id FROM token_pos GROUP BY token_id ORDER BY count(*) DESC, token_id LIMIT 3) SELECT feature_id, count(*) AS n, sum(round(act * 1000000)::BIGINT)::BIGINT AS act_sum, max(act) AS act_max FROM fa WHERE token_id NOT IN (SELECT token_id FROM freq) AND pos NOT IN (0, 1, 2) GROUP BY feature_id",
    "threshold_mask": "x AS (SELECT feature_id, prompt_idx, pos, act FROM fa JOIN encoder USING (feature_id) WHERE act >= threshold) SELECT feature_id, count(*) AS n, sum(round(act * 1000000)::BIGINT)::BIGINT AS act_sum, min(act) AS act_min FROM x GROUP BY feature_id",
    "feature_density": "a AS (SELECT feature_id, max(act) AS m, count(*) AS k, count(*) FILTER (abs(act) > 1e-6) AS z FROM fa GROUP BY feature_id) SELECT feature_id, coalesce(m, 0.0) AS max_act, coalesce(k, 0) AS n_active, round(coalesce(k, 0) / n, 6) AS frac_active, round(coalesce(z, 0) / n, 6) AS frac_nonzero FROM encoder LEFT JOIN a USING (feature_id), total",
    "feature_moments": "s AS (SELECT feature_id, sum(act) / any_value(n) AS m, sum(act ** 2) / any_value(n) AS e2, sum(act ** 3) / any_value(n) AS e3, sum(act ** 4) / any_value(n) AS e4 FROM fa, total GROUP BY feature_id) SELECT feature_id, round(m, 6) AS mean_act, round((e3 - 3 * m * e2 + 2 * m ** 3) / pow(e2 - m * m, 1.5), 4) AS skewness, round((e4 - 4 * m * e3 + 6 * m * m * e2 - 3 * m ** 4) / ((e2 - m * m) * (e2 - m * m)) - 3, 4) AS kurtosis FROM s",
    "feature_quantiles": f"a AS (SELECT feature_id, CASE WHEN act > 0 THEN act ELSE 0.0 END AS act FROM posv JOIN vec_acts USING (vec_id)), q AS (SELECT feature_id, quantile_cont(act, {_GRID}) AS qd FROM a GROUP BY feature_id) SELECT feature_id, unnest({_GRID}::DOUBLE[]) AS q, round(unnest(qd), 6) AS quantile FROM q",
    "reverse_quantile": _LABELS + "m AS (SELECT feature_id, prompt_idx, max(act) AS act FROM fa GROUP BY ALL) SELECT feature_id, prompt_idx, act, label, decimals FROM m JOIN lab USING (feature_id, act)",
    "acts_histogram": "e AS (SELECT feature_id, min(act) AS lo, max(act) AS hi FROM fa GROUP BY feature_id), h AS (SELECT feature_id, CASE WHEN hi = lo THEN 25 ELSE least(floor((act - lo) / ((hi - lo) / 50)), 49) END::INT AS bin, count(*) AS c FROM fa JOIN e USING (feature_id) GROUP BY ALL) SELECT e.feature_id, r.i::INT AS bin, coalesce(c, 0) AS height, round(lo + (r.i + 0.5) * ((hi - lo) / 50) + 1e-9::DOUBLE, 5) AS bar_value FROM e CROSS JOIN range(50) r(i) LEFT JOIN h ON h.feature_id = e.feature_id AND h.bin = r.i",
    "logits_histogram": "e AS (SELECT feature_id, min(logit) AS lo, max(logit) AS hi FROM logits GROUP BY feature_id), h AS (SELECT feature_id, CASE WHEN hi = lo THEN 25 ELSE least(floor((logit - lo) / ((hi - lo) / 50)), 49) END::INT AS bin, count(*) AS c FROM logits JOIN e USING (feature_id) GROUP BY ALL) SELECT e.feature_id, r.i::INT AS bin, coalesce(c, 0) AS height, round(lo + (r.i + 0.5) * ((hi - lo) / 50) + 1e-9::DOUBLE, 5) AS bar_value FROM e CROSS JOIN range(50) r(i) LEFT JOIN h ON h.feature_id = e.feature_id AND h.bin = r.i",
    "histogram_ticks": "e AS (SELECT feature_id, min(logit) AS lo, max(logit) AS hi FROM logits GROUP BY feature_id), s AS (SELECT *, 0.1::DOUBLE * floor(1e-4::DOUBLE + greatest(hi, -lo) / 0.3::DOUBLE) + 1e-6::DOUBLE AS step FROM e), k AS (SELECT *, least(3, greatest(0, floor(least(hi, -lo) / step)))::INT AS k FROM s), j AS (SELECT feature_id, step, unnest(range(CASE WHEN hi > -lo THEN -k ELSE -3 END, CASE WHEN hi > -lo THEN 4 ELSE k + 1 END)) AS i FROM k) SELECT feature_id, round(i * step, 1) + 0.0 AS tick FROM j",
    "logit_lens_topk": "x AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY logit DESC, token_id) AS rank FROM logits) SELECT feature_id, rank, token_id, token, logit FROM x JOIN vocab USING (token_id) WHERE rank <= 10",
    "logit_lens_bottomk": "x AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY logit, token_id) AS rank FROM logits) SELECT feature_id, rank, token_id, token, logit FROM x JOIN vocab USING (token_id) WHERE rank <= 10",
    "neuron_alignment": "d AS (SELECT feature_id, unnest(w) AS v, generate_subscripts(w, 1) - 1 AS idx, list_sum(list_transform(w, lambda v: abs(v))) AS l1 FROM decoder), r AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY v DESC, idx) AS rank FROM d) SELECT feature_id, rank, idx::INT AS idx, round(v, 5) AS value, round(abs(v) / l1, 5) AS l1_share FROM r WHERE rank <= 3",
    "decoder_head_allocation": "h AS (SELECT feature_id, list_transform(range(0, 4), lambda h: sqrt(list_sum(list_transform(w[h * 16 + 1 : h * 16 + 16], lambda v: v * v)))) AS n FROM decoder) SELECT feature_id, (i - 1)::INT AS head, round(n[i] / list_sum(n), 6) AS share FROM h, range(1, 5) r(i)",
    "residual_direction": "d AS (SELECT feature_id, unnest(w) AS v, generate_subscripts(w, 1) - 1 AS i FROM decoder), o AS (SELECT vec_id AS i, unnest(x) AS o, generate_subscripts(x, 1) - 1 AS j FROM emb WHERE vec_id IN (SELECT unnest(range(64)))) SELECT feature_id, j::INT AS j, round(sum(v * o), 6) + 0.0 AS v FROM d JOIN o USING (i) GROUP BY ALL",
    "corr_features_topk": f"a AS (SELECT feature_id, vec_id, act, v.n AS c FROM vec_acts JOIN vec_n v USING (vec_id) WHERE act > 0), s AS (SELECT feature_id, sum(act * c) AS s, sum(act * act * c) AS ss FROM a GROUP BY feature_id), p AS (SELECT x.feature_id AS x_id, y.feature_id AS y_id, sum(x.act * y.act * x.c) AS sxy FROM a x JOIN a y ON x.vec_id = y.vec_id AND x.feature_id <> y.feature_id AND x.feature_id // 8 = y.feature_id // 8 GROUP BY ALL), c AS (SELECT x_id, y_id, {_PEARSON} AS pearson, {_COSINE} AS cossim FROM (SELECT x_id, y_id, sxy, sx.s AS sx, sx.ss AS sxx, sy.s AS sy, sy.ss AS syy, n::DOUBLE AS n FROM p JOIN s sx ON sx.feature_id = x_id JOIN s sy ON sy.feature_id = y_id, total) UNION ALL SELECT feature_id, feature_id, 0.0, 0.0 FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY x_id ORDER BY pearson DESC, y_id) AS rank FROM c) SELECT x_id, rank, y_id, pearson, cossim FROM r WHERE rank <= 3",
    "corr_neurons_topk": f"d AS (SELECT vec_id, unnest(x) AS y, (generate_subscripts(x, 1) - 1)::INT AS idx FROM emb), q AS (SELECT feature_id, idx, sum(v.n)::DOUBLE AS n, sum(greatest(act, 0) * v.n) AS sx, sum(y * v.n) AS sy, sum(greatest(act, 0) ** 2 * v.n) AS sxx, sum(y * y * v.n) AS syy, sum(greatest(act, 0) * y * v.n) AS sxy FROM vec_acts JOIN vec_n v USING (vec_id) JOIN d USING (vec_id) GROUP BY ALL), c AS (SELECT feature_id, idx, {_PEARSON} AS pearson, {_COSINE} AS cossim FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY pearson DESC, idx) AS rank FROM c) SELECT feature_id, rank, idx, pearson, cossim FROM r WHERE rank <= 3",
    "top_activations": _TOP + "x AS (SELECT * FROM top) SELECT feature_id, rank, prompt_idx, pos, token, act, md5(array_to_string(token_ids[greatest(pos - 5, 0) + 1 : pos + 6], ',')) AS window_md5 FROM x JOIN prompts USING (prompt_idx) JOIN vocab USING (token_id)",
    "bottom_activations": "x AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY act, prompt_idx, pos) AS rank FROM fa) SELECT feature_id, rank, prompt_idx, pos, act FROM x WHERE rank <= 20",
    "interval_share": _GROUPS + "c AS (SELECT feature_id, group_ord, count(*) AS k FROM inside GROUP BY ALL) SELECT b.feature_id, b.group_ord, lower, upper, round((coalesce(k, 0) + CASE WHEN lower <= 0 THEN n - active ELSE 0 END) / n, 6) AS pct FROM bounds b LEFT JOIN c USING (feature_id, group_ord), total",
    "interval_samples": _GROUPS + "z AS (SELECT b.feature_id, b.group_ord, p.prompt_idx, p.pos, 0.0 AS act FROM (SELECT feature_id, group_ord FROM bounds WHERE lower <= 0) b, token_pos p ANTI JOIN fa ON fa.feature_id = b.feature_id AND fa.prompt_idx = p.prompt_idx AND fa.pos = p.pos), a AS (SELECT *, md5('0|' || prompt_idx || '|' || pos) AS k FROM (FROM inside UNION ALL FROM z)), r AS (SELECT *, row_number() OVER (PARTITION BY feature_id, group_ord ORDER BY k, prompt_idx, pos) AS rank FROM a) SELECT feature_id, group_ord, rank, prompt_idx, pos, act FROM r WHERE rank <= 5",
    "context_windows": _TOP + "d AS (SELECT feature_id, rank, t.prompt_idx, t.pos, p.pos AS wpos, p.token_id FROM top t JOIN token_pos p ON p.prompt_idx = t.prompt_idx AND p.pos BETWEEN t.pos - 5 AND t.pos + 5) SELECT d.feature_id, d.rank, d.prompt_idx, d.pos, d.wpos, d.token_id, round(coalesce(fa.act, 0) + 1e-9::DOUBLE, 4) AS act FROM d LEFT JOIN fa ON fa.feature_id = d.feature_id AND fa.prompt_idx = d.prompt_idx AND fa.pos = d.wpos",
    "full_sequence_windows": _TOP + "x AS (SELECT * FROM top) SELECT feature_id, rank, prompt_idx, pos, len(token_ids[2:]) AS n_tokens, md5(array_to_string(token_ids[2:], ',')) AS window_md5 FROM x JOIN prompts USING (prompt_idx)",
    "act_lag_lead": "o AS (SELECT prompt_idx, pos, lead(token_id) OVER w AS nx, lag(token_id) OVER w AS pv FROM token_pos WINDOW w AS (PARTITION BY prompt_idx ORDER BY pos)), x AS (SELECT a.feature_id, a.prompt_idx, a.pos, a.act, coalesce(b.act, 0) AS prev_act, nx, pv FROM fa a JOIN o USING (prompt_idx, pos) LEFT JOIN fa b ON b.feature_id = a.feature_id AND b.prompt_idx = a.prompt_idx AND b.pos = a.pos - 1) SELECT feature_id, prompt_idx, count(*) AS n, round(sum(act * prev_act), 4) AS lag_product, coalesce(sum(nx), 0)::BIGINT AS next_sum, coalesce(sum(pv), 0)::BIGINT AS prev_sum FROM x GROUP BY ALL",
    "argmax_position": "x AS (SELECT feature_id, prompt_idx, arg_max(pos, {'a': act, 'p': -pos}) AS pos, max(act) AS act FROM fa GROUP BY ALL) SELECT * FROM x",
    "group_offsets": _GROUPS + "c AS (SELECT feature_id, group_ord, count(*) AS n FROM inside GROUP BY ALL), g AS (SELECT feature_id, group_ord, coalesce(n, 0) AS n FROM bounds LEFT JOIN c USING (feature_id, group_ord)) SELECT feature_id, group_ord, n, coalesce(sum(n) OVER (PARTITION BY feature_id ORDER BY group_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_row FROM g",
    "attribution": _attribution("list_dot_product(x, w) * p"),
    "attribution_gqa": _attribution("p * (list_dot_product(x[1:16], w[1:16]) + list_dot_product(x[1:16], w[17:32]) + list_dot_product(x[17:32], w[33:48]) + list_dot_product(x[17:32], w[49:64]))"),
    "prompt_scores_act": "x AS (SELECT *, row_number() OVER (PARTITION BY prompt_idx, pos ORDER BY act DESC, feature_id) AS rank FROM fa) SELECT 'act_size' AS metric, prompt_idx, pos, rank, feature_id, act AS score FROM x WHERE rank <= 3",
    "prompt_scores_quantile": _LABELS + "x AS (SELECT *, row_number() OVER (PARTITION BY prompt_idx, pos ORDER BY label DESC, feature_id) AS rank FROM fa JOIN lab USING (feature_id, act)) SELECT 'act_quantile' AS metric, prompt_idx, pos, rank, feature_id, label AS score FROM x WHERE rank <= 3",
    "prompt_scores_loss": _LOSS,
    "feature_batches": "x AS (SELECT feature_id, ntile(4) OVER (ORDER BY feature_id) - 1 AS balanced, (row_number() OVER (ORDER BY feature_id) - 1) // 5 AS fixed FROM encoder) SELECT feature_id, balanced, fixed FROM x",
    "skipped_features": "a AS (SELECT feature_id, count(*) / any_value(n) AS f FROM fa, total GROUP BY feature_id) SELECT feature_id FROM encoder WHERE feature_id NOT IN (SELECT feature_id FROM a WHERE f BETWEEN 0.165 AND 1)",
    "resume_batches": "x AS (SELECT DISTINCT ntile(8) OVER (ORDER BY feature_id) - 1 AS batch_id FROM encoder) SELECT batch_id FROM x WHERE batch_id BETWEEN 1 AND 6 AND batch_id NOT IN (2, 3)",
    "stats_union": "a AS (SELECT feature_id, max(act) AS m FROM fa GROUP BY feature_id) SELECT feature_id, CASE WHEN feature_id >= 6 THEN 1 ELSE 0 END AS batch, m AS max_act FROM a",
    "bulk_activations": _TOP + _sequences("SELECT feature_id, 0 AS group_ord, rank, prompt_idx, pos FROM top") + "v AS (SELECT * FROM vals JOIN named USING (feature_id, group_ord, rank) JOIN seqs USING (feature_id, group_ord, rank)) SELECT feature_id AS index, row_number() OVER w AS place, list_max(vals) AS \"maxValue\", (list_position(vals, list_max(vals)) - 1)::INT AS \"maxValueTokenIndex\", list_min(vals) AS \"minValue\", (pos - 1)::INT AS \"qualifyingTokenIndex\", 'c' || md5(feature_id || '|' || (row_number() OVER w - 1))[1:24] AS id, md5(tokens) AS tokens_md5 FROM v WINDOW w AS (PARTITION BY feature_id ORDER BY rank)",
    "bulk_features": _TOP + "s AS (SELECT feature_id, prompt_idx, rank FROM top), m AS (SELECT s.feature_id, max(round(act + 1e-9::DOUBLE, 4)) AS m FROM s JOIN fa ON fa.feature_id = s.feature_id AND fa.prompt_idx = s.prompt_idx AND fa.pos >= 1 GROUP BY 1) SELECT feature_id AS index, greatest(0, coalesce(m, 0)) AS \"maxActApprox\", false AS \"hasVector\", 'demo-model' AS \"modelId\", '3-demo-set' AS layer FROM (SELECT DISTINCT feature_id FROM top) LEFT JOIN m USING (feature_id)",
    "html_tokens": "h AS (SELECT token_id, token, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(token, 'Ġ', '&nbsp;'), '''', '&apos;'), '\"', '&quot;'), chr(92), chr(92)||chr(92)), chr(92), '&bsol;'), '<', '&lt;'), '>', '&gt;'), ')', '&#41;'), '(', '&#40;'), '[', '&#91;'), ']', '&#93;'), '{', '&#123;') AS h0 FROM vocab) SELECT token_id, replace(h0, '}', '&#125;') AS html FROM h",
    "token_colours": "a AS (SELECT feature_id, prompt_idx, max(act) AS m FROM fa GROUP BY ALL), b AS (SELECT feature_id, max(m) AS top FROM a GROUP BY feature_id), s AS (SELECT feature_id, prompt_idx, least(1, greatest(0, m / top)) AS s FROM a JOIN b USING (feature_id)) SELECT feature_id, prompt_idx, '#ff' || lower(printf('%02x', round(255 - 115 * s)::INT)) || lower(printf('%02x', round(255 - 255 * s)::INT)) AS colour FROM s",
    "group_titles": _GROUPS + "c AS (SELECT feature_id, group_ord, count(*) AS k FROM inside GROUP BY ALL), g AS (SELECT b.feature_id, b.group_ord, lower, upper, (coalesce(k, 0) + CASE WHEN lower <= 0 THEN n - active ELSE 0 END) / n AS pct FROM bounds b LEFT JOIN c USING (feature_id, group_ord), total) SELECT feature_id, group_ord, printf('INTERVAL %.3f - %.3f<br>CONTAINS %.3f%%', lower, upper, pct * 100) AS title, printf('%.3f', lower)::DOUBLE AS bin_min, printf('%.3f', upper)::DOUBLE AS bin_max, round(printf('%.3f', pct * 100)::DOUBLE / 100, 8) AS bin_contains FROM g",
    "conversation_prompts": "c AS (SELECT conv_id, string_agg('<' || role || '> ' || coalesce(text, ''), chr(10) ORDER BY turn) AS t, count(*) AS turns FROM conversations GROUP BY conv_id) SELECT conv_id, turns, md5(t) AS text_md5 FROM c",
    "label_density": "a AS (SELECT feature_id, prompt_idx // 67108864 AS doc_id, count(*) AS k FROM fa GROUP BY ALL), t AS (SELECT prompt_idx // 67108864 AS doc_id, count(*) AS n FROM token_pos GROUP BY 1), q AS (SELECT quality, sum(n) AS n FROM labels JOIN t USING (doc_id) GROUP BY quality) SELECT feature_id, quality, round(sum(k) / any_value(q.n), 6) AS density FROM a JOIN labels USING (doc_id) JOIN q USING (quality) GROUP BY feature_id, quality",
    "page_scripts": "s AS (SELECT page_id, regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS l FROM pages) SELECT page_id, len(l) AS n_scripts, md5(array_to_string(l, '|')) AS scripts_md5 FROM s",
    "neuron_histogram": "x AS (SELECT 'quantity' AS k, l_quantity AS v FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem), e AS (SELECT k, min(v) AS lo, max(v) AS hi FROM x GROUP BY k), h AS (SELECT k, CASE WHEN hi = lo THEN 5 ELSE least(floor((v - lo) / ((hi - lo) / 10)), 9) END::INT AS bin, count(*) AS c FROM x JOIN e USING (k) GROUP BY ALL) SELECT e.k AS neuron, r.i::INT AS bin, coalesce(c, 0) AS height, round(lo + (r.i + 0.5) * ((hi - lo) / 10) + 1e-9::DOUBLE, 5) AS bar_value FROM e CROSS JOIN range(10) r(i) LEFT JOIN h ON h.k = e.k AND h.bin = r.i",
}


def _sub(name: str, query: str) -> str:
    """Another query's SQL as a table."""
    return f"{name} AS (WITH {SQL[query]}),\n"


_SHOWN = lambda v: f"CASE WHEN {v} >= 0 THEN printf('rgba(%d,%d,255,0.5)', floor(255 * (1 - abs({v}) / size))::INT, floor(255 * (1 - abs({v}) / size))::INT) ELSE printf('rgba(255,%d,%d,0.5)', floor(255 * (1 - abs({v}) / size))::INT, floor(255 * (1 - abs({v}) / size))::INT) END"
_SIGNED = lambda v: f"printf('%+.3f', round({v} + 1e-9::DOUBLE * sign({v}), 3))"
_MARKS = reduce(lambda c, kv: f"replace({c}, '{kv[0]}', {chr(39) + kv[1] + chr(39) if kv[1].isprintable() else f'chr({ord(kv[1])})'})", ARTEFACTS.items(), "token")

SQL |= {
    "dashboard_tables": _sub("na", "neuron_alignment") + _sub("cn", "corr_neurons_topk") + _sub("cf", "corr_features_topk") + "u AS (SELECT feature_id AS feature_index, rank AS place, idx, value, l1_share AS other, 'neuron_alignment' AS kind FROM na UNION ALL SELECT feature_id, rank, idx, pearson, cossim, 'correlated_neurons' FROM cn UNION ALL SELECT x_id, rank, y_id, pearson, cossim, 'correlated_features' FROM cf) SELECT * FROM u",
    "dashboard_logits": _sub("t", "logit_lens_topk") + _sub("b", "logit_lens_bottomk") + "u AS (SELECT feature_id AS feature_index, rank AS place, token, round(logit + 1e-9::DOUBLE * sign(logit), 5) AS value, 'pos' AS side FROM t UNION ALL SELECT feature_id, rank, token, round(logit + 1e-9::DOUBLE * sign(logit), 5), 'neg' FROM b) SELECT * FROM u",
    "dashboard_histograms": _sub("ah", "acts_histogram") + _sub("lh", "logits_histogram") + "k AS (SELECT feature_id, count(*) AS k FROM fa GROUP BY feature_id), f AS (SELECT feature_id AS feature_index, round(round(coalesce(k, 0) / n * 100, 3) / 100, 8) AS frac_nonzero FROM encoder LEFT JOIN k USING (feature_id), total), u AS (SELECT feature_id AS feature_index, bin + 1::BIGINT AS place, height, bar_value AS value, 'freq' AS kind FROM ah UNION ALL SELECT feature_id, bin + 1::BIGINT, height, bar_value, 'logits' FROM lh) SELECT * FROM u JOIN f USING (feature_index)",
    "dashboard_decoder": _sub("d", "decoder_head_allocation") + "x AS (SELECT feature_id AS feature_index, head + 1::BIGINT AS place, share FROM d) SELECT * FROM x",
    "dashboard_activations": _ALL_GROUPS + _BINS + _ATTN + """parts AS (SELECT feature_id, prompt_idx, src, round(list_dot_product(x, w) * p, 3) + 0.0 AS v FROM attn_at),
lists AS (SELECT feature_id, prompt_idx, list(v ORDER BY src) AS l FROM parts GROUP BY ALL),
dfa AS (SELECT feature_id, prompt_idx, l[2:] AS own, list_position(l, list_max(l)) - 1 AS target FROM lists)
SELECT s.feature_id AS feature_index, row_number() OVER (PARTITION BY s.feature_id ORDER BY s.group_ord, s.rank) AS place, bin_min, bin_max, bin_contains, (pos - 1)::INT AS qualifying_token_index, n_tokens, md5(tokens) AS tokens_md5, list_max(vals) AS value_max, round(list_sum(vals), 4) + 0.0 AS value_sum,
  coalesce(len(own), 0) AS n_src, coalesce(list_max(own), 0.0) AS "dfa_maxValue", coalesce(target - 1, -1)::INT AS "dfa_targetIndex", coalesce(round(list_sum(own), 3), 0.0) + 0.0 AS dfa_sum
FROM seqs s JOIN vals USING (feature_id, group_ord, rank) JOIN named USING (feature_id, group_ord, rank) JOIN bins USING (feature_id, group_ord) LEFT JOIN dfa ON dfa.feature_id = s.feature_id AND dfa.prompt_idx = s.prompt_idx""",
    "sequence_package": _ALL_GROUPS + "l AS (SELECT feature_id, group_ord, rank, count(*) AS n_logits, sum(round(logit * 1000000)::BIGINT)::BIGINT AS logit_sum FROM places JOIN logits USING (feature_id, token_id) GROUP BY ALL) SELECT feature_id, group_ord, rank, prompt_idx AS original_index, pos AS qualifying_token_index, md5(array_to_string(ids, ',')) AS tokens_md5, list_max(vals) AS act_max, n_logits, logit_sum FROM seqs JOIN vals USING (feature_id, group_ord, rank) JOIN l USING (feature_id, group_ord, rank)",
    "dashboard_payloads": _sub("na", "neuron_alignment") + _sub("cf", "corr_features_topk") + _sub("t", "logit_lens_topk") + _sub("b", "logit_lens_bottomk") + f"sz AS (SELECT feature_id, max(round(abs(logit) + 1e-9::DOUBLE, 5)) AS size FROM (FROM t UNION ALL FROM b) GROUP BY feature_id) SELECT na.feature_id AS feature_index, {_SIGNED('value')} AS aligned, printf('%.1f%%', round(l1_share * 100 + 1e-9::DOUBLE, 1)) AS aligned_share, y_id AS near, {_SIGNED('pearson')} AS near_pearson, t.token AS pos_symbol, round(round(t.logit + 1e-9::DOUBLE * sign(t.logit), 5) + 1e-9::DOUBLE * sign(t.logit), 2) AS pos_value, {_SHOWN('round(t.logit + 1e-9::DOUBLE * sign(t.logit), 5)')} AS pos_color, {_SHOWN('round(b.logit + 1e-9::DOUBLE * sign(b.logit), 5)')} AS neg_color, 50::BIGINT AS n_colors, '#ff8c00' AS last_color FROM na JOIN cf ON x_id = na.feature_id AND cf.rank = 1 JOIN t ON t.feature_id = na.feature_id AND t.rank = 1 JOIN b ON b.feature_id = na.feature_id AND b.rank = 1 JOIN sz ON sz.feature_id = na.feature_id WHERE na.rank = 1",
    "dashboard_batches": _TOP + _sequences("SELECT feature_id, 0 AS group_ord, rank, prompt_idx, pos FROM top") + "x AS (SELECT * FROM seqs) SELECT (feature_id // 8)::INT AS batch_id, 'demo-model' AS model_id, count(DISTINCT feature_id) AS n_features, count(*) AS n_activations FROM x GROUP BY ALL",
    "bulk_export": _TOP + _sequences("SELECT feature_id, 0 AS group_ord, rank, prompt_idx, pos FROM top") + "u AS (SELECT 'features' AS part, 'renamed-model' AS \"modelId\", feature_id AS i FROM (SELECT DISTINCT feature_id FROM seqs) UNION ALL SELECT 'activations', 'demo-model', feature_id FROM seqs UNION ALL SELECT unnest(['release', 'model', 'sourceset', 'source']), NULL, 0) SELECT part, \"modelId\", count(*) AS n, sum(i)::BIGINT AS index_sum FROM u GROUP BY ALL",
    "result_json": _TOP + _sequences("SELECT feature_id, 0 AS group_ord, rank, prompt_idx, pos FROM top") + _sub("d", "feature_density") + "q AS (SELECT feature_id, count(*) AS n_sequences FROM seqs GROUP BY 1) SELECT feature_id, max_act, n_active, n_sequences FROM d LEFT JOIN q USING (feature_id)",
    "vector_set_json": "p AS (SELECT label, sqrt(sum(m * m)) AS s FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, i) GROUP BY label) SELECT (row_number() OVER (ORDER BY label) - 1)::INT AS feature_id, 'label ' || label AS name, round(s, 6) AS norm, 0.0::DOUBLE AS b_enc FROM p",
    "norm_stats_json": "e AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM emb), st AS (SELECT i, avg(v) AS m, stddev_samp(v) AS s FROM e GROUP BY i), y AS (SELECT vec_id, (v - m) / (s + 1e-6::DOUBLE) AS y FROM e JOIN st USING (i)) SELECT vec_id AS vec_no, round(sum(y), 5) + 0.0 AS total, round(sqrt(sum(y * y)), 5) AS norm FROM y GROUP BY vec_id",
    "buffered_top": "n AS (SELECT prompt_idx, count(*) AS n FROM token_pos GROUP BY 1), x AS (SELECT feature_id, prompt_idx, pos, act, row_number() OVER (PARTITION BY feature_id ORDER BY act DESC, prompt_idx, pos) AS rank FROM fa JOIN n USING (prompt_idx) WHERE pos >= 6 AND pos < n - 5) SELECT feature_id, rank, prompt_idx, pos, act FROM x WHERE rank <= 10",
    "masked_topk": "g AS (SELECT feature_id, prompt_idx, least(count(*), 3) AS k FROM fa GROUP BY ALL), e AS (SELECT feature_id, prompt_idx, unnest(range(1, k + 1)) AS rank FROM g), b AS (SELECT feature_id, prompt_idx, act, pos, row_number() OVER (PARTITION BY feature_id, prompt_idx ORDER BY act DESC, pos) AS rank FROM fa WHERE pos % 2 = 0) SELECT feature_id, prompt_idx, rank, coalesce(act, 0.0) AS act, coalesce(pos, 0) AS pos FROM e LEFT JOIN b USING (feature_id, prompt_idx, rank)",
    "window_argmax": _sub("c", "context_windows") + "v AS (SELECT feature_id, rank, list(act ORDER BY wpos) AS l FROM c GROUP BY ALL) SELECT feature_id, rank, list_position(l, list_max(l)) - 1::BIGINT AS bold, list_max(l) AS scale, 1.0::DOUBLE AS negative_scale FROM v",
    "suppressed_values": "d AS (SELECT feature_id, (generate_subscripts(w, 1) - 1)::INT AS i, unnest(w) AS v FROM decoder) SELECT feature_id, i, round(v, 4) AS v FROM d WHERE abs(v) > 0.3::DOUBLE",
    "gathered_shards": "x AS (SELECT feature_id, sqrt(list_sum(list_transform(w, lambda v: v * v))) AS s FROM encoder) SELECT feature_id, round(s, 6) AS norm FROM x",
    "layer_weights": "x AS (SELECT feature_id, sqrt(list_sum(list_transform(w, lambda v: (v * 11) * (v * 11)))) AS s FROM decoder) SELECT feature_id, 2::INT AS from_layer, 2::INT AS to_layer, round(s, 6) AS norm FROM x",
    "hook_names": "x AS (SELECT doc_id, source, CASE WHEN doc_id % 3 > 0 OR lang IS NOT NULL THEN (doc_id % 48)::INT END AS layer, CASE WHEN doc_id % 3 = 0 THEN 'hook_' || lang END AS hook FROM documents) SELECT doc_id, layer, hook, layer || '-' || source || CASE WHEN doc_id % 2 = 0 THEN '__long' ELSE '' END AS source_id FROM x",
    "html_round_trip": f"x AS (SELECT token_id, {_MARKS} AS token FROM vocab) SELECT * FROM x",
    "prompt_deltas": _CHANGES + """d AS (SELECT feature_id, vec_id, u, round(zo - zn, 9) AS d FROM z),
few AS (SELECT *, rank() OVER (PARTITION BY feature_id, vec_id ORDER BY d DESC) AS hi, rank() OVER (PARTITION BY feature_id, vec_id ORDER BY d) AS lo FROM d),
uv AS (SELECT * FROM (SELECT vec_id AS u, token_id, row_number() OVER (PARTITION BY vec_id ORDER BY token_id) AS k FROM vocv) WHERE k <= 5),
tokens AS (SELECT feature_id, vec_id, token_id, hi, lo, row_number() OVER (PARTITION BY feature_id, vec_id, hi <= 5 ORDER BY d DESC, token_id) AS top_at, row_number() OVER (PARTITION BY feature_id, vec_id, lo <= 5 ORDER BY d, token_id) AS low_at FROM few JOIN uv USING (u) WHERE hi <= 5 OR lo <= 5),
tl AS (SELECT feature_id, vec_id, t.top_at AS place, t.token_id AS top, l.token_id AS bottom FROM (FROM tokens WHERE hi <= 5 AND top_at <= 5) t JOIN (FROM tokens WHERE lo <= 5 AND low_at <= 5) l USING (feature_id, vec_id) WHERE l.low_at = t.top_at)
SELECT a.feature_id, prompt_idx, pos, place, top, bottom FROM a JOIN tl USING (feature_id, vec_id)""",
}


# Weights that are means of classes of all vectors.
_WEIGHTS = """embl AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vno, label, embedding::DOUBLE[] AS x FROM embeddings),
parts AS MATERIALIZED (SELECT vno, label, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v FROM embl),
cls AS MATERIALIZED (SELECT (label * 2 + vno % 2)::INT AS feature_id, i, avg(v) AS m FROM parts GROUP BY 1, 2),
middle AS (SELECT i, avg(v) AS c FROM parts GROUP BY i),
share AS (SELECT (label * 2 + vno % 2)::INT AS feature_id, round(-count(*) / (SELECT count(*) FROM embl), 6) AS b FROM embl GROUP BY 1),
tdec AS MATERIALIZED (SELECT feature_id, list(round(m, 12) ORDER BY i) AS w FROM cls GROUP BY feature_id),
tenc AS MATERIALIZED (SELECT feature_id, list(round(m - c, 12) ORDER BY i) AS w, any_value(b) AS b FROM cls JOIN middle USING (i) JOIN share USING (feature_id) GROUP BY feature_id),
"""


def _on_tables(name: str) -> str:
    """A query's SQL over the weights of _WEIGHTS."""
    return _WEIGHTS + re.sub(r"\b(encoder|decoder)\b(?=[ ),]|$)", lambda x: {"encoder": "tenc", "decoder": "tdec"}[x[1]], SQL[name])


SQL["dashboard_decoder"] = _WEIGHTS + SQL["dashboard_decoder"].replace("FROM decoder", "FROM tdec")
for _name in ("neuron_alignment", "decoder_head_allocation", "gathered_shards"):
    SQL[_name] = _on_tables(_name)
SQL["fold_decoder_norm"] = _WEIGHTS + SQL["fold_decoder_norm"].replace("FROM decoder", "FROM tdec").replace("FROM encoder", "FROM tenc")
SQL["suppressed_values"] = _on_tables("suppressed_values").replace("0.3::DOUBLE", "0.02::DOUBLE")
SQL["residual_direction"] = _WEIGHTS + "sm AS (SELECT a.i, b.i AS j, sum(a.v * b.v) / (SELECT count(*) FROM embl) AS o FROM parts a JOIN parts b USING (vno) GROUP BY 1, 2), d AS (SELECT feature_id, unnest(w) AS v, generate_subscripts(w, 1) - 1 AS i FROM tdec) SELECT feature_id, j::INT AS j, round(sum(v * o), 6) + 0.0 AS v FROM d JOIN sm USING (i) GROUP BY ALL"
SQL["feature_batches"] = "fs AS (SELECT DISTINCT label * 2 + (row_number() OVER (ORDER BY vec_id) - 1) % 2 AS f FROM embeddings), x AS (SELECT f::INT AS feature_id, ntile((SELECT ceil(count(*) / 4)::BIGINT FROM fs)) OVER (ORDER BY f) - 1 AS balanced, (row_number() OVER (ORDER BY f) - 1) // 5 AS fixed FROM fs) SELECT feature_id, balanced, fixed FROM x"
SQL["resume_batches"] = "fs AS (SELECT DISTINCT label * 2 + (row_number() OVER (ORDER BY vec_id) - 1) % 2 AS f FROM embeddings), x AS (SELECT f, ntile((SELECT ceil(count(*) / 2)::BIGINT FROM fs)) OVER (ORDER BY f) - 1 AS batch_id FROM fs) SELECT DISTINCT batch_id FROM x WHERE batch_id BETWEEN 1 AND 6 AND batch_id NOT IN (SELECT batch_id FROM x WHERE f // 2 IN (2, 3))"
SQL["layer_weights"] = _WEIGHTS + "y AS (SELECT label::INT AS feature_id, i, round(avg(v), 12) AS m FROM parts WHERE vno % 4 = 2 AND vno // 4 % 4 = 2 GROUP BY 1, 2) SELECT feature_id, 2::INT AS from_layer, 2::INT AS to_layer, round(sqrt(sum(m * m)), 6) AS norm FROM y GROUP BY feature_id"
SQL["corr_increments"] = SQL["corr_stream"] = SQL["corr_neurons_topk"]
SQL["encode_batchtopk_parts"] = SQL["encode_batchtopk"].replace("prompt_idx // (8 * 67108864::BIGINT)", "prompt_idx // (512 * 67108864::BIGINT)").replace("SELECT batch_id, 2 * count", "SELECT batch_id, 3 * count")
_EXPORTED = _TOP + _sequences("SELECT feature_id, 0 AS group_ord, rank, prompt_idx, pos FROM top")
SQL["export_resumed"] = _EXPORTED + "v AS (SELECT feature_id, rank, list_max(vals) AS m FROM vals), x AS (SELECT feature_id // 8 AS batch_id, feature_id, m FROM seqs JOIN v USING (feature_id, rank)) SELECT batch_id::BIGINT AS batch_id, count(DISTINCT feature_id) AS features, (SELECT sum(DISTINCT feature_id) FROM x y WHERE y.batch_id = x.batch_id)::BIGINT AS index_sum, count(*) AS activations, round(sum(m), 3) AS max_sum, count(DISTINCT feature_id) AS n_features, count(*) AS n_activations FROM x GROUP BY batch_id"
SQL["export_renamed"] = _EXPORTED + "u AS (SELECT 'features' AS part, 'new-model' AS model FROM (SELECT DISTINCT feature_id FROM seqs) UNION ALL SELECT 'activations', 'new-model' FROM seqs UNION ALL SELECT unnest(['model', 'sourceset', 'source']), 'new-model' UNION ALL SELECT 'release', 'demo') SELECT part, model, count(*) AS n FROM u GROUP BY ALL"


def _softmax(kv: list[int]) -> str:
    """Attribution by softmax attention; kv: the block of keys and values of each head of queries."""
    at = lambda c, b: f"{c}[{b * 16 + 1}:{b * 16 + 16}]"
    scores = ", ".join(f"8.0 * list_dot_product({at('a.x', h)}, {at('b.x', k)}) AS s{h}" for h, k in enumerate(kv))
    gives = ", ".join(f"list_dot_product({at('x', k)}, {at('w', h)}) AS g{h}" for h, k in enumerate(kv))
    exps, sums = ", ".join(f"exp(s{h}) AS e{h}" for h in range(4)), ", ".join(f"sum(e{h}) AS z{h}" for h in range(4))
    value = " + ".join(f"e{h} / z{h} * g{h}" for h in range(4))
    return f"""best AS (SELECT feature_id, prompt_idx, arg_max(pos, {{'a': act, 'p': -pos}}) AS dest FROM fa GROUP BY ALL),
sc AS MATERIALIZED (SELECT a.vec_id AS qv, b.vec_id AS kv, {scores} FROM emb a, emb b), gs AS MATERIALIZED (SELECT vec_id, feature_id, {gives} FROM emb, encoder),
kp AS MATERIALIZED (SELECT prompt_idx, pos AS src, vec_id, (token_id::BIGINT * 13 + pos * 5) % (SELECT nv FROM nvec) AS kv FROM posv),
es AS MATERIALIZED (SELECT t.prompt_idx, dest, src, kp.vec_id, {exps} FROM (SELECT DISTINCT prompt_idx, dest FROM best) t JOIN posv q ON q.prompt_idx = t.prompt_idx AND q.pos = dest JOIN kp ON kp.prompt_idx = t.prompt_idx AND src <= dest JOIN sc ON sc.qv = q.vec_id AND sc.kv = kp.kv),
zs AS (SELECT prompt_idx, dest, {sums} FROM es GROUP BY ALL),
parts AS (SELECT feature_id, prompt_idx, src, round({value}, 3) + 0.0 AS v FROM best JOIN es USING (prompt_idx, dest) JOIN zs USING (prompt_idx, dest) JOIN gs USING (vec_id, feature_id)),
lists AS (SELECT feature_id, prompt_idx, list(v ORDER BY src) AS l FROM parts GROUP BY ALL)
SELECT feature_id, prompt_idx, list_max(l) AS dfa_max_value, (list_position(l, list_max(l)) - 1)::INT AS dfa_target_index, len(l) AS n_src, round(list_sum(l), 3) + 0.0 AS dfa_sum FROM lists"""


SQL["attribution_softmax"], SQL["attribution_softmax_gqa"] = _softmax([0, 1, 2, 3]), _softmax([0, 0, 1, 1])


SQL["corr_global_topk"] = """a AS (SELECT feature_id, vec_id, act, v.n AS c FROM vec_acts JOIN vec_n v USING (vec_id) WHERE act > 0), s AS (SELECT feature_id, sum(act * c) AS s, sum(act * act * c) AS ss FROM a GROUP BY feature_id),
p AS (SELECT x.feature_id AS x_id, y.feature_id AS y_id, sum(x.act * y.act * x.c) AS sxy FROM a x JOIN a y ON x.vec_id = y.vec_id AND x.feature_id <> y.feature_id GROUP BY ALL),
g AS (SELECT sx.feature_id AS x_id, sy.feature_id AS y_id, CASE WHEN sx.feature_id = sy.feature_id THEN 0.0 ELSE round((n * coalesce(sxy, 0) - sx.s * sy.s) / (sqrt(greatest((n * sx.ss - sx.s * sx.s) * (n * sy.ss - sy.s * sy.s), 0.0)) + 1e-6), 5) END AS pearson, CASE WHEN sx.feature_id = sy.feature_id THEN 0.0 ELSE round(coalesce(sxy, 0) / (sqrt(sx.ss * sy.ss) + 1e-6), 5) END AS cossim FROM s sx CROSS JOIN s sy CROSS JOIN total LEFT JOIN p ON p.x_id = sx.feature_id AND p.y_id = sy.feature_id)
SELECT x_id, rank, y_id, pearson, cossim FROM (SELECT *, row_number() OVER (PARTITION BY x_id ORDER BY pearson DESC, y_id) AS rank FROM g) WHERE rank <= 3"""
_WARM = lambda v: f"'#ff' || lower(printf('%02x', round(255 - 115 * least(1, greatest(0, {v})))::INT)) || lower(printf('%02x', round(255 - 255 * least(1, greatest(0, {v})))::INT))"
# A bar's colour: (0.4 of the largest centre + 0.6 of its own) as a share of the largest.
SQL["histogram_payload"] = _sub("ah", "acts_histogram") + f"""k AS (SELECT feature_id, count(*) AS k FROM fa GROUP BY feature_id), t AS (SELECT feature_id, max(bar_value) AS m FROM ah GROUP BY feature_id)
SELECT ah.feature_id AS feature_index, 'ACTIVATIONS<br>DENSITY = ' || printf('%.3f%%', round(k * 100 / n, 3)) AS title, floor(m)::BIGINT + 1 AS n_ticks, bin + 1::BIGINT AS place, bar_value AS x, height AS y, {_WARM('(0.4::DOUBLE * m + 0.6::DOUBLE * bar_value) / greatest(m, 1e-6)')} AS color FROM ah JOIN k USING (feature_id) JOIN t USING (feature_id), total"""
SQL["sequence_payload"] = _ALL_GROUPS + f"""e AS (SELECT p.feature_id, p.group_ord, p.rank, p.i, p.token_id, round(coalesce(fa.act, 0) + 1e-9::DOUBLE, 4) AS v FROM places p LEFT JOIN fa ON fa.feature_id = p.feature_id AND fa.prompt_idx = p.prompt_idx AND fa.pos = p.i),
tops AS (SELECT feature_id, CASE WHEN max(v) > 0 THEN max(v) ELSE 1.0 END AS m FROM e GROUP BY feature_id)
SELECT e.feature_id, e.group_ord, e.rank, i AS place, token AS tok, e.token_id AS tok_id, i = s.pos AS bold, CASE WHEN v > 1e-8 THEN v END AS act, CASE WHEN v > 1e-8 THEN {_WARM('v / m')} END AS color, round(round(logit + 1e-9::DOUBLE * sign(logit), 4) + 0.0, 4) AS logit FROM e JOIN tops USING (feature_id) JOIN seqs s USING (feature_id, group_ord, rank) JOIN vocab ON vocab.token_id = e.token_id JOIN logits l ON l.feature_id = e.feature_id AND l.token_id = e.token_id"""


SQL["batch_files"] = SQL["dashboard_batches"]
SQL["array_shards"] = "x AS (SELECT vec_id AS vec_no, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS s, x[1] AS f FROM emb) SELECT vec_no, round(s, 6) AS norm, round(f, 6) AS first FROM x"


SQL["start_zeroing"] = _EXPORTED + "x AS (SELECT * FROM vals) SELECT feature_id, rank, len(vals) + 1 AS n_tokens, 0.0 AS start_value, round(list_sum(vals), 3) + 0.0 AS total FROM x"


def oracle_sql() -> dict[str, str]:
    return {name: PREFIX + body for name, body in SQL.items()}

"""DuckDB SQL for the queries, over the driver's tables."""

from __future__ import annotations

_CASES = """cases AS (
  SELECT o_orderkey AS case_id, 'reader_' || CAST(o_custkey % 12 AS VARCHAR) AS reader,
         CASE o_orderstatus WHEN 'F' THEN 'ct' WHEN 'O' THEN 'cxr' ELSE 'mri' END AS modality, o_orderpriority AS body_part, o_orderkey % 5 AS batch
  FROM orders)"""
_REPORTS = """routed AS (
  SELECT *, CASE WHEN l_returnflag = 'A' THEN 'artifact_reuse' WHEN l_returnflag = 'N' THEN 'fresh_cli' WHEN l_linestatus = 'F' THEN 'mock_fallback' ELSE 'cloud_fallback' END AS source
  FROM lineitem), reports AS (
  SELECT l_orderkey AS case_id, l_linenumber AS pos, l_suppkey AS k1, l_partkey AS k2, l_extendedprice AS k3, 'm' || CAST(l_suppkey % 8 AS VARCHAR) AS model, source,
         CASE WHEN l_partkey % 10 = 0 THEN 'unknown' WHEN l_tax <= 0.06e0 THEN 'passed' ELSE 'failed' END AS quality,
         (l_discount >= 0.08e0) AS w1, (l_discount <= 0.01e0) AS w2, (l_tax >= 0.07e0) AS w3,
         1e0 + 40 * l_discount AS likert_mean, l_tax / 0.08e0 AS structure_score, l_quantity / 50 AS finding_coverage,
         CASE source WHEN 'artifact_reuse' THEN 'artifact' WHEN 'mock_fallback' THEN 'mock' WHEN 'cloud_fallback' THEN 'debug_fallback' ELSE 'exploratory_fresh' END AS evidence_tier
  FROM routed), eligible AS (
  SELECT * FROM reports WHERE evidence_tier NOT IN ('debug_fallback', 'mock') AND source NOT IN ('local_vlm_fallback', 'mock', 'mock_judge', 'fallback', 'mock_fallback'))"""
_VALUES = """vals AS (
  SELECT r.*, m.metric, m.value FROM (SELECT e.*, c.reader, c.modality FROM eligible e JOIN cases c USING (case_id)) r,
  LATERAL (VALUES ('likert_mean', r.likert_mean), ('structure_score', r.structure_score), ('finding_coverage', r.finding_coverage)) m(metric, value))"""
_HAZARDS = """hazards AS (
  SELECT l_orderkey AS case_id, l_linenumber % 7 AS error_type, CAST(1 + l_partkey % 5 AS INTEGER) AS level, CAST(1 + l_suppkey % 5 AS INTEGER) AS review_level, (l_quantity % 11 = 0) AS abstain
  FROM lineitem)"""
_FINDINGS = """findings AS (
  SELECT l_orderkey AS case_id, CASE WHEN l_linenumber % 2 = 1 THEN 'cand' ELSE 'ref' END AS side, 'obs' || CAST(l_partkey % 6 AS VARCHAR) AS observation,
         CASE WHEN l_suppkey % 4 = 0 THEN 'unspecified' ELSE 'loc' || CAST(l_suppkey % 4 AS VARCHAR) END AS location,
         CASE l_linenumber % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'left' ELSE 'right' END AS laterality,
         CASE l_returnflag WHEN 'R' THEN 'uncertain' WHEN 'A' THEN 'present' ELSE 'absent' END AS certainty, l_quantity AS mm
  FROM lineitem)"""
_RUNS = """runs AS (
  SELECT event_id, ts, user_id AS run_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status
  FROM events)"""
_PAIRS = r"""pairs AS (
  SELECT r.conv_id, r.turn AS ref_turn, r.text AS gold, c.text AS cand
  FROM conversations r JOIN conversations c ON r.conv_id = c.conv_id AND c.turn = r.turn + 1 WHERE r.role = 'user' AND c.role = 'assistant')"""
_T = "CASE n " + " ".join(f"WHEN {n} THEN {t}e0" for n, t in ((2, 12.706), (3, 4.303), (4, 3.182), (5, 2.776), (6, 2.571), (7, 2.447), (8, 2.365), (9, 2.306), (10, 2.262))) + " ELSE 1.96e0 END"


def _r(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits}"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _describe(keys: str) -> str:
    return _with(_CASES, _REPORTS, _VALUES) + f""", d AS (
  SELECT {keys}, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0e0) AS std, min(value) AS mn, max(value) AS mx FROM vals GROUP BY {keys}
), h AS (SELECT *, CASE WHEN n > 1 THEN {_T} * std / sqrt(n) END AS half FROM d)
SELECT {keys}, n, {_r('mean')} AS mean, {_r('std')} AS std, {_r('mn')} AS min, {_r('mx')} AS max, {_r('mean - half')} AS ci_lower, {_r('mean + half')} AS ci_upper FROM h"""


_UNIT = "CASE WHEN metric = 'likert_mean' THEN CASE WHEN value >= 1 THEN (value - 1) / 4 ELSE value END ELSE value END"
_SCORED = _with(_CASES, _REPORTS) + f""", scored AS (
  SELECT *, {_r('(greatest(0e0, least(1e0, CASE WHEN likert_mean >= 1 THEN (likert_mean - 1) / 4 ELSE likert_mean END)) * 0.4e0 + structure_score * 0.3e0 + finding_coverage * 0.3e0) / (0.4e0 + 0.3e0 + 0.3e0)', 4)} AS score
  FROM eligible
), ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, pos, k1, k2, k3) AS rank, count(*) OVER (PARTITION BY case_id) AS n FROM scored)"""
_GAP = _with(_CASES, _REPORTS, _VALUES) + f""", m AS (SELECT reader, metric, avg(value) AS m FROM vals GROUP BY reader, metric),
p AS (SELECT *, (sum(m) OVER (PARTITION BY metric) - m) / nullif(count(*) OVER (PARTITION BY metric) - 1, 0) AS peer FROM m),
g AS (SELECT reader, metric, {_r('m')} AS mean, {_r('peer')} AS peer_mean, {_r('m - peer', 4)} AS gap FROM p)"""

#: erfc(x / sqrt 2) by the series of erf with positive terms; beyond 8 it is 0 to more digits than are compared.
_TAIL = "CASE WHEN x >= 8e0 THEN 0e0 ELSE 1e0 - exp(-x * x / 2) * list_sum(list_transform(range(0, 150), lambda n: pow(x / sqrt(2e0), 2 * n + 1) / gamma(n + 1.5e0))) END"
_WELCH = _with(_CASES, _REPORTS, _VALUES) + f""", g AS (SELECT metric, model, count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM vals GROUP BY metric, model),
  b AS (SELECT a.metric, a.model AS model_a, b.model AS model_b, a.n AS n_a, b.n AS n_b, a.n >= 2 AND b.n >= 2 AS enough, a.mean - b.mean AS diff, sqrt(a.var / a.n + b.var / b.n) AS error
    FROM g a JOIN g b ON a.metric = b.metric AND a.model < b.model),
  x AS (SELECT *, CASE WHEN error > 0 THEN abs(diff / error) END AS x FROM b),
  w AS (SELECT *, CASE WHEN NOT enough THEN 1e0 WHEN error = 0 THEN CASE WHEN diff <> 0 THEN 0e0 ELSE 1e0 END ELSE {_TAIL} END AS p FROM x) """


def _tokens(column: str) -> str:
    grams = "flatten(list_transform(range(3, least(6, length(r)) + 1), lambda n: list_transform(range(1, length(r) - n + 2), lambda i: substr(r, i, n))))"
    runs = f"list_filter(regexp_extract_all(lower({column}), '[a-z0-9_]+|[\u4e00-\u9fff]+'), lambda r: length(r) >= 3)"
    return f"list_distinct(flatten(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '^[a-z0-9_]') THEN [r] ELSE {grams} END)))"


SQL: dict[str, str] = {
    "model_source_summary": _with(_REPORTS) + """SELECT model, source, evidence_tier, count(*) AS report_count, count(*) FILTER (WHERE quality = 'passed') AS quality_passed, count(*) FILTER (WHERE quality = 'failed') AS quality_failed,
  count(*) FILTER (WHERE quality = 'unknown') AS quality_unknown, CAST(sum(w1::INT + w2::INT + w3::INT) AS BIGINT) AS warning_count FROM reports GROUP BY ALL""",
    "modality_body_part_summary": _with(_CASES, _REPORTS) + """SELECT modality, body_part, count(DISTINCT c.case_id) AS case_count, count(r.case_id) AS report_count, count(*) FILTER (WHERE quality = 'passed') AS quality_passed, count(*) FILTER (WHERE quality = 'failed') AS quality_failed
  FROM cases c LEFT JOIN reports r ON c.case_id = r.case_id GROUP BY modality, body_part""",
    "case_routes": _with(_CASES, _REPORTS) + """, f AS (
  SELECT case_id, 'm' AS k, model AS x, min(pos) AS p FROM reports GROUP BY case_id, model UNION ALL
  SELECT case_id, 's', source, min(pos) FROM reports GROUP BY case_id, source UNION ALL
  SELECT case_id, 't', evidence_tier, min(pos) FROM reports GROUP BY case_id, evidence_tier
), l AS (SELECT case_id, k, string_agg(x, ';' ORDER BY p, x) AS t FROM f GROUP BY case_id, k), n AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE quality = 'passed') AS qp, count(*) FILTER (WHERE quality = 'failed') AS qf, count(*) FILTER (WHERE quality = 'unknown') AS qu FROM reports GROUP BY case_id)
SELECT c.case_id, reader, coalesce(n, 0) AS report_count, coalesce(qp, 0) AS quality_passed, coalesce(qf, 0) AS quality_failed, coalesce(qu, 0) AS quality_unknown, coalesce(m.t, '') AS models, coalesce(s.t, '') AS sources, coalesce(e.t, '') AS evidence_tiers
FROM cases c LEFT JOIN n ON c.case_id = n.case_id LEFT JOIN l m ON c.case_id = m.case_id AND m.k = 'm' LEFT JOIN l s ON c.case_id = s.case_id AND s.k = 's' LEFT JOIN l e ON c.case_id = e.case_id AND e.k = 't'""",
    "global_counters": _with(_REPORTS) + """SELECT 'model' AS kind, model AS value, count(*) AS n FROM reports GROUP BY model UNION ALL SELECT 'source', source, count(*) FROM reports GROUP BY source
  UNION ALL SELECT 'evidence_tier', evidence_tier, count(*) FROM reports GROUP BY evidence_tier""",
    "warning_histogram": _with(_REPORTS) + """, w AS (SELECT model, 'low_contrast' AS w FROM reports WHERE w1 UNION ALL SELECT model, 'short_report' FROM reports WHERE w2 UNION ALL SELECT model, 'late_review' FROM reports WHERE w3),
  c AS (SELECT model, w, count(*) AS n FROM w GROUP BY model, w) SELECT model, string_agg(w || ':' || CAST(n AS VARCHAR), ';' ORDER BY w) AS warnings FROM c GROUP BY model""",
    "quality_gate_failures": _with(_CASES, _REPORTS) + """SELECT case_id, reader, modality, body_part, model, source, evidence_tier,
  concat_ws(';', CASE WHEN w1 THEN 'low_contrast' END, CASE WHEN w2 THEN 'short_report' END, CASE WHEN w3 THEN 'late_review' END) AS warnings FROM reports JOIN cases USING (case_id) WHERE quality = 'failed'""",
    "metric_statistics_ci": _describe("metric"),
    "reader_metric_statistics": _describe("reader, metric"),
    "reader_overall_score": _with(_CASES, _REPORTS, _VALUES) + f"SELECT reader, {_r(f'avg({_UNIT})')} AS overall_score, count(*) AS n_values FROM vals GROUP BY reader",
    "reader_percentiles": _with(_CASES, _REPORTS, _VALUES) + f""", s AS (SELECT reader, {_r(f'avg({_UNIT})')} AS v FROM vals GROUP BY reader)
  SELECT reader, v AS overall_score, {_r('100e0 * ((SELECT count(*) FROM s b WHERE b.v < a.v) + 0.5e0 * (SELECT count(*) FROM s b WHERE b.v = a.v)) / (SELECT count(*) FROM s)')} AS percentile FROM s a""",
    "modelwise_weighted": _with(_CASES, _REPORTS, _VALUES) + f""", w AS (SELECT *, CASE WHEN model = 'm5' THEN 1e0 ELSE 0.5e0 * CAST(substr(model, 2) AS INTEGER) END AS w FROM vals)
  SELECT modality, metric, {_r('sum(value * w) / sum(w)')} AS weighted_mean FROM w GROUP BY modality, metric HAVING sum(w) <> 0""",
    "hazardwise_weighted": _with(_REPORTS) + f""", e AS (SELECT *, CAST(1 + k2 % 5 AS INTEGER) AS level, CASE WHEN k1 % 2 = 0 THEN 'omission_finding' ELSE 'false_finding' END AS error_type FROM reports
    WHERE evidence_tier NOT IN ('mock', 'debug_fallback') AND source NOT IN ('mock', 'mock_fallback', 'fallback', 'local_vlm_fallback')),
  w(error_type, level, w) AS (VALUES ('omission_finding', 4, 2e0), ('omission_finding', 5, 3e0), ('false_finding', 5, 1.5e0), ('false_finding', 1, 0.5e0))
  SELECT error_type, level, count(*) AS n, {_r('avg(finding_coverage * coalesce(w, 1e0))')} AS weighted FROM e LEFT JOIN w USING (error_type, level) GROUP BY error_type, level""",
    "department_denominators": _with(_CASES, _REPORTS) + f""", s AS (SELECT modality, count(*) AS source_count, count(*) FILTER (WHERE case_id IN (SELECT case_id FROM eligible)) AS success_count FROM cases GROUP BY modality)
  SELECT modality, source_count, success_count, source_count - success_count AS failure_count, {_r('success_count / greatest(source_count, 1)', 4)} AS success_rate FROM s""",
    "peer_gap": _GAP + " SELECT * FROM g",
    "weak_metrics": _GAP + """, k AS (SELECT *, rank() OVER (PARTITION BY reader ORDER BY mean) AS r FROM g) SELECT reader, metric, mean, gap < -1.0 AS below_peers FROM k WHERE r = 1 OR gap < -1.0""",
    "top_k_reports": _SCORED + """, c AS (SELECT *, max(CASE WHEN rank = 3 THEN score END) OVER (PARTITION BY case_id) AS cutoff FROM ranked),
  x AS (SELECT *, rank <= 3 AS selected, coalesce(n > 3 AND round((cutoff - score) * 10000) <= 100, false) AS near FROM c)
  SELECT case_id, pos, k1, k2, k3, model, score, rank, selected, near AND NOT selected AS near_cutoff_review FROM x WHERE selected OR near""",
    "top_k_ci_overlap": _SCORED + f""", d AS (SELECT model, count(*) AS n, avg(score) AS mean, coalesce(stddev_samp(score), 0e0) AS std FROM ranked GROUP BY model),
  h AS (SELECT model, {_r(f'mean + {_T} * std / sqrt(n)')} - {_r(f'mean - {_T} * std / sqrt(n)')} AS w FROM d),
  i AS (SELECT r.*, score - w / 2 AS low, score + w / 2 AS high FROM ranked r JOIN h USING (model)),
  c AS (SELECT *, max(CASE WHEN rank = 3 THEN low END) OVER (PARTITION BY case_id) AS cl, max(CASE WHEN rank = 3 THEN high END) OVER (PARTITION BY case_id) AS ch FROM i),
  x AS (SELECT *, coalesce(low <= ch AND cl <= high, false) AS uncertainty_overlap FROM c)
  SELECT case_id, pos, k1, k2, k3, model, score, rank, uncertainty_overlap FROM x WHERE rank <= 3 OR uncertainty_overlap""",
    "hazard_agreement": _with(_HAZARDS) + f""", c AS (SELECT error_type, count(*) AS compared, count(*) FILTER (WHERE level = review_level) AS exact, count(*) FILTER (WHERE abs(level - review_level) <= 1) AS within_one,
    count(*) FILTER (WHERE level % 3 = review_level % 3) AS action FROM hazards GROUP BY error_type)
  SELECT *, {_r('exact / compared', 4)} AS exact_rate, {_r('within_one / compared', 4)} AS within_one_rate, {_r('action / compared', 4)} AS action_rate FROM c""",
    "hazard_consensus": _with(_HAZARDS) + """, c AS (SELECT case_id, CASE WHEN level = review_level THEN level WHEN NOT abstain THEN review_level END AS consensus FROM hazards)
  SELECT case_id, coalesce(max(consensus), 0) AS max_level, count(*) FILTER (WHERE consensus >= 3) AS material, count(*) FILTER (WHERE consensus >= 2) AS nontrivial, count(*) FILTER (WHERE consensus IS NULL) AS unresolved FROM c GROUP BY case_id""",
    "hazard_histograms": _with(_HAZARDS) + "SELECT error_type, level, count(*) AS n FROM hazards GROUP BY error_type, level",
    "cohen_kappa_labels": f"""WITH p AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) / count(*) AS o FROM p),
  x AS (SELECT sum(na * nb) AS c FROM (SELECT a AS x, count(*) AS na FROM p GROUP BY a) JOIN (SELECT b AS x, count(*) AS nb FROM p GROUP BY b) USING (x)),
  g AS (SELECT count(DISTINCT v) AS categories FROM (SELECT a AS v FROM p UNION ALL SELECT b FROM p)), k AS (SELECT n, o, coalesce(c, 0) / (n * n) AS e, categories FROM t, x, g) SELECT n, {_r('o')} AS observed, {_r('e')} AS expected, {_r('CASE WHEN e = 1 THEN CASE WHEN o = 1 THEN 1e0 END ELSE (o - e) / (1 - e) END')} AS kappa, categories, CASE WHEN e = 1 AND o <> 1 THEN 'undefined' ELSE 'complete' END AS status FROM k""",
    "weighted_kappa_levels": _with(_HAZARDS) + f""", t AS (SELECT count(*) AS n, avg(1 - ((level - review_level) / 4e0) * ((level - review_level) / 4e0)) AS o FROM hazards),
  x AS (SELECT sum((1 - ((a - b) / 4e0) * ((a - b) / 4e0)) * na * nb) AS c FROM (SELECT level AS a, count(*) AS na FROM hazards GROUP BY a), (SELECT review_level AS b, count(*) AS nb FROM hazards GROUP BY b)),
  k AS (SELECT n, o, c / (n * n) AS e FROM t, x) SELECT n, {_r('o')} AS observed, {_r('e')} AS expected, {_r('(o - e) / (1 - e)')} AS kappa FROM k""",
    "agreement_sets": _with(_FINDINGS) + """, o AS (SELECT case_id, observation, bool_or(side = 'cand') AS c, bool_or(side = 'ref') AS r FROM findings GROUP BY case_id, observation),
  l AS (SELECT case_id, coalesce(string_agg(observation, ';' ORDER BY observation) FILTER (c AND NOT r), '') AS only_one, coalesce(string_agg(observation, ';' ORDER BY observation) FILTER (r AND NOT c), '') AS only_two FROM o GROUP BY case_id)
  SELECT *, only_one = '' AND only_two = '' AS exact FROM l""",
    "alignment_pair_scores": _with(_FINDINGS) + """, p AS (SELECT c.case_id, 100
    + CASE WHEN 'unspecified' IN (c.location, r.location) THEN 4 WHEN c.location = r.location THEN 20 ELSE 0 END
    + CASE WHEN 'unknown' IN (c.laterality, r.laterality) THEN 2 WHEN c.laterality = r.laterality THEN 15 ELSE -10 END
    + CASE WHEN c.certainty = r.certainty THEN 20 WHEN 'uncertain' IN (c.certainty, r.certainty) THEN 3 ELSE -20 END + 1
    + CASE WHEN abs(c.mm - r.mm) <= 5 THEN 10 ELSE -5 END AS points
  FROM findings c JOIN findings r ON c.case_id = r.case_id AND c.observation = r.observation AND c.side = 'cand' AND r.side = 'ref')
  SELECT case_id, count(*) AS pairs, CAST(max(points) AS BIGINT) AS best, CAST(sum(points) AS BIGINT) AS total FROM p GROUP BY case_id""",
    "merge_batches_coverage": _with(_CASES) + """, d AS (SELECT case_id FROM cases WHERE batch <> 3 UNION SELECT -case_id - 1 FROM cases WHERE case_id % 50 = 0)
  SELECT case_id, 'missing' AS problem FROM cases WHERE case_id NOT IN (SELECT case_id FROM d) UNION ALL SELECT case_id, 'extra' FROM d WHERE case_id NOT IN (SELECT case_id FROM cases)""",
    "merged_batches": _with(_CASES) + """, m AS (SELECT case_id, batch, batch AS batch_no FROM cases UNION ALL SELECT case_id, batch, 5 FROM cases WHERE case_id % 40 = 0), c AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS k FROM m)
  SELECT batch, batch_no, count(*) AS rows, count(*) FILTER (WHERE k > 1) AS duplicated FROM c GROUP BY batch, batch_no""",
    "manifest_summary": _with(_CASES) + """, f AS (SELECT modality, body_part, (reader = 'reader_0')::INT AS r, (batch = 0)::INT AS b FROM cases), k AS (SELECT 'modality' AS kind, modality AS value, r, b FROM f UNION ALL SELECT 'body_part', body_part, r, b FROM f UNION ALL SELECT 'all', 'all', r, b FROM f)
  SELECT kind, value, count(*) AS n, CAST(sum(r) AS BIGINT) AS reader_0, CAST(sum(b) AS BIGINT) AS first_batch FROM k GROUP BY kind, value""",
    "count_max_merge": _with(_CASES, _REPORTS) + """, u AS (SELECT modality AS key, count(*) AS n FROM cases GROUP BY modality UNION ALL SELECT modality, count(*) FROM reports JOIN cases USING (case_id) WHERE quality = 'failed' GROUP BY modality)
  SELECT key, max(n) AS n FROM u GROUP BY key""",
    "benchmark_summary": f"""WITH s AS (SELECT source, nullif(trim(text), '') AS t, n_chars FROM documents), a AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE t IS NULL) AS empty, count(DISTINCT t) AS unique_reports, min(n_chars) AS shortest, max(n_chars) AS longest, {_r('avg(n_chars)', 4)} AS mean_chars FROM s GROUP BY source)
  SELECT *, {_r('unique_reports / greatest(n, 1)')} AS unique_rate FROM a""",
    "truncation_rollup": r"""SELECT CASE WHEN grouping(lang) = 1 THEN 'total' ELSE lang END AS lang, count(*) AS n, count(*) FILTER (WHERE NOT regexp_matches(text, '[.!?]\z')) AS flagged FROM documents GROUP BY ROLLUP(lang)""",
    "plan_coverage_by_stratum": _with(_CASES) + f""", m AS (SELECT * FROM (VALUES ('g0', 'ct'), ('g1', 'mri'), ('g2', 'unknown'), ('g3', 'ct'), ('g4', 'pet'), ('g5', 'mri')) v(g, supported)),
  p AS (SELECT case_id, modality, body_part, count(g) AS routes FROM cases LEFT JOIN m ON supported = modality OR (supported = 'unknown' AND body_part = '1-URGENT') GROUP BY ALL),
  s AS (SELECT modality, body_part, count(*) AS cases, count(*) FILTER (WHERE routes > 0) AS covered, CAST(sum(routes) AS BIGINT) AS routes FROM p GROUP BY modality, body_part) SELECT *, {_r('covered / greatest(cases, 1)')} AS coverage FROM s""",
    "stratified_sample": _with(_CASES) + """, t AS (SELECT case_id, modality, body_part, row_number() OVER (PARTITION BY modality, body_part ORDER BY case_id) AS turn FROM cases) SELECT * FROM t ORDER BY turn, modality, body_part LIMIT 100""",
    "coverage_cartesian": _with(_CASES, _REPORTS) + """, w AS (SELECT case_id, candidate, repeat FROM cases, (SELECT 'm' || CAST(i AS VARCHAR) AS candidate FROM range(7) t(i)), (VALUES (1), (2)) r(repeat)),
  g AS (SELECT case_id, model AS candidate, 1 + pos % 2 AS repeat, count(*) AS k FROM reports GROUP BY ALL),
  p AS (SELECT candidate, repeat, CASE WHEN w.one IS NULL THEN 'extra' WHEN g.k IS NULL THEN 'missing' WHEN g.k > 1 THEN 'duplicate' END AS problem
    FROM (SELECT *, 1 AS one FROM w) w FULL JOIN g USING (case_id, candidate, repeat))
  SELECT candidate, repeat, problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY ALL""",
    "ambiguous_hash_join": "SELECT min(doc_id) AS doc_id, sha256(text) AS text_sha256 FROM documents GROUP BY text_sha256 HAVING min(doc_id) = max(doc_id)",
    "unique_finding_ids": """WITH i AS (SELECT conv_id, turn, role, role || '_' || CAST(conv_id % 20 AS VARCHAR) AS id FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY conv_id, turn, role) AS n FROM i)
  SELECT conv_id, turn, CASE WHEN n = 1 THEN id ELSE id || '-' || CAST(n AS VARCHAR) END AS unique_id FROM n""",
    "modality_normalize": """SELECT CASE p_partkey % 8 WHEN 0 THEN 'cxr' WHEN 1 THEN 'ct' WHEN 2 THEN 'mri' WHEN 3 THEN 'usabdomen' WHEN 4 THEN 'unknown' WHEN 5 THEN 'ct' WHEN 6 THEN 'cxr' ELSE 'primary' END AS modality, count(*) AS n FROM part GROUP BY modality""",
    "structure_scores": r"""SELECT conv_id, turn, CAST(CASE WHEN turn % 2 = 1 THEN CASE WHEN trim(text) = '' THEN 35 ELSE 90 END WHEN trim(text) = '' THEN 0 ELSE 55 END AS BIGINT) AS structure_score,
  CAST(CASE WHEN turn % 2 = 1 THEN 4 ELSE 0 END AS BIGINT) AS impression_chars,
  CAST(CASE WHEN turn % 2 = 1 THEN 3 + CAST(len(regexp_extract_all(text, '\S+')) + 3 >= 20 AS INTEGER) + 1 ELSE 3 + CAST(len(regexp_extract_all(text, '\S+')) >= 20 AS INTEGER) END AS BIGINT) AS likert FROM conversations""",
    "text_bounded": r"""WITH b AS (SELECT doc_id, CASE WHEN length(text) <= 12000 THEN text ELSE left(text, 5996) || chr(10) || '[...]' || chr(10) || right(text, 5996) END AS b FROM documents) SELECT doc_id, length(b) AS chars, md5(b) AS digest FROM b""",
    "illegal_transitions": _with(_RUNS) + """, s AS (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS b FROM runs)
  SELECT coalesce(b, 'none') AS before, status, count(*) AS n, count(*) FILTER (WHERE NOT CASE WHEN b IS NULL THEN status = 'queued' WHEN b = 'queued' THEN status IN ('running', 'cancelled') WHEN b = 'running' THEN status IN ('succeeded', 'failed', 'cancelled')
    WHEN b IN ('failed', 'cancelled') THEN status = 'queued' ELSE false END) AS illegal FROM s GROUP BY before, status""",
    "latest_registry_entry": _with(_RUNS) + "SELECT run_id, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS r FROM runs) WHERE r = 1",
    "progress_tumbling": _with(_RUNS) + "SELECT date_trunc('hour', ts) AS window_start, status, count(*) AS n FROM runs GROUP BY ALL",
    "validate_run_violations": _with(_HAZARDS) + """, v AS (SELECT case_id, 'level_in_range' AS rule FROM hazards WHERE NOT level BETWEEN 1 AND 5 UNION ALL SELECT case_id, 'review_within_two' FROM hazards WHERE abs(level - review_level) > 2 UNION ALL SELECT case_id, 'not_abstained' FROM hazards WHERE abstain)
  SELECT case_id, rule, count(*) AS n FROM v GROUP BY case_id, rule""",
    "gate_matrix": _with(_CASES, _REPORTS) + """, g AS (SELECT reader, model, CAST(bool_and(likert_mean >= 1) AS INTEGER) + CAST(bool_and(evidence_tier <> 'mock') AS INTEGER) + CAST(bool_and(finding_coverage > 0.02e0) AS INTEGER) AS passed FROM reports JOIN cases USING (case_id) GROUP BY reader, model)
  SELECT reader, model, passed, 3 - passed AS failed, 3 AS total, CASE WHEN passed = 3 THEN 'validated' ELSE 'pilot' END AS status FROM g""",
    "route_plan": _with(_REPORTS) + """SELECT model, count(*) AS routes, count(*) FILTER (WHERE source = 'artifact_reuse') AS artifact, count(*) FILTER (WHERE source = 'cloud_fallback') AS fallback, count(*) FILTER (WHERE source = 'mock_fallback') AS mock,
  count(*) FILTER (WHERE source = 'fresh_cli') AS fresh, count(DISTINCT case_id) AS cases FROM reports GROUP BY model""",
    "reader_aggregates": _with(_CASES, _REPORTS) + f""", c AS (SELECT reader, count(*) AS case_count, md5(string_agg(CAST(case_id AS VARCHAR), ',' ORDER BY case_id)) AS cases_digest FROM cases GROUP BY reader),
  m AS (SELECT reader, model, count(*) AS n, {_r('sum(finding_coverage) / count(*)')} AS mean FROM reports JOIN cases USING (case_id) GROUP BY reader, model),
  a AS (SELECT reader, CAST(sum(n) AS BIGINT) AS report_count, string_agg(model || ':' || CAST(n AS VARCHAR), ';' ORDER BY model) AS models, max(mean) AS best_mean FROM m GROUP BY reader) SELECT * FROM c LEFT JOIN a USING (reader)""",
    "ordinal_weighted": _with(_CASES, _REPORTS, _VALUES) + f""", o AS (SELECT model, row_number() OVER (ORDER BY model) AS k FROM (SELECT DISTINCT model FROM vals)), w AS (SELECT v.*, CASE k WHEN 1 THEN 3e0 WHEN 2 THEN 2e0 WHEN 3 THEN 0e0 WHEN 4 THEN 0.5e0 ELSE 1e0 END AS w FROM vals v JOIN o USING (model))
  SELECT modality, metric, {_r('sum(value * w) / sum(w)')} AS weighted_mean FROM w GROUP BY modality, metric HAVING sum(w) <> 0""",
    "hazard_alignment_problems": _with(_HAZARDS) + """, g AS (SELECT case_id, error_type, min(level) AS l, max(review_level) AS r FROM hazards GROUP BY case_id, error_type),
  x AS (SELECT CASE WHEN l > 1 AND r >= 5 THEN 'missing_review' WHEN l <= 1 AND r < 5 THEN 'extra_review' WHEN l > 1 AND r < 5 AND (l > 3) <> (r > 3) THEN 'type_mismatch' END AS problem FROM g) SELECT problem, count(*) AS n FROM x WHERE problem IS NOT NULL GROUP BY problem""",
    "side_relations": _with(_FINDINGS) + """, o AS (SELECT case_id, observation, bool_or(side = 'cand') AS c, bool_or(side = 'ref') AS r FROM findings GROUP BY ALL), k AS (SELECT case_id, bool_and(c AND r) AS e, bool_and(NOT c OR r) AS sub, bool_and(NOT r OR c) AS sup, bool_or(c AND r) AS ov FROM o GROUP BY case_id)
  SELECT CASE WHEN e THEN 'equal' WHEN sub THEN 'subset' WHEN sup THEN 'superset' WHEN ov THEN 'overlap' ELSE 'disjoint' END AS relation, count(*) AS n FROM k GROUP BY relation""",
    "latest_outputs": _with(_RUNS) + "SELECT run_id, 'o' || CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) AS output FROM runs WHERE status = 'succeeded' GROUP BY run_id",
    "missing_sections": "SELECT CASE turn % 3 WHEN 0 THEN 'missing_impression;missing_clinical_history' WHEN 1 THEN 'missing_findings;missing_clinical_history' ELSE 'missing_findings;missing_impression;missing_clinical_history' END AS missing, count(*) AS n FROM conversations GROUP BY missing",
    "recognised_modalities": """WITH s AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'header' WHEN p_partkey % 3 = 0 THEN 'filename' WHEN p_size % 2 = 0 THEN 'judge' ELSE 'none' END AS source FROM part)
  SELECT CASE source WHEN 'header' THEN 'ct' WHEN 'filename' THEN 'cxr' WHEN 'judge' THEN 'mri' ELSE 'unknown' END AS modality, source, count(*) AS n FROM s GROUP BY source""",
    "token_overlap": _with(_PAIRS) + f""", t AS (SELECT conv_id, ref_turn, {_tokens('gold')} AS a, {_tokens('cand')} AS b FROM pairs)
  SELECT conv_id, ref_turn, len(a) AS ref_tokens, len(list_intersect(a, b)) AS shared FROM t""",
    # All pairs of one observation have points above 0, so the best assignment pairs as many as the smaller side has.
    "alignment_only": _with(_FINDINGS) + """, o AS (SELECT case_id, observation, count(*) FILTER (WHERE side = 'cand') AS c, count(*) FILTER (WHERE side = 'ref') AS r FROM findings GROUP BY case_id, observation),
  e AS (SELECT case_id, 'false_finding' AS error, greatest(c - r, 0) AS n FROM o UNION ALL SELECT case_id, 'omission_finding', greatest(r - c, 0) FROM o)
  SELECT case_id, error, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY case_id, error HAVING sum(n) > 0""",
    "alignment_assignment": _with(_FINDINGS) + f""", o AS (SELECT case_id, observation, count(*) FILTER (WHERE side = 'cand') AS c, count(*) FILTER (WHERE side = 'ref') AS r FROM findings GROUP BY case_id, observation),
  m AS (SELECT case_id, CAST(sum(c) AS BIGINT) AS n_cand, CAST(sum(r) AS BIGINT) AS n_ref, CAST(sum(least(c, r)) AS BIGINT) AS matched FROM o GROUP BY case_id),
  x AS (SELECT *, matched / greatest(n_cand, 1) AS p, matched / greatest(n_ref, 1) AS q FROM m)
  SELECT case_id, n_cand, n_ref, matched, {_r('p', 4)} AS precision, {_r('q', 4)} AS recall, {_r('CASE WHEN p + q = 0 THEN 0e0 ELSE 2 * p * q / (p + q) END', 4)} AS f1 FROM x""",
    "model_pair_welch": _WELCH + f"SELECT metric, model_a, model_b, n_a, n_b, CASE WHEN enough AND error > 0 THEN {_r('diff / error', 4)} END AS t, {_r('p')} AS p, CASE WHEN enough THEN 'welch_normal_approximation' ELSE 'insufficient_data' END AS method FROM w",
    "holm_adjusted": _WELCH + f""", s AS (SELECT *, least(1e0, (count(*) OVER (PARTITION BY metric) - row_number() OVER (PARTITION BY metric ORDER BY p, model_a, model_b) + 1) * p) AS a FROM w)
  SELECT metric, model_a, model_b, {_r('p')} AS p, {_r('max(a) OVER (PARTITION BY metric ORDER BY p, model_a, model_b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS p_holm FROM s""",
}

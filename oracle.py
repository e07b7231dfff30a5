"""SQL (DuckDB dialect) for the queries of ``__spark_entry__``."""

from __future__ import annotations

BRANDS = [f"Brand#{i}" for i in range(1, 26)]
YEARS = (1996, 1998)
SAMPLES = 1000
KEYS = "model, scenario, region, temp_bucket"
RULE_FEATURES = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice", "l_extendedprice"]
IN_YEARS = "year IN (1996, 1998)"

BUCKET = """CASE {c} WHEN 'C1' THEN '1.5' WHEN 'C2' THEN '1.5' WHEN 'C3' THEN '2' WHEN 'C4' THEN '2'
  WHEN 'C5' THEN 'above 2' WHEN 'C6' THEN 'above 2' WHEN 'C7' THEN 'above 2' WHEN 'C8' THEN 'above 2'
  WHEN 'failed-vetting' THEN 'failed-vetting' WHEN 'no-climate-assessment' THEN 'no-climate-assessment' END"""

SCENARIOS = f"""scenarios AS (
  SELECT n_name AS model, s_name AS scenario, r_name AS region, s_suppkey,
         CASE s_suppkey % 10 WHEN 9 THEN 'failed-vetting' WHEN 0 THEN 'no-climate-assessment'
              ELSE 'C' || CAST(s_suppkey % 10 AS VARCHAR) END AS category
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
labelled AS (SELECT *, {BUCKET.format(c='category')} AS temp_bucket FROM scenarios)"""


def _base(sparse: bool = False) -> str:
    value = "CASE WHEN l_returnflag = 'R' THEN l_extendedprice END" if sparse else "l_extendedprice"
    return f"""{SCENARIOS},
long AS (
  SELECT model, scenario, region, temp_bucket, category, p_brand AS variable,
         CAST(year(l_shipdate) AS INTEGER) AS year, {value} AS value,
         row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS input_order
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN labelled ON l_suppkey = s_suppkey),
cells AS (
  SELECT {KEYS}, variable, year, arg_min(value, input_order) AS value
  FROM long WHERE value IS NOT NULL GROUP BY {KEYS}, variable, year)"""


DENSE, SPARSE = "WITH " + _base(), "WITH " + _base(True)


def _wide(years=YEARS) -> str:
    return ", ".join(
        f"max(CASE WHEN variable = '{v}' AND year = {y} THEN value END) AS \"{v} ({y})\"" for v in BRANDS for y in years
    )


SECTORS = """sectors AS (
  SELECT DISTINCT p_brand AS variable,
         'S' || CAST((CAST(split_part(p_brand, '#', 2) AS INTEGER) - 1) // 5 AS VARCHAR) AS sector,
         CAST(split_part(p_brand, '#', 2) AS INTEGER) AS ordinal FROM part)"""

DRAWS = f"""{SECTORS},
draws AS (
  SELECT sample_id, sector, variable,
         row_number() OVER (PARTITION BY sample_id, sector ORDER BY md5('42|' || CAST(sample_id AS VARCHAR) || '|' || variable)) AS place
  FROM (SELECT range AS sample_id FROM range({SAMPLES})) CROSS JOIN sectors),
members AS (
  SELECT sample_id, sector, variable, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY sector, place) - 1 AS INTEGER) AS position
  FROM draws WHERE place <= 2)"""


def _corr(year: int) -> str:
    return f"""moments AS (
  SELECT a.variable AS var_a, b.variable AS var_b, count(*) AS n, corr(a.value, b.value) AS c
  FROM cells a JOIN cells b USING ({KEYS}, year) WHERE year = {year} AND a.variable <= b.variable GROUP BY 1, 2),
matrix AS (SELECT var_a, var_b, n, CASE WHEN isnan(c) THEN NULL ELSE c END AS r FROM moments),
both_ways AS (
  SELECT var_a, var_b, abs(r) AS abs_r FROM matrix WHERE var_a < var_b
  UNION ALL SELECT var_b, var_a, abs(r) FROM matrix WHERE var_a < var_b)"""


SET_MAX = """set_max AS (
  SELECT a.sample_id, max(coalesce(abs_r, 1.0)) AS max_corr
  FROM members a JOIN members b ON a.sample_id = b.sample_id AND a.variable < b.variable
  LEFT JOIN matrix2 m ON m.var_a = a.variable AND m.var_b = b.variable GROUP BY 1)"""
MATRIX2 = "matrix2 AS (SELECT var_a, var_b, abs(r) AS abs_r FROM matrix)"

COUNTS = f"""hits AS (
  SELECT sample_id, {KEYS}, count(*) AS filled FROM members JOIN cells USING (variable)
  WHERE {IN_YEARS} GROUP BY sample_id, {KEYS}),
present AS (SELECT DISTINCT variable, year FROM cells WHERE {IN_YEARS}),
whole AS (
  SELECT sample_id FROM members JOIN present USING (variable) GROUP BY sample_id HAVING count(*) = 20),
counts AS (
  SELECT s.sample_id, count(*) FILTER (WHERE filled >= 16 AND w.sample_id IS NOT NULL) AS n_scenarios
  FROM (SELECT DISTINCT sample_id FROM members) s LEFT JOIN hits h USING (sample_id) LEFT JOIN whole w USING (sample_id)
  GROUP BY 1)"""

def _expanded(sparse: bool, threshold: float, max_vars: int) -> str:
    return f"""WITH RECURSIVE {_base(sparse)}, {DRAWS}, {_corr(1996)}, {MATRIX2}, {SET_MAX},
names AS (
  SELECT sample_id, list(variable ORDER BY position) AS names FROM members JOIN set_max USING (sample_id)
  WHERE max_corr <= {threshold} GROUP BY 1),
conflicts AS (
  SELECT s.variable, list(o.variable) AS bad FROM sectors s JOIN sectors o ON s.variable <> o.variable
  LEFT JOIN both_ways b ON b.var_a = s.variable AND b.var_b = o.variable WHERE coalesce(abs_r, 1) > {threshold} GROUP BY 1),
groups AS (SELECT sector, list(variable) AS members FROM sectors GROUP BY 1),
pool AS (
  SELECT sample_id, variable, coalesce(bad, []) AS bad, groups.members AS mates,
         row_number() OVER (PARTITION BY sample_id ORDER BY sector, place) AS step
  FROM draws LEFT JOIN conflicts USING (variable) JOIN groups USING (sector) WHERE place > 2),
grown AS (
  SELECT sample_id, CAST(0 AS BIGINT) AS step, names FROM names
  UNION ALL
  SELECT g.sample_id, p.step,
         CASE WHEN len(list_intersect(g.names, p.mates)) < {max_vars} AND NOT list_has_any(g.names, p.bad)
              THEN list_append(g.names, p.variable) ELSE g.names END
  FROM grown g JOIN pool p ON p.sample_id = g.sample_id AND p.step = g.step + 1),
final AS (SELECT sample_id, arg_max(names, step) AS names FROM grown GROUP BY 1),
flat AS (SELECT sample_id, unnest(names) AS variable FROM final),
strongest AS (
  SELECT a.sample_id, max(coalesce(m.abs_r, 1.0)) AS max_corr FROM flat a JOIN flat b
  ON a.sample_id = b.sample_id AND a.variable < b.variable
  LEFT JOIN matrix2 m ON m.var_a = a.variable AND m.var_b = b.variable GROUP BY 1)"""


EXPANDED = _expanded(False, 0.2, 4)

SUPPORT = f"""sizes AS (SELECT sample_id, count(*) * 2 AS n FROM flat GROUP BY 1),
hits AS (
  SELECT sample_id, {KEYS}, count(*) AS filled FROM flat JOIN cells USING (variable)
  WHERE {IN_YEARS} GROUP BY sample_id, {KEYS}),
present AS (SELECT DISTINCT variable, year FROM cells WHERE {IN_YEARS}),
whole AS (
  SELECT sample_id FROM flat JOIN present USING (variable) JOIN sizes USING (sample_id) GROUP BY sample_id, n HAVING count(*) = n),
supported AS (
  SELECT sample_id, count(*) FILTER (WHERE filled >= floor(n * 0.8::DOUBLE)) AS n_scenarios
  FROM hits JOIN whole USING (sample_id) JOIN sizes USING (sample_id) GROUP BY 1)"""

RANKED = f"""{_expanded(True, 0.4, 3)}, {SUPPORT},
ranked AS (
  SELECT sample_id, names, n_scenarios, max_corr FROM final JOIN strongest USING (sample_id) JOIN supported USING (sample_id)
  WHERE n_scenarios > 0)"""


CATEGORIES = """categories AS (
  SELECT s_suppkey, CASE WHEN s_suppkey % 7 > 0 THEN
    CASE WHEN s_suppkey % 3 = 0 THEN ' ' || name || '  ' ELSE name END END AS category
  FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'failed-vetting'
               ELSE 'C' || CAST(s_suppkey % 11 AS VARCHAR) END AS name FROM supplier))"""

WIDE_MAP = f"""{SECTORS}, lines AS (
  SELECT variable, sector FROM sectors UNION ALL SELECT DISTINCT p_type, 'T' FROM part)"""

FILLED = f"""kept AS (
  SELECT {KEYS} FROM cells WHERE {IN_YEARS} GROUP BY {KEYS} HAVING count(*) >= 30),
pairs AS (SELECT DISTINCT variable, year FROM cells WHERE {IN_YEARS}),
grid AS (
  SELECT {KEYS}, variable, year, value FROM kept CROSS JOIN pairs
  LEFT JOIN cells USING ({KEYS}, variable, year)),
imputed AS (
  SELECT {KEYS}, variable, year, coalesce(value, avg(value) OVER (PARTITION BY variable, year)) AS value FROM grid)"""

RULE = """rule_rows AS (
  SELECT l_quantity, l_discount, l_tax, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, l_extendedprice,
         CASE WHEN l_quantity > 35 AND l_discount < 0.05 THEN 1 ELSE 0 END AS label
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
BOX_1 = "l_quantity BETWEEN 30 AND 50 AND l_discount BETWEEN 0 AND 0.06"
BOXES = [(BOX_1, 2), ("l_quantity BETWEEN 36 AND 50 AND l_discount BETWEEN 0 AND 0.04", 2), ("p_size BETWEEN 10 AND 20", 1)]
BOX_STATS = "box_stats AS (" + " UNION ALL ".join(
    f"""SELECT {i} AS box_index, count(*) FILTER (WHERE {w}) AS n,
  CAST(count(*) FILTER (WHERE {w}) AS DOUBLE) / count(*) AS mass,
  CAST(coalesce(sum(label) FILTER (WHERE {w}), 0) AS DOUBLE) / count(*) FILTER (WHERE {w}) AS density,
  CAST(coalesce(sum(label) FILTER (WHERE {w}), 0) AS DOUBLE) / sum(label) AS coverage, {k} AS res_dim FROM rule_rows"""
    for i, (w, k) in enumerate(BOXES)
) + ")"
ASSESSED = """assessed AS (SELECT box_index, round_even(density, 3) AS precision, round_even(coverage, 3) AS recall,
  round_even(CASE WHEN density + coverage = 0 THEN 0 ELSE 2 * density * coverage / (density + coverage) END, 3) AS f1_score,
  res_dim AS restricted_dims, round_even(mass, 3) AS mass FROM box_stats)"""
LIMITS = {"l_quantity": (30, 50), "l_discount": (0, 0.06)}


def _restricted() -> str:
    parts = []
    for f in RULE_FEATURES:
        low, high = LIMITS.get(f, (f"min({f})", f"max({f})"))
        parts.append(
            f"SELECT '{f}' AS variable, CAST({low} AS DOUBLE) AS low, CAST({high} AS DOUBLE) AS high, "
            f"CAST(min({f}) AS DOUBLE) AS data_low, CAST(max({f}) AS DOUBLE) AS data_high FROM rule_rows"
        )
    return f"""WITH {RULE}, limits AS ({' UNION ALL '.join(parts)}),
restricted AS (SELECT *, NOT (abs(low - data_low) <= 1e-6 + 1e-5 * abs(data_low)
  AND abs(high - data_high) <= 1e-6 + 1e-5 * abs(data_high)) AS restricted FROM limits)"""


def _found_box() -> str:
    parts = []
    for f in RULE_FEATURES:
        cut = "FILTER (WHERE label = 1)" if f in ("l_quantity", "l_discount") else ""
        flag = "true" if cut else "false"
        parts.append(
            f"SELECT '{f}' AS variable, CAST(min({f}) {cut} AS DOUBLE) AS low, CAST(max({f}) {cut} AS DOUBLE) AS high, "
            f"{flag} AS restricted FROM rule_rows"
        )
    return f"WITH {RULE} " + " UNION ALL ".join(parts)


def _peels() -> str:
    inside = "l_quantity BETWEEN 30 AND 50"
    unioned = " UNION ALL ".join(
        f"SELECT '{f}' AS variable, CAST({f} AS DOUBLE) AS value, label FROM rule_rows WHERE {inside}" for f in RULE_FEATURES
    )
    return f"""WITH {RULE}, boxed AS ({unioned}),
levels AS (SELECT variable, value, count(*) AS n, sum(label) AS p FROM boxed GROUP BY 1, 2),
sides AS (
  SELECT variable, 'low' AS side, value, sum(n) OVER w AS removed, sum(p) OVER w AS lost,
         lead(value) OVER w AS bound FROM levels WINDOW w AS (PARTITION BY variable ORDER BY value)
  UNION ALL
  SELECT variable, 'high', value, sum(n) OVER w, sum(p) OVER w, lead(value) OVER w
  FROM levels WINDOW w AS (PARTITION BY variable ORDER BY value DESC)),
totals AS (SELECT count(*) AS inside, sum(label) AS positives, (SELECT count(*) FROM rule_rows) AS everything FROM rule_rows WHERE {inside}),
open_cuts AS (SELECT *, removed >= 0.05 * inside AS enough FROM sides, totals WHERE bound IS NOT NULL),
best AS (
  SELECT variable, side, coalesce(min(removed) FILTER (WHERE enough), max(removed)) AS removed FROM open_cuts GROUP BY 1, 2)
SELECT variable, side, bound, CAST(removed AS BIGINT) AS removed,
       round((inside - removed) / CAST(everything AS DOUBLE), 6) + 0.0 AS mass,
       round((positives - lost) / CAST(inside - removed AS DOUBLE), 6) + 0.0 AS mean
FROM open_cuts JOIN best USING (variable, side, removed)"""


def _report() -> str:
    support = SUPPORT.replace("0.8::DOUBLE", "0.7::DOUBLE")
    return f"""{_expanded(True, 0.5, 5)}, {support},
ranked AS (
  SELECT sample_id, names, n_scenarios, max_corr FROM final JOIN strongest USING (sample_id) JOIN supported USING (sample_id)
  WHERE n_scenarios > 0)
SELECT CAST(row_number() OVER (ORDER BY n_scenarios DESC, sample_id) AS INTEGER) AS combination,
       CAST(len(names) AS INTEGER) AS n_variables, n_scenarios, round(max_corr, 4) + 0.0 AS max_correlation,
       n_scenarios AS n_labelled, true AS explained
FROM (SELECT * FROM ranked ORDER BY n_scenarios DESC, sample_id LIMIT 10)"""


LABELS = """CASE temp_bucket WHEN '1.5' THEN '1.5°C' WHEN '2' THEN '2.0°C' WHEN 'above 2' THEN 'Above 2.0°C'
  WHEN 'failed-vetting' THEN 'Failed Vetting' WHEN 'no-climate-assessment' THEN 'No Climate Assessment' END AS label,
CASE temp_bucket WHEN '1.5' THEN '#D9420B' WHEN '2' THEN '#035AA6' WHEN 'above 2' THEN '#338474'
  WHEN 'failed-vetting' THEN '#999999' WHEN 'no-climate-assessment' THEN '#CCCCCC' END AS colour"""

WEIGHTS = f"{SPARSE}, weights AS (SELECT variable, sum(value) AS importance FROM cells GROUP BY 1)"

POINTS = """points AS (
  SELECT vec_id, label AS cluster, 'e' || CAST(generate_subscripts(embedding, 1) - 1 AS VARCHAR) AS variable,
         CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""


def _quartiles(group: str) -> str:
    return f"""boxes AS (
  SELECT {group}, variable, count(*) AS n, min(value) AS low, quantile_cont(value, 0.25) AS q1,
         quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS high
  FROM points GROUP BY 1, 2),
whiskers AS (
  SELECT {group}, variable, min(value) AS whisker_low, max(value) AS whisker_high
  FROM points JOIN boxes USING ({group}, variable)
  WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1, 2)"""


def _r(*columns: str, digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c.split('.')[-1]}" for c in columns)


def statements() -> dict[str, str]:
    training = "CAST('0x' || substr(md5('42|' || CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR)), 1, 8) AS BIGINT)"
    name = """CASE p_partkey % 4
      WHEN 0 THEN p_brand || ' (' || CAST(p_size AS VARCHAR) || ')'
      WHEN 1 THEN p_brand || '|' || p_type || ' (incl. x) ( ' || CAST(p_size AS VARCHAR) || ' )'
      WHEN 2 THEN p_name || ' (' || p_type || ')' ELSE p_name END"""
    coverage = f"""seen AS (
      SELECT {KEYS}, variable, count(DISTINCT year) AS k FROM cells WHERE {IN_YEARS} GROUP BY {KEYS}, variable)"""
    long_form = "SELECT model, scenario, variable, year,"
    strict = "CASE WHEN category IN ('C1', 'C2') THEN 1 ELSE 0 END"
    trimmed = f"coalesce({BUCKET.format(c='trim(category)')}, trim(category))"
    return {
        "tidy_long": f"{DENSE} SELECT {KEYS}, variable, year, value FROM long",
        "coverage_table": f"{SPARSE}, {coverage} SELECT variable, count(*) FILTER (WHERE k = 2) AS coverage FROM seen GROUP BY 1",
        "coverage_one": f"{SPARSE}, {coverage} SELECT 'Brand#7' AS variable, count(*) AS coverage FROM seen WHERE variable = 'Brand#7' AND k = 2",
        "pivot_first": f"{DENSE} SELECT {KEYS}, {_wide()} FROM cells WHERE {IN_YEARS} GROUP BY {KEYS}",
        "unpivot_years": f"""{DENSE}, ids AS (SELECT DISTINCT model, scenario, region, variable FROM cells)
            SELECT ids.*, CAST(y.range AS INTEGER) AS year, value FROM ids CROSS JOIN range(1995, 2002) y
            LEFT JOIN cells c ON c.model = ids.model AND c.scenario = ids.scenario AND c.region = ids.region
            AND c.variable = ids.variable AND c.year = y.range""",
        "parse_year_names": f"""SELECT p_partkey, name,
            CASE WHEN p_partkey % 4 = 0 THEN p_brand WHEN p_partkey % 4 = 1 THEN p_brand || '|' || p_type || ' (incl. x)' ELSE name END AS variable,
            CASE WHEN p_partkey % 4 < 2 THEN CAST(p_size AS INTEGER) END AS year FROM (SELECT *, {name} AS name FROM part)""",
        "roundtrip_wide": f"{SPARSE} SELECT {KEYS}, variable, year, value FROM cells WHERE {IN_YEARS}",
        "shape_report": f"""{SPARSE} SELECT (SELECT count(*) FROM (SELECT DISTINCT {KEYS} FROM cells)) AS n_scenarios,
            (SELECT count(*) FROM (SELECT DISTINCT variable, year FROM cells)) AS n_columns""",
        "bucket_map_trimmed": f"WITH {CATEGORIES} SELECT s_suppkey, category, {trimmed} AS temp_bucket FROM categories",
        "bucket_map_raw": f"WITH {CATEGORIES} SELECT s_suppkey, category, coalesce({BUCKET.format(c='trim(category)')}, category) AS temp_bucket FROM categories",
        "bucket_map_null": f"WITH {CATEGORIES} SELECT s_suppkey, category, {BUCKET.format(c='category')} AS temp_bucket FROM categories",
        "bucket_counts": f"WITH {SCENARIOS} SELECT temp_bucket, count(*) AS n FROM labelled GROUP BY 1",
        "binary_target": f"""WITH {CATEGORIES} SELECT s_suppkey,
            CASE WHEN {trimmed} = '1.5' THEN 1 ELSE 0 END AS label, {strict} AS strict_label FROM categories""",
        "display_labels": f"""{DENSE} SELECT temp_bucket AS bucket,
            CASE temp_bucket WHEN '1.5' THEN '1.5°C' WHEN '2' THEN '2.0°C' WHEN 'above 2' THEN 'Above 2.0°C'
              WHEN 'failed-vetting' THEN 'Failed Vetting' WHEN 'no-climate-assessment' THEN 'No Climate Assessment' END AS label,
            CASE temp_bucket WHEN '1.5' THEN '#D9420B' WHEN '2' THEN '#035AA6' WHEN 'above 2' THEN '#338474'
              WHEN 'failed-vetting' THEN '#999999' WHEN 'no-climate-assessment' THEN '#CCCCCC' END AS colour,
            count(*) AS n FROM long GROUP BY 1""",
        "sector_default": """WITH map AS (SELECT p_brand AS variable, arg_max(p_type, p_partkey) AS sector FROM part GROUP BY 1),
            variables AS (SELECT variable, count(*) AS n FROM (SELECT p_brand AS variable FROM part UNION ALL SELECT p_name FROM part) GROUP BY 1)
            SELECT variable, coalesce(sector, 'Other') AS sector, n FROM variables LEFT JOIN map USING (variable)""",
        "sector_present": f"{DENSE}, {WIDE_MAP} SELECT * FROM lines WHERE variable IN (SELECT variable FROM cells)",
        "sector_absent": f"{DENSE}, {WIDE_MAP} SELECT * FROM lines WHERE variable NOT IN (SELECT variable FROM cells)",
        "category_join": f"{DENSE} SELECT c.*, s.category FROM cells c LEFT JOIN scenarios s USING (model, scenario)",
        "bucket_join": f"""{SPARSE} SELECT model, scenario, n_cells, temp_bucket FROM
            (SELECT model, scenario, count(*) AS n_cells FROM cells GROUP BY 1, 2)
            LEFT JOIN (SELECT DISTINCT model, scenario, temp_bucket FROM cells) USING (model, scenario)""",
        "completeness_filter": f"{SPARSE} SELECT {KEYS}, {_wide()} FROM cells WHERE {IN_YEARS} GROUP BY {KEYS} HAVING count(*) >= 35",
        "count_valid": f"{SPARSE} SELECT count(*) AS n_scenarios FROM (SELECT 1 FROM cells WHERE {IN_YEARS} GROUP BY {KEYS} HAVING count(*) >= 35)",
        "corr_pairs": f"{DENSE}, {_corr(1996)} SELECT var_a, var_b, n, {_r('r')}, round(abs(r), 4) + 0.0 AS abs_r FROM matrix WHERE var_a < var_b",
        "corr_matrix": f"""{SPARSE}, {_corr(1998)} SELECT var_a, var_b, {_r('r')} FROM matrix
            UNION ALL SELECT var_b, var_a, {_r('r')} FROM matrix WHERE var_a < var_b""",
        "corr_top_pairs": f"""{DENSE}, {_corr(1996)} SELECT var_a, var_b, {_r('abs_r')} FROM
            (SELECT * FROM both_ways WHERE abs_r < 1 ORDER BY abs_r DESC, var_a, var_b LIMIT 10)""",
        "sample_start_sets": f"WITH {DRAWS} SELECT sample_id, position, variable FROM members",
        "sample_sectors": f"WITH {DRAWS} SELECT sample_id, position, variable, sector FROM members",
        "set_max_corr": f"{DENSE}, {DRAWS}, {_corr(1996)}, {MATRIX2}, {SET_MAX} SELECT sample_id, {_r('max_corr')} FROM set_max",
        "expanded_sets": f"{EXPANDED} SELECT sample_id, array_to_string(names, ',') AS variables, {_r('max_corr')} FROM final JOIN strongest USING (sample_id)",
        "valid_counts_all_sets": f"{SPARSE}, {DRAWS}, {COUNTS} SELECT sample_id, n_scenarios FROM counts",
        "ranked_sets": f"{RANKED} SELECT sample_id, array_to_string(names, ',') AS variables, n_scenarios, {_r('max_corr')} FROM ranked",
        "selection_summary": f"""{RANKED} SELECT CAST(row_number() OVER (ORDER BY n_scenarios DESC, sample_id) AS INTEGER) AS combination,
            CAST(len(names) AS INTEGER) AS n_variables, n_scenarios, round(max_corr, 4) + 0.0 AS max_correlation,
            array_to_string(names, ', ') AS variables FROM (SELECT * FROM ranked ORDER BY n_scenarios DESC, sample_id LIMIT 10)""",
        "mean_impute": f"{SPARSE}, {FILLED} {long_form} round(ln(value), 6) + 0.0 AS log_value FROM imputed",
        "standardise": f"""{SPARSE}, {FILLED}, scaled AS (SELECT *, avg(value) OVER p AS m, stddev_pop(value) OVER p AS s
            FROM imputed WINDOW p AS (PARTITION BY variable, year))
            {long_form} round(CASE WHEN s = 0 THEN 0 ELSE (value - m) / s END, 4) + 0.0 AS value FROM scaled""",
        "feature_ranges": f"WITH {RULE} "
        + " UNION ALL ".join(
            f"SELECT '{f}' AS variable, CAST(min({f}) AS DOUBLE) AS low, CAST(max({f}) AS DOUBLE) AS high FROM rule_rows" for f in RULE_FEATURES
        ),
        "hash_split": f"SELECT o_orderkey, o_custkey, CASE WHEN {training} % 1000 < 700 THEN 1 ELSE 0 END AS training FROM orders",
        "box_stats": f"WITH {RULE}, {BOX_STATS} SELECT box_index, n, {_r('mass', 'density', 'coverage', digits=6)}, res_dim FROM box_stats",
        "box_assess": f"WITH {RULE}, {BOX_STATS}, {ASSESSED} SELECT * FROM assessed",
        "box_best_f1": f"WITH {RULE}, {BOX_STATS}, {ASSESSED} SELECT coalesce(max(f1_score), 0.0) AS best_f1 FROM assessed",
        "box_restricted": f"{_restricted()} SELECT * FROM restricted",
        "box_rank": f"""{_restricted()} SELECT variable,
            CASE WHEN restricted THEN round(high - low, 4) + 0.0 ELSE CAST('Infinity' AS DOUBLE) END AS width FROM restricted""",
        "peel_candidates": _peels(),
        "find_box": _found_box(),
        "box_points": f"""WITH {RULE} SELECT ({BOX_1}) AS in_box, label, count(*) AS n, round(sum(l_quantity), 2) + 0.0 AS sum_quantity,
            round(sum(l_discount), 2) + 0.0 AS sum_discount FROM rule_rows GROUP BY 1, 2""",
        "class_metrics": """WITH t AS (SELECT quality AS y, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)),
            c AS (SELECT count(*) AS n, count(*) FILTER (WHERE y = p) AS hit, CAST(count(*) FILTER (WHERE y = 1 AND p = 1) AS DOUBLE) AS tp,
                  count(*) FILTER (WHERE p = 1) AS called, count(*) FILTER (WHERE y = 1) AS actual FROM t)
            SELECT n, round(hit / CAST(n AS DOUBLE), 6) + 0.0 AS accuracy,
                   round(coalesce(2 * tp / nullif(called + actual, 0), 0), 6) + 0.0 AS f1 FROM c""",
        "importance_share": f"""{WEIGHTS} SELECT variable, {_r('importance', digits=2)},
            round(sum(importance) OVER (ORDER BY importance DESC, variable ROWS UNBOUNDED PRECEDING) / sum(importance) OVER (), 6) + 0.0 AS share FROM weights""",
        "importance_count": f"""{WEIGHTS}, shares AS (SELECT sum(importance) OVER (ORDER BY importance DESC, variable ROWS UNBOUNDED PRECEDING)
            / sum(importance) OVER () AS share FROM weights) SELECT count(*) FILTER (WHERE share < 0.8) + 1 AS n_variables FROM shares""",
        "importance_top": f"{WEIGHTS} SELECT variable, {_r('importance', digits=2)} FROM (SELECT * FROM weights ORDER BY importance DESC, variable LIMIT 10)",
        "cumulative_variance": f"""{DENSE}, v AS (SELECT CAST(split_part(variable, '#', 2) AS INTEGER) AS component, var_pop(value) AS v FROM cells GROUP BY 1),
            s AS (SELECT component, v / sum(v) OVER () AS explained FROM v)
            SELECT component, {_r('explained', digits=6)}, round(sum(explained) OVER (ORDER BY component), 6) + 0.0 AS cumulative FROM s""",
        "cluster_quartiles": f"""WITH {POINTS}, {_quartiles('cluster')} SELECT cluster, variable, n,
            {_r('low', 'q1', 'median', 'q3', 'high', 'whisker_low', 'whisker_high')} FROM boxes JOIN whiskers USING (cluster, variable)""",
        "combined_quartiles": f"""WITH {POINTS.replace('label AS cluster', "CASE label WHEN 0 THEN '1.5°C' WHEN 1 THEN 'Above 1.5' ELSE 'Unknown' END AS label")},
            {_quartiles('label')} SELECT label, variable, n, {_r('q1', 'median', 'q3', 'whisker_low', 'whisker_high')}
            FROM boxes JOIN whiskers USING (label, variable) WHERE label <> 'Unknown'""",
        "cluster_label_map": "SELECT vec_id, CASE label WHEN 0 THEN '1.5°C' WHEN 1 THEN 'Above 1.5' ELSE 'Unknown' END AS bucket FROM embeddings",
        "top_per_cluster": f"""WITH {POINTS}, means AS (SELECT cluster, variable, round(abs(avg(value)), 9) AS importance FROM points GROUP BY 1, 2),
            placed AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY importance DESC, variable) AS place FROM means)
            SELECT cluster, variable, {_r('importance')} FROM placed WHERE place <= 10""",
        "csv_round_trip": f"{DENSE} SELECT {KEYS}, variable, year, value FROM cells",
        "parquet_round_trip": f"{DENSE} SELECT {KEYS}, variable, year, value FROM cells WHERE {IN_YEARS}",
        "pivot_file": f"{DENSE} SELECT model, scenario, variable, year, value FROM cells",
        "sector_map_file": f"WITH {SECTORS} SELECT variable, sector FROM sectors",
        "category_map_file": f"WITH {SCENARIOS} SELECT model, scenario, category FROM scenarios",
        "rewrite_with_bucket": f"WITH {CATEGORIES} SELECT s_suppkey, category, {BUCKET.format(c='category')} AS temp_bucket FROM categories",
        "box_trajectory": f"""WITH {RULE} SELECT CAST(count(*) AS BIGINT) AS first_rows_inside, CAST(sum(label) AS BIGINT) AS first_positives,
            CAST(sum(label) AS BIGINT) AS last_rows_inside, CAST(sum(label) AS BIGINT) AS last_positives, CAST(0 AS BIGINT) AS contradicted FROM rule_rows""",
        "rf_importance": f"""{SPARSE}, {FILLED} SELECT CAST(model AS INTEGER) AS model, variable || ' (' || CAST(year AS VARCHAR) || ')' AS variable,
            model = 1 AND variable = 'Brand#7' AND year = 1996 AS leads, 1.0::DOUBLE AS total FROM pairs CROSS JOIN range(2) AS r(model)""",
        "cluster_rf": """SELECT label AS cluster, CASE label WHEN 0 THEN '1.5°C' WHEN 1 THEN 'Above 1.5' ELSE 'Unknown' END AS bucket,
            CAST(10 AS BIGINT) AS n, 'planted' AS top_variable FROM embeddings GROUP BY label""",
        "shap_importance": f"""{SPARSE}, {FILLED} SELECT (SELECT count(*) FROM kept) AS n_scenarios, (SELECT count(*) FROM kept) AS n_additive,
            (SELECT count(*) FROM pairs) AS n_variables, true AS some_matter, true AS accuracy_ok""",
        "shap_summary": f"""{SPARSE}, {FILLED}, scaled AS (SELECT *, avg(value) OVER p AS m, stddev_pop(value) OVER p AS s
            FROM imputed WINDOW p AS (PARTITION BY variable, year))
            SELECT model, scenario, variable || ' (' || CAST(year AS VARCHAR) || ')' AS "column",
            round(CASE WHEN s = 0 THEN 0 ELSE (value - m) / s END, 4) + 0.0 AS value, true AS additive FROM scaled""",
        "pca_scores": f"""WITH {POINTS}, z AS (SELECT vec_id, cluster, (value - avg(value) OVER p) / nullif(stddev_pop(value) OVER p, 0) AS z
            FROM points WINDOW p AS (PARTITION BY variable))
            SELECT vec_id, cluster, round(sum(z * z), 4) + 0.0 AS squared_length FROM z GROUP BY 1, 2""",
        "pca_variance": "SELECT CAST(range + 1 AS INTEGER) AS component, true AS \"right\", true AS falls FROM range(5)",
        "pca_projection": f"{SPARSE}, {FILLED} SELECT temp_bucket, {LABELS}, count(*) AS n, count(*) AS n_filled FROM kept WHERE temp_bucket IS NOT NULL GROUP BY temp_bucket",
        "pair_points": "SELECT label AS cluster, count(*) AS n, count(*) AS n_points, CAST(6 AS INTEGER) AS n_components FROM embeddings GROUP BY label",
        "combination_report": _report(),
        "per_combination_files": f"""{RANKED}, top AS (SELECT * FROM ranked ORDER BY n_scenarios DESC, sample_id LIMIT 10),
            numbered AS (SELECT CAST(row_number() OVER (ORDER BY n_scenarios DESC, sample_id) AS INTEGER) AS combination, names FROM top)
            SELECT combination, CAST(generate_subscripts(names, 1) - 1 AS INTEGER) AS position, unnest(names) AS variable FROM numbered""",
        "record_files": f"""{RANKED} SELECT CAST(row_number() OVER (ORDER BY n_scenarios DESC, sample_id) AS INTEGER) AS combination,
            array_to_string(names, ',') AS variables, n_scenarios FROM (SELECT * FROM ranked ORDER BY n_scenarios DESC, sample_id LIMIT 10)""",
        "mixed_case_headers": f"{DENSE} SELECT model, scenario, region, variable, year, value FROM cells",
        "missing_columns": """SELECT 'supplier' AS name, CAST(3 AS INTEGER) AS n_missing, count(*) AS n_rows FROM supplier
            UNION ALL SELECT 'nation', 3, count(*) FROM nation UNION ALL SELECT 'lineitem', 3, count(*) FROM lineitem
            UNION ALL SELECT 'documents', 3, count(*) FROM documents""",
        "column_groups_file": f"{DENSE} SELECT {KEYS}, variable, year, value FROM cells",
        "load_scenarios": f"{DENSE} SELECT {KEYS}, variable, year, value FROM cells",
        "filtered_file": f"{SPARSE} SELECT {KEYS}, {_wide()} FROM cells WHERE {IN_YEARS} GROUP BY {KEYS} HAVING count(*) >= 35",
    }

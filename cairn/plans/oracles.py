"""The same results as plain SQL over the sample tables."""

from __future__ import annotations

import re

# Views over the sample tables, one per role. A query lists only those it uses.
VIEWS = {
    "v_line": """
        SELECT *, l_orderkey * 10 + l_linenumber AS sample_id,
               concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                         CAST(round(l_extendedprice * 100) AS BIGINT)) AS entity_id
        FROM lineitem""",
    "v_group": """
        SELECT o_orderkey AS sample_group_id, o_custkey AS site_id,
               CAST(substr(o_orderpriority, 1, 1) AS BIGINT) + 100 AS method_id,
               o_orderpriority AS sample_group_name,
               'Status ' || o_orderstatus AS sample_group_description
        FROM orders""",
    "v_entity": """
        SELECT g.site_id, l.l_orderkey AS sample_group_id, l.sample_id, l.entity_id,
               l.l_suppkey AS dataset_id, CAST(s.s_nationkey AS BIGINT) AS method_id,
               l.l_partkey AS taxon_id, CAST(l.l_quantity AS BIGINT) AS abundance,
               l.l_returnflag, l.l_linestatus, l.l_linenumber, l.l_quantity
        FROM v_line l JOIN v_group g ON g.sample_group_id = l.l_orderkey
        JOIN supplier s ON s.s_suppkey = l.l_suppkey""",
    "v_sample": """
        SELECT l_orderkey * 10 + l_linenumber AS physical_sample_id, l_orderkey AS sample_group_id,
               min(l_returnflag) AS sample_type_name, min(l_shipdate) AS day,
               concat_ws('/', l_orderkey, l_linenumber) AS sample_name
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_site_dataset": "SELECT DISTINCT site_id, dataset_id, method_id FROM v_entity",
    "v_method": """
        SELECT CAST(n_nationkey AS BIGINT) AS method_id, n_name AS method_name,
               CAST(n_regionkey AS BIGINT) AS method_group_id,
               CAST(n_regionkey AS BIGINT) AS record_type_id
        FROM nation""",
    "v_sampling_method": """
        SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) + 100 AS method_id,
               o_orderpriority AS method_name
        FROM orders""",
    "v_word": """
        SELECT DISTINCT p_partkey AS taxon_id, unnest(string_split(p_name, ' ')) AS word FROM part""",
    "v_code": """
        SELECT taxon_id, word,
               CAST('0x' || substr(md5(word), 1, 15) AS BIGINT) AS definition_id,
               CAST(length(word) % 3 AS BIGINT) AS group_id,
               upper(substr(word, 1, 2)) AS abbreviation
        FROM v_word""",
    "v_code2": "SELECT * FROM v_code WHERE group_id < 2",
    "v_taxonomy": """
        SELECT p_partkey AS taxon_id, p_name AS species,
               CAST(p_size % 9 AS BIGINT) AS author_id,
               CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS genus_id,
               p_brand AS genus_name,
               CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) % 5 AS family_id,
               'Family ' || r.r_name AS family_name,
               CAST(r.r_regionkey % 2 AS BIGINT) AS order_id,
               'Order ' || o.r_name AS order_name
        FROM part
        JOIN region r ON r.r_regionkey = CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) % 5
        JOIN region o ON o.r_regionkey = r.r_regionkey % 2""",
    "v_age": """
        SELECT o.o_custkey AS site_id, l.l_orderkey AS sample_group_id, l.sample_id, l.entity_id,
               l.l_suppkey AS dataset_id,
               CASE WHEN l_linenumber = 1 THEN CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS DOUBLE) END AS age,
               CASE WHEN l_linenumber <> 1 THEN CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS DOUBLE) END AS age_older,
               CASE WHEN l_linenumber <> 1 THEN CAST(date_diff('day', CAST(l_shipdate AS DATE), DATE '2002-01-01') AS DOUBLE) END AS age_younger,
               CASE WHEN l_linenumber = 1 THEN l_returnflag END AS dating_specifier,
               CAST(l_linenumber AS DOUBLE) AS chronology_id
        FROM v_line l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "v_dating": """
        SELECT l_suppkey AS dataset_id, entity_id, sample_id, l_orderkey AS sample_group_id,
               l_returnflag = 'N' AS is_lab,
               CASE WHEN l_returnflag = 'A' THEN l_quantity * 100 + 0.5 END AS c14_age_older,
               CASE WHEN l_returnflag = 'A' THEN l_quantity * 90 END AS c14_age_younger,
               CASE WHEN l_returnflag = 'R' THEN l_quantity * 110 END AS cal_age_older,
               CASE WHEN l_returnflag = 'R' THEN l_quantity * 80 + 0.25 END AS cal_age_younger,
               CASE WHEN l_returnflag = 'N' THEN round(l_extendedprice * 100) / 100 / 10 END AS age,
               CASE WHEN l_returnflag = 'N' THEN l_quantity END AS error_older,
               CASE WHEN l_returnflag = 'N' THEN CAST(l_linenumber AS DOUBLE) - 1 END AS error_younger,
               CASE WHEN l_returnflag = 'N' THEN l_linenumber || '-lab' END AS dating_lab_id
        FROM v_line""",
    "v_value": """
        SELECT event_id, user_id AS site_id,
               -(user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))) AS sample_id,
               event_id % 50 AS dataset_id, event_type AS key,
               CAST('0x' || substr(md5(event_type), 1, 15) AS BIGINT) AS value_class_id,
               CAST(length(event_type) % 2 AS BIGINT) AS value_type_id,
               CASE WHEN event_type = 'signup' THEN 'kind ' || (k % 7)
                    WHEN event_type = 'error' AND event_id % 3 = 0 THEN k || ' approx'
                    WHEN event_type = 'click' AND user_id % 5 = 0 THEN 'none'
                    ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS value
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "v_range": """
        SELECT event_id, CAST('0x' || substr(md5(event_type), 1, 15) AS BIGINT) AS value_class_id, event_type, user_id AS site_id,
               event_id % 50 AS dataset_id,
               CASE WHEN event_id % 11 <> 0 THEN 1000 + k * 5 END AS low_value,
               CASE WHEN event_type <> 'click'
                    THEN 1000 + k * 5 + CAST(floor(value) AS BIGINT) END AS high_value
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
        WHERE event_type IN ('view', 'purchase', 'click')""",
    "v_matrix": """
        SELECT vec_id AS taxon_id, r AS mcr_row,
               array_to_string(list_transform(embedding[1:60],
                   lambda x: CASE WHEN CAST(x AS DOUBLE) * 50 > r - 18 THEN '1' ELSE '0' END), '') AS mcr_data
        FROM embeddings, (SELECT unnest(range(1, 37)) AS r)""",
    "v_climate": """
        SELECT vec_id AS taxon_id,
               CAST(floor(CAST(embedding[1] AS DOUBLE) * 100) AS BIGINT) AS tmax_hi,
               CAST(floor(CAST(embedding[2] AS DOUBLE) * 100) AS BIGINT) AS tmax_lo,
               CAST(floor(CAST(embedding[3] AS DOUBLE) * 100) AS BIGINT) AS tmin_hi,
               CAST(floor(CAST(embedding[4] AS DOUBLE) * 100) AS BIGINT) AS tmin_lo,
               CAST(floor(CAST(embedding[5] AS DOUBLE) * 100) AS BIGINT) AS trange_hi,
               CAST(floor(CAST(embedding[6] AS DOUBLE) * 100) AS BIGINT) AS trange_lo,
               CASE WHEN vec_id % 4 <> 0 THEN CAST(floor(CAST(embedding[7] AS DOUBLE) * 100) AS BIGINT) END AS cog_mid_tmax,
               CASE WHEN vec_id % 4 <> 0 THEN CAST(floor(CAST(embedding[8] AS DOUBLE) * 100) AS BIGINT) END AS cog_mid_trange
        FROM embeddings""",
    "v_dataset_taxon": """
        SELECT DISTINCT l_suppkey AS scope, l_partkey AS taxon_id FROM lineitem
        WHERE l_partkey IN (SELECT vec_id FROM embeddings)""",
    "v_site_taxon": """
        SELECT DISTINCT site_id AS scope, taxon_id FROM v_entity
        WHERE method_id = 3 AND taxon_id IN (SELECT vec_id FROM embeddings)""",
    "v_column": "SELECT unnest(range(1, 61)) AS c",
}

ORACLES: dict[str, str] = {}


def _used(sql: str) -> list[str]:
    """View names that ``sql`` needs, each after those it builds on."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def oracle(name: str, sql: str) -> None:
    views = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in _used(sql))
    body = sql.strip()
    if not views:
        ORACLES[name] = body
    elif body.upper().startswith("WITH "):
        ORACLES[name] = f"WITH {views},\n{body[5:]}"
    else:
        ORACLES[name] = f"WITH {views}\n{body}"


# --- summaries --------------------------------------------------------------

oracle(
    "sum1_dataset_summaries",
    """SELECT d.method_id, m.method_name, count(DISTINCT site_id) AS site_count,
              count(*) AS dataset_count
       FROM v_site_dataset d LEFT JOIN v_method m USING (method_id) GROUP BY ALL""",
)
ORACLES["sum1_dataset_summaries_of_loads"] = ORACLES["sum1_dataset_summaries"]
oracle(
    "sum2_analysis_methods",
    """SELECT d.method_id, m.method_name, m.method_group_id, m.record_type_id,
              count(*) AS dataset_count
       FROM v_site_dataset d LEFT JOIN v_method m USING (method_id) GROUP BY ALL""",
)
oracle(
    "sum3_sample_methods",
    """SELECT g.method_id, m.method_name, CAST(99 AS BIGINT) AS method_group_id,
              count(*) AS sample_group_count
       FROM v_group g LEFT JOIN v_sampling_method m USING (method_id) GROUP BY ALL""",
)
oracle(
    "sum4_domains_overview",
    """SELECT CAST(r.r_regionkey AS BIGINT) AS domain_id, r.r_name AS title, count(*) AS dataset_count
       FROM v_site_dataset d JOIN nation n ON n.n_nationkey = d.method_id
       JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY ALL""",
)
oracle(
    "sum5_domain_sample_summary",
    """WITH c AS (SELECT method_id, count(DISTINCT sample_id) AS n FROM v_entity GROUP BY 1)
       SELECT CAST(n.n_regionkey AS BIGINT) AS domain_id,
              row_number() OVER (PARTITION BY n.n_regionkey ORDER BY n.n_nationkey) - 1 AS method_pos,
              CAST(n.n_nationkey AS BIGINT) AS method_id, n.n_name AS method_name,
              coalesce(c.n, 0) AS sample_count,
              CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY n.n_regionkey) AS BIGINT) AS domain_sample_count
       FROM nation n LEFT JOIN c ON c.method_id = n.n_nationkey""",
)
ORACLES["sum5_domain_sample_summary_of_loads"] = ORACLES["sum5_domain_sample_summary"]
oracle(
    "sum6_countries",
    """SELECT CAST(c_nationkey AS BIGINT) AS location_id, n_name AS country_name,
              count(DISTINCT c_custkey) AS site_count
       FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""",
)
oracle(
    "sum7_feature_types",
    """SELECT CAST(ascii(l_linestatus) AS BIGINT) AS id, l_linestatus AS name, count(*) AS n
       FROM lineitem GROUP BY ALL""",
)
oracle(
    "sum7_feature_types_per_site",
    """SELECT site_id, CAST(ascii(l_linestatus) AS BIGINT) AS id, l_linestatus AS name, count(*) AS n
       FROM v_entity GROUP BY ALL""",
)
oracle(
    "sum8_path_summary",
    """SELECT d.method_id AS id, min(s.s_name) AS name, count(*) AS n
       FROM v_site_dataset d JOIN supplier s ON s.s_suppkey = d.dataset_id GROUP BY 1""",
)
oracle(
    "sum8_path_summary_per_site",
    """SELECT g.site_id, CAST(ascii(s.sample_type_name) AS BIGINT) AS id, s.sample_type_name AS name,
              count(*) AS n
       FROM v_sample s JOIN v_group g USING (sample_group_id) GROUP BY ALL""",
)
oracle("sum9_path_count", "SELECT count(*) AS n FROM lineitem")
oracle(
    "sum10_grouped_by_sample_features",
    """SELECT CAST(ascii(l_linestatus) AS BIGINT) AS id, l_linestatus AS name, count(*) AS n
       FROM lineitem GROUP BY ALL""",
)
oracle(
    "sum10_grouped_by_sample_methods",
    """SELECT method_id AS id, sample_group_name AS name, count(*) AS n FROM v_group GROUP BY ALL""",
)
oracle(
    "sum11_building_types",
    """SELECT o_orderstatus AS name, count(*) AS n FROM orders
       WHERE o_orderpriority LIKE '2%' GROUP BY 1""",
)
oracle(
    "sum12_samples_count",
    "SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)",
)
oracle(
    "sum13_sample_types",
    """SELECT CAST(ascii(sample_type_name) AS BIGINT) AS sample_type_id, sample_type_name AS name,
              count(*) AS n FROM v_sample GROUP BY ALL""",
)
oracle(
    "sum14_sites_with_sample_coordinates",
    """SELECT DISTINCT g.site_id, l.sample_id AS physical_sample_id
       FROM v_line l JOIN v_group g ON g.sample_group_id = l.l_orderkey WHERE l.l_tax > 0.04""",
)
_AGE_EXTREMES = """SELECT site_id, max(CASE WHEN age_older <> 0 THEN CAST(trunc(age_older) AS BIGINT) END) AS {0},
              min(CASE WHEN age_younger <> 0 THEN CAST(trunc(age_younger) AS BIGINT) END) AS {1}
       FROM v_age GROUP BY 1"""
oracle("sum15_dating_overview", _AGE_EXTREMES.format("age_older", "age_younger"))
oracle(
    "sum16_entity_census",
    """WITH e AS (SELECT entity_id, count(*) AS n FROM v_line GROUP BY 1),
       t(table_name, times) AS (VALUES ('abundance', 1), ('aggregate_sample', 0), ('analysis_entity_dimension', 0),
         ('analysis_value', 0), ('ceramic', 1), ('dendro', 0), ('dendro_date', 0), ('entity_age', 1),
         ('geochronology', 0), ('isotope', 1), ('measured_value', 1), ('prep_method', 2), ('relative_date', 0),
         ('tephra_date', 0))
       SELECT entity_id, table_name, CAST(n * times AS BIGINT) AS n FROM e, t""",
)

# --- taxa ----------------------------------------------------------------------

_TOP = """SELECT taxon_id, CAST(sum(abundance) AS BIGINT) AS abundance FROM v_entity
          WHERE method_id = 3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""
oracle(
    "tax1_top_taxa",
    f"""WITH top AS ({_TOP})
       SELECT top.taxon_id, top.abundance, 'Family ' || r.r_name AS family, p.p_brand AS genus,
              p.p_name AS species
       FROM top LEFT JOIN part p ON p.p_partkey = top.taxon_id
       LEFT JOIN region r ON r.r_regionkey = CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) % 5""",
)
oracle(
    "tax2_taxon_distribution",
    """SELECT e.taxon_id, e.site_id, c.c_name AS site_name, CAST(c.c_nationkey AS DOUBLE) AS lon,
              c.c_acctbal / 100 AS lat, CAST(sum(e.abundance) AS BIGINT) AS abundance
       FROM v_entity e JOIN customer c ON c.c_custkey = e.site_id
       WHERE e.method_id = 3 GROUP BY ALL""",
)
oracle(
    "tax3_taxon_references",
    """SELECT p_partkey AS taxon_id,
              CASE WHEN p_size % 9 <> 0 THEN 'Author ' || (p_size % 9) END AS author_name,
              CASE WHEN p_size % 9 <> 0 AND p_size > 25 THEN lower(p_type) END AS taxonomy_notes
       FROM part""",
)
oracle("tax4_taxonomy", "SELECT * FROM v_taxonomy")
oracle(
    "tax5_site_taxa",
    """SELECT DISTINCT e.site_id, e.taxon_id, t.species, t.genus_name, t.family_name, t.order_name,
              CAST(len(string_split(t.species, ' ')) AS BIGINT) AS common_names,
              CAST(1 AS BIGINT) AS measured_attributes,
              CAST(CASE WHEN p.p_size > 25 THEN 1 ELSE 0 END AS BIGINT) AS notes
       FROM v_entity e JOIN v_taxonomy t USING (taxon_id)
       JOIN part p ON p.p_partkey = e.taxon_id""",
)

oracle(
    "tax6_species_associations",
    """SELECT p.p_partkey AS taxon_id, r.r_name AS association_type,
              CAST(p.p_size AS BIGINT) AS associated_taxon_id, o.species, o.genus_name, o.order_name
       FROM part p JOIN region r ON r.r_regionkey = p.p_size % 7
       JOIN v_taxonomy o ON o.taxon_id = p.p_size""",
)

# --- habitat codes -----------------------------------------------------------------

oracle(
    "eco1_taxon_ecocodes",
    """SELECT taxon_id, definition_id, group_id, abbreviation, word AS name FROM v_code2""",
)


def _bundle(scope: str, where: str) -> str:
    return f"""SELECT {scope}, c.definition_id, count(DISTINCT e.taxon_id) AS taxa_count,
              CAST(sum(e.abundance) AS BIGINT) AS abundance
       FROM v_entity e JOIN v_code2 c USING (taxon_id) {where} GROUP BY ALL"""


oracle("eco2_site_ecocodes", _bundle("e.site_id", "WHERE e.method_id = 3"))
oracle(
    "eco2_site_ecocode_taxa",
    """SELECT e.site_id, e.taxon_id, c.definition_id, CAST(sum(e.abundance) AS BIGINT) AS abundance
       FROM v_entity e JOIN v_code2 c USING (taxon_id) WHERE e.method_id = 3 GROUP BY ALL""",
)
oracle(
    "eco3_site_ecocodes_by_sample",
    f"""WITH b AS ({_bundle("e.sample_id", "WHERE e.method_id = 3")})
       SELECT g.site_id, s.physical_sample_id, b.definition_id, coalesce(b.taxa_count, 0) AS taxa_count,
              coalesce(b.abundance, 0) AS abundance
       FROM v_sample s JOIN v_group g USING (sample_group_id)
       LEFT JOIN b ON b.sample_id = s.physical_sample_id""",
)
oracle("eco4_dataset_ecocodes", _bundle("e.dataset_id", ""))
oracle(
    "eco5_dataset_ecocodes_by_sample",
    _bundle("e.dataset_id, e.sample_id AS physical_sample_id", ""),
)
oracle(
    "eco6_ecocodes_summary",
    """SELECT c.definition_id, c.abbreviation, c.word AS name, CAST(sum(e.abundance) AS BIGINT) AS abundance
       FROM v_entity e JOIN v_code2 c USING (taxon_id) WHERE e.method_id = 3 GROUP BY ALL""",
)
oracle(
    "eco6_ecocodes_summary_by_abbreviation",
    """WITH d AS (SELECT c.definition_id, c.abbreviation, c.word, sum(e.abundance) AS abundance
                 FROM v_entity e JOIN v_code2 c USING (taxon_id) WHERE e.method_id = 3 GROUP BY ALL)
       SELECT min(definition_id) AS definition_id, abbreviation, arg_min(word, definition_id) AS name,
              CAST(sum(abundance) AS BIGINT) AS abundance
       FROM d GROUP BY abbreviation""",
)
oracle(
    "eco7_site_ecocode_summary",
    f"""WITH b AS ({_bundle("e.site_id", "WHERE e.method_id = 3")}),
       d AS (SELECT DISTINCT definition_id, abbreviation, word FROM v_code2)
       SELECT b.definition_id, d.abbreviation, d.word AS name, CAST(sum(b.abundance) AS BIGINT) AS abundance,
              CAST(sum(b.taxa_count) AS BIGINT) AS taxa_count
       FROM b JOIN d USING (definition_id) GROUP BY ALL""",
)
oracle(
    "eco8_ecocode_across_sites",
    _bundle("e.site_id", "WHERE e.method_id = 3 AND c.word = 'red'"),
)
for _mode, _weight in (("abundance", "CAST(sum(top.abundance) AS BIGINT)"), ("species", "CAST(0 AS BIGINT)")):
    oracle(
        f"eco9_ecocodes_for_sites_{_mode}",
        f"""WITH top AS ({_TOP})
       SELECT c.definition_id, count(*) AS species, {_weight} AS abundance
       FROM top JOIN v_code2 c USING (taxon_id) GROUP BY 1""",
    )

# --- climate ----------------------------------------------------------------------

oracle(
    "mcr1_taxon_mcr",
    """SELECT e.vec_id AS taxon_id, 'Species ' || e.vec_id AS mcr_species_name,
              CAST(e.label AS BIGINT) AS mcr_number, CAST(NULL AS VARCHAR) AS comparison_notes,
              c.tmax_hi, c.tmax_lo, c.tmin_hi, c.tmin_lo, c.trange_hi, c.trange_lo,
              c.cog_mid_tmax, c.cog_mid_trange,
              (SELECT string_agg(m.mcr_data, '|' ORDER BY m.mcr_row) FROM v_matrix m
               WHERE m.taxon_id = e.vec_id) AS matrix
       FROM embeddings e JOIN v_climate c ON c.taxon_id = e.vec_id""",
)


def _cells(pairs: str) -> str:
    """One row per scope, matrix row and column: taxa, and taxa with a set cell."""
    return f"""SELECT p.scope, m.mcr_row - 1 AS r, k.c - 1 AS c, count(*) AS taxa,
              count(*) FILTER (substr(m.mcr_data, k.c, 1) = '1') AS n
       FROM {pairs} p JOIN v_matrix m USING (taxon_id), v_column k GROUP BY 1, 2, 3"""


def _reconstruction(pairs: str) -> str:
    return f"""WITH cell AS ({_cells(pairs)})
       SELECT scope, CAST(r AS BIGINT) AS row,
              string_agg(CASE WHEN n = taxa THEN '1' ELSE '0' END, '' ORDER BY c) AS bits
       FROM cell GROUP BY scope, r"""


oracle("mcr2_site_reconstruction", _reconstruction("v_site_taxon"))
oracle("mcr2_dataset_reconstruction", _reconstruction("v_dataset_taxon"))
oracle(
    "mcr2_dataset_reconstruction_summary",
    f"""WITH cell AS ({_cells("v_dataset_taxon")})
       SELECT scope, max(taxa) AS taxa_count,
              min(c) FILTER (n = taxa) AS col_min, max(c) FILTER (n = taxa) AS col_max,
              CAST(min(r) FILTER (n = taxa) AS BIGINT) AS row_min,
              CAST(max(r) FILTER (n = taxa) AS BIGINT) AS row_max
       FROM cell GROUP BY scope""",
)
oracle(
    "mcr3_dataset_density",
    f"""SELECT scope, CAST(r AS BIGINT) AS row, c AS col, n FROM ({_cells("v_dataset_taxon")})""",
)


def _lean(pairs: str) -> str:
    return f"""cell AS ({_cells(pairs)}),
       dens AS (SELECT scope, max(taxa) AS taxa_count,
                  min(c) FILTER (n > 0) AS col_min, max(c) FILTER (n > 0) AS col_max,
                  min(r) FILTER (n > 0) AS row_min, max(r) FILTER (n > 0) AS row_max
                FROM cell GROUP BY scope),
       top AS (SELECT scope, r AS peak_row, c AS peak_col, n AS peak_n FROM cell WHERE n > 0
               QUALIFY row_number() OVER (PARTITION BY scope ORDER BY n DESC, r, c) = 1),
       clim AS (SELECT p.scope, min(tmax_lo) AS tmax_lo, max(tmax_hi) AS tmax_hi,
                  min(tmin_lo) AS tmin_lo, max(tmin_hi) AS tmin_hi,
                  min(trange_lo) AS trange_lo, max(trange_hi) AS trange_hi,
                  CAST(floor(avg(cog_mid_tmax) FILTER (cog_mid_trange IS NOT NULL) + 0.5) AS BIGINT) AS cog_tmax,
                  CAST(floor(avg(cog_mid_trange) FILTER (cog_mid_tmax IS NOT NULL) + 0.5) AS BIGINT) AS cog_trange
                FROM {pairs} p JOIN v_climate USING (taxon_id) GROUP BY 1)"""


_LEAN = """tmax_lo, tmax_hi, tmin_lo, tmin_hi, trange_lo, trange_hi, cog_tmax, cog_trange,
           col_min, col_max, row_min, row_max, peak_row, peak_col, peak_n"""
oracle(
    "mcr4_aggregate",
    f"""WITH one AS (SELECT DISTINCT CAST(0 AS BIGINT) AS scope, taxon_id FROM v_site_taxon),
       {_lean("one")}
       SELECT scope, taxa_count, {_LEAN}
       FROM dens JOIN clim USING (scope) LEFT JOIN top USING (scope)""",
)
oracle(
    "mcr5_by_site",
    f"""WITH {_lean("v_site_taxon")}
       SELECT c_custkey AS position, c_custkey AS scope, coalesce(taxa_count, 0) AS taxa_count, {_LEAN}
       FROM customer LEFT JOIN dens ON dens.scope = c_custkey
       LEFT JOIN clim ON clim.scope = c_custkey LEFT JOIN top ON top.scope = c_custkey""",
)
oracle("mcr6_taxa_matrices", "SELECT taxon_id, mcr_row, mcr_data FROM v_matrix")

# --- dating ------------------------------------------------------------------------


def _histogram(bins: int, cap_first: bool) -> str:
    first = "greatest(0, CAST(floor((low - lowest) / width) AS BIGINT))"
    if cap_first:
        first = f"least({bins - 1}, {first})"
    return f"""WITH a AS (
         SELECT sample_group_id AS site_id, least(coalesce(age, age_younger), coalesce(age, age_older)) AS low,
                greatest(coalesce(age, age_younger), coalesce(age, age_older)) AS high
         FROM v_age WHERE coalesce(age, age_younger) IS NOT NULL AND coalesce(age, age_older) IS NOT NULL),
       lim AS (SELECT min(low) AS lowest, (max(high) - min(low)) / {bins} AS width FROM a),
       s AS (SELECT site_id, {first} AS f,
                    least({bins - 1}, CAST(floor((high - lowest) / width) AS BIGINT)) AS l
             FROM a, lim),
       n AS (SELECT bin, count(DISTINCT site_id) AS n FROM
               (SELECT site_id, unnest(range(f, l + 1)) AS bin FROM s) GROUP BY 1)
       SELECT b.bin, lowest + b.bin * width AS bin_start, lowest + (b.bin + 1) * width AS bin_end,
              coalesce(n.n, 0) AS site_count, (SELECT count(*) FROM orders) AS total_sites,
              (SELECT count(DISTINCT site_id) FROM a) AS sites_with_datings
       FROM (SELECT unnest(range(0, {bins})) AS bin) b CROSS JOIN lim LEFT JOIN n USING (bin)"""


oracle("dat1_datings_histogram", _histogram(20, cap_first=False))
oracle("dat1_datings_histogram_with_max", _histogram(70, cap_first=True))
oracle("dat2_site_age_summary", _AGE_EXTREMES.format("older", "younger"))
oracle(
    "dat3_dataset_dating_span",
    """WITH c AS (
         SELECT dataset_id, entity_id, 'c14' AS type, 0 AS rank, CAST(trunc(c14_age_older) AS BIGINT) AS o,
                CAST(trunc(c14_age_younger) AS BIGINT) AS y
         FROM v_dating WHERE c14_age_older <> 0 AND c14_age_younger <> 0
         UNION ALL
         SELECT dataset_id, entity_id, 'cal', 1, CAST(trunc(cal_age_older) AS BIGINT),
                CAST(trunc(cal_age_younger) AS BIGINT)
         FROM v_dating WHERE cal_age_older <> 0 AND cal_age_younger <> 0
         UNION ALL
         SELECT dataset_id, entity_id, 'other', 2,
                CAST(trunc(age) AS BIGINT) - CAST(trunc(error_older) AS BIGINT),
                CAST(trunc(age) AS BIGINT) + CAST(trunc(error_younger) AS BIGINT)
         FROM v_dating WHERE age <> 0 AND error_older <> 0 AND error_younger <> 0),
       o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY o DESC, entity_id, rank) = 1),
       y AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY y, entity_id, rank) = 1)
       SELECT o.dataset_id, o.o AS older, o.type AS older_type, o.entity_id AS older_entity,
              y.y AS younger, y.type AS younger_type, y.entity_id AS younger_entity
       FROM o JOIN y USING (dataset_id)""",
)
_DENDRO = """g AS (SELECT * FROM v_range WHERE event_type = 'view' AND low_value <> 0
               QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY low_value, event_id) = 1),
       f AS (SELECT * FROM v_range WHERE event_type = 'purchase' AND high_value <> 0
               QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY high_value DESC, event_id) = 1),
       d AS (SELECT site_id, g.low_value AS age_older, g.dataset_id AS older_dataset_id,
                    g.event_id AS older_analysis_entity_id,
                    CASE WHEN g.low_value IS NOT NULL THEN 'dendro' END AS older_type,
                    f.high_value AS age_younger, f.dataset_id AS younger_dataset_id,
                    f.event_id AS younger_analysis_entity_id,
                    CASE WHEN f.high_value IS NOT NULL THEN 'dendro' END AS younger_type
             FROM g FULL JOIN f USING (site_id))"""
oracle("dat4_dendro_extremes", f"WITH {_DENDRO} SELECT * FROM d")
oracle(
    "dat5_site_time",
    f"""WITH {_DENDRO}
       SELECT c_custkey AS site_id, d.* EXCLUDE (site_id)
       FROM customer LEFT JOIN d ON d.site_id = c_custkey""",
)
oracle(
    "dat6_dendro_years_bp",
    f"""WITH {_DENDRO}
       SELECT site_id, age_older - 74 AS older_bp, age_younger - 74 AS younger_bp FROM d""",
)

# --- keyed variables ------------------------------------------------------------------

oracle(
    "den1_variable_counts",
    "SELECT value, count(*) AS n FROM v_value WHERE key = 'signup' GROUP BY 1",
)
oracle(
    "den2_variable_average_per_site",
    """SELECT site_id, avg(x) AS average, count(x) AS n, min(x) AS min, max(x) AS max
       FROM (SELECT site_id, try_cast(value AS DOUBLE) AS x FROM v_value WHERE key = 'error')
       GROUP BY 1""",
)
oracle(
    "den3_variable_categories_per_site",
    """WITH c AS (SELECT site_id, value, count(*) AS n FROM v_value WHERE key = 'signup' GROUP BY 1, 2)
       SELECT site_id, value, n,
              round(n / sum(n) OVER (PARTITION BY site_id) * 100, 2) AS percentage,
              CAST(sum(n) OVER (PARTITION BY site_id) AS BIGINT) AS total,
              count(*) OVER (PARTITION BY site_id) AS unique_values
       FROM c""",
)
oracle(
    "den4_variable_per_site",
    """WITH v AS (SELECT site_id, value, try_cast(value AS DOUBLE) AS x,
                         count(try_cast(value AS DOUBLE)) OVER (PARTITION BY site_id) AS numeric_n,
                         count(*) OVER (PARTITION BY site_id) AS total
                  FROM v_value WHERE key = 'click')
       SELECT site_id, 'numeric' AS kind, avg(x) AS average, CAST(NULL AS VARCHAR) AS value,
              max(numeric_n) AS n, max(total) AS total
       FROM v WHERE numeric_n > 0 GROUP BY site_id
       UNION ALL
       SELECT site_id, 'category', NULL, value, count(*), max(total)
       FROM v WHERE numeric_n = 0 GROUP BY site_id, value""",
)
oracle(
    "den5_value_class_listing",
    """SELECT DISTINCT CAST('0x' || substr(md5(event_type), 1, 15) AS BIGINT) AS value_class_id, event_type AS name,
              CAST(length(event_type) % 2 AS BIGINT) AS value_type_id,
              CAST(10 + 9 * (length(event_type) % 2) AS BIGINT) AS method_id
       FROM events""",
)

# --- search --------------------------------------------------------------------------

# One search term of one token: rank is weight times occurrences, r / (r + 1).
_TOKENS = "regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+')"


def _score(name: str, q: str, scores: tuple[float, float, float], weight: float) -> str:
    tf = f"len(list_filter({_TOKENS.format(name)}, lambda w: w = lower('{q}')))"
    exact, prefix, contains = (f"CAST({s} AS DOUBLE)" for s in scores)
    return f"""(CASE WHEN lower({name}) = lower('{q}') THEN {exact} ELSE 0 END
        + CASE WHEN lower({name}) LIKE lower('{q}%') THEN {prefix} ELSE 0 END
        + CASE WHEN {name} ILIKE '%{q}%' THEN {contains} ELSE 0 END
        + CAST({weight} AS DOUBLE) * {tf} / (CAST({weight} AS DOUBLE) * {tf} + 1))"""


def _phrase_score(name: str, q: str, scores: tuple[float, float, float], weight: float) -> str:
    """Score for a query of several tokens that occur at most once in a name."""
    tf = f"(CASE WHEN regexp_matches(lower({name}), '(^|[^a-z0-9])nation[^a-z0-9]+1($|[^a-z0-9])') THEN 1 ELSE 0 END)"
    exact, prefix, contains = (f"CAST({s} AS DOUBLE)" for s in scores)
    return f"""(CASE WHEN lower({name}) = lower('{q}') THEN {exact} ELSE 0 END
        + CASE WHEN lower({name}) LIKE lower('{q}%') THEN {prefix} ELSE 0 END
        + CASE WHEN {name} ILIKE '%{q}%' THEN {contains} ELSE 0 END
        + CAST({weight} AS DOUBLE) * {tf} / (CAST({weight} AS DOUBLE) * {tf} + 1))"""


def _flags(name: str, q: str, other: str | None = None) -> str:
    contains = f"{name} ILIKE '%{q}%'"
    token = f"list_contains({_TOKENS.format(name)}, lower('{q}'))"
    if other:
        contains = f"({contains} OR {other} ILIKE '%{q}%')"
        token = f"({token} OR list_contains({_TOKENS.format(other)}, lower('{q}')))"
    prefix = f"lower({name}) LIKE lower('{q}%')"
    return f"""lower({name}) = lower('{q}') AS is_exact,
        ({prefix} AND lower({name}) <> lower('{q}')) AS is_prefix,
        ({contains} AND NOT ({prefix})) AS is_contains,
        ({token} AND NOT ({contains})) AS is_fts_only,
        ({contains} OR {token}) AS _hit"""


def _page(hits: str, page: int, limit: int) -> str:
    return f"""WITH hits AS ({hits}),
       total AS (SELECT count(*) AS total_count FROM hits),
       page AS (SELECT * FROM hits ORDER BY score DESC, site_name, site_id
                LIMIT {limit} OFFSET {(page - 1) * limit})
       SELECT total_count, CAST(ceil(total_count / {limit}) AS BIGINT) AS total_pages,
              {page} < ceil(total_count / {limit}) AS has_more,
              site_id, site_name, matched_value, score, is_exact, is_prefix, is_contains,
              is_fts_only, sample_group_id, dataset_id, method_id
       FROM total LEFT JOIN page ON true"""


_NULL = "CAST(NULL AS BIGINT)"
SITE_SCORES, NAME_SCORES = (6.0, 3.0, 1.5), (4.5, 2.0, 1.2)


def _site_hits(q: str, where: str = "true") -> str:
    return f"""SELECT * FROM (
        SELECT c_custkey AS site_id, c_name AS site_name, c_name AS matched_value,
        round({_score("c_name", q, SITE_SCORES, 1.0)}, 6) AS score, {_flags("c_name", q)},
        {_NULL} AS sample_group_id, {_NULL} AS dataset_id, {_NULL} AS method_id
        FROM customer WHERE {where}) WHERE _hit AND score > 0"""


def _best(rows: str, item: str) -> str:
    return f"""SELECT * FROM ({rows}) WHERE _hit AND score > 0
        QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY score DESC, matched_value, {item}) = 1"""


oracle("srch1_sites", _page(_site_hits("customer"), 2, 20))
oracle("srch1_sites_contains", _page(_site_hits("00000012"), 1, 50))
_GROUP_ROWS = f"""SELECT g.site_id, c.c_name AS site_name,
        trim(concat_ws(' ', sample_group_name, sample_group_description)) AS matched_value,
        round({_score("sample_group_name", "medium", NAME_SCORES, 0.4)}
              + CASE WHEN sample_group_description ILIKE '%medium%' THEN 0.6 ELSE 0 END, 6) AS score,
        {_flags("sample_group_name", "medium", "sample_group_description")},
        g.sample_group_id, {_NULL} AS dataset_id, {_NULL} AS method_id
        FROM v_group g JOIN customer c ON c.c_custkey = g.site_id"""
oracle("srch2_sample_groups", _page(_best(_GROUP_ROWS, "sample_group_id"), 1, 50))
oracle("srch6_counted_page_of_groups", _page(_best(_GROUP_ROWS, "sample_group_id"), 2, 30))
oracle("srch6_counted_page", _page(_site_hits("customer"), 4, 7))
_DATASET_ROWS = f"""SELECT d.site_id, c.c_name AS site_name, s_name AS matched_value,
        round({_score("s_name", "supplier", NAME_SCORES, 0.4)}, 6) AS score,
        {_flags("s_name", "supplier")},
        {_NULL} AS sample_group_id, d.dataset_id, {_NULL} AS method_id
        FROM v_site_dataset d JOIN supplier s ON s.s_suppkey = d.dataset_id
        JOIN customer c ON c.c_custkey = d.site_id"""
oracle("srch3_datasets", _page(_best(_DATASET_ROWS, "dataset_id"), 1, 50))
_LINKS = """SELECT site_id, d.method_id, method_name FROM v_site_dataset d JOIN v_method USING (method_id)
        UNION SELECT site_id, g.method_id, sample_group_name FROM v_group g"""


def _method_rows(q: str, links: str, score: str) -> str:
    return f"""SELECT k.site_id, c.c_name AS site_name, method_name AS matched_value,
        round({score}, 6) AS score, {_flags("method_name", q)},
        {_NULL} AS sample_group_id, {_NULL} AS dataset_id, k.method_id
        FROM ({links}) k JOIN customer c ON c.c_custkey = k.site_id"""


oracle(
    "srch4_methods",
    _page(
        _best(
            _method_rows(
                "NATION_1", _LINKS, _phrase_score("method_name", "NATION_1", NAME_SCORES, 0.4)
            ),
            "method_id",
        ),
        1,
        50,
    ),
)
oracle(
    "srch4_methods_with_sampling",
    _page(
        _best(
            _method_rows("urgent", _LINKS, _score("method_name", "urgent", NAME_SCORES, 0.4)),
            "method_id",
        ),
        3,
        20,
    ),
)
oracle(
    "srch5_sites_in_domain",
    _page(
        _site_hits(
            "customer", "c_custkey IN (SELECT site_id FROM v_entity WHERE method_id IN (3, 6))"
        ),
        1,
        50,
    ),
)
oracle(
    "srch5_methods_in_record_type_domain",
    _page(
        _best(
            _method_rows(
                "nation",
                """SELECT DISTINCT site_id, d.method_id, method_name FROM v_site_dataset d
                   JOIN v_method m USING (method_id) JOIN region ON r_regionkey = m.record_type_id
                   WHERE r_name = 'ASIA'""",
                _score("method_name", "nation", NAME_SCORES, 0.4),
            ),
            "method_id",
        ),
        1,
        50,
    ),
)
oracle("srch1_sites_backslash", _page(_site_hits("customer%1"), 1, 20))
oracle("srch6_page_past_the_end", _page(_site_hits("customer"), 1_000_000_000, 1))
_WORD_COUNT = "len(list_filter({0}, lambda w: list_contains({1}, w)))"


def _weighted(texts: str, words: str, names: str, also: str = "true") -> str:
    tokens = _TOKENS.format("strip_accents(text)")
    hits = _WORD_COUNT.format(tokens, words)
    also = also.format(tokens)
    return f"""WITH texts AS ({texts}),
       s AS (SELECT site_id, CAST(sum(weight * {hits}) AS BIGINT) AS score FROM texts GROUP BY 1
             HAVING sum(weight * {hits}) > 0 AND {also} ORDER BY score DESC, site_id LIMIT 50)
       SELECT s.site_id, n.site_name, s.score FROM s LEFT JOIN ({names}) n USING (site_id)"""


_SITE_TEXTS = """SELECT c_custkey AS site_id, 10 AS weight, c_name AS text FROM customer
         UNION ALL SELECT c_custkey, 5, 'Segment ' || lower(c_mktsegment) FROM customer
         UNION ALL SELECT c_custkey, 2, c_mktsegment FROM customer
         UNION ALL SELECT c_custkey, 5, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey
         UNION ALL SELECT c_custkey, 5, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey
                   JOIN region ON r_regionkey = n_regionkey
         UNION ALL SELECT c_custkey, 10, 'Work ' || (c_custkey % 150) FROM customer
         UNION ALL SELECT site_id, 10, s_name FROM v_site_dataset JOIN supplier ON s_suppkey = dataset_id
         UNION ALL SELECT DISTINCT site_id, 5, n_name FROM v_site_dataset
                   JOIN nation ON n_nationkey = method_id
         UNION ALL SELECT DISTINCT o_custkey, 5, o_orderpriority FROM orders
         UNION ALL SELECT site_id, 2, unnest(['Work ' || biblio_id,
                          CASE WHEN filled > 1 THEN 'y' || biblio_id END,
                          CASE WHEN filled > 2 THEN 'a' || biblio_id END]) FROM (
                   SELECT site_id, biblio_id, max(filled) AS filled FROM (
                     SELECT c_custkey AS site_id, c_custkey % 150 AS biblio_id, 1 AS filled FROM customer
                     UNION ALL SELECT o_custkey, o_orderkey % 170, 2 FROM orders
                     UNION ALL SELECT site_id, dataset_id % 200, 3 FROM v_site_dataset) GROUP BY 1, 2)
         UNION ALL (SELECT DISTINCT site_id, 5, unnest([family_name, genus_name, order_name])
                    FROM v_entity JOIN v_taxonomy USING (taxon_id))
         UNION ALL (SELECT DISTINCT site_id, 2, 'Element ' || l_returnflag FROM v_entity)
         UNION ALL (SELECT DISTINCT site_id, 2, l_linestatus FROM v_entity WHERE l_returnflag = 'R')
         UNION ALL SELECT site_id, 8, l_linestatus FROM v_entity
         UNION ALL SELECT c_custkey, 5, (SELECT string_agg(r_name, ' ') FROM region) FROM customer"""
_SITE_NAMES = "SELECT c_custkey AS site_id, c_name AS site_name FROM customer"
oracle("srch7_free_text", _weighted(_SITE_TEXTS, "['furniture', 'nation']", _SITE_NAMES))
oracle(
    "srch7_free_text_negated",
    _weighted(_SITE_TEXTS, "['furniture', 'machinery']", _SITE_NAMES, "NOT bool_or(list_contains({0}, 'asia'))"),
)
oracle(
    "srch7_free_text_phrase",
    _weighted(
        _SITE_TEXTS,
        "['segment', 'furniture', 'nation']",
        _SITE_NAMES,
        "bool_or(regexp_matches(lower(text), '(^|[^a-z0-9])segment[^a-z0-9]+furniture($|[^a-z0-9])'))",
    ),
)
oracle("srch7_free_text_accents", _weighted(_SITE_TEXTS, "['furniture', 'nation']", _SITE_NAMES))
oracle(
    "srch7_free_text_in_lookups",
    _weighted(_SITE_TEXTS, "['asia', 'brand', 'element', 'f', 'y7', 'high']", _SITE_NAMES),
)
oracle(
    "srch7_free_text_whole_documents",
    _weighted(
        "SELECT doc_id AS site_id, 5 AS weight, text FROM documents",
        "['nation', 'que', 'the']",
        "SELECT doc_id AS site_id, concat_ws(' ', source, lang) AS site_name FROM documents",
    ),
)
_FOLLOW = "bool_or(regexp_matches(lower(strip_accents(text)), '(^|[^\\p{{{{L}}}}\\p{{{{N}}}}]){0}[^\\p{{{{L}}}}\\p{{{{N}}}}]+{1}($|[^\\p{{{{L}}}}\\p{{{{N}}}}])'))"
oracle(
    "srch7_free_text_indexed",
    _weighted(
        "SELECT doc_id AS site_id, 5 AS weight, text FROM documents",
        "['the', 'in', 'que', 'la']",
        "SELECT doc_id AS site_id, concat_ws(' ', source, lang) AS site_name FROM documents",
        f"""{_FOLLOW.format("que", "la")} AND NOT {_FOLLOW.format("de", "que")}
            AND NOT bool_or(list_contains({{0}}, 'zanzibar'))""",
    ),
)


def _covered_documents(q: str, alternatives: list[list[str]]) -> str:
    """Hits among whole documents: the begin of the last run at every entry by running maxima; a cover where it moves."""
    words = sorted({w for terms in alternatives for w in terms})
    last = ", ".join(f"max(k) FILTER (WHERE token = '{w}') OVER w AS last_{w}" for w in words)
    begins = [f"CASE WHEN {' AND '.join(f'last_{w} IS NOT NULL' for w in a)} THEN least({', '.join(f'last_{w}' for w in a)}) END" for a in alternatives]
    held = " OR ".join("(" + " AND ".join(f"list_contains(words, '{w}')" for w in a) + ")" for a in alternatives)
    return f"""SELECT * FROM (
        SELECT doc_id AS site_id, text AS site_name, text AS matched_value,
        round(CASE WHEN lower(text) = lower('{q}') THEN 6.0::DOUBLE ELSE 0 END + CASE WHEN lower(text) LIKE lower('{q}%') THEN 3.0::DOUBLE ELSE 0 END
              + CASE WHEN text ILIKE '%{q}%' THEN 1.5::DOUBLE ELSE 0 END + coalesce(covers, 0) / (coalesce(covers, 0) + 1), 6) AS score,
        lower(text) = lower('{q}') AS is_exact, lower(text) LIKE lower('{q}%') AND lower(text) <> lower('{q}') AS is_prefix,
        text ILIKE '%{q}%' AND NOT lower(text) LIKE lower('{q}%') AS is_contains,
        coalesce(({held}), false) AND NOT text ILIKE '%{q}%' AS is_fts_only, text ILIKE '%{q}%' OR coalesce(({held}), false) AS _hit,
        {_NULL} AS sample_group_id, {_NULL} AS dataset_id, {_NULL} AS method_id
        FROM documents LEFT JOIN (
            SELECT doc_id, sum(1.0::DOUBLE / (1 + e.pos - b.pos - (e.k - e.b))) AS covers
            FROM (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY k) AS earlier FROM (
                      SELECT doc_id, k, pos, greatest({", ".join(begins)}) AS b FROM (
                          SELECT *, {last} FROM entries WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING)))) e
            JOIN (SELECT doc_id, k AS b, pos FROM entries) b USING (doc_id, b)
            WHERE e.b IS NOT NULL AND (e.earlier IS NULL OR e.b > e.earlier) GROUP BY doc_id
        ) USING (doc_id) LEFT JOIN (SELECT doc_id, list(DISTINCT token) AS words FROM entries GROUP BY doc_id) USING (doc_id)
        WHERE text IS NOT NULL) WHERE _hit AND score > 0"""


def _covered_page(q: str, alternatives: list[list[str]]) -> str:
    words = ", ".join(f"'{w}'" for terms in alternatives for w in terms)
    entries = f"""entries AS MATERIALIZED (
        SELECT doc_id, token, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM (
            SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (
                SELECT doc_id, list_filter({_TOKENS.format("text")}, lambda w: w <> '') AS t FROM documents)) WHERE token IN ({words}))"""
    return _page(_covered_documents(q, alternatives), 1, 50).replace("WITH hits AS", f"WITH {entries}, hits AS", 1)


oracle("srch1_two_terms", _covered_page("the of", [["the", "of"]]))
oracle("srch1_three_terms", _covered_page("of the and", [["of", "the", "and"]]))
oracle("srch1_alternatives", _covered_page("que la or the of", [["que", "la"], ["the", "of"]]))
oracle("srch1_sites_indexed", _page(_site_hits("00000012"), 1, 50))
oracle("srch2_sample_groups_indexed", _page(_best(_GROUP_ROWS, "sample_group_id"), 1, 50))
oracle(
    "qry1_collection_equal",
    "SELECT DISTINCT site_id AS id FROM v_site_dataset WHERE method_id = 3",
)
oracle(
    "qry1_collection_not",
    """SELECT c_custkey AS id FROM customer
       WHERE c_custkey NOT IN (SELECT site_id FROM v_site_dataset WHERE method_id = 3)""",
)
oracle(
    "src3_collection_projection",
    "SELECT c_custkey AS site_id, c_name AS site_name, c_acctbal / 100 AS latitude_dd FROM customer WHERE c_custkey < 400 AND c_custkey % 3 = 1",
)
oracle(
    "flt1_many_sites",
    "SELECT site_id, count(*) AS n FROM v_entity WHERE site_id % 3 = 1 AND site_id < 3000000 GROUP BY site_id",
)
oracle(
    "qry1_search_sites_equal",
    "SELECT DISTINCT site_id AS id FROM v_site_dataset WHERE method_id = 3",
)
oracle(
    "qry1_search_sites_not",
    """SELECT c_custkey AS id FROM customer
       WHERE c_custkey NOT IN (SELECT site_id FROM v_site_dataset WHERE method_id = 3)""",
)
oracle(
    "qry1_search_sites_greater",
    """SELECT DISTINCT g.site_id AS id FROM lineitem JOIN v_group g ON g.sample_group_id = l_orderkey
       WHERE l_tax > 0.04 AND l_extendedprice > 90000""",
)
oracle(
    "qry1_search_sites_text",
    "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P'",
)
oracle("qry2_search_taxa", "SELECT DISTINCT taxon_id AS id FROM v_word WHERE word = 'anvil'")
oracle("qry2_search_taxa_not", "SELECT p_partkey AS id FROM part WHERE p_size <> 12")

# --- data groups ---------------------------------------------------------------------


def _value_row(kind: str, key: str, text: str, number: str, value_type: str) -> str:
    return f"""'{kind}' AS type, CAST(dataset_id AS VARCHAR) AS data_group_id, dataset_id,
        sample_id AS physical_sample_id, entity_id AS analysis_entity_id, method_id,
        {key} AS key, {text} AS value_string, {number} AS value_double, '{value_type}' AS value_type"""


_TEXT, _NUMBER = "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)"
_ABUNDANCE = f"""SELECT site_id, {_value_row("abundance", "CAST(sample_id AS VARCHAR)", _TEXT,
                 "CAST(abundance AS DOUBLE)", "complex")}
       FROM v_entity WHERE method_id IN (3, 6, 8, 15, 40, 111)"""
oracle("grp1_abundance_values", _ABUNDANCE)
oracle(
    "grp1_abundance_details",
    """SELECT site_id, method_id, entity_id AS abundance_id, taxon_id, abundance,
              CASE WHEN l_linestatus = 'F' THEN 'level ' || l_linenumber ELSE '' END AS levels,
              CASE WHEN l_returnflag = 'R' THEN l_linestatus ELSE '' END AS modifications
       FROM v_entity WHERE method_id IN (3, 6, 8, 15, 40, 111)""",
)


def _dating_field(name: str, lab: bool, text: bool = False) -> str:
    return f"""SELECT site_id, {_value_row("dating", f"'{name}'", name if text else _TEXT,
               _NUMBER if text else name, "complex")} FROM dated WHERE is_lab = {str(lab).lower()}"""


_DATED = """dated AS (SELECT d.*, g.site_id, CAST(s.s_nationkey AS BIGINT) AS method_id
            FROM v_dating d JOIN v_group g USING (sample_group_id)
            JOIN supplier s ON s.s_suppkey = d.dataset_id WHERE s.s_nationkey IN (1, 7, 12))"""
_DATING = " UNION ALL ".join(
    [_dating_field(n, False) for n in ("c14_age_older", "c14_age_younger", "cal_age_older", "cal_age_younger")]
    + [_dating_field(n, True) for n in ("age", "error_older", "error_younger")]
    + [_dating_field("dating_lab_id", True, text=True)]
)
oracle("grp2_dating_values", f"WITH {_DATED} {_DATING}")


def _age_field(name: str, text: bool = False) -> str:
    present = f"{name} <> ''" if text else f"{name} <> 0"
    return f"""SELECT site_id, {_value_row("dating", f"'{name}'", name if text else _TEXT,
               _NUMBER if text else name, "simple")} FROM aged WHERE {present}"""


_AGED = """aged AS (SELECT a.*, CAST(s.s_nationkey AS BIGINT) AS method_id
            FROM v_age a JOIN supplier s ON s.s_suppkey = a.dataset_id WHERE s.s_nationkey IN (1, 7, 12))"""
_AGES = " UNION ALL ".join(
    [_age_field(n) for n in ("age", "age_older", "age_younger", "chronology_id")]
    + [_age_field("dating_specifier", text=True)]
)
oracle("grp3_entity_age_values", f"WITH {_AGED} {_AGES}")
# Of the 46 methods of the family the sample has number 14, which is not a laboratory one; of its method groups number 3.
_OF_FAMILY = ("s.s_nationkey IN (1, 7, 12)", "s.s_nationkey = 14")
_FAMILY_DATED, _FAMILY_AGED = _DATED.replace(*_OF_FAMILY), _AGED.replace(*_OF_FAMILY)
oracle("grp2_dating_values_of_the_family", f"WITH {_FAMILY_DATED} {_DATING}")
oracle("grp3_entity_ages_of_the_family", f"WITH {_FAMILY_AGED} {_AGES}")
oracle(
    "grp4_group_headers",
    f"""WITH {_DATED}, {_AGED}, v AS ({_DATING} UNION ALL {_AGES})
       SELECT site_id, type, data_group_id,
              CASE WHEN count(DISTINCT analysis_entity_id) = 1 THEN max(analysis_entity_id) END AS analysis_entity_id,
              CASE WHEN count(DISTINCT physical_sample_id) = 1 THEN max(physical_sample_id) END AS physical_sample_id,
              count(*) AS n,
              count(DISTINCT nullif(dataset_id % 200, 0)) AS biblio_count,
              min(nullif(dataset_id % 200, 0)) AS first_biblio_id
       FROM v GROUP BY 1, 2, 3""",
)
oracle(
    "grp4_group_references",
    f"""WITH {_DATED}, {_AGED}, v AS ({_DATING} UNION ALL {_AGES})
       SELECT DISTINCT site_id, type, data_group_id, CAST(dataset_id % 200 AS BIGINT) AS biblio_id
       FROM v WHERE dataset_id % 200 <> 0""",
)
_MEASURED = f"""SELECT site_id, {_value_row(
        "measured_values", "CAST(sample_id AS VARCHAR)",
        "CASE WHEN l_linenumber = 6 THEN '<' || abundance END",
        "CASE WHEN l_linenumber <> 6 THEN CAST(abundance AS DOUBLE) END", "simple")},
        CASE l_linenumber WHEN 7 THEN abundance || ' mm' WHEN 6 THEN '<' || abundance
             ELSE CAST(abundance AS VARCHAR) END AS data
       FROM v_entity WHERE method_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"""
oracle("grp5_measured_values", _MEASURED)
_ISOTOPE = f"""SELECT site_id, {_value_row("isotope", "CAST(sample_id AS VARCHAR)",
        "CAST(abundance AS VARCHAR)", _NUMBER, "complex")}, n_name AS data
       FROM v_entity JOIN nation ON n_nationkey = l_linenumber WHERE method_id IN (4, 9)"""
oracle("grp6_isotopes", _ISOTOPE)
_CERAMIC = f"""SELECT g.site_id, 'ceramic' AS type, CAST(sample_id AS VARCHAR) AS data_group_id,
              l_suppkey AS dataset_id, sample_id AS physical_sample_id, entity_id AS analysis_entity_id,
              CAST(17 + l_linenumber % 2 AS BIGINT) AS method_id, 'Attribute ' || l_linenumber AS key, l_returnflag AS value_string,
              {_NUMBER} AS value_double, 'simple' AS value_type
       FROM v_line JOIN v_group g ON g.sample_group_id = l_orderkey
       WHERE g.site_id IN (SELECT site_id FROM v_entity WHERE method_id IN (17, 18))"""
oracle("grp7_ceramics", _CERAMIC)


def _ranged(kind: str, bound: str, method: int) -> str:
    return f"""SELECT v.site_id, '{kind}' AS type, CAST(sample_id AS VARCHAR) AS data_group_id,
              v.dataset_id, sample_id AS physical_sample_id,
              CAST(v.event_id AS VARCHAR) AS analysis_entity_id, CAST(10 AS BIGINT) AS method_id, key,
              value AS value_string, {_NUMBER} AS value_double,
              CASE WHEN coalesce(low_value, 0) <> 0 OR coalesce(high_value, 0) <> 0
                   THEN 'complex' ELSE 'simple' END AS value_type,
              CAST(r.{bound} AS VARCHAR) AS data
       FROM v_value v LEFT JOIN v_range r USING (event_id)
       WHERE v.site_id IN (SELECT site_id FROM v_entity WHERE method_id = {method})"""


oracle("grp8_adna_values", _ranged("adna", "low_value", 19))
oracle("grp9_dendro_values", _ranged("dendro", "high_value", 10))
oracle(
    "grp10_value_classes_used",
    """SELECT DISTINCT CAST('0x' || substr(md5(event_type), 1, 15) AS BIGINT) AS value_class_id, event_type AS name,
              CAST(length(event_type) % 2 AS BIGINT) AS value_type_id,
              CAST(10 + 9 * (length(event_type) % 2) AS BIGINT) AS method_id
       FROM events""",
)
oracle(
    "grp10_value_classes_of_method",
    """SELECT DISTINCT CAST('0x' || substr(md5(event_type), 1, 15) AS BIGINT) AS value_class_id, event_type AS name,
              CAST(0 AS BIGINT) AS value_type_id, CAST(10 AS BIGINT) AS method_id
       FROM events WHERE length(event_type) % 2 = 0""",
)
oracle(
    "grp11_dating_uncertainties",
    """SELECT CAST(r_regionkey AS BIGINT) AS dating_uncertainty_id, r_name AS description
       FROM region WHERE r_regionkey IN (
         SELECT event_id % 4 FROM events WHERE event_type IN ('view', 'purchase'))""",
)
oracle(
    "grp12_dendro_sites",
    f"""SELECT site_id, sample_id AS physical_sample_id, value_class_id, key, value AS value_string,
              'measurement' AS kind, {_NULL} AS low_value, {_NULL} AS high_value FROM v_value
       UNION ALL
       SELECT DISTINCT v.site_id, v.sample_id, v.value_class_id, v.key, v.value, 'date',
              r.low_value, r.high_value FROM v_value v JOIN v_range r USING (event_id)""",
)
oracle(
    "grp13_family_sites",
    """SELECT DISTINCT 'abundance' AS family, site_id FROM v_entity WHERE method_id IN (3, 6, 8, 15, 40, 111)
       UNION ALL
       SELECT DISTINCT 'dating', site_id FROM v_entity JOIN v_method USING (method_id)
       WHERE method_id = 14 OR method_group_id IN (19, 20, 3)
       UNION ALL
       SELECT DISTINCT 'measured_values', site_id FROM v_entity JOIN v_method USING (method_id)
       WHERE method_group_id = 2
       UNION ALL SELECT DISTINCT 'dendro', site_id FROM v_entity WHERE method_id = 10""",
)
oracle(
    "grp14_abundance_lookups",
    """SELECT DISTINCT site_id, 'abundance_element' AS kind, CAST(ascii(l_returnflag) AS BIGINT) AS id,
              'Element ' || l_returnflag AS name FROM v_entity
       UNION ALL
       SELECT DISTINCT site_id, 'modification_type', CAST(ascii(l_linestatus) AS BIGINT), l_linestatus
       FROM v_entity WHERE l_returnflag = 'R'""",
)
oracle(
    "grp15_dating_labs",
    """SELECT DISTINCT site_id, CAST(l_linenumber AS BIGINT) AS dating_lab_id,
              'Lab ' || n_name AS lab_name
       FROM v_entity JOIN nation ON n_nationkey = l_linenumber WHERE l_returnflag = 'N'""",
)
_COMMON = """site_id, type, data_group_id, value_type"""
oracle(
    "grp_all_families",
    f"""WITH {_DATED}, {_AGED}, v AS (
         SELECT {_COMMON} FROM ({_ABUNDANCE}) UNION ALL SELECT {_COMMON} FROM ({_DATING}) UNION ALL SELECT {_COMMON} FROM ({_AGES})
         UNION ALL SELECT {_COMMON} FROM ({_MEASURED}) UNION ALL SELECT {_COMMON} FROM ({_CERAMIC})
         UNION ALL SELECT {_COMMON} FROM ({_ranged("adna", "low_value", 19)})
         UNION ALL SELECT {_COMMON} FROM ({_ranged("dendro", "low_value", 10)})
         UNION ALL SELECT {_COMMON} FROM ({_ISOTOPE}))
       SELECT type, value_type, count(*) AS n, count(DISTINCT site_id) AS sites,
              count(DISTINCT data_group_id) AS groups
       FROM v GROUP BY 1, 2""",
)
oracle(
    "grp13_gated_data_groups",
    f"""WITH {_FAMILY_DATED}, {_FAMILY_AGED}, v AS (
         SELECT {_COMMON} FROM ({_ABUNDANCE}) UNION ALL SELECT {_COMMON} FROM ({_DATING}) UNION ALL SELECT {_COMMON} FROM ({_AGES})
         UNION ALL SELECT {_COMMON} FROM ({_MEASURED}) UNION ALL SELECT {_COMMON} FROM ({_ranged("dendro", "low_value", 10)}))
       SELECT type, site_id, count(*) AS n FROM v
       WHERE type <> 'dating' OR site_id IN (SELECT site_id FROM v_entity JOIN v_method USING (method_id) WHERE method_id = 14 OR method_group_id = 3)
       GROUP BY 1, 2""",
)

# --- documents -----------------------------------------------------------------------

oracle(
    "doc1_site_documents_entities",
    """SELECT site_id, dataset_id, entity_id AS analysis_entity_id, sample_id AS physical_sample_id,
              sample_group_id,
              (l_linenumber + 300) || ',' || (ascii(l_returnflag) + 300) AS prep_methods
       FROM v_entity""",
)
oracle(
    "doc1_site_documents_samples",
    """SELECT g.site_id, s.sample_group_id, s.physical_sample_id, s.sample_type_name,
              strftime(s.day, '%Y-%m-%d') AS date_sampled, n.features, n.coordinates
       FROM v_sample s JOIN v_group g USING (sample_group_id)
       JOIN (SELECT sample_id, count(*) AS features, count(*) FILTER (l_tax > 0.04) AS coordinates
             FROM v_line GROUP BY 1) n ON n.sample_id = s.physical_sample_id""",
)
oracle(
    "doc1_site_documents_in_parts",
    """SELECT c_custkey AS site_id, c_name AS site_name, CAST(2 AS BIGINT) AS locations,
              coalesce(e.d, 0) AS datasets, coalesce(e.n, 0) AS entities, coalesce(e.s, 0) AS samples,
              CAST(0 AS BIGINT) AS misplaced
       FROM customer LEFT JOIN (SELECT site_id, count(*) AS n, count(DISTINCT sample_id) AS s,
                                       count(DISTINCT dataset_id) AS d
                                FROM v_entity GROUP BY 1) e ON e.site_id = c_custkey""",
)
oracle(
    "doc2_sample_group_children",
    """SELECT o_custkey AS site_id, o_orderkey AS sample_group_id,
              CAST(substr(o_orderpriority, 1, 1) AS BIGINT) + 100 AS method_id,
              o_orderstatus AS description, o_orderkey % 170 AS biblio_id, coalesce(n.n, 0) AS samples
       FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) n
       ON n.l_orderkey = o_orderkey""",
)
oracle(
    "doc3_sample_children",
    """SELECT sample_id AS physical_sample_id, l_suppkey AS feature_id,
              CAST(ascii(l_linestatus) AS BIGINT) AS feature_type_id, l_linestatus AS feature_type_name
       FROM v_line""",
)
oracle(
    "doc4_entity_prep_methods",
    """SELECT DISTINCT entity_id AS analysis_entity_id, unnest([CAST(l_linenumber + 300 AS BIGINT),
              CAST(ascii(l_returnflag) + 300 AS BIGINT)]) AS method_id
       FROM v_line""",
)
oracle(
    "doc5_site_datasets",
    """SELECT e.site_id, e.dataset_id, s.s_name AS dataset_name, e.method_id,
              e.dataset_id % 7 AS project_id, count(*) AS entities
       FROM v_entity e JOIN supplier s ON s.s_suppkey = e.dataset_id GROUP BY ALL""",
)
oracle(
    "doc6_site_locations_and_references",
    """SELECT c_custkey AS site_id, c_name AS site_name, c_mktsegment AS national_site_identifier,
              n_name || ',' || r_name AS locations, 'Work ' || (c_custkey % 150) AS "references"
       FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
)
_LOOKUP_ROWS = """SELECT DISTINCT site_id, 'method' AS kind, method_id AS id FROM v_site_dataset
       UNION SELECT site_id, 'method', method_id FROM v_group
       UNION SELECT site_id, 'unit', n_regionkey + 10 FROM v_site_dataset JOIN nation ON n_nationkey = method_id
       UNION SELECT site_id, 'prep_method', l_linenumber + 300 FROM v_entity
       UNION SELECT site_id, 'prep_method', ascii(l_returnflag) + 300 FROM v_entity
       UNION SELECT g.site_id, 'dimension', l_linenumber FROM lineitem
             JOIN v_group g ON g.sample_group_id = l_orderkey WHERE l_tax > 0.04
       UNION SELECT g.site_id, 'method', 201 FROM lineitem
             JOIN v_group g ON g.sample_group_id = l_orderkey WHERE l_tax > 0.04
       UNION SELECT site_id, unnest(['dimension', 'method', 'unit']),
                    unnest([l_linenumber, l_linenumber + 210, n_regionkey + 20])
             FROM v_entity JOIN nation ON n_nationkey = l_linenumber
       UNION SELECT site_id, unnest(['horizon', 'method']), unnest([dataset_id % 8, dataset_id % 8 + 220])
             FROM v_entity WHERE dataset_id % 8 < 5
       UNION SELECT o_custkey, unnest(['dimension', 'method', 'unit']),
                    unnest([c.n_nationkey % 9, c.n_regionkey + 230, d.n_regionkey + 20])
             FROM orders JOIN nation c ON c.n_nationkey = o_orderkey % 30 JOIN nation d ON d.n_nationkey = c.n_nationkey % 9
       UNION SELECT site_id, 'contact', unnest([dataset_id % 5, dataset_id % 7]) FROM v_site_dataset"""
oracle("doc7_site_lookups", _LOOKUP_ROWS)
oracle("doc1_site_lookup_tables", _LOOKUP_ROWS)
oracle(
    "doc7_site_lookup_tables",
    """SELECT *, true AS described FROM (
         SELECT DISTINCT site_id, 'biblio' AS kind, biblio_id AS id, 'Work ' || biblio_id AS name FROM (
           SELECT c_custkey AS site_id, c_custkey % 150 AS biblio_id FROM customer
           UNION ALL SELECT site_id, sample_group_id % 170 FROM v_group UNION ALL SELECT site_id, dataset_id % 200 FROM v_site_dataset)
         UNION ALL SELECT DISTINCT site_id, 'taxon', taxon_id, genus_name || ' ' || species FROM v_entity JOIN v_taxonomy USING (taxon_id)
         UNION ALL SELECT DISTINCT site_id, 'abundance_element', CAST(ascii(l_returnflag) AS BIGINT), 'Element ' || l_returnflag FROM v_entity
         UNION ALL SELECT DISTINCT site_id, 'modification_type', CAST(ascii(l_linestatus) AS BIGINT), l_linestatus FROM v_entity WHERE l_returnflag = 'R'
         UNION ALL SELECT DISTINCT site_id, 'dating_lab', CAST(l_linenumber AS BIGINT), 'Lab ' || n_name
                   FROM v_entity JOIN nation ON n_nationkey = l_linenumber WHERE l_returnflag = 'N'
         UNION ALL SELECT DISTINCT user_id, 'dating_uncertainty', event_id % 4, r_name FROM events JOIN region ON r_regionkey = event_id % 4
                   WHERE event_type IN ('view', 'purchase', 'click')
         UNION ALL SELECT DISTINCT user_id, 'value_class', CAST('0x' || substr(md5(event_type), 1, 15) AS BIGINT), event_type FROM events
         UNION ALL SELECT DISTINCT site_id, 'isotope_measurement', CAST(l_linenumber AS BIGINT), n_name FROM v_entity JOIN nation ON n_nationkey = l_linenumber
         UNION ALL SELECT c_custkey, 'domain', CAST(r_regionkey AS BIGINT), r_name FROM customer, region
                   WHERE r_regionkey IN (SELECT n_regionkey FROM nation))""",
)
oracle(
    "doc8_site_biblio_lookup",
    """WITH r AS (
         SELECT c_custkey AS site_id, c_custkey % 150 AS biblio_id, 1 AS filled, 0 AS source FROM customer
         UNION ALL SELECT site_id, sample_group_id % 170, 2, 1 FROM v_group
         UNION ALL SELECT site_id, dataset_id % 200, 3, 2 FROM v_site_dataset),
       b AS (SELECT site_id, biblio_id, max(filled) AS filled FROM r GROUP BY 1, 2)
       SELECT site_id, biblio_id, 'Work ' || biblio_id AS title,
              CASE WHEN filled > 1 THEN 'y' || biblio_id END AS year,
              CASE WHEN filled > 2 THEN 'a' || biblio_id END AS authors
       FROM b""",
)
_DOMAINS = """SELECT CAST(r_regionkey AS BIGINT) AS domain_id, lower(r_name) AS code, r_name AS title,
              string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS method_ids
       FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2, 3"""
oracle("doc9_domains", _DOMAINS)
oracle("doc9_domains_digit_runs", _DOMAINS)
oracle(
    "doc10_entities_by_dataset",
    """SELECT l_suppkey AS dataset_id, count(*) AS entities, min(sample_id) AS first_sample,
              max(sample_id) AS last_sample
       FROM v_line GROUP BY 1""",
)
oracle(
    "doc11_sample_group_datasets",
    "SELECT DISTINCT l_orderkey AS sample_group_id, l_suppkey AS dataset_id FROM lineitem",
)
oracle(
    "doc11_document_dataset_links",
    """SELECT o_custkey AS site_id, o_orderkey AS sample_group_id, coalesce(d.ids, '') AS dataset_ids
       FROM orders LEFT JOIN (
         SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS ids
         FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY 1) d
       ON d.l_orderkey = o_orderkey""",
)
oracle(
    "doc12_taxon_documents",
    """SELECT t.taxon_id, t.species, t.genus_name, t.family_name, t.order_name,
              CASE WHEN p_size % 9 <> 0 THEN 'Author ' || (p_size % 9) END AS author_name,
              array_to_string(list_sort(string_split(p_name, ' ')), ',') AS common_names,
              CASE WHEN p_size > 25 THEN lower(p_type) ELSE '' END AS notes,
              CAST(p_size AS DOUBLE) AS size
       FROM v_taxonomy t JOIN part p ON p.p_partkey = t.taxon_id""",
)
oracle(
    "doc13_ecocode_tree",
    """SELECT taxon_id, CAST(CASE WHEN group_id < 2 THEN 2 ELSE 3 END AS BIGINT) AS ecocode_system_id,
              group_id AS ecocode_group_id, r_name AS group_name,
              string_agg(word, ',' ORDER BY definition_id) AS codes
       FROM v_code JOIN region ON r_regionkey = group_id GROUP BY 1, 2, 3, 4""",
)
oracle(
    "doc14_analysis_values",
    """SELECT site_id, event_id AS analysis_value_id, key, value, key AS class_name, value_type_id
       FROM v_value""",
)
oracle(
    "doc15_datasets_extract",
    """SELECT site_id, dataset_id, method_id, entity_id AS analysis_entity_id,
              sample_id AS physical_sample_id, concat_ws('/', sample_group_id, l_linenumber) AS sample_name,
              CASE WHEN l_linenumber <> 6 THEN CAST(abundance AS DOUBLE) END AS measured_value
       FROM v_entity WHERE method_id IN (3, 5)""",
)
_GROUP_COLUMNS = """site_id, type, data_group_id, dataset_id, physical_sample_id, analysis_entity_id,
              method_id, key, value_string, value_double, value_type"""
oracle(
    "doc16_data_groups_extract",
    f"""SELECT {_GROUP_COLUMNS} FROM ({_MEASURED}) WHERE method_id IN (6, 12)
       UNION ALL SELECT {_GROUP_COLUMNS} FROM ({_ABUNDANCE}) WHERE method_id IN (6, 12)""",
)
oracle(
    "doc17_sample_datasets",
    """SELECT sample_id AS physical_sample_id, dataset_id, s_name AS dataset_name, method_id,
              entity_id AS analysis_entity_id
       FROM v_entity JOIN supplier ON s_suppkey = dataset_id""",
)

# --- exports ----------------------------------------------------------------------------

oracle(
    "src4_site_headers",
    """SELECT c_custkey AS site_id, c_name AS site_name, c_mktsegment AS national_site_identifier,
              'Segment ' || lower(c_mktsegment) AS site_description, c_acctbal / 100 AS latitude_dd,
              CAST(c_nationkey AS DOUBLE) AS longitude_dd
       FROM customer""",
)
oracle(
    "src5_export_sites",
    """SELECT c_custkey AS site_id, coalesce(d.n, 0) AS datasets, coalesce(g.n, 0) AS data_groups,
              coalesce(g.v, 0) AS values
       FROM customer
       LEFT JOIN (SELECT site_id, count(*) AS n FROM v_site_dataset WHERE method_id IN (2, 7) GROUP BY 1) d
         ON d.site_id = c_custkey
       LEFT JOIN (SELECT site_id, count(DISTINCT dataset_id) AS n, count(*) AS v
                  FROM v_entity JOIN v_method USING (method_id)
                  WHERE method_group_id = 2 AND method_id IN (2, 7) GROUP BY 1) g
         ON g.site_id = c_custkey""",
)
oracle(
    "src6_replaced_documents",
    """SELECT c_custkey AS site_id,
              CASE WHEN c_acctbal / 100 < 20 THEN upper(c_name) ELSE c_name END AS site_name,
              c_mktsegment AS national_site_identifier, 'Segment ' || lower(c_mktsegment) AS site_description,
              c_acctbal / 100 AS latitude_dd, CAST(c_nationkey AS DOUBLE) AS longitude_dd
       FROM customer""",
)
oracle(
    "src6_changed_sites",
    """SELECT c_custkey AS site_id, CASE WHEN c_custkey % 11 = 3 THEN 'new' WHEN c_custkey % 7 = 0 THEN 'gone' ELSE 'changed' END AS state
       FROM customer
       WHERE CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 11 <> 3
                  ELSE c_custkey % 11 = 3 OR c_acctbal / 100 < 20 OR c_custkey IN (SELECT site_id FROM v_site_dataset WHERE dataset_id = 5) END""",
)
oracle(
    "src6_refreshed_documents",
    """SELECT c_custkey AS site_id, CASE WHEN c_acctbal / 100 < 20 THEN upper(c_name) ELSE c_name END AS site_name,
              (SELECT count(*) FROM v_site_dataset WHERE site_id = c_custkey) AS n_datasets
       FROM customer WHERE c_custkey % 7 <> 0""",
)
oracle(
    "src7_domain_clauses",
    """SELECT CAST(r_regionkey AS BIGINT) AS facet_id, lower(r_name) AS facet_code, r_name AS display_title,
              'method_id in (' || string_agg(CAST(n_nationkey AS VARCHAR), ', ' ORDER BY n_nationkey) || ')' AS clause
       FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""",
)
oracle(
    "src2_keyed_lookup",
    """SELECT sample_group_id, site_id, method_id FROM v_group WHERE sample_group_name = '2-HIGH'""",
)

# --- children of documents ----------------------------------------------------------------

oracle(
    "doc2_group_coordinates",
    """SELECT o_custkey AS site_id, o_orderkey AS sample_group_id, o_totalprice AS measurement,
              o_orderstatus AS position_accuracy, CAST(c.n_regionkey + 230 AS BIGINT) AS coordinate_method_id,
              CAST(c.n_nationkey % 9 AS BIGINT) AS dimension_id, CAST(d.n_regionkey + 20 AS BIGINT) AS unit_id
       FROM orders JOIN nation c ON c.n_nationkey = o_orderkey % 30 JOIN nation d ON d.n_nationkey = c.n_nationkey % 9""",
)
oracle(
    "doc2_group_notes",
    """SELECT o_custkey AS site_id, o_orderkey AS sample_group_id, lower(o_orderpriority) AS note
       FROM orders WHERE o_orderstatus = 'F'""",
)
oracle(
    "doc2_group_sampling_contexts",
    """SELECT o_custkey AS site_id, o_orderkey AS sample_group_id, o_custkey % 5 AS sampling_context_id,
              r_name AS sampling_context FROM orders LEFT JOIN region ON r_regionkey = o_custkey % 5""",
)
for _name, _key, _value, _text, _type in (
    ("descriptions", "sample_description_type_id", "description", "'flag ' || l_returnflag", "description_type"),
    ("locations", "sample_location_type_id", "location", "l_linestatus", "location_type"),
    ("alt_refs", "alt_ref_type_id", "alt_ref", "'ref ' || l_partkey", "alt_ref_type"),
):
    oracle(
        f"doc3_sample_{_name}",
        f"""SELECT sample_id AS physical_sample_id, CAST(l_linenumber % 5 AS BIGINT) AS {_key}, {_text} AS {_value},
              r_name AS {_type} FROM v_line LEFT JOIN region ON r_regionkey = l_linenumber % 5""",
    )
oracle(
    "doc3_sample_dimensions",
    """SELECT sample_id AS physical_sample_id, CAST(l_linenumber AS BIGINT) AS dimension_id,
              CAST(l_linenumber + 210 AS BIGINT) AS method_id, l_quantity AS dimension_value,
              CAST(n_regionkey + 20 AS BIGINT) AS unit_id
       FROM v_line LEFT JOIN nation ON n_nationkey = l_linenumber""",
)
oracle(
    "doc3_sample_horizons",
    """SELECT sample_id AS physical_sample_id, CAST(r_regionkey AS BIGINT) AS horizon_id, r_name AS horizon_name,
              CAST(r_regionkey + 220 AS BIGINT) AS method_id
       FROM v_line JOIN region ON r_regionkey = l_suppkey % 8""",
)
oracle(
    "doc5_dataset_contacts",
    """SELECT site_id, dataset_id, c AS contact_id, r_name AS contact_name
       FROM (SELECT site_id, dataset_id, unnest([dataset_id % 5, dataset_id % 7]) AS c FROM v_site_dataset)
       LEFT JOIN region ON r_regionkey = c""",
)
oracle(
    "doc5_dataset_projects",
    """SELECT site_id, dataset_id, CAST(m.n_regionkey AS BIGINT) AS method_group_id, p.n_name AS project_name,
              r_name AS project_type_name
       FROM v_site_dataset LEFT JOIN nation m ON m.n_nationkey = method_id
       LEFT JOIN nation p ON p.n_nationkey = dataset_id % 7 LEFT JOIN region ON r_regionkey = p.n_regionkey""",
)
oracle(
    "doc6_other_records",
    """SELECT c_custkey AS site_id, c_custkey % 6 AS record_type_id,
              CASE WHEN r_name = 'ASIA' THEN 'DNA' ELSE r_name END AS record_type_name, lower(c_mktsegment) AS description
       FROM customer LEFT JOIN region ON r_regionkey = c_custkey % 6""",
)
oracle(
    "doc1_site_entity_ages",
    "SELECT site_id, entity_id AS analysis_entity_id, age, age_older, age_younger FROM v_age",
)
_PART = "SELECT p_partkey AS taxon_id, {0} FROM part {1}"
for _name, _columns, _more in (
    ("images", "'img-' || p_partkey AS image_name", ""),
    (
        "seasonality",
        """CAST(p_size % 7 AS BIGINT) AS season_id, lower(s.r_name) AS season_name, k.r_name AS season_type,
              n_name AS location_name, lower(p_brand) AS activity_type""",
        """LEFT JOIN region s ON s.r_regionkey = p_size % 7 LEFT JOIN region k ON k.r_regionkey = s.r_regionkey % 2
              LEFT JOIN nation ON n_nationkey = p_size % 25""",
    ),
    ("distribution", "'found in ' || lower(p_type) AS distribution_text", ""),
    ("biology", "'lives on ' || lower(p_brand) AS biology_text", ""),
    (
        "rdb",
        """CAST(p_size % 30 AS BIGINT) AS rdb_code_id, c.n_name AS category, s.r_name AS rdb_system,
              l.n_name AS location_name, k.r_name AS location_type""",
        """JOIN nation c ON c.n_nationkey = p_size % 30 JOIN region s ON s.r_regionkey = c.n_regionkey
              JOIN nation l ON l.n_nationkey = p_size % 25 JOIN region k ON k.r_regionkey = 1""",
    ),
    ("specimens", "'specimen ' || p_size AS specimen", ""),
    ("taxonomic_order", "CAST(p_size * 10 AS BIGINT) AS taxonomic_code, CAST(p_size % 5 AS BIGINT) AS taxonomic_order_system_id", ""),
    ("identification_keys", "upper(p_brand) AS key_text", ""),
    ("associations", "CAST(p_size AS BIGINT) AS associated_taxon_id, r_name AS association_type", "JOIN region ON r_regionkey = p_size % 7"),
):
    oracle(f"doc12_taxon_{_name}", _PART.format(_columns, _more))
oracle(
    "tax5_site_taxon_attributes",
    """WITH a AS (
         SELECT p_partkey AS taxon_id, 'common_names' AS kind, unnest(string_split(p_name, ' ')) AS value FROM part
         UNION ALL SELECT p_partkey, 'measured_attributes', CAST(p_size AS VARCHAR) || '.0' FROM part
         UNION ALL SELECT p_partkey, 'notes', lower(p_type) FROM part WHERE p_size > 25
         UNION ALL SELECT p_partkey, 'seasonality', lower(p_brand) FROM part
         UNION ALL SELECT p_partkey, 'distribution', 'found in ' || lower(p_type) FROM part
         UNION ALL SELECT p_partkey, 'biology', 'lives on ' || lower(p_brand) FROM part)
       SELECT site_id, taxon_id, kind, value FROM (SELECT DISTINCT site_id, taxon_id FROM v_entity) JOIN a USING (taxon_id)""",
)
oracle(
    "doc1_site_age_summary",
    f"""SELECT c_custkey AS site_id, a.age_older, a.age_younger FROM customer
       LEFT JOIN ({_AGE_EXTREMES.format("age_older", "age_younger")}) a ON a.site_id = c_custkey""",
)
oracle(
    "eco2_site_ecocode_bundles",
    f"""SELECT b.*, a.age_older, a.age_younger FROM ({_bundle("e.site_id", "WHERE e.method_id = 3")}) b
       LEFT JOIN ({_AGE_EXTREMES.format("age_older", "age_younger")}) a USING (site_id)""",
)

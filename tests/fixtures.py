"""Hand-made role tables with the null, missing, tie and edge cases."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq

from cairn.sources.tables import Tables, parquet_tables

SCHEMAS = {
    "site": "site_id long, site_name string, national_site_identifier string, "
    "site_description string, latitude_dd double, longitude_dd double",
    "location": "location_id long, location_name string, location_type_id long, location_type string",
    "site_location": "site_id long, location_id long",
    "site_reference": "site_id long, biblio_id long, title string, year string, authors string",
    "group_reference": "sample_group_id long, biblio_id long, title string, year string, authors string",
    "dataset_reference": "dataset_id long, biblio_id long, title string, year string, authors string",
    "sample_group": "sample_group_id long, site_id long, method_id long, sampling_context_id long, "
    "sample_group_name string, sample_group_description string",
    "sample_group_description": "sample_group_id long, type_id long, type_name string, "
    "group_description string",
    "physical_sample": "physical_sample_id long, sample_group_id long, sample_type_id long, "
    "sample_type_name string, sample_name string, date_sampled string",
    "sample_feature": "physical_sample_id long, feature_id long, feature_type_id long, "
    "feature_type_name string",
    "sample_coordinate": "physical_sample_id long, dimension_id long, coordinate_method_id long, "
    "measurement double, accuracy string",
    "sample_horizon": "physical_sample_id long, horizon_id long, horizon_name string",
    "analysis_entity": "analysis_entity_id long, physical_sample_id long, dataset_id long",
    "prep_method": "analysis_entity_id long, method_id long",
    "dataset": "dataset_id long, dataset_name string, method_id long, biblio_id long, project_id long",
    "dataset_contact": "dataset_id long, contact_id long",
    "method": "method_id long, method_name string, method_group_id long, record_type_id long, unit_id long",
    "record_type": "record_type_id long, record_type_name string",
    "domain_clause": "facet_id long, facet_code string, display_title string, clause string",
    "abundance": "abundance_id long, analysis_entity_id long, taxon_id long, abundance long, "
    "abundance_element_id long",
    "abundance_element": "abundance_element_id long, element_name string",
    "identification_level": "abundance_id long, level_id long, level_name string",
    "modification": "abundance_id long, modification_type_id long, modification_type_name string",
    "taxon": "taxon_id long, genus_id long, author_id long, species string",
    "genus": "genus_id long, genus_name string, family_id long",
    "family": "family_id long, family_name string, order_id long",
    "taxon_order": "order_id long, order_name string, record_type_id long",
    "taxon_author": "author_id long, author_name string",
    "taxon_note": "taxon_id long, taxonomy_notes string",
    "taxon_common_name": "taxon_id long, common_name string, language_id long",
    "taxon_measured": "taxon_id long, attribute_type string, data double",
    "species_association": "taxon_id long, associated_taxon_id long, association_type_id long",
    "association_type": "association_type_id long, association_type string",
    "ecocode": "taxon_id long, ecocode_definition_id long",
    "ecocode_definition": "ecocode_definition_id long, ecocode_group_id long, abbreviation string, name string",
    "ecocode_group": "ecocode_group_id long, ecocode_system_id long, group_name string",
    "mcr_name": "taxon_id long, mcr_species_name string, mcr_number long, comparison_notes string",
    "mcr_summary": "taxon_id long, tmax_hi long, tmax_lo long, tmin_hi long, tmin_lo long, "
    "trange_hi long, trange_lo long, cog_mid_tmax long, cog_mid_trange long",
    "mcr_matrix": "taxon_id long, mcr_row int, mcr_data string",
    "entity_age": "analysis_entity_id long, age double, age_older double, age_younger double, "
    "age_range string, chronology_id long, dating_specifier string",
    "relative_date": "relative_date_id long, analysis_entity_id long, relative_age_id long",
    "relative_age": "relative_age_id long, relative_age_name string, c14_age_older double, "
    "c14_age_younger double, cal_age_older double, cal_age_younger double",
    "geochronology": "geochron_id long, analysis_entity_id long, dating_lab_id string, "
    "lab_number string, age double, error_older double, error_younger double",
    "dating_lab": "dating_lab_id long, lab_name string",
    "analysis_value": "analysis_value_id long, analysis_entity_id long, value_class_id long, "
    "analysis_value string",
    "value_class": "value_class_id long, name string, value_type_id long, method_id long",
    "dating_range": "analysis_value_id long, low_value long, high_value long, "
    "low_is_uncertain boolean, age_type_id long, dating_uncertainty_id long",
    "dating_uncertainty": "dating_uncertainty_id long, description string",
    "measured_value": "analysis_entity_id long, measured_value string",
    "isotope": "isotope_id long, analysis_entity_id long, isotope_measurement_id long, "
    "measurement_value string, unit_id long",
    "isotope_measurement": "isotope_measurement_id long, measurement_name string",
    "unit": "unit_id long, unit_name string",
    "ceramic": "ceramics_id long, analysis_entity_id long, ceramics_lookup_id long, measurement_value string",
    "ceramic_lookup": "ceramics_lookup_id long, name string, description string, method_id long",
}

ONES = "1" * 60
ROWS: dict[str, list[tuple]] = {
    # Site 3 has no groups.
    "site": [
        (1, "Alpha", "A1", "A mound", 60.0, 15.0),
        (2, "Beta", "B1", None, 61.0, 16.0),
        (3, "Gamma", "G1", "Empty", 62.0, 17.0),
        (4, "Alpha farm", "A2", "100% wet, old Alpha", 63.0, 18.0),
        (5, "Farm north alpha", "A3", None, 64.0, 19.0),
    ],
    # Country by id only, by name only, with an empty name, with a null name.
    "location": [
        (1, "Norway", 1, None),
        (2, "Sweden", 9, "Country"),
        (3, "", 1, "Country"),
        (4, None, 1, "Country"),
        (5, "Parish", 2, "Parish"),
    ],
    "site_location": [(1, 1), (1, 5), (2, 1), (3, 2), (4, 3), (5, 4), (2, 1)],
    "site_reference": [(1, 70, "T70", None, None), (2, 71, "T71", "1990", None)],
    "group_reference": [(10, 70, "T70", "1980", "X"), (12, 71, "T71b", "1991", None)],
    "dataset_reference": [(1000, 70, "T70", "1980", None), (1001, 72, None, None, None)],
    # Group 13 has no samples.
    "sample_group": [
        (10, 1, 201, 1, "Core", "north core"),
        (11, 1, 202, 1, "Pit", None),
        (12, 2, 201, 2, "Core", "pit and core"),
        (13, 2, 202, 2, None, None),
        (14, 4, 201, 2, "Score", "50% core"),
    ],
    "sample_group_description": [
        (10, 62, "building", "house"),
        (11, 62, "building", "house"),
        (12, 62, "building", "barn"),
        (14, 61, "other", "house"),
    ],
    # Sample 104 has no entities.
    "physical_sample": [
        (100, 10, 1, "bulk", "s100", "2001-01-01"),
        (101, 10, 1, "bulk", "s101", None),
        (102, 11, 2, "core", "s102", None),
        (103, 12, 2, "core", "s103", None),
        (104, 12, 1, "bulk", "s104", None),
        (105, 14, 1, "bulk", "s105", None),
    ],
    "sample_feature": [
        (100, 1, 7, "pit"),
        (100, 2, 8, "well"),
        (103, 1, 7, "pit"),
        (104, 3, 7, "pit"),
    ],
    "sample_coordinate": [(100, 1, 300, 1.5, "m"), (100, 2, 300, 2.5, "m"), (103, 1, 300, 3.0, None)],
    "sample_horizon": [(100, 5, "H5"), (101, 5, "H5"), (103, 6, "H6")],
    "analysis_entity": [
        (1, 100, 1000),
        (2, 100, 1001),
        (3, 101, 1000),
        (4, 102, 1000),
        (5, 103, 1000),
        (6, 103, 1002),
        (7, 103, 1003),
        (8, 105, 1004),
        (9, 105, 1005),
        (10, 100, 1006),
        (11, 101, 1006),
        (12, 105, 1000),
        (13, 103, 1007),
    ],
    # Entity 1 repeats a preparation method.
    "prep_method": [(1, 401), (1, 400), (1, 401), (5, 400)],
    "dataset": [
        (1000, "Insects", 3, 70, 1),
        (1001, "Seeds", 8, 72, 1),
        (1002, "Radiocarbon", 151, 0, 1),
        (1003, "Periods", 50, None, 1),
        (1004, "Twice listed", 60, None, 1),
        (1005, "Unlisted", 999, None, 1),
        (1006, "Phosphate", 30, 73, 1),
        (1007, "Sherds", 171, None, 1),
    ],
    "dataset_contact": [(1000, 90), (1001, 90), (1002, 91)],
    "method": [
        (3, "Insect count", 5, 1, 1),
        (8, "Seed count", 5, 1, 1),
        (30, "Phosphate", 2, 2, 2),
        (50, "Period", 3, 3, None),
        (60, "Ancient DNA", 9, 4, None),
        (151, "C14 std", 3, 3, 3),
        (171, "Ceramics", 7, 5, None),
        (999, "Other", 8, 5, None),
        (201, "Coring", 20, 6, None),
        (202, "Count by hand", 20, 6, None),
    ],
    "record_type": [(1, "Insect"), (2, "Soil"), (3, "Age"), (4, "DNA"), (5, "Thing"), (6, "Field")],
    "domain_clause": [
        (1, "life", "Life", "tbl_datasets.method_id in (8, 3, 60) and 2020 > 1"),
        (2, "dna", "DNA", "method_id IN (60)"),
        (3, "none", "None", "method_id in (select method_id from x where id = 3)"),
        (4, "bare", "Bare", "true"),
    ],
    # Taxa 20 and 21 tie; taxon 23 has a null count; taxon 24 has no ecocode.
    "abundance": [
        (1, 1, 20, 4, 1),
        (2, 1, 21, 9, 1),
        (3, 3, 20, 5, 2),
        (4, 5, 22, 100, 1),
        (5, 4, 23, None, None),
        (6, 2, 20, 1000, 1),
        (7, 5, 24, 2, 1),
        (8, 12, 22, 1, 1),
    ],
    "abundance_element": [(1, "head"), (2, "wing")],
    "identification_level": [(1, 2, "species"), (1, 1, "genus")],
    "modification": [(1, 5, "charred"), (4, 6, "wet")],
    "taxon": [
        (20, 200, 1, "aterrima"),
        (21, 200, None, "bruna"),
        (22, 201, 2, "clara"),
        (23, 201, 1, "densa"),
        (24, 201, 1, "elata"),
    ],
    "genus": [(200, "Ater", 300), (201, "Bonus", 300)],
    "family": [(300, "Carabidae", 400)],
    "taxon_order": [(400, "Coleoptera", 1)],
    "taxon_author": [(1, "Linné"), (2, "Fabricius")],
    "taxon_note": [(20, "note a"), (21, "note b")],
    "taxon_common_name": [(20, "black one", 1), (20, "svart", 2), (22, "clear one", 1)],
    "taxon_measured": [(20, "length", 12.5), (22, "length", 5.0), (22, "width", 12.0)],
    "species_association": [(20, 22, 1), (21, 99, 1)],
    "association_type": [(1, "preys on")],
    # Definition 31 carries the abbreviation of definition 30.
    "ecocode": [(20, 30), (20, 31), (21, 30), (22, 31), (23, 32), (20, 33)],
    "ecocode_definition": [
        (30, 1, "W", "Wet"),
        (31, 1, "W", "Wetland"),
        (32, 2, "D", "Dry"),
        (33, 9, "Z", "Other system"),
    ],
    "ecocode_group": [(1, 2, "Water"), (2, 2, "Ground"), (9, 3, "Else")],
    # Taxon 20 has two names; taxon 23 has no matrix; taxon 24 no name.
    "mcr_name": [
        (20, "A. aterrima", 1, None),
        (20, "A. nigra", 1, None),
        (21, "A. bruna", 2, "n"),
        (22, "B. clara", 3, None),
        (23, "B. densa", 4, None),
    ],
    "mcr_summary": [
        (20, 25, 10, 5, -20, 40, 20, 17, 30),
        (21, 27, 12, 6, -18, 38, 22, 18, 31),
        (22, 30, None, 9, -5, 20, 10, None, 15),
    ],
    # Row 2 of taxon 21 is short; taxon 22 has one row only.
    "mcr_matrix": [
        (20, 1, "0" * 10 + "1" * 50),
        (20, 2, ONES),
        (21, 1, "1" * 20 + "0" * 40),
        (21, 2, "11"),
        (22, 36, "0" * 59 + "1"),
        (24, 1, ONES),
    ],
    # Point, range, flipped range, no age, zero, point at the maximum.
    "entity_age": [
        (1, 100.0, None, None, "c. 100", 3, "early"),
        (3, None, 300.0, 200.0, None, None, ""),
        (4, None, 150.0, 250.0, None, 0, None),
        (5, None, None, None, None, 1, None),
        (6, None, 0.0, 50.9, None, None, None),
        (8, 500.0, None, None, None, None, None),
    ],
    "relative_date": [(2, 7, 801), (1, 7, 800), (3, 5, 802)],
    "relative_age": [
        (800, "Bronze", 3000.9, 2500.2, None, None),
        (801, "Iron", 9000.0, 1.0, None, None),
        (802, "Modern", None, None, 0.0, 100.0),
    ],
    "geochronology": [(5, 6, "77b", "Ua-1", 2000.0, 30.0, 40.0), (6, 6, "x", "Ua-2", 1.0, 1.0, 1.0)],
    "dating_lab": [(77, "Uppsala")],
    "analysis_value": [
        (1, 1, 134, "12"),
        (2, 1, 137, " 12 "),
        (3, 2, 500, "12abc"),
        (4, 3, 500, ""),
        (5, 4, 500, None),
        (6, 5, 500, "Infinity"),
        (7, 5, 500, "NaN"),
        (8, 5, 500, "8"),
        (9, 5, 500, "12"),
        (10, 8, 500, "oak"),
        (11, 8, 500, "oak"),
        (12, 12, 500, "pine"),
        (13, 3, 134, "x"),
        (14, 4, 137, "y"),
    ],
    "value_class": [(134, "Germination", 1, 10), (137, "Felling", 1, 10), (500, "Key", 2, 3), (501, "Unused", 2, 3)],
    "dating_range": [
        (1, 1200, None, True, 1, 1),
        (2, None, 1300, False, 1, 2),
        (3, 0, None, False, 1, 3),
        (13, 1100, 1111, False, 1, None),
        (14, 1, 1299, False, 1, 2),
    ],
    "dating_uncertainty": [(1, "ca"), (2, "after"), (3, "unused")],
    "measured_value": [(10, "12"), (11, " 7.5 mg"), (10, "<3"), (1, "99")],
    "isotope": [(1, 10, 5, "-21.5", 9)],
    "isotope_measurement": [(5, "d13C")],
    "unit": [(9, "per mil")],
    "ceramic": [(1, 13, 600, "red"), (2, 13, 601, "coarse")],
    "ceramic_lookup": [(600, "Colour", "c", 171), (601, "Ware", "w", 172)],
}


ARROW_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(),
               "string": pa.string(), "boolean": pa.bool_()}


def role_tables(spark, folder) -> Tables:
    """The tables as Parquet files, so that tests read what jobs read."""
    paths = {}
    for role, schema in SCHEMAS.items():
        fields = [part.split() for part in schema.split(", ")]
        columns = [
            pa.array([row[i] for row in ROWS[role]], ARROW_TYPES[kind])
            for i, (_, kind) in enumerate(fields)
        ]
        paths[role] = str(folder / f"{role}.parquet")
        pq.write_table(pa.table(columns, names=[name for name, _ in fields]), paths[role])
    return parquet_tables(spark, paths)


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple(map(repr, t)))


def by(df, *keys) -> dict:
    """Rows as dictionaries by key."""
    found = {}
    for r in df.collect():
        d = r.asDict(recursive=True)
        key = tuple(d[k] for k in keys) if len(keys) > 1 else d[keys[0]]
        assert key not in found, f"key {key} occurs twice"
        found[key] = d
    return found

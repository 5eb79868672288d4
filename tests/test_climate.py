"""Climate reconstructions against plain loops."""

from pyspark.sql import functions as F

from cairn.operators import climate
from tests.fixtures import ROWS, by, rows

NAMED = {r[0] for r in ROWS["mcr_name"]}
SITE_TAXA = {1: {20, 21, 23}, 2: {22, 24}, 4: {22}}
DATASET_TAXA = {1000: {20, 21, 22, 23, 24}, 1001: {20}}


def loops(taxa):
    """Overlap, density and taxa count of the named taxa that have rows."""
    matrix = [(t, r, d) for t, r, d in ROWS["mcr_matrix"] if t in taxa and t in NAMED]
    both = [[1] * 60 for _ in range(36)]
    count = [[0] * 60 for _ in range(36)]
    for _, row, data in matrix:
        for col in range(60):
            if col < len(data) and data[col] == "1":
                count[row - 1][col] += 1
            else:
                both[row - 1][col] = 0
    return both, count, len({t for t, _, _ in matrix})


def test_overlap_and_density(roles):
    for scope, members in (("site", SITE_TAXA), ("dataset", DATASET_TAXA)):
        overlap = by(climate.mcr_reconstruction(roles, scope), "scope", "row")
        density = by(climate.mcr_density(roles, scope), "scope", "row", "col")
        for key, taxa in members.items():
            both, count, _ = loops(taxa)
            for r in range(36):
                assert overlap[key, r]["bits"] == "".join(map(str, both[r]))
            assert [[density[key, r, c]["n"] for c in range(60)] for r in range(36)] == count
        assert len(overlap) == 36 * len(members)


def test_overlap_summary(roles):
    got = by(climate.mcr_reconstruction_summary(roles, "site"), "scope")
    for key, taxa in SITE_TAXA.items():
        both, _, n = loops(taxa)
        cells = [(r, c) for r in range(36) for c in range(60) if both[r][c]]
        assert got[key]["taxa_count"] == n
        assert got[key]["row_min"] == min(r for r, _ in cells)
        assert got[key]["row_max"] == max(r for r, _ in cells)
        assert got[key]["col_min"] == min(c for _, c in cells)
        assert got[key]["col_max"] == max(c for _, c in cells)


def check_lean(found, taxa):
    _, count, n = loops(taxa)
    cells = [(r, c) for r in range(36) for c in range(60) if count[r][c]]
    peak = max(cells, key=lambda rc: (count[rc[0]][rc[1]], -rc[0], -rc[1]))
    assert found["taxa_count"] == n
    assert (found["peak_row"], found["peak_col"]) == peak
    assert found["peak_n"] == count[peak[0]][peak[1]]
    assert (found["col_min"], found["col_max"]) == (
        min(c for _, c in cells), max(c for _, c in cells),
    )


def test_lean_reconstructions(roles):
    every = set().union(*SITE_TAXA.values())
    one = climate.mcr_aggregate(roles).first().asDict()
    check_lean(one, every)
    assert (one["tmax_lo"], one["tmax_hi"]) == (10, 30)
    # Means over taxa that have both centres: (17 + 18) / 2 and (30 + 31) / 2, halves up.
    assert (one["cog_tmax"], one["cog_trange"]) == (18, 31)
    listed = climate.mcr_by_site(roles, [4, 3, 1]).collect()
    assert [r.scope for r in listed] == [4, 3, 1]
    check_lean(listed[0].asDict(), SITE_TAXA[4])
    check_lean(listed[2].asDict(), SITE_TAXA[1])
    assert listed[1].taxa_count == 0
    assert listed[1].peak_n is None
    assert listed[0].cog_tmax is None  # its only taxon lacks one centre
    assert climate.mcr_by_site(roles, []).count() == 0


def test_overlap_never_exceeds_density(roles):
    n = by(climate.mcr_reconstruction_summary(roles, "dataset"), "scope")[1000]["taxa_count"]
    dense = climate.mcr_density(roles, "dataset").where("scope = 1000")
    ones = climate.mcr_reconstruction(roles, "dataset").where("scope = 1000").select(
        F.sum(F.length(F.replace("bits", F.lit("0"), F.lit(""))))
    )
    assert n == 3
    assert dense.select(F.max("n")).first()[0] <= n
    assert ones.first()[0] > 0


def test_envelopes(roles):
    got = climate.taxon_mcr(roles, [20, 23]).orderBy("taxon_id", "mcr_species_name").collect()
    assert [r.mcr_species_name for r in got] == ["A. aterrima", "A. nigra", "B. densa"]
    assert got[0].matrix == [ROWS["mcr_matrix"][0][2], ROWS["mcr_matrix"][1][2]]
    assert got[2].matrix is None
    assert len(rows(climate.taxa_matrices(roles))) == 5  # taxon 24 has no name

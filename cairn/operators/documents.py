"""Nested site and taxon documents, their lookups, and extracts from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.nesting import (
    PART,
    PARTS,
    SLICE,
    child_rows,
    flat_documents,
    gather,
    grouped,
    header_rows,
    into_keyed_parts,
    into_parts,
    stack,
    with_null_keys,
)
from cairn.functions.semantics import SiteIds, best_by, ids_of, leading_number
from cairn.operators.datagroups import AGE_FIELDS
from cairn.operators.dating import site_age_summary
from cairn.operators.facts import (
    age_facts,
    entities,
    groups,
    joined,
    leaf,
    methods,
    of_methods,
    sample_rows,
    site_datasets,
    value_facts,
    with_site,
)
from cairn.operators.taxa import taxonomy
from cairn.sources.store import Store
from cairn.sources.tables import Tables

# Document field and the role that fills it, per level. Roles that are not
# bound leave their field out.
SITE_CHILDREN = {
    "biblio": "site_reference",
    "other_records": "site_other_record",
}
GROUP_CHILDREN = {
    "descriptions": "sample_group_description",
    "coordinates": "sample_group_coordinate",
    "biblio": "group_reference",
    "notes": "sample_group_note",
    "sampling_contexts": "sample_group_context",
}
SAMPLE_CHILDREN = {
    "features": "sample_feature",
    "descriptions": "sample_description",
    "locations": "sample_location",
    "alt_refs": "sample_alt_ref",
    "dimensions": "sample_dimension",
    "coordinates": "sample_coordinate",
    "horizons": "sample_horizon",
}
TAXON_CHILDREN = {
    "common_names": "taxon_common_name",
    "measured_attributes": "taxon_measured",
    "notes": "taxon_note",
    "images": "taxon_image",
    "seasonality": "taxon_seasonality",
    "distribution": "taxon_distribution_note",
    "biology": "taxon_biology",
    "rdb": "taxon_red_list",
    "specimens": "taxon_specimen",
    "taxonomic_order": "taxon_order_code",
    "identification_keys": "taxon_identification_key",
    "associations": "species_association",
}


class _Build:
    """One build of site documents: the wanted paths, the sites and their groups."""

    def __init__(
        self,
        t: Tables,
        site_ids: SiteIds,
        paths: Sequence[str] | None,
        slices: int,
        data_groups: DataFrame | None,
        sited: bool = True,
    ):
        self.t, self.site_ids, self.paths = t, site_ids, paths
        self.data_groups, self.slices = data_groups, slices
        # The keys by which rows below the groups find their site: without ``sited`` through their group, later.
        self.sited, self.home = sited, ["site_id"] if sited else ["sample_group_id"]
        self.sites = ids_of(t["site"], site_ids).select("site_id")
        self.groups = groups(t, site_ids)

    def wants(self, path: str) -> bool:
        if self.paths is None:
            return True
        return any(p == path or p.startswith(f"{path}.") for p in self.paths)

    def children(self, prefix: str, roles: dict[str, str]) -> dict[str, str]:
        return {
            field: role
            for field, role in roles.items()
            if role in self.t and self.wants(f"{prefix}{field}")
        }

    def group_children(self) -> dict[str, str]:
        return self.children("sample_groups.", GROUP_CHILDREN)

    def sample_children(self) -> dict[str, str]:
        return self.children("sample_groups.physical_samples.", SAMPLE_CHILDREN)

    def site_children(self) -> dict[str, str]:
        return self.children("", SITE_CHILDREN)

    def with_site(self, df: DataFrame) -> DataFrame:
        """Add site_id through the sample group, or leave that to a later join of what became of the rows."""
        if self.sited:
            return df.drop("site_id").join(self.groups, "sample_group_id")
        rows = df.drop("site_id")
        return rows if self.site_ids is None else rows.join(self.groups.select("sample_group_id"), "sample_group_id", "left_semi")

    def of_site(self, df: DataFrame) -> DataFrame:
        """Rows that carry the site_id of a wanted site."""
        return df.join(self.sites, "site_id")


def _prep_rows(t: Tables) -> DataFrame:
    """Preparation methods with the keys of their entity."""
    prep = t["prep_method"]
    if "sample_group_id" in prep.columns and "dataset_id" in prep.columns:
        return prep
    own = entities(t).select("analysis_entity_id", "sample_group_id", "dataset_id")
    return prep.select("analysis_entity_id", "method_id").join(own, "analysis_entity_id")


def _group_branch(b: _Build) -> DataFrame:
    """Headers and children of sample groups and samples, as rows of one table."""
    return stack(_group_frames(b))


def _group_heads(b: _Build) -> DataFrame:
    return header_rows(ids_of(b.t["sample_group"], b.site_ids), ["site_id", "sample_group_id"], "_group")


def _group_frames(b: _Build) -> list[DataFrame]:
    t = b.t
    group_key = list(dict.fromkeys([*b.home, "sample_group_id"]))
    sample_key = [*group_key, "physical_sample_id"]
    frames = [_group_heads(b)] if b.sited else []
    for field, role in b.group_children().items():
        frames.append(child_rows(b.with_site(joined(t, role)), group_key, f"g_{field}"))
    if b.wants("sample_groups.physical_samples"):
        own = sample_rows(t, "physical_sample", site=False)
        frames.append(header_rows(b.with_site(own), sample_key, "_sample"))
        for field, role in b.sample_children().items():
            rows = sample_rows(t, role, site=False)
            frames.append(child_rows(b.with_site(rows), sample_key, f"s_{field}"))
    if b.wants("sample_groups.dataset_ids"):
        links = b.with_site(entities(t).select("sample_group_id", "dataset_id").distinct())
        frames.append(
            links.select(
                *group_key,
                F.xxhash64("sample_group_id", "dataset_id").alias(SLICE),
                F.col("dataset_id").alias("g_dataset_ids"),
            )
        )
    return frames


def _lists(rows: DataFrame, prefix: str) -> list[str]:
    return [c for c in rows.columns if c.startswith(prefix)]


def _header_fields(rows: DataFrame, header: str, skip: Sequence[str] = ()) -> list:
    names = rows.schema[header].dataType.fieldNames()
    return [F.col(f"{header}.{n}").alias(n) for n in names if n not in skip]


def _home(header: str) -> object:
    """True in the one part that holds the header of a group, sample or dataset."""
    return F.col(header).isNotNull().alias("is_home")


def _nest_groups(rows: DataFrame) -> DataFrame:
    group_lists, sample_lists = _lists(rows, "g_"), _lists(rows, "s_")
    has_samples = "_sample" in rows.columns
    group_rows = rows
    if has_samples:
        # Group rows have no sample id: they form one extra row beside the samples.
        per_sample = grouped(rows, "site_id", PART, "sample_group_id", "physical_sample_id").agg(
            F.max("_group").alias("_group"),
            F.max("_sample").alias("_sample"),
            *[gather(c).alias(c) for c in (*group_lists, *sample_lists)],
        )
        is_sample = F.col("physical_sample_id").isNotNull()
        sample = F.struct(
            "physical_sample_id",
            *_header_fields(rows, "_sample"),
            _home("_sample"),
            *[F.col(c).alias(c[2:]) for c in sample_lists],
        )
        lists = [
            F.coalesce(F.max(F.when(~is_sample, F.col(c))), F.array()).alias(c)
            for c in group_lists
        ]
        lists.append(gather(F.when(is_sample, sample)).alias("physical_samples"))
        group_rows = per_sample
    else:
        lists = [gather(c).alias(c) for c in group_lists]
    per_group = grouped(group_rows, "site_id", PART, "sample_group_id").agg(
        F.max("_group").alias("_group"), *lists
    )
    group = F.struct(
        "sample_group_id",
        *_header_fields(rows, "_group"),
        _home("_group"),
        *[F.col(c).alias(c[2:]) for c in group_lists],
        *(["physical_samples"] if has_samples else []),
    )
    return grouped(per_group, "site_id", PART).agg(gather(group).alias("sample_groups"))


def _dataset_heads(b: _Build, *, units: bool = False) -> list[DataFrame]:
    """Dataset headers and contacts by site; ``units`` adds the unit of a dataset's method."""
    t, key = b.t, ["site_id", "dataset_id"]
    pairs, heads = site_datasets(t, b.site_ids), joined(t, "dataset")
    if units:
        heads = heads.join(methods(t).select("method_id", F.col("unit_id").alias("_unit_id")), "method_id", "left")
    frames = [header_rows(pairs.join(heads, "dataset_id"), key, "_dataset")]
    if b.wants("datasets.contacts") and "dataset_contact" in t:
        frames.append(child_rows(pairs.join(joined(t, "dataset_contact"), "dataset_id"), key, "d_contacts"))
    return frames


def _dataset_entities(b: _Build) -> list[DataFrame]:
    """Entities and preparation methods.

    Entity rows carry the method of their dataset, so a part can be cut by
    method wherever the header itself lies.
    """
    t, frames = b.t, []
    place = [*b.home, "dataset_id", F.xxhash64("analysis_entity_id").alias(SLICE), "analysis_entity_id"]
    if b.wants("datasets.analysis_entities"):
        members = of_methods(t, b.with_site(entities(t)))
        frames.append(
            members.select(
                *place,
                F.col("method_id").alias("_method_id"),
                F.struct("physical_sample_id", "sample_group_id").alias("_entity"),
            )
        )
    if b.wants("datasets.analysis_entities.prep_methods") and "prep_method" in t:
        prep = b.with_site(_prep_rows(t))
        frames.append(prep.select(*place, F.col("method_id").alias("_prep")))
    return frames


def _whole_entities(b: _Build) -> DataFrame:
    """One row per entity of a group, with its preparation methods, so that these do not go to their site one by one."""
    t, keys = b.t, ["sample_group_id", "dataset_id", "analysis_entity_id"]
    members = of_methods(t, entities(t)).select(
        *keys, F.col("method_id").alias("_method_id"), F.struct("physical_sample_id").alias("_own")
    )
    used = _prep_rows(t).select(*keys, F.col("method_id").alias("_prep"))
    rows = stack([members, used]).repartition("sample_group_id")
    whole = grouped(rows, *keys).agg(
        F.max("_method_id").alias("_method_id"), F.max("_own").alias("_own"), F.collect_set("_prep").alias("_preps")
    )
    return whole.join(b.groups, "sample_group_id").select(
        "site_id",
        "dataset_id",
        F.xxhash64("analysis_entity_id").alias(SLICE),
        "analysis_entity_id",
        "_method_id",
        F.when(F.col("_own").isNotNull(), F.struct("_own.physical_sample_id", "sample_group_id")).alias("_entity"),
        "_preps",
    )


def _dataset_branch(b: _Build) -> DataFrame:
    """Dataset headers, and entities with their preparation methods, as rows of one table."""
    if b.wants("datasets.analysis_entities.prep_methods") and "prep_method" in b.t:
        return stack([*_dataset_heads(b), _whole_entities(b)])
    return stack([*_dataset_heads(b), *_dataset_entities(b)])


def _nest_datasets(rows: DataFrame) -> DataFrame:
    own = _lists(rows, "d_")
    if "_entity" not in rows.columns:
        per_dataset = grouped(rows, "site_id", PART, "dataset_id").agg(
            F.max("_dataset").alias("_dataset"), *[gather(c).alias(c) for c in own]
        )
        dataset = F.struct(
            "dataset_id",
            *_header_fields(rows, "_dataset"),
            _home("_dataset"),
            *[F.col(c).alias(c[2:]) for c in own],
        )
        return grouped(per_dataset, "site_id", PART).agg(gather(dataset).alias("datasets"))
    lists = (
        [F.sort_array(F.array_distinct(F.flatten(F.collect_list("_preps")))).alias("prep_methods")]
        if "_preps" in rows.columns
        else []
    )
    per_entity = grouped(rows, "site_id", PART, "dataset_id", "analysis_entity_id").agg(
        F.max("_dataset").alias("_dataset"),
        F.max("_entity").alias("_entity"),
        F.max("_method_id").alias("_method_id"),
        *lists,
        *[gather(c).alias(c) for c in own],
    )
    entity = F.struct(
        "analysis_entity_id",
        "_entity.physical_sample_id",
        "_entity.sample_group_id",
        *(["prep_methods"] if lists else []),
    )
    per_dataset = grouped(per_entity, "site_id", PART, "dataset_id").agg(
        F.max("_dataset").alias("_dataset"),
        F.max("_method_id").alias("_method_id"),
        gather(F.when(F.col("analysis_entity_id").isNotNull(), entity)).alias("analysis_entities"),
        # Rows of the dataset itself have no entity.
        *[
            F.coalesce(F.max(F.when(F.col("analysis_entity_id").isNull(), F.col(c))), F.array()).alias(c)
            for c in own
        ],
    )
    dataset = F.struct(
        "dataset_id",
        F.coalesce("_dataset.method_id", "_method_id").alias("method_id"),
        *_header_fields(rows, "_dataset", skip=["method_id"]),
        _home("_dataset"),
        "analysis_entities",
        *[F.col(c).alias(c[2:]) for c in own],
    )
    return grouped(per_dataset, "site_id", PART).agg(gather(dataset).alias("datasets"))


def _rows_tell_lookups(b: _Build) -> bool:
    """Whether the other rows of a build hold every code of :func:`site_lookups` (but the units of methods)."""
    t = b.t
    read = {"sample_groups": "sample_group", "datasets": "dataset", "datasets.contacts": "dataset_contact"}
    read["datasets.analysis_entities.prep_methods"] = "prep_method"
    read["sample_groups.coordinates"] = GROUP_CHILDREN["coordinates"]
    read |= {f"sample_groups.physical_samples.{field}": SAMPLE_CHILDREN[field] for field in ("coordinates", "dimensions", "horizons")}
    if not all(b.wants(path) for path, role in read.items() if role in t):
        return False
    # A table with keys of its own above the sample could tell another site here than there.
    keyed = [role for path, role in read.items() if path.startswith("sample_groups.") and role in t and "site_id" in t[role].columns]
    prep = t["prep_method"].columns if "prep_method" in t else []
    return not keyed and ("sample_group_id" in prep) == ("dataset_id" in prep) and "site_id" not in prep


def _site_branch(b: _Build, *, derived: bool = True) -> DataFrame:
    """Headers and lists of sites; without ``derived`` those that follow from other rows of the build are left out."""
    t = b.t
    header = ids_of(t["site"], b.site_ids)
    summed = b.wants("age_summary") and (derived or not b.wants("analysis_entity_ages"))
    if summed and ("entity_age" in t or "entity_age_flat" in t):
        ages = site_age_summary(t, b.site_ids)
        ages = ages.select("site_id", F.col("older").alias("age_older"), F.col("younger").alias("age_younger"))
        header = header.join(ages, "site_id", "left")
    frames = [header_rows(header, ["site_id"], "_site", first=True)]
    if "site_location" in t and b.wants("location"):
        places = b.of_site(t["site_location"]).join(t["location"], "location_id", "left")
        frames.append(child_rows(places, ["site_id"], "l_location"))
    for field, role in b.site_children().items():
        frames.append(child_rows(b.of_site(joined(t, role)), ["site_id"], f"l_{field}"))
    if b.wants("lookup_tables") and (derived or not _rows_tell_lookups(b)):
        frames.append(child_rows(site_lookups(t, b.site_ids), ["site_id"], "l_lookup_tables"))
    if b.wants("analysis_entity_ages") and ("entity_age" in t or "entity_age_flat" in t):
        ages = age_facts(t, b.site_ids)
        fields = [c for c in AGE_FIELDS if c in ages.columns]
        ages = ages.select("site_id", "analysis_entity_id", *fields)
        frames.append(child_rows(ages, ["site_id"], "l_analysis_entity_ages"))
    return stack(frames)


def _every_part(b: _Build) -> DataFrame:
    """All slices of all sites that rows of a build can belong to."""
    sites = [b.sites, b.groups.select("site_id")]
    if "site_id" in entities(b.t).columns:
        sites.append(ids_of(entities(b.t), b.site_ids).select("site_id").distinct())
    return stack(sites).select("site_id", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(b.slices)])).alias(SLICE))


def _nest_site(rows: DataFrame) -> DataFrame:
    lists, marks = _lists(rows, "l_"), [c for c in rows.columns if c == "_filled"]
    nested = grouped(rows, "site_id", PART).agg(
        F.max("_site").alias("_site"), *[F.max(c).alias(c) for c in marks], *[gather(c).alias(c) for c in lists]
    )
    return nested.select(
        "site_id",
        PART,
        *marks,
        *_header_fields(rows, "_site"),
        *[F.col(c).alias(c[2:]) for c in lists],
    )


def _data_branch(b: _Build) -> DataFrame:
    return child_rows(
        b.of_site(b.data_groups),
        ["site_id", "type", "data_group_id"],
        "_value",
        ["data_group_id", "analysis_entity_id", "key"],
    )


def _nest_data_groups(rows: DataFrame) -> DataFrame:
    per_group = grouped(rows, "site_id", PART, "type", "data_group_id").agg(
        F.sort_array(F.collect_set("_value.method_id")).alias("method_ids"),
        gather("_value").alias("values"),
    )
    group = F.struct("type", "data_group_id", "method_ids", "values")
    return grouped(per_group, "site_id", PART).agg(gather(group).alias("data_groups"))


def site_documents(
    t: Tables,
    site_ids: SiteIds = None,
    *,
    paths: Sequence[str] | None = None,
    data_groups: DataFrame | None = None,
    slices: int,
) -> DataFrame:
    """One document per site: groups with samples, datasets with entities, places.

    Every level keeps parents without children. Entities sit under their
    dataset; a sample group lists the datasets reached through its samples.
    ``paths`` names the lists that are needed, with dots between levels (all
    when omitted): nothing else is read. ``data_groups`` adds the long rows of
    the measurement families.

    The document of every site is cut into ``slices`` (see
    :mod:`cairn.functions.nesting`). A group, sample or dataset then shows up in
    each slice that holds some of its children, and ``is_home`` marks the one
    that holds its own fields. The functions ``*_rows_of`` bring slices together.
    """
    b = _Build(t, site_ids, paths, slices, data_groups)
    branches = []
    if b.wants("sample_groups"):
        branches.append((_nest_groups, _group_branch(b)))
    if b.wants("datasets"):
        branches.append((_nest_datasets, _dataset_branch(b)))
    if data_groups is not None:
        branches.append((_nest_data_groups, _data_branch(b)))
    # All branches lie by exactly these keys and are sorted by them: no rows move or are sorted again.
    if len(branches) < 2:
        document = _nest_site(into_parts(_site_branch(b), "site_id", slices))
        for nest, rows in branches:
            document = document.join(nest(into_parts(rows, "site_id", slices)), ["site_id", PART], "full_outer")
    else:
        # A full join forgets how its rows lie, so the next one would move them. Left joins do not: the site's rows are given every key.
        own = _site_branch(b).withColumn("_filled", F.lit(True))
        document = _nest_site(into_keyed_parts(stack([own, _every_part(b)]), "site_id", slices))
        filled = F.col("_filled")
        for nest, rows in branches:
            nested = nest(into_keyed_parts(rows, "site_id", slices))
            document = document.join(nested, ["site_id", PART], "left")
            filled = filled | F.col(nested.columns[-1]).isNotNull()
        document = with_null_keys(document.where(filled).drop("_filled"), "site_id", slices)
    document = document.withColumn(PARTS, F.lit(slices))
    lists = ("sample_groups", "datasets", "data_groups", "location", "lookup_tables", "analysis_entity_ages")
    for name in (*lists, *SITE_CHILDREN):
        if name in document.columns:
            document = document.withColumn(name, F.coalesce(name, F.array()))
    lead = ["site_id", PART, PARTS]
    return document.select(*lead, *[c for c in document.columns if c not in lead])


def site_fingerprints(
    t: Tables,
    site_ids: SiteIds = None,
    *,
    paths: Sequence[str] | None = None,
    data_groups: DataFrame | None = None,
) -> DataFrame:
    """(site_id, fingerprint): equal for two states of the tables if the documents of the site are.

    A document is made of rows of the flat tables joined to what they point to.
    The fingerprint counts and adds up digests of each of these rows, so it does not
    depend on their order or on the number of slices, and nothing is nested or
    gathered. Lookups and the summary of ages are not built where the rows that they are made of
    count themselves; the unit of a method counts with its datasets. Rows below the groups are added up by group before they meet
    their site: a map task sends a few numbers a group or site, and no rows.
    """
    b = _Build(t, site_ids, paths, 1, data_groups, sited=False)
    by_group, by_site = [], [("site", _site_branch(b, derived=False))]
    if b.wants("sample_groups"):
        by_group += [("sample_groups", frame) for frame in _group_frames(b)]
        by_site.append(("sample_groups", _group_heads(b)))
    if b.wants("datasets"):
        by_group += [("datasets", frame) for frame in _dataset_entities(b)]
        by_site += [("datasets", frame) for frame in _dataset_heads(b, units=b.wants("lookup_tables"))]
    if data_groups is not None:
        by_site.append(("data_groups", _data_branch(b)))
    groups_of = _digest_sums(stack([_digests(*named, "sample_group_id") for named in by_group]), "sample_group_id") if by_group else None
    sites = [_digests(*named, "site_id") for named in by_site]
    if groups_of is not None:
        sites.append(groups_of.join(b.groups, "sample_group_id").select("site_id", *DIGEST_SUMS))
    sums = _digest_sums(stack(sites), "site_id")
    # Rows of a site that is no longer there do not bring it back.
    return sums.join(b.sites, "site_id", "left_semi").select("site_id", F.concat_ws(":", *DIGEST_SUMS).alias("fingerprint"))


# Sums of 32-bit pieces of two digests: no long overflows below 2^31 rows of a site.
DIGEST_SUMS = ("n", "a", "b", "c", "d")


def _digests(name: str, rows: DataFrame, key: str) -> DataFrame:
    """One row of sums for each row."""
    columns = sorted(c for c in rows.columns if c != SLICE)
    # A digest passes nulls over, so rows are told with the names of the fields that are there.
    told = F.to_json(F.struct(*columns))
    both = rows.select(key, F.xxhash64(F.lit(name), told).alias("x"), F.xxhash64(told, F.lit(name)).alias("y"))
    pieces = [piece for x in ("x", "y") for piece in (F.shiftrightunsigned(x, 32), F.col(x).bitwiseAND(F.lit(0xFFFFFFFF)))]
    return both.select(key, F.lit(1).cast("bigint").alias("n"), *(p.alias(c) for p, c in zip(pieces, DIGEST_SUMS[1:], strict=True)))


def _digest_sums(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(*(F.sum(c).alias(c) for c in DIGEST_SUMS))


def changed_sites(stored: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """(site_id, state, fingerprint) of the sites that are new, changed or gone."""
    if stored is None:
        return fresh.select("site_id", F.lit("new").alias("state"), "fingerprint")
    old, new = (f.select("site_id", F.col("fingerprint").alias(n)) for f, n in ((stored, "old"), (fresh, "new")))
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "changed")
    both = old.join(new, "site_id", "full_outer").withColumn("state", state)
    return both.where("state IS NOT NULL").select("site_id", "state", F.col("new").alias("fingerprint"))


def refresh_documents(
    t: Tables,
    store: Store,
    *,
    paths: Sequence[str] | None = None,
    data_groups: Callable[[Tables, DataFrame], DataFrame] | None = None,
    slices: int,
) -> DataFrame:
    """Bring stored site documents up to date; returns (site_id, state) of what was done.

    Only sites whose fingerprint differs from the stored one are built, gone ones
    are taken out, and only the buckets of these sites are written. Documents
    and fingerprints change in one commit, so a run that fails can simply be
    run again. ``data_groups`` makes the long rows of some sites.
    """
    spark = t.spark
    rows = None if data_groups is None else data_groups(t, None)
    fresh = site_fingerprints(t, paths=paths, data_groups=rows)
    folder = f"{store.path}/changes/{uuid.uuid4().hex}"
    changed_sites(store.read(spark, "fingerprints"), fresh).write.parquet(folder)
    changes = spark.read.parquet(folder)
    built = changes.where("state <> 'gone'")
    if not changes.isEmpty():
        ids = built.select("site_id")
        rows = None if data_groups is None else data_groups(t, ids)
        documents = site_documents(t, ids, paths=paths, data_groups=rows, slices=slices)
        store.commit({"documents": documents, "fingerprints": built.select("site_id", "fingerprint")}, changes.select("site_id"))
    return changes.select("site_id", "state")


# The key that the elements of a document list carry.
LIST_KEYS = {
    "sample_groups": "sample_group_id",
    "physical_samples": "physical_sample_id",
    "datasets": "dataset_id",
    "analysis_entities": "analysis_entity_id",
}


def child_rows_of(documents: DataFrame, path: str, key: str = "site_id") -> DataFrame:
    """The elements at a path of lists, with the keys of the levels above.

    An element that has children of its own comes once for each slice that
    holds some of them.
    """
    keys, item = [key], None
    *above, last = path.split(".")
    rows = documents
    for name in above:
        column = F.col(name) if item is None else F.col(f"item.{name}")
        rows = rows.select(*keys, F.explode(column).alias("item"))
        own = LIST_KEYS[name]
        rows, item = rows.select(*keys, F.col(f"item.{own}").alias(own), "item"), name
        keys.append(own)
    rows = rows.select(*keys, F.explode(last if item is None else f"item.{last}").alias("item"))
    kind = rows.schema["item"].dataType
    if not isinstance(kind, T.StructType):
        return rows.withColumnRenamed("item", last)
    return rows.select(*keys, *[f"item.{f}" for f in kind.fieldNames() if f not in keys])


def _together(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key from its slices: its own fields, and the length of every list.

    Of elements that may lie in several slices the home one counts.
    """
    out = []
    for field in rows.schema.fields:
        if field.name in keys or field.name == "is_home":
            continue
        if not isinstance(field.dataType, T.ArrayType):
            out.append(F.max(field.name).alias(field.name))
            continue
        inner, column = field.dataType.elementType, F.col(field.name)
        if isinstance(inner, T.StructType) and "is_home" in inner.fieldNames():
            column = F.filter(column, lambda x: x.is_home)
        out.append(F.sum(F.size(column)).cast("bigint").alias(field.name))
    return rows.groupBy(*keys).agg(*out)


def site_rows_of(documents: DataFrame) -> DataFrame:
    """One row per site, with the lengths of its lists."""
    return _together(documents.drop(PART, PARTS), ["site_id"])


def group_rows_of(documents: DataFrame) -> DataFrame:
    """One row per sample group, with the lengths of its lists."""
    return _together(child_rows_of(documents, "sample_groups"), ["site_id", "sample_group_id"])


def sample_rows_of(documents: DataFrame) -> DataFrame:
    """One row per sample, with the lengths of its lists."""
    rows = child_rows_of(documents, "sample_groups.physical_samples")
    return _together(rows, ["site_id", "sample_group_id", "physical_sample_id"])


def dataset_rows_of(documents: DataFrame) -> DataFrame:
    """One row per (site, dataset), with the number of its entities."""
    return _together(child_rows_of(documents, "datasets"), ["site_id", "dataset_id"])


def entity_rows_of(documents: DataFrame) -> DataFrame:
    """Documents back to one row per analysis entity; an entity lies in one slice."""
    return child_rows_of(documents, "datasets.analysis_entities")


def path_table(t: Tables, path: str, site_ids: SiteIds = None) -> DataFrame:
    """The rows that fill a list of the site document, with their site, from the flat tables.

    An unknown path, or one whose role is not bound, raises ``KeyError``.
    """
    *above, last = path.split(".")
    if path == "datasets":
        pairs = with_site(t, entities(t).select("sample_group_id", "dataset_id").distinct(), site_ids)
        return pairs.select("site_id", "dataset_id").distinct().join(t["dataset"], "dataset_id")
    if path == "datasets.analysis_entities":
        return with_site(t, entities(t), site_ids)
    if path == "location":
        return ids_of(t["site_location"], site_ids).join(t["location"], "location_id", "left")
    if not above:
        return ids_of(t["sample_group" if last == "sample_groups" else SITE_CHILDREN[last]], site_ids)
    if above == ["sample_groups"]:
        if last == "physical_samples":
            return sample_rows(t, "physical_sample", site_ids)
        return with_site(t, joined(t, GROUP_CHILDREN[last]), site_ids)
    if above == ["sample_groups", "physical_samples"]:
        return sample_rows(t, SAMPLE_CHILDREN[last], site_ids)
    raise KeyError(path)


def group_entities_by_dataset(
    rows: DataFrame, key: str = "dataset_id", *, slices: int
) -> DataFrame:
    """Entities re-homed under their dataset, in slices."""
    header = rows.select(key).distinct()
    return flat_documents(key, header, {"analysis_entities": rows}, slices)


def sample_datasets(t: Tables, sample_ids: SiteIds = None) -> DataFrame:
    """The entities of samples, grouped by sample and dataset, as flat rows."""
    rows = ids_of(entities(t), sample_ids, "physical_sample_id")
    named = t["dataset"].select("dataset_id", "dataset_name", "method_id")
    return rows.join(named, "dataset_id").select(
        "physical_sample_id", "dataset_id", "dataset_name", "method_id", "analysis_entity_id"
    )


def sample_group_datasets(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """Distinct (group, dataset) reached through the group's samples."""
    rows = entities(t).select("sample_group_id", "dataset_id")
    if site_ids is not None:
        rows = rows.join(groups(t, site_ids), "sample_group_id", "left_semi")
    return rows.distinct()


# The columns of sample children and group coordinates that refer to a lookup.
LOOKUP_COLUMNS = {
    "dimension_id": "dimension",
    "coordinate_method_id": "method",
    "method_id": "method",
    "unit_id": "unit",
    "horizon_id": "horizon",
}


def site_lookups(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """Distinct (site, kind, id) of every lookup entry a site refers to."""
    owned = of_methods(t, site_datasets(t, site_ids)).select("site_id", "method_id").distinct()
    group = ids_of(t["sample_group"], site_ids)
    units = owned.join(methods(t).select("method_id", "unit_id"), "method_id")

    def entries(df: DataFrame, kind: str, column: str) -> DataFrame:
        return df.select(
            "site_id", F.lit(kind).alias("kind"), F.col(column).cast("bigint").alias("id")
        )

    parts = [
        entries(owned, "method", "method_id"),
        entries(group.select("site_id", "method_id").distinct(), "method", "method_id"),
        entries(units, "unit", "unit_id"),
    ]
    if "prep_method" in t:
        prep = t["prep_method"]
        if "sample_group_id" not in prep.columns:
            keys = entities(t).select("analysis_entity_id", "sample_group_id")
            prep = prep.join(keys, "analysis_entity_id")
        prep = prep.select("sample_group_id", "method_id").distinct()
        parts.append(entries(with_site(t, prep, site_ids), "prep_method", "method_id"))
    for role in ("sample_coordinate", "sample_dimension", "sample_horizon", "sample_group_coordinate"):
        if role not in t:
            continue
        if role.startswith("sample_group"):
            rows = with_site(t, joined(t, role), site_ids)
        else:
            rows = sample_rows(t, role, site_ids)
        # All codes of a row in one pass; the distinct below combines them on the map side.
        codes = [
            F.struct(F.lit(kind).alias("kind"), F.col(column).cast("bigint").alias("id"))
            for column, kind in LOOKUP_COLUMNS.items()
            if column in rows.columns
        ]
        if codes:
            parts.append(rows.select("site_id", F.inline(F.array(*codes))))
    if "dataset_contact" in t:
        contact = site_datasets(t, site_ids).join(t["dataset_contact"], "dataset_id")
        parts.append(entries(contact, "contact", "contact_id"))
    return stack(parts).where("id IS NOT NULL").distinct()


BIBLIO_FIELDS = (
    "title", "year", "authors", "full_reference", "doi", "isbn", "url", "notes",
)


def site_biblio_lookup(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """One record per (site, reference): the one with the most fields filled.

    Ties go to the site's own record, then the group's, then the dataset's.
    """
    sources = [
        (0, ids_of(t["site_reference"], site_ids)),
        (1, with_site(t, t["group_reference"], site_ids)),
        (2, t["dataset_reference"].join(site_datasets(t, site_ids), "dataset_id")),
    ]
    fields = [f for f in BIBLIO_FIELDS if any(f in df.columns for _, df in sources)]
    empty = F.lit(None).cast("string")
    rows = None
    for order, df in sources:
        part = df.select(
            "site_id",
            "biblio_id",
            *[(F.col(f) if f in df.columns else empty).alias(f) for f in fields],
            F.lit(order).alias("source"),
        )
        rows = part if rows is None else rows.unionByName(part)
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    order = [-filled, F.col("source"), *[F.coalesce(f, F.lit("")) for f in fields]]
    return best_by(rows, ["site_id", "biblio_id"], order).drop("source")


def analysis_values(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """Keyed values with their class and value type."""
    classes = t["value_class"].select(
        "value_class_id", F.col("name").alias("class_name"), "value_type_id"
    )
    rows = value_facts(t, site_ids).join(classes, "value_class_id", "left")
    if "value_type" in t:
        rows = rows.join(t["value_type"], "value_type_id", "left")
    return rows


def datasets_extract(
    t: Tables,
    site_ids: SiteIds = None,
    method_ids: Sequence[int] = (),
    covered: DataFrame | None = None,
) -> DataFrame:
    """Entities of the chosen methods with sample names and numeric values.

    ``covered`` holds (site_id, dataset_id) pairs already delivered as data
    groups; they are left out.
    """
    rows = with_site(t, of_methods(t, entities(t), method_ids), site_ids)
    if covered is not None:
        rows = rows.join(covered, ["site_id", "dataset_id"], "left_anti")
    # Cut both sides by method before the join on the entity.
    measured = of_methods(t, leaf(t, "measured_value"), method_ids).select(
        "analysis_entity_id", leading_number(F.col("measured_value")).alias("measured_value")
    )
    names = t["physical_sample"].select("physical_sample_id", "sample_name")
    return (
        rows.join(measured, "analysis_entity_id", "left")
        .join(names, "physical_sample_id")
        .select(
            "site_id",
            "dataset_id",
            "method_id",
            "analysis_entity_id",
            "physical_sample_id",
            "sample_name",
            "measured_value",
        )
    )


def data_groups_extract(
    groups_table: DataFrame, site_ids: SiteIds, method_ids: Sequence[int]
) -> DataFrame:
    """Data-group rows of the chosen sites and methods, without gaps."""
    return ids_of(groups_table, site_ids).where(F.col("method_id").isin(list(method_ids)))


def ecocode_tree(t: Tables, taxon_ids: SiteIds = None, systems: Sequence[int] = (2, 3)) -> DataFrame:
    """Per taxon: code systems, their groups, and the distinct codes in each.

    Lists hold distinct codes, so their length is bounded by the code tables.
    """
    group = t["ecocode_group"].where(F.col("ecocode_system_id").isin(list(systems)))
    rows = (
        ids_of(t["ecocode"], taxon_ids, "taxon_id")
        .join(t["ecocode_definition"], "ecocode_definition_id")
        .join(group, "ecocode_group_id")
    )
    codes = rows.groupBy("taxon_id", "ecocode_system_id", "ecocode_group_id", "group_name").agg(
        F.sort_array(
            F.collect_set(F.struct("ecocode_definition_id", "abbreviation", "name"))
        ).alias("codes")
    )
    groups_of = codes.groupBy("taxon_id", "ecocode_system_id").agg(
        gather(F.struct("ecocode_group_id", "group_name", "codes")).alias("groups")
    )
    return groups_of.groupBy("taxon_id").agg(
        gather(F.struct("ecocode_system_id", "groups")).alias("ecocodes")
    )


def taxon_documents(
    t: Tables, taxon_ids: SiteIds = None, *, slices: int
) -> DataFrame:
    """One document per taxon: taxonomy, author, habitat codes and attribute lists."""
    own = ids_of(t["taxon"], taxon_ids, "taxon_id").select("taxon_id", "species", "author_id")
    ranks = taxonomy(t).drop("species", "author_id")
    header = (
        own.join(ranks, "taxon_id", "left")
        .join(t["taxon_author"], "author_id", "left")
        .join(ecocode_tree(t, taxon_ids), "taxon_id", "left")
    )
    children = {
        field: ids_of(joined(t, role), taxon_ids, "taxon_id")
        for field, role in TAXON_CHILDREN.items()
        if role in t
    }
    return flat_documents("taxon_id", header, children, slices)

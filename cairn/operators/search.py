"""Scored name search, weighted text search and document path search."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.semantics import best_by
from cairn.functions.text import (
    clean_query,
    count_folded,
    fold_text,
    free_terms,
    holds_folded,
    like_pattern,
    matches,
    query_terms,
    rank,
)
from cairn.operators.datagroups import abundance_lookups
from cairn.operators.documents import TAXON_CHILDREN, path_table, site_biblio_lookup
from cairn.operators.domains import domains
from cairn.operators.facts import (
    abundance_facts,
    entities,
    groups,
    joined,
    methods,
    of_methods,
    sample_rows,
    site_datasets,
)
from cairn.operators.paths import path_matches, schema_path
from cairn.operators.taxa import taxonomy
from cairn.operators.textindex import StoredIndex, candidates, gram_sets, indexed_scores
from cairn.sources.collections import is_collection, search_collection
from cairn.sources.tables import Tables

DEFAULT_LIMIT, MAX_LIMIT = 20, 50
# Pages that end within so many hits are picked from the first hits of every part, later ones by ranges.
HEAP_ROWS = 10_000
# Up to so many references that matter to a free-text query are named in a filter; of more all are read.
LISTED = 1_000

# The domains a search can be limited to.
SEARCH_DOMAINS = {
    "": None,
    "general": None,
    "palaeoentomology": {"method_ids": (3, 6)},
    "archaeobotany": {"method_ids": (4, 8)},
    "pollen": {"method_ids": (14, 15, 21)},
    "geoarchaeology": {"method_ids": (32, 33, 35, 36, 37, 94, 106)},
    "dendrochronology": {"method_ids": (10,)},
    "ceramic": {"method_ids": (172, 171)},
    "isotope": {"method_ids": (175,)},
    "adna": {"record_type": "DNA"},
}

# Scores of an exact, a prefix and a contained hit.
SITE_SCORES = (6.0, 3.0, 1.5)
NAME_SCORES = (4.5, 2.0, 1.2)
DESCRIPTION_SCORE = 0.6

HIT_COLUMNS = (
    "site_id", "site_name", "matched_value", "score", "is_exact", "is_prefix", "is_contains",
    "is_fts_only", "sample_group_id", "dataset_id", "method_id",
)


def _domain_method_ids(t: Tables, domain: str) -> DataFrame | None:
    """Methods of a search domain; None when the domain does not restrict."""
    code = (domain or "").strip().lower()
    if code not in SEARCH_DOMAINS:
        raise ValueError(f"unknown search domain {domain!r}")
    rule = SEARCH_DOMAINS[code]
    if rule is None:
        return None
    if "method_ids" in rule:
        return methods(t).where(F.col("method_id").isin(list(rule["method_ids"]))).select("method_id")
    types = t["record_type"].where(F.col("record_type_name") == rule["record_type"])
    return methods(t).join(types, "record_type_id", "left_semi").select("method_id")


def _entities_in_domain(t: Tables, wanted: DataFrame) -> DataFrame:
    datasets = t["dataset"].join(wanted, "method_id", "left_semi").select("dataset_id")
    rows = entities(t).select("sample_group_id", "dataset_id")
    return rows.join(datasets, "dataset_id", "left_semi")


class _Query:
    """Match columns of one cleaned query."""

    def __init__(self, text: str):
        self.text = text
        self.pattern = like_pattern(text)
        self.terms = query_terms(text)

    def exact(self, name: Column) -> Column:
        return F.lower(name) == F.lower(F.lit(self.text))

    def prefix(self, name: Column) -> Column:
        return F.lower(name).like(self.pattern.lower() + "%")

    def contains(self, name: Column) -> Column:
        return name.ilike(f"%{self.pattern}%")

    def holds(self, name: Column) -> Column:
        return matches(name, self.terms)

    def score(self, name: Column, scores: Sequence[float], label: str) -> Column:
        exact, prefix, contains = scores
        return (
            F.when(self.exact(name), exact).otherwise(0.0)
            + F.when(self.prefix(name), prefix).otherwise(0.0)
            + F.when(self.contains(name), contains).otherwise(0.0)
            + rank(name, self.terms, label)
        )


def _hits(
    rows: DataFrame,
    query: _Query,
    name: Column,
    scores: Sequence[float],
    label: str,
    description: Column | None = None,
) -> DataFrame:
    """Score and flag the rows that match by token or by substring.

    Plain columns are computed once, in a projection below the filter, so the
    text functions run one time per row.
    """
    n = F.col("_name")
    prefix, contains, holds = query.prefix(n), query.contains(n), query.holds(n)
    score = query.score(n, scores, label)
    matched = n
    cols = rows.withColumn("_name", F.coalesce(name, F.lit("")))
    if description is not None:
        cols = cols.withColumn("_text", F.coalesce(description, F.lit("")))
        d = F.col("_text")
        score = (
            score
            + F.when(query.contains(d), DESCRIPTION_SCORE).otherwise(0.0)
            + rank(d, query.terms, "C")
        )
        contains = contains | query.contains(d)
        holds = holds | query.holds(d)
        matched = F.trim(F.concat_ws(" ", n, d))
    found = cols.withColumn("_c", contains).withColumn("_h", holds).where("_c OR _h")
    scored = found.select(
        "site_id",
        F.coalesce("site_name", F.lit("")).alias("site_name"),
        matched.alias("matched_value"),
        score.alias("score"),
        query.exact(n).alias("is_exact"),
        (prefix & ~query.exact(n)).alias("is_prefix"),
        (F.col("_c") & ~prefix).alias("is_contains"),
        (F.col("_h") & ~F.col("_c")).alias("is_fts_only"),
        *[
            (F.col(c) if c in rows.columns else F.lit(None)).cast("bigint").alias(c)
            for c in ("sample_group_id", "dataset_id", "method_id")
        ],
    )
    return scored.where(F.col("score") > 0)


def _one_per_site(hits: DataFrame, item: str) -> DataFrame:
    return best_by(hits, ["site_id"], [-F.col("score"), F.col("matched_value"), F.col(item)])


def _site_names(t: Tables) -> DataFrame:
    return t["site"].select("site_id", "site_name")


def searchable_names(t: Tables) -> DataFrame:
    """(category, item, text): every name that :func:`search` looks at, for :func:`index_names`."""
    named = (
        ("sites", "site", "site_id", "site_name"),
        ("sample_groups", "sample_group", "sample_group_id", "sample_group_name"),
        ("sample_groups", "sample_group", "sample_group_id", "sample_group_description"),
        ("datasets", "dataset", "dataset_id", "dataset_name"),
        ("methods", "method", "method_id", "method_name"),
    )
    parts = [
        t[role].select(F.lit(category).alias("category"), F.col(key).cast("bigint").alias("item"), F.col(name).alias("text"))
        for category, role, key, name in named
    ]
    return reduce(DataFrame.unionByName, parts).where("text IS NOT NULL")


def _among(rows: DataFrame, items: DataFrame | None, key: str) -> DataFrame:
    """The rows that an index leaves to look at; all without one."""
    return rows if items is None else rows.join(items.select(F.col("item").alias(key)), key, "left_semi")


def _site_hits(t: Tables, query: _Query, wanted: DataFrame | None, items: DataFrame | None = None) -> DataFrame:
    rows = _among(_site_names(t).where("site_name IS NOT NULL"), items, "site_id")
    if wanted is not None:
        inside = _entities_in_domain(t, wanted).join(groups(t), "sample_group_id")
        rows = rows.join(inside.select("site_id"), "site_id", "left_semi")
    return _hits(rows, query, F.col("site_name"), SITE_SCORES, "A")


def _group_hits(t: Tables, query: _Query, wanted: DataFrame | None, items: DataFrame | None = None) -> DataFrame:
    rows = t["sample_group"].select(
        "sample_group_id", "site_id", "sample_group_name", "sample_group_description"
    )
    rows = _among(rows, items, "sample_group_id")
    if wanted is not None:
        rows = rows.join(
            _entities_in_domain(t, wanted).select("sample_group_id"),
            "sample_group_id",
            "left_semi",
        )
    # Site names join after the best group of each site is known.
    found = _hits(
        rows.withColumn("site_name", F.lit("")),
        query,
        F.col("sample_group_name"),
        NAME_SCORES,
        "B",
        F.col("sample_group_description"),
    )
    return _named(t, _one_per_site(found, "sample_group_id"))


def _named(t: Tables, hits: DataFrame) -> DataFrame:
    named = hits.drop("site_name").join(_site_names(t), "site_id")
    return named.withColumn("site_name", F.coalesce("site_name", F.lit(""))).select(*HIT_COLUMNS)


def _dataset_hits(t: Tables, query: _Query, wanted: DataFrame | None, items: DataFrame | None = None) -> DataFrame:
    # Score the dataset names first: the links only carry the few that match.
    datasets = _among(t["dataset"].where("dataset_name IS NOT NULL"), items, "dataset_id")
    if wanted is not None:
        datasets = datasets.join(wanted, "method_id", "left_semi")
    scored = _hits(
        datasets.select(
            "dataset_id", "dataset_name", F.lit(None).cast("bigint").alias("site_id"),
            F.lit("").alias("site_name"),
        ),
        query, F.col("dataset_name"), NAME_SCORES, "B",
    ).drop("site_id")
    rows = entities(t).select("sample_group_id", "dataset_id")
    links = (
        rows.join(scored.select("dataset_id"), "dataset_id", "left_semi")
        .join(groups(t), "sample_group_id")
        .select("site_id", "dataset_id")
        .distinct()
    )
    return _named(t, _one_per_site(links.join(scored, "dataset_id"), "dataset_id"))


def _method_hits(t: Tables, query: _Query, wanted: DataFrame | None, items: DataFrame | None = None) -> DataFrame:
    named = _among(t["method"].where("method_name IS NOT NULL"), items, "method_id")
    scored = _hits(
        named.select(
            "method_id", "method_name", F.lit(None).cast("bigint").alias("site_id"),
            F.lit("").alias("site_name"),
        ),
        query, F.col("method_name"), NAME_SCORES, "B",
    ).drop("site_id")
    links = of_methods(t, site_datasets(t)).select("site_id", "method_id")
    if wanted is not None:
        links = links.join(wanted, "method_id", "left_semi")
    else:
        links = links.union(
            t["sample_group"].where("method_id IS NOT NULL").select("site_id", "method_id")
        )
    pairs = links.distinct()
    return _named(t, _one_per_site(pairs.join(scored, "method_id"), "method_id"))


_CATEGORIES = {
    "sites": _site_hits,
    "sample_groups": _group_hits,
    "datasets": _dataset_hits,
    "methods": _method_hits,
}


_PLACE = (1 << 33) - 1


def _numbered(hits: DataFrame, order: list[Column]) -> DataFrame:
    """The hits with their partition and their place in it.

    The order ends with every column, which changes nothing, as it holds the
    whole order already; but so both the count of a partition and its rows need the same
    columns, and Spark computes the hits below once for both.
    """
    rest = [F.col(c) for c in hits.columns]
    rows = hits.sortWithinPartitions(*order, *rest).withColumn("_id", F.monotonically_increasing_id())
    return rows.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit(_PLACE))})


def _page(hits: DataFrame, order: list[Column], skipped: int, limit: int, heap_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows of a page and the number of all hits, from one pass over the hits.

    The hits, far fewer than the rows they are among, are dealt out once. An
    early page is among the first rows of every part. For a later one the hits
    are dealt by ranges of the order: the counts of the ranges, one small row a
    part, say in which of them the page lies. Names are neither counted nor
    numbered in one place.
    """
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = hits.repartition(parts, "site_id")
    end = skipped + limit
    early = end <= heap_rows
    if not early:
        dealt = dealt.repartitionByRange(parts, *order)
    rows = _numbered(dealt, order)
    counts = rows.groupBy("_part").agg(F.count("_id").alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total_count"))
    if early:
        return rows.where(F.col("_at") < end).select(*hits.columns).orderBy(*order).offset(skipped).limit(limit), total
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a part: their number is that of the partitions, whatever the hits.
    starts = counts.withColumn("_start", before).where((F.col("_start") < end) & (F.col("_start") + F.col("_n") > skipped))
    place = F.col("_start") + F.col("_at")
    paged = rows.join(F.broadcast(starts.select("_part", "_start")), "_part").where((place >= skipped) & (place < end))
    return paged.select(*hits.columns), total


def search(
    t: Tables,
    category: str,
    query: str,
    page: int = 1,
    limit: int = DEFAULT_LIMIT,
    domain: str = "",
    *,
    max_limit: int = MAX_LIMIT,
    heap_rows: int = HEAP_ROWS,
    index: StoredIndex | None = None,
) -> DataFrame:
    """One page of scored hits, each row with the totals of the whole result.

    A page has ``limit`` hits, ``max_limit`` at most. A page past the end is one
    row that holds only the totals.

    With an index of :func:`searchable_names` only the names that hold the
    trigrams of the query are looked at; the result is the same. A query
    with a part too short for a trigram looks at all names.
    """
    if category not in _CATEGORIES:
        raise ValueError(f"unknown search category {category!r}")
    text = clean_query(query)
    if len(text) < 2:
        raise ValueError("a search needs at least two characters")
    limit = min(max(int(limit), 1), max_limit)
    page = max(int(page), 1)
    wanted = _Query(text)
    sets = None if index is None else gram_sets(wanted.pattern, wanted.terms)
    items = None if sets is None else candidates(t.spark, index, category, sets)
    hits = _CATEGORIES[category](t, wanted, _domain_method_ids(t, domain), items)
    hits = hits.withColumn("score", F.round("score", 6))
    order = [F.desc("score"), F.asc("site_name"), F.asc("site_id")]
    skipped = (page - 1) * limit
    paged, total = _page(hits, order, skipped, limit, heap_rows)
    pages = F.ceil(F.col("total_count") / limit).cast("bigint")
    # `paged` holds at most `max_limit` rows and `total` exactly one.
    return (
        total.join(F.broadcast(paged), F.lit(True), "left")
        .withColumn("total_pages", pages)
        .withColumn("has_more", F.lit(page) < F.col("total_pages"))
        .select("total_count", "total_pages", "has_more", *HIT_COLUMNS)
        .orderBy(F.col("site_id").isNull(), *order)
    )


def site_texts(t: Tables, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """(site_id, weight, text): every searchable field of a site.

    Names that belong to a lookup (methods, taxa, datasets, references) appear
    once per site however often the site uses them. Tables that are not bound
    leave their fields out. With ``wanted`` texts that do not pass it may be left out:
    lookups are asked first, and one of which no text passes is not joined to its sites.
    """
    parts: list[DataFrame] = []

    # The weight of each field.
    def add(df: DataFrame, **weights: int) -> None:
        for column, weight in weights.items():
            if column in df.columns:
                text = F.col(column).alias("text")
                parts.append(df.select("site_id", F.lit(weight).alias("weight"), text))

    def passing(df: DataFrame, *columns: str) -> Column:
        """Whether a row has a text that passes."""
        named = [c for c in columns if c in df.columns]
        return F.lit(True) if wanted is None else reduce(lambda a, b: a | b, [F.coalesce(wanted(F.col(c)), F.lit(False)) for c in named], F.lit(False))

    def some(*asked: tuple[DataFrame, Sequence[str]]) -> bool:
        """Whether any row of any table has a text that passes; the first one found ends the search."""
        return wanted is None or any(not df.where(passing(df, *columns)).select(F.lit(1)).isEmpty() for df, columns in asked)

    add(t["site"], site_name=10, site_description=5, national_site_identifier=2)
    if "site_location" in t:
        add(t["site_location"].join(t["location"], "location_id"), location_name=5)
    if "site_reference" in t:
        add(t["site_reference"], title=10, authors=5, full_reference=5, isbn=2, year=2)
    if "group_reference" in t:
        fields = ("title", "isbn", "year", "authors", "full_reference")
        cited = t
        if wanted is not None:
            # A reference counts with one of its records, so it matters if any record has a text that passes.
            roles = {role: t[role] for role in ("site_reference", "group_reference", "dataset_reference")}
            found = reduce(DataFrame.union, [df.where(passing(df, *fields)).select("biblio_id") for df in roles.values()])
            ids = [r[0] for r in found.distinct().limit(LISTED + 1).collect()]
            if len(ids) <= LISTED:
                named = F.col("biblio_id").isin([i for i in ids if i is not None]) | (F.col("biblio_id").isNull() & F.lit(None in ids))
                cited = t.with_roles(**{role: df.where(named) for role, df in roles.items()}) if ids else None
        if cited is not None:
            add(site_biblio_lookup(cited), **dict.fromkeys(fields, 2))
    owned = site_datasets(t)
    if some((t["dataset"], ("dataset_name",))):
        add(owned.join(t["dataset"].select("dataset_id", "dataset_name"), "dataset_id"), dataset_name=10)
    if some((t["method"], ("method_name", "description"))):
        used = of_methods(t, owned).select("site_id", "method_id")
        sampling = t["sample_group"].select("site_id", "method_id")
        named = used.union(sampling).distinct().join(t["method"], "method_id")
        add(named, method_name=5, description=2)
        if "prep_method" in t:
            prep = t["prep_method"]
            if "sample_group_id" not in prep.columns:
                keys = entities(t).select("analysis_entity_id", "sample_group_id")
                prep = prep.join(keys, "analysis_entity_id")
            pairs = prep.select("sample_group_id", "method_id").distinct().join(groups(t), "sample_group_id")
            pairs = pairs.select("site_id", "method_id").distinct()
            add(pairs.join(t["method"], "method_id"), method_name=2, description=2)
    if "abundance" in t or "abundance_flat" in t:
        ranks = ("family_name", "genus_name", "order_name")
        taxa = taxonomy(t).select("taxon_id", *ranks)
        if some((taxa, ranks)):
            pairs = abundance_facts(t).select("site_id", "taxon_id").distinct()
            names = taxa.select("taxon_id", F.explode(F.array(*ranks)).alias("name"))
            add(pairs.join(names, "taxon_id").select("site_id", "name").distinct(), name=5)
        if some((t["abundance_element"], ("element_name",)), (t["modification"], ("modification_type_name",))):
            add(abundance_lookups(t), name=2)
    if "sample_feature" in t:
        if some((joined(t, "sample_feature"), ("feature_type_name",))):
            add(sample_rows(t, "sample_feature"), feature_type_name=8)
    if "domain_clause" in t:
        # The titles of all domains belong to every site: one text of a few words.
        titles = domains(t).agg(F.concat_ws(" ", F.sort_array(F.collect_set("title"))).alias("titles"))
        add(t["site"].select("site_id").crossJoin(F.broadcast(titles)), titles=5)
    texts = parts[0]
    for part in parts[1:]:
        texts = texts.union(part)
    return texts.where("text IS NOT NULL AND text <> ''")


def _matters(query: str) -> Callable[[Column], Column]:
    """Whether a text has a part in the score of a site or speaks against it."""
    words, _, unwanted = free_terms(query)

    def test(text: Column) -> Column:
        folded = fold_text(text)
        return reduce(lambda a, p: a | holds_folded(folded, p), unwanted, count_folded(folded, words) > 0)

    return test


def scanned_scores(texts: DataFrame, query: str) -> DataFrame:
    """(site_id, score) of the sites that a free-text query finds, by a scan of all texts."""
    words, phrases, unwanted = free_terms(query)
    rows = texts.select("site_id", "weight", fold_text(F.col("text")).alias("text"))
    text = F.col("text")
    flags = {f"has{i}": holds_folded(text, p) for i, p in enumerate(phrases)}
    flags |= {f"not{i}": holds_folded(text, p) for i, p in enumerate(unwanted)}
    marked = rows.withColumns({"hits": count_folded(text, words), **flags})
    some = " OR ".join(["hits > 0", *[f for f in flags if f.startswith("not")]])
    sites = marked.where(some).groupBy("site_id").agg(
        F.sum(F.col("hits") * F.col("weight")).cast("bigint").alias("score"),
        *[F.bool_or(f).alias(f) for f in flags],
    )
    wanted = " AND ".join(["score > 0", *[f if f.startswith("has") else f"NOT {f}" for f in flags]])
    return sites.where(wanted).select("site_id", "score")


def free_text(
    t: Tables, query: str, k: int = 50, texts: DataFrame | None = None, index: StoredIndex | None = None
) -> DataFrame:
    """The k sites with the largest weighted term count, accents ignored.

    The score of a site adds, over its fields, the field weight times the
    occurrences of any query word. Every quoted phrase must stand in one of its
    fields, and nothing with a leading minus may. All is summed on the map side
    per site. With an index of the texts only the postings of the query's own
    words are read; the result is the same.
    """
    if index is not None:
        sites = indexed_scores(t.spark, index, query)
    else:
        sites = scanned_scores(site_texts(t, _matters(query)) if texts is None else texts, query)
    best = sites.orderBy(F.desc("score"), "site_id").limit(k)
    return (
        best.join(_site_names(t), "site_id", "left")
        .select("site_id", "site_name", "score")
        .orderBy(F.desc("score"), "site_id")
    )


def path_test(value: str) -> tuple[str, object]:
    """Comparison and typed value of a path search.

    The prefixes are tried once each, in this order, and the last one found
    decides. A leading integer makes the value an integer.
    """
    operator = "eq"
    text = str(value)
    for prefix, name in (("not:", "ne"), ("gt:", "gt"), ("lt:", "lt")):
        if text.startswith(prefix):
            operator, text = name, text[len(prefix) :]
    whole = re.match(r"\s*([+-]?\d+)", text)
    if whole:
        return operator, int(whole.group(1))
    number = re.match(r"\s*([+-]?\.\d+(?:[eE][+-]?\d+)?)", text)
    return operator, float(number.group(1)) if number else text


def search_documents(documents: DataFrame, key: str, path: str, value: str) -> DataFrame:
    """Ids of the documents whose value at ``path`` passes the test.

    Through arrays one passing value is enough; "not" wants no value that is
    equal. A document may be spread over several parts, so the parts vote. A
    collection read without a schema is searched by its values.
    """
    operator, wanted = path_test(value)
    if is_collection(documents):
        return search_collection(documents, key, path, operator, wanted)
    kind, names = schema_path(documents, path)
    first = F.col(path.split(".")[0])
    hit = (
        F.lit(False)
        if kind is None
        else path_matches(kind, first, names, ("eq" if operator == "ne" else operator, wanted))
    )
    votes = documents.select(F.col(key).alias("id"), F.coalesce(hit, F.lit(False)).alias("hit"))
    # bool_or combines on the map side; a document of one part is one row.
    found = votes.groupBy("id").agg(F.bool_or("hit").alias("hit"))
    return found.where(~F.col("hit") if operator == "ne" else F.col("hit")).select("id")


def _by_rows(owners: DataFrame, rows: DataFrame | None, key: str, field: str, value: str) -> DataFrame:
    """Ids of the owners one of whose rows passes the test, or none for "not"."""
    operator, wanted = path_test(value)
    hit = F.lit(False)
    if rows is not None and field in rows.columns:
        test = ("eq" if operator == "ne" else operator, wanted)
        hit = path_matches(rows.schema[field].dataType, F.col(field), [], test)
    ids = owners.select(F.col(key).alias("id")).distinct()
    if rows is None:
        return ids if operator == "ne" else ids.where("false")
    found = rows.where(hit).select(F.col(key).alias("id"))
    return ids.join(found, "id", "left_anti" if operator == "ne" else "left_semi")


def search_sites(source: Tables | DataFrame, path: str, value: str) -> DataFrame:
    """Sites by the value at a document path.

    From tables, only the one flat table that fills the path is read; documents
    read from storage are tested as they are.
    """
    if isinstance(source, DataFrame):
        return search_documents(source, "site_id", path, value)
    above, _, field = path.rpartition(".")
    try:
        rows = path_table(source, above) if above else source["site"]
    except KeyError:
        rows = None
    return _by_rows(source["site"], rows, "site_id", field, value)


def search_taxa(source: Tables | DataFrame, path: str, value: str) -> DataFrame:
    """Taxa by the value at a document path, as :func:`search_sites`."""
    if isinstance(source, DataFrame):
        return search_documents(source, "taxon_id", path, value)
    above, _, field = path.rpartition(".")
    if above:
        role = TAXON_CHILDREN.get(above)
        rows = source[role] if role in source else None
    else:
        rows = taxonomy(source)
    return _by_rows(source["taxon"], rows, "taxon_id", field, value)


__all__ = [
    "free_text",
    "path_test",
    "search",
    "search_documents",
    "search_sites",
    "search_taxa",
    "searchable_names",
    "site_texts",
]

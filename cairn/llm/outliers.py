"""Quality rules: robust multivariate outliers by language and source.

Every text gives a vector of transformed statistics: log words, log mean word length, log symbols a hundred words,
and the square roots of the shares of repeated lines and of words in repeated three-word windows. For each language
and source a minimum-covariance-determinant estimate is found by concentration steps: center and covariance
of the ``part`` of the documents that are nearest by the last estimate. There are four starts: medians and quartile distances;
mean and covariance of all; and medians with the correlations of the standardized vectors' hyperbolic tangents, and of their
directions. Each takes ``trials`` steps, the one with the smallest determinant (of equal ones the first) goes on for ``steps``
more. A document whose squared Mahalanobis distance passes ``cut``, the 99.9 % quantile
of a chi-square with five degrees of freedom, is rejected, besides those that fail the base rules. Distances are
scaled so that the group's median is that of the chi-square, which makes up for the spread of a nearest part being
too small. They are never scaled up: where a statistic is the same in most texts the median is that of fewer degrees.

Values are counted in steps of 1/512, so all sums are exact whole numbers and reruns agree to the bit. No value passes 26,
as a text has less than 2^31 characters, so a sum of squares fits a long for over 5 * 10^10 documents. Floors on
the standard deviations keep estimates regular where a statistic is the same in most texts. For symbols and repeats
they are as small as they can be for the least a text of 50 words can have (one symbol, one repeated line, one
repeated run of three words) to be kept where no other text has any; that for log words makes up for the nearest part's
small spread where lengths are all that differs.

Every source has an estimate of its own, as have every language and all rows. Center, covariance and scale of a source with
n documents are drawn towards those of its language, and a language's towards those of all rows: its own part is
n / (n + ``pull``), with a fifth of ``pull`` for the center (one value a dimension, not five). It grows steadily
from 0 towards 1, with no size at which the rule changes.
Distances are sorted into bins of a sixteenth of an octave, so selecting the nearest part is an aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.jobs import cut, text_column

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STEPS = 512
DIMENSIONS = ("x0", "x1", "x2", "x3", "x4")
#: Median of a chi-square with five degrees of freedom.
MEDIAN = 4.351


@dataclass(frozen=True)
class Robust:
    part: float = 0.75
    trials: int = 2
    steps: int = 3
    cut: float = 20.515
    pull: float = 20.0
    floors: tuple[float, ...] = (0.3, 0.02, 0.25, 0.032, 0.08)
    groups_to_send: int = 20_000


def _near() -> Column:
    """Entries of ``sorted`` (40 bits of a window's digest above its place) that agree with a neighbour in the digest."""
    return F.filter(
        "sorted",
        lambda x, i: (F.when(i > 0, F.shiftrightunsigned(x.bitwiseXOR(F.get("sorted", i - 1)), 24) == 0).otherwise(False))
        | (F.when(i < F.size("sorted") - 1, F.shiftrightunsigned(x.bitwiseXOR(F.get("sorted", i + 1)), 24) == 0).otherwise(False)),
    )


def statistics(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """``keep``, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every row; null text counts as empty."""
    whole = text_column(text)
    frame = docs.select(
        *keep,
        F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.translate(whole, SPACE, "").alias("bare"),
        F.filter(F.split(whole, "\n"), lambda line: F.length(F.translate(line, SPACE, "")) > 0).alias("lines"),
    )
    names = [c for c in frame.columns if c not in ("words", "bare", "lines")]
    window = lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))
    low = (1 << 24) - 1
    frame = frame.select(
        *names,
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length("bare").cast("long").alias("word_chars"),
        (F.length("bare") - F.length(F.translate("bare", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(
            F.transform(
                F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))),
                lambda w, i: window(w, i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")),
            )
        ).alias("sorted"),
    )
    names += ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    frame = frame.select(*names, "words", F.when(F.col("n_words") <= low, _near()).otherwise(F.col("sorted")).alias("near"))
    # Places above 2^24 are not in the packed digests, so such a text compares all its windows.
    places = F.when(F.col("n_words") <= low, F.transform("near", lambda x: x.bitwiseAND(F.lit(low)).cast("int"))).otherwise(
        F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0)))
    )
    frame = frame.select(*names, "words", places.alias("places"))
    frame = frame.select(
        *names,
        F.array_sort(F.transform("places", lambda i: F.struct(window(F.get("words", i), i).alias("h"), i.alias("i")))).alias("entries"),
    )
    same = lambda e, i, j: F.coalesce(F.get("entries", i)["h"] == F.get("entries", j)["h"], F.lit(False))
    frame = frame.select(
        *names,
        F.array_sort(
            F.transform(F.filter("entries", lambda e, i: same(e, i, i - 1) | same(e, i, i + 1)), lambda e: e["i"])
        ).alias("places"),
    )
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return frame.select(*names, covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    values = (
        F.log(n.cast("double")),
        F.log1p(F.col("word_chars") / n),
        F.log1p(F.lit(100.0) * F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    )
    return [F.round(v * STEPS).cast("long").alias(d) for v, d in zip(values, DIMENSIONS, strict=True)]


def _moments(dimensions: tuple[str, ...] = DIMENSIONS, mark: str = "") -> list[tuple[str, Column]]:
    found = []
    for i, a in enumerate(dimensions):
        found.append((f"{mark}s{i}", F.col(a)))
        found += [(f"{mark}s{i}{j}", F.col(a) * F.col(dimensions[j])) for j in range(i + 1)]
    return found


def _summed(mark: str = "") -> list[Column]:
    """Means and covariances, without floors, of what :func:`_moments` gave, in units and not in steps."""
    size, n = range(len(DIMENSIONS)), F.col("n")
    found = [(F.col(f"{mark}s{i}") / n / STEPS).alias(f"{mark}m{i}") for i in size]
    found += [
        (F.col(f"{mark}s{i}{j}") / n / (STEPS * STEPS) - F.col(f"{mark}s{i}") / n / STEPS * (F.col(f"{mark}s{j}") / n / STEPS)).alias(f"{mark}c{i}{j}")
        for i in size for j in range(i + 1)
    ]
    return found


def _floored(how: Robust, entry) -> list[Column]:
    """Covariances from ``entry(i, j)``, with the floors on the diagonal."""
    size = range(len(DIMENSIONS))
    return [(entry(i, j) + how.floors[i] ** 2 if i == j else entry(i, j)).alias(f"c{i}{j}") for i in size for j in range(i + 1)]


def _inverse(frame: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the rows u{i}{j} of the inverted Cholesky factor of the covariance c{i}{j}, one entry after another."""
    size = len(DIMENSIONS)
    rest = lambda i, j: F.col(f"c{i}{j}") - reduce(lambda t, k: t + F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.lit(0.0))
    for j in range(size):
        frame = frame.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest(j, j), F.lit(1e-12))))
        frame = frame.withColumns({f"l{i}{j}": rest(i, j) / F.col(f"l{j}{j}") for i in range(j + 1, size)})
    for below in range(size):
        rows = {}
        for i in range(below, size):
            j = i - below
            sums = reduce(lambda t, k: t + F.col(f"l{i}{k}") * F.col(f"u{k}{j}"), range(j, i), F.lit(0.0))  # noqa: B023
            rows[f"u{i}{j}"] = (F.lit(1.0) if i == j else -sums) / F.col(f"l{i}{i}")
        frame = frame.withColumns(rows)
    return frame.select(*keep, *(f"u{i}{j}" for i in range(size) for j in range(i + 1)))


def _centers() -> list[str]:
    return [f"m{i}" for i in range(len(DIMENSIONS))]


def _covariances() -> list[str]:
    return [f"c{i}{j}" for i in range(len(DIMENSIONS)) for j in range(i + 1)]


def _distance() -> Column:
    size = len(DIMENSIONS)
    parts = [
        reduce(lambda t, j: t + F.col(f"u{i}{j}") * (F.col(DIMENSIONS[j]) / STEPS - F.col(f"m{j}")), range(i + 1), F.lit(0.0)) for i in range(size)
    ]
    return reduce(lambda t, p: t + p * p, parts, F.lit(0.0))


def _bin(distance: Column) -> Column:
    return F.floor(F.lit(16.0) * F.log2(F.lit(1.0) + distance)).cast("int")


def _middles(vectors: DataFrame, how: Robust) -> DataFrame:
    """Medians m{i}, and standard deviations d{i} from quartile distances and floors, of each group."""
    found = vectors.groupBy("group").agg(*(F.percentile(d, [0.25, 0.5, 0.75]).alias(f"q{i}") for i, d in enumerate(DIMENSIONS)))
    size = range(len(DIMENSIONS))
    spread = [F.sqrt(((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / STEPS / 1.349) ** 2 + F.lit(how.floors[i] ** 2)).alias(f"d{i}") for i in size]
    return found.select("group", *((F.col(f"q{i}")[1] / STEPS).alias(f"m{i}") for i in size), *spread)


def _starts(vectors: DataFrame, middles: DataFrame, how: Robust) -> DataFrame:
    """The four first estimates of each group, numbered by ``start``."""
    size = range(len(DIMENSIONS))
    known = [*_centers(), *(f"d{i}" for i in size)]
    frame = vectors.join(middles, "group").select("*", *(((F.col(DIMENSIONS[i]) / STEPS - F.col(f"m{i}")) / F.col(f"d{i}")).alias(f"z{i}") for i in size))
    length = F.sqrt(reduce(lambda t, i: t + F.col(f"z{i}") ** 2, size, F.lit(0.0)))
    frame = frame.withColumn("length", F.when(length > 0, length).otherwise(F.lit(1.0)))
    whole = lambda c: F.round(c * STEPS).cast("long")
    frame = frame.select("*", *(whole(F.tanh(f"z{i}")).alias(f"t{i}") for i in size), *(whole(F.col(f"z{i}") / F.col("length")).alias(f"g{i}") for i in size))
    sums = [*_moments(), *_moments(tuple(f"t{i}" for i in size), "t"), *_moments(tuple(f"g{i}" for i in size), "g")]
    found = frame.groupBy("group", *known).agg(F.count("*").alias("n"), *(F.sum(c).alias(name) for name, c in sums))
    d = lambda i: F.col(f"d{i}")
    found = cut(found.select("group", *known, *(c.alias(f"w{name}") for name, c in zip([*_centers(), *_covariances()], _summed(), strict=True)), *_summed("t"), *_summed("g")))

    def related(mark: str):
        def entry(i: int, j: int) -> Column:
            if i == j:
                return d(i) ** 2
            both = F.col(f"{mark}c{i}{i}") * F.col(f"{mark}c{j}{j}")
            return F.when(both > 0, d(i) * d(j) * F.col(f"{mark}c{i}{j}") / F.sqrt(both)).otherwise(F.lit(0.0))

        return entry

    def start(number: int, centers: list[Column], entry) -> DataFrame:
        return found.select("group", F.lit(number).alias("start"), *(c.alias(f"m{i}") for i, c in enumerate(centers)), *_floored(how, entry))

    medians = [F.col(m) for m in _centers()]
    all_ = reduce(
        DataFrame.unionByName,
        [
            start(0, medians, lambda i, j: d(i) ** 2 - F.lit(how.floors[i] ** 2) if i == j else F.lit(0.0)),
            start(1, [F.col(f"wm{i}") for i in size], lambda i, j: F.col(f"wc{i}{j}")),
            start(2, medians, related("t")),
            start(3, medians, related("g")),
        ],
    )
    return _inverse(all_, "group", "start", *_centers())


def _binned(vectors: DataFrame, estimate: DataFrame) -> DataFrame:
    """Counts and moments of the distance bins of each group's starts, with the rows before and in the group."""
    found = vectors.join(estimate, "group").withColumn("bin", _bin(_distance()))
    found = found.groupBy("group", "start", "bin").agg(F.count("*").alias("n"), *(F.sum(c).alias(n) for n, c in _moments()))
    of = Window.partitionBy("group", "start")
    order = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn("rows", F.sum("n").over(of))


def _concentrated(binned: DataFrame, how: Robust) -> DataFrame:
    """Center and covariance of the nearest part of each group, by start."""
    nearest = binned.where(F.col("before") < F.lit(how.part) * F.col("rows"))
    found = nearest.groupBy("group", "start").agg(F.sum("n").alias("n"), *(F.sum(n).alias(n) for n, _ in _moments()))
    found = found.select("group", "start", *_summed())
    found = found.select("group", "start", *_centers(), *_floored(how, lambda i, j: F.col(f"c{i}{j}")))
    return _inverse(found, "group", "start", *_centers(), *_covariances())


def _smallest(estimates: DataFrame) -> DataFrame:
    """Of each group's estimates the one with the smallest determinant, of equal ones the first."""
    determinant = reduce(lambda t, i: t - F.log(F.col(f"u{i}{i}")), range(len(DIMENSIONS)), F.lit(0.0))
    best = F.min_by(F.struct("*"), F.struct(determinant.alias("determinant"), "start")).alias("best")
    return estimates.groupBy(F.col("group").alias("of")).agg(best).select("best.*")


def _drawn(own: DataFrame, wider: DataFrame, how: Robust) -> DataFrame:
    """``own`` (one level's groups) with its values drawn towards those of the group ``above`` in ``wider``."""
    names = [*_centers(), *_covariances(), "scale"]
    n = F.col("rows")
    part = lambda pull: n / (n + F.lit(pull))
    parts = {c: part(how.pull / len(DIMENSIONS) if c in _centers() else how.pull) for c in names}
    wider = wider.select(F.col("group").alias("above"), *(F.col(c).alias(f"w_{c}") for c in names))
    return own.join(wider, "above").select(
        "group", "rows", *((parts[c] * F.col(c) + (1 - parts[c]) * F.col(f"w_{c}")).alias(c) for c in names)
    )


def outliers(docs: DataFrame, how: Robust = Robust(), id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) of every row.

    A null text is empty and fails the base rules. Null languages and sources are groups of their own.
    Estimates use the rows that pass the base rules; ``distance`` is null for the others. Repeated rows
    count as often as they stand. Other columns are not read. An empty table gives an empty result.
    """
    frame = statistics(docs, text, F.col(id).alias("id"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    frame = cut(frame.withColumn("base_failed", base_failed()))
    levels = {
        "group": F.concat(F.lit("source"), F.to_json(F.struct("lang", "source"))),
        "above": F.concat(F.lit("lang"), F.to_json(F.struct("lang"))),
    }
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    vectors = frame.select("id", *counts, levels["group"].alias("group"), *_vector())
    passed = frame.where("not base_failed")
    every = F.explode(F.array(*levels.values(), F.lit("all"))).alias("group")
    judged = passed.select(*_vector(), every)
    middles = cut(_middles(judged, how))
    many = middles.count()

    def sent(side: DataFrame) -> DataFrame:
        """A few rows for each group; sent to all tasks up to a fixed number of groups, else joined."""
        return F.broadcast(side) if many <= how.groups_to_send else side

    estimate = cut(_starts(judged, sent(middles), how))
    for _ in range(how.trials):
        estimate = cut(_concentrated(_binned(judged, sent(estimate)), how))
    estimate = cut(_smallest(estimate))
    for _ in range(how.steps):
        estimate = cut(_concentrated(_binned(judged, sent(estimate)), how))
    middle = _binned(judged, sent(estimate)).where("2 * before <= rows").groupBy("group").agg(F.max("bin").alias("bin"), F.max("rows").alias("rows"))
    scale = F.greatest((F.pow(F.lit(2.0), (F.col("bin") + 0.5) / 16) - 1) / F.lit(MEDIAN), F.lit(1.0)).alias("scale")
    own = cut(estimate.join(middle.select("group", "rows", scale), "group").select("group", "rows", *_centers(), *_covariances(), "scale"))
    widest = own.where("group = 'all'")
    languages = _drawn(own.where("group like 'lang%'").withColumn("above", F.when(F.col("group").startswith("lang"), "all")), widest, how)
    pairs = passed.groupBy("lang", "source").agg(F.lit(1)).select(levels["group"].alias("group"), levels["above"].alias("above"))
    sources = _drawn(own.join(pairs, "group"), languages, how)
    estimate = cut(_inverse(sources, "group", *_centers(), "scale"))
    distance = F.when(~F.col("base_failed"), _distance() / F.col("scale"))
    judged = vectors.join(sent(estimate), "group", "left").withColumn("distance", distance)
    return judged.select(
        F.col("id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= how.cut)).alias("kept"), "distance",
    )

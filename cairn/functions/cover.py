"""Cover density: how often and how densely a text satisfies a query, as column expressions.

The tokens of a text that the query names are its entries, in order. A run of
entries is a cover if it satisfies the query and no shorter run with the same
end does; after a cover, the search goes on behind the cover's first entry. A
cover adds 1 / (1 + other tokens in it).

Without excluded terms one sweep finds all covers: at every entry the latest
begin of a run that satisfies the query is the least, over the terms of an
alternative, of the begins of their last occurrences, and the best of the
alternatives counts; a cover ends wherever that begin moves on. With excluded
terms a run can also become too long, so covers are looked for one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = -1
FAR = 2**31 - 1


def entries_of(tokens: Column, named: Sequence[str]) -> Column:
    """(place among the entries, position in the text, token) of the named tokens."""
    placed = F.transform(tokens, lambda x, i: F.struct(i.alias("pos"), x.alias("token")))
    held = F.filter(placed, lambda e: e["token"].isin(list(named)))
    return F.transform(held, lambda e, k: F.struct(k.alias("k"), e["pos"].alias("pos"), e["token"].alias("token")))


def _ends_here(entries: Column, entry: Column, tokens: Sequence[str]) -> Column:
    """Whether the last of the tokens, which must follow each other, is at this entry."""
    hit = entry["token"] == tokens[-1]
    for back in range(1, len(tokens)):
        earlier = F.get(entries, entry["k"] - back)
        hit = hit & (earlier["token"] == tokens[-1 - back]) & (earlier["pos"] == entry["pos"] - back)
    return F.coalesce(hit, F.lit(False))


def _worth(entries: Column, begin: Column, end: Column) -> Column:
    """1 / (1 + tokens between two entries that are no entries)."""
    span = F.get(entries, end)["pos"] - F.get(entries, begin)["pos"]
    return F.lit(1.0) / (F.lit(1) + span - (end - begin))


def _least(values: list[Column]) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def _greatest(values: list[Column]) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


def swept_covers(entries: Column, alternatives: Sequence[Sequence[tuple[str, ...]]]) -> Column:
    """Sum over the covers of alternatives of terms that must all hold."""
    terms = list(dict.fromkeys(t for terms in alternatives for t in terms))
    start = F.struct(
        *(F.lit(NONE).alias(f"t{j}") for j in range(len(terms))), F.lit(NONE).alias("begin"), F.lit(0.0).alias("sum")
    )

    def step(state: Column, entry: Column) -> Column:
        last = [
            F.when(_ends_here(entries, entry, term), entry["k"] - (len(term) - 1)).otherwise(state[f"t{j}"])
            for j, term in enumerate(terms)
        ]
        begin = _greatest([_least([last[terms.index(t)] for t in wanted]) for wanted in alternatives])
        more = F.when(begin > state["begin"], _worth(entries, begin, entry["k"])).otherwise(F.lit(0.0))
        return F.struct(
            *(column.alias(f"t{j}") for j, column in enumerate(last)), begin.alias("begin"), (state["sum"] + more).alias("sum")
        )

    return F.aggregate(entries, start, step, lambda state: state["sum"])


def searched_covers(
    entries: Column, alternatives: Sequence[tuple[Sequence[tuple[str, ...]], Sequence[tuple[str, ...]]]]
) -> Column:
    """Sum over the covers of alternatives of (wanted, unwanted) terms, one cover after the other."""

    def found(term: tuple[str, ...]) -> Column:
        ends = F.filter(entries, lambda e: _ends_here(entries, e, term))
        return F.transform(ends, lambda e: F.struct((e["k"] - (len(term) - 1)).alias("b"), e["k"].alias("e")))

    def first_end(term: tuple[str, ...], start: Column) -> Column:
        ends = F.transform(F.filter(found(term), lambda o: o["b"] >= start), lambda o: o["e"])
        return F.coalesce(F.array_min(ends), F.lit(FAR))

    def last_begin(term: tuple[str, ...], end: Column) -> Column:
        begins = F.transform(F.filter(found(term), lambda o: o["e"] <= end), lambda o: o["b"])
        return F.coalesce(F.array_max(begins), F.lit(NONE))

    def end_of(wanted: Sequence, unwanted: Sequence, start: Column) -> Column:
        """The end of the shortest run from a start that satisfies an alternative."""
        end = _greatest([start, *(first_end(t, start) for t in wanted)])
        if not unwanted:
            return end
        return F.when(end < _least([first_end(t, start) for t in unwanted]), end).otherwise(F.lit(FAR))

    def begin_of(wanted: Sequence, unwanted: Sequence, end: Column) -> Column:
        """The begin of the shortest run up to an end that satisfies an alternative."""
        begin = _least([end, *(last_begin(t, end) for t in wanted)])
        if not unwanted:
            return begin
        return F.when(begin > _greatest([last_begin(t, end) for t in unwanted]), begin).otherwise(F.lit(NONE))

    def step(state: Column, _: Column) -> Column:
        end = _least([end_of(w, u, state["start"]) for w, u in alternatives])
        open_ = F.struct(state["start"].alias("start"), state["sum"].alias("sum"), end.alias("end"))

        def cover(s: Column) -> Column:
            begin = _greatest([begin_of(w, u, s["end"]) for w, u in alternatives])
            moved = F.struct((begin + 1).alias("start"), (s["sum"] + _worth(entries, begin, s["end"])).alias("sum"))
            stopped = F.struct(F.lit(FAR).alias("start"), s["sum"].alias("sum"))
            return F.when(s["end"] < F.size(entries), moved).otherwise(stopped)

        # A list of one is a name for a value that is used several times.
        return F.get(F.transform(F.array(open_), cover), 0)

    start = F.struct(F.lit(0).alias("start"), F.lit(0.0).alias("sum"))
    # Every cover moves the start on by one entry at least.
    return F.aggregate(entries, start, step, lambda state: state["sum"])

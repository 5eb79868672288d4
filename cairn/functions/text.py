"""Text matching: tokens, search terms, match and rank columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.cover import entries_of, searched_covers, swept_covers

# The characters of a token, and the rank weight of each label.
TOKEN = r"[\p{L}\p{N}\p{Mc}]"
RANK_WEIGHT = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


@dataclass(frozen=True)
class Term:
    """Tokens that must follow each other, wanted or unwanted."""

    tokens: tuple[str, ...]
    wanted: bool


def clean_query(text: object) -> str:
    """Control characters to spaces, spaces collapsed; empty without a letter or digit."""
    if not isinstance(text, str):
        return ""
    cleaned = re.sub(r"\s+", " ", re.sub("[\x00-\x1f\x7f]", " ", text)).strip()
    return cleaned if any(c.isalnum() for c in cleaned) else ""


def query_terms(query: str) -> list[list[Term]]:
    """Alternatives (joined by ``or``) of terms that must all hold.

    A quoted part, and a word that holds several tokens, is a phrase. A leading
    minus excludes a term.
    """
    alternatives: list[list[Term]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not minus:
            alternatives.append([])
            continue
        tokens = tuple(re.findall(r"[^\W_]+", (quoted or word).lower()))
        if tokens:
            alternatives[-1].append(Term(tokens, wanted=not minus))
    return [terms for terms in alternatives if terms]


def _word_pattern(*words: str) -> str:
    """Any of the words, standing as a whole token."""
    return f"(?<!{TOKEN})(?:{'|'.join(words)})(?!{TOKEN})"


def count_folded(folded: Column, words: Sequence[str]) -> Column:
    """Tokens of a folded text that are among the folded words."""
    return F.regexp_count(folded, F.lit(_word_pattern(*words))) if words else F.lit(0)


def holds_folded(folded: Column, words: Sequence[str]) -> Column:
    """Whether the folded words follow each other in a folded text."""
    gap = f"[^{TOKEN[1:]}+"
    return F.rlike(folded, F.lit(_word_pattern(gap.join(words))))


def count_words(text: Column, words: Sequence[str]) -> Column:
    """Tokens of the text that are among the words, ignoring case and accents."""
    return count_folded(fold_text(text), [fold_word(w) for w in words])


def holds_words(text: Column, words: Sequence[str]) -> Column:
    """Whether the words follow each other in the text, ignoring case and accents."""
    return holds_folded(fold_text(text), [fold_word(w) for w in words])


def free_terms(query: str) -> tuple[list[str], list[tuple[str, ...]], list[tuple[str, ...]]]:
    """The words that score, the phrases that must stand, and what must not, all folded.

    Quoted parts are phrases; their words score too. A leading minus excludes a
    word or a phrase. The word ``or`` says nothing.
    """
    words: set[str] = set()
    phrases, unwanted = [], []
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        tokens = tuple(fold_tokens(quoted or word))
        if not tokens or tokens == ("or",):
            continue
        if minus:
            unwanted += [tokens] if quoted else [(t,) for t in tokens]
            continue
        words.update(tokens)
        if quoted:
            phrases.append(tokens)
    return sorted(words), phrases, unwanted


def _occurrences(text: Column, term: Term) -> Column:
    first, *rest = term.tokens
    pattern = _word_pattern(first)
    if rest:
        # The tokens that follow are looked ahead at, so phrases may overlap.
        gap = f"[^{TOKEN[1:]}+"
        pattern += f"(?={gap}{gap.join(rest)}(?!{TOKEN}))"
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern))


def matches(text: Column, alternatives: list[list[Term]]) -> Column:
    """Whether the text satisfies the query."""
    found = F.lit(False)
    for terms in alternatives:
        all_hold = F.lit(True)
        for term in terms:
            present = _occurrences(text, term) > 0
            all_hold = all_hold & (present if term.wanted else ~present)
        found = found | all_hold
    return found


def cover_density(text: Column, alternatives: list[list[Term]]) -> Column:
    """The sum over all covers, before any weight."""
    if not alternatives:
        return F.lit(0.0)
    named = sorted({token for terms in alternatives for term in terms for token in term.tokens})
    tokens = token_list(F.lower(F.coalesce(text, F.lit(""))))
    if all(term.wanted for terms in alternatives for term in terms):
        sides = [[term.tokens for term in terms] for terms in alternatives]
        count = lambda entries: swept_covers(entries, sides)
    else:
        sides = [tuple([t.tokens for t in terms if t.wanted is wanted] for wanted in (True, False)) for terms in alternatives]
        count = lambda entries: searched_covers(entries, sides)
    # A list of one is a name for the entries, which are used several times.
    return F.get(F.transform(F.array(entries_of(tokens, named)), count), 0)


def rank(text: Column, alternatives: list[list[Term]], label: str) -> Column:
    """Cover density of a text, folded into 0..1 as r / (r + 1).

    A cover is a shortest run of the text that satisfies the query. Each cover
    adds the weight of the label, divided by one more than the number of tokens
    in it that the query does not name.
    """
    if len(alternatives) == 1 and len(alternatives[0]) == 1 and alternatives[0][0].wanted:
        # Every occurrence is a cover without other tokens.
        covers = _occurrences(text, alternatives[0][0]).cast("double")
    else:
        covers = cover_density(text, alternatives)
    score = covers * F.lit(RANK_WEIGHT[label])
    return score / (score + 1)


def like_pattern(text: str) -> str:
    """A search text as a LIKE pattern: a backslash makes the next character a plain one."""
    out, at = [], 0
    while at < len(text):
        c = text[at]
        if c == "\\" and at + 1 < len(text):
            at += 1
            c = text[at]
            c = f"\\{c}" if c in "%_\\" else c
        elif c == "\\":
            c = "\\\\"
        out.append(c)
        at += 1
    return "".join(out)


# Letters that stand for a plain one without a mark of their own.
STROKED = {"ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ı": "i"}


def _folds() -> dict[str, str]:
    """The small Latin, Greek and Cyrillic letters that are another letter with marks, and that letter."""
    found = dict(STROKED)
    for code in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        letter = chr(code)
        base = [STROKED.get(c, c) for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn"]
        if letter == letter.lower() and len(base) == 1 and base[0] != letter:
            found[letter] = base[0]
    return found


FOLDS = _folds()


def fold_word(word: str) -> str:
    """Lower case, without accents."""
    return "".join(FOLDS.get(c, c) for c in word.lower() if unicodedata.category(c) != "Mn")


def fold_text(text: Column) -> Column:
    """A text as :func:`fold_word` would have it; null is empty."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_replace(F.translate(lowered, "".join(FOLDS), "".join(FOLDS.values())), r"\p{Mn}+", "")


def fold_tokens(text: str) -> list[str]:
    """The folded tokens of a query, as :data:`TOKEN` has them."""
    kept = (c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Mc" else " " for c in fold_word(text))
    return "".join(kept).split()


def token_list(folded: Column) -> Column:
    """The tokens of a folded text, in order."""
    return F.regexp_extract_all(folded, F.lit(f"{TOKEN}+"), F.lit(0))

"""Text rules for questions, as column expressions.

Normalised text holds only ``a-z``, ``0-9`` and single spaces, so a word is
whatever stands between spaces.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_WORD = "[^a-z0-9]+"


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), _NOT_WORD, " "))


def normalized_name(name: str) -> str:
    """The driver-side twin of :func:`normalized`, for column names."""
    return re.sub(_NOT_WORD, " ", name.lower()).strip()


def has_any_phrase(text: Column, phrases: Sequence[str]) -> Column:
    """True if one of the phrases occurs anywhere, inside words too."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def spaced(text: Column) -> Column:
    """Text with a space on both sides, so that every word has two neighbours."""
    return F.concat(F.lit(" "), text, F.lit(" "))


def has_any_word(spaced_text: Column, words: Sequence[str]) -> Column:
    return has_any_phrase(spaced_text, [f" {w} " for w in words])


class ColumnNames:
    """Finds mentions of column names in normalised text with spaces around it."""

    def __init__(self, names: Sequence[str]):
        self.by_form: dict[str, list[str]] = {}
        for name in names:
            form = normalized_name(name)
            same = self.by_form.setdefault(form, []) if form else []
            if name not in same:
                same.append(name)

    def _pattern(self) -> str:
        longest_first = sorted(self.by_form, key=len, reverse=True)
        return f" ({'|'.join(longest_first)})(?= )"

    def found_in(self, spaced_text: Column) -> Column:
        """Normalised names in order of first mention; longer names win."""
        if not self.by_form:
            return F.array().cast("array<string>")
        forms = F.regexp_extract_all(spaced_text, F.lit(self._pattern()), F.lit(1))
        return F.array_distinct(forms)

    def name_of(self, form: Column) -> Column:
        """The column name behind a normalised name."""
        if not self.by_form:
            return F.lit(None).cast("string")
        names = [F.lit(x) for form_, same in self.by_form.items() for x in (form_, same[0])]
        return F.try_element_at(F.create_map(*names), form)

    def names_of(self, forms: Column) -> Column:
        return F.transform(forms, self.name_of)

    def blanked(self, spaced_text: Column) -> Column:
        """The text with every mention replaced by a mark that is no word."""
        if not self.by_form:
            return spaced_text
        return F.regexp_replace(spaced_text, self._pattern(), " #")

    def ambiguity(self, spaced_text: Column) -> Column:
        """An error text if a mention fits several names, else null."""
        clashes = [(f, same) for f, same in self.by_form.items() if len(same) > 1]
        found = [
            F.when(
                has_any_word(spaced_text, [form]),
                F.lit(
                    f"Ambiguous column reference '{form}' matches multiple schema columns: "
                    f"{', '.join(same)}."
                ),
            )
            for form, same in clashes
        ]
        return F.coalesce(*found, F.lit(None)).cast("string")

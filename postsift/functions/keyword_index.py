"""One automaton over the keywords of many searches; runs inside tasks.

For each listing column all keywords of all searches are found in one pass over its text.
A search is then ruled out by a keyword it excludes, or by none of those it asks for.
"""

from __future__ import annotations

import ahocorasick
import numpy as np

# The listing column a pair of keyword lists reads.
COLUMNS = {"company": ("companies_exclude", "companies_include"),
           "title": ("title_must_exclude", "title_must_include"),
           "location": ("location_must_exclude", "location_must_include"),
           "description": ("description_must_exclude", "description_must_include")}


class _Column:
    """Keywords of one column, and the searches that exclude or ask for each."""

    def __init__(self, searches: list[dict], unwanted: str, wanted: str):
        lists: dict[str, tuple[list[int], list[int]]] = {}
        for at, search in enumerate(searches):
            for side, name in enumerate((unwanted, wanted)):
                for word in {w for w in search[name] or () if w is not None}:
                    lists.setdefault(word, ([], []))[side].append(at)
        self.unwanted = [np.array(a, np.int64) for a, _ in lists.values()]
        self.wanted = [np.array(b, np.int64) for _, b in lists.values()]
        # A list of nulls only asks for something that is never there.
        self.free = np.array([not s[wanted] for s in searches], bool)
        self.always = [i for i, word in enumerate(lists) if not word]
        self.automaton = ahocorasick.Automaton()
        for i, word in enumerate(lists):
            if word:
                self.automaton.add_word(word, i)
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def narrow(self, low: str, ok: np.ndarray) -> None:
        """Take the searches out of ``ok`` that reject the lower-cased text."""
        found = set(self.always)
        if not self.empty:
            found.update(i for _, i in self.automaton.iter(low))
        hit = self.free.copy()
        for i in found:
            ok[self.unwanted[i]] = False
            hit[self.wanted[i]] = True
        ok &= hit


class KeywordIndex:
    """``searches``: dicts with the keyword lists, lower-cased, ``max_age_hours``, ``platform_codes``
    and ``profile_ord``."""

    def __init__(self, searches: list[dict]):
        self.ords = np.array([s["profile_ord"] for s in searches], np.int64)
        self.limits = np.array([np.inf if s["max_age_hours"] is None else s["max_age_hours"]
                                for s in searches], float)
        self.sources = {code: np.array([code in s["platform_codes"] for s in searches], bool)
                        for code in {c for s in searches for c in s["platform_codes"]}}
        self.columns = {name: _Column(searches, *lists) for name, lists in COLUMNS.items()}

    def passing(self, code: str | None, age: float | None, texts: dict[str, str]) -> np.ndarray:
        """``profile_ord`` of the searches that take a listing; ``texts`` are lower-cased by column."""
        scanned = self.sources.get(code)
        if scanned is None:
            return self.ords[:0]
        ok = scanned.copy()
        if age is not None:
            ok &= ~(age > self.limits)
        for name, column in self.columns.items():
            if not ok.any():
                break
            # Description rules need a description.
            if name != "description" or texts[name]:
                column.narrow(texts[name], ok)
        return self.ords[ok]

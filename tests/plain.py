"""Plain restatements of the similarity and dedup rules, used only to check answers."""

import re
from difflib import SequenceMatcher


def normal(text):
    return re.sub("[^a-z0-9]+", " ", (text or "").lower()).strip()


def alike(new, stored):
    a, b = normal(new), normal(stored)
    if not a or not b:
        return False
    if a == b:
        return True

    def ratio(x, y):
        return SequenceMatcher(None, x, y).ratio()

    if ratio(a, b) >= 0.85 or ratio(a.replace(" ", ""), b.replace(" ", "")) >= 0.85:
        return True
    one, two = set(a.split()), set(b.split())
    small, big = (one, two) if len(one) <= len(two) else (two, one)
    hits = [t for t in small
            if any(t == u or (len(t) >= 3 and t in u) or ratio(t, u) >= 0.7 for u in big)]
    return len(hits) / len(small) >= 0.75


def sequential(listings, state):
    """Outcome per listing in arrival order; ``listings`` are (title, company, can_alert)."""
    standing = list(state)
    outcomes = []
    for title, company, can_alert in listings:
        key = normal(company)
        if key and any(normal(c) == key and alike(title, t) for t, c in standing):
            outcomes.append("DUPLICATE")
        elif can_alert:
            standing.append((title, company))
            outcomes.append("NEW")
        else:
            outcomes.append("SEND_FAILED")
    return outcomes

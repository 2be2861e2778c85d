"""Searches found by one automaton against the rule chain of each pair."""

import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from postsift.functions import rules
from postsift.functions.text import as_of_literal
from postsift.operators import routing
from postsift.plans.views import profiles_from_searches
from postsift.schema import KEYWORD_FIELDS
from postsift.sources.profiles import match_profiles

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
SCHEMA = ("seq long, platform_code string, title string, company string, location string, post_date string, "
          "post_text string, description string")
PARTS = ["ha", "rbour", "Cl", "erk", "İ", "straße", "Éclair", " ", "ha", "x", "ß", "εσ", "Σ"]


def made(rng, low, high):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(low, high)))


def some_listings(spark, rng, rows):
    def value(high):
        return rng.choice([None, "", made(rng, 1, high), made(rng, 1, high), made(rng, 1, high)])
    data = [(i, rng.choice(["linkedin", "ejobs", "nowhere", None]), value(6), value(4), value(4), None,
             rng.choice([None, "3 hours ago", "2 days ago", "soon"]), value(60)) for i in range(rows)]
    return spark.createDataFrame(data + data[:3], SCHEMA)


def some_searches(rng, count):
    return [{"name": f"s{i % 7}", "enabled": i % 11 > 0,
             "platforms": rng.choice([["linkedin"], ["ejobs", "linkedin", "ejobs"], ["unknown"], []]),
             "filters": {**{field: [rng.choice([made(rng, 2, 3), made(rng, 1, 2), None if rng.random() < .1 else "rb",
                                                "" if rng.random() < .1 else "Σ"]) for _ in range(rng.randint(0, 2))]
                            for field in KEYWORD_FIELDS if rng.random() < .4},
                         "max_age_hours": rng.choice([None, 10.0, 48.0])}} for i in range(count)]


def pairs(df):
    return sorted((r.seq, r.profile_ord) for r in df.select("seq", "profile_ord").collect())


def test_index_equals_the_chain_of_every_pair(spark, monkeypatch):
    rng = random.Random(11)
    landed = some_listings(spark, rng, 120)
    profiles = profiles_from_searches(spark, some_searches(rng, 120))
    once = profiles.withColumn("platforms", F.array_distinct("platforms"))
    wanted = pairs(match_profiles(landed, once).where(rules.first_reason(F.col("filters"), as_of_literal(NOW)).isNull()))
    assert 200 < len(wanted)
    assert pairs(routing.routes(landed, profiles, as_of_literal(NOW), ["seq"])) == wanted
    # Too many searches to hand out: the join gives the same.
    monkeypatch.setattr(routing, "fits_broadcast", lambda df: False)
    assert pairs(routing.routes(landed, profiles, as_of_literal(NOW), ["seq"])) == wanted


def test_no_searches_and_no_listings(spark):
    rng = random.Random(3)
    landed, none = some_listings(spark, rng, 5), profiles_from_searches(spark, [{"platforms": ["unknown"]}])
    every = profiles_from_searches(spark, [{"name": "All", "platforms": ["linkedin"]}])
    assert pairs(routing.routes(landed, none, as_of_literal(NOW), ["seq"])) == []
    assert pairs(routing.routes(landed.limit(0), every, as_of_literal(NOW), ["seq"])) == []

"""Random documents over random releases: compiled plans against the row-by-row meaning."""

from __future__ import annotations

import random

import pytest
from evaluator import Evaluator
from pyspark.sql import functions as F

from quorumlake.model import Coverage, Refusal, Relationship, Release, table_from
from quorumlake.operators.compile import Frame
from quorumlake.plans.clauses import All, Not, flipped, simplified
from quorumlake.plans.resolve import Resolver

#: A haulage firm: depots hold trucks, trucks make trips and take fuel, trips have stops. Load classes are ordered.
LOADS, SKIES, PURPOSES, FUELS = ("van", "rigid", "trailer", "road train"), ("clear", "rain", "fog", "ice"), ("drop", "rest"), ("diesel", "gas", "battery", "n/a", "-")
HOME, TRIPS, FUELLED, STOPS = RELS = (
    Relationship("trucks", ("depot",), "depots", ("depot",)),
    Relationship("trips", ("truck",), "trucks", ("truck",)),
    Relationship("fuellings", ("truck",), "trucks", ("truck",)),
    Relationship("stops", ("trip",), "trips", ("trip",)),
)
N_TRUCKS, N_TRIPS = 17, 36


def some(rng, *values, empty=0.12):
    """One of the values, or sometimes none."""
    return rng.choice(values) if rng.random() >= empty else None


def haulage(spark, seed):
    """Tables with missing values, codes, keys without a parent, and what is declared about them, all drawn by seed."""
    rng = random.Random(1000 + seed)
    rows = {
        "depots": ("depot long, coast boolean, docks long", [(d, some(rng, True, False), some(rng, 2, 4, 8)) for d in (10, 20, 30, 40, 50)]),
        "trucks": ("truck long, depot long, fuel string, load string, tonnes double", [(t, some(rng, 10, 20, 30, 40, 50, 60), some(rng, *FUELS), some(rng, *LOADS, "unlisted"), some(rng, 0.75, 7.5, 18.0, 44.0)) for t in range(N_TRUCKS)]),
        "trips": ("trip long, truck long, sky string, km long", [(t, some(rng, *range(N_TRUCKS + 1)), some(rng, *SKIES), some(rng, *range(0, 600, 50))) for t in range(N_TRIPS)]),
        "fuellings": ("truck long, litres double, card boolean", [(some(rng, *range(N_TRUCKS + 2)), some(rng, 20.0, 55.5, 300.0), some(rng, True, False)) for _ in range(25)]),
        "stops": ("trip long, purpose string, minutes long", [(some(rng, *range(N_TRIPS + 3)), some(rng, *PURPOSES), some(rng, *range(0, 90, 15))) for _ in range(60)]),
        "logbooks": ("driven long, weather string", [(rng.randrange(N_TRUCKS), some(rng, *SKIES)) for _ in range(20)]),
        "cards": ("holder long", [(t,) for t in range(N_TRUCKS) if rng.random() < 0.5]),
        "routed": ("journey long, plan long", [(rng.randrange(N_TRIPS), rng.randrange(5)) for _ in range(28)]),
        "plans": ("plan long, aim string, everything boolean", [(rng.randrange(5), some(rng, *PURPOSES), rng.random() < 0.25) for _ in range(9)]),
    }
    declared = {"trucks": {"fuel": {"missing": (("n/a", "NOT_APPLICABLE"), ("-", "NOT_ASSESSED"))}, "load": {"permissible": LOADS, "ordered": True}}}
    keys = {"depots": ("depot",), "trucks": ("truck",), "trips": ("trip",)}
    listings = ("logbooks", "cards", "routed", "plans")
    tables = {n: table_from(n, spark.createDataFrame(r, schema).coalesce(1), keys.get(n, ()), declared.get(n), "coverage" if n in listings else "entity") for n, (schema, r) in rows.items()}
    resolver = Resolver(Release("haulage", tables, RELS), "trucks")

    def maybe(table, **leaf):
        return resolver.clause({"kind": "value", **leaf}, table) if rng.random() < 0.4 else None

    wet = maybe("trips", column="trips.sky", values=["rain", "fog", "ice"])
    large = maybe("trucks", column="trucks.load", range={"gt": "rigid"})
    far = maybe("trips", column="trips.km", range={"gte": 250})
    coverage = {
        HOME.id: Coverage("all"),
        TRIPS.id: [Coverage("all", parent_scope=large, record_filter=wet), Coverage("undeclared", record_filter=wet), Coverage("direct", "logbooks", ("driven",), parent_scope=large, proposed=True), Coverage("direct", "logbooks", ("driven",), (("sky", "weather"),), record_filter=wet)][rng.randrange(4)],
        FUELLED.id: [Coverage("direct", "cards", ("holder",)), Coverage("all", parent_scope=large), Coverage("undeclared")][rng.randrange(3)],
        STOPS.id: [Coverage("undeclared"), Coverage("all", parent_scope=far), Coverage("grouped", "routed", ("journey",), (), "plan", "plans", "plan"), Coverage("grouped", "routed", ("journey",), (("purpose", "aim"),), "plan", "plans", "plan", "everything", parent_scope=far, proposed=True)][rng.randrange(4)],
    }
    return Release("haulage", tables, RELS, coverage)


def leaves(rng, table):
    """Every sort of question about a row of the table itself or of those above it."""
    is_one_of = lambda column, values, **k: {"kind": "value", "column": column, "values": values, **k}
    lies = lambda column, by, bound: {"kind": "value", "column": column, "range": {by: bound}}
    side = rng.choice(["gt", "gte", "lt", "lte"])
    if table == "trucks":
        return [is_one_of("trucks.fuel", rng.sample(FUELS[:3], 2), negate=rng.random() < 0.35), lies("trucks.load", side, rng.choice(LOADS)), {"kind": "value", "column": "trucks.tonnes", "op": rng.choice(["<", ">=", "="]), "value": 18.0}, lies("depots.docks", side, 4)]
    if table == "trips":
        return [is_one_of("trips.sky", rng.sample(SKIES, rng.randint(1, 3))), lies("trips.km", side, rng.randrange(600)), lies("trucks.tonnes", side, 10.0), is_one_of("depots.coast", [True])]
    if table == "fuellings":
        return [lies("fuellings.litres", side, 55.5), is_one_of("fuellings.card", [False]), is_one_of("trucks.load", ["van"], negate=rng.random() < 0.5)]
    return [is_one_of("stops.purpose", [rng.choice(PURPOSES)]), lies("stops.minutes", side, rng.randrange(90)), is_one_of("trips.sky", ["clear"], negate=rng.random() < 0.5)]


BELOW = {"trucks": (("trips",), ("fuellings",), ("trips", "stops")), "trips": (("stops",),), "fuellings": (), "stops": ()}


def question(rng, table, room=3):
    """A random clause over the table, at most ``room`` levels deep."""
    lift = rng.choice(["strict", "assessed"])
    shape = rng.random()
    if room and shape < 0.4:
        parts = [question(rng, table, room - 1) for _ in range(rng.randint(1, 3))]
        word = rng.choice(["all", "any", "not", "known", "unknown"])
        return {word: parts if word in ("all", "any") else parts[0]}
    if shape < 0.8 and BELOW[table]:
        steps = rng.choice(BELOW[table])
        if rng.random() < 0.15:
            scope = {"scope": {"purpose": ["rest"]}} if steps[-1] == "stops" and rng.random() < 0.5 else {}
            return {"kind": "covered", "table": steps[-1], "lift": lift, **scope}
        how = [rng.choice(["some", "every", "some", {"some": rng.randint(2, 3)}]) for _ in steps]
        where = [question(rng, steps[-1], max(0, room - 2)) for _ in range(rng.randrange(3))]
        return {"kind": "exists", "table": steps[-1], "where": where, "quantifier": how if len(how) > 1 else how[0], "lift": lift}
    if table == "trips" and shape > 0.94:
        return {"kind": "exists", "table": "trips", "via": [TRIPS.id, TRIPS.id], "exclude_self": True, "where": [leaves(rng, "trips")[1]]}
    return rng.choice(leaves(rng, table))


@pytest.mark.parametrize("seed", range(12))
def test_plans_mean_what_rows_say(spark, seed):
    rng = random.Random(seed)
    made = haulage(spark, seed)
    judge, resolver = Evaluator(made), Resolver(made, "trucks")
    clauses = [resolver.clause(question(rng, "trucks"), "trucks") for _ in range(3)]
    frame = Frame(made, "trucks")
    truths = [frame.truth(c) for c in clauses]
    got = {r["truck"]: r for r in frame.df.select("truck", *[c for i, t in enumerate(truths) for c in t.named(f"t{i}")]).collect()}
    for row in judge.rows["trucks"]:
        for i, c in enumerate(clauses):
            r = got[row["truck"]]
            assert (r[f"t{i}v"], r[f"t{i}r"], r[f"t{i}m"]) == judge.truth(c, row), (i, row, c)
            assert judge.truth(simplified(c), row)[:2] == judge.truth(c, row)[:2]


def test_siblings_leave_the_row_out(spark):
    made = haulage(spark, 3)
    made.coverage[TRIPS.id] = Coverage("all")
    c = Resolver(made, "trips").clause({"kind": "exists", "table": "trips", "via": [TRIPS.id, TRIPS.id], "exclude_self": True, "where": [{"kind": "value", "column": "trips.km", "range": {"gt": 300}}]}, "trips")
    judge, frame = Evaluator(made), Frame(made, "trips")
    t = frame.truth(c)
    got = {r["trip"]: (r["v"], r["r"]) for r in frame.df.select("trip", t.v.alias("v"), t.r.alias("r")).collect()}
    assert got == {row["trip"]: judge.truth(c, row)[:2] for row in judge.rows["trips"]} and len({v for v, _ in got.values()}) > 1


def test_questions_over_one_relationship_share_an_aggregation(spark):
    made = haulage(spark, 1)
    made.coverage[TRIPS.id] = Coverage("all")
    r = Resolver(made, "trucks")
    asked = [r.clause({"kind": "exists", "table": "trips", "where": [{"kind": "value", "column": "trips.km", "range": {"lte": 90 * k}}]}, "trucks") for k in range(6)]
    frame = Frame(made, "trucks")
    frame.truth(All(tuple(asked)))
    plan = frame.df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1


@pytest.mark.parametrize("written,code", [
    ({"kind": "value", "column": "depots.wharves", "values": [1]}, "UNKNOWN_COLUMN"),
    ({"kind": "value", "column": "trucks.tonnes", "values": ["heavy"]}, "WRONG_TYPE"),
    ({"kind": "value", "column": "trucks.fuel", "range": {"gt": "gas"}}, "NOT_ORDERED"),
    ({"kind": "value", "column": "trucks.load", "range": {"gt": "unlisted"}}, "NOT_PERMISSIBLE"),
    ({"kind": "value", "column": "c:age", "values": [1]}, "NOT_SUPPORTED"),
    ({"kind": "exists", "table": "stops", "quantifier": ["some"]}, "QUANTIFIER_MISMATCH"),
    ({"kind": "exists", "table": "depots"}, "INVALID_PATH"),
    ({"kind": "exists", "table": "harbours"}, "UNKNOWN_TABLE"),
    ({"kind": "cohort", "cohort": "none"}, "UNKNOWN_COHORT"),
    ({"kind": "other"}, "UNKNOWN_KIND"),
])
def test_refusals(spark, written, code):
    with pytest.raises(Refusal) as refused:
        Resolver(haulage(spark, 0), "trucks").clause(written, "trucks")
    assert refused.value.code == code


def test_flipping_lifts_twice_is_nothing():
    assert flipped(flipped(Not(All(())))) == Not(All(()))


def test_mixed_keys_meet_exactly(spark):
    from quorumlake.operators.compile import same_key

    row = spark.createDataFrame([(9007199254740993, 9007199254740992.0, 5, 5.0)], "a long, b double, c long, d double")
    got = row.select(same_key(F.col("a"), F.col("b"), ("bigint", "double")), same_key(F.col("c"), F.col("d"), ("bigint", "double")), same_key(F.col("a"), F.col("b"), ("bigint", "string"))).first()
    assert tuple(got) == (False, True, False)

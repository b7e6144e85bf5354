"""Census and health tables as external datasets have them, and the kinds of SQL asked of them, against DuckDB.

Keys are derived from longer codes or from parts, measures are stored by row,
numbers are text with "Not Available" among them.
"""

import random
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from quadrille.functions import text as X

R = random.Random(11)
GROUPS = (None, "Black", "White", "Hispanic")


def tables():
    states = [f"{i:02}" for i in (1, 6, 36, 48)]
    names = dict(zip(states, ("Alabama", "California", "New York", "Texas"), strict=True))
    counties = [f"{s}{c:03}" for s in states for c in range(1, 16, 2)]
    num = lambda low, high: round(R.uniform(low, high), 3)
    maybe = lambda x, p=0.1: None if R.random() < p else x
    out = {
        "county_year": (["geo_id", "total_pop", "median_income", "poverty", "gini_index", "median_rent", "rent_share", "unemployed"], [(f"0500000US{c}", float(R.randrange(5_000, 900_000)), maybe(num(2e4, 9e4)), num(100, 9e4), maybe(num(0.3, 0.6)), num(500, 2500), maybe(num(10, 60)), num(10, 9999)) for c in counties]),
        "state_year": (["geo_id", "total_pop", "median_income"], [(f"0400000US{s}", float(R.randrange(10**6, 4 * 10**7)), num(4e4, 8e4)) for s in states]),
        "tract_outcomes": (["state", "county", "tract", "up_all", "up_black", "up_white", "jailed"], [(int(c[:2]), int(c[2:]), t, num(0.2, 0.6), maybe(num(0.1, 0.5)), maybe(num(0.2, 0.7)), num(0, 0.1)) for c in counties for t in (100, 201, 302)]),
        "tract_traits": (["state", "county", "tract", "zone", "income", "single_parents"], [(int(c[:2]), int(c[2:]), t, f"Zone {c[:2]}", maybe(R.randrange(20_000, 120_000)), num(0.1, 0.7)) for c in counties for t in (100, 201)]),
        "jobs": (["geoid", "total_jobs", "factory_jobs", "weekly_wage"], [(c, R.randrange(0, 50_000) if c != counties[0] else 0, R.randrange(0, 9_000), num(500, 2000)) for c in counties[:-3]]),
        "measures": (["edition", "measure", "state", "grp", "value", "low", "high"], [(2021, m, n, g, maybe(num(2, 40)), num(1, 2), num(40, 50)) for m in ("Uninsured", "Smoking", "Obesity") for n in names.values() for g in GROUPS]),
        "hospitals": (["provider_id", "name", "city", "state", "kind", "emergency", "stars", "better", "worse"], [(f"{i:06}", f"Hospital {i}", f"City {i % 7}", ("AL", "CA", "NY", "TX")[i % 4], ("Acute Care", "Critical Access")[i % 3 == 0], i % 2 == 0, ("1", "3", "5", "Not Available")[i % 4 if i % 5 else 3], ("0", "2", "Not Available")[i % 3], ("1", "3", "Not Available")[i % 3 - (i % 4 == 0)]) for i in range(60)]),
        "charges": (["provider_id", "state", "drg", "discharges", "covered", "medicare"], [(f"{R.randrange(70):06}", ("AL", "CA", "NY", "TX")[i % 4], f"{100 + i % 9} - CASE {i % 9}", R.randrange(0, 200), num(5_000, 90_000), num(2_000, 20_000) if i % 17 else 0.0) for i in range(300)]),
        "codes": (["fips", "abbr", "state"], [(s, a, names[s]) for s, a in zip(states, ("AL", "CA", "NY", "TX"), strict=True)]),
    }
    return out


#: Questions, by what they need.
EXAMPLES = {
    "one place by the end of its code": "SELECT median_income, poverty / total_pop AS share FROM county_year WHERE substr(geo_id, -5) = @fips",
    "most unequal": "SELECT substr(geo_id, -5) AS fips, gini_index FROM county_year WHERE gini_index IS NOT NULL ORDER BY gini_index DESC, fips LIMIT 20",
    "rent within a state": "SELECT substr(geo_id, -5) AS fips, rent_share FROM county_year WHERE substr(geo_id, 10, 2) = @state AND rent_share IS NOT NULL ORDER BY rent_share DESC",
    "profile of a small place": "SELECT total_pop, median_income, gini_index, median_rent FROM county_year WHERE substr(geo_id, -5) = @fips AND total_pop < 900001",
    "states by income": "SELECT right(geo_id, 2) AS fips, median_income FROM state_year ORDER BY median_income DESC",
    "best tracts": "SELECT state, county, tract, up_all FROM tract_outcomes ORDER BY up_all DESC, state, county, tract LIMIT 20",
    "gap in a county": "SELECT tract, up_white - up_black AS gap FROM tract_outcomes WHERE concat(lpad(CAST(state AS STRING), 2, '0'), lpad(CAST(county AS STRING), 3, '0')) = @fips AND up_black IS NOT NULL AND up_white IS NOT NULL ORDER BY gap DESC",
    "most jailed": "SELECT state, county, tract, jailed FROM tract_outcomes WHERE jailed > 0.01 ORDER BY jailed DESC, tract LIMIT 15",
    "outcomes by traits, on three keys": "SELECT t.zone, avg(o.up_all) AS up, avg(t.single_parents) AS single, count(*) AS n FROM tract_outcomes o JOIN tract_traits t ON o.state = t.state AND o.county = t.county AND o.tract = t.tract WHERE t.income IS NOT NULL GROUP BY t.zone",
    "share of factories": "SELECT geoid, factory_jobs / nullif(total_jobs, 0) AS share FROM jobs WHERE total_jobs > 100 ORDER BY share DESC, geoid LIMIT 10",
    "wages by income": "SELECT j.geoid, j.weekly_wage * 52 / c.median_income AS ratio FROM jobs j JOIN county_year c ON j.geoid = substr(c.geo_id, -5) WHERE c.median_income IS NOT NULL ORDER BY ratio DESC LIMIT 20",
    "a county's work": "SELECT total_jobs, factory_jobs, weekly_wage FROM jobs WHERE geoid = @fips",
    "gap of two groups": "SELECT b.state, b.measure, b.value - w.value AS gap FROM measures b JOIN measures w ON b.state = w.state AND b.measure = w.measure AND b.edition = w.edition WHERE b.grp = 'Black' AND w.grp = 'White' AND b.value IS NOT NULL AND w.value IS NOT NULL",
    "all of a state": "SELECT measure, value, low, high FROM measures WHERE state = @name AND grp IS NULL ORDER BY measure",
    "uninsured by group": "SELECT state, grp, value FROM measures WHERE measure = 'Uninsured' AND grp IN ('Black', 'White', 'Hispanic') AND value IS NOT NULL ORDER BY value DESC LIMIT 30",
    "three measures side by side": "SELECT a.state, a.value AS uninsured, b.value AS smoking, c.value AS obesity FROM measures a JOIN measures b ON a.state = b.state JOIN measures c ON a.state = c.state WHERE a.measure = 'Uninsured' AND b.measure = 'Smoking' AND c.measure = 'Obesity' AND a.grp IS NULL AND b.grp IS NULL AND c.grp IS NULL",
    "more worse than better": "SELECT name, state, try_cast(worse AS INT) AS w, try_cast(better AS INT) AS b FROM hospitals WHERE worse NOT IN ('Not Available') AND better NOT IN ('Not Available') AND try_cast(worse AS INT) > try_cast(better AS INT)",
    "rated emergency rooms": "SELECT name, city, try_cast(stars AS INT) AS stars FROM hospitals WHERE emergency AND state = @abbr AND stars <> 'Not Available' ORDER BY stars DESC, name",
    "hospitals by state": "SELECT state, count(*) AS n, sum(CASE WHEN emergency THEN 1 ELSE 0 END) AS er, sum(CASE WHEN kind LIKE '%Critical%' THEN 1 ELSE 0 END) AS critical, avg(try_cast(stars AS INT)) AS stars FROM hospitals GROUP BY state",
    "spread of a case's cost": "SELECT drg, count(DISTINCT provider_id) AS providers, avg(covered) AS mean, max(covered) / nullif(min(medicare), 0) AS spread FROM charges WHERE drg LIKE '10%' GROUP BY drg",
    "dearest cases": "SELECT drg, sum(discharges) AS n, avg(medicare) AS paid, count(DISTINCT state) AS states FROM charges GROUP BY drg HAVING sum(discharges) > 10 ORDER BY paid DESC LIMIT 5",
    "stars and cost": "SELECT h.name, try_cast(h.stars AS INT) AS stars, avg(c.medicare) AS paid FROM hospitals h JOIN charges c ON h.provider_id = c.provider_id WHERE c.drg LIKE @case AND h.stars <> 'Not Available' GROUP BY h.name, h.stars",
    "hospitals against the uninsured": "SELECT k.abbr, h.n, m.value FROM (SELECT state, count(*) AS n FROM hospitals GROUP BY state) h JOIN codes k ON k.abbr = h.state JOIN (SELECT state, avg(CASE WHEN grp IS NOT NULL THEN value END) AS value FROM measures WHERE measure = 'Uninsured' GROUP BY state) m ON m.state = k.state",
}
ARGS = {"fips": "36003", "state": "36", "name": "Texas", "abbr": "NY", "case": "103%"}


@pytest.fixture(scope="module")
def both(spark):
    con = duckdb.connect()
    for name, (columns, rows) in tables().items():
        frame = pd.DataFrame(rows, columns=columns)  # noqa: F841
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM frame")
        spark.createDataFrame(con.execute(f"SELECT * FROM {name}").fetchall(), columns).createOrReplaceTempView(name)
    yield spark, con
    for name in tables():
        spark.catalog.dropTempView(name)


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_example(both, name):
    spark, con = both
    text = EXAMPLES[name]
    args = {k: v for k, v in ARGS.items() if f"@{k}" in text}
    got = X.guarded(spark, text, args=args)
    want = con.execute(X.parameters(text).replace(":", "$"), args) if args else con.execute(text)
    columns = [d[0] for d in want.description]

    def plain(row):
        return tuple(f"{float(v):.9g}" if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v) for v in row)

    have, need = [plain(r) for r in got.collect()], [plain(r) for r in want.fetchall()]
    assert got.columns == columns and need and sorted(have) == sorted(need)

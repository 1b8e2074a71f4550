import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import utc

from vulntide.operators import analytics, commits as history
from vulntide.operators.ranking import grouped_quantiles, numbered
from vulntide.schemas import COMMIT

FINDING = "application_name string, advisory_id string, git_commit_hash string, timestamp timestamp, event_id string"


def tree(seed, n, app):
    """A random history: most commits extend the main line, some branch off it or merge."""
    rng = random.Random(seed)
    rows, main = [], []
    for i in range(n):
        commit = f"{app}-{i:05d}"
        if not main:
            parents, on_main = [], True
        elif rng.random() < 0.7:
            others = [rng.choice(rows)[1]] if rng.random() < 0.2 else []
            parents, on_main = [main[-1], *others], True
        else:
            parents, on_main = [rng.choice(rows)[1]], False
        rows.append([app, commit, parents, 1000 + i, False])
        if on_main:
            main.append(commit)
    for row in rows:
        row[4] = row[1] == main[-1]
    return rows, main


def sequence(spark, rows, cell_rows=history.CELL_ROWS):
    got = history.first_parent_sequence(spark.createDataFrame(rows, COMMIT), cell_rows).collect()
    assert len({(r.application_name, r.commit_id) for r in got}) == len(got)
    return {(r.application_name, r.commit_id): r.seq for r in got}


def test_first_parent_sequence_matches_brute_force(spark):
    rows, expected = [], {}
    for seed, n in enumerate((1, 2, 37, 120)):
        more, main = tree(seed, n, f"app{seed}")
        rows += more
        expected |= {(f"app{seed}", c): i for i, c in enumerate(main)}
    random.Random(5).shuffle(rows)
    assert sequence(spark, rows) == expected
    assert sequence(spark, rows + rows[:40]) == expected  # repeated rows


def branches(seed, n, app, heads, times):
    """A random history with several heads, merges and branches, and its numbers by hand."""
    rng = random.Random(seed)
    parents, rows = {}, []
    for i in range(n):
        commit = f"{app}-{i:05d}"
        # Mostly a branch goes on; now and then one forks off, a root starts, or a parent is unknown.
        draw = rng.random()
        recent = list(parents)[-6:]
        own = [] if not parents or draw < 0.02 else ["lost"] if draw < 0.04 else [rng.choice(recent)]
        parents[commit] = own[0] if own else None
        merged = [rng.choice(recent)] if own and rng.random() < 0.2 else []
        time = {"rising": i, "falling": -i, "equal": 7, "none": None}.get(times, rng.randrange(10 * n))
        rows.append((app, commit, own + merged, time, False))
    for k in rng.sample(range(n), min(heads, n)):
        rows[k] = (*rows[k][:4], True)
    expected = {}

    def number(commit):
        if parents.get(commit) not in parents:
            return 0
        return 1 + number(parents[commit])

    for _, commit, _, _, head in rows:
        while head and commit in parents:
            expected[app, commit] = number(commit)
            commit = parents[commit]
    return rows, expected


@pytest.mark.parametrize("times", ["rising", "falling", "equal", "none", "random"])
@pytest.mark.parametrize("cell_rows", [1, 9, 1000])
def test_cells_of_any_size_and_times_of_any_order(spark, times, cell_rows):
    rows, expected = [], {}
    for seed, (n, heads) in enumerate([(150, 3), (1, 1), (40, 1), (60, 0), (12, 5)]):
        more, numbers = branches(seed, n, f"app{seed}", heads, times)
        rows += more
        expected |= numbers
    random.Random(9).shuffle(rows)
    assert sequence(spark, rows + rows[:30], cell_rows) == expected


def test_long_branches_cross_many_cells(spark):
    rows = [("hot", f"{i:05d}", [f"{i - 1:05d}"] if i else [], i, i == 2999) for i in range(3000)]
    rows += [("hot", f"x{i:04d}", [f"x{i - 1:04d}" if i else "00700"], 700 + i, i == 199) for i in range(200)]
    expected = {("hot", f"{i:05d}"): i for i in range(3000)} | {("hot", f"x{i:04d}"): 701 + i for i in range(200)}
    assert sequence(spark, rows, 100) == expected


def test_odd_commits(spark):
    rows = [
        (None, "1", [], 1, False), (None, "2", ["1"], 2, True), ("a", None, ["1"], 3, True), ("a", "1", [], 1, False),
        ("b", "1", None, None, True), ("b", "2", [None, "1"], 2, True), ("c", "9", ["1"], 9, None),
        ("d", "1", ["1"], 9, False), ("d", "2", [], 9, True),
    ]
    with pytest.raises(ValueError, match="leads back to itself"):
        sequence(spark, rows)
    assert sequence(spark, rows[:-2]) == {(None, "2"): 0, ("a", None): 1, ("a", "1"): 0, ("b", "1"): 0, ("b", "2"): 0}


def test_several_heads_number_each_commit_once(spark):
    rows = [
        ("a", "1", [], 1, False), ("a", "2", ["1"], 2, False), ("a", "3", ["2"], 3, True),
        ("a", "4", ["2"], 4, False), ("a", "5", ["4"], 5, True), ("a", "6", ["1"], 6, False),
        ("a", "9", [], 9, True),
    ]
    assert sequence(spark, rows) == {
        ("a", "1"): 0, ("a", "2"): 1, ("a", "3"): 2, ("a", "4"): 2, ("a", "5"): 3, ("a", "9"): 0,
    }


def test_parent_outside_the_table_ends_the_branch(spark):
    rows = [("a", "3", ["2"], 3, True), ("a", "2", ["1"], 2, False)]
    assert sequence(spark, rows) == {("a", "3"): 1, ("a", "2"): 0}


def test_no_commits(spark):
    assert sequence(spark, []) == {}


@pytest.mark.parametrize("cell_rows", [1, 100])
def test_cycle_is_an_error(spark, cell_rows):
    rows = [("a", "1", ["2"], 1, True), ("a", "2", ["1"], 2, False)]
    rows += [("a", str(k), [str(k - 1)], k, False) for k in range(3, 30)]
    with pytest.raises(ValueError, match="leads back to itself"):
        sequence(spark, rows, cell_rows)


def test_remediation_by_hand(spark):
    log = [("a", str(i), [str(i - 1)] if i else [], 1_577_836_800 + i * 86400, i == 4) for i in range(5)]
    day = lambda n: utc(2020, 1, n)
    findings = [
        ("a", "CVE-1", "0", day(1), "e1"), ("a", "CVE-1", "1", day(2), "e2"),
        ("a", "CVE-2", "4", day(5), "e3"),  # still there
        ("a", "CVE-3", "2", day(3), "e4"),  # published after the fix
        ("a", "CVE-4", "2", day(3), "e5"),  # not in any feed
        ("a", "1234", "1", day(2), "e6"),
        ("a", "CVE-5", "2", day(3), "e8"), ("a", "CVE-5", "1", day(3), "e7"),  # tie on time
    ]
    published = [("CVE-1", utc(2020, 1, 1, 12)), ("CVE-2", day(1)), ("CVE-3", utc(2020, 6, 1)), ("CVE-5", day(1))]
    rows = analytics.remediation_times(
        spark.createDataFrame(findings, FINDING),
        history.mainline(spark.createDataFrame(log, COMMIT)),
        spark.createDataFrame(published, "cve_id string, published timestamp"),
    )
    got = {r.advisory_id: (r.first_commit, r.fixing_commit, r.seconds) for r in rows.collect()}
    assert got["CVE-1"] == ("0", "2", 1.5 * 86400)
    assert got["CVE-5"] == ("1", "3", 3 * 86400.0)
    assert got["CVE-3"][2] < 0 and set(got) == {"CVE-1", "CVE-3", "CVE-5"}
    (stats,) = analytics.remediation_stats(rows).collect()
    assert (stats.n, stats["mean"], stats["max"]) == (2, 2.25 * 86400, 3 * 86400.0)
    assert analytics.slowest_fix(rows).first().advisory_id == "CVE-5"
    assert analytics.remediated_count(rows).first().n_remediated == 2


def test_quantiles_match_numpy_on_skewed_groups(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.integers(0, 5000, 20000)]
    rows += [("same", 7.0)] * 500 + [("one", 1.5)] + [("two", 1.0), ("two", 2.0)]
    rows += [(f"g{i}", float(x)) for i in range(20) for x in rng.normal(size=17)]
    nulls = [("one", None)] * 5 + [("two", None)] + [("none", None)] * 3
    frame = spark.createDataFrame(rows + nulls, "g string, x double").repartition(16)
    got = {r.g: tuple(r)[1:] for r in grouped_quantiles(frame, "g", "x", analytics.QUARTILES).collect()}
    assert got.pop("none") == (None, None, None)
    groups = {}
    for g, x in rows:
        groups.setdefault(g, []).append(x)
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        assert np.allclose(got[g], np.quantile(values, [0.25, 0.5, 0.75]))


def test_numbered_is_one_total_order(spark):
    frame = spark.range(5000).selectExpr("id", "id % 7 AS k").repartition(9)
    rows = numbered(frame, "n", "k", "id").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 5001))
    assert [(r.k, r.id) for r in rows] == sorted((r.k, r.id) for r in rows)


@pytest.mark.parametrize("n", [3, 1500])
def test_sample_limits_each_group_by_partition_first(spark, n):
    frame = spark.range(8000).repartition(16).selectExpr(
        "concat('app', id % 2) AS application_name", "CAST(id AS string) AS event_id",
        "timestamp_seconds(id) AS timestamp",
    )
    sample = analytics.sample_per_app(frame, n)
    plan = sample._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number") >= 2 and "_part" in plan
    assert sorted(int(r.event_id) for r in sample.collect()) == list(range(2 * n))


def test_trend_buckets(spark):
    frame = spark.createDataFrame([("a", utc(1970, 1, 2)), ("a", utc(1970, 1, 30)), ("a", utc(1970, 2, 2))],
                                  "application_name string, timestamp timestamp")
    rows = analytics.trend(frame).orderBy("span.start").collect()
    assert [(r.span.start, r.n_findings) for r in rows] == [(utc(1970, 1, 1), 2), (utc(1970, 1, 31), 1)]


def test_sketches_merge_and_estimate(spark):
    frame = spark.range(60_000).selectExpr(
        "IF(id % 3 = 0, 'hot', concat('a', id % 7)) AS application_name", "concat('CVE-', id % 9000) AS advisory_id",
        "timestamp_seconds(id % 40 * 86400) AS timestamp", "id",
    )
    halves = [analytics.cve_sketches(frame.where(f"id % 2 = {k}")) for k in (0, 1)]
    merged = analytics.merged_sketches(halves[0].unionByName(halves[1]))
    days = [F.lit(d).cast("date") for d in ("1970-01-05", "1970-01-20")]
    for asked, rows in ((merged, frame), (merged, frame.where("id % 40 BETWEEN 4 AND 19"))):
        given = () if rows is frame else days
        got = {r.application_name: r.n_cves for r in analytics.estimated_cves(asked, *given).collect()}
        want = {r.application_name: r.n_cves for r in analytics.cves_per_app(rows).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[a] - n) <= max(1, 0.06 * n) for a, n in want.items())

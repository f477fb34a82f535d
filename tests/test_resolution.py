"""Consensus, authority and checks on small hand-made tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import authority, checks, consensus


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_null_does_not_conflict_and_conflict_becomes_null(spark):
    df = spark.createDataFrame([(1, "a", None), (1, None, 2), (1, "a", 3), (2, "b", 4)], "k int, s string, n int")
    got = {r["k"]: r for r in consensus.field_consensus(df, ["k"], ["s", "n"]).collect()}
    assert (got[1]["s"], got[1]["n"], got[1]["conflict_fields"], got[1]["observation_variant_count"]) == ("a", None, ["n"], 3)
    assert (got[2]["s"], got[2]["n"], got[2]["conflict_field_count"]) == ("b", 4, 0)


def test_snapshot_consensus_is_free_of_order(spark):
    data = [(1, "s2", "a", 3), (1, "s1", "a", 2), (1, "s1", None, 1), (2, "s9", "x", 1), (2, "s9", "y", 1)]
    answers = []
    for order in itertools.islice(itertools.permutations(data), 0, 120, 40):
        df = spark.createDataFrame(list(order), "k int, snap string, s string, n bigint").repartition(3)
        answers.append(rows(consensus.snapshot_consensus(df, ["k"], ["s"], "snap", F.col("n"))))
    assert answers[0] == answers[1] == answers[2]
    first = answers[0][0]
    assert first == (1, 2, ["s1", "s2"], 3, 6, "a", [], 0)


def test_dominance_matches_pairwise_comparison(spark):
    rng = random.Random(11)
    data = []
    for key in range(120):
        for _ in range(rng.randrange(1, 5)):
            data.append((key, rng.choice([1, 1, 1, 2]), *[rng.choice([None, 0, 1, 2]) for _ in range(3)]))
    df = spark.createDataFrame(data, "k int, m int, a int, b int, c int")
    got = {r["k"]: r for r in consensus.dominance(df, ["k"], ["a", "b", "c"], ["m"]).collect()}
    for key in range(120):
        mine = [r for r in data if r[0] == key]
        vectors = {r[2:] for r in mine}

        def over(x, y):
            return all(q is None or (p is not None and p >= q) for p, q in zip(x, y))

        best = [x for x in vectors if all(over(x, y) for y in vectors)]
        if len({r[1] for r in mine}) > 1:
            want, vector = "unresolved_metadata_conflict", (None,) * 3
        elif len(vectors) == 1:
            want, vector = "consensus", next(iter(vectors))
        elif len(best) == 1:
            want, vector = "componentwise_dominance", best[0]
        else:
            want, vector = "unresolved_nonmonotonic_conflict", (None,) * 3
        assert (got[key]["resolution"], (got[key]["a"], got[key]["b"], got[key]["c"])) == (want, vector)


def test_family_faults(spark):
    links = spark.createDataFrame([("n1", "s1"), ("n2", "s1"), ("n3", "s3")], "normalization_id string, source_snapshot_id string")
    definitions = spark.createDataFrame([("n1", "s1", "1"), ("n2", "s0", "2")], "normalization_id string, source_snapshot_id string, version string")
    found = rows(consensus.family_faults(links, definitions, ["version"]))
    assert found == [("*", "mixed_family"), ("n2", "snapshot_mismatch"), ("n3", "missing_definition"), ("s1", "several_normalizations")]


def test_conflict_profile_counts_null_next_to_value(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "a", 2), (2, None, 1), (2, "b", 1), (3, "c", 1)], "k int, s string, n int")
    summary, columns = consensus.conflict_profile(df, ["k"])
    assert tuple(summary.first()) == (6, 5, 3, 2, 2)
    assert rows(columns) == [("n", 1), ("s", 1)]


def test_partition_comparison_treats_nulls_as_equal(spark):
    left = spark.createDataFrame([(1, None, "x"), (2, 5, "y"), (None, 1, "z"), (4, 1, "w")], "k int, a int, b string")
    right = spark.createDataFrame([(1, None, "x"), (2, 6, None), (None, 1, "z"), (5, 1, "w")], "k int, a int, b string")
    got = {r["k"]: (r["place"], r["changed_columns"]) for r in consensus.compare_partitions(left, right, ["k"]).collect()}
    assert got == {1: ("both", []), 2: ("both", ["a", "b"]), None: ("both", []), 4: ("left_only", None), 5: ("right_only", None)}


def test_terminal_text_joins_formatting_variants_and_mojibake(spark):
    broken = "González singles".encode().decode("latin-1")
    data = [(1, 1, "early"), (1, 2, "González  singles"), (1, 2, broken), (2, 3, "a"), (2, 3, "b"), (3, 1, " "), (3, 1, None)]
    df = spark.createDataFrame(data, "k int, p int, t string")
    got = {r["k"]: r for r in consensus.terminal_text(df, ["k"], "p", "t").collect()}
    assert (got[1]["terminal_position"], got[1]["text_variant_count"], got[1]["terminal_row_count"]) == (2, 1, 2)
    assert got[1]["terminal_text"] is not None
    assert (got[2]["terminal_text"], got[2]["text_variant_count"]) == (None, 2)
    assert (got[3]["terminal_text"], got[3]["text_variant_count"]) == (None, 0)


def test_overlay_prefers_the_authority(spark):
    source = spark.createDataFrame([(1, 10, "R"), (2, 20, "L"), (3, None, "R")], "k int, who int, side string")
    official = spark.createDataFrame([(1, 11, "R"), (2, None, "R")], "k int, who int, side string")
    got = {r["k"]: r for r in authority.overlay(source, official, ["k"], ["who", "side"]).collect()}
    assert (got[1]["working_who"], got[1]["who_mismatch"], got[1]["working_authority"]) == (11, True, "official")
    assert (got[2]["working_who"], got[2]["working_side"], got[2]["side_mismatch"], got[2]["working_authority"]) == (20, "R", True, "source_only")
    assert (got[3]["working_who"], got[3]["official_found"], got[3]["working_authority"]) == (None, False, "incomplete")


def test_reassignment_needs_a_lone_donor(spark):
    data = [(1, "a", 1, 0), (1, "b", 2, 3), (2, "a", 2, 1), (2, "b", 0, 1), (3, "a", 1, 0), (3, "b", 0, 1), (3, "c", 5, 4)]
    df = spark.createDataFrame(data, "g int, p string, observed_count bigint, control_count bigint")
    found = authority.single_reassignments(df.withColumn("difference", F.col("observed_count") - F.col("control_count")), ["g"], "p")
    assert rows(found) == [(1, "a", "b")]


def test_corrections_need_the_pinned_row(spark):
    data = [(1, 7, "2021-05-01", 3, 1), (1, 8, "2021-05-01", None, None), (2, 7, "2021-05-02", 4, 0), (3, 7, "2021-05-03", 2, 2), (3, 9, "2021-05-03", 1, 0)]
    table = spark.createDataFrame(data, "game int, player int, day string, pa bigint, hits bigint")
    pins = [(1, 7, 8, "2021-05-01", 3, 1), (2, 7, 8, "2021-05-02", 5, 0), (3, 7, 9, "2021-05-03", 2, 2), (4, 7, 8, "2021-05-04", 1, 1)]
    listed = spark.createDataFrame(pins, "game int, source_entity int, corrected_entity int, pinned_day string, pinned_pa int, pinned_hits int")
    corrected, status = authority.apply_corrections(table, listed, "game", "player", "day", ["pa", "hits"])
    assert rows(status, "game", "status") == [(1, "applied"), (2, "vector_drifted"), (3, "target_collision"), (4, "source_row_missing")]
    assert rows(corrected, "game", "player", "pa") == [(1, 8, 3), (2, 7, 4), (3, 7, 2), (3, 9, 1)]


def test_ledger_leaves_agreeing_entities_alone(spark):
    source = spark.createDataFrame([(1, "g1", 4), (1, "g2", 3), (2, "g1", 5), (2, "g3", 1)], "p int, g string, pa bigint")
    ledger = spark.createDataFrame([(1, "g1", 4), (1, "g2", 3), (2, "g1", 4), (2, "g2", 2), (2, "g4", 0)], "p int, g string, pa bigint")
    corrected, evidence = authority.ledger_authority(source, ledger, ["p"], ["g"], ["pa"])
    assert rows(corrected, "p", "g", "pa", "action") == [
        (1, "g1", 4, "source_kept"),
        (1, "g2", 3, "source_kept"),
        (2, "g1", 5, "source_kept"),
        (2, "g3", 1, "source_kept"),
    ]  # player 2's totals agree (6), so nothing is touched
    source = source.where("not (p = 2 and g = 'g3')")
    corrected, evidence = authority.ledger_authority(source, ledger, ["p"], ["g"], ["pa"])
    assert rows(corrected.where("p = 2"), "g", "pa", "action") == [("g1", 4, "ledger_overlay"), ("g2", 2, "ledger_insert")]
    assert rows(evidence, "g", "field", "source_value", "ledger_value") == [("g1", "pa", 5, 4), ("g2", "pa", None, 2)]


def test_residual_quarantine_needs_both_proofs(spark):
    source = spark.createDataFrame([(1, "a", 3), (1, "b", 2), (2, "a", 3), (2, "b", 2), (3, "a", 1), (3, "b", 1)], "p int, g string, pa bigint")
    ledger = spark.createDataFrame([(1, "a", 3), (2, "a", 4)], "p int, g string, pa bigint")
    season = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "p int, residual_pa int")
    kept, verdicts = authority.residual_quarantine(source, ledger, season, ["p"], ["g"], ["pa"])
    assert rows(verdicts) == [(1, "quarantined"), (2, "ledger_totals_differ"), (3, "several_source_only_rows")]
    assert rows(kept.where("p = 1"), "g") == [("a",)]


def test_strikeout_goes_to_the_first_batter_after_two_strikes(spark):
    def pitches(key, codes, substitute_from, event):
        return [(key, i + 1, 100 if i + 1 < substitute_from else 200, c, event if i + 1 == len(codes) else None) for i, c in enumerate(codes)]

    data = pitches(1, "SSBS", 4, "strikeout") + pitches(2, "SBBS", 4, "strikeout") + pitches(3, "SSBX", 4, "single")
    df = spark.createDataFrame(data, "k int, n int, who int, code string, event string")
    owner, several = authority.outcome_owner(df, ["k"], ["n"], "who", F.col("code") == "S", F.col("event") == "strikeout")
    assert rows(owner, "k", "terminal_actor", "outcome_actor") == [(1, 200, 100), (2, 200, 200), (3, 200, 200)]
    assert several.count() == 0


def test_schema_contract(spark):
    df = spark.createDataFrame([("1", "x"), ("a", None)], "n string, s string")
    shaped, report = checks.conform(df, {"n": "bigint", "s": "string"}, ["s"])
    assert dict(shaped.dtypes) == {"n": "bigint", "s": "string"}
    assert rows(report) == [("n", 1, 0), ("s", 0, 1)]
    with pytest.raises(checks.ContractViolation, match="missing=\\['t'\\]"):
        checks.conform(df, {"n": "bigint", "s": "string", "t": "string"})
    with pytest.raises(checks.ContractViolation, match="extra=\\['s'\\]"):
        checks.conform(df, {"n": "bigint"})


def test_assert_empty_shows_examples(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(checks.ContractViolation, match="'k': 1"):
        checks.assert_empty(checks.duplicate_keys(df, ["k"]), "repeated keys")
    checks.assert_empty(checks.duplicate_keys(df.distinct(), ["k"]), "repeated keys")


def test_rules_fail_closed_on_null(spark):
    df = spark.createDataFrame([(1,), (None,), (9,)], "n int")
    assert rows(checks.rule_violations(df, {"small": F.col("n") < 5})) == [("small", 2)]


def test_profile_and_grain_faults(spark):
    summary = spark.createDataFrame([(1, 3), (2, 2), (3, 1)], "p int, total bigint")
    profile = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1)], "p int, c string, n bigint")
    assert rows(checks.profile_faults(summary, profile, ["p"], "total", "n", "c"), "p") == [(2,), (3,)]
    assert rows(checks.profile_faults(summary, profile, ["p"], "total", "n", "c", ["a", "b"]), "p") == [(2,), (3,)]
    fine = spark.createDataFrame([(1, "d1", 1), (1, "d2", 2), (2, "d1", 2)], "p int, d string, n bigint")
    coarse = spark.createDataFrame([(1, 3), (2, 1), (4, 1)], "p int, n bigint")
    assert rows(checks.grain_faults(fine, coarse, ["p"], ["n"]), "p", "n_difference") == [(2, 1), (4, -1)]


def test_issue_id_depends_on_content_only(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, s string")
    issues = checks.conflict_issues(consensus.field_consensus(df, ["k"], ["s"]), ["k"], "pitch", "agree", "v1")
    again = checks.conflict_issues(consensus.field_consensus(df.repartition(4), ["k"], ["s"]), ["k"], "pitch", "agree", "v1")
    assert rows(issues) == rows(again) and issues.count() == 1
    assert issues.first()["quality_issue_id"].startswith("issue_")


def test_adjudication_lists_snapshots_per_field(spark):
    seen = spark.createDataFrame(
        [(1, "a", "L", 1), (1, "b", "R", 1), (1, "c", "R", 1), (2, "a", "L", 5), (2, "a", "R", 5), (2, "b", "R", 6), (3, "a", "L", 1)],
        "k int, snap string, side string, n int",
    )
    conflicts = consensus.field_consensus(seen, ["k"], ["side", "n"]).where("conflict_field_count > 0")
    official = spark.createDataFrame([(1, "R", None), (2, "R", 6)], "k int, side string, n int")
    rows = {(r["k"], r["field"]): r for r in authority.adjudicate(conflicts, seen, official, ["k"], ["side", "n"], "snap").collect()}
    assert set(rows) == {(1, "side"), (2, "side"), (2, "n")}
    one = rows[1, "side"]
    assert one["matching_snapshots"] == ["b", "c"] and one["status"] == "official_matches_multiple_source_snapshots"
    assert [(c["snapshot"], c["value"]) for c in one["candidate_values"]] == [("a", "L"), ("b", "R"), ("c", "R")]
    two = rows[2, "side"]
    assert two["ambiguous_snapshots"] == ["a"] and two["matching_snapshots"] == [] and two["status"] == "source_candidate_ambiguous"
    assert rows[2, "n"]["matching_snapshots"] == ["b"] and rows[2, "n"]["status"] == "official_matches_one_source_snapshot"


def test_gaps_are_explained_only_by_a_zero_count(spark):
    source = spark.createDataFrame([(1, 1, 3), (1, 2, 4), (1, 5, None), (2, 1, 1)], "g int, u int, n int")
    official = spark.createDataFrame([(1, 1, 3), (1, 2, 6), (1, 3, 0), (1, 4, 2), (1, 5, 2)], "g int, u int, n int")
    units, groups = authority.count_gaps(source, official, ["g"], "u", "n")
    got = {(r["g"], r["u"]): r["status"] for r in units.collect()}
    assert got == {
        (1, 1): "count_matched", (1, 2): "count_mismatched", (1, 3): "zero_count_gap", (1, 4): "unexplained_gap", (1, 5): "count_missing", (2, 1): "source_only",
    }
    first = groups.where("g = 1").first()
    assert (first["unit_count"], first["zero_count_gap_count"], first["count_difference"]) == (5, 1, 2)


def test_colliding_hashes_never_pass_as_agreement(spark, monkeypatch):
    """With hashes that tell only the length of a text, equal lengths collide: no key may agree on either text."""
    monkeypatch.setattr(consensus, "_codes", lambda field: (F.length(field).cast("bigint"), F.length(field).cast("bigint")))
    df = spark.createDataFrame([(1, "aa"), (1, "bb"), (2, "aa"), (3, "c"), (3, "c"), (3, None), (4, None)], "k int, s string")
    got = {r["k"]: (r["s"], r["conflict_fields"]) for r in consensus.field_consensus(df, ["k"], ["s"]).collect()}
    assert got == {1: (None, ["s"]), 2: (None, ["s"]), 3: ("c", []), 4: (None, [])}

"""The scan against what is computed by hand, file by file."""

from __future__ import annotations

from math import exp

import pytest

from riskloom.operators import scan
from riskloom.plans.scan import FILES

SCHEMA = "file_id string, code string"


def heuristic(nodes, methods, calls, findings, adjustment):
    """0.7 of the network's noise-free mean and 0.3 of the traditional confidence, by their formulas."""
    mean = 1 / (1 + exp(-(0.5 + min(nodes / 200, 0.3) + min(methods / 20, 0.2) + min(calls / 30, 0.15) + 0.15 * findings)))
    old = min(1.0, 0.5 + min(nodes / 100, 0.3) + 0.2 * findings + (0.1 if nodes else 0) + adjustment)
    return round(0.7 * mean + 0.3 * old, 6)


def test_files_by_hand(spark):
    got = {(r.file_id, r.vuln_type): r for r in scan.scan(spark.createDataFrame(FILES, SCHEMA)).collect()}
    assert got.keys() == {("v1", "sql_injection"), ("v1", "csrf"), ("v2", "csrf"), ("v3", "weak_crypto"), ("v5", "command_injection")}
    # v1: 22 nodes, a method, two calls; SQL injection is worth 0.08 + 0.05 + 0.05, CSRF 0.03, on the mean.
    assert got["v1", "sql_injection"].confidence == pytest.approx(heuristic(22, 1, 2, 2, (0.18 + 0.03) / 2))
    assert got["v2", "csrf"].confidence == pytest.approx(heuristic(23, 1, 4, 1, 0.03))
    assert got["v3", "weak_crypto"].confidence == pytest.approx(heuristic(12, 1, 2, 1, 0.08))
    assert got["v5", "command_injection"].confidence == pytest.approx(heuristic(12, 1, 2, 1, 0.08 + 0.05))
    # The gate of SQL queries: evidence weighs 0.25, 0.10, 0.15, 0.20, 0.25; direct 1.05, many paths 1.10, dangerous 1.08, at most 1.
    weighed = (0.25 * 0.9 + 0.10 * 0.8 + 0.15 * 0.75 + 0.20 * 0.85 + 0.25 * 0.78) / 0.95
    assert got["v1", "sql_injection"].gate == pytest.approx(min(1.0, weighed * 1.05 * 1.10 * 1.08))


def test_model_raises_and_never_lowers(spark):
    model = spark.createDataFrame([("v1", 0.9, 0.1, False), ("v2", 0.1, 0.9, False), ("v3", 0.95, 0.05, True)], "file_id string, vuln double, safe double, ood boolean")
    got = {r.file_id: (r.confidence, r.how) for r in scan.scan(spark.createDataFrame(FILES, SCHEMA), model).collect()}
    h = heuristic(22, 1, 2, 2, 0.105)
    assert got["v1"] == (pytest.approx(h + 0.3 * (0.9 - h), abs=2e-6), "gnn_boost")
    assert got["v2"] == (pytest.approx(heuristic(23, 1, 4, 1, 0.03)), "heuristic_only")
    assert got["v3"] == (pytest.approx(heuristic(12, 1, 2, 1, 0.08)), "heuristic_only_ood")
    assert got["v5"][1] == "heuristic_only_nan_gnn"  # no prediction


def test_a_guarded_query_is_dropped_by_its_gate(spark):
    """A SQL finding in a file that binds its parameters too: without NO_SANITIZER the gate's evidence isn't complete."""
    code = FILES[0][1].replace("st.executeQuery(q);", "st.executeQuery(q);\n        PreparedStatement p = c.prepareStatement(q);\n        p.setString(1, id);")
    got = {r.vuln_type: (r.gate, r.verdict, r.level) for r in scan.scan(spark.createDataFrame([("g", code), ("n", None), ("e", "")], SCHEMA)).collect()}
    assert got["sql_injection"] == (0.0, "gate", "note")
    assert all(v[1] != "gate" for k, v in got.items() if k != "sql_injection")

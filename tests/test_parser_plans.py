from pathlib import Path

import pytest

from lexigraph.operators import claims
from lexigraph.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxToStringFields", "1000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.maxToStringFields")


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name, key, scans", [("parse_affix", "etymology_templates", 1), ("parse_standard", "etymology_templates", 1), ("parse_root_template", "etymology_templates", 3), ("parse_root_choice", "etymology_templates", 3), ("parse_descendants_list", "descendants", 1)])
def test_a_record_is_read_once(spark, name, key, scans):
    """No filter or lambda repeats the parsing of a record: 51 times in a filter for roots, three for descendants before."""
    assert plan(QUERIES[name](spark, DATA)).count(f"$['{key}']") <= scans


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name, most", [("parse_affix", 40), ("parse_descendants_list", 12), ("parse_root_template", 16)])
def test_a_term_is_cleaned_once_for_each_argument(spark, name, most):
    """Each mention of a cleaned term in an expression cleaned it anew, and mentions multiplied where they nest."""
    assert 0 < plan(QUERIES[name](spark, DATA)).lower().count("regexp_replace(") <= most


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["parse_confix", "parse_root_template", "parse_desc"])
def test_a_small_file_is_dealt_to_all_cores(spark, name):
    """Parts of a few MB were parsed in one task."""
    lines = plan(QUERIES[name](spark, DATA)).splitlines()
    at = [k for k, line in enumerate(lines) if "Relation [p_partkey" in line]
    assert at and all(any("RepartitionByExpression" in line for line in lines[max(0, k - 3) : k]) for k in at)


def test_terms_stop_at_the_first_gap(spark):
    """Bound values keep what a null, an empty or a lone hyphen ends."""
    rows = spark.createDataFrame([(["a", None, "b"],), ([None],), (["x", "y"],), ([],), (None,)], "v array<string>")
    got = [r[0] for r in rows.select(claims.leading(rows["v"])).collect()]
    assert got == [["a"], [], ["x", "y"], [], None]

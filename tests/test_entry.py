"""The registered queries next to their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of, same

# One or two of each family; the check tool runs all of them.
NAMES = [
    "spend_by_category", "top_vendors_by_business", "scope_month_category", "accountant_lines", "duplicate_gate",
    "value_rules", "parsed_amounts", "answered_bills", "canonical_vendors", "active_drafts", "nudge_due", "undo_requests",
    "routed_messages", "parsed_messages", "daily_net", "tax_quarters", "cash_flow", "kpis", "visible_bills", "flat_drafts", "decoded_lists", "city_zones",
]


def test_entry(spark):
    assert entry.entry(spark).columns == ["category", "bills", "amount"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = db.execute(entry.oracle_sql()[name])
    want = rows_of([c[0] for c in rel.description], rel.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)

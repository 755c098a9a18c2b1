"""Every query of the library beside its SQL, at the smallest scale."""

import pytest
from oracle import DATA, agree

from cellweave.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        agree(df, ORACLES[name])
    else:
        assert df.count() > 0 or name == "partition_hulls"  # too few cells for a hull at this scale


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_without_llm():
    """The rest imports, and its queries are there, where the subpackage isn't."""
    import subprocess
    import sys

    code = "import sys; sys.modules['cellweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'npmi_pairs' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], check=True)

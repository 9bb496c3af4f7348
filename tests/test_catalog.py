import sys
from importlib.util import find_spec

import pytest
from oracle import connect, differences

from veritally.plans import catalog, feeds, reports  # noqa: F401


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    n, m, wrong = differences(catalog.QUERIES[name](spark, sf_dir), con, catalog.ORACLES[name])
    assert n == m and not wrong, (n, m, wrong)


def test_entry_without_the_optional_part(monkeypatch, capsys):
    """What the optional subpackage imports may be missing; the verification queries stay."""
    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("veritally.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    assert __spark_entry__.queries() == catalog.QUERIES and __spark_entry__.oracle_sql() == catalog.ORACLES
    if find_spec("veritally.llm"):
        assert "left out" in capsys.readouterr().err

import importlib
import sys


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_stands_without_the_llm_subpackage(monkeypatch):
    import __spark_entry__ as e

    for name in [m for m in sys.modules if m.startswith("segspark.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "segspark.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        alone = importlib.reload(e)
        assert alone.llm is None and alone.corpus_pipeline is None
        assert "window_obs_pred" in alone.queries() and not [q for q in alone.queries() if q[:2] == "op" and q[2].isdigit()]
    finally:
        monkeypatch.undo()
        importlib.reload(e)

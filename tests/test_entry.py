import builtins
import sys

import __spark_entry__ as entry


def test_engine_queries_stay_where_the_corpus_operators_cannot_be_imported(monkeypatch):
    real = builtins.__import__

    def refuse(name, *args, **named):
        if name.startswith("keyloom.llm") or (name == "keyloom" and len(args) > 2 and args[2] and "llm" in args[2]):
            raise ImportError(name)
        return real(name, *args, **named)

    for name in [n for n in sys.modules if n.startswith("keyloom.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", refuse)
    found = entry.queries()
    assert "current_state" in found and "pipeline" not in found and not any(n.startswith("op") and n[2].isdigit() for n in found)
    assert set(entry.oracle_sql()) <= set(found)

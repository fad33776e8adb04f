import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "lumenstrata").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.M), path


def test_every_query_of_the_engine_has_sql():
    from lumenstrata import catalogue

    assert set(catalogue.queries()) == set(catalogue.oracle_sql())

"""Every registered query against its SQL on the smallest tables."""

import ast
import importlib
import pkgutil
from types import ModuleType

import pytest

import __spark_entry__ as entry
import catalog
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, duck, sql) is None


def test_entry_is_lazy_and_has_rows(spark):
    df = entry.entry(spark)
    assert "receita_total" in df.columns and not df.isEmpty()


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [m.name for m in pkgutil.iter_modules(catalog.__path__, "catalog.")])
def test_names_of_modules_exist(name):
    """A query that asks a module for a name it lacks fails only when it runs."""
    module = importlib.import_module(name)
    with open(module.__file__) as source:
        asked = [n for n in ast.walk(ast.parse(source.read())) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name)]
    held = vars(module)
    assert [f"{n.value.id}.{n.attr}" for n in asked
            if isinstance(held.get(n.value.id), ModuleType) and not hasattr(held[n.value.id], n.attr)] == []

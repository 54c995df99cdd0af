"""What is registered is a query."""

import inspect

import __spark_entry__


def test_every_registered_name_takes_a_session_and_a_folder():
    found = __spark_entry__.queries()
    assert not [n for n, f in found.items() if list(inspect.signature(f).parameters)[:2] != ["spark", "sf_dir"]]
    assert "op12_sql" not in found and "op12_vector_code_compression" in __spark_entry__.oracle_sql()

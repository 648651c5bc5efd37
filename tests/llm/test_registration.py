import re

import __spark_entry__ as entry


def test_one_query_per_operator():
    names = entry.queries()
    numbers = sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)

"""Sources that no query reads, and errors that no query may raise."""

import pytest

from tierwise.operators import governance
from tierwise.sources import files


def test_json_lists_and_single_objects(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"a": 1},\n {"a": 2, "b": "x"}]')
    (tmp_path / "one.json").write_text('{\n "a": 3\n}')
    read = lambda name: [tuple(r) for r in files.read_json(spark, str(tmp_path / name), "a int, b string").collect()]
    assert read("list.json") == [(1, None), (2, "x")] and read("one.json") == [(3, None)]


def test_artifacts_of_a_seed(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x__seed7.json").write_text('{"task": "t",\n "model": "m", "tau": 0.5}')
    (tmp_path / "m" / "y__seed7.json").write_text('{"task": "t", "model": "m"}')
    (tmp_path / "z__seed8.json").write_text('{"task": "u", "model": "m", "tau": 0.1}')
    got = files.read_artifacts(spark, str(tmp_path), "task string, model string, tau double", 7).collect()
    assert [tuple(r) for r in got] == [("t", "m", 0.5)]


@pytest.mark.parametrize("change", [{"SK": 0}, {"SK": 1, "TC": 2}, {"other": 1}])
def test_weights_that_are_refused(change):
    with pytest.raises(ValueError):
        governance.valid_weights({**dict.fromkeys(governance.DIMENSIONS, 1), **change})

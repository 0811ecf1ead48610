"""Configuration and reports."""

import json
from dataclasses import dataclass, field

import pytest

from emberline.sources.config import built, overridden, read_config
from emberline.sources.report import format_table, print_report


@dataclass
class Model:
    width: int = 1


@dataclass
class Whole:
    name: str = "x"
    model: Model = field(default_factory=Model)


def test_unknown_keys_are_errors(tmp_path):
    assert built(Whole, {"model": {"width": 2}}) == Whole("x", Model(2))
    with pytest.raises(KeyError, match="model.depth"):
        built(Whole, {"model": {"depth": 2}})
    (tmp_path / "m.json").write_text(json.dumps({"width": 5}))
    (tmp_path / "c.json").write_text(json.dumps({"name": "y", "model": "m.json"}))
    assert read_config(Whole, str(tmp_path / "c.json"), ["model.width=7"]) == Whole("y", Model(7))
    assert overridden({"a": {"b": 1}}, ["a.b=text", "c=[1]"]) == {"a": {"b": "text"}, "c": [1]}
    with pytest.raises(KeyError):
        read_config(Whole, str(tmp_path / "c.json"), ["nothing=1"])
    with pytest.raises(ValueError):
        overridden({}, ["a"])


def test_report(spark):
    text = format_table({"one": {"a": 0.5}, "longer": {"a": 2.0, "b": 3}}, ["a", "b"])
    assert text.split("\n") == ["            a    b", "one     0.500  nan", "longer  2.000    3"]
    assert print_report(spark.createDataFrame([("k", 1.0, None)], "n string, a double, b double"), "n", ["a", "b"]).endswith("1.000  nan")

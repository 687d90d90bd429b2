import json

import pytest

from lectern.plans import config


def test_settings(tmp_path, monkeypatch):
    f = tmp_path / "a.env"
    f.write_text("# note\nLECTERN_MODEL='m'\nTEMPERATURE=0.5\nAPI_KEY=SECRET\nother=1\n\n")
    monkeypatch.setenv("LECTERN_TOP_K", "3")
    c = config.read_config(str(f))
    assert (c.model, c.temperature, c.top_k, c.api_key) == ("m", 0.5, 3, "SECRET") and "SECRET" not in json.dumps(c.public())
    for bad in ({"temperature": 2.1}, {"top_p": -0.1}, {"top_k": -1}, {"max_tokens": 0}, {"timeout": 0}):
        with pytest.raises(ValueError):
            config.ModelConfig(**bad)


def test_templates(tmp_path):
    (tmp_path / "testing.json").write_text(json.dumps({"system": "s", "user": "u {question}", "constraints": ["c"]}))
    (tmp_path / "summary.json").write_text("{broken")
    t = config.load_templates(str(tmp_path))
    assert not t["testing"]["is_default"] and t["summary"]["is_default"] and t["generation"]["user"] == config.DEFAULTS["generation"]
    assert config.load_template("testing", str(tmp_path / "testing.json"))["user"] == "u {question}"
    for bad in ({"system": "s"}, {"system": "s", "user": 1}, {"system": "s", "user": "u", "constraints": [1]}, []):
        with pytest.raises(ValueError):
            config.check_template(bad)
    with pytest.raises(ValueError):
        config.load_template("other", str(tmp_path / "testing.json"))


@pytest.mark.parametrize("bad", [("legacy", None), ("uniform", []), ("uniform", [0]), ("uniform", [5], 0.5), ("fixed", [5]), ("fixed", [5], 1.5), ("no_reference", [5]), ("other", [5])])
def test_arguments(bad):
    config.check_arguments("fixed", [5], 0.5)
    config.check_arguments("legacy", None, length=9)
    with pytest.raises(ValueError):
        config.check_arguments(*bad)

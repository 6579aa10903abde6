"""Workspace settings."""

import pytest

from prismflow.settings import load_settings


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("PLACE", "here")
    f = tmp_path / "w.toml"
    f.write_text('root = "${PLACE}/data"\nruns = "{root}/runs"\nmemory_warn_gb = 4\n[metadata]\npath = "%PLACE%/m.csv"\ncolumns = { lot = "category" }\n')
    s = load_settings(f)
    assert s.root == tmp_path / "here/data" and s.runs == tmp_path / "here/data/runs" and s.metadata.path == tmp_path / "here/m.csv" and s.metadata.columns == {"lot": "category"}
    (tmp_path / "w.local.toml").write_text('memory_warn_gb = 8\n[metadata]\nkey = "stem"\n')
    s = load_settings(f)
    assert s.memory_warn_gb == 8 and s.metadata.key == "stem" and s.metadata.path == tmp_path / "here/m.csv"
    for bad in ('x = 1\nroot = "a"', "glob = '*'", 'root = "${NOT_SET_ANYWHERE}"', 'root = "{root}"', 'root = "a"\n[metadata]\nz = 1'):
        (tmp_path / "bad.toml").write_text(bad)
        with pytest.raises(ValueError):
            load_settings(tmp_path / "bad.toml")

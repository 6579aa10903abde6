"""Catalogs and runs through URIs, reading only what is new."""

import os

import numpy as np
import pandas as pd
import pytest

from prismflow.functions.folders import read_text, write_text
from prismflow.operators import catalog as ct
from prismflow.operators.catalog import Catalog
from prismflow.plans.runs import fit_run, transform_run
from prismflow.sources.listing import _segments, list_files, summaries


def spectrum(path, n=6, waves=3, step=None):
    df = pd.DataFrame({"Time": np.arange(float(n)), "Step": step or [1] * (n - 2) + [2] * 2, "Sequence": 1} | {f"{400 + w:.1f}nm": np.random.default_rng(n + w).random(n) for w in range(waves)})
    path.parent.mkdir(exist_ok=True)
    df.to_parquet(path, index=False)


@pytest.fixture
def root(tmp_path):
    for k in range(3):
        spectrum(tmp_path / "data set" / f"run-{k}.parquet", 6 + k, 3 + k)
    spectrum(tmp_path / "data set" / "sub" / "run-9.parquet")
    return tmp_path / "data set"


@pytest.mark.parametrize("uri", [False, True])
def test_listing(spark, root, uri):
    base = f"file://{root.as_posix()}" if uri else root.as_posix()
    deep = {r["path"]: (r["size"], r["mtime_ns"]) for r in list_files(spark, base).collect()}
    assert {os.path.basename(p) for p in deep} == {"run-0.parquet", "run-1.parquet", "run-2.parquet", "run-9.parquet"}
    for p, (size, mtime) in deep.items():
        assert os.path.getsize(p) == size and abs(os.stat(p).st_mtime_ns - mtime) < 2_000_000
    assert list_files(spark, base, "run-*.parquet").count() == 3 and list_files(spark, base, "**/run-9*").count() == 1


def test_summaries(spark, root):
    (root / "text.parquet").write_text("no parquet")
    pd.DataFrame({"Time": [1.0], "400.0nm": [1.0]}).to_parquet(root / "lacking.parquet")
    got = {os.path.basename(r["path"]): r for r in summaries(spark, [p.as_posix() for p in root.glob("*.parquet")]).collect()}
    assert got["run-2.parquet"]["n_rows"] == 8 and got["run-2.parquet"]["n_wavelengths"] == 5 and got["run-2.parquet"]["wavelength_max"] == 404.0
    assert [tuple(s) for s in got["run-2.parquet"]["segments"]] == [(1, 1, 6, 5.0), (2, 1, 2, 1.0)]
    assert "Step" in got["lacking.parquet"]["problem"] and got["text.parquet"]["problem"] and got["run-0.parquet"]["problem"] is None


def test_segments_return():
    """A segment that comes back begins anew; its largest StepTime is that of its longest run."""
    got = _segments(np.array([0.0, 1, 2, 3, 4, 9]), np.array([1.0, 1, 2, 1, 1, 1]), np.ones(6))
    assert got == [{"Step": 1, "Sequence": 1, "n_rows": 5, "step_time_max": 6.0}, {"Step": 2, "Sequence": 1, "n_rows": 1, "step_time_max": 0.0}]


def test_unchanged_files_are_not_read(spark, root, tmp_path, monkeypatch):
    read, whole = [], ct.summaries
    monkeypatch.setattr(ct, "summaries", lambda s, paths: read.append(sorted(map(os.path.basename, paths))) or whole(s, paths))
    catalog = Catalog(spark, f"file://{(tmp_path / 'catalog').as_posix()}")
    assert catalog.update(f"file://{root.as_posix()}") == 4 and catalog.update(root) == 0
    spectrum(root / "run-1.parquet", 9, 2)
    (root / "run-0.parquet").unlink()
    spectrum(root / "new.parquet", 5)
    assert catalog.update(root) == 2
    assert read == [["run-0.parquet", "run-1.parquet", "run-2.parquet", "run-9.parquet"], ["new.parquet", "run-1.parquet"]]
    assert {r["stem"]: r["n_rows"] for r in catalog.files.collect()} == {"run-1": 9, "run-2": 8, "run-9": 6, "new": 5}
    assert {(r["stem"], r["Step"]): r["n_rows"] for r in catalog.segments.collect()}[("run-1", 1)] == 7
    assert Catalog(spark, tmp_path / "catalog").files.count() == 4  # the same folder, as a path
    (root / "bad.parquet").write_text("x")
    with pytest.raises(ValueError, match="bad.parquet"):
        catalog.update(root)
    assert catalog.files.count() == 4


def test_runs_through_uris(spark, tmp_path):
    paths = []
    for k in range(6):
        spectrum(tmp_path / "d" / f"f{k}.parquet", 6 if k != 5 else 7, step=[1] * (6 if k != 5 else 7))
        paths.append(f"file://{(tmp_path / 'd' / f'f{k}.parquet').as_posix()}")
    r = np.random.default_rng(0)
    for p in paths:
        df = pd.read_parquet(p.removeprefix("file://"))
        df.iloc[:, 3:] = r.random(df.iloc[:, 3:].shape)
        df.to_parquet(p.removeprefix("file://"), index=False)
    out = f"file://{(tmp_path / 'run').as_posix()}"
    model = fit_run(spark, paths, out, n_component=2, max_null_ratio=0.0)
    assert read_text(spark, f"{out}/model.json") == model.to_json()
    scores = transform_run(spark, paths[:3], out, f"{out}-t")
    assert scores.count() == 3
    with pytest.raises(FileNotFoundError):
        transform_run(spark, paths, f"{out}-none", out)


def test_texts_are_replaced(spark, tmp_path):
    at = (tmp_path / "a" / "t.json").as_posix()
    assert read_text(spark, at) is None
    for text in ("one", "é two", ""):
        write_text(spark, at, text)
        assert read_text(spark, at) == text
    assert [p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")] == ["t.json"]

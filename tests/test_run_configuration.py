"""A run of a catalog goes by the configuration of its folder."""

import pytest

from datastrata.catalog import Catalog
from datastrata.plans import runner


def test_run_loads_the_folders_configuration(spark, tmp_path, monkeypatch):
    catalog = Catalog.create(spark, str(tmp_path))
    given = []
    monkeypatch.setattr(runner, "run", lambda root, only, options, store, remote: given.append(options.config) or [])
    catalog.run()
    (tmp_path / "run.yml").write_text("run:\n  commit: never\n  push: end\n  stages:\n    a: {push: each}\n")
    catalog.run()
    catalog.run(config=None)
    assert given[0] is None and given[2] is None
    assert given[1].of("a.dvc") == {"commit": "never", "push": "each"} and given[1].of("b")["push"] == "end"
    (tmp_path / "run.yml").write_text("run:\n  push: sometimes\n")
    with pytest.raises(ValueError):
        catalog.run()

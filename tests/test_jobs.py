import json

import pytest

from tallyweave.plans import jobs

from .test_models import made


def test_reproduce_and_resume(spark, tmp_path):
    made(tmp_path / "set", "train", 60)
    made(tmp_path / "set", "test", 15)
    data, artifacts, output = (str(tmp_path / n) for n in ("set", "artifacts", "output"))
    config = jobs.DEFAULTS | {"samples": 60, "seed": 17, "top_k": 12, "trees": 2}
    report = jobs.reproduce(spark, data, artifacts, output, config)
    assert report["ok"], report
    assert report["counts"]["s1"] == 15
    held = json.loads((tmp_path / "artifacts/experiment/validation.json").read_text())["holdout"]
    assert held["candidate_recall"] == 1.0 and held["queries"] == 9
    first = jobs.predict(spark, data, artifacts, config).count()
    assert jobs.predict(spark, data, artifacts, config).count() == first
    single = jobs.assemble(spark, data, artifacts, output, config, exclusive=True)
    assert single["queries"] == 15 and jobs.audited(spark, data, output)["ok"]
    with pytest.raises(ValueError):
        jobs.candidates(spark, data, artifacts, config | {"top_k": 5})

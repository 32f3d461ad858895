"""python -m tallyweave STEP --data D --artifacts A --output O [--config FILE]; exit code 1 if an audit fails."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyweave")
    parser.add_argument("step", choices=("train", "predict", "assemble", "audit", "reproduce"))
    for name in ("data", "artifacts", "output"):
        parser.add_argument(f"--{name}", default=name)
    parser.add_argument("--config")
    parser.add_argument("--exclusive", action="store_true", default=None)
    given = parser.parse_args(args)

    from pyspark.sql import SparkSession

    from .plans import jobs

    config = jobs.DEFAULTS | (json.loads(Path(given.config).read_text()) if given.config else {})
    spark = SparkSession.builder.appName("tallyweave").getOrCreate()
    places = (spark, given.data, given.artifacts)
    if given.step == "train":
        out = jobs.train(*places, config)["holdout"]
    elif given.step == "predict":
        out = {"rows": jobs.predict(*places, config).count()}
    elif given.step == "assemble":
        out = jobs.assemble(*places, given.output, config, given.exclusive)
    elif given.step == "audit":
        out = jobs.audited(spark, given.data, given.output)
    else:
        out = jobs.reproduce(*places, given.output, config)
    print(json.dumps(out, indent=2))
    return 0 if out.get("ok", True) else 1


if __name__ == "__main__":
    sys.exit(main())

"""Archives: safe extraction, the result package, report figures' data, and the methods text."""

from __future__ import annotations

import json
import zipfile
from datetime import date
from pathlib import Path

from .records import write_json

# Folders and files that never go into a package.
SKIPPED_FOLDERS = ("__pycache__", ".git", ".venv", "data", "dataset")
SKIPPED_FILES = (".env", ".envrc", "credentials", "secrets.json")
RESULTS = ("matching_results.tsv", "candidate_pairs.tsv")


def extract(archive: str, root: str, prefix: str) -> list[str]:
    """Unpack the members under prefix; hidden files are left out, and a member that would land
    outside root is an error."""
    base, out = Path(root).resolve(), []
    with zipfile.ZipFile(archive) as held:
        for member in held.infolist():
            parts = Path(member.filename).parts
            if member.is_dir() or not member.filename.startswith(prefix) or any(p.startswith(".") and p != ".." for p in parts):
                continue
            to = (base / member.filename).resolve()
            if not to.is_relative_to(base):
                raise ValueError(f"member outside the target folder: {member.filename}")
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(held.read(member))
            out.append(str(to))
    return out


def package(destination: str, results: str, project: str, methods: str) -> str:
    """ZIP of the result files, the code, the reports and the methods text."""
    root, out = Path(project), Path(results)
    needed = [out / name for name in RESULTS] + [Path(methods), root / "README.md", root / "requirements.txt"]
    if missing := [str(p) for p in needed if not p.is_file()]:
        raise FileNotFoundError(", ".join(missing))
    wanted = {f"output/{name}": out / name for name in RESULTS} | {"methods.md": Path(methods)}
    for name in ("README.md", "requirements.txt", "LICENSE", "run_config.json"):
        if (root / name).is_file():
            wanted[f"code/{name}"] = root / name
    for folder in ("src", "reports"):
        for path in sorted((root / folder).rglob("*")):
            inside = path.relative_to(root)
            if path.is_file() and not set(inside.parts) & set(SKIPPED_FOLDERS) and path.name not in SKIPPED_FILES and path.suffix not in (".pyc", ".pyo"):
                wanted[f"code/{inside.as_posix()}"] = path
    Path(destination).parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(destination, "w", zipfile.ZIP_DEFLATED) as held:
        for name, path in wanted.items():
            held.write(path, name)
    return destination


def figure_data(report: dict) -> dict:
    """The three figures as rows: threshold curve by weight, figures by group, the 15 greatest importances."""
    groups = {"Overall": report["holdout"], **report.get("holdout_by_country", {})}
    measures = ("macro_f05", "micro_precision", "micro_recall", "candidate_recall", "singleton_accuracy")
    ranked = sorted(report["feature_importance"].items(), key=lambda x: -x[1])[:15]
    return {
        "schema_version": 1,
        "threshold_curve": [{"weight": r.get("weight", 0.0), "threshold": r["threshold"], "macro_f05": r["macro_f05"]} for r in report["threshold_curve"]],
        "selected_threshold": report["threshold"],
        "groups": [{"group": g, **{m: values.get(m) for m in measures}} for g, values in groups.items()],
        "importance": [{"feature": f, "gain": v} for f, v in ranked],
    }


def write_figure_data(report: dict, folder: str) -> str:
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = f"{folder}/plot_data.json"
    write_json(figure_data(report), path)
    return path


def methods_text(audit: dict, report: dict, calibration: dict) -> str:
    """A methods report in Markdown; refused unless the audit is clean."""
    if not audit["ok"]:
        raise ValueError(f"the outputs failed their audit: {audit['errors'][:5]}")
    alone = calibration.get("exclusive", False)
    held = report["graph_ablation"]["holdout"]["exclusive"] if alone else report["holdout"]
    figures = "\n".join(f"- {k}: {json.dumps(held[k])}" for k in ("queries", "macro_f05", "micro_precision", "micro_recall", "candidate_recall", "singleton_accuracy"))
    return (
        f"# Record linkage: methods and results\n\nDate: {date.today().isoformat()}\n\n"
        "Records are normalised, expanded into blocking keys, and joined on the keys that are rare enough; "
        f"each reference keeps its {calibration['top_k']} best candidates (keys with more than {calibration['max_postings']} targets are skipped whole). "
        f"Two boosted-tree models score 47 features of a pair; the second one's weight is {calibration.get('weight', 0):g}, the threshold {calibration['threshold']:.6f}, "
        f"one owner for each target: {'yes' if alone else 'no'}. All settings were chosen on the tuning split.\n\n"
        f"## Holdout\n\n{figures}\n\n## Output\n\n- candidates: {audit['counts']['candidate_ids']}\n- matches: {audit['counts']['matched_ids']}\n"
    )

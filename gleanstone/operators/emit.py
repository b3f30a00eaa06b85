"""Cases as YAML, and the human-gated step that appends them to a dataset."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanstone.config import ORDINARY
from gleanstone.errors import GleanstoneError
from gleanstone.functions.coerce import slug
from gleanstone.operators.label import PLACEHOLDER_MARK

PREFIX = "gleanstone"


def case_id(window: Column, record_id: Column) -> Column:
    return F.concat_ws("_", F.lit(PREFIX), slug(window), slug(record_id))


def cases(candidates: DataFrame, labels: DataFrame, window: str) -> DataFrame:
    """(rank, id, tags, input, criteria, notes) of the candidates whose draft succeeded."""
    drafted = labels.where("draft_error is null").select("record_id", "criteria", "notes", "model_id", "dry_run")
    both = candidates.join(drafted, "record_id")
    reasons = F.coalesce("reasons", F.array().cast("array<string>"))
    signals = F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")).otherwise("none, ordinary traffic")
    notes = F.concat_ws(
        "\n",
        F.when(F.col("dry_run"), F.lit("Placeholder criteria of a dry run; no model read this record.")),
        F.format_string("Mined and NOT REVIEWED: window %s, record %s, stratum %s, score %d.", F.lit(window), "record_id", F.coalesce("stratum", F.lit(ORDINARY)), F.coalesce("score", F.lit(0)).cast("int")),
        F.format_string("Signals: %s.", signals),
        F.format_string("Criteria drafted by %s and not yet read by a human.", "model_id"),
        F.when(F.col("notes") != "", F.format_string("Drafter's note: %s", "notes")),
    )
    return both.select("rank", case_id(F.lit(window), F.col("record_id")).alias("id"), F.concat(F.array(F.lit(PREFIX)), reasons).alias("tags"), F.col("input_text").alias("input"), "criteria", notes.alias("notes")).orderBy("rank")


class _Block(str):
    __slots__ = ()


class _Dumper(yaml.SafeDumper):
    pass


_Dumper.add_representer(_Block, lambda d, s: d.represent_scalar("tag:yaml.org,2002:str", str(s), style="|" if "\n" in s and not re.search(r"[ \t]\n|[^\x20-\x7e\n\xa0-퟿]", s) else '"'))


def render_yaml(rows: list[dict]) -> str:
    """YAML of cases, read back and compared before it is handed out."""
    plain = [{"id": r["id"], "tags": list(r["tags"]), "input": _Block(r["input"]), "criteria": list(r["criteria"]), "notes": _Block(r["notes"])} for r in rows]
    text = yaml.dump(plain, Dumper=_Dumper, sort_keys=False, allow_unicode=True, width=10_000)
    back = yaml.safe_load(text) or []
    if back != [{k: (str(v) if isinstance(v, str) else v) for k, v in p.items()} for p in plain]:
        raise GleanstoneError("the cases don't survive being written")
    return text


def replace_file(path: str | Path, text: str, mode: int = 0o600) -> None:
    """Writes beside the file, flushes to the disk and renames over it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.chmod(name, mode)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def review(candidates: DataFrame, labels: DataFrame, window: str) -> str:
    """The document for whoever reads the drafts: every case with its record and reasons, and every failed draft, in rank order."""
    told = labels.select("record_id", "criteria", "notes", "draft_error", "model_id", "dry_run", "prompt_sha256")
    rows = [r.asDict() for r in candidates.join(told, "record_id").orderBy("rank").collect()]  # a shortlist
    good, bad = [r for r in rows if r["draft_error"] is None], [r for r in rows if r["draft_error"] is not None]
    quoted = lambda t: "\n".join(f"> {line}" for line in (t or "(none, the call failed)").splitlines() or [""])
    out = [f"# Drafts of {window}", "", f"{len(good)} drafted, {len(bad)} failed. Nothing here was read by a human yet."]
    if any(r["dry_run"] for r in rows):
        out += ["", "**Dry run: the criteria are placeholders and can't be promoted.**"]
    for r in good:
        out += ["", f"## {r['rank']}. {r['record_id']}", "", f"Stratum {r['stratum'] or ORDINARY}, score {r['score'] or 0}; signals: {', '.join(r['reasons'] or []) or 'none'}; drafted by {r['model_id']}; prompt {r['prompt_sha256'][:12]}."]
        out += ["", "Request:", "", quoted(r["input_text"]), "", "Response:", "", quoted(r["output_text"]), "", "Criteria:", ""]
        out += [f"- [ ] {c}" for c in r["criteria"]] + (["", f"Note: {r['notes']}"] if r["notes"] else [])
    if bad:
        out += ["", "## Failed drafts", "", "| rank | record | error |", "|---|---|---|"] + [f"| {r['rank']} | {r['record_id']} | {r['draft_error']} |" for r in bad]
    return "\n".join(out) + "\n"


def emit(case_rows: DataFrame, write: Callable[[str], None], failed: int = 0) -> int:
    """Hands the cases' YAML to ``write``; the shortlist bounds their number. Returns 0, 1 if drafts failed, or 2 if there are no cases."""
    rows = [r.asDict() for r in case_rows.collect()]
    write(render_yaml(rows))
    return 2 if not rows else 1 if failed else 0


def promote(drafts: str, target: str | Path, ids: list[str], reviewer: str) -> int:
    """Appends the named cases of ``drafts``, the text of a window's cases, to the file ``target``; the text that is there stays as it is.

    Refuses without reviewer or identifiers, for unknown or present ones, and for placeholder criteria.
    """
    if not reviewer.strip() or not ids:
        raise GleanstoneError("a reviewer and the identifiers to promote must be named")
    here = {c["id"]: c for c in yaml.safe_load(drafts) or []}
    target = Path(target)
    old = target.read_text(encoding="utf-8") if target.exists() else ""
    present = {c["id"] for c in yaml.safe_load(old) or []}
    if unknown := [i for i in ids if i not in here]:
        raise GleanstoneError(f"no such case: {', '.join(unknown)}")
    if twice := [i for i in ids if i in present or ids.count(i) > 1]:
        raise GleanstoneError(f"there already: {', '.join(sorted(set(twice)))}")
    if fake := [i for i in ids if any(PLACEHOLDER_MARK in c for c in here[i]["criteria"])]:
        raise GleanstoneError(f"placeholder criteria: {', '.join(fake)}")
    chosen = [{**here[i], "notes": f"{here[i]['notes']}\nReviewed by {reviewer.strip()}."} for i in ids]
    text = old + ("" if not old or old.endswith("\n") else "\n") + render_yaml(chosen)
    if [c["id"] for c in yaml.safe_load(text)] != [*[c["id"] for c in yaml.safe_load(old) or []], *ids]:
        raise GleanstoneError("the dataset would not read back as written")
    replace_file(target, text, 0o644)
    return len(ids)

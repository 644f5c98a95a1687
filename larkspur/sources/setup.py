"""What a run is set up with, on the driver: the profile, prompts, schemas, its manifest, and checks before it begins."""

from __future__ import annotations

import datetime
import hashlib
import json
import secrets
import string
import subprocess
import tomllib
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Fields that a draft needs, and fields of the profile by section.
NEEDED = ("survey_url", "sender.name", "sender.affiliation", "sender.school_short", "invitation.topic")
SECTIONS = {"": {"goal", "about_me", "survey_url", "sender", "invitation"}}


class SetupError(RuntimeError):
    pass


def load_profile(path: str, sections: dict[str, set[str]] | None = None) -> dict:
    """The profile at path. Keys that sections (by name; "" the top) don't list, no goal, and a survey that isn't https are errors."""
    try:
        data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise SetupError(f"{path}: {e}") from e
    for name, allowed in (SECTIONS | (sections or {})).items():
        if unknown := set(data if not name else data.get(name, {})) - allowed:
            raise SetupError(f"{path}: unknown {', '.join(sorted(unknown))}")
    trimmed = {k: {a: b.strip() if isinstance(b, str) else b for a, b in v.items()} if isinstance(v, dict) else v.strip() if isinstance(v, str) else v for k, v in data.items()}
    if not trimmed.get("goal"):
        raise SetupError(f"{path}: no goal")
    if trimmed.get("survey_url") and not trimmed["survey_url"].startswith("https://"):
        raise SetupError(f"{path}: survey_url must begin with https://")
    return trimmed


def _value(profile: dict, key: str) -> str:
    section, _, name = key.rpartition(".")
    return str((profile.get(section, {}) if section else profile).get(name, "") or "")


def drafting_gaps(profile: dict) -> list[str]:
    return [key for key in NEEDED if not _value(profile, key).strip()]


def eszett_fields(profile: dict) -> list[str]:
    """Fields whose text has a sharp s, which Swiss mails don't."""
    fields = [*(k for k, v in profile.items() if isinstance(v, str)), *(f"{s}.{k}" for s, v in profile.items() if isinstance(v, dict) for k in v)]
    return [k for k in fields if "ß" in _value(profile, k)]


def load_prompt(folder: str, name: str) -> tuple[str, str]:
    """Version and text of a prompt file: between two lines of --- a header with the version, then the text."""
    path = Path(folder) / f"{name}.md"
    parts = path.read_text(encoding="utf-8").split("---\n", 2) if path.is_file() else []
    if len(parts) != 3 or parts[0]:
        raise SetupError(f"{path}: no prompt with a header")
    fields = dict(line.split(":", 1) for line in parts[1].splitlines() if ":" in line)
    version = {k.strip(): v.strip() for k, v in fields.items()}.get("version")
    if not version:
        raise SetupError(f"{path}: no version")
    return version, parts[2].strip()


def rendered(folder: str, name: str, /, **values: str) -> tuple[str, str]:
    """Version and text of a prompt with its variables filled in; one that lacks is an error."""
    version, text = load_prompt(folder, name)
    try:
        return version, string.Template(text).substitute(values)
    except KeyError as e:
        raise SetupError(f"{name}: no value for {e.args[0]}") from e


def as_data(text: str, label: str = "PAGE", url: str | None = None) -> str:
    """Text of strangers between marks that it can't know, its own marks broken."""
    nonce = secrets.token_hex(8)
    while "<<<" in text:
        text = text.replace("<<<", "<< <")
    return f"<<<{label}-{nonce}{f' url={url}' if url else ''}>>>\n{text}\n<<<END-{nonce}>>>"


def register_query(graph: str, prefixes: dict[str, str], required: dict[str, str], optional: dict[str, str], forms: list[str], form: str, limit: int, offset: int) -> str:
    """A SPARQL query for a page of a register: required and optional variables with their property paths, of companies of some legal forms."""
    head = "\n".join(f"PREFIX {k}: <{v}>" for k, v in prefixes.items())
    names = " ".join(f"?{v}" for v in (*required, *optional))
    body = [f"?c {path} ?{v} ." for v, path in required.items()] + [f"FILTER(?{form} IN ({', '.join(f'<{x}>' for x in forms)}))"] + [f"OPTIONAL {{ ?c {path} ?{v} }}" for v, path in optional.items()]
    lines = "\n    ".join(body)
    return f"{head}\nSELECT {names} WHERE {{\n  GRAPH <{graph}> {{\n    {lines}\n  }}\n}} ORDER BY ?{next(iter(required))} LIMIT {limit} OFFSET {offset}"


def pages(ask: Callable[[int, int], list[dict]], size: int) -> Iterator[list[dict]]:
    """Pages of a service from the first on; the last is the one that isn't full."""
    offset = 0
    while True:
        rows = ask(size, offset)
        yield rows
        if len(rows) < size:
            return
        offset += size


def register(spark: SparkSession, ask: Callable[[int, int], list[dict]], size: int, path: str, schema: str) -> DataFrame:
    """All rows of a paged service, each page written under path as it comes; a register without rows is an error."""
    n = 0
    for k, rows in enumerate(pages(ask, size)):
        if rows:
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/page-{k:06d}")
            n += len(rows)
    if not n:
        raise SetupError("the register gave no rows")
    return spark.read.schema(schema).parquet(f"{path}/page-*")


def empty_tables(spark: SparkSession, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in schemas.items()}


def migrated(table: DataFrame, schema: str) -> DataFrame:
    """A table with the columns of schema, in its order: those it lacks are null, those of other types are cast, others stay at the end."""
    wanted = table.sparkSession.createDataFrame([], schema).schema
    own = [table[f.name].cast(f.dataType) if f.name in table.columns else _null(f) for f in wanted]
    return table.select(*own, *(c for c in table.columns if c not in wanted.names))


def _null(field):
    from pyspark.sql import functions as F

    return F.lit(None).cast(field.dataType).alias(field.name)


def git_commit(folder: str) -> str | None:
    found = subprocess.run(["git", "-C", folder, "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=False)
    return found.stdout.strip() or None


def manifest(run_id: str, profile: dict, prompts: dict[str, str], folder: str, **settings: object) -> str:
    """What a run was made with, as JSON: when, the code's commit, versions of prompts, settings, and the profile's hash but not its text."""
    said = {"run_id": run_id, "began": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"), "commit": git_commit(folder), "prompts": prompts, "settings": settings}
    said["profile_sha256"] = hashlib.sha256(json.dumps(profile, sort_keys=True).encode()).hexdigest()
    return json.dumps(said, sort_keys=True, ensure_ascii=False)


def health(checks: dict[str, Callable[[], object]]) -> list[tuple[str, bool, str]]:
    """name, whether it is well, and what was said, of each check; one that raises is unwell and stops none of the others."""
    out = []
    for name, check in checks.items():
        try:
            out.append((name, True, str(check() or "")))
        except Exception as e:  # noqa: BLE001
            out.append((name, False, f"{type(e).__name__}: {e}"))
    return out

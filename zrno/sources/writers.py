"""Sinks: shards with manifests, append-only logs, reports, dataset cards."""

from __future__ import annotations

import datetime
import json
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from zrno.functions.text import words

MARKER = "<!-- GENERATED by {by}; do not edit. -->"


def utc_now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def revision(folder: str | Path = ".") -> str:
    """The commit a result is made from, with -dirty for uncommitted changes; unknown outside a repository."""
    git = lambda *a: subprocess.run(["git", "-C", str(folder), *a], capture_output=True, text=True, check=False)
    head = git("rev-parse", "HEAD")
    if head.returncode:
        return "unknown"
    return head.stdout.strip() + ("-dirty" if git("status", "--porcelain").stdout.strip() else "")


def fingerprint(df: DataFrame) -> str:
    """A hash of a table's rows that doesn't depend on their order or on files: count and sums of row hashes."""
    h = F.xxhash64(*df.columns)
    r = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit((1 << 31) - 1)))).first()
    return "-".join(format(int(x or 0) & 0xFFFFFFFFFFFFFFFF, "x") for x in r)


def write_shard(df: DataFrame, path: str, manifest: str | Path, source: str, script: str, args: dict | None = None, band: tuple[int, int] | None = None, skipped: dict[str, int] | None = None) -> dict:
    """Writes documents as JSON lines, then, only if all went well, their manifest. Counts are observed while writing, so the data is read once."""
    seen = Observation("shard")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    df.observe(seen, F.count(F.lit(1)).alias("n_docs"), n(F.length("text")).alias("n_chars"), n(F.size(words("text"))).alias("n_words")).write.mode("overwrite").json(path)
    m = {"source": source, "script": script, "git_sha": revision(), "retrieved_at": utc_now(), "args": args or {}, **{k: int(v) for k, v in seen.get.items()}, "fingerprint": fingerprint(df.sparkSession.read.schema(df.schema).json(path))}
    if band:
        m["expected_band_words"] = list(band)
        m["in_band"] = band[0] <= m["n_words"] <= band[1]
    if skipped is not None:
        m["skip_counts"] = skipped
    write_manifest(manifest, m)
    return m


def write_manifest(path: str | Path, data: dict) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    tmp = p.with_suffix(p.suffix + ".tmp")
    tmp.write_text(json.dumps(data, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    tmp.replace(p)


def append_log(df: DataFrame, path: str) -> None:
    """Appends events; nothing that is there is touched."""
    df.write.mode("append").json(path)


def save_ledger(works: DataFrame, path: str) -> None:
    """The ledger sorted by work, as one file: it is kept under version control and small."""
    works.orderBy("work_id").coalesce(1).write.mode("overwrite").json(path)


def markdown(title: str, df: DataFrame, by: str, order: list[str] | None = None, most: int = 10_000) -> str:
    """A report of an aggregated table; it must be one, so more than `most` rows are an error, not cut off."""
    rows = (df.orderBy(*order) if order else df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{title}: more than {most} rows are no report")
    cell = lambda v: "" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    head = [MARKER.format(by=by), f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def freshness(report: str, now: str) -> str:
    """fresh, stale or unstamped, by the revision a report names."""
    import re

    m = re.search(r"git_sha: ([0-9a-f]+(?:-dirty)?)", report)
    return "unstamped" if not m else "fresh" if m[1] == now else "stale"


def uploads(card: str | Path, pairs: str | Path, manifest: str | Path, raw: str | Path) -> list[tuple[Path, str, bool]]:
    """(local file, remote name, whether it is required) of a published set of pairs; the raw log is added where it exists."""
    return [(Path(card), "README.md", True), (Path(pairs), "pairs.jsonl", True), (Path(manifest), "provenance/pairs.manifest.json", True), (Path(raw), "provenance/responses.jsonl", False)]


def require_uploads(files: list[tuple[Path, str, bool]]) -> list[tuple[Path, str]]:
    """What there is to upload; a required file that is missing is an error."""
    missing = [str(p) for p, _, needed in files if needed and not p.exists()]
    if missing:
        raise FileNotFoundError(f"can't publish, missing: {missing}")
    return [(p, name) for p, name, _ in files if p.exists()]


def dataset_card(name: str, licence: str, manifests: list[dict], allowed: tuple[str, ...] = ("cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0")) -> str:
    """A card from manifests; without an allowed licence there is none."""
    if licence.lower() not in allowed:
        raise ValueError(f"licence {licence} can't be published")
    rows = "\n".join(f"| {m['source']} | {m['n_docs']:,} | {m['n_words']:,} |" for m in manifests)
    return f"---\nlicense: {licence.lower()}\n---\n# {name}\n\n| source | documents | words |\n|---|---|---|\n{rows}\n"

"""Reports of triage and acquisition: HTML pages without any outside file, JSON, and the log beside an image."""

from __future__ import annotations

import json
import os
import platform
from collections.abc import Sequence
from datetime import UTC, datetime
from html import escape

TOOL = "tracewell"
# How results are called in reports.
HASH_NAMES = {"md5": "MD5", "sha1": "SHA-1", "sha256": "SHA-256"}
OS_LABELS = {"name": "Operating system", "edition": "Edition", "version": "Version", "build": "Build", "codename": "Codename", "installed": "Installed", "architecture": "Architecture", "registered_owner": "Registered owner", "registered_org": "Registered organisation", "product_id": "Product ID", "kernel_versions": "Kernels"}
DEVICE_LABELS = {"computer_name": "Computer name", "domain": "Domain", "manufacturer": "Manufacturer", "model": "Model", "bios": "BIOS", "ip_addresses": "IP addresses", "time_zone": "Time zone", "utc_offset": "UTC offset", "last_shutdown": "Last shutdown", "last_mounted_at": "Last mounted at", "last_mounted": "Last mounted", "last_written": "Last written"}
#: Rows of bad ranges in a report.
MOST = 200
_STYLE = "body{font:14px system-ui,sans-serif;margin:2em;max-width:70em}h2{margin-top:1.6em}table{border-collapse:collapse;width:100%}td,th{border-bottom:1px solid #ccc;padding:.3em .6em;text-align:left;vertical-align:top}.bad{color:#a00}.ok{color:#070}.card{display:inline-block;border:1px solid #ccc;padding:.6em 1em;margin:0 .6em .6em 0}"


def size_text(n: float | None, base: int = 1024, places: int = 2) -> str:
    """As functions.scalars.size_text, for one number; a dash for none."""
    if n is None:
        return "-"
    units, k = (("B", "KiB", "MiB", "GiB", "TiB") if base == 1024 else ("B", "KB", "MB", "GB", "TB")), 0
    while n >= base and k < 4:
        n, k = n / base, k + 1
    return f"{n:.0f} B" if not k else f"{n:.{places}f} {units[k]}"


def time_text(seconds: float | None) -> str:
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%d %H:%M:%S UTC") if seconds else "-"


def duration_text(seconds: float | None) -> str:
    if seconds is None:
        return "-"
    minutes, s = divmod(round(seconds), 60)
    h, m = divmod(minutes, 60)
    return f"{h}h {m:02d}m {s:02d}s" if h else f"{m}m {s:02d}s"


def speed_text(rate: float | None) -> str:
    return f"{(rate or 0) / 1e6:.1f} MB/s"


def _cell(v) -> str:
    return escape(", ".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v))


def table(heads: Sequence[str], rows: Sequence[Sequence]) -> str:
    if not rows:
        return "<p>None</p>"
    return f"<table><tr>{''.join(f'<th>{_cell(h)}</th>' for h in heads)}</tr>{''.join('<tr>' + ''.join(f'<td>{_cell(c)}</td>' for c in r) + '</tr>' for r in rows)}</table>"


def pairs(values: dict, labels: dict[str, str]) -> str:
    """Only what is known is told."""
    return table(("", ""), [(label, values[k]) for k, label in labels.items() if values.get(k) not in (None, "", [])])


def _findings(rows: Sequence[dict]) -> str:
    return "".join(f'<p class="{_cell(f["level"])}"><b>{_cell(f["title"])}</b> {_cell(f["detail"])}</p>' for f in rows) or "<p>None</p>"


def _page(title: str, *parts: str) -> str:
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{_cell(title)}</title><style>{_STYLE}</style></head><body><h1>{_cell(title)}</h1>{"".join(parts)}<p>Made by {TOOL} on {time_text(datetime.now(UTC).timestamp())}</p></body></html>'


def is_admin(user: dict) -> bool:
    """Root, or the built-in administrator."""
    return user.get("uid") == 0 or user.get("rid") == 500


def triage_html(document: dict) -> str:
    """document: of plans.triage.documents()."""
    image, systems = document.get("image") or {}, document.get("systems") or []
    parts = []
    if systems:
        first, users = systems[0], [u.get("username") or "" for u in systems[0].get("users") or []]
        known, saved = first.get("os") or {}, first.get("last_saved") or {}
        cards = [("System", " ".join(filter(None, (known.get("name"), known.get("version"), known.get("build"))))), ("Device", (first.get("device") or {}).get("computer_name")), ("Users", f"{len(users)}: {', '.join(users[:4])}{', …' if len(users) > 4 else ''}"), ("Last saved", saved.get("path"))]
        parts.append("".join(f'<div class="card"><b>{_cell(k)}</b><br>{_cell(v)}</div>' for k, v in cards))
    parts += ["<h2>Findings</h2>", _findings(document.get("findings") or [])]
    parts += ["<h2>Image</h2>", table(("", ""), [("File", (image.get("segments") or [""])[0]), ("Format", image.get("format")), ("Size", size_text(image.get("size"), 1000, 1)), ("MD5", image.get("md5")), ("SHA-1", image.get("sha1")), *(image.get("header") or {}).items()])]
    parts += ["<h2>Volumes</h2>", table(("#", "Offset", "Size", "Type", "Name", "File system", "System"), [(v.get("index"), v.get("offset"), size_text(v.get("size"), 1000, 1), v.get("type"), v.get("name"), v.get("fs"), v.get("os")) for v in document.get("volumes") or []])]
    for s in systems:
        parts += [f"<h2>Partition {_cell((s.get('volume') or {}).get('index'))}</h2>", pairs(s.get("os") or {}, OS_LABELS), "<h3>Device</h3>", pairs(s.get("device") or {}, DEVICE_LABELS)]
        rows = [(f"{u.get('username') or ''}{' (administrator)' if is_admin(u) else ''}", u.get("full_name"), u.get("account"), u.get("last_logon"), (u.get("last_saved") or {}).get("path"), (u.get("recent_doc") or {}).get("name"), u.get("profile")) for u in s.get("users") or []]
        parts += ["<h3>Users</h3>", table(("User", "Name", "Account", "Last login", "Last saved", "Last opened", "Profile"), rows)]
        parts += ["<h3>Newest files</h3>", table(("Saved", "User", "Path", "Size"), [(f.get("modified"), f.get("user"), f.get("path"), size_text(f.get("size"), 1000, 1)) for f in s.get("recent_files") or []])]
    return _page("Triage report", *parts)


def acquisition_html(result: dict, scan: dict | None = None, case: dict | None = None) -> str:
    """result: of plans.capture.acquire()."""
    rows = [("Source", result["source"]), ("Size", f"{result['total_bytes']:,} bytes ({size_text(result['total_bytes'])})"), ("Format", result["format"]), ("Compression", result["compression"] or "-"), ("Started", time_text(result["started_at"])), ("Finished", time_text(result["finished_at"])), ("Duration", duration_text(result["duration"])), ("Average speed", speed_text(result["avg_speed"])), ("Bad sectors", f"{result['bad_sectors']:,} (zero-filled)")]
    parts = ["<h2>Case</h2>", table(("", ""), list((case or {}).items())), "<h2>Acquisition</h2>", table(("", ""), rows)]
    parts += ["<h2>Hashes</h2>", table(("", ""), [(HASH_NAMES.get(a, a), h) for a, h in result["hashes"].items()])]
    if result.get("verify"):
        parts.append(f'<p class="{"ok" if result["verify"]["match"] else "bad"}">Verification: {"match" if result["verify"]["match"] else "mismatch"}</p>')
    if scan:
        parts += [f"<h2>Scan: {_cell(scan['verdict'])}</h2>", _findings(scan["findings"])]
    if result["bad_ranges"]:
        parts += ["<h2>Unreadable ranges</h2>", table(("First sector", "Sectors"), result["bad_ranges"][:MOST])]
    return _page("Acquisition report", *parts, "<h2>Files</h2>", table(("",), [(p,) for p in result["paths"]]))


def acquisition_log(result: dict, scan: dict | None = None, case: dict | None = None, device: dict | None = None) -> str:
    """The text that stands beside an image."""
    case, device = case or {}, device or {}
    lines = [f"Created by {TOOL}", f"Host: {platform.node()} ({platform.platform()})", "", "[Case]"]
    lines += [f"{label + ':':<17}{case.get(k, '')}" for k, label in (("case_number", "Case number"), ("evidence_number", "Evidence number"), ("examiner", "Examiner"), ("description", "Description"), ("notes", "Notes"))]
    lines += ["", "[Source]", f"{'Path:':<17}{result['source']}", f"{'Model:':<17}{device.get('model', '')}", f"{'Serial:':<17}{device.get('serial', '')}", f"{'Size:':<17}{result['total_bytes']:,} bytes ({size_text(result['total_bytes'])})", f"{'Sector size:':<17}{result['sector_size']}", "", "[Scan]"]
    lines += [f"{'Mode:':<17}{scan['mode']}   Verdict: {scan['verdict'].upper()}", *(f"  - [{f['level']}] {f['title']}: {f['detail']}" for f in scan["findings"])] if scan else ["Skipped"]
    lines += ["", "[Acquisition]", f"{'Format:':<17}{'E01 (EnCase 6)' if result['format'] == 'e01' else 'Raw (dd)'}", f"{'Compression:':<17}{result['compression'] or '-'}", f"{'Started:':<17}{time_text(result['started_at'])}", f"{'Finished:':<17}{time_text(result['finished_at'])}", f"{'Duration:':<17}{duration_text(result['duration'])}", f"{'Average speed:':<17}{speed_text(result['avg_speed'])}", f"{'Bad sectors:':<17}{result['bad_sectors']:,} (zero-filled)"]
    lines += [f"  LBA {a} (+{n})" for a, n in result["bad_ranges"]] + ["", "[Hashes]", *(f"{HASH_NAMES.get(a, a) + ':':<17}{h}" for a, h in result["hashes"].items())]
    if v := result.get("verify"):
        lines.append(f"{'Verification:':<17}{'MATCH' if v['match'] else 'MISMATCH'} ({duration_text(v['duration'])})")
    return "\n".join([*lines, "", "[Files]", *result["paths"]]) + "\n"


def write_new(path: str, text: str, newline: str = "\n") -> str:
    """A file that must not exist yet."""
    with open(path, "x", encoding="utf-8", newline=newline) as f:
        f.write(text)
    return path


def save(folder: str, name: str, content: dict, kind: str, html: str) -> str:
    """name-report.html or .json."""
    if kind not in ("html", "json"):
        raise ValueError(f"unknown kind of report {kind}")
    path = os.path.join(folder, f"{name}-report.{kind}")
    with open(path, "w", encoding="utf-8") as f:
        f.write(html if kind == "html" else json.dumps(content, indent=2, default=str))
    return path

"""Reports as one HTML file, with tables and drawn curves, and as Markdown."""

from __future__ import annotations

import html
import math

STYLE = "body{font:15px sans-serif;margin:2em;max-width:80em}table{border-collapse:collapse;font-size:13px}td,th{border:1px solid #ccc;padding:3px 7px;text-align:left}svg{background:#fafafa;border:1px solid #ccc}.t{overflow-x:auto}"


def cell(x) -> str:
    if x is None or isinstance(x, float) and not math.isfinite(x):
        return ""
    return f"{x:.6g}" if isinstance(x, float) else html.escape(str(x))


def table(title: str, rows: list[dict], file: str | None = None, most: int = 100) -> str:
    names = list(dict.fromkeys(k for r in rows for k in r))
    head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
    body = "".join("<tr>" + "".join(f"<td>{cell(r.get(n))}</td>" for n in names) + "</tr>" for r in rows[:most])
    more = f"<p>{most} of {len(rows):,} rows.</p>" if len(rows) > most else ""
    link = f'<p><a href="{html.escape(file)}">all rows</a></p>' if file else ""
    return f"<h2>{html.escape(title)}</h2>{link}<div class='t'><table><tr>{head}</tr>{body}</table></div>{more}"


def curves(title: str, lines: dict[str, list[tuple[float, float]]], width: int = 640, height: int = 300) -> str:
    """Lines over a shared scale, as inline SVG."""
    points = [p for line in lines.values() for p in line if all(map(math.isfinite, p))]
    if not points:
        return ""
    (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*points, strict=True))
    at = lambda x, y: f"{40 + (x - x0) / ((x1 - x0) or 1) * (width - 60):.1f},{height - 25 - (y - y0) / ((y1 - y0) or 1) * (height - 50):.1f}"
    colours = ("#1f5fa8", "#c2571a", "#3a7d44", "#7a4b9a")
    drawn = ""
    for i, (name, line) in enumerate(lines.items()):
        c = colours[i % len(colours)]
        path = " ".join(at(x, y) for x, y in line if math.isfinite(x) and math.isfinite(y))
        drawn += f"<polyline fill='none' stroke='{c}' stroke-width='2' points='{path}'/><text x='{50 + 150 * i}' y='15' fill='{c}' font-size='12'>{html.escape(name)}</text>"
    ends = f"<text x='2' y='{height - 25}' font-size='10'>{y0:.4g}</text><text x='2' y='30' font-size='10'>{y1:.4g}</text><text x='40' y='{height - 5}' font-size='10'>{x0:.4g}</text><text x='{width - 60}' y='{height - 5}' font-size='10'>{x1:.4g}</text>"
    return f"<h2>{html.escape(title)}</h2><svg width='{width}' height='{height}'>{drawn}{ends}</svg>"


def page(title: str, parts: list[str]) -> str:
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>{''.join(parts)}</body></html>\n"


def markdown_cell(x) -> str:
    text = html.escape("undefined" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x), quote=False)
    for c in "\\|`*_":
        text = text.replace(c, "\\" + c)
    return text.replace("\n", " ").replace("\r", " ")


def markdown_table(rows: list[dict], names: list[str]) -> str:
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(markdown_cell(r.get(n)) for n in names) + " |" for r in rows]) + "\n"

"""Figures as plain SVG, drawn from small tables on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from html import escape

WIDTH, HEIGHT, LEFT, TOP = 900, 360, 70, 40
COLOURS = ("#1b6ca8", "#d1495b", "#2e8b57", "#8a5a00", "#6a4c93", "#444444")


def _scale(values: Sequence[float], size: float, start: float, flip: bool):
    low, high = min(values), max(values)
    span = (high - low) or 1.0
    return (lambda v: start + size - (v - low) / span * size) if flip else (lambda v: start + (v - low) / span * size)


def _page(title: str, body: list[str], keys: list[str]) -> str:
    legend = [f'<text x="{LEFT + 150 * i}" y="{HEIGHT - 8}" fill="{COLOURS[i % len(COLOURS)]}">{escape(k)}</text>' for i, k in enumerate(keys)]
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="12">'
    return "\n".join([head, f'<rect width="{WIDTH}" height="{HEIGHT}" fill="white"/>', f'<text x="{LEFT}" y="22" font-size="15">{escape(title)}</text>', *body, *legend, "</svg>", ""])


def _axis(low: float, high: float) -> list[str]:
    mid = HEIGHT - 2 * TOP
    return [f'<text x="6" y="{y}">{v:.4g}</text>' for v, y in ((high, TOP + 10), (low, TOP + mid))]


def lines(title: str, series: dict[str, list[tuple[float, float | None]]], points: bool = False) -> str:
    """Lines (or points) of (x, y) for each key; a missing y breaks the line."""
    have = [(x, y) for rows in series.values() for x, y in rows if y is not None]
    if not have:
        return _page(f"{title} (no data)", [], [])
    fx, fy = _scale([x for x, _ in have], WIDTH - LEFT - 20, LEFT, False), _scale([y for _, y in have], HEIGHT - 2 * TOP, TOP, True)
    body = _axis(min(y for _, y in have), max(y for _, y in have))
    for i, rows in enumerate(series.values()):
        colour, run = COLOURS[i % len(COLOURS)], []
        for x, y in [*sorted(rows, key=lambda p: p[0]), (0, None)]:
            if y is not None:
                run.append(f"{fx(x):.1f},{fy(y):.1f}")
            elif run:
                body += [f'<circle cx="{p.split(",")[0]}" cy="{p.split(",")[1]}" r="2" fill="{colour}"/>' for p in run] if points else [f'<polyline fill="none" stroke="{colour}" points="{" ".join(run)}"/>']
                run = []
    return _page(title, body, list(series))


def stacked(pages: list[str]) -> str:
    """Several figures under each other as one."""
    moved = [f'<g transform="translate(0 {HEIGHT * i})">\n{page}</g>' for i, page in enumerate(pages)]
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT * max(1, len(pages))}">'
    return "\n".join([head, *moved, "</svg>", ""])


def intervals(title: str, rows: list[tuple[str, float | None, float | None, float | None]]) -> str:
    """A marker and an interval for each (label, value, low, high), with a line at zero."""
    values = [v for _, *vs in rows for v in vs if v is not None] + [0.0]
    fx, step = _scale(values, WIDTH - 3 * LEFT, 2.5 * LEFT, False), (HEIGHT - 2 * TOP) / max(1, len(rows))
    body = [f'<line x1="{fx(0):.1f}" x2="{fx(0):.1f}" y1="{TOP}" y2="{HEIGHT - TOP}" stroke="#999"/>']
    for i, (label, value, low, high) in enumerate(rows):
        y = TOP + step * (i + 0.5)
        body.append(f'<text x="6" y="{y:.1f}">{escape(label)}</text>')
        if low is not None and high is not None:
            body.append(f'<line x1="{fx(low):.1f}" x2="{fx(high):.1f}" y1="{y:.1f}" y2="{y:.1f}" stroke="{COLOURS[0]}" stroke-width="3"/>')
        if value is not None:
            body.append(f'<circle cx="{fx(value):.1f}" cy="{y:.1f}" r="4" fill="{COLOURS[1]}"/>')
    return _page(title, body, [])

"""Charts of retrieval scores as SVG files, from the small tables of siltstone.operators.metrics."""

from __future__ import annotations

from html import escape

import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from ..operators.metrics import score_points

COLOURS = ["#4269d0", "#efb118", "#ff725c", "#6cc5b0", "#3ca951", "#9c6b4e"]
WIDTH, HEIGHT, LEFT, TOP = 720, 320, 60, 40


def _text(x: float, y: float, s: object, anchor: str = "middle", size: int = 11) -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" font-size="{size}" text-anchor="{anchor}" font-family="sans-serif">{escape(str(s))}</text>'


def bars(title: str, labels: list[str], series: dict[str, list[float | None]]) -> str:
    """Stacked bars, one for each label; a single series is a plain bar chart."""
    top = max([1e-9, *(sum(v[k] or 0 for v in series.values()) for k in range(len(labels)))])
    step = (WIDTH - LEFT - 20) / max(1, len(labels))
    out = [_text(WIDTH / 2, 20, title, size=14), _text(LEFT - 6, TOP + 8, f"{top:.3g}", "end"), _text(LEFT - 6, HEIGHT - 40, "0", "end")]
    for k, label in enumerate(labels):
        y = HEIGHT - 40.0
        for c, values in enumerate(series.values()):
            h = (values[k] or 0) / top * (HEIGHT - 40 - TOP)
            y -= h
            out.append(f'<rect x="{LEFT + k * step + step * 0.15:.1f}" y="{y:.1f}" width="{step * 0.7:.1f}" height="{h:.1f}" fill="{COLOURS[c % len(COLOURS)]}"/>')
        out.append(_text(LEFT + (k + 0.5) * step, HEIGHT - 24, label))
    for c, name in enumerate(series):
        out.append(f'<rect x="{LEFT + c * 130}" y="{HEIGHT - 14}" width="10" height="10" fill="{COLOURS[c % len(COLOURS)]}"/>' + _text(LEFT + c * 130 + 14, HEIGHT - 5, name, "start"))
    return f'<g>{"".join(out)}</g>'


def ranges(title: str, labels: list[str], points: list[list[float]]) -> str:
    """Each label's values as dots between the least and the largest."""
    step = (WIDTH - LEFT - 20) / max(1, len(labels))
    top = max([1.0, *(p for own in points for p in own)])
    out = [_text(WIDTH / 2, 20, title, size=14), _text(LEFT - 6, TOP + 8, f"{top:.3g}", "end"), _text(LEFT - 6, HEIGHT - 40, "0", "end")]
    for k, (label, own) in enumerate(zip(labels, points)):
        x = LEFT + (k + 0.5) * step
        ys = [HEIGHT - 40 - p / top * (HEIGHT - 40 - TOP) for p in own]
        if ys:
            out.append(f'<line x1="{x:.1f}" x2="{x:.1f}" y1="{min(ys):.1f}" y2="{max(ys):.1f}" stroke="#888"/>')
        out += [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3" fill="{COLOURS[0]}" fill-opacity="0.6"/>' for y in ys]
        out.append(_text(x, HEIGHT - 24, label))
    return f'<g>{"".join(out)}</g>'


def grid(title: str, rows: list[str], columns: list[str], cells: dict[tuple[str, str], float]) -> str:
    """A matrix of shaded cells with their values."""
    w, h = (WIDTH - 130) / max(1, len(columns)), (HEIGHT - 70) / max(1, len(rows))
    out = [_text(WIDTH / 2, 20, title, size=14)]
    for i, r in enumerate(rows):
        out.append(_text(104, TOP + (i + 0.6) * h, r, "end"))
        for j, c in enumerate(columns):
            v = cells.get((r, c))
            if v is not None:
                out.append(f'<rect x="{110 + j * w:.1f}" y="{TOP + i * h:.1f}" width="{w:.1f}" height="{h:.1f}" fill="{COLOURS[0]}" fill-opacity="{min(1.0, max(0.0, v)):.2f}"/>' + _text(110 + (j + 0.5) * w, TOP + (i + 0.6) * h, f"{v:.2f}"))
    out += [_text(110 + (j + 0.5) * w, HEIGHT - 14, c) for j, c in enumerate(columns)]
    return f'<g>{"".join(out)}</g>'


def page(*panels: str) -> str:
    moved = "".join(f'<g transform="translate(0,{k * HEIGHT})">{p}</g>' for k, p in enumerate(panels))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT * len(panels)}">{moved}</svg>'


def write_charts(stats: DataFrame, by_type: DataFrame, overall: DataFrame, matrix: DataFrame, results: DataFrame, folder: str) -> list[str]:
    """Five SVG files of an evaluation: scores by query, their components, types, distributions, and a dashboard of all.

    The tables have a row per query or type, and results the top rows of each query: what an evaluation shows, not data.
    """
    s = sorted(stats.collect(), key=lambda r: str(r["query_id"]))
    t = sorted(by_type.collect(), key=lambda r: str(r["query_type"]))
    o = overall.first()
    cells = {(r["metric"], str(r["query_id"])): r["value"] for r in matrix.collect()}
    found: dict[str, list[float]] = {}
    for r in score_points(results).collect():
        found.setdefault(str(r["query_id"]), []).append(r["score"])
    ids = [str(r["query_id"]) for r in s]
    column = lambda c: [r[c] for r in s]
    by_query = [bars(title, ids, {title: column(c)}) for title, c in (("Average score", "avg_score"), ("Best score", "top1_score"), ("Results", "num_retrieved"), ("Standard deviation", "score_std"))]
    parts = bars("Components of the score", ids, {"semantic": column("avg_semantic_score"), "lexical": column("avg_lexical_score"), "reranker": column("avg_ce_score")})
    mean = bars("Mean components", ["semantic", "lexical", "reranker"], {"mean": [o["avg_semantic_contribution"], o["avg_lexical_contribution"], o["avg_ce_contribution"]]})
    types = [bars(title, [r["query_type"] for r in t], {title: [r[c] for r in t]}) for title, c in (("Average score by type", "avg_score"), ("Results by type", "avg_results"), ("Best score by type", "avg_top1_score"))]
    spread = ranges("Scores of each query", ids, [found.get(k, []) for k in ids])
    heat = grid("Measures by query", sorted({m for m, _ in cells}), ids, cells)
    head = bars("Queries", ["answered", "not answered"], {"queries": [o["successful_queries"], o["total_queries"] - o["successful_queries"]]})
    files = {"scores_by_query": page(*by_query), "score_components": page(parts, mean), "performance_by_type": page(*types), "score_distributions": page(spread), "dashboard": page(head, by_query[0], heat)}
    fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    fs.create_dir(root, recursive=True)
    for name, svg in files.items():
        with fs.open_output_stream(f"{root}/{name}.svg") as f:
            f.write(svg.encode())
    return [f"{folder}/{name}.svg" for name in files]

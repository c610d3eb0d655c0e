"""A page of summary cards, read funnel, histograms, knee, Lorenz curves and coverage scatter as one HTML file with inline SVG.

The data sets come from the operators as small tables: histograms have a fixed number of bins, Lorenz curves at most 50 cells, and knee
and scatter are thinned by `thinned`, so what reaches the driver doesn't grow with the input.
"""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT, PAD, POINTS = 460, 260, 36, 2000


def thinned(df: DataFrame, x: str, points: int = POINTS) -> DataFrame:
    """At most about `points` rows for a plot, one for each step of log10 of x (from 1 on) and series: the one of least x."""
    step = F.floor(F.log10(F.greatest(F.col(x).cast("double"), F.lit(1.0))) * (points / 12))
    series = [c for c in ("condition",) if c in df.columns]
    first = df.withColumn("__step", step).withColumn("__first", F.min(x).over(Window.partitionBy("__step", *series)))
    return first.where(F.col(x) == F.col("__first")).dropDuplicates(["__step", *series]).drop("__step", "__first")


def _scale(values: list[float], size: int) -> tuple[float, float]:
    low, high = min(values, default=0.0), max(values, default=1.0)
    return low, (size - 2 * PAD) / ((high - low) or 1.0)


def _frame(title: str, body: str, x: str, y: str) -> str:
    axis = f'<line x1="{PAD}" y1="{HEIGHT - PAD}" x2="{WIDTH - PAD}" y2="{HEIGHT - PAD}" stroke="#888"/><line x1="{PAD}" y1="{PAD}" x2="{PAD}" y2="{HEIGHT - PAD}" stroke="#888"/>'
    names = f'<text x="{WIDTH // 2}" y="{HEIGHT - 8}">{html.escape(x)}</text><text x="4" y="{PAD - 10}">{html.escape(y)}</text>'
    return f'<figure><figcaption>{html.escape(title)}</figcaption><svg width="{WIDTH}" height="{HEIGHT}">{axis}{names}{body}</svg></figure>'


def points(title: str, series: dict[str, list[tuple[float, float]]], x: str, y: str, joined: bool = False) -> str:
    """A scatter or line plot, one colour for each series."""
    every = [p for s in series.values() for p in s]
    (x0, sx), (y0, sy) = _scale([p[0] for p in every], WIDTH), _scale([p[1] for p in every], HEIGHT)
    body = []
    for k, (name, own) in enumerate(series.items()):
        at = [(PAD + (a - x0) * sx, HEIGHT - PAD - (b - y0) * sy) for a, b in sorted(own)]
        hue = f"hsl({k * 67 % 360},60%,45%)"
        if joined:
            body.append(f'<polyline fill="none" stroke="{hue}" points="{" ".join(f"{a:.1f},{b:.1f}" for a, b in at)}"><title>{html.escape(name)}</title></polyline>')
        else:
            body += [f'<circle cx="{a:.1f}" cy="{b:.1f}" r="2" fill="{hue}"><title>{html.escape(name)}</title></circle>' for a, b in at]
    return _frame(title, "".join(body), x, y)


def bars(title: str, heights: list[tuple[str, float]], x: str, y: str) -> str:
    top = max((h for _, h in heights), default=0) or 1
    step = (WIDTH - 2 * PAD) / max(len(heights), 1)
    body = [f'<rect x="{PAD + k * step:.1f}" y="{HEIGHT - PAD - h / top * (HEIGHT - 2 * PAD):.1f}" width="{step * 0.9:.1f}" height="{h / top * (HEIGHT - 2 * PAD):.1f}" fill="#48a"><title>{html.escape(str(name))}: {h:g}</title></rect>' for k, (name, h) in enumerate(heights)]
    return _frame(title, "".join(body), x, y)


def page(title: str, cards: DataFrame, funnel: DataFrame | None = None, knee: DataFrame | None = None, histograms: dict[str, DataFrame] | None = None, lorenz: DataFrame | None = None, scatter: DataFrame | None = None) -> str:
    """The page's text. cards (card, value); funnel (step, name, reads); knee (rank, read_count, condition); histograms (bin, n);
    lorenz (cell, cumulative_fraction_genome, cumulative_fraction_reads); scatter (mean_coverage, pct_1x, condition). What is missing is left out."""
    parts = [f'<div class="card"><b>{html.escape(r["card"])}</b><br>{"N/A" if r["value"] is None else format(r["value"], ",.6g")}</div>' for r in cards.orderBy("ord").collect()]
    if funnel is not None:
        parts.append(bars("Read funnel", [(r["name"], r["reads"]) for r in funnel.orderBy("step").collect()], "step", "reads"))

    def by_series(df: DataFrame, name: str, x: str, y: str, log: bool = False) -> dict[str, list[tuple[float, float]]]:
        out: dict[str, list[tuple[float, float]]] = {}
        rows = df.select(F.col(name).cast("string").alias("s"), *[(F.log10(F.greatest(F.col(c).cast("double"), F.lit(1.0))) if log else F.col(c).cast("double")).alias(k) for c, k in ((x, "x"), (y, "y"))])
        for r in rows.where("x is not null and y is not null").collect():
            out.setdefault(r["s"] or "", []).append((r["x"], r["y"]))
        return out

    if knee is not None:
        parts.append(points("Knee", by_series(thinned(knee, "rank"), "condition", "rank", "read_count", True), "log10 rank", "log10 reads"))
    for name, df in (histograms or {}).items():
        total = df.groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()
        parts.append(bars(name, [(r["bin"], float(r["n"])) for r in total], "bin", "cells"))
    if lorenz is not None:
        parts.append(points("Lorenz curves", by_series(lorenz, "cell", "cumulative_fraction_genome", "cumulative_fraction_reads"), "genome", "reads", True))
    if scatter is not None:
        thin = thinned(scatter.withColumn("__x", F.col("mean_coverage") * 1e6), "__x")
        parts.append(points("Coverage", by_series(thin, "condition", "mean_coverage", "pct_1x"), "mean coverage", "share at 1x"))
    style = "body{font-family:sans-serif}.card{display:inline-block;border:1px solid #ccc;padding:8px;margin:4px}figure{display:inline-block}text{font-size:11px}"
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{"".join(parts)}</body></html>'


def write(spark, text: str, path: str) -> None:
    """Writes the page to a file in whatever store the path names."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()

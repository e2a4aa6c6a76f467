"""Text charts of small aggregates, drawn on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def bars(rows: list[tuple[str, float]], width: int = 40, char: str = "█") -> list[str]:
    """A line for each (label, value): label, bar and value; the largest value fills the width."""
    if not rows:
        return []
    wide = max(len(label) for label, _ in rows)
    top = max((v for _, v in rows), default=0.0)
    out = []
    for label, v in rows:
        n = round(max(v, 0.0) / top * width) if top > 0 else 0
        shown = str(int(v)) if v == int(v) else f"{v:.4g}"
        out.append(f"{label:>{wide}} | {char * n:<{width}} {shown}")
    return out


def boxed(lines: list[str], title: str = "", label: str = "") -> list[str]:
    """The lines in a frame, with a title above and a label below."""
    wide = max([len(x) for x in lines] + [len(title) + 2, len(label) + 2], default=0)
    edge = lambda left, text, right: f"{left}─{f' {text} ' if text else ''}{'─' * (wide + 1 - (len(text) + 2 if text else 0))}{right}"
    return [edge("┌", title, "┐"), *(f"│ {x:<{wide}} │" for x in lines), edge("└", label, "┘")]


def plot(rows: DataFrame, label: str, value: str, width: int = 40, most: int = 100) -> str:
    """A bar chart of an aggregate of at most ``most`` rows, in their order."""
    return "\n".join(bars([(str(r[label]), float(r[value] or 0)) for r in rows.select(label, value).limit(most).collect()], width))

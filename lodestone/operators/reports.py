"""Reports in Markdown, from small aggregated tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

#: Rows of a report's table; reports are of aggregates, which are few.
MOST_ROWS = 10_000


def cell(value: object) -> str:
    if value is None:
        return "—"
    return f"{value:.4f}" if isinstance(value, float) else str(value).replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame, columns: Sequence[str] | None = None, show: dict[str, Callable[[object], str]] | None = None) -> str:
    """A Markdown table of df, in its order; ValueError beyond MOST_ROWS."""
    names = list(columns or df.columns)
    rows = df.select(*names).take(MOST_ROWS + 1)
    if len(rows) > MOST_ROWS:
        raise ValueError("too many rows for a report")
    shown = [[(show or {}).get(n, cell)(r[n]) for n in names] for r in rows]
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(r) + " |" for r in shown)]
    return "\n".join(lines)


def percent(value: object) -> str:
    return "—" if value is None else f"{value:.2%}"


def settings_block(config: dict) -> str:
    """What a run was made with, one line each, by name."""
    return "\n".join(f"- {k}: `{v}`" for k, v in sorted(config.items()))


def sections(groups: DataFrame, show: dict[str, Callable[[object], str]] | None = None) -> list[str]:
    """A table for each dimension of groups (dimension, value, n, ...), `all` first."""
    names = sorted({r["dimension"] for r in groups.select("dimension").distinct().take(MOST_ROWS)}, key=lambda d: (d != "all", d))
    return [f"## By {d.replace('_', ' ')}\n\n" + markdown_table(groups.filter(groups.dimension == d).drop("dimension").orderBy("value"), show=show) if d != "all" else "## Overall\n\n" + markdown_table(groups.filter(groups.dimension == d).drop("dimension", "value"), show=show) for d in names]


def weakest_sections(weakest: DataFrame, by: str, show: dict[str, Callable[[object], str]] | None = None) -> list[str]:
    """A table of the weakest cases of each group."""
    values = sorted(str(r[0]) for r in weakest.select(by).distinct().take(MOST_ROWS))
    return [f"## Weakest cases: {v}\n\n" + markdown_table(weakest.filter(weakest[by].cast("string") == v).drop(by).orderBy("place"), show=show) for v in values]


def _page(title: str, *parts: str) -> str:
    return "\n\n".join([f"# {title}", *(p for p in parts if p)]) + "\n"


def retrieval_report(groups: DataFrame, weakest: DataFrame, config: dict | None = None) -> str:
    """Settings, metrics over all and by dimension, then the weakest cases of each group."""
    return _page("Retrieval", settings_block(config or {}), *sections(groups), *weakest_sections(weakest, weakest.columns[0]))


def end_to_end_report(overall: DataFrame, groups: DataFrame, statuses: DataFrame, latency: DataFrame, weakest: DataFrame | None = None, config: dict | None = None) -> str:
    rates = {c: percent for c in overall.columns if c.endswith(("_rate", "_micro", "_macro"))}
    tables = ["## Outcomes\n\n" + markdown_table(overall, show=rates), "## Statuses\n\n" + markdown_table(statuses.orderBy("status")), "## Latency\n\n" + markdown_table(latency)]
    return _page("End to end", settings_block(config or {}), *tables, *sections(groups, rates), *(weakest_sections(weakest, weakest.columns[0], rates) if weakest is not None else []))


def comparison_report(runs: DataFrame, config: dict | None = None, artefacts: Sequence[str] = ()) -> str:
    """Baselines with their status and deltas; runs that don't compare show no scores."""
    used = "## Results used\n\n" + "\n".join(f"- `{a}`" for a in sorted(set(artefacts))) if artefacts else ""
    return _page("Baselines", settings_block(config or {}), markdown_table(runs), used)


def dataset_report(metadata: dict, cases: DataFrame) -> str:
    """How a benchmark was made, and how many cases each source, kind and style has."""
    counts = [f"## By {c.replace('_', ' ')}\n\n" + markdown_table(cases.groupBy(c).count().orderBy(c)) for c in ("gold_multiplicity", "duplication_scope", "paraphrase_type") if c in cases.columns]
    return _page("Benchmark", settings_block(metadata), *counts)

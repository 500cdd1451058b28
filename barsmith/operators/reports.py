"""Reports in markdown, from small results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.operators.patterns import concept_counts

#: Rules shown before and after diversity, and rules whose concepts are counted.
SHOWN, COUNTED = 10, 20


def _table(head: tuple[str, ...], rows: Iterable[tuple]) -> list[str]:
    def line(cells: Iterable[object]) -> str:
        return "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in cells) + " |"

    return [line(head), line("-" for _ in head), *map(line, rows), ""]


def diversity_report(ranked: DataFrame, diverse: DataFrame, similar: DataFrame, cluster: dict[str, str], importance: dict[str, float] | None = None) -> str:
    """What diversity did to a ranking, as markdown: counts, feature clusters, the best rules before and after, and the concepts of the best.

    ranked: base_ranking; diverse: diverse_ranking; similar: similar_rules; cluster: feature_clusters. Only counts and the first rules are collected.
    """
    importance = importance or {}
    members: dict[str, list[str]] = {}
    for feature, representative in sorted(cluster.items()):
        members.setdefault(representative, []).append(feature)
    before, after = ranked.count(), diverse.count()
    name = F.concat_ws(":", "features", "buckets")
    first = ranked.orderBy("rank").select(name, "base_score").limit(SHOWN).collect()
    best = diverse.orderBy("rank").limit(COUNTED).collect()
    concepts = concept_counts(diverse, cluster, COUNTED).collect()
    out = ["# Diversity of rules", "", f"- Rules ranked: {before}", f"- Representatives: {after}", f"- Left out as alike: {before - after}", f"- Pairs of similar robust rules: {similar.count()}", f"- Feature clusters: {len(members)}", "", "## Feature clusters", ""]
    weight = {r: [importance.get(x, 0.0) for x in m] for r, m in members.items()}
    out += _table(("Representative", "Strongest", "Mean importance", "Features", "Members"), [(r, min(m, key=lambda x: (-importance.get(x, 0.0), x)), f"{sum(weight[r]) / len(m):.6f}", len(m), ", ".join(m)) for r, m in members.items()])
    out += ["## Before and after", ""]
    rows = [(i + 1, *(first[i] if i < len(first) else (None, None)), *((best[i]["rule"], f"{best[i]['adjusted_score']:.6f}", f"{best[i]['diversity_score']:.2f}") if i < len(best) else (None, None, None))) for i in range(min(SHOWN, max(len(first), len(best))))]
    out += _table(("Rank", "Rule before", "Base score", "Rule after", "Score", "Diversity"), rows)
    out += ["## Representatives", ""]
    out += _table(("Rank", "Rule", "Group", "Alike", "Score", "Diversity"), [(r["rank"], r["rule"], r["group"], r["members"], f"{r['adjusted_score']:.6f}", f"{r['diversity_score']:.2f}") for r in best])
    out += [f"## Concepts of the best {COUNTED}", ""]
    return "\n".join([*out, *_table(("Concept", "Rules"), concepts)])

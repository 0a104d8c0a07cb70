"""Results as short texts, JSON and Markdown, for the command line."""

from __future__ import annotations

import json


def mix(total: int, by_source: dict[str, int], limiting: str, max_total: int, shortfall: dict[str, int]) -> str:
    """A mix's size, each source's part, what limits it and what was lacking."""
    lines = [f"mix: {total} examples"] + [f"  {name}: {n} ({n / total if total else 0.0:.1%})" for name, n in by_source.items()]
    lines.append(f"limited by {limiting} (at most {max_total})")
    return "\n".join(lines + [f"  {name} lacks {n}" for name, n in shortfall.items() if n > 0])


def agency(m: dict) -> str:
    rows = (
        ("timeliness (recall of ACT)", "timeliness"), ("false interventions", "false_intervention_rate"), ("precision of ACT", "precision_act"),
        ("F1 of ACT", "f1_act"), ("decision accuracy", "decision_accuracy"), ("interventions a minute unasked", "intrusiveness"),
    )
    return "\n".join([f"{title}: {m[key]:.3f}" for title, key in rows] + [f"examples: {m['support']}"])


def calibration(pick: dict, temperature: float, points: int) -> str:
    lines = [f"threshold: {pick['threshold']:.3f}", f"temperature: {temperature:.3f}", f"bound on false interventions: {'kept' if pick['satisfied'] else 'NOT kept'}", f"points of the curve: {points}"]
    return "\n".join(lines + ["degenerate: at this threshold the robot never acts; loosen the bound or improve the model"] * bool(pick["degenerate"]))


def retention(r: dict) -> str:
    verdict = "worse" if r["delta"] > 0 else "better"
    return f"base NLL: {r['base_nll']:.4f}\nadapter NLL: {r['adapter_nll']:.4f}\ndifference: {r['delta']:+.4f} ({verdict})\nof the base: {r['relative_degradation']:+.2%}\nexamples: {r['examples']}"


def error_rate(r: dict, name: str = "WER") -> str:
    return f"{name}: {r['rate']:.4f} ({r['rate'] * 100:.2f}%)\n  substitutions: {r['substitutions']}\n  deletions: {r['deletions']}\n  insertions: {r['insertions']}\n  reference length: {r['reference_length']}"


def as_json(row: dict) -> str:
    return json.dumps(row, ensure_ascii=False, indent=2, default=str)


def as_markdown(rows: list[dict]) -> str:
    """Rows as a Markdown table; numbers with four decimals."""
    if not rows:
        return ""
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0])]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r.values()) + " |" for r in rows])

"""Reports of a run: its figures as JSON and text, and one HTML file with drawings.

Aggregates, bins and thinned series are made by Spark; what the driver renders has at most some thousand rows.
"""

from __future__ import annotations

import datetime as dt
import html
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import metrics, runs

MOST_TRADES, BUCKETS, BINS = 250, 600, 31


def money(v: int | None) -> str | None:
    """Money as text with eight decimals."""
    return None if v is None else f"{'-' if v < 0 else ''}{abs(v) // 10**8}.{abs(v) % 10**8:08d}"


def figure(v: float | None) -> float | None:
    """Twelve significant digits; null where there is no finite number."""
    return None if v is None or not math.isfinite(v) else float(f"{v:.11e}") + 0.0


def iso(us: int | None) -> str | None:
    return None if us is None else dt.datetime.fromtimestamp(us / 1e6, dt.UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{us // 1000 % 1000:03d}Z"


def summary(events: DataFrame, run_id: str, qty_exp: int = 0) -> dict:
    """The figures of a run in groups: period, equity, risk, trades, costs, modelling."""
    own = events.where(F.col("run_id") == run_id)
    equity, trades, fills = runs.equity(own), runs.trades(own).withColumnRenamed("run_id", "run"), runs.fills(own)
    first = lambda df: (df.first() or None) and df.first().asDict()
    ends = equity.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("bars"), F.min_by("equity", "ts").alias("initial")).first()
    final = own.where("kind = 'final'").select("amount", "commission").first()
    growth, risk, stats = first(metrics.growth(equity)) or {}, first(metrics.risk(equity)) or {}, first(metrics.trade_stats(trades)) or {}
    ppy = (first(metrics.periods_per_year(equity)) or {}).get("ppy")
    deepest = metrics.drawdowns(equity).orderBy(F.desc("depth"), "peak_ts").first()
    longest = metrics.drawdowns(equity).agg(F.max("bars")).first()[0] or 0
    units = fills.agg(F.coalesce(F.sum("qty"), F.lit(0))).first()[0]
    counts = {r["reason"]: r["amount"] for r in own.where("kind = 'count'").select("reason", "amount").collect()}
    net = None if final is None or ends["initial"] is None else final["amount"] - ends["initial"]
    pre, paid = stats.get("pre_cost") or 0, final["commission"] if final else 0
    held = trades.agg(F.sum("bars")).first()[0] or 0
    down = deepest["depth_money"] if deepest else 0
    return {
        "period": {"start": iso(ends["start"]), "end": iso(ends["end"]), "days": figure(((ends["end"] or 0) - (ends["start"] or 0)) / 86_400_000_000), "bars": ends["bars"], "periodsPerYear": figure(ppy)},
        "equity": {"initial": money(ends["initial"]), "final": money(final["amount"] if final else None), "netProfit": money(net), "totalReturn": figure(growth.get("total_return")), "cagr": figure(growth.get("cagr"))},
        "risk": {
            "volatility": figure(risk.get("volatility")), "sharpe": figure(risk.get("sharpe")), "sortino": figure(risk.get("sortino")), "calmar": figure(growth.get("calmar")), "maxDrawdown": figure(growth.get("max_drawdown")), "maxDrawdownMoney": money(down),
            "maxDrawdownStart": iso(deepest["peak_ts"]) if deepest else None, "maxDrawdownTrough": iso(deepest["trough_ts"]) if deepest else None, "maxDrawdownRecovered": iso(deepest["recovered_ts"]) if deepest else None,
            "maxDrawdownBars": deepest["bars"] if deepest else 0, "longestDrawdownBars": longest, "recoveryFactor": figure(net / down) if down and net is not None else None,
        },
        "trades": {
            "count": stats.get("trades", 0), "wins": stats.get("wins", 0), "losses": stats.get("losses", 0), "winRate": figure(stats.get("win_rate")), "profitFactor": figure(stats.get("profit_factor")), "expectancy": money(stats.get("expectancy", 0)),
            "grossProfit": money(stats.get("gross_profit", 0)), "grossLoss": money(stats.get("gross_loss", 0)), "preCostPnl": money(pre), "avgWin": money(stats.get("avg_win", 0)), "avgLoss": money(stats.get("avg_loss", 0)),
            "largestWin": money(stats.get("largest_win", 0)), "largestLoss": money(stats.get("largest_loss", 0)), "avgBarsHeld": figure(stats.get("avg_bars") or 0.0), "exposure": figure(held / ends["bars"]) if ends["bars"] else 0.0,
        },
        "costs": {
            "commissionPaid": money(paid), "shareOfGross": figure(paid / pre) if pre > 0 else None, "unitsTraded": units / 10**qty_exp, "commissionPerUnit": money((2 * paid * 10**qty_exp + units) // (2 * units) if units else 0),
            "breakEvenCommissionPerUnit": money(pre * 10**qty_exp // units) if units and pre > 0 else None,
        },
        "modelling": {"ambiguousBars": counts.get("ambiguous", 0), "subBarLatencyIgnored": counts.get("sub_bar", 0), "warnings": warnings(counts, stats)},
    }


def warnings(counts: dict, stats: dict) -> list[str]:
    """What a reader must know before the figures."""
    out = []
    if n := counts.get("ambiguous", 0):
        out.append(f"{n} bars could have filled several orders; the policy chose their order.")
    if n := counts.get("deferred", 0):
        out.append(f"{n} stop-limit orders waited for the bar after their trigger.")
    if n := counts.get("sub_bar", 0):
        out.append(f"The part of the latency below a bar was ignored for {n} orders.")
    if 0 < stats.get("trades", 0) < 30:
        out.append("Fewer than 30 trades: the statistics of trades mean little.")
    return out


def to_json(s: dict) -> str:
    return json.dumps(s, indent=2, ensure_ascii=False) + "\n"


def to_text(s: dict) -> str:
    """Warnings first, then a line for each figure."""
    lines = [f"! {w}" for w in s["modelling"]["warnings"]]
    for group, values in s.items():
        lines += ["", group] + [f"  {k:<28}{'n/a' if v is None else v}" for k, v in values.items() if k != "warnings"]
    return "\n".join(lines).strip() + "\n"


def percent(v: float | None, digits: int = 2) -> str:
    return "n/a" if v is None or not math.isfinite(v) else f"{100 * v:.{digits}f}%"


def compact(v: float | None) -> str:
    """A number with three digits or so and a letter for thousands, millions and so on."""
    if v is None or not math.isfinite(v):
        return "n/a"
    for size, letter in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "k")):
        if abs(v) >= size:
            return f"{v / size:.1f}{letter}"
    return f"{v:.2f}"


def axis(low: float, high: float, n: int = 5, pad: float = 0.05) -> tuple[float, float, list[float]]:
    """Bounds with a margin on both sides, and n evenly spaced ticks; a flat series gets room of its own size, or of one."""
    room = (high - low) * pad if high > low else abs(high) * pad or 1.0
    a, z = low - room, high + room
    return a, z, [a + (z - a) * i / (n - 1) for i in range(n)]


def comparison_json(rows: DataFrame) -> str:
    """The same strategy under several venues' costs (venue, instrument, fills, commission, final_equity) as JSON, ordered by venue and instrument."""
    found = rows.orderBy("venue", "instrument").collect()
    return json.dumps([{"venue": r["venue"], "instrument": r["instrument"], "fills": r["fills"], "commission": money(r["commission"]), "finalEquity": money(r["final_equity"])} for r in found], indent=2) + "\n"


def path(points: list[tuple[float, float]], width: float, height: float) -> str:
    """Points as an SVG path that fills the box; a flat series lies in its middle."""
    if not points:
        return ""
    (x0, x1), (y0, y1) = ((min(p[i] for p in points), max(p[i] for p in points)) for i in (0, 1))
    x = lambda v: (v - x0) / (x1 - x0) * width if x1 > x0 else width / 2
    y = lambda v: height - (v - y0) / (y1 - y0) * height if y1 > y0 else height / 2
    return "M" + "L".join(f"{x(a):.2f},{y(b):.2f}" for a, b in points)


def to_html(events: DataFrame, run_id: str, title: str | None = None) -> str:
    """One file without scripts: figures, equity, drawdown, returns and the first trades."""
    own = events.where(F.col("run_id") == run_id)
    equity = runs.equity(own)
    s = summary(events, run_id)
    curve = [(r["ts"], r["equity"]) for r in metrics.downsample(equity, "equity", BUCKETS).orderBy("ts").collect()]
    under = [(r["ts"], -r["depth"]) for r in metrics.downsample(metrics.underwater(equity), "depth", BUCKETS).orderBy("ts").collect()]
    bins = {r["bin"]: r["n"] for r in metrics.histogram(metrics.returns(equity), "r", BINS).collect()}
    top = max(bins.values(), default=1)
    bars = "".join(f'<rect x="{i * 600 / BINS:.1f}" y="{120 - 120 * n / top:.1f}" width="{600 / BINS - 1:.1f}" height="{120 * n / top:.1f}"/>' for i, n in sorted(bins.items()))
    trades = runs.trades(own).orderBy("entry_ts", "exit_ts").limit(MOST_TRADES).collect()
    rows = "".join(f"<tr><td>{html.escape(t['instrument'])}<td>{'long' if t['direction'] > 0 else 'short'}<td>{t['qty']}<td>{iso(t['entry_ts'])}<td>{iso(t['exit_ts'])}<td>{money(t['net'])}" for t in trades)
    figures = "".join(f"<h2>{g}</h2><table>" + "".join(f"<tr><td>{html.escape(k)}<td>{html.escape('n/a' if v is None else str(v))}" for k, v in x.items() if k != "warnings") + "</table>" for g, x in s.items())
    caveats = "".join(f"<p class=w>{html.escape(w)}</p>" for w in s["modelling"]["warnings"])
    line = lambda points, h: f'<svg viewBox="0 0 600 {h}"><path d="{path(points, 600, h)}" fill="none" stroke="#246"/></svg>'
    return (
        f"<!doctype html><meta charset=utf-8><title>{html.escape(title or run_id)}</title><style>body{{font:14px sans-serif;max-width:60em;margin:2em auto}}svg{{width:100%}}.w{{color:#a40}}</style>"
        f"<h1>{html.escape(title or run_id)}</h1>{caveats}{line(curve, 200)}{line(under, 80)}<svg viewBox='0 0 600 120' fill='#69a'>{bars}</svg>{figures}<h2>trades</h2><table>{rows}</table>"
    )

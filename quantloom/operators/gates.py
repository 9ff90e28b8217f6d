"""Quality gate for ticks, and spreads of modelled quotes."""

from __future__ import annotations

from collections.abc import Sequence

from ..frames import Dialect, staged

#: Fixed values of the gate: share of bad prices above which a file is rejected, a jump between ticks, and jumps that make a file suspect.
POISON, JUMP, SUSPECT = 0.01, 0.5, 5


def gated(d: Dialect, ticks: str, file: Sequence[str] = ("symbol", "day"), order: Sequence[str] = ("ts", "event_id")) -> str:
    """Ticks with what is known of their file, and whether they stay.

    A file is the ticks of one symbol and day.  It is rejected as a whole where more than one in a hundred of its prices
    isn't above zero; else its bad prices and zero sizes go.  Jumps are counted between the prices that stay in the gate.
    """
    keys = ", ".join(file)
    rows = staged(
        ticks,
        {"bad_price": "case when price <= 0 then 1 else 0 end", "zero_size": "case when size = 0 then 1 else 0 end"},
        {"in_file": f"count(*) over (partition by {keys})", "bad_in_file": f"sum(bad_price) over (partition by {keys})"},
        {"rejected": f"case when bad_in_file > {POISON} * in_file then 1 else 0 end", "before": f"lag(case when bad_price = 0 then price end) over (partition by {keys}, bad_price order by {', '.join(order)})"},
        {"jumped": f"case when bad_price = 0 and abs(price / before - 1) > {JUMP} then 1 else 0 end"},
    )
    return staged(rows, {"kept": "case when rejected = 0 and bad_price = 0 and zero_size = 0 then 1 else 0 end"})


def gate_metrics(rows: str, file: Sequence[str] = ("symbol", "day")) -> str:
    """A row for each file of gated ticks: counts, whether it is rejected, and whether it is suspect."""
    keys = ", ".join(file)
    return f"(select {keys}, count(*) as ticks, sum(bad_price) as bad_price, sum(zero_size) as zero_size, sum(jumped) as jumps, max(rejected) as rejected, case when sum(jumped) > {SUSPECT} then 1 else 0 end as suspect, sum(kept) as kept from {rows} g group by {keys})"


#: Fixed values of the spread model: base spreads at and out of the money, and factors by the minutes since the open.
BASE_ATM, BASE_OTM, LEAST_SPREAD = 0.20, 0.30, 0.01
OPEN_MINUTES, CLOSE_MINUTES, LAST_MINUTE = 30, 330, 390
AT_OPEN, MIDDAY, AT_CLOSE, CLOSED = 1.5, 1.0, 1.3, 2.0


def spread(source: str) -> str:
    """Adds `spread` to quotes: by moneyness, days to expiry, volatility, time of day and structure.

    source: spot, strike, dte, vix, minutes (since the open), strangle (0 or 1).
    """
    return staged(
        source,
        {
            "moneyness": "abs(strike - spot) / nullif(spot, 0)",
            "base": f"case when strangle = 1 then {BASE_OTM} else {BASE_ATM} end",
            "dte_factor": "case when dte < 7 then 1.3 when dte < 14 then 1.15 else 1.0 end",
            "vol_factor": "least(3.0, 1.0 + greatest(0, (vix - 15.0) / 20.0))",
            "time_factor": f"case when minutes < 0 or minutes > {LAST_MINUTE} then {CLOSED} when minutes <= {OPEN_MINUTES} then {AT_OPEN} when minutes >= {CLOSE_MINUTES} then {AT_CLOSE} else {MIDDAY} end",
            "structure_factor": "case when strangle = 1 then 0.9 else 1.0 end",
        },
        {"spread": f"greatest({LEAST_SPREAD}, base * (1 + moneyness * 5) * dte_factor * vol_factor * time_factor * structure_factor)"},
    )

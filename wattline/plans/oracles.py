"""The catalog in SQL, written independently of the operators, for a second engine to run.

Every statement starts with the same list of common table expressions; an engine only runs the ones a
statement uses.
"""

from __future__ import annotations

import math

K = "series_id, timestamp_utc"
W = "PARTITION BY series_id ORDER BY timestamp_utc"
P, DA, IN, SP = "price_eur_mwh", "day_ahead_price_eur_mwh", "intraday_price_eur_mwh", "intraday_day_ahead_spread_eur_mwh"
D, R, IM = "demand_kw", "renewable_mw", "imbalance_price_eur_mwh"
PANEL = (P, D, R, DA, IM)
WEATHER = ("temperature_c", "wind_speed_mps", "radiation_wm2", "humidity_pct")
PREDS = ("pred_price_eur_mwh", "pred_demand_kw", "pred_renewable_mw")
STRATEGIES = ("original_strategy", "upgraded_strategy", "persistence", "seasonal", "naive_mean_reversion", "zero_signal")
BASELINES = STRATEGIES[2:]
DATE = "'%Y-%m-%d %H:%M:%S'"


def rnd(expr: str, digits: int = 4) -> str:
    r = f"round(({expr}) + 3e-9, {digits})"
    return f"CASE WHEN {r} = 0 THEN 0.0 ELSE {r} END"


def six(expr: str) -> str:
    return f"round({expr} + 3e-10, 6)"


def out(keys: str, source: str, digits: int = 4, ts: bool = True, plain=(), **cols) -> str:
    """SELECT with the key columns, the time as text, rounded numbers and plain columns."""
    parts = [keys] if keys else []
    if ts:
        parts.append(f"strftime(timestamp_utc, {DATE}) AS timestamp_utc")
    for name, expr in cols.items():
        parts.append(f"{expr if name in plain else rnd(expr, digits)} AS {name}")
    return f"SELECT {', '.join(parts)} FROM {source}"


def at_least_one(x: str) -> str:
    """greatest() skips NULL; a missing number has no lower bound."""
    return f"CASE WHEN {x} IS NOT NULL THEN greatest({x}, 1.0) END"


def same(*names) -> dict:
    return {n: n for n in names}


def frame(back: int, ahead: int = 0) -> str:
    end = "CURRENT ROW" if ahead == 0 else (f"{-ahead} PRECEDING" if ahead < 0 else f"{ahead} FOLLOWING")
    return f"({W} ROWS BETWEEN {back} PRECEDING AND {end})"


PAST = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BEFORE = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def roll(fn: str, col: str, size: int, least: int) -> str:
    f = frame(size - 1)
    return f"CASE WHEN count({col}) OVER {f} >= {least} THEN {fn} OVER {f} END"


def std(col, size, least):
    return roll(f"stddev_samp({col})", col, size, least)


def mean(col, size, least):
    return roll(f"avg({col})", col, size, least)


def lag(col, k=1):
    return f"lag({col}, {k}) OVER ({W})"


def ffill(col):
    return f"last_value({col} IGNORE NULLS) OVER {PAST}"


def repair(source: str, cols, name: str) -> str:
    """Three steps: linear in time (6 rows), hold (3 rows), back-fill (3 rows)."""
    prev, line, hold, fill = [], [], [], []
    for c in cols:
        near, later = frame(6, -1), f"({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
        t = f"CASE WHEN {c} IS NOT NULL THEN timestamp_utc END"
        prev += [
            f"last_value({c} IGNORE NULLS) OVER {near} AS pv_{c}", f"last_value({t} IGNORE NULLS) OVER {near} AS pt_{c}",
            f"first_value({c} IGNORE NULLS) OVER {later} AS nv_{c}", f"first_value({t} IGNORE NULLS) OVER {later} AS nt_{c}",
        ]
        share = f"((epoch_us(timestamp_utc) - epoch_us(pt_{c}))::DOUBLE / (epoch_us(nt_{c}) - epoch_us(pt_{c})))"
        line.append(f"coalesce({c}, coalesce(pv_{c} + (nv_{c} - pv_{c}) * {share}, pv_{c})) AS {c}")
        hold.append(f"last_value({c} IGNORE NULLS) OVER {frame(3)} AS {c}")
        fill.append(f"first_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS {c}")
    gap = " OR ".join(f"{c} IS NULL" for c in cols)
    return f"""
{name}_a AS (SELECT *, ({gap}) AS had_gap, {', '.join(prev)} FROM {source}),
{name}_b AS (SELECT {K}, had_gap, {', '.join(line)} FROM {name}_a),
{name}_c AS (SELECT {K}, had_gap, {', '.join(hold)} FROM {name}_b),
{name} AS (SELECT {K}, had_gap, {', '.join(fill)} FROM {name}_c)"""


def kind(event: str) -> str:
    return six(f"avg(value) FILTER (WHERE event_type = '{event}')")


def season(col: str, source_fallback: str) -> str:
    slot = "(PARTITION BY series_id, isodow(timestamp_utc), hour(timestamp_utc) ORDER BY timestamp_utc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"coalesce(avg({col}) OVER {slot}, avg({col}) OVER {BEFORE}, {source_fallback})"


BASE = f"""
ev AS (SELECT *, 'Z' || (user_id % 4)::VARCHAR AS series_id, date_trunc('hour', ts) AS h FROM events),
panel AS (
  SELECT series_id, h AS timestamp_utc, {kind('purchase')} AS {P}, {kind('view')} * 1000.0 AS {D}, {kind('click')} AS {R},
    {kind('signup')} AS {DA}, {kind('error')} AS {IM} FROM ev GROUP BY 1, 2),
bounds AS (SELECT series_id, min(timestamp_utc) AS lo, max(timestamp_utc) AS hi FROM panel GROUP BY 1),
grid AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS timestamp_utc FROM bounds),
aligned AS (SELECT * FROM grid LEFT JOIN panel USING (series_id, timestamp_utc)),
{repair('aligned', PANEL, 'filled')},
rounded AS (SELECT {K}, had_gap, {', '.join(f'{six(c)} AS {c}' for c in PANEL)} FROM filled),
clean AS (
  SELECT {K}, had_gap, coalesce({P}, {DA}) AS {P}, {D}, {R}, coalesce({DA}, {P}) AS {DA}, {IM}, {P} AS {IN},
    {P} - coalesce({DA}, {P}) AS {SP} FROM rounded),
wx_raw AS (
  SELECT series_id, h AS timestamp_utc, {six('avg(k)')} AS {WEATHER[0]}, min(k) AS {WEATHER[1]}, max(k) AS {WEATHER[2]},
    {six('avg(k * k)')} AS {WEATHER[3]}
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM ev) GROUP BY 1, 2),
wx_grid AS (
  SELECT series_id, unnest(generate_series(min(timestamp_utc), max(timestamp_utc), INTERVAL 1 HOUR)) AS timestamp_utc
  FROM wx_raw GROUP BY series_id),
wx_aligned AS (SELECT * FROM wx_grid LEFT JOIN wx_raw USING (series_id, timestamp_utc)),
{repair('wx_aligned', WEATHER, 'wx_filled')},
wx AS (SELECT {K}, {', '.join(f'{six(c)} AS {c}' for c in WEATHER)} FROM wx_filled),
merged AS (SELECT * EXCLUDE (had_gap) FROM clean JOIN wx USING (series_id, timestamp_utc)),
scored AS (
  SELECT * EXCLUDE (had_gap), {six(f'avg({P}) OVER {frame(24, -1)}')} AS {PREDS[0]}, {lag(D)} AS {PREDS[1]}, {lag(R)} AS {PREDS[2]}
  FROM clean),
cand AS (
  SELECT series_id, h AS timestamp_utc, value AS {P}, event_id,
    CASE event_id % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'partially_synthetic' ELSE 'synthetic' END AS data_quality,
    CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS q,
    CASE WHEN event_id % 7 <> 0 THEN TIMESTAMP '2024-02-01' + to_seconds(event_id % 1000) END AS fetched
  FROM ev)"""

MARKET = f"""
base AS (
  SELECT *, pred_price_eur_mwh - {P} AS delta0, {D} / 1000.0 - {R} AS net_load_mw,
    coalesce({P} - {lag(P)}, 0.0) AS price_trend FROM scored),
st1 AS (
  SELECT *, {std(P, 24, 12)} AS v0, {roll(f'quantile_cont({P}, 0.5)', P, 72, 24)} AS e0, {mean('net_load_mw', 72, 6)} AS l0,
    {std(SP, 24, 4)} AS s0, stddev_samp({P}) OVER {PAST} AS vx, avg(net_load_mw) OVER {PAST} AS lx,
    quantile_cont({P}, 0.5) OVER {PAST} AS ex, stddev_samp({SP}) OVER {PAST} AS sx,
    lead({P}) OVER ({W}) AS next_price FROM base),
st2 AS (
  SELECT *, coalesce({ffill('v0')}, vx) AS vol, coalesce({ffill('e0')}, ex) AS eq, coalesce({ffill('l0')}, lx) AS load_eq,
    coalesce({ffill('s0')}, sx) AS spread_vol FROM st1),
st3 AS (
  SELECT *, {roll('quantile_cont(vol, 0.7)', 'vol', 72, 6)} AS q70, {mean('price_trend', 24, 4)} AS tm, {mean('vol', 24, 4)} AS vm
  FROM st2),
scale AS (
  SELECT series_id, greatest(coalesce(quantile_cont(abs({P}), 0.5) FILTER (WHERE abs({P}) > 0), 1.0), 1.0) AS ref FROM scored GROUP BY 1),
market AS (
  SELECT *, CASE WHEN coalesce(vol > q70, false) THEN 'high_vol' ELSE 'low_vol' END AS vr,
    CASE WHEN coalesce(abs(tm) > coalesce(vm, 0.0) * 0.3, false) THEN 'trend' ELSE 'mean_revert' END AS mr,
    coalesce(lag({D}) OVER ({W}), {D}) AS last_d, coalesce(lag({R}) OVER ({W}), {R}) AS last_r,
    coalesce(lag({P}) OVER ({W}), {P}) AS last_p
  FROM st3 JOIN scale USING (series_id)),
seasonal AS (
  SELECT {K}, {season(P, 'last_p')} AS sea_p, {season(D, 'last_d')} AS sea_d, {season(R, 'last_r')} AS sea_r FROM market),
options AS (
  SELECT m.* EXCLUDE ({', '.join(PREDS)}), o.* FROM market m JOIN seasonal s USING (series_id, timestamp_utc),
  LATERAL (VALUES
    ('original_strategy', false, false, m.{PREDS[0]}, m.{PREDS[1]}, m.{PREDS[2]}),
    ('upgraded_strategy', true, false, m.{PREDS[0]}, m.{PREDS[1]}, m.{PREDS[2]}),
    ('persistence', true, false, m.last_p, m.last_d, m.last_r),
    ('seasonal', true, false, s.sea_p, s.sea_d, s.sea_r),
    ('naive_mean_reversion', false, false, m.{DA} - 0.5 * coalesce(m.{SP}, 0.0), m.last_d, m.last_r),
    ('zero_signal', true, true, m.{P}, m.{D}, m.{R})
  ) o(strategy_name, is_new, off, {', '.join(PREDS)})),
sig1 AS (
  SELECT *, {PREDS[0]} - {P} AS delta, {PREDS[1]} / 1000.0 - {PREDS[2]} AS imb FROM options),
sig2 AS (
  SELECT *, CASE WHEN delta > 0.5 THEN 'LONG' WHEN delta < -0.5 THEN 'SHORT' ELSE 'HOLD' END AS price_edge_decision,
    CASE WHEN delta > 0.5 THEN 1.0 WHEN delta < -0.5 THEN -1.0 ELSE 0.0 END AS side,
    CASE WHEN delta IS NOT NULL THEN greatest(delta - 0.5, 0.0) + greatest(-0.5 - delta, 0.0) END AS strength,
    CASE WHEN is_new THEN delta / (vol + 1e-6) ELSE delta END AS fs,
    CASE WHEN is_new THEN -({P} - eq) / (vol + 1e-6) ELSE 0.0 END AS ms,
    CASE WHEN is_new THEN (imb - load_eq) / 8.0 ELSE imb / 8.0 END AS fu,
    {SP} / (spread_vol + 1e-6) AS ss,
    CASE WHEN is_new THEN vr ELSE 'low_vol' END AS vol_regime, CASE WHEN is_new THEN mr ELSE 'trend' END AS market_regime
  FROM sig1),
sig3 AS (
  SELECT *, side * tanh(strength / 2.0) AS base_pos,
    CASE WHEN side * fu IS NOT NULL THEN 1.0 + 0.25 * tanh(greatest(side * fu, 0.0)) END AS mult FROM sig2),
sig4 AS (
  SELECT *, CASE WHEN off THEN 0.0 WHEN NOT is_new THEN base_pos
      ELSE base_pos * mult / (1.0 + vol) * CASE WHEN vol_regime = 'high_vol' THEN 0.65 ELSE 1.0 END END AS target_position_raw,
    CASE WHEN off THEN 0.0 ELSE fs END AS forecast_signal, CASE WHEN off THEN 0.0 ELSE ms END AS mean_reversion_signal,
    CASE WHEN off THEN 0.0 ELSE fu END AS fundamental_signal,
    CASE WHEN off THEN 0.0 WHEN NOT is_new THEN 0.06 * imb + 0.4 * delta
      WHEN market_regime = 'trend' THEN coalesce(0.45 * fs + 0.25 * fu, 0.0) ELSE coalesce(0.30 * ms + 0.25 * fu, 0.0) END
      AS ensemble_signal,
    CASE WHEN off THEN 0.0 WHEN is_new THEN side * strength ELSE 0.0 END AS signal_z_score,
    CASE WHEN off THEN 'HOLD' ELSE price_edge_decision END AS target_decision
  FROM sig3),
signals AS (
  SELECT *, CASE WHEN target_position_raw IS NULL THEN 0.0 ELSE greatest(least(target_position_raw, 1.0), -1.0) END AS target_position,
    row_number() OVER (PARTITION BY series_id, strategy_name ORDER BY timestamp_utc) AS rn FROM sig4)"""

TRADES = f"""
ramp(series_id, strategy_name, rn, pos, clipped) AS (
  SELECT series_id, strategy_name, 0::BIGINT, 0.0::DOUBLE, false FROM (SELECT DISTINCT series_id, strategy_name FROM signals)
  UNION ALL
  SELECT r.series_id, r.strategy_name, s.rn,
    greatest(least(r.pos + greatest(least(s.target_position - r.pos, 0.35), -0.35), 1.0), -1.0),
    abs(s.target_position - r.pos) > 0.35
  FROM ramp r JOIN signals s ON s.series_id = r.series_id AND s.strategy_name = r.strategy_name AND s.rn = r.rn + 1),
pos AS (
  SELECT s.*, r.pos AS target_position_constrained, r.clipped AS liquidity_clipped,
    coalesce(lag(r.pos) OVER w, 0.0) AS p1, coalesce(lag(r.pos, 2) OVER w, 0.0) AS p2
  FROM signals s JOIN ramp r USING (series_id, strategy_name, rn)
  WINDOW w AS (PARTITION BY series_id, strategy_name ORDER BY rn)),
trade1 AS (
  SELECT *, p1 AS position, p1 - p2 AS change, abs(p1 - p2) AS turnover, 10000.0 / ref AS exposure_mwh,
    coalesce({IN}, {P}) AS exec_ref, coalesce(next_price - {P}, 0.0) AS fwd,
    {at_least_one(f'abs(coalesce({IN}, {P}))')} * (3.0 / 10000.0) AS spread_eur FROM pos),
trade2 AS (
  SELECT *, turnover * exposure_mwh * (spread_eur / 2.0) AS spread_cost_eur,
    turnover * exposure_mwh * (0.08 * coalesce(vol, 0.0) + 0.02 * turnover * {at_least_one('abs(exec_ref)')}) AS slippage_cost_eur,
    turnover * exposure_mwh * coalesce(vol, 0.0) * 0.03 AS delay_cost_eur, turnover * 10000.0 * (5.0 / 10000.0) AS transaction_cost_eur,
    position * fwd * exposure_mwh AS gross_pnl_eur,
    abs(target_position - target_position_constrained) * exposure_mwh * abs(fwd) AS opportunity_cost_proxy_eur,
    exec_ref + sign(change) * spread_eur / 2.0 AS fill_price_eur_mwh FROM trade1),
trades AS (
  SELECT *, gross_pnl_eur - transaction_cost_eur - spread_cost_eur - slippage_cost_eur - delay_cost_eur AS net_pnl_eur
  FROM trade2),
equity(series_id, strategy_name, rn, e, r) AS (
  SELECT series_id, strategy_name, 0::BIGINT, 10000.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT series_id, strategy_name FROM signals)
  UNION ALL
  SELECT q.series_id, q.strategy_name, t.rn,
    greatest(q.e * (1.0 + greatest(least(coalesce(t.net_pnl_eur, 0.0) / q.e, 1.0 - 1e-6), -1.0 + 1e-6)), 1e-6),
    greatest(least(coalesce(t.net_pnl_eur, 0.0) / q.e, 1.0 - 1e-6), -1.0 + 1e-6)
  FROM equity q JOIN trades t ON t.series_id = q.series_id AND t.strategy_name = q.strategy_name AND t.rn = q.rn + 1),
money AS (
  SELECT t.*, q.r AS strategy_return, q.e AS equity_eur, q.e - coalesce(lag(q.e) OVER w, 10000.0) AS pnl,
    CASE WHEN is_new THEN CASE WHEN position > 1e-6 THEN 'LONG' WHEN position < -1e-6 THEN 'SHORT' ELSE 'HOLD' END
      ELSE CASE WHEN position > 0.1 THEN 'LONG' WHEN position < -0.1 THEN 'SHORT' ELSE 'HOLD' END END AS decision
  FROM trades t JOIN equity q USING (series_id, strategy_name, rn)
  WINDOW w AS (PARTITION BY series_id, strategy_name ORDER BY rn)),
judged AS (
  SELECT *, next_price AS future_price_eur_mwh, coalesce((next_price - {P}) / greatest(abs({P}), 1.0), 0.0) AS future_price_return,
    coalesce(pnl > 0, false) AS pnl_positive,
    coalesce(next_price IS NOT NULL AND ((decision = 'LONG' AND next_price > {P}) OR (decision = 'SHORT' AND next_price < {P})
      OR (decision = 'HOLD' AND abs(coalesce((next_price - {P}) / greatest(abs({P}), 1.0), 0.0)) <= 0.002)), false) AS directional_correct
  FROM money),
result AS (
  SELECT *, CASE WHEN next_price IS NULL THEN 'pending' WHEN directional_correct THEN 'correct' ELSE 'incorrect' END AS accuracy_status
  FROM judged WHERE strategy_name = 'upgraded_strategy'),
far0 AS (
  SELECT *, lead({P}, 24) OVER ({W}) AS f24 FROM result),
far1 AS (
  SELECT *, coalesce((f24 - {P}) / greatest(abs({P}), 1.0), 0.0) AS r24 FROM far0),
far AS (
  SELECT *, coalesce(f24 IS NOT NULL AND ((decision = 'LONG' AND f24 > {P}) OR (decision = 'SHORT' AND f24 < {P})
      OR (decision = 'HOLD' AND abs(r24) <= 0.01)), false) AS c24 FROM far1),
peaks AS (
  SELECT *, e2 / 10000.0 AS eq1, max(e2 / 10000.0) OVER w AS peak FROM (SELECT *, greatest(equity_eur, 0.0) AS e2 FROM judged)
  WINDOW w AS (PARTITION BY series_id, strategy_name ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
under AS (
  SELECT *, sum(CASE WHEN eq1 >= peak THEN 1 ELSE 0 END) OVER
    (PARTITION BY series_id, strategy_name ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM peaks),
dd AS (
  SELECT series_id, strategy_name, min(worst) AS max_drawdown, max(len)::BIGINT AS drawdown_duration_steps FROM (
    SELECT series_id, strategy_name, run, min((eq1 - peak) / peak) AS worst, count(*) FILTER (WHERE eq1 < peak) AS len
    FROM under GROUP BY ALL) GROUP BY ALL),
metric AS (
  SELECT series_id, strategy_name,
    coalesce(avg(strategy_return) / nullif(stddev_samp(strategy_return), 0.0) * sqrt(24.0), 0.0) AS sharpe_ratio,
    count(*) FILTER (WHERE strategy_return > 0) / greatest(count(*) FILTER (WHERE strategy_return <> 0), 1)::DOUBLE AS hit_rate,
    sum(pnl) AS total_pnl, count(*) FILTER (WHERE turnover > 1e-6) AS trade_count,
    coalesce(avg(strategy_return) FILTER (WHERE decision <> 'HOLD'), 0.0) AS average_trade_return,
    coalesce(avg(directional_correct::INT) FILTER (WHERE next_price IS NOT NULL), 0.0) AS directional_accuracy,
    coalesce(avg(pnl_positive::INT) FILTER (WHERE next_price IS NOT NULL), 0.0) AS pnl_positive_rate,
    sum(gross_pnl_eur) AS gross_pnl_eur, sum(net_pnl_eur) AS net_pnl_eur, sum(spread_cost_eur) AS spread_cost_eur,
    sum(slippage_cost_eur) AS slippage_cost_eur, sum(delay_cost_eur) AS delay_cost_eur,
    sum(opportunity_cost_proxy_eur) AS opportunity_cost_proxy_eur
  FROM judged GROUP BY ALL),
metrics AS (SELECT * FROM metric JOIN dd USING (series_id, strategy_name))"""


def hashed(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 12))::BIGINT"


def draws(iterations: int, streams, source: str, block: int = 3840) -> str:
    """Replicates with the same MD5 draws, first split over blocks of rows, then drawn inside a block.

    ``source`` has series_id, rn0 (0-based) and the streams.
    """
    cols = ", ".join(
        f"coalesce(avg({s}) / nullif(stddev_samp({s}), 0.0) * sqrt(24.0), 0.0) AS sh_{s}, avg({s}) AS mn_{s}" for s in streams
    )
    return f"""
streams AS ({source}),
sizes AS (SELECT series_id, count(*) AS n FROM streams GROUP BY 1),
slots AS (
  SELECT series_id, rep, n, CASE WHEN n <= {block} THEN 0 ELSE {hashed("'42-' || rep || '-block-' || rn0")} % n // {block} END AS blk
  FROM streams JOIN sizes USING (series_id), generate_series(1, {iterations}) g(rep)),
dealt AS (SELECT *, row_number() OVER (PARTITION BY series_id, rep, blk) - 1 AS k FROM slots),
picks AS (
  SELECT series_id, rep, blk * {block} + {hashed("'42-' || rep || '-' || blk || '-' || k")} % least({block}, n - blk * {block}) AS rn0 FROM dealt),
boot AS (SELECT series_id, rep, {cols} FROM picks JOIN streams USING (series_id, rn0) GROUP BY 1, 2)"""


def poisson(iterations: int, streams, source: str) -> str:
    """Replicates with Poisson(1) row weights from the same hash."""
    cuts, mass, total, k = [], math.exp(-1.0), math.exp(-1.0), 0
    while total <= 1.0 - 2.0**-48:
        cuts.append(total)
        k += 1
        mass /= k
        total += mass
    weight = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in cuts)
    sums = ", ".join(f"sum(w * {s}) AS a_{s}, sum(w * {s} * {s}) AS q_{s}" for s in streams)
    cols = ", ".join(
        f"coalesce(a_{s} / n / nullif(sqrt(greatest((q_{s} - n * (a_{s} / n) * (a_{s} / n)) / (n - 1), 0.0)), 0.0) * sqrt(24.0), 0.0) AS sh_{s}"
        for s in streams
    )
    return f"""
streams AS ({source}),
spread_rows AS (
  SELECT *, {hashed("'42-' || rep || '-' || rn0")} / 281474976710656.0::DOUBLE AS u
  FROM streams, generate_series(1, {iterations}) g(rep)),
weighted AS (SELECT *, ({weight})::DOUBLE AS w FROM spread_rows),
totals AS (SELECT series_id, rep, sum(w) AS n, {sums} FROM weighted GROUP BY 1, 2),
boot AS (SELECT series_id, rep, {cols} FROM totals)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n"


#: Without execution delay the position reached in an hour is held from that hour on, and waiting costs nothing.
AT_ONCE = TRADES.replace(
    "p1 AS position, p1 - p2 AS change, abs(p1 - p2) AS turnover",
    "target_position_constrained AS position, target_position_constrained - p1 AS change, abs(target_position_constrained - p1) AS turnover",
).replace("coalesce(vol, 0.0) * 0.03 AS delay_cost_eur", "0.0 AS delay_cost_eur")
B, M = with_(BASE), with_(BASE, MARKET)
T = with_(BASE, MARKET, TRADES)
WIDE = (
    "SELECT series_id, rn - 1 AS rn0, "
    + ", ".join(f"max(strategy_return) FILTER (WHERE strategy_name = '{s}') AS {s}" for s in STRATEGIES)
    + " FROM judged GROUP BY 1, 2"
)
CI = " UNION ALL ".join(
    f"SELECT series_id, '{s}' AS strategy_name, {rnd(f'quantile_cont(sh_{s}, 0.025)')} AS sharpe_ci_lower, "
    f"{rnd(f'quantile_cont(sh_{s}, 0.975)')} AS sharpe_ci_upper FROM boot GROUP BY 1"
    for s in STRATEGIES
)


def pair(a: str, b: str, names: str, mean_digits: int) -> str:
    gap = f"sh_{a} - sh_{b}"
    return (
        f"SELECT series_id, {names}{rnd(f'avg({gap})')} AS sharpe_diff, {rnd(f'avg(mn_{a} - mn_{b})', mean_digits)} AS pnl_diff_mean, "
        f"{rnd(f'quantile_cont({gap}, 0.025)')} AS sharpe_diff_ci_lower, {rnd(f'quantile_cont({gap}, 0.975)')} AS sharpe_diff_ci_upper, "
        f"quantile_cont({gap}, 0.025) > 0 AS significant_outperformance FROM boot GROUP BY series_id"
    )


PAIRS = " UNION ALL ".join(
    pair(a, b, f"'{a}' AS strategy_name, '{b}' AS baseline_name, ", 6)
    for a in ("upgraded_strategy", "original_strategy") for b in BASELINES
)

RUNS = f"""
flagged AS (SELECT *, ({{cond}}) AS bad FROM aligned),
marked AS (
  SELECT {K}, CASE WHEN timestamp_utc - lag(timestamp_utc) OVER ({W}) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh
  FROM flagged WHERE bad),
numbered AS (SELECT *, sum(fresh) OVER {PAST} AS run FROM marked)"""


def runs(cond: str) -> str:
    return with_(BASE, RUNS.format(cond=cond)) + (
        f"SELECT series_id, strftime(min(timestamp_utc), {DATE}) AS range_start, "
        f"strftime(max(timestamp_utc) + INTERVAL 1 HOUR, {DATE}) AS range_end FROM numbered GROUP BY series_id, run"
    )


def pieces(source: str) -> str:
    return (
        f"SELECT series_id, strftime(a, {DATE}) AS chunk_start, strftime(least(a + INTERVAL 7 DAY, hi), {DATE}) AS chunk_end "
        f"FROM (SELECT series_id, hi, unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS a FROM {source}) WHERE a < hi"
    )


def halves(source: str) -> str:
    mid = "(CASE WHEN date_trunc('hour', lo + (hi - lo) / 2) = lo + (hi - lo) / 2 THEN lo + (hi - lo) / 2 ELSE date_trunc('hour', lo + (hi - lo) / 2) + INTERVAL 1 HOUR END)"
    return f"SELECT series_id, lo, {mid} AS hi FROM {source} UNION ALL SELECT series_id, {mid} AS lo, hi FROM {source}"


BEST = "row_number() OVER (PARTITION BY series_id, timestamp_utc ORDER BY q DESC, fetched DESC NULLS LAST, event_id DESC)"
CAND_OUT = (
    f"SELECT series_id, strftime(timestamp_utc, {DATE}) AS timestamp_utc, {rnd(P)} AS {P}, data_quality, 'feed' AS data_source, "
    f"q <> 2 AS is_synthetic, strftime(fetched, {DATE}) AS fetch_timestamp_utc, 1::BIGINT AS cache_version, event_id FROM {{source}}"
)


def best(source: str) -> str:
    return f"(SELECT * FROM (SELECT *, {BEST} AS pick FROM {source}) WHERE pick = 1)"


def feed(event: str, name: str) -> str:
    return f"(SELECT series_id, h AS timestamp_utc, avg(value) AS {name} FROM ev WHERE event_type = '{event}' GROUP BY 1, 2)"


CTX = f"""
shares AS (SELECT series_id, avg(({DA} IS NULL)::INT) AS da_null, avg(({IM} IS NULL)::INT) AS im_null FROM {{source}} GROUP BY 1),
ctx AS (
  SELECT a.* EXCLUDE ({{drop}}), coalesce({DA}, {P}) AS da, coalesce({{intra}}, {DA}, {P}) AS intra,
    coalesce({IM}, {{intra}}, {DA}, {P}) AS im, {R} AS rf, da_null, im_null
  FROM {{source}} a JOIN shares USING (series_id))"""
FEAT = CTX.format(source="merged", drop=f"{DA}, {IM}, {IN}, {SP}", intra=IN) + f""",
lv AS (
  SELECT *, {D} / 1000.0 - {R} AS nl, intra - da AS sp, rf - {R} AS fe, hour(timestamp_utc) AS hh, isodow(timestamp_utc) - 1 AS dw,
    month(timestamp_utc) AS mo FROM ctx),
wf1 AS (
  SELECT *, {P} - {lag(P)} AS dp, nl - {lag('nl')} AS dl, wind_speed_mps - {lag('wind_speed_mps')} AS dwind,
    CASE WHEN {lag(P)} = 0 THEN CASE WHEN {P} <> 0 THEN 0.0 END ELSE {P} / {lag(P)} - 1 END AS mom FROM lv),
wf2 AS (SELECT *, {std('dp', 24, 12)} AS rv FROM wf1),
wf3 AS (SELECT *, {roll('quantile_cont(rv, 0.7)', 'rv', 168, 24)} AS q0 FROM wf2)"""


def z24(col):
    return f"({col} - ({mean(col, 24, 12)})) / nullif(({std(col, 24, 12)}), 0.0)"


OVER = f"""
fb0 AS (
  SELECT *, {', '.join(f"{season(c, lag(c))} AS fb_{c}" for c in PANEL)} FROM aligned),
fb AS (
  SELECT *, ({' OR '.join(f'{c} IS NOT NULL' for c in (P, DA, D, R))}) AS any_real,
    ({' OR '.join(f'{c} IS NULL' for c in (P, DA, D, R))}) AS any_missing FROM fb0),
over AS (
  SELECT *, CASE WHEN NOT any_real THEN 'synthetic' WHEN any_missing THEN 'partially_synthetic'
    ELSE CASE WHEN {P} IS NOT NULL THEN 'real' ELSE 'synthetic' END END AS quality,
    coalesce(CASE WHEN {P} IS NOT NULL THEN 'feed' END, 'feed_synthetic') AS known FROM fb)"""

ANOM = (P, D, R, SP)
ANOMALY = f"""
numbered_rows AS (
  SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM clean),
long AS ({' UNION ALL '.join(f"SELECT series_id, i, n, '{c}' AS col, {c} AS x FROM numbered_rows" for c in ANOM)}),
stats AS (SELECT series_id, col, avg(x) AS m, stddev_samp(x) AS s FROM long GROUP BY ALL),
review AS (
  SELECT series_id, col, count(*) FILTER (WHERE x IS NULL) AS missing,
    count(*) FILTER (WHERE abs((x - m) / (s + 1e-6)) > 4.0) AS spike_count, max(abs((x - m) / (s + 1e-6))) AS max_abs_zscore,
    avg(x) FILTER (WHERE i < greatest(n // 3, 1)) AS early_mean, avg(x) FILTER (WHERE i >= n - greatest(n // 3, 1)) AS late_mean,
    max(s) AS s FROM long JOIN stats USING (series_id, col) GROUP BY ALL),
report AS (
  SELECT *, col <> '{D}' AND col <> '{R}' AND coalesce(abs(late_mean - early_mean) > 1.5 * s, false) AS structural_break FROM review)"""

ATTR = " UNION ALL ".join(
    f"SELECT series_id, '{name}' AS dimension, {expr} AS bucket, {rnd('sum(net_pnl_eur)', 3)} AS pnl_sum, "
    f"{rnd('avg(net_pnl_eur)', 3)} AS pnl_mean, count(net_pnl_eur) AS n FROM result GROUP BY 1, 3"
    for name, expr in (
        ("vol_regime", "vol_regime"), ("market_regime", "market_regime"), ("hour", "hour(timestamp_utc)::VARCHAR"),
        ("month", "month(timestamp_utc)::VARCHAR"),
    )
)

FOLDS = """
lens AS (SELECT series_id, count(*) AS n FROM clean GROUP BY 1),
folds AS (
  SELECT series_id, n, least(336, n - 168) AS w, unnest(generate_series(0, (n - 168 - least(336, n - 168)) // 168)) AS fold
  FROM lens WHERE n > 168)"""

SIGNAL_COLUMNS = dict(
    rolling_volatility="vol", equilibrium_price_eur_mwh="eq", spread_signal="ss", price_edge_strength="strength",
    **same("forecast_signal", "mean_reversion_signal", "fundamental_signal", "vol_regime", "market_regime", "price_edge_decision",
           "ensemble_signal", "target_position_raw", "target_position"),
)
LABELS = ("vol_regime", "market_regime", "price_edge_decision")
EVENT = (
    f"SELECT series_id, '2024-02-01 00:00:00' AS logged_at_utc, strftime(timestamp_utc, {DATE}) AS timestamp_utc, "
    + ", ".join(f"{rnd(c)} AS {c}" for c in PREDS)
    + f", {rnd(f'{PREDS[1]} / 1000.0 - {PREDS[2]}')} AS pred_imbalance_mw, {rnd('target_position')} AS target_position, "
    f"{rnd('position')} AS executed_position, decision, 'model' AS model_key FROM (SELECT *, row_number() OVER "
    "(PARTITION BY series_id ORDER BY timestamp_utc DESC) AS back FROM result) WHERE back <= 24"
)
MOVES = f"(SELECT *, coalesce({P} - {lag(P)}, 0.0) AS mv, coalesce(({P} - {lag(P)}) / greatest(abs({lag(P)}), 1.0), 0.0) AS rt FROM clean)"
SHORT = [c for c in ("persistence", "seasonal", "naive_mean_reversion", "zero_signal")]
BASE_EXPR = {
    "persistence": ("last_p", "last_d", "last_r"),
    "seasonal": ("sea_p", "sea_d", "sea_r"),
    "naive_mean_reversion": (f"{DA} - 0.5 * coalesce({SP}, 0.0)", "last_d", "last_r"),
    "zero_signal": (P, D, R),
}
ERR = f"({PREDS[0]} - {P})"

ORACLES: dict = {
    # grid, gaps, rollup
    "hourly_rollup": B + f"SELECT series_id, strftime(h, {DATE}) AS timestamp_utc, {rnd('avg(value)')} AS value FROM ev GROUP BY series_id, h",
    "hourly_rollup_no_values": B + f"SELECT DISTINCT series_id, strftime(h, {DATE}) AS timestamp_utc FROM ev",
    "quarter_hour_rollup": B + (
        f"SELECT series_id, strftime(date_trunc('hour', q), {DATE}) AS timestamp_utc, {rnd('avg(v)')} AS value FROM ("
        "SELECT series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS q, round(avg(value) + 3e-10, 6) AS v FROM ev GROUP BY 1, 2) "
        "GROUP BY series_id, date_trunc('hour', q)"
    ),
    "hourly_grid_coverage": B + "SELECT g.series_id, count(*) AS grid_rows, count(p.series_id) AS present_rows FROM grid g "
    "LEFT JOIN panel p USING (series_id, timestamp_utc) GROUP BY 1",
    "missing_ranges": runs(f"{P} IS NULL"),
    "missing_ranges_forced": runs("true"),
    "chunked_ranges": B + pieces("bounds"),
    "bisected_ranges": with_(BASE, f"one AS ({halves('bounds')}), two AS ({halves('one')})")
    + f"SELECT series_id, strftime(lo, {DATE}) AS range_start, strftime(hi, {DATE}) AS range_end FROM two",
    "interpolate_and_fill": B + out("series_id", "filled", plain=("had_gap",), **same("had_gap", *PANEL)),
    "causal_fill": B + out(
        "series_id", "aligned", plain=("had_gap",), had_gap="(" + " OR ".join(f"{c} IS NULL" for c in PANEL) + ")",
        **{c: f"last_value({c} IGNORE NULLS) OVER {frame(3)}" for c in PANEL},
    ),
    "resolved_prices": B + out("series_id", "aligned", **{P: f"coalesce({P}, {DA})", DA: f"coalesce({DA}, {P})", IN: P, SP: f"{P} - coalesce({DA}, {P})"}),
    # quality
    "repaired_quality": B + (
        f"SELECT f.series_id, strftime(f.timestamp_utc, {DATE}) AS timestamp_utc, {rnd(f'f.{P}')} AS {P}, "
        f"CASE WHEN f.had_gap OR a.{P} IS NULL THEN 'partially_synthetic' ELSE 'real' END AS data_quality, "
        f"(f.had_gap OR a.{P} IS NULL) AS is_synthetic, 'feed' AS data_source, f.had_gap "
        "FROM filled f JOIN aligned a USING (series_id, timestamp_utc)"
    ),
    "repaired_flags": B + f"SELECT series_id, ({P} IS NULL OR {DA} IS NULL OR {D} IS NULL OR {R} IS NULL) AS required_repaired, "
    f"{IM} IS NULL AS optional_repaired, count(*) AS n FROM aligned GROUP BY ALL",
    "annotated_source": B + (
        f"SELECT series_id, strftime(timestamp_utc, {DATE}) AS timestamp_utc, CASE WHEN ok THEN 'real' ELSE 'partially_synthetic' END AS data_quality, "
        "NOT ok AS is_synthetic, 'feed' AS data_source, '2024-02-01 00:00:00' AS fetch_timestamp_utc, 1::BIGINT AS cache_version FROM "
        f"(SELECT *, ({P} IS NOT NULL AND {DA} IS NOT NULL AND {D} IS NOT NULL AND {R} IS NOT NULL) AS ok FROM panel)"
    ),
    "upsert_by_quality": B + CAND_OUT.format(source=best("cand")),
    "incremental_merge": with_(BASE, f"old AS (SELECT * EXCLUDE (pick) FROM {best('cand WHERE timestamp_utc < TIMESTAMP ' + chr(39) + '2024-01-20' + chr(39))})")
    + CAND_OUT.format(
        source="(SELECT * FROM old WHERE timestamp_utc < TIMESTAMP '2024-01-15' UNION ALL SELECT * EXCLUDE (pick) FROM "
        + best("(SELECT * FROM old WHERE timestamp_utc >= TIMESTAMP '2024-01-15' UNION ALL SELECT * FROM cand WHERE timestamp_utc >= TIMESTAMP '2024-01-15')")
        + ")"
    ),
    "dedupe_first": B + f"SELECT series_id, strftime(timestamp_utc, {DATE}) AS timestamp_utc, {rnd(f'arg_min({P}, event_id)')} AS {P}, "
    "min(event_id) AS event_id FROM cand GROUP BY series_id, cand.timestamp_utc",
    "fallback_overlay": with_(BASE, OVER) + out(
        "series_id", "over", plain=("data_quality", "data_source", "is_synthetic", "fetch_timestamp_utc", "cache_version", "optional_filled"),
        **{c: f"coalesce({c}, fb_{c})" for c in PANEL}, data_quality="quality", is_synthetic="quality <> 'real'",
        data_source="CASE quality WHEN 'synthetic' THEN 'feed_synthetic' WHEN 'partially_synthetic' THEN known || '+synthetic' ELSE known END",
        fetch_timestamp_utc="'2024-02-01 00:00:00'", cache_version="1::BIGINT", optional_filled=f"{IM} IS NULL AND fb_{IM} IS NOT NULL",
    ),
    "provenance_summary": B + (
        "SELECT *, " + ", ".join(
            f"{rnd(f'{a}_rows / row_count::DOUBLE')} AS {b}_coverage_ratio"
            for a, b in (("real", "real"), ("partially_synthetic", "partial_synthetic"), ("synthetic", "synthetic"))
        )
        + ", partially_synthetic_rows = 0 AND synthetic_rows = 0 AS research_grade, CASE WHEN synthetic_rows > 0 AND real_rows = 0 AND "
        "partially_synthetic_rows = 0 THEN 'synthetic' WHEN synthetic_rows > 0 OR partially_synthetic_rows > 0 THEN 'feed_partial_synthetic' "
        "ELSE 'feed' END AS energy_source FROM (SELECT series_id, count(*) AS row_count, count(*) FILTER (WHERE q = 2) AS real_rows, "
        "count(*) FILTER (WHERE q = 1) AS partially_synthetic_rows, count(*) FILTER (WHERE q = 0) AS synthetic_rows FROM cand GROUP BY 1)"
    ),
    "validation_report": with_(BASE, """
hits AS (
  SELECT series_id, timestamp_utc, count(*) AS copies, count(*) FILTER (WHERE fetched IS NULL) AS no_fetch FROM cand GROUP BY 1, 2),
counted AS (
  SELECT series_id, sum(copies) - count(*) AS dup, sum(no_fetch) AS nulls, count(*) AS hours, sum(copies) AS n FROM hits GROUP BY 1)""")
    + " UNION ALL ".join(
        f"SELECT series_id, '{rule}' AS rule, ({expr})::BIGINT AS violations FROM counted"
        for rule, expr in (
            ("invalid_timestamp", "0"), ("duplicate_timestamp", "dup"), ("version_mismatch", "0"),
            ("zone_mismatch", "CASE WHEN series_id = 'Z1' THEN 0 ELSE n END"), ("coordinate_mismatch", "0"), ("null_required", "nulls"),
            ("missing_hour", "720 - hours"), ("outside_grid", "0"),
        )
    ),
    "coerced_types": B + "SELECT series_id, count(ts) AS times, count(k) AS good, 0::BIGINT AS bad, 0::BIGINT AS absent, sum(k) AS good_sum FROM "
    "(SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM ev) GROUP BY 1",
    "conformed_schema": B + f"SELECT count(*) AS n, count({P}) AS prices, 0::BIGINT AS intraday, 0::BIGINT AS synthetic, count(*) AS versions FROM panel",
    "input_null_shares": B + "SELECT series_id, " + ", ".join(f"{rnd(f'avg(({c} IS NULL)::INT)')} AS {c}_null_share" for c in PANEL)
    + f", 1.0::DOUBLE AS {IN}_null_share FROM aligned GROUP BY 1",
    "optional_context": with_(BASE, CTX.format(source="aligned", drop=f"{DA}, {IM}", intra="NULL")) + out(
        "series_id", "ctx",
        **{P: P, D: D, R: R, DA: "da", IM: "im", IN: "intra", "intraday_renewable_forecast_mw": "rf", SP: "intra - da",
           "imbalance_price_spread_eur_mwh": "im - intra", f"{DA}_available": "(da_null <= 0.5)::INT::DOUBLE", f"{IN}_available": "0.0::DOUBLE",
           f"{IM}_available": "(im_null <= 0.5)::INT::DOUBLE", "intraday_renewable_forecast_mw_available": "0.0::DOUBLE"},
    ),
    "anomaly_report": with_(BASE, ANOMALY) + f'SELECT series_id, col AS "column", missing, spike_count, {rnd("max_abs_zscore")} AS max_abs_zscore, '
    f"{rnd('early_mean')} AS early_mean, {rnd('late_mean')} AS late_mean, structural_break FROM report",
    "anomaly_summary": with_(BASE, ANOMALY, """
seen AS (
  SELECT series_id, bool_or(missing > 0) AS m, bool_or(spike_count > 0) AS s, bool_or(structural_break) AS b FROM report GROUP BY 1)""") + (
        "SELECT series_id, CASE WHEN s OR b THEN 'high' ELSE 'low' END AS severity, concat_ws(',', "
        "CASE WHEN m THEN 'missing' END, CASE WHEN s THEN 'spikes' END, CASE WHEN b THEN 'breaks' END, "
        "CASE WHEN NOT (m OR s OR b) THEN 'none' END) AS issues, concat_ws(',', "
        "CASE WHEN m THEN 'interpolate_short_gaps' END, CASE WHEN s THEN 'keep_raw_prices' END, "
        "CASE WHEN b THEN 'evaluate_by_regime' END, CASE WHEN NOT (m OR s OR b) THEN 'keep_rules' END) AS actions FROM seen"
    ),
    "frame_stats": B + f"SELECT count(*) AS rows, 7::BIGINT AS columns, strftime(min(timestamp_utc), {DATE}) AS first_ts, "
    f"strftime(max(timestamp_utc), {DATE}) AS last_ts FROM panel",
    # joins and feeds
    "energy_weather_join": B + out("series_id", "merged", **same(P, D, R, *WEATHER)),
    "feed_outer_join": B + out(
        "series_id",
        f"{feed('signup', DA)} FULL JOIN {feed('view', 'demand_mw')} USING (series_id, timestamp_utc) FULL JOIN {feed('click', R)} "
        f"USING (series_id, timestamp_utc) LEFT JOIN {feed('purchase', IN)} USING (series_id, timestamp_utc) LEFT JOIN {feed('error', IM)} "
        "USING (series_id, timestamp_utc)",
        **{DA: DA, R: R, IN: IN, IM: IM, D: "demand_mw * 1000.0", P: f"coalesce({IN}, {DA})", SP: f"{IN} - {DA}"},
    ),
    "reindexed_fallback": B + out("series_id", f"{feed('purchase', P)} LEFT JOIN {feed('signup', DA)} USING (series_id, timestamp_utc)", **{DA: DA}),
    "rows_in_time_set": B + out("series_id", f"panel SEMI JOIN {feed('error', 'x')} e USING (series_id, timestamp_utc)", **same(*PANEL)),
    "paired_streams": B + (
        f"SELECT series_id, _row, {rnd('a')} AS a, {rnd('b')} AS b FROM (SELECT series_id, v AS a, row_number() OVER ({W}) - 1 AS _row FROM "
        f"{feed('purchase', 'v')}) JOIN (SELECT series_id, v AS b, row_number() OVER ({W}) - 1 AS _row FROM {feed('signup', 'v')}) USING (series_id, _row)"
    ),
    "wide_feed": B + out(
        "series_id", "panel", generation=f"coalesce({P}, 0.0) + coalesce({R}, 0.0) + coalesce({IM}, 0.0)",
        session=f"(coalesce({P}, 0.0) + coalesce({DA}, 0.0)) / nullif(({P} IS NOT NULL)::INT + ({DA} IS NOT NULL)::INT, 0)",
    ),
    "two_sided_price": B + out(
        "series_id", "panel", imbalance_price_buy_eur_mwh=P, imbalance_price_sell_eur_mwh=IM,
        **{IM: f"(coalesce({P}, 0.0) + coalesce({IM}, 0.0)) / nullif(({P} IS NOT NULL)::INT + ({IM} IS NOT NULL)::INT, 0)"},
    ),
    "normalised_feed": B + "SELECT series_id, round(sum(value), 3) AS actual, sum(user_id)::BIGINT AS unit, count(*) AS n FROM ev GROUP BY 1",
    "hourly_arrays": B + out("series_id", "wx", **same(*WEATHER)),
    "hourly_array_files": B + out("series_id", "wx", **same(*WEATHER)),
    "nonempty_columns": B + out("series_id", "aligned", **same(*PANEL)),
    "run_artifacts": T + f"""
SELECT series_id, r.n AS result_rows, {rnd("r.p", 3)} AS price_sum, {rnd("m.total_pnl", 3)} AS total_pnl, m.trade_count, r.n AS row_count
FROM (SELECT series_id, count(*) AS n, sum({P}) AS p FROM scored GROUP BY 1) r
JOIN (SELECT * FROM metrics WHERE strategy_name = 'upgraded_strategy') m USING (series_id)""",
    # features
    "calendar_features": B + (
        f"SELECT series_id, strftime(timestamp_utc, {DATE}) AS timestamp_utc, hour(timestamp_utc) AS hour, isodow(timestamp_utc) - 1 AS day_of_week, "
        "month(timestamp_utc) AS month, " + ", ".join(
            f"{rnd(f'{fn}(2 * pi() * {x} / {p})', 6)} AS {n}_{fn}"
            for n, x, p in (("hour", "hour(timestamp_utc)", "24.0"), ("dow", "(isodow(timestamp_utc) - 1)", "7.0"), ("month", "month(timestamp_utc)", "12.0"))
            for fn in ("sin", "cos")
        )
        + " FROM panel"
    ),
    "lag_roll_features": with_(BASE, FEAT) + out(
        "series_id", "lv",
        **{
            f"{n}_{suffix}": expr
            for n, c in ((P, P), ("net_load_mw", "nl"))
            for suffix, expr in (
                ("lag_1", lag(c)), ("lag_24", lag(c, 24)), ("roll_mean_24", mean(c, 24, 24)), ("roll_std_24", std(c, 24, 24)),
                ("ramp_1h", f"{c} - {lag(c)}"), ("ramp_24h", f"{c} - {lag(c, 24)}"),
            )
        },
    ),
    "regime_features": with_(BASE, FEAT) + out(
        "series_id", "wf3", plain=("high_vol_regime", "winter_peak_interaction"), price_momentum="mom", imbalance_zscore_24=z24("nl"),
        realized_volatility_24="rv", spread_volatility_24=std("sp", 24, 12), high_vol_regime=f"coalesce(rv > {ffill('q0')}, false)::BIGINT",
        intraday_stress_proxy="abs(sp) + coalesce(abs(fe), 0.0) + coalesce(abs(dl), 0.0)",
        winter_peak_interaction="(mo IN (11, 12, 1, 2) AND hh IN (7, 8, 9, 17, 18, 19))::BIGINT",
        solar_shape_proxy=mean("radiation_wm2", 3, 1), wind_ramp_proxy="coalesce(dwind, 0.0)", temperature_c_anomaly=z24("temperature_c"),
        humidity_pct_anomaly=z24("humidity_pct"), net_load_mw_x_hour_sin="coalesce(nl, 0.0) * sin(2 * pi() * hh / 24.0)",
        **{f"{SP}_x_dow_cos": "coalesce(sp, 0.0) * cos(2 * pi() * dw / 7.0)"},
        renewable_penetration=f"{R} / nullif({D} / 1000.0 + 1e-6, 0.0)",
    ),
    "dense_windows": (
        f"WITH d AS (SELECT l_returnflag AS series_id, date_trunc('day', l_shipdate)::TIMESTAMP AS timestamp_utc, {six('avg(l_extendedprice)')} AS {P}, "
        f"{six('avg(l_quantity)')} AS {D} FROM lineitem GROUP BY 1, 2) "
        + out("series_id", "d", plain=("row_number",), row_number=f"row_number() OVER ({W}) - 1", mean_24=mean(P, 24, 24),
              change=f"CASE WHEN {lag(P)} = 0 THEN CASE WHEN {P} <> 0 THEN 0.0 END ELSE {P} / {lag(P)} - 1 END", step=f"{D} - {lag(D)}", **{P: P})
    ),
    "horizon_features": B + out("series_id", "clean", **{P: lag(P, 2), D: lag(D, 2)}),
    # signals
    "signal_frame": M + out("series_id", "signals WHERE strategy_name = 'upgraded_strategy'", plain=LABELS, **SIGNAL_COLUMNS),
    "signal_legacy": M + out("series_id", "signals WHERE strategy_name = 'original_strategy'", plain=LABELS, **SIGNAL_COLUMNS),
    "baseline_forecasts": M + out(
        "series_id", "market JOIN seasonal USING (series_id, timestamp_utc)",
        **{f"{b}_{p}": BASE_EXPR[b][i] for b in BASELINES for i, p in enumerate(PREDS)},
    ),
    # backtest
    "position_ramp": T + out("series_id", "result", plain=("liquidity_clipped", "position_clipped"), position_clipped="false",
                             **same("target_position", "target_position_constrained", "liquidity_clipped", "position", "turnover")),
    "backtest_costs": T + out(
        "series_id", "result", reference_price_eur_mwh="ref", price_change_eur_mwh="price_trend", price_return="price_trend / ref",
        forward_price_change_eur_mwh="fwd", **same("exposure_mwh", "fill_price_eur_mwh", "spread_cost_eur", "slippage_cost_eur", "delay_cost_eur",
                                                  "transaction_cost_eur", "gross_pnl_eur", "net_pnl_eur", "opportunity_cost_proxy_eur"),
    ),
    "equity_curve": T + out("series_id", "result", plain=("decision",), equity_curve="equity_eur / 10000.0",
                            cumulative_returns="equity_eur / 10000.0 - 1.0", **same("strategy_return", "pnl", "equity_eur", "decision")),
    "equity_curve_bent": with_(BASE, f"""
steps AS (SELECT {K}, coalesce({P} - {DA}, 0.0) AS x, row_number() OVER ({W}) AS rn FROM clean),
bent(series_id, rn, e, r) AS (
  SELECT DISTINCT series_id, 0::BIGINT, 50.0::DOUBLE, 0.0::DOUBLE FROM steps
  UNION ALL
  SELECT b.series_id, s.rn, greatest(b.e * (1.0 + greatest(least(s.x / b.e, 1.0 - 1e-6), -1.0 + 1e-6)), 1e-6),
    greatest(least(s.x / b.e, 1.0 - 1e-6), -1.0 + 1e-6) FROM bent b JOIN steps s ON s.series_id = b.series_id AND s.rn = b.rn + 1)""")
    + out("series_id", f"(SELECT *, e - coalesce(lag(e) OVER ({W}), 50.0) AS g FROM steps JOIN bent USING (series_id, rn))",
          strategy_return="r", pnl="g", equity_eur="e"),
    "decision_accuracy_h1": T + out(
        "series_id", "result", plain=("decision", "directional_correct", "accuracy_status", "pnl_positive"),
        **same("decision", "future_price_eur_mwh", "future_price_return", "directional_correct", "accuracy_status", "pnl_positive"),
    ),
    "decision_accuracy_h24": T + out(
        "series_id", "far", plain=("decision", "directional_correct", "accuracy_status"), decision="decision", future_price_eur_mwh="f24",
        future_price_return="r24", directional_correct="c24",
        accuracy_status="CASE WHEN f24 IS NULL THEN 'pending' WHEN c24 THEN 'correct' ELSE 'incorrect' END",
    ),
    "accuracy_summary": T + (
        f"SELECT series_id, count(f24) AS evaluable_rows, {rnd('coalesce(avg(c24::INT) FILTER (WHERE f24 IS NOT NULL), 0.0)')} AS directional_accuracy, "
        f"{rnd('coalesce(avg(pnl_positive::INT) FILTER (WHERE f24 IS NOT NULL), 0.0)')} AS pnl_positive_rate, "
        "count(*) FILTER (WHERE f24 IS NOT NULL AND c24) AS correct_count, count(*) FILTER (WHERE f24 IS NOT NULL AND NOT c24) AS incorrect_count, "
        "count(*) FILTER (WHERE f24 IS NULL) AS pending_count, "
        + ", ".join(f"count(*) FILTER (WHERE decision = '{d}') AS {d.lower()}_count" for d in ("LONG", "SHORT", "HOLD")) + " FROM far GROUP BY 1"
    ),
    "backtest_metrics": T + out(
        "series_id, strategy_name, trade_count, drawdown_duration_steps", "metrics", 3, ts=False,
        **same("sharpe_ratio", "max_drawdown", "hit_rate", "total_pnl", "average_trade_return", "directional_accuracy", "pnl_positive_rate",
               "gross_pnl_eur", "net_pnl_eur", "spread_cost_eur", "slippage_cost_eur", "delay_cost_eur", "opportunity_cost_proxy_eur"),
    ),
    "strategy_leaderboard": T + out(
        "series_id, strategy_name", "metrics", 3, ts=False, plain=("rank",),
        rank="row_number() OVER (PARTITION BY series_id ORDER BY sharpe_ratio DESC, total_pnl DESC, directional_accuracy DESC, strategy_name)",
        **same("sharpe_ratio", "total_pnl", "directional_accuracy"),
    ),
    "pnl_attribution": T + ATTR,
    "signal_family_pnl": T + "SELECT series_id, " + ", ".join(
        f"{rnd(f'sum(position * fwd * abs(coalesce({f}_signal, 0.0)))', 2)} AS {f}_pnl" for f in ("forecast", "mean_reversion", "fundamental")
    ) + " FROM result GROUP BY 1",
    "return_decomposition": T + (
        "SELECT series_id, " + ", ".join(f"{rnd(e, 5)} AS {n}" for n, e in {
            "mean_return": "avg(strategy_return)", "return_volatility": "stddev_samp(strategy_return)", "hit_rate": "avg((strategy_return > 0)::INT)",
            "avg_win": "coalesce(avg(strategy_return) FILTER (WHERE strategy_return > 0), 0.0)",
            "avg_loss": "coalesce(avg(strategy_return) FILTER (WHERE strategy_return < 0), 0.0)",
            "annualized_sharpe": "coalesce(avg(strategy_return) / nullif(stddev_samp(strategy_return), 0.0) * sqrt(24.0), 0.0)",
        }.items())
        + f", {rnd('sum(transaction_cost_eur + spread_cost_eur + slippage_cost_eur + delay_cost_eur)', 2)} AS cost_drag_eur FROM result GROUP BY 1"
    ),
    "turnover_and_decisions": T + (
        f"SELECT series_id, {rnd('avg(turnover)')} AS mean_turnover, {rnd('max(turnover)')} AS max_turnover, {rnd('sum(turnover)')} AS total_turnover, "
        + ", ".join(f"count(*) FILTER (WHERE decision = '{d}') AS {d.lower()}_count" for d in ("LONG", "SHORT", "HOLD")) + " FROM result GROUP BY 1"
    ),
    "backtest_analytics": T + (
        "SELECT series_id, count(*) AS row_count, count(*) FILTER (WHERE decision = 'LONG') AS long_count, "
        + ", ".join(f"{rnd(e, 3)} AS {n}" for n, e in {
            "final_equity": "arg_max(equity_eur, rn) / 10000.0", "cumulative_return": "arg_max(equity_eur, rn) / 10000.0 - 1.0",
            "spread_cost_eur": "sum(spread_cost_eur)", "hit_rate": "avg((strategy_return > 0)::INT)",
            "forecast_pnl": "sum(position * fwd * abs(coalesce(forecast_signal, 0.0)))",
        }.items())
        + ", count(*) FILTER (WHERE next_price IS NULL) AS pending_count FROM result GROUP BY 1"
    ),
    "trade_counts": T + "SELECT series_id, count(*) FILTER (WHERE turnover > 1e-6) AS trade_count, count(*) FILTER (WHERE decision <> 'HOLD') AS label_count FROM result GROUP BY 1",
    "price_moves": B + out("series_id", MOVES, **{P: P, "price_change_eur_mwh": "mv", "price_return": "rt"}),
    # significance
    "bootstrap_ci": with_(BASE, MARKET, TRADES, draws(250, STRATEGIES, WIDE)) + CI,
    "paired_significance": with_(BASE, MARKET, TRADES, draws(250, STRATEGIES, WIDE)) + PAIRS,
    "poisson_bootstrap_ci": with_(BASE, MARKET, TRADES, poisson(250, STRATEGIES, WIDE)) + CI,
    "bootstrap_prices": with_(BASE, draws(250, ("own",), f"SELECT series_id, row_number() OVER ({W}) - 1 AS rn0, mv AS own FROM {MOVES}"))
    + f"SELECT series_id, {rnd('any_value(s)')} AS sharpe, {rnd('quantile_cont(sh_own, 0.025)')} AS ci_lower, {rnd('quantile_cont(sh_own, 0.975)')} AS ci_upper "
    "FROM boot JOIN (SELECT series_id, avg(own) / stddev_samp(own) * sqrt(24.0) AS s FROM streams GROUP BY 1) USING (series_id) GROUP BY 1",
    "compared_streams": with_(
        BASE, draws(250, ("a", "b"), f"SELECT series_id, row_number() OVER ({W}) - 1 AS rn0, coalesce({P} - {DA}, 0.0) AS a, coalesce({R}, 0.0) AS b FROM clean")
    ) + pair("a", "b", "", 4),
    # forecasting
    "walk_forward_folds": with_(BASE, FOLDS) + "SELECT series_id, fold::BIGINT AS fold, (fold * 168)::BIGINT AS train_start, (fold * 168 + w)::BIGINT AS train_end, "
    "(fold * 168 + w)::BIGINT AS test_start, (fold * 168 + w + 168)::BIGINT AS test_end FROM folds",
    "first_train_rows": with_(BASE, FOLDS) + "SELECT series_id, n AS rows, greatest(least(336, CASE WHEN n > 168 THEN n - 168 ELSE n END), 2)::BIGINT AS fit_rows FROM lens",
    "fold_assignment": with_(BASE, FOLDS) + out(
        "series_id", f"(SELECT {K}, row_number() OVER ({W}) - 1 AS i FROM clean) JOIN folds USING (series_id) WHERE i >= fold * 168 AND i < fold * 168 + w + 168",
        plain=("row_number", "fold", "role"), row_number="i", fold="fold::BIGINT", role="CASE WHEN i < fold * 168 + w THEN 'train' ELSE 'test' END",
    ),
    "correlation_pairs": B + " UNION ALL ".join(
        f"SELECT series_id, '{a}' AS \"left\", '{b}' AS \"right\", {rnd(f'corr({a}, {b})', 6)} AS corr FROM clean GROUP BY 1"
        for i, a in enumerate((*PANEL, SP)) for b in (*PANEL, SP)[i + 1 :]
    ),
    "forecast_errors": B + "SELECT series_id, " + ", ".join(
        f"{rnd(f'avg(abs({p} - {a}))')} AS {a}_mae, {rnd(f'sqrt(avg(({p} - {a}) * ({p} - {a})))')} AS {a}_rmse" for p, a in zip(PREDS, (P, D, R))
    ) + " FROM scored GROUP BY 1",
    "error_by_price_regime": B + (
        f"SELECT series_id, CASE WHEN {P} >= mid THEN 'high_price' ELSE 'low_price' END AS price_regime, {rnd(f'avg({ERR})')} AS mean_error, "
        f"{rnd(f'quantile_cont({ERR}, 0.5)')} AS median_error, {rnd(f'stddev_samp({ERR})')} AS std_error, count({ERR}) AS n FROM scored "
        f"JOIN (SELECT series_id, quantile_cont({P}, 0.5) AS mid FROM scored GROUP BY 1) USING (series_id) GROUP BY 1, 2"
    ),
    "error_by_hour": B + f"SELECT series_id, hour(timestamp_utc) AS hour, {rnd(f'avg(abs({ERR}))')} AS mean_abs_error, {rnd(f'max(abs({ERR}))')} AS max_abs_error, "
    f"count({ERR}) AS n FROM scored GROUP BY 1, 2",
    "error_by_vol_regime": with_(BASE, f"""
dv0 AS (SELECT *, {P} - {lag(P)} AS dp FROM scored), dv1 AS (SELECT *, {std('dp', 24, 6)} AS v0 FROM dv0),
dv AS (SELECT *, {ffill('v0')} AS v FROM dv1),
cut AS (SELECT series_id, coalesce(quantile_cont(v, 0.7), 0.0) AS c FROM dv GROUP BY 1)""") + (
        f"SELECT series_id, CASE WHEN coalesce(v > c, false) THEN 'high_vol' ELSE 'low_vol' END AS vol_regime, {rnd(f'avg(abs({ERR}))')} AS mean_abs_error, "
        f"{rnd(f'quantile_cont(abs({ERR}), 0.5)')} AS median_abs_error, count({ERR}) AS n FROM dv JOIN cut USING (series_id) GROUP BY 1, 2"
    ),
    "full_sample_zscore": B + out("series_id", f"clean JOIN (SELECT series_id, avg({P}) AS m, stddev_samp({P}) AS s FROM clean GROUP BY 1) USING (series_id)",
                                  **{P: P, "z": f"CASE WHEN s IS NULL OR s < 1e-6 THEN 0.0 ELSE ({P} - m) / s END"}),
    # review
    "rolling_accuracy": T + out("series_id", "result", rolling_directional_accuracy=f"avg(directional_correct::INT) OVER {frame(11)}",
                                rolling_pnl_positive_rate=f"avg(pnl_positive::INT) OVER {frame(11)}"),
    "latest_signal": T + out(
        "series_id", f"result QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY timestamp_utc DESC) = 1", 3,
        plain=("recommended_action", "position_label"), recommended_action="target_decision", expected_price_change_eur_mwh=f"{PREDS[0]} - {P}",
        expected_price_change_pct=f"CASE WHEN {P} = 0 THEN 0.0 ELSE ({PREDS[0]} - {P}) / {P} END", pred_imbalance_mw="imb", position_label="decision",
        rolling_volatility="vol", **same(PREDS[0], P, "position", "price_trend", "signal_z_score"),
    ).replace(f"strftime(timestamp_utc, {DATE}) AS timestamp_utc", f"strftime(result.timestamp_utc, {DATE}) AS timestamp_utc")
    .replace("ORDER BY timestamp_utc DESC", "ORDER BY result.timestamp_utc DESC"),
    "decision_log": T + out(
        "series_id", "result", plain=("decision", "directional_correct", "accuracy_status", "pnl_positive"),
        future_price_change_eur_mwh=f"next_price - {P}",
        **same("decision", PREDS[0], P, "future_price_return", "directional_correct", "accuracy_status", "pnl", "pnl_positive"),
    ),
    "decision_log_dates": T + out("series_id", "result WHERE result.timestamp_utc >= TIMESTAMP '2024-01-10' AND result.timestamp_utc < TIMESTAMP '2024-01-13'",
                                  plain=("decision",), **same("decision", "pnl")),
    "last_rows_chart": B + out("series_id", "(SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY timestamp_utc DESC) AS back FROM clean) WHERE back <= 300",
                               **{P: P, "demand_mw": f"{D} / 1000.0", R: R}),
    "decision_events": T + EVENT,
    "largest_moves": B + out("series_id", f"(SELECT * FROM {MOVES} ORDER BY abs(mv) DESC NULLS LAST, series_id || ' ' || timestamp_utc::VARCHAR LIMIT 20)",
                             price_change_eur_mwh="mv"),
    # sinks and streams: the same rows as the batch
    "panel_round_trip": B + out("series_id", "panel", plain=("cache_version",), **{P: P, D: D, "cache_version": "1::BIGINT"}),
    "scored_csv_round_trip": B + out("series_id", "scored", **same(P, PREDS[0])),
    "decision_log_json": T + EVENT,
    "streaming_decision_log": T + EVENT,
    "streaming_rollup": B + f"SELECT series_id, strftime(h, {DATE}) AS timestamp_utc, {rnd('avg(value)')} AS value FROM ev GROUP BY series_id, h",
    "streaming_windows": B + f"SELECT series_id, strftime(e, {DATE}) AS timestamp_utc, {rnd('avg(value)')} AS value_mean_24h, "
    f"{rnd('stddev_samp(value)')} AS value_std_24h, count(value) AS n FROM "
    "(SELECT *, unnest(generate_series(h + INTERVAL 1 HOUR, h + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS e FROM ev) GROUP BY series_id, e",
    "streaming_dedupe": B + f"SELECT DISTINCT series_id, strftime(h, {DATE}) AS timestamp_utc FROM ev",
    "immediate_execution": with_(BASE, MARKET, AT_ONCE)
    + out("series_id", "result", **same("position", "turnover", "delay_cost_eur", "net_pnl_eur", "equity_eur")),
    "streaming_ramp": with_(BASE, MARKET, TRADES, f"""
ramp_rows AS (
  SELECT series_id, timestamp_utc, target_position_constrained, row_number() OVER ({W}) AS k,
    coalesce(p2 * ({P} - lag({P}) OVER ({W})), 0.0) AS earned FROM result),
gross(series_id, k, e) AS (
  SELECT DISTINCT series_id, 0::BIGINT, 10000.0::DOUBLE FROM ramp_rows
  UNION ALL
  SELECT g.series_id, r.k, greatest(g.e * (1.0 + greatest(least(r.earned / g.e, 1.0 - 1e-6), -1.0 + 1e-6)), 1e-6)
  FROM gross g JOIN ramp_rows r ON r.series_id = g.series_id AND r.k = g.k + 1)""")
    + out("series_id", "ramp_rows JOIN gross USING (series_id, k)", plain=("late",), position_after="target_position_constrained",
          gross_equity_eur="e", late="false"),
    "streaming_upsert": B + f"SELECT series_id, strftime(timestamp_utc, {DATE}) AS timestamp_utc, {rnd(P)} AS {P}, data_quality, event_id FROM {best('cand')}",
    "versioned_panel": B + f"SELECT series_id, strftime(timestamp_utc, {DATE}) AS timestamp_utc, {rnd(P)} AS {P}, data_quality, event_id FROM {best('cand')}",
    "ranges_from_source": B + out("series_id", "panel", **same(*PANEL)),
    # flagship
    "gap_repaired_features": B + out("series_id", "clean", plain=("had_gap",), had_gap="had_gap", lag_1=lag(P), lag_24=lag(P, 24), mean_24=mean(P, 24, 24),
                                     std_24=std(P, 24, 24), **{P: P}),
}

"""SQL that states the queries of ``tidemill.queries`` independently, for DuckDB over the same tables."""

from __future__ import annotations

import json

#: Named parts of WITH clauses, each after those that it reads.
PARTS: dict[str, str] = {
    "trades": """SELECT date_trunc('week', l_shipdate) AS dt, p_type AS ticker, l_extendedprice / l_quantity AS px, l_quantity AS q, l_orderkey AS ok, l_linenumber AS ln
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY ticker, dt ORDER BY ok, ln, px, q) AS rn,
        row_number() OVER (PARTITION BY ticker, dt ORDER BY ok DESC, ln DESC, px DESC, q DESC) AS rd FROM trades""",
    "bars": """SELECT CAST(dt AS TIMESTAMP) AS date, ticker, max(CASE WHEN rn = 1 THEN px END) AS Open, max(px) AS High, min(px) AS Low,
        max(CASE WHEN rd = 1 THEN px END) AS Close, sum(q) AS Volume FROM numbered GROUP BY dt, ticker""",
    "calendar": "SELECT date FROM bars GROUP BY date HAVING count(*) = (SELECT count(DISTINCT ticker) FROM bars)",
    "panel": "SELECT bars.* FROM bars SEMI JOIN calendar ON bars.date = calendar.date",
    "rets": """SELECT *, Close / lag(Close) OVER w - 1 AS ret_1d, Close / lag(Close, 5) OVER w - 1 AS ret_5d, Close / lag(Close, 10) OVER w - 1 AS ret_10d,
        ln(Close) - ln(lag(Close) OVER w) AS log_ret,
        lead(Close, 1) OVER w / Close - 1 AS label_1d_fwd, lead(Close, 3) OVER w / Close - 1 AS label_3d_fwd, lead(Close, 5) OVER w / Close - 1 AS label_5d_fwd
        FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "feats": """SELECT *, CASE WHEN count(ret_1d) OVER f5 >= 5 THEN stddev_samp(ret_1d) OVER f5 END AS vol_5d,
        CASE WHEN count(ret_1d) OVER f20 >= 20 THEN stddev_samp(ret_1d) OVER f20 END AS vol_20d,
        CASE WHEN count(Close) OVER f5 >= 5 THEN Close / avg(Close) OVER f5 - 1 END AS dist_ma_5,
        CASE WHEN count(Close) OVER f20 >= 20 THEN Close / avg(Close) OVER f20 - 1 END AS dist_ma_20,
        CASE WHEN count(Volume) OVER f20 >= 20 THEN Volume / avg(Volume) OVER f20 END AS vol_ratio_20
        FROM rets WINDOW f5 AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING), f20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)""",
    "cal": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM calendar",
    "ks": "SELECT CAST(unnest(range(0, 200)) AS INTEGER) AS k",
    "windows": """SELECT k, CASE WHEN k = 0 THEN DATE '1995-01-15' ELSE CAST(DATE '1995-01-01' + to_months(3 * k) AS DATE) END AS a,
        CAST(DATE '1995-01-01' + to_months(3 * k + 12) AS DATE) - 1 AS b, CAST(DATE '1995-01-01' + to_months(3 * k + 12) AS DATE) AS c,
        CAST(DATE '1995-01-01' + to_months(3 * k + 15) AS DATE) - 1 AS d FROM ks""",
    "plan": """SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS fold_id, train_start, train_end, test_start, test_end FROM (
        SELECT k, min(CASE WHEN date >= a THEN date END) AS train_start, max(CASE WHEN date <= b THEN date END) AS train_end,
               min(CASE WHEN date >= c THEN date END) AS test_start, max(CASE WHEN date <= d THEN date END) AS test_end
        FROM windows, cal WHERE a <= (SELECT max(date) FROM cal) AND c <= (SELECT max(date) FROM cal) GROUP BY k)
        WHERE train_start <= train_end AND test_start <= test_end""",
    "cut": "SELECT p.*, e.pos AS end_pos, c.date AS label_cutoff FROM plan p JOIN cal e ON e.date = p.train_end LEFT JOIN cal c ON c.pos = e.pos - 1",
    # The position runs over each ticker, and over each ticker and fold.
    "z": """SELECT ticker, date, ret_1d, CASE WHEN count(Close) OVER f >= 20 THEN (Close - avg(Close) OVER f) / nullif(stddev_pop(Close) OVER f, 0) END AS z,
        row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM rets WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)""",
    "target": "SELECT *, coalesce(-sign(z) * least(floor(abs(z)), 4) * 0.25::DOUBLE, 0.0::DOUBLE) + 0.0::DOUBLE AS target_pos FROM z",
    "held": """SELECT ticker, rn, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, greatest(-0.25::DOUBLE, least(0.25::DOUBLE, target_pos)))) AS pos FROM target WHERE rn = 1
        UNION ALL SELECT t.ticker, t.rn, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, h.pos + greatest(-0.25::DOUBLE, least(0.25::DOUBLE, t.target_pos - h.pos))))
        FROM held h JOIN target t ON t.ticker = h.ticker AND t.rn = h.rn + 1""",
    "position": "SELECT t.*, h.pos FROM target t JOIN held h ON h.ticker = t.ticker AND h.rn = t.rn",
    "fz": """SELECT r.ticker, r.date, r.ret_1d / 500.0::DOUBLE AS ret_1d, p.*, CASE WHEN count(Close) OVER f >= 20 THEN (Close - avg(Close) OVER f) / nullif(stddev_pop(Close) OVER f, 0) END AS z,
        row_number() OVER (PARTITION BY r.ticker, fold_id ORDER BY r.date) AS rn
        FROM rets r JOIN plan p ON r.date BETWEEN p.train_start AND p.test_end WINDOW f AS (PARTITION BY r.ticker, fold_id ORDER BY r.date ROWS 19 PRECEDING)""",
    "ftarget": "SELECT *, coalesce(-sign(z) * least(floor(abs(z)), 4) * 0.25::DOUBLE, 0.0::DOUBLE) + 0.0::DOUBLE AS target_pos FROM fz",
    "fheld": """SELECT ticker, fold_id, rn, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, greatest(-0.25::DOUBLE, least(0.25::DOUBLE, target_pos)))) AS pos FROM ftarget WHERE rn = 1
        UNION ALL SELECT t.ticker, t.fold_id, t.rn, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, h.pos + greatest(-0.25::DOUBLE, least(0.25::DOUBLE, t.target_pos - h.pos))))
        FROM fheld h JOIN ftarget t ON t.ticker = h.ticker AND t.fold_id = h.fold_id AND t.rn = h.rn + 1""",
    "traded": """SELECT *, pos_lag * ret AS pnl_gross, turnover * 5.0::DOUBLE / 10000 AS cost, pos_lag * ret - turnover * 5.0::DOUBLE / 10000 AS pnl FROM (
        SELECT t.*, h.pos, coalesce(t.ret_1d, 0) AS ret, lag(h.pos, 1, 0.0::DOUBLE) OVER w AS pos_lag, coalesce(abs(h.pos - lag(h.pos) OVER w), 0) AS turnover
        FROM ftarget t JOIN fheld h ON h.ticker = t.ticker AND h.fold_id = t.fold_id AND h.rn = t.rn WINDOW w AS (PARTITION BY t.ticker, t.fold_id ORDER BY t.date))""",
    "detail": """SELECT *, sum(pnl) OVER w AS cum_pnl, product(1 + pnl) OVER w AS equity FROM traded WHERE date BETWEEN test_start AND test_end
        WINDOW w AS (PARTITION BY ticker, fold_id ORDER BY date ROWS UNBOUNDED PRECEDING)""",
    "curve": """SELECT *, equity / max(equity) OVER w - 1 AS drawdown FROM (
        SELECT ticker, date, pnl, product(1 + pnl) OVER w AS equity FROM (SELECT ticker, date, sum(pnl) AS pnl FROM detail GROUP BY ticker, date)
        WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)""",
    # Momentum: the five-bar return as a score, a five-hundredth of the capital held against the next bar.
    "pred": "SELECT date, ticker, ret_5d AS score, label_1d_fwd / 500.0::DOUBLE AS forward_ret FROM feats",
    "marked": """SELECT *, score IS NOT NULL AND forward_ret IS NOT NULL AS good, CASE WHEN score IS NOT NULL AND forward_ret IS NOT NULL THEN score END AS s FROM pred""",
    "placed": """SELECT *, count(s) OVER d AS n_valid_scores, coalesce(min(s) OVER d = max(s) OVER d, false) AS is_constant_score_day,
        row_number() OVER (PARTITION BY date ORDER BY good DESC, score DESC, ticker) AS l, row_number() OVER (PARTITION BY date ORDER BY good DESC, score ASC, ticker) AS sh
        FROM marked WINDOW d AS (PARTITION BY date)""",
    "weighted": """SELECT *, CASE WHEN good AND NOT is_constant_score_day AND sh <= least(2, n_valid_scores // 2) THEN -1.0::DOUBLE / least(2, n_valid_scores // 2)
        WHEN good AND NOT is_constant_score_day AND l <= least(2, n_valid_scores // 2) THEN 1.0::DOUBLE / least(2, n_valid_scores // 2) ELSE 0.0::DOUBLE END AS weight FROM placed""",
    "held_weights": """SELECT *, abs(weight - prev_weight) AS abs_weight_change, CASE WHEN weight <> 0 THEN weight * forward_ret ELSE 0 END AS contribution FROM (
        SELECT *, lag(weight, 1, 0.0::DOUBLE) OVER (PARTITION BY ticker ORDER BY date) AS prev_weight FROM weighted)""",
    "days": """SELECT *, portfolio_ret_gross - cost AS portfolio_ret_net FROM (
        SELECT date, sum(contribution) AS portfolio_ret_gross, 0.5::DOUBLE * sum(abs_weight_change) AS turnover, sum(abs(weight)) AS gross_exposure, sum(weight) AS net_exposure,
               count(*) FILTER (weight > 0) AS n_longs, count(*) FILTER (weight < 0) AS n_shorts, bool_or(is_constant_score_day) AS is_constant_score_day,
               CAST(max(n_valid_scores) AS BIGINT) AS n_valid_scores, 0.5::DOUBLE * sum(abs_weight_change) * 10.0::DOUBLE / 10000 AS cost FROM held_weights GROUP BY date)""",
    "daily": "SELECT *, product(1 + portfolio_ret_net) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM days",
    "pairs": "SELECT date, CASE WHEN good THEN score END AS a, CASE WHEN good THEN forward_ret END AS b FROM marked",
    "ranked": """SELECT *, CASE WHEN a IS NOT NULL THEN rank() OVER (PARTITION BY date, a IS NULL ORDER BY a) + (count(*) OVER (PARTITION BY date, a) - 1) / 2.0::DOUBLE END AS ra,
        CASE WHEN b IS NOT NULL THEN rank() OVER (PARTITION BY date, b IS NULL ORDER BY b) + (count(*) OVER (PARTITION BY date, b) - 1) / 2.0::DOUBLE END AS rb FROM pairs""",
    "ic": """SELECT date, count(a) AS n_assets,
        CASE WHEN count(a) >= 2 AND min(a) <> max(a) AND min(b) <> max(b) THEN covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0) END AS ic_pearson,
        CASE WHEN count(a) >= 2 AND min(a) <> max(a) AND min(b) <> max(b) THEN covar_pop(ra, rb) / nullif(sqrt(var_pop(ra) * var_pop(rb)), 0) END AS ic_spearman FROM ranked GROUP BY date""",
    "legs": """SELECT date, count(*) FILTER (weight > 0 AND forward_ret IS NOT NULL) AS n_longs, count(*) FILTER (weight < 0 AND forward_ret IS NOT NULL) AS n_shorts,
        avg(forward_ret) FILTER (weight > 0) AS long_mean_ret, avg(forward_ret) FILTER (weight < 0) AS short_mean_ret,
        avg(forward_ret) FILTER (weight > 0) - avg(forward_ret) FILTER (weight < 0) AS spread FROM held_weights GROUP BY date""",
    "bench": """SELECT *, product(1 + coalesce(eq_universe_return, 0)) OVER w AS eq_universe_equity, product(1 + coalesce(spy_return, 0)) OVER w AS spy_equity FROM (
        SELECT d.date, d.equity AS strategy_equity, m.eq_universe_return, m.spy_return FROM daily d LEFT JOIN (
            SELECT date, avg(forward_ret) AS eq_universe_return, avg(forward_ret) FILTER (ticker = (SELECT min(ticker) FROM pred)) AS spy_return FROM pred GROUP BY date) m ON m.date = d.date)
        WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)""",
    # The score with gaps: every seventh bar of a ticker is missing.
    "gaps": "SELECT date, ticker, CASE WHEN rn % 7 = 0 THEN NULL ELSE score END AS x, rn FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM pred)",
    "ema": """SELECT ticker, rn, x AS y, 1.0::DOUBLE AS w FROM gaps WHERE rn = 1
        UNION ALL SELECT g.ticker, g.rn, CASE WHEN g.x IS NULL THEN e.y WHEN e.y IS NULL THEN g.x ELSE (e.w * 0.5::DOUBLE * e.y + 0.5::DOUBLE * g.x) / (e.w * 0.5::DOUBLE + 0.5::DOUBLE) END,
               CASE WHEN g.x IS NULL THEN e.w * 0.5::DOUBLE ELSE 1.0::DOUBLE END FROM ema e JOIN gaps g ON g.ticker = e.ticker AND g.rn = e.rn + 1""",
    "uni": """SELECT fold_id, count(*) AS n, avg(ret_5d) AS mx, avg(label_1d_fwd) AS my, covar_pop(ret_5d, label_1d_fwd) AS cxy, var_pop(ret_5d) AS vx
        FROM rets r JOIN cut c ON r.date BETWEEN c.train_start AND c.label_cutoff WHERE ret_5d IS NOT NULL AND label_1d_fwd IS NOT NULL GROUP BY fold_id""",
    "ema5": """SELECT ticker, rn, x AS y, 1.0::DOUBLE AS w FROM gaps WHERE rn = 1
        UNION ALL SELECT g.ticker, g.rn, CASE WHEN g.x IS NULL THEN e.y WHEN e.y IS NULL THEN g.x ELSE (e.w * 2.0::DOUBLE / 3.0 * e.y + g.x / 3.0::DOUBLE) / (e.w * 2.0::DOUBLE / 3.0 + 1.0::DOUBLE / 3.0) END,
               CASE WHEN g.x IS NULL THEN e.w * 2.0::DOUBLE / 3.0 ELSE 1.0::DOUBLE END FROM ema5 e JOIN gaps g ON g.ticker = e.ticker AND g.rn = e.rn + 1""",
    "sources": """SELECT source_file, CAST(row_number() OVER (PARTITION BY source_file ORDER BY k) - 1 AS INTEGER) AS fold_id, train_start, train_end, test_start, test_end FROM (
        SELECT ticker || '.csv' AS source_file, k, min(CASE WHEN date >= a THEN date END) AS train_start, max(CASE WHEN date <= b THEN date END) AS train_end, min(CASE WHEN date >= c THEN date END) AS test_start, max(CASE WHEN date <= d THEN date END) AS test_end
        FROM windows, (SELECT *, max(date) OVER (PARTITION BY ticker) AS mx FROM bars) WHERE a <= mx AND c <= mx GROUP BY ticker, k) WHERE train_start <= train_end AND test_start <= test_end""",
    "uni_pred": """SELECT r.date, r.ticker, (u.my + u.n * u.cxy / (u.n * u.vx + 1.0::DOUBLE) * (r.ret_5d - u.mx)) / 500.0::DOUBLE AS score, r.label_1d_fwd / 500.0::DOUBLE AS forward_ret
        FROM rets r JOIN plan p ON r.date BETWEEN p.test_start AND p.test_end JOIN uni u ON u.fold_id = p.fold_id""",
}
READS: dict[str, tuple[str, ...]] = {
    "numbered": ("trades",), "bars": ("numbered",), "calendar": ("bars",), "panel": ("bars", "calendar"), "rets": ("panel",), "feats": ("rets",), "cal": ("calendar",), "windows": ("ks",), "plan": ("windows", "cal"),
    "cut": ("plan", "cal"), "z": ("rets",), "target": ("z",), "held": ("target",), "position": ("target", "held"), "fz": ("rets", "plan"), "ftarget": ("fz",), "fheld": ("ftarget",), "traded": ("ftarget", "fheld"), "detail": ("traded",),
    "curve": ("detail",), "pred": ("feats",), "marked": ("pred",), "placed": ("marked",), "weighted": ("placed",), "held_weights": ("weighted",), "days": ("held_weights",), "daily": ("days",), "pairs": ("marked",), "ranked": ("pairs",),
    "ic": ("ranked",), "legs": ("held_weights",), "bench": ("daily", "pred"), "gaps": ("pred",), "ema": ("gaps",), "uni": ("rets", "cut"),
    "ema5": ("gaps",), "sources": ("bars", "windows"), "uni_pred": ("rets", "plan", "uni"),
}


RECURSIVE = ("held", "fheld", "ema", "ema5")


def sql(select: str, *parts: str, more: dict[str, str] | None = None, swap: dict[str, str] | None = None) -> str:
    """``select`` after the parts that it names and all that these read; ``swap``: a part in another's place."""
    need: dict[str, None] = {}

    def visit(name: str) -> None:
        if swap and name in swap:
            visit(swap[name])
        else:
            for other in READS.get(name, ()):
                visit(other)
        need[name] = None

    for p in parts:
        visit(p)
    text = lambda n: f"SELECT * FROM {swap[n]}" if swap and n in swap else PARTS[n]
    body = [f"{n} AS ({PARTS[n]})" if n in RECURSIVE else f"{n} AS MATERIALIZED ({text(n)})" for n in need] + [f"{n} AS ({q})" for n, q in (more or {}).items()]
    return f"WITH RECURSIVE {', '.join(body)} {select}" if body else select


def rounded(*names: str, digits: int = 8) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0::DOUBLE AS {n.rsplit('.', 1)[-1]}" for n in names)


def stats(x: str, source: str, order: str = "date", keys: tuple[str, ...] = (), suffix: str = "", prefix: str = "") -> str:
    """Performance statistics of the returns ``x`` of ``source`` by keys."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    own = "".join(f"{k}, " for k in keys)
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    name = lambda n: f"{prefix}{n}{suffix}"
    return f"""SELECT {own}round(product(1 + x) - 1, 6) + 0.0::DOUBLE AS {name('total_return')},
        round(CASE WHEN product(1 + x) > 0 THEN pow(product(1 + x), 252.0::DOUBLE / count(x)) - 1 END, 6) + 0.0::DOUBLE AS {name('cagr')},
        round(CASE WHEN count(x) > 1 THEN stddev_pop(x) * sqrt(252.0::DOUBLE) END, 6) + 0.0::DOUBLE AS {name('ann_vol')},
        round(CASE WHEN count(x) > 1 AND stddev_pop(x) > 0 THEN avg(x) / stddev_pop(x) * sqrt(252.0::DOUBLE) END, 6) + 0.0::DOUBLE AS {name('sharpe')},
        round(CASE WHEN stddev_pop(CASE WHEN x < 0 THEN x END) > 0 THEN avg(x) * 252.0::DOUBLE / (stddev_pop(CASE WHEN x < 0 THEN x END) * sqrt(252.0::DOUBLE)) END, 6) + 0.0::DOUBLE AS {name('sortino')},
        round(min(dd), 6) + 0.0::DOUBLE AS {name('max_drawdown')}
        FROM (SELECT *, eq / max(eq) OVER ({part}ORDER BY {order} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM (
            SELECT {own}{order}, {x} AS x, product(1 + {x}) OVER ({part}ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS eq FROM {source} WHERE {x} IS NOT NULL)){group}"""


_FEATS = ("ret_1d", "ret_5d", "ret_10d", "vol_5d", "vol_20d", "dist_ma_5", "dist_ma_20", "vol_ratio_20")
_DAYS = "SELECT date, " + rounded("portfolio_ret_gross", "turnover", "gross_exposure", "net_exposure", "cost", "portfolio_ret_net") + ", n_longs, n_shorts, is_constant_score_day, n_valid_scores, " + rounded("equity", digits=6) + " FROM daily"
_SUMMARY = """SELECT g.total_return AS total_return_gross, n.total_return AS total_return_net, n.cagr AS cagr_net, n.ann_vol AS ann_vol_net, n.sharpe AS sharpe_net, n.sortino AS sortino_net,
    n.max_drawdown AS max_drawdown_net, r.* FROM g, n, (SELECT round(avg(turnover), 8) AS mean_turnover, round(avg(cost), 8) AS mean_cost, count(*) FILTER (gross_exposure > 0) AS n_traded_days FROM daily) r"""

ORACLE: dict[str, str] = {
    "momentum_net_performance": sql(_SUMMARY, "daily", more={"g": stats("portfolio_ret_gross", "daily"), "n": stats("portfolio_ret_net", "daily")}),
    "panel_bars": sql("SELECT date, ticker, " + rounded("Open", "High", "Low", "Close", "Volume") + " FROM panel", "panel"),
    "shared_calendar": sql("SELECT date FROM calendar", "calendar"),
    "calendar_positions": sql("SELECT date, CAST(pos AS INTEGER) AS pos FROM cal", "cal"),
    "dedupe_keep_first": """SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type""",
    "numeric_coercion": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS not_a_number FROM events",
    "date_range_filter": sql("SELECT date, ticker, " + rounded("Close") + " FROM panel WHERE date BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31'", "panel"),
    "union_by_name": sql("SELECT date, ticker, " + rounded("Close") + ", CAST(NULL AS DOUBLE) AS Volume FROM panel UNION ALL SELECT date, ticker, CAST(NULL AS DOUBLE), " + rounded("Volume") + " FROM panel", "panel"),
    "simple_log_returns": sql("SELECT date, ticker, round(ret_1d, 8) + 0.0::DOUBLE AS ret, round(log_ret, 8) + 0.0::DOUBLE AS log_ret FROM rets", "rets"),
    "features_returns": sql("SELECT date, ticker, " + rounded(*_FEATS[:3]) + " FROM feats", "feats"),
    "features_volatility": sql("SELECT date, ticker, " + rounded(*_FEATS[3:5]) + " FROM feats", "feats"),
    "features_ma_distance": sql("SELECT date, ticker, " + rounded(*_FEATS[5:7]) + " FROM feats", "feats"),
    "features_volume_ratio": sql("SELECT date, ticker, " + rounded(_FEATS[7]) + " FROM feats", "feats"),
    "forward_labels": sql("SELECT date, ticker, " + rounded("label_1d_fwd", "label_3d_fwd", "label_5d_fwd") + " FROM rets", "rets"),
    "global_wf_plan": sql("SELECT * FROM plan", "plan"),
    "per_source_wf_plan": sql(
        """SELECT ticker AS source_file, CAST(row_number() OVER (PARTITION BY ticker ORDER BY k) - 1 AS INTEGER) AS fold_id, train_start, train_end, test_start, test_end FROM (
        SELECT ticker, k, min(CASE WHEN date >= a THEN date END) AS train_start, max(CASE WHEN date <= b THEN date END) AS train_end, min(CASE WHEN date >= c THEN date END) AS test_start, max(CASE WHEN date <= d THEN date END) AS test_end
        FROM windows, (SELECT *, max(date) OVER (PARTITION BY ticker) AS mx FROM bars) WHERE a <= mx AND c <= mx GROUP BY ticker, k) WHERE train_start <= train_end AND test_start <= test_end""", "bars", "windows"),
    "fold_range_join": sql("SELECT fold_id, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, " + rounded("sum(Close)", digits=6).replace("AS sum(Close)", "AS close_sum") + " FROM panel JOIN plan ON date BETWEEN train_start AND test_end GROUP BY fold_id", "panel", "plan"),
    "label_purge_cutoff": sql("SELECT fold_id, train_end, label_cutoff FROM cut", "cut"),
    "asof_first_last_dates": sql("SELECT o_orderdate AS t, (SELECT min(date) FROM cal WHERE date >= o_orderdate) AS first_on_or_after, (SELECT max(date) FROM cal WHERE date <= o_orderdate) AS last_on_or_before FROM (SELECT DISTINCT o_orderdate FROM orders)", "cal"),
    "zscore_signal": sql("SELECT date, ticker, " + rounded("z", digits=6) + " FROM z", "z"),
    "rung_target": sql("SELECT date, ticker, target_pos FROM target", "target"),
    "rate_limited_position": sql("SELECT date, ticker, target_pos, " + rounded("pos") + " FROM position", "position"),
    "wf_backtest_detail": sql("SELECT date, ticker, fold_id, target_pos, " + rounded("z", digits=6) + ", " + rounded("pos", "pos_lag", "ret", "pnl_gross", "turnover", "cost", "pnl", "cum_pnl") + ", " + rounded("equity", digits=6) + " FROM detail", "detail"),
    "backtest_logret": sql("""SELECT date, ticker, round(pnl, 8) + 0.0::DOUBLE AS pnl, round(CASE WHEN pnl IS NOT NULL THEN sum(pnl) OVER w END, 6) + 0.0::DOUBLE AS cum_pnl, round(CASE WHEN pnl IS NOT NULL THEN exp(sum(pnl) OVER w) END, 6) + 0.0::DOUBLE AS equity
        FROM (SELECT p.date, p.ticker, lag(p.pos) OVER (PARTITION BY p.ticker ORDER BY p.date) * (r.log_ret / 500.0::DOUBLE) AS pnl FROM position p JOIN rets r ON r.ticker = p.ticker AND r.date = p.date)
        WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)""", "position", "rets"),
    "fold_summary": sql("""SELECT ticker, fold_id, min(train_start) AS train_start, min(train_end) AS train_end, min(test_start) AS test_start, min(test_end) AS test_end, count(*) AS n_test_rows,
        round(product(1 + pnl) - 1, 6) + 0.0::DOUBLE AS total_return, round(min(dd), 6) + 0.0::DOUBLE AS max_drawdown, round(pow(product(1 + pnl), 252.0::DOUBLE / count(*)) - 1, 6) + 0.0::DOUBLE AS ann_return,
        round(CASE WHEN count(*) > 1 THEN stddev_pop(pnl) * sqrt(252.0::DOUBLE) END, 6) + 0.0::DOUBLE AS ann_vol, round(CASE WHEN count(*) > 1 AND stddev_pop(pnl) > 0 THEN avg(pnl) / stddev_pop(pnl) * sqrt(252.0::DOUBLE) END, 6) + 0.0::DOUBLE AS sharpe,
        round(CASE WHEN count(*) > 1 THEN avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) END, 6) + 0.0::DOUBLE AS win_rate
        FROM (SELECT *, equity / max(equity) OVER (PARTITION BY ticker, fold_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM detail) GROUP BY ticker, fold_id""", "detail"),
    "add_pnl": sql("SELECT date, ticker, " + rounded("pnl", digits=8) + ", round(2 * product(1 + pnl) OVER w, 6) + 0.0::DOUBLE AS equity, round(2 * product(1 + pnl) OVER w - 2, 6) + 0.0::DOUBLE AS cum_pnl FROM (SELECT date, ticker, coalesce(lag(pos) OVER (PARTITION BY ticker ORDER BY date), 0) * coalesce(ret_1d / 500.0::DOUBLE, 0) AS pnl FROM position) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)", "position"),
    "stitched_curve": sql("SELECT date, ticker, " + rounded("pnl", digits=8) + ", " + rounded("equity", "drawdown", digits=6) + " FROM curve", "curve"),
    "fold_local_curves": sql("SELECT date, ticker, fold_id, round(equity, 6) + 0.0::DOUBLE AS equity_local, round(equity / max(equity) OVER (PARTITION BY ticker, fold_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) + 0.0::DOUBLE AS dd_local FROM detail", "detail"),
    "rolling_sharpe": sql("SELECT date, ticker, round(CASE WHEN count(pnl) OVER f >= 21 THEN avg(pnl) OVER f / nullif(stddev_pop(pnl) OVER f, 0) * sqrt(252.0::DOUBLE) END, 5) + 0.0::DOUBLE AS rolling_sharpe FROM curve WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS 62 PRECEDING)", "curve"),
    "buy_hold_curve": sql("""SELECT date, ticker, round(pnl, 8) + 0.0::DOUBLE AS pnl, round(equity, 6) + 0.0::DOUBLE AS equity, round(equity / max(equity) OVER w - 1, 6) + 0.0::DOUBLE AS drawdown FROM (
        SELECT *, product(1 + pnl) OVER w AS equity FROM (SELECT ticker, date, sum(ret) AS pnl FROM detail GROUP BY ticker, date) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING))
        WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)""", "detail"),
    "perf_stats": sql(stats("pnl", "curve", keys=("ticker",)), "curve"),
    "sortino": sql("SELECT ticker, round(CASE WHEN stddev_pop(CASE WHEN ret_1d < 0.001 THEN ret_1d - 0.001::DOUBLE END) > 0 THEN avg(ret_1d - 0.001::DOUBLE) * 52.0::DOUBLE / (stddev_pop(CASE WHEN ret_1d < 0.001 THEN ret_1d - 0.001::DOUBLE END) * sqrt(52.0::DOUBLE)) END, 6) AS sortino FROM rets GROUP BY ticker", "rets"),
    "ols_univariate_wf": sql("SELECT r.date, r.ticker, p.fold_id, round(u.my - u.cxy / u.vx * u.mx + u.cxy / u.vx * r.ret_5d, 8) + 0.0::DOUBLE AS score FROM rets r JOIN plan p ON r.date BETWEEN p.test_start AND p.test_end JOIN uni u ON u.fold_id = p.fold_id", "rets", "plan", "uni"),
    "ridge_univariate_wf": sql("SELECT r.date, r.ticker, p.fold_id, round(u.my + u.n * u.cxy / (u.n * u.vx + 1.0::DOUBLE) * (r.ret_5d - u.mx), 8) + 0.0::DOUBLE AS score FROM rets r JOIN plan p ON r.date BETWEEN p.test_start AND p.test_end JOIN uni u ON u.fold_id = p.fold_id", "rets", "plan", "uni"),
    "lasso_univariate_wf": sql("SELECT r.date, r.ticker, p.fold_id, round(u.my + sign(u.cxy) * greatest(abs(u.cxy) - 0.0001::DOUBLE, 0) / u.vx * (r.ret_5d - u.mx), 8) + 0.0::DOUBLE AS score FROM rets r JOIN plan p ON r.date BETWEEN p.test_start AND p.test_end JOIN uni u ON u.fold_id = p.fold_id", "rets", "plan", "uni"),
    "elasticnet_univariate_wf": sql("SELECT r.date, r.ticker, p.fold_id, round(u.my + sign(u.cxy) * greatest(abs(u.cxy) - 0.00005::DOUBLE, 0) / (u.vx + 0.00005::DOUBLE) * (r.ret_5d - u.mx), 8) + 0.0::DOUBLE AS score FROM rets r JOIN plan p ON r.date BETWEEN p.test_start AND p.test_end JOIN uni u ON u.fold_id = p.fold_id", "rets", "plan", "uni"),
    "score_zscore": sql("SELECT date, ticker, round(CASE WHEN score IS NOT NULL THEN CASE WHEN stddev_pop(score) OVER d > 0 THEN (score - avg(score) OVER d) / stddev_pop(score) OVER d ELSE 0 END END, 6) + 0.0::DOUBLE AS score_signal FROM pred WINDOW d AS (PARTITION BY date)", "pred"),
    "score_rank": sql("SELECT date, ticker, round(CASE WHEN score IS NOT NULL THEN CASE WHEN count(score) OVER d > 1 THEN 2.0::DOUBLE * (rank() OVER (PARTITION BY date, score IS NULL ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0::DOUBLE - 1) / (count(score) OVER d - 1) - 1 ELSE 0 END END, 6) + 0.0::DOUBLE AS score_signal FROM pred WINDOW d AS (PARTITION BY date)", "pred"),
    "score_ema": sql("SELECT g.date, g.ticker, round(CASE WHEN g.x IS NOT NULL THEN e.y END, 8) + 0.0::DOUBLE AS score_smoothed FROM gaps g JOIN ema e ON e.ticker = g.ticker AND e.rn = g.rn", "gaps", "ema"),
    "top_bottom_weights": sql("SELECT date, ticker, " + rounded("weight", "prev_weight", "abs_weight_change", "contribution") + ", is_constant_score_day, n_valid_scores FROM held_weights", "held_weights"),
    "portfolio_daily": sql(_DAYS, "daily"),
    "ticker_selection": sql("SELECT ticker, count(*) FILTER (weight > 0) AS n_long_days, count(*) FILTER (weight < 0) AS n_short_days, round(avg(score), 8) AS avg_score, round(avg(forward_ret) FILTER (weight > 0), 8) AS avg_forward_return_when_long, round(avg(forward_ret) FILTER (weight < 0), 8) AS avg_forward_return_when_short, round(avg(contribution), 8) AS mean_contribution, round(sum(contribution), 6) AS total_contribution, round(avg(abs(weight)) FILTER (weight <> 0), 8) AS avg_weight_when_selected, round(count(*) FILTER (weight > 0) / (SELECT count(DISTINCT date) FROM held_weights), 8) AS selection_rate_long, round(count(*) FILTER (weight < 0) / (SELECT count(DISTINCT date) FROM held_weights), 8) AS selection_rate_short FROM held_weights GROUP BY ticker", "held_weights"),
    "daily_ic": sql("SELECT date, n_assets, " + rounded("ic_pearson", "ic_spearman", digits=6) + " FROM ic", "ic"),
    "ic_summary": sql("SELECT round(avg(ic_pearson), 6) AS mean_ic, round(stddev_pop(ic_pearson), 6) AS ic_std, round(avg(ic_pearson) / nullif(stddev_pop(ic_pearson), 0), 6) AS ic_ir, count(ic_pearson) AS n_ic_days FROM ic", "ic"),
    "long_short_spread": sql("SELECT date, n_longs, n_shorts, " + rounded("long_mean_ret", "short_mean_ret", "spread") + " FROM legs", "legs"),
    "spread_summary": sql("SELECT round(avg(spread), 8) AS mean_spread, round(stddev_pop(spread), 8) AS spread_std, count(spread) AS n_spread_days FROM legs", "legs"),
    "portfolio_perf_summary": sql(_SUMMARY, "daily", more={"g": stats("portfolio_ret_gross", "daily"), "n": stats("portfolio_ret_net", "daily")}),
    "benchmark_curves": sql("SELECT date, " + rounded("strategy_equity", "eq_universe_equity", "spy_equity", digits=6) + ", " + rounded("eq_universe_return", "spy_return") + " FROM bench", "bench"),
    "benchmark_perf": sql("SELECT * EXCLUDE (eq_universe_sortino) FROM (" + stats("coalesce(eq_universe_return, 0)", "bench", prefix="eq_universe_") + ")", "bench"),
    "strategy_minus_benchmark": sql("SELECT round(a.total_return - b.total_return, 6) + 0.0::DOUBLE AS strategy_minus_eq_universe_total_return FROM a, b", "bench", more={"a": "SELECT product(1 + portfolio_ret_net) - 1 AS total_return FROM daily", "b": "SELECT product(1 + coalesce(eq_universe_return, 0)) - 1 AS total_return FROM bench"}),
    "champion_by_metric": """WITH r AS (SELECT o_orderpriority AS run_name, CASE WHEN o_custkey % 3 = 0 THEN 'ablation' WHEN o_custkey % 3 = 1 THEN 'single_run' ELSE 'strategy_ablation' END AS run_type, CAST(o_orderkey AS VARCHAR) AS experiment_name, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS timestamp, o_orderdate AS t,
        o_totalprice AS sharpe_net, CAST(o_custkey % 1013 AS DOUBLE) AS sortino_net, CAST(o_orderkey % 97 AS DOUBLE) AS mean_ic FROM orders),
        m AS (SELECT *, 'sharpe_net' AS champion_metric, sharpe_net AS champion_value FROM r UNION ALL SELECT *, 'sortino_net', sortino_net FROM r UNION ALL SELECT *, 'mean_ic', mean_ic FROM r)
        SELECT champion_metric, champion_value, run_name, run_type, experiment_name, timestamp FROM m WHERE run_type IN ('single_run', 'strategy_ablation')
        QUALIFY row_number() OVER (PARTITION BY champion_metric ORDER BY champion_value DESC, t DESC, run_name, experiment_name) = 1""",
    "rolling_ic": sql("SELECT date, " + rounded("ic_pearson", digits=6) + ", round(CASE WHEN count(ic_pearson) OVER f >= 6 THEN avg(ic_pearson) OVER f END, 6) + 0.0::DOUBLE AS rolling_ic FROM ic WINDOW f AS (ORDER BY date ROWS 19 PRECEDING)", "ic"),
    "cumulative_legs": sql("SELECT date, round(product(1 + coalesce(long_mean_ret, 0)) OVER w, 6) + 0.0::DOUBLE AS long_curve, round(product(1 + coalesce(short_mean_ret, 0)) OVER w, 6) + 0.0::DOUBLE AS short_curve, round(product(1 + coalesce(spread, 0)) OVER w, 6) + 0.0::DOUBLE AS spread_curve FROM legs WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)", "legs"),
    "spec_grid": "SELECT CAST(h AS INTEGER) AS horizon, CAST(k AS INTEGER) AS k, n AS normalization, s AS smoothing, concat('h', h, '__k', k, '__norm_', n, '__smooth_', s) AS experiment_name FROM (SELECT unnest([1, 3, 5]) AS h), (SELECT unnest([2, 3, 4]) AS k), (SELECT unnest(['none', 'zscore', 'rank_to_minus1_plus1']) AS n), (SELECT unnest(['none', 'ema_3']) AS s)",
}

_BARS = "date, ticker, " + rounded("Open", "High", "Low", "Close", "Volume")
_SELECTION = "SELECT ticker, round(sum(contribution), 6) + 0.0::DOUBLE AS total_contribution FROM held_weights GROUP BY ticker ORDER BY 2 {}, 1 LIMIT 5"

ORACLE |= {
    "csv_price_scan": sql("SELECT date, " + rounded("Open", "High", "Low", "Close", "Volume") + " FROM bars WHERE ticker = (SELECT min(ticker) FROM bars)", "bars"),
    "csv_panel_scan": sql(f"SELECT {_BARS} FROM panel", "panel"),
    "csv_panel_all_dates": sql(f"SELECT {_BARS} FROM bars", "bars"),
    "csv_dates": sql("SELECT ticker || '.csv' AS source_file, date FROM bars", "bars"),
    "csv_plan_round_trip": sql("SELECT * FROM sources", "sources"),
    "adjusted_returns": sql("""SELECT date, ticker, round(p / lag(p) OVER w - 1, 8) + 0.0::DOUBLE AS ret, round(ln(p) - ln(lag(p) OVER w), 8) + 0.0::DOUBLE AS log_ret
        FROM (SELECT date, ticker, Close * 0.5::DOUBLE + 1 AS p FROM panel) WINDOW w AS (PARTITION BY ticker ORDER BY date)""", "panel"),
    "return_fill_in": sql("SELECT date, ticker, round(Volume / 1000, 8) + 0.0::DOUBLE AS ret, round(log_ret, 8) + 0.0::DOUBLE AS log_ret FROM rets", "rets"),
    "source_backtest": sql("SELECT date, ticker, 'bars.csv' AS source_file, fold_id, " + rounded("pnl") + " FROM detail", "detail"),
    "experiment_summary": sql("""SELECT (SELECT count(*) FROM plan) AS n_folds, p.*, d.*, i.*, l.*, s.* FROM
        (SELECT count(*) AS n_prediction_rows, count(score) AS n_scored_rows, count(DISTINCT ticker) AS n_tickers FROM pred) p,
        (SELECT count(*) AS n_portfolio_days, count(*) FILTER (is_constant_score_day) AS n_constant_score_days FROM daily) d,
        (SELECT round(avg(ic_pearson), 6) + 0.0::DOUBLE AS mean_ic, round(stddev_pop(ic_pearson), 6) + 0.0::DOUBLE AS ic_std, round(avg(ic_pearson) / nullif(stddev_pop(ic_pearson), 0), 6) + 0.0::DOUBLE AS ic_ir, count(ic_pearson) AS n_ic_days FROM ic) i,
        (SELECT round(avg(spread), 6) + 0.0::DOUBLE AS mean_spread, round(stddev_pop(spread), 6) + 0.0::DOUBLE AS spread_std, count(spread) AS n_spread_days FROM legs) l,
        (""" + _SUMMARY + ") s", "plan", "daily", "ic", "legs", swap={"pred": "uni_pred"}, more={"g": stats("portfolio_ret_gross", "daily"), "n": stats("portfolio_ret_net", "daily")}),
    "strategy_minus_spy": sql("SELECT round(a.total_return - b.total_return, 6) + 0.0::DOUBLE AS strategy_minus_spy_total_return FROM a, b", "bench", more={"a": "SELECT product(1 + portfolio_ret_net) - 1 AS total_return FROM daily", "b": "SELECT product(1 + coalesce(spy_return, 0)) - 1 AS total_return FROM bench"}),
    "curves_compared": sql("SELECT date, round(strategy_equity, 6) + 0.0::DOUBLE AS strategy, round(spy_equity, 6) + 0.0::DOUBLE AS benchmark FROM bench WHERE spy_return IS NOT NULL", "bench"),
    "drawdown_curve": sql("SELECT date, round(equity / max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) + 0.0::DOUBLE AS drawdown FROM daily", "daily"),
    "score_ema_5": sql("SELECT g.date, g.ticker, round(CASE WHEN g.x IS NOT NULL THEN e.y END, 8) + 0.0::DOUBLE AS score_smoothed FROM gaps g JOIN ema5 e ON e.ticker = g.ticker AND e.rn = g.rn", "gaps", "ema5"),
    "prepared_scores": sql("""SELECT date, ticker, round(CASE WHEN y IS NOT NULL THEN CASE WHEN stddev_pop(y) OVER d > 0 THEN (y - avg(y) OVER d) / stddev_pop(y) OVER d ELSE 0 END END, 6) + 0.0::DOUBLE AS score_signal
        FROM (SELECT g.date, g.ticker, CASE WHEN g.x IS NOT NULL THEN e.y END AS y FROM gaps g JOIN ema e ON e.ticker = g.ticker AND e.rn = g.rn) WINDOW d AS (PARTITION BY date)""", "gaps", "ema"),
    "model_specs": """SELECT 'linear' AS experiment_name, 'linear' AS model_name, CAST(NULL AS DOUBLE) AS alpha, CAST(NULL AS DOUBLE) AS l1_ratio
        UNION ALL SELECT 'ridge__alpha_' || a, 'ridge', CAST(a AS DOUBLE), NULL FROM (SELECT unnest(['0.1', '1', '10']) AS a)
        UNION ALL SELECT 'lasso__alpha_' || a, 'lasso', CAST(a AS DOUBLE), NULL FROM (SELECT unnest(['0.0001', '0.001', '0.01']) AS a)
        UNION ALL SELECT 'elasticnet__alpha_' || a || '__l1_ratio_' || l, 'elasticnet', CAST(a AS DOUBLE), CAST(l AS DOUBLE) FROM (SELECT unnest(['0.0001', '0.001']) AS a), (SELECT unnest(['0.25', '0.5', '0.75']) AS l)""",
    "sweep_specs": "SELECT CAST(n AS INTEGER) AS n, CAST(s AS DOUBLE) AS step_frac FROM (SELECT unnest([10, 20, 40]) AS n), (SELECT unnest([0.25, 0.5]) AS s)",
    "best_tickers": sql(_SELECTION.format("DESC"), "held_weights"),
    "worst_tickers": sql(_SELECTION.format("ASC"), "held_weights"),
}

_KNOWN = " AND ".join(f"{f} IS NOT NULL" for f in _FEATS)
_SWEEPS = 250  # of coordinate descent; 80 (sf0.01) to 192 (sf0.001) are enough for changes below 1e-12


def fitted(name: str, model: str, *, alpha: float = 0.0, l1_ratio: float = 1.0, horizon: int = 1, share: float = 1.0) -> dict[str, str]:
    """Parts w_<name>: (fold_id, mx, my, w), the weights of all folds by the normal equations or by coordinate descent."""
    y, cols = f"(label_{horizon}d_fwd / {share}::DOUBLE)", ", ".join
    cut = f"SELECT p.*, c.date AS label_cutoff FROM plan p JOIN cal e ON e.date = p.train_end JOIN cal c ON c.pos = e.pos - {horizon}"
    moments = f"""SELECT fold_id, CAST(count(*) AS DOUBLE) AS n, [{cols(f'avg({f})' for f in _FEATS)}] AS mx, avg({y}) AS my, [{cols('[' + cols(f'covar_pop({f}, {g})' for g in _FEATS) + ']' for f in _FEATS)}] AS a,
        [{cols(f'covar_pop({f}, {y})' for f in _FEATS)}] AS b FROM feats r JOIN ({cut}) c ON r.date BETWEEN c.train_start AND c.label_cutoff WHERE {_KNOWN} AND {y} IS NOT NULL GROUP BY fold_id"""
    if model in ("linear", "ridge"):  # Gauss-Jordan steps
        steps = f"""SELECT fold_id, mx, my, 1 AS k, list_transform(a, lambda r, i: list_append(list_transform(r, lambda x, j: n * x + CASE WHEN i = j THEN {alpha}::DOUBLE ELSE 0 END), n * b[i])) AS m FROM mom_{name}
            UNION ALL SELECT fold_id, mx, my, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / m[k][k]) ELSE list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) END) FROM fit_{name} WHERE k <= 8"""
        return {f"mom_{name}": moments, f"fit_{name}": steps, f"w_{name}": f"SELECT fold_id, mx, my, list_transform(m, lambda r: r[9]) AS w FROM fit_{name} WHERE k = 9"}
    l1, l2, r = alpha * l1_ratio, alpha * (1 - l1_ratio), "(b[i] - list_dot_product(a[i], w) + a[i][i] * x)"
    steps = f"""SELECT fold_id, mx, my, a, b, 0 AS t, list_transform(b, lambda x: 0.0::DOUBLE) AS w FROM mom_{name}
        UNION ALL SELECT fold_id, mx, my, a, b, t + 1, list_transform(w, lambda x, i: CASE WHEN i = t % 8 + 1 THEN sign({r}) * greatest(abs({r}) - {l1}::DOUBLE, 0) / (a[i][i] + {l2}::DOUBLE) ELSE x END) FROM fit_{name} WHERE t < {8 * _SWEEPS}"""
    return {f"mom_{name}": moments, f"fit_{name}": steps, f"w_{name}": f"SELECT fold_id, mx, my, w FROM fit_{name} WHERE t = {8 * _SWEEPS}"}


def scored(name: str, more: str = "") -> str:
    """Test rows with the scores of w_<name>."""
    score = f"CASE WHEN {_KNOWN} THEN my - list_dot_product(w, mx) + list_dot_product(w, [{', '.join(_FEATS)}]) END"
    return f"SELECT {more}r.date, r.ticker, p.fold_id, {score} AS score FROM feats r JOIN plan p ON r.date BETWEEN p.test_start AND p.test_end JOIN w_{name} u ON u.fold_id = p.fold_id"


def keyed(part: str) -> str:
    """A part of the portfolio's chain for many experiments at once, told by ``spec``, with k of its own."""
    changes = {"PARTITION BY date": "PARTITION BY spec, date", "PARTITION BY ticker": "PARTITION BY spec, ticker", "GROUP BY date": "GROUP BY spec, date", "SELECT date,": "SELECT spec, date,", "OVER (ORDER BY": "OVER (PARTITION BY spec ORDER BY", "least(2,": "least(k,"}
    text = PARTS[part]
    for old, new in changes.items():
        text = text.replace(old, new)
    return text


def grid(specs: str, pred: str, parts: dict[str, str], columns: str) -> str:
    """The summary of each of specs (spec, k, ...); pred: (spec, k, date, ticker, score, forward_ret)."""
    more = {**parts, "specs": specs, "pred": pred, **{p: keyed(p) for p in ("marked", "placed", "weighted", "held_weights", "days", "daily", "pairs", "legs")}}
    more["ic"] = """SELECT spec, date, CASE WHEN count(a) >= 2 AND min(a) <> max(a) AND min(b) <> max(b) THEN covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0) END AS ic_pearson FROM pairs GROUP BY spec, date"""
    more["net"] = stats("portfolio_ret_net", "daily", keys=("spec",), suffix="_net")
    more["rest"] = "SELECT spec, count(*) FILTER (gross_exposure > 0) AS n_traded_days, count(*) FILTER (is_constant_score_day) AS n_constant_score_days, avg(turnover) AS mean_turnover FROM daily GROUP BY spec"
    more["ics"] = "SELECT spec, avg(ic_pearson) AS mean_ic, avg(ic_pearson) / nullif(stddev_pop(ic_pearson), 0) AS ic_ir FROM ic GROUP BY spec"
    more["spreads"] = "SELECT spec, avg(spread) AS mean_spread FROM legs GROUP BY spec"
    more["held_tickers"] = "SELECT spec, count(DISTINCT ticker) AS n_tickers FROM pred GROUP BY spec"
    joined = " ".join(f"JOIN {t} USING (spec)" for t in ("held_tickers", "rest", "ics", "spreads", "net"))
    return sql(f"SELECT {columns} FROM specs {joined}", "feats", "plan", "cal", more=more)


_MEASURES = "n_tickers, n_traded_days, n_constant_score_days, " + rounded("mean_ic", "mean_spread", "mean_turnover", digits=6) + ", total_return_net, sharpe_net, sortino_net, max_drawdown_net"
_MODELS = [("linear", {}), *(("ridge", {"alpha": a}) for a in (0.1, 1.0, 10.0)), *(("lasso", {"alpha": a}) for a in (0.0001, 0.001, 0.01)), *(("elasticnet", {"alpha": a, "l1_ratio": r}) for a in (0.0001, 0.001) for r in (0.25, 0.5, 0.75))]


def _model_grid() -> str:
    parts, rows, preds = {}, [], []
    for i, (model, params) in enumerate(_MODELS):
        parts |= fitted(f"m{i}", model, share=500.0, **params)
        preds.append(f"SELECT {i} AS spec, 2 AS k, s.*, label_1d_fwd / 500.0::DOUBLE AS forward_ret FROM ({scored(f'm{i}')}) s JOIN feats USING (date, ticker)")
        name = "__".join([model, *(f"{n}_{v:g}" for n, v in params.items())])
        rows.append(f"SELECT {i} AS spec, '{name}' AS experiment_name, '{model}' AS model_name, '{json.dumps(params)}' AS parameters")
    columns = "experiment_name, model_name, parameters, 1 AS horizon, 2 AS k, 'none' AS normalization, 'none' AS smoothing, round(ic_ir, 6) + 0.0::DOUBLE AS ic_ir, cagr_net, " + _MEASURES
    return grid(" UNION ALL ".join(rows), " UNION ALL ".join(preds), parts, columns)


def _strategy_grid() -> str:
    parts: dict[str, str] = {}
    for h in (1, 3, 5):
        parts |= fitted(f"h{h}", "elasticnet", alpha=0.001, l1_ratio=0.5, horizon=h, share=500.0)
    raw = " UNION ALL ".join(f"SELECT {h} AS horizon, s.*, label_{h}d_fwd / 500.0::DOUBLE AS forward_ret FROM ({scored(f'h{h}')}) s JOIN feats USING (date, ticker)" for h in (1, 3, 5))
    parts["raw"] = f"SELECT *, row_number() OVER (PARTITION BY horizon, ticker ORDER BY date, fold_id) AS rn FROM ({raw})"
    parts["smooth"] = """SELECT horizon, ticker, rn, score AS y, 1.0::DOUBLE AS w FROM raw WHERE rn = 1
        UNION ALL SELECT g.horizon, g.ticker, g.rn, CASE WHEN g.score IS NULL THEN e.y WHEN e.y IS NULL THEN g.score ELSE (e.w * 0.5::DOUBLE * e.y + 0.5::DOUBLE * g.score) / (e.w * 0.5::DOUBLE + 0.5::DOUBLE) END,
               CASE WHEN g.score IS NULL THEN e.w * 0.5::DOUBLE ELSE 1.0::DOUBLE END FROM smooth e JOIN raw g ON g.horizon = e.horizon AND g.ticker = e.ticker AND g.rn = e.rn + 1"""
    parts["smoothed"] = "SELECT 'none' AS smoothing, horizon, date, ticker, forward_ret, score FROM raw UNION ALL SELECT 'ema_3', r.horizon, date, r.ticker, forward_ret, CASE WHEN score IS NOT NULL THEN y END FROM raw r JOIN smooth s ON s.horizon = r.horizon AND s.ticker = r.ticker AND s.rn = r.rn"
    day = "PARTITION BY smoothing, horizon, date"
    parts["signals"] = f"""SELECT smoothing, horizon, 'none' AS normalization, date, ticker, forward_ret, score FROM smoothed
        UNION ALL SELECT smoothing, horizon, 'zscore', date, ticker, forward_ret, CASE WHEN score IS NOT NULL THEN CASE WHEN stddev_pop(score) OVER ({day}) > 0 THEN (score - avg(score) OVER ({day})) / stddev_pop(score) OVER ({day}) ELSE 0 END END FROM smoothed
        UNION ALL SELECT smoothing, horizon, 'rank_to_minus1_plus1', date, ticker, forward_ret, CASE WHEN score IS NOT NULL THEN CASE WHEN count(score) OVER ({day}) > 1
            THEN 2.0::DOUBLE * (rank() OVER ({day}, score IS NULL ORDER BY score) + (count(*) OVER ({day}, score) - 1) / 2.0::DOUBLE - 1) / (count(score) OVER ({day}) - 1) - 1 ELSE 0 END END FROM smoothed"""
    specs = "SELECT row_number() OVER () AS spec, * FROM (SELECT unnest([1, 3, 5]) AS horizon), (SELECT unnest([2, 3, 4]) AS k), (SELECT unnest(['none', 'zscore', 'rank_to_minus1_plus1']) AS normalization), (SELECT unnest(['none', 'ema_3']) AS smoothing)"
    pred = "SELECT spec, k, date, ticker, score, forward_ret FROM signals JOIN specs USING (horizon, normalization, smoothing)"
    columns = """concat('h', horizon, '__k', k, '__norm_', normalization, '__smooth_', smoothing) AS experiment_name, 'elasticnet' AS model_name, '{"alpha": 0.001, "l1_ratio": 0.5}' AS parameters, CAST(horizon AS INTEGER) AS horizon, CAST(k AS INTEGER) AS k, normalization, smoothing, """ + _MEASURES
    return grid(specs, pred, parts, columns)


def _param_sweep() -> str:
    by = "n, step_frac, ticker"
    change = lambda name: PARTS[name].replace("PARTITION BY ticker", f"PARTITION BY {by}").replace("PARTITION BY t.ticker", "PARTITION BY t.n, t.step_frac, t.ticker").replace("ticker, date", f"{by}, date")
    z = " UNION ALL ".join(PARTS["fz"].replace("SELECT r.ticker", f"SELECT {n} AS n, r.ticker").replace(">= 20", f">= {n}").replace("ROWS 19", f"ROWS {n - 1}") for n in (10, 20, 40))
    limit = "greatest(-step_frac, least(step_frac, target_pos))"
    held = f"""SELECT {by}, fold_id, rn, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {limit})) AS pos FROM starget WHERE rn = 1
        UNION ALL SELECT t.n, t.step_frac, t.ticker, t.fold_id, t.rn, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, h.pos + greatest(-t.step_frac, least(t.step_frac, t.target_pos - h.pos))))
        FROM sheld h JOIN starget t ON t.n = h.n AND t.step_frac = h.step_frac AND t.ticker = h.ticker AND t.fold_id = h.fold_id AND t.rn = h.rn + 1"""
    more = {
        "sz": z, "starget": PARTS["ftarget"].replace("FROM fz", "FROM sz, (SELECT CAST(unnest([0.25, 0.5]) AS DOUBLE) AS step_frac)"), "sheld": held,
        "straded": change("traded").replace("ftarget", "starget").replace("fheld", "sheld").replace("h.ticker = t.ticker", "h.n = t.n AND h.step_frac = t.step_frac AND h.ticker = t.ticker"),
        "sdetail": change("detail").replace("FROM traded", "FROM straded"), "scurve": change("curve").replace("FROM detail", "FROM sdetail"),
        "folds": f"SELECT {by}, fold_id, CASE WHEN count(*) > 1 AND stddev_pop(pnl) > 0 THEN avg(pnl) / stddev_pop(pnl) * sqrt(252.0::DOUBLE) END AS sharpe FROM sdetail GROUP BY {by}, fold_id",
        "means": f"SELECT {by}, round(avg(sharpe), 6) + 0.0::DOUBLE AS mean_fold_sharpe FROM folds GROUP BY {by}", "whole": stats("pnl", "scurve", keys=("n", "step_frac", "ticker")),
    }
    return sql("SELECT ticker, CAST(n AS INTEGER) AS n, step_frac, 1.0::DOUBLE AS K, 0 AS ddof, 5.0::DOUBLE AS cost_bps_per_turnover, mean_fold_sharpe, whole.* EXCLUDE (n, step_frac, ticker) FROM means JOIN whole USING (n, step_frac, ticker)", "rets", "plan", more=more)


def _scores(model: str, **params: float) -> str:
    return sql(f"SELECT date, ticker, fold_id, round(score, 6) + 0.0::DOUBLE AS score FROM ({scored('one')})", "feats", "plan", "cal", more=fitted("one", model, **params))


ORACLE |= {
    "ridge_wf_scores": _scores("ridge", alpha=1.0),
    "lasso_wf_scores": _scores("lasso", alpha=0.001),
    "elasticnet_wf_scores": _scores("elasticnet", alpha=0.001, l1_ratio=0.5),
    "model_grid_summary": _model_grid(),
    "strategy_grid_summary": _strategy_grid(),
    "param_sweep_grid": _param_sweep(),
}

# The grids' specs with counts over the panel.
_LABELS = "SELECT 1 AS h, count(label_1d_fwd) AS n_labels FROM rets UNION ALL SELECT 3, count(label_3d_fwd) FROM rets UNION ALL SELECT 5, count(label_5d_fwd) FROM rets"
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in (*_FEATS, "label_1d_fwd"))
ORACLE |= {
    "spec_grid": sql("SELECT g.*, n_labels FROM grid g JOIN counts ON h = horizon", "rets", more={"grid": ORACLE["spec_grid"], "counts": _LABELS}),
    "model_specs": sql(f"SELECT g.*, (SELECT count(*) FROM feats WHERE {_COMPLETE}) AS n_rows FROM grid g", "feats", more={"grid": ORACLE["model_specs"]}),
    "sweep_specs": sql(
        "SELECT g.*, (SELECT count(*) FROM places WHERE place >= g.n) AS n_rows FROM grid g",
        "panel",
        more={"grid": ORACLE["sweep_specs"], "places": "SELECT row_number() OVER (PARTITION BY ticker ORDER BY date) AS place FROM panel"},
    ),
}

#: Queries that are stated for bars by supplier as well, on the dates that any of them has.
WIDE = (
    "panel_bars", "features_volatility", "forward_labels", "score_rank", "top_bottom_weights", "portfolio_daily", "daily_ic", "rate_limited_position", "wf_backtest_detail",
    "ridge_univariate_wf",
)


def wide(text: str) -> str:
    trades = """SELECT date_trunc('week', l_shipdate) AS dt, CAST(l_suppkey AS VARCHAR) AS ticker, l_extendedprice / l_quantity AS px, l_quantity AS q,
        l_orderkey AS ok, l_linenumber AS ln FROM lineitem"""
    return text.replace(PARTS["trades"], trades).replace(PARTS["calendar"], "SELECT DISTINCT date FROM bars").replace(PARTS["panel"], "SELECT * FROM bars")


def _ticker_models() -> str:
    """As the ridge models of one feature, by ticker and fold."""
    own = PARTS["uni"].replace("SELECT fold_id,", "SELECT ticker, fold_id,").replace("GROUP BY fold_id", "GROUP BY ticker, fold_id")
    score = "CASE WHEN u.n > 0 THEN u.my + u.n * u.cxy / (u.n * u.vx + 1.0::DOUBLE) * (r.ret_5d - u.mx) END"
    text = sql(
        f"""SELECT r.date, r.ticker, p.fold_id, round({score}, 8) + 0.0::DOUBLE AS score FROM rets r JOIN plan p ON r.date BETWEEN p.test_start AND p.test_end
        LEFT JOIN own u ON u.fold_id = p.fold_id AND u.ticker = r.ticker""",
        "rets", "plan", "cut", more={"own": own},
    )
    return wide(text)


#: All orders in one series, and recurrences along it.
_ORDERS = """SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN (CAST(round(o_totalprice) AS BIGINT) % 2000) / 1000.0::DOUBLE - 1 END AS x,
    row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders"""
_MOVED = "greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {0} + greatest(-0.125::DOUBLE, least(0.125::DOUBLE, coalesce(x, 0) - {0}))))"
_AVERAGED = "(w * {0} * y + {1} * x) / (w * {0} + {1})".format("(1 - 2.0::DOUBLE / 6)", "(2.0::DOUBLE / 6)")
ORACLE |= {
    **{f"wide_{n}": wide(ORACLE[n]) for n in WIDE},
    "wide_ticker_models": _ticker_models(),
    "one_series_position": f"""WITH RECURSIVE o AS MATERIALIZED ({_ORDERS}),
        held AS (SELECT rn, {_MOVED.format('0.0::DOUBLE')} AS p FROM o WHERE rn = 1 UNION ALL SELECT o.rn, {_MOVED.format('p')} FROM held h JOIN o ON o.rn = h.rn + 1)
        SELECT o_orderkey, round(p, 8) + 0.0::DOUBLE AS pos FROM o JOIN held USING (rn)""",
    "one_series_average": f"""WITH RECURSIVE o AS MATERIALIZED ({_ORDERS}),
        made AS (SELECT rn, x AS y, 1.0::DOUBLE AS w FROM o WHERE rn = 1 UNION ALL
            SELECT o.rn, CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x ELSE {_AVERAGED} END, CASE WHEN x IS NULL THEN w * (1 - 2.0::DOUBLE / 6) ELSE 1.0::DOUBLE END
            FROM made m JOIN o ON o.rn = m.rn + 1)
        SELECT o_orderkey, round(CASE WHEN x IS NOT NULL THEN y END, 8) + 0.0::DOUBLE AS score_smoothed FROM o JOIN made USING (rn)""",
    "one_series_curve": f"""WITH o AS ({_ORDERS}), c AS (SELECT *, product(1 + coalesce(x / 1000.0::DOUBLE, 0)) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS equity FROM o)
        SELECT o_orderkey, round(equity, 8) + 0.0::DOUBLE AS equity, round(CASE WHEN x IS NOT NULL THEN equity / max(CASE WHEN x IS NOT NULL THEN equity END)
            OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) - 1 END, 8) + 0.0::DOUBLE AS drawdown FROM c""",
}


def _from(name: str, columns: str, rest: str = "") -> str:
    """Of another query's rows."""
    return f"SELECT {columns} FROM ({ORACLE[name]}) {rest}"


def _leaders(name: str, n: int) -> str:
    place = "row_number() OVER (ORDER BY sharpe_net DESC NULLS LAST, experiment_name)"
    return _from(name, f"CAST({place} AS INTEGER) AS place, experiment_name, sharpe_net, total_return_net, mean_ic, max_drawdown_net", f"QUALIFY {place} <= {n}")


#: Orders as rows of the registry.
_REGISTERED = """SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS timestamp, o_orderpriority AS run_name,
    CASE WHEN o_custkey % 3 = 0 THEN 'ablation' WHEN o_custkey % 3 = 1 THEN 'single_run' ELSE 'strategy_ablation' END AS run_type, CAST(o_orderkey AS VARCHAR) AS experiment_name,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'ridge' END AS model_name,
    CASE WHEN o_orderkey % 5 <> 0 THEN concat('{"alpha": ', o_custkey % 10, ', "note": "', lower(o_orderpriority), ', kept"}') ELSE '' END AS parameters,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 7 END AS horizon, CAST(NULL AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS normalization, o_orderstatus AS smoothing,
    CAST(o_orderkey % 97 AS DOUBLE) AS mean_ic, CAST(NULL AS DOUBLE) AS mean_spread, o_totalprice / 7.0::DOUBLE AS total_return_net, o_totalprice AS sharpe_net,
    CAST(o_custkey % 1013 AS DOUBLE) AS sortino_net, CAST(NULL AS DOUBLE) AS max_drawdown_net, CAST(NULL AS BIGINT) AS n_constant_score_days, CAST(NULL AS VARCHAR) AS path_to_run_dir FROM orders"""
_MESSY = f"SELECT date, ticker, {rounded('Open', 'High', 'Low', 'Close')}, round(CASE WHEN n % 5 <> 0 THEN Volume END, 8) + 0.0::DOUBLE AS Volume FROM counted SEMI JOIN calendar ON counted.date = calendar.date"
_BEST = "row_number() OVER (PARTITION BY ticker ORDER BY {0} DESC NULLS LAST, n, step_frac) = 1"
ORACLE |= {
    "best_sweep_configs": " UNION ALL ".join(_from("param_sweep_grid", f"'{m}' AS chosen_by, *", f"QUALIFY {_BEST.format(m)}") for m in ("mean_fold_sharpe", "total_return")),
    "model_leaderboard": _leaders("model_grid_summary", 5),
    "strategy_leaderboard": _leaders("strategy_grid_summary", 10),
    "registry_round_trip": _REGISTERED,
    "registry_champions": _from("champion_by_metric", "c.*, o_orderstatus AS smoothing", "c JOIN orders ON CAST(o_orderkey AS VARCHAR) = experiment_name"),
    "csv_result_round_trip": _from("wf_backtest_detail", "date, ticker, fold_id, pos, turnover, pnl, equity"),
    "fold_folders": _from("wf_backtest_detail", "date, ticker, fold_id, pnl, equity", "WHERE fold_id IN (2, 3)"),
    "report_ticker_summary": _from("ticker_selection", "*, row_number() OVER (ORDER BY total_contribution DESC, ticker) AS place"),
    "curves_of_first_folds": _from("fold_local_curves", "*", "QUALIFY dense_rank() OVER (ORDER BY fold_id) <= 5"),
    "csv_messy_panel": sql(_MESSY, "bars", "calendar", more={"counted": "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM bars"}),
    "csv_messy_dates": ORACLE["csv_dates"],
    "csv_selected_tickers": sql(
        f"SELECT {_BARS} FROM bars SEMI JOIN two ON bars.ticker = two.ticker WHERE date IN (SELECT date FROM bars SEMI JOIN two ON bars.ticker = two.ticker GROUP BY date HAVING count(*) = 2)",
        "bars", more={"two": "SELECT DISTINCT ticker FROM bars ORDER BY ticker LIMIT 2"},
    ),
}

"""SQL counterparts of the registered queries, over the same tables and written from the definitions.

Each text is a chain of common table expressions (``CTES``) and a final select.
"""

from panelspark.plans.catalog import END, FREQS, PANEL_COLUMNS, SPANS, START, TEST_START, TRAIN_END
from panelspark.schema import FFD_THRESH

TICKER = "partition by ticker order by date"


def prev(n):
    return f"({TICKER} rows between {n - 1} preceding and current row)"


def roll(agg, x, n):
    """An aggregate over the last n rows, null unless all n values are there."""
    return f"case when count({x}) over {prev(n)} = {n} then {agg}({x}) over {prev(n)} end"


def ahead(x, h):
    frame = f"({TICKER} rows between 1 following and {h} following)"
    return f"case when count({x}) over {frame} = {h} then sum({x}) over {frame} end"


def lag(x, k=1):
    return f"lag({x}, {k}) over ({TICKER})"


ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"
PRICE = "100 * (1 - l_discount) * (1 + l_tax)"


def bars(source):
    return f"""select ticker, date, first(price order by {ORDER}) as open, max(price) as high, min(price) as low,
        last(price order by {ORDER}) as close, sum(volume) as volume from {source} group by ticker, date"""


CTES = {
    "daily_rows": f"""select 'S' || l_suppkey as ticker, cast(l_shipdate as date) as date, {PRICE} as price,
        l_quantity as volume, {ORDER} from lineitem""",
    "daily_all": "select * from daily_rows union all select * replace ('MKT' as ticker) from daily_rows",
    "daily": bars("daily_all"),
    "weekly_rows": f"""select p_brand as ticker, cast(date_trunc('week', l_shipdate) as date) as date, {PRICE} as price,
        l_quantity as volume, {ORDER} from lineitem join part on l_partkey = p_partkey""",
    "weekly_all": "select * from weekly_rows union all select * replace ('MKT' as ticker) from weekly_rows",
    "weekly": bars("weekly_all"),
    "universe": """select 'S' || s_suppkey as ticker, n_name as sector, dense_rank() over (order by n_name) - 1 as sector_code
        from supplier join nation on s_nationkey = n_nationkey""",
    "returns": f"select *, close / nullif({lag('close')}, 0) - 1 as daily_return from daily",
    "weekly_returns": f"select *, close / nullif({lag('close')}, 0) - 1 as daily_return from weekly",
    "market": "select date, daily_return as market_return from returns where ticker = 'MKT'",
    "paired": "select r.*, m.market_return from returns r left join market m using (date)",
    "regressed": f"""select *,
        case when ticker = 'MKT' then 1.0
             when count(daily_return + market_return) over {prev(252)} = 252
             then covar_samp(daily_return, market_return) over {prev(252)} / nullif(var_samp(market_return) over {prev(252)}, 0) end as rolling_beta,
        {roll('avg', 'daily_return', 252)} as mean_r, {roll('avg', 'market_return', 252)} as mean_m from paired""",
    "residuals": """select *, daily_return - (rolling_alpha + rolling_beta * market_return) as residual_return from (
        select *, case when ticker = 'MKT' then 0.0 else mean_r - rolling_beta * mean_m end as rolling_alpha from regressed)""",
    "labelled": f"select *, {ahead('residual_return', 5)} as fwd_residual_return, {ahead('daily_return', 5)} as fwd_raw_return from residuals",
    # scores and portfolio
    "panel": f"""select * from (select ticker, date, daily_return,
            close / nullif({lag('close', 5)}, 0) - 1 as predicted_score,
            {roll('stddev_samp', 'daily_return', 20)} as realized_vol_20,
            round({ahead('daily_return', 5)}, 9) as fwd_raw_return
        from returns) where ticker <> 'MKT'""",
    "scored": """select date, ticker, predicted_score as score, realized_vol_20 as vol from panel
        where predicted_score is not null and realized_vol_20 is not null""",
    "legs": """select *, case when n < 5 then 0 when rk > n * 4 / 5.0 then 1 when rk <= n / 5.0 then -1 else 0 end as leg from (
        select *, row_number() over (partition by date order by score, ticker) as rk, count(*) over (partition by date) as n from scored)""",
    "weighted": """select date, ticker, leg, case when leg = 0 then 0.0 else coalesce(
            leg * (1 / nullif(vol, 0)) / sum(1 / nullif(vol, 0)) over (partition by date, leg), 0.0) end as weight from legs""",
    "freqs": "select unnest([{}]) as rebalance_freq",
    "days": """select date, count(*) filter (predicted_score is not null and realized_vol_20 is not null) as n_valid,
        row_number() over (order by date) - 1 as i from panel group by date""",
    "due": "select *, i % rebalance_freq = 0 as is_due, i % rebalance_freq = 0 and n_valid >= 10 as is_rebalance from days, freqs",
    "schedule": """select rebalance_freq, date, n_valid, is_due, is_rebalance,
        case when not is_due or is_rebalance then (select max(e.date) from due e where e.rebalance_freq = d.rebalance_freq
            and e.is_rebalance and e.date <= d.date) end as rebalance_date from due d""",
    "positions": """select s.rebalance_freq, p.date, p.ticker, w.weight, case when w.weight > 0 then 'long' else 'short' end as leg,
            p.daily_return, s.rebalance_date
        from panel p join schedule s on p.date = s.date
        join weighted w on w.date = s.rebalance_date and w.ticker = p.ticker and w.weight <> 0""",
    "pdays": """select rebalance_freq, date, lag(date) over (partition by rebalance_freq order by date) as before from (
        select distinct rebalance_freq, date from positions)""",
    "now_and_before": """select p.rebalance_freq, p.date, p.ticker, p.weight as w from positions p
        union all select d.rebalance_freq, d.date, p.ticker, -p.weight from pdays d
        join positions p on p.rebalance_freq = d.rebalance_freq and p.date = d.before""",
    "turn": """select rebalance_freq, date, sum(abs(w)) as turnover from (
        select rebalance_freq, date, ticker, sum(w) as w from now_and_before group by all) group by all""",
    "gross": "select rebalance_freq, date, coalesce(sum(weight * daily_return), 0) as gross_return from positions group by all",
    "book": """select *, gross_return - cost as net_return from (
        select rebalance_freq, date, gross_return, turnover, turnover * 8.0 / 10000 as cost
        from gross join turn using (rebalance_freq, date))""",
    "curves": """select *, product(1 + gross_return) over (partition by rebalance_freq order by date) as cum_gross,
        product(1 + net_return) over (partition by rebalance_freq order by date) as cum_net from book""",
    "bench": f"""select ticker, date, daily_return, product(1 + daily_return) over ({TICKER}) as cum_return
        from returns where ticker in ('MKT', 'S1') and daily_return is not null and date between '{START}' and '{END}'""",
    "ic_pairs": """select date, predicted_score as x, fwd_raw_return as y from panel
        where predicted_score is not null and fwd_raw_return is not null""",
    "ic_ranks": """select date, rank() over (partition by date order by x) + (count(*) over (partition by date, x) - 1) / 2.0 as rx,
        rank() over (partition by date order by y) + (count(*) over (partition by date, y) - 1) / 2.0 as ry from ic_pairs""",
    "ic": """select date, case when stddev_samp(rx) > 1e-12 and stddev_samp(ry) > 1e-12
            then covar_samp(rx, ry) / (stddev_samp(rx) * stddev_samp(ry)) end as ic, count(*) as n_stocks
        from ic_ranks group by date having count(*) >= 10""",
    # exponentially weighted means by recursion over the row number
    "steps": f"""select ticker, date, close, rn, greatest(delta, 0) as gain, greatest(-delta, 0) as loss from (
        select ticker, date, close, close - {lag('close')} as delta, row_number() over ({TICKER}) as rn from {{bars}})""",
    "emas": """select ticker, rn, cast(null as double) as g, cast(null as double) as l, close as f, close as s, cast(0 as double) as sig
            from steps where rn = 1
        union all
        select t.ticker, t.rn,
            case when e.rn = 1 then t.gain else e.g * 13 / 14 + t.gain / 14 end,
            case when e.rn = 1 then t.loss else e.l * 13 / 14 + t.loss / 14 end,
            e.f + (t.close - e.f) * 2 / 13, e.s + (t.close - e.s) * 2 / 27,
            e.sig * 0.8 + 0.2 * ((e.f + (t.close - e.f) * 2 / 13) - (e.s + (t.close - e.s) * 2 / 27))
        from emas e join steps t on t.ticker = e.ticker and t.rn = e.rn + 1""",
    "oscillators": """select ticker, date, case when rn >= 15 and l > 1e-12 then 100 - 100 / (1 + g / l) else 50 end as rsi_14,
        f - s as macd, sig as macd_signal, f - s - sig as macd_hist from emas join steps using (ticker, rn)""",
    # fractional differencing
    "wide": """select ticker, list(ln(greatest(close, 1e-8)) order by date) as ys, list(date order by date) as dates,
        count(*) as n from daily group by ticker""",
    "ws": """select unnest([{grid}]) as d, 0 as k, cast(1 as double) as w
        union all select d, k + 1, -w * (d - (k + 1) + 1) / (k + 1) from ws
        where k + 1 < 1000 and abs(-w * (d - (k + 1) + 1) / (k + 1)) >= {thresh}""",
    "filters": "select d, list(w order by k desc) as ws, count(*) as len from ws group by d",
    "ffd": """select ticker, d, i, dates[i] as date, ys[i] as log_close,
            case when n >= len and i >= len then list_dot_product(ys[i - len + 1 : i], ws)
                 when n < len and i = n then list_dot_product(ys, ws[len - n + 1 : len]) end as x
        from (select *, unnest(range(1, n + 1)) as i from wide, filters)""",
    "lags": """select ticker, d, x, u, x - u as dy, u - lag(x, 2) over w as du from (
        select *, lag(x) over (partition by ticker, d order by i) as u from ffd)
        window w as (partition by ticker, d order by i)""",
    "lags2": "select ticker, d, x, case when du is not null then u end as u, case when du is not null then dy end as dy, du from ({lagged})",
    "moments": """select ticker, d, count(x) as n, count(u) as m, var_samp(u) as a, var_samp(du) as b, covar_samp(u, du) as c,
        covar_samp(u, dy) as p, covar_samp(du, dy) as q, var_samp(dy) as s from complete group by ticker, d""",
    "solved": """select *, (p * b - q * c) / nullif(a * b - c * c, 0) as g, (q * a - p * c) / nullif(a * b - c * c, 0) as h from moments""",
    "tests": """select ticker, d, n as n_obs, case when n >= 50 and a * b - c * c > 1e-14 * a * b then
        g / sqrt((m - 1) * (s - g * p - h * q) / (m - 3) * b / ((m - 1) * (a * b - c * c))) end as stat from solved""",
    "best": "select ticker, coalesce(min(d) filter (stat < -2.8615928), 1.0) as d from tests group by ticker",
    # folds over the scored rows
    "row_places": "select date, row_number() over (order by date, ticker) - 1 as pos from scored",
    "date_places": "select date, ticker, dense_rank() over (order by date) - 1 as pos from scored",
    "bounds": """select fold, n, lo, hi, greatest(0, lo - 5) as purge_from, least(n, hi + floor(n * 0.01)) as embargo_to from (
        select fold, n, floor(fold * (n / 5.0)) as lo, case when fold = 4 then n else floor((fold + 1) * (n / 5.0)) end as hi
        from (select unnest(range(0, 5)) as fold) , (select {n} as n from {places}))""",
    "roles": """select *, case when pos >= lo and pos < hi then 'test' when pos >= purge_from and pos < lo then 'purged'
        when pos >= hi and pos < embargo_to then 'embargoed' else 'train' end as role from {places}, bounds""",
    "split_rows": """select case when date <= '{}' then 'train' when date >= '{}' then 'test' end as split, date
        from panel where predicted_score is not null and fwd_raw_return is not null {{}}""".format(TRAIN_END, TEST_START),
}
CTES["complete"] = CTES["lags2"].format(lagged="select * from lags")
DEPENDS = {
    "daily_all": ["daily_rows"], "daily": ["daily_all"], "weekly_all": ["weekly_rows"], "weekly": ["weekly_all"],
    "returns": ["daily"], "weekly_returns": ["weekly"], "market": ["returns"], "paired": ["returns", "market"],
    "regressed": ["paired"], "residuals": ["regressed"], "labelled": ["residuals"], "panel": ["returns"],
    "scored": ["panel"], "legs": ["scored"], "weighted": ["legs"], "days": ["panel"], "due": ["days", "freqs"],
    "schedule": ["due"], "positions": ["panel", "schedule", "weighted"], "pdays": ["positions"],
    "now_and_before": ["positions", "pdays"], "turn": ["now_and_before"], "gross": ["positions"],
    "book": ["gross", "turn"], "curves": ["book"], "bench": ["returns"], "ic_pairs": ["panel"],
    "ic_ranks": ["ic_pairs"], "ic": ["ic_ranks"], "emas": ["steps"], "oscillators": ["emas", "steps"],
    "wide": ["daily"], "filters": ["ws"], "ffd": ["wide", "filters"], "lags": ["ffd"], "complete": ["lags"],
    "moments": ["complete"], "solved": ["moments"], "tests": ["solved"], "best": ["tests"],
    "row_places": ["scored"], "date_places": ["scored"], "split_rows": ["panel"],
}


#: Expressions that are read more than once by one that is, too: computed once.
MATERIALIZED = {"panel", "lin"}


def sql(final, *names, **overrides):
    """``final`` with the named expressions and all that they need in front of it."""
    done = {}

    def add(name):
        if name in done:
            return
        for other in DEPENDS.get(name, []):
            add(other)
        done[name] = overrides.get(name, CTES[name])

    for name in names:
        add(name)
    chain = ",\n".join(f"{n} as {'materialized ' if n in MATERIALIZED else ''}({q})" for n, q in done.items())
    return f"with recursive {chain}\n{final}" if done else final


def r6(*columns):
    return ", ".join(f"round({c}, 6) as {c}" for c in columns)


def big(*columns):
    return ", ".join(f"cast({c} as bigint) as {c}" for c in columns)


BAR_COLUMNS = r6("open", "high", "low", "close", "volume")
ONE_FREQ = {"freqs": CTES["freqs"].format("5")}
ALL_FREQS = {"freqs": CTES["freqs"].format(", ".join(map(str, FREQS)))}
GRID = "0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9"


def weights(grid=GRID, thresh=FFD_THRESH):
    return {"ws": CTES["ws"].format(grid=", ".join(f"cast({d} as double)" for d in grid.split(", ")), thresh=f"{thresh:.10f}")}


def metrics(source, ret, keys, turnover="turnover", cost="cost"):
    """The metric columns from a table of returns; keys is a comma-separated list."""
    return f"""
    select {keys}, round(growth - 1, 6) as total_return, round(ann, 6) as annualized_return,
        round(dev * sqrt(252), 6) as annualized_volatility,
        round(case when dev > 1e-12 then mean / dev * sqrt(252) else 0 end, 6) as sharpe_ratio,
        round(coalesce(case when (case when n_down > 0 then down else dev end) > 1e-12
            then mean / (case when n_down > 0 then down else dev end) * sqrt(252) end, 0), 6) as sortino_ratio,
        round(fall, 6) as max_drawdown, round(case when fall = 0 then 0 else ann / abs(fall) end, 6) as calmar_ratio,
        round(turnover / (n / 252.0), 6) as annualized_turnover, round(n_up * 100.0 / n, 6) as win_rate_pct,
        n as n_trading_days, round(cost * 10000, 6) as total_cost_bps
    from (select *, pow(growth, 252.0 / n) - 1 as ann from (
        select {keys}, count(*) as n, product(1 + r) as growth, avg(r) as mean, stddev_samp(r) as dev,
            stddev_samp(r) filter (r < 0) as down, count(*) filter (r < 0) as n_down, count(*) filter (r > 0) as n_up,
            min(cum / peak - 1) as fall, sum(t) as turnover, sum(c) as cost
        from (select *, max(cum) over (partition by {keys} order by date) as peak from (
            select {keys}, date, {ret} as r, {turnover} as t, {cost} as c,
                product(1 + {ret}) over (partition by {keys} order by date) as cum from {source}))
        group by all having count(*) >= 2))"""


def true_range(name="tr"):
    return f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) as {name}"


PK = "pow(ln(high / nullif(low, 0)), 2)"
GK = "(0.5 * pow(ln(high / nullif(low, 0)), 2) - (2 * ln(2) - 1) * pow(ln(close / nullif(open, 0)), 2))"


def park(n):
    return f"sqrt({roll('avg', PK, n)} / (4 * ln(2)))"


def gk(n):
    level = roll("avg", GK, n)
    return f"case when ({level}) is not null then sqrt(greatest({level}, 0)) end"


def feature_select(source, extra=""):
    """All window features but the recursive ones."""
    illiq = "(abs(daily_return) / nullif(close * volume, 0) * 1e6)"
    return f"""select *, close / nullif(sma_20, 0) as close_to_sma20, sma_20 + 2 * dev as bb_upper, sma_20 - 2 * dev as bb_lower,
        ((sma_20 + 2 * dev) - (sma_20 - 2 * dev)) / nullif(sma_20, 0) as bb_width, atr_20 / nullif(atr_200, 0) as vol_regime
    from (select *, {park(10)} as parkinson_vol_10, {park(20)} as parkinson_vol_20,
        {gk(10)} as garman_klass_vol_10, {gk(20)} as garman_klass_vol_20,
        close * volume as dollar_volume, {roll('avg', illiq, 20)} as amihud_illiq_20,
        {roll('avg', 'tr', 20)} as atr_20, {roll('avg', 'tr', 200)} as atr_200,
        (volume - ({roll('avg', 'volume', 20)})) / nullif({roll('stddev_samp', 'volume', 20)}, 0) as volume_zscore,
        {roll('avg', 'close', 10)} as sma_10, {roll('avg', 'close', 20)} as sma_20, {roll('avg', 'close', 50)} as sma_50,
        {roll('stddev_samp', 'close', 20)} as dev,
        {roll('stddev_samp', 'daily_return', 10)} as realized_vol_10, {roll('stddev_samp', 'daily_return', 20)} as realized_vol_20,
        (high - low) / nullif(close, 0) as hl_spread, {roll('avg', 'volume', 10)} as volume_sma_10,
        volume / nullif({lag('volume')}, 0) - 1 as volume_change,
        {lag('daily_return', 1)} as return_lag_1, {lag('daily_return', 2)} as return_lag_2,
        {lag('daily_return', 3)} as return_lag_3, {lag('daily_return', 5)} as return_lag_5,
        close / nullif({lag('close', 5)}, 0) - 1 as momentum_5, close / nullif({lag('close', 10)}, 0) - 1 as momentum_10,
        close / nullif({lag('close', 20)}, 0) - 1 as momentum_20
    from (select *, {true_range()} from {source}){extra})"""


CTES["weekly_features"] = feature_select("weekly_returns")
CTES["daily_features"] = feature_select("returns")
DEPENDS["weekly_features"] = ["weekly_returns"]
DEPENDS["daily_features"] = ["returns"]


def weekly_feature(*columns, **computed):
    more = "".join(f", round({x}, 6) as {c}" for c, x in computed.items())
    return sql(f"select ticker, date, {r6(*columns)}{more} from weekly_features", "weekly_features")


def oscillator(*columns):
    return sql(f"select ticker, date, {r6(*columns)} from oscillators", "weekly", "oscillators",
               steps=CTES["steps"].format(bars="weekly"))


def panel_columns():
    numbers = [c for c in PANEL_COLUMNS if c not in ("sector", "sector_code")]
    return f"""select ticker, date, {r6(*numbers)}, coalesce(sector, 'Unknown') as sector,
        cast(coalesce(sector_code, -1) as bigint) as sector_code
        from daily_features join oscillators using (ticker, date) left join universe using (ticker)"""


def barrier():
    touches = "\n".join(
        f"when f{k} >= up then {{up{k}}} when f{k} <= lo then {{lo{k}}}" for k in range(1, 6))
    label = touches.format(**{f"up{k}": "1" for k in range(1, 6)}, **{f"lo{k}": "-1" for k in range(1, 6)})
    exit_ = touches.format(**{f"up{k}": f"d{k}" for k in range(1, 6)}, **{f"lo{k}": f"d{k}" for k in range(1, 6)})
    leads = ", ".join(f"lead(close, {k}) over ({TICKER}) as f{k}, lead(date, {k}) over ({TICKER}) as d{k}" for k in range(1, 6))
    return f"""select ticker, date,
            cast(case when d1 is null or vol is null or vol <= 0 then 0 {label} else sign(coalesce(f5, f4, f3, f2, f1) - close) end as bigint) as barrier_label,
            case when d1 is null or vol is null or vol <= 0 then null {exit_} else coalesce(d5, d4, d3, d2, d1) end as barrier_date
        from (select *, close * (1 + vol) as up, close * (1 - vol) as lo, {leads} from (
            select *, round({roll('stddev_samp', 'daily_return', 20)}, 9) as vol from returns))"""


def filled(c):
    return f"last_value({c} ignore nulls) over ({TICKER} rows between unbounded preceding and current row) as {c}"


FILL = f"""select ticker, date, {BAR_COLUMNS} from (
    select ticker, date, {', '.join(filled(c) for c in ('open', 'high', 'low', 'close'))}, volume from (
        select 'S' || l_suppkey as ticker, cast(l_shipdate as date) as date,
            first({PRICE} order by {ORDER}) filter (l_returnflag <> 'R') as open,
            max({PRICE}) filter (l_returnflag <> 'R') as high, min({PRICE}) filter (l_returnflag <> 'R') as low,
            last({PRICE} order by {ORDER}) filter (l_returnflag <> 'R') as close, sum(l_quantity) as volume
        from lineitem group by all))
    where open is not null and volume is not null"""

LONG_WEIGHTS = weights(thresh=1e-5)
CHOSEN = f"""select w.ticker, w.date, round(w.log_close, 6) as log_close,
        case when w.ticker = 'MKT' then 0.0 else b.d end as fracdiff_d,
        round(case when w.ticker = 'MKT' then w.log_close when b.d = 1.0 then w.log_close - lag(w.log_close) over (partition by w.ticker order by w.date)
            else w.x end, 6) as fracdiff_close
    from ffd w join best b on b.ticker = w.ticker and w.d = case when b.d = 1.0 then 0.9 else b.d end"""


def ffd_columns():
    picks = ", ".join(f"round(max(x) filter (d = {d}), 6) as ffd_{round(d * 1000):04d}" for d in (0.2, 0.4, 0.6, 0.8, 1.0))
    return f"select ticker, date, round(max(log_close), 6) as log_close, {picks} from ffd group by ticker, date"


def column_tests():
    parts = " union all ".join(
        f"select ticker, '{c}' as d, row_number() over ({TICKER}) as i, {c} as x from logs" for c in ("log_close", "daily_return", "volume"))
    final = 'select ticker, d as "column", n_obs, round(stat, 6) as stat from tests'
    return sql(final, "returns", "logs", "tests", **weights(), ffd=parts)


CTES["logs"] = "select *, ln(greatest(close, 1e-8)) as log_close from returns"
DEPENDS["logs"] = ["returns"]

FOLD_ROWS = {"bounds": CTES["bounds"].format(n="count(*)", places="row_places"),
             "roles": CTES["roles"].format(places="row_places")}
FOLD_DATES = {"bounds": CTES["bounds"].format(n="count(distinct date)", places="date_places"),
              "roles": CTES["roles"].format(places="date_places")}
DEPENDS["bounds"] = []
DEPENDS["roles"] = ["bounds"]
EXTRA_SPLIT = "and realized_vol_20 is not null and ticker not in ('S1', 'S2')"
LATE_DAYS = f"""and date not in (select date from (select distinct date from panel where predicted_score is not null
    and fwd_raw_return is not null and date <= '{TRAIN_END}') order by date desc limit 5)"""


def split(features, extra):
    return sql(f"""select split, count(*) as n_rows, min(date) as first_date, max(date) as last_date,
        cast({features} as bigint) as n_features from split_rows where split is not null group by split""",
               "split_rows", split_rows=CTES["split_rows"].format(extra))


def report():
    return sql("""select coalesce(ticker, 'Overall') as ticker, count(*) as n_samples,
            round(sqrt(sum(pow(p - y, 2)) / count(*)), 6) as rmse, round(sum(abs(p - y)) / count(*), 6) as mae,
            round(case when var_pop(y) > 0 then 1 - sum(pow(p - y, 2)) / (var_pop(y) * count(*)) end, 6) as r2,
            round(sqrt(sum(y * y) / count(*)), 6) as baseline_rmse, round(sum(abs(y)) / count(*), 6) as baseline_mae
        from (select ticker, predicted_score as p, fwd_raw_return as y from panel
              where predicted_score is not null and fwd_raw_return is not null)
        group by rollup (ticker)""", "panel")


POSITIONS = """select cast(rebalance_freq as bigint) as rebalance_freq, date, ticker, round(weight, 6) as weight, leg,
    round(daily_return, 6) as daily_return, rebalance_date from positions"""
CHECK = """select date, coalesce(sum(weight) filter (weight > 0), 0) as long_weight_sum,
    coalesce(sum(weight) filter (weight < 0), 0) as short_weight_sum, count(*) filter (weight > 0) as n_long,
    count(*) filter (weight < 0) as n_short from positions group by date"""
RETURN_COLUMNS = r6("gross_return", "turnover", "cost", "net_return", "cum_gross", "cum_net")
BOTH_SERIES = """select date, turnover, cost, 'gross' as series, gross_return as ret from book
    union all select date, turnover, cost, 'net', net_return from book"""
CTES["two_series"] = BOTH_SERIES
DEPENDS["two_series"] = ["book"]
CTES["sweep"] = """select cast(b as double) as cost_bps, date, turnover, turnover * b / 10000.0 as cost,
    gross_return - turnover * b / 10000.0 as ret from book, (select unnest(range(0, 31)) as b)"""
DEPENDS["sweep"] = ["book"]
CTES["lagged_positions"] = f"""select p.date, p.ticker, w.weight, p.next_return as daily_return
    from (select *, lead(daily_return) over ({TICKER}) as next_return from panel) p join schedule s on p.date = s.date
    join weighted w on w.date = s.rebalance_date and w.ticker = p.ticker and w.weight <> 0"""
DEPENDS["lagged_positions"] = ["panel", "schedule", "weighted"]
CTES["own_span"] = f"""select ticker, date, product(1 + daily_return) over ({TICKER}) as cum_return from returns
    where ticker in ('MKT', 'S1') and daily_return is not null
    and date between (select min(date) from book) and (select max(date) from book)"""
DEPENDS["own_span"] = ["returns", "book"]
CTES["latest"] = f"""select ticker, max(date) as date, max_by(rolling_beta, date) as rolling_beta,
    max_by(pv, date) as parkinson_vol_20 from (select *, {park(20)} as pv from residuals) where ticker <> 'MKT' group by ticker"""
DEPENDS["latest"] = ["residuals"]

ORACLES = {
    "bars_daily": sql(f"select ticker, date, {BAR_COLUMNS} from daily", "daily"),
    "bars_weekly": sql(f"select ticker, date, {BAR_COLUMNS} from weekly", "weekly"),
    "bars_users": """select 'U' || user_id as ticker, cast(ts as date) as date, round(first(value order by ts, event_id), 6) as open,
        round(max(value), 6) as high, round(min(value), 6) as low, round(last(value order by ts, event_id), 6) as close,
        cast(count(*) as double) as volume from events group by all""",
    "date_range_scan": sql(f"select ticker, date, {BAR_COLUMNS} from daily where date between '{START}' and '{END}'", "daily"),
    "dedupe_first": sql("""select ticker, date, round(price, 6) as price, round(volume, 6) as l_quantity from (
        select *, row_number() over (partition by ticker, date order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) as rn
        from daily_rows) where rn = 1""", "daily_rows"),
    "gap_report": sql(f"""select ticker, gap_start, gap_end, cast(days as bigint) as calendar_days,
        cast(floor(days * 5 / 7.0) - 1 as bigint) as approx_trading_days,
        case when floor(days * 5 / 7.0) - 1 <= 3 then 'forward_filled' else 'flagged_data_quality_issue' end as action
        from (select ticker, {lag('date')} as gap_start, date as gap_end, date - {lag('date')} as days from daily) where days > 4""", "daily"),
    "forward_fill": FILL,
    "history_report": sql("""select ticker, count(*) as n_rows, count(*) < 100 as few_rows, count(*) < 500 as dropped
        from daily group by ticker""", "daily"),
    "min_history": sql("""select ticker, date, round(close, 6) as close from daily
        where ticker in (select ticker from daily group by ticker having count(*) >= 500)""", "daily"),
    "universe_dim": sql(f"select ticker, sector, {big('sector_code')} from universe", "universe"),
    "sector_counts": sql("select sector, count(distinct ticker) as n_tickers from universe group by sector", "universe"),
    "daily_return": sql(f"select ticker, date, {r6('daily_return')} from returns", "returns"),
    "rolling_beta": sql(f"select ticker, date, {r6('rolling_beta', 'rolling_alpha')} from residuals", "residuals"),
    "residual_return": sql(f"select ticker, date, {r6('market_return', 'residual_return')} from residuals", "residuals"),
    "forward_targets": sql(f"select ticker, date, {r6('fwd_residual_return', 'fwd_raw_return')} from labelled", "labelled"),
    "label_coverage": sql("""select count(fwd_residual_return) as valid, count(*) as total,
        round(100.0 * count(fwd_residual_return) / count(*), 6) as pct from labelled""", "labelled"),
    "triple_barrier": sql(barrier(), "returns"),
    "parkinson": weekly_feature("parkinson_vol_10", "parkinson_vol_20"),
    "garman_klass": weekly_feature("garman_klass_vol_10", "garman_klass_vol_20"),
    "amihud": weekly_feature("dollar_volume", "amihud_illiq_20"),
    "atr_and_regime": sql(f"select ticker, date, round(tr, 6) as true_range, {r6('atr_20', 'vol_regime')} from weekly_features", "weekly_features"),
    "volume_features": weekly_feature("volume_zscore", "volume_sma_10", "volume_change"),
    "moving_averages": weekly_feature("sma_10", "sma_20", "sma_50", "close_to_sma20"),
    "bollinger": weekly_feature("bb_upper", "bb_lower", "bb_width"),
    "realized_vol": weekly_feature("realized_vol_10", "realized_vol_20"),
    "lags_and_momentum": weekly_feature("return_lag_1", "return_lag_2", "return_lag_3", "return_lag_5", "momentum_5",
                                        "momentum_10", "momentum_20", hl_spread_pct="hl_spread * 100"),
    "rsi": oscillator("rsi_14"),
    "macd": oscillator("macd", "macd_signal", "macd_hist"),
    "feature_panel": sql(panel_columns(), "daily_features", "oscillators", "universe", steps=CTES["steps"].format(bars="daily")),
    "ffd_apply": sql(ffd_columns(), "ffd", **weights("0.2, 0.4, 0.6, 0.8, 1.0")),
    "unit_root_tests": sql("select ticker, d, n_obs, round(stat, 6) as stat from tests", "tests", **weights()),
    "unit_root_of_columns": column_tests(),
    "optimal_d": sql("select ticker, d from best", "best", **weights()),
    "fracdiff_panel": sql(CHOSEN, "ffd", "best", **weights()),
    "fracdiff_long_memory": sql(CHOSEN, "ffd", "best", **LONG_WEIGHTS),
    "d_summary": sql("""select round(avg(d), 6) as mean_d, round(median(d), 6) as median_d, min(d) as min_d, max(d) as max_d,
        count(*) as n_tickers from best where ticker <> 'MKT'""", "best", **weights()),
    "rank_ic": sql(f"select date, {r6('ic')}, n_stocks from ic", "ic"),
    "ic_summary": sql("""select round(coalesce(avg(ic), 0), 6) as mean_ic, round(coalesce(stddev_samp(ic), 0), 6) as ic_std,
        round(coalesce(avg(ic) / stddev_samp(ic), 0), 6) as ir,
        round(coalesce(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 0), 6) as ic_tstat, count(*) as n_periods,
        round(coalesce(100.0 * count(*) filter (ic > 0) / nullif(count(*), 0), 0), 6) as pct_positive
        from (select round(ic, 12) as ic from ic)""", "ic"),
    "cumulative_ic": sql("select date, round(ic, 6) as ic, round(sum(ic) over (order by date), 6) as cum_ic from ic", "ic"),
    "quantile_legs": sql("select date, ticker, cast(leg as bigint) as leg from legs", "legs"),
    "inverse_vol_weights": sql("select date, ticker, cast(leg as bigint) as leg, round(weight, 6) as weight from weighted", "weighted"),
    "rebalance_schedule": sql("""select cast(rebalance_freq as bigint) as rebalance_freq, date, n_valid, is_due, is_rebalance,
        rebalance_date from schedule""", "schedule", **ONE_FREQ),
    "portfolio_positions": sql(POSITIONS, "positions", **ONE_FREQ),
    "next_day_positions": sql("""select date, ticker, round(weight, 6) as weight, round(daily_return, 6) as daily_return
        from lagged_positions""", "lagged_positions", **ONE_FREQ),
    "portfolio_summary": sql("""select cast(s.rebalance_freq as bigint) as rebalance_freq, n_rebalances,
        coalesce(n_long, 0) as n_long, coalesce(n_short, 0) as n_short from
        (select rebalance_freq, count(*) filter (is_due) as n_rebalances from schedule group by all) s left join
        (select rebalance_freq, count(*) filter (leg = 'long') as n_long, count(*) filter (leg = 'short') as n_short
         from positions group by all) p using (rebalance_freq)""", "schedule", "positions", **ONE_FREQ),
    "weight_check": sql(f"""select date, {r6('long_weight_sum', 'short_weight_sum')}, n_long, n_short,
        round(long_weight_sum - short_weight_sum, 6) as gross_exposure,
        round(long_weight_sum + short_weight_sum, 6) + 0.0 as net_exposure from ({CHECK})""", "positions", **ONE_FREQ),
    "exposure_summary": sql(f"""select round(avg(abs(long_weight_sum + short_weight_sum)), 6) as mean_abs_net,
        round(avg(long_weight_sum - short_weight_sum), 6) as mean_gross from ({CHECK})""", "positions", **ONE_FREQ),
    "portfolio_returns": sql(f"select date, {RETURN_COLUMNS} from curves", "curves", **ONE_FREQ),
    "performance_metrics": sql(metrics("two_series", "ret", "series"), "two_series", **ONE_FREQ),
    "drawdown": sql("""select date, round((cum_net / max(cum_net) over (order by date) - 1) * 100, 6) as drawdown_pct from curves""",
                    "curves", **ONE_FREQ),
    "rolling_sharpe": sql("""select date, round(case when count(*) over w = 63 then avg(net_return) over w / stddev_samp(net_return) over w * sqrt(252) end, 6)
        as rolling_sharpe from book window w as (order by date rows between 62 preceding and current row)""", "book", **ONE_FREQ),
    "benchmark_curve": sql(f"select ticker, date, {r6('daily_return', 'cum_return')} from bench", "bench"),
    "benchmark_metrics": sql(metrics("bench", "daily_return", "ticker", "0.0", "0.0"), "bench"),
    "tearsheet_equity": sql("""select date, 'gross' as curve, round(cum_gross, 6) as value from curves
        union all select date, 'net', round(cum_net, 6) from curves
        union all select date, ticker, round(cum_return, 6) from own_span where date in (select date from book)""",
                            "curves", "own_span", **ONE_FREQ),
    "tearsheet_ic": sql("select date, round(ic, 6) as ic, round(avg(ic) over (), 6) as mean_ic from ic", "ic"),
    "cost_sweep": sql(metrics("sweep", "ret", "cost_bps"), "sweep", **ONE_FREQ),
    "rebalance_sweep": sql(f"select * replace (cast(rebalance_freq as bigint) as rebalance_freq) from ({metrics('book', 'net_return', 'rebalance_freq')})",
                           "book", **ALL_FREQS),
    "breakeven_cost": sql("""select cast(rebalance_freq as bigint) as rebalance_freq, round(sum(gross_return), 6) as sum_gross,
        round(sum(turnover), 6) as sum_turnover, round(10000 * sum(gross_return) / sum(turnover), 6) as breakeven_bps
        from book group by all""", "book", **ALL_FREQS),
    "screener": sql("""select l.ticker, l.date, u.sector, round(l.rolling_beta, 6) as rolling_beta, round(l.parkinson_vol_20, 6) as parkinson_vol_20,
        b.d as fracdiff_d, round(coalesce(p.weight, 0), 6) as weight
        from latest l join best b using (ticker) join universe u using (ticker)
        left join positions p on p.ticker = l.ticker and p.date = l.date""", "latest", "best", "universe", "positions", **weights(), **ONE_FREQ),
    "ticker_regression_report": report(),
    "purged_folds_row": sql("""select cast(fold as bigint) as fold, role, count(*) as n_rows, min(date) as first_date, max(date) as last_date
        from roles group by all""", "row_places", "roles", **FOLD_ROWS),
    "purged_folds_date": sql("select date, ticker, cast(pos as bigint) as pos, cast(fold as bigint) as fold, role from roles",
                             "date_places", "roles", **FOLD_DATES),
    "fold_leakage": sql("""select cast(fold as bigint) as fold, count(*) filter (role <> 'test') as n_train_plain,
        count(*) filter (role <> 'test' and pos < lo and pos + 5 >= lo) as n_leaking_plain,
        count(*) filter (role = 'train') as n_train_purged,
        count(*) filter (role = 'train' and pos < lo and pos + 5 >= lo) as n_leaking_purged from roles group by all""",
                        "date_places", "roles", **FOLD_DATES),
    "split_summary": split(2, EXTRA_SPLIT),
    "purged_boundary_split": split(1, LATE_DAYS),
}

# means of other spans: one recursion step per row, with the rows since the last value


def means(source, alphas):
    """Recursion over the rows of ``source`` (ticker, date, x): one column per name in ``alphas``."""
    step = lambda n, a: (f"case when t.x is null then e.{n} when e.{n} is null then t.x "  # noqa: E731
                         f"else (pow({1 - a!r}::double, e.gap) * e.{n} + {a!r}::double * t.x) / (pow({1 - a!r}::double, e.gap) + {a!r}::double) end as {n}")
    return f"""with recursive src as ({source}), numbered as (select *, row_number() over (partition by ticker order by date) as rn from src),
    y as (select ticker, rn, {', '.join(f'x as {n}' for n in alphas)}, 1 as gap from numbered where rn = 1
        union all select t.ticker, t.rn, {', '.join(step(n, a) for n, a in alphas.items())}, case when t.x is null then e.gap + 1 else 1 end
        from y e join numbered t on t.ticker = e.ticker and t.rn = e.rn + 1)
    select ticker, date, {r6(*alphas)} from y join numbered using (ticker, rn)"""


def long_oscillators(final, period=14, fast=12, slow=26, signal=9):
    """The oscillators over daily bars with other periods."""
    emas = f"""select ticker, rn, cast(null as double) as g, cast(null as double) as l, close as f, close as s, cast(0 as double) as sig
            from steps where rn = 1
        union all
        select t.ticker, t.rn,
            case when e.rn = 1 then t.gain else e.g * {period - 1} / {period}.0 + t.gain / {period}.0 end,
            case when e.rn = 1 then t.loss else e.l * {period - 1} / {period}.0 + t.loss / {period}.0 end,
            e.f + (t.close - e.f) * 2 / {fast + 1}, e.s + (t.close - e.s) * 2 / {slow + 1},
            e.sig * {1 - 2 / (signal + 1)!r} + {2 / (signal + 1)!r} * ((e.f + (t.close - e.f) * 2 / {fast + 1}) - (e.s + (t.close - e.s) * 2 / {slow + 1}))
        from emas e join steps t on t.ticker = e.ticker and t.rn = e.rn + 1"""
    return sql(final, "daily", "steps", "emas", steps=CTES["steps"].format(bars="daily"), emas=emas)


CTES["lin"] = """select date, ticker, predicted_score as x, fwd_raw_return as y from panel
    where predicted_score is not null and fwd_raw_return is not null"""
CTES["lin_places"] = "select *, dense_rank() over (order by date) - 1 as pos from lin"
CTES["line"] = f"""select regr_slope(y, x) as slope, regr_intercept(y, x) as intercept from lin where date <= '{TRAIN_END}'"""
DEPENDS |= {"lin": ["panel"], "lin_places": ["lin"], "line": ["lin"]}
LINEAR_FOLDS = {"bounds": CTES["bounds"].format(n="count(distinct date)", places="lin_places"),
                "roles": CTES["roles"].format(places="lin_places")}

#: Daily bars in which returned line items have no price
HOLEY = (f"select ticker, date, close as x from (select ticker, date, last(price order by {ORDER}) filter (price is not null) as close from ("
         f"select 'S' || l_suppkey as ticker, cast(l_shipdate as date) as date, case when l_returnflag <> 'R' then {PRICE} end as price, {ORDER} "
         "from lineitem) group by ticker, date)")

ORACLES |= {
    "bars_store": ORACLES["date_range_scan"],
    "vendor_bars": """select ticker, date, round(value, 6) as open, round(value + 1, 6) as high, cast(null as double) as low,
        round(value, 6) as close, cast(1 as double) as volume from (
        select cast(user_id as varchar) as ticker, cast(ts as date) as date, value,
            row_number() over (partition by user_id, cast(ts as date) order by ts, value) as rn from events) where rn = 1""",
    "universe_store": ORACLES["universe_dim"],
    "panel_store": ORACLES["daily_return"],
    "csv_store": ORACLES["portfolio_returns"],
    "missing_tickers": f"""select 'S' || s_suppkey as ticker from supplier where s_suppkey not in (
        select l_suppkey from lineitem where cast(l_shipdate as date) = '{START}')""",
    "ewm_spans": means(sql("select ticker, date, close as x from daily", "daily"),
                       {f"ewm_{n}": 2 / (n + 1) for n in SPANS} | {"ewm_a50": 1 / 50}),
    "ewm_with_gaps": means(HOLEY, {"ewm_20": 2 / 21}),
    "ewm_steep": means(HOLEY, {"ewm_a90": 0.9, "ewm_a999": 0.999, "ewm_a1": 1.0}),
    "rsi_50": long_oscillators("""select ticker, date, round(case when rn >= 51 and l > 1e-12 then 100 - 100 / (1 + g / l) else 50 end, 6) as rsi_50
        from emas join steps using (ticker, rn)""", period=50),
    "macd_50_100": long_oscillators("""select ticker, date, round(f - s, 6) as macd, round(sig, 6) as macd_signal, round(f - s - sig, 6) as macd_hist
        from emas join steps using (ticker, rn)""", fast=50, slow=100),
    "cv_rmse_linear": sql("""select cast(fold as bigint) as fold, round(sqrt(avg(pow(y - intercept - slope * x, 2)) filter (role = 'test')), 6) as rmse,
        count(*) filter (role = 'train') as n_train, count(*) filter (role = 'test') as n_test
        from roles join (select fold, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept from roles where role = 'train' group by fold)
        using (fold) group by fold""", "lin_places", "roles", **LINEAR_FOLDS),
    "scores_linear": sql("select ticker, date, round((select intercept from line) + (select slope from line) * predicted_score, 6) as predicted_score from panel",
                         "panel", "line"),
}

# p-values: the normal distribution by its series, Student's by Simpson's rule over the same angle
def unit_root_p_values(final):
    return sql(f"""select ticker, d, n_obs, round(stat, 6) as stat, round(case when stat > 2.74 then 1 when stat < -18.83 then 0 when stat is null then 1
        else greatest(0, least(1, 0.5 + v * exp(-v * v / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200),
            lambda k: exp(k * ln(greatest(v * v, 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())))))) end, 6) as p_value
        from (select *, greatest(-8.5, least(8.5, case when stat <= -1.61 then 2.1659 + 1.4412 * stat + 0.038269 * stat * stat
            else 1.7339 + 0.93202 * stat - 0.12745 * stat * stat - 0.010368 * stat * stat * stat end)) as v from ({final}))""", "tests", **weights())


ORACLES |= {
    "unit_root_p_values": unit_root_p_values("select ticker, cast(d as double) as d, n_obs, stat from tests"),
    "rank_ic_p_values": sql("""select date, round(ic, 6) as ic, n_stocks, round(case when abs(ic) >= 1 then 0 when ic is not null then greatest(0, least(1,
        1 - 2 / sqrt(pi()) * exp(lgamma((n_stocks - 1) / 2.0) - lgamma((n_stocks - 2) / 2.0)) * u / 6000 * list_sum(list_transform(range(0, 2001),
            lambda i: (case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) * pow(cos(u * i / 2000), n_stocks - 3))))) end, 6) as p_value
        from (select *, asin(least(abs(ic), 1)) as u from ic)""", "ic"),
}

# ridge regression: each setting by the closed form of at most two features, errors row by row
CTES["ridge_rows"] = """select ticker, date, fwd_raw_return as y, [predicted_score, realized_vol_20, daily_return, 0] as x from panel
    where predicted_score is not null and realized_vol_20 is not null and daily_return is not null and fwd_raw_return is not null"""
CTES["ridge_places"] = "select *, dense_rank() over (order by date) - 1 as pos from ridge_rows"
CTES["settings"] = """select (row_number() over (order by s, r) - 1) as candidate, u, v, reg from
    (values (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 1, 2), (4, 1, 3), (5, 2, 3)) sets(s, u, v),
    (values (0, 0::double), (1, 1e-5::double), (2, 1e-4::double), (3, 1e-3::double), (4, 1e-2::double)) regs(r, reg)"""
CTES["ridge_moments"] = """select fold, candidate, u, v, count(*) as n_train, avg(y) as my, avg(x[u]) as mu, avg(x[v]) as mv,
    covar_pop(x[u], x[u]) + reg as suu, covar_pop(x[v], x[v]) + reg as svv, covar_pop(x[u], x[v]) as suv, covar_pop(y, x[u]) as suy,
    covar_pop(y, x[v]) as svy from roles, settings where role = 'train' group by fold, candidate, u, v, reg"""
CTES["ridge_lines"] = """select *, case when v = 4 then suy / suu else (suy * svv - svy * suv) / (suu * svv - suv * suv) end as bu,
    case when v = 4 then 0 else (svy * suu - suy * suv) / (suu * svv - suv * suv) end as bv from ridge_moments"""
CTES["ridge_errors"] = """select candidate, fold, sqrt(avg(pow(y - my - bu * (x[u] - mu) - bv * (x[v] - mv), 2))) as rmse, any_value(n_train) as n_train,
    count(*) as n_test from ridge_lines join roles using (fold) where role = 'test' group by candidate, fold"""
MATERIALIZED |= {"ridge_rows", "roles"}
DEPENDS |= {"ridge_rows": ["panel"], "ridge_places": ["ridge_rows"], "ridge_moments": ["settings"], "ridge_lines": ["ridge_moments"],
            "ridge_errors": ["ridge_lines"]}
RIDGE_FOLDS = {"bounds": CTES["bounds"].format(n="count(distinct date)", places="ridge_places"),
               "roles": CTES["roles"].format(places="ridge_places")}
ORACLES |= {
    "scores_object": ORACLES["scores_linear"],
    "linear_search": sql("""select candidate, cast(fold as bigint) as fold, round(rmse, 6) as rmse, n_train, n_test from ridge_errors""",
                         "ridge_places", "roles", "ridge_errors", **RIDGE_FOLDS),
    "best_linear": sql("select candidate, round(avg(rmse), 6) as mean_rmse from ridge_errors group by candidate",
                       "ridge_places", "roles", "ridge_errors", **RIDGE_FOLDS),
}

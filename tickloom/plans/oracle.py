"""The registered queries as ANSI SQL over the same tables, for checking."""

from __future__ import annotations

DAY = 86_400_000_000_000
DAY_S = 86_400

# The views of `tape_views.py`.
VIEWS = {
    "e_msgs": """
        select event_id as seq, cast(user_id as int) as stock_locate, epoch_us(ts) * 1000 as ts_ns,
          concat('S', cast(user_id as varchar)) as stock, m as msg_type,
          case when m in ('A', 'P') then k end as shares,
          case when m in ('A', 'P') then cast(round(value * 10000) as bigint) end as price_ticks,
          case when m in ('A', 'P')
            then cast(round(value * 10000) as bigint) / 10000.0 end as price,
          case when m = 'A' then event_id end as order_ref,
          case when m in ('A', 'P')
            then case when event_type = 'click' then 'S' else 'B' end end as side,
          case when m = 'R' then substr('QGSN', cast(k % 4 + 1 as int), 1) end as market_cat
        from (select *, cast(props->>'k' as bigint) as k,
            case when event_type = 'purchase' then 'P'
              when event_type in ('view', 'click') then 'A'
              when event_type = 'signup' and user_id % 10 <> 0 then 'R' else 'X' end as m
          from events) z""",
    "e_trades": "select * from e_msgs where msg_type = 'P'",
    "e_adds": "select * from e_msgs where msg_type = 'A'",
    "e_dir": "select distinct stock_locate, stock, market_cat from e_msgs where msg_type = 'R'",
    "e_enriched": """
        select t.seq, t.stock, t.ts_ns, t.shares, t.price_ticks, t.price, d.stock_locate,
          d.market_cat
        from e_trades t join e_dir d on t.stock = d.stock""",
    "e_bars": f"""
        select stock, ts_ns // {DAY} as minute_bucket, cast(sum(shares) as bigint) as volume,
          sum(price_ticks * shares) / nullif(sum(shares), 0) / 10000.0 as vwap,
          sum(price_ticks) / count(price_ticks) / 10000.0 as avg_price, count(*) as trade_count
        from e_trades group by 1, 2""",
    "e_obi": f"""
        select stock, minute_bucket, buy as Buy_Vol, sell as Sell_Vol,
          (buy - sell) / nullif(buy + sell, 0) as OBI
        from (select stock, ts_ns // {DAY} as minute_bucket,
            cast(sum(case when side = 'B' then shares else 0 end) as bigint) as buy,
            cast(sum(case when side = 'S' then shares else 0 end) as bigint) as sell
          from e_adds group by 1, 2) o""",
    "l_trades": """
        select concat('P', cast(l_partkey as varchar)) as stock,
          epoch_us(l_shipdate) * 1000 as ts_ns, l_orderkey as seq,
          cast(l_quantity as bigint) as shares,
          (cast(round(l_extendedprice * 100) as bigint) * 100) // cast(l_quantity as bigint)
            as price_ticks
        from lineitem""",
    "l_dir": """
        select concat('P', cast(p_partkey as varchar)) as stock, p_type as market_cat from part""",
    "l_enriched": "select t.*, d.market_cat from l_trades t join l_dir d on t.stock = d.stock",
    "l_bars": f"""
        select stock, ts_ns // {DAY} as minute_bucket, market_cat,
          cast(sum(shares) as bigint) as volume,
          sum(price_ticks * shares) / nullif(sum(shares), 0) / 10000.0 as vwap,
          sum(price_ticks) / count(price_ticks) / 10000.0 as avg_price, count(*) as trade_count
        from l_enriched group by 1, 2, 3""",
    "b_bars": f"""
        select p_brand as stock, ts_ns // {90 * DAY} as minute_bucket, p_type as market_cat,
          cast(sum(shares) as bigint) as volume,
          sum(price_ticks * shares) / nullif(sum(shares), 0) / 10000.0 as vwap,
          sum(price_ticks) / count(price_ticks) / 10000.0 as avg_price, count(*) as trade_count,
          row_number() over (partition by p_brand order by ts_ns // {90 * DAY}, p_type) as up,
          row_number() over (partition by p_brand order by ts_ns // {90 * DAY} desc, p_type desc) as down
        from l_trades join part on stock = concat('P', cast(p_partkey as varchar)) group by 1, 2, 3""",
    "b_session": """
        select stock, max(avg_price) filter (up = 1) as first_price, max(avg_price) filter (down = 1) as last_price,
          max(vwap) filter (down = 1) as last_vwap, cast(sum(volume) as bigint) as total_volume,
          cast(sum(trade_count) as bigint) as trade_count
        from b_bars group by 1""",
    "e_stats": f"""
        select seq, stock, ts_ns, shares, price, s as timestamp_sec,
          count(price) over w as n, stddev_samp(price) over w as sd,
          sum(price_ticks * shares) over w / nullif(sum(shares) over w, 0) / 10000.0 as vwap,
          max(price) over (partition by stock order by s
            range between 1 following and {DAY_S} following) as future
        from (select *, ts_ns // 1000000000 as s from e_trades) t
        window w as (partition by stock order by s
          range between {DAY_S} preceding and current row)""",
    # Times in whole hours, rows dealt over four files, place = (time, file, offset).
    "t_msgs": """
        select *, ts_ns::hugeint * 10000000000000000000::hugeint + seq as place
        from (select * replace (ts_ns - ts_ns % 3600000000000 as ts_ns,
            (seq % 4) * 1099511627776 + seq // 4 as seq) from e_msgs) m""",
    "t_trades": "select * from t_msgs where msg_type = 'P'",
    "m_rows": """
        select concat('P', cast(l_partkey as varchar)) as stock,
          epoch_us(l_shipdate) // 1000000 as timestamp_sec,
          cast(ceil(l_quantity / 5) * 5 + case when l_quantity > 25 then 20 else 0 end as double)
            as OBI,
          l_discount as Rolling_Volatility, cast(l_linenumber as double) as Trade_Count_Per_Min,
          l_tax as VWAP_Change,
          case when l_quantity > 25 then 1.0::double else 0.0::double end as price_direction
        from lineitem""",
    "e_lagged": """
        select *, lag(vwap) over (partition by stock order by ts_ns, seq) as vwap_prev
        from e_stats""",
    "top50": """
        select stock from (select stock, sum(shares) as v from e_trades group by 1) t
        order by v desc, stock limit 50""",
    "f_obi": f"""
        select stock, bar, (b - s) / (b + s + 1e-9) as obi
        from (select stock, (ts_ns // 1000000000 // {DAY_S}) * {DAY_S} as bar,
            cast(sum(case when side = 'B' then shares else 0 end) as bigint) as b,
            cast(sum(case when side = 'S' then shares else 0 end) as bigint) as s
          from e_adds group by 1, 2) o""",
    "f_rows": f"""
        select l.stock, l.timestamp_sec, coalesce(o.obi, 0.0) as OBI,
          round(l.sd, 6) as Rolling_Volatility, l.n as Trade_Count_Per_Min,
          l.vwap - l.vwap_prev as VWAP_Change,
          case when l.future > l.price then 1.0::double else 0.0::double end as price_direction,
          coalesce(p.obi, 0.0) as obi_before
        from e_lagged l
        left join f_obi o on o.stock = l.stock and o.bar = (l.timestamp_sec // {DAY_S}) * {DAY_S}
        left join f_obi p
          on p.stock = l.stock and p.bar = (l.timestamp_sec // {DAY_S}) * {DAY_S} - {DAY_S}
        where l.stock in (select stock from top50) and l.sd is not null
          and l.vwap - l.vwap_prev is not null""",
}

VIEWS["t_stats"] = VIEWS["e_stats"].replace("e_trades", "t_trades")

# Which views each view reads.
READS = {
    "e_trades": ["e_msgs"],
    "t_msgs": ["e_msgs"],
    "t_trades": ["t_msgs"],
    "t_stats": ["t_trades"],
    "e_adds": ["e_msgs"],
    "e_dir": ["e_msgs"],
    "e_enriched": ["e_trades", "e_dir"],
    "e_bars": ["e_trades"],
    "e_obi": ["e_adds"],
    "b_bars": ["l_trades"],
    "b_session": ["b_bars"],
    "l_enriched": ["l_trades", "l_dir"],
    "l_bars": ["l_enriched"],
    "e_stats": ["e_trades"],
    "e_lagged": ["e_stats"],
    "top50": ["e_trades"],
    "f_obi": ["e_adds"],
    "f_rows": ["e_lagged", "f_obi", "top50"],
}

_DECODED = f"""msg_type, stock_locate, ts_ns % {DAY} as ts_ns, stock, shares, price_ticks, price,
    order_ref, side, market_cat"""

_OPEN_CLOSE = """
    min(price) as low, max(price) as high, arg_min(price, ts_ns) as open,
    arg_max(price, ts_ns) as close,
    sum(price_ticks * shares) / nullif(sum(shares), 0) / 10000.0 as vwap,
    cast(sum(shares) as bigint) as volume"""

_L_SUMMARY = """
    select stock, market_cat, cast(sum(shares) as bigint) as total_volume,
      sum(price_ticks) / count(price_ticks) / 10000.0 as avg_price, count(*) as trade_count
    from l_enriched group by 1, 2"""

_ENRICHED_COLUMNS = "seq, stock, ts_ns, shares, price_ticks, stock_locate, market_cat"

# The newest bar counts even when its VWAP is NULL (no volume), hence arg_max_null.
_CHANGE = """
    (arg_max(avg_price, minute_bucket) - arg_min(avg_price, minute_bucket))"""
_CHANGE_PCT = f"""
    coalesce({_CHANGE} / nullif(arg_min(avg_price, minute_bucket), 0) * 100.0, 0.0)"""

_DIRECTION = "case when d > 0 then '▲' when d < 0 then '▼' else '●' end"

_MIN_BARS = f"""
    select stock, ts_ns // {DAY} as minute_bucket, market_cat,
      cast(sum(shares) as bigint) as volume,
      sum(price_ticks * shares) / nullif(sum(shares), 0) / 10000.0 as vwap,
      sum(price_ticks) / count(price_ticks) / 10000.0 as avg_price, count(*) as trade_count
    from e_enriched group by 1, 2, 3"""

# A feed has times of the day only.
_FEED_HOUR = f"ts_ns % {DAY} // 3600000000000"

# name: (views read directly, select)
SELECTS: dict[str, tuple[list[str], str]] = {
    "decode_messages": (["e_msgs"], f"select seq, {_DECODED} from e_msgs where msg_type <> 'X'"),
    "rejected_frames": (
        ["e_msgs"],
        """select seq, 'other type' as reason, cast(11 as int) as size from e_msgs
           where msg_type = 'X'""",
    ),
    "frame_split": (["e_msgs"], f"select {_DECODED} from e_msgs where msg_type <> 'X'"),
    "frame_split_ranges": (["e_msgs"], f"select {_DECODED} from e_msgs where msg_type <> 'X'"),
    "tape_source_messages": (["e_msgs"], f"select {_DECODED} from e_msgs where msg_type <> 'X'"),
    "tape_source_trades": (
        ["e_msgs"],
        f"select {_DECODED} from e_msgs where msg_type = 'P' and stock in ('S1', 'S2', 'S3', 'S4', 'S5', 'S6', 'S7', 'S8', 'S9')",
    ),
    "prefix_sample": (
        ["e_msgs"],
        f"""select cast(total - size - 2 as bigint) as place, {_DECODED} from (
              select *, sum(size + 2) over (partition by seq // 5000 order by seq) as total from (
                select *, case msg_type when 'R' then 20 when 'X' then 11 else 36 end as size
                from e_msgs) a) b
            where total <= 100000 and msg_type <> 'X'""",
    ),
    "prefix_sample_rows": (
        ["e_msgs"],
        """select seq, size from (
             select seq, size, sum(size + 2) over (order by seq) as total from (
               select seq, cast(case msg_type when 'R' then 20 when 'X' then 11 else 36 end as int)
                 as size from e_msgs) a) b
           where total <= 100000""",
    ),
    "write_partitioned": (
        ["e_msgs"],
        f"""select seq, msg_type, stock_locate, ts_ns, stock, shares, price_ticks, price, order_ref,
              side, market_cat, cast(ts_ns % {DAY} // 3600000000000 as int) as hour
            from e_msgs where msg_type <> 'X'""",
    ),
    "scan_parquet": (
        ["e_enriched"],
        f"""select seq, stock, ts_ns, shares, price,
              cast(ts_ns % {DAY} // 3600000000000 as int) as hour, stock_locate, market_cat
            from e_enriched where market_cat = 'Q'""",
    ),
    "write_signal": (["e_obi"], "select * from e_obi"),
    "summary_csv": (["l_bars"], "select * from l_bars"),
    "stock_summary_csv": (
        ["e_enriched"],
        """select stock, market_cat, cast(sum(shares) as bigint) as total_volume,
             sum(price_ticks) / count(price_ticks) / 10000.0 as avg_price,
             count(*) as trade_count
           from e_enriched group by 1, 2""",
    ),
    "demux": (
        ["e_msgs"],
        "select seq, msg_type, stock, ts_ns from e_msgs where msg_type in ('R', 'A', 'P')",
    ),
    "in_list": (
        ["e_msgs"],
        "select seq, msg_type, price_ticks from e_msgs where msg_type in ('A', 'P')",
    ),
    "trade_columns": (
        ["e_trades"],
        """select cast(stock_locate as bigint) as stock_locate, ts_ns as "timestamp", shares, stock,
             price from e_trades""",
    ),
    "point_filter": (
        ["e_trades"],
        "select seq, stock, ts_ns, shares, price from e_trades where stock = 'S7'",
    ),
    "time_columns": (
        ["e_trades"],
        f"""select seq, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:%M:%S.%f')
              as readable_time,
              cast(ts_ns % {DAY} // 3600000000000 as int) as hour,
              ts_ns // 1000000000 as timestamp_sec, ts_ns // 60000000000 as minute_bucket,
              ts_ns // 60000000000 * 60 as minute_start_sec
            from e_trades""",
    ),
    "minute_bucket_rounded": (
        ["l_trades"],
        f"""select cast(ts_ns / {2 * DAY} as bigint) as minute_bucket, count(*) as trades
            from l_trades group by 1""",
    ),
    "named_keys": (
        ["e_msgs"],
        """select stock, count(*) as messages from e_msgs
           where stock is not null and stock <> '' group by 1""",
    ),
    "complete_rows": (
        ["e_msgs"],
        """select seq, order_ref, side from e_msgs
           where order_ref is not null and side is not null""",
    ),
    "enrich_trades": (["e_enriched"], f"select {_ENRICHED_COLUMNS} from e_enriched"),
    "enrich_trades_salted": (["e_enriched"], f"select {_ENRICHED_COLUMNS} from e_enriched"),
    "enrich_trades_l": (
        ["l_enriched"],
        "select seq, stock, ts_ns, shares, price_ticks, market_cat from l_enriched",
    ),
    "directory_latest": (
        ["e_msgs"],
        """select stock_locate, stock, market_cat from (
             select *, row_number() over (partition by stock order by ts_ns desc, seq desc) as rn
             from e_msgs where msg_type = 'R') r where rn = 1""",
    ),
    "attach_obi": (
        ["e_trades", "e_obi"],
        f"""select t.seq, t.stock, t.ts_ns // {DAY} as minute_bucket, coalesce(o.OBI, 0.0) as OBI
            from e_trades t left join e_obi o
              on o.stock = t.stock and o.minute_bucket = t.ts_ns // {DAY}""",
    ),
    "asof_last_quote": (
        ["e_trades", "e_adds"],
        """select t.seq, t.stock_locate, t.ts_ns, t.price, a.price as last_a_price,
             t.price - a.price as market_impact
           from e_trades t asof left join e_adds a
             on t.stock_locate = a.stock_locate and t.ts_ns >= a.ts_ns""",
    ),
    "asof_last_quote_by_side": (
        ["e_trades", "e_adds"],
        """select t.seq, t.side, t.price, a.price as last_a_price,
             t.price - a.price as market_impact
           from e_trades t asof left join e_adds a
             on t.stock_locate = a.stock_locate and t.side = a.side and t.ts_ns >= a.ts_ns""",
    ),
    "semi_join_topk": (
        ["e_trades"],
        """select seq, stock, ts_ns, shares, price_ticks from e_trades where stock in (
             select stock from (select stock, sum(shares) as v from e_trades group by 1) s
             order by v desc, stock limit 10)""",
    ),
    "directory_distinct": (["e_dir"], "select * from e_dir"),
    "vwap_by_stock": (
        ["l_enriched"],
        """select stock, market_cat,
             sum(price_ticks * shares) / nullif(sum(shares), 0) / 10000.0 as vwap,
             cast(sum(shares) as bigint) as total_volume
           from l_enriched group by 1, 2 order by total_volume desc""",
    ),
    "vwap_by_stock_e": (
        ["e_enriched"],
        """select stock, market_cat,
             sum(price_ticks * shares) / nullif(sum(shares), 0) / 10000.0 as vwap,
             cast(sum(shares) as bigint) as total_volume
           from e_enriched group by 1, 2 order by total_volume desc""",
    ),
    "minute_bars": (["e_enriched"], _MIN_BARS),
    "minute_bars_joined": (["e_enriched"], _MIN_BARS),
    "minute_bars_l": (["l_bars"], "select * from l_bars"),
    "stock_summary": (["l_enriched"], _L_SUMMARY),
    "order_book_imbalance": (["e_obi"], "select * from e_obi"),
    "order_book_imbalance_eps": (
        ["e_adds"],
        f"""select stock, minute_bucket, b as Buy_Vol, s as Sell_Vol,
              (b - s) / (b + s + 1e-9) as OBI
            from (select stock, ts_ns // 1000000000 // {DAY_S} * {DAY_S} as minute_bucket,
                cast(sum(case when side = 'B' then shares else 0 end) as bigint) as b,
                cast(sum(case when side = 'S' then shares else 0 end) as bigint) as s
              from e_adds group by 1, 2) o""",
    ),
    "ohlc_candles": (
        ["e_trades"],
        f"select stock, ts_ns // {DAY} as minute_bucket, {_OPEN_CLOSE} from e_trades group by 1, 2",
    ),
    "ohlc_candles_rounded": (
        ["e_trades"],
        f"""select stock, cast(ts_ns / {DAY} as bigint) as minute_bucket, {_OPEN_CLOSE}
            from e_trades group by 1, 2""",
    ),
    "top_k_by_volume": (
        ["e_trades"],
        """select stock, cast(sum(shares) as bigint) as vol from e_trades group by 1
           order by vol desc, stock limit 10""",
    ),
    "legacy_summary": (
        ["l_trades"],
        """select stock, 'Unknown' as market_cat, cast(sum(shares) as bigint) as total_volume,
             avg(price_ticks) as avg_price, count(*) as trade_count
           from l_trades group by 1""",
    ),
    "legacy_row_index": (
        ["e_trades"],
        """select seq, row_number() over (order by ts_ns, seq) - 1 as minute_bucket,
             shares as volume, 'Unknown' as market_cat from e_trades""",
    ),
    "tickers": (["e_trades"], "select distinct stock from e_trades order by stock"),
    "stock_totals": (
        ["l_bars"],
        """select stock, cast(sum(volume) as bigint) as total_volume,
             cast(sum(trade_count) as bigint) as trade_count,
             sum(volume) / count(volume) as avg_bar_volume
           from l_bars group by 1""",
    ),
    "rolling_volatility": (
        ["e_trades"],
        f"""select seq, stock, ts_ns, price, round(stddev_samp(price) over (
                partition by stock order by ts_ns range between {DAY} preceding and current row), 6)
              as volatility
            from e_trades where stock in (
              select stock from (select stock, sum(shares) as v from e_trades group by 1) s
              order by v desc, stock limit 10)""",
    ),
    "rolling_volatility_l": (
        ["l_trades"],
        f"""select stock, ts_ns, shares, price_ticks, round(stddev_samp(price_ticks / 10000.0) over (
                partition by stock order by ts_ns
                range between {90 * DAY} preceding and current row), 6) as volatility
            from l_trades""",
    ),
    "rolling_volatility_60s": (
        ["e_stats"],
        "select seq, stock, timestamp_sec, round(sd, 6) as Rolling_Volatility from e_stats",
    ),
    "rolling_count_vwap": (
        ["e_stats"],
        """select seq, stock, timestamp_sec, n as Trade_Count_Per_Min, vwap as VWAP
           from e_stats""",
    ),
    "vwap_change": (
        ["e_lagged"],
        """select seq, vwap as VWAP, vwap_prev as VWAP_prev,
             vwap - vwap_prev as VWAP_Change from e_lagged""",
    ),
    "future_max_label": (
        ["e_stats"],
        """select seq, price, future as Future_Max_Price,
             case when future > price then 1.0::double else 0.0::double end as price_direction
           from e_stats""",
    ),
    "bar_pct_change": (
        ["e_bars"],
        """select stock, minute_bucket, avg_price, avg_price / nullif(lag(avg_price) over (
               partition by stock order by minute_bucket), 0) - 1 as pct_change from e_bars""",
    ),
    "tick_direction": (
        ["e_bars"],
        f"""select stock, minute_bucket, avg_price, {_DIRECTION} as direction from (
              select *, avg_price - lag(avg_price) over (
                partition by stock order by minute_bucket) as d from e_bars) b""",
    ),
    "session_change": (
        ["e_bars"],
        f"""select stock, arg_min(avg_price, minute_bucket) as first_price,
              arg_max(avg_price, minute_bucket) as last_price,
              {_CHANGE} as price_change, {_CHANGE_PCT} as price_change_pct,
              case when {_CHANGE_PCT} >= 0 then '▲' else '▼' end as direction
            from e_bars group by 1""",
    ),
    "last_n_bars": (
        ["l_bars"],
        """select stock, minute_bucket, volume,
             least(n, 60) - rn as idx
           from (select *, count(*) over (partition by stock) as n,
               row_number() over (partition by stock order by minute_bucket desc) as rn
             from l_bars) b where rn <= 60""",
    ),
    "latest_row": (
        ["e_obi"],
        """select stock, OBI, minute_bucket from (
             select *, row_number() over (partition by stock order by minute_bucket desc) as rn
             from e_obi) o where rn = 1""",
    ),
    "bar_return_volatility": (
        ["e_bars"],
        """select stock, round(v, 6) as volatility,
             case when v > 0.02 then 'HIGH' when v > 0.01 then 'ELEVATED' else 'NORMAL' end
               as regime
           from (select stock, case when count(*) <= 1 then 0.0::double
                 when not bool_or(coalesce(prev = 0 and avg_price <> 0, false))
                 then stddev_samp(avg_price / nullif(prev, 0) - 1) end as v
             from (select *, lag(avg_price) over (partition by stock order by minute_bucket) as prev
               from e_bars) b group by 1) r""",
    ),
    "abnormal_volume": (
        ["e_bars"],
        """select stock, cast(sum(volume) as bigint) as total_volume,
             sum(volume) / count(volume) as avg_bar_volume,
             sum(volume) > 2 * (sum(volume) / count(volume)) as abnormal
           from e_bars group by 1""",
    ),
    "abnormal_last_bar": (
        ["e_bars"],
        """select stock, cast(sum(volume) as bigint) as total_volume,
             sum(volume) / count(volume) as avg_bar_volume,
             arg_max(volume, minute_bucket) as last_bar_volume,
             arg_max(volume, minute_bucket) > 2 * (sum(volume) / count(volume)) as abnormal
           from e_bars group by 1""",
    ),
    "session_phase": (
        ["e_trades"],
        f"""select stock, hour, count(*) as trade_count, cast(sum(shares) as bigint) as volume,
              case when hour between 9 and 16 then 'OPEN' else 'CLOSED' end as phase
            from (select *, cast(ts_ns % {DAY} // 3600000000000 as int) as hour from e_trades) t
            group by 1, 2""",
    ),
    "key_metrics": (
        ["e_bars"],
        f"""select stock, arg_max(avg_price, minute_bucket) as last_price,
              arg_max_null(vwap, minute_bucket) as last_vwap,
              cast(sum(volume) as bigint) as total_volume,
              cast(sum(trade_count) as bigint) as trade_count,
              {_CHANGE} as price_change, {_CHANGE_PCT} as price_change_pct
            from e_bars group by 1""",
    ),
    "session_change_ties": (
        ["b_session"],
        """select stock, first_price, last_price, last_price - first_price as price_change, c as price_change_pct,
              case when c >= 0 then '▲' else '▼' end as direction
            from (select *, coalesce((last_price - first_price) / nullif(first_price, 0) * 100.0, 0.0) as c from b_session) s""",
    ),
    "key_metrics_ties": (
        ["b_session"],
        """select stock, last_price, last_vwap, total_volume, trade_count, last_price - first_price as price_change,
              coalesce((last_price - first_price) / nullif(first_price, 0) * 100.0, 0.0) as price_change_pct
            from b_session""",
    ),
    "key_metric_labels": (
        ["e_bars"],
        f"""select stock, upper(stock) as ticker, printf('$%.2f', p) as last_price,
              concat(case when c >= 0 then '▲' else '▼' end, ' ', printf('%.2f%%', abs(c)))
                as change,
              format('{{:,}}', v) as total_volume, printf('$%.2f', w) as vwap,
              format('{{:,}}', n) as trade_count
            from (select stock, arg_max(avg_price, minute_bucket) as p,
                arg_max_null(vwap, minute_bucket) as w, cast(sum(volume) as bigint) as v,
                cast(sum(trade_count) as bigint) as n, {_CHANGE_PCT} as c
              from e_bars group by 1) m""",
    ),
    "volume_profile": (
        ["l_bars"],
        "select stock, minute_bucket, market_cat, volume from l_bars",
    ),
    "top_liquidity": (
        ["l_enriched"],
        f"""select *, concat(printf('%.1f', total_volume / 1e6), 'M') as label from (
              {_L_SUMMARY} order by total_volume desc, stock, market_cat limit 10) t""",
    ),
    "trade_tape": (
        ["e_bars"],
        f"""select stock, minute_bucket, volume, vwap, avg_price, trade_count,
              count(*) over (partition by stock) - rn as idx,
              {_DIRECTION} as direction, printf('$%.4f', avg_price) as price_display,
              format('{{:,}}', volume) as volume_display, printf('$%.4f', vwap) as vwap_display
            from (select *, avg_price - lag(avg_price) over (
                partition by stock order by minute_bucket) as d
              from (select *, row_number() over (
                  partition by stock order by minute_bucket desc) as rn
                from e_bars) b where rn <= 10) t""",
    ),
    "trade_tape_full": (
        ["e_bars"],
        f"""select stock, minute_bucket, least(n, 10) - rn as idx, {_DIRECTION} as direction
            from (select *, count(*) over (partition by stock) as n,
                row_number() over (partition by stock order by minute_bucket desc) as rn,
                avg_price - lag(avg_price) over (partition by stock order by minute_bucket) as d
              from e_bars) b where rn <= 10""",
    ),
    "depth_ladder": (
        ["e_adds"],
        """select stock, side, level, price_ticks / 10000.0 as price, size from (
             select *, row_number() over (partition by stock, side
                 order by case when side = 'B' then -price_ticks else price_ticks end) as level
             from (select stock, side, price_ticks, cast(sum(shares) as bigint) as size
               from e_adds group by 1, 2, 3) s) l
           where level <= 5""",
    ),
    "depth_ladder_by_bar": (
        ["e_adds"],
        f"""select stock, side, bar as minute_bucket, level, price_ticks / 10000.0 as price, size from (
             select *, row_number() over (partition by stock, side, bar
                 order by case when side = 'B' then -price_ticks else price_ticks end) as level
             from (select b.stock, b.side, b.bar, a.price_ticks, cast(sum(a.shares) as bigint) as size
               from (select distinct stock, side, ts_ns // {DAY} as bar from e_adds) b
               join e_adds a on a.stock = b.stock and a.side = b.side and a.ts_ns // {DAY} <= b.bar
               group by 1, 2, 3, 4) s) l
           where level <= 5""",
    ),
    "chart_candles": (
        ["e_trades"],
        f"""select stock, ts_ns // {DAY} * {DAY_S} as time, arg_min(price, ts_ns) as open,
              max(price) as high, min(price) as low, arg_max(price, ts_ns) as close
            from e_trades group by 1, 2""",
    ),
    "chart_vwap": (
        ["e_trades"],
        f"""select stock, ts_ns // {DAY} * {DAY_S} as time,
              sum(price_ticks * shares) / nullif(sum(shares), 0) / 10000.0 as value
            from e_trades group by 1, 2""",
    ),
    "obi_histogram": (
        ["e_obi"],
        f"""select stock, minute_bucket * {DAY_S} as time, abs(OBI) as value,
              case when OBI >= 0 then 1 else -1 end as bar_sign,
              case when OBI >= 0 then 'rgba(0, 230, 118, 0.5)' else 'rgba(255, 59, 48, 0.5)' end
                as color
            from e_obi""",
    ),
    "upper_ticker": (
        ["e_trades"],
        "select distinct lower(stock) as stock, upper(lower(stock)) as ticker from e_trades",
    ),
    "signed_obi": (
        ["e_obi"],
        """select stock, minute_bucket, case when OBI > 0 then concat('+', printf('%.4f', OBI))
             when OBI is not null then printf('%.4f', OBI) end as label from e_obi""",
    ),
    "stream_land": (["e_msgs"], f"select {_DECODED} from e_msgs where msg_type <> 'X'"),
    "stream_rejected": (
        ["e_msgs"],
        "select 'other type' as reason, count(*) as frames from e_msgs where msg_type = 'X'",
    ),
    "stream_minute_bars": (["e_enriched"], _MIN_BARS.replace(f"ts_ns // {DAY}", _FEED_HOUR)),
    "stream_order_book_imbalance": (
        ["e_adds"],
        f"""select stock, {_FEED_HOUR} as minute_bucket, cast(sum(case when side = 'B' then shares else 0 end) as bigint) as Buy_Vol,
              cast(sum(case when side = 'S' then shares else 0 end) as bigint) as Sell_Vol,
              (sum(case when side = 'B' then shares else 0 end) - sum(case when side = 'S' then shares else 0 end))
                / nullif(sum(case when side in ('B', 'S') then shares else 0 end), 0) as OBI
            from e_adds group by 1, 2""",
    ),
    "stream_candles": (
        ["e_trades"],
        f"""select stock, {_FEED_HOUR} as minute_bucket, {_OPEN_CLOSE.replace("price, ts_ns)", f"price, ts_ns % {DAY})")}
            from e_trades group by 1, 2""",
    ),
    "landed_columns": (
        ["e_msgs"],
        f"""select seq, msg_type, stock_locate, ts_ns % {DAY} as ts_ns, stock, shares, price_ticks,
              price, order_ref, side, market_cat,
              strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d') as trade_date,
              ts_ns % {DAY} as "timestamp",
              strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:%M:%S.%f') as readable_time,
              cast(ts_ns % {DAY} // 3600000000000 as int) as hour
            from e_msgs where msg_type <> 'X'""",
    ),
    "row_counts": (
        ["e_msgs"],
        """select k.msg_type, count(m.seq) as rows, count(m.seq) = 0 as is_empty
           from (select unnest(['R', 'A', 'P', 'X', 'D']) as msg_type) k left join e_msgs m using (msg_type) group by 1""",
    ),
    "directory_latest_ties": (
        ["t_msgs"],
        """select stock_locate, stock, market_cat from (
             select *, row_number() over (partition by stock order by ts_ns desc, seq desc) as rn
             from t_msgs where msg_type = 'R') r where rn = 1""",
    ),
    "asof_ties": (
        ["t_msgs"],
        """select t.seq, t.stock_locate, t.ts_ns, t.price, a.price as last_a_price,
             t.price - a.price as market_impact
           from (select * from t_msgs where msg_type = 'P') t
           asof left join (select * from t_msgs where msg_type = 'A') a
             on t.stock_locate = a.stock_locate and t.place >= a.place""",
    ),
    "ohlc_candles_ties": (
        ["t_trades"],
        f"""select stock, ts_ns // {DAY} as minute_bucket,
              {_OPEN_CLOSE.replace("price, ts_ns", "price, place")} from t_trades group by 1, 2""",
    ),
    "vwap_change_ties": (
        ["t_stats"],
        """select seq, vwap as VWAP, p as VWAP_prev, vwap - p as VWAP_Change
           from (select *, lag(vwap) over (partition by stock order by ts_ns, seq) as p
             from t_stats) l""",
    ),
    "minute_bars_two_days": (
        ["e_trades"],
        f"""select strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d') as trade_date, stock,
              ts_ns % {DAY} // 3600000000000 as minute_bucket, 'Q' as market_cat,
              cast(sum(shares) as bigint) as volume,
              sum(price_ticks * shares) / nullif(sum(shares), 0) / 10000.0 as vwap,
              sum(price_ticks) / count(price_ticks) / 10000.0 as avg_price, count(*) as trade_count
            from e_trades group by 1, 2, 3""",
    ),
    "rolling_two_days": (
        ["e_trades"],
        f"""select seq, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d') as trade_date, stock,
              ts_ns % {DAY} as ts_ns,
              round(stddev_samp(price) over (partition by ts_ns // {DAY}, stock
                order by ts_ns range between {DAY // 4} preceding and current row), 6) as volatility
            from e_trades""",
    ),
    "assembled": (
        ["m_rows"],
        """select stock, timestamp_sec, OBI, Rolling_Volatility, Trade_Count_Per_Min, VWAP_Change
           from m_rows""",
    ),
    "train_score": (
        ["m_rows"],
        """select price_direction as label, price_direction as prediction, count(*) as n,
             1.0::double as accuracy, 1.0::double as weightedPrecision
           from m_rows
           where timestamp_sec > (select quantile_disc(timestamp_sec, 0.8) from m_rows)
           group by 1""",
    ),
    "q_tickers": (["l_trades"], "select distinct stock from l_trades order by stock"),
    "q_summary": (
        ["e_enriched"],
        """select stock, market_cat, cast(sum(shares) as bigint) as total_volume,
             sum(price_ticks) / count(price_ticks) / 10000.0 as avg_price, count(*) as trade_count
           from e_enriched group by 1, 2 order by total_volume desc""",
    ),
    "q_candles": (
        ["e_enriched"],
        f"""select stock, ts_ns // {DAY} as minute_bucket, {_OPEN_CLOSE}
            from e_enriched where stock = 'S7' group by 1, 2 order by 2""",
    ),
    "obi_series": (
        ["e_obi"],
        """select stock, minute_bucket, OBI, Buy_Vol, Sell_Vol from e_obi where stock = 'S7'
           order by minute_bucket""",
    ),
    "sentiment": (
        ["e_msgs", "e_obi"],
        """select stock, obi, score as sentiment_score,
             case when score > 65 then 'BULLISH' when score < 35 then 'BEARISH' else 'NEUTRAL' end
               as status
           from (select stock, obi,
               cast(greatest(0.0, least(100.0, 50 + 50 * obi)) as double) as score
             from (select s.stock, cast(coalesce(o.OBI, 0.0) as double) as obi
               from (select distinct stock from e_msgs) s
               left join (select stock, OBI, row_number() over (
                   partition by stock order by minute_bucket desc) as rn from e_obi) o
                 on o.stock = s.stock and o.rn = 1) b) c""",
    ),
    "build_features": (
        ["f_rows"],
        """select stock, timestamp_sec, OBI, Rolling_Volatility, Trade_Count_Per_Min,
             VWAP_Change, price_direction from f_rows""",
    ),
    "build_features_lagged": (
        ["f_rows"],
        """select stock, timestamp_sec, obi_before as OBI, Rolling_Volatility,
             Trade_Count_Per_Min, VWAP_Change, price_direction from f_rows""",
    ),
    "chrono_split": (
        ["f_rows"],
        """select stock, timestamp_sec,
             case when timestamp_sec <= (select quantile_disc(timestamp_sec, 0.8) from f_rows)
               then 'train' else 'test' end as part
           from f_rows""",
    ),
}


def _with_views(names: list[str]) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for read in READS.get(name, []):
            add(read)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "with " + ",\n".join(f"{name} as ({VIEWS[name]})" for name in ordered)


# The table functions answer like the queries they are made of.
SELECTS |= {
    "sql_tickers": (["e_msgs"], "select distinct stock from e_msgs order by stock"),
    "sql_summary": SELECTS["q_summary"],
    "sql_candles": SELECTS["q_candles"],
    "sql_obi_series": SELECTS["obi_series"],
    "sql_sentiment": SELECTS["sentiment"],
}


def oracle_sql() -> dict[str, str]:
    return {name: f"{_with_views(views)}\n{sql}" for name, (views, sql) in SELECTS.items()}

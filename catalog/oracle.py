"""The catalog's questions as SQL over the same tables.

Written from the meaning of each question, with none of the library's rewrites:
plain windows, quantile functions and self joins.
"""

from __future__ import annotations

from .queries import EVENT_TYPES, LINE_MEASURES, TEN_MEASURES, WINDOWS
from .views import SPOILT_EVERY

_WEEKDAYS = "['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday']"
_SEASONS = "['Summer','Autumn','Winter','Spring']"


def _mean(x: str, where: str | None = None) -> str:
    """Mean of values with two decimals, as the engine adds decimals."""
    keep = f" FILTER (WHERE {where})" if where else ""
    return f"AVG(CAST({x} AS DECIMAL(18, 2))){keep}"


def _round(x: str, digits: int) -> str:
    """Round half away from zero on the decimal, not on the binary value."""
    return f"CAST(ROUND(CAST({x} AS DECIMAL(30,10)), {digits}) AS DOUBLE)"


def _season(ts: str) -> str:
    return (
        f"CASE WHEN MONTH({ts}) IN (12,1,2) THEN 'Summer' WHEN MONTH({ts}) IN (3,4,5) THEN 'Autumn'"
        f" WHEN MONTH({ts}) IN (6,7,8) THEN 'Winter' ELSE 'Spring' END"
    )


def _features(ts: str) -> str:
    return (
        f"CAST(YEAR({ts}) AS INTEGER) AS year, CAST(MONTH({ts}) AS INTEGER) AS month,"
        f" CAST(DAY({ts}) AS INTEGER) AS day, CAST(HOUR({ts}) AS INTEGER) AS hour,"
        f" DAYNAME({ts}) AS day_of_week, {_season(ts)} AS season"
    )


_WIDE_SLOTS = ", ".join(_mean("value", f"event_type = '{t}'") + f" AS {t}" for t in EVENT_TYPES)
WIDE = (
    "slots AS (SELECT time_bucket(INTERVAL '10 minutes', ts) AS timestamp, "
    f"{_WIDE_SLOTS} FROM events GROUP BY 1),"
    f" wide AS (SELECT *, {_features('timestamp')} FROM slots)"
)
READINGS = (
    "readings AS (SELECT event_id AS record_number, ts AS timestamp, value,"
    f" {_features('ts')} FROM events)"
)
LONG = (
    "long_range AS (SELECT l_orderkey AS record_number, l_shipdate AS timestamp, l_linenumber,"
    f" {', '.join(LINE_MEASURES)}, {_features('l_shipdate')} FROM lineitem)"
)
_READING = "timestamp, record_number, l_linenumber, l_extendedprice, l_quantity"
_FORTY = (
    f"WITH {LONG}, forty AS (SELECT record_number % 40 AS series, timestamp, record_number, l_linenumber,"
    " l_quantity, l_extendedprice FROM long_range)"
)
_EVENT_TABLE = (
    "event_table AS (SELECT event_id AS event, ts AS start,"
    " ts + to_seconds(CAST(floor(value) AS BIGINT) * 10) AS \"end\" FROM events)"
)
ORDERS = (
    "readings AS (SELECT o_orderkey AS record_number, o_orderdate AS timestamp, o_totalprice,"
    f" {_features('o_orderdate')} FROM orders)"
)


def _days(view: str, column: str, mean: str | None = None) -> str:
    return (
        f"days AS (SELECT CAST(timestamp AS DATE) AS date, {mean or _mean(column)} AS value"
        f" FROM {view} WHERE {column} IS NOT NULL GROUP BY 1)"
    )


def _calendar(view: str, columns: dict[str, str]) -> str:
    means = ", ".join(f"{_mean(c)} AS {name}" for name, c in columns.items())
    names = ", ".join(columns)
    return (
        f"present AS (SELECT CAST(timestamp AS DATE) AS date, {means} FROM {view} GROUP BY 1),"
        " bounds AS (SELECT MIN(date) AS a, MAX(date) AS b FROM present),"
        " spine AS (SELECT CAST(UNNEST(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds),"
        f" days AS (SELECT date, {names} FROM spine LEFT JOIN present USING (date))"
    )


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _long(view: str, columns, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return "vals AS (" + _union(
        f"SELECT {lead}'{c}' AS parameter, {c} AS value FROM {view} WHERE {c} IS NOT NULL"
        for c in columns
    ) + ")"


def _describe(view: str, columns, mean) -> str:
    return _union(
        f"SELECT '{c}' AS parameter, COUNT({c}) AS count, {_round(mean(c), 4)} AS mean,"
        f" {_round(f'STDDEV_SAMP({c})', 4)} AS std, {_round(f'MIN({c})', 4)} AS min,"
        f" {_round(f'QUANTILE_CONT({c}, 0.25)', 4)} AS q25, {_round(f'QUANTILE_CONT({c}, 0.5)', 4)} AS q50,"
        f" {_round(f'QUANTILE_CONT({c}, 0.75)', 4)} AS q75, {_round(f'MAX({c})', 4)} AS max,"
        f" {_round(f'100.0 * (COUNT(*) - COUNT({c})) / COUNT(*)', 4)} AS missing_pct FROM {view}"
        for c in columns
    )


def _boxes(by: str = "") -> str:
    lead, join = (f"{by}, ", f"({by}, parameter)") if by else ("", "(parameter)")
    return (
        f"q AS (SELECT {lead}parameter, COUNT(*) AS n, QUANTILE_CONT(value, 0.25) AS q1,"
        " QUANTILE_CONT(value, 0.5) AS q2, QUANTILE_CONT(value, 0.75) AS q3 FROM vals"
        f" GROUP BY ALL), f AS (SELECT *, q1 - (q3 - q1) * 1.5 AS lo, q3 + (q3 - q1) * 1.5 AS hi FROM q),"
        f" boxes AS (SELECT {lead}parameter, ANY_VALUE(n) AS count,"
        f" {_round('LEAST(MIN(value) FILTER (WHERE value BETWEEN lo AND hi), ANY_VALUE(q1))', 4)} AS whisker_low,"
        f" {_round('ANY_VALUE(q1)', 4)} AS q25, {_round('ANY_VALUE(q2)', 4)} AS q50,"
        f" {_round('ANY_VALUE(q3)', 4)} AS q75,"
        f" {_round('GREATEST(MAX(value) FILTER (WHERE value BETWEEN lo AND hi), ANY_VALUE(q3))', 4)} AS whisker_high,"
        " COUNT(*) FILTER (WHERE value NOT BETWEEN lo AND hi) AS outliers"
        f" FROM vals JOIN f USING {join} GROUP BY ALL)"
    )


def _histogram(view: str, columns, bins: int) -> str:
    return (
        f"WITH {_VIEWS[view]}, {_long(view, columns)},"
        f" ext AS (SELECT parameter, MIN(value) AS lo, MAX(value) AS hi, (MAX(value) - MIN(value)) / {bins}.0 AS w"
        " FROM vals GROUP BY 1),"
        f" edges AS (SELECT parameter, CAST(b AS BIGINT) AS bin, lo + b * w AS bin_from,"
        f" CASE WHEN b = {bins - 1} THEN hi ELSE lo + (b + 1) * w END AS bin_to"
        f" FROM ext, range({bins}) AS r(b))"
        f" SELECT e.parameter, e.bin, {_round('e.bin_from', 6)} AS bin_from, {_round('e.bin_to', 6)} AS bin_to,"
        " COUNT(v.value) AS readings FROM edges e LEFT JOIN vals v ON v.parameter = e.parameter"
        f" AND v.value >= e.bin_from AND (v.value < e.bin_to OR (e.bin = {bins - 1} AND v.value <= e.bin_to))"
        " GROUP BY e.parameter, e.bin, e.bin_from, e.bin_to"
    )


_VIEWS = {"wide": WIDE, "readings": READINGS, "long_range": LONG}


def _lead(view: str) -> str:
    return f"WITH {_VIEWS[view]} "


def _flagged() -> str:
    columns = {c: c for c in LINE_MEASURES}
    return (
        f"WITH {LONG}, {_calendar('long_range', columns)}, vals AS ("
        + _union(f"SELECT '{c}' AS parameter, {i} AS i, date, {c} AS value FROM days" for i, c in enumerate(LINE_MEASURES))
        + "), s AS (SELECT parameter, AVG(value) AS m, STDDEV_SAMP(value) AS sd FROM vals GROUP BY 1),"
        " flagged AS (SELECT parameter, i, date, value, COALESCE(ABS((value - m) / NULLIF(sd, 0)) > 3, FALSE)"
        " AS is_flagged FROM vals JOIN s USING (parameter)),"
        " counts AS (SELECT parameter, i, COUNT(*) FILTER (WHERE is_flagged) AS flagged_days FROM flagged GROUP BY ALL)"
    )


def _gaps(view_sql: str, extra: str) -> str:
    return (
        f"WITH {view_sql}, g AS (SELECT timestamp, epoch_us(timestamp) - LAG(epoch_us(timestamp))"
        f" OVER (ORDER BY timestamp) AS us FROM {extra} WHERE timestamp IS NOT NULL)"
    )


def _corr(a: str, b: str, view: str) -> str:
    return f"SELECT '{a}' AS column_a, '{b}' AS column_b, CORR({a}, {b}) AS r FROM {view}"


def _pairs(columns):
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]


def _matrix() -> str:
    parts = [_corr(a, b, "long_range") for a, b in _pairs(LINE_MEASURES)]
    parts += [_corr(b, a, "long_range") for a, b in _pairs(LINE_MEASURES)]
    parts += [f"SELECT '{c}', '{c}', 1.0 FROM range(1)" for c in LINE_MEASURES]
    return f"WITH {LONG}, m AS ({_union(parts)}) SELECT column_a, column_b, {_round('r', 6)} AS r FROM m"


def _streaks(days_sql: str, flag: str, by_gap: bool = False) -> str:
    island = ", date - CAST(ROW_NUMBER() OVER (ORDER BY date) AS INTEGER) AS island" if by_gap else ""
    key = "run, island" if by_gap else "run"
    return (
        f"{days_sql}, f AS (SELECT date, value, COALESCE({flag}, FALSE) AS hot FROM days),"
        f" g AS (SELECT *, SUM(CASE WHEN hot THEN 0 ELSE 1 END) OVER (ORDER BY date) AS run{island} FROM f)"
        " SELECT MIN(date) AS streak_start, MAX(date) AS streak_end, COUNT(*) AS streak_length_days,"
        f" {_round('AVG(value)', 6)} AS streak_mean FROM g WHERE hot GROUP BY {key} HAVING COUNT(*) >= 2"
    )


_START, _END, _ = WINDOWS[0]
_START2, _END2, _ = WINDOWS[1]
_KEY = "record_number, l_linenumber"
_REPEATED = f"rep AS (SELECT {_KEY}, COUNT(*) AS occurrences FROM long_range GROUP BY ALL HAVING COUNT(*) > 1)"


def _missing(columns, where: str = "") -> str:
    return f"{_lead('wide')}SELECT * FROM (" + _union(
        f"SELECT '{c}' AS parameter, COUNT(*) - COUNT({c}) AS missing_count,"
        f" {_round(f'100.0 * (COUNT(*) - COUNT({c})) / COUNT(*)', 2)} AS missing_pct FROM wide"
        for c in columns
    ) + f") AS m{where}"


def _overview() -> str:
    types = {"timestamp": "timestamp_ntz", **{t: "double" for t in EVENT_TYPES}, "day_of_week": "string"}
    return _lead("wide") + _union(
        f"SELECT '{c}' AS \"column\", {i} AS position, '{t}' AS dtype, COUNT(*) AS total_rows,"
        f" COUNT({c}) AS non_null FROM wide"
        for i, (c, t) in enumerate(types.items(), 1)
    )


def _gate(view_sql: str, view: str, raw: str, where: str = "TRUE", time: str = "timestamp") -> str:
    """The checks of rows of a view against the rows of the raw table."""
    return (
        f"WITH {view_sql}, c AS (SELECT *, {time} AS checked_time FROM {view} WHERE {where}),"
        " f AS (SELECT COUNT(*) AS n, COUNT(*) - COUNT(DISTINCT record_number) AS rep,"
        " COUNT(*) FILTER (WHERE season IS NULL) AS no_season, COUNT(DISTINCT season) AS seasons,"
        " BOOL_AND(typeof(checked_time) LIKE 'TIMESTAMP%') AS typed FROM c)"
        f" SELECT 'row_count_unchanged' AS \"check\", n = (SELECT COUNT(*) FROM {raw}) AS passed, n AS detail FROM f"
        " UNION ALL SELECT 'key_unique', rep = 0, rep FROM f"
        " UNION ALL SELECT 'timestamp_typed', typed, CASE WHEN typed THEN 0 ELSE 1 END FROM f"
        " UNION ALL SELECT 'season_present', no_season = 0, no_season FROM f"
        " UNION ALL SELECT 'seasons_complete', seasons = 4, seasons FROM f"
    )


def _rejects_gate() -> str:
    """The gate over the orders whose line fits the header; the spoilt ones are too many."""
    fits = f"record_number % {SPOILT_EVERY} > 2"
    report = _gate(ORDERS, "readings", "orders", fits)
    counted = f"(SELECT COUNT(*) FROM orders WHERE o_orderkey % {SPOILT_EVERY} <= 2)"
    return (
        report.replace("n = (SELECT COUNT(*) FROM orders)", f"n = (SELECT COUNT(*) FROM orders) - {counted}")
        + f" UNION ALL SELECT 'rows_rejected', {counted} <= 3, {counted} FROM f"
    )


def _summary(where: str = "TRUE") -> str:
    """Headline numbers of a cleaning that keeps the rows of ``where``."""
    return (
        f"WITH {LONG}, f AS (SELECT COUNT(*) AS n, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT"
        f" {_KEY} FROM long_range)) AS copies, COUNT(*) - COUNT(DISTINCT record_number) AS rep FROM long_range),"
        " c AS (SELECT COUNT(*) AS n,"
        " COUNT(*) FILTER (WHERE l_quantity < 2 OR l_quantity > 49 OR l_discount > 0.09 OR l_tax < 0) AS bad"
        f" FROM long_range WHERE {where}) SELECT 'Original records' AS metric, n AS value FROM f"
        " UNION ALL SELECT 'Fully duplicated rows found', copies FROM f"
        " UNION ALL SELECT 'Duplicate record numbers found', rep FROM f"
        " UNION ALL SELECT 'Rows failing plausibility checks', bad FROM c"
        " UNION ALL SELECT 'Records removed during cleaning', f.n - c.n FROM f, c"
        " UNION ALL SELECT 'Final records', n FROM c"
    )


def _ten() -> str:
    """Every pair of ten measures with holes, by the engine's own correlation."""
    measures = ", ".join(
        f"CASE WHEN l_orderkey % 7 <> {i % 7} THEN CAST({x} AS DOUBLE) END AS m{i}"
        for i, x in enumerate(TEN_MEASURES)
    )
    pairs = _union(
        f"SELECT 'm{i}' AS column_a, 'm{j}' AS column_b, {_round(f'CORR(m{i}, m{j})', 6)} AS r FROM t"
        for i in range(10) for j in range(i + 1, 10)
    )
    return f"WITH t AS (SELECT {measures} FROM lineitem) {pairs}"


def _monthly() -> str:
    parts = []
    for c in ("l_quantity", "l_extendedprice", "l_tax"):
        parts += [
            f"{_round(_mean(c), 2)} AS {c}_mean", f"{_round(f'MIN({c})', 2)} AS {c}_min",
            f"{_round(f'MAX({c})', 2)} AS {c}_max",
        ]
    return f"{_lead('long_range')}SELECT year, month, {', '.join(parts)} FROM long_range GROUP BY year, month"


def _grouped(view: str, by: str, columns, digits: int = 2) -> str:
    means = ", ".join(f"{_round(_mean(c), digits)} AS {c}_mean" for c in columns)
    return f"{_lead(view)}SELECT {by}, COUNT(*) AS reading_count, {means} FROM {view} GROUP BY {by}"


def _shape() -> str:
    means = ", ".join(f"{_mean(c)} AS {c}" for c in LINE_MEASURES)
    scaled = ", ".join(
        _round(f"({c} - MIN({c}) OVER ()) / NULLIF(MAX({c}) OVER () - MIN({c}) OVER (), 0)", 6) + f" AS {c}"
        for c in LINE_MEASURES
    )
    return f"WITH {LONG}, m AS (SELECT month, {means} FROM long_range GROUP BY 1) SELECT month, {scaled} FROM m"


ORACLE: dict[str, str] = {
    "row_count": "SELECT COUNT(*) AS total_rows FROM events",
    "filtered_row_count": f"{_lead('long_range')}SELECT COUNT(*) FILTER (WHERE season IN ('Summer', 'Winter'))"
        " AS filtered_rows, COUNT(*) AS total_rows FROM long_range",
    "extent": "SELECT MIN(ts) AS first_reading, MAX(ts) AS last_reading,"
        " (epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / CAST(1000000 AS DOUBLE) AS span_seconds FROM events",
    "table_overview": _overview(),
    "first_readings": f"{_lead('readings')}SELECT record_number, timestamp, value FROM readings"
        " ORDER BY timestamp, record_number LIMIT 5",
    "last_readings": f"{_lead('readings')}SELECT record_number, timestamp, value FROM readings"
        " ORDER BY timestamp DESC, record_number DESC LIMIT 5",
    "distinct_seasons": f"{_lead('long_range')}SELECT DISTINCT season FROM long_range",
    "distinct_weekdays": f"{_lead('long_range')}SELECT DISTINCT day_of_week FROM long_range",
    "distinct_year_months": f"{_lead('long_range')}SELECT DISTINCT year, month FROM long_range",
    "clean_readings": "SELECT ts AS timestamp, event_id AS record_number,"
        " CASE WHEN event_type <> 'error' THEN value END AS temperature,"
        " CASE WHEN event_type = 'view' THEN value END AS turbidity,"
        " CAST(user_id AS DOUBLE) AS temperature_quality, event_type AS \"Station note\","
        f" {_features('ts')} FROM events",
    "chronological_readings": f"{_lead('readings')}SELECT record_number, timestamp, value FROM readings"
        " ORDER BY timestamp, record_number",
    **dict.fromkeys(
        ("materialized_orders", "materialized_again", "clean_csv_orders", "saved_table_orders", "ingested_in_drops"),
        f"WITH {ORDERS} SELECT record_number, timestamp,"
        " CASE WHEN record_number % 10 > 0 THEN o_totalprice END AS turbidity,"
        " year, month, day, hour, day_of_week, season FROM readings",
    ),
    "quarantined_rows": "SELECT CAST(o_orderkey % 2 AS INT) AS drop, CASE o_orderkey % "
        f"{SPOILT_EVERY} WHEN 0 THEN concat_ws(',', o_orderdate, o_orderkey)"
        " WHEN 1 THEN concat_ws(',', o_orderdate, o_orderkey, o_totalprice, 'again')"
        " ELSE concat('\"', concat_ws(',', o_orderdate, o_orderkey, o_totalprice)) END AS text"
        f" FROM orders WHERE o_orderkey % {SPOILT_EVERY} <= 2",
    "materialized_with_rejects": f"WITH {ORDERS} SELECT record_number, timestamp, o_totalprice AS turbidity,"
        f" year, month, day, hour, day_of_week, season FROM readings WHERE record_number % {SPOILT_EVERY} > 2",
    "clean_gate_report_rejects": _rejects_gate(),
    "time_features": f"{_lead('readings')}SELECT * FROM readings",
    "time_features_long_range": f"{_lead('long_range')}SELECT {_KEY}, timestamp, year, month, day, hour,"
        " day_of_week, season FROM long_range",
    "ordered_categories": f"WITH {LONG}, c AS (SELECT season, CASE WHEN day_of_week NOT IN ('Saturday', 'Sunday')"
        " THEN day_of_week END AS working_day, COUNT(*) AS reading_count FROM long_range GROUP BY ALL)"
        f" SELECT *, CAST(list_position({_SEASONS}, season) AS BIGINT) AS season_position,"
        f" CAST(CASE WHEN working_day IS NULL THEN 0 ELSE list_position({_WEEKDAYS}, working_day) END AS BIGINT)"
        " AS day_position FROM c",
    "present_measures": f"{_lead('wide')}SELECT {', '.join(EVENT_TYPES)} FROM wide",
    "selected_seasons": f"{_lead('long_range')}SELECT {_KEY}, season, l_quantity FROM long_range"
        " WHERE season IN ('Autumn', 'Spring')",
    "rows_with_values": f"{_lead('wide')}SELECT timestamp, purchase FROM wide WHERE purchase IS NOT NULL",
    "event_readings": f"{_lead('readings')}SELECT record_number, timestamp, value FROM readings"
        f" WHERE timestamp BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{_END}'",
    "event_readings_whole_days": f"{_lead('readings')}SELECT record_number, timestamp, value FROM readings"
        f" WHERE CAST(timestamp AS DATE) BETWEEN DATE '{_START2[:10]}' AND DATE '{_END2[:10]}'",
    "high_daytime_readings": f"{_lead('readings')}SELECT record_number, hour, value FROM readings"
        " WHERE value > 60 AND hour >= 6 AND hour < 18",
    "annotate_events": f"WITH {READINGS}, {_calendar('readings', {'value': 'value'})}, w(a, b, event_label) AS (VALUES "
        + ", ".join(f"(DATE '{a[:10]}', DATE '{b[:10]}', '{label}')" for a, b, label in WINDOWS)
        + ") SELECT date, value, event_label FROM days d LEFT JOIN w ON d.date BETWEEN w.a AND w.b",
    "annotate_event_table": f"WITH {READINGS}, {_calendar('readings', {'value': 'value'})}, {_EVENT_TABLE}"
        " SELECT date, value, event AS event_label FROM days d LEFT JOIN (SELECT * FROM event_table WHERE event % 50 = 7) w"
        " ON d.date BETWEEN CAST(w.start AS DATE) AND CAST(w.\"end\" AS DATE)",
    "event_table_means": f"WITH {READINGS}, {_EVENT_TABLE}, m AS (SELECT event, COUNT(*) AS readings,"
        f" {_round(_mean('value'), 4)} AS value_mean FROM event_table w JOIN readings r"
        " ON r.timestamp BETWEEN w.start AND w.\"end\" GROUP BY event)"
        " SELECT w.event, w.start, w.\"end\", COALESCE(readings, 0) AS readings, value_mean"
        " FROM event_table w LEFT JOIN m ON w.event = m.event",
    "null_counts_wide": f"{_lead('wide')}SELECT COUNT(*) AS total_rows, "
        + ", ".join(f"COUNT(*) - COUNT({t}) AS null_{t}" for t in EVENT_TYPES) + " FROM wide",
    "missing_pct_long": _missing(EVENT_TYPES),
    "missing_all_columns": _missing(
        ["timestamp", *EVENT_TYPES, "year", "month", "day", "hour", "day_of_week", "season"],
        " WHERE missing_count >= 1",
    ),
    "missing_pct_by_period": f"{_lead('wide')}SELECT month, day, "
        + ", ".join(_round(f"100.0 * (COUNT(*) - COUNT({t})) / COUNT(*)", 1) + f" AS {t}" for t in EVENT_TYPES)
        + " FROM wide GROUP BY month, day",
    "missing_pct_by_month": f"{_lead('wide')}SELECT year, month,"
        f" {_round('100.0 * (COUNT(*) - COUNT(click)) / COUNT(*)', 4)} AS missing_pct,"
        " make_date(year, month, 1) AS period FROM wide GROUP BY year, month",
    "missing_pct_filtered": f"{_lead('wide')}SELECT {_round('100.0 * (COUNT(*) - COUNT(click)) / COUNT(*)', 4)}"
        " AS missing_pct FROM wide WHERE hour >= 6 AND hour < 18",
    "all_missing_rows": f"{_lead('wide')}SELECT COUNT(*) AS fully_empty_measurement_rows FROM wide"
        " WHERE click IS NULL AND view IS NULL",
    "full_duplicate_rows": f"WITH {LONG}, {_REPEATED} SELECT {_KEY} FROM long_range JOIN rep USING ({_KEY})",
    "excess_duplicates": f"{_lead('long_range')}SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {_KEY}"
        " FROM long_range)) AS excess_rows FROM long_range",
    "excess_record_numbers": f"{_lead('long_range')}SELECT COUNT(*) - COUNT(DISTINCT record_number) AS excess_rows"
        " FROM long_range",
    "excess_timestamps": f"{_lead('long_range')}SELECT COUNT(*) - COUNT(DISTINCT timestamp) AS excess_rows"
        " FROM long_range",
    "duplicate_id_rows": f"WITH {LONG}, {_REPEATED} SELECT {_KEY}, timestamp, l_extendedprice"
        f" FROM long_range JOIN rep USING ({_KEY})",
    "duplicate_id_groups": f"WITH {LONG}, {_REPEATED} SELECT * FROM rep",
    "top_repeated_timestamps": f"{_lead('long_range')}SELECT timestamp, COUNT(*) AS occurrences FROM long_range"
        " GROUP BY timestamp HAVING COUNT(*) > 1 ORDER BY occurrences DESC, timestamp LIMIT 10",
    "rows_sharing_timestamp": f"{_lead('long_range')}SELECT timestamp, {_KEY}, l_extendedprice FROM long_range"
        " WHERE timestamp IN (SELECT timestamp FROM long_range GROUP BY 1 HAVING COUNT(*) > 1)"
        f" ORDER BY timestamp, {_KEY}, l_extendedprice LIMIT 10",
    "range_check_report": f"{_lead('long_range')}SELECT 'quantity_outside' AS \"check\","
        " COUNT(*) FILTER (WHERE l_quantity < 2 OR l_quantity > 49) AS failing_rows FROM long_range"
        " UNION ALL SELECT 'discount_high', COUNT(*) FILTER (WHERE l_discount > 0.09) FROM long_range"
        " UNION ALL SELECT 'negative_values', COUNT(*) FILTER (WHERE l_quantity < 0 OR l_tax < 0) FROM long_range",
    "implausible_rows": f"{_lead('long_range')}SELECT COUNT(*) FILTER (WHERE l_quantity < 2 OR l_quantity > 49"
        " OR l_discount > 0.09 OR l_tax < 0) AS failing_rows FROM long_range",
    "negative_value_rows": "SELECT COUNT(*) AS negative_value_rows FROM customer WHERE c_acctbal < 0 OR c_nationkey < 0",
    "min_max_ranges": _lead("long_range") + _union(
        f"SELECT '{c}' AS parameter, MIN({c}) AS min, MAX({c}) AS max FROM long_range" for c in LINE_MEASURES
    ),
    "clean_gate_report": _gate(LONG, "long_range", "lineitem"),
    "clean_gate_report_orders": _gate(ORDERS, "readings", "orders"),
    "clean_gate_report_lost_rows": _gate(LONG, "long_range", "lineitem", "l_quantity > 1"),
    "clean_gate_report_untyped": _gate(ORDERS, "readings", "orders", time="CAST(timestamp AS VARCHAR)"),
    "quality_summary": _summary(),
    "quality_summary_removed": _summary("l_quantity > 3"),
    "duplicate_whole_rows": f"WITH {LONG}, t AS (SELECT record_number, timestamp, l_linenumber,"
        f" {', '.join(LINE_MEASURES)} FROM long_range UNION ALL SELECT record_number, timestamp, l_linenumber,"
        f" {', '.join(LINE_MEASURES)} FROM long_range WHERE l_linenumber = 3)"
        " SELECT * FROM t QUALIFY COUNT(*) OVER (PARTITION BY t) > 1",
    "gap_report_millisecond": f"WITH {READINGS}, g AS (SELECT timestamp,"
        " epoch_us(timestamp) - LAG(epoch_us(timestamp)) OVER (ORDER BY timestamp) AS us FROM readings)"
        " SELECT COUNT(*) AS gaps, MAX(CAST(us AS DOUBLE) / 1000000.0) AS longest, MAX(timestamp) AS last_end"
        " FROM g WHERE us > 1000",
    "correlation_ten_measures": _ten(),
    "monthly_coverage": f"{_lead('long_range')}SELECT year, month, COUNT(*) AS reading_count,"
        " COUNT(DISTINCT day) AS distinct_days_with_readings FROM long_range GROUP BY year, month",
    "monthly_stats": _monthly(),
    "monthly_means": f"{_lead('long_range')}SELECT year, month, {_round(_mean('l_quantity'), 4)} AS l_quantity_mean,"
        f" {_round(_mean('l_discount'), 4)} AS l_discount_mean, make_date(year, month, 1) AS period"
        " FROM long_range GROUP BY year, month",
    "month_over_month": f"WITH {LONG}, m AS (SELECT year, month, {_round(_mean('l_extendedprice'), 2)} AS mean"
        " FROM long_range GROUP BY year, month) SELECT c.year, c.month, c.mean, p.mean AS previous_mean,"
        f" {_round('c.mean - p.mean', 2)} AS change FROM m c LEFT JOIN m p"
        " ON (c.year = p.year AND c.month = p.month + 1)"
        " OR (c.month = 1 AND p.month = 12 AND c.year = p.year + 1)",
    "seasonal_summary": _grouped("long_range", "season", LINE_MEASURES),
    "weekday_summary": _grouped("long_range", "day_of_week", ["l_quantity", "l_extendedprice"]),
    "hourly_cycle": _grouped("readings", "hour", ["value"]),
    "daily_mean_present": f"WITH {LONG}, {_days('long_range', 'l_extendedprice')} SELECT date,"
        f" {_round('value', 2)} AS value FROM days",
    "daily_mean_calendar": f"WITH {ORDERS}, {_calendar('readings', {'value': 'o_totalprice'})}"
        " SELECT date, value FROM days",
    "month_shape_normalised": _shape(),
    "band_counts": f"{_lead('readings')}SELECT CASE WHEN value < 10 THEN 'low' WHEN value < 35 THEN 'moderate'"
        " WHEN value < 70 THEN 'good' ELSE 'high' END AS band, COUNT(*) AS reading_count FROM readings"
        " WHERE value IS NOT NULL GROUP BY 1",
    **dict.fromkeys(
        ("season_band_counts", "sql_season_band_counts"),
        f"{_lead('long_range')}SELECT season, CASE WHEN l_quantity < 10 THEN 'small'"
        " WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS band, COUNT(*) AS reading_count"
        " FROM long_range WHERE l_quantity IS NOT NULL GROUP BY 1, 2",
    ),
    "streamed_daily_means": f"WITH readings AS (SELECT o_orderdate AS timestamp,"
        " CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice END AS value FROM orders),"
        f" {_days('readings', 'value', _round(_mean('value'), 2))} SELECT date, value FROM days",
    "threshold_by_month": f"{_lead('long_range')}SELECT year, month, COUNT(*) AS high_readings FROM long_range"
        " WHERE l_extendedprice > 100000 GROUP BY year, month",
    "daytime_stats_by_group": f"{_lead('readings')}SELECT day_of_week, COUNT(*) AS reading_count,"
        f" {_round(_mean('value'), 3)} AS mean, {_round('MIN(value)', 3)} AS min, {_round('MAX(value)', 3)} AS max"
        " FROM readings WHERE hour >= 6 AND hour < 18 AND value IS NOT NULL GROUP BY day_of_week",
    "months_above_global_mean": f"{_lead('long_range')}SELECT year, month, {_round(_mean('l_extendedprice'), 2)} AS mean"
        f" FROM long_range GROUP BY year, month HAVING {_mean('l_extendedprice')} >"
        f" (SELECT {_mean('l_extendedprice')} * 1.005 FROM long_range)",
    "low_days_with_enough_readings": f"{_lead('long_range')}SELECT year, month, day, COUNT(*) AS reading_count,"
        f" {_round(_mean('l_quantity'), 2)} AS mean FROM long_range WHERE l_quantity IS NOT NULL"
        f" GROUP BY year, month, day HAVING COUNT(*) >= 3 AND {_mean('l_quantity')} < 24",
    "atypical_share_by_season": f"{_lead('long_range')}SELECT season, COUNT(*) AS total_readings,"
        " COUNT(*) FILTER (WHERE l_quantity < 5 OR l_quantity > 45) AS atypical_readings,"
        f" {_round('100.0 * COUNT(*) FILTER (WHERE l_quantity < 5 OR l_quantity > 45) / COUNT(*)', 2)}"
        " AS atypical_pct FROM long_range WHERE l_quantity IS NOT NULL GROUP BY season",
    "event_window_mean": "SELECT 'value' AS parameter, "
        + _round(_mean("value", f"ts BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{_END}'"), 4)
        + f" AS event_mean, {_round(_mean('value'), 4)} AS overall_mean FROM events",
    "describe_measures": _lead("wide") + _describe("wide", EVENT_TYPES, lambda c: f"AVG({c})"),
    "describe_long_range": _lead("long_range") + _describe("long_range", LINE_MEASURES, _mean),
    "coefficient_of_variation": _lead("long_range") + _union(
        f"SELECT '{c}' AS parameter, {_round(f'STDDEV_SAMP({c}) / ABS(AVG({c}))', 6)} AS cv FROM long_range"
        for c in LINE_MEASURES
    ),
    "iqr_outlier_counts": f"WITH {READINGS}, {_long('readings', ['value'])}, {_boxes()}"
        " SELECT parameter, outliers AS iqr_outlier_count FROM boxes",
    "iqr_outlier_counts_wide": f"WITH {WIDE}, {_long('wide', EVENT_TYPES)}, {_boxes()}"
        " SELECT parameter, outliers AS iqr_outlier_count FROM boxes",
    "histogram_counts": _histogram("readings", ["value"], 40),
    "histogram_counts_long_range": _histogram("long_range", ["l_extendedprice", "l_tax"], 60),
    "box_stats": f"WITH {READINGS}, {_long('readings', ['value'])}, {_boxes()} SELECT * FROM boxes",
    "box_stats_by_season": f"WITH {LONG}, {_long('long_range', ['l_quantity', 'l_extendedprice'], 'season')},"
        f" {_boxes('season')} SELECT * FROM boxes",
    "correlation_pairs": f"WITH {WIDE}, m AS ({_union(_corr(a, b, 'wide') for a, b in _pairs(EVENT_TYPES))})"
        f" SELECT column_a, column_b, {_round('r', 6)} AS r FROM m",
    "correlation_matrix": _matrix(),
    "strongest_correlation": f"WITH {LONG}, m AS ({_union(_corr(a, b, 'long_range') for a, b in _pairs(LINE_MEASURES))})"
        f" SELECT column_a, column_b, {_round('r', 6)} AS r FROM m ORDER BY ABS(m.r) DESC LIMIT 1",
    "reproducible_sample": "SELECT event_id AS record_number, ts AS timestamp, value FROM events"
        " ORDER BY md5(concat_ws(':', CAST(event_id AS VARCHAR), '42')), event_id LIMIT 3000",
    "flagged_days_by_measure": _flagged() + " SELECT parameter, flagged_days FROM counts",
    "most_flagged_days": _flagged() + " SELECT parameter, strftime(date, '%Y-%m-%d') AS flagged_date, value FROM flagged"
        " WHERE is_flagged AND parameter = (SELECT parameter FROM counts ORDER BY flagged_days DESC, i LIMIT 1)",
    "rolling_7": f"WITH {LONG}, {_days('long_range', 'l_extendedprice', _round(_mean('l_extendedprice'), 2))}"
        f" SELECT date, value, {_round('rolling', 2)} AS rolling_mean FROM (SELECT date, value,"
        " CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) OVER w AS DOUBLE) / (100 * COUNT(value) OVER w) AS rolling"
        " FROM days WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) AS r",
    "moving_mean_of_readings": f"{_FORTY} SELECT series, {_READING}, {_round('rolling', 2)} AS rolling_mean"
        " FROM (SELECT *, CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) OVER w AS DOUBLE) / (100 * COUNT(*) OVER w)"
        f" AS rolling FROM forty WINDOW w AS (PARTITION BY series ORDER BY {_READING}"
        " ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))",
    "running_mean_of_readings": f"{_FORTY} SELECT series, {_READING}, {_round('running', 4)} AS cumulative_mean"
        " FROM (SELECT *, CAST(SUM(CAST(ROUND(l_quantity * 100) AS BIGINT)) OVER w AS DOUBLE) / (100 * COUNT(*) OVER w)"
        f" AS running FROM forty WINDOW w AS (PARTITION BY series ORDER BY {_READING}"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
    "streaks_of_readings": f"{_FORTY}, g AS (SELECT *, COUNT(*) FILTER (WHERE l_quantity <= 5) OVER (PARTITION BY series"
        f" ORDER BY {_READING} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM forty)"
        " SELECT series, MIN(timestamp) AS streak_start, MAX(timestamp) AS streak_end, COUNT(*) AS length,"
        f" {_round(_mean('l_extendedprice'), 2)} AS streak_mean FROM g WHERE l_quantity > 5"
        " GROUP BY series, run HAVING COUNT(*) >= 20",
    "cumulative_mean": f"WITH {LONG}, {_days('long_range', 'l_quantity')} SELECT date, {_round('value', 4)} AS value,"
        f" {_round('running', 4)} AS cumulative_mean FROM (SELECT date, value, AVG(value) OVER"
        " (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM days) AS r",
    "rank_months": f"WITH {LONG}, m AS (SELECT year, month, {_mean('l_extendedprice')} AS mean FROM long_range"
        f" GROUP BY year, month) SELECT year, month, {_round('mean', 2)} AS mean,"
        " CAST(RANK() OVER (ORDER BY m.mean DESC) AS INTEGER) AS rank FROM m",
    "deviation_from_day_mean": f"WITH {READINGS}, {_days('readings', 'value')} SELECT r.record_number, r.timestamp,"
        f" r.value, {_round('d.value', 2)} AS day_mean, {_round('r.value - d.value', 2)} AS deviation"
        " FROM readings r JOIN days d ON CAST(r.timestamp AS DATE) = d.date"
        " ORDER BY deviation DESC, timestamp, record_number LIMIT 15",
    "all_deviations": f"WITH {READINGS}, {_days('readings', 'value')} SELECT r.record_number, r.timestamp,"
        f" r.value, d.value AS day_mean, r.value - d.value AS deviation"
        " FROM readings r JOIN days d ON CAST(r.timestamp AS DATE) = d.date",
    "anomaly_days_high": f"WITH {LONG}, {_days('long_range', 'l_extendedprice')}, s AS (SELECT AVG(value) AS m,"
        " SQRT(AVG((value - (SELECT AVG(value) FROM days)) * (value - (SELECT AVG(value) FROM days)))) AS sd FROM days)"
        f" SELECT date, {_round('value', 2)} AS value, {_round('m', 2)} AS overall_mean,"
        f" {_round('(value - m) / sd', 2)} AS z_score FROM days, s WHERE (value - m) / sd > 3",
    "anomaly_days_two_sided": f"WITH {ORDERS}, {_calendar('readings', {'value': 'o_totalprice'})},"
        " s AS (SELECT AVG(value) AS m, STDDEV_SAMP(value) AS sd FROM days)"
        " SELECT date, value, COALESCE(ABS((value - m) / NULLIF(sd, 0)) > 3, FALSE) AS is_flagged FROM days, s",
    "streaks_present_days": _streaks(f"WITH {WIDE}, {_days('wide', 'click', 'AVG(click)')}", "value > 50"),
    "streaks_calendar_days": _streaks(
        f"WITH {ORDERS}, {_calendar('readings', {'value': 'o_totalprice'})}", "value > 250000"
    ),
    "streaks_broken_by_gaps": _streaks(
        f"WITH {ORDERS}, {_days('readings', 'o_totalprice')}", "value > 250000", by_gap=True
    ),
    "sampling_intervals": _gaps(READINGS, "readings") + " SELECT CAST(us // 60000000 * 60 AS DOUBLE) AS interval_seconds,"
        " COUNT(*) AS occurrences FROM g WHERE us IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "sampling_intervals_exact": _gaps(READINGS, "readings") + " SELECT CAST(us // 1000 * 1000 AS DOUBLE) / 1000000.0"
        " AS interval_seconds, COUNT(*) AS occurrences FROM g WHERE us IS NOT NULL GROUP BY 1",
    "sampling_intervals_days": _gaps(LONG, "long_range") + " SELECT CAST(us AS DOUBLE) / 1000000.0 AS interval_seconds,"
        " COUNT(*) AS occurrences FROM g WHERE us IS NOT NULL GROUP BY 1",
    "gap_report": _gaps(READINGS, "readings") + " SELECT timestamp AS gap_ends_at, CAST(us AS DOUBLE) / 1000000.0"
        " AS gap_seconds FROM g WHERE us > 300000000",
    "gap_report_days": _gaps(ORDERS, "readings") + " SELECT timestamp AS gap_ends_at, CAST(us AS DOUBLE) / 1000000.0"
        " AS gap_seconds FROM g WHERE us > 86400000000",
}

# Dates are compared as ISO text; the queries print theirs the same way.
ORACLE["bucketed_duplicate_id_rows"] = (
    f"{_lead('long_range')}SELECT {_KEY}, timestamp, l_extendedprice FROM long_range WHERE l_linenumber > 5"
    " QUALIFY COUNT(*) OVER (PARTITION BY record_number) > 1"
)
#: Queries that answer another one's question from a store of their own.
_SAME = {
    "clean_gate_report_bucketed": "clean_gate_report_orders",
    "rollup_monthly_coverage": "monthly_coverage", "rollup_monthly_stats": "monthly_stats",
    "rollup_seasonal_summary": "seasonal_summary", "rollup_weekday_summary": "weekday_summary",
    "rollup_threshold_by_month": "threshold_by_month", "rollup_atypical_share": "atypical_share_by_season",
}
ORACLE |= {name: ORACLE[other] for name, other in _SAME.items()}

_DATES = {
    "date": [
        "annotate_event_table", "annotate_events", "anomaly_days_high", "anomaly_days_two_sided", "cumulative_mean",
        "daily_mean_calendar", "daily_mean_present", "rolling_7", "streamed_daily_means",
    ],
    "period": ["missing_pct_by_month", "monthly_means"],
    "streak_start": ["streaks_present_days", "streaks_calendar_days", "streaks_broken_by_gaps"],
    "streak_end": ["streaks_present_days", "streaks_calendar_days", "streaks_broken_by_gaps"],
}
for _column, _names in _DATES.items():
    for _name in _names:
        ORACLE[_name] = (
            f"SELECT * REPLACE (CAST({_column} AS VARCHAR) AS {_column}) FROM ({ORACLE[_name]}) AS answer"
        )

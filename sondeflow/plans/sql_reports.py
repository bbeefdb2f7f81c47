"""Water-quality reports as SQL over the view ``water_quality``.

They need :func:`sondeflow.functions.sql.register_functions` and give the rows of the
reports of the same name in :mod:`sondeflow.plans.reports`.
"""

from __future__ import annotations

SQL_REPORTS: dict[str, str] = {
    "oxygen_bands": """
        SELECT oxygen_band(dissolved_oxygen) AS oxygen_band, count(*) AS reading_count
        FROM water_quality WHERE dissolved_oxygen IS NOT NULL
        GROUP BY ALL ORDER BY reading_count DESC, oxygen_band
    """,
    "high_turbidity_months": """
        SELECT year, month, count(*) AS high_turbidity_readings
        FROM water_quality WHERE turbidity > 20 GROUP BY year, month ORDER BY year, month
    """,
    "daytime_ph": """
        SELECT season_of(month) AS season, count(*) AS reading_count, round(avg(ph), 3) AS avg_ph,
               round(min(ph), 3) AS min_ph, round(max(ph), 3) AS max_ph
        FROM water_quality WHERE ph IS NOT NULL AND hour BETWEEN 6 AND 17
        GROUP BY ALL ORDER BY avg_ph DESC
    """,
    "turbid_months": """
        WITH overall AS (SELECT avg(turbidity) AS mean FROM water_quality)
        SELECT year, month, round(avg(turbidity), 2) AS avg_turbidity
        FROM water_quality GROUP BY year, month
        HAVING avg(turbidity) > (SELECT 2 * mean FROM overall) ORDER BY avg_turbidity DESC
    """,
    "salinity_classes": """
        SELECT season_of(month) AS season, salinity_class(salinity) AS salinity_class, count(*) AS reading_count
        FROM water_quality WHERE salinity IS NOT NULL
        GROUP BY ALL ORDER BY season, reading_count DESC
    """,
    "low_oxygen_days": """
        SELECT year, month, day, count(dissolved_oxygen) AS reading_count,
               round(avg(dissolved_oxygen), 2) AS avg_dissolved_oxygen
        FROM water_quality GROUP BY year, month, day
        HAVING count(dissolved_oxygen) >= 40 AND avg(dissolved_oxygen) < 6 ORDER BY avg_dissolved_oxygen
    """,
    "atypical_temperatures": """
        SELECT season_of(month) AS season, count(*) AS total_readings,
               count_if(temperature < 15 OR temperature > 30) AS atypical_temp_readings,
               round(try_divide(100.0D * count_if(temperature < 15 OR temperature > 30), count(*)), 2) AS atypical_temp_pct
        FROM water_quality WHERE temperature IS NOT NULL GROUP BY ALL ORDER BY atypical_temp_pct DESC
    """,
}

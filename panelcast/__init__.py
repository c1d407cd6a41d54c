"""panelcast: keyed daily-demand analytics on Spark.

Entry points (all operate on every series of a panel at once):

- ``sources.io``: ``load_panel_csv``, ``ingest_gate``, ``write_csv``; ``sources.tables.daily_sales``
- ``functions.calendar``: ``date_features``, ``time_features``, ``us_federal_holiday``
- ``operators.windows``: ``lag_features``, ``shifted_rolling``, ``trailing_rolling``, ``expanding``,
  ``fill_columns``, ``interpolate_linear``, ``difference_features``, ``interaction_features``
- ``operators.ewm.ewm_features``; ``operators.longseries.chunked``
- ``operators.profile``, ``operators.impute``, ``operators.outliers``, ``operators.isoforest``
- ``operators.diagnostics`` (decomposition, Shapiro-Wilk, Jarque-Bera, KPSS), ``operators.adf``
- ``plans.features.build_features``, ``plans.validation``, ``plans.training``, ``plans.forecast``
- ``streaming.ingest.start_ingest``
"""

from panelcast.spec import FeatureConfig, SeriesSpec

__all__ = ["FeatureConfig", "SeriesSpec"]

"""tidecast: demand forecasting for many locations, as Spark DataFrame operators."""

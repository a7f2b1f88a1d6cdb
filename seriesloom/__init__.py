"""PySpark jobs for panels of time series and the short texts that go with them."""

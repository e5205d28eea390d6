"""Panel-data analytics on Spark: tables of observations keyed by place, kind and period."""

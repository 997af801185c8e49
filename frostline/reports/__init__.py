"""Reports: functions from tables to DataFrames. Every `now` is the parameter as_of."""

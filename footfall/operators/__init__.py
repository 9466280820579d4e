"""The jobs: functions from DataFrames to DataFrames."""

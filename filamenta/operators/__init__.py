"""Table operators: functions of DataFrames that build one lazy plan."""

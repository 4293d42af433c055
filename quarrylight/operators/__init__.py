"""Record-level and set-level operators over DataFrames."""
